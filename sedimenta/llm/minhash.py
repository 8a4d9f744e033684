"""Near-duplicate texts: bottom-k sketches from one hash function, inverted lists, union-sketch estimates, exact Jaccard.

A document's set holds its distinct word shingles; its sketch holds the K smallest hashes of the set (the whole set where it has
no more). The steps:

1. Documents with equal sets form a class, which a number stands for from here on.
2. Inverted lists of runs of RUN neighbouring values of the sketch find the classes that can have a partner at all.
3. For those, values of the sketch stand by how many classes hold them, rarest first. Two sketches that must overlap in c of n
   values share one of the first n - c + 1 in any order, so only these go to inverted lists, without values of a single class.
4. Each list links its members to its smallest member. Overlaps that the sketches of a pair allow are estimated from the
   union sketch; exact Jaccard on full sets confirms or refutes.
5. Members of a list that are in different components after that, and whose places in the lists allow the overlap, are
   compared in the same way. Pairs within one component need no comparison: they change no result.
6. Components of the confirmed links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, stored

WORDS = re.compile("[^\x20\x09-\x0d]+")
SHINGLE = 5
K = 256
#: Runs of this many neighbouring values, of the first RUN_K of a sketch: two sets of similarity 0.8 share none once in 2e6 times, of 0.85 once in 1e8.
RUN, RUN_K = 3, 40
#: Sketches of partners may overlap by this many standard deviations less than expected.
SLACK = 5.0
#: Ids that are broadcast at most.
SMALL = 500_000
_LOWER = {c: c + 32 for c in range(65, 91)}
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted hashes of the shingle sets of texts; hashes of words are remembered up to a bound."""

    def __init__(self, width: int = SHINGLE, memory: int = 300_000):
        self.width, self.memory, self.known = width, memory, {}

    def of(self, text: str | None) -> np.ndarray:
        words = WORDS.findall((text or "").translate(_LOWER) if text and not text.islower() else text or "")
        if not words:
            return np.empty(0, np.uint64)
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
                if len(known) < self.memory and len(w) <= 64:
                    known[w] = h
            out.append(h)
        h = np.array(out, np.uint64)
        n = min(self.width, len(h))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total = mixed(total * _MIX[0] + h[k : k + len(total)] + np.uint64(k + 1))
        if n < self.width:  # a short text's whole sequence, told apart from shingles by its length
            total = mixed(total + np.uint64(n))
        return np.unique(total >> np.uint64(1))  # fits a signed 64-bit integer


def runs_of(values: np.ndarray) -> np.ndarray:
    """A hash of each run of RUN neighbouring values among the first RUN_K, or of all values where there are fewer; of up to
    2 * RUN values each one as well, since so few may be split by a difference into shorter runs."""
    first = values[:RUN_K]
    n = min(RUN, len(first))
    total = np.zeros(len(first) - n + 1, np.uint64) + np.uint64(n)
    for k in range(n):
        total = mixed(total * _MIX[0] + first[k : k + len(total)])
    if len(first) <= 2 * RUN:
        total = np.concatenate([total, mixed(first + _MIX[2])])
    return total >> np.uint64(1)


def lists_of(arrays: list[np.ndarray | None]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([0 if a is None else len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([*(a for a in arrays if a is not None), np.empty(0, np.uint64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([a is None for a in arrays]))


def hashed(docs: DataFrame, id_col: str, text_col: str, width: int, *, sets: bool) -> DataFrame:
    """id, n (set size), s1 and s2 (which stand for the set), and either the runs' hashes, or the sketch and, where it has not
    the whole set, the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                got = [shingler.of(t) for t in part.column("text").to_pylist()]
                rows = {"id": part.column("id"), "n": pa.array([len(s) for s in got], pa.int64())}
                with np.errstate(over="ignore"):
                    rows["s1"] = pa.array([int(np.bitwise_xor.reduce(mixed(s))) >> 1 if len(s) else 0 for s in got], pa.int64())
                    rows["s2"] = pa.array([int(mixed(s + _MIX[1]).sum(dtype=np.uint64)) >> 1 if len(s) else 0 for s in got], pa.int64())
                if sets:
                    rows["sketch"] = lists_of([s[:K] for s in got])
                    rows["set"] = lists_of([s if len(s) > K else None for s in got])
                else:
                    rows["runs"] = lists_of([runs_of(s) if len(s) else s for s in got])
                yield pa.RecordBatch.from_pydict(rows)

    schema = "id long, n long, s1 long, s2 long, " + ("sketch array<long>, set array<long>" if sets else "runs array<long>")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def chosen(docs: DataFrame, ids: DataFrame, *, small: int = SMALL) -> DataFrame:
    """The rows of docs whose id is in ids. Up to `small` ids are broadcast, so that texts stay where they are; beyond that both sides are shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= small else ids, "id", "left_semi")


def linked(docs: DataFrame, *, similarity: str = "0.85", width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Two documents are linked when 100 * |A & B| >= 100 * similarity * |A | B| on their full sets. Null, empty and blank
    texts have empty sets and are linked with nothing; a text with fewer words than a shingle has one shingle, the whole. Rows
    with equal ids are taken together in components but each gives a row; a null id is linked with nothing and kept.
    An empty table gives an empty table.
    """
    t = Fraction(similarity)
    tf = float(t)
    marks = stored(hashed(docs, id_col, text_col, width, sets=False), "minhash-marks")
    some = marks.where("n > 0 and id is not null")

    # 1. classes of equal sets. A class may hold most rows: its rows meet its number in a join of two plain exchanges, whose skewed
    # partitions Spark splits
    sig = ["s1", "s2", "n"]
    classes = stored(some.groupBy(*sig).agg(F.min("id").alias("rep")), "minhash-sets")
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cls"), *sig, "rep"), "minhash-classes")
    member = stored(some.select("id", *sig).join(classes.select("cls", *sig), sig).select("id", "cls").distinct(), "minhash-members")
    # an id with several texts is in several classes, which belong together
    several = member.groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b").select("id", "a")
    same = member.join(several, "id").where("a < cls").select("a", F.col("cls").alias("b"))

    # 2. classes that share a run of sketch values with another class: lists of runs with more than one set
    keys = some.select("id", "s1", F.explode("runs").alias("key"))
    common = keys.groupBy("key").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("key")
    maybe = keys.select("id", "key").join(common, "key", "left_semi").select("id").distinct()
    maybe = stored(classes.join(member.join(maybe, "id").select("cls").distinct(), "cls"), "minhash-maybe")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    pool = hashed(chosen(texts, maybe.select(F.col("rep").alias("id")).distinct()), "id", "text", width, sets=True)
    # the text of an id that has several may be of another class
    pool = pool.join(maybe.select("cls", F.col("rep").alias("id"), *sig), ["id", *sig]).dropDuplicates(["cls"])
    pool = stored(pool.select(F.col("cls").alias("id"), F.col("id").alias("rep"), "n", "sketch", "set"), "minhash-pool")

    # 3. values by rarity, and the inverted lists of the leading ones
    values = pool.select("id", F.explode("sketch").alias("v"))
    held = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    size = F.size("sketch")
    # where the sketches of a class and of every possible partner hold whole sets, they must overlap as the sets do
    whole = F.ceil(size * F.lit(tf) - 1e-9)
    sampled = F.greatest(F.lit(1), F.floor(size * F.lit(tf) - SLACK * F.sqrt(size * F.lit(tf * (1 - tf)))))
    need = F.when(F.col("n") * t.denominator <= K * t.numerator, whole).otherwise(sampled).cast("int")
    sizes = pool.select("id", "rep", "n", size.alias("k"), need.alias("c"))
    ranked = values.join(held, "v").join(sizes, "id")
    by_rarity = Window.partitionBy("id").orderBy("df", "v")
    single = F.col("k") - F.count("*").over(Window.partitionBy("id"))  # values of this class alone stand first
    lists = ranked.withColumn("at", single + F.row_number().over(by_rarity) - 1).where("at <= k - c").select("v", "id", "rep", "n", "k", "at")
    lists = stored(lists, "minhash-lists")

    sets = pool.select("id", F.coalesce("set", "sketch").alias("set"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Of distinct pairs (a, b), those whose union sketch allows the similarity and whose full sets have it."""
        fits = (F.greatest("na", "nb") * F.lit(t.numerator) <= F.least("na", "nb") * F.lit(t.denominator)) if "na" in pairs.columns else F.lit(True)
        pairs = pairs.where(fits).select("a", "b").distinct()
        left = pool.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("k1"))
        right = pool.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("k2"))
        both = pairs.join(left, "a").join(right, "b")
        # the smallest K of the union are a sample of it, of which the values in both sketches are in the intersection
        union = F.slice(F.sort_array(F.array_union("k1", "k2")), 1, K)
        agreed = F.size(F.array_intersect(F.array_intersect("k1", "k2"), union))
        u = F.size(union)
        both = both.where(agreed >= u * F.lit(tf) - F.lit(SLACK) * F.sqrt(u * F.lit(tf * (1 - tf)))).select("a", "b")
        x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
        shared = F.size(F.array_intersect("x", "y")).cast("long")
        full = both.join(x, "a").join(y, "b").withColumn("i", shared)
        full = full.where(F.col("i") * t.denominator >= (F.size("x") + F.size("y") - F.col("i")) * t.numerator)
        return stored(full.select("a", "b"), name)

    # 4. every list's members with its smallest by document id, which copies of one text tend to have in common
    heads = lists.groupBy("v").agg(F.min(F.struct("rep", "id", "n")).alias("head"))
    stars = lists.join(heads, "v").where(F.col("id") != F.col("head.id"))
    links = confirmed(stars.select(F.col("head.id").alias("a"), F.col("id").alias("b"), F.col("head.n").alias("na"), F.col("n").alias("nb")), "minhash-stars")
    first = components(links, "minhash-first")

    # 5. what is left: members of one list in different components
    placed = lists.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    alone = placed.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("v")
    placed = placed.join(alone, "v", "left_semi")
    lead = placed.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("lead"))  # at most K values
    placed = stored(placed.join(lead, "id"), "minhash-left")
    one = placed.select("v", *[F.col(c).alias(f"{c}1") for c in ("id", "n", "k", "at", "component", "lead")])
    two = placed.select("v", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "k", "at", "component", "lead")])
    # values before a shared one are shared by none, or by an earlier list: what can still be shared must be enough
    rest = F.least(F.col("k1") - F.col("at1"), F.col("k2") - F.col("at2"))
    enough = F.when(
        (F.col("n1") <= K) & (F.col("n2") <= K),
        rest * (t.numerator + t.denominator) >= (F.col("n1") + F.col("n2")) * t.numerator,
    ).otherwise(F.lit(True))
    ratio = F.greatest("n1", "n2") * t.numerator <= F.least("n1", "n2") * t.denominator
    # a pair comes up in the first list that holds both, and in no other
    once = F.get(F.array_intersect("lead1", "lead2"), F.lit(0)) == F.col("v")
    across = one.join(two, "v").where((F.col("id1") < F.col("id2")) & (F.col("component1") != F.col("component2")) & ratio & enough & once)
    more = confirmed(across.select(F.col("id1").alias("a"), F.col("id2").alias("b")), "minhash-across")

    # 6. components of classes, then of documents
    known = components(links.unionByName(more).unionByName(same), "minhash-last").select(F.col("id").alias("cls"), "component")
    whole_of = classes.select("cls", "rep").join(known, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = whole_of.groupBy("component").agg(F.min("rep").alias("c"))
    named = stored(whole_of.join(least, "component").select("cls", "c"), "minhash-named")
    named = member.join(named, "cls").groupBy("id").agg(F.min("c").alias("c"))
    out = marks.select("id", "n").join(named, "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("c", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(True)).alias("kept"),
    )
