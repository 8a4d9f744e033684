"""Near-duplicate embeddings: Euclidean p-stable hashing in several tables, then exact cosine.

Vectors are normalised, so cosine c means distance sqrt(2 - 2c). Each of TABLES tables cuts PROJECTIONS random Gaussian projections
into slots of width WIDTH with random offsets; vectors that share all slots of a table and the label are compared
exactly. A pair counts in the first table that holds it, so counts need no list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

TABLES, PROJECTIONS, WIDTH, SEED = 24, 8, 1.0, 20_240_601
#: A bucket with more classes than this is cut into blocks of as many, which are compared pairwise by separate tasks.
BLOCK = 1024


def collision(distance: float, width: float = WIDTH) -> float:
    """How likely one projection puts two vectors at this distance into one slot."""
    if distance <= 0:
        return 1.0
    r = width / distance
    phi = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def recall(cosine: float) -> float:
    """How likely a pair with this cosine shares a bucket of some table."""
    return 1 - (1 - collision(math.sqrt(max(0.0, 2 - 2 * cosine))) ** PROJECTIONS) ** TABLES


def projections(dims: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dims])
    return rng.standard_normal((dims, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def codes(unit: np.ndarray) -> np.ndarray:
    """(vector, table) hashes of the slots."""
    direction, offset = projections(unit.shape[1])
    slots = np.floor((unit @ direction + offset) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS).astype(np.uint64)
    h = np.zeros(slots.shape[:2], np.uint64)
    for k in range(PROJECTIONS):
        h = (h ^ slots[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def usable(vectors: list) -> list[np.ndarray | None]:
    """Each vector in double precision and of length one; None where a vector is null, empty, zero or not finite."""
    out = []
    for v in vectors:
        got = None
        if v is not None and len(v) and None not in v:
            a = np.array(v, float)
            if np.isfinite(a).all() and (top := np.abs(a).max()) > 0:
                a = a / top
                got = a / math.sqrt(float(a @ a))
        out.append(got)
    return out


def linked(vectors: DataFrame, *, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links (other rows linked directly), component_id, kept.

    Rows are linked when labels are equal and not null and the cosine in double precision is at least `cosine`. A vector that is
    null, empty, zero or not finite, or whose label is null, links with nothing; vectors of different lengths do not link. Equal
    vectors of a label form a class that is compared once; its rows link with each other. Repeated rows each count.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists("v", lambda x: x != 0)
    base = stored(base.withColumn("key", F.when(fit, F.sha2(F.concat_ws("|", F.lit("v"), "label", F.array_join("v", ",")), 256))), "vectors-base")
    classes = base.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.min_by(F.struct("label", "v"), "id").alias("x"))
    classes = stored(classes.select("key", F.monotonically_increasing_id().alias("cls"), "rep", "m", "x.*"), "vectors-classes")

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = usable(batch.column("v").to_pylist())
            got: list = [None] * len(units)
            for dims in {len(u) for u in units if u is not None}:
                at = [k for k, u in enumerate(units) if u is not None and len(u) == dims]
                for k, h in zip(at, codes(np.stack([units[k] for k in at]))):
                    got[k] = h.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cls", "rep", "m", "label")), pa.array(units, pa.list_(pa.float64())), pa.array(got, pa.list_(pa.int64()))], ["cls", "rep", "m", "label", "u", "h"])

    hashed = stored(classes.select("cls", "rep", "m", "label", "v").mapInArrow(hash_all, "cls long, rep long, m long, label string, u array<double>, h array<long>"), "vectors-hashed")
    entries = hashed.select("cls", F.xxhash64("label", F.size("u")).alias("l"), F.posexplode("h").alias("t", "slot")).withColumn("bucket", F.xxhash64("l", "t", "slot")).select("cls", "t", "bucket")
    buckets = entries.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    # a bucket's members are dealt to blocks by hash; each pair of blocks is one task, and a block meets itself once
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = entries.join(buckets, "bucket").withColumn("n", blocks).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("bucket", "t", "cls", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    dealt = dealt.join(hashed.select("cls", "rep", "m", "label", "u", "h"), "cls")
    dealt = dealt.repartition(F.col("bucket"), F.col("x"), F.col("y")).sortWithinPartitions("bucket", "x", "y")

    out_schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> list[tuple]:
        """Rows for one pair of blocks: links by class, and links that join components within it."""
        dims = len(table.column("u")[0])
        if any(len(x) != dims for x in table.column("u")):  # two buckets with one hash: by length, then
            sizes = [len(x) for x in table.column("u")]
            return [r for d in sorted(set(sizes)) for r in compare(table.filter(pa.array([n == d for n in sizes])))]
        u = table.column("u").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        h = table.column("h").combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
        cls, rep, m, mine = (table.column(c).to_numpy() for c in ("cls", "rep", "m", "mine"))
        labels = np.array(table.column("label").to_pylist(), object)
        t, x, y = (table.column(c)[0].as_py() for c in ("t", "x", "y"))
        left = np.flatnonzero(mine == x)
        right = left if x == y else np.flatnonzero(mine == y)
        links = np.zeros(len(cls), np.int64)
        parent = list(range(len(cls)))

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        joined = []
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            near = u[rows] @ u[right].T >= cosine
            i, j = np.nonzero(near)
            i, j = rows[i], right[j]
            keep = (i < j) if x == y else np.ones(len(i), bool)
            keep &= labels[i] == labels[j]
            i, j = i[keep], j[keep]
            if t and len(i):
                new = ~(h[i][:, :t] == h[j][:, :t]).any(axis=1)
                i, j = i[new], j[new]
            np.add.at(links, i, m[j])
            np.add.at(links, j, m[i])
            for p, q in zip(i.tolist(), j.tolist()):
                p2, q2 = root(p), root(q)
                if p2 != q2:
                    parent[max(p2, q2)] = min(p2, q2)
                    joined.append((p, q))
        return [(int(cls[k]), int(links[k]), None, None) for k in np.flatnonzero(links)] + [(None, None, int(rep[p]), int(rep[q])) for p, q in joined]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks stand one after the other; one may go on in the next batch."""
        rest: pa.Table | None = None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, out_schema)], schema=out_schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            keys = np.stack([table.column(c).to_numpy() for c in ("bucket", "x", "y")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()] if table.num_rows else [0]
            rows = []
            for start, end in zip(cuts, cuts[1:]):
                rows += compare(table.slice(start, end - start))
            rest = table.slice(cuts[-1])
            yield told(rows)
        if rest is not None and rest.num_rows:
            yield told(compare(rest))

    found = stored(dealt.mapInArrow(run, "cls long, links long, a long, b long"), "vectors-found")
    links = found.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    parts = components(found.where("a is not null").select("a", "b"), "vectors").select(F.col("id").alias("rep"), "component")
    told = classes.select("cls", "key", "rep", "m").join(links, "cls", "left").join(parts, "rep", "left")
    told = told.select("key", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.select("id", "key").join(told, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
