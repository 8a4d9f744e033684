"""Phrase collocations: count-min sketches of n-grams pick what may be frequent, a second pass counts just that exactly.

First pass: blocks of texts hash their n-grams of 1 to SKETCHED words and give, per row of the sketch and shard of its counters, the
counters that they raise; shards are merged by adding, up to the least count that matters. A counter is never below an n-gram's true count, so
an n-gram whose counters do not all reach it is rare; and the counters of the two parts of a longer n-gram, each a word shorter, are never
below its count either. Second pass: the n-grams that may be frequent, and whose parts may, are counted
by their words, block by block and then over all. So no frequent phrase is lost and every count is exact, whatever the
sketch's size; the size decides how many rare n-grams are counted beside them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LONGEST = 4
#: Longer n-grams have no counters of their own; their parts' ones stand for them.
SKETCHED = 3
LEAST = 30
KEEP = 2000
SUBSUMED = 80
#: Rows of the sketch.
ROWS = 2
#: Counters of a row: a power of two, about one for 8 bytes of text, between these; beyond the upper one the second pass counts more rare n-grams.
FEWEST_BITS, MOST_BITS = 18, 29
#: Counters of a shard.
SHARD_BITS = 20
#: Bytes of text of a block.
BLOCK = 4_000_000
#: N-grams of a task's blocks whose counters are sorted and sent together: the more, the smaller the gaps between counters.
PENDING = 5_000_000

_GAP = b"\n"
#: A-Z to lower case, what ends a piece to \n, tab to space: all ASCII, so UTF-8 stays whole.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + _GAP * 9 + b" ")


class Block:
    """The words of some texts of one language, as numbers.

    words: the distinct words, from number 2; ids: the number of each word in order, 1 between pieces; starts[k]: where a
    run of k words within a piece begins; hashes[k], for k up to SKETCHED: a 64-bit hash of these runs and the language, the same in every block.
    """

    def __init__(self, lang: str, texts: list[str]):
        self.lang = lang
        vocabulary: defaultdict[bytes, int] = defaultdict(count(2).__next__, {b"": 0, _GAP: 1})
        blob = _GAP.join([t.encode() for t in texts]).translate(_FOLD).replace(_GAP, b" \n ")
        words = blob.split(b" ")
        ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words))
        self.ids = ids[ids > 0]
        self.words = list(vocabulary)
        self.n = int(np.count_nonzero(self.ids > 1))
        mark = lang.encode() + b"\0"
        own = np.fromiter((xxhash.xxh64_intdigest(mark + w) for w in self.words), np.uint64, len(self.words))[self.ids]
        held = self.ids > 1
        whole, now = held, own
        self.starts, self.hashes = {1: np.flatnonzero(whole)}, {1: own[whole]}
        for k in range(2, LONGEST + 1):
            whole = whole[:-1] & held[k - 1 :]
            self.starts[k] = np.flatnonzero(whole)
            if k <= SKETCHED:
                now = _mixed(now[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[k - 1 :])
                self.hashes[k] = now[whole]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def counter_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of each hash in a row: rows take different bits of the hash."""
    return (hashes >> np.uint64(64 - bits) if row == 0 else (hashes >> np.uint64(2)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of at most BLOCK bytes of text (or one text) of a task's rows (lang, text), by language."""
    held: defaultdict[str, list[str]] = defaultdict(list)
    size = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column("text")).to_pylist()
        for lang, text, n in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), lengths):
            if size and size + n > BLOCK:
                for key, texts in held.items():
                    yield Block(key, texts)
                held.clear()
                size = 0
            held[lang].append(text)
            size += n
    for key, texts in held.items():
        yield Block(key, texts)


def packed(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending counters and how often each is raised (at most 255), compressed: the gaps by byte planes, then the times."""
    gaps = np.diff(places, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return len(places).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(gaps.T.tobytes() + times.tobytes())


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:], max_output_size=5 * n), np.uint8)
    gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint32), raw[4 * n :]


class Filter:
    """Which counters reached the least count, a bit each, by row."""

    def __init__(self, bits: int):
        self.bits = bits
        self.rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(ROWS)]

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for row, marks in enumerate(self.rows):
            at = counter_of(hashes, row, self.bits)
            ok &= (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return ok


def sketched(rows: DataFrame, bits: int, least: int) -> Filter:
    """Sketches of all blocks of rows (lang, text), merged; what comes to the driver is the filter, of a size that MOST_BITS bounds."""
    shard_bits = min(bits, SHARD_BITS)
    shards = ROWS << (bits - shard_bits)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [[] for _ in range(ROWS)], 0
        for block in blocks(batches):
            for k in range(1, SKETCHED + 1):
                for row in range(ROWS):
                    held[row].append(counter_of(block.hashes[k], row, bits))
                n += len(block.hashes[k])
            if n >= PENDING:
                yield from raised(held)
                held, n = [[] for _ in range(ROWS)], 0
        if n:
            yield from raised(held)

    def raised(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            at = np.concatenate(held[row])
            held[row] = []
            at.sort()
            heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            times = np.minimum(np.diff(heads, append=len(at)), least).astype(np.uint8)
            at = at[heads]
            edges = np.searchsorted(at >> np.uint32(shard_bits), np.arange((1 << (bits - shard_bits)) + 1))
            full = np.flatnonzero(np.diff(edges))
            low = at & np.uint32((1 << shard_bits) - 1)
            data = [packed(low[edges[s] : edges[s + 1]], times[edges[s] : edges[s + 1]]) for s in full]
            yield pa.RecordBatch.from_pydict({"shard": pa.array(row << (bits - shard_bits) | full, pa.int32()), "data": pa.array(data, pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                at, times = unpacked(data.as_py())
                if shard not in sums:
                    sums[shard] = np.zeros(1 << shard_bits, np.uint8)
                sums[shard][at] = np.minimum(sums[shard][at] + times, least)  # each at most `least` < 128, so the sum fits
        for shard, total in sums.items():
            marks = zstandard.ZstdCompressor(level=3).compress(np.packbits(total >= least).tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "marks": pa.array([marks], pa.binary())})

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 32)
    told = rows.mapInArrow(sketch, "shard int, data binary").repartition(parts, "shard").mapInArrow(merge, "shard int, marks binary")
    out = Filter(bits)
    size = (1 << shard_bits) // 8
    for r in told.collect():
        row, shard = divmod(r["shard"], 1 << (bits - shard_bits))
        out.rows[row][shard * size : (shard + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["marks"]), max_output_size=size), np.uint8)
    return out


def _survivors(block: Block, passing: Filter) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Per number of words the n-grams of a block that may be frequent, and their counts in it."""
    before = np.zeros(len(block.ids) + 1, np.int64)  # per start: 1 + number of the n-gram there, one word shorter, or 0
    for k in range(1, LONGEST + 1):
        starts = block.starts[k]
        ok = passing.passes(block.hashes[k]) if k <= SKETCHED else np.ones(len(starts), bool)
        if k > 1:
            ok &= (before[starts] > 0) & (before[starts + 1] > 0)  # both parts may be frequent
        starts = starts[ok]
        key = block.ids[starts] if k == 1 else before[starts] << 32 | block.ids[starts + k - 1]
        _, first, number, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        before = np.zeros(len(block.ids) + 1, np.int64)
        before[starts] = number + 1
        words, at = block.words, block.ids[starts[first][:, None] + np.arange(k)].tolist() if len(first) else []
        yield k, [b" ".join([words[i] for i in ids]) for ids in at], times


def counted(rows: DataFrame, passing: Filter, least: int) -> DataFrame:
    """(lang, phrase, size, f) of every n-gram with f >= least, exactly, and of each language's words together (size 0, phrase empty)."""
    shared = rows.sparkSession.sparkContext.broadcast(passing)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield batch_of(block.lang, 0, [b""], np.array([block.n]))
            for k, phrases, times in _survivors(block, shared.value):
                if phrases:
                    yield batch_of(block.lang, k, phrases, times)

    def batch_of(lang: str, k: int, phrases: list[bytes], times: np.ndarray) -> pa.RecordBatch:
        n = len(phrases)
        return pa.RecordBatch.from_pydict({"lang": [lang] * n, "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "size": pa.array([k] * n, pa.int32()), "f": pa.array(times, pa.int64())})

    found = rows.mapInArrow(run, "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("size") == 0) | (F.col("f") >= least))


def scored(counts: DataFrame, keep: int = KEEP) -> DataFrame:
    """The best `keep` phrases of each language by the score of their weakest cut, without those that a longer one mostly holds."""
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    grams = counts.where("size > 0").select("lang", "phrase", F.col("f"))
    phrases = counts.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("words"))
    part = lambda at, size: F.array_join(F.slice("words", at, size), " ")
    cuts = phrases.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size")).alias("tail"))
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(grams.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("CAST(a AS DECIMAL(19,0)) * CAST(2000000 AS DECIMAL(7,0)) div (CAST(l AS DECIMAL(19,0)) + r)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda at: part(at, m))))
    longer = phrases.where("size > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    held = F.col("within").isNotNull() & (F.col("within").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * SUBSUMED)
    best = best.join(longer, ["lang", "phrase"], "left").where(~held)
    order = (F.desc("cut.score"), F.desc("a"), F.col("phrase"))
    cell = F.pmod(F.xxhash64("phrase"), F.lit(16))  # the first ones of a language's sixteen parts, then of these
    top = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", cell).orderBy(*order))).where(F.col("rank") <= keep)
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= keep)
    return top.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def mine(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, keep: int = KEEP, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's phrases of 2 to LONGEST words with at least `least` (2 to 127) occurrences.

    Whole texts are read; a null text is empty, a null language is `und` and one with it. Repeated rows count as often as they
    stand there. Other columns are not read, whatever their names. An empty table gives no rows. bits: the sketch's
    width as a power of two, else by the bytes of all texts; it changes no result.
    """
    if not 2 <= least <= 127:
        raise ValueError("least is from 2 to 127")
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(FEWEST_BITS, (size // 8).bit_length()))
    counts = stored(counted(rows, sketched(rows, bits, least), least), "phrases")
    return scored(counts, keep)
