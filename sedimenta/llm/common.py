"""What the training-data operators share: expressions, scratch tables and distributed components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """The words of a text in order; no words for null."""
    return bind(trimmed(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES)))


def word_count(text: Column) -> Column:
    return bind(trimmed(text), lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACES)))).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(key: Column, of: int = 5) -> Column:
    """crc32 of the key as text, modulo the number of folds."""
    return F.crc32(key.cast("string").cast("binary")) % of


def free_prefix(prefix: str, columns: list[str]) -> str:
    """prefix, made longer by underscores until no column begins with it."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix += "_"
    return prefix


_LOCAL: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of spark.checkpoint.dir. The folders stay until clear() deletes them, as lazy results read them.

    Only where that setting is absent a temporary folder stands in for it, which goes when the process ends; it serves a session in one
    process (tests, a laptop), and on a cluster the setting is asked for.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="sedimenta-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        base = f"file://{_LOCAL[0]}"
    _MADE.append(f"{base.rstrip('/')}/sedimenta/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> int:
    """Deletes the folders that this process has asked for, when no result that reads them is needed any more; returns how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_MADE)
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends there, and columns can be pruned."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(rows: DataFrame, per_part: int = 16_384) -> tuple[int, int]:
    """How many rows there are, and how many partitions of at most `per_part` rows on average they fill (the session's number at least)."""
    n = rows.count()
    return n, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // per_part))


def positions(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows (k, ...) with idx, the place from 0 within k by `order`, and n, the rows of k.

    Rows are dealt by ranges of (k, order), numbered within their range, and each range's number of rows moves the next ones
    on; so a k of any size is spread over tasks. Rows that `order` does not tell apart have to be equal.
    """
    _, parts = parts_for(rows, 100_000)
    placed = stored(rows.repartitionByRange(parts, "k", *order).sortWithinPartitions("k", *order).withColumn("m", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("part", F.shiftright("m", 33))
    ranges = placed.groupBy("k", "part").agg(F.count("*").alias("c"), F.min("m").alias("first"))  # a row per range and group that meets it
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("k", "part", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("k")).alias("n"))
    return placed.join(ranges, ["k", "part"]).withColumn("idx", F.col("before") + F.col("m") - F.col("first")).drop("m", "part", "first", "before")


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges (a, b): component is the smallest id that can be reached.

    Each round gives every id the smallest label among its neighbours', then the label of that label, so
    the number of rounds follows the logarithm of the longest chain. Every round ends in a shared table.
    """
    both = stored(
        edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
        .unionByName(edges.select(F.col("b").cast("long").alias("a"), F.col("a").cast("long").alias("b")))
        .where("a <> b")
        .distinct(),
        f"{name}-edges",
    )
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), f"{name}-0")
    for turn in range(1, max_rounds):
        near = (
            both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("c").alias("c"))
        )
        hop = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = stored(
            labels.join(near, "id", "left")
            .join(hop, "component", "left")
            .select("id", F.least("component", "c", "up").alias("component"), (F.least("component", "c", "up") < F.col("component")).alias("moved")),
            f"{name}-{turn}",
        )
        moved = new.where("moved").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
