"""Upserts, deletes, eviction and queue transitions, as new versions of immutable tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.sources.versions import Versions


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, the largest by its other columns in their order; a null key is a key like others."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    top = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"top.{c}").alias(c) for c in rows.columns])


def same_keys(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}"))
    return on


def merge(old: DataFrame, new: DataFrame, keys: list[str], combine: dict[str, Column] | None = None) -> DataFrame:
    """Rows of new replace rows of old with equal keys, null being equal to null. combine: by column, an expression over old.<c> and
    new.<c> for rows in both. Of several new rows with one key the largest counts; old rows without a new one stay, repeated or not."""
    new = one_per_key(new.select(*old.columns), keys)
    if not combine:
        return old.alias("old").join(new.alias("new"), same_keys(keys), "left_anti").unionByName(new)
    o, n = old.withColumn("in_old", F.lit(True)).alias("old"), new.withColumn("in_new", F.lit(True)).alias("new")
    both = o.join(n, same_keys(keys), "full_outer")
    fresh, gone = F.col("in_old").isNull(), F.col("in_new").isNull()
    pick = lambda c: F.when(fresh, F.col(f"new.{c}")).when(gone, F.col(f"old.{c}")).otherwise(combine.get(c, F.col(f"new.{c}")))
    return both.select(*[pick(c).alias(c) for c in old.columns])


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of old with a key that new has go; new's rows come in."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def delete_by_key(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def evict_to_limit(cache: DataFrame, limit: int, *, age_col: str = "created_at", key_col: str = "key") -> DataFrame:
    """The newest `limit` rows, ties by key."""
    return cache.orderBy(F.desc(age_col), key_col).limit(limit)


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key: a partial aggregate, so a busy key is summed up before it moves."""
    rest = [c for c in events.columns if c != key]
    top = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    return events.groupBy(key).agg(top.alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def recovered(queue: DataFrame) -> DataFrame:
    """processing becomes pending, unless the same file is pending already; then the row goes."""
    pending = queue.where("status = 'pending'").select("file_id").distinct()
    back = queue.where("status = 'processing'").join(pending, "file_id", "left_anti").withColumn("status", F.lit("pending"))
    return queue.where("status <> 'processing'").unionByName(back)


def popped(queue: DataFrame, n: int = 1) -> DataFrame:
    """The next n pending rows."""
    return queue.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "file_id").limit(n)


def moved(queue: DataFrame, rows: DataFrame, status: str) -> DataFrame:
    """The queue with those rows (by file_id) that are not done yet in another status: processing when popped, then completed or failed."""
    named = rows.select("file_id").distinct().withColumn("named", F.lit(True))
    here = F.col("named") & F.col("status").isin("pending", "processing")
    return queue.join(named, "file_id", "left").withColumn("status", F.when(here, F.lit(status)).otherwise(F.col("status"))).select(*queue.columns)


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Tables (each with the name of its reference to `key`) without the rows that refer to deleted keys."""
    keys = gone.select(F.col(key).alias("gone_key")).distinct()
    return {name: t.join(keys, F.col(column) == F.col("gone_key"), "left_anti") for name, (t, column) in tables.items()}


def compacted(table: DataFrame, rows_per_file: int, *, n_rows: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The same rows in as few partitions as hold about rows_per_file each, sorted by `by`, ready to be written anew."""
    n = table.count() if n_rows is None else n_rows
    parts = max(1, -(-n // rows_per_file))
    return table.repartitionByRange(parts, *by).sortWithinPartitions(*by) if by else table.repartition(parts)


def model_checked(cache: DataFrame, stored_model: str | None, model: str) -> DataFrame:
    """The cache, or none of it where it was made by another model."""
    return cache if stored_model == model else cache.where("false")


class VersionedTable:
    """A table as numbered versions and, for each, the folder that holds it.

    A write fills a folder of its own and then makes the next version by naming it, so readers see whole versions only, a write that
    fails changes nothing, and of two writers of one version the second fails without touching the other's files.
    Paths may be anything that Spark's file system layer opens.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/_versions")

    def version(self) -> int:
        return self.versions.latest()[0]

    def read(self) -> DataFrame | None:
        _, now = self.versions.latest()
        return self.spark.read.parquet(f"{self.path}/{now['folder']}") if now else None

    def write(self, df: DataFrame) -> int:
        v, folder = self.version() + 1, f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        self.versions.put(v, {"folder": folder})
        return v

    def clean(self, keep: int = 1) -> None:
        """Deletes all versions but the last `keep`, with their folders."""
        old = self.versions.numbers()[:-keep]
        self.versions.drop([f"{self.path}/{c['folder']}" for n in old if (c := self.versions.get(n))], old)

    def merge(self, new: DataFrame, keys: list[str], combine: dict[str, Column] | None = None) -> int:
        old = self.read()
        return self.write(new if old is None else merge(old, new, keys, combine))

    def replace_by_key(self, new: DataFrame, keys: list[str]) -> int:
        old = self.read()
        return self.write(new if old is None else replace_by_key(old, new, keys))

    def delete(self, gone: DataFrame, keys: list[str]) -> int:
        old = self.read()
        return 0 if old is None else self.write(delete_by_key(old, gone, keys))


def dedup_first(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def with_cache(wanted: DataFrame, cache: DataFrame, key: str, make) -> DataFrame:
    """cache's rows of the wanted keys, and make(the wanted keys that it lacks), with `cached`. Only the latter are computed."""
    known = cache.join(wanted.select(key), key, "left_semi").withColumn("cached", F.lit(True))
    new = make(wanted.select(key).join(cache.select(key), key, "left_anti")).withColumn("cached", F.lit(False))
    return known.unionByName(new.select(*known.columns))


def at_once(jobs: list[tuple], *, parallel: int = 10, most: int = 100, stop: bool = False) -> list[tuple]:
    """(name, value, error) of jobs (name, function) in their order, up to `parallel` at a time, each a Spark job of its own.

    A job that fails has its error, and with stop the jobs that had not begun are left out with an error of their own.
    """
    from concurrent.futures import ThreadPoolExecutor

    if len(jobs) > most:
        raise ValueError(f"{len(jobs)} jobs; at most {most} may be asked for at once")
    failed: list[str] = []

    def run(job: tuple) -> tuple:
        name, f = job
        if stop and failed:
            return name, None, f"left out after {failed[0]}"
        try:
            return name, f(), None
        except Exception as e:  # the caller's own work may fail in any way
            failed.append(name)
            return name, None, str(e)

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(jobs) or 1))) as pool:
        return list(pool.map(run, jobs))
