"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix, stored, word_count

#: The random offset has this many values, so that prefix sums plus offset stay exact in a double.
GRAIN = 1 << 20


def size_class(size: Column) -> Column:
    """Sizes of one class agree in the number of digits and the leading two digits."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def source_key(source: Column) -> Column:
    """A key that is never null, for joins."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: str = "mix") -> DataFrame:
    """Per source: source_size, target, rate (expected copies of each document) and offset.

    Weights go to sources by rank (code point order, null last) and repeat. A source's target is its share of
    all sizes by weight, at most max_copies times its own size; the excess is shared again by weight. That
    fixed point is a water level: sources are taken by rising cap/weight, and the level is the largest
    value of (total - caps before) / (weights from here on). The table has one row per source.
    """
    per = sizes.groupBy("k").agg(F.sum("size").alias("source_size"), F.min("source").alias("source"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_copies).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    rising = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / rest)
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(Window.partitionBy()) * F.col("w")))
    offset = F.conv(F.substring(digest(F.concat(F.lit(f"{seed}:"), F.col("k"))), 1, 5), 16, 10).cast("long")
    return per.select(
        "k", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
        (offset / GRAIN).alias("offset"),
    )


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_copies: int = 3,
    seed: str = "mix",
    keep_text: bool = True,
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies.

    Within a source the documents stand in order of size class, a digest of the id, size and id; document m
    is emitted floor(rate*m + offset) - floor(rate*(m-1) + offset) times. Neighbours have like
    sizes, so the words taken come near the target, and no document is taken more than max_copies times.
    The place of a document is its place in its cell (source, size class, two hex digits of the digest) plus
    the number of documents in the cells before, so a source of any size is dealt over many tasks.

    Null texts have size 0 and null sources form one source; a null id is digested as the word "null"; repeated rows are separate
    documents; documents of equal size and id stand by a hash of the text; an empty table gives an empty table. Names of docs'
    other columns do not matter: where one begins with mix_, the four new names begin with prefix_of(docs) instead.
    """
    p = prefix_of(docs)
    kept = docs.columns if keep_text else [id_col]
    measured = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)]).alias("row"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("h"),
    )
    sizes = stored(measured.select("size", "source", "id"), "mix-sizes")
    rows = measured if keep_text else sizes.select(F.struct(F.col("id").alias("c0")).alias("row"), "*", F.lit(0).alias("h"))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "k": source_key(F.col("source")),
            "class": size_class(F.col("size")),
            "cell": F.substring(digest(F.coalesce(F.col("id").cast("string"), F.lit("null"))), 1, 2),
        })

    goal = targets(sizes.select(source_key(F.col("source")).alias("k"), "size", "source"), weights, max_copies, seed)
    cell = ["k", "class", "cell"]
    cells = placed(sizes).groupBy(*cell).agg(F.count("*").alias("n"))
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("class", "cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.drop("n").join(goal, "k")
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "id", "h"))
    out = placed(rows).withColumn("place", place).join(cells, cell)
    last = F.floor(F.col("rate") * (F.col("before") + F.col("place")) + F.col("offset"))
    first = F.floor(F.col("rate") * (F.col("before") + F.col("place") - 1) + F.col("offset"))
    return out.select(
        *[F.col(f"row.c{k}").alias(c) for k, c in enumerate(kept)],
        F.col("size").alias(f"{p}size"),
        F.col("source_size").alias(f"{p}source_size"),
        F.col("target").alias(f"{p}target"),
        (last - first).cast("int").alias(f"{p}copies"),
    )


def prefix_of(docs: DataFrame) -> str:
    """What the new columns of mix(docs) begin with."""
    return free_prefix("mix_", docs.columns)


def repeated(mixed: DataFrame, prefix: str = "mix_") -> DataFrame:
    """Each document as often as the mix takes it, without the columns of the mix. prefix: prefix_of() what was mixed."""
    new = {f"{prefix}{c}" for c in ("size", "source_size", "target", "copies")}
    copies = F.sequence(F.lit(1), F.col(f"{prefix}copies"))
    return mixed.where(F.col(f"{prefix}copies") > 0).withColumn(f"{prefix}copy", F.explode(copies)).select(*[F.col(f"`{c}`") for c in mixed.columns if c not in new])
