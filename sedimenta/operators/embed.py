"""Embedding models without parameters to load: signed feature hashing of terms, in doubles or in int8 with a scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64


def slot(term: Column) -> Column:
    """The dimension that a term counts in: from the first two hex digits of its MD5."""
    return (F.conv(F.substring(F.md5(term.cast("binary")), 1, 2), 16, 10).cast("int") % DIMENSIONS).cast("int")


def sign(term: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(term.cast("binary")), 3, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def hashed_vectors(counts: DataFrame) -> DataFrame:
    """(id, vector) from (id, term, n): each term adds n to its dimension, or takes n off. Ids without terms have no row."""
    per = counts.groupBy("id", slot(F.col("term")).alias("slot")).agg(F.sum(F.col("n") * sign(F.col("term"))).cast("double").alias("x"))
    held = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("m"))  # at most DIMENSIONS entries
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return held.select("id", dense.alias("vector"))


def quantised(vector: Column) -> tuple[Column, Column]:
    """(scale, values): values are bytes in -127..127, and scale * value differs from the component by scale / 2 at most. A zero vector has scale 0."""
    scale = F.array_max(F.transform(vector, lambda x: F.abs(x))) / 127
    return scale, F.transform(vector, lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.round(x / scale)).cast("byte"))


def restored(scale: Column, values: Column) -> Column:
    return F.transform(values, lambda x: x * scale)


#: Models by name: what each makes of (id, vector) of the hashing embedder. A cache is keyed by model and content, so models never mix.
MODELS = ("hash64", "hash64-int8")


def embedded(counts: DataFrame, model: str) -> DataFrame:
    """(id, model, vector) from (id, term, n). hash64-int8 keeps a scale and bytes, and its vectors are those that come back."""
    if model not in MODELS:
        raise ValueError(f"no model {model}; there are {', '.join(MODELS)}")
    rows = hashed_vectors(counts)
    if model == "hash64-int8":
        scale, values = quantised(F.col("vector"))
        rows = rows.select("id", scale.alias("scale"), values.alias("values")).select("id", restored(F.col("scale"), F.col("values")).alias("vector"))
    return rows.select("id", F.lit(model).alias("model"), "vector")
