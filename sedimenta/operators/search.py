"""Keyword search, vector top-k, rank fusion and relevance signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
PART = 5_000  # rows of a list that are searched at once


def squared_l2(vector: Column, query: Column) -> Column:
    return F.aggregate(F.zip_with(vector, query, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 when lengths differ or a norm is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def vector_topk(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k nearest rows with `distance` and `score` = 1 / (1 + distance); filters apply before the cut. Ties by id.

    The cut is TakeOrderedAndProject: each task keeps k rows.
    """
    q = literal_vector(query)
    d = squared_l2(F.col(vector_col), q) if metric == "l2" else 1 - cosine(F.col(vector_col), q) if metric == "cosine" else -dot(F.col(vector_col), q)
    rows = vectors if where is None else vectors.where(where)
    return rows.withColumn("distance", d).orderBy("distance", id_col).limit(k).withColumn("score", 1 / (1 + F.col("distance")))


def phrase_hits(tokens: DataFrame, phrase: list[str], *, keys: tuple[str, ...] = ("file_id", "line")) -> DataFrame:
    """Where the words stand in a row: each word's positions shifted to the phrase's start, then counted."""
    parts = [tokens.where(F.col("term") == w).select(*keys, (F.col("pos") - k).alias("pos"), F.lit(k).alias("part")) for k, w in enumerate(phrase)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*keys, "pos").agg(F.count_distinct("part").alias("n")).where(F.col("n") == len(phrase)).drop("n")


def ranked(df: DataFrame, *order) -> DataFrame:
    """A rank over a list that has been cut to a few rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def fuse(vector: DataFrame, keyword: DataFrame, *, min_score: float = 0.0, k: int = 10) -> DataFrame:
    """Reciprocal rank fusion of two cut lists (id, rank, and score on the vector side): sums of 1 / (60 + rank) by id, divided by the largest."""
    a = vector.select("id", (1 / (RRF_K + F.col("rank"))).alias("part"), "score", F.lit(True).alias("semantic"), F.lit(False).alias("keyword"))
    b = keyword.select("id", (1 / (RRF_K + F.col("rank"))).alias("part"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("semantic"), F.lit(True).alias("keyword"))
    fused = a.unionByName(b).groupBy("id").agg(F.sum("part").alias("rrf"), F.max("score").alias("vector_score"), F.bool_or("semantic").alias("s"), F.bool_or("keyword").alias("w"))
    top = F.max("rrf").over(Window.partitionBy())
    kind = F.when(F.col("s") & F.col("w"), "hybrid").when(F.col("s"), "semantic").otherwise("keyword")
    out = fused.withColumn("score", F.col("rrf") / top).where(F.col("score") >= min_score).withColumn("match_type", kind)
    return out.orderBy(F.desc("score"), "id").limit(k).select("id", "rrf", "score", "vector_score", "match_type")


def recency_boost(age_days: Column) -> Column:
    return F.when(age_days <= 1, 1.15).when(age_days <= 7, 1.05).when(age_days <= 30, 1.0).when(age_days <= 90, 0.95).otherwise(0.90)


def size_penalty(size_bytes: Column) -> Column:
    kb = F.floor(size_bytes / 1024)
    return F.when(kb <= 50, 1.0).when(kb <= 200, 0.98).when(kb <= 500, 0.95).when(kb <= 1000, 0.90).otherwise(0.85)


#: Weights (vector, path, symbols, summary) by what a query asks; the first rule that fits holds.
WEIGHTS = (
    (r"where|defined|find", (0.25, 0.15, 0.50, 0.10)),
    (r"how|explain|what", (0.35, 0.15, 0.15, 0.35)),
    (r"/|\.rs|\.ts|\.js", (0.30, 0.40, 0.20, 0.10)),
)
DEFAULT_WEIGHTS = (0.40, 0.20, 0.25, 0.15)


def adaptive_weights(query: Column) -> Column:
    q = F.lower(query)
    make = lambda w: F.struct(*[F.lit(x).alias(n) for n, x in zip(("vector", "path", "symbols", "summary"), w)])
    out = make(DEFAULT_WEIGHTS)
    for pattern, w in reversed(WEIGHTS):
        out = F.when(q.rlike(pattern), make(w)).otherwise(out)
    return out


def stem(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(word.endswith("ing") & (n > 5), F.left(word, n - 3))
        .when(word.endswith("ed") & (n > 4), F.left(word, n - 2))
        .when(word.endswith("s") & (n > 3), F.left(word, n - 1))
        .otherwise(word)
    )


def similarity_ratio(a: Column, b: Column) -> Column:
    """Characters of a that occur in b, over the longer byte length; 1 when both are empty."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    chars = F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)))
    hits = F.when(F.length(a) == 0, F.lit(0)).otherwise(F.size(F.filter(chars, lambda c: F.contains(b, c))))
    return F.when(longest == 0, F.lit(1.0)).otherwise(hits / longest)


def keyword_share(words: list[str], text: Column) -> Column:
    """Share of the words that the text contains."""
    got = sum(F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words)
    return F.least(got / F.lit(len(words)), F.lit(1.0))


def path_score(words: list[str], path: Column) -> Column:
    """0.3 for a word in the file name, 0.1 for one elsewhere in the path; 1 at most."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    total = sum(F.when(F.contains(name, F.lit(w)), 0.3).when(F.contains(F.lower(path), F.lit(w)), 0.1).otherwise(0.0) for w in words)
    return F.least(total, F.lit(1.0))


def confidence(*signals: Column) -> Column:
    """1 less the population standard deviation of the signals, within 0 and 1."""
    mean = sum(signals) / len(signals)
    var = sum((s - mean) * (s - mean) for s in signals) / len(signals)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.sqrt(var)))


def relevance(vector: Column, path: Column, symbols: Column, summary: Column, weights: Column, recency: Column, size: Column) -> tuple[Column, Column]:
    """(base, final): the weighted sum of the signals, and the same with recency and size, within 0 and 1."""
    base = vector * weights["vector"] + path * weights["path"] + symbols * weights["symbols"] + summary * weights["summary"]
    return base, F.least(F.greatest(base * recency * size, F.lit(0.0)), F.lit(1.0))


def some_names(names: Column) -> Column:
    return F.concat(F.lit("contains relevant symbols ("), F.array_join(F.slice(names, 1, 3), ", "), F.lit(")"))


def told(*parts: Column) -> Column:
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "found in search results").otherwise(text)


#: Thresholds above which a signal is named.
def reason(base: Column, weights: Column, names: Column, recency: Column, sure: Column) -> Column:
    """Why a file was selected: each weight's part of the base score, recency and confidence (see confidence())."""
    part = {k: base * weights[k] for k in ("vector", "path", "symbols", "summary")}
    return told(
        F.when(part["vector"] > 0.28, "high semantic similarity").when(part["vector"] > 0.20, "good semantic match"),
        F.when(part["path"] > 0.12, "path matches query"),
        F.when((part["symbols"] > 0.15) & (F.size(names) > 0), some_names(names)),
        F.when(part["summary"] > 0.10, "summary matches query"), F.when(recency > 1.0, "recently modified"), F.when(sure > 0.8, "high confidence"),
    )


def plain_reason(vector: Column, path: Column, symbols: Column, summary: Column, names: Column) -> Column:
    """The older form, from the signals themselves."""
    return told(
        F.when(vector > 0.7, "high semantic similarity").when(vector > 0.5, "good semantic match"), F.when(path > 0.3, "path matches query keywords"),
        F.when((symbols > 0.5) & (F.size(names) > 0), some_names(names)), F.when(summary > 0.5, "summary matches query"),
    )


def preview(content: Column) -> Column:
    """The first three lines, and dots if there are more."""
    parts = F.split(content, "\n", -1)
    return F.concat(F.array_join(F.slice(parts, 1, 3), "\n"), F.when(F.size(parts) > 3, F.lit("...")).otherwise(F.lit("")))


def match_reason(content: Column, symbol: Column, kind: Column, query: str) -> Column:
    """What of a hit holds the query: its symbol's name (by kind), the beginning of a doc comment, a text with imports, one with type
    definitions, or just its text."""
    q = F.lit(query.lower())
    inside = lambda text: F.coalesce(F.contains(F.lower(text), q), F.lit(False))
    any_of = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(content, w))
    name = F.when(kind == "function", "FunctionName").when(kind.isin("struct", "class"), "ClassName").when(kind.isin("enum", "trait", "interface"), "TypeDefinition").otherwise("SymbolName")
    place = F.coalesce(*[F.nullif(F.position(F.lit(mark), content), F.lit(0)) for mark in ("///", "/**", '"""')])
    comment = F.substr(content, place, F.lit(200))
    return (
        F.when(inside(symbol), name).when(F.coalesce(inside(comment), F.lit(False)), "DocComment")
        .when(any_of("use ", "import ", "from ") & inside(content), "ImportStatement")
        .when(any_of("struct ", "enum ", "class ", "interface ", "type ") & inside(content), "TypeDefinition").otherwise("CodeContent")
    )


#: How a declaration names what it declares, in the order in which they are looked for.
DECLARED = (r"\sfn [^\p{L}\p{N}_]*([^(<]+)[(<]", r"^(?:export )?function\s+([^\s(<]+)", r"const (.*?) = ", r"^def ([^(]*)", r"class (.*?)[ {(<]", r"(?:struct|enum) (.*?)[ {<]")


def declared_name(content: Column) -> Column:
    """The name that one of the first five lines declares; null without one."""
    lines = F.transform(F.slice(F.split(content, "\n", -1), 1, 5), lambda t: F.trim(t))

    def name(line: Column) -> Column:
        got = [F.nullif(F.trim(F.regexp_extract(line, p, 1)), F.lit("")) for p in DECLARED]
        return F.coalesce(*got)

    return F.get(F.filter(F.transform(lines, name), lambda x: x.isNotNull()), F.lit(0))


def sanitised(query: Column) -> Column:
    """A phrase for the keyword index: trimmed, quotes doubled, quoted; null for an empty query, which finds nothing."""
    q = F.trim(query)
    return F.when(q != "", F.concat(F.lit('"'), F.replace(q, F.lit('"'), F.lit('""')), F.lit('"')))


def ivf_assign(vectors: DataFrame, centroids: list[list[float]], *, vector_col: str = "embedding") -> DataFrame:
    """vectors with the number of the nearest of a few centroids."""
    distances = F.array(*[squared_l2(F.col(vector_col), literal_vector(c)) for c in centroids])
    return vectors.withColumn("centroid", (F.array_position(distances, F.array_min(distances)) - 1).cast("int"))


def ivf_topk(vectors: DataFrame, queries: DataFrame, k: int, *, lists: int = 16, probes: int = 12, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Approximate top-k for each query: query_id, id, distance. K-means lists (fit on a bounded sample by hash), of which the nearest few are searched exactly.

    Lists are dealt out in parts of about PART rows, and each part hands on k rows a query, ties by id; no product of rows is made.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    whole = vectors.where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull()))
    sample = whole.orderBy(F.xxhash64(id_col), id_col).limit(20_000).select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    centroids = [c.tolist() for c in KMeans(k=lists, seed=1, maxIter=10).fit(sample).clusterCenters()]
    assigned = ivf_assign(vectors, centroids, vector_col=vector_col).where("centroid is not null")
    parts = {r["centroid"]: -(-r["count"] // PART) for r in assigned.groupBy("centroid").count().collect()}
    n_parts = F.get(F.array(*[F.lit(parts.get(c, 1)) for c in range(len(centroids))]), F.col("centroid"))
    held = assigned.select("centroid", F.pmod(F.xxhash64(id_col), n_parts).cast("int").alias("part"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    distances = F.array(*[F.struct(squared_l2(F.col(vector_col), literal_vector(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)])
    near = F.filter(F.slice(F.array_sort(distances), 1, probes), lambda x: x["d"].isNotNull())
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.explode(near).alias("near")).select("id", "v", F.col("near.i").alias("centroid"))
    asked = asked.select("centroid", F.explode(F.sequence(F.lit(0), (n_parts - 1).cast("int"))).alias("part"), "id", "v")

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if a.num_rows and b.num_rows:
            matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            b = b.sort_by("id")
            q, v, ids, asking = matrix(a), matrix(b), b["id"].to_numpy(), a["id"].to_numpy()
            step = max(1, 4_000_000 // v.size)
            for at in range(0, len(q), step):
                d = ((q[at : at + step, None, :] - v[None]) ** 2).sum(axis=2)
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                for col, x in zip(out, (np.repeat(asking[at : at + step], best.shape[1]), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel())):
                    col.append(x)
        return pa.table(dict(zip(("query_id", "id", "distance"), map(np.concatenate, out))))

    found = asked.groupBy("centroid", "part").cogroup(held.groupBy("centroid", "part")).applyInArrow(nearest, "query_id long, id long, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", F.col("id").alias(id_col), "distance")


def weigh(word: Column, n: Column):
    """What a directory, at place k of n, adds for a word that it contains."""
    return lambda d, k: F.when(F.contains(d, word), F.lit(0.15) * F.when(d.isin("src", "core", "api", "lib"), 1.2).otherwise(1.0) / (n - k)).otherwise(F.lit(0.0))


def stem_path_score(words: list[str], path: Column) -> Column:
    """Per word: 0.5 where it equals the file's stem; 0.3 by likeness where the stem contains it; else, for each directory
    that contains it, 0.15 (a fifth more for important ones) over its distance from the file; and 0.2 for a stem at most two edits away. 1 at most."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    stem_ = F.regexp_replace(name, r"\.[^.]*$", "")
    dirs = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda d: d != "")
    n = F.size(dirs)
    total = F.lit(0.0)
    for w in words:
        lit = F.lit(w)
        by_dir = F.aggregate(F.transform(dirs, weigh(lit, n)), F.lit(0.0), lambda a, b: a + b)
        near = F.when(F.levenshtein(stem_, lit).between(0, 2), 0.2).otherwise(0.0)
        total = total + F.when(stem_ == lit, 0.5).when(F.contains(stem_, lit), F.lit(0.3) * similarity_ratio(lit, stem_)).otherwise(by_dir + near)
    return F.least(total, F.lit(1.0))
