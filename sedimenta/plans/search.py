"""Search, vector and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import search as s
from sedimenta.sources import adapters as a

from . import indexes
from .registry import query

WORDS = ["the", "que", "der"]
_W = "('the', 'que', 'der')"
D2 = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
COS = """(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))))"""
Q = "q AS (SELECT embedding FROM embeddings WHERE vec_id = 0)"


def query_vector(spark, d) -> list[float]:
    """The vector that the searches ask for: the one of vec_id 0."""
    return [float(x) for x in a.table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def _hybrid(spark, d, k=10, min_score=0.0):
    vectors = a.table(spark, d, "embeddings")
    v = s.vector_topk(vectors, query_vector(spark, d), 2 * k)
    v = s.ranked(v, "distance", "vec_id").select(F.col("vec_id").alias("id"), "rank", "score")
    w = s.ranked(indexes.project_index(spark, d).keyword_topk(WORDS, 2 * k), F.desc("n_words"), F.desc("n_hits"), "file_id").select(F.col("file_id").alias("id"), "rank")
    return s.fuse(v, w, min_score=min_score, k=k).select("id", F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"), "match_type")


def _hybrid_sql(k=10, min_score=0.0, vwhere="TRUE", twhere="TRUE"):
    return f"""WITH {a.TOKENS}, {Q},
v AS (SELECT vec_id AS id, {D2} AS d FROM embeddings e, q WHERE {vwhere} ORDER BY d, id LIMIT {2 * k}),
vr AS (SELECT id, 1 / (1 + d) AS vs, row_number() OVER (ORDER BY d, id) AS r FROM v),
w AS (SELECT file_id AS id, count(DISTINCT term) AS nw, count(*) AS nh FROM tokens WHERE term IN {_W} AND {twhere} GROUP BY file_id ORDER BY nw DESC, nh DESC, id LIMIT {2 * k}),
wr AS (SELECT id, row_number() OVER (ORDER BY nw DESC, nh DESC, id) AS r FROM w),
u AS (SELECT id, 1.0::DOUBLE / (60 + r) AS p, vs, 1 AS s, 0 AS k FROM vr UNION ALL SELECT id, 1.0::DOUBLE / (60 + r), NULL, 0, 1 FROM wr),
f AS (SELECT id, sum(p) AS rrf, max(vs) AS vs, max(s) AS s, max(k) AS k FROM u GROUP BY id),
n AS (SELECT *, rrf / max(rrf) OVER () AS score FROM f)
SELECT id, round(rrf, 6) AS rrf, round(score, 6) AS score, round(vs, 6) AS vector_score, CASE WHEN s = 1 AND k = 1 THEN 'hybrid' WHEN s = 1 THEN 'semantic' ELSE 'keyword' END AS match_type
FROM n WHERE score >= {min_score} ORDER BY n.score DESC, id LIMIT {k}"""


@query(_hybrid_sql())
def hybrid_search(spark, d):
    return _hybrid(spark, d)


@query(_hybrid_sql(min_score=0.5))
def hybrid_search_min_score(spark, d):
    return _hybrid(spark, d, min_score=0.5)


@query(_hybrid_sql(vwhere="e.label = 3", twhere="file_id IN (SELECT id FROM files WHERE path LIKE '/corpus/src1%')"))
def hybrid_search_path_filter(spark, d):
    v = s.vector_topk(a.table(spark, d, "embeddings"), query_vector(spark, d), 20, where=F.col("label") == 3)
    v = s.ranked(v, "distance", "vec_id").select(F.col("vec_id").alias("id"), "rank", "score")
    found = indexes.project_index(spark, d).keyword_topk(WORDS, 20, F.col("path").startswith("/corpus/src1"))
    w = s.ranked(found, F.desc("n_words"), F.desc("n_hits"), "file_id").select(F.col("file_id").alias("id"), "rank")
    return s.fuse(v, w).select("id", F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"), F.round("vector_score", 6).alias("vector_score"), "match_type")


@query(f"WITH {Q} SELECT vec_id, round({D2}, 6) AS distance, round(1 / (1 + {D2}), 6) AS score FROM embeddings e, q ORDER BY {D2}, vec_id LIMIT 20")
def vector_topk_l2(spark, d):
    return s.vector_topk(a.table(spark, d, "embeddings"), query_vector(spark, d), 20).select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"WITH {Q} SELECT vec_id, round(1 - {COS}, 6) AS distance FROM embeddings e, q ORDER BY round(1 - {COS}, 9), vec_id LIMIT 20")
def vector_topk_cosine(spark, d):
    q = s.literal_vector(query_vector(spark, d))
    e = a.table(spark, d, "embeddings").withColumn("d", F.round(1 - s.cosine(F.col("embedding"), q), 9))
    return e.orderBy("d", "vec_id").limit(20).select("vec_id", F.round("d", 6).alias("distance"))


@query(f"WITH {Q} SELECT vec_id, label, round({D2}, 6) AS distance FROM embeddings e, q WHERE label IN (1, 2) ORDER BY {D2}, vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    return s.vector_topk(a.table(spark, d, "embeddings"), query_vector(spark, d), 10, where=F.col("label").isin(1, 2)).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {Q} SELECT label, count(*) AS n, round(max(1 / (1 + {D2})), 6) AS best, round(avg({D2}), 4) AS mean_distance FROM embeddings e, q GROUP BY label")
def vector_score_by_label(spark, d):
    q = s.literal_vector(query_vector(spark, d))
    e = a.table(spark, d, "embeddings").withColumn("dd", s.squared_l2(F.col("embedding"), q))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max(1 / (1 + F.col("dd"))), 6).alias("best"), F.round(F.avg("dd"), 4).alias("mean_distance"))


@query()
def ivf_probe(spark, d):
    vectors = a.table(spark, d, "embeddings")
    return s.ivf_topk(vectors, vectors.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {a.TOKENS} SELECT file_id, count(DISTINCT term) AS n_words, count(*) AS n_hits FROM tokens WHERE term IN {_W} GROUP BY file_id ORDER BY n_words DESC, n_hits DESC, file_id LIMIT 20")
def keyword_or_search(spark, d):
    """From the stored postings of the words."""
    return indexes.project_index(spark, d).keyword_topk(WORDS, 20)


@query(f"WITH {a.TOKENS} SELECT a.file_id, a.line, a.pos FROM tokens a JOIN tokens b ON a.file_id = b.file_id AND a.line = b.line AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def keyword_phrase_search(spark, d):
    """From the stored postings of the words."""
    return indexes.project_index(spark, d).phrase(["of", "the"])


@query(f"WITH {a.SYMBOLS} SELECT id, file_id, name FROM symbols WHERE contains(name, 'tion') ORDER BY file_id, id LIMIT 200")
def symbol_substring_search(spark, d):
    return a.symbols(a.lines(a.files(spark, d))).where(F.contains("name", F.lit("tion"))).select("id", "file_id", "name").orderBy("file_id", "id").limit(200)


@query(f"WITH {a.TOKENS} SELECT term, count(*) AS n, count(DISTINCT file_id) AS df FROM tokens GROUP BY term")
def term_document_frequency(spark, d):
    per = a.tokens(a.lines(a.files(spark, d))).groupBy("term", "file_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


@query(f"""WITH {a.FILES}, {Q},
v AS (SELECT vec_id AS id, 1 / (1 + {D2}) AS score FROM embeddings e, q ORDER BY {D2}, vec_id LIMIT 30),
k AS (SELECT id, 0.1 * ((CASE WHEN coalesce(contains(lower(b.text), 'tion'), false) OR contains(path, 'tion') THEN 1 ELSE 0 END) + (CASE WHEN coalesce(contains(lower(b.text), 'src1'), false) OR contains(path, 'src1') THEN 1 ELSE 0 END)) AS bonus FROM files LEFT JOIN benchmark b ON b.item_id = files.id),
j AS (SELECT coalesce(v.id, k.id) AS id, coalesce(score, 0) + coalesce(bonus, 0) AS score FROM v FULL OUTER JOIN (SELECT * FROM k WHERE bonus > 0) k ON v.id = k.id)
SELECT id, round(score, 6) AS score FROM j ORDER BY round(j.score, 9) DESC, id LIMIT 10""")
def search_by_purpose(spark, d):
    v = s.vector_topk(a.table(spark, d, "embeddings"), query_vector(spark, d), 30).select(F.col("vec_id").alias("id"), "score")
    told = a.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("summary"))
    f = a.files(spark, d).select("id", "path").join(told, "id", "left")
    hits = sum(F.when(F.coalesce(F.contains("summary", F.lit(w)), F.lit(False)) | F.contains("path", F.lit(w)), 1).otherwise(0) for w in ("tion", "src1"))
    k = f.select("id", (hits * 0.1).alias("bonus")).where("bonus > 0")
    j = v.join(k, "id", "full_outer").select("id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0)), 9).alias("score"))
    return j.orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 6).alias("score"))


_PATH = """least(CASE WHEN contains(lower(string_split(path, '/')[-1]), 'src1') THEN 0.3 WHEN contains(lower(path), 'src1') THEN 0.1 ELSE 0.0 END
  + CASE WHEN contains(lower(string_split(path, '/')[-1]), '12') THEN 0.3 WHEN contains(lower(path), '12') THEN 0.1 ELSE 0.0 END, 1.0)"""
_AGE = "((1700000000 - last_modified) // 86400)"
_REC = f"CASE WHEN {_AGE} <= 1 THEN 1.15 WHEN {_AGE} <= 7 THEN 1.05 WHEN {_AGE} <= 30 THEN 1.0 WHEN {_AGE} <= 90 THEN 0.95 ELSE 0.90 END"
_SIZE = "CASE WHEN size_bytes // 1024 <= 50 THEN 1.0 WHEN size_bytes // 1024 <= 200 THEN 0.98 WHEN size_bytes // 1024 <= 500 THEN 0.95 WHEN size_bytes // 1024 <= 1000 THEN 0.90 ELSE 0.85 END"
_TOLD = "lower(coalesce((SELECT b.text FROM benchmark b WHERE b.item_id = files.id), content))"
_SUMM = f"((CASE WHEN contains({_TOLD}, 'tion') THEN 1 ELSE 0 END) + (CASE WHEN contains({_TOLD}, 'the') THEN 1 ELSE 0 END)) / 2.0"


def _signals(f):
    """Signals of files that may have a stored summary (column summary); the others' whole text stands for it."""
    told = F.coalesce("summary", "content") if "summary" in f.columns else F.col("content")
    age = F.floor((F.lit(a.NOW) - F.col("last_modified")) / 86400)
    return f.withColumns({
        "path_s": s.path_score(["src1", "12"], F.col("path")),
        "summary_s": s.keyword_share(["tion", "the"], F.lower(told)),
        "recency": s.recency_boost(age),
        "size_p": s.size_penalty(F.col("size_bytes")),
    })


def _summed(spark, d):
    """Files with their stored summaries."""
    return a.files(spark, d).join(a.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("summary")), "id", "left")


#: What is asked for: words of the query, then each table of a file's signals.
ASKED = ("where", "src1", "tion", "12")


def _path_v2(word):
    """SQL of one word's part of the path score."""
    return f"""CASE WHEN stem = '{word}' THEN 0.5 WHEN contains(stem, '{word}') THEN 0.3 * len(list_filter(string_split('{word}', ''), lambda c: contains(stem, c))) / greatest(strlen('{word}'), strlen(stem))
    ELSE coalesce(list_sum(list_transform(dirs, lambda x, i: CASE WHEN contains(x, '{word}') THEN 0.15 * (CASE WHEN x IN ('src', 'core', 'api', 'lib') THEN 1.2 ELSE 1.0 END) / (len(dirs) - i + 1) ELSE 0 END)), 0) + CASE WHEN levenshtein(stem, '{word}') <= 2 THEN 0.2 ELSE 0 END END"""


_PATH_V2 = "least(" + " + ".join(_path_v2(w) for w in ASKED) + ", 1.0)"
_STEMS = "(SELECT *, regexp_replace(string_split(lower(path), '/')[-1], '\\.[^.]*$', '') AS stem, list_filter(string_split(lower(path), '/')[:-2], lambda x: x <> '') AS dirs FROM files)"


@query(f"WITH {a.FILES} SELECT id, round(CAST({_PATH_V2} AS DOUBLE), 6) AS score FROM {_STEMS}")
def stem_path_score(spark, d):
    return a.files(spark, d).select("id", F.round(s.stem_path_score(list(ASKED), F.col("path")), 6).alias("score"))


def _selected(spark, d):
    """The files nearest to the query vector with every signal: stored summaries (benchmark), and symbols, paths, age and size from the scoring index; no text is read."""
    near = s.vector_topk(a.table(spark, d, "embeddings"), query_vector(spark, d), 60).select(F.col("vec_id").alias("id"), F.col("score").alias("vector_s"))
    kept = indexes.project_index(spark, d).live("signals").select(F.col("file_id").alias("id"), "path", "size_bytes", "last_modified", "names")
    f = kept.join(F.broadcast(near), "id")  # 60 rows
    age = F.floor((F.lit(a.NOW) - F.col("last_modified")) / 86400)
    f = f.withColumns({"recency": s.recency_boost(age), "size_p": s.size_penalty(F.col("size_bytes")), "hits": F.size(F.filter("names", lambda n: F.contains(n, F.lit("tion")) | F.contains(n, F.lit("12"))))})
    told = a.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("summary"))
    rows = f.join(told, "id", "left")
    rows = rows.withColumns({
        "path_v2": s.stem_path_score(list(ASKED), F.col("path")), "symbol_s": F.coalesce(F.least(F.col("hits") / 2.0, F.lit(1.0)), F.lit(0.0)),
        "summary_v2": F.coalesce(s.keyword_share(list(ASKED), F.col("summary")), F.lit(0.0)), "w": s.adaptive_weights(F.lit(" ".join(ASKED))),
    })
    base, final = s.relevance(F.col("vector_s"), F.col("path_v2"), F.col("symbol_s"), F.col("summary_v2"), F.col("w"), F.col("recency"), F.col("size_p"))
    return rows.withColumns({"base": base, "final": final, "sure": s.confidence(F.col("vector_s"), F.col("path_v2"), F.col("symbol_s"))})


_NAMED = "'contains relevant symbols (' || array_to_string(names[1:3], ', ') || ')'"
_SELECTED = f"""{a.SYMBOLS}, {Q},
v AS (SELECT vec_id AS id, 1 / (1 + {D2}) AS vs FROM embeddings e, q ORDER BY {D2}, vec_id LIMIT 60),
y AS (SELECT file_id AS id, least(count(*) FILTER (WHERE contains(name, 'tion') OR contains(name, '12')) / 2.0, 1.0) AS ys, list(name ORDER BY line_start) AS names FROM symbols GROUP BY 1),
j AS (SELECT f.id, vs, CAST({_PATH_V2} AS DOUBLE) AS ps, CAST(coalesce(ys, 0) AS DOUBLE) AS ys, coalesce(names, []) AS names, {_REC} AS rec, {_SIZE} AS siz,
  CAST(coalesce((SELECT len(list_filter(['where', 'src1', 'tion', '12'], lambda w: contains(lower(b.text), w))) / 4.0 FROM benchmark b WHERE b.item_id = f.id), 0) AS DOUBLE) AS ss FROM v JOIN {_STEMS} f ON f.id = v.id LEFT JOIN y ON y.id = f.id),
b AS (SELECT *, vs * 0.25 + ps * 0.15 + ys * 0.50 + ss * 0.10 AS base, (vs + ps + ys) / 3 AS mu FROM j),
t AS (SELECT *, least(greatest(base * rec * siz, 0), 1) AS final, greatest(0, least(1, 1 - sqrt(((vs - mu) ** 2 + (ps - mu) ** 2 + (ys - mu) ** 2) / 3))) AS sure FROM b)"""


@query(f"""WITH {_SELECTED}, r AS (SELECT id, final, concat_ws(', ', CASE WHEN base * 0.25 > 0.28 THEN 'high semantic similarity' WHEN base * 0.25 > 0.20 THEN 'good semantic match' END, CASE WHEN base * 0.15 > 0.12 THEN 'path matches query' END,
  CASE WHEN base * 0.50 > 0.15 AND len(names) > 0 THEN {_NAMED} END, CASE WHEN base * 0.10 > 0.10 THEN 'summary matches query' END, CASE WHEN rec > 1 THEN 'recently modified' END, CASE WHEN sure > 0.8 THEN 'high confidence' END) AS why FROM t)
SELECT id, round(final, 6) AS score, CASE WHEN why = '' THEN 'found in search results' ELSE why END AS reason FROM r WHERE final >= 0.3 ORDER BY round(final, 9) DESC, id LIMIT 20""")
def smart_file_selection(spark, d):
    out = _selected(spark, d).where("final >= 0.3")
    why = s.reason(F.col("base"), F.col("w"), F.col("names"), F.col("recency"), F.col("sure"))
    return out.orderBy(F.desc(F.round("final", 9)), "id").limit(20).select("id", F.round("final", 6).alias("score"), why.alias("reason"))


@query(f"""WITH {_SELECTED}, r AS (SELECT id, concat_ws(', ', CASE WHEN vs > 0.7 THEN 'high semantic similarity' WHEN vs > 0.5 THEN 'good semantic match' END, CASE WHEN ps > 0.3 THEN 'path matches query keywords' END,
  CASE WHEN ys > 0.5 AND len(names) > 0 THEN {_NAMED} END, CASE WHEN ss > 0.5 THEN 'summary matches query' END) AS why FROM t) SELECT id, CASE WHEN why = '' THEN 'found in search results' ELSE why END AS reason FROM r""")
def selection_reason_plain(spark, d):
    return _selected(spark, d).select("id", s.plain_reason(F.col("vector_s"), F.col("path_v2"), F.col("symbol_s"), F.col("summary_v2"), F.col("names")).alias("reason"))


@query(f"WITH {a.FILES} SELECT id, round(CAST({_PATH} AS DOUBLE), 6) AS score FROM files")
def path_score(spark, d):
    return _signals(a.files(spark, d)).select("id", F.round(F.col("path_s").cast("double"), 6).alias("score"))


@query(f"WITH {a.FILES} SELECT id, {_AGE} AS age_days, round(CAST({_REC} AS DOUBLE), 6) AS boost, round(CAST({_SIZE} AS DOUBLE), 6) AS penalty FROM files")
def recency_and_size(spark, d):
    f = _signals(a.files(spark, d))
    return f.select("id", F.floor((F.lit(a.NOW) - F.col("last_modified")) / 86400).alias("age_days"), F.round(F.col("recency").cast("double"), 6).alias("boost"), F.round(F.col("size_p").cast("double"), 6).alias("penalty"))


@query(f"WITH {a.FILES} SELECT id, round({_SUMM}, 6) AS score FROM files")
def summary_score(spark, d):
    return _signals(_summed(spark, d)).select("id", F.round("summary_s", 6).alias("score"))


@query(f"""WITH {a.SYMBOLS}, per AS (SELECT file_id, count(*) FILTER (WHERE contains(name, 'tion') OR contains(name, 'er')) AS hits FROM symbols GROUP BY file_id)
SELECT file_id, round(least(hits / 2.0, 1.0), 6) AS score FROM per""")
def symbol_score(spark, d):
    hit = F.contains("name", F.lit("tion")) | F.contains("name", F.lit("er"))
    return a.symbols(a.lines(a.files(spark, d))).groupBy("file_id").agg(F.round(F.least(F.count_if(hit) / 2.0, F.lit(1.0)), 6).alias("score"))


@query("""SELECT p_partkey,
  CASE WHEN regexp_matches(lower(p_name), 'where|defined|find') THEN 0.5 WHEN regexp_matches(lower(p_name), 'how|explain|what') THEN 0.15 WHEN regexp_matches(lower(p_name), '/|\\.rs|\\.ts|\\.js') THEN 0.2 ELSE 0.25 END::DOUBLE AS symbols,
  CASE WHEN regexp_matches(lower(p_name), 'where|defined|find') THEN 0.25 WHEN regexp_matches(lower(p_name), 'how|explain|what') THEN 0.35 WHEN regexp_matches(lower(p_name), '/|\\.rs|\\.ts|\\.js') THEN 0.3 ELSE 0.4 END::DOUBLE AS vector FROM part""")
def adaptive_weights(spark, d):
    w = s.adaptive_weights(F.col("p_name"))
    return a.table(spark, d, "part").select("p_partkey", w["symbols"].cast("double").alias("symbols"), w["vector"].cast("double").alias("vector"))


@query("SELECT DISTINCT p_name, levenshtein(p_name, 'small ring') AS distance FROM part WHERE levenshtein(p_name, 'small ring') <= 6")
def edit_distance_fuzzy(spark, d):
    dist = F.levenshtein("p_name", F.lit("small ring"))
    return a.table(spark, d, "part").select("p_name").distinct().withColumn("distance", dist.cast("long")).where("distance <= 6")


@query("""SELECT p_partkey, round(CASE WHEN greatest(strlen(p_name), 6) = 0 THEN 1.0 ELSE len(list_filter(string_split(p_name, ''), lambda c: contains('widget', c))) / greatest(strlen(p_name), 6) END, 6) AS ratio FROM part""")
def similarity_ratio(spark, d):
    return a.table(spark, d, "part").select("p_partkey", F.round(s.similarity_ratio(F.col("p_name"), F.lit("widget")), 6).alias("ratio"))


@query(f"""WITH {a.TOKENS} SELECT term, CASE WHEN term LIKE '%ing' AND length(term) > 5 THEN left(term, length(term) - 3) WHEN term LIKE '%ed' AND length(term) > 4 THEN left(term, length(term) - 2)
  WHEN term LIKE '%s' AND length(term) > 3 THEN left(term, length(term) - 1) ELSE term END AS stem FROM (SELECT DISTINCT term FROM tokens)""")
def keyword_stem(spark, d):
    return a.tokens(a.lines(a.files(spark, d))).select("term").distinct().withColumn("stem", s.stem(F.col("term")))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_discount + l_tax + l_quantity / 50) / 3 AS mu, l_discount AS x, l_tax AS y, l_quantity / 50 AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1, 1 - sqrt(((x - mu) * (x - mu) + (y - mu) * (y - mu) + (z - mu) * (z - mu)) / 3))), 6) AS confidence FROM m""")
def confidence(spark, d):
    c = s.confidence(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50)
    return a.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(c, 6).alias("confidence"))


@query(f"WITH {a.FILES}, p AS (SELECT id, string_split(content, chr(10)) AS ls FROM files) SELECT id, array_to_string(ls[1:3], chr(10)) || CASE WHEN len(ls) > 3 THEN '...' ELSE '' END AS preview FROM p")
def search_preview(spark, d):
    return a.files(spark, d).select("id", s.preview(F.col("content")).alias("preview"))


_HIT = """p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS symbol, ['function', 'struct', 'enum', 'trait', 'field'][1 + p_size % 5] AS kind,
  CASE p_size % 6 WHEN 0 THEN '/// about ' || p_name WHEN 1 THEN 'use shop;' || chr(10) || p_name WHEN 2 THEN 'struct ' || p_type WHEN 3 THEN p_brand || ' ring' WHEN 4 THEN '/** ' || repeat('x', 200) || ' ring' ELSE 'type T = ' || p_name END AS content"""


@query(f"""WITH h AS (SELECT {_HIT} FROM part) SELECT p_partkey, CASE WHEN coalesce(contains(symbol, 'ring'), false) THEN CASE kind WHEN 'function' THEN 'FunctionName' WHEN 'struct' THEN 'ClassName' WHEN 'field' THEN 'SymbolName' ELSE 'TypeDefinition' END
  WHEN content LIKE '///%' AND contains(content, 'ring') THEN 'DocComment' WHEN contains(content, 'use ') AND contains(content, 'ring') THEN 'ImportStatement' WHEN (contains(content, 'struct ') OR contains(content, 'type ')) AND contains(lower(content), 'ring') THEN 'TypeDefinition' ELSE 'CodeContent' END AS reason FROM h""")
def match_reason(spark, d):
    """Hits of a query for "Ring" among made texts: comments, imports, declarations and others, with a symbol or none."""
    n, k = F.col("p_name"), F.col("p_size") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("/// about "), n)).when(k == 1, F.concat(F.lit("use shop;\n"), n)).when(k == 2, F.concat(F.lit("struct "), "p_type")).when(k == 3, F.concat("p_brand", F.lit(" ring")))
        .when(k == 4, F.lit("/** " + "x" * 200 + " ring")).otherwise(F.concat(F.lit("type T = "), n))
    )
    kind = F.get(F.array(*map(F.lit, ("function", "struct", "enum", "trait", "field"))), (F.col("p_size") % 5).cast("int"))
    symbol = F.when(F.col("p_size") % 5 != 0, n)
    return a.table(spark, d, "part").select("p_partkey", s.match_reason(text, symbol, kind, "Ring").alias("reason"))


@query(f"""WITH {a.FILES}, s AS (SELECT id, path, 0.40 * (1.0 / (1 + id)) + 0.20 * {_PATH} + 0.15 * {_SUMM} + 0.10 * ({_REC}) + 0.10 * ({_SIZE}) + 0.05 * CASE WHEN domain IS NULL THEN 0 ELSE 1 END AS score FROM files)
SELECT id, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, id LIMIT 50""")
def multi_factor_ranking(spark, d):
    f = _signals(_summed(spark, d))
    score = 0.40 * (1.0 / (1 + F.col("id"))) + 0.20 * F.col("path_s") + 0.15 * F.col("summary_s") + 0.10 * F.col("recency").cast("double") + 0.10 * F.col("size_p").cast("double") + 0.05 * F.when(F.col("domain").isNull(), 0).otherwise(1)
    return f.select("id", F.round(score, 9).alias("s")).orderBy(F.desc("s"), "id").limit(50).select("id", F.round("s", 6).alias("score"))
