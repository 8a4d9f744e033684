"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, lm, merkle, minhash, mixing, packing, phrases, pii, quality, token_files, toxicity, vectors
from .common import fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.linked(table(spark, sf_dir, "documents").select("doc_id", "text"), similarity="0.85")


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = token_files.export(docs, file="word_bpe_49k.json", end_id=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.threaded(table(spark, sf_dir, "conversations"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), file="byte_bpe_50k.json", end_id=1)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs, rules)
    return judged.select(
        "doc_id",
        F.col("q_n_words").alias("n_words"),
        F.col("q_word_chars").alias("word_chars"),
        F.col("q_n_symbols").alias("n_symbols"),
        F.col("q_n_dup_lines").alias("n_dup_lines"),
        F.col("q_n_repeat_words").alias("n_repeat_words"),
        F.col("q_base_failed").alias("base_failed"),
        F.col("q_kept").alias("kept"),
        F.col("q_rule").alias("rule"),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 2) AS cell
  FROM documents),
s AS (
  SELECT k, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (
  SELECT *, CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w,
         source_size * 3 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM s),
l AS (
  SELECT *, CAST(total - coalesce(CAST(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM w),
t AS (
  SELECT k, source_size, least(CAST(cap AS DOUBLE), max(level) OVER () * w) AS target,
         CAST(('0x' || substr(md5('mix:' || k), 1, 5)) AS BIGINT) / 1048576.0::DOUBLE AS off
  FROM l),
o AS (
  SELECT d.*, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.k ORDER BY length(CAST(size AS VARCHAR)) * 100 + CAST(substr(CAST(size AS VARCHAR), 1, 2) AS INTEGER), cell, size, doc_id) AS m
  FROM d JOIN t ON d.k = t.k)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate * m + off) - floor(rate * (m - 1) + off)) AS BIGINT) * size AS taken
FROM o
"""


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_bytes")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *[pii.count_of(spans, kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(spans).alias("spans"),
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    other = F.when(fold(F.col("doc_id")) == 0, merkle.tampered_leaf(docs))
    made = merkle.manifest(docs, merkle.FIELDS, extra={"other": other})
    root = F.lit(made.root)
    rows = made.leaves.withColumn("folded_root", merkle.folded(F.coalesce("other", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", root.alias("root"), merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), file="byte_bpe_50k.tiktoken", with_decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash": op2_minhash,
    "op3_vectors": op3_vectors,
    "op4_token_files": op4_token_files,
    "op5_chat": op5_chat,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_mix_sources": op8_mix_sources,
    "op9_lm_scores": op9_lm_scores,
    "op10_pii": op10_pii,
    "op11_merkle": op11_merkle,
    "op12_bpe": op12_bpe,
    "op13_phrases": op13_phrases,
}
# shingles by window of words; pairs that share a shingle; links by exact similarity; components by recursion
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id
"""

OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND norm > 0 AND isfinite(norm)),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.c AS component_id, c.id = c.c AS kept FROM c LEFT JOIN n ON n.a = c.id
"""

# leaves, nodes level by level, each leaf's siblings by the places of its parents, folding by reduction
OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k,
         list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS v,
         list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS o,
         xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
           lambda s, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(s, b)), 4294967295)) % 5 = 0 AS bad
  FROM documents),
l AS (
  SELECT doc_id, k, sha256(array_to_string(v, '')) AS leaf, CASE WHEN bad THEN sha256(array_to_string(o, '')) ELSE sha256(array_to_string(v, '')) END AS other FROM f),
p AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM l),
t AS (
  SELECT 0 AS lv, k, idx, leaf AS digest, n FROM p
  UNION ALL
  SELECT lv + 1, k, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY lv, k, idx // 16, n),
s AS (SELECT k, digest AS subroot, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lv, idx, subroot AS digest, n FROM s
  UNION ALL
  SELECT lv + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY lv, idx // 16, n),
w AS (
  SELECT p.k, p.idx AS place, t.lv, coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx < p.idx // (16 ** t.lv)::BIGINT), '') AS a,
         coalesce(string_agg(t.digest, '' ORDER BY t.idx) FILTER (t.idx > p.idx // (16 ** t.lv)::BIGINT), '') AS b
  FROM p JOIN t ON t.k = p.k AND t.n > 1 AND t.idx // 16 = p.idx // (16 ** (t.lv + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT p.k, p.idx, 100 + u.lv, coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx < s.idx // (16 ** u.lv)::BIGINT), ''),
         coalesce(string_agg(u.digest, '' ORDER BY u.idx) FILTER (u.idx > s.idx // (16 ** u.lv)::BIGINT), '')
  FROM p JOIN s ON s.k = p.k JOIN u ON u.n > 1 AND u.idx // 16 = s.idx // (16 ** (u.lv + 1))::BIGINT GROUP BY ALL),
x AS (SELECT k, place, list({'a': a, 'b': b} ORDER BY lv) AS steps, string_agg(a || b, '' ORDER BY lv) AS proof FROM w GROUP BY k, place),
r AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(coalesce(x.proof, '')) AS proof_sha256,
         list_reduce(coalesce(x.steps, []), lambda y, z: {'a': sha256(z.a || y.a || z.b), 'b': ''}, {'a': p.other, 'b': ''}).a AS folded_root
  FROM p JOIN s ON s.k = p.k LEFT JOIN x ON x.k = p.k AND x.place = p.idx)
SELECT *, folded_root = root AS verified FROM r
"""

# all n-grams of all pieces, counted; the weakest cut of each; what a longer one holds goes
OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
o AS (SELECT lang, ws, unnest([1, 2, 3, 4]) AS size FROM w),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM o WHERE len(ws) >= size),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT lang, phrase, a, size, ws, unnest(range(1, size)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * k.a) // (l.a + r.a) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, ws, a, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2)) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase
WHERE h.a IS NULL OR 100 * h.a < 80 * b.a
QUALIFY rank <= 2000
"""

ORACLES = {"op11_merkle": OP11_SQL, "op13_phrases": OP13_SQL, "op3_vectors": OP3_SQL, "op2_minhash": OP2_SQL, "op8_mix_sources": OP8_SQL}
