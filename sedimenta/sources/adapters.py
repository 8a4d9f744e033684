"""Index tables over the benchmark tables: projections only, with the same definition here and in SQL below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No query reads the clock.
NOW = 1_700_000_000
TERM_GAP = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"))


def as_files(d: DataFrame) -> DataFrame:
    n = F.substring("source", 4, 10).cast("int")
    domain = F.when(n == 19, None).when(n < 6, "backend").when(n < 12, "frontend").when(n < 16, "shared").otherwise("ops")
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("lang").alias("language"),
        domain.alias("domain"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.lit(NOW) - F.col("doc_id") * 3600).alias("last_modified"),
    )


def lines(files_: DataFrame) -> DataFrame:
    """(file_id, line, text), 1-based; a trailing newline makes no line."""
    parts = F.split("content", "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files_.select(F.col("id").alias("file_id"), F.posexplode(kept).alias("p", "text")).select("file_id", (F.col("p") + 1).alias("line"), "text")


def terms(text):
    return F.filter(F.split(F.lower(text), TERM_GAP), lambda t: t != "")


def tokens(lines_: DataFrame) -> DataFrame:
    """(file_id, line, pos, term), 1-based."""
    return lines_.select("file_id", "line", F.posexplode(terms(F.col("text"))).alias("p", "term")).select("file_id", "line", (F.col("p") + 1).alias("pos"), "term")


def symbols(lines_: DataFrame) -> DataFrame:
    """One symbol per line that has a term: its first."""
    first = terms(F.col("text"))
    n = F.length("name")
    return (
        lines_.withColumn("name", F.get(first, F.lit(0)))
        .where("name is not null")
        .select(
            (F.col("file_id") * (1 << 32) + F.col("line")).alias("id"),
            "file_id",
            "name",
            F.element_at(F.array(*map(F.lit, ("function", "struct", "enum", "class"))), n % 4 + 1).alias("kind"),
            F.col("line").alias("line_start"),
            (F.col("line") + n % 5).alias("line_end"),
            F.col("text").alias("signature"),
        )
    )


def refs(tokens_: DataFrame) -> DataFrame:
    """All further terms of a line refer to a name."""
    kind = F.element_at(F.array(*map(F.lit, ("call", "usage", "import"))), F.length("term") % 3 + 1)
    return tokens_.where("pos > 1").select("file_id", "line", "pos", F.col("term").alias("target_name"), kind.alias("kind"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("tool_name"), F.col("value").alias("latency_ms"), (F.col("event_type") != "error").alias("success"), F.col("ts").alias("created_at"), "user_id")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    severity = F.when(F.col("value") > 50, "error").when(F.col("value") > 10, "warning").otherwise("info")
    return e.select(
        F.concat(F.lit("/src/u"), F.col("user_id").cast("string"), F.lit(".rs")).alias("file_path"),
        F.get_json_object("props", "$.k").cast("int").alias("line"),
        severity.alias("severity"),
        F.concat(F.lit("E"), F.get_json_object("props", "$.k")).alias("code"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
        F.col("ts").alias("updated_at"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "processing").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("file_id"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


FILES = """files AS (
  SELECT doc_id AS id, '/corpus/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, text AS content, sha256(text) AS content_hash, lang AS language,
    CASE WHEN CAST(substr(source, 4) AS INTEGER) = 19 THEN NULL WHEN CAST(substr(source, 4) AS INTEGER) < 6 THEN 'backend' WHEN CAST(substr(source, 4) AS INTEGER) < 12 THEN 'frontend'
      WHEN CAST(substr(source, 4) AS INTEGER) < 16 THEN 'shared' ELSE 'ops' END AS domain,
    CAST(strlen(text) AS BIGINT) AS size_bytes, 1700000000 - doc_id * 3600 AS last_modified
  FROM documents)"""
LINES = (
    FILES
    + r""",
lines AS (
  SELECT file_id, CAST(line AS INTEGER) AS line, text FROM (
    SELECT id AS file_id, unnest(ls) AS text, generate_subscripts(ls, 1) AS line, len(ls) AS n FROM (SELECT id, string_split(content, chr(10)) AS ls FROM files))
  WHERE NOT (line = n AND text = ''))"""
)
TOKENS = (
    LINES
    + r""",
tokens AS (
  SELECT file_id, line, unnest(ts) AS term, CAST(generate_subscripts(ts, 1) AS INTEGER) AS pos FROM (
    SELECT file_id, line, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM lines))"""
)
SYMBOLS = (
    TOKENS
    + """,
symbols AS (
  SELECT t.file_id * 4294967296 + t.line AS id, t.file_id, t.term AS name, ['function', 'struct', 'enum', 'class'][1 + length(t.term) % 4] AS kind,
    t.line AS line_start, CAST(t.line + length(t.term) % 5 AS INTEGER) AS line_end, l.text AS signature
  FROM tokens t JOIN lines l ON t.file_id = l.file_id AND t.line = l.line WHERE t.pos = 1)"""
)
REFS = (
    SYMBOLS
    + """,
refs AS (
  SELECT file_id, line, pos, term AS target_name, ['call', 'usage', 'import'][1 + length(term) % 3] AS kind FROM tokens WHERE pos > 1)"""
)
AUDIT = "audit AS (SELECT event_id AS id, event_type AS tool_name, value AS latency_ms, event_type <> 'error' AS success, ts AS created_at, user_id FROM events)"
ERRORS = """errors AS (
  SELECT '/src/u' || user_id || '.rs' AS file_path, CAST(json_extract_string(props, '$.k') AS INTEGER) AS line,
    CASE WHEN value > 50 THEN 'error' WHEN value > 10 THEN 'warning' ELSE 'info' END AS severity, 'E' || json_extract_string(props, '$.k') AS code,
    'event ' || event_id AS message, ts AS updated_at
  FROM events WHERE event_type = 'error')"""
QUEUE = """queue AS (
  SELECT o_orderkey AS file_id, 6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE 'pending' END AS status, o_orderdate AS created_at
  FROM orders)"""
