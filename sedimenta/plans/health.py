"""Index health, statistics, usage and change analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import scalars as sc
from sedimenta.sources import adapters as a

from .registry import query


@query(f"WITH {a.ERRORS} SELECT file_path, line, severity, code, message FROM errors WHERE severity = 'error' ORDER BY file_path, line, message LIMIT 50 OFFSET 10")
def errors_page(spark, d):
    return a.errors(spark, d).where("severity = 'error'").orderBy("file_path", "line", "message").offset(10).limit(50).select("file_path", "line", "severity", "code", "message")


@query(f"WITH {a.ERRORS} SELECT file_path, string_agg(line || ' [' || severity || '] ' || code || ': ' || message, '; ' ORDER BY line, message) AS report, count(*) AS n FROM errors GROUP BY file_path")
def errors_by_file(spark, d):
    x = F.sort_array(F.collect_list(F.struct("line", "message", "severity", "code")))
    text = F.transform(x, lambda v: F.concat(v["line"].cast("string"), F.lit(" ["), v["severity"], F.lit("] "), v["code"], F.lit(": "), v["message"]))
    return a.errors(spark, d).groupBy("file_path").agg(F.array_join(text, "; ").alias("report"), F.count("*").alias("n"))


@query(f"WITH {a.ERRORS} SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM errors")
def count_errors(spark, d):
    return a.errors(spark, d).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


@query(f"WITH {a.ERRORS} SELECT severity, count(*) AS n FROM errors GROUP BY severity")
def severity_breakdown(spark, d):
    return a.errors(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


_ISSUES = f"""{a.SYMBOLS}, issues AS (
  SELECT 'files without symbols' AS category, 'warning' AS severity, count(*) AS n FROM files WHERE id NOT IN (SELECT file_id FROM symbols)
  UNION ALL SELECT 'orphaned symbols', 'critical', count(*) FROM symbols WHERE file_id NOT IN (SELECT id FROM files)
  UNION ALL SELECT 'bad ranges', 'critical', count(*) FROM symbols WHERE line_end < line_start
  UNION ALL SELECT 'duplicate content', 'info', coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM files GROUP BY content_hash)
  UNION ALL SELECT 'empty files', 'info', count(*) FROM files WHERE size_bytes = 0
  UNION ALL SELECT 'no domain', 'info', count(*) FROM files WHERE domain IS NULL
  UNION ALL SELECT 'stale files', 'warning', count(*) FROM files WHERE (1700000000 - last_modified) // 86400 > 30)"""


@query(f"WITH {_ISSUES} SELECT category, severity, CAST(n AS BIGINT) AS n FROM issues")
def validate_index(spark, d):
    f = a.files(spark, d)
    s = a.symbols(a.lines(f))
    ids, owners = f.select("id"), s.select(F.col("file_id").alias("id")).distinct()
    age = F.floor((F.lit(a.NOW) - F.col("last_modified")) / 86400)
    # what one pass over the files tells
    sums = f.agg(F.count_if(F.col("size_bytes") == 0).alias("empty files"), F.count_if(F.col("domain").isNull()).alias("no domain"), F.count_if(age > 30).alias("stale files"))
    kinds = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(w).alias("severity"), F.col(c).alias("n")) for c, w in (("empty files", "info"), ("no domain", "info"), ("stale files", "warning"))])
    parts = [
        ("files without symbols", "warning", ids.join(owners, "id", "left_anti").agg(F.count("*").alias("n"))),
        ("orphaned symbols", "critical", s.join(ids.withColumnRenamed("id", "file_id"), "file_id", "left_anti").agg(F.count("*").alias("n"))),
        ("bad ranges", "critical", s.agg(F.count_if(F.col("line_end") < F.col("line_start")).alias("n"))),
        ("duplicate content", "info", f.groupBy("content_hash").agg((F.count("*") - 1).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))),
    ]
    out = sums.select(F.explode(kinds).alias("k")).select("k.*")
    for category, severity, df in parts:
        row = df.select(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""WITH {a.FILES}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE domain IS NOT NULL) AS done, count(DISTINCT language) AS languages, max(last_modified) AS newest FROM files)
SELECT total, done, round(100.0 * done / total, 4) AS completeness, CASE WHEN 100.0 * done / total >= 95 THEN 'healthy' WHEN 100.0 * done / total >= 80 THEN 'degraded' ELSE 'poor' END AS health, languages, (1700000000 - newest) // 60 AS age_minutes FROM s""")
def index_status(spark, d):
    f = a.files(spark, d)
    s = f.agg(F.count("*").alias("total"), F.count_if(F.col("domain").isNotNull()).alias("done"), F.count_distinct("language").alias("languages"), F.max("last_modified").alias("newest"))
    pct = F.col("done") * 100.0 / F.col("total")
    health = F.when(pct >= 95, "healthy").when(pct >= 80, "degraded").otherwise("poor")
    return s.select("total", "done", F.round(pct, 4).alias("completeness"), health.alias("health"), "languages", F.floor((F.lit(a.NOW) - F.col("newest")) / 60).alias("age_minutes"))


@query(f"WITH {a.FILES} SELECT id, (1700000000 - last_modified) // 86400 AS age_days FROM files WHERE (1700000000 - last_modified) // 86400 > 10")
def stale_files(spark, d):
    age = F.floor((F.lit(a.NOW) - F.col("last_modified")) / 86400)
    return a.files(spark, d).select("id", age.alias("age_days")).where("age_days > 10")


@query(f"WITH {a.QUEUE} SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'completed') AS completed FROM queue")
def queue_stats(spark, d):
    return a.queue(spark, d).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed")])


@query(f"WITH {a.AUDIT} SELECT tool_name, count(*) AS calls, count(*) FILTER (WHERE latency_ms > 100) AS slow, round(sum(latency_ms), 4) AS total_ms, round(avg(latency_ms), 6) AS avg_ms, round(count(*) FILTER (WHERE latency_ms > 100) / count(*), 6) AS slow_rate FROM audit GROUP BY tool_name")
def query_stats(spark, d):
    slow = F.count_if(F.col("latency_ms") > 100)
    return a.audit(spark, d).groupBy("tool_name").agg(F.count("*").alias("calls"), slow.alias("slow"), F.round(F.sum("latency_ms"), 4).alias("total_ms"), F.round(F.avg("latency_ms"), 6).alias("avg_ms"), F.round(slow / F.count("*"), 6).alias("slow_rate"))


@query(f"WITH {a.AUDIT} SELECT tool_name, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, round(max(latency_ms), 6) AS worst, round(quantile_cont(latency_ms, 0.5), 6) AS median FROM audit GROUP BY 1, 2")
def tool_latency(spark, d):
    day = F.date_format("created_at", "yyyy-MM-dd")
    return a.audit(spark, d).groupBy("tool_name", day.alias("day")).agg(F.count("*").alias("n"), F.round(F.max("latency_ms"), 6).alias("worst"), F.round(F.percentile("latency_ms", 0.5), 6).alias("median"))


@query("SELECT count(*) AS entries, count(*) * 1600 AS bytes, round(count(*) FILTER (WHERE label IN (1, 2)) / count(*), 6) AS hit_rate FROM embeddings")
def cache_stats(spark, d):
    e = a.table(spark, d, "embeddings")
    return e.agg(F.count("*").alias("entries"), (F.count("*") * 1600).alias("bytes"), F.round(F.count_if(F.col("label").isin(1, 2)) / F.count("*"), 6).alias("hit_rate"))


@query(f"WITH {a.FILES} SELECT domain, language, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(grouping(domain, language) AS INTEGER) AS level FROM files GROUP BY ROLLUP (domain, language)")
def stats_rollup(spark, d):
    return a.files(spark, d).rollup("domain", "language").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.grouping_id().cast("int").alias("level"))


@query("SELECT c_mktsegment, n_regionkey, count(*) AS n, CAST(grouping(c_mktsegment, n_regionkey) AS INTEGER) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_regionkey)")
def stats_cube(spark, d):
    c = a.table(spark, d, "customer").join(a.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    return c.cube("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query("SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS ts FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey = 42) ON l_orderkey = o_orderkey ORDER BY ts DESC, commit_id LIMIT 20")
def file_history(spark, d):
    touched = a.table(spark, d, "lineitem").where("l_partkey = 42").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    o = a.table(spark, d, "orders").join(touched, "o_orderkey").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))
    return o.orderBy(F.desc("ts"), "commit_id").limit(20)


_PATHS = ("src/cart/mod.rs", "src/cart/test_sum.rs", "docs/guide.txt", "README.md", "Cargo.toml", ".github/workflows/ci.yml", "Dockerfile", "src/db/rows.go", "lib/spec_api.py", "ui/.gitlab-ci.yml")
_COMMITS = f"""c AS (SELECT l_orderkey AS commit_id, count(*) AS files, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS additions, CAST(sum(CAST(round(l_quantity * l_discount * 20) AS INTEGER)) AS BIGINT) AS deletions,
  list(CASE WHEN l_partkey % 60 < 10 THEN {list(_PATHS)!r}[CAST(1 + l_partkey % 60 AS INTEGER)] ELSE 'src/m' || l_suppkey || '/run.rs' END) AS paths, list(CASE l_returnflag WHEN 'A' THEN CASE WHEN l_partkey % 7 = 0 THEN 'added' ELSE 'modified' END WHEN 'R' THEN 'modified' ELSE 'deleted' END) AS statuses
  FROM lineitem GROUP BY 1)"""


def _commits(spark, d):
    """A commit per order, with a path and a status for each of its lines."""
    li = a.table(spark, d, "lineitem")
    k = (F.col("l_partkey") % 60).cast("int")
    path = F.when(k < 10, F.get(F.array(*map(F.lit, _PATHS)), k)).otherwise(F.concat(F.lit("src/m"), F.col("l_suppkey").cast("string"), F.lit("/run.rs")))
    status = F.when(F.col("l_returnflag") == "A", F.when(F.col("l_partkey") % 7 == 0, "added").otherwise("modified")).when(F.col("l_returnflag") == "R", "modified").otherwise("deleted")
    return li.groupBy(F.col("l_orderkey").alias("commit_id")).agg(
        F.count("*").alias("files"),
        F.sum(F.col("l_quantity").cast("int")).alias("additions"),
        F.sum(F.round(F.col("l_quantity") * F.col("l_discount") * 20).cast("int")).alias("deletions"),
        F.collect_list(path).alias("paths"),
        F.collect_list(status).alias("statuses"),
    )


_KIND = """CASE WHEN len(list_filter(paths, lambda p: contains(p, 'test') OR contains(p, 'spec'))) > 0 THEN 'test' WHEN len(list_filter(paths, lambda p: p LIKE '%.md' OR p LIKE 'docs/%')) > 0 THEN 'docs'
  WHEN len(list_filter(paths, lambda p: p LIKE '%.toml' OR p LIKE '%.json' OR p LIKE '.github/%')) > 0 THEN 'chore' WHEN len(list_filter(paths, lambda p: contains(p, '.github/workflows') OR contains(p, '.gitlab-ci') OR p = 'Dockerfile')) > 0 THEN 'ci'
  WHEN deletions > additions * 2 THEN 'refactor' WHEN list_contains(statuses, 'added') THEN 'feat' WHEN files <= 3 AND additions + deletions < 50 THEN 'fix' ELSE 'refactor' END"""


@query(f"""WITH {_COMMITS} SELECT commit_id, {_KIND} AS kind,
  CASE WHEN files > 10 OR additions + deletions > 500 THEN 'large' WHEN files > 3 OR additions + deletions > 100 THEN 'medium' ELSE 'simple' END AS complexity FROM c""")
def change_type(spark, d):
    c = _commits(spark, d)
    return c.select("commit_id", sc.change_type(F.col("paths"), F.col("statuses"), F.col("additions"), F.col("deletions")).alias("kind"), sc.complexity(F.col("files"), F.col("additions") + F.col("deletions")).alias("complexity"))


@query(f"""WITH {_COMMITS}, k AS (SELECT *, {_KIND} AS kind FROM c)
SELECT commit_id, CASE kind WHEN 'ci' THEN 'CI/CD pipeline updates'
  WHEN 'feat' THEN CASE WHEN list_contains(statuses, 'added') THEN 'New functionality added across ' || files || ' file(s)' ELSE 'Feature enhancement in ' || files || ' file(s)' END
  WHEN 'fix' THEN 'Bug fix in ' || files || ' file(s)' WHEN 'docs' THEN 'Documentation update for ' || files || ' file(s)' WHEN 'test' THEN 'Test updates in ' || files || ' file(s)' WHEN 'chore' THEN 'Build/config changes in ' || files || ' file(s)'
  ELSE CASE WHEN list_contains(statuses, 'deleted') THEN 'Code refactoring with cleanup (' || len(list_filter(statuses, lambda s: s = 'modified')) || ' files modified, ' || len(list_filter(statuses, lambda s: s = 'deleted')) || ' removed)' ELSE 'Code refactoring in ' || files || ' file(s)' END END AS summary FROM k""")
def change_summary(spark, d):
    c = _commits(spark, d).withColumn("kind", sc.change_type(F.col("paths"), F.col("statuses"), F.col("additions"), F.col("deletions")))
    return c.select("commit_id", sc.change_summary(F.col("kind"), F.col("statuses")).alias("summary"))


@query(f"WITH {_COMMITS} SELECT CAST(sum(files) AS BIGINT) AS files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, CAST(sum(additions) // count(*) AS BIGINT) AS mean_additions FROM c")
def commit_analysis(spark, d):
    c = _commits(spark, d)
    return c.agg(F.sum("files").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.floor(F.sum("additions") / F.count("*")).alias("mean_additions"))


@query(f"""WITH {_COMMITS} SELECT commit_id, concat_ws('; ', CASE WHEN additions + deletions > 300 THEN 'many lines' END, CASE WHEN files > 5 THEN 'many files' END, CASE WHEN deletions > additions THEN 'mostly deletions' END) AS warnings FROM c""")
def safety_checks(spark, d):
    w = F.concat_ws("; ", F.when(F.col("additions") + F.col("deletions") > 300, "many lines"), F.when(F.col("files") > 5, "many files"), F.when(F.col("deletions") > F.col("additions"), "mostly deletions"))
    return _commits(spark, d).select("commit_id", w.alias("warnings"))


@query("SELECT p_partkey, count(*) AS churn, count(DISTINCT l_orderkey) AS commits, count(DISTINCT o_custkey) AS authors FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY churn DESC, p_partkey LIMIT 50")
def hotspots(spark, d):
    o = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = a.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(o, "l_orderkey")
    li = li.join(a.table(spark, d, "part").select("p_partkey"), "p_partkey", "left_semi")
    return li.groupBy("p_partkey").agg(F.count("*").alias("churn"), F.count_distinct("l_orderkey").alias("commits"), F.count_distinct("o_custkey").alias("authors")).orderBy(F.desc("churn"), "p_partkey").limit(50)
