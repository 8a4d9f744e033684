"""Line search, reading, trees, extraction from markup and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import scalars as sc
from sedimenta.operators import links
from sedimenta.operators import text as t
from sedimenta.sources import adapters as a
from sedimenta.sources import corpus

from .registry import query

TRIM = "trim(text, ' ')"


@query(f"WITH {a.LINES} SELECT file_id, line, {TRIM} AS text FROM lines WHERE regexp_matches(text, '[a-z]+tion [a-z]+ing')")
def grep_lines(spark, d):
    return t.grep(a.lines(a.files(spark, d)), "[a-z]+tion [a-z]+ing")


@query(f"WITH {a.LINES} SELECT file_id, line, {TRIM} AS text FROM lines WHERE regexp_matches(text, '(?i)^THE [a-z]+') ORDER BY file_id, line LIMIT 100")
def grep_case_insensitive(spark, d):
    return t.grep(a.lines(a.files(spark, d)), "^THE [a-z]+", ignore_case=True, limit=100)


@query(f"""WITH {a.LINES}, c AS (SELECT *, array_to_string(list(text) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10)) AS context FROM lines)
SELECT file_id, line, text, context FROM c WHERE regexp_matches(text, 'License')""")
def search_files_context(spark, d):
    return t.grep_context(a.lines(a.files(spark, d)), "License", 1)


@query(f"""WITH {a.LINES} SELECT file_id, coalesce(string_agg(text, chr(10) ORDER BY line) FILTER (WHERE line BETWEEN 2 AND 4), '') AS content, count(*) AS total_lines FROM lines GROUP BY file_id""")
def read_line_range(spark, d):
    return t.read_range(a.lines(a.files(spark, d)), 2, 4)


@query(f"WITH {a.FILES} SELECT id, path FROM files WHERE regexp_matches(path, '^/corpus/src.*/de/.*7\\.txt$')")
def find_files_glob(spark, d):
    return t.find_files(a.files(spark, d), "/corpus/src*/de/*7.txt").select("id", "path")


@query(f"""WITH {a.FILES}, p AS (SELECT string_split(substr(path, 2), '/') AS ps FROM files), s AS (SELECT ps, unnest(range(1, least(len(ps), 3) + 1)) AS depth FROM p)
SELECT DISTINCT '/' || array_to_string(ps[1:depth], '/') AS path, CAST(depth AS INTEGER) AS depth, depth < len(ps) AS is_dir FROM s""")
def project_tree(spark, d):
    return t.project_tree(a.files(spark, d), 3)


@query(f"WITH {a.FILES} SELECT regexp_extract(path, '^(.*/)', 1) AS directory, count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_size FROM files WHERE path LIKE '/corpus/src1%' AND NOT contains(path, 'dist') GROUP BY 1")
def list_directory_stats(spark, d):
    return t.list_directory(a.files(spark, d), "/corpus/src1")


@query(f"WITH {a.FILES} SELECT id, size_bytes, CAST(len(string_split(content, chr(10))) AS INTEGER) AS n_lines, contains(content, chr(0)) AS is_binary FROM files")
def file_metadata(spark, d):
    return a.files(spark, d).select("id", "size_bytes", F.size(F.split("content", "\n", -1)).alias("n_lines"), F.contains("content", F.lit("\0")).alias("is_binary"))


@query(f"WITH {a.FILES} SELECT id, count(*) > 0 AS found FROM files WHERE path LIKE '%/12.txt' GROUP BY id")
def file_exists(spark, d):
    return a.files(spark, d).where(F.col("path").endswith("/12.txt")).groupBy("id").agg((F.count("*") > 0).alias("found"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS doc FROM pages")
def docstring_extract(spark, d):
    return a.table(spark, d, "pages").select("page_id", t.docstring(F.col("html")).alias("doc"))


@query("SELECT page_id, name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Z][A-Za-z0-9]*|[a-z]+-[a-z0-9-]+|h[1-6]|article|footer|nav)', 1)) AS name FROM pages) GROUP BY page_id, name")
def component_refs(spark, d):
    names = F.regexp_extract_all("html", F.lit(r"<([A-Z][A-Za-z0-9]*|[a-z]+-[a-z0-9-]+|h[1-6]|article|footer|nav)"), F.lit(1))
    return a.table(spark, d, "pages").select("page_id", F.explode(names).alias("name")).groupBy("page_id", "name").agg(F.count("*").alias("n"))


@query("""SELECT page_id, regexp_extract(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS body,
  CAST(length(split_part(html, '<script', 1)) - length(replace(split_part(html, '<script', 1), chr(10), '')) + 1 AS INTEGER) AS line FROM pages""")
def script_section(spark, d):
    x = t.script_section(F.col("html"))
    return a.table(spark, d, "pages").select("page_id", x["body"].alias("body"), x["line"].alias("line"))


@query(f"WITH {a.FILES} SELECT id, size_bytes // 4 AS tokens FROM files")
def token_estimate(spark, d):
    return a.files(spark, d).select("id", sc.token_estimate(F.col("content")).alias("tokens"))


@query("SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)")
def frontend_calls(spark, d):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return a.table(spark, d, "pages").select("page_id", F.explode(hrefs).alias("href")).distinct()


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method FROM pages")
def api_routes(spark, d):
    method = F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST")
    return a.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"), method.alias("method"))


@query("SELECT page_id, regexp_replace(replace(url, '=', '/${x}'), '\\$\\{[^}]+\\}', ':param', 'g') AS path FROM pages")
def normalize_api_path(spark, d):
    return a.table(spark, d, "pages").select("page_id", links.normalize_api_path(F.replace("url", F.lit("="), F.lit("/${x}"))).alias("path"))


@query("""SELECT p_partkey, lower(translate(p_brand || '_' || p_name, '_-', '')) AS field, lower(regexp_replace(replace(p_type, ' ', '') || p_brand, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')) AS kebab,
  array_to_string(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda p: upper(left(p, 1)) || substr(p, 2)), '') AS pascal, CASE WHEN length(p_name) > 9 THEN left(p_name, 6) || '...' ELSE p_name END AS short FROM part""")
def name_functions(spark, d):
    return a.table(spark, d, "part").select(
        "p_partkey",
        sc.normalize_field(F.concat("p_brand", F.lit("_"), "p_name")).alias("field"),
        sc.pascal_to_kebab(F.concat(F.replace("p_type", F.lit(" "), F.lit("")), "p_brand")).alias("kebab"),
        sc.kebab_to_pascal(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("pascal"),
        sc.truncate(F.col("p_name"), 9).alias("short"),
    )


@query(f"""WITH {a.FILES} SELECT id, CASE WHEN size_bytes < 1024 THEN format('{{:d}} B', size_bytes) WHEN size_bytes < 1048576 THEN printf('%.1f KB', round(size_bytes / 1024.0::DOUBLE, 1)) ELSE printf('%.1f MB', round(size_bytes / 1048576.0::DOUBLE, 1)) END AS size,
  CASE WHEN size_bytes < 60 THEN size_bytes || 's' WHEN size_bytes < 3600 THEN (size_bytes // 60) || 'm' WHEN size_bytes < 86400 THEN (size_bytes // 3600) || 'h' ELSE (size_bytes // 86400) || 'd' END AS duration FROM files""")
def format_functions(spark, d):
    return a.files(spark, d).select("id", sc.format_bytes(F.col("size_bytes")).alias("size"), sc.format_duration(F.col("size_bytes")).alias("duration"))


@query(f"""WITH {a.FILES} SELECT id, CASE WHEN contains(content, 'the') THEN replace(content, 'the', 'THE') END AS patched,
  CASE WHEN length(content) - length(replace(content, 'the', '')) >= 6 THEN
    array_to_string(string_split(content, 'the')[1:2], 'the') || 'THE' || array_to_string(string_split(content, 'the')[3:], 'the') END AS second FROM files""")
def patch_text(spark, d):
    return a.files(spark, d).select("id", t.replace_occurrence(F.col("content"), "the", "THE").alias("patched"), t.replace_occurrence(F.col("content"), "the", "THE", 2).alias("second"))


@query(f"""WITH {a.LINES}, p AS (SELECT id, string_split(content, chr(10)) AS x, string_split(replace(content, 'of', 'OF'), chr(10)) AS y FROM files),
i AS (SELECT id, x, y, unnest(range(1, greatest(len(x), len(y)) + 1)) AS k FROM p)
SELECT id, CAST(k AS INTEGER) AS line FROM i WHERE x[k] IS DISTINCT FROM y[k]""")
def changed_lines(spark, d):
    return a.files(spark, d).select("id", F.explode(sc.changed_lines(F.col("content"), F.replace("content", F.lit("of"), F.lit("OF")))).alias("line"))


@query("""SELECT item_id, CAST(length(left(text, 100)) - length(replace(left(text, 100), chr(10), '')) + 1 AS INTEGER) AS line FROM benchmark""")
def line_of_offset(spark, d):
    return a.table(spark, d, "benchmark").select("item_id", sc.line_of_offset(F.col("text"), F.lit(100)).alias("line"))


@query(f"WITH {a.FILES} SELECT id, substr(path, 9) AS relative FROM files")
def relative_paths(spark, d):
    return a.files(spark, d).select("id", sc.make_relative(F.col("path"), "/corpus").alias("relative"))


@query(f"""WITH {a.FILES} SELECT language, CASE id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' END AS extension, count(*) AS n
FROM files WHERE NOT contains(path, '/src3/') AND NOT (contains(path, '/fr/') AND id % 10 <> 7) GROUP BY 1, 2""")
def ignore_and_extension(spark, d):
    """Files under the names of three languages, without those that an ignore file's lines leave out."""
    f = a.files(spark, d)
    ext = F.element_at(F.array(F.lit(".py"), F.lit(".rs"), F.lit(".zip")), (F.col("id") % 3 + 1).cast("int"))
    f = f.withColumn("path", F.concat(F.regexp_replace(F.substr("path", F.lit(9)), r"\.txt$", ""), ext))
    f = f.where(~corpus.ignored(F.col("path"), ["# made files", "src3/", "**/fr/*", "!*7.*"]))
    return f.groupBy("language", corpus.language(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, lower(regexp_extract(l, '^([A-Za-z0-9][A-Za-z0-9._-]*)', 1)) AS name, regexp_extract(l, '([<>=!~]=?[^;\\s]*)', 1) AS spec FROM (SELECT p_partkey, replace(p_name, ' ', '-') || '>=' || p_size || ' # ' || p_brand AS raw, trim(regexp_replace(replace(p_name, ' ', '-') || '>=' || p_size || ' # ' || p_brand, '(^|\\s)#.*$', '')) AS l FROM part)""")
def requirements_lines(spark, d):
    line = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(">="), F.col("p_size").cast("string"), F.lit(" # "), F.col("p_brand"))
    x = sc.requirement(line)
    return a.table(spark, d, "part").select("p_partkey", x["name"].alias("name"), x["spec"].alias("spec"))


@query("""SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN split_part(p, '::', 1) WHEN 1 THEN split_part(p, '.', 1) WHEN 2 THEN string_split(p, '/')[-1] ELSE CASE WHEN starts_with(p, '@') THEN array_to_string(string_split(p, '/')[1:2], '/') ELSE string_split(p, '/')[1] END END AS package
FROM (SELECT c_custkey, c_nationkey, CASE c_nationkey % 4 WHEN 0 THEN 'serde::de::' || c_custkey WHEN 1 THEN 'os.path.x' || c_custkey WHEN 2 THEN 'github.com/x/m' || c_custkey ELSE '@scope/p' || c_custkey || '/sub' END AS p FROM customer)""")
def package_name(spark, d):
    k, n = F.col("c_nationkey") % 4, F.col("c_custkey").cast("string")
    p = F.when(k == 0, F.concat(F.lit("serde::de::"), n)).when(k == 1, F.concat(F.lit("os.path.x"), n)).when(k == 2, F.concat(F.lit("github.com/x/m"), n)).otherwise(F.concat(F.lit("@scope/p"), n, F.lit("/sub")))
    lang = F.when(k == 0, "rust").when(k == 1, "python").when(k == 2, "go").otherwise("typescript")
    return a.table(spark, d, "customer").select("c_custkey", links.package_name(p, lang).alias("package"))


@query(f"WITH {a.LINES} SELECT DISTINCT file_id, lower(regexp_extract(text, '([A-Z][a-z]+) License', 1)) AS license FROM lines WHERE regexp_matches(text, '[A-Z][a-z]+ License')")
def license_lines(spark, d):
    hits = a.lines(a.files(spark, d)).where(F.col("text").rlike("[A-Z][a-z]+ License"))
    return hits.select("file_id", F.lower(F.regexp_extract("text", "([A-Z][a-z]+) License", 1)).alias("license")).distinct()


@query("SELECT event_id, CAST(least(256, greatest(32, floor(102400 / (value + 1)))) AS INTEGER) AS batch FROM events")
def adaptive_batch(spark, d):
    return a.table(spark, d, "events").select("event_id", sc.adaptive_batch(F.col("value") + 1).alias("batch"))
