"""Relational lookups, graph joins and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import graph as g
from sedimenta.operators import links
from sedimenta.sources import adapters as a

from .registry import query


def _symbols(spark, d):
    f = a.files(spark, d)
    return f, a.symbols(a.lines(f))


def _refs(spark, d):
    f = a.files(spark, d)
    ls = a.lines(f)
    return f, a.symbols(ls), a.refs(a.tokens(ls))


@query(f"WITH {a.SYMBOLS} SELECT f.path, s.name, s.kind, s.line_start FROM symbols s JOIN files f ON f.id = s.file_id WHERE s.kind = 'struct' ORDER BY f.path, s.line_start LIMIT 200 OFFSET 50")
def get_symbols_page(spark, d):
    f, s = _symbols(spark, d)
    page = s.where("kind = 'struct'").join(f.select(F.col("id").alias("file_id"), "path"), "file_id")
    return page.orderBy("path", "line_start").offset(50).limit(200).select("path", "name", "kind", "line_start")


@query(f"WITH {a.SYMBOLS} SELECT kind, count(*) AS n FROM symbols GROUP BY kind")
def symbols_by_kind(spark, d):
    return _symbols(spark, d)[1].groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {a.SYMBOLS} SELECT id, file_id, kind, line_start FROM symbols WHERE name = 'the'")
def symbol_by_name(spark, d):
    return _symbols(spark, d)[1].where("name = 'the'").select("id", "file_id", "kind", "line_start")


@query(f"""WITH {a.SYMBOLS} SELECT f.path, string_agg(s.name || ':' || s.line_start, ',' ORDER BY s.line_start) AS symbols FROM symbols s JOIN files f ON f.id = s.file_id GROUP BY f.path""")
def symbols_grouped_by_file(spark, d):
    f, s = _symbols(spark, d)
    x = F.sort_array(F.collect_list(F.struct("line_start", "name")))
    out = s.groupBy("file_id").agg(F.array_join(F.transform(x, lambda v: F.concat(v["name"], F.lit(":"), v["line_start"].cast("string"))), ",").alias("symbols"))
    return out.join(f.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "symbols")


@query(f"""WITH {a.SYMBOLS} SELECT id, starts_with(signature, 'pub ') OR starts_with(signature, 'export ') OR (NOT starts_with(name, '_') AND kind <> 'enum') AS exported FROM symbols""")
def is_exported(spark, d):
    s = _symbols(spark, d)[1]
    return s.select("id", (F.col("signature").startswith("pub ") | F.col("signature").startswith("export ") | (~F.col("name").startswith("_") & (F.col("kind") != "enum"))).alias("exported"))


@query(f"""WITH {a.LINES}, p AS (SELECT file_id, line, text, lag(text) OVER (PARTITION BY file_id ORDER BY line) AS before FROM lines) SELECT file_id, line, coalesce(regexp_matches(before, '^[A-Z][a-z]+'), false) AS documented FROM p""")
def has_documentation(spark, d):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("file_id").orderBy("line"))
    return a.lines(a.files(spark, d)).withColumn("before", before).select("file_id", "line", F.coalesce(F.col("before").rlike("^[A-Z][a-z]+"), F.lit(False)).alias("documented"))


@query(f"""WITH {a.FILES} SELECT id, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/test_' || id || '.txt' AS test_path FROM files WHERE id % 3 = 0
UNION ALL SELECT id, regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || id || '.spec.txt' FROM files WHERE id % 4 = 1 UNION ALL SELECT id, '/corpus/tests/' || id || '.txt' FROM files WHERE id % 5 = 2""")
def has_tests_for(spark, d):
    """Files with the paths of their tests: beside them by two ways of naming, or in the folder of tests. Some files have none, some several, and
    some tests have no file."""
    f = a.files(spark, d).select("id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.col("id").cast("string").alias("stem"))
    beside, spec, apart = F.concat("dir", F.lit("/test_"), "stem", F.lit(".txt")), F.concat("dir", F.lit("/"), "stem", F.lit(".spec.txt")), F.concat(F.lit("/corpus/tests/"), "stem", F.lit(".txt"))
    made = F.array_compact(F.array(F.when(F.col("id") % 3 == 0, beside), F.when(F.col("id") % 4 == 1, spec), F.when(F.col("id") % 5 == 2, apart), F.when(F.col("id") % 7 == 0, F.concat("dir", F.lit("/test_none"), "stem", F.lit(".txt")))))
    there = f.select(F.explode(made).alias("test_path"))
    asked = f.select("id", F.explode(F.array(beside, spec, apart)).alias("test_path"))
    return asked.join(there, "test_path", "left_semi").select("id", "test_path")


@query("""SELECT p_name AS dependency, count(*) AS uses, count(DISTINCT l_orderkey) AS files FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_name""")
def dependency_usage(spark, d):
    # uses are summed up by part before the names come in
    per = a.table(spark, d, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.count("*").alias("n"))
    named = per.join(a.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return named.groupBy(F.col("p_name").alias("dependency")).agg(F.sum("n").alias("uses"), F.count_distinct("l_orderkey").alias("files"))


@query("SELECT l_orderkey AS file_id, l_linenumber AS line, l_returnflag AS usage_type, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name = 'small ring'")
def dependency_impact(spark, d):
    p = a.table(spark, d, "part").where("p_name = 'small ring'").select(F.col("p_partkey").alias("l_partkey"))
    return a.table(spark, d, "lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("usage_type"), "l_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def unused_dependencies(spark, d):
    used = a.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return g.unused(a.table(spark, d, "part"), used, "p_partkey").select("p_partkey", "p_name")


@query("SELECT DISTINCT l_orderkey AS file_id, p_brand AS dependency FROM lineitem JOIN part ON l_partkey = p_partkey")
def file_dependencies(spark, d):
    li = a.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return li.join(a.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select(F.col("l_orderkey").alias("file_id"), F.col("p_brand").alias("dependency")).distinct()


@query(f"WITH {a.REFS} SELECT file_id, line, pos, kind FROM refs WHERE target_name = 'ention'")
def references_by_name(spark, d):
    return _refs(spark, d)[2].where("target_name = 'ention'").select("file_id", "line", "pos", "kind")


@query(f"""WITH {a.REFS}, c AS (SELECT file_id, line, count(*) AS n FROM refs WHERE kind IN ('call', 'usage') AND target_name IN ('was', 'is', 'with') GROUP BY ALL) SELECT s.id AS caller_id, s.name AS caller, c.n FROM c JOIN symbols s ON s.file_id = c.file_id AND s.line_start = c.line""")
def callers(spark, d):
    _, s, r = _refs(spark, d)
    hits = r.where(F.col("kind").isin("call", "usage") & F.col("target_name").isin("was", "is", "with")).groupBy("file_id", F.col("line").alias("line_start")).agg(F.count("*").alias("n"))
    return s.join(hits, ["file_id", "line_start"]).select(F.col("id").alias("caller_id"), F.col("name").alias("caller"), "n")


@query(f"""WITH {a.REFS} SELECT s.name AS caller, r.target_name AS callee, count(*) AS n FROM symbols s JOIN refs r ON r.file_id = s.file_id AND r.line = s.line_start WHERE s.kind = 'enum' AND r.kind = 'call' GROUP BY ALL""")
def callees(spark, d):
    _, s, r = _refs(spark, d)
    per = r.where("kind = 'call'").groupBy("file_id", F.col("line").alias("line_start"), "target_name").agg(F.count("*").alias("n"))
    return s.where("kind = 'enum'").join(per, ["file_id", "line_start"]).groupBy(F.col("name").alias("caller"), F.col("target_name").alias("callee")).agg(F.sum("n").alias("n"))


@query(f"""WITH {a.REFS}, n AS (SELECT s.id, s.file_id, s.name, regexp_extract(f.path, '^(.*/)', 1) AS dir FROM symbols s JOIN files f ON f.id = s.file_id),
a AS (SELECT file_id, name, min(id) AS i FROM n GROUP BY ALL), b AS (SELECT dir, name, min(id) AS i FROM n GROUP BY ALL), c AS (SELECT name, min(id) AS i FROM n GROUP BY ALL)
SELECT r.file_id, r.line, r.pos, r.target_name, coalesce(a.i, b.i, c.i) AS target_id, CASE WHEN a.i IS NOT NULL THEN 'file' WHEN b.i IS NOT NULL THEN 'directory' WHEN c.i IS NOT NULL THEN 'global' ELSE 'unresolved' END AS tier
FROM refs r JOIN files f ON f.id = r.file_id LEFT JOIN a ON a.file_id = r.file_id AND a.name = r.target_name LEFT JOIN b ON b.dir = regexp_extract(f.path, '^(.*/)', 1) AND b.name = r.target_name LEFT JOIN c ON c.name = r.target_name""")
def resolve_references(spark, d):
    f, s, r = _refs(spark, d)
    return g.resolve_references(r, s, f)


@query(f"""WITH {a.SYMBOLS}, m AS (SELECT l.file_id, l.line, s.id, s.name, s.line_end - s.line_start AS span, row_number() OVER (PARTITION BY l.file_id, l.line ORDER BY s.line_end - s.line_start, s.id) AS rn FROM lines l JOIN symbols s ON s.file_id = l.file_id AND l.line BETWEEN s.line_start AND s.line_end)
SELECT file_id, line, id AS symbol_id, name FROM m WHERE rn = 1""")
def enclosing_symbol(spark, d):
    f = a.files(spark, d)
    ls = a.lines(f)
    return g.enclosing_symbol(ls.select("file_id", "line"), a.symbols(ls))


@query(f"""WITH {a.REFS} SELECT s.id AS symbol_id, r.target_name, r.kind, count(*) AS n FROM refs r JOIN symbols s ON s.file_id = r.file_id AND r.line BETWEEN s.line_start AND s.line_end AND r.target_name <> s.name GROUP BY ALL""")
def refs_to_symbols(spark, d):
    _, s, r = _refs(spark, d)
    return g.refs_to_symbols(r, s)


_SUB = "sub AS (SELECT DISTINCT regexp_extract(path, '^(/corpus/src[0-9]+)/', 1) AS p FROM files UNION SELECT DISTINCT regexp_extract(path, '^(/corpus/src[0-9]+/de)/', 1) FROM files WHERE language = 'de')"


def _subprojects(f):
    top = f.select(F.regexp_extract("path", "^(/corpus/src[0-9]+)/", 1).alias("path"))
    return top.unionByName(f.where("language = 'de'").select(F.regexp_extract("path", "^(/corpus/src[0-9]+/de)/", 1).alias("path"))).distinct()


@query(f"WITH {a.FILES}, {_SUB} SELECT f.id, max_by(s.p, length(s.p)) AS subproject FROM files f JOIN sub s ON starts_with(f.path, s.p || '/') GROUP BY f.id")
def subproject_assignment(spark, d):
    f = a.files(spark, d)
    return g.deepest_subproject(f, _subprojects(f))


@query(f"WITH {a.FILES}, {_SUB} SELECT c.p AS path, max_by(s.p, length(s.p)) AS parent FROM sub c LEFT JOIN sub s ON starts_with(c.p, s.p || '/') GROUP BY c.p")
def subproject_parent(spark, d):
    s = _subprojects(a.files(spark, d))
    up = g.deepest_subproject(s.select(F.col("path").alias("id"), "path"), s)
    return s.join(up.select(F.col("id").alias("path"), F.col("subproject").alias("parent")), "path", "left")


@query("""SELECT e.event_id, e.user_id, (SELECT max_by(p.value, (p.ts, p.value)) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_value FROM events e WHERE e.event_type = 'view'""")
def blame_asof(spark, d):
    e = a.table(spark, d, "events")
    probes = e.where("event_type = 'view'").select("user_id", "ts", "event_id")
    hunks = e.where("event_type = 'purchase'").select("user_id", "ts", "value")
    found = g.asof(probes, hunks, "user_id", "ts", "ts", "value", bucket=lambda o: F.date_trunc("day", o))
    return found.select("event_id", "user_id", F.col("value").alias("last_value"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS src, l_partkey + 1000000000 AS dst FROM lineitem UNION SELECT DISTINCT l_partkey + 1000000000, l_suppkey + 2000000000 FROM lineitem),
r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 2)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY node""")
def import_bfs(spark, d):
    li = a.table(spark, d, "lineitem")
    edges = li.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")).unionByName(li.select((F.col("l_partkey") + 1_000_000_000).alias("src"), (F.col("l_suppkey") + 2_000_000_000).alias("dst"))).distinct()
    return g.reachable(edges, spark.range(1, 2).select(F.col("id").alias("node")), 2)


@query(f"WITH {a.SYMBOLS} SELECT id FROM files WHERE id NOT IN (SELECT file_id FROM symbols WHERE kind = 'struct')")
def files_without_symbols(spark, d):
    f, s = _symbols(spark, d)
    return g.unused(f.select("id"), s.where("kind = 'struct'").select(F.col("file_id").alias("id")), "id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')")
def orphaned_symbols(spark, d):
    o = a.table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return a.table(spark, d, "lineitem").join(o, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


_ROUTES = """routes AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/[0-9]+$', '/:id') AS path FROM pages),
calls AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)"""


@query(f"""WITH {_ROUTES}, r AS (SELECT path, list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM routes), c AS (SELECT path, list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM calls)
SELECT r.path AS route, c.path AS call FROM r JOIN c ON len(r.s) = len(c.s) AND len(list_filter(list_zip(r.s, c.s), lambda z: z[1] <> z[2] AND NOT starts_with(z[1], ':') AND NOT starts_with(z[2], ':'))) = 0""")
def route_match(spark, d):
    p = a.table(spark, d, "pages").select(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return links.match_routes(p.select(F.regexp_replace("path", "/[0-9]+$", "/:id").alias("path")), p)


_FIELDS = """fp AS (SELECT page_id, list_distinct(list_filter(string_split(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), ' '), lambda x: x <> '')) AS fields FROM pages)"""


@query(f"WITH {_FIELDS} SELECT page_id, array_to_string(list_sort(fields), ' ') AS fields, CAST(len(fields) AS INTEGER) AS field_count FROM fp WHERE len(fields) >= 3")
def type_fingerprints(spark, d):
    return _fingerprints(spark, d).select("page_id", F.array_join(F.sort_array("fields"), " ").alias("fields"), F.size("fields").alias("field_count")).where("field_count >= 3")


def _fingerprints(spark, d):
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return a.table(spark, d, "pages").select("page_id", F.array_distinct(F.filter(F.split(title, " "), lambda x: x != "")).alias("fields"))


@query(f"""WITH {a.TOKENS}, t AS (SELECT DISTINCT file_id, term FROM tokens), n AS (SELECT file_id, count(*) AS n, any_value(domain) AS domain FROM t JOIN files f ON f.id = t.file_id GROUP BY file_id),
l AS (SELECT t.* FROM t JOIN n ON n.file_id = t.file_id WHERE domain = 'backend'), r AS (SELECT t.* FROM t JOIN n ON n.file_id = t.file_id WHERE domain = 'frontend'),
p AS (SELECT l.file_id AS a, r.file_id AS b, count(*) AS i FROM l JOIN r ON l.term = r.term GROUP BY ALL)
SELECT a, b, CAST(i AS INTEGER) AS shared, round(i / (x.n + y.n - i), 6) AS jaccard FROM p JOIN n x ON x.file_id = a JOIN n y ON y.file_id = b WHERE i / (x.n + y.n - i) >= 0.75""")
def jaccard_links(spark, d):
    f = a.files(spark, d).select(F.col("id").alias("file_id"), "domain", F.array_distinct(a.terms(F.col("content"))).alias("fields"))
    out = links.jaccard_links(f.where("domain = 'backend'"), f.where("domain = 'frontend'"), 0.75)
    return out.select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


_LINKS = "x AS (SELECT l_orderkey AS source, l_partkey AS target, 'part' AS kind, max(l_discount) AS weight FROM lineitem GROUP BY 1, 2)"


def _links(spark, d):
    return a.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.max("l_discount").alias("weight"))


@query(f"WITH {_LINKS} SELECT source, target, weight FROM x WHERE source = 7 OR target = 7 ORDER BY weight DESC, source, target")
def cross_stack_links_for_file(spark, d):
    return _links(spark, d).where((F.col("source") == 7) | (F.col("target") == 7)).select("source", "target", "weight")


@query(f"""WITH {_LINKS}, h AS (SELECT o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) SELECT DISTINCT h.id, x.target, x.weight FROM h JOIN x ON x.source = h.id""")
def cross_stack_search(spark, d):
    h = a.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("source"))
    return _links(spark, d).join(h, "source").select(F.col("source").alias("id"), "target", "weight").distinct()


@query(f"""WITH {a.FILES} SELECT id, CASE WHEN contains(path, '/src0/') OR contains(path, '/src1/') OR contains(path, 'server') OR contains(path, 'api') THEN 'backend' WHEN contains(path, '/src2/') OR contains(path, '/src3/') OR contains(path, 'components') OR contains(path, 'pages') THEN 'frontend'
  WHEN contains(path, 'docker') OR contains(path, 'deploy') OR contains(path, '.github') THEN 'ops' ELSE 'unknown' END AS domain FROM files""")
def domain_detect(spark, d):
    return a.files(spark, d).select("id", links.domain_by_path(F.col("path")).alias("domain"))


@query(f"WITH {a.FILES} SELECT coalesce(domain, 'unknown') AS domain, count(*) AS n FROM files GROUP BY files.domain")
def domain_stats(spark, d):
    return a.files(spark, d).groupBy("domain").agg(F.count("*").alias("n")).select(F.coalesce("domain", F.lit("unknown")).alias("domain"), "n")


@query("SELECT l.doc_id, d.lang, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1")
def golden_samples(spark, d):
    return a.table(spark, d, "labels").where("quality = 1").join(a.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id").select("doc_id", "lang", "source")


@query(f"WITH {a.FILES} SELECT f.path, b.text AS summary FROM files f JOIN benchmark b ON b.item_id = f.id")
def summaries_join(spark, d):
    """The stored summaries (benchmark) with their files' paths."""
    told = a.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("summary"))
    return a.files(spark, d).select("id", "path").join(told, "id").select("path", "summary")


@query("SELECT p_partkey, p_name || '@' || p_size || ' (' || lower(p_type) || ')' || CASE WHEN p_size > 25 THEN ' [dev]' ELSE '' END AS label FROM part ORDER BY p_type, p_name, p_partkey")
def dependencies_ordered(spark, d):
    label = F.concat("p_name", F.lit("@"), F.col("p_size").cast("string"), F.lit(" ("), F.lower("p_type"), F.lit(")"), F.when(F.col("p_size") > 25, " [dev]").otherwise(""))
    return a.table(spark, d, "part").orderBy("p_type", "p_name", "p_partkey").select("p_partkey", label.alias("label"))


@query("SELECT n_name, r_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_regionkey DESC, n_name")
def rules_ordered(spark, d):
    r = a.table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return a.table(spark, d, "nation").join(r, "n_regionkey").orderBy(F.desc("n_regionkey"), "n_name").select("n_name", "r_name", "n_nationkey")
