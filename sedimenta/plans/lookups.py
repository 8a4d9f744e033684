"""Point lookups, existence checks, lists and the rest of the write path, over index tables made from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.functions import scalars as sc
from sedimenta.operators import maintain as m
from sedimenta.operators import search as s
from sedimenta.operators.extract import PRIMITIVES
from sedimenta.sources import adapters as a

from .registry import query

# lookups


@query(f"WITH {a.FILES} SELECT id, path, language, size_bytes FROM files WHERE id = 42")
def file_by_id(spark, d):
    return a.files(spark, d).where("id = 42").select("id", "path", "language", "size_bytes")


@query(f"WITH {a.FILES} SELECT id, path, language FROM files WHERE path = '/corpus/src7/en/7.txt'")
def file_by_path(spark, d):
    return a.files(spark, d).where("path = '/corpus/src7/en/7.txt'").select("id", "path", "language")


@query(f"WITH {a.SYMBOLS} SELECT id, name, kind, line_start FROM symbols WHERE id = 42 * 4294967296 + 1")
def symbol_by_id(spark, d):
    """The number of a symbol holds its file's, so one file is read."""
    f = a.files(spark, d).where(F.col("id") == 42)
    return a.symbols(a.lines(f)).where(F.col("id") == 42 * (1 << 32) + 1).select("id", "name", "kind", "line_start")


_CONFIG = "config_keys AS (SELECT p_brand || '.' || p_type AS key_name, max(p_size) AS default_value, bool_or(p_size > 45) AS required FROM part GROUP BY 1)"


def config_keys(spark, d):
    p = a.table(spark, d, "part").select(F.concat("p_brand", F.lit("."), "p_type").alias("key_name"), "p_size")
    return p.groupBy("key_name").agg(F.max("p_size").alias("default_value"), F.bool_or(F.col("p_size") > 45).alias("required"))


@query(f"WITH {_CONFIG} SELECT key_name || CASE WHEN required THEN ' [required]' ELSE '' END AS key, default_value FROM config_keys")
def config_key_list(spark, d):
    k = config_keys(spark, d)
    return k.select(F.concat("key_name", F.when(F.col("required"), " [required]").otherwise("")).alias("key"), "default_value").orderBy("key")


_LINKS = "links AS (SELECT l_orderkey AS source, l_partkey AS target, max(l_discount) AS confidence, CASE min(l_returnflag) WHEN 'A' THEN 'route' WHEN 'N' THEN 'type' ELSE 'name' END AS link_type FROM lineitem GROUP BY 1, 2)"


def links(spark, d):
    li = a.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.max("l_discount").alias("confidence"), F.min("l_returnflag").alias("f"))
    return li.withColumn("link_type", F.when(F.col("f") == "A", "route").when(F.col("f") == "N", "type").otherwise("name")).drop("f")


@query(f"WITH {_LINKS} SELECT source, target, confidence FROM links WHERE link_type = 'route' ORDER BY confidence DESC, source, target LIMIT 50")
def links_by_type(spark, d):
    return links(spark, d).where("link_type = 'route'").orderBy(F.desc("confidence"), "source", "target").limit(50).select("source", "target", "confidence")


@query(f"WITH {_LINKS} SELECT l.source, o_custkey AS owner, l.target, confidence FROM links l JOIN orders ON o_orderkey = l.source WHERE l.target = 17")
def entity_links_backend(spark, d):
    """Links that lead to one symbol, with the file of the other side."""
    o = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("owner"))
    return links(spark, d).where("target = 17").join(o, "source").select("source", "owner", "target", "confidence")


@query(f"WITH {_LINKS} SELECT l.source, l.target, p_name AS name, confidence FROM links l JOIN part ON p_partkey = l.target WHERE l.source = 33")
def entity_links_frontend(spark, d):
    p = a.table(spark, d, "part").select(F.col("p_partkey").alias("target"), F.col("p_name").alias("name"))
    return links(spark, d).where("source = 33").join(p, "target").select("source", "target", "name", "confidence")


@query("SELECT 'nation.' || n_name AS key, CASE WHEN n_regionkey = 2 THEN 'set again' ELSE n_nationkey::VARCHAR END AS value FROM nation WHERE n_regionkey IN (1, 2)")
def index_meta(spark, d):
    """Values of keys that are set, some of them again, and then asked for by a list of keys."""
    n = a.table(spark, d, "nation").select(F.concat(F.lit("nation."), "n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"), "n_regionkey")
    stored = m.merge(n.drop("n_regionkey"), n.where("n_regionkey = 2").select("key", F.lit("set again").alias("value")), ["key"])
    return stored.join(n.where("n_regionkey IN (1, 2)").select("key"), "key", "left_semi")


_PROBES = "probes AS (SELECT DISTINCT lower(string_split(text, ' ')[1]) AS name, CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id END AS file_id FROM benchmark)"


@query(f"WITH {a.SYMBOLS}, {_PROBES} SELECT name, file_id, CASE WHEN file_id IS NULL THEN name IN (SELECT term FROM tokens) ELSE EXISTS (SELECT 1 FROM symbols y WHERE y.name = p.name AND y.file_id = p.file_id) END AS found FROM probes p")
def symbol_exists(spark, d):
    """In its file where one is named, else anywhere in the keyword index. The probes are the first words of the benchmark's passages."""
    p = a.table(spark, d, "benchmark").select(F.lower(F.split("text", " ")[0]).alias("name"), F.when(F.col("item_id") % 3 != 0, F.col("item_id")).alias("file_id")).distinct()
    ls = a.lines(a.files(spark, d))
    here = a.symbols(ls).select("name", F.col("file_id")).distinct().withColumn("in_file", F.lit(True))
    any_ = a.tokens(ls).select(F.col("term").alias("name")).join(p.where("file_id is null").select("name").distinct(), "name", "left_semi").distinct().withColumn("in_index", F.lit(True))
    out = p.join(here, ["name", "file_id"], "left").join(any_, "name", "left")
    return out.select("name", "file_id", F.coalesce(F.when(F.col("file_id").isNull(), F.col("in_index")).otherwise(F.col("in_file")), F.lit(False)).alias("found"))


@query(f"WITH {a.SYMBOLS}, w AS (SELECT '/corpus/src1/en/' || item_id || '.txt' AS path, item_id AS id FROM benchmark) SELECT y.id, y.name, w.path FROM w JOIN files f ON f.path = w.path JOIN symbols y ON y.file_id = f.id AND length(y.name) = 3")
def symbol_by_name_and_file(spark, d):
    """Short names in the files of a list of paths."""
    w = a.table(spark, d, "benchmark").select(F.concat(F.lit("/corpus/src1/en/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"))
    f = a.files(spark, d).join(w, "path")
    paths = f.select(F.col("id").alias("file_id"), "path")
    return a.symbols(a.lines(f)).where(F.length("name") == 3).join(paths, "file_id").select("id", "name", "path")


@query("""WITH r AS (SELECT p_partkey, unnest([p_name, CASE p_size % 4 WHEN 0 THEN 'String' WHEN 1 THEN 'usize' WHEN 2 THEN 'Promise' ELSE 'nil' END, 'Stringy', 'vec']) AS name FROM part)
SELECT p_partkey, name FROM r WHERE name NOT IN ('String', 'usize', 'Promise', 'nil')""")
def references_without_primitives(spark, d):
    made = F.get(F.array(*map(F.lit, ("String", "usize", "Promise", "nil"))), (F.col("p_size") % 4).cast("int"))
    r = a.table(spark, d, "part").select("p_partkey", F.explode(F.array("p_name", made, F.lit("Stringy"), F.lit("vec"))).alias("name"))
    return r.where(~F.col("name").isin(sorted(PRIMITIVES)))


@query("SELECT c_custkey AS project, 'root/' || c_custkey AS path, max(o_orderdate) AS last_opened FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2 ORDER BY last_opened DESC, project LIMIT 50")
def registry_projects(spark, d):
    """The projects opened last."""
    o = a.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.max("o_orderdate").alias("last_opened"))
    c = a.table(spark, d, "customer").select(F.col("c_custkey").alias("project"))
    top = o.join(c, "project", "left_semi").orderBy(F.desc("last_opened"), "project").limit(50)
    return top.select("project", F.concat(F.lit("root/"), F.col("project").cast("string")).alias("path"), "last_opened")


# joins and sums


@query(f"WITH {a.FILES} SELECT f.path, regexp_extract_all(b.text, '[A-Z][a-z]+') AS components FROM benchmark b JOIN files f ON f.id = b.item_id")
def component_trees(spark, d):
    """Trees stored by file, with the names of their components."""
    t = a.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)).alias("components"))
    return a.files(spark, d).select("id", "path").join(t, "id").select("path", "components")


@query(f"WITH {a.FILES} SELECT f.path, list(vec_id ORDER BY vec_id) AS chunks FROM embeddings e JOIN files f ON f.id = vec_id % 100 WHERE label < 3 GROUP BY 1")
def chunks_per_file(spark, d):
    """The chunks of hits by their file; hits are a cut list, so an array is small."""
    e = a.table(spark, d, "embeddings").where("label < 3").select((F.col("vec_id") % 100).alias("id"), "vec_id")
    return e.join(a.files(spark, d).select("id", "path"), "id").groupBy("path").agg(F.sort_array(F.collect_list("vec_id")).alias("chunks"))


@query(f"WITH {a.AUDIT} SELECT count(*) AS requests, round(sum(latency_ms), 4) AS total_ms, round(avg(latency_ms), 4) AS mean_ms, count(*) FILTER (WHERE NOT success) AS failed FROM audit")
def daemon_counters(spark, d):
    return a.audit(spark, d).agg(F.count("*").alias("requests"), F.round(F.sum("latency_ms"), 4).alias("total_ms"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.count_if(~F.col("success")).alias("failed"))


@query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(*) > 20 AND count(DISTINCT l_partkey) > 5")
def having_groups(spark, d):
    g = a.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"))
    return g.where("n > 20 AND parts > 5")


_PROBE_COUNTS = " UNION ALL ".join(f"SELECT '{name}' AS component, count(*) AS n, count(*) > 0 AS healthy FROM {table}" for name, table in (("files", "documents"), ("vectors", "embeddings"), ("audit", "events"), ("queue", "orders")))


@query(_PROBE_COUNTS)
def health_check(spark, d):
    """One count for each component; counts of Parquet files come from their footers."""
    out = None
    for name, t in (("files", "documents"), ("vectors", "embeddings"), ("audit", "events"), ("queue", "orders")):
        row = a.table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("component"), "n", (F.col("n") > 0).alias("healthy"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1)
, r AS (SELECT label AS service, vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 9) AS c FROM embeddings, q)
SELECT service, vec_id, round(c, 6) AS relevance, row_number() OVER (PARTITION BY service ORDER BY c DESC, vec_id) AS rank FROM r QUALIFY rank <= 5""")
def tool_ranking(spark, d):
    """The five best tools of each service (label) by the cosine of their description to the request."""
    from pyspark.sql import Window

    e = a.table(spark, d, "embeddings")
    q = [float(x) for x in e.where("vec_id = 1").select("embedding").first()[0]]
    rows = e.select(F.col("label").alias("service"), "vec_id", F.round(s.cosine(F.col("embedding"), s.literal_vector(q)), 9).alias("c"))
    rank = F.row_number().over(Window.partitionBy("service").orderBy(F.desc("c"), "vec_id"))  # tasks keep the first five of each
    return rows.withColumn("rank", rank).where("rank <= 5").select("service", "vec_id", F.round("c", 6).alias("relevance"), F.col("rank").cast("long").alias("rank"))


@query("SELECT table_name AS name, n FROM (VALUES ('documents', (SELECT count(*) FROM documents)), ('part', (SELECT count(*) FROM part)), ('region', (SELECT count(*) FROM region))) t(table_name, n)")
def batch_operations(spark, d):
    """Several independent reads at once; results keep the order of the requests, and one that fails has an error instead."""
    jobs = [(n, lambda n=n: a.table(spark, d, n).count()) for n in ("documents", "part", "region")]
    done = m.at_once(jobs, parallel=3)
    return spark.createDataFrame([(name, value) for name, value, error in done if error is None], "name string, n long")


# scalars


@query("""SELECT p_partkey, CASE WHEN t = '' THEN NULL ELSE '"' || replace(t, '"', '""') || '"' END AS phrase FROM (SELECT p_partkey, trim(q, ' ') AS t FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '   ' WHEN 1 THEN ' say "' || p_name || '" ' ELSE p_name END AS q FROM part))""")
def query_sanitised(spark, d):
    k = F.col("p_size") % 4
    q = F.when(k == 0, "   ").when(k == 1, F.concat(F.lit(' say "'), "p_name", F.lit('" '))).otherwise(F.col("p_name"))
    return a.table(spark, d, "part").select("p_partkey", s.sanitised(q).alias("phrase"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Button' WHEN 1 THEN '.env' WHEN 2 THEN 'a.b' ELSE 'plain' END AS component FROM part""")
def component_name(spark, d):
    paths = F.array(*map(F.lit, ("src/ui/Button.vue", "x/.env", "a.b.vue", "dir.d/plain")))
    return a.table(spark, d, "part").select("p_partkey", sc.file_stem(F.get(paths, (F.col("p_size") % 4).cast("int"))).alias("component"))


@query("""SELECT p_partkey, p_size % 4 < 2 AS stdlib FROM part""")
def likely_stdlib(spark, d):
    modules = F.array(*map(F.lit, ("os.path", "concurrent.futures", "numpy.linalg", "osx")))
    return a.table(spark, d, "part").select("p_partkey", sc.likely_stdlib(F.get(modules, (F.col("p_size") % 4).cast("int"))).alias("stdlib"))


@query("""SELECT p_partkey, '{' || chr(10) || '  "a": "http://x/*no*/' || p_name || '",  ' || chr(10) || '  "b": ' || p_size || ' ' || chr(10) || '}' AS text, CAST(p_size AS BIGINT) AS b FROM part""")
def json_without_comments(spark, d):
    text = F.concat(F.lit('{\n  "a": "http://x/*no*/'), "p_name", F.lit('",  // "c": 1,\n  "b": '), F.col("p_size").cast("string"), F.lit(' /* one "\n two */\n}'))
    bare = sc.strip_json_comments(text)
    return a.table(spark, d, "part").select("p_partkey", bare.alias("text"), F.get_json_object(bare, "$.b").cast("long").alias("b"))


@query(f"""WITH {a.FILES}, c AS (SELECT id, content, unnest(string_split(content, '')) AS ch, generate_subscripts(string_split(content, ''), 1) AS i FROM files WHERE strlen(content) > 2000),
s AS (SELECT id, content, i, sum(strlen(ch)) OVER (PARTITION BY id ORDER BY i) AS bytes FROM c), k AS (SELECT id, any_value(content) AS content, max(i) AS n FROM s WHERE bytes <= 2000 GROUP BY id)
SELECT id, left(content, n) AS beginning FROM k UNION ALL SELECT id, content FROM files WHERE strlen(content) <= 2000""")
def truncated_utf8(spark, d):
    """What a summariser is sent of each file: at most 2000 bytes, never half a character."""
    return a.files(spark, d).select("id", sc.truncate_utf8(F.col("content"), 2000).alias("beginning"))


@query("""SELECT p_partkey, '{"field":"' || p_brand || '","size":' || p_size || ',"names":["' || p_type || '","x"]}' AS metadata FROM part""")
def json_metadata(spark, d):
    x = F.struct(F.col("p_brand").alias("field"), F.col("p_size").alias("size"), F.array("p_type", F.lit("x")).alias("names"))
    return a.table(spark, d, "part").select("p_partkey", F.to_json(x).alias("metadata"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'total_' || p_partkey WHEN 1 THEN 'Cart' || p_partkey WHEN 2 THEN 'load' || p_partkey END AS context FROM part""")
def declared_names(spark, d):
    k = F.col("p_partkey").cast("string")
    texts = F.array(
        F.concat(F.lit("// sums\n\npub fn total_"), k, F.lit("<T>(x: T) {")), F.concat(F.lit("export class Cart"), k, F.lit(" extends Base {")), F.concat(F.lit("x\nfunction load"), k, F.lit("() {\n")),
        F.concat(F.lit("\n\n\n\n\ndef late"), k, F.lit("():")),
    )
    return a.table(spark, d, "part").select("p_partkey", s.declared_name(F.get(texts, (F.col("p_size") % 4).cast("int"))).alias("context"))


# the write path


@query("SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'backend' ELSE 'unknown' END AS domain FROM documents")
def update_file_domain(spark, d):
    old = a.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("unknown").alias("domain"))
    new = a.table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id"), F.lit("backend").alias("domain"))
    return m.merge(old, new, ["id"])


@query("SELECT p_partkey AS file_id, CASE WHEN p_size > 40 THEN 'marked' ELSE 'kept' END AS reason FROM part WHERE p_size > 30")
def mark_golden_sample(spark, d):
    p = a.table(spark, d, "part")
    old = p.where("p_size > 30").select(F.col("p_partkey").alias("file_id"), F.lit("kept").alias("reason"))
    return m.merge(old, p.where("p_size > 40").select(F.col("p_partkey").alias("file_id"), F.lit("marked").alias("reason")), ["file_id"])


@query(f"WITH {a.ERRORS} SELECT file_path, line, message, severity, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line, code ORDER BY updated_at DESC, message DESC) AS rn FROM errors) WHERE rn = 1")
def insert_errors(spark, d):
    """Of reports of one error the last one counts."""
    e = a.errors(spark, d)
    last = e.groupBy("file_path", "line", "code").agg(F.max(F.struct("updated_at", "message", "severity")).alias("x"))
    return last.select("file_path", "line", "x.message", "x.severity", "x.updated_at")


@query(f"WITH {a.ERRORS} SELECT severity, count(*) AS n FROM errors WHERE file_path NOT IN (SELECT '/src/u' || user_id || '.rs' FROM events WHERE user_id % 2 = 0) GROUP BY 1")
def clear_file_errors(spark, d):
    gone = a.table(spark, d, "events").where("user_id % 2 = 0").select(F.concat(F.lit("/src/u"), F.col("user_id").cast("string"), F.lit(".rs")).alias("file_path"))
    return m.delete_by_key(a.errors(spark, d), gone, ["file_path"]).groupBy("severity").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, max(event_id) AS last_id FROM (SELECT event_id FROM events UNION ALL SELECT event_id + 1000000 FROM events WHERE event_type = 'error')")
def log_tool_calls(spark, d):
    """New rows of the log go behind the old ones; nothing of the old is read to write them."""
    old = a.table(spark, d, "events").select("event_id")
    new = a.table(spark, d, "events").where("event_type = 'error'").select((F.col("event_id") + 1_000_000).alias("event_id"))
    return old.unionByName(new).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("""WITH old AS (SELECT vec_id, vec_id % 50 AS file, label FROM embeddings WHERE vec_id % 3 > 0), new AS (SELECT vec_id + 10000 AS vec_id, vec_id % 50 AS file, 9 AS label FROM embeddings WHERE vec_id % 50 < 10)
SELECT * FROM old WHERE file NOT IN (SELECT file FROM new) UNION ALL SELECT * FROM new""")
def upsert_chunks(spark, d):
    """All chunks of the files that a batch brings go, then the batch comes in."""
    e = a.table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("file"), F.col("label").cast("int").alias("label"))
    new = e.where("file < 10").select((F.col("vec_id") + 10_000).alias("vec_id"), "file", F.lit(9).alias("label"))
    return m.replace_by_key(e.where("vec_id % 3 > 0"), new, ["file"])


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings")
def compaction(spark, d):
    """The vector table in few sorted parts, with the rows that it had."""
    e = a.table(spark, d, "embeddings")
    return m.compacted(e, 100_000, by=["vec_id"]).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("""WITH gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT 'files' AS t, count(*) AS n FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)""")
def delete_file_cascade(spark, d):
    o, li = a.table(spark, d, "orders"), a.table(spark, d, "lineitem")
    left = m.cascade({"files": (o, "o_orderkey"), "lines": (li, "l_orderkey")}, o.where("o_orderstatus = 'P'"), "o_orderkey")
    out = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n") for name, t in left.items()]
    return out[0].unionByName(out[1])


@query(f"""WITH {a.QUEUE}, p AS (SELECT file_id FROM queue WHERE status = 'pending' ORDER BY priority DESC, created_at, file_id LIMIT 10)
SELECT status, count(*) AS n, CAST(sum(file_id) AS BIGINT) AS ids FROM (SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM p) THEN 'processing' ELSE status END AS status FROM queue) GROUP BY 1""")
def queue_pop_moves(spark, d):
    """Popping moves rows to processing."""
    q = a.queue(spark, d)
    return m.moved(q, m.popped(q, 10), "processing").groupBy("status").agg(F.count("*").alias("n"), F.sum("file_id").alias("ids"))


@query(f"WITH {a.QUEUE} SELECT status, count(*) AS n FROM (SELECT CASE WHEN status IN ('pending', 'processing') THEN CASE WHEN file_id % 7 = 0 THEN 'completed' WHEN file_id % 7 = 1 THEN 'failed' ELSE status END ELSE status END AS status FROM queue) GROUP BY 1")
def queue_complete_and_fail(spark, d):
    q = a.queue(spark, d)
    done = m.moved(q, q.where("file_id % 7 = 0"), "completed")
    return m.moved(done, q.where("file_id % 7 = 1"), "failed").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1")
def cache_model_check(spark, d):
    """A cache of one model is empty for another."""
    c = a.table(spark, d, "customer")
    mine, other = m.model_checked(c.where("c_custkey % 2 = 0"), "small:64", "small:64"), m.model_checked(c, "small:64", "large:64")
    return mine.unionByName(other).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(f"""WITH {a.FILES}, u AS (SELECT DISTINCT content_hash FROM files), o AS (SELECT content_hash, content_hash IN (SELECT content_hash FROM files WHERE language = 'en') AS cached FROM u)
SELECT content_hash, cached, CASE WHEN cached THEN 0.0 ELSE round(CAST(('0x' || substr(content_hash, 1, 6)) AS BIGINT) / 16777216.0, 9) END AS first FROM o""")
def embedding_with_cache(spark, d):
    """Only hashes that the cache lacks are embedded, each once; the embedder here is a stand-in with the hash's own digits."""
    f = a.files(spark, d)
    cache = f.where("language = 'en'").select("content_hash", F.array(F.lit(0.0)).alias("vector")).dropDuplicates(["content_hash"])
    stand_in = lambda df: df.select("content_hash", F.array(F.round(F.conv(F.substring("content_hash", 1, 6), 16, 10).cast("long") / 16777216.0, 9)).alias("vector"))
    out = m.with_cache(f.select("content_hash").distinct(), cache, "content_hash", stand_in)
    return out.select("content_hash", "cached", F.col("vector")[0].alias("first"))
