"""Stored tables and streams, project summaries, catalogues, and what resources and prompts are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import code as c
from sedimenta.operators import extract as x
from sedimenta.operators import maintain as m
from sedimenta.operators import search as s
from sedimenta.sources import adapters as a
from sedimenta.sources import reports, scratch
from sedimenta.streaming import windows

from . import code as made
from .registry import query

# stored tables and streams


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'P'")
def versioned_table(spark, d):
    """A table through three versions: all orders, new prices for some of them, some of them deleted."""
    o = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    t = m.VersionedTable(spark, scratch.folder(spark, "orders"))
    t.write(o.drop("o_orderstatus"))
    t.merge(o.where("o_orderstatus = 'O'").select("id", (F.col("price") + 1).alias("price")), ["id"])
    t.delete(o.where("o_orderstatus = 'P'").select("id"), ["id"])
    return t.read()


_LATEST = """WITH e AS (SELECT user_id % 50 AS path, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_id AS seq, value FROM events),
l AS (SELECT path, max(seq) AS seq FROM e GROUP BY path) SELECT e.path, e.seq, e.value FROM e JOIN l ON e.path = l.path AND e.seq = l.seq WHERE op = 'upsert'"""


def _changes(spark, d):
    """The events as a stream of changes of 50 files."""
    rows = spark.readStream.schema(a.table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    return rows.select((F.col("user_id") % 50).alias("path"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("event_id").alias("seq"), "value")


@query(_LATEST)
def stream_ingest(spark, d):
    """A change stream applied to a stored table, a merge for each micro-batch."""
    t = m.VersionedTable(spark, scratch.folder(spark, "ingest"))
    windows.ingest(_changes(spark, d), t, ["path"], ["seq"], scratch.folder(spark, "ingest-checkpoint")).awaitTermination()
    return t.read()


@query("SELECT count(*) AS rows_read FROM events")
def stream_progress(spark, d):
    """What a stream says of its own progress: the rows that its batches have read."""
    t = m.VersionedTable(spark, scratch.folder(spark, "progress"))
    q = windows.ingest(_changes(spark, d), t, ["path"], ["seq"], scratch.folder(spark, "progress-checkpoint"))
    q.awaitTermination()
    return windows.progress(spark, q)


@query("SELECT o_orderkey AS source, l_partkey AS target, max(l_discount) AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def insert_entity_links(spark, d):
    """Pairs are unique: a link that comes again replaces the old one, with the greater confidence."""
    li = a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_discount").alias("confidence"))
    per = li.groupBy("source", "target").agg(F.max("confidence").alias("confidence"))
    old, new = per.where("source % 3 > 0").withColumn("confidence", F.col("confidence") * 0), per.where("source % 3 < 3")
    return m.merge(old, new, ["source", "target"], {"confidence": F.greatest("old.confidence", "new.confidence")})


@query("SELECT l_orderkey AS path, l_returnflag AS method, max(l_linestatus) AS handler FROM lineitem GROUP BY 1, 2")
def insert_api_endpoints(spark, d):
    """An endpoint is one row by path and method."""
    li = a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("handler"))
    return m.merge(li.where("false"), li, ["path", "method"])


# projects and catalogues


def _manifest(spark, d):
    return made.texts(spark, d, '[package]\nname = "p{k}"\nversion = "0.{s}.0"\nedition = "2021"\n[dependencies]\nserde = "1"\ntokio = "1.{s}"\n')


@query("SELECT 'p' || p_partkey AS path, 'p' || p_partkey AS name, '0.' || p_size || '.0' AS version, '2021' AS edition, 2 AS dependencies FROM part")
def rust_project_info(spark, d):
    t = _manifest(spark, d).select("path", "value")
    n = reports.toml_manifests(t).groupBy("path").agg(F.count("*").cast("int").alias("dependencies"))
    key = lambda name: F.regexp_extract("value", rf'(?m)^{name}\s*=\s*"([^"]*)"', 1).alias(name)
    return t.select("path", key("name"), key("version"), key("edition")).join(n, "path", "left").withColumn("dependencies", F.coalesce("dependencies", F.lit(0)))


@query("SELECT 'p' || p_partkey AS path, 'example.com/p' || p_partkey AS module, '1.22' AS version, 2 AS dependencies FROM part")
def go_project_info(spark, d):
    t = made.texts(spark, d, "module example.com/p{k}\n\ngo 1.22\n\nrequire (\n\texample.com/m{s} v1.0.0\n\tgithub.com/x/y v0.2.0\n)\n").select("path", "value")
    n = reports.go_mod(t).groupBy("path").agg(F.count("*").cast("int").alias("dependencies"))
    return t.select("path", F.regexp_extract("value", r"(?m)^module\s+(\S+)", 1).alias("module"), F.regexp_extract("value", r"(?m)^go\s+(\S+)", 1).alias("version")).join(n, "path")


@query("SELECT p_partkey * 4 + 1 AS file_id, 'load' || p_partkey AS name, 'export const load' || p_partkey || ' = async (' AS signature FROM part")
def script_signatures(spark, d):
    src = made.sources(spark, d).where("language = 'typescript'")
    y = x.extract(src, "symbols")
    e = x.extract(src, "exports").select("file_id", "name")
    return y.where("kind = 'function'").join(e, ["file_id", "name"], "left_semi").select("file_id", "name", "signature")


@query("SELECT p_partkey * 4 + 1 AS file_id, 'Row' || p_partkey AS type, ['size'] AS members, 1 AS users FROM part")
def inspect_types(spark, d):
    """Interfaces with their members and how many functions of the file use them."""
    src = made.sources(spark, d).where("language = 'typescript'")
    y = x.extract(src, "symbols")
    members = x.extract(src, "fields").groupBy("file_id", "type").agg(F.array_sort(F.collect_set("field")).alias("members"))
    used = c.referenced_types(y.where("kind = 'function'"), x.extract(src, "refs"), y).groupBy("file_id", "type").agg(F.count_distinct("function").cast("int").alias("users"))
    return y.where("kind = 'interface'").select("file_id", F.col("name").alias("type")).join(members, ["file_id", "type"]).join(used, ["file_id", "type"])


#: The tools of each language service.
SERVICES = {
    "go": ("explain_struct", "find_interface_impls", "project_info"),
    "python": ("inspect_code", "read_manifest", "resolve_import"),
    "rust": ("explain_struct", "find_trait_impls", "project_info", "resolve_module_path"),
    "typescript": ("find_references", "get_exports", "get_signature", "inspect_type"),
    "vue": ("find_usages", "get_meta", "pinia_stores", "read_section", "resolve_component", "router_map"),
}


@query("SELECT service, count(*) AS n FROM (VALUES " + ", ".join(f"('{k}', '{t}')" for k, v in SERVICES.items() for t in v) + ") t(service, tool) GROUP BY 1")
def language_tools(spark, d):
    """The catalogue of language tools, by service."""
    rows = spark.createDataFrame([(k, t) for k, v in SERVICES.items() for t in v], "service string, tool string")
    return rows.groupBy("service").agg(F.count("*").alias("n"))


@query("SELECT p_type AS language, p_brand AS type, list(DISTINCT p_name ORDER BY p_name) AS fields, count(DISTINCT p_name) AS field_count FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_name) >= 3")
def fingerprints_by_language(spark, d):
    """Types with three fields or more, by language."""
    rows = a.table(spark, d, "part").groupBy(F.col("p_type").alias("language"), F.col("p_brand").alias("type")).agg(F.array_sort(F.collect_set("p_name")).alias("fields"))
    return rows.withColumn("field_count", F.size("fields").cast("long")).where("field_count >= 3").orderBy("language", "type")


@query("SELECT p_name AS name, p_size AS version, CASE p_size % 4 WHEN 1 THEN 'npm' END AS ecosystem FROM part WHERE p_size % 4 = 1")
def dependencies_by_ecosystem(spark, d):
    eco = F.get(F.array(*map(F.lit, ("cargo", "npm", "pypi", "go"))), (F.col("p_size") % 4).cast("int"))
    return a.table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("version"), eco.alias("ecosystem")).where("ecosystem = 'npm'")


@query(f"WITH {a.FILES}, q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'pending' END AS st FROM orders) SELECT coalesce(st, 'completed') AS status, count(*) AS n FROM files f LEFT JOIN q ON q.id = f.id GROUP BY 1")
def files_by_status(spark, d):
    """A file without a status counts as completed."""
    st = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "pending")
    q = a.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), st.alias("st"))
    return a.files(spark, d).select("id").join(q, "id", "left").groupBy(F.coalesce("st", F.lit("completed")).alias("status")).agg(F.count("*").alias("n"))


# resources and prompts


@query(f"WITH {a.SYMBOLS} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(DISTINCT language) FROM files) AS languages, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FROM events) AS calls")
def resource_stats(spark, d):
    """The numbers of the project's resource, each from one pass."""
    f = a.files(spark, d)
    own = f.agg(F.count("*").alias("files"), F.count_distinct("language").alias("languages"), F.sum(F.size(F.filter(F.split("content", "\n", -1), lambda t: F.size(a.terms(t)) > 0))).alias("symbols"))
    count = lambda name, t: a.table(spark, d, t).agg(F.count("*").alias(name))
    row = own.withColumn("one", F.lit(1)).join(count("chunks", "embeddings").withColumn("one", F.lit(1)), "one").join(count("calls", "events").withColumn("one", F.lit(1)), "one")
    return row.select("files", "symbols", "languages", "chunks", "calls")


@query("SELECT p_partkey * 4 AS root, 'Explain p' || p_partkey || '/app/main.ts. It declares function: 1. It imports p' || p_partkey || '/src/api/m.ts, p' || p_partkey || '/src/ui/index.tsx.' AS prompt FROM part")
def explain_module_prompt(spark, d):
    """A prompt on a module from its path, its symbols by kind and the files that it imports."""
    f, by_alias, _ = made.resolved(spark, d)
    paths = f.select(F.col("id").alias("target"), F.col("path").alias("imported"))
    taken = by_alias.join(paths.hint("merge"), "target").groupBy(F.col("file_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("imported")), ", ").alias("imported"))
    kinds = c.symbol_summary(x.extract(f.select(F.col("id").alias("file_id"), F.lit("typescript").alias("language"), "content"), "symbols")).withColumnRenamed("file_id", "id")
    rows = f.where("id % 4 = 0").join(taken.hint("merge"), "id").join(kinds.hint("merge"), "id")
    return rows.select(F.col("id").alias("root"), F.concat(F.lit("Explain "), "path", F.lit(". It declares "), "kinds", F.lit(". It imports "), "imported", F.lit(".")).alias("prompt"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q, label FROM embeddings WHERE vec_id = 5) SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: (z[1] - z[2]) ** 2))), 5) AS distance FROM embeddings, q WHERE embeddings.label = q.label AND vec_id <> 5 ORDER BY distance, vec_id LIMIT 5""")
def find_related_prompt(spark, d):
    """The chunks nearest to one of the same label, for a prompt on related code."""
    e = a.table(spark, d, "embeddings")
    me = e.where("vec_id = 5").first()
    q = s.literal_vector([float(v) for v in me["embedding"]])
    rows = e.where((F.col("label") == me["label"]) & (F.col("vec_id") != 5)).select("vec_id", F.round(F.sqrt(s.squared_l2(F.col("embedding"), q)), 5).alias("distance"))
    return rows.orderBy("distance", "vec_id").limit(5)
