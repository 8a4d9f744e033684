"""Queries over the extraction table functions: a source file per part and language, whose contents SQL knows as well."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sedimenta.operators import extract as x
from sedimenta.operators import routes as r
from sedimenta.sources import adapters as a

from .registry import query

PYTHON = "import os\nfrom pkg{s} import helper_{s} as h\n\nclass Item{k}:\n    size: int = {s}\n\n    def price(self, q):\n        return h(q) * {s}\n\ndef make_{k}(q):\n    return Item{k}().price(q)\n"
RUST = "use std::fmt;\nuse crate::shop::Item;\n\npub struct Part{k} {{\n    pub size: u32,\n    name: String,\n}}\n\nimpl Part{k} {{\n    pub fn price(&self) -> u32 {{\n        compute(self.size) // {s}\n    }}\n}}\n"
TYPESCRIPT = 'import {{ load }} from "./m{s}";\n\nexport interface Part{k} {{\n  size: number;\n  label?: string;\n}}\n\nexport function price{k}(p: Part{k}) {{\n  return load(p.size) + {s};\n}}\n'
GO = 'package main\n\nimport "example.com/m{s}"\n\ntype Part{k} struct {{\n\tSize int\n}}\n\nfunc (p Part{k}) Price() int {{\n\treturn m{s}.Compute(p.Size)\n}}\n'
TEMPLATES = (("python", PYTHON), ("rust", RUST), ("typescript", TYPESCRIPT), ("go", GO))


def sources(spark, d):
    p = a.table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("string").alias("s"))
    out = None
    for n, (language, template) in enumerate(TEMPLATES):
        parts = []
        text = template.replace("{{", "\0").replace("}}", "\1")
        for piece in re.split(r"(\{[ks]\})", text):
            parts.append(F.col(piece[1]) if piece in ("{k}", "{s}") else F.lit(piece.replace("\0", "{").replace("\1", "}")))
        rows = p.select((F.col("p_partkey") * 4 + n).alias("file_id"), F.lit(language).alias("language"), F.concat(*parts).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


_K, _S = "p_partkey", "p_size"


@query(
    f"""SELECT file_id, name, kind, line_start, line_end FROM (SELECT p_partkey * 4 + v.f AS file_id, v.n AS name, v.k AS kind, CAST(v.a AS INTEGER) AS line_start, CAST(v.b AS INTEGER) AS line_end FROM (SELECT p_partkey, unnest([
  {{'f': 0, 'n': 'Item' || {_K}, 'k': 'class', 'a': 4, 'b': 8}}, {{'f': 0, 'n': 'price', 'k': 'method', 'a': 7, 'b': 8}}, {{'f': 0, 'n': 'make_' || {_K}, 'k': 'function', 'a': 10, 'b': 11}},
  {{'f': 1, 'n': 'Part' || {_K}, 'k': 'struct', 'a': 4, 'b': 7}}, {{'f': 1, 'n': 'Part' || {_K}, 'k': 'impl', 'a': 9, 'b': 13}}, {{'f': 1, 'n': 'price', 'k': 'function', 'a': 10, 'b': 12}},
  {{'f': 2, 'n': 'Part' || {_K}, 'k': 'interface', 'a': 3, 'b': 6}}, {{'f': 2, 'n': 'price' || {_K}, 'k': 'function', 'a': 8, 'b': 10}},
  {{'f': 3, 'n': 'Part' || {_K}, 'k': 'struct', 'a': 5, 'b': 7}}, {{'f': 3, 'n': 'Price', 'k': 'method', 'a': 9, 'b': 11}}]) AS v FROM part))"""
)
def parse_symbols(spark, d):
    return x.extract(sources(spark, d), "symbols").drop("signature")


@query(
    f"""SELECT p_partkey * 4 + v.f AS file_id, v.n AS name, v.k AS kind, CAST(v.a AS INTEGER) AS line FROM (SELECT p_partkey, unnest([
  {{'f': 0, 'n': 'os', 'k': 'import', 'a': 1}}, {{'f': 0, 'n': 'helper_' || {_S}, 'k': 'import', 'a': 2}}, {{'f': 0, 'n': 'h', 'k': 'call', 'a': 8}}, {{'f': 0, 'n': 'Item' || {_K}, 'k': 'call', 'a': 11}}, {{'f': 0, 'n': 'price', 'k': 'call', 'a': 11}},
  {{'f': 1, 'n': 'Item', 'k': 'import', 'a': 2}}, {{'f': 1, 'n': 'compute', 'k': 'call', 'a': 11}}, {{'f': 2, 'n': 'load', 'k': 'import', 'a': 1}}, {{'f': 2, 'n': 'Part' || {_K}, 'k': 'type_usage', 'a': 8}}, {{'f': 2, 'n': 'load', 'k': 'call', 'a': 9}},
  {{'f': 3, 'n': 'm' || {_S}, 'k': 'import', 'a': 3}}, {{'f': 3, 'n': 'Part' || {_K}, 'k': 'type_usage', 'a': 9}}, {{'f': 3, 'n': 'Compute', 'k': 'call', 'a': 10}}]) AS v FROM part)"""
)
def parse_references(spark, d):
    return x.extract(sources(spark, d), "refs")


@query(
    f"""SELECT p_partkey * 4 + v.f AS file_id, v.m AS module, v.i AS item, v.r AS relative, CAST(v.a AS INTEGER) AS line FROM (SELECT p_partkey, unnest([
  {{'f': 0, 'm': 'os', 'i': '*', 'r': false, 'a': 1}}, {{'f': 0, 'm': 'pkg' || {_S}, 'i': 'helper_' || {_S}, 'r': false, 'a': 2}}, {{'f': 1, 'm': 'crate::shop', 'i': 'Item', 'r': true, 'a': 2}},
  {{'f': 2, 'm': './m' || {_S}, 'i': 'load', 'r': true, 'a': 1}}, {{'f': 3, 'm': 'example.com/m' || {_S}, 'i': '*', 'r': false, 'a': 3}}]) AS v FROM part)"""
)
def parse_imports(spark, d):
    return x.extract(sources(spark, d), "imports")


@query(
    f"""SELECT p_partkey * 4 + v.f AS file_id, v.t AS type, v.n AS field FROM (SELECT p_partkey, unnest([
  {{'f': 0, 't': 'Item' || {_K}, 'n': 'size'}}, {{'f': 1, 't': 'Part' || {_K}, 'n': 'size'}}, {{'f': 1, 't': 'Part' || {_K}, 'n': 'name'}}, {{'f': 2, 't': 'Part' || {_K}, 'n': 'size'}},
  {{'f': 2, 't': 'Part' || {_K}, 'n': 'label'}}, {{'f': 3, 't': 'Part' || {_K}, 'n': 'Size'}}]) AS v FROM part)"""
)
def type_fields(spark, d):
    return x.extract(sources(spark, d), "fields")


@query()
def smart_chunks(spark, d):
    f = a.files(spark, d).select(F.col("id").alias("file_id"), "language", "content")
    return x.extract(f, "chunks").select("file_id", "line_start", "line_end", F.sha2("content", 256).alias("hash"))


@query()
def skeleton(spark, d):
    return x.extract(sources(spark, d), "skeleton")


ROUTES = (
    ("axum", '    .route("/r{k}", get(show_{k}))'),
    ("express", "router.post('/e{k}/:id', save_{k});"),
    ("fastapi", '@app.delete("/f{k}")'),
    ("flask", '@app.route("/l{k}", methods=["GET", "POST"])'),
    ("nest", "@Controller('n{k}')\n@Get('items')"),
    ("axios", "const a = await axios.put(`/r{k}/${x}`, body)"),
    ("fetch", "fetch('/l{k}', {method: 'POST'})"),
)


def route_lines(spark, d):
    """One file per part whose lines declare a route in each framework and make two calls."""
    p = a.table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("k"))
    text = "\n".join(t for _, t in ROUTES)
    content = F.replace(F.lit(text), F.lit("{k}"), F.col("k"))
    return a.lines(p.select(F.col("p_partkey").alias("id"), content.alias("content")))


@query("""SELECT p_partkey AS file_id, CAST(v.a AS INTEGER) AS line, v.f AS framework, v.m AS method, v.p AS path, v.h AS handler FROM (SELECT p_partkey, unnest([
  {'a': 1, 'f': 'axum', 'm': 'GET', 'p': '/r' || p_partkey, 'h': 'show_' || p_partkey}, {'a': 2, 'f': 'express', 'm': 'POST', 'p': '/e' || p_partkey || '/:id', 'h': 'save_' || p_partkey},
  {'a': 3, 'f': 'fastapi', 'm': 'DELETE', 'p': '/f' || p_partkey, 'h': NULL}, {'a': 4, 'f': 'flask', 'm': 'GET', 'p': '/l' || p_partkey, 'h': NULL}, {'a': 4, 'f': 'flask', 'm': 'POST', 'p': '/l' || p_partkey, 'h': NULL},
  {'a': 6, 'f': 'nest', 'm': 'GET', 'p': '/n' || p_partkey || '/items', 'h': NULL}]) AS v FROM part)""")
def backend_routes(spark, d):
    return r.backend_routes(route_lines(spark, d))


@query("""SELECT p_partkey AS file_id, CAST(v.a AS INTEGER) AS line, v.c AS client, v.m AS method, v.p AS path, v.q AS pattern FROM (SELECT p_partkey, unnest([
  {'a': 7, 'c': 'axios', 'm': 'PUT', 'p': '/r' || p_partkey || '/${x}', 'q': '/r' || p_partkey || '/:param'}, {'a': 8, 'c': 'fetch', 'm': 'POST', 'p': '/l' || p_partkey, 'q': '/l' || p_partkey}]) AS v FROM part)""")
def client_calls(spark, d):
    return r.frontend_calls(route_lines(spark, d))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS file_id, l_linenumber AS first, CAST(l_linenumber + l_quantity AS INTEGER) AS last FROM lineitem),
m AS (SELECT *, max(last) OVER (PARTITION BY file_id ORDER BY first, last DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) SELECT file_id, first, last FROM m WHERE reach IS NULL OR last > reach""")
def merge_ranges(spark, d):
    s = a.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("first"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("last"))
    return r.merge_ranges(s)


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p, '^src/[^/]+/') THEN regexp_extract(p, '^src/([^/]+)/', 1) WHEN regexp_matches(p, '^docs/|\\.md$') THEN 'docs' WHEN regexp_matches(p, '(^|/)tests?/') THEN 'tests' WHEN contains(p, 'api') THEN 'api' END AS scope
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'src/' || p_type || '/x.rs' WHEN 1 THEN 'docs/' || p_partkey WHEN 2 THEN 'a/tests/b.py' ELSE 'x/api' || p_partkey END AS p FROM part)""")
def change_scope(spark, d):
    k = F.col("p_size") % 4
    p = F.when(k == 0, F.concat(F.lit("src/"), "p_type", F.lit("/x.rs"))).when(k == 1, F.concat(F.lit("docs/"), F.col("p_partkey").cast("string"))).when(k == 2, "a/tests/b.py").otherwise(F.concat(F.lit("x/api"), F.col("p_partkey").cast("string")))
    return a.table(spark, d, "part").select("p_partkey", r.scope(p).alias("scope"))


@query("""WITH b AS (SELECT l_orderkey, list(DISTINCT l_shipdate::DATE::VARCHAR ORDER BY l_shipdate::DATE::VARCHAR) AS points, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, 'feat(core): ' || n || ' lines' || chr(10) || chr(10) || array_to_string(list_transform(points[1:5], lambda p: '- ' || p), chr(10)) AS message FROM b""")
def commit_messages(spark, d):
    b = a.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd"))).alias("points"), F.count("*").alias("n"))
    return b.select("l_orderkey", r.commit_message(F.lit("feat"), F.lit("core"), F.concat(F.col("n").cast("string"), F.lit(" lines")), F.col("points")).alias("message"))


@query("""SELECT p_partkey, ['size', 'q' || p_size] AS props, ['save'] AS emits, ['default', 's' || p_partkey] AS slots FROM part""")
def component_meta(spark, d):
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("<script setup>defineProps<{ size: number; q"), s, F.lit("?: string }>()\ndefineEmits(['save'])</script><template><slot/><slot name=\"s"), k, F.lit("\"/></template>"))
    x = r.vue_meta(text)
    return a.table(spark, d, "part").select("p_partkey", x["props"].alias("props"), x["emits"].alias("emits"), x["slots"].alias("slots"))
