"""Queries on made source files whose answers follow from their numbers: a shop's files in four languages for each part, with nested
items, generics, heads over several lines, and braces in strings and comments; tool reports and manifests; and a project's imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import code as c
from sedimenta.operators import extract as x
from sedimenta.operators import routes as r
from sedimenta.sources import adapters as a
from sedimenta.sources import corpus, reports, scratch

from .registry import query


def filled(template: str, **values):
    """The template with {name} replaced by columns."""
    out, at = [], 0
    import re

    for m in re.finditer(r"\{(\w+)\}", template):
        if m.group(1) in values:
            out += [F.lit(template[at : m.start()]), values[m.group(1)]]
            at = m.end()
    return F.concat(*out, F.lit(template[at:])) if at < len(template) else F.concat(*out)


def parts(spark, d):
    p = a.table(spark, d, "part").select("p_partkey", "p_size", "p_name")
    return p.withColumns({"k": F.col("p_partkey").cast("string"), "s": F.col("p_size").cast("string"), "n": (F.col("p_size") % 4 + 1).cast("int")})


#: Parts whose files are made by one task.
DEAL = 8192


def dealt(spark, d):
    """parts(), dealt over tasks by their number before files are made of them: the table is small and its files are not, and one task may read it whole."""
    p = parts(spark, d)
    return p.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-p.count() // DEAL)), "p_partkey")


def repeated(template: str):
    """n copies of the template, numbered by {i} from 0."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: filled(template, i=i.cast("string"), k=F.col("k"))), "")


RUST_HEAD = "/// Holds {k}, not { this }\npub struct Box{k}<F: Fn(u32) -> u32> {\n    pub f: F,  // {\n    size: u32,\n}\n\nimpl<F: Fn(u32) -> u32> Shape{s} for Box{k}<F>\nwhere\n    F: Clone,\n{\n"
RUST_METHOD = "    fn m{i}(&self) -> &str {\n        helper_{k}(\"}{\")\n    }\n"
RUST_TAIL = "}\n\nfn helper_{k}(\n    text: &str,\n) -> &str {\n    /* { */ text\n}\n"
TS_HEAD = "import { api } from \"@/api/m{s}\";\n\nexport interface Row{k} {\n  size: number;\n}\n\nexport const load{k} = async (\n  row: Row{k},\n  then: (x: number) => void,\n): Promise<Row{k}> => {\n  const text = `{ ${row.size} `;\n  return api(row, text);\n};\n\nclass Table{k} {\n"
TS_METHOD = "  // row {i} }\n"
TS_TAIL = "}\n"
GO_TEXT = "package shop\n\nimport (\n\t\"fmt\"\n\tm \"example.com/m{s}\"\n)\n\ntype Cart{k} struct {\n\tSize int // }\n\titems []Item\n}\n\ntype Item struct{ Name string }\n\nfunc (c *Cart{k}) Price(\n\tq int,\n) int {\n\tfmt.Println(\"}\")\n\treturn m.Sum(c.Size) * q\n}\n\nfunc open{k}() *Cart{k} { return nil }\n"
PY_HEAD = "from shop.base import Base as B\n\n@register(\"x{k}\")\nclass Deal{k}(B):\n    \"\"\"class Not{k}: pass\"\"\"\n    rate: float = 1.0\n    owner: Owner\n\n"
PY_METHOD = "    @cached\n    async def m{i}(self, cart: Cart) -> Total:\n        def inner():\n            return cart.sum(\"def no(\")\n        return inner()\n\n"
PY_TAIL = "def _hidden_{k}(): return None\n"


def sources(spark, d):
    """(file_id, language, content): four files for each part, numbered part * 4 + language."""
    k, s = F.col("k"), F.col("s")
    texts = (
        ("rust", F.concat(filled(RUST_HEAD, k=k, s=s), repeated(RUST_METHOD), filled(RUST_TAIL, k=k))),
        ("typescript", F.concat(filled(TS_HEAD, k=k, s=s), repeated(TS_METHOD), F.lit(TS_TAIL))),
        ("go", filled(GO_TEXT, k=k, s=s)),
        ("python", F.concat(filled(PY_HEAD, k=k), repeated(PY_METHOD), filled(PY_TAIL, k=k))),
    )
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lang).alias("language")) for i, (lang, _) in enumerate(texts)])).alias("f")
    content = F.when(F.lit(False), F.lit(None).cast("string"))  # a row makes its own text only
    for i, (_, text) in enumerate(texts):
        content = content.when(F.col("f.i") == i, text)
    return dealt(spark, d).select("p_partkey", "k", "s", "n", each).select((F.col("p_partkey") * 4 + F.col("f.i")).alias("file_id"), "f.language", content.alias("content"))


def source_lines(spark, d):
    return a.lines(sources(spark, d).select(F.col("file_id").alias("id"), "content"))


_P = "p AS (SELECT p_partkey, p_partkey * 4 AS f, p_partkey AS k, p_size AS s, p_size % 4 + 1 AS n FROM part), m AS (SELECT *, unnest(range(n)) AS i FROM p)"
_SYMBOLS = f"""{_P}, y AS (
  SELECT f AS file_id, 'Box' || k AS name, 'struct' AS kind, 2 AS a, 5 AS b FROM p UNION ALL SELECT f, 'Box' || k, 'impl', 7, 11 + 3 * n FROM p UNION ALL SELECT f, 'm' || i, 'function', 11 + 3 * i, 13 + 3 * i FROM m
  UNION ALL SELECT f, 'helper_' || k, 'function', 13 + 3 * n, 17 + 3 * n FROM p
  UNION ALL SELECT f + 1, 'Row' || k, 'interface', 3, 5 FROM p UNION ALL SELECT f + 1, 'load' || k, 'function', 7, 13 FROM p UNION ALL SELECT f + 1, 'Table' || k, 'class', 15, 16 + n FROM p
  UNION ALL SELECT f + 2, 'Cart' || k, 'struct', 8, 11 FROM p UNION ALL SELECT f + 2, 'Item', 'struct', 13, 13 FROM p UNION ALL SELECT f + 2, 'Price', 'method', 15, 20 FROM p UNION ALL SELECT f + 2, 'open' || k, 'function', 22, 22 FROM p
  UNION ALL SELECT f + 3, 'Deal' || k, 'class', 3, 7 + 6 * n FROM p UNION ALL SELECT f + 3, 'm' || i, 'method', 9 + 6 * i, 13 + 6 * i FROM m UNION ALL SELECT f + 3, 'inner', 'function', 11 + 6 * i, 12 + 6 * i FROM m
  UNION ALL SELECT f + 3, '_hidden_' || k, 'function', 9 + 6 * n, 9 + 6 * n FROM p)"""


@query(f"WITH {_SYMBOLS} SELECT file_id, name, kind, CAST(a AS INTEGER) AS line_start, CAST(b AS INTEGER) AS line_end FROM y")
def parse_nested_symbols(spark, d):
    return x.extract(sources(spark, d), "symbols").drop("signature")


@query(f"""WITH {_P} SELECT f AS file_id, 'F' AS name, 1 AS n FROM p
UNION ALL SELECT f + 1, 'Row' || k, 2 FROM p UNION ALL SELECT f + 2, 'Item', 1 FROM p UNION ALL SELECT f + 2, 'Cart' || k, 2 FROM p
UNION ALL SELECT f + 3, 'B', 1 FROM p UNION ALL SELECT f + 3, 'Owner', 1 FROM p UNION ALL SELECT f + 3, 'Cart', n FROM p UNION ALL SELECT f + 3, 'Total', n FROM p""")
def type_usages(spark, d):
    u = x.extract(sources(spark, d), "refs", "type_usage")
    return u.groupBy("file_id", "name").agg(F.count("*").cast("int").alias("n"))


@query(f"""WITH {_P} SELECT f AS file_id, 'Box' || k AS name, 'struct' AS kind, 2 AS line FROM p UNION ALL SELECT f + 1, 'Row' || k, 'interface', 3 FROM p UNION ALL SELECT f + 1, 'load' || k, 'function', 7 FROM p
UNION ALL SELECT f + 2, 'Cart' || k, 'struct', 8 FROM p UNION ALL SELECT f + 2, 'Item', 'struct', 13 FROM p UNION ALL SELECT f + 2, 'Price', 'method', 15 FROM p UNION ALL SELECT f + 3, 'Deal' || k, 'class', 4 FROM p""")
def exported_items(spark, d):
    return x.extract(sources(spark, d), "exports")


@query(f"""WITH {_P} SELECT f + 3 AS file_id, 'Deal' || k AS name, 'register(''x' || k || ''')' AS decorator, 3 AS line FROM p UNION ALL SELECT f + 3, 'm' || i, 'cached', CAST(9 + 6 * i AS INTEGER) FROM m""")
def decorators(spark, d):
    return x.extract(sources(spark, d), "decorators")


@query(f"WITH {_P} SELECT 'Shape' || s AS trait, f AS file_id, 'Box' || k AS name, 7 AS line FROM p WHERE s = 7")
def trait_implementations(spark, d):
    return c.trait_impls(x.extract(sources(spark, d).where("language = 'rust'"), "impls"), F.lit("Shape7"))


@query(f"WITH {_P} SELECT f AS file_id, 'Box' || k AS name, 2 AS line_start, ['f', 'size'] AS fields, ['Shape' || s] AS traits, list_transform(range(n), lambda i: 'm' || i) AS methods FROM p")
def explain_struct(spark, d):
    rust = sources(spark, d).where("language = 'rust'")
    y = x.extract(rust, "symbols")
    return c.explained(y.where("kind = 'struct'"), x.extract(rust, "fields"), x.extract(rust, "impls"), y)


@query(f"""WITH {_P} SELECT f + 1 AS file_id, 'load' || k AS function, 7 AS line_start,
  'export const load' || k || ' = async (' || chr(10) || '  row: Row' || k || ',' || chr(10) || '  then: (x: number) => void,' || chr(10) || '): Promise<Row' || k || '> => {{' || chr(10) || '  const text = `{{ ${{row.size}} `;' || chr(10) || '  return api(row, text);' || chr(10) || '}};' AS code,
  ['Row' || k] AS types, []::VARCHAR[] AS callees, ['@/api/m' || s] AS imports FROM p
UNION ALL SELECT f, 'm' || i, CAST(11 + 3 * i AS INTEGER), '    fn m' || i || '(&self) -> &str {{' || chr(10) || '        helper_' || k || '("}}{{")' || chr(10) || '    }}', [], ['helper_' || k], ['crate::none'] FROM m WHERE false
UNION ALL SELECT f, 'm' || i, CAST(11 + 3 * i AS INTEGER), '    fn m' || i || '(&self) -> &str {{' || chr(10) || '        helper_' || k || '("}}{{")' || chr(10) || '    }}', [], ['helper_' || k], [] FROM m""")
def read_function_context(spark, d):
    """The functions of the scripts and the methods of Rust files, with what they need to be understood."""
    src = sources(spark, d).where("language IN ('typescript', 'rust')")
    got = x.extract_tables(src, ("symbols", "refs", "imports"), scratch.folder(spark, "function-context"))
    y = got["symbols"]
    wanted = y.where("kind = 'function' AND name NOT LIKE 'helper%'")
    ls = a.lines(src.select(F.col("file_id").alias("id"), "content"))
    return c.function_context(wanted, ls, got["refs"], y, got["imports"])


@query(f"WITH {_P} SELECT f + 1 AS file_id, 'load' || k AS function, 7 AS line_start, 'Row' || k AS type, 'interface' AS kind, 3 AS type_start FROM p UNION ALL SELECT f + 2, 'open' || k, 22, 'Cart' || k, 'struct', 8 FROM p UNION ALL SELECT f + 2, 'Price', 15, 'Cart' || k, 'struct', 8 FROM p")
def referenced_types(spark, d):
    src = sources(spark, d).where("language IN ('typescript', 'go')")
    y = x.extract(src, "symbols")
    return c.referenced_types(y.where("kind IN ('function', 'method')"), x.extract(src, "refs"), y)


@query(f"""WITH {_P} SELECT f AS file_id, 1 AS line, '/// Holds ' || k || ', not {{ this }}' AS text FROM p UNION ALL SELECT f, 2, 'pub struct Box' || k || '<F: Fn(u32) -> u32> {{' FROM p UNION ALL SELECT f + 1, 15, 'class Table' || k || ' {{' FROM p
UNION ALL SELECT f + 2, 8, 'type Cart' || k || ' struct {{' FROM p UNION ALL SELECT f + 2, 13, 'type Item struct{{ Name string }}' FROM p UNION ALL SELECT f + 3, 4, 'class Deal' || k || '(B):' FROM p""")
def read_types_only(spark, d):
    return c.types_only(source_lines(spark, d)).select("file_id", "line", "text")


@query(f"WITH {_P} SELECT f AS file_id, count(*) AS n FROM (SELECT f, unnest(range(17 + 3 * n)) + 1 AS line, n FROM p) WHERE NOT ((line - 11) % 3 = 0 AND line >= 11 AND line < 11 + 3 * n) AND line <> 13 + 3 * n GROUP BY 1")
def public_items(spark, d):
    """How many lines of each Rust file stay when private items are left out: heads of private functions go."""
    ls = source_lines(spark, d).where("file_id % 4 = 0")
    return c.public_lines(ls, F.lit("rust")).groupBy("file_id").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT DISTINCT p_brand AS interface, p_type AS method FROM part WHERE p_size < 3), h AS (SELECT DISTINCT l_suppkey AS type, p_type AS method FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT interface, count(*) AS n FROM w GROUP BY 1) SELECT w.interface, h.type FROM w JOIN h USING (method) JOIN n USING (interface) GROUP BY w.interface, h.type, n.n HAVING count(*) = n.n""")
def interface_implementations(spark, d):
    p = a.table(spark, d, "part")
    wanted = p.where("p_size < 3").select(F.col("p_brand").alias("interface"), F.col("p_type").alias("method"))
    methods = a.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("type"), F.col("l_partkey").alias("p_partkey")).join(p.select("p_partkey", F.col("p_type").alias("method")), "p_partkey").select("type", "method")
    return c.interface_impls(wanted.select("interface"), wanted, methods)


@query("""SELECT 'crate::shop::m' || p_partkey AS module, 'src/shop/m' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.rs' ELSE '/mod.rs' END AS path FROM part WHERE p_size % 3 < 2 UNION ALL SELECT 'crate', 'src/main.rs'""")
def module_paths(spark, d):
    """Modules of a crate, a third of which are missing, with their files."""
    p = parts(spark, d)
    k = F.col("p_size") % 3
    files = p.select(F.concat(F.lit("src/shop/m"), "k", F.when(k == 0, ".rs").when(k == 1, "/mod.rs").otherwise(".txt")).alias("path"))
    files = files.unionByName(spark.createDataFrame([("src/main.rs",)], "path string"))
    modules = p.select(F.concat(F.lit("crate::shop::m"), "k").alias("module")).unionByName(spark.createDataFrame([("crate",)], "module string"))
    return c.resolve_modules(modules, files)


# a project for each part: main.ts imports by alias and by path, the imported files import further ones


def project(spark, d):
    """(id, path, content): p{k}/app/main.ts, p{k}/src/api/m.ts, p{k}/src/ui/index.tsx, p{k}/src/deep.ts."""
    p, k = dealt(spark, d), F.col("k")
    one = lambda i, path, text: F.struct(F.lit(i).alias("i"), filled(path, k=k).alias("path"), filled(text, k=k, s=F.col("s")).alias("content"))
    rows = F.array(
        one(0, "p{k}/app/main.ts", "import { a } from \"@/api/m\";\nimport { u } from \"~ui\";\nimport x from \"react\";\nexport function main() { a(u); }\n"),
        one(1, "p{k}/src/api/m.ts", "import { d } from \"../deep\";\nexport function a(x) {\n  return d(x) + {s};\n}\n"),
        one(2, "p{k}/src/ui/index.tsx", "export const u = 1;\n"), one(3, "p{k}/src/deep.ts", "export function d(x) {\n  return x;\n}\n"),
    )
    return p.select("p_partkey", F.explode(rows).alias("f")).select((F.col("p_partkey") * 4 + F.col("f.i")).alias("id"), "f.path", "f.content")


def resolved(spark, d):
    f = project(spark, d)
    imports = x.extract(f.select(F.col("id").alias("file_id"), F.lit("typescript").alias("language"), "content"), "imports").join(f.select(F.col("id").alias("file_id"), "path").hint("merge"), "file_id")
    config = '{ // aliases\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["none/*", "src/*"], "~ui": ["src/ui"] } } }'
    configs = parts(spark, d).select(F.concat(F.lit("p"), "k").alias("directory"), F.lit(config).alias("value"))
    by_alias = c.resolve_aliases(imports.select("file_id", "path", "module"), configs, f)
    by_path = r.resolve_imports(imports.where("module LIKE '.%'").select("file_id", "path", "module"), f)
    return f, by_alias, by_path


@query("SELECT p_partkey * 4 AS file_id, '@/api/m' AS module, p_partkey * 4 + 1 AS target FROM part UNION ALL SELECT p_partkey * 4, '~ui', p_partkey * 4 + 2 FROM part")
def import_aliases(spark, d):
    return resolved(spark, d)[1]


@query("SELECT p_partkey * 4 + 1 AS file_id, '../deep' AS module, p_partkey * 4 + 3 AS target FROM part")
def import_paths(spark, d):
    return resolved(spark, d)[2]


@query("""SELECT p_partkey * 4 AS root, p_partkey * 4 + v.i AS file_id, CAST(v.d AS INTEGER) AS depth, CAST(v.n AS INTEGER) AS lines FROM (SELECT p_partkey, unnest([{'i': 0, 'd': 0, 'n': 5}, {'i': 1, 'd': 1, 'n': 3}, {'i': 2, 'd': 1, 'n': 2}, {'i': 3, 'd': 2, 'n': 2}]) AS v FROM part)""")
def context_bundle(spark, d):
    """Each project's main file in full and what it imports, over two steps, as skeletons (a body is one line); here with their numbers of lines."""
    f, by_alias, by_path = resolved(spark, d)
    bare = x.extract(f.select(F.col("id").alias("file_id"), F.lit("typescript").alias("language"), "content"), "skeleton")
    starts = f.where("id % 4 = 0").select(F.col("id").alias("root"))
    out = c.bundle(starts, by_alias.unionByName(by_path), f, bare)
    return out.select("root", "file_id", "depth", F.size(F.split("content", "\n", -1)).alias("lines"))


# sides and frameworks


_MADE = """made AS (SELECT p_partkey, p_size % 8 AS g FROM part)"""
_TEXTS = (
    ("rs", "use axum::Router;\nuse tokio::net;\n.route(\"/a\", get(b))"), ("py", "from fastapi import APIRouter\nimport pytest"), ("py", "import flask\napp = Flask(__name__)"), ("ts", "import { x } from 'vue'\nimport a from 'axios'"),
    ("js", "const e = require('express')\napp.get('/x', f)"), ("tsx", "plain"), ("yml", "a: b"), ("ts", "import { M } from '@nestjs/common'\n@Controller('n')\nimport r from 'react'"),
)


def made(spark, d):
    pick = F.get(F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(t).alias("text")) for e, t in _TEXTS]), (F.col("p_size") % 8).cast("int"))
    return a.table(spark, d, "part").select("p_partkey", pick.alias("m")).select("p_partkey", "m.*")


@query(f"WITH {_MADE} SELECT p_partkey, ['rust', 'python', 'python', 'frontend', 'rust', 'unknown', 'unknown', 'unknown'][1 + g] AS by_imports, ['rust', 'python', 'python', 'unknown', 'unknown', 'frontend', 'ops', 'unknown'][1 + g] AS by_extension, [['axum', 'tokio'], ['fastapi', 'pytest'], ['flask'], ['vue'], ['express'], [], [], ['react', 'nestjs']][1 + g] AS stack FROM made")
def sides(spark, d):
    m = made(spark, d)
    path = F.concat(F.lit("a/b."), "ext")
    return m.select("p_partkey", r.domain_by_imports(F.col("text"), F.col("ext")).alias("by_imports"), r.domain_by_extension(path).alias("by_extension"), r.tech_stack(F.col("text"), F.col("ext")).alias("stack"))


@query(f"WITH {_MADE} SELECT p_partkey, [['axum'], ['fastapi'], ['flask'], [], ['express'], [], [], ['nest']][1 + g] AS frameworks FROM made")
def framework_dispatch(spark, d):
    return made(spark, d).select("p_partkey", c.frameworks(F.col("text"), F.col("ext")).alias("frameworks"))


@query("SELECT p_partkey AS file_id, 2 AS line, 'useCart' || p_partkey AS name, 'cart' || p_size AS store FROM part")
def state_stores(spark, d):
    text = filled("import x\nexport const useCart{k} = defineStore('cart{s}', {})\n", k=F.col("k"), s=F.col("s"))
    return c.stores(a.lines(parts(spark, d).select(F.col("p_partkey").alias("id"), text.alias("content"))))


@query("SELECT p_partkey AS file_id, CAST(v.a AS INTEGER) AS line, v.p AS path, v.c AS component FROM (SELECT p_partkey, unnest([{'a': 1, 'p': '/a' || p_partkey, 'c': 'Home'}, {'a': 2, 'p': '/b/:id', 'c': './V' || p_size || '.vue'}]) AS v FROM part)")
def router_entries(spark, d):
    text = filled("{ path: '/a{k}', component: Home },\n{ path: '/b/:id', component: () => import('./V{s}.vue') },", k=F.col("k"), s=F.col("s"))
    return r.router_map(a.lines(parts(spark, d).select(F.col("p_partkey").alias("id"), text.alias("content"))))


@query("SELECT p_partkey, 'const a = ' || p_size AS script, '<p>' || p_name || '</p>' AS template, NULL::VARCHAR AS style FROM part")
def component_sections(spark, d):
    text = filled("<script setup lang=\"ts\">\nconst a = {s}\n</script>\n<template>\n<p>{m}</p>\n</template>\n", s=F.col("s"), m=F.col("p_name"))
    return parts(spark, d).select("p_partkey", *[c.sections(text, n).alias(n) for n in ("script", "template", "style")])


@query("SELECT p_partkey AS file_id, CASE p_size % 2 WHEN 0 THEN 'my-box' || p_partkey ELSE 'MyBox' || p_partkey END AS component, p_partkey AS target FROM part")
def component_targets(spark, d):
    p = parts(spark, d)
    uses = p.select(F.col("p_partkey").alias("file_id"), F.concat(F.when(F.col("p_size") % 2 == 0, "my-box").otherwise("MyBox"), "k").alias("component"))
    files = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("ui/MyBox"), "k", F.lit(".vue")).alias("path"))
    return c.resolved_component(uses, files)


# reports and manifests


def texts(spark, d, template: str):
    p = parts(spark, d)
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("p"), "k").alias("path"), F.concat(F.lit("p"), "k").alias("file"), filled(template, k=F.col("k"), s=F.col("s")).alias("value"))


@query("SELECT 'src/f' || p_partkey || '.rs' AS file_path, CAST(p_size AS INTEGER) AS line, 4 AS \"column\", 'warning' AS severity, 'unused' AS code, 'unused x' || p_partkey AS message, 'remove it' AS suggestion FROM part")
def compiler_messages(spark, d):
    t = '{"reason":"compiler-message","message":{"level":"warning","message":"unused x{k}","code":{"code":"unused"},"spans":[{"file_name":"no","line_start":1,"column_start":1,"is_primary":false},{"file_name":"src/f{k}.rs","line_start":{s},"column_start":4,"is_primary":true}],"children":[{"level":"help","message":"remove it"}]}}'
    other = '{"reason":"build-finished","success":true,"n":{k}}'
    return reports.cargo(texts(spark, d, t).select("value").unionByName(texts(spark, d, other).select("value")))


@query("SELECT 'src/a' || p_partkey || '.ts' AS file_path, CAST(p_size AS INTEGER) AS line, 7 AS \"column\", 'error' AS severity, 'TS2304' AS code, 'Cannot find name ''x''.' AS message, NULL::VARCHAR AS suggestion FROM part")
def typescript_messages(spark, d):
    rows = texts(spark, d, "src/a{k}.ts({s},7): error TS2304: Cannot find name 'x'.").select("value")
    return reports.tsc(rows.unionByName(texts(spark, d, "Found {k} errors.").select("value")))


@query("SELECT 'l' || p_partkey || '.py' AS file_path, CAST(p_size AS INTEGER) AS line, 'warning' AS severity, 'F401' AS code FROM part UNION ALL SELECT 'l' || p_partkey || '.js', CAST(p_size AS INTEGER), 'error', 'semi' FROM part UNION ALL SELECT 'l' || p_partkey || '.js', 2, 'warning', 'eqeqeq' FROM part")
def linter_messages(spark, d):
    ruff = reports.ruff(texts(spark, d, '[{"filename":"l{k}.py","code":"F401","message":"m","location":{"row":{s},"column":1},"fix":{"message":"f"}}]'))
    es = reports.eslint(texts(spark, d, '[{"filePath":"l{k}.js","messages":[{"ruleId":"semi","severity":2,"message":"m","line":{s},"column":1},{"ruleId":"eqeqeq","severity":1,"message":"m","line":2,"column":1}]}]'))
    keep = ("file_path", "line", "severity", "code")
    return ruff.select(*keep).unionByName(es.select(*keep))


_MANIFESTS = """SELECT 'p' || p_partkey AS path, v.n AS name, v.v AS version, v.d AS dev FROM (SELECT p_partkey, unnest([{'n': 'vue', 'v': '^3.' || p_size, 'd': false}, {'n': 'vite', 'v': '5', 'd': true}, {'n': 'serde', 'v': '1.' || p_size, 'd': false}, {'n': 'tokio', 'v': '1', 'd': false}, {'n': 'rand', 'v': '*', 'd': true}]) AS v FROM part)"""


@query(_MANIFESTS)
def manifest_dependencies(spark, d):
    js = reports.npm(texts(spark, d, '{"dependencies": {"vue": "^3.{s}"}, "devDependencies": {"vite": "5"}}').select("path", "value"))
    toml = '[package]\nname = "p{k}"\n[dependencies]\nserde = "1.{s}"\ntokio = { version = "1", features = ["net"] }\n[dev-dependencies]\nrand = { path = "../r" }\n'
    return js.unionByName(reports.toml_manifests(texts(spark, d, toml).select("path", "value")))


@query("SELECT 'p' || p_partkey AS path, 'example.com/m' || p_size AS name, 'v1.' || p_size || '.0' AS version FROM part UNION ALL SELECT 'p' || p_partkey, 'github.com/x/y', 'v0.2.0' FROM part")
def go_dependencies(spark, d):
    return reports.go_mod(texts(spark, d, "module example.com/p{k}\n\ngo 1.22\n\nrequire (\n\texample.com/m{s} v1.{s}.0\n)\nrequire github.com/x/y v0.2.0 // indirect\n").select("path", "value"))


@query("SELECT 'repo' AS repo, 'c' || p_partkey AS commit_id, 'Ann' AS author, CAST(p_size * 1000 AS BIGINT) AS at, 'f' || v AS file FROM (SELECT p_partkey, p_size, unnest([1, 2]) AS v FROM part)")
def commit_history(spark, d):
    h = reports.history(texts(spark, d, "\0c{k}\x01Ann\x01{s}000\x01say: it\n\nf1\nf2\n").select(F.lit("repo").alias("repo"), "value"))
    return h.select("repo", "commit_id", "author", F.unix_timestamp("ts").alias("at"), "file")


@query("SELECT 'p' || p_partkey AS file, CAST(v AS INTEGER) AS line, CASE v WHEN 1 THEN 'Ann' ELSE 'Bob' END AS author FROM (SELECT p_partkey, unnest([1, 2, 3]) AS v FROM part)")
def blame_lines(spark, d):
    one, two = "a" * 40, "b" * 40
    t = f"{one} 1 1 1\nauthor Ann\nsummary s\n\tx{{k}}\n{two} 2 2 2\nauthor Bob\nfilename f\n\ty\n{two} 3 3\n\tz{{s}}\n"
    return reports.blame(texts(spark, d, t).select("file", "value")).select("file", "line", "author")


@query("SELECT p_partkey AS id, v.f AS file, CAST(v.a AS BIGINT) AS added, CAST(v.d AS BIGINT) AS deleted FROM (SELECT p_partkey, unnest([{'f': 'a' || p_partkey, 'a': 2, 'd': 1}, {'f': 'b' || p_size, 'a': 0, 'd': 1}]) AS v FROM part)")
def diff_sizes(spark, d):
    t = "--- a/a{k}\n+++ b/a{k}\n@@ -1 +1,2 @@\n-x\n+y\n+z\n keep\n--- a/b{s}\n+++ b/b{s}\n@@ -1 +0,0 @@\n-gone\n"
    return reports.diff(texts(spark, d, t).select("id", "value"))


@query("SELECT '# TYPE shop_' || lower(r_name) || ' counter' || chr(10) || 'shop_' || lower(r_name) || ' ' || r_regionkey AS value FROM region WHERE r_name <> 'MIDDLE EAST'")
def metrics_exposition(spark, d):
    m = a.table(spark, d, "region").where("r_name <> 'MIDDLE EAST'").select(F.lower("r_name").alias("name"), F.col("r_regionkey").alias("value"))
    return reports.prometheus(m, "shop")


@query("SELECT 'w/p' || p_partkey AS path, CASE p_size % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'node' ELSE 'python' END AS kind FROM part WHERE p_size > 5")
def manifest_directories(spark, d):
    """Directories that are projects of their own; those below installed packages are not."""
    name = F.get(F.array(*map(F.lit, ("Cargo.toml", "package.json", "pyproject.toml"))), (F.col("p_size") % 3).cast("int"))
    at = F.when(F.col("p_size") > 5, "w/p").otherwise("w/node_modules/p")
    return reports.subprojects(parts(spark, d).select(F.concat(at, "k", F.lit("/"), name).alias("path")))


@query("""SELECT 'd' || doc_id AS path, CASE WHEN lang = 'es' THEN 'delete' ELSE 'upsert' END AS op FROM documents WHERE lang = 'es' OR lang = 'de' OR (lang = 'fr' AND doc_id % 2 = 0)""")
def corpus_changes(spark, d):
    """Of two scans: German files are new, Spanish ones gone, French ones have another time and half of them another content too."""
    t = a.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "lang")
    before = t.where("lang <> 'de'").select("path", F.lit(1).alias("last_modified"), F.col("lang").alias("content_hash"))
    hash_now = F.when((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0), "new").otherwise(F.col("lang"))
    now = t.where("lang <> 'es'").select("path", F.when(F.col("lang") == "fr", 2).otherwise(1).alias("last_modified"), hash_now.alias("content_hash"))
    return corpus.changes(now, before)


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Shop of ' || p_name WHEN 1 THEN 'sums ' || p_partkey ELSE 'Page ' || p_size END AS summary FROM part")
def file_docstrings(spark, d):
    k = F.col("p_size") % 3
    text = F.when(k == 0, filled("//! Shop of {m}\n//! # Heading\nfn a() {}\n", m=F.col("p_name"))).when(k == 1, filled('"""sums {k}"""\nimport x\n', k=F.col("k"))).otherwise(filled("/**\n * @fileoverview Page {s}\n */\n", s=F.col("s")))
    language = F.when(k == 0, "rust").when(k == 1, "python").otherwise("typescript")
    return parts(spark, d).select("p_partkey", r.docstring(text, language).alias("summary"))


@query(f"WITH {_SYMBOLS}, n AS (SELECT file_id, kind, count(*) AS n FROM y GROUP BY 1, 2) SELECT file_id, string_agg(kind || ': ' || n, ', ' ORDER BY kind) AS kinds FROM n GROUP BY 1")
def module_outlines(spark, d):
    """What a prompt or resource says of each file: its symbols by kind."""
    return c.symbol_summary(x.extract(sources(spark, d), "symbols"))
