"""Routes that servers declare and calls that clients make, from the lines of source files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How frameworks declare a route: (framework, pattern, group of the method or the method itself, group of the path, group of the handler).
PATTERNS = (
    ("axum", r'\.route\(\s*"([^"]+)"\s*,\s*(get|post|put|patch|delete)\(([\w:]+)', 2, 1, 3),
    ("express", r"(?<![@\w])(?:app|router)\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"](?:\s*,\s*([\w.]+)\))?", 1, 2, 3),
    ("fastapi", r"^\s*@(?:app|router)\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]", 1, 2, None),
    ("flask", r"^\s*@(?:app|bp|blueprint)\.route\(\s*['\"]([^'\"]+)['\"]", "GET", 1, None),
    ("nest", r"^\s*@(Get|Post|Put|Patch|Delete)\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)", 1, 2, None),
)
CALLS = (
    ("axios", r"\baxios\.(get|post|put|patch|delete)\(\s*['\"`]([^'\"`]+)['\"`]", 1, 2),
    ("fetch", r"\bfetch\(\s*['\"`]([^'\"`]+)['\"`](?:\s*,\s*\{[^}]*method:\s*['\"](\w+)['\"])?", 2, 1),
)


def group(pattern: str, k) -> Column:
    if k is None:
        return F.lit(None).cast("string")
    if isinstance(k, str):
        return F.lit(k)
    got = F.regexp_extract("text", pattern, k)
    return F.when(got != "", got)


def backend_routes(lines: DataFrame) -> DataFrame:
    """(file_id, line, framework, method, path, handler) from lines; a line may declare several routes of different frameworks.

    A Flask route with a list of methods gives a row for each. A Nest route stands below the controller's prefix, the last one before it in the file.
    """
    one = [
        F.when(F.col("text").rlike(p), F.struct(F.lit(name).alias("framework"), F.upper(group(p, m)).alias("method"), F.coalesce(group(p, path), F.lit("")).alias("path"), group(p, h).alias("handler")))
        for name, p, m, path, h in PATTERNS
    ]
    prefix = F.regexp_extract("text", r"^\s*@Controller\(\s*['\"]([^'\"]*)['\"]", 1)
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("controller", F.last(F.when(F.col("text").rlike(r"^\s*@Controller\("), prefix), True).over(before))
    rows = rows.withColumn("r", F.explode(F.array_compact(F.array(*one)))).select("file_id", "line", "text", "controller", "r.*")
    listed = F.regexp_extract_all(F.regexp_extract("text", r"methods\s*=\s*\[([^\]]*)\]", 1), F.lit(r"['\"](\w+)['\"]"), F.lit(1))
    methods = F.when((F.col("framework") == "flask") & (F.size(listed) > 0), listed).otherwise(F.array("method"))
    rows = rows.withColumn("method", F.explode(methods))
    joined = F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.concat_ws("/", F.coalesce("controller", F.lit("")), "path"), "/"), lambda s: s != ""), "/"))
    return rows.select("file_id", "line", "framework", F.upper("method").alias("method"), F.when(F.col("framework") == "nest", joined).otherwise(F.col("path")).alias("path"), "handler")


def frontend_calls(lines: DataFrame) -> DataFrame:
    """(file_id, line, client, method, path, pattern): the pattern has :param for template holes; the method is GET unless told."""
    one = [F.when(F.col("text").rlike(p), F.struct(F.lit(name).alias("client"), F.upper(F.coalesce(group(p, m), F.lit("get"))).alias("method"), group(p, path).alias("path"))) for name, p, m, path in CALLS]
    rows = lines.withColumn("c", F.explode(F.array_compact(F.array(*one)))).select("file_id", "line", "c.*")
    return rows.withColumn("pattern", F.regexp_replace("path", r"\$\{[^}]+\}", ":param"))


#: By extension, what a text must contain, the technology's name (null: none), the side and its points.
MARKS = {
    ("rs",): (("rust", 10), [(("use axum",), "axum", "rust", 5), (("use actix",), "actix", "rust", 5), (("use sqlx",), "sqlx", "rust", 3), (("use diesel",), "diesel", "rust", 3), (("use tokio",), "tokio", None, 0), (("use serde",), "serde", None, 0)]),
    ("py",): (("python", 10), [((f"import {m}", f"from {m}"), m, "python" if n else None, n) for m, n in (("fastapi", 5), ("django", 5), ("flask", 5), ("sqlalchemy", 3), ("asyncio", 0), ("pydantic", 0), ("pytest", 0))]),
    ("ts", "tsx", "js", "jsx", "vue"): (None, [
        (("from 'vue'", 'from "vue"'), "vue", "frontend", 10), (("from 'react'", 'from "react"'), "react", "frontend", 10), (("from 'svelte'",), "svelte", "frontend", 10), (("@tailwind", "tailwindcss"), "tailwindcss", "frontend", 3),
        (("from 'express'", "require('express')"), "express", "rust", 10), (("from '@nestjs",), "nestjs", "rust", 10), (("from 'pg'", "from 'mysql'"), None, "rust", 5), (("from 'axios'", "from 'ky'"), None, "frontend", 2),
    ]),
}
SIDES = ("rust", "python", "frontend")
#: The side that an extension alone tells.
BY_EXTENSION = {"rs": "rust", "py": "python", "vue": "frontend", "tsx": "frontend", "jsx": "frontend", "sql": "rust", "dockerfile": "ops", "yaml": "ops", "yml": "ops"}


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def domain_by_extension(path: Column) -> Column:
    return reduce(lambda out, pair: F.when(extension(path) == pair[0], pair[1]).otherwise(out), BY_EXTENSION.items(), F.lit("unknown"))


def marked(content: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(content, F.lit(w)) for w in words])


def domain_by_imports(content: Column, ext: Column) -> Column:
    """The side with more points than each other one; unknown without such a side."""
    points = {side: F.lit(0) for side in SIDES}
    for exts, (start, marks) in MARKS.items():
        here = ext.isin(*exts)
        if start:
            points[start[0]] = points[start[0]] + F.when(here, start[1]).otherwise(0)
        for words, _, side, n in marks:
            if side:
                points[side] = points[side] + F.when(here & marked(content, words), n).otherwise(0)
    out = F.lit("unknown")
    for side in reversed(SIDES):
        best = points[side] > 0
        for other in SIDES:
            if other != side:
                best = best & (points[side] > points[other])
        out = F.when(best, side).otherwise(out)
    return out


def tech_stack(content: Column, ext: Column) -> Column:
    """Names of technologies that a text imports, in the order in which they are looked for."""
    return F.array_compact(F.array(*[F.when(ext.isin(*exts) & marked(content, words), name) for exts, (_, marks) in MARKS.items() for words, name, _, _ in marks if name]))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (file_id, first, last) that no earlier one of their file contains: sorted by start, kept where they reach beyond all before."""
    w = Window.partitionBy("file_id").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("last").over(w)
    return ranges.distinct().withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("last") > F.col("reach"))).drop("reach")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, module, target): relative imports (file_id, path, module) with the first candidate that is a file: the path itself, an extension, or an index file."""
    base = F.concat(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("/"), F.regexp_replace("module", r"^\./", ""))
    parent = F.regexp_replace(base, r"/[^/]+/\.\./", "/")
    cands = F.array(*[F.concat(parent, F.lit(s)) for s in ("", ".ts", ".tsx", ".js", ".jsx", ".vue", ".py", "/index.ts", "/index.js", "/__init__.py")])
    tried = imports.where(F.col("module").startswith(".")).select("file_id", "module", F.posexplode(cands).alias("rank", "candidate"))
    found = tried.join(files.select(F.col("path").alias("candidate"), F.col("id").alias("target")).hint("merge"), "candidate")  # files may be many, and are not broadcast
    return found.groupBy("file_id", "module").agg(F.min_by("target", "rank").alias("target"))


def docstring(content: Column, language: Column) -> Column:
    """A file's own description: inner comments of Rust, a JSDoc of the file, or the opening docstring of Python; three lines at most."""
    rust = F.array_join(F.slice(F.filter(F.regexp_extract_all(content, F.lit(r"(?m)^//! ?(.*)$"), F.lit(1)), lambda x: ~x.startswith("#")), 1, 3), " ")
    script = F.regexp_extract(content, r"/\*\*[\s\S]*?@(?:fileoverview|description|module)\s+([^\n*]+)", 1)
    python = F.array_join(F.slice(F.split(F.btrim(F.regexp_extract(content, r'^\s*"""([\s\S]*?)"""', 1)), "\n"), 1, 3), " ")
    got = F.when(language == "rust", rust).when(language == "typescript", script).when(language == "python", python)
    return F.when(got != "", F.btrim(got))


#: Parts of a path that name a scope, in order.
SCOPES = (("docs", r"^docs/|\.md$"), ("tests", r"(^|/)tests?/"), ("api", "api"), ("auth", "auth"), ("storage", "storage|database"), ("core", "core"))


def scope(path: Column) -> Column:
    out = F.when(path.rlike("^src/[^/]+/"), F.regexp_extract(path, "^src/([^/]+)/", 1))
    for name, p in SCOPES:
        out = out.when(path.rlike(p), F.lit(name))
    return out


def commit_message(kind: Column, scope_: Column, summary: Column, bullets: Column) -> Column:
    """A subject of at most 72 characters, then at most five points."""
    subject = F.concat(kind, F.coalesce(F.concat(F.lit("("), scope_, F.lit(")")), F.lit("")), F.lit(": "), summary)
    subject = F.when(F.length(subject) > 72, F.concat(F.left(subject, F.lit(69)), F.lit("..."))).otherwise(subject)
    points = F.array_join(F.transform(F.slice(bullets, 1, 5), lambda b: F.concat(F.lit("- "), b)), "\n")
    return F.when(F.size(bullets) == 0, subject).otherwise(F.concat(subject, F.lit("\n\n"), points))


def vue_meta(content: Column) -> Column:
    """Props, events and slots of a component, from their declarations."""
    props = F.regexp_extract_all(F.regexp_extract(content, r"defineProps(?:<\{([^}]*)\}>|\(\{([^}]*)\}\))", 1), F.lit(r"(\w+)\??\s*:"), F.lit(1))
    emits = F.regexp_extract_all(F.regexp_extract(content, r"defineEmits\(\[([^\]]*)\]\)", 1), F.lit(r"['\"]([\w:-]+)['\"]"), F.lit(1))
    slots = F.transform(F.regexp_extract_all(content, F.lit(r"<slot(?:\s+name=\"([^\"]*)\")?"), F.lit(1)), lambda s: F.when(s == "", F.lit("default")).otherwise(s))
    return F.struct(props.alias("props"), emits.alias("emits"), slots.alias("slots"))


def router_map(lines: DataFrame) -> DataFrame:
    """(file_id, line, path, component) of router entries."""
    p = r"path:\s*['\"]([^'\"]*)['\"].*?component:\s*(?:\(\)\s*=>\s*import\(['\"]([^'\"]+)['\"]\)|(\w+))"
    return lines.where(F.col("text").rlike(p)).select("file_id", "line", F.regexp_extract("text", p, 1).alias("path"), F.concat(F.regexp_extract("text", p, 2), F.regexp_extract("text", p, 3)).alias("component"))
