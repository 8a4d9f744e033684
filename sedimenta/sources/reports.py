"""Captured tool outputs and manifests as tables: compiler and linter reports, history, dependencies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = "STRUCT<file_name: STRING, line_start: INT, column_start: INT, is_primary: BOOLEAN>"
CARGO = f"STRUCT<reason: STRING, message: STRUCT<level: STRING, message: STRING, code: STRUCT<code: STRING>, spans: ARRAY<{SPAN}>, children: ARRAY<STRUCT<level: STRING, message: STRING>>>>"
DIAGNOSTIC = ("file_path", "line", "column", "severity", "code", "message", "suggestion")


def cargo(lines: DataFrame) -> DataFrame:
    """Compiler messages in JSON lines (column value): errors and warnings at their primary span, with the first help or note."""
    m = lines.select(F.from_json("value", CARGO).alias("j")).where("j.reason = 'compiler-message'").select("j.message.*")
    span = F.get(F.filter("spans", lambda s: s["is_primary"]), F.lit(0))
    hint = F.get(F.filter("children", lambda c: c["level"].isin("help", "note")), F.lit(0))["message"]
    rows = m.where(F.col("level").isin("error", "warning")).select(span.alias("s"), "level", F.col("code.code").alias("code"), "message", hint.alias("suggestion"))
    return rows.where("s is not null").select(F.col("s.file_name").alias("file_path"), F.col("s.line_start").alias("line"), F.col("s.column_start").alias("column"), F.col("level").alias("severity"), "code", "message", "suggestion")


def tsc(lines: DataFrame) -> DataFrame:
    """file(line,col): severity TSnnnn: message."""
    pattern = r"^(.+?)\((\d+),(\d+)\):\s+(error|warning)\s+(TS\d+):\s+(.*)$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    rows = lines.where(F.col("value").rlike(pattern))
    return rows.select(part(1).alias("file_path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"), part(4).alias("severity"), part(5).alias("code"), part(6).alias("message"), F.lit(None).cast("string").alias("suggestion"))


def ruff(documents: DataFrame) -> DataFrame:
    schema = "ARRAY<STRUCT<filename: STRING, code: STRING, message: STRING, location: STRUCT<row: INT, `column`: INT>, fix: STRUCT<message: STRING>>>"
    x = documents.select(F.explode(F.from_json("value", schema)).alias("x"))
    return x.select(F.col("x.filename").alias("file_path"), F.col("x.location.row").alias("line"), F.col("x.location.column").alias("column"), F.lit("warning").alias("severity"), F.col("x.code").alias("code"), F.col("x.message").alias("message"), F.col("x.fix.message").alias("suggestion"))


def eslint(documents: DataFrame) -> DataFrame:
    schema = "ARRAY<STRUCT<filePath: STRING, messages: ARRAY<STRUCT<ruleId: STRING, severity: INT, message: STRING, line: INT, `column`: INT>>>>"
    x = documents.select(F.explode(F.from_json("value", schema)).alias("f")).select("f.filePath", F.explode("f.messages").alias("m"))
    severity = F.when(F.col("m.severity") == 2, "error").otherwise("warning")
    return x.select(F.col("filePath").alias("file_path"), F.col("m.line").alias("line"), F.col("m.column").alias("column"), severity.alias("severity"), F.col("m.ruleId").alias("code"), F.col("m.message").alias("message"), F.lit(None).cast("string").alias("suggestion"))


def history(logs: DataFrame) -> DataFrame:
    """(repo, commit_id, author, ts, message, file) from whole outputs (repo, value) of git log --name-only --format='%x00%H%x01%an%x01%at%x01%s'."""
    commits = logs.select("repo", F.explode(F.split("value", "\0")).alias("c")).where("c <> ''")
    rows = commits.select("repo", F.split("c", "\n").alias("l")).select("repo", F.split(F.col("l")[0], "\x01").alias("h"), F.expr("slice(l, 2, size(l))").alias("files"))
    head = rows.select("repo", F.col("h")[0].alias("commit_id"), F.col("h")[1].alias("author"), F.timestamp_seconds(F.col("h")[2].cast("long")).alias("ts"), F.col("h")[3].alias("message"), F.explode("files").alias("file"))
    return head.where("file <> ''")


def blame(documents: DataFrame) -> DataFrame:
    """(file, line, commit_id, author) from whole outputs (file, value) of git blame --line-porcelain."""
    rows = documents.select("file", F.posexplode(F.split("value", "\n")).alias("p", "t"))
    w = Window.partitionBy("file").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    head, author = r"^([0-9a-f]{40}) \d+ (\d+)", r"^author (.*)$"
    rows = rows.withColumns({
        "commit_id": F.last(F.when(F.col("t").rlike(head), F.regexp_extract("t", head, 1)), True).over(w),
        "line": F.last(F.when(F.col("t").rlike(head), F.regexp_extract("t", head, 2).cast("int")), True).over(w),
        "author": F.last(F.when(F.col("t").rlike(author), F.regexp_extract("t", author, 1)), True).over(w),
    })
    return rows.where(F.col("t").startswith("\t")).select("file", "line", "commit_id", "author")


def diff(documents: DataFrame) -> DataFrame:
    """(id, file, added, deleted) from unified diffs (id, value): each line belongs to the last file header before it."""
    rows = documents.select("id", F.posexplode(F.split("value", "\n")).alias("p", "t"))
    w = Window.partitionBy("id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    header = r"^\+\+\+ (?:b/)?(.*)$"
    rows = rows.withColumn("file", F.last(F.when(F.col("t").rlike(header), F.regexp_extract("t", header, 1)), True).over(w))
    rows = rows.where("file is not null")
    added, gone = F.col("t").rlike(r"^\+(?!\+\+ )"), F.col("t").rlike(r"^-(?!-- )")
    return rows.groupBy("id", "file").agg(F.count_if(added).alias("added"), F.count_if(gone).alias("deleted"))


def prometheus(metrics: DataFrame, prefix: str = "sedimenta") -> DataFrame:
    """Text exposition lines of (name, value)."""
    return metrics.select(F.format_string(f"# TYPE {prefix}_%s counter\n{prefix}_%s %d", "name", "name", F.col("value").cast("long")).alias("value"))


def npm(documents: DataFrame) -> DataFrame:
    """(path, name, version, dev) from package.json texts (path, value)."""
    j = documents.select("path", F.from_json("value", "STRUCT<dependencies: MAP<STRING, STRING>, devDependencies: MAP<STRING, STRING>>").alias("j"))
    one = lambda field, dev: j.select("path", F.explode(f"j.{field}").alias("name", "version"), F.lit(dev).alias("dev"))
    return one("dependencies", False).unionByName(one("devDependencies", True))


def toml_manifests(documents: DataFrame) -> DataFrame:
    """(path, name, version, dev) from Cargo.toml, pyproject.toml (PEP 621 and poetry) and Pipfile texts (path, value); bad ones give none."""

    def rows_of(path: str, text: str) -> list[tuple]:
        import tomllib

        try:
            t = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            return []
        plain = lambda v: v if isinstance(v, str) else v.get("version", "*") if isinstance(v, dict) else "*"
        poetry = t.get("tool", {}).get("poetry", {})
        out = []
        for table, dev in ((t.get("dependencies"), False), (t.get("dev-dependencies"), True), (t.get("packages"), False), (t.get("dev-packages"), True), (poetry.get("dependencies"), False), (poetry.get("dev-dependencies"), True)):
            if isinstance(table, dict):
                out += [(path, n, plain(v), dev) for n, v in table.items() if n != "python"]
        for spec in t.get("project", {}).get("dependencies", []):
            m = re.match(r"\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*([^;]*)", spec)
            out.append((path, m.group(1), m.group(2).strip() or "*", False))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, v in zip(b["path"], b["value"]) for r in rows_of(p, v)], columns=["path", "name", "version", "dev"])

    return documents.select("path", "value").mapInPandas(run, "path string, name string, version string, dev boolean")


def go_mod(documents: DataFrame) -> DataFrame:
    """(path, name, version) from go.mod texts: lines of require blocks and single requires."""
    line = documents.select("path", F.explode(F.split("value", "\n")).alias("l"))
    pattern = r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+(v\S+)"
    return line.where(F.col("l").rlike(pattern) & ~F.col("l").rlike("^\\s*(?:module|replace|exclude)")).select("path", F.regexp_extract("l", pattern, 1).alias("name"), F.regexp_extract("l", pattern, 2).alias("version"))


def subprojects(files: DataFrame) -> DataFrame:
    """Directories below the root that hold a manifest: (path, kind)."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name == "Cargo.toml", "rust").when(name == "package.json", "node").when(name.isin("pyproject.toml", "requirements.txt"), "python").when(name == "go.mod", "go")
    rows = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"), kind.alias("kind"))
    return rows.where("kind is not null and path <> ''").where(~F.col("path").rlike("(^|/)(node_modules|target|dist|build)(/|$)")).distinct()
