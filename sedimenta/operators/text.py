"""Line search, reading, globbing, trees and text extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grep(lines: DataFrame, pattern: str, *, ignore_case: bool = False, limit: int | None = None) -> DataFrame:
    """Lines that match, in file order; ties by line. A limit is the feature's own cut (TakeOrderedAndProject)."""
    hits = lines.where(F.col("text").rlike(("(?i)" if ignore_case else "") + pattern)).select("file_id", "line", F.btrim("text").alias("text"))
    return hits if limit is None else hits.orderBy("file_id", "line").limit(limit)


def grep_context(lines: DataFrame, pattern: str, n: int = 1, *, ignore_case: bool = False) -> DataFrame:
    """Matching lines with the n lines before and after each, from one pass over each file in line order."""
    w = Window.partitionBy("file_id").orderBy("line").rowsBetween(-n, n)
    around = lines.withColumn("context", F.array_join(F.collect_list("text").over(w), "\n"))
    return around.where(F.col("text").rlike(("(?i)" if ignore_case else "") + pattern)).select("file_id", "line", "text", "context")


def read_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Per file the lines first..last (1-based, clamped) as one text, and how many lines the file has."""
    inside = F.when(F.col("line").between(first, last), F.struct("line", "text"))
    return lines.groupBy("file_id").agg(F.sort_array(F.collect_list(inside)).alias("part"), F.count("*").alias("total_lines")).select(
        "file_id", F.array_join(F.transform("part", lambda x: x["text"]), "\n").alias("content"), "total_lines"
    )


def glob_regex(glob: str) -> str:
    """A regular expression for a glob in which * crosses slashes."""
    out = ""
    for c in glob:
        out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
    return f"^{out}$"


def find_files(files: DataFrame, glob: str) -> DataFrame:
    return files.where(F.col("path").rlike(glob_regex(glob)))


def project_tree(files: DataFrame, depth: int) -> DataFrame:
    """Distinct directories and files down to a depth, with whether each is a directory."""
    parts = F.split(F.substr(F.col("path"), F.lit(2)), "/")
    level = F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth)))).alias("depth")
    steps = files.select(parts.alias("parts")).select("parts", level)
    return steps.select(F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, F.col("depth")), "/")).alias("path"), "depth", (F.col("depth") < F.size("parts")).alias("is_dir")).distinct()


NOISE = ("node_modules", "target", ".git", "dist", "build")


def list_directory(files: DataFrame, prefix: str, exclude: tuple[str, ...] = NOISE) -> DataFrame:
    """Per directory below a prefix: files and bytes."""
    keep = F.col("path").startswith(prefix)
    for x in exclude:
        keep = keep & ~F.contains("path", F.lit(x))
    return files.where(keep).groupBy(F.regexp_extract("path", "^(.*/)", 1).alias("directory")).agg(F.count("*").alias("total_files"), F.sum("size_bytes").alias("total_size"))


def docstring(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def component_names(html: Column) -> Column:
    """Tags in Pascal case or with a hyphen, in order."""
    return F.regexp_extract_all(html, F.lit(r"<([A-Z][A-Za-z0-9]*|[a-z]+-[a-z0-9-]+)"), F.lit(1))


def script_section(html: Column) -> Column:
    """The body of the first script and the line on which it begins."""
    body = F.regexp_extract(html, r"(?s)<script[^>]*>(.*?)</script>", 1)
    before = F.split_part(html, F.lit("<script"), F.lit(1))
    return F.struct(body.alias("body"), (F.length(before) - F.length(F.replace(before, F.lit("\n"))) + 1).alias("line"))


def replace_occurrence(text: Column, old: str, new: str, occurrence: int = 0) -> Column:
    """All occurrences for 0, else the n-th, 1-based; null where there are fewer."""
    if occurrence == 0:
        return F.when(F.contains(text, F.lit(old)), F.replace(text, F.lit(old), F.lit(new)))
    head = F.substring_index(text, old, occurrence)
    enough = (F.length(text) - F.length(F.replace(text, F.lit(old)))) >= len(old) * occurrence
    return F.when(enough, F.concat(head, F.lit(new), F.substr(text, F.length(head) + 1 + len(old))))
