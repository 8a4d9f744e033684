"""Corpus scans with ignore rules and change detection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.extract import EXTENSIONS

LARGEST = 2 * 1024 * 1024
#: Always ignored.
ALWAYS = (".git/", "node_modules/", "target/", "dist/", "build/", "*.lock")


def ignore_regex(pattern: str) -> tuple[bool, str]:
    """(whether it takes files back in, regular expression on a relative path) of one line of an ignore file."""
    back = pattern.startswith("!")
    p = pattern[1:] if back else pattern
    only_dirs = p.endswith("/")
    p = p.rstrip("/")
    rooted = p.startswith("/") or "/" in p
    p = p.lstrip("/")
    out, k = "", 0
    while k < len(p):
        if p.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif p.startswith("**", k):
            out, k = out + ".*", k + 2
        elif p[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif p[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(p[k]), k + 1
    return back, ("^" if rooted else "(?:^|/)") + out + ("/" if only_dirs else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """The last pattern that fits decides."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip()
        if line and not line.startswith("#"):
            back, regex = ignore_regex(line)
            out = F.when(path.rlike(regex), F.lit(not back)).otherwise(out)
    return out


def language(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.lit(None).cast("string")
    for e, name in EXTENSIONS.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, *, largest: int = LARGEST) -> DataFrame:
    """(path, content, content_hash, last_modified, size_bytes, language) of the indexable files below root.

    Paths are relative. Hidden files, ignored ones, other extensions and files over `largest` bytes are left out before any content is read,
    since path and length are columns of the file listing.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(prefix) + "/", "")
    rows = base.withColumn("rel", rel).where((F.col("length") <= largest) & language(F.col("rel")).isNotNull() & ~F.col("rel").rlike(r"(^|/)\.") & ~ignored(F.col("rel"), [*ALWAYS, *(patterns or [])]))
    content = F.decode("content", "UTF-8")
    return rows.select(F.col("rel").alias("path"), content.alias("content"), F.sha2(F.col("content"), 256).alias("content_hash"), F.unix_timestamp("modificationTime").alias("last_modified"), F.col("length").alias("size_bytes"), language(F.col("rel")).alias("language"))


def changes(scanned: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(path, op): upsert where a file is new or its time and hash both differ, delete where it is gone."""
    if stored is None:
        return scanned.select("path", F.lit("upsert").alias("op"))
    s = stored.select("path", F.col("last_modified").alias("t"), F.col("content_hash").alias("h"))
    both = scanned.select("path", "last_modified", "content_hash").join(s, "path", "full_outer")
    op = F.when(F.col("content_hash").isNull(), "delete").when(F.col("h").isNull() | ((F.col("last_modified") != F.col("t")) & (F.col("content_hash") != F.col("h"))), "upsert")
    return both.select("path", op.alias("op")).where("op is not null")
