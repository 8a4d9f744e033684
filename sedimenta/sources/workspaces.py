"""Workspaces of packages: globs from manifests, compiled to a trie of path segments that directories walk by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import folder


def patterns(manifests: DataFrame) -> DataFrame:
    """(root, pattern) from manifests (root, name, content). A pnpm-workspace.yaml takes the place of the package.json beside it."""
    lines = manifests.where("name = 'pnpm-workspace.yaml'").select("root", F.explode(F.split("content", "\n")).alias("line"))
    item = F.regexp_replace(F.trim(F.regexp_replace(F.trim("line"), "^-+", "")), "^['\"]+|['\"]+$", "")
    pnpm = lines.select("root", item.alias("pattern")).where("pattern <> '' AND pattern NOT LIKE '#%' AND pattern <> 'packages:'")
    told = manifests.where("name = 'package.json'").join(manifests.where("name = 'pnpm-workspace.yaml'").select("root").hint("merge"), "root", "left_anti")
    # a list of workspaces, or an object with packages
    listed, nested = (F.from_json(F.get_json_object("content", p), "array<string>") for p in ("$.workspaces", "$.workspaces.packages"))
    npm = told.select("root", F.explode(F.coalesce(listed, nested)).alias("pattern")).where("pattern is not null")
    return pnpm.unionByName(npm).distinct()


def trie(patterns_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, finals): edges (root, node, kind, seg, next) are literal, glob or deep; finals (root, node, negative) end a pattern.

    A node is the beginning of a pattern, so patterns that begin alike share nodes. Patterns that begin with ! take members out; they
    have nodes of their own. A deep node (after **) stays where it is for any segment.
    """
    negative = F.col("pattern").startswith("!")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"^!", ""), r"^(\./)+|^/+|/+$", ""), r"(\*\*/)+(?=\*\*(/|$))", "")
    rows = patterns_.select("root", negative.alias("negative"), F.split(clean, "/").alias("segs"))
    mark = F.when(F.col("negative"), F.lit("!")).otherwise(F.lit(""))
    node = lambda n: F.concat(mark, F.array_join(F.slice("segs", F.lit(1), n), "/"))
    steps = rows.select("*", F.posexplode("segs").alias("i", "seg"))
    kind = F.when(F.col("seg") == "**", "deep").when(F.col("seg").rlike(r"[*?\[]"), "glob").otherwise("literal")
    edges = steps.select("root", node(F.col("i")).alias("node"), kind.alias("kind"), "seg", node(F.col("i") + 1).alias("next")).distinct()
    return edges, rows.select("root", node(F.size("segs")).alias("node"), "negative").distinct()


def segment_regex(seg):
    """The regular expression of a glob segment: * and ? within it, and sets in brackets."""
    literal = F.regexp_replace(seg, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(literal, r"\[!", "[^"), r"\*", ".*"), r"\?", "."), F.lit("$"))


def members(patterns_: DataFrame, directories: DataFrame) -> DataFrame:
    """(root, directory) of the directories (root, directory; relative, without a slash at either end) that a pattern of their root names and none excludes.

    Each round takes all directories one segment further by joins on (root, node, segment) and (root, node), and writes where they are; there
    are as many rounds as the deepest directory has segments. Names with a leading dot are met by * as others are.
    """
    spark = directories.sparkSession

    def written(rows: DataFrame, name: str) -> DataFrame:
        path = folder(spark, f"workspaces-{name}")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    edges, finals = trie(patterns_)
    edges, finals = written(edges, "edges"), written(finals, "finals")
    segs = F.split("directory", "/")
    every = directories.select("root", "directory").where("directory <> ''").distinct()
    starts = edges.select("root", F.when(F.col("node").startswith("!"), "!").otherwise("").alias("node")).distinct()
    now = every.join(starts.hint("merge"), "root").select("root", "directory", "node")
    deepest = every.agg(F.max(F.size(segs))).first()[0] or 0
    # edges compress well, so that Spark takes them for small; merged, they do not go through the driver
    deep = edges.where("kind = 'deep'").select("root", "node", "next").hint("merge")
    literal = edges.where("kind = 'literal'").select("root", "node", F.col("seg").alias("here"), "next").hint("merge")
    glob = edges.where("kind = 'glob'").select("root", "node", segment_regex(F.col("seg")).alias("regex"), "next").hint("merge")
    ended = []
    for i in range(deepest + 1):
        now = now.unionByName(now.join(deep, ["root", "node"]).select("root", "directory", F.col("next").alias("node")))
        now = written(now.distinct(), "round")
        ended.append(now.where(F.size(segs) == i))
        if i < deepest:
            here = now.where(F.size(segs) > i).withColumn("here", F.get(segs, F.lit(i)))
            by_name = here.join(literal, ["root", "node", "here"]).select("root", "directory", F.col("next").alias("node"))
            by_glob = here.join(glob, ["root", "node"]).where(F.regexp_like("here", F.col("regex"))).select("root", "directory", F.col("next").alias("node"))
            stay = here.where(F.col("node").rlike(r"(^!?|/)\*\*$")).select("root", "directory", "node")
            now = by_name.unionByName(by_glob).unionByName(stay)
    found = ended[0]
    for e in ended[1:]:
        found = found.unionByName(e)
    found = found.join(finals.hint("merge"), ["root", "node"]).groupBy("root", "directory").agg(F.bool_or("negative").alias("out"))
    return found.where("not out").select("root", "directory")
