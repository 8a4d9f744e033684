"""Resolution of Python imports by one join with an index of modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.scalars import likely_stdlib

#: Package roots below the project, in the order in which they are tried, and what a hit there is called.
ROOTS = (("", "project"), ("src/", "project (src/)"))


def modules(files: DataFrame) -> DataFrame:
    """(key, path, package) of files (path, relative): key is the path without .py, or the directory of an __init__.py."""
    rows = files.where(F.col("path").endswith(".py")).select("path", F.regexp_replace("path", r"\.py$", "").alias("bare"))
    package = F.col("bare").rlike(r"(^|/)__init__$")
    return rows.select(F.when(package, F.regexp_replace("bare", r"/?__init__$", "")).otherwise(F.col("bare")).alias("key"), "path", package.alias("package"))


def resolved(imports: DataFrame, files: DataFrame, roots: tuple[tuple[str, str], ...] = ROOTS) -> DataFrame:
    """imports (from_file, import_path, any more) with resolved and kind.

    Leading dots go up from the file's directory. Of a module and a package of one name the module counts; the roots are tried in
    order; what no root holds is of the standard library or of a third party. A relative import that leads nowhere has nulls; so has one above
    the project, and an empty import.
    """
    keyed = imports.withColumns({"from_key": F.coalesce("from_file", F.lit("")), "import_key": F.coalesce(F.trim("import_path"), F.lit(""))})
    rows = keyed.select("from_key", "import_key").distinct()  # each import of a file is resolved once
    name = F.regexp_replace("import_key", r"^\.+", "")
    rows = rows.withColumns({"dots": F.length(F.regexp_extract("import_key", r"^(\.*)", 1)), "module": F.translate(name, ".", "/")})
    up = F.filter(F.split(F.regexp_replace("from_key", r"/?[^/]*$", ""), "/"), lambda s: s != "")
    anchor = F.slice(up, F.lit(1), F.greatest(F.size(up) - F.col("dots") + 1, F.lit(0)))
    own = F.array_join(F.filter(F.concat(anchor, F.array("module")), lambda s: s != ""), "/")
    relative = F.when(F.size(up) >= F.col("dots") - 1, F.array(F.struct(F.lit(0).alias("tier"), F.lit("relative").alias("base"), own.alias("key"))))
    absolute = F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(base).alias("base"), F.concat(F.lit(root), F.col("module")).alias("key")) for k, (root, base) in enumerate(roots)])
    asked = rows.select("*", F.explode(F.when(F.col("dots") > 0, relative).when(F.col("module") != "", absolute)).alias("c")).select("*", "c.tier", "c.base", "c.key")
    # merged: a broadcast of all modules or answers would go through the driver
    hits = asked.join(modules(files).hint("merge"), "key").where("module <> '' OR package")
    kind = F.when(F.col("module") == "", "relative package").otherwise(F.concat("base", F.when(F.col("package"), " (package)").otherwise("")))
    best = hits.groupBy("from_key", "import_key").agg(F.min(F.struct("tier", "package", "path", kind.alias("kind"))).alias("best"))
    outside = F.when(likely_stdlib(name), F.struct(F.lit("<stdlib>").alias("path"), F.lit("standard library").alias("kind"))).otherwise(F.struct(F.lit("<site-packages>").alias("path"), F.lit("third-party").alias("kind")))
    got = F.when(F.col("best").isNotNull(), F.struct(F.col("best.path").alias("path"), F.col("best.kind").alias("kind"))).when(~F.col("import_key").rlike(r"^(\.|$)"), outside)
    out = keyed.join(best.hint("merge"), ["from_key", "import_key"], "left")
    return out.select(*[F.col(f"`{c}`") for c in imports.columns], got["path"].alias("resolved"), got["kind"].alias("kind"))
