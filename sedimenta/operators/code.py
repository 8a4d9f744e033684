"""Reading tools and language tools over the index: functions with their types and callees, types only, public items, implementations,
module paths, import aliases and context bundles. Inputs are the tables that extraction gives (see extract.SCHEMAS) and lines of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.operators.graph import BIN, in_bins

# Tables of files are exploded out of smaller ones, and Spark expects them to be as small as these; a join that says merge is never
# broadcast, which would take a whole table through the driver.

#: Beginnings of a line that declares a type, and of a doc comment.
TYPE_STARTS = ("struct ", "enum ", "interface ", "type ", "class ", "pub struct ", "pub enum ", "pub type ")
DOC_STARTS = ("///", "/**")
TYPE_KINDS = ("struct", "enum", "interface", "type")


def starts(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.startswith(w))


def within(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Each of spans (file_id, line_start, line_end, ...) with the points (file_id, line, ...) of its lines. They meet on bins of lines, a point in one."""
    p = points.withColumn("bin", F.floor(F.col("line") / BIN))
    return in_bins(spans).join(p.hint("merge"), ["file_id", "bin"]).where("line BETWEEN line_start AND line_end").drop("bin")


def types_only(lines: DataFrame, *, kind: str | None = None, docs: bool = True) -> DataFrame:
    """(file_id, line, text) of the lines of skeletons that declare types, or are doc comments; with kind, those that hold the word."""
    t = F.trim("text")
    keep = F.contains(t, F.lit(kind)) if kind else starts(t, TYPE_STARTS) | (F.lit(docs) & starts(t, DOC_STARTS))
    return lines.where(keep)


def public_lines(lines: DataFrame, language: Column) -> DataFrame:
    """Lines of Rust that begin a function or a struct stay only if they say pub; other lines and languages stay."""
    t = F.trim("text")
    private = (t.startswith("fn") | t.startswith("struct")) & ~F.contains("text", F.lit("pub"))
    return lines.where(~((language == "rust") & private))


def with_text(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """symbols with `code`, the text of their lines. Symbols meet lines of their own file only, a row for each of their lines."""
    each = symbols.withColumn("line", F.explode(F.sequence("line_start", "line_end")))
    got = each.join(lines.select("file_id", "line", "text").hint("merge"), ["file_id", "line"])
    keys = ["file_id", "name", "kind", "line_start", "line_end"]
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return got.groupBy(*keys).agg(code.alias("code"))


def referenced_types(functions: DataFrame, refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, function, line_start, type, kind, type_start): types used in a function's lines that its own file declares."""
    used = refs.where("kind = 'type_usage'").select("file_id", F.col("name").alias("type"), "line")
    f = functions.select("file_id", F.col("name").alias("function"), "line_start", "line_end")
    inside = within(f, used).select("file_id", "function", "line_start", "type").distinct()
    types = symbols.where(F.col("kind").isin(*TYPE_KINDS)).select("file_id", F.col("name").alias("type"), "kind", F.col("line_start").alias("type_start"))
    return inside.join(types.hint("merge"), ["file_id", "type"])


def function_context(functions: DataFrame, lines: DataFrame, refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """A row for each function: its code, the types of its file that it uses, the functions of its file that it calls, and the file's imports."""
    f = functions.select("file_id", F.col("name").alias("function"), "line_start", "line_end")
    code = with_text(functions, lines).select("file_id", F.col("name").alias("function"), "line_start", "code")
    types = referenced_types(functions, refs, symbols).groupBy("file_id", "function", "line_start").agg(F.array_sort(F.collect_set("type")).alias("types"))
    called = refs.where("kind = 'call'").select("file_id", F.col("name").alias("callee"), "line")
    own = symbols.where("kind IN ('function', 'method')").select("file_id", F.col("name").alias("callee")).distinct()
    calls = within(f, called.join(own.hint("merge"), ["file_id", "callee"], "left_semi")).where("callee <> function")
    calls = calls.groupBy("file_id", "function", "line_start").agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    taken = imports.groupBy("file_id").agg(F.array_sort(F.collect_set("module")).alias("imports"))
    key = ["file_id", "function", "line_start"]
    out = code.join(types.hint("merge"), key, "left").join(calls.hint("merge"), key, "left").join(taken.hint("merge"), "file_id", "left")
    empty = F.array().cast("array<string>")
    return out.select(*key, "code", *[F.coalesce(c, empty).alias(c) for c in ("types", "callees", "imports")])


def explained(structs: DataFrame, fields: DataFrame, impls: DataFrame, symbols: DataFrame) -> DataFrame:
    """A row for each struct: its fields, the traits it implements and the methods of its impl blocks in the file."""
    key = ["file_id", "name"]
    base = structs.select(*key, "line_start").distinct()
    f = fields.select("file_id", F.col("type").alias("name"), "field").groupBy(*key).agg(F.array_sort(F.collect_set("field")).alias("fields"))
    t = impls.where("trait IS NOT NULL").groupBy(*key).agg(F.array_sort(F.collect_set("trait")).alias("traits"))
    blocks = symbols.where("kind = 'impl'").select(*key, "line_start", "line_end")
    inner = symbols.where("kind IN ('function', 'method')").select("file_id", F.col("name").alias("method"), F.col("line_start").alias("line"))
    m = within(blocks, inner).groupBy(*key).agg(F.array_sort(F.collect_set("method")).alias("methods"))
    empty = F.array().cast("array<string>")
    out = base.join(f, key, "left").join(t, key, "left").join(m, key, "left")
    return out.select(*key, "line_start", *[F.coalesce(c, empty).alias(c) for c in ("fields", "traits", "methods")])


def trait_impls(impls: DataFrame, trait: Column) -> DataFrame:
    """(trait, file_id, name, line): the types that implement a trait."""
    return impls.where(F.col("trait") == trait).select("trait", "file_id", "name", "line")


def interface_impls(interfaces: DataFrame, wanted: DataFrame, methods: DataFrame) -> DataFrame:
    """(interface, type): types that have all methods of an interface. wanted: (interface, method); methods: (type, method).

    An interface starts from the types that have its rarest method, and only these are asked for its others: a method that all types
    have brings up no pair.
    """
    wanted, methods = wanted.distinct(), methods.distinct()
    held = methods.groupBy("method").agg(F.count("*").alias("types"))
    need = wanted.join(held, "method", "left").groupBy("interface").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("types", F.lit(0)).alias("types"), "method")).alias("rarest"))
    need = need.where("rarest.types > 0").join(interfaces.select("interface").distinct(), "interface", "left_semi")
    some = need.select("interface", "n", F.col("rarest.method").alias("method")).join(methods, "method").select("interface", "n", "type")
    have = some.join(wanted, "interface").join(methods, ["type", "method"], "left_semi").groupBy("interface", "type", "n").agg(F.count("*").alias("have"))
    return have.where("have = n").select("interface", "type")


def module_candidates(module: Column, root: str = "src") -> Column:
    """Files that may hold crate::a::b, the likeliest first."""
    path = F.array_join(F.filter(F.split(module, "::"), lambda x: x != "crate"), "/")
    at_root = F.array(F.lit(f"{root}/lib.rs"), F.lit(f"{root}/main.rs"))
    return F.when(path == "", at_root).otherwise(F.array(F.concat(F.lit(f"{root}/"), path, F.lit(".rs")), F.concat(F.lit(f"{root}/"), path, F.lit("/mod.rs"))))


def resolve_modules(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(module, path): the first candidate that is a file."""
    tried = modules.select("module", F.posexplode(module_candidates(F.col("module"))).alias("rank", "path"))
    found = tried.join(files.select("path"), "path")
    return found.groupBy("module").agg(F.min_by("path", "rank").alias("path"))


SCRIPTS = ("", ".ts", ".tsx", ".js", ".jsx", ".vue", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.vue")


def resolve_aliases(imports: DataFrame, configs: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, module, target): imports (file_id, path, module) by the `paths` of the nearest configuration above the file.

    configs: (directory, value), the JSON text of a tsconfig; comments are allowed. An alias is a prefix up to its star, and its
    targets are tried in order, each as it is, with an extension, or as a directory's index. Files meet configurations by their
    ancestors, candidates meet files by their path.
    """
    from sedimenta.functions.scalars import strip_json_comments

    shape = "STRUCT<compilerOptions: STRUCT<baseUrl: STRING, paths: MAP<STRING, ARRAY<STRING>>>>"
    c = configs.select("directory", F.from_json(strip_json_comments(F.col("value")), shape)["compilerOptions"].alias("o"))
    base = F.coalesce(F.regexp_replace(F.col("o.baseUrl"), r"^\./?", ""), F.lit(""))
    c = c.select("directory", base.alias("base"), F.explode("o.paths").alias("alias", "targets"))
    c = c.select("directory", F.regexp_replace("alias", r"\*$", "").alias("alias"), F.transform("targets", lambda t: F.concat_ws("/", F.nullif("directory", F.lit("")), F.nullif("base", F.lit("")), F.regexp_replace(F.regexp_replace(t, r"\*$", ""), r"^\./", ""))).alias("targets"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    asked = imports.where(~F.col("module").startswith(".")).select("file_id", "module", F.posexplode(above).alias("depth", "directory"))
    near = asked.join(configs.select("directory").distinct().hint("merge"), "directory").groupBy("file_id", "module").agg(F.max_by("directory", "depth").alias("directory"))
    fits = near.join(c.hint("merge"), "directory").where(F.col("module").startswith(F.col("alias")))
    tried = fits.select("file_id", "module", F.substr("module", F.length("alias") + 1).alias("rest"), F.length("alias").alias("long"), F.posexplode("targets").alias("t", "target"))
    tried = tried.select("file_id", "module", "long", "t", F.posexplode(F.array(*[F.concat("target", "rest", F.lit(x)) for x in SCRIPTS])).alias("e", "path"))
    found = tried.join(files.select("path", F.col("id").alias("target")).hint("merge"), "path")
    return found.groupBy("file_id", "module").agg(F.min_by("target", F.struct(-F.col("long"), "t", "e")).alias("target"))


def bundle(start: DataFrame, imports: DataFrame, files: DataFrame, skeletons: DataFrame, *, depth: int = 2) -> DataFrame:
    """(root, file_id, depth, content): a file in full and what it imports, over `depth` steps, as skeletons; each file once, at its
    smallest depth. start: (root); imports: (file_id, target), resolved."""
    edges = imports.select(F.col("file_id").alias("at"), "target").where("target IS NOT NULL").distinct()
    seen = start.select("root", F.col("root").alias("file_id"), F.lit(0).alias("depth"))
    last = seen
    for step in range(1, depth + 1):
        last = last.join(edges.hint("merge"), last["file_id"] == edges["at"]).select("root", F.col("target").alias("file_id"), F.lit(step).alias("depth")).distinct()
        seen = seen.unionByName(last)
    seen = seen.groupBy("root", "file_id").agg(F.min("depth").alias("depth"))
    whole = files.select(F.col("id").alias("file_id"), "content")
    short = skeletons.select("file_id", "skeleton")
    return seen.join(whole.hint("merge"), "file_id").join(short.hint("merge"), "file_id", "left").select("root", "file_id", "depth", F.when(F.col("depth") == 0, F.col("content")).otherwise(F.coalesce("skeleton", "content")).alias("content"))


def frameworks(content: Column, ext: Column) -> Column:
    """Which route patterns a file is worth searching for, by its extension and marks in its text."""
    script = ext.isin("ts", "tsx", "js", "jsx")
    one = [
        F.when((ext == "rs") & F.contains(content, F.lit(".route(")), "axum"),
        F.when((ext == "py") & (F.contains(content, F.lit("fastapi")) | F.contains(content, F.lit("APIRouter"))), "fastapi"),
        F.when((ext == "py") & (F.contains(content, F.lit("flask")) | F.contains(content, F.lit("Flask"))), "flask"),
        F.when(script & F.contains(content, F.lit("@Controller")), "nest"),
        F.when(script & content.rlike(r"\b(?:app|router)\.(?:get|post|put|delete|patch)\("), "express"),
    ]
    return F.array_compact(F.array(*one))


def stores(lines: DataFrame) -> DataFrame:
    """(file_id, line, name, store) of state stores declared in scripts."""
    p = r"(?:export\s+)?const\s+(\w+)\s*=\s*defineStore\(\s*['\"]([^'\"]+)['\"]"
    return lines.where(F.col("text").rlike(p)).select("file_id", "line", F.regexp_extract("text", p, 1).alias("name"), F.regexp_extract("text", p, 2).alias("store"))


def sections(content: Column, name: str) -> Column:
    """The inside of a component file's section; null without one."""
    p = rf"(?s)<{name}(?:\s[^>]*)?>\s*(.*?)\s*</{name}>"
    return F.when(content.rlike(p), F.regexp_extract(content, p, 1))


def resolved_component(uses: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, component, target): component references with the file whose stem, in kebab or Pascal case, is theirs; the shortest path."""
    from sedimenta.functions.scalars import file_stem, kebab_to_pascal

    key = lambda c: F.when(F.contains(c, F.lit("-")), kebab_to_pascal(c)).otherwise(c)
    named = files.where(F.col("path").endswith(".vue")).select(key(file_stem(F.col("path"))).alias("key"), F.struct(F.length("path").alias("n"), "path", F.col("id").alias("id")).alias("f"))
    best = named.groupBy("key").agg(F.min("f").alias("f")).select("key", F.col("f.id").alias("target"))
    return uses.withColumn("key", key(F.col("component"))).join(best, "key").select("file_id", "component", "target")


def symbol_summary(symbols: DataFrame) -> DataFrame:
    """(file_id, kinds): how many symbols of each kind a file has, as text for prompts and resources."""
    per = symbols.groupBy("file_id", "kind").agg(F.count("*").alias("n"))
    return per.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["kind"], F.lit(": "), x["n"].cast("string"))), ", ").alias("kinds"))
