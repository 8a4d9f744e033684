"""File sources, streams with state, sketches, workspaces and imports against plain versions."""

import datetime as dt
import fnmatch
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringEndsWith, StringStartsWith

from sedimenta.operators import code, extract, links, py_imports, sketches
from sedimenta.sources import corpus, files, workspaces
from sedimenta.streaming import ttl


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "r"
    made = {"a.py": "x", "src/b.rs": "é", "src/deep/c/d.ts": "t", "src/deep/e.lock": "l", "src/big.py": "y" * 200, ".hid/f.py": "h", "gen/g.py": "g", "gen/keep.py": "k", "doc/readme.md": "m", "target/x.rs": "z"}
    for path, text in made.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_files_source(spark, tree):
    files.register(spark)
    load = lambda: spark.read.format("corpus-files").option("root", f"file://{tree}").option("ignore", "gen/*\n!gen/keep.py").option("largest", "100").load()
    got = {r.path: (r.content, r.language, r.size_bytes) for r in load().collect()}
    assert got == {"a.py": ("x", "python", 1), "src/b.rs": ("é", "rust", 2), "src/deep/c/d.ts": ("t", "typescript", 1), "gen/keep.py": ("k", "python", 1)}
    # what the scan of listed files gives, too
    assert {tuple(r) for r in load().select("path", "content_hash").collect()} == {tuple(r) for r in corpus.scan(spark, str(tree), ["gen/*", "!gen/keep.py"], largest=100).select("path", "content_hash").collect()}
    assert [r.path for r in load().where("path LIKE 'src/%' AND language = 'rust'").collect()] == ["src/b.rs"]
    assert load().where("path = 'a.py'").count() == 1 and load().where("path LIKE 'none%'").count() == 0


def test_filters_prune_directories(tree):
    reader = files.FilesReader({"root": str(tree)})
    every = {p.directory for p in reader.partitions()}
    other = StringEndsWith(("path",), ".rs")
    assert list(reader.pushFilters([StringStartsWith(("path",), "src/deep/"), EqualTo(("language",), "typescript"), other])) == [other]
    pruned = {p.directory for p in reader.partitions()}
    assert {"src", "gen", "doc"} <= every and "src/deep" in pruned and not {"gen", "doc", "target"} & pruned
    rows = [p for b in map(reader.read, reader.partitions()) for batch in b for p in batch.column("path").to_pylist()]
    assert rows == ["src/deep/c/d.ts"]


def test_changes_source(spark, tmp_path):
    """Lists that come later are read by the next run, those read before are not; offsets give the same batch again."""
    files.register(spark)
    root, out, checkpoint = (tmp_path / x for x in ("lists", "out", "cp"))
    root.mkdir()

    def put(number, *rows):
        (root / f"{number}.jsonl").write_text("".join(json.dumps(dict(zip(("path", "op", "content"), r))) + "\n" for r in rows))

    def run():
        stream = spark.readStream.format("corpus-changes").option("root", f"file://{root}").load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out)).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(str(out)).select("path", "op", "seq").collect()))

    put(1, ("a", "upsert", "x"), ("b", "upsert", "y"))
    put(3, ("a", "delete", None))
    first = run()
    assert first == [("a", "delete", 3_000_000), ("a", "upsert", 1_000_000), ("b", "upsert", 1_000_001)]
    put(10, ("c", "upsert", "z"))
    assert run() == sorted([*first, ("c", "upsert", 10_000_000)])
    reader = files.ChangesReader({"root": str(root)})
    assert [p.number for p in reader.partitions({"list": 1}, {"list": 10})] == [3, 10] and reader.latestOffset() == {"list": 10}


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{k % 3}/{k}.py", "é" * k) for k in range(20)], "path string, content string").repartition(3)
    assert files.write_files(rows, str(tmp_path / "w")) == 20
    assert sum(len(names) for _, _, names in os.walk(tmp_path / "w")) == 20 and (tmp_path / "w/d1/4.py").read_text() == "é" * 4


def plain_cache(lookups, ttl_seconds):
    made, hits = {}, {}
    for key, id_, at in sorted(lookups, key=lambda x: (x[0], x[2], x[1])):
        hits[id_] = key in made and at < made[key] + dt.timedelta(seconds=ttl_seconds)
        if not hits[id_]:
            made[key] = at
    return hits


def test_cache_over_runs(spark, tmp_path):
    """A stream that is stopped and started again equals one pass over all lookups; entries run out by event time."""
    draw = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(f"k{draw.randrange(6)}", k, start + dt.timedelta(seconds=k * 40 + draw.randrange(30))) for k in range(120)]
    schema = "key string, id long, ts timestamp"
    for k in range(0, 120, 40):
        spark.createDataFrame(rows[k : k + 40], schema).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        ttl.run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", 600)
    got = {r.id: r.hit for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == plain_cache(rows, 600) and 0 < sum(got.values()) < 120


def test_sketches(spark):
    """Any roll-up of stored daily sketches is near the exact values, and merging by days changes counts in nothing."""
    rows = spark.range(40_000).select(
        (F.col("id") % 4).alias("tool"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("user"), (F.pmod(F.xxhash64(F.col("id") + 1), F.lit(10_000)) / 10).alias("ms"),
        F.concat(F.lit("l"), F.least(F.pmod(F.xxhash64(F.col("id") + 2), F.lit(40)), F.lit(12))).alias("label"),
    )
    day = sketches.daily(rows, ["tool"], time="ts", item="user", value="ms", label="label")
    assert day.count() > 20
    for by in (["tool"], ["day"], []):
        got = {tuple(r[c] for c in by): r for r in sketches.rolled(day, by).collect()}
        exact = rows.withColumn("day", F.to_date("ts")).groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"), F.percentile("ms", F.array(F.lit(0.47), F.lit(0.53), F.lit(0.87), F.lit(0.93))).alias("q"))
        for r in exact.collect():
            s = got[tuple(r[c] for c in by)]
            assert s.n == r.n and abs(s.distinct - r.users) <= 0.06 * r.users
            assert r.q[0] <= s.quantiles[0] <= r.q[1] and r.q[2] <= s.quantiles[1] <= r.q[3]
    top = sketches.rolled(day, []).first().top
    assert [x.item for x in top][:1] == ["l12"] and top[0]["count"] == rows.where("label = 'l12'").count()


def globbed(pattern, directory):
    """Whether a pattern meets a directory, segment by segment."""

    def go(p, d):
        if not p:
            return not d
        if p[0] == "**":
            return go(p[1:], d) or bool(d) and go(p, d[1:])
        return bool(d) and fnmatch.fnmatchcase(d[0], p[0]) and go(p[1:], d[1:])

    return go(pattern.strip("/").split("/"), directory.split("/"))


def test_workspaces(spark):
    draw = random.Random(6)
    names = ["a", "b", "ab", "packages", "x.y", "t"]
    directories = sorted({(f"r{draw.randrange(3)}", "/".join(draw.choices(names, k=draw.randint(1, 4)))) for _ in range(120)})
    patterns = [("r0", p) for p in ("packages/*", "a/**", "**/t", "!**/ab", "?")] + [("r1", p) for p in ("**", "!a/**", "!*/b")] + [("r2", p) for p in ("x.y/[ab]", "a*/**/t", "./b/", "**/**/packages")]
    got = {tuple(r) for r in workspaces.members(spark.createDataFrame(patterns, "root string, pattern string"), spark.createDataFrame(directories, "root string, directory string")).collect()}
    want = set()
    for root, d in directories:
        mine = [p for r, p in patterns if r == root]
        named = any(globbed(p.removeprefix("./"), d) for p in mine if p[0] != "!")
        if named and not any(globbed(p[1:], d) for p in mine if p[0] == "!"):
            want.add((root, d))
    assert got == want and len(want) > 10
    manifests = spark.createDataFrame([("a", "pnpm-workspace.yaml", "packages:\n  - 'p/*'\n  - \"!q\"\n# no\n"), ("a", "package.json", '{"workspaces": ["z"]}'), ("b", "package.json", '{"workspaces": {"packages": ["u", "v/*"]}}'), ("c", "package.json", "{}"), ("d", "package.json", "broken")], "root string, name string, content string")
    assert {tuple(r) for r in workspaces.patterns(manifests).collect()} == {("a", "p/*"), ("a", "!q"), ("b", "u"), ("b", "v/*")}


def test_python_imports(spark):
    tree_ = ["app/__init__.py", "app/core.py", "app/core/__init__.py", "app/api/v1.py", "app/api/__init__.py", "src/lib/__init__.py", "src/app/core.py", "main.py"]
    asked = [
        ("app/api/v1.py", "..core", "app/core.py", "relative"), ("app/api/v1.py", ".", "app/api/__init__.py", "relative package"), ("main.py", ".app", "app/__init__.py", "relative (package)"), ("main.py", "..app", None, None),
        ("app/api/v1.py", "app.core", "app/core.py", "project"), ("main.py", "lib", "src/lib/__init__.py", "project (src/) (package)"), ("main.py", " os.path ", "<stdlib>", "standard library"), ("main.py", "requests", "<site-packages>", "third-party"),
        ("main.py", "", None, None), ("main.py", None, None, None), (None, "app.core", "app/core.py", "project"), ("main.py", ".", None, None),
    ]
    rows = spark.createDataFrame([(f, i, k) for k, (f, i, *_) in enumerate(asked)], "from_file string, import_path string, `a.b` int").repartition(3)
    got = {r["a.b"]: (r.resolved, r.kind) for r in py_imports.resolved(rows, spark.createDataFrame([(p,) for p in tree_], "path string")).collect()}
    assert got == {k: (a, b) for k, (_, _, a, b) in enumerate(asked)}


def test_routes_by_fixed_segments(spark):
    draw = random.Random(11)
    path = lambda: "/" + "/".join(draw.choice(["api", "v1", "users", ":id", "{x}", "7"]) for _ in range(draw.randint(0, 4)))
    routes, calls = [path() for _ in range(60)] + ["/:a/:b"], [path() for _ in range(60)]
    is_p = lambda s: s[:1] in (":", "{")
    split = lambda p: [s for s in p.split("/") if s]
    want = {(r, c) for r in routes for c in calls if len(split(r)) == len(split(c)) and all(a == b or is_p(a) or is_p(b) for a, b in zip(split(r), split(c)))}
    frame = lambda ps: spark.createDataFrame([(p,) for p in ps], "path string")
    got = [tuple(r) for r in links.match_routes(frame(routes), frame(calls)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_interfaces_by_rarest_method(spark):
    wanted = [("I", "new"), ("I", "rare"), ("J", "new"), ("K", "none"), ("K", "new")]
    methods = [(f"T{k}", "new") for k in range(50)] + [("T3", "rare"), ("T3", "rare"), ("U", "rare")]
    frame = lambda rows, a, b: spark.createDataFrame(rows, f"{a} string, {b} string")
    w = frame(wanted, "interface", "method")
    got = {tuple(r) for r in code.interface_impls(w.select("interface"), w, frame(methods, "type", "method")).collect()}
    assert got == {("I", "T3")} | {("J", f"T{k}") for k in range(50)}


def test_points_within_spans(spark):
    draw = random.Random(3)
    spans = [(draw.randrange(3), a := draw.randrange(1, 400), a + draw.randrange(0, 300), f"f{k}") for k in range(40)]
    points = [(draw.randrange(3), draw.randrange(1, 700), k) for k in range(80)]
    got = [(r.name, r.k) for r in code.within(spark.createDataFrame(spans, "file_id int, line_start int, line_end int, name string"), spark.createDataFrame(points, "file_id int, line int, k int")).collect()]
    want = sorted((n, k) for f, a, b, n in spans for g, line, k in points if f == g and a <= line <= b)
    assert sorted(got) == want


def calls(pack, text):
    return [name for name, kind, _ in pack.parse(text).refs if kind == "call"]


def test_declared_names_are_no_calls():
    ts = "class A {\n  foo(x: number): void {\n    bar(x);\n  }\n  static async *gen(f: (a: number) => void) {\n    if (baz(1)) { qux(2); }\n  }\n}\nnamespace N { function q() { run(); } }\n"
    assert calls(extract.TYPESCRIPT, ts) == ["bar", "baz", "qux", "run"]
    assert calls(extract.GO, "package p\ntype I interface {\n\tM() int\n}\nfunc f() {\n\tif g(1) {\n\t\th()\n\t}\n}\n") == ["g", "h"]
    assert calls(extract.RUST, "#[derive(Debug)]\npub fn a() { if b(1) { c(); } }\n") == ["b", "c"]
