"""Upserts, as-of joins, breakers and language tools against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import scalars as sc
from sedimenta.operators import code, extract, graph, maintain, routes, search
from sedimenta.streaming import windows


def test_merge_keeps_null_keys_and_takes_one_row_a_key(spark):
    schema = "k string, v int"
    old = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], schema)
    new = spark.createDataFrame([("a", 5), ("a", 9), (None, 7), ("d", 4)], schema)
    want = [("a", 9), (None, 7), ("c", 3), ("d", 4)]
    assert sorted(map(tuple, maintain.merge(old, new, ["k"]).collect()), key=str) == sorted(want, key=str)
    got = maintain.merge(old, new, ["k"], {"v": F.greatest("old.v", "new.v")}).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    gone = maintain.merge(old, new.where("false"), ["k"], {"v": F.greatest("old.v", "new.v")}).collect()
    assert sorted(map(tuple, gone), key=str) == sorted([("a", 1), (None, 2), ("c", 3)], key=str)


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_asof_model(spark, width):
    rng = random.Random(width)
    hunks = [(rng.randrange(4), rng.randrange(60), rng.randrange(100)) for _ in range(40)] + [(1, 3, None)]
    probes = [(k, n, f"p{k}.{n}") for k in range(5) for n in range(0, 70, 3)]
    got = graph.asof(spark.createDataFrame(probes, "k int, at int, name string"), spark.createDataFrame(hunks, "k int, start int, v int"), "k", "at", "start", "v", bucket=lambda o: F.floor(o / width))
    want = {}
    for k, n, name in probes:
        before = [(s, v) for key, s, v in hunks if key == k and s <= n and v is not None]
        want[name] = max(before)[1] if before else None
    assert {r["name"]: r["v"] for r in got.collect()} == want and got.count() == len(probes)


def test_breaker_model(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("ab"), 0.0, rng.random() < 0.3, k * 4_000) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, tool_name string, latency_ms double, success boolean, t long").withColumn("created_at", F.timestamp_seconds("t"))
    want, run = {}, {"a": 0, "b": 0}
    for k, tool, _, success, _ in rows:
        run[tool] = 0 if success else run[tool] + 1
        want[k] = (run[tool], run[tool] >= 5)
    assert {r.id: (r.failures_in_row, r.open) for r in windows.breaker(df, 5).collect()} == want


def test_queue_moves(spark):
    q = spark.createDataFrame([(1, 5, "pending", 1), (2, 9, "pending", 2), (3, 1, "completed", 3)], "file_id long, priority int, status string, created_at int")
    now = maintain.moved(q, maintain.popped(q, 1), "processing")
    assert {r.file_id: r.status for r in now.collect()} == {1: "pending", 2: "processing", 3: "completed"}
    assert {r.file_id: r.status for r in maintain.moved(now, q.where("file_id >= 2"), "failed").collect()} == {1: "pending", 2: "failed", 3: "completed"}


def test_at_once_keeps_order_and_errors():
    def bad():
        raise ValueError("no")

    got = maintain.at_once([("a", lambda: 1), ("b", bad), ("c", lambda: 3)], parallel=2)
    assert got == [("a", 1, None), ("b", None, "no"), ("c", 3, None)]
    assert maintain.at_once([("b", bad), ("c", lambda: 3)], parallel=1, stop=True)[1][1] is None
    with pytest.raises(ValueError):
        maintain.at_once([("x", bad)] * 101)


def test_truncate_utf8(spark):
    texts = ["", "abc", "aé" * 5, "中" * 4, "😀" * 3, "a😀b", "x" * 12]
    for n in range(4, 12):
        got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sc.truncate_utf8(F.col("t"), n)).collect()]
        assert got == [t.encode()[:n].decode(errors="ignore") for t in texts], n


def test_change_types(spark):
    cases = {
        "test": (["src/a.rs", "src/spec_b.rs"], ["added", "modified"], 1, 1), "docs": (["docs/x"], ["modified"], 1, 1), "chore": ([".github/workflows/ci.yml"], ["modified"], 1, 1), "ci": (["Dockerfile"], ["added"], 1, 1),
        "feat": (["src/a.rs"], ["added"], 10, 1), "fix": (["src/a.rs"], ["modified"], 10, 1),
    }
    for want, (paths, statuses, added, gone) in cases.items():
        row = spark.createDataFrame([(paths, statuses, added, gone)], "p array<string>, s array<string>, a int, d int")
        assert row.select(sc.change_type(F.col("p"), F.col("s"), F.col("a"), F.col("d"))).first()[0] == want
    row = spark.createDataFrame([(["a"], ["added"], 1, 3), (["a", "b", "c", "d"], ["modified"] * 4, 60, 3)], "p array<string>, s array<string>, a int, d int")
    assert {r[0] for r in row.select(sc.change_type(F.col("p"), F.col("s"), F.col("a"), F.col("d"))).collect()} == {"refactor"}


def test_generic_heads():
    rust = "unsafe impl<'a, F: Fn(A<'a>) -> Vec<B>> my::Trait<F> for &'a other::Type<F> where F: Send { fn f() {} }\nimpl Plain { }\n"
    got = extract.PACKS["rust"].parse(rust)
    assert [(n, t) for n, t, _ in got.impls] == [("Type", "Trait"), ("Plain", None)]
    ts = "export const f = <T,>(\n  a: (x: number) => void,\n  b = g(1),\n): Promise<Row> => {\n  return 1;\n};\nconst notOne = (1 + 2);\nlet h = async (x) => x;\n"
    got = extract.PACKS["typescript"].parse(ts)
    assert [(s[0], s[2], s[3]) for s in got.symbols] == [("f", 1, 6), ("h", 8, 8)]


def test_aliases_prefer_the_nearest_configuration(spark):
    files = spark.createDataFrame([(1, "app/a.ts"), (2, "src/m.ts"), (3, "app/src/m.ts"), (4, "app/src/ui/index.vue")], "id long, path string")
    configs = spark.createDataFrame([("", '{"compilerOptions":{"paths":{"@/*":["src/*"]}}}'), ("app", '{"compilerOptions":{"baseUrl":"./src","paths":{"@/*":["*"]}}}')], "directory string, value string")
    imports = spark.createDataFrame([(1, "app/a.ts", "@/m"), (1, "app/a.ts", "@/ui"), (1, "app/a.ts", "react"), (2, "src/m.ts", "@/m")], "file_id long, path string, module string")
    assert {tuple(r) for r in code.resolve_aliases(imports, configs, files).collect()} == {(1, "@/m", 3), (1, "@/ui", 4), (2, "@/m", 2)}


def test_sides_without_a_winner(spark):
    t = spark.createDataFrame([("import x from 'react'\nimport e from 'express'",), ("",), (None,)], "t string")
    assert [r[0] for r in t.select(routes.domain_by_imports(F.col("t"), F.lit("ts"))).collect()] == ["unknown"] * 3


def test_declared_names(spark):
    texts = ["def f(x):", "export function load(a, b) {", "let x\nconst y = 1", "pub(crate) fn go<T>(t: T)", "class A:", "enum Kind {", "nothing", "a\nb\nc\nd\ne\ndef late():"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(search.declared_name(F.col("t"))).collect()] == ["f", "load", "y", "go", None, "Kind", None, None]
