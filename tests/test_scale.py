"""What keeps queries on made files within their limits on larger tables: files dealt over tasks, lists parsed alone or together, no broadcasts of tables of files."""

import pytest

from sedimenta.operators import extract, links
from sedimenta.plans import code
from sedimenta.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.01"
RUST = "use a::b;\npub struct S { pub f: u32 }\nimpl<F: Fn(u32) -> u32> T for S<F> {\n    fn m(&self, o: Other) { g(); }\n}\n"
PYTHON = "from a import b\n\n@cached\n@reg('x')\nclass A(B):\n    n: Own\n    def m(self, c: Cart):\n        if c:\n            def inner(): return c.f(1)\n"


def tasks_with_rows(df):
    return df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count()


@pytest.mark.parametrize("name", ["decorators", "exported_items", "module_outlines", "parse_nested_symbols"])
def test_made_files_are_dealt_over_tasks(spark, name):
    """The parts lie in one small file; their files are parsed by as many tasks as the session has partitions."""
    table = code.sources(spark, SF)
    assert tasks_with_rows(table) == 4
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("language, text", [("rust", RUST), ("python", PYTHON)])
def test_one_list_is_parsed_as_with_the_others(language, text):
    pack = extract.PACKS[language]
    whole = pack.parse(text)
    for what in ("symbols", "refs", "imports", "fields", "exports", "decorators", "impls"):
        assert sorted(getattr(pack.parse(text, what), what), key=str) == sorted(getattr(whole, what), key=str)
        assert what in pack.gives or not getattr(whole, what)
    types = [r for r in pack.parse(text, "refs", "type_usage").refs if r[1] == "type_usage"]
    assert types and sorted(types) == sorted(r for r in whole.refs if r[1] == "type_usage")


def test_several_tables_of_one_pass(spark, tmp_path):
    files = spark.createDataFrame([(1, "rust", RUST), (2, "python", PYTHON), (3, "rust", None), (4, "cobol", "x")], "file_id long, language string, content string")
    got = extract.extract_tables(files, ("symbols", "refs", "imports"), str(tmp_path / "tables"))
    for what, rows in got.items():
        want = extract.extract(files, what)
        assert rows.columns == want.columns and sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) != []
    none = extract.extract_tables(files.where("file_id > 2"), ("symbols", "refs"), str(tmp_path / "none"))
    assert [rows.count() for rows in none.values()] == [0, 0]


@pytest.mark.parametrize("name", ["read_function_context", "context_bundle", "explain_module_prompt", "python_resolve_import", "workspace_members"])
def test_tables_of_files_are_not_broadcast(spark, name):
    """Spark takes tables that are exploded out of parts for as small as these; a broadcast would take them through the driver."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_routes_meet_calls_at_their_rarest_segment(spark):
    """Calls that share only a frequent first segment with a route are not compared with it; parameters on either side still match."""
    calls = spark.createDataFrame([(2, 0, "=api", k) for k in range(9)] + [(2, 1, f"=c{k % 3}", k) for k in range(6)], "n int, place int, seg string, k int")
    routes = spark.createDataFrame([("/api/c1", ["api", "c1"], 2, [(0, "=api"), (1, "=c1")]), ("/api/new", ["api", "new"], 2, [(0, "=api"), (1, "=new")])], "route string, route_s array<string>, n int, fixed array<struct<place: int, seg: string>>")
    assert sorted((r.route, r.x.held, r.x.place) for r in links.rarest_segments(routes, calls).collect()) == [("/api/c1", 2, 1), ("/api/new", 0, 1)]
    path = lambda *values: spark.createDataFrame([(v,) for v in values], "path string")
    got = links.match_routes(path("/api/c1", "/api/:id", "/:a/:b", "/x"), path("/api/c1", "/api/:id", "/:v/c1", "/api/c2", "/x/y/z", "/x")).collect()
    assert sorted((r.route, r.call) for r in got) == sorted(
        [("/api/c1", "/api/c1"), ("/api/c1", "/api/:id"), ("/api/c1", "/:v/c1"), *(("/api/:id", c) for c in ("/api/c1", "/api/:id", "/:v/c1", "/api/c2")), *(("/:a/:b", c) for c in ("/api/c1", "/api/:id", "/:v/c1", "/api/c2")), ("/x", "/x")]
    )


def test_jaccard_links_move_sets_once_a_cell(spark):
    """Copies are compared as one and stand for all; near copies move to where they are compared, not pair by pair; null and odd fields are fields."""
    import random

    draw = random.Random(5)
    base = [f"w{k} :\"\\{k}" for k in range(150)]
    near = lambda: [f for f in base if draw.random() > 0.04] + [f"x{draw.randrange(9999)}"]
    make = lambda start: [(start + k, near()) for k in range(25)] + [(start + 50 + k, base[::-1]) for k in range(10)] + [(start + 70, [None, "a", "b", "c"]), (start + 71, []), (start + 72, None), (start + 73, ["é", "a"] * 3)]
    left, right = make(0), make(1000)
    schema = "file_id long, fields array<string>"
    df = links.jaccard_links(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.85)
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = sorted((a, b, len(set(x) & set(y)), jaccard(x, y)) for a, x in left for b, y in right if x and y and jaccard(x, y) >= 0.85)
    assert sorted(map(tuple, df.collect())) == want and len(want) > 800
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("fa" in line or "fb" in line for line in joins)


@pytest.mark.parametrize("n, m, common", [(1, 1, 0), (64, 65, 60), (300, 240, 230), (128, 256, 100), (700, 700, 0)])
def test_parities_differ_in_no_more_slots_than_sets_in_fields(spark, n, m, common):
    from pyspark.sql import functions as F

    sets = spark.createDataFrame([(1, [f"f{k}" for k in range(n)]), (2, [f"f{k}" for k in range(n - common, n - common + m)])], "id long, f array<string>")
    p = sets.select("id", F.transform("f", lambda x: F.xxhash64(x)).alias("h")).mapInArrow(links._parities, "id long, n int, p array<bigint>")
    got = p.where("id = 1").select("n", F.col("p").alias("p")).crossJoin(p.where("id = 2").select(F.col("p").alias("q"))).select("n", links._differ(F.col("p"), F.col("q"))).first()
    apart = n + m - 2 * common
    assert got[0] == n and got[1] <= apart and (apart - got[1]) % 2 == 0 and got[1] > 0.3 * apart


def test_an_index_for_searches_keeps_postings_alone(spark, tmp_path):
    """Places move once, as numbers; contents are not copied; searches find what those of a whole index do, also after changes and compaction."""
    from sedimenta.index import project
    from sedimenta.plans import indexes
    from sedimenta.sources import adapters

    f = adapters.files(spark, SF).where("id % 9 = 1")
    whole, made = project.ProjectIndex(spark, f"file://{tmp_path}/a", buckets=4), project.ProjectIndex(spark, f"file://{tmp_path}/b", buckets=4, searched_only=True)
    for index in (whole, made):
        index.apply(f)
        index.apply(f.where("id % 2 = 0").withColumn("content", adapters.F.concat("content", adapters.F.lit("\nthe file"))), f.where("id % 5 = 0").select("id"))
    assert set(made.store.state()[1]["tables"]) == {"files", "postings"}
    for _ in range(2):
        assert made.keyword_topk(["the", "of", "file"], 50).collect() == whole.keyword_topk(["the", "of", "file"], 50).collect() != []
        assert sorted(made.phrase(["the", "file"]).collect()) == sorted(whole.phrase(["the", "file"]).collect()) != []
        made.compact()
    tokens = adapters.tokens(adapters.lines(f))
    plan = project.postings(tokens, 4)._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert [x.columns for x in indexes.changes(f)] == [f.columns + ["op", "seq"]] * 3
