"""Stored indexes: versions, plans that read only what is asked for, changes against rebuilt indexes, recall."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.index.project import ProjectIndex, ingest, postings
from sedimenta.index.store import Store
from sedimenta.index.vectors import VectorIndex, kmeans, lists_for
from sedimenta.operators import embed
from sedimenta.operators.maintain import VersionedTable
from sedimenta.sources import adapters as a

FILES = "id long, path string, content string, content_hash string, language string, domain string, size_bytes long, last_modified long"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "x1"]


def file(k, content):
    return (k, f"/p/{k}.txt", content, str(hash(content)), "en" if k % 2 else "fr", None, len(content), 100 + k)


def texts(seed, ids):
    draw = random.Random(seed)
    return [file(k, "\n".join(" ".join(draw.choices(WORDS, k=draw.randint(0, 6))) for _ in range(draw.randint(0, 5)))) for k in ids]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def same(one, two):
    """All tables of two indexes, without the segments' names."""
    for name in ("lines", "symbols", "vectors", "signals"):
        columns = sorted(c for c in one.live(name).columns if c != "seg")
        assert rows(one.live(name).select(*columns)) == rows(two.live(name).select(*columns)), name
    assert rows(one.postings(None).drop("seg")) == rows(two.postings(None).drop("seg"))
    assert rows(one.stats()) == rows(two.stats())
    assert rows(one.files().select("id", "path", "content_hash")) == rows(two.files().select("id", "path", "content_hash"))


def test_changes_equal_a_rebuilt_index(spark, tmp_path):
    """Inserts, changes, deletes and deletes by listing, then compaction: the tables of an index made at once."""
    made = ProjectIndex(spark, f"file://{tmp_path}/a", buckets=4)
    state = {}
    draw = random.Random(4)
    for turn in range(4):
        ids = draw.sample(range(3000), 12) if turn else list(range(0, 3000, 100))
        changed = texts(turn, ids)
        gone = [k for k in draw.sample(sorted(state), 5)] if turn else []
        state = {k: v for k, v in state.items() if k not in gone} | {r[0]: r for r in changed}
        table = spark.createDataFrame(changed, FILES)
        if turn == 2:
            made.apply_listing(spark.createDataFrame([(k,) for k in state], "id long"), table)
        else:
            made.apply(table, spark.createDataFrame([(k,) for k in gone], "id long"))
    fresh = ProjectIndex(spark, f"file://{tmp_path}/b", buckets=8)
    fresh.apply(spark.createDataFrame(list(state.values()), FILES))
    same(made, fresh)
    before = len(made.store.state()[1]["tables"]["lines"]["segments"])
    made.compact(now=500)
    assert before == 4 and len(made.store.state()[1]["tables"]["lines"]["segments"]) == 1
    assert made.store.clean() > 0
    same(made, fresh)
    assert made.stale(1000, 400) and not made.stale(800, 400)
    # searches against the texts
    want = sorted(((-len(hit := {w for w in ("alpha", "of") if w in r[2].split()}), -sum(r[2].split().count(w) for w in hit), k) for k, r in state.items() if {"alpha", "of"} & set(r[2].split())))[:7]
    assert [(-r.n_words, -r.n_hits, r.file_id) for r in made.keyword_topk(["alpha", "of"], 7).collect()] == want
    found = {(k, i, j + 1) for k, r in state.items() for i, line in enumerate(r[2].split("\n"), 1) for j in range(len(line.split()) - 1) if line.split()[j : j + 2] == ["the", "of"]}
    assert {tuple(r) for r in made.phrase(["the", "of"]).select("file_id", "line", "pos").collect()} == found
    assert made.keyword_topk([], 3).count() == 0 and made.keyword_topk(["absent"], 3).count() == 0


def test_only_the_terms_folders_are_read(spark, tmp_path):
    made = ProjectIndex(spark, f"file://{tmp_path}/a", buckets=16)
    made.apply(spark.createDataFrame(texts(1, range(40)), FILES))
    told = plan(made.postings(["alpha"]))
    assert "PartitionFilters: [bucket" in told.replace("isnotnull(bucket", "bucket") and "PushedFilters: [" in told and "alpha" in told
    read = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in made.postings(["alpha"]).select("term").distinct().inputFiles()}
    every = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in made.postings(None).inputFiles()}
    assert len(every) > 2 and "content" not in told
    assert spark.read.parquet(*made.postings(["alpha"]).inputFiles()).where("term = 'alpha'").count() > 0 and read <= every
    assert "Project" in plan(made.live("signals").select("path")) and "names" not in plan(made.live("signals").select("path"))


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    made = ProjectIndex(spark, f"file://{tmp_path}/a")
    table = spark.createDataFrame(texts(1, range(5)), FILES)
    assert made.apply(table, stream="s", batch=0) == 1
    assert made.apply(table, stream="s", batch=0) == 1 and made.apply(table, stream="t", batch=0) == 2
    assert made.stats().where("kind = 'language'").agg(F.sum("n")).first()[0] == 5


def test_stream_into_an_index(spark, tmp_path):
    """Micro-batches of one file of changes each; of several changes of an id in a batch the last one counts."""
    draw = random.Random(9)
    schema, log = FILES + ", op string, seq long", []
    for k in range(36):
        log.append((*texts(100 + k, [draw.randrange(9)])[0], draw.choice(["upsert", "upsert", "delete"]), k))
    for k in range(0, 36, 12):
        spark.createDataFrame(log[k : k + 12], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    made = ProjectIndex(spark, f"file://{tmp_path}/a")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest(stream(), made, f"{tmp_path}/cp").awaitTermination()
    last = {r[0]: r for r in log}
    fresh = ProjectIndex(spark, f"file://{tmp_path}/b")
    fresh.apply(spark.createDataFrame([r[:8] for r in last.values() if r[8] != "delete"], FILES))
    same(made, fresh)
    version = made.store.state()[0]
    ingest(stream(), made, f"{tmp_path}/cp2").awaitTermination()  # all batches again
    assert made.store.state()[0] == version


def test_postings_of_a_busy_term_are_blocks(spark):
    tokens = spark.range(5000).select(F.col("id").alias("file_id"), F.lit(1).alias("line"), F.lit(1).alias("pos"), F.lit("the").alias("term"))
    got = postings(tokens, 4).collect()
    assert len(got) == 5 and sum(r.n_files for r in got) == 5000 and max(r.n_files for r in got) <= 1024


def test_writers_and_broken_versions(spark, tmp_path):
    """The second writer of a version fails and the first one's rows stay; a document that does not parse is passed over."""
    store = Store(spark, f"file://{tmp_path}/s")
    number, state = store.state()
    for k in range(2):
        seg = store.new_segment()
        df = store.write("t", spark.range(k + 1).withColumn("p", F.lit(k)), seg, by=("p",))
        if k == 0:
            assert store.commit(number, state, {"t": df.drop("seg").schema}, seg, {}) == 1
        else:
            with pytest.raises(OSError):
                store.commit(number, state, {"t": df.drop("seg").schema}, seg, {})
    assert store.read("t").count() == 1
    (tmp_path / "s/_versions/2").write_text('{"tables": {')
    assert store.state()[0] == 2 and store.read("t").count() == 1
    store.commit(*store.state(), {"t": df.drop("seg").schema}, seg, {"x": 1})
    assert store.read("t").count() == 3 and json.loads((tmp_path / "s/_versions/3").read_text())["meta"] == {"x": 1}
    table = VersionedTable(spark, f"file://{tmp_path}/v")
    table.write(spark.range(3))
    table.write(spark.range(4))
    with pytest.raises(OSError):
        table.versions.put(2, {"folder": "other"})
    table.clean()
    assert table.read().count() == 4 and table.versions.numbers() == [2] and len(list((tmp_path / "v").glob("data-*"))) == 1


def test_recall_of_a_quarter_of_the_lists(spark, tmp_path):
    """Every row with an id divisible by 100 is asked for: at least 0.9 of the true ten nearest are found, and a quarter of the lists is read."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = e.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in table]), np.array([r[1] for r in table], float)
    made = VectorIndex(spark, f"file://{tmp_path}/v")
    made.build(e)
    got = {}
    for r in made.search(e.where("vec_id % 100 = 0"), 10).collect():
        got.setdefault(r.query_id, {})[r.id] = r.distance
    asked = [k for k, i in enumerate(ids) if i % 100 == 0]
    hits = 0
    for k in asked:
        d = ((x - x[k]) ** 2).sum(1)
        true = {int(ids[i]) for i in np.lexsort((ids, d))[:10]}
        found = got[int(ids[k])]
        assert len(found) == 10 and all(abs(found[i] - d[np.flatnonzero(ids == i)[0]]) < 1e-9 for i in found)
        hits += len(true & set(found))
    assert hits >= 0.9 * 10 * len(asked)
    one = made.codes([3, 5])
    assert "PartitionFilters" in plan(one) and {f.rsplit("list=", 1)[1].split("/")[0] for f in one.inputFiles()} >= {"3", "5"}
    assert one.select("list").distinct().count() == 2 and lists_for(len(ids)) == 45


def test_vector_index_changes(spark, tmp_path):
    """Rows added, replaced and removed are found or not at once; a rebuilt index finds the same; odd vectors are left out."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    frame = lambda ids, v: spark.createDataFrame([(int(i), [float(c) for c in v[i]]) for i in ids], "vec_id long, embedding array<double>")
    odd = spark.createDataFrame([(900, None), (901, [1.0]), (902, [None] * 16), (903, [float("nan")] * 16), (None, [1.0] * 16)], "vec_id long, embedding array<double>")
    made = VectorIndex(spark, f"file://{tmp_path}/v")
    made.build(frame(range(200), x).unionByName(odd))
    assert not made.outgrown()
    y = x.copy()
    y[7] = x[250] + 1e-3
    made.add(frame([*range(200, 300), 7], y))
    assert made.outgrown()
    made.remove(frame([5, 6, 999 % 300], x))
    alive = [i for i in range(300) if i not in (5, 6, 99)]
    nearest = lambda q: [i for i in sorted(alive, key=lambda i: (((y[i] - y[q]) ** 2).sum(), i))][:3]
    asked = [250, 0, 17]
    for turn in range(2):
        got = {}
        for r in made.search(frame(asked, y).unionByName(odd), 3, probed=1.0, reranked=100).orderBy("query_id", "distance", "id").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == {q: nearest(q) for q in asked}
        assert {r.id for r in made.vectors().collect()} == set(alive)
        made.rebuild()
    assert made.store.state()[1]["meta"]["built"] == len(alive) and not made.outgrown()


def test_kmeans():
    x = np.concatenate([np.zeros((50, 4)), np.ones((50, 4)) * 9]) + np.random.default_rng(1).normal(size=(100, 4)) * 0.01
    c = kmeans(x, 2)
    assert sorted(round(float(v)) for v in c[:, 0]) == [0, 9] and len(kmeans(x[:3], 10)) == 3


def test_embedders(spark):
    """Components of the int8 form differ by half a scale at most, distances by what follows from it; a cache by model never mixes."""
    from sedimenta.operators.maintain import with_cache

    counts = a.tokens(a.lines(spark.createDataFrame(texts(2, range(30)), FILES))).groupBy(F.col("file_id").alias("id"), "term").agg(F.count("*").alias("n"))
    plain = {r.id: np.array(r.vector) for r in embed.embedded(counts, "hash64").collect()}
    coarse = {r.id: np.array(r.vector) for r in embed.embedded(counts, "hash64-int8").collect()}
    assert plain.keys() == coarse.keys() and len(plain) > 15
    for i, v in plain.items():
        scale = np.abs(v).max() / 127
        assert np.abs(v - coarse[i]).max() <= scale / 2 + 1e-12
        for j, w in plain.items():
            bound = 8 * (scale + np.abs(w).max() / 127) / 2
            assert abs(np.linalg.norm(v - w) - np.linalg.norm(coarse[i] - coarse[j])) <= bound + 1e-9
    with pytest.raises(ValueError):
        embed.embedded(counts, "other")
    make = lambda model: lambda keys: embed.embedded(counts.join(keys.select("id"), "id", "left_semi"), model)
    wanted = counts.select("id").distinct()
    keyed = lambda model: wanted.withColumn("model", F.lit(model))
    cache = embed.embedded(counts.where("id < 10"), "hash64")
    of = lambda model: with_cache(wanted, cache.where(F.col("model") == model), "id", make(model))
    assert of("hash64").where("cached").count() == len([i for i in plain if i < 10]) and of("hash64-int8").where("cached").count() == 0
    assert keyed("hash64").count() == len(plain) and {r.model for r in of("hash64-int8").collect()} == {"hash64-int8"}


def test_scratch_folders(spark, tmp_path, monkeypatch):
    """Folders go when they are cleared; without a shared folder a cluster's session is refused."""
    from types import SimpleNamespace

    from sedimenta.sources import scratch

    monkeypatch.setattr(scratch, "_MADE", [])
    path = scratch.folder(spark, "x")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and scratch.clear(spark) == 1 and scratch.clear(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path)
    for master, ok in (("spark://host:7077", False), ("local-cluster[2,1,1024]", False), ("local[4]", True)):
        other = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
        if ok:
            assert scratch.folder(other, "y").startswith("file://")
        else:
            with pytest.raises(RuntimeError):
                scratch.folder(other, "y")
