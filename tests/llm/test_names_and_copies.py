"""Columns of the caller that are named like an operator's own, and copies of one document."""

import pytest

pytest.importorskip("sedimenta.llm")
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from sedimenta.llm import mixing, packing, quality  # noqa: E402

SF = "/root/testdata/sf0.001"
CLASHES = ("q_words", "q_kept", "Q__x", "mix_size", "mix_note", "rate", "target", "k", "n", "cell", "row", "pii", "pii_spans", "a.b")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    return rows.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])


def kept(rows):
    """Whether each row still has the values that it came with."""
    told = rows.select("doc_id", *[F.col(f"`{c}`") for c in CLASHES]).collect()
    assert told and all(r[k + 1] == f"{c}:{r[0]}" for r in told for k, c in enumerate(CLASHES))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_leave_other_columns(spark, docs, stage):
    """Columns named like the operators' own come out of every stage as they went in, with the rows of a table without them."""
    out = stage[1](spark, docs, SF)
    assert out.columns == docs.columns
    kept(out)
    plain = stage[1](spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), SF)
    columns = ["doc_id", "text", "n_chars"]
    assert sorted(map(tuple, out.select(columns).collect()), key=str) == sorted(map(tuple, plain.select(columns).collect()), key=str)


def test_operators_with_clashing_names(spark, docs):
    p = quality.prefix_of(docs)
    rules = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    judged = quality.judge(docs, rules)
    plain = quality.judge(docs.select("doc_id", "text"), rules)
    kept(judged)
    assert sorted(judged.select("doc_id", f"{p}n_words", f"{p}kept", f"{p}rule").collect()) == sorted(plain.select("doc_id", "q_n_words", "q_kept", "q_rule").collect())
    m = mixing.prefix_of(docs)
    mixed = mixing.mix(docs)
    kept(mixed)
    assert sorted(mixed.select("doc_id", f"{m}copies").collect()) == sorted(mixing.mix(docs.select("doc_id", "text", "source")).select("doc_id", "mix_copies").collect())


def test_equal_ids_and_sizes_are_mixed_alike(spark):
    """Documents that only their texts tell apart are taken alike however they are dealt."""
    rows = [(None if k % 2 else 1, f"w{k % 7} x y", "s", k) for k in range(60)] + [(2, "a b", "t", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    want = None
    for parts in (1, 3, 7):
        got = sorted((str(r.doc_id), r.text, r.mix_copies) for r in mixing.mix(table.repartition(parts)).collect())
        want = want or got
        assert got == want


def test_copies_do_not_share_a_sequence(spark):
    """Of documents that are there three times no two copies of a piece stand in one sequence, and every id is packed once."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    rows = base.withColumn("copy", F.explode(F.array(*map(F.lit, range(3))))).select("doc_id", "text")
    got = packing.pack(rows, file="byte_bpe_50k.json", end_id=1).collect()
    seen, per = set(), {}
    for r in got:
        assert (r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id) not in seen
        seen.add((r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id))
        per[r.doc_id] = per.get(r.doc_id, 0) + r.length
    assert all(per[r.doc_id] == 3 * r.doc_tokens for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.LENGTH


def test_one_document_very_often(spark):
    """Copies of one document that are all of the table."""
    rows = spark.range(9000).select(F.lit(7).alias("doc_id"), F.lit("one short text").alias("text"))
    got = packing.pack(rows, file="byte_bpe_50k.json", end_id=1)
    n = got.agg(F.sum("length"), F.count("*"), F.count_distinct("sequence_id")).first()
    total = got.first().doc_tokens
    assert n[0] == 9000 * total and n[1] >= 9000


def test_shared_folders(spark, monkeypatch):
    """Folders go when they are cleared; without a shared folder a cluster's session is refused."""
    from types import SimpleNamespace

    from sedimenta.llm import common

    monkeypatch.setattr(common, "_MADE", [])
    kept_rows = common.stored(spark.range(3), "x")
    assert kept_rows.count() == 3 and common.clear(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(*kept_rows.inputFiles())
    for master in ("spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master)), "y")
    assert common.free_prefix("q_", ["a", "Q_x", "q__"]) == "q___"
