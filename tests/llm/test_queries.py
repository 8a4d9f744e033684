"""Every registered query of the training-data operators against a plain version, on the smallest tables, and the pipeline's stages."""

import hashlib
import importlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("sedimenta.llm")
from sedimenta.llm import minhash, mixing, packing, pii, quality, queries, tokens, toxicity  # noqa: E402

from test_operators import counts_of, groups, shingles, spans_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_names():
    assert sorted(queries.QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n).group(1))) == list(queries.QUERIES)
    assert [int(re.match(r"op(\d+)_", n).group(1)) for n in queries.QUERIES] == list(range(1, 14))


def test_op1(spark, texts):
    """Scores from the model's token scores by the definition of maximal segments; labels only through rows that are not held out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, SF).collect()}
    assert got.keys() == texts.keys()
    told = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    for i, r in got.items():
        assert r.held_out == (fold(i) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    held = [i for i in told if fold(i) == 0]
    assert sum(got[i].predicted == told[i] for i in held) >= 0.9 * len(held)
    # other labels of held-out rows change nothing
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.fit(docs, other)
    assert {r.doc_id: r.score for r in toxicity.score(docs, model).collect()} == {i: r.score for i, r in got.items()}

    def plain(s):
        best = None
        for i in range(len(s)):
            t = 0.0
            for j in range(i, len(s)):
                t += s[j]
                if t > 0 and (best is None or t > best[0]):
                    best = (t, i, j + 1)
        return [] if best is None else [best[0], *plain(s[: best[1]]), *plain(s[best[2] :])]

    for i, text in texts.items():
        words = toxicity.TOKEN.findall(text or "")
        if len(words) <= 150:
            scores = [float(model.scores[toxicity.slot(w)]) for w in words]
            base = model.level + math.log(max(len(words), 1))
            evidence = sum(e for e in (x * model.nats - base for x in plain(scores)) if e > 0)
            assert abs(got[i].score - 1 / (1 + math.exp(-(model.a + model.b * math.log1p(evidence))))) < 1e-4


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchall()
    columns = [d[0] for d in con.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, SF).select(*columns).collect())) == sorted(want)


def test_op2(spark, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op2_minhash(spark, SF).collect()}
    assert got == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def ids_of(file, text, end):
    return np.array(tokens.encoder(file).whole.encode(text or "", add_special_tokens=False).ids + [end], "<u4").tobytes()


def test_op4(spark, texts):
    got, at = {r.doc_id: r for r in queries.op4_token_files(spark, SF).collect()}, 0
    for i in sorted(texts):
        ids = ids_of("word_bpe_49k.json", texts[i], 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4


def test_op5(spark):
    """On the tables, then on made-up talk full of quotations, each against the rules read one message at a time."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert_threads(rows, queries.op5_chat(spark, SF).collect())
    import random

    from sedimenta.llm import chat

    rng = random.Random(11)
    lines = [f"{a} {b} {c}" for a in ("red", "Blue", "old") for b in ("stone", "river") for c in ("sings", "sleeps", "waits")]
    made = []
    for conv in [*range(12), None]:
        for turn in range(5):
            text = []
            for _ in range(rng.randint(0, 3)):
                passage = rng.sample(lines, rng.randint(1, 3))
                mark = rng.choice(["", "", "> ", "> > ", ">"])
                if mark and rng.random() < 0.4:
                    text.append("Ann wrote:")
                text += [mark + x for x in passage] + ([""] if rng.random() < 0.6 else [])
            made.append((conv, turn if rng.random() < 0.97 else None, rng.choice(["user", "assistant", None]), "\n".join(text) if rng.random() < 0.95 else None))
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    assert_threads(made, chat.threaded(df).collect())


def assert_threads(rows, got):
    norm = lambda t: re.sub(r"[^\w]|_", " ", re.sub("[A-Z]", lambda m: m.group().lower(), t)).split()

    def passages(text):
        out, last = [], None
        lines = re.sub("\r\n?", "\n", text or "").split("\n")
        depth = lambda line: m.group().count(">") if (m := re.match(r"^(?:[ \t]*>)+", line)) else 0
        for n, line in enumerate(lines):
            level = depth(line)
            body = re.sub(r"^(?:[ \t]*>)+ ?", "", line)
            announces = level == 0 and n + 1 < len(lines) and depth(lines[n + 1]) > 0 and re.match(r"(?i)^.{0,200}\bwrote\s*:\s*$", body)
            if last != level or not body.strip(" \t\n\x0b\x0c\r") or announces:
                out.append((level, []))
            out[-1][1].append(body)
            last = level
        return out

    read = [(conv, turn, passages(text)) for conv, turn, _, text in rows]
    sources = []
    for conv, turn, ps in read:
        if conv is not None and turn is not None:
            own = [b for level, b in ps if level == 0]
            sources.append((conv, turn, [norm("\n".join(b)) for b in own], [norm(x) for b in own for x in b if norm(x)]))
    want = Counter()
    for conv, turn, ps in read:
        quotes = [b for level, b in ps if level > 0 and norm("\n".join(b))]
        first, linked = None, 0
        if conv is not None and turn is not None:
            for q in quotes:
                whole, run = norm("\n".join(q)), [norm(x) for x in q if norm(x)]
                ways = (
                    lambda s: whole in s[2],
                    lambda s: any(s[3][k : k + len(run)] == run for k in range(len(s[3]) - len(run) + 1)),
                )
                found = None
                for same in (True, False):
                    for has in ways:
                        if found is None and same:
                            found = max(((conv, s[1]) for s in sources if s[0] == conv and s[1] < turn and has(s)), default=None)
                        elif found is None:
                            found = min(((s[0], s[1]) for s in sources if s[0] != conv and has(s)), default=None)
                linked += found is not None
                first = first or found
        want[conv, turn, len(quotes), linked, first] += 1
    told = Counter((r.conv_id, r.turn, r.n_quotes, r.n_linked, (r.quoted_conv, r.quoted_turn) if r.quoted_conv is not None else None) for r in got)
    assert told == want


def test_op6(spark, texts):
    pieces, sequences = {}, {}
    for r in queries.op6_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for i, mine in pieces.items():
        ids, at = ids_of("byte_bpe_50k.json", texts[i], 1), 0
        for r in sorted(mine, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids[4 * at : 4 * (at + r.length)])) and r.length > 0
            at += r.length
        assert at == len(ids) // 4
    lengths = []
    for mine in sequences.values():
        mine.sort(key=lambda r: r.offset)
        assert [r.offset for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        lengths.append(sum(r.length for r in mine))
    assert max(lengths) <= 2048
    assert sum(2048 - n for n in lengths if n & (n - 1)) <= 0.02 * sum(lengths)


def test_op7(spark, texts):
    """Counts and rules in plain Python; the list is the one that the operator learns, read as text."""
    got = {r.doc_id: r for r in queries.op7_quality_rules(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rules = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).rules

    def measures(text):
        text = text or ""
        n, chars, symbols, dup, rep = counts_of(text)
        per = lambda chars_, of: sum(c in chars_ for c in text) / max(of, 1)
        return {
            "q_words": n, "q_word_len": chars / max(n, 1), "q_symbols": symbols / max(n, 1), "q_dup_lines": dup / (text.count("\n") + 1), "q_repeats": rep / max(n, 1),
            "q_upper": sum("A" <= c <= "Z" for c in text) / max(chars, 1), "q_marks": per("!?", n), "q_digits": per("0123456789", chars), "q_bars": per("|{}[]\\/=~^_", n),
        }

    assert got.keys() == texts.keys()
    for i, text in texts.items():
        n, chars, symbols, dup, rep = counts_of(text)
        m = measures(text)
        rule = next((k for k, r in enumerate(rules, 1) if all((m[x.measure] > x.edge) == x.above for x in r.literals)), 0)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert r.kept == (not r.base_failed and rule == 0) and r.rule == rule


def test_quality_rules_are_grown_by_gain(spark):
    """The first threshold of the first rule is the best by FOIL gain among all thresholds the learner may set."""
    import random

    rng = random.Random(4)
    rows = []
    for k in range(400):
        bad = rng.random() < 0.4
        rows.append((*[rng.random() + (0.6 if bad and j == 3 else 0.0) for j in range(len(quality.MEASURES))], bad, k % 3 == 0))
    df = spark.createDataFrame(rows, ", ".join(f"{m} double" for m in quality.MEASURES) + ", bad boolean, q_prune boolean")
    rules = quality.learn(df, "bad").rules
    assert rules
    grow = [r for r in rows if not r[-1]]
    p0, n0 = sum(r[-2] for r in grow), sum(not r[-2] for r in grow)

    def gain(measure, above, edge):
        j = quality.MEASURES.index(measure)
        covered = [r for r in grow if (r[j] > edge) == above]
        p, n = sum(r[-2] for r in covered), sum(not r[-2] for r in covered)
        return p * (math.log((p + 1) / (p + n + 2)) - math.log((p0 + 1) / (p0 + n0 + 2)))

    first = rules[0].literals[0]
    mine = gain(first.measure, first.above, first.edge)
    assert first.measure == quality.MEASURES[3] and first.above
    others = [gain(m, above, r[j]) for j, m in enumerate(quality.MEASURES) if j != 3 for above in (True, False) for r in grow]
    assert mine >= max(others)


def test_op8(spark, texts):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()
    got = {r.doc_id: r for r in queries.op8_mix_sources(spark, SF).collect()}
    taken, size = Counter(), Counter()
    for r in rows:
        n = len(re.findall("[^\x20\x09-\x0d]+", texts[r.doc_id] or ""))
        x = got[r.doc_id]
        assert x.size == n and x.taken in {n * c for c in range(4)}
        taken[r.source] += x.taken
        size[r.source] += n
    longest = max(x.size for x in got.values())
    for r in rows:
        x = got[r.doc_id]
        assert x.source_size == size[r.source] and x.target <= 3 * x.source_size + 1e-6 and abs(taken[r.source] - x.target) <= 3 * longest
    assert abs(sum({r.source: got[r.doc_id].target for r in rows}.values()) - sum(size.values())) < 1e-3


def test_op9(spark, texts):
    got = {r.doc_id: r for r in queries.op9_lm_scores(spark, SF).collect()}
    toks = {i: [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), " "] for i, t in texts.items()}
    train = Counter(w for i, ws in toks.items() if fold(i) != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 1, len(ws), sum(train[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) < 1e-6 * len(ws)
        assert r.score < 0 and r.bits_per_byte > 0


def test_op10(spark, texts):
    got = {r.doc_id: r for r in queries.op10_pii(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        base = spans_of(text)
        r, n = got[i], Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in pii.BASE)
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert ",".join(s for s in spans if s.split(":")[0] in pii.BASE) == told


# the stages of the pipeline, each against its effect


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls in any column, empty and repeated texts, repeated rows, and columns with names that operators use."""
    long_text = " ".join(f"word{k}" for k in range(80))
    rows = [(k, f"{long_text} tail{k} mail me at a{k}@b.com", "en", "src0", 1, "x") for k in range(0, 40, 2)]
    rows += [(1, None, None, None, None, None), (3, "", "en", "src1", 0, ""), (None, long_text, "en", None, 5, "y"), (5, " ".join(f"other{k}" for k in range(90)), "en", "src1", 3, "z")]
    rows += [rows[0], rows[0], (7, rows[-1][1].replace("other3 ", "changed "), "en", "src1", 3, "z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    names = {"extra": "pii_spans"}
    return spark.createDataFrame(rows, schema).withColumnsRenamed(names)


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


def test_stage_names(pipeline):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixture", "packing"]


def test_stage_quality(spark, pipeline, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in queries.op7_quality_rules(spark, SF).collect() if r.kept}
    out = pipeline.quality_rules(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert all(r.text and len(r.text.split()) >= 50 for r in pipeline.quality_rules(spark, odd, SF).collect())
    assert pipeline.quality_rules(spark, none, SF).count() == 0


def test_stage_near_duplicates(spark, pipeline, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id for r in minhash.linked(docs, similarity="0.8").where("kept").collect()}
    out = pipeline.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == want
    # of the near copies one stays, of rows with one id and one text one; a null id is linked with nothing
    left = sorted((r.doc_id is None, r.doc_id or 0) for r in pipeline.near_duplicates(spark, odd, SF).collect())
    assert left == [(False, 0), (False, 1), (False, 3), (False, 5), (True, 0)]
    assert pipeline.near_duplicates(spark, none, SF).count() == 0


def test_stage_personal_data(spark, pipeline, odd, none):
    out = pipeline.personal_data(spark, odd, SF)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert all("@" not in (r.text or "") for r in out.collect())
    assert Counter(r.pii_spans for r in out.collect()) == Counter(r.pii_spans for r in odd.collect())
    assert pipeline.personal_data(spark, none, SF).count() == 0


def test_stage_mixture(spark, pipeline, odd, none):
    out = Counter(r.text for r in pipeline.mixture(spark, odd, SF).collect())
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r.text] += r.mix_copies
    assert out == +want and pipeline.mixture(spark, odd, SF).columns == odd.columns
    assert pipeline.mixture(spark, none, SF).count() == 0


def test_stage_packing(spark, pipeline, odd, none):
    out = pipeline.sequences(spark, odd, SF)
    assert out.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert out.columns == packing.pack(odd, file="byte_bpe_50k.json", end_id=1).columns
    assert pipeline.sequences(spark, none, SF).count() == 0


def test_pipeline(spark, pipeline):
    out = pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in out}
    first = {r.doc_id for r in pipeline.quality_rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert kept and kept <= first
