"""Manifests, byte-pair codes and phrases against plain versions, and their odd cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("sedimenta.llm")
from pyspark.sql import functions as F  # noqa: E402
from sedimenta.llm import bpe, merkle, phrases, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def climb(nodes):
    """The top of a run of digests, and for each the siblings (left, right) from level to level."""
    paths, own, now = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(now) > 1:
        for k in range(len(nodes)):
            at = own[k]
            first = at // 16 * 16
            paths[k].append(("".join(now[first:at]), "".join(now[at + 1 : first + 16])))
            own[k] = at // 16
        now = [h("".join(now[i : i + 16])) for i in range(0, len(now), 16)]
    return now[0], paths


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row."""
    groups = {}
    for r in rows:
        groups.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    tops, held = [], []
    for key in sorted(groups):
        inside = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), k) for k, r in enumerate(groups[key])))
        top, paths = climb([x[2] for x in inside])
        held.append([(groups[key][x[3]], x[2], p) for x, p in zip(inside, paths)])
        tops.append(top)
    root, above = climb(tops)
    out = []
    for top, up, docs in zip(tops, above, held):
        for row, leaf, path in docs:
            path = path + up
            now = leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                now = leaf_of(row | {"text": row["text"] and row["text"].translate(LOWER)})
            for a, b in path:
                now = h(a + now + b)
            out.append((row["doc_id"], leaf, top, root, h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def run_on(spark, tmp_path, rows, name, schema=DOCS):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]


def test_op11(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_merkle(spark, SF).collect()), key=str) == plain_manifest(rows)


def test_op11_odd_rows(spark, tmp_path):
    """Null fields, one-leaf groups, runs of one, ties and equal rows, long texts, and a group of 16 * 16 + 1."""
    rows = [dict(doc_id=k, text=f"Text {k}", lang="en", source="big", n_chars=k) for k in range(257)]
    rows += [dict(doc_id=k, text="Ä" * k, lang=None, source=None, n_chars=None) for k in range(17)]
    rows += [dict(doc_id=5, text=None, lang="", source="", n_chars=0), dict(doc_id=None, text="A", lang="x", source="lone", n_chars=1)]
    rows += [dict(doc_id=7, text=t, lang="é", source="ü", n_chars=2) for t in ("A", "B", "B", "Same " * 100_000)]
    got = sorted(run_on(spark, tmp_path, [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], "op11_merkle"), key=str)
    assert got == plain_manifest(rows)
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_op11_one_document_and_none(spark, tmp_path):
    [r] = run_on(spark, tmp_path, [(1, "x", "en", "s", 1)], "op11_merkle")
    assert r[1] == r[2] == r[3] and r[4] == h("")
    empty = spark.createDataFrame([], DOCS)
    assert merkle.manifest(empty, merkle.FIELDS).leaves.count() == 0


def test_manifest_changes(spark):
    """Only documents of groups that differ are told, and names of other columns do not matter."""
    rows = [(k, f"text {k}", "en", f"s{k % 3}", k) for k in range(40)]
    one = spark.createDataFrame(rows, DOCS).withColumn("k", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("a.b", F.lit(2))
    two = spark.createDataFrame([r if r[0] != 7 else (7, "other", *r[2:]) for r in rows[:-1]], DOCS)
    a, b = merkle.manifest(one, merkle.FIELDS), merkle.manifest(two, merkle.FIELDS)
    assert a.root != b.root
    assert sorted((r.doc_id, r.side) for r in merkle.changed(a, b).collect()) == [(7, "one"), (7, "other"), (39, "one")]
    assert merkle.changed(a, a).count() == 0


@pytest.fixture(scope="module")
def tokeniser():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_op12(spark, tokeniser):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_bpe(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array(tokeniser(text or ""), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_bpe_every_character(tokeniser):
    """Each character beside letters, digits, spaces and itself."""
    own = bpe.Codec("byte_bpe_50k.tiktoken")
    every = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} {c}1{c}{c} x{c}" for c in every]
    for text, data in zip(texts, own.batch(texts)):
        assert ids_of(data) == tokeniser(text), repr(text)
        assert own.decode(data) == text.encode()


def test_bpe_long_and_repeated(tokeniser):
    """Long words, runs of one letter, spaces and marks, names of special tokens; a small memory changes nothing."""
    draw = random.Random(5)
    texts = ["", " ", "  ", "a" * 5000, "ab" * 3000, " " * 300 + "x", "\n\n \t x", "<|endoftext|> <|endoftext|>", "don't 'tis I'll  we've", "x" + "é" * 999, "0" * 1000 + " 12"]
    texts += ["".join(draw.choices("abc dé'.\n\t 1日 ", k=draw.randint(1, 400))) for _ in range(300)]
    texts.append("".join(draw.choices("etaoinshrdlu", k=200_000)))
    for memory in (8, 100_000):
        own = bpe.Codec("byte_bpe_50k.tiktoken", memory)
        for _ in range(2):
            assert [ids_of(x) for x in own.batch(texts)] == [tokeniser(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_bpe_any_text(texts):
    import public_tokenizers as P
    import tiktoken

    if not hasattr(test_bpe_any_text, "own"):
        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        test_bpe_any_text.own = bpe.Codec("byte_bpe_50k.tiktoken"), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, plain = test_bpe_any_text.own
    assert [ids_of(x) for x in own.batch(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_replay_when_a_merge_makes_a_lower_rank(tmp_path):
    """Ranks in which a longer token comes before its parts: order as in merging each word by itself."""
    draw = random.Random(2)
    for turn in range(30):
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 330:
            tokens.add(bytes(draw.choices(b"abc", k=draw.randint(2, 5))))
        longer = [t for t in tokens if len(t) > 1]
        draw.shuffle(longer)
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + k for k, t in enumerate(longer)}
        file = tmp_path / f"{turn}.tiktoken"
        file.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
        words = ["".join(draw.choices("abc", k=draw.randint(1, 30))) for _ in range(60)]

        def plain(word):
            parts = [word[i : i + 1] for i in range(len(word))]
            if word in ranks:
                return [ranks[word]]
            while True:
                best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
                if best is None:
                    return [ranks[p] for p in parts]
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        assert [ids_of(x) for x in bpe.Codec(str(file)).batch(words)] == [plain(w.encode()) for w in words]


def test_op12_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", None, None), (1, "", None, None, None), (None, "Hi <|endoftext|>", "en", "s", 1), (3, "word " * 300_000, "en", "s", 1)]
    got = run_on(spark, tmp_path, rows, "op12_bpe")
    none = hashlib.sha256(b"").hexdigest()
    assert sorted(r[1:] for r in got if r[0] == 1) == [(0, none, none)] * 2
    assert {r[0]: r[3] for r in got if r[0] != 1} == {i: h(t) for i, t, *_ in rows if i != 1}
    assert run_on(spark, tmp_path, [], "op12_bpe") == []


def test_decode_of_a_table(spark):
    docs = spark.createDataFrame([("x", "some text", 1), ("y", None, 2)], "doc_id string, text string, ids_ int")
    back = bpe.decode(bpe.encode(docs, file="byte_bpe_50k.tiktoken"), file="byte_bpe_50k.tiktoken")
    assert {r.doc_id: bytes(r.decoded) for r in back.collect()} == {"x": b"some text", "y": b""}
    with pytest.raises(ValueError):
        bpe.decode(back, file="byte_bpe_50k.tiktoken")


def plain_phrases(rows, least=30, keep=2000):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    often = {g: a for g, a in count.items() if len(g[1]) > 1 and a >= least}
    within = Counter()
    for (lang, words), a in often.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                key = lang, words[i : i + m]
                within[key] = max(within[key], a)
    found = {}
    for (lang, words), a in often.items():
        if 100 * within[lang, words] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = count[lang, words[:k]], count[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, left, right, total[lang], -s) for lang, all_ in found.items() for r, (s, a, p, left, right) in enumerate(sorted(all_)[:keep], 1))


def test_op13(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    assert sorted(map(tuple, queries.op13_phrases(spark, SF).collect())) == plain_phrases(rows)


def talk(seed, n):
    draw = random.Random(seed)
    vocabulary = ["New", "york", "new", "a", "b", "é", "日本", "the", "of", "x\x1cy", "\x85z", "q"]
    return ["".join(draw.choice(vocabulary) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for _ in range(draw.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("bits", [4, 10, None])
def test_phrases_of_any_sketch(spark, bits):
    """Sketches of any width give the exact result; also with few kept, null texts and languages and clashing names."""
    rows = [(draw, text) for draw, text in zip(["en", None, "und", "fr"] * 60, talk(1, 240))] + [("en", None), (None, ""), ("fr", "a b. " * 2000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "lang string, text string, rank int, f int, `cut.score` int").repartition(5)
    got = phrases.mine(docs, least=9, keep=25, bits=bits)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 9, 25)


def test_blocks_change_nothing(spark, monkeypatch):
    rows = list(zip(["en", "fr", None] * 50, talk(3, 150)))
    monkeypatch.setattr(phrases, "BLOCK", 500)
    monkeypatch.setattr(phrases, "PENDING", 900)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert sorted(map(tuple, phrases.mine(docs, least=5).collect())) == plain_phrases(rows, 5)


def test_phrases_of_nothing(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        phrases.mine(spark.createDataFrame([], "lang string, text string"), least=200)


def test_scores_beyond_64_bits(spark):
    """2,000,000 times a count may pass 64 bits."""
    a = 6 * 10**12
    counts = spark.createDataFrame([("en", "", 0, 10**15), ("en", "x", 1, a + 1), ("en", "y", 1, a + 2), ("en", "x y", 2, a)], "lang string, phrase string, size int, f long")
    [r] = phrases.scored(counts).collect()
    assert (r.a, r.l, r.r, r.score) == (a, a + 1, a + 2, 2_000_000 * a // (2 * a + 3))


def test_packed_counters():
    at = np.unique(np.random.default_rng(1).integers(0, 1 << 20, 5000)).astype(np.uint32)
    times = (at % 30 + 1).astype(np.uint8)
    back, told = phrases.unpacked(phrases.packed(at, times))
    assert (back == at).all() and (told == times).all()


def test_token_files_remember_few_pieces():
    """A worker's memory of pieces is bounded, and smaller for token files than in general; what is not remembered gets the same ids."""
    from sedimenta.llm import token_files, tokens

    assert token_files.REMEMBERED <= 300_000
    small, texts = tokens.encoder("word_bpe_49k.json", 500), [" ".join(f"w{k}x{n}" for n in range(100)) for k in range(40)]
    got = [small.batch([t])[0] for t in texts]
    assert len(small.known) <= 600
    assert got == tokens.Encoder("word_bpe_49k.json").batch(texts)
