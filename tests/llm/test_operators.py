"""The training-data operators against plain Python on small tables with nulls, empty, long and repeated texts and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sedimenta.llm")
from sedimenta.llm import chat, lm, minhash, mixing, packing, pii, quality, token_files, tokens, toxicity, vectors  # noqa: E402

WORDS = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, size long, h long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    texts = [None, "", " \t\n", "One", "one", "a b c d", "a b c d e", "Ünï cödé " * 20, "x" * 5000, "same line\n" * 40]
    base = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(12)]
    texts += base + base[:4]
    for b in base[:8]:
        for edits in (1, 2, 3, 6):
            w = b.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    for k in range(30):  # near copies of one text, each with an edit of its own
        w = base[0].split()
        w[(k * 4) % 120] = f"z{k}"
        texts.append(" ".join(w))
    texts += [" ".join(base[0].split()[:60] + [rng.choice(vocab) for _ in range(60)]) for _ in range(20)]
    texts += ["p q r s t u v w", "p q r s t u v w x", "o p q r s t u v w", "p q r s t u"]
    texts += ["A" * 30 + " very long " + " ".join(rng.choice(vocab) for _ in range(20_000))]
    return [(k * 3 + 1, t, "en", [None, "a", "b", "é"][k % 4], len(t or ""), 7, 8, 9, 10) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = WORDS.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("similarity", ["0.85", "0.8"])
def test_minhash_is_exact(docs, rows, similarity):
    t = int(similarity[2:].ljust(2, "0"))
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])]
    expect = groups(ids, links)
    got = {r.doc_id: r for r in minhash.linked(docs, similarity=similarity).collect()}
    assert {i: r.component_id for i, r in got.items()} == expect
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_minhash_empty_and_repeated(spark, empty):
    assert minhash.linked(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in minhash.linked(df).collect())
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 3, True), (True, 0, None, True)]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 16))
    vs = [(k, base[k % 20] + (k // 20) * 0.05 * rng.standard_normal(16), k % 2) for k in range(120)]
    data = [(k, [float(np.float32(x)) for x in v], l) for k, v, l in vs]
    data += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [None] * 16, 1), (204, data[0][1], None), (205, data[0][1], 0), (206, data[0][1], 0), (207, [], 1), (208, data[1][1][:8], 1)]
    got = {r.vec_id: r for r in vectors.linked(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(k, np.array(v), l) for k, v, l in data if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for i, (a, u, x) in enumerate(good) for b, v, y in good[i + 1 :] if x == y and len(u) == len(v) and u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= 0.98]
    n = Counter(x for pair in links for x in pair)
    assert {k: r.n_links for k, r in got.items()} == {k: n[k] for k, _, _ in data}
    assert {k: r.component_id for k, r in got.items()} == groups([k for k, _, _ in data], links)
    assert vectors.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert vectors.recall(0.98) > 0.99


def test_components(spark):
    from sedimenta.llm.common import components

    chain = [(k, k + 1) for k in range(40)] + [(100, 99), (99, 100), (5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_are_the_librarys(file):
    rng = random.Random(1)
    parts = list("ab cdé's \n\t.,;!? 12ßÀİΣσ中 \xa0\x85\x1c　́") + [" ", "  ", " the", " they're", "<|endoftext|>", "'S "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [None]
    e = tokens.Encoder(file, memory=50)
    got = [x for k in range(0, len(texts), 100) for x in e.batch(texts[k : k + 100])]
    assert got == [tokens.Encoder.packed(x.ids) for x in e.whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def encoded(file, text, end):
    e = tokens.encoder(file)
    return e.whole.encode(text or "", add_special_tokens=False).ids + [end]


def test_token_files(spark, docs, rows, empty, tmp_path):
    made = token_files.write(docs, f"file://{tmp_path}/ids", file="word_bpe_49k.json", end_id=2)
    got = sorted(token_files.read(made).collect(), key=lambda r: r.start)
    at = 0
    for r, row in zip(got, sorted(rows), strict=True):
        ids = encoded("word_bpe_49k.json", row[1], 2)
        assert (r.doc_id, r.start, r.n_tokens) == (row[0], at, len(ids))
        assert r.ids == np.array(ids, "<u4").tobytes()
        at += len(ids)
    assert token_files.export(empty, file="word_bpe_49k.json", end_id=2).count() == 0
    first = next(iter(made.collect()))
    with open(first.file.removeprefix("file://"), "rb") as f:
        reader = token_files.Reader(f)
        wanted = int(reader.ids[-1])
        assert reader.find(wanted) == [np.array(encoded("word_bpe_49k.json", dict((r[0], r[1]) for r in rows)[wanted], 2), "<u4").tobytes()]
        f.seek(0)
        data = bytearray(f.read())
    data[reader.frames[0][1] - 1] ^= 1
    import io

    with pytest.raises(Exception):
        token_files.Reader(io.BytesIO(bytes(data))).document(0)


def test_packing(docs, rows, empty):
    got = packing.pack(docs, file="byte_bpe_50k.json", end_id=1, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for row in rows:
        mine = sorted(by_doc[row[0]], key=lambda r: r.start)
        ids = np.array(encoded("byte_bpe_50k.json", row[1], 1), "<u4").tobytes()
        assert b"".join(r.ids for r in mine) == ids
        assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
        assert {r.doc_tokens for r in mine} == {len(ids) // 4}
    pad = 0
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == [sum(x.length for x in seq[:k]) for k in range(len(seq))]
        n = sum(r.length for r in seq)
        assert n <= 2048
        pad += 0 if n & (n - 1) == 0 else 2048 - n
    assert pad <= 0.02 * sum(r.length for r in got)
    assert packing.pack(empty, file="byte_bpe_50k.json", end_id=1).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(200)]
    plain = []
    for k in sorted(range(200), key=lambda k: (-lengths[k], k)):
        for b in plain:
            if sum(lengths[x] for x in b) + lengths[k] <= 100:
                b.append(k)
                break
        else:
            plain.append([k])
    assert packing.first_fit_decreasing(lengths, 100) == plain


def counts_of(text):
    text = text or ""
    w = WORDS.findall(text)
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + d for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, rows, empty):
    bad = [(5000 + k, "## ** $$ " * 10 + f"junk{k} " + " ".join(f"j{k}x{i}" for i in range(60)), "en", "a", 1, 7, 8, 9, 10) for k in range(60)]
    good = [(7000 + k, " ".join(f"g{k}y{i}" for i in range(90)), "en", "a", 1, 7, 8, 9, 10) for k in range(200)]
    extra = spark.createDataFrame(bad + good, DOCS)
    labels = spark.createDataFrame([(r[0], 0) for r in bad] + [(r[0], 1) for r in good] + [(1, None), (None, 1)], "doc_id long, quality int")
    rules = quality.fit(extra, labels)
    assert 1 <= len(rules.rules) <= 3
    judged = {r.doc_id: r for r in quality.judge(docs.unionByName(extra), rules).collect()}
    for row in [*rows, *bad, *good]:
        r, (n, chars, symbols, dup, rep) = judged[row[0]], counts_of(row[1])
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == (n, chars, symbols, dup, rep), row[0]
        assert r.q_base_failed == (n < 50 or 100 * rep > 50 * n)
    assert not any(judged[r[0]].q_kept for r in bad) and all(judged[r[0]].q_kept for r in good)
    none = quality.fit(empty, labels)
    assert none.rules == [] and quality.judge(empty, none).count() == 0


def test_mixing(docs, rows, empty):
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = {r[0]: len(WORDS.findall(r[1] or "")) for r in rows}
    sources = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    target, open_, left = {}, set(sources), sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
            open_.remove(s)
    longest = max(size.values())
    for s in sources:
        mine = [r for r in rows if r[3] == s]
        assert all(got[r[0]].mix_size == size[r[0]] and got[r[0]].mix_source_size == total[s] for r in mine)
        assert all(abs(got[r[0]].mix_target - target[s]) < 1e-6 * max(1, target[s]) for r in mine)
        assert all(0 <= got[r[0]].mix_copies <= 3 for r in mine)
        assert abs(sum(got[r[0]].mix_copies * size[r[0]] for r in mine) - target[s]) <= 3 * longest
    assert sorted(mixing.mix(docs).select("doc_id", "mix_copies").collect()) == sorted((i, r.mix_copies) for i, r in got.items())
    assert mixing.repeated(mixing.mix(docs)).count() == sum(r.mix_copies for r in got.values())
    assert mixing.mix(empty).count() == 0


def spans_of(text):
    text, out = text or "", []
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    for kind, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return out


PII = [
    None, "", "mail a.b+c@x-y.example.co.uk, then a@b.co_x@y.zz and @no.no x@y", "a@b..c d@e.f. -@-.-", "1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4111111111111111", "+1 (017) 555-7713 or +49 89 1234567. +1 2 ++1 (2) 3456-7890-12 +1234567890123456",
    "é中😀 a@b.cd 😀 1.1.1.1", "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" but 04dbebab91ab85687d33eeaaf9ac699e1188f962', "ssn 123-45-6789", "9" * 300 + " " + "x" * 3000 + "@",
    "9" * 20_000, "a@b" + ".c" * 3000, "1." * 3000, "+1" + " 2" * 3000, "x" * 5000 + "@", "+" * 5000, "AB12" + "CD34" * 2000, "- " * 5000,
]


def test_pii(spark, rows, empty):
    rng = random.Random(4)
    soup = ["".join(rng.choice("0123456789..@- +()ab_x%") for _ in range(60)) for _ in range(400)]
    data = [(k, t, "en", "a", len(t or ""), 7, 8, 9, 10) for k, t in enumerate([*PII, *soup, *(r[1] for r in rows)])]
    got = {r.doc_id: r.pii for r in pii.find(spark.createDataFrame(data, DOCS)).collect()}
    for k, t, *_ in data:
        assert [(s.kind, s.start, s.end) for s in got[k] if s.kind in pii.BASE] == spans_of(t), t
    assert [s.kind for s in got[8]] == ["iban"] and [s.kind for s in got[10]] == ["ssn"]
    assert [(s.kind, s.start) for s in got[9]] == [("secret", 9)]
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(data, DOCS)).collect()}
    assert clean[0] is None and clean[1] == "" and clean[10] == "ssn <ssn>"
    assert clean[7] == "é中😀 <email> 😀 <ip>"
    assert pii.find(empty).count() == 0


def test_secrets_of_either_case(spark):
    key = "9233a8ecf7" * 4
    data = [(k, f'TOKEN = "{x}"') for k, x in enumerate((key, key.upper(), key[:20] + key[20:].upper()))]
    got = pii.find(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert [[(s.kind, s.start, s.end) for s in r.pii] for r in sorted(got)] == [[("secret", 9, 49)]] * 3


def test_context_on_both_sides(spark):
    texts = ["SSN: 123-45-6789, 987-65-4321", "123-45-6789 (SSN)", "123-45-6789, 987-65-4321 (SSN)", "SSN" + " " * 38 + "123-45-6789", "123-45-6789" + " " * 38 + "SSN", "é😀 ssn: 123-45-6789", "no word 123-45-6789"]
    texts += ["ssn 123-45-6789 " + "x" * 60 + " 987-65-4321", "123-45-6789, " * 100 + "SSN", "0123456789abcdef" * 2 + " is the API key"]
    got = {r.doc_id: [(s.kind, s.start) for s in r.pii] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts[:9]):
        window = lambda m: (t[max(0, m.start() - 40) : m.start()] + "|" + t[m.end() : m.end() + 40]).lower()
        assert got[k] == [("ssn", m.start()) for m in re.finditer(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", t) if "ssn" in window(m)], t
    assert [len(got[k]) for k in range(9)] == [2, 1, 2, 0, 0, 1, 0, 1, 3] and got[9] == [("secret", 0)]


def test_toxicity(spark, empty):
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(500)]
    data, labels = [], []
    for k in range(600):
        w = [rng.choice(vocab) for _ in range(80)]
        toxic = k % 6 == 0
        if toxic:
            at = rng.randrange(70)
            w[at : at + 6] = [rng.choice(["scum", "idiot", "moron", "trash"]) for _ in range(6)]
        data.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    data += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum((got[k].score >= 0.5) != t for k, t in labels) <= 6
    assert got[1000].score == got[1001].score < 0.5 and got[1000].passages == []
    bad = got[0].passages[0]
    assert set(data[0][1][bad.start : bad.end].split()) & {"scum", "idiot", "moron", "trash"}
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_segments_are_maximal():
    """Against the definition by recursion: the best segment, then the same to its left and right."""

    def plain(s, lo, hi):
        best = None
        for i in range(lo, hi):
            t = 0
            for j in range(i, hi):
                t += s[j]
                if t > 0 and (best is None or t > best[0] or (t == best[0] and j + 1 - i < best[2] - best[1])):
                    best = (t, i, j + 1)
        return [] if best is None else plain(s, lo, best[1]) + [best] + plain(s, best[2], hi)

    rng = random.Random(8)
    for _ in range(200):
        s = [rng.choice([-5, -3, -2, -1, 1, 2, 4]) + rng.random() / 7 for _ in range(rng.randint(0, 30))]
        got = toxicity.segments(np.array(s))
        want = plain(s, 0, len(s))
        assert [(i, j) for _, i, j in got] == [(i, j) for _, i, j in want]


def test_lm(spark, docs, rows, empty):
    got = {r.doc_id: r for r in lm.scored(docs).collect()}
    train = Counter()
    toks = {r[0]: [*WORDS.findall(lower(r[1])), " "] for r in rows}
    for i, w in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update(w)
    n, v = sum(train.values()), len(train)
    for i, w in toks.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(r.base_score - sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6 * len(w)
        assert r.score < 0 and r.n_bytes == sum(len(x.encode()) + 1 for x in w[:-1]) + 1
        assert abs(r.bits_per_byte + r.score * math.log2(10) / r.n_bytes) < 1e-9
    assert lm.scored(empty).count() == 0


def test_chat(spark):
    data = [
        (1, 0, "user", "How do I sort a list?\n\nI tried sorted."),
        (1, 1, "assistant", "> how do I  sort a list\n\nUse list.sort()."),
        (1, 2, "user", "Anna wrote:\n> > How do I sort a list?\n> Use list.sort().\nThanks!"),
        (1, 3, "assistant", "No quote here."),
        (1, 4, "user", "> I tried sorted.\nMe too."),
        (2, 0, "user", "> Use list.sort().\nFrom elsewhere"),
        (2, 1, None, None),
        (None, 0, "user", "> Use list.sort()."),
        (3, 0, "user", ">\n> nothing known"),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.threaded(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1].text == "Use list.sort()." and (got[1, 1].quoted_conv, got[1, 1].quoted_turn) == (1, 0)
    assert got[1, 2].text == "Thanks!" and got[1, 2].n_quotes == 2 and got[1, 2].n_linked == 2
    assert got[1, 4].quoted_turn == 0 and got[1, 3].quoted_turn is None
    assert (got[2, 0].quoted_conv, got[2, 0].quoted_turn) == (1, 1)
    assert [k for k in sorted((r.reply_order, t) for (c, t), r in got.items() if c == 1)] == [(1, 0), (2, 1), (3, 2), (4, 4), (5, 3)]
    assert got[2, 1].line == "user: " and got[None, 0].n_linked == 0 and got[3, 0].n_linked == 0
    assert chat.threaded(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_rows(spark):
    """Announcing lines go, rows repeat, long texts pass, null turns and conversations stand alone, other columns do not matter."""
    from pyspark.sql import functions as F

    data = [
        (1, 0, "user", "One stone."), (1, 1, "user", "My view.\nAnna wrote:\n> One stone.\nYes."), (1, 1, "user", "My view.\nAnna wrote:\n> One stone.\nYes."),
        (1, None, "user", "> One stone."), (None, 3, None, "> One stone."), (None, 3, None, "> One stone."), (2, 0, "user", "word " * 100_000 + "\n> One stone."), (2, 1, "user", "Anna wrote:\nnothing quoted"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"row": F.lit(1), "own": F.lit("x"), "quotes": F.lit(2)})
    got = Counter((r.conv_id, r.turn, r.n_linked, r.reply_order, r.text[:20]) for r in chat.threaded(df).collect())
    assert got == Counter({
        (1, 0, 0, 2, "One stone."): 1, (1, 1, 1, 3, "My view.\nYes."): 1, (1, 1, 1, 4, "My view.\nYes."): 1, (1, None, 0, 1, ""): 1, (None, 3, 0, 1, ""): 2, (2, 0, 1, 1, "word word word word "): 1,
        (2, 1, 0, 2, "Anna wrote:\nnothing "): 1,
    })


def test_minhash_repeated_ids_keep_links(spark):
    """An id with two texts stands for both: near copies of either are linked with it."""
    w = [f"a{k}" for k in range(100)]
    v = [f"b{k}" for k in range(100)]
    rows = [(1, " ".join(w)), (1, " ".join(v)), (2, " ".join([*w[:99], "x"])), (3, " ".join([*v[:99], "y"])), (4, "else " * 20)]
    got = {(r.doc_id, r.component_id) for r in minhash.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_minhash_without_broadcast(spark, docs, monkeypatch):
    """Beyond SMALL ids both sides are shuffled, with the same rows."""
    ids = docs.select(docs.doc_id.alias("id")).where("id % 2 = 0")
    texts = docs.select(docs.doc_id.alias("id"), "text")
    assert sorted(minhash.chosen(texts, ids).collect(), key=str) == sorted(minhash.chosen(texts, ids, small=0).collect(), key=str)


def test_names_of_other_columns(spark):
    """Columns that operators use inside do no harm, and dots in names pass."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "mail a@b.cd now"), (2, None)], "doc_id long, text string").withColumns({"pii_spans": F.lit("mine"), "id": F.lit(9), "n": F.lit(8), "a.b": F.lit(7)})
    clean = pii.redact(df)
    assert clean.columns == df.columns and {(r.doc_id, r.text, r.pii_spans) for r in clean.collect()} == {(1, "mail <email> now", "mine"), (2, None, "mine")}
    with pytest.raises(ValueError):
        pii.find(df.withColumn("pii", F.lit(1)))
    assert minhash.linked(df).count() == packing.pack(df, file="byte_bpe_50k.json", end_id=1).select("doc_id").distinct().count() == 2
    e = spark.createDataFrame([(1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x")], "vec_id long, embedding array<float>, label int, key string").withColumns({"cls": F.lit(1), "u": F.lit(2), "v": F.lit(3)})
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.linked(e).collect()) == [(1, 2, 1), (2, 2, 1), (2, 2, 1)]


def test_context_words_are_whole(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f"the turkey {key}", f"{key} is my api key", f"api_key={key}", f"KEY: {key}", f"monkeys {key}", f"keys {key}", "key" + "x" * 38 + " " + key, "tur" + "key" + " " * 38 + key]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [len(r.pii) for r in sorted(got)] == [0, 1, 1, 1, 0, 1, 0, 0]


def test_toxicity_rows(spark):
    """Repeated rows, very long texts and other columns."""
    from pyspark.sql import functions as F

    rows = [(k, ("scum idiot " * 5 if k % 4 == 0 else "") + f"plain words{k % 7} here and there " * 10) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "half": F.lit(2), "toxic": F.lit(3)})
    model = toxicity.fit(docs, spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int"))
    more = docs.union(docs.limit(1)).union(docs.limit(1).withColumn("text", F.lit("plain " * 200_000)))
    got = toxicity.score(more, model)
    assert got.count() == 82 and got.columns == ["doc_id", "score", "passages"]


def test_packing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c " * 50)] * 3000 + [(2, "x")], "doc_id long, text string")
    got = packing.pack(df, file="byte_bpe_50k.json", end_id=1)
    n = len(tokens.encoder("byte_bpe_50k.json").whole.encode("a b c " * 50, add_special_tokens=False).ids) + 1
    assert got.where("doc_id = 1").groupBy().sum("length").first()[0] == 3000 * n
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_chat_parts_of_passages(spark):
    data = [
        (1, 0, "user", "First line here\nsecond line here\nthird line here\n\nAnother paragraph."),
        (1, 1, "assistant", "> First line here\n> second line here\n> third line here\n>\n> Another paragraph.\nBoth."),
        (1, 2, "user", "> second line here\n> third line here\nTwo lines."),
        (1, 3, "user", "> Third line here\n> Another paragraph.\nRun together."),
        (1, 4, "user", "> first line here\n> third line here\nNot in a row."),
        (2, 0, "user", "> Shared words.\nBefore I say it."),
        (2, 1, "user", "Shared words."),
        (3, 5, "user", "Shared words."),
        (4, 0, "user", "Shared words."),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.threaded(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    linked = {k: (r.n_quotes, r.n_linked, r.quoted_conv, r.quoted_turn, r.thread, r.text) for k, r in got.items() if r.n_quotes}
    assert linked == {
        (1, 1): (2, 2, 1, 0, 0, "Both."), (1, 2): (1, 1, 1, 0, 0, "Two lines."), (1, 3): (1, 1, 1, 0, 0, "Run together."),
        (1, 4): (1, 0, None, None, 4, "Not in a row."), (2, 0): (1, 1, 3, 5, 0, "Before I say it."),
    }


def test_queries_and_pipeline(spark):
    import corpus_pipeline
    from sedimenta.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(QUERIES) == 13
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "personal_data", "mixture", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
            assert set(out.select("doc_id").toPandas().doc_id) <= set(docs.select("doc_id").toPandas().doc_id)
        from sedimenta.llm.common import stored

        docs = stored(out, "test-stage")
    assert docs.count() > 0


def test_sha_of_spans(spark):
    from pyspark.sql import functions as F

    df = pii.find(spark.createDataFrame([(1, "a@b.cd 1.2.3.4")], "doc_id long, text string"))
    row = df.select(F.sha2(pii.listed(F.col("pii")), 256).alias("s")).first()
    assert row.s == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
