"""The language model against a plain one that takes a text bit by bit, and its probabilities against their definition."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("sedimenta.llm")
from sedimenta.llm import lm  # noqa: E402

M64, M32 = (1 << 64) - 1, (1 << 32) - 1
C1, C2, C3, C4, C5 = (int(c) for c in (lm.C1, lm.C2, lm.C3, lm.C4, lm.C5))


def block(texts):
    """A block as the operator makes it: words, hashes, tokens, sizes, vocabulary."""
    vocabulary = {b"": 0}
    docs = [[vocabulary.setdefault(w, len(vocabulary)) for w in [*lm.words_of(t), b""]] for t in texts]
    words = b"".join(w + b" " for w in list(vocabulary)[1:])
    return words, lm.hashes_of(list(vocabulary)), np.concatenate([np.array(d, np.int32) for d in docs]), np.array([len(d) for d in docs]), list(vocabulary)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    common = [("the of and to " * 5 + "river stone light paper window").split(), ("der die und zu " * 5 + "fluß stein licht papier fenster").split()]
    texts = []
    for k in range(120):
        words = [rng.choice(common[k % 2]) if rng.random() < 0.7 else "".join(rng.choice(["an", "be", "ru", "ti", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([0, 3, 30, 200]))]
        texts.append(" ".join(words).encode())
    texts += [b"", b"x" * 3000, b"The THE the, the."]
    held = np.array([k % 5 == 1 for k in range(len(texts))])
    words, hashes, tokens, sizes, vocabulary = block(texts)
    counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(vocabulary))
    codes, lengths = lm.code_tables(lm.code_counts(words, counts, np.zeros(lm.CODES * 256)))
    trainer = lm.Trainer(16, codes, lengths)
    for _ in range(2):
        trainer.block(words, hashes, counts, tokens, sizes, held)
    model = lm.Model(16, codes, lengths, lm.tables_of(trainer.n), trainer.weights, int(counts.sum()), int((counts > 0).sum()))
    return model, texts, (words, hashes, tokens, sizes, vocabulary), counts


class Plain:
    """The same model, one decision at a time, in Python's own numbers."""

    def __init__(self, model):
        self.m = model

    def look(self, table, key):
        v = int(self.m.tables[table][((key ^ (key >> 15)) * C5 & M32) >> (32 - self.m.bits)])
        return ((v >> 4) - 1024) / 64, v & 15

    def decisions(self, symbols, place):
        """Of one byte of a word: outcomes, step 1's logits, keys of the whole prefix."""
        earlier = [symbols[place - back] + 1 if place >= back else 0 for back in range(1, 6)]
        cell = ((((earlier[0] * 257 + earlier[1]) * 257 + earlier[2]) * C1 & M64) >> 50) * 256 + symbols[place]
        code, size = int(self.m.codes[cell]), int(self.m.lengths[cell])
        contexts, h, done = [], 0, 0
        for order in lm.ORDERS:
            for back in range(done, order):
                h = (h ^ earlier[back]) * C1 & M64
                h ^= h >> 31
            done = order
            contexts.append((h * C2 + order) & M64)
        prefix = sum((symbols[q] + 1) * pow(C3, q + 1, 1 << 64) for q in range(place)) & M64
        contexts.append(((prefix ^ (prefix >> 32)) * C1 + place) & M64)
        w = self.m.weights
        for k in range(size):
            node = (code >> (size - k)) | (1 << k)
            keys = [((c >> 32) + node * C4) & M32 for c in contexts]
            got = [self.look(i, key) for i, key in enumerate(keys)]
            g = min((got[-1][1] + 2) // 3, 5) * 4 + min((got[-2][1] + 3) // 4, 3)
            mixed = sum(w.early[g, i] * x for i, (x, _) in enumerate(got))
            at = (min(max(mixed, -7.99), 7.99) + 8) * 2
            table = []
            for j in (int(at), int(at) + 1):
                p = (w.ones[g, j] + 20 / (1 + math.exp(8 - j / 2))) / (w.hits[g, j] + 20)
                table.append(math.log(p / (1 - p)))
            yield (code >> (size - 1 - k)) & 1, 0.5 * mixed + 0.5 * (table[0] * (1 - at % 1) + table[1] * (at % 1)), keys[-1]

    def score(self, text, counts):
        words = [*lm.words_of(text), b""]
        own, sure, lead, past, since = [1.0, 1.0], [lm.PRIOR, lm.PRIOR], 0, {}, 0
        late, options = self.m.weights.late, [0.0] * len(lm.SHARES)
        edge, step, steps = lm.CHUNK, float(lm.CHUNK), [[0.0, 0.0], [0.0, 0.0]]
        for n, word in enumerate(words):
            total = 0.0
            symbols = word + b" " if word else b"\n"
            for place in range(len(symbols)):
                for bit, m, key in self.decisions(symbols, place):
                    if place < lm.HEAD:
                        v, seen = self.look(lm.TABLES - 1, key ^ lead)
                        x = late[seen, 0] * m, late[seen, 1] * v
                        m = own[0] * x[0] + own[1] * x[1]
                    m = min(max(m, -16), 16)
                    p = 1 / (1 + math.exp(-m))
                    total += math.log(p if bit else 1 - p)
                    if place < lm.HEAD:
                        for k in (0, 1):
                            steps[k][0] += p * (1 - p) * x[k] ** 2
                            steps[k][1] += (bit - p) * x[k]
            for k, (counted, repeated) in enumerate(lm.SHARES):
                other, spelt = counted * counts.get(word, 0) / self.m.tokens, 1 - counted
                if since:
                    other, spelt = repeated * past.get(word, 0) / since + (1 - repeated) * other, (1 - repeated) * spelt
                options[k] += math.log(other + spelt * math.exp(total)) if other else math.log(spelt) + total
            past[word] = past.get(word, 0) + 1
            since += 1
            if 0 < len(word) <= lm.SHORT:
                lead = int(lm.hashes_of([word])[0]) >> 32
            if n + 1 == edge:
                for k in (0, 1):
                    sure[k] += 2 * steps[k][0]
                    own[k] += steps[k][1] / sure[k]
                steps = [[0.0, 0.0], [0.0, 0.0]]
                step *= lm.GROWTH
                edge += int(step)
        top = max(options)
        return (top + math.log(sum(math.exp(x - top) for x in options) / len(options))) / math.log(10)


def test_scores_are_the_plain_models(made):
    model, texts, (words, hashes, tokens, sizes, vocabulary), counts = made
    got = model.texts(words, hashes, counts, tokens, sizes)
    plain, known = Plain(model), dict(zip(vocabulary, counts.tolist()))
    for text, score in list(zip(texts, got))[::7] + list(zip(texts, got))[-3:]:
        want = plain.score(text, known)
        assert abs(score - want) < 1e-3 * max(1, abs(want)), text[:50]


def test_a_text_scores_alike_in_any_block(made):
    model, texts, _, counts = made
    known = dict(zip(made[2][4], counts.tolist()))

    def scores(some):
        words, hashes, tokens, sizes, vocabulary = block(some)
        return model.texts(words, hashes, np.array([known.get(w, 0) for w in vocabulary]), tokens, sizes)

    assert np.allclose(scores(texts)[:10], scores(texts[:10]), rtol=1e-4, atol=1e-4)


def test_bytes_are_a_distribution(made):
    """At any place of a word the probabilities of all bytes add up to one, and so do code words' shares."""
    plain = Plain(made[0])
    for start in (b"", b"t", b"riv", b"anbe", b"zzzzzz"):
        total = 0.0
        for byte in range(256):
            p = 1.0
            for bit, m, _ in plain.decisions(start + bytes([byte]), len(start)):
                q = 1 / (1 + math.exp(-m))
                p *= q if bit else 1 - q
            total += p
        assert abs(total - 1) < 1e-6
    assert np.allclose(np.exp2(-made[0].lengths.astype(float)).reshape(lm.CODES, 256).sum(axis=1), 1)


def test_huffman_is_optimal():
    rng = random.Random(9)
    for _ in range(50):
        weights = [rng.choice([1, 1, 2, 3, 5, 8, 100]) for _ in range(rng.randint(2, 9))]
        heap, cost = sorted(weights), 0
        while len(heap) > 1:
            both = heap.pop(0) + heap.pop(0)
            cost += both
            heap = sorted([*heap, both])
        lengths = lm.huffman([float(w) for w in weights])
        assert sum(w * n for w, n in zip(weights, lengths)) == cost


def test_order_matters(made):
    """Contexts cross words: a text with its words shuffled has another probability."""
    model, _, (words, hashes, tokens, sizes, vocabulary), counts = made
    known = dict(zip(vocabulary, counts.tolist()))
    rng = random.Random(1)
    one = b"the river of light and the stone to paper of the window".split()
    two = one[:]
    rng.shuffle(two)
    w, h, t, n, v = block([b" ".join(one), b" ".join(two)])
    a, b = model.texts(w, h, np.array([known.get(x, 0) for x in v]), t, n)
    assert a != b


def test_held_out_texts_score_above_the_base(spark):
    rows = lm.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_counts_do_not_depend_on_buckets(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(5)
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm.scored(docs).collect())
    monkeypatch.setattr(lm, "BUCKET", 500)
    assert sorted((r.doc_id, r.n_known, round(r.base_score, 6)) for r in lm.scored(docs).collect()) == want


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (1, None, "y"), (None, "a b", "z"), (2, "", ""), (3, "w" * 300_000, ""), (4, "a b", "q"), (4, "a b", "q")], "doc_id long, text string, block string"
    ).withColumnRenamed("block", "words")
    got = [(r.doc_id or 0, r.n_tokens, r.n_known) for r in lm.scored(df).collect()]
    assert sorted(got) == [(0, 3, 3), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 3, 3), (4, 3, 3)]  # 3 is held out
