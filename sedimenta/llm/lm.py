"""Language-model scores: hashed-context bit predictors mixed logistically by gated weights, over the bytes of whole texts.

The text scored is its lower-cased words, each closed by a space, and one end byte. Every byte is a few binary decisions down a
Huffman code that the three bytes before it in the word choose. Each decision is predicted from contexts that are hashed to tables
of counts: the last 3 and 5 bytes of the word, the whole word so far, and, for a word's first bytes, the word so far behind the last
short word of the text (which crosses words, and tells languages and phrases apart).

1. The contexts inside the word are combined in the logistic domain by weights that a gate picks (how much evidence the longest
   contexts have); the result is refined by an adaptive map of probabilities. All texts of a block share this work word by word.
2. At every occurrence the crossing context is mixed in, by weights gated by its evidence. These are learned online within the text:
   they change after chunks of tokens whose lengths grow from CHUNK by a fixed ratio, so only earlier tokens count.
3. The word's probability is the product over its decisions, mixed with the share of the word in all training texts (exact counts
   of the whole corpus) and in the text's own past; the shares of the three are weighed by how well each choice did so far (an
   exact Bayesian mixture).

Weights and map are learned online from all training texts: each is predicted from what the task has counted before, then counted.
Tasks' counts are added up, their weights averaged by evidence. Tables of contexts are sized by the corpus up to MOST_BITS; the
late decisions of a word enter its own context's table when a task has it for the second time, so that words of a single
occurrence do not crowd them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored

#: Texts that share a vocabulary while scored; memory is bounded by this and the longest text.
BLOCK_BYTES, BLOCK_DOCS = 3_000_000, 4000
#: A task's first block; each next one may be twice as long, so that weights are learned from some evidence early on.
FIRST_BYTES = 1 << 15
CODES = 1 << 14  # contexts of the byte code, by a hash of three bytes
ORDERS = (3, 5)  # bytes; after these tables the one of the whole prefix, then of the prefix behind the last short word
TABLES = len(ORDERS) + 2
HEAD = 4  # bytes of a word that the last short word before it helps to predict
SHORT = 3  # bytes of a short word, at most
FEWEST_BITS, MOST_BITS = 14, 21  # slots of each context's table, as a power of two
GATES, LATE = 24, 16  # gates of step 1 and of step 2
CHUNK, GROWTH = 16, 1.25  # tokens to the first change of a text's own weights, and how chunks grow
SHARES = ((0.1, 0.005), (0.1, 0.05), (0.5, 0.005), (0.5, 0.05))  # of exact counts, of the text's own past
KEEP = 0.9  # of the curvature behind the weights, from step to step
PRIOR = 100.0  # of a text's own weights: as if learned from some hundred decisions
SLICE = 1000  # words of texts that are predicted at once
SHARED = 8  # bytes by which words of a vocabulary share their work
BYTES = 5_000  # bytes of a vocabulary that are predicted at once
SEEN_BITS = 24  # of the table of hashes of words that a task has had
TASK_BYTES = 48_000_000  # of packed blocks that one task learns from
PIECES = 128  # rows in which tables of counts move
BUCKET = 2_000_000  # words of blocks whose counts are added up in one task
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
C4, C5 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words; bytes.split knows the same white space as the contract: space and 9 to 13."""
    return (text or b"").lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def bytes_of(words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words: each closed by a space, the end token before them. The bytes, each one's place in its word, and each word's size."""
    data = np.frombuffer(b"\n" + words, np.uint8)
    ends = np.flatnonzero(data == 32)
    sizes = np.diff(np.concatenate([[-1, 0], ends]))
    starts = np.cumsum(sizes) - sizes
    return data, np.arange(len(data)) - np.repeat(starts, sizes), sizes


def before(data: np.ndarray, at: np.ndarray, place: np.ndarray, back: int) -> np.ndarray:
    """Of the bytes at some places of data, the byte `back` bytes earlier in the word plus one, 0 where the word begins later."""
    out = data[np.maximum(at - back, 0)].astype(np.uint64)
    out += np.uint64(1)
    out[place < back] = 0
    return out


def code_context(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    return (((one * np.uint64(257) + two) * np.uint64(257) + three) * C1 >> np.uint64(50)).view(np.int64)


def code_counts(words: bytes, counts: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Adds to `into`, (CODES * 256), how often each byte follows each context of the code; counts: of the words, the end token first."""
    data, place, sizes = bytes_of(words)
    context = code_context(*(before(data, np.arange(len(data)), place, back) for back in (1, 2, 3)))
    np.add.at(into, context * 256 + data, np.repeat(counts, sizes).astype(into.dtype))
    return into


def huffman(weights: list[float]) -> list[int]:
    """Code lengths by two queues: leaves by rising weight, and joined nodes, whose weights rise by themselves."""
    order = sorted(range(len(weights)), key=weights.__getitem__)
    n = len(order)
    value, parent = [weights[k] for k in order], [0] * (2 * n - 1)
    leaf, joined = 0, n
    for node in range(n, 2 * n - 1):
        total = 0.0
        for _ in range(2):
            if leaf < n and (joined >= node or value[leaf] <= value[joined]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, joined = joined, joined + 1
            parent[pick] = node
            total += value[pick]
        value.append(total)
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    out = [0] * n
    for at, k in enumerate(order):
        out[k] = depth[at]
    return out


def code_tables(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical code and its length, by context and byte. Bytes not seen behind a context stand by how common they are in all."""
    counts = counts.reshape(CODES, 256)
    share = counts.sum(axis=0) + 1
    share /= share.sum()
    lengths = np.full((CODES, 256), huffman(np.maximum(share, 1 / 4096).tolist()), np.uint8)
    for ctx in np.flatnonzero(counts.sum(axis=1)):
        row = counts[ctx]
        lengths[ctx] = huffman((row + ((row > 0).sum() + row.sum() / 1024) * np.maximum(share, 1 / 4096)).tolist())
    order = np.argsort(lengths, axis=1, kind="stable")
    sizes = np.take_along_axis(lengths, order, axis=1).astype(np.int64)
    codes, now = np.zeros((CODES, 256), np.uint32), np.zeros(CODES, np.uint32)
    for k in range(256):
        if k:
            now = (now + np.uint32(1)) << (sizes[:, k] - sizes[:, k - 1]).astype(np.uint32)
        codes[np.arange(CODES), order[:, k]] = now
    return codes.reshape(-1), lengths.reshape(-1)


@dataclass
class Tree:
    """A vocabulary's words by their first SHARED bytes, so that a byte that neighbours have in common, with all before it, comes up once.

    Words stand in `order`; each brings the bytes from place `shared` on. Of these bytes: the place in data and in the word, a hash of
    the word so far, the first word with it and the one behind the last.
    """

    data: np.ndarray
    order: np.ndarray
    sizes: np.ndarray
    shared: np.ndarray
    first: np.ndarray  # the word's first byte of its own
    at: np.ndarray
    place: np.ndarray
    prefix: np.ndarray
    word: np.ndarray
    end: np.ndarray

    def sums(self, amounts: np.ndarray) -> np.ndarray:
        """By byte, the sum over the words that have it. amounts: in the vocabulary's order."""
        total = np.concatenate([[0], np.cumsum(amounts[self.order])])
        return total[self.end] - total[self.word]

    def source(self, place: int) -> np.ndarray:
        """By word, the number of its byte at a place below SHARED (of some other byte where the word has none there)."""
        owner = np.maximum.accumulate(np.where(self.shared <= place, np.arange(len(self.order)), 0))
        return np.minimum(self.first[owner] + place - self.shared[owner], len(self.at) - 1)


def tree_of(words: bytes) -> Tree:
    data, place, sizes = bytes_of(words)
    starts, n = np.cumsum(sizes) - sizes, len(sizes)
    # the whole prefix: a polynomial of the bytes, taken from running sums so that no word is walked by itself
    power = np.cumprod(np.full(int(place.max()) + 2, C3, np.uint64))
    terms = np.cumsum((data + np.uint64(1)) * power[place])
    prefix = np.concatenate([np.zeros(1, np.uint64), terms[:-1]]) - np.repeat(np.where(starts > 0, terms[starts - 1], np.uint64(0)), sizes)
    prefix[place == 0] = 0
    key = np.zeros(n, np.uint64)
    for p in range(SHARED):
        some = np.flatnonzero(sizes > p)
        key[some] |= data[starts[some] + p].astype(np.uint64) << np.uint64(56 - 8 * p)
    order = np.argsort(key, kind="stable")
    key, starts, sizes = key[order], starts[order], sizes[order]
    apart = key[1:] ^ key[:-1]
    shared = np.concatenate([[0], sum((apart < np.uint64(1 << (56 - 8 * p))).astype(np.int64) for p in range(SHARED))])
    own = sizes - shared
    first = np.cumsum(own) - own
    word = np.repeat(np.arange(n), own)
    at_place = np.arange(len(word)) - np.repeat(first - shared, own)
    at = np.repeat(starts, own) + at_place
    # words with one byte in common, and all before it, are neighbours
    nexts = np.repeat(np.arange(1, n + 1)[None], SHARED, axis=0)
    for p in range(SHARED):
        begin = np.flatnonzero(shared <= p)
        nexts[p, begin] = np.append(begin[1:], n)
    end = np.where(at_place < SHARED, nexts[np.minimum(at_place, SHARED - 1), word], word + 1)
    return Tree(data, order, sizes, shared, first, at, at_place, prefix[at], word, end)


@dataclass
class Spelled:
    """The decisions of some bytes of a tree: how many each byte has, and by decision its outcome and the hash of each context."""

    size: np.ndarray
    bit: np.ndarray
    keys: list[np.ndarray]  # the last one for the whole prefix


def spelled(tree: Tree, some: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> Spelled:
    at, place, prefix = tree.at[some], tree.place[some], tree.prefix[some]
    earlier = [before(tree.data, at, place, back) for back in range(1, max(ORDERS) + 1)]
    contexts, h, done = [], np.zeros(len(at), np.uint64), 0
    for order in ORDERS:
        for back in range(done, order):
            h = (h ^ earlier[back]) * C1
            h ^= h >> np.uint64(31)
        done = order
        contexts.append(h * C2 + np.uint64(order))
    contexts.append((prefix ^ (prefix >> np.uint64(32))) * C1 + place.astype(np.uint64))
    cell = code_context(*earlier[:3]) * 256 + tree.data[at]
    size = lengths[cell].astype(np.int64)
    mine, ends = np.repeat(codes[cell], size), np.cumsum(size)
    k = np.arange(len(mine), dtype=np.uint32) - np.repeat((ends - size).astype(np.uint32), size)
    left = np.repeat(size.astype(np.uint32), size) - k
    bit = ((mine >> (left - np.uint32(1))) & np.uint32(1)).astype(np.int8)
    node = ((mine >> left) | (np.uint32(1) << k)) * C4
    keys = []
    for c in contexts:
        key = np.repeat((c >> np.uint64(32)).astype(np.uint32), size)
        key += node
        keys.append(key)
    return Spelled(size, bit, keys)


@dataclass
class Known:
    """What step 2 needs of a vocabulary: by word, its early decisions (about its first HEAD bytes) as a place and a number, and the
    logarithm of the probability of its other decisions; by early decision what told() gives."""

    first: np.ndarray
    size: np.ndarray
    rest: np.ndarray
    early: np.ndarray


def known_of(tree: Tree, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Known:
    """pieces: bytes, and told() of them."""
    size, rest = np.zeros(len(tree.at), np.int64), np.zeros(len(tree.at))
    for some, n, _, logs in pieces:
        size[some], rest[some] = n, logs
    early = np.concatenate([x for _, _, x, _ in pieces])
    begin = np.cumsum(size) - size
    heads = np.stack([np.where(tree.sizes > p, tree.source(p), -1) for p in range(HEAD)], axis=1)
    n = np.where(heads >= 0, size[heads], 0)
    flat, each = heads[heads >= 0], n[heads >= 0]
    ends = np.cumsum(each)
    expanded = np.repeat(begin[flat] - (ends - each), each) + np.arange(ends[-1])
    # the rest: shared bytes by place, then the word's own ones in a row
    run = np.concatenate([[0.0], np.cumsum(rest)])
    last = tree.first + tree.sizes - tree.shared
    total = run[last] - run[np.minimum(tree.first + np.maximum(SHARED - tree.shared, 0), last)]
    for p in range(HEAD, SHARED):
        total += np.where(tree.sizes > p, rest[tree.source(p)], 0)
    count = n.sum(axis=1)
    out = Known(np.empty_like(count), np.empty_like(count), np.empty_like(total), early[expanded])
    out.first[tree.order], out.size[tree.order], out.rest[tree.order] = np.cumsum(count) - count, count, total
    return out


def told(place: np.ndarray, s: Spelled, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some bytes: how many early decisions each has; of those, in 64 bits each, the key of the whole prefix and step 1's logit
    with the outcome as its last bit; and the logarithm of each byte's probability by other decisions."""
    is_early = place < HEAD
    early = np.repeat(is_early, s.size)
    out = np.empty((int(early.sum()), 2), np.uint32)
    out[:, 0] = s.keys[-1][early]
    out[:, 1] = (mixed[early].view(np.uint32) & np.uint32(0xFFFFFFFE)) | s.bit[early].view(np.uint8)
    right = np.log1p(-np.abs(s.bit - squash(np.clip(mixed, -16, 16))))
    logs = np.add.reduceat(right, np.cumsum(s.size) - s.size)
    return np.where(is_early, s.size, 0), out.view(np.uint64).reshape(-1), np.where(is_early, 0, logs)


def heard(known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key, logit and outcome that told() gave."""
    parts = known.view(np.uint32).reshape(-1, 2)
    second = parts[:, 1].copy()
    return parts[:, 0], second.view(np.float32), (second & np.uint32(1)).astype(np.int8)


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys ^ (keys >> np.uint32(15))) * C5 >> np.uint32(32 - bits)).astype(np.int64)


def evidence(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """0 to 15: twice the logarithm of how often a slot was counted."""
    return np.minimum(2 * np.log2(n0 + n1 + np.float32(1)), 15).astype(np.int64)


def stretched(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + np.float32(0.3)) / (n0 + np.float32(0.3)))


def outcomes(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the bit was 0 and 1, from pairs of 32-bit counts read as one number."""
    return (both & np.uint64(0xFFFFFFFF)).astype(np.float32), (both >> np.uint64(32)).astype(np.float32)


def packed(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Prediction and evidence in 16 bits."""
    q = np.clip(np.rint(stretched(n0, n1) * 64), -1023, 1023).astype(np.int32) + 1024
    return (q * 16 + evidence(n0, n1)).astype(np.uint16)


def tables_of(n: np.ndarray) -> np.ndarray:
    return np.stack([packed(*outcomes(row.view("<u8"))) for row in n])


def unpacked(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ((v >> 4).astype(np.float32) - np.float32(1024)) * np.float32(1 / 64), (v & 15).astype(np.int64)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


LEVELS = np.minimum((np.arange(16) + 2) // 3, 5)


def gate(prefix: np.ndarray, part: np.ndarray) -> np.ndarray:
    """By the evidence of the whole prefix (6 levels) and of its last bytes (4 levels)."""
    return LEVELS[prefix] * 4 + np.minimum((part + 3) >> 2, 3)


def refined(mixed: np.ndarray, g: np.ndarray, ones: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Half the mixed logit, half that of the map's frequencies around it."""
    place = (np.clip(mixed, -7.99, 7.99) + 8) * 2
    low = place.astype(np.int64)
    part = (place - low).astype(np.float32)
    middle = squash(np.arange(33) / 2 - 8)
    table = (ones + 20 * middle) / (hits + 20)
    table = (0.5 * np.log(table / (1 - table))).astype(np.float32).ravel()
    low += g * 33
    left = table[low]
    return np.float32(0.5) * mixed + left + part * (table[low + 1] - left)


@dataclass
class Weights:
    """What is learned besides counts. `sure` and `late_sure` sum up curvature: how much each weight was learned from."""

    early: np.ndarray
    late: np.ndarray
    sure: np.ndarray
    late_sure: np.ndarray
    ones: np.ndarray
    hits: np.ndarray

    @staticmethod
    def new() -> Weights:
        late = np.stack([np.linspace(1, 0.4, LATE), np.linspace(0, 0.6, LATE)], axis=1)
        return Weights(np.full((GATES, TABLES - 1), 0.25), late, np.full((GATES, TABLES - 1), 10.0), np.full((LATE, 2), 10.0), np.zeros((GATES, 33)), np.zeros((GATES, 33)))

    def flat(self) -> np.ndarray:
        """What adds up over tasks."""
        return np.concatenate([a.ravel() for a in (self.early * self.sure, self.late * self.late_sure, self.sure, self.late_sure, self.ones, self.hits)])

    @staticmethod
    def of(flat: np.ndarray) -> Weights:
        shapes = ((GATES, TABLES - 1), (LATE, 2), (GATES, TABLES - 1), (LATE, 2), (GATES, 33), (GATES, 33))
        parts, at = [], 0
        for shape in shapes:
            n = math.prod(shape)
            parts.append(flat[at : at + n].reshape(shape))
            at += n
        early, late, sure, late_sure, ones, hits = parts
        return Weights(early / sure, late / late_sure, sure, late_sure, ones, hits)


def learn(w: np.ndarray, sure: np.ndarray, g: np.ndarray, x: list[np.ndarray], error: np.ndarray, curve: np.ndarray) -> None:
    """One online step of the weights of every gate in g: gradient over the curvature of the last steps."""
    n = len(w)
    np.maximum(sure * KEEP, 10, out=sure)
    for k, column in enumerate(x):
        sure[:, k] += np.bincount(g, curve * column * column, n)
        w[:, k] += np.bincount(g, error * column, n) / sure[:, k]


class Trainer:
    """Counts and weights of one task."""

    def __init__(self, bits: int, codes: np.ndarray, lengths: np.ndarray):
        self.bits, self.codes, self.lengths = bits, codes, lengths
        self.n = np.zeros((TABLES, 2 << bits), np.uint32)  # by slot, how often the bit was 0, and 1
        self.both = self.n.view("<u8")
        self.weights = Weights.new()
        self.seen = np.zeros(1 << SEEN_BITS, bool)  # by hash, words of earlier blocks

    def again(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which words this task has had before, in this block or an earlier one."""
        place = (hashes >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
        out = (counts > 1) | ((counts > 0) & self.seen[place])
        self.seen[place[counts > 0]] = True
        return out

    def block(self, words: bytes, hashes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> None:
        """counts: of each word in the training texts of this block. Words are predicted before they are counted, slice by slice."""
        if not held.all():
            self.learned(words, hashes, counts, tokens, sizes, held)

    def learned(self, words: bytes, hashes: np.ndarray, counts: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> None:
        tree, again = tree_of(words), self.again(hashes, counts)
        weight, types = tree.sums(counts), tree.sums(counts > 0)
        often = np.where(tree.place < HEAD, weight, tree.sums(counts * again))
        taught = np.flatnonzero(weight > 0)  # other bytes are of held-out texts only
        parts = np.split(taught, np.arange(BYTES, len(taught), BYTES))
        pieces: list = [None] * len(parts)
        # neighbours in the tree are alike, so its parts teach in a random order
        for k in np.random.default_rng(len(taught)).permutation(len(parts)).tolist():
            some = parts[k]
            s = spelled(tree, some, self.codes, self.lengths)
            pieces[k] = (some, *told(tree.place[some], s, self.inside(s, weight[some], types[some], often[some])))
        known = known_of(tree, pieces)
        lead = short_before(tokens, sizes, hashes, bytes_sizes(words))
        teach = np.flatnonzero(np.repeat(~held, sizes))
        w = self.weights
        for at in range(0, len(teach), SLICE):
            pick = teach[at : at + SLICE]
            d, n = decisions(known, tokens[pick])
            key, mixed, bit = heard(known.early[d])
            place = slots(key ^ np.repeat(lead[pick], n), self.bits)
            pair = outcomes(self.both[-1][place])
            x, g = [mixed, stretched(*pair)], evidence(*pair)
            late = w.late.T.astype(np.float32)
            p = squash(late[0][g] * x[0] + late[1][g] * x[1])
            learn(w.late, w.late_sure, g, x, bit - p, p * (1 - p) * 2)
            np.add.at(self.n[-1], 2 * place + bit, np.uint32(1))

    def inside(self, s: Spelled, weight: np.ndarray, types: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Step 1 of some bytes, which are then learned from and counted. Amounts by byte: occurrences, words, and occurrences of which
        the table of whole prefixes hears."""
        w, bit = self.weights, s.bit
        weight = np.repeat(weight.astype(np.float32), s.size)
        where = [slots(key, self.bits) for key in s.keys]
        n = [outcomes(self.both[i][place]) for i, place in enumerate(where)]
        x = [stretched(*pair) for pair in n]
        g = gate(evidence(*n[-1]), evidence(*n[-2]))
        early = w.early.T.astype(np.float32)
        m = sum(early[i][g] * x[i] for i in range(TABLES - 1))
        p = squash(m)
        out = refined(m, g, w.ones, w.hits)
        learn(w.early, w.sure, g, x, weight * (bit - p), weight * (p * (1 - p)) * (TABLES - 1))
        cell = g * 33 + ((np.clip(m, -7.99, 7.99) + 8) * 2 + 0.5).astype(np.int64)
        w.hits += np.bincount(cell, weight, GATES * 33).reshape(GATES, 33)
        w.ones += np.bincount(cell, weight * bit, GATES * 33).reshape(GATES, 33)
        once, often = np.repeat(types.astype(np.uint32), s.size), np.repeat(often.astype(np.uint32), s.size)
        for i, place in enumerate(where):
            np.add.at(self.n[i], 2 * place + bit, often if i == TABLES - 2 else once)
        return out


def bytes_sizes(words: bytes) -> np.ndarray:
    """The bytes of each word without the closing space; the end token counts as long."""
    return np.concatenate([[SHORT + 1], bytes_of(words)[2][1:] - 1])


def decisions(known: Known, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The early decisions of tokens in order, and how many each token has."""
    n = known.size[token]
    ends = np.cumsum(n)
    d = np.repeat(known.first[token] - (ends - n), n)
    d += np.arange(len(d))
    return d, n


def short_before(tokens: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """By token, a hash of the last short word before it in its text; 0 where there is none."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(tokens))
    last = np.maximum.accumulate(np.where(length[tokens] <= SHORT, at, -1))
    last = np.concatenate([[-1], last[:-1]])
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    return np.where(last >= starts, h[tokens[np.maximum(last, 0)]], np.uint32(0))


@dataclass
class Model:
    """bits of a slot number; the byte code; by table and slot, prediction and evidence; weights; training tokens, distinct ones."""

    bits: int
    codes: np.ndarray
    lengths: np.ndarray
    tables: np.ndarray
    weights: Weights
    tokens: int
    distinct: int

    def inside(self, s: Spelled) -> np.ndarray:
        """Step 1 for every decision of a slice of a vocabulary."""
        early = self.weights.early.T.astype(np.float32)
        got = [unpacked(self.tables[i][slots(key, self.bits)]) for i, key in enumerate(s.keys)]
        g = gate(got[-1][1], got[-2][1])
        return refined(sum(early[i][g] * x for i, (x, _) in enumerate(got)), g, self.weights.ones, self.weights.hits)

    def texts(self, words: bytes, hashes: np.ndarray, exact: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of each text's probability. exact: count of each word of the vocabulary in all training texts."""
        tree, pieces = tree_of(words), []
        for at in range(0, len(tree.at), BYTES):
            some = np.arange(at, min(at + BYTES, len(tree.at)))
            s = spelled(tree, some, self.codes, self.lengths)
            pieces.append((some, *told(tree.place[some], s, self.inside(s))))
        known = known_of(tree, pieces)
        del tree, pieces
        lead = short_before(tokens, sizes, hashes, bytes_sizes(words))
        late = self.weights.late.T.astype(np.float32)
        starts = np.cumsum(sizes) - sizes
        own = np.ones((2, len(sizes)), np.float32)  # each text's own factors of the two inputs
        sure = np.full((2, len(sizes)), PRIOR, np.float32)
        logs = np.empty(len(tokens), np.float32)
        order = np.argsort(-sizes, kind="stable")
        sorted_sizes = sizes[order]
        lo, step = 0, float(CHUNK)
        longest = int(sizes.max())
        while lo < longest:
            hi = min(lo + int(step), longest)
            active = order[: np.searchsorted(-sorted_sizes, -lo)]  # texts of more than lo tokens
            n = np.minimum(sizes[active], hi) - lo
            # some texts at a time, so that arrays stay small
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // SLICE)) + 1
            for docs, m in zip(np.split(active, cuts), np.split(n, cuts)):
                ends = np.cumsum(m)
                at = np.arange(ends[-1]) + np.repeat(starts[docs] + lo - (ends - m), m)
                d, each = decisions(known, tokens[at])
                heads = np.cumsum(each) - each
                by = heads[ends - m]
                total = np.add.reduceat(each, ends - m)
                key, mixed, bit = heard(known.early[d])
                v, seen = unpacked(self.tables[-1][slots(key ^ np.repeat(lead[at], each), self.bits)])
                x0, x1 = late[0][seen] * mixed, late[1][seen] * v
                z = np.repeat(own[0, docs], total) * x0 + np.repeat(own[1, docs], total) * x1
                np.clip(z, -16, 16, out=z)
                p = squash(z)
                error = bit - p
                logs[at] = np.add.reduceat(np.log1p(-np.abs(error)), heads) + known.rest[tokens[at]]
                if hi < longest:
                    curve = p * (1 - p)
                    for k, x in enumerate((x0, x1)):
                        sure[k, docs] += 2 * np.add.reduceat(curve * x * x, by)
                        own[k, docs] += np.add.reduceat(error * x, by) / sure[k, docs]
            lo, step = hi, step * GROWTH
        return self.mixture(logs, exact, tokens, sizes)

    def mixture(self, logs: np.ndarray, exact: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Step 3, from the logarithms of the tokens' probabilities by bits."""
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        key = owner * np.int64(len(exact)) + tokens
        by = np.argsort(key, kind="stable")
        at = np.arange(len(key))
        fresh = np.concatenate([[True], np.diff(key[by]) != 0])[: len(key)]
        earlier = np.empty(len(key))
        earlier[by] = at - np.maximum.accumulate(np.where(fresh, at, 0))
        since = at - starts[owner]
        past = earlier / np.maximum(since, 1)
        bits, share = np.exp(logs.astype(float)), (exact / max(self.tokens, 1))[tokens]
        options = []
        for counted, repeated in SHARES:
            counted = counted if self.tokens else 0.0
            spelt = np.where(since > 0, (1 - repeated) * (1 - counted), 1 - counted)
            other = np.where(since > 0, repeated * past + (1 - repeated) * counted * share, counted * share)
            # a word of hundreds of bytes may be too unlikely for a double: its logarithm is added then
            p = np.log(np.maximum(other + spelt * bits, 1e-300))
            options.append(np.add.reduceat(np.where((other == 0) & (logs < -600), np.log(spelt) + logs, p), starts))
        options = np.stack(options)
        top = options.max(axis=0)
        return (top + np.log(np.exp(options - top).mean(axis=0))) / math.log(10)


def press(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: most high bytes are zero."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpress(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


@contextmanager
def one_by_one(spark):
    """Blocks are rows of some megabytes: jobs that run inside hand them to Python a few at a time, not by thousands."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before_ = spark.conf.get(setting)
    spark.conf.set(setting, "4")
    try:
        yield
    finally:
        spark.conf.set(setting, before_)


BLOCK = "block long, ids binary, nulls binary, held binary, sizes binary, tokens binary, words binary, hashes binary, counts binary, n long"


def blocks_of(docs: DataFrame) -> DataFrame:
    """Texts as numbers into their block's vocabulary; the vocabulary's hashes and counts in the block's training texts; n: its size.

    Each task's last row has a negative block and, as its tokens, how often bytes follow contexts of the code in training texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        index: defaultdict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        index[b""]  # the end token
        ids, held, texts, size = [], [], [], 0
        code = np.zeros(CODES * 256)

        def block() -> pa.RecordBatch:
            nonlocal ids, held, texts, size, number
            sizes = np.array([len(t) for t in texts], np.int64)
            tokens, out = np.concatenate(texts), np.array(held)
            vocabulary = list(index)
            counts = np.bincount(tokens[np.repeat(~out, sizes)], minlength=len(vocabulary))
            joined = b"".join([w + b" " for w in vocabulary[1:]])
            code_counts(joined, counts, code)
            hashes = hashes_of(vocabulary)
            row = [
                (part << 32) + number, press(np.array([i or 0 for i in ids], np.int64)), bytes(i is None for i in ids), out.tobytes(), press(sizes), press(tokens), zstandard.ZstdCompressor(level=1).compress(joined),
                hashes.tobytes(), press(counts.astype(np.int32)), len(vocabulary),
            ]
            number += 1
            ids, held, texts, size = [], [], [], 0
            index.clear()
            index[b""]
            return made(row)

        def made(row: list) -> pa.RecordBatch:
            kinds = [pa.int64(), *[pa.binary()] * 8, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, out, text = (batch.column(c)[row].as_py() for c in ("id", "held", "text"))
                words = words_of(text)
                words.append(b"")
                texts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                held.append(out)
                size += len(text or b"")
                if size >= min(BLOCK_BYTES, FIRST_BYTES << min(number, 20)) or len(ids) >= BLOCK_DOCS:
                    yield block()
        if ids:
            yield block()
        if code.any():
            yield made([-1 - part, b"", b"", b"", b"", press(code.astype(np.uint64)), b"", b"", b"", 0])

    return docs.mapInArrow(run, BLOCK)


def added(parts: DataFrame, kind: type, into: type) -> DataFrame:
    """(piece, data) from (piece, data): arrays of equal pieces added up; a task holds one sum and one array. Twice, by a salt first.

    kind, into: of the numbers that come in and go out; those of negative pieces are doubles."""

    def run_of(kind: type):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total = None, np.empty(0)
            for batch in batches:
                for row in range(batch.num_rows):
                    key = batch.column("piece")[row].as_py(), batch.column("salt")[row].as_py()
                    data = unpress(batch.column("data")[row].as_py(), kind if key[0] >= 0 else np.float64)
                    if key == now:
                        total += data
                        continue
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({"piece": pa.array([now[0]], pa.int32()), "data": [press(total)]})
                    now, total = key, data.astype(into if key[0] >= 0 else np.float64)
            if now is not None:
                yield pa.RecordBatch.from_pydict({"piece": pa.array([now[0]], pa.int32()), "data": [press(total)]})

        return run

    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    for k in (kind, into):
        parts = parts.repartition("piece", "salt").sortWithinPartitions("piece", "salt").mapInArrow(run_of(k), "piece int, data binary").withColumn("salt", F.lit(0))
    return parts.select("piece", "data")


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by bucket, and each one's bucket in that order."""
    which = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(which, kind="stable")
    return order, which[order]


def exact_counts(blocks: DataFrame) -> tuple[DataFrame, int, int, int]:
    """(block, known): counts of each word of the block's vocabulary in all training texts; training tokens, distinct ones, buckets.

    Blocks deal the hashes of their words over buckets, a row for each bucket that gets some; a bucket adds its words up and answers
    each block. Two words with one hash of 64 bits would be taken for one: among n words with chance n * n / 2**65.
    """
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("hashes")[row].as_py(), np.uint64)
                counts = unpress(batch.column("counts")[row].as_py(), np.int32)
                order, which = dealt(hashes, buckets)
                heads = np.flatnonzero(np.diff(which, prepend=-1))
                parts = np.split(order, heads[1:])
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(which[heads], pa.int32()), "block": pa.array([batch.column("block")[row].as_py()] * len(parts), pa.int64()),
                        "hashes": pa.array([hashes[k].tobytes() for k in parts], pa.binary()), "counts": pa.array([press(counts[k]) for k in parts], pa.binary()),
                    }
                )

    def add(group: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(v.as_py(), np.uint64) for v in group.column("hashes")]
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.bincount(inverse, np.concatenate([unpress(v.as_py(), np.int32) for v in group.column("counts")])).astype(np.int64)
        known = [press(part) for part in np.split(sums[inverse], np.cumsum([len(h) for h in hashes])[:-1])]
        rest = [0] * (len(known) - 1)
        return pa.table(
            {
                "block": group.column("block").combine_chunks(), "bucket": group.column("bucket").combine_chunks(), "known": pa.array(known, pa.binary()),
                "tokens": pa.array([int(sums.sum()), *rest], pa.int64()), "distinct": pa.array([int((sums > 0).sum()), *rest], pa.int64()),
            }
        )

    rows = blocks.select("block", "hashes", "counts").mapInArrow(deal, "bucket int, block long, hashes binary, counts binary")
    answers = stored(rows.groupBy("bucket").applyInArrow(add, "block long, bucket int, known binary, tokens long, distinct long"), "lm-counts")
    sums = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    known = answers.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "known"))), lambda x: x["known"]).alias("known"))
    return known, sums[0], sums[1], buckets


def fitted(blocks: DataFrame, extra: DataFrame, tokens: int, distinct: int) -> Model:
    """The model from all blocks. Tables have 4 slots a distinct word and more, up to 2 ** MOST_BITS, so memory is bounded."""
    bits = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(max(1, distinct) * 4))))
    got = added(extra.select(F.lit(0).alias("piece"), F.col("tokens").alias("data")), np.uint64, np.uint64).collect()
    codes, lengths = code_tables(unpress(got[0]["data"], np.uint64).astype(float) if got else np.zeros(CODES * 256))
    code = blocks.sparkSession.sparkContext.broadcast((codes, lengths))
    width = (TABLES * 2 << bits) // PIECES

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        for batch in batches:
            for row in range(batch.num_rows):
                trainer = trainer or Trainer(bits, *code.value)
                trainer.block(*block_of(batch, row), held=np.frombuffer(batch.column("held")[row].as_py(), bool))
        if trainer is not None:
            flat = trainer.n.reshape(-1)
            for k in range(PIECES):
                part = flat[k * width : (k + 1) * width]
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "data": [press(part)]})
            yield pa.RecordBatch.from_pydict({"piece": pa.array([-1], pa.int32()), "data": [press(trainer.weights.flat())]})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column("data")[row].as_py()
                if batch.column("piece")[row].as_py() >= 0:
                    n = unpress(data, np.uint64).reshape(-1, 2).astype(np.float32)
                    data = press(packed(n[:, 0], n[:, 1]))
                yield pa.RecordBatch.from_pydict({"piece": batch.column("piece")[row : row + 1], "data": [data]})

    # a task's tables are its output, so tasks are few enough for tables to be small beside texts
    size = blocks.agg(F.sum(F.length("tokens") + F.length("words"))).first()[0] or 0
    parts = blocks.select("block", "held", "sizes", "tokens", "words", "hashes", "counts").coalesce(max(1, -(-size // TASK_BYTES))).mapInArrow(train, "piece int, data binary")
    weights, tables = Weights.new(), np.full(TABLES << bits, packed(np.zeros(1, np.float32), np.zeros(1, np.float32))[0], np.uint16)
    for row in added(parts, np.uint32, np.uint64).mapInArrow(finish, "piece int, data binary").collect():  # of one size for any corpus
        if row["piece"] < 0:
            weights = Weights.of(unpress(row["data"], np.float64))
        else:
            tables[row["piece"] * width // 2 : (row["piece"] + 1) * width // 2] = unpress(row["data"], np.uint16)
    return Model(bits, codes, lengths, tables.reshape(TABLES, -1), weights, tokens, distinct)


def block_of(batch: pa.RecordBatch, row: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, hashes, counts, tokens, sizes"""
    get = lambda c: batch.column(c)[row].as_py()
    return (
        zstandard.ZstdDecompressor().decompress(get("words")), np.frombuffer(get("hashes"), np.uint64), unpress(get("counts"), np.int32),
        unpress(get("tokens"), np.int32), unpress(get("sizes"), np.int64),
    )


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Training counts come from all documents whose fold is not held_out; a null id is in no fold and counts. Null and empty
    texts are the end token alone. Repeated rows count and are scored each. base_score is the unigram's. score is the log10
    probability of the text as its words spelled out and the end. bits_per_byte is the score in bits over n_bytes, the bytes of
    the words, each with its closing space, and the end. Only the two named columns are read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    held = F.coalesce(fold(F.col(f"`{id_col}`")) == held_out, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), held.alias("held"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    everything = stored(blocks_of(rows), "lm-blocks")
    blocks, extra = everything.where("block >= 0"), everything.where("block < 0")
    with one_by_one(spark):
        known, tokens, distinct, buckets = exact_counts(blocks)
        model = spark.sparkContext.broadcast(fitted(blocks, extra, tokens, distinct))
    N, V = float(tokens), float(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                words, token, sizes = zstandard.ZstdDecompressor().decompress(get("words")), unpress(get("tokens"), np.int32), unpress(get("sizes"), np.int64)
                hashes = hashes_of([b"", *words.split()])
                exact = np.empty(len(hashes), np.int64)
                exact[dealt(hashes, buckets)[0]] = np.concatenate([unpress(v, np.int64) for v in get("known")])
                total = model.value.texts(words, hashes, exact, token, sizes)
                base = np.log10((exact + 0.5) / (N + 0.5 * (V + 1)))
                starts = np.cumsum(sizes) - sizes
                n_bytes = np.add.reduceat(bytes_of(words)[2][token], starts)  # the end token's size is 1
                nulls = np.frombuffer(get("nulls"), bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(unpress(get("ids"), np.int64), mask=nulls), pa.array(np.frombuffer(get("held"), bool)), pa.array(sizes),
                        pa.array(np.add.reduceat((exact > 0)[token].astype(np.int64), starts)), pa.array(np.full(len(sizes), tokens), pa.int64()), pa.array(np.add.reduceat(base[token], starts)),
                        pa.array(total), pa.array(n_bytes.astype(np.int64)), pa.array(-total * math.log2(10) / n_bytes),
                    ],
                    [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
                )

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    with one_by_one(spark):
        return stored(blocks.select("block", "ids", "nulls", "held", "sizes", "tokens", "words").join(known, "block").mapInArrow(run, schema), "lm-scores")
