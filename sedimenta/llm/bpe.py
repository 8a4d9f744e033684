"""Byte-level BPE by ranks: merges are replayed over all new words of a block of texts at once, and ids are decoded again.

Words are the matches of the splitting pattern. The distinct words of a block that are not remembered are laid out as one array of
byte symbols; an inverted index leads from a pair's rank to the places where the pair stands in any of them. Ranks are taken
in ascending order, each merge is applied at all its places, and only the pairs with the two neighbours of a place are
looked up anew. A merge that makes a pair of lower rank is answered within its word first, so each word's merges come in just the order in
which it alone would be merged.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _NONE, LONGEST, Encoder, path

#: Pieces remembered by a worker process.
MEMORY = 500_000
#: Bytes of text of a block.
BLOCK = 8_000_000


class Codec(Encoder):
    """Texts to ids (little-endian unsigned 32-bit bytes) and back by a file of ranks.

    file: a file of base64 tokens and ranks; a name without a slash is one of the public tokenizers.
    Texts are first cut at spaces before visible characters, where the public pattern always cuts, and such pieces are remembered.
    """

    def __init__(self, file: str, memory: int = MEMORY):
        import public_tokenizers

        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        with open(file if "/" in file else path(file), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self.pairs = np.array(pairs, np.int64)  # ranks of pairs of bytes
        self.joined: dict[int, int] = {}  # ranks of pairs of ids, -1 for none
        self.whole, self.added = None, ()
        self.memory = memory
        self.known: dict[str, bytes] = {_NONE: b""}
        self.opened: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}  # of words within pieces

    def _rank(self, a: int, b: int) -> int:
        key = a << 32 | b
        rank = self.joined.get(key)
        if rank is None:
            if len(self.joined) >= 4_000_000:
                self.joined.clear()
            rank = self.joined[key] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
        return rank

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (none of them empty)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        last = ends.tolist()
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        first = np.full(n, -1, np.int64)  # the rank of the pair that begins at each byte
        first[:-1] = self.pairs[raw[:-1], raw[1:]]
        first[ends - 1] = -1
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[ends - sizes] = -1
        symbol, after, before = self.bytes[raw].tolist(), after.tolist(), before.tolist()
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        at = first[places]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else at
        index = {int(at[s]): part.tolist() for s, part in zip(starts, np.split(places, starts[1:]))} if len(at) else {}
        waiting = list(index)
        heapq.heapify(waiting)
        rank_of, joined = self._rank, self.joined
        while waiting:
            rank = heapq.heappop(waiting)
            there = index.pop(rank)
            there.sort()
            skip, late = -1, []
            for i in there:
                if i < skip:
                    late.append(i)
                    continue
                j = after[i]
                if j < 0 or symbol[i] < 0 or rank_of(symbol[i], symbol[j]) != rank:
                    continue  # a merge of lower rank has taken one of the two
                symbol[i], symbol[j] = rank, -1
                nxt = after[i] = after[j]
                lower = False
                if nxt >= 0:
                    before[nxt] = i
                    key = rank << 32 | symbol[nxt]
                    new = joined.get(key)
                    if new is None:
                        new = rank_of(rank, symbol[nxt])
                    if new >= 0:
                        lower = new < rank
                        if new in index:
                            index[new].append(i)
                        else:
                            index[new] = [i]
                            heapq.heappush(waiting, new)
                prior = before[i]
                if prior >= 0:
                    key = symbol[prior] << 32 | rank
                    new = joined.get(key)
                    if new is None:
                        new = rank_of(symbol[prior], rank)
                    if new >= 0:
                        lower |= new < rank
                        if new in index:
                            index[new].append(prior)
                        else:
                            index[new] = [prior]
                            heapq.heappush(waiting, new)
                if lower:  # the rest of this word waits for the pair that this merge has made
                    skip = last[bisect_right(last, i)]
            if late:
                index[rank] = late
                heapq.heappush(waiting, rank)
        left = np.array(symbol, np.int64)
        alive = left >= 0
        upto = np.cumsum(alive)[ends - 1] * 4
        ids = left[alive].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist())]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word: a word that is a token is that token, the others are merged."""
        spelled = [w.encode() for w in words]
        found = [self.ranks.get(w) for w in spelled]
        rest = [w for w, r in zip(spelled, found) if r is None]
        merged = iter(self.replay(rest) if rest else ())
        return [next(merged) if r is None else self.packed((r,)) for r in found]

    def _encode(self, tokenizer, texts: list[str]) -> list[bytes]:
        """Texts of which nothing is known, each cut into words."""
        cut = [self.cut(t) for t in texts]
        new = {w for words in cut for w in words}.difference(self.bare)
        if len(self.bare) + len(new) > self.memory:
            self.bare = {}
            new = {w for words in cut for w in words}
        new = list(new)
        told = dict(zip(new, self._words(new)))
        get = {**self.bare, **told}.__getitem__ if len(self.bare) < len(told) else lambda w: told[w] if w in told else self.bare[w]
        out = [b"".join(map(get, words)) for words in cut]
        self.bare.update((w, ids) for w, ids in told.items() if len(w) <= LONGEST)
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces that follow a space."""
        known, bare = self.known, self.bare
        new = [p for p in pieces if p.isalpha()]  # one word with its space
        rest = [(p, self.cut(" " + p)) for p in pieces if not p.isalpha()]
        need = {w[1:] for _, words in rest for w in words[:1]}.difference(new, known)  # the words with the space before them
        spaced = [*new, *need]
        told = dict(zip(spaced, self._words([" " + w for w in spaced])))
        others = {w for _, words in rest for w in words[1:]}.difference(bare)
        more = dict(zip(others, self._words(list(others))))
        got = {p: told[p] for p in new}
        for p, words in rest:
            w = words[0][1:]
            got[p] = b"".join([told[w] if w in told else known[w], *[more[x] if x in more else bare[x] for x in words[1:]]])
        if len(bare) + len(more) <= self.memory // 4:
            bare.update((w, ids) for w, ids in more.items() if len(w) <= LONGEST)
        if len(known) < self.memory:
            known.update((p, ids) for p, ids in told.items() if p and len(p) <= LONGEST and p[0] != " ")
            known.update((p, ids) for p, ids in got.items() if len(p) <= LONGEST)
        return got

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids spell; an id without a token raises IndexError."""
        return b"".join(map(self.tokens.__getitem__, array("I", ids) if array("I").itemsize == 4 else np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(file: str) -> Codec:
    """This worker process's codec, kept from task to task."""
    if file not in _CODECS:
        _CODECS[file] = Codec(file)
    return _CODECS[file]


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of BLOCK bytes each, or of one row."""
    values = batch.column(column)
    size = np.cumsum(np.array(pc.binary_length(values).fill_null(0)), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        till = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right")))
        yield batch.slice(at, till - at)
        at = till


def encode(docs: DataFrame, *, file: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit), and with with_decoded the bytes decoded from these ids.

    Whole texts are encoded, without special tokens: their names are ordinary text. A null or empty text has no ids. Rows with equal
    ids are separate documents. Other columns are not read, whatever their names. Rows stay in the partition where they are read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file)
        for batch in batches:
            for block in _blocks(batch, "text"):
                ids = own.batch(block.column("text").to_pylist())
                columns = {"doc_id": block.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if with_decoded:
                    columns["decoded"] = pa.array(list(map(own.decode, ids)), pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * with_decoded)


def decode(rows: DataFrame, *, file: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with the bytes that their ids spell in the column `into` (it may not be there yet); null for null ids."""
    schema = rows.schema.fields
    if into in rows.columns:
        raise ValueError(f"there is a column {into} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(file)
        for batch in batches:
            for block in _blocks(batch, ids_col):
                told = [None if x is None else own.decode(x) for x in block.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(told, pa.binary())], [*block.schema.names, into])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return rows.mapInArrow(run, StructType([*schema, StructField(into, BinaryType())]))
