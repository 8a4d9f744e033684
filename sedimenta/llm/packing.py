"""Packing token ids into sequences: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for
from .tokens import encoder

LENGTH = 2048
#: Documents of a group on average; also the most that are packed at once, so memory is bounded.
GROUP = 1024
#: Room of fewer ids than this is left as padding rather than filled with a cut piece.
LEAST = 16


class Tournament:
    """Room of bins 0..n-1; each inner node holds the most room below it, so the first bin with enough room is found from the root."""

    def __init__(self, n: int, room: int):
        self.width = 1
        while self.width < n:
            self.width *= 2
        self.room = [room] * (2 * self.width)

    def first(self, need: int) -> int:
        room, k = self.room, 1
        while k < self.width:
            k *= 2
            if room[k] < need:
                k += 1
        return k - self.width

    def take(self, bin_: int, used: int) -> None:
        room, k = self.room, bin_ + self.width
        room[k] -= used
        while k > 1:
            k //= 2
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most


def first_fit_decreasing(lengths: list[int], room: int = LENGTH) -> list[list[int]]:
    """Bins of item numbers: items by falling length (ties by number), each into the first bin with room."""
    bins: list[list[int]] = []
    tree = Tournament(max(1, len(lengths)), room)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = tree.first(lengths[k])
        if at == len(bins):
            bins.append([])
        bins[at].append(k)
        tree.take(at, lengths[k])
    return bins


def arrange(lengths: list[int], room: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length), each item of at most `room`.

    After first-fit decreasing the emptiest bins are taken apart and cut to fill the room of at least LEAST in fuller
    ones; the one bin that remains is cut into sequences whose lengths are powers of two, which need no padding.
    """
    bins = [[(k, 0, lengths[k]) for k in b] for b in first_fit_decreasing(lengths, room)]
    used = lambda b: sum(p[2] for p in b)
    whole = [b for b in bins if room - used(b) < LEAST]
    part = sorted((b for b in bins if room - used(b) >= LEAST), key=used)  # the emptiest first
    lo, hi = 0, len(part) - 1
    gap = room - used(part[hi]) if part else 0
    while lo < hi:
        if gap < LEAST:
            whole.append(part[hi])
            hi -= 1
            gap = room - used(part[hi])
            continue
        if not part[lo]:
            lo += 1
            continue
        item, start, n = part[lo].pop()
        take = min(n, gap)
        part[hi].append((item, start, take))
        gap -= take
        if take < n:
            part[lo].append((item, start + take, n - take))
    if part and part[lo]:
        last, left = part[lo], used(part[lo])
        if room - left < LEAST:
            whole.append(last)
        else:
            while left:
                want = 1 << (left.bit_length() - 1)
                left -= want
                now = []
                while want:
                    item, start, n = last.pop()
                    take = min(n, want)
                    now.append((item, start, take))
                    want -= take
                    if take < n:
                        last.append((item, start + take, n - take))
                whole.append(now)
    return whole


def pack(
    docs: DataFrame, *, file: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document's ids (its text's, then end_id; a null text is empty) are cut at multiples of `length`; whole sequences stand
    alone and the rest is packed within a group of documents drawn by a hash of id and text. Rows with equal ids
    are separate documents with equal doc_id. Copies of one document (equal id and text) never share a sequence: in a group the first copies
    are packed together, then the second ones, and so on; they are dealt over groups by the partition in which they are read, so that
    no row is all of a group. A group with more than 4 * GROUP rests is packed in turns of so many. sequence_id is the group's number times 2**32 plus the number
    in the group. Other columns are not read, whatever their names. An empty table gives an empty table.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n, parts = parts_for(rows)
    groups = max(1, -(-n // GROUP))
    rows = rows.withColumn("h", F.xxhash64("id", "text")).withColumn("g", F.pmod(F.xxhash64("h", F.spark_partition_id()), F.lit(groups)).cast("long"))
    rows = rows.repartition(parts, "g").sortWithinPartitions("g", "id", "h")
    end = struct.pack("<I", end_id)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    fields += [("ids", pa.binary())] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        rests: list[tuple] = []  # doc_id, start, doc_tokens, ids
        group, number = None, 0

        def piece(doc_id, start, ids, total, sequence, offset):
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, (group << 32) + sequence, offset, *([ids] if with_ids else [])))

        def flush():
            nonlocal number, rests
            turns: list[list[tuple]] = []  # the first copies of each rest, the second ones, ...
            seen: Counter = Counter()
            for r in rests:
                if seen[r] == len(turns):
                    turns.append([])
                turns[seen[r]].append(r)
                seen[r] += 1
            for turn in turns:
                for pieces in arrange([len(r[3]) // 4 for r in turn], length):
                    offset = 0
                    for k, start, n in pieces:
                        doc_id, before, total, ids = turn[k]
                        piece(doc_id, before + start, ids[start * 4 : (start + n) * 4], total, number, offset)
                        offset += n
                    number += 1
            rests = []

        def emit() -> pa.RecordBatch:
            nonlocal out
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])
            out = []
            return batch

        for batch in batches:
            ids, texts, keys = (batch.column(c).to_pylist() for c in ("id", "text", "g"))
            for at in range(0, len(texts), 256):
                for doc_id, got, key in zip(ids[at : at + 256], encoder(file).batch(texts[at : at + 256]), keys[at : at + 256]):
                    if key != group:
                        if group is not None:
                            flush()
                        group, number = key, 0
                    got += end
                    total, whole = len(got) // 4, len(got) // 4 // length * length
                    for start in range(0, whole, length):
                        piece(doc_id, start, got[start * 4 : (start + length) * 4], total, number, 0)
                        number += 1
                    if whole < total:
                        rests.append((doc_id, whole, total, got[whole * 4 :]))
                        if len(rests) >= 4 * GROUP:  # many equal rows in one group
                            flush()
                if len(out) >= 20_000:
                    yield emit()
        if group is not None:
            flush()
        if out:
            yield emit()

    kinds = {"int64": "long", "binary": "binary"}
    return rows.mapInArrow(run, ", ".join(f"{n} {kinds[str(t)]}" for n, t in fields))
