"""Token files: independent zstandard frames, a document index, and a trailing seek table with checksums.

A file is a sequence of zstandard frames, each of at most FRAME_IDS token ids as little-endian unsigned 32-bit integers,
then a skippable frame with the document index (per document: id, whether the id is null, number of ids), then a skippable frame
with the seek table: compressed size, content size and checksum (low 32 bits of XXH64 of the content) of each
frame, the number of frames, a descriptor byte and the closing magic number, as in zstandard's seekable format.
A plain zstandard decoder reads all ids of the file; a reader that wants some documents reads the tail and
decompresses only the frames in which they lie.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, shared_dir, stored
from .tokens import encoder

FRAME_IDS = 1 << 16
#: Pieces that a worker remembers (some 150 bytes each). Where tasks are short an executor has more workers than cores for a while.
REMEMBERED = 250_000
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
HEAD = struct.Struct("<II")


def opened(uri: str):
    """The file system and path of a URI; a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


class Writer:
    """Writes one file; memory holds one frame and the document index."""

    def __init__(self, sink):
        self.sink, self.frames, self.ids, self.nulls, self.lengths = sink, [], [], [], []
        self.buffer = bytearray()
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids) // 4)
        self.buffer += ids
        size = FRAME_IDS * 4
        if len(self.buffer) >= size:
            whole = len(self.buffer) // size * size
            for at in range(0, whole, size):
                self._frame(bytes(self.buffer[at : at + size]))
            del self.buffer[:whole]

    def _frame(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self.sink.write(packed)
        self.frames.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> int:
        """Writes the index and the table; returns the number of ids."""
        if self.buffer:
            self._frame(bytes(self.buffer))
        index = np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.lengths, "<u8").tobytes()
        index = struct.pack("<I", len(self.ids)) + self.compressor.compress(index)
        self.sink.write(HEAD.pack(SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(ENTRY.pack(*f) for f in self.frames) + FOOTER.pack(len(self.frames), CHECKSUMS, SEEKABLE)
        # before the table, the size of the index in a skippable frame of its own, so that the tail leads to it
        self.sink.write(HEAD.pack(SKIPPABLE_INDEX, 4) + struct.pack("<I", len(index)))
        self.sink.write(HEAD.pack(SKIPPABLE_TABLE, len(table)) + table)
        return sum(self.lengths)


class Reader:
    """Reads a file that can seek: first the tail, then only the frames that are asked for."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, 2) or source.tell()
        source.seek(end - FOOTER.size)
        n, descriptor, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE or descriptor != CHECKSUMS:
            raise ValueError("not a token file: the seek table is missing")
        at = end - FOOTER.size - n * ENTRY.size
        source.seek(at)
        table = source.read(n * ENTRY.size)
        self.frames, place, first = [], 0, 0
        for k in range(n):
            packed, content, check = ENTRY.unpack_from(table, k * ENTRY.size)
            self.frames.append((place, packed, first, content // 4, check))
            place, first = place + packed, first + content // 4
        source.seek(at - HEAD.size - 4)
        (size,) = struct.unpack("<I", source.read(4))
        source.seek(place + HEAD.size)
        index = source.read(size)
        (docs,) = struct.unpack_from("<I", index)
        index = zstandard.ZstdDecompressor().decompress(index[4:], max_output_size=max(1, docs * 17)) if docs else b""
        self.ids = np.frombuffer(index, "<i8", docs)
        self.nulls = np.frombuffer(index, "u1", docs, docs * 8)
        self.lengths = np.frombuffer(index[docs * 9 :], "<u8", docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.last = (-1, b"")

    def _content(self, k: int) -> bytes:
        if self.last[0] != k:
            place, packed, _, n, check = self.frames[k]
            self.source.seek(place)
            content = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=n * 4)
            if len(content) != n * 4 or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, content)
        return self.last[1]

    def document(self, row: int) -> bytes:
        """The ids of the document at a row of the index."""
        at, end, parts = int(self.starts[row]), int(self.starts[row + 1]), []
        while at < end:
            k = at // FRAME_IDS
            first, n = self.frames[k][2:4]
            take = min(end, first + n)
            parts.append(self._content(k)[(at - first) * 4 : (take - first) * 4])
            at = take
        return b"".join(parts)

    def find(self, doc_id: int) -> list[bytes]:
        """The ids of each document with that id."""
        return [self.document(int(r)) for r in np.flatnonzero((self.ids == doc_id) & (self.nulls == 0))]


def write(docs: DataFrame, folder: str, *, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends end_id, and writes one token file per range of ids to folder.

    Returns the manifest, one row per file in the order of ids: part, file, n_docs, n_ids, first_id (ids in the files before).
    Documents stand by ascending id, null first; rows with equal ids stand by a hash of the text and the text. Null texts are
    empty: one end id. A file is written under another name and moved into place, so a task that runs again or twice leaves
    one whole file. An empty table gives an empty manifest.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    _, parts = parts_for(rows)
    rows = rows.repartitionByRange(parts, F.col("id").asc_nulls_first(), "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h", "text").select("id", "text")
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, base = opened(folder)
        writer, sink, n_docs = None, None, 0
        temporary, final = f"{base}/.{uuid.uuid4().hex}.tmp", f"{base}/part-{part:06d}.ids.zst"
        for batch in batches:
            if writer is None:
                files.create_dir(base, recursive=True)
                sink = files.open_output_stream(temporary)
                writer = Writer(sink)
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                for doc_id, got in zip(rows.column("id").to_pylist(), encoder(file, REMEMBERED).batch(rows.column("text").to_pylist())):
                    writer.add(doc_id, got + end)
            n_docs += batch.num_rows
        if writer is not None:
            total = writer.close()
            sink.close()
            files.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{folder}/part-{part:06d}.ids.zst"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    told = stored(rows.mapInArrow(encode, "part int, file string, n_docs long, n_ids long"), "token-manifest")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    return told.withColumn("first_id", F.coalesce(before, F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """One row per document in the files: doc_id, start (ids of all documents before), n_tokens, ids (binary)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, first in zip(batch.column("file").to_pylist(), batch.column("first_id").to_pylist()):
                files, place = opened(where)
                with files.open_input_file(place) as source:
                    reader = Reader(source)
                    rows, size = [], 0
                    for k in range(len(reader.ids)):
                        ids = reader.document(k)
                        rows.append((None if reader.nulls[k] else int(reader.ids[k]), first + int(reader.starts[k]), len(ids) // 4, ids))
                        size += len(ids)
                        if size > 4_000_000 or k + 1 == len(reader.ids):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])
                            rows, size = [], 0

    parts = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    return manifest.repartition(parts).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def export(docs: DataFrame, *, file: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes token files (to a new folder below the shared one unless told) and reads all documents back."""
    return read(write(docs, folder or shared_dir(docs.sparkSession, "tokens"), file=file, end_id=end_id))


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
