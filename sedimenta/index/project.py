"""The index of a corpus of files: lines, symbols, postings, vectors and signals, kept up file by file under one version.

Each change writes one segment per table with the rows of the changed files only. The log of files says which segment
holds a file's current rows, so older rows and those of deleted files are passed over without being rewritten, until compact().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import search
from sedimenta.operators.embed import hashed_vectors
from sedimenta.sources import adapters

from .store import Store, latest_by

#: Files whose postings of one term stand in a row.
BLOCK = 1024
#: Columns that files have besides their content.
FILE = ("id", "path", "content_hash", "language", "domain", "size_bytes", "last_modified")
TABLES = ("lines", "symbols", "postings", "vectors", "signals")


@dataclass(frozen=True)
class Extraction:
    """What is taken out of files (FILE and content): lines (file_id, line, text), and of lines the tokens (file_id, line, pos, term) and symbols."""

    lines: Callable[[DataFrame], DataFrame] = adapters.lines
    tokens: Callable[[DataFrame], DataFrame] = adapters.tokens
    symbols: Callable[[DataFrame], DataFrame] = adapters.symbols


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(tokens: DataFrame, buckets: int, parts: int = 0) -> DataFrame:
    """(term, block, n_files, files, bucket): the files of a block of BLOCK ids that hold a term, with its places there; in `parts` ranges, sorted, if given.

    A term in all files is many rows, one a block; only places move, as two arrays of numbers for each term and block of a task.
    """
    block = F.floor(F.col("file_id") / BLOCK)
    at = F.shiftleft(F.col("file_id") - block * BLOCK, 31).bitwiseOR(F.col("line").cast("long"))
    rows = tokens.select("term", block.alias("block"), at.alias("at"), "pos").groupBy("term", "block").agg(F.collect_list("at").alias("at"), F.collect_list("pos").alias("pos"))
    rows = rows.withColumn("bucket", bucket(F.col("term"), buckets))
    if parts:
        rows = rows.repartitionByRange(parts, "bucket", "term", "block").sortWithinPartitions("bucket", "term", "block")
    file = lambda x: F.shiftright(x["at"], 31)
    place = lambda x: F.struct(x["at"].bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("line"), x["pos"].alias("pos"))
    rows = rows.withColumn("x", F.sort_array(F.arrays_zip("at", "pos")))
    new = F.filter(F.transform("x", lambda x, k: F.when((k == 0) | (file(x) != file(F.get("x", F.greatest(k - 1, F.lit(0))))), k).otherwise(-1)), lambda k: k >= 0)
    rows = rows.withColumn("new", new)
    n = lambda start, k: F.coalesce(F.get("new", k + 1), F.size("x")) - start
    one = lambda start, k: F.struct((F.col("block") * BLOCK + file(F.get("x", start))).alias("file_id"), n(start, k).alias("n"), F.transform(F.slice("x", start + 1, n(start, k)), place).alias("places"))
    return rows.select("term", "block", F.size("new").alias("n_files"), F.transform("new", one).alias("files"), "bucket")


class ProjectIndex:
    """apply() takes changed and deleted files; live() and the searches read the current version."""

    def __init__(self, spark: SparkSession, path: str, extraction: Extraction | None = None, buckets: int = 64, *, searched_only: bool = False):
        """searched_only: of the files' contents only postings are kept, which is what the searches read."""
        self.spark, self.store, self.extraction, self.buckets, self.searched_only = spark, Store(spark, path), extraction or Extraction(), buckets, searched_only

    # writing

    def apply(self, changed: DataFrame, gone: DataFrame | None = None, *, stream: str | None = None, batch: int = 0, now: int = 0) -> int:
        """The index with `changed` (FILE and content, one row an id) in place of what these ids had, and without the ids in `gone`.

        stream, batch: where changes come from; a batch of a stream that is applied already (or is older) changes nothing, so a replay
        is harmless. Ids are not null. Returns the version.
        """
        number, state = self.store.state()
        done = state["meta"].get("streams", {})
        if stream is not None and batch <= done.get(stream, -1):
            return number
        seg, buckets = self.store.new_segment(), state["meta"].get("buckets", self.buckets)
        files = changed.select(*FILE)
        log = files.withColumn("gone", F.lit(False))
        if gone is not None:
            named = gone.select("id").distinct().join(files.select("id"), "id", "left_anti")
            log = log.unionByName(named.withColumn("gone", F.lit(True)), allowMissingColumns=True)
        log = self.store.write("files", log.withColumn("version", F.lit(number + 1)), seg)
        if self.searched_only:
            new = {"postings": self._inverted(self.extraction.lines(changed), seg, buckets)}
        else:
            new = self._extract(changed, seg, buckets)
            stats = self._counted(new["symbols"], log.where("not gone"), 1)
            if number:  # what the changed and deleted files added before is taken off
                ids = log.select("id")
                old = self.live("symbols", state).join(ids.withColumnRenamed("id", "file_id"), "file_id", "left_semi")
                stats = stats.unionByName(self._counted(old, self.files(state).join(ids, "id", "left_semi"), -1))
            new["stats"] = self.store.write("stats", stats.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n <> 0"), seg)
        new["files"] = log
        meta = {"buckets": buckets, "changed_at": now} | ({"built_at": now} if not number else {})
        if stream is not None:
            meta["streams"] = {**done, stream: batch}
        return self.store.commit(number, state, {k: v.drop("seg").schema for k, v in new.items()}, seg, meta)

    def apply_listing(self, listed: DataFrame, changed: DataFrame, **options) -> int:
        """apply(changed), and all files of the index that `listed` (id) does not name are gone."""
        here = self.files()
        gone = here.select("id").join(listed.select("id"), "id", "left_anti") if here is not None else None
        return self.apply(changed, gone, **options)

    def _extract(self, changed: DataFrame, seg: str, buckets: int) -> dict[str, DataFrame]:
        x, write = self.extraction, self.store.write
        lines = write("lines", x.lines(changed), seg).drop("seg")
        symbols = write("symbols", x.symbols(lines), seg).drop("seg")
        inverted = self._inverted(lines, seg, buckets)
        counts = inverted.select("term", F.explode("files").alias("f")).select(F.col("f.file_id").alias("id"), "term", F.col("f.n").alias("n"))
        vectors = write("vectors", hashed_vectors(counts).withColumnRenamed("id", "file_id"), seg).drop("seg")
        names = symbols.groupBy("file_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_start", "name"))), lambda s: s["name"]).alias("names"))
        size = lines.groupBy("file_id").agg(F.count("*").alias("n_lines"))
        signals = changed.select(*FILE).withColumnRenamed("id", "file_id").join(size, "file_id", "left").join(names, "file_id", "left")
        signals = signals.withColumns({"n_lines": F.coalesce("n_lines", F.lit(0).cast("long")), "names": F.coalesce("names", F.array().cast("array<string>"))})
        return {"lines": lines, "symbols": symbols, "postings": inverted, "vectors": vectors, "signals": write("signals", signals, seg).drop("seg")}

    def _inverted(self, lines: DataFrame, seg: str, buckets: int) -> DataFrame:
        parts = max(1, min(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        return self.store.write("postings", postings(self.extraction.tokens(lines), buckets, parts), seg, by=("bucket",)).drop("seg")

    @staticmethod
    def _counted(symbols: DataFrame, files: DataFrame, sign: int) -> DataFrame:
        """Signed counts: symbols by kind and by name, files by language."""
        of = lambda df, kind, key: df.groupBy(F.lit(kind).alias("kind"), F.coalesce(F.col(key), F.lit("")).alias("key")).agg((F.count("*") * sign).alias("n"))
        return of(symbols, "symbol_kind", "kind").unionByName(of(symbols, "symbol_name", "name")).unionByName(of(files, "language", "language"))

    def compact(self, now: int = 0) -> int:
        """A version of one segment a table that holds the current rows only; counts are made anew."""
        number, state = self.store.state()
        seg, tables = self.store.new_segment(), {}
        log = self.files(state).withColumn("gone", F.lit(False)).withColumn("version", F.lit(number + 1))
        tables["files"] = self.store.write("files", log.drop("seg"), seg)
        for name in TABLES:
            if name != "postings" and name in state["tables"]:
                tables[name] = self.store.write(name, self.live(name, state).drop("seg"), seg)
        flat = self.postings(None, state).select("term", "file_id", F.explode("places").alias("p")).select("term", "file_id", "p.line", "p.pos")
        tables["postings"] = self.store.write("postings", postings(flat, state["meta"]["buckets"]).repartition("bucket").sortWithinPartitions("term", "block"), seg, by=("bucket",))
        if "symbols" in tables:
            tables["stats"] = self.store.write("stats", self._counted(tables["symbols"], tables["files"], 1), seg)
        return self.store.commit(number, state, {k: v.drop("seg").schema for k, v in tables.items()}, seg, {"built_at": now}, replace=True)

    # reading

    def files(self, state: dict | None = None) -> DataFrame | None:
        """FILE and seg of each file that is there now."""
        log = self.store.read("files", state)
        return log if log is None else latest_by(log, "id").where("not gone").drop("gone")

    def _current(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows (file_id, seg, ...) that are the current ones of their file."""
        table = state["tables"]["files"]
        if len(table["segments"]) == 1:  # one segment: nothing was changed or deleted since
            return rows
        return rows.join(self.files(state).select(F.col("id").alias("file_id"), "seg"), ["file_id", "seg"], "left_semi").select(*rows.columns)

    def live(self, name: str, state: dict | None = None) -> DataFrame:
        """The current rows of lines, symbols, vectors or signals."""
        state = state or self.store.state()[1]
        return self._current(self.store.read(name, state), state)

    def stats(self) -> DataFrame:
        """(kind, key, n): the signed counts of all segments together."""
        return self.store.read("stats").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n <> 0")

    def stale(self, now: int, most: int) -> bool:
        """Whether the last full build (or compact()) is more than `most` seconds ago."""
        return now - self.store.state()[1]["meta"].get("built_at", 0) > most

    def postings(self, terms: list[str] | None, state: dict | None = None) -> DataFrame:
        """(term, file_id, n, places, seg) of the current files that hold the terms (None: all): only the folders of the terms' buckets are
        read, and in their files the row groups that may hold a term."""
        state = state or self.store.state()[1]
        rows = self.store.read("postings", state)
        if terms is not None:
            places = rows.sparkSession.range(1).select(*[bucket(F.lit(t), state["meta"]["buckets"]).alias(f"b{k}") for k, t in enumerate(terms)]).first() if terms else ()
            rows = rows.where(F.col("bucket").isin(sorted(set(places))) & F.col("term").isin(terms))
        rows = rows.select("term", "seg", F.explode("files").alias("f")).select("term", "seg", "f.file_id", "f.n", "f.places")
        return self._current(rows, state)

    def tokens(self, terms: list[str]) -> DataFrame:
        """(term, file_id, line, pos) of the terms."""
        return self.postings(terms).select("term", "file_id", F.explode("places").alias("p")).select("term", "file_id", "p.line", "p.pos")

    def keyword_topk(self, words: list[str], k: int, where: Column | None = None) -> DataFrame:
        """Files that hold any of the words: n_words, n_hits; the first k by these. where: a condition on the columns of files."""
        found = self.postings(sorted(set(words)))
        if where is not None:
            found = found.join(self.files().where(where).select(F.col("id").alias("file_id")), "file_id", "left_semi")
        found = found.groupBy("file_id").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_hits"))
        return found.orderBy(F.desc("n_words"), F.desc("n_hits"), "file_id").limit(k)

    def phrase(self, phrase: list[str]) -> DataFrame:
        """Where the words stand in a row: file_id, line, pos."""
        return search.phrase_hits(self.tokens(phrase), phrase)


def ingest(stream: DataFrame, index: ProjectIndex, checkpoint: str, *, name: str = "changes"):
    """A change stream (FILE, content, op, seq) into the index, a version for each micro-batch; the last change of an id in a batch counts.

    A batch that runs again after a failure finds itself applied. Contents move, to find the last change of an id, only if an id has several.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if batch.groupBy("id").count().where("count > 1").isEmpty():
            index.apply(batch.where("op <> 'delete'"), batch.where("op = 'delete'"), stream=name, batch=number)
            return
        last = batch.groupBy("id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "id"]), "seq").alias("x")).select("id", "x.*").persist()
        try:
            index.apply(last.where("op <> 'delete'"), last.where("op = 'delete'"), stream=name, batch=number)
        finally:
            last.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
