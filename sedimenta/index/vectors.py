"""An inverted file over vectors with product-quantised codes: stored lists, read by the questions that need them, then exact distances.

Vectors are coded as SUBS bytes, each naming the nearest of at most 256 centroids of its part of the dimensions. The code of a
vector stands in the lists of its SPILL nearest coarse centroids, so a near neighbour across a border is still met; lists are
folders, and a search reads only those that some question asks for. A question scores codes by a table of its distances to the
parts' centroids, keeps the best ones over its lists, and orders these by the distances of the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Store, latest_by

SUBS = 16
SPILL = 4
#: Vectors that the centroids are learned from, at most, drawn by a hash of the id.
SAMPLE = 20_000
#: Share of the lists that a question reads.
PROBED = 0.25
#: Codes whose vectors are compared exactly, per neighbour asked for.
RERANKED = 20
#: Codes and questions of a task's group.
CODES, QUESTIONS = 16_384, 2_048
#: Growth since the lists were learned beyond which they are learned anew.
GROWTH = 1.2


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from k rows drawn at random; an empty one stays where it was."""
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the n nearest rows of c for each row of x, in blocks."""
    n, step = min(n, len(c)), max(1, 4_000_000 // len(c))
    return np.concatenate([np.argsort(squared(x[i : i + step], c), axis=1, kind="stable")[:, :n] for i in range(0, len(x), step)] or [np.empty((0, n), np.int64)])


class Model:
    """Coarse centroids and the centroids of each part of the dimensions."""

    def __init__(self, coarse: np.ndarray, parts: np.ndarray):
        self.coarse, self.parts = coarse, parts  # (lists, d) and (SUBS, 256 at most, d / SUBS)

    @classmethod
    def learned(cls, x: np.ndarray, lists: int) -> Model:
        return cls(kmeans(x, lists), np.stack([kmeans(s, 256, 8) for s in np.split(x, SUBS, axis=1)]))

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(s, c, 1)[:, 0] for s, c in zip(np.split(x, SUBS, axis=1), self.parts)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(questions, SUBS, centroids): squared distances of each question's parts."""
        return np.stack([squared(s, c) for s, c in zip(np.split(q, SUBS, axis=1), self.parts)], axis=1)


def matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def lists_for(n: int) -> int:
    """The square root of the number of vectors, from 4 to 256."""
    return min(256, max(4, round(n**0.5)))


class VectorIndex:
    """build() learns and stores; add() and remove() change rows; search() answers a table of questions.

    Vectors that are null, of another number of dimensions, or hold a null or non-finite component are not in the index and are not
    found; as questions they have no answers. Ids are unique; a later row of an id replaces the earlier one.
    """

    def __init__(self, spark: SparkSession, path: str, *, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.store, self.id_col, self.vector_col = spark, Store(spark, path), id_col, vector_col

    def _whole(self, rows: DataFrame, dims: int | None = None) -> DataFrame:
        v = F.col(f"`{self.vector_col}`").cast("array<double>")
        rows = rows.select(F.col(f"`{self.id_col}`").cast("long").alias("id"), v.alias("v"))
        rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        return rows.where(F.size("v") == dims) if dims else rows

    def build(self, vectors: DataFrame) -> int:
        """A new version with lists learned from these vectors, which are all that it has."""
        rows = self._whole(vectors)
        dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if dims is None or dims["d"] % SUBS:
            raise ValueError(f"vectors of a multiple of {SUBS} dimensions are needed")
        rows = rows.where(F.size("v") == dims["d"])
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
        model = Model.learned(matrix(sample["v"], sample.num_rows), lists_for(dims["count"]))
        number, state = self.store.state()
        meta = {"dims": dims["d"], "built": dims["count"], "rows": dims["count"], "coarse": model.coarse.tolist(), "parts": model.parts.tolist()}
        return self._write(number, state, rows, None, model, meta, replace=True)

    def add(self, vectors: DataFrame) -> int:
        """A version with these vectors as well, in the lists that there are; a row replaces an earlier one with its id."""
        number, state = self.store.state()
        rows = self._whole(vectors, state["meta"]["dims"])
        new = rows.join(self._live(state).select("id"), "id", "left_anti").count()
        return self._write(number, state, rows, None, self.model(state), {"rows": state["meta"]["rows"] + new})

    def remove(self, gone: DataFrame) -> int:
        """A version without the ids of gone."""
        number, state = self.store.state()
        ids = gone.select(F.col(f"`{self.id_col}`").cast("long").alias("id")).distinct().join(self._live(state).select("id"), "id", "left_semi")
        empty = self.spark.createDataFrame([], "id long, v array<double>")
        return self._write(number, state, empty, ids, self.model(state), {"rows": state["meta"]["rows"] - ids.count()})

    def _write(self, number: int, state: dict, rows: DataFrame, gone: DataFrame | None, model: Model, meta: dict, replace: bool = False) -> int:
        seg = self.store.new_segment()
        held = self.store.write("vectors", rows, seg)
        codes = coded(held.drop("seg"), model).repartition("list").sortWithinPartitions("list", "id")
        written = {"vectors": held, "codes": self.store.write("codes", codes, seg, by=("list",))}
        log = held.select("id", F.lit(False).alias("gone"))
        if gone is not None:
            log = log.unionByName(gone.withColumn("gone", F.lit(True)))
        written["log"] = self.store.write("log", log.withColumn("version", F.lit(number + 1)), seg)
        return self.store.commit(number, state, {k: v.drop("seg").schema for k, v in written.items()}, seg, meta, replace)

    def model(self, state: dict | None = None) -> Model:
        meta = (state or self.store.state()[1])["meta"]
        return Model(np.array(meta["coarse"]), np.array(meta["parts"]))

    def outgrown(self) -> bool:
        """Whether the rows have grown by more than a fifth since the lists were learned."""
        meta = self.store.state()[1]["meta"]
        return meta["rows"] > GROWTH * meta["built"]

    def rebuild(self) -> int:
        """build() from the vectors that are there now."""
        return self.build(self.vectors().select(F.col("id").alias(self.id_col), F.col("v").alias(self.vector_col)))

    def _live(self, state: dict) -> DataFrame:
        """(id, seg): where each id's current row is."""
        return latest_by(self.store.read("log", state), "id").where("not gone").select("id", "seg")

    def _current(self, rows: DataFrame, state: dict) -> DataFrame:
        return rows if len(state["tables"]["log"]["segments"]) == 1 else rows.join(self._live(state), ["id", "seg"], "left_semi").select(*rows.columns)

    def vectors(self, state: dict | None = None) -> DataFrame:
        """(id, v, seg) of the vectors that are there now."""
        state = state or self.store.state()[1]
        return self._current(self.store.read("vectors", state), state)

    def codes(self, lists: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """(id, code, list, seg) of some lists; only their folders are read."""
        state = state or self.store.state()[1]
        rows = self.store.read("codes", state)
        return self._current(rows if lists is None else rows.where(F.col("list").isin(lists)), state)

    def search(self, questions: DataFrame, k: int = 10, *, probed: float = PROBED, reranked: int = RERANKED) -> DataFrame:
        """query_id, id, distance (squared) of the k nearest found for each question (id_col, vector_col), ties by id.

        A question reads `probed` of the lists, one at least. Lists are dealt in parts of about CODES, questions in parts of about QUESTIONS, and each pair
        of parts hands on k * reranked codes a question at most; no product of rows is made by Spark.
        """
        state = self.store.state()[1]
        meta, model = state["meta"], self.model(state)
        probes, kept = max(1, int(len(model.coarse) * probed)), k * reranked
        asked = probing(self._whole(questions, meta["dims"]), model, probes).persist()
        try:
            per = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}  # a row per list: 256 at most
            found = self._scored(asked, self.codes(sorted(per), state), per, meta["rows"], model, kept).persist()
            first = Window.partitionBy("query_id").orderBy("score", "id")
            best = found.groupBy("query_id", "id").agg(F.min("score").alias("score")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= kept)
            exact = best.select("query_id", "id").join(self.vectors(state).select("id", "v"), "id")
            exact = exact.join(self._whole(questions, meta["dims"]).select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
            distance = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
            exact = exact.select("query_id", "id", distance.alias("distance"))
            order = Window.partitionBy("query_id").orderBy("distance", "id")
            return exact.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "id", "distance")
        finally:
            asked.unpersist()

    def _scored(self, asked: DataFrame, codes: DataFrame, per: dict[int, int], rows: int, model: Model, kept: int) -> DataFrame:
        """(query_id, id, score): for each pair of parts of a list and of its questions, the best codes of each question."""
        lists = len(model.coarse)
        parts = max(1, -(-rows * SPILL // (lists * CODES)))
        turns = F.get(F.array(*[F.lit(max(1, -(-per.get(k, 0) // QUESTIONS))) for k in range(lists)]), F.col("list"))
        codes = codes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
        asked = asked.withColumn("turn", F.pmod(F.xxhash64("query_id"), turns).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        codebooks = model.parts

        def score(a: pa.Table, b: pa.Table) -> pa.Table:
            out = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            if a.num_rows and b.num_rows:
                b = b.sort_by("id")
                ids, code = b["id"].to_numpy(), np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(-1, SUBS)
                asking, q = a["query_id"].to_numpy(), matrix(a["v"], a.num_rows)
                own = Model(np.empty(0), codebooks)
                for at in range(0, len(q), 64):
                    table = own.tables(q[at : at + 64])
                    d = sum(table[:, s, code[:, s]] for s in range(SUBS))
                    if d.shape[1] > kept:
                        best = np.argpartition(d, kept - 1, axis=1)[:, :kept]
                    else:
                        best = np.broadcast_to(np.arange(d.shape[1]), d.shape)
                    for col, x in zip(out, (np.repeat(asking[at : at + 64], best.shape[1]), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel())):
                        col.append(x)
            return pa.table(dict(zip(("query_id", "id", "score"), map(np.concatenate, out))))

        keys = ("list", "part", "turn")
        return asked.groupBy(*keys).cogroup(codes.select(*keys, "id", "code").groupBy(*keys)).applyInArrow(score, "query_id long, id long, score double")


def coded(rows: DataFrame, model: Model) -> DataFrame:
    """(id, code, list) of (id, v): a row for each of the SPILL nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"), b.num_rows)
                lists, codes = nearest(x, model.coarse, SPILL), model.codes(x)
                n = lists.shape[1]
                yield pa.RecordBatch.from_pydict({"id": b.column("id").to_numpy().repeat(n), "code": pa.array([c.tobytes() for c in codes for _ in range(n)], pa.binary()), "list": pa.array(lists.ravel(), pa.int32())})

    return rows.select("id", "v").mapInArrow(run, "id long, code binary, list int")


def probing(rows: DataFrame, model: Model, probes: int) -> DataFrame:
    """(query_id, v, list) of (id, v): a row for each of the nearest lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = nearest(matrix(b.column("v"), b.num_rows), model.coarse, probes)
                n = lists.shape[1]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(np.arange(b.num_rows).repeat(n))), b.column("v").take(pa.array(np.arange(b.num_rows).repeat(n))), pa.array(lists.ravel(), pa.int32())], ["query_id", "v", "list"])

    return rows.select("id", "v").mapInArrow(run, "query_id long, v array<double>, list int")
