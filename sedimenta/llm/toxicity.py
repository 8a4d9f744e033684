"""Toxic passages: maximum-scoring segments of token log-odds with Dirichlet priors, calibrated by extreme values."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, stored

TOKEN = re.compile(r"\w+")
#: Tokens share this many slots by hash, so the model has one size for any corpus.
SLOTS = 1 << 20
#: At most this many labelled rows, drawn by a hash of the id, teach the model.
SAMPLE = 50_000
PRIOR = 1000.0  # weight of the background distribution in either class, in tokens
FLOOR = 0.5
CAUTION = 1.7
DRIFT = 0.2  # taken from every token, so that clean text drifts down
LOWEST, HIGHEST = -1.0, 5.0
MEMORY = 300_000  # tokens whose score a worker remembers


def slot(token: str) -> int:
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) & (SLOTS - 1)


def token_scores(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Per slot: log-odds of toxic against clean under a Dirichlet prior shaped like both together (at least FLOOR a slot), drawn
    towards 0 by CAUTION standard deviations, within bounds, less the drift. toxic, clean: documents of each class that hold the slot."""
    n1, n0 = max(toxic.sum(), 1.0), max(clean.sum(), 1.0)
    prior = np.maximum(PRIOR * (toxic + clean) / (n1 + n0), FLOOR)
    a, b = toxic + prior, clean + prior
    seen = (toxic + clean) > 0
    a, b = np.where(seen, a, 1.0), np.where(seen, b, 1.0)
    odds = np.log(a / (n1 + PRIOR)) - np.log(b / (n0 + PRIOR))
    sure = np.maximum(np.abs(odds) - CAUTION * np.sqrt(1 / a + 1 / b), 0) * np.sign(odds)
    return (np.clip(np.where(seen, sure, 0.0), LOWEST, HIGHEST) - DRIFT).astype(np.float32)


def decay(scores: np.ndarray, clean: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * score)) = 1 over clean tokens: scores times it are in nats."""
    p = clean / max(clean.sum(), 1.0)
    keep = p > 0
    p, s = p[keep], scores[keep].astype(float)
    if not len(s) or s.max() <= 0 or (p * s).sum() >= 0:
        return 1.0
    low, high = 1e-3, 1.0
    while (p * np.exp(high * s)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return high


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), end exclusive, in one pass.

    Candidates hold the sums before their start and after their end and a link to the nearest earlier
    candidate with a smaller sum before; a new positive token is merged back along the links as long as that raises the score.
    """
    if not len(scores):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=float)])
    found: list[tuple[float, float, int, int, int]] = []  # before, after, start, end, link
    for i in np.flatnonzero(scores > 0).tolist():
        before, after, start = float(total[i]), float(total[i + 1]), i
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= before:
                k = found[k][4]
            if k < 0 or found[k][1] >= after:
                found.append((before, after, start, i + 1, k))
                break
            before, start = found[k][0], found[k][2]
            del found[k:]
    return [(after - before, start, end) for before, after, start, end, _ in found]


@dataclass
class Model:
    """scores: per slot; nats: the decay; level: log of the search constant of extreme values; a, b: calibration of the evidence."""

    scores: np.ndarray
    nats: float
    level: float = 0.0
    a: float = -2.0
    b: float = 1.0

    def passages(self, scores: np.ndarray) -> list[tuple[float, int, int]]:
        """Significant segments as (evidence, start, end): evidence is minus the log of the expected number of segments
        of clean text of this length that score as high."""
        base = self.level + math.log(max(len(scores), 1))
        found = [(s * self.nats - base, i, j) for s, i, j in segments(scores)]
        return [x for x in found if x[0] > 0]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.a + self.b * math.log1p(evidence)))))


class Scores(dict):
    """Scores by token, remembered for the first MEMORY tokens."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __missing__(self, token: str) -> float:
        value = float(self.table[slot(token)])
        if len(self) < MEMORY and len(token) <= 64:
            self[token] = value
        return value


def evidence_of(model: Model, scores: np.ndarray) -> tuple[float, list]:
    found = model.passages(scores)
    return sum(x[0] for x in found), found


def logistic(x: np.ndarray, right: np.ndarray, wrong: np.ndarray) -> tuple[float, float]:
    """Newton's method for P(toxic | x) with counts of both classes at each x, slightly regularised."""
    a, b = -1.0, 0.5
    n = right + wrong
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(right - n * p).sum() - 1e-3 * a, ((right - n * p) * x).sum() - 1e-3 * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: int = 0) -> Model:
    """Learns from labelled rows whose fold is not held_out, at most SAMPLE of them.

    Counts by slot come from Spark; two models made from either half of the rows score the other half, which gives the
    search constant (from clean rows) and the calibration. Only the counts of SLOTS slots and a histogram
    come to the driver. Rows whose label or id is null teach nothing. Without labels of both classes every score is the same.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != held_out)).select(F.col(id_col).alias("id"), (F.col(label_col) == 1).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "toxic").limit(SAMPLE).withColumn("half", F.crc32(F.concat(F.lit("half:"), F.col("id").cast("string")).cast("binary")) % 2)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                got = []
                for t in TOKEN.findall(text or ""):
                    s = memory.get(t)
                    if s is None:
                        s = slot(t)
                        if len(memory) < MEMORY:
                            memory[t] = s
                    got.append(s)
                out.append(np.array(got, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("half"), pa.array(out, pa.binary())], ["toxic", "half", "slots"])

    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most SAMPLE rows of two numbers
    train = stored(known.select("toxic", F.col("half").cast("int").alias("half"), "text").mapInArrow(slots, "toxic boolean, half int, slots binary"), "toxicity-train")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, SLOTS), np.int64)
        for batch in batches:
            for toxic, half, got in zip(*(batch.column(c).to_pylist() for c in ("toxic", "half", "slots"))):
                counts[2 * half + toxic][np.unique(np.frombuffer(got, "<i4"))] += 1
        used = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *[pa.array(counts[k][part], pa.int64()) for k in range(4)]], ["slot", "n0", "n1", "n2", "n3"])

    told = train.mapInArrow(tally, "slot int, n0 long, n1 long, n2 long, n3 long").groupBy("slot").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]).toArrow()
    counts = np.zeros((4, SLOTS))
    where = told.column("slot").to_numpy()
    for k in range(4):
        counts[k][where] = told.column(f"n{k}").to_numpy()

    def model(*halves: int) -> Model:
        clean, toxic = (sum(counts[2 * h + t] for h in halves) for t in (0, 1))
        scores = token_scores(toxic, clean)
        return Model(scores, decay(scores, clean))

    # the model for a half is learned from the other one
    crossed = [model(1), model(0)]
    shared = spark.sparkContext.broadcast([(m.scores, m.nats) for m in crossed])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for toxic, half, got in zip(*(batch.column(c).to_pylist() for c in ("toxic", "half", "slots"))):
                scores, nats = shared.value[half]
                mine = scores[np.frombuffer(got, "<i4")]
                top = max((s for s, _, _ in segments(mine)), default=0.0)
                out.append((toxic, half, math.floor(4 * (top * nats - math.log(max(len(mine), 1))))))
            yield pa.RecordBatch.from_pylist([dict(zip(("toxic", "half", "x"), r)) for r in out], pa.schema([("toxic", pa.bool_()), ("half", pa.int32()), ("x", pa.int32())]))

    hist = train.mapInArrow(best, "toxic boolean, half int, x int").where("not toxic").groupBy("x").count().toArrow().to_pydict()
    # a maximum m over clean text of length n has P(m > t) = 1 - exp(-K n exp(-nats t)); the median of nats m - log n is log K - log log 2
    level = 0.0
    if hist["x"]:
        order = np.argsort(hist["x"])
        xs, ns = np.array(hist["x"])[order], np.array(hist["count"])[order]
        level = float(xs[np.searchsorted(np.cumsum(ns), ns.sum() / 2)] + 0.5) / 4 + math.log(math.log(2))
    for m in crossed:
        m.level = level

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(s, n, level) for s, n in shared.value]
        for batch in batches:
            out = []
            for toxic, half, got in zip(*(batch.column(c).to_pylist() for c in ("toxic", "half", "slots"))):
                e, _ = evidence_of(models[half], models[half].scores[np.frombuffer(got, "<i4")])
                out.append((toxic, round(20 * math.log1p(e))))
            yield pa.RecordBatch.from_pylist([dict(zip(("toxic", "x"), r)) for r in out], pa.schema([("toxic", pa.bool_()), ("x", pa.int32())]))

    fitted = model(0, 1)
    fitted.level = level
    rows = train.mapInArrow(weigh, "toxic boolean, x int").groupBy("x").agg(F.count_if("toxic").alias("p"), F.count_if(~F.col("toxic")).alias("n")).toArrow().to_pydict()
    if sum(rows["p"]) and sum(rows["n"]):
        fitted.a, fitted.b = logistic(np.array(rows["x"]) / 20, np.array(rows["p"], float), np.array(rows["n"], float))
    return fitted


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, score, passages (array of start, end in code points, end exclusive, and evidence).

    Whole texts are read; a null or empty text has no passages and the score of no evidence. Repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = Scores(model.scores)
        passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))
        for batch in batches:
            p, spans = [], []
            for text in batch.column("text").to_pylist():
                tokens = TOKEN.findall(text or "")
                evidence, found = evidence_of(model, np.array([known[t] for t in tokens], np.float32))
                p.append(model.probability(evidence))
                here = []
                if found:
                    places = [m.span() for m in TOKEN.finditer(text)]
                    here = [{"start": places[i][0], "end": places[j - 1][1], "evidence": e} for e, i, j in found]
                spans.append(here)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p, pa.float64()), pa.array(spans, passage)], [id_col, "score", "passages"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, passages array<struct<start:int,end:int,evidence:double>>")
