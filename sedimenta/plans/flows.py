"""Streams with state, data sources over written files, and sketches that are rolled up."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from sedimenta.operators import maintain as m
from sedimenta.operators import sketches
from sedimenta.sources import adapters as a
from sedimenta.sources import files as sources
from sedimenta.sources import scratch
from sedimenta.streaming import ttl, windows

from .registry import query


@query("""WITH RECURSIVE l AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t FROM events),
e AS (SELECT key, min(t) AS made FROM l GROUP BY key UNION ALL SELECT e.key, min(l.t) FROM e JOIN l ON l.key = e.key AND l.t >= e.made + 86400000000 GROUP BY e.key, e.made),
f AS (SELECT e.key, min(l.id) AS id FROM e JOIN l ON l.key = e.key AND l.t = e.made GROUP BY e.key, e.made)
SELECT l.key, l.id, f.id IS NULL AS hit FROM l LEFT JOIN f ON f.key = l.key AND f.id = l.id""")
def cache_ttl_stream(spark, d):
    """A query cache whose entries live for a day: events are lookups, which come in three runs of a stream that is stopped and goes on from its state."""
    e = a.table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    inbox, outbox, checkpoint = (scratch.folder(spark, f"lookups-{x}") for x in ("in", "out", "state"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first, first + (last - first) / 3, first + (last - first) * 2 / 3]
    for k, begin in enumerate(cuts):
        part = e.where(F.col("ts") >= begin)
        part = part.where(F.col("ts") < cuts[k + 1]) if k + 1 < len(cuts) else part
        part.write.mode("append").parquet(inbox)
        ttl.run(spark.readStream.schema(e.schema).parquet(inbox), outbox, checkpoint, 86_400)
    return spark.read.schema("key long, id long, hit boolean").parquet(outbox)


_EXTENSION = {"en": "py", "fr": "ts", "de": "rs", "es": "go"}
_NAMES = {"en": "python", "fr": "typescript", "de": "rust", "es": "go"}


def _tree(spark, d):
    """documents as files below a new root: source/language/number, with an extension by language."""
    docs = a.table(spark, d, "documents").where("text is not null")
    ext = F.create_map(*[F.lit(x) for pair in _EXTENSION.items() for x in pair])[F.col("lang")]
    rows = docs.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.col("text").alias("content"))
    root = scratch.folder(spark, "tree")
    sources.write_files(rows.where("path is not null"), root)
    return root


_CASE = lambda names: "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(f"""SELECT source || '/' || lang || '/' || doc_id || '.' || {_CASE(_EXTENSION)} AS path, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS content_hash, {_CASE(_NAMES)} AS language
FROM documents WHERE source LIKE 'src1%' AND lang IN ('en', 'es') AND NOT (source = 'src12' AND lang = 'es') AND strlen(text) <= 9000""")
def corpus_files_scan(spark, d):
    """Files of some directories, scanned by directories with a filter that is pushed down, ignore rules and a limit of size."""
    sources.register(spark)
    scan = spark.read.format("corpus-files").option("root", _tree(spark, d)).option("ignore", "src12/es/\n*.rs").option("largest", "9000").load()
    return scan.where("path LIKE 'src1%' AND language IN ('python', 'go')").select("path", "size_bytes", "content_hash", "language")


@query("""SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 9 = 5 THEN md5('again') ELSE md5(text) END AS digest FROM documents WHERE doc_id % 9 <> 4""")
def corpus_change_stream(spark, d):
    """Numbered lists of changes, read as a stream from its offsets and applied to a stored table: all documents, then some deleted and some changed."""
    docs = a.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text")
    number = F.floor(F.col("doc_id") / 500) + 1
    later = docs.where("doc_id % 9 IN (4, 5)").select((number + 1_000_000).alias("number"), "path", F.when(F.col("doc_id") % 9 == 4, "delete").otherwise("upsert").alias("op"), F.when(F.col("doc_id") % 9 == 5, "again").alias("content"))
    lists = docs.select(number.alias("number"), "path", F.lit("upsert").alias("op"), F.col("text").alias("content")).unionByName(later)
    root = scratch.folder(spark, "changes-lists")

    def write(group: pa.Table) -> pa.Table:
        files, base = sources.opened(root)
        files.create_dir(base, recursive=True)
        n = group["number"][0].as_py()
        with files.open_output_stream(f"{base}/{n}.jsonl") as sink:
            for path, op, content in zip(*(group[c].to_pylist() for c in ("path", "op", "content"))):
                sink.write(json.dumps({"path": path, "op": op, "content": content}).encode() + b"\n")
        return pa.table({"n": [group.num_rows]})

    lists.groupBy("number").applyInArrow(write, "n long").agg(F.sum("n")).collect()  # 500 changes a list
    sources.register(spark)
    t = m.VersionedTable(spark, scratch.folder(spark, "changed"))
    stream = spark.readStream.format("corpus-changes").option("root", root).load()
    windows.ingest(stream, t, ["path"], ["seq"], scratch.folder(spark, "changed-checkpoint")).awaitTermination()
    return t.read().select("path", F.md5(F.col("content").cast("binary")).alias("digest"))


def _exact(rows):
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_TOP = "(SELECT max(c) FROM (SELECT count(*) AS c FROM events y WHERE y.event_type = e.event_type GROUP BY json_extract_string(y.props, '$.k')))"


@query(f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS users_near, TRUE AS median_near, {_TOP} AS most FROM events e GROUP BY event_type")
def rolled_sketches(spark, d):
    """Sketches stored by day and kind, rolled up over all days without the events: against exact values, the distinct users are within
    a twentieth, the median's rank is within 3 %, and the most frequent label has its count."""
    e = a.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    folder = scratch.folder(spark, "sketches")
    sketches.daily(e, ["event_type"], time="ts", item="user_id", value="value", label="k").write.parquet(folder)
    rolled = sketches.rolled(spark.read.parquet(folder), ["event_type"])
    rank = e.join(F.broadcast(rolled.select("event_type", F.col("quantiles")[0].alias("median"))), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("median")).cast("double")).alias("rank"))
    out = _exact(e).join(rolled.select("event_type", "distinct", F.get("top", F.lit(0))["count"].alias("most")), "event_type").join(rank, "event_type")
    return out.select("event_type", "n", "users", (F.abs(F.col("distinct") - F.col("users")) <= F.col("users") / 20).alias("users_near"), (F.abs(F.col("rank") - 0.5) <= 0.03).alias("median_near"), "most")
