"""The write path as queries over old and new tables, and stream windows in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedimenta.operators import maintain as m
from sedimenta.sources import adapters as a
from sedimenta.streaming import windows as w

from .registry import query

_OLD = "old AS (SELECT doc_id AS id, lang, n_chars AS size, CASE WHEN lang <> 'fr' THEN source END AS note FROM documents WHERE lang <> 'es')"
_NEW = "new AS (SELECT doc_id AS id, upper(lang) AS lang, n_chars + 1 AS size, CASE WHEN lang <> 'de' THEN 'n' || source END AS note FROM documents WHERE lang <> 'en')"


def _versions(spark, d):
    """An index before and after a change: English files only before, Spanish ones only after, the others in both."""
    t = a.table(spark, d, "documents")
    k = F.col("doc_id")
    old = t.where("lang <> 'es'").select(k.alias("id"), "lang", F.col("n_chars").alias("size"), F.when(F.col("lang") != "fr", F.col("source")).alias("note"))
    new = t.where("lang <> 'en'").select(k.alias("id"), F.upper("lang").alias("lang"), (F.col("n_chars") + 1).alias("size"), F.when(F.col("lang") != "de", F.concat(F.lit("n"), "source")).alias("note"))
    return old, new


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def upsert_merge(spark, d):
    old, new = _versions(spark, d)
    return m.merge(old, new, ["id"])


@query(f"""WITH {_OLD}, {_NEW} SELECT coalesce(n.id, o.id) AS id, coalesce(n.lang, o.lang) AS lang, CASE WHEN n.id IS NULL THEN o.size WHEN o.id IS NULL THEN n.size ELSE greatest(o.size, n.size) END AS size,
  CASE WHEN n.id IS NULL THEN o.note WHEN o.id IS NULL THEN n.note ELSE coalesce(n.note, o.note) END AS note FROM old o FULL OUTER JOIN new n ON o.id = n.id""")
def coalesce_upsert(spark, d):
    old, new = _versions(spark, d)
    return m.merge(old, new, ["id"], {"note": F.coalesce("new.note", "old.note"), "size": F.greatest("old.size", "new.size")})


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM old WHERE lang NOT IN (SELECT lower(lang) FROM new WHERE note IS NULL) UNION ALL SELECT id, lower(lang), size, note FROM new WHERE note IS NULL")
def replace_by_key(spark, d):
    old, new = _versions(spark, d)
    return m.replace_by_key(old, new.where("note is null").withColumn("lang", F.lower("lang")), ["lang"])


@query(f"WITH {_OLD}, {_NEW} SELECT id FROM old WHERE id NOT IN (SELECT id FROM new)")
def deleted_files(spark, d):
    old, new = _versions(spark, d)
    return m.delete_by_key(old, new, ["id"]).select("id")


@query(f"WITH {_OLD}, {_NEW} SELECT n.id, o.id IS NULL OR o.size <> n.size - 1 OR o.note IS NULL AS needs FROM new n LEFT JOIN old o ON o.id = n.id")
def needs_reindex(spark, d):
    old, new = _versions(spark, d)
    o = old.select("id", F.col("size").alias("s"), F.col("note").alias("t"))
    needs = F.col("s").isNull() | (F.col("s") != F.col("size") - 1) | F.col("t").isNull()
    return new.join(o, "id", "left").select("id", needs.alias("needs"))


@query(f"WITH {a.FILES}, seen AS (SELECT DISTINCT content_hash FROM files WHERE language = 'en') SELECT id, content_hash IN (SELECT content_hash FROM seen) AS cached FROM files")
def cached_vs_uncached(spark, d):
    f = a.files(spark, d).select("id", "language", "content_hash")
    seen = f.where("language = 'en'").select("content_hash").distinct().withColumn("hit", F.lit(True))
    return f.join(seen, "content_hash", "left").select("id", F.coalesce("hit", F.lit(False)).alias("cached"))


@query(f"WITH {a.FILES} SELECT content_hash, min(id) AS first_id, count(*) AS n FROM files GROUP BY content_hash")
def content_hashes(spark, d):
    return a.files(spark, d).groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def evict_by_age(spark, d):
    return a.table(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id", "ts")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 300")
def evict_to_limit(spark, d):
    return m.evict_to_limit(a.table(spark, d, "events").select("event_id", "ts"), 300, age_col="ts", key_col="event_id")


@query(f"WITH {a.QUEUE} SELECT file_id, priority, created_at FROM queue WHERE status = 'pending' ORDER BY priority DESC, created_at, file_id LIMIT 10")
def queue_pop(spark, d):
    return m.popped(a.queue(spark, d), 10).select("file_id", "priority", "created_at")


_Q2 = f"{a.QUEUE}, q2 AS (SELECT file_id // 2 AS file_id, priority, status FROM queue)"


@query(f"WITH {_Q2}, p AS (SELECT DISTINCT file_id FROM q2 WHERE status = 'pending') SELECT file_id, priority, status FROM q2 WHERE status <> 'processing' UNION ALL SELECT file_id, priority, 'pending' FROM q2 WHERE status = 'processing' AND file_id NOT IN (SELECT file_id FROM p)")
def queue_recover(spark, d):
    return m.recovered(a.queue(spark, d).select(F.floor(F.col("file_id") / 2).alias("file_id"), "priority", "status"))


@query(f"WITH {a.FILES} SELECT id, CASE WHEN path LIKE '/corpus/src2/%' THEN 'pending' ELSE 'completed' END AS status FROM files")
def force_reindex_scope(spark, d):
    return a.files(spark, d).select("id", F.when(F.col("path").startswith("/corpus/src2/"), "pending").otherwise("completed").alias("status"))


@query("SELECT DISTINCT l_partkey AS p_partkey, '?' AS version FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")
def missing_dependency_placeholder(spark, d):
    known = a.table(spark, d, "part").where("p_size < 25").select("p_partkey")
    return a.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(known, "p_partkey", "left_anti").withColumn("version", F.lit("?"))


@query(f"WITH {a.AUDIT} SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS start, tool_name, count(*) AS n, round(sum(latency_ms), 4) AS latency FROM audit GROUP BY 1, 2")
def audit_tumbling(spark, d):
    return w.tumbling(a.audit(spark, d), "1 hour").withColumn("latency", F.round("latency", 4))


@query(f"""WITH {a.AUDIT}, x AS (SELECT tool_name, latency_ms, unnest([time_bucket(INTERVAL 30 MINUTE, created_at), time_bucket(INTERVAL 30 MINUTE, created_at) - INTERVAL 30 MINUTE]) AS start FROM audit)
SELECT start, tool_name, count(*) AS n, round(sum(latency_ms), 4) AS latency FROM x GROUP BY 1, 2""")
def audit_sliding(spark, d):
    return w.tumbling(a.audit(spark, d), "1 hour", "30 minutes").withColumn("latency", F.round("latency", 4))


@query(f"""WITH {a.AUDIT}, g AS (SELECT user_id, created_at, CASE WHEN created_at >= lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM audit),
s AS (SELECT user_id, created_at, sum(cut) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(created_at) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def audit_session(spark, d):
    return w.sessions(a.audit(spark, d), "30 minutes")


@query(f"WITH {a.AUDIT} SELECT user_id, max_by(id, (created_at, id)) AS id, max_by(tool_name, (created_at, id)) AS tool_name FROM audit GROUP BY user_id")
def stream_latest_per_path(spark, d):
    return m.latest(a.audit(spark, d).select("user_id", "created_at", "id", "tool_name"), "user_id", ["created_at", "id"]).select("user_id", "id", "tool_name")


@query(f"WITH {a.AUDIT} SELECT user_id, tool_name, min(created_at) AS first_at FROM audit GROUP BY 1, 2")
def stream_dedup(spark, d):
    x = m.dedup_first(a.audit(spark, d), ["user_id", "tool_name"], ["created_at", "id"])
    return x.select("user_id", "tool_name", F.col("created_at").alias("first_at"))


@query(f"""WITH {a.AUDIT}, r AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 7 ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS run, 'u' || (user_id % 7) AS t FROM audit)
SELECT id, t AS tool_name, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY t, run ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures_in_row,
  sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY t, run ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) >= 3 AS open FROM r""")
def breaker_state(spark, d):
    return w.breaker(a.audit(spark, d).withColumn("tool_name", F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))), 3)


@query("SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations")
def conversation_turns(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id")
    return a.table(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("role").over(by.orderBy("turn")).alias("before"), F.count("*").over(by).alias("turns"))
