"""Merkle manifest of a dataset: one tree of digests per group of documents, one tree over the groups, and a proof per document.

A leaf is the SHA-256 of a document's fields. Within a group leaves stand in order, and every FANOUT consecutive nodes become
one node above, until one is left, the group's subroot; subroots become the root in the same way. Each level is one window over
(group, parent): its ordered collect_list is the parent's preimage and, without the node itself, the node's siblings. One row
per parent goes on to the next level, so a level costs a sixteenth of the one below, and the largest group is dealt over as
many keys as it has parents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, positions, stored

FANOUT = 16


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value as text; so fields can be put together unambiguously."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(group: Column) -> Column:
    """Text that sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def runs(nodes: DataFrame) -> DataFrame:
    """nodes (k, idx, digest, ...) with p (the parent's idx), parent (its digest), and what stands left and right of the node in its run."""
    run = Window.partitionBy("k", "p").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = nodes.withColumn("p", F.expr(f"idx div {FANOUT}")).withColumn("run", F.collect_list("digest").over(run))
    place = (F.col("idx") % FANOUT).cast("int")
    rows = rows.withColumn("left", F.array_join(F.slice("run", F.lit(1), place), "")).withColumn("right", F.array_join(F.slice("run", place + 2, F.lit(FANOUT)), ""))
    return rows.withColumn("parent", F.sha2(F.array_join("run", ""), 256)).drop("run")


def levels(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level above the lowest one, and the top of each group: (k, digest, depth)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    inner, tops, depth = [], nodes.where("n = 1").select("k", "digest", F.lit(0).alias("depth")), 0
    now = runs(nodes.where("n > 1").select("k", "idx", "digest", "n"))
    while most > 1:
        above = now.where(F.col("idx") % FANOUT == 0).select("k", F.col("p").alias("idx"), F.col("parent").alias("digest"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"))
        if not depth:
            above = stored(above, f"{name}-1")
        depth, most = depth + 1, -(-most // FANOUT)
        tops = tops.union(above.where("n = 1").select("k", "digest", F.lit(depth)))
        if most > 1:
            now = stored(runs(above.where("n > 1")), f"{name}-{depth}-runs")
            inner.append(now)
    return inner, tops


def proofs(nodes: DataFrame, inner: list[DataFrame], tops: DataFrame) -> DataFrame:
    """nodes with proof, an array of (left, right) from the node's run to the top of all, and with subroot.

    tops (k, depth, subroot, proof): the proof of each group's top. A level's rows meet their parents, a sixteenth of them.
    """
    lowest = nodes.where("n > 1")
    up, step = None, F.array(F.struct("left", "right"))
    kept = [c for c in nodes.columns if c not in ("k", "idx", "n")]
    for depth in range(len(inner), -1, -1):
        ended = tops.where(F.col("depth") == depth + 1).select("k", F.lit(0).cast("long").alias("p"), F.col("proof").alias("rest"), "subroot")
        up = ended if up is None else ended.unionByName(up)
        now = inner[depth - 1] if depth else runs(lowest)
        now = now.join(up, ["k", "p"]).withColumn("proof", F.concat(step, "rest"))
        up = now.select("k", F.col("idx").alias("p"), F.col("proof").alias("rest"), "subroot")
    alone = nodes.where("n = 1").join(tops.where("depth = 0").select("k", "proof", "subroot"), "k")
    return now.select(*kept, "proof", "subroot").unionByName(alone.select(*kept, "proof", "subroot"))


def folded(digest: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, digest, lambda now, s: F.sha2(F.concat(s["left"], now, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


@dataclass
class Manifest:
    """leaves: doc_id, leaf, other columns asked for, subroot and proof; groups: k, subroot, depth; root: the digest of all (None for no rows)."""

    leaves: DataFrame
    groups: DataFrame
    root: str | None


def manifest(docs: DataFrame, fields: tuple[str, ...], *, id_col: str = "doc_id", group_col: str = "source", extra: dict[str, Column] | None = None) -> Manifest:
    """The trees of docs over the named fields, and each document's proof.

    Leaves of a group ascend by id, null first, then by digest, so rows with one id have an order and equal rows are equal
    leaves. Null groups are a group, the first. Every document is hashed whole; null fields have a mark of their own, so they differ from
    empty ones. extra: more columns of the leaves, computed as documents are read. Other columns are not read, whatever their
    names. An empty table has no leaves and no root.
    """
    of = lambda c: F.col(f"`{c}`")
    rows = stored(
        docs.select(group_key(of(group_col)).alias("k"), of(id_col).alias("doc_id"), leaf(*map(of, fields)).alias("digest"), *[c.alias(a) for a, c in (extra or {}).items()]), "merkle-leaves"
    )
    nodes = positions(rows, [F.col("doc_id").asc_nulls_first(), F.col("digest")], "merkle-positions")
    inner, tops = levels(nodes, "merkle")
    groups = stored(tops.withColumnRenamed("k", "group"), "merkle-groups")
    heads = positions(groups.select(F.lit("").alias("k"), "group", "digest", "depth"), [F.col("group")], "merkle-heads")
    above, top = levels(heads, "merkle-top")
    found = top.first()
    root = found and found["digest"]
    start = top.select("k", "depth", F.lit(root).alias("subroot"), F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    ends = proofs(heads.withColumnRenamed("depth", "own_depth"), above, start).select(F.col("group").alias("k"), F.col("own_depth").alias("depth"), F.col("digest").alias("subroot"), "proof")
    ends = stored(ends, "merkle-ends")
    leaves = proofs(nodes, inner, ends).withColumnRenamed("digest", "leaf")
    return Manifest(leaves, groups.select(F.col("group").alias("k"), F.col("digest").alias("subroot"), "depth"), root)


def changed(one: Manifest, other: Manifest) -> DataFrame:
    """Documents whose leaf is in one manifest only: doc_id, leaf, side (`one` or `other`). Groups with equal subroots are not compared further.

    A leaf that is there more often on one side is told as often as it is there more.
    """
    differ = one.groups.select("k", F.col("subroot").alias("a")).join(other.groups.select("k", F.col("subroot").alias("b")), "k", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    subroots = differ.select(F.explode(F.array("a", "b")).alias("subroot")).where("subroot is not null").distinct()
    a, b = (m.leaves.join(subroots, "subroot", "left_semi").select("doc_id", "leaf") for m in (one, other))
    return a.exceptAll(b).withColumn("side", F.lit("one")).union(b.exceptAll(a).withColumn("side", F.lit("other")))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf of a document whose text has its A-Z in lower case."""
    return leaf(*[lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
