"""Tables of immutable segments, and versions that name the segments of all of them at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedimenta.sources.versions import Versions


class Store:
    """Readers see the tables of one version; a writer adds segments in new folders and then makes the next version by naming them.

    A segment that no version names (a failed writer's) is never read. Rows carry the column `seg`, the name of their segment.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/_versions")

    def state(self) -> tuple[int, dict]:
        """The current number, and {tables: {name: {segments, schema}}, meta}."""
        n, content = self.versions.latest()
        return n, content or {"tables": {}, "meta": {}}

    @staticmethod
    def new_segment() -> str:
        return f"s{uuid.uuid4().hex}"

    def write(self, name: str, df: DataFrame, seg: str, by: tuple[str, ...] = ()) -> DataFrame:
        """Writes df as a segment, in folders by the columns `by`, and reads it again."""
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(f"{self.path}/{name}/seg={seg}")
        return self.segments(name, [seg], df.schema)

    def segments(self, name: str, segs: list[str], schema: StructType) -> DataFrame:
        schema = StructType(list(schema.fields)).add("seg", "string")
        root = f"{self.path}/{name}"
        return self.spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/seg={s}" for s in segs])

    def read(self, name: str, state: dict | None = None) -> DataFrame | None:
        state = state or self.state()[1]
        table = state["tables"].get(name)
        return table and self.segments(name, table["segments"], StructType.fromJson(json.loads(table["schema"])))

    def commit(self, number: int, state: dict, added: dict[str, StructType], seg: str, meta: dict, replace: bool = False) -> int:
        """Makes version number + 1: state's tables with the segment seg of each table in `added` (or with it alone), and state's meta with meta."""
        tables = {} if replace else {k: dict(v) for k, v in state["tables"].items()}
        for name, schema in added.items():
            before = tables.get(name, {"segments": []})["segments"]
            tables[name] = {"segments": [*before, seg], "schema": schema.json()}
        self.versions.put(number + 1, {"tables": tables, "meta": {**state["meta"], **meta}})
        return number + 1

    def clean(self, keep: int = 1) -> int:
        """Deletes the segments that none of the last `keep` versions names, and older versions; returns how many folders went.

        Not while another writer works: its segments have no version yet.
        """
        numbers = self.versions.numbers()
        held = [c for n in numbers[-keep:] if (c := self.versions.get(n))]
        named = {(t, s) for c in held for t, v in c["tables"].items() for s in v["segments"]}
        fs, path = self.versions._fs()
        gone = []
        for table in fs.listStatus(path(self.path)):
            name = table.getPath().getName()
            if table.isDirectory() and not name.startswith("_"):
                for s in fs.listStatus(table.getPath()):
                    if (name, s.getPath().getName().removeprefix("seg=")) not in named:
                        gone.append(s.getPath().toString())
        self.versions.drop(gone, numbers[:-keep])
        return len(gone)


def latest_by(log: DataFrame, key: str) -> DataFrame:
    """The row of each key's last version: a partial aggregate."""
    rest = [c for c in log.columns if c not in (key, "version")]
    top = log.groupBy(key).agg(F.max(F.struct("version", *rest)).alias("x"))
    return top.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])
