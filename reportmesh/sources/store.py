"""Snapshot tables on plain Parquet with an atomic pointer.

A publish writes every table under a fresh ``snapshot_id=...`` folder and only then adds the next
numbered pointer file; the file with the highest number is the snapshot. A job that fails earlier adds
none, and readers always see the tables of one snapshot. The new file is renamed into place and never
over another, so of two publishers that began from the same snapshot one fails and loses nothing.

A table may be laid out by columns (``partition_by``): each publish then writes folders of their values,
and readers that filter or semi-join on them open those folders only. A keyed table (``key``) takes new
versions of rows; a read gives the newest version of each key, without those marked ``_gone``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import together

POINTER = "_SNAPSHOT-"
#: A table never has more folders of appended rows than this.
MAX_FOLDERS = 32


@dataclass(frozen=True)
class TableSpec:
    """Layout of a table: folders by column values, and the key of versioned rows."""

    partition_by: tuple[str, ...] = ()
    key: tuple[str, ...] = ()


def newest(rows: DataFrame, key: tuple[str, ...] | list[str]) -> DataFrame:
    """The newest version of each key, without versions marked ``_gone``: one combined aggregate."""
    rest = [c for c in rows.columns if c not in (*key, "_seq")]
    return (
        rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_seq").alias("_row"))
        .select(*key, *[F.col("_row").getField(c).alias(c) for c in rest])
        .filter(~F.col("_gone")).drop("_gone")
    )


class CheckFailed(RuntimeError):
    """A table broke a check while it was written; nothing was published."""


class ConcurrentPublish(RuntimeError):
    """Another snapshot was published since the one this work began from."""


class SnapshotStore:
    """Named tables under ``root`` (any Hadoop file system the executors share)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # -- file system ----------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def _latest(self) -> int:
        """Number of the newest pointer, 0 without any."""
        fs, root, jvm = self._fs(self.root)
        if not fs.exists(root):
            return 0
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{POINTER}*"))
        return max((int(f.getPath().getName()[len(POINTER) :]) for f in found), default=0)

    def _read_pointer(self) -> dict | None:
        number = self._latest()
        if not number:
            return None
        fs, path, jvm = self._fs(f"{self.root}/{POINTER}{number:012d}")
        stream = fs.open(path)
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {**json.loads(text), "number": number}

    def _add_pointer(self, number: int, content: dict) -> None:
        """Write aside, then rename to a name that must be free: the only step readers can observe."""
        fs, target, jvm = self._fs(f"{self.root}/{POINTER}{number:012d}")
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_aside-{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(content).encode("utf-8")))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(
            jvm.org.apache.hadoop.fs.Options.Rename, 1
        )
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(target), options)
        except Exception as error:
            fs.delete(aside, False)
            if fs.exists(target):
                raise ConcurrentPublish(f"snapshot {number} is published already") from error
            raise

    # -- snapshots ------------------------------------------------------------------------------

    def current(self) -> str | None:
        pointer = self._read_pointer()
        return None if pointer is None else pointer["snapshot_id"]

    def metadata(self) -> dict:
        pointer = self._read_pointer()
        return {} if pointer is None else pointer.get("metadata", {})

    def tables(self) -> tuple[str, ...]:
        pointer = self._read_pointer()
        return () if pointer is None else tuple(sorted(pointer["tables"]))

    def read(self, table: str) -> DataFrame:
        """Table of the current snapshot; filters and columns reach the Parquet scan."""
        rows, spec = self.read_rows(table)
        return newest(rows, spec.key) if spec.key else rows

    def read_rows(self, table: str) -> tuple[DataFrame, TableSpec]:
        """All stored rows of a table, old versions of keyed rows too, and its layout."""
        pointer = self._read_pointer()
        if pointer is None or table not in pointer["tables"]:
            raise LookupError(f"table {table} is not published")
        spec = _spec_of(pointer, table)
        return self._scan(table, pointer["tables"][table], pointer.get("schemas", {}).get(table)), spec

    def _scan(self, table: str, paths: list[str], schema: str | None) -> DataFrame:
        if schema is None:
            return self.spark.read.parquet(*paths)
        # folders of several publishes: their own names are no column
        reader = self.spark.read.schema(StructType.fromJson(json.loads(schema)))
        found = reader.option("basePath", f"{self.root}/{table}").parquet(*paths)
        return found.drop("snapshot_id")

    def publish(
        self,
        replaced: dict[str, DataFrame] | None = None,
        appended: dict[str, DataFrame] | None = None,
        metadata: dict | None = None,
        base: str | None = None,
        specs: dict[str, TableSpec] | None = None,
        metrics: dict[str, dict[str, Column]] | None = None,
        verify: Callable[[dict[str, dict]], list[str]] | None = None,
    ) -> str:
        """Replace and/or append tables as one new snapshot; untouched tables carry over.

        Appended rows become an extra folder next to the existing ones. Folders merge by size class, a
        few equally large ones into one of the next class, so a row is rewritten a logarithmic number of
        times and an append touches history seldom. ``specs`` lay out tables that this publish creates.
        ``base`` is the snapshot the tables were computed from; if another is current, or becomes so
        meanwhile, ConcurrentPublish is raised.

        ``metrics`` are aggregates of tables of this publish, observed while they are written; ``verify``
        gets them by table and names what is wrong, in which case CheckFailed is raised and no pointer moves.
        """
        pointer = self._read_pointer() or {"tables": {}, "number": 0}
        if base is not None and pointer.get("snapshot_id") != base:
            raise ConcurrentPublish(f"{base} is not the current snapshot")
        snapshot, number = uuid.uuid4().hex, pointer["number"] + 1
        tables = {name: list(paths) for name, paths in pointer["tables"].items()}
        weights = {name: list(w) for name, w in pointer.get("weights", {}).items()}
        schemas, laid_out = dict(pointer.get("schemas", {})), dict(pointer.get("specs", {}))
        for name, spec in (specs or {}).items():
            if name not in tables:
                laid_out[name] = asdict(spec)

        observed: dict[str, Observation] = {}

        def writing(name: str, df: DataFrame, path: str, old: list[str]) -> Callable[[], None]:
            if name in (metrics or {}):
                observed[name] = Observation(f"{name}-{snapshot}")
                df = df.observe(observed[name], *[column.alias(metric) for metric, column in metrics[name].items()])
            spec = _spec_of({"specs": laid_out}, name)
            if spec.key:
                df = df.withColumn("_seq", F.lit(number).cast("long"))
                if "_gone" not in df.columns:
                    df = df.withColumn("_gone", F.lit(False))
            if spec.partition_by:
                if name in schemas:  # the same columns in all folders
                    known = StructType.fromJson(json.loads(schemas[name]))
                    df = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known])
                else:
                    schemas[name] = df.schema.json()
            if old:
                df = self._scan(name, old, schemas.get(name)).unionByName(df, allowMissingColumns=True)
            writer = df
            if spec.partition_by:  # rows of a folder meet in one task, or in several if they are many
                writer = df.hint("rebalance", *[F.col(c) for c in spec.partition_by])
            return lambda: writer.write.mode("errorifexists").partitionBy(*spec.partition_by).parquet(path)

        writes = []

        for name, df in (replaced or {}).items():
            path = f"{self.root}/{name}/snapshot_id={snapshot}"
            schemas.pop(name, None)
            writes.append(writing(name, df, path, []))
            tables[name], weights[name] = [path], [0]
        for name, df in (appended or {}).items():
            path, old = f"{self.root}/{name}/snapshot_id={snapshot}-append", tables.get(name, [])
            weight = weights.get(name, [0] * len(old))
            merged, size = _to_merge(weight)
            writes.append(writing(name, df, path, old[len(old) - merged :]))
            tables[name] = [*old[: len(old) - merged], path]
            weights[name] = [*weight[: len(weight) - merged], size]
        together(self.spark, writes)
        broken = verify({name: seen.get for name, seen in observed.items()}) if verify else []
        if broken:
            raise CheckFailed("; ".join(broken))
        kept = {**pointer.get("metadata", {}), **(metadata or {})}
        content = {"snapshot_id": snapshot, "tables": tables, "metadata": kept, "weights": weights, "schemas": schemas, "specs": laid_out}
        self._add_pointer(number, content)
        return snapshot

    def compact(self, table: str) -> str:
        """Rewrite the folders of one table as a single folder; of a keyed one the newest versions."""
        return self.publish(replaced={table: self.read(table)}, base=self.current())


def _spec_of(pointer: dict, table: str) -> TableSpec:
    found = pointer.get("specs", {}).get(table, {})
    return TableSpec(tuple(found.get("partition_by", ())), tuple(found.get("key", ())))


def _to_merge(weights: list[int]) -> tuple[int, int]:
    """How many of the last folders the next append takes in, and the weight of what results.

    A weight counts the appends in a folder; 0 stands for a replaced table, which only a full list of
    folders makes part of a merge.
    """
    if len(weights) >= MAX_FOLDERS:
        return len(weights), 0
    group = max(2, MAX_FOLDERS // 4)
    taken, size = 0, 1
    while weights[len(weights) - taken - group + 1 : len(weights) - taken] == [size] * (group - 1):
        taken, size = taken + group - 1, size * group
    return taken, size


def read_complaints(
    table: DataFrame, *, ids: list[str] | None = None, ordered: bool = False
) -> DataFrame:
    """Stored complaints, optionally a point read by id, optionally in id order."""
    if ids is not None:
        table = table.filter(F.col("id").isin(*ids))
    return table.orderBy("id") if ordered else table
