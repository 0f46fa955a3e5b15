"""Results of runs as snapshots: versioned feeder partitions, and one manifest per run that says which count.

A run writes its rows below ``run=<id>`` and never touches those of other runs.  Its
manifest, written last, names for every table and feeder the run that holds the rows:
this one for what was analysed (also where that left no rows), an earlier one for what
did not change, none for what is gone.  Readers follow the newest complete manifest, so
they see all of a run or nothing of it, and old snapshots stay readable until they
are cleared.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.session import materialize

#: partition of tables that belong to no feeder
SYSTEM = "all"
#: partition of rows without a feeder
NO_FEEDER = "(none)"
#: one row per table and feeder; a row without feeder carries the schema of the table
MANIFEST = "layer string, entity string, feeder_id string, run string, schema string"


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def runs(self) -> list[str]:
        """Complete runs, oldest first; a manifest counts once the job that wrote it has committed."""
        folder = f"{self.root}/manifests"
        return [n for n in self._names(folder) if self._fs.exists(self._path(f"{folder}/{n}/_SUCCESS"))]

    def manifest(self, run: str | None = None) -> DataFrame:
        """Rows of one run's manifest, by default the newest; none before the first run."""
        done = self.runs()
        if run is not None and run not in done:
            raise ValueError(f"no complete run {run}")
        if not done:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{run or done[-1]}")

    def path(self, layer: str, entity: str) -> str:
        return f"{self.root}/{layer}/{entity}"

    def read(self, layer: str, entity: str, run: str | None = None, manifest: DataFrame | None = None) -> DataFrame:
        """A table as a manifest has it; without columns if it was never written.

        Only partitions that the manifest names are read.
        """
        manifest = self.manifest(run) if manifest is None else manifest
        mine = manifest.where((F.col("layer") == layer) & (F.col("entity") == entity))
        known = mine.where("feeder_id IS NULL").select("schema").first()
        if known is None:
            return self.spark.createDataFrame([], T.StructType([]))
        schema = T.StructType.fromJson(json.loads(known.schema))
        stored = T.StructType([*[f for f in schema if f.name != "feeder_id"], T.StructField("run", T.StringType()), T.StructField("feeder_id", T.StringType())])
        try:
            rows = self.spark.read.schema(stored).parquet(self.path(layer, entity))
        except AnalysisException as error:
            # no run has had a row of this table
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        named = mine.where("feeder_id IS NOT NULL").select("run", "feeder_id")
        found = rows.join(named, ["run", "feeder_id"], "left_semi")
        return found.withColumn("feeder_id", F.nullif("feeder_id", F.lit(NO_FEEDER))).select(*schema.names)

    def begin(self) -> Writer:
        return Writer(self)

    def clear(self, keep: int = 1) -> list[str]:
        """Delete manifests but the newest ``keep`` and what no kept manifest names; returns the deleted runs.

        Call it while no run is being written: rows of an unfinished run are in no manifest.
        """
        kept = self.runs()[-keep:]
        gone = [n for n in self._names(f"{self.root}/manifests") if n not in kept]
        # (table, run) pairs: as many as tables times the runs that still hold a feeder
        named = {(r.layer, r.entity, r.run) for k in kept for r in self.manifest(k).where("run IS NOT NULL").select("layer", "entity", "run").distinct().collect()}
        for layer in self._names(self.root):
            for entity in self._names(f"{self.root}/{layer}") if layer != "manifests" else []:
                for folder in self._names(self.path(layer, entity)):
                    if folder.startswith("run=") and (layer, entity, folder.removeprefix("run=")) not in named:
                        self._fs.delete(self._path(f"{self.path(layer, entity)}/{folder}"), True)
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/manifests/{n}"), True)
        return gone


class Writer:
    """One run: tables are written as they come, and count from ``commit`` on."""

    def __init__(self, store: Snapshots):
        self.store, self.spark = store, store.spark
        done = store.runs()
        number = int(done[-1].split("-")[0]) + 1 if done else 1
        #: the random end keeps rows of a run that broke off out of a later one
        self.run = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        self.before = store.manifest()
        self._rows: list[DataFrame] = []
        self._tables: dict[tuple[str, str], tuple[str, DataFrame | None]] = {}

    def write(self, layer: str, entity: str, df: DataFrame, feeders: DataFrame | None = None) -> None:
        """Rows of this run for ``feeders`` (all rows those feeders have from now on; maybe none).

        Without ``feeders`` the table is replaced as a whole.  A table without feeder_id is
        one partition of the system.
        """
        if "feeder_id" not in df.columns:
            df = df.withColumn("feeder_id", F.lit(SYSTEM))
        df = df.withColumn("feeder_id", F.coalesce("feeder_id", F.lit(NO_FEEDER)))
        spread = self.spark.sql("SELECT /*+ REBALANCE(feeder_id) */ * FROM {df}", df=df)
        target = f"{self.store.path(layer, entity)}/run={self.run}"
        spread.write.partitionBy("feeder_id").parquet(target)
        self._tables[layer, entity] = json.dumps(df.schema.jsonValue()), feeders
        # which feeders have rows is read off the partitions
        written = self.spark.read.schema(df.schema).parquet(target).select("feeder_id").distinct()
        self._rows.append(written.select(F.lit(layer).alias("layer"), F.lit(entity).alias("entity"), "feeder_id", F.lit(self.run).alias("run"), F.lit(None).cast("string").alias("schema")))

    def manifest(self, alive: DataFrame | None = None) -> DataFrame:
        """The manifest that ``commit`` would write now."""
        own = self._rows[0] if self._rows else self.spark.createDataFrame([], MANIFEST)
        for rows in self._rows[1:]:
            own = own.unionByName(rows)
        kept = self.before.where("feeder_id IS NOT NULL")
        for (layer, entity), (_, feeders) in self._tables.items():
            table = (F.col("layer") == layer) & (F.col("entity") == entity)
            if feeders is None:
                kept = kept.where(~table)
        partial = [(*key, feeders) for key, (_, feeders) in self._tables.items() if feeders is not None]
        # all tables that were written for the same feeders lose them in one join
        for feeders in {id(f): f for *_, f in partial}.values():
            inside = F.concat_ws("/", "layer", "entity").isin([f"{layer}/{entity}" for layer, entity, f in partial if f is feeders])
            replaced = feeders.select(F.coalesce("feeder_id", F.lit(NO_FEEDER)).alias("feeder_id")).distinct().withColumn("replaced", F.lit(True))
            kept = kept.join(replaced, "feeder_id", "left").where(F.col("replaced").isNull() | ~inside).drop("replaced")
        if alive is not None:
            living = alive.select("feeder_id").unionByName(self.spark.createDataFrame([(SYSTEM,)], "feeder_id string")).distinct()
            kept, own = (rows.join(living, "feeder_id", "left_semi") for rows in (kept, own))
        schemas = [(layer, entity, None, None, text) for (layer, entity), (text, _) in self._tables.items()]
        new = self.spark.createDataFrame(schemas, MANIFEST)
        old = self.before.where("feeder_id IS NULL").join(new.select("layer", "entity"), ["layer", "entity"], "left_anti")
        columns = [c.split()[0] for c in MANIFEST.split(", ")]
        return kept.select(*columns).unionByName(own.select(*columns)).unionByName(new).unionByName(old.select(*columns))

    def read(self, layer: str, entity: str) -> DataFrame:
        """A table as it will be after this run."""
        return self.store.read(layer, entity, manifest=materialize(self.manifest(), "manifest"))

    def commit(self, alive: DataFrame | None = None) -> str:
        """Make the run count.  Feeders that are not ``alive`` leave every table, but for the system's own partitions."""
        target = f"{self.store.root}/manifests/{self.run}"
        self.manifest(alive).write.parquet(target)
        # committing a job writes the mark by which readers know a complete manifest; stores may switch it off
        mark = self.store._path(f"{target}/_SUCCESS")
        if not self.store._fs.exists(mark):
            self.store._fs.create(mark).close()
        return self.run


def counts(store: Snapshots, layer: str, entities: Iterable[str]) -> DataFrame:
    """(entity, rows, feeders) of tables as the newest manifest has them."""
    manifest, out = store.manifest(), None
    for name in entities:
        table = store.read(layer, name, manifest=manifest)
        per = (table if table.columns else table.withColumn("feeder_id", F.lit(""))).groupBy("feeder_id").agg(F.count(F.lit(1)).alias("n"))
        one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("feeders")).select(F.lit(name).alias("entity"), "rows", "feeders")
        out = one if out is None else out.unionByName(one)
    return out
