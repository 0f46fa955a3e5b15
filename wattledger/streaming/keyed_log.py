"""A keyed log: rows arrive in batches, the latest row of a key counts.

Batches are only ever added.  Readers merge what the last compaction left with the batches
after it.  A compaction rewrites the feeders that those batches touched, as one snapshot
with the number of the last batch it holds, so it counts as a whole or not at all.  Every batch leaves its
content sums beside it: which feeders it touched, and what it adds to their input hash,
is known without reading a row of it.

Rows whose key says nothing (``identified`` is not true) correct no other row: all of them count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.operators.incremental import content_sums
from wattledger.session import materialize
from wattledger.sources.snapshots import Snapshots

_BATCH = "batch_id"
_SUMS = "feeder_id string, t string, h decimal(20,0), n long, batch_id long"


class KeyedLog:
    def __init__(self, spark: SparkSession, root: str, entity: str, schema: T.StructType, key: Sequence[str], identified: str | None = None):
        """``schema`` holds the columns of a row, ``feeder_id`` and the ``key`` among them.

        ``identified`` is an SQL condition, by default that no column of the key is null.
        """
        self.spark, self.root, self.entity, self.schema = spark, root.rstrip("/"), entity, schema
        self.key = list(dict.fromkeys(["feeder_id", *key]))
        self.values = [f.name for f in schema.fields if f.name not in self.key]
        self.identified = F.coalesce(F.expr(identified or " AND ".join(f"{c} IS NOT NULL" for c in self.key)), F.lit(False))
        self.base = Snapshots(spark, f"{self.root}/base")

    def _read(self, folder: str, schema: T.StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def land(self, rows: DataFrame, batch_id: int) -> None:
        """Add a batch; a batch that is delivered again after a failure replaces itself.

        Of rows of one key in one batch the one with the largest values stays, so the
        outcome does not depend on their order.
        """
        once = materialize(self._latest(rows.select(*self.schema.names)), "batch")

        def put(frame: DataFrame, folder: str, *by: str) -> None:
            frame.withColumn(_BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/{folder}")

        put(once, "batches", _BATCH, "feeder_id")
        # last: a batch without sums is one that did not land to its end
        put(content_sums(once, self.entity), "sums", _BATCH)

    def _latest(self, rows: DataFrame, *order: str) -> DataFrame:
        """Per key the row that is last in ``order`` and then in its values; rows that are not identified as they are."""
        last = rows.where(self.identified).groupBy(*self.key).agg(F.max(F.struct(*order, *self.values)).alias("v"))
        return last.select(*self.key, "v.*").select(*self.schema.names).unionByName(rows.where(~self.identified).select(*self.schema.names))

    def sums(self) -> DataFrame:
        """(feeder_id, t, h, n, batch_id): what every landed batch added, for ``hash_of_sums``."""
        return self._read("sums", _SUMS)

    def compacted(self) -> int:
        """Number of the last batch that the base holds; -1 before the first compaction."""
        state = self.base.read("log", "state")
        found = state.first() if state.columns else None
        return -1 if found is None else found.upto

    def touched(self, after: int | None = None) -> DataFrame:
        """Feeders of the batches after one, by default after the last compaction."""
        after = self.compacted() if after is None else after
        return self.sums().where(F.col(_BATCH) > after).select("feeder_id").distinct()

    def _merged(self, upto: int) -> DataFrame:
        """Base and later batches, the latest row of every key."""
        stored = T.StructType([f for f in self.schema if f.name != "feeder_id"]).add(_BATCH, T.LongType()).add("feeder_id", T.StringType())
        landed = self.sums().where(F.col(_BATCH) > upto).select(_BATCH).distinct()
        later = self._read("batches", stored).where(F.col(_BATCH) > upto).join(landed, _BATCH, "left_semi")
        base = self.base.read("log", self.entity)
        rows = later.select(*self.schema.names, _BATCH)
        if base.columns:
            rows = rows.unionByName(base.withColumn(_BATCH, F.lit(-1).cast("long")))
        return self._latest(rows, _BATCH)

    def read(self) -> DataFrame:
        """The latest row of every key."""
        return self._merged(self.compacted())

    def compact(self) -> int:
        """Rewrite the feeders that were touched since; the others keep the files they have.  Returns the last batch."""
        upto = self.compacted()
        newest = self.sums().agg(F.max(_BATCH)).first()[0]
        if newest is None or newest <= upto:
            return upto
        touched = materialize(self.touched(upto), "touched")
        writer = self.base.begin()
        names = touched.withColumnRenamed("feeder_id", "touched_id")
        rewritten = self._merged(upto).join(names, F.col("feeder_id").eqNullSafe(F.col("touched_id")), "left_semi")
        writer.write("log", self.entity, rewritten, touched)
        writer.write("log", "state", self.spark.createDataFrame([(newest,)], "upto long"))
        writer.commit()
        return newest
