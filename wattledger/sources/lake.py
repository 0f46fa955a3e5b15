"""Layered Parquet tables partitioned by feeder: reading, replacing, exporting."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattledger import schemas
from wattledger.sources.snapshots import Snapshots


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def snapshots(self) -> Snapshots:
        """What runs have written: gold, system tables and states, by the manifest of each run."""
        return Snapshots(self.spark, f"{self.root}/snapshots")

    def path(self, layer: str, entity: str) -> str:
        return f"{self.root}/{layer}/{entity}"

    def read_entity(self, layer: str, entity: str, feeder_id: str | None = None) -> DataFrame:
        """Whole entity, or one feeder by partition pruning.

        Bronze entities are read with their canonical schema, so no footer is read to find
        it and older files simply lack newer columns.  An entity that was never written is
        an empty frame; every other failure is raised.
        """
        known = entity in schemas.entities()
        reader = self.spark.read.schema(schemas.schema(entity)) if known and layer == "bronze" else self.spark.read
        try:
            df = reader.parquet(self.path(layer, entity))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schemas.schema(entity) if known else schemas.T.StructType([]))
        return df if feeder_id is None else df.where(F.col("feeder_id") == feeder_id)

    def write_partitions(self, layer: str, entity: str, df: DataFrame, extract_date: str | None = None) -> None:
        """Replace exactly the feeders present in ``df``: arrivals.  What a run leaves goes to ``snapshots``.

        Rebalancing by feeder gives each feeder few large files and splits a feeder
        that holds much of the data over several writers.
        """
        keys = ["feeder_id"]
        if extract_date is not None:
            df, keys = df.withColumn("extract_date", F.lit(extract_date)), ["feeder_id", "extract_date"]
        spread = self.spark.sql("SELECT /*+ REBALANCE(feeder_id) */ * FROM {df}", df=df)
        (
            spread.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .parquet(self.path(layer, entity))
        )

    def list_feeders(self) -> DataFrame:
        """Feeders that have a head meter; only partition values are read."""
        return self.read_entity("bronze", "header_meters").select("feeder_id").distinct()

    def query(self, sql: str, layer: str, entities: list[str]) -> DataFrame:
        """Free SQL over ``<layer>_<entity>`` views."""
        for entity in entities:
            self.read_entity(layer, entity).createOrReplaceTempView(f"{layer}_{entity}")
        return self.spark.sql(sql)


def read_tabular(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet or CSV by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    if suffix in ("csv", "txt"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"unsupported format: {suffix}")


def read_layers_csv(spark: SparkSession, directory: str, layers: list[str]) -> dict[str, DataFrame]:
    """One CSV file or folder per source layer, all columns as text."""
    return {name: read_tabular(spark, f"{directory.rstrip('/')}/{name}.csv") for name in layers}


def export_csv(df: DataFrame, path: str, feeders: list[str] | None = None) -> None:
    chosen = df if feeders is None else df.where(F.col("feeder_id").isin(feeders))
    chosen.write.mode("overwrite").option("header", True).csv(path)


# --- geometry -----------------------------------------------------------------


def points(rows: DataFrame, poles: DataFrame) -> DataFrame:
    """Rows with the coordinates of their pole; rows without coordinates drop out."""
    place = poles.groupBy("pole_id").agg(F.min(F.struct("x", "y")).alias("xy"))
    placed = rows.join(place, "pole_id").withColumn("x", F.col("xy.x")).withColumn("y", F.col("xy.y")).drop("xy")
    return placed.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def wkt_point(x: Column, y: Column) -> Column:
    return F.format_string("POINT(%.1f %.1f)", x, y)


def node_coordinates(sites: DataFrame, customers: DataFrame, poles: DataFrame) -> DataFrame:
    """Where each node stands: site nodes and their secondary side, meters, and the source
    at the centroid of its feeder's poles."""
    at_sites = points(sites, poles)
    low = at_sites.select("feeder_id", F.concat("node_id", F.lit("_S")).alias("node"), "x", "y")
    high = at_sites.select("feeder_id", F.col("node_id").alias("node"), "x", "y")
    meters = points(customers, poles).select("feeder_id", F.col("customer_unit_id").alias("node"), "x", "y")
    source = poles.groupBy("feeder_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select(
        "feeder_id", F.concat("feeder_id", F.lit("-SRC")).alias("node"), "x", "y"
    )
    every = high.unionByName(low).unionByName(meters).unionByName(source)
    return every.groupBy("feeder_id", "node").agg(F.min(F.struct("x", "y")).alias("xy")).select(
        "feeder_id", "node", "xy.x", "xy.y"
    )


def lines(segments: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Segments whose two ends have coordinates, as WKT lines."""
    a = coordinates.select("feeder_id", F.col("node").alias("node_from"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = coordinates.select("feeder_id", F.col("node").alias("node_to"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    wkt = F.format_string("LINESTRING(%.1f %.1f,%.1f %.1f)", *[F.round(c, 1) for c in ("x1", "y1", "x2", "y2")])
    return (
        segments.join(a, ["feeder_id", "node_from"])
        .join(b, ["feeder_id", "node_to"])
        .withColumn("wkt", wkt)
    )


def result_layer(geometry: DataFrame, result: DataFrame, key: str) -> DataFrame:
    """Result rows with the geometry of their element."""
    drop = [c for c in result.columns if c in geometry.columns and c != key]
    return geometry.join(result.drop(*drop), key)
