"""Load-curve clustering on the shape of each meter's series."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.functions.numeric import rnd
from wattledger.operators import series as S
from wattledger.session import materialize


def shapes(series: DataFrame) -> DataFrame:
    """Series divided by its own mean; meters without consumption carry no shape."""
    rows = series.withColumn("mu", S.mean(F.col("kwh")))
    shape = F.when(F.col("mu") > 0, S.bind(F.col("mu"), lambda mu: F.transform("kwh", lambda v: v / mu)))
    return rows.select("feeder_id", "customer_unit_id", "months", shape.alias("shape"))


def load_curves(series: DataFrame, k: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(meter -> cluster, centroid rows); cluster -1 marks meters without consumption."""
    rows = materialize(shapes(series), "shapes")
    used = rows.where(F.col("shape").isNotNull()).withColumn("x", array_to_vector("shape"))
    model = KMeans(k=k, seed=seed, featuresCol="x", predictionCol="cluster", maxIter=30).fit(used)
    assigned = model.transform(used).select("feeder_id", "customer_unit_id", "cluster")
    none = rows.where(F.col("shape").isNull()).select("feeder_id", "customer_unit_id", F.lit(-1).alias("cluster"))
    # a centroid is the mean shape of its members, one row per cluster and period
    members = assigned.join(rows, ["feeder_id", "customer_unit_id"]).select(
        "cluster", F.explode(F.arrays_zip("months", "shape")).alias("z")
    )
    centroids = members.groupBy("cluster", F.col("z.months").alias("year_month")).agg(
        rnd(F.avg("z.shape"), 6).alias("level"), F.count(F.lit(1)).alias("n_members")
    )
    return assigned.unionByName(none), centroids
