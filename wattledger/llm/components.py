"""Connected components of a table of links by neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattledger.session import materialize, materialize_with


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id of ``links`` (a, b): label is the smallest id it is connected with.

    Labels start as the smallest neighbour; each round takes the neighbours' smallest label
    and then the label's own label, so the rounds grow with the logarithm of a chain, not
    with its length.  A hub is one key of a join whose other side has unique keys, which
    adaptive execution splits, and of a sum that is combined before the shuffle.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        told = labels.join(heard, "id").select("id", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        own = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
        jumped = told.join(own, "label").select("id", "old", F.least("label", "above").alias("label"))
        labels, seen = materialize_with(jumped, "labels", changed=F.sum((F.col("old") != F.col("label")).cast("long")))
        labels = labels.select("id", "label")
        if not seen["changed"]:
            return labels
