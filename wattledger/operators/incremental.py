"""Skip feeders whose inputs did not change.

A table's content is known by a multiset sum: every row, in a fixed text form, gives the
first half of its md5 as a number, and the numbers are added modulo 2^64.  Sums of parts
add up to the sum of the whole in any order, so rows that arrive only add their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattledger.session import materialize

#: between the values of a row, and in place of a null
SEPARATOR, NULL = "\x1f", "\\N"
#: sums are kept modulo this
MODULUS = 1 << 64


def text_of(name: str, kind: T.DataType) -> Column:
    """A value as text that does not depend on the engine: floating point with six decimals, instants in UTC to the second."""
    c = F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.format_string("%.6f", c)
    elif isinstance(kind, T.TimestampType):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(F.when(c.isNotNull(), text), F.lit(NULL))


def row_number(df: DataFrame) -> Column:
    """A row's number below 2^64: the first 16 hexadecimal digits of the md5 of its values in order of their names."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    digest = F.md5(F.concat_ws(SEPARATOR, *[text_of(f.name, f.dataType) for f in fields]).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def _added(numbers: Column) -> Column:
    return (F.sum(numbers.cast("decimal(38,0)")) % F.lit(str(MODULUS)).cast("decimal(38,0)")).cast("decimal(20,0)")


def content_sums(df: DataFrame, name: str) -> DataFrame:
    """(feeder_id, t, h, n): sum and number of a table's rows per feeder, by one partial aggregate."""
    return df.groupBy("feeder_id").agg(F.lit(name).alias("t"), _added(row_number(df)).alias("h"), F.count(F.lit(1)).alias("n"))


def add_sums(sums: DataFrame) -> DataFrame:
    """Sums of parts of tables (feeder_id, t, h, n) as sums of the tables."""
    return sums.groupBy("feeder_id", "t").agg(_added(F.col("h")).alias("h"), F.sum("n").alias("n"))


def hash_of_sums(sums: DataFrame, extra: str = "") -> DataFrame:
    """(feeder_id, input_hash) from the sums of all its tables; a table without rows is as if it were absent."""
    # one row per feeder and table: the list is bounded by the number of tables
    text = F.array_sort(F.collect_list(F.concat_ws(":", "t", F.col("h").cast("string"), F.col("n").cast("string"))))
    return add_sums(sums).groupBy("feeder_id").agg(text.alias("p")).select(
        "feeder_id", F.substring(F.sha2(F.concat_ws("|", F.concat_ws("|", "p"), F.lit(extra)), 256), 1, 16).alias("input_hash")
    )


def input_hash(tables: dict[str, DataFrame], extra: str = "") -> DataFrame:
    """Order-independent content hash per feeder over all input tables."""
    return hash_of_sums(reduce(DataFrame.unionByName, [content_sums(df, n) for n, df in tables.items()]), extra)


def needs_recompute(hashes: DataFrame, done: DataFrame) -> DataFrame:
    """Feeders without a finished run on the same inputs."""
    return hashes.join(done, ["feeder_id", "input_hash"], "left_anti")


def mark_done(done: DataFrame, finished: DataFrame) -> DataFrame:
    """New state table: one row per feeder, the finished hashes replacing older ones."""
    kept = done.join(finished.select("feeder_id"), "feeder_id", "left_anti")
    return materialize(kept.unionByName(finished.select(*done.columns)), "state")
