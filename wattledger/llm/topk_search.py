"""Exact top-k inner products by pivot-table elimination.

Inner products become Euclidean distances by one more component: a candidate x is
continued with sqrt(M - |x|^2), a query with 0, M being the largest squared norm, so that
|q - x|^2 = |q|^2 + M - 2 <q, x>.  Distances of every row to the pivots are computed once;
by the triangle inequality max_p |d(q, p) - d(x, p)| bounds d(q, x) from below.

Rows lie in blocks by their nearest pivot, and a block knows its least and largest distance
to each pivot.  A query meets its own row's block first; its k-th score there says which of
the other blocks it has to visit.  Inside a block the same bound rules out slices of rows;
those left are multiplied with the queries that reach them.

The queries are a stated set.  A task holds one block and at most a bounded part of the
queries, and only rows that reach a query's k-th score go on to the merge.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wattledger.session import materialize

K = 5
QUERY_STEP = 50
SCALE = 256
#: rows of a block, and queries that meet it in one group
ROWS, QUERIES = 16384, 65536
#: pivots, farthest first from a bounded sample
PIVOTS, PIVOT_SAMPLE = 12, 2048
#: rows of a slice, and queries that are multiplied with it at a time
TILE = 1024
#: k-th score of a query that has met fewer than k rows
NONE = -float(np.finfo(np.float32).max)

_FOUND = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame) -> DataFrame:
    """vec_id, v (array of long): floor(256 x); rows that are null, empty or not finite are left out."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _matrix(values, dims: int) -> np.ndarray:
    out = np.zeros((len(values), dims))
    for row, v in zip(out, values):
        row[: len(v)] = v
    return out


def _continued(x: np.ndarray, largest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(largest - (x * x).sum(1), 0.0))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first points of the sample."""
    chosen = [0] if len(sample) else []
    near = np.full(len(sample), np.inf)
    while chosen and len(chosen) < min(n, len(sample)):
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(near.argmax()))
    return sample[chosen]


def _numbers(lists) -> np.ndarray:
    """The lists of one column, all of the same length, as rows of a matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def _measure(largest: float, pivots: np.ndarray, queries: bool):
    """Appends the distances to the pivots and the number of the nearest."""

    def measure(batches):
        for batch in batches:
            x = _numbers(batch.column("v")).astype(float)
            full = np.hstack([x, np.zeros((len(x), 1))]) if queries else _continued(x, largest)
            d = _distances(full, pivots)
            new = {"pivot": _lists(d), "cell": pa.array(d.argmin(1).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], names=[*batch.schema.names, *new])

    return measure


def _slack(largest: float) -> float:
    return 1e-6 * (1.0 + np.sqrt(max(largest, 1.0)))


def _reach(square, kth, largest: float):
    """Distance beyond which no row reaches the k-th score, not even a tie."""
    return np.sqrt(np.maximum(square + largest - 2 * kth, 0.0)) + _slack(largest)


def _bounds(d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance of each query to the rows whose distances to the pivots lie between low and high."""
    out = np.zeros((len(d), len(low)))
    for p in range(d.shape[1]):
        np.maximum(out, np.maximum(low[None, :, p] - d[:, p, None], d[:, p, None] - high[None, :, p]), out=out)
    return out


def _aim(largest: float, low: np.ndarray, high: np.ndarray):
    """Replaces ``block``, where the query has been, by the others that it has to visit."""

    def aim(batches):
        for batch in batches:
            x = _numbers(batch.column("v")).astype(float)
            open_ = _bounds(_numbers(batch.column("pivot")), low, high) <= _reach((x * x).sum(1), batch.column("kth").to_numpy(), largest)[:, None]
            open_[np.arange(len(x)), batch.column("block").to_numpy()] = False
            ends = np.concatenate([[0], np.cumsum(open_.sum(1))]).astype(np.int32)
            blocks = pa.ListArray.from_arrays(ends, pa.array(np.nonzero(open_)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_id", "v", "pivot", "kth")), blocks], names=["query_id", "v", "pivot", "kth", "blocks"])

    return aim


def _first_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without those copies of a vector that more than k smaller ids keep out of every result."""
    same = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    g, i = same[order], ids[order]
    at = np.arange(len(g))

    def place(new):
        return at - np.maximum.accumulate(np.where(new, at, 0))

    group = np.concatenate([[True], g[1:] != g[:-1]])
    # a query leaves out its own id, which repeats as often as the longest run at most
    longest = place(group | np.concatenate([[True], i[1:] != i[:-1]])).max() + 1
    return order[place(group) < k + longest]


def _best(rows, ids, scores, k: int):
    """The k best per row, ties to the smaller id, and the places of the k-th."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    at = np.arange(len(rows)) - np.searchsorted(rows, rows)
    keep = at < k
    return rows[keep], ids[keep], scores[keep], np.flatnonzero(at[keep] == k - 1)


def best_of_block(q_ids, q, q_pivot, kth, ids, x, x_pivot, largest: float, k: int):
    """The k best rows of one block for every query, of those that reach its ``kth``: (query_id, vec_id, score) arrays."""
    # sums of whole numbers that stay below the squared norm are exact
    number = np.float32 if largest < 2**24 else np.float64
    first = _first_copies(ids, x, k)
    order = first[np.argsort(x_pivot[first, x_pivot.mean(0).argmin()], kind="stable")]
    ids, x, x_pivot = ids[order], x[order].astype(number), x_pivot[order]
    starts = np.arange(0, len(ids), TILE)
    low, high = np.minimum.reduceat(x_pivot, starts), np.maximum.reduceat(x_pivot, starts)
    found = []
    for a in range(0, len(q_ids), TILE):
        own, tile, bar = q_ids[a : a + TILE], q[a : a + TILE].astype(number), kth[a : a + TILE].copy()
        square = (tile.astype(float) ** 2).sum(1)
        bound = _bounds(q_pivot[a : a + TILE], low, high)
        by_id = np.argsort(own)
        near = by_id[np.minimum(np.searchsorted(own, ids, sorter=by_id), len(own) - 1)]
        own_x = np.flatnonzero(own[near] == ids)
        rows, top_ids, top = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for s in np.argsort(bound.min(0), kind="stable"):
            at, to = starts[s], min(starts[s] + TILE, len(ids))
            asking = np.flatnonzero(bound[:, s] <= _reach(square, bar, largest))
            if not len(asking):
                continue
            score = tile[asking] @ x[at:to].T
            place = np.full(len(own), -1)
            place[asking] = np.arange(len(asking))
            mine = own_x[(own_x >= at) & (own_x < to)]
            mine = mine[place[near[mine]] >= 0]
            score[place[near[mine]], mine - at] = -np.inf
            hits = score >= bar[asking].astype(number)[:, None]
            if to - at > k and np.count_nonzero(hits) > 4 * k * len(asking):
                bar[asking] = np.maximum(bar[asking], np.partition(score, -k, axis=1)[:, -k])
                hits = score >= bar[asking].astype(number)[:, None]
            r, c = np.nonzero(hits)
            rows, top_ids, top, full = _best(np.concatenate([rows, asking[r]]), np.concatenate([top_ids, ids[at + c]]), np.concatenate([top, score[r, c]]), k)
            bar[rows[full]] = np.maximum(bar[rows[full]], top[full])
        found.append((own[rows], top_ids, top.astype(np.int64)))
    return [np.concatenate(part) for part in zip(*found)]


def _meet(largest: float, k: int):
    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = [np.empty(0, np.int64)] * 3
        if len(asked) and len(rows):
            found = best_of_block(
                asked.column("query_id").to_numpy(), _numbers(asked.column("v")), _numbers(asked.column("pivot")), asked.column("kth").to_numpy(),
                rows.column("vec_id").to_numpy(), _numbers(rows.column("v")), _numbers(rows.column("pivot")), largest, k,
            )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    return meet


def top_k(table: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query, the query's own row left out.

    Queries are rows whose vec_id is divisible by ``step``.  Vectors that are null, empty,
    or hold null or non-finite components take no part, nor do rows without vec_id; a
    shorter vector counts as continued with zeros.  Ties go to the smaller vec_id.  Rows
    that repeat a vec_id are candidates of their own, and one query.  Scores are exact
    while they are below 2^53.  An empty table gives an empty result; other columns are
    not read.
    """
    spark = table.sparkSession
    vectors = materialize(integer_vectors(table), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.max(square).alias("largest")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims, largest = facts["dims"], facts["largest"]
    # the pivots alone come from a bounded sample: they change the speed, not the result
    sample = _matrix([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id")).limit(PIVOT_SAMPLE).collect()], dims)
    pivots = choose_pivots(_continued(sample, largest), PIVOTS)
    rows, low, high = _blocks(vectors, dims, largest, pivots)
    asked = _asked(rows, step, largest, pivots)
    parts = -(-max(asked.count(), 1) // QUERIES)

    def met(q: DataFrame, n: int) -> DataFrame:
        part = F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")
        x = rows.select("block", "vec_id", "v", "pivot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
        return q.withColumn("part", part).groupBy("block", "part").cogroup(x.groupBy("block", "part")).applyInArrow(_meet(largest, k), _FOUND)

    at_home = materialize(met(asked.withColumn("kth", F.lit(NONE)), 1), "found")
    away = met(aimed(asked, at_home, low, high, largest, k), parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc()))
    return at_home.unionByName(away).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(vectors: DataFrame, dims: int, largest: float, pivots: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows with their block, and the blocks' least and largest distances to the pivots."""
    kind = "smallint" if largest < 2**30 else "bigint"
    whole = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v"))).cast(f"array<{kind}>")
    # salt: rows of a cell are dealt by a hash of the whole row, so that repeats of one vec_id spread as well as any rows
    salted = vectors.select("vec_id", whole.alias("v"), F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("salt"))
    placed = materialize(salted.mapInArrow(_measure(largest, pivots, False), f"vec_id long, v array<{kind}>, salt long, pivot array<double>, cell int"), "placed")
    first, base, parts = 0, [0] * len(pivots), [1] * len(pivots)
    for r in placed.groupBy("cell").count().orderBy("cell").collect():
        base[r["cell"]], parts[r["cell"]] = first, -(-r["count"] // ROWS)
        first += parts[r["cell"]]
    cell = F.col("cell") + 1
    block = F.element_at(F.lit(base), cell) + F.pmod("salt", F.element_at(F.lit(parts), cell))
    rows = placed.withColumn("block", block.cast("int"))
    ends = [f(F.get("pivot", F.lit(p))).alias(f"{f.__name__}{p}") for f in (F.min, F.max) for p in range(len(pivots))]
    # two numbers per pivot for every ROWS rows; a block that got no row is nobody's goal
    low, high = np.full((first, len(pivots)), np.inf), np.full((first, len(pivots)), -np.inf)
    for r in rows.groupBy("block").agg(*ends).collect():
        low[r["block"]], high[r["block"]] = r[1 : 1 + len(pivots)], r[1 + len(pivots) :]
    return rows, low, high


def _asked(rows: DataFrame, step: int, largest: float, pivots: np.ndarray) -> DataFrame:
    """query_id, v, pivot and block, the one that the query's own row lies in."""
    own = rows.where(F.col("vec_id") % step == 0).dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "v", "block")
    kind = rows.schema["v"].dataType.simpleString()
    return materialize(own.mapInArrow(_measure(largest, pivots, True), f"query_id long, v {kind}, block int, pivot array<double>, cell int").drop("cell"), "asked")


def aimed(asked: DataFrame, found: DataFrame, low: np.ndarray, high: np.ndarray, largest: float, k: int) -> DataFrame:
    """Every query beside the blocks that may hold a row of at least its k-th score so far."""
    kth = found.groupBy("query_id").agg(F.min("score").cast("double").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).drop("n")
    known = asked.join(kth, "query_id", "left").select("query_id", "v", "pivot", "block", F.coalesce("kth", F.lit(NONE)).alias("kth"))
    kind = asked.schema["v"].dataType.simpleString()
    goals = known.mapInArrow(_aim(largest, low, high), f"query_id long, v {kind}, pivot array<double>, kth double, blocks array<int>")
    return goals.select("query_id", "v", "pivot", "kth", F.explode("blocks").alias("block"))
