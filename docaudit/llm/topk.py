"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are bucketed by length; buckets are cut into blocks of bounded size. A first look at the
longest vectors gives each query a score that its k-th best can't fall below. A bucket whose
longest vector can't reach it is skipped. For the others that score becomes a local cosine
threshold, which chooses the pruning: by single coordinates where it is high, by length where it is
low. The products of what remains are verified exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import stored

BUCKETS = 32
SEEDS = 1024  # longest vectors that give the first thresholds
COSINE = 0.7  # local threshold from which coordinates prune
FOCUS = 3  # coordinates looked at
QUERIES_A_GROUP = 16_384
EXACT = 2.0**52  # products below this are exact as doubles
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
SLACK = 1e-9  # rounding of norms and bounds


def quantised(column: Column) -> Column:
    """floor(256 x) of each component as a double, which holds it exactly; null where the vector or any component is null or not finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * 256
        return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("double")).otherwise(scaled)  # beyond, doubles are integers

    return F.when(finite, F.transform(column, whole))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vec, dim and norm of the vectors that take part, one for each id (the largest, where an id is repeated)."""
    rows = df.select(F.col(key).alias("id"), quantised(F.col(vector)).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    single = rows.groupBy("id").agg(F.max("vec").alias("vec"))
    # by the largest component, so that no square overflows
    largest = F.array_max(F.transform("vec", F.abs))
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / F.col("largest")) * (x / F.col("largest")))
    norm = F.when(F.col("largest") > 0, F.least(F.col("largest") * F.sqrt(square), F.lit(1e308))).otherwise(0.0)
    return single.withColumn("largest", largest).select("id", "vec", F.size("vec").alias("dim"), norm.alias("norm"))


def _matrix(vectors: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(rows, len(values) // max(1, rows))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as longs or, where any may not fit, as Python's integers."""
    most = float(np.abs(left).max(initial=0)) * left.shape[1]
    with np.errstate(over="ignore"):
        wide = np.flatnonzero(most * np.abs(right).max(axis=1, initial=0) >= EXACT)
    if not len(wide):
        return np.rint(left @ right.T).astype("i8")
    out = np.zeros((len(left), len(right)), object)
    narrow = np.setdiff1d(np.arange(len(right)), wide)
    out[:, narrow] = np.rint(left @ right[narrow].T).astype("i8").astype(object)
    whole = np.vectorize(int, otypes=[object])
    out[:, wide] = whole(left) @ whole(right[wide]).T if left.size else 0
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda n: (-scores[n], ids[n]))[:k], "i8")
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def below(score: int) -> float:
    """A double at most as large as an integer."""
    if abs(score) < EXACT:
        return float(score)
    if abs(score) > 10**308:
        return 1e308 if score > 0 else -np.inf
    near = float(int(score))
    return near - abs(near) * SLACK


def search_block(ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_norms: np.ndarray, floors: np.ndarray, k: int) -> list[tuple]:
    """(query, id, score) of the k best of a block for each query, but none below the query's floor."""
    order = np.lexsort((ids, -norms))
    ids, vectors, norms = ids[order], vectors[order], norms[order]
    out = []

    def keep(query: int, scores: np.ndarray, places: np.ndarray) -> None:
        fit = (scores >= floors[query]) & (ids[places] != query_ids[query])
        scores, places = scores[fit], places[fit]
        # the best of a block in full; a score that doesn't fit a long is only an error if it is returned
        out.extend((int(query_ids[query]), int(ids[places[n]]), min(MOST_LONG, max(LEAST_LONG, int(scores[n])))) for n in _best(scores, ids[places], k))

    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        # the least cosine with which the longest vector of the block still reaches the floor
        local = np.where((query_norms > 0) & (norms[0] > 0), floors / (query_norms * norms[0]), np.where(floors > 0, np.inf, -np.inf))
    alive = np.flatnonzero(local <= 1 + SLACK)
    by_length, by_coordinate = alive[local[alive] < COSINE], alive[local[alive] >= COSINE]
    unit = None
    for query in by_coordinate:
        if unit is None:
            unit = vectors / np.maximum(norms, 1e-300)[:, None]
        direction = queries[query] / query_norms[query]
        least = min(1.0, max(0.0, float(local[query]) - SLACK))
        mask = np.ones(len(ids), bool)
        for at in np.argsort(-np.abs(direction), kind="stable")[:FOCUS]:
            reach = np.sqrt(max(0.0, 1 - least**2) * max(0.0, 1 - direction[at] ** 2)) + 1e-7
            # a cosine of `least` or more bounds each coordinate from both sides
            if direction[at] >= 0:
                mask &= unit[:, at] >= direction[at] * least - reach
                if direction[at] < least:
                    mask &= unit[:, at] <= direction[at] * least + reach
            else:
                mask &= unit[:, at] <= direction[at] * least + reach
                if -direction[at] < least:
                    mask &= unit[:, at] >= direction[at] * least - reach
        places = np.flatnonzero(mask)
        if len(places):
            keep(query, products(queries[query : query + 1], vectors[places])[0], places)
    with np.errstate(divide="ignore", invalid="ignore"):
        shortest = np.where(query_norms > 0, floors / query_norms, np.where(floors > 0, np.inf, -np.inf)) * (1 - SLACK)
    long_enough = np.searchsorted(-norms, -shortest, side="right")
    for start in range(0, len(by_length), 256):
        some = by_length[start : start + 256]
        most = int(long_enough[some].max(initial=0))
        if most:
            scores = products(queries[some], vectors[:most])
            for n, query in enumerate(some):
                reach = int(long_enough[query])
                keep(query, scores[n, :reach], np.arange(reach))
    return out


def top_products(df: DataFrame, is_query: Callable[[Column], Column], key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank (from 1), the found key and its score: the k largest inner products of each query.

    Vectors count as floor(256 x). `is_query` tells from a key whether it is a query; every vector
    but a query's own is a candidate, and fewer than k give fewer rows. Ties go to the smaller key.
    Null keys take no part, nor do vectors that are null or hold a null or non-finite component. All
    finite ones do; products are exact at any size, and the query fails if a score that it returns
    doesn't fit a long. A repeated key
    counts once, with its largest vector; vectors only meet others of as many components. Extra
    columns play no part; an empty table gives no rows. Queries meet blocks of vectors: both sides
    of a group are bounded, and blocks that can't matter for a query never see it.
    """
    vectors = stored(usable(df, key, vector), "vectors")
    spark = df.sparkSession
    count = vectors.count()
    cuts = vectors.agg(F.percentile_approx("norm", [n / BUCKETS for n in range(1, BUCKETS)], 10_000)).first()[0] or []
    edges = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    bucketed = vectors.withColumn("bucket", F.size(F.filter(edges, lambda e: e < F.col("norm"))))
    block_rows = min(16_384, max(512, count // 1024))
    sizes = bucketed.groupBy("dim", "bucket").agg(F.max("norm").alias("longest"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    sizes = stored(sizes, "buckets", count)

    top = vectors.orderBy(F.desc("norm"), "id").limit(SEEDS).toArrow()
    by_dim: dict[int, tuple] = {}
    for dim in set(top["dim"].to_pylist()):
        part = top.filter(pc.equal(top["dim"], dim))
        by_dim[dim] = (part["id"].to_numpy(), _matrix(part["vec"], part.num_rows))
    seeds = spark.sparkContext.broadcast(by_dim)

    @F.arrow_udf("double")
    def floor_of(ids: pa.Array, vecs: pa.Array, dims: pa.Array) -> pa.Array:
        own, size = ids.to_numpy(), dims.to_numpy()
        out = np.full(len(own), -np.inf)
        values, ends = vecs.flatten().to_numpy(), np.cumsum(size)
        for dim, (seed_ids, seed) in seeds.value.items():
            for n in np.flatnonzero(size == dim):
                scores = products(values[ends[n] - dim : ends[n]].reshape(1, -1), seed)[0][seed_ids != own[n]]
                if len(scores) >= k:
                    least = sorted(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]
                    out[n] = below(least)
        return pa.array(out)

    queries = vectors.where(is_query(F.col("id"))).withColumn("floor", floor_of("id", "vec", "dim"))
    queries = stored(queries, "queries")
    groups = max(1, -(-queries.count() // QUERIES_A_GROUP))
    chunk = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    reach = F.col("norm") * F.col("longest") * (1 + SLACK) >= F.col("floor")
    asked = queries.join(sizes, "dim").where(reach).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select("dim", "bucket", "block", chunk.alias("chunk"), "id", "vec", "norm", "floor")
    dealt = bucketed.join(sizes.drop("longest"), ["dim", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("dim", "bucket", "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("chunk"), "id", "vec", "norm")

    def search(block: pa.Table, asking: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if block.num_rows and asking.num_rows:
            found = search_block(block["id"].to_numpy(), _matrix(block["vec"], block.num_rows), block["norm"].to_numpy(), asking["id"].to_numpy(), _matrix(asking["vec"], asking.num_rows), asking["norm"].to_numpy(), asking["floor"].to_numpy(), k)
        columns = list(zip(*found)) if found else ([], [], [])
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "score"), columns)})

    where = ["dim", "bucket", "block", "chunk"]
    met = dealt.groupBy(*where).cogroup(asked.groupBy(*where)).applyInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= k)
    beyond = F.col("score").isin(LEAST_LONG, MOST_LONG)
    score = F.when(beyond, F.raise_error(F.lit("a score doesn't fit a long")).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", "rank", F.col("id").alias(key), score.alias("score"))
