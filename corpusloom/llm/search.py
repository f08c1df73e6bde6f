"""Exact top-k search by inner product, with the three phases of the uniform-threshold method.

The score of a pair is the sum over a few *lists*, one for each block of dimensions. Phase 1 gathers, from
every part of the candidates, the leaders of each list with their whole scores; the k-th best of them is a
safe cutoff t for its query, since the k-th best score can't be lower. Phase 2 sends t to every part, which
collects the entries that reach t / lists in some list: where no list reaches that, the sum stays below t.
Phase 3 resolves what is left of their scores exactly and keeps those of at least t.

Queries and candidates meet as blocks on a grid: each task holds one block of queries and one part of the
candidates, both of bounded size, and sends at most k entries for each query.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most rows in a block of queries and in a part of the candidates, on average.
QUERY_BLOCK, CANDIDATE_PART = 4096, 32768
#: Blocks of dimensions.
LISTS = 2
#: Queries that are scored at once in a task.
STEP = 64
_NONE = -(2**63)


def quantized(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of each component, as long.

    Rows whose vector is null or holds a null or non-finite component go, and rows without an id. A component that
    doesn't fit into 64 bits fails the query.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = df.where(F.col(id_col).isNotNull() & x.isNotNull()).where(F.coalesce(finite, F.lit(False)))
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    # a larger one would become the largest long
    whole = lambda c: F.when(F.abs(scaled(c)) < F.lit(2.0**63), F.floor(scaled(c))).otherwise(F.raise_error(F.lit("a component doesn't fit into 64 bits; use a smaller scale")).cast("long"))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """The vectors as rows, filled with zeros up to ``width``."""
    column = column.combine_chunks()
    values = np.asarray(column.flatten())
    lengths = np.diff(np.asarray(column.offsets))
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _width(column) -> int:
    column = column.combine_chunks()
    return int(np.diff(np.asarray(column.offsets)).max(initial=0))


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether integer products of rows are exact in float64."""
    top = [int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) for x in (a, b)]
    return top[0] * top[1] * max(1, a.shape[1]) < 2**53


def _scores(a: np.ndarray, b: np.ndarray, blocks: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The products of rows by block, and whole ones.

    Large ones are worked out in Python's integers. Blocks only choose what is looked at, so theirs are then
    held to 64 bits; a whole score that doesn't fit is an error.
    """
    if not blocks:
        return [], np.zeros((len(a), len(b)), np.int64)
    if _exact(a, b):
        lists = [(a[:, x].astype(np.float64) @ b[:, x].astype(np.float64).T).astype(np.int64) for x in blocks]
        return lists, sum(lists[1:], lists[0])
    exact = [a[:, x].astype(object) @ b[:, x].astype(object).T for x in blocks]
    whole = sum(exact[1:], exact[0])
    if whole.size and max(abs(whole.max()), abs(whole.min())) >= 2**63:
        raise OverflowError("a score doesn't fit into 64 bits; use a smaller scale")
    return [np.clip(x, _NONE + 1, 2**63 - 1).astype(np.int64) for x in exact], whole.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The places in ``among`` of the k best scores, ties to the smaller id."""
    if len(among) > k:
        own = scores[among]
        among = among[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return among[np.lexsort((ids[among], -scores[among]))][:k]


def _phase(k: int, first: bool):
    def run(left, right):
        import pyarrow as pa

        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            width = max(_width(left["v"]), _width(right["v"]))
            ours, theirs = _matrix(left["v"], width), _matrix(right["v"], width)
            query, ids = np.asarray(left["query_id"]), np.asarray(right["vec_id"])
            cutoff = np.full(len(query), _NONE) if first else np.asarray(left["cutoff"])
            blocks = [x for x in np.array_split(np.arange(width), LISTS) if len(x)]
            for at in range(0, len(query), STEP):
                lists, whole = _scores(ours[at : at + STEP], theirs, blocks)
                for i in range(len(whole)):
                    other = ids != query[at + i]
                    if first:
                        places = np.unique(np.concatenate([_best(x[i], ids, np.flatnonzero(other), k) for x in lists or [whole]]))
                    else:
                        # a list can reach its share of the cutoff only from here on; the float bound is loosened by one
                        share = cutoff[at + i] / max(len(lists), 1) - 1 - abs(cutoff[at + i]) * 2.0**-50 if cutoff[at + i] > _NONE else -np.inf
                        reach = np.logical_or.reduce([x[i] >= share for x in lists or [whole]])
                        places = np.flatnonzero(other & reach)
                        places = places[whole[i][places] >= cutoff[at + i]]
                    places = _best(whole[i], ids, places, k)
                    out.append((np.full(len(places), query[at + i]), ids[places], whole[i][places]))
        columns = [np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64) for j in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of ``vectors`` with the highest inner product for each row of ``queries``.

    Both have ``vec_id`` (long) and ``v`` (array of long), as ``quantized`` makes them; other columns are
    ignored. Returns query_id, rank (from 1), vec_id, score. Ties go to the smaller vec_id. Rows of vectors
    that carry the query's own id are no candidates; where a query's id repeats, its greatest vector asks;
    repeated candidates count each. A shorter vector counts as filled with zeros. With fewer than k
    candidates a query gets all; without any, or for empty tables, no rows. A score that doesn't fit into 64
    bits fails the query.
    """
    spark = vectors.sparkSession
    n, asked = vectors.count(), queries.count()
    parts = max(math.ceil(n / CANDIDATE_PART), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 512)), 1)
    blocks = max(math.ceil(asked / QUERY_BLOCK), 1)
    part = F.sequence(F.lit(0), F.lit(parts - 1))
    block = F.sequence(F.lit(0), F.lit(blocks - 1))
    asking = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.max("v").alias("v"))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    theirs = vectors.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int").alias("part"), F.explode(block).alias("block"))
    theirs = theirs.groupBy("block", "part")
    schema = "query_id long, vec_id long, score long"

    def meet(left: DataFrame, first: bool) -> DataFrame:
        left = left.withColumn("part", F.explode(part)).groupBy("block", "part")
        return left.cogroup(theirs).applyInArrow(_phase(k, first), schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    leaders = meet(asking, True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    cutoffs = leaders.where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    told = asking.join(cutoffs, "query_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(_NONE)))
    found = meet(told, False).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """For each row whose vec_id is divisible by 100, its ten best other rows."""
    from .common import read

    vectors = quantized(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM pairs
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 10
"""

QUERIES = {"op10_exact_top_k": op10_exact_top_k}
ORACLE_SQL = {"op10_exact_top_k": _SQL}
