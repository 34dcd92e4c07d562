"""Exact top-k by inner product: blocks of queries against blocks of candidates, term at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strataframe.llm.common import in_small_batches, table

#: Rows of one candidate block and of one query block, on average; they bound a task's score arrays.
CANDIDATES, QUERIES_A_BLOCK = 4096, 256


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """One row per block: ids and, for each term, the positions and weights of its postings."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["id"].to_numpy(np.int64)
        lengths = np.array([len(v) for v in frame["terms"]], np.int64)
        flat = np.concatenate([np.asarray(v, np.int64) for v in frame["terms"]]) if lengths.sum() else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(ids)), lengths)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        keep = flat != 0
        row, term, flat = row[keep], term[keep], flat[keep]
        order = np.lexsort((row, term))
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "ids": [ids.tobytes()], "rows": [row[order].astype(np.int32).tobytes()], "terms": [term[order].astype(np.int32).tobytes()], "weights": [flat[order].tobytes()]})

    return rows.withColumnRenamed(block, "block").groupBy("block").applyInPandas(pack, "block long, ids binary, rows binary, terms binary, weights binary")


def _postings(rows: bytes, terms: bytes, weights: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    r, t, w = np.frombuffer(rows, np.int32), np.frombuffer(terms, np.int32), np.frombuffer(weights, np.int64)
    cuts = np.flatnonzero(np.diff(t)) + 1
    starts = np.concatenate(([0], cuts)).astype(int) if len(t) else np.empty(0, int)
    ends = np.concatenate((cuts, [len(t)])).astype(int) if len(t) else starts
    return {int(t[a]): (r[a:b], w[a:b]) for a, b in zip(starts, ends, strict=True)}


def _scores(q: dict, c: dict, n_queries: int, n_candidates: int) -> np.ndarray:
    """Each weight of a query row is scattered, times the postings of its term, into the row's dense scores."""
    scores = np.zeros((n_queries, n_candidates), np.int64)
    for term in sorted(q.keys() & c.keys()):
        (rows, weights), (at, posted) = q[term], c[term]
        whole = len(at) == n_candidates  # every candidate has the term, in order: no scatter index is needed
        for i, w in zip(rows, weights, strict=True):
            if whole:
                scores[i] += w * posted
            else:
                scores[i, at] += w * posted
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id: a partition first, then a sort of what reaches its bound."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= bound)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best candidates of every query by integer inner product, exactly.

    Both sides are ``(id long, terms array<long>)``; position i of ``terms`` is the weight of term i and
    zero weights have no posting, so vectors of unequal length meet on the terms that they share.  Each
    side is packed into blocks of bounded size; every query block visits every candidate block (the
    queries are a stated set), keeps ``k`` a query there, and the partial lists are merged by a window.
    A candidate block moves once and is held by its task while the query blocks stream past it.
    The query's own id never answers it.  Ties go to the smaller id.  Rows with a null id or null terms
    take no part; empty vectors score 0; repeated candidate rows each take a place; of repeated query
    ids the smallest vector asks.  Empty tables give no rows, other columns do not matter.  Products are
    64-bit integers.  A block holds whole vectors, so very long ones make larger blocks.

    Equal candidate rows are counted first and no more than ``k`` of them go on, as no answer has room
    for more; so blocks follow from ids and vectors alone, and no value fills one, however often it repeats.
    """
    usable = "id IS NOT NULL AND terms IS NOT NULL"
    queries = queries.where(usable).groupBy("id").agg(F.min("terms").alias("terms"))
    candidates = candidates.where(usable).groupBy("id", "terms").agg(F.count(F.lit(1)).alias("c"))
    candidates = candidates.select("id", "terms", F.explode(F.sequence(F.lit(1).cast("long"), F.least("c", F.lit(k)))).alias("copy"))
    n, m = candidates.count(), queries.count()
    n_blocks, m_blocks = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES_A_BLOCK))
    place = lambda blocks: F.pmod(F.xxhash64("id", F.lit(11)), F.lit(blocks)).alias("b")
    spread = candidates.withColumn("b", F.pmod(F.xxhash64("id", "terms", "copy"), F.lit(n_blocks)))
    blocks = _packed(spread.select("id", "terms", "b"), "b").withColumn("asks", F.lit(0))
    asked = _packed(queries.select("id", "terms", place(m_blocks)), "b").withColumn("asks", F.lit(1))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    met = blocks.unionByName(asked).repartition(max(1, min(n_blocks, 4096)), "block").sortWithinPartitions("block", "asks")
    met = met.select("block", "asks", "ids", "rows", "terms", "weights")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, postings = None, np.empty(0, np.int64), {}
        for batch in batches:
            found = [np.empty((0, 3), np.int64)]
            for at in range(batch.num_rows):
                block, asks, named, *packed = (column[at].as_py() for column in batch.columns)
                if not asks:
                    held, ids, postings = block, np.frombuffer(named, np.int64), _postings(*packed)
                elif block == held:
                    q_ids = np.frombuffer(named, np.int64)
                    scores = _scores(_postings(*packed), postings, len(q_ids), len(ids))
                    for i, qid in enumerate(q_ids):
                        others = np.flatnonzero(ids != qid)
                        best = others[_best(scores[i, others], ids[others], k)]
                        found.append(np.column_stack((np.full(len(best), qid), ids[best], scores[i, best])))
            rows = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["query_id", "vec_id", "score"])

    found = in_small_batches(met).mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def weights_of(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``floor(scale * x)`` of every component; rows with a null or non-finite component become null."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    terms = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return vectors.select(F.col("vec_id").alias("id"), F.when(~bad, terms).alias("terms"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weights_of(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return exact_top_k(rows.where("id % 100 = 0"), rows).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(coalesce(list_sum(list_transform(list_zip(q.t, c.t, true), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""

QUERIES = {"op2_exact_top_k": op2_exact_top_k}
SQL = {"op2_exact_top_k": OP2_SQL}
