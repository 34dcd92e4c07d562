"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataframe.runtime import Scratch, join_by_key

#: Links of a round up to which a single task may hold them all, so a step is one plan; beyond it the links of a hub are dealt.
TASK_LINKS = 65_536
#: Tasks that contract the links of such a round, each its own share, before the round's shuffles.
SHARES = 8


def _stars(links: DataFrame) -> DataFrame:
    """Links that join the same nodes: in every task, each node with the smallest that the task's links reach from it.

    A task takes its links in blocks of ``TASK_LINKS``, so it holds no more at once.  Nodes that are no numbers stay as
    they are.
    """
    if {kind for _, kind in links.dtypes} - {"int", "bigint"}:
        return links

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([batch.column(c).to_numpy() for c in (0, 1) for batch in held])
        ids, at = np.unique(ends, return_inverse=True)
        u, v = at.reshape(2, -1)
        label, before = np.arange(len(ids)), None
        while before is None or (label != before).any():
            before, low = label.copy(), np.minimum(label[u], label[v])
            for node in (u, v, before[u], before[v]):
                np.minimum.at(label, node, low)
            label = label[label]
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TASK_LINKS:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return links.mapInArrow(run, links.schema)


def _higher(links: DataFrame) -> DataFrame:
    """Links as ``u > v``, contracted where they lie, each once; self loops and null ends go."""
    return _stars(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")).distinct()


def _lowest(links: DataFrame) -> DataFrame:
    """``(u, m, n)``: the smallest of a node's smaller neighbours and how many links it has to such."""
    return links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _large_star(scratch: Scratch, links: DataFrame, spread: bool) -> DataFrame:
    """Larger neighbours of every node meet the smallest of its neighbours and itself.

    A link ``u > v`` is met at ``v``; the smallest is a smaller neighbour, or ``v`` itself where it has none.
    """
    low = _lowest(links).select(F.col("u").alias("v"), "m")
    if not spread:
        return links.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
    met = links.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(low, "v", "left")
    keys = scratch.cut(met.select("v", "n", F.coalesce("m", "v").alias("m")))
    return scratch.cut(join_by_key(links, keys, "v", "n", "u").select("u", F.col("m").alias("v")).distinct())


def _small_star(scratch: Scratch, links: DataFrame, spread: bool) -> DataFrame:
    """Smaller neighbours of every node, and the node, meet the smallest of them."""
    low = _lowest(links)
    if spread:
        low = scratch.cut(low)
        met = join_by_key(links, low, "u", "n", "v")
    else:
        met = links.join(low, "u")
    ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return met.select(F.inline(ends)).where("u > v").distinct()


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60, task_links: int | None = None) -> DataFrame:
    """``(node, component)`` for every node that has an edge; the label is the smallest node reached.

    Self loops, repeated edges and null ends are ignored.  Each round is a table in the shared folder, so a lost
    executor costs one round at most; a round's tables are dropped when the next one is written.  A round of more than
    ``task_links`` links stores the links of each node as a number, and those of a hub go to several tasks; the
    labels are the same either way.  Smaller rounds are contracted in ``SHARES`` tasks first, so few rounds are needed.
    """
    scratch = Scratch(edges.sparkSession, "components")
    limit = TASK_LINKS if task_links is None else task_links
    print_of = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    now, seen = scratch.cut_told(_higher(edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))), **print_of)
    for _ in range(max_rounds):
        if seen["n"] == 0:
            break
        spread = seen["n"] > limit
        if not spread:
            now = scratch.cut(_stars(now.coalesce(SHARES)))
        last, (now, seen) = seen, scratch.cut_told(_small_star(scratch, _large_star(scratch, now, spread), spread), **print_of)
        scratch.keep_only(now)
        if last == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
