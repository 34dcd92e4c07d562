"""Near duplicates by MinHash with tensored banding, verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataframe.llm.common import in_small_batches, table
from strataframe.operators.graph import connected_components
from strataframe.runtime import Scratch, join_by_key, sized_broadcast

#: Hashes in half a table key, and half keys in each of the two collections: HALVES ** 2 tables.
HALF, HALVES = 3, 14
#: Rows of cells are broadcast to the scan up to this many (28 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Classes in a block when the classes of one hub are compared with each other, and in a block of a large group.
BLOCK, MOST = 512, 4096
#: Sides of a cell: left ones are held, right ones are asked against them, others are compared among themselves.
LEFT, BOTH, RIGHT = 0, 1, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)
_STRIDE = 2048


class _Words(dict):
    """64-bit hashes of words, remembered by worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _Words()


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; A-Z are lower-cased.

    A text of fewer words than ``width`` is one shingle, a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n, w = len(words), min(width, len(words))
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    acc = np.full(n - w + 1, w, np.uint64)
    for j in range(w):
        acc = (acc ^ h[j : n - w + 1 + j]) * _MIX
        acc ^= acc >> _SHIFT
    return np.unique(acc)


def _hashes(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_077)
    odd = draw.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, draw.integers(0, 2**63, count, np.uint64)


def half_keys(shingles: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], half: int) -> np.ndarray:
    """Fold each run of ``half`` minhashes to one 64-bit half key, told apart by its place."""
    mul, add = hashes
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _STRIDE):
        low = np.minimum(low, (shingles[None, at : at + _STRIDE] * mul[:, None] + add[:, None]).min(axis=1))
    low = low.reshape(-1, half)
    acc = np.arange(1, len(low) + 1, dtype=np.uint64)
    for j in range(half):
        acc = (acc ^ low[:, j]) * _MIX
        acc ^= acc >> _SHIFT
    return acc.view(np.int64)


def signatures(
    docs: DataFrame, key: str, text: str, width: int, half: int = HALF, halves: int = HALVES
) -> DataFrame:
    """``(node, n, cls, a, b)`` per row: set size, a 128-bit name of the set, the two collections of half keys."""
    names = ["node", "n", "cls", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = _hashes(2 * half * halves)
        keys_type = pa.list_(pa.int64())
        for batch in batches:
            sizes, classes, left, right = [], [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py() or "", width)
                keys = half_keys(s, hashes, half) if len(s) else np.empty(0, np.int64)
                sizes.append(len(s))
                classes.append(xxhash.xxh128_digest(s.tobytes()))
                left.append(keys[:halves])
                right.append(keys[halves:])
            made = [pa.array(sizes, pa.int64()), pa.array(classes, pa.binary())]
            made += [pa.array(left, keys_type), pa.array(right, keys_type)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names)

    source = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("t"))
    return in_small_batches(source).mapInArrow(run, "node long, n long, cls binary, a array<long>, b array<long>")


def _tables(reps: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(t, node)``, the table keys that two classes or more share, and ``(t, c)``, the classes of each key.

    A table key pairs a first half key with a second one.  Half keys are counted on their own first, so the
    second collection is unfolded only where a table may form.
    """
    first = reps.select("node", F.explode("a").alias("ka"))
    shared = work.cut(first.groupBy("ka").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    halves = join_by_key(first, shared, "ka", "c", "node").select("node", "ka")
    paired = halves.join(reps.select("node", "b"), "node")
    rows = work.cut(paired.select("node", F.explode("b").alias("kb"), "ka").select("node", F.xxhash64("ka", "kb").alias("t")))
    sizes = work.cut(rows.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    return rows, sizes


def _homes(rows: DataFrame, sizes: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(t, node, c)`` of shared tables, and ``(node, home)``: for each class a hub that it shares a table with.

    The hub of a table is the class whose tables hold most classes; a class takes the best of its tables' hubs.
    """
    met = work.cut(join_by_key(rows, sizes, "t", "c", "node").select("t", "node", "c"))
    scores = met.groupBy("node").agg(F.sum("c").alias("score"))
    hub = F.max(F.struct("score", (-F.col("node")).alias("low")))
    heads = met.join(scores, "node").groupBy("t").agg(hub.alias("m"), F.count(F.lit(1)).alias("c"))
    heads = work.cut(heads.select("t", "c", F.col("m.score").alias("score"), F.col("m.low").alias("low")))
    placed = join_by_key(met.select("t", "node"), heads, "t", "c", "node")
    homes = placed.groupBy("node").agg(F.max(F.struct("score", "low")).alias("m"))
    return met, work.cut(homes.select("node", (-F.col("m.low")).alias("home")))


def _parts(size: Column) -> Column:
    """Blocks that the classes of one hub are dealt into: of ``BLOCK`` classes first, of ``MOST`` in large groups."""
    return F.ceil(F.when(size <= 8 * BLOCK, size / BLOCK).otherwise(F.greatest(F.lit(8.0), size / MOST))).cast("long")


def _star_cells(homes: DataFrame) -> DataFrame:
    """Cells ``(cell, side, node, comp)`` that compare each class with its hub; the hub goes to every block."""
    rows = homes.where("node <> home")
    parts = rows.groupBy("home").agg(F.count(F.lit(1)).alias("c")).select("home", F.ceil(F.col("c") / BLOCK).alias("parts"))
    cell = F.xxhash64("home", "part").alias("cell")
    node = F.col("node").alias("comp")
    dealt = rows.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    hubs = parts.select("home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    left = hubs.select(cell, F.lit(LEFT).alias("side"), F.col("home").alias("node"), F.col("home").alias("comp"))
    return left.unionByName(dealt.select(cell, F.lit(RIGHT).alias("side"), "node", node))


def _raised(homes: DataFrame) -> DataFrame:
    """``(node, home)`` with the home of each hub in the hub's place, where it has another one."""
    above = homes.select(F.col("node").alias("home"), F.col("home").alias("above"))
    above = sized_broadcast(above, above.count(), BROADCAST_IDS)
    return homes.join(above, "home", "left").select("node", F.coalesce("above", "home").alias("home"))


def _open_cells(met: DataFrame, homes: DataFrame, comps: DataFrame, work: Scratch) -> DataFrame:
    """Cells ``(cell, side, node, comp)`` that hold every pair of a table whose classes lie in different components.

    Classes of one hub are dealt into blocks, hubs that share a table with a better one counted to it, so a
    group of near copies makes few large blocks.  Blocks that meet in a table with two components or more are
    compared with each other: what is paired are blocks, never the classes of a table.
    """
    sizes = met.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    spans = sizes.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"))
    spans = work.cut(spans.where("lo < hi").select("t", "c"))
    rows = work.cut(join_by_key(sizes.select("t", "node", "comp"), spans, "t", "c", "node").select("t", "node", "comp"))
    homes = work.cut(_raised(work.cut(_raised(homes))))
    nodes = rows.select("node", "comp").distinct().join(homes, "node")
    parts = nodes.groupBy("home").agg(F.count(F.lit(1)).alias("c")).select("home", _parts(F.col("c")).alias("parts"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = work.cut(nodes.join(parts, "home").select("node", "comp", block.alias("block")))
    lows = rows.join(placed.select("node", "block"), "node").groupBy("t", "block")
    lows = work.cut(lows.agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")))
    other = lows.select("t", F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    apart = "block <= other AND (lo < hi OR lo2 < hi2 OR lo <> lo2)"
    pairs = lows.join(other, "t").where(apart).select("block", "other").distinct()
    pairs = work.cut(pairs.withColumn("cell", F.xxhash64("block", "other")))
    side = F.when(F.col("block") == F.col("other"), BOTH).otherwise(LEFT)
    left = pairs.select("cell", side.alias("side"), "block")
    right = pairs.where("block <> other").select("cell", F.lit(RIGHT).alias("side"), F.col("other").alias("block"))
    return left.unionByName(right).join(placed, "block").select("cell", "side", "node", "comp")


class _Cell:
    """The classes of one cell: left ones are kept as postings, right ones are asked against them."""

    def __init__(self, percent: int):
        self.percent, self.root = percent, {}
        self.comps, self.sets, self.index = [], [], None

    def _top(self, comp: int) -> int:
        while comp in self.root:
            comp = self.root[comp]
        return comp

    def keep(self, comp: int, own: np.ndarray) -> None:
        self.comps.append(comp)
        self.sets.append(own)

    def links(self, comp: int, own: np.ndarray) -> list[tuple[int, int]]:
        """Links of one more set to kept ones of other components; components that meet are one from then on."""
        if self.index is None:
            sizes = np.array([len(v) for v in self.sets])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            self.index = sizes, flat[order], owner[order], np.array([self._top(c) for c in self.comps], np.int64)
        sizes, terms, owner, comps = self.index
        comp = self._top(comp)
        others = comps != comp
        if not others.any():
            return []
        lo, hi = np.searchsorted(terms, own, "left"), np.searchsorted(terms, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sizes))
        hit = others & (100 * both >= self.percent * (len(own) + sizes - both))
        found = []
        for other in np.unique(comps[hit]).tolist():
            found.append((comp, other))
            self.root[other] = comp
            comps[comps == other] = comp
        return found

    def inner(self) -> list[tuple[int, int]]:
        """Links among the kept sets themselves."""
        return [link for comp, own in zip(self.comps, self.sets, strict=True) for link in self.links(comp, own)]


def _compared(cells: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int, work: Scratch) -> DataFrame:
    """``(x, y)``: components that a pair of a cell links, confirmed on full sets.

    Every text goes to each of its cells once.  Rows arrive sorted by cell, left ones first, so a task holds
    the sets of one block and streams the other.
    """
    cells = work.cut(cells)
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("t"))
    rows = texts.join(sized_broadcast(cells, cells.count(), BROADCAST_IDS), "node").select("cell", "side", "comp", "t")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, inner = None, _Cell(percent), False
        for batch in batches:
            links = []
            for c, side, comp, t in zip(*map(pa.Array.to_pylist, batch.columns[:3]), batch.column(3), strict=True):
                if c != now:
                    links += cell.inner() if inner else []
                    now, cell, inner = c, _Cell(percent), side == BOTH
                own = shingle_set(t.as_py() or "", width)
                if side == RIGHT and cell.sets:
                    links += cell.links(comp, own)
                else:
                    cell.keep(comp, own)
            yield _links(links)
        yield _links(cell.inner() if inner else [])

    return work.cut(in_small_batches(rows).mapInArrow(run, "x long, y long"))


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["x", "y"])


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    half: int = HALF,
    halves: int = HALVES,
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Documents are linked when the Jaccard similarity of their sets of ``width``-word shingles is at
    least ``percent`` / 100; components carry the smallest id that they reach.  The tables hold
    ``halves ** 2`` keys of ``2 * half`` minhashes each, made from ``2 * half * halves`` hashes by pairing
    half keys.  A pair of similarity s is missed with probability below ``2 * (1 - s**half) ** halves``
    (9e-5 at 0.8 by default, 7e-7 at 0.9).

    Equal sets form one class first, so a hot group of copies is one row from then on.  Each class is
    compared with one hub of the tables that it is in; these links give components.  Then what shares a table
    but lies in different components is compared as well, in blocks of the classes of a hub, so that no link
    between different texts is lost to the hubs.  A text moves once for each block that its own one meets, not
    once a pair.  Links, components and sets never reach the driver; the tables between the steps lie in the
    shared folder and are dropped at the end, when the result is a table there.

    Texts without words, null texts included, have no shingles and are linked with nothing.  Rows with a
    null id take no part: component null, kept.  Rows that repeat an id are one document of several texts:
    a copy of any of them shares its component.  Empty tables give no rows; other columns do not matter.
    """
    work = Scratch(docs.sparkSession, "near-duplicates")
    signed = work.cut(signatures(docs, key, text, width, half, halves))
    classes = signed.where("n > 0 AND node IS NOT NULL").groupBy("cls")
    classes = classes.agg(F.min(F.struct("node", "n", "a", "b")).alias("r"), F.count(F.lit(1)).alias("size"))
    reps = work.cut(classes.select("cls", "size", "r.node", "r.n", "r.a", "r.b"))
    rows, sizes = _tables(reps, work)
    met, homes = _homes(rows, sizes, work)
    work.drop(rows, sizes)

    links = _compared(_star_cells(homes), docs, key, text, width, percent, work)
    comps = work.cut(connected_components(links, "x", "y"))
    links = _compared(_open_cells(met, homes, comps, work), docs, key, text, width, percent, work)
    joined = connected_components(links, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("joined"))
    found = comps.select("node", "component").unionByName(joined.select(F.col("component").alias("node"), "component"))
    found = found.groupBy("node").agg(F.min("component").alias("component")).join(joined, "component", "left")
    found = found.select("node", F.coalesce("joined", "component").alias("component"))

    named = reps.select("cls", "size", "node").join(found, "node", "left")
    named = work.cut(named.select("cls", "size", F.coalesce("component", "node").alias("component")).where("size > 1 OR component <> node"))
    ids = signed.select(F.col("node").alias("id"), "n", F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    out = join_by_key(ids, named, "cls", "size", "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    names = [F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept")]
    return work.keep_only(work.cut(out.select(*names)))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, percent=80)


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS meet FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * meet >= 80 * (p.n + q.n - meet)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.d = w.doc_id
"""

SQL = {"op8_minhash_near_dedup": OP8_SQL}
