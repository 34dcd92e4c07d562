"""Shards of near equal bytes by a k-d tree: split at the weighted median of the widest metadata dimension.

Medians are found without moving rows: histograms of weights between the ends of the bin that holds the median, for
all nodes of a level at once, until the bin holds one place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from strataframe.llm.common import crc32_sql, table, text_of
from strataframe.operators.spatial import SMALL, ranked
from strataframe.runtime import Scratch, join_by_key, sized_broadcast

#: Bins of a histogram of one node.
BINS = 4096
#: Copies of one text may be parted if they weigh more than a shard over this.
PARTED_FROM = 20
#: A place in a node's order: the dimension's coordinate, the group of equal texts, the id's upper and lower half.
_STAGES = ("c", "grp", "high", "low")


def group_of(text: Column) -> Column:
    """60 bits of a text's digest; equal texts share them."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Bits of a size, so that a step is a doubling."""
    return F.length(F.bin(size))


def with_rank(scratch: Scratch, docs: DataFrame, name: str, out: str) -> DataFrame:
    """Add ``out``: the place of the value of ``name`` among its distinct values by code points, from 1; 0 for null."""
    counts = docs.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    ranks = scratch.cut(ranked(counts, name).withColumnRenamed("pos", "_pos"))
    small = ranks.count() <= SMALL
    met = docs.join(F.broadcast(ranks), name, "left") if small else join_by_key(docs, ranks, name, "_n", "doc_id", "left")
    return met.select(*docs.columns, F.coalesce("_pos", F.lit(0)).cast("int").alias(out))


def _coordinate(dims: list[str]) -> str:
    return f"element_at(array({', '.join(f'CAST({d} AS LONG)' for d in dims)}), coalesce(dim, 1))"


def _bounds(rows: DataFrame, dims: list[str]) -> DataFrame:
    ends = ", ".join(f"min({d}) AS min_{d}, max({d}) AS max_{d}" for d in dims)
    return rows.sparkSession.sql(f"SELECT node, k, sum(weight) AS w, {ends} FROM {{rows}} GROUP BY node, k", rows=rows)


#: A search for one node's cut: its weight and shards, the dimension, the stage of the place and the ends of the bin
#: looked into, the weight before it, and what is known of the cut.
_STATE = ["node", "k", "w", "k_left", "dim", "stage", "before", "lo", "hi", *[f"at_{s}" for s in _STAGES], "unit", "done"]


def _first_states(rows: DataFrame, dims: list[str], spans: Mapping[str, int]) -> DataFrame:
    """A node's widest dimension, the weight that goes left, and the ends of its coordinates."""
    wide = ", ".join(f"(max_{d} - min_{d}) / {float(max(spans[d], 1))}D" for d in dims)
    low, high = (f"element_at(array({', '.join(f'CAST({n}_{d} AS LONG)' for d in dims)}), dim)" for n in ("min", "max"))
    unknown = ", ".join(f"CAST(NULL AS LONG) AS at_{s}" for s in _STAGES)
    widest = f"SELECT *, CAST(array_position(array({wide}), array_max(array({wide}))) AS INT) AS dim FROM {{found}}"
    sql = f"""SELECT node, k, w, CAST(ceil(k / 2) AS INT) AS k_left, dim, 0 AS stage, 0L AS before, {low} AS lo, {high} AS hi,
                     {unknown}, CAST(NULL AS LONG) AS unit, false AS done FROM ({widest})"""
    return rows.sparkSession.sql(sql, found=_bounds(rows.where("k > 1"), dims))


def _told(spark: SparkSession, states: list[Row]) -> DataFrame:
    """A level's states as a table of literals."""
    values = ", ".join(f"({', '.join('NULL' if v is None else str(v) for v in row)})" for row in states)
    kinds = ["INT" if n in ("node", "k", "k_left", "dim", "stage") else "BOOLEAN" if n == "done" else "LONG" for n in _STATE]
    casts = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in zip(_STATE, kinds, strict=True))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(_STATE)})")


def _narrowed(rows: DataFrame, dims: list[str], states: DataFrame, whole: float) -> DataFrame:
    """One step for every node: the bin that holds the median, its ends, and the weight before it.

    A group of copies stays whole unless it weighs more than its share of ``whole``, a shard's weight.
    """
    known = " AND ".join(f"(at_{s} IS NULL OR at_{s} = {s})" for s in _STAGES[:-1])
    places = f"array({', '.join(_STAGES)})"
    exact = lambda x: f"CAST({x} AS DECIMAL(38, 0))"
    found = ", ".join(f"CASE WHEN one AND stage = {i} THEN v_lo ELSE at_{s} END AS at_{s}" for i, s in enumerate(_STAGES))
    sql = f"""
    WITH met AS (SELECT r.* EXCEPT (k), s.* EXCEPT (node), {_coordinate(dims)} AS c FROM {{rows}} AS r JOIN {{states}} AS s ON r.node = s.node),
    placed AS (SELECT *, element_at({places}, stage + 1) AS v, get({places}, stage + 1) AS f FROM met WHERE {known}),
    binned AS (SELECT *, (v - lo) DIV ((hi - lo) DIV {BINS} + 1) AS bin FROM placed WHERE v BETWEEN lo AND hi),
    bins AS (SELECT {', '.join(_STATE)}, bin, sum(weight) AS b, min(v) AS v_lo, max(v) AS v_hi, min(f) AS f_lo, max(f) AS f_hi FROM binned GROUP BY {', '.join(_STATE)}, bin),
    summed AS (SELECT *, before + sum(b) OVER (PARTITION BY node ORDER BY bin) AS upto FROM bins),
    first AS (SELECT node, min_by(struct(*), bin) AS s FROM summed WHERE {exact('upto')} * k >= {exact('w')} * k_left GROUP BY node),
    told AS (SELECT s.*, s.v_lo = s.v_hi AS one, s.v_lo = s.v_hi AND (s.stage = {len(_STAGES) - 1} OR s.stage = 1 AND s.b * {PARTED_FROM} <= {whole}D) AS over FROM first)
    SELECT node, k, w, k_left, dim, CASE WHEN one AND NOT over THEN stage + 1 ELSE stage END AS stage, upto - b AS before,
           CASE WHEN one AND NOT over THEN f_lo ELSE v_lo END AS lo, CASE WHEN one AND NOT over THEN f_hi ELSE v_hi END AS hi,
           {found}, CASE WHEN over THEN b END AS unit, over AS done FROM told"""
    return rows.sparkSession.sql(sql, rows=rows, states=states)


def _split(rows: DataFrame, dims: list[str], states: DataFrame) -> DataFrame:
    """Every row of a node that is cut goes left or right; ``node`` is the first shard of what it leads to.

    What straddles the cut goes left if the left is then nearer to its share than without it.
    """
    side = "fits"
    for s in reversed(_STAGES):
        side = f"CASE WHEN at_{s} IS NULL THEN fits WHEN {s} < at_{s} THEN true WHEN {s} > at_{s} THEN false ELSE {side} END"
    exact = lambda x: f"CAST({x} AS DECIMAL(38, 0))"
    fits = f"{exact('before + unit')} * k - {exact('w')} * k_left <= {exact('w')} * k_left - {exact('before')} * k AS fits"
    rest = ", ".join(c for c in rows.columns if c not in ("node", "k"))
    sql = f"""
    WITH cuts AS (SELECT node, k_left, dim, {', '.join(f'at_{s}' for s in _STAGES)}, {fits} FROM {{states}}),
    met AS (SELECT r.*, c.* EXCEPT (node), {_coordinate(dims)} AS c FROM {{rows}} AS r LEFT JOIN cuts AS c ON r.node = c.node),
    went AS (SELECT *, {side} AS goes FROM met)
    SELECT {rest}, CASE WHEN dim IS NULL OR goes THEN node ELSE node + k_left END AS node,
           CASE WHEN dim IS NULL THEN k WHEN goes THEN k_left ELSE k - k_left END AS k FROM went"""
    return rows.sparkSession.sql(sql, rows=rows, states=states)


def kd_shards(docs: DataFrame, dims: list[str], weight: str = "size", group: str = "grp", key: str = "doc_id", shards: int | None = None, target: int | None = None) -> DataFrame:
    """Add ``shard`` (0 to the number of shards less 1): near equal sums of ``weight``.

    The number is ``shards``, or the whole weight over ``target``, rounded, one at least.  A node of k shards is cut
    along the dimension (integer columns ``dims``) that is widest against the whole table's, ties to the first named,
    where it holds the share of the left ceil(k / 2) shards; rows of one coordinate follow by ``group``, then ``key``
    (null first).  The cut falls before or after what straddles it, whichever is nearer: a whole group of copies if it
    weighs at most a ``PARTED_FROM``-th of a shard, else the rows of one id.  So a group that is a third of the table
    is dealt to as many shards as it needs, and shards differ by about a tenth at most, or by what one row weighs.

    Equal rows share a shard.  Weights are positive, groups and dimensions never null, groups not negative.  Empty table:
    no row.  A column named shard is replaced, all others stay.  The driver holds one state for each node of a level,
    fewer than there are shards, and rows move only if there are too many of them to be broadcast.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "kd")
    id_, names = F.col(key).cast("long"), [f"d{i}" for i in range(len(dims))]
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != "shard"]).alias("row"),
        *[F.col(d).alias(n) for d, n in zip(dims, names, strict=True)],
        F.col(weight).cast("long").alias("weight"),
        F.col(group).alias("grp"),
        F.coalesce(F.shiftright(id_, 32), F.lit(-(1 << 31) - 1)).alias("high"),
        F.coalesce(id_.bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)).alias("low"),
        F.lit(0).alias("node"),
        F.lit(1).alias("k"),
    )
    rows, dims = scratch.cut(rows), names
    ends = _bounds(rows, dims).first()
    if ends is None:
        return rows.select("row.*", F.col("node").alias("shard"))
    total, spans = ends["w"], {d: ends[f"max_{d}"] - ends[f"min_{d}"] for d in dims}
    n = shards or max(1, round(total / target))
    rows, levels = rows.withColumn("k", F.lit(n)), (n - 1).bit_length()
    for _ in range(levels):
        open_, cuts = _first_states(rows, dims, spans).collect(), []
        while open_:
            found = _narrowed(rows, dims, sized_broadcast(_told(spark, open_), len(open_), SMALL), total / n).collect()
            open_, cuts = [x for x in found if not x["done"]], cuts + [x for x in found if x["done"]]
        if cuts:
            rows = scratch.cut(_split(rows, dims, sized_broadcast(_told(spark, cuts), len(cuts), SMALL)))
    return rows.select("row.*", F.col("node").alias("shard"))


def with_slots(rows: DataFrame, *order) -> DataFrame:
    """Add ``slot``, the place in the row's ``shard`` in ``order``, from 0 and without gaps; equal rows in any order."""
    placed = ranked(rows, "shard", *order)
    firsts = placed.groupBy("shard").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    n = firsts.count()
    return placed.join(sized_broadcast(firsts, n, SMALL), "shard").select(*rows.columns, (F.col("pos") - F.col("_first")).alias("slot"))


def with_first_places(scratch: Scratch, rows: DataFrame, places: list[str], group: str = "grp", by: str = "doc_id") -> DataFrame:
    """Rows of one group get the lowest of its ``places``, so that a group has one place; a group may hold any share of the rows."""
    lows = [F.min(p).alias(f"low_{i}") for i, p in enumerate(places)]
    again = scratch.cut(rows.groupBy(group).agg(F.count(F.lit(1)).alias("copies"), *lows).where("copies > 1"))
    met = join_by_key(rows, again, group, "copies", by, "left")
    return met.withColumns({p: F.coalesce(f"low_{i}", p) for i, p in enumerate(places)}).select(*rows.columns)


def shard_documents(docs: DataFrame, shards: int | None = None, target: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32`` of every document, its ``shard`` and ``slot``: dimensions source, language, size class.

    Size: UTF-8 bytes and one; null texts count as empty and share a group with them.  Equal texts have the place of the
    first of their sources and of their languages, so they share a shard unless they are too heavy (see ``kd_shards``).
    Null sources and languages come before all others.  Repeated rows each have a slot.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = text_of("text")
    size = F.octet_length(text).cast("long") + 1
    narrow = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), group_of(text).alias("grp"))
    narrow = scratch.cut(narrow.withColumn("size_class", size_class(F.col("size"))))
    placed = with_rank(scratch, with_rank(scratch, narrow, "source", "source_place"), "lang", "lang_place").drop("source", "lang")
    placed = with_first_places(scratch, scratch.cut(placed), ["source_place", "lang_place"])
    sharded = kd_shards(placed, ["source_place", "lang_place", "size_class"], shards=shards, target=target)
    return with_slots(sharded.select("doc_id", "size", "text_crc32", "shard"), F.asc_nulls_first("doc_id"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def _level_sql(before: str, here: str) -> str:
    """One level of splits in halves; the widest dimension, then sums in its order."""
    wide = [f"CAST(max({d}) OVER n - min({d}) OVER n AS DOUBLE) / s{i}" for i, d in enumerate("abc")]
    ordered = "PARTITION BY node ORDER BY v, grp"
    return f"""
{here}1 AS (SELECT *, {', '.join(f'{x} AS w{i}' for i, x in enumerate(wide))} FROM {before} WINDOW n AS (PARTITION BY node)),
{here}2 AS (SELECT *, CASE WHEN w0 >= w1 AND w0 >= w2 THEN a WHEN w1 >= w2 THEN b ELSE c END AS v FROM {here}1),
{here}3 AS (SELECT *, sum(size) OVER (PARTITION BY node) AS w, sum(size) OVER ({ordered}) AS upto, sum(size) OVER (PARTITION BY node, v, grp) AS unit,
  sum(size) OVER ({ordered}, id) AS upto_id, sum(size) OVER (PARTITION BY node, v, grp, id) AS unit_id FROM {here}2),
{here}4 AS (SELECT *, 2 * upto >= w AND 2 * (upto - unit) < w AS straddles, 2 * upto_id >= w AND 2 * (upto_id - unit_id) < w AS straddles_id FROM {here}3),
{here} AS (SELECT r, id, size, grp, a, b, c, s0, s1, s2, total, 2 * node + CASE
  WHEN NOT straddles THEN CASE WHEN 2 * upto < w THEN 0 ELSE 1 END
  WHEN unit * 16 * {PARTED_FROM} <= total THEN CASE WHEN 2 * upto - w <= w - 2 * (upto - unit) THEN 0 ELSE 1 END
  WHEN NOT straddles_id THEN CASE WHEN 2 * upto_id < w THEN 0 ELSE 1 END
  WHEN 2 * upto_id - w <= w - 2 * (upto_id - unit_id) THEN 0 ELSE 1 END AS node FROM {here}4)"""


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS grp, {crc32_sql("coalesce(text, '')")} AS crc FROM documents),
k AS (SELECT source, dense_rank() OVER (ORDER BY source) AS a FROM (SELECT DISTINCT source FROM d WHERE source IS NOT NULL)),
l AS (SELECT lang, dense_rank() OVER (ORDER BY lang) AS b FROM (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL)),
e AS (SELECT r, coalesce(CAST(doc_id AS HUGEINT), -9223372036854775809) AS id, size, grp, min(coalesce(a, 0)) OVER g AS a, min(coalesce(b, 0)) OVER g AS b, length(bin(size)) AS c, 0 AS node FROM d LEFT JOIN k USING (source) LEFT JOIN l USING (lang) WINDOW g AS (PARTITION BY grp)),
f AS (SELECT *, {', '.join(f'greatest(max({d}) OVER () - min({d}) OVER (), 1) AS s{i}' for i, d in enumerate('abc'))}, sum(size) OVER () AS total FROM e),
{_level_sql('f', 'g')}, {_level_sql('g', 'h')}, {_level_sql('h', 'i')}, {_level_sql('i', 'j')}
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(node AS INT) AS shard,
       row_number() OVER (PARTITION BY node ORDER BY d.doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM d JOIN j USING (r)
"""

QUERIES = {"op12_sharding": op12_sharding}
SQL = {"op12_sharding": OP12_SQL}
