"""Merkle manifest of a table: bitmaps of ids tell each leaf's place, slot arrays reduce the levels.

A group's ids are held as 64-bit words, empty ones left out; counts of words, of containers of words and so on up
form a directory.  A leaf's place is the directory's count before its word and the bits before its own, so leaves are
never sorted.  Leaves then meet in arrays of ``SLOTS`` neighbours, each array reduced by up to ``FAN_BITS`` levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strataframe.llm.common import crc32_sql, let, table
from strataframe.operators.spatial import SMALL, ranked
from strataframe.runtime import Scratch, join_by_key, sized_broadcast

#: Levels that one array of slots reduces; also words of a container and containers of the next level.
FAN_BITS = 10
SLOTS = 1 << FAN_BITS
#: Ids of a word of a bitmap.
_WORD_BITS = 6
#: Rows of a directory level that a window over a whole group may hold.
DIRECTORY_ROWS = 4096
#: The word of null ids: below every word of a long.
_NO_WORD = -(1 << (63 - _WORD_BITS)) - 1


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of a row's fields, in the order given; nulls are fields of their own."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _group_key(group: str) -> Column:
    """A group's name with null first and no name lost; ordered by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))


def bitmap_words(rows: DataFrame) -> DataFrame:
    """``(home, bits, n)``: a bitmap's non-empty words by group and word (``home``), and the rows whose ids they hold.

    Bitmaps are merged by bit-or, in every task before anything is moved.
    """
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    return rows.groupBy("home").agg(F.bit_or(mark).alias("bits"), F.count(F.lit(1)).alias("n"))


def _directory(scratch: Scratch, nodes: DataFrame, bits: int = 64 - _WORD_BITS) -> DataFrame:
    """Add ``before``, the group's rows before each node ``(g, w, n)``: counts within its container and above it.

    A window holds one container, ``SLOTS`` nodes at most; a whole group only where the level is proven small, or
    has no more than two places a group.
    """
    inside = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if bits <= 0 or nodes.count() <= DIRECTORY_ROWS:
        return nodes.withColumn("before", inside("g"))
    up = nodes.withColumn("_up", F.shiftright("w", FAN_BITS))
    containers = scratch.cut(up.groupBy("g", F.col("_up").alias("w")).agg(F.sum("n").alias("n")))
    above = _directory(scratch, containers, bits - FAN_BITS).select("g", F.col("w").alias("_up"), F.col("before").alias("_above"))
    within = up.withColumn("_within", inside("g", "_up"))
    return within.join(above, ["g", "_up"]).select("g", "w", "n", (F.col("_above") + F.col("_within")).alias("before"))


def leaf_places(scratch: Scratch, leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(g, i, d, rest)``: the place ``i`` in its group, from 0, of every leaf ``(g, key, d, rest)``; and the rows ``n`` of each ``g``.

    Ids of which a group holds several rows are no bitmap's matter: the rows of their words, and no others, are
    sorted by id and leaf.  Null ids come first.
    """
    word = F.coalesce(F.shiftright("key", _WORD_BITS), F.lit(_NO_WORD))
    bit = F.coalesce(F.col("key").bitwiseAND(F.lit((1 << _WORD_BITS) - 1)), F.lit(0)).cast("int")
    rows = leaves.select(F.struct("g", word.alias("w")).alias("home"), bit.alias("bit"), "key", "d", "rest")
    words = scratch.cut(bitmap_words(rows))
    totals = scratch.cut(words.groupBy("home.g").agg(F.sum("n").alias("n")))
    before = _directory(scratch, words.select("home.g", "home.w", "n"))
    crowded = F.col("n") > F.bit_count("bits")
    indexed = scratch.cut(words.join(before.select(F.struct("g", "w").alias("home"), "before"), "home").withColumn("crowded", crowded))
    placed = join_by_key(rows, indexed, "home", "n", "key")
    below = F.bit_count(F.call_function("shiftleft", F.col("bits"), F.lit(63) - F.col("bit"))) - 1
    told = placed.where("NOT crowded").select("home.g", (F.col("before") + below).alias("i"), "d", "rest")
    if indexed.where("crowded").limit(1).count():
        crowd = ranked(placed.where("crowded").select("home", "before", "key", "d", "rest"), "home", F.asc_nulls_first("key"), "d")
        first = crowd.groupBy("home").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
        crowd = join_by_key(crowd, scratch.cut(first), "home", "n", "pos")
        told = told.unionByName(crowd.select("home.g", (F.col("before") + F.col("pos") - F.col("first")).alias("i"), "d", "rest"))
    return told, totals


def _parents(nodes: Column) -> Column:
    """Digests of every two neighbours, the last alone where they are odd in number."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda i: F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))), 256))


def _levels(nodes: Column, steps: Column) -> Column:
    """The nodes and the levels above them, ``steps`` of them."""
    grown = F.aggregate(F.sequence(F.lit(1), steps), F.array(nodes), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))
    return F.when(steps > 0, grown).otherwise(F.array(nodes))


def _siblings(levels: Column, slot: Column, steps: Column) -> Column:
    """The siblings of a slot up to the top of its array: ``L`` or ``R`` and the digest by side, ``-`` for none."""

    def at(j: Column) -> Column:
        level, here = F.get(levels, j), F.call_function("shiftright", slot, j)
        other = here.bitwiseXOR(F.lit(1))
        return F.when(other < here, F.concat(F.lit("L"), F.get(level, other))).otherwise(F.coalesce(F.concat(F.lit("R"), F.get(level, other)), F.lit("-")))

    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), at)).otherwise(F.array().cast("array<string>"))


def climb(scratch: Scratch, nodes: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes (g, i, d, rest)``, digests ``d`` at places ``i``: the roots ``(g, root)`` and the paths.

    Paths are the nodes' rows ``(g, i, d, rest, path)``, siblings from the bottom up.  ``totals`` has the nodes ``n``
    of each ``g``.  Nodes are keyed by array, ``SLOTS`` in each, so a large group is dealt to as many tasks as it has
    arrays; an array's top is a node of the next call.
    """
    gathered = nodes.groupBy("g", F.shiftright("i", FAN_BITS).alias("b")).agg(F.sort_array(F.collect_list(F.struct("i", "d", "rest"))).alias("slots"))
    small = sized_broadcast(totals, totals.count(), SMALL)
    size = F.length(F.bin(F.size("slots") - 1))
    steps = F.when(F.col("n") > SLOTS, F.lit(FAN_BITS)).when(F.col("n") == 1, F.lit(0)).otherwise(size).cast("int")
    arrays = scratch.cut(gathered.join(small, "g").withColumn("steps", steps))
    digests = F.transform("slots", lambda s: s["d"])
    top = F.get(F.element_at(let(digests, lambda d: _levels(d, F.col("steps"))), -1), F.lit(0))
    tops = scratch.cut(arrays.select("g", F.col("b").alias("i"), top.alias("d"), F.lit(0).alias("rest"), "n"))
    roots = tops.where(F.col("n") <= SLOTS).select("g", F.col("d").alias("root"))
    more = scratch.cut(totals.where(F.col("n") > SLOTS).select("g", F.ceil(F.col("n") / SLOTS).alias("n")))
    above = None
    if more.limit(1).count():
        higher, above = climb(scratch, tops.where(F.col("n") > SLOTS).drop("n"), more)
        roots, above = roots.unionByName(higher), above.select("g", F.col("i").alias("b"), F.col("path").alias("above"))

    def with_paths(levels: Column) -> Column:
        return F.transform(F.col("slots"), lambda s, k: F.struct(s["i"].alias("i"), s["d"].alias("d"), s["rest"].alias("rest"), _siblings(levels, k, F.col("steps")).alias("path")))

    found = arrays.select("g", "b", let(let(digests, lambda d: F.struct(_levels(d, F.col("steps")).alias("l"))), lambda l: with_paths(l["l"])).alias("slots"))
    if above is None:
        return roots, found.select("g", F.inline("slots"))
    # groups of one array end here, all others go on
    met = found.join(above, ["g", "b"], "left").select("g", F.coalesce("above", F.array().cast("array<string>")).alias("above"), F.inline("slots"))
    return roots, met.select("g", "i", "d", "rest", F.concat("path", "above").alias("path"))


def manifest(leaves: DataFrame, group: str = "lang", key: str = "doc_id", leaf: str = "leaf") -> DataFrame:
    """Add ``leaf_index``, ``path`` (siblings up to the root), ``subroot`` (the group's) and ``root`` to ``leaves``.

    Leaves of a group ascend by ``key``, null first; rows of one id by their digest, so equal rows are leaves of their
    own.  Groups ascend by UTF-8 bytes, null first; their subroots are the leaves of the top tree.  A group may be a
    third of all rows or have one row.  Empty table: no row.  Columns of the added names are replaced, others stay;
    a leaf is never null (``leaf_digest`` makes none).
    """
    added = ("leaf_index", "path", "subroot", "root")
    names = [c for c in leaves.columns if c not in added]
    scratch = Scratch(leaves.sparkSession, "merkle")
    plain = leaves.select(_group_key(group).alias("g"), F.col(key).cast("long").alias("key"), F.col(leaf).alias("d"), F.struct(*names).alias("rest"))
    placed, totals = leaf_places(scratch, scratch.cut(plain))
    subroots, paths = climb(scratch, placed, totals)
    tops = ranked(subroots, "g").select(F.lit("").alias("g"), (F.col("pos") - 1).alias("i"), F.col("root").alias("d"), F.struct("g").alias("rest"))
    tops = scratch.cut(tops)
    groups = tops.count()
    roots, top_paths = climb(scratch, tops, scratch.cut(tops.groupBy("g").agg(F.count(F.lit(1)).alias("n"))))
    root = roots.select("root").first()
    heads = scratch.cut(top_paths.select("rest.g", F.col("d").alias("subroot"), F.col("path").alias("top")).join(totals, "g"))
    joined = paths.join(F.broadcast(heads), "g") if groups <= SMALL else join_by_key(paths, heads, "g", "n", "i")
    whole = F.concat("path", "top").alias("path")
    return joined.select("rest.*", F.col("i").alias("leaf_index"), whole, "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    rest = lambda t: F.substring(t, 2, 64)
    pair = lambda done, t: F.when(t.startswith("L"), F.concat(rest(t), done)).when(t.startswith("R"), F.concat(done, rest(t))).otherwise(done)
    return F.aggregate(path, leaf, lambda done, t: F.sha2(pair(done, t), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, one after the other."""
    return F.sha2(F.array_join(F.transform(path, lambda t: F.when(t != "-", F.substring(t, 2, 64)).otherwise("")), ""), 256)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    head = [F.col("doc_id"), F.col("source"), F.col("lang")]
    forged = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    leaves = docs.select("doc_id", "lang", leaf_digest(*head, F.col("n_chars"), F.col("text")).alias("leaf"), F.when(forged, leaf_digest(*head, more, F.col("text"))).alias("forged"))
    made = manifest(leaves).withColumn("folded_root", fold(F.coalesce("forged", "leaf"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _leaf_sql(chars: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", chars, "text"]
    return f"sha256({' || '.join(_field_sql(v) for v in values)})"


#: Levels by recursion, a node's sibling by the last bit of its place; folding by list_reduce over the siblings.
OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '0') AS g, {_leaf_sql("CAST(n_chars AS VARCHAR)")} AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("CAST(n_chars + 1 AS VARCHAR)")} END AS forged FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t AS (SELECT g, 0 AS l, i, leaf AS d FROM p UNION ALL
      SELECT g, l + 1, i // 2, sha256(d || coalesce(nx, '')) FROM (SELECT *, lead(d) OVER (PARTITION BY g ORDER BY i) AS nx, count(*) OVER (PARTITION BY g) AS n FROM t) WHERE i % 2 = 0 AND n > 1),
h AS (SELECT g, max(l) AS h FROM t GROUP BY g),
s AS (SELECT t.g, d AS subroot, row_number() OVER (ORDER BY t.g) - 1 AS i, h FROM t JOIN h ON t.g = h.g AND l = h),
u AS (SELECT 0 AS l, i, subroot AS d FROM s UNION ALL
      SELECT l + 1, i // 2, sha256(d || coalesce(nx, '')) FROM (SELECT *, lead(d) OVER (ORDER BY i) AS nx, count(*) OVER () AS n FROM u) WHERE i % 2 = 0 AND n > 1),
v AS (SELECT max(l) AS h FROM u),
w AS (SELECT p.r, s.subroot, k.l, p.i >> k.l AS place, t.d AS sib FROM p JOIN s ON p.g = s.g JOIN (SELECT unnest(range(64)) AS l) AS k ON k.l < s.h
      LEFT JOIN t ON t.g = p.g AND t.l = k.l AND t.i = xor(p.i >> k.l, 1)
      UNION ALL SELECT p.r, s.subroot, 100 + k.l, s.i >> k.l, u.d FROM p JOIN s ON p.g = s.g CROSS JOIN v JOIN (SELECT unnest(range(64)) AS l) AS k ON k.l < v.h
      LEFT JOIN u ON u.l = k.l AND u.i = xor(s.i >> k.l, 1)),
q AS (SELECT r, string_agg(coalesce(sib, ''), '' ORDER BY l) AS proof, list(CASE WHEN sib IS NULL THEN '-' WHEN place % 2 = 1 THEN 'L' || sib ELSE 'R' || sib END ORDER BY l) AS path FROM w GROUP BY r),
f AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT d FROM u JOIN v ON u.l = v.h) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
             list_reduce(list_prepend(coalesce(forged, leaf), coalesce(path, [])), lambda x, y: sha256(CASE y[1] WHEN 'L' THEN y[2:] || x WHEN 'R' THEN x || y[2:] ELSE x END)) AS folded_root
      FROM p JOIN s ON p.g = s.g LEFT JOIN q ON p.r = q.r)
SELECT *, folded_root = root AS verified FROM f
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
SQL = {"op11_merkle_manifest": OP11_SQL}
