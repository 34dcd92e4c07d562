"""Periodic runs of words: suffix trees of a text and its reversal, Lyndon roots extended both ways.

Bannai et al. (2017): every run has a Lyndon root that is the longest Lyndon word at its place, under the order of
symbols or under its reversal.  So 2n candidates, each extended by two common-extension queries, give all runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from strataframe.llm.common import WORD, crc32_sql, in_small_batches, let, table

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
#: Places of a block of the Euler tour; neighbours differ by one, so a block is told by seven signs.
_BLOCK = 8


def _lowest_in_blocks() -> np.ndarray:
    """For seven signs and places i <= j of a block, the place of the lowest level."""
    signs = (np.arange(1 << (_BLOCK - 1))[:, None] >> np.arange(_BLOCK - 1)) & 1
    levels = np.concatenate([np.zeros((len(signs), 1), int), np.cumsum(2 * signs - 1, axis=1)], axis=1)
    out = np.zeros((len(signs), _BLOCK, _BLOCK), np.int8)
    for i in range(_BLOCK):
        for j in range(i, _BLOCK):
            out[:, i, j] = i + levels[:, i : j + 1].argmin(axis=1)
    return out


_LOWEST = _lowest_in_blocks()


class SuffixTree:
    """Ukkonen's tree of a list of numbers from 0, the last one found nowhere else; answers queries in constant time each.

    ``rank`` tells the place of every suffix in the order of symbols.  Memory is in proportion to the list.
    """

    def __init__(self, symbols: list[int]):
        self.size, self._sigma = len(symbols), max(symbols) + 1
        self._grow(symbols)
        self._tour()

    def _grow(self, s: list[int]) -> None:
        n, sigma = self.size, self._sigma
        start, end, link, to = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                at = node * sigma + s[edge]
                below = to.get(at)
                if below is None:
                    to[at] = len(start)
                    start.append(i), end.append(n), link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = 0
                else:
                    span = end[below] - start[below]
                    if length >= span:
                        edge, length, node = edge + span, length - span, below
                        continue
                    branch = start[below] + length
                    if s[branch] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(start)
                    to[at] = middle
                    start.append(start[below]), end.append(branch), link.append(0)
                    to[middle * sigma + c] = middle + 1
                    start.append(i), end.append(n), link.append(0)
                    start[below] = branch
                    to[middle * sigma + s[branch]] = below
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._spans = np.array(end) - np.array(start)
        edges = np.fromiter(to.keys(), np.int64, len(to))
        order = np.argsort(edges)
        self._child = np.fromiter(to.values(), np.int64, len(to))[order]
        self._parent = edges[order] // sigma

    def _tour(self) -> None:
        count = len(self._spans)
        first_child = np.searchsorted(self._parent, np.arange(count + 1)).tolist()
        child, spans, up = self._child.tolist(), self._spans.tolist(), [0] * count
        for c, p in zip(child, self._parent.tolist(), strict=True):
            up[c] = p
        depth, seen, place, level, first = [0] * count, first_child[:], [], [], [0] * count
        node = high = 0
        while True:
            place.append(node)
            level.append(high)
            k = seen[node]
            if k < first_child[node + 1]:
                seen[node] = k + 1
                below = child[k]
                depth[below] = depth[node] + spans[below]
                first[below] = len(place)
                node, high = below, high + 1
            elif high:
                node, high = up[node], high - 1
            else:
                break
        self._depth = np.array(depth)[np.array(place)]
        leaf = np.diff(first_child) == 0
        leaves = np.flatnonzero(leaf)
        suffix = self.size - np.array(depth)[leaves]
        self._first = np.zeros(self.size, np.int64)
        self._first[suffix] = np.array(first)[leaves]
        self.rank = np.empty(self.size, np.int64)
        self.rank[np.argsort(self._first)] = np.arange(self.size)
        self._index(np.array(level))

    def _index(self, level: np.ndarray) -> None:
        rest = -len(level) % _BLOCK
        level = np.concatenate([level, level[-1] + 1 + np.arange(rest)])
        blocks = level.reshape(-1, _BLOCK)
        self._signs = ((np.diff(blocks, axis=1) > 0) << np.arange(_BLOCK - 1)).sum(axis=1)
        self._level = level
        lows = [np.arange(len(blocks)) * _BLOCK + _LOWEST[self._signs, 0, _BLOCK - 1]]
        step = 1
        while 2 * step <= len(blocks):
            a, b = lows[-1][:-step], lows[-1][step:]
            lows.append(np.where(level[a] <= level[b], a, b))
            step *= 2
        self._lows = lows

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common start of suffixes ``i`` and ``j``, pair by pair, i and j unlike: the depth of their lowest common ancestor."""
        a, b = self._first[i], self._first[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        left, right = low // _BLOCK, high // _BLOCK
        alone = left == right
        best = left * _BLOCK + _LOWEST[self._signs[left], low % _BLOCK, np.where(alone, high % _BLOCK, _BLOCK - 1)]
        best = self._lower(best, np.where(alone, best, right * _BLOCK + _LOWEST[self._signs[right], 0, high % _BLOCK]))
        between = right - left - 1
        for power, lows in enumerate(self._lows):
            at = np.flatnonzero((between >= 1 << power) & (between < 2 << power))
            if len(at):
                two = self._lower(lows[left[at] + 1], lows[right[at] - (1 << power)])
                best[at] = self._lower(best[at], two)
        return self._depth[best]

    def _lower(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self._level[b] < self._level[a], b, a)


def _next_lower(rank: list[int]) -> np.ndarray:
    """The next place whose rank is lower, the end where there is none: where the longest Lyndon word of each place ends."""
    n = len(rank)
    out, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def _runs_of_symbols(symbols: list[int], min_words: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period), by start and period, of the runs of a list of numbers from 1."""
    n = len(symbols)
    forth, back = SuffixTree([*symbols, 0]), SuffixTree([*reversed(symbols), 0])
    ranks = forth.rank[:n]
    roots = []
    for order in (ranks, -ranks):
        ends = _next_lower(order.tolist())
        begins = np.flatnonzero(ends < n)
        roots.append(np.stack([begins, ends[begins]], axis=1))
    i, j = np.unique(np.concatenate(roots), axis=0).T
    period = j - i
    ahead = forth.common(i, j)
    behind = np.zeros_like(i)
    inner = np.flatnonzero(i > 0)
    behind[inner] = back.common(n - i[inner], n - j[inner])
    length = period + ahead + behind
    kept = length >= np.maximum(min_words, min_exponent * period)
    return np.unique(np.stack([i - behind, length, period], axis=1)[kept], axis=0)[:, [0, 1, 2]]


def _stretches(words: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int]]:
    """Parts (start, end) of the text outside which no run can lie, told by three-word windows.

    In a run of period q, a window comes back q words on: of q >= 2, 4q words or more hold each window three times;
    of one, six words hold it four times (so for other limits).  A window that is rarer lies in no run.
    """
    rare = min(min_exponent, max(min_words, min_exponent) - 1)
    width = int(words.max()) + 1
    _, pairs = np.unique(words[:-1] * width + words[1:], return_inverse=True)
    _, which, often = np.unique(pairs[:-1] * width + words[2:], return_inverse=True, return_counts=True)
    if often.max() < rare - 1:
        return []
    fits = np.concatenate([[False], (often >= rare - 1)[which], [False]])
    turns = np.flatnonzero(fits[1:] != fits[:-1])
    return [(a, b + 2) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True) if b + 2 - a >= min_words]


def runs_of_words(words: list, min_words: int = 6, min_exponent: int = 4) -> np.ndarray:
    """Rows (start, length, period), by start and period: every stretch of ``words`` with smallest period q of at
    least ``min_words`` words and ``min_exponent`` periods that no neighbour extends; words may be any hashable."""
    if min_words < 3 or min_exponent < 2:
        raise ValueError("a run has three words and two periods or more")
    if len(words) < min_words:
        return np.zeros((0, 3), np.int64)
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    parts = _stretches(ids, min_words, min_exponent)
    if not parts:
        return np.zeros((0, 3), np.int64)
    # one list of all stretches, a symbol of its own between two of them; small numbers, since they key the edges
    _, near = np.unique(np.concatenate([ids[a:b] for a, b in parts]), return_inverse=True)
    symbols, homes, taken, fresh = [], [], 0, int(near.max()) + 2
    for a, b in parts:
        symbols += (near[taken : taken + b - a] + 1).tolist()
        symbols.append(fresh)
        homes += [*range(a, b), -1]
        taken, fresh = taken + b - a, fresh + 1
    found = _runs_of_symbols(symbols, min_words, min_exponent)
    found[:, 0] = np.array(homes)[found[:, 0]]
    return found


def collapse(words: list, runs: np.ndarray) -> list:
    """``words`` without those that any run holds after its first period."""
    if not len(runs):
        return words
    turn = np.zeros(len(words) + 1, np.int64)
    np.add.at(turn, runs[:, 0] + runs[:, 2], 1)
    np.add.at(turn, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(turn[:-1]) == 0).tolist()]


def find_runs(docs: DataFrame, text: str = "text", min_words: int = 6, min_exponent: int = 4) -> DataFrame:
    """Add ``runs``, the periodic runs by start and period, and ``collapsed``, the text with one period of each run.

    Words are runs of code points other than ASCII white space; ``collapsed`` joins those that are kept by one space.
    A null or empty text has no run and an empty ``collapsed``.  Rows are read one by one, so repeated rows, ties and
    hot keys do not matter and nothing is shuffled; an empty table gives an empty one.  Columns of the added names are
    replaced, all others stay.  Memory of a task is in proportion to a batch of texts, and to the stretches of one
    text that can hold runs.
    """
    kept = [c for c in docs.columns if c not in ("runs", "collapsed")]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    names = ["start", "length", "period"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, found, left = [0], [], []
            for value in batch.column("_text").to_pylist():
                words = (value or b"").split()  # of bytes: splits at the six ASCII characters and nothing else
                runs = runs_of_words(words, min_words, min_exponent)
                found.append(runs)
                ends.append(ends[-1] + len(runs))
                left.append(b" ".join(collapse(words, runs)))
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names)
            out = [*[batch.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, [*kept, "runs", "collapsed"])

    source = in_small_batches(docs.select(*kept, F.col(text).cast("binary").alias("_text")))
    return source.mapInArrow(search, schema)


def runs_text(runs: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed, in the order given."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def longest_run(runs: Column) -> Column:
    """The run of greatest length in periods, exactly compared; ties to the smallest start, then period; null without a run."""
    first = F.get(runs, F.lit(0))
    wide = lambda c: c.cast("decimal(19,0)")
    return F.aggregate(runs, first, lambda best, r: F.when(wide(r["length"]) * wide(best["period"]) > wide(best["length"]) * wide(r["period"]), r).otherwise(best))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, one in ten made periodic from some word on, as ids tell: h = crc32 of the decimal id, g = h div 10."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        period = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return let(F.struct(a.alias("a"), period.alias("p")), lambda at: F.array_join(F.transform(words, lambda w, i: F.when(i < at["a"], w).otherwise(F.get(words, (at["a"] + (i - at["a"]) % at["p"]).cast("int")))), " "))

    made = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.when(F.size(w) > 0, repeat(w)))
    return F.coalesce(F.when(h % 10 == 0, made), text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs).select("doc_id", "runs", "collapsed", longest_run(F.col("runs")).alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{n}").alias(n) for n in ("start", "length", "period")],
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
        F.sha2(runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Windows of three words that are found again within a quarter of the text, told apart by distance; islands of
#: neighbouring starts are stretches of that period, and the smallest period of a stretch is its run's.
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM e),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
t AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
x AS (SELECT r, n, unnest(w) AS x, unnest(range(n)) AS i FROM t),
k AS (SELECT r, n, i, x || ' ' || lead(x) OVER s || ' ' || lead(x, 2) OVER s AS k FROM x WINDOW s AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, n, i, k FROM (SELECT *, count(*) OVER (PARTITION BY r, k) AS c FROM k WHERE k IS NOT NULL) WHERE c > 2),
m AS (SELECT u.r, u.i, v.i - u.i AS q FROM c AS u JOIN c AS v ON u.r = v.r AND u.k = v.k AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
s AS (SELECT r, q, min(i) AS start, count(*) + 2 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m) GROUP BY r, q, island),
z AS (SELECT r, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
b AS (SELECT r, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, place) AS best,
             sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
      FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM z) GROUP BY r),
o AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM z),
l AS (SELECT x.r, string_agg(x.x, ' ' ORDER BY x.i) AS left_over FROM x ANTI JOIN o ON x.r = o.r AND x.i = o.i GROUP BY x.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(best.length * 1000 // best.period AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (r) LEFT JOIN l USING (r)
"""

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
SQL = {"op13_periodic_runs": OP13_SQL}
