"""Merkle manifest, shards and periodic runs: brute-force versions and edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strataframe.llm import merkle, runs, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, path string, runs int, node int, k int, dim int, row int, g int, i int, w int"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars), with columns whose names clash with those made inside."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4, 5, 6, 7, 8) for r in rows], DOCS)


# 11

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """Levels of a tree, from the leaves up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            out.append(("L" if i % 2 else "R") + level[i ^ 1])
        else:
            out.append("-")
        i //= 2
    return out


def plain_manifest(rows):
    """For every row its (leaf, subroot, path), and the root; rows of one id go by their leaf."""
    leaves = [(r[2], r[0], sha(*map(plain_field, (r[0], r[3], r[2], r[4], r[1])))) for r in rows]
    langs = sorted({x[0] for x in leaves}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        trees[lang] = plain_tree([x[2] for x in sorted((x for x in leaves if x[0] == lang), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))])
    top = plain_tree([trees[lang][-1][0] for lang in langs])
    out = []
    for n, lang in enumerate(langs):
        for i, leaf in enumerate(trees[lang][0]):
            out.append((leaf, trees[lang][-1][0], *plain_path(trees[lang], i), *plain_path(top, n)))
    return sorted(out), top[-1][0] if top and top[-1] else None


def made_manifest(spark, d):
    digest = merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return merkle.manifest(d.withColumn("leaf", digest))


def random_rows(count, seed):
    draw = random.Random(seed)
    ids = [draw.choice([None, -1 - i, i, i * 64, i * 70_000, 2**62 - i, -(2**63) + i, 5]) for i in range(count)]
    return [(i, draw.choice([None, "", "ä" * 3, "text \n" * draw.randrange(1, 9)]), draw.choice([None, "", "de", "en", "en", "en", "ß", "zh"]), draw.choice([None, "s"]), draw.choice([None, 7])) for i in ids]


@pytest.mark.parametrize(("count", "fan"), [(1, 10), (47, 10), (150, 3)])
def test_manifest_by_a_plain_tree(spark, monkeypatch, count, fan):
    monkeypatch.setattr(merkle, "FAN_BITS", fan)
    monkeypatch.setattr(merkle, "SLOTS", 1 << fan)
    monkeypatch.setattr(merkle, "DIRECTORY_ROWS", 4)
    rows = random_rows(count, count + fan)
    rows += rows[:3] + [rows[0]] * (count // 3)
    want, root = plain_manifest(rows)
    made = made_manifest(spark, docs(spark, rows))
    assert [c for c in made.columns if c not in ("leaf_index", "path", "subroot", "root", "leaf")] == [c for c in docs(spark, rows).columns if c != "path"]
    got = made.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    assert sorted((r.leaf, r.subroot, *r.path) for r in got) == want
    assert {r.root for r in got} == {root} == {r.folded for r in got}
    assert all(r.proof == sha(*(t[1:] for t in r.path if t != "-")) for r in got)


def test_a_changed_row_does_not_fold_to_the_root(spark):
    rows = random_rows(60, 3)
    made = made_manifest(spark, docs(spark, rows))
    forged = made.withColumn("folded", merkle.fold(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("path")))
    assert forged.where("folded = root").count() == 0


def test_manifest_of_nothing(spark):
    assert made_manifest(spark, docs(spark, [])).count() == 0


# 12

def plain_shards(rows, shards, parted=20):
    """The same splits with everything in one list: (index, shard)."""
    place = {None: 0} | {s: i + 1 for i, s in enumerate(sorted({r[3] for r in rows} - {None}))}
    langs = {None: 0} | {s: i + 1 for i, s in enumerate(sorted({r[2] for r in rows} - {None}))}
    size = [len((r[1] or "").encode()) + 1 for r in rows]
    same = {t or "": [r for r in rows if (r[1] or "") == (t or "")] for t in {r[1] for r in rows}}
    at = [(min(place[x[3]] for x in same[r[1] or ""]), min(langs[x[2]] for x in same[r[1] or ""]), size[i].bit_length()) for i, r in enumerate(rows)]
    group = [int(hashlib.md5((r[1] or "").encode()).hexdigest()[:15], 16) for r in rows]
    spans, total, out = [max(1, max(a[d] for a in at) - min(a[d] for a in at)) for d in range(3)], sum(size), {}

    def split(members, first, k):
        if k == 1 or not members:
            out.update(dict.fromkeys(members, first))
            return
        wide = [(max(at[i][d] for i in members) - min(at[i][d] for i in members)) / spans[d] for d in range(3)]
        d, w, left = wide.index(max(wide)), sum(size[i] for i in members), (k + 1) // 2
        key = lambda i: (at[i][d], group[i], -(2**64) if rows[i][0] is None else rows[i][0])
        parts = {}
        for i in members:
            parts.setdefault(key(i)[:2], []).append(i)
        before, goes = 0, []
        for _, part in sorted(parts.items()):
            units = [part]
            weight = sum(size[i] for i in part)
            if weight * parted * shards > total and before * k < w * left <= (before + weight) * k:
                ids = {}
                for i in part:
                    ids.setdefault(key(i), []).append(i)
                units = [u for _, u in sorted(ids.items())]
            for unit in units:
                heavy = sum(size[i] for i in unit)
                if (before + heavy) * k <= w * left or before * k < w * left and (before + heavy) * k - w * left <= w * left - before * k:
                    goes += unit
                before += heavy
        gone = set(goes)
        split(goes, first, left)
        split([i for i in members if i not in gone], first + left, k - left)

    split(list(range(len(rows))), 0, shards)
    return out


@pytest.mark.parametrize(("count", "shards", "bins"), [(1, 3, 4096), (120, 5, 7)])
def test_shards_by_a_plain_tree(spark, monkeypatch, count, shards, bins):
    monkeypatch.setattr(sharding, "BINS", bins)
    draw = random.Random(count + shards)
    rows = [(draw.choice([None, n, -n, n << 33]), draw.choice([None, "", "copy " * 40, "a" * draw.randrange(600)]), draw.choice([None, "de", "en"]), draw.choice([None, "s1", "s2", "hot", "hot"]), n) for n in range(count)]
    rows += [rows[0]] * (count // 3)
    want = plain_shards(rows, shards)
    got = sharding.shard_documents(docs(spark, rows), shards=shards).collect()
    told = sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32, r.shard) for r in got)
    assert told == sorted((r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), want[i]) for i, r in enumerate(rows))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_are_even_and_copies_stay_together(spark):
    draw = random.Random(1)
    texts = [f"{n} " * draw.randrange(1, 60) for n in range(400)]
    rows = [(n, t, "en", "hot" if n % 3 else f"s{n}", 0) for n, t in enumerate(texts + texts[:100] + ["many copies of it " * 4] * 250)]
    got = sharding.shard_documents(docs(spark, rows), shards=4).collect()
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 0.1 * sum(sizes) / 4 + max(r.size for r in got)
    home = {}
    for r in got:
        home.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    weights = {t: sum(len(x[1]) + 1 for x in rows if x[1] == t) for t in home}
    assert all(len(s) == 1 for t, s in home.items() if weights[t] * 20 * 4 <= sum(sizes))
    assert len(home["many copies of it " * 4]) > 1


def test_shards_of_a_target_and_of_nothing(spark):
    rows = [(n, "x" * 99, "en", "s", 0) for n in range(50)]
    got = sharding.shard_documents(docs(spark, rows), target=1000).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(got) == 5 and {r.b for r in got} == {1000}
    assert sharding.shard_documents(docs(spark, []), shards=16).count() == 0


# 13

def plain_runs(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def random_words(draw, longest=60):
    letters = draw.choice([1, 2, 2, 3, 4])
    w = [str(draw.randrange(letters)) for _ in range(draw.randrange(longest))]
    for _ in range(draw.randrange(3)):
        at = draw.randrange(len(w) + 1)
        w[at:at] = [str(draw.randrange(letters + 1)) for _ in range(draw.randrange(1, 5))] * draw.randrange(1, 7)
    return w


def test_runs_of_words_by_brute_force():
    draw = random.Random(2)
    for _ in range(1500):
        w, (least, exponent) = random_words(draw), draw.choice([(6, 4), (6, 4), (3, 2), (4, 3), (6, 2), (3, 4), (5, 5)])
        got = [tuple(r) for r in runs.runs_of_words(w, least, exponent).tolist()]
        assert got == sorted(plain_runs(w, least, exponent), key=lambda r: (r[0], r[2]))


def test_common_extensions_by_brute_force():
    draw = random.Random(3)
    for _ in range(60):
        s = [draw.randrange(1, 4) for _ in range(draw.randrange(2, 70))] + [0]
        tree = runs.SuffixTree(s)
        assert [i for _, i in sorted((s[i:], i) for i in range(len(s)))] == sorted(range(len(s)), key=lambda i: tree.rank[i])
        pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
        got = tree.common(*map(__import__("numpy").array, zip(*pairs, strict=True)))
        assert got.tolist() == [next(k for k in range(len(s)) if s[i + k] != s[j + k]) for i, j in pairs]


def test_found_runs_and_collapsed_texts(spark):
    draw = random.Random(4)
    texts = [None, "", " \n", "a b", "one " * 6, "one " * 5, "x\ta\x0bb c a b c a b c a b c y", *[draw.choice([" ", "\n"]).join(random_words(draw)) for _ in range(80)]]
    rows = [(n, t, "en", "s", None) for n, t in enumerate([*texts, "one " * 6])]
    made = runs.find_runs(docs(spark, rows))
    assert [c for c in made.columns if c not in ("runs", "collapsed")] == [c for c in docs(spark, rows).columns if c != "runs"]
    best = runs.longest_run(F.col("runs"))
    for r in made.withColumn("best", best).withColumn("told", runs.runs_text(F.col("runs"))).collect():
        words = (rows[r.doc_id][1] or "").encode().split()
        want = sorted(plain_runs(words), key=lambda x: (x[0], x[2]))
        assert [tuple(x) for x in r.runs] == want and r.told == "".join(f"{s},{n},{q}\n" for s, n, q in want)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert r.collapsed == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        first = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2])) if want else None
        assert (tuple(r.best) if r.best else None) == first
    assert runs.find_runs(docs(spark, [])).count() == 0


def test_long_texts_take_time_in_proportion():
    draw = random.Random(5)
    part = [draw.randrange(9) for _ in range(20_000)]
    assert [0, 100_000, 20_000] in runs.runs_of_words(part * 5).tolist()
    assert runs.runs_of_words([1] * 200_000).tolist() == [[0, 200_000, 1]]


def test_planted_texts_by_hand(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(n, " ".join(words[: n % 41]) or None, "en", "s", None) for n in range(120)]
    got = {r.doc_id: r.t for r in docs(spark, rows).select("doc_id", runs.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()}
    for n, text, *_ in rows:
        h, w = zlib.crc32(str(n).encode()), (text or "").split()
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            assert got[n] == " ".join(w)
        else:
            assert got[n] == text
