"""Registered queries of the subpackage against their SQL, and small edge cases for each operator."""

import base64
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from comparing import assert_matches
from strataframe.llm import bpe, chat, extraction, mixing, neardup, pii, pipeline, quality, registry, topk, toxicity, warc


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert_matches(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, score string, ids string, pii string, component_id string"


def docs(spark, *texts, source="s"):
    rows = [(i, t, "en", source, None if t is None else len(t), 1, "x", "y", "z", "p", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def plain(spark, *texts):
    return docs(spark, *texts).select("doc_id", "text", "lang", "source", "n_chars")


# 1

def test_water_filling_by_hand(spark):
    s = spark.createDataFrame([("a", 100, 5.0), ("b", 300, 2.0), ("c", 600, 1.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(s).collect()}
    assert got["a"] == 300 and got["b"] == pytest.approx(700 * 2 / 3) and got["c"] == pytest.approx(700 / 3)


def test_water_filling_equals_rounds_of_resharing(spark):
    draw = random.Random(5)
    rows = [(f"s{i:02d}", draw.randrange(0, 1000), float(draw.choice([5, 2, 1]))) for i in range(30)]
    got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "source string, source_size long, weight double")).collect()}
    left, open_, want = float(sum(r[1] for r in rows)), set(range(30)), {}
    while True:
        weight = sum(rows[i][2] for i in open_)
        over = [i for i in open_ if left * rows[i][2] / weight > 3 * rows[i][1]] if open_ else []
        if not over:
            want |= {rows[i][0]: left * rows[i][2] / weight for i in open_}
            break
        for i in over:
            want[rows[i][0]] = 3.0 * rows[i][1]
        left -= sum(3.0 * rows[i][1] for i in over)
        open_ -= set(over)
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_mix_meets_targets_with_nulls_repeats_and_clashing_columns(spark):
    d = docs(spark, *[f"{'w ' * (i % 9)}" for i in range(200)], None, "").withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 3)))
    d = d.unionByName(d.limit(5))
    rows = mixing.mix(d, mixing.word_count("text")).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 1 for taken, target in by.values()) and sum(t for t, _ in by.values()) == pytest.approx(sum(r.size for r in rows), abs=3)
    whole = mixing.mix(d, mixing.word_count("text"), whole_documents=True).collect()
    assert all(r.taken == r.copies * r.size for r in whole)
    assert mixing.mix(d.limit(0), mixing.word_count("text")).count() == 0


# 2

def test_top_k_ties_unequal_lengths_and_unusable_rows(spark):
    rows = [(0, [1, 2]), (100, [3]), (1, [1, 2]), (2, [1, 2]), (3, None), (4, []), (5, [0, 0, 9]), (None, [1])]
    d = spark.createDataFrame(rows, "id long, terms array<long>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(d.where("id % 100 = 0"), d, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5), (0, 2, 2, 5), (0, 3, 100, 3), (100, 1, 0, 3), (100, 2, 1, 3), (100, 3, 2, 3)]
    assert topk.exact_top_k(d.limit(0), d.limit(0)).count() == 0


def test_top_k_by_brute_force_with_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice([7, 100, 200, rng.randrange(40)]), [rng.randrange(-3, 4) for _ in range(rng.choice([0, 2, 5]))]) for _ in range(300)]
    rows += [(9, [1, 1])] * 400
    asked = {q: min(t for i, t in rows if i == q) for q in (100, 200)}
    want = []
    for q, terms in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(terms, t)), i) for i, t in rows if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:25])]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, terms array<long>, block string")
    got = topk.exact_top_k(d.where("id % 100 = 0 AND id > 0"), d, 25)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == want


def test_non_finite_vectors_take_no_part(spark):
    d = spark.createDataFrame([(0, [0.5]), (1, [float("nan")]), (2, [float("inf")]), (3, [None]), (4, [-0.0001])], "vec_id long, embedding array<float>")
    assert {r.id: r.terms for r in topk.weights_of(d).collect()} == {0: [512], 1: None, 2: None, 3: None, 4: [-1]}


# 3

def test_codec_equals_tiktoken():
    import public_tokenizers as P
    import tiktoken

    c = bpe.codec(bpe.VOCABULARY)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.known, special_tokens={})
    draw = random.Random(9)
    texts = ["", " ", "\n\n \t x", "a" * 3000, "<|endoftext|>", "naïve 漢字 👩‍👩‍👧 \x00\x01 é", "".join(chr(draw.randrange(1, 0x2FFF)) for _ in range(2000))]
    for t in texts:
        assert c.encode(t) == want.encode_ordinary(t)
        assert c.decode(c.encode(t)) == t.encode()


def test_documents_are_encoded_whole_with_nulls(spark):
    rows = bpe.encode_documents(docs(spark, None, "", "x y" * 20000)).collect()
    assert rows[0].ids == [] and bytes(rows[2].decoded) == b"x y" * 20000
    assert bpe.digest_documents(docs(spark, None)).first().ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digest_documents(docs(spark).limit(0)).count() == 0


# 4

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><nav><a href=x>Home</a></nav></header>
<div class="cookie-notice">We use cookies</div><main><article class="post-%d"><h1>Title %d</h1><p>First &amp; <b>bold</b>   text %d.<br>more
<p>Second &lt;x&gt;</p><script>var a = "</p>";</script><div class="share">Share</div><ul><li>one<li>two</ul></article>
<section id="comments"><article class="comment"><p>Nice!</p></article></section></main><aside>Related</aside><form>Sign up<input></form><footer>(c)</footer></body></html>"""


def test_article_without_furniture(spark):
    rows = [(i, "http://h.example/%d" % i, PAGE % (i, i, i), "clash") for i in range(5)] + [(9, None, None, "clash"), (10, "no url", "", "clash"), (11, "http://x/", "<p>only", "clash"), (12, "http://h.example/", "<<<>>&&", "clash")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extraction.extract_text(d).collect()}
    for i in range(5):
        assert got[i] == f"Title {i}\nFirst & bold text {i}. more\nSecond <x>\none\ntwo"
    assert got[9] == got[10] == "" and got[11] == "only" and len(got) == 9
    assert extraction.extract_text(d.limit(0)).count() == 0


def test_wrapper_is_a_union_free_expression():
    pages = [extraction.of_page(extraction.parse(h)) for h in ("<div><h1>a</h1><p>x</p></div>", "<div><h1>b</h1><p>x</p><p>y</p><hr><ul><li>z</ul></div>")]
    assert extraction.aligned(*pages).expression() == '<#root><div><h1>#</>(<p>#</>)+(<ul><li>"z"</></>)?</></>'


def test_pages_without_article_use_the_densest_part(spark):
    html = '<body><div class="menu"><a>a</a></div><div id="c"><div class="t">Words that %s tell.</div><div class="t">More %s words.</div></div></body>'
    d = spark.createDataFrame([(i, "http://d.example/", html % (w, w)) for i, w in enumerate(("one", "two"))], "page_id long, url string, html string")
    assert {r.text for r in extraction.extract_text(d).collect()} == {"Words that one tell.\nMore one words.", "Words that two tell.\nMore two words."}


# 5

def test_repeated_words_by_brute_force(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abc") for _ in range(n)) for n in (0, 1, 4, 5, 6, 7, 12, 40, 300)] + [None, "a b c d e\n" * 3, "x " * 5000]

    def want(t):
        w = (t or "").split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        return len({i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}) if len(grams) < 400 else len(w)

    rows = quality.line_rules(docs(spark, *texts)).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in rows] == [want(t) for t in texts]
    assert rows[0].base_failed and not rows[0].kept


def test_line_rules_drop_lines_then_documents(spark):
    good = "This is a line of plain prose that ends well. Another sentence follows it here, and it is quite long too."
    rows = quality.line_rules(docs(spark, good + "\nHome | About | Contact | More\n", "Home | About | News | Jobs | More | Less | In | Out | Up | Down", good.strip() + "\nWe value your data, see our Privacy Policy.")).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, False, True]
    assert "About" not in rows[0].clean_text and "Privacy" not in rows[2].clean_text
    assert quality.line_rules(docs(spark).limit(0)).count() == 0


# 6

def test_archives_round_trip_with_revisits(spark, tmp_path):
    rows = [(1, "http://a", "same"), (5, "http://b", "same"), (5, "http://b", "same"), (3, None, None), (4, "x", ""), (7, "u", "é" * 70000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_records(pages), path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == 6 and {(r.record_id, r.record_type, r.refers_to) for r in got} == {("urn:page:1", "revisit", "urn:page:5"), ("urn:page:5", "response", None), ("urn:page:3", "revisit", "urn:page:4"), ("urn:page:4", "response", None), ("urn:page:7", "response", None)}
    assert {bytes(r.payload) for r in got if r.payload is not None} == {b"same", b"", "é".encode() * 70000}
    digest = base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert {r.payload_digest for r in got if r.record_id in ("urn:page:1", "urn:page:5")} == {digest}
    assert warc.read_warc(spark, path).where("record_type = 'revisit'").count() == 2
    assert warc.read_warc(spark, path, ("revisit",), payload=False).where("payload IS NULL").count() == 2
    small = warc.plan_records(pages, least_bytes=5)
    assert small.where("record_type = 'revisit'").count() == 0
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_null_page_ids_come_back_as_null(spark, tmp_path):
    rows = [(None, "u", "same"), (-1, "v", "same"), (None, "w", "alone"), (None, None, "alone")]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.op6_warc(spark, folder).collect()]
    assert sorted(got, key=str) == [(-1, "response", None), (None, "response", None), (None, "response", None), (None, "revisit", -1)]


def test_long_payloads_are_read_in_proportion(spark, tmp_path):
    page = spark.range(1).select(F.lit(1).cast("long").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789abcdef"), 1 << 22).alias("html"))
    path = str(tmp_path / "w")
    warc.write_warc(warc.plan_records(page), path)
    got = warc.read_warc(spark, path).select(F.length("payload").alias("n"), F.sha1("payload").alias("h")).first()
    assert tuple(got) == (1 << 26, hashlib.sha1(b"0123456789abcdef" * (1 << 22)).hexdigest())


def test_plain_archives_are_read(spark, tmp_path):
    from types import SimpleNamespace as N

    row = N(payload=b"abc", record_type="response", record_id="urn:x", date="2024-01-01T00:00:00Z", target_uri="http://a", payload_digest=None, payload_bytes=None, refers_to=None)
    (tmp_path / "p.warc").write_bytes(warc.record(row) * 3)
    assert [bytes(r.payload) for r in warc.read_warc(spark, str(tmp_path)).collect()] == [b"abc"] * 3


# 7

def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold a handful of toxic held-out rows
    scored = toxicity.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    clean = [r for r in scored if r.toxic == 0]
    assert np.mean([r.predicted == 0 for r in clean]) > 0.9
    caught = [r.predicted == 1 for r in scored if r.toxic == 1]
    print("caught", sum(caught), "of", len(caught), "flagged", sum(r.predicted for r in clean), "of", len(clean))
    assert caught and np.mean(caught) >= 0.8, f"{sum(caught)} of {len(caught)}"


def test_scores_do_not_depend_on_steps_and_empty_texts(spark):
    rng = np.random.default_rng(0)
    texts = [np.array([toxicity.features(w) for w in rng.choice(["bad", "good", "fine", "day"], 12)], np.int32) for _ in range(60)]
    labels = np.array([int(any((t == toxicity.features("bad")).all(axis=1))) for t in texts])
    model = toxicity.fit(texts, labels, ["en"] * 60)
    long = "good day " * 20000
    d = docs(spark, None, "", long, long + " bad day", "bad")
    whole = [r.score for r in toxicity.score_toxicity(d, model).orderBy("doc_id").collect()]
    assert whole[0] == whole[1] and all(0 <= s <= 1 for s in whole)
    words = toxicity._tokens(long)
    rows = model.table[np.array([toxicity.features(w) for w in words])].sum(axis=1) @ model.projection()
    assert model.score(model.logit(model.pooled(rows)), toxicity.language(toxicity.votes(words).sum(axis=0), len(words))) == pytest.approx(whole[2])


def test_scores_by_a_plain_convolution(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["bad", "worse", "good", "fine", "day", "it", "is"]
    said = [list(rng.choice(vocabulary, rng.integers(1, 15))) for _ in range(80)]
    labels = np.array([int("bad" in w) for w in said])
    model = toxicity.fit([np.array([toxicity.features(x) for x in w], np.int32) for w in said], labels, ["en"] * 80)

    def plain_score(text):
        words = toxicity._tokens(text.lower())
        rows = [sum(model.table[f] for f in toxicity.features(w)) for w in words]
        logit = model.shift
        for b, kernel in enumerate(model.kernels):
            edge = [np.zeros(toxicity.DIM, np.float32)] * (len(kernel) - 1)
            padded = [*edge, *rows, *edge]
            for f in range(toxicity.FILTERS):
                windows = [sum(float(padded[i + j] @ kernel[j][:, f]) for j in range(len(kernel))) for i in range(len(padded) - len(kernel) + 1)]
                at = b * toxicity.FILTERS + f
                logit += max(0.0, (max(windows) if rows else 0.0) + model.bias[at]) * model.out[at]
        spoken = toxicity.language(toxicity.votes(words).sum(axis=0), len(words)) if words else ""
        return 1 / (1 + np.exp(-(logit - model.thresholds.get(spoken, model.thresholds[""]))))

    texts = ["bad", "it is a good day", "Good day, BAD day!", "is it worse " * 9, "unknown words only"]
    got = [r.score for r in toxicity.score_toxicity(docs(spark, *texts), model).orderBy("doc_id").collect()]
    assert got == pytest.approx([plain_score(t) for t in texts], abs=1e-4)


def test_one_class_scores_the_prior():
    model = toxicity.fit([np.zeros((2, toxicity.FEATURES), np.int32)], np.array([0]), ["en"])
    assert model.score(0.0, "en") < 0.5
    assert toxicity.fit([np.zeros((2, toxicity.FEATURES), np.int32)], np.array([1]), ["en"]).score(0.0, "en") > 0.5
    assert toxicity.fit([], np.array([]), []).score(0.0, "xx") < 0.5


# 8

def brute_components(texts, width, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return label, [len(s) for s in sets]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_by_brute_force(spark, width):
    draw = random.Random(width)
    base = [" ".join(draw.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(draw.randrange(50)) for _ in range(60)) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(14):
            w = b.split()
            for _ in range(draw.randrange(0, 4)):
                w[draw.randrange(len(w))] = "new" + str(draw.randrange(9))
            texts.append(" ".join(w))
    texts += [None, "", "  \n", "one", "One", "one two", "a  b\tC", "A b c"] + texts[:3]
    got = neardup.near_duplicates(docs(spark, *texts), width=width).orderBy("doc_id").collect()
    label, sizes = brute_components(texts, width)
    assert [r.component_id for r in got] == label and [r.n_shingles for r in got] == sizes
    assert [r.kept for r in got] == [i == c for i, c in enumerate(label)]


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert neardup.near_duplicates(docs(spark).limit(0)).count() == 0
    d = docs(spark, "a b c", "a b c").withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(d, width=2).collect()} == {(None, None, True), (1, 1, True)}


def planted_pairs(width, changes, count, seed):
    """Pairs of texts of 180 shingles, ``m`` words apart from each other replaced: (180 - width m) / (180 + width m) alike."""
    draw, words = random.Random(seed), 179 + width
    for m in changes:
        for _ in range(count):
            a = [f"w{draw.randrange(10**9)}" for _ in range(words)]
            b = list(a)
            for place in draw.sample(range(width - 1, words - width + 1, width), m):
                b[place] = f"n{draw.randrange(10**9)}"
            yield m, " ".join(a), " ".join(b)


def recall_by_similarity(spark, width, changes, count, seed=0):
    pairs = list(planted_pairs(width, changes, count, seed))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, *[t for _, a, b in pairs for t in (a, b)]), width=width).collect()}
    found = {m: [got[2 * i] == got[2 * i + 1] for i, p in enumerate(pairs) if p[0] == m] for m in changes}
    return {round((180 - width * m) / (180 + width * m), 3): sum(f) / len(f) for m, f in found.items()}


@pytest.mark.parametrize(("width", "changes"), [(2, (10, 8, 5, 2)), (5, (4, 3, 2, 1))])
def test_recall_at_every_similarity(spark, width, changes):
    recall = recall_by_similarity(spark, width, changes, 100)
    assert min(recall) == 0.8 and min(recall.values()) >= 0.99


# 9

def test_chat_reads_back_whatever_is_in_it(spark):
    nasty = ["<|assistant|>", "|>\n", "\\", "\\<|x|>", "<", "|", "<|/user|>\n", "", None, "a\nb", r"\### Assistant: </turn> ok"]
    rows = [(1, i, role, t, "extra") for i, (role, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "assistant", "+x", "/<", None))]
    rows += [(2, None, "user", "n", "extra"), (None, 1, "assistant", "z", "extra"), (2, 0, "user", "n", "extra"), (2, 0, "user", "n", "extra")]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "segments", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [(r[2] or "", r[3] or "") for r in rows if r[0] == 1]
    assert got[1].loss == "".join(r[3] or "" for r in rows if r[0] == 1 and r[2] == "assistant")
    assert "".join(s.text for s in got[1].segments) == got[1].formatted and len(got[2].t) == 3 and got[None].loss == "z"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_conversations_of_very_many_turns_are_merged_in_proportion(spark):
    n = 50_000
    rows = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 < 2, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text")
    )
    began = time.monotonic()
    out = chat.format_chats(rows).select(chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss"), "formatted").collect()[0]
    assert time.monotonic() - began < 60
    assert [(t.role, t.text) for t in out.t] == [("user" if i % 3 < 2 else "assistant", str(i)) for i in range(n)]
    assert out.loss == "".join(str(i) for i in range(2, n, 3))
    assert out.formatted.count("<|user:|>") == (n + 2) // 3 and out.formatted.count("<|+user:|>") == (n + 1) // 3


# 10

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        value = [int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(value) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_base_spans_equal_a_plain_search(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choice("01234.5 -+@ab()%é😀.@") for _ in range(draw.randrange(0, 200))) for _ in range(300)] + [None, "", "a" * 50000 + "@b.c", "1" * 50000, "4111 1111-1111 1111 x 1.2.3.4.5.6.7.8 a@b.c_d@e.f"]
    got = pii.find_pii(docs(spark, *texts).drop("pii")).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        want = [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, t or "") if passes(k, m[0])]
        assert [(s.kind, s.start, s.end) for s in r.pii if s.base] == want, (t or "")[:200]


def test_checksums_context_and_redaction(spark):
    texts = ["my iban is DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 01", "call 212-555-0100 now", "id 212-555-0100 x", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "ssn 123-45-6789", None]
    rows = pii.redact(pii.find_pii(docs(spark, *texts).drop("pii"))).orderBy("doc_id").collect()
    assert [[s.kind for s in r.pii] for r in rows] == [["iban"], [], ["local_phone"], [], ["secret"], ["ssn"], []]
    assert rows[0].text == "my iban is [IBAN]." and rows[2].text == "call [LOCAL_PHONE] now" and rows[6].text is None


ADDED = [  # the added kinds by a plain search; the gains of context words do not matter to what is found here
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("local_phone", r"(?<![0-9+)(])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"),
    ("secret", None),
]


def plain_secrets(text):
    """Runs of 20 or more of the alphabets of base64, with what padding follows them, unless more text or padding does."""
    for m in re.finditer("[A-Za-z0-9_+/-]+", text):
        end = m.end()
        while text[end : end + 1] == "=":
            end += 1
        if len(m[0]) >= 20 and end - m.end() <= 2 and not re.match("[A-Za-z0-9_+/-]", text[end : end + 1]):
            yield m.start(), end


def _added(text, base):
    """Added spans of a text by rule: validator, score with the context within 40 code points, clear of base spans."""
    out = []
    for kind, pattern in ADDED:
        _, _, _, _, score, gain = next(k for k in pii.ADDED if k[0] == kind)
        for start, end in [m.span() for m in re.finditer(pattern, text)] if pattern else plain_secrets(text):
            near = (text[max(0, start - 40) : start] + " " + text[end : end + 40]).lower()
            points = score + gain * bool(re.search(rf"(?<![a-zà-ÿ])(?:{pii.CONTEXT[kind]})", near))
            found = text[start:end]
            plain = found.replace(" ", "")
            ok = kind in ("ssn", "local_phone")
            ok |= kind == "iban" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
            ok |= kind == "secret" and bool(re.search("[A-Za-z]", found)) and len(re.findall("[0-9]", found)) >= 3
            if ok and points >= 0.5 and not any(s < end and start < e for _, s, e in base):
                out.append((kind, start, end))
    return out


def test_added_spans_and_redaction_by_brute_force(spark):
    draw = random.Random(11)
    bits = ["password ", "token: ", "a1b2" * 6, "x9" * 200, "dGhpc2lzMTIzNDU2Nzg5MA==", "QWxhZGRpbjpvcGVuIHNlc2FtZTEyMw=", "=", "call ", "212-555-0100", "ssn ", "123-45-6789", "me@host.org", "10.0.0.1", "iban ", "DE89 3704 0044 0532 0130 00", " ", "\n", "é😀 ", "words here ", "4111 1111 1111 1111", "+1 212 555 0100 99"]
    texts = ["".join(draw.choice(bits) for _ in range(n)) for n in (3, 10, 40, 90, 300, 1000) for _ in range(6)]
    rows = pii.redact(pii.find_pii(docs(spark, *texts).drop("pii"))).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        spans = [(s.kind, s.start, s.end) for s in r.pii]
        base = [(s.kind, s.start, s.end) for s in r.pii if s.base]
        assert spans == base + _added(t, base)
        out, at = "", 0
        for start, end, kind in sorted((s, e, k) for k, s, e in spans):
            if start >= at:
                out += t[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert r.text == out + t[at:]


def test_secrets_of_any_length_and_very_many_spans(spark):
    import time

    secret = "token " + "a1b2c3d4" * 60
    many = "mail me@host.org or call 212-555-0100, " * 100_000
    began = time.time()
    rows = pii.redact(pii.find_pii(docs(spark, secret, many).drop("pii"))).orderBy("doc_id").collect()
    assert rows[0].text == "token [SECRET]" and len(rows[1].pii) == 200_000
    assert rows[1].text == "mail [EMAIL] or call [LOCAL_PHONE], " * 100_000
    assert time.time() - began < 120


# pipeline

def test_stages_keep_the_columns_and_do_their_work(spark, sf_dir):
    d = plain(spark, "Mail me at a@b.co today, please do it.", "Mail me at a@b.co today, please do it.", "Other words stand here for once.", None, "")
    d = d.unionByName(d.limit(1))
    stages = dict(pipeline.STAGES)
    kept = stages["near_duplicates"](spark, d, sf_dir)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    masked = {r.doc_id: r for r in stages["personal_data"](spark, kept, sf_dir).collect()}
    assert masked[0].text == "Mail me at [EMAIL] today, please do it." and masked[0].n_chars == len(masked[0].text)
    mixed = stages["mixing"](spark, kept, sf_dir)
    assert mixed.columns == d.columns and {r.doc_id for r in mixed.collect()} <= {0, 2, 3, 4}
    assert all(r.round_trip for r in stages["byte_bpe"](spark, d, sf_dir).collect())


def run_pipeline(spark, tmp_path, d, labels):
    folder = str(tmp_path / "tables")
    d.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return pipeline.run(spark, folder)


def test_pipeline_without_labels_keeps_clean_rows(spark, tmp_path):
    d = plain(spark, None, "", "Some plain words stand here for once.", "Quite other words are told in this text.")
    d = d.unionByName(d.where("doc_id = 2"))
    out = run_pipeline(spark, tmp_path, d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.doc_id for r in out.collect()} >= {2, 3} and out.where("NOT round_trip").count() == 0


def test_pipeline_of_nothing_and_of_null_sources(spark, tmp_path):
    labels = spark.createDataFrame([(2, 0)], "doc_id long, toxic int")
    d = plain(spark, None, "", "Some plain words stand here for once.").withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id for r in run_pipeline(spark, tmp_path / "a", d, labels).collect()} >= {2}
    assert run_pipeline(spark, tmp_path / "b", d.limit(0), labels.limit(0)).count() == 0


def test_toxic_rows_go_and_all_others_stay(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = dict(pipeline.STAGES)["toxicity"](spark, d, sf_dir)
    model = toxicity.train(d, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    gone = {r.doc_id for r in toxicity.score_toxicity(d, model).where("predicted = 1").collect()}
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == sorted({r.doc_id for r in d.collect()} - gone)


def test_pipeline_runs(spark, sf_dir):
    out = registry.queries()["pipeline"](spark, sf_dir)
    assert out.count() > 0 and out.where("NOT round_trip").count() == 0


def test_varying_containers_of_a_host_are_all_found(spark):
    slug = "<html><body><header>Site head</header><article id='%s-story'><p>Told by %s in %s.</p></article><div class=r>Rest %s</div></body></html>"
    kinds = "<html><body><header>Site head</header><div class=x><article class='k-%s'><p>Text of %s alone.</p></article></div><p>Tail %s</p></body></html>"
    names = [a + b for a in "abcdefgh" for b in "uvwxyz"]
    rows = [(i, "http://slug.example/", slug % (n, n, n, n)) for i, n in enumerate(names)] + [(100 + i, "http://kinds.example/", kinds % (n, n, n)) for i, n in enumerate(names)]
    got = {r.page_id: r.text for r in extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Told by {n} in {n}." for i, n in enumerate(names)} | {100 + i: f"Text of {n} alone." for i, n in enumerate(names)}


def test_containers_that_the_wrapper_lacks_and_page_headers():
    page = extraction.parse("<body><header>Site head</header><article class=q><p>Own text.</p></article><p>Tail</p></body>")
    assert extraction.main_text(page, [["body", "article.a"], ["body"]]) == "Own text."
    page = extraction.parse("<body><header>Site head</header><p>Plain text.</p></body>")
    assert extraction.main_text(page, [["body", "article.a"], ["body"]]) == "Plain text."


def test_long_pages_keep_their_wrapper():
    html = "<body><article>" + "".join(f"<div class=a{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}><p>w{i}</p></div>" for i in range(900)) + "</article></body>"
    one, two, three = (extraction.of_page(extraction.parse(h)) for h in (html, html, "<body><p>Short</p></body>"))
    both = extraction.pruned(extraction.aligned(one, two))
    assert len(both.kids[0].kids[0].kids) == 900
    mixed = extraction.pruned(extraction.aligned(both, three))
    assert ["body", "article"] in extraction.rules(mixed)


def test_boxes_that_a_host_repeats_are_left_out(spark):
    start = "The same long beginning of every story, " * 8
    html = "<html><body><div class='content'><h1>On %s</h1><div class='by-house'>Written by the house.</div><section><p>%s ends with %s.</p></section><div class='fine'>All prices are net.</div></div></body></html>"
    rows = [(i, "http://c.example/", html % (w, start, w)) for i, w in enumerate("one two three four".split())]
    rows += [(10 + i, "http://same.example/", html % ("this", start, "this")) for i in range(4)]
    got = {r.page_id: r.text for r in extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, w in enumerate("one two three four".split()):
        assert got[i] == f"On {w}\n{start}ends with {w}."
    assert got[10] == f"On this\nWritten by the house.\n{start}ends with this.\nAll prices are net."


def texts_of(spark, pages):
    d = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in extraction.extract_text(d).orderBy("page_id").collect()]


def test_a_page_gives_the_same_article_alone_or_among_others(spark):
    html = (
        "<body><nav>Home</nav><div class=cookie-bar>We use cookies</div><article><h1>%s pie</h1><h2>Ingredients</h2><ul><li>salt</li><li>%s</li></ul>"
        "<div class=fine>All prices are net.</div><h2>Method</h2><ol><li>Stir.</li><li>Bake the %s.</li></ol></article><footer>(c)</footer></body>"
    )
    pages = [("http://pies.example/", html % (w, w, w)) for w in "apple pear plum quince cherry berry".split()]
    want = [f"{w} pie\nIngredients\nsalt\n{w}\nAll prices are net.\nMethod\nStir.\nBake the {w}." for w in "apple pear plum quince cherry berry".split()]
    assert texts_of(spark, pages) == want
    assert texts_of(spark, [(f"http://h{i}.example/", h) for i, (_, h) in enumerate(pages)]) == want


def test_class_words_inside_an_article(spark):
    body = (
        "<article><h1>Paper %s</h1><section class=related-work><p>Others did %s.</p></section><section class=alert-levels><p>Three levels.</p></section>"
        "<div class=share-buttons>Share</div><div class='newsletter signup-form'>Sign up</div><div class=related-posts><a href=x>More</a></div>"
        "<div class=tags-of-day><a href=x>one</a> <a href=y>two</a></div><div class=comment-list><p>Nice!</p></div><aside>Box</aside><p>End %s.</p></article>"
    )
    got = texts_of(spark, [("http://p.example/", "<body>" + body % (i, i, i) + "</body>") for i in range(4)])
    assert got == [f"Paper {i}\nOthers did {i}.\nThree levels.\nEnd {i}." for i in range(4)]


def plain_matches(left, right):
    """Pairs of unmatched elements that are one container: each takes the first of its like behind the last one."""
    def alike(a, b):
        tag, *words = a.key.split(".")
        other, *others = b.key.split(".")
        shared = {p for w in set(words) & set(others) for p in re.split("[^a-z0-9]+", w)}
        return not a.furniture and not b.furniture and tag == other and (tag in ("article", "main") or bool(shared & extraction.MAIN))

    out, at = [], 0
    for i, p in enumerate(left):
        k = next((k for k in range(at, len(right)) if alike(p, right[k])), None)
        if k is not None:
            out.append((i, k))
            at = k + 1
    return out


def test_containers_under_other_names_by_brute_force():
    draw = random.Random(9)
    for _ in range(300):
        sides = []
        for side in "ab":
            kinds = [draw.choice(["div.post", "div.x", "section.story.u", "article", "div.main-content", "p", "div.body.text"]) for _ in range(draw.randrange(8))]
            sides.append([extraction.Part(f"{k}.{side}{i}", draw.random() < 0.1) for i, k in enumerate(kinds)])
        # own names keep the keys apart, so all that is aligned is told by likeness
        whole = []
        for kids in sides:
            root = extraction.Part("div", False)
            root.kids = kids
            whole.append(root)
        want = len(sides[0]) + len(sides[1]) - len(plain_matches(*sides))
        before = extraction.folded
        try:
            extraction.folded = lambda parts: parts
            assert len(extraction.aligned(*whole).kids) == want
        finally:
            extraction.folded = before


def test_very_many_unlike_siblings_are_aligned_within_seconds():
    sides = []
    for side in "ab":
        root = extraction.Part("div", False)
        root.kids = [extraction.Part(f"{('div.post', 'p', 'li.x')[i % 3]}.{side}{i}", False) for i in range(20_000)]
        sides.append(root)
    began = time.monotonic()
    extraction.aligned(*sides)
    assert time.monotonic() - began < 20


def test_constant_text_gives_a_container_no_weight():
    html = "<body><article class=notice-text>%s</article><article class=b>Short %s.</article></body>"
    root = None
    for w in "abc":
        page = extraction.of_page(extraction.parse(html.replace("notice-text", "legal") % ("Terms and conditions of use. " * 9, w)))
        root = page if root is None else extraction.aligned(root, page)
    assert extraction.rules(root)[0] == ["body", "article.b"]


def test_a_copy_does_not_take_another_document_of_its_id(spark, sf_dir):
    d = plain(spark, "Some words that stand here in the first text.", "Some words that stand here in the first text.", "Quite other words are told in this second text.")
    d = d.withColumn("doc_id", F.when(F.col("doc_id") == 2, F.lit(1)).otherwise(F.col("doc_id")).cast(d.schema["doc_id"].dataType)).unionByName(d.where("doc_id IS NULL"))
    kept = dict(pipeline.STAGES)["near_duplicates"](spark, d, sf_dir)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text[:5]) for r in kept.collect()) == [(0, "Some "), (1, "Quite")]


def test_articles_stay_whatever_the_words_around_them_say(spark):
    words = "The harbour was quiet that morning and the boats lay still. "
    body = f"<nav>Home</nav><article><h1>Title</h1><p>{words * 4}</p></article><div class=comments><article class=comment><p>Nice one.</p></article></div>"
    pages = [
        (1, "http://a.org/1", f'<body><div class="content with-sidebar">{body}</div></body>'),
        (2, "http://b.org/1", f'<body class="post has-newsletter">{body}</body>'),
        (3, "http://c.org/1", f"<body><div class=post><p>{words * 4}</p></div><div class=comments><article class=comment><p>Nice one.</p></article></div></body>"),
    ]
    got = {r.page_id: r.text for r in extraction.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "Title\n" + (words * 4).strip() and got[3] == (words * 4).strip()


def test_deep_and_broken_pages_are_read_in_proportion(spark):
    import time

    deep = "<div>" * 5000 + "<p>Deep text stands here.</p><nav>Menu</nav><p>More of it.</p>" + "</div>" * 5000
    began = time.time()
    pages = [(1, "http://a.org/1", deep), (2, "http://b.org/1", "<p>Some words.</p>" + "<a " * 350_000), (3, "http://c.org/1", "<p>Said.</p>" + "<li" * 300_000 + "<!-- " * 9)]
    pages += [(4, "http://d.org/1", "<p>One.</p>" + "<b><i><div>" * 60_000), (5, "http://e.org/1", "<p>Kept.</p><script>var a = 1 > 0; var b = '<p>no</p>'")]
    got = {r.page_id: r.text for r in extraction.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == "Deep text stands here.\nMore of it." and got[2].startswith("Some words.") and got[3].startswith("Said.")
    assert got[4] == "One." and got[5] == "Kept."
    assert time.time() - began < 90


def test_pages_of_very_many_elements_are_aligned_in_proportion(monkeypatch):
    rng = random.Random(6)
    names = ["h2", "p", "ul", "pre", "table"]
    pages = []
    for _ in range(2):
        order = [names[i % 5] for i in range(12_000)]
        for at in sorted(rng.sample(range(len(order)), 40), reverse=True):
            del order[at]
        pages.append([extraction.Part(tag, False) for tag in order])
    matched = extraction._matches(*pages)
    assert all(pages[0][p].key == pages[1][q].key for p, q in matched)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(matched, matched[1:]))
    assert len(matched) > 11_500
    short = [[extraction.Part(rng.choice(names), False) for _ in range(30)] for _ in range(2)]
    whole = len(extraction._matches(*short))
    monkeypatch.setattr(extraction, "TABLE_CELLS", 1)
    assert 0 < len(extraction._matches(*short)) <= whole
