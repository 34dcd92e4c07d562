"""Quality rules, line first: drop failing lines, then documents that lose too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataframe.llm.common import WORD, let, table, text_of, total

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture; a line that holds one fails.  Fixed values.
BOILERPLATE = (
    "cookie policy", "use of cookies", "uses cookies", "accept cookies", "privacy policy", "terms of use",
    "terms of service", "terms and conditions", "all rights reserved", "enable javascript", "javascript is disabled",
    "subscribe to our newsletter", "sign up for", "log in to", "click here", "read more", "share this", "lorem ipsum",
)
_PHRASES = "(?i)" + "|".join(BOILERPLATE)
#: A word that ends as a sentence does, closing quotes and brackets allowed.
_ENDED = r"""[.!?…。！？]["'”’»)\]]*(?:[\x20\x09-\x0D]|$)"""
_SEPARATOR = r"(?:^|[\x20\x09-\x0D])[|»›>•·/\\~-]+(?=[\x20\x09-\x0D]|$)"
_MARKS = r"[#*$%&|<>!?@=_~^]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside ``width``-word windows that occur twice or more in the list, the first included.

    Windows are compared by 64-bit hashes.  Lists without a repeat are told apart by a hash set; only
    the others are sorted, and the marked starts are measured as a union of intervals.
    """

    def marked(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(sorted_pairs: Column) -> Column:
            def same(j: Column, k: Column) -> Column:
                return F.coalesce(F.get(sorted_pairs, k)["h"] == F.get(sorted_pairs, j)["h"], F.lit(False))

            hit = F.transform(sorted_pairs, lambda p, j: F.when(same(j, j - 1) | same(j, j + 1), p["i"]))
            return F.array_sort(F.filter(hit, lambda i: i.isNotNull()))

        def covered(at: Column) -> Column:
            return total(F.transform(at, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - x, F.lit(width)))))

        return let(pairs, lambda p: let(starts(p), covered))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))
        full = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(marked(h)))
        return F.when(F.size(w) > width, full).otherwise(F.lit(0).cast("long"))

    return let(words, of)


def keep_line(line: Column, max_marks: float = 0.2, max_separators: float = 0.1) -> Column:
    """True for a line that passes the punctuation, navigation and boilerplate rules.

    Punctuation: a word ends a sentence, and marks (symbols, exclamation and question marks) number at
    most ``max_marks`` a word.  Navigation: separators standing alone (bars, arrows, bullets) are under
    two, or at most ``max_separators`` of the words.  Boilerplate: no phrase of page furniture.
    """

    def rules(n: Column) -> Column:
        punctuation = line.rlike(_ENDED) & ((_count(line, _MARKS) <= n * F.lit(max_marks)) | (_count(line, _MARKS) <= 2))
        return punctuation & ((_count(line, _SEPARATOR) < 2) | (_count(line, _SEPARATOR) <= n * F.lit(max_separators))) & ~line.rlike(_PHRASES)

    return let(_count(line, WORD), rules)


def line_rules(docs: DataFrame, text: str = "text", max_loss: float = 0.5, min_words: int = 10, max_repeat: float = 20) -> DataFrame:
    """Add the base counts, ``clean_text``, ``lost_chars``, ``base_failed`` and ``kept`` to ``docs``.

    Lines without a word are neither judged nor counted as lost.  ``clean_text`` holds the lines that
    pass.  A document is rejected if the failing lines hold more than ``max_loss`` of the word
    characters, or if the base rules fail: under ``min_words`` words, or more than ``max_repeat`` percent
    of the words in repeated five-word windows.  Null texts count as empty: no words, base failed.
    Repeated rows are judged one by one; all work stays in the row, so nothing is shuffled and no hot key
    matters.  Columns of the added names are replaced.
    """
    src = text_of(text)
    bare = lambda c: F.length(F.regexp_replace(c, r"[\x20\x09-\x0D]+", ""))
    worded = F.filter(F.split(src, "\n"), lambda line: line.rlike(WORD))

    def lines(ls: Column) -> Column:
        good = F.filter(ls, lambda line: keep_line(line))
        return let(
            good,
            lambda g: F.struct(
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"),
                F.array_join(g, "\n").alias("clean"),
                bare(F.array_join(g, " ")).cast("long").alias("left"),
            ),
        )

    counts = let(F.regexp_extract_all(src, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("rep")))
    return (
        docs.withColumn("_c", counts)
        .withColumn("_l", let(worded, lines))
        .withColumn("n_words", F.col("_c.n"))
        .withColumn("word_chars", bare(src).cast("long"))
        .withColumn("n_symbols", (F.length(src) - F.length(F.translate(src, SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", F.col("_l.dup"))
        .withColumn("n_repeat_words", F.col("_c.rep"))
        .withColumn("clean_text", F.col("_l.clean"))
        .withColumn("lost_chars", F.col("word_chars") - F.col("_l.left"))
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(max_loss) * F.col("word_chars")))
        .drop("_c", "_l")
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, hash(w[i:i+4]) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM g) WHERE c > 1),
m AS (SELECT r, sum(least(5, coalesce(n - i, 5))) AS rep FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS n FROM p) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
             length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
             len(regexp_extract_all(line, '[#*$%&|<>!?@=_~^]')) AS marks,
             len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: regexp_full_match(x, '[|»›>•·/\\~-]+'))) AS bars,
             regexp_matches(line, '[.!?…。！？]["''”’»)\]]*([\x20\x09-\x0D]|$)') AS ended,
             regexp_matches(line, '{_PHRASES}') AS phrase FROM l),
v AS (SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS dup,
             sum(CASE WHEN ended AND (marks <= n * 0.2 OR marks <= 2) AND (bars < 2 OR bars <= n * 0.1) AND NOT phrase THEN 0 ELSE chars END) AS lost
      FROM f GROUP BY r),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM d LEFT JOIN m USING (r) LEFT JOIN v USING (r)),
y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= 0.5 * word_chars AS kept FROM y
"""

QUERIES = {"op5_quality_rules": op5_quality_rules}
SQL = {"op5_quality_rules": OP5_SQL}
