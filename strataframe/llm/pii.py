"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataframe.llm.common import let, table, text_of, total

# The patterns find what a plain leftmost greedy search finds.  A match can begin only where a run of
# its first class begins, or where the last match ended (\G); runs that cannot give anything back are
# possessive.  So a long run is read once instead of once from each of its characters.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+)(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_])[A-Za-z0-9_+/-]{20,}+={0,2}+(?![A-Za-z0-9_+/=-])"

#: Words that raise the score of a span within WINDOW code points.  Fixed values.
CONTEXT = {
    "email": "mail|contact|write|correo|courriel|kontakt",
    "ip": "ip|host|server|address|login|client",
    "card": "card|visa|mastercard|amex|credit|debit|payment|tarjeta|carte|karte",
    "phone": "phone|call|tel|mobile|cell|fax|telefon|teléfono|téléphone",
    "iban": "iban|account|bank|transfer|konto|cuenta|compte",
    "ssn": "ssn|social|security|taxpayer",
    "local_phone": "phone|call|tel|mobile|cell|fax|telefon|teléfono|téléphone",
    "secret": "token|secret|password|passwd|api.?key|apikey|credential|bearer",
}
WINDOW = 40


#: Code points in a piece of a long text: what lies far inside it is read from its piece, not from the beginning.
PIECE = 512


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` has gathered before each element of an array of integers.

    The array is worked on in blocks of about its root, so no list is copied once an element.
    """

    def of_block(block: Column, first: Column) -> Column:
        def add(acc: Column, v: Column) -> Column:
            return F.struct(F.concat(acc["done"], F.array(acc["at"])).alias("done"), step(acc["at"], v).alias("at"))

        empty = F.struct(F.expr("cast(array() as array<int>)").alias("done"), first.alias("at"))
        return F.aggregate(block, empty, add, lambda acc: acc["done"])

    def blocked(vs: Column, size: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / size).cast("int")), lambda k: F.slice(vs, k * size + 1, size))

        def placed(blocks: Column) -> Column:
            sums = F.transform(blocks, lambda b: F.aggregate(b, start, step))
            return let(of_block(sums, start), lambda firsts: F.flatten(F.transform(blocks, lambda b, k: of_block(b, F.get(firsts, k)))))

        return let(whole, placed)

    size = lambda vs: F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(vs))).cast("int"))
    return let(values, lambda vs: F.when(F.size(vs) <= 64, of_block(vs, start)).otherwise(let(size(vs), lambda n: blocked(vs, n))))


def pieces(text: Column) -> Column:
    """A text cut into pieces of ``PIECE`` code points."""
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The text from code point ``start`` to ``end``, exclusive, of a text in pieces; both lie inside it."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(F.greatest(end - 1, start) / PIECE).cast("int")
    two = F.concat(F.get(cut, first), F.when(last > first, F.get(cut, last)).otherwise(F.lit("")))
    joined = F.when(last - first <= 1, two).otherwise(F.array_join(F.slice(cut, first + 1, last - first + 1), ""))
    return F.when(end > start, F.substring(joined, start - first * PIECE + 1, end - start)).otherwise(F.lit(""))


def located(matches: Column, gaps: Column) -> Column:
    """Matches as ``array<struct<start, end, found>>`` in code points, end exclusive.

    The gaps that ``split`` leaves and the matches alternate, so running sums of their lengths are the
    positions.
    """
    moved = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

    def span(before: Column, i: Column) -> Column:
        start = before + F.length(F.get(gaps, i))
        return F.struct(start.alias("start"), (start + F.length(F.get(matches, i))).alias("end"), F.get(matches, i).alias("found"))

    return F.transform(running(moved, F.lit(0), lambda at, n: at + n), span)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start: int, end: int, found: string>>)")


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn check over a string of digits."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.when(n > 0, total(F.transform(F.sequence(F.lit(1), n), value)) % 10 == 0).otherwise(F.lit(False))


def mod97(found: Column) -> Column:
    """The mod-97 check of an account number: the first four characters go last, letters count from 10."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        a = F.ascii(c)
        return F.when(a < 58, (acc * 10 + a - 48) % 97).otherwise((acc * 100 + a - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


def _part(found: Column, i: int) -> Column:
    return F.regexp_replace(F.split_part(found, F.lit("."), F.lit(i)), "^0+(?=[0-9])", "")


def _ip_ok(found: Column) -> Column:
    ok = F.lit(True)
    for i in range(1, 5):
        part = _part(found, i)
        ok = ok & F.when(F.length(part) > 3, F.lit(False)).otherwise(F.substring(part, 1, 3).cast("int") <= 255)
    return ok


def _card_ok(found: Column) -> Column:
    return let(_digits(found), lambda d: F.length(d).between(13, 19) & luhn(d))


def _mixed(found: Column) -> Column:
    """Long mixed strings only: a letter and three digits or more."""
    return found.rlike("[A-Za-z]") & (F.length(_digits(found)) >= 3)


#: kind, a cheap test of the whole text, pattern, validator, score when valid, gain from context; base kinds first, in their listed order.
_always = lambda found: F.lit(True)
_has = lambda sign: lambda text: F.contains(text, F.lit(sign))
_has_digit = lambda text: text.rlike("[0-9]")
BASE: tuple[tuple[str, Callable, str, Callable, float, float], ...] = (
    ("email", _has("@"), EMAIL, _always, 0.9, 0.1),
    ("ip", lambda t: F.contains(t, F.lit(".")) & _has_digit(t), IP, _ip_ok, 0.6, 0.3),
    ("card", _has_digit, CARD, _card_ok, 0.8, 0.2),
    ("phone", _has("+"), PHONE, lambda m: F.length(_digits(m)).between(9, 15), 0.7, 0.2),
)
ADDED = (
    ("iban", _has_digit, IBAN, mod97, 0.8, 0.2),
    ("ssn", _has("-"), SSN, _always, 0.3, 0.4),
    ("local_phone", lambda t: t.rlike("[0-9][-.][0-9]"), LOCAL_PHONE, _always, 0.4, 0.3),
    ("secret", _has_digit, SECRET, _mixed, 0.3, 0.5),
)


def _near(cut: Column, length: Column, span: Column) -> Column:
    """Whether a context word of the span's kind stands near it."""
    before = between(cut, F.greatest(span["start"] - WINDOW, F.lit(0)), span["start"])
    after = between(cut, span["end"], F.least(span["end"] + WINDOW, length))

    def told(words: Column) -> Column:
        out = F.lit(False)
        for kind, listed in CONTEXT.items():
            out = F.when(span["kind"] == kind, words.rlike(rf"(?<![a-zà-ÿ])(?:{listed})")).otherwise(out)
        return out

    return let(F.lower(F.concat(before, F.lit(" "), after)), told)


_SPAN = "struct<kind: string, start: int, end: int, score: double, base: boolean>"


def _clear_of(base: Column, added: Column) -> Column:
    """The spans of ``added`` that overlap none of ``base``: one sweep over both in order of their starts."""
    spans = F.sort_array(F.concat(*[F.transform(side, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("s"))) for side in (base, added)]))
    far = F.lit((1 << 31) - 1)

    def swept(all_: Column) -> Column:
        ends = F.transform(all_, lambda e: F.when(e["s"]["base"], e["end"]).otherwise(0))
        starts = F.reverse(F.transform(all_, lambda e: F.when(e["s"]["base"], e["start"]).otherwise(far)))
        reached = running(ends, F.lit(0), lambda at, v: F.greatest(at, v))
        ahead = F.reverse(running(starts, far, lambda at, v: F.least(at, v)))
        free = lambda r, n: F.filter(all_, lambda e, i: ~e["s"]["base"] & (F.get(r, i) <= e["start"]) & (F.get(n, i) >= e["end"]))
        kept = let(reached, lambda r: let(ahead, lambda n: free(r, n)))
        return let(F.transform(kept, lambda e: e["s"]), by_kind)

    def by_kind(spans: Column) -> Column:
        return F.concat(*[F.filter(spans, lambda s: s["kind"] == k[0]) for k in ADDED])  # noqa: B023

    return let(spans, swept)


def find_pii(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``pii``, an ``array<struct<kind, start, end, score, base>>``, to ``docs``.

    Base kinds (email, ip, card, phone) are kept whenever their validator passes; spans that fail it are
    dropped and not retried.  Added kinds (iban by mod-97, ssn, local_phone, secret) are kept if their
    score, raised by a context word within ``WINDOW`` code points on either side, reaches
    ``threshold``.  An added span that overlaps a base span of the same text is left out.  Spans are
    ordered by kind as listed, then start.  Null and empty texts give an empty list; repeated rows are
    searched one by one; very long texts and texts of very many spans take time in proportion (running sums
    in blocks, windows from pieces); nothing is shuffled.  A clashing column ``pii`` is replaced.
    """
    src, kinds = text_of(text), [*BASE, *ADDED]
    none, no_texts = F.expr(f"cast(array() as array<{_SPAN}>)"), F.expr("cast(array() as array<string>)")

    def proposed(test: Callable, pattern: str) -> Column:
        found = F.when(test(src), F.regexp_extract_all(src, F.lit(pattern), F.lit(0))).otherwise(no_texts)
        gaps = lambda ms: F.when(F.size(ms) > 0, F.split(src, pattern)).otherwise(no_texts)
        return let(found, lambda ms: F.struct(ms.alias("ms"), gaps(ms).alias("gaps")))

    def of_kind(hits: Column, kind: str, valid: Callable, score: float, base: bool) -> Column:
        named = [F.lit(kind).alias("kind"), F.lit(score).alias("score"), F.lit(base).alias("base")]
        span = lambda s: F.struct(named[0], s["start"].alias("start"), s["end"].alias("end"), *named[1:])
        return F.transform(F.filter(hits, lambda s: valid(s["found"])), span)

    def confirmed(places: Column) -> Column:
        """Valid spans of all kinds, scored by kind alone."""
        out = [of_kind(F.get(places, F.lit(i)), k[0], k[3], k[4], i < len(BASE)) for i, k in enumerate(kinds)]
        return F.concat(*out)

    def scored(spans: Column, cut: Column, size: Column) -> Column:
        def mark(s: Column) -> Column:
            gain = F.lit(0.0)
            for kind, *_, more in kinds:
                gain = F.when(s["kind"] == kind, F.lit(more)).otherwise(gain)
            score = s["score"] + F.when(_near(cut, size, s), gain).otherwise(F.lit(0.0))
            return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"), s["base"].alias("base"))

        return F.filter(F.transform(spans, mark), lambda s: s["base"] | (s["score"] >= threshold))

    def merged(spans: Column) -> Column:
        base, added = F.filter(spans, lambda s: s["base"]), F.filter(spans, lambda s: ~s["base"])
        both = lambda b, a: F.when((F.size(a) > 0) & (F.size(b) > 0), F.concat(b, _clear_of(b, a))).otherwise(spans)
        return let(base, lambda b: let(added, lambda a: both(b, a)))

    places = F.transform(F.array(*[proposed(k[1], k[2]) for k in kinds]), lambda e: F.when(F.size(e["ms"]) > 0, located(e["ms"], e["gaps"])).otherwise(_none()))
    given = lambda spans: F.when(F.size(spans) == 0, none).otherwise(let(let(pieces(src), lambda cut: let(F.length(src), lambda n: scored(spans, cut, n))), merged))
    return docs.withColumn("pii", let(let(places, confirmed), given))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span of ``pii`` in ``text`` by its kind in brackets; overlapping spans become one mark.

    Texts without spans, null texts included, stay as they are.
    """
    ordered = F.sort_array(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cleaned(spans: Column, cut: Column) -> Column:
        def written(reached: Column) -> Column:
            """Texts before the spans that begin beyond all earlier ones, their marks, and what is left."""
            mark = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
            begins = lambda s, i: s["start"] >= F.get(reached, i)
            out = F.transform(spans, lambda s, i: F.when(begins(s, i), F.concat(between(cut, F.get(reached, i), s["start"]), mark(s))).otherwise(F.lit("")))
            last = F.array_max(F.transform(spans, lambda s: s["end"]))
            return F.concat(F.array_join(out, ""), between(cut, last, F.length(text)))

        return let(running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda at, v: F.greatest(at, v)), written)

    marked = let(ordered, lambda spans: let(pieces(F.col(text)), lambda cut: cleaned(spans, cut)))
    return docs.withColumn(text, F.when(F.size("pii") > 0, marked).otherwise(F.col(text)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return docs.select(
        "doc_id",
        *[count(k[0]) for k in BASE],
        F.sha2(_listed(F.filter("pii", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
    )


QUERIES = {"op10_pii": op10_pii}
SQL: dict[str, str] = {}
