"""Chat formatting in Spark expressions: sorted turns, merged speakers, a loss mask by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strataframe.llm.common import table, text_of

#: Control strings all begin with OPEN and end with SHUT; escaped texts hold neither.  The colon of END keeps
#: a role's last character and the bar apart.
OPEN, SHUT, END = "<|", "|>", ":|>\n"


def escape(text: Column) -> Column:
    r"""Double each backslash, then break every ``<|`` and ``|>`` with one; ``unescape`` undoes it."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit(OPEN), F.lit("<\\|")), F.lit(SHUT), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    """A role as a header name; a leading + or / would read as a control, so it is broken as well."""
    name = escape(role)
    return F.when(name.startswith("+") | name.startswith("/"), F.concat(F.lit("\\"), name)).otherwise(name)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    r"""One row per conversation: ``formatted`` and ``segments``, the loss mask by run.

    Turns are sorted by turn number (null first), then role and text, so ties and repeated rows have one
    order and are all kept.  Adjacent turns of one role are merged into one block::

        <|role:|>\n first text <|+role:|>\n next text of the same role <|/role:|>\n

    Texts and roles are escaped, so the marks are the only control strings and everything can be read
    back (``read_back``).  ``segments`` splits ``formatted`` without gaps; ``loss`` marks the texts of
    the roles in ``learn`` and nothing else.  Null texts and roles are empty, a null conversation id is
    a conversation of its own, an empty table gives no rows, other columns are ignored.

    A conversation is one value of the result, so its turns meet in one row by contract; the collected
    lists are built per input task first and carry role and text only.
    """
    turns = rows.groupBy(F.col(conv)).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")))).alias("turns"))

    # Runs of one role are found by comparing neighbours and gathered by slices, so the work is in proportion to the turns.
    same = lambda i, j: F.get("turns", i)["role"] == F.get("turns", j)["role"]
    last = F.size("turns") - 1
    places = F.sequence(F.lit(0), last)
    opens = F.filter(places, lambda i: (i == 0) | ~same(i, i - 1))
    ends = F.filter(places, lambda i: (i == last) | ~same(i, i + 1))

    def block_of(run: Column) -> Column:
        texts = F.transform(F.slice("turns", run["first"] + 1, run["last"] - run["first"] + 1), lambda t: t["text"])
        return F.struct(F.get("turns", run["first"])["role"].alias("role"), texts.alias("texts"))

    blocks = F.transform(F.arrays_zip(opens.alias("first"), ends.alias("last")), block_of)

    def parts(block: Column) -> Column:
        name, learned = _role(block["role"]), block["role"].isin(*learn)
        mark = lambda sign: F.struct(F.concat(F.lit(OPEN + sign), name, F.lit(END)).alias("text"), F.lit(False).alias("loss"))
        told = lambda t: F.struct(escape(t).alias("text"), learned.alias("loss"))
        body = F.transform(block["texts"], lambda t, i: F.array(F.when(i == 0, mark("")).otherwise(mark("+")), told(t)))
        return F.concat(F.flatten(body), F.array(mark("/")))

    segments = F.flatten(F.transform(blocks, parts))
    return turns.select(F.col(conv), segments.alias("segments")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` of a formatted conversation, markers taken out."""
    pieces = F.filter(F.split(formatted, r"<\|"), lambda p: (p != "") & ~p.startswith("/"))

    def turn(piece: Column) -> Column:
        name = F.substring_index(piece, END, 1)
        body = F.substring(piece, F.length(name) + 1 + len(END), F.length(piece))
        return F.struct(unescape(F.regexp_replace(name, r"^\+", "")).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(segments: Column) -> Column:
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    listed = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        format_chats(rows)
        .select("conv_id", "formatted", read_back(F.col("formatted")).alias("_turns"), loss_text(F.col("segments")).alias("_loss"))
        .select(
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            digest(listed).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            digest(F.col("_loss")).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS told,
         coalesce(lag(role) OVER w <> role, true) AS opens
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
g AS (
  SELECT conv_id, count(*) AS n,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
         sum(length(told) + length(role) + CASE WHEN opens THEN 6 + 7 + length(role) ELSE 7 END) AS chars
  FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""

QUERIES = {"op9_chat_formatting": op9_chat_formatting}
SQL = {"op9_chat_formatting": OP9_SQL}
