"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

A template names, for each role, what stands before and after a text, and whether the text
counts for the loss; a table of states says which role may follow which. Turns are put in
order, escaped and joined; the result is one string and the list of its segments, each with
its place and loss flag. ``read_back`` turns the string into turns again.

Inside texts, the escape sign and the first characters of control strings are replaced by the
escape sign and a digit, so that no text can hold a mark of the template or of the listed
foreign formats; the reverse replacement gives the text back.

Scale: DataFrame functions only. One shuffle groups the turns of a conversation; a
conversation is one string in the result, so its turns have to meet. Work is linear in them: places
are a running sum, and no step looks at a conversation again for each turn.

Defined cases: a null text counts as empty; a null role as the role ''. Rows with one turn
number are put in the order of role and text, null turns first; all of them are written. A
conversation that breaks the order of roles is written and marked (``valid`` false). Each row
with a null conv_id is a conversation of its own, so that such rows don't meet. Extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of turns, roles that count for the loss, and the transitions of the machine (state -> role -> state)."""

    begin: str = "<|turn|>"
    middle: str = "<|text|>"
    end: str = "<|end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple[str, ...] = ("answered",)
    #: The escape sign, and the characters that control strings begin with, each with its digit.
    escape: str = "~"
    guarded: tuple[str, ...] = ("<", "[")

    def escaped(self, text: Column) -> Column:
        for k, c in enumerate((self.escape, *self.guarded)):
            text = F.replace(text, F.lit(c), F.lit(f"{self.escape}{k}"))
        return text

    def unescaped(self, text: Column) -> Column:
        for k, c in reversed(list(enumerate((self.escape, *self.guarded)))):
            text = F.replace(text, F.lit(f"{self.escape}{k}"), F.lit(c))
        return text


TEMPLATE = Template()
#: A conversation that tests the escapes: its texts hold control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def formatted(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, formatted (string), segments (start, length, role, loss, at: where its turn begins), valid and broken_at (the first turn out of order)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("apart"))
    rows = rows.withColumn("head", template.escaped(F.col("role"))).withColumn("body", template.escaped(F.col("text")))
    # places of turns by a running sum, which the grouping needs no other shuffle for
    order = Window.partitionBy("conv_id", "apart").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    chars = F.length("head") + F.length("body") + len(template.begin + template.middle + template.end)
    end = F.sum(chars.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("conv_id", "apart", F.struct(F.row_number().over(order).alias("k"), (end - chars).alias("at"), "role", "head", "body").alias("one"))
    convs = rows.groupBy("conv_id", "apart").agg(F.array_sort(F.collect_list("one")).alias("turns")).drop("apart")

    # the machine: states and roles as one map, 'failed' for any other pair
    pairs = [F.lit(x) for state, to in template.moves.items() for role_, then in to.items() for x in (f"{state}\n{role_}", then)]
    moves = F.create_map(*pairs)
    begin = F.struct(F.lit("start").alias("state"), F.lit(None).cast("long").alias("broken"), F.lit(0).alias("k"))

    def move(a: Column, t: Column) -> Column:
        then = F.coalesce(F.try_element_at(moves, F.concat(a["state"], F.lit("\n"), t["role"])), F.lit("failed"))
        return F.struct(then.alias("state"), F.when(a["broken"].isNull() & (then == "failed"), a["k"].cast("long")).otherwise(a["broken"]).alias("broken"), (a["k"] + 1).alias("k"))

    convs = convs.withColumn("_end", F.aggregate("turns", begin, move))
    pieces = F.transform("turns", lambda t: F.concat(F.lit(template.begin), t["head"], F.lit(template.middle), t["body"], F.lit(template.end)))
    begins = len(template.begin + template.middle)
    segments = F.transform(
        "turns",
        lambda t: F.struct((t["at"] + begins + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length"), t["role"].alias("role"), t["role"].isin(*template.loss).alias("loss"), t["at"].alias("at")),
    )
    convs = convs.withColumn("formatted", F.array_join(pieces, ""))
    return convs.select("conv_id", "formatted", segments.alias("segments"), F.col("_end.state").isin(*template.final).alias("valid"), F.col("_end.broken").alias("broken_at"))


def read_back(chats: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """chats and ``turns`` (role, text), read from the formatted string, and ``loss_text``, read from it by the segments with loss."""
    # what a begin mark leads, one for each segment: a segment's place is then looked for in its own part, not from the string's start
    chats = chats.withColumn("_parts", F.filter(F.split("formatted", "\\Q" + template.begin + "\\E"), lambda x: x != ""))
    turns = F.transform("_parts", lambda x: F.struct(template.unescaped(F.substring_index(x, template.middle, 1)).alias("role"), template.unescaped(_body(x, template)).alias("text")))
    here = lambda p, s: F.substring(p, (s["start"] - s["at"] - len(template.begin) + 1).cast("int"), s["length"].cast("int"))
    loss = F.zip_with("_parts", "segments", lambda p, s: F.when(s["loss"], template.unescaped(here(p, s))).otherwise(""))
    return chats.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, "")).drop("_parts")


def _body(part: Column, template: Template) -> Column:
    """The text of a turn: what stands between the middle mark and the end mark."""
    body = F.substring_index(part, template.middle, -1)
    return F.substring(body, F.lit(1), F.length(body) - len(template.end))


def chat_report(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """The columns of the contract, for all conversations and the probe."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = conversations.sparkSession.createDataFrame(PROBE, rows.schema)
    back = read_back(formatted(rows.unionByName(probe), template), template)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "broken_at",
    )


REPORT_SQL = r"""
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS apart, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER w - 1 AS k, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id, apart ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
              WHEN before = 'user' THEN role = 'assistant' ELSE false END AND (role <> 'system' OR k = 0) AS ok,
       CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
       length(regexp_replace(text, '[~<\[]', 'xx', 'g')) + length(regexp_replace(role, '[~<\[]', 'xx', 'g')) + 24 AS chars FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY k)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars,
       bool_and(ok) AND max_by(role, k) = 'assistant' AS valid, min(CASE WHEN NOT ok THEN k END)::BIGINT AS broken_at
FROM s GROUP BY conv_id, apart
"""
