"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation's rows, in order of ``turn``, become one text and its segments. For each
turn the template emits the head (``### User: ``), the escaped text and the end mark; only
the segment of a text whose role is in ``loss_roles`` carries the loss flag. The machine
reads the roles in the same order; a conversation is ``valid`` when every step is allowed
and it ends in an accepting state. Invalid conversations are formatted as well, so that
nothing is lost; ``valid`` and ``end_state`` tell them apart.

Escaping is reversible and leaves no control string inside a text: the escape character,
the head mark, the end mark and (in a role) the colon are replaced by two-character codes,
so the formatted text can be split at the end marks.

Everything is DataFrame functions; no Python runs on the executors. A conversation's text
is one value of one row, so its turns meet in one group; nothing larger does.

Defined cases: NULL text is the empty text and a NULL role the empty role; rows of equal
``turn`` are ordered by role, then text, and repeated rows are turns of their own; a NULL
``turn`` comes first; rows with a NULL ``conv_id`` form the conversation NULL; roles the
template does not know get a generic head and make the conversation invalid; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import table


@dataclass(frozen=True)
class Template:
    """What a turn looks like, which roles are learned, and which orders are allowed."""

    mark: str = "###"
    end: str = "</turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    #: (state, role) -> state; any other step is an error
    steps: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accepting: tuple[str, ...] = ("answered",)

    def codes(self) -> list[tuple[str, str]]:
        """Control string -> code; the escape character first."""
        return [("\\", "\\b"), (self.mark, "\\h"), (self.end.strip(), "\\t")]


def escape(text: Column, template: Template) -> Column:
    for raw, code in template.codes():
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, template: Template) -> Column:
    """Undoes :func:`escape`: each escape character of an escaped text belongs to one code,
    and the code of the escape character itself goes last."""
    for raw, code in reversed(template.codes()):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _literal_map(items: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, formatted, segments array<struct<text,loss>>, valid, end_state`` of the rows
    ``conv_id, turn, role, text``."""
    t = template or Template()
    names = _literal_map(t.names)
    steps = _literal_map({f"{state}\n{role}": to for (state, role), to in t.steps.items()})

    def known(role: Column) -> Column:
        return F.element_at(names, role)

    def head(role: Column) -> Column:
        other = F.concat(F.lit("?"), F.replace(escape(role, t), F.lit(":"), F.lit("\\c")))
        return F.concat(F.lit(f"{t.mark} "), F.coalesce(known(role), other), F.lit(": "))

    def segments(x: Column) -> Column:
        return F.array(
            F.struct(head(x["role"]).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
        )

    rows = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).alias("t"))
    conversations = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    state = F.aggregate(
        "turns",
        F.lit(t.start),
        lambda s, x: F.coalesce(F.element_at(steps, F.concat(s, F.lit("\n"), x["role"])), F.lit("error")),
    )
    return (
        conversations.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), state.alias("end_state"))
        .withColumn("formatted", F.array_join(F.col("segments.text"), ""))
        .withColumn("valid", F.col("end_state").isin(*t.accepting))
        .select("conv_id", "formatted", "segments", "valid", "end_state")
    )


def parse_formatted(formatted: Column, template: Template | None = None) -> Column:
    """``array<struct<role,text>>`` read back from a formatted text."""
    t = template or Template()
    roles = _literal_map({name: role for role, name in t.names.items()})

    def turn(x: Column) -> Column:
        name = F.substring_index(F.substr(x, F.lit(len(t.mark) + 2)), ": ", 1)
        other = unescape(F.replace(F.substr(name, F.lit(2)), F.lit("\\c"), F.lit(":")), t)
        return F.struct(
            F.coalesce(F.element_at(roles, name), other).alias("role"),
            unescape(F.substr(x, F.length(name) + len(t.mark) + 4), t).alias("text"),
        )

    # the end mark ends every turn, so the last piece is empty
    pieces = F.split(formatted, "\\Q" + t.end + "\\E")
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


#: The conversation that holds the control strings themselves.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Template()
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema)
    done = format_conversations(turns.unionByName(control), t)
    read = F.array_join(F.transform(parse_formatted(F.col("formatted"), t), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"], t)), "")
    return done.withColumns({"read": read, "learned": loss}).select(
        "conv_id",
        F.size(parse_formatted(F.col("formatted"), t)).cast("bigint").alias("n_turns"),
        F.sha2("read", 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        "end_state",
    )


OP8_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, replace(replace(replace(text, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t') AS body FROM turns
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM escaped
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS said,
    coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS learned,
    -- '### ' name ': ' body '</turn>' newline; the name is as long as the role
    sum(4 + length(role) + 2 + length(body) + 8) AS formatted_chars,
    bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user')
      WHEN role = 'user' THEN before IN ('assistant') OR (before = 'system' AND k = 2)
      WHEN role = 'assistant' THEN before = 'user' ELSE false END) AS allowed,
    max(role) FILTER (WHERE k = n) AS last_role
  FROM numbered GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
  sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  allowed AND last_role = 'assistant' AS valid,
  CASE WHEN NOT allowed THEN 'error' WHEN last_role = 'system' THEN 'told'
    WHEN last_role = 'user' THEN 'asked' ELSE 'answered' END AS end_state
FROM joined
"""
