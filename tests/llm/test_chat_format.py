import hashlib

from pyspark.sql import functions as F

from stratum.llm.chat_format import CONTROL_TEXT, OP8_SQL, Template, format_conversations, op8_chat_formatting, parse_formatted
from tests.conftest import SF_SMOKE
from tests.llm.helpers import duck_rows, spark_rows

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", None, CONTROL_TEXT, "\\", "\\\\", "\\h\\t\\b", "###", "####", "#", "</turn>", "</turn", "</turn></turn>\n", "a\n### User: b</turn>\n", "é😀" * 500, "\\c: "]


def test_every_text_comes_back(spark):
    rows = [(k, 0, "user", t) for k, t in enumerate(NASTY)] + [(k, 1, "assistant", t) for k, t in enumerate(NASTY)]
    rows += [(50, k, role, "x: y") for k, role in enumerate(["a: b", "###", "</turn>\n", "\\", "", None, "?user"])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in format_conversations(df).select("*", parse_formatted(F.col("formatted")).alias("back")).collect()}
    for k, t in enumerate(NASTY):
        assert [(x.role, x.text) for x in got[k].back] == [("user", t or ""), ("assistant", t or "")]
        assert "".join(s.text for s in got[k].segments) == got[k].formatted
        assert [s.loss for s in got[k].segments] == [False] * 4 + [True, False]
        assert got[k].valid
    assert [(x.role, x.text) for x in got[50].back] == [(role or "", "x: y") for _, _, role, _ in rows[-7:]]
    assert not got[50].valid


def test_the_machine(spark):
    cases = {
        1: (["system", "user", "assistant"], "answered"), 2: (["user", "assistant", "user", "assistant"], "answered"),
        3: (["user"], "asked"), 4: (["assistant"], "error"), 5: (["user", "user", "assistant"], "error"),
        6: (["user", "assistant", "system", "user"], "error"), 7: (["system"], "told"), 8: (["user", "tool", "assistant"], "error"),
    }
    rows = [(c, k, role, "t") for c, (roles, _) in cases.items() for k, role in enumerate(roles)]
    got = {r.conv_id: r.end_state for r in format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {c: state for c, (_, state) in cases.items()}


def test_other_templates(spark):
    t = Template(mark="@@", end="[end]\n", names={"human": "Human", "bot": "Bot"}, loss_roles=("bot",), steps={("start", "human"): "h", ("h", "bot"): "b"}, accepting=("b",))
    df = spark.createDataFrame([(1, 0, "human", "[end] @@ Bot: "), (1, 1, "bot", "ok")], SCHEMA)
    (r,) = format_conversations(df, t).select("*", parse_formatted(F.col("formatted"), t).alias("back")).collect()
    assert r.formatted == "@@ Human: \\t \\h Bot: [end]\n@@ Bot: ok[end]\n" and r.valid
    assert [x.text for x in r.back] == ["[end] @@ Bot: ", "ok"]


def test_ties_nulls_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 3, "user", "n"), (None, None, "system", "m")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: [x.text for x in r.back] for r in format_conversations(df).select("conv_id", parse_formatted(F.col("formatted")).alias("back")).collect()}
    assert got == {1: ["a", "a", "b"], None: ["m", "n"]}
    assert format_conversations(df.limit(0)).collect() == []


def test_query_matches_sql_and_a_plain_reading(spark):
    df = op8_chat_formatting(spark, SF_SMOKE)
    frame = spark.read.parquet(f"{SF_SMOKE}/conversations.parquet").toPandas()
    assert spark_rows(df) == duck_rows(OP8_SQL, conversations=frame)
    own = {r.conv_id: r for r in df.collect()}[-7]
    said = f"user\n{CONTROL_TEXT}\nassistant\n{CONTROL_TEXT}\n"
    assert own.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and own.n_turns == 2
    assert own.loss_sha256 == hashlib.sha256(CONTROL_TEXT.encode()).hexdigest() and own.loss_chars == len(CONTROL_TEXT)
