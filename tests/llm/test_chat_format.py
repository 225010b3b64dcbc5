from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowdelta.llm import chat_format as c


def both(turns):
    made = c.format_conversations(turns)
    return made.select("*", c.read_back(F.col("formatted")).alias("turns"), c.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))


piece = st.sampled_from([*c.CONTROL, "\\", "<", "s>", "[", "\n", "é", "😀", "", "\x00", " ok "])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["user", "assistant", None, "<s>", "a\\"]), st.none() | st.lists(piece, max_size=8).map("".join)), min_size=1, max_size=8))
def test_round_trip(spark, rows):
    rows = [(v, i, r, t) for i, (v, r, t) in enumerate(rows)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("line", F.lit("x"))
    for r in both(turns).collect():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")
        assert r["formatted"].count(c.CLOSE) == len(own)


def test_parts_become_placeholders(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "s3://i", 576), ("audio", "ignored", "a.wav", None), ("document", None, "d.pdf", 90), ("text", "!", None, 3), (None, "?", None, 1)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "fine", None, 0)]), (1, 2, "assistant", None)], f"conv_id long, turn long, role string, parts {c.PART}")
    r = both(turns).first()
    assert r["formatted"].startswith("<s>user[INST]see <\\|image|> <|image|><|audio|><|document|>!?[/INST]</s>")
    assert [tuple(a) for a in r["attachments"]] == [(0, "image", "s3://i", 576), (0, "audio", "a.wav", 0), (0, "document", "d.pdf", 90)]
    assert r["expanded_tokens"] == 666 and r["loss"] == "fine" and len(r["loss_spans"]) == 2


def test_nulls_ties_and_order(spark):
    rows = [(None, 0, "user", "a"), (None, None, "assistant", "first"), (5, 1, "b", "t"), (5, 1, "a", "t"), (5, 1, "a", "t"), (5, None, None, None)]
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in both(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {None: [("assistant", "first"), ("user", "a")], 5: [("", ""), ("a", "t"), ("a", "t"), ("b", "t")]}


def test_long_text_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    r = both(spark.createDataFrame([(1, 0, "assistant", "[INST]" * 50_000)], schema)).first()
    assert r["loss"] == "[INST]" * 50_000
    assert both(spark.createDataFrame([], schema)).count() == 0
