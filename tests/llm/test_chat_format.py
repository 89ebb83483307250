"""Conversations read back from their formatted texts."""

from pyspark.sql import functions as F

from capital_access.llm import chat_format as m

TURNS = f"conv_id long, turn long, role string, parts array<{m.PART_TYPE}>"
NASTY = ["", "<turn user>\nhi\n</turn>\n", "\\### Assistant: </turn> ok", "<\\turn <\\\\/turn <image><audio>", "a < b\\", "<", "é😀<document>", "\n\n"]


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_texts_and_roles_come_back(spark):
    roles = ["user", "assistant", None, "sys>tem\n%0A", "%25", "a<turn b", "%3C</turn>"]
    rows = [(k, t, roles[(k + t) % len(roles)], [part("text", NASTY[(k * 3 + t) % len(NASTY)])]) for k in range(8) for t in range(5)]
    rows += [(99, 0, "assistant", [part("text", None)]), (99, 1, "assistant", None), (None, None, "user", [part("text", "no id")])]
    done = m.format_conversations(spark.createDataFrame(rows, TURNS)).select(
        "conv_id", "formatted", m.read_turns(F.col("formatted")).alias("turns"), m.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    found = {r.conv_id: r for r in done.collect()}
    for k in range(8):
        mine = [(r[2] or "", r[3][0][1]) for r in rows if r[0] == k]
        assert [(t.role, t.text) for t in found[k].turns] == mine
        assert found[k].loss == [t for role, t in mine if role == "assistant"]
    assert [t.text for t in found[99].turns] == ["", ""] and found[99].loss == [""]
    assert [t.text for t in found[None].turns] == ["no id"]


def test_attachments_are_placed_in_order(spark):
    rows = [(1, 1, "assistant", [part("text", "see"), part("image", ref="a.png", width=700, height=300), part("text", "<image> and"), part("odd", "kind")]),
            (1, 0, "user", [part("audio", ref="b.ogg", seconds=2.5), part("document", ref="c.pdf", pages=3), part("image", ref=None)])]
    row = m.format_conversations(spark.createDataFrame(rows, TURNS)).first()
    assert row.formatted == ("<turn user>\n<audio>\n<document>\n<image>\n</turn>\n"
                             "<turn assistant>\nsee\n<image>\n<\\image> and\nkind\n</turn>\n")
    assert [(a.place, a.turn, a.kind, a.ref, a.tokens) for a in row.attachments] == [
        (1, 0, "audio", "b.ogg", 63), (2, 0, "document", "c.pdf", 1536), (3, 0, "image", None, 145), (4, 1, "image", "a.png", 1 + 3 * 144)]
    assert [row.formatted[s.start:s.end] for s in row.loss_mask] == ["see", "<\\image> and", "kind"]
    assert row.n_attachment_tokens == 63 + 1536 + 145 + 433 and row.n_text_tokens == 1 + 5 + 1  # see; < \ image > and; kind


def test_repeated_turns_empty_table_and_other_columns(spark):
    rows = [(5, 0, "user", [part("text", "b")]), (5, 0, "user", [part("text", "a")]), (5, 0, "user", [part("text", "a")])]
    df = spark.createDataFrame(rows, TURNS).withColumns({"formatted": F.lit("x"), "piece": F.lit(1), "offset": F.lit(2)})
    row = m.format_conversations(df).select(m.read_turns(F.col("formatted")).alias("t"), "n_turns").first()
    assert [t.text for t in row.t] == ["a", "a", "b"] and row.n_turns == 3
    assert m.format_conversations(df.where("false")).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = m.format_conversations(df.withColumn("parts", m.text_part(F.col("text"))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
