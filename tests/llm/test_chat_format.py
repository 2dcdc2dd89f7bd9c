import hashlib

from pyspark.sql import functions as F

from quarry.llm import chat_format as m
from tests.parity import same


def test_parity(spark):
    same(spark, m.query, m.SQL)


def test_escapes_are_reversible_and_hide_control_strings(spark):
    texts = ["", "\\", "\\\\<s>", "<s></s>[INST][/INST][ROLE][/ROLE]<<SYS>><</SYS>>", "<\\s>", "[[INST]]", "a<", "<<s>", "é\n</s>\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", m.escape(F.col("t")).alias("e"))
    for r in rows.withColumn("back", m.unescape(F.col("e"))).collect():
        assert r.back == r.t and not any(c in r.e for c in m.CONTROL)


def test_examples_and_masks(spark):
    turns = [(1, 0, "system", "be"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "yo [INST]"), (1, 3, "user", "more"), (1, 4, "assistant", "ok"), (1, 5, "user", "bye"), (2, 0, "user", None)]
    got = m.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "example").collect()
    assert [(r.conv_id, r.trainable) for r in got] == [(1, True), (1, True), (1, False), (2, False)]
    masks = [r.formatted[r.loss_start : r.loss_end] for r in got]
    assert masks == ["yo [\\INST]", "ok", "", ""]
    assert got[1].formatted.startswith(got[0].formatted)


def test_edges(spark):
    turns = [(1, 0, None, "x", 1), (1, 0, "assistant", "b", 1), (1, 0, "assistant", "a", 1), (None, 0, "assistant", "y" * 100_000, 1), (3, None, "ro</s>le", "", 1), (1, 0, "assistant", "a", 1)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, example int")
    got = {r.conv_id: r for r in m.digest(m.format_conversations(rows)).collect()}
    told = lambda *t: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    assert got[1].turns_sha256 == told(("", "x"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")) and got[1].loss_chars == 3
    assert got[None].loss_chars == 100_000 and got[3].turns_sha256 == told(("ro</s>le", ""))
    assert m.digest(m.format_conversations(rows.limit(0))).count() == 0
