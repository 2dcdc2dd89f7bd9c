"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one training example: all turns before it are context, and that
reply alone is trainable. Turns after the last assistant turn have no example of their own, so a
conversation that does not end in one also gets a context-only record, which carries no loss and
keeps the conversation readable from the output.

Template, one turn: ``[ROLE]`` role ``[/ROLE]`` newline text ``</s>``; a record starts with ``<s>``.
Control strings inside a role or a text are broken up by a backslash after their first character,
and each backslash is doubled; dropping one backslash of each pair, or the one before any other
character, gives the text back exactly.

Defined cases: null text or role is the empty string; rows of equal conversation and turn are
ordered by role, then text, and repeated rows are repeated turns; a null conversation id is a
conversation of its own; an empty table gives no records; other columns are ignored, whatever
their names. A conversation is one training document, so its turns meet in one row; what grows is
the number of conversations, and records grow with the assistant turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._common import fresh_path, table

#: The control strings of the template and of the instruction format it must not collide with.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>")
#: A backslash, or the first character of a control string.
_OPENS = r"(\\|<(?=/?s>|</?SYS>>)|\[(?=/?INST\]|/?ROLE\]))"


def escape(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _OPENS, r"$1\\")


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, example (0, 1, ... in turn order), trainable, loss_start, loss_end, formatted.

    ``loss_start`` and ``loss_end`` are code-point offsets into ``formatted``: the mask of the reply.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    head = lambda t: F.concat(F.lit("[ROLE]"), escape(t["role"]), F.lit("[/ROLE]\n"))
    one = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    one = one.select(
        "conv_id",
        F.transform("turns", lambda t: head(t)).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
    )
    last = F.size("heads") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("replies", i) | (i == last))
    return (
        one.select("*", F.posexplode(ends).alias("example", "at"))
        .withColumn(
            "context",
            F.concat(
                F.lit("<s>"),
                F.array_join(
                    F.zip_with(F.slice("heads", 1, F.col("at")), F.slice("bodies", 1, F.col("at")), lambda h, b: F.concat(h, b, F.lit("</s>"))),
                    "",
                ),
                F.get("heads", F.col("at")),
            ),
        )
        .select(
            "conv_id",
            F.col("example").cast("long").alias("example"),
            F.get("replies", F.col("at")).alias("trainable"),
            F.char_length("context").cast("long").alias("loss_start"),
            (F.char_length("context") + F.when(F.get("replies", F.col("at")), F.char_length(F.get("bodies", F.col("at")))).otherwise(0)).cast("long").alias("loss_end"),
            F.concat("context", F.get("bodies", F.col("at")), F.lit("</s>")).alias("formatted"),
        )
    )


def read_turns(formatted: F.Column) -> F.Column:
    """array<struct<role, text>> of one record, unescaped."""
    pieces = F.split(F.substring(formatted, 4, 2147483647), "</s>", -1)
    return F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, r"(?s)^\[ROLE\](.*?)\[/ROLE\]\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"(?s)^\[ROLE\].*?\[/ROLE\]\n", "")).alias("text"),
        ),
    )


def digest(records: DataFrame) -> DataFrame:
    """Per conversation, from formatted records alone: its turns and what the loss mask covers."""
    masked = F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    seen = records.select(
        "conv_id",
        "example",
        F.when(F.col("trainable"), unescape(masked)).otherwise("").alias("loss"),
        F.char_length("formatted").alias("chars"),
        "formatted",
    )
    per = seen.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]).alias("losses"),
        F.max_by("formatted", "example").alias("whole"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    turns = per.withColumn("turns", read_turns(F.col("whole"))).withColumn("loss", F.array_join("losses", ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -1: a user and an assistant turn that both say control strings."""
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted(spark))
    path = fresh_path(spark, "chat")
    format_conversations(rows).write.parquet(path)
    return digest(spark.read.parquet(path))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '\\\\', '\\\\\\\\', 'g'),
      '<(/?s>|</?SYS>>)', '<\\\\\\1', 'g'), '\\[(/?INST\\]|/?ROLE\\])', '[\\\\\\1', 'g') AS esc
  FROM t
), f AS (
  SELECT *, length(role) + length(esc) + 18 AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM e
), g AS (
  SELECT *, CASE WHEN role = 'assistant' OR k = n
    THEN 3 + sum(chars) OVER (PARTITION BY conv_id ORDER BY k) ELSE 0 END AS record_chars
  FROM f
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k)) AS loss_sha256,
  CAST(sum(record_chars) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""
