"""Chat formatting by relational operations: turns collected and sorted, adjacent turns of a role merged, texts concatenated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import running

TURN, TEXT, JOIN, END = "<|turn|>", "<|text|>", "<|join|>", "<|end|>"
#: What begins a control string of this or another common template. In a text, & goes after the first character, and so
#: it does where & stands there already; that makes it reversible.
CONTROL = r"\||/?s>|/?INST\]"
LOSS = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(&|{CONTROL})", "$1&$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])&(&|{CONTROL})", "$1$2")


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss, the spans (start, end) of the assistant's texts in it, in code points.

    Turns are in the order of ``turn``. A run of turns of one role is one block: a turn mark, the role, a text mark, the
    texts with a join mark between them, an end mark. Control strings in roles and texts are escaped reversibly.

    Nulls: a null role or text is empty; a null turn comes first; rows with a null conv_id are one conversation. Ties in
    ``turn`` go by role, then text, so repeated rows stand next to each other. Empty texts have empty spans. A
    conversation's turns meet in one row, as its string must. An empty table gives no rows. Other columns are ignored.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), own(role).alias("role"), own(text).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    role_at = lambda i: F.get(F.col("t"), i)["role"]
    opens = lambda x, i: F.when((i > 0) & (role_at(i - 1) == x["role"]), F.lit(JOIN)).otherwise(F.concat(F.lit(TURN), escape(x["role"]), F.lit(TEXT)))
    closes = lambda x, i: F.when(F.coalesce(role_at(i + 1) == x["role"], F.lit(False)), F.lit("")).otherwise(F.lit(END))
    pieces = F.transform("t", lambda x, i: F.struct(opens(x, i).alias("head"), escape(x["text"]).alias("body"), closes(x, i).alias("tail"), (x["role"] == LOSS).alias("loss")))
    chats = chats.select("conv_id", pieces.alias("p"))
    chats = chats.withColumn("at", running(F.transform("p", lambda x: (F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"])).cast("long"))))
    spans = F.zip_with("p", "at", lambda x, at: F.when(x["loss"], F.struct((at + F.length(x["head"])).alias("start"), (at + F.length(x["head"]) + F.length(x["body"])).alias("end"))))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
    )


def read_chats(formatted: Column) -> Column:
    """The turns that a formatted string holds: an array of structs (role, text)."""
    literal = lambda s: s.replace("|", r"\|")
    blocks = F.transform(F.filter(F.split(formatted, literal(END), -1), lambda b: b != ""), lambda b: F.split(F.substring(b, len(TURN) + 1, 2**31 - 1), literal(TEXT), -1))
    texts = lambda b: F.split(F.get(b, F.lit(1)), literal(JOIN), -1)
    return F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(unescape(F.get(b, F.lit(0))).alias("role"), unescape(t).alias("text")))))


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS).alias("role"), F.lit(said).alias("text"))
    done = format_chats(given.unionByName(own)).withColumn("turns", read_chats(F.col("formatted")))
    learned = F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    done = done.withColumn("learned", F.array_join(learned, ""))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), named AS (
  SELECT *, lag(role) OVER w AS before,
    regexp_replace(text, '([<\[])(&|\||/?s>|/?INST\])', '\1&\2', 'g') AS body,
    regexp_replace(role, '([<\[])(&|\||/?s>|/?INST\])', '\1&\2', 'g') AS head
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + CASE WHEN before = role THEN 8 ELSE 8 + length(head) + 8 + 7 END)::BIGINT AS formatted_chars
FROM named GROUP BY conv_id
"""
