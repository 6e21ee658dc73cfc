"""Chat formatting: rebuild conversations from event logs and render them for training.

Native: DataFrame functions only. Events are folded for each message first and joined to
conversations afterwards, so a busy conversation is pre-aggregated where its rows are read.
The one value that must hold a whole conversation is its rendered text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import table

BEGIN, BODY, END = "<|begin|>", "<|text|>", "<|end|>\n"
#: Strings that chat templates give a meaning; none survives unescaped inside a text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Double each backslash, then put one after the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    """The inverse of escape: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Fold (conv_id, message_id, seq, kind, role, text) events into final messages.

    kind: message sets the whole text, delta appends, edit replaces, regenerate discards
    what was there and starts again with its own text, delete removes the message. Ties in
    seq are ordered by kind, role and text; a null text is empty, a null kind is message,
    an unknown kind raises no error and changes nothing. A message's place is its first seq, its
    role the last one given. Returns conv_id, message_id, place, role, text.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    log = F.sort_array(
        F.collect_list(F.struct("seq", kind.alias("kind"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    )
    folded = events.groupBy("conv_id", "message_id").agg(log.alias("log"))
    whole = ("message", "edit", "regenerate", "delete")
    start = F.coalesce(
        F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*whole), i))), F.lit(0)
    )
    folded = folded.withColumn("start", start)
    live = F.filter(F.slice("log", F.col("start") + 1, F.size("log")), lambda e: e["kind"].isin(*whole, "delta"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return folded.where(F.col("log")[F.col("start")]["kind"] != "delete").select(
        "conv_id",
        "message_id",
        F.col("log")[0]["seq"].alias("place"),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def format_conversations(messages: DataFrame) -> DataFrame:
    """Render messages (conv_id, place, role, text) to one row for each conversation.

    segments: pieces with a loss flag, on for the texts of assistants; formatted: all pieces
    joined. Messages are ordered by place, then role and text; repeated rows are turns of their own.
    """
    turn = F.struct(F.col("place"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(t: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(BODY)), F.lit(False)),
            part(escape(t["text"]), t["role"] == "assistant"),
            part(F.lit(END), F.lit(False)),
        )

    out = turns.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_formatted(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    parts = F.split(formatted, r"<\|end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    inner = lambda p, i: unescape(F.regexp_extract(p, r"(?s)\A<\|begin\|>(.*?)<\|text\|>(.*)\z", i))
    return F.transform(parts, lambda p: F.struct(inner(p, 1).alias("role"), inner(p, 2).alias("text")))


def events_of(conversations: DataFrame) -> DataFrame:
    """One message event for each row of a conversations table; every row is a message of its own."""
    return conversations.select(
        "conv_id",
        F.monotonically_increasing_id().alias("message_id"),
        F.col("turn").alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of op7, read back from formatted conversations."""
    turns = F.transform(
        parse_formatted(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("t"),
    ).select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digest(format_conversations(fold_events(events_of(rows))))


def _sql() -> str:
    said = "</s>[INST] ok [/INST]"
    esc = "replace(x, '\\', '\\\\')"
    for c in CONTROL:
        esc = f"replace({esc}, '{c}', '{c[0]}\\{c[1:]}')"
    fixed = len(BEGIN) + len(BODY) + len(END)
    length = lambda x: f"length({esc.replace('(x,', f'({x},')})"
    order = "ORDER BY turn, role, text"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + {length('role')} + {length('text')}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


ORACLE_SQL = _sql()
