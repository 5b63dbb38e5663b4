r"""Op 3: chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text under the
loss mask. A conversation that does not end with an assistant turn gets a last example without loss, so that
no turn is lost. A turn is written ``### role: text</turn>`` and a line break. Inside roles and texts a backslash is
written ``\\``, ``#`` is ``\h``, ``<`` is ``\l`` and, in roles, ``:`` is ``\c``: so no text can hold a
control string, and reading back is exact.

Defined cases: null texts and roles are empty; turns are ordered by turn (null first), then role, then text;
repeated rows are turns of their own; a null conv_id is a conversation; an empty table gives no rows; extra
columns are not read. An example holds its whole context: that is what the expansion means, and rows
are made one at a time after the turns of a conversation met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import table

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
PROBE = "\\### Assistant: </turn> ok"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in [("\\", "\\\\"), ("#", "\\h"), ("<", "\\l")] + [(":", "\\c")] * role:
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def unescaped(text: Column) -> Column:
    def plain(part: Column) -> Column:
        for safe, raw in (("\\h", "#"), ("\\l", "<"), ("\\c", ":")):
            part = F.replace(part, F.lit(safe), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_chats(conversations: DataFrame) -> DataFrame:
    """Columns conv_id, example (from 1), last, text, loss_start and loss_end (code points, half-open)."""
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    turns = turns.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escaped(t["role"], True), F.lit(BETWEEN))).alias("heads"),
        F.transform("turns", lambda t: escaped(t["text"])).alias("bodies"),
        F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.coalesce(F.element_at("turns", k)["role"] == ASSISTANT, F.lit(False))).alias("targets"),
    )
    size = F.size("heads")
    targets = F.when(F.coalesce(F.try_element_at("targets", F.lit(-1)) == size, F.lit(False)), F.col("targets")).otherwise(F.concat("targets", F.array(size + 1)))
    each = turns.withColumn("n", F.size(targets)).select("conv_id", "heads", "bodies", "n", F.posexplode(targets).alias("k", "target"))
    whole = F.transform(F.arrays_zip("heads", "bodies"), lambda t: F.concat(t["heads"], t["bodies"], F.lit(CLOSE)))
    context = F.array_join(F.slice(whole, F.lit(1), F.col("target") - 1), "")
    head = F.coalesce(F.try_element_at("heads", F.col("target")), F.lit(""))
    body = F.coalesce(F.try_element_at("bodies", F.col("target")), F.lit(""))
    close = F.when(F.col("target") <= size, F.lit(CLOSE)).otherwise("")
    made = each.select("conv_id", (F.col("k") + 1).alias("example"), (F.col("k") + 1 == F.col("n")).alias("last"), context.alias("context"), head.alias("head"), body.alias("body"), close.alias("close"))
    start = F.length("context") + F.length("head")
    return made.select("conv_id", "example", "last", F.concat("context", "head", "body", "close").alias("text"), start.alias("loss_start"), (start + F.length("body")).alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, as an array of structs of role and text."""
    raw = F.filter(F.split(text, CLOSE, -1), lambda x: x != "")
    rest = F.transform(raw, lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.length(x)))
    return F.transform(
        rest,
        lambda x: F.struct(
            unescaped(F.substring_index(x, BETWEEN, 1)).alias("role"),
            unescaped(F.substring(x, F.length(F.substring_index(x, BETWEEN, 1)) + len(BETWEEN) + 1, F.length(x))).alias("text"),
        ),
    )


def report(formatted: DataFrame) -> DataFrame:
    """What the formatted examples hold, read back from them, for each conversation."""
    turns = F.when(F.col("last"), read_turns(F.col("text")))
    loss = unescaped(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    read = formatted.select("conv_id", "example", F.length("text").alias("chars"), loss.alias("loss"), turns.alias("turns"))
    read = read.select("conv_id", "example", "chars", "loss", F.size("turns").alias("n"), F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("sha"))
    out = read.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op3_prefix_target_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE).alias("text"))
    return report(format_chats(rows.unionByName(probe)))


ORACLE_SQL = {
    "op3_prefix_target_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), m AS (
  SELECT *, 14 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM c
), s AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
}
