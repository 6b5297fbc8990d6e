"""Prefix-target expansion of conversations, with DataFrame functions alone.

Every assistant turn becomes one example: all turns before it as context, and its own text as the
only trainable part. A conversation that ends with another role gives one more example, of context
alone, so that every turn is in the output. Control strings inside roles and texts get a
backslash after their first character (one more, if some are there already); ``unescape``
takes it off again.

Defined results: null roles and texts are empty, null turns come first, rows of one turn are ordered
by role and text; repeated rows are turns each; a null conv_id is one conversation; a
conversation without an assistant has one example with no trainable part; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What follows the first character of a control string.
_REST = r"(\|(?:turn|text|end)\|>|/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)\\(\\*)" + _REST, "$1$2$3")


def examples(turns: DataFrame, target: str = "assistant") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): code points from loss_start up to loss_end are trainable."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("said", escape(F.col("text")))
    rows = rows.withColumn("part", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT), F.col("said"), F.lit(END)))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "conv_id", "role", "said",
        F.row_number().over(in_order).alias("example"),
        F.collect_list("part").over(so_far).alias("parts"),
        F.lead(F.lit(1)).over(in_order).isNull().alias("last"),
    )
    rows = rows.where((F.col("role") == target) | F.col("last")).withColumn("formatted", F.array_join("parts", ""))
    loss_end = F.length("formatted") - F.when(F.col("role") == target, F.lit(len(END))).otherwise(F.lit(0))
    trainable = F.when(F.col("role") == target, F.length("said")).otherwise(F.lit(0))
    return rows.select("conv_id", "example", F.col("formatted").alias("text"), (loss_end - trainable).cast("long").alias("loss_start"), loss_end.cast("long").alias("loss_end"))


def digests(found: DataFrame) -> DataFrame:
    """Read turns and trainable texts back from the examples of each conversation."""
    loss = unescape(F.expr("substring(text, int(loss_start) + 1, int(loss_end - loss_start))"))
    by = found.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    turn = F.filter(F.split("whole", r"<\|end\|>"), lambda x: x != "")
    read = lambda x: F.concat(unescape(F.substring_index(x, TEXT, 1).substr(F.lit(len(TURN) + 1), F.length(x))), F.lit("\n"), unescape(F.substring_index(x, TEXT, -1)), F.lit("\n"))
    by = by.withColumn("turns", turn).withColumn("trained", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    return by.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", read), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def query(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return digests(examples(table.unionByName(probe)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<|turn|><|text|><|end|>')
      + length(regexp_replace(role, '(<|\[)(\\*)(\|(?:turn|text|end)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '(<|\[)(\\*)(\|(?:turn|text|end)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS so_far FROM o
)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
