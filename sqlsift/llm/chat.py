"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered with that speaker as assistant, the
others as named users and system turns as they are; only the assistant's words are to be trained on.
Turns meet the participants of their conversation by key (a join that can be split for a conversation of
any size). Positions come from a range partitioning by conversation, perspective and turn: running
sums in each range, and what the ranges before hold of the one dialogue that crosses a border.

Defined results: a null text is empty; a null role speaks as `unknown` and is nobody's perspective; null
conversation ids are one conversation; turns sort nulls first, ties by role, then text; repeated rows are
turns of their own; a conversation of system turns alone has no perspective and gives no row; no turns give no rows.
Columns beside conv_id, turn, role and text are not read and do not come back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlsift.llm.common import pieces, stored, table

SYSTEM = "system"


def _running(batches):
    pid, last, nth, at = TaskContext.get().partitionId(), None, 0, 0
    for b in batches:
        seq, start = [], []
        for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if last is None or key[:2] != last:
                last, nth, at = key[:2], 0, 0
            nth += 1
            seq.append(nth)
            start.append(at)
            at += key[2]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pid] * b.num_rows, pa.int32()), pa.array(seq, pa.int64()), pa.array(start, pa.int64())], names=[*b.schema.names, "pid", "seq", "start_char"])


def rotate(turns: DataFrame) -> DataFrame:
    """From (conv_id, turn, role, text): a row for each perspective and turn.

    conv_id, perspective, seq (from 1), turn, kind, name, message, start_char, end_char, mask_start, mask_end:
    the last two bound the characters of the dialogue that are trained on (equal: none).
    """
    said = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    people = said.filter(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    kind = F.when(F.col("role") == F.col("perspective"), "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(F.col("kind") == "user", F.coalesce("role", F.lit("unknown")))
    head = F.when(F.col("kind") == "user", F.concat(F.lit("<|user name="), F.col("name"), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), F.col("kind"), F.lit("|>\n")))
    both = said.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of").withColumn("kind", kind).withColumn("name", name).withColumn("head", head)
    both = both.select("conv_id", "perspective", (F.length("head") + F.length("text") + 1).cast("long").alias("size"), F.length("head").cast("long").alias("head"), "turn", "role", "kind", "name", F.concat("head", "text", F.lit("\n")).alias("message"))
    both = stored(both, "rotated")
    order = ["conv_id", "perspective", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "message"]
    n = pieces(both, 32 << 20, int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *order, "row").sortWithinPartitions(*order, "row").drop("row")
    placed = stored(dealt.mapInArrow(_running, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields) + ", pid int, seq long, start_char long"), "placed")
    sums = placed.groupBy("conv_id", "perspective", "pid").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("pid").alias("at"), F.sum("n").over(before).alias("n"), F.sum("chars").over(before).alias("chars")).filter("n is not null")
    # one row at most for each border between ranges
    out = placed.join(F.broadcast(carried), (F.col("pid") == F.col("at")) & (F.col("perspective") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    start = F.col("start_char") + F.coalesce("chars", F.lit(0))
    end = start + F.col("size")
    own = F.col("kind") == "assistant"
    return out.select(
        "conv_id", "perspective", (F.col("seq") + F.coalesce("n", F.lit(0))).alias("seq"), "turn", "kind", "name", "message", start.alias("start_char"), end.alias("end_char"),
        F.when(own, start + F.col("head")).otherwise(end).alias("mask_start"), F.when(own, end - 1).otherwise(end).alias("mask_end"),
    )


def op7_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role <> 'system'),
k AS (SELECT t.*, perspective, CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS kind
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN kind = 'user' THEN coalesce(role, 'unknown') END AS name,
  '<|' || kind || CASE WHEN kind = 'user' THEN ' name=' || coalesce(role, 'unknown') ELSE '' END || '|>' || chr(10) AS head FROM k),
m AS (SELECT *, head || text || chr(10) AS message FROM h),
o AS (SELECT *, row_number() OVER w AS seq, cast(sum(length(message)) OVER w AS BIGINT) AS end_char FROM m
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, message ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, seq, turn, kind, name, message, end_char - length(message) AS start_char, end_char,
  CASE WHEN kind = 'assistant' THEN end_char - length(message) + length(head) ELSE end_char END AS mask_start,
  CASE WHEN kind = 'assistant' THEN end_char - 1 ELSE end_char END AS mask_end FROM o
"""
