"""Symbols, boxes and pages derived from the driver's tables by integer arithmetic.

The tables hold no music. The same arithmetic in Spark and in SQL makes streams of symbols of `events`
(a staff for each user) and boxes of `lineitem`; this proves the operators' rules at scale, not
recognition quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """staff_id, seq, event_type, event_id, cents."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("staff_id"), F.row_number().over(w).alias("seq"), "event_type", "event_id", F.bround(F.col("value") * 100, 0).cast("long").alias("cents"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of symbols for each user; see `operators.rules`."""
    c, t = F.col("cents"), F.col("event_type")
    kind = F.when(t == "signup", "clef").when(t == "error", "barline").when((t == "view") & (c % 11 == 0), "time").when(t == "view", "rest").otherwise("note")
    ev = ordered_events(spark, sf_dir).withColumn("kind", kind)
    of = lambda k, v: F.when(F.col("kind") == k, v)
    pick = lambda s, n: F.substring(F.lit(s), (c % n + 1).cast("int"), F.lit(1))
    alter = F.when(c % 5 == 2, 1).when(c % 5 == 3, -1).when(c % 5 == 4, 0)
    return ev.select(
        "staff_id",
        "seq",
        "kind",
        of("clef", pick("GFC", 3)).alias("sign"),
        of("clef", (c % 15 - 7).cast("int")).alias("fifths"),
        of("time", F.lit(1)).cast("int").alias("num"),
        of("time", F.when(c % 2 == 0, 4).otherwise(2)).cast("int").alias("den"),
        of("note", pick("CDEFGAB", 7)).alias("step"),
        of("note", 3 + c % 4).cast("int").alias("octave"),
        of("note", alter).cast("int").alias("alter"),
        F.when(F.col("kind").isin("note", "rest"), F.pow(F.lit(2.0), c % 7)).cast("int").alias("base"),
        F.when(F.col("kind").isin("note", "rest"), F.when(c % 9 == 0, "dot").when(c % 10 == 0, "triplet").otherwise("none")).alias("modifier"),
        "cents",
    ).withColumn("ticks", F.when(F.col("modifier") == "dot", F.floor(F.col("base") * 3 / 2)).when(F.col("modifier") == "triplet", F.floor(F.col("base") * 2 / 3)).otherwise(F.col("base")).cast("int"))


SYMBOLS_SQL = """
ev AS (SELECT user_id AS staff_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS int) AS seq, event_type, event_id,
              CAST(round_even(value * 100, 0) AS bigint) AS cents FROM events),
kinds AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'clef' WHEN event_type = 'error' THEN 'barline'
                 WHEN event_type = 'view' AND cents % 11 = 0 THEN 'time' WHEN event_type = 'view' THEN 'rest' ELSE 'note' END AS kind FROM ev),
sym0 AS (SELECT staff_id, seq, kind, cents,
  CASE WHEN kind = 'clef' THEN substr('GFC', CAST(cents % 3 + 1 AS int), 1) END AS sign,
  CASE WHEN kind = 'clef' THEN CAST(cents % 15 - 7 AS int) END AS fifths,
  CASE WHEN kind = 'time' THEN 1 END AS num, CASE WHEN kind = 'time' THEN CASE WHEN cents % 2 = 0 THEN 4 ELSE 2 END END AS den,
  CASE WHEN kind = 'note' THEN substr('CDEFGAB', CAST(cents % 7 + 1 AS int), 1) END AS step,
  CASE WHEN kind = 'note' THEN CAST(3 + cents % 4 AS int) END AS octave,
  CASE WHEN kind = 'note' THEN CASE cents % 5 WHEN 2 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN 0 END END AS alter_in,
  CASE WHEN kind IN ('note', 'rest') THEN CAST(pow(2, cents % 7) AS int) END AS base,
  CASE WHEN kind IN ('note', 'rest') THEN CASE WHEN cents % 9 = 0 THEN 'dot' WHEN cents % 10 = 0 THEN 'triplet' ELSE 'none' END END AS modifier FROM kinds),
sym AS (SELECT *, CAST(CASE modifier WHEN 'dot' THEN floor(base * 3 / 2) WHEN 'triplet' THEN floor(base * 2 / 3) ELSE base END AS int) AS ticks FROM sym0),
seg AS (SELECT *, sum(CAST(kind = 'barline' AS int)) OVER so_far AS measure_no, sum(CAST(kind = 'clef' AS int)) OVER so_far AS clef_no
        FROM sym WINDOW so_far AS (PARTITION BY staff_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
"""


def boxes(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Boxes on pages (one for each hundred orders): page_id, box_id, cx, cy, w, h, x1, y1, x2, y2, all whole numbers; perhaps dealt by page to so many tasks."""
    li = table(spark, sf_dir, "lineitem")
    page = F.floor(F.col("l_orderkey") / 100).alias("page_id")
    if tasks:
        li = li.select(page, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition(tasks, "page_id")
        page = F.col("page_id")
    li = li.groupBy(*([page] if tasks else []), "l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity")))
    df = li.select(
        page,
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box_id"),
        ((F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 2000).alias("x1"),
        ((F.col("l_suppkey") * 53 + F.col("l_orderkey") * 7) % 3000).alias("y1"),
        (F.col("l_quantity").cast("long") + 4).alias("w"),
        ((F.col("l_partkey") % 40) + 6).alias("h"),
    )
    return df.withColumns({"x2": F.col("x1") + F.col("w"), "y2": F.col("y1") + F.col("h")})


BOXES_SQL = """
boxes AS (SELECT *, x1 + w AS x2, y1 + h AS y2 FROM (
  SELECT CAST(floor(l_orderkey / 100) AS bigint) AS page_id, l_orderkey * 10 + l_linenumber AS box_id,
         (l_partkey * 37 + l_linenumber * 11) % 2000 AS x1, (l_suppkey * 53 + l_orderkey * 7) % 3000 AS y1,
         CAST(l_quantity AS bigint) + 4 AS w, l_partkey % 40 + 6 AS h
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)))
"""
