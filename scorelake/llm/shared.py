"""What the operators of this subpackage share: distributed ranks, joins of hot keys, bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.sources.tables import join_entries, materialize, shared_folder

__all__ = ["bits_for", "free_names", "flipped", "in_bitmap", "join_entries", "materialize", "prefix", "ranked", "salted", "shared_folder", "text_or_empty"]


def text_or_empty(df: DataFrame, text_col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def free_names(columns: list[str], taken: list[str]) -> list[str]:
    """The names of columns; those that are taken, whatever their case, get as many "_" as make them free."""
    used = {c.lower() for c in taken} | {c.lower() for c in columns if c.lower() not in {t.lower() for t in taken}}
    names = []
    for c in columns:
        if c.lower() in {t.lower() for t in taken}:
            while c.lower() in used:
                c += "_"
            used.add(c.lower())
        names.append(c)
    return names


def flipped(column: Column) -> Column:
    """Signed order of the result is the unsigned order of the 64-bit column."""
    return column.bitwiseXOR(F.lit(-(2**63)))


def prefix(column: Column, bits: int) -> Column:
    """The first bits of a 64-bit column, as a number from 0."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(column, 64 - bits)


def bits_for(rows: int, per_bucket: int) -> int:
    """So many bits that buckets of that many hash bits hold about per_bucket rows."""
    return min(40, max(0, -(-rows // max(1, per_bucket)) - 1).bit_length())


def ranked(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str = "rank") -> DataFrame:
    """Adds each row's gapless rank from 0 among the rows of its keys, in the order of bucket, then order.

    No task holds a whole key: rows are ranked inside (keys, bucket), and a table of the
    buckets' row counts gives the ranks before each. bucket must be coarse and follow the
    wanted order; df is read twice, so pass a table that gives the same rows each time.
    Keys and bucket must not be null.
    """
    offsets = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return df.join(offsets, [*keys, bucket]).withColumn(name, F.col("_before") + F.row_number().over(inside) - 1).drop("_before")


def salted(rows: DataFrame, entries: DataFrame, key: str, n_rows: int, share: int = 1000) -> DataFrame:
    """Inner join of rows with entries, which have one row for each key; no task gets many rows of one key.

    Keys of more than n_rows / share rows, fewer than share of them, are cut into parts of about so many rows, and their
    entries repeated for each. For entries that are too large to be broadcast; rows is read twice. Keys must not be null.
    """
    least = max(64, n_rows // share + 1)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least)
    hot = F.broadcast(hot.select(key, F.ceil(F.col("_n") / least).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return dealt.join(entries.join(hot, key, "left").withColumn("_part", parts).drop("_parts"), [key, "_part"]).drop("_part")


def in_bitmap(wanted: DataFrame, column: str, probe: Column, bits: int = 18) -> Column:
    """False only where probe is not among wanted's values: a bitmap of 2**bits cells, whatever wanted's size.

    The bitmap is a scalar subquery. As a literal, its words would be so many expressions in each version of the plan and
    be printed in each of its descriptions, which the driver keeps.
    """
    c = F.pmod(F.col(column), F.lit(1 << bits))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    zeros = wanted.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
    words = wanted.select(F.shiftright(c, 6).alias("at"), mask.alias("word")).unionByName(zeros).groupBy("at").agg(F.bit_or("word").alias("word"))
    table = words.agg(F.sort_array(F.collect_list(F.struct("at", "word")))["word"].alias("bitmap")).scalar()
    cell = F.pmod(probe, F.lit(1 << bits)).cast("int")
    return F.getbit(F.get(table, F.shiftright(cell, 6)), cell.bitwiseAND(F.lit(63))) == 1
