"""Rules over ordered symbols: measures, carried accidentals, keys, clefs, time signatures.

A table of symbols has the columns of a stream (`keys`, usually a staff), seq and kind (clef, time,
note, rest, barline), and those that a kind needs: sign and fifths, num and den, step, octave and
alter, ticks. All rules are windows over a stream in the order of seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import music

KEYS = ("staff_id",)


def _so_far(keys, *more):
    return Window.partitionBy(*keys, *more).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def _running(condition: Column, window) -> Column:
    return F.sum(condition.cast("int")).over(window).cast("int")


def segmented(symbols: DataFrame, keys=KEYS) -> DataFrame:
    """Adds measure_no and clef_no, the numbers of barlines and clefs so far."""
    w = _so_far(keys)
    return symbols.withColumns({"measure_no": _running(F.col("kind") == "barline", w), "clef_no": _running(F.col("kind") == "clef", w)})


def with_carried_accidentals(symbols: DataFrame, keys=KEYS) -> DataFrame:
    """Adds carried: the last alter printed for the same pitch since the last barline and clef, 0 included."""
    w = _so_far(keys, "measure_no", "clef_no", "step", "octave")
    return symbols.withColumn("carried", F.when(F.col("kind") == "note", F.last("alter", ignorenulls=True).over(w)))


def with_sounding_alters(symbols: DataFrame, keys=KEYS) -> DataFrame:
    """Adds alter_out: the carried alter, else that of the last clef's key; the key holds across barlines."""
    symbols = with_carried_accidentals(segmented(symbols, keys), keys)
    key = F.coalesce(F.max("fifths").over(Window.partitionBy(*keys, "clef_no")), F.lit(0))
    return symbols.withColumn("key", key).withColumn("alter_out", F.coalesce("carried", F.when(F.col("kind") == "note", music.key_alter(F.col("step"), F.col("key")))))


def without_redundant_clefs(symbols: DataFrame, keys=KEYS) -> DataFrame:
    """Drops a clef with the sign and key of the clef before it (which is the last one kept)."""
    w = Window.partitionBy(*keys, F.col("kind") == "clef").orderBy("seq")
    same = F.lag("sign").over(w).eqNullSafe(F.col("sign")) & F.lag("fifths").over(w).eqNullSafe(F.col("fifths")) & (F.row_number().over(w) > 1)
    return symbols.withColumn("_same", same & (F.col("kind") == "clef")).filter("not _same").drop("_same")


def first_time_signature_only(symbols: DataFrame, keys=KEYS) -> DataFrame:
    """Drops every time signature of a stream but the first."""
    w = Window.partitionBy(*keys, F.col("kind") == "time").orderBy("seq")
    return symbols.withColumn("_n", F.row_number().over(w)).filter("kind <> 'time' or _n = 1").drop("_n")


def dominant(symbols: DataFrame, value: str, keys=KEYS) -> DataFrame:
    """(keys, value, n): the most frequent value of the clefs, the earliest of equally frequent ones; only if it occurs twice."""
    counts = symbols.filter("kind = 'clef'").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("_first"))
    best = counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("b"))
    return best.select(*keys, f"b.{value}", "b.n").filter("n >= 2")


def with_dominant_key(symbols: DataFrame, keys=KEYS) -> DataFrame:
    """All clefs of a stream get its dominant key, if there is one."""
    best = dominant(symbols, "fifths", keys).select(*keys, F.col("fifths").alias("_key"))
    fifths = F.when(F.col("kind") == "clef", F.coalesce("_key", "fifths")).otherwise(F.col("fifths"))
    return symbols.join(best, [*keys], "left").withColumn("fifths", fifths).drop("_key")


def with_dominant_clef(symbols: DataFrame, keys=KEYS) -> DataFrame:
    """All clefs get the dominant sign; notes keep their staff position, read under their own clef before.

    Notes ahead of the first clef, and streams without a dominant sign, stay as they are.
    """
    best = dominant(symbols, "sign", keys).select(*keys, F.col("sign").alias("_sign"))
    own = F.last("sign", ignorenulls=True).over(_so_far(keys))
    symbols = symbols.join(best, [*keys], "left").withColumn("_own", own)
    pitch = music.moved_to_clef(F.col("step"), F.col("octave"), F.col("_own"), F.col("_sign"))
    note = F.col("kind") == "note"
    symbols = symbols.withColumn("_pitch", F.when(note, pitch))
    changed = {"step": F.when(note, F.col("_pitch.step")).otherwise(F.col("step")), "octave": F.when(note, F.col("_pitch.octave")).otherwise(F.col("octave")), "sign": F.when(F.col("kind") == "clef", F.coalesce("_sign", "sign")).otherwise(F.col("sign"))}
    return symbols.withColumns(changed).drop("_sign", "_own", "_pitch")


def measure_lengths(symbols: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, measure_no, length): ticks of each measure that has symbols."""
    return segmented(symbols, keys).filter("kind <> 'barline'").groupBy(*keys, "measure_no").agg(F.coalesce(F.sum("ticks"), F.lit(0)).cast("int").alias("length"))


def measure_statistics(symbols: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, n_measures, length_std of the population, length_median)."""
    return measure_lengths(symbols, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_measures"), F.stddev_pop("length").alias("length_std"), F.median("length").alias("length_median"))


def with_filled_time_signatures(symbols: DataFrame, keys=KEYS) -> DataFrame:
    """Every time signature gets the numerator that the median length of a measure tells, halves to the even one."""
    stats = measure_statistics(symbols, keys).select(*keys, "length_median")
    num = F.bround(F.col("length_median") / (F.lit(4) / F.col("den") * music.QUARTER), 0).cast("int")
    return symbols.join(stats, [*keys], "left").withColumn("num", F.when(F.col("kind") == "time", num).otherwise(F.col("num"))).drop("length_median")


def without_empty_measures(symbols: DataFrame, measure=("measure_no",), keys=KEYS) -> DataFrame:
    """Drops rows of measures in which nothing but a barline is; a flag on such a measure is lost with it."""
    w = Window.partitionBy(*keys, *measure)
    return symbols.withColumn("_n", F.sum((F.col("kind") != "barline").cast("int")).over(w)).filter("_n > 0").drop("_n")


def with_break_flags(measures: DataFrame, voice=("voice",), system="system_no", page="page_no", order="measure_no") -> DataFrame:
    """Adds new_line for the first measure of a voice on each system, and new_page for that of the first voice on each page but the first."""
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(system, order)) == 1
    return measures.withColumns({"new_line": first(page, *voice, system), "new_page": first(page, *voice) & (F.col(page) > 0) & (F.col(voice[0]) == 0)})


def numbered_measures(measures: DataFrame, part=("voice",), order=("page_no", "system_no", "measure_no")) -> DataFrame:
    """Adds number, from 1 in each part."""
    return measures.withColumn("number", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def with_emitted_attributes(measures: DataFrame, values=("sign", "fifths"), flag="new_line", keys=KEYS, order="seq") -> DataFrame:
    """Adds emit: whether a clef or time signature is written, because it is the first, starts a system, or changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = ~F.lit(True)
    for v in values:
        changed = changed | ~F.lag(v).over(w).eqNullSafe(F.col(v))
    return measures.withColumn("emit", (F.row_number().over(w) == 1) | F.col(flag) | changed)
