"""Token strings: `a+b|c+barline`, where + separates steps and | stacks a chord."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import music, tokens

KEYS = ("staff_id",)


def parse(strings: DataFrame, keys=KEYS, column: str = "tokens") -> DataFrame:
    """Symbols (see `rules`) of token strings, one row for each note of a chord: seq, chord_pos, measure_no, kind, ...

    Rests and chords without notes have one row; its base, modifier and ticks are the chord's, the notes' own are in note_base, note_modifier and note_ticks.
    A key counts only right after a clef of the same measure; it has no row. Multirests and unknown tokens go.
    """
    parts = strings.select(*keys, F.posexplode(F.split(column, r"\+")).alias("pos", "token"))
    w = Window.partitionBy(*keys).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("token")
    kind = (
        F.when(t == "barline", "barline")
        .when(t.startswith("keySignature"), "key")
        .when(t.startswith("multirest"), None)
        .when(t.startswith("note") | t.contains("|"), "note")
        .when(t.startswith("clef"), "clef")
        .when(t.startswith("timeSignature"), "time")
        .when(t.startswith("rest"), "rest")
    )
    parts = parts.withColumn("kind", kind).filter("kind is not null")
    parts = parts.withColumn("measure_no", F.sum((F.col("kind") == "barline").cast("int")).over(so_far).cast("int"))
    # what a key can follow: the symbol before it, other keys left out
    parts = parts.withColumn("_block", F.sum((F.col("kind") != "key").cast("int")).over(so_far))
    key = F.when(F.col("kind") == "key", tokens.key_of(t))
    parts = parts.withColumn("_key", F.last(key, ignorenulls=True).over(Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    parts = parts.filter("kind <> 'key'")
    of = lambda k, value: F.when(F.col("kind") == k, value)
    time, rest, chord = tokens.time_of(t), tokens.rest(t), tokens.chord(t)
    parts = parts.withColumns({"_time": of("time", time), "_rest": of("rest", rest), "_chord": of("note", chord)})
    parts = parts.select(
        *keys,
        F.col("pos").alias("seq"),
        "kind",
        "measure_no",
        of("clef", tokens.clef_sign(t)).alias("sign"),
        of("clef", F.coalesce("_key", F.lit(0))).cast("int").alias("fifths"),
        F.col("_time.num").alias("num"),
        F.col("_time.den").alias("den"),
        F.coalesce("_rest.base", "_chord.length.base").alias("base"),
        F.coalesce("_rest.modifier", "_chord.length.modifier").alias("modifier"),
        F.coalesce("_rest.ticks", "_chord.length.ticks").alias("ticks"),
        F.posexplode_outer("_chord.notes").alias("chord_pos", "_note"),
    )
    kind = F.when((F.col("kind") == "note") & F.col("_note").isNull(), "rest").otherwise(F.col("kind"))
    return parts.select(*keys, "seq", F.coalesce("chord_pos", F.lit(0)).alias("chord_pos"), kind.alias("kind"), "measure_no", "sign", "fifths", "num", "den", "_note.step", "_note.octave", "_note.alter", "base", "modifier", "ticks", *(F.col(f"_note.{c}").alias(f"note_{c}") for c in ("base", "modifier", "ticks")))


def counted(strings: DataFrame, keys=KEYS, column: str = "tokens") -> DataFrame:
    """(keys, n_clefs, n_keys, n_times, n_accidentals): symbols of a token string; the alters of its keys count as accidentals."""
    symbols = parse(strings, keys, column)
    parts = strings.select(*keys, F.explode(F.split(column, r"\+|\|")).alias("t"))
    printed = parts.groupBy(*keys).agg(F.count_if(tokens.is_note(F.col("t")) & tokens.note(F.col("t"))["printed"]).alias("n_printed"))
    has_key = (F.col("kind") == "clef") & (F.col("fifths") != 0)
    found = symbols.groupBy(*keys).agg(F.count_if(F.col("kind") == "clef").alias("n_clefs"), F.count_if(has_key).alias("n_keys"), F.count_if(F.col("kind") == "time").alias("n_times"), F.coalesce(F.sum(F.abs("fifths")), F.lit(0)).alias("_of_keys"))
    return found.join(printed, [*keys]).select(*keys, "n_clefs", "n_keys", "n_times", (F.col("n_printed") + F.col("_of_keys")).alias("n_accidentals"))


def vocabulary(spark) -> DataFrame:
    """(family, token, id) of pitches, lifts and notes: built from their rule, C0 to B9 and then C10, rising."""
    pitches = ["nonote", *(f"note-{s}{o}" for o in range(10) for s in music.STEPS)][:71]
    lifts = ["nonote", "lift_null", "lift_#", "lift_b", "lift_N"]
    rows = [("pitch", t, k) for k, t in enumerate(pitches)] + [("lift", t, k) for k, t in enumerate(lifts)] + [("note", "nonote", 0), ("note", "note", 1)]
    return spark.createDataFrame(rows, "family string, token string, id int")


def looked_up(df: DataFrame, vocab: DataFrame, family: str, column: str = "token", default: int = 0) -> DataFrame:
    """Adds <column>_id; a token that isn't in the family gets the default. The vocabulary has some hundred rows."""
    ids = vocab.filter(F.col("family") == family).select(F.col("token").alias(column), F.col("id").alias(f"{column}_id"))
    return df.join(F.broadcast(ids), column, "left").withColumn(f"{column}_id", F.coalesce(f"{column}_id", F.lit(default)))


def detokenized(df: DataFrame, vocab: DataFrame, family: str, special=(0, 1, 2)) -> DataFrame:
    """Tokens of ids, without those that only mark the start, the end and padding."""
    names = vocab.filter(F.col("family") == family).select("id", "token")
    return df.filter(~F.col("id").isin(*special)).join(F.broadcast(names), "id")


def _pitch_order(symbol):
    """The sort key of a chord's member: highest pitch first, then what isn't a pitch."""
    name = F.translate(F.get(F.split(symbol, "_"), F.lit(0)), "#bN", "")
    octave = F.substring(name, 7, 2).try_cast("int")
    return F.when(name.startswith("note-") & octave.isNotNull(), -(octave * 7 + music.step_index(F.substring(name, 6, 1)))).otherwise(1000)


def merge(triples: DataFrame, keys=KEYS, keep_all: bool = False) -> DataFrame:
    """(keys, tokens) of (keys, pos, rhythm, pitch, lift).

    A | makes the next symbol part of the chord before it. A stream that starts with | loses all its symbols,
    as the chord they wait for never comes. A second, different clef is dropped. In a chord of several
    only notes stay (unless keep_all), highest pitch first.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    clef = F.col("rhythm").contains("clef") & ~F.col("rhythm").contains("note")
    rows = triples.withColumn("_first_clef", F.first(F.when(clef, F.col("rhythm")), ignorenulls=True).over(so_far))
    rows = rows.filter((~clef) | (F.col("rhythm") == F.col("_first_clef")))
    rows = rows.withColumn("_lost", F.first(F.col("rhythm")).over(so_far) == "|").filter("not _lost")
    stacked = F.lag("rhythm").over(w) == "|"
    rows = rows.withColumn("_stacked", F.coalesce(stacked, F.lit(False))).filter("rhythm <> '|'")
    mark = F.when(F.col("lift").isin("lift_##", "lift_#", "lift_bb", "lift_b", "lift_N"), F.substr("lift", F.lit(6))).otherwise("")
    symbol = F.when(F.col("rhythm").contains("note"), F.concat(F.col("pitch"), mark, F.lit("_"), F.regexp_extract("rhythm", "^.*note-(.*)$", 1))).otherwise(F.col("rhythm"))
    rows = rows.withColumn("_symbol", symbol).withColumn("_step", F.sum((~F.col("_stacked")).cast("int")).over(so_far))
    members = F.array_sort(F.collect_list(F.struct("pos", "_symbol")))
    chords = rows.groupBy(*keys, "_step").agg(members.alias("m"))
    names = F.transform("m", lambda x: x["_symbol"])
    kept = names if keep_all else F.filter(names, lambda s: s.startswith("note"))
    ranked = F.array_sort(F.transform(kept, lambda s, i: F.struct(_pitch_order(s).alias("o"), i.alias("i"), s.alias("s"))))
    chord = F.when(F.size("m") == 1, F.get(names, F.lit(0))).otherwise(F.array_join(F.transform(ranked, lambda x: x["s"]), "|"))
    chords = chords.select(*keys, "_step", chord.alias("c"))
    return chords.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_step", "c"))), lambda x: x["c"]), "+").alias("tokens"))


def _exploded(strings: DataFrame, keys, column: str) -> DataFrame:
    """One row for each symbol: step (time step), place (in the chord), symbol."""
    steps = strings.select(*keys, F.posexplode(F.split(F.trim(column), r"\s+|\+")).alias("step_no", "_chord"))
    return steps.select(*keys, "step_no", F.posexplode(F.split("_chord", r"\|")).alias("place", "symbol"))


def with_printed_accidentals(strings: DataFrame, keys=KEYS, column: str = "tokens", keyed: bool = True) -> DataFrame:
    """One row for each symbol with printed: the accidental that shows, because it differs from what holds.

    keyed: notes tell how they sound; what holds at first is the key, then the alter of the last note of that
    name and octave in the measure. Else notes tell what is printed, and only repetitions are left out.
    """
    rows = _exploded(strings, keys, column)
    order = Window.partitionBy(*keys).orderBy("step_no", "place")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    key = F.when(F.col("symbol").startswith("keySignature"), F.coalesce(tokens.key_of(F.col("symbol")), F.lit(0)))
    rows = rows.withColumns(
        {
            "_key": F.coalesce(F.last(key, ignorenulls=True).over(so_far), F.lit(0)),
            # what holds is forgotten at barlines and at a new key
            "_part": F.sum((F.col("symbol").startswith("keySignature") | (F.col("symbol") == "barline")).cast("int")).over(so_far),
            "_alter": tokens.note_accidental(F.col("symbol")),
            "_name": F.substring(tokens.note_pitch_name(F.col("symbol")), 6, 2),
        }
    )
    before = Window.partitionBy(*keys, "_part", "_name", F.col("_alter").isNotNull()).orderBy("step_no", "place")
    if keyed:
        by_key = F.when(music.in_key(F.substring("_name", 1, 1), F.col("_key")), F.when(F.col("_key") < 0, "b").otherwise("#")).otherwise("N")
        sounds = F.when(F.col("_alter") == "", "N").otherwise(F.col("_alter"))
        printed = F.when(sounds != F.coalesce(F.lag(sounds).over(before), by_key), sounds).otherwise("")
    else:
        last = F.last(F.when(F.col("_alter") != "", F.col("_alter")), ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
        printed = F.when((F.col("_alter") != "") & ~F.col("_alter").eqNullSafe(last), F.col("_alter")).otherwise("")
    return rows.withColumn("printed", F.when(F.col("_alter").isNotNull(), printed)).drop("_key", "_part", "_alter", "_name")


def split(strings: DataFrame, keys=KEYS, column: str = "tokens", keyed: bool = True) -> DataFrame:
    """(keys, pos, rhythm, pitch, lift, note): the four streams of token strings; ties go, and chords are sorted, highest pitch first."""
    rows = with_printed_accidentals(strings, keys, column, keyed).filter("symbol <> 'tie'")
    s = F.col("symbol")
    note = tokens.is_note(s)
    lift = F.when(F.col("printed").isNull(), "nonote").when(F.col("printed") == "", "lift_null").otherwise(F.concat(F.lit("lift_"), F.col("printed")))
    rows = rows.select(*keys, "step_no", "place", F.when(note, tokens.note_rhythm(s)).otherwise(tokens.other_rhythm(s)).alias("rhythm"), tokens.note_pitch_name(s).alias("pitch"), lift.alias("lift"), F.when(note, "note").otherwise("nonote").alias("note"), _pitch_order(s).alias("_rank"))
    member = F.col("rhythm").startswith("note") | F.col("rhythm").startswith("rest")
    # runs of notes and rests in a chord are sorted, other symbols keep their place
    chord = Window.partitionBy(*keys, "step_no").orderBy("place")
    run = F.sum((~member).cast("int")).over(chord)
    rows = rows.withColumns({"_run": run, "_member": member})
    rank = F.row_number().over(Window.partitionBy(*keys, "step_no", "_run", "_member").orderBy(F.when(F.col("_member"), F.col("_rank")).otherwise(0), "place"))
    start = F.min("place").over(Window.partitionBy(*keys, "step_no", "_run", "_member"))
    rows = rows.withColumn("_place", start + rank - 1)
    # a | stands before each further member
    bar = F.when(F.col("_place") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    rows = rows.withColumn("_half", F.explode(bar))
    streams = {c: F.when(F.col("_half") == 0, "|" if c == "rhythm" else "nonote").otherwise(F.col(c)) for c in ("rhythm", "pitch", "lift", "note")}
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("step_no", "_place", "_half")) - 1
    return rows.select(*keys, pos.alias("pos"), *(v.alias(c) for c, v in streams.items()))


def with_accidentals(strings: DataFrame, keys=KEYS, column: str = "tokens") -> DataFrame:
    """(keys, tokens): token strings in which notes tell what is printed instead of how they sound."""
    rows = with_printed_accidentals(strings, keys, column)
    s = F.col("symbol")
    parts = F.split(s, "_")
    name = F.concat(F.translate(F.get(parts, F.lit(0)), "N#b", ""), F.col("printed"), F.lit("_"), F.get(parts, F.lit(1)))
    rows = rows.withColumn("symbol", F.when(F.col("printed").isNotNull(), name).otherwise(s))
    chords = rows.groupBy(*keys, "step_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]), "|").alias("c"))
    return chords.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "c"))), lambda x: x["c"]), "+").alias("tokens"))


def transcribed(images: DataFrame, model, schema: str = "staff_id long, attempt int, tokens string") -> DataFrame:
    """Runs a pluggable model over rows of images: model() is called once in each task and gives a function of a pandas frame."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = model()
        for pdf in frames:
            yield ready(pdf)

    return images.mapInPandas(run, schema)
