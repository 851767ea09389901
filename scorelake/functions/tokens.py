"""Column functions over tokens: `note-C4#_quarter.`, `rest-half`, `clef-G2`, `keySignature-DM`, `timeSignature-/4`, `barline`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .music import QUARTER, adjusted_ticks, key_fifths, name_ticks

# Durations of the vocabulary by the first word of other spellings.
DURATION_SPELLINGS = {"second": "breve", "double": "breve", "quadruple": "breve", "thirty": "thirty_second", "sixty": "sixty_fourth", "hundred": "hundred_twenty_eighth"}
ACCIDENTALS = ["##", "#", "bb", "b", "N"]


def duration_modifier(duration: Column) -> Column:
    return F.when(duration.endswith("."), "dot").when(duration.endswith("³"), "triplet").otherwise("none")


def bare_duration(duration: Column) -> Column:
    return F.regexp_replace(duration, r"[.³]$", "")


def duration(text: Column) -> Column:
    """(base, modifier, ticks) of a duration with its modifier."""
    base, modifier = name_ticks(bare_duration(text)), duration_modifier(text)
    return F.struct(base.alias("base"), modifier.alias("modifier"), adjusted_ticks(base, modifier).alias("ticks"))


def _pitch_and_duration(token: Column) -> Column:
    parts = F.split(F.get(F.split(token, "-"), F.lit(1)), "_")
    length = F.concat_ws("_", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.struct(F.get(parts, F.lit(0)).alias("pitch"), length.alias("duration"))


def _read_note(x: Column) -> Column:
    pitch = x["pitch"]
    octave, mark = F.substring(pitch, 2, 1).try_cast("int"), F.substring(pitch, 3, 1)
    base, modifier = name_ticks(bare_duration(x["duration"])), duration_modifier(x["duration"])
    alter = F.when(mark == "b", -1).when(mark == "#", 1).when(mark != "", 0)
    full = F.struct(F.substring(pitch, 1, 1).alias("step"), octave.alias("octave"), alter.cast("int").alias("alter"), base.alias("base"), modifier.alias("modifier"), adjusted_ticks(base, modifier).alias("ticks"), (mark != "").alias("printed"))
    unread = F.struct(F.lit("C").alias("step"), F.lit(4).alias("octave"), F.lit(0).alias("alter"), F.lit(QUARTER).alias("base"), F.lit("none").alias("modifier"), F.lit(QUARTER).alias("ticks"), F.lit(False).alias("printed"))
    return F.when(octave.isNotNull(), full).otherwise(unread)


def notes(tokens: Column) -> Column:
    """(step, octave, alter, base, modifier, ticks, printed) of each note token of an array.

    The accidental is the third character of the pitch: # and b, anything else a natural. What can't be
    read is a natural C4 of a quarter.
    """
    return F.transform(F.transform(tokens, _pitch_and_duration), _read_note)


def note(token: Column) -> Column:
    """As `notes`, of one token."""
    return F.get(notes(F.array(token)), F.lit(0))


def rest(token: Column) -> Column:
    """(base, modifier, ticks) of a rest: only what stands between the first marks counts, so a name with _ has 1 tick."""
    return duration(F.get(F.split(F.get(F.split(token, r"\|"), F.lit(0)), "-|_"), F.lit(1)))


def chord(token: Column) -> Column:
    """(notes, length: (ticks, base, modifier)): the notes of a token and the shortest of its notes and rests.

    Without notes it starts from a quarter; the first of equally short ones counts, and a rest only if it is shorter.
    """
    parts = F.split(token, r"\|")
    found = notes(F.filter(parts, lambda p: p.startswith("note")))
    length = lambda x: F.struct(x["ticks"].alias("ticks"), x["base"].alias("base"), x["modifier"].alias("modifier"))
    rests = F.transform(F.transform(F.filter(parts, lambda p: p.startswith("rest")), rest), length)
    quarter = F.struct(F.lit(QUARTER).alias("ticks"), F.lit(QUARTER).alias("base"), F.lit("none").alias("modifier"))
    all_ = F.concat(F.when(F.size(found) > 0, F.transform(found, length)).otherwise(F.array(quarter)), rests)
    ordered = F.array_sort(F.transform(all_, lambda x, i: F.struct(x["ticks"].alias("ticks"), i.alias("i"), x.alias("x"))))
    return F.struct(found.alias("notes"), F.get(ordered, F.lit(0))["x"].alias("length"))


def clef_sign(token: Column) -> Column:
    """The sign; the line that the token gives is dropped."""
    return F.substring(F.get(F.split(token, "-"), F.lit(1)), 1, 1)


def key_of(token: Column) -> Column:
    """Sharps or flats of a key token, null if it isn't known."""
    return key_fifths(F.get(F.split(token, "-"), F.lit(1)))


def time_of(token: Column) -> Column:
    """(num, den): C is 4/4, C/ is 2/2, and otherwise only the denominator is told, over 1."""
    name = F.get(F.split(token, "-"), F.lit(1))
    num = F.when(name == "C", 4).when(name == "C/", 2).otherwise(1)
    den = F.when(name == "C", 4).when(name == "C/", 2).otherwise(F.substr(name, F.lit(2)).try_cast("int"))
    return F.struct(num.cast("int").alias("num"), den.cast("int").alias("den"))


def first_clef(tokens: Column) -> Column:
    """The first clef of a token string, as sign and digit; empty if there is none."""
    return F.regexp_extract(tokens, "clef-([A-G][0-9])", 1)


def flattened(token: Column) -> Column:
    """The pitches of a token without durations, sharps and flats. Naturals stay."""
    return F.transform(F.split(token, r"\|"), lambda p: F.translate(F.get(F.split(p, "_"), F.lit(0)), "#b", ""))


def note_rhythm(token: Column) -> Column:
    """The rhythm token of a note: its duration as the vocabulary spells it, with one dot at most; triplets are not told."""
    word = F.regexp_replace(F.get(F.split(token, "_"), F.lit(1)), r"[.³]", "")
    known = F.create_map(*(F.lit(x) for kv in DURATION_SPELLINGS.items() for x in kv))
    return F.concat(F.lit("note-"), F.coalesce(F.try_element_at(known, word), word), F.when(token.contains("."), ".").otherwise(""))


def other_rhythm(token: Column) -> Column:
    """The rhythm token of anything but a note."""
    plain = F.regexp_replace(F.regexp_replace(token, "rest-(double|quadruple)_whole", "multirest-2"), r"_fermata|\.|³", "")
    return F.when(plain.rlike(r"^(rest-whole|multirest-)\d"), rhythm_of_rest(plain)).when(plain.startswith("timeSignature-"), F.concat(F.lit("timeSignature-"), time_rhythm(F.substr(plain, F.lit(15))))).otherwise(plain)


def is_note(token: Column) -> Column:
    return token.startswith("note") | token.startswith("gracenote")


def note_pitch_name(token: Column) -> Column:
    """The pitch token of a note, without accidental; `nonote` for anything else."""
    name = F.get(F.split(F.get(F.split(token, "_"), F.lit(0)), "-"), F.lit(1))
    return F.when(is_note(token), F.concat(F.lit("note-"), F.translate(name, "#bN", ""))).otherwise("nonote")


def note_accidental(token: Column) -> Column:
    """#, b, N or empty for a note (doubles count as single), null for anything else."""
    name = F.get(F.split(token, "_"), F.lit(0))
    found = F.lit("")
    for mark in reversed(ACCIDENTALS):
        found = F.when(F.instr(name, mark) > 0, mark[0]).otherwise(found)
    return F.when(is_note(token), found)


def rhythm_of_rest(token: Column) -> Column:
    """Rests of whole measures as the vocabulary has them: 1 or fewer a whole rest, more than 10 ten."""
    count = F.regexp_extract(token, r"(\d+)$", 1).try_cast("int")
    return F.when(count <= 1, F.lit("rest-whole")).otherwise(F.concat(F.lit("multirest-"), F.least(count, F.lit(10)).cast("string")))


def time_rhythm(name: Column) -> Column:
    """The denominator alone: C is /4, C/ is /2, n/d is /d."""
    return F.when(name == "C", "/4").when(name == "C/", "/2").otherwise(F.concat(F.lit("/"), F.element_at(F.split(name, "/"), -1)))


def note_token(step: Column, octave: Column, alter: Column, duration_: Column) -> Column:
    """A note token; sharps, flats and naturals as #, b and N."""
    mark = F.when(alter == 1, "#").when(alter == -1, "b").when(alter == 0, "N").otherwise("")
    return F.concat(F.lit("note-"), step, octave.cast("string"), mark, F.lit("_"), duration_)

