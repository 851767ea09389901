"""Column functions over pitches, clefs, keys and durations.

A pitch is three columns: step (C..B), octave, alter, where a null alter means that nothing is printed
and 0 an explicit natural. Durations are ticks, 16 to a quarter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the notation.
STEPS = "CDEFGAB"
SHARP_ORDER, FLAT_ORDER = "FCGDAEB", "BEADGCF"
QUARTER = 16
KEY_NAMES = {-7: "CbM", -6: "GbM", -5: "DbM", -4: "AbM", -3: "EbM", -2: "BbM", -1: "FM", 0: "CM", 1: "GM", 2: "DM", 3: "AM", 4: "EM", 5: "BM", 6: "F#M", 7: "C#M"}
NAME_TICKS = {"whole": 64, "half": 32, "quarter": 16, "eighth": 8, "sixteenth": 4, "thirty_second": 2}
TICK_NAMES = {64: "whole", 32: "half", 16: "quarter", 8: "eighth", 4: "16th", 2: "32nd", 1: "64th"}
REFERENCES = {"G": ("C", 4), "F": ("E", 2), "C": ("C", 3)}
CLEF_LINES = {"G": 2, "F": 4, "C": 3}


def _lookup(values: dict, key: Column) -> Column:
    """The value of a key, null if there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def step_index(step: Column) -> Column:
    return F.instr(F.lit(STEPS), step) - 1


def step_name(index: Column) -> Column:
    return F.substring(F.lit(STEPS), index + 1, F.lit(1))


def in_key(step: Column, fifths: Column) -> Column:
    """Whether the key of so many sharps (flats, if negative) alters the step."""
    sharps = F.substring(F.lit(SHARP_ORDER), F.lit(1), F.greatest(fifths, F.lit(0)))
    flats = F.substring(F.lit(FLAT_ORDER), F.lit(1), F.greatest(-fifths, F.lit(0)))
    return F.instr(F.concat(sharps, flats), step) > 0


def key_alter(step: Column, fifths: Column) -> Column:
    """1 or -1 if the key alters the step, else null."""
    return F.when(in_key(step, fifths), F.when(fifths < 0, -1).otherwise(1)).cast("int")


def key_name(fifths: Column) -> Column:
    return _lookup(KEY_NAMES, fifths.cast("int"))


def key_fifths(name: Column) -> Column:
    """Null for a name that isn't a key."""
    return _lookup({v: k for k, v in KEY_NAMES.items()}, name)


def altered_pitches(fifths: Column) -> Column:
    """All pitches of octaves 0 to 10 that the key alters, as an array of names."""
    order = F.when(fifths >= 0, F.substring(F.lit(SHARP_ORDER), F.lit(1), fifths)).otherwise(F.substring(F.lit(FLAT_ORDER), F.lit(1), -fifths))
    steps = F.filter(F.split(order, ""), lambda s: s != "")
    return F.flatten(F.transform(steps, lambda s: F.transform(F.sequence(F.lit(0), F.lit(10)), lambda o: F.concat(s, o.cast("string")))))


def moved(step: Column, octave: Column, position: Column, fifths: Column) -> Column:
    """(step, octave, alter): the pitch so many positions above, altered by the key. Octaves count with floor division."""
    at = step_index(step) + position
    name = step_name(F.pmod(at, F.lit(7)))
    return F.struct(name.alias("step"), (octave + F.floor(at / 7)).cast("int").alias("octave"), key_alter(name, fifths).alias("alter"))


def reference_step(sign: Column) -> Column:
    return _lookup({k: v[0] for k, v in REFERENCES.items()}, F.upper(sign))


def reference_octave(sign: Column) -> Column:
    return _lookup({k: v[1] for k, v in REFERENCES.items()}, F.upper(sign))


def clef_line(sign: Column) -> Column:
    """The line of a clef's sign; null for a lower-case sign."""
    return _lookup(CLEF_LINES, sign)


def note_pitch(sign: Column, position: Column, fifths: Column) -> Column:
    """The pitch of a note at a staff position under a clef; positions count from one below the reference."""
    return moved(reference_step(sign), reference_octave(sign), position + 1, fifths)


def relative_position(step: Column, octave: Column, from_step: Column, from_octave: Column) -> Column:
    """Diatonic steps from one pitch to another."""
    return (octave - from_octave) * 7 + step_index(step) - step_index(from_step)


def from_relative(step: Column, octave: Column, relative: Column) -> Column:
    """(step, octave) at a relative position.

    The octave follows the rule octave + |relative - index| // 6 * sign(relative), index being that of the
    new step; from E it is one octave low for relative 5 to 11.
    """
    index = F.pmod(step_index(step) + relative, F.lit(7))
    rise = F.floor(F.abs(relative - index) / 6) * F.signum(relative.cast("double"))
    return F.struct(step_name(index).alias("step"), (octave + rise).cast("int").alias("octave"))


def moved_by_steps(step: Column, octave: Column, steps: Column) -> Column:
    """(step, octave) so many steps away, by the rule of `from_relative`."""
    return from_relative(step, octave, steps)


def moved_to_clef(step: Column, octave: Column, sign: Column, new_sign: Column) -> Column:
    """(step, octave) of the same staff position under another clef; unchanged where either clef is null or both are equal."""
    relative = relative_position(step, octave, reference_step(sign), reference_octave(sign))
    same = F.struct(step.alias("step"), octave.cast("int").alias("octave"))
    return F.when(sign.isNull() | new_sign.isNull() | (sign == new_sign), same).otherwise(from_relative(reference_step(new_sign), reference_octave(new_sign), relative))


def adjusted_ticks(base: Column, modifier: Column) -> Column:
    """Ticks with a dot (half more) or in a triplet (a third less), in whole numbers."""
    return F.when(modifier == "dot", F.floor(base * 3 / 2)).when(modifier == "triplet", F.floor(base * 2 / 3)).otherwise(base).cast("int")


def duration_name(base: Column) -> Column:
    """The written name of unmodified ticks; a quarter if there is none."""
    return F.coalesce(_lookup(TICK_NAMES, base.cast("int")), F.lit("quarter"))


def name_ticks(name: Column) -> Column:
    """The ticks of a duration name; any other name has 1."""
    return F.coalesce(_lookup(NAME_TICKS, name), F.lit(1)).cast("int")


def alter_mark(alter: Column) -> Column:
    return F.when(alter == 1, "#").when(alter == -1, "b").when(alter == 0, "♮").otherwise("")


def pitch_text(step: Column, octave: Column, alter: Column) -> Column:
    return F.concat(step, octave.cast("string"), alter_mark(alter))


def duration_text(base: Column, modifier: Column) -> Column:
    """The name with its modifier: a point for a dot, a raised 3 for a triplet."""
    return F.concat(duration_name(base), F.when(modifier == "dot", ".").when(modifier == "triplet", "³").otherwise(""))


def surplus(n: Column) -> Column:
    return F.greatest(n - 1, F.lit(0))


def part_id(index: Column) -> Column:
    return F.concat(F.lit("P"), (index + 1).cast("string"))
