"""Sampled generation against a loop with a merger, and its frequencies against the softmax."""

import math
import random
from collections import Counter

import pytest

from scorelake.operators import codec, sampling

SCHEMA = "staff_id long, step long, attempt int, rhythm string, pitch string, lift string"


def loop(steps, attempts=5):
    """One staff: [(step, attempt, rhythm, pitch, lift, merged)]; steps: lists of attempts in order."""
    empty, waits, clef, out = True, False, None, []
    for n, tries in enumerate(steps):
        merged = False
        for a, (rhythm, pitch, lift) in enumerate(tries):
            if rhythm in ("[EOS]", "[BOS]", "[PAD]"):
                break
            if rhythm == "|":
                waits = True
                refused = empty
            elif "clef" in rhythm and "note" not in rhythm and clef and clef != rhythm:
                refused = True
            else:
                refused = False
                if "clef" in rhythm and "note" not in rhythm:
                    clef = rhythm
                if not (waits and empty):
                    empty, waits = False, False
                    merged = True
            if not refused:
                merged = merged or rhythm == "|"
                break
        if rhythm == "[EOS]":
            break
        out.append((n, a, rhythm, pitch, lift, merged))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_attempts_count_as_in_a_loop(spark, seed):
    """Staffs that begin with |, with pads, with several clefs, and steps on which all attempts are refused."""
    rng = random.Random(seed)
    names = ["|", "|", "clef-G2", "clef-F4", "clef-C3", "note-quarter", "rest-half", "[PAD]", "[BOS]", "[EOS]"]
    rows, want = [], []
    for staff in range(300):
        weights = [rng.random() ** 3 for _ in names[:-1]] + [0.05]
        steps = [[(rng.choices(names, weights)[0], f"note-C{rng.randrange(9)}", "lift_#") for _ in range(5)] for _ in range(rng.randrange(1, 14))]
        rows += [(staff, n, a, *t) for n, tries in enumerate(steps) for a, t in enumerate(tries)]
        want += [(staff, *r) for r in loop(steps)]
    out = sampling.accepted(spark.createDataFrame(rows, SCHEMA)).select("staff_id", "step", "attempt", "rhythm", "pitch", "lift", "merged").collect()
    assert sorted(map(tuple, out)) == sorted(want)
    assert any(not r[-1] and r[2] == 4 for r in want) and any(not r[-1] and r[3] == "note-quarter" for r in want)
    merged = sampling.accepted(spark.createDataFrame(rows, SCHEMA)).filter("merged").withColumnRenamed("step", "pos")
    tokens = codec.merge(merged, ("staff_id",))
    assert tokens.count() == len({r[0] for r in want if r[-1] and r[3] != "|"})


def logits(spark, staffs):
    names = {"rhythm": ["[EOS]", "note-quarter", "note-half", "rest-half", "rest-quarter"], "pitch": ["note-C4", "note-D4", "nonote"], "lift": ["lift_null", "lift_#"]}
    values = {"rhythm": [-9.0, 1.0, 0.3, -0.5, 0.9], "pitch": [0.2, 1.1, -1.0], "lift": [0.0, 0.7]}
    rows = [(s, 0, head, i, t, values[head][i]) for s in range(staffs) for head in names for i, t in enumerate(names[head])]
    return spark.createDataFrame(rows, "staff_id long, step long, head string, index long, token string, logit double"), names, values


@pytest.mark.parametrize("attempt", [0, 2])
def test_frequencies_are_those_of_the_softmax(spark, attempt):
    n = 4000
    df, names, values = logits(spark, n)
    drawn = sampling.draws(df, threshold=0.4).filter(f"attempt = {attempt}").collect()
    for head in names:
        kept = sorted(range(len(names[head])), key=lambda i: -values[head][i])[: math.ceil(round(0.6 * len(names[head]), 9))]
        weights = {names[head][i]: math.exp(values[head][i] / 3.5**attempt) for i in kept}
        found = Counter(r[head] for r in drawn)
        assert set(found) <= set(weights)
        for token, w in weights.items():
            p = w / sum(weights.values())
            assert abs(found[token] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-9, (head, token)
    # heads are drawn independently
    both = Counter((r.pitch, r.lift) for r in drawn)
    pitch, lift = Counter(r.pitch for r in drawn), Counter(r.lift for r in drawn)
    assert all(abs(c / n - pitch[p] * lift[s] / n**2) < 0.03 for (p, s), c in both.items())


def test_draws_repeat(spark):
    df, _, _ = logits(spark, 60)
    one = sorted(map(tuple, sampling.draws(df).collect()))
    assert one == sorted(map(tuple, sampling.draws(df.repartition(7, "index")).collect())) and one != sorted(map(tuple, sampling.draws(df, seed=1).collect()))
    assert sampling.accepted(sampling.draws(df.limit(0))).count() == 0
