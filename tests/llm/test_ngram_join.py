"""The n-gram join against brute force, with hot groups."""

import random
import re

import numpy as np
import pytest

from scorelake.llm import ngram_join as g
from scorelake.llm.words import exact_sets, word_hashes, words_of


def brute(rows, rule):
    words = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    sets = []
    for _, t in rows:
        w = words(t)
        k = min(rule.k, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rule.den * len(a & b) >= rule.num * len(a | b):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=260):
    """Near copies at all distances, a passage in many documents, copies, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: f"W{rng.randint(0, 5000)}"
    passage = [word() for _ in range(25)]
    bases = [[word() for _ in range(size)] for size in (8, 20, 60, 60, 150)]
    rows = []
    for k in range(n):
        kind = rng.randrange(6)
        if kind < 3:
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [word()], [w[at], word()]])
        elif kind == 3:
            w = passage + [word() for _ in range(rng.randint(0, 30))]
        elif kind == 4:
            w = [word() for _ in range(rng.randint(0, 6))]
        else:
            w = [rng.choice("ab") for _ in range(rng.randint(1, 12))]
        text = rng.choice([" ", "\n", "\t "]).join(w)
        rows.append((k, rng.choice([text, text, text.lower()])))
    return rows + [(1000, None), (1001, ""), (1002, "a" + " a" * 3000), (1003, "A" + " a" * 2000), (None, "x y z u v w"), (7, rows[7][1]), (7, "other words for a repeated id")]


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 4, 85), (2, 5, 80)])
def test_components(spark, seed, k, num):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, root string").repartition(3)
    out = g.jaccard_components(df, k, num)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == brute(rows, g.Rule(k, num, 100))


def thue_morse(n, a, b):
    """A word of n letters that any polynomial modulo 2**64 of odd base maps to the same number as the one with a and b swapped."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("bits", [64, 5])
def test_words_decide_not_hashes(spark, bits):
    """Words that collide in simple hashes, and classes whose ids clash, are told apart."""
    rows = [(1, thue_morse(1024, "a", "b")), (2, thue_morse(1024, "b", "a")), *((10 + k, f"w{k} " * 3 + f"v{k % 40}") for k in range(120))]
    rows += [(500 + k, "  ".join(rows[2 + k][1].upper().split())) for k in range(0, 120, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rule = g.Rule(4, 85, 100, bits)
    out = g.components_of(df, rule, "doc_id", "text")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == brute(rows, rule)


def test_word_hashes_tell_words_apart():
    """Equal words, and only those, have equal hashes: short ones, ones that share their first eights, long and colliding ones."""
    rng = random.Random(1)
    words = ["a", "a\x00", "\x00", "\x00\x00", "b", "aa", "a" * 7, "a" * 8, "a" * 9, "a" * 16, "a" * 17, "a" * 256, "a" * 257, "x" * 8 + "y", "x" * 8 + "z", "\u00e9", "\x1c", "x\x1fy", thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a"), thue_morse(256, "a", "b"), thue_morse(256, "b", "a")]
    words += ["".join(rng.choices("abcdef", k=rng.randint(1, 40))) for _ in range(3000)]
    words += [w.upper() for w in words[:400]]
    rng.shuffle(words)
    text = "".join(w + rng.choice([" ", "\n", "\t \x0b", "\r\x0c"]) for w in words)
    plain = words_of(text)
    assert plain == [w.encode().lower() for w in words]
    hashes = word_hashes(text).tolist()
    assert len(hashes) == len(words) and len(set(hashes)) == len(set(plain)) == len(set(zip(plain, hashes)))
    assert len(word_hashes("")) == 0 and len(word_hashes(" \n")) == 0


def test_exact_sets():
    texts = ["A b c d e", "a B c d e f", "x", "", "a b", "b a", "a b c d e a b c d"]
    for k in (1, 2, 4, 5):
        plain = []
        for t in texts:
            w = t.lower().split()
            n = min(k, len(w))
            plain.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
        sets = exact_sets(texts, k)
        for i, a in enumerate(plain):
            assert len(sets[i]) == len(a)
            for j, b in enumerate(plain):
                assert len(np.intersect1d(sets[i], sets[j])) == len(a & b)
    assert exact_sets([], 4) == []


@pytest.mark.parametrize("large", [7, 10_000])
def test_hot_keys(spark, monkeypatch, large):
    """With tiny limits, pivots and blocks do the work, with and without a partition anew."""
    monkeypatch.setattr(g, "SMALL", 2)
    monkeypatch.setattr(g, "LARGE", large)
    monkeypatch.setattr(g, "BLOCK", 7)
    rows = corpus(3, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = g.jaccard_components(df, 4, 85)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == brute(rows, g.Rule(4, 85, 100))


def test_form_letters(spark, monkeypatch):
    """Texts of which most is the same, but too little for a link, and some families that are linked: rare shingles tell, no blocks are compared."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    form = [word() for _ in range(80)]
    rows = []
    for k in range(90):
        own = [word() for _ in range(20)]
        for copy in range(3 if k % 15 == 0 else 1):
            rows.append((10 * k + copy, " ".join([*form, *own, *(["extra"] * copy)])))
    monkeypatch.setattr(g, "SMALL", 8)
    monkeypatch.setattr(g, "LARGE", 40)
    compared = []
    monkeypatch.setattr(g, "compared_in_blocks", lambda members, texts, rule: compared.append(members.count()) or members.selectExpr("d u", "d v").limit(0))
    deeper = []
    monkeypatch.setattr(g, "unsettled", lambda *a, real=g.unsettled: deeper.append(real(*a)) or deeper[-1])
    out = g.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == brute(rows, g.Rule(4, 85, 100))
    assert deeper and deeper[0].count() > 50 and not compared


def test_one_stays(spark):
    rows = corpus(4, 120)
    names = "_of _hash _id _text _rank row id h rank component_id component_class gone gone_h".split()
    df = spark.createDataFrame([(d, t, *(f"{c} {d}" for c in names)) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    kept = g.one_of_each_component(df, 5, 80)
    assert kept.columns == df.columns
    assert all(r[c] == f"{c} {r.doc_id}" for r in kept.collect() for c in names)
    found = g.jaccard_components(df, 5, 80).collect()
    components = {r.component_class for r in found if r.n_shingles and r.component_id is not None}
    others = [r for r in found if not r.n_shingles or r.component_id is None]
    got = kept.collect()
    assert len(got) == len(components) + len(others)
    smallest = {r.component_id for r in found if r.component_class in components}
    assert {r.doc_id for r in got if r.doc_id is not None} == smallest | {r.doc_id for r in others if r.doc_id is not None}


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert g.jaccard_components(df).count() == 0 and g.one_of_each_component(df).count() == 0


def test_capacity_exceeds_the_difference():
    for rule in (g.Rule(4, 85, 100), g.Rule(5, 80, 100), g.Rule(4, 85, 100, fine=True)):
        bands = g.Bands(rule)
        bands.of(50_000)
        low = 1
        for b in bands.all:
            assert b.low == low and b.high >= b.low
            low = b.high + 1
            apart = rule.most_apart(b.high, b.high * rule.den // rule.num)
            assert b.segments + b.deleted - apart - 1 == b.spare >= 0


def test_a_link_shares_a_key_or_is_hot():
    rng = np.random.default_rng(1)
    for k in range(800):
        rule = g.Rule(4, 85, 100) if k % 2 else g.Rule(4, 85, 100, fine=True)
        bands = g.Bands(rule)
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(rng.integers(0, rule.most_apart(len(a), len(a)) + 2))
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop // 2 :]], rng.integers(0, 1 << 63, drop - drop // 2).astype(np.uint64))))
        if not len(b) or not rule.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            continue
        assert g.sketch_distance(g.sketch_of(a), g.sketch_of(b)) <= rule.most_apart(len(a), len(b))
        small = min(len(a), len(b))
        band = next(x for x in bands.of(small) if x.low <= small <= x.high)
        assert band in bands.of(max(len(a), len(b)))
        assert len(np.intersect1d(g.keys_of(a, band)[0], g.keys_of(b, band)[0]))
