"""Top-k search, conversation trie and phrases against brute force, and against their SQL on the given tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from scorelake.llm import phrases, prefix_trie, queries, topk_search

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_exact_top_k", "op12_conversation_trie", "op13_phrase_collocations"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want))


# ---- top-k


def brute_top(rows, k, every, scale=1024):
    """(query id, rank, id, score) of rows (id, vector), by exact fractions."""
    kept = [(i, [math.floor(float(x)) if abs(x) > 2**60 else math.floor(x) for x in (scale * float(c) for c in v)]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) and math.isfinite(scale * c) for c in v)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q % every == 0:
            scores = [(max(-(2**63), min(2**63 - 1, sum(s * t for s, t in zip(x, y)))), i) for b, (i, y) in enumerate(kept) if b != a]
            out += [(q, r, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:k], 1)]
    return sorted(out)


def found_top(spark, rows, k, every):
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<float>, row string, norm double")
    return sorted(map(tuple, topk_search.exact_top_k(df, k=k, every=every).collect()))


def as_float(v):
    return [None if x is None else float(np.float32(x)) for x in v]


@pytest.mark.parametrize("seed", range(3))
def test_top_k_of_vectors_of_all_lengths(spark, monkeypatch, seed):
    """Lengths that differ by far, clusters, copies and ties; small buckets, so that many are pruned."""
    monkeypatch.setattr(topk_search, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(int(i), as_float((centres[i % 6] + rng.normal(size=8) * 0.1) * rng.exponential() ** 2)) for i in range(240)]
    rows += [(300 + i, as_float(centres[0])) for i in range(60)] + [(500 + i, [0.0] * 8) for i in range(5)]
    assert found_top(spark, rows, 5, 10) == brute_top(rows, 5, 10)


def test_coordinate_pruning_prunes_and_loses_nothing():
    rng = np.random.default_rng(1)
    v = np.floor(1024 * rng.normal(size=(800, 16)))
    norms = np.sqrt((v * v).sum(axis=1))
    order = np.argsort(-norms)
    v, norms = v[order], norms[order]
    bucket = topk_search.Bucket(np.arange(800), np.arange(800), norms, v)
    tried = 0
    for q in (v[::40] + rng.normal(size=(20, 16)) * 100).round():
        norm = float(np.sqrt((q * q).sum()))
        for share in (0.75, 0.9, 0.97):
            bound = share * norm * norms[0]
            places = bucket.near(q, norm, bound)
            assert set(np.flatnonzero(v @ q >= bound)) <= set(places.tolist())
            tried += len(places) < 400
    assert tried > 30
    assert bucket.near(v[0], norms[0], 0.3 * norms[0] ** 2) is None and bucket.prefix(norms[0] * norms[400], norms[0]) in (401, 402)


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [5.0]), (10, None), (20, [nan, 1.0]), (30, [inf, 0.0]), (40, [None, 1.0]), (50, []), (None, [9.0, 9.0]), (7, [1.0, 2.0, 3.0]), (-10, [1e18, -1e18]), (8, [-3e18, 2e17]), (9, [1e38]), (100, [-0.001, 0.0005])]
    rows = [(i, None if v is None else as_float(v)) for i, v in rows]
    assert found_top(spark, rows, 4, 10) == brute_top(rows, 4, 10)
    assert found_top(spark, [], 4, 10) == [] and found_top(spark, [(0, [1.0])], 4, 10) == []


# ---- trie


def brute_trie(spark, rows):
    """Plain code over all prefixes as tuples. rows: conv_id, turn, role, text."""
    from pyspark.sql import functions as F

    ties = spark.createDataFrame([(r or "", t or "") for _, _, r, t in rows], "r string, t string").distinct()
    tie = {(x.r, x.t): (x.a, x.b) for x in ties.select("r", "t", F.xxhash64("r", "t").alias("a"), F.xxhash64(F.lit(1), "r", F.lit(2), "t").alias("b")).collect()}
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, *tie[role or "", text or ""], role or "", text or ""))
    own = {c: [x[-2:] for x in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    paths = {c: own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)

    def subtree(node):
        todo = [node]
        while todo:
            x = todo.pop()
            yield x
            todo += below[x]

    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(paths[c]) == len(node))
        under = list(subtree(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(below[node]), sum(not below[x] for x in under), sum((len(members[x]) - 1) * words(x) for x in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def found_trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, depth int")
    return sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=lambda x: (x[1], x[0]))


@pytest.mark.parametrize("seed, span", [(0, 4096), (1, 3)])
def test_trie(spark, monkeypatch, seed, span):
    """Shared beginnings, whole copies, null turns, roles and texts, ties, gaps in ids, negative ids, many members at one node."""
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    rng = random.Random(seed)
    texts = ["hello there", "a b\tc\x0bd", "", None, " x ", "Hello there", "é ü", "a\x0cb"]
    rows = []
    for c in [*range(0, 90, 2), *range(-45, 0, 5), 1003]:
        for t in range(rng.randrange(0, 5)):
            rows.append((c, None if rng.random() < 0.1 else rng.choice([t, t, 1]), rng.choice(["user", "user", None]), rng.choice(texts[:3] if rng.random() < 0.7 else texts)))
    rows += [(2000 + k, t, "user", "same words again") for k in range(40) for t in range(3)]
    rows += [(None, 1, "user", "no id"), (4, 1, "user", "twice"), (4, 1, "user", "twice"), (5, 0, "user", "long " * 50_000)]
    assert found_trie(spark, rows) == brute_trie(spark, rows)


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(20, t % 700, "user", f"turn {t % 13}") for t in range(2000)] + [(21, 0, "user", "turn 0"), (33, 5, "", "z")]
    assert found_trie(spark, rows) == brute_trie(spark, rows)
    assert found_trie(spark, []) == [] and found_trie(spark, [(None, 1, "a", "b")]) == []


# ---- phrases


def brute_phrases(rows, least=10, longest=3, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    covered = defaultdict(int)
    for (lang, p), a in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                covered[lang, p[i : i + size]] = max(a, covered[lang, p[i : i + size]])
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * covered[lang, p] >= 50 * a:
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, le, ri, n[lang], -s) for lang, all_ in out.items() for r, (s, a, p, le, ri) in enumerate(sorted(all_)[:top], 1))


def found_phrases(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, a int")
    return sorted(map(tuple, phrases.collocations(df, **more).collect()))


@pytest.mark.parametrize("shard, longest", [(1 << 21, 3), (400, 3), (3000, 4)])
def test_phrases(spark, monkeypatch, shard, longest):
    """Small shards and slices, so that texts and bitmaps are cut; overlaps, marks, null languages and texts, repeated rows, very long words and texts."""
    for name, value in (("SHARD", shard), ("SLICE", 1 << 10), ("CELLS", 2)):
        monkeypatch.setattr(phrases, name, value)
    rng = random.Random(4)
    words = ["aa", "aa", "aa", "Ab", "c", "d", "É", "x-y", " ", "w" * 300, "\U0001f600"] + [f"w{i}" for i in range(30)]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" "] * 12 + ["\t ", ". ", ",", "\x0b", "\n", " ! ", "\x85 "]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und"]), text(rng.randrange(60))) for _ in range(150)] + [("en", text(6000)), ("en", None), (None, ""), ("fr", " . , "), ("de", "aa " * 200)]
    rows += [("en", "new york city is new york")] * 12
    assert found_phrases(spark, rows, longest=longest) == brute_phrases(rows, longest=longest)
    assert found_phrases(spark, rows, top=5, least=11) == brute_phrases(rows, top=5, least=11)


def test_phrases_of_nothing(spark):
    assert found_phrases(spark, []) == [] and found_phrases(spark, [("en", None), (None, "a b")]) == []


def test_scores_are_whole_numbers_of_any_size():
    a, left, right = 3 * 10**12 + 1, 7 * 10**15 + 3, 5 * 10**12 + 9
    assert phrases.cut_score(a, left, right) == 1_000_000 * a**2 // (left * right) and phrases.cut_score(10, 10, 10) == 1_000_000


def test_words_are_numbered_by_their_bytes(monkeypatch):
    """Texts in order, with words of all lengths and equal beginnings; also where all hashes are one."""
    texts = [("en", b"a b  a\n\nlonger-than-eight longer-than-nine a"), ("de", b"a b"), ("en", b""), ("en", b"x" * 300 + b" " + b"x" * 299 + b"y " + b"x" * 300 + b"\nb ")]
    want = [[(lang, w) for w in piece.split()] for lang, t in texts for piece in t.split(b"\n")]
    for same in (False, True):
        if same:
            monkeypatch.setattr(phrases, "mixed", lambda x: x * np.uint64(0))
        shard = phrases.numbered(texts)
        got, piece = [], []
        for p in shard.positions.tolist():
            if p:
                piece.append((shard.langs[p - 1], shard.words[p - 1]))
            else:
                got.append(piece)
                piece = []
        assert got == want and len(set(zip(shard.langs, shard.words))) == len(shard.words) == len({x for w in want for x in w})
    assert phrases.numbered([("en", b"")]).words == []


def test_bitmaps_shift_and_count():
    """A phrase that starts in one block and ends in the next; a shift doesn't cross an empty position."""
    positions = np.array([0] * 15 + [1, 2, 1, 2, 0, 1, 0, 2] + [1, 2] * 20)
    own = phrases.word_bitmaps(positions, 2)
    assert own.popcounts(2).tolist() == [(positions == 1).sum(), (positions == 2).sum()]
    starts = np.searchsorted(own.block, np.arange(len(positions) // 16 + 2))
    longer, p, w = phrases.extended(own, own, starts, 2)
    pairs = Counter((a - 1, b - 1) for a, b in zip(positions.tolist(), positions[1:].tolist()) if a and b)
    assert dict(zip(zip(p.tolist(), w.tolist()), longer.popcounts(len(p)).tolist())) == pairs
