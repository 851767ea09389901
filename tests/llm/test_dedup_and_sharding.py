"""Exact dedup, sharding, mixing and packing against plain code, on awkward small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import exact_dedup, mixing, packing, sharding
from scorelake.llm.shared import in_bitmap, ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, bucket int, id string, rank int"
#: Columns named like those that the operators use or return.
CLASHING = "_h _sha _id _ties _hash _of _rank _text row ties none part place block slot file line batch batch_slot bucket_length n_tokens mix_slot mix_phase mix_block mix_position".split()


def clashing(df):
    return df.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in CLASHING})


def awkward(spark, n=300, seed=0):
    """Nulls, empty and long texts, hot copies, repeated rows, and columns named like inner ones."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = rng.choice([None, "", "a", "A", "a ", "hot copy", "hot copy", f"text {k}", f"text {k % 20}", "é" * (k % 7), "long " * 4000 if k % 50 == 0 else "x"])
        rows.append((k if k % 37 else None, text, "en", rng.choice([None, "s1", "s1", "s1", "s2", "s3"]), len(text or ""), "h", 1, "i", 2))
    rows += rows[:5] + rows[10:12] * 2
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.mark.parametrize("capacity", [exact_dedup.CAPACITY, 4, 30_000])
def test_exact_dedup(spark, capacity):
    df, rows = awkward(spark)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((r[0], largest[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    out = exact_dedup.exact_dedup(df, capacity=capacity).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    rows_kept = exact_dedup.kept_documents(clashing(df))
    assert rows_kept.columns == df.columns + CLASHING
    found = rows_kept.collect()
    assert Counter((r.doc_id, r.text or "") for r in found) == Counter((largest[t], t) for t in groups)
    assert all(r[c] == f"{c} {-1 if r.doc_id is None else r.doc_id}" for r in found for c in CLASHING)


def test_exact_dedup_of_nothing(spark):
    df, _ = awkward(spark)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert exact_dedup.kept_documents(df.limit(0)).count() == 0


def test_chains_of_equal_hashes():
    """Texts with one hash are told apart by their bytes."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 0], pa.int32()), pa.array([7, 7, 7]), pa.array(["a", "b", "a"]), pa.array([1, 2, 3]), pa.array([1, 1, 2]), pa.array([1, 1, 1])], names=["bucket", "h", "text", "keep_id", "group_size", "ties"])
    out = next(exact_dedup._own([batch])).to_pylist()
    assert [(r["link"], r["keep_id"], r["group_size"]) for r in out] == [(0, 3, 3), (1, 2, 1)]


def test_directory_covers_every_slot(spark):
    df = spark.range(2000).select(F.xxhash64("id").alias("h"), F.when(F.col("id") == 7, 5000).otherwise(F.col("id") % 10).cast("long").alias("bytes")).persist()
    for capacity, most in ((200, 20), (200, 3), (10**6, 20)):
        slots = exact_dedup.directory(df, capacity, most)
        depth = len(slots).bit_length() - 1
        assert len(slots) == 1 << depth <= 1 << most and sorted(set(slots)) == list(range(max(slots) + 1)) and slots.tolist() == sorted(slots)
        held = defaultdict(list)
        for r in df.collect():
            held[slots[(r.h % (1 << 64)) >> (64 - depth)]].append(r.bytes)
        if most == 20:  # only the text that fills a bucket by itself makes one overfull
            assert all(sum(x) - (max(x) if max(x) > capacity else 0) <= capacity for x in held.values())
        for bucket in set(slots):  # a bucket is a whole subtree
            own = np.flatnonzero(slots == bucket)
            assert len(own) & (len(own) - 1) == 0 and own[0] % len(own) == 0 and own[-1] - own[0] + 1 == len(own)
    assert len(slots) == 1
    more = exact_dedup.directory(df.filter("id <> 7"), 100)
    assert max(more) + 1 > max(exact_dedup.directory(df.filter("id <> 7"), 1000)) + 1  # buckets grow in number with the bytes


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding(spark, shards):
    df, rows = awkward(spark, 500, 3)
    out = sharding.assign_shards(df, shards, rows_per_task=20).collect()
    assert len(out) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for part in by.values():
        assert abs(sum(r["size"] for r in part) - total / shards) <= 2 * largest + 0.01 * total / shards
    assert sharding.assign_shards(df.limit(0), shards).count() == 0


def test_a_hot_group_is_cut_between_ids(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 700, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    sizes = Counter()
    for r in sharding.assign_shards(df, 10).collect():
        sizes[r.shard] += r["size"]
    assert len(sizes) == 10 and max(sizes.values()) - min(sizes.values()) <= 0.05 * max(sizes.values())


def test_ranks_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") / 100).cast("int").alias("b"), "id")
    out = ranked(df, ["k"], "b", ["id"]).collect()
    for k in range(3):
        assert [r.rank for r in sorted((r for r in out if r.k == k), key=lambda r: r.id)] == list(range(len([r for r in out if r.k == k])))


def test_bitmap_of_few_or_no_members(spark):
    """Where all words of the bitmap are small numbers."""
    for members in ([], [64], [0, 30]):
        wanted = spark.createDataFrame([(m,) for m in members], "x long")
        rows = spark.range(200).filter(in_bitmap(wanted, "x", F.col("id"))).collect()
        assert [r.id for r in rows] == members


def test_bitmap_rejects_no_member(spark):
    wanted = spark.range(500).select((F.xxhash64("id")).alias("h"))
    assert wanted.filter(in_bitmap(wanted, "h", F.col("h"), 10)).count() == 500


def test_bitmap_is_not_printed_in_plans(spark):
    """The driver keeps the descriptions of plans; with the words of the bitmap this one had 162,856 characters."""
    wanted = spark.range(5000).select(F.xxhash64("id").alias("h"))
    met = in_bitmap(wanted, "h", F.xxhash64("id"))
    rows = spark.range(20_000)
    plan = rows.filter(met).unionByName(rows.filter(~met))
    assert len(plan._jdf.queryExecution().toString()) < 40_000
    assert plan.count() == 20_000 and 5000 <= rows.filter(met).count() < 6000


@pytest.mark.parametrize(
    ("weights", "slots"),
    [
        ({"a": 5.0, "b": 3.0, "c": 2.0}, 20_000),
        ({"a": 1.0, "b": 1.0, "c": 1.0}, 1_000_000),
        ({"a": 0.7, "b": 0.29995, "c": 0.00005}, 1_000_000),
        ({"a": 1.0, "b": 1e-5}, 1_000_000),
        ({"a": 30.0} | {f"s{k:03}": 1 + (k * 37 % 100) / 99 for k in range(200)}, 1_000_000),
        ({f"s{k:03}": 1.5**-k for k in range(20)}, 200_000),
    ],
)
def test_deviation_from_the_targets_is_less_than_one_block(weights, slots):
    """At any slot, over all chunks, against the weights as they are given."""
    total = sum(weights.values())
    plan = mixing.Plan([(s, w, -(-slots * w // total) + 2, 1) for s, w in weights.items()])
    got, worst, seen = Counter(), 0.0, 0
    names = sorted(weights)
    share = np.array([weights[s] / total for s in names])
    for q in range(len(plan.ends) - 1):
        out = plan.chunk_slots(q)
        if plan.ends[q + 1] > slots:
            break
        assert [x[2] for x in out] == list(range(plan.ends[q], plan.ends[q + 1]))
        hit = np.zeros((len(out), len(names)))
        hit[np.arange(len(out)), [names.index(x[0]) for x in out] if len(names) < 5 else np.searchsorted(names, [x[0] for x in out])] = 1
        count = np.array([got[s] for s in names]) + np.cumsum(hit, axis=0)
        worst = max(worst, np.abs(count - np.arange(plan.ends[q] + 1, plan.ends[q + 1] + 1)[:, None] * share).max())
        for name, number, _ in out:
            assert number == got[name]
            got[name] += 1
        seen = plan.ends[q + 1]
    assert seen > 0.99 * slots - 2 * mixing.PERIOD and worst < 1 + 1e-6


def test_mixing(spark):
    df, rows = awkward(spark, 400, 5)
    out = mixing.mixed_positions(df, {"s1": 2.0, "s2": 1.0, "s3": 1.0}, block=4, rows_per_task=10, keep=["doc_id", "source", "text"]).collect()
    assert sorted(r.mix_position for r in out) == list(range(len(rows)))
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter((r[0], r[1], r[3]) for r in rows)
    blocks = defaultdict(set)
    for r in out:
        blocks[r.mix_slot].add((r.source or "", r.mix_block))
    assert all(len(x) == 1 for x in blocks.values()) and sorted(blocks) == list(range(len(blocks)))
    ordered = mixing.mixed_documents(clashing(df), block=4)
    found = ordered.collect()
    assert ordered.columns == df.columns + CLASHING and len(found) == len(rows)
    assert all(r[c] == f"{c} {-1 if r.doc_id is None else r.doc_id}" for r in found for c in CLASHING)
    names = mixing.mixed_positions(clashing(df), block=4, keep=["doc_id", "mix_slot"])
    assert names.columns == ["doc_id", "mix_slot_", *mixing.ADDED] and names.count() == len(rows)
    assert mixing.mixed_positions(df.limit(0)).count() == 0


def test_mixing_keeps_to_the_given_weights_over_many_periods(spark):
    """Weights that are no multiples of a period's share: the error does not add up from period to period."""
    weights = {"a": 1.0} | {f"s{i:02}": 0.0213 + 0.0007 * i for i in range(19)}
    total, n = sum(weights.values()), 60_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise(F.format_string("s%02d", F.col("id") % 19)).alias("source"))
    out = mixing.mixed_positions(rows, weights, block=1).select("mix_slot", "source", "mix_phase", "mix_position").orderBy("mix_slot").collect()
    assert [r.mix_slot for r in out] == [r.mix_position for r in out] == list(range(n))
    first = [r.source for r in out if r.mix_phase == 0]
    assert len(first) > 10 * mixing.PERIOD
    got = np.cumsum(np.array(first)[:, None] == np.array(sorted(weights)), axis=0)
    want = np.arange(1, len(first) + 1)[:, None] * np.array([weights[s] / total for s in sorted(weights)])
    off = np.abs(got - want).max(axis=1)
    assert off.max() < 1 + 1e-6


def test_mixing_of_many_sources(spark):
    """A hot source, 30 of middle size and 2,000 small ones: all rows get a position, and none comes far from its turn."""
    size = F.when(F.col("s") == 0, 20_000).when(F.col("s") <= 30, 300).otherwise(1 + F.col("s") % 7)
    rows = spark.range(2031).withColumnRenamed("id", "s").select("s", F.explode(F.sequence(F.lit(1), size)).alias("k"))
    rows = rows.select((F.col("s") * 100_000 + F.col("k")).alias("doc_id"), F.lit("").alias("text"), F.col("s").cast("string").alias("source"))
    out = mixing.mixed_positions(rows, block=2).orderBy("mix_position").collect()
    n = Counter(r.source for r in out)
    assert sum(n.values()) == rows.count() and len(n) == 2031
    assert [r.mix_position for r in out] == list(range(len(out)))
    slots = defaultdict(set)
    for r in out:
        slots[r.mix_slot].add((r.source, r.mix_block))
    assert all(len(x) == 1 for x in slots.values()) and sorted(slots) == list(range(len(slots)))
    order = [next(iter(slots[t])) for t in range(len(slots))]
    weight, blocks = {s: c**0.5 for s, c in n.items()}, {s: -(-c // 2) for s, c in n.items()}
    names = sorted(n)
    w, b = np.array([weight[s] for s in names]), np.array([blocks[s] for s in names])
    left, got, v, at = b.astype(float), np.zeros(len(names)), 0.0, {s: k for k, s in enumerate(names)}
    for s, j in order:  # all at once by weight until empty, against blocks
        assert j == got[at[s]]
        got[at[s]] += 1
        slot = 1.0
        while slot > 1e-9:
            rate = w[left > 1e-9].sum()
            step = min(slot / rate, (left[left > 1e-9] / w[left > 1e-9]).min())
            left = np.where(left > 1e-9, left - w * step, 0.0)
            slot -= rate * step
        assert np.abs(got - (b - left)).max() < 2


def brute_padding(histogram, buckets):
    from itertools import combinations

    tops = sorted(t for t, _ in histogram)
    best = None
    for k in range(1, min(buckets, len(tops)) + 1):
        for some in combinations(tops[:-1], k - 1):
            edges = [*some, tops[-1]]
            cost = sum(n * min(e for e in edges if e >= t) for t, n in histogram)
            best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        histogram = [(t, rng.randint(1, 50)) for t in rng.sample(range(1, 60), rng.randint(1, 9))]
        for buckets in (1, 2, 3, 5):
            edges = packing.boundaries(histogram, buckets)
            assert len(edges) <= buckets and edges == sorted(set(edges))
            assert sum(n * min(e for e in edges if e >= t) for t, n in histogram) == brute_padding(histogram, buckets)
    assert packing.boundaries([], 4) == []


def test_boundaries_are_optimal_for_any_length():
    """Long lengths, many of them, and large counts: against the plain recurrence."""
    rng = random.Random(2)
    for top, distinct in ((5_000, 60), (10**7, 150), (40, 40)):
        histogram = [(t, rng.choice([1, 2, 10**9 + rng.randrange(9)])) for t in rng.sample(range(1, top + 1), distinct)]
        tops, counts = zip(*sorted(histogram), strict=True)
        best = [0] + [None] * len(tops)
        for buckets in range(1, 6):
            best = [0] + [min(best[s] + tops[e - 1] * sum(counts[s:e]) for s in range(e) if best[s] is not None) for e in range(1, len(tops) + 1)]
            edges = packing.boundaries(histogram, buckets)
            assert len(edges) <= buckets
            assert sum(n * min(e for e in edges if e >= t) for t, n in histogram) == best[-1]


def test_packing(spark, tmp_path):
    df, rows = awkward(spark, 300, 7)
    df.coalesce(2).write.parquet(str(tmp_path / "docs"))
    for docs in (df, spark.read.parquet(str(tmp_path / "docs"))):
        out = packing.packed(docs, budget=100, buckets=4, keep=["doc_id", "text"], rows_per_task=25, by_arrival=True).collect()
        assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
        batches = Counter()
        for r in out:
            assert r.n_tokens == len((r.text or "").split()) <= r.bucket_length
            batches[r.bucket_length, r.batch] += 1
        assert all(n <= max(1, 100 // b) for (b, _), n in batches.items())
        assert len({(r.bucket_length, r.batch, r.batch_slot) for r in out}) == len(out)
    assert packing.packed(df.limit(0)).count() == 0


def test_packing_keeps_columns_of_any_name(spark):
    df, rows = awkward(spark, 60, 8)
    docs = clashing(df)
    out = packing.packed(docs, keep=docs.columns)
    assert out.columns[: len(docs.columns)] == [f"{c}_" if c in packing.ADDED else c for c in docs.columns]
    assert all(r.batch_ == f"batch {-1 if r.doc_id is None else r.doc_id}" and r.file.startswith("file ") for r in out.collect()) and out.count() == len(rows)


def test_a_long_document_is_not_padded_beyond_the_longest(spark):
    df = spark.createDataFrame([(1, "w " * 2049), (2, "w " * 5001), (3, "w")], "doc_id long, text string")
    assert sorted((r.n_tokens, r.bucket_length) for r in packing.packed(df).collect()) == [(1, 1), (2049, 2049), (5001, 5001)]


def test_numbers_are_plain():
    assert np.array(packing.boundaries([(3, 2), (9, 1)], 2)).tolist() == [3, 9]
