"""N-gram Jaccard join: exact links between shingle sets by a partition of the universe.

Sets are grouped in bands of size. For a band, the difference of two linked sets, of which the smaller
is in the band, is at most H; the universe of shingles is hashed into m segments, and D of them also
get one-deletion neighbourhoods. A segment with no difference (in the D: with at most one) shows up
as an equal key, so linked sets share a key as long as m + D > H. `allocation` picks m and D by cost,
with some capacity to spare: a set may ignore as much of its capacity as is spare, which it spends on
empty segments and on segments whose key very many sets share. Only sets whose spare capacity doesn't
reach that far compare inside such hot keys: first all with one pivot, and then, where that leaves
more than one component, in blocks of bounded size.

Candidates pass a parity sketch, which never rejects a link, and are then verified on the words of their texts.
Texts of the same words are one class from the start, so copies are never paired; classes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.operators.grouping import components

from .shared import in_bitmap, join_entries, materialize, salted, text_or_empty
from .words import exact_sets, mixed, shingle_hashes, word_hashes, words_of

#: Sets with one key that are paired directly; beyond, the key is hot.
SMALL = 32
#: Sets in a block of the last comparison, and in a cluster that is partitioned anew before.
BLOCK, LARGE = 256, 8192
#: Growth of a band's sizes, and the share of H that is spare.
GROWTH, SPARE = 1.4, 0.1
#: The same growth, and segments for each shingle of a band's smallest sets, where sets are partitioned anew.
NARROW, FINE = 1.15, 8
#: Classes with one id at most, among n texts about n**2 / 2**65 of them; and texts that are compared with one at a time.
MOST_CLASHING, TOGETHER = 1 << 20, 64
#: Classes that a task remembers, so as not to send their keys again.
REMEMBERED = 200_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Linked: den * intersection >= num * union, of sets of k-word shingles."""

    k: int
    num: int
    den: int
    #: Bits of a class's id; texts of different words with one id get others.
    class_bits: int = 64
    #: Whether sets are partitioned anew, into FINE segments.
    fine: bool = False

    def most_apart(self, a, b):
        """The largest difference of two linked sets of sizes a and b."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def sizes_fit(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    segments: int
    deleted: int
    spare: int


def allocation(low: int, apart: int) -> tuple[int, int, int]:
    """(segments, how many of them get one-deletion neighbourhoods, spare capacity) of least cost.

    Cost: keys a set emits. A segment adds one key and 1 to the capacity; a neighbourhood adds as many
    keys as the segment has members and 1 to the capacity, but leaves segments larger. Capacity to spare
    must cover the segments expected to be empty in the band's smallest sets, and a share of H.
    """
    if apart == 0:
        return 1, 0, 0
    best = None
    for deleted in range(4):
        for segments in range(max(1, deleted, apart - deleted), 2 * apart + 40):
            spare = segments + deleted - apart - 1
            if spare < 0:
                continue
            mean = low / segments
            empty = (segments - deleted + deleted * (2 + mean)) * math.exp(-mean) if segments > 1 else 0.0
            if spare < SPARE * apart + (0 if empty < 0.05 else empty + 2 * math.sqrt(empty)):
                continue
            cost = segments - deleted + deleted * (1 + mean)
            if best is None or cost < best[0]:
                best = (cost, segments, deleted, spare)
            break
    return best[1:] if best else (apart + 1, 0, 0)


class Bands:
    """The bands of a rule, made as sizes ask for them."""

    def __init__(self, rule: Rule):
        self.rule, self.all = rule, []

    def of(self, n: int) -> list[Band]:
        """Bands in which a set of that size may be the smaller or the larger of a linked pair."""
        while not self.all or self.all[-1].high < n:
            low = self.all[-1].high + 1 if self.all else 1
            high = max(low, int(low * (NARROW if self.rule.fine else GROWTH)))
            apart = self.rule.most_apart(high, high * self.rule.den // self.rule.num)
            parts = (FINE * low + apart, 0, FINE * low - 1) if self.rule.fine else allocation(low, apart)
            self.all.append(Band(len(self.all), low, high, *parts))
        least = -(-self.rule.num * n // self.rule.den)
        found = []
        for band in reversed(self.all):
            if band.high < least:
                break
            if band.low <= n:
                found.append(band)
        return found


def shingle_set(text: str, k: int) -> np.ndarray:
    """Distinct shingles by their hashes, in rising order."""
    return np.unique(shingle_hashes(word_hashes(text), k))


def class_ids(words: list[bytes], rule: Rule) -> tuple[int, int]:
    """(id of a text's class, the id that it gets if other words have the first one), signed 64-bit: a hash of all its words in order."""
    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    first, second = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:]))
    return first >> (64 - rule.class_bits), second


def keys_of(items: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, capacity of each, capacity left to spare) of a set in a band."""
    n, m, d = len(items), band.segments, band.deleted
    segment = ((items >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the items
    spread = mixed(items + _GOLDEN)
    start = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    own, at = np.add.reduceat(spread, start), segment[start]
    size = np.diff(np.append(start, n))
    salt = np.uint64(band.number * 7919 + 1)
    keys, weight = [mixed(own + at * _GOLDEN + salt)], [1 + (at < d)]
    empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at)
    ignored = len(empty) + int((empty < d).sum()) + int(((at < d) & (size == 1)).sum())
    if d:
        inside = np.flatnonzero((segment < d) & (np.repeat(size, size) > 1))
        keys.append(mixed(np.repeat(own, size)[inside] - spread[inside] + segment[inside] * _GOLDEN + salt))
        weight.append(np.ones(len(inside), np.int64))
    if ignored > band.spare:  # such sets also meet on what is empty
        single = at[(at < d) & (size == 1)]
        none = np.concatenate((empty, single))
        keys.append(mixed(none * _GOLDEN + salt))
        weight.append(np.ones(len(none), np.int64))
    return np.concatenate(keys), np.concatenate(weight).astype(np.int64), max(0, band.spare - ignored)


def sketch_of(items: np.ndarray) -> bytes:
    """Parities of the counts of members by hash; two sketches differ in no more bits than the sets have differences."""
    width = max(64, 1 << int(len(items) // 2).bit_length())
    counts = np.bincount((items & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits(counts & 1).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    # bit p of the narrow sketch is the parity of all bits that are p modulo its width
    return np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)


def sketch_distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum())


# info of a key's row: size, band, capacity, spare capacity, and whether the set's own band it is
def _packed(n: int, band: Band, weight: np.ndarray, spare: int) -> np.ndarray:
    native = int(band.low <= n <= band.high)
    return (np.int64(n) << 32) + (np.int64(band.number) << 24) + (np.int64(min(spare, 0xFFFFF)) << 4) + (weight << 1) + native


def _size(info):
    return info >> 32


def _classes(rule: Rule):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                items = np.unique(shingle_hashes(word_hashes(text), rule.k))
                for column, value in zip(out, (len(items), *class_ids(words, rule), sketch_of(items) if len(items) else b""), strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, types)], names=["id", "h", "n", "d", "other", "sketch"])

    return run


def _keys(rule: Rule, clashing: frozenset[int]):
    def run(batches):
        bands, seen = Bands(rule), OrderedDict()
        for batch in batches:
            keys, ids, infos, held = [], [], [], 0
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                if not words:
                    continue
                d, other = class_ids(words, rule)
                if d in clashing:
                    d = other
                if d in seen:
                    continue
                seen[d] = None
                if len(seen) > REMEMBERED:
                    seen.popitem(last=False)
                items = np.unique(shingle_hashes(word_hashes(text), rule.k))
                for band in bands.of(len(items)):
                    own, weight, spare = keys_of(items, band)
                    keys.append(own.view(np.int64))
                    ids.append(np.full(len(own), d, np.int64))
                    infos.append(_packed(len(items), band, weight, spare))
                    held += len(own)
                if held > 100_000:
                    yield _key_rows(keys, ids, infos)
                    keys, ids, infos, held = [], [], [], 0
            if held:
                yield _key_rows(keys, ids, infos)

    return run


def _key_rows(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names=["key", "d", "info"])


def _walk(rule: Rule):
    """Rows in the order of keys. A key of at most SMALL classes gives their pairs (0, a, b, 0), a hot one its rows (1, key, d, info)."""

    def run(batches):
        carry: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        hot = None  # the key whose rows are passed on as they come
        pairs: list[tuple[np.ndarray, ...]] = []

        def group(d, info):
            first, second = np.triu_indices(len(d), 1)
            size = _size(info)
            keep = ((info[first] | info[second]) & 1 == 1) & rule.sizes_fit(size[first], size[second])
            a, b = d[first[keep]], d[second[keep]]
            if len(a):
                zero = np.zeros(len(a), np.int64)
                pairs.append((zero, np.minimum(a, b), np.maximum(a, b), zero))

        def passed(key, d, info):
            if len(d):
                pairs.append((np.ones(len(d), np.int64), np.full(len(d), key), d, info))

        def once(d, info):
            _, first = np.unique(d, return_index=True)
            return d[first], info[first]

        def rows():
            out = [np.concatenate(c) for c in zip(*pairs, strict=True)]
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["kind", "a", "b", "info"])

        for batch in batches:
            key, d, info = (np.concatenate((c, batch.column(k).to_numpy(zero_copy_only=False))) for k, c in enumerate(carry))
            if not len(key):
                continue
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            end = np.append(start[1:], len(key))
            if hot is not None and key[0] == hot:
                passed(hot, d[: end[0]], info[: end[0]])
                start, end = start[1:], end[1:]
            if not len(start):
                carry = [np.zeros(0, np.int64)] * 3
                if pairs:
                    yield rows()
                continue
            hot = None
            several = end[:-1] - start[:-1] > 1
            for s, e in zip(start[:-1][several].tolist(), end[:-1][several].tolist(), strict=True):
                own, tags = once(d[s:e], info[s:e])
                if len(own) > SMALL:
                    passed(key[s], own, tags)
                elif len(own) > 1:
                    group(own, tags)
            own, tags = once(d[start[-1] :], info[start[-1] :])
            if len(own) > SMALL:
                hot = key[-1]
                passed(hot, own, tags)
                carry = [np.zeros(0, np.int64)] * 3
            else:
                carry = [np.full(len(own), key[-1]), own, tags]
            if pairs:
                yield rows()
        if len(carry[0]) > 1:
            group(carry[1], carry[2])
            if pairs:
                yield rows()

    return run


def candidates(df: DataFrame, rule: Rule, text_col: str = "text", clashing: frozenset[int] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes a < b with a common key that isn't hot; rows of hot keys: key, d, info, only of classes without the capacity to ignore them)."""
    keys = df.select(text_or_empty(df, text_col).alias("text")).mapInArrow(_keys(rule, clashing), "key long, d long, info long")
    walked = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_walk(rule), "kind long, a long, b long, info long")
    walked = materialize(walked, "ngram-candidates")
    pairs = walked.filter("kind = 0").select("a", "b").distinct()
    hot = walked.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("d"), "info").distinct()
    hot = hot.withColumn("band", F.shiftright("info", 24).bitwiseAND(F.lit(255)))
    weight, spare = F.shiftright("info", 1).bitwiseAND(F.lit(7)), F.shiftright("info", 4).bitwiseAND(F.lit(0xFFFFF))
    bound = hot.groupBy("d", "band").agg(F.sum(weight).alias("w"), F.min(spare).alias("s")).filter("w > s").select("d", "band")
    return pairs, materialize(hot.join(bound, ["d", "band"]).select("key", "d", "info"), "ngram-hot")


def stars(hot: DataFrame) -> DataFrame:
    """(u, v): each class of a hot key with the key's pivot, its smallest class; keys without a class of the band are left out."""
    pivot = hot.groupBy("key").agg(F.min("d").alias("u"), F.max(F.col("info").bitwiseAND(F.lit(1))).alias("native"), F.count(F.lit(1)).alias("rows")).filter("native = 1")
    return join_entries(hot.select("key", "d"), pivot.select("key", "u", "rows"), ["key"], "rows", hot.count()).filter("u <> d").select("u", F.col("d").alias("v")).distinct()


def verified(pairs: DataFrame, classes: DataFrame, df: DataFrame, rule: Rule, text_col: str = "text") -> DataFrame:
    """The links (u, v) among pairs (a, b) of classes. A class in very many pairs is compared in several tasks."""

    @F.pandas_udf(T.BooleanType())
    def near(xs: pd.Series, ys: pd.Series, ns: pd.Series, ms: pd.Series) -> pd.Series:
        return pd.Series([sketch_distance(x, y) <= rule.most_apart(n, m) for x, y, n, m in zip(xs, ys, ns, ms, strict=True)], dtype=bool)

    pairs = materialize(pairs, "ngram-pairs")
    of = lambda s: classes.select(F.col("d").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"), F.col("h").alias(f"h_{s}"))
    fit = rule.den * F.least("n_a", "n_b") >= rule.num * F.greatest("n_a", "n_b")
    n_rows = pairs.count()
    left = salted(salted(pairs, of("a"), "a", n_rows), of("b"), "b", n_rows).filter(fit).filter(near("s_a", "s_b", "n_a", "n_b"))
    left = materialize(left.select("a", "b", "h_a", "h_b"), "ngram-near")
    texts = texts_of(left.select(F.col("h_a").alias("h")).unionByName(left.select(F.col("h_b").alias("h"))), df, text_col)
    one = texts.select(F.col("h").alias("h_a"), F.col("text").alias("t_a"))
    two = texts.select(F.col("h").alias("h_b"), F.col("text").alias("t_b"))
    n_rows = left.count()
    both = salted(salted(left, two, "h_b", n_rows), one, "h_a", n_rows).select("a", "b", "t_a", "t_b")

    def compared(rows):
        sets = exact_sets([rows[0][2], *(r[3] for r in rows)], rule.k)
        own = sets[0]
        for (a, b, *_), other in zip(rows, sets[1:], strict=True):
            if rule.linked(len(np.intersect1d(own, other, assume_unique=True)), len(own), len(other)):
                yield a, b

    def run(batches):
        for batch in batches:
            found, rows = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (row[0] != rows[0][0] or len(rows) == TOGETHER):
                    found += compared(rows)
                    rows = []
                rows.append(row)
            if rows:
                found += compared(rows)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256, in hexadecimal."""
    return F.substring(F.sha2(text, 256), 1, 32)


def texts_of(wanted: DataFrame, df: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, text): one row for each text whose key is wanted."""
    wanted = wanted.select("h").distinct()
    text = text_or_empty(df, text_col)
    rows = df.select(text_key(text).alias("h"), text.alias("text"))
    rows = rows.filter(in_bitmap(wanted.select(F.xxhash64("h").alias("x")), "x", F.xxhash64("h")))
    # copies become one before they are exchanged
    return materialize(rows.groupBy("h").agg(F.first("text").alias("text")).join(wanted, "h", "left_semi"), "ngram-texts")


def unsettled(star: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """(cluster, size, d, root, n, h) of the classes that meet in hot keys and are in more than one component. roots: node, root of the links so far."""
    roots = roots.withColumnRenamed("node", "d")
    members = components(star).withColumnsRenamed({"node": "d", "root": "cluster"})
    members = members.join(roots, "d", "left").withColumn("root", F.coalesce("root", "d"))
    open_ = members.groupBy("cluster").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")).filter("r0 <> r1")
    members = join_entries(members, open_.select("cluster", "size"), ["cluster"], "size", classes.count())
    return materialize(members.join(classes.select("d", "n", "h"), "d"), "ngram-unsettled")


def compared_in_blocks(members: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links (u, v) that join different components inside a cluster. members: see `unsettled`; texts: h, text.

    A cluster is cut by the sizes of sets, and by the hashes of their ids, into blocks of about BLOCK; two blocks meet unless their
    sizes are too far apart, or both are in one component.
    """
    kind = F.floor(F.log("n") / max(0.05, math.log(rule.den / rule.num))).cast("long")
    members = members.drop("size").withColumn("kind", kind)
    sizes = members.groupBy("cluster", "kind").agg(F.count(F.lit(1)).alias("size"))
    cut = F.greatest(F.ceil(F.log2(F.col("size") / BLOCK)), F.lit(0)).cast("int")
    found = join_entries(members, sizes, ["cluster", "kind"], "size", members.count())
    block = F.pmod(F.xxhash64("d"), F.pow(F.lit(2), cut).cast("long"))
    members = materialize(found.withColumn("block", F.col("kind") * (1 << 32) + block).drop("size", "kind"), "ngram-members")
    blocks = members.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    a, b = blocks.alias("a"), blocks.alias("b")
    meets = (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.block") <= F.col("b.block"))
    open_ = ~((F.col("a.r0") == F.col("a.r1")) & (F.col("b.r0") == F.col("b.r1")) & (F.col("a.r0") == F.col("b.r0")))
    fits = rule.den * F.col("a.high") >= rule.num * F.col("b.low")
    tasks = a.join(b, meets & open_ & fits).select(F.col("a.cluster").alias("cluster"), F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    dealt = tasks.withColumn("block", F.explode(F.array_distinct(F.array("i", "j")))).join(members, ["cluster", "block"])
    dealt = dealt.join(texts, "h")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = _forest(exact_sets(pdf["text"].tolist(), rule.k), pdf["root"].to_numpy(), pdf["block"].to_numpy(), rule)
        d = pdf["d"].to_numpy()
        return pd.DataFrame({"u": [d[x] for x, _ in edges], "v": [d[y] for _, y in edges]}, dtype="int64")

    return dealt.groupBy("cluster", "i", "j").applyInPandas(compare, "u long, v long")


def _forest(sets: list[np.ndarray], roots: np.ndarray, blocks: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Linked pairs (from different blocks, if there are two) that join different components, none twice."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets)
    _, number, times = np.unique(items, return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    row = np.repeat(np.arange(n), sizes)
    keep = shared[number]
    row, number = row[keep], column[number[keep]]
    common = np.zeros((n, n), np.float64)
    step = max(1, (8 << 20) // max(1, n))  # columns at a time, to bound memory
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    for low in range(0, int(shared.sum()), step):
        s, e = np.searchsorted(number, (low, low + step))
        part = np.zeros((n, min(step, int(shared.sum()) - low)), np.float32)
        part[row[s:e], number[s:e] - low] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    links = rule.linked(common, sizes[:, None], sizes[None, :]) & (roots[:, None] != roots[None, :])
    if len(set(blocks.tolist())) > 1:
        links &= blocks[:, None] != blocks[None, :]
    found, parent = [], {r: r for r in roots.tolist()}

    def top(r):
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    for x, y in zip(*np.nonzero(np.triu(links)), strict=True):
        a, b = top(int(roots[x])), top(int(roots[y]))
        if a != b:
            parent[a] = b
            found.append((int(x), int(y)))
    return found


def jaccard_components(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_shingles, component_id, class_id, component_class, text_hash.

    A document's set: its distinct k-word shingles, A-Z lower-cased; with fewer words, all of them as one.
    Documents link when den * intersection >= num * union; component_id is the smallest id in reach. Without
    words, null texts included, the set is empty and links with nothing. Rows with a null id are linked like
    others, but lend no id: a component of such rows only has a null one. Repeated rows are one class
    (class_id), linked; component_class tells components apart where ids repeat. Links are decided on words, not on
    their hashes. Other columns are not looked at.
    """
    return components_of(df, Rule(k, num, den), id_col, text_col)


def _with(pairs: DataFrame, star: DataFrame) -> DataFrame:
    return pairs.unionByName(star.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).distinct()


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with further links (u, v): what roots says of the earlier links stands in for them."""
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links))


def components_of(df: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(df, text_col)
    slim = df.select(df[id_col].cast("long").alias("id"), text_key(text).alias("h"), text.alias("text"))
    slim = materialize(slim.mapInArrow(_classes(rule), "id long, h string, n long, d long, other long, sketch binary"), "ngram-classes")
    clashing = frozenset(r[0] for r in slim.groupBy("d").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a <> b").select("d").limit(MOST_CLASHING).collect())
    if clashing:
        slim = slim.withColumn("d", F.when(F.col("d").isin(list(clashing)), F.col("other")).otherwise(F.col("d")))
    sets = slim.filter("n > 0")
    classes = sets.groupBy("d").agg(F.min("n").alias("n"), F.min("h").alias("h"), F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"), F.first("sketch").alias("sketch"), F.min("other").alias("one"), F.max("other").alias("two"))
    classes = materialize(classes, "ngram-distinct")
    if clashing and classes.filter("one <> two").take(1):
        raise ValueError("classes of texts can't be told apart by 128 bits")
    pairs, hot = candidates(df, rule, text_col, clashing)
    star = materialize(stars(hot), "ngram-stars")
    links = materialize(verified(_with(pairs, star), classes, df, rule, text_col), "ngram-links")
    roots = components(links)
    if star.take(1):
        members = unsettled(star, roots, classes)
        largest = members.agg(F.max("size")).first()[0]
        if largest:
            texts = texts_of(members, df, text_col)
            if largest > LARGE:
                pairs, hot = candidates(texts, replace(rule, fine=True), "text", clashing)
                star = materialize(stars(hot), "ngram-stars")
                roots = _grown(roots, verified(_with(pairs, star), classes, texts, rule))
                members = unsettled(star, roots, classes) if star.take(1) else members.limit(0)
            if members.take(1):
                roots = _grown(roots, compared_in_blocks(members, texts, rule))
    classes = classes.join(roots.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    entries = classes.join(least, "root").select("d", "rows", "component_id", "root")
    found = join_entries(sets.select("id", "h", "n", "d"), entries, ["d"], "rows", slim.count())
    alone = slim.filter("n = 0").select("id", "h", "n", "d", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    out = found.select("id", "h", "n", "d", "component_id", "root").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("d").alias("class_id"), F.col("root").alias("component_class"), F.col("h").alias("text_hash"))


def one_of_each_component(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whatever their names, of which one of each component of linked documents stays: the one with the smallest id.

    Of several rows with that id, the one with the smallest text hash stays, and of those that are equal one. Documents
    without words are linked with nothing and stay, as do components in which all ids are null.
    """
    found = materialize(jaccard_components(df, k, num, den, id_col, text_col).withColumnRenamed(id_col, "id"), "ngram-components")
    linked = found.filter("n_shingles > 0 and component_id is not null").select("component_class", "component_id", "id", F.col("text_hash").alias("h"))
    first = linked.filter("id = component_id").groupBy("component_class", "component_id").agg(F.min("h").alias("first"))
    size = linked.groupBy("component_class").agg(F.count(F.lit(1)).alias("rows"))
    entries = first.drop("component_id").join(size, "component_class")
    linked = join_entries(linked, entries, ["component_class"], "rows", found.count())
    gone = linked.filter("id is null or id <> component_id or h <> first").select("id", "h").distinct()
    repeated = linked.filter("id = component_id and h = first").groupBy("id", "h").count().filter("count > 1").select("id", "h")
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), df[id_col].cast("long").alias("id"), text_key(text_or_empty(df, text_col)).alias("h"))
    # most rows are in neither, and stay where they are: whole texts are exchanged for the others alone
    named = materialize(gone.select("h").unionByName(repeated.select("h")).select(F.xxhash64("h").alias("x")), "ngram-named")
    met = in_bitmap(named, "x", F.xxhash64("h"))
    rest, rows = rows.filter(~met).select("row"), rows.filter(met)
    rows = rows.join(gone.withColumnsRenamed({"id": "gone", "h": "gone_h"}), F.col("id").eqNullSafe(F.col("gone")) & (F.col("h") == F.col("gone_h")), "left_anti")
    again = rows.join(repeated, ["id", "h"], "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("id", "h").orderBy(F.xxhash64("row")))).filter("rank = 1")
    return rows.join(repeated, ["id", "h"], "left_anti").select("row").unionByName(again.select("row")).unionByName(rest).select("row.*")
