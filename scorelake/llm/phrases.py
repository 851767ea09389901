"""Phrase collocation mining with compressed position bitmaps.

Tasks lay the words of their documents out as positions, with an empty one between pieces and between
documents, and cut them into shards of bounded length. A word has a bitmap of its positions, of which only the
blocks with a bit are stored. A phrase is extended by a word by shifting its bitmap one position on, AND with
the word's bitmap, and a popcount of what is left; a shift out of a piece meets an empty position. Phrases are
extended depth first, a slice of the bitmaps at a time, and the popcounts are summed over shards by Spark.

There is a pass over the documents for each length. Its tasks only follow prefixes and suffixes that a filter has for frequent;
the filter is a bitmap of at most 2**MOST_BITS cells, so it has the same bound whatever the corpus. It lets all frequent
phrases pass and a few others, whose exact sums then tell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize
from .words import _BASE, _FIRST, mixed

#: What ends a piece becomes a line feed, a tab a space, and A-Z are lower-cased.
_PLAIN = bytes(10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bytes of a shard, about, and entries of bitmaps that are extended at a time.
SHARD, SLICE = 1 << 22, 1 << 16
#: Bits of a block. Only blocks with a bit are stored.
_BLOCK = 16
#: Cells of the filter for each frequent phrase, and the log of the most cells (16 MB).
CELLS, MOST_BITS = 16, 27
#: What a language's words are cut into before its best are taken, so that no task ranks all of them.
_PARTS = 64
#: Words of more bytes are hashed and compared one by one.
_LONG = 256


@dataclass
class Shard:
    """The number of the word at each position, 0 where there is none, and of each number from 1 the language, the word, and a hash of both."""

    positions: np.ndarray
    langs: list[str]
    words: list[bytes]
    hashes: np.ndarray


def shards(rows: Iterable[tuple[str, bytes]]) -> Iterator[Shard]:
    """Shards of bounded size of rows of language and text. A text that fills one goes on in another, from a piece's start."""
    held: list[tuple[str, bytes]] = []
    size = 0
    for lang, text in rows:
        data, start = text.translate(_PLAIN), 0
        while size + len(data) - start >= SHARD:
            cut = data.rfind(b"\n", start, start + max(1, SHARD - size))
            cut = data.find(b"\n", start) if cut < 0 else cut
            if cut < 0:
                break
            held.append((lang, data[start:cut]))
            yield numbered(held)
            held, size, start = [], 0, cut + 1
        held.append((lang, data[start:]))
        size += len(data) - start + 1
        if size >= SHARD:
            yield numbered(held)
            held, size = [], 0
    if held:
        yield numbered(held)


def numbered(texts: list[tuple[str, bytes]]) -> Shard:
    """The shard of some texts, in which spaces part words and line feeds pieces."""
    data = b"".join(t + b"\n" for _, t in texts) + bytes(8)
    code = np.frombuffer(data, np.uint8)[:-8]
    inside = np.zeros(len(code) + 2, np.int8)
    inside[1:-1] = (code != 32) & (code != 10)
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    size = ends - starts
    names = list(dict.fromkeys(lang for lang, _ in texts))
    place = {lang: k for k, lang in enumerate(names)}
    bounds = np.cumsum([len(t) + 1 for _, t in texts])
    lang_of = np.array([place[lang] for lang, _ in texts])[np.searchsorted(bounds, starts, side="right")]
    eights = np.ndarray(len(code) + 1, "<u8", data, strides=(1,))
    salt = np.array([int.from_bytes(hashlib.sha256(lang.encode("utf-8", "surrogatepass")).digest()[:8], "little") for lang in names], np.uint64)
    own = mixed(_eight(eights, starts, size, 0) ^ (size.astype(np.uint64) * _BASE) ^ salt[lang_of])
    at, longer = 8, np.flatnonzero((size > 8) & (size <= _LONG))
    while len(longer):
        own[longer] = mixed(own[longer] * _BASE + mixed(_eight(eights, starts[longer], size[longer], at) + np.uint64(at)))
        at += 8
        longer = longer[size[longer] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        own[k] = own[k] ^ np.uint64(int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little"))
    hashes, first, number = np.unique(own, return_index=True, return_inverse=True)
    if not _same(data, eights, starts, size, lang_of, first[number]):  # two words with one hash, once in a long while
        seen: dict[tuple, int] = {}
        keys = [(int(n), data[a:b]) for n, a, b in zip(lang_of, starts, ends, strict=True)]
        number = np.array([seen.setdefault(key, len(seen)) for key in keys], np.int64)
        first = np.unique(number, return_index=True)[1]
        hashes = own[first]
    marks = np.zeros(len(code), np.int32)
    marks[starts] = 1
    marks[np.flatnonzero(code == 10)] = 1
    spot = np.cumsum(marks, dtype=np.int32)
    positions = np.zeros(int(spot[-1]) if len(spot) else 0, np.int64)
    positions[spot[starts] - 1] = number + 1
    words = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return Shard(positions, [names[k] for k in lang_of[first].tolist()], words, hashes)


def _eight(eights: np.ndarray, starts: np.ndarray, size: np.ndarray, at: int) -> np.ndarray:
    """The bytes of each word from `at` on as one number, eight of them at most."""
    return eights[starts + at] & _FIRST[np.clip(size - at, 0, 8)]


def _same(data: bytes, eights: np.ndarray, starts: np.ndarray, size: np.ndarray, lang_of: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word is the other one, of the same language."""
    if (size != size[other]).any() or (lang_of != lang_of[other]).any():
        return False
    at, left = 0, np.arange(len(size))
    while at < _LONG and len(left):
        if (_eight(eights, starts[left], size[left], at) != _eight(eights, starts[other[left]], size[left], at)).any():
            return False
        at += 8
        left = left[size[left] > at]
    return all(data[starts[k] : starts[k] + size[k]] == data[starts[other[k]] : starts[other[k]] + size[k]] for k in left.tolist())


@dataclass
class Bitmaps:
    """Entries of bitmaps: the phrase, the block of positions, and its bits, none of which is empty."""

    phrase: np.ndarray
    block: np.ndarray
    bits: np.ndarray

    def popcounts(self, n: int) -> np.ndarray:
        return np.bincount(self.phrase, np.bitwise_count(self.bits), n).astype(np.int64)

    def where(self, kept: np.ndarray) -> Bitmaps:
        """Those of kept phrases, numbered anew."""
        here = kept[self.phrase]
        return Bitmaps((np.cumsum(kept) - 1)[self.phrase[here]], self.block[here], self.bits[here])

    def shifted(self) -> Bitmaps:
        """All positions moved on by one."""
        out = self.bits >> np.uint16(_BLOCK - 1) != 0
        bits = np.concatenate([self.bits << np.uint16(1), np.ones(out.sum(), np.uint16)])
        return Bitmaps(np.concatenate([self.phrase, self.phrase[out]]), np.concatenate([self.block, self.block[out] + 1]), bits)


def word_bitmaps(positions: np.ndarray, n: int) -> Bitmaps:
    """The bitmaps of the words 1 to n as phrases 0 to n - 1, ordered by block."""
    at = np.flatnonzero(positions)
    code = (at // _BLOCK) * n + positions[at] - 1
    order = np.argsort(code, kind="stable")
    code, at = code[order], at[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    bits = np.bitwise_or.reduceat(np.uint16(1) << (at % _BLOCK).astype(np.uint16), first) if len(first) else np.zeros(0, np.uint16)
    return Bitmaps(code[first] % max(n, 1), code[first] // max(n, 1), bits)


def extended(prefixes: Bitmaps, words: Bitmaps, starts: np.ndarray, n: int) -> tuple[Bitmaps, np.ndarray, np.ndarray]:
    """(bitmaps of the phrases that are a prefix and one of n words; the prefix and the word of each). starts: where each block's words begin."""
    moved = prefixes.shifted()
    block = np.minimum(moved.block, len(starts) - 2)  # nothing stands behind the last block
    size = np.where(moved.block == block, starts[block + 1] - starts[block], 0)
    i = np.repeat(np.arange(len(size)), size)
    j = np.arange(len(i)) + np.repeat(starts[block] - np.cumsum(size) + size, size)
    bits = moved.bits[i] & words.bits[j]
    met = np.flatnonzero(bits)
    i, j = i[met], j[met]
    phrases, number = np.unique(moved.phrase[i] * n + words.phrase[j], return_inverse=True)
    return Bitmaps(number, moved.block[i], bits[met]), phrases // n, phrases % n


class Frequent:
    """A bitmap of cells of hashes: false only for a hash that is not among those put in."""

    def __init__(self, cells: np.ndarray, bits: int):
        self.cells, self.bits = cells, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        cell = hashes >> np.uint64(64 - self.bits)
        return self.cells[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1) != 0


def _joined(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase of a prefix and a word."""
    return mixed(prefix * _BASE + word + np.uint64(1))


def counted(shard: Shard, length: int, frequent: list[Frequent]) -> Iterator[tuple[list[str], list[bytes], np.ndarray, np.ndarray]]:
    """(languages, phrases, hashes, counts in the shard) of its phrases of that many words whose shorter parts are all frequent. frequent: by length less 1."""
    positions, langs, words, hashes = shard.positions, shard.langs, shard.words, shard.hashes
    if length == 1:
        yield langs, words, hashes, word_bitmaps(positions, len(words)).popcounts(len(words))
        return
    kept = frequent[0].has(hashes)
    n = int(kept.sum())
    if not n:
        return
    number = np.concatenate([[0], np.where(kept, np.cumsum(kept), 0)])
    own = word_bitmaps(number[positions], n)
    langs, words, hashes = ([x for x, k in zip(some, kept, strict=True) if k] for some in (langs, words, hashes))
    hashes = np.array(hashes, np.uint64)
    starts = np.searchsorted(own.block, np.arange(len(positions) // _BLOCK + 2))
    order = np.argsort(own.phrase, kind="stable")
    own_down = Bitmaps(own.phrase[order], own.block[order], own.bits[order])

    def deeper(prefixes: Bitmaps, names: list[bytes], own_langs: list[str], whole: np.ndarray, tail: np.ndarray, depth: int):
        """tail: the hash of each prefix without its first word, where there are more."""
        for a in range(0, len(prefixes.phrase), SLICE):
            some = Bitmaps(prefixes.phrase[a : a + SLICE], prefixes.block[a : a + SLICE], prefixes.bits[a : a + SLICE])
            longer, p, w = extended(some, own, starts, n)
            suffix = _joined(tail[p], hashes[w]) if depth > 1 else hashes[w]
            fits = frequent[depth - 1].has(suffix)
            full = _joined(whole[p], hashes[w])
            if depth + 1 < length:
                fits &= frequent[depth].has(full)
            longer, p, w, full, suffix = longer.where(fits), p[fits], w[fits], full[fits], suffix[fits]
            found = [names[x] + b" " + words[y] for x, y in zip(p.tolist(), w.tolist(), strict=True)]
            of = [own_langs[x] for x in p.tolist()]
            if depth + 1 == length:
                yield of, found, full, longer.popcounts(len(found))
            elif found:
                down = np.argsort(longer.phrase, kind="stable")
                yield from deeper(Bitmaps(longer.phrase[down], longer.block[down], longer.bits[down]), found, of, full, suffix, depth + 1)

    yield from deeper(own_down, words, langs, hashes, hashes, 1)


def _filter(counts: DataFrame) -> Frequent:
    """The filter of the hashes h of counts."""
    n = counts.count()
    bits = max(6, min(MOST_BITS, (CELLS * n).bit_length()))
    cell = F.shiftrightunsigned("h", 64 - bits)
    rows = counts.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits"))
    found = rows.toArrow()  # 2**(MOST_BITS - 6) rows of 16 bytes at most
    cells = np.zeros(1 << (bits - 6), np.uint64)
    cells[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Frequent(cells, bits)


def _counts(texts: DataFrame, length: int, least: int, frequent: list[Broadcast]) -> DataFrame:
    """lang, phrase, h, a of the phrases of that many words with a >= least, on shared files. Of length 1 also a row with a null phrase: the language's number of words."""

    def run(batches):
        known = [f.value for f in frequent]
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for shard in shards(rows):
            for langs, phrases, hashes, counts in counted(shard, length, known):
                if length == 1:
                    every = dict.fromkeys(langs, 0)
                    for lang, c in zip(langs, counts.tolist(), strict=True):
                        every[lang] += c
                    langs, phrases = [*langs, *every], [*phrases, *[None] * len(every)]
                    hashes, counts = np.concatenate([hashes, np.zeros(len(every), np.uint64)]), np.concatenate([counts, np.array([*every.values()], np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(hashes.view(np.int64)), pa.array(counts)], names=["lang", "phrase", "h", "c"])

    # shards are sums already; a second table of them in each task would hold nearly as many rows, so the sums are made behind the exchange
    found = texts.mapInArrow(run, "lang string, phrase binary, h long, c long").repartition("lang", "phrase", "h").groupBy("lang", "phrase", "h").agg(F.sum("c").alias("a"))
    return materialize(found.filter((F.col("a") >= least) | F.col("phrase").isNull()).withColumn("phrase", F.col("phrase").cast("string")), f"phrases-{length}")


def cut_score(a: int, l: int, r: int) -> int:  # noqa: E741
    """The score of a cut, in whole numbers of any size."""
    return 1_000_000 * a * a // (l * r)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("l", "r", "score")]))
def _lowest(a: pd.Series, lefts: pd.Series, rights: pd.Series) -> pd.DataFrame:
    """Of each phrase the cut with the lowest score, the first of equal ones."""
    out = []
    for x, ls, rs in zip(a.tolist(), lefts, rights, strict=True):
        cuts = [(cut_score(x, int(left), int(right)), k, int(left), int(right)) for k, (left, right) in enumerate(zip(ls, rs, strict=True))]
        score, _, left, right = min(cuts)
        out.append((left, right, score))
    return pd.DataFrame(out, columns=["l", "r", "score"])


def _words_from(phrase: str, first: int, n: int, of: int):
    """The n words from number first (from 0) on, of a phrase of so many."""
    return F.substring_index(F.substring_index(phrase, " ", first + n), " ", -n) if first else F.substring_index(phrase, " ", n) if n < of else F.col(phrase)


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, longest: int = 3, top: int = 2000) -> DataFrame:
    """Each language's top phrases of 2 to longest words: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lower-cased, texts cut into pieces at . , ; : ! ? and the characters 10 to 13, and pieces at spaces and
    tabs into words. All is counted per language (null: und) over all documents and whole texts of any length, repeated rows as
    often as they stand there; null texts count as empty. Phrases with a >= least occurrences are scored at their weakest
    cut (see `cut_score`); those inside a longer one with at least half of their occurrences are left out. Order: score and a
    falling, then the phrase's bytes. A language without such phrases has no row. Other columns are not looked at.
    """
    spark = df.sparkSession
    texts = df.select(F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang"), df[text_col].cast("string").cast("binary").alias("text")).filter("text is not null")
    by_length: list[DataFrame] = []
    filters: list[Broadcast] = []
    for length in range(1, longest + 1):
        by_length.append(_counts(texts, length, least, filters))
        if length < longest:
            filters.append(spark.sparkContext.broadcast(_filter(by_length[-1].filter("phrase is not null"))))
    total = by_length[0].filter("phrase is null").select("lang", F.col("a").alias("n"))
    scored, around = None, None
    for length in range(longest, 1, -1):
        own = by_length[length - 1].select("lang", "phrase", "a")
        for k in range(1, length):
            for side, first, n in (("l", 0, k), ("r", k, length - k)):
                part = by_length[n - 1].filter("phrase is not null").select("lang", F.col("phrase").alias("part"), F.col("a").alias(f"{side}{k}"))
                own = own.withColumn("part", _words_from("phrase", first, n, length)).join(part, ["lang", "part"]).drop("part")
        cuts = _lowest("a", F.array(*(f"l{k}" for k in range(1, length))), F.array(*(f"r{k}" for k in range(1, length))))
        found = own.select("lang", "phrase", "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.*")
        if around is not None:
            most = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            found = found.join(most, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 50 * a").drop("longer")
        scored = found if scored is None else scored.unionByName(found)
        inside = [_words_from("phrase", first, n, length) for n in range(2, length) for first in range(length - n + 1)]
        if inside:
            parts = by_length[length - 1].select("lang", F.explode(F.array(*inside)).alias("phrase"), F.col("a").alias("longer"))
            around = parts if around is None else around.unionByName(parts)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
