"""Words and word shingles of whole texts, as bytes, as 64-bit hashes and as exact numbers, for the tasks of other operators."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The first so many bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 256


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased: runs of other than space and the characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str, outside: np.ndarray = _SPACE) -> np.ndarray:
    """The hash of each word, A-Z lower-cased. Words are runs of bytes other than white space, or than those outside.

    Eight bytes are taken as one number; the hash so far is mixed with each further eight.
    """
    data = text.encode("utf-8", "surrogatepass").lower() + bytes(8)
    inside = np.zeros(len(data) - 6, np.int8)
    inside[1:-1] = ~outside[np.frombuffer(data, np.uint8)[:-8]]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    size = ends - starts
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = mixed((eights[starts] & _FIRST[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _BASE))
    at, longer = 8, np.flatnonzero((size > 8) & (size <= _LONG))
    while len(longer):
        block = eights[starts[longer] + at] & _FIRST[np.minimum(size[longer] - at, 8)]
        out[longer] = mixed(out[longer] * _BASE + mixed(block + np.uint64(at)))
        at += 8
        longer = longer[size[longer] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def alnum_hashes(text: str) -> np.ndarray:
    """As word_hashes; words are runs of ASCII letters and digits and of other characters' bytes."""
    return word_hashes(text, ~_ALNUM)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, given by theirs; with fewer words, of all of them as one; none without words."""
    k = min(k, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _BASE + words[i : len(words) - k + 1 + i]
    return mixed(out)


def exact_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The set of shingles of each text as rising numbers, which are equal in two of them only for the same words.

    Nothing is hashed: words, and then runs of two, three to k of them, are numbered among all texts given.
    """
    number: dict[bytes, int] = {}
    rows = []
    for text in texts:
        row = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
        rows.append(np.array(row + [0] * (k - len(row)) if row else [], np.int64))  # 0 is no word
    sizes = [max(0, len(r) - k + 1) for r in rows]
    place = lambda i: np.concatenate([r[i : i + n] for r, n in zip(rows, sizes, strict=True)] or [np.zeros(0, np.int64)])
    ids = place(0)
    for i in range(1, k):
        ids = np.unique(ids * (len(number) + 1) + place(i), return_inverse=True)[1]
    return [np.unique(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []
