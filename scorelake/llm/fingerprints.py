"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer when the smallest hash among its s-mers is that of its
first or its last s-mer. Whether it is one depends on the k-mer alone, so an edit disturbs only the
k-mers that it touches, and the same passage gives the same anchors at shifted positions. The
fingerprint holds every anchor of the whole text in the order of positions, so it grows with the text and
no edit is too small for it; likeness counts the shared anchors whose shift others share, wherever they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bits_for, materialize, text_or_empty

K, S = 12, 4
#: Code points in a cell of shifts; small insertions move what follows into the next cell.
SHIFT_CELL = 64
#: Shared anchors on about one shift that count; fewer are chance, unless two texts share no more in all.
SUPPORT = 3
#: Bytes of texts after which a task passes its rows on.
PASS_BYTES = 8 << 20

# The digits of a fingerprint. Each anchor is one digit, its distance from the one before it (from -1 for
# the first), and five digits of its hash.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_DIGITS = np.frombuffer(DIGITS.encode(), np.uint8)
_VALUES = np.zeros(256, np.int64)
_VALUES[_DIGITS] = np.arange(64)
_PLACES = np.array([24, 18, 12, 6, 0], np.uint64)

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n-mer."""
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        out = out * _A + codes[i : len(codes) - n + 1 + i]
    return _mixed(out)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(30-bit hashes, positions) of all of the text's syncmers, positions rising.

    Of k - s k-mers in a row one at least is a syncmer. A text that has none, or that is shorter than a k-mer, is
    one anchor; an empty one has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes) < K:
        return (_rolled(codes, len(codes)) >> np.uint64(34)).astype(np.int64), np.zeros(1, np.int64)
    inner, width = _rolled(codes, S), K - S + 1
    least, reach = inner, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    ends = least == inner[: len(least)]
    ends |= least == inner[width - 1 :]
    at = np.flatnonzero(ends)
    if not len(at):
        at = np.array([int(least.argmin())])
    hashes = np.zeros(len(at), np.uint64)
    for i in range(K):
        hashes = hashes * _A + codes[at + i]
    return (_mixed(hashes) >> np.uint64(34)).astype(np.int64), at


def written(found: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint: six digits for each anchor, see DIGITS."""
    hashes, at = found
    out = np.zeros((len(at), 6), np.uint8)
    out[:, 0] = _DIGITS[np.diff(at, prepend=-1)]
    out[:, 1:] = _DIGITS[((hashes.astype(np.uint64)[:, None] >> _PLACES) & np.uint64(63)).astype(np.int64)]
    return out.tobytes().decode("ascii")


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of a fingerprint."""
    digits = _VALUES[np.frombuffer(fingerprint.encode("ascii"), np.uint8)].reshape(-1, 6)
    return (digits[:, 1:] << _PLACES.astype(np.int64)).sum(axis=1), np.cumsum(digits[:, 0]) - 1


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: the share of common anchors among the distinct ones of both; those count that agree on a shift.

    An anchor stands at its first place in a text. Its shift must be about that of SUPPORT - 1 others, so a passage
    moved as a whole, or one that follows an insertion, counts. Equal fingerprints have 1; an empty one has 0 with
    any that isn't.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    (x, i), (y, j) = np.unique(a[0], return_index=True), np.unique(b[0], return_index=True)
    common, i2, j2 = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    cell = (a[1][i[i2]] - b[1][j[j2]]) // SHIFT_CELL
    cells, place, n = np.unique(cell, return_inverse=True, return_counts=True)
    near = n.copy()
    beside = cells[1:] - cells[:-1] == 1
    near[1:][beside] += n[:-1][beside]
    near[:-1][beside] += n[1:][beside]
    counted = near[place] >= min(SUPPORT, len(common))
    return float(counted.sum() / (len(x) + len(y) - len(common)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_chars, fingerprint. Null counts as empty, and has an empty fingerprint; repeated rows are repeated."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([written(anchors(t)) for t in texts], pa.string())], names=["id", "n_chars", "fingerprint"])

    out = df.select(df[id_col].cast("long").alias("id"), text_or_empty(df, text_col).alias("text")).mapInArrow(run, "id long, n_chars long, fingerprint string")
    return out.withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compare(batches):
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last, kept = None, None  # the following text is mostly the next row's own
    for batch in batches:
        rows, held = [], 0
        for k, i in enumerate(batch.column(0).to_pylist()):
            text, following = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
            other = edited(text, following)
            own = kept if text == last else anchors(text)
            changed, after = anchors(other), anchors(following)
            last, kept = following, after
            rows.append((i, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(changed), likeness(own, changed), likeness(own, after)))
            held += len(text)
            if held > PASS_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


#: The most ranges of ids; beyond, ranges get longer.
MOST_RANGES = 1 << 16


def _cuts_up_to(cuts: list[int], column: Column) -> Column:
    """How many of the rising cuts are at most the column's value: first by whole chunks of cuts, then inside one."""
    if not cuts:
        return F.lit(0)
    chunk = max(1, round(len(cuts) ** 0.5))
    table = lambda some: F.split(F.lit(",".join(map(str, some))), ",").cast("array<bigint>")
    whole = F.size(F.filter(table(cuts[chunk - 1 :: chunk]), lambda e: e <= column))
    return whole * chunk + F.size(F.filter(F.slice(table(cuts), whole * chunk + 1, F.lit(chunk)), lambda e: e <= column))


def with_following(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 2_000) -> DataFrame:
    """id, text and the text of the next document in descending order of ids; after the last comes the first.

    The ids are cut into ranges of about rows_per_task rows; each range gets a copy of the first row
    of the next one, so no task sees more than a range and texts are exchanged once. A range that one repeated
    id, or null, makes larger is cut by the hashes of its texts. Null ids come last; rows with equal ids are ordered
    by their texts' hashes.
    """
    ids = df.select(df[id_col].cast("long").alias("id"), F.xxhash64(text_or_empty(df, text_col)).alias("h"))
    ids = materialize(ids, "following-ids")
    ranges = min(MOST_RANGES, max(1, -(-ids.count() // rows_per_task)))
    cuts = sorted({int(x) for x in ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges)}) if ranges > 1 else []
    # the range's number rises as ids fall; null ids are in the last one
    place = F.when(F.col("id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - _cuts_up_to(cuts, F.col("id")))
    first = F.min(F.struct(F.col("id").isNull().alias("n"), (-F.col("id")).alias("down"), F.col("h"))).alias("first")
    ranged = ids.withColumn("range", place)
    found = ranged.groupBy("range").agg(first, F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).collect()  # a row for each range
    usual = 4 * max(rows_per_task, sum(r["rows"] for r in found) // max(1, ranges))
    heavy = [(r["range"], r["least"], bits_for(r["rows"], rows_per_task)) for r in found if r["rows"] > usual]
    spark = df.sparkSession
    cut = spark.createDataFrame(heavy, "range int, least long, bits int")

    def in_parts(rows: DataFrame) -> DataFrame:
        if not heavy:
            return rows.withColumn("part", F.lit(0).cast("long"))
        of_hash = F.expr("shiftrightunsigned(h ^ -9223372036854775808, 64 - bits)")
        part = F.when(F.col("bits") > 0, F.when(F.col("id").eqNullSafe(F.col("least")), 1 + of_hash))
        return rows.join(F.broadcast(cut), "range", "left").withColumn("part", F.coalesce(part, F.lit(0))).drop("least", "bits")

    if heavy:
        found = in_parts(ranged).groupBy("range", "part").agg(first).collect()
    order = sorted((r["range"], r["part"] if heavy else 0, r["first"]["n"], r["first"]["down"], r["first"]["h"]) for r in found)
    # each part gets the first row of the next one, the last part that of the first
    heads = [(*order[k - 1][:2], None if n else -down, h) for k, (_, _, n, down, h) in enumerate(order)]
    heads = spark.createDataFrame(heads, "range int, part long, head long, head_h long")
    rows = df.select(df[id_col].cast("long").alias("id"), text_or_empty(df, text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    own = in_parts(rows.withColumn("range", place)).select("id", "text", "h", "range", "part", F.lit(0).alias("tail"))
    copies = rows.join(F.broadcast(heads), rows["id"].eqNullSafe(heads["head"]) & (rows["h"] == heads["head_h"]))
    copies = copies.groupBy("range", "part").agg(F.first(F.struct("id", "text", "h")).alias("row")).select("row.id", "row.text", "row.h", "range", "part", F.lit(1).alias("tail"))
    order = Window.partitionBy("range", "part").orderBy("tail", F.col("id").desc_nulls_last(), "h")
    placed = own.unionByName(copies).withColumn("following", F.lead("text").over(order))
    return placed.filter("tail = 0").select("id", "text", F.coalesce("following", F.col("text")).alias("following"))


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    edited: the last floor(n_chars / 3) code points replaced by the first as many of the next document's
    in descending order of ids (see `with_following`). Null texts are empty; two empty fingerprints are
    alike (1). The only row of a table follows itself. Other columns are not looked at.
    """
    out = with_following(df, id_col, text_col).mapInArrow(_compare, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
