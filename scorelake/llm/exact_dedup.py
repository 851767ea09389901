"""Exact deduplication over an extendible-hash index on shared files.

1. A slim table (id, 64-bit hash, SHA-256, bytes) is written once to the shared folder.
2. The directory: bytes of distinct texts below each prefix of the hash. As long as a slot holds more than a
   bucket's capacity the directory doubles, which splits overfull buckets; what needs fewer bits shares a
   bucket. Equal texts share one entry, so a hot text never makes a bucket overfull. Capacity is given in
   bytes, so buckets grow in number with the corpus, up to 2**DEEPEST slots; beyond, they grow in size.
3. Each scan task folds copies together (bounded memory), one exchange deals the rest to the owners, each of
   a range of buckets in key order, and owners walk them in hash order: entries with equal hashes form a chain,
   in which bytes are compared. The index entries go to shared files.
4. Documents look their entry up. Entries of very large groups, at most `HOT_SHARE` of them, are
   broadcast; the others are joined by key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bits_for, materialize, prefix, text_or_empty

#: The directory's greatest depth: a slot takes four bytes in each task.
DEEPEST = 20
#: Bytes of distinct texts in a bucket, and of those that an owner walks, beyond MOST_OWNERS owners.
CAPACITY, OWNED, MOST_OWNERS = 16 << 20, 256 << 20, 256
#: Entries of groups with more than rows / HOT_SHARE rows are broadcast: fewer than HOT_SHARE entries.
HOT_SHARE = 1000
#: Bytes of distinct texts that a scan task holds before it passes them on.
FOLD_BYTES = 32 << 20


def directory(hashes: DataFrame, capacity: int, deepest: int = DEEPEST) -> np.ndarray:
    """The bucket of each slot, of 2**depth, of an extendible-hash directory over the column h. Buckets are numbered in key order.

    hashes: distinct h, and the bytes that each stands for. The driver sees a sum for each slot.
    """
    total = hashes.agg(F.sum("bytes")).first()[0] or 0
    depth = min(deepest, bits_for(total, capacity))
    while True:
        sums = hashes.groupBy(prefix(F.col("h"), depth).alias("slot")).agg(F.sum("bytes").alias("n"), F.max("bytes").alias("most")).toArrow()
        slot, n, most = (sums.column(k).to_numpy() for k in range(3))
        # next to a text of more than half a bucket little is gained by a split
        if depth == deepest or not ((n > capacity) & (n - most > capacity // 2)).any():
            break
        depth += 1
    held = np.zeros(1 << depth, np.int64)
    held[slot] = n
    local = np.full(1 << depth, depth)
    for d in range(depth - 1, -1, -1):
        fits = held.reshape(1 << d, -1).sum(axis=1) <= capacity
        local[np.repeat(fits, 1 << (depth - d))] = d
    own = np.arange(1 << depth)
    first = own >> (depth - local) << (depth - local)
    return (np.cumsum(first == own) - 1).astype(np.int32)


def _fold(bucket_of: np.ndarray, owners: int):
    """Copies within a scan task become one row: (owner, bucket, h, text, largest id, rows, rows with that id)."""
    depth, buckets = int(len(bucket_of)).bit_length() - 1, int(bucket_of[-1]) + 1

    def run(batches):
        seen: dict[tuple[int, str], list] = {}
        held = 0

        def rows():
            h = np.array([k[0] for k in seen], np.int64)
            bucket = bucket_of[(h.view(np.uint64) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(h), np.int64)]
            columns = [pa.array(bucket.astype(np.int64) * owners // buckets, pa.int32()), pa.array(bucket), pa.array(h), pa.array([k[1] for k in seen], pa.string())]
            columns += [pa.array([x[k] for x in seen.values()], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays(columns, names=["owner", "bucket", "h", "text", "keep_id", "group_size", "ties"])

        for batch in batches:
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (h, text) in seen:
                    _add(seen[h, text], i, 1, 1)
                else:
                    seen[h, text] = [i, 1, 1]
                    held += 200 + 2 * len(text)
                if held > FOLD_BYTES:
                    yield rows()
                    seen, held = {}, 0
        if seen:
            yield rows()

    return run


def _add(entry: list, i: int | None, n: int, ties: int) -> None:
    """Into [largest id, rows, rows with that id]; a null id is smaller than any other."""
    entry[1] += n
    if i == entry[0]:
        entry[2] += ties
    elif entry[0] is None or i is not None and i > entry[0]:
        entry[0], entry[2] = i, ties


def _own(batches):
    """An owner's buckets in hash order: chains of equal hashes, in which texts are compared."""

    def closed(h, chain):
        for link, (text, bucket, entry) in enumerate(chain):
            data = text.encode("utf-8", "surrogatepass")
            out.append((bucket, h, link, hashlib.sha256(data).hexdigest(), len(data), *entry))

    out: list[tuple] = []
    at, chain = None, []
    for batch in batches:
        for bucket, h, text, i, n, ties in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if h != at:
                closed(at, chain)
                at, chain = h, []
            for other, _, entry in chain:
                if other == text:
                    _add(entry, i, n, ties)
                    break
            else:
                chain.append((text, bucket, [i, n, ties]))
        if len(out) > 10_000:
            yield _entries(out)
            out.clear()
    closed(at, chain)
    yield _entries(out)


_ENTRY = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("link", pa.int32()), ("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("ties", pa.int64())])


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ENTRY)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENTRY, strict=True)], schema=_ENTRY)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(slim documents: id, h, text_sha256, bytes; index entries, one for each distinct text), both on shared files.

    capacity: bytes of distinct texts that a bucket may hold.
    """
    text = text_or_empty(df, text_col)
    size = F.octet_length(text).cast("long").alias("bytes")
    slim = materialize(df.select(df[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("text_sha256"), size), "dedup-slim")
    hashes = materialize(slim.groupBy("h").agg(F.max("bytes").alias("bytes")), "dedup-hashes")
    bucket_of = directory(hashes, capacity)
    buckets = int(bucket_of[-1]) + 1
    owned = hashes.agg(F.sum("bytes")).first()[0] or 0
    owners = min(buckets, max(MOST_OWNERS, owned // OWNED))
    folded = df.select(df[id_col].cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    folded = folded.mapInArrow(_fold(bucket_of, owners), "owner int, bucket int, h long, text string, keep_id long, group_size long, ties long")
    folded = folded.repartitionById(owners, "owner").drop("owner").sortWithinPartitions("bucket", "h")
    entries = folded.mapInArrow(_own, "bucket int, h long, link int, text_sha256 string, n_bytes long, keep_id long, group_size long, ties long")
    return slim, materialize(entries, "dedup-index")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they have the same bytes; null counts as empty. The row with the
    largest id stays; a null id is smaller than any other, and of rows with the same text and
    the same largest id one stays. Other columns of df are not looked at. An empty table gives none.
    """
    slim, index = build_index(df, id_col, text_col, capacity)
    slim, index = slim.drop("bytes"), index.select("h", "text_sha256", "keep_id", "group_size", "ties")
    least = max(2, slim.count() // HOT_SHARE + 1)
    hot = index.filter(F.col("group_size") >= least)
    columns = ["id", "h", "text_sha256", "keep_id", "group_size", "ties"]
    seen = slim.join(F.broadcast(hot), ["h", "text_sha256"], "left")
    found = seen.filter("group_size is not null").select(columns)
    rest = seen.filter("group_size is null").select("id", "h", "text_sha256").join(index.filter(F.col("group_size") < least), ["h", "text_sha256"]).select(columns)
    both = found.unionByName(rest)
    largest = F.col("id").eqNullSafe(F.col("keep_id"))
    alone = both.filter(~(largest & (F.col("ties") > 1))).withColumn("kept", largest)
    tied = _one_of_ties(both.filter(largest & (F.col("ties") > 1)))
    return alone.unionByName(tied).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def _one_of_ties(tied: DataFrame) -> DataFrame:
    """Rows with the same text and id: the first of the first partition that has any stays."""
    tied = tied.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    tied = materialize(tied, "dedup-ties")
    first = tied.groupBy("h", "text_sha256").agg(F.min("_row").alias("_first"))
    return tied.join(first, ["h", "text_sha256"]).withColumn("kept", F.col("_row") == F.col("_first")).drop("_part", "_row", "_first")


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns, whatever their names.

    Which of rows with the same text and the same largest id stays is told by the hash of all their columns.
    """
    _, index = build_index(df, id_col, text_col)
    text = text_or_empty(df, text_col)
    kept = index.select("h", F.col("text_sha256").alias("sha"), F.col("keep_id").alias("id"), "ties").withColumn("none", F.col("id").isNull()).fillna(0, ["id"])
    id_ = df[id_col].cast("long")
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("sha"), F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("none"))
    rows = rows.join(kept, ["h", "sha", "id", "none"])
    alone = rows.filter("ties = 1").select("row")
    tied = rows.filter("ties > 1").withColumn("rank", F.row_number().over(Window.partitionBy("h", "sha").orderBy(F.xxhash64("row")))).filter("rank = 1").select("row")
    return alone.unionByName(tied).select("row.*")
