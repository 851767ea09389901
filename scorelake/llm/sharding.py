"""Histogram sort: shards of near equal bytes, in key order, with one exchange.

The key of a row is 128 bits: the hash of its text, then the hash of its id. Splitters are found
before any row moves: probes cut the key space below each open splitter into 2**DIGIT parts, the
exact bytes of all parts are counted over all partitions, and the part in which the splitter's
target lies is cut again, until a probe is within the tolerance of the target. Equal texts are
neighbours in key order, so a shard's edge falls into such a group only if the group holds more
bytes than the tolerance; then the id's hash cuts it. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bits_for, flipped, materialize, prefix, ranked, text_or_empty

#: Bits by which open parts are cut in each pass, and of a key.
DIGIT, KEY = 8, 128


def _digits(depth: int) -> Column:
    """The first bits of the key, as text: unique and of fixed length for each depth."""
    high = F.lpad(F.hex(prefix(F.col("h"), min(depth, 64))), 16, "0")
    return high if depth <= 64 else F.concat(high, F.lpad(F.hex(prefix(F.col("r"), depth - 64)), 16, "0"))


def _number(text: str, depth: int) -> int:
    return int(text[:16], 16) if depth <= 64 else int(text[:16], 16) << (depth - 64) | int(text[16:], 16)


def _text(number: int, depth: int) -> str:
    return f"{number:016X}" if depth <= 64 else f"{number >> (depth - 64):016X}{number & ((1 << (depth - 64)) - 1):016X}"


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.002) -> list[int]:
    """shards - 1 keys of 128 bits; the bytes below the j-th are near j / shards of all bytes.

    keys: h, r, size. tolerance: the greatest error, as a share of a shard. The driver gets at
    most (shards - 1) * 2**DIGIT counts a pass.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    allowed = tolerance * total / shards
    open_ = {j: (0, 0) for j in range(1, shards)}  # splitter: the part it lies in, bytes below that part
    found: dict[int, int] = {}
    depth = 0
    while open_:
        parts = sorted({p for p, _ in open_.values()})
        rows = keys if depth == 0 else keys.filter(_digits(depth).isin([_text(p, depth) for p in parts]))
        depth += DIGIT
        counts: dict[int, list[tuple[int, int]]] = {p: [] for p in parts}
        for text, size in rows.groupBy(_digits(depth)).agg(F.sum("size")).collect():
            p = _number(text, depth)
            counts[p >> DIGIT].append((p, size))
        still = {}
        for j, (part, below) in open_.items():
            target = j * total / shards
            for p, size in sorted(counts[part]):
                if below + size >= target:
                    break
                below += size
            else:
                p, size = ((part + 1) << DIGIT) - 1, 0
            low, high = target - below, below + size - target
            if min(low, high) <= allowed or depth == KEY:
                found[j] = (p if low <= high else p + 1) << (KEY - depth)
            else:
                still[j] = (p, below)
        open_ = still
    return [found[j] for j in range(1, shards)]


def _signed(number: int) -> int:
    """The 64-bit number as `flipped` orders it."""
    return number - 2**63


def assign_shards(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, rows_per_task: int = 20_000) -> DataFrame:
    """One row for each document: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size: UTF-8 bytes of the text (null: none) plus overhead. Shards are ranges of the key, so they
    hold near equal bytes, up to the tolerance or one row. Repeated rows have the same key and get
    slots of their own; a null id is hashed like any other; an empty table gives no rows; other
    columns are not looked at.
    """
    text = text_or_empty(df, text_col)
    keys = df.select(
        df[id_col].alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.xxhash64(df[id_col]).alias("r")
    )
    keys = materialize(keys, "shard-keys")
    edges = [e for e in splitters(keys, shards) if e < 1 << KEY]
    h, r = flipped(F.col("h")), flipped(F.col("r"))
    shard = F.lit(0)
    for e in edges:
        high, low = _signed(e >> 64), _signed(e & (2**64 - 1))
        shard = shard + ((h > high) | ((h == high) & (r >= low))).cast("int")
    bits = bits_for(keys.count() // shards, rows_per_task)
    placed = keys.withColumns({"shard": shard, "_part": prefix(F.col("r"), bits), "_h": h, "_r": r})
    placed = ranked(placed, ["shard"], "_part", ["_h", "_r", "id"], "slot")
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
