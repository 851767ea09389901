"""Mixing sources to target weights by Pfair scheduling of their blocks.

The rows of each source are cut into blocks of equal length. If all sources were drawn at once, each in
proportion to its weight and until it is empty, source i would have given min(w_i v, blocks_i) blocks at
virtual time v; the sum of all is the number of slots t(v) filled by then. So the j-th block (from 1) gets
a window: it may take a slot from floor(t((j - 1) / w)) on and must have one before ceil(t(j / w)). Each
slot goes to the block with the earliest deadline among those released. Weights are not rounded.

No scheduler sees all slots: they are cut into chunks, each dealt out in one task without regard to the others.
Of the blocks whose windows a chunk's end cuts, those with the earliest deadlines come before it, as far as
their releases leave room: for each slot r, the blocks released from r on that come before the end t are at
most t - r. With such a choice at both ends every block of a chunk gets a slot in its window, so at any slot
a source is less than one block off its target.

Any number of sources: those with less than 1 / MOST_ALONE of all weight form classes of weights that
differ by less than twice. A class is scheduled as one source; inside, blocks go by the virtual time
(j - 1 + u) / w, with a number u in (0, 1) from the hash of the source, so that equal ones take turns.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bits_for, free_names, materialize, prefix, ranked, text_or_empty

#: Slots of a chunk at least, and chunks at most; and the most sources that are no part of a class.
PERIOD, MOST_CHUNKS, MOST_ALONE = 2048, 4096, 256
#: Slots before a chunk's end in which room for the blocks that it cuts is looked for: all of the chunk, unless it is longer.
LOOK_BACK = 1 << 16
#: What rounding of numbers may add to a number of slots.
TINY = 1e-7


def earliest_deadlines(windows: list[tuple], first: int = 0) -> list[tuple]:
    """(name, number, slot) of the jobs (name, number, release, deadline), a slot each from first on: earliest deadline first among the released.

    Jobs of a name are in order. Where none is released, the next to be released comes early.
    """
    coming = sorted((release, deadline, name, j) for name, j, release, deadline in windows)
    ready: list[tuple] = []
    out, at = [], 0
    for slot in range(first, first + len(coming)):
        while at < len(coming) and (coming[at][0] <= slot or not ready):
            _, deadline, name, j = coming[at]
            heapq.heappush(ready, (deadline, name, j))
            at += 1
        _, name, j = heapq.heappop(ready)
        out.append((name, j, slot))
    return out


def _curve(w: np.ndarray, blocks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Virtual times, and the blocks that n sources each of these weights and blocks have given by then; linear between."""
    order = np.argsort(blocks / w, kind="stable")
    times = np.concatenate([[0.0], (blocks / w)[order]])
    rates = np.cumsum((w * n)[order][::-1])[::-1]
    given = np.concatenate([[0.0], np.cumsum(np.diff(times) * rates)])
    return times, given * ((blocks * n).sum() / given[-1])


class Plan:
    """Slots for the blocks of some classes of sources, chunk by chunk.

    sizes: (class, weight, blocks, number of sources with them).
    """

    def __init__(self, sizes: list[tuple], period: int = PERIOD, most_chunks: int = MOST_CHUNKS):
        self.names = sorted({r[0] for r in sizes})
        cls = np.array([r[0] for r in sizes])
        w, blocks, n = (np.array([r[k] for r in sizes], np.float64) for k in (1, 2, 3))
        self.all = _curve(w, blocks, n)
        self.own = [_curve(w[cls == c], blocks[cls == c], n[cls == c]) for c in self.names]
        total = int((blocks * n).sum())
        span = max(period, -(-total // most_chunks))
        self.ends = np.minimum(np.arange(-(-total // span) + 1) * span, total)
        #: virtual times of the chunks' ends
        self.times = np.interp(self.ends, self.all[1], self.all[0])
        target = np.array([np.interp(self.times, *c) for c in self.own])
        target[:, -1] = [round(c[1][-1]) for c in self.own]
        low, high = np.floor(target + TINY), np.ceil(target - TINY)
        #: blocks of each class before each chunk's end
        self.before = np.zeros(target.shape, np.int64)
        for q in range(1, len(self.ends)):
            taken = low[:, q].copy()
            taken[self._early(q, taken, np.flatnonzero(taken < high[:, q]))] += 1
            while (free := int(self.ends[q] - taken.sum())) != 0:  # only by inexact numbers
                step = 1 if free > 0 else -1
                may = taken < target[:, -1] if free > 0 else taken > self.before[:, q - 1]
                taken[np.argmax(np.where(may, step * (target[:, q] - taken), -np.inf))] += step
            self.before[:, q] = taken

    def _early(self, q: int, low: np.ndarray, open_: np.ndarray) -> list[int]:
        """The classes, of those whose next block has a window that chunk q's predecessor's end cuts, that have this block before it."""
        end, free = int(self.ends[q]), int(self.ends[q] - low.sum())
        if not len(open_) or free <= 0:
            return []
        first = max(int(self.ends[q - 1]), end - LOOK_BACK)
        release = lambda curve, n: np.floor(np.interp(np.interp(n, curve[1], curve[0]), *self.all) + TINY).astype(int)
        # how many blocks that must come before the end are released in each slot
        released = np.zeros(end - first + 1, np.int64)
        v = np.interp(first, self.all[1], self.all[0])
        for curve, n in zip(self.own, low, strict=True):
            some = np.arange(np.ceil(np.interp(v, *curve) - TINY), n)
            if len(some):
                np.add.at(released, np.maximum(release(curve, some) - first, 0), 1)
        room = end - np.arange(first, end + 1) - np.cumsum(released[::-1])[::-1]
        room[0] = max(room[0], free)  # blocks left over by the chunk before are released there: the numbers fit as a whole
        due = [np.interp(low[i] + 1, self.own[i][1], self.own[i][0]) for i in open_]
        chosen = []
        for k in np.argsort(due, kind="stable"):
            i = int(open_[k])
            some = room[: max(0, int(release(self.own[i], low[i])) - first) + 1]
            if len(chosen) < free and some.min() >= 1:
                some -= 1
                chosen.append(i)
        return chosen

    def chunk_slots(self, q: int) -> list[tuple]:
        """(class, number of the block in its class, slot) of chunk q."""
        windows = []
        for name, curve, a, b in zip(self.names, self.own, self.before[:, q], self.before[:, q + 1], strict=True):
            if a < b:
                at = np.interp(np.interp(np.arange(a, b + 1), curve[1], curve[0]), *self.all)
                release, deadline = np.floor(at[:-1] + TINY).astype(int), np.ceil(at[1:] - TINY).astype(int)
                windows += zip([name] * int(b - a), range(a, b), release.tolist(), deadline.tolist(), strict=True)
        return earliest_deadlines(windows, int(self.ends[q]))


def _sources(df: DataFrame, source, weights: dict[str, float] | None, block: int) -> DataFrame:
    """source_key, n, blocks, w, cls and u of each source: its rows and blocks, its weight, its class and where in a block's window it stands."""
    counts = df.groupBy(source.alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    if weights:
        positive = [float(w) for w in weights.values() if w > 0]
        least = min(positive, default=1.0)
        last = sum(positive, least) * 2.0**-40
        given = df.sparkSession.createDataFrame([(s, max(float(w), last)) for s, w in weights.items()], "source_key string, w double")
        counts = counts.join(given, "source_key", "left").withColumn("w", F.coalesce("w", F.lit(least)))
    else:
        counts = counts.withColumn("w", F.sqrt("n"))
    counts = materialize(counts.withColumn("blocks", F.ceil(F.col("n") / block)), "mix-sources")
    total = counts.agg(F.sum("w")).first()[0]
    alone = F.col("w") >= F.lit(total) / MOST_ALONE
    cls = F.when(alone, F.concat(F.lit("s"), "source_key")).otherwise(F.format_string("w%04d", F.floor(F.log2("w"))))
    return counts.withColumns({"cls": cls, "u": F.when(alone, 1.0).otherwise((F.pmod(F.xxhash64("source_key"), F.lit(1 << 20)) + 0.5) / (1 << 20))})


def _placed(sources: DataFrame, block: int) -> DataFrame:
    """source_key, block, slot, chunk, phase (sources that are empty before the slot) and start (rows before it) of all blocks."""
    spark = sources.sparkSession
    sizes = [tuple(r) for r in sources.groupBy("cls", "w", "blocks").count().collect()]
    if not sizes:
        return spark.createDataFrame([], "source_key string, block long, slot long, phase long, start long")
    plan = Plan(sizes)
    edges, chunks = plan.times[1:-1], len(plan.ends) - 1

    @F.pandas_udf("long")
    def chunk_of(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, v.to_numpy()))

    def dealt(batches):
        for batch in batches:
            for q in batch["id"]:
                out = pd.DataFrame(plan.chunk_slots(q), columns=["cls", "k", "slot"])
                yield out.assign(chunk=q)

    # a source's blocks in two steps, so that no array is long
    ranges = sources.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(4096).cast("long"))))
    blocks = ranges.withColumn("block", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + 4095, F.col("blocks") - 1))))
    blocks = blocks.withColumn("v", (F.col("block") + F.col("u")) / F.col("w"))
    blocks = blocks.select("source_key", "block", "cls", "v", chunk_of("v").alias("near"), F.least(F.lit(block), F.col("n") - F.col("block") * block).alias("rows"), (F.col("block") == F.col("blocks") - 1).cast("long").alias("last"))
    blocks = ranked(blocks, ["cls"], "near", ["v", "source_key"], "k")
    slots = spark.range(0, chunks, 1, min(chunks, 200)).mapInPandas(dealt, "cls string, k long, slot long, chunk long")
    placed = materialize(blocks.join(slots, ["cls", "k"]).select("source_key", "block", "rows", "last", "slot", "chunk"), "mix-blocks")
    before, inside = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (Window.partitionBy(F.lit(0)).orderBy("chunk"), Window.partitionBy("chunk").orderBy("slot")))
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = placed.groupBy("chunk").agg(F.sum("rows").alias("r"), F.sum("last").alias("l"))  # MOST_CHUNKS rows at most
    sums = sums.select("chunk", so_far("r", before).alias("r"), so_far("l", before).alias("l"))
    placed = placed.join(F.broadcast(sums), "chunk")
    return placed.select("source_key", "block", "slot", (F.col("l") + so_far("last", inside)).alias("phase"), (F.col("r") + so_far("rows", inside)).alias("start"))


#: The columns that mixing adds.
ADDED = ["mix_phase", "mix_block", "mix_slot", "mix_position"]


def _mixed(df: DataFrame, keep: list[str], slim: bool, weights: dict[str, float] | None, source_col: str, id_col: str, text_col: str, block: int, rows_per_task: int) -> DataFrame:
    """row (a struct of the columns keep) and ADDED. slim: rows are small and worth writing once."""
    source = F.coalesce(df[source_col].cast("string"), F.lit(""))
    sources = _sources(df, source, weights, block)
    most = sources.agg(F.max("n")).first()[0] or 0
    blocks = _placed(sources, block)
    bits = bits_for(most, rows_per_task)
    own = df.select(F.struct(*(df[c] for c in keep)).alias("row"), source.alias("source_key"), F.xxhash64(df[id_col], text_or_empty(df, text_col)).alias("h"))
    own = own.withColumn("part", prefix(F.col("h"), bits))
    if slim:
        own = materialize(own, "mix-keys")
    own = ranked(own, ["source_key"], "part", ["h"], "place").withColumn("block", F.floor(F.col("place") / block).cast("long"))
    found = own.join(blocks, ["source_key", "block"])
    return found.select("row", F.col("phase").alias("mix_phase"), F.col("block").alias("mix_block"), F.col("slot").alias("mix_slot"), (F.col("start") + F.col("place") % block).alias("mix_position"))


def mixed_positions(df: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block: int = 64, rows_per_task: int = 2_000, keep: list[str] | None = None) -> DataFrame:
    """The rows of df with mix_phase, mix_block, mix_slot and mix_position (gapless from 0: the order of training).

    weights: target weight of each source; without, the square roots of their numbers of rows. A source
    missing there gets the smallest weight given. Null sources count as '', null texts as empty. Within a source
    rows are ordered by the hash of their ids and texts, of whatever length. All rows get a position, repeated ones
    too. keep: columns of df to return (default: source and id); one that is named like an added one gets "_" appended.
    """
    names = keep or [source_col, id_col]
    placed = _mixed(df, names, not keep, weights, source_col, id_col, text_col, block, rows_per_task)
    return placed.select(*(F.col("row").getField(c).alias(new) for c, new in zip(names, free_names(names, ADDED), strict=True)), *ADDED)


def mixed_documents(df: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """The rows of df with their columns, whatever their names, in the order of training: partitions and the rows in them follow the mix."""
    placed = _mixed(df, df.columns, False, weights, source_col, id_col, text_col, block, 2_000)
    return placed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select("row.*")
