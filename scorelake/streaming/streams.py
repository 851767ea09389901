"""Streams: files read once, order status, and accidentals carried as state."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Seconds after which a job, and what is kept for it, is forgotten.
TIME_TO_LIVE = 1800


def pages_once(spark: SparkSession, path: str, delete: bool = True) -> DataFrame:
    """Page files as a stream; the query's checkpoint remembers them, and each is deleted once its batch is done."""
    return spark.readStream.format("binaryFile").option("cleanSource", "delete" if delete else "off").schema("path string, modificationTime timestamp, length long, content binary").load(path)


def once_each(events: DataFrame, id_col: str = "file_id", time_col: str = "ts", within: str = f"{TIME_TO_LIVE} seconds") -> DataFrame:
    """Events of a stream without repetitions of an id that come within the time to live."""
    return events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, within).dropDuplicatesWithinWatermark([id_col])


def counts_by_window(events: DataFrame, time_col: str = "ts", length: str = "5 seconds", late: str = f"{TIME_TO_LIVE} seconds", by=("status",)) -> DataFrame:
    """Events by window of time and status, as a client that polls would see them."""
    rows = events.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return rows.groupBy(F.window(time_col, length), *by).agg(F.count(F.lit(1)).alias("n"))


def sounding_alters(symbols: DataFrame, time_to_live: float = TIME_TO_LIVE, forget: bool = True) -> DataFrame:
    """(staff_id, seq, alter_out) of notes in a stream of symbols, with the state of a measure kept for each staff.

    The rule of `rules.with_sounding_alters`; rows of a staff must arrive in the order of seq from batch to
    batch. symbols: staff_id, seq, kind, fifths, step, octave, alter. State: the key and the alters of a measure; it is forgotten
    when no row of a staff has come for `time_to_live` seconds, so it doesn't grow with the staffs that ever were. A query that forgets looks for such
    staffs until it is stopped; one that is to end by itself (trigger availableNow) needs forget=False: old state is passed over then, not deleted.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = int(1000 * time.time())
        fifths, names, values, last = state.get if state.exists else (0, [], [], now)
        if now - last > 1000 * time_to_live:  # it may end in the batch that brings new rows
            fifths, names, values = 0, [], []
        held = dict(zip(names, values, strict=True))
        out = []
        for row in pd.concat(frames).sort_values("seq").itertuples(index=False):
            if row.kind in ("barline", "clef"):
                held = {}
                if row.kind == "clef":
                    fifths = 0 if pd.isna(row.fifths) else int(row.fifths)
            elif row.kind == "note":
                name = f"{row.step}{row.octave}"
                if not pd.isna(row.alter):
                    held[name] = int(row.alter)
                order = "FCGDAEB"[:fifths] if fifths > 0 else "BEADGCF"[: -fifths]
                by_key = (1 if fifths > 0 else -1) if row.step in order else None
                out.append((key[0], row.seq, held.get(name, by_key)))
        state.update((fifths, list(held), list(held.values()), now))
        if forget:
            state.setTimeoutDuration(max(1, int(1000 * time_to_live)))
        yield pd.DataFrame(out, columns=["staff_id", "seq", "alter_out"]).astype({"alter_out": "Int32"})

    return symbols.groupBy("staff_id").applyInPandasWithState(run, "staff_id long, seq long, alter_out int", "fifths int, names array<string>, alters array<int>, last long", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)
