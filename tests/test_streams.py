"""Streams: repetitions and counts within the time to live, and state that ends."""

import time
from datetime import datetime, timedelta

import pytest

from scorelake.streaming import streams

START = datetime(2024, 1, 1, 12)
SYMBOLS = "staff_id long, seq long, kind string, fifths int, step string, octave int, alter int"


def appended(spark, tmp_path, name, rows, schema, make, mode="append"):
    """Rows of a memory table to which each list of rows is streamed as a file of its own."""
    for k, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01 * k)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = make(source).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    if mode == "complete":
        assert out.format("memory").queryName(name).start().awaitTermination(150)
        return spark.table(name).collect()
    assert out.format("parquet").start(str(tmp_path / "out")).awaitTermination(150)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_once_each(spark, tmp_path):
    """A repeated id goes while it is remembered."""
    at = lambda s: START + timedelta(seconds=s)
    rows = [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(60)), ("c", at(61))]]
    out = appended(spark, tmp_path, "once", rows, "file_id string, ts timestamp", streams.once_each)
    assert sorted(r.file_id for r in out) == ["a", "b", "c"]


def test_counts_by_window(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [[("finished", at(0)), ("finished", at(4)), ("failed", at(4)), ("finished", at(5))], [("finished", at(3))]]
    out = appended(spark, tmp_path, "counts", rows, "status string, ts timestamp", streams.counts_by_window, "complete")
    assert {(r.window.start.second, r.status): r.n for r in out} == {(0, "finished"): 3, (0, "failed"): 1, (5, "finished"): 1}


@pytest.mark.parametrize("pause, live, want", [(0, 1800, 1), (3, 1, None)])
def test_state_is_forgotten(spark, tmp_path, pause, live, want):
    """A sharp holds for the rest of the measure, in the next run too, unless the staff was silent for longer than the time to live."""
    first = [(7, 1, "note", None, "C", 4, 1), (7, 2, "note", None, "C", 4, None)]
    name = f"alters{live}"
    out = appended(spark, tmp_path, name, [first], SYMBOLS, lambda s: streams.sounding_alters(s, live, forget=False))
    assert {r.seq: r.alter_out for r in out} == {1: 1, 2: 1}
    time.sleep(pause)
    out = appended(spark, tmp_path, f"{name}again", [[(7, 3, "note", None, "C", 4, None), (8, 1, "note", None, "C", 4, None)]], SYMBOLS, lambda s: streams.sounding_alters(s, live, forget=False))
    assert {(r.staff_id, r.seq): r.alter_out for r in out} == {(7, 1): 1, (7, 2): 1, (7, 3): want, (8, 1): None}


def test_a_query_that_forgets_goes_on(spark, tmp_path):
    """State that timed out is deleted while the query runs."""
    spark.createDataFrame([(7, 1, "note", None, "C", 4, 1)], SYMBOLS).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SYMBOLS).parquet(str(tmp_path / "in"))
    query = streams.sounding_alters(source, 1).writeStream.format("memory").queryName("forgets").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        deadline, left = time.time() + 60, None
        while time.time() < deadline and left != 0:
            progress = query.lastProgress
            left = progress and progress["stateOperators"][0]["numRowsTotal"] if spark.table("forgets").count() else None
            time.sleep(0.3)
        assert left == 0 and [r.alter_out for r in spark.table("forgets").collect()] == [1]
    finally:
        query.stop()
