"""Tables in the folder that driver and executors share, and joins of tables with hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session without that setting gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='scorelake-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths of tables that are deleted at the end of the scopes around them.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialize` writes inside are deleted at the end; what is computed from them must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """df with the hint that joins with it are merge joins.

    Spark takes an exploded table for as small as the one it was made of, and a table of few different values for as small as its files, and would
    collect either on the driver to broadcast it.
    """
    return df.hint("merge")


def dealt(df: DataFrame, key: str, each: int | Column, most: int = 1_000_000) -> DataFrame:
    """df dealt by key to so many tasks that each makes about `most` rows if every row becomes `each`. A small file is one task otherwise, however much is made of it."""
    made = df.agg(F.sum(each)).first()[0] if isinstance(each, Column) else df.count() * each
    return df.repartition(max(1, -(-(made or 0) // most)), key)


def in_groups(df: DataFrame, keys: list[str], order: list[str], rule: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that rule gives for each group of df: keys, all longs, and then the rule's. A rule gets the group's other columns, in order.

    Groups go through a task one after the other. Unlike applyInPandas, that makes no frame for each of many small groups; a task holds the group at hand.
    """
    at = len(keys)
    columns = [*keys, *(c for c in df.columns if c not in keys)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for own, group in groupby(rows(batches), lambda r: r[:at]):
            out += [own + row for row in rule(r[at:] for r in group)]
            if len(out) >= 20_000:
                yield _batch(out, types)
                out = []
        if out:
            yield _batch(out, types)

    types = to_arrow_schema(T._parse_datatype_string(schema))
    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def join_entries(rows: DataFrame, entries: DataFrame, keys: list[str], size: str, n_rows: int, share: int = 1000) -> DataFrame:
    """Inner join of rows with entries, which have one row for each key and the number of rows with it in `size`.

    Keys of more than n_rows / share rows are fewer than share; their entries are broadcast, so a hot
    key's rows stay where they are. The others are joined by key. Keys must not be null.
    """
    least = max(2, n_rows // share + 1)
    hot = F.broadcast(entries.filter(F.col(size) >= least).withColumn("_hot", F.lit(True)))
    seen = rows.join(hot, keys, "left")
    columns = [*rows.columns, *(c for c in entries.columns if c not in keys)]
    rest = seen.filter("_hot is null").select(rows.columns).join(entries.filter(F.col(size) < least), keys)
    return seen.filter("_hot").select(columns).unionByName(rest.select(columns))
