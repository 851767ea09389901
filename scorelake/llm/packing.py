"""Packing into optimal length buckets.

The histogram of exact lengths over all documents goes to the driver; dynamic programming chooses the
bucket boundaries with the least padding in total. Inside a bucket every document is padded to the
boundary, and batches are filled to a budget of tokens.

Documents of n tokens in all have fewer than 1 + sqrt(2 n) distinct lengths, so the histogram has so many
rows at most, 16 bytes each; the programming takes linear time for each bucket.
"""

from __future__ import annotations

from array import array
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bits_for, free_names, materialize, prefix, ranked, text_or_empty

#: The columns that packing adds.
ADDED = ["n_tokens", "bucket_length", "batch", "batch_slot"]


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The rising bucket boundaries, at most `buckets`, with the least sum of count * boundary. histogram: (length, count), whole numbers.

    With one bucket more, the lengths up to the e-th cost min over s < e of best[s] + length[e] * (total[e] - total[s]):
    for each s a straight line in length[e]. Slopes fall and lengths rise, so one walk along the lower hull of
    the lines finds all minima.
    """
    tops, counts = zip(*sorted(histogram), strict=True) if histogram else ((), ())
    total, n = [0, *accumulate(counts)], len(tops)
    best = [0, *(t * c for t, c in zip(tops, total[1:], strict=True))]  # one bucket over the first e lengths
    choices = []
    for _ in range(1, min(buckets, n)):
        again, choice = best[:], array("q", bytes(8 * (n + 1)))
        hull: list[int] = []
        at = 0
        for e in range(1, n + 1):
            s = e - 1  # its line joins; those that it leaves above the hull go
            while len(hull) > 1:
                a, b = hull[-2], hull[-1]
                if (best[s] - best[a]) * (total[b] - total[a]) <= (best[b] - best[a]) * (total[s] - total[a]):
                    hull.pop()
                else:
                    break
            hull.append(s)
            at = min(at, len(hull) - 1)
            x = tops[e - 1]
            while at + 1 < len(hull) and best[hull[at + 1]] - total[hull[at + 1]] * x <= best[hull[at]] - total[hull[at]] * x:
                at += 1
            s = hull[at]
            again[e], choice[e] = best[s] + x * (total[e] - total[s]), s
        choices.append(choice)
        best = again
    found, e = [], n
    for choice in reversed(choices):
        if e:
            found.append(int(tops[e - 1]))
            e = choice[e]
    if e:
        found.append(int(tops[e - 1]))
    return found[::-1]


def words_of(text: Column) -> Column:
    """The number of words in a text: runs of other than white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def arrival(df: DataFrame) -> list[Column] | None:
    """The order of rows in the files that df was read from, if it was."""
    try:
        order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
        df.select(*order)
        return order
    except AnalysisException:
        return None


def packed(df: DataFrame, budget: int = 32_768, buckets: int = 16, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, keep: list[str] | None = None, rows_per_task: int = 20_000, by_arrival: bool = False) -> DataFrame:
    """One row for each document: the columns keep (default: the id), n_tokens, bucket_length, batch, batch_slot.

    length: tokens of a row (default: words of the text; null texts are empty). bucket_length: what it is
    padded to, 1 at least. A batch, numbered from 0 inside its bucket, holds floor(budget /
    bucket_length) documents, or one that is longer than the budget. Batches take documents in the order of the
    hashes of their ids or, with by_arrival, in that of the files which df was read from, so that a mix of sources
    written before is kept. All rows are packed, repeated ones too. A column of keep that is named like one of the
    four added ones gets "_" appended.
    """
    names = keep or [id_col]
    order = arrival(df) if by_arrival else None
    size = length if length is not None else words_of(text_or_empty(df, text_col))
    own = df.select(F.struct(*(df[c] for c in names)).alias("row"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64(df[id_col]).alias("h"), *((order[0].alias("file"), order[1].alias("line")) if order else (F.lit("").alias("file"), F.lit(0).cast("long").alias("line"))))
    # written once, else the words are counted anew for each boundary that a length is compared with
    own = materialize(own, "pack-keys")
    lengths = own.groupBy(F.greatest("n_tokens", F.lit(1)).alias("n")).count().toArrow()
    histogram = list(zip(lengths.column(0).to_pylist(), lengths.column(1).to_pylist(), strict=True))
    edges = boundaries(histogram, buckets)
    bits = bits_for(sum(n for _, n in histogram), rows_per_task)
    table = F.lit(edges) if edges else F.array().cast("array<long>")
    bucket = F.array_min(F.filter(table.cast("array<long>"), lambda e: e >= F.col("n_tokens")))
    # rows come in the order of files and of stretches of lines in them
    part = F.concat_ws(":", "file", F.lpad(F.floor(F.col("line") / rows_per_task).cast("string"), 12, "0")) if order else F.lpad(prefix(F.col("h"), bits).cast("string"), 13, "0")
    own = own.withColumns({"bucket_length": bucket, "part": part})
    own = ranked(own, ["bucket_length"], "part", ["line", "h", "n_tokens"], "place")
    fit = F.greatest(F.floor(F.lit(budget) / F.col("bucket_length")), F.lit(1)).cast("long")
    kept = [F.col("row").getField(c).alias(new) for c, new in zip(names, free_names(names, ADDED), strict=True)]
    return own.select(*kept, "n_tokens", "bucket_length", F.floor(F.col("place") / fit).cast("long").alias("batch"), (F.col("place") % fit).cast("long").alias("batch_slot"))
