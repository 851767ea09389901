"""Conversation prefix trie by smallest-member ownership.

A node is a prefix that conversations share; it is owned by the smallest of them. Whoever owns a node owns all that
follow on its path, so each conversation owns a suffix of its path, and a node is named by its owner and its depth.

The prefixes are 128-bit hashes: the xor, running along the path, of hashes of depth and turn. The smallest member of each is a
minimum by prefix. With it the rows of a conversation tell where its own suffix begins, how many words stand before that,
who owns the node above, and whether the path ends in a leaf. One group-by of all occurrences by node then
gives everything: in a subtree, the words of all occurrences less those of owned nodes are what its members have between
the node and their own suffixes; each child and each leaf counts once, where it is owned.

No task holds a whole conversation or all members of a node. Turns are put in order by a range exchange, running sums are
windows within its partitions, to which the sums of earlier partitions are added; joins send the entries of hot keys to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_entries, materialize

#: Conversations with ids of one such span are listed in one row.
SPAN = 4096


def _xor(column: str) -> Column:
    return F.bit_xor(column)


def _carried(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running aggregates along each conversation, up to the row before; sums: name to the aggregate, 0 at the start.

    rows: conv_id and part, which rises along a conversation. Windows run inside (conv_id, part); a conversation's parts are few.
    """
    inside = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").agg(*(c.alias(f"_{k}") for k, c in sums.items()))
    whole = {k: (F.bit_xor if k.startswith("k") else F.sum)(f"_{k}").over(before) for k in sums}
    parts = parts.select("conv_id", "part", *(F.coalesce(c, F.lit(0)).alias(f"_{k}") for k, c in whole.items()))
    out = rows.withColumns({k: F.coalesce(c.over(inside), F.lit(0)) for k, c in sums.items()}).join(parts, ["conv_id", "part"])
    for k in sums:
        out = out.withColumn(k, F.col(k).bitwiseXOR(F.col(f"_{k}")) if k.startswith("k") else F.col(k) + F.col(f"_{k}")).drop(f"_{k}")
    return out


def turns_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, part, place (from 0), t1 and t2 (hashes of role and text) and words of each turn, on shared files."""
    role, text = (F.coalesce(df[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    slim = df.select(df[conv_col].cast("long").alias("conv_id"), df[turn_col].cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), role, F.lit(2), text).alias("t2"), words.alias("words")).filter("conv_id is not null")
    order = [F.asc_nulls_first("turn"), "t1", "t2"]
    slim = materialize(slim.repartitionByRange("conv_id", *order, F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "turns")
    return _carried(slim, order, {"place": F.count(F.lit(1))})


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, depth, size, t1, t2, words of the turns of all rebuilt conversations; conv_id and size of these, turnless ones too)."""
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4))
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = turns.filter("place < 3").select(F.col("conv_id").alias("base"), "place", "t1", "t2", "words")
    base = F.col("conv_id") - F.col("conv_id") % 20
    convs = counts.select("conv_id", "n", heads.alias("h"), base.alias("base"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "n", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")), "trie-conversations")
    taken = first.join(convs.select("conv_id", "base", "h", "size"), "base").filter("place < h").select("conv_id", F.lit(-1).alias("part"), (F.col("place") + 1).alias("depth"), "size", "t1", "t2", "words")
    own = join_entries(turns, convs.select("conv_id", "n", "h", "taken", "size"), ["conv_id"], "n", turns.count()).filter("place >= h")
    own = own.select("conv_id", "part", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "size", "t1", "t2", "words")
    return taken.unionByName(own), convs.select("conv_id", "size")


def _occurrences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, size, depth, k1, k2 (the prefix), before and through (words above the node, and with it) of each conversation's nodes, the root too."""
    salted = turns.withColumns({"x1": F.xxhash64("depth", "t1", "t2"), "x2": F.xxhash64("t2", "depth", "t1")})
    run = _carried(salted, [F.col("depth")], {"k1": _xor("x1"), "k2": _xor("x2"), "before": F.sum("words")})
    nodes = run.select("conv_id", "size", "depth", F.col("k1").bitwiseXOR(F.col("x1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("k2"), "before", (F.col("before") + F.col("words")).alias("through"))
    zero = F.lit(0).cast("long")
    return nodes.unionByName(convs.select("conv_id", "size", *(zero.alias(c) for c in ("depth", "k1", "k2", "before", "through"))))


def _digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of the nodes at which conversations end; ends: conv_id, depth, member.

    Ids are listed by spans of SPAN, so a row is bounded. A node of one span is hashed at once; the spans of
    another are fed to one hash in order, a stream of bounded memory, as that hash is defined over the whole list.
    """
    lists = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / SPAN).alias("span")).agg(F.array_sort(F.collect_list("member")).alias("ids"))
    lists = lists.select("conv_id", "depth", "span", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("listed"))
    lists = materialize(lists, "trie-ends")
    spans = lists.groupBy("conv_id", "depth").agg(F.count(F.lit(1)).alias("spans"), F.max("listed").alias("listed"))
    single = spans.filter("spans = 1").select("conv_id", "depth", F.sha2(F.col("listed").cast("binary"), 256).alias("ends_sha256"))
    several = lists.join(spans.filter("spans > 1").select("conv_id", "depth"), ["conv_id", "depth"])
    streamed = several.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "span")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for conv, depth, listed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (conv, depth) != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (conv, depth), hashlib.sha256(listed.encode())
                else:
                    digest.update(b"," + listed.encode())
            yield _rows(done)
        if node:
            yield _rows([(*node, digest.hexdigest())])

    return single.unionByName(streamed.select("conv_id", "depth", "listed").mapInArrow(run, "conv_id long, depth long, ends_sha256 string"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; those with the same turn by a hash of role and text, so repeated rows stand together, and
    each counts as a turn. Null roles and texts count as empty, texts of any length are compared and counted as a whole.
    Rows without a conversation's id are left out. The first h turns of a conversation, h from the crc32 of its id, are replaced by
    those of the one whose id is the multiple of 20 before it (towards zero); without turns there it only loses its own. An empty table
    has no node. Other columns are not looked at.
    """
    turns = materialize(turns_of(df, conv_col, turn_col, role_col, text_col), "trie-turns")
    paths, convs = rebuilt(turns)
    rows = materialize(_occurrences(materialize(paths, "trie-paths"), convs), "trie-occurrences")
    n_rows = rows.count()
    node = ["depth", "k1", "k2"]
    is_end = F.col("depth") == F.col("size")
    owners = rows.groupBy(*node).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("members"), F.count_if(is_end).alias("ends"))
    owned = materialize(join_entries(rows, materialize(owners, "trie-owners"), node, "members", n_rows), "trie-owned")
    mine = F.col("owner") == F.col("conv_id")
    leaf = mine & is_end & (F.col("members") == F.col("ends"))
    # of each path: the first node that it owns (behind the last, if none), the words above it and its parent's owner
    suffixes = owned.groupBy("conv_id").agg(
        F.coalesce(F.min(F.when(mine, F.col("depth"))), F.max("depth") + 1).alias("start"),
        F.coalesce(F.min(F.when(mine, F.col("before"))), F.max("through")).alias("above"),
        F.max(F.when(~mine, F.col("owner"))).alias("parent"),
        F.max(leaf.cast("long")).alias("leaf"),
        F.count(F.lit(1)).alias("n"),
    )
    marked = join_entries(owned, materialize(suffixes, "trie-suffixes"), ["conv_id"], "n", n_rows)
    nodes = marked.groupBy(F.col("owner").alias("node_owner"), "depth").agg(
        F.max(F.when(mine & (F.col("depth") > 0), F.when(F.col("depth") > F.col("start"), F.col("conv_id")).otherwise(F.col("parent")))).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if((F.col("size") > F.col("depth")) & (F.col("start") <= F.col("depth") + 1)).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("above") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    digests = _digests(owned.filter(is_end).select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    named = nodes.withColumnRenamed("node_owner", "conv_id").join(digests, ["conv_id", "depth"], "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return named.select(*columns, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
