"""Sampled generation over a decoder's logits, with the retries that the merger of symbols asks for.

Random numbers are functions of (seed, staff, step, attempt, head, token), so a draw is the same on whatever machine and in
whatever order it is made. The token of a head is the one with the largest logit / temperature + Gumbel noise, which
has the probabilities of the softmax and is a plain aggregate. All attempts of all steps are drawn at once; which of them counts depends on what the merger
has taken so far, and as its memory is small (whether it is empty, and its first clef), windows over the steps tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.ranking import top_logits

HEADS = ["rhythm", "pitch", "lift"]
#: Tokens that are no symbols; the first ends a staff.
END, OTHERS = "[EOS]", ["[EOS]", "[BOS]", "[PAD]"]


def uniform(*counters: Column) -> Column:
    """Between 0 and 1, from 52 bits of the hash of the counters."""
    text = F.concat_ws(",", *(c.cast("string") for c in counters))
    bits = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / float(1 << 52)


def draws(logits: DataFrame, temperature: float = 1.0, factor: float = 3.5, attempts: int = 5, threshold: float = 0.7, seed: int = 0, keys=("staff_id",)) -> DataFrame:
    """(keys, step, attempt, rhythm, pitch, lift): a token of each head for each attempt, whose temperature is `factor` times that of the one before.

    logits: keys, step, head (see HEADS), index, token, logit. Of each head the ceil((1 - threshold) n) largest logits take part.
    """
    each = [*keys, "step", "head"]
    rows = top_logits(logits, threshold, each, "logit", "index")
    heat = F.array(*(F.lit(temperature * factor**a) for a in range(attempts)))
    rows = rows.select(*each, "index", "token", "logit", F.posexplode(heat).alias("attempt", "heat"))
    noise = -F.log(-F.log(uniform(F.lit(seed), *map(F.col, keys), F.col("step"), F.col("attempt"), F.col("head"), F.col("index"))))
    rows = rows.withColumn("score", F.col("logit") / F.col("heat") + noise)
    best = lambda head: F.max_by(F.when(F.col("head") == head, F.col("token")), F.when(F.col("head") == head, F.struct("score", -F.col("index")))).alias(head)
    return rows.groupBy(*keys, "step", "attempt").agg(*map(best, HEADS))


def accepted(drawn: DataFrame, most: int = 256, keys=("staff_id",)) -> DataFrame:
    """(keys, step, attempt, rhythm, pitch, lift, merged): what each step gives out, up to the first end token or `most` steps.

    A step takes its first attempt that the merger doesn't refuse, else its last. The merger refuses | while it is empty, and is then
    spoilt: it waits for a chord that never comes, and takes nothing more. It refuses a clef other than its first. merged:
    whether the symbol was taken (see `codec.merge`); tokens that are no symbols are not.
    """
    steps = Window.partitionBy(*keys).orderBy("step")
    order = F.array_sort(F.collect_list(F.struct("attempt", "rhythm", "pitch", "lift"))).alias("tries")
    rows = drawn.filter(F.col("step") < most).groupBy(*keys, "step").agg(order)
    first = F.get("tries", F.lit(0))["rhythm"]
    so_far = steps.rowsBetween(Window.unboundedPreceding, 0)
    # the first attempt of the first step that gives a symbol at all
    opening = F.first(F.when(~first.isin(OTHERS), first), True).over(so_far)
    rows = rows.withColumn("spoilt", F.coalesce(opening == "|", F.lit(False)))
    is_clef = lambda r: r.contains("clef") & ~r.contains("note")
    free = F.filter("tries", lambda t: ~(F.col("spoilt") & (t["rhythm"] == "|")))
    chosen = F.coalesce(F.get(free, F.lit(0)), F.element_at("tries", -1))
    rows = rows.withColumn("_clef", F.when(is_clef(chosen["rhythm"]), chosen["rhythm"])).withColumn("clef", F.first("_clef", True).over(steps.rowsBetween(Window.unboundedPreceding, -1)))
    refused = lambda t: (F.col("spoilt") & (t["rhythm"] == "|")) | (is_clef(t["rhythm"]) & F.coalesce(t["rhythm"] != F.col("clef"), F.lit(False)))
    fine = F.filter("tries", lambda t: ~refused(t))
    rows = rows.select(*keys, "step", "spoilt", (F.size(fine) > 0).alias("_fine"), F.coalesce(F.get(fine, F.lit(0)), F.element_at("tries", -1)).alias("t"))
    rows = rows.select(*keys, "step", "t.*", (F.col("_fine") & ~F.col("spoilt") & ~F.col("t.rhythm").isin(OTHERS)).alias("merged"))
    ended = F.max((F.col("rhythm") == END).cast("int")).over(so_far)
    return rows.withColumn("_ended", ended).filter("_ended = 0").drop("_ended")
