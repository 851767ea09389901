"""Queries over the driver's tables, one or more for each family of operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.functions import geometry, music, tokens
from scorelake.operators import codec, document, grouping, ranking, raster, rules, spatial, staffs
from scorelake.plans.derived import BOXES_SQL, SYMBOLS_SQL, boxes, symbols, table
from scorelake.sources import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


KEY_SQL = "CASE WHEN strpos(CASE WHEN {k} > 0 THEN substr('FCGDAEB', 1, {k}) WHEN {k} < 0 THEN substr('BEADGCF', 1, -{k}) ELSE '' END, {s}) > 0 THEN CASE WHEN {k} < 0 THEN -1 ELSE 1 END END"
SYM = f"WITH {SYMBOLS_SQL}"
BOX = f"WITH {BOXES_SQL}"

# ---- rules


@query(
    f"""{SYM}, carried AS (SELECT *, last_value(alter_in IGNORE NULLS) OVER (PARTITION BY staff_id, measure_no, clef_no, step, octave ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c,
        coalesce(max(fifths) OVER (PARTITION BY staff_id, clef_no), 0) AS k FROM seg)
    SELECT staff_id, seq, step, octave, CAST(coalesce(c, {KEY_SQL.format(k="k", s="step")}) AS int) AS alter_out FROM carried WHERE kind = 'note'"""
)
def carry_accidentals(spark, sf_dir):
    return rules.with_sounding_alters(symbols(spark, sf_dir)).filter("kind = 'note'").select("staff_id", "seq", "step", "octave", "alter_out")


@query(
    f"""{SYM}, c AS (SELECT *, lag(sign) OVER w AS s, lag(fifths) OVER w AS f, row_number() OVER w AS n FROM sym WHERE kind = 'clef' WINDOW w AS (PARTITION BY staff_id ORDER BY seq))
    SELECT staff_id, seq, sign, fifths FROM c WHERE n = 1 OR s <> sign OR f <> fifths"""
)
def redundant_clefs(spark, sf_dir):
    return rules.without_redundant_clefs(symbols(spark, sf_dir)).filter("kind = 'clef'").select("staff_id", "seq", "sign", "fifths")


@query(
    f"""{SYM}, n AS (SELECT staff_id, fifths, count(*) AS n, min(seq) AS f FROM sym WHERE kind = 'clef' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY staff_id ORDER BY n DESC, f) AS r FROM n) SELECT staff_id, fifths, n FROM r WHERE r = 1 AND n >= 2"""
)
def dominant_key(spark, sf_dir):
    return rules.dominant(symbols(spark, sf_dir), "fifths")


DOMINANT_CLEF = """
best AS (SELECT staff_id, sign AS best FROM (SELECT staff_id, sign, count(*) AS n, row_number() OVER (PARTITION BY staff_id ORDER BY count(*) DESC, min(seq)) AS r
         FROM sym WHERE kind = 'clef' GROUP BY 1, 2) WHERE r = 1 AND n >= 2),
own AS (SELECT sym.*, last_value(sign IGNORE NULLS) OVER (PARTITION BY staff_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS own FROM sym),
refs AS (SELECT * FROM (VALUES ('G', 0, 4), ('F', 2, 2), ('C', 0, 3)) t(s, i, o)),
rel AS (SELECT own.*, best, (octave - r.o) * 7 + strpos('CDEFGAB', step) - 1 - r.i AS rel, b.i AS bi, b.o AS bo
        FROM own LEFT JOIN best USING (staff_id) LEFT JOIN refs r ON r.s = own LEFT JOIN refs b ON b.s = best WHERE kind = 'note')"""


@query(
    f"""{SYM}, {DOMINANT_CLEF} SELECT staff_id, seq,
      CASE WHEN own IS NULL OR best IS NULL OR own = best THEN step ELSE substr('CDEFGAB', ((bi + rel) % 7 + 7) % 7 + 1, 1) END AS step,
      CAST(CASE WHEN own IS NULL OR best IS NULL OR own = best THEN octave ELSE bo + floor(abs(rel - ((bi + rel) % 7 + 7) % 7) / 6) * sign(rel) END AS int) AS octave FROM rel"""
)
def dominant_clef_transpose(spark, sf_dir):
    return rules.with_dominant_clef(symbols(spark, sf_dir)).filter("kind = 'note'").select("staff_id", "seq", "step", "octave")


LENGTHS = "len AS (SELECT staff_id, measure_no, CAST(coalesce(sum(ticks), 0) AS int) AS length FROM seg WHERE kind <> 'barline' GROUP BY 1, 2)"


@query(f"{SYM}, {LENGTHS} SELECT staff_id, count(*) AS n_measures, round(stddev_pop(length), 6) AS length_std, median(length) AS length_median FROM len GROUP BY 1")
def measure_stats(spark, sf_dir):
    return rules.measure_statistics(symbols(spark, sf_dir)).withColumn("length_std", F.round("length_std", 6))


@query(
    f"""{SYM}, {LENGTHS}, med AS (SELECT staff_id, median(length) AS m FROM len GROUP BY 1)
    SELECT staff_id, seq, CAST(round_even(m / (4.0 / den * 16), 0) AS int) AS num, den FROM sym JOIN med USING (staff_id) WHERE kind = 'time'"""
)
def filled_time_signatures(spark, sf_dir):
    return rules.with_filled_time_signatures(symbols(spark, sf_dir)).filter("kind = 'time'").select("staff_id", "seq", "num", "den")


@query(f"{SYM} SELECT staff_id, min(seq) AS seq, arg_min(den, seq) AS den FROM sym WHERE kind = 'time' GROUP BY 1")
def first_time_signature(spark, sf_dir):
    return rules.first_time_signature_only(symbols(spark, sf_dir)).filter("kind = 'time'").select("staff_id", "seq", "den")


@query(
    f"""{SYM}, c AS (SELECT *, lag(sign) OVER w AS s, lag(fifths) OVER w AS f, row_number() OVER w AS n FROM seg WHERE kind = 'clef' WINDOW w AS (PARTITION BY staff_id ORDER BY seq))
    SELECT staff_id, seq, sign, (n = 1 OR measure_no % 8 = 0 OR s <> sign OR f <> fifths) AS emit FROM c"""
)
def emit_attributes(spark, sf_dir):
    clefs = rules.segmented(symbols(spark, sf_dir)).filter("kind = 'clef'").withColumn("new_line", F.col("measure_no") % 8 == 0)
    return rules.with_emitted_attributes(clefs).select("staff_id", "seq", "sign", "emit")


@query(f"{SYM}, n AS (SELECT *, sum(CAST(kind <> 'barline' AS int)) OVER (PARTITION BY staff_id, measure_no) AS n FROM seg) SELECT staff_id, count(*) AS n_rows FROM n WHERE n > 0 GROUP BY 1")
def nonempty_measures(spark, sf_dir):
    kept = rules.without_empty_measures(rules.segmented(symbols(spark, sf_dir)))
    return kept.groupBy("staff_id").agg(F.count(F.lit(1)).alias("n_rows"))


def _measures(spark, sf_dir):
    seg = rules.segmented(symbols(spark, sf_dir)).select(F.col("staff_id").alias("doc"), "measure_no").distinct()
    return seg.select(F.floor(F.col("doc") / 10).alias("doc_id"), (F.col("doc") % 10).cast("int").alias("voice"), F.floor(F.col("measure_no") / 8).alias("page_no"), (F.floor(F.col("measure_no") / 4) % 2).alias("system_no"), "measure_no")


MEASURES = f"""{SYM}, m AS (SELECT DISTINCT staff_id // 10 AS doc_id, CAST(staff_id % 10 AS int) AS voice, CAST(floor(measure_no / 8) AS bigint) AS page_no,
       CAST(floor(measure_no / 4) AS bigint) % 2 AS system_no, measure_no FROM seg)"""


@query(
    f"""{MEASURES} SELECT doc_id, voice, page_no, system_no, measure_no,
      row_number() OVER (PARTITION BY doc_id, voice, page_no, system_no ORDER BY measure_no) = 1 AS new_line,
      (row_number() OVER (PARTITION BY doc_id, voice, page_no ORDER BY system_no, measure_no) = 1 AND page_no > 0 AND voice = 0) AS new_page,
      row_number() OVER (PARTITION BY doc_id, voice ORDER BY page_no, system_no, measure_no) AS number FROM m"""
)
def measure_breaks(spark, sf_dir):
    flagged = rules.with_break_flags(_measures(spark, sf_dir), voice=("voice", "doc_id"))
    return rules.numbered_measures(flagged, ("doc_id", "voice"))


# ---- tokens


def note_tokens(spark, sf_dir):
    mark = F.when(F.col("alter") == 1, "#").when(F.col("alter") == -1, "b").when(F.col("alter") == 0, "N").otherwise("")
    dot = F.when(F.col("modifier") == "dot", ".").when(F.col("modifier") == "triplet", "³").otherwise("")
    name = F.element_at(F.array(*map(F.lit, ["whole", "half", "quarter", "eighth", "sixteenth", "thirty_second", "breve"])), (F.col("cents") % 7 + 1).cast("int"))
    keys = F.element_at(F.array(*map(F.lit, [music.KEY_NAMES[k] for k in range(-7, 8)])), F.col("fifths") + 8)
    token = (
        F.when(F.col("kind") == "note", F.concat(F.lit("note-"), "step", F.col("octave").cast("string"), mark, F.lit("_"), name, dot))
        .when(F.col("kind") == "rest", F.concat(F.lit("rest-"), name, dot))
        .when(F.col("kind") == "clef", F.concat(F.lit("clef-"), "sign", F.lit("2+keySignature-"), keys))
        .when(F.col("kind") == "time", F.concat(F.lit("timeSignature-/"), F.col("den").cast("string")))
        .otherwise("barline")
    )
    return symbols(spark, sf_dir).withColumn("token", token)


def token_strings(spark, sf_dir):
    """(staff_id, tokens): the derived stream as a token string; a note whose cents end in 0 to 2 stacks on the note before it."""
    rows = note_tokens(spark, sf_dir)
    w = Window.partitionBy("staff_id").orderBy("seq")
    stack = (F.col("kind") == "note") & (F.lag("kind").over(w) == "note") & (F.col("cents") % 10 < 3)
    joint = F.when(F.row_number().over(w) == 1, "").when(stack, "|").otherwise("+")
    rows = rows.withColumn("t", F.concat(joint, "token"))
    return rows.groupBy("staff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), "").alias("tokens"))


TOKENS = f"""{SYM}, tok AS (SELECT *, CASE kind WHEN 'note' THEN 'note-' || step || octave || CASE alter_in WHEN 1 THEN '#' WHEN -1 THEN 'b' WHEN 0 THEN 'N' ELSE '' END || '_' || nm || md
     WHEN 'rest' THEN 'rest-' || nm || md WHEN 'clef' THEN 'clef-' || sign || '2+keySignature-' || ['CbM','GbM','DbM','AbM','EbM','BbM','FM','CM','GM','DM','AM','EM','BM','F#M','C#M'][fifths + 8]
     WHEN 'time' THEN 'timeSignature-/' || den ELSE 'barline' END AS token
   FROM (SELECT *, ['whole','half','quarter','eighth','sixteenth','thirty_second','breve'][CAST(cents % 7 + 1 AS int)] AS nm,
         CASE modifier WHEN 'dot' THEN '.' WHEN 'triplet' THEN '³' ELSE '' END AS md FROM seg)),
 joint AS (SELECT *, CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN kind = 'note' AND lag(kind) OVER w = 'note' AND cents % 10 < 3 THEN '|' ELSE '+' END AS j
           FROM tok WINDOW w AS (PARTITION BY staff_id ORDER BY seq))"""


@query(f"{TOKENS} SELECT staff_id, string_agg(j || token, '' ORDER BY seq) AS tokens FROM joint GROUP BY 1")
def token_text(spark, sf_dir):
    return token_strings(spark, sf_dir)


@query(
    f"""{TOKENS}, steps AS (SELECT *, sum(CAST(j <> '|' AS int)) OVER (PARTITION BY staff_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS step_no FROM joint),
    places AS (SELECT *, row_number() OVER (PARTITION BY staff_id, step_no ORDER BY seq) - 1 AS place FROM steps)
    SELECT staff_id, step_no, place AS chord_pos, step, octave, alter_in AS alter,
      CAST(CASE cents % 7 WHEN 0 THEN 64 WHEN 1 THEN 32 WHEN 2 THEN 16 WHEN 3 THEN 8 WHEN 4 THEN 4 WHEN 5 THEN 2 ELSE 1 END AS int) AS base, modifier
    FROM places WHERE kind = 'note'"""
)
def token_parse(spark, sf_dir):
    parsed = codec.parse(token_strings(spark, sf_dir))
    # the number of the time step; keys have no row of their own
    step = F.dense_rank().over(Window.partitionBy("staff_id").orderBy("seq"))
    return parsed.withColumn("step_no", step).filter("kind = 'note'").select("staff_id", "step_no", "chord_pos", "step", "octave", "alter", F.col("note_base").alias("base"), F.col("note_modifier").alias("modifier"))


@query(
    f"""{TOKENS}, steps AS (SELECT *, sum(CAST(j <> '|' AS int)) OVER (PARTITION BY staff_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS step_no FROM joint),
    t AS (SELECT *, CAST(CASE modifier WHEN 'dot' THEN b * 3 // 2 WHEN 'triplet' THEN b * 2 // 3 ELSE b END AS int) AS own
          FROM (SELECT *, CAST(CASE cents % 7 WHEN 0 THEN 64 WHEN 1 THEN 32 WHEN 2 THEN 16 WHEN 3 THEN 8 WHEN 4 THEN 4 WHEN 5 THEN 2 ELSE 1 END AS int) AS b FROM steps WHERE kind = 'note'))
    SELECT staff_id, step_no, count(*) AS n_notes, min(own) AS ticks FROM t GROUP BY 1, 2"""
)
def chord_min_duration(spark, sf_dir):
    parsed = codec.parse(token_strings(spark, sf_dir))
    steps = parsed.groupBy("staff_id", "seq").agg(F.count(F.lit(1)).alias("n_notes"), F.first("kind").alias("kind"), F.first("ticks").alias("ticks"))
    steps = steps.withColumn("step_no", F.row_number().over(Window.partitionBy("staff_id").orderBy("seq")))
    return steps.filter("kind = 'note'").select("staff_id", "step_no", "n_notes", "ticks")


@query(
    f"""{SYM}, clean AS (SELECT *, lag(kind) OVER (PARTITION BY staff_id ORDER BY seq) AS before FROM seg),
    n AS (SELECT *, strpos('CDEFGAB', step) - 1 + octave * 7 AS h FROM clean WHERE kind = 'note'),
    g AS (SELECT *, sum(CASE WHEN before = 'note' AND cents % 10 < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY staff_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c FROM n)
    SELECT staff_id, string_agg(x, '+' ORDER BY c) AS tokens FROM (SELECT staff_id, c,
      string_agg('note-' || step || octave || CASE alter_in WHEN 1 THEN '#' WHEN -1 THEN 'b' WHEN 0 THEN 'N' ELSE '' END || '_quarter', '|' ORDER BY h DESC, seq) AS x FROM g GROUP BY 1, 2) GROUP BY 1"""
)
def token_merge(spark, sf_dir):
    w = Window.partitionBy("staff_id").orderBy("seq")
    rows = symbols(spark, sf_dir).withColumn("stack", (F.lag("kind").over(w) == "note") & (F.col("cents") % 10 < 3)).filter("kind = 'note'")
    lift = F.when(F.col("alter") == 1, "lift_#").when(F.col("alter") == -1, "lift_b").when(F.col("alter") == 0, "lift_N").otherwise("lift_null")
    own = F.struct(F.lit(1).alias("half"), F.lit("note-quarter").alias("rhythm"), F.concat(F.lit("note-"), "step", F.col("octave").cast("string")).alias("pitch"), lift.alias("lift"))
    bar = F.struct(F.lit(0).alias("half"), F.lit("|").alias("rhythm"), F.lit("nonote").alias("pitch"), F.lit("nonote").alias("lift"))
    triples = rows.select("staff_id", "seq", F.explode(F.when(F.coalesce("stack", F.lit(False)), F.array(bar, own)).otherwise(F.array(own))).alias("x"))
    return codec.merge(triples.select("staff_id", (F.col("seq") * 2 + F.col("x.half")).alias("pos"), "x.rhythm", "x.pitch", "x.lift"))


SOUNDING = """n AS (SELECT *, CASE alter_in WHEN 1 THEN '#' WHEN -1 THEN 'b' ELSE 'N' END AS snd,
   sum(CAST(kind IN ('barline', 'clef') AS int)) OVER (PARTITION BY staff_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part,
   coalesce(last_value(fifths IGNORE NULLS) OVER (PARTITION BY staff_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS k FROM seg)"""


@query(
    f"""{SYM}, {SOUNDING}, p AS (SELECT *, lag(snd) OVER (PARTITION BY staff_id, part, step, octave ORDER BY seq) AS before,
      CASE {KEY_SQL.format(k="k", s="step")} WHEN 1 THEN '#' WHEN -1 THEN 'b' ELSE 'N' END AS bykey FROM n WHERE kind = 'note')
    SELECT staff_id, row_number() OVER (PARTITION BY staff_id ORDER BY seq) AS n, step, octave, CASE WHEN snd <> coalesce(before, bykey) THEN snd ELSE '' END AS printed FROM p"""
)
def key_codec(spark, sf_dir):
    rows = note_tokens(spark, sf_dir).groupBy("staff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "token"))), lambda x: x["token"]), "+").alias("tokens"))
    printed = codec.with_printed_accidentals(rows).filter("printed is not null")
    n = F.row_number().over(Window.partitionBy("staff_id").orderBy("step_no", "place"))
    return printed.select("staff_id", n.alias("n"), F.substring(tokens.note_pitch_name(F.col("symbol")), 6, 1).alias("step"), F.substring(tokens.note_pitch_name(F.col("symbol")), 7, 1).cast("int").alias("octave"), "printed")


@query(
    f"""{TOKENS} SELECT staff_id, sum(CAST(kind = 'clef' AS int)) AS n_clefs, sum(CAST(kind = 'clef' AND fifths <> 0 AS int)) AS n_keys, sum(CAST(kind = 'time' AS int)) AS n_times,
      sum(CASE WHEN kind = 'note' AND alter_in IS NOT NULL THEN 1 WHEN kind = 'clef' THEN abs(fifths) ELSE 0 END) AS n_accidentals FROM tok GROUP BY 1"""
)
def token_counts(spark, sf_dir):
    return codec.counted(token_strings(spark, sf_dir))


@query(
    f"""{SYM}, v AS (SELECT 'note-' || substr('CDEFGAB', CAST(i % 7 AS int) + 1, 1) || i // 7 AS token, i + 1 AS id FROM range(70) t(i))
    SELECT staff_id, seq, coalesce(id, 0) AS token_id FROM sym LEFT JOIN v ON token = 'note-' || step || octave WHERE kind IN ('note', 'rest')"""
)
def vocab_lookup(spark, sf_dir):
    rows = symbols(spark, sf_dir).filter("kind in ('note', 'rest')").withColumn("token", F.coalesce(F.concat(F.lit("note-"), "step", F.col("octave").cast("string")), F.lit("rest")))
    return codec.looked_up(rows, codec.vocabulary(spark), "pitch").select("staff_id", "seq", "token_id")


# ---- ranking


@query(
    f"""{SYM}, t AS (SELECT staff_id, step || octave AS token, CASE WHEN cents % 2 = 0 THEN 1 ELSE -1 END AS n FROM sym WHERE kind = 'note'),
    c AS (SELECT staff_id, token, sum(n) AS n FROM t GROUP BY 1, 2) SELECT staff_id, CAST(sum(abs(n)) AS bigint) AS distance FROM c GROUP BY 1"""
)
def multiset_distance(spark, sf_dir):
    notes = symbols(spark, sf_dir).filter("kind = 'note'").withColumn("token", F.concat("step", F.col("octave").cast("string")))
    return ranking.multiset_distance(notes.filter("cents % 2 = 0"), notes.filter("cents % 2 <> 0"))


@query(
    f"""{SYM}, a AS (SELECT staff_id, seq % 3 AS attempt, sum(CAST(kind = 'note' AND cents % 2 = 0 AS int)) AS distance, sum(CAST(alter_in IS NOT NULL AS int)) - sum(CAST(kind = 'clef' AS int)) AS diff,
       round(stddev_pop(ticks), 6) AS sd, greatest(sum(CAST(kind = 'time' AS int)) - 1, 0) AS surplus, sum(CAST(kind = 'rest' AS int)) AS ne, sum(CAST(kind = 'note' AS int)) AS na FROM sym GROUP BY 1, 2),
    r AS (SELECT *, round((distance + abs(diff) + sd + surplus) / greatest(least(ne, na), 1), 6) AS rating FROM a)
    SELECT staff_id, arg_min(attempt, (rating, attempt)) AS attempt, min(rating) AS rating FROM r GROUP BY 1"""
)
def candidate_rank(spark, sf_dir):
    s = symbols(spark, sf_dir).withColumn("attempt", F.col("seq") % 3)
    a = s.groupBy("staff_id", "attempt").agg(
        F.count_if((F.col("kind") == "note") & (F.col("cents") % 2 == 0)).alias("distance"),
        (F.count("alter") - F.count_if(F.col("kind") == "clef")).alias("diff_accidentals"),
        F.round(F.stddev_pop("ticks"), 6).alias("measure_std"),
        music.surplus(F.count_if(F.col("kind") == "time")).alias("surplus"),
        F.count_if(F.col("kind") == "rest").alias("n_expected"),
        F.count_if(F.col("kind") == "note").alias("n_actual"),
    )
    best = ranking.best_candidates(a.withColumn("has_clef", F.lit(True)))
    return best.select("staff_id", "attempt", F.round("rating", 6).alias("rating"))


@query(
    """WITH e AS (SELECT vec_id, unnest(embedding) AS logit, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS r, count(*) OVER (PARTITION BY vec_id) AS n FROM e)
    SELECT vec_id, token, round(logit, 6) AS logit FROM r WHERE r <= ceil(0.3 * n)"""
)
def topk_logits(spark, sf_dir):
    logits = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit"))
    return ranking.top_logits(logits).select("vec_id", "token", F.round(F.col("logit").cast("double"), 6).alias("logit"))


@query("WITH m AS (SELECT event_id, event_type, value, avg(value) OVER w AS a, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type)) SELECT event_id, event_type FROM m WHERE abs(value - a) <= 2 * s")
def outlier_filter(spark, sf_dir):
    return ranking.usual_only(table(spark, sf_dir, "events"), "value", ("event_type",)).select("event_id", "event_type")


# ---- joins


@query(
    f"""{BOX} SELECT a.page_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id % 2 = 0 AND b.box_id % 2 = 1
      AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2"""
)
def overlap_join(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return spatial.box_candidates(b.filter("box_id % 2 = 0"), b.filter("box_id % 2 = 1"))


@query(
    f"""{BOX}, e AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id <> b.box_id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2)
    , reach AS (SELECT * FROM (WITH RECURSIVE r(node, root) AS (SELECT box_id, box_id FROM boxes UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY 1))
    SELECT page_id, root, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM boxes JOIN reach ON node = box_id GROUP BY 1, 2"""
)
def components(spark, sf_dir):
    b = boxes(spark, sf_dir)
    pairs = spatial.box_candidates(b, b).filter("a < b")
    return grouping.merged_boxes(b, pairs)


@query(
    f"""{BOX}, p AS (SELECT a.page_id, a.box_id AS a, min(b.box_id) AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id % 3 = 0 AND b.box_id % 3 = 1
      AND a.x1 - 7.5 <= b.x2 AND b.x1 <= a.x2 + 7.5 AND a.y1 - 7.5 <= b.y2 AND b.y1 <= a.y2 + 7.5 GROUP BY 1, 2)
    SELECT n.page_id, n.box_id AS notehead_id, s.box_id AS stem_id, CASE WHEN s.y1 + s.h / 2.0 < n.y1 + n.h / 2.0 THEN 'up' WHEN s.box_id IS NOT NULL THEN 'down' END AS direction
    FROM boxes n LEFT JOIN p ON p.a = n.box_id LEFT JOIN boxes s ON s.box_id = p.b WHERE n.box_id % 3 = 0"""
)
def first_match_join(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumns({"cx": F.col("x1") + F.col("w") / 2, "cy": F.col("y1") + F.col("h") / 2})
    heads = b.filter("box_id % 3 = 0").withColumnRenamed("box_id", "notehead_id")
    stems = b.filter("box_id % 3 = 1").withColumnRenamed("box_id", "stem_id")
    return spatial.noteheads_with_stems(heads, stems)


@query(
    f"""{SYM}, i AS (SELECT staff_id, seq AS item_id, seq * 7 AS x FROM sym WHERE kind = 'note'), g AS (SELECT staff_id, seq * 11 % 900 AS gx, min(seq) AS ord FROM sym WHERE kind = 'rest' GROUP BY 1, 2),
    r AS (SELECT i.*, gx, row_number() OVER (PARTITION BY i.staff_id, item_id ORDER BY abs(gx - x), gx) AS r FROM i LEFT JOIN g ON g.staff_id = i.staff_id AND abs(gx - x) <= 50)
    SELECT staff_id, item_id, x, gx AS grid_x FROM r WHERE r = 1"""
)
def nearest_asof(spark, sf_dir):
    s = symbols(spark, sf_dir)
    items = s.filter("kind = 'note'").select("staff_id", F.col("seq").alias("item_id"), (F.col("seq") * 7).alias("x"))
    grid = s.filter("kind = 'rest'").select("staff_id", (F.col("seq") * 11 % 900).alias("x")).distinct()
    return spatial.nearest_point(items, grid, ("staff_id",)).select("staff_id", "item_id", "x", "grid_x")


@query(
    f"""{BOX}, z AS (SELECT page_id, box_id AS anchor_id, y1 - h AS low, y2 + h AS high FROM boxes WHERE box_id % 2 = 0), f AS (SELECT page_id, box_id AS fragment_id, y1 + h / 2.0 AS cy FROM boxes WHERE box_id % 2 = 1)
    SELECT z.page_id, anchor_id, fragment_id FROM z JOIN f ON z.page_id = f.page_id AND cy BETWEEN low AND high"""
)
def zone_interval_join(spark, sf_dir):
    b = boxes(spark, sf_dir)
    zones = b.filter("box_id % 2 = 0").select("page_id", F.col("box_id").alias("anchor_id"), (F.col("y1") - F.col("h")).alias("low"), (F.col("y2") + F.col("h")).alias("high"))
    fragments = b.filter("box_id % 2 = 1").select("page_id", F.col("box_id").alias("fragment_id"), (F.col("y1") + F.col("h") / 2).alias("cy"))
    return spatial.fragments_in_zones(fragments, zones)


@query(
    f"""{BOX}, i AS (SELECT page_id, box_id AS interval_id, x1 AS low, x2 AS high FROM boxes) SELECT a.page_id, interval_id FROM i a WHERE interval_id % 2 = 0
      AND NOT EXISTS (SELECT 1 FROM i b WHERE b.page_id = a.page_id AND b.interval_id % 2 = 1 AND a.low <= b.high AND b.low <= a.high)"""
)
def anti_overlap(spark, sf_dir):
    i = boxes(spark, sf_dir).select("page_id", F.col("box_id").alias("interval_id"), F.col("x1").alias("low"), F.col("x2").alias("high"))
    left = i.filter("interval_id % 2 = 0").withColumn("_id", F.col("interval_id"))
    return spatial.intervals_apart(left, i.filter("interval_id % 2 = 1"), "page_id", 100).select("page_id", "interval_id")


@query(
    """WITH i AS (SELECT DISTINCT l_orderkey // 100 AS page_id, l_orderkey AS id, l_partkey % 12 AS item FROM lineitem),
    s AS (SELECT page_id, id AS set_id, item FROM i WHERE id % 2 = 0), p AS (SELECT page_id, id AS super_id, item FROM i WHERE id % 2 = 1),
    size AS (SELECT page_id, set_id, count(*) AS n FROM s GROUP BY 1, 2),
    m AS (SELECT s.page_id, set_id, super_id, count(*) AS m FROM s JOIN p ON s.page_id = p.page_id AND s.item = p.item GROUP BY 1, 2, 3),
    f AS (SELECT m.page_id, m.set_id, count(*) AS k, min(super_id) AS super_id FROM m JOIN size USING (page_id, set_id) WHERE m = n GROUP BY 1, 2)
    SELECT page_id, set_id, CASE WHEN k = 1 THEN super_id END AS super_id FROM size LEFT JOIN f USING (page_id, set_id)"""
)
def set_containment(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("page_id"), "l_orderkey", (F.col("l_partkey") % 12).alias("item"))
    return spatial.contained_once(li.filter("l_orderkey % 2 = 0").withColumnRenamed("l_orderkey", "set_id"), li.filter("l_orderkey % 2 = 1").withColumnRenamed("l_orderkey", "super_id"))


@query(
    """WITH e AS (SELECT user_id AS page_id, event_id AS staff_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    j AS (SELECT *, coalesce(abs(value - before) < 10, false) AS joined FROM e)
    SELECT page_id, staff_id, CAST(sum(CAST(NOT joined AS int)) OVER (PARTITION BY page_id ORDER BY staff_id ROWS UNBOUNDED PRECEDING) - 1 AS int) AS island FROM j"""
)
def islands_of_staffs(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").withColumn("joined", F.abs(F.col("value") - F.lag("value").over(w)) < 10)
    rows = e.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("staff_id"), F.col("event_id").alias("min_y"), "joined")
    return grouping.islands(rows, "joined").select("page_id", "staff_id", "island")


# ---- functions


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS double) AS w, CAST(l_partkey % 90 + 1 AS double) AS h, CAST(l_suppkey * 37 % 361 - 180 AS double) AS a, CAST(l_partkey % 700 AS double) AS cx, CAST(l_suppkey % 300 AS double) AS cy FROM lineitem)
    SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN abs(a) > 45 AND abs(a) <= 135 THEN h ELSE w END), 4) AS sum_w, round(sum(CASE WHEN abs(a) > 45 AND abs(a) <= 135 THEN w ELSE h END), 4) AS sum_h,
      round(sum(CASE WHEN a > 135 THEN a - 180 WHEN a < -135 THEN a + 180 WHEN a > 45 THEN a - 90 WHEN a < -45 THEN a + 90 ELSE a END), 4) AS sum_angle,
      CAST(sum(trunc(cx - w / 2)) AS bigint) AS sum_x1, CAST(sum(trunc(cy + h / 2)) AS bigint) AS sum_y2,
      CAST(sum(round_even((cx + w) / 2, 0)) AS bigint) AS sum_center,
      CAST(sum(CASE WHEN h / w > 0.1 THEN trunc(w / h * 128) ELSE 1280 END) AS bigint) AS sum_canvas
    FROM b GROUP BY 1"""
)
def box_geometry(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("w"), (F.col("l_partkey") % 90 + 1.0).alias("h"), (F.col("l_suppkey") * 37 % 361 - 180.0).alias("a"), (F.col("l_partkey") % 700 * 1.0).alias("cx"), (F.col("l_suppkey") % 300 * 1.0).alias("cy"))
    c = F.col
    n, t = geometry.normal_angle(c("w"), c("h"), c("a")), geometry.truncated_box(c("cx"), c("cy"), c("w"), c("h"))
    return b.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(n["w"]), 4).alias("sum_w"),
        F.round(F.sum(n["h"]), 4).alias("sum_h"),
        F.round(F.sum(n["angle"]), 4).alias("sum_angle"),
        F.sum(t["x1"]).alias("sum_x1"),
        F.sum(t["y2"]).alias("sum_y2"),
        F.sum(geometry.box_center(c("cx"), c("cy"), c("w"), c("cy"))["x"]).cast("long").alias("sum_center"),
        F.sum(geometry.canvas_size(c("w"), c("h"))["w"]).cast("long").alias("sum_canvas"),
    )


@query(
    """WITH p AS (SELECT p_partkey, p_size + 500 AS w, p_partkey % 3000 + 200 AS h FROM part), r AS (SELECT *, sqrt(3675000.0 / (w * h)) AS r, w * h BETWEEN 3000000 AND 4350000 AS fits FROM p)
    SELECT p_partkey, CAST(CASE WHEN fits THEN w ELSE round_even(w * r, 0) END AS int) AS w, CAST(CASE WHEN fits THEN h ELSE round_even(h * r, 0) END AS int) AS h FROM r"""
)
def page_sizes(spark, sf_dir):
    size = geometry.target_size(F.col("p_size") + 500, F.col("p_partkey") % 3000 + 200)
    return table(spark, sf_dir, "part").select("p_partkey", size["w"].alias("w"), size["h"].alias("h"))


@query(
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 10 + l_suppkey % 5 AS u, 100 + l_partkey % 50 AS y0, 60.0 + l_partkey * 7 % 180 AS cy, CAST(l_partkey % 15 - 7 AS int) AS k, substr('GFC', CAST(l_suppkey % 3 AS int) + 1, 1) AS sign FROM lineitem),
    i AS (SELECT *, list_position(d, list_min(d)) - 1 AS idx FROM (SELECT *, [abs(y0 - cy), abs(y0 + u - cy), abs(y0 + 2 * u - cy), abs(y0 + 3 * u - cy), abs(y0 + 4 * u - cy)] AS d FROM l)),
    p AS (SELECT *, CAST(2 * (5 - idx) + round_even(2 * (y0 + idx * u - cy) / u, 0) - 1 AS int) AS position FROM i),
    q AS (SELECT *, CASE sign WHEN 'F' THEN 2 ELSE 0 END + position + 1 AS s, CASE sign WHEN 'G' THEN 4 WHEN 'F' THEN 2 ELSE 3 END AS o FROM p),
    z AS (SELECT *, substr('CDEFGAB', CAST((s % 7 + 7) % 7 AS int) + 1, 1) AS step, CAST(o + floor(s / 7.0) AS int) AS octave FROM q)
    SELECT position, step, octave, {KEY_SQL.format(k="k", s="step")} AS alter, count(*) AS n FROM z GROUP BY 1, 2, 3, 4"""
)
def staff_position(spark, sf_dir):
    u, y0 = F.lit(10) + F.col("l_suppkey") % 5, F.lit(100) + F.col("l_partkey") % 50
    li = table(spark, sf_dir, "lineitem").select(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (y0 + i * u).cast("double")).alias("y"), (F.lit(60.0) + F.col("l_partkey") * 7 % 180).alias("cy"), (F.col("l_partkey") % 15 - 7).cast("int").alias("k"), F.substring(F.lit("GFC"), (F.col("l_suppkey") % 3 + 1).cast("int"), F.lit(1)).alias("sign"))
    placed = li.withColumn("position", geometry.staff_position(F.col("y"), F.col("cy")))
    placed = placed.withColumn("p", music.note_pitch(F.col("sign"), F.col("position"), F.col("k")))
    return placed.groupBy("position", "p.step", "p.octave", "p.alter").agg(F.count(F.lit(1)).alias("n"))


# ---- rasters as tables


@query(
    """WITH p AS (SELECT p_partkey AS page_id, 200 + p_size * 7 AS w, 150 + p_partkey % 400 AS h FROM part),
    t AS (SELECT page_id, least(x * 128, greatest(w - 256, 0)) AS x, least(y * 128, greatest(h - 256, 0)) AS y FROM p, range(40) a(x), range(40) b(y) WHERE x * 128 < w AND y * 128 < h)
    SELECT page_id, x, y, count(*) AS n FROM t GROUP BY 1, 2, 3"""
)
def tile_grid(spark, sf_dir):
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), (F.lit(200) + F.col("p_size") * 7).alias("width"), (F.lit(150) + F.col("p_partkey") % 400).alias("height"))
    return raster.tiles(pages, 256).groupBy("page_id", "x", "y").agg(F.count(F.lit(1)).alias("n"))


GRID = "g AS (SELECT l_orderkey // 1000 AS page_id, l_partkey % 20 AS i, l_suppkey % 20 AS j, round(avg(l_quantity * l_linenumber), 6) AS noise FROM lineitem GROUP BY 1, 2, 3)"


@query(
    f"""WITH {GRID}, n AS (SELECT a.*, noise > 50 AND EXISTS (SELECT 1 FROM g b WHERE b.page_id = a.page_id AND b.noise > 50 AND abs(a.i - b.i) + abs(a.j - b.j) = 1) AS noisy FROM g a),
    s AS (SELECT *, avg(CAST(noisy AS int)) OVER (PARTITION BY page_id) AS share FROM n) SELECT page_id, i, j, NOT (noisy AND share <= 0.5) AS keep FROM s"""
)
def noise_mask(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    grid = li.groupBy(F.floor(F.col("l_orderkey") / 1000).alias("page_id"), (F.col("l_partkey") % 20).alias("i"), (F.col("l_suppkey") % 20).alias("j")).agg(F.round(F.avg(F.col("l_quantity") * F.col("l_linenumber")), 6).alias("noise"))
    return raster.noise_mask(grid).select("page_id", "i", "j", "keep")


@query(
    """WITH p AS (SELECT l_orderkey // 100 AS page_id, CAST(l_quantity * 5 AS int) AS v FROM lineitem), h AS (SELECT page_id, v, count(*) AS n FROM p GROUP BY 1, 2),
    d AS (SELECT page_id, arg_max(v, (n, -v)) AS dominant FROM h GROUP BY 1),
    c AS (SELECT page_id, CAST(floor(sum(v * n) * 1.0 / sum(n)) AS int) AS center FROM h WHERE v BETWEEN 150 AND 254 GROUP BY 1)
    SELECT page_id, dominant, coalesce(center, 255) AS center FROM d LEFT JOIN c USING (page_id)"""
)
def dominant_color(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("page_id"), (F.col("l_quantity") * 5).cast("int").alias("v"))
    return raster.dominant_intensity(pixels).join(raster.dominant_color(pixels, 255), "page_id").select("page_id", "dominant", "center")


@query(
    """WITH p AS (SELECT l_orderkey // 1000 AS page_id, l_partkey % 300 AS y, CAST(l_linenumber > 3 AS int) AS v FROM lineitem),
    rows AS (SELECT page_id, y FROM (SELECT DISTINCT page_id FROM p), range(300) t(y)), n AS (SELECT page_id, y, count(*) AS n FROM p WHERE v > 0 GROUP BY 1, 2)
    SELECT page_id, y, coalesce(n, 0) AS n FROM rows LEFT JOIN n USING (page_id, y)"""
)
def row_profile(spark, sf_dir):
    pixels = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 1000).alias("page_id"), (F.col("l_partkey") % 300).alias("y"), (F.col("l_linenumber") > 3).cast("int").alias("v"))
    return staffs.row_profile(pixels, 300)


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey // 50 AS page_id, l_partkey % 600 * (1 + l_suppkey % 2) AS y FROM lineitem),
    g AS (SELECT *, y - lag(y) OVER (PARTITION BY page_id ORDER BY y) AS gap FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY gap NULLS LAST, y) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM g),
    u AS (SELECT *, avg(CASE WHEN r <= greatest(5, round_even(n * 0.2, 0)) THEN gap END) OVER (PARTITION BY page_id) AS unit FROM r)
    SELECT page_id, y, CAST(sum(CASE WHEN gap > unit * 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y ROWS UNBOUNDED PRECEDING) AS int) AS peak_group FROM u"""
)
def peak_groups(spark, sf_dir):
    peaks = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 50).alias("page_id"), (F.col("l_partkey") % 600 * (1 + F.col("l_suppkey") % 2)).alias("y")).distinct()
    return staffs.grouped_peaks(peaks).withColumnRenamed("group", "peak_group")


# ---- pages and jobs


@query(
    """WITH j AS (SELECT event_id // 4 AS doc_id, CASE event_type WHEN 'signup' THEN CASE WHEN user_id % 3 = 0 THEN 'failed' ELSE 'queued' END WHEN 'error' THEN CASE WHEN user_id % 5 = 0 THEN 'canceled' ELSE 'finished' END ELSE 'finished' END AS status FROM events)
    SELECT doc_id, count(*) AS n_jobs, sum(CAST(status = 'finished' AS int)) AS n_finished,
      CASE WHEN bool_and(status = 'finished') THEN 'finished' WHEN bool_or(status IN ('failed', 'stopped', 'canceled')) THEN 'failed' ELSE 'running' END AS status FROM j GROUP BY 1"""
)
def job_status(spark, sf_dir):
    t, u = F.col("event_type"), F.col("user_id")
    status = F.when(t == "signup", F.when(u % 3 == 0, "failed").otherwise("queued")).when(t == "error", F.when(u % 5 == 0, "canceled").otherwise("finished")).otherwise("finished")
    return jobs.order_status(table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("doc_id"), status.alias("status")))


def _pages(spark, sf_dir):
    """Symbols by document (of ten users), page, voice and system: all of them, and each page has all voices of its document.

    A voice is cut into as many parts as its document has pages: 40 symbols of the longest voice each, but
    no more pages than leave two symbols, one a system, of the shortest.
    """
    s = rules.segmented(symbols(spark, sf_dir))
    doc, voice = F.floor(F.col("staff_id") / 10).alias("doc_id"), (F.col("staff_id") % 10).alias("voice")
    sizes = s.groupBy(doc, voice).agg(F.count(F.lit(1)).alias("n"))
    pages = sizes.groupBy("doc_id").agg(F.least(F.ceil(F.max("n") / 40), F.greatest(F.floor(F.min("n") / 2), F.lit(1))).alias("pages"))
    s = s.select(doc, voice, *(c for c in s.columns if c != "staff_id")).join(sizes.join(pages, "doc_id"), ["doc_id", "voice"])
    half = F.expr("(seq - 1) * 2 * pages div n")
    s = s.withColumns({"page_no": F.floor(half / 2), "system_no": half % 2}).drop("n", "pages")
    new_line = F.col("measure_no") == F.min("measure_no").over(Window.partitionBy("doc_id", "voice", "page_no", "system_no"))
    return s.withColumns({"new_line": new_line, "new_page": new_line & (F.col("system_no") == 0) & (F.col("page_no") > 0) & (F.col("voice") == 0), "chord_pos": F.lit(0)}).drop("clef_no", "cents")


@query(
    f"""{SYM}, v AS (SELECT *, staff_id // 10 AS doc_id, staff_id % 10 AS voice FROM seg), z AS (SELECT doc_id, voice, count(*) AS n FROM v GROUP BY 1, 2),
    pg AS (SELECT doc_id, CAST(least(ceil(max(n) / 40.0), greatest(floor(min(n) / 2.0), 1)) AS bigint) AS pages FROM z GROUP BY 1),
    h AS (SELECT v.*, (seq - 1) * 2 * pages // n AS half FROM v JOIN z USING (doc_id, voice) JOIN pg USING (doc_id)),
    p AS (SELECT * EXCLUDE (seq, measure_no, clef_no), half // 2 AS page_no, half % 2 AS system_no, row_number() OVER (PARTITION BY doc_id, half // 2, voice ORDER BY half % 2, seq) AS seq FROM h),
    m AS (SELECT *, sum(CAST(kind = 'barline' AS int)) OVER w AS measure_no, sum(CAST(kind = 'clef' AS int)) OVER w AS clef_no FROM p WINDOW w AS (PARTITION BY doc_id, page_no, voice ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, last_value(alter_in IGNORE NULLS) OVER (PARTITION BY doc_id, page_no, voice, measure_no, clef_no, step, octave ORDER BY seq ROWS UNBOUNDED PRECEDING) AS c,
          coalesce(max(fifths) OVER (PARTITION BY doc_id, page_no, voice, clef_no), 0) AS k FROM m),
    a AS (SELECT *, CASE WHEN kind = 'note' THEN coalesce(c, {KEY_SQL.format(k="k", s="step")}) END AS sounding, row_number() OVER (PARTITION BY doc_id, voice ORDER BY page_no, system_no, seq) AS s FROM c),
    d AS (SELECT doc_id, voice, fifths AS best FROM (SELECT doc_id, voice, fifths, count(*) AS n, row_number() OVER (PARTITION BY doc_id, voice ORDER BY count(*) DESC, min(s)) AS r FROM a WHERE kind = 'clef' GROUP BY 1, 2, 3) WHERE r = 1 AND n >= 2),
    e AS (SELECT a.* EXCLUDE (fifths), CASE WHEN kind = 'clef' THEN coalesce(best, fifths) ELSE fifths END AS fifths FROM a LEFT JOIN d USING (doc_id, voice)),
    f AS (SELECT *, lag(sign) OVER q AS ps, lag(fifths) OVER q AS pf, row_number() OVER q AS r FROM e WINDOW q AS (PARTITION BY doc_id, voice, kind = 'clef' ORDER BY s)),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, voice, kind = 'time' ORDER BY s) AS tr FROM f WHERE NOT (kind = 'clef' AND r > 1 AND ps = sign AND pf = fifths)),
    x AS (SELECT *, sum(CAST(kind <> 'barline' AS int)) OVER (PARTITION BY doc_id, voice, page_no, system_no, measure_no) AS nn FROM t WHERE kind <> 'time' OR tr = 1)
    SELECT doc_id, voice, CAST(row_number() OVER (PARTITION BY doc_id, voice ORDER BY page_no, system_no, s) AS int) AS seq, kind, sign, fifths, step, octave, CAST(sounding AS int) AS alter, ticks FROM x WHERE nn > 0"""
)
def page_assembly(spark, sf_dir):
    return document.assembled(_pages(spark, sf_dir)).select("doc_id", "voice", "seq", "kind", "sign", "fifths", "step", "octave", "alter", "ticks")


@query()
def musicxml_text(spark, sf_dir):
    return document.music_xml(document.assembled(_pages(spark, sf_dir)))


# ---- rules that follow the order of arrival: compared with plain code in the tests


@query()
def chord_grouping(spark, sf_dir):
    b = boxes(spark, sf_dir)
    notes = b.select("page_id", (F.col("box_id") % 4).alias("staff_id"), F.col("box_id").alias("ord"), (F.col("x1") + F.col("w") / 2).cast("double").alias("cx"), F.when(F.col("h") > 10, F.col("x1").cast("double")).alias("stem_x"))
    return grouping.chords(notes)


@query()
def line_chaining(spark, sf_dir):
    b = boxes(spark, sf_dir)
    f = b.select("page_id", (F.col("y1") / 300).cast("long").alias("anchor_id"), F.col("box_id").alias("fragment_id"), (F.col("x1") + F.col("w") / 2).cast("double").alias("cx"), (F.col("y1") % 300 / 20).cast("int").cast("double").alias("cy"), F.col("w").cast("double").alias("w"), F.lit(0.0).alias("angle"), F.lit(20.0).alias("unit"))
    return staffs.chained_lines(f)


@query()
def dedupe_staffs(spark, sf_dir):
    return ranking.without_duplicate_staffs(boxes(spark, sf_dir).select("page_id", F.col("box_id").alias("staff_id"), "x1", "y1", "x2", "y2", (F.col("h") % 7).alias("anchors")))


@query(
    f"""{BOX}, o AS (SELECT page_id, x1, x2, CASE WHEN x1 >= lag(x2) OVER (PARTITION BY page_id ORDER BY x1, x2) THEN 1 ELSE 0 END AS new FROM boxes),
    z AS (SELECT page_id, x1, x2, CAST(sum(new) OVER (PARTITION BY page_id ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS bigint) AS zone FROM o)
    SELECT page_id, zone, min(x1) AS start, arg_max(x2, (x1, x2)) AS stop FROM z GROUP BY 1, 2"""
)
def merged_ranges(spark, sf_dir):
    return staffs.merged_ranges(boxes(spark, sf_dir).select("page_id", F.col("x1").alias("start"), F.col("x2").alias("stop")))


@query()
def peak_find(spark, sf_dir):
    return staffs.profile_peaks(row_profile(spark, sf_dir), 5.0)


@query()
def resample(spark, sf_dir):
    s = symbols(spark, sf_dir).filter("kind = 'note'")
    line = lambda i: F.when(F.col("cents") % (i + 3) != 0, F.lit(100.0 + 20 * i) + F.col("cents") % 9)
    return staffs.tracked_points(s.select(F.lit(0).cast("long").alias("page_id"), "staff_id", F.col("seq").cast("long").alias("ord"), (F.col("seq") * 10).cast("double").alias("x"), F.array(*(line(i) for i in range(5))).alias("y"), F.lit(20.0).alias("unit")))
