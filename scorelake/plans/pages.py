"""Queries over pages of boxes, staffs and pixels, over names and over jobs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.functions import geometry, music, tokens
from scorelake.operators import codec, contrast, dewarp, document, ranking, raster, raw_staffs, sampling, spatial, staffs
from scorelake.plans.catalog import BOX, SYM, TOKENS, note_tokens, query, token_strings
from scorelake.plans.derived import boxes, symbols, table
from scorelake.sources import jobs
from scorelake.sources.tables import by_key, dealt, materialize

# ---- functions of boxes


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber - 3 AS t, 10 + l_suppkey % 5 AS u, CAST(l_quantity AS double) AS w, CAST(l_partkey % 90 + 1 AS double) AS h, CAST(l_suppkey % 60 - 30 AS double) AS a,
        CAST(l_partkey % 700 AS double) AS cx, CAST(l_suppkey % 300 AS double) AS cy FROM lineitem),
    c AS (SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM b)
    SELECT l_orderkey, round(sum(x1 + y1 * 2 + x2 * 3 + y2 * 4), 4) AS sum_corners, round(sum(w + greatest(t, 0) + (h + greatest(t, 0)) * 2), 4) AS sum_thicker, round(sum(h + t), 4) AS sum_taller,
      round(sum(cx + t), 4) AS sum_moved, round(sum(round((350 - cx) * tan(radians(a)) + cy, 6)), 3) AS sum_y, CAST(sum(u * 5) AS bigint) AS sum_gap, count(*) FILTER (w - 10 > 0 AND h > 0) AS n_valid,
      count(*) FILTER (cx BETWEEN 10 AND 590 AND cy BETWEEN 10 AND 270) AS n_on_image,
      CAST(sum(greatest(0, least(499, round_even(x1, 0))) + greatest(0, least(199, round_even(y1, 0))) * 2 + greatest(0, least(499, round_even(x2, 0))) * 3 + greatest(0, least(199, round_even(y2, 0))) * 4) AS bigint) AS sum_crop,
      round(sum((cx + 5) * 2 + 2 * (5 * (cy - 3) + 10 * u)), 4) AS sum_transformed
    FROM c GROUP BY 1"""
)
def box_transforms(spark, sf_dir):
    c = F.col
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", (c("l_linenumber") - 3).alias("t"), (10 + c("l_suppkey") % 5).alias("u"), c("l_quantity").cast("double").alias("w"), (c("l_partkey") % 90 + 1.0).alias("h"), (c("l_suppkey") % 60 - 30.0).alias("a"), (c("l_partkey") % 700 * 1.0).alias("cx"), (c("l_suppkey") % 300 * 1.0).alias("cy"))
    k = geometry.corners(c("cx"), c("cy"), c("w"), c("h"))
    thick = geometry.thicker(c("w"), c("h"), c("t"))
    crop = geometry.crop_box(k["x1"], k["y1"], k["x2"], k["y2"], F.lit(500), F.lit(200))
    lines = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: c("cy") + i * c("u"))
    moved = geometry.transformed(lines, F.lit(5.0), F.lit(-3.0), F.lit(2.0), c("cx"))
    return b.groupBy("l_orderkey").agg(
        F.round(F.sum(k["x1"] + k["y1"] * 2 + k["x2"] * 3 + k["y2"] * 4), 4).alias("sum_corners"),
        F.round(F.sum(thick["w"] + thick["h"] * 2), 4).alias("sum_thicker"),
        F.round(F.sum(geometry.taller(c("h"), c("t"))), 4).alias("sum_taller"),
        F.round(F.sum(geometry.moved_in_x(c("cx"), c("t"))), 4).alias("sum_moved"),
        F.round(F.sum(F.round(geometry.extrapolated(c("cx"), c("cy"), c("a"), F.lit(350)), 6)), 3).alias("sum_y"),
        F.sum(geometry.max_line_gap(c("u"))).cast("long").alias("sum_gap"),
        F.count_if(geometry.valid_size(c("w") - 10, c("h"))).alias("n_valid"),
        F.count_if(geometry.on_image(c("cx"), c("cy"), F.lit(600), F.lit(280))).alias("n_on_image"),
        F.sum(crop["x1"] + crop["y1"] * 2 + crop["x2"] * 3 + crop["y2"] * 4).cast("long").alias("sum_crop"),
        F.round(F.sum(moved["x"] + F.aggregate(moved["y"], F.lit(0.0), lambda x, y: x + y)), 4).alias("sum_transformed"),
    )


# ---- names


@query(
    f"""{SYM} SELECT staff_id, seq, 'note-' || step || octave || CASE alter_in WHEN 1 THEN '#' WHEN -1 THEN 'b' WHEN 0 THEN 'N' ELSE '' END || '_quarter' AS token,
      step || octave || CASE alter_in WHEN 1 THEN '#' WHEN -1 THEN 'b' WHEN 0 THEN '♮' ELSE '' END AS pitch,
      CASE base WHEN 64 THEN 'whole' WHEN 32 THEN 'half' WHEN 16 THEN 'quarter' WHEN 8 THEN 'eighth' WHEN 4 THEN '16th' WHEN 2 THEN '32nd' WHEN 1 THEN '64th' ELSE 'quarter' END || CASE modifier WHEN 'dot' THEN '.' WHEN 'triplet' THEN '³' ELSE '' END AS duration
    FROM sym WHERE kind = 'note'"""
)
def note_names(spark, sf_dir):
    n = symbols(spark, sf_dir).filter("kind = 'note'")
    step, octave, alter = F.col("step"), F.col("octave"), F.col("alter")
    return n.select("staff_id", "seq", tokens.note_token(step, octave, alter, F.lit("quarter")).alias("token"), music.pitch_text(step, octave, alter).alias("pitch"), music.duration_text(F.col("base"), F.col("modifier")).alias("duration"))


@query(
    f"""{SYM} SELECT staff_id, seq, ['CbM','GbM','DbM','AbM','EbM','BbM','FM','CM','GM','DM','AM','EM','BM','F#M','C#M'][fifths + 8] AS name,
      coalesce((SELECT string_agg(substr(o, CAST(i AS int), 1) || k, ',' ORDER BY i, k) FROM range(1, 8) a(i), range(11) b(k), (SELECT CASE WHEN fifths >= 0 THEN substr('FCGDAEB', 1, fifths) ELSE substr('BEADGCF', 1, -fifths) END AS o) WHERE i <= abs(fifths)), '') AS pitches
    FROM sym WHERE kind = 'clef'"""
)
def key_pitches(spark, sf_dir):
    clefs = symbols(spark, sf_dir).filter("kind = 'clef'")
    return clefs.select("staff_id", "seq", music.key_name(F.col("fifths")).alias("name"), F.array_join(music.altered_pitches(F.col("fifths")), ",").alias("pitches"))


@query(
    f"""{TOKENS} SELECT staff_id, coalesce(arg_min(CASE WHEN kind = 'clef' THEN sign || '2' END, CASE WHEN kind = 'clef' THEN seq END), '') AS clef,
      count(*) FILTER (kind = 'note') AS n_notes, sum(CAST(kind = 'note' AND alter_in = 0 AS int)) AS n_naturals FROM joint GROUP BY 1"""
)
def first_clefs(spark, sf_dir):
    rows = token_strings(spark, sf_dir)
    pitches = F.flatten(F.transform(F.split("tokens", r"\+"), tokens.flattened))
    notes = F.filter(pitches, lambda p: p.startswith("note-"))
    return rows.select("staff_id", tokens.first_clef(F.col("tokens")).alias("clef"), F.size(notes).cast("long").alias("n_notes"), F.size(F.filter(notes, lambda p: p.endswith("N"))).cast("long").alias("n_naturals"))


@query(
    f"""{TOKENS} SELECT staff_id, seq, CASE WHEN kind = 'note' THEN 'note-' || nm || CASE WHEN modifier = 'dot' THEN '.' ELSE '' END
        WHEN kind = 'clef' THEN 'clef-' || sign || '2' WHEN kind = 'rest' THEN 'rest-' || nm WHEN kind = 'time' THEN 'timeSignature-/' || den ELSE token END AS rhythm,
      CASE WHEN kind = 'note' THEN 'note-' || step || octave ELSE 'nonote' END AS pitch, CASE WHEN kind = 'note' THEN CASE alter_in WHEN 1 THEN '#' WHEN -1 THEN 'b' WHEN 0 THEN 'N' ELSE '' END END AS accidental FROM tok"""
)
def token_streams(spark, sf_dir):
    t = F.col("token")
    rows = note_tokens(spark, sf_dir).withColumn("token", F.when(F.col("kind") == "clef", F.get(F.split("token", r"\+"), F.lit(0))).otherwise(t))
    return rows.select("staff_id", "seq", F.when(tokens.is_note(t), tokens.note_rhythm(t)).otherwise(tokens.other_rhythm(t)).alias("rhythm"), tokens.note_pitch_name(t).alias("pitch"), tokens.note_accidental(t).alias("accidental"))


@query(
    f"""{SYM} SELECT staff_id, seq, 'note-' || substr('CDEFGAB', CAST((id - 1) % 7 AS int) + 1, 1) || (id - 1) // 7 AS token FROM (SELECT staff_id, seq, cents % 80 AS id FROM sym) WHERE id BETWEEN 3 AND 70"""
)
def detokenized_ids(spark, sf_dir):
    ids = symbols(spark, sf_dir).select("staff_id", "seq", (F.col("cents") % 80).alias("id"))
    return codec.detokenized(ids, codec.vocabulary(spark), "pitch").select("staff_id", "seq", "token")


# ---- boxes on staffs: ten staffs a page, with a point every ten pixels from 100 to 1900, sinking by a pixel every 500

GRID = f"""{BOX}, pages AS (SELECT DISTINCT page_id FROM boxes),
 staffs AS (SELECT page_id, s AS staff_id, CAST(8 + s AS double) AS u, CAST(300 * s + 100 AS double) AS y0 FROM pages, range(10) t(s)),
 items AS (SELECT page_id, box_id, CAST(x1 + w / 2.0 AS double) AS cx, CAST(y1 + h / 2.0 AS double) AS cy, CAST(w AS double) AS w, CAST(h AS double) AS h, CAST(y1 AS double) AS y1, CAST(y2 AS double) AS y2 FROM boxes),
 near AS (SELECT i.*, staff_id, u, y0, CAST(least(greatest(10 * ceil((cx - 5) / 10), 100), 1900) AS double) AS gx FROM items i JOIN staffs USING (page_id)),
 placed AS (SELECT *, y0 + floor(gx / 500) AS l0 FROM near WHERE abs(gx - cx) <= 50),
 d AS (SELECT *, [abs(l0 - cy), abs(l0 + u - cy), abs(l0 + 2 * u - cy), abs(l0 + 3 * u - cy), abs(l0 + 4 * u - cy)] AS d FROM placed)"""


def _grid_and_items(spark, sf_dir, id_):
    """The points of staffs and the items, both dealt by page to the same tasks."""
    pages = dealt(table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("page_id")).distinct(), "page_id", 10 * 181)
    return _grid(pages), _items(boxes(spark, sf_dir, pages.rdd.getNumPartitions()), id_)


def _grid(pages):
    staff = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<long>")).alias("staff_id")).withColumn("unit", 8.0 + F.col("staff_id"))
    points = staff.withColumn("x", F.explode(F.sequence(F.lit(100), F.lit(1900), F.lit(10)))).withColumn("x", F.col("x").cast("double"))
    line = lambda i: 300.0 * F.col("staff_id") + 100 + F.floor(F.col("x") / 500) + i * F.col("unit")
    return points.withColumn("y", F.transform(F.sequence(F.lit(0), F.lit(4)), line))


def _items(b, id_):
    d = lambda c: F.col(c).cast("double")
    return b.select("page_id", F.col("box_id").alias(id_), (F.col("x1") + F.col("w") / 2).alias("x"), (F.col("y1") + F.col("h") / 2).alias("cy"), d("w").alias("w"), d("h").alias("h"), d("y1").alias("top"), d("y2").alias("bottom"))


@query(
    f"""{GRID} SELECT page_id, box_id AS symbol_id, staff_id, gx AS grid_x, (h >= 3 * u AND w <= 2 * u AND abs(l0 - y1) <= 4 * u AND abs(l0 + 4 * u - y2) <= 4 * u) AS bar,
      (list_position(d, list_min(d)) IN (2, 3) AND w BETWEEN 0.7 * u AND 3.5 * u AND h BETWEEN 0.7 * u AND 3.5 * u) AS rest,
      (w BETWEEN 0.5 * u AND 3 * u AND h BETWEEN 0.5 * u AND 3 * u) AS accidental, (w BETWEEN 0.5 * u AND 3 * u AND h BETWEEN 0.5 * u AND 2 * u) AS note
    FROM d WHERE cy BETWEEN l0 - 4 * u AND l0 + 8 * u"""
)
def staff_symbols(spark, sf_dir):
    grid, items = _grid_and_items(spark, sf_dir, "symbol_id")
    found = spatial.on_staffs(items, grid, spatial.staff_units(grid))
    w, h, u, y = F.col("w"), F.col("h"), F.col("unit"), F.col("y")
    bar = spatial.bar_line_sized(w, h, u) & spatial.bar_line_on_staff(y, F.col("top"), F.col("bottom"), u)
    return found.select("page_id", "symbol_id", "staff_id", "grid_x", bar.alias("bar"), spatial.rest_on_staff(y, F.col("cy"), w, h, u).alias("rest"), spatial.accidental_sized(w, h, u).alias("accidental"), spatial.notehead_sized(w, h, u).alias("note"))


@query(
    f"""{GRID}, all_ AS (SELECT n.page_id, n.box_id, n.staff_id, coalesce(list_min(d), 1e10) AS distance FROM near n LEFT JOIN d ON d.page_id = n.page_id AND d.box_id = n.box_id AND d.staff_id = n.staff_id)
    SELECT page_id, box_id AS item_id, arg_min(staff_id, (distance, staff_id)) AS staff_id, min(distance) AS distance FROM all_ GROUP BY 1, 2"""
)
def nearest_staffs(spark, sf_dir):
    grid, items = _grid_and_items(spark, sf_dir, "item_id")
    return spatial.nearest_staff(items, grid)


@query(
    f"""{GRID}, all_ AS (SELECT n.page_id, n.box_id, n.staff_id, n.u, n.w, n.h, coalesce(list_min(d), 1e10) AS distance FROM near n LEFT JOIN d ON d.page_id = n.page_id AND d.box_id = n.box_id AND d.staff_id = n.staff_id WHERE n.h > 16 AND n.w < 24)
    SELECT page_id, item_id FROM (SELECT page_id, box_id AS item_id, any_value(h) AS h, arg_min(u, (distance, staff_id)) AS v FROM all_ GROUP BY 1, 2) WHERE h > 4 * v"""
)
def tall_items(spark, sf_dir):
    grid, items = _grid_and_items(spark, sf_dir, "item_id")
    return spatial.tall_elements(items, grid, spatial.staff_units(grid)).select("page_id", "item_id")


@query(
    f"""{BOX}, s AS (SELECT page_id, box_id % 100 AS staff_id, min(x1) AS a, max(x2) AS b, min(y1) AS c FROM boxes GROUP BY 1, 2) SELECT page_id, staff_id FROM s WHERE NOT (a > 0.90 * 1400 OR c > 0.95 * 2000 OR b < 0.20 * 1400)"""
)
def staffs_in_view(spark, sf_dir):
    s = boxes(spark, sf_dir).groupBy("page_id", (F.col("box_id") % 100).alias("staff_id")).agg(F.min("x1").alias("a"), F.max("x2").alias("b"), F.min("y1").alias("c"))
    return s.filter(spatial.in_view(F.col("a"), F.col("b"), F.col("c"), F.lit(1400), F.lit(2000))).select("page_id", "staff_id")


@query(
    f"""{BOX}, s AS (SELECT page_id, box_id % 20 AS staff_id, min(x1) AS l, max(x2) AS r, min(y1) AS t, min(y1) + 60 + max(h) AS b, 8.0 + box_id % 20 AS u, max(CASE WHEN box_id % 3 = 0 THEN y2 END) AS nb, min(CASE WHEN box_id % 3 = 0 THEN y1 END) AS nt FROM boxes GROUP BY page_id, box_id % 20),
    c AS (SELECT *, (t + b) // 2 AS c FROM s), o AS (SELECT page_id, c, lag(c) OVER w AS above, lead(c) OVER w AS below FROM (SELECT DISTINCT page_id, c FROM c) WINDOW w AS (PARTITION BY page_id ORDER BY c)),
    n AS (SELECT c.*, least(CASE WHEN above >= 0 THEN b - above END, below - t) AS near FROM c JOIN o USING (page_id, c)),
    y AS (SELECT *, nt IS NOT NULL AS has, (near > 3 * u AND near < 8 * u) AS close, CASE WHEN nt IS NULL THEN 3.5 ELSE 2.5 END * u AS m FROM n)
    SELECT page_id, staff_id, CAST(trunc(l - 2 * u) AS int) AS x1, CAST(trunc(CASE WHEN close THEN t - near ELSE least(t - m, coalesce(nt - u, t - m)) END) AS int) AS y1,
      CAST(trunc(r + 2 * u) AS int) AS x2, CAST(trunc(CASE WHEN close THEN b + near ELSE greatest(b + m, coalesce(nb + u, b + m)) END) AS int) AS y2 FROM y"""
)
def staff_regions(spark, sf_dir):
    staff = (F.col("box_id") % 20).alias("staff_id")
    note = lambda c: F.when(F.col("box_id") % 3 == 0, F.col(c))
    s = boxes(spark, sf_dir).groupBy("page_id", staff).agg(F.min("x1").alias("min_x"), F.max("x2").alias("max_x"), F.min("y1").alias("min_y"), (F.min("y1") + 60 + F.max("h")).alias("max_y"), F.max(note("y2")).alias("note_bottom"), F.min(note("y1")).alias("note_top"))
    s = staffs.with_nearest_offsets(s.withColumn("unit", 8.0 + F.col("staff_id")))
    c = F.col
    region = geometry.staff_region(c("min_x"), c("min_y"), c("max_x"), c("max_y"), c("unit"), c("note_top").isNotNull(), c("note_top"), c("note_bottom"), c("near"))
    return s.select("page_id", "staff_id", region.alias("r")).select("page_id", "staff_id", "r.*")


# ---- overlaps of polygons, braces, continuing lines


@query(
    f"""{BOX} SELECT a.page_id, a.box_id AS a, b.box_id AS b FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id % 2 = 0 AND b.box_id % 2 = 1
      AND ((a.x1 BETWEEN b.x1 AND b.x2 OR a.x2 BETWEEN b.x1 AND b.x2) AND (a.y1 BETWEEN b.y1 AND b.y2 OR a.y2 BETWEEN b.y1 AND b.y2) OR (b.x1 BETWEEN a.x1 AND a.x2 OR b.x2 BETWEEN a.x1 AND a.x2) AND (b.y1 BETWEEN a.y1 AND a.y2 OR b.y2 BETWEEN a.y1 AND a.y2))"""
)
def polygon_overlap(spark, sf_dir):
    b = boxes(spark, sf_dir)
    b = b.withColumn("polygon", spatial.turned_corners(F.col("x1") + F.col("w") / 2, F.col("y1") + F.col("h") / 2, F.col("w"), F.col("h"), F.lit(0.0)))
    return spatial.overlapping(b.filter("box_id % 2 = 0"), b.filter("box_id % 2 = 1"))


@query(
    f"""{BOX}, t AS (SELECT page_id, box_id, x1 + w / 2.0 AS cx, y1 + h / 2.0 AS cy, w, h, box_id % 2 AS odd FROM boxes), a AS (SELECT page_id, box_id, cx - h / 2.0 AS x1, cx + h / 2.0 AS x2, cy - w / 2.0 AS y1, cy + w / 2.0 AS y2 FROM t WHERE odd = 0),
    b AS (SELECT page_id, box_id, cx + 0.25 - w / 2.0 AS x1, cx + 0.25 + w / 2.0 AS x2, cy + 0.25 - h / 2.0 AS y1, cy + 0.25 + h / 2.0 AS y2 FROM t WHERE odd = 1)
    SELECT a.page_id, a.box_id AS a, b.box_id AS b FROM a JOIN b ON a.page_id = b.page_id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2"""
)
def turned_intersection(spark, sf_dir):
    """Even boxes are turned by 90 degrees."""
    b = boxes(spark, sf_dir).select("page_id", "box_id", (F.col("x1") + F.col("w") / 2 + 0.25 * (F.col("box_id") % 2)).alias("cx"), (F.col("y1") + F.col("h") / 2 + 0.25 * (F.col("box_id") % 2)).alias("cy"), "w", "h", F.when(F.col("box_id") % 2 == 0, 90.0).otherwise(0.0).alias("angle"))
    b = b.withColumn("polygon", spatial.turned_corners(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("angle")))
    reach = F.greatest("w", "h") / 2
    b = b.withColumns({"x1": F.col("cx") - reach, "x2": F.col("cx") + reach, "y1": F.col("cy") - reach, "y2": F.col("cy") + reach})
    return spatial.overlapping(b.filter("box_id % 2 = 0"), b.filter("box_id % 2 = 1"), spatial.polygons_intersect)


@query(
    f"""{BOX}, l AS (SELECT DISTINCT a.page_id, a.box_id AS brace_id, b.y1 // 300 AS staff_id FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id % 4 = 0 AND b.box_id % 4 <> 0
      AND a.x1 - 15 <= b.x2 AND b.x1 <= a.x2 + 15 AND a.y1 - 15 <= b.y2 AND b.y1 <= a.y2 + 15),
    s AS (SELECT *, lag(staff_id) OVER (PARTITION BY page_id ORDER BY min_y) AS above FROM (SELECT page_id, y1 // 300 AS staff_id, min(y1) AS min_y FROM boxes GROUP BY 1, 2))
    SELECT page_id, staff_id, min_y, EXISTS (SELECT 1 FROM l a JOIN l b USING (page_id, brace_id) WHERE a.page_id = s.page_id AND a.staff_id = s.staff_id AND b.staff_id = s.above) AS joined FROM s"""
)
def braced_staffs(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("staff_id", F.floor(F.col("y1") / 300))
    links = spatial.met_staffs(b.filter("box_id % 4 = 0").withColumnRenamed("box_id", "brace_id"), b.filter("box_id % 4 <> 0").withColumnRenamed("box_id", "symbol_id"), F.lit(30))
    return spatial.connected_staffs(links, b.groupBy("page_id", "staff_id").agg(F.min("y1").alias("min_y")))


@query(
    f"""{BOX}, t AS (SELECT boxes.*, rule, CASE rule WHEN 'clefs' THEN 0 ELSE h % 8 + 8 END AS half FROM boxes, (VALUES ('clefs'), ('lines')) r(rule) WHERE box_id % 4 = 0)
    SELECT DISTINCT rule, a.page_id, a.box_id AS brace_id, b.y1 // 300 AS staff_id FROM t a JOIN boxes b ON a.page_id = b.page_id AND b.box_id % 4 = CASE rule WHEN 'clefs' THEN 1 ELSE 2 END
      AND a.x1 - half <= b.x2 AND b.x1 <= a.x2 + half AND a.y1 - half <= b.y2 AND b.y1 <= a.y2 + half"""
)
def brace_rules(spark, sf_dir):
    """Braces with clefs, as they are, and with staff lines, two units thicker."""
    b = boxes(spark, sf_dir).withColumn("staff_id", F.floor(F.col("y1") / 300))
    braces, symbol = b.filter("box_id % 4 = 0").withColumnRenamed("box_id", "brace_id"), b.withColumnRenamed("box_id", "symbol_id")
    met = lambda rule, rest, thick: spatial.met_staffs(braces, symbol.filter(f"symbol_id % 4 = {rest}"), thick).select(F.lit(rule).alias("rule"), "page_id", "brace_id", "staff_id")
    return met("clefs", 1, F.lit(0)).unionByName(met("lines", 2, 2 * (F.col("h") % 8 + 8)))


@query(
    f"""{BOX}, f AS (SELECT page_id, box_id, x1 + w / 2.0 AS cx, y1 + h / 2.0 AS cy, w, box_id % 7 - 3 AS a FROM boxes), p AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b, a.cx AS acx, a.cy AS acy, a.w AS aw, a.a AS aa, b.cx AS bcx, b.cy AS bcy, b.w AS bw, b.a AS ba,
      (least(a.cx + a.w / 2.0, b.cx + b.w / 2.0) + greatest(a.cx - a.w / 2.0, b.cx - b.w / 2.0)) / 2 AS m FROM f a JOIN f b ON a.page_id = b.page_id AND a.box_id < b.box_id AND abs(a.cy - b.cy) < 60)
    SELECT page_id, a, b FROM p WHERE greatest(abs(m - acx) - aw / 2.0, 0) <= 100 AND greatest(abs(m - bcx) - bw / 2.0, 0) <= 100 AND abs((m - acx) * tan(radians(aa)) + acy - ((m - bcx) * tan(radians(ba)) + bcy)) <= 20.0 / 3"""
)
def continuing_lines(spark, sf_dir):
    f = boxes(spark, sf_dir).select("page_id", F.col("box_id").alias("fragment_id"), (F.col("x1") + F.col("w") / 2).alias("cx"), (F.col("y1") + F.col("h") / 2).alias("cy"), "w", (F.col("box_id") % 7 - 3).alias("angle"))
    return spatial.continuing_pairs(f, 20.0)


# ---- pieces of shapes


@query(
    f"""{BOX}, f AS (SELECT page_id, box_id AS fragment_id, x1 + w / 2.0 AS cx, y1 + h / 2.0 AS cy, w * 6 AS w, box_id % 7 - 3 AS a, greatest(CAST(ceil(w * 6 / 100.0) AS int), 1) AS n FROM boxes),
    p AS (SELECT *, unnest(range(n)) AS piece FROM f) SELECT page_id, fragment_id, CAST(piece AS int) AS piece, round(cx - w / 2.0 + w / n * (piece + 0.5), 6) AS cx, round((cx - w / 2.0 + w / n * (piece + 0.5) - cx) * tan(radians(a)) + cy, 6) AS cy, round(w / n, 6) AS w FROM p"""
)
def split_fragments(spark, sf_dir):
    f = boxes(spark, sf_dir).select("page_id", F.col("box_id").alias("fragment_id"), (F.col("x1") + F.col("w") / 2).alias("cx"), (F.col("y1") + F.col("h") / 2).alias("cy"), (F.col("w") * 6).alias("w"), "h", (F.col("box_id") % 7 - 3).alias("angle"))
    return raster.split_wide(f).select("page_id", "fragment_id", "piece", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "w")))


@query(
    f"""{BOX}, f AS (SELECT *, CAST(greatest(round_even((x2 - x1) / (12.0 * 1.285714), 0), 1) AS int) AS a, CAST(greatest(round_even((y2 - y1) / 12.0, 0), 1) AS int) AS d FROM boxes),
    p AS (SELECT *, unnest(range(a)) AS i FROM f), q AS (SELECT *, unnest(range(d)) AS j FROM p)
    SELECT page_id, box_id, CAST(i * d + j AS int) AS part, round(x1 + (x2 - x1) / a * i, 6) AS x1, round(y1 + (y2 - y1) / d * j, 6) AS y1, round(x1 + (x2 - x1) / a * (i + 1), 6) AS x2, round(y1 + (y2 - y1) / d * (j + 1), 6) AS y2 FROM q"""
)
def split_heads(spark, sf_dir):
    out = raster.split_noteheads(boxes(spark, sf_dir).withColumn("unit", F.lit(12.0)))
    return out.select("page_id", "box_id", "part", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(
    f"""{SYM}, l AS (SELECT staff_id, seq, [CASE WHEN cents % (i + 3) <> 0 THEN CAST(100 + 20 * i + cents % 9 AS double) END FOR i IN range(5)] AS y FROM sym WHERE kind = 'note'),
    z AS (SELECT staff_id, seq, y[1] AS a, y[2] AS b, y[3] AS c, y[4] AS d, y[5] AS e FROM l)
    SELECT staff_id, seq, coalesce(a, b - 20, c - 40, d - 60, e - 80) AS y0, coalesce(b, a + 20, c - 20, d - 40, e - 60) AS y1, coalesce(c, b + 20, a + 40, d - 20, e - 40) AS y2,
      coalesce(d, c + 20, b + 40, a + 60, e - 20) AS y3, coalesce(e, d + 20, c + 40, b + 60, a + 80) AS y4 FROM z WHERE coalesce(a, b, c, d, e) IS NOT NULL"""
)
def filled_staff_lines(spark, sf_dir):
    line = lambda i: F.when(F.col("cents") % (i + 3) != 0, F.lit(100.0 + 20 * i) + F.col("cents") % 9)
    s = symbols(spark, sf_dir).filter("kind = 'note'").select("staff_id", "seq", F.array(*(line(i) for i in range(5))).alias("y"), F.lit(20.0).alias("unit"))
    return staffs.filled_lines(s).select("staff_id", "seq", *(F.get("y", F.lit(i)).alias(f"y{i}") for i in range(5)))


@query(
    f"""{BOX} SELECT page_id, box_id AS staff_id, unnest(range(x1 // 10 * 10, x2 // 10 * 10 + 1, 10)) AS x FROM boxes"""
)
def staff_grid_places(spark, sf_dir):
    b = boxes(spark, sf_dir).select("page_id", F.col("box_id").alias("staff_id"), F.col("x1").alias("min_x"), F.col("x2").alias("max_x"))
    return staffs.grid_places(b).withColumn("x", F.col("x").cast("long"))


# ---- pixels: a page of 40 by 40 for each supplier

PIXELS = """px AS (SELECT s_suppkey AS page_id, y, x, (s_suppkey * 31 + y * y * 17 + x * 7 + x * y * 3) % 256 AS v FROM supplier, range(40) a(y), range(40) b(x))"""


def _pixels(spark, sf_dir):
    rows = dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id")), "page_id", 40 * 40)
    side = F.sequence(F.lit(0), F.lit(39)).cast("array<long>")
    y, x = F.col("y"), F.col("x")
    return rows.withColumn("y", F.explode(side)).withColumn("x", F.explode(side)).withColumn("v", (F.col("page_id") * 31 + y * y * 17 + x * 7 + x * y * 3) % 256)


@query(
    f"""WITH {PIXELS}, k AS (SELECT * FROM (VALUES (0,0,4),(0,1,-2),(0,-1,-2),(1,0,-2),(-1,0,-2),(1,1,1),(1,-1,1),(-1,1,1),(-1,-1,1)) t(dy, dx, k)),
    r AS (SELECT a.page_id, a.y, a.x, sum(b.v * k) AS r FROM px a, k JOIN px b ON b.page_id = a.page_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.y BETWEEN 1 AND 38 AND a.x BETWEEN 1 AND 38 GROUP BY 1, 2, 3),
    g AS (SELECT page_id, y // 10 AS i, x // 10 AS j, avg(abs(r)) AS noise FROM r GROUP BY 1, 2, 3),
    n AS (SELECT a.*, noise > 250 AND EXISTS (SELECT 1 FROM g b WHERE b.page_id = a.page_id AND b.noise > 250 AND abs(a.i - b.i) + abs(a.j - b.j) = 1) AS noisy FROM g a),
    s AS (SELECT *, noisy AND avg(CAST(noisy AS int)) OVER (PARTITION BY page_id) <= 0.5 AS gone FROM n)
    SELECT px.page_id, CAST(sum(CASE WHEN gone THEN 0 ELSE v END) AS bigint) AS total, count(*) FILTER (gone) AS n_gone FROM px LEFT JOIN s ON s.page_id = px.page_id AND i = y // 10 AND j = x // 10 GROUP BY 1"""
)
def denoised_pages(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    mask = raster.noise_mask(raster.grid_noise(pixels, 10), 250.0)
    out = raster.masked(pixels, mask, 10).groupBy("page_id").agg(F.sum("v").alias("total"))
    gone = mask.filter("not keep").join(by_key(pixels.select("page_id", F.floor(F.col("y") / 10).alias("i"), F.floor(F.col("x") / 10).alias("j"))), ["page_id", "i", "j"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_gone"))
    return out.join(gone, "page_id", "left").select("page_id", "total", F.coalesce("n_gone", F.lit(0)).alias("n_gone"))


@query(
    f"""WITH {PIXELS}, m AS (SELECT page_id, y, x, CAST(v > 200 AS int) AS v FROM px),
    s AS (SELECT page_id, sum(v) AS strong FROM (SELECT page_id, max(v) OVER (PARTITION BY page_id, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM m) GROUP BY 1),
    d AS (SELECT page_id, y, x, max(v) OVER (PARTITION BY page_id, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM m),
    b AS (SELECT page_id, sum(v) AS bars FROM (SELECT page_id, max(v) OVER (PARTITION BY page_id, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM d) GROUP BY 1),
    r AS (SELECT page_id, y, x, greatest(v - v // 3, 0) AS v FROM px), e AS (SELECT page_id, y, x, min(v) OVER (PARTITION BY page_id, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM r),
    o AS (SELECT page_id, sum(v) AS dots FROM (SELECT page_id, max(v) OVER (PARTITION BY page_id, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM e) GROUP BY 1)
    SELECT page_id, CAST(strong AS bigint) AS strong, CAST(bars AS bigint) AS bars, CAST(dots AS bigint) AS dots FROM s JOIN b USING (page_id) JOIN o USING (page_id)"""
)
def line_masks(spark, sf_dir):
    pixels = _pixels(spark, sf_dir)
    mask = pixels.withColumn("v", (F.col("v") > 200).cast("int"))
    total = lambda df, name: df.groupBy("page_id").agg(F.sum("v").cast("long").alias(name))
    staff = pixels.withColumn("v", F.floor(F.col("v") / 3))
    return total(raster.stronger_lines(mask), "strong").join(total(raster.bars_joined(mask), "bars"), "page_id").join(total(raster.braces_and_dots(pixels, staff), "dots"), "page_id")


@query(
    f"""WITH {PIXELS}, n AS (SELECT page_id, y * 40 + x AS id, y, x FROM px WHERE v % 5 = 0),
    e AS (SELECT a.page_id, a.id AS u, b.id AS v FROM n a JOIN n b ON a.page_id = b.page_id AND a.id <> b.id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    reach AS (SELECT * FROM (WITH RECURSIVE r(page_id, node, root) AS (SELECT page_id, id, id FROM n UNION SELECT e.page_id, e.v, r.root FROM r JOIN e ON e.page_id = r.page_id AND e.u = r.node) SELECT page_id, node, min(root) AS root FROM r GROUP BY 1, 2))
    SELECT n.page_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, count(*) AS area FROM reach JOIN n ON n.page_id = reach.page_id AND id = node GROUP BY n.page_id, root"""
)
def mask_regions(spark, sf_dir):
    mask = _pixels(spark, sf_dir).withColumn("v", (F.col("v") % 5 == 0).cast("int"))
    return raster.region_extents(raster.regions(mask)).drop("region")


REGIONS = """n AS (SELECT page_id, y * 40 + x AS id, y, x FROM px WHERE v % 5 = 0),
    e AS (SELECT a.page_id, a.id AS u, b.id AS v FROM n a JOIN n b ON a.page_id = b.page_id AND a.id <> b.id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    reach AS (SELECT * FROM (WITH RECURSIVE r(page_id, node, root) AS (SELECT page_id, id, id FROM n UNION SELECT e.page_id, e.v, r.root FROM r JOIN e ON e.page_id = r.page_id AND e.u = r.node) SELECT page_id, node, min(root) AS root FROM r GROUP BY 1, 2))"""


@query(
    f"""WITH {PIXELS}, {REGIONS}, s AS (SELECT n.page_id, root, count(*) AS n, sum(x)::BIGINT AS x, sum(y)::BIGINT AS y, sum(x * x)::BIGINT AS xx, sum(y * y)::BIGINT AS yy, sum(x * y)::BIGINT AS xy FROM reach JOIN n ON n.page_id = reach.page_id AND id = node GROUP BY 1, 2),
    m AS (SELECT *, (n * xx - x * x)::DOUBLE AS a, (n * yy - y * y)::DOUBLE AS b, (n * xy - x * y)::DOUBLE AS c FROM s)
    SELECT page_id, round(x / n, 4) AS cx, round(y / n, 4) AS cy, round(4 * sqrt(greatest((a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c), 0)) / n, 4) AS w,
      round(4 * sqrt(greatest((a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c), 0)) / n, 4) AS h, round(degrees(atan2(2 * c, a - b) / 2), 4) AS angle FROM m"""
)
def region_ellipses(spark, sf_dir):
    mask = _pixels(spark, sf_dir).withColumn("v", (F.col("v") % 5 == 0).cast("int"))
    return raster.region_ellipses(raster.regions(mask)).select("page_id", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "w", "h", "angle")))


@query(
    """WITH m AS (SELECT l_orderkey // 100 AS page_id, l_partkey % 10 AS y, l_suppkey % 10 AS x, l_linenumber % 3 AS class, avg(l_quantity) AS p FROM lineitem GROUP BY 1, 2, 3, 4)
    SELECT page_id, y, x, arg_max(class, (p, -class)) AS class FROM m GROUP BY 1, 2, 3"""
)
def voted_classes(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 100).alias("page_id"), (F.col("l_partkey") % 10).alias("y"), (F.col("l_suppkey") % 10).alias("x"), (F.col("l_linenumber") % 3).alias("class"), F.col("l_quantity").alias("p"))
    return raster.averaged_classes(p)


@query()
def adjusted_pages(spark, sf_dir):
    """No SQL, as light and contrast are a dozen steps; tests/test_contrast.py has plain code."""
    out = contrast.color_adjusted(_pixels(spark, sf_dir).withColumn("v", 120 + F.col("v") % 130), 10)
    return out.groupBy("page_id", "y").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("x")).alias("moment"))


@query()
def image_variants(spark, sf_dir):
    """With squares of 3 in squares of 5; no SQL, see tests/test_contrast.py."""
    out = contrast.image_variants(_pixels(spark, sf_dir), 40.0, 3, 5)
    return out.groupBy("page_id", "attempt", "y").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("x")).alias("moment"))


# ---- staffs: a page of 260 by 48 for each supplier, with a bent staff of five lines

STAFFS = """sp AS (SELECT s_suppkey AS page_id, range * 10 AS x, 16.0 + abs((range * 10 + s_suppkey * 37) % 160 - 80) / 10.0 + s_suppkey % 3 AS mid FROM supplier, range(26)),
    st AS (SELECT s_suppkey AS page_id, y, x, CASE WHEN (y - (16 + abs((x + s_suppkey * 37) % 160 - 80) // 10 + s_suppkey % 3)) IN (-8, -4, 0, 4, 8) THEN 0 ELSE 255 - (x * 7 + y * 3 + s_suppkey) % 40 END AS v FROM supplier, range(48) a(y), range(260) b(x))"""


def _bent_staffs(spark, sf_dir):
    """(pixels, points) of the staffs."""
    rows = dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id")), "page_id", 260 * 48)
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    page, y, x = F.col("page_id"), F.col("y"), F.col("x")
    wave = F.abs((x + page * 37) % 160 - 80)
    pixels = rows.withColumn("y", side(48)).withColumn("x", side(260))
    pixels = pixels.withColumn("v", F.when((y - (16 + F.floor(wave / 10) + page % 3)).isin(-8, -4, 0, 4, 8), F.lit(0).cast("long")).otherwise(255 - (x * 7 + y * 3 + page) % 40))
    points = rows.withColumn("x", side(26)).withColumn("x", x * 10).withColumn("mid", F.lit(16.0) + wave / 10.0 + page % 3)
    return pixels, points.select("page_id", "x", F.transform(F.array(*map(F.lit, (-8.0, -4.0, 0.0, 4.0, 8.0))), lambda d: F.col("mid") + d).alias("y"))


@query(
    f"""WITH {STAFFS}, cols AS (SELECT page_id, k * 80 + 2 AS x FROM (SELECT DISTINCT page_id FROM sp), range(4) r(k) WHERE k * 80 + 2 < 260),
    mid AS (SELECT c.page_id, c.x, arg_min(mid, (abs(sp.x - c.x), sp.x)) AS mid FROM cols c JOIN sp ON sp.page_id = c.page_id AND abs(sp.x - c.x) <= 50 GROUP BY 1, 2),
    bend AS (SELECT page_id, x, trunc(mid - first_value(mid) OVER (PARTITION BY page_id ORDER BY x)) AS bend FROM mid),
    pts AS (SELECT page_id, band, x, 2 + 8 * band + bend AS y FROM bend, range(6) r(band) WHERE 2 + 8 * band < 46 AND x BETWEEN 10 AND 250 AND 2 + 8 * band + bend BETWEEN 10 AND 38),
    lines AS (SELECT *, floor(avg(y) OVER w) AS t FROM pts WINDOW w AS (PARTITION BY page_id, band) QUALIFY count(*) OVER w > 2),
    one AS (SELECT * FROM lines QUALIFY band = min(band) OVER (PARTITION BY page_id, t)),
    ends AS (SELECT page_id, t, x, y FROM one UNION ALL SELECT page_id, t, 0, arg_min(y, x) FROM one GROUP BY 1, 2 UNION ALL SELECT page_id, t, 260, arg_max(y, x) FROM one GROUP BY 1, 2),
    grid AS (SELECT a.page_id, a.t, b.x FROM (SELECT DISTINCT page_id, t FROM ends) a JOIN (SELECT DISTINCT page_id, x FROM ends) b USING (page_id)),
    known AS (SELECT g.page_id, g.t, g.x, e.y, last_value(e.x IGNORE NULLS) OVER w AS ax, last_value(e.y IGNORE NULLS) OVER w AS ay, first_value(e.x IGNORE NULLS) OVER v AS bx, first_value(e.y IGNORE NULLS) OVER v AS by_
      FROM (SELECT g.*, e.x AS ex FROM grid g LEFT JOIN ends e USING (page_id, t, x)) g LEFT JOIN ends e ON e.page_id = g.page_id AND e.t = g.t AND e.x = g.ex
      WINDOW w AS (PARTITION BY g.page_id, g.t ORDER BY g.x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY g.page_id, g.t ORDER BY g.x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    nodes AS (SELECT page_id, t, x, coalesce(y, ay + (by_ - ay) * (x - ax) / (bx - ax)) AS s FROM known
      UNION ALL SELECT page_id, t, x, t FROM (SELECT DISTINCT page_id, x FROM ends), (VALUES (0.0::DOUBLE), (48.0::DOUBLE)) e(t)),
    c1 AS (SELECT *, lead(t) OVER d AS t1, lead(s) OVER d AS sb FROM nodes WINDOW d AS (PARTITION BY page_id, x ORDER BY t)),
    c2 AS (SELECT *, lead(x) OVER a AS x1, lead(s) OVER a AS sr, lead(sb) OVER a AS sa FROM c1 WINDOW a AS (PARTITION BY page_id, t ORDER BY x)),
    cells AS (SELECT * FROM c2 WHERE t1 IS NOT NULL AND x1 IS NOT NULL),
    placed AS (SELECT p.page_id, p.y, p.x, CASE WHEN (p.y - t) * (x1 - c.x) < (p.x - c.x) * (t1 - t)
      THEN s + (sr - s) / (x1 - c.x) * (p.x - c.x) + (sa - sr) / (t1 - t) * (p.y - t) ELSE s + (sa - sb) / (x1 - c.x) * (p.x - c.x) + (sb - s) / (t1 - t) * (p.y - t) END AS f
      FROM st p JOIN cells c ON c.page_id = p.page_id AND p.x >= c.x AND p.x < x1 AND p.y >= t AND p.y < t1),
    new AS (SELECT a.page_id, a.y, a.x, CAST(floor(coalesce(u.v, 255) * (1 - (f - floor(f))) + coalesce(w.v, 255) * (f - floor(f)) + 1e-9) AS bigint) AS v
      FROM placed a LEFT JOIN st u ON u.page_id = a.page_id AND u.x = a.x AND u.y = floor(f) LEFT JOIN st w ON w.page_id = a.page_id AND w.x = a.x AND w.y = floor(f) + 1)
    SELECT p.page_id, p.y, CAST(sum(coalesce(n.v, p.v)) AS bigint) AS total, CAST(sum(coalesce(n.v, p.v) * p.x) AS bigint) AS moment, min(coalesce(n.v, p.v)) AS least FROM st p LEFT JOIN new n USING (page_id, y, x) GROUP BY 1, 2"""
)
def dewarped_staffs(spark, sf_dir):
    out = dewarp.straightened(*_bent_staffs(spark, sf_dir))
    return out.groupBy("page_id", "y").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("x")).alias("moment"), F.min("v").cast("long").alias("least"))


@query()
def transcriber_images(spark, sf_dir):
    """Canvases of 64 rows and 256 columns of the bent staffs: on smaller ones a band has no three control points, and no staff is made level. No SQL, as each has five resampled steps: tests/test_dewarp.py compares with plain code."""
    pixels, points = _bent_staffs(spark, sf_dir)
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), F.lit(10.0).alias("x1"), F.lit(2.0).alias("y1"), F.lit(240.0).alias("x2"), F.lit(46.0).alias("y2"), F.lit(4.0).alias("unit"))
    out = dewarp.staff_images(pixels, points, own, 64, 256)
    return out.groupBy("page_id", "y").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("x")).alias("moment"))


@query()
def clef_anchors(spark, sf_dir):
    """No SQL for the choice of peaks; tests/test_raw_staffs.py has plain code."""
    clefs, pixels, sizes = _clef_pages(spark, sf_dir)
    return staffs.anchors_from_clefs(clefs, pixels, sizes)


def _clef_pages(spark, sf_dir):
    """(clefs, mask, sizes): pages of 130 by 120 with three staffs of five lines, in noise; clefs stand on some of them."""
    rows = dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id")), "page_id", 130 * 120)
    page, y, x = F.col("page_id"), F.col("y"), F.col("x")
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    line = (y - 10 - page % 7 - F.floor(x / 40)) % 40
    pixels = rows.withColumn("y", side(120)).withColumn("x", side(130)).withColumn("v", ((line % 5 == 0) & (line >= 0) & (line < 25) | ((page * 31 + y * y * 17 + x * 7 + x * y * 3) % 11 == 0)).cast("int"))
    clefs = rows.withColumn("k", side(3)).filter("(page_id + k) % 3 > 0")
    k = F.col("k")
    clefs = clefs.select("page_id", (page * 10 + k).alias("symbol_id"), (15.0 + k * 12 + page % 5 * 9).alias("cx"), (20.0 + page % 7 + 40 * k).alias("cy"), F.lit(14.0).alias("w"), F.lit(24.0).alias("h"), (page % 9 - 4).cast("double").alias("angle"), (4.0 + k).alias("unit"))
    return clefs, pixels, rows.select("page_id", F.lit(130).cast("long").alias("width"), F.lit(120).cast("long").alias("height"))


# ---- staffs of fragments: four tracks of five lines on each page, with gaps where no item fell


def _tracks(spark, sf_dir):
    """(fragments, anchors, zones): 16 stretches of each line; an anchor stands where all five lines of a track are."""
    li = table(spark, sf_dir, "lineitem")
    spots = li.groupBy(F.floor(F.col("l_orderkey") / 100).alias("page_id"), (F.col("l_suppkey") % 4).alias("track"), (F.col("l_linenumber") % 5).cast("long").alias("line_no"), (F.col("l_partkey") % 16).alias("part")).agg(F.min("l_quantity").alias("q"), F.min("l_orderkey").alias("o"))
    track, line, part = F.col("track"), F.col("line_no"), F.col("part")
    spots = spots.withColumn("fragment_id", (track * 5 + line) * 16 + part)
    fragments = spots.select("page_id", "fragment_id", (50.0 + 100 * part).alias("cx"), (100.0 + 300 * track + 20 * line + F.col("o") % 3).alias("cy"), (60.0 + F.col("q")).alias("w"), F.lit(3.0).alias("h"), (F.col("o") % 5 - 2).cast("double").alias("angle"))
    five = spots.groupBy("page_id", "track", "part").agg(F.count(F.lit(1)).alias("n")).filter("n = 5").select("page_id", "track", "part", (part * 4 + track).alias("anchor_id"))
    anchors = spots.join(by_key(five), ["page_id", "track", "part"]).select("page_id", "anchor_id", "line_no", "fragment_id")
    zones = five.select("page_id", "anchor_id", (300.0 * track + 20).alias("low"), (300.0 * track + 260).alias("high"), F.lit(20.0).alias("unit"), (50.0 + 100 * part).alias("x"))
    return fragments, anchors, zones


@query()
def joined_staffs(spark, sf_dir):
    """No SQL: which staff an anchor joins depends on those before it; tests/test_raw_staffs.py has plain code."""
    fragments, anchors, zones = _tracks(spark, sf_dir)
    lines = materialize(raw_staffs.connected_lines(anchors, zones, fragments), "connected")
    joined = raw_staffs.joined_anchors(anchors, lines)
    extents = raw_staffs.staff_extents(raw_staffs.staff_lines(joined, lines), fragments)
    return joined.groupBy("page_id", "staff_id").agg(F.count(F.lit(1)).alias("n_anchors")).join(by_key(extents), ["page_id", "staff_id"])


@query()
def resampled_staffs(spark, sf_dir):
    """No SQL, as each point depends on the accepted one before it; tests/test_raw_staffs.py has plain code."""
    fragments, anchors, zones = _tracks(spark, sf_dir)
    lines = materialize(raw_staffs.connected_lines(anchors, zones, fragments), "connected")
    joined = raw_staffs.joined_anchors(anchors, lines)
    own = anchors.join(by_key(fragments), ["page_id", "fragment_id"]).join(by_key(zones.select("page_id", "anchor_id", "x", "unit")), ["page_id", "anchor_id"])
    at = (F.col("x") - F.col("cx")) * F.tan(F.radians("angle")) + F.col("cy")
    seeds = own.groupBy("page_id", "anchor_id", "x", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", at.alias("y")))), lambda p: p["y"]).alias("seed"))
    out = raw_staffs.resampled(seeds.join(by_key(joined), ["page_id", "anchor_id"]), raw_staffs.staff_lines(joined, lines), fragments)
    return out.select("page_id", "staff_id", "anchor_id", "side", "ord", "x", *(F.round(F.get("y", F.lit(i)), 6).alias(f"y{i}") for i in range(5)), F.round("angle", 6).alias("angle"))


# ---- a decoder's steps


@query(
    """WITH e AS (SELECT vec_id, unnest(embedding) AS logit, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), l AS (SELECT vec_id, k // 8 AS step, k % 8 AS token, logit FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, step ORDER BY logit DESC, token) AS r, count(*) OVER (PARTITION BY vec_id, step) AS n FROM l),
    t AS (SELECT *, row_number() OVER (PARTITION BY vec_id, step ORDER BY CAST(token = 3 OR r > 6 AS int), r) AS b FROM r WHERE r <= ceil(0.3 * n)),
    c AS (SELECT vec_id, step, token, max(CAST(token = 0 AS int)) OVER (PARTITION BY vec_id ORDER BY step) AS ended FROM t WHERE b = 1) SELECT vec_id AS staff_id, step, token FROM c WHERE ended = 0"""
)
def generated_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("staff_id"), F.posexplode("embedding").alias("k", "logit"))
    token = F.col("k") % 8
    return ranking.generated(e.select("staff_id", F.floor(F.col("k") / 8).alias("step"), token.cast("long").alias("token"), "logit", (token != 3).alias("allowed")))


RHYTHMS, PITCHES, LIFTS = ["note-quarter", "clef-G2", "[EOS]", "|", "note-half", "clef-F4", "rest-quarter", "[PAD]"], ["note-C4", "note-E4", "note-G4", "nonote"], ["lift_null", "lift_#", "lift_b", "nonote"]


def _logits(spark, sf_dir):
    """Steps of three heads from the numbers of embeddings: four of each vector, and eight vectors to a staff."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    place = F.col("k") % 16
    head = F.when(place < 8, "rhythm").when(place < 12, "pitch").otherwise("lift")
    names = F.array(*map(F.lit, RHYTHMS + PITCHES + LIFTS))
    step = (F.col("vec_id") % 8) * 4 + F.floor(F.col("k") / 16)
    return e.select(F.floor(F.col("vec_id") / 8).alias("staff_id"), step.alias("step"), head.alias("head"), place.cast("long").alias("index"), F.get(names, place).alias("token"), (F.col("x").cast("double") * 8).alias("logit"))


@query(
    f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE * 8 AS logit, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
    l AS (SELECT vec_id // 8 AS staff_id, vec_id % 8 * 4 + k // 16 AS step, k % 16 AS place, CASE WHEN k % 16 < 8 THEN 'rhythm' WHEN k % 16 < 12 THEN 'pitch' ELSE 'lift' END AS head, {RHYTHMS + PITCHES + LIFTS}[k % 16 + 1] AS token, logit FROM e),
    top AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY staff_id, step, head ORDER BY logit DESC, place) <= ceil(0.3 * count(*) OVER (PARTITION BY staff_id, step, head))),
    d AS (SELECT *, logit / pow(3.5, a) - ln(-ln((('0x' || substr(sha256(concat_ws(',', 0, staff_id, step, a, head, place)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)) AS score FROM top, range(5) r(a)),
    t AS (SELECT staff_id, step, a, arg_max(token, score) FILTER (head = 'rhythm') AS rhythm, arg_max(token, score) FILTER (head = 'pitch') AS pitch, arg_max(token, score) FILTER (head = 'lift') AS lift FROM d GROUP BY 1, 2, 3),
    o AS (SELECT *, coalesce(first_value(CASE WHEN a = 0 AND rhythm NOT IN ('[EOS]', '[BOS]', '[PAD]') THEN rhythm END IGNORE NULLS) OVER (PARTITION BY staff_id ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = '|', false) AS spoilt FROM t),
    c0 AS (SELECT staff_id, step, arg_min(rhythm, CASE WHEN spoilt AND rhythm = '|' THEN a + 10 ELSE a END) AS r FROM o GROUP BY 1, 2),
    c AS (SELECT staff_id, step, first_value(CASE WHEN r LIKE '%clef%' THEN r END IGNORE NULLS) OVER (PARTITION BY staff_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clef FROM c0),
    f AS (SELECT o.*, (spoilt AND rhythm = '|') OR (rhythm LIKE '%clef%' AND coalesce(rhythm <> clef, false)) AS refused FROM o JOIN c USING (staff_id, step)),
    p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY staff_id, step ORDER BY refused, CASE WHEN refused THEN -a ELSE a END) = 1),
    n AS (SELECT *, max(CAST(rhythm = '[EOS]' AS int)) OVER (PARTITION BY staff_id ORDER BY step) AS ended FROM p)
    SELECT staff_id, step, CAST(a AS int) AS attempt, rhythm, pitch, lift, NOT refused AND NOT spoilt AND rhythm NOT IN ('[EOS]', '[BOS]', '[PAD]') AS merged FROM n WHERE ended = 0"""
)
def sampled_tokens(spark, sf_dir):
    return sampling.accepted(sampling.draws(_logits(spark, sf_dir)))


# ---- jobs


@query(
    """WITH j AS (SELECT user_id AS doc_id, event_id AS file_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS page_no FROM events)
    SELECT doc_id, CAST(page_no AS int) AS page_no, file_id, page_no = 0 AS is_first_page, value FROM j"""
)
def ordered_pages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    files = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id")))
    orders = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.transform(files, lambda x: x["event_id"]).alias("file_ids"))
    found = document.pages_in_order(orders, e.select(F.col("event_id").alias("file_id"), "value"))
    first = jobs.submitted_jobs(orders).select("doc_id", "page_no", "is_first_page")
    return found.join(first, ["doc_id", "page_no"]).select("doc_id", "page_no", "file_id", "is_first_page", "value")
