"""Operators against plain code."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import grouping, raster, rules, spatial, staffs
from scorelake.sources import jobs
from scorelake.streaming import streams


def test_components_do_not_depend_on_the_order_of_edges(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        parent[b] = a
    want = {x: top(x) for e in edges if e[0] != e[1] for x in e}
    for some in (edges, [(v, u) for u, v in reversed(edges)]):
        out = grouping.components(spark.createDataFrame(some, "u long, v long"))
        assert {r.node: r.root for r in out.collect()} == want


def test_a_chain_of_thousand(spark):
    out = grouping.components(spark.createDataFrame([(k, k + 1) for k in range(1000)], "u long, v long"))
    assert out.filter("root = 0").count() == 1001


def test_no_edges(spark):
    assert grouping.components(spark.createDataFrame([], "u long, v long")).count() == 0


def spec_alters(rows):
    """The accidental rules in plain code."""
    out, fifths, held = {}, 0, {}
    for seq, kind, f, step, octave, alter in rows:
        if kind in ("barline", "clef"):
            held = {}
            fifths = f if kind == "clef" else fifths
        elif kind == "note":
            if alter is not None:
                held[step, octave] = alter
            order = "FCGDAEB"[:fifths] if fifths > 0 else "BEADGCF"[:-fifths] if fifths < 0 else ""
            out[seq] = held.get((step, octave), (1 if fifths > 0 else -1) if step in order else None)
    return out


def random_stream(seed, n=200):
    rng, rows = random.Random(seed), []
    for k in range(n):
        kind = rng.choice(["note"] * 6 + ["barline", "clef", "rest"])
        rows.append((k, kind, rng.randint(-7, 7) if kind == "clef" else None, *((rng.choice("CDEFGAB"), rng.randint(3, 5), rng.choice([None, None, -1, 0, 1])) if kind == "note" else (None, None, None))))
    return rows


SYMBOLS = "staff_id long, seq int, kind string, fifths int, step string, octave int, alter int"


@pytest.mark.parametrize("seed", [1, 2])
def test_sounding_alters(spark, seed):
    rows = random_stream(seed)
    df = spark.createDataFrame([(1, *r) for r in rows], SYMBOLS)
    out = rules.with_sounding_alters(df).filter("kind = 'note'").collect()
    assert {r.seq: r.alter_out for r in out} == spec_alters(rows)


def test_sounding_alters_of_a_stream(spark, tmp_path):
    rows = random_stream(5)
    df = spark.createDataFrame([(1, *r) for r in rows], SYMBOLS)
    df.filter("seq < 90").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.filter("seq >= 90").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = streams.sounding_alters(source, forget=False).writeStream.format("memory").queryName("alters").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.seq: r.alter_out for r in spark.table("alters").collect()}
    assert got == spec_alters(rows)


def test_pages_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pgm").write_bytes(b"P5 2 1 255\n\x01\x02")
    query = streams.pages_once(spark, str(tmp_path / "in"), delete=False).writeStream.format("memory").queryName("pages").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    images = raster.decoded_images(spark.table("pages").select(F.lit(1).cast("long").alias("page_id"), "content"))
    row = images.first()
    assert (row.h, row.w, row.c, bytes(row.content)) == (1, 2, 1, b"\x01\x02")


def random_boxes(seed, n=120):
    rng = random.Random(seed)
    return [(rng.randint(0, 1), k, float(x := rng.randint(-50, 700)), float(y := rng.randint(-50, 700)), float(x + rng.randint(0, 150)), float(y + rng.randint(0, 150))) for k in range(n)]


def test_box_candidates(spark):
    rows = random_boxes(1)
    df = spark.createDataFrame(rows, "page_id long, box_id long, x1 double, y1 double, x2 double, y2 double")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]}
    out = spatial.box_candidates(df, df, 60.0).collect()
    assert len(out) == len(want) and {(r.a, r.b) for r in out} == want


def test_crossing_bars_intersect_but_do_not_overlap(spark):
    df = spark.createDataFrame([(1, 1, 50.0, 50.0, 100.0, 4.0, 0.0), (1, 2, 50.0, 50.0, 100.0, 4.0, 90.0), (1, 3, 90.0, 50.0, 40.0, 2.0, 0.0)], "page_id long, box_id long, cx double, cy double, w double, h double, angle double")
    df = df.withColumn("polygon", spatial.turned_corners(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle"))))
    df = df.withColumns({"x1": F.array_min(F.transform("polygon", lambda p: p["x"])), "x2": F.array_max(F.transform("polygon", lambda p: p["x"])), "y1": F.array_min(F.transform("polygon", lambda p: p["y"])), "y2": F.array_max(F.transform("polygon", lambda p: p["y"]))})
    pairs = lambda test: {(r.a, r.b) for r in spatial.overlapping(df, df, test).filter("a < b").collect()}
    assert pairs(spatial.polygons_overlap) == {(1, 3)}
    assert pairs(spatial.polygons_intersect) == {(1, 2), (1, 3)}


def test_on_staffs(spark):
    grid = spark.createDataFrame([(1, s, float(x), [y + 10.0 * k for k in range(5)]) for s, y in ((1, 100), (2, 180)) for x in range(0, 200, 10)], "page_id long, staff_id long, x double, y array<double>")
    units = spatial.staff_units(grid)
    points = grid.join(units.select("staff_id", "unit"), "staff_id").select("page_id", "staff_id", "x", "y", "unit")
    items = spark.createDataFrame([(1, 1, 55.0, 120.0), (1, 2, 55.0, 160.0), (1, 3, 400.0, 120.0)], "page_id long, symbol_id long, x double, cy double")
    out = {(r.symbol_id, r.staff_id) for r in spatial.on_staffs(items, points, units).collect()}
    assert out == {(1, 1), (2, 1), (2, 2)}
    near = spatial.nearest_staff(items.withColumnRenamed("symbol_id", "item_id"), grid)
    assert {r.item_id: (r.staff_id, r.distance) for r in near.collect()} == {1: (1, 0.0), 2: (1, 20.0), 3: (1, 1e10)}


def test_chords(spark):
    rows = [(1, 1, 0, 10.0, None), (1, 1, 1, 18.0, None), (1, 1, 2, 26.0, None), (1, 1, 3, 90.0, 95.0), (1, 1, 4, 70.0, 97.0)]
    out = grouping.chords(spark.createDataFrame(rows, "page_id long, staff_id long, ord long, cx double, stem_x double"))
    assert [r.group for r in out.orderBy("ord").collect()] == [0, 0, 0, 1, 1]


def test_merged_multi_staffs(spark):
    rows = [(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 1, 4), (1, 2, 2), (1, 2, 3)]
    out = grouping.merged_multi_staffs(spark.createDataFrame(rows, "page_id long, multi long, staff long"))
    assert {(r.multi, r.staff) for r in out.collect()} == {(0, 1), (0, 2), (0, 3), (1, 3), (1, 4)}


def five_lines():
    rows, k = [], 0
    for line in range(5):
        for x in (50, 155, 260):
            rows.append((1, k, float(x), 100.0 + 20 * line, 100.0, 2.0, 0.0))
            k += 1
    return rows


def test_anchors(spark):
    fragments = spark.createDataFrame(five_lines(), "page_id long, fragment_id long, cx double, cy double, w double, h double, angle double")
    symbols = spark.createDataFrame([(1, 7, False, 150.0, 140.0, 4.0, 100.0), (1, 8, False, 150.0, 700.0, 4.0, 100.0)], "page_id long, symbol_id long, is_clef boolean, cx double, cy double, w double, h double")
    out = staffs.anchors(symbols, fragments).collect()
    assert {r.symbol_id for r in out} == {7} and {r.line_no for r in out} == set(range(5))


def test_chained_lines(spark):
    fragments = spark.createDataFrame([(*r, 20.0) for r in five_lines()], "page_id long, fragment_id long, cx double, cy double, w double, h double, angle double, unit double")
    out = staffs.chained_lines(fragments.withColumn("anchor_id", F.lit(1).cast("long"))).collect()
    assert Counter(r.line_no for r in out) == {k: 3 for k in range(5)}


def test_profile_peaks_and_filled_lines(spark):
    profile = spark.createDataFrame([(1, y, 50 if y in (10, 20, 30, 40, 50) else 0) for y in range(60)], "page_id long, y long, n long")
    assert [r.y for r in staffs.profile_peaks(profile, 5.0).orderBy("y").collect()] == [10, 20, 30, 40, 50]
    points = spark.createDataFrame([(1, [None, 120.0, None, 160.0, None], 20.0), (2, [None] * 5, 20.0)], "id int, y array<double>, unit double")
    out = staffs.filled_lines(points).collect()
    assert [list(r.y) for r in out] == [[100.0, 120.0, 140.0, 160.0, 180.0]]


def pixels(spark, *images):
    rows = [(page, y, x, int(v)) for page, a in enumerate(images) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "page_id long, y long, x long, v long").repartition(3)


def image(df, page):
    rows = df.filter(F.col("page_id") == page).collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), int)
    for r in rows:
        out[r.y, r.x] = r.v
    return out


def plain_regions(mask):
    """Regions of eight neighbours by flooding."""
    left, found = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        todo, some = [left.pop()], []
        while todo:
            y, x = todo.pop()
            some.append((y, x))
            for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
        ys, xs = zip(*some, strict=True)
        found.append((min(xs), min(ys), max(xs), max(ys), len(some)))
    return sorted(found)


def test_regions_of_masks(spark):
    rng = np.random.default_rng(4)
    masks = [(rng.random((40, 150)) < share).astype(int) for share in (0.15, 0.4)]
    df = pixels(spark, *masks)
    out = raster.region_extents(raster.regions(df)).collect()
    for page, mask in enumerate(masks):
        assert sorted((r.x1, r.y1, r.x2, r.y2, r.area) for r in out if r.page_id == page) == plain_regions(mask)
    assert raster.regions(df.filter("v > 5")).count() == 0


def test_masks_to_boxes(spark):
    mask = np.zeros((20, 30), np.uint8)
    mask[2:6, 3:13] = 1
    mask[10:15, 20:22] = 1
    found = raster.regions(pixels(spark, mask))
    assert sorted((r.cx, r.cy, r.w, r.h) for r in raster.region_boxes(found).collect()) == [(7.5, 3.5, 9.0, 3.0), (20.5, 12.0, 1.0, 4.0)]
    assert raster.region_boxes(found, (2, 2)).count() == 1
    # what was joined is refitted as one
    one = raster.region_boxes(found.withColumn("region", F.lit(1))).first()
    assert one.w * one.h < 18 * 12 and one.w * one.h >= 9 * 3


def test_pixel_operators(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (12, 9))
    df = pixels(spark, a)
    for h, w in ((3, 3), (2, 1), (5, 3), (1, 4)):
        around = lambda y, x: a[max(0, y - h // 2) : y + h - h // 2, max(0, x - w // 2) : x + w - w // 2]  # noqa: B023, E731
        assert (image(raster.dilated(df, h, w), 0) == [[around(y, x).max() for x in range(9)] for y in range(12)]).all()
        assert (image(raster.eroded(df, h, w), 0) == [[around(y, x).min() for x in range(9)] for y in range(12)]).all()
    page, small = np.full((100, 100), 60), np.full((60, 60), 220)
    page[10:90, 15:95] = 220
    small[0:30, :] = 10
    cropped = raster.autocropped(pixels(spark, page, small))
    assert abs(image(cropped, 0).shape[0] - 80) <= 10 and image(cropped, 0).min() == 220
    edge, inner = np.full((40, 40), 255), np.full((40, 40), 255)
    edge[0:20, 0:20] = 0
    inner[5:20, 5:20] = 0
    out = raster.without_dark_edges(pixels(spark, edge, inner), 5)
    assert image(out, 0).min() == 255 and (image(out, 1) == inner).all()


def test_kernels():
    cx, cy, w, h, angle = raster.least_rectangle(np.array([(0, 0), (10, 10), (12, 8), (2, -2)]))
    assert sorted([round(w, 3), round(h, 3)]) == [2.828, 14.142]


def test_job_status(spark):
    rows = [(1, "finished"), (1, "finished"), (2, "finished"), (2, "queued"), (3, "failed"), (3, "queued")]
    out = jobs.order_status(spark.createDataFrame(rows, "doc_id long, status string"))
    assert {r.doc_id: r.status for r in out.collect()} == {1: "finished", 2: "running", 3: "failed"}


def test_safe_members(spark):
    names = spark.createDataFrame([("a/b.bin",), ("/etc/x",), ("a/../../x",)], "name string")
    assert [r.name for r in jobs.safe_members(names).collect()] == ["a/b.bin"]


def test_semantic_lines(spark, tmp_path):
    (tmp_path / "Corpus").mkdir()
    (tmp_path / "Corpus/a.semantic").write_text("clef-G2 note-C4_quarter\n")
    row = jobs.semantic_lines(spark, str(tmp_path / "Corpus")).first()
    assert row.keyed and row.tokens.startswith("clef-G2")


def test_shared_folder_setting(spark):
    from scorelake.sources.tables import materialize

    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and spark.conf.get("spark.checkpoint.dir")


def test_scratch_tables_are_deleted(spark, tmp_path):
    import os

    from scorelake.sources.tables import materialize, scratch, shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scratch(spark):
        materialize(spark.range(5), "gone").write.parquet(str(tmp_path / "kept"))
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before and spark.read.parquet(str(tmp_path / "kept")).count() == 5


def test_pages_keep_all_symbols_of_uneven_voices(spark, tmp_path):
    """A hot user, and users with few events, in the same documents."""
    from scorelake.plans import catalog

    sizes = {10: 3000, 11: 5, 12: 300, 13: 1, 20: 170, 21: 90, 30: 7}
    rows = [(u, k, ["purchase", "view", "error", "click", "signup"][(k * 7 + u) % 5 if k % 50 else 4], float(k * 13 % 997) / 4) for u, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "user_id long, k long, event_type string, value double").withColumn("event_id", F.col("user_id") * 10_000 + F.col("k"))
    df.withColumn("ts", F.timestamp_seconds("k")).write.parquet(f"{tmp_path}/events.parquet")
    pages = catalog._pages(spark, tmp_path)
    assert Counter((10 * r.doc_id + r.voice) for r in pages.collect()) == Counter(sizes)
    each = pages.groupBy("doc_id", "page_no").agg(F.count_distinct("voice").alias("n")).collect()
    assert {(r.doc_id, r.n) for r in each} == {(1, 4), (2, 2), (3, 1)}
    assert {d: sum(r.doc_id == d for r in each) for d in (1, 2, 3)} == {1: 1, 2: 5, 3: 1}
    assert pages.filter("new_page").select("doc_id", "page_no").distinct().count() == 4
    sounding = F.col("kind").isin("note", "rest")
    want = Counter((r.staff_id, r.kind) for r in catalog.symbols(spark, tmp_path).filter(sounding).collect())
    assert Counter((10 * r.doc_id + r.voice, r.kind) for r in catalog.page_assembly(spark, tmp_path).filter(sounding).collect()) == want
    texts = {r.doc_id: r.xml for r in catalog.musicxml_text(spark, tmp_path).collect()}
    assert {d: x.count("<note>") for d, x in texts.items()} == {d: sum(n for (u, _), n in want.items() if u // 10 == d) for d in texts}
