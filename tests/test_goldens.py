"""Small cases worked out by hand."""

from pyspark.sql import functions as F

from scorelake.functions import geometry, music, tokens
from scorelake.operators import codec, ranking, rules, staffs


def parsed(spark, text):
    return codec.parse(spark.createDataFrame([(1, text)], "staff_id long, tokens string"))


def alters(spark, text):
    out = rules.with_sounding_alters(parsed(spark, text).drop("measure_no")).filter("kind = 'note'").orderBy("seq", "chord_pos")
    return [(r.measure_no, r.alter_out) for r in out.collect()]


G1 = "clef-G2+keySignature-DM+timeSignature-/4+note-C4_quarter+note-C4b_quarter+note-C4_quarter+barline+note-C4_quarter+rest-half."


def test_key_and_carried_accidentals(spark):
    assert alters(spark, G1) == [(0, 1), (0, -1), (0, -1), (1, 1)]
    first = parsed(spark, G1).filter("kind = 'clef'").first()
    assert (first.sign, first.fifths) == ("G", 2)
    lengths = [r.length for r in rules.measure_lengths(parsed(spark, G1).drop("measure_no")).orderBy("measure_no").collect()]
    assert lengths == [48, 64]
    time = rules.with_filled_time_signatures(parsed(spark, G1).drop("measure_no")).filter("kind = 'time'").first()
    assert (time.num, time.den) == (4, 4)


def test_natural_is_carried_until_the_barline(spark):
    text = "clef-F4+keySignature-FM+note-B2_eighth+note-B2N_eighth+note-B2_eighth+barline+note-B2_eighth"
    assert alters(spark, text) == [(0, -1), (0, 0), (0, 0), (1, -1)]
    assert {r.ticks for r in parsed(spark, text).filter("kind = 'note'").collect()} == {8}


def test_chord_takes_the_shortest(spark):
    rows = parsed(spark, "note-C4_quarter|note-E4#_eighth|rest-sixteenth").orderBy("chord_pos").collect()
    assert [(r.step, r.octave, r.alter, r.note_ticks, r.ticks) for r in rows] == [("C", 4, None, 16, 4), ("E", 4, 1, 8, 4)]


def test_odd_durations_and_unreadable_notes(spark):
    assert parsed(spark, "rest-thirty_second").first().ticks == 1
    assert parsed(spark, "note-C4_thirty_second").first().note_ticks == 2
    assert parsed(spark, "note-C4_breve").first().note_ticks == 1
    bad = parsed(spark, "note-C_quarter").first()
    assert (bad.step, bad.octave, bad.alter, bad.note_ticks) == ("C", 4, 0, 16)
    assert parsed(spark, "multirest-4").count() == 0
    assert parsed(spark, "keySignature-GM+note-C4_quarter").count() == 1
    assert parsed(spark, "clef-G2+note-C4_half+keySignature-GM").filter("kind = 'clef'").first().fifths == 0


def merged(spark, *triples):
    rows = [(1, k, *t) for k, t in enumerate(triples)]
    found = codec.merge(spark.createDataFrame(rows, "staff_id long, pos int, rhythm string, pitch string, lift string")).collect()
    return found[0].tokens if found else ""


def test_merge(spark):
    n = ("nonote", "nonote")
    assert merged(spark, ("clef-G2", *n), ("note-quarter", "note-C4", "lift_null"), ("|", *n), ("note-quarter", "note-E4", "lift_#"), ("barline", *n)) == "clef-G2+note-E4#_quarter|note-C4_quarter+barline"
    assert merged(spark, ("|", *n), ("clef-G2", *n), ("note-quarter", "note-C4", "lift_null")) == ""
    assert merged(spark, ("clef-G2", *n), ("clef-F4", *n), ("barline", *n)) == "clef-G2+barline"


def test_redundant_clefs(spark):
    rows = [(1, 1, "clef", "G", 2), (1, 2, "clef", "G", 2), (1, 3, "clef", "F", 0), (1, 4, "clef", "G", 2)]
    df = spark.createDataFrame(rows, "staff_id long, seq int, kind string, sign string, fifths int")
    once = rules.without_redundant_clefs(df)
    assert sorted(r.seq for r in once.collect()) == [1, 3, 4]
    assert sorted(r.seq for r in rules.without_redundant_clefs(once).collect()) == [1, 3, 4]


def test_dominant_clef_moves_notes(spark):
    rows = [(1, 1, "clef", "F", 0, None, None), (1, 2, "clef", "F", 0, None, None), (1, 3, "clef", "G", 0, None, None), (1, 4, "note", None, None, "A", 4)]
    df = spark.createDataFrame(rows, "staff_id long, seq int, kind string, sign string, fifths int, step string, octave int")
    out = {r.seq: r for r in rules.with_dominant_clef(df).collect()}
    assert {out[k].sign for k in (1, 2, 3)} == {"F"}
    assert (out[4].step, out[4].octave) == ("C", 2)


def test_multiset_distance(spark):
    of = lambda xs: spark.createDataFrame([(1, x) for x in xs], "staff_id long, token string")
    a, e = of(["C4", "C4", "D4"]), of(["C4", "E4"])
    assert ranking.multiset_distance(a, e).first().distance == 3
    assert ranking.multiset_distance(e, a).first().distance == 3
    assert ranking.multiset_distance(a, a).first().distance == 0


def test_printed_accidentals(spark):
    df = spark.createDataFrame([(1, "keySignature-DM+note-C4#_quarter+note-C4b_quarter+note-C4b_quarter")], "staff_id long, tokens string")
    out = codec.with_accidentals(df).first().tokens
    assert out == "keySignature-DM+note-C4_quarter+note-C4b_quarter+note-C4_quarter"


def test_split(spark):
    text = "clef-G2 keySignature-DM timeSignature-3/4 note-C4#_quarter|note-E4_half barline rest-whole3"
    rows = codec.split(spark.createDataFrame([(1, text)], "staff_id long, tokens string")).orderBy("pos").collect()
    assert [r.rhythm for r in rows] == ["clef-G2", "keySignature-DM", "timeSignature-/4", "note-half", "|", "note-quarter", "barline", "multirest-3"]
    assert [r.pitch for r in rows][3:6] == ["note-E4", "nonote", "note-C4"]
    assert [r.lift for r in rows][3:6] == ["lift_null", "nonote", "lift_null"]


def test_ranges_end_anew(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 10, 50), (1, 60, 70)], "page_id long, start long, stop long")
    assert [(r.start, r.stop) for r in staffs.merged_ranges(df).orderBy("zone").collect()] == [(0, 50), (60, 70)]


def test_peak_groups(spark):
    ys = [10, 20, 30, 40, 50, 100, 110, 120, 130, 140]
    df = spark.createDataFrame([(1, y) for y in ys], "page_id long, y long")
    grouped = staffs.grouped_peaks(df)
    assert [r.group for r in grouped.orderBy("y").collect()] == [0] * 5 + [1] * 5
    assert staffs.complete_groups(grouped).count() == 10


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geometry(spark):
    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    size = one(spark, geometry.target_size(F.lit(1000), F.lit(1000)).alias("s")).s
    assert (size.w, size.h) == (1917, 1917)
    for given, want in [((10, 40, 80), (40, 10, -10)), ((10, 40, 170), (10, 40, -10)), ((10, 40, -60), (40, 10, 30))]:
        assert tuple(one(spark, geometry.normal_angle(*lit(*given)).alias("a")).a) == want
    y = F.array(*lit(10, 20, 30, 40, 50))
    for cy, want in [(30, 5), (50, 1), (60, -1), (25, 6)]:
        assert one(spark, geometry.staff_position(y, F.lit(float(cy))).alias("p")).p == want
    pitch = one(spark, music.note_pitch(F.lit("G"), F.lit(1), F.lit(0)).alias("p")).p
    assert (pitch.step, pitch.octave, pitch.alter) == ("E", 4, None)


def test_rating(spark):
    df = spark.createDataFrame([(1, 0, 3, 1, 0.0, 0, 2, 3)], "staff_id long, attempt int, distance int, diff_accidentals int, measure_std double, surplus int, n_expected int, n_actual int")
    assert ranking.rated(df).first().rating == 2.0


def test_best_candidate(spark):
    schema = "staff_id long, attempt int, distance int, diff_accidentals int, measure_std double, surplus int, n_expected int, n_actual int, has_clef boolean"
    rows = [(1, 0, 5, 0, 0.0, 0, 5, 5, True), (1, 1, 5, 0, 0.0, 0, 5, 5, True), (2, 0, 0, 0, 0.0, 0, 5, 0, True), (2, 1, 9, 0, 0.0, 0, 5, 5, True), (3, 0, 1, 0, 0.0, 0, 5, 5, True), (3, 1, 9, 0, 0.0, 0, 5, 5, False), (3, 2, 0, 0, 0.0, 0, 5, 5, True)]
    best = ranking.best_candidates(spark.createDataFrame(rows, schema))
    assert {r.staff_id: r.attempt for r in best.collect()} == {1: 0, 2: 1, 3: 1}


def test_flattened_keeps_naturals(spark):
    assert one(spark, tokens.flattened(F.lit("note-C4#_quarter|note-D4N_half")).alias("t")).t == ["note-C4", "note-D4N"]
