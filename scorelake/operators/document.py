"""Assembly of pages into documents, and MusicXML."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions import music
from scorelake.operators import rules
from scorelake.sources.tables import materialize

#: Fixed value: the first line of a document.
DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>'


def voices_of_first_page(symbols: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Only voices that the first page has; a later page with fewer voices is an error that fails the query."""
    w = Window.partitionBy(doc)
    voices = symbols.groupBy(doc, "page_no").agg(F.max("voice").alias("top"))
    voices = voices.withColumn("_first", F.min_by("top", "page_no").over(w))
    checked = voices.withColumn("_ok", F.assert_true(F.col("top") >= F.col("_first"), F.lit("a page has fewer voices than the first")))
    kept = checked.filter("_ok is null").select(doc, "page_no", "_first")
    return symbols.join(kept, [doc, "page_no"]).filter("voice <= _first").drop("_first")


def in_document_order(symbols: DataFrame, keys=("doc_id", "voice"), order=("page_no", "system_no", "seq")) -> DataFrame:
    """seq over all pages and systems of a voice."""
    return symbols.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def merged_and_cleaned(symbols: DataFrame, keys=("doc_id", "voice"), single_voice: bool = False) -> DataFrame:
    """One clean stream for each voice: the dominant clef (with a single voice), the dominant key, no redundant clefs, one time signature, no empty measures."""
    if single_voice:
        symbols = rules.with_dominant_clef(symbols, keys)
    symbols = rules.with_dominant_key(symbols, keys)
    symbols = rules.first_time_signature_only(rules.without_redundant_clefs(symbols, keys), keys)
    return rules.without_empty_measures(symbols, ("page_no", "system_no", "measure_no"), keys)


def assembled(symbols: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pages of symbols as one stream for each voice of a document.

    Accidentals are resolved on each page first and not again: a key that the merge changes alters no notes.
    """
    page = (doc, "page_no", "voice")
    symbols = rules.with_sounding_alters(in_document_order(symbols, page, ("system_no", "seq")), page)
    symbols = symbols.withColumn("alter", F.when(F.col("kind") == "note", F.col("alter_out")).otherwise(F.col("alter"))).drop("alter_out", "carried", "key", "clef_no")
    # read three times: for the voices of pages, for the dominant keys and for the symbols themselves
    symbols = materialize(in_document_order(symbols, (doc, "voice")), "symbols-of-pages")
    return in_document_order(merged_and_cleaned(voices_of_first_page(symbols, doc), (doc, "voice")), (doc, "voice"))


def pages_in_order(order: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages by the order of their files; a file without a page fails the query. order: doc_id, file_ids (array)."""
    wanted = order.select("doc_id", F.posexplode("file_ids").alias("page_no", "file_id"))
    found = wanted.join(pages.withColumn("_there", F.lit(True)), "file_id", "left")
    return found.withColumn("_ok", F.assert_true(F.col("_there").isNotNull(), F.lit("a page is missing"))).filter("_ok is null").drop("_there", "_ok")


def _note(n):
    pitch = F.struct(n["step"].alias("step"), F.coalesce(n["alter"], F.lit(0)).alias("alter"), n["octave"].alias("octave"))
    rest = n["kind"] == "rest"
    chord = F.when(n["chord_pos"] > 0, F.lit(""))
    dot = F.when(n["modifier"] == "dot", F.lit(""))
    triplet = F.when(n["modifier"] == "triplet", F.struct(F.lit(3).alias("actual-notes"), F.lit(2).alias("normal-notes")))
    return F.struct(
        F.when(~rest, chord).alias("chord"),
        F.when(rest, F.struct(F.lit("yes").alias("_measure"))).alias("rest"),
        F.when(~rest, pitch).alias("pitch"),
        n["ticks"].alias("duration"),
        F.when(~rest, F.lit("1")).alias("voice"),
        music.duration_name(n["base"]).alias("type"),
        dot.alias("dot"),
        triplet.alias("time-modification"),
        F.lit(1).alias("staff"),
    )


def measures(symbols: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, voice, number, attributes, print, note): one row for each measure, nested for XML.

    A clef or time signature is written if it is the first, starts a system or changes; a new page wins over
    a new system, which the first measure doesn't tell.
    """
    keys = (doc, "voice")
    place = ("page_no", "system_no", "measure_no")
    for kind, values in (("clef", ("sign", "fifths")), ("time", ("num", "den"))):
        own = symbols.withColumn("_own", F.col("kind") == kind)
        symbols = rules.with_emitted_attributes(own, values, "new_line", (*keys, "_own")).filter("emit or not _own").drop("emit", "_own")
    symbols = symbols.filter("kind <> 'barline'")
    row = F.struct("seq", "chord_pos", "kind", "step", "octave", "alter", "base", "modifier", "ticks")
    clef = F.struct(F.col("sign").alias("sign"), music.clef_line(F.col("sign")).alias("line"))
    grouped = symbols.groupBy(*keys, *place).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind").isin("note", "rest"), row))).alias("rows"),
        F.max_by(F.when(F.col("kind") == "clef", clef), F.when(F.col("kind") == "clef", F.col("seq"))).alias("clef"),
        F.max_by(F.when(F.col("kind") == "clef", F.col("fifths")), F.when(F.col("kind") == "clef", F.col("seq"))).alias("fifths"),
        F.max_by(F.struct(F.col("num").alias("beats"), F.col("den").alias("beat-type")), F.when(F.col("kind") == "time", F.col("seq"))).alias("time"),
        F.max("new_line").alias("new_line"),
        F.max("new_page").alias("new_page"),
    )
    numbered = rules.numbered_measures(grouped, keys, place)
    first = F.col("number") == 1
    has = F.col("clef").isNotNull() | F.col("time").isNotNull()
    attributes = F.when(first | has, F.struct(F.when(first, F.lit(music.QUARTER)).alias("divisions"), F.when(F.col("fifths").isNotNull(), F.struct(F.col("fifths").alias("fifths"))).alias("key"), F.col("time"), F.col("clef")))
    page_break = F.when(F.col("new_page"), F.struct(F.lit("yes").alias("_new-page"), F.lit(None).cast("string").alias("_new-system")))
    system_break = F.when(F.col("new_line") & ~first, F.struct(F.lit(None).cast("string").alias("_new-page"), F.lit("yes").alias("_new-system")))
    return numbered.select(*keys, "number", F.coalesce(page_break, system_break).alias("print"), attributes.alias("attributes"), F.transform("rows", _note).alias("note"))


def music_xml(symbols: DataFrame, doc: str = "doc_id", title: str = "Title") -> DataFrame:
    """(doc, xml): one MusicXML text for each document, a part for each voice."""
    each = measures(symbols, doc)
    measure = F.struct(F.col("number").cast("string").alias("_number"), "print", "attributes", "note")
    parts = each.groupBy(doc, "voice").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", measure.alias("m")))), lambda x: x["m"]).alias("measure"))
    part = F.struct(music.part_id(F.col("voice")).alias("_id"), "measure")
    tree = parts.groupBy(doc).agg(F.transform(F.array_sort(F.collect_list(F.struct("voice", part.alias("p")))), lambda x: x["p"]).alias("part"))
    score_part = lambda p: F.struct(
        p["_id"].alias("_id"),
        F.lit("Piano").alias("part-name"),
        F.struct(F.concat(p["_id"], F.lit("-I1")).alias("_id"), F.lit("Piano").alias("instrument-name")).alias("score-instrument"),
        F.struct(F.concat(p["_id"], F.lit("-I1")).alias("_id"), F.lit(1).alias("midi-channel"), F.lit(1).alias("midi-program"), F.lit(100).alias("volume"), F.lit(0).alias("pan")).alias("midi-instrument"),
    )
    root = F.struct(
        F.lit("4.0").alias("_version"),
        F.struct(F.lit(title).alias("work-title")).alias("work"),
        F.struct(F.transform("part", score_part).alias("score-part")).alias("part-list"),
        F.col("part"),
    )
    return tree.select(doc, F.concat(F.lit(DECLARATION + "\n"), F.to_xml(root, {"rowTag": "score-partwise"})).alias("xml"))


def write_documents(documents: DataFrame, path: str, doc: str = "doc_id") -> None:
    """One folder for each document, with its text file."""
    documents.select(doc, F.col("xml").alias("value")).write.partitionBy(doc).text(path)
