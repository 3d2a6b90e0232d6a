"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarmill.functions import keys
from sonarmill.llm import overlap
from sonarmill.plans import oracle_keys as sql
from sonarmill.session import cut_lineage, read_table


TRAIN, HELD_OUT = 1, 2


def _sided(split: str) -> Column:
    """1 for train, 2 for validation and test, null for no split."""
    name = keys.split_name(split)
    return F.when(name == "train", TRAIN).when(name.isNotNull(), HELD_OUT)


def _both(touched: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of rows of the two sides that agree in ``by``; touched: ``row_seq, side`` and those columns."""
    a = touched.where(F.col("side") == TRAIN).select(F.col("row_seq").alias("a"), *by)
    b = touched.where(F.col("side") == HELD_OUT).select(F.col("row_seq").alias("b"), *by)
    return a.join(b, by).select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))


def side_classes(rows: DataFrame, *text: str) -> DataFrame:
    """One row for each text and side: ``record, text, n_rows``. A record's number ends in 0 for train and in 1 for held-out.

    rows: ``row_seq, side`` and the columns that make up the text; rows without any of them have none.
    """
    whole = F.concat_ws("|", *text) if len(text) > 1 else F.col(text[0])
    named = rows.select("row_seq", "side", whole.alias("text")).where("text IS NOT NULL AND trim(BOTH '|' FROM text) <> ''")
    return named.groupBy("text", "side").agg((F.min("row_seq") * 2 + F.col("side") - 1).alias("record"), F.count("*").alias("n_rows"))


def class_fractions(classes: DataFrame) -> DataFrame:
    """``(record, fraction)`` of the classes' texts that the other side has, by content-defined chunks."""
    return overlap.overlap_fractions(overlap.chunks(classes), F.pmod("record", F.lit(2)).cast("int") + 1)


def matched_contents(rows: DataFrame) -> DataFrame:
    """The contents ``sha`` that rows ``row_seq, side, sha`` of both sides have.

    Contents are cut into chunks, side by side. One that also occurs on the other side has all its chunks there, so only
    those with fraction 1 are compared as a whole.
    """
    classes = side_classes(rows.where("sha IS NOT NULL"), "sha")
    inside = class_fractions(classes).where("fraction = 1").select("record")
    full = classes.join(inside, "record").groupBy(F.col("text").alias("sha")).agg(F.bit_or((F.pmod("record", F.lit(2)) + 1).cast("int")).alias("sides"))
    return full.where("sides = 3").select("sha")


def equal_contents(rows: DataFrame) -> DataFrame:
    """Pairs of rows ``row_seq, side, sha`` of two sides with the same content."""
    return _both(cut_lineage(rows.join(matched_contents(rows), "sha").select("row_seq", "side", "sha")), ["sha"])


def near_pairs(rows: DataFrame, n_rows: int) -> DataFrame:
    """Distinct prints of the two sides that are near; rows: ``row_seq, side, hi, lo``."""
    prints = rows.where("hi IS NOT NULL").groupBy("hi", "lo").agg(F.bit_or("side").alias("sides"))
    return cut_lineage(overlap.near_prints(prints, n_rows, n_rows))


def near_contents(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs of rows ``row_seq, side, hi, lo`` of two sides whose prints are ``near``."""
    a = rows.where(F.col("side") == TRAIN).select(F.col("row_seq").alias("a"), F.col("hi").alias("left_hi"), F.col("lo").alias("left_lo"))
    b = rows.where(F.col("side") == HELD_OUT).select(F.col("row_seq").alias("b"), F.col("hi").alias("right_hi"), F.col("lo").alias("right_lo"))
    pairs = a.join(near, ["left_hi", "left_lo"]).join(b, ["right_hi", "right_lo"])
    return pairs.select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))


def sided_recordings(rows: DataFrame) -> DataFrame:
    """``row_seq, side, sha, hi, lo`` as compared; rows: ``row_seq, split, sha, print`` as stored."""
    hi, lo = overlap.print_halves("print")
    return rows.select("row_seq", _sided("split").alias("side"), keys.sha_key("sha").alias("sha"), hi.alias("hi"), lo.alias("lo")).where("side IS NOT NULL")


def recording_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of recordings ``(row_a, row_b)`` across splits; rows: ``row_seq, split, sha, print`` as stored."""
    sided = sided_recordings(rows)
    prints = sided.select("row_seq", "side", "hi", "lo")
    return equal_contents(sided.select("row_seq", "side", "sha")).unionByName(near_contents(prints, near_pairs(prints, rows.count()))).distinct()


def sided_segments(rows: DataFrame) -> DataFrame:
    """``row_seq, side, recording, index`` as compared; rows: ``row_seq, split, segment`` as stored."""
    return rows.select("row_seq", _sided("split").alias("side"), keys.segment_sha("segment").alias("recording"), keys.segment_index("segment").alias("index")).where("side IS NOT NULL")


def touching_segments(known: DataFrame) -> DataFrame:
    """``(recording, left, right)``: indexes of the two sides that share samples."""
    return overlap.shared_cells(known.select("recording", "index", (F.col("side") - 1).alias("side"))).where("fraction > 0").select("recording", "left", "right")


def _ends(pairs: DataFrame, *more: str) -> DataFrame:
    """Both ends of pairs ``recording, left, right``, each with its side."""
    return pairs.select("recording", *more, F.inline(F.array(F.struct(F.lit(TRAIN).alias("side"), F.col("left").alias("index")), F.struct(F.lit(HELD_OUT).alias("side"), F.col("right").alias("index")))))


def segment_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of segments ``(row_a, row_b)`` across splits that share samples; rows: ``row_seq, split, segment`` as stored."""
    known = sided_segments(rows)
    pairs = cut_lineage(touching_segments(known).withColumn("pair", F.xxhash64("recording", "left", "right")))
    touched = known.join(_ends(pairs, "pair"), ["recording", "index", "side"]).select("row_seq", "side", "recording", "pair")
    return _both(cut_lineage(touched), ["recording", "pair"])


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "combined_manifest").select("row_seq", "split", F.col("sha256").alias("sha"), F.col("audio_print").alias("print"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "train_shard_manifest").select("row_seq", "split", F.col("segment_id").alias("segment"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    recordings, segments = recording_pairs(_recordings(spark, d)), segment_pairs(_segments(spark, d))
    return recordings.select(F.lit("combined_manifest").alias("table_name"), "row_a", "row_b").unionByName(segments.select(F.lit("train_shard_manifest").alias("table_name"), "row_a", "row_b"))


def touched_rows(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """``(table_name, row_seq)`` of the rows that overlap with the other side, from classes: pairs of rows are never made."""
    known = sided_recordings(recordings)
    same = known.join(matched_contents(known.select("row_seq", "side", "sha")), "sha", "left_semi").select("row_seq")
    near = near_pairs(known.select("row_seq", "side", "hi", "lo"), recordings.count())
    ends = near.select(F.inline(F.array(F.struct(F.lit(TRAIN).alias("side"), F.col("left_hi").alias("hi"), F.col("left_lo").alias("lo")), F.struct(F.lit(HELD_OUT).alias("side"), F.col("right_hi").alias("hi"), F.col("right_lo").alias("lo"))))).distinct()
    alike = known.join(ends, ["side", "hi", "lo"], "left_semi").select("row_seq")
    pieces = sided_segments(segments)
    cut = pieces.join(_ends(touching_segments(pieces)).distinct(), ["recording", "index", "side"], "left_semi").select("row_seq")
    return same.unionByName(alike).distinct().select(F.lit("combined_manifest").alias("table_name"), "row_seq").unionByName(cut.select(F.lit("train_shard_manifest").alias("table_name"), "row_seq"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table, split and source dataset: rows, and rows that overlap with another split."""
    touched = touched_rows(_recordings(spark, d), _segments(spark, d)).withColumn("hit", F.lit(1))
    combined = read_table(spark, d, "combined_manifest").select(F.lit("combined_manifest").alias("table_name"), "row_seq", keys.split_name("split").alias("split"), F.col("dataset").alias("source"))
    shards = read_table(spark, d, "train_shard_manifest").select(F.lit("train_shard_manifest").alias("table_name"), "row_seq", keys.split_name("split").alias("split"), F.col("source_dataset").alias("source"))
    rows = combined.unionByName(shards).join(touched, ["table_name", "row_seq"], "left")
    return rows.groupBy("table_name", "split", "source").agg(F.count("*").alias("n_rows"), F.count("hit").alias("n_overlapping"))


def p3_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """How much of each distinct record of ``combined_manifest`` also stands in records of the other side.

    The record is its normalised identity and lineage: dataset, path, group, content and print. ``row_seq`` is the first
    row that has it on its side, ``n_rows`` how many do. A copy with another path or group, or a near copy from the same
    recording, shows as a fraction between 0 and 1.
    """
    rows = read_table(spark, d, "combined_manifest").select(
        "row_seq", _sided("split").alias("side"), "dataset", keys.path_key("relative_path").alias("path"), keys.group_key("recording_group_id").alias("group"),
        keys.sha_key("sha256").alias("sha"), F.lower(keys.strip("audio_print")).alias("print"))
    classes = side_classes(rows.where("side IS NOT NULL"), "dataset", "path", "group", "sha", "print")
    out = classes.join(class_fractions(classes), "record", "left")
    return out.select(F.shiftright("record", 1).alias("row_seq"), F.when(F.pmod("record", F.lit(2)) == 0, "train").otherwise("held_out").alias("side"), "n_rows", F.round(F.coalesce("fraction", F.lit(0.0)), 6).alias("fraction"))


_KEY = sql.segment_key("segment_id")
_PAIRS_SQL = f"""WITH c AS (SELECT row_seq, {sql.split_name('split')} AS sp, {sql.sha_key('sha256')} AS sha, CASE WHEN regexp_full_match(lower(trim(audio_print)), '[0-9a-f]{{32}}') THEN ('0x' || left(lower(trim(audio_print)), 16))::UBIGINT END AS hi, CASE WHEN regexp_full_match(lower(trim(audio_print)), '[0-9a-f]{{32}}') THEN ('0x' || right(lower(trim(audio_print)), 16))::UBIGINT END AS lo FROM combined_manifest),
s AS (SELECT row_seq, {sql.split_name('split')} AS sp, regexp_extract({_KEY}, '^(.+):([0-9]{{1,9}})$', 1) AS sha, try_cast(nullif(regexp_extract({_KEY}, '^(.+):([0-9]{{1,9}})$', 2), '') AS INT) AS i FROM train_shard_manifest),
pairs AS (SELECT 'combined_manifest' AS table_name, least(a.row_seq, b.row_seq) AS row_a, greatest(a.row_seq, b.row_seq) AS row_b FROM c a JOIN c b ON a.sp = 'train' AND b.sp IN ('validation', 'test') AND (a.sha = b.sha OR bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8)
UNION ALL SELECT 'train_shard_manifest', least(a.row_seq, b.row_seq), greatest(a.row_seq, b.row_seq) FROM s a JOIN s b ON a.sp = 'train' AND b.sp IN ('validation', 'test') AND a.sha = b.sha AND abs(a.i - b.i) <= 1)"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_overlaps": p3_overlaps}
ORACLE = {
    "p3_found": _PAIRS_SQL + " SELECT table_name, row_a, row_b FROM pairs",
    "p3_report": _PAIRS_SQL + f""", hit AS (SELECT DISTINCT table_name, r FROM (SELECT table_name, row_a AS r FROM pairs UNION ALL SELECT table_name, row_b FROM pairs)),
rows AS (SELECT 'combined_manifest' AS table_name, row_seq, {sql.split_name('split')} AS split, dataset AS source FROM combined_manifest UNION ALL SELECT 'train_shard_manifest', row_seq, {sql.split_name('split')}, source_dataset FROM train_shard_manifest)
SELECT rows.table_name, split, source, count(*) AS n_rows, count(r) AS n_overlapping FROM rows LEFT JOIN hit ON hit.table_name = rows.table_name AND hit.r = rows.row_seq GROUP BY 1, 2, 3""",
}
