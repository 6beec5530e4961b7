"""Queries over the driver's tables and the SQL that gives the same rows.

There are no recordings among the tables, so ``conversations`` serves as one: a turn of a conversation is a segment as
long as its text, and speakers' turns are segments shifted, left out and relabelled so that misses and ties occur.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions import scalars
from turnweave.operators import overlap, stitching
from turnweave.plans import transcripts
from turnweave.sources import documents, stored, strict
from turnweave.sources.sinks import write_files
from turnweave.sources.storage import shared_folder

_SEGMENTS = """SELECT conv_id AS rec, turn AS pos,
  (SUM(d) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - d AS st,
  SUM(d) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS en, role, text
FROM (SELECT *, LENGTH(text) / CAST(16 AS DOUBLE) AS d FROM conversations) c"""
_TURNS = """SELECT rec, pos, st + ((rec * 7 + pos * 3) % 5 - 2) * CAST(8 AS DOUBLE) AS st,
  en + ((rec * 5 + pos) % 5 - 2) * CAST(8 AS DOUBLE) AS en,
  CONCAT('SPEAKER_0', CAST((pos + rec % 2) % 3 AS VARCHAR(2))) AS speaker
FROM segments WHERE (rec + pos) % 4 <> 3"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    segments = spark.sql(_SEGMENTS.replace("conversations", "{conversations}"), conversations=conversations)
    turns = spark.sql(_TURNS.replace("segments", "{segments}"), segments=segments)
    names = {"st": "start", "en": "end"}
    return segments.withColumnsRenamed(names), turns.withColumnsRenamed(names)


def _back(frame: DataFrame) -> DataFrame:
    return frame.withColumnsRenamed({"start": "st", "end": "en"})


def _padded(segments: DataFrame) -> DataFrame:
    """Segments whose texts need stripping and some of whose times pass an hour."""
    text = F.concat(F.lit(" 　\n"), "text", F.lit("\t\x1c "))
    return segments.withColumns({"start": F.col("start") + (F.col("rec") % 3) * F.lit(3500.0), "text": text})


def segments_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _ = _tables(spark, sf_dir)
    nested = segments.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("pos", "start", "end", "text"))).alias("s"))
    nested = nested.select("rec", F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))).alias("segments"))
    return _back(documents.unnest(nested)).withColumn("pos", F.col("pos").cast("bigint"))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _ = _tables(spark, sf_dir)
    nested = segments.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("pos", "start", "end", "text"))).alias("segments"))
    written = nested.select("rec", F.to_json(F.struct("segments")).alias("json"))
    return _back(documents.segments(written)).withColumn("pos", F.col("pos").cast("bigint"))


def turns_default_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, turns = _tables(spark, sf_dir)
    lost = F.when((F.col("rec") + F.col("pos")) % 5 != 0, F.col("speaker"))
    return _back(turns.select("rec", "pos", "start", "end", scalars.speaker_or_unknown(lost).alias("speaker")))


def text_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _ = _tables(spark, sf_dir)
    return _padded(segments).select("rec", "pos", scalars.strip(F.col("text")).alias("text"))


def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _ = _tables(spark, sf_dir)
    seconds = F.col("start") + (F.col("rec") % 3) * F.lit(3500.0) - (F.col("pos") % 4) * F.lit(61.5)
    return segments.select("rec", "pos", scalars.time_text(seconds).alias("time"))


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_pairs(*_tables(spark, sf_dir))


def speaker_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.assign_speakers(*_tables(spark, sf_dir))
    return _back(found).select("rec", "pos", "st", "en", "speaker")


def speaker_assign_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap.assign_speakers(*_tables(spark, sf_dir), cell_seconds=32.0)
    return _back(found).select("rec", "pos", "st", "en", "speaker")


def speaker_assign_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From tables of buckets, without a shuffle after they are written."""
    own, run = stored.session(spark), uuid.uuid4().hex
    for rows, kind in zip(_tables(spark, sf_dir), ("segments", "turns")):
        stored.keep(rows, f"{kind}_{run}", int(spark.conf.get("spark.sql.shuffle.partitions")), shared_folder(spark))
    found = overlap.assign_speakers(*(stored.kept(own, f"{kind}_{run}") for kind in ("segments", "turns")))
    return _back(found).select("rec", "pos", "st", "en", "speaker")


def transcript_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, _ = _tables(spark, sf_dir)
    return transcripts.plain(_padded(segments))


def transcript_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels are found at the true times, then times are moved
    segments, turns = _tables(spark, sf_dir)
    found = _padded(overlap.assign_speakers(segments, turns))
    line = scalars.labelled_line(F.col("speaker"), F.col("start"), scalars.strip(F.col("text")))
    return found.select("rec", "pos", line.alias("line"))


def transcript_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both outcomes of the choice between plain and labelled lines."""
    segments, turns = _tables(spark, sf_dir)
    without, with_turns = transcripts.transcript(segments), transcripts.transcript(segments, turns)
    return without.withColumn("labelled", F.lit(False)).union(with_turns.withColumn("labelled", F.lit(True)))


def _documents(frame: DataFrame, *fields: str) -> DataFrame:
    """Rows ``rec, pos, ...`` as one JSON document per recording."""
    nested = frame.groupBy(F.col("rec").cast("string").alias("rec")).agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("segments"))
    bare = F.transform("segments", lambda s: F.struct(*(s[f].alias(f) for f in fields)))
    return nested.select("rec", F.to_json(F.struct(bare.alias("segments"))).alias("json"))


def _left_by_a_tool(docs: DataFrame) -> str:
    """The folder below which each document is a file."""
    folder = shared_folder(docs.sparkSession)
    docs.repartition("rec").write.partitionBy("rec").text(folder)
    return folder


def _numbered(flat: DataFrame) -> DataFrame:
    return _back(flat).withColumns({"rec": F.col("rec").cast("bigint"), "pos": F.col("pos").cast("bigint")})


def documents_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcription files, a document each, read from a folder and unnested."""
    segments, _ = _tables(spark, sf_dir)
    folder = _left_by_a_tool(_documents(segments, "start", "end", "text"))
    return _numbered(documents.segments(documents.raw_documents(spark, folder, by_folder=True)))


def turns_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diarization files, some without ``segments`` and some turns without a speaker."""
    _, turns = _tables(spark, sf_dir)
    turns = turns.withColumn("speaker", F.when((F.col("rec") + F.col("pos")) % 5 != 0, F.col("speaker")))
    docs = _documents(turns, "start", "end", "speaker")
    docs = docs.withColumn("json", F.when(F.col("rec").cast("bigint") % 6 == 0, "{}").otherwise(F.col("json")))
    return _numbered(documents.turns(documents.raw_documents(spark, _left_by_a_tool(docs), by_folder=True)))


def _strict_documents(segments: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as JSON texts, in which speakers are missing or null, and ends are null where a recording has no turns."""

    def written(frame: DataFrame, last: Column) -> DataFrame:
        fields = F.concat_ws(",", F.concat(F.lit('"start":'), F.col("start").cast("string")), F.concat(F.lit('"end":'), F.when(F.col("open"), "null").otherwise(F.col("end").cast("string"))), last)
        nested = frame.select(F.col("rec").cast("string").alias("rec"), F.struct("pos", F.concat(F.lit("{"), fields, F.lit("}")).alias("json")).alias("s"))
        nested = nested.groupBy("rec").agg(F.sort_array(F.collect_list("s")).alias("s"))
        return nested.select("rec", F.concat(F.lit('{"segments":['), F.array_join("s.json", ","), F.lit("]}")).alias("json"))

    quoted = lambda c: F.substring(F.to_json(F.struct(c)), F.lit(2), F.length(F.to_json(F.struct(c))) - 2)
    kind = (F.col("rec") + F.col("pos")) % 5
    speaker = F.when(kind == 0, F.lit('"speaker":null')).when(kind != 1, quoted("speaker"))
    speech = written(segments.withColumn("open", (F.col("rec") % 6 == 0) & (F.col("pos") % 2 == 1)), quoted("text"))
    told = written(turns.withColumn("open", F.lit(False)), speaker)
    return speech, told.withColumn("json", F.when(F.col("rec").cast("bigint") % 6 == 0, "{}").otherwise(F.col("json")))


def strict_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and null speakers told apart, and ends that nothing needs."""
    found = strict.transcript(*_strict_documents(*_tables(spark, sf_dir)))
    return found.withColumns({"rec": F.col("rec").cast("bigint"), "pos": F.col("pos").cast("bigint")})


def strict_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong in documents some of whose fields are of another type, null or lost."""
    segments, _ = _tables(spark, sf_dir)
    nth = (F.col("rec") * 3 + F.col("pos")) % 11
    start = F.when(nth == 0, F.lit('"start":"0"')).when(nth == 1, F.lit('"start":null')).when(nth != 2, F.concat(F.lit('"start":'), F.col("start").cast("string")))
    text = F.when(nth == 3, F.lit('"text":12')).when(nth == 4, F.lit('"text":null')).when(nth != 5, F.lit('"text":"as said"'))
    end = F.when(nth != 6, F.lit('"end":null'))
    element = F.concat(F.lit("{"), F.concat_ws(",", start, end, text), F.lit("}"))
    nested = segments.groupBy(F.col("rec").cast("string").alias("rec")).agg(F.sort_array(F.collect_list(F.struct("pos", element.alias("json")))).alias("s"))
    listed = F.concat(F.lit('{"segments":['), F.array_join("s.json", ","), F.lit("]}"))
    number = F.col("rec").cast("bigint")
    docs = nested.select("rec", F.when(number % 9 == 0, "{}").when(number % 9 == 1, '{"segments":null}').otherwise(listed).alias("json"))
    return strict.problems(docs).select(F.col("rec").cast("bigint").alias("rec"), "kind", F.col("pos").cast("bigint").alias("pos"), "problem")


def stitch_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn's piece starts if every turn of a conversation is a piece of its own, repeating none."""
    segments, _ = _tables(spark, sf_dir)
    length = F.col("end") - F.col("start")
    pieces = segments.select("rec", (F.row_number().over(Window.partitionBy("rec").orderBy("pos")) - 1).alias("piece"), length.alias("length"))
    return stitching.offsets(pieces).select("rec", F.col("piece").cast("bigint").alias("piece"), F.col("offset").alias("st"), (F.col("offset") + F.col("length")).alias("en"), F.col("last").alias("is_last"))


def stitch_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings cut every 30 seconds into pieces of 40, whose segments within the overlaps stand in both, are whole again."""
    segments, _ = _tables(spark, sf_dir)
    ends = segments.groupBy("rec").agg(F.max("start").alias("until"))
    pieces = ends.select("rec", F.explode(F.sequence(F.lit(0), F.floor(F.col("until") / 30).cast("int"))).alias("piece"), F.lit(40.0).alias("length"))
    of = F.filter(F.array(F.floor(F.col("start") / 30) - 1, F.floor(F.col("start") / 30)), lambda k: (k >= 0) & (F.col("start") < k * 30 + 40))
    told = segments.select("*", F.explode(of).alias("piece")).withColumn("piece", F.col("piece").cast("int"))
    told = told.withColumns({"start": F.col("start") - F.col("piece") * 30.0, "end": F.col("end") - F.col("piece") * 30.0})
    return _back(stitching.stitch(told, pieces, 10.0)).select("rec", F.col("pos").cast("bigint").alias("pos"), "st", "en", "role", "text")


def recordings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the tables' folder as recordings: stems, and paths put together again."""
    found = documents.recordings(spark, f"{sf_dir}/*.parquet")
    whole = F.concat(F.regexp_replace("path", "[^/]*$", ""), "rec", F.lit(".parquet"))
    return found.select("rec", (F.col("length") > 0).alias("has_content"), (whole == F.col("path")).alias("path_is_whole"))


def sink_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sink has written, file by file; some recordings are silent, and Spark's readers pass empty files over."""
    segments, _ = _tables(spark, sf_dir)
    recordings = segments.select(F.col("rec").cast("string").alias("rec")).distinct()
    lines = transcripts.plain(segments.where("rec % 7 <> 0")).withColumn("rec", F.col("rec").cast("string"))
    folder = shared_folder(spark)
    write_files(lines, folder, recordings)
    files = spark.read.format("binaryFile").load(folder)
    written = files.select(scalars.stem(scalars.decoded_name(F.col("_metadata.file_name"))).alias("rec"), F.col("content").cast("string").alias("content"))
    return recordings.join(written, "rec", "left").select(F.col("rec").cast("bigint").alias("rec"), F.coalesce("content", F.lit("")).alias("content"))


def file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of each document's text, with dots in many places."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    word = F.translate(F.left(F.coalesce("text", F.lit("")), F.lit(12)), "/\n ", "_..")
    name = F.concat(F.repeat(F.lit("."), (F.col("doc_id") % 3).cast("int")), word, F.when(F.col("doc_id") % 4 > 0, ".").otherwise(""), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).otherwise(""))
    return docs.select("doc_id", name.alias("name")).select("doc_id", "name", scalars.stem(F.col("name")).alias("stem"))


QUERIES = {
    "segments_unnest": segments_unnest,
    "json_roundtrip": json_roundtrip,
    "turns_default_speaker": turns_default_speaker,
    "text_strip": text_strip,
    "time_format": time_format,
    "overlap_pairs": overlap_pairs,
    "speaker_assign": speaker_assign,
    "speaker_assign_binned": speaker_assign_binned,
    "speaker_assign_stored": speaker_assign_stored,
    "transcript_plain": transcript_plain,
    "transcript_labelled": transcript_labelled,
    "transcript_chosen": transcript_chosen,
    "documents_scan": documents_scan,
    "turns_scan": turns_scan,
    "strict_transcript": strict_transcript,
    "strict_problems": strict_problems,
    "stitch_offsets": stitch_offsets,
    "stitch_whole": stitch_whole,
    "recordings_scan": recordings_scan,
    "sink_partitioned": sink_partitioned,
    "file_stem": file_stem,
}

#: Tables of the driver's folders, in which each is one file.
TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()

_WITH = f"WITH segments AS ({_SEGMENTS}), turns AS ({_TURNS})"
_N = "CAST(trunc({s}) AS BIGINT)"
_SHIFTED = "st + (rec % 3) * CAST(3500 AS DOUBLE)"


def _time_sql(seconds: str) -> str:
    n = _N.format(s=seconds)
    minutes, rest = f"((({n} % 3600) + 3600) % 3600) // 60", f"(({n} % 60) + 60) % 60"
    return f"CASE WHEN {n} >= 3600 THEN printf('%d:%02d:%02d', {n} // 3600, {minutes}, {rest}) ELSE printf('%02d:%02d', {minutes}, {rest}) END"


_CHARS = " || ".join(f"chr({ord(c)})" for c in scalars.WHITE_SPACE)
_STRIPPED = f"trim(chr(32) || chr(12288) || chr(10) || text || chr(9) || chr(28) || chr(32), {_CHARS})"
_TEXT = f"trim(text, {_CHARS})"
_ASSIGNED = """SELECT rec, pos, st, en, text, speaker FROM (
  SELECT g.rec, g.pos, g.st, g.en, g.text, CASE WHEN t.pos IS NULL THEN 'UNKNOWN' ELSE t.speaker END AS speaker,
    ROW_NUMBER() OVER (PARTITION BY g.rec, g.pos ORDER BY LEAST(g.en, t.en) - GREATEST(g.st, t.st) DESC NULLS LAST, t.pos ASC) AS rn
  FROM segments g LEFT JOIN turns t ON g.rec = t.rec AND g.st < t.en AND t.st < g.en AND g.st < g.en AND t.st < t.en) x WHERE rn = 1"""
_UNNESTED = f"{_WITH} SELECT rec, pos, st, en, text FROM segments"
_SPEAKERS = f"{_WITH} SELECT rec, pos, st, en, speaker FROM ({_ASSIGNED})"

ORACLE_SQL = {
    "segments_unnest": _UNNESTED,
    "json_roundtrip": _UNNESTED,
    "turns_default_speaker": f"{_WITH} SELECT rec, pos, st, en, CASE WHEN (rec + pos) % 5 <> 0 THEN speaker ELSE 'UNKNOWN' END AS speaker FROM turns",
    "text_strip": f"{_WITH} SELECT rec, pos, {_STRIPPED} AS text FROM segments",
    "time_format": f"{_WITH} SELECT rec, pos, {_time_sql(_SHIFTED + ' - (pos % 4) * CAST(61.5 AS DOUBLE)')} AS time FROM segments",
    "overlap_pairs": f"""{_WITH} SELECT g.rec, g.pos, t.pos AS t_pos, t.speaker, LEAST(g.en, t.en) - GREATEST(g.st, t.st) AS overlap
FROM segments g JOIN turns t ON g.rec = t.rec AND g.st < t.en AND t.st < g.en AND g.st < g.en AND t.st < t.en""",
    "speaker_assign": _SPEAKERS,
    "speaker_assign_binned": _SPEAKERS,
    "speaker_assign_stored": _SPEAKERS,
    "transcript_plain": f"{_WITH} SELECT rec, pos, {_time_sql(_SHIFTED)} || ' ' || {_STRIPPED} AS line FROM segments",
    "transcript_labelled": f"{_WITH} SELECT rec, pos, '[' || speaker || '] ' || {_time_sql(_SHIFTED)} || ' ' || {_STRIPPED} AS line FROM ({_ASSIGNED})",
    "transcript_chosen": f"""{_WITH} SELECT rec, pos, {_time_sql("st")} || ' ' || {_TEXT} AS line, false AS labelled FROM segments
UNION ALL SELECT rec, pos, '[' || speaker || '] ' || {_time_sql("st")} || ' ' || {_TEXT}, true FROM ({_ASSIGNED})""",
    "documents_scan": _UNNESTED,
    "turns_scan": f"{_WITH} SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS pos, st, en, CASE WHEN (rec + pos) % 5 <> 0 THEN speaker ELSE 'UNKNOWN' END AS speaker FROM turns WHERE rec % 6 <> 0",
    "strict_transcript": f"""WITH segments AS ({_SEGMENTS}),
turns AS (SELECT rec, pos, st, en, CASE (rec + pos) % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'UNKNOWN' ELSE speaker END AS speaker FROM ({_TURNS}) WHERE rec % 6 <> 0)
SELECT rec, pos, '[' || speaker || '] ' || {_time_sql("st")} || ' ' || {_TEXT} AS line FROM ({_ASSIGNED})""",
    "strict_problems": f"""{_WITH}, n AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS pos, (rec * 3 + pos) % 11 AS nth FROM segments WHERE rec % 9 > 1)
SELECT rec, 'segment' AS kind, pos, CASE nth WHEN 0 THEN 'has a start that is no number' WHEN 1 THEN 'has a null start' WHEN 2 THEN 'has no start'
  WHEN 3 THEN 'has a text that is no string' WHEN 4 THEN 'has a null text' WHEN 5 THEN 'has no text' ELSE 'has no end' END AS problem FROM n WHERE nth < 7
UNION ALL SELECT DISTINCT rec, 'segment', -1, CASE rec % 9 WHEN 0 THEN 'has no segments' ELSE 'has null segments' END FROM segments WHERE rec % 9 < 2""",
    "stitch_offsets": f"""{_WITH} SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY pos) - 1 AS piece, st, en,
  pos = max(pos) OVER (PARTITION BY rec) AS is_last FROM segments""",
    "stitch_whole": f"{_WITH} SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY st, pos) - 1 AS pos, st, en, role, coalesce(text, '') AS text FROM segments",
    "recordings_scan": "SELECT unnest([" + ", ".join(f"'{t}'" for t in TABLES) + "]) AS rec, true AS has_content, true AS path_is_whole",
    "sink_partitioned": f"""{_WITH} SELECT rec, CASE WHEN rec % 7 = 0 THEN '' ELSE string_agg({_time_sql("st")} || ' ' || {_TEXT} || chr(10), '' ORDER BY pos) END AS content FROM segments GROUP BY rec""",
    "file_stem": r"""SELECT doc_id, name, regexp_replace(name, '(?s)^(\.*[^.].*)\.[^.]*$', '\1') AS stem FROM (
SELECT doc_id, repeat('.', CAST(doc_id % 3 AS INTEGER)) || translate(left(coalesce(text, ''), 12), '/' || chr(10) || ' ', '_..') || CASE WHEN doc_id % 4 > 0 THEN '.' ELSE '' END || CASE WHEN doc_id % 5 > 0 THEN lang ELSE '' END AS name FROM documents)""",
}
