"""JSON documents of speech tools, one per recording, as guarded DataFrames.

A document is read whole and parsed by ``from_json``, so a file is never split. Guards sit on the array, before it is
unnested: a check on an unnested column would be pruned with the column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions.scalars import decoded_name, speaker_or_unknown, stem
from turnweave.sources.schemas import SEGMENT_DOC, TURN_DOC


def recordings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``rec, path, length`` of audio files; contents are not read."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(stem(decoded_name(F.col("_metadata.file_name"))).alias("rec"), "path", "length")


def raw_documents(spark: SparkSession, paths: str | list[str], by_folder: bool = False) -> DataFrame:
    """``rec, json`` of the files at the paths, in UTF-8.

    A file's stem names its recording; with ``by_folder`` its folder ``rec=NAME`` does, as Spark's writers leave it.
    """
    if by_folder:
        return spark.read.schema("value string, rec string").text(paths, wholetext=True).select("rec", F.col("value").alias("json"))
    files = spark.read.text(paths, wholetext=True)
    return files.select(stem(decoded_name(F.col("_metadata.file_name"))).alias("rec"), F.col("value").alias("json"))


_NO_DOCUMENT, _MORE_DOCUMENTS, _MORE_RECORDINGS = "no document for", "more than one document for", "more than one recording is named"


def matched(found: DataFrame, recordings: DataFrame) -> DataFrame:
    """``rec, json`` of the recordings (``rec``) that are asked for; other documents are left out.

    The job that reads the documents fails itself if a recording is there twice, as one's transcript would replace the
    other's, or has no document, as files whose names start with _ or . do, or has more than one. The error names one of
    them. Documents move once, by ``rec``, as what follows needs them; nothing is read beforehand.
    """
    asked = recordings.select("rec", F.lit(1).alias("asked"), F.lit(None).cast("string").alias("json"))
    given = found.select("rec", F.lit(0).alias("asked"), "json")
    one = asked.union(given).groupBy("rec").agg(F.sum("asked").alias("asked"), (F.count("*") - F.sum("asked")).alias("given"), F.first("json", ignorenulls=True).alias("json"))
    wrong = F.when(F.col("asked") > 1, F.lit(_MORE_RECORDINGS)).when(F.col("given") == 0, F.lit(_NO_DOCUMENT)).when(F.col("given") > 1, F.lit(_MORE_DOCUMENTS))
    told = F.raise_error(F.concat(wrong, F.lit(" "), F.coalesce(F.col("rec"), F.lit("null"))))
    return one.where("asked > 0").select("rec", F.when(wrong.isNotNull(), told).otherwise(F.col("json")).alias("json"))


@contextmanager
def told_plainly() -> Iterator[None]:
    """Turns the failures of ``matched`` in a job into FileNotFoundError or ValueError; others pass as they are."""
    try:
        yield
    except Exception as failed:  # a job's failure has several classes, by the way it was started
        found = re.search(rf"(?:\[USER_RAISED_EXCEPTION\] )(({_NO_DOCUMENT}|{_MORE_DOCUMENTS}|{_MORE_RECORDINGS}) .*?)(?: SQLSTATE: \w+)?$", str(failed), re.MULTILINE)
        if not found:
            raise
        raise (FileNotFoundError if found[2] == _NO_DOCUMENT else ValueError)(found[1]) from failed


def _finite(time: Column) -> Column:
    return time.isNotNull() & ~F.isnan(time) & (F.abs(time) < float("inf"))


def segments(documents: DataFrame) -> DataFrame:
    """``rec, pos, start, end, text`` of transcription documents (``rec, json``), in list order.

    Fails on text that is not JSON, on a document without ``segments`` and on a segment without ``start``, ``end`` or
    ``text``, or with a time that is not finite.
    """
    parsed = documents.select("rec", F.from_json("json", SEGMENT_DOC, {"mode": "FAILFAST"}).alias("doc")).select("rec", F.col("doc.segments").alias("segments"))
    complete = lambda s: _finite(s["start"]) & _finite(s["end"]) & s["text"].isNotNull()
    missing = F.raise_error(F.concat(F.lit("no segments in the transcription of "), F.col("rec")))
    incomplete = F.raise_error(F.concat(F.lit("a segment lacks start, end or text in the transcription of "), F.col("rec")))
    checked = F.when(F.col("segments").isNull(), missing).when(~F.forall("segments", complete), incomplete).otherwise(F.col("segments"))
    return unnest(parsed.select("rec", checked.alias("segments")))


def turns(documents: DataFrame) -> DataFrame:
    """``rec, pos, start, end, speaker`` of diarization documents, in list order.

    A document without ``segments`` has no turns; a missing or null speaker is ``UNKNOWN``. Fails on a turn without
    ``start`` or ``end``, or with a time that is not finite.
    """
    parsed = documents.select("rec", F.from_json("json", TURN_DOC, {"mode": "FAILFAST"}).alias("doc")).select("rec", F.col("doc.segments").alias("segments"))
    complete = lambda t: _finite(t["start"]) & _finite(t["end"])
    incomplete = F.raise_error(F.concat(F.lit("a turn lacks start or end in the diarization of "), F.col("rec")))
    checked = F.when(F.col("segments").isNull() | F.forall("segments", complete), F.col("segments")).otherwise(incomplete)
    flat = unnest(parsed.select("rec", checked.alias("segments")))
    return flat.withColumn("speaker", speaker_or_unknown(F.col("speaker")))


def unnest(nested: DataFrame) -> DataFrame:
    """A row per element of ``segments``, with its place ``pos``; a null or empty array gives none."""
    return nested.select("rec", F.posexplode("segments").alias("pos", "s")).select("rec", "pos", "s.*")
