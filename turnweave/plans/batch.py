"""Transcripts of many recordings in one job, from a folder of audio or of the tools' documents to a text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnweave.operators.stitching import numbered
from turnweave.plans.transcripts import stitched, transcript
from turnweave.sources import documents, strict
from turnweave.sources.backends import Backend
from turnweave.sources.sinks import write_files


def lines(spark: SparkSession, recordings: DataFrame, speech: Backend, speakers: Backend | None = None, exact: bool = False, pieces: DataFrame | None = None, overlap: float = 0.0) -> DataFrame:
    """Lines ``rec, pos, line`` of the recordings (``rec, path``), labelled if there is a source of speakers.

    With ``pieces`` (``rec, length`` in seconds) the recordings are pieces of longer ones, such as ``meeting_003``, each
    repeating ``overlap`` seconds of the one before, and lines are those of the whole; not together with ``exact``.

    The job that computes them fails if two recordings share a stem, or if one has no document or more than one. With
    ``exact`` fields are taken as they are (``sources.strict``).
    """
    if exact and pieces is not None:
        raise ValueError("pieces are put together from checked segments, not with exact")
    said = documents.matched(speech.documents(spark, recordings), recordings)
    told = documents.matched(speakers.documents(spark, recordings), recordings) if speakers else None
    if exact:
        return strict.transcript(said, told)
    segments, turns = documents.segments(said), None if told is None else documents.turns(told)
    return transcript(segments, turns) if pieces is None else stitched(segments, pieces, turns, overlap)


def transcribe(spark: SparkSession, recordings: DataFrame, folder: str, speech: Backend, speakers: Backend | None = None, exact: bool = False, pieces: DataFrame | None = None, overlap: float = 0.0) -> None:
    """Writes ``STEM.txt`` per recording into ``folder``, an empty one for a recording in which nobody speaks; one per whole
    recording if these are pieces.

    With tools that keep their results (``ExternalTool.results``) a run after a failure takes up what the first has done.
    """
    with documents.told_plainly():
        whole = recordings if pieces is None else numbered(recordings.select("rec")).select("rec").distinct()
        write_files(lines(spark, recordings, speech, speakers, exact, pieces, overlap), folder, whole)
