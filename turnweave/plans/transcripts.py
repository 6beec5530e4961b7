"""Plain and labelled transcripts as lines ``rec, pos, line``; one plan from scan to sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.scalars import labelled_line, plain_line, strip
from turnweave.operators.overlap import assign_speakers
from turnweave.operators.stitching import numbered, stitch


def plain(segments: DataFrame) -> DataFrame:
    return segments.select("rec", "pos", plain_line(F.col("start"), strip(F.col("text"))).alias("line"))


def labelled(segments: DataFrame, turns: DataFrame) -> DataFrame:
    found = assign_speakers(segments, turns)
    return found.select("rec", "pos", labelled_line(F.col("speaker"), F.col("start"), strip(F.col("text"))).alias("line"))


def transcript(segments: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """Labelled lines if there are turns to label by, else plain ones."""
    return plain(segments) if turns is None else labelled(segments, turns)


def stitched(segments: DataFrame, pieces: DataFrame, turns: DataFrame | None = None, overlap: float = 0.0) -> DataFrame:
    """Lines of whole recordings from segments of their pieces, named as ``meeting_003``; ``pieces`` is ``rec, length`` of
    all of them. Speakers are told by the turns of a piece, whose names mean the same within that piece only."""
    said = segments if turns is None else assign_speakers(segments, turns)
    whole = stitch(numbered(said), numbered(pieces), overlap)
    if turns is None:
        return plain(whole)
    return whole.select("rec", "pos", labelled_line(F.col("speaker"), F.col("start"), strip(F.col("text"))).alias("line"))
