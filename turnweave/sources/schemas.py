"""Shapes of the documents that speech tools leave, and of the flat rows made from them."""

from __future__ import annotations

SEGMENT_DOC = "segments array<struct<start: double, end: double, text: string>>"
TURN_DOC = "segments array<struct<start: double, end: double, speaker: string>>"
SEGMENTS = "rec string, pos int, start double, end double, text string"
TURNS = "rec string, pos int, start double, end double, speaker string"
