"""JSON documents of speech tools taken as they are, by VARIANT: a missing field, a null and a wrong type are told apart.

``documents`` reads with a struct schema, in which a missing field and a null are one and numbers become texts. Here each
field is looked at before it gets a type:

| Field | Missing | Null | Of another type |
| --- | --- | --- | --- |
| ``segments`` of a transcription | problem | problem | problem |
| ``segments`` of a diarization | no turns | problem | problem |
| a segment's ``start`` | problem | problem | problem |
| a segment's ``end`` | problem | kept; a problem where the recording has turns | problem |
| a segment's ``text`` | problem | problem | problem |
| a turn's ``start``, ``end`` | problem | problem (for the first segment, if there is any) | problem |
| a turn's ``speaker`` | ``UNKNOWN`` | ``None``, as it is printed | whole numbers as digits, else a problem |

Numbers are JSON numbers that a double can hold; truth values and digits in quotes are none. Text that is not JSON, NaN,
and a key that is there twice in one object are errors of the parser; a null in place of a document is a problem. Problems are found on the whole array before it is
unnested, so that no pruning of columns hides one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.scalars import UNKNOWN
from turnweave.plans.transcripts import transcript as lines_of
from turnweave.sources.documents import unnest

#: How a null speaker is printed, a fixed value.
NULL_SPEAKER = "None"

_LACKS = "NOT isnotnull(variant_get({v}, '$.{field}', 'variant'))"
_NULL = "is_variant_null(variant_get({v}, '$.{field}', 'variant'))"
_TYPE = "schema_of_variant(variant_get({v}, '$.{field}', 'variant'))"
#: Names that schema_of_variant gives to JSON numbers.
_NUMBER = "(BIGINT|DECIMAL.*|DOUBLE)"


def _time_problem(v: str, field: str, null_is_one: bool = True) -> str:
    lacks, null, type_ = (x.format(v=v, field=field) for x in (_LACKS, _NULL, _TYPE))
    value = f"try_variant_get({v}, '$.{field}', 'double')"
    wrong = f"NOT rlike({type_}, '^{_NUMBER}$') OR {value} IS NULL OR abs({value}) = double('infinity')"
    return f"CASE WHEN {lacks} THEN 'has no {field}' WHEN {null} THEN {repr(f'has a null {field}') if null_is_one else 'NULL'} WHEN {wrong} THEN 'has a {field} that is no number' END"


def _text_problem(v: str) -> str:
    lacks, null, type_ = (x.format(v=v, field="text") for x in (_LACKS, _NULL, _TYPE))
    return f"CASE WHEN {lacks} THEN 'has no text' WHEN {null} THEN 'has a null text' WHEN {type_} <> 'STRING' THEN 'has a text that is no string' END"


def _speaker_problem(v: str) -> str:
    lacks, null, type_ = (x.format(v=v, field="speaker") for x in (_LACKS, _NULL, _TYPE))
    return f"CASE WHEN {lacks} OR {null} OR {type_} IN ('STRING', 'BIGINT') THEN NULL ELSE 'has a speaker that is no string' END"


_SEGMENT_PROBLEM = f"coalesce({_time_problem('s', 'start')}, {_time_problem('s', 'end', null_is_one=False)}, {_text_problem('s')})"
_TURN_PROBLEM = f"coalesce({_time_problem('s', 'start')}, {_time_problem('s', 'end')}, {_speaker_problem('s')})"


def _checked(documents: DataFrame, problem: str, optional: bool) -> DataFrame:
    """``rec, items, problems``: the elements as VARIANT, and (pos, problem) of each that is wrong; pos is -1 for a list."""
    doc = documents.select("rec", F.parse_json("json").alias("doc"))
    doc = doc.selectExpr("rec", "variant_get(doc, '$.segments', 'variant') AS listed", "variant_get(doc, '$.segments', 'variant') IS NULL AND coalesce(NOT startswith(schema_of_variant(doc), 'OBJECT'), true) AS bare")
    doc = doc.selectExpr("rec", "listed", "bare", "try_variant_get(listed, '$', 'array<variant>') AS items")
    lists = f"""CASE WHEN bare THEN 'is no object' WHEN listed IS NULL THEN {'NULL' if optional else "'has no segments'"}
                     WHEN is_variant_null(listed) THEN 'has null segments' WHEN items IS NULL THEN 'has segments that are no list' END"""
    single = f"filter(transform(items, (s, i) -> named_struct('pos', i, 'problem', {problem})), p -> p.problem IS NOT NULL)"
    none = "cast(array() AS array<struct<pos: int, problem: string>>)"
    return doc.selectExpr("rec", "items", f"CASE WHEN ({lists}) IS NOT NULL THEN array(named_struct('pos', -1, 'problem', {lists})) ELSE coalesce({single}, {none}) END AS problems")


def _stopping(checked: DataFrame, element: str, kind: str) -> DataFrame:
    """``rec, items``; the first problem of a document fails the job as soon as its elements are asked for."""
    told = f"concat(if(problems[0].pos < 0, '', concat('{element} ', problems[0].pos, ' ')), problems[0].problem, ': the {kind} of ', rec)"
    return checked.selectExpr("rec", f"CASE WHEN size(problems) > 0 THEN raise_error({told}) ELSE items END AS items")


def _segments_of(items: str) -> str:
    return f"transform({items}, s -> named_struct('start', variant_get(s, '$.start', 'double'), 'end', variant_get(s, '$.end', 'double'), 'text', variant_get(s, '$.text', 'string'))) AS segments"


def _turns_of(items: str) -> str:
    speaker = f"CASE WHEN {_LACKS.format(v='s', field='speaker')} THEN '{UNKNOWN}' ELSE coalesce(variant_get(s, '$.speaker', 'string'), '{NULL_SPEAKER}') END"
    return f"transform({items}, s -> named_struct('start', variant_get(s, '$.start', 'double'), 'end', variant_get(s, '$.end', 'double'), 'speaker', {speaker})) AS segments"


def segments(documents: DataFrame) -> DataFrame:
    """``rec, pos, start, end, text`` of transcription documents (``rec, json``), in list order; a null ``end`` is kept.

    Fails with the place and kind of a document's first problem. An empty table gives an empty one.
    """
    return unnest(_stopping(_checked(documents, _SEGMENT_PROBLEM, False), "segment", "transcription").selectExpr("rec", _segments_of("items")))


def turns(documents: DataFrame) -> DataFrame:
    """``rec, pos, start, end, speaker`` of diarization documents, in list order; fails as ``segments`` does."""
    return unnest(_stopping(_checked(documents, _TURN_PROBLEM, True), "turn", "diarization").selectExpr("rec", _turns_of("items")))


def transcript(speech: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """Lines ``rec, pos, line`` of documents (``rec, json``), one per recording, labelled if there are speakers' ones.

    Only a recording with turns needs the ends of its segments: there a null one fails. Documents meet by recording for
    this, before they are unnested; a recording without a speakers' document has no turns.
    """
    if speakers is None:
        return lines_of(segments(speech))
    said = _stopping(_checked(speech, _SEGMENT_PROBLEM, False), "segment", "transcription")
    told = turns(speakers)
    labels = told.select("rec").distinct().withColumn("labelled", F.lit(True))
    open_end = "exists(items, s -> is_variant_null(variant_get(s, '$.end', 'variant')))"
    ends = said.join(labels, "rec", "left").selectExpr("rec", f"CASE WHEN labelled AND {open_end} THEN raise_error(concat('a segment has a null end: the transcription of ', rec)) ELSE items END AS items")
    return lines_of(unnest(ends.selectExpr("rec", _segments_of("items"))), told)


def problems(speech: DataFrame, speakers: DataFrame | None = None) -> DataFrame:
    """``rec, kind, pos, problem`` of all that is wrong in the documents, for reports; nothing fails but on text that is
    not JSON. ``kind`` is ``segment`` or ``turn``; ``pos`` is -1 for a document's list as a whole."""
    found = _checked(speech, _SEGMENT_PROBLEM, False).select("rec", F.lit("segment").alias("kind"), F.inline("problems"))
    if speakers is None:
        return found
    return found.unionByName(_checked(speakers, _TURN_PROBLEM, True).select("rec", F.lit("turn").alias("kind"), F.inline("problems")))
