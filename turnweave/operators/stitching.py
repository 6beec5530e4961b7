"""Pieces of split audio put together: times from the recording's start, and what was said twice at a seam said once.

Long recordings are cut into numbered pieces before the tools see them, with some seconds of overlap if no word is to be
lost at a cut. A piece starts where the lengths of those before it end, less the overlaps. What is said within an overlap
stands in two pieces. The two are aligned by word triples that occur once on each side, which vote for how far apart equal
words stand; along the shift with most votes, the longest run of equal words is where both tools heard the same, and the
seam is cut at a segment's end within that run: the earlier piece gives what comes before, the later one what comes after.
Without a common triple, the seam is cut in the middle of the overlap, and a segment goes with its start.

Words meet by equality keys (recording, seam, triple or place), so a seam's work grows with its words, not with pairs of
them. Sums over a recording's pieces go by blocks of pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of a block within which sums are taken in order; then blocks are.
BLOCK = 1024
MICRO = 1_000_000


def numbered(rows: DataFrame, pattern: str = r"(?s)^(.*)_([0-9]+)$") -> DataFrame:
    """``rec`` of pieces such as ``meeting_003`` told apart into ``rec`` and a number ``piece``; another name is an error."""
    parts = F.regexp_extract("rec", pattern, 2)
    piece = F.when(parts == "", F.raise_error(F.concat(F.lit("no number of a piece in the name "), F.col("rec")))).otherwise(parts.cast("int"))
    return rows.select(F.regexp_extract("rec", pattern, 1).alias("rec"), piece.alias("piece"), *(c for c in rows.columns if c != "rec"))


def _before(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``before``, the sum of ``value`` over lower pieces of the recording, ``whole`` (pieces are numbered from
    0 without gaps, as far as seen from this row) and ``last``."""
    rows = rows.withColumn("block", F.floor(F.col("piece") / BLOCK))
    block = Window.partitionBy("rec", "block")
    ordered = block.orderBy("piece")
    inside = rows.withColumns({"below": F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), "nth": F.row_number().over(ordered) - 1, "held": F.count("*").over(block)})
    blocks = Window.partitionBy("b_rec").orderBy("b_block")
    sums = rows.groupBy(F.col("rec").alias("b_rec"), F.col("block").alias("b_block")).agg(F.sum(value).alias("total"))
    sums = sums.select("b_rec", "b_block", F.sum("total").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("base"), (F.row_number().over(blocks) - 1).alias("b_nth"), F.lead("b_block").over(blocks).isNull().alias("b_last"))
    joined = inside.join(sums, F.col("rec").eqNullSafe(F.col("b_rec")) & F.col("block").eqNullSafe(F.col("b_block")))
    whole = (F.col("piece") == F.col("block") * BLOCK + F.col("nth")) & (F.col("block") == F.col("b_nth")) & (F.col("b_last") | (F.col("held") == BLOCK))
    before = F.coalesce("base", F.lit(0)) + F.coalesce("below", F.lit(0))
    return joined.select(*rows.drop("block").columns, before.alias("before"), F.coalesce(whole, F.lit(False)).alias("whole"), (F.col("b_last") & (F.col("nth") == F.col("held") - 1)).alias("last"))


def offsets(pieces: DataFrame, overlap: float = 0.0) -> DataFrame:
    """``rec, piece, offset, length, last`` of pieces ``rec, piece, length``: where each starts in its recording, in seconds.

    Each piece but the first repeats the last ``overlap`` seconds of the one before. Sums are of whole microseconds, so
    their order does not matter. An error if a recording's pieces are not numbered from 0 without gaps and repeats, if a
    length is null, not finite or negative, or if a piece before another is shorter than two overlaps.
    """
    shared = round(overlap * MICRO)
    good = F.col("length").isNotNull() & ~F.isnan("length") & F.col("length").between(0, 1e12)
    micro = F.when(good, F.round(F.col("length") * MICRO).cast("bigint"))
    placed = _before(pieces.select("rec", "piece", "length", micro.alias("micro"), (micro - shared).alias("step")), "step")
    wrong = F.when(F.col("micro").isNull(), F.lit("a piece has no length that is a number")).when(~F.col("whole"), F.lit("pieces are not numbered from 0 without gaps"))
    wrong = wrong.when(~F.col("last") & (F.col("micro") < 2 * shared), F.lit("a piece is shorter than its two overlaps"))
    told = F.raise_error(F.concat(wrong, F.lit(" in "), F.coalesce("rec", F.lit("null")))).cast("double")
    return placed.select("rec", "piece", F.when(wrong.isNotNull(), told).otherwise(F.col("before") / MICRO).alias("offset"), "length", "last")


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([^\s\p{Z}]+)"))


def _seam_words(placed: DataFrame) -> DataFrame:
    """``rec, seam, late, at, pos, w, word, ends``: the words on both sides of each seam, counted from 0 by ``at``."""
    sides = F.array(F.when(F.col("in_tail"), F.struct((F.col("piece") + 1).alias("seam"), F.lit(False).alias("late"))), F.when(F.col("in_head"), F.struct(F.col("piece").alias("seam"), F.lit(True).alias("late"))))
    told = placed.where("in_tail OR in_head").withColumn("side", F.explode(F.array_compact(sides)))
    each = told.select("rec", "side.seam", "side.late", "pos", F.size("words").alias("n"), F.posexplode("words").alias("w", "raw"))
    bare = F.regexp_replace(F.lower("raw"), r"[^\p{L}\p{N}]", "")
    order = Window.partitionBy("rec", "seam", "late").orderBy("pos", "w")
    return each.select("rec", "seam", "late", (F.row_number().over(order) - 1).alias("at"), "pos", "w", F.when(bare == "", F.col("raw")).otherwise(bare).alias("word"), (F.col("w") == F.col("n") - 1).alias("ends"))


def seams(words: DataFrame) -> DataFrame:
    """``rec, seam, early, late``: the last word (pos, w) before the cut on either side of each seam with a common triple."""
    seam = ["rec", "seam"]
    order = Window.partitionBy(*seam, "late").orderBy("at")
    triples = words.withColumn("triple", F.struct("word", F.lead("word").over(order).alias("second"), F.lead("word", 2).over(order).alias("third"))).where("triple.third IS NOT NULL")
    once = triples.groupBy(*seam, "triple").agg(F.count_if("late").alias("n_late"), F.count_if(~F.col("late")).alias("n_early"), F.max(F.when(F.col("late"), F.col("at"))).alias("j"), F.max(F.when(~F.col("late"), F.col("at"))).alias("i"))
    votes = once.where("n_late = 1 AND n_early = 1").groupBy(*seam, (F.col("i") - F.col("j")).alias("shift")).agg(F.count("*").alias("n"))
    shifts = votes.groupBy(*seam).agg(F.max_by("shift", F.struct("n", -F.abs("shift"), -F.col("shift"))).alias("shift"))
    # a word of each side at one place along the shift; equal ones form runs
    place = F.when(F.col("late"), F.col("at") + F.col("shift")).otherwise(F.col("at"))
    of = lambda side: F.max(F.when(side, F.struct("word", "pos", "w", "ends")))
    met = words.join(shifts, seam).groupBy(*seam, place.alias("place")).agg(of(~F.col("late")).alias("e"), of(F.col("late")).alias("l")).where("e.word = l.word")
    run = F.col("place") - F.row_number().over(Window.partitionBy(*seam).orderBy("place"))
    worth = F.when(F.col("e.ends") & F.col("l.ends"), 2).when(F.col("e.ends"), 1).otherwise(0)
    cut = F.struct(worth.alias("worth"), "place", F.struct("e.pos", "e.w").alias("early"), F.struct("l.pos", "l.w").alias("late"))
    runs = met.select(*seam, run.alias("run"), cut.alias("cut")).groupBy(*seam, "run").agg(F.count("*").alias("n"), F.max("cut").alias("cut"))
    best = runs.groupBy(*seam).agg(F.max_by("cut", F.struct("n", -F.col("run"))).alias("cut"))
    return best.select(*seam, "cut.early", "cut.late")


def stitch(segments: DataFrame, pieces: DataFrame, overlap: float = 0.0) -> DataFrame:
    """Segments of whole recordings, from those of pieces (``rec, piece, pos, start, end, text`` and other columns).

    ``piece`` is gone, times count from the recording's start, and ``pos`` from 0 in order of piece and ``pos``. ``pieces``
    (``rec, piece, length``) lists all pieces, silent ones too; a segment of another one is an error. A segment that a seam
    cuts keeps its words on its side, joined by blanks, and the part of its time that is theirs by number; one that loses
    all its words goes. A null text is an empty one. With no overlap nothing is said twice and texts stay as they are.
    Words are what white space parts, compared by letters and digits without case. ``(rec, piece, pos)`` identifies a
    segment.
    """
    own = ["rec", "piece", "pos", "start", "end", "text"]
    others = [c for c in segments.columns if c not in own]
    at = offsets(pieces, overlap).select(F.col("rec").alias("o_rec"), F.col("piece").alias("o_piece"), "offset", F.col("length").alias("o_length"), "last")
    placed = segments.select(*own, F.struct(F.lit(0).alias("_"), *others).alias("others")).join(at, (F.col("rec") == F.col("o_rec")) & (F.col("piece") == F.col("o_piece")), "left")
    lost = F.raise_error(F.concat(F.lit("no length of a piece of "), F.coalesce("rec", F.lit("null")))).cast("double")
    placed = placed.withColumn("offset", F.when(F.col("o_rec").isNull(), lost).otherwise(F.col("offset"))).drop("o_rec", "o_piece")
    if overlap > 0:
        placed = _cut_at_seams(placed, overlap)
    counts = _before(placed.groupBy("rec", "piece").agg(F.count("*").alias("n")), "n").select(F.col("rec").alias("o_rec"), F.col("piece").alias("o_piece"), "before")
    order = Window.partitionBy("rec", "piece").orderBy("pos")
    placed = placed.withColumn("nth", F.row_number().over(order) - 1)
    found = placed.join(counts, (F.col("rec") == F.col("o_rec")) & (F.col("piece") == F.col("o_piece")))
    value = {"rec": F.col("rec"), "pos": F.col("before") + F.col("nth"), "start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset"), "text": F.coalesce("text", F.lit(""))}
    value |= {c: F.col("others")[c] for c in others}
    return found.select(*(value[c].alias(c) for c in segments.columns if c != "piece"))


def _cut_at_seams(placed: DataFrame, overlap: float) -> DataFrame:
    """``placed`` without what the other side of a seam says."""
    columns = placed.columns
    placed = placed.withColumns({"words": _words("text"), "in_tail": ~F.col("last") & (F.col("end") > F.col("o_length") - overlap), "in_head": (F.col("piece") > 0) & (F.col("start") < overlap)})
    cuts = seams(_seam_words(placed))
    tail = cuts.select(F.col("rec").alias("t_rec"), (F.col("seam") - 1).alias("t_piece"), F.col("early").alias("t"))
    head = cuts.select(F.col("rec").alias("h_rec"), F.col("seam").alias("h_piece"), F.col("late").alias("h"))
    placed = placed.join(tail, (F.col("rec") == F.col("t_rec")) & (F.col("piece") == F.col("t_piece")), "left")
    placed = placed.join(head, (F.col("rec") == F.col("h_rec")) & (F.col("piece") == F.col("h_piece")), "left")
    size, middle = F.size("words"), overlap / 2
    goes_after = F.col("in_tail") & F.when(F.col("t").isNull(), F.col("start") >= F.col("o_length") - middle).otherwise(F.col("pos") > F.col("t.pos"))
    goes_before = F.col("in_head") & F.when(F.col("h").isNull(), F.col("start") < middle).otherwise(F.col("pos") < F.col("h.pos"))
    low = F.when(F.col("in_head") & (F.col("pos") == F.col("h.pos")), F.col("h.w") + 1).otherwise(0)
    high = F.when(F.col("in_tail") & (F.col("pos") == F.col("t.pos")), F.col("t.w") + 1).otherwise(size)
    kept = placed.withColumns({"low": low, "high": high, "size": size}).where(~(goes_after | goes_before)).where("size = 0 OR low < high")
    part = lambda n: F.col("start") + (F.col("end") - F.col("start")) * n / F.col("size")
    changed = {
        "start": F.when(F.col("low") > 0, part(F.col("low"))).otherwise(F.col("start")),
        "end": F.when(F.col("high") < F.col("size"), part(F.col("high"))).otherwise(F.col("end")),
        "text": F.when((F.col("low") > 0) | (F.col("high") < F.col("size")), F.array_join(F.slice("words", F.col("low") + 1, F.col("high") - F.col("low")), " ")).otherwise(F.col("text")),
    }
    return kept.select(*(changed.get(c, F.col(c)).alias(c) for c in columns))
