"""Which speaker a segment belongs to: the turn that overlaps it most.

A left-outer interval-overlap join and an argmax, by equality keys only. Time is cut into cells, which pair up into cells
twice as long, and so on up: a binary hierarchy of LEVELS levels. An interval is covered by the fewest cells that make it
up, two a level at most; a moment lies in one cell of each level. So a moment meets an interval that holds it in exactly
one of the interval's cells, and two intervals share time where the start of one, or the end, is a moment of the other.
Cells are even up to about half a year and grow with time beyond, so any finite interval has some forty cells at most. A
moment looks at the levels only that its recording's intervals reach. One very long recording is spread over its cells.

A turn that holds a segment whole overlaps it as much as any turn can, and the first such turn by ``pos`` settles it but
for ties. It is found without pairing: within a cell, turns and segments are sorted by their ends, and a running minimum
tells each segment the first turn of those that end no earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.scalars import UNKNOWN

#: Length of the shortest cells in seconds, near the usual duration of a segment.
CELL_SECONDS = 16.0
#: Cells to each side of 0 that have that length; of those beyond, so many double the time.
EVEN, A_DOUBLING = 1 << 20, 64
#: 2 ** LEVELS cells hold every finite time; the first one is at -2 ** (LEVELS - 1).
LEVELS = 22

_KEY = ["rec", "level", "node"]


def _cell(time: str, seconds: float) -> str:
    """SQL: the number of the shortest cell of a time; a later time never has a lower one."""
    x = f"({time} / {float(seconds)}D)"
    beyond = f"floor(least({A_DOUBLING} * log2(abs({x}) / {EVEN}), 66000D))"
    return f"(cast(CASE WHEN abs({x}) < {EVEN} THEN floor({x}) WHEN {x} > 0 THEN {EVEN} + {beyond} ELSE -{EVEN} - 1 - {beyond} END AS bigint) + {1 << (LEVELS - 1)}L)"


def _cover(low: str, high: str) -> str:
    """SQL: the cells (level, node) that make up the shortest cells from low to high, none if high < low."""
    left, right = f"shiftright({low} + shiftleft(1L, k) - 1, k)", f"shiftright({high} + 1, k)"
    pair = f"""array(if({left} < {right} AND {left} & 1 = 1, named_struct('level', k, 'node', {left}), null),
                     if({left} < {right} AND {right} & 1 = 1, named_struct('level', k, 'node', {right} - 1), null))"""
    return f"filter(flatten(transform(sequence(0, length(bin(greatest({high} - {low} + 1, 1L))) - 1), k -> {pair})), c -> c IS NOT NULL)"


def _path(cell: str, top: str) -> str:
    """SQL: the cells (level, node) up to a level that a shortest cell lies in."""
    return f"transform(sequence(0, {top}), k -> named_struct('level', k, 'node', shiftright({cell}, k)))"


def _sides(segments: DataFrame, turns: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame]:
    """Segments and turns of some length, with the cells of their starts and ends."""
    s = segments.select("rec", "pos", "start", "end", F.expr(_cell("start", seconds)).alias("low"), F.expr(_cell("end", seconds)).alias("high")).where("start < end")
    t = turns.select("rec", F.col("pos").alias("t_pos"), F.col("start").alias("t_start"), F.col("end").alias("t_end"), "speaker").where("t_start < t_end")
    return s, t.withColumns({"t_low": F.expr(_cell("t_start", seconds)), "t_high": F.expr(_cell("t_end", seconds))})


def _covered(side: DataFrame, low: str, high: str) -> DataFrame:
    """A row for each cell of each interval."""
    return side.withColumn("c", F.explode(F.expr(_cover(low, high)))).select("*", "c.level", "c.node").drop("c")


def _reached(side: DataFrame, low: str, high: str) -> DataFrame:
    """``rec, top``: the highest level of a recording's cells, from the lengths of its intervals."""
    return side.groupBy("rec").agg(F.max(F.expr(f"length(bin(greatest({high} - {low} + 1, 1L))) - 1")).alias("top"))


def _located(moments: DataFrame, cell: str, reached: DataFrame) -> DataFrame:
    """A row for each cell of each moment, up to the level that the recording's intervals reach."""
    return moments.join(reached, "rec").withColumn("c", F.explode(F.expr(_path(cell, "top")))).select("*", "c.level", "c.node").drop("c", "top")


_OVERLAP = "least(end, t_end) - greatest(start, t_start)"


def overlap_pairs(segments: DataFrame, turns: DataFrame, cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """``rec, pos, t_pos, speaker, overlap`` of every segment and turn of a recording that share time.

    Intervals that only touch, and empty or inverted ones, share none. Times are finite numbers of any size.
    """
    s, t = _sides(segments, turns, cell_seconds)
    # the later of the two starts lies in the other interval: in exactly one of its cells
    begun = _located(s, "low", _reached(t, "t_low", "t_high")).join(_covered(t, "t_low", "t_high"), _KEY).where("t_start <= start AND start < t_end")
    joined = _covered(s, "low", "high").join(_located(t, "t_low", _reached(s, "low", "high")), _KEY).where("start < t_start AND t_start < end")
    columns = ["rec", "pos", "t_pos", "speaker", F.expr(_OVERLAP).alias("overlap")]
    return begun.select(columns).union(joined.select(columns))


def _first_holding(s: DataFrame, t: DataFrame) -> DataFrame:
    """``rec, pos, t_pos, speaker, overlap`` of segments and the first turn that holds them whole, by running minima.

    A segment may have several rows, one of which is the first turn's.
    """
    # turns that start in an earlier cell than the segment: the segment's start is in one of the cells after theirs
    after = _covered(t.withColumn("after", F.col("t_low") + 1), "after", "t_high").select(*_KEY, F.lit(None).cast("bigint").alias("cell"), F.col("t_end").alias("until"), F.struct("t_pos", "speaker").alias("turn"))
    none = F.lit(None).cast(after.schema["turn"].dataType)
    asked = _located(s, "low", _reached(t, "t_low", "t_high")).select(*_KEY, F.lit(None).cast("bigint").alias("cell"), F.col("end").alias("until"), none.alias("turn"), "pos", "start")
    # turns that start in the same cell: those up to the segment's start are a prefix by start, made up of runs of
    # 1, 2, 4, ... turns that begin at multiples of their lengths
    both = t.select("rec", F.col("t_low").alias("cell"), F.col("t_start").alias("since"), F.col("t_end").alias("until"), F.struct("t_pos", "speaker").alias("turn"), F.lit(None).cast(s.schema["pos"].dataType).alias("pos"), F.lit(None).cast("double").alias("start"))
    both = both.union(s.select("rec", F.col("low").alias("cell"), F.col("start").alias("since"), F.col("end").alias("until"), none.alias("turn"), "pos", "start"))
    in_cell = Window.partitionBy("rec", "cell")
    running = in_cell.orderBy("since", F.col("turn").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"before": F.count("turn").over(running), "all": F.count("turn").over(in_cell)}).where("before > 0")
    runs = """if(turn IS NOT NULL,
        filter(transform(sequence(0, length(bin(all)) - 1), k -> named_struct('level', k, 'node', shiftright(before - 1, k))), c -> c.node & 1 = 0),
        filter(transform(sequence(0, length(bin(before)) - 1), k -> named_struct('level', k, 'node', shiftright(before, k) - 1)), c -> c.node & 1 = 0))"""
    same = both.withColumn("c", F.explode(F.expr(runs))).select("rec", "c.level", "c.node", "cell", "until", "turn", "pos", "start")
    rows = after.withColumns({"pos": F.lit(None).cast(s.schema["pos"].dataType), "start": F.lit(None).cast("double")}).unionByName(asked).unionByName(same)
    latest = Window.partitionBy("rec", "cell", "level", "node").orderBy(F.col("until").desc(), F.col("turn").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("first", F.min("turn").over(latest)).where("turn IS NULL AND first IS NOT NULL")
    return found.select("rec", "pos", F.col("first.t_pos").alias("t_pos"), F.col("first.speaker").alias("speaker"), (F.col("until") - F.col("start")).alias("overlap"))


def _partly(s: DataFrame, t: DataFrame) -> DataFrame:
    """``rec, pos, t_pos, speaker, overlap`` of segments and turns that overlap them without holding them whole: which start
    within them, or else end within them."""
    ends = F.explode(F.array(F.struct(F.lit(True).alias("starts"), F.col("t_low").alias("cell")), F.struct(F.lit(False).alias("starts"), F.col("t_high").alias("cell"))))
    moments = t.withColumn("m", ends).select("rec", "t_pos", "t_start", "t_end", "speaker", "m.starts", "m.cell")
    met = _covered(s, "low", "high").join(_located(moments, "cell", _reached(s, "low", "high")), _KEY)
    within = "if(starts, start < t_start AND t_start < end, t_start <= start AND start < t_end AND t_end < end)"
    return met.where(within).select("rec", "pos", "t_pos", "speaker", F.expr(_OVERLAP).alias("overlap"))


def candidates(segments: DataFrame, turns: DataFrame, cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """``rec, pos, t_pos, speaker, overlap`` of the turns that can be a segment's best: of those that hold it whole a few
    with the first among them, and all that overlap it partly."""
    s, t = _sides(segments, turns, cell_seconds)
    return _first_holding(s, t).unionByName(_partly(s, t))


def assign_speakers(segments: DataFrame, turns: DataFrame, cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """The segments with a column ``speaker``, one row each.

    The single turn with the largest overlap gives it, of equal ones the first by ``pos``; a segment that no turn
    overlaps, or a turn without a speaker, gives ``UNKNOWN``. Neither side need be sorted. ``(rec, pos)`` identifies a
    segment. Times are finite numbers of any size; ``cell_seconds`` changes the speed only.
    """
    best = candidates(segments, turns, cell_seconds).groupBy(F.col("rec").alias("b_rec"), F.col("pos").alias("b_pos")).agg(F.max_by("speaker", F.struct("overlap", -F.col("t_pos"))).alias("speaker"))
    found = segments.join(best, (F.col("rec") == F.col("b_rec")) & (F.col("pos") == F.col("b_pos")), "left")
    return found.select(*segments.columns, F.coalesce("speaker", F.lit(UNKNOWN)).alias("speaker"))
