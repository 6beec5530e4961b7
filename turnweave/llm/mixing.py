"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). Cell weights are raked to the targets of each marginal in turn
until all agree; a document then gets as many copies as its cell's ratio of fitted to observed tokens says: the whole
part for certain, and one more with the remaining probability. Every document of a cell has the same expectation, so
the expected tokens are the fitted mixture and as many as there were; no cell, however rare, scales the others.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm._session import cut, fresh, prepare
from turnweave.llm._words import lowered, separators, span_hash, windows, word_hashes

#: Cells that the driver fits by itself; beyond, the same sweeps run as DataFrame aggregations.
DRIVER_CELLS = 100_000
SWEEPS, TOLERANCE = 100, 1e-9
#: How far each marginal moves from its observed shares (1) towards equal ones (0).
TEMPER = {"source": 0.8, "lang": 0.9, "topic": 0.9}
#: Topics that are told apart, and the shares of all documents that have a word which can stand for one.
TOPICS, LEAST_SHARE, MOST_SHARE = 16, 0.01, 0.1
#: Words: whole runs of so many letters a-z and characters beyond ASCII.
WORD = r"[A-Za-z\x{80}-\x{10FFFF}]{5,}+"
_NO_LETTER = separators(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Hexadecimal digits of the digest that decides a row's fate.
_DIGITS = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z read as a-z."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, _UPPER, _LOWER)).otherwise(w))


def topic_words(docs: DataFrame, text_col: str = "text", topics: int | None = TOPICS) -> list[str]:
    """Words that stand for topics, learned from all documents.

    Of the words that between LEAST_SHARE and MOST_SHARE of the documents have, the ``topics`` that most have, of equal
    ones the first in code-point order; with None all of them. A document has some hundred different words, so that many
    / LEAST_SHARE bounds their number, whatever the table's size.
    """
    total = docs.count()
    counted = docs.select(F.explode(F.array_distinct(words(F.col(text_col)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = counted.where(F.col("n").between(LEAST_SHARE * total, MOST_SHARE * total))
    return [r["word"] for r in sorted(counted.collect(), key=lambda r: (-r["n"], r["word"].encode()))][:topics]


def topic(text: Column, topics: list[str]) -> Column:
    """The one of the words that a text has most often as a whole word, of equal ones the first; ``other`` if it has none."""
    if not topics:
        return F.lit("other")
    prepare(SparkSession.active())
    hashes, _ = word_hashes(pa.array(topics), _NO_LETTER)
    order = np.argsort(hashes)
    known, nth = hashes[order], order

    @F.arrow_udf("string")
    def most(column: pa.Array) -> pa.Array:
        best = np.zeros(len(column), np.int64)
        keys = [np.zeros(0, np.int64)]
        data, offsets = lowered(column)
        for rows, starts, ends, sums in windows(data, offsets, _NO_LETTER):
            found = span_hash(starts, ends, sums)
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = known[at] == found
            keys.append(rows[hit] * len(known) + nth[at[hit]])
        pairs, times = np.unique(np.concatenate(keys), return_counts=True)
        # most often, then first
        np.maximum.at(best, pairs // len(known), times * len(known) + len(known) - 1 - pairs % len(known))
        names = pa.array([*reversed(topics), "other"])
        return names.take(pa.array(np.where(best > 0, best % len(known), len(known))))

    return most(text)


def tokens(text: Column) -> Column:
    """Tokens of a text, estimated as a token per four UTF-8 bytes, and one at least."""
    return F.greatest(F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4), F.lit(1)).cast("double")


def tempered(observed: dict, exponent: float) -> dict:
    """Target shares: observed ones to a power, scaled to sum to 1."""
    powers = {k: v**exponent for k, v in observed.items()}
    total = sum(powers[k] for k in sorted(powers, key=str))
    return {k: v / total for k, v in powers.items()}


def fit(cells: dict[tuple, float], targets: list[dict], sweeps: int = SWEEPS) -> tuple[dict[tuple, float], float]:
    """Weights of the cells, from their tokens, whose marginals are the targets' shares of the whole; and how far the worst
    marginal then is from its target, as a share of the target.

    A value with target 0 gets weight 0. Targets that contradict each other, or whose cells are all empty, are met as
    nearly as the sweeps come, the last marginal best.
    """
    keys, total = list(cells), sum(cells.values())
    weights = np.array([cells[k] for k in keys], float)
    axes = []
    for axis, target in enumerate(targets):
        values = {v: n for n, v in enumerate(dict.fromkeys(k[axis] for k in keys))}
        axes.append((np.array([values[k[axis]] for k in keys], np.int64), np.array([target[v] * total for v in values])))
    worst = 0.0
    for _ in range(sweeps):
        worst = 0.0
        for code, target in axes:
            sums = np.bincount(code, weights=weights, minlength=len(target))
            met = sums > 0
            ratio = np.divide(target, sums, out=np.zeros(len(target)), where=met)
            worst = max([worst, *np.abs(ratio - 1)[met & (target > 0)], *(~met & (target > 0)).astype(float)])
            weights = weights * ratio[code]
        if worst < TOLERANCE:
            break
    return dict(zip(keys, weights.tolist())), float(worst)


def _complete(observed: dict, wanted: dict | None, exponent: float) -> dict:
    """Every observed value's target share. Values without one keep their observed share of the whole, and targets are
    scaled to the rest; if all that is wanted is 0, the others are scaled to the whole."""
    total = sum(observed.values())
    if wanted is None:
        return tempered({k: v / total for k, v in observed.items()}, exponent)
    free = sum(v / total for k, v in observed.items() if k not in wanted)
    given = sum(v for k, v in wanted.items() if k in observed)
    if not given and not free:
        raise ValueError("every value that the documents have has target 0")
    scale = (1 - free) / given if given else 0.0
    rest = 1.0 if given or not any(k in wanted for k in observed) else 1 / free
    return {k: wanted[k] * scale if k in wanted else v / total * rest for k, v in observed.items()}


def _checked(targets: dict[str, dict] | None, axes: dict[str, Column]) -> dict[str, dict]:
    for axis, wanted in (targets or {}).items():
        if axis not in axes:
            raise ValueError(f"there is no marginal {axis}")
        if bad := [k for k, v in wanted.items() if not (math.isfinite(v) and v >= 0)]:
            raise ValueError(f"targets of {axis} must be finite and not negative: {bad}")
    return targets or {}


def _fitted_by_sums(cells: DataFrame, axes: list[str], targets: dict[str, DataFrame], total: float, sweeps: int = SWEEPS) -> tuple[DataFrame, float]:
    """The sweeps of ``fit`` over a table of cells too large for the driver; targets are (value, share)."""
    fitted, worst = cells.withColumn("w", F.col("tokens")), 0.0
    for _ in range(sweeps):
        worst = 0.0
        for axis in axes:
            sums = fitted.groupBy(axis).agg(F.sum("w").alias("s"))
            wanted = F.col("share") * total
            ratio = F.when(F.col("s") > 0, wanted / F.col("s")).otherwise(F.lit(0.0))
            gap = F.when(F.col("share") > 0, F.abs(ratio - 1)).otherwise(F.lit(0.0))
            ratios = sums.join(targets[axis], sums[axis].eqNullSafe(F.col("value"))).select(F.col(axis).alias("_v"), ratio.alias("ratio"), gap.alias("gap"))
            fitted = fitted.join(ratios, fitted[axis].eqNullSafe(F.col("_v"))).withColumn("w", F.col("w") * F.col("ratio"))
            fitted = cut(fitted.select(*axes, "tokens", "w", "gap"))
            worst = max(worst, fitted.agg(F.max("gap")).first()[0] or 0.0)
            fitted = fitted.drop("gap")
        if worst < TOLERANCE:
            break
    return fitted, worst


def mix(
    docs: DataFrame,
    axes: dict[str, Column] | None = None,
    targets: dict[str, dict] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 11,
    driver_cells: int = DRIVER_CELLS,
    name: str = "mix",
    sweeps: int = SWEEPS,
    strict: bool = False,
) -> DataFrame:
    """The input's columns plus a struct ``name`` of ``tokens, weight, probability, sampled, copies``.

    ``axes`` names the marginals (by default source, lang and topic); ``targets`` may give a marginal's shares by value,
    otherwise observed shares are tempered by TEMPER. Values with target 0 go; values that no document has are passed over;
    values without a target keep their share. If the marginals do not agree after ``sweeps`` sweeps, as when targets
    contradict each other, a warning tells by how much, or with ``strict`` an error. A null value is a value of its own.
    ``weight`` is the cell's ratio
    of fitted to observed tokens. ``copies`` is its whole part, and one more if the digest of the row's seed, id and text
    (nulls count as empty) falls below the rest, so a row's fate does not depend on partitions, and repeated rows share
    theirs. ``sampled`` says that there is a copy, ``probability`` how likely that is: the weight, 1 at most. An empty
    table gives an empty result. If an input column has the struct's name, the struct gets underscores after it
    (``fresh``); the input's columns stay as they are.
    """
    name = fresh(docs.columns, name)
    text = F.col(text_col)
    axes = axes or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(text, topic_words(docs, text_col))}
    targets = _checked(targets, axes)
    names = [f"_axis_{a}" for a in axes]
    keep = [F.col(f"`{c}`") for c in docs.columns]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    draw = F.conv(F.left(digest, F.lit(_DIGITS)), 16, 10).cast("bigint") / float(1 << 4 * _DIGITS)
    whole = docs.select(F.struct(*keep).alias("_row"), *(v.cast("string").alias(n) for n, v in zip(names, axes.values())), tokens(text).alias("_tokens"), draw.alias("_draw"))
    cells = cut(whole.groupBy(*names).agg(F.sum("_tokens").alias("tokens")))
    n_cells = cells.count()
    if n_cells <= driver_cells:
        observed = {tuple(r[n] for n in names): r["tokens"] for r in cells.collect()}  # driver_cells rows at most
        shares = []
        for axis, of in enumerate(axes):
            sums: dict = {}
            for key in sorted(observed, key=str):
                sums[key[axis]] = sums.get(key[axis], 0.0) + observed[key]
            shares.append(_complete(sums, targets.get(of), TEMPER.get(of, 1.0)))
        fitted, worst = fit({k: observed[k] for k in sorted(observed, key=str)}, shares, sweeps)
        schema = ", ".join(f"{n} string" for n in names) + ", weight double"
        ratios = docs.sparkSession.createDataFrame([(*k, w / observed[k]) for k, w in fitted.items()], schema)
    else:
        total = cells.agg(F.sum("tokens")).first()[0]
        by_axis = {}
        for of, column in zip(axes, names):
            sums = cells.groupBy(F.col(column).alias("value")).agg((F.sum("tokens") / total).alias("seen"))
            if wanted := targets.get(of):
                given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in wanted.items()], "given string, wanted double")
                sums = sums.join(given, F.col("value").eqNullSafe(F.col("given")), "left")
                given, free, some = sums.agg(F.coalesce(F.sum("wanted"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("wanted").isNull(), F.col("seen"))), F.lit(0.0)), F.count("wanted")).first()
                if not given and not free:
                    raise ValueError("every value that the documents have has target 0")
                scale, rest = (1 - free) / given if given else 0.0, 1.0 if given or not some else 1 / free
                share = F.coalesce(F.col("wanted") * scale, F.col("seen") * rest)
            else:
                power = F.pow("seen", F.lit(TEMPER.get(of, 1.0)))
                share = power / F.lit(sums.agg(F.sum(power)).first()[0])
            by_axis[column] = cut(sums.select("value", share.alias("share")))
        fitted, worst = _fitted_by_sums(cells, names, by_axis, total, sweeps)
        ratios = fitted.select(*names, (F.col("w") / F.col("tokens")).alias("weight"))
    if worst >= TOLERANCE:
        told = f"marginals are still {worst:.3g} of a target apart after {sweeps} sweeps"
        if strict:
            raise ValueError(told)
        warnings.warn(told, stacklevel=2)
    ratios = ratios.select(*(F.col(n).alias(f"{n}_") for n in names), "weight")
    if n_cells <= driver_cells:
        ratios = F.broadcast(ratios)
    same = None
    for n in names:
        here = F.col(n).eqNullSafe(F.col(f"{n}_"))
        same = here if same is None else same & here
    probability = F.least(F.col("weight"), F.lit(1.0))
    certain = F.floor("weight")
    copies = certain + (F.col("_draw") < F.col("weight") - certain).cast("bigint")
    return whole.join(ratios, same).select("_row.*", F.struct(F.col("_tokens").alias("tokens"), "weight", probability.alias("probability"), (copies > 0).alias("sampled"), copies.alias("copies")).alias(name))


def repeated(mixed: DataFrame, name: str = "mix") -> DataFrame:
    """The rows of ``mix``, each as often as it has copies, without the struct."""
    keep = [F.col(f"`{c}`") for c in mixed.columns if c != name]
    nth = fresh(mixed.columns, "_copy")
    n = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(f"{name}.copies")))
    return mixed.where(F.col(f"{name}.copies") > 0).select(*keep, n.alias(nth)).drop(nth)
