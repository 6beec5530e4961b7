"""Rule bitmask ledger for document quality.

``ledger`` evaluates every rule once and stores the measurements and one failure bit per rule. A policy is a versioned
mask of rules that reject; ``apply_policy`` and ``ablations`` work on the bits alone, so a new policy or the effect of
dropping a rule needs no second look at the texts. Built-in functions only; the scan is the only stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm._session import fresh, pinned

#: Rules in bit order: name, SQL condition over the measurements that fails a document.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeat_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("dup_lines", "10 * n_dup_lines > 4 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
)
BIT = {name: 1 << n for n, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": BIT["few_words"] | BIT["repeat_words"],
    "v1": sum(BIT.values()),
}
BASE_MASK = POLICIES["base"]

_SPACE = r"[\x20\x09-\x0D]+"


def _measure(frame: DataFrame) -> DataFrame:
    """Measurements of ``_text``. Columns are added step by step since each array is used by several later ones."""
    trimmed = F.btrim("_text", F.lit(" \t\n\x0b\x0c\r"))
    frame = frame.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE)))
    frame = frame.withColumn("n_words", F.size("_words").cast("bigint"))
    frame = frame.withColumn(
        "_windows",
        F.expr("CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) END"),
    )
    # equal windows side by side, with their places; only for texts that have any
    frame = frame.withColumn(
        "_sorted",
        F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i))) END"),
    )
    frame = frame.withColumn("_again", F.expr("filter(_sorted, (e, k) -> coalesce(e.h = get(_sorted, k - 1).h, false) OR coalesce(e.h = get(_sorted, k + 1).h, false))"))
    repeated = F.expr("size(array_distinct(flatten(transform(_again, e -> array(e.i, e.i + 1, e.i + 2)))))")
    frame = frame.withColumn("_lines", F.expr(r"filter(split(_text, '\n'), l -> length(btrim(l, ' \t\n\x0b\x0c\r')) > 0)".replace(r"\x0b", "\x0b").replace(r"\x0c", "\x0c")))
    return frame.select(
        "*",
        F.expr("aggregate(_words, 0L, (n, w) -> n + char_length(w))").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"\p{L}+", ""))).cast("bigint").alias("n_letters"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_sorted").isNull(), 0).otherwise(repeated).cast("bigint").alias("n_repeat_words"),
    )


MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_letters", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, text_col: str = "text", name: str = "ledger") -> DataFrame:
    """The input's columns plus a struct ``name`` of ``fail_bits`` and the measurements.

    A null text has no words and fails ``few_words``, as does an empty one. Words are runs of anything but U+0020 and
    U+0009-000D; repeated windows of three words are found by a 64-bit hash of the words. Repeated rows are measured each.
    An empty table gives an empty result. If an input column has the struct's name, the struct gets underscores after it
    (``fresh``); the input's columns stay as they are.
    """
    name = fresh(docs.columns, name)
    keep = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*keep).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    measured = _measure(whole)
    bits = F.lit(0)
    for rule, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), BIT[rule]).otherwise(0))
    return measured.select("_row.*", F.struct(pinned(bits).alias("fail_bits"), *MEASUREMENTS).alias(name))


def passes(version: str, name: str = "ledger") -> Column:
    """Whether a policy keeps a row, by the ledger in the struct ``name``."""
    return F.col(f"{name}.fail_bits").bitwiseAND(POLICIES[version]) == 0


def apply_policy(ledgered: DataFrame, version: str, name: str = "ledger") -> DataFrame:
    """The rows that a policy keeps, without their ledger."""
    return ledgered.where(passes(version, name)).drop(name)


def ablations(ledgered: DataFrame, version: str, name: str = "ledger") -> DataFrame:
    """For each rule of a policy: rows it fails, rows that only it rejects (kept again if it were dropped), and the
    rows, rejected rows and union of failure bits of the whole table. One pass over the bits; the first aggregation
    leaves a row per bit pattern, at most 2 to the power of the number of rules."""
    mask = POLICIES[version]
    patterns = ledgered.groupBy(F.col(f"{name}.fail_bits").alias("bits")).agg(F.count("*").alias("n"))
    whole = F.struct(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(mask) != 0, F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.bit_or("bits"), F.lit(0)).alias("any_bits"),
    )
    of_rule = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(BIT[rule]) != 0, F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(mask) == BIT[rule], F.col("n"))), F.lit(0)).alias("only_this"),
        )
        for rule, _ in RULES
        if BIT[rule] & mask
    ]
    return patterns.agg(whole.alias("whole"), F.array(*of_rule).alias("rules")).select(F.inline("rules"), F.col("whole")).select("rule", "failed", "only_this", "whole.*")
