"""Spelling variants of words by permuterm rotations.

A word is marked with a terminator, and every rotation of the marked word is taken: of ``cat$`` these are ``cat$``,
``at$c``, ``t$ca`` and ``$cat``. The edited character is a rotation's last one, so what an edit leaves is a prefix:

* words that differ by a replaced character have rotations that agree but for the last character (``t$ca`` and ``t$cu``);
* a word that lacks a character of another is a rotation that the other one's rotation continues (``t$c`` and ``t$ca``).

So each rotation is sorted under its prefix without the last character, which it skips, and under itself; a group of
equal prefixes is scanned once. All its members are near each other: those that skip differ in the skipped character,
and at most one word is there whole. A group has no more members than the alphabet has letters, whatever the corpus, and
its neighbours are counted and the best ones taken from its sorted members without making pairs.

Prefixes longer than ``TEXT`` characters are replaced by 128-bit fingerprints, computed for all rotations of a word in
linear time, so a word of any length is treated like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm._session import bounded, cut, prepare
from turnweave.llm._words import mix

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A near word gives a word its form if it is so many times as frequent.
RATIO = 10
END = "$"
#: Prefixes of up to so many characters are compared as texts.
TEXT = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip_every: int | None = None) -> DataFrame:
    """``word, n`` of the words of at least ``least_length`` characters that occur ``least_count`` times or more.

    A word is a maximal run of LETTERS, A-Z read as a-z. With ``slip_every``, typing slips are planted: where it divides
    the unsigned CRC-32 of ``id:word``, the word lacks the character at the CRC-32's remainder by the word's length. A null
    text has no words; a null id counts as empty. Every row counts, repeated ones too; an empty table gives an empty
    result; other columns are ignored.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[{LETTERS}]{{{least_length},}}+"), F.lit(0))
    f = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    f = f.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("word"))
    if slip_every:
        h = F.crc32(F.encode(F.concat_ws(":", "id", "word"), "UTF-8"))
        f = f.select("word", h.alias("h"))
        f = f.select("word", F.when(F.col("h") % slip_every == 0, (F.col("h") % F.char_length("word")).cast("int")).alias("lost"))
        slipped = F.expr("concat(left(word, lost), substr(word, lost + 2))")
        f = f.select(F.when(F.col("lost").isNull(), F.col("word")).otherwise(slipped).alias("word")).where(F.char_length("word") >= least_length)
    return f.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _rotations(words: DataFrame) -> DataFrame:
    """``prefix, id, n, skips, first``: the rotations of words (``id, word, n``) whose prefixes are at most TEXT long.

    ``skips`` tells a rotation without its last character from a whole one. Taking out any character of a run of equal
    ones leaves the same word; ``first`` marks one of these rotations.
    """
    marked = words.where(F.char_length("word") <= TEXT).select("id", "n", F.char_length("word").alias("size"), F.concat("word", F.lit(END)).alias("marked"))
    whole = "transform(sequence(0, size), i -> named_struct('prefix', concat(substr(marked, i + 1), left(marked, i)), 'skips', false, 'first', false))"
    skipping = """transform(slice(sequence(0, size), 2, size), i -> named_struct('prefix', concat(substr(marked, i + 1), left(marked, i - 1)), 'skips', true,
        'first', i = 1 OR substr(marked, i, 1) <> substr(marked, i - 1, 1)))"""
    each = marked.select("id", "n", F.explode(F.expr(f"concat({whole}, {skipping})")).alias("r"))
    return each.select("r.prefix", "id", "n", "r.skips", "r.first").where(F.char_length("prefix") <= TEXT)


def _fingerprints(text: str) -> tuple[list[str], list[str], np.ndarray]:
    """Fingerprints of a word's whole rotations, of those that skip their last character, and which of these are first."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(_U)
    size = len(codes)
    values = mix(codes * _U(_BASES[0]))
    end = mix(np.array([ord(END)], _U) * _U(_BASES[0]))
    halves: list[tuple[np.ndarray, np.ndarray]] = []
    for base in _BASES:
        powers = np.ones(size + 2, _U)
        powers[1:] = base
        powers = np.multiply.accumulate(powers, dtype=_U)
        inverse = np.ones(size + 2, _U)
        inverse[1:] = pow(base, -1, 1 << 64)
        inverse = np.multiply.accumulate(inverse, dtype=_U)
        sums = np.zeros(size + 1, _U)
        np.cumsum(values * powers[:size], dtype=_U, out=sums[1:])

        def rotated(start: np.ndarray, stop: np.ndarray, sums=sums, powers=powers, inverse=inverse) -> np.ndarray:
            """Of text[start:] + END + text[:stop]."""
            tail = size - start
            return mix((sums[size] - sums[start]) * inverse[start] + end * powers[tail] + sums[stop] * powers[tail + 1])

        at = np.arange(size + 1)
        halves.append((rotated(at, at), rotated(at[1:], at[:-1])))
    told = lambda k: [f"#{a:016x}{b:016x}" for a, b in zip(halves[0][k].tolist(), halves[1][k].tolist())]
    first = np.ones(size, bool)
    first[1:] = codes[1:] != codes[:-1]
    return told(0), told(1), first


_ROTATION = "prefix string, id string, n bigint, skips boolean, first boolean"
#: Rotations that a task hands on at a time.
_STEP = 10_000


def _long_rotations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rotations of (id, word, n) whose prefixes are longer than TEXT, by fingerprint."""
    for batch in batches:
        for name, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            whole, skipping, first = _fingerprints(word)
            # a prefix that skips is as long as the word, a whole rotation one longer
            skipping, first = (skipping, first) if len(word) > TEXT else ([], first[:0])
            prefixes, skips, firsts = whole + skipping, np.arange(len(whole) + len(skipping)) >= len(whole), np.concatenate([np.zeros(len(whole), bool), first])
            for at in range(0, len(prefixes), _STEP):
                part = slice(at, at + _STEP)
                size = len(prefixes[part])
                columns = [pa.array(prefixes[part]), pa.array([name] * size), pa.array([n] * size, pa.int64()), pa.array(skips[part]), pa.array(firsts[part])]
                yield pa.RecordBatch.from_arrays(columns, names=["prefix", "id", "n", "skips", "first"])


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, near, near_n`` of different words (``word, n``): how many words are near it, and the one of them
    with the largest n, of equal ones the first in code-point order; 0 and nulls if none is.

    Words are near if they differ by one inserted, deleted or replaced character.
    """
    prepare(words.sparkSession)
    is_long = F.char_length("word") > TEXT
    # a long word goes by its digest, or its rotations would hold the square of its length
    named = cut(words.select(F.when(is_long, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word")).alias("id"), "word", "n"))  # read for rotations, texts and words alone
    long = named.where(F.char_length("word") >= TEXT)
    texts = named.where(is_long).select(F.col("id").alias("long_id"), F.col("word").alias("long_word"))
    rotations = _rotations(named).unionByName(long.mapInArrow(bounded(_long_rotations), _ROTATION))
    member = F.struct((-F.col("n")).alias("m"), "id", "skips", "first")
    groups = rotations.groupBy("prefix").agg(F.sort_array(F.collect_list(member)).alias("g")).where("size(g) > 1")
    groups = groups.select("g", *(F.expr(sql).alias(name) for name, sql in (("n_skip", "size(filter(g, x -> x.skips))"), ("n_first", "size(filter(g, x -> x.first))"), ("of_long", "exists(g, x -> startswith(x.id, '#'))"))))
    each = groups.select("g", "n_skip", "n_first", "of_long", F.posexplode("g").alias("i", "x"))
    others = F.expr("CASE WHEN NOT x.skips THEN n_first WHEN x.first THEN size(g) - 1 ELSE n_skip - 1 END").cast("bigint")
    # of the sorted members the first that is another one is the best, unless names have to be told by their texts
    best = F.expr("if(of_long, null, if(i = 0, g[1], g[0]))")
    kind = "struct<m: bigint, word: string>"
    each = each.select("x", "g", "i", "of_long", others.alias("n_near"), F.when(best.isNotNull(), F.struct(best["m"].alias("m"), best["id"].alias("word"))).alias("best"))
    ties = each.where("of_long").select(F.col("x.id").alias("id"), F.expr("explode(filter(g, (y, j) -> j <> i AND y.m = if(i = 0, g[1].m, g[0].m)))").alias("y"))
    ties = ties.join(texts, F.col("y.id") == F.col("long_id"), "left").select("id", F.lit(0).cast("bigint").alias("n_near"), F.struct(F.col("y.m").alias("m"), F.coalesce("long_word", "y.id").alias("word")).cast(kind).alias("best"))
    alone = named.select("id", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast(kind).alias("best"))
    known = F.lit(None).cast("bigint").alias("n")
    found = alone.union(each.select("x.id", known, "n_near", "best")).union(ties.select("id", known, "n_near", "best"))
    found = found.groupBy("id").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    found = found.join(texts, F.col("id") == F.col("long_id"), "left")
    return found.select(F.coalesce("long_word", "id").alias("word"), "n", "n_near", F.col("best.word").alias("near"), (-F.col("best.m")).alias("near_n"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of different words (``word, n``).

    ``form`` is the near word of the largest n, of equal ones the first in code-point order, if it is at least ``ratio``
    times as frequent as the word, else null; ``root`` is where following forms ends, the word itself if it has none. An
    empty table gives an empty result; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least, or forms could lead in circles")
    enough = F.col("near_n") >= ratio * F.col("n")
    found = near_words(words.select("word", "n"))
    found = cut(found.select("word", F.when(enough, F.col("near")).alias("form"), "n", "n_near", F.when(enough, F.col("near_n")).alias("form_n")))
    # frequencies grow by the ratio at each step, which bounds a chain; each round doubles what a step leads over
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = found.where("form IS NOT NULL").agg(F.max("form_n"), F.min("n")).first()
    steps = 0 if most[0] is None else math.floor(math.log(most[0] / max(most[1], 1), ratio) + 1e-9)
    for _ in range(max(0, math.ceil(math.log2(steps))) if steps > 1 else 0):
        further = roots.select(F.col("word").alias("at"), F.col("root").alias("further"))
        roots = cut(roots.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root")))
    roots = roots.select(F.col("word").alias("of"), "root")
    return found.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
