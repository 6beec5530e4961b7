"""Proportional stratified interleaving into shards.

Rows are shuffled by a seeded hash within each source and ranked; a row's fractional rank is (rank - 1/2) / rows of its
source. Sorting all rows by fractional rank interleaves the sources in proportion, so any contiguous cut of that order
holds the mixture of the whole; shards are contiguous cuts of equal length (law ``rows``).

No rank is taken over a whole source or table. Rows are counted by (source, bucket), a bucket being a range of the hash;
a row's rank is the count of the buckets before its own plus its place in its own. The place of a row in the whole order
follows likewise from ranges of the fractional rank. Rows that are alike in all that tells rows apart are counted before
they are dealt, so no bucket holds more of them than one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.llm._session import cut

#: Rows that a bucket or range holds on average while there are fewer than MOST_BUCKETS of them.
BUCKET_ROWS, MOST_BUCKETS = 2000, 1 << 16
#: Hexadecimal digits of the digest by which rows are shuffled.
_DIGITS = 10


def interleave(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source") -> DataFrame:
    """One row per input row: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 length plus 1, ``text_crc32`` the unsigned checksum of its UTF-8 bytes; a null text
    counts as empty. A null source is a source of its own. Shards' row counts differ by one at most and ``slot`` numbers
    a shard's rows from 0. Rows are shuffled by a digest of seed, id and text (nulls count as empty), then by id,
    checksum and size; rows alike in all of these and in source are interchangeable. ``grown_shard`` is null: the law
    ``rows`` makes no promise about another shard count. An empty table gives an empty result; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(stratum_col).cast("string").alias("stratum"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.conv(F.left(digest, F.lit(_DIGITS)), 16, 10).cast("bigint").alias("h"),
    )
    alike = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")))
    total = alike.agg(F.sum("copies")).first()[0] or 0
    buckets = max(1, min(total // BUCKET_ROWS, MOST_BUCKETS))

    alike = alike.withColumn("bucket", F.shiftright(F.col("h") * buckets, 4 * _DIGITS))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = alike.groupBy("stratum", "bucket").agg(F.sum("copies").alias("here"))
    cells = cells.select(
        F.col("stratum").alias("s"),
        F.col("bucket").alias("b"),
        F.coalesce(F.sum("here").over(before), F.lit(0)).alias("earlier"),
        F.sum("here").over(Window.partitionBy("stratum")).alias("n"),
    )
    order = ["h", "id", "crc", "size"]
    ranked = alike.join(cells, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    up_to = F.sum("copies").over(Window.partitionBy("stratum", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("last", F.col("earlier") + up_to)
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last"))))
    # (rank - 1/2) / n in units of 1 / buckets, in whole numbers
    ranked = ranked.withColumn("range", F.expr(f"((2 * rank - 1) * {buckets}) div (2 * n)"))
    ranked = cut(ranked.select("id", "stratum", "size", "crc", "h", "rank", "n", "range"))

    counts = ranked.groupBy("range").agg(F.count("*").alias("here"))
    starts = counts.select(F.col("range").alias("k"), F.coalesce(F.sum("here").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier_ranges"))
    placed = ranked.join(F.broadcast(starts), F.col("range") == F.col("k"))  # MOST_BUCKETS rows at most
    fraction = (2 * F.col("rank") - 1) / (2 * F.col("n"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(fraction, "stratum", *order))
    placed = placed.withColumn("at", F.col("earlier_ranges") + within - 1)
    placed = placed.withColumn("shard", F.expr(f"(at * {shards}) div {max(total, 1)}"))
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"at - (shard * {total} + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
