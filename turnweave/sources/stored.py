"""Segments and turns kept in buckets of recordings, so that labelling them, once or many times, needs no shuffle.

Documents are read, checked and dealt by recording once. A table of them has as many files as buckets, a recording in one
of them; tables of equally many buckets meet bucket by bucket. A task then labels whole recordings, so this is for many
recordings of usual lengths; where one recording holds much of a table, label unkept rows, which are dealt by cells of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Keys of a join may be dealt by some of them: those that buckets are dealt by.
_BY_SOME_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: The column that is kept for ``rec``. A scan's own column loses its buckets where plans unite; a renamed one does not.
_KEPT = "recording"


def keep(rows: DataFrame, name: str, buckets: int, path: str | None = None, append: bool = False) -> None:
    """Write ``rec, ...`` as table ``name``, below ``path`` or in the warehouse; with ``append`` to the recordings there.

    An existing table is an error without ``append``; one of other buckets is with it. A recording must come whole in one
    call. ``buckets`` should leave some hundred MB in each.
    """
    if _KEPT in rows.columns:
        raise ValueError(f"a column is named {_KEPT}")
    dealt = rows.repartition(buckets, "rec").withColumnRenamed("rec", _KEPT)
    writer = dealt.write.bucketBy(buckets, _KEPT).sortBy(_KEPT).mode("append" if append else "errorifexists")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def session(spark: SparkSession) -> SparkSession:
    """A session that plans joins bucket by bucket, with the settings of ``spark``, which stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(_BY_SOME_KEYS, "false")
    return own


def kept(spark: SparkSession, name: str) -> DataFrame:
    """The rows of a table of ``keep``; read both sides of a join with one ``session``."""
    return spark.table(name).withColumnRenamed(_KEPT, "rec")
