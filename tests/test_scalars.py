import pytest
from pyspark.sql import functions as F

from turnweave.functions import scalars

TIMES = {
    0: "00:00", 0.999: "00:00", 15: "00:15", 59.999: "00:59", 60: "01:00", 3599.99: "59:59", 3600: "1:00:00", 3661.5: "1:01:01",
    86399: "23:59:59", 86400: "24:00:00", 360000: "100:00:00", -0.5: "00:00", -1: "59:59", -5: "59:55", -61.2: "58:59", -3601: "59:59",
}
STEMS = {
    "a.m4a": "a", "a.b.m4a": "a.b", ".m4a": ".m4a", "..b": "..b", "a..b": "a.", "a.": "a", ".a.b": ".a", "noext": "noext",
    "회의 1.m4a": "회의 1", "a.tar.gz": "a.tar",
}


def test_time_text(spark):
    rows = spark.createDataFrame([(float(s),) for s in TIMES], "s double").select(scalars.time_text(F.col("s"))).collect()
    assert [r[0] for r in rows] == list(TIMES.values())


def test_stem(spark):
    rows = spark.createDataFrame([(n,) for n in STEMS], "n string").select(scalars.stem(F.col("n"))).collect()
    assert [r[0] for r in rows] == list(STEMS.values())


@pytest.mark.parametrize("inner", ["", "a b", "​a﻿", "　"])
def test_strip_is_pythons(spark, inner):
    for c in scalars.WHITE_SPACE:
        assert c.isspace()
    text = scalars.WHITE_SPACE + inner + scalars.WHITE_SPACE
    assert len(scalars.WHITE_SPACE) == 29
    assert spark.createDataFrame([(text,)], "t string").select(scalars.strip(F.col("t"))).first()[0] == text.strip()


def test_decoded_name(spark):
    rows = spark.createDataFrame([("a%20b+c%25.json",)], "n string").select(scalars.decoded_name(F.col("n"))).first()
    assert rows[0] == "a b+c%.json"
