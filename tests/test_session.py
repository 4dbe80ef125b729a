import os

import pytest
from pyspark.sql import functions as F

from synthtab.session import shared_folder, stage, staged_path, staging


def test_stage_uses_the_folder_the_session_names(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    df = spark.range(50).select(F.col("id").alias("odd name (x)"), F.lit("a").alias("b;c"))
    assert shared_folder(spark)
    staged = stage(df)
    assert staged.columns == df.columns and staged.dtypes == df.dtypes
    assert staged.exceptAll(df).count() == 0
    assert "FileScan parquet" in staged._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.checkpoint.dir", None) == before


def test_times_as_numbers_ignore_the_time_zone(spark):
    from synthtab.functions.columns import epoch_micros

    df = spark.sql(
        "select timestamp_ntz'2024-03-10 02:30:15.123456' as a, timestamp_ntz'1969-12-31 23:59:59.000001' as b, "
        "date'1960-02-29' as c"
    )
    expected = (1710037815123456, -999999, -310521600000000)
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert tuple(df.select(*[epoch_micros(df, c) for c in "abc"]).first()) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_staged_tables_go_with_their_owner(spark):
    before = stage(spark.range(10))
    with staging(spark):
        inside = stage(spark.range(20))
        path = staged_path(spark, "mine")
        spark.range(3).write.parquet(path)
        assert inside.count() == 20 and os.path.isdir(path)
    assert not os.path.exists(path) and before.count() == 10
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|FileNotFound"):
        inside.collect()
