"""Generation and MCAR nulls are stateless, so streams work unchanged."""

from pyspark.sql import functions as F

import synthtab as st


def test_stream_equals_batch(spark, tmp_path, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey")
    source = str(tmp_path / "in")
    orders.repartition(3).write.parquet(source)

    def work(df):
        specs = [st.ColumnSpec("price", "numeric", mean=5.0), st.ColumnSpec("city")]
        made = st.generate_columns(df, specs, "o_orderkey", F.col("o_orderkey") + 1, 3, keep=["o_orderkey"])
        return st.inject_nulls(made, {"null_patterns": {"city": {"null_pct": 20.0, "pattern": "MCAR"}}}, "o_orderkey", 3)

    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    query = (
        work(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination(120)
    expected = work(orders)
    got = spark.read.parquet(out)
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0
