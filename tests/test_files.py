import csv
import json

import pytest
from pyspark.sql import functions as F

import synthtab as st
from synthtab.sources import files


def write(path, text):
    path.write_text(text)
    return str(path)


@pytest.mark.parametrize("name, sep", [("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("bar", "|")])
def test_delimiters(spark, tmp_path, name, sep):
    rows = [["name", "age", "city"], ["Ann", "3", "x y"], ["Bob", "4", "z"]]
    path = write(tmp_path / f"{name}.csv", "\n".join(sep.join(r) for r in rows) + "\n")
    df = st.read_delimited(spark, path)
    assert df.columns == ["name", "age", "city"] and dict(df.dtypes)["age"] == "int"
    assert [r["city"] for r in df.collect()] == ["x y", "z"]
    assert st.read_delimited(spark, path, max_rows=1).count() == 1


def test_single_column_and_quoted_header(spark, tmp_path):
    assert st.read_delimited(spark, write(tmp_path / "one.csv", "word\nabc\ndef\n")).columns == ["word"]
    quoted = write(tmp_path / "q.csv", '"a,b";"c"\n1;2\n')
    assert files.detect_delimiter(spark, quoted) == ";"
    assert files.detect_delimiter(spark, write(tmp_path / "empty.csv", "")) == ","


def test_whole_input_by_default(spark, tmp_path):
    path = write(tmp_path / "long.csv", "a,b\n" + "1,2\n" * 10_500)
    assert st.read_delimited(spark, path).count() == 10_500


def test_listing(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name in ("a.csv", "b.txt", "sub/c.csv", "sub/deep/d.txt"):
        (tmp_path / name).write_text("x,y\n1,2\n")
    found = [r["path"] for r in st.list_csv(spark, str(tmp_path)).collect()]
    assert [p.rsplit("/", 1)[1] for p in found] == ["a.csv", "c.csv"]
    assert st.list_csv(spark, str(tmp_path / "a.csv")).count() == 1
    assert st.list_csv(spark, str(tmp_path / "b.txt")).count() == 0


def test_inferred_columns(spark):
    df = spark.sql("select 1 as i, 1.5D as d, 'x' as s, true as b, current_date() as t, array(1) as a, binary('x') as r")
    rows = {r["column_name"]: r for r in st.infer_columns(df).collect()}
    types = {n: r["data_type"] for n, r in rows.items()}
    assert types == {"i": "numeric", "d": "numeric", "s": "text", "b": "boolean", "t": "datetime", "a": "text", "r": "text"}
    assert rows["i"]["null_ratio"] == 0.0  # required
    nullable = st.infer_columns(spark.createDataFrame([(1,)], "i int")).first()
    assert nullable["null_ratio"] is None
    assert files.catalog_type("yearmonth") == "datetime" and files.catalog_type("odd") == "odd"


def test_formula_guard_and_csv(spark, tmp_path):
    df = spark.createDataFrame(
        [("=1+1", -5.0), ("+a", 1.0), ("-b", 2.0), ("@c", 3.0), ('say "hi"', 4.0), (None, None)], "s string, x double"
    )
    guarded = [r["s"] for r in st.guard_formulas(df).collect()]
    assert guarded == ["'=1+1", "'+a", "'-b", "'@c", 'say "hi"', None]
    path = str(tmp_path / "out")
    st.write_csv(df.coalesce(1), path)
    part = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    rows = list(csv.reader(part.open()))
    assert rows[0] == ["s", "x"] and rows[1] == ["'=1+1", "-5.0"] and rows[5][0] == 'say "hi"'


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "s string, x double").withColumn("t", F.lit("2024-01-02").cast("timestamp_ntz"))
    st.write_json(df, str(tmp_path / "j"))
    row = json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("*.json")))
    assert row == {"s": "a", "x": None, "t": "2024-01-02T00:00:00.000"}


def test_parquet_round_trip(spark, tmp_path):
    df = st.generate(spark, st.generic_schema("healthcare"), 50, 2)
    st.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).exceptAll(df).count() == 0


def test_clean_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["pr!ce", "price?", "%", "a b"])
    assert st.clean_columns(df).columns == ["prce", "price", "column", "a b"]
    twice = spark.createDataFrame([(1, 2)], ["a!", "a?"])
    assert st.clean_columns(twice).columns == ["a", "a_2"]


def test_text_comes_back_as_it_was(spark, tmp_path):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, ""), (4, None), (5, "a,b;c\td"), (6, '""'), (7, "back\\slash\\"), (8, " edge ")]
    df = spark.createDataFrame(rows, "id int, words string").coalesce(1)
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_delimited(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_all_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_text("id;size\n3;4.5\n")
    (tmp_path / "c.csv").write_text("id,name\nq,z\n")
    from synthtab.plans.jobs import READERS

    df = READERS["folder"](spark, str(tmp_path))
    assert sorted(df.columns) == ["id", "name", "size"] and sorted(r["id"] for r in df.collect()) == ["1", "2", "3", "q"]


def test_types_are_settled_over_all_layouts(spark, tmp_path):
    """A column that is text in one file keeps its cells as written in the others."""
    (tmp_path / "a.csv").write_text("id,v,n,d,t,b\n007,1.50,1,2024-01-02,2024-01-02 03:04:05,true\n,2.0,2,2024-1-3,,FALSE\n")
    (tmp_path / "b.csv").write_text("id;v;n;d\nX1;n/a;3000000000;2024-05-06\n")
    (tmp_path / "c 1.csv").write_text("n\tid\n2.5\t08\n\t09\n")
    (tmp_path / "empty.csv").write_text("")
    from synthtab.plans.jobs import READERS

    df = READERS["folder"](spark, str(tmp_path))
    kinds = dict(df.dtypes)
    assert kinds == {"id": "string", "v": "string", "n": "double", "d": "date", "t": "timestamp", "b": "boolean"}
    rows = sorted((r["id"] or "", r["v"] or "", r["n"] or 0) for r in df.collect())
    assert rows == [("", "2.0", 2.0), ("007", "1.50", 1.0), ("08", "", 2.5), ("09", "", 0), ("X1", "n/a", 3e9)]
    whole = files.read_files(spark, [str(tmp_path / "a.csv")])
    assert dict(whole.dtypes)["id"] == "int" and dict(whole.dtypes)["v"] == "double"
    assert files.read_files(spark, [str(tmp_path / "empty.csv")]).collect() == []


def test_heads_of_many_files_are_read_in_one_job(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i}.csv").write_text("a,b\n" if i % 2 else "a;b\n1;2\n")
    spark.sparkContext.setJobGroup("heads", "heads")
    try:
        heads = files.file_heads(spark, [str(tmp_path)])
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("heads")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted({d for _, d in heads.values()}) == [",", ";"] and len(heads) == 12
    assert len(jobs) <= 2  # adaptive execution runs the shuffle as a job of its own
