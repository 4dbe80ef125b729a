"""Delimited files in, CSV / JSON / Parquet out."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthtab.functions.columns import INTEGRAL, FRACTIONAL, col

HEAD_LINES = 50
HEAD_CHARS = 4096


def _width(line: str, delimiter: str) -> int:
    return len(next(csv.reader([line], delimiter=delimiter), []))


def delimiter_of(lines: list[str]) -> str:
    """Comma if it splits the header, else semicolon, else the delimiter that
    splits the first lines most evenly, else comma."""
    if not lines:
        return ","
    header = lines[0].lstrip("﻿")
    for delimiter in (",", ";"):
        if _width(header, delimiter) > 1:
            return delimiter
    sample, used = [], 0
    for line in lines:
        used += len(line) + 1
        if used > HEAD_CHARS and sample:
            break
        if line:
            sample.append(line)
    for delimiter in ("\t", "|", ":", " "):
        widths = {_width(line, delimiter) for line in sample}
        if len(widths) == 1 and widths.pop() > 1:
            return delimiter
    return ","


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of one file by its first lines; reads the head only."""
    return delimiter_of([r[0] for r in spark.read.text(path).head(HEAD_LINES)])


def file_heads(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, str]]:
    """Header line and delimiter of each file that has a line, from one job over all files.

    A second one looks at more lines of those whose header has neither comma
    nor semicolon.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"),
    ).where("at = 0")
    first = lines.groupBy("path").agg(F.min_by("value", "place").alias("header"), F.min("place").alias("first")).collect()
    odd = [(r["path"], r["first"]) for r in first if not any(_width(r["header"].lstrip("﻿"), d) > 1 for d in ",;")]
    heads: dict[str, list[tuple[int, str]]] = {}
    if odd:
        asked = F.broadcast(spark.createDataFrame(odd, "path string, first long"))
        for r in lines.join(asked, "path").where(F.col("place") < F.col("first") + HEAD_LINES).collect():
            heads.setdefault(r["path"], []).append((r["place"], r["value"]))
    more = {path: [line for _, line in sorted(found)] for path, found in heads.items()}
    return {unquote(r["path"]): (r["header"].strip(), delimiter_of(more.get(r["path"], [r["header"]]))) for r in first}


#: One dialect for reading and writing: quotes are doubled, an empty cell is null, a quoted empty cell is empty text.
DIALECT = {"header": True, "quote": '"', "escape": '"', "nullValue": "", "emptyValue": '""'}


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    max_rows: int | None = None,
    schema: str | T.StructType | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """A headed UTF-8 file (or folder of files in one dialect) with its delimiter detected.

    The whole input by default.  Give a ``schema`` for very large inputs: it
    saves the pass that infers the types.  Cells may hold line breaks, so a
    file is read by one task; ``multi_line=False`` splits large files that
    have none.
    """
    first = path if isinstance(path, str) else path[0]
    # The parser gives an empty cell ``nullValue`` and a quoted one ``emptyValue``: they must differ to be told apart.
    options = {**DIALECT, "nullValue": "\x00", "emptyValue": "", "multiLine": multi_line, "sep": detect_delimiter(spark, first)}
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.limit(max_rows) if max_rows is not None else df


def read_files(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """Headed files as one table: each file's own delimiter and header, columns matched by name.

    Files that share both are read together, so the plan grows with the
    number of layouts and not with that of files.  Cells are read as text, and
    a column gets one type over all files: the first that takes all its cells.
    A column that stays text is as written (``007``, ``1.50``).
    """
    layouts: dict[tuple[str, str], list[str]] = {}
    for path, head in sorted(file_heads(spark, paths).items()):
        layouts.setdefault(head, []).append(path)
    if not layouts:
        return spark.createDataFrame([], T.StructType())
    options = {**DIALECT, "nullValue": "\x00", "emptyValue": "", "multiLine": multi_line}
    out = None
    for (_, delimiter), same in layouts.items():
        more = spark.read.options(**options, sep=delimiter).csv(same)
        out = more if out is None else out.unionByName(more, allowMissingColumns=True)
    kinds = settled_types(out)
    return out.select(*(F.expr(f"try_cast({quoted(c)} as {kinds[c]})").alias(c) if c in kinds else col(c) for c in out.columns))


#: Types a text column may have, the narrowest first, with the look that their cells must have.
CELL_TYPES = {
    "int": r"^[+-]?[0-9]{1,10}$", "bigint": r"^[+-]?[0-9]{1,19}$", "double": r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$",
    "boolean": "^(?i)(true|false)$", "date": "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "timestamp": "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:.+$",
}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def settled_types(df: DataFrame) -> dict[str, str]:
    """The narrowest type that takes every cell of a text column, in one pass; none for columns that stay text."""
    names = df.columns
    counts = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]
    for i, c in enumerate(names):
        for kind, look in CELL_TYPES.items():
            fits = col(c).rlike(look) & F.expr(f"try_cast({quoted(c)} as {kind})").isNotNull()
            counts.append(F.count_if(fits).alias(f"{kind}{i}"))
    row = df.agg(*counts).first() if names else {}
    out = {}
    for i, c in enumerate(names):
        kind = next((k for k in CELL_TYPES if row[f"{k}{i}"] == row[f"n{i}"]), None)
        if kind and row[f"n{i}"]:
            out[c] = kind
    return out


def list_csv(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a ``.csv`` file or of every nested ``.csv`` below a folder."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(path)
    )
    return listing.select("path").orderBy("path")


# Field types of file schemas and the catalog types they map to.
FIELD_TYPES = {
    "string": "text",
    "number": "numeric",
    "integer": "numeric",
    "date": "datetime",
    "datetime": "datetime",
    "time": "datetime",
    "year": "numeric",
    "yearmonth": "datetime",
    "boolean": "boolean",
    "binary": "text",
    "object": "text",
    "array": "text",
    "geopoint": "text",
    "geojson": "text",
    "any": "text",
}


def catalog_type(field_type: str) -> str:
    """Catalog type of a field type; unknown names pass through."""
    return FIELD_TYPES.get(field_type, field_type)


def field_type(data_type: T.DataType) -> str:
    if isinstance(data_type, INTEGRAL):
        return "integer"
    if isinstance(data_type, FRACTIONAL):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.BinaryType):
        return "binary"
    if isinstance(data_type, T.ArrayType):
        return "array"
    if isinstance(data_type, (T.StructType, T.MapType)):
        return "object"
    return "string"


def infer_columns(df: DataFrame) -> DataFrame:
    """Name, description, catalog type; null ratio 0 for a required field, else unknown."""
    rows = [
        (
            i,
            f.name,
            (f.metadata or {}).get("comment", ""),
            catalog_type(field_type(f.dataType)),
            None if f.nullable else 0.0,
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "position int, column_name string, column_description string, data_type string, null_ratio double",
    )


# ---- export ---------------------------------------------------------------------


def guard_formulas(df: DataFrame) -> DataFrame:
    """Prefix text cells that a spreadsheet would run as a formula with ``'``."""
    changes = {
        f.name: F.when(col(f.name).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), col(f.name))).otherwise(col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(changes) if changes else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    guard_formulas(df).write.mode(mode).options(**DIALECT, **kept).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines with nulls kept and ISO dates."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def clean_columns(df: DataFrame) -> DataFrame:
    """Columns with cleaned names; repeated names get a number."""
    from synthtab.plans.spec import clean_name

    used: set[str] = set()
    names = []
    for name in df.columns:
        base = candidate = clean_name(name)
        number = 2
        while candidate.lower() in used:
            candidate = f"{base}_{number}"
            number += 1
        used.add(candidate.lower())
        names.append(candidate)
    return df.toDF(*names)
