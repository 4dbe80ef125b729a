"""Jobs over many sources: scan into the catalog, fingerprint, store profiles."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from synthtab.operators.describe import profile_sources
from synthtab.operators.profile import Fingerprint, fingerprint
from synthtab.plans.imperfections import SEED_DOMAINS, default_profile, merge_profile, save_profile
from synthtab.session import stage
from synthtab.sources.catalog import Catalog, stable_id
from synthtab.sources.files import infer_columns, list_csv, read_delimited, read_files

logger = logging.getLogger(__name__)

# (kind, path, label); kinds other than these are skipped
Source = tuple[str, str, str]


def _read_path(spark: SparkSession, path: str) -> DataFrame:
    # text is parsed once; the many later passes read the columns they need
    return stage(read_delimited(spark, path))


def _read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV below a folder as one table; files may differ in delimiter and columns."""
    files = [r["path"] for r in list_csv(spark, path).collect()]  # names only
    if not files:
        raise FileNotFoundError(f"no .csv below {path}")
    return stage(read_files(spark, files))


def _read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {"url": _read_path, "folder": _read_folder, "parquet": _read_parquet}


def scan_source(spark: SparkSession, path: str, kind: str = "url") -> DataFrame:
    """Catalog column rows of one source: inferred types joined with measured statistics."""
    return _column_rows(spark, {path: READERS[kind](spark, path)})


def _column_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Catalog column rows of all tables, by path; the tables are measured together."""
    inferred = [infer_columns(df).drop("null_ratio").withColumn("source", F.lit(path)) for path, df in tables.items()]
    measured = profile_sources(tables).drop("column_name")
    rows = reduce(DataFrame.unionByName, inferred).join(measured, ["source", "position"])
    return rows.withColumn("dataset_id", stable_id(F.col("source")))


def _measured(spark: SparkSession, tables: Mapping[str, DataFrame]) -> list[Row]:
    """Column rows of all tables that can be read; one job for all, table by table only where that fails."""
    try:
        return _column_rows(spark, tables).collect() if tables else []  # one row per column
    except Exception as error:
        if len(tables) == 1:
            logger.warning("scan of %s failed: %s", next(iter(tables)), error)
            return []
        return [row for path, df in tables.items() for row in _measured(spark, {path: df})]


def scan_sources(catalog: Catalog, sources: Mapping[str, Iterable[Source]]) -> DataFrame:
    """Scan every source of every domain into the catalog.

    All sources are measured in the same jobs.  Returns (domain, label,
    status) with ``ok``, ``failed`` or ``skipped``; one failing source never
    stops the others.
    """
    spark = catalog.spark
    catalog.add_domains([(d, SEED_DOMAINS.get(d, "")) for d in sources])
    entries = [(domain, *entry) for domain, some in sources.items() for entry in some]
    tables: dict[str, DataFrame] = {}
    for _, kind, path, _ in entries:
        if kind in READERS and path not in tables:
            try:
                tables[path] = READERS[kind](spark, path)
            except Exception as error:
                logger.warning("%s cannot be read: %s", path, error)
    rows = _measured(spark, tables)
    counts = {r["source"]: r["rows"] for r in rows}
    results, datasets = [], []
    for domain, kind, path, label in entries:
        if kind not in READERS:
            results.append((domain, f"{kind}:{path}", "skipped"))
        elif path not in counts:
            results.append((domain, label, "failed"))
        else:
            domain_id = catalog.domain(domain)["id"]
            datasets.append((kind, path, domain_id, label, counts[path], len(tables[path].columns)))
            results.append((domain, label, "ok"))
    if datasets:
        incoming = spark.createDataFrame(
            datasets,
            "source string, source_url string, domain_id bigint, dataset_name string, "
            "row_count bigint, column_count bigint",
        ).withColumn("crawled_at", F.now())
        catalog.put_datasets(incoming)
        catalog.put_columns(spark.createDataFrame(rows, COLUMN_ROWS))
    return spark.createDataFrame(results, "domain string, label string, status string")


#: What ``_column_rows`` gives; the catalog takes the columns it knows.
COLUMN_ROWS = (
    "source string, position int, column_name string, column_description string, data_type string, rows bigint, null_ratio double, "
    "distinct_count bigint, mean double, std double, min double, max double, sample_values string, dataset_id bigint"
)


def fingerprint_csv(spark: SparkSession, path: str, domain: str = "", dataset: str = "") -> Fingerprint | None:
    """Fingerprint of a delimited file; None if it cannot be read."""
    try:
        return fingerprint(_read_path(spark, path), domain, dataset)
    except Exception as error:
        logger.warning("could not analyse %s: %s", path, error)
        return None


def fingerprint_domain(catalog: Catalog, domain: str, newest: int | None = None) -> list[Fingerprint]:
    """Fingerprints of all datasets of a domain, or of the newest; failures are skipped."""
    found = []
    for row in catalog.datasets(domain, newest).collect():
        try:
            df = READERS[row["source"]](catalog.spark, row["source_url"])
            found.append(fingerprint(df, domain, row["dataset_name"]))
        except Exception as error:
            logger.warning("analysis of %s failed: %s", row["dataset_name"], error)
    return found


def analyze_domains(
    catalog: Catalog, domains: Iterable[str] | None = None, dry_run: bool = False
) -> list[str]:
    """Measure every domain and store its profile; the default where nothing could be measured."""
    names = list(domains) if domains is not None else list(SEED_DOMAINS)
    if dry_run:
        return names
    for name in names:
        measured = fingerprint_domain(catalog, name)
        profile: dict = {} if measured else default_profile(name)
        for one in measured:
            profile = merge_profile(profile, one)
        save_profile(catalog, name, profile)
    return names


def list_profiles(catalog: Catalog) -> DataFrame:
    """Domains with the number of their datasets and whether a profile is stored."""
    counts = catalog.table("datasets").groupBy("domain_id").agg(F.count("*").alias("datasets"))
    stored = catalog.table("profiles").select(F.col("domain_id"), F.lit(True).alias("stored"))
    return (
        catalog.table("domains")
        .withColumnRenamed("id", "domain_id")
        .join(counts, "domain_id", "left")
        .join(stored, "domain_id", "left")
        .select(
            "name",
            F.coalesce("datasets", F.lit(0)).alias("datasets"),
            F.coalesce("stored", F.lit(False)).alias("has_profile"),
        )
        .orderBy("name")
    )


def scan_and_analyze(
    catalog: Catalog, sources: Mapping[str, Iterable[Source]], kind: str = "all", dry_run: bool = False
) -> dict:
    """Scan, then fingerprint every domain (the fingerprints are returned, not stored)."""
    wanted = {
        d: [s for s in entries if kind == "all" or s[0] == kind] for d, entries in sources.items()
    }
    wanted = {d: entries for d, entries in wanted.items() if entries}
    if dry_run:
        return {"sources": sum(len(e) for e in wanted.values()), "domains": len(wanted)}
    status = scan_sources(catalog, wanted)
    tally = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    prints = {d: fingerprint_domain(catalog, d) for d in wanted}
    return {
        "status": tally,
        "fingerprints": {d: p for d, p in prints.items() if p},
        "counts": dict(catalog.counts()),
    }
