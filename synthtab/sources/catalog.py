"""The catalog: domains, datasets, columns, profiles and cached answers.

The table operators at the top are plain DataFrame functions and scale with
the tables they are given; latest-wins rules are ``max_by`` aggregates, which
combine before the shuffle, so one source with most of the rows is no hot
spot.  :class:`Catalog` keeps the tables as Parquet in a shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthtab.plans.spec import ColumnSpec

STATS = ("mean", "std", "min", "max", "null_ratio")

SCHEMAS = {
    "domains": "id bigint, name string, description string, parent_domain_id bigint, created_at timestamp",
    "datasets": "id bigint, source string, source_url string, domain_id bigint, dataset_name string, "
    "row_count bigint, column_count bigint, crawled_at timestamp",
    "columns": "dataset_id bigint, column_name string, column_description string, data_type string, "
    "null_ratio double, distinct_count bigint, mean double, std double, min double, max double, "
    "sample_values string, position int",
    "profiles": "domain_id bigint, profile_json string",
    "cache": "cache_key string, model string, response string, created_at timestamp, expires_at timestamp",
}


def stable_id(text: Column) -> Column:
    """60-bit id from a natural key: the same on every run, no counter needed."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


# ---- table operators ---------------------------------------------------------------


def upsert_domains(domains: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add the names that are not there yet; existing rows stay as they are."""
    columns = domains.columns
    rest = [F.min_by(c, F.coalesce("description", F.lit(""))).alias(c) for c in incoming.columns if c != "name"]
    fresh = incoming.groupBy("name").agg(*rest).join(domains.select("name"), "name", "left_anti")
    fresh = fresh.withColumn("id", stable_id(F.col("name")))
    return domains.unionByName(fresh.select(*columns))


def upsert_datasets(datasets: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest row per ``source_url``; an existing id and source are kept."""
    columns = datasets.columns
    old = datasets.withColumn("age", F.lit(0))
    new = incoming.withColumn("id", stable_id(F.col("source_url"))).withColumn("age", F.lit(1))
    order = F.struct("age", "crawled_at", "dataset_name", "row_count")
    kept = ("id", "source")
    picks = [
        (F.min_by if c in kept else F.max_by)(F.col(c), order).alias(c)
        for c in columns
        if c != "source_url"
    ]
    both = old.unionByName(new.select(*columns, "age"))
    return both.groupBy("source_url").agg(*picks).select(*columns)


def list_datasets(datasets: DataFrame, domain_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; all of them, or the newest ``limit``."""
    if domain_id:
        datasets = datasets.filter(F.col("domain_id") == F.lit(domain_id))
    newest = datasets.orderBy(F.desc("crawled_at"), "id")
    return newest if limit is None else newest.limit(limit)


def put_columns(columns: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace per (dataset, column), so scanning a dataset again is idempotent."""
    names = columns.columns
    both = columns.withColumn("age", F.lit(0)).unionByName(incoming.select(*names).withColumn("age", F.lit(1)))
    keys = ("dataset_id", "column_name")
    order = F.struct("age", "data_type", "sample_values")
    picks = [F.max_by(F.col(c), order).alias(c) for c in names if c not in keys]
    return both.groupBy(*keys).agg(*picks).select(*names)


def merged_schema(domains: DataFrame, datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per (domain, column) over all datasets of the domain, newest first.

    The type comes from the newest dataset that has the column, each statistic
    from the newest one that knows it.  ``position`` orders the columns by
    first sighting.
    """
    wide = (
        columns.join(
            datasets.select(F.col("id").alias("dataset_id"), "domain_id", "crawled_at"), "dataset_id"
        )
        .join(domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain")), "domain_id")
    )
    # max_by takes the largest order: newest dataset, smallest id, first position
    newest = F.struct(F.col("crawled_at"), -F.col("dataset_id"), -F.col("position"))
    stats = [F.max_by(F.col(s), F.when(F.col(s).isNotNull(), newest)).alias(s) for s in STATS]
    return wide.groupBy("domain", "column_name").agg(
        F.max_by(F.col("data_type"), newest).alias("data_type"), *stats, F.max(newest).alias("seen")
    )


def catalog_counts(
    domains: DataFrame, datasets: DataFrame, columns: DataFrame, profiles: DataFrame
) -> DataFrame:
    tables = {"domains": domains, "datasets": datasets, "columns": columns, "profiles": profiles}
    counted = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counted).agg(
        *[F.sum(F.when(F.col("t") == n, F.col("n")).otherwise(F.lit(0))).alias(n) for n in tables]
    )


def upsert_profiles(profiles: DataFrame, incoming: DataFrame) -> DataFrame:
    """One profile per domain, the incoming one wins."""
    both = profiles.withColumn("age", F.lit(0)).unionByName(incoming.withColumn("age", F.lit(1)))
    order = F.struct("age", "profile_json")
    return both.groupBy("domain_id").agg(F.max_by("profile_json", order).alias("profile_json"))


def cache_key(text: Column) -> Column:
    """Key of a description: hash of its trimmed lower-case text."""
    return F.sha2(F.lower(F.trim(text)), 256)


def cache_put(cache: DataFrame, incoming: DataFrame) -> DataFrame:
    """The latest answer per key."""
    names = cache.columns
    order = F.struct("created_at", "response")
    picks = [F.max_by(F.col(c), order).alias(c) for c in names if c != "cache_key"]
    return cache.unionByName(incoming.select(*names)).groupBy("cache_key").agg(*picks).select(*names)


def cache_get(requests: DataFrame, cache: DataFrame, key: Column, now: Column, out: str = "response") -> DataFrame:
    """Left join of unexpired answers; ``key`` is the hashed key of a request.

    A key occurs once in the cache, so a key asked for by many requests only
    widens their rows.
    """
    live = cache.filter(F.col("expires_at") > now).select(
        F.col("cache_key").alias("_key"), F.col("response").alias(out)
    )
    return requests.join(live, key == F.col("_key"), "left").drop("_key")


# ---- stored catalog -------------------------------------------------------------------


class Catalog:
    """Catalog tables as Parquet below ``root``.

    Every change writes a new version folder next to the old one and reads go
    to the newest complete version, so a failed write leaves the table intact.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # storage

    def _folder(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _version(self, name: str) -> int:
        fs, path = self._folder(name)
        if not fs.exists(path):
            return 0
        found = [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        done = [p.getName() for p in found if fs.exists(jvm_path(p, "_SUCCESS"))]
        return max((int(n[1:]) for n in done if n[:1] == "v"), default=0)

    def table(self, name: str) -> DataFrame:
        version = self._version(name)
        if version == 0:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/v{version:08d}")

    def _save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{self._version(name) + 1:08d}")

    # domains

    def add_domain(self, name: str, description: str = "", parent_id: int | None = None) -> None:
        self.add_domains([(name, description, parent_id)])

    def add_domains(self, domains: Iterable[tuple]) -> None:
        """Rows of name, description and, where there is one, the parent's id."""
        full = [(*row, None)[:3] for row in domains]
        rows = self.spark.createDataFrame(full, "name string, description string, parent_domain_id bigint")
        rows = rows.withColumn("created_at", F.now())
        self._save("domains", upsert_domains(self.table("domains"), rows))

    def domain(self, name: str | None = None, id: int | None = None):
        match = F.col("name") == F.lit(name) if name is not None else F.col("id") == F.lit(id)
        return self.table("domains").filter(match).first()

    def domains(self) -> DataFrame:
        return self.table("domains").orderBy("name")

    # datasets

    def put_datasets(self, incoming: DataFrame) -> None:
        """Rows need every dataset column but ``id``."""
        self._save("datasets", upsert_datasets(self.table("datasets"), incoming))

    def dataset(self, id: int):
        return self.table("datasets").filter(F.col("id") == F.lit(id)).first()

    def datasets(self, domain: str | None = None, limit: int | None = None) -> DataFrame:
        if domain is None:
            return list_datasets(self.table("datasets"), None, limit)
        row = self.domain(domain)
        return list_datasets(self.table("datasets"), row["id"] if row else -1, limit)

    # columns

    def put_columns(self, incoming: DataFrame) -> None:
        self._save("columns", put_columns(self.table("columns"), incoming))

    def domain_specs(self, domain: str) -> list[ColumnSpec] | None:
        """The merged schema of a domain; None without the domain or its datasets."""
        if self.domain(domain) is None or self.datasets(domain, 1).first() is None:
            return None
        merged = merged_schema(
            self.table("domains").filter(F.col("name") == F.lit(domain)),
            self.table("datasets"),
            self.table("columns"),
        )
        rows = merged.orderBy(F.desc("seen")).collect()  # one row per column
        return [
            ColumnSpec.of({k: r[k] for k in ("column_name", "data_type", *STATS)}) for r in rows
        ]

    def counts(self) -> Mapping[str, int]:
        names = ("domains", "datasets", "columns", "profiles")
        return catalog_counts(*[self.table(n) for n in names]).first().asDict()

    # profiles

    def put_profile(self, domain: str, profile_json: str) -> None:
        row = self.domain(domain)
        if row is None:
            raise ValueError(f"unknown domain '{domain}'")
        incoming = self.spark.createDataFrame([(row["id"], profile_json)], SCHEMAS["profiles"])
        self._save("profiles", upsert_profiles(self.table("profiles"), incoming))

    def profile_json(self, domain: str) -> str | None:
        row = self.domain(domain)
        if row is None:
            return None
        found = self.table("profiles").filter(F.col("domain_id") == F.lit(row["id"])).first()
        return found["profile_json"] if found else None

    # cached answers

    def cache_put(self, incoming: DataFrame, ttl_days: int = 30) -> None:
        """Rows (cache_key, model, response) with hashed keys."""
        rows = incoming.withColumns(
            {"created_at": F.now(), "expires_at": F.now() + F.make_dt_interval(F.lit(ttl_days))}
        )
        self._save("cache", cache_put(self.table("cache"), rows))

    def cache_get(self, requests: DataFrame, key: Column, out: str = "response") -> DataFrame:
        return cache_get(requests, self.table("cache"), key, F.now(), out)
