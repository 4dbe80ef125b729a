"""URL filter: a trie over reversed host labels, each node with a trie over path segments.

Rules are ``(verdict, host, path)``.  A rule fits its host and all subdomains
where the url's path starts with the rule's path; the last segment of a rule
may be the start of a segment.  The longest rule (host and path together) wins,
then the longer host, then block; a url that no rule fits is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules of more bytes than this are joined instead of broadcast.
MOST_TRIE_BYTES = 64 << 20
DEFAULT = "allow"
Rule = tuple[str, str, str]


class Trie:
    """Children by label; ``paths``: children by whole segment, ``ends``: rules by the start of the segment after."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label holds a slash
            *segments, last = path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            ends = node.setdefault("/", {})
            # The same host and path twice: block stands.
            if ends.get(last, ("allow",))[0] == "allow":
                ends[last] = (verdict, host, path)

    def find(self, host: str, path: str) -> Rule | None:
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            inner = node.get("/")
            for n, segment in enumerate(segments):
                if inner is None:
                    break
                for last, rule in inner.get("/", {}).items() if len(inner.get("/", {})) <= len(segment) else self._starts(inner["/"], segment):
                    if segment.startswith(last) and (best is None or self._order(rule) > self._order(best)):
                        best = rule
                inner = inner.get(segment) if n < len(segments) - 1 else None
        return best

    @staticmethod
    def _starts(ends: dict, segment: str):
        return [(segment[:k], ends[segment[:k]]) for k in range(len(segment) + 1) if segment[:k] in ends]

    @staticmethod
    def _order(rule: Rule) -> tuple:
        return len(rule[1]) + len(rule[2]), len(rule[1]), rule[0] == "block"


def split_url(url: str = "url"):
    """Columns of host (A-Z lower-cased) and path; both empty for a null or a url without ``://``."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "(?s)^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def by_trie(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.find
        for batch in batches:
            found = [find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            rule = pa.array([r and r[1] + r[2] for r in found], pa.string())
            verdict = pa.array([r[0] if r else DEFAULT for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], [*batch.schema.names, "rule", "verdict"])

    return urls.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same answers for rules that are too many to broadcast: one join of distinct host and path pairs by host suffix."""
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    cut = F.split("path", "/")
    r = rules.select("verdict", F.col("host").alias("at"), F.col("path").alias("begins"))
    # Start of the path in the join key: a rule's whole segments.
    r = r.withColumn("whole", F.regexp_extract("begins", "(?s)^(.*)/", 1)).withColumn("deep", F.size(F.split("begins", "/")))
    asked = pairs.select("host", "path", F.explode(suffixes).alias("at"), cut.alias("cut"))
    asked = asked.select("host", "path", "at", F.posexplode(F.col("cut")).alias("k", "_"), "cut")
    asked = asked.select("host", "path", "at", (F.col("k") + 1).alias("deep"), F.array_join(F.slice("cut", F.lit(1), F.col("k")), "/").alias("whole"))
    fits = asked.join(r, ["at", "deep", "whole"]).where(F.startswith("path", "begins"))
    order = F.struct(F.length("at") + F.length("begins"), F.length("at"), (F.col("verdict") == "block").cast("int"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("verdict", F.concat("at", "begins").alias("rule")), order).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(DEFAULT)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, most_bytes: int = MOST_TRIE_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page.

    Rules as a list, or as a DataFrame of ``verdict, host, path`` that is
    collected only when it is measured to be smaller than ``most_bytes``.  A
    null or odd url has an empty host and path and is allowed; repeated rows
    give a row each; only ``page_id`` and ``url`` are read.
    """
    host, path = split_url()
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        clean = rules.select("verdict", F.lower("host").alias("host"), "path").where("verdict is not null and host is not null and path is not null")
        if (clean.agg(F.sum(F.length("host") + F.length("path") + 100)).first()[0] or 0) > most_bytes:
            return by_join(urls, clean)
        rules = [tuple(r) for r in clean.collect()]
    return by_trie(urls, [(v, h.lower(), p) for v, h, p in rules])
