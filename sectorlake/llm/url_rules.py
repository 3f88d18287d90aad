"""URL filtering: nested host and path rules met by a sorted sweep over reversed-host keys."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: About as many keys give the range boundaries, whatever the input; they only balance the partitions.
BOUNDARY_SAMPLE = 20_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot: a host's key is a prefix of its subdomains' keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _boundaries(keys: DataFrame, buckets: int) -> np.ndarray:
    """At most buckets - 1 quantiles of about BOUNDARY_SAMPLE keys, picked by hash; a common key fills several."""
    share = BOUNDARY_SAMPLE / max(keys.count(), BOUNDARY_SAMPLE)
    picked = F.pmod(F.xxhash64("page_id", "key", F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30))
    found = np.sort(keys.where(picked).select("key").toPandas()["key"].to_numpy(dtype=object))
    if not len(found):
        return found
    return found[(np.arange(1, buckets) * len(found)) // buckets]


class _Paths:
    """The path rules of one host: a path's longest rule by a search in sorted order, whatever their number.

    A sweep over the sorted paths keeps a stack of those that enclose the next one, so each rule knows the
    longest one that is a prefix of its own.  Any rule that a path starts with encloses the last rule that
    is not behind it.
    """

    def __init__(self, host: str):
        self.host = host
        self.verdicts: dict[str, str] = {}
        self.paths: list[str] | None = None

    def add(self, path: str, verdict: str) -> None:
        self.verdicts[path] = "block" if "block" in (verdict, self.verdicts.get(path)) else verdict
        self.paths = None

    def longest(self, path: str) -> str | None:
        if self.paths is None:
            self.paths, self.outer, open_ = sorted(self.verdicts), [], []
            for k, own in enumerate(self.paths):
                while open_ and not own.startswith(self.paths[open_[-1]]):
                    open_.pop()
                self.outer.append(open_[-1] if open_ else -1)
                open_.append(k)
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.outer[k]
        return self.paths[k] if k >= 0 else None


def apply_rules(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", buckets: int | None = None
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` are (verdict, host, path).  A rule fits its host and all subdomains where the page's
    path starts with the rule's; of those that fit the longest host plus path wins (ties: longer
    host, then ``block``).  ``rule`` is host plus path of the winner, null where none fits, and
    then ``default`` is the verdict.  A null url or one without ``://`` has empty host and path.
    Repeated and null page_ids are judged row by row; other columns are ignored.

    Each rule is an interval of reversed-host keys.  Pages are dealt to key ranges by quantiles of
    a bounded sample, one common host over several ranges; a rule is sent to each range that its
    interval meets.  Each range is swept in key order with a stack of the hosts whose rules are open, so
    memory is that of the nested rules, not of the range.  On each open host a path finds its longest rule
    by a search in sorted order.  Very long urls are judged whole.
    """
    spark = pages.sparkSession
    buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parsed = parsed.withColumn("key", host_key(F.col("host")))
    bounds = _boundaries(parsed, buckets)

    def page_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = 0
        for p in batches:
            key = p["key"].to_numpy(dtype=object)
            lo, hi = np.searchsorted(bounds, key, "left"), np.searchsorted(bounds, key, "right")
            # A common key's rows take turns over its ranges, whatever their ids.
            turn = (np.arange(row, row + len(p))) % (hi - lo + 1)
            row += len(p)
            yield pd.DataFrame({"bucket": (lo + turn).astype(np.int32), "key": key, "kind": np.int32(1), "page_id": p["page_id"], "host": p["host"], "path": p["path"], "verdict": None})

    kind = dict(parsed.dtypes)["page_id"]
    schema = "bucket int, key string, kind int, page_id string, host string, path string, verdict string"
    dealt = parsed.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(page_bucket, schema)

    # A rule's interval is [key, key + the last code point]; ranges touched run from lo to hi.
    held = []
    for verdict, host, path in rules:
        key = ".".join(reversed(host.split("."))) + "."
        lo = int(np.searchsorted(bounds, key, "left")) if len(bounds) else 0
        hi = int(np.searchsorted(bounds, key + "\U0010ffff", "right")) if len(bounds) else 0
        held.append((lo, hi, key, host, path, verdict))
    spans = spark.createDataFrame(held, "lo int, hi int, key string, host string, path string, verdict string")
    opened = spans.select(
        F.explode(F.sequence("lo", "hi")).alias("bucket"), "key", F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("page_id"), "host", "path", "verdict",
    )
    swept = dealt.unionByName(opened).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "key", "kind")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, stack = None, []
        for p in batches:
            of, keys, kinds = p["bucket"].to_numpy(), p["key"].to_numpy(dtype=object), p["kind"].to_numpy()
            paths = p["path"].to_numpy(dtype=object)
            names, verdicts = np.full(len(p), None, object), np.full(len(p), default, object)
            new = np.ones(len(p), bool)
            new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])
            begins = np.flatnonzero(new)
            for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(p)], strict=True):  # rows of one key are judged together
                key = keys[lo]
                if of[lo] != bucket:
                    bucket, stack = of[lo], []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kinds[lo] == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, _Paths(p["host"].iloc[lo])))
                    for path, verdict in zip(paths[lo:hi], p["verdict"].iloc[lo:hi], strict=True):
                        stack[-1][1].add(path, verdict)
                    continue
                if not stack:
                    continue
                for k in range(lo, hi):
                    fits = [(len(own.host) + len(rule), len(own.host), own, rule) for _, own in stack if (rule := own.longest(paths[k])) is not None]
                    if fits:
                        _, _, own, rule = max(fits, key=lambda f: f[:2])
                        names[k], verdicts[k] = own.host + rule, own.verdicts[rule]
            pages_ = kinds == 1
            if pages_.any():
                yield pd.DataFrame({"page_id": p["page_id"][pages_], "host": p["host"][pages_], "path": p["path"][pages_], "rule": pd.Series(names[pages_], index=p.index[pages_], dtype=object), "verdict": verdicts[pages_]})

    judged = swept.mapInPandas(sweep, "page_id string, host string, path string, rule string, verdict string")
    return judged.withColumn("page_id", F.col("page_id").cast(kind))
