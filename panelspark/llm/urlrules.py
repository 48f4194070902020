"""URL filters as a sort-merge range join.

The canonical key of a url is its host with the labels reversed, each followed by a dot, then ``/`` and its path
(``net.example.www./en/7``).  A rule's host covers itself and all subdomains: the interval of keys from ``net.example.``
up to ``net.example/`` (``/`` is the character after ``.``).  Urls and interval starts are sorted by key in one sweep
that keeps a stack of the rules whose intervals are open; nested hosts give nested intervals.  An open rule fits if the
url's path starts with the rule's path; the longest wins: the longest host, then the longest path, then ``block``.

Distribution: the urls are cut into ranges at splits drawn by a hash sample of the rows (bounded: ``SAMPLE_PER_RANGE``
keys a range).  A hot key fills several equal splits, and its rows are dealt over all ranges that these delimit.  A
rule is given to each range that its interval meets: a range's start lies inside as many intervals as there are nested
hosts.  Each task sweeps its sorted rows as a stream, with the stack alone in memory.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the default;
a url has one verdict whatever its copies; null ids stay; without rules all get the default; an empty table gives an
empty result.  Other columns of the input are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
DEFAULT = "allow"
SAMPLE_PER_RANGE = 20
ROWS_PER_RANGE = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host between ``://`` and the first of ``/ ? #``, A-Z lower-cased; the path up to the first of ``? #``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def reversed_host(host: Column) -> Column:
    """``www.example.net`` → ``net.example.www.``; empty stays empty."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _dealer(splits: list[str]):
    """Give each row its range, or each of the ranges that a rule's interval meets."""
    marks = np.array(splits, dtype=object)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, upper = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("key", "upper"))
            low, high = np.searchsorted(marks, key, side="left"), np.searchsorted(marks, upper, side="right")
            rule = np.array(batch.column("rule").is_valid())
            # equal splits leave a choice of ranges, which the row's hash takes
            spin = batch.column("spin").to_numpy(zero_copy_only=False) % (high - low + 1)
            low, high = np.where(rule, low, low + spin), np.where(rule, high, low + spin)
            times = high - low + 1
            row = np.repeat(np.arange(len(key)), times)
            place = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int32()), *(out.column(c) for c in ("id", "host", "path", "key", "rule",
                                                                          "verdict"))],
                ["place", "id", "host", "path", "key", "rule", "verdict"])

    return deal


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, key, urls last): keep the stack of open rules, answer each url from its top down."""
    stack: list[tuple[str, list]] = []  # (host prefix, [(path, rule, verdict), longest path first])
    here = None
    for batch in batches:
        rows = batch.to_pydict()
        rules, verdicts = [], []
        for place, key, path, rule, verdict in zip(*(rows[c] for c in ("place", "key", "path", "rule", "verdict"))):
            if place != here:
                here, stack = place, []
            host = key.split("/", 1)[0]
            while stack and not host.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                if not stack or stack[-1][0] != host:
                    stack.append((host, []))
                stack[-1][1].append((path, rule, verdict))
                stack[-1][1].sort(key=lambda x: (-len(x[0]), x[2] != "block"))
                rules.append(None)
                verdicts.append(None)
                continue
            found = next((r for _, level in reversed(stack) for r in level if path.startswith(r[0])), None)
            rules.append(found[1] if found else None)
            verdicts.append(found[2] if found else None)
        url = pa.array([r is None for r in rows["rule"]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("host"), batch.column("path"), pa.array(rules, pa.string()),
             pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"]).filter(url)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id",
               url_col: str = "url", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(id, host, path, rule, verdict) of every url; ``rules`` has host, path, verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    # the path follows the host, so that a hot host's urls can be cut into ranges too
    urls = urls.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit("/"), F.col("path")))
    n = pages.count()
    ranges = max(1, -(-n // rows_per_range), min(n // 50, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # a bounded sample: about SAMPLE_PER_RANGE keys for each range, chosen by a hash of the rows
    odds = min(1.0, ranges * SAMPLE_PER_RANGE / max(n, 1))
    drawn = (urls.where(F.pmod(F.xxhash64(F.lit(10), "id", "key"), F.lit(1 << 30)) < int(odds * (1 << 30)))
             .select("key").sort("key").toPandas()["key"].tolist() if ranges > 1 else [])
    splits = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if len(drawn) >= ranges else []

    named = rules.dropna(subset=["host", "path", "verdict"])
    head = reversed_host(F.translate("host", _UPPER, _LOWER))
    id_type = urls.schema["id"].dataType
    events = urls.select("id", "host", "path", "key", F.col("key").alias("upper"), F.lit(None).cast("string").alias(
        "rule"), F.lit(None).cast("string").alias("verdict"), F.xxhash64("id", "key").alias("spin")).unionByName(
        named.select(F.lit(None).cast(id_type).alias("id"), F.lit("").alias("host"), "path", head.alias("key"),
                     F.concat(F.regexp_replace(head, r"\.$", ""), F.lit("/")).alias("upper"),
                     F.concat("host", "path").alias("rule"), "verdict", F.lit(0).cast("long").alias("spin")))
    kind = id_type.simpleString()
    placed = events.mapInArrow(_dealer(splits), f"place int, id {kind}, host string, path string, key string, "
                                                f"rule string, verdict string")
    ranged = placed.repartitionById(ranges, F.col("place")).sortWithinPartitions(
        "place", "key", F.col("rule").isNull())
    swept = ranged.mapInArrow(_sweep, f"id {kind}, host string, path string, rule string, verdict string")
    return swept.select(F.col("id").alias(id_col), "host", "path", "rule",
                        F.coalesce("verdict", F.lit(default)).alias("verdict"))
