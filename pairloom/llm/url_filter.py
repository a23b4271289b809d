"""URL filter: a sort-merge range join of urls and rules.

A host is written label by label from the right (``www.example.org`` becomes
``org.example.www.``), so a rule for a host and all its subdomains is an interval
of keys: everything that begins with the rule's key. Urls and rules are dealt out
by ranges of (key, path, id); a rule goes to every range that its interval
touches. Inside a range one sorted sweep keeps the stack of rules whose interval
is open, and each url asks the stack from there. Nothing is paired up, no rule is
broadcast, and a host or a url that holds a third of all rows is cut into several
ranges because the id takes part in the bounds.

Defined cases: a null url, or one without ``://``, has an empty host and path and
no rule; an empty host fits no rule; several fitting rules: the longest (host and
path together) wins, then the longer host; the same rule given twice: block wins;
a rule with a null or empty host is ignored and a null path counts as empty;
repeated rows are judged each; other columns are not looked at.
"""

from __future__ import annotations

import string
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import in_batches, slots

# Sampled keys per range; they fix the bounds, not the result.
KEYS_PER_RANGE = 32


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased."""
    host = F.regexp_extract(rest_of(url), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """Path up to ``?``, ``#`` or the end."""
    return F.regexp_extract(rest_of(url), r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the right, each with a dot behind it; null for an empty host."""
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``rules``: host, path, verdict (allow or block). Result: id, host, path, rule, verdict."""
    spark = urls.sparkSession
    pages = urls.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    pages = pages.withColumn("key", F.coalesce(host_key(F.col("host")), F.lit("")))
    ranges = 2 * slots(spark)
    sample = pages.select("key", "path", F.coalesce("id", F.lit(0)).alias("id")).orderBy(F.xxhash64("id", "path"), "key").limit(ranges * KEYS_PER_RANGE)
    found = sorted((r.key, r.path, r.id) for r in sample.collect())
    bounds = sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []

    host = F.translate(F.col("host"), string.ascii_uppercase, string.ascii_lowercase)
    known = rules.select(host.alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"), F.col("verdict").alias("verdict"))
    known = known.where("host <> '' AND verdict IS NOT NULL").withColumn("key", host_key(F.col("host")))
    blank = F.lit(None).cast("string")
    both = pages.select("key", F.lit(1).alias("kind"), "id", "host", "path", blank.alias("verdict")).unionByName(
        known.select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "host", "path", "verdict")
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, row = [], []
            cols = [batch.column(n).to_pylist() for n in ("key", "kind", "id", "path")]
            for i, (key, kind, key_id, path) in enumerate(zip(*cols, strict=True)):
                if kind:
                    at.append(bisect_right(bounds, (key, path, key_id or 0)))
                    row.append(i)
                else:  # from the range where the interval opens to the one where it ends
                    low, high = bisect_right(bounds, (key,)), bisect_right(bounds, (key[:-1] + "/",))  # before any path and id
                    at.extend(range(low, high + 1))
                    row.extend([i] * (high + 1 - low))
            out = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *out.columns], names=["range", *out.schema.names])

    schema = "range int, key string, kind int, id long, host string, path string, verdict string"
    dealt = in_batches(both, deal, schema).repartition(slots(spark), "range").sortWithinPartitions("range", "key", "kind", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack = None, []  # open rules: key, {path: verdict}, rule host
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ids, hosts, paths, named, verdicts = [], [], [], [], []
            for at, key, kind, page, host, path, verdict in rows:
                if at != now:
                    now, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not kind:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, host))
                    held = stack[-1][1]
                    held[path] = "block" if "block" in (verdict, held.get(path)) else verdict
                    continue
                best = (0, 0, None, default)
                for _, held, of in stack:
                    for size in sorted({len(p) for p in held}, reverse=True):
                        if size <= len(path) and path[:size] in held:
                            best = max(best, (len(of) + size, len(of), of + path[:size], held[path[:size]]), key=lambda x: x[:2])
                            break
                ids.append(page), hosts.append(host), paths.append(path), named.append(best[2]), verdicts.append(best[3])
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            cols = [pa.array(c, k) for c, k in zip((ids, hosts, paths, named, verdicts), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "host", "path", "rule", "verdict"])

    return in_batches(dealt, sweep, f"{id_col} long, host string, path string, rule string, verdict string")
