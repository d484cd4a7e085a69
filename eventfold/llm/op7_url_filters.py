"""URL filters over a sorted digest array.

A rule list becomes one file: the rules' 64-bit xxhash digests in ascending order, the ends of the
rules' strings, their verdicts, the numbers of labels of their hosts and the lengths of their paths, and the
strings themselves. A worker maps the file into memory and probes it with a vectorised binary search; a hit
counts only when the stored full string equals the probed one, so a collision of digests cannot decide anything.
A url's candidates are the host's suffixes of as many labels, and the path's prefixes of such a length, as
rules have.

The list is broadcast while its file is at most ``BROADCAST_BYTES``. A larger one, ``judge_by_shards``, is cut by
ranges of the digest into files of about ``SHARD_RULES`` rules, each of which is mapped by the task that the
candidates of its range go to. Both ways find the same.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and gets the
default verdict. An empty table gives no rows, an empty rule list lets every url have the default.
Repeated rows and equal urls are judged alike. A rule given with both verdicts blocks. Columns of the input named
like the results are replaced. Ties cannot occur: rules are unique strings, and of two rules that fit, the longer
(in UTF-8) wins; for equal lengths the greater string does.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.common import Written, add_columns, join_groups, map_rows, map_stream, table

#: Largest index file that is broadcast to the executors.
BROADCAST_BYTES = 64 << 20
#: Rules in a shard of a larger list, at most twice as many, and candidates probed at a time.
SHARD_RULES, PROBED = 1 << 18, 20_000
#: The rule list of the registered query: (verdict, rule).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DEFAULT = "allow"


def build_index(rules) -> bytes:
    """The index file's bytes from pairs (verdict, rule): numbers of rules, label counts and path lengths, then digests
    (sorted), ends of strings, label counts, path lengths, verdicts, strings."""
    unique: dict[str, bool] = {}
    for verdict, rule in rules:
        unique[rule] = unique.get(rule, True) and verdict == "allow"
    rows = sorted((xxhash.xxh64_intdigest(rule.encode()), rule.encode(), allow) for rule, allow in unique.items())
    labels, paths = (np.array(sorted(set(x)), "<i8") for x in zip(*map(shape, unique), strict=True)) if unique else (np.zeros(0, "<i8"),) * 2
    return b"".join([
        np.array([len(rows), len(labels), len(paths)], "<i8").tobytes(), np.array([r[0] for r in rows], "<u8").tobytes(),
        np.cumsum([len(r[1]) for r in rows], dtype="<i8").tobytes() if rows else b"", labels.tobytes(), paths.tobytes(),
        np.array([r[2] for r in rows], "u1").tobytes(), b"".join(r[1] for r in rows),
    ])


def shape(rule: str) -> tuple[int, int]:
    """Labels of a rule's host, and characters of its path."""
    host, _, path = rule.partition("/")
    return host.count(".") + 1, len(path) + 1


class DigestIndex:
    """A memory-mapped index file."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile(dir=os.environ.get("TMPDIR")) as f:  # the mapping outlives the name
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, labels, paths = (int(x) for x in np.frombuffer(self.map, "<i8", 3))
        self.keys = np.frombuffer(self.map, "<u8", n, 24)
        self.ends = np.frombuffer(self.map, "<i8", n, 24 + 8 * n)
        self.labels = np.frombuffer(self.map, "<i8", labels, 24 + 16 * n).tolist()
        self.path_lengths = np.frombuffer(self.map, "<i8", paths, 24 + 16 * n + 8 * labels).tolist()
        at = 24 + 16 * n + 8 * (labels + paths)
        self.allow = np.frombuffer(self.map, "u1", n, at)
        self.base = at + n

    def string(self, i: int) -> bytes:
        return self.map[self.base + (int(self.ends[i - 1]) if i else 0) : self.base + int(self.ends[i])]

    def find(self, strings: list[bytes]) -> np.ndarray:
        """Each string's row in the index, -1 for none. Rows of equal digests are compared one after another."""
        digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), "<u8", len(strings))
        at, stop = np.searchsorted(self.keys, digests), np.searchsorted(self.keys, digests, side="right")
        found = np.full(len(strings), -1, "i8")
        for k in np.flatnonzero(stop > at):
            found[k] = next((i for i in range(at[k], stop[k]) if self.string(i) == strings[k]), -1)
        return found


_MAPPED: dict[int, DigestIndex] = {}


def mapped(data: bytes) -> DigestIndex:
    """The index of a file's bytes, the latest one kept for the worker's next task."""
    key = xxhash.xxh3_64_intdigest(data)
    if key not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[key] = DigestIndex(data)
    return _MAPPED[key]


def host_and_path(url: str):
    """Columns for the host (A-Z lower-cased) and the path of a url column; empty for null or without ``://``."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, rest, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, rest, 2), F.lit(""))


def candidates(host: str, path: str, labels: list[int], path_lengths: list[int]) -> list[str]:
    """Every string that a fitting rule can have: a suffix of the host by labels, then a prefix of the path."""
    if not host:
        return []
    own = host.rsplit(".", labels[-1]) if labels else []
    tails = [host if k == len(own) else ".".join(own[len(own) - k :]) for k in labels if k <= len(own)]
    heads = [path[:k] for k in path_lengths if len(path) >= k]
    return [h + p for h in tails for p in heads]


def best_rules(index: DigestIndex, hosts: list[str], paths: list[str]) -> tuple[list, list]:
    """Rule and verdict of each (host, path), None where no rule fits; one probe for all candidates of a batch."""
    tried = [candidates(h, p, index.labels, index.path_lengths) for h, p in zip(hosts, paths, strict=True)]
    flat = [c.encode() for row in tried for c in row]
    hits, k = index.find(flat), 0
    rules, verdicts = [], []
    for row in tried:
        at = max((i for i in range(k, k + len(row)) if hits[i] >= 0), key=lambda i: (len(flat[i]), flat[i]), default=None)
        k += len(row)
        rules.append(None if at is None else flat[at].decode())
        verdicts.append(None if at is None else "allow" if index.allow[hits[at]] else "block")
    return rules, verdicts


def _split(urls: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(url)
    return urls.withColumns({"_host": host, "_path": path}).drop("host", "path", "rule", "verdict").withColumnsRenamed({"_host": "host", "_path": "path"})


def judge_urls(spark: SparkSession, urls: DataFrame, rules, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``urls`` with host, path, rule and verdict added.

    ``rules``: pairs (verdict, rule); a list here is what a driver can hold. A list whose index file is
    over ``BROADCAST_BYTES`` goes through ``judge_by_shards`` instead of a broadcast.
    """
    data = build_index(rules)
    if len(data) > BROADCAST_BYTES:
        return judge_by_shards(urls, spark.createDataFrame([(v, r) for v, r in rules], "verdict string, rule string"), url, default)
    sent = spark.sparkContext.broadcast(data)

    def start():
        index = mapped(sent.value)

        def probe(hosts: list[str], paths: list[str]) -> Iterator[tuple]:
            found, verdicts = best_rules(index, hosts, paths)
            return zip(found, [v or default for v in verdicts], strict=True)

        return probe

    return add_columns(_split(urls, url), ["host", "path"], "rule string, verdict string", start)


def judge_by_shards(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The same for a rule list of any size, a DataFrame (verdict, rule), cut by ranges of the digest.

    Only distinct (host, path) pairs are expanded and probed, so a host with a third of all pages costs its paths.
    In a task a shard's file comes first and its candidates stream after it.
    """
    written = Written(urls.sparkSession, "urls")
    shapes = rules.select((F.size(F.split(F.substring_index("rule", "/", 1), "[.]"))).alias("l"), (F.length("rule") - F.instr("rule", "/") + 1).alias("p"))
    found = shapes.agg(F.sort_array(F.collect_set("l")).alias("l"), F.sort_array(F.collect_set("p")).alias("p"), F.count("*").alias("n")).first()
    labels, paths, width = found["l"], found["p"], max(0, (found["n"] // SHARD_RULES).bit_length())
    shard_of = lambda text: xxhash.xxh64_intdigest(text.encode()) >> (64 - width) if width else 0

    def ranged(batch: dict) -> Iterator[tuple]:
        return ((shard_of(r), v, r) for v, r in zip(batch["verdict"], batch["rule"], strict=True))

    def indexes(rows: Iterator[tuple]) -> Iterator[tuple]:
        for shard, own in groupby(rows, lambda r: r[0]):
            yield shard, 0, build_index(r[1:] for r in own), None, None, None

    def expand(batch: dict) -> Iterator[tuple]:
        for host, path in zip(batch["host"], batch["path"], strict=True):
            for c in candidates(host, path, labels, paths):
                yield shard_of(c), 1, None, host, path, c

    def probe(rows: Iterator[tuple]) -> Iterator[tuple]:
        for _, own in groupby(rows, lambda r: r[0]):
            first = next(own)
            if first[1]:
                continue  # a range without rules
            index = DigestIndex(first[2])
            while some := list(islice(own, PROBED)):
                for k, (*_, host, path, c) in zip(index.find([r[5].encode() for r in some]), some, strict=True):
                    if k >= 0:
                        yield host, path, c, "allow" if index.allow[k] else "block"

    split = _split(urls, url)
    kinds = "shard long, kind int, data binary, host string, path string, candidate string"
    files = map_stream(map_rows(rules.select("verdict", "rule"), "shard long, verdict string, rule string", lambda: ranged).repartition("shard").sortWithinPartitions("shard"), kinds, indexes, rows=1)
    pairs = written.put(split.groupBy("host", "path").agg(F.count("*").alias("rows")), "pairs")
    tried = map_rows(pairs.select("host", "path"), kinds, lambda: expand)
    hits = map_stream(files.unionByName(tried).repartition("shard").sortWithinPartitions("shard", "kind"), "host string, path string, rule string, verdict string", probe)
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.octet_length("rule"), "rule")).alias("best"))
    whole = lambda df: df.withColumn("_url", F.concat(F.length("host").cast("string"), F.lit(":"), "host", "path"))
    groups = whole(pairs.join(best, ["host", "path"], "left")).select("_url", "rows", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return join_groups(whole(split), written.put(groups, "groups"), "_url").select(*split.columns, "rule", "verdict")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return judge_urls(spark, pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), r AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM s
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
