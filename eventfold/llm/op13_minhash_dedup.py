"""MinHash near-dedup by a multi-index Hamming join.

A document's set holds 64-bit hashes of its distinct two-word shingles; equal sets are one node. A node's signature has
``SLOTS`` slots of ``BITS`` bits, each of the least of a hash of its own over the set; two signatures are as far apart as
the number of slots that differ. Sets of Jaccard 0.8 differ in 6 slots of 30 on average, and in more than ``ERRORS`` with
a chance of 0.0002.

1. Multi-index: the slots are split into ``CHUNKS`` chunks. By the pigeonhole principle two signatures at most ``ERRORS``
   apart have a chunk with at most ``WRONG`` differing slots. Every choice of ``WRONG`` slots to leave out of a chunk
   gives a key of the others, so such a pair shares a key: none under the threshold is lost.
2. Keys of several nodes are lists of candidates. All lists with one pivot are one family (``near``), whose nodes meet in
   blocks; inside, pairs of different components at most ``ERRORS`` apart are verified on their whole sets, the nearest
   first, and a link joins its components at once. No pairs are emitted, and copies of one text need no more
   verifications than there are copies.
3. Components of all links; of each the smallest doc_id is kept.

Sets of up to three shingles link with none but equal ones, so they have no keys. Keys grow in proportion to the number
of distinct texts. A key that many nodes share is counted before rows move, and meets them by a broadcast.

Cases: a null text or one without words has an empty set, links with nothing, is its own component and kept. One word is
one shingle. Equal sets are one node; a null doc_id takes part, but names no component unless all its members' ids are
null. Repeated rows are kept together. An empty table gives no rows. Of the input only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.common import Written, join_groups, map_rows, mixed, slices, table
from eventfold.llm.near import all_links, candidate_sets, components, digest, families, grouped, node_of, shingles

WIDTH, PERCENT = 2, 80
SLOTS, BITS, CHUNKS, WRONG = 30, 16, 5, 2
CHUNK = SLOTS // CHUNKS
#: Signatures at most this far apart are compared: were it one more, all chunks could have WRONG + 1 differing slots.
ERRORS = CHUNKS * (WRONG + 1) - 1
#: Smaller sets cannot link without being equal.
LEAST = 4
_SEEDS = np.arange(1, SLOTS + 1, dtype="u8") * np.uint64(0xD6E8FEB86659FD93)  # an odd constant: all seeds differ
_KEPT = [[c * CHUNK + s for s in some] for c in range(CHUNKS) for some in combinations(range(CHUNK), CHUNK - WRONG)]


def signature(own: np.ndarray) -> np.ndarray:
    """The low bits of the least hash, for each slot's hash."""
    return np.array([mixed(own ^ s).min() & np.uint64((1 << BITS) - 1) for s in _SEEDS], "u2")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The keys (row, chunk and choice) of signatures (row, slot)."""
    out = np.empty((len(signatures), len(_KEPT)), "u8")
    for k, slots in enumerate(_KEPT):
        own = np.full(len(signatures), k + 1, "u8")
        for s in slots:
            own = mixed(own + signatures[:, s].astype("u8"))
        out[:, k] = own
    return out.view("i8")


def hamming_index(own: list[np.ndarray], sizes: np.ndarray, rows: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Partners of a set among the sets in ``rows`` whose signatures are at most ``ERRORS`` apart, the nearest first."""
    signatures = np.array([signature(x) for x in own])

    def partners(k: int, labels: np.ndarray) -> np.ndarray:
        fits = (labels[rows] != labels[k]) & (100 * sizes[rows] >= PERCENT * sizes[k]) & (100 * sizes[k] >= PERCENT * sizes[rows])
        near = rows[fits]
        apart = (signatures[near] != signatures[k]).sum(1)
        order = np.argsort(apart, kind="stable")
        return near[order[: int((apart <= ERRORS).sum())]]

    return partners


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, key, node and signature (null for small sets)."""

    def start():
        def run(batch: dict) -> Iterator[tuple]:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = shingles(text, WIDTH)
                key = digest(own)
                yield doc, len(own), key, node_of(key), signature(own).tobytes() if len(own) >= LEAST else None

        return run

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n long, key binary, node long, signature binary", start)


def keyed(nodes: DataFrame) -> DataFrame:
    """list (a key), node: all keys of nodes (node, signature)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            signatures = np.frombuffer(b"".join(b.column("signature").to_pylist()), "u2").reshape(-1, SLOTS)
            nodes_ = np.repeat(b.column("node").to_numpy(), len(_KEPT))
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(signatures).ravel()), pa.array(nodes_)], ["list", "node"])

    return nodes.mapInArrow(run, "list long, node long")


def common_keys(described: DataFrame, written: Written) -> DataFrame:
    """list, node: the keys of several nodes with these."""
    nodes = described.where("signature IS NOT NULL").groupBy("node").agg(F.first("signature").alias("signature"))
    keys = written.put(keyed(nodes), "keys")
    groups = written.put(keys.groupBy("list").agg(F.count("*").alias("rows")).where("rows > 1"), "common")
    lists = written.put(join_groups(keys, groups, "list").select("list", "node"), "lists")
    written.drop("keys", "common")
    return lists


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    written = Written(docs.sparkSession, "minhash")
    described = written.put(describe(docs), "described")
    members = written.put(families(common_keys(described, written)), "families")
    written.drop("lists")
    ids = described.drop("signature")
    sets = written.put(candidate_sets(docs, ids, members, WIDTH), "sets")
    labels = components(all_links(members, sets, hamming_index, PERCENT, written), written, "all")
    out = grouped(ids, labels, written)
    written.drop("families", "sets", "first", "more")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component and whether it is kept."""
    return dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+') IF x <> ''] AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 2 THEN [words[1]]
    ELSE list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) END AS own FROM w
), d AS (SELECT doc_id, CAST(len(own) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(own) AS shingle FROM s),
often AS (SELECT shingle FROM t GROUP BY shingle HAVING count(*) > 1),
u AS (SELECT t.doc_id, t.shingle FROM t JOIN often ON t.shingle = often.shingle),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM u x JOIN u y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM k JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT d.doc_id, d.n AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept FROM d JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, d.n
"""
