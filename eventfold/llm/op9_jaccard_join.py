"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds 64-bit hashes of its distinct five-word shingles. Equal sets are one node. Two nodes
link when 100 * |A and B| >= 75 * |A or B|; the result is each document's component.

1. One pass over the texts gives every document's set size, the set's digest, and its marks: the shingles
   whose hash lies in the lowest ``MARKED`` of the hash range.
2. Prefix filter: sets of Jaccard 0.75 share one of their first |A| - ceil(0.75 |A|) + 1 shingles in any
   common order. The order is by frequency among the marks, so passages that many documents share come
   last. A mark of one node alone can lead nowhere and is dropped as soon as marks meet by hash, before any are written. What is left
   are short lists of nodes with a common mark. Marks travel as packed arrays, a few rows per task.
3. Families (``near``): all lists of one pivot, the node that is in most lists, are one family, its distinct nodes, so
   that copies of a long text, which share hundreds of lists, meet once and not in each of them.
4. Inside a family's tasks an R-tree proposes the partners. It is packed from the count vectors of the nodes' sets
   (shingles hashed into ``GROUPS`` groups, counted). A tree node keeps the coordinates' maxima and the sizes' range; the
   sum of coordinate minima with a query bounds the overlap from above, for tree nodes and for points. Every node asks
   the tree; tree nodes that lie in the query's component throughout are passed over. What the bound cannot exclude
   is verified on whole sets, the likeliest first, and a link joins its components at once.
5. Components of all links, by repeated minima of neighbours and pointer jumping over written tables.

Sets, not samples of them, decide every link.

Cases: a null text or one without words has an empty set, links with nothing and is its own component.
Fewer than five words are one shingle. Equal texts are one node; a null doc_id takes part, but names no
component unless all its members' ids are null. An empty table gives no rows. Of the input only doc_id and
text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.common import Written, map_rows, map_stream, table
from eventfold.llm.near import BROADCAST_IDS as BROADCAST_IDS
from eventfold.llm.near import all_links, candidate_sets, components, digest, families, grouped, node_of
from eventfold.llm.near import shingles as shingles_of

WIDTH = 5
PERCENT = 75
#: Share of the hash range whose shingles are marks: over a quarter, so that nearly all prefixes lie within them.
MARKED = 0.34
GROUPS = 256
#: Points in a leaf: few, so that a family of a dozen nodes has inner ones.
LEAF = 8
#: Nodes in one row of a list.
ROW_NODES = 1 << 16
#: Marks that one task takes, about.
TASK_MARKS = 1 << 20
#: Bytes of text for a shingle, at least, as a rule: tasks are counted by it.
WORD_BYTES = 5.5
_LIMIT = np.uint64(int(MARKED * 2**64))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    return shingles_of(text, WIDTH)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def marks_of(own: np.ndarray) -> np.ndarray:
    """The marks of a set, and more of its smallest hashes if they are fewer than its prefix."""
    return own[: max(int(np.searchsorted(own, _LIMIT)), prefix_length(len(own)))] if len(own) else own


def counts_of(own: np.ndarray) -> np.ndarray:
    """The set's point: how many of its shingles fall into each group."""
    return np.bincount((own >> np.uint64(8)).astype("u8") % np.uint64(GROUPS), minlength=GROUPS)


def needed(n: float, m: float) -> float:
    """Least overlap of linked sets of these sizes."""
    return PERCENT * (n + m) / (100 + PERCENT)


class CountTree:
    """An R-tree over count vectors, packed from halves along the coordinate with the largest spread."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rows: np.ndarray | None = None):
        self.points, self.sizes = points, sizes
        self.rows = np.arange(len(points)) if rows is None else rows
        own = points[self.rows]
        self.most, self.least_size, self.most_size = own.max(0), sizes[self.rows].min(), sizes[self.rows].max()
        self.parts: list[CountTree] = []
        self.own = own
        if len(self.rows) > LEAF:
            self.own = None
            if self.most_size > 2 * self.least_size:
                order = np.argsort(sizes[self.rows], kind="stable")
            else:
                order = np.argsort(own[:, int(np.argmax(own.max(0) - own.min(0)))], kind="stable")
            half = len(order) // 2
            self.parts = [CountTree(points, sizes, self.rows[x]) for x in (order[:half], order[half:])]

    def partners(self, q: np.ndarray, n: int, label: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of other labels whose overlap with the query may be enough, and its bound."""
        if self.most_size * 100 < PERCENT * n or self.least_size * PERCENT > 100 * n:
            return
        if np.minimum(q, self.most).sum() < needed(n, max(self.least_size, PERCENT * n / 100)):
            return
        if self.parts:
            if (labels[self.rows] != label).any():
                for part in self.parts:
                    yield from part.partners(q, n, label, labels)
        else:
            bound = np.minimum(q, self.own) @ np.ones(len(q), q.dtype)
            enough = (bound >= needed(n, self.sizes[self.rows])) & (labels[self.rows] != label)
            yield self.rows[enough], bound[enough]


def tree_index(own: list[np.ndarray], sizes: np.ndarray, rows: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Partners of a set by the R-tree over the sets in ``rows``, the likeliest first."""
    exact = "f4" if sizes.max() < 1 << 24 else "f8"  # sums of coordinates are integers that these hold
    points = np.array([counts_of(x) for x in own], exact)
    tree = CountTree(points, sizes, rows)

    def partners(k: int, labels: np.ndarray) -> np.ndarray:
        found = list(tree.partners(points[k], int(sizes[k]), int(labels[k]), labels))
        if not found:
            return np.zeros(0, "i8")
        near, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        return near[np.argsort(-bound / (sizes[near] + sizes[k]), kind="stable")]

    return partners


def _packed(values: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows (bucket, arrays' bytes ...) of columns dealt by a value."""
    bucket = (values % np.uint64(parts)).astype("i4")
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(edges)):
        some = order[edges[k] : edges[k + 1]]
        yield (int(k), *(c[some].tobytes() for c in columns))


def _joined(rows: list[tuple], at: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), kind)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, key, node, marks."""

    def start():
        def run(batch: dict) -> Iterator[tuple]:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = shingles(text)
                key = digest(own)
                yield doc, len(own), key, node_of(key), marks_of(own).tobytes()

        return run

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n long, key binary, node long, marks binary", start)


MET = "kind int, bucket int, a binary, b binary, c binary, doc_id long, n long, key binary, node long"


def tasks_for(docs: DataFrame) -> int:
    """So many tasks that one takes about ``TASK_MARKS`` marks, by the texts' bytes."""
    return 1 + int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * MARKED / WORD_BYTES) // TASK_MARKS


def common_lists(described: DataFrame) -> DataFrame:
    """Lists (list, nodes) of nodes that share a mark of their prefixes, equal ones once. A long one has several rows; two
    of one name only add candidates."""
    total = described.agg(F.sum(F.octet_length("marks")) / 8).first()[0] or 0
    tasks = 1 + int(total) // TASK_MARKS
    return met_lists(met_marks(described, tasks), tasks)


def met_marks(described: DataFrame, tasks: int) -> DataFrame:
    """Rows of ``MET``. Kind 0: packed marks that several nodes have, by node; kind 1: nodes' sizes; kind 2: a document's
    doc_id, n, key and node, which come along so that the marks of all texts are never written, only shuffled."""
    parts = 4 * tasks

    def deal(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Marks with their nodes, by hash; sizes, by node. A node's copies in a task are dealt once."""
        none = (None, None, None, None)
        seen: set[int] = set()
        hashes, nodes, sizes, held = [], [], [], 0
        last = object()
        while True:
            row = next(rows, last)
            if row is last or held > TASK_MARKS:
                if hashes:
                    h, v = np.concatenate(hashes), np.repeat(np.array([s[0] for s in sizes], "i8"), [len(x) for x in hashes])
                    for k, *columns in _packed(h, parts, h, v):
                        yield 0, k, *columns, *none
                    s = np.array(sizes, "i8")
                    for k, *columns in _packed(s[:, 0].astype("u8"), parts, s[:, 0].copy(), s[:, 1].copy(), s[:, 2].copy()):
                        yield 1, k, columns[0], columns[1] + columns[2], *none
                hashes, sizes, held = [], [], 0
            if row is last:
                return
            doc, n, key, node, marks = row
            yield 2, hash((doc, node)) % parts, None, None, doc, n, key, node
            if n and node not in seen:
                if len(seen) > TASK_MARKS:
                    seen.clear()
                seen.add(node)
                hashes.append(np.frombuffer(marks, "u8"))
                sizes.append((node, prefix_length(n), len(hashes[-1])))
                held += len(hashes[-1])

    def meet(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Marks of two nodes or more, with their number of nodes, dealt by node; sizes pass through."""
        held, none = [], (None, None, None, None)
        for kind, bucket, a, b, *doc in rows:
            if kind:
                yield kind, bucket, a, b, b"" if kind == 1 else None, *doc
            else:
                held.append((a, b))
        if not held:
            return
        h, v = _joined(held, 0, "u8"), _joined(held, 1, "i8")
        order = np.lexsort((v, h))
        h, v = h[order], v[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (v[1:] != v[:-1])])
        h, v = h[new], v[new]
        _, at, many = np.unique(h, return_inverse=True, return_counts=True)
        often = many[at]
        keep = often > 1
        h, v, often = h[keep], v[keep], often[keep].astype("i8")
        for k, *columns in _packed(v.astype("u8"), parts, v, h, often):
            yield 0, k, *columns, *none

    kinds = "kind int, bucket int, a binary, b binary, doc_id long, n long, key binary, node long"
    dealt = map_stream(described.select("doc_id", "n", "key", "node", "marks"), kinds, deal, rows=64)
    return map_stream(dealt.repartition(tasks, "bucket"), MET, meet, rows=64)


def met_lists(met: DataFrame, tasks: int) -> DataFrame:
    """The lists of ``met_marks``."""
    parts = 4 * tasks

    def cut(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Each node's marks that lie within its prefix, dealt by hash again."""
        held, sizes = [], []
        for kind, _, a, b, c in rows:
            (sizes if kind else held).append((a, b, c))
        if not held:
            return
        v, h, often = _joined(held, 0, "i8"), _joined(held, 1, "u8"), _joined(held, 2, "i8")
        node = _joined(sizes, 0, "i8")
        halves = [np.frombuffer(x[1], "i8").reshape(2, -1) for x in sizes]
        prefix, marks = np.concatenate([x[0] for x in halves]), np.concatenate([x[1] for x in halves])
        node, first = np.unique(node, return_index=True)
        prefix, marks = prefix[first], marks[first]
        order = np.lexsort((h, often, v))
        v, h = v[order], h[order]
        edges = np.searchsorted(v, node)
        held_marks = np.searchsorted(v, node, side="right") - edges
        alone = marks - held_marks  # marks of no other node come first in the order
        rank = np.arange(len(v)) - np.repeat(edges[held_marks > 0], held_marks[held_marks > 0])
        keep = rank < np.repeat((prefix - alone)[held_marks > 0], held_marks[held_marks > 0])
        for k, *columns in _packed(h[keep], parts, h[keep], v[keep]):
            yield k, *columns

    def lists(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = [r[1:] for r in rows]
        if not held:
            return
        h, v = _joined(held, 0, "u8"), _joined(held, 1, "i8")
        order = np.lexsort((v, h))
        h, v = h[order], v[order]
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        seen = set()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1 and (name := xxhash.xxh3_64_intdigest(v[a:b].tobytes()) - (1 << 63)) not in seen:
                seen.add(name)
                for k in range(a, b, ROW_NODES):
                    yield name, v[k : min(k + ROW_NODES, b)].tolist()

    met = met.where("kind < 2").select("kind", "bucket", "a", "b", "c")
    cut_ = map_stream(met.repartition(tasks, "bucket"), "bucket int, a binary, b binary", cut, rows=64)
    return map_stream(cut_.repartition(tasks, "bucket"), "list long, nodes array<long>", lists, rows=500).distinct()


def join_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    written = Written(docs.sparkSession, "jaccard")
    tasks = tasks_for(docs)
    met = written.put(met_marks(describe(docs), tasks), "met")
    ids = written.put(met.where("kind = 2").select("doc_id", "n", "key", "node"), "ids")
    lists = written.put(met_lists(met, tasks), "lists")
    written.drop("met")
    members = written.put(families(lists.select("list", F.explode("nodes").alias("node")).distinct()), "families")
    written.drop("lists")
    sets = written.put(candidate_sets(docs, ids, members, WIDTH), "sets")
    labels = components(all_links(members, sets, tree_index, PERCENT, written), written, "all")
    out = grouped(ids, labels, written)
    written.drop("families", "sets", "first", "more")
    return out


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component."""
    return join_copies(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+') IF x <> ''] AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS own FROM w
), d AS (SELECT doc_id, CAST(len(own) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(own) AS shingle FROM s),
often AS (SELECT shingle FROM t GROUP BY shingle HAVING count(*) > 1),
u AS (SELECT t.doc_id, t.shingle FROM t JOIN often ON t.shingle = often.shingle),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM u x JOIN u y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM k JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT d.doc_id, d.n AS n_shingles, min(reach.b) AS component_id FROM d JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, d.n
"""
