"""What the near-duplicate joins share: shingle sets, families of candidates, links inside them, components.

A join names *nodes* (distinct shingle sets) and *lists* of nodes that may be near copies. All lists with one pivot, the
node of a list that is in most lists, are one family. A family's nodes are linked inside tasks, with their whole sets:

1. Nodes are dealt to blocks of about ``BLOCK``, the pivot to all of them. In a block an index proposes partners of
   other components, the likeliest first; a link joins two components at once. So no link between components of a block
   is lost, pairs inside one are never looked at, and a block gives fewer links than it has nodes.
2. Families of several blocks that still hold several components after that: nodes outside their largest component ask
   all blocks once more, a task for each block of asking and block of asked nodes.

Sets decide every link. They are made again from the texts of nodes that are in a family; the ids of those texts are
broadcast up to ``BROADCAST_IDS``, beyond that they meet by a shuffle join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.common import Written, join_groups, map_rows, map_stream

#: Nodes of a family in one block, and pairs verified at a time.
BLOCK, AT_ONCE = 1024, 64
BROADCAST_IDS = 4_000_000
#: Links that one task contracts, about.
TASK_LINKS = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio

#: From sets, their sizes and the rows to propose: a function from (row, label of each row) to rows of other labels.
Index = Callable[[list[np.ndarray], np.ndarray, np.ndarray], Callable[[int, np.ndarray], np.ndarray]]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words; of fewer words, of all of them as one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], "u8")
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))
    h = w[: len(w) - width + 1].copy()
    for k in range(1, width):
        h *= _PRIME
        h += w[k : len(w) - width + 1 + k]
    h ^= h >> np.uint64(31)
    h *= _PRIME
    h ^= h >> np.uint64(29)
    return np.unique(h)


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def linked_ones(a: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of some sets, none empty, link with a set."""
    if not others:
        return np.zeros(0, bool)
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat
    both = np.add.reduceat(hit.astype("i8"), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(a) + sizes - both)


def candidate_sets(docs: DataFrame, ids: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """node, key, n and the whole set of every node in a family, made again from one text of each."""
    nodes = members.select("node").distinct()
    chosen = ids.join(nodes, "node", "left_semi").groupBy("key").agg(F.min("doc_id").alias("id")).select("id").distinct()
    few = members.count() <= BROADCAST_IDS
    chosen = F.broadcast(chosen) if few else chosen
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def start():
        def run(batch: dict) -> Iterator[tuple]:
            for text in batch["text"]:
                if len(own := shingles(text, width)):
                    key = digest(own)
                    yield node_of(key), key, len(own), own.tobytes()

        return run

    return map_rows(texts, "node long, key binary, n long, own binary", start).dropDuplicates(["key"])


def families(members: DataFrame) -> DataFrame:
    """Nodes (family, node) of distinct (list, node).

    The pivot, by which the family is named, is the list's node that is in most lists: of a text and its edited copies
    that is the text, as each copy has lost some of its shingles."""
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    pivots = members.join(degree, "node").groupBy("list").agg(F.max_by("node", F.struct("degree", "node")).alias("family"))
    return members.join(pivots, "list").select("family", "node").distinct()


def _own_block(blocks: str) -> str:
    return f"pmod(xxhash64(node), {blocks})"


def dealt_once(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members with the one block of a node, or all blocks for the pivot; all ask and are asked."""
    named = join_groups(members, sizes, "family")
    blocks = f"CASE WHEN family = node THEN sequence(0L, blocks - 1) ELSE array({_own_block('blocks')}) END"
    true = F.lit(True)
    return named.select("family", F.explode(F.expr(blocks)).alias("i"), F.lit(0).cast("long").alias("j"), "node", F.lit(None).cast("binary").alias("label"), true.alias("asks"), true.alias("asking"), true.alias("asked"))


def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (family, node, key, label, asks, n_asks, size) of the families with several components. Nodes outside the
    component that most of a family's nodes have ask. ``labels``: node, key, label."""
    named = members.select("family", "node").join(labels, "node")
    per = named.groupBy("family", "label").agg(F.count("*").alias("n")).groupBy("family")
    per = per.agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("parts"))
    per = per.where("parts > 1").select("family", "top", "size", (F.col("size") - F.col("most")).alias("n_asks"))
    return named.join(per, "family").withColumn("asks", F.col("label") != F.col("top")).drop("top")


def dealt_again(members: DataFrame) -> DataFrame:
    """Members as from ``mixed``: the asking ones in each block of asked nodes, these in each block of asking ones."""
    here = "struct({} AS i, {} AS j, {} AS asking, {} AS asked)"
    deal = f"""concat(transform(sequence(0L, size div {BLOCK}), k -> {here.format("own_i", "k", "true", "false")}),
      transform(sequence(0L, n_asks div {BLOCK}), k -> {here.format("k", "own_j", "false", "true")}))"""
    own = {"own_i": F.expr(_own_block(f"n_asks div {BLOCK} + 1")), "own_j": F.expr(_own_block(f"size div {BLOCK} + 1"))}
    dealt = members.withColumns(own).select("family", "node", "key", "label", "asks", F.explode(F.expr(deal)).alias("d"))
    return dealt.select("family", "d.*", "node", "label", "asks").where("asked OR asks")


def block_links(held: list[tuple], index: Index, percent: int) -> Iterator[tuple]:
    """Links of rows (node, label, asks, asking, asked, key, own), each joining two components.

    A null label is a component of its own. Two nodes that both ask meet where the smaller one asks."""
    node, label, asks, asking, asked, key, own = zip(*held, strict=True)
    own = [np.frombuffer(x, "u8") for x in own]
    sizes, node, asks, asked = np.array([len(x) for x in own]), np.array(node), np.array(asks), np.array(asked)
    if not asked.any() or not any(asking):
        return
    labels = np.unique([k if x is None else x for x, k in zip(label, key, strict=True)], return_inverse=True)[1]
    partners = index(own, sizes, np.flatnonzero(asked))
    for k in np.flatnonzero(asking):
        rows = partners(int(k), labels)
        rows = rows[~asks[rows] | (node[rows] > node[k])]
        for at in range(0, len(rows), AT_ONCE):
            some = rows[at : at + AT_ONCE]
            some = some[labels[some] != labels[k]]
            for j in some[linked_ones(own[k], [own[j] for j in some], percent)]:
                if labels[j] != labels[k]:
                    labels[labels == labels[j]] = labels[k]
                    yield key[k], key[j]


def links_in_blocks(dealt: DataFrame, sets: DataFrame, index: Index, percent: int) -> DataFrame:
    """Links (key_a, key_b) that join the components of each block as far as its nodes link."""
    rows = dealt.join(sets.select("node", "key", "own"), "node").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node", "key", "asking")

    def links(stream: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        for row in stream:
            if held and row[:3] != held[0][:3]:
                yield from block_links([r[3:] for r in held], index, percent)
                held = []
            held.append(row)
        if held:
            yield from block_links([r[3:] for r in held], index, percent)

    return map_stream(rows.select("family", "i", "j", "node", "label", "asks", "asking", "asked", "key", "own"), "key_a binary, key_b binary", links).distinct()


def contracted(links: Iterator[tuple]) -> Iterator[tuple]:
    """Pairs (key, smallest key that these links reach from it) by union-find, for all keys that are linked."""
    root: dict[bytes, bytes] = {}

    def top(k: bytes) -> bytes:
        while (up := root.setdefault(k, k)) != k:
            root[k] = k = root[up]
        return k

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    for k in list(root):
        yield k, top(k)


def components(links: DataFrame, written: Written, name: str) -> DataFrame:
    """key, label: the smallest key reachable; ``links`` are written.

    Tasks contract ``TASK_LINKS`` links each to pairs with the smallest key they reach. If there was one task that is
    the result. Else labels are passed along these pairs, by repeated minima of neighbours and pointer jumping; every
    step is a written table, the one before is dropped."""
    tasks = 1 + links.count() // TASK_LINKS
    pairs = written.put(map_stream(links.repartition(tasks), "key binary, label binary", contracted), f"{name}-pairs")
    if tasks == 1:
        return pairs
    pairs = pairs.where("key <> label")
    edges = written.put(pairs.union(pairs.select("label", "key")).distinct().toDF("key", "other"), f"{name}-edges")
    labels = written.put(edges.groupBy("key").agg(F.least("key", F.min("other")).alias("label")), f"{name}-0")
    step, changed = 0, 1
    while changed:
        near = edges.join(labels.withColumnRenamed("key", "other"), "other").groupBy("key").agg(F.min("label").alias("near"))
        lower = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        after = lower.join(jump, "label", "left").select("key", F.least("label", F.coalesce("further", "label")).alias("label"), "was")
        after = written.put(after, f"{name}-{step + 1}")
        changed = after.where("label <> was").limit(1).count()
        written.drop(f"{name}-{step}")
        labels, step = after.select("key", "label"), step + 1
    written.drop(f"{name}-edges", f"{name}-pairs")
    return labels


def all_links(members: DataFrame, sets: DataFrame, index: Index, percent: int, written: Written) -> DataFrame:
    """Links that join what reaches each other within the families; ``members``: family, node; ``sets`` as from ``candidate_sets``."""
    sizes = members.groupBy("family").agg(F.count("*").alias("rows")).withColumn("blocks", F.expr(f"rows div {BLOCK} + 1"))
    first = written.put(links_in_blocks(dealt_once(members, sizes), sets, index, percent), "first")
    large = sizes.where("blocks > 1").select("family")
    if not large.limit(1).count():
        return first
    labels = components(first, written, "spanning")
    labels = sets.select("key", "node").join(labels, "key", "left").select("node", "key", F.coalesce("label", "key").alias("label"))
    more = links_in_blocks(dealt_again(mixed(members.join(large, "family", "left_semi"), labels)), sets, index, percent)
    return first.union(written.put(more, "more"))


def grouped(ids: DataFrame, labels: DataFrame, written: Written) -> DataFrame:
    """doc_id, n_shingles and component_id of ``ids`` (doc_id, n, key); ``labels`` as from ``components``."""
    keys = ids.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")).join(labels, "key", "left")
    lows = keys.where("label IS NOT NULL").groupBy("label").agg(F.min("low").alias("component"))
    groups = keys.join(lows, "label", "left").select("key", "rows", F.coalesce("component", "low").alias("component"))
    groups = written.put(groups, "groups")
    out = join_groups(ids.select("doc_id", "n", "key"), groups, "key")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
