"""Phrase collocation mining over deduplicated pieces.

1. Texts are lower-cased (A-Z) and split into pieces at sentence and line marks, a piece is its words joined by blanks.
   Equal pieces of a language are one row with a multiplicity, so a passage that many documents repeat is counted once.
2. One round for each length, from one word to three. Tasks turn their pieces into n-grams by arrays of word numbers, add
   up equal ones a slice at a time, and send (lang, phrase, weight) to the hash bucket of the phrase. A word that fills
   a third of all texts is one row for each slice there.
3. A bucket's task streams its rows through duckdb, which adds them up under ``MEMORY`` and spills beyond it. Phrases
   that occur ``LEAST`` times or more are written: every part of a candidate occurs at least as often as it does. So
   the next round sends only n-grams whose two parts of one word less are, by a bit map of their hashes, among those
   phrases. The bit map has ``BITS`` bits whatever their number; bits that others set let n-grams through that
   the count then drops, so it saves rows and never decides.
4. Candidates request the counts of their parts: requests are shuffled to where the parts are; a part that is asked for
   by more than one request in 1024 is broadcast instead, of which there are at most that many.
5. Longer candidates send their counts to the phrases inside them, which takes the dominated ones out.

Scores are exact in decimals of 38 digits, for counts up to 5 * 10^15. Only the first ``TOP`` of each task leave it for
their language's ranking.

The spill folder of duckdb is a task's own scratch, removed at its end; nothing else reads it, and a task that is
repeated elsewhere starts anew.

Cases: null languages are ``und``, together with that language's own rows. Null and empty texts have no pieces. Equal
rows count each. A piece of any length is one row. An empty table gives no rows. Only text and lang are read.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.llm.common import Written, join_groups, mixed, slices, table

LEAST, LONGEST, TOP, COVERED = 10, 3, 2000, 50
#: Memory of one bucket's duckdb, and n-grams in a bucket, about.
MEMORY, BUCKET_GRAMS = "256MB", 1 << 21
#: Words of a slice that are numbered together.
SLICE_WORDS = 1 << 20
#: Bits of the map of frequent phrases (16 MB), and of a part of it that one task makes.
BITS, PART_BITS = 1 << 27, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, rows and words: the distinct pieces with their multiplicities and numbers of words."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            split = pc.split_pattern_regex(pc.ascii_lower(b.column("text")), r"[.,;:!?\n\x0B\f\r]")
            piece = pc.utf8_trim(pc.replace_substring_regex(split.flatten(), r"[ \t]+", " "), " ")
            lang = b.column("lang").take(pc.list_parent_indices(split))
            yield pa.RecordBatch.from_arrays([lang, piece], ["lang", "piece"]).filter(pc.not_equal(piece, ""))

    every = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, "lang string, piece string")
    found = every.groupBy("lang", "piece").agg(F.count("*").alias("rows"))
    return found.withColumn("words", F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + F.lit(1))


def _summed(code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes' first places, and the sums of their weights."""
    order = np.argsort(code, kind="stable")
    sorted_ = code[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return order[first], np.add.reduceat(weight[order], first)


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), "u8", len(words))


def _chained(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Places in the bit map of phrases, from the hashes of their languages and words."""
    out = lang
    for w in words:
        out = mixed(out + w)
    return (out % np.uint64(BITS)).astype("i8")


def bit_map(counts: DataFrame, n: int) -> np.ndarray:
    """The bit map of the phrases (lang, phrase) of ``n`` words. The driver gets ``BITS`` bits, put together in tasks."""

    def places(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                words = _hashes(pc.split_pattern(b.column("phrase"), " ").flatten()).reshape(-1, n)
                at = np.unique(_chained(_hashes(b.column("lang")), list(words.T)))
                yield pa.RecordBatch.from_arrays([pa.array(at // PART_BITS), pa.array(at % PART_BITS)], ["part", "at"])

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(PART_BITS, bool)
        bits[rows["at"].to_numpy()] = True
        return pd.DataFrame({"part": rows["part"][:1], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros(BITS // 8, "u1")
    found = counts.select("lang", "phrase").mapInArrow(places, "part long, at long").distinct()
    for r in found.groupBy("part").applyInPandas(packed, "part long, bits binary").toLocalIterator():
        out[r["part"] * (PART_BITS // 8) :][: PART_BITS // 8] = np.frombuffer(r["bits"], "u1")
    return out


def grams(batch: pa.RecordBatch, n: int, known: np.ndarray | None) -> pa.RecordBatch | None:
    """lang, phrase and weight of the n-grams of some pieces (lang, piece, rows), equal ones added up; if ``known``, the bit
    map of shorter phrases, is given, of those whose parts are in it."""
    split = pc.split_pattern(batch.column("piece"), " ")
    sizes = pc.list_value_length(split).to_numpy().astype("i8")
    words, langs = split.flatten().dictionary_encode(), batch.column("lang").dictionary_encode()
    number, names = words.indices.to_numpy().astype("i8"), words.dictionary
    lang = np.repeat(langs.indices.to_numpy().astype("i8"), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.flatnonzero(ends - np.arange(len(number)) >= n)
    if known is not None and len(at):
        own = _hashes(names)[number]
        place = _chained(_hashes(langs.dictionary)[lang[: len(own) - n + 2]], [own[k : len(own) - n + 2 + k] for k in range(n - 1)])
        sound = (known[place >> 3] >> (7 - (place & 7)).astype("u1")) & 1 == 1
        at = at[sound[at] & sound[at + 1]]
    if not len(at):
        return None
    code = lang[at]
    for k in range(n):
        code = code * len(names) + number[at + k]
        code = np.unique(code, return_inverse=True)[1] if 0 < k < n - 1 else code
    first, total = _summed(code, np.repeat(batch.column("rows").to_numpy(), sizes)[at])
    here = at[first]
    parts = [names.take(pa.array(number[here + k])) for k in range(n)]
    phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[here])), phrase, pa.array(total)], ["lang", "phrase", "weight"])


def partial_counts(found: DataFrame, n: int, known: np.ndarray | None) -> DataFrame:
    """lang, phrase, weight: n-grams added up within slices of the pieces."""
    shared = None if known is None else found.sparkSession.sparkContext.broadcast(known)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = np.cumsum(b.column("words").to_numpy()) // SLICE_WORDS
            cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end > start and (made := grams(b.slice(start, end - start), n, shared and shared.value)) is not None:
                    for k in range(0, made.num_rows, 1 << 16):
                        yield made.slice(k, 1 << 16)

    return found.mapInArrow(run, "lang string, phrase string, weight long")


def frequent(partial: DataFrame, buckets: int) -> DataFrame:
    """lang, phrase, f: the phrases that occur ``LEAST`` times or more, a bucket at a time in duckdb."""
    types = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("weight", pa.int64())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as scratch:
            con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False})
            try:
                con.register("rows", pa.RecordBatchReader.from_batches(types, (b.cast(types) for b in batches)))
                found = con.sql(f"SELECT lang, phrase, CAST(sum(weight) AS BIGINT) AS f FROM rows GROUP BY lang, phrase HAVING sum(weight) >= {LEAST}")
                yield from found.fetch_arrow_table().to_batches(max_chunksize=1 << 16)
            finally:
                con.close()
        pa.default_memory_pool().release_unused()

    return partial.repartition(buckets, "lang", "phrase").mapInArrow(run, "lang string, phrase string, f long")


def scored(counts: DataFrame, written: Written) -> DataFrame:
    """lang, phrase, a, l, r, score of all candidates by their lowest-scoring cut; ``counts``: lang, phrase, f, n_words."""
    own = counts.where("n_words > 1").select("lang", "phrase", F.col("f").alias("a"), "n_words")
    words = F.split("phrase", " ")
    part = lambda start, size: F.concat_ws(" ", F.slice(words, start, size))
    cuts = own.select("lang", "phrase", "a", "n_words", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    both = cuts.select("lang", "phrase", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("is_left"), F.col("left").alias("part")), F.struct(F.lit(False).alias("is_left"), F.col("right").alias("part")))).alias("x"))
    asked = written.put(both.select("lang", "phrase", "a", "k", "x.is_left", F.concat_ws("\n", "lang", "x.part").alias("part")), "requests")
    requests = asked.groupBy("part").agg(F.count("*").alias("rows"))
    parts = counts.where(f"n_words < {LONGEST}").select(F.concat_ws("\n", "lang", "phrase").alias("part"), "f").join(requests, "part")
    told = join_groups(asked, written.put(parts, "parts"), "part")
    one = told.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("is_left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_left"), F.col("f"))).alias("r"))
    exact = lambda c: f"CAST({c} AS DECIMAL(20,0))"
    score = F.expr(f"({exact('a')} * {exact('a')} * CAST(1000000 AS DECIMAL(7,0))) div ({exact('l')} * {exact('r')})")
    low = one.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return low.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covering(counts: DataFrame) -> DataFrame:
    """lang, phrase, longer: of phrases inside longer candidates, the greatest count of one."""
    long = counts.where(f"n_words = {LONGEST}").select("lang", F.split("phrase", " ").alias("w"), "f")
    inner = [F.concat_ws(" ", F.slice("w", k, LONGEST - 1)) for k in (1, 2)]
    return long.select("lang", F.explode(F.array(*inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``TOP`` phrases."""
    written = Written(docs.sparkSession, "collocations")
    found = written.put(pieces(docs), "pieces")
    totals = written.put(found.groupBy("lang").agg(F.sum(F.col("rows") * F.col("words")).alias("n")), "totals")
    buckets = 1 + (found.agg(F.sum("words")).first()[0] or 0) // BUCKET_GRAMS
    counts, known = None, None
    for n in range(1, LONGEST + 1):
        own = written.put(frequent(partial_counts(found, n, known), buckets).withColumn("n_words", F.lit(n)), f"counts-{n}")
        known = bit_map(own, n) if n < LONGEST else None
        counts = own if counts is None else counts.union(own)
    written.drop("pieces")
    lower = scored(counts, written).join(covering(counts), ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {COVERED} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lower.drop("longer").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of all documents, by language."""
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


ORACLE = rf"""
WITH p AS MATERIALIZED (
  SELECT lang, [x FOR x IN string_split_regex(piece, '[ \t]+') IF x <> ''] AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents)
), g AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= {LEAST}),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN g x ON x.lang = cut.lang AND x.phrase = cut.x JOIN g y ON y.lang = cut.lang AND y.phrase = cut.y
), low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY ALL)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, n, score
FROM low JOIN n ON n.lang = low.lang LEFT JOIN inner_ i ON i.lang = low.lang AND i.phrase = low.phrase
WHERE i.longer IS NULL OR 100 * i.longer < {COVERED} * a QUALIFY rank <= {TOP}
"""
