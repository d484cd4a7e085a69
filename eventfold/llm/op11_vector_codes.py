"""Vector code compression: product codebooks by Lloyd's rounds with Elkan's pruning.

A component x is the integer floor(4096 * x). A vector is cut into ``PARTS`` equal parts; each part position has a
codebook of ``ENTRIES`` entries, at first those parts of the smallest ids. A round assigns every part to its nearest
entry (squared distance, ties to the lower index) and replaces each entry by its parts' floored mean.

Elkan: with every part are kept an upper bound of the distance to its entry and one lower bound for each entry. After
an update they are shifted by how far the entries moved. An entry is not looked at if the upper bound is strictly
below its lower bound, or strictly below half the distance between it and the part's entry; such an entry is strictly
further away, so it cannot even tie. All others are compared by exact integer distances, which decide ties. Bounds are
rounded outwards, half floats of a scale that the largest component fixes, so pruning never changes a result.

One job a round: each task assigns its vectors, writes them with their new bounds, and adds one row with the sums and
counts of its parts by entry. The driver gets the sums of those rows: ``PARTS * ENTRIES`` entries, whatever the number
of vectors. Of the rounds' tables two exist at a time. No vector is shuffled before the labels' sums.

Cases: vectors that are null or hold null or non-finite components are dropped, and so are those that cannot be cut
alike: of a length that is no multiple of ``PARTS``, or other than the most frequent one (of equally frequent ones the
longest). Fewer vectors than entries give as many entries; equal entries are taken by the lowest index. Null ids
come last, equal ids by their components. Components whose distances pass 64 bits are refused with an error. A sum
over a label that passes 64 bits is null. An empty table gives no rows. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from eventfold.llm.common import Written, join_groups, slices, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Outward rounding of distances, far above the error of a square root.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
_FAR = np.iinfo("i8").max


def _half_up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = x.astype("f2")
    return np.where(h < x, np.nextafter(h, np.float16(np.inf)), h)


def _half_down(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = x.astype("f2")
    return np.where(h > x, np.nextafter(h, np.float16(-np.inf)), h)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def reassign(x: np.ndarray, entries: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Nearest entries of the parts ``x``, the code so far and its bounds being given; the bounds are tightened in place."""
    n, many = lower.shape
    gaps = np.array([_distances(np.broadcast_to(e, entries.shape), entries) for e in entries])
    half = np.sqrt(gaps) * (0.5 * _DOWN)
    own = np.arange(many) == code[:, None]
    open_ = ~own & (upper[:, None] >= lower) & (upper[:, None] >= half[code])
    rows = np.flatnonzero(open_.any(1))
    if not len(rows):
        return code
    at = code[rows]
    best = np.full((len(rows), many), _FAR)
    best[np.arange(len(rows)), at] = exact = _distances(x[rows], entries[at])
    root = np.sqrt(exact)
    upper[rows], lower[rows, at] = root * _UP, root * _DOWN
    i, j = np.nonzero(open_[rows] & (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= half[at]))
    best[i, j] = exact = _distances(x[rows[i]], entries[j])
    lower[rows[i], j] = np.sqrt(exact) * _DOWN
    code = code.copy()
    code[rows] = best.argmin(1)
    upper[rows] = np.sqrt(best.min(1)) * _UP
    return code


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of an array as binary values of one length."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype="i8") * width), pa.py_buffer(rows)])


def _rows(column: pa.Array, kind: str, n: int) -> np.ndarray:
    """Binary values of one length as rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1)


class Codebooks:
    """What a task needs: integer entries (part, entry, position), how far they moved, the number type and the bounds' scale."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None, kind: str, scale: float):
        self.entries, self.kind, self.scale = entries, kind, scale
        moved = np.zeros(entries.shape[:2]) if before is None else np.sqrt(((entries - before) ** 2).sum(2))
        self.moved = moved * _UP

    def start(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors as read, with bounds that say nothing."""
        n, (parts, many, width) = b.num_rows, self.entries.shape
        x = np.floor(b.column("embedding").flatten().to_numpy(zero_copy_only=False) * SCALE).astype(self.kind).reshape(n, parts * width)
        return x, np.zeros((n, parts), "u1"), np.concatenate([np.full((n, parts, 1), np.inf), np.zeros((n, parts, many))], 2)

    def stored(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, (parts, many, _) = b.num_rows, self.entries.shape
        bounds = _rows(b.column("bounds"), "f2", n).reshape(n, parts, 1 + many).astype("f8") * self.scale
        return _rows(b.column("vec"), self.kind, n), _rows(b.column("code"), "u1", n), bounds

    def assign(self, x: np.ndarray, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """New codes; ``bounds`` are shifted and tightened in place."""
        width, out = self.entries.shape[2], np.empty_like(code)
        for p, entries in enumerate(self.entries):
            upper, lower = bounds[:, p, 0], bounds[:, p, 1:]
            upper += self.moved[p][code[:, p]]
            lower -= self.moved[p]
            np.maximum(lower, 0, out=lower)
            out[:, p] = reassign(x[:, p * width : (p + 1) * width].astype("i8"), entries, code[:, p], upper, lower)
        return out

    def sums(self, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        """By part and entry: the sums of the positions, then the number of parts."""
        parts, many, width = self.entries.shape
        out = np.zeros((parts, many, width + 1), "i8")
        for p in range(parts):
            own = (code[:, p] == np.arange(many)[:, None]).astype("i8")
            out[p, :, :width] = own @ x[:, p * width : (p + 1) * width].astype("i8")
            out[p, :, width] = own.sum(1)
        return out


def _state(label: str) -> StructType:
    return StructType.fromDDL(f"vec_id long, label {label}, vec binary, code binary, bounds binary, sums array<long>")


def round_of(df: DataFrame, books: Codebooks, first: bool) -> DataFrame:
    """The vectors with new codes and bounds, and a row with sums for each task."""
    label = df.schema["label"].dataType
    schema = _state(label.simpleString())
    types = to_arrow_schema(schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros((*books.entries.shape[:2], books.entries.shape[2] + 1), "i8")
        for b in slices(batches):
            x, code, bounds = (books.start if first else books.stored)(b)
            code = books.assign(x, code, bounds)
            total += books.sums(x, code)
            bounds /= books.scale
            kept = np.concatenate([_half_up(bounds[:, :, :1]), _half_down(bounds[:, :, 1:])], 2).reshape(len(x), -1)
            made = [b.column("vec_id"), b.column("label"), _binary(x), _binary(code), _binary(kept), pa.nulls(len(x), types.field("sums").type)]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(made, types, strict=True)], schema=types)
        if total[:, :, -1].any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, t.type) for t in list(types)[:-1]] + [pa.array([total.ravel().tolist()], types.field("sums").type)], schema=types)

    return df.mapInArrow(run, schema)


def coded(df: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code and error by the last codebooks."""
    schema = StructType.fromDDL(f"vec_id long, label {df.schema['label'].dataType.simpleString()}, code string, error long")
    types = to_arrow_schema(schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        width = books.entries.shape[2]
        for b in slices(batches):
            x, code, bounds = books.stored(b)
            code = books.assign(x, code, bounds)
            error = sum(_distances(x[:, p * width : (p + 1) * width].astype("i8"), e[code[:, p]]) for p, e in enumerate(books.entries))
            made = [b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(made, types, strict=True)], schema=types)

    return df.mapInArrow(run, schema)


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and label of the vectors that have components throughout."""
    sound = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label").where(sound).where(f"size(embedding) % {PARTS} = 0")


def updated(entries: np.ndarray, state: DataFrame) -> np.ndarray:
    """The entries after an update by the sums in ``state``."""
    parts = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "value"))
    found = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("total")).collect()}
    out, (_, many, width) = entries.copy(), entries.shape
    for p, j in np.ndindex(entries.shape[:2]):
        base = (p * many + j) * (width + 1)
        if count := found.get(base + width, 0):
            out[p, j] = [found[base + k] // count for k in range(width)]
    return out


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every whole vector."""
    spark, written = vectors.sparkSession, Written(vectors.sparkSession, "codes")
    whole = whole_vectors(vectors)
    lengths = whole.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("rows"), F.max(F.expr("array_max(transform(embedding, x -> abs(x)))")).alias("most"))
    found = lengths.orderBy(F.desc("rows"), F.desc("length")).limit(1).collect()
    label = vectors.schema["label"].dataType.simpleString()
    if not found:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    length, most = found[0]["length"], int((found[0]["most"] or 0) * SCALE) + 1
    if 4 * most * most * max(length, 1) >= 1 << 62:
        raise ValueError(f"components up to {most / SCALE} have distances beyond 64 bits")
    kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8"
    whole = whole.where(F.size("embedding") == length)
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    entries = np.floor(np.array([r["embedding"] for r in first]).reshape(len(first), length) * SCALE).astype("i8").reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy()
    scale = 2.0 ** max(0, int(np.ceil(np.log2(2 * most * max(length, 1) ** 0.5 / 32768))))
    before, state = None, whole
    for k in range(ROUNDS):
        rows = round_of(state, Codebooks(entries, before, kind, scale), k == 0)
        table_ = written.put(rows, f"round-{k}")
        state, before, entries = table_.where("sums IS NULL"), entries, updated(entries, table_)
        written.drop(f"round-{k - 1}")
    codes = written.put(coded(state, Codebooks(entries, before, kind, scale)), "coded")
    written.drop(f"round-{ROUNDS - 1}")
    codes = codes.withColumn("_label", F.to_json(F.struct("label")) if label != "string" else F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    total = F.sum(F.col("error").cast("decimal(20,0)")).try_cast("long")
    groups = written.put(codes.groupBy("_label").agg(total.alias("label_error"), F.count("*").alias("rows")), "labels")
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    return join_groups(codes, groups, "_label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings."""
    return compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def _oracle() -> str:
    """Components as rows, rounds as tables one after another."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS z
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "pos AS (SELECT unnest(range(max(len(z)))) AS i FROM v)",
        f"x AS MATERIALIZED (SELECT rid, i, i // ((SELECT max(len(z)) FROM v) // {PARTS}) AS part, z[i + 1] AS value FROM v, pos)",
        f"c0 AS (SELECT rid - 1 AS j, i, part, CAST(value AS HUGEINT) AS value FROM x WHERE rid <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS (SELECT rid, x.part, j, sum((x.value - c.value) * (x.value - c.value)) AS d FROM x JOIN c{k} c ON x.i = c.i GROUP BY rid, x.part, j)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT rid, part, j, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, j) = 1)")
        if k < ROUNDS:
            mean = "(s - ((s % m) + m) % m) // m"
            steps.append(f"s{k} AS (SELECT a.j, x.i, sum(CAST(x.value AS HUGEINT)) AS s, count(*) AS m FROM a{k} a JOIN x ON a.rid = x.rid AND a.part = x.part GROUP BY a.j, x.i)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.j, c.i, c.part, coalesce({mean}, c.value) AS value FROM c{k} c LEFT JOIN s{k} s ON c.j = s.j AND c.i = s.i)")
    steps += [
        f"e AS (SELECT rid, CAST(sum(d) AS BIGINT) AS error, string_agg(printf('%02x', CAST(j AS INTEGER)), '' ORDER BY part) AS code FROM a{ROUNDS} GROUP BY rid)",
        f"h AS (SELECT sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY part, j, i)) AS codebooks_sha256 FROM c{ROUNDS})",
    ]
    return f"WITH {', '.join(steps)} SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM v JOIN e ON v.rid = e.rid, h"


ORACLE = _oracle()
