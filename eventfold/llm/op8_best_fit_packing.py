"""Best-fit packing planned on the histogram of lengths.

Only how many pieces there are of each length decides the plan, so best-fit decreasing runs over counts
(at most ``CAPACITY`` of them) on the driver. The plan is a short list of runs: the pieces of a length
with ranks r0, r0 + 1, ... fill consecutive sequences, some in each, from some offset. Pieces then take
their planned places by their rank within their length.

The rank needs no task to hold a whole length: pieces are numbered within (length, bucket), buckets are
dealt by a hash of the document, and the buckets' counts, added up in order, give each its first rank. A
length that a third of all pieces have is spread over as many tasks as there are buckets.

Texts are tokenised with tiktoken on the model file's own merges, which is a pass of native code a text. Its
ids are the library's if ids follow the order of merges, which is checked when a file is loaded. Any other
file, texts with a special token's name and texts with very long white space go through the library.

Cases: a null text is an empty one: one piece, the closing id alone. Repeated (doc_id, text) rows are
packed once each; of equal keys, which row takes which of their places is open, and their places are
interchangeable. An empty table gives no pieces. Of the input only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from eventfold.llm.common import Written, add_columns, map_rows, numbered, table

CAPACITY = 2048
END_ID = 0
#: White space that tiktoken's pattern engine is not given: its stack ends at some hundred thousand.
LONG_BLANK = 1000

# The pre-tokenizer's pattern, and the letters by which the model writes bytes: printable ones
# of Latin-1 for themselves, the others for the letters from U+0100 on.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_LETTER_BYTES = {chr(0x100 + k): b for k, b in enumerate(_HIDDEN)} | {chr(b): b for b in range(256) if b not in _HIDDEN}
_PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_TWO_BLANKS, _LONG_BLANK = re.compile(r"\s\s"), re.compile(rf"\s{{{LONG_BLANK}}}")


class Tokeniser:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        self.special = [t["content"] for t in given["added_tokens"]]
        self.fast = self.native(given)

    @cached_property
    def library(self):
        """The library's tokenizer, only loaded for a text or file that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def native(given: dict):
        """tiktoken's encoding by the file's merges, None where its ids could differ."""
        import tiktoken

        model, before = given["model"], given["pre_tokenizer"] or {}
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        plain = model["type"] == "BPE" and not any(model.get(o) for o in options) and given["normalizer"] is None
        if not plain or any(before.get(k) != v for k, v in _PRE_TOKENIZER.items()):
            return None
        ids = model["vocab"]
        ordered = [ids.get(a + b) for a, b in merges] == [*range(256, 256 + len(merges))]
        if not ordered or sorted(ids[c] for c in _LETTER_BYTES if c in ids) != [*range(256)]:
            return None
        ranks = {bytes(map(_LETTER_BYTES.__getitem__, w)): i for w, i in ids.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("merges", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def unusual(self, text: str) -> bool:
        """Whether a text has a special token's name or long white space, which would hold two steps of half its length."""
        if _TWO_BLANKS.search(text[:: LONG_BLANK // 2]) and _LONG_BLANK.search(text):
            return True
        return any(x in text for x in self.special)

    def __call__(self, text: str) -> bytes:
        if self.fast is None or self.unusual(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast(text)
        return np.array(ids, "<u4").tobytes()


_LOADED: dict[str, Tokeniser] = {}


def tokeniser(path: str) -> Tokeniser:
    """One for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Tokeniser(path)
    return _LOADED[path]


def cut(ids: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Piece number, first id's place and ids of a document's pieces; only the first may be shorter than the capacity."""
    n = len(ids) // 4
    start, number, stop = 0, 0, n % CAPACITY or min(n, CAPACITY)
    while start < n:
        yield number, start, ids[4 * start : 4 * stop]
        start, number, stop = stop, number + 1, stop + CAPACITY


def pieces_of(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every document's pieces."""

    def start():
        encode = tokeniser(path)

        def run(batch: dict) -> Iterator[tuple]:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                for number, first, ids in cut(encode(text or "") + END_ID.to_bytes(4, "little")):
                    row = doc, number, first, len(ids) // 4, zlib.crc32(ids)
                    yield (*row, np.frombuffer(ids, "<u4").astype("i4")) if keep_ids else row

        return run

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return map_rows(docs.select("doc_id", "text"), schema, start)


Run = tuple[int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts: runs (length, first rank, pieces a sequence, first sequence, first offset).

    ``free`` holds the open sequences by the room left in them, as ranges of sequence numbers. A piece goes
    where the least room is left that holds it, and so do the following ones of its length while they fit.
    """
    runs: list[Run] = []
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if room:
            if room not in free:
                bisect.insort(rooms, room)
            free.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, each, first, capacity - room))
                leave(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if full < n:
                if left:
                    runs.append((length, rank, left, first + full, capacity - room))
                    leave(room - left * length, first + full, 1)
                    full, left, rank = full + 1, 0, rank + left
                if full < n:
                    leave(room, first + full, n - full)
    return runs


def places(runs: list[Run], lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    table_ = np.array(sorted(runs), "i8").reshape(-1, 5)
    at = np.searchsorted(_key(table_[:, 0], table_[:, 1]), _key(lengths, ranks), side="right") - 1
    length, first, each, sequence, offset = table_[at].T
    assert (length == lengths).all()
    k = ranks - first
    return sequence + k // each, offset + k % each * length


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << 48) + rank


def pack(pieces: DataFrame) -> DataFrame:
    """``pieces`` with sequence_id and offset. Read three times, so give it as a written table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = spark.sparkContext.broadcast(plan(counts))
    ranked = numbered(pieces, "length", ["doc_id", "piece", "ids_crc32"], ["doc_id", "piece", "ids_crc32"], "rank", sum(counts.values()))

    def start():
        def run(lengths: list[int], ranks: list[int]) -> Iterator[tuple]:
            return zip(*(x.tolist() for x in places(runs.value, np.array(lengths, "i8"), np.array(ranks, "i8"))), strict=True)

        return run

    return add_columns(ranked, ["length", "rank"], "sequence_id long, offset long", start).drop("rank")


def pack_documents(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Places of all documents' pieces. With ``keep_ids``, a sequence is its pieces' ids in the order of offset."""
    written = Written(docs.sparkSession, "packing")
    return pack(written.put(pieces_of(docs, path, keep_ids), "pieces"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
