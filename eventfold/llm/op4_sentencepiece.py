"""SentencePiece encoding and decoding with offsets.

``Normaliser`` walks a text by the longest prefix found in the model's compiled character map (a double
array trie and a pool of replacement strings); it writes the normalised UTF-8 bytes and, for every one of
them, the offset of the source byte it came from. Pieces are spans of normalised bytes, so the alignment
projects each one to a byte span of the original text.

Merging is byte-pair encoding by piece score. No piece of the vocabulary may hold a white-space mark after
another character (checked when the model is loaded), so merges never cross the start of a word, words are
encoded independently, and a word's pieces are remembered between texts of a Python worker.

Decoding is the library's, as the ids are the library's.

Cases: a null text is an empty one and has no ids. Unknown characters become byte pieces; the last byte's
piece has the character's span, the others an empty span before it. Equal texts give equal ids. A very
long text is one sequence of words; a very long word costs n log n. An empty table gives no rows; columns
of the input named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from eventfold.llm.common import Memo, ddl, map_rows, table

MARK = "▁"
#: Words remembered by a Python worker.
REMEMBERED = 400_000
#: Longest word that is merged by ``merge_short``.
SHORT = 100
_NONE = 1 << 40
# Piece types of the model file.
NORMAL, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a protocol-buffer message; fixed-width values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}[kind] if kind in (1, 5) else varint()
            yield number, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: trie units, then zero-terminated replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key at a position, None if there is none."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != text[k]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        start, length = found
        return self.pool[start : self.pool.index(b"\0", start)], length

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Normaliser:
    def __init__(self, spec: bytes):
        given = dict(fields(spec))
        self.map = CharacterMap(given.get(2, b""))
        self.dummy_prefix, self.squeeze, self.escape = (bool(given.get(k, 1)) for k in (3, 4, 5))

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source offset in bytes."""
        raw = text.encode()
        if not raw:
            return "", np.zeros(1, "i8")
        if not self.map.units and not self.squeeze and self.escape:  # nothing but blanks changes
            source = np.arange(len(raw))
            blanks = np.frombuffer(raw, "u1") == 0x20
            if blanks.any():
                source = np.repeat(source, np.where(blanks, len(MARK.encode()), 1))
            head = np.zeros(len(MARK.encode()) * self.dummy_prefix, "i8")
            return MARK * self.dummy_prefix + text.replace(" ", MARK), np.concatenate([head, source, [len(raw)]])
        return self._walk(raw)

    def _walk(self, raw: bytes) -> tuple[str, np.ndarray]:
        blank = MARK.encode() if self.escape else b" "
        out, source, at, after_blank = bytearray(), [], 0, self.squeeze
        if self.squeeze:
            while at < len(raw) and self._step(raw, at)[0] == b" ":
                at += self._step(raw, at)[1]
            if at == len(raw):
                return "", np.array([len(raw)])
        if self.dummy_prefix:
            out += blank
            source += [at] * len(blank)
        while at < len(raw):
            piece, width = self._step(raw, at)
            if self.squeeze and after_blank:
                piece = piece.lstrip(b" ")
            if piece:
                written = piece.replace(b" ", blank)
                out += written
                source += [at] * len(written)
                after_blank = piece.endswith(b" ")
            at += width
        end = at
        while self.squeeze and out.endswith(blank):
            end = source[len(out) - len(blank)]
            del out[-len(blank) :], source[-len(blank) :]
        return out.decode(), np.array([*source, end])

    def _step(self, raw: bytes, at: int) -> tuple[bytes, int]:
        found = self.map.longest(raw, at)
        if found:
            return found
        width = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
        return raw[at : at + width], width


class Encoder:
    """A model file's encoder. ``encode`` gives ids and the byte span of each piece in the original text."""

    def __init__(self, path: str):
        pieces = []
        with open(path, "rb") as f:
            parts = [*fields(f.read())]
        for number, value in parts:
            if number == 1:
                given = dict(fields(value))
                pieces.append((given[1].decode(), struct.unpack("<f", given.get(2, b"\0" * 4))[0], given.get(3, NORMAL)))
        spec = next((v for n, v in parts if n == 3), b"")
        self.normalise = Normaliser(spec)
        self.rank = {p: (-score, i) for i, (p, score, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces) or any(regex.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            raise ValueError("pieces that cross words, user-defined and unused pieces are not supported")
        order = {p: k for k, p in enumerate(sorted(self.rank, key=self.rank.get))}
        ids = [self.rank[p][1] for p in order]
        self.names = [*map(str, ids)]
        self.packed = [self.pack(i, len(p.encode())) for i, p in zip(ids, order, strict=True)]
        #: Places in that order of two pieces that merge, to the place of what they make: scores fall along it.
        self.pairs = {(order[p[:k]], order[p[k:]]): n for p, n in order.items() for k in range(1, len(p)) if p[:k] in order and p[k:] in order}
        self.order = order
        self.bytes = [i for p, i in sorted((p, i) for i, (p, _, kind) in enumerate(pieces) if kind == BYTE)]
        if any(c not in self.rank for p in self.rank for c in p):
            raise ValueError("a piece has a character that is no piece")
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.words = Memo(lambda word: self._word(MARK + word), REMEMBERED)
        self.runs = Memo(self._word, REMEMBERED // 4)
        self.split = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    pack = staticmethod(struct.Struct("<ii").pack)

    def merge(self, word: str) -> list[int]:
        """Neighbours merge by best score, the leftmost first among equals; pieces as places in ``order``, unknown
        characters as -1 minus their code point."""
        parts = [*map(self.order.get, word)]
        if None in parts:
            parts = [self.order.get(c, -1 - ord(c)) for c in word]
        return self.merge_short(parts) if len(parts) <= SHORT else self.merge_long(parts)

    def merge_short(self, parts: list[int]) -> list[int]:
        """Looks for the best pair in a list, which is fastest for words of usual length."""
        of = self.pairs.get
        made = [*map(of, zip(parts, parts[1:], strict=False), repeat(_NONE))]
        while made and (best := min(made)) != _NONE:
            k = made.index(best)
            parts[k : k + 2] = (best,)
            del made[k]
            if k:
                made[k - 1] = of((parts[k - 1], best), _NONE)
            if k < len(made):
                made[k] = of((best, parts[k + 1]), _NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs, for words that are very long."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        gone = len(self.order)
        agenda: list[tuple[int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (made := self.pairs.get((parts[a], parts[b]), _NONE)) != _NONE:
                heapq.heappush(agenda, (made, a, b))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while agenda:
            made, a, b = heapq.heappop(agenda)
            if after[a] != b or self.pairs.get((parts[a], parts[b])) != made:
                continue
            parts[a], parts[b], after[a] = made, gone, after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [x for x in parts if x != gone]

    def _word(self, word: str) -> tuple[str, bytes]:
        """Ids joined by commas, and of each piece its id and the normalised bytes it takes: 0 for a byte before a
        character's last."""
        parts = self.merge(word)
        if min(parts) >= 0:
            return ",".join([self.names[x] for x in parts]), b"".join([self.packed[x] for x in parts])
        names, packed = [], []
        for x in parts:
            if x >= 0:
                names.append(self.names[x])
                packed.append(self.packed[x])
            else:
                raw = chr(-1 - x).encode()
                names += [str(self.bytes[b]) for b in raw]
                packed += [self.pack(self.bytes[b], 0) for b in raw[:-1]] + [self.pack(self.bytes[raw[-1]], len(raw))]
        return ",".join(names), b"".join(packed)

    def _words(self, normal: str) -> Iterator[tuple[str, bytes]]:
        """The words of a normalised text, each encoded; most texts have one mark before each word."""
        if normal[0] == MARK and 2 * MARK not in normal:
            return map(self.words.__getitem__, normal.split(MARK)[1:])
        return map(self.runs.__getitem__, self.split.findall(normal))

    def encode(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """Ids joined by commas, ids, and an array of (begin, end)."""
        normal, source = self.normalise(text)
        if not normal:
            return "", np.zeros(0, "<i4"), np.zeros((0, 2), "<i8")
        joined, packed = zip(*self._words(normal), strict=True)
        ids, widths = np.frombuffer(b"".join(packed), "<i4").reshape(-1, 2).T
        ends = np.cumsum(widths)
        spans = np.empty((len(ends), 2), "<i8")
        spans[:, 1] = source[ends]
        spans[0, 0], spans[1:, 0] = source[0], spans[:-1, 1]
        return ",".join(joined), np.ascontiguousarray(ids), spans


_LOADED: dict[str, tuple] = {}


def load(path: str) -> tuple:
    """The encoder and the library's processor for a model, once a Python worker."""
    if path not in _LOADED:
        import sentencepiece

        _LOADED[path] = Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ids and the flat (begin, end) byte offsets of their pieces."""
    df = df.drop("ids", "offsets")
    at = df.columns.index(text)

    def start():
        encoder, _ = load(path)

        def run(batch: dict) -> Iterator[tuple]:
            for row in zip(*batch.values(), strict=True):
                _, ids, spans = encoder.encode(row[at] or "")
                yield *row, ids, spans.ravel()

        return run

    return map_rows(df, f"{ddl(df)}, ids array<int>, offsets array<long>", start)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of ids, decoded text and spans of every document."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def start():
        encoder, library = load(path)

        def run(batch: dict) -> Iterator[tuple]:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                joined, ids, spans = encoder.encode(text or "")
                decoded = library.decode(ids.tolist()) if len(ids) else ""
                yield doc, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), zlib.crc32(spans.tobytes())

        return run

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return map_rows(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long", start)
