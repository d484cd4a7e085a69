"""Media columns: signature sniffing.

An Aho-Corasick automaton over magic numbers runs once over a value's bytes; every hit is handed to its
format's validator, which confirms the structure and computes the true length from the format's own
fields. A value whose first confirmed medium starts at byte 0 gets that type, whatever was declared;
confirmed media that start later, also inside others, are carved (type, start, length). A hit that fails its
validator is not reported.

Formats: wav (RIFF/WAVE, chunk sizes), png (chunk walk to IEND, checksums), gif (block walk to the trailer), jpeg
(marker walk to EOI), pdf (%PDF- to the last %%EOF), zip (central directory walked to its end record), gzip (one member
inflated and its checksum), ogg (pages of a stream walked to its last), flac (metadata blocks walked to a frame's
sync code; the format has no length, so it is reported as unknown, ``?``).

``store`` keeps any bytes losslessly as 8-bit mono samples of a WAV file, ``load`` reads them back.

Cases: a null value is an empty one; equal values give equal results, so ties and repeated rows cannot
disagree; a very long value is scanned once, in linear time apart from the validators' walks; an empty
table gives no rows; columns of the input named like the results are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.common import add_columns, map_rows, table

# The formats' magic numbers.
MAGIC = {
    "wav": b"RIFF", "png": b"\x89PNG\r\n\x1a\n", "gif87": b"GIF87a", "gif89": b"GIF89a", "jpeg": b"\xff\xd8\xff",
    "pdf": b"%PDF-", "zip": b"PK\x03\x04", "gzip": b"\x1f\x8b\x08", "flac": b"fLaC", "ogg": b"OggS\x00",
}
SAMPLE_RATE = 8000
UNIT = 64
HEADER = 44
#: Compressed bytes that a gzip check is fed at a time, and bytes that it makes of them at a time.
FED, MADE = 1 << 16, 1 << 20


def store(payload: bytes) -> bytes:
    """A WAV file whose 8-bit mono samples are the payload's bytes, padded to even length as RIFF asks."""
    size = len(payload)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", HEADER - 8 + size + size % 2, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", size)
    return head + payload + b"\0" * (size % 2)


def load(media: bytes) -> bytes:
    """The samples of a stored value, found by walking its chunks."""
    at = 12
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


class Value:
    """A value's bytes, and places in them that validators of many hits need, looked for once."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def last_eof(self) -> int:
        return self.data.rfind(b"%%EOF")

    @cached_property
    def zip_ends(self) -> list[int]:
        return [m.start() for m in re.finditer(rb"PK\x05\x06", self.data)]


#: The length of a medium whose format does not tell it.
UNKNOWN = -1


def _wav(b: bytes, at: int) -> int:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end, k, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return 0
    while k + 8 <= end:
        kind, size = struct.unpack_from("<4sI", b, k)
        if k + 8 + size > end:
            return 0
        seen.add(kind)
        k += 8 + size + size % 2
    return end - at if {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int) -> int:
    k, first = at + 8, True
    while k + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, k)
        end = k + 12 + size
        if end > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[k + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if kind == b"IEND":
            return end - at
        k, first = end, False
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    table_of = lambda flags: 3 * 2 ** ((flags & 7) + 1) if flags & 0x80 else 0
    k = at + 13 + table_of(b[at + 10])
    while k < len(b):
        mark = b[k]
        if mark == 0x3B:
            return k + 1 - at
        if mark == 0x2C and k + 10 < len(b):
            k += 11 + table_of(b[k + 9])
        elif mark == 0x21:
            k += 2
        else:
            return 0
        while k < len(b) and b[k]:
            k += 1 + b[k]
        k += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    k = at + 2
    while k + 4 <= len(b) and b[k] == 0xFF:
        mark = b[k + 1]
        if mark == 0xD9:
            return k + 2 - at
        size = struct.unpack_from(">H", b, k + 2)[0]
        if size < 2 or mark == 0xD8:
            return 0
        k += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next real marker
            while (k := b.find(b"\xff", k)) >= 0 and k + 1 < len(b) and (b[k + 1] == 0 or 0xD0 <= b[k + 1] <= 0xD7):
                k += 2
            if k < 0:
                return 0
    return k + 2 - at if b[k : k + 2] == b"\xff\xd9" else 0


def _pdf(v: Value, at: int) -> int:
    return v.last_eof + 5 - at if v.data[at + 5 : at + 6].isdigit() and v.last_eof > at else 0


def _zip(v: Value, at: int) -> int:
    """The first end record whose directory starts and ends where it says, with as many entries."""
    b = v.data
    next_ = bisect.bisect(v.zip_ends, at)
    end = v.zip_ends[next_] if next_ < len(v.zip_ends) else len(b)
    if end + 22 > len(b):
        return 0
    entries, size, start, comment = struct.unpack_from("<HIIH", b, end + 10)
    k = at + start
    if k + size != end or end + 22 + comment > len(b):
        return 0
    for _ in range(entries):
        if b[k : k + 4] != b"PK\x01\x02" or k + 46 > end:
            return 0
        k += 46 + sum(struct.unpack_from("<HHH", b, k + 28))
    return end + 22 + comment - at if k == end else 0


def _gzip(b: bytes, at: int) -> int:
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    inflate, view = zlib.decompressobj(31), memoryview(b)
    try:
        for k in range(at, len(b), FED):
            part = view[k : k + FED]
            while len(part) and not inflate.eof:
                inflate.decompress(part, MADE)
                part = inflate.unconsumed_tail
            if inflate.eof:
                return k + len(view[k : k + FED]) - len(inflate.unused_data) - at
        while inflate.decompress(b"", MADE):
            pass
    except zlib.error:
        return 0
    return len(b) - at - len(inflate.unused_data) if inflate.eof else 0


def _flac(b: bytes, at: int) -> int:
    k, first = at + 4, True
    while k + 4 <= len(b):
        kind, size = b[k] & 0x7F, int.from_bytes(b[k + 1 : k + 4])
        if kind == 127 or first != (kind == 0) or first and size != 34:
            return 0
        last, k, first = b[k] & 0x80, k + 4 + size, False
        if last:
            return UNKNOWN if b[k : k + 1] == b"\xff" and b[k + 1 : k + 2] in (b"\xf8", b"\xf9") else 0
    return 0


def _ogg(b: bytes, at: int) -> int:
    """From the first page of a stream (its flag) over pages of the same stream in sequence to the last one (its flag)."""
    k, number, serial = at, 0, b[at + 14 : at + 18]
    while k + 27 <= len(b) and b[k : k + 5] == b"OggS\0":
        flags, segments = b[k + 5], b[k + 26]
        if flags & 0xF8 or bool(flags & 2) != (number == 0) or b[k + 14 : k + 18] != serial or int.from_bytes(b[k + 18 : k + 22], "little") != number:
            return 0
        k, number = k + 27 + segments + sum(b[k + 27 : k + 27 + segments]), number + 1
        if k > len(b):
            return 0
        if flags & 4:
            return k - at
    return 0


VALIDATORS = {"wav": _wav, "png": _png, "gif87": _gif, "gif89": _gif, "jpeg": _jpeg, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "flac": _flac, "ogg": _ogg}


WHOLE = ("pdf", "zip")  # validators that take a ``Value``


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, magic in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def sniff(machine: ahocorasick.Automaton, value: bytes) -> list[tuple[str, int, int]]:
    """Confirmed media as (type, start, length), by start."""
    found, whole = [], Value(value)
    for last, (kind, width) in machine.iter(value.decode("latin-1")):
        at = last + 1 - width
        if length := VALIDATORS[kind](whole if kind in WHOLE else value, at):
            found.append((kind.rstrip("79").rstrip("8"), at, length))
    return sorted(found, key=lambda x: (x[1], x[0]))


def describe(found: list[tuple[str, int, int]], declared: str | None, size: int) -> tuple[str, str]:
    """The corrected type, and a line with type, declared type, length confirmed, and all carved media."""
    kind = next((k for k, at, _ in found if at == 0), "unknown")
    whole = next((n for _, at, n in found if at == 0), 0)
    length = lambda n: "?" if n == UNKNOWN else n
    carved = ",".join(f"{k}@{at}+{length(n)}" for k, at, n in found if at)
    return kind, f"type={kind};declared={declared or 'none'};length={length(whole)}/{size};carved={carved}"


def sniff_column(df: DataFrame, value: str, declared: str) -> DataFrame:
    """``df`` with media_type and media_feature from the bytes in ``value``, against the type in ``declared``."""
    df = df.drop("media_type", "media_feature")

    def start():
        machine = automaton()

        def one(data, said) -> tuple[str, str]:
            data = bytes(data or b"")
            return describe(sniff(machine, data), said, len(data))

        return lambda values, types: map(one, values, types)

    return add_columns(df, [value, declared], "media_type string, media_feature string", start)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as samples, read back, and sniffed although declared as plain bytes."""
    docs = table(spark, sf_dir, "documents", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("value"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def start():
        machine = automaton()

        def run(batch: dict) -> Iterator[tuple]:
            for doc, text in zip(batch["doc_id"], batch["value"], strict=True):
                media = store(text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT)))
                back = load(media)
                feature = describe(sniff(machine, media), "octets", len(media))[1]
                yield doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature

        return run

    return map_rows(docs, schema, start)
