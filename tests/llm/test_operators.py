"""The operators on small inputs: against brute force, the libraries, SQL, and in odd cases."""

import base64
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from eventfold.llm import op1_sharding as o1
from eventfold.llm import op2_quality_rules as o2
from eventfold.llm import op3_chat_formatting as o3
from eventfold.llm import op4_sentencepiece as o4
from eventfold.llm import op5_pii as o5
from eventfold.llm import op6_media_columns as o6
from eventfold.llm import op7_url_filters as o7
from eventfold.llm import op8_best_fit_packing as o8
from eventfold.llm import near, queries
from eventfold.llm import op9_jaccard_join as o9
from eventfold.llm import op10_toxicity as o10
from eventfold.llm import op11_vector_codes as o11
from eventfold.llm import op12_collocations as o12
from eventfold.llm import op13_minhash_dedup as o13

public = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sa") for b in ("n", "r", "sto", "ve", "x", "")]
ODD = [None, "", " ", "\n\n", "one", "a b c d", "a b c d", "é 日本 😀 \t x", "word " * 30000, "x" * 40000]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Odd texts, copies, near copies, repeated rows, null columns and columns with clashing names."""
    base = [prose(k, 120) for k in range(12)]
    near = [" ".join(base[0].split()[:110] + prose(90 + k, 10).split()) for k in range(5)]
    texts = ODD + base + [base[3]] * 5 + near
    rows = [(k, t, "en", None if k % 7 == 0 else "s", len(t or ""), "clash", k) for k, t in enumerate(texts)]
    rows += [rows[12], (None, base[5], None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, rank long")
    path = str(tmp_path_factory.mktemp("docs"))
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, found = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    order = [df.columns.index(c) for c in found.columns]
    assert sorted(repr([tuple(r)[k] for k in order]) for r in df.collect()) == sorted(repr(list(r)) for r in found.fetchall())


# 1


def test_differencing_balances_and_keeps_given_parts():
    r = np.random.default_rng(1)
    sizes = r.integers(8, 5000, 3000)
    sums = np.bincount(o1.differencing(sizes, 24), sizes, 24)
    assert sums.max() - sums.min() <= 8
    given = np.array([2 * 10**5, 0, 10**5, *[0] * 21])
    sums = np.bincount(o1.differencing(sizes, 24, given), sizes, 24) + given
    assert sums.max() - sums.min() <= 8
    assert sorted(np.bincount(o1.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]  # as in the published example


def test_sharding(spark, docs):
    rows = o1.shard(docs).collect()
    assert len(rows) == docs.count()
    by_shard, text = defaultdict(list), {r["doc_id"]: r["text"] for r in docs.collect()}
    shard_of = defaultdict(set)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        t = text[r["doc_id"]]
        shard_of[t].add(r["shard"])
        assert r["size"] == 8 + len((t or "").encode()) and r["text_crc32"] == zlib.crc32((t or "").encode())
    assert all(len(s) == 1 for s in shard_of.values()) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert o1.shard(docs.where("false")).count() == 0


# 2


def brute_counts(text):
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    at = defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k : k + 8])].append(k)
    repeated = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts():
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "b", " ", "\n", "#", "é", " ", "\x0b", "c "]) for _ in range(r.randint(0, 300))) for _ in range(300)]
    for t in [*texts, *(t for t in ODD if t), prose(1, 40) + " " + prose(1, 40)]:
        assert o2.base_counts(t) == brute_counts(t), t[:60]


def test_quality_verdicts(docs):
    rows = {r["doc_id"]: r for r in o2.quality(docs).collect()}
    assert rows[10]["kept"] is True and not rows[0]["kept"] and rows[0]["n_words"] == 0 and not rows[8]["kept"]
    noise = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/ ") for _ in range(9000))
    packer = o2.zstandard.ZstdCompressor(level=o2.LEVEL)
    assert not o2.judge(noise, packer)[-1] and not o2.judge(" ".join(f"{k}{k}{k}" for k in range(1000)) + "ab " * 3000, packer)[-1]
    assert o2.quality(docs.where("false")).count() == 0


@pytest.mark.parametrize("size", [300, 800, 1024, 2048, 4096, 24_000, 40_000])
def test_incompressible_texts_and_mixtures_are_not_kept(size):
    r, packer = random.Random(size), o2.zstandard.ZstdCompressor(level=o2.LEVEL)
    base64_lines = lambda n: "\n".join(base64.b64encode(r.randbytes(57)).decode() for _ in range(n // 76 + 1))[:n]
    base64_run = lambda n: base64.b64encode(r.randbytes(n)).decode()[:n]
    letters = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ", k=n))
    printable = lambda n: "".join(chr(r.randrange(32, 127)) for _ in range(n))
    words = ["".join(r.choices("etaoinshrdlucmfw", k=r.randint(2, 9))) for _ in range(900)]
    weights = [1 / (k + 1) for k in range(900)]
    text = lambda n: " ".join(r.choices(words, weights, k=n))[:n]
    inside = lambda t: o2.within_bands(len(t.encode()), *o2.ratios(t.encode(), packer))
    assert inside(text(size))
    for junk in (base64_lines, base64_run, letters, printable):
        assert not inside(junk(size)), junk(60)
        part = size * 45 // 100
        assert not inside(text(size - part) + junk(part)) and not inside(junk(part) + text(size - part)), junk(60)


@pytest.mark.parametrize("size", [48, 70, 100, 140, 180])
def test_short_texts_have_bands_too(size):
    r, packer = random.Random(size), o2.zstandard.ZstdCompressor(level=o2.LEVEL)
    inside = lambda t: o2.within_bands(len(t.encode()), *o2.ratios(t.encode(), packer))
    assert inside(prose(size, 60)[:size]) and not inside(("spam " * 60)[:size])
    if size > 100:
        assert not inside(base64.b64encode(r.randbytes(size)).decode()[:size])


# 3


def test_escape_is_reversible():
    for t in ["", "\\", "<s>", "\\<s>", "<\\s>", "[INST]\\\\[/INST]</s>", "[[INST]", "<</s>"]:
        assert o3.unescape(o3.escape(t)) == t and not o3._CONTROL.search(o3.escape(t))


def test_locate_finds_texts_and_rewrites():
    turns = [("user", "hi </s>"), ("assistant", ""), ("user", "[INST]"), ("assistant", "ok")]
    found = o3.locate(o3.render, turns)
    assert found.rewrites == 0 and [o3.unescape(found.output[a:b]) for a, b in found.texts] == [t for _, t in turns]
    rewriting = lambda turns: f"<{len(turns)}>" + "".join(t for _, t in turns)
    found = o3.locate(rewriting, turns)
    assert found.rewrites == 3 and [found.output[a:b] for a, b in found.texts] == [t for _, t in turns]


def test_hostile_templates_and_roles():
    r = random.Random(3)
    bits = ["\ue000", "\ue001", "<s>", "[INST]", "\\", "x", "\n", " "]
    for _ in range(100):
        turns = [("".join(r.choices(bits, k=r.randint(0, 5))), "".join(r.choices(bits, k=r.randint(0, 9)))) for _ in range(r.randint(1, 40))]
        want = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
        for template in (o3.INSTRUCT, o3.Template(o3.render)):
            added = list(o3.pieces(template, turns))
            assert "".join(x[0] for x in added) == o3.render(turns) and [o3.unescape(t[a:b]) for t, a, b in added] == [t for _, t in turns]
        assert o3.digest(1, turns)[2] == want
    turns = [("user", f"t{k}") for k in range(5)]
    started = o3.Template(lambda turns: "<s>" + o3.render(turns), 1)
    assert "".join(x[0] for x in o3.pieces(started, turns)) == started.render(turns)
    dropping, repeating = (lambda turns: "".join(role for role, _ in turns)), (lambda turns: "".join(t + t for _, t in turns))
    growing, counting = (lambda turns: "x" * len(turns) + ">" + "".join(t for _, t in turns)), (lambda turns: "".join(f"{k}:{t}" for k, (_, t) in enumerate(turns)))
    for template in (o3.Template(dropping), o3.Template(repeating, 1), o3.Template(growing, 1), o3.Template(counting, 1)):
        with pytest.raises(ValueError, match="template"):
            list(o3.pieces(template, turns))
    added = list(o3.pieces(o3.Template(growing), turns))
    assert "".join(x[0] for x in added) == growing(turns) and [t[a:b] for t, a, b in added] == [t for _, t in turns]


def test_long_and_odd_conversations(spark, monkeypatch):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(50)] + [(2, 0, None, None), (2, 0, "assistant", "x"), (None, 1, "user", "</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in o3.digest_conversations(df).collect()}
    said = "".join(f"t{k}" for k in range(1, 50, 2))
    assert found[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and found[1]["n_turns"] == 50
    assert found[2]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\nx\n").hexdigest() and found[None]["n_turns"] == 1
    whole = o3.render([("assistant" if k % 2 else "user", f"t{k}") for k in range(50)])
    monkeypatch.setattr(o3, "PART_CHARS", 100)
    parts = sorted((r["start"], r["formatted"], r["loss_spans"]) for r in o3.format_conversations(df).where("conv_id = 1").collect())
    assert len(parts) > 5 and "".join(x[1] for x in parts) == whole
    assert "".join(whole[a:b] for x in parts for a, b in x[2]) == said
    assert o3.format_conversations(df.where("false")).count() == 0


# 4


@pytest.fixture(scope="module")
def pieces():
    return o4.load(public.path("piece_bpe_32k.model"))


def test_encoding_equals_the_library(pieces):
    encoder, library = pieces
    r = random.Random(4)
    texts = [t for t in ODD if t] + ["".join(r.choice(["a", "the ", "▁", " ", "\n", "ß", "日", "😀", "</s>", "<0x41>", "\x00", "ing"]) for _ in range(r.randint(1, 80))) for _ in range(300)]
    for t in texts:
        joined, ids, spans = encoder.encode(t)
        assert ids.tolist() == library.encode(t) == [int(x) for x in joined.split(",")], t[:50]
        if len(t) < 200:
            assert [tuple(x) for x in spans.tolist()] == [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]
    word = [encoder.order.get(c, -1 - ord(c)) for c in "understandings" * 9]
    assert encoder.merge_short(list(word)) == encoder.merge_long(list(word))


def darts(keys):
    """A compiled map for a few keys, laid out one node after another in a sparse table of units."""
    import struct

    pool, units, free = b"", {}, [1]
    trie: dict = {}
    for key, value in keys.items():
        node = trie
        for b in key.encode():
            node = node.setdefault(b, {})
        node[-1] = len(pool)
        pool += value.encode() + b"\0"

    def lay(node, at, label):
        base = free[0] * 256
        free[0] += 1
        units[at] = ((at ^ base) << 10) | (0x100 if -1 in node else 0) | label
        if -1 in node:
            units[base] = node[-1] | 1 << 31
        for b, child in node.items():
            if b >= 0:
                lay(child, base ^ b, b)

    lay(trie, 0, 0)
    size = max(units) + 1
    return struct.pack("<I", 4 * size) + b"".join(struct.pack("<I", units.get(k, 0)) for k in range(size)) + pool


def test_character_map_takes_the_longest_prefix_and_keeps_sources():
    blob = darts({"ﬁ": "fi", "a": "A", "ab": "<ab>", "\t": " ", "x": ""})
    found = o4.CharacterMap(blob)
    assert found.longest(b"abc", 0) == (b"<ab>", 2) and found.longest(b"ac", 0) == (b"A", 1) and found.longest(b"z", 0) is None
    spec = bytes([0x12]) + bytes(_varint(len(blob))) + blob + bytes([0x18, 1, 0x20, 1, 0x28, 1])
    text, source = o4.Normaliser(spec)("  ab\tﬁ xa ")
    assert text == "▁<ab>▁fi▁A" and source.tolist() == [2] * 3 + [2] * 4 + [4] * 3 + [5] * 2 + [8] * 3 + [10, 11]


def _varint(n):
    while n > 127:
        yield n & 127 | 128
        n >>= 7
    yield n


def test_encode_frame(docs, pieces):
    rows = o4.encode(docs, public.path("piece_bpe_32k.model")).collect()
    assert len(rows) == docs.count() and all(len(r["offsets"]) == 2 * len(r["ids"]) and pieces[1].decode(r["ids"]) == (r["text"] or "") for r in rows if r["text"] != "\n\n")


# 5

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, said):
    d = re.sub("[^0-9]", "", said)
    luhn = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or kind == "ip" and all(int(x) <= 255 for x in said.split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15


def test_base_spans_equal_brute_force(spark):
    r = random.Random(5)
    bits = ["1", "2", "55", ".", "-", " ", "@", "a", "b", "+", "(", ")", "%", "é", "😀", "4111111111111111", "a@b.c", "1.2.3.4", "_", "+1 (202) 555-0147"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["1" * 20000, "a" * 30000 + "@", "1-" * 20000 + "1", "a@b" + ".c" * 20000, "+1" + " " * 30000 + "23456789", None]
    found = o5.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {}).select("doc_id", o5.written("base_spans").alias("s")).collect()
    for row in found:
        t = texts[row["doc_id"]] or ""
        want = sorted((m.start(), no, m.end(), k) for no, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t) if passes(k, m[0]))
        assert row["s"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in want), t[:80]


def test_weak_supervision_accepts_secrets_and_leaves_words(spark):
    r = random.Random(6)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = [f'some words token = "{hexes(40)}" and more' for _ in range(40)] + [f"look at release/documentVersion{k}Final2024 now" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    accepted = o5.learn(df)
    spans = {x["doc_id"]: x["spans"] for x in o5.find_spans(df, accepted).select("doc_id", o5.written("spans").alias("spans")).collect()}
    assert all(spans[k].startswith("secret:20:60") for k in range(40)) and not any(spans[k] for k in range(40, 80))
    assert o5.redact(df, accepted).where("doc_id = 0").first()["text"] == 'some words token = "<secret>" and more'
    assert o5.learn(df.where("false")) == {"secret": [], "name": []}


def test_names_by_gazetteer_and_context(spark):
    rows = [f"we wrote to Mrs {a} {b}{k} yesterday".replace(str(k), "") for k in range(40) for a, b in [(("Anna", "Klaus")[k % 2], "Mi" + "abcdefgh"[k % 8] + "er")]]
    rows += ["Erthnt Ontiat was here. The End came", "Then Reties Onher went"] * 20
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = {x["doc_id"]: x["spans"] for x in o5.find_spans(df, o5.learn(df)).select("doc_id", o5.written("spans").alias("spans")).collect()}
    assert all("name:" in spans[k] for k in range(40)) and not any(spans[k] for k in range(40, 80)), spans


def test_texts_of_very_many_matches(spark):
    n = 20_000
    text = " ".join(f"a{k}@b.com x1y2z3w4{k:05d}" for k in range(n // 2)) + " end"
    df = spark.createDataFrame([(1, text), (2, "no")], "doc_id long, text string")
    accepted = {"secret": ["8|mixed|many|blank", "8|mixed|some|blank", "8|mixed|one|blank"]}
    found = o5.find_spans(df, accepted).where("doc_id = 1").select(o5.written("spans").alias("s")).first()["s"]
    want = sorted((m.start(), m.end(), k) for k, p in (("email", PATTERNS["email"]), ("secret", r"x1y2z3w4\d+")) for m in re.finditer(p, text))
    assert found == ",".join(f"{k}:{a}:{b}" for a, b, k in want)
    assert o5.redact(df, accepted).where("doc_id = 1").first()["text"] == "<email> <secret> " * (n // 2) + "end"


def test_running_equals_accumulation(spark):
    r = random.Random(3)
    rows = [[r.randint(0, 99) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 128, 1000)]
    df = spark.createDataFrame([(x,) for x in rows], "v array<int>").select("v", o5.running(F.col("v"), lambda a, b: a + b).alias("s"), o5.running(F.col("v"), F.greatest).alias("m"))
    for x in df.collect():
        assert x["s"] == [sum(x["v"][: k + 1]) for k in range(len(x["v"]))] and x["m"] == [max(x["v"][: k + 1]) for k in range(len(x["v"]))]


def test_spans_run_no_python(docs):
    plan = o5.find_spans(docs, {"secret": ["40|hex|many|sign"]})._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 6


def test_store_is_lossless_and_media_are_carved():
    import io
    import wave

    for data in (b"", b"abc", bytes(range(256)) * 3):
        assert o6.load(o6.store(data)) == data
        with wave.open(io.BytesIO(o6.store(data))) as w:
            assert w.readframes(w.getnframes()) == data and w.getsampwidth() == 1
    gif = b"GIF89a" + b"\1\0\1\0\x80\0\0" + b"\0" * 6 + b",\0\0\0\0\1\0\1\0\0\2\2\x44\1\0;"
    png_chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    png = o6.MAGIC["png"] + png_chunk(b"IHDR", b"\0" * 13) + png_chunk(b"IEND", b"")
    import gzip

    zipped = gzip.compress(b"hello")
    found = o6.sniff(o6.automaton(), b"noise GIF89a RIFF" + gif + b"--" + png + zipped)
    start = 17
    assert found == [("gif", start, len(gif)), ("png", start + len(gif) + 2, len(png)), ("gzip", start + len(gif) + 2 + len(png), len(zipped))]
    assert o6.describe(o6.sniff(o6.automaton(), png), "jpeg", len(png))[0] == "png"
    assert o6.sniff(o6.automaton(), png[:-1]) == []


def test_validators_confirm_structure_and_length():
    import gzip
    import io
    import zipfile

    machine = o6.automaton()
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a", "hello")
        z.writestr("b/c", b"x" * 5000)
    zipped = zipped.getvalue()
    page = lambda number, flags, body, serial=b"abcd": b"OggS\0" + bytes([flags]) + b"\0" * 8 + serial + number.to_bytes(4, "little") + b"\0" * 4 + bytes([1, len(body)]) + body
    ogg = page(0, 2, b"head") + page(1, 0, b"more") + page(2, 4, b"end")
    flac = b"fLaC" + b"\x00\0\0\x22" + b"\0" * 34 + b"\x84\0\0\x04abcd" + b"\xff\xf8data"
    big = gzip.compress(bytes(range(256)) * 20000)
    pdf = b"%PDF-1.4 text %%EOF"
    for kind, data in (("zip", zipped), ("ogg", ogg), ("gzip", big), ("pdf", pdf)):
        assert (kind, 2, len(data)) in o6.sniff(machine, b"--" + data + b"tail"), kind
    assert o6.sniff(machine, flac) == [("flac", 0, o6.UNKNOWN)] and "length=?/" in o6.describe(o6.sniff(machine, flac), None, len(flac))[1]
    broken = [zipped.replace(b"PK\x01\x02", b"PK\x01\x03"), ogg[:-4], page(0, 2, b"a") + page(2, 4, b"b"), flac[:-6], b"fLaC\0\0\0\x22", big[:-1], b"%PDF-x %%EOF"]
    assert [o6.sniff(machine, x) for x in broken] == [[]] * len(broken)
    for hostile in (b"%PDF-1" * 200_000, b"PK\x03\x04" * 200_000, b"\x1f\x8b\x08" * 100_000, b"\xff\xd8\xff" * 100_000, b"OggS\0\2" * 50_000):
        assert o6.sniff(machine, hostile) == []


def test_sniff_frame(spark):
    df = spark.createDataFrame([(1, bytearray(o6.store(b"x")), "png", None), (2, None, None, 5)], "id long, value binary, declared string, media_type long")
    rows = {r["id"]: r for r in o6.sniff_column(df, "value", "declared").collect()}
    assert rows[1]["media_type"] == "wav" and rows[2]["media_type"] == "unknown"


# 7

URLS = [None, "", "nothing", "http://Example.COM/en/x", "https://www.example.com/en/1?q", "https://a.example.net/es/", "http://net/fr/#x", "http://xnet/es/", "http://example.com", "http://example.com/en", "x://h//en/", "http://b.com/a", "a://b://c.com/"]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in o7.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_by_broadcast_and_by_shards(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(3, URLS[3])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    want = sorted(repr((k, *brute_url(u))) for k, u in [*enumerate(URLS), (3, URLS[3])])
    columns = ("page_id", "host", "path", "rule", "verdict")
    assert sorted(repr(tuple(r)) for r in o7.judge_urls(spark, df, o7.RULES).select(*columns).collect()) == want
    rules = spark.createDataFrame(list(o7.RULES), "verdict string, rule string")
    assert sorted(repr(tuple(r)) for r in o7.judge_by_shards(df, rules).select(*columns).collect()) == want
    assert o7.judge_urls(spark, df.where("false"), []).count() == 0 == o7.judge_by_shards(df.where("false"), rules).count()
    assert {r["rule"] for r in o7.judge_by_shards(df, rules.where("false")).collect()} == {None}


def test_both_ways_agree_on_many_rules_and_odd_urls(spark, monkeypatch):
    r = random.Random(7)
    label = lambda: "".join(r.choice("abä日") for _ in range(r.randint(1, 2)))
    rule = lambda: ".".join(label() for _ in range(r.randint(1, 3))) + "/" + r.choice(["", "a", "ä/", "日a", "a/b/"])
    rules = [(r.choice(["allow", "block"]), rule()) for _ in range(3000)]
    urls = [f"http://{'.'.join(label() for _ in range(r.randint(1, 4)))}/{r.choice(['', 'a', 'ä/x', '日ab', 'a/b/c'])}" for _ in range(2000)]
    urls += ["http://" + "a." * 100_000 + "b/a", "http://" + "." * 5000, "http://a/" + "a" * 100_000] + [urls[0]] * 500
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    columns = ("page_id", "host", "path", "rule", "verdict")
    want = sorted(map(tuple, o7.judge_urls(spark, df, rules).select(*columns).collect()))
    assert sum(x[3] is not None for x in want) > 1000 and len({v for v, x in rules if (v == "block") and ("allow", x) in rules}) == 1
    monkeypatch.setattr(o7, "SHARD_RULES", 50)
    monkeypatch.setattr(o7, "PROBED", 64)
    assert sorted(map(tuple, o7.judge_by_shards(df, spark.createDataFrame(rules, "verdict string, rule string")).select(*columns).collect())) == want
    best = {}
    for v, x in rules:
        best[x] = "block" if v == "block" else best.get(x, "allow")
    for _, host, path, found, verdict in want[::17]:
        fits = [(len(x.encode()), x) for x in best for h, _, p in [x.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)] if len(host) < 1000 else None
        assert fits is None or (found, verdict) == ((max(fits)[1], best[max(fits)[1]]) if fits else (None, "allow"))


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(o7.xxhash, "xxh64_intdigest", lambda b: len(b))
    index = o7.DigestIndex(o7.build_index([("block", "aa/"), ("allow", "bb/")]))
    assert [index.string(i) for i in index.find([b"bb/", b"aa/"])] == [b"bb/", b"aa/"] and index.find([b"cc/"])[0] == -1


# 8


def test_tokens_equal_the_library():
    own = o8.tokeniser(public.path("byte_bpe_50k.json"))
    assert own.fast
    r = random.Random(8)
    texts = [t or "" for t in ODD] + [" " * 400_000 + "x", "x" + "\n" * 2000]
    texts += ["".join(chr(c) + f" {chr(c)}1" for c in range(k, k + 4096) if not 0xD800 <= c < 0xE000) for k in range(0, 0x20000, 4096)]
    texts += ["".join(r.choice(["a", " the", "'s", " ", "\n", "ß", "日", "😀", "<|endoftext|>", "12", "!?", "\t", "\u3000"]) for _ in range(r.randint(0, 40))) for _ in range(500)]
    for t in texts:
        assert own(t) == np.array(own.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:50]


def test_plan_is_best_fit_over_counts():
    r = random.Random(9)
    for _ in range(30):
        counts = {r.randint(1, 50): r.randint(1, 30) for _ in range(12)}
        runs = o8.plan(counts, 50)
        lengths, ranks = np.repeat(list(counts), list(counts.values())), np.concatenate([np.arange(n) for n in counts.values()])
        fill: dict = {}
        for s, at, n in sorted(zip(*map(np.ndarray.tolist, o8.places(runs, lengths, ranks)), lengths.tolist(), strict=True)):
            assert fill.get(s, 0) == at
            fill[s] = at + n
        rooms: list = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [k for k, room in enumerate(rooms) if room >= n]
            k = min(fits, key=rooms.__getitem__) if fits else len(rooms)
            rooms[k:] = rooms[k:] if fits else [50]
            rooms[k] -= n
        assert max(fill.values()) <= 50 and len(fill) == len(rooms)


def test_packing(docs):
    rows = o8.pack_documents(docs, public.path("byte_bpe_50k.json"), keep_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) <= o8.CAPACITY and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for places in by_sequence.values():
        assert [a for a, _ in sorted(places)] == np.cumsum([0, *(n for _, n in sorted(places))]).tolist()[:-1]
    long = sorted(by_doc[8], key=lambda r: r["piece"])
    assert [r["length"] for r in long[1:]] == [2048] * (len(long) - 1) and [r["start"] for r in long] == np.cumsum([0, *(r["length"] for r in long)]).tolist()[:-1]
    assert by_doc[0][0]["ids"] == [0] and len(by_doc[12]) == 2
    assert o8.pack_documents(docs.where("false"), public.path("byte_bpe_50k.json")).count() == 0


# 9


def brute_components(rows, width=5, percent=75):
    def own(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])

    sets = [(d, own(t)) for d, t in rows]
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                root[max(top(a), top(b))] = min(top(a), top(b))
    low = {}
    for k, (d, _) in enumerate(sets):
        low[top(k)] = min((x for x in (low.get(top(k)), d) if x is not None), default=None)
    return sorted(repr((d, len(s), low[top(k)] if s else d)) for k, (d, s) in enumerate(sets))


def test_components_equal_brute_force(spark, docs):
    r = random.Random(10)
    base = [prose(500 + k, n) for k, n in enumerate([5, 6, 8, 12, 40, 40, 90, 200, 400])]
    rows, k = [], 100
    for t in base:
        for _ in range(9):
            w = t.split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((k, " ".join(w) + " " + base[4] * r.choice([0, 0, 1])))
            k += 1
    more = spark.createDataFrame(rows, "doc_id long, text string")
    path = o9.Written(spark, "test").put(docs.select("doc_id", "text").unionByName(more), "docs")
    want = brute_components([(x["doc_id"], x["text"]) for x in path.collect()])
    assert sorted(repr(tuple(x)) for x in o9.join_copies(path).collect()) == want
    assert o9.join_copies(path.where("false")).count() == 0


def linked(a, b, percent=75):
    return bool(near.linked_ones(a, [b], percent)[0])


@pytest.mark.parametrize(("index", "percent"), [(o9.tree_index, 75), (o13.hamming_index, 80)])
def test_blocks_find_every_link(index, percent):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 60).astype("u8")
    sets = [np.unique(np.concatenate([r.choice(base, 60 - k % 30, replace=False), r.integers(0, 2**63, k % 30).astype("u8")])) for k in range(700)]
    labels = [bytes([k % 251, k % 7]) for k in range(700)]
    rows = [(k, lab, True, True, True, k.to_bytes(2, "big"), s.tobytes()) for k, (s, lab) in enumerate(zip(sets, labels, strict=True))]
    assert o9.CountTree(np.array([o9.counts_of(s) for s in sets], "f4"), np.array([len(s) for s in sets])).parts

    def groups(links):
        part = {lab: lab for lab in labels}

        def find(x):
            while part[x] != x:
                x = part[x]
            return x

        for a, b in links:
            part[find(labels[a])] = find(labels[b])
        return [find(lab) for lab in labels]

    brute = groups((a, b) for a in range(700) for b in range(a) if linked(sets[a], sets[b], percent))
    found = [(int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in near.block_links(rows, index, percent)]
    own = groups(found)
    assert all(linked(sets[a], sets[b], percent) for a, b in found) and len(found) < 700
    assert len(set(zip(own, brute, strict=True))) == len(set(own)) == len(set(brute)) > 1


@pytest.mark.parametrize("join", [o9.join_copies, o13.dedup])
def test_dealt_families_give_the_same_components(spark, monkeypatch, join):
    base = prose(77, 100).split()
    texts = [" ".join([*base[: 100 - k % 40], *prose(1000 + k, k % 40).split()]) for k in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, join(df).collect()))
    monkeypatch.setattr(near, "BLOCK", 10)
    monkeypatch.setattr(near, "TASK_LINKS", 25)
    assert sorted(map(tuple, join(df).collect())) == want


def test_components_of_contracted_links_and_of_many_tasks(spark, monkeypatch):
    r = random.Random(6)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(230)] + [(400 + k, 401 + k) for k in range(40)]
    root = {}
    for a, b in links:
        low, high = sorted((root.setdefault(a, a), root.setdefault(b, b)))
        root = {k: low if v == high else v for k, v in root.items()}
    df = spark.createDataFrame([(bytearray(a.to_bytes(2, "big")), bytearray(b.to_bytes(2, "big"))) for a, b in links], "key_a binary, key_b binary")
    for most in (1 << 20, 50):
        monkeypatch.setattr(near, "TASK_LINKS", most)
        found = near.components(df, o9.Written(spark, "test"), f"c{most}").collect()
        known = {int.from_bytes(x["key"], "big"): int.from_bytes(x["label"], "big") for x in found}
        assert all(known.get(k, k) == v for k, v in root.items()) and len(known) == len(found)


def test_count_tree_excludes_no_link_and_passes_over_its_own_component():
    r = np.random.default_rng(11)
    base = [np.unique(r.integers(0, 2**63, n).astype("u8")) for n in r.integers(3, 300, 40)]
    sets = [np.unique(np.concatenate([b[: max(1, int(len(b) * f))], r.integers(0, 2**63, int(len(b) * g)).astype("u8")])) for b in base for f, g in ((1, 0), (0.9, 0.05), (0.8, 0), (0.7, 0.4), (1, 0.3))]
    tree = o9.CountTree(np.array([o9.counts_of(s) for s in sets], "i4"), np.array([len(s) for s in sets]))
    assert tree.parts and tree.parts[0].parts and tree.parts[0].parts[0].parts
    own = np.arange(len(sets))
    for a, s in enumerate(sets):
        found = {int(x) for rows, _ in tree.partners(o9.counts_of(s), len(s), -1, own) for x in rows}
        assert {b for b, t in enumerate(sets) if linked(s, t)} <= found
        assert len(found) < len(sets)
        assert not list(tree.partners(o9.counts_of(s), len(s), 0, np.zeros(len(sets), "i8")))


def test_the_tree_proposes_every_link_of_the_join(spark, tmp_path):
    """All links that make the components of a small directory come out of the tree's blocks."""
    texts = [prose(k // 4, 60) + f" own{k} word{k}" for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    described = o9.describe(df)
    lists = o9.common_lists(described)
    members = near.families(lists.select("list", F.explode("nodes").alias("node")).distinct())
    sets = near.candidate_sets(df, described.drop("marks"), members, o9.WIDTH)
    links = near.all_links(members, sets, o9.tree_index, o9.PERCENT, o9.Written(spark, "test")).collect()
    assert len(links) == 30  # ten groups of four, each joined by three links


# 10


@pytest.fixture(scope="module")
def toxic(spark):
    r, rows, labels = random.Random(12), [], []
    for k in range(900):
        w = prose(1000 + k, 60).split()
        bad = k % 4 == 0
        if bad:
            for x in r.sample(["idiot", "moron", "pathetic"], 2):
                w[r.randrange(60)] = x
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad) if k % 50 else None))
    docs = spark.createDataFrame(rows + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame(labels + [(1, 0), (9999, 1)], "doc_id long, toxic int")
    return docs, labels, o10.fit(docs, labels)


def test_toxicity_on_held_out_rows(toxic):
    docs, labels, learned = toxic
    rows = o10.score(docs.withColumn("score", F.lit("clash")), learned).join(labels, "doc_id").where((o10.fold() == o10.HELD_OUT) & F.col("toxic").isNotNull()).collect()
    assert len(rows) > 100 and all(r["predicted"] == r["toxic"] for r in rows)
    found = {r["doc_id"]: r["score"] for r in o10.score(docs.where("doc_id >= 5000"), learned).collect()}
    assert found == {5000: o10.FLOOR, 5001: o10.FLOOR}


def test_deobfuscation(spark, toxic):
    restorer = o10.Restorer(toxic[2].model)
    assert [restorer.word(w) for w in ("1d10t", "idiooot", "m-o-r-o-n", "p@thetic", "Moron!!!", "kansto")] == ["idiot", "idiot", "moron", "pathetic", "moron", "kansto"]
    assert "idiot" in restorer.spaced("so i d i o t it") and restorer.word("x" * 5000) is not None
    df = spark.createDataFrame([(1, f"{prose(1, 20)} m0r0n {prose(2, 20)}"), (2, f"{prose(1, 20)} m o r o n {prose(2, 20)}"), (3, prose(3, 40))], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in o10.score(df, toxic[2]).collect()} == {1: 1, 2: 1, 3: 0}


OBFUSCATED = ["!diot", "idio+", "|diot", "(!diot)", "!diot!", "iidiott", "mmoronn", "1d107", "m0r0n!", "+p@thetic", "i\td\ti\to\tt", "i\nd\ni\no\nt", "i  d  i  o  t", "i. d. i. o. t.", "i - d - i - o - t", "i d i o t!", "id iot", "id\tiot", "mo ron", "m 0 r 0 n"]


def test_every_obfuscation_reaches_the_lattice(spark, toxic):
    texts = [f"{prose(1, 20)} {x} {prose(2, 20)}" for x in OBFUSCATED] + [prose(k, 60) + " 12 345! (5417) +1 kaann" for k in range(40)]
    rows = o10.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), toxic[2]).collect()
    assert [OBFUSCATED[r["doc_id"]] for r in rows if r["doc_id"] < len(OBFUSCATED) and not r["predicted"]] == []
    assert [r["doc_id"] for r in rows if r["doc_id"] >= len(OBFUSCATED) and r["predicted"]] == []
    assert o10.Restorer(toxic[2].model).words("5417")


def test_no_labels_and_no_rows(spark, toxic):
    docs, labels, _ = toxic
    learned = o10.fit(docs.limit(5), labels.where("false"))
    assert learned.bounds == {} and o10.score(docs.where("false"), learned).count() == 0
    assert o10.fit(docs.where("false"), labels).bounds == {}


def test_a_lattice_that_reaches_no_feature_is_the_only_one_left_out():
    rng = random.Random(10)
    said = ["idiot", "clown", "rash", "letter", "book", "the"]
    total = sum(np.bincount(o10.trigrams(w), minlength=o10.SYMBOLS**3) for w in said)
    model = o10.language_model(total.astype("f8"))
    wanted = frozenset(f for w in ("idiot", "clown", "the") for f in o10.features(w))
    every, some = o10.Restorer(model), o10.Restorer(model, wanted)
    looks = {v[0]: k for k, v in o10.LOOKS.items()}

    def hidden(word: str) -> str:
        return "".join(rng.choice([c, c * 2, looks.get(c, c), c + rng.choice(".-_*")]) for c in word)

    has = lambda words: sorted({w for w in words if wanted & set(o10.features(w))})
    for _ in range(600):
        token = rng.choice("!(1. x").strip() + hidden(rng.choice(said)) + rng.choice(["", "!", "ee", "9"])
        assert has(every.words(token)) == has(some.words(token)), token
        row = " ".join(hidden(c)[:2] for c in rng.choice(said) + rng.choice(said))
        assert has(every.spaced(row)) == has(some.spaced(row)), row
    assert some.decode("1d!0t") == every.decode("1d!0t") == "idiot"
    assert o10.Restorer(model, frozenset()).decode("1d!0t") == ""


# 11


def lloyd(rows):
    """Codes and errors by brute force in Python integers."""
    kept = [(v, [int(np.floor(float(x) * 4096)) for x in e], lab) for v, e, lab in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    width = len(kept[0][1]) // 8
    cut = lambda e, p: e[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda x: (x[0] is None, x[0] or 0, x[1]))[:16]
    books = [[cut(e, p) for _, e, _ in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda e, p: min(range(len(books[p])), key=lambda j: (far(cut(e, p), books[p][j]), j))
    for _ in range(6):
        parts = [[[] for _ in first] for _ in range(8)]
        for _, e, _ in kept:
            for p in range(8):
                parts[p][nearest(e, p)].append(cut(e, p))
        books = [[[sum(c) // len(own) for c in zip(*own, strict=True)] if own else old for own, old in zip(parts[p], books[p], strict=True)] for p in range(8)]
    codes = [[nearest(e, p) for p in range(8)] for _, e, _ in kept]
    errors = [sum(far(cut(e, p), books[p][c[p]]) for p in range(8)) for (_, e, _), c in zip(kept, codes, strict=True)]
    total = defaultdict(int)
    for (_, _, lab), x in zip(kept, errors, strict=True):
        total[lab] += x
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(repr((v, bytes(c).hex(), x, total[lab], sha)) for (v, _, lab), c, x in zip(kept, codes, errors, strict=True))


@pytest.mark.parametrize("spread", [0.2, 30.0, 2000.0])
def test_vector_codes_equal_brute_force(spark, spread):
    r = np.random.default_rng(5)
    rows = [(k, (r.normal(0, 1, 24) * spread).round(2).tolist(), None if k % 5 == 0 else k % 3) for k in range(300)]
    rows += [rows[7], rows[7], (None, rows[9][1], 1), (400, None, 1), (401, [None, *rows[3][1][1:]], 1), (402, [float("nan"), *rows[3][1][1:]], 1), (403, [float("-inf"), *rows[3][1][1:]], 1)]
    rows += [(500 + k, [0.5 * (k % 2)] * 24, 2) for k in range(40)]  # ties
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    assert sorted(repr(tuple(x)) for x in o11.compress(df).collect()) == lloyd(rows)


def test_vector_codes_of_few_odd_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label string"
    few = [(3, [1.0] * 8, "a"), (1, [2.0] * 8, None), (2, [1.5] * 8, "a"), (4, [1.0] * 7, "a"), (5, [1.0] * 16, "a"), (6, [], None)]
    found = {x["vec_id"]: x for x in o11.compress(spark.createDataFrame(few, schema)).collect()}
    assert set(found) == {1, 2, 3} and found[1]["code"] == "00" * 8 and found[3]["code"] == "02" * 8 and found[3]["label_error"] == 0
    assert o11.compress(spark.createDataFrame([], schema)).count() == 0
    assert o11.compress(spark.createDataFrame([(1, None, "a")], schema)).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        o11.compress(spark.createDataFrame([(1, [1e30] * 8, "a")], schema))


def test_bounds_prune_and_never_decide():
    """Entries that the bounds leave out are strictly further away, after any movement."""
    r = np.random.default_rng(8)
    x, entries = r.integers(-900, 900, (400, 6)), r.integers(-900, 900, (16, 6))
    code, upper, lower = np.zeros(400, "u1"), np.full(400, np.inf), np.zeros((400, 16))
    compared = []
    for _ in range(5):
        before = entries
        code = o11.reassign(x, entries, code, upper, lower)
        gaps = ((x[:, None] - entries) ** 2).sum(2)
        assert (code == gaps.argmin(1)).all() and (upper**2 >= gaps.min(1)).all() and (lower**2 <= gaps).all()
        compared.append(int((lower**2 > 0.999999 * gaps).sum()))
        entries = entries + r.integers(-9, 9, entries.shape)
        moved = np.sqrt(((entries - before) ** 2).sum(1)) * (1 + 1e-12)
        upper += moved[code]
        np.maximum(lower - moved, 0, out=lower)
    assert compared[-1] < compared[0] / 3


# 12


def brute_collocations(rows, least, top):
    f, n = defaultdict(int), defaultdict(int)
    upper = str.maketrans(o12.UPPER, o12.LOWER)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(upper)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    out = []
    for lang in n:
        found = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= least}
        some = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, _, x, y = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            some.append((-score, -a, " ".join(p).encode(), x, y))
        out += [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(some)[:top], 1)]
    return sorted(map(repr, out))


def test_collocations_equal_brute_force(spark, monkeypatch):
    r = random.Random(4)
    small = ["da", "de", "Di", "é", "x\u00a0y", "z|"]
    texts = [" ".join(r.choice(small) + r.choice(["", "", "", ",", "\t", "\n", ". "]) for _ in range(r.randrange(60))) for _ in range(60)]
    rows = [(t, r.choice(["en", "de", None, "und", "a b"])) for t in texts] + [(texts[0], "en")] * 30 + [(None, "en"), ("", None), (" .. ", "fr"), ("word " * 30000, "en"), ("a\nb", "fr"), (prose(9, 4000), "de")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "text string, lang string, rank int").repartition(5)
    for slice_words in (o12.SLICE_WORDS, 50):
        monkeypatch.setattr(o12, "SLICE_WORDS", slice_words)
        assert sorted(repr(tuple(x)) for x in o12.collocations(df).collect()) == brute_collocations(rows, o12.LEAST, o12.TOP)
    assert o12.collocations(df.where("false")).count() == 0


def test_the_bit_map_lets_through_what_is_frequent(spark):
    rows = [("en", f"w{k} v{k % 7}") for k in range(500)]
    known = o12.bit_map(spark.createDataFrame(rows, "lang string, phrase string"), 2)
    import pyarrow as pa

    one = pa.RecordBatch.from_pydict({"lang": ["en", "en", "de"], "piece": ["w8 v1 w9 v2", "w1 v1 v1 w2", "w8 v1 v2"], "rows": [3, 1, 1], "words": [4, 4, 3]})
    assert int(np.unpackbits(known).sum()) == 500 and o12.grams(one, 3, known) is None
    two = pa.RecordBatch.from_pydict({"lang": ["en"], "piece": ["w8 v1"], "rows": [3], "words": [2]})
    assert o12.grams(two, 2, None).to_pylist() == [{"lang": "en", "phrase": "w8 v1", "weight": 3}]


# 13


def test_near_dedup_equals_brute_force(spark, docs):
    r = random.Random(14)
    rows, k = [], 100
    for t in [prose(700 + k, n) for k, n in enumerate([1, 2, 3, 4, 5, 7, 12, 40, 90, 200, 600])]:
        for _ in range(9):
            w = t.split()
            for _ in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((k, " ".join(w)))
            k += 1
    path = o9.Written(spark, "test").put(docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")), "docs")
    every = [(x["doc_id"], x["text"]) for x in path.collect()]
    want = sorted(repr((*ast_row, ast_row[0] == ast_row[2])) for ast_row in map(eval, brute_components(every, 2, 80)))
    assert sorted(repr(tuple(x)) for x in o13.dedup(path).collect()) == want
    assert o13.dedup(path.where("false")).count() == 0


def test_signatures_under_the_threshold_share_a_key():
    r = np.random.default_rng(3)
    one = r.integers(0, 2**16, (400, o13.SLOTS)).astype("u2")
    other = one.copy()
    for k, row in enumerate(other):
        at = r.choice(o13.SLOTS, o13.ERRORS - k % 3, replace=False)
        row[at] ^= np.uint16(1 + k)
    assert all(set(a) & set(b) for a, b in zip(o13.keys_of(one), o13.keys_of(other), strict=True))
    assert len(o13.keys_of(one)[0]) == 75 and len(np.unique(o13.keys_of(one))) == 400 * 75
    sets = [np.unique(np.concatenate([s[:80], r.integers(0, 2**63, n).astype("u8")])) for s in [r.integers(0, 2**63, 90).astype("u8") for _ in range(300)] for n in (10, 10)]
    signed = np.array([o13.signature(s) for s in sets])
    apart = (signed[::2] != signed[1::2]).sum(1)  # of sets with Jaccard 0.8
    assert (apart <= o13.ERRORS).mean() > 0.99 and 5 < apart.mean() < 7


def test_ordinary_words_marks_of_any_length_and_exact_rejections(spark):
    """``lose`` is not ``loser``; marks around spelled letters may be many; what the two-letter and run tests pass over scores nothing."""
    r, rows, labels = random.Random(15), [], []
    for k in range(600):
        w = prose(4000 + k, 50).split()
        w[r.randrange(50)] = "loser" if k % 4 == 0 else r.choice(["lose", "losesan", "loset", "losekan", "loselo"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = o10.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert learned.of("loser") > 0.5 and learned.of("losers") > 0.5 and learned.of("lose") == learned.of("losexy") == 0
    quick, slow = o10.Restorer(learned.model, frozenset(learned.bounds)), o10.Restorer(learned.model)
    assert any(learned.of(w) for w in quick.spaced("l.. o........ s.. e. r......... kan"))
    texts = ["l o s e r", "loooser L0ser lo.ser,", "a la de lo se ro lo", "kan lolos erer l0 se", "loo oser l oo sser"]
    best = lambda words: max(map(learned.of, words), default=0)
    for text in [*texts, *(t for _, t in rows[:60])]:
        assert best(quick.spaced(text)) == best(slow.spaced(text))
        for token in text.split():
            assert (0 if quick.plain(token) else best(quick.words(token))) == best(slow.words(token))


@pytest.mark.parametrize("at", [2, 17, 20, 39, 40])
def test_a_stated_look_back_is_not_trusted(at):
    """A template that puts a summary in front from some turn on, the last one too, is refused; ``locate`` finds the rewrite."""
    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(40)]
    summing = lambda t: ("sum " if len(t) >= at else "") + o3.render(t)
    with pytest.raises(ValueError, match="look|rewrites"):
        list(o3.pieces(o3.Template(summing, 1), turns))
    assert o3.locate(summing, turns).rewrites == 1
    assert "".join(x[0] for x in o3.pieces(o3.Template(summing), turns)) == summing(turns)
    assert len(list(o3.pieces(o3.INSTRUCT, turns))) == 40


@pytest.mark.parametrize("at", [3, 5, 6, 7, 30])
def test_every_prefix_is_looked_at(at):
    """A template that differs at one length alone, which is no power of two and not the last, is refused."""
    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(40)]
    once = lambda t: ("sum " if len(t) == at else "") + o3.render(t)
    with pytest.raises(ValueError, match="look|rewrites"):
        list(o3.pieces(o3.Template(once, 1), turns))


def test_a_template_made_turn_by_turn():
    said = o3.Turnwise(lambda before, turn: f"{before[-1][0] if before else 'start'}>{turn[0]}: {turn[1]};", 1)
    turns = [("user", "a"), ("assistant", "b;"), ("user", "")]
    found = list(o3.pieces(said, turns))
    assert "".join(x[0] for x in found) == "start>user: a;user>assistant: b;;assistant>user: ;" and [t[a:b] for t, a, b in found] == [t for _, t in turns]
    with pytest.raises(ValueError, match="template"):
        list(o3.pieces(o3.Turnwise(lambda _, turn: turn[1] * 2), turns))


def test_the_registered_template_is_rendered_by_every_prefix():
    turns = [("assistant" if k % 2 else "user", f"t{k} </s>") for k in range(9)]
    lengths = []
    seen = o3.INSTRUCT._replace(render=lambda t: lengths.append(len(t)) or o3.render(t))
    assert o3.digest(1, turns, seen) == o3.digest(1, turns) and set(lengths) == set(range(1, 10))
    assert [t[0] for t in o3.pieces(o3.INSTRUCT, turns)] == [o3.render([turn]) for turn in turns]
    every = [("user", "".join(map(chr, range(0xE000, 0xF900)))), ("assistant", "x")]
    assert [t[a:b] for t, a, b in o3.pieces(o3.INSTRUCT, every)] == [text for _, text in every]


def test_rewrites_are_counted_and_read_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(6)] + [(2, k, "assistant", "<s>") for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    summing = o3.Template(lambda t: "sum " * max(0, len(t) - 3) + o3.render(t))
    role = lambda head: o3.unescape(head.rpartition("[INST] ")[2][: -len(" [/INST] ")])
    assert o3.digest(1, [r[2:] for r in rows[:6]], summing, role)[-1] == 3
    found = {r["conv_id"]: r for r in o3.digest_conversations(df, summing, role).collect()}
    plain = {r["conv_id"]: r for r in o3.digest_conversations(df).collect()}
    assert [found[c]["rewrites"] for c in (1, 2)] == [3, 0] and [plain[c]["rewrites"] for c in (1, 2)] == [0, 0]
    for same in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256"):
        assert [found[c][same] for c in (1, 2)] == [plain[c][same] for c in (1, 2)]
    assert found[1]["formatted_chars"] == plain[1]["formatted_chars"] + 3 * len("sum ")
    with pytest.raises(ValueError, match="history"):
        o3.digest(1, [("user", "a"), ("assistant", "b")], o3.Template(lambda t: "".join(text for _, text in reversed(t))))


def test_pieces_are_cut_in_arrow(spark):
    rows = [("One\t two  , THREE\x0b\u00a0four \u00c9\tx", None), (None, "de"), (" \t.;", "de"), ("a\tb. a  b! A b", "de"), ("", "und"), ("one two", "und")]
    found = o12.pieces(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(map(tuple, found.collect())) == [("de", "a b", 3, 2), ("und", "one two", 2, 2), ("und", "three", 1, 1), ("und", "\u00a0four \u00c9 x", 1, 3)]
    assert "regexp_replace" not in found._jdf.queryExecution().toString()


def test_jaccard_join_never_writes_the_marks_of_all_texts(spark, monkeypatch):
    """Marks are shuffled from the texts; what is written has those that several nodes share, and a row a document."""
    made, put = [], o9.Written.put
    monkeypatch.setattr(o9.Written, "put", lambda self, df, name: made.append((name, put(self, df, name))) or made[-1][1])
    monkeypatch.setattr(o9.Written, "drop", lambda self, *names: None)
    word = lambda d: " ".join(f"w{d}x{k}" for k in range(60))
    docs = spark.createDataFrame([(1, word(1)), (2, word(1) + " more"), (3, word(3)), (None, word(3)), (5, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in o9.join_copies(docs).collect()}
    assert found == {1: (56, 1), 2: (57, 1), 3: (56, 3), None: (56, 3), 5: (0, 5)}
    tables = dict(made)
    assert all("marks" not in t.columns for t in tables.values())
    met = tables["met"]
    assert met.where("kind = 2").count() == 5
    assert met.where("kind = 0").selectExpr("sum(octet_length(a)) / 8").first()[0] <= 2 * 56
