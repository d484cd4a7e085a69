"""The registered queries and the pipeline over a small directory of tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from eventfold.llm import op2_quality_rules as o2
from eventfold.llm import op8_best_fit_packing as o8
from eventfold.llm.queries import QUERIES

public = pytest.importorskip("public_tokenizers")
WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sa") for b in ("n", "r", "sto", "ve", "x", "")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    texts = [None, "", " \n", "one two", "x" * 20000, "word " * 3000, prose(1, 9000)] + [prose(k, 60 + k) for k in range(10, 60)]
    texts += [texts[-1]] * 4 + [" ".join([*texts[-2].split()[:-3], "other", "end"])]
    texts += [prose(100 + k, 40) + f" mail k{k}@b.com from 10.0.0.{k} card 4111111111111111 call +1 (202) 555-01{k:02d}" for k in range(20)]
    texts += [prose(200 + k, 40) + " you are a wretched scumlord " + prose(300 + k, 20) for k in range(24)]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, prose(7, 50), None, None, None), (3, prose(8, 50), "de", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    labels = [(k, 1, int("scumlord" in (t or ""))) for k, t in enumerate(texts)] + [(9999, 0, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, [(r[0], r[1]) for r in rows]


def result(spark, tables, name):
    return [r.asDict() for r in QUERIES[name](spark, tables[0]).collect()]


def same_texts(rows, tables, key, make):
    """Whether the multiset of (doc_id, values of key) is what ``make`` gives for every document."""
    want = Counter((d, *make(t or "")) for d, t in tables[1])
    assert Counter((r["doc_id"], *(r[k] for k in key)) for r in rows) == want


def test_op1(spark, tables):
    rows = result(spark, tables, "op1_sharding")
    same_texts(rows, tables, ("size", "text_crc32"), lambda t: (len(t.encode()) + 8, zlib.crc32(t.encode())))
    shards, texts, size = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        shards[r["shard"]].append(r["slot"])
        if r["size"] > 8:  # null and empty texts look alike here
            texts[r["text_crc32"], r["size"]].add(r["shard"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and all(len(s) == 1 for s in texts.values()) and set(shards) <= set(range(24))
    groups = Counter()
    for r in rows:
        groups[r["text_crc32"], r["size"]] += r["size"]
    largest, mean = max(groups.values()), sum(groups.values()) / 24
    assert max(size.values()) <= max(largest, mean + sorted(groups.values())[-24]) and {r["law"] for r in rows} == {"bytes"}


def test_op2(spark, tables):
    packer = zstandard.ZstdCompressor(level=o2.LEVEL)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rows = result(spark, tables, "op2_quality_rules")

    def brute(t):
        words = [w for w in re.split("[ \t-\r]+", t) if w]
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        again = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed, not failed and o2.within_bands(len(t.encode()), *o2.ratios(t.encode(), packer))

    same_texts(rows, tables, names, brute)


def test_op4(spark, tables):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def brute(t):
        ids = library.encode(t)
        return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))

    same_texts(result(spark, tables, "op4_sentencepiece"), tables, ("n_tokens", "ids_sha256", "decoded_sha256"), brute)


def test_op5(spark, tables):
    rows = result(spark, tables, "op5_pii")
    mails = [r for r in rows if r["n_email"]]
    assert len(mails) == 20 and all((r["n_ip"], r["n_card"], r["n_phone"], r["n_spans"]) == (1, 1, 1, 4) for r in mails)
    for r in rows:
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in ("email", "ip", "card", "phone"))
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]


def test_op6(spark, tables):
    rows = result(spark, tables, "op6_media_columns")

    def brute(t):
        raw = t.encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])

    same_texts(rows, tables, ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"), brute)
    assert all(r["feature"].startswith("type=wav;") for r in rows)


def test_op8(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = result(spark, tables, "op8_best_fit_packing")
    want = Counter()
    for d, t in tables[1]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % o8.CAPACITY or o8.CAPACITY
        cuts = [0, *range(min(first, len(ids)), len(ids) + 1, o8.CAPACITY)]
        want.update((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= o8.CAPACITY
    assert len(sequences) <= 1.1 * sum(r["length"] for r in rows) / o8.CAPACITY + 1


def test_op10(spark, tables):
    rows = result(spark, tables, "op10_toxicity")
    assert len(rows) == len(tables[1])
    toxic = {d for d, t in tables[1] if "scumlord" in (t or "")}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["doc_id"] in toxic) == bool(r["predicted"])


def test_pipeline_is_its_stages(spark, tables):
    """Rejections, copies, spans and pieces of the pipeline are those of brute-force stages over what was kept."""
    packer = zstandard.ZstdCompressor(level=o2.LEVEL)
    docs = [(d, t) for d, t in tables[1] if "scumlord" not in (t or "")]
    docs = [(d, t) for d, t in docs if o2.judge(t, packer)[-1]]
    shingle = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    sets, group = [shingle(t) for _, t in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    first = {g: min((d is None, d or 0, hashlib.sha256(t.encode()).hexdigest(), k) for k, ((d, t), x) in enumerate(zip(docs, group, strict=True)) if x == g)[-1] for g in set(group)}
    kept = [docs[k] for k in first.values()]
    hide = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>"), (r"10\.0\.0\.[0-9]+", "<ip>"), (r"4111111111111111", "<card>"), (r"\+1 \(202\) 555-01[0-9]+", "<phone>")]
    want = Counter()
    encode = o8.tokeniser(public.path("byte_bpe_50k.json"))
    for d, t in kept:
        for pattern, kind in hide:
            t = re.sub(pattern, kind, t)
        want.update((d, number, start, len(ids) // 4, zlib.crc32(ids)) for number, start, ids in o8.cut(encode(t) + b"\0\0\0\0"))
    rows = [r.asDict() for r in corpus_pipeline.run(spark, tables[0]).collect()]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want


def test_pipeline_of_nothing(spark, tables, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
