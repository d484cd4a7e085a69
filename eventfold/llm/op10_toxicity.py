"""Toxicity with noisy-channel deobfuscation.

Language model: character trigrams, counted over all documents; every task adds up its own counts, the
sums are at most ``len(ALPHABET) ** 3`` rows whatever the input. Deobfuscation: a suspicious token (digits
or symbols among letters or at the ends, only look-alikes, a letter twice in a row) is a lattice in which a
character may stand for itself or a look-alike, and a repetition or a separator may be nothing; Viterbi
decoding finds the best path under the language model. Up to ``EDGE_SIGNS`` look-alikes at each end are read
as letters and as marks. Neighbouring pieces of at most ``PIECE`` characters, with any marks around them and any white
space and separators between them, are one lattice in which each letter may start a word. Scoring takes the worst of
a token's raw and restored words; a lattice none of whose paths begins a word as a kept feature does has nothing
to add to a score, and its best path is not looked for then.

Score: words and their first four and five letters are features. Of each, the different texts and the
different preceding words in toxic and in clean labelled documents are counted; the smaller count speaks
for toxicity, the larger against, so that near copies of a document count once (their preceding words are
the same), and so does a long document that repeats a word (its text is the same). A feature is
kept if its share of toxic contexts is above chance by a binomial test corrected for the number of features
and its Wilson lower bound is over a half; a beginning, moreover, if no more words of clean documents begin so than of toxic ones,
as many do with ``lose`` and none with ``loser``. It does not speak for words that by their own counts are rather clean.
A document's score is the noisy-or of its words' bounds, or
``FLOOR`` where it has none. Labels of rows whose crc32(doc_id) mod 4 is 2 are held out. The fit takes
about ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows at most, chosen by a hash of doc_id.

Cases: null and empty texts score ``FLOOR``; null labels are ignored, repeated labels count as their
maximum; a label without a document is ignored; with no labels, all score ``FLOOR``. A very long token is
decoded in linear time. An empty table gives no rows; columns named like the results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.common import Memo, add_columns, map_stream, table

TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
LEAST_SUPPORT = 4
#: Clean contexts or texts that make a word an ordinary one.
LEAST_ORDINARY = 2
SIGNIFICANCE = 0.01
FLOOR = 0.02
THRESHOLD = 0.3
HELD_OUT, FOLDS = 2, 4
EDGE_SIGNS, PIECE = 3, 3
#: Characters of a token that can be a piece whatever its ends are.
TOKEN = 5
REMEMBERED = 150_000

# Symbols of the language model (a blank, letters, and one for all others) and look-alikes.
ALPHABET = " abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
OTHER = len(ALPHABET)
SYMBOLS = OTHER + 1
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = set(".-_*~'·,/\\^`\"")
COST = {"look": 1.0, "repeat": 0.7, "separator": 0.5, "start": 1.5}

_CODE = np.full(1 << 16, OTHER, "u1")
for _k, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _k
_CODE[[9, 10, 11, 12, 13]] = 0
_PAIRS = SYMBOLS * SYMBOLS
_INDEX = {c: k for k, c in enumerate(ALPHABET)}
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$|([^\w])\1{2,}$")
_PLAIN = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_WORD = re.compile(r"\w")
_RUN = re.compile(r"(.)\1*")
_LETTERS = re.compile(f"[{ALPHABET[1:]}]+")
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LOOKS) + "·«»„“”‘’…"
_SIGNS = "!|+(¡"
#: A token that ends any row of pieces.
_END = "aaaaaaaa"
_BARE_MARKS = ".,;:?\"'-)[]{}<>/\\·«»„“”‘’…"


def trigrams(text: str) -> np.ndarray:
    """Codes of a text's trigrams, blanks in a row being one."""
    codes = _CODE[np.frombuffer(f" {text.lower()} ".encode("utf-16-le", "replace"), "<u2")].astype("i4")
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    return (codes[:-2] * SYMBOLS + codes[1:-1]) * SYMBOLS + codes[2:]


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of all trigrams of all texts."""

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros(SYMBOLS**3, "i8")
        some, size = [], 0
        for (text,) in rows:
            some.append(text or "")
            size += len(some[-1])
            if size > 1 << 20:
                total += np.bincount(trigrams(" ".join(some)), minlength=SYMBOLS**3)
                some, size = [], 0
        total += np.bincount(trigrams(" ".join(some)), minlength=SYMBOLS**3)
        for k in np.flatnonzero(total):
            yield int(k), int(total[k])

    counts = map_stream(docs.select("text"), "code int, n long", count, rows=50_000).groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS**3, "f8")
    for r in counts.toLocalIterator():
        out[r["code"]] = r["n"]
    return out


def language_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Log probabilities of a symbol after two others, smoothed by shorter contexts."""
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
    p2 = (n2 + weight * p1) / (n2.sum(1, keepdims=True) + weight)
    return np.log((n3 + weight * p2[None]) / (n3.sum(2, keepdims=True) + weight))


class Restorer:
    """Viterbi decoding of suspicious tokens.

    ``wanted``: features, if words without any of them are of no use; lattices that cannot spell the first three letters
    of one are then restored to nothing.
    """

    def __init__(self, model: np.ndarray, wanted: frozenset[str] | None = None):
        self.model = model.ravel().tolist()
        self.starts = None if wanted is None else {f[:n] for f in wanted for n in (1, 2, 3)}
        self.begins = None if wanted is None else self._begins(self.starts)
        self.others = set() if wanted is None else {a + b for a in ALPHABET[1:] for b in ALPHABET[1:] if a != b and a + b not in self.starts}
        self.letters: dict[tuple[str, bool], tuple[str, bool]] = {}
        self.choices: dict[tuple[str, bool, bool], list] = {}
        self.decoded = Memo(lambda text: self.best_path(text, False), REMEMBERED)
        self.decoded_spaced = Memo(lambda text: self.best_path(text, True), REMEMBERED)
        self.short = Memo(self.piece, REMEMBERED)
        self.groups = Memo(self.restored, REMEMBERED)

    def options(self, c: str, again: bool, spaced: bool) -> list[tuple[list[int], float]]:
        """What a character may have been, with its cost: some letters, or nothing. ``again``: it repeats the one before."""
        out = [([_INDEX[c]], 0.0)] if c in _INDEX else [([_INDEX[x]], COST["look"]) for x in LOOKS.get(c, "")]
        starts = [([0, *x], cost + COST["start"]) for x, cost in out] if spaced else []
        if again:
            out.append(([], COST["repeat"]))
        if c in SEPARATORS or not out:
            out.append(([], COST["separator"]))
        return out + starts

    @staticmethod
    def _begins(starts: set[str]) -> re.Pattern:
        """Of letters of which repeated ones may be one: that they spell a start of three letters somewhere."""
        runs = lambda start: "".join(f"{re.escape(m[0][0])}{{{len(m[0])},}}" for m in _RUN.finditer(start))
        return re.compile("|".join(sorted(runs(x) for x in starts if len(x) == 3)) or "(?!)")

    def plain(self, token: str) -> bool:
        """Whether a token is a word in letters that begins as no wanted feature can, by its first two letters."""
        bare = token.strip(_BARE_MARKS)
        return bare[:2].lower() in self.others and bare.isalpha()

    def spells(self, text: str, spaced: bool) -> bool:
        """Whether some path has a word, at the start or, if ``spaced``, anywhere, that begins as a wanted feature does."""
        begun, last = {""}, ""
        for c in text:
            key = c, c == last
            if key not in self.letters:
                options = self.options(*key, False)
                self.letters[key] = "".join(ALPHABET[x] for letters, _ in options for x in letters), any(not letters for letters, _ in options)
            letters, nothing = self.letters[key]
            after = {p + x for p in begun for x in letters} & self.starts
            if any(len(p) == 3 for p in after):
                return True
            if nothing:
                after |= begun
            if spaced:
                after.add("")
            elif not after:
                return False
            begun, last = after, c
        return False

    def decode(self, text: str, spaced: bool = False) -> str:
        if len(text) >= 64:  # not worth a place in memory
            return self.best_path(text, spaced)
        return (self.decoded_spaced if spaced else self.decoded)[text]

    def best_path(self, text: str, spaced: bool) -> str:
        """The best path; a state is the last two symbols as one number, steps link back to the ones before."""
        if self.starts is not None and not self.spells(text, spaced):
            return ""
        model, last = self.model, ""
        states: dict[int, tuple[float, tuple | None]] = {OTHER * SYMBOLS: (0.0, None)}
        for k, c in enumerate(text):
            key = c, c == last, spaced and k > 0
            options = self.choices.get(key)
            if options is None:
                options = self.choices[key] = self.options(*key)
            after: dict[int, tuple[float, tuple | None]] = {}
            for letters, cost in options:
                for ab, (score, path) in states.items():
                    score -= cost
                    for x in letters:
                        at = ab * SYMBOLS + x
                        score += model[at]
                        ab, path = at % _PAIRS, (x, path)
                    old = after.get(ab)
                    if old is None or score > old[0]:
                        after[ab] = score, path
            states, last = after, c
        path = max((score + model[ab * SYMBOLS], -i, path) for i, (ab, (score, path)) in enumerate(states.items()))[2]
        out = []
        while path:
            out.append(ALPHABET[path[0]])
            path = path[1]
        return "".join(reversed(out))

    def word(self, token: str) -> str:
        """A token in small letters without marks at its ends, decoded if it is suspicious."""
        bare = _EDGE.sub("", _EDGE.sub("", token.lower()))
        if _PLAIN.fullmatch(bare):
            return self.decode(bare) if _TRIPLE.search(bare) else bare
        return self.decode(bare) if any(c.isalpha() for c in bare) else ""

    def words(self, token: str) -> tuple[str, ...]:
        """What a token may mean: ``word``, and its restored forms with look-alikes at its ends as letters and as marks."""
        low = token.lower()
        bare = low.strip(_BARE_MARKS)  # marks that can stand for no letter
        if _PLAIN.fullmatch(bare):
            if not _DOUBLE.search(bare):
                return (bare,)
            own = self.decode(bare)
            return (bare,) if own == bare else (own, bare) if _TRIPLE.search(bare) else (bare, own)
        found = {self.word(token): None}
        first = _WORD.search(low)
        if first:
            start, stop = first.start(), len(low) - _WORD.search(low[::-1]).start()
            heads = ["", *(low[k:start] for k in range(start - 1, max(start - EDGE_SIGNS, 0) - 1, -1) if low[k] in LOOKS)]
            tails = ["", *(low[stop:k] for k in range(stop + 1, min(stop + EDGE_SIGNS, len(low)) + 1) if low[k - 1] in LOOKS)]
            for text in (head + low[start:stop] + tail for head in heads for tail in tails):
                if _PLAIN.fullmatch(text):
                    found[text] = None
                if not _PLAIN.fullmatch(text) or _DOUBLE.search(text):
                    found[self.decode(text)] = None
        elif any(c in LOOKS for c in low):
            found[self.decode(low)] = None
        return tuple(w for w in found if w)

    @staticmethod
    def piece(token: str) -> str | None:
        """A short piece without marks; empty for marks alone, None for anything else."""
        piece = token.strip(_MARKS)
        piece = piece.strip(_SIGNS) or piece
        return piece if len(piece) <= PIECE and all(c.isalpha() or c in LOOKS for c in piece) else None

    def restored(self, group: str) -> tuple[str, ...]:
        """Words restored from neighbouring pieces, blanks between them, that are not pieces themselves."""
        pieces = group.split(" ")
        if self.begins is not None and _LETTERS.fullmatch(joined := "".join(pieces)) and not self.begins.search(joined):
            return ()
        lattices = {"".join(pieces)} if any(c.isalpha() for c in group) else set()
        singles = "".join(p if len(p) == 1 else " " for p in pieces).split(" ")
        found: dict[str, None] = {}
        for lattice in lattices | {x for x in singles if len(x) > 2}:
            if len(lattice) > 2:
                found |= dict.fromkeys(self.decode(lattice, spaced=True).split())
        return tuple(w for w in found if len(w) > 2 and w not in pieces)

    def spaced(self, text: str) -> list[str]:
        """Words restored from short pieces in a row; marks alone do not end a row, any other token does."""
        out: list[str] = []
        row: list[str] = []
        short = self.short
        for token in [*text.lower().split(), _END]:
            # a longer one can only be a piece with marks or signs at an end
            piece = None if len(token) > TOKEN and token[0].isalnum() and token[-1].isalnum() else short[token] if len(token) < 64 else self.piece(token)
            if piece:
                row.append(piece)
            elif piece is None:
                if len(row) > 1:
                    group = " ".join(row)
                    out += self.groups[group] if len(group) < 64 else self.restored(group)
                row = []
        return out


_LATEST: dict[bytes, Restorer] = {}


def restorer_of(model: np.ndarray, wanted: frozenset[str] | None = None) -> Restorer:
    """The worker's restorer of a model; the latest one stays, with what it remembers, for the next task."""
    key = xxhash.xxh3_128_digest(model.tobytes() + repr(wanted and sorted(wanted)).encode("utf-8", "surrogatepass"))
    if key not in _LATEST:
        _LATEST.clear()
        _LATEST[key] = Restorer(model, wanted)
    return _LATEST[key]


def features(word: str) -> tuple[str, ...]:
    """A word and its beginnings."""
    return tuple({word + "$", word[:4], word[:5]}) if len(word) > 2 else ()


class Toxicity(NamedTuple):
    """What is learned: the language model, a lower bound of toxicity for each kept feature, and the words that begin as one
    does, but are rather clean by their own counts."""

    model: np.ndarray
    bounds: dict[str, float]
    ordinary: frozenset[str] = frozenset()

    def of(self, word: str) -> float:
        """The bound of a word: its own, or one of its beginnings' unless it is an ordinary word."""
        if len(word) < 3:
            return 0.0
        get = self.bounds.get
        own = get(word + "$", 0.0)
        begins = max(get(word[:4], 0.0), get(word[:5], 0.0))
        return own if begins <= own or word in self.ordinary else begins


def wilson_low(part: int, whole: int, z: float = 1.96) -> float:
    p = part / whole
    return (p + z * z / (2 * whole) - z * math.sqrt(p * (1 - p) / whole + z * z / (4 * whole * whole))) / (1 + z * z / whole)


def log_tail(part: int, whole: int, chance: float) -> float:
    """An upper bound (Chernoff) of the log probability of at least ``part`` of ``whole`` by chance."""
    p = part / whole
    if p <= chance:
        return 0.0
    return -whole * (p * math.log(p / chance) + ((1 - p) * math.log((1 - p) / (1 - chance)) if p < 1 else 0.0))


def _support(docs: DataFrame, sent, wanted) -> dict[str, tuple[int, int]]:
    """Smaller and larger of the numbers of texts and of preceding words of each feature; of wanted ones, and words that begin
    as one does, only, if given."""

    def pairs(rows: Iterator[tuple]) -> Iterator[tuple]:
        restorer = restorer_of(sent.value)
        words = Memo(restorer.words, REMEMBERED)
        only = wanted and wanted.value
        for (text,) in rows:
            before, seen, own = "", set(), xxhash.xxh64_intdigest(text or "") >> 1
            for token in [*(text or "").split(), *restorer.spaced(text or "")]:
                context, found = xxhash.xxh64_intdigest(before) >> 1, words[token]
                for word in found:
                    own_features = features(word)
                    begins = only and not only.isdisjoint(own_features)
                    for f in own_features:
                        if not only or f in only or begins and f[-1] == "$":
                            seen.add((f, context))
                before = found[0] if found else ""
            for f, context in seen:
                yield f, context, own

    rows = map_stream(docs.select("text"), "feature string, context long, own long", pairs, rows=50_000)
    counts = F.count_distinct("context"), F.count_distinct("own")
    found = rows.groupBy("feature").agg(F.least(*counts).alias("low"), F.greatest(*counts).alias("high"))
    return {r["feature"]: (r["low"], r["high"]) for r in found.where(F.col("low") >= (1 if wanted else LEAST_SUPPORT)).toLocalIterator()}


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame) -> Toxicity:
    spark = docs.sparkSession
    model = language_model(count_trigrams(docs))
    sent = spark.sparkContext.broadcast(model)
    train = labels.where(fold() != HELD_OUT).where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}

    def sample(toxic: int, most: int) -> DataFrame:
        """At most about ``most`` labelled rows; so few ids that they can be sent to all tasks."""
        share = min(1.0, most / max(1, found.get(toxic, 0)))
        ids = train.where((F.col("toxic") == toxic) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))).select("doc_id")
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")

    toxic = _support(sample(1, TOXIC_ROWS), sent, None)
    clean = _support(sample(0, CLEAN_ROWS), sent, spark.sparkContext.broadcast(frozenset(toxic))) if toxic else {}
    against = {f: high for f, (_, high) in clean.items()}
    total = sum(low for low, _ in toxic.values())
    chance = min(total / (total + sum(against.values())), 1 - 1e-9) if total else 0.5
    limit = math.log(SIGNIFICANCE / max(1, len(toxic)))
    bounds = {}
    for f, (t, _) in toxic.items():
        n = t + against.get(f, 0)
        if wilson_low(t, n) > 0.5 and log_tail(t, n, chance) < limit:
            bounds[f] = wilson_low(t, n)
    words = lambda found: Counter(b for f in found if f[-1] == "$" for b in {f[:4], f[:5]} - {f})
    ours, theirs = words(toxic), words(f for f in against if f not in bounds)
    bounds = {f: b for f, b in bounds.items() if f[-1] == "$" or theirs[f] <= ours[f]}
    begun = ((f[:-1], n) for f, n in against.items() if f[-1] == "$" and (f[:4] in bounds or f[:5] in bounds))
    ordinary = frozenset(w for w, n in begun if n >= LEAST_ORDINARY and wilson_low((own := toxic.get(w + "$", (0, 0))[0]), own + n) <= 0.5)
    return Toxicity(model, bounds, ordinary)


def score(docs: DataFrame, learned: Toxicity) -> DataFrame:
    """``docs`` with score and predicted added."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def start():
        restorer, best = restorer_of(sent.value.model, frozenset(sent.value.bounds)), sent.value.of
        plain = restorer.plain
        tokens = Memo(lambda token: max(map(best, restorer.words(token)), default=0.0), REMEMBERED)

        def run(texts: list[str | None]) -> Iterator[tuple]:
            for text in texts:
                text, clean = text or "", 1.0
                for token in set(text.split()):
                    if not plain(token) and (p := tokens[token]):
                        clean *= 1 - p
                for word in restorer.spaced(text):
                    clean *= 1 - best(word)
                value = max(FLOOR, 1 - clean)
                yield value, int(value >= THRESHOLD)

        return run

    return add_columns(docs, ["text"], "score double, predicted int", start)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    learned = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score(docs, learned).select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", "predicted")
