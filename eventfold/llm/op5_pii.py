"""PII by weak supervision, in DataFrame functions throughout.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. The method adds spans of two kinds.
``secret``: runs of eight or more ASCII letters, digits and ``_+/-`` inside them that hold a letter and a digit.
``name``: two or three capitalised words in a row. For each kind labelers vote +1, 0 or -1 on every candidate: by
regex (the run's shape, its mixture), by gazetteer (words that announce a secret or deny it; given names, titles)
and by context (the character before, the case, the start of a sentence). Expectation-maximisation over the counts
of vote patterns estimates every labeler's reliability and each pattern's posterior; these are the soft labels from
which the kind's final span classifier, naive Bayes over features of the span, is trained. It alone decides, also
for spans on which all labelers abstain.

Plan: the first pass reduces all candidates to counts by (kind, votes, features), of which there are at most some
ten thousand whatever the input; the driver's part works on those counts. The second pass finds the spans of
each document in place: nothing is joined, so repeated or null doc_ids cannot mix. Offsets follow from
the lengths of what stands between matches, as ``split`` and ``regexp_extract_all`` cut at the same places. Sums
over a document's matches run in chunks, so that a text of very many matches takes no square of their number.

The patterns differ from the contract's in writing only: possessive quantifiers and look-behinds keep
the same leftmost matches but take linear time and no stack on very long runs.

Cases: a null or empty text has no spans. Ties of start go by kind. Added spans never overlap base ones.
With no candidates nothing is added. An empty table gives no rows; columns named like the results are
replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.common import table

BASE = ("email", "ip", "card", "phone")
# The base patterns.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SECRET = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9][A-Za-z0-9_+/-]{7,}+"
# The gazetteers: words before a secret, before what only looks like one, before a name, and given names.
CUES = ("token", "password", "passwd", "passwort", "pwd", "secret", "key", "apikey", "auth", "bearer", "credential", "private", "clave", "geheim", "motdepasse")
NOT_CUES = ("sha", "sha1", "sha256", "md5", "commit", "uuid", "isbn", "doi", "version", "hash", "checksum", "digest", "revision", "build", "id")
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "mme", "dear", "patient", "customer", "employee")
NAME = rf"(?<![\p{{L}}\p{{N}}_])(?!(?i:{'|'.join(TITLES)})\b)\p{{Lu}}\p{{Ll}}{{1,20}}+(?: \p{{Lu}}\p{{Ll}}{{1,20}}+){{1,2}}+(?![\p{{L}}\p{{N}}_])"
GIVEN = (
    "james", "mary", "robert", "patricia", "john", "jennifer", "michael", "linda", "david", "elizabeth", "william", "barbara", "richard", "susan", "joseph", "jessica", "thomas", "sarah", "charles", "karen",
    "christopher", "lisa", "daniel", "nancy", "matthew", "betty", "anthony", "sandra", "mark", "margaret", "paul", "ashley", "steven", "kimberly", "andrew", "emily", "kenneth", "donna", "george", "michelle",
    "kevin", "carol", "brian", "amanda", "edward", "melissa", "peter", "laura", "maria", "anna", "jan", "eva", "hans", "klaus", "juergen", "wolfgang", "heike", "sabine", "ursula", "petra", "monika", "stefan",
    "andreas", "martin", "pierre", "jean", "michel", "philippe", "alain", "nicolas", "marie", "nathalie", "isabelle", "sylvie", "catherine", "francoise", "jose", "juan", "antonio", "manuel", "carlos", "luis",
    "javier", "carmen", "ana", "isabel", "dolores", "pilar", "lucia", "sofia", "mohammed", "ahmed", "fatima", "ali", "wei", "li", "ming", "yuki", "hiroshi", "priya", "raj", "olga", "ivan", "dmitri", "natasha",
)
ROUNDS, TRUST = 60, 0.2

CHUNK = 64

_MATCH = "array<struct<at:int,stop:int,said:string,before:string,after:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what a lambda takes from outside is computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The running sums or maxima of an array of non-negative integers, in chunks so that no array is grown to a great length."""
    none = F.array().cast("array<int>")

    def scan(part: Column) -> Column:
        step = lambda acc, x: bound(op(acc["all"], x), lambda v: F.struct(v.alias("all"), F.concat(acc["out"], F.array(v)).alias("out")))
        return F.aggregate(part, F.struct(F.lit(0).alias("all"), none.alias("out")), step)

    def firsts(scans: Column) -> Column:
        step = lambda acc, s: F.struct(op(acc["all"], s["all"]).alias("all"), F.concat(acc["out"], F.array(acc["all"])).alias("out"))
        return F.aggregate(scans, F.struct(F.lit(0).alias("all"), none.alias("out")), step, lambda acc: acc["out"])

    def joined(scans: Column) -> Column:
        return F.flatten(F.zip_with(scans, firsts(scans), lambda s, first: F.transform(s["out"], lambda x: op(x, first))))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: scan(F.slice(v, c * CHUNK + 1, CHUNK)))
    return bound(values, lambda v: F.when(F.size(v) == 0, none).otherwise(bound(cut(v), joined)))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches with their offsets in code points, and up to 24 characters before and 1 after."""

    def placed(found: Column, parts: Column) -> Column:
        n = F.size(found)
        ends = running(F.zip_with(found, F.slice(parts, 1, n), lambda m, p: F.length(p) + F.length(m)), lambda a, b: a + b)
        around = F.zip_with(F.slice(parts, 1, n), F.slice(parts, 2, n), lambda p, q: F.struct(F.substring(p, -24, 24).alias("before"), F.substring(q, 1, 1).alias("after")))
        own = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("at"), e.alias("stop"), m.alias("said")))
        return F.zip_with(own, around, lambda m, x: F.struct(m["at"].alias("at"), m["stop"].alias("stop"), m["said"].alias("said"), x["before"].alias("before"), x["after"].alias("after")))

    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return bound(found, lambda f: F.when(F.size(f) == 0, F.array().cast(_MATCH)).otherwise(bound(parts, lambda p: placed(f, p))))


def _where(text: Column, needs: str, pattern: str) -> Column:
    """``matches`` only where a cheap test finds what every match needs."""
    return F.when(text.rlike(needs), matches(text, pattern)).otherwise(F.array().cast(_MATCH))


def _digits(said: Column) -> Column:
    return F.translate(said, " +().-", "")


def base_spans(text: Column) -> dict[str, Column]:
    """Matches of each base kind that pass their test."""
    digits = lambda m, a, b: F.length(_digits(m["said"])).between(a, b)
    return {
        "email": _where(text, "@", EMAIL),
        "ip": F.filter(_where(text, r"[0-9]\.[0-9]", IP), lambda m: m["said"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter(_where(text, r"(?:[0-9][\x20-]?){11}[0-9]", CARD), lambda m: digits(m, 12, 19) & F.call_function("luhn_check", _digits(m["said"]))),
        "phone": F.filter(_where(text, r"\+[0-9]", PHONE), lambda m: digits(m, 9, 15)),
    }


def _alternations(said: Column) -> Column:
    return F.size(F.split(said, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])", -1)) - 1


def _sign(plus: Column, minus: Column) -> Column:
    return F.when(plus, "+").when(minus, "-").otherwise("0")


def _last_word(before: Column) -> Column:
    """The word that ends up to four other characters before the match."""
    return F.regexp_extract(F.lower(before), r"(\w+)\W{0,4}$", 1)


def secret_votes(m: Column) -> Column:
    """Two labelers by regex, one by gazetteer, two by context."""
    said, cue, last = m["said"], _last_word(m["before"]), F.substring(m["before"], -1, 1)
    return F.concat(
        _sign(said.rlike("^(?:AKIA[0-9A-Z]{12,}|[0-9a-f]{16,}|[0-9A-F]{16,})$"), said.rlike("^[0-9]+[a-zA-Z]{1,3}$|^[A-Za-z]+[0-9]{1,4}$|[/_-].*[/_-]")),
        _sign(_alternations(said) >= 4, _alternations(said) <= 1),
        _sign(cue.isin(*CUES), cue.isin(*NOT_CUES)),
        _sign(last.isin("=", ":", '"', "'"), last.isin("/", ".", "_", "-", "@", "#")),
        _sign((F.lower(said) == said) | (F.upper(said) == said), said.rlike("[a-z][A-Z].*[a-z][A-Z]")),
    )


def secret_traits(m: Column) -> Column:
    """Length, letters, mixture, character before."""
    said, n, last = m["said"], F.length(m["said"]), F.substring(m["before"], -1, 1)
    return F.concat_ws(
        "|",
        F.when(n < 16, "8").when(n < 20, "16").when(n < 32, "20").when(n < 40, "32").when(n < 64, "40").otherwise("64"),
        F.when(said.rlike("[/_+-]"), "marks").when(said.rlike("^[0-9a-f]+$"), "hex").when(said.rlike("^[0-9A-F]+$"), "HEX").when(F.upper(said) == said, "upper").otherwise("mixed"),
        F.when(_alternations(said) >= 4, "many").when(_alternations(said) >= 2, "some").otherwise("one"),
        F.when(last.isin("=", ":", '"', "'"), "sign").when((last == "") | last.rlike(r"^\s"), "blank").otherwise("other"),
    )


def _given(said: Column) -> Column:
    return F.lower(F.substring_index(said, " ", 1)).isin(*GIVEN)


def _starts(before: Column) -> Column:
    return before.rlike(r"(?:^|[.!?\n]\s*)$")


def name_votes(m: Column) -> Column:
    """One labeler by regex, two by gazetteer, one by context."""
    said, cue = m["said"], _last_word(m["before"])
    return F.concat(
        _sign(F.lit(False), said.rlike(r"^\S{1,3} |\S{14,}| \S{1,2}$")),
        _sign(_given(said), ~_given(said)),
        _sign(cue.isin(*TITLES), F.lit(False)),
        _sign(m["before"].rlike("[a-z,:(] ?$"), _starts(m["before"])),
    )


def name_traits(m: Column) -> Column:
    """Number of words, whether the first is a given name or follows a title, and where it stands."""
    words = F.size(F.split(m["said"], " "))
    return F.concat_ws(
        "|", words.cast("string"), F.when(_given(m["said"]), "given").otherwise("other"), F.when(_last_word(m["before"]).isin(*TITLES), "title").otherwise("none"),
        F.when(_starts(m["before"]), "start").otherwise("inside"),
    )


class Added(NamedTuple):
    """A kind of span that the method finds: what each candidate needs, its pattern, votes and traits."""

    kind: str
    needs: str
    pattern: str
    votes: Callable[[Column], Column]
    traits: Callable[[Column], Column]

    def candidates(self, text: Column) -> Column:
        return _where(text, self.needs, self.pattern)

    def among(self, accepted: list[str]) -> Callable[[Column], Column]:
        return lambda m: self.traits(m).isin(*accepted)


ADDED = (Added("secret", "[0-9]", SECRET, secret_votes, secret_traits), Added("name", r"\p{Lu}\p{Ll}+ \p{Lu}", NAME, name_votes, name_traits))
KINDS = (*BASE, *(a.kind for a in ADDED))


def reliabilities(counts: dict[str, float]) -> tuple[float, list[dict[str, tuple[float, float]]], dict[str, float]]:
    """Expectation-maximisation over vote patterns: prior, each labeler's probabilities of a vote for a span that
    is not and that is private, and each pattern's posterior. It starts from the votes' majority; that labelers are
    better than chance is given beforehand, at the weight of ``TRUST`` of the candidates, so that where nothing is
    private no class of its own is made of it."""
    belief = {v: 0.9 if v.count("+") > v.count("-") + 1 else 0.1 if v.count("-") >= v.count("+") else 0.5 for v in counts}
    prior, tables = 0.5, []
    for _ in range(ROUNDS):
        yes = sum(n * belief[v] for v, n in counts.items())
        total = sum(counts.values())
        prior, weight = (yes + 1) / (total + 2), 3 + TRUST * total
        tables = []
        for k in range(len(next(iter(counts)))):
            cells = {s: [weight * no, weight * yes_] for s, no, yes_ in (("+", 0.1, 0.5), ("0", 0.5, 0.4), ("-", 0.4, 0.1))}
            for v, n in counts.items():
                cells[v[k]][0] += n * (1 - belief[v])
                cells[v[k]][1] += n * belief[v]
            tables.append({s: (a / (total - yes + weight), b / (yes + weight)) for s, (a, b) in cells.items()})
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[s][1] / t[s][0]) for t, s in zip(tables, v, strict=True))
            belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, tables, belief


def train(counts: dict[tuple[str, str], int]) -> list[str]:
    """The traits that the final classifier accepts, among those seen."""
    by_votes: dict[str, float] = defaultdict(float)
    for (v, _), n in counts.items():
        by_votes[v] += n
    if not by_votes:
        return []
    prior, _, belief = reliabilities(by_votes)
    cells: dict[tuple[int, str], list[float]] = defaultdict(lambda: [1.0, 1.0])
    totals = [1.0, 1.0]
    for (v, t), n in counts.items():
        for z, weight in ((0, n * (1 - belief[v])), (1, n * belief[v])):
            totals[z] += weight
            for k, value in enumerate(t.split("|")):
                cells[k, value][z] += weight
    accepted = []
    for t in sorted({t for _, t in counts}):
        odds = math.log(totals[1] / totals[0])
        odds += sum(math.log(cells[k, x][1] / totals[1]) - math.log(cells[k, x][0] / totals[0]) for k, x in enumerate(t.split("|")))
        if odds > 0:
            accepted.append(t)
    return accepted


def learn(docs: DataFrame, text: str = "text") -> dict[str, list[str]]:
    """Traits of private spans of each kind, learned from all candidates of all documents."""
    one = lambda a: F.transform(a.candidates(F.col(text)), lambda m: F.struct(F.lit(a.kind).alias("kind"), a.votes(m).alias("v"), a.traits(m).alias("t")))
    counts = docs.select(F.explode(F.concat(*map(one, ADDED))).alias("c")).groupBy("c.kind", "c.v", "c.t").count().collect()
    return {a.kind: train({(r["v"], r["t"]): r["count"] for r in counts if r["kind"] == a.kind}) for a in ADDED}


_SPAN = "array<struct<at:int,kind_no:int,stop:int,kind:string>>"


def _spans(found: Column, no: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["at"].alias("at"), F.lit(no).alias("kind_no"), m["stop"].alias("stop"), F.lit(KINDS[no]).alias("kind")))


def clear_of(added: Column, base: Column) -> Column:
    """Both sorted by start, without those added that overlap base ones or added ones before them."""
    far = 2**31 - 1
    is_base = lambda s: s["kind_no"] < len(BASE)
    largest = lambda a, b: F.greatest(a, b)

    def kept(spans: Column) -> Column:
        upto = running(F.transform(spans, lambda s: F.when(is_base(s), s["stop"]).otherwise(0)), largest)
        after = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(is_base(s), far - s["at"]).otherwise(0))), largest))
        rows = F.zip_with(spans, F.zip_with(upto, after, lambda u, a: F.struct(u.alias("u"), (far - a).alias("a"))), lambda s, x: F.struct(s.alias("s"), x["u"].alias("u"), x["a"].alias("a")))
        return F.transform(F.filter(rows, lambda r: is_base(r["s"]) | ((r["u"] <= r["s"]["at"]) & (r["a"] >= r["s"]["stop"]))), lambda r: r["s"])

    return F.when(F.size(added) == 0, base).otherwise(bound(F.array_sort(F.concat(base, added)), kept))


def find_spans(docs: DataFrame, accepted: dict[str, list[str]], text: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (at, kind_no, stop, kind), sorted."""
    col = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*(_spans(c, no) for no, c in enumerate(base_spans(col).values()))))
    docs = docs.drop("base_spans", "spans", "_added").withColumn("base_spans", base)
    added = [F.array().cast(_SPAN)]
    for no, a in enumerate(ADDED, len(BASE)):
        if accepted.get(a.kind):
            added.append(_spans(F.filter(a.candidates(col), a.among(accepted[a.kind])), no))
    return docs.withColumn("_added", F.concat(*added)).withColumn("spans", clear_of(F.col("_added"), F.col("base_spans"))).drop("_added")


def written(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, accepted: dict[str, list[str]]) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; a span inside another goes with it.

    A text is cut before every ``CHUNK``th span first, and then at the spans, as finding a place takes time by the length before it.
    """
    found = find_spans(docs, accepted)

    def cut(spans: Column) -> Column:
        """(at, stop, kind, from): from is where the text goes on after the spans before."""
        from_ = F.concat(F.array(F.lit(0)), running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b)))
        return F.zip_with(spans, F.slice(from_, 1, F.size(spans)), lambda s, x: F.struct(s["at"].alias("at"), s["stop"].alias("stop"), s["kind"].alias("kind"), x.alias("from")))

    def piece(part: Column) -> Column:
        """The text from the first span's ``from`` to the last span, which is replaced."""
        low = F.element_at(part, 1)["from"]

        def inner(own: Column, low: Column) -> Column:
            said = lambda s: F.concat(F.substring(own, s["from"] - low + 1, s["at"] - s["from"]), F.lit("<"), s["kind"], F.lit(">"))
            return F.array_join(F.transform(part, lambda s: F.when(s["at"] >= s["from"], said(s)).otherwise("")), "")

        return bound(low, lambda x: bound(F.substring(F.col("text"), x + 1, F.element_at(part, -1)["at"] - x), lambda own: inner(own, x)))

    def whole(spans: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda c: bound(F.slice(spans, c * CHUNK + 1, CHUNK), piece))
        last = F.greatest(F.array_max(F.transform(spans, lambda s: s["stop"])), F.lit(0))
        return F.concat(F.array_join(parts, ""), bound(last, lambda x: F.substring(F.col("text"), x + 1, F.length("text"))))

    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(bound(cut(F.col("spans")), whole))
    return found.withColumn("text", text).drop("base_spans", "spans")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of base spans, and all spans and their number, of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = find_spans(docs, learn(docs))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(written("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, BASE), base, written("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
