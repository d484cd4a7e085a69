"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. ``locate`` renders the
prefixes of a conversation one turn longer each time. Where an output continues the one before, the
added characters are the new turn's span; where it does not, the template has rewritten history, which
is counted, and the texts of all turns are located once more in the last output. Rendering a turn with a
probe, a character that the conversation does not have, in place of its text shows how many characters stand
before and after the text, so the loss mask needs no knowledge of the template. A template that drops, repeats or
changes the probe, or whose other characters depend on a text, is refused.

The registered template goes that way, as any other. So a conversation's turns and a few of its renderings are held in a
task, and its time grows with the square of its turns: nothing is known of a template but what it gives for each prefix.

A template may state how many turns it looks back at. The statement is not trusted: after every turn the whole prefix is
rendered too, and has to be what the turns have given so far, or the template is refused. A template made turn by turn
(``Turnwise``) is a function from a turn and those before it to what is added, and a rendering is these one after another.
There nothing is stated that could be untrue, so a conversation is a stream of any length.

Turns of a conversation arrive sorted by (turn, role, text) in one task, conversations one after another; hashes over a
conversation are one after another by their nature.

Cases: null role or text: empty. Equal (conv_id, turn) rows are all kept, ordered by role and text.
Rows with null conv_id form one conversation. An empty table gives only what the caller adds.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.common import map_stream, table

#: Characters in one row of a formatted conversation.
PART_CHARS = 1 << 20
# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_HIGH = re.compile("[\ue000-\U0010ffff]")
Turn = tuple[str, str]


def escape(text: str) -> str:
    """Backslashes doubled, and one put after the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class Template(NamedTuple):
    """A rendering, and how many turns before the last one can change what is added for it; None: all, and it may rewrite."""

    render: Callable[[list[Turn]], str]
    look_back: int | None = None


class Turnwise(NamedTuple):
    """What a turn adds, from the last ``look_back`` turns before it and the turn itself."""

    added: Callable[[list[Turn], Turn], str]
    look_back: int = 0


def _instruct(turn: Turn) -> str:
    """A turn in the registered template: role in a pair of marks, then the text and an end mark."""
    return f"[INST] {escape(turn[0])} [/INST] {escape(turn[1])}</s>"


def render(turns: Iterable[Turn]) -> str:
    return "".join(map(_instruct, turns))


class Instruct:
    """``render`` for a conversation's prefixes one after another: what its turns have become is kept, until a single turn
    begins the next conversation."""

    def __init__(self) -> None:
        self.kept: dict[Turn, str] = {}

    def __reduce__(self) -> tuple:
        return Instruct, ()

    def __call__(self, turns: list[Turn]) -> str:
        kept = self.kept
        if len(turns) == 1:
            kept.clear()
        return "".join([kept.get(turn) or kept.setdefault(turn, _instruct(turn)) for turn in turns])


def role_of(head: str) -> str:
    """The role from what stands before a turn's text."""
    return unescape(head[len("[INST] ") : -len(" [/INST] ")])


INSTRUCT = Template(Instruct())


class Located:
    """A rendered conversation: the output, each turn's span and the part of it that is text, and rewrites of history."""

    def __init__(self) -> None:
        self.output, self.spans, self.texts, self.rewrites = "", [], [], 0


def probe_for(turns: list[Turn]) -> str:
    """A private-use character that no role or text has, or the next one behind those."""
    used = {c for turn in turns for x in turn for c in _HIGH.findall(x)}
    return next(c for c in map(chr, range(0xE000, 0x110000)) if c not in used)


def text_place(template: Callable[[list[Turn]], str], turns: list[Turn], k: int, output: str, probe: str | None = None) -> tuple[int, int]:
    """Start and end of turn k's text in the output of all turns."""
    probe = probe or probe_for(turns)
    probed = template([*turns[:k], (turns[k][0], probe), *turns[k + 1 :]])
    start = probed.find(probe)
    stop = len(output) - (len(probed) - start - 1)
    if probed.count(probe) != 1 or stop < start or output[:start] != probed[:start] or output[stop:] != probed[start + 1 :]:
        raise ValueError("the template drops, repeats or changes a text, or what is around it")
    return start, stop


def locate(template: Callable[[list[Turn]], str], turns: list[Turn]) -> Located:
    """The whole prefixes one after another; for templates of which nothing is known."""
    found, probe = Located(), probe_for(turns)
    for k in range(1, len(turns) + 1):
        before, now = found.output, template(turns[:k])
        found.rewrites += not now.startswith(before)
        found.output = now
        found.spans.append((len(before), len(now)))
        if not found.rewrites:
            found.texts.append(text_place(template, turns[:k], k - 1, now, probe))
    if found.rewrites:
        found.texts = [text_place(template, turns, k, found.output, probe) for k in range(len(turns))]
        found.spans = list(found.texts)
    return found


def cut(found: Located) -> Iterator[tuple[str, int, int]]:
    """The output by what each turn added, or where history was rewritten by texts with what is before them, at last all."""
    spans = found.spans
    if found.rewrites:
        ends = [b for _, b in found.texts[:-1]]
        spans = zip([0, *ends], [*ends, len(found.output)], strict=True)
    for (start, stop), (a, b) in zip(spans, found.texts, strict=True):
        if a < start:
            raise ValueError("the template puts a text into history")
        yield found.output[start:stop], a - start, b - start


def pieces(template: Template | Turnwise, turns: Iterable[Turn]) -> Iterator[tuple[str, int, int]]:
    """What each turn adds to the output, and the start and end of its text in that."""
    if isinstance(template, Turnwise):
        last: deque[Turn] = deque(maxlen=template.look_back)
        for turn in turns:
            before = list(last)
            alone = lambda one, before=before: template.added(before, one[0])
            added = alone([turn])
            yield added, *text_place(alone, [turn], 0, added)
            last.append(turn)
        return
    if template.look_back is None:
        yield from cut(locate(template.render, list(turns)))
        return
    window: deque[Turn] = deque(maxlen=template.look_back)
    held: list[Turn] = []
    parts: list[str] = []
    for turn in turns:
        own = [*window, turn]
        before, now = template.render(own[:-1]) if window else "", template.render(own)
        if not now.startswith(before):
            raise ValueError("the template rewrites history")
        start, stop = (x - len(before) for x in text_place(template.render, own, len(own) - 1, now))
        added = now[len(before) :]
        if start < 0:
            raise ValueError("the template puts a text into history")
        held.append(turn)
        parts.append(added)
        check(template, held, parts)
        window.append(turn)
        yield added, start, stop


def check(template: Template, turns: list[Turn], parts: list[str]) -> None:
    """Whether the whole rendering is what was added turn by turn."""
    if template.render(turns) != "".join(parts):
        raise ValueError("the template looks back further than it states, or rewrites history")


def digest(conv, turns: Iterable[tuple[str, str]], template: Template | Turnwise = INSTRUCT, role_of=role_of, unescape=unescape) -> tuple:
    """What is read back from a conversation's rendering, and how often it rewrote history; a template that states
    anything is refused if it does."""
    n = loss = chars = rewrites = 0
    turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
    if isinstance(template, Template) and template.look_back is None:
        found = locate(template.render, list(turns))
        added_turns, rewrites = cut(found), found.rewrites
    else:
        added_turns = pieces(template, turns)
    for added, start, stop in added_turns:
        role, text = role_of(added[:start]), unescape(added[start:stop])
        n, chars = n + 1, chars + len(added)
        turns_hash.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss += len(text)
            loss_hash.update(text.encode())
    return conv, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars, rewrites


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[Turn]]]:
    for conv, own in groupby(rows, lambda r: r[0]):
        yield conv, ((role or "", text or "") for _, role, text in own)


def _in_order(conversations: DataFrame) -> DataFrame:
    return conversations.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, template: Template | Turnwise = INSTRUCT) -> DataFrame:
    """conv_id, part, start, formatted text and loss_spans (code points of the conversation, end exclusive).

    A conversation is one rendering; a long one comes in parts, to be joined in order, so that no row outgrows memory."""

    def formatted(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns in _conversations(rows):
            held, spans, part, first, at, said = [], [], 0, 0, 0, deque()

            def told(turns, said=said):
                for turn in turns:
                    said.append(turn[0])
                    yield turn

            for added, start, stop in pieces(template, told(turns)):
                if said.popleft() == "assistant":
                    spans.append([at + start, at + stop])
                held.append(added)
                at += len(added)
                if at - first >= PART_CHARS:
                    yield conv, part, first, "".join(held), spans
                    held, spans, part, first = [], [], part + 1, at
            if held:
                yield conv, part, first, "".join(held), spans

    return map_stream(_in_order(conversations), "conv_id long, part long, start long, formatted string, loss_spans array<array<long>>", formatted, rows=16)


def digest_conversations(conversations: DataFrame, template: Template | Turnwise = INSTRUCT, role_of=role_of, unescape=unescape) -> DataFrame:
    """One row for each conversation, all read back from its rendering."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"
    return map_stream(_in_order(conversations), schema, lambda rows: (digest(conv, turns, template, role_of, unescape) for conv, turns in _conversations(rows)))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and -7, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digest_conversations(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS role_e,
            replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS text_e FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('[INST] ') + length(role_e) + length(' [/INST] ') + length(text_e) + length('</s>')) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS rewrites
FROM e GROUP BY conv_id
"""
