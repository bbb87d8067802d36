"""Chat formatting with a template taken as a black box.

A template turns a list of (role, text) into one string. It is rendered for successive prefixes of a
conversation; what a prefix adds to the one before is its turn's span, and a template whose output for a longer
prefix does not begin with that for the shorter one rewrites history. Where the text stands inside the span is
found by rendering the turn with other texts and comparing. The spans of assistant texts are the loss mask.

Rendering every prefix costs a square of the turns, so a conversation longer than WINDOW turns is rendered in
windows that overlap, if the last of their turns renders in the new window as it did in the old one; what stands before a
window's first turn, such as a header, is shown once. A template for which it doesn't (one that numbers the turns, say) is
rendered by whole prefixes however long the conversation is. What windows show is held against the whole prefix: whenever
the turns have grown by an eighth, and at the conversation's end, so joined spans equal the template's output or an error is raised:
Rewrites with the turn that changes history, or LooksFar if the template only looks further back than a window, for which whole prefixes (window=inf) are right.
The whole prefixes together cost about nine renderings of the conversation. For this a task keeps one conversation's turns.

A template may be declared to look at most reach turns back. Of its conversations turns are kept up to CHECKED characters, and up
to there they are held against whole prefixes too. Beyond, only windows and digests are kept, so that one conversation may have most rows; where windows
meet a turn is still compared. The template of this module has reach 0.

The template of this module marks turns as <|im_start|>role, line feed, text, <|im_end|>, line feed. A backslash goes into
every <|, <\\|, ... of a role or text, and one comes out when it is read back, so no text can forge a mark. Roles also
escape line feeds and backslashes.

Null text or role: as empty. Null turn: first. Ties of a turn: by role, then text. Null conv_id: a conversation
of its own. Repeated rows: turns of their own. Very long texts: rendered whole, one turn at a time, and again for each check. Extra columns, whatever their names, are not read. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a window, and of the old one's that the next one begins with.
WINDOW, OVERLAP = 32, 4
#: Characters of a conversation that is held against whole prefixes though the template's reach is known.
CHECKED = 1 << 24


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chatml(turns: list[Turn]) -> str:
    return "".join(f"{START}{escape_role(r)}\n{escape(t)}{END}\n" for r, t in turns)


class Rewrites(ValueError):
    """The template's output for a longer prefix doesn't begin with that for a shorter one."""


class LooksFar(ValueError):
    """The template rewrites nothing, but a turn depends on more turns before it than windows show."""


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def content_span(template: Template, before: list[Turn], role: str, text: str, start: int, whole: str) -> tuple[int, int]:
    """Where the text of the last turn stands in whole, which begins with start characters for the turns before."""
    # two probes differ in their first and last characters, so what they share on either side is the frame
    a, b = (template([*before, (role, p)])[start:] for p in ("a-a", "b-b"))
    head = common_prefix(a, b)
    tail = common_prefix(a[head:][::-1], b[head:][::-1])
    span = whole[start:]
    if span[:head] != a[:head] or (tail and span[len(span) - tail :] != a[len(a) - tail :]):
        raise Rewrites("the frame of a turn depends on its text")
    return start + head, len(whole) - tail


class Conversation:
    """Renders turns as they come. Each yields (rendered characters, start and end of its text within them); close() ends it.

    reach: how many turns back the template looks, if that is known.
    """

    def __init__(self, template: Template, window: float = WINDOW, reach: int | None = None):
        self.template, self.reach, self.overlap = template, reach, max(OVERLAP, (reach or 0) + 2)
        self.window: float = max(window, self.overlap)
        self.turns: list[Turn] = []
        self.shown = self.span = ""
        self.frames: dict[tuple[str, bool], tuple[str, str]] = {}
        # all turns so far, unless they are too many of a known reach, and the digest of what they showed
        self.all: list[Turn] | None = []
        self.count = self.chars = self.checked = 0
        self.joined = sha256()

    @property
    def whole(self) -> bool:
        """turns are all that came."""
        return len(self.turns) == self.count

    def check(self) -> None:
        """Holds what was shown against the whole prefix."""
        self.checked = self.count
        if not self.whole and self.all is not None and sha256(self.template(self.all).encode("utf-8", "surrogatepass")).digest() != self.joined.digest():
            if (k := rewrites(self.template, self.all)) is not None:
                raise Rewrites(f"turn {k} changes what stands before it")
            raise LooksFar(f"a turn up to {self.count - 1} depends on more turns before it than windows show; render by whole prefixes")

    def close(self) -> None:
        if self.checked < self.count:
            self.check()

    def shift(self) -> None:
        """Begins the next window, if its last turn renders as it did in the old one."""
        before, shown = self.template(self.turns[-self.overlap : -1]), self.template(self.turns[-self.overlap :])
        if shown.startswith(before) and shown[len(before) :] == self.span:
            self.turns, self.shown = self.turns[-self.overlap :], shown
        elif self.whole:
            self.window = float("inf")
        elif self.all is None:
            raise LooksFar("a turn depends on more turns before it than the template's reach")
        else:  # from here on by whole prefixes
            self.check()
            self.turns, self.window = self.all[:], float("inf")
            self.shown = self.template(self.turns)

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        if len(self.turns) >= self.window:
            self.shift()
        whole = self.template([*self.turns, (role, text)])
        if not whole.startswith(self.shown):
            raise Rewrites(f"turn {self.count} changes what stands before it")
        start = len(self.shown)
        key = (role, not self.turns)
        head, tail = self.frames.get(key, (None, None))
        span = whole[start:]
        if head is not None and len(span) >= len(head) + len(tail) and span.startswith(head) and span.endswith(tail):
            a, b = len(head), len(span) - len(tail)
        else:
            a, b = content_span(self.template, self.turns, role, text, start, whole)
            a, b = a - start, b - start
            if len(self.frames) < 64:
                self.frames[key] = (span[:a], span[b:])
        self.turns.append((role, text))
        self.shown, self.span = whole, span
        self.count += 1
        self.chars += len(span)
        if self.all is not None:
            self.all.append((role, text))
            self.joined.update(span.encode("utf-8", "surrogatepass"))
            if self.reach is not None and self.chars > CHECKED:
                self.all = None
            elif self.count >= max(WINDOW, self.checked + max(1, self.checked // 8)):
                self.check()
        return span, a, b


def rewrites(template: Template, turns: list[Turn]) -> int | None:
    """The first turn whose rendering changes what stands before it, if any does."""
    shown = ""
    for k in range(len(turns)):
        now = template(turns[: k + 1])
        if not now.startswith(shown):
            return k
        shown = now
    return None


def read_back(span: str) -> Turn:
    """Role and text of one turn of chatml()."""
    if not span.startswith(START) or not span.endswith(END + "\n") or span.count(START) != 1 or span.count(END) != 1:
        raise ValueError("not one turn")
    role, _, text = span[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(text)


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, a conversation's rows together and in order."""
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"))
    return rows.repartition(common.partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in it:
        yield from zip(common.column(b, "conv_id"), common.column(b, "turn"), common.column(b, "role"), common.column(b, "text"), strict=True)


def render(conversations: DataFrame, template: Template = chatml, reach: int | None = None, window: float = WINDOW) -> DataFrame:
    """One row per turn: conv_id, position, role, formatted (its part of the output), text_start and text_end within it, in_loss.

    A template that rewrites history fails the job. reach, window: as in Conversation; the reach of chatml is known.
    """
    reach = 0 if template is chatml else reach
    common.small_batches(conversations.sparkSession)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("in_loss", pa.bool_())])
        out: list[tuple] = []
        chars, current, now, position = 0, object(), Conversation(template, window, reach), 0
        for conv_id, _, role, text in _rows(it):
            if conv_id != current:
                now.close()
                current, now, position = conv_id, Conversation(template, window, reach), 0
            span, a, b = now.add(role, text)
            out.append((conv_id, position, role, span, a, b, role == "assistant"))
            position += 1
            chars += len(span)
            if len(out) >= 2000 or chars > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, chars = [], 0
        now.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return ordered(conversations).mapInArrow(work, "conv_id long, position long, role string, formatted string, text_start long, text_end long, in_loss boolean")


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from what render() gives."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current = None
        state: list = []

        def close() -> None:
            if state:
                out.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in it:
            for conv_id, span, a, e, in_loss in zip(*(common.column(b, n) for n in ("conv_id", "formatted", "text_start", "text_end", "in_loss")), strict=True):
                if not state or conv_id != current:
                    close()
                    current, state = conv_id, [0, sha256(), 0, sha256(), 0]
                role, text = read_back(span)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if in_loss:
                    learnt = unescape(span[a:e])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(span)
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return render(conversations).mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
