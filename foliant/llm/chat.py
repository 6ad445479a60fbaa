"""Chat formatting by a template that is a black box.

A template is a function from a list of (role, text) to one string. Rendering successive
prefixes of a conversation and comparing neighbouring outputs gives the span of each turn: what
the longer output adds. A template that changes what it wrote before is detected, and reported.

Every prefix is rendered in full, whatever the conversation's length. Only a template that declares
itself ``local`` (an attribute: what a turn adds depends on its neighbour only) is rendered after
the neighbour alone, and isn't trusted: its spans wait until the whole prefix is rendered, whenever
the length has doubled and at the end. If they don't join to that output, every prefix they come
from is rendered in full, and so are all later ones. So a conversation takes time in proportion to
its length under a local template, and to its square under others.

Rows are dealt by conversation, sorted by turn (ties by role, then text) and streamed through;
a worker holds one conversation.

Null texts count as empty and a null role as an empty one. Rows whose conv_id is null are one
conversation. Repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

OPEN, SAID, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
_escapes = {"~": "~0", "<|": "~1", "[INST]": "~2", "[/INST]": "~3", "</s>": "~4", "<s>": "~5", "<<SYS>>": "~6", "<</SYS>>": "~7"}
_controls = re.compile("|".join(map(re.escape, sorted(_escapes, key=len, reverse=True))))
_plain = {v: k for k, v in _escapes.items()}
_escaped = re.compile("~[0-7]")


def escape(text: str) -> str:
    """Write control strings in another way, so that none is left; ``unescape`` undoes it."""
    return _controls.sub(lambda m: _escapes[m[0]], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: _plain[m[0]], text)


def template(turns: Sequence[Turn]) -> str:
    """Each turn is ``<|turn|>role<|text|>text<|end|>`` and a line feed, with escaped role and text."""
    return "".join(f"{OPEN}{escape(r)}{SAID}{escape(t)}{CLOSE}" for r, t in turns)


template.local = True


class RewritesHistory(ValueError):
    """The template's output for a prefix isn't a prefix of its output for more turns."""


class _Prefixes:
    """Spans of one conversation, fed turn by turn; they come out once a whole prefix confirmed them."""

    def __init__(self, render: Template, where: str = "", whole: bool = False):
        self.render, self.where = render, where
        self.local = getattr(render, "local", False) and not whole
        self.turns: list[Turn] = []
        self.before = ""
        self.waiting: list[str | None] = []
        self.next = 2

    def add(self, turn: Turn) -> list[str]:
        self.turns.append(turn)
        n = len(self.turns)
        if n == 1 or not self.local:
            return [self._whole(n)]
        self.waiting.append(self._after_neighbour())
        return self.settle() if n >= self.next or self.waiting[-1] is None else []

    def settle(self) -> list[str]:
        """The spans that wait, compared with the rendering of all turns so far."""
        out, self.waiting = self.waiting, []
        if not out:
            return []
        now = None if out[-1] is None else self.render(self.turns)
        if now is not None and self._is_joined(now, out):
            self.before = now
        else:
            self.local = False
            n = len(self.turns)
            out = [self._whole(k) for k in range(n - len(out) + 1, n + 1)]
        self.next = 2 * len(self.turns)
        return out

    def _is_joined(self, now: str, added: list[str]) -> bool:
        at = len(self.before)
        if not now.startswith(self.before):
            return False
        for span in added:
            if not now.startswith(span, at):
                return False
            at += len(span)
        return at == len(now)

    def _whole(self, n: int) -> str:
        now = self.render(self.turns[:n])
        if not now.startswith(self.before):
            raise RewritesHistory(f"{self.where}turn {n - 1} changes what was written before")
        added, self.before = now[len(self.before) :], now
        return added

    def _after_neighbour(self) -> str | None:
        alone, both = self.render(self.turns[-2:-1]), self.render(self.turns[-2:])
        return both[len(alone) :] if both.startswith(alone) else None


def spans(turns: Sequence[Turn], render: Template = template, whole: bool = False) -> Iterator[str]:
    """What each turn adds to the output, found by rendering prefixes; ``whole``: all of them in full."""
    found = _Prefixes(render, whole=whole)
    for turn in turns:
        yield from found.add(turn)
    yield from found.settle()


def rewrites(turns: Sequence[Turn], render: Template) -> bool:
    """Whether a template rewrites history on these turns."""
    try:
        for _ in spans(turns, render, whole=True):
            pass
    except RewritesHistory:
        return True
    return False


def parse(span: str) -> Turn:
    """Role and text of a turn, read back from its span of the output."""
    role, _, text = span.removeprefix(OPEN).removesuffix(CLOSE).partition(SAID)
    return unescape(role), unescape(text)


def loss_mask(span: str, roles: Sequence[str] = ("assistant",)) -> tuple[int, int]:
    """Start and end of the text in a turn's span that the loss counts; equal for other roles."""
    start = span.index(SAID) + len(SAID)
    return (start, len(span) - len(CLOSE)) if unescape(span[len(OPEN) : start - len(SAID)]) in roles else (start, start)


class _Conversation:
    """Digests of one conversation, fed turn by turn."""

    def __init__(self, key, render: Template):
        self.key, self.found = key, _Prefixes(render, f"conversation {key}: ")
        self.n, self.n_loss, self.n_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, turn: Turn) -> list[str]:
        return self._read(self.found.add(turn))

    def end(self) -> list[str]:
        return self._read(self.found.settle())

    def _read(self, found: list[str]) -> list[str]:
        for added in found:
            role, text = parse(added)
            self.all.update(f"{role}\n{text}\n".encode())
            a, b = loss_mask(added)
            under = unescape(added[a:b])
            self.n_loss += len(under)
            self.loss.update(under.encode())
            self.n += 1
            self.n_chars += len(added)
        return found

    def row(self) -> dict:
        self.end()
        return {"conv_id": self.key, "n_turns": self.n, "turns_sha256": self.all.hexdigest(), "loss_chars": self.n_loss, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.n_chars}


_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


_SPANS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int32()), ("span", pa.string()), ("mask_start", pa.int32()), ("mask_end", pa.int32())])


def _by_conversation(rows: DataFrame) -> DataFrame:
    read = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")


def digests(rows: DataFrame, render: Template = template) -> DataFrame:
    """One row per conversation, read back from the output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(key, render)
                now.add((role, text))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, _OUT)
                done = []
        if now is not None:
            done.append(now.row())
        yield pa.RecordBatch.from_pylist(done, _OUT)

    return _by_conversation(rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(rows: DataFrame, render: Template = template) -> DataFrame:
    """conv_id, seq, span (what the turn adds to the output), mask_start and mask_end within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def put(found: list[str]) -> None:
            for seq, span in enumerate(found, now.n - len(found)):
                a, b = loss_mask(span)
                out.append({"conv_id": now.key, "seq": seq, "span": span, "mask_start": a, "mask_end": b})

        for batch in batches:
            for key, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        put(now.end())
                    now = _Conversation(key, render)
                put(now.add((role, text)))
            yield pa.RecordBatch.from_pylist(out, _SPANS)
            out.clear()
        if now is not None:
            put(now.end())
            yield pa.RecordBatch.from_pylist(out, _SPANS)

    return _by_conversation(rows).mapInArrow(run, "conv_id long, seq int, span string, mask_start int, mask_end int")
