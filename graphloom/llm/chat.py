"""Chat formatting by incremental black-box rendering.

A template is only asked to render lists of turns.  Successive prefixes of a conversation are rendered and consecutive
outputs compared: what the next prefix adds is the turn's span, and an output that does not begin with the one before
shows a template that rewrites history.  Where a text lies within its span is found by rendering the prefix with two
other texts in its place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

Turn = tuple[str, str]


class MarkedTurns:
    """``### role: text</turn>`` and a line feed for each turn; a backslash before each character of a control string
    (and before a backslash) makes it plain text."""

    _control = re.compile(r"\\|###|</turn>|:")
    _text_control = re.compile(r"\\|###|</turn>")
    _escaped = re.compile(r"\\(.)", re.DOTALL)

    @staticmethod
    def _escape(found: re.Match) -> str:
        return "".join("\\" + c for c in found[0])

    def render(self, turns: list[Turn]) -> str:
        role = lambda r: self._control.sub(self._escape, r)
        return "".join(f"### {role(r)}: {self._text_control.sub(self._escape, t)}</turn>\n" for r, t in turns)

    def text(self, piece: str) -> str:
        return self._escaped.sub(r"\1", piece)

    def role(self, header: str) -> str:
        return self.text(header[len("### ") : -len(": ")])


@dataclass
class Span:
    start: int
    text_start: int
    text_end: int
    end: int


def _common(a: str, b: str, low: int = 0) -> int:
    """Length of the longest common prefix, known to be ``low`` at least."""
    high = min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _common_end(a: str, b: str) -> int:
    return _common(a[::-1], b[::-1])


def locate(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[Span], bool]:
    """The rendered conversation, where each turn and its text lie in it, and whether a later turn changed what an
    earlier prefix had rendered."""
    out = before = render([])
    spans, rewrites = [], False
    for k, (role, _) in enumerate(turns):
        out = render(turns[: k + 1])
        start = len(before) if out.startswith(before) else _common(before, out)
        rewrites |= start < len(before)
        spans.append(_inside(render, turns[:k], role, [], start, out))
        before = out
    if rewrites:  # spans of prefixes do not hold in the whole: look for each text there
        for k, (role, _) in enumerate(turns):
            spans[k] = _inside(render, turns[:k], role, turns[k + 1 :], 0, out)
        for k, span in enumerate(spans):
            span.start = spans[k - 1].end if k else 0
            span.end = spans[k + 1].text_start if k + 1 < len(spans) else len(out)
    return out, spans, rewrites


def _inside(render, head: list[Turn], role: str, tail: list[Turn], start: int, out: str) -> Span:
    a, b = (render([*head, (role, probe), *tail]) for probe in ("0", "1"))
    at = _common(a, b)
    return Span(start, at, len(out) - _common_end(a[at:], b[at:]), len(out))


_SPANS = "array<struct<start: long, text_start: long, text_end: long, end: long>>"


def formatted(turns: DataFrame, template=None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: (conv_id, formatted, spans, rewrites_history); offsets are in code points.

    Turns are ordered by number, then role and text (null numbers first), so ties and repeated rows have one order; null roles and texts count as empty.  Rows
    with a null conversation are one conversation.  An empty table gives no rows; other columns are not looked at.  A
    conversation is one string in the output and so one task's work; the work grows with the square of its turns.
    """
    template = template or MarkedTurns()
    turn = F.struct(F.col(turn_col).alias("n"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(batches):
        for batch in batches:
            text, spans, changed = [], [], []
            for conversation in batch.column(1):
                out, where, rewrites = locate(template.render, [(t["role"], t["text"]) for t in conversation.as_py()])
                text.append(out)
                spans.append([vars(s) for s in where])
                changed.append(rewrites)
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "text_start", "text_end", "end")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(spans, kind), pa.array(changed, pa.bool_())], names=["conv_id", "formatted", "spans", "rewrites_history"])

    conv = turns.schema[conv_col].dataType.simpleString()
    return in_arrow(grouped, run, f"conv_id {conv}, formatted string, spans {_SPANS}, rewrites_history boolean")


def read_back(chats: DataFrame, template=None, loss_role: str = "assistant") -> DataFrame:
    """Digests of what formatted() wrote, read from its text and spans only: (conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, rewrites_history).  The loss mask covers the texts of ``loss_role``."""
    template = template or MarkedTurns()

    def run(batches):
        for batch in batches:
            rows = []
            for out, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns, loss = hashlib.sha256(), []
                for s in spans:
                    role = template.role(out[s["start"] : s["text_start"]])
                    text = template.text(out[s["text_start"] : s["text_end"]])
                    turns.update(f"{role}\n{text}\n".encode())
                    if role == loss_role:
                        loss.append(text)
                masked = "".join(loss)
                rows.append((len(spans), turns.hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(out)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), batch.column(3)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"])

    conv = chats.schema["conv_id"].dataType.simpleString()
    return in_arrow(chats, run, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
