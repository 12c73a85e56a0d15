"""Chat formatting with a template that is only ever called, never looked into.

Successive prefixes of a conversation are rendered and each output is compared with the one before. Where it
goes on from it, the new part is the turn's span; a template that changed what it had said before is
found out and reported, as no loss mask can be trusted then. A turn's own text is located
inside its span by rendering the turn again with two probe texts: what those have in common, in front and
behind, is the template's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Texts without control strings: no ``<|`` is left, and ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out.append(text[i:j])
        out.append(text[j + 1])
        i = j + 2
    return "".join(out) + text[i:]


def chat_template(turns: list[Turn]) -> str:
    return "".join(f"{_OPEN}{escape(role)}\n{escape(text)}{_CLOSE}\n" for role, text in turns)


def parse_chat(formatted: str) -> list[Turn]:
    """The turns of a text that ``chat_template`` made. A role holds no line break, else the turn's text begins after the first."""
    out = []
    for part in formatted.split(_OPEN)[1:]:
        role, _, text = part.partition("\n")
        out.append((unescape(role), unescape(text[: -len(_CLOSE) - 1])))
    return out


def common_prefix(a: str, b: str) -> int:
    n, lo = min(len(a), len(b)), 0
    if a[:n] == b[:n]:
        return n
    hi = n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


@dataclass
class Formatted:
    """text: the rendered conversation. spans: begin, end, and begin and end of the turn's own text. rewrites: turns at which the template changed its past."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[str, int, int, int, int]] = field(default_factory=list)
    rewrites: list[int] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def locate(render: Render, before: list[Turn], role: str, start: int, whole: str) -> tuple[int, int]:
    """Where the last turn's text lies in ``whole``, its rendering after ``before``."""
    a, b = render([*before, (role, "0")]), render([*before, (role, "1")])
    head = max(common_prefix(a, b), start)
    foot = common_prefix(a[::-1], b[::-1])
    end = len(whole) - min(foot, len(a) - head - 1)
    return min(head, len(whole)), max(min(head, len(whole)), end)


def format_turns(turns: Iterator[Turn], render: Render) -> Formatted:
    """Render a conversation turn by turn, every prefix in full, so that no change of the past goes unseen.
    The template is free to look at all turns, so the cost of a conversation grows with the square of its turns.
    """
    out, context, last = Formatted(), [], render([])
    out.parts.append(last)
    out.length = len(last)
    for i, (role, text) in enumerate(turns):
        now = render([*context, (role, text)])
        same = common_prefix(last, now)
        if same < len(last):
            # the past was changed: what stands is replaced, and the turn's span is what is new
            out.rewrites.append(i)
            out.parts, out.length = [now[:same]], same
        head, foot = locate(render, context, role, same, now)
        out.spans.append((role, same, len(now), head, foot))
        out.parts.append(now[same:])
        out.length = len(now)
        context.append((role, text))
        last = now
    return out


_OUT = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        ("spans", pa.list_(pa.struct([("role", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("text_begin", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))),
        ("rewrites", pa.list_(pa.int32())),
    ]
)
_OUT_SQL = "conv_id long, formatted string, spans array<struct<role string, begin long, end long, text_begin long, text_end long, loss boolean>>, rewrites array<int>"


def _format(render: Render, loss_roles: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

        done, size = [], 0
        source = rows()
        row = next(source, None)
        while row is not None:
            conv = row[0]

            def turns(conv=conv):
                nonlocal row
                while row is not None and row[0] == conv:
                    yield row[1], row[2]
                    row = next(source, None)

            f = format_turns(turns(), render)
            spans = [{"role": r, "begin": a, "end": b, "text_begin": c, "text_end": d, "loss": r in loss_roles and not f.rewrites} for r, a, b, c, d in f.spans]
            done.append({"conv_id": conv, "formatted": f.text, "spans": spans, "rewrites": f.rewrites})
            size += f.length
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(done, _OUT)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_pylist(done, _OUT)

    return run


def format_conversations(turns: DataFrame, render: Render = chat_template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> a row for each conversation: conv_id, formatted, spans, rewrites.

    spans, in turn order: role, begin and end of the turn in ``formatted``, begin and end of its text, and whether
    the loss counts there. rewrites: places of the turns at which the template changed what it had rendered
    before; such a conversation has no loss.

    Turns are ordered by number (null first), those of one number by role and text, and repeated rows are turns of
    their own. A null role or text is empty; a null conv_id is a conversation of its own. Other columns are not
    looked at. Rows stream through a task in order; it holds one conversation's output at a time.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format(render, frozenset(loss_roles)), _OUT_SQL)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        out = []
        for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            turns = parse_chat(text)
            every, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, said in turns:
                every.update(f"{role}\n{said}\n".encode())
            for s in spans:
                if s["loss"]:
                    said = unescape(text[s["text_begin"] : s["text_end"]])
                    loss.update(said.encode())
                    chars += len(said)
            out.append((conv, len(turns), every.hexdigest(), chars, loss.hexdigest(), len(text)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``format_conversations`` with ``chat_template``: turns, texts under the loss mask, lengths."""
    return formatted.select("conv_id", "formatted", "spans").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
