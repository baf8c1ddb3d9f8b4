"""Operator 1: chat formatting with turn spans found by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` turns to a string; nothing is known of its
inside. Successive prefixes of a conversation are rendered. Where a longer prefix's output starts with
the shorter one's, the new turn's span is what was added; where it does not, the template rewrites
history, which is reported. Two probe renderings that differ only in the new turn's text locate the
text inside the span, so a loss mask over assistant texts needs no knowledge of the template either.

Turns are ordered by turn number, then role, then text; null turn numbers come first; null roles and
texts are empty. Repeated rows are turns of their own. A conversation without rows does not exist; an
empty table gives no rows. A conversation's prefixes cost the square of its number of turns. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]

START, STOP = "<|im_start|>", "<|im_end|>"
#: Strings that some template gives a meaning; none may appear unescaped inside a text.
CONTROL = (START, STOP, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.?)", re.DOTALL)


@lru_cache(maxsize=4096)
def escape(text: str) -> str:
    """Double every backslash, then break each control string by one after its first character."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """A role ends at the first line break that no backslash precedes."""
    return escape(role).replace("\n", "\\\n")


def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The built-in template: start mark and role on one line, then the text and the stop mark. Different turns give different outputs."""
    return "".join(f"{START}{escape_role(r)}\n{escape(t)}{STOP}\n" for r, t in turns)


def _common(a: str, b: str, least: int = 0) -> int:
    """Length of the common beginning, by bisection over slices; ``least`` is known to be common."""
    low, high = least, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def locate(template: Template, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """Output, per turn ``(start, stop, text_start, text_stop)`` in it, and the first rewriting turn."""
    before, spans, rewritten = template([]), [], None
    for k in range(1, len(turns) + 1):
        after = template(turns[:k])
        same = len(before) if after.startswith(before) else _common(before, after)
        if same < len(before):
            rewritten = k if rewritten is None else rewritten
        zero, one = (template([*turns[: k - 1], (turns[k - 1][0], p)]) for p in ("0", "1"))
        head = _common(zero, one, same if zero.startswith(after[:same]) and one.startswith(after[:same]) else 0)
        tail = _common(zero[head:][::-1], one[head:][::-1])
        spans.append((same, len(after), min(head, len(after)), max(head, len(after) - tail)))
        before = after
    return before, spans, rewritten


def format_conversations(
    rows: DataFrame, template: Template = marked_turns, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, formatted, spans, rewritten_at)`` per conversation.

    ``spans``: array of struct(start, stop, text_start, text_stop, loss) in code points; ``loss`` is
    true for assistant turns. For a template that rewrites history (``rewritten_at`` is the first such
    turn, else null) the spans of earlier turns refer to their own prefix's output.
    """
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))))
    grouped = rows.groupBy(conv).agg(turns.alias("_turns"))
    narrow = grouped.select(conv, F.col("_turns.r").alias("r"), F.col("_turns.t").alias("t"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.struct([(n, pa.int64()) for n in ("start", "stop", "text_start", "text_stop")] + [("loss", pa.bool_())])
        for batch in batches:
            out, found, rewritten = [], [], []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                formatted, spans, at = locate(template, list(zip(roles, texts)))
                out.append(formatted)
                found.append([{"start": a, "stop": b, "text_start": c, "text_stop": d, "loss": r == "assistant"} for (a, b, c, d), r in zip(spans, roles)])
                rewritten.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(found, pa.list_(span)), pa.array(rewritten, pa.int32())],
                names=[conv, "formatted", "spans", "rewritten_at"],
            )

    kind = rows.schema[conv].dataType.simpleString()
    return narrow.mapInArrow(
        run,
        f"`{conv}` {kind}, formatted string, spans array<struct<start:bigint,stop:bigint,text_start:bigint,text_stop:bigint,loss:boolean>>, rewritten_at int",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``: array of struct(role, text, loss), read from the output of the built-in template."""
    plain = r"regexp_replace({}, r'(?s)\\(.?)', '$1')"
    role = plain.format(f"substr(formatted, cast(s.start + {len(START)} + 1 AS int), cast(s.text_start - s.start - {len(START)} - 1 AS int))")
    text = plain.format("substr(formatted, cast(s.text_start + 1 AS int), cast(s.text_stop - s.text_start AS int))")
    return formatted.withColumn("turns", F.expr(f"transform(spans, s -> named_struct('role', {role}, 'text', {text}, 'loss', s.loss))"))
