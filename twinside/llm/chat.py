"""Operator 9: chat formatting by a grammar round trip.

The rendered text of a turn is parsed again by a deterministic parser; while
the recovered turn differs from the source, its content is escaped further.

Grammar: a conversation is a row of turns, a turn is
``<|im_start|>`` header ``\\n`` body ``<|im_end|>\\n``; header and body hold no
control string, the header no line break. Turns delimit themselves, so a
conversation parses to its turns exactly if each rendered turn parses to one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from twinside.llm.common import map_partition
from twinside.session import settle

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
CONTROL = re.compile(r"<\|(?=im_start\|>|im_end\|>|nl\|>)")
#: An opening of a control string with any number of escape marks; each level of nesting has one more.
OPENING = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
#: Chunks of a conversation are closed after so many characters, at the end of a turn.
CHUNK_CHARS = 1_000_000
LOSS_ROLE = "assistant"


def escape(text: str, level: int) -> str:
    """Level 0 leaves the text, level 1 marks control strings, level 2 every opening."""
    if level == 0:
        return text
    return CONTROL.sub(r"<\\|", text) if level == 1 else OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text) if "<\\" in text else text


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """Turns as (role, text, body start, body end); None if the text is not in the grammar."""
    turns, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        end = text.find(END + "\n", line + 1) if line >= 0 else -1
        if end < 0 or not text.startswith(START, at):
            return None
        head, body = text[at + len(START) : line], text[line + 1 : end]
        if START in body or END in body or START in head or END in head:
            return None
        turns.append((unescape(head.replace(BREAK, "\n")), unescape(body), line + 1, end))
        at = end + len(END) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn that parses to exactly this role and text, and where its body begins and ends."""
    for head_level in range(3):
        for level in range(3):
            head = escape(role, head_level).replace("\n", BREAK)
            out = f"{START}{head}\n{escape(text, level)}{END}\n"
            got = parse(out)
            if got and len(got) == 1 and got[0][:2] == (role, text):
                return out, got[0][2], got[0][3]
            if got and len(got) == 1 and got[0][0] != role:
                break
    raise ValueError("a turn does not survive its own grammar")


def chunks(rows: Iterator[tuple], chunk_chars: int) -> Iterator[tuple]:
    """Formatted chunks of a sorted partition: (conv_id, part, whole, text, loss spans).

    ``part`` orders the chunks of a conversation. ``whole`` says that the chunk
    is all of its conversation: the first and last conversation of a partition
    may go on in its neighbours.
    """
    base, seq = TaskContext.get().partitionId() << 32, 0
    conv, first, parts, size, spans, cut = None, True, [], 0, [], False
    begun = False

    def chunk(whole):
        return conv, base | seq, whole, "".join(parts), spans

    for key, _, role, text in rows:
        if begun and key != conv:
            yield chunk(not first and not cut)
            seq += 1
            first, parts, size, spans, cut = False, [], 0, [], False
        elif begun and size >= chunk_chars:
            yield chunk(False)
            seq += 1
            parts, size, spans, cut = [], 0, [], True
        begun, conv = True, key
        out, a, b = render(role or "", text or "")
        if (role or "") == LOSS_ROLE:
            spans += [size + a, size + b]
        parts.append(out)
        size += len(out)
    if begun:
        yield chunk(False)


def format_conversations(turns: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Formatted chunks of ``(conv_id, turn, role, text)`` rows: conv_id, part, whole, text, loss_spans.

    Turns come in the order of turn, role and text, nulls first; null roles and
    texts count as empty; a null conv_id is a conversation of its own; repeated
    rows are repeated turns; an empty table gives no rows. Rows are dealt by
    ranges of (conv_id, turn, role), so the turns of one long conversation go
    to many tasks, and a task holds one chunk at a time.
    """
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_partition(rows, partial(chunks, chunk_chars=chunk_chars), "conv_id bigint, part bigint, whole boolean, text string, loss_spans array<bigint>")


def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row per conversation from its chunks in order, holding one chunk at a time."""
    conv, state = None, None

    def told():
        n, turns, loss_chars, loss, formatted = state
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted

    for key, _, text, spans in rows:
        if state and key != conv:
            yield told()
            state = None
        if not state:
            conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        for role, body, _, _ in parse(text):
            state[0] += 1
            state[1].update(f"{role}\n{body}\n".encode())
        for a, b in zip(spans[::2], spans[1::2]):
            masked = unescape(text[a:b])
            state[2] += len(masked)
            state[3].update(masked.encode())
        state[4] += len(text)
    if state:
        yield told()


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_digests(formatted: DataFrame) -> DataFrame:
    """Digests of the conversations read back from formatted chunks.

    Conversations of one chunk need no shuffle. The others meet by conv_id; a
    digest takes its bytes in order, so each of them is streamed by one task,
    which holds one chunk at a time.
    """
    columns = ("conv_id", "part", "text", "loss_spans")
    alone = map_partition(formatted.filter("whole").select(*columns), digests, DIGEST)
    split = formatted.filter("NOT whole").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return alone.unionByName(map_partition(split, digests, DIGEST))


def write_formatted(turns: DataFrame, label: str = "chat", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The formatted chunks, written to the shared folder and read back."""
    return settle(format_conversations(turns, chunk_chars), label)
