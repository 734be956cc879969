"""Chat formatting by rendering turn prefixes through a template that is treated as a black box.

For each conversation the renderer is called on successive prefixes of its turns; the part by which one output exceeds
the one before is the span of the new turn. An output that doesn't begin with the one before shows a template that
rewrites history. Rendering every prefix from the first turn would cost the square of the turns, so after `context`
turns the prefix begins anew a few turns back, behind the system turns that open the conversation, if the last turn's
span comes out the same from both beginnings. If it doesn't, the whole conversation is rendered: if it still is what the spans
add up to, the template only depends on all turns, as one that numbers them does, and whole prefixes are rendered from
there on (at a cost of the square of the turns); otherwise it rewrites history. So that no rewriting further back goes unseen,
the whole conversation is rendered as well whenever its turns have doubled and at its end, and has to be what the spans add
up to: linear time in all. Such rewriting is reported at the turn where the whole was rendered; what a template changes and
restores between two of these lengths is not seen.

Turns stream through in (conversation, turn) order: memory holds one conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

#: The control strings of the template below.
BOS, EOS, INST, END_INST, ROLE, END_HEAD, END_ROLE = "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/HEAD]", "[/ROLE]"
CONTROL = re.compile("|".join(map(re.escape, (BOS, EOS, INST, END_INST, ROLE, END_HEAD, END_ROLE))))
_TO_ESCAPE = re.compile(r"\\|" + CONTROL.pattern)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LOSS_ROLE = "assistant"
PIECES = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("piece", pa.string()), ("start", pa.int64()), ("loss_start", pa.int64()), ("loss_len", pa.int64()), ("rewrites", pa.bool_())])
PIECES_DDL = "conv_id long, seq long, piece string, start long, loss_start long, loss_len long, rewrites boolean"
Message = tuple[str, str]


def escape(text: str) -> str:
    """text without any control string: a backslash is doubled, a control string gets `\\.` after its first character."""
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\.{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def render_inst(messages: list[Message]) -> str:
    """The template: user and assistant turns in instruction brackets, any other role with a head of its own."""
    out = []
    for role, text in messages:
        if role == "user":
            out.append(f"{BOS}{INST} {escape(text)} {END_INST}")
        elif role == LOSS_ROLE:
            out.append(f" {escape(text)}{EOS}")
        else:
            out.append(f"{ROLE}{escape(role)}{END_HEAD}{escape(text)}{END_ROLE}")
    return "".join(out)


def parse_inst(piece: str) -> list[tuple[str, str, int, int]]:
    """The turns in formatted text: role, text, and where the still escaped text starts and ends."""
    out, at = [], 0
    while at < len(piece):
        if piece.startswith(BOS + INST + " ", at):
            a = at + len(BOS + INST) + 1
            b = piece.index(END_INST, a)
            out.append(("user", unescape(piece[a : b - 1]), a, b - 1))
            at = b + len(END_INST)
        elif piece.startswith(ROLE, at):
            h = piece.index(END_HEAD, at)
            a = h + len(END_HEAD)
            b = piece.index(END_ROLE, a)
            out.append((unescape(piece[at + len(ROLE) : h]), unescape(piece[a:b]), a, b))
            at = b + len(END_ROLE)
        elif piece.startswith(" ", at):
            b = piece.index(EOS, at)
            out.append((LOSS_ROLE, unescape(piece[at + 1 : b]), at + 1, b))
            at = b + len(EOS)
        else:
            raise ValueError(f"no turn begins at {at}")
    return out


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass")).digest()


def spans(messages: Iterator[Message], render: Callable[[list[Message]], str], context: int = 16) -> Iterator[tuple[str, bool]]:
    """The text that each turn adds to the output, and whether the template rewrote what it had put out before."""
    turns = iter(messages)
    every: list[Message] = []
    lead: list[Message] = []  # up to `context` system turns ahead of all others; restarted prefixes keep them
    held: list[Message] = []  # turns after those, since the last beginning
    before = render([])
    anchored = before  # what stands ahead of the first turn belongs to its span
    first, far, whole, rewrote = True, False, True, False
    restart: float = 2 * context
    check = 2 * context
    said = hashlib.blake2b()
    message = next(turns, None)
    while message is not None:
        following = next(turns, None)
        if len(held) >= restart:
            # Begin anew about `context` turns back, at a turn of the first one's role if there is one: the last turn's span must
            # not depend on where the prefix begins. A template that refuses the shorter prefix goes on with the longer one.
            cut = next((k for k in range(len(held) - context, 0, -1) if held[k][0] == held[0][0]), len(held) - context)
            last_before, short = render(lead + held[:-1]), held[cut:]
            try:
                a, b = render(lead + short[:-1]), render(lead + short)
            except Exception:
                restart = len(held) + context
            else:
                same = before.startswith(last_before) and b.startswith(a) and before[len(last_before) :] == b[len(a) :]
                if same or rewrote:
                    far, held, before, whole, restart = not same, short, b, False, max(2 * context, len(short) + context)
                elif _digest(full := render(every)) == said.digest():
                    lead, held, before, whole, restart = [], list(every), full, True, math.inf
                else:
                    far = True
        (held if held or message[0] != "system" or len(lead) >= context else lead).append(message)
        if not rewrote:
            every.append(message)
        now = render(lead + held)
        grown = now.startswith(before)
        piece = now[len(before) :] if grown else now
        piece = anchored + piece if first and grown else piece
        rewrites = far or not grown
        if not rewrote:
            said.update(piece.encode("utf-8", "surrogatepass"))
            # Held against the whole output at doubling lengths and at the end, which costs a constant number of turns each.
            if not rewrites and not whole and (following is None or len(every) >= check):
                full = render(every)
                if _digest(full) != said.digest():
                    piece, rewrites = full, True
            if len(every) >= check:
                check *= 2
            if rewrites:
                rewrote = True
                every.clear()
        yield piece, rewrites
        before, first, far = now, False, False
        message = following


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", render: Callable[[list[Message]], str] = render_inst, parse: Callable[[str], list[tuple[str, str, int, int]]] = parse_inst, context: int = 16) -> DataFrame:
    """Formatted conversations, a row per turn: conv_id, seq (from 0), piece (what the turn adds; the pieces in order are
    the formatted conversation), start (code points ahead of it), loss_start and loss_len (the still escaped text under
    the loss mask, within the piece; null outside assistant turns), rewrites (the template changed earlier output; then the
    piece may be the whole new output).

    Null role or text: empty. A null conversation is one conversation; a null turn comes first; equal turns are ordered by
    role and text, so repeated rows are turns like any other. Other columns are ignored. Rows come out sorted by (conv_id,
    seq) within partitions that hold whole conversations.
    """
    src = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col), F.lit("")).alias("r"), F.coalesce(F.col(text_col), F.lit("")).alias("x"))
    src = src.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = ((c, r, x) for b in batches for c, r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))

        def rows() -> Iterator[tuple]:
            ahead = next(flat, None)
            while ahead is not None:
                conv = ahead[0]

                def own() -> Iterator[Message]:
                    nonlocal ahead
                    while ahead is not None and ahead[0] == conv:
                        message = ahead[1:]
                        ahead = next(flat, None)
                        yield message

                seq = start = 0
                for piece, rewrites in spans(own(), render, context):
                    loss = None if rewrites else next((s for s in parse(piece) if s[0] == LOSS_ROLE), None)
                    yield conv, seq, piece, start, loss and loss[2], loss and loss[3] - loss[2], rewrites
                    seq, start = seq + 1, start + len(piece)

        return batched(rows(), PIECES)

    return src.mapInArrow(run, PIECES_DDL)


def read_back(formatted: DataFrame, parse: Callable[[str], list[tuple[str, str, int, int]]] = parse_inst) -> DataFrame:
    """What the formatted conversations say, a row per conversation: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. Takes the rows of format_chats in the order and partitions in which they come."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, n = None, -1
            turns = loss = None
            loss_chars = chars = 0
            for b in batches:
                for c, seq, piece, at, size, rewrites in zip(*(b.column(k).to_pylist() for k in ("conv_id", "seq", "piece", "loss_start", "loss_len", "rewrites")), strict=True):
                    if rewrites:
                        raise ValueError(f"the template rewrites history in conversation {c}; its turns have no spans")
                    if seq == 0:
                        if n >= 0:
                            yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
                        conv, n, turns, loss, loss_chars, chars = c, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                    for role, text, _, _ in parse(piece):
                        n += 1
                        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if at is not None:
                        said = unescape(piece[at : at + size])
                        loss_chars += len(said)
                        loss.update(said.encode("utf-8", "surrogatepass"))
                    chars += len(piece)
            if n >= 0:
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        return batched(rows(), schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
