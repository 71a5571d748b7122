"""Chat formatting: final messages folded from an event log, rendered with a reversible template and a loss mask.

Events are dealt out by conversation and message and folded in the order of their
sequence numbers; the messages are then dealt out by conversation. Both steps
stream over sorted rows and hold one message at a time, so a conversation of any
length passes through a task without being collected.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_bytes, batch

EVENTS = "conv_id long, seq long, kind string, msg_id string, role string, text string"
OPEN, CLOSE = "<turn ", "</turn>"
HEAD = "### "
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_SPECIAL = re.compile(r"[\\<>#]")


def escape(text: str) -> str:
    """A backslash before each character that a control string begins or ends with, and before backslashes."""
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn, and where its escaped text starts and ends in it."""
    head = f"{OPEN}{escape(role)}>\n{HEAD}{escape(role)}: "
    body = escape(text)
    return f"{head}{body} {CLOSE}\n", len(head), len(head) + len(body)


_TURN = re.compile(r"<turn ((?:[^\\<>#]|\\.)*)>\n### ((?:[^\\<>#]|\\.)*): ((?:[^\\<>#]|\\.)*) </turn>\n", re.DOTALL)


def parse(formatted: str):
    """(role, text) of each turn of a formatted conversation, read back; ValueError if it isn't one."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        # the role stands twice: it tells where the text begins even if the role holds ": "
        if m is None:
            raise ValueError("not a formatted conversation")
        role = m[1]
        inner = formatted[m.end(1) + 2 + len(HEAD) : m.end() - len(CLOSE) - 2]
        if not inner.startswith(role + ": "):
            raise ValueError("a turn whose roles differ")
        yield unescape(role), unescape(inner[len(role) + 2 :])
        at = m.end()


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, seq, role, text): final messages, at the place of their first event.

    Kinds: ``message``, or an event without a msg_id, is a whole message of its own; ``start`` opens message
    ``msg_id``, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate``
    discards it and further deltas write it anew, ``delete`` removes it until a
    later event writes it again. Events of a message apply in the order of seq;
    ties go by kind, role and text. Null texts and roles are empty (a message's
    role is the last one given), null seqs come first, null kinds count as
    ``message``, an unknown kind raises.
    """
    e = events.select("conv_id", F.col("seq").cast("long").alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.col("msg_id").cast("string").alias("msg_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # a whole message is a log of one event, under a name that no other has
    whole = (F.col("kind") == "message") | F.col("msg_id").isNull()
    name = F.when(whole, F.concat(F.lit("0:"), F.monotonically_increasing_id().cast("string"))).otherwise(F.concat(F.lit("1:"), F.col("msg_id")))
    e = e.select("conv_id", name.alias("msg_id"), "seq", F.when(whole, "start").otherwise(F.col("kind")).alias("kind"), "role", "text")
    ddl = "conv_id long, seq long, role string, text string"

    def fold(batches):
        schema = arrow_schema(ddl)
        key, out = None, []
        state: list = []  # conv_id, first seq, role, parts, alive
        for b in batches:
            for conv, msg, seq, kind, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (conv, msg) != key:
                    if key is not None and state[4]:
                        out.append((state[0], state[1], state[2], "".join(state[3])))
                    key, state = (conv, msg), [conv, seq, "", [], True]
                state[2] = role or state[2]
                if kind in ("start", "delta"):
                    state[3].append(text)
                elif kind in ("edit", "regenerate"):
                    state[3] = [text]
                elif kind == "delete":
                    state[3] = []
                else:
                    raise ValueError(f"unknown event: {kind}")
                state[4] = kind != "delete"
                if len(out) >= 1000:
                    yield batch(schema, *zip(*out, strict=True))
                    out = []
        if key is not None and state[4]:
            out.append((state[0], state[1], state[2], "".join(state[3])))
        if out:
            yield batch(schema, *zip(*out, strict=True))

    order = F.expr("array_position(array('start','edit','regenerate','delta','delete'), kind)")
    return e.repartition("conv_id", "msg_id").sortWithinPartitions("conv_id", "msg_id", "seq", order, "role", "text").mapInArrow(fold, ddl)


def formatted(final: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end): a conversation's segments in the order of ``turn``, from 0, concatenate to its formatted text.

    loss_start and loss_end bound the part of the segment that is under the loss
    mask, in code points; they are null where nothing is.
    """
    ddl = "conv_id long, turn long, segment string, loss_start long, loss_end long"

    def run(batches):
        schema = arrow_schema(ddl)
        last, turn = (), 0
        for b in batches:
            out = []
            for conv, role, text in zip(b.column(0).to_pylist(), (as_bytes(b.column(2))), as_bytes(b.column(3)), strict=True):
                turn = turn + 1 if last == (conv,) else 0
                last = (conv,)
                role = role.decode()
                segment, start, end = render(role, text.decode())
                masked = role in learn
                out.append((conv, turn, segment, start if masked else None, end if masked else None))
            if out:
                yield batch(schema, *zip(*out, strict=True))

    rows = final.select("conv_id", "seq", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")
    return rows.mapInArrow(run, ddl)


def digests(segments: DataFrame) -> DataFrame:
    """Read formatted conversations back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Segments of a conversation stream through its digests in order; each is
    parsed from its formatted text, and the masked part cut from that by its
    bounds. A null conv_id is one conversation.
    """
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        schema = arrow_schema(ddl)
        last, state = (), None

        def close():
            return (last[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            out = []
            for conv, segment, start, end in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if last != (conv,):
                    if state:
                        out.append(close())
                    last, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(segment)
                if start is not None:
                    text = unescape(segment[start:end])
                    state[2] += len(text)
                    state[3].update(text.encode())
            if out:
                yield batch(schema, *zip(*out, strict=True))
        if state:
            yield batch(schema, *([x] for x in close()))

    rows = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return rows.mapInArrow(run, ddl)
