r"""Conversations as training text with a loss mask, proven by a grammar round trip.

The grammar, deterministic with no look-ahead beyond a control string (text never holds one: see below)::

    conversation = turn*
    turn         = "<s>[INST] " text " [/INST]"           a user's turn
                 | "[OUT] " text " </s>"                  an assistant's turn; the text is under the loss mask
                 | "[ROLE] " role " [/ROLE] " text " [/TURN]"   any other role

A turn is rendered with its text as it is, parsed again, and compared with its source.  What does not come back identical is in conflict with
the grammar - it holds a control string, or what reads like an escaped one - and is escaped until it does: a backslash goes behind the first
character of each control string (one more where there are some already), and the parser takes one away.  Control strings begin with < or [ and hold
neither further on, and they hold no blank while every seam has one, so neither overlaps nor seams can make or hide one: the second attempt always comes back.

A turn is a row.  What was formatted is read back as one stream of characters per conversation, in order, holding no more than one turn at a time.

Turns come in order of their number, null first; equal numbers by role, then text.  Null roles and texts are empty, an empty role is a role of its own.
Rows with a null key are one conversation with a null key.  Repeated rows are turns of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows

#: The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[/ROLE]", "[/TURN]")
_ESCAPABLE = re.compile("|".join(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]) for c in CONTROLS))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\(\\*)" + re.escape(c[1:]) for c in CONTROLS))
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_LONGEST = max(map(len, CONTROLS)) + 2


class Unreadable(ValueError):
    """Text that the grammar does not produce."""


def escape(text: str) -> str:
    return _ESCAPABLE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _frame(role: str, escaped: bool) -> tuple[str, str]:
    """What stands before and behind a text."""
    if role == "user":
        return "<s>[INST] ", " [/INST]"
    if role == "assistant":
        return "[OUT] ", " </s>"
    return f"[ROLE] {escape(role) if escaped else role} [/ROLE] ", " [/TURN]"


class Parser:
    """Reads turns from a stream of characters: ``feed`` returns (role, text, where its mask starts or -1, mask length) of each turn that has ended."""

    #: What a turn may begin with: its role and the control string that ends it.
    OPENERS = {"<s>[INST] ": ("user", "[/INST]"), "[OUT] ": ("assistant", "</s>"), "[ROLE] ": (None, "[/TURN]")}

    def __init__(self) -> None:
        self.held, self.base, self.seen = "", 0, 0
        self.state, self.role, self.closer = "opener", None, ""

    def _skip(self, n: int) -> None:
        self.held, self.base, self.seen = self.held[n:], self.base + n, 0

    def _to(self, closer: str) -> str | None:
        """The characters up to the next control string, which has to be ``closer`` behind a blank; None where it has not come yet."""
        found = _CONTROL.search(self.held, self.seen)
        if found is None:
            self.seen = max(self.seen, len(self.held) - _LONGEST)
            return None
        if found[0] != closer or found.start() == 0 or self.held[found.start() - 1] != " ":
            raise Unreadable(f"{found[0]} at {self.base + found.start()}, not {closer}")
        part = self.held[:found.start() - 1]
        self._skip(found.end())
        return part

    def feed(self, part: str) -> Iterator[tuple[str, str, int, int]]:
        self.held += part
        while True:
            if self.state == "opener":
                opener = next((o for o in self.OPENERS if self.held.startswith(o)), None)
                if opener is None:
                    if any(o.startswith(self.held) for o in self.OPENERS):
                        return
                    raise Unreadable(f"no turn begins at {self.base}: {self.held[:20]!r}")
                self._skip(len(opener))
                self.role, self.closer = self.OPENERS[opener]
                self.state = "name" if self.role is None else "text"
            if self.state == "name":
                name = self._to("[/ROLE]")
                if name is None:
                    return
                self.role, self.state = unescape(name), "blank"
            if self.state == "blank":
                if not self.held:
                    return
                if self.held[0] != " ":
                    raise Unreadable(f"no blank behind a role at {self.base}")
                self._skip(1)
                self.state = "text"
            at = self.base
            raw = self._to(self.closer)
            if raw is None:
                return
            self.state = "opener"
            yield self.role, unescape(raw), at if self.closer == "</s>" else -1, len(raw)

    def end(self) -> None:
        if self.held or self.state != "opener":
            raise Unreadable(f"the text ends inside a turn at {self.base}")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of a whole text; raises Unreadable where the grammar does not produce it."""
    parser = Parser()
    turns = list(parser.feed(text))
    parser.end()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's text, and start and length of its part under the loss mask (-1, 0 without); escaped if it would not come back otherwise."""
    for escaped in (False, True):
        before, behind = _frame(role, escaped)
        body = escape(text) if escaped else text
        whole = before + body + behind
        try:
            back = [t[:2] for t in parse(whole)]
        except Unreadable:
            continue
        if back == [(role, text)]:
            return (whole, len(before), len(body)) if role == "assistant" else (whole, -1, 0)
    raise Unreadable(f"a turn of {role[:40]!r} does not come back")


def format_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, turn, role, text, piece (its part of the conversation's text), mask_start and mask_length within the piece (code points; -1, 0 without), one row a turn."""
    kind = turns.schema
    rows = turns.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def work(items):
        for k, t, r, x in items:
            yield k, t, r, x, *render(r, x)

    return map_rows(rows, f"key {kind[key].dataType.simpleString()}, turn {kind[turn].dataType.simpleString()}, role string, text string, piece string, "
                          "mask_start long, mask_length long", work)


def conversation_texts(pieces: DataFrame) -> DataFrame:
    """key, text, masks (array of start, length over the whole text): conversations gathered into one row each, for those that fit one."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "piece", "mask_start", "mask_length")))
    whole = pieces.groupBy("key").agg(ordered.alias("t"))
    ends = F.aggregate("t", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("masks")),
                       lambda acc, p: F.struct((acc["at"] + F.length(p["piece"])).alias("at"),
                                               F.when(p["mask_start"] >= 0, F.concat(acc["masks"], F.array(F.struct(
                                                   (acc["at"] + p["mask_start"]).alias("start"), p["mask_length"].alias("length"))))).otherwise(acc["masks"]).alias("masks")))
    return whole.select("key", F.concat_ws("", F.transform("t", lambda p: p["piece"])).alias("text"), ends["masks"].alias("masks"))


def read_back(pieces: DataFrame, also: list[str] | None = None) -> DataFrame:
    """What a parser of the formatted text finds, per conversation: key, <also>, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Only ``piece`` is read, as one stream; key, ``also``, turn, role and text order it.  A digest of a whole conversation takes one task, which holds one
    turn at a time.
    """
    keys = ["key", *(also or [])]
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def work(items):
        last, done = None, None
        for *key, piece in items:
            if key != last:
                if done is not None:
                    yield *last, *done.result()
                last, done = key, _Reader()
            done.take(piece)
        if done is not None:
            yield *last, *done.result()

    ordered = (pieces.repartition(*keys).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys], F.asc_nulls_first("turn"), "role", "text").select(*keys, "piece"))
    return map_rows(ordered, schema, work)


class _Reader:
    def __init__(self) -> None:
        self.parser, self.turns, self.loss = Parser(), hashlib.sha256(), hashlib.sha256()
        self.n, self.chars, self.masked = 0, 0, 0

    def take(self, piece: str) -> None:
        self.chars += len(piece)
        for role, text, mask, _ in self.parser.feed(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if mask >= 0:
                self.masked += len(text)
                self.loss.update(text.encode())

    def result(self) -> tuple[int, str, int, str, int]:
        self.parser.end()
        return self.n, self.turns.hexdigest(), self.masked, self.loss.hexdigest(), self.chars


#: A conversation whose texts are control strings themselves.
HOSTILE = "</s>[INST] ok [/INST]"


def round_trip(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Format all conversations and the hostile one under the key -1, and read everything back.

    The hostile conversation stays one of its own where the table has that key too.
    """
    own = turns.select(key, turn, role, text)
    added = turns.sparkSession.createDataFrame([(-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)], "k long, t long, r string, x string")
    kind = own.schema
    added = added.select(F.col("k").cast(kind[key].dataType).alias(key), F.col("t").cast(kind[turn].dataType).alias(turn), F.col("r").alias(role), F.col("x").alias(text))
    pieces = [format_turns(t, key, turn, role, text).withColumn("added", F.lit(a)) for t, a in ((own, False), (added, True))]
    return read_back(pieces[0].unionByName(pieces[1]), ["added"]).drop("added").withColumnRenamed("key", key)
