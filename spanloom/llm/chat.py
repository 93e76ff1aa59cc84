"""Chat formatting with a grammar round trip.

The grammar: a conversation is a run of turns; a turn is an opening mark, its text, a closing mark.

    user       ``[INST] `` text `` [/INST]``
    assistant  ``<s> `` text `` </s>``
    system     ``<<SYS>> `` text `` <</SYS>>``
    any other  ``[ROLE] `` name `` [/ROLE]`` then ``[TURN] `` text `` [/TURN]``

Control strings inside a text are escaped by a backslash after their first character, and one more
where backslashes stand there already, so the step back is unique. Each turn is rendered plainly first
and parsed; it is escaped only if what the parser recovers differs from the source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import table

#: The marks of the template.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
ROLE, TURN = ("[ROLE] ", " [/ROLE]"), ("[TURN] ", " [/TURN]")
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]")

_PLAIN = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(role: str, text: str) -> str:
    if role in MARKS:
        start, end = MARKS[role]
        return start + text + end
    return ROLE[0] + role + ROLE[1] + TURN[0] + text + TURN[1]


class Grammar(ValueError):
    """The text isn't a run of turns."""


class Reader:
    """Parses a conversation's formatted text, which may come cut anywhere: where turns begin and end is found from
    the marks alone. It holds the unfinished turn only."""

    OPENINGS = (*((m[0], r) for r, m in MARKS.items()), (ROLE[0], None))

    def __init__(self) -> None:
        self.rest, self.at, self.inside, self.sought = "", 0, None, 0
        self.role: str | None = None

    def feed(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, unescaped text, start and end of the escaped text, counted from the conversation's start) of each
        turn that ends in what has come so far."""
        rest, done = self.rest + text, 0  # done: characters of ``rest`` that are parsed
        try:
            while done < len(rest):
                if self.inside is None:
                    opening = self._opening(rest, done)
                    if opening is None:
                        return
                    done, self.sought = done + opening, 0
                end = rest.find(self.inside[1], done + self.sought)
                if end < 0:
                    self.sought = max(0, len(rest) - done - len(self.inside[1]) + 1)
                    return
                body, start = unescape(rest[done:end]), done
                done = end + len(self.inside[1])
                if self.inside is ROLE:
                    if body in MARKS:
                        raise Grammar(f"a named role {body!r} at {self.at + start}")
                    self.role, self.inside = body, None
                else:
                    yield self.role, body, self.at + start, self.at + end
                    self.role, self.inside = None, None
        finally:
            self.rest, self.at = rest[done:], self.at + done

    def _opening(self, rest: str, done: int) -> int | None:
        """Enters the turn that begins here and gives its mark's length; None if the mark isn't whole yet."""
        known = self.OPENINGS if self.role is None else ((TURN[0], self.role),)
        for mark, role in known:
            if rest.startswith(mark, done):
                self.role = role
                self.inside = TURN if mark == TURN[0] else ROLE if mark == ROLE[0] else MARKS[role]
                return len(mark)
        if any(mark.startswith(rest[done : done + len(mark)]) for mark, _ in known):
            return None
        raise Grammar(f"no turn at {self.at + done}")

    def close(self) -> None:
        """The text ends here; raises Grammar within a turn."""
        if self.rest or self.inside or self.role is not None:
            raise Grammar(f"the text ends within a turn, at {self.at}")


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """The turns of a whole text, as ``Reader.feed`` gives them."""
    reader = Reader()
    yield from reader.feed(text)
    reader.close()


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the bounds of its text, escaped where the round trip asks for it."""
    for change in (lambda x: x, escape):
        piece = render(role if role in MARKS else change(role), change(text))
        try:
            back = list(parse(piece))
        except Grammar:
            continue
        if [x[:2] for x in back] == [(role, text)]:
            return piece, back[0][2], back[0][3]
    raise Grammar(f"a turn of role {role!r} doesn't survive the round trip")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, piece, start, end): a row per turn; a conversation's formatted text is its
    pieces end to end, in the order of turn, then role, then piece.

    Null role and null text count as empty; any role beside user, assistant and system is kept by
    name. Null conv_id is a conversation of its own. Repeated rows and tied turns are turns of their
    own. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            made = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            columns = [*batch.columns[:3], pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.int64()), pa.array([x[2] for x in made], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "piece", "start", "end"])

    empty = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return rows.mapInArrow(run, "conv_id bigint, turn bigint, role string, piece string, start bigint, end bigint")


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the
    formatted text of each whole conversation: its pieces are fed to one reader, which finds the turns
    by the marks, wherever the pieces were cut. Conversations stream through sorted partitions, so a
    very long one takes no more memory than its longest turn and piece. Raises Grammar if a
    conversation isn't a run of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def close() -> None:
            if state:
                state["reader"].close()
                done.append((current, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([x[i] for x in done], k) for i, k in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or conv != current:
                    close()
                    current, state = conv, {"reader": Reader(), "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                state["chars"] += len(piece)
                for role, text, _, _ in state["reader"].feed(piece):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state["loss_chars"] += len(text)
                        state["loss"].update(text.encode())
            yield flush()
        close()
        yield flush()

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece").select("conv_id", "piece")
    return ordered.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: The conversation added to the table.
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"),
    )
    return read_back(format_conversations(turns.unionByName(extra)))
