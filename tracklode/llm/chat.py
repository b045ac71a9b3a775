"""Operator 7: chat formatting with a hidden Markov model.

The hidden states are the speaker roles; what is seen of a turn are a speaker
marker on its first line, its length, its number of lines and how it ends.
Start, transition and feature probabilities come from a bounded sample of
labelled turns (``SAMPLE`` rows by a hash) or, where nothing is labelled, from
``DEFAULTS``.  A row may hold a whole transcript: a line with a marker
opens a turn, and every turn becomes a row of its own, numbered by ``piece``.
Viterbi recovers the roles of each conversation, and each turn is rendered as
``<|role|>``, its text, and ``<|end|>``.  A marker is left out where it names
the recovered role and stays as text where it does not.  Literals of these
marks in a text get a backslash, so that a turn cannot forge another.

Turns are put in order by a range partitioning on (conversation, turn, hash
of the text), so a conversation that holds a third of all rows lies in many
tasks.  One that lies within a task is decoded there.  One that is cut is
decoded exactly all the same: each piece gives the best score between every
pair of its border states, a grouped pass over the pieces fixes the states at
the cuts, and each piece is then decoded between them.

Texts of any length are read whole, line by line.  Null text counts as empty and is one empty turn; a null turn comes first and a null conversation is
one conversation of its own.  Equal scores go to the role listed first.
Repeated rows are turns like others.  An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, arrow_schema, id_field, materialize, small_batches, struct

ROLES = ("system", "user", "assistant")
SAMPLE = 50_000
#: Speaker markers by role; fixed values.
MARKERS = {"system": ("system", "context", "instruction", "instructions"), "user": ("user", "human", "customer", "question", "q"), "assistant": ("assistant", "ai", "bot", "agent", "answer", "a")}
_marker = re.compile(r"[ \t]*(?:#{1,6}[ \t]*|<\|)?(" + "|".join(w for ws in MARKERS.values() for w in ws) + r")[ \t]*(?:\|>|:)[ \t]*\n?", re.I)
_role_of = {w: r for r, ws in enumerate(MARKERS.values()) for w in ws}

#: Sizes of the features: marker (none or a role), length, lines, end.
SIZES = (4, 8, 5, 3)


def features(text: str | None) -> tuple[int, int, int, int]:
    text = text or ""
    m = _marker.match(text)
    end = text.rstrip()[-1:]
    return (
        1 + _role_of[m[1].lower()] if m else 0,
        min(7, max(0, len(text).bit_length() - 4)),
        min(4, text.count("\n")),
        1 if end in ("?", "？") and end else 2 if end in (".", "!", "。", "！") and end else 0,
    )


def split_turns(text: str | None) -> list[str]:
    """The turns of a text: every line with a marker opens one; unmarked leading lines are a turn too."""
    turns: list[list[str]] = []
    for line in (text or "").split("\n"):
        if turns and not _marker.match(line + "\n"):
            turns[-1].append(line)
        else:
            turns.append([line])
    return ["\n".join(t) for t in turns]


def strip_marker(role: str, text: str | None) -> str:
    """The text without its marker, if that names the role."""
    text = text or ""
    m = _marker.match(text)
    return text[m.end() :] if m and ROLES[_role_of[m[1].lower()]] == role else text


#: Literals of the marks of a rendering, also those that have been escaped before.
_mark = re.compile(r"<(?=\\*\|(?:" + "|".join(ROLES) + r"|end)\|>)")


def render(role: str, text: str | None) -> str:
    body = _mark.sub(r"<\\", strip_marker(role, text))
    return f"<|{role}|>\n{body}\n<|end|>"


#: Counts in which a marker speaks for its role, and turns alternate after a system turn.
DEFAULTS = {
    "start": np.array([4.0, 8.0, 1.0]),
    "step": np.array([[0.2, 8.0, 1.0], [0.1, 1.0, 8.0], [0.1, 8.0, 1.0]]),
    "seen": [np.array([[9.0, 30.0 * (r == 0), 30.0 * (r == 1), 30.0 * (r == 2)] for r in range(3)]), np.zeros((3, 8)), np.zeros((3, 5)), np.zeros((3, 3))],
}


class Model:
    """Log-probabilities of starts, transitions and features."""

    def __init__(self, start=None, step=None, seen=None):
        log = lambda x: np.log((x + 0.5) / (x + 0.5).sum(-1, keepdims=True))
        self.start = log(DEFAULTS["start"] if start is None else start)
        self.step = log(DEFAULTS["step"] if step is None else step)
        self.seen = [log(x + y) for x, y in zip(DEFAULTS["seen"], seen or DEFAULTS["seen"], strict=True)]

    def emit(self, text: str | None) -> np.ndarray:
        return sum(t[:, k] for t, k in zip(self.seen, features(text), strict=True))


def viterbi(first: np.ndarray, step: np.ndarray, emit: np.ndarray, last: np.ndarray | None = None) -> list[int]:
    """Best states of a run of turns; ``first`` and ``last`` score its first and last state."""
    n = len(emit)
    back = np.zeros((n, len(step)), np.int64)
    score = first + emit[0]
    for i in range(1, n):
        each = score[:, None] + step
        back[i] = each.argmax(0)
        score = each.max(0) + emit[i]
    state = int((score if last is None else score + last).argmax())
    states = [state]
    for i in range(n - 1, 0, -1):
        state = int(back[i, state])
        states.append(state)
    return states[::-1]


def between(step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Best score of a piece for each pair of first and last state."""
    score = np.where(np.eye(len(step)) > 0, emit[0][None, :], -np.inf)
    for e in emit[1:]:
        score = (score[:, :, None] + step[None]).max(1) + e
    return score


def fit(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, sample: int = SAMPLE) -> Model:
    """Counts over about ``sample`` labelled turns; the turn before each is looked up by number."""
    labelled = turns.filter(F.col(role_col).isin(*ROLES)).select(F.col(conv_col).alias("c"), F.col(turn_col).cast("bigint").alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("__text"))
    total = labelled.count()
    if not total:
        return Model()
    share = int(min(1.0, sample / total) * (1 << 40))
    few = labelled.filter(F.pmod(F.xxhash64("c", "t", "__text"), F.lit(1 << 40)) < share)
    schema = struct(("c", "string"), ("t", "bigint"), ("r", "string"), ("f", "array<int>"))
    out = arrow_schema(schema)

    def run(batches):
        for b in batches:
            f = [features(x) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(f, out[3].type)], schema=out)

    small_batches(turns.sparkSession)
    few = materialize(few.select(F.col("c").cast("string").alias("c"), "t", "r", "__text").mapInArrow(run, schema), "turns")
    before = labelled.select(F.col("c").cast("string").alias("c"), (F.col("t") + 1).alias("t"), F.col("r").alias("r0")).join(few.select("c", "t").distinct(), ["c", "t"], "left_semi").groupBy("c", "t").agg(F.min("r0").alias("r0"))
    steps = few.join(before, ["c", "t"], "left").groupBy("r0", "r").count().collect()  # at most roles x roles rows
    start, step = np.zeros(3), np.zeros((3, 3))
    for r0, r, n in steps:
        if r0 is None:
            start[ROLES.index(r)] += n
        else:
            step[ROLES.index(r0), ROLES.index(r)] += n
    seen = [np.zeros((3, n)) for n in SIZES]
    for r, k, v, n in few.select("r", F.posexplode("f").alias("k", "v")).groupBy("r", "k", "v").count().collect():  # at most roles x sum(SIZES) rows
        seen[k][ROLES.index(r), v] += n
    return Model(start, step, seen)


def recover(turns: DataFrame, model: Model, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """``conv_col, turn_col, piece, role_pred, rendered`` of each turn; ``piece`` counts the turns of a row."""
    small_batches(turns.sparkSession)
    shared = turns.sparkSession.sparkContext.broadcast(model)
    ordered = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("h"))
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(n, "c", "t", "h").sortWithinPartitions("c", "t", "h")
    schema = T.StructType([T.StructField("c", turns.schema[conv_col].dataType), T.StructField("t", turns.schema[turn_col].dataType), *struct(("__text", "string"), ("piece", "int"), ("part", "int"), ("n", "bigint"), ("role", "int"), ("emit", "array<double>"))])
    out = arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        m, part = shared.value, TaskContext.get().partitionId()
        none = object()
        key, rows, count, first = none, [], 0, True

        def flush(edge: bool):
            """The current conversation; one at the edge of the task may go on in another and stays undecided."""
            nonlocal count
            emit = np.array([m.emit(r[2]) for r in rows])
            roles = [None] * len(rows) if edge else viterbi(m.start, m.step, emit)
            for at in range(0, len(rows), SLICE_ROWS):
                some = rows[at : at + SLICE_ROWS]
                e = emit[at : at + SLICE_ROWS].tolist() if edge else [None] * len(some)
                numbers = list(range(count, count + len(some)))
                count += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([r[0] for r in some], [r[1] for r in some], [r[2] for r in some], [r[3] for r in some], [part] * len(some), numbers, roles[at : at + SLICE_ROWS], e), out, strict=True)], schema=out)

        for b in batches:
            for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if r[0] != key or key is none:
                    if rows:
                        yield from flush(first)
                        first = False
                    key, rows = r[0], []
                rows += [(r[0], r[1], x, k) for k, x in enumerate(split_turns(r[2]))]
        if rows:
            yield from flush(True)

    decoded = materialize(ordered.mapInArrow(run, schema), "turns")
    final = lambda df: df.select(F.col("c").alias(conv_col), F.col("t").alias(turn_col), "piece", F.get(F.array(*map(F.lit, ROLES)), "role").alias("role_pred"), "__text")
    done = decoded.filter("role IS NOT NULL")
    open_ = decoded.filter("role IS NULL").withColumn("k", F.coalesce(F.col("c").cast("string"), F.lit("\0null")))
    rest = decide(open_, shared)
    both = final(done).unionByName(final(rest))

    schema2 = T.StructType([id_field(both, conv_col), id_field(both, turn_col), *struct(("piece", "int"), ("role_pred", "string"), ("rendered", "string"))])
    out2 = arrow_schema(schema2)

    def write(batches):
        for b in batches:
            rendered = [render(r, x) for r, x in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(rendered, pa.string())], schema=out2)

    return both.mapInArrow(write, schema2)


def decide(pieces: DataFrame, shared) -> DataFrame:
    """Roles of conversations at the edges of tasks: two pieces a task at most, each within one task."""
    summary = struct(("k", "string"), ("part", "int"), ("best", "array<double>"))

    def summarize(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        emit = np.array(table.column("emit").to_pylist())
        return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([between(shared.value.step, emit).ravel().tolist()])], schema=arrow_out)

    arrow_out = arrow_schema(summary)
    scores = pieces.select("k", "part", "n", "emit").groupBy("k", "part").applyInArrow(summarize, summary)
    borders = struct(("k", "string"), ("part", "int"), ("first", "int"), ("last", "int"))
    arrow_borders = arrow_schema(borders)

    def settle(table: pa.Table) -> pa.Table:
        """First and last state of each piece of one conversation: at most one row for each task."""
        m = shared.value
        table = table.sort_by("part")
        best = np.array(table.column("best").to_pylist()).reshape(-1, 3, 3)
        # Best score up to each border, over pairs of (first, last) of a piece.
        score, back = m.start, []
        for i, b in enumerate(best):
            into = score if i == 0 else (score[:, None] + m.step).max(0)
            origin = None if i == 0 else (score[:, None] + m.step).argmax(0)
            each = into[:, None] + b
            back.append((each.argmax(0), origin))
            score = each.max(0)
        last = int(score.argmax())
        firsts, lasts = [], []
        for first_of, origin in reversed(back):
            first = int(first_of[last])
            firsts.append(first)
            lasts.append(last)
            if origin is not None:
                last = int(origin[first])
        return pa.Table.from_arrays([table.column("k"), table.column("part"), pa.array(firsts[::-1], pa.int32()), pa.array(lasts[::-1], pa.int32())], schema=arrow_borders)

    fixed = materialize(scores.groupBy("k").applyInArrow(settle, borders), "borders")
    schema = T.StructType([f for f in pieces.schema if f.name in ("c", "t", "__text", "piece")] + list(struct(("role", "int"))))
    arrow_final = arrow_schema(schema)

    def decode(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        emit = np.array(table.column("emit").to_pylist())
        only = lambda s: np.where(np.arange(3) == s, 0.0, -np.inf)
        roles = viterbi(only(table.column("first")[0].as_py()), shared.value.step, emit, only(table.column("last")[0].as_py()))
        return pa.Table.from_arrays([table.column("c"), table.column("t"), table.column("__text"), table.column("piece"), pa.array(roles, pa.int32())], schema=arrow_final)

    return pieces.join(fixed, ["k", "part"]).groupBy("k", "part").applyInArrow(decode, schema)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Fit on the labelled sample, recover the roles of all turns and render them."""
    return recover(turns, fit(turns, conv_col, turn_col, role_col, text_col), conv_col, turn_col, text_col)


def split_transcript(text: str | None, model: Model | None = None) -> list[tuple[str, str]]:
    """(role, text) turns of one raw transcript whose turns begin at marked lines; unmarked leading text is a turn too."""
    turns = split_turns(text)
    m = model or Model()
    states = viterbi(m.start, m.step, np.array([m.emit(t) for t in turns]))
    return [(ROLES[s], strip_marker(ROLES[s], t)) for s, t in zip(states, turns, strict=True)]
