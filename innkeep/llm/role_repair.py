"""Minimum-cost role repair of conversations, and their rendering.

A legal conversation is ``[system] (user assistant)+``.  Every turn either
opens a turn of a legal role (its own, or another at the cost of a relabel,
after empty turns inserted at their cost) or is merged into the turn before.
Dynamic programming over the automaton's states finds the cheapest repair;
among equal ones, going back from the end, the predecessor state of lowest
number and the action of lowest number win.

A turn's effect on the states' costs is a min-plus matrix that depends on its
role alone, and such matrices multiply.  Turns are range-partitioned by
(conversation, turn), so a conversation of any length spreads over tasks: each
task reduces the stretches at its two ends to one matrix each; from these (a
table of two small rows a task) follow the costs where each stretch of a
conversation in several tasks begins; the stretches then tell which state they
lead back to, and last the turns are repaired and rendered.  Along a
conversation, matrices and states are combined in a tree of groups of at most
``FAN`` rows.  Nothing holds a conversation whole but a task that holds all of
its turns, and no rows go to the driver.

Edge cases: roles are trimmed and lower-cased; null, empty and other roles are
unknown (cheaper to relabel); null text is empty; rows with a null conversation
form one conversation; turns order by (turn, role, text), nulls first; repeated
rows are turns of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import BROADCAST_ROWS, cut

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("unknown", "system", "user", "assistant")  # by state, START standing for an unknown role
PART_BYTES = 16 << 20
PART_ROWS = 20_000
FAN = 1024  # stretches, or groups of them, combined by one group of a task
INF = 1 << 40

# Names of roles in public chat formats
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 2
    name: int = 1  # relabel of an unknown role
    insert: int = 3


def _inserts(state: int, role: int) -> int | None:
    """Empty turns needed in ``state`` before a turn of ``role`` (None: never legal)."""
    if role == SYSTEM:
        return 0 if state == START else None
    if role == USER:
        return 1 if state == USER else 0
    return 0 if state == USER else 1


class Repair:
    """Cost vectors and matrices of the automaton, remembered once met."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.seen_vectors: dict = {}
        self.seen_matrices: dict = {}

    def _label(self, role: int, new: int) -> int:
        return 0 if role == new else self.costs.name if role == START else self.costs.relabel

    def moves(self, state: int, role: int) -> list[tuple[int, int, int, int]]:
        """(next state, cost, action, inserted) of a turn: 0 keep, 1 merge, 2 relabel, 3 relabel and merge."""
        out = []
        for new in (SYSTEM, USER, ASSISTANT):
            n = _inserts(state, new)
            if n is not None:
                out.append((new, self._label(role, new) + n * self.costs.insert, 0 if new == role else 2, n))
        if state != START:
            out.append((state, self.costs.merge + self._label(role, state), 1 if state == role else 3, 0))
        return out

    def step(self, vector: tuple, role: int) -> tuple[tuple, tuple]:
        """Costs after a turn, and for every state (state before, action, inserted)."""
        key = (vector, role)
        if key not in self.seen_vectors:
            low = min(vector)
            best = [(INF, 0, 0, 0)] * 4
            for s, c in enumerate(vector):
                if c < INF:
                    for new, cost, action, n in self.moves(s, role):
                        best[new] = min(best[new], (c - low + cost, s, action, n))
            self.seen_vectors[key] = (tuple(b[0] for b in best), tuple(b[1:] for b in best))
        vector, back = self.seen_vectors[key]
        return vector, back

    def times(self, matrix: tuple, role: int) -> tuple:
        """Matrix of a stretch with one more turn (rows: state before), less its smallest entry."""
        key = (matrix, role)
        if key not in self.seen_matrices:
            rows = []
            for row in matrix:
                out = [INF] * 4
                for s, c in enumerate(row):
                    if c < INF:
                        for new, cost, _, _ in self.moves(s, role):
                            out[new] = min(out[new], c + cost)
                rows.append(out)
            low = min(min(r) for r in rows)
            self.seen_matrices[key] = tuple(tuple(c - low if c < INF else INF for c in r) for r in rows)
        return self.seen_matrices[key]

    def end(self, vector: tuple) -> int:
        """The state to end in: complete with empty turns at their cost."""
        rest = {ASSISTANT: 0, USER: self.costs.insert, SYSTEM: 2 * self.costs.insert}
        return min((vector[s] + c, s) for s, c in rest.items())[1]


UNIT = tuple(tuple(0 if i == j else INF for j in range(4)) for i in range(4))


def role_number(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), START)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, conversation, rows) of each conversation in a task's sorted rows; rows are (turn, role, text, state...)."""
    now, rows = None, []
    for batch in batches:
        for part, conv, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if now != (part, conv):
                if rows:
                    yield (*now, rows)
                now, rows = (part, conv), []
            rows.append(row)
    if rows:
        yield (*now, rows)


NODE = "conv long, part long, item array<long>"
NODE_SCHEMA = pa.schema([("conv", pa.int64()), ("part", pa.int64()), ("item", pa.list_(pa.int64()))])


def _borders(costs: Costs):
    """Matrices of the first and the last stretch of a task (a task in between holds one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, out = Repair(costs), []
        for part, conv, rows in _stretches(batches):
            m = UNIT
            for row in rows:
                m = repair.times(m, role_number(row[1]))
            del out[1:]
            out.append({"conv": conv, "part": part, "item": [c for row in m for c in row]})
        yield pa.RecordBatch.from_pylist(out, NODE_SCHEMA)

    return run


FIRST = [0, INF, INF, INF]


def _less(values: list[int]) -> list[int]:
    """Costs less the smallest."""
    low = min(values)
    return [c - low if c < INF else INF for c in values]


class Begins:
    """Forward along a conversation: items are matrices, states the costs where a stretch begins and 1 if it is the last."""

    @staticmethod
    def fold(items: list) -> list:
        m = items[0]
        for x in items[1:]:
            m = _less([min(min(m[4 * i + s] + x[4 * s + j] for s in range(4)), INF) for i in range(4) for j in range(4)])
        return m

    @staticmethod
    def root(item: list) -> list:
        return [*FIRST, 1]

    @staticmethod
    def spread(state: list, items: list) -> list:
        *vector, last = state
        out = []
        for k, m in enumerate(items):
            out.append([*vector, last if k == len(items) - 1 else 0])
            vector = _less([min(min(vector[i] + m[4 * i + j] for i in range(4)), INF) for j in range(4)])
        return out


class Ends:
    """Backward: items are the states that each end state leads back to, and the end state of a last stretch; states are end states."""

    @staticmethod
    def fold(items: list) -> list:
        lead = range(4)
        for x in reversed(items):
            lead = [x[s] if s >= 0 else -1 for s in lead]
        return [*lead, items[-1][4]]

    @staticmethod
    def root(item: list) -> list:
        return [item[4]]

    @staticmethod
    def spread(state: list, items: list) -> list:
        out, s = [], state[0]
        for x in reversed(items):
            out.append([s])
            s = x[s]
        return out[::-1]


def _scan(nodes: DataFrame, way: type[Begins] | type[Ends], span: int) -> DataFrame:
    """``conv, part, state`` of every node (``conv, part, item``; parts are below ``span``), in a tree of groups of ``FAN`` parts."""

    def children(df: pd.DataFrame) -> tuple[pd.DataFrame, list]:
        df = df.sort_values("part")
        return df, [[int(c) for c in x] for x in df["item"]]

    def answer(df: pd.DataFrame, states: list) -> pd.DataFrame:
        return pd.DataFrame({"conv": df["conv"].array, "part": df["part"].array, "state": states})

    def whole(df: pd.DataFrame) -> pd.DataFrame:
        df, items = children(df)
        return answer(df, way.spread(way.root(way.fold(items)), items))

    def folded(df: pd.DataFrame) -> pd.DataFrame:
        df, items = children(df)
        return pd.DataFrame({"conv": df["conv"].array[:1], "part": df["part"].array[:1] // FAN, "item": [way.fold(items)]})

    def below(df: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        df, items = children(df)
        return answer(df, way.spread([int(c) for c in above["state"].iloc[0]], items))

    out = "conv long, part long, state array<long>"
    if span <= FAN:
        return nodes.groupBy("conv").applyInPandas(whole, out)
    group = F.floor(F.col("part") / FAN).alias("up")
    above = _scan(cut(nodes.groupBy("conv", group).applyInPandas(folded, NODE)), way, -(-span // FAN))
    return nodes.groupBy("conv", group).cogroup(above.groupBy("conv", F.col("part").alias("up"))).applyInPandas(below, out)


def _beside(dealt: DataFrame, states: DataFrame, name: str) -> DataFrame:
    """``dealt`` with the state of its stretch as a last column (null: a conversation in one task), stretches whole and in order.

    A state is a handful of numbers: up to ``BROADCAST_ROWS`` of them, counted, go to the tasks; more meet the turns by a shuffle.
    """
    states = states.select(F.col("part").alias("to_part"), F.col("conv").alias("to_conv"), F.col("state").alias(name))
    few = states.count() <= BROADCAST_ROWS
    at = (F.col("part") == F.col("to_part")) & F.col("conv").eqNullSafe(F.col("to_conv"))
    out = dealt.join(F.broadcast(states) if few else states, at, "left").drop("to_part", "to_conv")
    # a part lies whole in one task again, and tasks are in order
    return out if few else out.repartitionByRange(dealt.rdd.getNumPartitions(), "part").sortWithinPartitions("part", "pos")


def _forward(repair: Repair, begin: tuple, rows: list) -> tuple[tuple, list]:
    vector, trail = begin, []
    for row in rows:
        vector, back = repair.step(vector, role_number(row[1]))
        trail.append(back)
    return vector, trail


def _leads(costs: Costs):
    """For every state at the end of a stretch, the state at its beginning (-1: not reached); the end state of a last stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, out = Repair(costs), []
        for part, conv, rows in _stretches(batches):
            begin = rows[0][-1]
            if begin is not None:
                vector, trail = _forward(repair, tuple(begin[:4]), rows)
                leads = [s if vector[s] < INF else -1 for s in range(4)]
                for back in reversed(trail):
                    leads = [back[s][0] if s >= 0 else -1 for s in leads]
                out.append({"conv": conv, "part": part, "item": [*leads, repair.end(vector) if begin[4] else -1]})
        yield pa.RecordBatch.from_pylist(out, NODE_SCHEMA)

    return run


OUT = "conv_id long, turn long, role string, new_role string, action string, inserted int, tail int, piece string"
ACTIONS = ("keep", "merge", "relabel", "relabel_merge")


def _open(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSE = "<|end|>\n"


def _render(costs: Costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, out = Repair(costs), []
        for _, conv, rows in _stretches(batches):
            *begin, last = rows[0][-2] or (*FIRST, 1)
            vector, trail = _forward(repair, tuple(begin), rows)
            final = state = rows[0][-1][0] if rows[0][-1] else repair.end(vector)
            path = []
            for back in reversed(trail):
                before, action, n = back[state]
                path.append((before, state, action, n))
                state = before
            for (turn, role, text, *_), (before, state, action, n) in zip(rows, reversed(path)):
                if action in (1, 3):
                    piece = "\n" + (text or "")
                else:
                    piece = CLOSE if before != START else ""
                    if n:
                        piece += _open(USER if state == ASSISTANT else ASSISTANT) + CLOSE
                    piece += _open(state) + (text or "")
                out.append({"conv_id": conv, "turn": turn, "role": role, "new_role": ROLES[state], "action": ACTIONS[action], "inserted": n, "tail": 0, "piece": piece})
            if last:  # complete the conversation
                missing = {SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT]}.get(final, [])
                out[-1]["tail"] = len(missing)
                out[-1]["piece"] += CLOSE + "".join(_open(r) + CLOSE for r in missing)
            if len(out) >= 5_000:
                yield pa.RecordBatch.from_pylist(out, SCHEMA)
                out = []
        yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return run


SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.int32()), ("tail", pa.int32()), ("piece", pa.string())]
)


def repair_roles(turns: DataFrame, costs: Costs = Costs(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input turn: ``conv_id, turn, role, new_role, action, inserted, tail, piece``.

    ``inserted`` empty turns come before it, ``tail`` empty turns end the
    conversation after it; the pieces of a conversation, in order, are its
    rendered text.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")
    )
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(1, -(-size["n"] // PART_ROWS), -(-int(size["b"] or 0) // PART_BYTES))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *order[:3], F.xxhash64("text"), "row")
    order = [*order[:3], F.xxhash64("text"), F.col("text").asc_nulls_first(), F.col("row")]
    # a reliable checkpoint keeps partitions and their order; the passes below shuffle no text unless states are too many to broadcast
    dealt = dealt.sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"))
    dealt = cut(dealt)
    turns = dealt.select("part", "conv", "turn", "role", F.lit(None).cast("string").alias("text"), "pos")
    nodes = cut(turns.drop("text", "pos").mapInArrow(_borders(costs), NODE))
    # conversations in several tasks
    several = nodes.groupBy("conv").agg(F.count("*").alias("c")).where("c > 1").select(F.col("conv").alias("to_conv"))
    nodes = cut(nodes.join(several, F.col("conv").eqNullSafe(F.col("to_conv")), "left_semi"))
    span = dealt.rdd.getNumPartitions()
    begins = cut(_scan(nodes, Begins, span))
    leads = cut(_beside(turns, begins, "begin").drop("pos").mapInArrow(_leads(costs), NODE))
    ends = cut(_scan(leads, Ends, span))
    return _beside(_beside(dealt, begins, "begin"), ends, "end").drop("pos").mapInArrow(_render(costs), OUT)
