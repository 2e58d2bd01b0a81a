"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

A conversation is legal when it is an optional system turn, then user and assistant turns in
alternation, user first. Each given turn is placed as a turn of some role (relabelled where the role
differs, after empty turns inserted where the automaton asks for them) or merged into the turn before.
Dynamic programming finds the cheapest repair; ties fall to the earlier entry of ACTIONS.

A turn's effect on the automaton is a matrix of least costs between states, and turns compose by the
(min, +) product. So rows are range-partitioned by conversation and turn, and a conversation may span
partitions: each partition gives the product for its first and its last conversation, at most two small
rows, the driver chains these, and each partition then repairs its rows between the states it is told.
A conversation with a third of all rows is thus split like any other rows.

Edge cases: null roles and roles other than the three are relabelled at their own cost. Null turns sort
first; turns with equal numbers are ordered by role and text; repeated rows are repaired as repeated
turns. A null text is empty. A null conversation id is a conversation. Lone system turns get an empty
user turn after them. Very long texts pass through unchanged. An empty table gives an empty result. Only
the four columns of a conversation are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
#: Legal next turns of each state.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Where a conversation may end.
ACCEPT = (USER, ASSISTANT)


@dataclass(frozen=True)
class Costs:
    insert: float = 2.0
    merge: float = 1.0
    relabel: float = 3.0
    #: Relabelling a role that is none of the three.
    relabel_unknown: float = 0.5


@dataclass(frozen=True)
class Template:
    open: str = "<|{role}|>\n"
    close: str = "<|end|>\n"
    join: str = "\n\n"
    #: What a text may not have, as it would forge a turn, and what stands for it.
    escape: tuple[str, str] = ("<|", "< |")


def _inserts(source: int, target: int) -> list[int] | None:
    """The fewest turns to insert after ``source`` so that ``target`` may follow; None where it never may."""
    paths, seen = [(source, [])], set()
    while paths:
        state, path = paths.pop(0)
        if target in LEGAL[state]:
            return path
        for nxt in LEGAL[state]:
            if nxt not in seen:
                seen.add(nxt)
                paths.append((nxt, [*path, nxt]))
    return None


INSERTS = {(s, t): _inserts(s, t) for s in range(4) for t in range(1, 4)}
#: (name, from, to) in order of preference at equal cost.
ACTIONS = [("place", s, t) for s in range(4) for t in range(1, 4) if INSERTS[s, t] is not None] + [("merge", s, s) for s in range(1, 4)]


@dataclass
class Repairer:
    costs: Costs = field(default_factory=Costs)

    def __post_init__(self):
        self.kind, self.source, self.target = (np.array(x) for x in zip(*ACTIONS, strict=True))
        self.price = np.array([[self._price(role, *a) for a in ACTIONS] for role in range(4)])
        self.matrix = np.full((4, 4, 4), np.inf)
        for role in range(4):
            for (_, s, t), c in zip(ACTIONS, self.price[role], strict=True):
                self.matrix[role, s, t] = min(self.matrix[role, s, t], c)
        tails = {s: [] if s in ACCEPT else min((INSERTS[s, t] + [t] for t in ACCEPT if INSERTS[s, t] is not None), key=len) for s in range(4)}
        self.tails = {**tails, START: []}
        self.finish = np.array([np.inf if s == START else self.costs.insert * len(self.tails[s]) for s in range(4)])

    def _price(self, role: int, kind: str, s: int, t: int) -> float:
        """``role`` is START for one that is none of the three."""
        c = 0.0 if role == t else self.costs.relabel_unknown if role == START else self.costs.relabel
        return c + (self.costs.merge if kind == "merge" else self.costs.insert * len(INSERTS[s, t]))

    def product(self, roles: list[int]) -> np.ndarray:
        """Least costs from each state to each over the given turns."""
        out = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
        for r in roles:
            out = (out[:, :, None] + self.matrix[r][None]).min(1)
        return out

    def solve(self, roles: list[int], entry: int = START, leave: int | None = None) -> tuple[list[int], int, float]:
        """The action of every turn, the last state, and the cost with the finish where ``leave`` is None."""
        best = np.full(4, np.inf)
        best[entry] = 0.0
        came = np.empty((len(roles), 4), np.int32)
        for i, r in enumerate(roles):
            nxt = np.full(4, np.inf)
            for a, (_, s, t) in enumerate(ACTIONS):
                c = best[s] + self.price[r, a]
                if c < nxt[t]:
                    nxt[t], came[i, t] = c, a
            best = nxt
        end = leave if leave is not None else int(np.argmin(best + self.finish))
        cost = float(best[end] + (self.finish[end] if leave is None else 0.0))
        actions, state = [0] * len(roles), end
        for i in range(len(roles) - 1, -1, -1):
            actions[i] = int(came[i, state])
            state = ACTIONS[actions[i]][1]
        return actions, end, cost


def chain(products: list[np.ndarray], repairer: Repairer) -> list[tuple[int, int]]:
    """Entry and exit state of each consecutive part of one conversation."""
    best, back = np.array([0.0, np.inf, np.inf, np.inf]), []
    for m in products:
        total = best[:, None] + m
        back.append(total.argmin(0))
        best = total.min(0)
    state, out = int(np.argmin(best + repairer.finish)), []
    for b in reversed(back):
        out.append((int(b[state]), state))
        state = int(b[state])
    return out[::-1]


SCHEMA = "conv_id long, turn long, position long, role string, new_role string, action string, inserted array<string>, cost double, rendered string"


def repair(conversations: DataFrame, costs: Costs = Costs(), template: Template = Template(), partitions: int | None = None) -> DataFrame:
    """Every turn with its repaired role, action, inserted turns, cost and rendering; renderings of a conversation concatenate by position."""
    spark = conversations.sparkSession
    shared_dir(spark)
    repairer = Repairer(costs)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    order = ["conv_id", "turn", "role", "text", "tie"]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The tie parts equal rows, so that copies of one row are dealt out too.
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie").checkpoint()

    def segments(batches: Iterator[pa.RecordBatch]):
        """(conv, turns, roles, texts) of each run of one conversation."""
        now = None
        for batch in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield now
                    now = (conv, [], [], [])
                now[1].append(turn)
                now[2].append(role)
                now[3].append(text)
        if now is not None:
            yield now

    def ends(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, first, last, count = TaskContext.get().partitionId(), None, None, 0
        for conv, _, roles, _ in segments(batches):
            last = (conv, roles)
            first = first or last
            count += 1
        found = [] if first is None else [first] if count == 1 else [first, last]
        for k, (conv, roles) in enumerate(found):
            product = repairer.product([ROLES.get(r, START) for r in roles])
            yield pa.RecordBatch.from_pylist([{"part": part, "k": k, "single": count == 1, "conv": conv, "n": len(roles), "costs": product.ravel().tolist()}], ends_schema)

    ends_schema = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("single", pa.bool_()), ("conv", pa.int64()), ("n", pa.int64()), ("costs", pa.list_(pa.float64()))])
    no_text = ordered.select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"))
    found = sorted(no_text.mapInArrow(ends, "part int, k int, single boolean, conv long, n long, costs array<double>").collect(), key=lambda r: (r["part"], r["k"]))
    told: dict[tuple[int, int], tuple[int, int | None, int, bool]] = {}
    i = 0
    while i < len(found):
        j = i + 1
        # A run goes on while the next row is the first of a later part and of the same conversation.
        while j < len(found) and found[j]["k"] == 0 and found[j]["conv"] == found[i]["conv"]:
            j += 1
        if j - i > 1:
            at = 0
            for k, (entry, leave) in enumerate(chain([np.array(r["costs"]).reshape(4, 4) for r in found[i:j]], repairer)):
                r = found[i + k]
                told[r["part"], r["k"]] = (entry, leave, at, i + k == j - 1)
                at += r["n"]
        i = j

    names = ["conv_id", "turn", "position", "role", "new_role", "action", "inserted", "cost", "rendered"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.string()]

    def turns(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        columns, size = [[] for _ in names], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        before, count = None, 0
        for now in _with_last(segments(batches)):
            (conv, turn, roles, texts), is_last = now
            place = (part, 0) if count == 0 else (part, 1) if is_last else None
            count += 1
            entry, leave, at, final = told.get(place, (START, None, 0, True))
            codes = [ROLES.get(r, START) for r in roles]
            actions, end, _ = repairer.solve(codes, entry, leave)
            for i, (a, code) in enumerate(zip(actions, codes, strict=True)):
                kind, s, t = ACTIONS[a]
                inserted = [NAMES[x] for x in INSERTS[s, t]] if kind == "place" else []
                cost = float(repairer.price[code, a])
                body = (texts[i] or "").replace(*template.escape)
                if kind == "merge":
                    said = template.join + body
                else:
                    said = (template.close if s != START else "") + "".join(template.open.format(role=x) + template.close for x in inserted) + template.open.format(role=NAMES[t]) + body
                if final and i == len(roles) - 1:
                    tail = [NAMES[x] for x in repairer.tails[end]]
                    cost += costs.insert * len(tail)
                    said += template.close + "".join(template.open.format(role=x) + template.close for x in tail)
                    inserted = inserted + tail
                action = kind if kind == "merge" or code == t else "relabel"
                for column, value in zip(columns, (conv, turn[i], at + i, roles[i], NAMES[t], action, inserted, cost, said), strict=True):
                    column.append(value)
                size += len(said) + 64
            if size > 4 << 20:
                yield flush()
                columns, size = [[] for _ in names], 0
        if columns[0]:
            yield flush()

    return ordered.mapInArrow(turns, SCHEMA)


def _with_last(items: Iterator) -> Iterator:
    """Each item with whether it is the last."""
    held = None
    for x in items:
        if held is not None:
            yield held[0], False
        held = (x,)
    if held is not None:
        yield held[0], True
