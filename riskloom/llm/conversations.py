"""Conversation structure repair by Hirschberg's divide and conquer over a four-state automaton.

A repaired conversation's role initials match ``(s?(ua)+)?``: states START, SYSTEM (after s), USER (after u), ASSISTANT (after a); START and
ASSISTANT may end. Each row is deleted, kept or given another role, after inserting empty turns in front of it; the tail may be inserted
too. The cheapest edits are wanted, and among equally cheap ones those whose initials (D, I, K, R) are ASCII-least.

A forward pass holds, for each state, the least cost of reaching it and the *rank* of the least edits that do so among the four states'. No
edit string of some rows is a proper prefix of another one of the same rows (each ends with its last row's edit), so ranks and one
step's edits decide every comparison and no string is kept. A backward pass holds the four costs to the end. Both meet in
the middle; of the states whose costs add up to the least, the one of least rank is crossed, and both halves are solved anew
between their fixed ends: linear space. Vectors are normalised by their least cost, so few of them occur and each step is a look-up.

On Spark: rows are range-partitioned and sorted by (conversation, turn, role, text), so one hot conversation spreads over
partitions. A conversation that lies within a task's range and fits a chunk (``CHUNK_ROWS``, ``CHUNK_BYTES``) is solved at once. Others are
cut into chunks, each summed up by its 4 x 4 costs and ranks. These are composed for each (conversation, partition) and then for
each conversation; crossings are chosen top down by the same recursion over summaries, and each chunk solves its rows between
its two states. A task holds one chunk, or the summaries of one partition's chunks, or those of a conversation's partitions.

Defined cases: a null role or text is one space; a null conversation id is a conversation of its own; a null turn comes first; rows of one
turn are ordered by role, the text's first 64 characters and a hash; repeated rows are rows of their own; an empty role has no initial
that fits and must be replaced or deleted; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialise

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1  # costs; CUT for each truncated row that stays
INF = 1 << 60
CHUNK_ROWS, CHUNK_BYTES = 2048, 8 << 20
BLANKS = " \t\n\x0b\x0c\r"
#: State behind an inserted or replaced turn of user (from START, SYSTEM, ASSISTANT) or assistant (from USER).
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = ("su", "ua", "au")
END = ("end", False, False)  # the kind of the step that ends a conversation

#: A step from state to state: {(from, to): (cost, edits)}.
Steps = dict[tuple[int, int], tuple[int, str]]


def steps_of(kind: tuple[str, bool, bool]) -> Steps:
    """All cheapest steps of one kind of row: (initial, must be deleted, truncated)."""
    initial, gone, cut = kind
    out: Steps = {}

    def offer(a: int, b: int, cost: int, edits: str) -> None:
        if (cost, edits) < out.get((a, b), (INF, "")):
            out[a, b] = (cost, edits)

    for state in STATES:
        at, cost, edits = state, 0, ""
        for _ in range(len(STATES)):  # more inserts only come back to a state seen before
            if kind == END:
                if at in (START, ASSISTANT):
                    offer(state, START, cost, edits)
            else:
                offer(state, at, cost + DELETE, edits + "D")
                if not gone:
                    if (initial, at) in KEPT:
                        offer(state, KEPT[initial, at], cost + KEEP + CUT * cut, edits + "K")
                    offer(state, NEXT[at], cost + REROLE + CUT * cut, edits + "R")
            at, cost, edits = NEXT[at], cost + INSERT, edits + "I"
    return out


class Step:
    """One row or a run of rows: costs[a][b], and ranks[a][b] among the edits from a (ties in cost are settled already)."""

    __slots__ = ("costs", "ranks")

    def __init__(self, costs, ranks):
        self.costs, self.ranks = costs, ranks

    @classmethod
    def of(cls, steps: Steps) -> Step:
        costs = [[steps.get((a, b), (INF, ""))[0] for b in STATES] for a in STATES]
        ranks = []
        for a in STATES:
            order = sorted(e for (x, _), (_, e) in steps.items() if x == a)
            ranks.append([order.index(steps[a, b][1]) if (a, b) in steps else 0 for b in STATES])
        return cls(costs, ranks)


#: costs and ranks of the four states, the least cost being 0.
Vector = tuple[tuple[int, ...], tuple[int, ...]]


def unit(state: int) -> Vector:
    return tuple(0 if s == state else INF for s in STATES), (0,) * 4


def forward(vector: Vector, step: Step) -> tuple[Vector, int]:
    """The vector behind a step, and what was taken off its costs."""
    costs, ranks = vector
    best = []
    for b in STATES:
        options = [(costs[a] + step.costs[a][b], ranks[a], step.ranks[a][b]) for a in STATES if costs[a] < INF and step.costs[a][b] < INF]
        best.append(min(options, default=(INF, 0, 0)))
    order = sorted({(r, t) for c, r, t in best if c < INF})
    least = min(c for c, _, _ in best)
    if least >= INF:
        return ((INF,) * 4, (0,) * 4), 0
    place = tuple(order.index((r, t)) if c < INF else 0 for c, r, t in best)
    return (tuple(c - least if c < INF else INF for c, _, _ in best), place), least


def backward(costs: tuple[int, ...], step: Step) -> tuple[int, ...]:
    """Normalised costs to the end in front of a step."""
    out = [min(step.costs[a][b] + costs[b] if step.costs[a][b] < INF and costs[b] < INF else INF for b in STATES) for a in STATES]
    least = min(out)
    return tuple(c - least if c < INF else INF for c in out)


class Solver:
    """Steps of rows by kind, and look-up tables of what they make of a vector."""

    def __init__(self):
        self.steps: dict[tuple, Steps] = {}
        self.made: dict[tuple, Step] = {}
        self.ahead: dict[tuple, tuple[Vector, int]] = {}
        self.back: dict[tuple, tuple[int, ...]] = {}

    def step(self, kind) -> Step:
        if kind not in self.made:
            self.steps[kind] = steps_of(kind)
            self.made[kind] = Step.of(self.steps[kind])
        return self.made[kind]

    def go(self, vector: Vector, kind) -> tuple[Vector, int]:
        if isinstance(kind, Step):
            return forward(vector, kind)
        key = (vector, kind)
        if key not in self.ahead:
            self.ahead[key] = forward(vector, self.step(kind))
        return self.ahead[key]

    def come(self, costs: tuple[int, ...], kind) -> tuple[int, ...]:
        if isinstance(kind, Step):
            return backward(costs, kind)
        key = (costs, kind)
        if key not in self.back:
            self.back[key] = backward(costs, self.step(kind))
        return self.back[key]

    def sum_up(self, kinds: list) -> Step:
        """A run of steps as one step."""
        costs, ranks = [], []
        for a in STATES:
            vector, total = unit(a), 0
            for kind in kinds:
                vector, least = self.go(vector, kind)
                total += least
            costs.append([c + total if c < INF else INF for c in vector[0]])
            ranks.append(list(vector[1]))
        return Step(costs, ranks)

    def crossings(self, kinds: list, entry: int, leave: int) -> list[int]:
        """The state in front of each step and behind the last, by meeting in the middle."""
        states = [entry] * (len(kinds) + 1)
        states[-1] = leave
        work = [(0, len(kinds))]
        while work:
            lo, hi = work.pop()
            if hi - lo < 2:
                continue
            mid = (lo + hi) // 2
            vector, costs = unit(states[lo]), unit(states[hi])[0]
            for k in range(lo, mid):
                vector, _ = self.go(vector, kinds[k])
            for k in range(hi - 1, mid - 1, -1):
                costs = self.come(costs, kinds[k])
            states[mid] = min(STATES, key=lambda s: (min(INF, vector[0][s] + costs[s]), vector[1][s]))
            work += [(lo, mid), (mid, hi)]
        return states

    def solve(self, kinds: list[tuple], entry: int, leave: int) -> tuple[int, list[str]]:
        """The cost, and the edits of each row, between two states."""
        states = self.crossings(kinds, entry, leave)
        for kind in set(kinds):
            self.step(kind)
        taken = [self.steps[kind][states[k], states[k + 1]] for k, kind in enumerate(kinds)]
        return sum(cost for cost, _ in taken), [edits for _, edits in taken]

    def edits(self, kinds: list[tuple], entry: int, leave: int) -> list[str]:
        return self.solve(kinds, entry, leave)[1]


def apply_edits(rows: list[tuple[str, str]], edits: list[str], state: int) -> list[tuple[str, str]]:
    """The repaired (role, text), from a state."""
    role_of = {USER: "user", ASSISTANT: "assistant"}
    out = []
    for (role, text), todo in zip(rows, edits, strict=True):
        for edit in todo:
            if edit == "I":
                state = NEXT[state]
                out.append((role_of[state], ""))
            elif edit == "R":
                state = NEXT[state]
                out.append((role_of[state], text))
            elif edit == "K":
                state = KEPT[role[:1], state]
                out.append((role, text))
    return out


# -- one run of rows ---------------------------------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal")


class Run:
    """Faults and kinds of consecutive rows of one conversation: (turn, role, text), None for the row that only names it."""

    def __init__(self, rows: list[tuple], repeated: list[bool] | None = None):
        self.rows = [(role, text) for _, role, text in rows]
        self.count = dict.fromkeys(COUNTS, 0)
        self.kinds, seen = [], set()
        for k, (_, role, text) in enumerate(rows):
            bare = text.rstrip(BLANKS)
            again = (role, text) in seen if repeated is None else repeated[k]
            seen.add((role, text))
            blank = not bare
            cut = not blank and not again and bare[-1] not in ".!?"
            self.count["blank"] += blank
            self.count["duplicate"] += again and not blank
            self.count["truncated"] += cut
            initial = role[:1]
            self.kinds.append((initial if initial in ("s", "u", "a") else "", blank or again, cut))
        initials = [role[:1] for _, role, _ in rows]
        self.first, self.last = (initials[0], initials[-1]) if rows else (None, None)
        self.count["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        turns = sorted({t for t, _, _ in rows if t is not None})
        self.turns, self.low, self.high = len(turns), turns[0] if turns else None, turns[-1] if turns else None


SOLVED = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint"
REPAIRED = "cost bigint, audit string, repaired array<struct<role: string, text: string>>"
ROWS = "rows array<struct<turn: bigint, role: string, text: string>>"


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: range-partitioned and sorted; a hot conversation lies in several partitions."""
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "head", "tie"]
    df = rows.withColumns({"head": F.substring("text", 1, 64), "tie": F.xxhash64("role", "text")})
    # equal rows may be parted, unequal ones are never mixed up: the row's number only deals out
    df = df.withColumn("deal", F.monotonically_increasing_id())
    return df.repartitionByRange(*keys, "deal").sortWithinPartitions(*keys).drop("head", "tie", "deal")


def solve_or_cut(rows: DataFrame, id_type: str) -> DataFrame:
    """conv_id, part, chunk, done, and either the solution or the raw rows of a chunk (in order of part and chunk)."""
    chunk_rows, chunk_bytes = CHUNK_ROWS, CHUNK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, solver, chunk = TaskContext.get().partitionId(), Solver(), 0
        conv, held, size, is_open = None, [], 0, True  # the first conversation may begin in the partition before
        out: list[dict] = []

        def flush() -> None:
            nonlocal held, size, chunk, is_open
            is_open = True
            raw = [{"turn": t, "role": r, "text": x} for t, r, x in held]
            out.append({"conv_id": conv, "part": part, "chunk": chunk, "done": False, "rows": raw})
            held, size, chunk = [], 0, chunk + 1

        def close() -> None:
            nonlocal held, size
            if is_open:
                flush()
                return
            own = Run(held)
            total, edits = solver.solve([*own.kinds, END], START, START)
            fixed = apply_edits([*own.rows, ("", "")], edits, START)
            out.append(
                {"conv_id": conv, "part": part, "chunk": 0, "done": True, **own.count, "turns": own.turns, "low": own.low, "high": own.high}
                | {"cost": total, "audit": "".join(edits), "repaired": [{"role": r, "text": x} for r, x in fixed]}
            )
            held, size = [], 0

        def send():
            nonlocal out
            batch, out = pa.RecordBatch.from_pylist(out, schema=target), []
            return batch

        started = False
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for c, turn, role, text, gone in zip(*columns, strict=True):
                if not started or c != conv:
                    if started:
                        close()
                        is_open = False
                    conv, started = c, True
                if not gone:
                    held.append((turn, role, text))
                    size += len(text)
                    if len(held) >= chunk_rows or size >= chunk_bytes:
                        flush()
                        if len(out) >= 2:
                            yield send()
                if len(out) >= 512:
                    yield send()
        if started:
            flush()  # the last conversation may go on in the next partition
        if out:
            yield send()

    kind = f"conv_id {id_type}, part int, chunk int, done boolean, {SOLVED}, {REPAIRED}, {ROWS}"
    target = arrow_schema(kind)
    return rows.mapInArrow(run, kind)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def pairs(states: list[int]) -> list[tuple[int, int]]:
    return list(zip(states, states[1:], strict=False))


# -- conversations in several chunks -------------------------------------------------------------------------------------

#: A summary of consecutive rows: its steps row by row, the ends that meet the neighbours', and counts.
SUMMARY = f"costs array<bigint>, ranks array<int>, first string, last string, {SOLVED}"


def as_step(costs, ranks) -> Step:
    return Step([[int(x) for x in costs[4 * a : 4 * a + 4]] for a in STATES], [[int(x) for x in ranks[4 * a : 4 * a + 4]] for a in STATES])


def summary(step: Step, parts: list[dict]) -> dict:
    """The summary of consecutive parts, whose rows together make ``step``."""
    filled = [p for p in parts if p["first"] is not None]
    seams = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(filled, filled[1:], strict=False))
    dated = [p for p in parts if p["low"] is not None]
    shared = sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
    out = {c: sum(p[c] for p in parts) for c in COUNTS}
    out["illegal"] += seams
    out |= {"turns": sum(p["turns"] for p in dated) - shared, "low": dated[0]["low"] if dated else None, "high": dated[-1]["high"] if dated else None}
    out |= {"first": filled[0]["first"] if filled else None, "last": filled[-1]["last"] if filled else None}
    return out | {"costs": [x for row in step.costs for x in row], "ranks": [x for row in step.ranks for x in row]}


def repeated_rows(chunks: DataFrame) -> DataFrame:
    """(part, chunk, fresh): the places of those rows of a chunk whose role and text no earlier row of the conversation has.

    A row's role and text are compared by a 128-bit hash; the least place of each is a grouped minimum, however often it occurs."""
    rows = chunks.select("conv_id", "part", "chunk", F.posexplode("rows").alias("place", "row"))
    said = F.concat_ws("\u0000", F.length("row.role").cast("string"), "row.role", "row.text")
    at = F.struct("part", "chunk", "place")
    first = rows.groupBy("conv_id", F.md5(said.cast("binary")).alias("said")).agg(F.min(at).alias("at"))
    return first.groupBy("at.part", "at.chunk").agg(F.collect_list("at.place").alias("fresh"))


def run_of(rows, fresh) -> Run:
    known = set() if fresh is None else set(fresh)
    plain = [(r["turn"], r["role"], r["text"]) for r in rows]
    return Run(plain, [k not in known for k in range(len(plain))])


def summed_up(chunks: DataFrame) -> DataFrame:
    """part, chunk, conv_id and the summary of each chunk."""

    def run(batches):
        solver = Solver()
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own = run_of(row["rows"], row["fresh"])
                part = {**own.count, "turns": own.turns, "low": own.low, "high": own.high, "first": own.first, "last": own.last}
                out = {k: row[k] for k in ("conv_id", "part", "chunk")} | summary(solver.sum_up(own.kinds), [part])
                yield pa.RecordBatch.from_pylist([out], schema=target)

    kind = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, part int, chunk int, {SUMMARY}"
    target = arrow_schema(kind)
    return chunks.mapInArrow(run, kind)


def composed(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """One summary for each group of summaries."""

    def run(table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda r: r[order])
        step = Solver().sum_up([as_step(r["costs"], r["ranks"]) for r in own])
        return pa.Table.from_pylist([{k: own[0][k] for k in by} | summary(step, own)], schema=target)

    kind = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in by) + f", {SUMMARY}"
    target = arrow_schema(kind)
    return parts.groupBy(*by).applyInArrow(run, kind)


def crossed(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, order, entry, leave of each part; ``parts`` carry the entry and leave of their group as `enter` and `exit`."""

    def run(table: pa.Table) -> pa.Table:
        own = sorted(table.to_pylist(), key=lambda r: r[order])
        steps = [as_step(r["costs"], r["ranks"]) for r in own]
        states = Solver().crossings(steps, own[0]["enter"], own[0]["exit"])
        out = [{k: r[k] for k in (*by, order)} | {"entry": a, "leave": b} for r, (a, b) in zip(own, pairs(states), strict=True)]
        return pa.Table.from_pylist(out, schema=target)

    kind = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in (*by, order)) + ", entry int, leave int"
    target = arrow_schema(kind)
    return parts.groupBy(*by).applyInArrow(run, kind)


def ended(wholes: DataFrame) -> DataFrame:
    """conv_id, counts, cost, the state in front of the end and the edits there."""

    def run(batches):
        solver = Solver()
        end = solver.step(END)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                step = as_step(row["costs"], row["ranks"])
                exit_ = solver.crossings([step, END], START, START)[1]
                cost = step.costs[START][exit_] + end.costs[exit_][START]
                out.append({k: row[k] for k in ("conv_id", *COUNTS, "turns", "low", "high")} | {"cost": cost, "exit": exit_})
                out[-1]["tail"] = solver.steps[END][exit_, START][1]
            yield pa.RecordBatch.from_pylist(out, schema=target)

    kind = f"conv_id {wholes.schema['conv_id'].dataType.simpleString()}, {SOLVED}, cost bigint, exit int, tail string"
    target = arrow_schema(kind)
    return wholes.mapInArrow(run, kind)


def repaired_chunks(chunks: DataFrame) -> DataFrame:
    """conv_id, part, chunk, audit, repaired; ``chunks`` carry entry, leave and (the last one of a conversation) tail."""

    def run(batches):
        solver = Solver()
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own = run_of(row["rows"], row["fresh"])
                edits = solver.edits(own.kinds, row["entry"], row["leave"])
                fixed = apply_edits(own.rows, edits, row["entry"])
                if row["tail"]:
                    edits.append(row["tail"])
                    fixed += apply_edits([("", "")], [row["tail"]], row["leave"])
                out = {k: row[k] for k in ("conv_id", "part", "chunk")} | {"audit": "".join(edits)}
                out["repaired"] = [{"role": r, "text": x} for r, x in fixed]
                yield pa.RecordBatch.from_pylist([out], schema=target)

    kind = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, part int, chunk int, audit string, repaired array<struct<role: string, text: string>>"
    target = arrow_schema(kind)
    return chunks.mapInArrow(run, kind)


def repair_cut(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, counts, cost), and the repaired chunks of conversations that were cut."""
    cut = cut.select("conv_id", "part", "chunk", "rows")
    chunks = materialise(cut.join(repeated_rows(cut), ["part", "chunk"], "left"), "conversation-chunks")
    small = materialise(summed_up(chunks), "chunk-summaries")
    by_part = materialise(composed(small, ["conv_id", "part"], "chunk"), "part-summaries")
    whole = materialise(ended(composed(by_part, ["conv_id"], "part")), "conversation-summaries")
    goal = whole.select(F.col("conv_id").alias("conv"), F.lit(START).alias("enter"), "exit", "tail")
    same = F.col("conv_id").eqNullSafe(F.col("conv"))
    top = crossed(by_part.join(goal, same), ["conv_id"], "part")
    top = top.select(F.col("conv_id").alias("conv"), F.col("part").alias("of"), F.col("entry").alias("enter"), F.col("leave").alias("exit"))
    inner = crossed(small.join(top, same & (F.col("part") == F.col("of"))), ["conv_id", "part"], "chunk")
    last = small.groupBy("conv_id").agg(F.max(F.struct("part", "chunk")).alias("at")).join(goal, same)
    last = last.select("at.part", "at.chunk", "tail")
    todo = chunks.join(inner.drop("conv_id"), ["part", "chunk"]).join(last, ["part", "chunk"], "left")
    return whole, repaired_chunks(todo)


# -- the operator ----------------------------------------------------------------------------------------------------------


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables for conversation rows (conv_id, turn, role, text, gone).

    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost. Pieces, in order of (part, chunk): conv_id,
    part, chunk, audit (edit initials), repaired (role and text). Rows with ``gone`` only name their conversation.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    first = materialise(solve_or_cut(ordered(rows), id_type), "conversations")
    done, cut = first.where("done"), first.where("NOT done")
    whole, chunks = repair_cut(cut)
    facts = ["conv_id", *COUNTS, "turns", "low", "high", "cost"]
    all_facts = done.select(*facts).union(whole.select(*facts))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    pieces = done.select("conv_id", "part", "chunk", "audit", "repaired").union(chunks)
    return all_facts.select("conv_id", gaps, *COUNTS, "cost"), pieces


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """conv_id, turn (numbered from 0), role, text of the repaired conversations."""
    rows = pieces.select("conv_id", "part", "chunk", F.posexplode("repaired").alias("place", "row"), F.size("repaired").alias("n"))
    sizes = pieces.select("conv_id", "part", "chunk", F.size("repaired").cast("bigint").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part", "chunk")) - F.col("n")
    starts = sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("chunk").alias("k"), before.alias("start"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("chunk") == F.col("k"))
    return rows.join(starts, same).select("conv_id", (F.col("start") + F.col("place")).alias("turn"), "row.role", "row.text")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of rows damaged by the checksum of ``conv_id:turn`` (a null: one space) modulo 20.

    0 drops the row, 1 empties its text, 2 takes out full stops, exclamation and question marks, 3 repeats it, 4 sets the role user.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", word("role").alias("role"), word("text").alias("text"),
        (F.crc32(F.concat_ws(":", word("conv_id"), word("turn"))) % 20).alias("h"),
    )
    h = F.col("h")
    rows = rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.when(h == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (h == 0).alias("gone"), F.when(h == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("copy", "copies")


def joined_hashes(pieces: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its repaired ``role:text`` rows, newline-joined: a stream over the sorted rows, holding one state."""
    rows = pieces.select("conv_id", "part", "chunk", F.posexplode_outer("repaired").alias("place", "row"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk", "place")

    def run(batches):
        conv, state, started, lines = None, None, False, 0
        for batch in batches:
            out = []
            for c, row in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if not started or c != conv:
                    if started:
                        out.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                    conv, state, started, lines = c, hashlib.sha256(), True, 0
                if row is not None:
                    state.update(("\n" * (lines > 0) + f"{row['role']}:{row['text']}").encode())
                    lines += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if started:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], schema=target)

    kind = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    target = arrow_schema(kind)
    return rows.mapInArrow(run, kind)


def repair_report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage."""
    facts, pieces = repair(damage(conversations))
    pieces = materialise(pieces, "repaired")
    several = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    one = pieces.join(several, same, "left_anti")
    many = pieces.join(several, same, "left_semi")
    line = F.transform("repaired", lambda r: F.concat_ws(":", r["role"], r["text"]))
    short = one.select("conv_id", "audit", F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"))
    parts = F.sort_array(F.collect_list(F.struct("part", "chunk", "audit")))
    audits = many.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    hashes = joined_hashes(many).withColumnRenamed("conv_id", "c")
    long = audits.join(hashes, same).drop("c")
    found = short.unionByName(long).withColumnRenamed("conv_id", "c")
    return facts.join(found, same).drop("c")
