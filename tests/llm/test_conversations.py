"""Conversation repair against a plain search for the cheapest, ASCII-least edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from riskloom.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, part int"
AFTER = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        row = (conv, turn, "user" if h == 4 else role, text)
        out += [row, row] if h == 3 else [row]
    return out


def best_edits(kinds):
    """(cost, audit) of the cheapest, then least, edits: whole strings compared, from the back."""

    @cache
    def rest(k, state, inserted):
        options = [(0, "")] if k == len(kinds) and state in ("", "a") else []
        moves = []
        if k < len(kinds):
            initial, gone, cut = kinds[k]
            moves.append((3, "D", k + 1, state, 0))
            if not gone:
                if initial in AFTER[state]:
                    moves.append((cut, "K", k + 1, AFTER[state][initial], 0))
                moves += [(2 + cut, "R", k + 1, c, 0) for c in "ua" if c in AFTER[state]]
        if inserted < 3:
            moves += [(2, "I", k, c, inserted + 1) for c in "ua" if c in AFTER[state]]
        for price, edit, *then in moves:
            if found := rest(*then):
                options.append((price + found[0], edit + found[1]))
        return min(options, default=None)

    return rest(0, "", 0)


def every_script(kinds):
    """The same by trying all edits of few rows, with the pattern itself."""
    best = None
    for edits in itertools.product("DKua", repeat=len(kinds)):
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(kinds) + 1):
            initials, cost, audit = gaps[-1], 2 * len(gaps[-1]), "I" * len(gaps[-1])
            for (initial, gone, cut), e, g in reversed(list(zip(kinds, edits, gaps, strict=False))):
                if gone and e != "D":
                    cost = None
                    break
                cost += {"D": 3, "K": cut}.get(e, 2 + cut) + 2 * len(g)
                audit = "I" * len(g) + ("R" if e in "ua" else e) + audit
                initials = g + {"D": "", "K": initial or "?"}.get(e, e) + initials
            if cost is not None and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def expected(rows):
    """The report of one conversation's original rows, conv_id left out."""
    own = sorted(damaged(rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    count, kinds, seen = dict.fromkeys(C.COUNTS, 0), [], set()
    for _, _, role, text in own:
        letters = re.findall("[^\x20\x09-\x0D]", text)
        fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    pairs = zip(own, own[1:], strict=False)
    count["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs)
    cost, audit = best_edits(tuple(kinds))
    out, state, k = [], "", 0
    for e in audit:
        if e in "IR":
            state = "a" if state == "u" else "u"
            out.append(("user" if state == "u" else "assistant", "" if e == "I" else own[k][3]))
        elif e == "K":
            state = own[k][2][:1]
            out.append((own[k][2], own[k][3]))
        k += e != "I"
    turns = {t for _, t, _, _ in own if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *count.values(), cost, audit, digest)


TEXTS = ["Well said.", "And more!", "No end here", "", " \t", "Really? ", "\x1c", "...", "é", None]


def make(rng, conv, n):
    rows, turn = [], 0
    for _ in range(n):
        role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "User", "", "s", None])
        rows.append((conv, rng.choice([None, turn, turn]), role, rng.choice(TEXTS) if rng.random() < 0.4 else f"Text {rng.randrange(10**6)}."))
        turn += rng.choice([1, 1, 1, 0, 2, 3])
    return rows


def test_best_edits_are_the_cheapest_of_all():
    rng = random.Random(2)
    solver = C.Solver()
    for _ in range(60):
        kinds = []
        for _ in range(rng.randrange(4)):
            gone = rng.random() < 0.25
            kinds.append((rng.choice(["s", "u", "a", ""]), gone, not gone and rng.random() < 0.4))
        want = every_script(kinds)
        assert best_edits(tuple(kinds)) == want
        edits = solver.edits([*kinds, C.END], C.START, C.START)
        assert "".join(edits) == want[1]


def test_hirschberg_matches_whole_strings():
    rng = random.Random(4)
    solver = C.Solver()
    for _ in range(400):
        weights = [rng.random() for _ in range(4)]
        kinds = []
        for _ in range(rng.randrange(60)):
            gone = rng.random() < 0.15
            kinds.append((rng.choices(["s", "u", "a", ""], weights)[0], gone, not gone and rng.random() < 0.3))
        cost, audit = best_edits(tuple(kinds))
        full = [*kinds, C.END]
        assert "".join(solver.edits(full, C.START, C.START)) == audit
        cuts = sorted(rng.sample(range(len(full) + 1), min(3, len(full))))
        runs = [full[a:b] for a, b in zip([0, *cuts], [*cuts, len(full)], strict=True)]
        steps = [solver.sum_up(r) for r in runs]  # the same through summaries
        states = solver.crossings(steps, C.START, C.START)
        edits = [e for r, a, b in zip(runs, states, states[1:], strict=False) if r for e in solver.edits(r, a, b)]
        assert "".join(edits) == audit
        assert solver.sum_up(full).costs[C.START][C.START] == cost


@pytest.mark.parametrize("chunk_rows", [2048, 3])
def test_report_matches_plain_python(spark, chunk_rows, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk_rows)
    rng = random.Random(chunk_rows)
    by = {conv: make(rng, conv, rng.choice([1, 2, 4, 8, 15])) for conv in range(60)}
    by[None] = make(rng, None, 7)
    by[100] = make(rng, 100, 300)
    by[101] = [(101, 5, "user", "Again.")] * 40 + [(101, 6, "assistant", "x" * 50_000)]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    by[gone] = [(gone, 0, "user", "All rows go.")]
    rows = [(*r, "clash", 7) for own in by.values() for r in own]
    rng.shuffle(rows)
    got = {}
    for r in C.repair_report(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.conv_id not in got
        got[r.conv_id] = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
    assert got.keys() == by.keys()
    for conv, own in by.items():
        want = expected(own)
        assert got[conv] == want, conv
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_and_empty_table(spark):
    assert C.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 0, "user", "Hi.", "", 0), (1, 1, "user", "Again.", "", 0), (1, 2, "assistant", "Yes.", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("conv_id", "turn", "role", "text", "false AS gone")
    _, pieces = C.repair(df)
    fixed = sorted((r.turn, r.role, r.text) for r in C.repaired_rows(pieces).collect())
    assert [(r, t) for _, r, t in fixed] == [("user", "Hi."), ("assistant", ""), ("user", "Again."), ("assistant", "Yes.")]
