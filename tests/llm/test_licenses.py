import random

import numpy as np

from riskloom.llm import licenses as S
from riskloom.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def brute(text, templates):
    """Every window of the grid verified, none skipped."""
    words, starts, ends = S.word_places((text or "").encode())
    out = []
    for t in [S.Template(n, x) for n, x in sorted(templates.items())]:
        shingles = S.runs(words, t.width) if t.size else words[:0]
        if not len(shingles):
            continue
        if t.size == 1:
            places = [(i, i) for i, s in enumerate(shingles) if s == t.shingles[0]]
        else:
            places = [p for w in range(2 * len(shingles) // t.reach + 2) if (p := S.verify(shingles, t, w))]
        out += [(t.name, int(starts[a]), int(ends[b + t.width - 1])) for a, b in S.merged(places)]
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def texts():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    out = [None, "", "all rights", "All  RIGHTS\nreserved.", "é All rights reserved 😀 all rights reserved"]
    for name in S.TEMPLATES:
        for _ in range(3):
            line = S.TEMPLATES[name].split()
            if len(line) > 30 and rng.random() < 0.7:
                line[rng.randrange(len(line))] = "changed"
            around = [" ".join(rng.choices(words, k=rng.randint(0, 400))) for _ in range(2)]
            out.append(f"{around[0]} {' '.join(line)} {around[1]}")
    out.append("w " * 60_000 + S.TEMPLATES["mit-grant"])
    return out


def test_bands_retrieve_what_brute_force_finds(frame):
    rows = texts()
    found, f = S.find_licenses(frame(rows * 2, ids=[*range(len(rows))] * 2))
    got = found.select("doc_id", f"{f}.*").collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        text = rows[r.doc_id] or ""
        want = brute(text, S.TEMPLATES)
        point = lambda b: len(text.encode()[:b].decode())
        assert list(zip(r.names, r.starts, r.ends, strict=True)) == [(n, point(a), point(b)) for n, a, b in want]


def test_every_planted_template_is_found(frame):
    rows = texts()
    got = {r.doc_id: set(r.licenses.split(",")) for r in S.license_report(frame(rows)).collect()}
    names = [n for n in S.TEMPLATES for _ in range(3)]
    for k, name in enumerate(names):
        assert name in got[5 + k]
    assert got[0] == got[1] == got[2] == {""} and "mit-grant" in got[len(rows) - 1]


def test_collision_probability():
    assert 1 - (1 - S.SIMILARITY) ** S.BANDS >= S.RECALL
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(2000):
        t = rng.integers(0, 2**63, 20).astype(np.uint64)
        other = rng.integers(0, 2**63, 64).astype(np.uint64)
        window = np.concatenate([t[:16], other])
        missed += not ((t[:, None] * S._ODD).min(0) == (window[:, None] * S._ODD).min(0)).any()
    assert missed / 2000 < 0.01


def test_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op6_license_scans"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs) and sum(r.n_matches for r in rows) > 0
    for r in rows:
        assert r.licenses == ",".join(sorted({n for n, _, _ in brute(docs[r.doc_id], S.TEMPLATES)}))


def test_empty_table_and_templates(frame):
    assert S.license_report(frame([])).collect() == []
    assert S.license_report(frame(["x"]), {"none": " . "}).first().n_matches == 0
