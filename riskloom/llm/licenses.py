"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are those of the decontamination operator (A-Z lowered). A template's shingles are its runs of five words (of all its words, if it
has fewer). Every shingle of a text gets BANDS hash values; minima are taken over overlapping windows of 8, 16, 32, ... shingles that
move by half their length. A template belongs to the shortest windows of at least twice its shingles, so each occurrence lies
whole in one of them, and the window's similarity to the template is at least SIMILARITY when CONTAINMENT of the template is
there. A band is one hash function: BANDS of them collide with a probability of at least RECALL at that similarity
(``bands_for``). A retrieved window, widened by the template's length on both sides, is a match if it holds at least CONTAINMENT of
the template's distinct shingles; touching matches of a template are merged. Templates of one shingle need no bands:
the shingle itself is looked up.

Defined cases: null and empty texts have no match; equal templates are both reported; templates without words are ignored;
repeated rows are scanned alike; an empty table gives no row. Templates are a short list held by each task.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_text, mix64, word_bounds, word_hashes
from riskloom.llm.decontamination import _TABLE

WIDTH, CONTAINMENT, SIMILARITY, RECALL = 5, 0.8, 0.2, 0.999
BLOCK = 4  # shingles; the shortest window has two blocks

#: License notices (fixed public texts).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def bands_for(similarity: float, recall: float) -> int:
    """One-row bands needed for a collision of sets of that similarity with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity))


BANDS = bands_for(SIMILARITY, RECALL)
_ODD = mix64(np.arange(1000, 1000 + BANDS, dtype=np.uint64)) | np.uint64(1)


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first byte, end byte) of a text's words."""
    data = np.frombuffer(text.translate(_TABLE), np.uint8)
    starts, ends = word_bounds(data)
    return word_hashes(data, starts, ends), starts, ends


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order of the text."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    acc = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        acc = mix64(acc ^ words[k : len(words) - width + 1 + k])
    return acc


class Template:
    def __init__(self, name: str, text: str):
        words = word_places(text.encode())[0]
        self.name, self.width = name, min(WIDTH, len(words))
        self.shingles = np.unique(runs(words, self.width)) if self.width else words
        self.size = len(self.shingles)
        self.level = max(1, math.ceil(math.log2(max(1, 2 * self.size / BLOCK))))  # windows of 2**level blocks
        self.reach = BLOCK << self.level
        self.signature = (self.shingles[:, None] * _ODD).min(0) if self.size else None


def minima(shingles: np.ndarray, levels: int) -> list[np.ndarray]:
    """For level 1, 2, ...: windows x BANDS minima; window t of a level begins at t times half its length."""
    blocks = -(-len(shingles) // BLOCK)
    padded = 1 << max(levels, (max(1, blocks) - 1).bit_length())
    low = np.full((padded, BANDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, blocks, 4096):
        part = shingles[at * BLOCK : (at + 4096) * BLOCK]
        values = part[:, None] * _ODD
        edges = np.arange(0, len(part), BLOCK)
        low[at : at + len(edges)] = np.minimum.reduceat(values, edges, axis=0)
    low = low[: max(1 << levels, blocks + (-blocks % (1 << levels)) + (1 << levels))]
    out = [np.minimum(low[:-1], low[1:])]
    for _ in range(1, levels):
        out.append(np.minimum(out[-1][:-2:2], out[-1][2::2]))
    return out


class Scanner:
    def __init__(self, templates: dict[str, str]):
        made = [Template(n, t) for n, t in sorted(templates.items())]
        self.by_width: dict[int, list[Template]] = {}
        for t in made:
            if t.size:
                self.by_width.setdefault(t.width, []).append(t)

    def scan(self, text: bytes) -> list[tuple[str, int, int]]:
        """(template, first byte, end byte) of the matches, ordered by place and name."""
        words, starts, ends = word_places(text)
        found = []
        for width, templates in self.by_width.items():
            shingles = runs(words, width)
            if not len(shingles):
                continue
            long = [t for t in templates if t.size > 1]
            low = minima(shingles, max(t.level for t in long)) if long else []
            for t in templates:
                if t.size == 1:
                    places = [(int(p), int(p)) for p in np.flatnonzero(shingles == t.shingles[0])]
                else:
                    hits = np.flatnonzero((low[t.level - 1] == t.signature).any(1))
                    places = [p for w in hits.tolist() if (p := verify(shingles, t, w))]
                for a, b in merged(places):
                    found.append((t.name, int(starts[a]), int(ends[b + width - 1])))
        return sorted(found, key=lambda x: (x[1], x[0], x[2]))


def verify(shingles: np.ndarray, t: Template, window: int) -> tuple[int, int] | None:
    """First and last place of the template's shingles around a window, if enough of them are there."""
    first = window * (t.reach // 2)
    begin = max(0, first - t.size)
    region = shingles[begin : first + t.reach + t.size]
    held = np.isin(region, t.shingles)
    if len(np.unique(region[held])) < CONTAINMENT * t.size:
        return None
    at = np.flatnonzero(held)
    return begin + int(at[0]), begin + int(at[-1])


def merged(places: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", keep: list[str] | None = None
) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned too): names, starts, ends of the matches (code points)."""
    given = dict(TEMPLATES if templates is None else templates)

    def make():
        scanner = Scanner(given)

        def apply(texts: list[bytes]) -> dict[str, list]:
            out: dict[str, list] = {"names": [], "starts": [], "ends": []}
            for t in texts:
                found = scanner.scan(t)
                points = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)]) if found else None
                out["names"].append([n for n, _, _ in found])
                out["starts"].append([int(points[a]) for _, a, _ in found])
                out["ends"].append([int(points[b]) for _, _, b in found])
            return out

        return apply

    kind = "names array<string>, starts array<bigint>, ends array<bigint>"
    return map_text(docs, make, kind, text=text, keep=keep, out="licenses")


def license_report(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_matches, licenses (distinct names, comma-joined), spans (name:start:end, comma-joined)."""
    found, f = find_licenses(docs, templates, keep=["doc_id"])
    spans = F.transform(
        F.arrays_zip(f"{f}.names", f"{f}.starts", f"{f}.ends"), lambda x: F.concat_ws(":", x["names"], x["starts"], x["ends"])
    )
    return found.select(
        "doc_id", F.size(f"{f}.names").cast("bigint").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(f"{f}.names")), ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
    )
