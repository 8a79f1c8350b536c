"""Rule-driven column functions: ordered keyword classifier, bands, flags, name rewrites.

All compile a small, driver-side rule list into one native ``CASE WHEN`` expression: no UDF, no
join, evaluated inside whole-stage codegen next to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.numeric import ColumnOrName, _c


def classify(
    x: ColumnOrName,
    rules: Sequence[tuple[str, Sequence[str]]] = K.FIRM_TYPE_RULES,
    default: str = K.FIRM_TYPE_DEFAULT,
) -> Column:
    """Ordered keyword classifier: the first rule with a keyword contained in ``lower(x)`` wins.

    Keywords are literal substrings (``contains``), never regular expressions, so rules such as
    ``'lv='`` or ``'marks & spencer financial'`` need no escaping. A null input lowers to the text
    ``'none'`` in the reference (``str(None)``) and therefore falls through to ``default``.

    From ``PATTERN_FROM`` keywords on, one pattern finds the rules instead of a ``contains`` for each keyword (same result).
    """
    low = F.lower(_c(x).cast("string"))
    if sum(len(keywords) for _, keywords in rules) >= PATTERN_FROM:
        return _classify_by_pattern(low, rules, default)
    expr = None
    for label, keywords in rules:
        cond = None
        for kw in keywords:
            hit = low.contains(kw.lower())
            cond = hit if cond is None else (cond | hit)
        if cond is None:
            continue
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


#: Keywords from which :func:`classify` uses one pattern.
PATTERN_FROM = 200


def _classify_by_pattern(low: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first rule found, by one look-ahead alternation that is tried at every place of the text.

    Alternatives are dealt by their first character, so few are tried at a place, and those with the same one stand in rule
    order: the match at a place is the best rule that begins there, and the least rank of all places is the first rule.
    """
    ranks: dict[str, int] = {}
    for rank, (_, keywords) in enumerate(rules):
        for kw in keywords:
            ranks.setdefault(kw.lower(), rank)
    everywhere = ranks.pop("", len(rules))  # the empty keyword is in every text
    by_first: dict[str, list[str]] = {}
    for kw in ranks:
        by_first.setdefault(kw[0], []).append(kw)
    quote = lambda text: re.sub(r"([^\w\s])", r"\\\1", text)
    branches = [
        f"{quote(first)}(?:{'|'.join(quote(kw[1:]) for kw in words)})" for first, words in by_first.items()
    ]
    labels = F.array(*[F.lit(label) for label, _ in rules])
    best = F.lit(everywhere)
    if branches:
        found = F.regexp_extract_all(low, F.lit(f"(?=({'|'.join(branches)}))"), F.lit(1))
        known = F.create_map(*[F.lit(v) for pair in ranks.items() for v in pair])
        at = F.array_min(F.transform(F.array_distinct(found), lambda kw: F.element_at(known, kw)))
        best = F.least(at, best)  # least() skips a null: no keyword found
    best = F.when(low.isNotNull(), best)
    return F.coalesce(F.get(labels, best), F.lit(default))


def band(
    x: ColumnOrName,
    cuts: Sequence[tuple[float, str]],
    otherwise: str,
    null_label: str | None = None,
    strict: bool = False,
) -> Column:
    """``x >= cut`` (or ``>`` when ``strict``) checked in order; first hit wins.

    ``null_label`` is returned for a null ``x`` when given; otherwise a null falls to ``otherwise``
    (SQL ``CASE`` semantics: every comparison with null is false).
    """
    col = _c(x)
    expr = F.when(col.isNull(), F.lit(null_label)) if null_label is not None else None
    for cut, label in cuts:
        cond = (col > F.lit(cut)) if strict else (col >= F.lit(cut))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise)) if expr is not None else F.lit(otherwise)


def flag_at_least(x: ColumnOrName, threshold: float = K.HIGH_UPHOLD_THRESHOLD) -> Column:
    """0/1 flag ``x >= threshold``; a missing value counts as 0."""
    return F.coalesce((_c(x) >= F.lit(threshold)).cast("int"), F.lit(0))


def upheld_band(x: ColumnOrName) -> Column:
    return band(x, K.UPHELD_BANDS, K.UPHELD_BAND_OTHER, null_label=K.UPHELD_BAND_NULL)


def traffic_light(x: ColumnOrName) -> Column:
    """Red / amber / green on a mean uphold rate; a missing mean is green."""
    return band(x, K.TRAFFIC_LIGHT, K.TRAFFIC_LIGHT_OTHER)


def direction(x: ColumnOrName) -> Column:
    """Up / down / flat arrow of a change; null stays null."""
    col = _c(x)
    return F.when(col > 0, F.lit("▲")).when(col < 0, F.lit("▼")).when(col == 0, F.lit("▬"))


def replace_chain(x: ColumnOrName, pairs: Iterable[tuple[str, str]] = K.SHORT_NAME_REPLACEMENTS) -> Column:
    """Apply literal ``replace(a, b)`` rewrites in order, anywhere in the text."""
    col = _c(x)
    for a, b in pairs:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def unify_names(df: DataFrame, alias_map: Mapping[str, str] = K.NAME_ALIASES,
                column: str = K.FIRM) -> DataFrame:
    """Replace whole values of ``column`` by their canonical spelling (exact match)."""
    if not alias_map:
        return df
    return df.replace(dict(alias_map), subset=[column])


def harmonised_name(raw: str, rules=K.HEADER_RULES) -> str:
    """Pure name -> name rule for a sheet header (driver-side, runs once per column name)."""
    cl = str(raw).lower().strip()
    for kind, pats, target in rules:
        if kind == "in" and cl in pats:
            return target
        if kind == "contains" and any(p in cl for p in pats):
            return target
        if kind == "all" and all(p in cl for p in pats):
            return target
        if kind == "startswith" and any(cl.startswith(p) for p in pats):
            return target
    return raw
