"""Scans of the positional index: which edges hold which terms where.

A condition is (term, position): `k` the k-th place (1 is the predicate), `3F1` inside a functional term, `-k` edges
without the term at k, `!k` any other place of the same depth, `F` only inside functional terms, `-F` never inside, and
None anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gnosia.model import is_function, positions
from gnosia.operators.tables import written as checkpointed
from gnosia.plans import sexpr


def holding(term: str) -> Column:
    """Whether the text of an edge has all names, numbers and strings of a term; true wherever the term occurs at all."""
    words = {w.removeprefix("'") for w in re.findall(r"\"(?:[^\"\\]|\\.)*\"|[^\s()\"]+", term)}
    whole, out = F.array_join(F.concat(F.array("pred"), "args"), " "), F.lit(True)
    for w in sorted(words):
        out &= whole.contains(w)
        if not w.startswith('"'):
            out &= whole.rlike(r"(?:^|[\s()\"'$])" + re.escape(w) + r"(?:$|[\s()\"])")
    return out


def find(edges: DataFrame, conditions: Sequence[tuple[str, str | int | None]], index: DataFrame | None = None) -> DataFrame:
    """Edges that meet all conditions; each is a semi-join or anti-join with the index.

    Only edges whose text holds the terms that must occur are written and parsed.
    """
    needed = [holding(term) for term, where in conditions if where is None or not str(where).startswith("-") or str(where) == "-F"]
    if needed:
        edges = checkpointed(edges.where(reduce(Column.__and__, needed)))
    index = positions(edges) if index is None else index
    out = edges
    for term, where in conditions:
        pos = None if where is None else str(where)
        rows = index.where(F.col("term") == term)
        if pos is None:
            out = out.join(rows.select("edge_id"), "edge_id", "left_semi")
        elif pos == "F":
            out = out.join(rows.where("depth > 0").select("edge_id"), "edge_id", "left_semi")
        elif pos == "-F":
            out = out.join(rows.select("edge_id"), "edge_id", "left_semi").join(rows.where("depth > 0").select("edge_id"), "edge_id", "left_anti")
        elif pos.startswith("-"):
            out = out.join(rows.where(F.col("path") == pos[1:]).select("edge_id"), "edge_id", "left_anti")
        elif pos.startswith("!"):
            depth = pos.count("F")
            out = out.join(rows.where((F.col("path") != pos[1:]) & (F.col("depth") == depth)).select("edge_id"), "edge_id", "left_semi")
        else:
            out = out.join(rows.where(F.col("path") == pos).select("edge_id"), "edge_id", "left_semi")
    return out


def find_text(edges: DataFrame, text: str, index: DataFrame | None = None) -> DataFrame:
    """find() from its surface form: terms each followed by an optional position in parentheses, such as `Dog (2) isa (-1)`."""
    parts = re.findall(r"\(\s*([-!]?[0-9F]+)\s*\)|(\((?:[^()]|\([^()]*\))*\)|\"[^\"]*\"|[^\s()]+)", text)
    conditions: list[list] = []
    for pos, term in parts:
        if pos:
            conditions[-1][1] = pos
        else:
            conditions.append([sexpr.text(sexpr.parse(term)), None])
    return find(edges, [tuple(c) for c in conditions], index)


def in_microtheory(edges: DataFrame, mt: str) -> DataFrame:
    return edges.where(F.col("mt") == mt)


def inside_functions(index: DataFrame, term: str, only: bool = True) -> DataFrame:
    """edge_id of edges that hold the term inside (or, not only, outside) functional terms."""
    return index.where((F.col("term") == term) & ((F.col("depth") > 0) if only else (F.col("depth") == 0))).select("edge_id").distinct()


def functional_terms(index: DataFrame, func: str) -> DataFrame:
    """(term): all terms built with a function, nested ones too."""
    return index.where(is_function(F.col("term")) & F.col("term").startswith(f"({func} ")).select("term").distinct()


def at_depth(depths: DataFrame, depth: int) -> DataFrame:
    return depths.where(F.col("depth") == depth).select("term")
