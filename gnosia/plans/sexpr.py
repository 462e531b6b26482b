"""S-expressions: the text form of terms, assertions and queries.

A parsed expression is a string (constant, variable, literal) or a tuple of expressions. Its canonical text has single
spaces, no `#$`, and bare numbers quoted ('5), which is the join key everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Expr = "str | tuple"
_TOKEN = re.compile(r"""\s*(?:(\()|(\))|("(?:[^"\\]|\\.)*")|((?:[^\s()"])+))""")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE]-?\d+)?")


class SyntaxFault(ValueError):
    """Text that is not one S-expression."""


def parse(text: str, quote_numbers: bool = True):
    """One S-expression; raises SyntaxFault for anything else."""
    stack: list[list] = [[]]
    at = 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SyntaxFault(f"unreadable at {at}: {text[at : at + 20]!r}")
        at = m.end()
        opened, closed, string, atom = m.groups()
        if opened:
            stack.append([])
        elif closed:
            if len(stack) == 1:
                raise SyntaxFault("a closing parenthesis too many")
            done = tuple(stack.pop())
            if not done:
                raise SyntaxFault("an empty list")
            stack[-1].append(done)
        elif string:
            stack[-1].append(string)
        else:
            atom = atom.removeprefix("#$")
            stack[-1].append(f"'{atom}" if quote_numbers and _NUMBER.fullmatch(atom) else atom)
    if len(stack) != 1 or len(stack[0]) != 1:
        raise SyntaxFault("not exactly one expression")
    return stack[0][0]


def text(expr) -> str:
    """Canonical text."""
    return expr if isinstance(expr, str) else "(" + " ".join(map(text, expr)) + ")"


def is_variable(expr) -> bool:
    return isinstance(expr, str) and expr.startswith("?")


def variables(expr) -> list[str]:
    """Variables in order of first use."""
    return list(dict.fromkeys(_variables(expr)))


def _variables(expr) -> Iterator[str]:
    if is_variable(expr):
        yield expr
    elif isinstance(expr, tuple):
        for x in expr:
            yield from _variables(x)


def substitute(expr, values: dict[str, object]):
    """Replace variables, in nested terms too."""
    if isinstance(expr, tuple):
        return tuple(substitute(x, values) for x in expr)
    return values.get(expr, expr)


def invert(values: dict[str, str]) -> dict[str, str]:
    """The substitution that undoes one between variables."""
    return {v: k for k, v in values.items()}


def unwrap(expr) -> tuple[tuple, int, bool]:
    """(edge, sign, removed) of an assertion, without its `not` and `removed`."""
    sign, removed = 1, False
    while isinstance(expr, tuple) and len(expr) == 2 and expr[0] in ("not", "removed") and isinstance(expr[1], tuple):
        if expr[0] == "not":
            sign = -sign
        else:
            removed = True
        expr = expr[1]
    return expr, sign, removed


def paths(expr: tuple) -> list[tuple[str, int, str]]:
    """(path, depth, term) of every position: `1` is the predicate, `3F1` the first term inside argument three."""
    out: list[tuple[str, int, str]] = []

    def walk(nodes: tuple, before: str, depth: int) -> None:
        for i, x in enumerate(nodes, 1):
            out.append((f"{before}{i}", depth, text(x)))
            if isinstance(x, tuple):
                walk(x, f"{before}{i}F", depth + 1)

    walk(expr, "", 0)
    return out


def split_terms(term: str) -> list[str]:
    """Top-level parts of a functional term's text; one part for anything else."""
    if not term.startswith("("):
        return [term]
    got = parse(term)
    return [text(x) for x in got] if isinstance(got, tuple) else [term]
