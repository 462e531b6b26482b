"""Text of concepts and assertions, and concept names from text."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gnosia.plans import sexpr

#: A space goes before a capital or digit after a small letter, and before a capital that begins a word.
_CAMEL = r"(?<=\p{Ll})(?=[\p{Lu}\p{Nd}])|(?<=[^\s(])(?=\p{Lu}\p{Ll})"
_SUFFIX = r"(?s)^(.*)-([^-]+)$"
WHAT = "what things"


def camel_to_normal(name: Column) -> Column:
    return F.regexp_replace(name, _CAMEL, " ")


def concept_to_text(name: Column) -> Column:
    """`_` is a space, a last `-x` becomes ` (x)`, camel case is split."""
    return camel_to_normal(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), _SUFFIX, "$1 ($2)"))


#: A part of a template and what it becomes when negated (fixed values); the first part that is there counts.
NEGATIONS = (("(is)/(are)/", "(is)/(are)/ not"), ("(has)/(have)/", "(does not have)/(do not have)/"))


def negate(template: Column) -> Column:
    """A predicate template made negative."""
    out = F.when(template.contains(" is "), F.regexp_replace(template, r"(?s)^(.*?) is ", "$1 is not ")).otherwise(F.concat(template, F.lit(" is not true")))
    for part, negative in reversed(NEGATIONS):
        out = F.when(template.contains(part), F.replace(template, F.lit(part), F.lit(negative))).otherwise(out)
    return out


def negated(template: str) -> str:
    """negate() of one template."""
    for part, negative in NEGATIONS:
        if part in template:
            return template.replace(part, negative)
    return template.replace(" is ", " is not ", 1) if " is " in template else template + " is not true"


def shortest(text: Column) -> Column:
    """Aggregate: the shortest string, the least among equally short ones."""
    return F.min_by(text, F.struct(F.length(text), text))


def sentences(edges: DataFrame, templates: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Add `sentence` to a table of binary edges. templates: (pred, template); names: (term, name), plain words where there is none."""
    t = templates.groupBy("pred").agg(F.min("template").alias("template"))
    out = edges.join(t, "pred", "left")
    for i in (1, 2):
        plain_words = concept_to_text(F.col(f"arg{i}"))
        if names is None:
            out = out.withColumn(f"__n{i}", plain_words)
        else:
            n = names.groupBy(F.col("term").alias(f"arg{i}")).agg(F.min("name").alias(f"__n{i}"))
            out = out.join(n, f"arg{i}", "left").withColumn(f"__n{i}", F.coalesce(f"__n{i}", plain_words))
    said = F.when(F.col("sign") < 0, negate(F.col("template"))).otherwise(F.col("template"))
    said = F.regexp_replace(said, r"/\d+\((.+?)\)/\((.+?)\)/", "$1")
    said = F.replace(F.replace(said, F.lit("$1"), F.col("__n1")), F.lit("$2"), F.col("__n2"))
    bare = F.concat("__n1", F.when(F.col("sign") < 0, " does not have '").otherwise(" has '"), "pred", F.lit("' relation to "), "__n2")
    whole = F.concat(F.when(F.col("removed"), "Removed: ").otherwise(""), F.coalesce(said, bare))
    return out.select(*edges.columns, whole.alias("sentence"))


#: Characters spelled out (fixed values).
SPELLED = {"°": " degrees ", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "–": "-", "—": "-", "’": "'"}


def to_ascii(text: str) -> str:
    bare = re.sub("[̀-ͯ]+", "", unicodedata.normalize("NFD", text))
    return "".join(c if ord(c) < 128 else SPELLED.get(c, "?") for c in bare)


class _Spelling(dict):
    """Characters of a concept name by what they become; all others part words."""

    def __missing__(self, code: int) -> str:
        return " "


_SPELLING = _Spelling({ord(c): c for c in string.ascii_letters + string.digits + "-"} | {ord(c): "" for c in "!'."})
_SPELLING |= {ord(c): w for c, w in (("&", " And "), ("@", " At "), ("+", " Plus "), ("(", "- "), (")", "- "))}


def text_to_concept(text: str) -> str:
    """A concept name: ASCII, punctuation spelled or dropped, words capitalised and joined; of exclamation marks alone, their word."""
    text = to_ascii(text)
    if not text.strip("!"):
        return "Exclm" * len(text)
    return "".join(w[0].upper() + w[1:] for w in text.translate(_SPELLING).split()).strip("-")


@F.pandas_udf(T.StringType())
def concept_name(text: pd.Series) -> pd.Series:
    """text_to_concept() of a column."""
    return text.map(text_to_concept, na_action="ignore")


@F.pandas_udf(T.StringType())
def ascii_text(text: pd.Series) -> pd.Series:
    return text.map(to_ascii, na_action="ignore")


_CAMEL_PY = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z0-9])|(?<=[^\s(])(?=[A-Z][a-z])")


def plain(name: str) -> str:
    """concept_to_text() of one name."""
    m = re.fullmatch(r"(?s)(.*)-([^-]+)", name.replace("_", " "))
    return _CAMEL_PY.sub(" ", f"{m[1]} ({m[2]})" if m else name.replace("_", " "))


class Writer:
    """Text of terms, assertions and queries, from looked-up strings.

    names: term -> preferred string (canonical string, one of its sub-predicates, or shortest term string), without
    quotes; templates: predicate -> text template with $1, $2 and /n(singular)/(plural)/.
    """

    def __init__(self, names: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> None:
        self.names, self.templates = names or {}, templates or {}

    def term(self, expr, markup: bool = False) -> str:
        key = sexpr.text(expr)
        if key.startswith('"'):
            return key
        if key.startswith("'"):
            return key[1:]
        out = self._term(expr, key)
        return f"[[{key}|{out}]]" if markup and not (out.startswith("<") and out.endswith(">")) else out

    def _term(self, expr, key: str) -> str:
        if key in self.names:
            return self.names[key]
        if not isinstance(expr, tuple):
            return plain(key)
        func, *args = (self.term(x) for x in expr)
        whole = " & ".join(args)
        if "___" in func:  # the function's name has a place for its arguments
            return re.sub("___+", lambda _: whole, func)
        kind = func.removesuffix(" Fn")
        return f"{whole[:-1]}, {kind})" if whole.endswith(")") else f"{whole} ({kind})"

    def sentence(self, expr, query: bool = False, show_variables: bool = False, markup: bool = False) -> str:
        """An assertion, or the question that a query asks."""
        expr, sign, removed = sexpr.unwrap(expr)
        if expr[0] in ("and", "or"):
            parts = [self.sentence(x, query, True, markup).removesuffix("?") for x in expr[1:]]
            return f" {expr[0].upper()} ".join(parts) + "?" * query
        proof = query and not sexpr.variables(expr)
        args = [f"'{sexpr.text(expr[0])}'"]
        for x in expr[1:]:
            args.append((f"{WHAT} {x}" if show_variables else WHAT) if sexpr.is_variable(x) else self.term(x, markup))
        template = self.templates.get(sexpr.text(expr[0]))
        prefix = "Removed: " * removed
        if template is None:
            verb = "does " if proof else ""
            no = (" not" if query else " does not") if sign < 0 else ""
            have = " have " if sign < 0 or proof or (query and sexpr.is_variable(expr[1])) else " has "
            rest = [" to " + a if i == 0 else (" and " if i == len(args) - 3 else ", ") + a for i, a in enumerate(args[2:])]
            return f"{prefix}{verb}{args[1]}{no}{have}{args[0]} relation{''.join(rest)}" + "?" * query
        out = prefix + (self._negated(template) if sign < 0 else template)
        if proof:
            out = "is " + re.sub(r" ?/\d+\((.+?)\)/\((.+?)\)/ ?", " ", out, count=1)
        out = re.sub(r"/(\d+)\((.+?)\)/\((.+?)\)/", lambda m: m[3] if args[int(m[1])].startswith(WHAT) else m[2], out)
        return re.sub(r"\$(\d+)", lambda m: args[int(m[1])] if int(m[1]) < len(args) else m[0], out) + "?" * query

    _negated = staticmethod(negated)

    def markup(self, text: str, known: Callable[[str], bool] = lambda _: True, markup: bool = False) -> str:
        """Replace each [[term]] or [[term|text]] by the term's text."""

        def one(m: re.Match) -> str:
            inner = self.term(sexpr.parse(m[1])) if known(m[1]) else m[1]
            return f"[[{m[1]}|{inner}]]" if markup else inner

        return re.sub(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]", one, text)
