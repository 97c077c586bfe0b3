"""Predicates of layers: AST, wire form, parser with a column whitelist, and Column expressions.

Wire form: '' (always true), (col='value'), ((p) AND (q)), ((p) OR (q)). Values compare as text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class PredicateError(ValueError):
    """A malformed predicate, or one on a column that may not be filtered."""


@dataclass(frozen=True)
class Everything:
    """The empty predicate: true for every row."""


@dataclass(frozen=True)
class Equals:
    column: str
    value: str


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


Predicate = Everything | Equals | Both | Either


def from_json(tree: dict | None) -> Predicate:
    """{'==': [col, val]}, {'AND': [p, q]}, {'OR': [p, q]}; {} and None are true."""
    if not tree:
        return Everything()
    if len(tree) != 1:
        raise PredicateError("a predicate has one operator")
    ((op, args),) = tree.items()
    if not isinstance(args, (list, tuple)) or len(args) != 2:
        raise PredicateError(f"{op} takes two arguments")
    if op == "==":
        return Equals(str(args[0]), str(args[1]))
    if op in ("AND", "OR"):
        return (Both if op == "AND" else Either)(from_json(args[0]), from_json(args[1]))
    raise PredicateError(f"unknown operator {op}")


def to_wire(p: Predicate) -> str:
    match p:
        case Everything():
            return ""
        case Equals(c, v):
            if "'" in v:
                raise PredicateError("a value may not hold a quote")
            return f"({c}='{v}')"
        case Both(a, b) | Either(a, b):
            x, y = to_wire(a), to_wire(b)
            if not x or not y:  # true AND q = q; true OR q = true
                return (x or y) if isinstance(p, Both) else ""
            return f"({x} {'AND' if isinstance(p, Both) else 'OR'} {y})"


def parse_wire(text: str, columns: list[str]) -> Predicate:
    """Parse the wire form; columns is the whitelist, matched without regard to case. Quotes inside values are refused."""
    allowed = {c.lower(): c for c in columns}
    text = text.strip()
    if not text:
        return Everything()
    pos = 0

    def blanks() -> None:
        nonlocal pos
        while pos < len(text) and text[pos] == " ":
            pos += 1

    def take(token: str) -> bool:
        nonlocal pos
        blanks()
        if text[pos : pos + len(token)].upper() == token:
            pos += len(token)
            return True
        return False

    def node() -> Predicate:
        nonlocal pos
        if not take("("):
            raise PredicateError("a predicate is wholly parenthesised")
        blanks()
        if text[pos : pos + 1] == "(":
            left = node()
            while not take(")"):
                kind = Both if take("AND") else Either if take("OR") else None
                if kind is None:
                    raise PredicateError("AND or OR expected")
                left = kind(left, node())
            return left
        end = text.find("=", pos)
        if end < 0:
            raise PredicateError("= expected")
        name = text[pos:end].strip()
        if name.lower() not in allowed:
            raise PredicateError(f"{name!r} is not a column that may be filtered")
        pos = end + 1
        blanks()
        close = text.find("'", pos + 1)
        if text[pos : pos + 1] != "'" or close < 0:
            raise PredicateError("a value stands in single quotes")
        value = text[pos + 1 : close]
        pos = close + 1
        if not take(")"):
            raise PredicateError("a value may not hold a quote")
        return Equals(allowed[name.lower()], value)

    p = node()
    blanks()
    if pos != len(text):
        raise PredicateError("something follows the predicate")
    return p


def to_column(p: Predicate) -> Column:
    """Text equality, as the wire has no types; null columns never match."""
    match p:
        case Everything():
            return F.lit(True)
        case Equals(c, v):
            return F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False))
        case Both(a, b):
            return to_column(a) & to_column(b)
        case Either(a, b):
            return to_column(a) | to_column(b)


def holds(p: Predicate, row: dict) -> bool:
    """Evaluation of one row on the driver, for highlights."""
    match p:
        case Everything():
            return True
        case Equals(c, v):
            return row.get(c) is not None and str(row[c]) == v
        case Both(a, b):
            return holds(a, row) and holds(b, row)
        case Either(a, b):
            return holds(a, row) or holds(b, row)


def check_columns(p: Predicate, columns: list[str]) -> None:
    match p:
        case Equals(c, _):
            if c.lower() not in {x.lower() for x in columns}:
                raise PredicateError(f"{c!r} is not a column that may be filtered")
        case Both(a, b) | Either(a, b):
            check_columns(a, columns)
            check_columns(b, columns)
