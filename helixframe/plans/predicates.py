"""Predicates: sets of rows, compiled to Column expressions in negation normal form.

A filter is a set of rows and ``!`` its complement, so a row with a null is in exactly one of the two.  Every leaf gives a form
for the set and one for its complement (``c IS NULL OR c <> v``), and both reach the Parquet reader; nothing wraps a comparison.  Ambiguity modes travel down: ``maybe``
widens, ``exact`` resets, and each negation swaps the two.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.errors import IllegalQuery, require
from helixframe.functions.alphabets import Alphabet
from helixframe.plans.relation import quoted

PLAIN, UPPER, LOWER = "plain", "upper", "lower"
_SWAP = {PLAIN: PLAIN, UPPER: LOWER, LOWER: UPPER}
#: Sequences up to this length are compared by a native sum, longer ones in Python workers.
NATIVE_PROFILE = 64


class Predicate:
    def column(self, negate: bool = False, mode: str = PLAIN) -> Column:
        """A condition that is true for the rows of the set (of its complement); false or null for others."""
        raise NotImplementedError


def _all(columns: list[Column], join: Callable) -> Column:
    """A balanced tree: the plan stays shallow whatever the number of terms."""
    while len(columns) > 1:
        columns = [join(columns[k], columns[k + 1]) if k + 1 < len(columns) else columns[k] for k in range(0, len(columns), 2)]
    return columns[0]


@dataclass
class Constant(Predicate):
    value: bool

    def column(self, negate=False, mode=PLAIN):
        return F.lit(self.value != negate)


@dataclass
class Compare(Predicate):
    name: str
    op: str  # = < <= > >=
    value: object

    def column(self, negate=False, mode=PLAIN):
        c = F.col(quoted(self.name))
        v = F.lit(self.value)
        if self.op == "=":
            return c.isNull() | (c != v) if negate else c == v
        forms = {"<": (c < v, c >= v), "<=": (c <= v, c > v), ">": (c > v, c <= v), ">=": (c >= v, c < v)}
        yes, no = forms[self.op]
        if negate and isinstance(self.value, float) and np.isnan(self.value):
            return F.lit(True)
        return c.isNull() | no if negate else yes


@dataclass
class Between(Predicate):
    name: str
    low: object
    high: object
    open_end: bool = False

    def column(self, negate=False, mode=PLAIN):
        c = F.col(quoted(self.name))
        if negate:
            out = [c.isNull()]
            out += [c < F.lit(self.low)] if self.low is not None else []
            out += [(c >= F.lit(self.high)) if self.open_end else (c > F.lit(self.high))] if self.high is not None else []
            return reduce(Column.__or__, out)
        parts = [c >= F.lit(self.low)] if self.low is not None else []
        parts += [(c < F.lit(self.high)) if self.open_end else (c <= F.lit(self.high))] if self.high is not None else []
        return reduce(Column.__and__, parts) if parts else c.isNotNull()


@dataclass
class In(Predicate):
    name: str
    values: frozenset

    def column(self, negate=False, mode=PLAIN):
        c, values = F.col(quoted(self.name)), sorted(self.values)
        if not values:
            return F.lit(negate)
        return c.isNull() | ~c.isin(values) if negate else c.isin(values)


@dataclass
class IsNull(Predicate):
    name: str

    def column(self, negate=False, mode=PLAIN):
        c = F.col(quoted(self.name))
        return c.isNotNull() if negate else c.isNull()


@dataclass
class Like(Predicate):
    name: str
    pattern: str

    def column(self, negate=False, mode=PLAIN):
        c = F.col(quoted(self.name))
        return c.isNull() | ~c.rlike(self.pattern) if negate else c.rlike(self.pattern)


@dataclass
class Symbols(Predicate):
    """The symbol at a position (from 1) is in a set; the set may depend on the mode."""

    name: str
    position: int
    chosen: Callable[[str], frozenset]

    def column(self, negate=False, mode=PLAIN):
        return symbol_condition(self.name, self.position, self.chosen(mode), negate)


def symbol_text(name: str, position: int, symbols: frozenset, negate: bool = False) -> str:
    """The condition as SQL: symbols are letters, ``-`` or ``*``, and one text is quicker to hand over than many literals."""
    if not symbols:
        return str(negate).lower()
    values = ", ".join(f"'{s}'" for s in sorted(symbols))
    test = f"substring({quoted(name)}, {position}, 1) {'NOT IN' if negate else 'IN'} ({values})"
    return f"({quoted(name)} IS NULL OR {test})" if negate else test


def symbol_condition(name: str, position: int, symbols: frozenset, negate: bool) -> Column:
    return F.expr(symbol_text(name, position, symbols, negate))


@dataclass
class InsertionContains(Predicate):
    column_name: str
    position: int
    pattern: str

    def column(self, negate=False, mode=PLAIN):
        whole = f"^(?:{self.pattern})$"
        found = F.exists(F.col(quoted(self.column_name)), lambda x: (x["pos"] == self.position) & x["ins"].rlike(whole))
        return ~F.coalesce(found, F.lit(False)) if negate else found


@dataclass
class Complement(Predicate):
    child: Predicate

    def column(self, negate=False, mode=PLAIN):
        return self.child.column(not negate, _SWAP[mode])


@dataclass
class Mode(Predicate):
    child: Predicate
    mode: str

    def column(self, negate=False, mode=PLAIN):
        return self.child.column(negate, self.mode)


def _flat(kind: type, children: list[Predicate]) -> list[Predicate]:
    out = []
    for c in children:
        out += _flat(kind, c.children) if isinstance(c, kind) else [c]
    return out


@dataclass
class All(Predicate):
    children: list[Predicate]

    def column(self, negate=False, mode=PLAIN):
        if negate:
            return _any(_flat(All, self.children), True, mode)
        return _all([c.column(False, mode) for c in _flat(All, self.children)], Column.__and__)


@dataclass
class Any(Predicate):
    children: list[Predicate]

    def column(self, negate=False, mode=PLAIN):
        if negate:
            return _all([c.column(True, mode) for c in _merged(_flat(Any, self.children), mode)], Column.__and__)
        return _any(_flat(Any, self.children), False, mode)


def _any(children: list[Predicate], negate: bool, mode: str) -> Column:
    if not negate:
        children = _merged(children, mode)
    return _all([c.column(negate, mode) for c in children], Column.__or__)


def _merged(children: list[Predicate], mode: str) -> list[Predicate]:
    """Symbols at one position, and equal strings of one column, become one set each."""
    out: list[Predicate] = []
    symbols: dict[tuple[str, int], set] = {}
    values: dict[str, set] = {}
    for c in children:
        if isinstance(c, Symbols):
            symbols.setdefault((c.name, c.position), set()).update(c.chosen(mode))
        elif isinstance(c, In) or (isinstance(c, Compare) and c.op == "=" and isinstance(c.value, str)):
            values.setdefault(c.name, set()).update(c.values if isinstance(c, In) else [c.value])
        else:
            out.append(c)
    out += [Symbols(n, p, lambda _, s=frozenset(s): s) for (n, p), s in symbols.items()]
    return out + [In(n, frozenset(v)) if len(v) != 1 else Compare(n, "=", next(iter(v))) for n, v in values.items()]


@dataclass
class NOf(Predicate):
    n: int
    children: list[Predicate]
    exactly: bool

    def column(self, negate=False, mode=PLAIN):
        k = len(self.children)
        if not self.exactly and self.n <= 0:
            return F.lit(not negate)
        if self.n > k or self.n < 0:
            return F.lit(negate)
        if self.n == k and k:
            return All(self.children).column(negate, mode)
        if self.n == 1 and not self.exactly:
            return Any(self.children).column(negate, mode)
        if self.n == 0:
            return Any(self.children).column(not negate, mode) if k else F.lit(not negate)
        hits = _all([F.coalesce(c.column(False, mode), F.lit(False)).cast("int") for c in self.children], Column.__add__)
        inside = hits == self.n if self.exactly else hits >= self.n
        return ~inside if negate else inside


@dataclass
class Profile(Predicate):
    """At most ``distance`` symbols of the sequence can't stand for the profile's; null sequences are in the set."""

    name: str
    profile: str
    distance: int
    alphabet: Alphabet

    def column(self, negate=False, mode=PLAIN):
        c = F.col(quoted(self.name))
        near = F.coalesce(self._distance(c) <= self.distance, F.lit(True))
        return ~near if negate else near

    def _distance(self, c: Column) -> Column:
        told = [(k, s) for k, s in enumerate(self.profile) if s != self.alphabet.missing]
        if not told:
            return F.lit(0)
        if len(self.profile) <= NATIVE_PROFILE:
            every = frozenset(self.alphabet.symbols)
            # bound to a lambda's variable, so that a computed sequence is made once a row and not once a symbol
            tests = " + ".join(f"CAST({symbol_text('x', k + 1, every - self.alphabet.may_be[s])} AS INT)" for k, s in told)
            return F.expr(f"transform(array({quoted(self.name)}), x -> {tests})[0]")
        return profile_distance(self.profile, self.alphabet)(c)


def profile_distance(profile: str, alphabet: Alphabet):
    """A UDF: how many symbols of a sequence can't stand for the profile's (null for a null sequence).

    A worker gets 100 rows at a time. An Arrow batch has 10,000, so what a worker holds would follow their length, in several copies.
    """
    kinds = [p for p in dict.fromkeys(profile) if p != alphabet.missing]
    passes = []
    for k in range(0, len(kinds), 8):  # a bit for each kind of symbol
        bits = {p: 1 << i for i, p in enumerate(kinds[k : k + 8])}
        unfit = bytes(sum(bit for p, bit in bits.items() if chr(x) not in alphabet.may_be[p]) for x in range(256))
        passes.append((unfit, np.array([bits.get(p, 0) for p in profile], np.uint8)))

    def distance(text: str | None) -> int | None:
        if text is None:
            return None
        data = text.encode()
        return sum(int(np.count_nonzero(np.frombuffer(data.translate(unfit), np.uint8).reshape(own.shape) & own)) for unfit, own in passes)

    return F.udf(distance, "int", useArrow=False)


def check_regex(pattern: str) -> None:
    """Patterns are those of a linear-time engine: no look-around, no back-references, nothing that repeats twice."""
    message = "Invalid Regular Expression. The parsing of the regular expression failed with the error '{}'. See https://github.com/google/re2/wiki/Syntax for a Syntax specification."
    if re.search(r"(?<!\\)(?:\\\\)*\\$", pattern):
        raise IllegalQuery(message.format("trailing \\"))
    if m := re.search(r"\(\?(?:[=!>]|<[=!])", pattern):
        raise IllegalQuery(message.format(f"invalid perl operator: {m[0]}"))
    if m := re.search(r"(?<!\\)(?:\\\\)*(\\[1-9])", pattern):
        raise IllegalQuery(message.format(f"invalid escape sequence: {m[1]}"))
    try:
        re.compile(pattern)
    except re.error as e:
        text = {"missing ), unterminated subpattern": f"missing ): {pattern}", "unbalanced parenthesis": f"unexpected ): {pattern}", "nothing to repeat": f"no argument for repetition operator: {pattern[e.pos or 0 :][:1]}"}
        raise IllegalQuery(message.format(text.get(e.msg, e.msg))) from None


def typed(kind: str | None, name: str, value: object) -> object:
    """A literal as a column's value; nothing is converted between kinds of numbers."""
    kinds = {bool: ("bool", ("BOOL",)), int: ("int", ("INT32", "INT64")), float: ("float", ("FLOAT",)), str: ("string", ("STRING", "DICTIONARY_ENCODED")), datetime.date: ("date", ("DATE32",))}
    title, fits = kinds[type(value)]
    require(kind in fits, f"The column '{name}' is not of type {title}")
    if kind == "INT32":
        require(-(1 << 31) <= value < 1 << 31, f"Cannot cast {value} to int32. Value out of range")
    return value
