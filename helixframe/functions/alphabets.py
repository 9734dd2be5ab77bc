"""Alphabets of aligned sequences: symbols, what ambiguity codes stand for, and what may stand for a symbol."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property


@dataclass(frozen=True)
class Alphabet:
    title: str  # as messages name it
    kind: str  # the column type
    symbols: str  # in output order
    mutations: str  # symbols that count as coverage and can be reported
    missing: str
    codes: tuple[tuple[str, str], ...]  # an ambiguity code and the symbols it stands for
    same: tuple[tuple[str, str], ...] = ()  # letters read as others

    @cached_property
    def stands_for(self) -> dict[str, frozenset[str]]:
        """Each symbol's possible symbols; the missing symbol stands for all."""
        own = {s: frozenset(s) for s in self.symbols} | {s: frozenset(x) for s, x in self.codes}
        return own | {self.missing: frozenset(self.symbols)}

    @cached_property
    def may_be(self) -> dict[str, frozenset[str]]:
        """Symbols that may stand for a given one: all it stands for, they stand for too."""
        return {s: frozenset(y for y in self.symbols if self.stands_for[s] <= self.stands_for[y]) for s in self.symbols}

    def read(self, letter: str) -> str | None:
        letter = dict(self.same).get(letter.upper(), letter.upper())
        return letter if len(letter) == 1 and letter in self.symbols else None


# The alphabets.
NUCLEOTIDE = Alphabet(
    "Nucleotide", "NUCLEOTIDE_SEQUENCE", "-ACGTRYSWKMBDHVN", "-ACGT", "N",
    (("R", "AG"), ("Y", "CT"), ("S", "GC"), ("W", "AT"), ("K", "GT"), ("M", "AC"), ("B", "CGT"), ("D", "AGT"), ("H", "ACT"), ("V", "ACG")), (("U", "T"),),
)
AMINO_ACID = Alphabet(
    "AminoAcid", "AMINO_ACID_SEQUENCE", "-ACDEFGHIKLMNOPQRSTUVWYBJZ*X", "-ACDEFGHIKLMNOPQRSTUVWY*", "X", (("B", "DN"), ("J", "LI"), ("Z", "QE"))
)
BY_KIND = {a.kind: a for a in (NUCLEOTIDE, AMINO_ACID)}
