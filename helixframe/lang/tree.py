"""The syntax tree: frozen nodes that know where they stand in the text (line, column)."""

from __future__ import annotations

from dataclasses import dataclass, field

At = tuple[int, int]


@dataclass(frozen=True)
class Node:
    at: At = field(compare=False)


@dataclass(frozen=True)
class Name(Node):
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Literal(Node):
    """A string, int, float, bool or None."""

    value: str | int | float | bool | None

    def __str__(self) -> str:
        if self.value is None:
            return "null"
        if isinstance(self.value, bool):
            return str(self.value).lower()
        return f"'{self.value}'" if isinstance(self.value, str) else f"{self.value}"


@dataclass(frozen=True)
class Cast(Node):
    operand: Node
    to: str

    def __str__(self) -> str:
        return f"{self.operand}::{self.to}"


@dataclass(frozen=True)
class Not(Node):
    operand: Node

    def __str__(self) -> str:
        return f"!{self.operand}"


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Call(Node):
    function: str
    positional: tuple[Node, ...]
    named: tuple[tuple[str, Node], ...]

    def __str__(self) -> str:
        args = [str(x) for x in self.positional] + [f"{n}:={x}" for n, x in self.named]
        return f"{self.function}({', '.join(args)})"


@dataclass(frozen=True)
class SetOf(Node):
    items: tuple[Node, ...]

    def __str__(self) -> str:
        return "{" + ", ".join(map(str, self.items)) + "}"


@dataclass(frozen=True)
class Record(Node):
    fields: tuple[tuple[str, Node], ...]

    def __str__(self) -> str:
        return "{" + ", ".join(f"{n}:={x}" for n, x in self.fields) + "}"
