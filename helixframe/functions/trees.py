"""Phylogenetic trees: Newick and Auspice readers, clade intervals, common ancestors and pruned subtrees.

Nodes are numbered in preorder, so a clade is an interval of numbers and a row needs one integer to be filtered by any node.
Nothing recurses: trees may be as deep as they like.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np

from helixframe.errors import InputError

_LABEL = r"A-Za-z0-9_.\-|/\\=@"
_PIECE = re.compile(rf"\s+|(?P<mark>[(),;:])|(?P<word>[{_LABEL}+]+)")


@dataclass
class Tree:
    names: list[str]  # in preorder, children as written
    parent: list[int]  # -1 for the root
    length: list[float | None]
    number: dict[str, int] = field(init=False)
    depth: list[int] = field(init=False)
    last: list[int] = field(init=False)  # largest number in the clade
    children: list[list[int]] = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.names)
        self.number = {x: k for k, x in enumerate(self.names)}
        self.depth, self.last, self.children = [0] * n, list(range(n)), [[] for _ in range(n)]
        for k in range(1, n):
            self.depth[k] = self.depth[self.parent[k]] + 1
            self.children[self.parent[k]].append(k)
        for k in range(n - 1, 0, -1):
            self.last[self.parent[k]] = max(self.last[self.parent[k]], self.last[k])

    def is_leaf(self, k: int) -> bool:
        return not self.children[k]

    def common(self, a: int, b: int) -> int:
        """The deepest node whose clade has both."""
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
        return a

    def subtree(self, chosen: set[int], contract: bool = True) -> str:
        """Newick text of the chosen leaves below their common ancestor; inner nodes with one branch are contracted."""
        if not chosen:
            return ""
        if len(chosen) == 1:
            return self.names[next(iter(chosen))] + ";"
        root = self.common(min(chosen), max(chosen))
        text: dict[int, tuple[str, float | None]] = {}
        for k in range(self.last[root], root - 1, -1):
            if self.is_leaf(k):
                if k in chosen:
                    text[k] = self.names[k], self.length[k]
                continue
            own = [text.pop(c) for c in self.children[k] if c in text]
            if not own:
                continue
            if len(own) == 1 and contract:
                text[k] = own[0][0], _sum(own[0][1], self.length[k])
            else:
                inner = ",".join(t if x is None else f"{t}:{np.float32(x):g}" for t, x in own)
                text[k] = f"({inner}){self.names[k]}", self.length[k]
        return text[root][0] + ";" if root in text else ";"

    @classmethod
    def from_newick(cls, text: str) -> Tree:
        try:
            return _newick(text)
        except InputError as e:
            short = text if len(text) <= 200 else text[:200] + "..."
            raise InputError(f"Error when parsing the Newick string '{short}': {e}") from None

    @classmethod
    def from_auspice(cls, text: str) -> Tree:
        loaded = json.loads(text)
        if "tree" not in loaded:
            raise InputError("Invalid File: Auspice JSON does not contain a 'tree' entry.")
        names, parent, length = [], [], []
        seen: set[str] = set()
        stack = [(loaded["tree"], -1)]
        while stack:
            node, up = stack.pop()
            if "name" not in node:
                raise InputError("Invalid File: Auspice JSON node does not contain a 'name' entry.")
            if node["name"] in seen:
                raise InputError(f"Duplicate node ID found in Auspice JSON string: '{node['name']}'")
            seen.add(node["name"])
            names.append(node["name"])
            parent.append(up)
            div = node.get("node_attrs", {}).get("div")
            length.append(None if div is None else float(np.float32(div)))
            # subtrees are printed with the children of this format in reverse
            stack += [(c, len(names) - 1) for c in node.get("children", [])]
        return cls(names, parent, length)

    @classmethod
    def from_file(cls, path: str, text: str) -> Tree:
        ending = path.lower().rpartition(".")[2]
        if ending == "nwk":
            return cls.from_newick(text)
        if ending == "json":
            try:
                return cls.from_auspice(text)
            except json.JSONDecodeError:
                raise InputError(f"The JSON file '{path}' does not contain valid JSON.") from None
        raise InputError(f"Error when parsing tree file: '{path}'. Path must end with .nwk or .json")


def _sum(a: float | None, b: float | None) -> float | None:
    if a is None or b is None:
        return b if a is None else a
    return float(np.float32(a) + np.float32(b))


def _without_comments(text: str) -> str:
    out, depth = [], 0
    for c in text:
        if c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if depth < 0:
                raise InputError("Error when parsing the Newick string - unmatched ']'")
        elif not depth:
            out.append(c)
    if depth:
        raise InputError("Error when parsing the Newick string - unmatched '['")
    return "".join(out)


def _newick(text: str) -> Tree:
    text = _without_comments(text).strip()
    if not text:
        raise InputError("Error when parsing the Newick string - The string is empty")
    if not text.endswith(";"):
        raise InputError("string does not end in ';'")
    # post-order pass: a stack of finished child lists; then numbered from the root
    groups: list[list[dict]] = [[]]
    node: dict | None = None
    place, wants_length = 0, False
    while place < len(text):
        m = _PIECE.match(text, place)
        if m is None:
            raise InputError(f"Newick string contains invalid characters: '{text[place]}'")
        place = m.end()
        mark, word = m["mark"], m["word"]
        if word is not None:
            if wants_length:
                try:
                    node["length"] = float(np.float32(float(word)))
                except ValueError:
                    raise InputError(f"Invalid branch length '{word}' in Newick string") from None
                wants_length = False
            elif (node is not None and node["name"] is not None) or "+" in word:
                raise InputError(f"Label of node in Newick string contains invalid characters: '{word}'")
            else:
                node = node or {"children": [], "length": None}
                node["name"] = word
        elif mark == ":":
            node, wants_length = node or {"children": [], "length": None, "name": ""}, True
        elif mark == "(":
            groups.append([])
        elif mark is not None:
            if wants_length:
                raise InputError("Invalid branch length '' in Newick string")
            node = node or {"children": [], "length": None, "name": ""}
            node["name"] = node["name"] or ""
            groups[-1].append(node)
            node = None
            if mark == ")":
                if len(groups) < 2:
                    raise InputError("Parenthesis mismatch in Newick string - depth does not match")
                node = {"children": groups.pop(), "length": None, "name": None}
            if mark == ";" and place < len(text):
                raise InputError(f"extra characters found: '{text[place:]}'")
    if len(groups) != 1 or len(groups[0]) != 1:
        raise InputError("Parenthesis mismatch in Newick string - depth does not match")
    names, parent, length = [], [], []
    seen: set[str] = set()
    stack = [(groups[0][0], -1)]
    while stack:
        node, up = stack.pop()
        if node["name"] in seen:
            raise InputError(f"Duplicate node ID found in Newick string: '{node['name']}'")
        seen.add(node["name"])
        names.append(node["name"])
        parent.append(up)
        length.append(node["length"])
        stack += [(c, len(names) - 1) for c in reversed(node["children"])]
    return Tree(names, parent, length)
