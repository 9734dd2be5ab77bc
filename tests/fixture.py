"""A small database of our own making: five catches with sequences, clades and a tree."""

from __future__ import annotations

import json

from helixframe.catalog.database import DEFAULT, Database
from helixframe.functions.trees import Tree

CONFIG = """
schema:
  instanceName: harbour log
  metadata:
    - {name: specimenId, type: string, isPhyloTreeField: true}
    - {name: seen, type: date}
    - {name: received, type: date}
    - {name: waters, type: string, generateIndex: true}
    - {name: nation, type: string, generateIndex: true}
    - {name: clade, type: string, generateIndex: true, generateLineageIndex: waters_of_old, lineageIndexType: both}
    - {name: harbour, type: string, generateIndex: true}
    - {name: dep, type: int}
    - {name: score, type: float}
    - {name: checked, type: boolean}
  primaryKey: specimenId
"""
REFERENCES = json.dumps({
    "nucleotideSequences": [{"name": "hull", "sequence": "TTGACCAT"}, {"name": "tail", "sequence": "GGCA"}],
    "genes": [{"name": "cap", "sequence": "MKLV*"}, {"name": "fin", "sequence": "MGHT*"}],
})
LINEAGES = """
Atlantic: {}
Baltic:
  aliases: [OLD.SEA]
Baltic.west:
  parents: [Baltic]
Mixed:
  parents: [Atlantic, Baltic]
"""
TREE = "((cod1, (cod2, cod3)pair)west, (cod4, cod5)east)sea;"

#: id, seen, received, harbour, depth, score, checked, clade, hull, tail, insertions of cap, fin
CATCHES = (
    ("cod1", "2018-02-11", None, "Halden", 12, 0.5, True, "Baltic.west", "ttgaccau", "GGCA", ["2:WY"], "MGHT*"),
    ("cod2", "2018-07-04", "2018-01-09", "Havn", 20, 0.45, False, "Baltic.west", "TAGNCAAN", "GACN", [], "MGHT*"),
    ("cod3", "2018-07-19", "2018-05-30", "Alta", 35, 0.4, None, "Mixed", "ttgaccau", "GGCA", [], "MGHT*"),
    ("cod4", "2018-06-28", "2017-11-02", "Havn", 12, 0.35, True, "Baltic.west", "ttgaccau", "GGCA", [], "MGHT*"),
    ("cod5", "2018-01-30", "2018-06-01", "Tromso", 90, 0.3, True, "Mixed", "ttgaccau", "GGCA", ["2:WY"], "XXXX*"),
)


def rows() -> list[dict]:
    names = ("specimenId", "seen", "received", "harbour", "dep", "score", "checked", "clade", "hull", "tail", "cap", "fin")
    out = []
    for catch in CATCHES:
        row = dict(zip(names, catch, strict=True)) | {"waters": "Skagerrak", "nation": "Norway", "unaligned_hull": "TTGACC", "unaligned_tail": None}
        row["cap"] = {"sequence": "MKLV*", "insertions": row["cap"]}
        out.append(row | {s: {"sequence": row[s], "insertions": []} for s in ("hull", "tail", "fin")})
    return out


def build(spark, strict: bool = False) -> Database:
    db = Database.initialize(CONFIG, REFERENCES, {"waters_of_old.yaml": LINEAGES}, Tree.from_newick(TREE), spark=spark, strict=strict)
    db.append_data_from_string(DEFAULT, "\n".join(map(json.dumps, rows())) + "\n\n")
    return db


def answer(db: Database, text: str) -> list[dict]:
    return [r.asDict() for r in db.query(text).collect()]
