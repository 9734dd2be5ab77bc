"""Database configuration (YAML), reference sequences (JSON) and the table schema that follows from them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from helixframe.errors import ConfigError, InputError
from helixframe.functions.alphabets import AMINO_ACID, NUCLEOTIDE, Alphabet
from helixframe.plans.relation import Field

#: Types of a configuration and the column kinds they give (fixed values).
TYPES = {"string": "STRING", "date": "DATE32", "boolean": "BOOL", "int": "INT32", "int32": "INT32", "int64": "INT64", "float": "FLOAT"}
LINEAGE_INDEX_TYPES = ("columnMetadata", "table", "both")
UNALIGNED = "unaligned_"


@dataclass(frozen=True)
class Metadata:
    name: str
    type: str
    indexed: bool = False
    lineage: str | None = None
    lineage_index: str = "columnMetadata"
    tree: bool = False
    lenient: bool = False

    @property
    def kind(self) -> str:
        return "DICTIONARY_ENCODED" if self.indexed else TYPES[self.type]


@dataclass(frozen=True)
class Config:
    instance: str
    primary_key: str
    metadata: tuple[Metadata, ...]

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        import yaml

        try:
            schema = yaml.safe_load(text)["schema"]
            own = tuple(cls._entry(m) for m in schema.get("metadata") or ())
            config = cls(str(schema["instanceName"]), str(schema["primaryKey"]), own)
        except (yaml.YAMLError, KeyError, TypeError) as e:
            raise ConfigError(f"Failed to read database config: {e}") from None
        config.check()
        return config

    @staticmethod
    def _entry(m: dict) -> Metadata:
        kind = str(m["type"])
        if kind not in TYPES:
            raise ConfigError(f"Unknown metadata type: {kind}")
        index = str(m.get("lineageIndexType", "columnMetadata"))
        if index not in LINEAGE_INDEX_TYPES:
            raise ConfigError(f"Unknown lineageIndexType: '{index}'. Must be one of 'columnMetadata', 'table', 'both'.")
        lineage = m.get("generateLineageIndex")
        return Metadata(str(m["name"]), kind, bool(m.get("generateIndex", False)), None if lineage is None else str(lineage), index, bool(m.get("isPhyloTreeField", False)), bool(m.get("treatUnknownLineagesAsNull", False)))

    def check(self) -> None:
        seen: set[str] = set()
        for m in self.metadata:
            if m.name in seen:
                raise ConfigError(f"Metadata {m.name} is defined twice in the config")
            seen.add(m.name)
            text = m.type == "string"
            faults = (
                (not text and m.lineage is not None, "generateLineageIndex is set, but the column is not of type STRING."),
                (not text and m.tree, "isPhyloTreeField is set, but the column is not of type STRING."),
                (not text and m.indexed, "generateIndex is set, but generating an index is only allowed for types STRING"),
                (not m.indexed and m.lineage is not None, "generateLineageIndex is set, generateIndex must also be set."),
                (m.lineage is None and m.lineage_index != "columnMetadata", f"lineageIndexType is set to '{m.lineage_index}', but generateLineageIndex is not set."),
                (m.indexed and m.tree, "isPhyloTreeField and generateIndex are both set, if isPhyloTreeField is set then generateIndex cannot be set."),
            )
            for wrong, message in faults:
                if wrong:
                    raise ConfigError(f"Metadata '{m.name}' {message}")
        if not self.metadata:
            raise ConfigError("Database config without fields not possible")
        if self.primary_key not in seen:
            raise ConfigError("Primary key is not in metadata")


@dataclass(frozen=True)
class References:
    nucleotides: dict[str, str] = field(default_factory=dict)
    genes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> References:
        try:
            loaded = json.loads(text)
            own = [{str(e["name"]): read_reference(str(e["sequence"]), a) for e in loaded.get(key, [])} for key, a in (("nucleotideSequences", NUCLEOTIDE), ("genes", AMINO_ACID))]
        except (json.JSONDecodeError, KeyError, TypeError, AttributeError) as e:
            raise InputError(f"The reference genomes are not as expected: {e}") from None
        return cls(*own)


def read_reference(text: str, alphabet: Alphabet) -> str:
    own = [alphabet.read(c) for c in text]
    if None in own:
        raise InputError(f"Illegal {alphabet.title} character '{text[own.index(None)]}' in the reference sequence")
    return "".join(own)


def table_fields(config: Config, references: References, unaligned: bool = True) -> list[Field]:
    key = next(m for m in config.metadata if m.name == config.primary_key)
    if key.kind != "STRING":
        raise ConfigError(f"The primary key must be of type STRING but it is of type {key.kind}")
    out = [Field(m.name, m.kind) for m in config.metadata]
    out += [Field(n, NUCLEOTIDE.kind) for n in references.nucleotides]
    out += [Field(UNALIGNED + n, "ZSTD_COMPRESSED_STRING") for n in references.nucleotides] if unaligned else []
    return out + [Field(n, AMINO_ACID.kind) for n in references.genes]
