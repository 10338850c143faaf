"""Table definitions and their rules."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from ..errors import InvalidInput
from ..plans.lexer import KEYWORDS

STRUCT = {"BOOLEAN": T.BooleanType(), "INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "STRING": T.StringType()}


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = True
    has_default: bool = False
    default: object = None
    unique: bool = False
    index: bool = False
    references: str | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    primary_key: str
    columns: tuple[ColumnSpec, ...]
    #: Folder of the rows: the name with the place in history of its creation.
    folder: str = ""

    def column(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise InvalidInput(f"unknown column {name} in table {self.name}")

    @property
    def key(self) -> ColumnSpec:
        return self.column(self.primary_key)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, STRUCT[c.type]) for c in self.columns])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> TableSpec:
        d = json.loads(text)
        return TableSpec(d["name"], d["primary_key"], tuple(ColumnSpec(**c) for c in d["columns"]), d["folder"])

    def show_create(self) -> str:
        """CREATE TABLE text."""
        lines = []
        for c in self.columns:
            parts = [_name(c.name), c.type]
            if c.name == self.primary_key:
                parts.append("PRIMARY KEY")
            elif not c.nullable:
                parts.append("NOT NULL")
            if c.has_default:
                parts.append(f"DEFAULT {_written(c.default, c.type)}")
            if c.name != self.primary_key:
                if c.unique:
                    parts.append("UNIQUE")
                if c.index:
                    parts.append("INDEX")
            if c.references:
                parts.append(f"REFERENCES {_name(c.references)}")
            lines.append("  " + " ".join(parts))
        return f"CREATE TABLE {_name(self.name)} (\n" + ",\n".join(lines) + "\n)"


def _name(name: str) -> str:
    plain = re.fullmatch(r"[^\W\d_]\w*", name) and name == name.lower() and name not in KEYWORDS
    return name if plain else '"' + name.replace('"', '""') + '"'


def _written(value: object, type_: str) -> str:
    if value is None:
        return "NULL"
    if type_ == "STRING":
        return "'" + str(value).replace("'", "''") + "'"
    if isinstance(value, float) and not math.isfinite(value):
        return "NAN" if math.isnan(value) else ("INFINITY" if value > 0 else "-INFINITY")
    return str(value).upper()


def defined(name: str, columns: list[dict], lookup) -> TableSpec:
    """A table from parsed columns (dicts of ColumnDef with defaults folded to (value, type)); lookup gives referenced tables."""
    keys = [c["name"] for c in columns if c["primary_key"]]
    if len(keys) != 1:
        raise InvalidInput(f"no primary key for table {name}" if not keys else f"multiple primary keys for table {name}")
    specs: list[ColumnSpec] = []
    for c in columns:
        is_key = c["primary_key"]
        if any(s.name == c["name"] for s in specs):
            raise InvalidInput(f"duplicate column {c['name']} in table {name}")
        if is_key and c["nullable"]:
            raise InvalidInput(f"primary key {c['name']} cannot be nullable")
        nullable = (not is_key) if c["nullable"] is None else c["nullable"]
        default = c["default"]
        if default is not None:
            value, kind = default
            if value is None and not nullable:
                raise InvalidInput(f"invalid NULL default for non-nullable column {c['name']}")
            if value is not None and kind != c["type"]:
                raise InvalidInput(f"invalid default type {kind} for {c['type']} column {c['name']}")
        if c["references"] and c["references"] != name:
            target = lookup(c["references"])
            if target is None:
                raise InvalidInput(f"unknown table {c['references']} referenced by column {c['name']}")
            if target.key.type != c["type"]:
                raise InvalidInput(f"can't reference {target.key.type} primary key of {target.name} from {c['type']} column {c['name']}")
        specs.append(
            ColumnSpec(
                c["name"],
                c["type"],
                nullable,
                default is not None or nullable,
                default[0] if default else None,
                bool(c["unique"] or is_key),
                bool((c["index"] or c["unique"] or c["references"]) and not is_key),
                c["references"],
            )
        )
    spec = TableSpec(name, keys[0], tuple(specs))
    for c in spec.columns:
        if c.references == name and c.type != spec.key.type:
            raise InvalidInput(f"can't reference {spec.key.type} primary key of {name} from {c.type} column {c.name}")
    return spec
