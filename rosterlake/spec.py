"""The user-declared record spec and the column expressions it stands for."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import fixed_values as fv

KINDS = ("extracted", "fallback", "formula", "static")
RULES = ("regex", "max_length", "min_length", "contains_cjk", "url_like")
METADATA = ("university_name", "department", "listing_url")


@dataclass(frozen=True)
class Validation:
    regex: str | None = None
    max_length: int | None = None
    min_length: int | None = None
    contains_cjk: bool = False
    url_like: bool = False
    case_insensitive: bool = False

    def violations(self, c: Column) -> list[tuple[str, Column]]:
        """(rule, test) pairs in the order the rules apply to a non-NULL value."""
        tests: list[tuple[str, Column]] = []
        present = c != ""
        if self.regex:
            # anchored at the start only; (?d) makes "\n" the one line end
            flags = "(?diu)" if self.case_insensitive else "(?d)"
            tests.append(("regex", present & ~c.rlike(rf"{flags}\A(?:{self.regex})")))
        if self.max_length is not None:
            tests.append(("max_length", F.length(c) > self.max_length))
        if self.min_length is not None:
            tests.append(("min_length", present & (F.length(c) < self.min_length)))
        if self.contains_cjk:
            tests.append(("contains_cjk", present & ~c.rlike(fv.CJK_PATTERN)))
        if self.url_like:
            tests.append(("url_like", present & ~c.rlike(r"(?i)\Ahttps?://")))
        return tests


@dataclass(frozen=True)
class ColumnRule:
    name: str
    kind: str
    hint: str | None = None
    formula: str | None = None
    comment: str | None = None
    value: Any = None
    value_from: str | None = None
    validation: Validation | None = None
    required: bool = False

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"column {self.name!r}: kind must be one of {KINDS}")

    def first_violation(self, c: Column) -> Column:
        """Name of the first broken rule, NULL when the value is valid."""
        out = F.lit(None).cast("string")
        for rule, broken in reversed(self.validation.violations(c) if self.validation else []):
            out = F.when(broken, F.lit(rule)).otherwise(out)
        return out

    def validated(self, c: Column) -> Column:
        value = F.coalesce(c, F.lit(""))
        if not self.validation or not self.validation.violations(value):
            return value
        broken = None
        for _, test in self.validation.violations(value):
            broken = test if broken is None else broken | test
        return F.when(broken, F.lit("")).otherwise(value)


def _known(cls: type, given: dict[str, Any]) -> dict[str, Any]:
    """The entries a spec class knows; others in a spec file are left alone."""
    names = {f.name for f in fields(cls)}
    return {k: v for k, v in given.items() if k in names and v is not None}


@dataclass(frozen=True)
class RecordSpec:
    columns: tuple[ColumnRule, ...] = ()
    dedup_keys: tuple[str, ...] = field(default=())

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> RecordSpec:
        columns = []
        for entry in data.get("columns", []):
            entry = dict(entry)
            rules = entry.pop("validation", None)
            kind = entry.pop("type", None) or entry.pop("kind")
            validation = Validation(**_known(Validation, rules)) if rules else None
            columns.append(
                ColumnRule(kind=kind, validation=validation, **_known(ColumnRule, entry))
            )
        return cls(tuple(columns), tuple(data.get("dedup_keys", ())))

    @classmethod
    def load(cls, path: str | Path) -> RecordSpec:
        """Read a spec from JSON; an absent file is an empty spec."""
        path = Path(path)
        if not path.exists():
            return cls()
        return cls.from_dict(json.loads(path.read_text(encoding="utf-8")))

    def with_column(self, column: ColumnRule) -> RecordSpec:
        if column.name in self.names():
            raise ValueError(f"column {column.name!r} is already in the spec")
        return replace(self, columns=(*self.columns, column))

    def of_kind(self, *kinds: str) -> list[ColumnRule]:
        return [c for c in self.columns if c.kind in kinds]

    def extractable(self) -> list[ColumnRule]:
        return self.of_kind("extracted", "fallback")

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def required(self) -> list[str]:
        return [c.name for c in self.columns if c.required]

    def column(self, name: str) -> ColumnRule:
        return next(c for c in self.columns if c.name == name)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in self.names()])

    def columns_json(self) -> str:
        return json.dumps([asdict(c) for c in self.columns], ensure_ascii=False, sort_keys=True)

    def fingerprint(self) -> str:
        """Changes with anything that changes results: all columns, rules, keys."""
        text = self.columns_json() + json.dumps(list(self.dedup_keys))
        return hashlib.sha256(text.encode()).hexdigest()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by its exact name, also when it holds dots or spaces."""
    return F.col(quoted(name))


def formula_expression(formula: str, known: list[str]) -> Column:
    """A formula is a Spark SQL expression with ``[@[Name]]`` references."""

    def reference(match: re.Match[str]) -> str:
        if match[1] not in known:
            raise ValueError(f"formula refers to unknown column {match[1]!r}: {formula}")
        return quoted(match[1])

    return F.expr(re.sub(r"\[@\[([^\]]+)\]\]", reference, formula.lstrip("=")))
