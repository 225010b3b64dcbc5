"""Running rules over a schema, and comparing a schema with a target at three levels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from enum import Enum

from rowdelta.model import FieldInfo, SchemaInfo

from .rules import DictionaryEncodingRule, Rule, TemporalFormatRule


class ValidationLevel(Enum):
    STRICT = "strict"
    COMPATIBLE = "compatible"
    RELAXED = "relaxed"


@dataclass
class ValidationResult:
    valid: bool = True
    errors: dict[str, list[str]] = field(default_factory=dict)
    warnings: dict[str, list[str]] = field(default_factory=dict)

    def fail(self, group: str, message: str) -> None:
        self.valid = False
        self.errors.setdefault(group, []).append(message)


class Validator:
    """Rules judge a schema alone; the level judges a schema against a target."""

    def __init__(self, rules: Sequence[Rule] = (), level: ValidationLevel = ValidationLevel.COMPATIBLE):
        self.rules, self.level = list(rules), level

    def add_rule(self, rule: Rule) -> Validator:
        self.rules.append(rule)
        return self

    def set_level(self, level: ValidationLevel) -> Validator:
        self.level = level
        return self

    def validate(self, schema: SchemaInfo) -> ValidationResult:
        out = ValidationResult()
        for rule in self.rules:
            if wrong := rule.check(schema):
                out.fail(rule.name, wrong)
        return out

    def validate_against(self, schema: SchemaInfo, target: SchemaInfo) -> ValidationResult:
        out = ValidationResult()
        {ValidationLevel.STRICT: _strict, ValidationLevel.COMPATIBLE: _compatible, ValidationLevel.RELAXED: _relaxed}[self.level](schema, target, out)
        return out


def _nulls(f: FieldInfo) -> str:
    return "allows nulls" if f.nullable else "forbids nulls"


def _strict(schema: SchemaInfo, target: SchemaInfo, out: ValidationResult) -> None:
    """Same fields in the same order."""
    if len(schema.fields) != len(target.fields):
        out.fail("SchemaStructure", f"{len(schema.fields)} fields where the target has {len(target.fields)}")
        return
    wrong = []
    for i, (a, b) in enumerate(zip(schema.fields, target.fields, strict=True)):
        if a.name != b.name:
            wrong.append(f"field name mismatch at index {i}: got '{a.name}', expected '{b.name}'")
            continue
        if not a.type.equals(b.type):
            wrong.append(f"field type mismatch for '{a.name}': got '{a.type}', expected '{b.type}'")
        if a.nullable != b.nullable:
            wrong.append(f"'{a.name}' {_nulls(a)} where the target {_nulls(b)}")
    if wrong:
        out.fail("SchemaStructure", "; ".join(wrong))


def _compatible(schema: SchemaInfo, target: SchemaInfo, out: ValidationResult) -> None:
    """Types stay and nothing becomes stricter; new, removed and relaxed fields are warnings."""
    have, wrong, odd = schema.by_name, [], []
    for f in target.fields:
        if f.name not in have:
            odd.append(f"new field '{f.name}' in target schema")
        elif not have[f.name].type.equals(f.type):
            wrong.append(f"incompatible type for field '{f.name}': got '{have[f.name].type}', expected '{f.type}'")
        elif f.nullable and not have[f.name].nullable:
            odd.append(f"'{f.name}' may be null in the target only")
        elif have[f.name].nullable and not f.nullable:
            wrong.append(f"'{f.name}' may be null, which the target forbids")
    odd += [f"field '{n}' removed in target schema" for n in schema.names if n not in target.by_name]
    if odd:
        out.warnings["SchemaEvolution"] = odd
    if wrong:
        out.fail("SchemaCompatibility", "; ".join(wrong))


def _relaxed(schema: SchemaInfo, target: SchemaInfo, out: ValidationResult) -> None:
    """Only the types of common fields matter."""
    have, wrong, odd = schema.by_name, [], []
    for f in target.fields:
        if f.name not in have:
            odd.append(f"field '{f.name}' exists only in target schema")
        elif not have[f.name].type.equals(f.type):
            wrong.append(f"incompatible type for common field '{f.name}': got '{have[f.name].type}', expected '{f.type}'")
    odd += [f"field '{n}' exists only in source schema" for n in schema.names if n not in target.by_name]
    if odd:
        out.warnings["SchemaStructure"] = odd
    if wrong:
        out.fail("CommonFields", "; ".join(wrong))


def common_validator() -> Validator:
    """UTC timestamps (of no fields until some are named) and dictionary-encoded strings."""
    return Validator([TemporalFormatRule(timezone="UTC"), DictionaryEncodingRule()])


def validate_reader(reader: object, validator: Validator) -> ValidationResult:
    """Validate whatever has a ``schema``: an attribute or a method without arguments."""
    out = ValidationResult()
    if not hasattr(reader, "schema"):
        out.fail("System", "the reader cannot tell its schema")
        return out
    schema = reader.schema() if callable(reader.schema) else reader.schema
    if schema is None:
        out.fail("System", "the reader has no schema")
        return out
    return validator.validate(schema)
