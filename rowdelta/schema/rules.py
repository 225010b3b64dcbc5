"""Pluggable rules over one schema. ``check`` returns nothing or the one message of what is wrong."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import pyarrow as pa

from rowdelta.model import SchemaInfo


@runtime_checkable
class Rule(Protocol):
    name: str
    description: str

    def check(self, schema: SchemaInfo) -> str | None: ...


def _joined(kinds: Sequence[pa.DataType]) -> str:
    return ", ".join(map(str, kinds))


@dataclass
class FieldTypeRule:
    """Fields must be present and have one of the types allowed for them."""

    allowed: Mapping[str, Sequence[pa.DataType]]
    name = "FieldTypeRule"
    description = "Fields have one of their expected types"

    def check(self, schema: SchemaInfo) -> str | None:
        found, wrong = schema.by_name, []
        for name, kinds in self.allowed.items():
            if name not in found:
                wrong.append(f"field '{name}' not found in schema")
            elif not any(found[name].type.equals(k) for k in kinds):
                wrong.append(f"field '{name}' has type '{found[name].type}', but expected one of: {_joined(kinds)}")
        return f"field type validation failed: {'; '.join(wrong)}" if wrong else None


@dataclass
class RequiredFieldsRule:
    """Fields must be present."""

    fields: Sequence[str]
    name = "RequiredFieldsRule"
    description = "All required fields are present"

    def check(self, schema: SchemaInfo) -> str | None:
        missing = [f for f in self.fields if f not in schema.by_name]
        return f"required fields missing: {', '.join(missing)}" if missing else None


@dataclass
class NullabilityRule:
    """Fields that are present must be declared non-null; no data is looked at."""

    fields: Sequence[str]
    name = "NullabilityRule"
    description = "The given fields are not nullable"

    def check(self, schema: SchemaInfo) -> str | None:
        found = schema.by_name
        wrong = [f for f in self.fields if f in found and found[f].nullable]
        return f"fields that should not be nullable: {', '.join(wrong)}" if wrong else None


@dataclass
class TypeCompatibilityRule:
    """A present field's type must be a key of its map and among that key's own types."""

    compatible: Mapping[str, Mapping[pa.DataType, Sequence[pa.DataType]]]
    name = "TypeCompatibilityRule"
    description = "Field types are among the compatible ones"

    def check(self, schema: SchemaInfo) -> str | None:
        found, wrong = schema.by_name, []
        for name, kinds in self.compatible.items():
            if name not in found:
                continue
            kind = found[name].type
            allowed = next((v for k, v in kinds.items() if k.equals(kind)), None)
            if allowed is None:
                wrong.append(f"field '{name}' has type '{kind}' which is not in the compatibility map")
            elif not any(kind.equals(k) for k in allowed):
                wrong.append(f"field '{name}' has type '{kind}' which is not compatible with any of: {_joined(allowed)}")
        return f"type compatibility validation failed: {'; '.join(wrong)}" if wrong else None


@dataclass
class MetadataRule:
    """Metadata keys must be present; then each present key's validator may raise."""

    required: Sequence[str] = ()
    validators: Mapping[str, Callable[[str], None]] = field(default_factory=dict)
    name = "MetadataRule"
    description = "Schema metadata has the required keys with valid values"

    def check(self, schema: SchemaInfo) -> str | None:
        missing = [k for k in self.required if k not in schema.metadata]
        if missing:
            return f"required metadata keys missing: {', '.join(missing)}"
        wrong = []
        for key, validate in self.validators.items():
            if key in schema.metadata:
                try:
                    validate(schema.metadata[key])
                except Exception as e:  # a validator says no by raising anything
                    wrong.append(f"validation failed for key '{key}': {e}")
        return f"metadata validation failed: {'; '.join(wrong)}" if wrong else None


@dataclass
class DictionaryEncodingRule:
    """Plain string fields that are not exempt fail; dictionary-encoded ones have another type."""

    required: bool = True
    exempt: Sequence[str] = ()
    name = "DictionaryEncodingRule"
    description = "String fields use dictionary encoding"

    def check(self, schema: SchemaInfo) -> str | None:
        plain = (pa.string(), pa.large_string())
        wrong = [f.name for f in schema.fields if self.required and f.name not in self.exempt and f.type in plain]
        return f"string fields should use dictionary encoding: {', '.join(wrong)}" if wrong else None


@dataclass
class TemporalFormatRule:
    """Present fields must be 32-bit dates, or timestamps of the required zone."""

    timestamps: Sequence[str] = ()
    dates: Sequence[str] = ()
    timezone: str = ""
    name = "TemporalFormatRule"
    description = "Temporal fields have the proper types and zone"

    def check(self, schema: SchemaInfo) -> str | None:
        found, wrong = schema.by_name, []
        for f in self.dates:
            if f in found and not pa.types.is_date32(found[f].type):
                wrong.append(f"field '{f}' should use Date32 type, got '{found[f].type}'")
        for f in self.timestamps:
            if f not in found:
                continue
            kind = found[f].type
            if not pa.types.is_timestamp(kind):
                wrong.append(f"field '{f}' should use Timestamp type, got '{kind}'")
            elif self.timezone and (kind.tz or "") != self.timezone:
                wrong.append(f"field '{f}' should use timezone '{self.timezone}', got '{kind.tz or ''}'")
        return f"temporal format validation failed: {'; '.join(wrong)}" if wrong else None


@dataclass
class DecimalPrecisionRule:
    """Present fields must be 128-bit decimals of exactly this precision and scale."""

    required: Mapping[str, tuple[int, int]]
    name = "DecimalPrecisionRule"
    description = "Decimal fields have the required precision and scale"

    def check(self, schema: SchemaInfo) -> str | None:
        found, wrong = schema.by_name, []
        for name, (precision, scale) in self.required.items():
            if name not in found:
                continue
            kind = found[name].type
            if not pa.types.is_decimal128(kind):
                wrong.append(f"field '{name}' should be a decimal type, got '{kind}'")
            elif (kind.precision, kind.scale) != (precision, scale):
                wrong.append(f"field '{name}' has decimal precision/scale ({kind.precision},{kind.scale}), but requires ({precision},{scale})")
        return f"decimal precision validation failed: {'; '.join(wrong)}" if wrong else None


def rule_from_schema(schema: SchemaInfo) -> FieldTypeRule:
    """Another schema must have this one's fields with these types."""
    return FieldTypeRule({f.name: [f.type] for f in schema.fields})
