"""Validators from JSON or YAML files."""

from __future__ import annotations

import json
from pathlib import Path

from .rules import DecimalPrecisionRule, DictionaryEncodingRule, FieldTypeRule, MetadataRule, NullabilityRule, RequiredFieldsRule, TemporalFormatRule
from .types import parse_type
from .validator import ValidationLevel, Validator


def validator_from_file(path: str) -> Validator:
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"schema file not found: {path}")
    text = file.read_text()
    if file.suffix.lower() == ".json":
        config = json.loads(text)
    elif file.suffix.lower() in (".yaml", ".yml"):
        import yaml

        config = yaml.safe_load(text) or {}
    else:
        raise ValueError(f"unsupported schema file format: {file.suffix} (supported: .json, .yaml, .yml)")
    return validator_from_config(config)


def validator_from_config(config: dict) -> Validator:
    """Rules in a fixed order: required, non-null, types, temporal, dictionary, decimal, metadata."""
    out = Validator()
    if level := config.get("validation_level"):
        try:
            out.set_level(ValidationLevel(level.lower()))
        except ValueError:
            raise ValueError(f"unknown validation level: {level}") from None
    if names := config.get("required_fields"):
        out.add_rule(RequiredFieldsRule(names))
    if names := config.get("non_nullable_fields"):
        out.add_rule(NullabilityRule(names))
    if types := config.get("field_types"):
        out.add_rule(FieldTypeRule({name: [_parsed(name, k) for k in kinds] for name, kinds in types.items()}))
    if names := config.get("timestamp_fields"):
        out.add_rule(TemporalFormatRule(names, timezone=config.get("required_timezone") or ""))
    if config.get("string_fields_require_dictionary"):
        out.add_rule(DictionaryEncodingRule(exempt=config.get("dictionary_exempt_fields") or []))
    if sizes := config.get("decimal_precisions"):
        out.add_rule(DecimalPrecisionRule({name: (p, s) for name, (p, s) in sizes.items()}))
    if keys := config.get("required_metadata_keys"):
        out.add_rule(MetadataRule(keys))
    return out


def _parsed(name: str, kind: str):
    try:
        return parse_type(kind)
    except ValueError as e:
        raise ValueError(f"invalid type specification for field '{name}': {e}") from None
