"""Schema rules, compatibility levels, configuration files and reports. All of it runs on the driver."""

from .config import validator_from_file
from .report import compare_schemas, print_result, schema_differences, schema_text
from .rules import (
    DecimalPrecisionRule,
    DictionaryEncodingRule,
    FieldTypeRule,
    MetadataRule,
    NullabilityRule,
    RequiredFieldsRule,
    Rule,
    TemporalFormatRule,
    TypeCompatibilityRule,
    rule_from_schema,
)
from .types import parse_type, same_type, schema_of, spark_type
from .validator import ValidationLevel, ValidationResult, Validator, common_validator, validate_reader

__all__ = [
    "DecimalPrecisionRule",
    "DictionaryEncodingRule",
    "FieldTypeRule",
    "MetadataRule",
    "NullabilityRule",
    "RequiredFieldsRule",
    "Rule",
    "TemporalFormatRule",
    "TypeCompatibilityRule",
    "ValidationLevel",
    "ValidationResult",
    "Validator",
    "common_validator",
    "compare_schemas",
    "parse_type",
    "print_result",
    "rule_from_schema",
    "same_type",
    "schema_differences",
    "schema_of",
    "schema_text",
    "spark_type",
    "validate_reader",
    "validator_from_file",
]
