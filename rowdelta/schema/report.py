"""Schemas, validation results and schema comparisons as text or rows, always in schema order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowdelta.model import SchemaInfo

from .validator import ValidationResult


def schema_text(schema: SchemaInfo) -> str:
    lines = ["Schema:", *(f"  {f.name}: {f.type} {'NULL' if f.nullable else 'NOT NULL'}" for f in schema.fields)]
    if schema.metadata:
        lines += ["", "Metadata:", *(f"  {k}: {v}" for k, v in schema.metadata.items())]
    return "\n".join(lines) + "\n"


def print_result(result: ValidationResult) -> str:
    lines = ["Schema validation passed." if result.valid else "Schema validation failed!"]
    for title, groups in (("Errors", result.errors), ("Warnings", result.warnings)):
        if groups:
            lines += ["", f"{title}:"]
            for name, messages in groups.items():
                lines += [f"  Rule '{name}':", *(f"    - {m}" for m in messages)]
    return "\n".join(lines) + "\n"


def schema_differences(source: SchemaInfo, target: SchemaInfo) -> list[tuple[str, str, str | None, str | None]]:
    """(field, kind, source, target); kind is only_in_source, only_in_target, type or nullability."""
    a, b, out = source.by_name, target.by_name, []
    out += [(n, "only_in_source", str(a[n].type), None) for n in source.names if n not in b]
    out += [(n, "only_in_target", None, str(b[n].type)) for n in target.names if n not in a]
    for n in source.names:
        if n in b:
            if not a[n].type.equals(b[n].type):
                out.append((n, "type", str(a[n].type), str(b[n].type)))
            if a[n].nullable != b[n].nullable:
                out.append((n, "nullability", str(a[n].nullable).lower(), str(b[n].nullable).lower()))
    return out


def differences_frame(spark: SparkSession, source: SchemaInfo, target: SchemaInfo) -> DataFrame:
    return spark.createDataFrame(schema_differences(source, target), "field string, kind string, source string, target string")


def compare_schemas(source: SchemaInfo, target: SchemaInfo) -> str:
    found = schema_differences(source, target)
    lines = ["Schema Comparison:", ""]
    if len(source.fields) != len(target.fields):
        lines += [f"Field count differs: source={len(source.fields)}, target={len(target.fields)}", ""]
    for kind, side, at in (("only_in_source", "source", 2), ("only_in_target", "target", 3)):
        if own := [d for d in found if d[1] == kind]:
            lines += [f"Fields only in {side} schema:", *(f"  {d[0]}: {d[at]}" for d in own), ""]
    lines.append("Common fields with differences:")
    common: dict[str, list[str]] = {}
    for name, kind, a, b in found:
        if kind in ("type", "nullability"):
            common.setdefault(name, []).append(f"{kind}: {a} -> {b}")
    lines += [f"  {n}: {', '.join(d)}" for n, d in common.items()] or ["  None"]
    return "\n".join(lines) + "\n"
