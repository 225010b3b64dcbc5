"""Command line: diff, schema, inspect, generate, version. Progress and warnings go to stderr."""

from __future__ import annotations

import argparse
import dataclasses
import json
import signal
import sys
import threading
import warnings

from pyspark.sql import SparkSession

from rowdelta import generate, sinks, sources
from rowdelta.inspect import inspect_parquet
from rowdelta.model import Dataset, DiffOptions
from rowdelta.plans import diff
from rowdelta.schema import (
    DictionaryEncodingRule,
    NullabilityRule,
    RequiredFieldsRule,
    TemporalFormatRule,
    ValidationLevel,
    Validator,
    compare_schemas,
    print_result,
    schema_differences,
    schema_text,
    validator_from_file,
)
from rowdelta.sources.arrow_file import arrow_schema
from rowdelta.sources.files import local_files

VERSION = "0.1.0"


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rowdelta")
    sub = top.add_subparsers(dest="command", required=True)

    d = sub.add_parser("diff", help="compare two datasets")
    d.add_argument("source")
    d.add_argument("target")
    d.add_argument("--source-type", default="auto")
    d.add_argument("--target-type", default="auto")
    d.add_argument("--key", type=_names, default=[])
    d.add_argument("--ignore", type=_names, default=[])
    d.add_argument("--output", "-o", default="")
    d.add_argument("--format", "-f", default="parquet", choices=list(sinks.WRITERS), help="arrow and json are folders that executors write, arrow_file and json_array one file for small results")
    d.add_argument("--tolerance", type=float, default=0.0001)
    d.add_argument("--parallel", action=argparse.BooleanOptionalAction, default=True)
    d.add_argument("--batch-size", "-b", type=int, default=10_000)
    d.add_argument("--workers", type=int, default=4)
    d.add_argument("--full-load", action="store_true")
    d.add_argument("--stream", action="store_true")
    d.add_argument("--differ", default="spark")
    d.add_argument("--unique-keys", action="store_true", help="promise that no key has several rows")
    d.add_argument("--checksums", action="store_true", help="leave out buckets of keys whose checksums agree")
    d.add_argument("--key-style", default="typed", choices=["typed", "text"])
    d.add_argument("--exit-code", action="store_true", help="exit 2 if there are differences")

    s = sub.add_parser("schema", help="validate a schema, or compare two")
    s.add_argument("source")
    s.add_argument("target", nargs="?")
    s.add_argument("--source-type", default="auto")
    s.add_argument("--target-type", default="auto")
    s.add_argument("--level", default="compatible")
    s.add_argument("--required", type=_names, default=[])
    s.add_argument("--non-nullable", type=_names, default=[])
    s.add_argument("--require-dict-encoding", action="store_true")
    s.add_argument("--require-utc", action="store_true")
    s.add_argument("--timestamp-fields", type=_names, default=[])
    s.add_argument("--date-fields", type=_names, default=[])
    s.add_argument("--config", default="", help="rules and level from a JSON or YAML file")
    s.add_argument("--format", "-f", default="text", choices=["text", "json"])
    s.add_argument("--exit-code", action="store_true", help="exit 2 if validation fails")

    i = sub.add_parser("inspect", help="show a Parquet file's shape and first rows")
    i.add_argument("file")
    i.add_argument("--rows", type=int, default=5)
    i.add_argument("--statistics", action="store_true", help="values, nulls and bytes of each column over all row groups")

    g = sub.add_parser("generate", help="write a source and target pair")
    g.add_argument("source")
    g.add_argument("target")
    for f in dataclasses.fields(generate.PairConfig):
        name = "--" + f.name.replace("_", "-")
        if isinstance(f.default, bool):
            g.add_argument(name, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            g.add_argument(name, type=type(f.default), default=f.default)

    sub.add_parser("version")
    return top


def _session() -> SparkSession:
    return SparkSession.builder.appName("rowdelta").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def run_diff(a: argparse.Namespace) -> int:
    if a.full_load and a.stream:
        raise ValueError("--full-load and --stream exclude each other")
    if a.differ not in ("spark", "arrow"):
        raise ValueError(f"unsupported differ: {a.differ}")
    if not a.key:
        print("Warning: no key columns given; rows are compared as wholes", file=sys.stderr)
    spark = _session()
    kinds = [sources.detect_type(p) if k == "auto" else k for p, k in ((a.source, a.source_type), (a.target, a.target_type))]
    data: list[Dataset] = []
    for path, kind in zip((a.source, a.target), kinds, strict=True):
        # the file's order decides which row of a key is last
        by_place = kind == "parquet" and not a.unique_keys
        one = sources.read(spark, path, kind, **({"positions": True} if by_place else {}))
        data.append(sources.full_load(one) if a.full_load else one)
    hidden = tuple(dict.fromkeys(c for x in data for c in x.position))
    options = DiffOptions(tuple(a.key), (*a.ignore, *hidden), a.tolerance, unique_keys=a.unique_keys, checksums=a.checksums, key_style=a.key_style, batch_size=a.batch_size, parallel=a.parallel, workers=a.workers)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        result = diff(data[0], data[1], options)
    drop = [c for h in hidden for c in (h, f"_modified_{h}")]
    if drop:
        whole = result.one_pass
        result = dataclasses.replace(result, one_pass=whole and (lambda: whole().drop(*drop)), added=result.added.drop(*drop), deleted=result.deleted.drop(*drop), modified=result.modified.drop(*drop))
    summary = result.summary()
    to_stdout = a.format in ("json", "json_array") and not a.output
    sinks.print_summary(summary, sys.stderr if to_stdout else sys.stdout)
    if a.output:
        sinks.write_diff(result, a.output, a.format)
    elif to_stdout:
        sinks.json_array(result.changes(), sys.stdout)
    return 2 if a.exit_code and summary.added + summary.deleted + summary.modified else 0


def _schema(path: str, kind: str):
    kind = sources.detect_type(path, strict=True) if kind == "auto" else kind
    if kind == "arrow":
        from rowdelta.model import SchemaInfo

        return SchemaInfo.of(arrow_schema(path, None if local_files(path, ".arrow") else _session()))
    return sources.read(_session(), path, kind).schema


def run_schema(a: argparse.Namespace) -> int:
    schema = _schema(a.source, a.source_type)
    if a.config:
        validator = validator_from_file(a.config)
    else:
        level = a.level.lower() if a.level.lower() in [v.value for v in ValidationLevel] else "compatible"
        validator = Validator(level=ValidationLevel(level))
    if a.required:
        validator.add_rule(RequiredFieldsRule(a.required))
    if a.non_nullable:
        validator.add_rule(NullabilityRule(a.non_nullable))
    if a.require_dict_encoding:
        validator.add_rule(DictionaryEncodingRule())
    if a.require_utc or a.timestamp_fields or a.date_fields:
        validator.add_rule(TemporalFormatRule(a.timestamp_fields, a.date_fields, "UTC" if a.require_utc else ""))
    target = _schema(a.target, a.target_type) if a.target else None
    result = validator.validate_against(schema, target) if target else validator.validate(schema)
    if a.format == "json":
        out = {"valid": result.valid, "errors": result.errors, "warnings": result.warnings}
        out |= {"differences": schema_differences(schema, target)} if target else {"schema": [{"name": f.name, "type": str(f.type), "nullable": f.nullable} for f in schema.fields]}
        print(json.dumps(out, indent=2))
    else:
        print(compare_schemas(schema, target) if target else schema_text(schema))
        print(print_result(result), end="")
    return 2 if a.exit_code and not result.valid else 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    # Spark cancels its jobs on SIGINT; SIGTERM is to do the same
    if threading.current_thread() is threading.main_thread():
        signal.signal(signal.SIGTERM, lambda *_: signal.raise_signal(signal.SIGINT))
    try:
        if a.command == "diff":
            return run_diff(a)
        if a.command == "schema":
            return run_schema(a)
        if a.command == "inspect":
            print(inspect_parquet(_session(), a.file, a.rows, a.statistics), end="")
        elif a.command == "generate":
            config = generate.PairConfig(**{f.name: getattr(a, f.name) for f in dataclasses.fields(generate.PairConfig)})
            generate.write_pair(_session(), a.source, a.target, config)
        else:
            print(f"rowdelta version {VERSION}")
    except KeyboardInterrupt:
        print("Cancelled", file=sys.stderr)
        return 1
    except (ValueError, TypeError, FileNotFoundError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
