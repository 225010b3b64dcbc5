import json

import pyarrow as pa
import pytest

from rowdelta.model import FieldInfo, SchemaInfo
from rowdelta.schema import (
    DecimalPrecisionRule,
    DictionaryEncodingRule,
    FieldTypeRule,
    MetadataRule,
    NullabilityRule,
    RequiredFieldsRule,
    Rule,
    TemporalFormatRule,
    TypeCompatibilityRule,
    ValidationLevel,
    Validator,
    common_validator,
    compare_schemas,
    parse_type,
    print_result,
    rule_from_schema,
    same_type,
    schema_text,
    spark_type,
    validate_reader,
    validator_from_file,
)


def schema(metadata=None, **kinds):
    return SchemaInfo(tuple(FieldInfo(n, k[0] if isinstance(k, tuple) else k, not isinstance(k, tuple)) for n, k in kinds.items()), metadata or {})


I64, I32, STR, F64 = pa.int64(), pa.int32(), pa.string(), pa.float64()
BASE = schema(id=(I64,), name=STR)


def test_required_fields():
    order = schema(order_no=(I64,), placed=pa.timestamp("us"), note=STR)
    assert RequiredFieldsRule([]).check(order) is None and RequiredFieldsRule(["note", "order_no"]).check(order) is None
    # in the order asked for, and names are case-sensitive
    assert RequiredFieldsRule(["tax", "placed", "Note"]).check(order) == "required fields missing: tax, Note"


def test_field_types():
    s = schema(sku=(STR,), weight=pa.decimal128(8, 3), stored=pa.date32())
    assert FieldTypeRule({"stored": [pa.date32()], "sku": [pa.large_string(), STR]}).check(s) is None
    wrong = FieldTypeRule({"weight": [F64, pa.decimal128(8, 2)], "shelf": [I32], "sku": [STR]}).check(s)
    assert "field 'weight' has type 'decimal128(8, 3)', but expected one of: " in wrong and "field 'shelf' not found in schema" in wrong and "sku" not in wrong


def test_nullability():
    assert NullabilityRule(["id", "absent"]).check(BASE) is None
    assert NullabilityRule(["id", "name"]).check(BASE) == "fields that should not be nullable: name"


def test_metadata():
    s = schema({"owner": "billing", "retention_days": "400"}, amount=F64)

    def a_year_at_most(v):
        if int(v) > 366:
            raise ValueError(f"kept for {v} days")

    assert MetadataRule(["retention_days", "owner"]).check(s) is None
    # a missing key is told before any value is looked at
    assert MetadataRule(["owner", "region"], {"retention_days": a_year_at_most}).check(s) == "required metadata keys missing: region"
    assert "kept for 400 days" in MetadataRule([], {"retention_days": a_year_at_most, "region": a_year_at_most}).check(s)


def test_type_compatibility():
    rule = TypeCompatibilityRule({"id": {I64: [I32, I64]}, "absent": {}})
    assert rule.check(BASE) is None
    assert "not in the compatibility map" in TypeCompatibilityRule({"id": {I32: [I64]}}).check(BASE)
    assert "not compatible with any of: int32" in TypeCompatibilityRule({"id": {I64: [I32]}}).check(BASE)
    d = schema(d=pa.decimal128(10, 2))
    assert TypeCompatibilityRule({"d": {pa.decimal128(10, 2): [pa.decimal128(10, 2)]}}).check(d) is None


def test_dictionary_encoding():
    s = schema(a=STR, b=pa.large_string(), c=pa.dictionary(I32, STR), d=I64)
    assert DictionaryEncodingRule().check(s) == "string fields should use dictionary encoding: a, b"
    assert DictionaryEncodingRule(exempt=["a", "b"]).check(s) is None and DictionaryEncodingRule(False).check(s) is None


def test_temporal():
    s = schema(slot=pa.timestamp("us", "UTC"), local_slot=pa.timestamp("us", "Asia/Tokyo"), wall=pa.timestamp("ns"), due=pa.date32(), due_ms=pa.date64(), shelf=I32)
    rule = lambda **kw: TemporalFormatRule(**kw).check(s)
    # names that are absent are no failure, and a zone is asked for only if one is given
    assert rule(timestamps=["slot", "gone"], dates=["due", "gone"], timezone="UTC") is None and rule(timestamps=["local_slot", "wall"]) is None
    for name, zone in (("local_slot", "Asia/Tokyo"), ("wall", "")):
        assert rule(timestamps=[name], timezone="UTC").endswith(f"field '{name}' should use timezone 'UTC', got '{zone}'")
    both = rule(timestamps=["shelf"], dates=["due_ms"])
    # dates are told before timestamps; a date of another width is none
    assert both.index("'due_ms' should use Date32 type") < both.index("'shelf' should use Timestamp type, got 'int32'")


def test_decimals():
    s = schema(a=pa.decimal128(10, 2), b=pa.decimal256(10, 2), c=F64)
    assert DecimalPrecisionRule({"a": (10, 2), "absent": (1, 1)}).check(s) is None
    wrong = DecimalPrecisionRule({"a": (12, 2), "b": (10, 2), "c": (1, 0)}).check(s)
    assert "(10,2), but requires (12,2)" in wrong and "field 'b' should be a decimal type" in wrong and "field 'c' should" in wrong


def test_rules_run_together():
    parcel = schema(barcode=(STR,), grams=I32, lane=pa.dictionary(I32, STR))
    validator = Validator([FieldTypeRule({"grams": [I32, I64]}), DictionaryEncodingRule(exempt=["barcode"])])
    assert validator.validate(parcel).valid
    # every rule has its say, in the order in which rules were added
    validator.add_rule(NullabilityRule(["grams", "barcode"])).add_rule(RequiredFieldsRule(["sender", "lane"]))
    found = validator.validate(parcel)
    assert {k: len(v) for k, v in found.errors.items()} == {"NullabilityRule": 1, "RequiredFieldsRule": 1} and not found.valid
    assert [isinstance(r, Rule) for r in validator.rules] == [True] * 4


def test_strict():
    v = Validator(level=ValidationLevel.STRICT)
    assert v.validate_against(BASE, BASE).valid
    assert "field type mismatch for 'id'" in v.validate_against(BASE, schema(id=(I32,), name=STR)).errors["SchemaStructure"][0]
    assert "2 fields where the target has 1" in v.validate_against(BASE, schema(id=(I64,))).errors["SchemaStructure"][0]
    out = v.validate_against(BASE, schema(name=I32, id=(I64,))).errors["SchemaStructure"][0]
    assert "name mismatch at index 0" in out and "type" not in out
    assert "'name' allows nulls where the target forbids nulls" in v.validate_against(BASE, schema(id=(I64,), name=(STR,))).errors["SchemaStructure"][0]


def test_compatible():
    v = Validator()
    s = schema(id=(I64,), name=(STR,))
    out = v.validate_against(s, schema(id=(I64,), name=STR, email=STR))
    assert out.valid and len(out.warnings["SchemaEvolution"]) == 2
    assert v.validate_against(s, schema(id=(I64,))).warnings["SchemaEvolution"] == ["field 'name' removed in target schema"]
    bad = v.validate_against(BASE, schema(id=(I32,), name=(STR,)))
    assert not bad.valid and "incompatible type for field 'id'" in bad.errors["SchemaCompatibility"][0] and "'name' may be null, which the target forbids" in bad.errors["SchemaCompatibility"][0]


def test_relaxed():
    loose = Validator().set_level(ValidationLevel.RELAXED)
    shelf, moved = schema(aisle=(I32,), bin=STR), schema(bin=(STR,), lift=F64, dock=I64)
    # nothing but the types of fields of both sides can fail: other fields are warnings, nulls are nothing
    found = loose.validate_against(shelf, moved)
    assert found.valid and sorted(found.warnings["SchemaStructure"]) == ["field 'aisle' exists only in source schema", "field 'dock' exists only in target schema", "field 'lift' exists only in target schema"]
    assert "common field 'bin': got 'string', expected 'double'" in loose.validate_against(shelf, schema(aisle=I32, bin=F64)).errors["CommonFields"][0]


def test_type_names():
    assert parse_type("INT") == I32 and parse_type("ULong") == pa.uint64() and parse_type("Timestamp[MS]") == pa.timestamp("ms")
    assert parse_type("decimal(10,2)") == pa.decimal128(10, 2) and same_type(parse_type("utf8"), STR)
    for bad in ("list", "Decimal(10,2)", "decimal(x,2)", ""):
        with pytest.raises(ValueError, match="unsupported Arrow type"):
            parse_type(bad)
    assert spark_type(pa.uint64()).simpleString() == "decimal(20,0)" and spark_type(pa.timestamp("s")).simpleString() == "timestamp_ntz"
    with pytest.raises(TypeError):
        spark_type(pa.time64("us"))


CONFIG = {
    "validation_level": "Strict",
    "required_fields": ["id", "amount", "at"],
    "non_nullable_fields": ["id"],
    "field_types": {"id": ["int64", "string"], "amount": ["decimal(10,2)"], "at": ["timestamp[ms]"]},
    "timestamp_fields": ["at"],
    "required_timezone": "UTC",
    "string_fields_require_dictionary": True,
    "dictionary_exempt_fields": ["note"],
    "decimal_precisions": {"amount": [10, 2]},
    "required_metadata_keys": ["schema_version"],
}


def test_config_files(tmp_path):
    import yaml

    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    (tmp_path / "c.YML").write_text(yaml.safe_dump(CONFIG))
    for name in ("c.json", "c.YML"):
        v = validator_from_file(str(tmp_path / name))
        assert v.level is ValidationLevel.STRICT
        assert [r.name for r in v.rules] == ["RequiredFieldsRule", "NullabilityRule", "FieldTypeRule", "TemporalFormatRule", "DictionaryEncodingRule", "DecimalPrecisionRule", "MetadataRule"]
        s = schema({"schema_version": "1"}, id=(I64,), amount=pa.decimal128(10, 2), at=pa.timestamp("ms"), note=STR)
        # a type without a zone is asked for together with a zone: no schema can do both
        assert list(v.validate(s).errors) == ["TemporalFormatRule"]


def test_bad_config_files(tmp_path):
    with pytest.raises(FileNotFoundError, match="schema file not found"):
        validator_from_file(str(tmp_path / "no.json"))
    for name, text, message in (("a.txt", "", "unsupported schema file format"), ("b.json", '{"validation_level": "odd"}', "unknown validation level: odd"), ("c.json", '{"field_types": {"f": ["nope"]}}', "invalid type specification for field 'f'")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match=message):
            validator_from_file(str(tmp_path / name))


def test_reports():
    s = schema({"k": "v"}, id=(I64,), name=STR, age=I32)
    assert schema_text(s) == "Schema:\n  id: int64 NOT NULL\n  name: string NULL\n  age: int32 NULL\n\nMetadata:\n  k: v\n"
    text = compare_schemas(s, schema(id=I32, name=STR))
    assert "Field count differs: source=3, target=2" in text and "  id: type: int64 -> int32, nullability: false -> true" in text and "Fields only in source schema:\n  age: int32" in text
    assert compare_schemas(s, s).endswith("Common fields with differences:\n  None\n")
    out = print_result(Validator([RequiredFieldsRule(["x"])]).validate(s))
    assert out == "Schema validation failed!\n\nErrors:\n  Rule 'RequiredFieldsRule':\n    - required fields missing: x\n"
    assert print_result(Validator().validate(s)) == "Schema validation passed.\n"


def test_common_validator_readers_and_derived_rules():
    assert not common_validator().validate(BASE).valid
    assert common_validator().validate(schema(id=I64)).valid

    class Reader:
        def __init__(self, s):
            self.s = s

        def schema(self):
            return self.s

    assert validate_reader(Reader(BASE), Validator()).valid
    assert validate_reader(Reader(None), Validator()).errors == {"System": ["the reader has no schema"]}
    assert validate_reader(object(), Validator()).errors == {"System": ["the reader cannot tell its schema"]}
    assert rule_from_schema(BASE).check(schema(id=I64, name=STR)) is None and "name" in rule_from_schema(BASE).check(schema(id=I64))


def test_validators_for_whole_tables():
    meter = Validator([RequiredFieldsRule(["meter", "read_at"]), TemporalFormatRule(["read_at"], ["installed"], "UTC"), DecimalPrecisionRule({"kwh": (14, 3)})])
    good = schema(meter=(STR,), read_at=(pa.timestamp("ms", "UTC"),), kwh=pa.decimal128(14, 3), installed=pa.date32())
    assert meter.validate(good).valid
    bad = schema(meter=(STR,), read_at=pa.timestamp("ms"), kwh=pa.decimal128(14, 2))
    assert list(meter.validate(bad).errors) == ["TemporalFormatRule", "DecimalPrecisionRule"]
    assert list(Validator([*meter.rules, NullabilityRule(["kwh"])]).validate(good).errors) == ["NullabilityRule"]
