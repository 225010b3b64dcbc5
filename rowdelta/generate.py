"""Deterministic source and target pairs for tests, written by Spark."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdelta.sinks.files import write_files

FIRST = ("Ada", "Ben", "Chloe", "Dan", "Eve", "Finn", "Grace", "Hugo", "Iris", "Jack")
LAST = ("Archer", "Baker", "Carter", "Dyer", "Fisher", "Mason", "Potter", "Smith", "Turner", "Weaver")
DOMAINS = ("example.com", "example.org", "example.net")
STATUS = ("active", "inactive", "pending", "closed")
STATES = ("CA", "NY", "TX", "WA", "FL", "IL")
DAY = 86_400


@dataclass(frozen=True)
class PairConfig:
    """``new_ids`` is the share of target rows with ids the source lacks; ``changed`` the share of the other rows
    whose fields are drawn anew and whose e-mail names the id. ``errors`` perturbs single fields of target rows, ``nulls`` empties nullable ones."""

    rows: int = 1_000_000
    seed: int = 42
    new_ids: float = 0.1
    changed: float = 1.0
    errors: float = 0.01
    nulls: float = 0.05
    new_columns: bool = True
    missing_columns: bool = False


#: What is drawn for a row, in the order of the stream: fields and control draws, each a word of 32 bits.
FIELDS = ("first_name", "last_name", "email", "age", "score", "balance", "active", "status", "created_at", "updated_at", "state", "lat", "long", "last_login")
DRAWS = ("first", "last", "domain", "age", "years", "score", "balance", "active", "status", "created", "updated", "state", "lat", "long", "login", *(f"null {f}" for f in FIELDS))
CONTROLS = ("reuse", "changed", "error", "which")


def _stream(seed: Column | int, block: Column | str) -> Column:
    """Four words of a row's stream of draws: the MD5 of seed, row number and block as text, so that any engine can
    repeat it, whatever row it starts at."""
    return F.md5(F.concat_ws(":", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), F.col("n").cast("string"), F.lit(block)))


def _word(digest: str, place: int) -> Column:
    """In [0, 1), from the ``place``-th word of a column of digests."""
    return F.conv(F.substring(digest, 1 + 8 * place, 8), 16, 10).cast("double") / float(1 << 32)


def _control(salt: str) -> Column:
    return _word("c", CONTROLS.index(salt))


def _draw(salt: str) -> Column:
    i = DRAWS.index(salt)
    return _word(f"d{i // 4}", i % 4)


def _with_draws(rows: DataFrame, seed: Column | int) -> DataFrame:
    """The digests of a row's field draws as columns, made once each."""
    return rows.withColumns({f"d{k}": _stream(seed, str(k)) for k in range(-(-len(DRAWS) // 4))})


def _pick(values: tuple[str, ...], salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(_draw(salt) * len(values)) + 1).cast("int"))


def _at(seconds: Column) -> Column:
    """A time without zone, so many seconds after the start of 1970."""
    return F.timestamp_add("SECOND", seconds.cast("long"), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def _fields(target: bool, config: PairConfig) -> dict[str, Column]:
    first, last = _pick(FIRST, "first"), _pick(LAST, "last")
    start = F.lit(1_700_000_000) - F.floor(_draw("created") * 1000) * DAY
    update = start + F.floor(_draw("updated") * 300) * DAY
    error = F.when(_control("error") < config.errors, F.floor(_control("which") * 4)).otherwise(-1) if target else F.lit(-1)
    score = _draw("score") * 100
    balance = F.floor(_draw("balance") * 1_000_000) / 100
    out = {
        "first_name": F.when(error == 0, F.concat(first, F.lit("X"))).otherwise(first),
        "last_name": last,
        "email": F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@"), _pick(DOMAINS, "domain")),
        "age": (18 + F.floor(_draw("age") * 80) + F.when(error == 1, F.floor(_draw("years") * 5)).otherwise(0)).cast("int"),
        "score": (F.floor(score * F.when(error == 2, 1.1).otherwise(1.0) * 100) / 100).cast("decimal(10,2)"),
        "balance": F.when(error == 3, -balance).otherwise(balance),
        "active": _draw("active") > 0.3,
        "status": _pick(STATUS, "status"),
        "created_at": _at(start),
        "updated_at": _at(update),
    }
    if target and config.new_columns:
        out |= {
            "state": _pick(STATES, "state"),
            "lat": _draw("lat") * 170 - 85,
            "long": _draw("long") * 360 - 180,
            "last_login": _at(update + (1 + F.floor(_draw("login") * 30)) * DAY),
        }
    if target and config.missing_columns:
        del out["created_at"], out["updated_at"]
    return {k: F.when(_draw(f"null {k}") >= config.nulls, v) for k, v in out.items()}


def _id(seed: int) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "n"), 256), 1, 32)


def _with_id(rows: DataFrame, fields: dict[str, Column], seed: int) -> DataFrame:
    """The generator's metadata is the id column's, and from there that of the footers of the files written."""
    made = {"created_by": "rowdelta", "version": "1.0.0", "timestamp": datetime.now(timezone.utc).isoformat(timespec="seconds")}
    return rows.select(_id(seed).alias("id", metadata=made), *[c.alias(k) for k, c in fields.items()])


def source(spark: SparkSession, config: PairConfig = PairConfig()) -> DataFrame:
    rows = _with_draws(spark.range(config.rows).withColumnRenamed("id", "n"), config.seed)
    return _with_id(rows, _fields(False, config), config.seed)


def target(spark: SparkSession, config: PairConfig = PairConfig()) -> DataFrame:
    """As many rows: ids of the source, chosen by a draw without a shuffle, and new ones for the rest."""
    n = F.col("n")
    rows = spark.range(config.rows).withColumnRenamed("id", "n").withColumn("c", _stream(config.seed, "c"))
    # a row whose id is not reused gets a number beyond all of the source's
    rows = rows.select(F.when(_control("reuse") >= config.new_ids, n).otherwise(n + config.rows).alias("n"))
    rows = rows.withColumn("c", _stream(config.seed, "c"))
    changed = (n < config.rows) & (_control("changed") < config.changed)
    rows = rows.withColumn("changed", changed)
    seed = F.when((n >= config.rows) | F.col("changed"), F.lit(config.seed + 1)).otherwise(F.lit(config.seed))
    rows = _with_draws(rows, seed)
    fields = _fields(True, config)
    mail = F.concat(F.lit("modified_"), _id(config.seed), F.lit("@example.com"))
    fields["email"] = F.when(F.col("changed") & fields["email"].isNotNull(), mail).otherwise(fields["email"])
    return _with_id(rows, fields, config.seed)


def write_pair(spark: SparkSession, source_path: str, target_path: str, config: PairConfig = PairConfig()) -> None:
    for df, path in ((source(spark, config), source_path), (target(spark, config), target_path)):
        write_files(df, path, "parquet")
