"""Secrets in texts, with corpus-wide ownership of their values, in DataFrame functions only.

Assignments, access keys and long hex runs are found by pattern. Further candidates are long tokens of mixed
letters and digits. The hashes of all candidate values are aggregated over the corpus by distinct repositories
and owners: a value that several owners or very many repositories hold is a widely copied example, one that few
hold looks like a live credential of theirs. Owner-specific tokens are added to the spans under the kind ``owned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key

_word = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
ASSIGN = "(" + "|".join(_word(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so asking for the least length here drops the same matches as dropping short ones later.
ACCESS, HEX, MIXED = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
SPAN = "array<struct<start:int,rank:int,end:int,value:bigint,check:bigint>>"


#: Sums are carried over runs of so many matches, so that a text's work is in proportion to its matches.
RUN = 256


def _before(lengths: str) -> str:
    """SQL: the sum of all values before each place of an array. Runs are summed first, then walked one by one."""
    runs = f"transform(sequence(0, (size({lengths}) - 1) div {RUN}), c -> slice({lengths}, c * {RUN} + 1, {RUN}))"
    none = "cast(array() as array<int>)"
    walk = lambda xs, start, add: f"aggregate({xs}, named_struct('at', {start}, 'out', {none}), (s, x) -> named_struct('at', s.at + {add}, 'out', array_append(s.out, s.at)), s -> s.out)"
    firsts = walk("r", "0", "aggregate(x, 0, (a, b) -> a + b)")
    return f"transform(array({runs}), r -> flatten(zip_with(r, {firsts}, (run, first) -> {walk('run', 'first', 'x')})))[0]"


def _spans(pattern: str, rank: int, group: int, fits) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches whose group ``fits``.

    The lengths of the pieces between the matches give the places, in code points."""
    q = pattern.replace("\\", "\\\\").replace("'", "\\'")
    whole, part, between = f"regexp_extract_all(text, '{q}', 0)", f"regexp_extract_all(text, '{q}', {group})", f"split(text, '{q}', -1)"
    none = "cast(array() as array<struct<start:int,end:int,v:string>>)"
    lengths = "zip_with(x.m, slice(x.p, 1, size(x.m)), (m, p) -> length(m) + length(p))"
    start = "y.at[i] + length(x.p[i])"
    each = f"transform(sequence(0, size(x.m) - 1), i -> named_struct('start', {start}, 'end', {start} + length(x.m[i]), 'v', x.v[i]))"
    placed = f"transform(array(named_struct('at', {_before('l')})), y -> {each})[0]"
    made = f"transform(array(named_struct('m', {whole}, 'v', {part}, 'p', {between})), x -> transform(array({lengths}), l -> {placed})[0])[0]"
    spans = F.when(F.expr(f"text rlike '{q}'"), F.expr(made)).otherwise(F.expr(none))
    spans = F.filter(spans, lambda s: fits(s["v"]))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.xxhash64(s["v"]).alias("value"), F.xxhash64(F.lit("#"), s["v"]).alias("check"))).cast(SPAN)


def _clear(spans: str, others: str) -> str:
    """SQL: the spans that overlap none of the others. Both are in order and each is disjoint, so runs of spans are held
    against the runs of others that reach into theirs, of which there are few."""
    runs = lambda x: f"if(size({x}) = 0, cast(array() as array<{SPAN}>), transform(sequence(0, (size({x}) - 1) div {RUN}), c -> slice({x}, c * {RUN} + 1, {RUN})))"
    reaches = "o[0].start < r[size(r) - 1].end and r[0].start < o[size(o) - 1].end"
    free = "filter(r, m -> not exists(near, b -> b.start < m.end and m.start < b.end))"
    each = f"transform(array(flatten(filter(runs, o -> {reaches}))), near -> {free})[0]"
    return f"transform(array({others}), base_ -> transform(array({runs('base_')}), runs -> flatten(transform({runs(spans)}, r -> {each})))[0])[0]"


def shown(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", copied_owners: int = 3, copied_repositories: int = 50) -> DataFrame:
    """doc_id, base (spans), added (spans), n_owned, n_copied, most_owners and most_repositories for each row of
    ``docs`` (doc_id, text, owner).

    base are the assign, access and hex spans by start, then kind; added are mixed tokens outside of them
    whose value is owned: fewer than ``copied_owners`` distinct owners and fewer than ``copied_repositories``
    distinct repositories hold it. n_owned and n_copied count all candidates of the row by that line; most_owners
    and most_repositories are those of its most common candidate (0 without one). The owner is the column
    ``owner``, a repository the column ``repository`` of an owner; null is a value of either.

    A null text is empty. Repeated rows do not make a value common, as their repository is one. Rows are told apart
    by doc_id (null is a value) and text; equal rows get equal results. Work on a text is about in proportion to its
    length: spans are held against others by runs of ``RUN``. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text.alias("text"))
    any_ = lambda v: F.lit(True)
    assign = _spans(ASSIGN, 1, 2, lambda v: F.length(v) >= 6)
    base = F.array_sort(F.concat(assign, _spans(ACCESS, 2, 0, any_), _spans(HEX, 3, 0, any_)))
    # access keys and hex runs are parts of a mixed token that overlaps them: its text tells
    mixed = _spans(MIXED, 4, 0, lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]") & ~v.rlike(f"{ACCESS}|{HEX}"))
    found = docs.select("doc_id", "owner", "repository", text_key(F.col("text")).alias("text_hash"), base.alias("base"), mixed.alias("mixed"))
    found = stored(found.withColumn("mixed", F.expr(_clear("mixed", "filter(base, b -> b.rank = 1)"))), "candidates")

    each = found.select("doc_id", "text_hash", "owner", "repository", F.explode(F.concat("base", "mixed")).alias("s"))
    # distinct, then counts: every step is pre-aggregated before its shuffle
    held = each.select("s.value", "s.check", "owner", "repository").distinct().groupBy("value", "check", "owner").agg(F.count("*").alias("repositories"))
    # written, so that adaptive execution can split the join with a value that very many rows hold
    held = stored(held.groupBy("value", "check").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")), "held")
    known = each.select("doc_id", "text_hash", "s", F.col("s.value").alias("value"), F.col("s.check").alias("check")).dropDuplicates(["doc_id", "text_hash", "s"]).join(held, ["value", "check"])
    few = (F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories)
    zero = F.lit(0).cast("long")
    most = {"most_owners": F.max("owners"), "most_repositories": F.max("repositories")}
    counts = {"n_owned": F.count_if(few), "n_copied": F.count_if(~few)} | most
    by_row = known.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_list(F.when(few & (F.col("s.rank") == 4), F.col("s")))).alias("added"), *(c.alias(k) for k, c in counts.items()))
    out = found.join(by_row, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"), *(F.coalesce(k, zero).alias(k) for k in counts))
