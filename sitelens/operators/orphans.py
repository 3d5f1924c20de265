"""References to records that do not exist: orphan references per table and period.

Method
------
* Every key that a reference uses is *dictionary-encoded*: keys are spread over hash ranges
  and numbered inside their range, so no global sort or counter is needed.
* References become one bitmap per key range of 32,768 keys, period (month) and table. A
  parent's life becomes the span of months that it fills wholly; keys of one range with the
  same span share a bitmap, so a life costs one bit however long it lasts. Bitmaps are stored
  in the smallest of three containers (positions, runs, bits).
* ``references AND NOT parents`` is computed range by range: the bitmaps of the spans that hold
  a month are united and taken off the references of that month. The bits that survive are
  decoded to keys.
* The surviving keys are joined back to the references and checked against the exact life
  spans, which settles the months in which a parent begins or ends.

Scale: references are reduced to distinct (key, month) pairs and lives to one row per key and
first month, with map-side aggregation, before anything is joined with the dictionary; a key
that holds a third of all references is one bit per month. A range has at most one bitmap
for each table and month and for each pair of months. Both joins of surviving references
are salted against hot keys. Nothing is collected but the first and last month and a count.

Defined cases: null and blank references are no references; a parent without a start never
lives; a parent or reference whose key parts are null matches nothing; a reference without
a time has no live target; repeated rows give one result row; empty tables work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.session import stored

RANGE_BITS = 32_768
SALTS = 8
#: Last month of a life without end.
EVER = 1 << 30
#: Period of references without a time: no parent is ever live in it.
NO_PERIOD = -1


def normal_key(c: str | Column) -> Column:
    """A reference as it is compared: no surrounding white space, lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def compound(*parts: str | Column) -> Column:
    """One string for a key of several parts; null if any part is."""
    return F.concat(*[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in (F.col(p) if isinstance(p, str) else p for p in parts)])


def month_no(t: str | Column) -> Column:
    return F.coalesce(F.year(t) * 12 + F.month(t) - 1, F.lit(NO_PERIOD))


def pack(bits: bytes) -> bytes:
    """The smallest container for a bitmap: positions (A), runs (R) or bits (B)."""
    flags = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    at = np.flatnonzero(flags).astype("<u2")
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags, [0])).astype(np.int8)))
    runs = np.stack([edge[::2], edge[1::2] - 1], 1).astype("<u2")
    return min(b"A" + at.tobytes(), b"R" + runs.tobytes(), b"B" + bytes(bits), key=len)


def unpack(box: bytes | None) -> np.ndarray:
    flags = np.zeros(RANGE_BITS, bool)
    if box:
        kind, body = box[:1], box[1:]
        if kind == b"A":
            flags[np.frombuffer(body, "<u2")] = True
        elif kind == b"R":
            step = np.zeros(RANGE_BITS + 1, np.int32)
            runs = np.frombuffer(body, "<u2").reshape(-1, 2).astype(int)
            step[runs[:, 0]] += 1
            step[runs[:, 1] + 1] -= 1
            flags = np.cumsum(step)[:-1] > 0
        else:
            flags = np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little").astype(bool)
    return flags


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.names.index("bits")
        yield b.set_column(at, pa.field("bits", pa.binary()), pa.array([pack(x) for x in b.column(at).to_pylist()], pa.binary()))


def _bitmaps(df: DataFrame, *by: str) -> DataFrame:
    """Compressed bitmaps of ``pos`` per key range and ``by``."""
    out = df.groupBy(*by, "rng").agg(F.bitmap_construct_agg("pos").alias("bits"))
    return out.mapInArrow(_packed, out.schema)


_SURVIVOR = pa.schema([("src_table", pa.string()), ("rng", pa.int64()), ("period", pa.int32()), ("pos", pa.int64())])


def _and_not(key: tuple[pa.Scalar, ...], refs: pa.Table, spans: pa.Table) -> pa.Table:
    """The bits of one key range that no life covers for the whole of their month."""
    lives = [(a, z, unpack(bits)) for a, z, bits in zip(*(spans.column(c).to_pylist() for c in ("first", "last", "bits")))]
    covered: dict[int, np.ndarray] = {}
    out = []
    for table, period, bits in zip(*(refs.column(c).to_pylist() for c in ("src_table", "period", "bits"))):
        if period not in covered:
            covered[period] = np.logical_or.reduce([flags for a, z, flags in lives if a <= period <= z] or [np.zeros(RANGE_BITS, bool)])
        pos = np.flatnonzero(unpack(bits) & ~covered[period])
        out.append(pa.Table.from_arrays([pa.array([table] * len(pos), pa.string()), pa.array([key[0].as_py()] * len(pos), pa.int64()), pa.array([period] * len(pos), pa.int32()), pa.array(pos, pa.int64())], schema=_SURVIVOR))
    return pa.concat_tables(out) if out else _SURVIVOR.empty_table()


def whole_months(parents: DataFrame, first: int, last: int) -> DataFrame:
    """(key, first, last): spans of whole months that a life fills, cut to the months in use; of the
    spans of a key that begin in one month the longest."""
    start = F.col("live_from") == F.date_trunc("month", "live_from")
    begins = F.greatest(month_no("live_from") + F.when(start, 0).otherwise(1), F.lit(first))
    ends = F.least(F.when(F.col("live_to").isNull(), F.lit(EVER)).otherwise(month_no("live_to") - 1), F.lit(last))
    spans = parents.select("key", begins.cast("int").alias("first"), ends.cast("int").alias("last")).where("first <= last")
    return spans.groupBy("key", "first").agg(F.max("last").alias("last"))


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References without a live parent.

    ``refs``: src_table, src_key, src_item, ref_key, key, t. ``parents``: key, live_from,
    live_to (null: still live). Both ``key`` columns hold the same encoding; null matches
    nothing. Returns ``refs`` rows (distinct) of the orphans, with ``period`` (month number).
    """
    refs = refs.where(F.col("ref_key").isNotNull() & (F.col("ref_key") != "")).withColumn("period", month_no("t")).withColumn("key", F.coalesce("key", F.lit("?")))
    parents = parents.where(F.col("key").isNotNull() & F.col("live_from").isNotNull() & (F.col("live_to").isNull() | (F.col("live_to") > F.col("live_from"))))

    used = stored(refs.select("src_table", "key", "period").distinct(), "used")
    first, last, keys = used.agg(F.min(F.when(F.col("period") != NO_PERIOD, F.col("period"))), F.max("period"), F.approx_count_distinct("key")).first()
    first, last = (first, last) if first is not None else (0, 0)
    ranges = max(8, int((keys or 0) // (RANGE_BITS // 2)) + 1)
    coded = used.select("key").distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(ranges)))
    dictionary = stored(
        coded.withColumn("no", F.expr("row_number() over (partition by bucket order by key) - 1")).select(
            "key", (F.col("bucket") + ranges * F.floor(F.col("no") / RANGE_BITS)).cast("long").alias("rng"), (F.col("no") % RANGE_BITS).cast("long").alias("pos")
        ),
        "dictionary",
    )
    ref_bits = _bitmaps(used.join(dictionary, "key"), "src_table", "period")
    span_bits = _bitmaps(whole_months(parents, first, last).join(dictionary, "key"), "first", "last")
    left = ref_bits.groupBy("rng").cogroup(span_bits.groupBy("rng")).applyInArrow(_and_not, "src_table string, rng bigint, period int, pos bigint")
    survivors = stored(left.join(dictionary, ["rng", "pos"]).select("src_table", "key", "period"), "survivors")

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hit = refs.withColumn("salt", F.pmod(F.hash("src_key", "src_item"), F.lit(SALTS))).join(survivors.select("*", salts).hint("merge"), ["src_table", "key", "period", "salt"])
    lives = parents.join(survivors.select("key").distinct(), "key", "left_semi").select("key", "live_from", "live_to").distinct().select(F.col("key").alias("k"), "live_from", "live_to", salts.alias("s"))
    live = (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")) & (F.col("live_from") <= F.col("t")) & (F.col("live_to").isNull() | (F.col("t") < F.col("live_to")))
    return hit.join(lives.hint("merge"), live, "left_anti").select("src_table", "src_key", "src_item", "ref_key", "period").distinct()


def audit_references(judge: DataFrame, findings: DataFrame, affected: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references and parents of the audit tables, in the shape that ``orphans`` takes."""
    finding = findings.select("run_key", "fixture", "run_no", "produced_at", F.explode("sections").alias("s")).select("run_key", "fixture", "run_no", "produced_at", F.explode("s.findings").alias("f"))
    rule, told = lambda c: F.concat(F.lit("R"), compound(c)), lambda c: F.concat(F.lit("F"), compound("fixture", "run_no", c))
    refs = (
        judge.select(F.lit("judge").alias("src_table"), F.col("verdict_key").alias("src_key"), F.lit("").alias("src_item"), normal_key("finding_id").alias("ref_key"), "fixture", "run_no", F.col("judged_at").alias("t"))
        .withColumn("key", told(F.col("ref_key")))
        .drop("fixture", "run_no")
    )
    cited = finding.select(F.lit("findings").alias("src_table"), F.col("run_key").alias("src_key"), F.coalesce("f.id", F.lit("")).alias("src_item"), F.explode("f.rule_ids").alias("r"), F.col("produced_at").alias("t"))
    logged = affected.select(F.lit("affected_urls").alias("src_table"), F.col("hit_no").alias("src_key"), F.lit("").alias("src_item"), F.col("rule_id").alias("r"), F.col("logged_at").alias("t"))
    for df in (cited, logged):
        df = df.withColumn("ref_key", normal_key("r")).withColumn("key", rule(F.col("ref_key"))).drop("r")
        refs = refs.unionByName(df)
    parents = finding.select(told(normal_key("f.id")).alias("key"), F.col("produced_at").alias("live_from"), F.col("f.deleted_at").alias("live_to")).unionByName(
        registry.select(rule(normal_key("rule_id")).alias("key"), F.col("introduced_at").alias("live_from"), F.col("retired_at").alias("live_to"))
    )
    stamp = lambda c: F.col(c).cast("timestamp").alias(c)
    return refs.withColumn("t", stamp("t")), parents.select("key", stamp("live_from"), stamp("live_to"))
