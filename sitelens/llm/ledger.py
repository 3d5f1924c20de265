"""Duplicates hidden by formatting differences: an incremental ledger of canonical keys.

Method
------
A record's canonical key is the digest of the word sequences of its texts, in any order of
the texts. The ledger is a folder: it holds one row per key, in buckets by key, with the
number of copies and the earliest record, and a manifest that tells which version of each
bucket counts. A batch is aggregated by key and full-outer-joined with the buckets that it
touches; counts are added, the earliest representative is kept, and those buckets are written
anew as the next version. The others are neither read nor written. Any later session opens
the folder and goes on.

Scale: keys are 16-byte digests, so no text is shuffled; a batch is aggregated map-side, so
a group that holds a third of all rows is one row per task before the shuffle. The number of
buckets is taken from the size of the first batch and doubled when the ledger outgrows it, so
that a bucket stays near ``KEYS_PER_BUCKET`` keys. Members are found by joining keys with the
ledger; keys that hold more than a thousandth of all rows (at most a thousand by arithmetic)
are broadcast, all others are joined by shuffle.

Words: a word is a run of letters and digits with their accents and vowel signs, whatever
the case; composed and decomposed accents are the same, missing ones are not. Letters with two
lower-case forms are one: final and other sigma, and sharp s with ss, its capital form
(so "Maße" and "MASSE" are copies, and "Masse" with them).

Defined cases: a record with a null text or a text without letter or digit has no key and is
in no group; exact repeats count as copies; equal texts in both fields work; an empty batch
leaves the ledger as it is; columns of other names pass by unread.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from sitelens.session import scratch_path, stored

HOT_SHARE = 1000
LEAST_BUCKETS, KEYS_PER_BUCKET = 8, 1_000_000


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in texts], dtype=object)


def words_of(c: str | Column) -> Column:
    """The sequence of words of a text. Only texts with combining marks leave the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.coalesce(_composed(F.when(c.rlike(r"\p{M}"), c)), c)
    lower = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    # marks belong to the letter or digit before them; alone, or as mere variants of a symbol, they are no word
    bare = F.regexp_replace(lower, r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{034F}]|(?<![\p{L}\p{N}\p{M}])\p{M}+", " ")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}\p{M}]+", " "))


def canonical_key(*texts: str) -> Column:
    """16 bytes that are equal for records with the same texts; null without a usable text."""
    parts = [words_of(t) for t in texts]
    usable = reduce(lambda a, b: a & b, [F.coalesce(p != "", F.lit(False)) for p in parts])
    return F.when(usable, F.unhex(F.md5(F.array_join(F.array_sort(F.array(*parts)), "\n"))))


class Ledger:
    """Copies and earliest record of each canonical key, in buckets of parquet files.

    ``path`` names a new folder or that of an earlier ledger, which is continued. One writer at a time.
    """

    SCHEMA = "key binary, copies bigint, first_row bigint, bucket int"
    MANIFEST = "version int, bucket int, buckets int, keys bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, keys_per_bucket: int = KEYS_PER_BUCKET):
        self.spark, self.path, self.keys_per_bucket = spark, path or scratch_path(spark, "ledger"), keys_per_bucket
        self.version, self.buckets = 0, 0
        self.where: dict[int, int] = {}  # bucket -> version that holds it
        self.keys: dict[int, int] = {}  # bucket -> number of keys
        self._open()

    def _open(self) -> None:
        """State from the manifest: for each bucket of the latest division its latest version."""
        try:
            entries = self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:  # a new ledger
            return
        latest = entries.groupBy("bucket", "buckets").agg(F.max_by(F.struct("version", "keys"), "version").alias("e")).select("bucket", "buckets", "e.*").collect()
        if latest:
            self.version, self.buckets = max(r.version for r in latest), max(r.buckets for r in latest)
            own = [r for r in latest if r.buckets == self.buckets]
            self.where, self.keys = {r.bucket: r.version for r in own}, {r.bucket: r["keys"] for r in own}

    def _read(self, buckets: list[int]) -> DataFrame:
        parts: dict[int, list[int]] = {}
        for b in buckets:
            if b in self.where:
                parts.setdefault(self.where[b], []).append(b)
        frames = [self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v{v}").where(F.col("bucket").isin(bs)) for v, bs in parts.items()]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], self.SCHEMA)

    def _divide(self, n: int) -> None:
        """Writes the ledger in ``n`` buckets, each of the old ones into several."""
        everything = self._read(list(self.where)).drop("bucket")
        self.buckets, self.where, self.keys = n, {}, {}
        self._write(everything)

    def _bucket(self) -> Column:
        return F.pmod(F.crc32("key"), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        self.version += 1
        out = f"{self.path}/v{self.version}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(out)
        counts = self.spark.read.schema(self.SCHEMA).parquet(out).groupBy("bucket").agg(F.count(F.lit(1)).alias("keys")).collect()
        state = [(self.version, r.bucket, self.buckets, r["keys"]) for r in counts]
        self.spark.createDataFrame(state, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")  # from here on the version counts
        self.where.update({b: self.version for _, b, _, _ in state})
        self.keys.update({b: k for _, b, _, k in state})

    def merged(self, new: DataFrame, touched: list[int]) -> DataFrame:
        """The touched buckets with the batch's counts added."""
        old = self._read(touched)
        return new.join(old.select("key", "copies", "first_row"), "key", "full_outer").select("key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("first_row", "r").alias("first_row"))

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of (row_no, key)."""
        new = stored(batch.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("r")), "batch")
        size = new.count()
        if not size:
            return
        wanted = max(LEAST_BUCKETS, -(-(size + sum(self.keys.values())) // self.keys_per_bucket))
        if not self.buckets:
            self.buckets = wanted
        elif wanted > 2 * self.buckets:
            n = self.buckets
            while n < wanted:
                n *= 2
            self._divide(n)
        touched = [r[0] for r in new.select(self._bucket()).distinct().collect()]  # at most one row for each bucket
        self._write(self.merged(new, touched))

    def rows(self) -> DataFrame:
        return self._read(list(self.where))


def build(keyed: DataFrame, batches: list[Column], path: str | None = None, keys_per_bucket: int = KEYS_PER_BUCKET) -> Ledger:
    """A ledger from batches of ``keyed`` (row_no, key, ...), each given by a condition; every batch
    opens the ledger from its folder, as a job of its own would."""
    spark = keyed.sparkSession
    path = path or scratch_path(spark, "ledger")
    for condition in batches:
        Ledger(spark, path, keys_per_bucket).add(keyed.where(condition).select("row_no", "key"))
    return Ledger(spark, path, keys_per_bucket)


def members(keyed: DataFrame, ledger: Ledger) -> DataFrame:
    """(row_no, first_row, copies) of the records in groups of two or more."""
    groups = ledger.rows().where("copies > 1").select("key", "copies", "first_row")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    line = max(1000, total // HOT_SHARE)
    rows = keyed.where("key is not null").select("row_no", "key")
    hot, rest = groups.where(F.col("copies") > line), groups.where(F.col("copies") <= line)
    hot_rows = rows.join(F.broadcast(hot), "key")
    rest_rows = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key")
    return hot_rows.unionByName(rest_rows).select("row_no", "first_row", "copies")
