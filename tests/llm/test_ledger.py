from collections import defaultdict

from pyspark.sql import functions as F

from sitelens.llm import ledger as G

ROWS = [
    (1, "Red Lamp!", "Buy now"), (2, "red  lamp", "BUY, now."), (3, "Buy now", "RED lamp"), (4, "Réd lamp", "Buy now"), (5, None, "Buy now"), (6, "...", "Buy now"), (7, "Red Lamp!", "Buy now"),
    (8, "a", "a"), (9, "A", "a."), (10, "Straße", "x"), (11, "STRASSE", "X"), (12, "x" * 50_000, "y"), (13, "X" * 50_000, " y "),
]
WANT = {1: 4, 8: 2, 10: 2, 12: 2}


def keyed(spark, rows):
    df = spark.createDataFrame([(*r, "clash", b"k") for r in rows], "row_no bigint, title string, meta_desc string, copies string, bucket binary")
    return df.withColumn("key", G.canonical_key("title", "meta_desc"))


def test_groups(spark):
    df = keyed(spark, ROWS)
    for cuts in ([F.lit(True)], [F.col("row_no") < 4, F.col("row_no") >= 4], [F.col("row_no") > 6, F.lit(False), F.col("row_no") <= 6], [F.col("row_no") == n for n in range(1, 14)][::-1]):
        led = G.build(df, cuts)
        rows = {r.first_row: r.copies for r in led.rows().collect()}
        assert {k: v for k, v in rows.items() if v > 1} == WANT
        got = defaultdict(set)
        for r in G.members(df, led).collect():
            got[r.first_row].add(r.row_no)
        assert dict(got) == {1: {1, 2, 3, 7}, 8: {8, 9}, 10: {10, 11}, 12: {12, 13}}


def test_empty_and_hot(spark, monkeypatch):
    df = keyed(spark, ROWS)
    led = G.build(df.where("false"), [F.lit(True)])
    assert led.rows().count() == 0 and G.members(df, led).count() == 0
    many = spark.range(5000).select(F.col("id").alias("row_no"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.col("id").cast("string")).alias("title"), F.lit("d").alias("meta_desc")).withColumn("key", G.canonical_key("title", "meta_desc"))
    led = G.build(many, [F.lit(True)])
    assert G.members(many, led).count() == 1667 and {r.first_row for r in G.members(many, led).collect()} == {0}


def test_words(spark):
    texts = {
        "caf\u00e9 X": "caf\u00e9 x", "Cafe\u0301 x": "caf\u00e9 x", "cafe x": "cafe x", "की": "की", "का": "का", "\u2764\ufe0f ok": "ok", "\u0301 a1\u20e3": "a1\u20e3", "MASSE Maße ΣΑΣ": "masse masse σασ", "\u0301": "",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.w for r in df.select("t", G.words_of("t").alias("w")).collect()} == texts


def test_ledger_goes_on_from_its_folder(spark, tmp_path):
    df, path = keyed(spark, ROWS).cache(), f"file://{tmp_path}/ledger"
    G.Ledger(spark, path).add(df.where("row_no < 4"))
    later = G.Ledger(spark, path)  # as another session would open it
    assert later.version == 1 and {r.first_row: r.copies for r in later.rows().collect()} == {1: 3}
    later.add(df.where("row_no >= 4"))
    again = G.Ledger(spark, path)
    assert again.version == 2 and {r.first_row: r.copies for r in again.rows().collect() if r.copies > 1} == WANT
    again.add(df.where("false"))
    assert G.Ledger(spark, path).version == 2


def test_only_touched_buckets_are_read(spark):
    many = spark.range(3000).select(F.col("id").alias("row_no"), F.unhex(F.md5(F.col("id").cast("string"))).alias("key"))
    led = G.build(many, [F.lit(True)])
    before = dict(led.where)
    one = many.where("row_no = 7").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("r"))
    (bucket,) = [r[0] for r in one.select(led._bucket()).collect()]
    plan = led.merged(one, [bucket])._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan and f" = {bucket})" in plan
    led.add(many.where("row_no = 7"))
    assert {b for b in led.where if led.where[b] != before[b]} == {bucket} and len(before) == G.LEAST_BUCKETS
    assert led.rows().where("copies = 2").count() == 1 and led.rows().count() == 3000


def test_buckets_grow_with_the_ledger(spark):
    many = spark.range(4000).select(F.col("id").alias("row_no"), F.unhex(F.md5((F.col("id") % 3000).cast("string"))).alias("key"))
    led = G.build(many, [F.col("row_no") < 100, F.col("row_no") >= 100], keys_per_bucket=50)
    assert led.buckets >= 60 and led.rows().count() == 3000 and led.rows().agg(F.sum("copies")).first()[0] == 4000
    assert led.rows().where("copies = 2 and first_row < 1000").count() == 1000
