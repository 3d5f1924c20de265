"""Rule files: JSON arrays of rules, whose parameters take the place of the built-in ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.rules import CATALOGUE, Rule

SCHEMA = "id string, kategorie string, scope string, severity string, title string, quelle string, datum string, lastReviewed string, params map<string,double>"


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, kategorie, scope, severity, title, quelle, datum, last_reviewed, params, file) of all .json
    files of a folder; a file that is no array of objects gives no rule."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return rows.where(F.col("id").isNotNull()).select(
        F.col("id").alias("rule_id"), "kategorie", "scope", "severity", "title", "quelle", "datum", F.col("lastReviewed").alias("last_reviewed"), F.coalesce("params", F.create_map().cast("map<string,double>")).alias("params"), F.col("_metadata.file_name").alias("file")
    )


def catalogue_of(rules: DataFrame) -> dict[str, Rule]:
    """The built-in rules that the files name, with the files' severity, scope and parameters. Rules
    without a detector are left out, so at most the built-in number of rows is collected."""
    known = rules.where(F.col("rule_id").isin(list(CATALOGUE))).dropDuplicates(["rule_id"]).collect()
    given = {r.rule_id: r for r in known}
    return {
        i: Rule(i, given[i].kategorie or rule.category, given[i].severity or rule.severity, given[i].scope or rule.scope, {**rule.params, **{k: v for k, v in given[i].params.items() if v is not None}})
        for i, rule in CATALOGUE.items()
        if i in given
    }


def parity(rules: DataFrame) -> DataFrame:
    """(rule_id, problem): rules of the files without a detector, and detectors without a rule."""
    mine = rules.sparkSession.createDataFrame([(i,) for i in CATALOGUE], "rule_id string")
    return (
        rules.select("rule_id").distinct().join(mine, "rule_id", "left_anti").withColumn("problem", F.lit("no detector"))
        .unionByName(mine.join(rules.select("rule_id"), "rule_id", "left_anti").withColumn("problem", F.lit("no rule")))
    )
