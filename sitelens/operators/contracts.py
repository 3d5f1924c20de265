"""Contracts of JSON documents as tables of checks: every broken rule is one row, all at once.

A document is parsed once as a variant; a check looks at one path. ``errors`` runs any list of
checks, ``FINDINGS`` and ``EXPECTED`` are those of the audit's documents.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Field(NamedTuple):
    """A member and what it must be: string, number, boolean, object, array or strings (an array of them)."""

    path: str
    kind: str
    required: bool = True
    nullable: bool = False


def fields(kind: str, at: str, names: str, **more: bool) -> list[Field]:
    return [Field(f"{at}.{n}" if at else n, kind, **more) for n in names.split()]


FINDINGS = [
    *fields("object", "", "meta execSummary strategy confidence"), *fields("array", "", "sections"), *fields("strings", "", "positives"),
    *fields("string", "meta", "url modelId rulesetVersion siteType"), Field("meta.crawledAt", "string", nullable=True), Field("meta.coveragePct", "number", nullable=True), Field("meta.sampleSize", "number"),
    *fields("strings", "execSummary", "metrics patterns quickWins"), *fields("strings", "strategy", "levers todos"), Field("confidence.sampleSize", "number"), Field("confidence.minNMet", "boolean"), Field("confidence.caveats", "strings"),
]
SECTION = [*fields("string", "", "id title"), Field("num", "number"), Field("findings", "array")]
FINDING = [*fields("string", "", "id title category severity prov befund beleg auswirkung empfehlung"), Field("ice", "object"), Field("kbSources", "array"), Field("ruleIds", "strings", required=False)]
EXPECTED = [Field("fixture", "string"), *fields("array", "", "mustContain mustNotContain")]
MUST = [Field("ruleId", "string"), *fields("string", "", "urlAnchor note", required=False)]
MUST_NOT = [Field("ruleId", "string"), Field("reason", "string", required=False)]
_NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _get(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, "$" + "".join(f".{p}" for p in path.split(".")) if path else "$", "variant")


def kind_of(v: Column) -> Column:
    """What a value is, in the words of ``Field``; null if it is absent."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s.rlike(_NUMBERS), "number").otherwise("other")
    )


def problems_of(doc: Column, checks: list[Field], at: str | Column = "") -> Column:
    """The broken checks of a value, as an array of texts; a check below an absent parent is silent."""
    at, out = F.lit(at) if isinstance(at, str) else at, []
    for c in checks:
        value, parent = _get(doc, c.path), c.path.rpartition(".")[0]
        kind = kind_of(value)
        there = kind_of(_get(doc, parent)) == "object" if parent else F.lit(True)
        fits = (kind == "array") if c.kind == "strings" else (kind == c.kind)
        wrong = kind.isNotNull() & ~(fits | F.lit(c.nullable) & (kind == "null"))
        say = lambda text, p=c.path: F.concat(at, F.lit(f"{p}: {text}"))
        out.append(F.when(there & kind.isNull() & F.lit(c.required), say("missing")).when(there & wrong, say(f"must be {'an array' if c.kind == 'strings' else c.kind}")))
        if c.kind == "strings":
            entries = F.try_variant_get(doc, "$." + c.path, "array<variant>")
            out.append(F.when(there & (kind == "array") & F.exists(entries, lambda e: kind_of(e) != "string"), say("must hold strings")))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _entries(doc: Column, path: str, name: str | Column) -> Column:
    """(name with place, entry) of an array's entries."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.transform(F.coalesce(F.try_variant_get(doc, "$." + path, "array<variant>"), F.array().cast("array<variant>")), lambda v, i: F.struct(F.concat(name, F.lit("["), i.cast("string"), F.lit("]")).alias("at"), v.alias("v")))


def _checked(entries: Column, checks: list[Field]) -> Column:
    """Problems of each entry: no object, or its broken checks."""
    return F.flatten(F.transform(entries, lambda e: F.when(kind_of(e["v"]) != "object", F.array(F.concat(e["at"], F.lit(": must be object")))).otherwise(problems_of(e["v"], checks, F.concat(e["at"], F.lit("."))))))


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.try_parse_json(text).alias("doc"))


def _listed(docs: DataFrame, key: str, found: Column) -> DataFrame:
    whole = F.when(F.col("doc").isNull() | (kind_of(F.col("doc")) != "object"), F.array(F.lit("no JSON object"))).otherwise(found)
    return docs.select(key, F.explode(whole).alias("problem"))


def findings_errors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, problem) for each broken rule of findings documents: shapes, and the rules between members."""
    docs = _documents(df, key, text)
    doc = F.col("doc")
    sections = _entries(doc, "sections", "sections")
    findings = F.flatten(F.transform(sections, lambda s: _entries(s["v"], "findings", F.concat(s["at"], F.lit(".findings")))))
    number = lambda p: F.try_variant_get(doc, "$." + p, "double")
    met = F.try_variant_get(doc, "$.confidence.minNMet", "boolean")
    between = F.filter(
        F.array(
            F.when(met != (number("confidence.sampleSize") >= 5), F.lit("confidence.minNMet: must tell whether sampleSize is 5 or more")),
            F.when(number("meta.sampleSize") != number("confidence.sampleSize"), F.lit("meta.sampleSize: must equal confidence.sampleSize")),
        ),
        lambda x: x.isNotNull(),
    )
    return _listed(docs, key, F.concat(problems_of(doc, FINDINGS), _checked(sections, SECTION), _checked(findings, FINDING), between))


def expected_errors(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, problem) for each broken rule of expectation documents."""
    docs = _documents(df, key, text)
    doc = F.col("doc")
    return _listed(docs, key, F.concat(problems_of(doc, EXPECTED), _checked(_entries(doc, "mustContain", "mustContain"), MUST), _checked(_entries(doc, "mustNotContain", "mustNotContain"), MUST_NOT)))
