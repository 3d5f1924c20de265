"""Queries of the language-model data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import chunks, leaks, ledger, lookalikes, neighbours, packing, sentences
from sitelens.session import stored, table

TEXTS = ["title", "meta_desc", "h1"]


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of the knowledge base as pieces of at most 1,200 characters."""
    return chunks.split_oversized(table(spark, sf_dir, "kb_chunks", "chunk_no", "heading", "content"), "chunk_no")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that had to be cut."""
    return p2_pieces(spark, sf_dir).where("piece_count > 1").select("chunk_no").distinct()


def p2_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content put together again from the own parts of its pieces, by digest, and whether all pieces fit."""
    own = F.struct("piece_no", F.expr("right(text, part_end - part_start)").alias("part"))
    parts = p2_pieces(spark, sf_dir).groupBy("chunk_no").agg(F.array_sort(F.collect_list(own)).alias("parts"), (F.max(F.when(F.col("piece_count") > 1, F.length("text")).otherwise(0)) <= chunks.LIMIT).alias("fits"))
    whole = table(spark, sf_dir, "kb_chunks", "chunk_no", "heading", "content")
    size = F.length(F.coalesce("content", F.lit(""))) + F.when(F.coalesce("heading", F.lit("")) != "", F.length("heading") + 1).otherwise(0)
    cut = whole.where(size > chunks.LIMIT).select("chunk_no")  # pieces within the limit carry their heading once
    return parts.join(cut, "chunk_no").select("chunk_no", F.md5(F.array_join(F.transform("parts", lambda x: x["part"]), "")).alias("digest"), "fits")


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, description and heading of each page in their one ordinary form."""
    return lookalikes.canonicalize(table(spark, sf_dir, "crawl", "row_no", *TEXTS), "row_no", TEXTS).select("row_no", "field_name", "canonical", "disguised")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that are written with other characters than they look like."""
    return lookalikes.canonicalize(table(spark, sf_dir, "crawl", "row_no", *TEXTS), "row_no", TEXTS, only_changed=True).select("row_no", "field_name")


def _page_ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ledger.Ledger]:
    """Keys of the pages and their ledger, from two batches by time of ingestion."""
    keyed = stored(table(spark, sf_dir, "crawl", "row_no", "title", "meta_desc", "ingested_at").select("row_no", ledger.canonical_key("title", "meta_desc").alias("key"), "ingested_at").where("key is not null"), "page-keys")
    first, last = keyed.agg(F.min("ingested_at"), F.max("ingested_at")).first()
    if first is None:
        return keyed, ledger.build(keyed, [F.lit(True)])
    late = F.coalesce(F.col("ingested_at") >= F.lit(first + (last - first) / 2), F.lit(True))
    return keyed, ledger.build(keyed, [~late, late])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of a page with the first page of its group."""
    found = ledger.members(*_page_ledger(spark, sf_dir))
    return found.where("row_no <> first_row").select(F.col("first_row").alias("row_a"), F.col("row_no").alias("row_b"))


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each distinct page text, with its number of copies."""
    return _page_ledger(spark, sf_dir)[1].rows().select(F.col("first_row").alias("row_no"), "copies")


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of every chunk with a usable vector."""
    return neighbours.nearest(table(spark, sf_dir, "kb_chunks", "chunk_no", "vector"), "chunk_no", "vector")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the five most similar of the other."""
    return neighbours.unordered_pairs(p6_neighbours(spark, sf_dir), "chunk_no").select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text, or part of an oversized one, with its container."""
    return packing.fill_containers(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of the space that is used."""
    return p7_containers(spark, sf_dir).agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("used", F.round(F.col("tokens") / (F.col("containers") * packing.CAPACITY), 4))


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are packed, and breaches: containers beyond a limit, texts split though they fit, parts lost."""
    items = p7_containers(spark, sf_dir)
    full = items.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.sum("loss").alias("loss"))
    over = full.agg(F.count_if(F.col("tokens") > packing.CAPACITY).alias("over_tokens"), F.count_if(F.col("n") > packing.SEGMENTS).alias("over_segments"), F.count_if((F.col("n") > 1) & (F.col("loss") > packing.MOST_LOSS)).alias("over_loss"))
    texts = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last"), F.sum("tokens").alias("tokens"))
    whole = texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= packing.CAPACITY)).alias("split_though_fitting"), F.count_if(F.col("n") != F.col("last") + 1).alias("parts_lost"))
    return whole.withColumn("one", F.lit(1)).join(over.withColumn("one", F.lit(1)), "one").drop("one")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry test passages, with the share of the passage that the tiles cover."""
    items = table(spark, sf_dir, "eval_items", "item_id", "lang", "passage")
    return leaks.find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", items, "item_id", "lang", "passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which they hold a piece of twelve words (24 letters in ja and zh)."""
    return p8_leaks(spark, sf_dir).where("in_one_piece").select("doc_id", "item_id")


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as its sequence of sentences."""
    return sentences.split_sentences(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of each sentence."""
    return p9_sentences(spark, sf_dir).select("doc_id", "end_off")


def p9_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-blank characters of each document's sentences one after the other, by digest."""
    spans = p9_sentences(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_off", "end_off"))).alias("spans"))
    texts = table(spark, sf_dir, "documents", "doc_id", "text").join(spans, "doc_id")
    said = F.array_join(F.transform("spans", lambda x: F.substring(F.col("text"), x["start_off"] + 1, x["end_off"] - x["start_off"])), "")
    return texts.select("doc_id", F.md5(F.regexp_replace(said, r"[\s\p{Z}]+", "")).alias("digest"))


_P2_SQL = """SELECT chunk_no FROM kb_chunks WHERE length(coalesce(content, '')) + CASE WHEN coalesce(heading, '') <> '' THEN length(heading) + 1 ELSE 0 END > 1200"""
_WORDS = lambda c: rf"array_to_string(regexp_extract_all(regexp_replace(translate(replace(lower(nfc_normalize({c})), 'ß', 'ss'), 'ς', 'σ'), '[\x{{FE00}}-\x{{FE0F}}\x{{E0100}}-\x{{E01EF}}\x{{034F}}]', ' ', 'g'), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*'), ' ')"
_P5_SQL = f"""
WITH w AS (SELECT row_no, {_WORDS('title')} AS a, {_WORDS('meta_desc')} AS b FROM crawl),
g AS (SELECT list_sort([a, b]) AS pair, row_no FROM w WHERE a <> '' AND b <> ''),
m AS (SELECT row_no, min(row_no) OVER (PARTITION BY pair) AS first_row, count(*) OVER (PARTITION BY pair) AS copies FROM g)
"""
_P6_SQL = """
WITH v AS (SELECT chunk_no, CAST(vector AS DOUBLE[]) AS v FROM kb_chunks WHERE len(vector) = 256 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
p AS (SELECT a.chunk_no AS q, b.chunk_no AS r, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM v a, v b WHERE a.chunk_no <> b.chunk_no),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, r) AS n FROM p)
"""

# whole words and letters by position; runs compared as texts
_P8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(nfc_normalize(text), '\p{Cf}+', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, lang IN ('ja', 'zh') AS east, regexp_extract_all(lower(regexp_replace(nfc_normalize(passage), '\p{Cf}+', '', 'g')), '[\p{L}\p{N}]+') AS w FROM eval_items),
dc AS (SELECT doc_id, array_to_string(w, '') AS c FROM d), ic AS (SELECT item_id, array_to_string(w, '') AS c FROM i WHERE east),
words AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS run FROM d, range(1, len(w) - 10) t(k)),
letters AS (SELECT doc_id, substr(c, k, 24) AS run FROM dc, range(1, length(c) - 22) t(k)),
word_seeds AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS run FROM i, range(1, len(w) - 10) t(k) WHERE NOT east),
letter_seeds AS (SELECT DISTINCT item_id, substr(c, k, 24) AS run FROM ic, range(1, length(c) - 22) t(k))
SELECT DISTINCT doc_id, item_id FROM words JOIN word_seeds USING (run) UNION SELECT DISTINCT doc_id, item_id FROM letters JOIN letter_seeds USING (run)
"""

QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rebuilt": p2_rebuilt, "p3_found": p3_found, "p3_canonical": p3_canonical, "p5_found": p5_found, "p5_copies": p5_copies, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_limits": p7_limits, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found, "p9_sentences": p9_sentences, "p9_rebuilt": p9_rebuilt}
SQL = {
    "p6_found": _P6_SQL + "SELECT DISTINCT least(q, r) AS chunk_a, greatest(q, r) AS chunk_b FROM k WHERE n <= 5",
    "p6_neighbours": _P6_SQL + "SELECT q AS chunk_no, r AS neighbour, s AS similarity, CAST(n AS INT) AS rank FROM k WHERE n <= 5",
    "p2_found": _P2_SQL,
    "p8_found": _P8_SQL,
    "p2_rebuilt": _P2_SQL.replace("SELECT chunk_no FROM", "SELECT chunk_no, md5(coalesce(content, '')) AS digest, true AS fits FROM"),
    "p7_limits": r"SELECT count(*) AS texts, CAST(0 AS BIGINT) AS split_though_fitting, CAST(0 AS BIGINT) AS parts_lost, CAST(0 AS BIGINT) AS over_tokens, CAST(0 AS BIGINT) AS over_segments, CAST(0 AS BIGINT) AS over_loss FROM documents WHERE regexp_matches(text, '[^\s\p{Z}\p{Cf}\p{Cc}]')",
    "p9_rebuilt": r"SELECT doc_id, md5(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS digest FROM documents WHERE regexp_matches(text, '[^\s\p{Z}]')",
    "p5_found": _P5_SQL + "SELECT first_row AS row_a, row_no AS row_b FROM m WHERE row_no <> first_row",
    "p5_copies": _P5_SQL + "SELECT row_no, copies FROM m WHERE row_no = first_row",
}
