"""Knowledge base: markdown sections, hashed embeddings, exact top-k search, upserts."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 256
QUERY_BLOCK, ROW_BLOCK = 1024, 16_384
_FRONT = regex.compile(r"\A---\r?\n.*?\r?\n---\r?\n?", regex.S)
_FENCE = regex.compile(r"\s*(```+|~~~+)")


def front_matter(text: str | Column) -> Column:
    """The ``key: value`` lines between the leading ``---`` lines, as a map; empty without any."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.transform(F.split(block, r"\r?\n"), lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)).alias("v"))), lambda p: p["k"] != "")
    return F.map_from_entries(pairs)


def sections_of(text: str, overlap: int = 0) -> list[tuple[str, str]]:
    """(heading, body) of each section; headings inside code fences start none."""
    body, parts, fence = _FRONT.sub("", text), [[]], ""
    for line in body.split("\n"):
        if mark := _FENCE.match(line):
            if not fence:
                fence = mark.group(1)[0]
            elif line.lstrip().startswith(fence):
                fence = ""
        if not fence and regex.match(r"#{1,6} ", line) and parts[-1]:
            parts.append([])
        parts[-1].append(line)
    out = []
    for part in ("\n".join(p).strip() for p in parts):
        if part:
            head = regex.match(r"#{1,6}\s+(.+)", part)
            out.append((head.group(1).strip(), part[head.end() :].strip()) if head else ("", part))
    out = out or [("", body.strip())]
    if overlap > 0:
        tails = ["", *(t[-overlap:] for _, t in out[:-1])]
        out = [(h, f"{tail}\n{t}" if tail else t) for (h, t), tail in zip(out, tails)]
    return out


def sections(df: DataFrame, key: str, text: str, overlap: int = 0) -> DataFrame:
    """(``key``, ord from 0, heading, body) for each markdown section of each document."""
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, h, t) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x is not None for i, (h, t) in enumerate(sections_of(x, overlap))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (b.schema.field(0).type, pa.int32(), pa.string(), pa.string()))], names=[key, "ord", "heading", "body"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ord int, heading string, body string")


_TOKEN = regex.compile(r"[a-z0-9]+")
_slots: dict[str, tuple[int, int]] = {}


def _slot(token: str) -> tuple[int, int]:
    if (found := _slots.get(token)) is None:
        h = 5381
        for c in token:
            h = ((h * 33) & 0xFFFFFFFF) ^ ord(c)
        if len(_slots) > 200_000:
            _slots.clear()
        found = _slots[token] = (h % DIMS, (h >> 8) & 255)
    return found


def embed_text(text: str | None) -> np.ndarray:
    """Token hash counts (1 and 1/2 into two slots) with length one; all zero without a token."""
    v = np.zeros(DIMS)
    for token in _TOKEN.findall((text or "").lower()):
        a, b = _slot(token)
        v[a] += 1.0
        v[b] += 0.5
    n = np.sqrt((v * v).sum())
    return v / n if n else v


def embed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, vector) for each row."""
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.concatenate([embed_text(t) for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * DIMS, pa.int32()), pa.array(flat))], names=[key, "vector"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<double>")


def ingest(files: DataFrame) -> DataFrame:
    """(id, vector, source, heading, date, text) of markdown ``files`` (file, text): ``file#i`` for the i-th
    section, whose body, or else its heading, is embedded; a section without either is left out. Source and
    date come from the front matter, the source else is the file's name."""
    about = files.select("file", front_matter("text").alias("m")).select("file", F.coalesce(F.col("m")["source"], F.col("file")).alias("source"), F.coalesce(F.col("m")["datum"], F.lit("")).alias("date"))
    parts = sections(files, "file", "text").withColumn("text", F.when(F.trim("body") != "", F.trim("body")).otherwise(F.col("heading"))).where("text <> ''")
    rows = parts.select(F.concat("file", F.lit("#"), F.col("ord").cast("string")).alias("id"), "file", "heading", "text")
    return rows.join(embed(rows, "id", "text"), "id").join(about, "file").select("id", "vector", "source", "heading", "date", "text")


def citation_allowlist(files: DataFrame) -> DataFrame:
    """(source): what may be cited: the source that a file's front matter names, and that file's name."""
    named = files.select("file", F.trim(front_matter("text")["source"]).alias("source")).where("source <> ''")
    return named.select("source").unionByName(named.select(F.col("file").alias("source"))).distinct()


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vector columns; 0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


_PART = pa.schema([("query", pa.int64()), ("near", pa.list_(pa.struct([("sim", pa.float64()), ("id", pa.int64())])))])


def _rows(vectors: list) -> np.ndarray:
    """The vectors as one matrix. One that is null, of another length than most or holds null or NaN has the
    cosine 0 with all others, as a zero vector has."""
    lengths = Counter(len(v) for v in vectors if v)
    dims = lengths.most_common(1)[0][0] if lengths else 0
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims and all(c is not None and c == c for c in v):
            out[i] = v
    return out


def _block(k: int, decimals: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        is_query = np.array(t.column("is_query").to_pylist(), bool)
        ids = np.array(t.column("id").to_pylist())
        x = _rows(t.column("vec").to_pylist())
        if is_query.all() or not is_query.any():
            return _PART.empty_table()
        norm = np.sqrt((x * x).sum(axis=1))
        x = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
        q, r, rid = x[is_query], x[~is_query], ids[~is_query]
        sims = np.round(q @ r.T, decimals)
        near = [[{"sim": float(sims[i, j]), "id": int(rid[j])} for j in np.lexsort((rid, -sims[i]))[:k]] for i in range(len(q))]
        return pa.Table.from_arrays([pa.array(ids[is_query], pa.int64()), pa.array(near, _PART.field("near").type)], schema=_PART)

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for b in batches:
            for q, near in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                best[q] = heapq.nsmallest(k, [*best.get(q, []), *((-n["sim"], n["id"]) for n in near)])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([[{"sim": -s, "id": i} for s, i in v] for v in best.values()], _PART.field("near").type)], schema=_PART)

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int = 4, min_score: float | None = None, decimals: int = 6) -> DataFrame:
    """(query, rank, id, score): the k most similar rows of each query, exactly.

    Both sides have (id, vec) with vectors of one length. Queries and rows meet in blocks; each
    task multiplies one block of queries with one of rows. ``min_score`` is applied after k.
    """
    n_q, n_r = queries.count(), rows.count()
    qb, rb = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_r // ROW_BLOCK))
    place = lambda df, n, m, mine, other: df.select(
        F.col("id").cast("bigint"), F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
    )
    tiles = place(queries, qb, rb, "qb", "rb").withColumn("is_query", F.lit(True)).unionByName(place(rows, rb, qb, "rb", "qb").withColumn("is_query", F.lit(False)))
    found = tiles.groupBy("qb", "rb").applyInArrow(_block(k, decimals), "query bigint, near array<struct<sim double, id bigint>>")
    best = found.repartition("query").mapInArrow(_merge(k), found.schema)
    out = best.select("query", F.posexplode("near").alias("rank", "n")).select("query", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("id"), F.col("n.sim").alias("score"))
    return out if min_score is None else out.where(F.col("score") >= min_score)


def upsert(store: DataFrame, batch: DataFrame, key: str, newer: str) -> DataFrame:
    """The store with the batch's rows in place of its own; of rows with one key the newest counts."""
    latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), newer).alias("r")).select("r.*")
    return store.join(latest.select(key), key, "left_anti").unionByName(latest)
