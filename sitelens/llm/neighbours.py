"""Most similar vectors for every vector: an exact block matrix join on int8 products.

Method
------
* Equal vectors are one row of the matrix, known by the digest of their values; of its members
  only the ``k + 1`` smallest ids can ever be neighbours, so a group of copies, however large,
  costs one row.
* Rows are normalised, turned by a fixed orthogonal matrix (signs and Hadamard, which spreads
  single large values and leaves all products as they are) and quantised once to int8 with
  one scale each. Codes and stored values are one table in the shared folder, which
  ``pyarrow.fs`` must be able to open.
* A task owns one block of rows and reads the table's other rows block by block from the
  folder. The product of the codes is the cosine up to the error bound
  ``|e_a| |q_b| + |e_b|`` made of the rows' own quantisation residuals; both terms are two more
  columns of the product. Pairs whose upper bound lies below the (k+1)-th best of their row so
  far are dropped; the others are computed at once in double precision from the stored
  values and rounded to 6 decimals.
* A row keeps the ``k + 1`` best answers, itself and copies among them, so a task ends with the
  final lists of its rows. The result is exact (recall 1.0); ties go to the smaller id.

Scale: nothing is copied for each block. Stored values are shuffled once (to find equal ones)
and written once, with one byte a dimension beside them, and a row has one list of ``k + 1``
answers, so disk and shuffle grow with the rows, whatever the number of blocks. The work grows
with the square of the different vectors, in tiles of bounded size; each pair is multiplied
once for either row, as lists that one task makes for another's rows would grow with
the square as well. Only groups of more than ``k + 1`` copies get their answers by a (salted) join.

Defined cases: a vector that is null, has another length, holds a null or NaN or infinite
value or is all zero is not used and appears in no pair; fewer than k + 1 usable rows give
what there is; the scale of a vector does not matter; repeated ids count as they come.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import spread, stored

#: Rows of a block at most; fewer where that leaves too few tasks for the cores.
BLOCK_ROWS, LEAST_ROWS = 16_384, 1024
_TILE = 1024
SALTS = 16
_DECIMALS = 6


def usable(vector: str, dims: int):
    """SQL condition: ``dims`` finite numbers that are not all zero."""
    return F.coalesce((F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def unit_rows(raw: np.ndarray) -> np.ndarray:
    rows = raw.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # keeps the norm of tiny and huge vectors finite
    return rows / np.sqrt((rows**2).sum(axis=1))[:, None]


def turning(dims: int) -> np.ndarray:
    """An orthogonal map from ``dims`` to the next power of two: fixed signs, then Hadamard."""
    h = np.ones((1, 1))
    while len(h) < dims:
        h = np.block([[h, h], [h, -h]])
    signs = np.where(np.random.default_rng(1).random(dims) < 0.5, -1.0, 1.0)
    return signs[:, None] * h[:dims] / math.sqrt(len(h))


def quantise(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, error of the codes) of each row."""
    unit = unit_rows(raw) @ turning(raw.shape[1])
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    return codes.astype(np.int8), scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))


#: In place of an id where there is none: behind all others.
_NONE = np.iinfo(np.int64).max


class Block:
    """Rows of the table of vectors, in the forms in which they are multiplied."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, keep: int):
        vec, codes, members = (_column(rows, c) for c in ("vec", "codes", "members"))
        scale, error = (_column(rows, c).to_numpy().astype(np.float32)[:, None] for c in ("scale", "error"))
        self.unit = unit_rows(_matrix(vec))
        coded = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1) * scale
        norm = np.sqrt((coded**2).sum(axis=1, keepdims=True))
        self.gap, self.norm, one = error * _WIDER, norm * _WIDER, np.ones_like(norm)
        self.left = np.hstack((coded, self.gap, one))  # left @ right.T: upper bounds of the cosines
        self.right = np.hstack((coded, self.norm, self.gap))
        count = members.value_lengths().to_numpy()
        own = np.repeat(np.arange(len(count)), count)
        self.members = np.full((len(count), keep), _NONE)
        self.members[own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)] = members.flatten().to_numpy()


def _column(rows: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    x = rows.column(name)
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


class Best:
    """The ``keep`` best answers of each row of a block: larger similarity, then smaller id. What lies below a row's floor isn't among them."""

    def __init__(self, n: int, keep: int):
        self.keep, self.floor = keep, np.full(n, -2.0, np.float32)
        self.sims, self.ids = np.full((n, keep), -2.0), np.full((n, keep), _NONE)

    def add(self, rows: np.ndarray, sims: np.ndarray, members: np.ndarray) -> None:
        if not len(rows):
            return
        used = members != _NONE
        count, own = used.sum(axis=1), np.unique(rows)
        r = np.concatenate((np.repeat(rows, count), np.repeat(own, self.keep)))
        s = np.concatenate((np.repeat(sims, count), self.sims[own].ravel()))
        ids = np.concatenate((members[used], self.ids[own].ravel()))
        order = np.lexsort((ids, -s, r))
        first = np.searchsorted(r[order], own)
        kept = order[(first[:, None] + np.arange(self.keep)).ravel()]  # there are that many at least
        self.sims[own], self.ids[own] = s[kept].reshape(-1, self.keep), ids[kept].reshape(-1, self.keep)
        self.floor[own] = np.maximum(self.floor[own], self.sims[own, -1])


#: Cosines that may be equal after rounding, with what single precision may add; what it may add to a product, for each of its terms; and to an error or norm.
_EQUAL, _SINGLE, _WIDER = np.float32(1.5 * 10.0**-_DECIMALS), 2.0**-23, np.float32(1 + 1e-4)


def _tile(a: Block, b: Block, best: Best, i0: int, i1: int, j0: int, j1: int) -> None:
    """One product of int8 rows: drops what the error bounds exclude, computes the rest."""
    upper = a.left[i0:i1] @ b.right[j0:j1].T
    single = np.float32(_SINGLE * a.left.shape[1])
    floor = best.floor[i0:i1]
    fresh = np.flatnonzero(floor < -1.5)  # later the computed ones are better
    if len(fresh) and upper.shape[1] >= best.keep:
        lower = upper[fresh] - 2 * (a.gap[i0:i1][fresh] * b.norm[j0:j1].T + b.gap[j0:j1].T)
        floor[fresh] = np.partition(lower, -best.keep, axis=1)[:, -best.keep] - single
    r, c = np.nonzero(upper >= (floor - _EQUAL - single)[:, None])
    r, c = r + i0, c + j0
    sims = np.round(np.concatenate([np.einsum("ij,ij->i", a.unit[r[s : s + 4096]], b.unit[c[s : s + 4096]]) for s in range(0, max(1, len(r)), 4096)]), _DECIMALS)
    kept = sims >= best.floor[r] - _EQUAL
    best.add(r[kept], sims[kept], b.members[c[kept]])


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            codes, scale, error = quantise(_matrix(b.column("vec")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(scale), pa.array(error)], names=[*b.schema.names, "codes", "scale", "error"])


def _read(file: str, rows: int) -> Iterator[pa.RecordBatch]:
    """A file of the table of vectors, ``rows`` rows at a time."""
    system, path = fs.FileSystem.from_uri(file)
    with system.open_input_file(path) as f:
        yield from pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(rows, use_threads=False)


def _own(file: str, start: int, stop: int, rows: int) -> pa.Table:
    at, parts = 0, []
    for b in _read(file, rows):
        if at < stop and start < at + b.num_rows:
            parts.append(b.slice(max(0, start - at), stop - max(start, at)))
        at += b.num_rows
        if at >= stop:
            break
    return pa.Table.from_batches(parts)


_ANSWERS = "digest binary, members array<bigint>, whole boolean, near array<struct<n: bigint, sim: double>>"


def _nearest(files: list[str], parts: list[tuple[int, int, int]], keep: int, block_rows: int):
    """Task n: the answers of the rows of ``parts[n]`` (file, first row, row behind the last)."""

    def answers(f: int, start: int, stop: int) -> pa.RecordBatch:
        own = _own(files[f], start, stop, block_rows)
        a, best = Block(own, keep), Best(stop - start, keep)
        for file in files[f:] + files[:f]:  # tasks don't all read the same one at once
            for rows in _read(file, block_rows):
                b = Block(rows, keep)
                for i0 in range(0, stop - start, _TILE):
                    for j0 in range(0, rows.num_rows, _TILE):
                        _tile(a, b, best, i0, min(i0 + _TILE, stop - start), j0, min(j0 + _TILE, rows.num_rows))
        used = best.ids != _NONE
        near = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(used.sum(axis=1)))).astype(np.int32), pa.StructArray.from_arrays([pa.array(best.ids[used]), pa.array(best.sims[used])], ["n", "sim"]))
        members = _column(own, "members")
        whole = pa.array(members.value_lengths().to_numpy() == _column(own, "copies").to_numpy())
        return pa.RecordBatch.from_arrays([_column(own, "digest"), members, whole, near], names=["digest", "members", "whole", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in b.column(0).to_pylist():
                yield answers(*parts[n])

    return run


def _digest(values: bool):
    """Digests with the rows' ids or with their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = np.ascontiguousarray(_matrix(b.column(1)))
                digests = pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([digests, b.column(int(values))], names=["digest", "vec" if values else "id"])

    return run


def _smallest(digests: DataFrame, keep: int) -> DataFrame:
    """For each different vector its ``keep`` smallest ids and its number of copies: ranks inside salts
    first, so that a group of copies never meets in one task."""
    lists = digests.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, keep).alias("ids"), F.count(F.lit(1)).alias("copies"))
    return lists.groupBy("digest").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep).alias("members"), F.sum("copies").alias("copies"))


def parts_of(counts: list[int], cores: int, block_rows: int, least_rows: int) -> list[tuple[int, int, int]]:
    """(file, first row, row behind the last) of each task: small enough for a task, and two for each core."""
    rows = min(block_rows, max(least_rows, -(-sum(counts) // (2 * cores))))
    out = []
    for f, n in enumerate(counts):
        m = max(1, -(-n // block_rows), round(n / rows))
        out += [(f, n * i // m, n * (i + 1) // m) for i in range(m) if n * i // m < n * (i + 1) // m]
    return out


def nearest(df: DataFrame, key: str, vector: str, k: int = 5, dims: int = 256, block_rows: int = BLOCK_ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(``key``, neighbour, similarity, rank): the k most similar rows of every usable row."""
    spark = df.sparkSession
    rows = spread(df.where(usable(vector, dims)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vec")))
    vec = f"vec {rows.schema['vec'].dataType.simpleString()}"
    digests = stored(rows.mapInArrow(_digest(values=False), "digest binary, id bigint"), "digests")
    different = rows.mapInArrow(_digest(values=True), f"digest binary, {vec}").groupBy("digest").agg(F.first("vec").alias("vec"))  # the one shuffle of values
    known = different.join(_smallest(digests, k + 1), "digest").select("digest", "vec", "members", "copies")
    vectors = stored(known.mapInArrow(_codes, f"digest binary, {vec}, members array<bigint>, copies bigint, codes binary, scale double, error double"), "vectors")

    files = sorted(vectors.groupBy(F.input_file_name()).count().collect())
    parts = parts_of([n for _, n in files], spark.sparkContext.defaultParallelism, block_rows, least_rows)
    tasks = spark.range(0, len(parts), 1, max(1, len(parts)))
    answers = stored(tasks.mapInArrow(_nearest([f for f, _ in files], parts, k + 1, block_rows), _ANSWERS), "nearest")

    # every copy gets the answer of its vector
    few = answers.where("whole").select(F.explode("members").alias("id"), "near")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    many = answers.where("not whole").select("digest", "near", salts)  # k + 2 copies each at least
    members = digests.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = few.unionByName(members.join(many.hint("merge"), ["digest", "salt"]).select("id", "near"))
    out = out.select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["n"] != F.col("id")), 1, k)).alias("rank", "x"))
    kind = df.select(key).schema[0].dataType
    return out.select(F.col("id").cast(kind).alias(key), F.col("x.n").cast(kind).alias("neighbour"), F.col("x.sim").alias("similarity"), (F.col("rank") + 1).alias("rank"))


def unordered_pairs(near: DataFrame, key: str) -> DataFrame:
    """Pairs (smaller id, larger id) in which one is a neighbour of the other."""
    return near.select(F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b")).distinct()


def brute_force(ids: list[int], vectors: list, k: int = 5, dims: int = 256) -> pd.DataFrame:
    """All cosines at once, for tests."""
    ok = [(i, np.array(v, float)) for i, v in zip(ids, vectors) if v is not None and len(v) == dims and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    x = np.array([v / np.abs(v).max() for _, v in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims, out = np.round(x @ x.T, _DECIMALS), []
    for r, (i, _) in enumerate(ok):
        order = sorted((-sims[r, c], ok[c][0]) for c in range(len(ok)) if c != r)[:k]
        out += [(i, j, -s, n + 1) for n, (s, j) in enumerate(order)]
    return pd.DataFrame(out, columns=["id", "neighbour", "similarity", "rank"])
