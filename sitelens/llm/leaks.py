"""Evaluation texts leaking into training text: greedy string tiling on shared seeds.

Method
------
1. Every run of ``SEED[0]`` words of a passage (``SEED[1]`` letters and digits in Chinese and
   Japanese, which have no blanks) is a *seed*, known by its Karp-Rabin hash.
2. The rolling hashes of a document's runs are tested against a Bloom filter of the seeds; runs
   that pass are joined with the seeds by hash. A pair of document and item is compared if it
   shares as many different seeds as one run of ``FULL`` units or the least coverage must hold.
3. Each pair is tiled greedily by running Karp-Rabin: the search length starts at the longest
   run that both texts still have unmarked and falls to the seed length; at each length all
   runs that do not overlap are marked in both texts. So reordered and repeated passages are
   found, and tiles never overlap.
4. A pair is a leak if one tile has ``FULL`` units (a passage in a piece), or if the tiles
   cover ``COVERAGE`` of the passage (a passage in reordered pieces, each below that length).

Scale: a document is read once and only its passing hashes are shuffled. The filter grows
with the number of seeds up to ``MOST_BITS`` (16 MB); beyond that it only thins out, the join
decides. Nothing is broadcast but that filter. Documents are salted against the seeds and the items, so that a seed or an item that
a third of all documents hold is spread over tasks. Repeated texts are each reported.

Defined cases: null and empty texts and passages give nothing; passages shorter than a seed
give nothing; case, punctuation, markup, spacing, line breaks and invisible characters do
not count; very long and repetitive texts are hashed and tiled in linear time for each
search length; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import spread, stored

#: Units (words; letters in Chinese and Japanese) of a seed, and of a piece that is a leak by itself.
SEED, FULL = (6, 12), (12, 24)
#: Share of a passage that its tiles must cover where no tile is as long as that.
COVERAGE = 0.5
LEAST_BITS, MOST_BITS, BITS_PER_SEED, PROBES = 1 << 18, 1 << 27, 64, 4
SALTS = 16
_UNSPACED = ("ja", "zh")
_CF = regex.compile(r"\p{Cf}+")
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """Lower case, composed accents, nothing invisible."""
    if text.isascii():
        return text.lower()
    return _CF.sub("", unicodedata.normalize("NFC", text)).lower()


def _is_word_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for cp in range(0x110000):
        if unicodedata.category(chr(cp))[0] in "LN":
            table[cp] = True
    return table


_word_table: list[np.ndarray] = []


def word_table() -> np.ndarray:
    if not _word_table:
        _word_table.append(_is_word_table())
    return _word_table[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    return x * _MIX


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, _BASE), out=out[1:]) if n > 1 else None
    return out


def _inverse_powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, _INVERSE), out=out[1:]) if n > 1 else None
    return out


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Sums of ``unit * base**position``: two of them give the hash of any run between."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(units * _powers(len(units)), dtype=np.uint64)))


def run_hashes(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of the runs of ``size`` units at ``starts``."""
    return _mix((sums[starts + size] - sums[starts]) * inverse[starts])


def rolling(units: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` units."""
    n = len(units) - size + 1
    return run_hashes(prefix_sums(units), _inverse_powers(n), np.arange(n), size) if n > 0 else np.zeros(0, np.uint64)


def units_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and letter hashes of plain texts, each with the number of its text."""
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(t) for t in texts], int) + 1
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(codes)]
    inside = word_table()[codes]
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.uint64)
        return none, none.astype(int), none, none.astype(int)
    letters = _mix(codes[at].astype(np.uint64) + np.uint64(1))
    begins = np.concatenate(([True], at[1:] != at[:-1] + 1))
    first = np.flatnonzero(begins)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate((first, [len(at)]))))
    words = _mix(np.add.reduceat(letters * _powers(int(within.max()) + 1)[within], first) + np.uint64(7))
    return words, owner[at[first]], letters, owner[at]


def _runs(units: np.ndarray, owner: np.ndarray, size: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs that lie in one text, and the texts' numbers."""
    h = rolling(units, size)
    if not len(h):
        return h, owner[:0]
    same = owner[: len(h)] == owner[size - 1 :]
    return h[same] ^ np.uint64(kind), owner[: len(h)][same]


def runs_of(texts: list[str], words: int, letters: int, unspaced: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    w, wo, c, co = units_of(texts)
    parts = []
    if unspaced is not True:
        parts.append(_runs(w, wo, words, 0))
    if unspaced is not False:
        parts.append(_runs(c, co, letters, 0x5555))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _unspaced(lang: str | None) -> bool:
    return (lang or "").strip().lower()[:2] in _UNSPACED


def needed(units: int, seed: int, full: int, coverage: float) -> int:
    """How many seeds a pair must share to be compared: a run of ``full`` units has ``full - seed + 1``;
    tiles of ``coverage`` of the passage have at least one for each ``seed`` units that they cover."""
    return max(1, min(full - seed + 1, int(np.ceil(coverage * units / seed))))


def _seeds(seed: tuple[int, int], full: tuple[int, int], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, lang, passage in zip(*(c.to_pylist() for c in b.columns)):
                east = _unspaced(lang)
                h, _ = runs_of([plain(passage or "")], *seed, east)
                least, runs = needed(len(h) + seed[east] - 1, seed[east], full[east], coverage), len(h)
                h = np.unique(h).astype(np.int64)
                if len(h):
                    least = least if len(h) == runs else 1  # a passage that repeats itself has fewer different seeds
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array([item] * len(h), b.schema.field(0).type), pa.array([least] * len(h), pa.int32())], names=["hash", "item", "least"])

    return run


def _probe(key: str, seed: tuple[int, int], bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = np.frombuffer(bits, np.uint8), np.uint64(8 * len(bits) - 1)

        def holds(h: np.ndarray) -> np.ndarray:
            hit = np.ones(len(h), bool)
            for i in range(PROBES):
                slot = ((h & mask) + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1))) & mask
                hit[hit] = (table[(slot[hit] >> np.uint64(3)).astype(np.int64)] >> (slot[hit] & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return hit

        for b in batches:
            for s in range(0, b.num_rows, 2000):
                part = b.slice(s, 2000)
                texts = part.column(1).to_pylist()
                h, owner = runs_of([plain(t or "") for t in texts], *seed)
                hit = holds(h)
                h, owner = h[hit].astype(np.int64), owner[hit]
                if len(h):
                    order = np.argsort(owner, kind="stable")  # word runs and letter runs come one after the other
                    h, owner = h[order], owner[order]
                    rows, first = np.unique(owner, return_index=True)
                    cut = np.split(h, first[1:])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows)), pa.array([np.unique(x) for x in cut], pa.list_(pa.int64()))], names=[key, "text", "hashes"])

    return run


class _Side:
    """One text of a pair: its units as numbers, prefix sums for hashes, marks."""

    def __init__(self, units: np.ndarray):
        self.units, self.n = units, len(units)
        hashed = _mix(units.astype(np.uint64) + np.uint64(1))
        self.sums, self.inverse = prefix_sums(hashed), _inverse_powers(max(1, self.n))
        self.taken = np.zeros(self.n, bool)

    def free(self, size: int, among: np.ndarray | None = None) -> np.ndarray:
        """Starts of the runs of ``size`` units without a mark."""
        if self.n < size:
            return np.zeros(0, np.int64)
        marks = np.concatenate(([0], np.cumsum(self.taken)))
        starts = np.arange(self.n - size + 1) if among is None else among[among <= self.n - size]
        return starts[marks[starts + size] == marks[starts]]

    def hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        return run_hashes(self.sums, self.inverse, starts, size)


def tiles(a: list, b: list, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of ``a`` and ``b``: (start in a, start in b, length), longest first.

    Running Karp-Rabin with a falling search length: the longest run that is unmarked in both is
    searched by halving, all such runs are marked from left to right, and so on down to ``least``.
    """
    number: dict = {}
    one, two = (_Side(np.fromiter((number.setdefault(u, len(number)) for u in x), np.int64, len(x))) for x in (a, b))
    out: list[tuple[int, int, int]] = []
    # every match begins where a run of the least length matches
    i0, j0 = one.free(least), two.free(least)
    hi, hj = one.hashes(i0, least), two.hashes(j0, least)
    i0, j0 = i0[np.isin(hi, hj)], j0[np.isin(hj, hi)]

    def matching(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, j = one.free(size, i0), two.free(size, j0)
        x, y = one.hashes(i, size), two.hashes(j, size)
        keep = np.isin(x, y)
        return i[keep], x[keep], j, y

    top = min(one.n, two.n)
    while top >= least:
        low, high = least - 1, top  # the longest common run has at least low and at most high units
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if len(matching(mid)[0]) else (low, mid - 1)
        if low < least:
            break
        i, x, j, y = matching(low)
        where: dict[int, list[int]] = {}
        for h, k in zip(y.tolist()[::-1], j.tolist()[::-1]):
            where.setdefault(h, []).append(k)
        for h, k in zip(x.tolist(), i.tolist()):
            if one.taken[k] or one.taken[k + low - 1]:
                continue
            spots = where[h]
            while spots and (two.taken[spots[-1]] or two.taken[spots[-1] + low - 1]):
                spots.pop()  # a run once marked stays marked
            if spots and (one.units[k : k + low] == two.units[spots[-1] : spots[-1] + low]).all():
                m = spots.pop()
                one.taken[k : k + low] = two.taken[m : m + low] = True
                out.append((k, m, low))
        top = low - 1
    return out


_WORD = regex.compile(r"[\p{L}\p{N}]+")


@lru_cache(maxsize=256)
def _units(text: str, unspaced: bool) -> list[str]:
    words = _WORD.findall(plain(text))
    return list("".join(words)) if unspaced else words


def compare(text: str, passage: str, unspaced: bool, seed: tuple[int, int] = SEED) -> tuple[float, int, int]:
    """(share of the passage covered, longest tile, tiles)"""
    a, b = _units(text, unspaced), _units(passage, unspaced)
    found = tiles(a, b, seed[unspaced])
    return sum(n for _, _, n in found) / max(1, len(b)), max((n for _, _, n in found), default=0), len(found)


def _verify(key: str, item: str, seed: tuple[int, int], full: tuple[int, int], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text, i, lang, passage in zip(*(c.to_pylist() for c in b.columns)):
                east = _unspaced(lang)
                share, longest, n = compare(text, passage, east, seed)
                if longest >= full[east] or share >= coverage:
                    rows.append((k, i, share, longest, n, longest >= full[east]))
            if rows:
                types = (b.schema.field(0).type, b.schema.field(2).type, pa.float64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[key, item, "coverage", "longest", "tiles", "in_one_piece"])

    return run


def _bit_table(seeds: DataFrame) -> bytes:
    """A Bloom filter of the seeds' hashes: a power of two of bits, at least ``BITS_PER_SEED`` for each,
    ``MOST_BITS`` at most, ``PROBES`` of them set by each seed."""
    size = LEAST_BITS
    while size < MOST_BITS and size < BITS_PER_SEED * seeds.count():
        size *= 2
    low, step = F.col("hash").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("hash", 32).bitwiseOR(F.lit(1))
    slots = seeds.select(F.explode(F.array(*[(low + i * step).bitwiseAND(F.lit(size - 1)) for i in range(PROBES)])).alias("s")).select(F.floor(F.col("s") / 32768).alias("part"), (F.col("s") % 32768).alias("bit"))
    table = bytearray(size // 8)
    for part, bits in slots.groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():  # at most MOST_BITS / 32,768 rows
        table[part * 4096 : (part + 1) * 4096] = bits
    return bytes(table)


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, lang: str, passage: str, seed: tuple[int, int] = SEED, full: tuple[int, int] = FULL, coverage: float = COVERAGE) -> DataFrame:
    """(``key``, ``item``, coverage, longest, tiles, in_one_piece) for each document and item that it leaks."""
    k_type, i_type = (d.select(c).schema[0].dataType.simpleString() for d, c in ((docs, key), (items, item)))
    seeds = stored(items.select(item, lang, passage).mapInArrow(_seeds(seed, full, coverage), f"hash bigint, item {i_type}, least int"), "seeds")
    probe = _probe(key, seed, _bit_table(seeds))
    near = stored(spread(docs.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(key, text)).mapInArrow(probe, f"{key} {k_type}, text string, hashes array<bigint>"), "near")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = F.pmod(F.hash(key), F.lit(SALTS)).alias("salt")
    shared = near.select(key, salted, F.explode("hashes").alias("hash")).distinct().join(seeds.select("hash", "item", "least", salts).hint("merge"), ["hash", "salt"])
    pairs = shared.groupBy(key, "item", "salt").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).where("n >= least").select(key, "salt", F.col("item").alias(item))
    full_texts = pairs.join(items.select(item, F.col(lang).alias("lang"), F.col(passage).alias("passage"), salts).hint("merge"), [item, "salt"])
    spots = max(2 * docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # tiling costs far more than its rows weigh
    full_texts = full_texts.repartition(spots, key).join(near.select(key, "text").hint("merge"), key)
    verify = _verify(key, item, seed, full, coverage)
    return full_texts.select(key, "text", item, "lang", "passage").mapInArrow(verify, f"{key} {k_type}, {item} {i_type}, coverage double, longest int, tiles int, in_one_piece boolean").distinct()
