"""Several values packed in one field: split them into one row per value.

Method
------
1. Every cell is scanned into *atoms* and the separator candidates between them. Quoted
   spans are atoms of their own and are never cut or joined. One pair of list brackets
   around the cell is removed.
2. The atoms are the edges of a lattice. An atom that looks like a value of the field's kind
   begins one. One that doesn't (``b`` after ``?f=a,``) may go on with the value before it or be
   a piece of its own, which is no value; an atom in an open list of paths (``/combo?/a,/b``)
   may go on with the list or begin the next value, whatever the length of the list.
3. The score of a value is its frequency in the column, smoothed by that of its shape; the
   score of a separator is the share with which separators of its class end a value. All are
   learned by expectation maximisation: the E-step runs the forward-backward algorithm over
   the lattices of all cells (a lattice with one path gives certain counts, which no round
   changes), the M-step renormalises the expected counts. Quoted spans count as certain
   observations.
4. Viterbi's best path through the lattice of each cell gives its values.

Scale: counts are summed inside each task before the shuffle; only cells whose lattice has
more than one path are kept for the rounds, as distinct forms with their number, in a table
in the shared folder. The model has a fixed size: values and shapes are hashed into
``KEY_SLOTS`` slots per field, and the share that a slot owes to collisions is taken off, so
the tables sent to the driver and to the tasks never grow with the data. All cells are
counted and all are decoded.

Defined cases: null, empty and blank cells and cells that only say that there is nothing
(``[]``, ``-``, ``none``, ``null`` ...) give no rows; empty pieces give no rows; repeated
values are kept and counted; pieces that are no value of the field's kind and follow no
value are dropped; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import spread, stored

KEY_SLOTS = 1 << 14
ROUNDS = 4
#: Weight of a value's shape beside its own frequency; probability of each atom of a shape never seen; of a piece that is no value.
SHAPE_WEIGHT, NEW_ATOM, NO_VALUE = 10.0, 1e-3, 1e-6

_SEP = r"(?:[\s,;|]|→|»|=>|->|>(?=\s|$))"
_QUOTED = r"\"(?:[^\"\\]|\\.|\"\")*\"|'(?:[^'\\]|\\.|'')*'"
#: separator run | quoted span that ends a piece | plain run (quotes inside it stay closed)
_SCAN = {
    False: re.compile(rf"(?P<s>{_SEP}+)|(?P<q>(?:{_QUOTED})(?=$|{_SEP}))|(?P<p>(?:(?<==)\"[^\"]*\"|(?!{_SEP}).)+)", re.S),
    True: re.compile(rf"(?P<s>(?:{_SEP}|/)+)|(?P<q>(?:{_QUOTED})(?=$|{_SEP}|/))|(?P<p>(?:(?!{_SEP}|/).)+)", re.S),
}
#: Cells and pieces that only say that there is nothing.
_NOTHING = frozenset(["", "-", "--", "–", "—", "none", "null", "nil", "nan", "n/a", "na", "undefined", "false", "[]", "{}", "()"])
_BRACKETS = {"[": "]", "{": "}", "(": ")"}

KINDS = {
    "redirect_chain": re.compile(r"https?://[^\s]", re.I),
    "ld_types": re.compile(r"(?:https?://[^\s,;|]+/|[A-Za-z][\w.-]*:)?[A-Za-z_]\w*$", re.I),
    "hreflang": re.compile(r"[A-Za-z]{1,8}(?:[-_][A-Za-z0-9]{1,8})*$"),
    "resource_paths": re.compile(r"/"),
}
#: Kinds whose values may hold separator marks.
_SPANS = frozenset(["redirect_chain", "resource_paths"])
#: The beginning of a list of paths inside one value.
_OPEN = "?/"
_WORD, _NUMBER, _STEPS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(?:/a[.a9()_-]*)+")


def _unquote(q: str) -> str:
    body = q[1:-1]
    if q[0] * 2 in body:
        body = body.replace(q[0] * 2, q[0])
    if "\\" in body:
        try:
            return json.loads(f'"{body}"') if q[0] == '"' else body.replace("\\'", "'").replace("\\/", "/")
        except ValueError:
            return re.sub(r"\\(.)", r"\1", body)
    return body


def _sep_class(raw: str, open_list: bool) -> str:
    """Class of a separator: its mark, ``+`` where blanks stand beside it, ``?`` inside an open list."""
    core = raw.strip(" ")
    c = core[0] if core else " "
    c = "\n" if c in "\r\n\t" else ">" if c in "→»=->" else c
    return c + "+" * (core != raw and bool(core)) + "?" * open_list


def _shape(text: str) -> str:
    return _STEPS.sub("/a", _NUMBER.sub("9", _WORD.sub("a", text)))


#: text, quoted, raw separator before it, looks like the beginning of a value
Atom = tuple[str, bool, str, bool]


def atoms_of(cell: str, field: str) -> list[Atom]:
    """The pieces of a cell that are or may belong to a value."""
    s = cell.strip()
    if s.lower() in _NOTHING:
        return []
    if s[0] in _BRACKETS and s[-1] == _BRACKETS[s[0]] and len(s) > 1:
        s = s[1:-1].strip()
    kind, spans, out, sep = KINDS[field], field in _SPANS, [], ""
    for m in _SCAN[field == "hreflang"].finditer(s):
        what, text = m.lastgroup, m.group()
        if what == "s":
            sep += text
            continue
        if what == "q":
            if (value := _unquote(text).strip()) and value.lower() not in _NOTHING and kind.match(value):
                out.append((value, True, sep, True))
        elif kind.match(text):
            if text.lower() not in _NOTHING:
                out.append((text, False, sep, True))
        elif spans and out and not out[-1][1]:
            out.append((text, False, sep, False))
        sep = ""
    return out


def _crc(key: str, before: int = 0) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass"), before)


class Model:
    """Frequencies of values (``V`` and slot), of shapes (``S`` and slot), and of separators that end a
    value or lie inside one (``E`` or ``I`` and class)."""

    def __init__(self, counts: dict[str, float] | None = None):
        self.counts = counts or {}
        self.values, self.shapes = self._table("V"), self._table("S")
        self.ends, self.inside = ({k[1:]: n for k, n in self.counts.items() if k[0] == c} for c in "EI")

    def _table(self, of: str) -> tuple[dict[int, float], float, float]:
        """(count by slot, all counts, what a slot owes to collisions on average)"""
        table = {int(k[1:]): n for k, n in self.counts.items() if k[0] == of}
        total = sum(table.values())
        return table, total, total / KEY_SLOTS if len(table) > KEY_SLOTS // 2 else 0.0

    def value(self, text: int, shape: int, atoms: int, is_value: bool = True) -> float:
        """log P(value), by the checksums of its text and shape"""
        (shapes, all_shapes, shape_noise), (values, total, noise) = self.shapes, self.values
        log_new = atoms * math.log(NEW_ATOM) + (0.0 if is_value else math.log(NO_VALUE))
        seen = max(0.0, shapes.get(shape % KEY_SLOTS, 0.0) - shape_noise)
        own = max(0.0, values.get(text % KEY_SLOTS, 0.0) - noise)
        if not own and not seen:  # the power of a long value would be 0
            return log_new - math.log(all_shapes + 1.0)
        like = (seen + math.exp(log_new)) / (all_shapes + 1.0)
        return math.log((own + SHAPE_WEIGHT * like) / (total + SHAPE_WEIGHT))

    def sep(self, cls: str) -> tuple[float, float]:
        """log P(ends a value), log P(belongs to one)"""
        prior = 0.3 if cls == ",?" else 0.95
        a, b = self.ends.get(cls, 0.0) + 10 * prior, self.inside.get(cls, 0.0) + 10 * (1 - prior)
        return math.log(a / (a + b)), math.log(b / (a + b))


class Edge(NamedTuple):
    end: int
    text: int  # checksums of the value and of its shape
    shape: int
    size: int  # atoms, where a list counts as two
    inner: str  # class of the separator before its last atom, if it has several
    last: str  # class of the separator that ends it


def edges_of(atoms: list[Atom]) -> list[list[Edge]]:
    """Per start atom the values that may begin there, each one atom longer than the one before."""
    n, out = len(atoms), []
    for i, (head, quoted, _, begins) in enumerate(atoms):
        text, shape, size, opened, j, inner, own = _crc(head), _crc(_shape(head)), 1, not quoted and _OPEN in head, i + 1, "", []
        while True:
            own.append(Edge(j, text, shape, size, inner, _sep_class(atoms[j][2], opened) if j < n else ""))
            if j == n or quoted or not begins or atoms[j][1]:
                break
            part, _, sep, starts = atoms[j]
            inner = _sep_class(sep, opened)
            if starts and (not opened or inner[0] != "," or _OPEN in part):  # only commas join the paths of a list
                break
            text = _crc(part, _crc(sep, text))
            if not starts:
                shape, size = _crc(inner[0] + _shape(part), shape), size + 1
            elif size == 1:
                shape, size = _crc(",/a", shape), 2  # a list of paths has one shape, whatever its length
            j += 1
        out.append(own)
    return out


def _scores(atoms: list[Atom], edges: list[list[Edge]], model: Model) -> list[list[float]]:
    """Score of each edge: its value, the separators inside and the one that ends it."""
    out = []
    for (_, _, _, begins), own in zip(atoms, edges):
        inside, row = 0.0, []
        for e in own:
            inside += model.sep(e.inner)[1] if e.inner else 0.0
            row.append(model.value(e.text, e.shape, e.size, begins) + inside + (model.sep(e.last)[0] if e.last else 0.0))
        out.append(row)
    return out


def _lse(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def count_value(counts: Counter, text: int, shape: int, weight: float) -> None:
    counts[f"V{text % KEY_SLOTS}"] += weight
    counts[f"S{shape % KEY_SLOTS}"] += weight


def count_quoted(counts: Counter, text: str, field: str, weight: float) -> None:
    """A quoted span is one value for certain; the separators in it belong to it."""
    parts = atoms_of(text, field) if field in _SPANS else []
    if len(parts) < 2 or parts[0][1]:
        count_value(counts, _crc(text), _crc(_shape(text)), weight)
        return
    whole = edges_of(parts)[0]
    if whole[-1].end == len(parts):
        count_value(counts, whole[-1].text, whole[-1].shape, weight)
    for e in whole[1:]:
        counts["I" + e.inner] += weight


def expect(atoms: list[Atom], weight: float, field: str, model: Model, counts: Counter) -> None:
    """E-step: adds the expected counts of one cell, by forward-backward."""
    n, edges = len(atoms), edges_of(atoms)
    scores = _scores(atoms, edges, model)
    fwd, bwd = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    fwd[0], bwd[n] = 0.0, 0.0
    for i in range(n):
        for e, score in zip(edges[i], scores[i]):
            fwd[e.end] = _lse(fwd[e.end], fwd[i] + score)
    for i in range(n - 1, -1, -1):
        for e, score in zip(edges[i], scores[i]):
            bwd[i] = _lse(bwd[i], score + bwd[e.end])
    for i in range(n):
        longer = 0.0  # weight of the values from i that hold the separator at hand
        for e, score in zip(edges[i][::-1], scores[i][::-1]):
            p = weight * math.exp(fwd[i] + score + bwd[e.end] - fwd[n])
            if atoms[i][1]:
                count_quoted(counts, atoms[i][0], field, p)
            elif p:
                count_value(counts, e.text, e.shape, p)
            if e.last:
                counts["E" + e.last] += p
            longer += p
            if e.inner:
                counts["I" + e.inner] += longer


def best_cuts(atoms: list[Atom], model: Model) -> list[int]:
    """Viterbi: the ends of the values on the likeliest path."""
    n, edges = len(atoms), edges_of(atoms)
    best, back = [-math.inf] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for i, row in enumerate(_scores(atoms, edges, model)):
        for e, score in zip(edges[i], row):
            if (s := best[i] + score) > best[e.end]:
                best[e.end], back[e.end] = s, i
    cuts, j = [], n
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def one_path(atoms: list[Atom]) -> bool:
    """Whether the lattice of a cell has one path: every atom begins a value, and no list is open at the next."""
    return not any(not b[3] or (_OPEN in a[0] and not a[1] and not b[1] and "," in b[2]) for a, b in zip(atoms, atoms[1:]))


def split_cell(cell: str | None, field: str, model: Model) -> list[str]:
    atoms = atoms_of(cell, field) if cell else []
    if one_path(atoms):
        return [a[0] for a in atoms]
    out, i = [], 0
    for j in best_cuts(atoms, model):
        if atoms[i][3]:  # a piece that looks like no value is none
            out.append("".join([atoms[i][0], *(a[2] + a[0] for a in atoms[i + 1 : j])]))
        i = j
    return out


def _observe(fields: list[str]):
    """Certain counts of the cells whose lattice has one path; the other cells as forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: Counter = Counter()
        sums: dict[str, Counter] = {f: Counter() for f in fields}

        def flush() -> pa.RecordBatch:
            rows = [(f, form, "", float(n)) for (f, form), n in forms.items()] + [(f, None, k, n) for f in fields for k, n in sums[f].items()]
            forms.clear()
            for f in fields:
                sums[f].clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OBSERVED.types)], schema=_OBSERVED)

        for batch in batches:
            for field in fields:
                counts = sums[field]
                for cell in batch.column(batch.schema.get_field_index(field)).to_pylist():
                    if not cell or not (atoms := atoms_of(cell, field)):
                        continue
                    if not one_path(atoms):
                        forms[field, json.dumps(atoms, ensure_ascii=False)] += 1
                        continue
                    for k, (text, quoted, sep, _) in enumerate(atoms):
                        if quoted:
                            count_quoted(counts, text, field, 1.0)
                        else:
                            count_value(counts, _crc(text), _crc(_shape(text)), 1.0)
                        if k:
                            counts["E" + _sep_class(sep, False)] += 1.0
            if len(forms) > 50_000:
                yield flush()
        if forms or any(sums.values()):
            yield flush()

    return run


_OBSERVED = pa.schema([("field_name", pa.string()), ("form", pa.string()), ("slot", pa.string()), ("n", pa.float64())])
_STATS = pa.schema([("field_name", pa.string()), ("slot", pa.string()), ("n", pa.float64())])


def _e_step(models: dict[str, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {f: Counter() for f in models}
        for batch in batches:
            for field, form, n in zip(*(c.to_pylist() for c in batch.columns)):
                expect([tuple(a) for a in json.loads(form)], n, field, models[field], counts[field])
        rows = [(f, k, v) for f in models for k, v in counts[f].items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _STATS.types)], schema=_STATS)

    return run


def learn(df: DataFrame, fields: list[str], rounds: int = ROUNDS) -> dict[str, Model]:
    """Expectation maximisation over all cells of ``fields``; returns a model for each field.

    Collected per round: at most two sums for each of ``KEY_SLOTS`` and the separator classes of each field.
    """
    seen = stored(df.select(*fields).mapInArrow(_observe(fields), "field_name string, form string, slot string, n double").groupBy("field_name", "form", "slot").agg(F.sum("n").alias("n")), "observed")

    def collected(rows: DataFrame) -> dict[str, dict[str, float]]:
        out: dict[str, dict[str, float]] = defaultdict(dict)
        for field, slot, n in rows.select("field_name", "slot", "n").collect():
            out[field][slot] = n
        return out

    certain = collected(seen.where("form is null"))
    forms = seen.where("form is not null").select("field_name", "form", "n")
    models = {f: Model(certain[f]) for f in fields}
    if forms.isEmpty():
        return models
    for _ in range(rounds):
        stats = forms.mapInArrow(_e_step(models), "field_name string, slot string, n double").groupBy("field_name", "slot").agg(F.sum("n").alias("n"))
        expected = collected(stats)
        models = {f: Model(dict(Counter(certain[f]) + Counter(expected[f]))) for f in fields}
    return models


def split_packed(df: DataFrame, key: str, fields: list[str], models: dict[str, Model] | None = None) -> DataFrame:
    """One row per value: (``key``, field_name, ord from 1, item)."""
    df = spread(df.select(key, *fields))
    models = models or learn(df, fields)
    kind = df.select(key).schema[0].dataType
    item_type = pa.list_(pa.struct([("field_name", pa.string()), ("items", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [batch.column(1 + i).to_pylist() for i in range(len(fields))]
            rows = [[{"field_name": f, "items": items} for f, cell in zip(fields, row) if cell and (items := split_cell(cell, f, models[f]))] for row in zip(*cells)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, item_type)], names=["k", "cells"])

    cells = df.select(F.col(key).alias("k"), *fields).mapInArrow(run, f"k {kind.simpleString()}, cells array<struct<field_name string, items array<string>>>")
    return (
        cells.select("k", F.explode("cells").alias("c"))
        .select("k", "c.field_name", F.posexplode("c.items").alias("ord", "item"))
        .select(F.col("k").alias(key), "field_name", (F.col("ord") + 1).cast("int").alias("ord"), "item")
    )


def lattice_report(df: DataFrame, fields: list[str], models: dict[str, Model] | None = None) -> DataFrame:
    """(field_name, cells, atoms, values, decided): how many cells hold a value, and for how many of
    them the lattice has more than one path, so that the learned frequencies decide."""
    df = spread(df.select(*fields))
    models = models or learn(df, fields)
    names = ["field_name", "cells", "atoms", "values", "decided"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, f in enumerate(fields):
                parsed = [(c, a) for c in batch.column(i).to_pylist() if c and (a := atoms_of(c, f))]
                decided = [c for c, a in parsed if not one_path(a)]
                rows.append((f, len(parsed), sum(len(a) for _, a in parsed), sum(len(split_cell(c, f, models[f])) for c, _ in parsed), len(decided)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    counted = df.mapInArrow(run, "field_name string, cells bigint, atoms bigint, values bigint, decided bigint")
    return counted.groupBy("field_name").agg(*[F.sum(c).alias(c) for c in names[1:]])
