"""Splitting oversized items at natural boundaries: content-defined chunking of markdown.

Method
------
A rolling hash over 32 code points marks *landmarks* in the text. From the last cut the
first landmark between the minimum and the maximum size is taken and snapped to the nearest
natural boundary in that window: the end of a paragraph, of a list item, table row, code line
or line that ends with its sentence, or of a sentence; of two equally near ones the stronger.
Without any in the window the last one before it is taken, else the blank or wrapped line
nearest to the landmark, else the edge of a written character. Cuts depend on nearby content
only, so an edit alters its own piece and its neighbours; later pieces stay.

Each piece is the heading, a line break, the last ``overlap`` characters of the text before
the cut, and its own part; together at most ``limit`` code points.

Defined cases: null counts as empty; rows within the limit come out as one piece that is
their text; a text without any boundary is cut between written characters (never before an
accent, joiner or variation mark, unless one such cluster alone exceeds the limit); a
heading too long to be carried (it would leave fewer than ``ROOM`` characters) becomes part
of the text, once; long texts take linear time; repeated rows are split alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, ROOM = 1200, 120, 100
_WINDOW, _MASK = 32, 127
_PARA = regex.compile(r"\n[ \t\r]*\n\s*|\n(?=#{1,6} )|(?<=\n```[^\n]*)\n(?!.*\n```)")
#: a line end that is no mere wrapping: the line ends a sentence, row or item, or the next one begins one
_LINE = regex.compile(r"(?:(?<=[.!?:;。！？।؟|][ \t]*)\n|\n(?=[ \t]*(?:[-*+•>|]|#{1,6} |\d{1,3}[.)][ \t]|$))|(?<=(?:\A|\n)[ \t]*(?:[-*+•][ \t]|\d{1,3}[.)][ \t])[^\n]*)\n)(?![ \t\r]*\n)")
_SENTENCE = regex.compile(r"(?<=\p{L}\p{M}?\p{L}[)\]]?|[\p{Nd}%)\]\"'”’»“])[.!?…]+[\"'”’»“)\]]*\s+(?=[\p{Lu}\p{Lt}\p{Nd}\p{Pi}\p{Ps}\p{So}\"'¿¡])|[。！？｡]+[」』”’）】]*(?![と、。！？」』”’）】])|[।؟۔][\"”»]*\s*")
_BLANK = regex.compile(r"\s+|[、，；：]")
_GLUE = regex.compile(r"[\p{M}‍︀-️\U0001f3fb-\U0001f3ff]|(?<=‍).|(?<=\r)\n", regex.S)


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of the ``_WINDOW`` code points up to each position."""
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(codes), np.uint64)
    for k in range(_WINDOW):
        out[k:] += mixed[: len(mixed) - k if k else None] * np.uint64(pow(1099511628211, k, 1 << 64))
    return out >> np.uint64(40)


def boundaries(text: str) -> list[np.ndarray]:
    """Cut positions by level, the strongest first: paragraphs, lines, sentences, blanks."""
    fences, inside = [], False
    for m in regex.finditer(r"(?m)^```[^\n]*\n?", text):
        fences.append(m.end() if inside else m.start())
        inside = not inside
    para = {m.end() for m in _PARA.finditer(text)}
    if fences:  # a blank line inside a fence is only a line end
        edges = np.array(fences)
        para = {p for p in para if np.searchsorted(edges, p, "left") % 2 == 0 or p in fences}
        para.update(f for f in fences if 0 < f < len(text))
    line = {m.end() for m in _LINE.finditer(text)}
    for a, z in zip(fences[::2], fences[1::2]):  # lines of code
        line.update(m.end() for m in regex.finditer(r"\n", text, pos=a, endpos=z))
    ends = lambda p: {m.end() for m in p.finditer(text)}
    return [np.array(sorted(x), dtype=int) for x in (para, line, ends(_SENTENCE), ends(_BLANK))]


def cuts(text: str, most: int) -> list[int]:
    """End of each piece of ``text``; no piece is longer than ``most`` code points."""
    n, least = len(text), max(1, most // 3)
    if n <= most:
        return [n]
    marks = np.flatnonzero((rolling_hash(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")) & np.uint64(_MASK)) == 0)
    levels, glue, out, start = boundaries(text), None, [], 0
    natural = np.concatenate(levels[:3])
    rank = np.repeat(np.arange(3), [len(x) for x in levels[:3]])
    order = np.lexsort((rank, natural))
    natural, rank = natural[order], rank[order]
    while n - start > most:
        low, high = start + least, start + most
        i = np.searchsorted(marks, low)
        mark = int(marks[i]) + 1 if i < len(marks) and marks[i] < high else (low + high) // 2
        cut = 0
        for at, strength in ((natural, rank), (levels[3], None)):
            x, y = np.searchsorted(at, low), np.searchsorted(at, high, "right")
            if x < y:
                away = np.abs(at[x:y] - mark)
                cut = int(at[x + (np.lexsort((strength[x:y], away))[0] if strength is not None else away.argmin())])
            elif x and at[x - 1] > start:
                cut = int(at[x - 1])
            if cut:
                break
        if not cut:
            if glue is None:
                glue = {m.start() for m in _GLUE.finditer(text)}
            cut = next((p for p in range(high, start, -1) if p not in glue), high)
        out.append(cut)
        start = cut
    return [*out, n]


def pieces(heading: str | None, content: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, text) of each piece; start and end refer to the text that is split."""
    heading, content = heading or "", content or ""
    lead = heading + "\n" if heading else ""
    if len(lead) + len(content) <= limit:
        return [(0, len(content), lead + content)]
    if limit - overlap - len(lead) < ROOM:
        lead, content = "", lead + content
    out, start = [], 0
    for end in cuts(content, limit - overlap - len(lead)):
        out.append((start, end, lead + content[max(0, start - overlap) : end]))
        start = end
    return out


def split_oversized(df: DataFrame, key: str, heading: str = "heading", content: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(``key``, piece_no from 1, piece_count, part_start, part_end, text); rows within the limit
    stay in the JVM and give one piece."""
    rows = df.select(F.col(key), F.coalesce(heading, F.lit("")).alias("heading"), F.coalesce(content, F.lit("")).alias("content"))
    size = F.length("content") + F.when(F.col("heading") != "", F.length("heading") + 1).otherwise(0)
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, i + 1, len(ps), a, z, t) for k, h, c in zip(*(x.to_pylist() for x in b.columns)) for ps in [pieces(h, c, limit, overlap)] for i, (a, z, t) in enumerate(ps)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=[key, "piece_no", "piece_count", "part_start", "part_end", "text"])

    cut = rows.where(size > limit).mapInArrow(run, f"{key} {kind}, piece_no int, piece_count int, part_start int, part_end int, text string")
    whole = rows.where(size <= limit).select(
        key, F.lit(1).alias("piece_no"), F.lit(1).alias("piece_count"), F.lit(0).alias("part_start"), F.length("content").alias("part_end"),
        F.when(F.col("heading") != "", F.concat("heading", F.lit("\n"), "content")).otherwise(F.col("content")).alias("text"),
    )
    return cut.unionByName(whole)
