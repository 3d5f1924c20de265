"""Visually identical text with different characters: one consistent form for every text.

Method
------
1. Compatibility normalisation (full-width forms, ligatures, half-width kana, composed
   accents), plain blanks, and deletion of ignorable characters. Joiners that Persian or
   Indic words and emoji need stay; the ideographic space and full-width punctuation stay
   in Japanese and Chinese text.
2. A word that mixes letters of Latin, Greek, Cyrillic, Armenian, Cherokee or Coptic, or holds
   one of the unusual Latin letters that look like a usual one, is a lattice: each letter may
   stand for any of its look-alikes. Viterbi finds the reading with the best score under
   character bigrams of each script, learned from the words of the whole column; changing
   the script inside a word costs most, replacing a letter costs a little.

Scale: one JVM pattern decides which cells can need a change; only those reach Python.
Words are counted with map-side aggregation; the bigram table is bounded by the letters of
six alphabets. No shuffle carries a text.

Defined cases: null stays null and is no case; empty stays empty; words wholly in one
script stay, also with an unusual letter where the column uses it as usual (dotless i); a word all of whose letters have twins goes to its best-scoring script; very
long texts are handled in linear time; repeated rows are handled one by one.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Look-alike letters, as Latin, Greek and Cyrillic (a dot where a script has none) ...
LOOKALIKES = """
A Α А|B Β В|C . С|E Ε Е|H Η Н|I Ι І|J . Ј|K Κ К|M Μ М|N Ν .|O Ο О|P Ρ Р|S . Ѕ|T Τ Т|X Χ Х|Y Υ У|Z Ζ .
a α а|c ϲ с|e . е|i ι і|j ϳ ј|k κ к|n η .|o ο о|p ρ р|s . ѕ|u υ .|v ν .|w ω ѡ|x χ х|y γ у|h . һ|d . ԁ|q . ԛ|l . ӏ|m . м|t τ т|b . Ь|r . г
"""
# ... as Latin and the same in Armenian, Cherokee and Coptic ...
ARMENIAN = "O Օ|o օ|S Տ|U Ս|u ս|h հ|n ո|g ց|q զ|j յ|L Լ|f ք"
CHEROKEE = "A Ꭺ|B Ᏼ|C Ꮯ|D Ꭰ|E Ꭼ|G Ꮐ|H Ꮋ|J Ꭻ|K Ꮶ|L Ꮮ|M Ꮇ|P Ꮲ|R Ꮢ|S Ꮪ|T Ꭲ|V Ꮩ|W Ꮃ|Y Ꮍ|Z Ꮓ|i Ꭵ"
COPTIC = "C Ⲥ|c ⲥ|H Ⲏ|I Ⲓ|K Ⲕ|M Ⲙ|N Ⲛ|O Ⲟ|o ⲟ|P Ⲣ|p ⲣ|T Ⲧ|X Ⲭ|x ⲭ|Y Ⲩ"
# ... and letters of the Latin script itself, written as another one.
WITHIN_LATIN = "a ɑ|g ɡ|i ı|i ɩ|c ᴄ|o ᴏ|v ᴠ|w ᴡ|z ᴢ|s ꜱ|y ʏ"
_NAMES = {"L": "Latin", "G": "Greek", "C": "Cyrillic", "A": "Armenian", "K": "Cherokee", "P": "Coptic"}


def _twins() -> dict[str, list[tuple[str, str]]]:
    """Letter -> (script, letter) of all that it may stand for."""
    groups: dict[str, dict[str, str]] = {}
    single = []
    for row in LOOKALIKES.strip().replace("\n", "|").split("|"):
        own = {s: c for s, c in zip("LGC", row.split(" ")) if c != "."}
        groups[own["L"]] = own
    for script, text in (("A", ARMENIAN), ("K", CHEROKEE), ("P", COPTIC)):
        for latin, c in (row.split(" ") for row in text.split("|")):
            groups.setdefault(latin, {"L": latin})[script] = c
    single = [row.split(" ") for row in WITHIN_LATIN.split("|")]
    out = {c: [(s, t) for s, t in own.items() if s != script] for own in groups.values() for script, c in own.items()}
    for latin, c in single:
        out.setdefault(c, []).append(("L", latin))
    return out


_TWINS = _twins()
_INNER = "".join(dict.fromkeys(row.split(" ")[1] for row in WITHIN_LATIN.split("|")))

#: Cells that match none of these need no change: marks, invisible characters, odd blanks, compatibility letters, words of mixed scripts.
SUSPECT = (
    r"[\p{M}\p{Cf}\p{Zl}\p{Zp}\p{Co}]|[\x00-\x08\x0E-\x1F\x7F-\x9F]|[\p{Zs}&&[^ ]]"
    r"|[ª²³µ¹ºĲĳĿŀŉſǄ-ǌǱ-ǳʰ-ʸˠ-ˤևᴬ-ᵪᵸᶛ-ᶿẚ"
    r"⁰-ₜ℀-↋①-⓪ㄱ-ㆎ㈀-㏿ꚜꚝꝰꭜ-ꭟ豈-﫿ﬀ-﷿ﹰ-ﻼ０-９Ａ-Ｚａ-ｚｦ-ￜﾠᅟᅠㅤ]"
    r"|[\x{1D400}-\x{1D7FF}\x{1F100}-\x{1F190}\x{2F800}-\x{2FA1F}]|[" + _INNER + "]|"
    + "|".join(rf"\p{{Is{n}}}[" + "".join(rf"\p{{Is{m}}}" for m in _NAMES.values() if m != n) + "]" for n in _NAMES.values())
)

_EAST = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}]")
_RUN = regex.compile("[" + "".join(rf"\p{{{n}}}" for n in _NAMES.values()) + r"\p{Mn}]+")
_OF = {s: regex.compile(rf"\p{{{n}}}") for s, n in _NAMES.items()}
_WITHIN = regex.compile(f"[{_INNER}]")
_ODD = regex.compile(r"[\p{Cf}\p{Zs}\p{Zl}\p{Zp}\x00-\x08\x0e-\x1f\x7f-\x9f︀-️ᅟᅠㅤﾠ͏᠋-᠏]")
_ARABIC = regex.compile(r"[\p{Arabic}&&\p{L}]", regex.V1)
_VIRAMA = regex.compile(r"[्্੍્୍்్್്්]")
_PICTURE = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}️⃣]")
_COMPAT = regex.compile(r"[^\x00-\x7f]+")
#: A compatibility form is ordinary writing if it is punctuation, a symbol or a picture.
_LETTERISH = regex.compile(r"[\p{L}\p{N}\p{M}]")


def script_of(c: str) -> str:
    for s, p in _OF.items():
        if p.match(c):
            return s
    return ""


def _odd(text: str, east: bool):
    def swap(m: regex.Match) -> str:
        c, i = m.group(), m.start()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c == "　":
            return c if east else " "
        if c == "‌" and ((_ARABIC.match(before) and _ARABIC.match(after)) or _VIRAMA.match(before)):
            return c
        if c == "‍" and ((_PICTURE.match(before) and _PICTURE.match(after)) or _VIRAMA.match(before)):
            return c
        if "︀" <= c <= "️":
            return c if before and (_PICTURE.match(before) or before in "#*0123456789" or unicodedata.category(before) in ("So", "Sm", "Lo")) else ""
        if unicodedata.category(c) == "Zs":
            return " "
        if c in "  \x85":
            return "\n"
        if "\U000e0020" <= c <= "\U000e007f" and text[:i].rstrip("".join(map(chr, range(0xE0020, 0xE0080))))[-1:] == "\U0001f3f4":
            return c
        return ""

    return swap


def _compat(run: str, east: bool) -> str:
    """Compatibility form of letters, digits and accents; punctuation and pictures stay."""
    run = unicodedata.normalize("NFC", run)
    if unicodedata.is_normalized("NFKC", run):
        return run
    out = []
    for c in run:
        plain = unicodedata.normalize("NFKC", c)
        out.append(plain if plain != c and _LETTERISH.match(c) and _LETTERISH.search(plain) and not plain.startswith(" ") else c)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", "".join(out)) if any("ｦ" <= c <= "ﾟ" for c in run) and not any(c in "！（）、。「」　？：；，" for c in run) else _kana(out))


def _kana(chars: list[str]) -> str:
    """Joins half-width voiced marks, which follow their kana."""
    text = "".join({"ﾞ": "゙", "ﾟ": "゚"}.get(c, c) for c in chars)
    return unicodedata.normalize("NFC", text)


class Bigrams:
    """Character bigram log-probabilities for each script, with additive smoothing."""

    def __init__(self, counts: dict[str, float]):
        self.pairs, self.first = counts, Counter()
        for pair, n in counts.items():
            self.first[pair[0]] += n

    def score(self, a: str, b: str) -> float:
        return math.log((self.pairs.get(a + b, 0) + 0.05) / (self.first.get(a, 0) + 5.0))


def read_word(word: str, model: Bigrams, switch: float = 40.0, replace: float = 1.5) -> str:
    """Viterbi over the look-alike lattice of one word."""
    paths = {("^", ""): (0.0, None)}
    steps = []
    for c in word:
        own = script_of(c)
        options = [(c, own, 0.0), *((t, s, replace) for s, t in _TWINS.get(c, ()))]
        new: dict = {}
        for t, s, cost in options:
            best = None
            for (p, ps), (score, _) in paths.items():
                v = score + model.score(p.lower(), t.lower()) - cost - (switch if s and ps and s != ps else 0.0)
                if best is None or v > best[0]:
                    best = (v, (p, ps))
            carried = s or best[1][1]
            if (t, carried) not in new or best[0] > new[t, carried][0]:
                new[t, carried] = best
        steps.append(new)
        paths = new
    node = max(paths, key=lambda k: paths[k][0] + model.score(k[0].lower(), "$"))
    out = []
    for step in reversed(steps):
        out.append(node[0])
        node = step[node][1]
    return "".join(reversed(out))


def canonical(text: str, model: Bigrams) -> str:
    """The one ordinary form of a text."""
    east = bool(_EAST.search(text))
    text = _ODD.sub(_odd(text, east), text)
    text = _COMPAT.sub(lambda m: _compat(m.group(), east), text) if not text.isascii() else text
    text = unicodedata.normalize("NFC", text)  # an accent may follow an ASCII letter

    def fix(m: regex.Match) -> str:
        word = m.group()
        if sum(bool(p.search(word)) for p in _OF.values()) < 2 and not _WITHIN.search(word):
            return word
        return unicodedata.normalize("NFC", read_word(unicodedata.normalize("NFD", word), model))

    return text if text.isascii() else _RUN.sub(fix, text)


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: Counter = Counter()
    for b in batches:
        for token, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for word in _RUN.findall(unicodedata.normalize("NFD", token.lower())):
                if len({script_of(c) for c in word} - {""}) == 1:
                    for pair in zip("^" + word, word + "$"):
                        sums["".join(pair)] += n
    if sums:
        yield pa.RecordBatch.from_pydict({"pair": list(sums), "n": list(sums.values())})


def learn(long: DataFrame) -> Bigrams:
    """Bigrams of all words of the column ``text``; collects one sum for each pair of letters."""
    tokens = long.select(F.explode(F.split("text", " ")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rows = tokens.mapInArrow(_bigrams, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Bigrams({r.pair: r.n for r in rows})


def canonicalize(df: DataFrame, key: str, fields: list[str], only_changed: bool = False, model: Bigrams | None = None) -> DataFrame:
    """(``key``, field_name, text, canonical, disguised) for each cell of ``fields``.

    ``only_changed`` leaves out the cells whose canonical form is their text.
    """
    cells = df.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("c")).select(key, "c.*")
    model = model or learn(cells.where("text <> ''"))
    suspect = F.coalesce(F.col("text").rlike(r"[^\x20-\x7E\t\r\n]") & F.col("text").rlike(SUSPECT), F.lit(False))  # plain ASCII needs no closer look

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            forms = [canonical(t, model) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forms, pa.string()), pa.array([f != t for f, t in zip(forms, texts)])], names=[key, "field_name", "text", "canonical", "disguised"])

    kind = df.select(key).schema[0].dataType.simpleString()
    hard = cells.where(suspect).mapInArrow(run, f"{key} {kind}, field_name string, text string, canonical string, disguised boolean")
    if only_changed:
        return hard.where("disguised")
    return cells.where(~suspect).withColumns({"canonical": F.col("text"), "disguised": F.lit(False)}).unionByName(hard)
