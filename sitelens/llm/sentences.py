"""Sentence boundaries across languages and scripts: a finite transducer, run in parallel.

Method
------
1. A scanner turns a text into symbols: words by case and script, blanks, line structure,
   terminators, abbreviations, numbers, file and host names, quotes, brackets.
2. The boundary rules are a state machine over these symbols (``step``). It is compiled by
   exploring all states that can be reached, into a table ``state x symbol -> state, starts a
   sentence here``. A pending end is settled by the symbols after it, so no look-back is
   needed; quotations and brackets are states of their own.
3. Whether a quotation or bracket that opens is closed before its paragraph ends is what a
   second machine knows that reads from the right, with one bit for each kind of pair; an
   opener without its partner becomes plain punctuation. Distance does not count.
4. A long document's symbols are cut into chunks. Each chunk is evaluated as a function from
   every entry state to its exit state; the functions are composed by a parallel prefix scan,
   which gives each chunk's entry state; then all chunks of all documents run side by side,
   one column of symbols at a time.

Scale: one pass over the documents without a shuffle; chunks of one long document are
evaluated together with those of the others, so length costs no more than volume. A document
of more than ``LONG`` characters does not stay in one task: it is cut where symbols can't change
(``safe_cuts``), its pieces are scanned by many tasks, and what each piece tells of the ones beside
it (which partners it holds for openers before it; its function from state to state) is composed
in order, first from the right, then from the left. The result is the same.

Defined cases: null and blank texts give no rows; a text without any terminator is one
sentence; unmatched quotes and brackets are plain characters; an empty line ends whatever
is open; repeated texts are split alike; the language column is not needed (scripts decide).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import spread, stored

CHUNK = 512
#: Characters beyond which a document is scanned in pieces, and characters of a piece.
LONG, PIECE = 400_000, 100_000

# Abbreviations that a name, number or phrase always follows ...
_NEVER = (
    "Dr Dra Prof Mr Mrs Ms St Sr Sra Srta Hr Hrn Fr Frl Fa Mme Mlle Mgr Me Nr Nrn Abs Abb Kap Bd Tel Tab Gem gem vgl ca lt bzw inkl exkl zzgl sog evtl ggf Art art Fig fig Sect sect Sec sec Eq eq Vol vol Ch "
    "approx Approx vs cf Cf env Env aprox Aprox pág Pág págs núm Núm cap Cap Ud Uds p pp см рис Рис табл стр ул им проф акад гр г-н Ок ок ср напр гл ред डॉ श्री प्रो д-р أ د م"
)
# ... those that do when a number follows ...
_NUMBERED = "no No nos n N S s z Z u l c § pt Pt al v bl bzw п ст п.п том"
# ... those that may also end a sentence ...
_MAYBE = "etc usw usf uvm Inc Ltd Co Corp Jr Sr Bros min Min Std std sec Sek sek Jh Jhd Mio Mrd Mill al Ä jr ff hrs hr mins г гг в вв тыс млн млрд руб др пр"
# ... and dotted ones that never end one.
_DOTTED_NEVER = r"[ei]\.\s?[ge]\.|[zZ]\.\s?B\.|[dD]\.\s?h\.|[iI]\.\s?d\.\s?R\.|[uU]\.\s?a\.|[sS]\.\s?[ou]\.|[oO]\.\s?g\.|[vV]\.\s?a\.|[pP]\.\s?(?:ex|ej)\.|[cC]\.-à-d\.|т\.\s?е\.|т\.\s?к\.|n\.\s?[ºª°o]|[Nn]°"
_DOTTED_MAYBE = r"EE\.\s?UU\.|т\.\s?[дп]\.|[ap]\.m\.|(?:\p{Lu}\.){2,}|(?:\p{L}\.){2,}|et\s+al\."
_ORDINAL_BEFORE = r"[Aa]m|[Ii]m|[Dd]em|[Dd]er|[Dd]en|[Dd]es|[Dd]as|[Dd]ie|[Vv]om|[Zz]um|[Zz]ur|[Bb]eim|[Ss]eit|[Bb]is|[Aa]b|und|ein|eine|einem|einen|einer|jeder|jedem"
_ORDINAL_AFTER = r"Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Halbjahr|Jahrhundert|Jahrestag|Stock|Platz|Auflage"

#: a number after one of these, carried over to the next line, begins no list item
_NO_COUNT = r"(?<!(?<![\w.])(?:[Tt]el|S|Nrn?|Abs|Abb|Kap|Bd|[Ff]ig|[Nn]os?|[Ss]ect|[Aa]rt|págs?|рис|стр|vgl|cf|approx|ca|[Ee]nv|[Aa]prox|pp?)\.\s+)"
_L = r"[\p{L}\p{M}\p{N}\p{Cf}]"
_TOKENS = [
    # the frequent and unambiguous forms first; each leaves what needs a closer look to those below
    ("blank", r"[ ]++(?![\s\p{Thai}])"),
    ("lower", r"(?<=\s)[a-z]+(?: [a-z]+)*(?=\s)"),
    ("lower", rf"(?:(?<!{_L})\p{{Ll}}(?:(?!\p{{Lu}}){_L}|['’-](?={_L}))*+(?![.!?'’\p{{Lu}}:@/])[ ]*+)+"),
    ("other_script", r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]+|(?=\p{Lo})[\p{Lo}\p{M}]++(?!\.)"),
    ("upper", rf"(?<!{_L})\p{{Lu}}(?:(?!\p{{Lo}}){_L}|-(?={_L}))*+(?![.!?'’:@/])"),
    ("number", r"(?<![\w.,-])\d+(?:[.,]\d+)*+(?![\w.,:/@)-])"),
    ("period", r"\.(?![.!?]|[ ]\.)"),
    ("punct", r"[,;](?=\s)"),
    ("para", r"[^\S\n]*\n[^\S\n]*\n\s*"),
    ("heading", r"(?=\#)(?<=(?:\A|\n)[ \t]*)\#{1,6}[ \t]+(?=\S)"),
    ("ordinal_line", rf"(?=\d)(?<=\n[ \t]*)(?:(?<=\b(?:{_ORDINAL_BEFORE})\s+)\d{{1,3}}\.(?=\s+\p{{Lu}})|(?<!\w)\d{{1,3}}\.(?=\s+(?:{_ORDINAL_AFTER})\b))"),
    ("number", rf"(?=\d)(?:(?<=\b(?:{_ORDINAL_BEFORE})\s+)\d{{1,3}}\.(?=\s+\p{{Lu}})|(?<!\w)\d{{1,3}}\.(?=\s+(?:{_ORDINAL_AFTER})\b))"),
    ("item", rf"(?=[-*+•‣1])(?<=(?:\A|\n)[ \t]*){_NO_COUNT}(?:[-*+•‣]|1\.)[ \t]+(?=\S)"),
    ("item_n", rf"(?=\d)(?<=(?:\A|\n)[ \t]*){_NO_COUNT}\d{{1,3}}\.[ \t]+(?=\S)"),
    ("item_bracket", rf"(?=1)(?<=(?:\A|\n)[ \t]*){_NO_COUNT}1\)[ \t]+(?=\S)"),
    ("item_n_bracket", rf"(?=\d)(?<=(?:\A|\n)[ \t]*){_NO_COUNT}\d{{1,3}}\)[ \t]+(?=\S)"),
    ("margin", r"(?=>)(?<=(?:\A|\n)[ \t]*)>+[ \t]?"),
    ("thai_gap", r"(?=\s)(?<=\p{Thai})\s+(?=\p{Thai})"),
    ("line", r"[^\S\n]*\n\s*"),
    ("blank", r"\s+"),
    ("file", r"https?://[!-~]*[A-Za-z0-9/=&\#%+~_-]"),
    ("abbr", rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Ll}})(?:{_DOTTED_NEVER})|(?<![\p{{L}}\p{{N}}])Co\.(?=\s*(?:KG|OHG)\b)"),
    ("Abbr", rf"(?<![\p{{L}}\p{{N}}])(?:{_DOTTED_NEVER})"),
    ("maybe", rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Ll}})(?:{_DOTTED_MAYBE})"),
    ("Maybe", rf"(?<![\p{{L}}\p{{N}}])(?:{_DOTTED_MAYBE})"),
    ("file", r"(?<![\p{L}\p{N}])(?![\d.,:]+(?![\w]))[A-Za-z0-9_][A-Za-z0-9_-]*(?:(?:[.:/@](?![a-z]+\p{Lu})[a-z0-9_]|:[A-Za-z0-9_])[A-Za-z0-9_-]*)+(?![\p{Lu}])"),
    ("number", r"\d+(?:[.,:/]\d+)*"),
    ("lower", rf"(?<!{_L})(?:[cdjlmnst]|qu)['’](?=\p{{L}})"),
    ("upper", rf"(?<!{_L})(?:[CDJLMNST]|Qu)['’](?=\p{{L}})"),
    ("abbr", rf"(?<!{_L})(?=\p{{Ll}})\L<never>\.|(?<!{_L})(?=\p{{Ll}})\L<numbered>\.(?=\s*\d)"),
    ("Abbr", rf"(?<!{_L})\L<never>\.|(?<!{_L})\L<numbered>\.(?=\s*\d)|(?<!{_L})\p{{Lu}}\.(?=\s*\p{{Lu}})"),
    ("maybe", rf"(?<!{_L})(?=\P{{Lu}})\L<maybe>\.(?<!(?<=\d\s?)[a-zг]\.)"),
    ("Maybe", rf"(?<!{_L})\L<maybe>\."),
    ("camel", rf"(?<!{_L})\p{{Ll}}+\p{{Lu}}(?:{_L}|['’-](?={_L}))*"),
    ("lower", rf"\p{{Ll}}(?:(?!\p{{Lo}}){_L}|['’-](?={_L}))*"),
    ("upper", rf"[\p{{Lu}}\p{{Lt}}](?:(?!\p{{Lo}}){_L}|['’-](?={_L}))*"),
    ("other_script", r"[\p{L}\p{M}]+"),
    ("dots", r"\.{2,}(?:[ ]\.{2,})*|\.(?:[ ]\.){2,}|…+|⋯+"),
    ("strong", r"[。！？｡．](?:[。！？｡．!?])*|[।॥؟۔](?:[।॥؟۔!?])*"),
    ("exclaim", r"[!?‼⁇⁈⁉][.!?‼⁇⁈⁉]*|\.(?=[!?])[.!?]*"),
    ("period", r"\."),
    ("colon", r"[:：]"),
    ("open_german", r"[„‚]"),
    ("open_angle", r"[«‹]"),
    ("close_angle", r"[»›]"),
    ("left_curly", r"“"),
    ("go_on_zh", r"”(?=[^。！？，；：“”\n]*+(?<=问道|说道|答道|喊道|写道|问|说|答|表示|补充)[。，！])"),
    ("right_curly", r"”"),
    ("open_corner", r"[「『]"),
    ("go_on", r"[」』](?=と|って|など|は|が|を|に|も|の|で|や|だ)"),
    ("close_corner", r"[」』]"),
    ("double", r"\""),
    ("open_single", r"(?<![\p{L}\p{N}])['‘](?=[\p{L}\p{N}][^'‘’\n]*+['’](?!\p{L}))"),
    ("close_single", r"(?<=[^\s])['’](?![\p{L}\p{N}])"),
    ("open_bracket", r"[(\[（【{]"),
    ("close_bracket", r"[)\]）】}]"),
    ("starter", r"[¿¡]"),
    ("emphasis", r"[*_`~]+"),
    ("dash", r"[-–—―]+"),
    ("invisible", r"\p{Cf}+"),
    ("punct", r"[\p{P}\p{Sm}\p{Sc}\p{Sk}%°]"),
    ("symbol", r"\S"),
]
#: double_end: no other straight quote follows in the paragraph, so that it can only close
_NAMES = sorted({n for n, _ in _TOKENS} | {"double_end"})
SYMBOL = {n: i for i, n in enumerate(_NAMES)}
_FIRST = {"letter": r"\p{L}", "number": r"\p{N}", "blank": r"\s", "other": r"[^\p{L}\p{N}\s]"}
#: What a form can begin with, where that is not any character: forms are only tried at such characters.
_BEGINS_WITH = {
    "blank": "blank", "para": "blank", "thai_gap": "blank", "line": "blank", "lower": "letter", "upper": "letter", "camel": "letter", "abbr": "letter", "Abbr": "letter", "maybe": "letter", "Maybe": "letter", "ordinal_line": "number", "number": "number",
    "item_n": "number", "item_bracket": "number", "item_n_bracket": "number",
    **dict.fromkeys(["period", "punct", "heading", "margin", "dots", "strong", "exclaim", "colon", "open_german", "open_angle", "close_angle", "left_curly", "go_on_zh", "right_curly", "open_corner", "go_on", "close_corner", "double", "open_single", "close_single", "open_bracket", "close_bracket", "starter", "emphasis", "dash", "invisible"], "other"),
}
#: After these a blank tells nothing, so that they take it along; not one that a gap between Thai letters may be.
_WITH_BLANK = {**dict.fromkeys(["lower", "upper", "number", "punct", "camel", "file"], r"(?:[ ](?![\s\p{Thai}]))?+"), "other_script": r"(?:(?<!\p{Thai})[ ](?![\s\p{Thai}]))?+"}
_FORMS = [(first, n, f"(?:{p}){_WITH_BLANK.get(n, '')}") for first in _FIRST for n, p in _TOKENS if _BEGINS_WITH.get(n, first) == first]
_SCANNER = regex.compile(
    "|".join(f"(?={pattern})(?:{'|'.join(f'({p})' for f, _, p in _FORMS if f == first)})" for first, pattern in _FIRST.items()), regex.V0, never=_NEVER.split(), numbered=_NUMBERED.split(), maybe=_MAYBE.split()
)
_OF_GROUP = np.array([-1, *(SYMBOL[n] for _, n, _ in _FORMS)], np.int16)
_KINDS = {"open_german": "g", "open_angle": "a", "open_corner": "c", "open_single": "s", "open_bracket": "b", "left_curly": "l", "double": "d"}
_CLOSES = {"close_angle": "a", "right_curly": "lg", "go_on_zh": "lg", "left_curly": "g", "close_corner": "c", "go_on": "c", "double": "dg", "double_end": "dg", "close_single": "s", "close_bracket": "b"}
_BLANKS = ("blank", "line", "thai_gap", "margin")
_TERMINATORS = {"period": ".", "exclaim": "!", "strong": "T", "maybe": "m", "Maybe": "m"}
#: Symbols that can begin a sentence after a pending end and a blank.
_BEGINS = frozenset(["upper", "Abbr", "Maybe", "camel", "file", "starter", *_KINDS])
START, HEADING, ITEM = ("start",), ("heading",), ("item",)


def step(state: tuple, sym: str) -> tuple[tuple, bool]:
    """The boundary rules: next state, and whether a sentence starts at this symbol."""
    kind = state[0]
    if sym == "para":
        return START, False
    if sym == "heading":
        return HEADING, True
    if sym == "invisible":
        return state, False
    if sym == "ordinal_line":  # in a list a number at the line's beginning is the next item's
        if kind == "item":
            return ITEM, True
        sym = "number"
    if sym in ("item_bracket", "item_n_bracket"):
        if kind == "open" and state[1] == "b":  # no item: its bracket closes the one that is open
            return step(_quoted((*state[:3], False, state[4]), "close_bracket"), "blank")
        sym = sym.removesuffix("_bracket")
    if kind == "heading":
        return (START, False) if sym == "line" else (state, False)
    if sym == "item" or (sym == "item_n" and kind in ("start", "item", "pending")):
        return ITEM, True
    if kind == "item":
        return state, False
    if sym == "item_n" and kind == "mid":  # no item here, but a number and the period behind it
        return ("pending", ".", True), False
    if kind == "start":
        if sym == "margin":
            return ("mid", False), True
        if sym in _BLANKS:
            return START, False
        return (("open", _KINDS[sym], "S", False, 1), True) if sym in _KINDS else (_inside(sym, False), True)
    if kind == "mid":
        if sym == "thai_gap":
            return START, False
        return (state, False) if sym in _BLANKS else (_inside(sym, state[1]), False)
    if kind == "open":
        return _quoted(state, sym), False
    return _pending(state, sym)


def _inside(sym: str, colon: bool) -> tuple:
    if sym in _TERMINATORS:
        return ("pending", _TERMINATORS[sym], False)
    if sym in _KINDS:
        return ("open", _KINDS[sym], "C" if colon else "M", False, 1)
    return ("mid", sym == "colon")


def _quoted(state: tuple, sym: str) -> tuple:
    _, what, how, ended, depth = state
    if what in _CLOSES.get(sym, ""):
        if depth > 1:
            return ("open", what, how, ended, depth - 1)
        if sym == "go_on" or (sym == "go_on_zh" and how == "S") or not ended or (what == "b" and how != "S"):
            return ("mid", False)
        return ("pending", ("b" if what == "b" else "q") + how, False)
    if _KINDS.get(sym) == what and what in "bac":
        return ("open", what, how, False, min(depth + 1, 3))
    if sym in _BLANKS or sym in _CLOSES:
        return state
    return ("open", what, how, sym in _TERMINATORS, depth)


def _pending(state: tuple, sym: str) -> tuple[tuple, bool]:
    _, what, gap = state
    if sym == "thai_gap":
        return START, False
    if sym == "margin":  # the mark of a quoted line goes with the sentence that it opens
        return step(START, sym) if what not in ("m", "qM") else (state, False)
    if sym in _BLANKS:
        return ("pending", what, True), False
    if sym in ("period", "exclaim", "strong"):
        return ("pending", what if what[0] in "qb" else _TERMINATORS[sym], gap), False
    if not gap and (sym == "emphasis" or (sym in _CLOSES and sym not in _KINDS)):
        return state, False  # what belongs to the end
    ends = False
    if what == "T":
        ends = sym not in ("punct", "colon", "dash", "dots")
    elif what in (".", "!"):
        ends = sym in _BEGINS or sym in ("number", "symbol", "emphasis", "dash", "other_script") if gap else sym in ("upper", "camel", "Abbr", "Maybe", "starter", "other_script") or (sym in _KINDS and sym != "open_single")
    elif what == "m":
        ends = sym in _BEGINS or sym in ("symbol", "emphasis", "other_script") if gap else sym == "upper"
    elif what == "qM":
        ends = gap and sym in _BEGINS
    else:  # a quotation after a colon or alone, a bracket alone
        ends = sym in _BEGINS or sym in ("number", "symbol", "other_script", "emphasis")
    return step(START, sym) if ends else (_inside(sym, False), False)


def compile_table() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a sentence) by state and symbol, over all reachable states; state 0 is the start."""
    number, rows, todo = {START: 0}, [], [START]
    for state in todo:
        row = [step(state, s) for s in _NAMES]
        for new, _ in row:
            if new not in number:
                number[new] = len(number)
                todo.append(new)
        rows.append(row)
    return np.array([[number[n] for n, _ in r] for r in rows], np.int16), np.array([[f for _, f in r] for r in rows], bool)


NEXT, STARTS = compile_table()


def scan(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a text and where they begin."""
    at, groups = [], []
    for m in _SCANNER.finditer(text):
        at.append(m.start())
        groups.append(m.lastindex)
    return _OF_GROUP[np.array(groups, np.int16)] if groups else np.zeros(0, np.int16), np.array(at, np.int64)


#: kinds of pairs: (symbols that open, symbols that close, what an opener without partner becomes)
_PAIRS = [
    (("open_german",), ("left_curly", "right_curly", "go_on_zh", "double"), "punct"), (("open_angle",), ("close_angle",), "punct"), (("open_corner",), ("close_corner", "go_on"), "punct"),
    (("open_bracket",), ("close_bracket", "item_bracket", "item_n_bracket"), "punct"), (("double",), ("double",), "double_end"),
]


def pair(streams: list[np.ndarray]) -> list[np.ndarray]:
    """The reading from the right, for all streams at once: openers that no partner follows in
    their paragraph are plain."""
    if not streams:
        return streams
    lengths = np.array([len(s) for s in streams])
    flat = np.concatenate(streams)
    paragraph = np.cumsum(flat == SYMBOL["para"]) + np.repeat(np.arange(len(streams)), lengths) * (len(flat) + 1)
    out = flat.copy()
    for opens, closes, lone in _PAIRS:
        at = np.flatnonzero(np.isin(flat, [SYMBOL[n] for n in opens]))
        if len(at):
            ends = np.append(np.flatnonzero(np.isin(flat, [SYMBOL[n] for n in closes])), len(flat))
            nearest = ends[np.searchsorted(ends, at, "right")]
            open_ended = (nearest == len(flat)) | (paragraph[np.minimum(nearest, len(flat) - 1)] != paragraph[at])
            out[at[open_ended]] = SYMBOL[lone]
    return np.split(out, np.cumsum(lengths)[:-1])


def chunk_functions(chunks: np.ndarray) -> np.ndarray:
    """For each row of symbols (-1: none) the exit state of every entry state."""
    states = np.tile(np.arange(len(NEXT), dtype=np.int16), (len(chunks), 1))
    for column in chunks.T:
        live = column >= 0
        states[live] = NEXT[states[live], column[live, None]]
    return states


def prefix_compose(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions of the chunk functions, by parallel scan in log(n) rounds."""
    out, shift = functions.copy(), 1
    while shift < len(out):
        # function i follows function i - shift
        out[shift:] = np.take_along_axis(out[shift:], out[:-shift].astype(np.int64), axis=1)
        shift *= 2
    return out


def starts_of(streams: list[np.ndarray], chunk: int = CHUNK, entry: list[int] | None = None) -> list[np.ndarray]:
    """For each symbol stream the symbols at which a sentence starts; ``entry``: the states that they begin in."""
    spans = [(d, a) for d, s in enumerate(streams) for a in range(0, len(s), chunk)]
    if not spans:
        return [np.zeros(0, np.int64) for _ in streams]
    grid = np.full((len(spans), chunk), -1, np.int16)
    for r, (d, a) in enumerate(spans):
        part = streams[d][a : a + chunk]
        grid[r, : len(part)] = part
    first = np.zeros(len(streams), np.int64) if entry is None else np.asarray(entry)
    entry = first[[d for d, _ in spans]].astype(np.int16)
    rows: dict[int, list[int]] = {}
    for r, (d, _) in enumerate(spans):
        rows.setdefault(d, []).append(r)
    for d, rs in rows.items():
        if len(rs) > 1:  # a long document: its chunks as functions, composed by prefix scan
            entry[rs[1:]] = prefix_compose(chunk_functions(grid[rs[:-1]]))[:, first[d]]
    order = np.argsort(-(grid >= 0).sum(axis=1), kind="stable")  # rows still alive stay in front
    grid, state = grid[order], entry[order]
    lengths = (grid >= 0).sum(axis=1)
    flags = np.zeros(grid.shape, bool)
    for c in range(int(lengths.max())):
        n = int(np.searchsorted(-lengths, -c, "left"))
        sym = grid[:n, c]
        flags[:n, c] = STARTS[state[:n], sym]
        state[:n] = NEXT[state[:n], sym]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return [np.concatenate([np.flatnonzero(flags[back[r]]) + spans[r][1] for r in rows[d]]) if d in rows else np.zeros(0, np.int64) for d in range(len(streams))]


def _trimmed(text: str, starts: list[int]) -> list[int]:
    """The ends of the sentences that lie before ``starts`` and the text's end, without blanks."""
    ends: list[int] = []
    for p in [*starts, len(text)]:
        while p and text[p - 1].isspace():
            p -= 1
        if p and (not ends or p > ends[-1]):
            ends.append(p)
    return ends


def ends_of(texts: list[str | None]) -> list[list[int]]:
    """For each text the offsets behind the last character of its sentences."""
    scanned = [scan(t or "") for t in texts]
    return [_trimmed(text, at[begins[1:]].tolist()) if text else [] for text, (_, at), begins in zip(texts, scanned, starts_of(pair([s for s, _ in scanned])))]


#: A cut between these changes no symbol: after a paragraph's end, or between plain words, or inside a run of
#: letters of scripts without blanks.
_SAFE = regex.compile(r"(?<=\n[ \t]*\n)(?=\S)|(?<=[a-zа-я]{4}[ \n])(?=[a-zа-я]{4})|(?<=\p{Han}{2})(?=\p{Han}{2})|(?<=\p{Thai}{2})(?=\p{Thai}{2})")
_LOOKS_AHEAD = regex.compile(r"['‘’“”]")


def safe_cuts(text: str, size: int = PIECE) -> list[int]:
    """Where a long text is cut: at the first safe place after each ``size`` characters. Before a cut inside a
    line the line holds no mark whose meaning lies further on in it."""
    cuts, at = [0], size
    while at < len(text):
        for m in _SAFE.finditer(text, at):
            p = m.start()
            line = max(text.rfind("\n", cuts[-1], p) + 1, cuts[-1])
            if text[p - 1] == "\n" or not _LOOKS_AHEAD.search(text, line, p):
                break
        else:
            break
        cuts.append(p)
        at = p + size
    return cuts


def _edges(symbols: np.ndarray) -> tuple[int, bool]:
    """(bits of the kinds of partners that the piece holds before its first paragraph end, has it one)"""
    ends = np.flatnonzero(symbols == SYMBOL["para"])
    head = symbols[: ends[0]] if len(ends) else symbols
    return sum(1 << n for n, (_, closes, _) in enumerate(_PAIRS) if np.isin(head, [SYMBOL[c] for c in closes]).any()), bool(len(ends))


def _open_to(symbols: np.ndarray, bits: int) -> np.ndarray:
    """The piece's symbols after the reading from the right, where ``bits`` tells which partners follow in the
    paragraph that the piece's end lies in."""
    follow = [SYMBOL[closes[0]] for n, (_, closes, _) in enumerate(_PAIRS) if bits >> n & 1]
    return pair([np.concatenate((symbols, np.array(follow, np.int16)))])[0][: len(symbols)]


def _compose(pieces: pa.Table) -> pa.Table:
    """For each piece of one document: the partners that follow it, by composing from the right."""
    order = np.argsort(pieces.column("n").to_numpy())
    bits, ends = pieces.column("bits").to_numpy()[order], np.array(pieces.column("ends").to_pylist(), bool)[order]
    out, after = np.zeros(len(order), np.int64), 0
    for k in range(len(order) - 1, -1, -1):
        out[k], after = after, int(bits[k]) if ends[k] else int(bits[k]) | after
    return pa.table({"uid": pieces.column("uid").take(pa.array(order)), "n": pieces.column("n").take(pa.array(order)), "follow": pa.array(out)})


def _enter(pieces: pa.Table) -> pa.Table:
    """For each piece of one document the state in which it begins, by a prefix scan of the functions."""
    order = np.argsort(pieces.column("n").to_numpy())
    functions = np.stack([np.frombuffer(f, np.int16) for f in pieces.column("function").to_pylist()])[order]
    entry = np.concatenate(([0], prefix_compose(functions)[:-1, 0])).astype(np.int64)
    return pa.table({"uid": pieces.column("uid").take(pa.array(order)), "n": pieces.column("n").take(pa.array(order)), "entry": pa.array(entry)})


def starts_in_pieces(docs: DataFrame, key: str, text: str, size: int = PIECE) -> DataFrame:
    """(own, at): the offsets at which sentences start in the long documents (uid, ``key``, ``text``), scanned in pieces."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, k, t in zip(*(c.to_pylist() for c in b.columns)):
                cuts = [*safe_cuts(t, size), len(t)]
                n = len(cuts) - 1
                yield pa.RecordBatch.from_arrays([pa.array([uid] * n), pa.array([k] * n, b.schema.field(1).type), pa.array(range(n), pa.int32()), pa.array(cuts[:-1], pa.int64()), pa.array([t[a:z] for a, z in zip(cuts, cuts[1:])])], names=["uid", key, "n", "base", "piece"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(t) for t in b.column(4).to_pylist()]
            bits = [_edges(s) for s, _ in got]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([s.tobytes() for s, _ in got], pa.binary()), pa.array([at.tobytes() for _, at in got], pa.binary()), pa.array([x for x, _ in bits], pa.int64()), pa.array([x for _, x in bits])],
                names=["uid", key, "n", "base", "symbols", "at", "bits", "ends"],
            )

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for symbols, follow in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s = _open_to(np.frombuffer(symbols, np.int16), follow)
                grid = np.full((-(-max(1, len(s)) // CHUNK), CHUNK), -1, np.int16)
                grid.ravel()[: len(s)] = s
                out.append(prefix_compose(chunk_functions(grid))[-1].astype(np.int16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["uid", "n", "function"])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, base, symbols, at, follow, state in zip(*(c.to_pylist() for c in b.columns)):
                s = _open_to(np.frombuffer(symbols, np.int16), follow)
                (found,) = starts_of([s], entry=[state])
                places = np.frombuffer(at, np.int64)[found] + base
                yield pa.RecordBatch.from_arrays([pa.array([uid] * len(places), pa.int64()), pa.array(places)], names=["own", "at"])

    pieces = docs.select("uid", key, text).mapInArrow(cut, f"uid bigint, {key} {kind}, n int, base bigint, piece string")
    cores = docs.sparkSession.sparkContext.defaultParallelism
    read = stored(pieces.repartition(4 * cores).mapInArrow(scanned, f"uid bigint, {key} {kind}, n int, base bigint, symbols binary, at binary, bits bigint, ends boolean"), "scanned")
    follow = read.select("uid", "n", "bits", "ends").groupBy("uid").applyInArrow(_compose, "uid bigint, n int, follow bigint")
    known = stored(read.join(follow, ["uid", "n"]), "followed")
    entry = known.select("uid", "n", "symbols", "follow").mapInArrow(functions, "uid bigint, n int, function binary").groupBy("uid").applyInArrow(_enter, "uid bigint, n int, entry bigint")
    return known.join(entry, ["uid", "n"]).select("uid", "base", "symbols", "at", "follow", "entry").mapInArrow(starts, "own bigint, at bigint")


def _rows_of(key: str):
    """Sentences of whole texts whose starts are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t, at in zip(*(c.to_pylist() for c in b.columns)):
                ends = _trimmed(t, at[1:])
                yield _sentences([k], [t], [ends], key, b.schema.field(0).type)

    return run


def _sentences(keys: list, texts: list[str], ends: list[list[int]], key: str, kind: pa.DataType) -> pa.RecordBatch:
    out_keys, orders, starts, stops = [], [], [], []
    for k, t, own in zip(keys, texts, ends):
        p = 0
        for n, e in enumerate(own, 1):
            while t[p].isspace():
                p += 1
            out_keys.append(k), orders.append(n), starts.append(p), stops.append(e)
            p = e
    return pa.RecordBatch.from_arrays([pa.array(out_keys, kind), *(pa.array(x, pa.int32()) for x in (orders, starts, stops))], names=[key, "ord", "start_off", "end_off"])


def split_sentences(df: DataFrame, key: str, text: str, long: int = LONG, size: int = PIECE) -> DataFrame:
    """(``key``, ord from 1, start_off, end_off) for each sentence, in code points of the text."""
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"{key} {kind}, ord int, start_off int, end_off int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for s in range(0, big.num_rows, 1000):
                b = big.slice(s, 1000)
                texts = b.column(1).to_pylist()
                yield _sentences(b.column(0).to_pylist(), texts, ends_of(texts), key, b.schema.field(0).type)

    rows = df.select(key, text).where(F.col(text).isNotNull())
    short = spread(rows.where(F.length(text) <= long)).mapInArrow(run, schema)
    large = stored(rows.where(F.length(text) > long), "long")
    if large.isEmpty():
        return short
    numbered = stored(large.select(F.monotonically_increasing_id().alias("uid"), key, text), "numbered")
    begins = starts_in_pieces(numbered, key, text, size).groupBy("own").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return short.unionByName(numbered.join(begins, F.col("uid") == F.col("own")).select(key, text, "at").mapInArrow(_rows_of(key), schema))
