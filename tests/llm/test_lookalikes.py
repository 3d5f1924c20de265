import pytest

from sitelens.llm import lookalikes as L

BIGRAMS = L.Bigrams({a + b: 10 for w in ("^office$", "^wool$", "^fahrräder$", "^gartenbänke$", "^körbe$", "^книжная$", "^полка$", "^algodón$", "^zakure$") for a, b in zip(w, w[1:])})


@pytest.mark.parametrize(
    "text, want",
    [
        ("Ｏｆｆｉｃｅ １２", "Office 12"), ("Oﬀice", "Office"), ("Fahrräder", "Fahrräder"), ("Fahrr​äder⁠", "Fahrräder"), ("a b c", "a b c"), ("a　b", "a b"), ("﻿wool", "wool"), ("Co­rb", "Corb"),
        ("wоol", "wool"), ("Gаrtenbänkе", "Gartenbänke"), ("Κörbe", "Körbe"), ("algodо́n", "algodón"), ("Kнижная", "Книжная"), ("Korb", "Korb"), ("ｶﾞｰﾃﾞﾝ", "ガーデン"), ("が", "が"),
    ],
)
def test_disguises(text, want):
    assert L.canonical(text, BIGRAMS) == want
    assert L.canonical(want, BIGRAMS) == want


@pytest.mark.parametrize("text", ["Hängelampe – “x” … №", "Tara　陶器の急須（限定）！", "کتاب‌خانه", "\U0001f468‍\U0001f469‍\U0001f467 ok", "Книжная полка Bufo", "Beniのウール", "a\tb\r\n c  d", "", "क्‍ष", "❤️"])
def test_ordinary_writing_stays(text):
    assert L.canonical(text, BIGRAMS) == text


def test_more_scripts():
    texts = {"offiсe": "office", "օffice": "office", "wօօl": "wool", "Ꮶorb": "Korb", "ⲟffice": "office", "Gɑrtenbänke": "Gartenbänke", "Ɡartenbänke": "Ɡartenbänke", "ɡartenbänke": "gartenbänke", "Gartenbänkе": "Gartenbänke"}
    model = L.Bigrams({**BIGRAMS.pairs, **{a + b: 10 for w in ("^korb$", "^gartenbänke$") for a, b in zip(w, w[1:])}})
    assert {t: L.canonical(t, model) for t in texts} == texts


def test_words_of_other_alphabets_stay():
    turkish = L.Bigrams({a + b: 500 for w in ("^kapı$", "^ışık$", "^altın$") for a, b in zip(w, w[1:])})
    assert [L.canonical(t, turkish) for t in ("kapı", "ışık altın")] == ["kapı", "ışık altın"]
    assert [L.canonical(t, BIGRAMS) for t in ("հայերեն", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ⲙⲉⲧⲣⲉⲙⲛⲭⲏⲙⲓ", "ελληνικά", "русский")] == ["հայերեն", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ", "ⲙⲉⲧⲣⲉⲙⲛⲭⲏⲙⲓ", "ελληνικά", "русский"]


def test_table(spark):
    rows = [(1, "wоol", None, "x"), (1, "wоol", None, "x"), (2, "", "Ａ", "x"), (3, "plain wool", "z​" * 30_000, None)]
    df = spark.createDataFrame(rows, "row_no bigint, title string, h1 string, text string")
    got = [(r.row_no, r.field_name, r.canonical) for r in L.canonicalize(df, "row_no", ["title", "h1"]).collect()]
    assert sorted(x[:2] for x in got) == sorted((n, f) for n in (1, 1, 2, 3) for f in ("title", "h1"))
    assert got.count((1, "title", "wool")) == 2 and (2, "h1", "A") in got and (2, "title", "") in got and (3, "h1", "z" * 30_000) in got and (1, "h1", None) in got
    assert sorted((r.row_no, r.field_name) for r in L.canonicalize(df, "row_no", ["title", "h1"], only_changed=True).collect()) == [(1, "title"), (1, "title"), (2, "h1"), (3, "h1")]
    assert L.canonicalize(df.where("false"), "row_no", ["title"]).count() == 0


def test_jvm_pattern_finds_all_disguises(spark):
    texts = ["Ｏ", "ﬀ", "ä", "a​b", "a b", "wоol", "K", "ｶ", "plain", "Fahrräder – x", "книжная", "陶器の急須（限定）！", "１", "wօol", "Ꮶorb", "ɡut", "հայերեն"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    hit = [r.x for r in df.selectExpr("t").select(__import__("pyspark").sql.functions.col("t").rlike(L.SUSPECT).alias("x")).collect()]
    assert hit == [True] * 8 + [False] * 4 + [True] * 4 + [False]
