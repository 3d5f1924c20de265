import random

import numpy as np
import pytest

from sitelens.llm import sentences as S


def split(text):
    out, p = [], 0
    for e in S.ends_of([text])[0]:
        out.append(text[p:e].strip())
        p = e
    assert not text[p:].strip()  # nothing is left over
    return out


@pytest.mark.parametrize(
    "sentences",
    [
        ["The owner is Lobafo Inc., the agency is Soro & Co. and both agree.", "At 9 a.m. the page went.", "It starts at 9 p.m.", "iOS clients skip.", "'alt text' is not a key in feed.v2.xml.", "J. K. Rese rewrote it.", "Really?!"],
        ["She asked \"Who changed it?\" and got no reply.", "The reviewer wrote: \"Why is it missing?\"", "(Ask the web team.)", "It has to be fixed (who owns it? the team) before launch.", "The Hopla! widget drops.", "The crawl paused ... and resumed."],
        ["It ships only to the U.S.", "Compared with 2025, it drops.", "The U.S. storefront stays flat.", "See no. 12 in the list; Sect. 16.16 explains it.", "Wait… the data stays flat.", "robots.txt wins over it here.", "app.min.js too."],
        ["Das gilt für Fa. Dore i. d. R. ab Version 1.2.5.", "Seit dem 1. Halbjahr 2025 fehlt das, s. o. und vgl. https://x.example/a.9?q=x.y dazu.", "Der Lauf beginnt am 9. Mai.", "„Das fehlt.“", "Mehr stand nicht im Ticket.", "Zuständig ist H. Nonasi, Tel. 8552.", "Gem. Kap. 3.4 fehlt das."],
        ["Im Protokoll steht „Abruf fehlgeschlagen. Bitte später.“ und danach nichts.", "Die Prüferin schrieb: „Warum?“", "Titel, Bilder usw. wurden exportiert, sagt die GmbH & Co. KG dazu.", "Das betrifft Links usw.", "Das Hopla!-Modul fehlt.", "Laut Abs. 21 gilt das, vgl. S. 9."],
        ["Elle a demandé : « Pourquoi ? »", "M. Nori renvoie à l'art. 19 du guide, cf. le n° 3.", "Le journal indique « Échec. Réessayez. » puis rien.", "Vraiment ?!", "Plusieurs champs, p. ex. le titre."],
        ["Ella preguntó: «¿Por qué?»", "¡No borren nada!", "El n.º 7 afecta a EE. UU. y Canadá.", "La Dra. Pane remite a la pág. 10.", "¿Hace falta?"],
        ["Она спросила: «Почему?»", "Поля a, b и т. д. были пусты.", "Отчёт за 2025 г. лежит у Koki, см. рис. 9.", "В журнале «Сбой. Повторите.» и больше ничего."],
        ["डॉ. Dazule ने देखा।", "लॉग में \"विफल। बाद में।\" लिखा है।", "क्या चाहिए?", "डॉ. Lofu ने देखा।"],
        ["راجع د. Lofu كل شيء.", "يقول السجل «فشل. أعد المحاولة.» ثم يتوقف.", "هل نحتاج؟", "لا تحذفوا شيئا!"],
    ],
)
def test_spaced(sentences):
    for sep in (" ", "\n", "  ", "\n\n"):
        assert split(sep.join(sentences)) == sentences


@pytest.mark.parametrize(
    "sentences",
    [
        ["「なぜ？」とRetaさんが尋ねた。", "記録には「取得に失敗した。後で試す。」と残っている。", "待って……説明文は確認が必要だ。", "何も消さないこと！", "Sutafiさんは確認した（原因は不明。）と書いた。"],
        ["审核员说：“缺失了。”", "审核员说：“复查。”", "日志写着“抓取失败。请稍后重试。”然后就停了。", "“为什么？”Zipi问道。", "Kipa检查了（原因不明。）并做了记录。", "中位数从3.88秒降到8.14秒。"],
    ],
)
def test_unspaced(sentences):
    assert split("".join(sentences)) == sentences


def test_structure():
    assert split("# Kopf. Zwei\n\nText eins. Text\nzwei.\n\n1. Eins. Zwei\nweiter\n2. Drei\n- Vier") == ["# Kopf. Zwei", "Text eins.", "Text\nzwei.", "1. Eins. Zwei\nweiter", "2. Drei", "- Vier"]
    assert split("กฎนี้ทำงาน 9 ครั้ง ไฟล์ llms.txt มี 9 เส้นทาง ทีมงาน") == ["กฎนี้ทำงาน 9 ครั้ง", "ไฟล์ llms.txt มี 9 เส้นทาง", "ทีมงาน"]
    assert split("- It ships to the U.S.\n- Really?!\n\n1. To the U.S.\n2. Zwei") == ["- It ships to the U.S.", "- Really?!", "1. To the U.S.", "2. Zwei"]
    assert split("Tel.\n23. Siehe Nr.\n4 der Liste (see Fig.\n15) hier. Gut.") == ["Tel.\n23.", "Siehe Nr.\n4 der Liste (see Fig.\n15) hier.", "Gut."]
    assert split("1. Es weicht\nab\n3. Am 9. Mai") == ["1. Es weicht\nab", "3. Am 9. Mai"]
    assert split("Das ist am\n9. Mai so.Wir zählten.") == ["Das ist am\n9. Mai so.", "Wir zählten."]
    assert S.ends_of([None, "", " \n", "no end"]) == [[], [], [], [6]]


def test_distance_does_not_count():
    inner = "Der Abruf ist fehlgeschlagen. Bitte später noch einmal. " * 200
    for a, z in ("„“", "„”", "«»", "‹›", '""', "()", "[]"):
        text = f"Im Protokoll steht {a}{inner.strip()}{z} und danach nichts."
        assert len(text) > 5000 and split(f"{text} Mehr nicht.") == [text, "Mehr nicht."]
    ja = "記録には「" + "取得に失敗した。後で試す。" * 500 + "」と残っている。"
    assert split(ja + "次の文だ。") == [ja, "次の文だ。"]
    zh = "“为什么？”Zipi在" + "复查缓存和镜像环境" * 20 + "以后问道。"
    assert split(zh + "下一句。") == [zh, "下一句。"]
    listed = "Siehe (Kap. 3" + " und weiter" * 100 + "\n15) hier. Gut."
    assert split(listed) == [listed[: -len(" Gut.")], "Gut."]


def test_lone_marks_are_plain():
    for mark in ("„", "«", "(", "[", '"'):
        assert split(f"Das {mark}fehlt. Es folgt mehr. Und Schluss.") == [f"Das {mark}fehlt.", "Es folgt mehr.", "Und Schluss."]
    assert split("Das (fehlt. Es folgt mehr.\n\nUnd) Schluss.") == ["Das (fehlt.", "Es folgt mehr.", "Und) Schluss."]  # its partner is in another paragraph
    assert split('Er sagte "ja. Gut" und "das. Es folgt mehr.') == ['Er sagte "ja. Gut" und "das.', "Es folgt mehr."]


def test_prefix_scan_equals_a_plain_run():
    rnd = random.Random(7)
    parts = ['He asked "why? now." and left. ', "„Das fehlt.“ ", "Dr. X. ", "\n\n", "- a. b\n", "（不明。）", "x ", "... ", "U.S. ", "(open ", "“", "y! "]
    texts = ["".join(rnd.choice(parts) for _ in range(n)) for n in (1, 50, 3000, 0, 900)]
    streams = S.pair([S.scan(t)[0] for t in texts])
    assert all((a == b).all() for a, b in zip(streams, [S.pair([S.scan(t)[0]])[0] for t in texts]))
    plain = []
    for s in streams:
        state, flags = 0, []
        for i, sym in enumerate(s):
            if S.STARTS[state, sym]:
                flags.append(i)
            state = S.NEXT[state, sym]
        plain.append(flags)
    for chunk in (7, 64, 512):
        assert [x.tolist() for x in S.starts_of(streams, chunk)] == plain
    f = S.chunk_functions(np.array([s for s in np.array_split(streams[2][: 64 * 8], 8)], np.int16))
    total = S.prefix_compose(f)[-1]
    assert (total == S.chunk_functions(streams[2][None, : 64 * 8])[0]).all()


def test_table(spark):
    rows = [(1, "One. Two.", "x"), (2, None, "x"), (3, "  ", "x"), (4, "One. Two.", None), (4, "One. Two.", None), (5, "A sentence here. " * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ord string")
    got = S.split_sentences(df, "doc_id", "text").collect()
    assert [(r.start_off, r.end_off) for r in got if r.doc_id == 1] == [(0, 4), (5, 9)] and sum(r.doc_id == 4 for r in got) == 4 and sum(r.doc_id == 5 for r in got) == 20_000
    assert S.split_sentences(df.where("false"), "doc_id", "text").count() == 0


def test_long_documents_in_pieces(spark):
    """Scanned in small pieces by many tasks, texts come out as they do whole."""
    rnd = random.Random(11)
    parts = [
        "Der Abruf ist fehlgeschlagen und wird wiederholt. ", "Im Protokoll steht „Abruf fehlgeschlagen. Bitte später“ und danach nichts. ", "She asked \"Who changed the table?\" and left. ", "(Ask the web team. It knows.) ", "\n\n", "\n\n# Kopf. Zwei\n",
        "\n- first item here. second part\n2. other item follows\n", "the plain words go on without any end ", "On „opened and never closed. ", "这一条镜像路径没有返回预期的页面模板。审核员说：“缺失了。”", "กฎนี้ทำงานเก้าครั้ง ทีมงานตรวจสอบ", "it's the client's 'alt text' here. ", "Отчёт лежит внизу слева. ", "Tel. 8552, vgl. Kap. 3.4 (siehe Abs. 2). ",
    ]
    texts = ["".join(rnd.choice(parts) for _ in range(n)) for n in (400, 5, 900)] + ["„" + "lange rede ohne ende hier. " * 300 + "“ und Schluss. Ja.", "x" * 9000, "   "]
    cuts = [S.safe_cuts(t, 200) for t in texts]
    assert len(cuts[0]) > 20 and len(cuts[3]) > 20 and cuts[4] == [0]
    for t, own in zip(texts, cuts):
        # words without case marks may come in one symbol or several, with the blank behind them or without: no state tells them apart
        plain = lambda symbols: [n for n, before in zip(symbols, [None, *symbols]) if n != before or n not in ("lower", "other_script")]
        names = lambda scanned: [n for n in (S._NAMES[s] for s in scanned[0]) if n != "blank"]
        assert plain(names(S.scan(t))) == plain([n for a, z in zip(own, [*own[1:], len(t)]) for n in names(S.scan(t[a:z]))])
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id bigint, text string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(S.split_sentences(df, "doc_id", "text", long=300, size=200)) == rows(S.split_sentences(df, "doc_id", "text"))
