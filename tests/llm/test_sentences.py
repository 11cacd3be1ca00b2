import pytest

from notelake.llm.p4_sentences import sentences

CASES = [
    ["Bring tools, e.g. a kettle, i.e. the new one, to Osterfell.", "It weighs 52.7 lb. more than the rope."],
    ["The shop closes at 7 p.m.", "As agreed, the choir left."],
    ["We meet at 5 p.m. near the lamp.", "See fig. 3 and vol. 59 about it."],
    ['"Stop. Take the sofa away," said a visitor.', "It leaks!"],
    ["“It leaks.”", "iron-free paint suits the harness (see ch. 46.39)."],
    ['The clerk asked, "Is it old? Really?" and left.', "Dr. and Mrs. are printed on it."],
    ["(The gardener sanded the canoe.)", "In Kelvowick we met."],
    ["Was it borrowed?!", "Nobody knows."],
    ["The carpet ... well, the gardener moved it.", "No. 20 on the list is new."],
    ["Das Treffen ist ca. 45,1 km entfernt.", "Am 6. März kam sie.", "Bitte Werkzeug, z. B. eine Säge, d. h. die alte."],
    ["„Halt. Nimm die Lampe mit“, sagte das Team.", "Die Uhr – na ja … – gehört Prof. und Dr. gleichermaßen."],
    ["M. le président et Mme la trésorière voient la malle.", "Est-ce que la locataire compte ?", "La cloche… enfin, on la prête."],
    ["« Arrête. Prends la malle », dit le passeur.", "Voir p. 16, fig. 2, etc. pour la serrure."],
    ["Нужны вещи, т. е. взять новую карту и т. д. по ошибке.", "«Стой. Возьми полку», — сказал хор."],
    ["「もう終わった。片づけよう。」と大家が言った。", "鏡が……まあ、大工が測った。", "16.7円だった…。", "えっ！？", "誰も知らない。"],
    ["“停下。把书架拿走。”委员会说。", "读数从97.5升到11.4。"],
    ['"रुको। साइकिल ले जाओ।" नाविक ने कहा।', "डॉ. साहब ने टोकरी देखी।"],
    ["«توقف. خذ السلم معك» قال النجار.", "هل أعاد الفريق الحقيبة؟", "رأى د. الضيف القارب."],
    ["กัปตันย้ายโซฟา 38 อันเมื่อวันจันทร์", "เพื่อนบ้านซ่อมปั๊มน้ำว่างหรือยังครับ", "ค่าเพิ่มจาก 49.7 เป็น 51.2 ก่อนพายุ"],
    ["See http://a.example/" + "x" * 300 + "/B.C?d=1 today.", "It leaks."],
    ["Write to " + "A." * 50 + "LEE@" + "B." * 60 + "EXAMPLE now.", "It leaks."],
    ["My page is www.a.example/x.html?id=4 today.", "Write to A.LEE@B.EXAMPLE now.", "Version 4.1.2 is in notes.v2.txt."],
]


@pytest.mark.parametrize("want", CASES, ids=[c[0][:20] for c in CASES])
def test_one_line(table, want):
    glue = "" if any("。" in w for w in want) else " "
    text = glue.join(want)
    rows = sentences(table([(1, text)], "k long, t string"), "k", "t").orderBy("start_pos").collect()
    assert [r["sentence"] for r in rows] == want
    assert all(text[r["start_pos"]:r["end_pos"]] == r["sentence"] for r in rows)


def test_lines_lists_and_edges(table):
    text = "  Heading\r\n22. 脚立を確認\n\n- a lamp, 42.8 kg  the end.Next one"
    long = "Word word. " * 50_000
    rows = sentences(table([(1, text), (2, None), (3, ""), (4, " \n\t "), (5, long), (None, "x.")], "k long, t string"), "k", "t")
    got = [r["sentence"] for r in rows.where("k = 1").orderBy("start_pos").collect()]
    assert got == ["Heading", "22. 脚立を確認", "- a lamp, 42.8 kg", "the end.", "Next one"]
    assert {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()} == {1: 5, 5: 50_000}
    assert sentences(table([], "k long, t string"), "k", "t").count() == 0


@pytest.mark.parametrize("marks", ["“”", "「」", "()", '""'])
def test_long_quotes_and_brackets_stay_whole(table, marks):
    inside = "The lamp is new. " * 60
    want = [f"The clerk said {marks[0]}{inside}{marks[1]} and left.", "It leaks."]
    rows = sentences(table([(1, " ".join(want))], "k long, t string"), "k", "t").orderBy("start_pos").collect()
    assert [r["sentence"] for r in rows] == want


def test_placeholders_of_the_text_itself_stay(table):
    text = "One \ue002 two. Mr. Three \ue000 \ue001 four! " + " " * 60 + "\n" + " " * 60 + "12. five"
    rows = sentences(table([(1, text)], "k long, t string"), "k", "t").orderBy("start_pos").collect()
    assert all(text[r["start_pos"]:r["end_pos"]] == r["sentence"] for r in rows)
    assert rows[0]["sentence"] == "One \ue002 two." and rows[-1]["sentence"] == "12. five"
