import numpy as np
import pytest
from held_out_personal import SENTENCES

from notelake.llm import p1_personal as p1
from notelake.llm import p1_training as training
from notelake.llm.tagger import N_TAGS, TAGS, Tagger, TaggerConfig, _crf, train

NOTES = "note_id long, content string, kind string, n int"
CASES = [
    ("Contact Ilvavet Ostroshaw, zimiamir+list@brinmill.example or (0555) 68 03 81 for the keys.", {("name", "Ilvavet Ostroshaw"), ("email", "zimiamir+list@brinmill.example"), ("phone", "(0555) 68 03 81")}),
    ("We gave Mrs. Ostrondel the orchard and a coat.", {("name", "Ostrondel")}),
    ("My passport is X05938702 for the form.", {("id_number", "X05938702")}),
    ("Order 108-69-9320 is on its way. Part 555-4778 failed again. Ping @holmadyke-crew about build 0.640.7185.", set()),
    ("Moved to Flat 1, 16B Linder Lane, Sunderness! Lind Lane in Pellingwick was closed.", {("address", "Flat 1, 16B Linder Lane, Sunderness")}),
    ("届け先は〒007-9520 蛍織市藍織谷6-9-6です。担当は苔瀬 灯乃様、電話 ０００－２２７５－４３５３ です。", {("address", "〒007-9520 蛍織市藍織谷6-9-6"), ("name", "苔瀬 灯乃"), ("phone", "０００－２２７５－４３５３")}),
    ("Reply address is ilvavet.marraquist [at] zetharbor [dot] invalid, not the old one.", {("email", "ilvavet.marraquist [at] zetharbor [dot] invalid")}),
    ("Bei Frau Telnashaw nach der Kaffeekanne fragen. Rückruf unter 555-0158-808 erbeten.", {("name", "Telnashaw"), ("phone", "555-0158-808")}),
]


@pytest.fixture(scope="module")
def tagger():
    return Tagger.load(p1.weights())


@pytest.mark.parametrize("text,want", CASES)
def test_mentions(tagger, text, want):
    m = p1.mentions_of([text], tagger)[0]
    assert {(k, text[a:b]) for a, b, k in m} == want


def test_held_out_accuracy(tagger):
    """Invented values that no training text holds, in contexts of several languages."""
    rng = np.random.default_rng(99)
    words = ["".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(3)).capitalize() for _ in range(120)]
    texts, want = [], []
    for i in range(0, 120, 2):
        name = f"{words[i]} {words[i + 1]}"
        t = [f"Ask {name} about the piano.", f"According to {name}, the mirror was sold.", f"Demander à {name} pour la malle.", f"Kontakt: {name}, x@y.test, 0555/123456 wegen der Schlüssel."][i // 2 % 4]
        texts.append(f"The ferry was late. {t} Nobody has to wait.")
        want.append(name)
    found = p1.mentions_of(texts, tagger)
    hit = sum(any(k == "name" and t[a:b] == w for a, b, k in f) for t, f, w in zip(texts, found, want, strict=True))
    assert hit >= 0.85 * len(texts)


def test_rows_and_redaction(table):
    text = CASES[0][0]
    n = table([(1, text, "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, " \n", "x", 1), (5, "Nothing here. " * 30_000 + text, "x", 1)], NOTES)
    got = {(r["note_id"], r["kind"], r["found_text"]) for r in p1.mentions(n).collect()}
    assert got == {(i, k, v) for i in (1, 5) for k, v in CASES[0][1]}
    out = {r["note_id"]: r["content"] for r in p1.redacted(n).collect()}
    assert out[1] == "Contact [NAME], [EMAIL] or [PHONE] for the keys." and out[3] == "" and out[4] == " \n" and 2 not in out
    assert p1.mentions(n.limit(0)).count() == 0


def test_held_out_sentences(tagger):
    """Contexts and names that the generator of training texts doesn't know."""
    true = found = both = 0
    for text, want in SENTENCES:
        got = {(k, text[a:b]) for a, b, k in p1.mentions_of([text], tagger)[0]}
        true, found, both = true + len(want), found + len(got), both + len(got & set(want))
    assert both >= 0.88 * true and both >= 0.88 * found


def test_checks():
    t = "see Mr. Gravemont's piano"
    assert [t[a:b] for a, b in [p1.checked(t, 4, 19, "name")]] == ["Gravemont"]
    assert p1.checked("call 12 now", 5, 7, "phone") is None and p1.checked("abcDEF", 0, 6, "address") is None
    t = "(0555) 12 34 56, a@b.test; do"
    assert p1.checked(t, 1, 14, "phone") == (0, 15) and t[slice(*p1.checked(t, 17, 29, "email"))] == "a@b.test"
    assert p1.redact("a b c", []) == "a b c"


def test_generated_spans_are_of_their_kind():
    """Training texts have spans within them, in order, without overlaps."""
    texts = ["The gardener sold a lamp in Westfell. Nobody has to wait.", "庭師がランプを藍織谷で見つけた。", "Der Chor und die Lampe.", "La lampe est jolie et calme."]
    data = training.examples(texts, [("Ilvavet", "given", "latin"), ("Ostroshaw", "family", "latin"), ("澪羽", "given", "kanji"), ("雫瀬", "family", "kanji")], training.TrainingConfig(texts=400))
    kinds = set()
    for t, spans in data:
        assert all(0 <= a < b <= len(t) for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        kinds |= {k for _, _, k in spans}
        assert all(t[a:b] == t[a:b].strip() for a, b, _ in spans)
    assert kinds == set(p1.PLACEHOLDERS)


def test_parts_of_a_long_text_overlap(tagger, monkeypatch):
    monkeypatch.setattr(p1, "PART", 900)
    monkeypatch.setattr(p1, "SHARED", 400)
    case, filler = CASES[0][0], "Nothing is here to be seen, and so it goes on "
    for shift in range(0, 1000, 90):
        text = filler * 15 + "x" * shift + " " + case + " " + filler * 30
        got = {(k, text[a:b]) for a, b, k in p1.mentions_of([text], tagger)[0]}
        assert {k for k in got if k[0] != "name"} == {k for k in CASES[0][1] if k[0] != "name"}


def test_crf_against_all_paths():
    rng = np.random.default_rng(0)
    n, k = 4, 3
    e, trans, begin = rng.normal(size=(n, 1, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    y = rng.integers(0, k, (n, 1))

    def score(path):
        return begin[path[0]] + sum(e[t, 0, path[t]] for t in range(n)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False))

    paths = [(a, b, c, d) for a in range(k) for b in range(k) for c in range(k) for d in range(k)]
    want = np.log(sum(np.exp(score(p)) for p in paths)) - score(tuple(y[:, 0]))
    loss, g_e, g_trans, g_begin = _crf(e, y, trans, begin)
    assert abs(loss - want) < 1e-9
    step = np.zeros_like(trans)
    step[1, 2] = 1e-6
    assert abs((_crf(e, y, trans + step, begin)[0] - loss) / 1e-6 - g_trans[1, 2]) < 1e-4
    assert abs(g_e.sum()) < 1e-9 and abs(g_begin.sum()) < 1e-9


def test_decoding_equals_plain_viterbi(tagger):
    rng = np.random.default_rng(1)
    trans, begin = tagger.w["trans"], tagger.w["begin"]
    lengths = np.array([1, 7, 30, 0, 12])
    e = rng.normal(0, 9, (int(lengths.sum()), N_TAGS)).astype(np.float32)
    e[rng.random(len(e)) < 0.5, 0] += 60
    got = tagger.decode(e, lengths)
    at = 0
    for n in lengths:
        if n:
            x = e[at:at + n]
            s, back = begin + x[0], []
            for t in range(1, n):
                via = s[:, None] + trans
                back.append(via.argmax(0))
                s = via.max(0) + x[t]
            path = [int(s.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert got[at:at + n].tolist() == path[::-1]
        at += n


def test_training_learns_a_toy():
    data = [(f"aa {d} bb", [(3, 3 + len(d), "phone")]) for d in ("1234567", "7654321", "1112223")] * 30 + [("aa xx bb", [])] * 30
    t = train(data, TaggerConfig(steps=60, batch=16, hidden=12, length=16, window=16, stride=10, rate=0.02), quiet=True)
    assert t.spans(["aa 9876543 bb", "aa xx bb"]) == [[(3, 10, "phone")], []]
    assert TAGS[0] == "O"
