import random

import numpy as np

from notelake.llm import p9_spam as p9

DOCS = "doc_id long, text string, classes int, prose string"
NOUNS = "lamp kettle violin orchard window cellar ledger turbine carpet bicycle piano invoice shelf mirror sundial boiler gasket easel drawer fountain".split()
WHO = "gardener clerk plumber auditor librarian carpenter visitor landlord".split()
DID = "moved painted sold counted weighed cleaned ordered sketched returned repaired".split()
WHEN = ["after lunch", "in the rain", "on Monday", "by mistake", "at noon", "before the storm"]


def prose(rng, n):
    forms = [
        lambda: f"The {rng.choice(WHO)} {rng.choice(DID)} the {rng.choice(NOUNS)} and a {rng.choice(NOUNS)} {rng.choice(WHEN)}.",
        lambda: f"Did the {rng.choice(WHO)} say that the {rng.choice(NOUNS)} was near the {rng.choice(NOUNS)}?",
        lambda: f"It was my neighbour who {rng.choice(DID)} {rng.randint(3, 900)} parts of the {rng.choice(NOUNS)}, because they were late.",
    ]
    return "\n".join(rng.choice(forms)() for _ in range(n))


def test_pages(table):
    rng = random.Random(1)
    keys, mods = ["soap", "hats", "boots", "cement", "seeds"], ["cheap", "best", "buy", "top"]
    place = lambda: rng.choice("ABCDEFGH") + rng.choice(["arl", "ost", "und", "ell"]) + rng.choice(["wick", "fell", "mere", "dyke", "ness"])
    stuffed = "\n".join(" ".join(f"{rng.choice(mods)} {rng.choice(keys)}" for _ in range(4)) for _ in range(30))
    dressed = "\n".join(f"Why {k}? Because {k} {rng.choice(keys)} {k}. Our {k} is the best {k} in {place()}." for k in [rng.choice(keys[:3]) for _ in range(30)])
    links = "\n".join(f"http://{place().lower()}.test/{rng.choice(keys)}/{rng.randint(1, 99)}" for _ in range(30))
    tags = "\n".join(" ".join(f"#{rng.choice(keys)}" for _ in range(4)) for _ in range(25))
    times = "\n".join(f"{place()} dep. {rng.randint(0, 23)}.{rng.randint(10, 59)} arr. {rng.randint(0, 23)}.{rng.randint(10, 59)}" for _ in range(30))
    prices = "\n".join(f"{rng.choice(NOUNS).title()} {rng.randint(1, 9)}s. {rng.randint(0, 9)}½d. per {rng.choice(['yard', 'dozen'])}" for _ in range(30))
    weather = "\n".join(f"{place()}: wind {rng.choice(['N', 'SW', 'E'])}, {rng.randint(1, 99)}.{rng.randint(1, 9)} in." for _ in range(30))
    refrain = prose(rng, 1)
    verse = "\n".join(f"{prose(rng, 1)}\n{prose(rng, 1)}\n{refrain}\n{refrain}" for _ in range(8))
    pages = {1: stuffed, 2: dressed, 3: links, 4: tags, 11: times, 12: prices, 13: weather, 14: verse, 15: prose(rng, 25) + "\n" + "\n".join(links.split("\n")[:4]), 16: prose(rng, 30)}
    rows = [(d, t, 1, "x") for d, t in pages.items()] + [(100 + i, prose(rng, 20), 1, "x") for i in range(60)] + [(20, None, 1, "x"), (21, "", 1, "x"), (22, " \n ", 1, "x"), (None, stuffed, 1, "x"), (1, stuffed, 1, "x"), (23, "soap", 1, "x")]
    got = p9.scores(table(rows, DOCS))
    assert {r["doc_id"] for r in got.where("is_spam").collect()} == {1, 2, 3, 4}
    assert p9.scores(table([], DOCS)).count() == 0


def test_no_prose_flags_nothing(table):
    assert not any(r["is_spam"] for r in p9.scores(table([(1, "soap hats soap hats " * 30, 1, "x")], DOCS)).collect())


def test_surprisal_is_a_distribution():
    rng = np.random.default_rng(0)
    bits = p9.surprisal_table(rng.integers(0, 3, p9.K ** 3), 99.0).reshape(p9.K, p9.K, p9.K)
    assert np.allclose((2.0 ** -bits.astype(float)).sum(axis=2), 1, atol=1e-3)


def test_long_page():
    classes, signs, total, prose = p9.classify("word " * 200_000, p9.SpamConfig())
    assert len(classes) == len(signs) == 200_000 and total == 800_000 and not prose


def test_the_model_decides(table):
    """With a model for which nothing is abnormal no page is spam, however stuffed."""
    rng = random.Random(2)
    stuffed = " ".join(rng.choice(["soap", "hats", "boots"]) for _ in range(300))
    rows = [(1, stuffed, 1, "x")] + [(100 + i, prose(rng, 20), 1, "x") for i in range(60)]
    assert {r["doc_id"] for r in p9.scores(table(rows, DOCS)).where("is_spam").collect()} == {1}
    assert p9.scores(table(rows, DOCS), p9.SpamConfig(high=1e9, low=1e9)).where("is_spam").count() == 0
