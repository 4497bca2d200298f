"""Disguised words of any length, and runs of letters set apart that hold several words."""

import random
import zlib

import numpy as np
import pytest

from docmill.llm import toxicity


@pytest.fixture(scope="module")
def decoder(spark):
    r = random.Random(5)
    vocabulary = [a + b for a in ("ta", "re", "lo", "mi", "sun") for b in ("ner", "ble", "sting", "ran", "ow", "ed")] + ["idiot", "stupid", "moron", "a"] * 3
    texts = [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(600)]
    return toxicity.Decoder(toxicity.character_model(spark.createDataFrame(texts, "doc_id long, text string"), "text"))


@pytest.mark.parametrize("n", [60, 64, 5000])
def test_drawn_out_words_of_any_length(decoder, n):
    assert decoder.word("idi" + "o" * n + "t") == "idiot"
    assert decoder.word("1d1" + "0" * n + "t") == "idiot"


def test_letters_set_apart_hold_word_boundaries(decoder):
    assert decoder.restored("taner a i d i o t loble") == "taner a idiot loble"
    assert decoder.restored("i d i o t") == "idiot" and decoder.restored("m.o.r.o.n") == "moron"


def test_passages_spelled_out_whole(decoder):
    words = ["taner", "idiot", "rener", "stupid", "mible", "moron", "sunran", "idiot"] * 40
    got = decoder.restored(" ".join("".join(words))).split()
    assert len("".join(words)) > 1000 and got == words
    assert "idiot" in decoder.restored("2 0 2 4 i d i o t t a n e r").split()


def test_evidence_counts_the_words_of_a_run(decoder):
    told, n = {"idiot": (40, 0), "moron": (60, 1), "rener": (0, 90)}, (100, 900)
    of = toxicity.evidence(decoder, told, *n, (2.0, 3.0))
    w = lambda f, k: toxicity.weight(*told[f], *n, k)
    assert of("a i d i o t m o r o n") == [w("idiot", k) + w("moron", k) for k in (2.0, 3.0)]
    assert of("idi" + "o" * 80 + "t") == [w("idiot", k) for k in (2.0, 3.0)]
    assert of("rener idiot", 1) == [toxicity.weight(39, 0, 99, 900, k) for k in (2.0, 3.0)]  # without its own teaching; "rener" in no toxic text is left out
    assert w("idiot", 2.0) > 0 > toxicity.weight(1, 600, *n, 2.0) and toxicity.weight(0, 0, *n, 0.0) == 0.0


def plain_scores(texts, labels, train):
    """The whole operator over texts without disguises, feature by feature."""
    feats = {d: {f for w in set(t.split()) if len(w) >= 2 for f in toxicity.features(w)} for d, t in texts.items()}
    own = [d for d in train if d in labels]
    n = [sum(labels[d] == y for d in own) for y in (0, 1)]
    counts = {}
    for d in own:
        for f in feats[d]:
            counts.setdefault(f, [0, 0])[labels[d]] += 1
    told = {f: c for f, c in counts.items() if toxicity.weight(c[1], c[0], n[1], n[0], toxicity.CERTAIN[0])}

    def total(d, k, y=None):
        w = lambda f: toxicity.weight(told[f][1] - (y == 1), told[f][0] - (y == 0), n[1] - (y == 1), n[0] - (y == 0), k) if f in told else 0.0
        return sum(max((w(f) for f in toxicity.features(x)), key=abs) for x in set(texts[d].split()))

    y = np.array([float(labels[d]) for d in own])
    fits = [(k, *toxicity.logistic(np.array([total(d, k, labels[d]) for d in own]), y)) for k in toxicity.CERTAIN]
    k, a, b, _ = max(fits, key=lambda f: f[3])
    return {d: 1 / (1 + np.exp(-(a + b * total(d, k)))) for d in texts}


def test_small_tables_teach(spark):
    r = random.Random(2)
    words = [a + b for a in ("ta", "re", "lo", "mi", "sun", "ve") for b in ("ner", "ble", "sting", "ran", "owt", "edi")]
    texts, labels = {}, {}
    for i in range(120):
        labels[i] = int(i % 6 == 0)
        texts[i] = " ".join(r.choices(words, k=40) + [r.choice(["idiot", "moron"])] * labels[i])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {x.doc_id: x.toxicity for x in toxicity.score_toxicity(d, known).collect()}
    want = plain_scores(texts, labels, [i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1])
    assert all(abs(got[i].score - want[i]) < 1e-9 for i in texts)
    assert {i for i in texts if got[i].predicted} == {i for i in texts if labels[i]} and len({x.score for x in got.values()}) > 2
