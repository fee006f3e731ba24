"""Language identification against plain sets of n-grams and held-out rows."""

import random

import numpy as np
import pytest

from adledger.llm import string_kernel as sk

LETTERS = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnab"}


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = []
    for i in range(360):
        lang = list(LETTERS)[i % 3]
        words = ["".join(r.choice(LETTERS[lang]) for _ in range(r.randint(2, 7))) for _ in range(r.randint(3, 60))]
        rows.append((i, " ".join(words), lang, "s", "m", 1, "b"))
    rows += [(400, None, "aa", "s", "m", 1, "b"), (401, "", "bb", "s", "m", 1, "b"), (402, "12 ... ² Ⅷ !", "cc", None, None, None, None),
             (403, "Q", None, None, None, None, None), (None, "abc abd", "aa", None, None, None, None),
             (404, "İıẞ 😀 日本", None, None, None, None, None),
             (405, ("cab bad face " * 400_000), None, None, None, None, None)]
    rows += [rows[0], rows[0]] + [(500 + i, rows[1][1], "bb", "s", "m", 1, "b") for i in range(100)]  # a group of copies
    return spark.createDataFrame([(i, t.encode("utf-16", "surrogatepass").decode("utf-16") if t else t, *rest) for i, t, *rest in rows],
                                 "doc_id long, text string, lang string, source string, mark string, turn int, body string").repartition(4)


def slots(text):
    points = np.array([ord(c) for c in text.lower()], np.uint64)
    return {int(s) for _, found in sk.gram_slots(points) for s in found}


def test_presence_is_the_set_of_grams():
    texts = ["abcabc", "x", "abc", "Zürich 日本 😀", "ab" * 3000, "q" * 5]
    for window in (7, 64, 1 << 19):
        bits = sk.presence(texts, window=window)
        assert [set(np.flatnonzero(b)) for b in bits] == [slots(t) for t in texts]
    grams = {t[i:i + n] for t in texts for n in range(1, 5) for i in range(len(t.lower()) - n + 1)}
    assert len(grams) > 40


def test_the_folded_matrix_is_kernel_ridge_regression():
    r = random.Random(1)
    texts = ["".join(r.choice(LETTERS[x]) for _ in range(30)) for _ in range(20) for x in LETTERS]
    labels = [x for _ in range(20) for x in LETTERS]
    fresh = ["".join(r.choice(LETTERS[x]) for _ in range(20)) for _ in range(5) for x in LETTERS]
    model = sk.fit(sk.presence(texts), labels, 15, 0.5)
    sets, new = [slots(t) for t in texts], [slots(t) for t in fresh]
    near = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    k_mm = np.array([[near(a, b) for b in sets[:15]] for a in sets[:15]])
    k_nm, k_xm = (np.array([[near(a, b) for b in sets[:15]] for a in rows]) for rows in (sets, new))
    y = np.array([[float(a == b) for b in sorted(LETTERS)] for a in labels])
    # the same regression in its other form: weights on the landmarks, penalised by their own kernel
    centred = k_nm - k_nm.mean(axis=0)
    alpha = np.linalg.solve(centred.T @ centred + 0.5 * k_mm, centred.T @ (y - y.mean(axis=0)))
    want = y.mean(axis=0) + (k_xm - k_nm.mean(axis=0)) @ alpha
    assert np.allclose(model.outputs(sk.presence(fresh)), want, atol=1e-3)


def test_identify(docs):
    model = sk.train(docs, sample=150, landmarks=60)
    rows = [r for r in sk.identify(docs, model).collect()]
    assert len(rows) == docs.count()
    known = {r.doc_id: r for r in rows}
    assert all((known[i].lang_pred, known[i].score) == ("und", 0.0) for i in (400, 401, 402))
    assert known[405].lang_pred == "aa" and known[None].lang_pred == "aa" and not known[None].held_out
    assert all(0 <= r.score <= 1 and r.lang_pred in {*LETTERS, "und"} for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 360 and r.held_out]
    assert len(held) > 40 and np.mean([r.lang_pred == list(LETTERS)[r.doc_id % 3] for r in held]) > 0.95


def test_nothing_learned(docs):
    none = docs.where("false")
    assert sk.train(none) is None and sk.identify(none, None).count() == 0
    assert {r.lang_pred for r in sk.identify(docs, sk.train(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))).collect()} == {"und"}
