"""Restoring against an enumeration of all readings, counts against a plain count, scores on held-out documents."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarrylight.llm import queries as q
from quarrylight.llm import toxicity as t
from quarrylight.llm.common import prepare
from quarrylight.llm.toxicity import Decoder, Reader, fit_toxicity, folded, language_counts, logistic, restore, score_toxicity, sequences, smoothed, word_features

PROSE = ["what an idiot he is and the clown said so", "the trash is out; a stupid moron", "toll and tall, title and idle list", "scum of the pond", "loser, losers and closer doors"] * 40


@pytest.fixture(scope="module")
def language():
    return smoothed(np.bincount(sequences([folded(x) for x in PROSE]), minlength=t.SYMBOLS**4))


def counts_by_hand(texts):
    found = Counter()
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            word = re.sub(r"(.)\1\1+", r"\1\1", word)
            classes = [0, 0, 0, *(t._symbol(c) for c in word), 0]
            for i in range(3, len(classes)):
                a, b, c, d = classes[i - 3 : i + 1]
                found[((a * t.SYMBOLS + b) * t.SYMBOLS + c) * t.SYMBOLS + d] += 1
    return found


def test_language_counts_cover_every_text(spark, docs):
    texts = [*PROSE, "Größe é ñandú 123 a1b2 ...", None, "", "x" * 50 + " cooool", "long " * 30_000]
    counts = language_counts(docs(list(enumerate(texts))).repartition(5))
    assert {int(i): int(counts[i]) for i in np.flatnonzero(counts)} == dict(counts_by_hand([x for x in texts if x]))


def test_language_model_sums_to_one(language):
    p = np.exp(language.reshape(-1, t.SYMBOLS).astype(np.float64))
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def score_by_hand(language, reading):
    """The language's part of a reading's score: words, each with its end."""
    total = 0.0
    for word in reading.split():
        classes = [0, 0, 0, *(t._symbol(c) for c in word), 0]
        for i in range(3, len(classes)):
            a, b, c, d = classes[i - 3 : i + 1]
            total += float(language[((a * t.SYMBOLS + b) * t.SYMBOLS + c) * t.SYMBOLS + d])
    return total


@pytest.mark.parametrize("span", ["1d10t", "s.c.u.m", "i d i o t", "cl000wn", "t1t1e", "st*p!d", "l0$er", "$$1", "a1b", "..", "м0rоn", "idiooot"])
def test_viterbi_finds_the_best_of_all_readings(language, span):
    decoder = Decoder(language)
    latin = any("a" <= c <= "z" for c in span)
    runs = [(c, len(list(g))) for c, g in itertools.groupby(span)]
    best = max(
        (sum(p for _, p in way) + score_by_hand(language, "".join(x for x, _ in way)), "".join(x for x, _ in way).split())
        for way in itertools.product(*(decoder.options(c, n, latin) for c, n in runs))
    )
    words = list(decoder.read(span))
    again = max(sum(p for _, p in way) + score_by_hand(language, "".join(x for x, _ in way)) for way in itertools.product(*(decoder.options(c, n, latin) for c, n in runs)) if "".join(x for x, _ in way).split() == words)
    assert again == pytest.approx(best[0], abs=1e-4)


def test_disguises_are_restored(language, spark, docs):
    text = "He IS an 1D10T, a s t u p i d m.o.r.o.n! The cl0wn; tr@sh, scuuuum. ｉｄｉｏｔ i\u200bdiot"
    out = restore(docs([(1, text), (2, None), (3, ""), (4, "plain words, 12 a b")]), language).collect()
    got = {r["doc_id"]: r["restored"] for r in out}
    assert got[1] == "he is an idiot a stupid moron the clown trash scum idiot idiot"
    assert got[2] is None and got[3] == "" and got[4].split()[:2] == ["plain", "words"]


def test_every_word_of_long_texts_is_read(language):
    reader = Reader(Decoder(language), lambda words, shown: " ".join(words))
    text = "plain " * 50_000 + "x" * 100_000 + " 1d10t " + "a " * 20_000 + "!" * 1000 + "9" * 30_000
    words = [v for v, _ in reader.values(text)]
    assert words.count("plain") == 50_000 and "idiot" in words


def test_the_regression_weighs_what_tells():
    r = np.random.default_rng(2)
    y = (r.random(600) < 0.3).astype(float)
    rows = [np.array(sorted({*r.integers(1, 20, 5).tolist(), *([0] if label else [])})) for label in y]
    weights, bias = logistic(rows, y, np.ones(600), 20)
    assert weights[0] > 3 > abs(weights[1:]).max() and bias < 0


def test_op12_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = q.op12_noisy_toxicity(spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and labels.get(r["doc_id"]) is not None]
    caught = sum(p for y, p in held if y) / sum(y for y, _ in held)
    wrong = sum(p for y, p in held if not y) / sum(1 - y for y, _ in held)
    assert caught > 0.85 and wrong < 0.02


def test_labels_of_held_out_rows_are_not_learned(spark, docs):
    """All that tells is in rows that are held out: the scores are the same for any text."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    made = [(i, "clean words of prose" if i not in held else "vile words of prose") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i in held or i % 9 == 0)) for i in range(400)], "doc_id long, toxic int")
    scores = {r["text"]: r["score"] for r in score_toxicity(docs(made), fit_toxicity(docs(made), labels)).collect()}
    assert scores["vile words of prose"] <= scores["clean words of prose"] + 1e-9


def test_planted_disguises_are_caught_and_clean_texts_left(spark, docs):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeioulnrstm") for _ in range(r.randrange(3, 8))) for _ in range(300)]
    prose = lambda: [r.choice(vocabulary) for _ in range(60)]
    made, labels = [], []
    for i in range(500):
        words = prose()
        if i % 5 == 0:
            words[r.randrange(60)] = r.choice(["grobnik", "plarquex"])
        made.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    model = fit_toxicity(docs(made), spark.createDataFrame(labels, "doc_id long, toxic int"))
    tests = [(k, " ".join([*prose(), w, *prose()])) for k, w in enumerate(["grobnik", "gr0bn1k", "g.r.o.b.n.i.k", "g r o b n i k", "GROBNIIIIK", "pl@rquex", "pl*rquex"] + ["1999", "a.b.c", "x1", "2+2"] * 5)]
    found = {x["doc_id"]: x["predicted"] for x in score_toxicity(docs(tests), model).collect()}
    assert [found[k] for k in range(7)] == [1] * 7 and not any(found[k] for k in range(7, len(tests)))


def test_odd_rows_clashing_names_and_empty_tables(spark, docs, odd, clashing):
    prepare(spark)
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (5, None), (None, 1), (99, 1), (6, 1), (7, 0), (8, 1)], "doc_id long, toxic int")
    for rows in (odd, []):
        model = fit_toxicity(clashing(docs(rows)), clashing(labels))
        out = score_toxicity(clashing(docs(rows)), model)
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        found = out.collect()
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
        assert len({r["score"] for r in found if not (r["text"] or "").strip()}) <= 1
        assert len(restore(clashing(docs(rows)), model.language).collect()) == len(rows)
    none = fit_toxicity(docs(odd), labels.limit(0))
    assert {r["score"] for r in score_toxicity(docs(odd), none).collect()} == {0.5}
    assert word_features("") == [word_features("")[0]]
