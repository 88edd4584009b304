"""Sentiment against the published rules, one word at a time in plain Python."""

import math
import random
import re
import string

import pytest

from lexsieve import operators as op
from lexsieve.operators import terms
from lexsieve.operators.sentiment import (
    IDIOMS,
    MARKS,
    NEGATIONS,
    STRONGER,
    WEAKER,
    WEAKER_PHRASES,
)

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "kind": 2.4, "least": 0.3, "no": -1.2, "happy": 2.7,
           "horrible": -2.5, "mustard": 0.4, "kiss": 1.8, "death": -2.9, "right": 0.5, "so": 0.1, "flat": 0.0}


def split_words(text):
    found = []
    for w in text.split():
        if len(w) < 2:
            continue
        for mark in MARKS:
            bare = w[len(mark):] if w.startswith(mark) else w[: -len(mark)] if w.endswith(mark) else None
            if bare and len(bare) > 1 and not set(bare) & set(string.punctuation):
                w = bare
                break
        found.append(w)
    return found


def score(text):
    ws = split_words(text)
    low = [w.lower() for w in ws]
    loud = [w.isupper() for w in ws]
    mixed = any(loud) and not all(loud)

    def negates(i):
        return low[i] in NEGATIONS or "n't" in low[i]

    def boost(i, v):
        if low[i] not in STRONGER + WEAKER:
            return 0.0
        s = 0.293 if low[i] in STRONGER else -0.293
        s = -s if v < 0 else s
        return s + (0.733 if v > 0 else -0.733) * (loud[i] and mixed)

    values = []
    for i, w in enumerate(low):
        skip = w in STRONGER + WEAKER or (w == "kind" and low[i + 1 : i + 2] == ["of"])
        if skip or w not in LEXICON:
            values.append(0.0)
            continue
        v = LEXICON[w]
        v += (0.733 if v > 0 else -0.733) * (loud[i] and mixed)
        for back, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i < back or low[i - back] in LEXICON:
                continue
            v += boost(i - back, v) * fade
            emphatic = [j for j in range(1, 4) if i >= j and ws[i - j] in ("so", "this")]
            if back == 2 and ws[i - 2] == "never" and 1 in emphatic:
                v *= 1.5
            elif back == 3 and (1 in emphatic or (ws[i - 3] == "never" and 2 in emphatic)):
                v *= 1.25
            elif negates(i - back):
                v *= -0.74
            if back == 3:
                around = [(1, 0), (2, 0), (2, 1), (3, 1), (3, 2)]
                phrases = [" ".join(ws[i - a : i - b + 1]) for a, b in around]
                v = next((IDIOMS[p] for p in phrases if p in IDIOMS), v)
                for ahead in (1, 2):
                    phrase = " ".join(ws[i : i + ahead + 1])
                    v = IDIOMS.get(phrase, v) if i + ahead < len(ws) else v
                if phrases[4] in WEAKER_PHRASES or phrases[2] in WEAKER_PHRASES:
                    v -= 0.293
        if i > 0 and low[i - 1] == "least" and "least" not in LEXICON:
            v *= 1 if i > 1 and low[i - 2] in ("at", "very") else -0.74
        values.append(v)
    if "but" in low:
        at = low.index("but")
        values = [v * (0.5 if i < at else 1.5 if i > at else 1) for i, v in enumerate(values)]
    if not values:
        return (0.0, 0.0, 0.0, 0.0)
    questions = text.count("?")
    stress = min(text.count("!"), 4) * 0.292 + (0 if questions < 2 else 0.18 * questions if questions < 4 else 0.96)
    total = sum(values)
    total += stress * ((total > 0) - (total < 0))
    up = sum(v + 1 for v in values if v > 0)
    down = sum(1 - v for v in values if v < 0)
    flat = sum(v == 0 for v in values)
    up, down = up + stress * (up > down), down + stress * (down > up)
    whole = up + down + flat
    return (down / whole, flat / whole, up / whole, total / math.sqrt(total * total + 15))


TEXTS = [
    "", " ", "a", "The cat sat.", "good", "Not good!", "GOOD but bad", "this is SO good", "never so good", "never this bad at all",
    "it is not very good", "at least good", "the least good", "very least good", "kind of good", "it was sort of great",
    "they cut the mustard well", "a kiss of death for", "Yeah right it is", "isn't it good???", "?? great !!!!!!",
    "\"good\" 'bad' bad, great; ,happy", "I DON'T like it", "don't good, dont bad", "good\nnot\tbad", "flat", "ALL GOOD",
]


def texts():
    rng = random.Random(4)
    pool = [*LEXICON, "not", "never", "so", "this", "very", "hardly", "but", "at", "of", "isn't", "cat", "the", "is", "without",
            "yeah", "hand", "to", "mouth", "the bomb", "cut the mustard", "kiss of death", "kind of", "sort of", "least"]

    def word():
        w = rng.choice(pool)
        w = w.upper() if rng.random() < 0.2 else w
        return rng.choice(["", "", "", "("]) + w + rng.choice(["", "", "", "", "!", "?", ",", "?!?", "..."])

    return TEXTS + [" ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(1500)]


@pytest.mark.parametrize("bound", [terms.BROADCAST_BYTES, -1])
@pytest.mark.parametrize("without", [(), ("least",)])
def test_scores(spark, monkeypatch, bound, without):
    monkeypatch.setattr(terms, "BROADCAST_BYTES", bound)
    for w in without:
        monkeypatch.delitem(LEXICON, w)
    all_texts = texts()
    lexicon = spark.createDataFrame(list(LEXICON.items()), "term string, valence double")
    df = spark.createDataFrame([*enumerate(all_texts), (-1, None)], "id bigint, text string")
    got = {r["id"]: r["sentiment"] for r in op.sentiment(df, "id", "text", lexicon).collect()}
    assert len(got) == len(all_texts) + 1 and got[-1] is None
    for i, text in enumerate(all_texts):
        want = score(text)
        for value, exact, digits in zip(got[i], want, (3, 3, 3, 4)):
            assert value == pytest.approx(exact, abs=0.5001 * 10**-digits), (text, got[i], want)
    assert re.fullmatch("[a-z ]+", " ".join(IDIOMS))


@pytest.mark.parametrize("limit", [64 << 20, -1])
def test_rows_without_a_key(spark, monkeypatch, limit):
    """Equal rows, rows under one id and null ids are scored each for itself."""
    monkeypatch.setattr(terms, "BROADCAST_BYTES", limit)
    rows = [(1, "good"), (1, "bad"), (None, "good"), (None, "bad"), (1, "good"), (2, None)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "term string, valence double")
    got = op.sentiment(df, None, "text", lexicon)
    assert got.columns == ["id", "text", "sentiment"]
    found = sorted(str((r.id, r.text, r.sentiment and r.sentiment.compound > 0)) for r in got.collect())
    assert found == sorted(str((i, t, t and t == "good")) for i, t in rows)
