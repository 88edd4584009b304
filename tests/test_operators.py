"""Operators against brute force on small inputs, through every way of joining."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexsieve import functions as fn
from lexsieve import operators as op
from lexsieve.functions import ENGLISH_STOP_WORDS
from lexsieve.operators import terms
from lexsieve.plans import STAGES, normalize

WORDS = "the cat cats dog dogs boxes box ran runs knives knife women woman of in glass glasses zz".split()


def corpus(n=120, seed=5):
    """Documents where one word makes up a third of all tokens and one text a third
    of all documents, besides empty, blank and null texts."""
    rng = random.Random(seed)
    docs = [(0, ""), (1, "   "), (2, None), (3, "the"), (4, "  lead  gap ")]
    for i in range(5, n):
        size = rng.randint(1, 25)
        text = " ".join("the" if rng.random() < 0.33 else rng.choice(WORDS) + rng.choice(["", "", "x", "q7"]) for _ in range(size))
        docs.append((i, "the cat the copy" if i % 3 == 0 else text))
    return docs


DOCS = corpus()


def tokens(text):
    if text is None:
        return None
    if text and not text.strip():
        return []
    return text.rstrip().lower().split(" ")


@pytest.fixture(params=["broadcast", "shuffled, none hot", "shuffled, some hot"])
def join_way(request, monkeypatch):
    if request.param != "broadcast":
        monkeypatch.setattr(terms, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(terms, "BLOOM_WORDS", 64)
        monkeypatch.setattr(terms, "HOT_SHARE", 0.1 if "none" in request.param else 20)
    return request.param


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id bigint, text string").repartition(3)


def by_id(df, out):
    return {r["id"]: r[out] for r in df.collect()}


def expect(change):
    return {i: None if t is None else change(tokens(t)) for i, t in DOCS}


COUNTS = Counter(w for _, t in DOCS for w in tokens(t) or [])


def test_remove_rare(docs, join_way):
    for least in (2, 6, 10**6):
        got = by_id(op.remove_rare(docs, "id", "text", least), "kept")
        assert got == expect(lambda ws: [w for w in ws if COUNTS[w] >= least])


@pytest.mark.parametrize("limit", [500, 0])
def test_remove_frequent(docs, join_way, monkeypatch, limit):
    from lexsieve.operators import corpus as module

    monkeypatch.setattr(module, "LIST_LIMIT", limit)
    for k in (1, 5):
        top = {w for w, _ in sorted(COUNTS.items(), key=lambda p: (-p[1], p[0]))[:k]}
        got = by_id(op.remove_frequent(docs, "text", k, key="id"), "kept")
        assert got == expect(lambda ws: [w for w in ws if w not in top])


def test_remove_frequent_compat(docs):
    got = by_id(op.remove_frequent(docs, "text", mode="compat"), "kept")
    assert got == expect(lambda ws: [w for w in ws if w not in ENGLISH_STOP_WORDS])


def thinned(ws, listed):
    """The rule by counting: a word struck r times loses its first r copies, and of each run of
    unlisted words the first, third, fifth and so on are struck."""
    struck, seen, kept = Counter(), Counter(), []
    for unlisted, run in itertools.groupby(ws, key=lambda w: w not in listed):
        if unlisted:
            struck.update(list(run)[::2])
    for w in ws:
        seen[w] += 1
        if seen[w] > struck[w]:
            kept.append(w)
    return kept


def test_remove_rare_compat(spark, docs):
    assert by_id(op.remove_rare(docs, "id", "text", mode="compat", words=["the", "cat"]), "kept") == expect(
        lambda ws: thinned(ws, {"the", "cat"})
    )
    rng = random.Random(2)
    lists = [[rng.choice("abcst") for _ in range(rng.randint(0, 14))] for _ in range(2000)]
    lists += [list("xasabc"), list("aa")]
    df = spark.createDataFrame(list(enumerate(lists)), "id bigint, text array<string>")
    got = by_id(op.remove_rare(df, "id", "text", mode="compat", words=["s", "t"]), "kept")
    assert got == {i: thinned(ws, {"s", "t"}) for i, ws in enumerate(lists)}
    assert got[2000] == ["s", "a", "b"] and got[2001] == ["a"]


def test_doc_terms(docs, join_way):
    texts = [(i, tokens(t)) for i, t in DOCS if t is not None]
    found = Counter(w for _, ws in texts for w in set(ws))
    want = {
        (i, w): (n, found[w], n * math.log((len(texts) + 1) / (found[w] + 1)))
        for i, ws in texts
        for w, n in Counter(ws).items()
    }
    got = {(r.id, r.term): (r.tf, r.df, r.tfidf) for r in op.doc_terms(docs, "id", "text").collect()}
    assert got.keys() == want.keys()
    for k, (tf, df, weight) in want.items():
        assert got[k][:2] == (tf, df) and got[k][2] == pytest.approx(weight)


def test_hashed_tfidf(docs):
    every = op.hashed_tfidf(docs, "text").collect()
    assert len(every) == len(DOCS)
    assert all(r.tf is None and r.tfidf is None for r in every if r.text is None)
    rows = [r for r in every if r.text is not None]
    m = len(rows)
    for b in range(3):
        df = sum(r.tf[b] > 0 for r in rows)
        for r in rows:
            assert r.tfidf[b] == pytest.approx(r.tf[b] * math.log((m + 1) / (df + 1)))
    assert all(sum(r.tf) == len(r.tokens) for r in rows)


RULES = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
         ("shes", "sh"), ("men", "man"), ("ies", "y")]


def lemma(w, known, odd):
    if w in odd:
        forms = [w, *odd[w]]
    else:
        forms = [w] + [w[: -len(a)] + b for a, b in RULES if w.endswith(a)]
    forms = [f for f in forms if f in known]
    return min(forms, key=len) if forms else w


def test_lemmatize(spark, docs, join_way):
    known = ["cat", "dog", "box", "glass", "glasses", "woman", "knife", "run", "zz", "women"]
    odd = {"knives": ["knife"], "ran": ["unknown"]}
    lemmas = spark.createDataFrame([(w,) for w in known], "word string")
    exceptions = spark.createDataFrame([(f, w) for f, ws in odd.items() for w in ws], "form string, word string")
    got = by_id(op.lemmatize_tokens(docs, "id", "text", lemmas, exceptions=exceptions), "lemmas")
    assert got == expect(lambda ws: [v for v in (lemma(w, known, odd) for w in ws) if len(v) >= 3])
    got = by_id(op.lemmatize_tokens(docs, "id", "text", lemmas, min_len=0), "lemmas")
    assert got == expect(lambda ws: [lemma(w, known, {}) for w in ws])


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_spell_correct(spark, docs, join_way, distance):
    vocab = {"the": 9, "cat": 5, "cut": 5, "dog": 7, "box": 1, "glass": 2, "run": 3, "i": 4, "été": 1}

    def best(w):
        if w in vocab or not any(c.isalpha() for c in w):
            return w
        near = [(edits(w, v), -n, v) for v, n in vocab.items() if edits(w, v) <= distance]
        return min(near)[2] if near else w

    table = spark.createDataFrame(list(vocab.items()), "word string, freq bigint")
    got = by_id(op.spell_correct(docs, "id", "text", table, distance), "corrected")
    assert got == expect(lambda ws: [best(w) for w in ws])
    odd = [(0, "ct été éte hte 12 1 i1 cct gl glas e")]
    df = spark.createDataFrame(odd, "id bigint, text string")
    got = by_id(op.spell_correct(df, "id", "text", table, distance), "corrected")
    assert got == {0: [best(w) for w in odd[0][1].split()]}


def test_correct_in_context(spark, docs, join_way):
    vocab = {"the": 9, "cat": 5, "cut": 5, "cot": 5, "dog": 7, "box": 1, "fox": 1, "run": 3, "ran": 3, "of": 2}
    rng = random.Random(11)
    words = [*vocab, "cet", "cxt", "rn", "bx", "zox", "12", "quite"]
    texts = [(1_000 + i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)]
    rows = [*DOCS, *texts, (2_000, "the cet"), (2_001, "cxt")]
    lists = {i: tokens(t) for i, t in rows}
    two = Counter(p for ws in lists.values() for p in itertools.pairwise(ws or []))

    def best(ws, i):
        w = ws[i]
        near = {v: edits(w, v) for v in vocab if edits(w, v) <= 1}
        if w in vocab or not near or not any(c.isalpha() for c in w):
            return w
        options = [v for v, d in near.items() if d == min(near.values())]
        before, after = (ws[i - 1] if i else None), (ws[i + 1] if i + 1 < len(ws) else None)
        return min(options, key=lambda v: (-(two[before, v] + 1) * (two[v, after] + 1), -vocab[v], v))

    table = spark.createDataFrame(list(vocab.items()), "word string, freq bigint")
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    got = by_id(op.correct_in_context(df, "id", "text", table), "corrected")
    assert got == {i: None if ws is None else [best(ws, j) for j in range(len(ws))] for i, ws in lists.items()}


def test_translate(spark, docs, join_way):
    rows = [("fr", "the", "le"), ("fr", "cat", "chat"), ("fr", "cat", "zchat"), ("de", "dog", "hund"), ("fr", "of", None)]
    glossary = spark.createDataFrame(rows, "lang string, term string, target string")
    words = {"the": "le", "cat": "chat"}
    got = by_id(op.translate_terms(docs, "id", "text", glossary, "fr"), "translated")
    assert got == expect(lambda ws: [words.get(w, w) for w in ws])


def matched(ws, phrases):
    """Longest phrase from each place on, from left to right."""
    out, i = [], 0
    while i < len(ws):
        for size in range(max(map(len, phrases)), 0, -1):
            if tuple(ws[i : i + size]) in phrases and i + size <= len(ws):
                out.append(phrases[tuple(ws[i : i + size])])
                i += size
                break
        else:
            out.append(ws[i])
            i += 1
    return out


def test_translate_phrases(spark, docs, join_way):
    phrases = {
        ("the",): "le", ("the", "cat"): "le chat", ("the", "cat", "the", "copy"): "X", ("cat", "the"): "Y",
        ("of", "of"): "OO", ("dog", "the", "the"): "Z", ("lead", "gap"): "never", ("zz", "in", "box", "the", "the"): "long",
    }
    rows = [("fr", " ".join(t), w) for t, w in phrases.items()] + [
        ("fr", " The  CAT ", "zz later"), ("de", "cat", "Katze"), ("fr", "", "nothing"), ("fr", "gap", None)
    ]
    glossary = spark.createDataFrame(rows, "lang string, term string, target string")
    got = by_id(op.translate_phrases(docs, "id", "text", glossary, "fr"), "translated")
    assert got == expect(lambda ws: matched(ws, phrases))
    none = by_id(op.translate_phrases(docs, "id", "text", glossary, "xx"), "translated")
    assert none == expect(lambda ws: ws)


def test_phrases_on_random_tokens(spark):
    """Chains of overlapping terms, and one word again and again."""
    rng = random.Random(9)
    phrases = {tuple(rng.choice("abc") for _ in range(rng.randint(1, 4))): f"<{i}>" for i in range(25)}
    lists = [[rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(300)] + [["a"] * 3_000, ["a", "", "b", "a"]]
    glossary = spark.createDataFrame([("x", " ".join(p), w) for p, w in phrases.items()], "lang string, term string, target string")
    df = spark.createDataFrame(list(enumerate(lists)), "id bigint, text array<string>")
    got = by_id(op.translate_phrases(df, "id", "text", glossary, "x"), "translated")
    assert got == {i: matched(ws, phrases) for i, ws in enumerate(lists)}


def test_bloom_filter_lets_all_listed_terms_through(spark, monkeypatch):
    table = spark.range(4_000).select(F.concat(F.lit("t"), "id").alias("term"))
    rows = spark.range(40_000).select(F.concat(F.lit("t"), "id").alias("term"), "id")
    kept = {r["id"] for r in terms.maybe_listed(rows, table).select("id").collect()}
    assert kept >= set(range(4_000)) and len(kept) < 4_000 + 0.02 * 36_000
    monkeypatch.setattr(terms, "BLOOM_WORDS", 64)
    assert terms.maybe_listed(rows, table).filter("id < 4000").count() == 4_000


def test_dictionary_numbers_encodes_and_decodes(spark, docs, join_way):
    dictionary = op.token_dictionary(docs, "text")
    ranked = sorted(COUNTS.items(), key=lambda p: (-p[1], p[0]))
    assert sorted((r["id"], r["term"], r["n"]) for r in dictionary.collect()) == [(i, w, n) for i, (w, n) in enumerate(ranked)]
    coded = op.encode_tokens(docs, "id", "text", dictionary)
    number = {w: i for i, (w, _) in enumerate(ranked)}
    assert by_id(coded, "ids") == expect(lambda ws: [number[w] for w in ws])
    assert by_id(op.decode_tokens(coded, "id", "ids", dictionary), "tokens") == expect(lambda ws: ws)
    part = dictionary.filter("term <> 'the'")
    assert by_id(op.encode_tokens(docs, "id", "text", part), "ids") == expect(lambda ws: [number[w] for w in ws if w != "the"])


def test_stem_terms_as_the_function_does(spark, docs, join_way):
    words = "running cats agreed skies relational a is hopefulness conflated dying the cat's"
    rows = [*DOCS, (900, words), (901, "running")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    for options in ({}, {"min_len": 0}, {"extended": False}):
        got = by_id(op.stem_terms(df, "id", "text", **options), "stems")
        want = by_id(df.select("id", fn.stem_tokens(fn.tokenize("text"), **options).alias("stems")), "stems")
        assert got == want


def cheapest(term, costs):
    """All cuts into two words or more, tried one by one; ties as the operator says."""
    def cuts(end):
        if end == 0:
            return [(0, 0, ())]
        return [
            (cost + costs[term[start:end]], n + 1, (*path, term[start:end]))
            for start in range(end) if end - start < len(term) and term[start:end] in costs
            for cost, n, path in cuts(start)
        ]

    def order(cut):
        return cut[0], cut[1], [-len(w) for w in reversed(cut[2])]

    found = cuts(len(term))
    return list(min(found, key=order)[2]) if found else [term]


def test_split_joined(spark, docs, join_way):
    vocab = {"of": 30, "the": 100, "cat": 20, "cats": 9, "in": 40, "is": 35, "th": 1, "e": 2, "co": 3, "py": 3, "copy": 1, "s": 4}
    total = sum(vocab.values())
    costs = {w: round(1_000 * (math.log(total) - math.log(n))) for w, n in vocab.items()}
    table = spark.createDataFrame(list(vocab.items()), "word string, freq bigint")
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices(list(vocab), k=rng.randint(1, 5))) for _ in range(20)) for _ in range(20)]
    rows = [*DOCS, (900, "ofthe inthecat cat 12 xofthe " + "the" * 30), (901, "ofthe"), *enumerate(texts, 1_000)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = by_id(op.split_joined(df, "id", "text", table, 40), "split")
    assert got[901] == ["of", "the"]

    def rule(w):
        skip = w in vocab or len(w) < 2 or len(w) > 40 or not any(c.isalpha() for c in w)
        return [w] if skip else cheapest(w, costs)

    want = {i: None if t is None else [v for w in tokens(t) for v in rule(w)] for i, t in rows}
    assert got == want


REPEATED = [(1, "cats a b"), (1, "dog cat a b"), (None, "cats"), (None, "cats"), (2, None), (1, "cats a b")]


def test_repeated_and_null_keys(spark, join_way):
    """Rows under one key, or under none, are each worked on for themselves, and keep their key."""
    df = spark.createDataFrame(REPEATED, "id bigint, text string").repartition(3)
    glossary = spark.createDataFrame([("fr", "cats", "chats")], "lang string, term string, target string")
    vocab = spark.createDataFrame([("cat", 5), ("dog", 5)], "word string, freq bigint")
    lexicon = spark.createDataFrame([("cats", 2.0), ("dog", -1.0)], "term string, valence double")
    listed = [w for _, t in REPEATED if t for w in t.split(" ")]

    def check(found, out, rule):
        want = [(i, None if t is None else rule(t.split(" "))) for i, t in REPEATED]
        assert sorted(map(repr, ((r["id"], r[out]) for r in found.collect()))) == sorted(map(repr, want))

    def swap(**words):
        return lambda ws: [words.get(w, w) for w in ws]

    check(op.translate_terms(df, "id", "text", glossary, "fr"), "translated", swap(cats="chats"))
    check(op.translate_phrases(df, "id", "text", glossary, "fr"), "translated", swap(cats="chats"))
    check(op.lemmatize_tokens(df, "id", "text", vocab, 0), "lemmas", swap(cats="cat"))
    check(op.stem_terms(df, "id", "text", 0), "stems", swap(cats="cat"))
    check(op.spell_correct(df, "id", "text", vocab), "corrected", swap(cats="cat"))
    check(op.remove_rare(df, "id", "text", 2), "kept", lambda ws: [w for w in ws if listed.count(w) > 1])
    scores = op.sentiment(df, "id", "text", lexicon).collect()
    assert sorted(repr((r["id"], r["sentiment"] and r["sentiment"]["compound"] > 0)) for r in scores) == sorted(
        repr((i, None if t is None else "cats" in t)) for i, t in REPEATED
    )


def test_other_columns_and_rows_stay(spark, join_way):
    df = spark.createDataFrame([(i, "a b", i * 2) for i in range(50)], "id bigint, text string, other bigint")
    out = op.remove_rare(df, "id", "text", 2)
    assert out.columns == ["id", "text", "other", "kept"]
    assert {(r.id, r.other, tuple(r.kept)) for r in out.collect()} == {(i, i * 2, ("a", "b")) for i in range(50)}


def test_normalize(spark, docs):
    lemmas = spark.createDataFrame([("cat",), ("dog",)], "word string")
    out = normalize(docs, "id", "text", lemmas=lemmas)
    assert out.columns == ["id", *STAGES]
    rows = {r["id"]: r for r in out.collect()}
    assert rows[2].tokens is None and rows[2].lemmas is None
    assert rows[3].no_stop == []
    df = spark.createDataFrame([(1, "The Cats' 3 boxes, naïve DOGS!")], "id bigint, text string")
    row = normalize(df, "id", "text", lemmas=lemmas).first()
    assert row.no_punct == "The Cats 3 boxes naïve DOGS" and row.ascii == "The Cats 3 boxes nave DOGS"
    assert row.no_digits == "The Cats  boxes nave DOGS"
    assert row.tokens == ["the", "cats", "", "boxes", "nave", "dogs"]
    assert row.no_stop == ["cats", "", "boxes", "nave", "dogs"]
    assert row.stems == ["cat", "box", "nave", "dog"] and row.lemmas == ["cat", "box", "nave", "dog"]
    assert normalize(df, "id", "text", ["tokens"]).columns == ["id", "tokens"]
    twice = spark.createDataFrame([(1, "cats"), (1, "dogs"), (None, "boxes cats"), (None, None)], "id bigint, text string")
    found = normalize(twice, "id", "text", ["stems", "lemmas"], lemmas, min_len=0)
    assert found.columns == ["id", "stems", "lemmas"]
    assert sorted(str((r.id, r.lemmas)) for r in found.collect()) == [
        "(1, ['cat'])", "(1, ['dog'])", "(None, None)", "(None, ['box', 'cat'])"
    ]
    with pytest.raises(ValueError):
        normalize(df, "id", "text", ["lemmas"])
    with pytest.raises(ValueError):
        normalize(df, "id", "text", ["stemz"])


def test_column_summary(spark):
    rows = [("Rwanda", 1), (" 42 ", 1), ("99999999999", None), (None, None), (None, None), ("4.7", 2), ("-3", 2),
            ("x" * 100, 1), ("x" * 100, 1), ("x" * 99 + "y", 1)]
    df = spark.createDataFrame(rows, "c string, n int")
    assert op.column_summary(df, "c").first().asDict() == {"count": 10, "unique": 8, "maximum": 42}
    assert op.column_summary(df, "n").first().maximum == 2
    assert op.column_summary(df, "c", approx=True).first().unique == 8
    assert op.column_summary(df.filter("c = 'Rwanda'"), "c").first().maximum is None
    uniques = op.column_uniques(df, ["c", "n"])
    assert uniques.first().asDict() == {"c": 7, "n": 2}
    assert "sha2" in uniques._jdf.queryExecution().executedPlan().toString()


def test_groups(spark):
    rows = [("a", "3"), ("a", "3"), ("a", None), ("b", "x"), (None, "7"), ("c", None), (None, "-1")]
    df = spark.createDataFrame(rows, "k string, v string")
    assert op.group_info(df, "k", "v").first().asDict() == {"count": 4, "maximum": 7, "minimum": -1}
    values = {(r.k, r.v, r["count"]) for r in op.group_values(df, "k", "v").collect()}
    assert values == {("a", "3", 2), ("b", "x", 1), (None, "7", 1), (None, "-1", 1), ("c", None, 0)}
    summary = {r.k: (r["count"], r.maximum, r.minimum) for r in op.group_summary(df, "k", "v").collect()}
    assert summary == {"a": (3, 3, 3), "b": (1, None, None), None: (2, 7, -1), "c": (1, None, None)}


def test_frequent_terms(docs):
    got = [(r.term, r.n) for r in op.frequent_terms(docs, "text", 5).collect()]
    assert got == sorted(COUNTS.items(), key=lambda p: (-p[1], p[0]))[:5]
    assert docs.select(F.lit(1)).count() == len(DOCS)


def test_long_top_list_is_exact(spark, monkeypatch):
    """Long lists are sorted in ranges; ties at the end are cut in order of the term."""
    from lexsieve.operators import corpus as module

    monkeypatch.setattr(module, "LIST_LIMIT", 0)
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(6_000)]
    df = spark.createDataFrame([(" ".join(words[i : i + 50]),) for i in range(0, 6_000, 50)], "text string")
    ranked = sorted(Counter(words).items(), key=lambda p: (-p[1], p[0]))
    for k in (1, 7, 100, 10**6):
        top = op.frequent_terms(df, "text", k)
        assert sorted(top.collect(), key=lambda r: (-r["n"], r["term"])) == [(w, n) for w, n in ranked[:k]]
        assert "TakeOrdered" not in top._jdf.queryExecution().executedPlan().toString()
    assert op.frequent_terms(df.limit(0), "text", 5).count() == 0


def test_rows_without_a_key(spark):
    """Equal rows, rows under one id and null ids are each patched for themselves."""
    rows = [(1, "cat a b"), (1, "dog cat a b"), (None, "cat"), (None, "cat"), (2, None), (1, "cat a b")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    glossary = spark.createDataFrame([("fr", "cat", "chat")], "lang string, term string, target string")
    vocab = spark.createDataFrame([("cat", 5), ("a", 5), ("b", 5)], "word string, freq bigint")
    listed = [w for _, t in rows if t for w in t.split(" ")]
    frequent = [f"w{i}" for i in range(250)]
    many = spark.createDataFrame([(t,) for t in [" ".join(frequent)] * 2 + ["w1 rare", "w2 rare"]], "text string")

    def outs(got, out):
        return sorted(str(r[out]) for r in got.select(out).collect())

    def by_rule(rule):
        return sorted(str(None if t is None else rule(t.split(" "))) for _, t in rows)

    translated = op.translate_terms(df, None, "text", glossary, "fr")
    assert translated.columns == ["id", "text", "translated"]
    assert outs(translated, "translated") == by_rule(lambda ws: ["chat" if w == "cat" else w for w in ws])
    assert outs(op.remove_rare(df, None, "text"), "kept") == by_rule(lambda ws: [w for w in ws if listed.count(w) > 1])
    assert outs(op.spell_correct(df, None, "text", vocab), "corrected") == by_rule(lambda ws: ws)
    assert outs(op.lemmatize_tokens(df, None, "text", vocab), "lemmas") == by_rule(lambda ws: [w for w in ws if len(w) > 2])
    # 251 terms: all but the last of the rarest are among the 250 most frequent.
    assert outs(op.remove_frequent(many, "text", 250), "kept") == ["['w99']"] * 2 + ["[]"] * 2
