"""Divergence audit, centroids and decontamination against brute force, and odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexsieve.llm import centroids, divergence, passages
from tests.llm.test_operators import ODD_ROWS, SCHEMA

EMPTY = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(ODD_ROWS, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


# Divergence audit


def brute_audit(rows, least_docs, top):
    docs, occurrences, groups = Counter(), Counter(), set()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups.add((lang, source))
        docs.update((lang, t) for t in set(found))
        occurrences.update((lang, source, t) for t in found)
    kept = defaultdict(list)
    for (lang, term), n in docs.items():
        if n >= least_docs:
            kept[lang].append(term)

    def shares(lang, sources):
        n = {t: sum(occurrences[lang, s, t] for s in sources) for t in kept[lang]}
        under = sum(n.values()) + 5 * len(n)
        return {t: 1 + 1_000_000_000 * (n[t] + 5) // under for t in n}

    out = []
    for lang, source in groups:
        others = {s for x, s in groups if x == lang}
        p, q = shares(lang, [source]), shares(lang, others)
        pairs = []
        for other in others - {source}:
            o = shares(lang, [other])
            pairs.append((-sum(abs(p[t] - o[t]) for t in p), other.encode(), other))
        terms = [(q[t] - p[t], t.encode(), t) for t in p if occurrences[lang, source, t] and p[t] > q[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item, -v, i) for i, (v, _, item) in enumerate(items, 1)]
    return sorted(out)


def corpus(seed, n=240):
    random.seed(seed)
    pieces = ["a", "an", "And", "ant", "é", "éa", "zz" * 40, "zz" * 40 + "q", "日本", "𝒳", "x1y", "b-c", "I"]
    rows = []
    for i in range(n):
        lang = random.choices(["en", "fr", "", None, "one"], [6, 2, 1, 1, 1])[0]
        source = "only" if lang == "one" else random.choices(["hot", "s1", "é", "𝒳", "", None], [5, 2, 2, 1, 1, 1])[0]
        words = random.choices(pieces, k=random.randint(0, 30)) + [f"w{random.choice('abcdef') * random.randint(1, 9)}"]
        rows.append((i, random.choice([" ".join(words)] * 9 + ["", None, "123 456"]), lang, source))
    return rows + [rows[3]] * 20


@pytest.mark.parametrize(("options", "listed"), [({}, 8 << 20), ({"segment_bytes": 300, "first_length": 1}, 8 << 20), ({"segment_bytes": 900}, -1)])
def test_audit_against_brute_force(spark, options, listed, monkeypatch):
    monkeypatch.setattr(divergence, "LISTED_BYTES", listed)
    monkeypatch.setattr(divergence, "PAIR_TERMS", 7)
    monkeypatch.setattr(divergence, "PAIR_SOURCES", 2)
    rows = corpus(3)
    df = spark.createDataFrame(rows, EMPTY).repartition(3)
    found = divergence.audit(df, least_docs=12, top=5, **options)
    assert sorted(tuple(r) for r in found.collect()) == brute_audit(rows, 12, 5)


def test_audit_discards_prefixes_before_terms(spark):
    """A prefix below the threshold has no longer ones, and kept terms are those in enough documents."""
    rows = [(i, f"alpha al{'bcd'[i % 3]}eta rare{i} {'long' * 30}", "en", "s") for i in range(30)]
    segments = divergence.build_segments(spark.createDataFrame(rows, EMPTY).repartition(4), "lang", "source", "text")
    kept = {bytes(r["prefix"]) for r in divergence.kept_terms(segments, 11).select("prefix").collect()}
    assert kept == {b"alpha\x00", b"long" * 30 + b"\x00", b"rare\x00"}
    two = divergence.prefix_counts(segments, 2).groupBy("prefix").agg(F.sum("docs").alias("n")).collect()
    assert {bytes(r["prefix"]): r["n"] for r in two} == {b"al": 30, b"ra": 30, b"lo": 30}
    four = divergence.prefix_counts(segments, 4).groupBy("prefix").agg(F.sum("docs").alias("n")).collect()
    assert {bytes(r["prefix"]): r["n"] for r in four} == {
        b"alph": 30, b"albe": 10, b"alce": 10, b"alde": 10, b"rare": 30, b"long": 30
    }


def test_segments_are_read_one_at_a_time(spark):
    """However many segments a task has written, a reader holds one."""
    rows = [(i, f"alpha al{'bcd'[i % 3]}eta word{i}", "en" if i % 2 else "fr", "s") for i in range(60)]
    df = spark.createDataFrame(rows, EMPTY).coalesce(1)
    segments = divergence.build_segments(df, "lang", "source", "text", 200)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in segments.inputFiles()]
    groups = [meta.row_group(i).num_rows for meta in files for i in range(meta.num_row_groups)]
    assert len(files) == 1 and len(groups) > 10 and set(groups) == {1}


def test_audit_passes_over_prefixes_even_if_many_are_kept(spark, monkeypatch):
    """Beyond LISTED_BYTES a filter is sent, so that not all prefixes of the corpus are shuffled."""
    monkeypatch.setattr(divergence, "LISTED_BYTES", -1)
    rows = [(i, f"alpha {chr(98 + i % 20) * 4}{i}x {chr(98 + i // 20 % 20) * 3}q", "en", "s") for i in range(400)]
    rows += [(i, f"zz{i}", "fr", "s") for i in range(400)]
    segments = divergence.build_segments(spark.createDataFrame(rows, EMPTY).repartition(2), "lang", "source", "text")
    kept = spark.createDataFrame([("en", bytearray(b"alph"))], "lang string, prefix binary")
    listed, exact = divergence._listed(kept)
    found = divergence.prefix_counts(segments, 8, listed, 4)
    assert not exact and found.count() < 40
    assert found.filter("prefix = X'616C70686100'").agg(F.sum("docs")).first()[0] == 400


def test_audit_of_odd_and_empty_tables(spark, odd):
    rows = [(r[0], r[1], r[2], r[3]) for r in ODD_ROWS]
    for least in (1, 2, 30):
        found = divergence.audit(odd, least_docs=least)
        assert sorted(tuple(r) for r in found.collect()) == brute_audit(rows, least, 50)
    empty = divergence.audit(odd.limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_shares_are_exact_for_large_counts(spark):
    n = [(0, 0, 1), (7 * 10**14, 10**15, 10**6), (3, 10**15, 1)]
    df = spark.createDataFrame(n, "n long, total long, kinds long")
    found = [r[0] for r in df.select(divergence.share(F.col("n"), F.col("total"), F.col("kinds"))).collect()]
    assert found == [1 + 10**9 * (a + 5) // (b + 5 * c) for a, b, c in n]


# Centroids


def brute_clusters(rows, clusters, rounds, size, scale=1024, seed=3):
    kept = [
        (key, [math.floor(scale * x) for x in v]) for key, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]

    def digest(key):
        return hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()

    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[assign(v)[1]].append(v)
        centres = [[sum(x) // len(x) for x in zip(*members[i])] if members[i] else c for i, c in enumerate(centres)]
    told = [(key, *assign(v)[::-1]) for key, v in kept]
    inertia = Counter()
    for _, c, d in told:
        inertia[c] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    most = 2**63 - 1
    return sorted(((str(k), c, min(d, most), min(inertia[c], most), min(sum(inertia.values()), most), shas[c]) for k, c, d in told))


def numbers(found):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in found.select("vec_id", *centroids.OUTPUTS).collect())


@pytest.mark.parametrize("block", [8_192, 7])
def test_clusters_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", block)
    random.seed(5)
    rows = [(i, [random.gauss(i % 5, 0.4) for _ in range(6)]) for i in range(150)]
    rows += [rows[0]] * 30 + [(None, rows[1][1]), (None, rows[2][1]), (900, rows[3][1]), (900, rows[4][1])]
    rows += [(901, None), (902, [0.0] * 5), (903, [0.0] * 5 + [None]), (904, [float("nan")] * 6), (905, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert numbers(centroids.cluster(df, clusters=4, rounds=5, size=6)) == brute_clusters(rows, 4, 5, 6)


def test_clusters_of_huge_components_are_exact(spark):
    rows = [(i, [1e300 * (-1) ** i, 3.5 + i, float(2**53 + 2 * i)]) for i in range(9)] + [(9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert numbers(centroids.cluster(df, clusters=3, rounds=4, size=3)) == brute_clusters(rows, 3, 4, 3)


def test_clusters_of_few_rows_and_clashing_names(spark):
    rows = [(1, [0.5, 1.0], "x", 7), (2, [3.0, 1.0], "y", 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, rows int")
    found = centroids.cluster(df, size=2)
    assert found.columns == ["vec_id", "embedding", "rows", *centroids.OUTPUTS]
    assert sorted((r["vec_id"], r["rows"], r["distance"]) for r in found.collect()) == [(1, 7, 0), (2, 8, 0)]
    assert centroids.cluster(df.limit(0), size=2).count() == 0 and centroids.cluster(df, size=64).count() == 0


# Decontamination


def word_list(text):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))


def brute_contamination(rows, items, length, slop=None):
    windows = defaultdict(set)
    for item, text in items:
        w = word_list(text)
        for i in range(max(1, len(w) - length + 1) if w else 0):
            windows[tuple(w[i : i + length])].add(None if item is None else str(item))
    out = []
    for key, text in rows:
        w = word_list(text)
        hit, ids = set(), set()
        for window, owners in windows.items():
            n = len(window)
            for i in range(len(w) - n + 1):
                if slop is None and tuple(w[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    ids |= owners
            if slop is not None and any(set(window) <= set(w[i : i + n + slop]) for i in range(len(w))):
                ids |= owners
        ids = sorted(ids - {None})
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        out.append((str(key), len(w), len(hit) if slop is None else None, len(ids), digest))
    return sorted(out, key=str)


def told(found, exact=True):
    rows = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").collect()
    return sorted(((str(r[0]), r[1], r[2] if exact else None, r[3], r[4]) for r in rows), key=str)


def texts(seed):
    random.seed(seed)
    vocabulary = ["the", "a", "of", "é", "x1", "日本", "Zed", "rare", "rarer", "𝒳"]

    def text(n):
        return " ".join(random.choices(vocabulary, [9, 8, 7, 2, 2, 1, 1, 0.3, 0.2, 0.2], k=n))

    items = [(i, text(random.randint(0, 12))) for i in range(12)]
    items += [(3, items[4][1]), (None, items[5][1]), (77, "of"), (78, ""), (79, None), (10, items[9][1])]
    rows = [(i, text(random.randint(0, 60))) for i in range(120)]
    rows += [(i, f"{text(5)}! {random.choice(items)[1]},{text(4)}".replace(" ", random.choice([" ", "\n", "--"]))) for i in range(200, 240)]
    return rows + [(None, items[0][1]), (None, None), (7, ""), (7, "of THE")] + [(300, items[6][1])] * 25, items


@pytest.mark.parametrize("segment", [8 << 20, 200])
def test_contamination_against_brute_force(spark, segment):
    rows, items = texts(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = passages.contamination(df, spark.createDataFrame(items, "item_id long, text string"), length=5, segment_bytes=segment)
    assert told(found) == brute_contamination(rows, items, 5)
    assert all(r["n_hit"] == sum(s["end"] - s["start"] for s in r["spans"] or []) for r in found.collect())


def test_near_passages_against_brute_force(spark):
    rows, items = texts(4)
    items = [i for i in items if len(set(word_list(i[1]))) > 2]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = passages.contamination(df, spark.createDataFrame(items, "item_id long, text string"), length=6, slop=3)
    assert told(found, exact=False) == brute_contamination(rows, items, 6, slop=3)


def test_contamination_of_odd_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "three four five six"), (2, "w3 w4 w5")], "item_id long, text string")
    found = passages.contamination(odd.withColumn("spans", F.lit(1)), items, length=3)
    rows = [(r[0], r[1]) for r in ODD_ROWS]
    assert told(found) == brute_contamination(rows, [(1, "three four five six"), (2, "w3 w4 w5")], 3)
    assert {"lang", "source", "shard", "text_2"} <= set(found.columns) and "text" not in found.columns
    assert passages.contamination(odd.limit(0), items).count() == 0
    clean = passages.contamination(odd, items.limit(0)).collect()
    assert len(clean) == len(ODD_ROWS) and not any(r["contaminated"] for r in clean)
