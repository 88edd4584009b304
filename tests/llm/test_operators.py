"""The operators against brute force, exact round trips and odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from lexsieve.llm import (
    bpe, chat, embeddings, fingerprints, jaccard, mixing, quality, secrets, sharding, toxicity,
)
from lexsieve.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, shard int, text_2 string"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
ODD_ROWS = [
    (1, "one two three four five six seven", "en", "a", 9, "x"),
    (1, "one two three four five six seven", "en", "a", 9, "x"),
    (2, None, None, None, None, None),
    (None, "", "en", "b", 1, ""),
    (3, "", None, "b", 1, ""),
    (4, LONG, "en", None, 2, "y"),
    (5, "\U0001f600 é <turn \\ password: abcdefg", "fr", "c", 3, "z"),
    (None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(ODD_ROWS, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def kept_columns(df, odd, outputs):
    return set(odd.columns) - set(outputs) <= set(df.columns)


# Sharding


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_are_level_gapless_and_whole(spark, odd, shards):
    found = sharding.shuffle_shards(odd, shards).collect()
    assert sorted(map(str, (r["text"] for r in found))) == sorted(str(r[1]) for r in ODD_ROWS)
    sizes = [sum(r["shard"] == s for r in found) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    assert {r["size"] for r in found if r["text"] is None} == {16}


def test_shards_of_an_empty_table(spark, odd):
    assert sharding.shuffle_shards(odd.limit(0), 4).count() == 0


def test_order_is_shuffled(spark):
    rows = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.shuffle_shards(rows, 1).orderBy("slot").collect()
    ids = [r["doc_id"] for r in found]
    assert sorted(ids) == list(range(2_000))
    assert sum(a < b for a, b in itertools.pairwise(ids)) < 1_200


# Mixing


def brute_targets(sizes, weights, share, most):
    """Share again what goes over, source by source, until nothing does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, held = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        if not free:
            return held
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return {**held, **{s: weight[s] * level for s in free}}
        for s in over:
            held[s] = most * sizes[s]
            left -= held[s]


def test_mixing_targets_and_copies(spark):
    random.seed(4)
    rows = [
        (i, " ".join("w" * random.randint(0, 9)), random.choice(["a", "B", "é", "", None, "z" * 3]))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text))
    want = brute_targets(sizes, (5, 2, 1), 1.5, 2)
    assert len(found) == 600
    for r in found:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
        assert r["copies"] in (0, 1, 2)
    taken = mixing.take(mixing.mix(df))
    assert taken.columns == df.columns
    assert taken.count() == sum(r["copies"] for r in found)
    total = sum(r["size"] * r["copies"] for r in found)
    assert abs(total - 1.5 * sum(sizes.values())) < 0.15 * sum(sizes.values())


def test_mixing_takes_near_the_target_of_rows_with_one_id(spark):
    """A source whose rows share an id, or are one row again and again, is still taken in part."""
    rows = [(1, "one two three", "a")] * 900 + [(2, f"w{i} w w", "b") for i in range(900)] + [(None, "x y z", None)] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix(df, weights=(1, 1, 1), share=1.5)
    taken = {r["source"]: r for r in found.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")
    ).collect()}
    for r in taken.values():
        assert r["n"] == 900 and abs(r["taken"] - r["target"]) < 0.1 * r["target"]
    again = mixing.mix(df.repartition(3, "source"), weights=(1, 1, 1), share=1.5)
    columns = ["doc_id", "text", "source", "copies"]
    assert found.select(columns).exceptAll(again.select(columns)).isEmpty()


def test_mixing_odd_rows(spark, odd):
    found = mixing.mix(odd)
    assert found.count() == len(ODD_ROWS) and kept_columns(found, odd, mixing.OUTPUTS)
    assert mixing.mix(odd.limit(0)).count() == 0
    empty = mixing.mix(odd.filter("text = '' or text is null")).collect()
    assert {r["target"] for r in empty} == {0.0}


# Secrets

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def brute_entropy(text):
    """Entropy of every window from the beginning; windows in one stretch joined."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        word = m[0]
        if any(re.search(p, word) for p in secrets.ALLOWED):
            continue
        bits = next(b for p, b in secrets.CLASSES if re.search(p, word))
        for i in range(len(word) - 19):
            window = word[i : i + 20]
            total = sum(round(c * math.log2(c) * 2**30) for c in map(window.count, set(window)))
            if total <= math.floor(20 * (math.log2(20) - bits) * 2**30):
                if out and out[-1][2] >= m.start() + i and out[-1][0] >= m.start():
                    out[-1] = (out[-1][0], 3, m.start() + i + 20)
                else:
                    out.append((m.start() + i, 3, m.start() + i + 20))
    base = brute_base(text)
    return [s for s in out if not any(b[0] <= s[0] and b[2] >= s[2] for b in base)]


def test_secrets_against_brute_force(spark):
    random.seed(7)
    pieces = [
        "password", "=", ": ", "token", "api_key", "'", '"', "abc", "secret", "é", "\U0001f600", " ", "\n",
        "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "Zk9qLx2Rm7TbVw4Yc8Nd", "aaaaaaaaaaaaaaaaaaaaaaaaa",
        "usr/local/lib/python3/site", "K", "PassWord", "f3", "+/=", "01234567-89ab-cdef-0123-456789abcdef",
    ]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    some = 0
    for r in secrets.scan_secrets(df).collect():
        want = sorted(brute_base(r["text"]) + brute_entropy(r["text"]))
        assert [(s["start"], s["order"], s["end"]) for s in r["secrets"]] == want, r["text"]
        some += any(s[1] == 3 for s in want)
    assert some > 20


def test_secrets_odd_rows_and_redaction(spark, odd):
    found = secrets.scan_secrets(odd)
    rows = found.withColumn("clean", secrets.redacted(F.col("text"), F.col("secrets"))).collect()
    assert len(rows) == len(ODD_ROWS)
    assert {len(r["secrets"]) for r in rows if not r["text"]} == {0}
    assert next(r["clean"] for r in rows if r["doc_id"] == 5) == "\U0001f600 é <turn \\ [SECRET]"
    assert next(r["clean"] for r in rows if r["doc_id"] == 2) is None


# Fingerprints


def test_next_text_and_likeness(spark, odd):
    random.seed(2)
    words = [f"v{i}" for i in range(400)]
    rows = [(i * 3, " ".join(random.choices(words, k=random.randint(0, 80)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df).collect()}
    assert found == {k: dict(rows)[k - 3 if k else 897] for k, _ in rows}
    own, changed = fingerprints.anchors(F.col("text")), fingerprints.anchors(
        fingerprints.edited(F.col("text"), F.col("next_text"))
    )
    near = fingerprints.with_next(df).filter("length(text) > 250").select(
        fingerprints.likeness(own, own).alias("same"), fingerprints.likeness(own, changed).alias("changed"),
        fingerprints.likeness(own, fingerprints.anchors(F.col("next_text"))).alias("other"),
    ).collect()
    assert {r["same"] for r in near} == {1.0} and {r["other"] for r in near} == {0.0}
    assert 0.3 < sum(r["changed"] for r in near) / len(near) < 0.6
    assert fingerprints.with_next(odd).count() == len(ODD_ROWS)
    assert fingerprints.with_next(odd.limit(1)).first()["next_text"] is not None
    assert fingerprints.with_next(odd.limit(0)).count() == 0


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(f"u{i * i % 91}" for i in range(300))
    words = text.split(" ")
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string")
    h = [r[0] for r in df.orderBy("i").select(F.xxhash64("w")).collect()]
    pairs = spark.createDataFrame(list(itertools.pairwise(h)), "a long, b long").select(F.xxhash64("a", "b")).collect()
    small = [r[0] for r in pairs]
    want = [i for i in range(len(words) - 4) if min(small[i], small[i + 3]) <= min(small[i + 1 : i + 3])]
    found = spark.createDataFrame([(text,)], "text string").select(fingerprints.anchors(F.col("text"))).first()[0]
    assert [a["pos"] for a in found] == want


def test_every_text_with_words_has_an_anchor(spark):
    random.seed(6)
    rows = [(n, " ".join(random.choices("abcdefghij", k=n))) for n in range(11) for _ in range(60)]
    df = spark.createDataFrame(rows, "n int, text string")
    own = fingerprints.anchors(F.col("text"))
    other = fingerprints.anchors(F.concat(F.col("text"), F.lit(" other"), F.repeat(F.lit(" words"), 9)))
    unlike = fingerprints.anchors(F.regexp_replace("text", "[a-j]", "x$0"))
    for r in df.select("n", F.size(own).alias("size"), fingerprints.likeness(own, own).alias("same"),
                       fingerprints.likeness(own, unlike).alias("unlike"), F.size(other).alias("more")).collect():
        assert (r["size"] > 0) == (r["n"] > 0) and r["more"] > 0
        assert r["same"] == 1.0 and r["unlike"] == (0.0 if r["n"] else 1.0)


# Chat


def test_chat_round_trip(spark):
    random.seed(3)
    pieces = ["<turn ", "</turn>\n", "\\", "\\b", "\\l", "<", ">", "### Assistant:", "é", "\n", "a", ""]
    talks = {
        c: [
            (random.choice(["user", "assistant", "system", "assistant"]), "".join(random.choices(pieces, k=6)))
            for _ in range(random.randint(1, 9))
        ]
        for c in range(60)
    }
    rows = [(c, i, r, t or None) for c, talk in talks.items() for i, (r, t) in enumerate(talk)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.format_chats(df)
    for r in chat.read_chats(examples).collect():
        talk = talks[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == talk
        assert r["losses"] == [t for role, t in talk if role == "assistant"]
    counts = {r["conv_id"]: r["count"] for r in examples.groupBy("conv_id").count().collect()}
    for c, talk in talks.items():
        assert counts[c] == sum(r == "assistant" for r, _ in talk) + (talk[-1][0] != "assistant")


def test_chat_nulls(spark):
    rows = [(None, None, None, None), (1, 0, "user", "q"), (1, None, None, "first"), (1, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in read[1]["turns"]] == [("", "first"), ("user", "q"), ("user", "q")]
    assert [tuple(t) for t in read[None]["turns"]] == [("", "")] and read[None]["losses"] == []
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_chat_of_one_long_conversation(spark):
    random.seed(4)
    n = 30_000  # examples as values would be some 10^11 characters
    talk = [(None, i // 3, random.choice(["user", "assistant"]), f"<{random.random()}\\" * 20) for i in range(n)]
    talk += [(None, n, "user", "same")] * 3_000 + [(1, 0, "user", "q"), (1, 1, "assistant", "a<")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").repartition(4)
    parts = chat.format_parts(df)
    assert parts.filter("conv_id is null").select("range").distinct().count() > 1
    read = chat.joined_in_order(
        chat.read_parts(parts), whole=F.concat("role", F.lit("\n"), "text", F.lit("\n")), losses=F.col("loss")
    )
    found = {r["conv_id"]: r for r in read.collect()}
    turns = sorted(talk[:-2], key=lambda t: t[1:])
    lengths = itertools.accumulate(16 + len(r + t) + sum((r + t).count(x) for x in "<>\\") for *_, r, t in turns)
    ends = [i for i, t in enumerate(turns) if t[2] == "assistant"] + [len(turns) - 1]
    lengths = list(lengths)
    assert found[None]["n_turns"] == len(turns) and found[None]["formatted_chars"] == sum(lengths[i] for i in ends)
    assert found[None]["whole"] == "".join(f"{r}\n{t}\n" for *_, r, t in turns)
    assert found[None]["losses"] == "".join(t for *_, r, t in turns if r == "assistant")
    assert found[1]["losses"] == "a<" and found[1]["n_turns"] == 2


def test_chat_expands_prefixes_where_they_fit(spark):
    """Small conversations are examples of whole prefixes, large ones spans; both are read back alike."""
    talks = {
        1: [("user", "a<"), ("assistant", "b\\"), ("user", "c"), ("assistant", "d")],
        2: [("user", "x" * 300), ("assistant", "y>")],
        None: [("assistant", "z"), ("user", "")],
    }
    rows = [(c, i, r, t) for c, talk in talks.items() for i, (r, t) in enumerate(talk)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    small, large = chat.by_size(df, most=500)
    assert {r.conv_id for r in large.collect()} == {2}
    texts = [r.formatted for r in chat.format_chats(small.filter("conv_id = 1")).orderBy("example").collect()]
    assert len(texts) == 2 and texts[1].startswith(texts[0]) and texts[0].endswith("b\\b</turn>\n")
    found = {}
    for most in (0, 500, chat.EXPANDED_CHARS):
        read = chat.read_back(df, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")), most)
        found[most] = sorted(map(str, read.select(*sorted(read.columns)).collect()))
    assert found[0] == found[500] == found[chat.EXPANDED_CHARS]
    read = {r.conv_id: r for r in read.collect()}
    for c, talk in talks.items():
        assert read[c].whole == "".join(f"{r}\n{t}\n" for r, t in talk) and read[c].n_turns == len(talk)
        assert read[c].losses == "".join(t for r, t in talk if r == "assistant")


def test_chat_query_expands_prefixes(spark):
    from lexsieve.llm.queries import QUERIES

    plan = QUERIES["op8_chat"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and "max_by" in plan


# BPE

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_the_library():
    own, library = bpe.Tokenizer(PATH), Library.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    random.seed(1)
    letters = "aab bé'sΣİ1½२中 \n\t\x85\xa0!?…ǅßÅÅk"
    texts = ["", "a" * 3_000, "ααΣ", "<|endoftext|>", "<|ENDOFTEXT|>", LONG[:5_000]]
    texts += [
        "".join(random.choices(letters, k=random.randint(0, 40))) + random.choice(["", "<|endoftext|>"]) + "x"
        for _ in range(1_500)
    ]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_on_tables(spark, odd):
    coder = bpe.Tokenizer(PATH)
    found = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert len(found) == len(ODD_ROWS)
    for r in found:
        want = coder.encode([r["text"] or ""])[0]
        assert r["ids"] == want.tolist() and r["decoded"] == coder.decode(want)
    for r in bpe.round_trip(odd, PATH).collect():
        ids = coder.encode([r["text"] or ""])[0]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert bpe.encode(odd.limit(0), PATH).count() == 0


# Near duplicates


def brute_links(texts):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for t in texts]
    out = [set() for _ in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (texts[i] or "") == (texts[j] or "") or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
            out[i].add(j)
            out[j].add(i)
    return out


def reach(links):
    label = list(range(len(links)))
    for start in range(len(links)):
        stack = [start] if label[start] == start else []
        while stack:
            for j in links[stack.pop()]:
                if label[j] > start:
                    label[j] = start
                    stack.append(j)
    return label


@pytest.mark.parametrize("block", [800, 7])
def test_jaccard_join_against_brute_force(spark, block):
    random.seed(6)
    words = [f"q{i}" for i in range(3_000)]
    texts = [None, "", "", "a b", "a b", "a b c", "\x1c \x1d"]
    for _ in range(12):
        base = random.choices(words, k=random.randint(5, 120))
        for _ in range(random.randint(1, 7)):
            new = list(base)
            for _ in range(random.randint(0, 3)):
                new[random.randrange(len(new))] = random.choice(words)
            texts.append(" ".join(new))
    base = random.choices(words, k=60)
    texts += [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in range(0, 40)]
    random.shuffle(texts)
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    found = {r["doc_id"]: r for r in jaccard.near_duplicates(df, block=block).collect()}
    links = brute_links(texts)
    label = reach(links)
    assert len(found) == len(texts)
    for i in range(len(texts)):
        assert found[i]["n_links"] == len(links[i])
        assert found[i]["class_id"] == label[i] and found[i]["kept"] == (label[i] == i)
    one = jaccard.keep_one(df, block=block)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(label)) and one.columns == ["doc_id", "text"]


def test_jaccard_odd_rows(spark, odd):
    found = jaccard.near_duplicates(odd)
    assert found.count() == len(ODD_ROWS) and kept_columns(found, odd, jaccard.OUTPUTS)
    one = jaccard.keep_one(odd)
    assert one.columns == odd.columns
    assert sorted((r["text"] or "")[:9] for r in one.collect()) == sorted({(r[1] or "")[:9] for r in ODD_ROWS})
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("rows", [1_000, 40])
def test_near_vectors_against_brute_force(spark, rows):
    random = np.random.default_rng(5)
    base = random.normal(size=(60, 16))
    vectors = [v for b in base for v in b + random.normal(size=(3, 16)) * random.choice([0.01, 0.05, 0.3])]
    vectors += [base[0]] * 30 + [base[0] * 2]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0], [1.0]]
    data = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vectors)]
    data += [(1_000 + i, v, 0) for i, v in enumerate(odd)] + [(2_000, data[0][1], None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in embeddings.near_vectors(df, shard_rows=rows).collect()}
    ok = [
        v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None
        for _, v, label in data
    ]
    links = [set() for _ in data]
    for i, j in itertools.combinations(range(len(data)), 2):
        (_, a, la), (_, b, lb) = data[i], data[j]
        if ok[i] and ok[j] and la == lb and len(a) == len(b):
            if np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98 or a == b:
                links[i].add(j)
                links[j].add(i)
    label = reach(links)
    for i, (key, _, _) in enumerate(data):
        assert found[key]["n_links"] == len(links[i]), key
        assert found[key]["component_id"] == data[label[i]][0] and found[key]["kept"] == (label[i] == i)
    result = embeddings.near_vectors(df, shard_rows=rows)
    assert embeddings.audit_recall(df, result, every=5) >= 0.9
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_search_is_made_again_below_the_target(spark, monkeypatch):
    """A search that finds too little is followed by a wider one, which is audited in turn."""
    random = np.random.default_rng(6)
    base = random.normal(size=(40, 8))
    vectors = np.concatenate([base, base + random.normal(size=(40, 8)) * 0.02])
    df = spark.createDataFrame([(20 * i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    whole, tried = embeddings.near_vectors, []

    def blind(*args, margin=1.25, **options):
        tried.append(margin)
        found = whole(*args, margin=margin, **options)
        return found if margin is None else found.withColumn("n_links", F.lit(0).cast("long"))

    found, recall = embeddings.audited_vectors(df)
    assert recall >= 0.9 and found.filter("n_links > 0").count() >= 70
    monkeypatch.setattr(embeddings, "near_vectors", blind)
    found, recall = embeddings.audited_vectors(df)
    assert tried == [1.25, None] and recall >= 0.9 and found.filter("n_links > 0").count() >= 70
    assert embeddings.audited_vectors(df.limit(0))[1] == 1.0


def low_rank(random, n, inside, length):
    """Pairs of linked vectors in a subspace: a cosine of 0.981 to 0.999."""
    axes = np.linalg.qr(random.normal(size=(length, inside)))[0].T
    base = random.normal(size=(n, inside))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = random.normal(size=(n, inside))
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    angle = random.uniform(0.05, 0.195, (n, 1))
    return np.concatenate([base, np.cos(angle) * base + np.sin(angle) * aside]) @ axes


@pytest.mark.parametrize("mixed", [False, True])
def test_near_vectors_of_low_rank_over_two_levels(spark, mixed):
    random = np.random.default_rng(8)
    vectors = low_rank(random, 1_500, 6, 48 if mixed else 192)
    data = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    if mixed:  # one long vector, which links with none
        data.append((len(data), [1.0] * 6_400, 0))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    options = {"shard_rows": 100, "most_centres": 10}
    levels = embeddings._split(
        df.select(F.col("vec_id").cast("string").alias("rid"), F.col("embedding").alias("vec"), F.lit("0").alias("grp"))
        .filter("size(vec) < 6400"), "double", 100, 0.98, 1.25, 4, 10,
    )
    assert levels.filter("grp like '%/%/%'").count()
    result = embeddings.near_vectors(df, **options)
    assert embeddings.audit_recall(df, result, every=1) >= 0.995


def test_certain_margin_loses_no_link():
    random = np.random.default_rng(9)
    vectors = low_rank(random, 1_000, 5, 40)
    centres = vectors[:30]
    reach = embeddings.margins(centres, np.zeros((0, 40)), 0.98, None)
    member = embeddings.borders(vectors, centres, reach)
    left, right = member[:1_000], member[1_000:]
    assert (left & right).any(1).all() and member.mean() < 0.5


# Classifiers


def test_toxicity_learns_and_holds_out(spark, odd):
    random.seed(8)
    syllables = ["an", "the", "or", "ti", "on", "sh", "en", "re"]
    bad = ["grumbly", "vexmonk", "snarf", "blotter"]

    def text(toxic):
        words = ["".join(random.choices(syllables, k=random.randint(1, 4))) for _ in range(60)]
        if toxic:
            for _ in range(4):
                words[random.randrange(60)] = random.choice(bad)
        return " ".join(words)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    found = toxicity.score(df, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    for r in found:
        assert r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    tested = [r for r in found if r["held"]]
    assert sum(r["predicted"] == r["toxic"] for r in tested) > 0.95 * len(tested)
    flipped = df.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(df.select("doc_id", "text"), flipped.select("doc_id", "toxic"))
    assert again.toxic == model.toxic and again.weights == model.weights
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(ODD_ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    none = toxicity.train(odd, df.select("doc_id", "toxic").limit(0))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_expectation_maximisation_finds_accuracies():
    random = np.random.default_rng(3)
    truth = random.random(20_000) < 0.8
    bad_if_bad, bad_if_good = [0.9, 0.6, 0.7], [0.02, 0.1, 0.05]
    votes = np.stack([
        np.where(random.random(20_000) < np.where(truth, g, b), -1, 1)
        for b, g in zip(bad_if_bad, bad_if_good, strict=True)
    ], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, chances, prior = quality.estimate(patterns, counts)
    assert abs(prior - 0.8) < 0.02
    assert np.allclose(chances[:, 0, 0], bad_if_bad, atol=0.03) and np.allclose(chances[:, 1, 0], bad_if_good, atol=0.03)


def test_quality_on_labelled_documents(spark, odd):
    folder = "/root/testdata/sf0.01"
    found = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"))
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "truth")
    rows = found.join(labels, "doc_id").collect()
    good = [r["keep"] for r in rows if r["truth"] == 1]
    bad = [r["keep"] for r in rows if r["truth"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.6 * len(bad)
    assert quality.classify(odd).count() == len(ODD_ROWS)
    assert quality.classify(odd.limit(0)).count() == 0
