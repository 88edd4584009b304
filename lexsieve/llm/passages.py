"""Benchmark decontamination with a distributed positional inverted index.

The index is a table: documents are taken together into segments, and each term of a segment has
one row with the places of its occurrences in it, documents lying one after the other. Segments are
made where the documents are read, so nothing is shuffled to build it.

A search takes windows of words. It reads the postings of their terms from the index once; only
segments that hold a window's rarest terms are looked at, and only the postings wanted there are
brought together. The lists, each moved by its term's place in the window, are intersected from the rarest
term on, and what is left is where the window stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lexsieve.llm.coding import coded_words
from lexsieve.llm.common import code_points, named, packed, unpacked
from lexsieve.operators.terms import join_given_terms, maybe_listed
from lexsieve.sources.shared import settle

OUTPUTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word, once A-Z are small letters: digits, a-z and all beyond ASCII; and the same for bytes.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SEGMENT_BYTES = 8 << 20
RAREST = 3
POSTINGS = "segment long, term string, n int, positions array<int>, starts array<int>, sizes array<int>"
MATCHES = "segment long, doc int, n_hit long, spans array<struct<start:int,end:int>>, windows array<string>"


def words(text: Column) -> Column:
    """The words of a text, A-Z as small letters; a null text has none."""
    return F.regexp_extract_all(F.translate(code_points(text), UPPER, LOWER), F.lit(WORD), F.lit(0))


def build_index(df: DataFrame, text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of all texts, written to the shared folder.

    Rows with a ``term`` are postings: its ``n`` ``positions`` in the ``segment``. The row without
    one tells the segment's documents: where each ``starts``, its number of words in ``sizes``, and in
    ``rows`` the caller's columns but for the text. Between two documents a place is left
    empty, so that no run of places goes from one into the next.
    """
    rows = packed(df, [text, *OUTPUTS], text=code_points(named(text)))
    schema = StructType([*StructType.fromDDL(POSTINGS), StructField("rows", ArrayType(rows.schema["row"].dataType))])

    def segment(number: int, texts: list[pa.Array], of: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        doc, codes, terms = coded_words(pa.concat_arrays(texts), WORD_BYTES)
        sizes = np.bincount(doc, minlength=sum(map(len, texts)))
        starts = np.cumsum(sizes + 1) - sizes - 1
        n = len(terms)
        counts = np.bincount(codes, minlength=n)
        ends = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        # A document's words stand after one empty place for each document before it.
        place = np.arange(len(doc)) + doc
        positions = pa.array(place[np.argsort(codes, kind="stable")].astype(np.int32))

        def one(kind, value=None):
            return pa.nulls(1, kind) if value is None else pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value)

        lists = pa.list_(pa.int32())
        documents = pa.concat_arrays(of)
        yield pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, lists),
            one(lists, pa.array(starts.astype(np.int32))), one(lists, pa.array(sizes.astype(np.int32))), one(None, documents),
        ], schema.names)
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number), pa.int64()), terms.cast(pa.string()),
                pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(ends, positions),
                pa.nulls(n, lists), pa.nulls(n, lists), pa.nulls(n, pa.list_(documents.type)),
            ], schema.names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, of, size = [], [], 0
        for batch in batches:
            texts = batch.column("text")
            sizes = pc.binary_length(texts.cast(pa.binary())).to_numpy()
            first = 0
            while first < len(texts):
                # Texts up to the one that fills the segment.
                last = min(first + int(np.searchsorted(np.cumsum(sizes[first:]), segment_bytes - size)) + 1, len(texts))
                held.append(texts.slice(first, last - first))
                of.append(batch.column("row").slice(first, last - first))
                size += int(sizes[first:last].sum())
                first = last
                if size >= segment_bytes:
                    yield from segment(number, held, of)
                    number, held, of, size = number + 1, [], [], 0
        if held:
            yield from segment(number, held, of)

    return settle(rows.mapInArrow(build, schema))


def item_windows(items: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(item, window, words): each run of ``length`` words of an item, or the whole of a shorter one."""
    w = F.col("w")
    runs = F.when(F.size(w) >= length, F.transform(
        F.sequence(F.lit(0), F.size(w) - length), lambda i: F.slice(w, i + 1, F.lit(length))
    )).when(F.size(w) > 0, F.array(w))
    made = items.select(named(key).cast("string").alias("item"), words(named(text)).alias("w"))
    return made.select("item", F.explode(runs).alias("words")).select(
        "item", F.md5(F.array_join("words", " ")).alias("window"), "words"
    )


def wanted_postings(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(segment, term, n, positions) of the windows' terms, settled.

    The terms are broadcast if they are few; otherwise a Bloom filter of them is, and the index is
    shuffled no further than that lets through.
    """
    terms = windows.select(F.explode("words").alias("term")).distinct()
    postings = index.filter("term is not null").select("segment", "term", "n", "positions")
    return settle(join_given_terms(postings, settle(terms)))


def ranked_windows(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, length, terms): a window's terms as (n, place, term), the rarest in the corpus first.

    Windows with a term that no document has are left out.
    """
    different = windows.dropDuplicates(["window"]).select("window", F.size("words").alias("length"), "words")
    placed = different.select("window", "length", F.posexplode("words").alias("place", "term"))
    counts = postings.groupBy("term").agg(F.sum("n").alias("n"))
    terms = F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("terms")
    return placed.join(counts, "term").groupBy("window", "length").agg(terms).filter(F.size("terms") == F.col("length"))


def intersect(lists: list[np.ndarray], places: list[int]) -> np.ndarray:
    """Starts of the windows whose terms stand at ``places``, from sorted lists, the rarest first."""
    left = lists[0] - places[0]
    for positions, place in zip(lists[1:], places[1:], strict=True):
        if not len(left):
            break
        at = np.searchsorted(positions, left + place)
        at[at == len(positions)] = 0
        left = left[positions[at] == left + place]
    return left


def near_spans(lists: list[np.ndarray], most: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """Shortest spans of at most ``most`` places within one document that hold each list's term, one
    for each occurrence of the rarest that is in such a span."""
    spans = []
    for p in lists[0].tolist():
        doc = np.searchsorted(starts, p, "right")
        low = max(p - most + 1, int(starts[doc - 1]))
        high = min(p + most, int(starts[doc]) - 1 if doc < len(starts) else p + most)
        near = [x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in lists[1:]]
        if not all(len(x) for x in near):
            continue
        best = None
        for begin in sorted({p, *(int(v) for x in near for v in x if v <= p)}, reverse=True):
            ends = [x[np.searchsorted(x, begin) :] for x in near]
            if not all(len(x) for x in ends):
                continue
            end = max(p, *(int(x[0]) for x in ends)) if ends else p
            if end - begin < most and (best is None or end - begin < best[1] - best[0]):
                best = begin, end
        if best:
            spans.append((best[0], best[1] + 1))
    return sorted(set(spans))


def _place() -> Column:
    """A term in a segment, as one value."""
    return F.concat_ws(" ", F.col("segment").cast("string"), "term")


def search(index: DataFrame, postings: DataFrame, ranked: DataFrame, slop: int | None = None) -> DataFrame:
    """Documents in which windows occur: (segment, doc, n_hit, spans, windows).

    ``doc`` is the document's number in its segment; ``spans`` are the runs of its words inside any
    occurrence, ends exclusive, and ``n_hit`` their words. With ``slop`` a window occurs in any order
    wherever each of its terms stands in one span of at most ``slop`` words more than the window.
    """
    exact = slop is None
    held = postings.select("segment", "term")
    alive = held.join(ranked.withColumn("term", F.col("terms")[0]["term"]), "term").drop("term")
    for i in range(1, RAREST):
        other = F.coalesce(F.get("terms", F.lit(i))["term"], F.col("terms")[0]["term"])
        alive = alive.withColumn("term", other).join(held, ["segment", "term"], "left_semi").drop("term")
    alive = settle(alive)
    # A Bloom filter of what is wanted where goes to the postings, so that these are shuffled once.
    needed = settle(alive.select("segment", F.explode("terms.term").alias("term")).select(_place().alias("place")).distinct())
    postings = maybe_listed(postings.select("segment", "term", "positions", _place().alias("place")), needed, "place").drop("place")
    headers = index.filter("term is null").select("segment", "term", F.col("starts").alias("positions"))
    headers = headers.join(alive.select("segment").distinct(), "segment", "left_semi")

    def find(windows: pa.Table, lists: pa.Table) -> pa.Table:
        terms = lists.column("term").to_pylist()
        column = lists.column("positions").combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        held = {t: flat[ends[i] : ends[i + 1]] for i, t in enumerate(terms)}
        found: dict[int, tuple[list, list]] = {}
        starts = held.pop(None, np.zeros(0, np.int32))
        rows = zip(*(windows.column(c).to_pylist() for c in ("window", "length", "terms")), strict=True)
        for window, length, order in rows:
            if not all(t["term"] in held for t in order):
                continue
            if exact:
                at = intersect([held[t["term"]] for t in order], [t["place"] for t in order])
                spans = [(s, s + length) for s in at.tolist()]
            else:
                different = list(dict.fromkeys(t["term"] for t in order))
                spans = near_spans([held[t] for t in different], length + slop, starts)
            for (start, end), doc in zip(spans, np.searchsorted(starts, [s for s, _ in spans], "right") - 1, strict=True):
                told = found.setdefault(int(doc), ([], []))
                told[0].append((start - int(starts[doc]), end - int(starts[doc])))
                told[1].append(window)
        docs = sorted(found)
        merged = [_merged(found[d][0]) for d in docs]
        segment = windows.column("segment")[0].as_py() if len(windows) else None
        return pa.table({
            "segment": pa.array([segment] * len(docs), pa.int64()), "doc": pa.array(docs, pa.int32()),
            "n_hit": pa.array([sum(e - s for s, e in m) for m in merged], pa.int64()),
            "spans": pa.array([[{"start": s, "end": e} for s, e in m] for m in merged],
                              pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            "windows": pa.array([sorted(set(found[d][1])) for d in docs], pa.list_(pa.string())),
        })

    return alive.groupBy("segment").cogroup(postings.unionByName(headers).groupBy("segment")).applyInArrow(find, MATCHES)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(spans)):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def contamination(
    df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    length: int = 10, slop: int | None = None, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """All rows, without their text, with ``n_words``, ``n_hit`` (words inside any occurrence of a window),
    ``n_items`` and ``items_sha256`` (different items with occurring windows; their ids sorted as
    strings and joined by commas), ``contaminated`` and ``spans`` (word numbers, ends exclusive).

    A window is ``length`` words of an item in a row, or all words of a shorter one; ``slop`` is that of
    :func:`search`. Null and empty texts have no words; items without words have no windows; an
    item without an id hits words but is not listed; repeated rows and items each count as they stand,
    repeated ids once. An empty table on either side gives no hits. Columns of the outputs' names
    give way.
    """
    index = build_index(df, text, segment_bytes)
    windows = settle(item_windows(items, item, item_text, length))
    postings = wanted_postings(index, windows)
    found = settle(search(index, postings, settle(ranked_windows(postings, windows)), slop))
    ids = windows.select("window", "item").filter("item is not null").distinct()
    listed = (
        found.select("segment", "doc", F.explode("windows").alias("window")).join(ids, "window")
        .groupBy("segment", "doc").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    )
    hits = found.select("segment", "doc", "n_hit", "spans").join(listed, ["segment", "doc"], "left")
    documents = index.filter("term is null").select(
        "segment", F.posexplode(F.arrays_zip("rows", "sizes")).alias("doc", "d")
    ).select("segment", "doc", F.col("d.rows").alias("row"), F.col("d.sizes").cast("long").alias("n_words"))
    joined = documents.join(hits, ["segment", "doc"], "left")
    names = F.coalesce("ids", F.array().cast("array<string>"))
    return unpacked(
        joined, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "spans",
    )
