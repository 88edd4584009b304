"""Source divergence audit by Iceberg prefix refinement.

Which terms of a language are in enough of its documents is found without counting every term there
is: byte prefixes of growing length are counted, each by the different documents that have a
term with it, and one below the threshold is discarded with all terms under it. A term is complete
at the first length beyond its own (its end counts as a byte); what is complete and still kept at the end
are the kept terms. On these the sources are compared.

Documents are coded once: a segment holds, for a language, its sorted terms and each document's
term numbers and counts. As terms are sorted, those with one prefix are neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.llm.coding import coded_words
from lexsieve.llm.common import code_points, named
from lexsieve.sources.shared import settle

# A term is a run of letters and of anything beyond ASCII; A-Z become small letters.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
END = b"\x00"
SEGMENT_BYTES = 8 << 20
# Kept prefixes of up to so many bytes are sent to all tasks, which then pass over the others; of more a Bloom filter is.
LISTED_BYTES = 8 << 20
# 64-bit words of a Bloom filter at most: 16 MB.
BLOOM_WORDS = 1 << 21
FIRST_LENGTH = 4
PAIR_TERMS, PAIR_SOURCES = 2_048, 128
BODY = ["terms", "sizes", "codes", "counts", "source_of"]
SEGMENT = "segment long, lang string, sources array<string>, body binary"
PREFIXES = "lang string, prefix binary, docs long"
# A segment is a row group of its own and is read alone, however many a task has written to its file.
ONE_ROW = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false", "compression": "uncompressed"}


def _segment(number: int, lang: str, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The documents of one language in a segment. Its arrays are compressed in one value, so that Spark
    holds few bytes of it and takes none of them apart."""
    doc, code, terms = coded_words(texts, TERM_BYTES)
    cells, counts = np.unique(doc * max(len(terms), 1) + code, return_counts=True)
    sizes = np.bincount(cells // max(len(terms), 1), minlength=len(texts))
    source = sources.dictionary_encode()

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def ints(values: np.ndarray) -> pa.Array:
        return one(pa.array(values.astype(np.int32)))

    arrays = pa.RecordBatch.from_arrays(
        [one(terms.cast(pa.binary())), ints(sizes), ints(cells % max(len(terms), 1)), ints(counts), ints(source.indices.to_numpy())],
        BODY,
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, arrays.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as stream:
        stream.write_batch(arrays)
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.array([lang]), one(source.dictionary), pa.array([sink.getvalue().to_pybytes()], pa.binary()),
    ], ["segment", "lang", "sources", "body"])


def _arrays(body: pa.BinaryScalar, *names: str) -> list[pa.Array]:
    """Arrays of a segment; the others stay compressed."""
    options = pa.ipc.IpcReadOptions(included_fields=sorted(BODY.index(n) for n in names), use_threads=False)
    arrays = pa.ipc.open_stream(body.as_buffer(), options=options).read_next_batch()
    return [arrays.column(n)[0].values for n in names]


def build_segments(df: DataFrame, lang: str, source: str, text: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Coded documents, one row for each language of a segment; made where they are read, unshuffled."""

    def told(name: str) -> Column:
        return code_points(named(name).cast("string"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, []

        def made() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            for name in pc.unique(rows.column("lang")).to_pylist():
                own = rows.filter(pc.equal(rows.column("lang"), name)).combine_chunks()
                yield _segment(number, name, *(own.column(c).chunk(0) for c in ("source", "text")))

        for batch in batches:
            sizes = pc.binary_length(batch.column("text").cast(pa.binary())).to_numpy()
            first = 0
            while first < batch.num_rows:
                # Texts up to the one that fills the segment.
                last = min(first + int(np.searchsorted(np.cumsum(sizes[first:]), segment_bytes - size)) + 1, batch.num_rows)
                held.append(batch.slice(first, last - first))
                size += int(sizes[first:last].sum())
                first = last
                if size >= segment_bytes:
                    yield from made()
                    number, size, held = number + 1, 0, []
                    pa.default_memory_pool().release_unused()
        if held:
            yield from made()
        pa.default_memory_pool().release_unused()

    rows = df.select(told(lang).alias("lang"), told(source).alias("source"), told(text).alias("text"))
    return settle(rows.mapInArrow(build, SEGMENT), **ONE_ROW)


def _ended(terms: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(terms, pa.scalar(END, pa.binary()), pa.scalar(b"", pa.binary()))


def _bloom_place(lang: str, values: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a Bloom filter that each value sets bits in, and these three bits."""
    own = pd.util.hash_array(np.array([lang], object), categorize=False)
    found = own + pd.util.hash_array(values.to_numpy(zero_copy_only=False), categorize=False)
    bits = [np.uint64(1) << (found >> np.uint64(shift) & np.uint64(63)) for shift in (24, 36, 48)]
    return (found & np.uint64(words - 1)).astype(np.int64), bits[0] | bits[1] | bits[2]


def _bloom_filter(kept: DataFrame) -> np.ndarray:
    """The words of a Bloom filter of prefixes: 16 bits for one, up to BLOOM_WORDS words; beyond, it lets more through, never less."""
    n, words = kept.count(), 64
    while words * 4 < n and words < BLOOM_WORDS:
        words *= 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                word, bits = _bloom_place(lang, own.column("prefix"), words)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], ["word", "bits"])

    places = kept.select("lang", "prefix").mapInArrow(place, "word long, bits long")
    told = places.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(words, np.uint64)
    found[told.column("word").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
    return found


def _listed(kept: DataFrame) -> tuple[Broadcast, bool]:
    """For all tasks, prefixes by language if their bytes are few enough, or a Bloom filter of them; whether
    these are the prefixes themselves."""
    size = kept.agg(F.coalesce(F.sum(F.octet_length("prefix") + F.octet_length("lang") + 8), F.lit(0))).first()[0]
    context = kept.sparkSession.sparkContext
    if size > LISTED_BYTES:
        return context.broadcast(_bloom_filter(kept)), False
    found: dict[str, list[bytes]] = {}
    for lang, prefix in kept.select("lang", "prefix").collect():
        found.setdefault(lang, []).append(bytes(prefix))
    return context.broadcast({lang: pa.array(prefixes, pa.binary()) for lang, prefixes in found.items()}), True


def _among(values: pa.Array, listed: dict[str, pa.Array] | np.ndarray, lang: str) -> np.ndarray:
    """Which of the values are listed; by a Bloom filter, these and few others."""
    if isinstance(listed, dict):
        return pc.is_in(values, listed.get(lang, pa.array([], pa.binary()))).to_numpy(zero_copy_only=False)
    word, bits = _bloom_place(lang, values, len(listed))
    return listed[word] & bits == bits


def prefix_counts(segments: DataFrame, length: int, under: Broadcast | None = None, above: int = 0) -> DataFrame:
    """(lang, prefix, docs): prefixes of ``length`` bytes of the terms with their ends, and how many documents
    of a segment have a term with each; a row for each segment.

    With ``under`` only terms count whose first ``above`` bytes are among its prefixes, as :func:`_among` tells.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, body = batch.column("lang")[i].as_py(), batch.column("body")[i]
                ended = _ended(_arrays(body, "terms")[0])
                at = np.arange(len(ended))
                if under is not None:
                    at = np.flatnonzero(_among(pc.binary_slice(ended, 0, above), under.value, lang))
                if not len(at):
                    continue
                sizes, codes = (x.to_numpy() for x in _arrays(body, "sizes", "codes"))
                prefixes = pc.binary_slice(ended.take(pa.array(at)), 0, length)
                new = np.r_[True, pc.not_equal(prefixes[1:], prefixes[:-1]).to_numpy(zero_copy_only=False)]
                first = np.flatnonzero(new)
                group = np.full(len(ended), -1)
                group[at] = np.cumsum(new) - 1
                # Numbers rise within a document, so equal groups in it are neighbours.
                found = group[codes]
                doc = np.repeat(np.arange(len(sizes)), sizes)[found >= 0]
                found = found[found >= 0]
                apart = np.r_[True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]
                docs = np.bincount(found[apart], minlength=len(first))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(first), pa.string()), prefixes.take(pa.array(first)), pa.array(docs, pa.int64()),
                ], ["lang", "prefix", "docs"])

    return segments.select("lang", "body").mapInArrow(count, PREFIXES)


def kept_terms(segments: DataFrame, least_docs: int, first_length: int = FIRST_LENGTH) -> DataFrame:
    """(lang, prefix): the complete terms in at least ``least_docs`` documents of their language, with END.

    Prefix lengths double from ``first_length`` on, so their number grows with the logarithm of
    the longest term. A document is in one segment, so the documents of a prefix are added up over segments. The prefixes
    kept go to all tasks if they are few (see LISTED_BYTES); otherwise a Bloom filter of them does, and what it lets
    through in error goes by a join of the sums.
    """
    complete, length, going, above = None, first_length, None, 0
    while True:
        listed, exact = (None, True) if going is None else _listed(going)
        level = prefix_counts(segments, length, listed, above)
        sums = level.groupBy("lang", "prefix").agg(F.sum("docs").alias("n")).filter(F.col("n") >= least_docs)
        if not exact:
            shorter = going.select("lang", F.col("prefix").alias("shorter"))
            sums = sums.withColumn("shorter", F.substring("prefix", 1, above)).join(shorter, ["lang", "shorter"], "left_semi")
        kept = settle(sums.select("lang", "prefix", F.expr("right(hex(prefix), 2) = '00'").alias("complete")))
        whole = kept.filter("complete").select("lang", "prefix")
        complete = whole if complete is None else complete.unionByName(whole)
        going = kept.filter("NOT complete").select("lang", "prefix")
        if going.isEmpty():
            return complete
        above, length = length, length * 2


def source_counts(segments: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms of :func:`kept_terms`, where there are any."""
    listed, exact = _listed(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, sources = batch.column("lang")[i].as_py(), batch.column("sources")[i].values
                held, *others = _arrays(batch.column("body")[i], *BODY)
                sizes, codes, counts, source_of = (x.to_numpy() for x in others)
                source = np.repeat(source_of, sizes).astype(np.int64)
                at = _among(_ended(held), listed.value, lang)[codes]
                codes, counts, source = codes[at], counts[at], source[at]
                # Sorted cells, each with the sum of its run.
                cells = source * max(len(held), 1) + codes
                order = np.argsort(cells, kind="stable")
                cells, counts = cells[order], counts[order].astype(np.int64)
                starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]][: len(cells)])
                cell, n = cells[starts], np.add.reduceat(counts, starts) if len(starts) else counts
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(cell), pa.string()), sources.take(pa.array(cell // max(len(held), 1))),
                    held.take(pa.array(cell % max(len(held), 1))).cast(pa.string()), pa.array(n),
                ], ["lang", "source", "term", "n"])

    cells = segments.select("lang", "sources", "body").mapInArrow(count, "lang string, source string, term string, n long")
    sums = cells.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    if not exact:
        whole = F.expr("substring(prefix, 1, length(prefix) - 1)").cast("string").alias("term")
        sums = sums.join(terms.select("lang", whole), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")
    return settle(sums)


def share(n: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10 ** 9 * (n + 5) / (total + 5 * kinds)), exact for any counts."""
    over = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + F.lit(5)).cast("decimal(20,0)")
    under = (total + F.lit(5) * kinds).cast("decimal(20,0)")
    return F.call_function("div", over, under).cast("long") + 1


def _pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language abs(p - q) summed over its kept terms.

    Terms are dealt into buckets and sources into blocks, and a task has the terms of one bucket
    for two blocks. A term that neither source has is not looked at: it adds the difference of
    their shares at count 0.
    """
    order = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    blocks = groups.withColumn("block", F.floor(order / PAIR_SOURCES).cast("int"))
    blocks = settle(blocks.withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1).withColumn(
        "buckets", F.ceil(F.col("kinds") / PAIR_TERMS).cast("int")
    ))
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")
    shared = ["lang", "source", "block", "blocks"]
    rows = cells.join(blocks.select(*shared, "buckets"), ["lang", "source"]).select(*shared, bucket.alias("bucket"), "term", "p")
    # Each source is in each bucket with its share at count 0, under no term.
    none = F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")
    markers = blocks.filter("buckets > 0").select(*shared, none, F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(
        F.least("block", b).alias("a"), F.greatest("block", b).alias("b")
    ))
    dealt = rows.unionByName(markers).withColumn("pair", F.explode(other)).select("lang", "bucket", "pair.*", "block", "source", "term", "p")

    def differ(told: pa.Table) -> pa.Table:
        frame = told.to_pandas()
        marks = frame[frame["term"].isna()].sort_values(["block", "source"])
        found = frame[frame["term"].notna()]
        names = marks["source"].to_numpy()
        row = dict(zip(names, range(len(names)), strict=True))
        column, terms = found["term"].factorize()
        p = np.repeat(marks["p"].to_numpy()[:, None], len(terms), 1)
        p[[row[s] for s in found["source"]], column] = found["p"].to_numpy()
        a, b = told.column("a")[0].as_py(), told.column("b")[0].as_py()
        block = marks["block"].to_numpy()
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        sums = np.stack([np.abs(p[right] - p[i]).sum(1) for i in left]) if len(left) else np.zeros((0, len(right)), np.int64)
        source, item = np.repeat(names[left], len(right)), np.tile(names[right], len(left))
        if a != b:
            source, item, sums = np.r_[source, item], np.r_[item, source], np.r_[sums.ravel(), sums.ravel()]
        n = len(source)
        return pa.table({
            "lang": pa.array([told.column("lang")[0].as_py()] * n, pa.string()), "source": pa.array(source, pa.string()),
            "item": pa.array(item, pa.string()), "part_sum": pa.array(sums.ravel(), pa.int64()),
            "seen": pa.array(np.full(n, len(terms)), pa.int64()),
        })

    sums = dealt.groupBy("lang", "bucket", "a", "b").applyInArrow(
        differ, "lang string, source string, item string, part_sum long, seen long"
    ).groupBy("lang", "source", "item").agg(F.sum("part_sum").alias("part_sum"), F.sum("seen").alias("seen"))
    p0 = blocks.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = blocks.select("lang", "source", "p0", "kinds").join(p0, "lang").filter("source != item")
    rest = (F.col("kinds") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("p0") - F.col("q0"))
    value = F.when(F.col("kinds") == 0, F.lit(0)).otherwise(F.coalesce("part_sum", F.lit(0)) + rest)
    return pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", value.cast("long").alias("value"))


def audit(
    df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 30,
    top: int = 50, segment_bytes: int = SEGMENT_BYTES, first_length: int = FIRST_LENGTH,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others.

    Kept terms are those in at least ``least_docs`` documents of the language. A group (a source of a
    language, or the language) gives a kept term that occurs n times in it the share p = :func:`share`.
    Part ``pair`` has, for each other source, the absolute differences of shares summed over
    all kept terms (0 where there are none); part ``term`` the ``top`` kept terms that the source has
    and gives more than the language does, with the difference. Ranks run from 1, the greatest
    value first, ties in order of the item's bytes.

    Null texts, languages and sources count as ''. Repeated rows are documents of their own. Sources
    without terms are groups; a language with one source has no pairs. Very long terms take more
    prefix lengths. An empty table gives an empty result; other columns are not looked at.
    """
    segments = build_segments(df, lang, source, text, segment_bytes)
    terms = settle(kept_terms(segments, least_docs, first_length))
    counts = source_counts(segments, terms)
    kinds = terms.groupBy("lang").agg(F.count("*").alias("kinds"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = segments.select("lang", F.explode("sources").alias("source")).distinct()
    zero = F.lit(0).cast("long")
    groups = known.join(kinds, "lang", "left").join(sizes, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("kinds", zero).alias("kinds"), F.coalesce("total", zero).alias("total")
    )
    least = F.when(F.col("kinds") > 0, share(zero, F.col("total"), F.col("kinds")))
    groups = settle(groups.withColumn("p0", least))
    cells = settle(counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), "n", "kinds"
    ))
    pairs = _pair_sums(cells, groups).withColumn("part", F.lit("pair"))

    totals = sizes.groupBy("lang").agg(F.sum("total").alias("total"))
    of_lang = cells.groupBy("lang", "term", "kinds").agg(F.sum("n").alias("n")).join(totals, "lang").select(
        "lang", "term", share(F.col("n"), F.col("total"), F.col("kinds")).alias("q")
    )
    above = cells.join(of_lang, ["lang", "term"]).filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = above.withColumn("rank", rank).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(columns).unionByName(best.select(columns))
