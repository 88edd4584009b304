"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one holds the words of toxic texts that stand out
against ordinary ones, the other the most common ordinary words. A text is compressed window
by window with both; how many bytes the toxic dictionary saves is the window's distance.
Calibrated thresholds on these distances give a score.

A window is one word with its edges, each letter written as four bytes: a match costs a
compressor about eight bytes, which a short word would not outweigh.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from lexsieve.llm.common import code_points, named, packed, unpacked

# Letters of one word; a longer run is cut into several windows.
WINDOW = re.compile(r"[^\W\d_]{1,32}")
SPARK_WINDOW = r"\p{L}{1,32}"
KNOWN_WINDOWS = 300_000
LEVEL = 6
# Saved bytes from which on a window counts, one count for each bound.
BOUNDS = (6, 9, 12, 15, 18)
TOPS = 3
FOLDS = 3


def spelled(text: str) -> bytes:
    """Four bytes a letter, scattered so that letters have nothing in common."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return (codes * np.uint32(2_654_435_761)).tobytes()


def _compressor(words: list[str]) -> zstandard.ZstdCompressor:
    content = spelled(" ".join(["", *words, ""]))
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=64, dict_size=len(content), write_content_size=False,
        write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


@dataclass
class Model:
    """Words of both dictionaries, best last, and the calibration.

    ``share`` is that of toxic rows among all usable labels: a score above it says that a text's
    words make the label likelier than it is without them.
    """

    toxic: list[str]
    ordinary: list[str]
    weights: list[float] = field(default_factory=list)
    share: float = 0.0

    def evidence(self, odds: float) -> float:
        """The score at which a text's words make the label's odds ``odds`` times what they are without."""
        raised = odds * self.share
        return raised / (raised + 1 - self.share) if self.weights else 0.5

    def open(self) -> Model:
        self.compressors = _compressor(self.ordinary), _compressor(self.toxic)
        self.known: dict[str, int] = {}
        return self

    def distances(self, text: str) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window of the whole text."""
        windows = WINDOW.findall(text.lower())
        if len(self.known) > KNOWN_WINDOWS:
            self.known.clear()
        ordinary, toxic = self.compressors
        for w in set(windows).difference(self.known):
            data = spelled(f" {w} ")
            self.known[w] = len(ordinary.compress(data)) - len(toxic.compress(data))
        return np.fromiter(map(self.known.__getitem__, windows), np.int64, len(windows))

    def features(self, text: str) -> list[float]:
        """The greatest distances; for each bound the windows that reach it, as number, by the root of
        the text's length and by its length; and the length."""
        d = self.distances(text)
        n = max(len(d), 1)
        top = np.r_[np.sort(np.maximum(d, 0))[::-1][:TOPS], np.zeros(TOPS)][:TOPS]
        hits = np.array([(d >= bound).sum() for bound in BOUNDS], float)
        counts = np.r_[np.log1p(hits), hits / n**0.5, np.log1p(100 * hits / n), np.log1p(n)]
        return [*top.tolist(), *counts.tolist()]

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(features))
        n = features.shape[1]
        w = np.array(self.weights)
        scaled = (features - w[:n]) / w[n : 2 * n]
        return 1 / (1 + np.exp(-np.clip(w[2 * n] + scaled @ w[2 * n + 1 :], -30, 30)))

    def calibrate(
        self, features: np.ndarray, labels: np.ndarray, counts_for: np.ndarray, ridge: float = 1.0
    ) -> None:
        """Logistic weights by Newton's steps; none if a class is missing. ``counts_for`` is the number
        of labelled rows that each row stands for."""
        if len(set(labels.tolist())) < 2:
            return
        self.share = float(counts_for @ labels / counts_for.sum())
        weight = counts_for / counts_for.mean()
        mean, spread = features.mean(0), features.std(0) + 1e-6
        x = np.c_[np.ones(len(features)), (features - mean) / spread]
        w = np.zeros(x.shape[1])
        keep = ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (weight * (p - labels)) + keep @ w
            step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + keep, slope)
            w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        self.weights = [*mean.tolist(), *spread.tolist(), *w.tolist()]


def held_out(key: Column) -> Column:
    """Whether a row's label is kept for the test: crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    most_rows: int = 6_000, most_words: int = 4_000, lift: float = 20.0, least_share: float = 0.006,
    seed: int = 5,
) -> Model:
    """Dictionaries and calibration from labelled rows that are not held out.

    The labels are sampled by a hash of their ids: at most ``most_rows`` rows of each class, a bound
    that does not grow with the corpus (nor, then, do the words of those rows, the dictionaries of
    at most ``most_words`` words and what reaches the driver). In the calibration each row counts
    for as many as there are usable labels of its class for one in the sample, so that scores keep
    their meaning where the bound cuts one class and not the other. Of rows with the same id the one
    with the least text digest is taken.

    Each row is calibrated on dictionaries made without its third of the sample; the final
    dictionaries are of the whole sample. A word stands out if it is in ``least_share`` of the toxic
    rows, in three at least, and its share there is ``lift`` times that among ordinary rows.
    """
    chance = F.xxhash64(F.lit(seed), "id")
    usable = labels.select(named(key).alias("id"), named(label).cast("int").alias("toxic")).filter(
        F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("id"))
    ).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = usable.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    parts = [usable.filter(F.col("toxic") == c).orderBy(chance, "id").limit(most_rows) for c in (0, 1)]
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(FOLDS)).cast("int")
    sample = parts[0].unionByName(parts[1]).withColumn("fold", fold)
    rows = df.select(named(key).alias("id"), code_points(named(text)).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("id", "toxic", "fold").agg(F.min_by("text", F.md5("text")).alias("text")).persist()

    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(SPARK_WINDOW), F.lit(0)))
    cells = [(c, k) for c in (0, 1) for k in range(FOLDS)]

    def told(c: int, k: int) -> Column:
        return F.count_if((F.col("toxic") == c) & (F.col("fold") == k))

    sizes = rows.agg(*[told(c, k) for c, k in cells]).first()
    size = dict(zip(cells, sizes, strict=True))
    counts = rows.select("toxic", "fold", F.explode(words).alias("word")).groupBy("word").agg(
        *[told(c, k).alias(f"n{c}{k}") for c, k in cells]
    ).persist()

    def without(left_out: int | None) -> Model:
        """Dictionaries of all folds but one."""
        used = [k for k in range(FOLDS) if k != left_out]
        toxic, ordinary = (sum(F.col(f"n{c}{k}") for k in used) for c in (1, 0))
        n_toxic, n_ordinary = (sum(size[c, k] for k in used) for c in (1, 0))
        share, usual = (toxic + 0.5) / (n_toxic + 1), (ordinary + 0.5) / (n_ordinary + 1)
        standing = counts.filter((toxic >= max(3.0, least_share * n_toxic)) & (share >= lift * usual))
        best = [r["word"] for r in standing.orderBy(F.desc(toxic), "word").limit(most_words).collect()]
        seen = counts.filter(toxic + ordinary > 0).orderBy(F.desc(ordinary), "word")
        common = [r["word"] for r in seen.limit(max(len(best), 1)).collect()]
        # The end of a dictionary is nearest to the window, so the best words come last.
        return Model(best[::-1], common[::-1])

    models = [without(k) for k in range(FOLDS)]
    model = without(None)

    def features(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = [m.open() for m in models]
        for batch in texts:
            found = [opened[k].features(t) for k, t in zip(batch["fold"], batch["text"], strict=True)]
            yield pd.DataFrame({"toxic": batch["toxic"], "f": found})

    measured = rows.select("toxic", "fold", "text").mapInPandas(features, "toxic int, f array<double>").collect()
    counts.unpersist()
    rows.unpersist()
    if measured:
        stands_for = [n / max(1, min(n, most_rows)) for n in known]
        model.calibrate(
            np.array([r["f"] for r in measured]), np.array([r["toxic"] for r in measured], float),
            np.array([stands_for[r["toxic"]] for r in measured]),
        )
    return model


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All rows with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Every window of the whole text counts. Null and empty texts are texts without windows;
    without labels of both classes every score is 0. No shuffle; columns of the outputs' names
    give way.
    """

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        opened = model.open()
        for series in texts:
            found = [opened.features(t) for t in series]
            yield pd.Series(opened.score(np.array(found)) if found else np.zeros(0))

    rows = packed(df, ["score", "predicted"], text=code_points(named(text)))
    rows = rows.withColumn("score", scores("text"))
    return unpacked(rows, "score", (F.col("score") >= threshold).cast(IntegerType()).alias("predicted"))
