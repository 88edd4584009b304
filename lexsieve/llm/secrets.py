"""Secret scans: known forms, and strings whose characters look drawn at random.

Three base forms are found by pattern. Beyond them, candidate strings (long runs of
characters that tokens are made of) are searched with a sliding window: the Shannon entropy
of the window's characters is kept up to date by the counts of the character that leaves
and the one that enters. Windows at or above the threshold of the candidate's character
class become spans, unless the candidate is of an allowed form.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexsieve.llm.common import code_points, let, named, packed, unpacked

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A run of the last class is taken whole or not at all, so its least length can stand in
# the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
ASSIGN_LEAST = 6

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
# Character class of a candidate -> bits at which a window counts as random. The first
# class that fits holds.
CLASSES = [
    (r"^[0-9A-Fa-f]+$", 3.0),
    (r"^[A-Za-z]+$", 4.1),
    (r"^", 3.7),
]
ALLOWED = [
    r"^[0-9_=+/-]+$",  # numbers and rulers
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",  # UUIDs
    # Words and paths: pieces of letters, then three digits at most. It says what may not stand
    # in one, as a repeated group would recurse once for each piece.
    r"^(?!.*(?:\+|[0-9]{4}|(?<![A-Za-z0-9])[0-9]|[0-9][A-Za-z]))(?=[/_-]?[A-Za-z])(?=.*[A-Za-z0-9][/_=-])",
    r"^(.{1,8}?)\1+$",  # one short piece again and again
]
# c * log2(c) in units of 2 ** -30: whole numbers, so a running sum stays exact.
UNIT = 2**30

SPAN = "array<struct<start:int,end:int>>"


def _positions(found: Column, pieces: Column, keep=None) -> Column:
    """Spans of the matches, from the matched strings and the pieces between them."""

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(pieces, i))
        end = start + F.length(F.get(found, i))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.concat(state["spans"], span)
        if keep is not None:
            spans = F.when(keep(i), spans).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step)["spans"]


def pattern_spans(text: Column, pattern: str) -> Column:
    """Spans (code points) of all matches, leftmost first, not overlapping."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("pieces")),
                lambda x: _positions(x["found"], x["pieces"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def assign_spans(text: Column) -> Column:
    """Spans of assignments whose value has ASSIGN_LEAST characters or more."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)).alias("found"),
        F.split(text, ASSIGN, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)).alias("values"),
    )
    spans = let(found, lambda x: _positions(
        x["found"], x["pieces"], lambda i: F.length(F.get(x["values"], i)) >= ASSIGN_LEAST
    ))
    return F.when(text.rlike(ASSIGN), spans).otherwise(F.array().cast(SPAN))


def _weights() -> Column:
    return F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0).cast("long") for c in range(WINDOW + 1)])


def _most(bits: float) -> int:
    """The largest sum of c * log2(c), in units, at which a window has so many bits."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def random_windows(candidate: Column, classes: Sequence[tuple[str, float]] = CLASSES) -> Column:
    """Spans inside a candidate: its windows of high entropy, overlapping ones joined."""
    most = F.lit(_most(classes[-1][1]))
    for pattern, bits in reversed(classes[:-1]):
        most = F.when(candidate.rlike(pattern), F.lit(_most(bits))).otherwise(most)
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def search(x: Column) -> Column:
        codes, weights = x["codes"], x["weights"]
        window = F.slice(codes, 1, WINDOW)
        counts = F.transform(
            F.sequence(F.lit(0), F.lit(len(ALPHABET) - 1)),
            lambda a: F.size(F.filter(window, lambda c: c == a)),
        )

        def joined(spans: Column, at: Column, total: Column) -> Column:
            last = F.get(spans, F.size(spans) - 1)
            new = F.struct(at.cast("int").alias("start"), (at + WINDOW).cast("int").alias("end"))
            longer = F.struct(last["start"].alias("start"), (at + WINDOW).cast("int").alias("end"))
            return (
                F.when(total > x["most"], spans)
                .when((F.size(spans) > 0) & (last["end"] >= at),
                      F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(longer)))
                .otherwise(F.concat(spans, F.array(new)))
            )

        def step(state: Column, i: Column) -> Column:
            gone, come = F.get(codes, i - 1), F.get(codes, i + WINDOW - 1)
            counts = F.transform(
                state["counts"],
                lambda n, a: n - (a == gone).cast("int") + (a == come).cast("int"),
            )
            old, new = F.get(state["counts"], gone), F.get(state["counts"], come)
            change = (
                F.get(weights, old - 1) - F.get(weights, old) + F.get(weights, new + 1) - F.get(weights, new)
            )
            total = state["total"] + F.when(gone == come, F.lit(0)).otherwise(change)
            return F.struct(
                counts.alias("counts"), total.alias("total"),
                joined(state["spans"], i, total).alias("spans"),
            )

        def begin(y: Column) -> Column:
            first = F.aggregate(y, F.lit(0).cast("long"), lambda s, n: s + F.get(weights, n))
            return let(first, lambda total: F.struct(
                y.alias("counts"), total.alias("total"),
                joined(F.array().cast(SPAN), F.lit(0), total).alias("spans"),
            ))

        steps = F.filter(F.sequence(F.lit(0), F.size(codes) - WINDOW), lambda i: i > 0)
        return F.aggregate(steps, let(counts, begin), step)["spans"]

    return let(
        F.struct(codes.alias("codes"), _weights().alias("weights"), most.cast("long").alias("most")), search
    )


def entropy_spans(text: Column, allowed: Sequence[str] = ALLOWED) -> Column:
    """Spans of random-looking windows in the candidate strings of a text."""
    accepted = F.lit(False)

    def windows(x: Column) -> Column:
        def one(span: Column) -> Column:
            candidate = F.substring(text, span["start"] + 1, span["end"] - span["start"])

            def inside(c: Column) -> Column:
                passes = accepted
                for pattern in allowed:
                    passes = passes | c.rlike(pattern)
                found = F.transform(random_windows(c), lambda s: F.struct(
                    (span["start"] + s["start"]).alias("start"), (span["start"] + s["end"]).alias("end")
                ))
                return F.when(passes, F.array().cast(SPAN)).otherwise(found)

            return let(candidate, inside)

        return F.flatten(F.transform(x, one))

    return let(pattern_spans(text, CANDIDATE), windows)


def scan_secrets(
    df: DataFrame, text: str = "text", allowed: Sequence[str] = ALLOWED
) -> DataFrame:
    """All rows with ``secrets``: array of (start, order, end), sorted, ends exclusive, in code
    points; ``order`` is the place of the kind in KINDS.

    Spans of different kinds may overlap; an entropy span inside a base span is left out as
    it tells nothing new. There is no shuffle and no state between rows. Null and empty texts
    have no secrets; a column named ``secrets`` gives way.
    """
    rows = packed(df, ["secrets"], text=code_points(named(text)))
    rows = rows.select(
        "row", "text",
        assign_spans(F.col("text")).alias("assign"),
        pattern_spans(F.col("text"), ACCESS).alias("access"),
        pattern_spans(F.col("text"), HEX).alias("hex"),
        entropy_spans(F.col("text"), allowed).alias("entropy"),
    )

    def marked(kind: str, spans: Column) -> Column:
        order = F.lit(KINDS.index(kind))
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), order.alias("order"), s["end"].alias("end")
        ))

    base = F.concat(*[marked(kind, F.col(kind)) for kind in KINDS[:-1]])
    told = let(base, lambda b: F.concat(b, F.filter(
        marked("entropy", F.col("entropy")),
        lambda s: ~F.exists(b, lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"])),
    )))
    return unpacked(rows, F.array_sort(told).alias("secrets"))


def span_list(secrets: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(
        ":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def redacted(text: Column, secrets: Column, mask: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping secrets put as one mask."""

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        apart = s["start"] >= state["at"]
        out = F.when(apart, F.concat(state["out"], between, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(secrets, start, step, lambda state: F.concat(
        state["out"], F.substring(text, state["at"] + 1, F.length(text))
    ))
    return F.when(F.size(secrets) > 0, masked).otherwise(text)
