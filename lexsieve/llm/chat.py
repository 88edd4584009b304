r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and
its reply alone is trainable. A conversation that does not end with an assistant's turn
has one example more, whole and without a trainable part, so that no turn is lost.

Template of a turn: ``<turn ROLE>\nTEXT</turn>\n``. Inside roles and texts ``\``, ``<``
and ``>`` are written ``\b``, ``\l`` and ``\g``; so a mark of the template cannot occur in
them, and reading back is exact.

Two forms: :func:`format_chats` expands each example to one value, which grows with the square of a
conversation; :func:`format_parts` writes every turn once, and an example is a number of turns and a
span of code points over them, so it grows with the turns. :func:`by_size` tells which conversations
can be expanded; only those that cannot are left as parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexsieve.llm.common import code_points, named, parallelism
from lexsieve.sources.shared import settle

ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]
OPEN, HEAD_END, CLOSE = "<turn ", ">\n", "</turn>\n"
# Code points that all examples of a conversation may have if each is to be one value.
EXPANDED_CHARS = 1 << 26


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    """Each backslash of an escaped text starts a pair, so the pairs can be undone one
    kind at a time if the backslash itself comes last."""
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars), one row per example.

    ``example`` counts from 0 in a conversation. The trainable part are ``loss_chars`` code
    points from ``loss_start`` (from 0) on: the escaped reply. Both are null in an example
    without one.

    Turns are ordered by turn, then role and text; null turns come first, null roles and
    texts are empty, rows with a null conversation are one conversation, repeated rows are
    repeated turns. An example is one value and holds its whole prefix, so a conversation must
    fit in a value: that is this form's own bound; :func:`format_parts` has none. Extra columns are
    left out.
    """
    written = F.concat(
        F.lit(OPEN), escape(code_points(named(role))), F.lit(HEAD_END),
        escape(code_points(named(text))), F.lit(CLOSE),
    )
    rows = df.select(
        named(conv).alias("conv_id"),
        F.struct(
            named(turn).alias("turn"),
            code_points(named(role)).alias("role"),
            code_points(named(text)).alias("text"),
            written.alias("written"),
        ).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    lengths = F.transform("turns", lambda t: F.length(t["written"]))
    ends = F.transform("turns", lambda t, i: F.when(t["role"] == target, i + 1))
    last = F.size("turns")
    ends = F.filter(ends, lambda e: e.isNotNull())
    examples = talks.withColumn("lengths", lengths).withColumn(
        "ends", F.when(F.get("turns", last - 1)["role"] == target, ends).otherwise(
            F.concat(ends, F.array(last))
        )
    )
    # An expression, not a column, is exploded: for a column Spark adds a filter on its size,
    # which would work out the array twice.
    each = examples.select(
        "conv_id", "turns", F.posexplode(F.transform("ends", lambda e: e)).alias("example", "end")
    )
    prefix = F.slice("turns", F.lit(1), F.col("end"))
    final = F.get("turns", F.col("end") - 1)
    formatted = F.array_join(F.transform(prefix, lambda t: t["written"]), "")
    reply = F.when(final["role"] == target, F.length(escape(final["text"])))
    return each.select(
        "conv_id", "example", formatted.alias("formatted"), reply.cast("long").alias("loss_chars")
    ).select(
        "conv_id", "example", "formatted",
        (F.length("formatted") - len(CLOSE) - F.col("loss_chars")).alias("loss_start"), "loss_chars",
    )


def by_size(
    df: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text", target: str = "assistant",
    most: int = EXPANDED_CHARS,
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations to expand, and those of conversations whose examples may have more than
    ``most`` code points in all; None if there are none of these.

    Each example is counted as the whole conversation, so no value that is built is longer than ``most``.
    """
    chars = F.length(escape(code_points(named(role)))) + F.length(escape(code_points(named(text))))
    examples = F.count_if(code_points(named(role)) == target) + 1
    sizes = df.groupBy(named(conv).alias("large_id")).agg(
        (F.sum(chars.cast("long") + len(OPEN + HEAD_END + CLOSE)) * examples).alias("chars")
    )
    large = settle(sizes.filter(F.col("chars") > most).select("large_id"))
    if large.isEmpty():
        return df, None
    same = named(conv).eqNullSafe(F.col("large_id"))
    return df.join(large, same, "left_anti"), df.join(large, same, "left_semi")


def format_parts(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    target: str = "assistant",
) -> DataFrame:
    """(conv_id, range, turn_no, written, start, example, loss_start, loss_chars), one row per turn.

    The text of an example, as in :func:`format_chats`, is that of ``written`` of all turns of the
    conversation up to the row where ``example`` is not null, ``start`` + length(written) code points;
    ``loss_start`` and ``loss_chars`` are its trainable part. ``turn_no`` and ``start`` count from 0.
    Order and nulls are those of :func:`format_chats`.

    Turns are dealt out in ranges by their order and numbered in their ``range``; what a conversation has
    in the ranges before it is added. So no task sees a whole conversation, and equal turns are
    spread too. The sums of conversations over several ranges are broadcast: two rows a range, and
    one more for each range that one conversation fills.
    """
    order = ["turn", "role", "text", "tie"]
    rows = df.select(
        named(conv).alias("conv_id"), named(turn).alias("turn"), code_points(named(role)).alias("role"),
        code_points(named(text)).alias("text"), F.monotonically_increasing_id().alias("tie"),
    )
    dealt = settle(
        rows.repartitionByRange(parallelism(df.sparkSession), "conv_id", *order)
        .withColumn("range", F.spark_partition_id())
    )
    written = F.concat(
        F.lit(OPEN), escape(F.col("role")), F.lit(HEAD_END), escape(F.col("text")), F.lit(CLOSE)
    )
    sized = dealt.withColumn("written", written).withColumn("chars", F.length("written").cast("long")).withColumn(
        "is_target", (F.col("role") == target).cast("long")
    )
    sums = sized.groupBy("conv_id", "range").agg(
        F.count("*").alias("n"), F.sum("chars").alias("c"), F.sum("is_target").alias("e")
    )
    whole = Window.partitionBy("conv_id").orderBy("range")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    spans = settle(sums.select(
        F.col("conv_id").alias("span_id"), F.col("range").alias("span_range"),
        *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"before_{x}") for x in "nce"],
        F.lead("range").over(whole).isNotNull().alias("goes_on"),
    ).filter("goes_on or before_n > 0"))
    inside = Window.partitionBy("conv_id", "range").orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = sized.select(
        "*", (F.row_number().over(inside) - 1).alias("n"), F.coalesce(F.sum("chars").over(so_far), F.lit(0)).alias("c"),
        F.coalesce(F.sum("is_target").over(so_far), F.lit(0)).alias("e"),
        F.lead("tie").over(inside).isNull().alias("last"),
    )
    placed = numbered.join(
        F.broadcast(spans),
        (F.col("range") == F.col("span_range")) & F.col("conv_id").eqNullSafe(F.col("span_id")), "left",
    )
    n, c, e = (F.col(x) + F.coalesce(F.col(f"before_{x}"), F.lit(0)) for x in "nce")
    ends = (F.col("is_target") == 1) | (F.col("last") & ~F.coalesce("goes_on", F.lit(False)))
    reply = F.when(F.col("is_target") == 1, F.length(escape(F.col("text"))).cast("long"))
    return placed.select(
        "conv_id", "range", n.alias("turn_no"), "written", c.alias("start"), F.when(ends, e).alias("example"),
        (c + F.col("chars") - len(CLOSE) - reply).alias("loss_start"), reply.alias("loss_chars"),
    )


def read_parts(parts: DataFrame) -> DataFrame:
    """(conv_id, range, turn_no, role, text, loss, formatted_chars), one row per turn, read back from
    the written turns alone.

    ``loss`` is the trainable text and ``formatted_chars`` the length of the example that ends there.
    """
    turn = read_turn(F.substring("written", F.lit(1), F.length("written") - len(CLOSE)))
    end = F.col("start") + F.length("written")
    return parts.withColumn("turn", turn).select(
        "conv_id", "range", "turn_no", "turn.role", "turn.text",
        read_loss(F.col("written"), F.col("loss_start") - F.col("start"), F.col("loss_chars")).alias("loss"),
        F.when(F.col("example").isNotNull(), end).alias("formatted_chars"),
    )


def joined_in_order(read: DataFrame, **columns: Column) -> DataFrame:
    """One row per conversation of :func:`read_parts`: n_turns, formatted_chars, and each of the text
    ``columns`` of its turns as one value, null ones left out.

    Turns are put together in their ranges first, so what the last task has of a conversation is a
    row for each range. A conversation of which such a value is asked must fit in one.
    """
    names = list(columns)
    told = read.select("conv_id", "range", "turn_no", "formatted_chars", *[c.alias(k) for k, c in columns.items()])

    def put(df: DataFrame, keys: list[str], place: str, n: Column) -> DataFrame:
        found = df.groupBy(*keys).agg(
            n.alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
            F.sort_array(F.collect_list(F.struct(place, *names))).alias("all"),
        )
        return found.select(
            *keys, "n_turns", "formatted_chars", *[F.array_join(F.col("all")[k], "").alias(k) for k in names]
        )

    each = put(told, ["conv_id", "range"], "turn_no", F.count("*"))
    return put(each, ["conv_id"], "range", F.sum("n_turns"))


def read_turn(piece: Column) -> Column:
    """(role, text) from a written turn without its end."""
    head = F.instr(piece, F.lit(">"))
    return F.struct(
        unescape(F.substring(piece, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(piece, head + len(HEAD_END), F.length(piece))).alias("text"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) from a formatted text."""
    pieces = F.split(formatted, CLOSE, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), read_turn)


def read_loss(formatted: Column, start: Column, chars: Column) -> Column:
    """The trainable text of an example, unescaped; null if it has none."""
    return unescape(F.substring(formatted, (start + 1).cast("int"), chars.cast("int")))


def read_chats(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, losses, formatted_chars), read back from the examples alone.

    ``turns`` is an array of (role, text) from the longest example, ``losses`` the trainable
    texts in order.
    """
    loss = read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    told = F.when(F.col("loss_chars").isNotNull(), F.struct("example", loss.alias("text")))
    return examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(told)).alias("told"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    ).select(
        "conv_id", read_turns(F.col("whole")).alias("turns"),
        F.transform("told", lambda t: t["text"]).alias("losses"), "formatted_chars",
    )


def read_back(df: DataFrame, turn: Callable[[Column], Column], most: int = EXPANDED_CHARS) -> DataFrame:
    """(conv_id, n_turns, formatted_chars, whole, losses) of conversations, formatted and read back.

    ``turn`` makes the text to tell of a turn from its (role, text); ``whole`` and ``losses`` are
    these and the trainable texts, put together in order. Prefixes are expanded to examples, of
    conversations beyond ``most`` (see :func:`by_size`) told as spans.
    """
    small, large = by_size(df, most=most)
    each = read_chats(format_chats(small)).withColumn("n_turns", F.size("turns").cast("long"))
    told = each.select(
        "conv_id", "n_turns", "formatted_chars", F.array_join(F.transform("turns", turn), "").alias("whole"),
        F.array_join("losses", "").alias("losses"),
    )
    if large is None:
        return told
    parts = read_parts(format_parts(large))
    one = turn(F.struct("role", "text"))
    return told.unionByName(joined_in_order(parts, whole=one, losses=F.col("loss")))
