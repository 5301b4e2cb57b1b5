"""Line deduplication with per-document keep bitmaps.

Lines become 128-bit hashes of their keys.  The rows (hash, document, position) are
range-partitioned by hash and document and sorted by these and position within, so that
one hash, however frequent, spreads over many tasks, and each task streams the documents
of a hash in order: of the lines that a document has of a hash only the first goes on, to
be counted, and the first of the first is the one that stays.  What comes back per document
is a bitmap of kept lines in sparse 64-bit words, never text; ``apply_bitmaps`` turns it
into text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import WS, ascii_lower, materialize, maybe_broadcast, measured_join, quoted, unused

#: Rows up to which a table of a few numbers a row may be broadcast.
BROADCAST_ROWS = 200_000


def _text_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id; a null text is an empty one."""
    return F.xxhash64(F.lit(17), F.coalesce(text, F.lit("")))


def first_lines(lines: DataFrame) -> DataFrame:
    """Of rows (h1, h2, doc_id, k, pos) the first of each hash in each document, streamed in that order.

    The ranges of hash and document keep all rows of one hash and document together, so the
    window needs no exchange of its own, and a hash of many documents is in many ranges.
    """
    ranged = lines.repartitionByRange("h1", "h2", "doc_id")
    in_order = Window.partitionBy("h1", "h2", "doc_id").orderBy("k", "pos")
    return ranged.withColumn("nth", F.row_number().over(in_order)).filter("nth = 1").drop("nth")


def line_bitmaps(docs: DataFrame, *, min_docs: int = 2, min_chars: int = 1, keep: str = "first") -> DataFrame:
    """Which lines of each document to keep, as bitmaps.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points that occur in at least ``min_docs``
    documents are repeated; of these, ``keep="first"`` keeps the first occurrence
    (least doc_id, then least position) and ``keep="none"`` none.

    Returns doc_id, k, n_dropped, dropped: array of (word, bits), bit ``i`` of word
    ``w`` set if line ``64 * w + i`` goes; absent words mean that all 64 stay.  k tells apart
    rows that share a doc_id.  Documents that keep all lines have no row, so an empty table has
    none.  Null and empty texts are one empty line; very long texts and lines are read whole;
    rows repeated with one doc_id count as one document; null doc_ids are one document.
    """
    key = ascii_lower(F.trim(F.col("line"), F.lit(WS)))
    lines = (
        docs.select("doc_id", _text_key(F.col("text")).alias("k"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
        .withColumn("key", key)
        .filter(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc_id", "k", "pos")
    )
    lines = materialize(lines, "lines")
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "k", "pos")
    counted = [F.count(F.lit(1)).alias("n"), *([F.min(place).alias("first")] if keep == "first" else [])]
    repeated = first_lines(lines).groupBy("h1", "h2").agg(*counted).filter(F.col("n") >= min_docs)
    # Where the repeated keys are too many to be sent to all tasks, the lines of a frequent one stay where they are.
    hit = measured_join(lines, repeated, ["h1", "h2"], rows=BROADCAST_ROWS).drop("n")
    if keep == "first":
        # A key may repeat within its first document, too.
        hit = hit.filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k") == F.col("first.k")) & (F.col("pos") == F.col("first.pos"))))
    # Equal rows with equal doc_ids give equal bits, hence bit_or and not a sum.
    word = hit.groupBy("doc_id", "k", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return word.groupBy("doc_id", "k").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with text replaced by its kept lines, plus n_lines and n_dropped.

    All other columns stay, whatever their names; columns of ``docs`` named n_lines or n_dropped
    are replaced.  Null texts become empty ones; an empty table gives an empty one; repeated rows
    repeat.
    """
    cols = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    own, doc, k, n, bits, lines = (unused(x, docs) for x in ("own", "doc", "k", "n", "bits", "lines"))
    rows = docs.select(*[quoted(c) for c in cols], F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn(own, _text_key(F.col("text")))
    b = maybe_broadcast(bitmaps, BROADCAST_ROWS).select(F.col("doc_id").alias(doc), F.col("k").alias(k), F.col("n_dropped").alias(n), F.map_from_entries("dropped").alias(bits))
    out = rows.join(b, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(k)), "left")
    kept = F.filter(
        F.split("text", "\n", -1), lambda line, i: F.lit(1).cast("long") != F.getbit(F.coalesce(F.try_element_at(bits, (i / 64).cast("int")), F.lit(0).cast("long")), i % 64).cast("long")
    )
    n_lines = (F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = out.withColumn(lines, n_lines).withColumn("text", F.when(F.col(n).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    return out.select(*[quoted(c) for c in docs.columns if c in cols or c.lower() == "text"], F.col(lines).alias("n_lines"), F.coalesce(n, F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without its repeated lines; see ``line_bitmaps`` and ``apply_bitmaps``."""
    return apply_bitmaps(docs, line_bitmaps(docs, **how))
