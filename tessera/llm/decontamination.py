"""Benchmark decontamination: which documents contain which test items.

A containment search by MinHash, partitioned by item size.  Hashing orders all
shingles at random, and the least hashes of a set are its MinHash sample.  If a
document holds a share ``threshold`` of an item's ``n`` shingles, it lacks at most
``n - ceil(threshold * n)`` of them; so of the item's sample of that many least hashes
and one more, it holds one for certain.  Each size class thus has a sample size of its
own.  Items so short that their sample is one hash make a part of their own: that hash may
be any number, so no bound would hold anything back, and a shingle is looked up there only
if it is in the set of these hashes.  The other classes' samples lie below a bound, their
greatest hash, which is the lower the larger the items; of a document's shingles only those
below the greatest bound of a class that the document is long enough for are looked up there.  Long documents
cost nothing in accuracy, since the sample is the item's.  Candidates are verified on whole
shingle sets, as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ascii_lower, materialize, maybe_broadcast, unused, words

#: Rows up to which a table of hashes, or of candidates, may be broadcast.
BROADCAST_ROWS = 200_000
#: Hashes of the shortest items up to which they are a set in the plan; beyond it every shingle is looked up.
SHORT_SET = 10_000


def _hashes(ws: Column, width: int) -> Column:
    """Hashes of all shingles of ``width`` words in ``ws``, repeats included."""
    last = F.size(ws) - width
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(width), *[F.get(ws, i + j) for j in range(width)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def _strings(ws: Column, width: Column) -> Column:
    """All distinct shingles of ``width`` words as strings."""
    last = F.size(ws) - width
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(ws, i + 1, width), " "))
    return F.when(last >= 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def _probes(hashes: Column, sizes: list[tuple[int, int]], short: list[int] | None) -> Column:
    """Of a document's distinct shingle hashes those that are looked up.

    ``sizes`` has, for each class of longer items, the least number of shingles that a document
    with one of them has, and the bound of the samples; ``short`` are the hashes of the shortest items, or None if
    they are too many for a set.
    """
    all_ = F.array_distinct(hashes)
    if short is None:
        return all_

    def below(hs: Column) -> Column:
        bound = F.greatest(F.lit(-(2**63)), F.lit(-(2**63)), *[F.when(F.size(hs) >= n, F.lit(b)) for n, b in sizes])
        known = lambda h: h.isin(short) if short else F.lit(False)
        return F.get(F.transform(F.array(bound), lambda b: F.filter(hs, lambda h: (h <= b) | known(h))), F.lit(0))

    return F.get(F.transform(F.array(all_), below), F.lit(0))


def item_samples(items: DataFrame, *, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """item_id, width, shingles, n_shingles, size_class and sample (least hashes) per item.

    size_class is 0 for items whose sample is one hash, else the logarithm of their size.  Items
    of fewer than ``width`` words have their whole sequence as one shingle of that many words; items
    without words (null, empty or blank texts) have none and are left out.  Very long texts are read whole, repeated
    rows repeat, an empty table gives an empty one, further columns are ignored.
    """
    ws = items.select("item_id", words(ascii_lower(F.col("text"))).alias("_w")).filter(F.size("_w") > 0)
    ws = ws.withColumn("width", F.least(F.size("_w"), F.lit(width)))
    per_width = F.coalesce(*[F.when(F.col("width") == k, _hashes(F.col("_w"), k)) for k in range(1, width + 1)])
    out = ws.select("item_id", "width", _strings(F.col("_w"), F.col("width")).alias("shingles"), F.array_sort(F.array_distinct(per_width)).alias("_h"))
    n = F.size("_h")
    return out.select(
        "item_id",
        "width",
        "shingles",
        F.size("shingles").cast("long").alias("n_shingles"),
        F.when(n - F.ceil(n * F.lit(threshold) - 1e-9) < 1, F.lit(0)).otherwise(F.floor(F.log2(n))).cast("int").alias("size_class"),
        n.alias("n_hashes"),
        F.slice("_h", F.lit(1), n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1).alias("sample"),
    )


def contained_items(docs: DataFrame, items: DataFrame, *, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of documents and items of which they contain at least ``threshold`` of the shingles.

    Returns doc_id, item_id, n_shingles (of the item), n_shared, containment; the pair's
    highest count if several rows share a doc_id or an item_id.  Words are split at ASCII
    white space, A-Z lower-cased.  Null and empty texts contain nothing, very long ones are
    read whole; an empty table gives no pairs; repeated rows give the pairs of one; items with
    equal texts are items of their own.  Further columns of either table are ignored, whatever
    their names.
    """
    sampled = materialize(item_samples(items.select("item_id", "text"), width=width, threshold=threshold), "items")
    # A few numbers: for each width and size class the bound of its sample's hashes.
    need = F.ceil(F.col("n_hashes") * F.lit(threshold) - 1e-9)
    classes = sampled.groupBy("width", "size_class").agg(F.max(F.array_max("sample")).alias("bound"), F.min(need).alias("need")).collect()
    # A document that shares the least share of the smallest item of a class has that many shingles.
    bounds = {k: [(r.need, r.bound) for r in classes if r.width == k and r.size_class] for k in {r.width for r in classes}}
    shortest = sampled.filter("size_class = 0").select("width", F.col("sample")[0].alias("h")).distinct().limit(SHORT_SET + 1).collect()
    short = {k: [r.h for r in shortest if r.width == k] if len(shortest) <= SHORT_SET else None for k in bounds}
    keyed = docs.select("doc_id", "text", F.xxhash64(F.lit(17), "text").alias("_k"))
    ws = keyed.select("doc_id", "_k", words(ascii_lower(F.col("text"))).alias("_w"))
    found = [_probes(_hashes(F.col("_w"), k), b, short[k]) for k, b in sorted(bounds.items())]
    hashes = ws.select("doc_id", "_k", F.explode(F.concat(*found) if found else F.array().cast("array<bigint>")).alias("h"))
    lookup = sampled.select(F.explode("sample").alias("h"), "item_id").distinct()
    lookup = maybe_broadcast(lookup, BROADCAST_ROWS)
    pairs = hashes.join(lookup, "h").groupBy("doc_id", "_k", "item_id").count()
    pairs = materialize(pairs.select(F.col("doc_id").alias("_d"), F.col("_k").alias("_dk"), F.col("item_id").alias("_i")), "pairs")
    per_doc = pairs.groupBy("_d", "_dk").agg(F.collect_set("_i").alias("_items"))
    per_doc = maybe_broadcast(per_doc, BROADCAST_ROWS)
    texts = keyed.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_k").eqNullSafe(F.col("_dk")))
    texts = texts.select("doc_id", words(ascii_lower(F.col("text"))).alias("_w"), "_items")
    # A document's shingles are made once per width, whatever the number of its candidates.
    made = [_strings(F.col("_w"), F.lit(k)).alias(f"_s{k}") for k in sorted(bounds)] or [F.array().cast("array<string>").alias("_s0")]
    sides = texts.select("doc_id", "_items", *made).select("doc_id", F.explode("_items").alias("item_id"), *[f"_s{k}" for k in sorted(bounds) or [0]])
    own = maybe_broadcast(sampled.select("item_id", "width", "shingles", "n_shingles"), BROADCAST_ROWS // 20)
    shared = F.coalesce(*[F.when(F.col("width") == k, F.size(F.array_intersect("shingles", f"_s{k}"))) for k in sorted(bounds)], F.lit(0))
    scored = sides.join(own, "item_id").select("doc_id", "item_id", "n_shingles", shared.cast("long").alias("n_shared"))
    best = scored.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold - 1e-12)
    return best.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_shingles", "n_shared", "containment"), F.col("containment")).alias("_b")).select(
        "doc_id", "item_id", "_b.n_shingles", "_b.n_shared", "_b.containment"
    )


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay, whatever their names.

    Rows that share a doc_id go if one of them contains an item; null doc_ids are one document.
    Null, empty and very long texts, repeated rows and empty tables are taken as by ``contained_items``.
    """
    leak = unused("leak", docs)
    leaks = contained_items(docs, items, **how).select(F.col("doc_id").alias(leak)).distinct()
    leaks = maybe_broadcast(leaks, BROADCAST_ROWS)
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(leak)), "left_anti")
