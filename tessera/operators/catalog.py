"""The catalog of memories: listing, lookup, moving, merging, removing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def front_matter(files: DataFrame, *, text: str = "text") -> DataFrame:
    """``files`` with front (map of its front matter's plain fields, as text) and body."""
    t = F.col(text)
    has = t.rlike(r"(?s)\A---[ \t]*\r?\n.*?\n---[ \t]*(\r?\n|\z)")
    raw = F.when(has, F.regexp_extract(t, r"(?s)\A---[ \t]*\r?\n(.*?)\n---[ \t]*(\r?\n|\z)", 1)).otherwise("")
    # Lists written one item a line become the short form.
    flat = F.regexp_replace(raw, r"\n\s*-\s+", ", ")
    lines = F.filter(X.split_lines(flat), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    value = lambda x: F.regexp_replace(X.strip(F.regexp_replace(x, r"^[^:]*:\s*,?", "")), r"^([\"'])(.*)\1$", "$2")
    pairs = F.transform(lines, lambda x: F.struct(X.strip(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), value(x).alias("v")))
    # Of a key that comes twice the last counts.
    last = X.let(pairs, lambda ps: F.map_from_entries(F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.greatest(F.size(ps), F.lit(1))), lambda q: q["k"] == p["k"]))))
    return files.withColumn("front", last).withColumn("body", F.when(has, F.regexp_replace(t, r"(?s)\A---[ \t]*\r?\n.*?\n---[ \t]*(\r?\n|\z)\n*", "")).otherwise(t))


def tag_list(c: Column) -> Column:
    """Tags out of ``[a, b]`` or ``a, b``: quotes and blanks around them dropped, empty ones left out."""
    parts = F.split(F.regexp_replace(c, r"^[\[\]]+|[\[\]]+$", ""), ",")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(X.strip(x), r"^[\"']|[\"']$", "")), lambda x: x != "")


def catalog(files: DataFrame, *, path: str = "path", scope: str = "scope") -> DataFrame:
    """scope, slug, title, tags, path, created_at, updated_at, source and body of each memory file (with text)."""
    rows = front_matter(files)
    at = lambda k: F.try_element_at("front", F.lit(k))
    heading = F.nullif(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))
    slug = X.file_stem(F.col(path))
    return rows.select(
        scope, slug.alias("slug"), F.coalesce(heading, at("title"), slug).alias("title"), F.coalesce(tag_list(at("tags")), F.array().cast("array<string>")).alias("tags"), F.col(path).alias("path"),
        *[F.coalesce(at(k), F.lit("")).alias(k) for k in ("created_at", "updated_at", "source")], "body",
    )


def find(cat: DataFrame, slug: str, scope: str | None = None) -> DataFrame:
    """The memory of a slug: that of the global scope before the project's."""
    rows = cat.filter(F.col("slug") == slug)
    rows = rows if scope is None else rows.filter(F.col("scope") == scope)
    return rows.orderBy(F.when(F.col("scope") == "global", 0).otherwise(1), "scope", "path").limit(1)


def titles(cat: DataFrame, limit: int = 50) -> DataFrame:
    return cat.orderBy("path").limit(limit).select("path", "title")


def title_block(cat: DataFrame, shown: int = 30) -> DataFrame:
    """One text that lists the first titles and says how many more there are."""
    n = cat.agg(F.count(F.lit(1)).alias("_n"))
    some = cat.orderBy("path").limit(shown).agg(F.array_sort(F.collect_list(F.struct("path", "title"))).alias("_t"))
    lines = F.array_join(F.transform("_t", lambda x: F.concat(F.lit('  - "'), x["title"], F.lit('"'))), "\n")
    more = F.when(F.col("_n") > shown, F.concat(F.lit("\n  - … and "), (F.col("_n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    return some.crossJoin(n).select(F.when(F.col("_n") == 0, "  (none)").otherwise(F.concat(lines, more)).alias("block"))  # two tables of one row


def remove(cat: DataFrame, gone: DataFrame) -> DataFrame:
    """``cat`` without the memories in ``gone`` (scope, slug)."""
    return cat.join(gone.select("scope", "slug").distinct(), ["scope", "slug"], "left_anti")


def move(cat: DataFrame, slug: str, to: str) -> DataFrame:
    """``cat`` with the scope of one memory changed."""
    return cat.withColumn("scope", F.when(F.col("slug") == slug, to).otherwise(F.col("scope")))


def merge_groups(members: DataFrame, *keys: str, pos: str = "pos") -> DataFrame:
    """Per group title (the first), tags (union, sorted) and body (those that aren't blank, in order, parted by rules)."""
    b = X.strip(F.coalesce("body", F.lit("")))
    rows = members.select(*keys, pos, "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.when(b != "", F.struct(F.col(pos).alias("p"), b.alias("b"))).alias("_b"))
    return rows.groupBy(*keys).agg(
        F.min_by("title", pos).alias("title"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.array_join(F.transform(F.array_sort(F.collect_list("_b")), lambda x: x["b"]), "\n\n---\n\n").alias("body"), F.count(F.lit(1)).alias("n_sources")
    )


def merge(cat: DataFrame, slugs: list[str], *, title: str | None = None, scope: str | None = None) -> DataFrame:
    """``cat`` with the memories of ``slugs`` (two at least) made into one."""
    if len(slugs) < 2:
        raise ValueError("at least two slugs are needed")
    pos = F.array_position(F.array(*map(F.lit, slugs)), F.col("slug"))
    rank = F.when(F.col("scope") == "global", 0).otherwise(1)
    chosen = cat.filter(F.col("slug").isin(slugs)).groupBy("slug").agg(F.min_by(F.struct(*cat.columns), rank).alias("m")).select("m.*").withColumn("pos", pos)
    if chosen.count() < len(set(slugs)):
        raise ValueError("not all memories exist")
    one = merge_groups(chosen).crossJoin(chosen.filter("pos = 1").select(F.col("scope").alias("_scope"), F.col("path").alias("_path")))  # one row each
    new_title = F.lit(title) if title else F.col("title")
    slug = X.slugify(new_title, "merged")
    rest = [c for c in cat.columns if c not in ("scope", "slug", "title", "tags", "path", "body", "source")]
    new = one.select(
        (F.lit(scope) if scope else F.col("_scope")).alias("scope"), slug.alias("slug"), new_title.alias("title"), "tags", F.concat(F.regexp_replace("_path", r"[^/]*$", ""), slug, F.lit(".md")).alias("path"), F.lit("merge").alias("source"), "body", *[F.lit("").alias(c) for c in rest]
    )
    return remove(remove(cat, chosen), new).unionByName(new.select(cat.columns))
