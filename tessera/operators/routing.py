"""Where things go: managed paths, near slugs, titles, and the plan of writes for a session's items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..schema import KIND_SCOPES

MAX_DISTANCE = 3
MAX_PROJECT_ACTIONS = 5
MEMORY_CATEGORIES = ("global_memory", "project_memory")
PROJECT_CATEGORIES = ("project_memory", "project_skill", "claude_md_patch")


def path_kind(path: Column, roots: dict[str, str]) -> Column:
    """Kind of the first managed directory that a path is in; null if in none.  ``roots`` maps kinds to directories, in order."""
    out: Column | None = None
    for kind, root in roots.items():
        inside = path.startswith(root.rstrip("/") + "/")
        out = F.when(inside, kind) if out is None else out.when(inside, kind)
    return out if out is not None else F.lit(None).cast("string")


def route_paths(files: DataFrame, roots: dict[str, str], *, path: str = "file_path") -> DataFrame:
    """``files`` with kind and scope of their directories; null for others."""
    rows = files.withColumn("kind", path_kind(F.col(path), roots))
    scope = F.create_map(*[F.lit(x) for kv in KIND_SCOPES.items() for x in kv])
    return rows.withColumn("scope", F.when(F.col("kind").isNotNull(), F.coalesce(F.try_element_at(scope, F.col("kind")), F.col("kind"))))


def edit_route(files: DataFrame, roots: dict[str, str], project_root: str | None, suffixes: tuple[str, ...], ignored: tuple[str, ...], *, path: str = "file_path") -> DataFrame:
    """``files`` with route: memory (Markdown in a managed directory), code (source under the project) or null."""
    rows = route_paths(files, roots, path=path)
    parts = F.split(F.col(path), "/")
    code = F.lit(False)
    if project_root:
        code = F.col(path).startswith(project_root.rstrip("/") + "/") & X.suffix(F.col(path)).isin(*suffixes) & ~F.arrays_overlap(parts, F.array(*map(F.lit, ignored)))
    return rows.withColumn("route", F.when(F.col("kind").isNotNull() & F.col(path).endswith(".md"), "memory").when(code, "code"))


def near_slugs(wanted: DataFrame, existing: DataFrame, *, distance: int = MAX_DISTANCE, slug: str = "slug", keys: tuple[str, ...] = ()) -> DataFrame:
    """Per wanted slug the existing one at most ``distance`` edits away, and that distance; the slug itself and null if none.

    The least distance wins, then the least slug; only rows with equal ``keys`` meet.  Slugs
    within ``distance`` edits share a piece: one of them cut into ``distance + 1`` pieces, one
    piece is whole in the other, at a place shifted by at most ``distance``.  Those pieces are
    join keys, so that not every pair meets.
    """
    k = distance + 1
    start = lambda n, i: F.floor(n * i / k).cast("int")
    piece = lambda c, n, i, move: F.substring(c, start(n, i) + move + 1, start(n, i + 1) - start(n, i))
    span = lambda a, b: F.explode(F.array(*[F.lit(x) for x in range(a, b + 1)]))
    left = wanted.select(*keys, F.col(slug).alias("_s")).distinct()
    right = existing.select(*keys, F.col(slug).alias("_e")).distinct()
    a = left.withColumn("_i", span(0, distance)).withColumn("_n", F.length("_s"))
    a = a.withColumn("_p", piece(F.col("_s"), F.col("_n"), F.col("_i"), F.lit(0)))
    b = right.withColumn("_i", span(0, distance)).withColumn("_by", span(-distance, distance)).withColumn("_move", span(-distance, distance))
    b = b.withColumn("_n", F.length("_e") + F.col("_by")).filter((F.col("_n") > 0) & (start(F.col("_n"), F.col("_i")) + F.col("_move") >= 0))
    b = b.withColumn("_p", piece(F.col("_e"), F.col("_n"), F.col("_i"), F.col("_move"))).select(*keys, "_e", "_i", "_n", "_p").distinct()
    met = a.join(b, [*keys, "_i", "_n", "_p"]).select(*keys, "_s", "_e").distinct()
    near = met.withColumn("_d", F.levenshtein("_s", "_e", distance)).filter(F.col("_d") >= 0)
    best = near.groupBy(*keys, "_s").agg(F.min(F.struct("_d", "_e")).alias("_b"))
    return left.join(best, [*keys, "_s"], "left").select(*keys, F.col("_s").alias(slug), F.coalesce("_b._e", "_s").alias("target_slug"), F.col("_b._d").alias("distance"))


def resolve_titles(titles: DataFrame, catalog: DataFrame, *, distance: int = MAX_DISTANCE, keys: tuple[str, ...] = ()) -> DataFrame:
    """``titles`` (title) with the slug of the memory meant: equal slug, else near slug, else equal heading; null if none."""
    t = titles.select(*keys, "title").distinct().withColumn("slug", X.slugify(F.col("title")))
    near = near_slugs(t, catalog, distance=distance, keys=keys).filter("distance IS NOT NULL").select(*keys, "slug", F.col("target_slug").alias("_near"))
    heads = catalog.groupBy(*keys, "title").agg(F.min("slug").alias("_head"))
    out = t.join(near, [*keys, "slug"], "left").join(heads, [*keys, "title"], "left")
    return titles.join(out.select(*keys, "title", F.coalesce("_near", "_head").alias("found_slug")), [*keys, "title"], "left")


def dispatch(items: DataFrame, catalog: DataFrame, *, has_project: bool, max_project_actions: int = MAX_PROJECT_ACTIONS, batch: str | None = None) -> DataFrame:
    """The plan for all items: item_no, part, category, title, slug, status, reason.

    Statuses: written, appended, merged, merge_source_deleted, deleted, skipped.  At most
    ``max_project_actions`` merges and deletions of project memories are tried, in order of
    item_no; ``batch`` names the column of the call or session that the bound holds for, else it
    holds for the whole table.  item_no is unique in the table.  A merge has one row for its result and one per source (part counts them);
    a source that is the result stays.  ``catalog`` has category, slug, title.
    """
    x = items.select(
        "item_no", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("action", F.lit("write")).alias("action"), X.strip(F.coalesce("title", F.lit(""))).alias("title"),
        X.strip(F.coalesce("content", F.lit(""))).alias("content"), F.coalesce("merge_sources", F.array().cast("array<string>")).alias("merge_sources"), (F.col(batch) if batch else F.lit(0)).alias("_batch"),
    )
    counted = (F.col("category") == "project_memory") & F.col("action").isin("merge", "delete")
    # Only the counted items of a batch come together; the others are dealt out.
    apart = F.when(~counted, F.xxhash64("item_no"))
    quota = F.sum(F.when(counted, 1).otherwise(0)).over(Window.partitionBy("_batch", apart).orderBy("item_no"))
    x = x.withColumn("_over", counted & (quota > max_project_actions)).withColumn("slug", X.slugify(F.col("title")))
    memory, project = F.col("category").isin(*MEMORY_CATEGORIES), F.col("category").isin(*PROJECT_CATEGORIES)
    empty = (F.col("title") == "") | (F.col("content") == "")
    no_project = project & F.lit(not has_project)
    quoted = F.concat(F.lit("'"), F.col("category"), F.lit("'"))
    limit = f"project merge/delete limit ({max_project_actions}) reached"
    a = F.col("action")
    reason = (
        F.when(F.col("_over"), limit)
        .when((a == "merge") & empty, "merge: missing title or content")
        .when((a == "merge") & (F.size("merge_sources") == 0), "merge: no merge_sources provided")
        .when((a == "merge") & ~memory, F.concat(F.lit("merge not supported for category: "), quoted))
        .when((a == "delete") & ~memory, F.concat(F.lit("delete not supported for category: "), quoted))
        .when(a.isin("merge", "delete") & no_project, "no project detected")
        .when(a.isin("merge", "delete"), F.lit(None))
        .when(empty, "missing title or content")
        .when(no_project, "no project detected")
        .when(F.col("category") == "global_skill", "global_skill not supported — use global_memory instead")
        .when(~(memory | project), F.concat(F.lit("unknown category: "), quoted))
    )
    x = x.withColumn("reason", reason)
    # Slugs near an existing one of the category take its place.
    near = near_slugs(x, catalog.filter(F.col("category").isin(*MEMORY_CATEGORIES, "project_skill")), keys=("category",))
    x = x.join(near, ["category", "slug"], "left").withColumn("target_slug", F.coalesce("target_slug", "slug"))
    wanted = x.filter((a == "delete") & F.col("reason").isNull()).select("item_no", "category", F.lit(0).alias("part"), "title", F.lit("").alias("target_slug"))
    sources = x.filter((a == "merge") & F.col("reason").isNull()).select("item_no", "category", F.posexplode("merge_sources").alias("part", "title"), "target_slug")
    asked = wanted.unionByName(sources.withColumn("part", F.col("part") + 1))
    found = resolve_titles(asked.select("category", "title").distinct(), catalog, keys=("category",))
    asked = asked.join(found, ["category", "title"], "left").filter(F.col("found_slug").isNull() | (F.col("found_slug") != F.col("target_slug")))
    is_source = F.col("part") > 0
    gone = asked.select(
        "item_no", "part", "category", "title", F.coalesce("found_slug", F.lit("")).alias("slug"),
        F.when(F.col("found_slug").isNull(), "skipped").when(is_source, "merge_source_deleted").otherwise("deleted").alias("status"),
        F.when(F.col("found_slug").isNull(), F.concat(F.when(is_source, "merge source not found: '").otherwise("memory not found: '"), F.col("title"), F.lit("'"))).alias("reason"),
    )
    status = F.when(F.col("reason").isNotNull(), "skipped").when(a == "merge", "merged").when(F.col("category") == "claude_md_patch", "appended").otherwise("written")
    own = x.filter((a != "delete") | F.col("reason").isNotNull()).select(
        "item_no", F.lit(0).alias("part"), "category", "title", F.when(F.col("reason").isNotNull() | (F.col("category") == "claude_md_patch"), "").otherwise(F.col("target_slug")).alias("slug"), status.alias("status"), "reason"
    )
    return own.unionByName(gone)


def memory_text(title: Column, content: Column, created_at: Column, updated_at: Column, extra: list[tuple[str, Column | None]], tags: Column | None = None) -> Column:
    """The file of a memory: front matter, heading, content."""
    t = F.when(F.size(tags) > 0, F.to_json(tags)) if tags is not None else None
    front = X.yaml_front([("created_at", created_at), ("updated_at", updated_at), *extra, ("tags", t)])
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise("")
    return F.concat(front, F.lit("\n\n"), head, X.strip(content), F.lit("\n"))


def kept_creation(planned: DataFrame, existing: DataFrame, now: str, *, key: str = "slug") -> DataFrame:
    """``planned`` with created_at (that of the existing memory, if any) and updated_at."""
    old = existing.select(key, F.nullif(F.col("created_at"), F.lit("")).alias("_c")).dropDuplicates([key])
    return planned.join(old, key, "left").withColumn("created_at", F.coalesce("_c", F.lit(now))).withColumn("updated_at", F.lit(now)).drop("_c")


def append_block(text: Column, content: Column, stamp: str, start: str, end: str) -> Column:
    """``text`` with ``content`` before the last end mark, or in a new block between marks at its end."""
    note = F.concat(F.lit(f"<!-- appended {stamp} -->\n"), X.strip(content), F.lit("\n"))
    at = F.length(text) - F.length(F.element_at(F.split(text, "\\Q" + end + "\\E", -1), -1)) - len(end)
    inside = F.concat(F.substring(text, F.lit(1), at), note, F.substring(text, at + 1, F.length(text)))
    fresh = F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit(f"\n\n{start}\n"), note, F.lit(f"{end}\n"))
    return F.when(text.contains(start) & text.contains(end), inside).otherwise(fresh)
