"""The library as a user meets it: one object over a store, directories and an embedder."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as X
from .functions.embed import Embedder, HashingEmbedder, embed_column, lexical_score
from .operators import catalog as C
from .operators import chunking, effects, indexing, ledger, recall, routing, search, sessions
from .operators import review as reviews
from .schema import CHUNKS, CODE_SCOPE, ITEMS
from .sources import files
from .sources.shared import exists, read_text
from .sources.store import VectorStore


class Memory:
    """Long-term memory in ``root``: Markdown under memory/ and skills/, an index under index/."""

    def __init__(self, spark: SparkSession, root: str, *, project_root: str | None = None, embedder: Embedder | None = None):
        self.spark, self.root, self.project_root = spark, root.rstrip("/"), project_root
        self.embedder = embedder or HashingEmbedder()
        self.store = VectorStore(spark, f"{self.root}/index", dim=self.embedder.dim, model=self.embedder.model)
        self.roots = {"memory_global": f"{self.root}/memory", "skill_global": f"{self.root}/skills"}
        if project_root:
            self.roots |= {"memory_project": f"{project_root}/.tessera/memory", "skill_project": f"{project_root}/.tessera/skills"}

    def _rows(self, chunks: DataFrame, index_name: str, *, stored: str = "display_text") -> DataFrame:
        """Chunks (file_path, file_hash, chunk_idx, display_text, heading_path, scope, tags) as rows of the store; ``stored`` names the text that is kept."""
        made = chunks.withColumn("embedding", embed_column(self.embedder, F.col("display_text"))).withColumn("text", F.col(stored))
        return made.select(
            *[{"index_name": F.lit(index_name), "model": F.lit(self.embedder.model), "indexed_at": F.current_timestamp()}.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CHUNKS]
        )

    def _seen(self) -> DataFrame:
        out = None
        for kind, root in self.roots.items():
            one = files.markdown_files(self.spark, root, kind).withColumnRenamed("path", "file_path")
            out = one if out is None else out.unionByName(one)
        return out

    def index(self, *, prune: bool = True) -> dict[str, int]:
        """Bring the index up to date with the directories; only new and changed files are chunked and embedded."""
        seen, base = self._seen(), self.store.manifest()["version"]
        stored = self.store.files(base).filter(F.col("scope") != CODE_SCOPE)
        plan = indexing.change_plan(seen, stored, prune=prune).cache()
        changed = C.front_matter(seen.join(plan.filter("status IN ('new', 'changed')").select("file_path"), "file_path", "left_semi"))
        tags = C.tag_list(F.try_element_at("front", F.lit("tags")))
        rows = self._rows(chunking.chunk_markdown(changed.withColumn("tags", tags)), "memory").cache()
        counters = indexing.run_counters(plan, rows).first().asDict()
        self.store.apply(plan, rows, base=base)
        plan.unpersist()
        rows.unpersist()
        return counters

    def index_code(self, *, prune: bool = True, chunk_lines: int = 40, ignored: tuple[str, ...] = ()) -> dict[str, int]:
        """Bring the index of the project's source code up to date."""
        if not self.project_root:
            raise ValueError("no project")
        seen = files.code_files(self.spark, self.project_root, ignored=ignored).withColumnRenamed("path", "file_path")
        base = self.store.manifest()["version"]
        stored = self.store.files(base).filter(F.col("scope") == CODE_SCOPE)
        plan = indexing.change_plan(seen, stored, prune=prune).cache()
        changed = seen.filter("NOT too_large").join(plan.filter("status IN ('new', 'changed')").select("file_path"), "file_path", "left_semi")
        c = chunking.chunk_code(changed, size=chunk_lines)
        args = (F.col("language"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("text"))
        c = c.withColumn("_stored", X.code_stored_text(*args)).withColumn("display_text", X.code_embed_text(*args))
        c = c.withColumn("scope", F.lit(CODE_SCOPE)).withColumn("tags", F.array().cast("array<string>")).withColumn("heading_path", F.array().cast("array<string>"))
        rows = self._rows(c, "code", stored="_stored").cache()
        counters = indexing.run_counters(plan, rows).first().asDict()
        self.store.apply(plan, rows, base=base)
        plan.unpersist()
        rows.unpersist()
        return counters

    def reindex(self) -> dict[str, int]:
        """Index everything anew, the project's code too; without a project the code that is stored stays."""
        stored = self.store.read()
        self.store.write(stored.limit(0) if self.project_root else stored.filter(F.col("scope") == CODE_SCOPE))
        counters = self.index()
        if self.project_root:
            code = self.index_code()
            counters = {k: v + code[k] for k, v in counters.items()}
        return counters

    def search(self, query: str, *, scope: str | list[str] | None = None, k: int = 5, tags: list[str] | None = None, rerank: bool = False) -> DataFrame:
        """The hits nearest to a query, best first."""
        vector, k = self.embedder.embed([query])[0], search.clamp_k(k)
        rows = self.store.read().filter(F.col("scope") != CODE_SCOPE)
        hits = search.search_reranked(rows, vector, query, k, lexical_score, scope=scope, tags=tags) if rerank else search.top_k(rows, vector, k, scope=scope, tags=tags)
        return hits

    def search_code(self, query: str, *, k: int = 5) -> DataFrame:
        return search.search_code(self.store.read(), self.embedder.embed([query])[0], k)

    def search_all(self, query: str, *, k: int = 5) -> DataFrame:
        """Memory and code in one ranking."""
        return search.union_hits(self.search(query, k=k), self.search_code(query, k=k), k)

    def recall(self, prompt: str, *, k: int = 5, budget_tokens: int = 2000, scope: list[str] | None = None) -> DataFrame:
        """The hits for a prompt that fit a token budget."""
        hits = self.search(prompt, scope=scope or ["project", "global", "skills"], k=k)
        ranked = self.spark.createDataFrame([(i + 1, *r) for i, r in enumerate(hits.collect())], "rank int, " + ", ".join(f"{n} {t}" for n, t in hits.dtypes))
        head = X.hit_header(F.col("rank"), F.col("file_path"), F.col("score"), F.col("scope"))
        return recall.pack_budget(ranked, budget_tokens, header=head)

    def catalog(self, scope: str | None = None) -> DataFrame:
        kinds = {"global": "memory_global", "project": "memory_project"}
        out = None
        for s, kind in kinds.items():
            if kind in self.roots and scope in (None, s):
                one = files.markdown_files(self.spark, self.roots[kind], kind, recursive=False)
                out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("no project")
        return C.catalog(out)

    def write(self, content: str, *, scope: str = "global", title: str | None = None, tags: list[str] | None = None) -> dict:
        """Write a memory, over one of the same or nearly the same slug if there is one, and index it."""
        scope = scope.lower()
        if scope == "project" and not self.project_root:
            raise ValueError("no project to write to")
        kind = "memory_project" if scope == "project" else "memory_global"
        name = title or (content.splitlines()[0] if content.strip() else "memory")
        now = datetime.now(tz=UTC).isoformat()
        cat = self.catalog("project" if scope == "project" else "global")
        one = self.spark.createDataFrame([(name, title or "", content, tags or [])], "name string, title string, content string, tags array<string>")
        one = one.withColumn("slug", X.slugify(F.col("name"), "memory"))
        near = routing.near_slugs(one, cat)
        one = one.join(near, "slug").withColumn("slug", F.col("target_slug"))
        one = routing.kept_creation(one, cat, now)
        text = routing.memory_text(F.col("title"), F.col("content"), F.col("created_at"), F.col("updated_at"), [("scope", F.lit(scope))], F.col("tags"))
        row = one.select("slug", text.alias("text")).first()
        path = Path(self.roots[kind]) / f"{row.slug}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(row.text, encoding="utf-8")
        self.index()
        return {"written": str(path), "scope": scope, "tags": tags or []}

    def remove(self, slug: str, scope: str | None = None) -> str:
        """Delete a memory's file and its chunks; returns its path."""
        found = C.find(self.catalog(scope), slug, scope).first()
        if found is None:
            raise KeyError(slug)
        Path(found.path).unlink()
        self.store.delete(self.spark.createDataFrame([(found.path,)], "file_path string"))
        return found.path

    def move(self, slug: str, to: str) -> str:
        """Move a memory between the global scope and the project; returns its new path."""
        kind = {"global": "memory_global", "project": "memory_project"}[to]
        if kind not in self.roots:
            raise ValueError("no project")
        found = C.find(self.catalog(), slug).first()
        if found is None:
            raise KeyError(slug)
        new = Path(self.roots[kind]) / Path(found.path).name
        if new.exists():
            raise FileExistsError(str(new))
        old = Path(self.remove_from_index(slug))
        new.parent.mkdir(parents=True, exist_ok=True)
        old.rename(new)
        self.index()
        return str(new)

    def remove_from_index(self, slug: str) -> str:
        found = C.find(self.catalog(), slug).first()
        if found is None:
            raise KeyError(slug)
        self.store.delete(self.spark.createDataFrame([(found.path,)], "file_path string"))
        return found.path

    def show(self, slug: str, scope: str | None = None) -> str:
        """The file of a memory, front matter and all."""
        found = C.find(self.catalog(scope), slug, scope).first()
        if found is None:
            raise KeyError(slug)
        return Path(found.path).read_text(encoding="utf-8")

    def edit(self, slug: str, change: Callable[[str], str], scope: str | None = None) -> bool:
        """Rewrite a memory's file by ``change`` and index it; whether anything changed."""
        old = self.show(slug, scope)
        new = change(old)
        if new == old:
            return False
        Path(C.find(self.catalog(scope), slug, scope).first().path).write_text(new, encoding="utf-8")
        self.index()
        return True

    def merge(self, slugs: list[str], *, title: str | None = None, scope: str | None = None) -> str:
        """Make one memory of several and delete them; returns its path."""
        cat = self.catalog()
        merged = C.merge(cat, slugs, title=title, scope=scope)
        new = merged.filter("source = 'merge'").filter(~F.col("path").isin([r.path for r in cat.filter("source = 'merge'").select("path").collect()]) | F.col("slug").isin(slugs)).first()
        now = datetime.now(tz=UTC).isoformat()
        row = self.spark.createDataFrame([(new.title, new.body, new.tags)], "title string, content string, tags array<string>").select(
            routing.memory_text(F.lit(""), F.col("content"), F.lit(now), F.lit(now), [("title", F.col("title")), ("source", F.lit("merge"))], F.col("tags")).alias("t")
        ).first()
        kind = {"global": "memory_global", "project": "memory_project"}[new.scope]
        path = Path(self.roots[kind]) / f"{new.slug}.md"
        if path.exists() and new.slug not in slugs:
            raise FileExistsError(str(path))
        path.write_text(row.t, encoding="utf-8")
        for s in slugs:
            if s != new.slug:
                self.remove(s)
        self.index()
        return str(path)

    def review(self, events: DataFrame, *, min_user_messages: int = 3, spent: DataFrame | None = None) -> DataFrame:
        """The gate's verdict on every session of event lines, and the step that follows."""
        turns = sessions.parse_events(events)
        gated = sessions.gate(sessions.session_counts(turns, session="file"), min_user_messages=min_user_messages)
        if spent is None:
            spent = self.spark.createDataFrame([(0.0, False)], "spent double, exceeded boolean")
        return sessions.session_plan(gated, spent, session="file")

    def _targets(self) -> dict[str, str]:
        """Where items of each category go."""
        out = {"global_memory": self.roots["memory_global"]}
        if self.project_root:
            out |= {"project_memory": self.roots["memory_project"], "project_skill": self.roots["skill_project"], "claude_md_patch": f"{self.project_root}/{effects.NOTES}"}
        return out

    def _known(self) -> DataFrame:
        """Memories and skills of the project by category: category, slug, title, path, created_at."""
        category = F.when(F.col("scope") == "global", "global_memory").otherwise("project_memory")
        out = self.catalog().select(category.alias("category"), "slug", "title", "path", "created_at")
        if self.project_root:
            found = files.markdown_files(self.spark, self.roots["skill_project"], "skill_project").filter(F.col("path").endswith("/SKILL.md"))
            name = F.element_at(F.split("path", "/"), -2)
            out = out.unionByName(found.select(F.lit("project_skill").alias("category"), name.alias("slug"), name.alias("title"), "path", F.lit("").alias("created_at")))
        return out

    def plan(self, items: DataFrame, *, batch: str | None = None) -> DataFrame:
        """What would be done about a session's items (see ITEMS): the plan, with paths."""
        made = routing.dispatch(items, self._known(), has_project=bool(self.project_root), batch=batch)
        return effects.records(made, self._targets())

    def carry_out(self, items: DataFrame, run: str, *, batch: str | None = None, now: str | None = None, before: Callable | None = None) -> DataFrame:
        """Write, merge, append and delete what items ask for and index the result; a record for each part of each item.

        ``run`` names a journal under the root: a run that was cut off and is repeated under
        its name finds its plan there, carries out what is left of it, and does nothing twice.
        """
        journal = f"{self.root}/journal/{run}"
        if not exists(self.spark, f"{journal}/records/_SUCCESS"):
            self.plan(items, batch=batch).write.mode("overwrite").parquet(f"{journal}/records")
        records = self.spark.read.parquet(f"{journal}/records")
        notes = self._targets().get("claude_md_patch")
        made = lambda: effects.effects(records, items, self._known(), now or datetime.now(tz=UTC).isoformat(), notes=read_text(self.spark, notes) if notes and exists(self.spark, notes) else "")
        effects.carry_out(self.spark, made, journal, before=before)
        self.index()
        return records

    def context(self) -> str:
        """What a reviewer is told of the memory: titles of memories, names of skills."""
        rows = self._known().select("category", "title").orderBy("path").collect()
        of = lambda c: [r.title for r in rows if r.category == c]
        skills = files.markdown_files(self.spark, self.roots["skill_global"], "skill_global").filter(F.col("path").endswith("/SKILL.md")).select(F.element_at(F.split("path", "/"), -2).alias("n")).orderBy("n")
        return reviews.context(self.project_root, of("global_memory"), of("project_memory"), [*(r.n for r in skills.collect()), *of("project_skill")])

    def run_reviews(
        self, events: DataFrame, call: Callable[[str], str], run: str, *, judge: Callable[[str], tuple[bool, str]] | None = None, force: bool = False, min_user_messages: int = 3, spent: DataFrame | None = None, now: str | None = None, model: str = "", before: Callable | None = None, **how
    ) -> DataFrame:
        """Review all sessions of event lines: gate, judge, reviewer, plan, effects, digests, costs.

        ``call`` gets a prompt and gives the reviewer's JSON report; ``judge`` is asked about long discussions
        without edits.  With ``force`` every session is reviewed.  The result has one row per session: file,
        decision, category, reason, step, error, should_persist, n_items, n_records and digest (a path).

        ``run`` names the journal under the root.  Each stage leaves its outcome there, so a run that is
        repeated under its name asks neither judge nor reviewer twice and ends with the same files; ``how`` goes
        to ``review.ask``.  Sessions that fail have the error in row and digest, and stop no other.
        """
        journal, spark = f"{self.root}/journal/{run}", self.spark

        def kept(name: str, made: Callable[[], DataFrame]) -> DataFrame:
            if not exists(spark, f"{journal}/{name}/_SUCCESS"):
                made().write.mode("overwrite").parquet(f"{journal}/{name}")
            return spark.read.parquet(f"{journal}/{name}")

        turns = sessions.parse_events(events)

        def gated() -> DataFrame:
            counts = sessions.session_counts(turns, session="file")
            if force:
                out = counts.withColumns({"decision": F.lit("run"), "category": F.lit("manual"), "reason": F.lit("forced via manual trigger")})
            else:
                out = sessions.judge(sessions.gate(counts, min_user_messages=min_user_messages), sessions.condense(turns, session="file"), judge, session="file")
            own = turns.groupBy("file").agg(F.first("session_id", ignorenulls=True).alias("session_id"), F.first("cwd", ignorenulls=True).alias("cwd"))
            spent_ = spark.createDataFrame([(0.0, False)], "spent double, exceeded boolean") if spent is None else spent
            return sessions.session_plan(out, spent_, session="file").join(own, "file").withColumn("now", F.lit(now or datetime.now(tz=UTC).isoformat()))

        steps = kept("steps", gated)
        first = steps.select("now").first()
        if first is None:
            return spark.createDataFrame([], "file string, decision string, category string, reason string, step string, error string, should_persist boolean, n_items int, n_records long, digest string")
        now = first.now
        asked = kept("prompts", lambda: reviews.prompts(sessions.markdown(turns.join(steps.filter("step = 'review'").select("file"), "file", "left_semi"), session="file"), self.context(), session="file"))
        replies = sessions.payload(reviews.ask(asked, call, f"{journal}/replies", session="file", **how))
        one = F.col("item")
        items = kept("items", lambda: replies.filter("should_persist").select("file", F.posexplode("items").alias("at", "item")).select(F.concat_ws("#", "file", F.lpad(F.col("at").cast("string"), 6, "0")).alias("item_no"), "file", *[one[f.name].alias(f.name) for f in ITEMS if f.name != "item_no"]))
        records = self.carry_out(items, run, batch="file", now=now, before=before).join(items.select("item_no", "file"), "item_no").withColumn("record_no", F.concat_ws("#", "item_no", "part"))
        # A digest is called after its session; of several with one name all but the first get a number.
        made = sessions.digest(steps.withColumn("session", F.coalesce("session_id", X.file_stem(F.col("file")))), records.join(steps.select("file", F.coalesce("session_id", X.file_stem(F.col("file"))).alias("session")), "file"), now, session="session", cwd="cwd", replies=replies.join(steps.select("file", F.coalesce("session_id", X.file_stem(F.col("file"))).alias("session")), "file"))
        nth = F.row_number().over(Window.partitionBy("file_name").orderBy("session"))
        named = made.withColumn("file_name", F.when(nth > 1, F.concat(F.regexp_replace("file_name", r"\.md$", ""), F.lit("-"), nth.cast("string"), F.lit(".md"))).otherwise(F.col("file_name")))
        written = named.select(F.concat(F.lit(f"{self.root}/reviews/"), "file_name").alias("path"), F.lit("write").alias("kind"), F.col("digest").alias("text"), F.col("session").alias("item_no"))
        effects.carry_out(spark, lambda: written, f"{journal}/digests")
        paid = ledger.agent_usage(replies.filter("report IS NOT NULL"))
        project = Path(self.project_root).name if self.project_root else "global"
        if not exists(spark, f"{self.root}/costs/run={run}/_SUCCESS"):
            entry = paid.select(F.lit(now).alias("ts"), F.lit("review").alias("source"), F.lit(project).alias("project"), F.lit(model).alias("model"), "tokens", F.round("cost_usd", 6).alias("cost_usd"), F.col("file").alias("context"))
            entry.write.mode("overwrite").json(f"{self.root}/costs/run={run}")
        digests = spark.read.parquet(f"{journal}/digests/effects").select(F.col("item_no").alias("session"), F.col("path").alias("digest"))
        out = steps.withColumn("session", F.coalesce("session_id", X.file_stem(F.col("file")))).join(digests, "session", "left").join(replies.select("file", "error", "should_persist", F.size("items").alias("n_items")), "file", "left")
        counted = records.groupBy("file").agg(F.count(F.lit(1)).alias("n_records"))
        return out.join(counted, "file", "left").select("file", "decision", "category", "reason", "step", "error", "should_persist", "n_items", F.coalesce("n_records", F.lit(0)).alias("n_records"), "digest")

    def costs(self, lines: DataFrame, period: str = "30d", source: str | None = None, now: datetime | None = None) -> DataFrame:
        entries = ledger.of_source(files.read_ledger(lines), source)
        return ledger.summary(ledger.since(entries, period, now or datetime.now(tz=UTC)))

    def status(self) -> str:
        """What the memory holds, as JSON."""
        rows = [r.asDict() for r in self.store.stats().collect()]
        return json.dumps({"root": self.root, "project_root": self.project_root, "model": self.embedder.model, "dim": self.embedder.dim, "version": self.store.manifest()["version"], "index": rows}, indent=2)
