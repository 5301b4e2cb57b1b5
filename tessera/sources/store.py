"""A versioned vector store on Parquet, with edits as deltas, branches and three-way merges.

A version is a small manifest: a list of segments in order.  A segment holds the chunks of the
files that one commit wrote, and a log with one row for each file that it wrote or deleted; both
are cut into buckets by a hash of file_path.  The last segment whose log has a file decides about it,
so an edit writes the buckets of its files and nothing else, and readers drop what later logs name.
Compaction rewrites buckets that many segments share.

Manifests are numbered and never overwritten: each is created exclusively, so of two writers with
the same next number one has to look again.  If the other's commit touched other files, its own goes
on top; else it fails with ConflictError.  Manifests name their parents, which gives branches a
common ancestor to merge from.
"""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import indexing
from ..schema import CHUNKS
from .shared import exists, file_of, names_in, read_text, remove, write_text

LOG = "file_path string, file_hash string, scope string, n_chunks int"
#: Bytes of paths up to which the files of the deltas are broadcast to the scan.
BROADCAST_BYTES = 32 << 20


class ConflictError(RuntimeError):
    """Another commit changed the same files in the meantime."""


class VectorStore:
    """``root`` may be on any file system that Spark reads.

    ``buckets`` counts for a new store only; a bucket should be small enough to be rewritten now and
    then.  A bucket that ``most_segments`` segments share is compacted by the commit that makes it so.
    """

    def __init__(self, spark: SparkSession, root: str, *, dim: int, model: str, branch: str = "main", buckets: int = 64, most_segments: int = 16):
        self.spark, self.root, self.dim, self.model, self.branch_name, self.most_segments = spark, root.rstrip("/"), dim, model, branch, most_segments
        found = self.manifest()
        if found and found["dim"] != dim:
            raise ValueError(f"the store at {root} holds vectors of length {found['dim']}, not {dim}")
        if found and found["model"] != model:
            # Vectors of another model don't compare: start anew; older versions stay until vacuumed.
            self._publish(found | {"model": model, "segments": []}, found)
        elif not found:
            self._publish({"dim": dim, "model": model, "buckets": buckets, "segments": []}, None)

    # Manifests

    def _at(self, version: int, branch: str | None = None) -> str:
        return f"{self.root}/versions/{branch or self.branch_name}/{version:012d}.json"

    def versions(self) -> list[int]:
        """The numbers of this branch's versions that are still there."""
        return [int(n[:-5]) for n in names_in(self.spark, f"{self.root}/versions/{self.branch_name}") if n.endswith(".json") and not n.startswith(".")]

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, of the last one unless it is given; None if there is none."""
        found = self.versions() if version is None else [version]
        return json.loads(read_text(self.spark, self._at(found[-1]))) if found else None

    def _publish(self, new: dict, head: dict | None, *others: list) -> dict | None:
        """Make ``new`` the version after ``head``; None if another writer was first."""
        number = head["version"] + 1 if head else 0
        new = new | {"version": number, "branch": self.branch_name, "parents": [*([[self.branch_name, head["version"]]] if head else []), *others]}
        return new if write_text(self.spark, self._at(number), json.dumps(new), exclusive=True) else None

    # Reading

    def _scan(self, kind: str, schema: str | None, places: list[tuple[str, int]]) -> DataFrame:
        """Rows of the given buckets of segments, with ``_seg``."""
        at = f"{self.root}/{kind}"
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNKS) if schema is None else schema
        if not places:
            return self.spark.createDataFrame([], f"{fields}, _seg string")
        return self.spark.read.schema(f"{fields}, _seg string, _bucket int").option("basePath", at).parquet(*[f"{at}/_seg={s}/_bucket={b}" for s, b in places]).drop("_bucket")

    @staticmethod
    def _shared(m: dict) -> set[int]:
        """Buckets that several segments have logs of."""
        seen: dict[int, int] = {}
        for s in m["segments"]:
            for b in s["log"]:
                seen[b] = seen.get(b, 0) + 1
        return {b for b, n in seen.items() if n > 1}

    @staticmethod
    def _order(m: dict) -> Column:
        pairs = [x for i, s in enumerate(m["segments"]) for x in (F.lit(s["id"]), F.lit(i))]
        return F.element_at(F.create_map(*pairs), F.col("_seg"))

    def read(self, version: int | None = None, *, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, of the last one unless it is given; of some buckets if they are named.

        Buckets of one segment are scanned as they are.  Rows of the others are held against the
        files of all logs but each bucket's first, which are few between compactions.
        """
        m = self.manifest(version)
        shared = self._shared(m)
        places = [(s["id"], b) for s in m["segments"] for b in s["data"] if buckets is None or b in buckets]
        alone = self._scan("data", None, [p for p in places if p[1] not in shared]).drop("_seg")
        if not any(b in shared for _, b in places):
            return alone
        later, size, first = [], 0, set()
        for s in m["segments"]:
            new = [b for b in s["log"] if b in shared and (buckets is None or b in buckets)]
            later += [(s["id"], b) for b in new if b in first]
            size += s["bytes"] if any(b in first for b in new) else 0
            first.update(new)
        last = self._scan("log", LOG, later).groupBy("file_path").agg(F.max(self._order(m)).alias("_last"))
        rows = self._scan("data", None, [p for p in places if p[1] in shared])
        kept = rows.join(F.broadcast(last) if size <= BROADCAST_BYTES else last, "file_path", "left").filter(self._order(m) >= F.coalesce("_last", F.lit(-1)))
        kept = kept.select(*[f.name for f in CHUNKS])
        return kept if not any(b not in shared for _, b in places) else alone.unionByName(kept)

    def files(self, version: int | None = None) -> DataFrame:
        """file_path, file_hash and scope of the files of a version, from the logs alone."""
        m = self.manifest(version)
        shared = self._shared(m)
        places = [(s["id"], b) for s in m["segments"] for b in s["log"]]
        rows = self._scan("log", LOG, [p for p in places if p[1] not in shared]).drop("_seg")
        if shared:
            several = self._scan("log", LOG, [p for p in places if p[1] in shared])
            value = F.struct("file_hash", "scope", "n_chunks")
            last = several.groupBy("file_path").agg(F.max_by(value, self._order(m)).alias("_v")).select("file_path", "_v.*")
            rows = rows.unionByName(last)
        return rows.filter("n_chunks > 0").drop("n_chunks")

    # Writing

    def _bucket(self, m: dict) -> Column:
        return F.pmod(F.xxhash64("file_path"), F.lit(m["buckets"])).cast("int")

    def _segment(self, m: dict, touched: DataFrame, chunks: DataFrame) -> dict:
        """Write a segment: ``chunks``, and a log of their files and of those of ``touched`` (file_path)."""
        seg = {"id": f"s{uuid.uuid4().hex}"}
        data, wrong = f"{self.root}/data/_seg={seg['id']}", f"vectors of length {self.dim} are needed"
        fits = F.when(F.coalesce(F.size("embedding") == self.dim, F.lit(True)), F.col("embedding")).otherwise(F.raise_error(F.lit(wrong)))
        rows = chunks.withColumn("embedding", fits).select([F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNKS]).withColumn("_bucket", self._bucket(m))
        # Partitions of a bucket each, of many tasks where a bucket is large.
        rows = rows.hint("rebalance", F.col("_bucket")).sortWithinPartitions("_bucket", "file_path", "chunk_idx")
        try:
            rows.write.option("compression", "zstd").partitionBy("_bucket").parquet(data)
        except Exception as error:
            self._drop(seg)
            if wrong in str(error):
                raise ValueError(wrong) from error
            raise
        seg["data"] = sorted(int(n[8:]) for n in names_in(self.spark, data) if n.startswith("_bucket="))
        written = self._scan("data", None, [(seg["id"], b) for b in seg["data"]])
        own = written.groupBy("file_path").agg(F.first("file_hash").alias("file_hash"), F.first("scope").alias("scope"), F.count(F.lit(1)).cast("int").alias("n_chunks"))
        log = touched.select("file_path").filter("file_path IS NOT NULL").distinct().join(own, "file_path", "full").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
        facts = Observation()
        sums = [F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.octet_length("file_path") + 16), F.lit(0)).alias("bytes")]
        log = log.withColumn("_bucket", self._bucket(m)).hint("rebalance", F.col("_bucket")).observe(facts, *sums)
        log.write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.root}/log/_seg={seg['id']}")
        seg["log"] = sorted(int(n[8:]) for n in names_in(self.spark, f"{self.root}/log/_seg={seg['id']}") if n.startswith("_bucket="))
        return seg | facts.get

    def _drop(self, seg: dict) -> None:
        for kind in ("data", "log"):
            remove(self.spark, f"{self.root}/{kind}/_seg={seg['id']}")

    def _check_apart(self, base: dict, head: dict, seg: dict, *, everything: bool) -> None:
        """Raise ConflictError if a commit between the versions touched a file of the segment."""
        known = {s["id"] for s in base["segments"]}
        fresh = [s for s in head["segments"] if s["id"] not in known and not s.get("compact")]
        replaced = head.get("since") != base.get("since") or head["model"] != base["model"]
        if replaced or fresh and everything:
            raise ConflictError(f"version {head['version']} replaced what version {base['version']} held")
        places = [(s["id"], b) for s in fresh for b in s["log"] if b in seg["log"]]
        if not places:
            return
        theirs = self._scan("log", LOG, places).select("file_path")
        both = self._scan("log", LOG, [(seg["id"], b) for b in seg["log"]]).join(theirs, "file_path", "left_semi").limit(1).collect()
        if both:
            raise ConflictError(f"{both[0].file_path} was changed by a commit after version {base['version']}")

    def commit(self, touched: DataFrame, chunks: DataFrame, *, base: int | None = None, everything: bool = False, merged: list | None = None) -> int:
        """Replace all rows of the files in ``touched`` and in ``chunks`` by ``chunks``; the new version's number.

        ``base`` is the version that the caller has read, the last one unless it is given.  A
        commit since then that touched one of the files is a conflict.  With ``everything``
        nothing but ``chunks`` stays, and any commit since then is a conflict.
        """
        start = self.manifest(base)
        seg = self._segment(start, touched, chunks)
        try:
            while True:
                head = self.manifest()
                if head["version"] != start["version"]:
                    self._check_apart(start, head, seg, everything=everything)
                kept = [] if everything else head["segments"]
                new = head | {"segments": [*kept, seg] if seg["log"] else kept} | ({"since": seg["id"]} if everything else {})
                done = self._publish(new, head, *([merged] if merged else []))
                if done:
                    break
        except BaseException:
            self._drop(seg)
            raise
        crowded = {b for b in self._shared(done) if sum(b in s["log"] for s in done["segments"]) >= self.most_segments}
        if crowded:
            self.compact(crowded)
        return done["version"]

    def compact(self, buckets: set[int] | None = None) -> list[int]:
        """Rewrite buckets that several segments share, all of them unless some are named, as one segment; the buckets.

        The new segment takes the place of those it replaces, below commits that come meanwhile.
        If another compaction was first, nothing changes.
        """
        base = self.manifest()
        todo = self._shared(base) & (buckets if buckets is not None else self._shared(base))
        if not todo:
            return []
        rows = self.read(base["version"], buckets=todo)
        seg = self._segment(base, rows.select("file_path").limit(0), rows) | {"compact": True}
        old = [s["id"] for s in base["segments"]]
        while True:
            head = self.manifest()
            holds = lambda m: [[b for b in s["log"] if b in todo] for s in m["segments"] if s["id"] in old]
            if holds(head) != holds(base):
                self._drop(seg)
                return []
            kept, at = [], 0
            for s in head["segments"]:
                if s["id"] in old:
                    s = s | {"data": [b for b in s["data"] if b not in todo], "log": [b for b in s["log"] if b not in todo]}
                    if s["log"]:
                        kept.append(s)
                    at = len(kept)
                else:
                    kept.append(s)
            new = head | {"segments": [*kept[:at], *([seg] if seg["log"] else []), *kept[at:]]}
            if self._publish(new, head):
                return sorted(todo)

    def write(self, rows: DataFrame, *, base: int | None = None) -> int:
        """Make ``rows`` all that the next version holds, if all vectors have the store's length; its number."""
        return self.commit(rows.select("file_path").limit(0), rows, base=base, everything=True)

    def apply(self, plan: DataFrame, chunks: DataFrame, *, base: int | None = None) -> int:
        """Apply a change plan; a plan without changes writes nothing."""
        touched = plan.filter(F.col("status").isin("new", "changed", "pruned")).select("file_path")
        if not touched.limit(1).count():
            return self.manifest()["version"]
        return self.commit(touched, chunks, base=base)

    def upsert(self, chunks: DataFrame, *, base: int | None = None) -> int:
        return self.commit(chunks.select("file_path").limit(0), chunks, base=base)

    def delete(self, paths: DataFrame, *, base: int | None = None) -> int:
        """Remove files; returns the number of chunks that went."""
        named = paths.select("file_path").distinct()
        gone = self.read(base).join(named, "file_path", "left_semi").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
        total = gone.agg(F.sum("n")).first()[0] or 0
        if total:
            self.commit(gone, self.spark.createDataFrame([], CHUNKS), base=base)
        return total

    # Branches

    def branch(self, name: str) -> VectorStore:
        """A branch of that name that starts at the last version of this one; nothing is copied."""
        head = self.manifest()
        new = head | {"version": 0, "branch": name, "parents": [[self.branch_name, head["version"]]]}
        if not write_text(self.spark, self._at(0, name), json.dumps(new), exclusive=True):
            raise ValueError(f"there is a branch {name} already")
        return VectorStore(self.spark, self.root, dim=self.dim, model=self.model, branch=name, most_segments=self.most_segments)

    def ancestor(self, other: VectorStore) -> tuple[str, int] | None:
        """The nearest version that both branches come from, as branch and number; None if none is left."""

        def line(s: VectorStore) -> dict[tuple[str, int], int]:
            seen, todo = {}, [((s.branch_name, s.manifest()["version"]), 0)]
            for at, far in todo:
                if at not in seen and exists(self.spark, self._at(at[1], at[0])):
                    seen[at] = far
                    todo += [((b, n), far + 1) for b, n in json.loads(read_text(self.spark, self._at(at[1], at[0])))["parents"]]
            return seen

        mine, theirs = line(self), line(other)
        both = [(mine[k] + theirs[k], k) for k in mine if k in theirs]
        return min(both)[1] if both else None

    def merge(self, other: VectorStore, *, prefer: str = "current") -> dict[str, int]:
        """Bring what another branch has changed since the common ancestor into this one; counters.

        Per file, the side that changed counts, deletions included; where both did and differ, ``prefer``
        says which (current or other), or error raises ConflictError.  Without a common
        ancestor nothing counts as deleted: the other branch's files come where this one has none.
        Whole files are compared by their hashes, from the logs; only chunks that come over are read.
        """
        if prefer not in ("current", "other", "error"):
            raise ValueError("prefer must be current, other or error")
        mine, theirs, at = self.manifest()["version"], other.manifest()["version"], self.ancestor(other)
        h = lambda s, v, n: s.files(v).select("file_path", F.concat_ws("/", "file_hash", "scope").alias(n))
        files = h(self, mine, "c").join(h(other, theirs, "o"), "file_path", "full")
        if at:
            old = copy.copy(self)
            old.branch_name = at[0]
            files = files.join(h(old, at[1], "a"), "file_path", "full")
        else:
            files = files.withColumn("a", F.lit(None).cast("string"))
        same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
        changed = ~same("o", "a") & ~same("o", "c")
        clash = changed & ~same("c", "a")
        if not at:
            changed, clash = changed & F.col("o").isNotNull(), clash & F.col("o").isNotNull() & F.col("c").isNotNull()
        rows = files.select("file_path", "o", clash.alias("clash"), changed.alias("changed")).filter("changed").cache()
        counts = rows.agg(F.count_if("clash").alias("conflicts"), F.count_if(~F.col("clash") & F.col("o").isNotNull()).alias("taken"), F.count_if(~F.col("clash") & F.col("o").isNull()).alias("deleted")).first().asDict()
        try:
            if counts["conflicts"] and prefer == "error":
                raise ConflictError(f"{counts['conflicts']} files were changed on both branches, {rows.filter('clash').first().file_path} among them")
            chosen = rows if prefer == "other" else rows.filter("NOT clash")
            if chosen.limit(1).count():
                self.commit(chosen.select("file_path"), other.read(theirs).join(chosen.select("file_path"), "file_path", "left_semi"), base=mine, merged=[other.branch_name, theirs])
        finally:
            rows.unpersist()
        return counts

    # Housekeeping

    def stats(self) -> DataFrame:
        return indexing.index_stats(self.read()).withColumn("dim", F.lit(self.dim))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Drop all but the last ``keep`` versions of this branch, and the files that no version of any branch needs any more; the dropped versions' names.

        Lineage ends at what is dropped: branches that part before have no common ancestor then.
        """
        numbers = self.versions()
        old = numbers[: max(0, len(numbers) - max(1, keep))]
        dropped = [self.manifest(n) for n in old]
        for n in old:
            remove(self.spark, self._at(n))
        needed = set()
        for b in names_in(self.spark, f"{self.root}/versions"):
            for n in names_in(self.spark, f"{self.root}/versions/{b}"):
                if n.endswith(".json") and not n.startswith("."):
                    needed |= self._places(json.loads(read_text(self.spark, f"{self.root}/versions/{b}/{n}")))
        for kind, seg, b in sorted({p for m in dropped for p in self._places(m)} - needed):
            remove(self.spark, f"{self.root}/{kind}/_seg={seg}" + ("" if not any(k == kind and s == seg for k, s, _ in needed) else f"/_bucket={b}"))
        return [f"v={n}" for n in old if n]

    @staticmethod
    def _places(m: dict) -> set[tuple[str, str, int]]:
        return {(kind, s["id"], b) for s in m["segments"] for kind in ("data", "log") for b in s[kind]}


def merge_tables(spark: SparkSession, ancestor: str | None, current: str, other: str | None) -> bool:
    """Merge Parquet tables of chunks into ``current``: all rows of the tables that exist, one per file_hash, model and chunk_idx.

    A row comes from current, else other, else the ancestor.  The result is written beside the
    table and takes its place at the end.  False if none of the tables exists.
    """
    found = {n: spark.read.parquet(p) for n, p in (("current", current), ("other", other), ("ancestor", ancestor)) if p and exists(spark, p)}
    if not found:
        return False
    sides = list(found.values())
    rows = indexing.merge_union(sides[0], sides[1], sides[2] if len(sides) > 2 else None) if len(sides) > 1 else indexing.merge_union(sides[0], sides[0].limit(0))
    fresh = f"{current.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(fresh)
    fs, at = file_of(spark, current)
    if fs.exists(at):
        fs.delete(at, True)
    fs.rename(file_of(spark, fresh)[1], at)
    return True
