"""Carrying out a plan of writes: effects on files, a journal of what is done, and records of the outcome.

A plan becomes effects, each of which is safe to repeat: a whole file to be written, or a
path to be gone.  They are written down before the first is carried out, and each leaves a mark
behind when it is done, so a run that was cut off ends the same way when it is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import exists, names_in, remove, write_text
from . import routing

#: Fixed value: the file of notes that a patch goes to, under the project.
NOTES = "CLAUDE.md"
#: Marks around what is appended to it.
NOTES_START, NOTES_END = "<!-- tessera:notes:start -->", "<!-- tessera:notes:end -->"
SKILL_DESCRIPTION = "(written by a session's review)"


def skill_text(title: F.Column, content: F.Column, description: str = SKILL_DESCRIPTION) -> F.Column:
    """The file of a skill: front matter with name and description, then the content."""
    front = X.yaml_front([("name", title), ("description", F.lit(description)), ("source", F.lit("review"))])
    return F.concat(front, F.lit("\n\n"), X.strip(content), F.lit("\n"))


def records(plan: DataFrame, directories: dict[str, str]) -> DataFrame:
    """``plan`` with the path each row is about; empty where nothing is touched.  ``directories`` maps categories to theirs."""
    d = F.create_map(*[F.lit(x) for kv in directories.items() for x in kv]) if directories else F.lit(None).cast("map<string,string>")
    own = F.try_element_at(d, F.col("category"))
    file = F.when(F.col("category") == "project_skill", F.concat(own, F.lit("/"), F.col("slug"), F.lit("/SKILL.md"))).otherwise(F.concat(own, F.lit("/"), F.col("slug"), F.lit(".md")))
    return plan.withColumn("path", F.when(F.col("status") == "skipped", "").when(F.col("status") == "appended", own).otherwise(F.coalesce(file, F.lit(""))))


def effects(records: DataFrame, items: DataFrame, existing: DataFrame, now: str, *, notes: str = "") -> DataFrame:
    """What is to be done, one row per path: path, kind (write or delete), text, item_no.

    ``records`` come from ``records``, ``items`` are the items of the plan, ``existing`` (path,
    created_at) the memories there are: a memory that is written anew keeps its creation.  Of several rows about
    one path the last by item_no and part counts; what is appended to the notes, whose text is ``notes``,
    is appended in the order of item_no and makes one file.
    """
    full = records.filter("status <> 'skipped' AND path <> ''").join(items.select("item_no", "content", F.col("tags").alias("_tags")), "item_no")
    gone = F.col("status").isin("deleted", "merge_source_deleted")
    old = existing.groupBy("path").agg(F.max(F.nullif("created_at", F.lit(""))).alias("_created"))
    last = full.filter("status <> 'appended'").groupBy("path").agg(F.max_by(F.struct("category", "title", "content", "_tags", gone.alias("gone"), "item_no"), F.struct("item_no", "part")).alias("_e"))
    rows = last.select("path", "_e.*").join(old, "path", "left")
    memory = routing.memory_text(F.col("title"), F.col("content"), F.coalesce("_created", F.lit(now)), F.lit(now), [("category", F.col("category")), ("source", F.lit("review"))], F.col("_tags"))
    text = F.when(~F.col("gone"), F.when(F.col("category") == "project_skill", skill_text(F.col("title"), F.col("content"))).otherwise(memory))
    files = rows.select("path", F.when(F.col("gone"), "delete").otherwise("write").alias("kind"), text.alias("text"), "item_no")
    added = full.filter("status = 'appended'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("item_no", "content"))).alias("_all"))
    whole = F.aggregate("_all", F.lit(notes), lambda t, x: routing.append_block(t, x["content"], now, NOTES_START, NOTES_END))
    return files.unionByName(added.select("path", F.lit("write").alias("kind"), whole.alias("text"), F.element_at("_all", -1)["item_no"].alias("item_no")))


def carry_out(spark: SparkSession, made: Callable[[], DataFrame], journal: str, *, before: Callable[[Row], None] | None = None) -> int:
    """Carry out the effects that ``made`` gives, under a journal of this run; how many were still to be done.

    The effects are stored in the journal first; if they are there already, because an earlier run
    was cut off, they are taken from it and ``made`` isn't asked again.  Files are written before any
    is deleted, so that a merge never loses its sources first.  The driver takes effects one by one from
    a stream of partitions.  ``before`` is called before each, for tests.
    """
    if not exists(spark, f"{journal}/effects/_SUCCESS"):
        made().write.mode("overwrite").parquet(f"{journal}/effects")
    done, n = set(names_in(spark, f"{journal}/done")), 0
    rows = spark.read.parquet(f"{journal}/effects").orderBy(F.col("kind") == "delete", "item_no", "path")
    for r in rows.toLocalIterator():
        mark = hashlib.sha256(f"{r.kind}\n{r.path}\n{r.text}".encode()).hexdigest()[:32]
        if mark in done:
            continue
        if before:
            before(r)
        if r.kind == "delete":
            remove(spark, r.path)
        else:
            write_text(spark, r.path, r.text)
        write_text(spark, f"{journal}/done/{mark}", r.path)
        n += 1
    return n
