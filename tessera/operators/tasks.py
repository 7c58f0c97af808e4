"""Task records: lifecycle, listing, documents and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as X

# Fixed values.
COMPLEXITIES = ("low", "medium", "high")
ANSWER = "summary string, findings array<struct<title: string, description: string, related_files: array<string>>>, dependencies array<struct<name: string, description: string, is_external: boolean>>, suggested_approach string"


def listing(tasks: DataFrame) -> DataFrame:
    """Newest first; ties by id."""
    return tasks.orderBy(F.desc("updated_at"), "id")


def by_prefix(tasks: DataFrame, prefix: str) -> DataFrame:
    """outcome (none, one, many), n and the id if it is one."""
    found = tasks.where(F.startswith("id", F.lit(prefix)))
    n = F.count(F.lit(1))
    return found.agg(F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("outcome"), n.alias("n"), F.when(n == 1, F.min("id")).alias("id"))


def advanced(tasks: DataFrame) -> DataFrame:
    """Every task with can_advance and the phase it would come to."""
    can = F.coalesce(X.can_advance(F.col("phase"), F.col("research_doc"), F.col("plan")), F.lit(False))
    return tasks.withColumn("can_advance", can).withColumn("next_phase", F.when(can, X.next_phase(F.col("phase"))))


def created(prompt: str) -> dict:
    """A new task record in its first phase."""
    import datetime
    import re
    import uuid

    name = re.sub(r"[^\w-]|_", "", "-".join(prompt.split()[:5]).lower())
    now = datetime.datetime.now(datetime.UTC)
    return {"id": str(uuid.uuid4()), "name": name, "prompt": prompt, "phase": schemas.PHASES[0], "created_at": now, "updated_at": now, "research_doc": None, "plan": None}


def without(tasks: DataFrame, pointer: DataFrame, task_id: str) -> tuple[DataFrame, DataFrame]:
    """Tasks and the current-task pointer (column id) after a deletion."""
    return tasks.where(F.col("id") != task_id), pointer.where(F.col("id") != task_id)


def current(tasks: DataFrame, pointer: DataFrame) -> DataFrame:
    return tasks.join(pointer.select("id"), "id", "left_semi")


def parsed_answer(answer: Column) -> Column:
    """The fields of an answer's JSON; null if a required one is missing. Lists of related files default to empty."""

    def made(parsed: Column) -> Column:
        findings = F.transform(parsed["findings"], lambda f: F.struct(f["title"].alias("title"), f["description"].alias("description"), F.coalesce(f["related_files"], F.array().cast("array<string>")).alias("related_files")))
        complete = parsed["summary"].isNotNull() & parsed["findings"].isNotNull() & parsed["dependencies"].isNotNull() & parsed["suggested_approach"].isNotNull()
        whole = ~F.exists(parsed["findings"], lambda f: f["title"].isNull() | f["description"].isNull()) & ~F.exists(parsed["dependencies"], lambda d: d["name"].isNull() | d["description"].isNull() | d["is_external"].isNull())
        return F.when(complete & whole, F.struct(parsed["summary"].alias("summary"), findings.alias("findings"), parsed["dependencies"].alias("dependencies"), parsed["suggested_approach"].alias("suggested_approach")))

    # a variable of a lambda function: else the text would be parsed for each use of a field
    return F.transform(F.array(F.from_json(X.json_block(answer), ANSWER)), made)[0]


def research_prompt(task: Column, context: Column) -> Column:
    """What is asked of a model for a task, given the context found for it."""
    lead = "Study the code below for this task and answer in JSON with summary, findings, dependencies and suggested_approach."
    return F.concat(F.lit(f"{lead}\n\nTask: "), task, F.lit("\n\n"), F.coalesce(context, F.lit("")))


def refinement_prompt(summary: Column, approach: Column, feedback: Column) -> Column:
    """What is asked of a model about an earlier answer."""
    part = lambda title, c: F.concat(F.lit(f"{title}:\n"), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n\n", F.lit("Revise the answer below."), part("Summary", summary), part("Suggested approach", approach), part("What to change", feedback))


def documents(rows: DataFrame) -> DataFrame:
    """rows of the schema ResearchDoc → task_name, text: each as Markdown. Empty or null lists have no section."""
    none = lambda c: F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c]))
    files = lambda f: F.transform(F.coalesce(f["related_files"], F.array().cast("array<string>")), lambda x: F.concat(F.lit("- `"), x, F.lit("`")))
    finding = lambda f: F.concat(F.array(F.concat(F.lit("### "), f["title"]), F.lit(""), f["description"], F.lit("")), files(f))
    dependency = lambda d: F.array(F.concat(F.lit("### "), d["name"]), F.lit(""), d["description"], F.lit(""))
    section = lambda title, c, lines: F.when(F.size(none(c)) > 0, F.concat(F.array(F.lit(f"## {title}"), F.lit("")), lines)).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.concat(F.lit("# Research: "), "task_name"), F.lit(""), F.lit("## Summary"), F.lit(""), F.col("summary"), F.lit("")),
        section("Codebase analysis", "codebase_analysis", F.flatten(F.transform(none("codebase_analysis"), finding))),
        section("Dependencies", "dependencies", F.flatten(F.transform(none("dependencies"), dependency))),
        F.array(F.lit("## Suggested approach"), F.lit(""), F.col("suggested_approach"), F.lit("")),
        section("Sources", "sources", F.transform(none("sources"), lambda x: F.concat(F.lit("- "), x))),
    )
    return rows.select("task_name", F.array_join(lines, "\n").alias("text"))


def markdown(doc: dict) -> str:
    """A research document as Markdown."""
    out = [f"# Research: {doc['task_name']}", "", "## Summary", "", doc["summary"], ""]
    for title, part in (("Codebase analysis", "codebase_analysis"), ("Dependencies", "dependencies")):
        if doc.get(part):
            out += [f"## {title}", ""]
            for x in doc[part]:
                out += [f"### {x.get('title') or x.get('name')}", "", x["description"], ""]
                out += [f"- `{f}`" for f in x.get("related_files") or []]
    out += ["## Suggested approach", "", doc["suggested_approach"], ""]
    if doc.get("sources"):
        out += ["## Sources", "", *[f"- {s}" for s in doc["sources"]]]
    return "\n".join(out)


def plan_items(plans: DataFrame) -> DataFrame:
    """task_name, ordinal, action, path: files to create, then files to modify."""
    create = F.transform("files_to_create", lambda f: F.struct(F.lit("create").alias("action"), f["path"].alias("path")))
    modify = F.transform("files_to_modify", lambda f: F.struct(F.lit("modify").alias("action"), f["path"].alias("path")))
    return plans.select("task_name", F.posexplode(F.concat(create, modify)).alias("ordinal", "_i")).select("task_name", "ordinal", "_i.*")


def files_affected(plans: DataFrame) -> DataFrame:
    """task_name, files: how many files a plan creates and modifies."""
    return plans.select("task_name", (F.size("files_to_create") + F.size("files_to_modify")).alias("files"))


def cursor(items: DataFrame, results: DataFrame) -> DataFrame:
    """Of each plan: how many items it has and how many are done, and the first that is not: task_name, total, completed, next_ordinal, action, path. items: plan_items; results: task_name, ordinal."""
    done = results.select("task_name", "ordinal", F.lit(True).alias("_done")).distinct()
    rows = items.join(done, ["task_name", "ordinal"], "left")
    left = F.when(F.col("_done").isNull(), F.struct("ordinal", "action", "path"))
    found = rows.groupBy("task_name").agg(F.count(F.lit(1)).alias("total"), F.count("_done").alias("completed"), F.min(left).alias("_next"))
    return found.select("task_name", "total", "completed", F.col("_next.ordinal").alias("next_ordinal"), "_next.action", "_next.path")


def progress(results: DataFrame) -> DataFrame:
    """task_name, total, completed, all_passed over execution results (column conformance)."""
    done = F.col("conformance").isNotNull()
    return results.groupBy("task_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("completed"), F.every(F.coalesce(F.col("conformance") == "passed", F.lit(False))).alias("all_passed"))
