"""Context assembly: directory tree, size budget, prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.session import cut
from tessera.sources.documents import write_document

# Fixed values.
MAX_FILE, MAX_TOTAL = 100 * 1024, 500 * 1024
EXTENSIONS = (
    "rs", "toml", "js", "ts", "jsx", "tsx", "mjs", "cjs", "py", "pyi", "go", "mod", "sum", "java", "kt", "kts", "c", "h", "cpp", "hpp", "cc", "hh", "cs", "csproj",
    "rb", "rake", "gemspec", "php", "swift", "html", "css", "scss", "sass", "less", "json", "yaml", "yml", "xml", "sh", "bash", "zsh", "md", "txt", "rst",
    "Makefile", "Dockerfile", "Containerfile",
)
EXCLUDED = (
    ".git", ".svn", ".hg", "node_modules", "vendor", "venv", ".venv", "env", "__pycache__", ".pytest_cache", "target", "build", "dist", "out", "bin", "obj",
    ".idea", ".vscode", ".vs", "coverage", ".coverage", ".nyc_output", ".next", ".nuxt", ".cache",
)


def eligible(path: Column) -> Column:
    """Whether a file goes into a plain context, by its extension; a name of EXTENSIONS without a dot is none."""
    return X.extension(path).isin(*EXTENSIONS)


def tree_entries(paths: DataFrame, path: str = "path") -> DataFrame:
    """entry, parent, name, depth, is_dir: every file and every directory above one."""
    parts = paths.select(F.split(path, "/").alias("_p"))
    steps = parts.select("_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("depth"))
    rows = steps.select(F.array_join(F.slice("_p", 1, F.col("depth")), "/").alias("entry"), F.array_join(F.slice("_p", 1, F.col("depth") - 1), "/").alias("parent"), F.col("_p")[F.col("depth") - 1].alias("name"), "depth", (F.col("depth") < F.size("_p")).alias("is_dir"))
    return rows.distinct()


def tree_lines(paths: DataFrame, path: str = "path") -> DataFrame:
    """entry, place (arrays in the order of the tree, directories first), text: a line of the tree for every file and directory.

    The last entry below each directory is an aggregate, so a directory of very many files is no hot spot; what stands in
    front of a name follows from which of the directories above it are the last of theirs.
    """
    entries = cut(tree_entries(paths, path))
    last = entries.groupBy("parent").agg(F.max(F.struct((~F.col("is_dir")).alias("plain"), "name")).alias("_last"))
    flagged = entries.join(last, "parent").withColumn("is_last", F.struct((~F.col("is_dir")).alias("plain"), "name") == F.col("_last")).drop("_last")
    steps = entries.where("depth > 1").select("entry", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("at"), F.split("entry", "/").alias("_p"))
    above = steps.select("entry", "at", F.array_join(F.slice("_p", 1, F.col("at")), "/").alias("_above"))
    # of the directories only; what is below one of them is put together before it is shuffled
    lead = above.join(flagged.where("is_dir").select(F.col("entry").alias("_above"), F.col("is_last").alias("_closed")), "_above").groupBy("entry").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_closed"))), lambda x: F.when(x["_closed"], "    ").otherwise("│   ")), "").alias("lead")
    )
    names = F.split("entry", "/")
    place = F.transform(names, lambda n, k: F.concat(F.when((k + 1 < F.col("depth")) | F.col("is_dir"), "0").otherwise("1"), n))
    text = F.concat(F.coalesce("lead", F.lit("")), F.when(F.col("is_last"), "└── ").otherwise("├── "), "name", F.when(F.col("is_dir"), "/").otherwise(""))
    return flagged.join(lead, "entry", "left").select("entry", place.alias("place"), text.alias("text"))


def write_tree(paths: DataFrame, to: str, path: str = "path") -> None:
    """The tree as an ordered document, written in parallel."""
    write_document(tree_lines(paths, path).withColumn("section", F.lit(0)), to, ("place",), tail="")


def rendered_tree(paths: DataFrame, path: str = "path") -> str:
    """The tree as text, directories first, for the files of a prompt: as many lines as its budget has files come to the driver."""
    return "\n".join(r["text"] for r in tree_lines(paths, path).orderBy("place").collect())


def within_budget(files: DataFrame, path: str = "path", size: str = "size", max_file: int = MAX_FILE, max_total: int = MAX_TOTAL, excluded: tuple[str, ...] = (), mode: str = "substring") -> DataFrame:
    """The files in path order, each of max_file bytes at most, up to the first that would exceed max_total in all.

    Of files that aren't empty no more than max_total can be taken, so for a budget of up to ONE_TASK bytes the running sum is
    over the first max_total + 1 of them (a top-k, no full sort), however many files there are. For larger ones files are dealt
    out by ranges of the path, whose sums tell in which range the budget ends; ranges behind it are not summed up. Empty files
    are taken up to the one at which the scan stops. It is decided on paths and sizes alone; the taken files' other columns
    are looked up by path.
    """
    if set(files.columns) > {path, size}:
        taken = within_budget(files.select(path, size), path, size, max_file, max_total, excluded, mode)
        return files.join(taken.select(path), path, "left_semi")
    fit = files.where(F.col(size) <= max_file)
    if excluded:
        fit = fit.where(~X.in_excluded_dir(F.col(path), list(excluded), mode))
    running = _running(fit.where(F.col(size) > 0), path, size, max_total)
    stop = running.where(F.col("_sum") > max_total).agg(F.min(path)).scalar()
    empty = fit.where(F.col(size) == 0).where(stop.isNull() | (F.col(path) < stop))
    return running.where(F.col("_sum") <= max_total).drop("_sum").unionByName(empty)


#: Rows that a single task may sum up in order.
ONE_TASK = 1 << 20


def _running(rows: DataFrame, path: str, size: str, most: int) -> DataFrame:
    """rows with _sum, the sizes up to and with each in path order; at least those up to the first beyond `most`."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if most < ONE_TASK:
        return rows.orderBy(path).limit(most + 1).withColumn("_sum", F.sum(size).over(upto(Window.orderBy(path))))
    dealt = cut(rows.repartitionByRange(path).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(F.sum(size).alias("_own")).withColumn("_before", F.sum("_own").over(upto(Window.orderBy("_range"))) - F.col("_own"))
    begun = F.broadcast(ranges.where(F.col("_before") <= most).drop("_own"))  # a row for each partition
    return dealt.join(begun, "_range").withColumn("_sum", F.col("_before") + F.sum(size).over(upto(Window.partitionBy("_range").orderBy(path)))).drop("_range", "_before")


def prompt_parts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """ordinal-free parts of a prompt: path and its section."""
    return files.select(F.col(path).alias("path"), F.concat(F.lit("### "), F.col(path), F.lit("\n```\n"), F.col(content), F.lit("\n```\n")).alias("part"))


#: Hits whose names are broadcast; a search gives 15.
FEW_HITS = 10_000


def smart_sections(hits: DataFrame, calls: DataFrame, n: int = 5) -> DataFrame:
    """Search hits with their relations. hits: rank, path, score, start_line, end_line, preview, entity_id, entity_type.

    Adds: source (of a path's first hit), part, and the relation lines, at most n names each. The hits are found first; of the
    calls only those of their names go on, and no more than n names of each are put together.
    """
    from tessera.operators.graph import first_names

    hits = cut(hits)
    name = X.bare_name(F.col("entity_id"))
    names = hits.select(name.alias("_n")).where("_n is not null").distinct()
    names = F.broadcast(names) if hits.count() <= FEW_HITS else names

    def related(by: str, other: str, into: str) -> DataFrame:
        own = calls.select(by, other).join(names, F.col(by) == F.col("_n"), "left_semi")
        return first_names(own, by, other, n).select(F.col(by).alias("_n"), F.col("names").alias(into))

    deps, hit = related("caller_name", "callee_name", "_deps"), related("callee_name", "caller_name", "_hit")
    first = F.row_number().over(Window.partitionBy("path").orderBy("rank")) == 1
    span = F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    lead = F.concat(F.lit("- **"), F.col("entity_type"), F.lit("** `"), F.col("entity_id"), F.lit("`"))
    rows = hits.withColumn("_name", name).join(deps, F.col("_name") == deps["_n"], "left").drop("_n").join(hit, F.col("_name") == hit["_n"], "left").drop("_n")
    return rows.select(
        "rank",
        F.when(first, F.concat(span, F.lit(" (score: "), F.format_string("%.2f", "score"), F.lit(")"))).alias("source"),
        F.when(F.col("preview").isNotNull(), F.concat(F.lit("### "), F.col("path"), F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")\n```\n"), F.col("preview"), F.lit("\n```"))).alias("part"),
        F.concat(lead, F.lit(" calls: "), F.col("_deps")).alias("calls"),
        F.concat(lead, F.lit(" is called by: "), F.col("_hit")).alias("called_by"),
    )


def joined(sections: DataFrame, column: str, order: str, mark: str = "\n\n") -> DataFrame:
    """One text of all sections in order; a prompt is bounded by its budget."""
    kept = sections.where(F.col(column).isNotNull())
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), mark).alias("text"))
