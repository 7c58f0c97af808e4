"""Scalar helpers as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}\p{Pc}]+"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def after_last(c: Column, mark: str = ":") -> Column:
    return F.substring_index(c, mark, -1)


def bare_name(c: Column) -> Column:
    """The text after the last colon, without backticks."""
    return F.btrim(after_last(c), F.lit("`"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The part after the last dot of a name that doesn't begin with it; empty if there is none."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def without_prefix(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, len(root) + 1, 2**30)).otherwise(path)


def occurrences(c: Column, what: str) -> Column:
    """How often a non-empty string occurs, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")


def cyclomatic(c: Column, words: tuple[str, ...]) -> Column:
    """One more than the occurrences of all given substrings."""
    return sum((occurrences(c, w) for w in words), F.lit(1))


def line_of(c: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.length(F.substring(c, F.lit(1), offset)) - F.length(F.replace(F.substring(c, F.lit(1), offset), F.lit("\n"), F.lit(""))) + 1


def lines_between(c: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(F.split(c, "\n"), first, last - first + 1), "\n")


def stripped(c: Column, lead: str, tail: str = "") -> Column:
    """Without all repetitions of lead in front and of tail behind; both are plain strings."""
    quoted = lambda x: "".join(f"\\x{{{ord(k):x}}}" for k in x)
    c = F.regexp_replace(c, f"^(?:{quoted(lead)})+", "") if lead else c
    return F.regexp_replace(c, f"(?:{quoted(tail)})+$", "") if tail else c


def to_the_minute(c: Column) -> Column:
    """A time as year-month-day hour:minute."""
    return F.date_format(c, "yyyy-MM-dd HH:mm")


def html_escaped(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def simple_name(c: Column) -> Column:
    """A type's own name: cut at the first of < { ( #, without a leading "impl ", the last :: segment, at most 30 characters."""
    c = F.trim(F.regexp_extract(c, r"^[^<{(#]*", 0))
    c = F.trim(F.regexp_replace(c, r"^impl ", ""))
    c = F.substring_index(c, "::", -1)
    return F.when(F.length(c) > 30, F.concat(F.substring(c, 1, 27), F.lit("..."))).otherwise(c)


def task_name(prompt: Column) -> Column:
    """The first five words, joined by dashes, lower case, letters, digits and dashes only."""
    words = F.slice(F.filter(F.split(prompt, r"\s+"), lambda w: w != ""), 1, 5)
    return F.regexp_replace(F.lower(F.array_join(words, "-")), r"[^\p{L}\p{N}-]", "")


def capital(name: Column) -> Column:
    """Whether the first letter is a capital one."""
    return name.rlike(r"^\p{Lu}")


def word(c: Column) -> Column:
    """Whether a text is one word of letters, digits and underscores, of any script."""
    return c.rlike(r"^(?U)\w+$")


def kilobytes(size: Column) -> Column:
    """Whole kilobytes."""
    return F.floor(size / 1024).cast("long")


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 8)


def signature(c: Column) -> Column:
    """First line without the mark that opens a body."""
    return trimmed(F.regexp_replace(F.element_at(F.split(c, "\n"), 1), r"\s*(\{|:|=>)\s*$", ""))


def json_block(c: Column) -> Column:
    """The JSON in an answer: a fenced block, else from the first { to the last }."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.nullif(F.when(fenced != "", fenced).otherwise(bare), F.lit(""))


def sse_token(line: Column) -> Column:
    """The text that one line of a completion stream adds, null if none."""
    data = F.when(F.startswith(line, F.lit("data: ")) & (line != "data: [DONE]"), F.substring(line, 7, 2**30))
    return F.nullif(F.get_json_object(data, "$.choices[0].delta.content"), F.lit(""))


def sse_delta(event: Column) -> Column:
    """The text of one event of the other stream form: only content_block_delta carries any."""
    data = F.when(event.contains("event: content_block_delta"), F.regexp_extract(event, r"data: (.*)", 1))
    return F.nullif(F.get_json_object(data, "$.delta.text"), F.lit(""))


def next_phase(c: Column) -> Column:
    return F.when(c == "research", "planning").when(c == "planning", "agent").when(c == "agent", "complete")


def can_advance(phase: Column, research_doc: Column, plan: Column) -> Column:
    return F.when(phase == "research", research_doc.isNotNull()).when(phase == "planning", plan.isNotNull()).otherwise(phase == "agent")


def lookup(c: Column, values: dict[str, str], default: str | None = None) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default)) if default is not None else F.create_map(*pairs)[c]


def in_excluded_dir(path: Column, names: list[str], mode: str = "substring") -> Column:
    """Whether a path is excluded: by substring anywhere (default), or by whole path segments."""
    if mode == "segment":
        return F.exists(F.split(path, "/"), lambda s: s.isin(*names))
    return F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(path, n))


def listed(c: Column, n: int | None = None) -> Column:
    """Distinct values in order, joined by a comma; the first n of them."""
    found = F.array_sort(F.collect_set(c))
    return F.array_join(F.slice(found, 1, n) if n else found, ", ")
