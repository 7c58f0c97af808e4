"""Call lookups and the projection of entities and edges onto one graph."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X

# Colour and size of a category.
STYLE = {"function": ("#0969da", 8), "method": ("#0969da", 8), "struct": ("#1a7f37", 12), "class": ("#1a7f37", 12), "trait": ("#9a6700", 12), "interface": ("#9a6700", 12), "enum": ("#cf222e", 12), "impl": ("#8250df", 10)}
OTHER = ("#57606a", 6)
PREFIX = {"function": "fn", "struct": "struct", "trait": "trait", "enum": "enum", "impl": "impl"}
#: Families in the order in which they enter the id map; later ones win.
RANK = {"function": 0, "struct": 1, "trait": 2, "enum": 3}


def call_edges(edges: DataFrame) -> DataFrame:
    """src, dst → the four-column call table: ids and the names behind their last colon."""
    return edges.select(F.col("src").alias("caller_id"), F.col("dst").alias("callee_id"), X.after_last(F.col("src")).alias("caller_name"), X.after_last(F.col("dst")).alias("callee_name"))


def contained(rows: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst of the relations from a file to what it contains, for files that are known (column path)."""
    known = files.select(F.concat(F.lit("file:"), "path").alias("src")).distinct()
    return rows.where("edge_type = 'contains'").select("src", "dst").join(known, "src", "left_semi")


def known_calls(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """The call edges to functions that exist, their ends being the first function, by id, of the name called."""
    first = functions.groupBy(F.concat(F.lit("function:?:"), "name").alias("dst")).agg(F.min("id").alias("_id"))
    calls = rows.where("edge_type = 'calls'")
    return calls.join(first, "dst").withColumn("dst", F.col("_id")).select(*calls.columns)


def implementations(rows: DataFrame) -> DataFrame:
    return rows.where("edge_type = 'implements'").select(F.col("src").alias("impl_id"), F.col("dst").alias("trait_id"))


def dependencies(calls: DataFrame, entity: str, loose: bool = False) -> DataFrame:
    """Distinct names that an entity calls, in order. loose: also by the part after the last dot."""
    name = F.lit(entity.rsplit(":", 1)[-1].strip("`"))
    own = F.col("caller_name") == name
    own = own | (X.after_last(F.col("caller_name"), ".") == name) if loose else own
    return calls.where(own).select(F.col("callee_name").alias("name")).distinct().orderBy("name")


def impact(calls: DataFrame, entity: str, loose: bool = False) -> DataFrame:
    """Distinct names that call an entity, in order."""
    name = F.lit(entity.rsplit(":", 1)[-1].strip("`"))
    own = F.col("callee_name") == name
    own = own | (X.after_last(F.col("callee_name"), ".") == name) if loose else own
    return calls.where(own).select(F.col("caller_name").alias("name")).distinct().orderBy("name")


def lists(calls: DataFrame, by: str, other: str, n: int | None = None) -> DataFrame:
    """For each name the distinct names at the other end, in order, joined by commas, and how many they are; of the names the first n only.

    With n, no more than n names of a name ever meet: each task keeps n of its own (WindowGroupLimit), and they are counted apart.
    """
    pairs = calls.select(by, other).distinct()
    if n is None:
        return pairs.groupBy(by).agg(X.listed(F.col(other), n).alias("names"), F.count(F.lit(1)).alias("n"))
    return first_names(calls, by, other, n).join(pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by)


def first_names(calls: DataFrame, by: str, other: str, n: int) -> DataFrame:
    """For each name the first n distinct names at the other end, in order, joined by commas."""
    ranked = calls.select(by, other).where(F.col(by).isNotNull() & F.col(other).isNotNull()).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(other)))
    return ranked.where(F.col("_rank") <= n).groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(other)), ", ").alias("names"))


def style(category: Column) -> tuple[Column, Column]:
    color = X.lookup(category, {k: v[0] for k, v in STYLE.items()}, OTHER[0])
    size = F.coalesce(F.create_map(*[F.lit(x) for k, v in STYLE.items() for x in (k, v[1])])[category], F.lit(OTHER[1]))
    return color, size


def nodes(entities: DataFrame) -> DataFrame:
    """Graph nodes. entities: family, ordinal, name, qualified_name, file_path, start_line, end_line, target_type, trait_name.

    Impls are labelled by trait and type; keys are prefix:file:line:name; of equal keys the first family, then the first row, stays.
    """
    target, trait = X.simple_name(F.col("target_type")), X.simple_name(F.col("trait_name"))
    label = F.when(F.col("family") == "impl", F.when(F.col("trait_name").isNotNull(), F.concat(trait, F.lit(" for "), target)).otherwise(target)).otherwise(F.col("name"))
    color, size = style(F.col("family"))
    key = F.concat_ws(":", X.lookup(F.col("family"), PREFIX), "file_path", F.col("start_line").cast("string"), label)
    rank = F.create_map(*[F.lit(x) for k, v in {**RANK, "impl": 4}.items() for x in (k, v)])[F.col("family")]
    made = entities.select(key.alias("key"), label.alias("label"), F.col("family").alias("category"), color.alias("color"), size.alias("size"), "file_path", "start_line", "end_line", F.struct(rank.alias("r"), F.col("ordinal").alias("o")).alias("_order"))
    row = F.struct("label", "category", "color", "size", "file_path", "start_line", "end_line")
    return made.groupBy("key").agg(F.min_by(row, F.col("_order")).alias("_row")).select("key", "_row.*")


def id_map(entities: DataFrame) -> DataFrame:
    """id → key. Functions enter by qualified name, by function:file:name and by name, the other families by qualified name and name; the last entry of an id wins."""
    used = entities.where(F.col("family").isin(*RANK))
    ids = F.when(F.col("family") == "function", F.array("qualified_name", F.concat_ws(":", F.lit("function"), "file_path", "name"), "name")).otherwise(F.array("qualified_name", "name"))
    key = F.concat_ws(":", X.lookup(F.col("family"), PREFIX), "file_path", F.col("start_line").cast("string"), "name")
    rank = F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (k, v)])[F.col("family")]
    rows = used.select(F.explode(ids).alias("id"), key.alias("key"), F.struct(rank.alias("r"), F.col("ordinal").alias("o")).alias("_order"))
    return rows.groupBy("id").agg(F.max_by("key", "_order").alias("key"))


def resolved_calls(calls: DataFrame, ids: DataFrame, repeated: bool = False) -> DataFrame:
    """Distinct (unless repeated is set) call edges between known nodes: an end is looked up by id, then by name.

    Distinct ends are looked up, callers and callees together and by id and name at once, so the id map is joined once and a
    caller with very many calls is asked for once. Calls are shuffled for the two joins with what was found, if that is too
    large to be broadcast, and are made distinct last, behind sums within each task.
    """
    edges = calls.select("caller_id", "caller_name", "callee_id", "callee_name")
    ends = edges.select(F.explode(F.array(*[F.struct(F.col(f"{e}_id").alias("end_id"), F.col(f"{e}_name").alias("end_name")) for e in ("caller", "callee")])).alias("e")).select("e.*").distinct()
    asked = ends.select("end_id", "end_name", F.posexplode(F.array("end_id", "end_name")).alias("nth", "id"))
    found = asked.join(ids, "id").groupBy("end_id", "end_name").agg(F.min_by("key", "nth").alias("key"))
    for e, into in (("caller", "src"), ("callee", "dst")):
        own = found.select(F.col("end_id").alias("_id"), F.col("end_name").alias("_name"), F.col("key").alias(into))
        edges = edges.join(own, F.col(f"{e}_id").eqNullSafe(F.col("_id")) & F.col(f"{e}_name").eqNullSafe(F.col("_name"))).drop("_id", "_name")
    edges = edges.select("src", F.lit("calls").alias("rel"), "dst")
    return edges if repeated else edges.distinct()


def implements_edges(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """impl → trait, by the trait's simple name."""
    impls = entities.where((F.col("family") == "impl") & F.col("trait_name").isNotNull())
    trait, target = X.simple_name(F.col("trait_name")), X.simple_name(F.col("target_type"))
    key = F.concat_ws(":", F.lit("impl"), "file_path", F.col("start_line").cast("string"), F.concat(trait, F.lit(" for "), target))
    return impls.select(key.alias("src"), trait.alias("id")).join(ids, "id").select("src", F.lit("implements").alias("rel"), F.col("key").alias("dst")).distinct()


def method_edges(entities: DataFrame, ids: DataFrame) -> DataFrame:
    """parent → method, by the parent's simple name."""
    methods = entities.where((F.col("family") == "function") & F.col("parent").isNotNull())
    key = F.concat_ws(":", F.lit("fn"), "file_path", F.col("start_line").cast("string"), "name")
    return methods.select(key.alias("dst"), X.simple_name(F.col("parent")).alias("id")).join(ids, "id").select(F.col("key").alias("src"), F.lit("has_method").alias("rel"), "dst").distinct()


def known_only(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    keys = known.select("key")
    return edges.join(keys.withColumnRenamed("key", "src"), "src", "left_semi").join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi").select("src", "rel", "dst")


def graph(entities: DataFrame, calls: DataFrame, repeated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the whole graph. Both ends of every edge are keys of rows of entities, so they are nodes; each relation is distinct in itself.

    With repeated, calls may come more than once: for what makes edges distinct by itself, so that they are not shuffled for it twice.
    """
    ids = id_map(entities)
    return nodes(entities), resolved_calls(calls, ids, repeated).unionByName(implements_edges(entities, ids)).unionByName(method_edges(entities, ids))


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair, whatever the relations: src, dst."""
    return edges.select("src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """key, out_degree, in_degree over distinct pairs."""
    pairs = simple_edges(edges)
    ends = pairs.select(F.col("src").alias("key"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select(F.col("dst").alias("key"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("key").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def neighbours(edges: DataFrame, key: str) -> DataFrame:
    """The keys one step from a node in either direction, itself included."""
    near = edges.where((F.col("src") == key) | (F.col("dst") == key))
    return near.select(F.explode(F.array("src", "dst")).alias("key")).distinct()


def around(entities: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """neighbours of the whole graph's edges, of which only calls that name an id of the node are resolved.

    A call's end is the node only if its id or its name is one of the node's ids.
    """
    ids = id_map(entities)
    own = ids.where(F.col("key") == key).agg(F.collect_set("id").alias("ids")).scalar()
    named = functools.reduce(Column.__or__, [F.coalesce(F.array_contains(own, F.col(c)), F.lit(False)) for c in ("caller_id", "caller_name", "callee_id", "callee_name")])
    return neighbours(resolved_calls(calls.where(named), ids).unionByName(implements_edges(entities, ids)).unionByName(method_edges(entities, ids)), key)


def node_detail(nodes_: DataFrame, calls: DataFrame) -> DataFrame:
    """key, node_type, label, dependencies, impact: the type by the key's prefix (none for impl), the names called and calling."""
    back = {v: k for k, v in PREFIX.items() if k != "impl"}
    kind = X.lookup(F.substring_index("key", ":", 1), back)
    deps = lists(calls, "caller_name", "callee_name").select(F.col("caller_name").alias("label"), F.col("names").alias("dependencies"))
    hit = lists(calls, "callee_name", "caller_name").select(F.col("callee_name").alias("label"), F.col("names").alias("impact"))
    rows = nodes_.select("key", kind.alias("node_type"), X.after_last(F.col("key")).alias("label"))
    return rows.join(deps, "label", "left").join(hit, "label", "left").select("key", "node_type", "label", F.coalesce("dependencies", F.lit("")).alias("dependencies"), F.coalesce("impact", F.lit("")).alias("impact"))
