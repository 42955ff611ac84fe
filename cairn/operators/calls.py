"""Resolution of calls by their receivers, and the workflows of routes.

symbols: id, file_id, name, qualified_name, kind, start_offset, end_offset. components: component (its
symbol's id), file_id, name, qualified_name, kind, start_offset, end_offset. imports: file_id,
local_name, target_symbol, target_file. extends: child, parent (symbols). injections: ord, symbol_id,
parameter, type_name, target_name. calls: id, file_id, symbol_id (in which they stand), receiver, member.

A set of candidates travels as its smallest and greatest symbol: it is one symbol if they are equal,
and ambiguous if not, so no set is ever spelled out however many classes share a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.canonical import identity
from cairn.operators.ingest import enclosing
from cairn.operators.ranges import RANGE_ROWS, numbered
from cairn.sources.store import scratch, stored

# HTTP methods by the decorators that make a method a route; the longest path that is kept.
HTTP_METHODS = {"All": "ALL", "Delete": "DELETE", "Get": "GET", "Head": "HEAD", "Options": "OPTIONS", "Patch": "PATCH", "Post": "POST", "Put": "PUT"}
PATH_LIMIT = 512
#: Classes above a class that are climbed at most.
DEPTH = 8


def said(c: str | Column) -> Column:
    """The string, null if it is blank."""
    own = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(own) != "", own)


def spans(rows: DataFrame, keys: list[str], symbol: str = "symbol") -> DataFrame:
    """The smallest and greatest symbol of each key (low, high)."""
    return rows.groupBy(*keys).agg(F.min(symbol).alias("low"), F.max(symbol).alias("high"))


def homes(symbols: DataFrame, components: DataFrame) -> DataFrame:
    """symbol_id and its component: the symbol itself, or else the narrowest class around it in its file; symbols without one are left out."""
    ids = components.select(F.col("component").alias("id"))
    direct = symbols.join(ids, "id", "left_semi").select(F.col("id").alias("symbol_id"), F.col("id").alias("component"))
    rest = symbols.join(ids, "id", "left_anti").select(F.col("id").alias("symbol_id"), "file_id", "start_offset", "end_offset")
    classes = components.filter("kind = 'class'").select("component", "file_id", "start_offset", "end_offset")
    return direct.unionByName(enclosing(rest, classes, ["symbol_id"], "component"))


def members(symbols: DataFrame, components: DataFrame) -> DataFrame:
    """component, member, symbol: methods inside a component whose qualified name continues the component's. The prefixes of a qualified name are the join key."""
    parts = F.split("qualified_name", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    methods = symbols.filter("kind = 'method' and qualified_name like '%.%'").select(F.col("id").alias("symbol"), "file_id", F.col("name").alias("member"), F.col("start_offset").alias("a_"), F.col("end_offset").alias("b_"), F.explode(above).alias("qualified_name"))
    met = methods.join(components.select("component", "file_id", "qualified_name", "start_offset", "end_offset"), ["file_id", "qualified_name"])
    return met.filter("start_offset <= a_ and end_offset >= b_").select("component", "member", "symbol")


def lineage(extends: DataFrame, depth: int = DEPTH) -> DataFrame:
    """component, ancestor, level (1 for a parent): the classes above each class, up to depth, by the nearest way; a class that comes round again ends its way.

    A level is a join of the one before with the parents, written so that the next one starts from a table.
    """
    spark = extends.sparkSession
    root = scratch(spark, "lineage")
    parents = extends.select(F.col("child").alias("ancestor"), F.col("parent").alias("next")).dropna().distinct()
    level = parents.filter("ancestor <> next").select(F.col("ancestor").alias("component"), F.col("next").alias("ancestor"), F.array("ancestor", "next").alias("way"), F.lit(1).alias("level"))
    done = []
    for k in range(1, depth + 1):
        path = f"{root}/{k}"
        level.write.parquet(path)
        level = spark.read.parquet(path)
        if level.isEmpty():
            break
        done.append(path)
        further = level.join(parents, "ancestor").filter(~F.array_contains("way", F.col("next")))
        level = further.select("component", F.col("next").alias("ancestor"), F.concat("way", F.array("next")).alias("way"), F.lit(k + 1).alias("level"))
    every = spark.read.parquet(*done) if done else level
    return every.groupBy("component", "ancestor").agg(F.min("level").alias("level"))


def inherited(own: DataFrame, line: DataFrame) -> DataFrame:
    """own (component, member, low, high) with the members of the nearest class above that has them."""
    above = line.join(own.withColumnRenamed("component", "ancestor"), "ancestor").groupBy("component", "member", "level").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    every = own.withColumn("level", F.lit(0)).unionByName(above)
    return every.groupBy("component", "member").agg(F.min(F.struct("level", "low", "high")).alias("x")).select("component", "member", "x.low", "x.high")


def named(refs: DataFrame, components: DataFrame, imports: DataFrame, own: DataFrame) -> DataFrame:
    """id, low, high: the member of what a name stands for in a file.

    refs: id, file_id, name, member. Components that the file imports by that name come first (the first
    part of a dotted one), then those of the file, then any, by name or qualified name.
    """
    bound = imports.join(components.select(F.col("component").alias("target_symbol")), "target_symbol").select("file_id", "local_name", F.col("target_symbol").alias("component")).distinct()
    called = components.select("component", "file_id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"))
    first = refs.withColumn("local_name", F.substring_index("name", ".", 1)).join(bound, ["file_id", "local_name"], "left").drop("local_name")
    second = first.filter("component is null").drop("component").join(called, ["file_id", "name"], "left")
    near = first.filter("component is not null").unionByName(second.filter("component is not null")).join(own, ["component", "member"])
    anywhere = called.join(own, "component").groupBy("name", "member").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    far = second.filter("component is null").join(anywhere, ["name", "member"])
    return near.select("id", "low", "high").unionByName(far.select("id", "low", "high"))


def resolved_names(refs: DataFrame, components: DataFrame, imports: DataFrame) -> DataFrame:
    """refs (id, file_id, name, ...) with tier, status and target: the component that a name stands for in a file.

    Tier 0 is what the file imports by that name (the first part of a dotted one), 1 what is in the file, 2
    what is anywhere, by name or qualified name; the first tier that has any component counts. Each
    tier is one row a name, so a name that is everywhere costs one row for each reference.
    """
    bound = imports.join(components.select(F.col("component").alias("target_symbol")), "target_symbol")
    called = components.select("component", "file_id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"))
    ends = lambda rows, keys, symbol, k: spans(rows, keys, symbol).withColumnsRenamed({"low": f"low{k}_", "high": f"high{k}_"})
    out = refs.withColumn("local_name", F.substring_index("name", ".", 1))
    out = out.join(ends(bound, ["file_id", "local_name"], "target_symbol", 0), ["file_id", "local_name"], "left").drop("local_name")
    out = out.join(ends(called, ["file_id", "name"], "component", 1), ["file_id", "name"], "left").join(ends(called, ["name"], "component", 2), "name", "left")
    tier = F.when(F.col("low0_").isNotNull(), 0).when(F.col("low1_").isNotNull(), 1).when(F.col("low2_").isNotNull(), 2)
    low, high = (F.coalesce(*[F.col(f"{end}{k}_") for k in range(3)]) for end in ("low", "high"))
    out = out.withColumns({"tier": tier, "status": F.when(low == high, "resolved").when(low.isNotNull(), "ambiguous").otherwise("unresolved"), "target": F.when(low == high, low)})
    return out.drop(*[f"{end}{k}_" for end in ("low", "high") for k in range(3)])


def resolved_calls(calls: DataFrame, symbols: DataFrame, components: DataFrame, imports: DataFrame, extends: DataFrame, injections: DataFrame, climb: int = 0) -> DataFrame:
    """id, source (component), status (resolved, ambiguous, unresolved), target (symbol), target_component of each call.

    By receiver: this, the own component's members; this.x, those of what is injected as x; super, those
    of the parents; a name without dots, those of the components that it stands for, or what a
    namespace import of that name holds; none, an imported symbol or a function of the file. Other
    receivers resolve to nothing. With climb, a class also has the members of up to so many classes
    above it, of the nearest one that has them. A component's last injection of a parameter counts.
    """
    # each of these is read several times
    home = stored(homes(symbols, components), "homes")
    own = spans(members(symbols, components), ["component", "member"])
    own = stored(inherited(own, lineage(extends, climb)) if climb else own, "members")
    asked = stored(calls.select("id", "file_id", "symbol_id", said("receiver").alias("receiver"), said("member").alias("member")).join(home, "symbol_id", "left"), "asked")
    inside, receiver, usable = F.col("component").isNotNull(), F.col("receiver"), asked.filter("member is not null")
    this = usable.filter(inside & (receiver == "this")).select("id", "component", "member")
    parents = extends.join(components.select(F.col("component").alias("parent")), "parent").select(F.col("child").alias("component"), "parent").distinct()
    above = usable.filter(inside & (receiver == "super")).join(parents, "component").select("id", F.col("parent").alias("component"), "member")
    typed = injections.withColumns({"parameter": said("parameter"), "type_": F.coalesce(said("type_name"), said("target_name"))}).dropna(subset=["parameter", "type_"]).join(home, "symbol_id")
    given = typed.groupBy("component", "parameter").agg(F.max_by("type_", "ord").alias("name")).join(components.select("component", "file_id"), "component")
    by_field = usable.filter(inside & F.startswith(receiver, F.lit("this."))).select("id", "component", F.substr(receiver, F.lit(6)).alias("parameter"), "member").join(given, ["component", "parameter"]).select("id", "file_id", "name", "member")
    by_name = usable.filter(receiver.isNotNull() & ~F.contains(receiver, F.lit(".")) & ~(inside & receiver.isin("this", "super"))).select("id", "file_id", receiver.alias("name"), "member")
    found = stored(this.unionByName(above).join(own, ["component", "member"]).select("id", "low", "high").unionByName(named(by_field.unionByName(by_name), components, imports, own)), "found")
    names = spans(symbols, ["file_id", "name"], "id")
    spaces = imports.filter("target_file is not null").select("file_id", F.col("local_name").alias("name"), "target_file").distinct()
    spaced = by_name.join(found.select("id"), "id", "left_anti").join(spaces, ["file_id", "name"]).join(names.select(F.col("file_id").alias("target_file"), F.col("name").alias("member"), "low", "high"), ["target_file", "member"]).select("id", "low", "high")
    bare = usable.filter(receiver.isNull()).select("id", "file_id", "member")
    bound = spans(imports.join(symbols.select(F.col("id").alias("target_symbol")), "target_symbol"), ["file_id", "local_name"], "target_symbol").withColumnRenamed("local_name", "member")
    functions = spans(symbols.filter("kind = 'function'"), ["file_id", "name"], "id").withColumnRenamed("name", "member")
    free = bare.join(bound.unionByName(functions), ["file_id", "member"]).select("id", "low", "high")
    sets = found.unionByName(spaced).unionByName(free).groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # by the smallest candidate, as calls without a target would meet in one task
    sets = sets.join(home.select(F.col("symbol_id").alias("low"), F.col("component").alias("component_")), "low", "left")
    one = F.col("low") == F.col("high")
    out = asked.select("id", F.col("component").alias("source")).join(sets, "id", "left")
    return out.select("id", "source", F.when(one, "resolved").when(F.col("low").isNotNull(), "ambiguous").otherwise("unresolved").alias("status"), F.when(one, F.col("low")).alias("target"), F.when(one, F.col("component_")).alias("target_component"))


def call_outputs(resolved: DataFrame) -> DataFrame:
    """Outputs of resolved calls: a calls relationship from component to component where both are known, and a diagnostic for an ambiguous call."""
    linked = F.col("source").isNotNull() & F.col("target_component").isNotNull()
    kind = F.when(linked, "calls").when(F.col("status") == "ambiguous", "ambiguous_call_target")
    return resolved.select("id", F.when(linked, "relationship").otherwise("diagnostic").alias("output"), kind.alias("kind"), F.when(linked, F.col("target_component")).alias("target")).filter("kind is not null")


def routes(decorators: DataFrame, components: DataFrame) -> DataFrame:
    """The routes that lie in a controller: fact_id, symbol_id, component_key, http_method, route_path, handler, their range and workflow_key.

    decorators: fact_id, name, target_kind, target_name, path (the first argument, if it is a string),
    symbol_id, file_id, start_offset, end_offset. components also have type, path and identity_key.
    """
    last = F.regexp_extract("name", r"([^.]*)$", 1)
    methods = F.create_map(*[F.lit(x) for pair in HTTP_METHODS.items() for x in pair])
    own = decorators.filter((F.col("target_kind") == "method") & last.isin(*HTTP_METHODS) & F.col("symbol_id").isNotNull() & F.col("start_offset").isNotNull())
    controllers = components.filter("type = 'controller'").withColumns({"c_name": said("name"), "c_path": said("path")}).dropna(subset=["c_name", "c_path"]).select("identity_key", "file_id", "start_offset", "end_offset", "c_name", "c_path")
    around = enclosing(own.select("fact_id", "file_id", "start_offset", "end_offset"), controllers, ["fact_id"], "identity_key")
    own = own.join(around, "fact_id").join(controllers.select("identity_key", "c_name", "c_path"), "identity_key")
    handler = F.coalesce(said("target_name"), F.lit("<anonymous-route>"))
    path = F.when(F.length("path") <= PATH_LIMIT, F.col("path"))
    return own.select(
        "fact_id", "symbol_id", F.col("identity_key").alias("component_key"), methods[last].alias("http_method"), path.alias("route_path"), handler.alias("handler"), "file_id", "start_offset", "end_offset",
        identity("workflow", "c_path", "c_name", handler, methods[last], F.coalesce(path, F.lit(""))).alias("workflow_key"),
    )


def sites(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """The calls in methods of routes: no other can be a step, so no other need be resolved for workflows."""
    return calls.join(routes.select("symbol_id"), "symbol_id", "left_semi").select(*calls.columns)


def workflows(decorators: DataFrame, components: DataFrame, calls: DataFrame, resolved: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Facts of the workflows of routes among decorators (see routes), from what all calls resolve to."""
    return workflows_of(stored(routes(decorators, components), "routes"), components, calls, resolved, range_rows)


def workflows_of(routes: DataFrame, components: DataFrame, calls: DataFrame, resolved: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Facts of the workflows of routes, kind workflow or workflow_step.

    calls, those of routes at least, also have identity_key, callee and start_offset; resolved has a row
    for each. A route's workflow belongs to the narrowest controller around it; its steps are the entry,
    0, and its method's resolved calls in the order of their offsets (calls without one last). It tells
    how many calls are unresolved and ambiguous.
    """
    own = routes
    sited = calls.select("id", "symbol_id", F.col("identity_key").alias("call_key"), "callee", F.col("file_id").alias("c_file"), F.col("start_offset").alias("at"), F.col("end_offset").alias("until")).join(resolved.select("id", "status", "target", "target_component"), "id")
    met = stored(own.select("fact_id", "symbol_id", "workflow_key").join(sited, "symbol_id"), "sites")  # counted, numbered and summed up
    counts = met.groupBy("fact_id").agg(F.count_if(F.col("status") == "resolved").alias("resolved_"), F.count_if(F.col("status") == "unresolved").cast("long").alias("unresolved"), F.count_if(F.col("status") == "ambiguous").cast("long").alias("ambiguous"))
    fine = met.filter("status = 'resolved' and target is not null").withColumn("late_", F.col("at").isNull())
    steps = numbered(fine, "fact_id", ["late_", "at", "id"], "nth", fine.count(), range_rows)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    none = lambda kind: F.lit(None).cast(kind)
    heads = own.join(counts, "fact_id", "left").select(
        F.lit("workflow").alias("kind"), F.col("workflow_key").alias("identity_key"), F.concat("http_method", F.lit(" "), F.coalesce("route_path", F.lit("/")), F.lit(" → "), "handler").alias("name"), "workflow_key", none("int").alias("step"), none("string").alias("step_type"), "component_key",
        F.col("symbol_id").alias("target"), (zero(F.col("resolved_")) + 1).alias("steps"), zero(F.col("unresolved")).alias("unresolved"), zero(F.col("ambiguous")).alias("ambiguous"), "fact_id", "file_id", "start_offset", "end_offset", "handler",
    )
    entry = heads.withColumns({"name": F.col("handler"), "kind": F.lit("workflow_step"), "identity_key": identity("workflow_step", "workflow_key", F.lit("entry")), "step": F.lit(0), "step_type": F.lit("entrypoint"), "steps": none("long"), "unresolved": none("long"), "ambiguous": none("long")})
    heads, entry = heads.drop("handler"), entry.drop("handler")
    keys = components.select(F.col("component").alias("target_component"), F.col("identity_key").alias("component_key"))
    rest = steps.join(keys, "target_component", "left").select(
        F.lit("workflow_step").alias("kind"), identity("workflow_step", "workflow_key", "call_key").alias("identity_key"), F.coalesce(said("callee"), F.concat(F.lit("symbol:"), F.col("target").cast("string"))).alias("name"), "workflow_key", (F.col("nth") + 1).cast("int").alias("step"), F.lit("resolved_call").alias("step_type"), "component_key",
        "target", none("long").alias("steps"), none("long").alias("unresolved"), none("long").alias("ambiguous"), "fact_id", F.col("c_file").alias("file_id"), F.col("at").alias("start_offset"), F.col("until").alias("end_offset"),
    )
    return heads.unionByName(entry).unionByName(rest)


def beyond_limits(facts: DataFrame, most_workflows: int, most_steps: int, most_each: int) -> DataFrame:
    """rule and workflow_key (null for the whole) of what exceeds the limits of a snapshot: its workflows, its steps, the steps of one workflow."""
    heads = facts.filter("kind = 'workflow'")
    whole = heads.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"))
    none = F.lit(None).cast("string").alias("workflow_key")
    return (
        whole.filter(F.col("n") > most_workflows).select(F.lit("too_many_workflows").alias("rule"), none)
        .unionByName(whole.filter(F.col("steps") > most_steps).select(F.lit("too_many_steps").alias("rule"), none))
        .unionByName(heads.filter(F.col("steps") > most_each).select(F.lit("too_many_steps_of_one").alias("rule"), "workflow_key"))
    )
