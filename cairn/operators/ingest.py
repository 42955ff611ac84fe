"""Discovery, hashing, and resolution of modules and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.enums import IGNORED_DIRECTORIES, REGULAR_MODES, SOURCE_LANGUAGES
from cairn.functions.text import extension

# Limits of a tree's paths and files.
MAX_FILE_BYTES, MAX_PATH, MAX_DEPTH = 2 * 1024 * 1024, 1024, 64
#: Extensions of sources, in the order in which a bare module name tries them.
SOURCE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".json")


def path_violations(tree: DataFrame, max_path: int = MAX_PATH, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Entries whose path is unsafe: the caller decides whether a job fails on them."""
    p = F.col("path")
    segments = F.split(p, "/")
    bad = (F.length(p) == 0) | (F.length(p) > max_path) | F.startswith(p, F.lit("/")) | F.contains(p, F.lit("\\")) | p.rlike(r"[\x00-\x1f\x7f\x{fffd}]") | (F.size(segments) > max_depth)
    return tree.filter(bad | F.exists(segments, lambda s: s.isin("", ".", "..")))


def outcome(max_bytes: int = MAX_FILE_BYTES) -> Column:
    """What discovery does with an entry; the order of the tests matters."""
    directories = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    ignored = F.exists(directories, lambda d: F.lower(d).isin(*IGNORED_DIRECTORIES))
    own = extension(F.col("path"))
    return F.when(~F.col("mode").isin(*REGULAR_MODES), "special").when(ignored, "ignored").when(own.isNull() | ~own.isin(*SOURCE_LANGUAGES), "unsupported").when(F.col("size_bytes") > max_bytes, "oversized").otherwise("selected")


def discovery_statistics(tree: DataFrame) -> DataFrame:
    own = tree.withColumn("outcome", outcome())
    return own.agg(
        F.count(F.lit(1)).alias("observed"),
        *[F.count_if(F.col("outcome") == x).alias(x) for x in ("selected", "ignored", "unsupported", "oversized", "special")],
        F.coalesce(F.sum(F.when(F.col("outcome") == "selected", F.col("size_bytes"))), F.lit(0)).alias("selected_bytes"),
    )


def with_language(tree: DataFrame) -> DataFrame:
    """language and capability by extension, from a map of eight entries inside the plan."""
    names = F.create_map(*[F.lit(x) for k, v in SOURCE_LANGUAGES.items() for x in (k, v[0])])
    able = F.create_map(*[F.lit(x) for k, v in SOURCE_LANGUAGES.items() for x in (k, v[1])])
    own = extension(F.col("path"))
    return tree.withColumns({"extension": own, "language": F.try_element_at(names, own), "capability": F.try_element_at(able, own)})


def unchanged(tree: DataFrame, known: DataFrame) -> DataFrame:
    """tree with whether a blob may be skipped: same object and size as the current hash of its path."""
    old = known.select("path", F.col("object_id").alias("old_object"), F.col("size_bytes").alias("old_size"))
    return tree.join(old, "path", "left").withColumn("skip", F.coalesce((F.col("object_id") == F.col("old_object")) & (F.col("size_bytes") == F.col("old_size")), F.lit(False))).drop("old_object", "old_size")


def module_candidates(source: Column, specifier: Column) -> Column:
    """Paths that a relative module name may mean, in order; empty for others and for those that leave the tree."""
    relative = F.startswith(specifier, F.lit("./")) | F.startswith(specifier, F.lit("../"))
    directory = F.when(F.contains(source, F.lit("/")), F.regexp_replace(source, r"/[^/]*$", "")).otherwise(F.lit(""))
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(directory, F.lit("")), specifier), "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    base = F.array_join(up, "/")
    ext = F.lower(F.regexp_extract(base, r"[^/](\.[^./]*)$", 1))
    stem = F.left(base, F.length(base) - F.length(ext))
    direct = F.when(ext == ".js", F.array(F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")), base)).when(ext == ".jsx", F.array(F.concat(stem, F.lit(".tsx")), base)).otherwise(F.array(base))
    spread = F.array(*[F.concat(base, F.lit(e)) for e in SOURCE_EXTENSIONS], *[F.concat(base, F.lit("/index" + e)) for e in SOURCE_EXTENSIONS])
    inside = relative & (F.size(up) > 0) & ~F.startswith(base, F.lit(".."))
    return F.when(inside, F.when(ext.isin(*SOURCE_EXTENSIONS), direct).otherwise(spread)).otherwise(F.array().cast("array<string>"))


def resolved_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (id, source_path, specifier) with target_file: the first candidate that exists."""
    tried = imports.select("id", F.posexplode(module_candidates(F.col("source_path"), F.col("specifier"))).alias("nth", "path"))
    first = tried.join(files.select("path", F.col("id").alias("file")), "path").groupBy("id").agg(F.min_by("file", "nth").alias("target_file"))
    return imports.join(first, "id", "left")


def resolved_symbols(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """references (id, file_id, target_name) with target_symbol_id.

    Nothing for * or no name; for default the only default export; else the only symbol with that
    qualified name, else the only exported one with the last part as name, else the only one. What is
    ambiguous stays null. Names of a file are resolved once, by one row of counts for each name and
    qualified name, so symbols that share a name cost no row for each reference.
    """
    last = F.regexp_extract(F.col("target_name"), r"([^.]*)$", 1)
    asked = references.select("file_id", "target_name").filter(F.col("target_name").isNotNull() & ~F.col("target_name").isin("*", "")).distinct().withColumn("simple_", F.when(F.col("target_name") != "default", last))
    own = symbols.select(F.col("indexed_file_id").alias("file_id"), F.col("name").alias("simple_"), F.col("qualified_name").alias("target_name"), F.col("id").alias("symbol_"), "exported")
    n, out = F.count(F.lit(1)), F.col("exported")
    exact = own.groupBy("file_id", "simple_", "target_name").agg(n.alias("n1"), F.max("symbol_").alias("s1"))
    named = own.groupBy("file_id", "simple_").agg(F.count_if(out).alias("n2"), F.max(F.when(out, F.col("symbol_"))).alias("s2"), n.alias("n3"), F.max("symbol_").alias("s3"))
    defaults = symbols.filter("default_export").groupBy(F.col("indexed_file_id").alias("file_id")).agg(n.alias("n"), F.max("id").alias("only")).filter("n = 1").select("file_id", "only")
    met = asked.join(named, ["file_id", "simple_"], "left").join(exact, ["file_id", "simple_", "target_name"], "left").join(defaults, "file_id", "left")
    by_name = F.when(F.col("n1") == 1, F.col("s1")).when(F.col("n2") == 1, F.col("s2")).when(F.col("n3") == 1, F.col("s3"))
    chosen = met.select("file_id", "target_name", F.when(F.col("target_name") == "default", F.col("only")).otherwise(by_name).alias("target_symbol_id"))
    return references.join(chosen, ["file_id", "target_name"], "left")


#: Width of the offset buckets by which ranges and what lies inside them meet.
BUCKET = 4096


def enclosing(items: DataFrame, ranges: DataFrame, keys: list[str], range_id: str) -> DataFrame:
    """The narrowest range around each item that has one: keys of the item and range_id; of equal widths the smallest range_id.

    Both have file_id, start_offset and end_offset. File and offset bucket are the equi key, a range
    being in each bucket that it touches, so a file of many ranges is many keys; the range test is a
    residual predicate, and a map-side minimum picks the narrowest.
    """
    bucket = F.floor(F.col("start_offset") / BUCKET)
    of = ranges.select("file_id", range_id, F.col("start_offset").alias("from_"), F.col("end_offset").alias("to_"), F.explode(F.sequence(bucket, F.greatest(bucket, F.floor(F.col("end_offset") / BUCKET)))).alias("bucket_"))
    met = items.select(*keys, "file_id", "start_offset", "end_offset", bucket.alias("bucket_")).join(of, ["file_id", "bucket_"]).filter((F.col("from_") <= F.col("start_offset")) & (F.col("end_offset") <= F.col("to_")))
    return met.groupBy(*keys).agg(F.min_by(range_id, F.struct(F.col("to_") - F.col("from_"), F.col(range_id))).alias(range_id))


def _cover(low: str, high: str) -> Column:
    """The aligned blocks of 2 ** level offsets that together are low to high, as structs of level and block: two of each level at most, none if high is less than low."""
    levels = f"sequence(0, CAST(log2(greatest({high} - {low} + 1, 1)) AS INT) + 1)"
    # of each level the first block when its number is odd, and the last when it is even; the others lie in larger blocks
    first, end = f"shiftright({low} + shiftleft(1L, k) - 1, k)", f"shiftright({high} + 1, k)"
    block = lambda at, odd: f"IF({first} < {end} AND ({odd}) & 1 = 1, array(named_struct('level_', k, 'block_', {at})), array())"
    return F.expr(f"flatten(transform({levels}, k -> concat({block(first, first)}, {block(end + ' - 1', end)})))")


def _blocks(at: str, deepest: int) -> Column:
    """The block of each level that holds an offset."""
    return F.expr(f"transform(sequence(0, {deepest}), k -> named_struct('level_', k, 'block_', shiftright({at}, k)))")


def _deepest(ranges: DataFrame, low: str, high: str) -> int:
    """The level of the largest blocks that ranges are made of."""
    return max(1, ranges.agg(F.max(F.col(high) - F.col(low) + 1).cast("long").alias("n")).first()["n"] or 1).bit_length()


def smallest_enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (id, file_id, at_offset) with the narrowest range (range_id) of the same file around them.

    A range is the few blocks of its cover, and of each block's ranges only the narrowest is kept; a place
    asks the block of each level that holds it. So rows grow with the logarithm of a range's length, however many ranges
    lie around a place, and places that repeat ask once.
    """
    own = ranges.select(F.col("indexed_file_id").alias("file_id"), F.col("id").alias("range_id"), F.col("start_offset").cast("long").alias("from_"), F.col("end_offset").cast("long").alias("to_"))
    own = own.groupBy("file_id", "from_", "to_").agg(F.min("range_id").alias("range_id"))
    narrowest = own.select("file_id", F.struct(F.col("to_") - F.col("from_"), F.col("range_id").alias("range_id")).alias("best_"), F.explode(_cover("from_", "to_")).alias("x")).groupBy("file_id", "x.level_", "x.block_").agg(F.min("best_").alias("best_"))
    places = points.select("file_id", "at_offset").distinct()
    asked = places.select("file_id", "at_offset", F.explode(_blocks("CAST(at_offset AS BIGINT)", _deepest(own, "from_", "to_"))).alias("x")).select("file_id", "at_offset", "x.*")
    found = asked.join(narrowest, ["file_id", "level_", "block_"]).groupBy("file_id", "at_offset").agg(F.min("best_").getField("range_id").alias("range_id"))
    return points.join(found, ["file_id", "at_offset"], "left")


def members(symbols: DataFrame, prefix: int) -> DataFrame:
    """component and method: pairs of different symbols (id, indexed_file_id, qualified_name, start_offset, end_offset) of a file, the method within the component's range, its qualified name beginning with the first characters (prefix of them) of the component's.

    Pairs are found among ranges that differ, by the block of the component's cover that holds where the method
    begins: a range meets only those that cover its beginning. Then both sides take the symbols of their range.
    """
    own = symbols.select("indexed_file_id", "id", F.col("start_offset").cast("long").alias("from_"), F.col("end_offset").cast("long").alias("to_"), F.substring("qualified_name", 1, prefix).alias("head_"))
    keys = ["indexed_file_id", "from_", "to_", "head_"]
    spans = own.select(*keys).distinct()
    side = lambda p, rows: rows.select("indexed_file_id", *[F.col(c).alias(p + c) for c in keys[1:]], *[c for c in rows.columns if c not in keys])
    outer = side("c_", spans.select(*keys, F.explode(_cover("from_", "to_")).alias("x")).select(*keys, "x.*"))
    inner = side("m_", spans.filter("to_ >= from_").select(*keys, F.explode(_blocks("from_", _deepest(spans, "from_", "to_"))).alias("x")).select(*keys, "x.*"))
    # a range that ends before it begins may lie in ranges that don't cover its beginning
    odd = side("m_", spans.filter("to_ < from_"))
    met = outer.join(inner, ["indexed_file_id", "level_", "block_"]).drop("level_", "block_").unionByName(side("c_", spans).join(odd, "indexed_file_id").filter("m_from_ >= c_from_"))
    pairs = met.filter("m_to_ <= c_to_ AND startswith(m_head_, c_head_)")
    held = lambda p, name: side(p, own.withColumnRenamed("id", name))
    both = pairs.join(held("c_", "component"), ["indexed_file_id", "c_from_", "c_to_", "c_head_"]).join(held("m_", "method"), ["indexed_file_id", "m_from_", "m_to_", "m_head_"])
    return both.filter("method <> component").select("component", "method")


def normalized_imports(imports: DataFrame) -> DataFrame:
    """Dependency rows of imports (id, module, default_import, namespace_import, named: array of (imported, local)): a row for each binding, or a bare one."""
    row = lambda target, local: F.struct(target.alias("target_name"), local.alias("local_name"))
    none = F.lit(None).cast("string")
    every = F.concat(
        F.when(F.col("default_import").isNotNull(), F.array(row(F.lit("default"), F.col("default_import")))).otherwise(F.array().cast("array<struct<target_name:string,local_name:string>>")),
        F.when(F.col("namespace_import").isNotNull(), F.array(row(F.lit("*"), F.col("namespace_import")))).otherwise(F.array().cast("array<struct<target_name:string,local_name:string>>")),
        F.coalesce(F.transform("named", lambda n: row(n["imported"], n["local"])), F.array().cast("array<struct<target_name:string,local_name:string>>")),
    )
    return imports.select("id", "module", F.explode(F.when(F.size(every) > 0, every).otherwise(F.array(row(none, none)))).alias("d")).select("id", "module", "d.*")


def export_target(kind: Column, local: Column, exported: Column) -> Column:
    """Target name of an export's dependency: * for all and namespace exports, else the local name, else the exported one."""
    return F.when(kind.isin("all", "namespace"), "*").otherwise(F.coalesce(local, exported))


def snapshots(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """jobs (id, scope, status, total_files) with state: ready, stale or unfinished.

    A finished job's snapshot is ready when both the active files of its scope and those of them that
    the job saw last, with a hash, are as many as it counted. files: scope, status, last_job_id, hash_id.
    """
    active = files.filter("status = 'active'")
    every = active.groupBy("scope").agg(F.count(F.lit(1)).alias("active_"))
    seen = active.filter("hash_id is not null").groupBy("scope", F.col("last_job_id").alias("id")).agg(F.count(F.lit(1)).alias("seen_"))
    met = jobs.join(every, "scope", "left").join(seen, ["scope", "id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = (zero("active_") == F.col("total_files")) & (zero("seen_") == F.col("total_files"))
    return met.withColumn("state", F.when(F.col("status") != "succeeded", "unfinished").when(whole, "ready").otherwise("stale")).drop("active_", "seen_")


def code_files(files: DataFrame, symbols: DataFrame, dependencies: DataFrame) -> DataFrame:
    """files (id, hash_id) with their symbols and dependencies (each with hash_id, start_offset, id) as arrays of structs in reading order; empty without any."""
    out = files
    for name, rows in (("symbols", symbols), ("dependencies", dependencies)):
        rest = [c for c in rows.columns if c not in ("hash_id", "start_offset", "id")]
        nested = rows.groupBy("hash_id").agg(F.array_sort(F.collect_list(F.struct("start_offset", "id", *rest))).alias(name))
        none = F.array().cast(nested.schema[name].dataType)
        out = out.join(nested, "hash_id", "left").withColumn(name, F.coalesce(name, none))
    return out


def after(files: DataFrame, last_id: int, limit: int = 250) -> DataFrame:
    """The next page of a keyset scan: the filter reaches the scan, and the page is a top-k."""
    return files.filter(F.col("id") > last_id).orderBy("id").limit(limit)


def heritage_targets(heritage: DataFrame, bindings: DataFrame) -> DataFrame:
    """heritage (id, file_id, target) resolved through the file's import bindings (file_id, local_name, module, imported, ord); the last binding of a name wins."""
    last = bindings.groupBy("file_id", "local_name").agg(F.max_by(F.struct("module", "imported"), "ord").alias("b"))
    root, rest = F.substring_index("target", ".", 1), F.expr("substr(target, length(substring_index(target, '.', 1)) + 2)")
    met = heritage.withColumn("local_name", root).join(last, ["file_id", "local_name"], "left")
    target = F.when(F.col("b").isNull(), F.col("target")).when((F.col("b.imported") == "*") & (rest != ""), rest).otherwise(F.col("b.imported"))
    return met.select("id", F.col("b.module").alias("module"), target.alias("target_name"), F.col("target").alias("local"))


#: Spans of keys whose totals one task sums up.
SPANS = 1_000_000


def first_offender(df: DataFrame, amount: str, key: str, limit: int, spans: int = SPANS) -> DataFrame:
    """The row (with running) at which the total in the order of an integer key first passes limit; empty if it never does.

    Rows of one key count together, those without a key last; amounts may be negative or null. Spans of keys are summed
    first, as many as spans at most, so the ordered window over all sees a row per span. Looked at row by row are the
    first span that ends above the limit, and those before it whose positive amounts alone would pass it.
    """
    ends = df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    span = 1 if ends["low"] is None else max(4096, -(-(ends["high"] - ends["low"] + 1) // spans))
    bucket = F.floor(F.col(key) / span)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = df.groupBy(bucket.alias("span_")).agg(zero(F.sum(amount)).alias("sum_"), zero(F.sum(F.greatest(F.col(amount), F.lit(0)))).alias("gain_"))
    order = Window.orderBy(F.asc_nulls_last("span_")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("before_", zero(F.sum("sum_").over(order)))
    passed = ahead.withColumn("passed_", zero(F.sum((F.col("before_") + F.col("sum_") > limit).cast("int")).over(order)))
    near = passed.filter((F.col("passed_") == 0) & (F.col("before_") + F.col("gain_") > limit)).select(F.col("span_").alias("near_"), "before_")
    rows = df.withColumn("span_", bucket)
    inside = rows.join(F.broadcast(near), rows["span_"].eqNullSafe(F.col("near_")))
    running = F.col("before_") + F.sum(amount).over(Window.partitionBy("span_").orderBy(key).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return inside.withColumn("running", running).filter(F.col("running") > limit).orderBy(F.asc_nulls_last(key)).limit(1).drop("span_", "near_", "before_")
