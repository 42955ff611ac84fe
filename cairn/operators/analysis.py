"""Classification and name resolution of analysed code, and merging of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes in the order they are tried, generic names, and keyword patterns of rule types.
SUFFIXES = ("Configuration", "Controller", "Repository", "Service", "Provider", "Response", "Request", "Entity", "Module", "Config", "Model", "Input", "Output", "DTO", "Dto")
GENERIC = ("app", "application", "base", "common", "config", "configuration", "core", "default", "helper", "shared", "utility", "utils")
PERMISSION = "permission|authori[sz]|forbidden|role|access|ability|owner"
STATE = "status|state|transition|cancelled|canceled|pending|active|inactive"
ELIGIBILITY = "eligible|eligibility|qualif|entitled"
SCHEDULING = "schedule|appointment|booking|calendar|availability|available|slot"
COMPONENT_SUFFIXES = ("Controller", "Service", "Repository", "Module", "Entity", "Provider")


def concept_name(name: Column) -> Column:
    """Without its first matching technical suffix, camel case parted; null when nothing is left."""
    base = F.regexp_replace(name, f"^(.+?)({'|'.join(SUFFIXES)})$", "$1")
    parted = F.regexp_replace(F.regexp_replace(base, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.nullif(F.trim(F.regexp_replace(parted, "[^A-Za-z0-9]+", " ")), F.lit(""))


def is_generic(name: Column) -> Column:
    return F.lower(name).isin(*GENERIC)


# What makes a declaration a concept, with its confidence, in the order in which it is asked.
BOUNDARY, SERVICE = "(DTO|Dto|Entity|Model|Request|Response|Input|Output)$", "(Controller|Repository|Service)$"


def concept_source(kind: Column, name: Column, exported: Column, entity: Column) -> Column:
    """source, confidence_pct and deterministic of the concept that a declaration stands for; null for none.

    An entity by its decorator, a type that is no class, a class at a boundary or a service by its name,
    or any other exported class.
    """
    said = lambda source, sure: F.struct(F.lit(source).alias("source"), F.lit(sure).cast("long").alias("confidence_pct"), F.lit(sure == 100).alias("deterministic"))
    own = kind == "class"
    return F.when(own & entity, said("entity_decorator", 100)).when(kind.isin("interface", "enum", "type_alias"), said("domain_type", 80)).when(own & name.rlike(BOUNDARY), said("boundary_type", 85)).when(own & name.rlike(SERVICE), said("service_boundary", 70)).when(own & exported, said("domain_type", 65))


def concepts(declarations: DataFrame) -> DataFrame:
    """Concepts of declarations (file_id, ord, kind, name, exported, entity): of those with one name in a file the first counts, and generic names are none."""
    from cairn.functions.canonical import identity

    own = declarations.withColumns({"x": concept_source(F.col("kind"), F.col("name"), F.col("exported"), F.col("entity")), "concept": concept_name(F.col("name"))})
    own = own.filter(F.col("x").isNotNull() & F.col("concept").isNotNull() & ~is_generic(F.col("concept"))).withColumn("identity_key", identity("domain_concept", F.lower("concept")))
    return own.groupBy("file_id", "identity_key").agg(F.min(F.struct("ord", "concept", F.col("kind").alias("declaration_kind"), "x")).alias("f")).select("file_id", "identity_key", "f.ord", "f.concept", "f.declaration_kind", "f.x.*")


def concept_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(concept_name(name), name)), r"\s+"), lambda x: x != "")


def tokens_within(tokens: Column, signals: Column) -> Column:
    """Whether all tokens are among the signals."""
    return F.size(F.array_except(tokens, signals)) == 0


def rule_type(condition: Column, every: Column, outcome: Column) -> Column:
    """Type of a guarded rule: by its condition first, then by all signals, in another order; else validation where it throws or returns."""
    c, s = F.lower(condition), F.lower(every)
    return (
        F.when(c.rlike(PERMISSION), "permission").when(c.rlike(STATE), "state_constraint").when(c.rlike(ELIGIBILITY), "eligibility").when(c.rlike(SCHEDULING), "scheduling")
        .when(s.rlike(PERMISSION), "permission").when(s.rlike(ELIGIBILITY), "eligibility").when(s.rlike(STATE), "state_constraint").when(s.rlike(SCHEDULING), "scheduling")
        .when(outcome.isin("throw", "return"), "validation")
    )


def component_type(symbols: DataFrame, decorators: DataFrame) -> DataFrame:
    """symbols (id, name, path) with type, confidence and conflict, by decorators (symbol_id, name), then by name, then by path."""
    last = F.regexp_extract("name", r"([^.]*)$", 1)
    direct = F.when(last == "Module", "module").when(last == "Controller", "controller").when(last.isin("Entity", "ChildEntity"), "entity")
    own = decorators.groupBy("symbol_id").agg(F.array_sort(F.collect_set(direct)).alias("direct"), F.bool_or(last == "Injectable").alias("injectable"))
    found = F.lower(F.regexp_extract("name", f"({'|'.join(COMPONENT_SUFFIXES)})$", 1))
    suffix = F.coalesce(F.nullif(found, F.lit("")), F.when(F.col("name").rlike("(Config|Configuration)$"), "configuration"))
    joined = symbols.join(own, symbols["id"] == own["symbol_id"], "left").withColumns({"direct": F.coalesce("direct", F.array().cast("array<string>")), "injectable": F.coalesce("injectable", F.lit(False)), "suffix": suffix})
    conflict = F.size("direct") > 1
    config = F.lower("path").rlike(r"(^|/)config/|\.config\.[jt]s$")
    kind = F.when(conflict, None).when(F.size("direct") == 1, F.try_element_at("direct", F.lit(1))).when(F.col("suffix").isNotNull(), F.col("suffix")).when(F.col("injectable"), "provider").when(config, "configuration")
    sure = F.when(conflict, None).when(F.size("direct") == 1, 100).when(F.col("injectable") & F.col("suffix").isNotNull(), 95).when(F.col("injectable"), 100).when(F.col("suffix").isNotNull(), 80).when(config, 85)
    return joined.select("id", kind.alias("type"), (sure / 100).alias("confidence"), conflict.alias("conflict"))


# Confidence of a relation by whether its target is named by an import or in the same file; relations of a module's fields.
NAMED, ANYWHERE = 100, 75
MODULE_RELATIONS = {"controllers": "contains", "providers": "contains", "imports": "depends_on"}
ROUTES = ("All", "Delete", "Get", "Head", "Options", "Patch", "Post", "Put")
ANALYSED = ("domain_concept", "business_rule", "state", "state_transition", "domain_event", "event_handler")


def _outputs(references: DataFrame, relation: Column, diagnostic: Column) -> DataFrame:
    """references with output (relationship or diagnostic), kind and confidence_pct; those with neither are left out."""
    fine = F.col("status") == "resolved"
    kind = F.when(fine, relation).otherwise(diagnostic)
    out = references.withColumns({"output": F.when(fine, "relationship").otherwise("diagnostic"), "kind": kind})
    return out.withColumn("confidence_pct", F.when(fine, F.when(F.col("tier") < 2, NAMED).otherwise(ANYWHERE)).cast("long")).filter("kind is not null")


def injection_outputs(references: DataFrame) -> DataFrame:
    """Outputs of injected parameters that are resolved (tier, status): depends_on, or a diagnostic where several components have the name; none at all is silent."""
    return _outputs(references, F.lit("depends_on"), F.when(F.col("status") == "ambiguous", "ambiguous_injection_target"))


def module_outputs(references: DataFrame) -> DataFrame:
    """Outputs of a module's references (field, tier, status): contains or depends_on by the field, or a diagnostic where no or several components have the name; other fields are ignored."""
    relation = F.create_map(*[F.lit(x) for pair in MODULE_RELATIONS.items() for x in pair])
    return _outputs(references.filter(F.col("field").isin(*MODULE_RELATIONS)), relation[F.col("field")], F.concat("status", F.lit("_module_reference")))


def emitted(facts: DataFrame, components: DataFrame, outputs: list[DataFrame]) -> DataFrame:
    """fact_id and kind of what an analysis yields: analysed facts, route decorators of methods, components, and outputs; raw calls, injections and other decorators stay inside."""
    route = (F.col("kind") == "decorator") & (F.col("target_kind") == "method") & F.regexp_extract("name", r"([^.]*)$", 1).isin(*ROUTES)
    out = facts.filter(F.col("kind").isin(*ANALYSED) | route).select("fact_id", "kind").unionByName(components.select("fact_id", "kind"))
    for part in outputs:
        out = out.unionByName(part.select("fact_id", "kind"))
    return out


def contract_violations(facts: DataFrame, evidence: DataFrame, files: DataFrame, analyzers: DataFrame, most: int) -> DataFrame:
    """rule, file_id and identity_key of what breaks the contract of analysers, with any of which an analysis fails.

    facts: fact_id, file_id (the file under analysis), identity_key, analyzer, version; evidence: fact_id,
    file_id, hash_id, end_offset; files: file_id, hash_id, length; analyzers: analyzer, version. Analysers
    must be registered as they name themselves, evidence must lie in the file under analysis and inside
    it, an identity stands once in a file, and a file has `most` facts at most.
    """
    said = lambda rule, rows: rows.select(F.lit(rule).alias("rule"), "file_id", "identity_key")
    unknown = facts.join(analyzers, ["analyzer", "version"], "left_anti")
    met = evidence.select("fact_id", F.col("file_id").alias("e_file"), F.col("hash_id").alias("e_hash"), "end_offset").join(facts, "fact_id").join(files, "file_id", "left")
    inside = (F.col("e_file") == F.col("file_id")) & (F.col("e_hash") == F.col("hash_id")) & (F.col("end_offset").isNull() | (F.col("end_offset") <= F.col("length")))
    outside = met.filter(~F.coalesce(inside, F.lit(False))).select("file_id", "identity_key").distinct()
    repeated = facts.groupBy("file_id", "identity_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = facts.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).withColumn("identity_key", F.lit(None).cast("string"))
    return said("unknown_analyzer", unknown).unionByName(said("evidence_outside", outside)).unionByName(said("repeated_identity", repeated)).unionByName(said("too_many_facts", many))


def merged_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per identity: greatest confidence, deterministic if any is, sorted distinct aliases, distinct evidence, and whether fingerprints conflict."""
    return facts.groupBy(*keys).agg(
        F.max("confidence_pct").alias("confidence_pct"), F.bool_or("deterministic").alias("deterministic"), F.array_sort(F.collect_set("alias")).alias("aliases"), F.count_distinct("evidence_file").alias("evidence"), (F.min("fingerprint") != F.max("fingerprint")).alias("conflict")
    )


def first_wins(facts: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Greatest confidence, and of all rows the first one's value."""
    return facts.groupBy(*keys).agg(F.max("confidence_pct").alias("confidence_pct"), F.min_by(value, order).alias(value))


def last_wins(facts: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("r")).select(*keys, "r.*")


def most_confident(facts: DataFrame, keys: list[str], values: list[str], order: str) -> DataFrame:
    """The row of greatest confidence; the first of equal ones."""
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(F.col("confidence_pct"), -F.col(order))).alias("r")).select(*keys, "r.*")


def merged_events(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct operations and the number of distinct identities of each key."""
    return facts.groupBy(*keys).agg(F.array_sort(F.collect_set("alias")).alias("operations"), F.count_distinct("identity_key").alias("occurrences"))


def complete_steps(steps: DataFrame, workflow: str, order: str) -> DataFrame:
    """Workflows and whether their steps are numbered 0, 1, 2, ... without a gap or a repeat; counted, not collected."""
    n = F.count(F.lit(1))
    whole = (F.min(order) == 0) & (F.max(order) == n - 1) & (F.count_distinct(order) == n)
    return steps.groupBy(workflow).agg(F.coalesce(whole, F.lit(False)).alias("complete"))


def humanized(c: Column, none: str = "Business rule") -> Column:
    """Camel, snake or kebab case to words, the first letter upper; `none` for nothing."""
    words = F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-]+", " ")))
    return F.when(words == "", none).otherwise(F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2))))


# The longest name and summary of a rule.
NAME_LIMIT, SUMMARY_LIMIT = 512, 4_000


def limited(c: Column, most: int) -> Column:
    return F.left(F.trim(F.regexp_replace(c, r"[\r\n]+", " ")), F.lit(most))


def rule_text(rules: DataFrame) -> DataFrame:
    """rules with name and summary.

    rules: rule_type, condition (null, or a struct of kind, operation, target and identifiers), outcome (the
    same), container (null outside of a declaration). A condition is called by its target or its first
    three identifiers, an outcome by what it does.
    """
    when, then = F.col("condition"), F.col("outcome")
    aim = F.coalesce(when["target"], F.nullif(F.array_join(F.slice(when["identifiers"], 1, 3), " and "), F.lit("")))
    asked = F.when(when.isNotNull(), F.when(aim.isNull(), humanized(when["kind"])).when(when["operation"] == "!", F.concat(F.lit("not "), aim)).otherwise(aim))
    first, kind, fallback = F.try_element_at(then["identifiers"], F.lit(1)), then["kind"], F.concat(humanized(F.col("rule_type")), F.lit(" rule"))
    said = lambda title, summary: F.struct(title.alias("title"), summary.alias("summary"))
    with_ = F.coalesce(F.concat(F.lit(" with "), first), F.lit(""))
    set_, called, rounded = F.coalesce(then["target"], first, F.lit("state")), F.coalesce(then["operation"], first, F.lit("operation")), F.coalesce(then["target"], first, F.lit("calculated value"))
    result = F.coalesce(then["target"], first)
    after = lambda word, x: F.concat(F.lit(word + " "), x)
    done = (
        F.when(then.isNull(), said(fallback, after("enforces a", fallback)))
        .when(kind == "assignment", said(after("Set", set_), after("sets", set_)))
        .when(kind == "throw", said(F.concat(F.lit("Reject"), with_), F.concat(F.lit("rejects execution"), with_)))
        .when(kind == "return", said(F.coalesce(after("Return", result), F.lit("Return early")), F.coalesce(after("returns", result), F.lit("returns early"))))
        .when(kind == "call", said(after("Call", called), after("calls", called)))
        .when(kind == "rounding_call", said(after("Round", rounded), after("rounds", rounded)))
        .otherwise(said(humanized(kind), after("performs", humanized(kind))))
    )
    where = F.coalesce(F.concat(F.lit(" in "), F.col("container")), F.lit(""))
    own = rules.withColumns({"asked_": asked, "done_": done, "where_": where})
    some = F.col("asked_").isNotNull()
    name = F.concat(F.col("done_.title"), F.when(some, F.concat(F.lit(" when "), F.col("asked_"))).otherwise(""), F.col("where_"))
    summary = F.concat(F.when(some, F.concat(F.lit("When "), F.col("asked_"), F.lit(", the code "))).otherwise("The code "), F.col("done_.summary"), F.col("where_"), F.lit("."))
    return own.withColumns({"name": limited(name, NAME_LIMIT), "summary": limited(summary, SUMMARY_LIMIT)}).drop("asked_", "done_", "where_")


# The longest identity and analyser name of a fact, in UTF-16 units.
IDENTITY_LIMIT, ANALYZER_LIMIT = 512, 100


def bounded(c: Column, most: int) -> Column:
    """Whether a text isn't blank, not longer than `most` UTF-16 units, and of one line without NUL."""
    units = F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.coalesce(c.rlike(r"\S") & (units <= most) & ~c.rlike(r"[\x00\r\n]"), F.lit(False))


def fact_violations(facts: DataFrame, evidence: DataFrame, property_bytes: int = 16_384) -> DataFrame:
    """fact_id and rule of all that makes a fact invalid, each rule once.

    facts: fact_id, identity_key, analyzer, version, confidence (double), canonical (its properties as
    canonical JSON; null where they hold what JSON can't). evidence: fact_id, file_id, hash_id, symbol_id
    (null for none), and start_line, start_column, start_offset, end_line, end_column, end_offset (all null
    without a range).
    """
    at_least = lambda c, low: F.coalesce(F.col(c) >= low, F.lit(False))
    ends = ("start_line", "start_column", "start_offset", "end_line", "end_column", "end_offset")
    no_range = F.lit(True)
    for c in ends:
        no_range = no_range & F.col(c).isNull()
    fine_range = at_least("start_line", 1) & at_least("start_column", 1) & at_least("start_offset", 0) & at_least("end_line", F.col("start_line")) & at_least("end_column", 1) & at_least("end_offset", F.col("start_offset"))
    fine = at_least("file_id", 1) & at_least("hash_id", 1) & (F.col("symbol_id").isNull() | (F.col("symbol_id") >= 1)) & (no_range | fine_range)
    backed = evidence.groupBy("fact_id").agg(F.count_if(~fine).alias("bad_"), F.count(F.lit(1)).alias("held_"))
    sure = ~F.isnan("confidence") & F.col("confidence").between(0, 1)
    rules = {
        "invalid_identity": bounded(F.col("identity_key"), IDENTITY_LIMIT), "invalid_analyzer": bounded(F.col("analyzer"), ANALYZER_LIMIT) & bounded(F.col("version"), ANALYZER_LIMIT), "invalid_confidence": sure,
        "missing_evidence": F.col("held_").isNotNull(), "invalid_evidence": F.coalesce(F.col("bad_"), F.lit(0)) == 0, "invalid_properties": F.col("canonical").isNotNull(), "properties_too_large": F.coalesce(F.octet_length("canonical"), F.lit(0)) <= property_bytes,
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]))
    return facts.join(backed, "fact_id", "left").select("fact_id", F.explode(broken).alias("rule"))
