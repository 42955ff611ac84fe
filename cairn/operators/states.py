"""Facts of states and transitions, rules and concepts from what the source reader finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.canonical import identity

#: Facts of one kind of a file have numbers of their own below this.
MOST = 1_000_000
ROLES = {"enum_member": "declaration", "assignment": "assignment", "condition": "condition"}


def state_key(state_set: Column, state: Column) -> Column:
    return F.when(state.isNotNull(), identity("state", F.lower(state_set), F.lower(state)))


def _facts(rows: DataFrame, kind: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rest = {c: none for c in ("source_key", "target_key", "relation", "container") if c not in rows.columns}
    own = rows.withColumns({"kind": F.lit(kind), "resolved": F.lit(True), **rest})
    own = own.withColumn("fingerprint", F.sha2(F.to_json(F.struct("kind", "identity_key", "name", "value", "source_key", "target_key", "container", "confidence_pct", "deterministic"), {"ignoreNullFields": "false"}), 256))
    return own.select("fact_id", "kind", "identity_key", "name", "value", "source_key", "target_key", "relation", "container", "path", "resolved", F.col("confidence_pct").cast("long").alias("confidence_pct"), "deterministic", "fingerprint")


def state_facts(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts and evidence of states and transitions, as projectors of knowledge take them; read: id, path, states and transitions of parsed files.

    A file names a state once, however often it sets it or asks for it; of its mentions the first
    gives its name, the surest its confidence. A transition is told from others of its kind in the file
    by how many went before.
    """
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    seen = read.select(F.col("id").alias("file_id"), "path", F.posexplode("states").alias("nth_", "x")).select("file_id", "path", "nth_", "x.*").withColumn("identity_key", state_key(F.col("state_set"), F.col("state")))
    first = F.min_by(F.struct(F.col("state").alias("name"), F.col("state_set").alias("value")), "nth_").alias("f")
    seen = seen.withColumn("first_", F.min("nth_").over(Window.partitionBy("file_id", "identity_key"))).withColumn("fact_id", F.col("file_id") * (2 * MOST) + F.col("first_"))
    states = seen.groupBy("file_id", "identity_key", "path", "fact_id").agg(first, F.max("confidence_pct").alias("confidence_pct"))
    states = states.select("path", "identity_key", "f.*", "fact_id", "confidence_pct", (F.col("confidence_pct") == 100).alias("deterministic"))
    places = seen.groupBy("file_id", "identity_key", "fact_id", "offset", "end_offset", "how").agg(F.min("nth_").alias("nth_"))
    order = Window.partitionBy("fact_id").orderBy("nth_")
    backed = places.select("fact_id", (F.row_number().over(order) - 1).cast("long").alias("nth"), "file_id", F.col("offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"), roles[F.col("how")].alias("role"))

    moves = read.select(F.col("id").alias("file_id"), "path", F.posexplode("transitions").alias("nth_", "x")).select("file_id", "path", "nth_", "x.*")
    moves = moves.withColumns({"source_key": state_key(F.col("from_set"), F.col("from_state")), "target_key": state_key(F.col("to_set"), F.col("to_state"))})
    signature = F.to_json(F.struct(F.col("container").alias("containingSymbol"), "field", F.col("source_key").alias("from"), "subject", F.col("target_key").alias("to")), {"ignoreNullFields": "false"})
    alike = Window.partitionBy("file_id", "signature_").orderBy("nth_")
    moves = moves.withColumn("signature_", signature).withColumn("occurrence_", F.row_number().over(alike) - 1)
    moves = moves.withColumns({"identity_key": identity("state_transition", "path", "signature_", "occurrence_"), "fact_id": F.col("file_id") * (2 * MOST) + MOST + F.col("nth_"), "name": F.col("from_state"), "value": F.col("to_state")})
    pieces = F.array_compact(F.array(F.struct(F.lit(0).alias("nth"), F.col("offset").alias("a"), F.col("end_offset").alias("b"), F.lit("assignment").alias("role")), F.when(F.col("source_key").isNotNull(), F.struct(F.lit(1).alias("nth"), F.col("condition_offset").alias("a"), F.col("condition_end").alias("b"), F.lit("condition").alias("role")))))
    moved = moves.select("fact_id", "file_id", F.explode(pieces).alias("x")).select("fact_id", F.col("x.nth").cast("long").alias("nth"), "file_id", F.col("x.a").cast("long").alias("start_offset"), F.col("x.b").cast("long").alias("end_offset"), "x.role")
    return _facts(states, "state").unionByName(_facts(moves, "state_transition")), backed.unionByName(moved)
