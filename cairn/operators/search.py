"""Lexical retrieval, graph expansion and rank fusion over search documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.enums import SOURCE_TYPES, ordinal
from cairn.functions.cover_density import FIELDS, impact, rank, rank_of, weighted_terms
from cairn.functions.text import normalized, query_terms, round6, terms
from cairn.sources.store import delete, listed, mark

# Weights of the exact signals, of relations, and the cap of the graph's part.
SIGNALS = (("exact_identifier", 120), ("exact_title", 110), ("exact_path", 100), ("title_prefix", 70), ("identifier_prefix", 65), ("path_contains", 40))
SOURCE_WEIGHT = {"knowledge_edge": 25, "code_dependency": 20}
OUTGOING_WEIGHT, GRAPH_CAP = 2, 50
GRAPH_SEEDS, NEIGHBOURS, CANDIDATES = 10, 5, 50
#: Ids that segments have replaced or removed and that may be broadcast (some 24 bytes each); more are met by a shuffle.
BROADCAST_IDS = 1_000_000
#: Ids that may stand in the plan of a page.
PINNED = 1_000


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Equality filters for the values that are set; an unset one adds no predicate, so all others reach the scan."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def exact_signals(docs: DataFrame, raw: str) -> DataFrame:
    """docs with the six exact signals of the raw query; null columns count as empty, and % or _ are ordinary characters."""
    q = F.lower(F.lit(raw))
    name, title, path = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "title", "path"))
    return docs.withColumns(
        {"exact_identifier": name == q, "exact_title": title == q, "exact_path": path == q, "title_prefix": F.startswith(title, q), "identifier_prefix": F.startswith(name, q), "path_contains": F.contains(path, q)}
    )


def lexical_match(docs: DataFrame, text: str) -> Column:
    """Whether all terms of the normalised query are among the document's terms of any field; false for a query without any."""
    own = F.transform(weighted_terms(docs.columns), lambda x: x["term"])
    wanted = terms(F.lit(text))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, own)) == 0)


#: Weight classes in the order of a document's places, and how much text is split into terms at once.
CLASSES, CUT_BYTES = ("A", "B", "C"), 4 << 20
POSTING = "search_index_id long, term string, id long, n_a long, n_b long, n_c long, places array<int>"


def _scope(docs: DataFrame) -> Column:
    return (F.col("search_index_id") if "search_index_id" in docs.columns else F.lit(1)).cast("long").alias("search_index_id")


def postings(docs: DataFrame) -> DataFrame:
    """The inverted table of all fields: search_index_id, term, id, places by weight class (n_a, n_b, n_c) and positions.

    A document's terms are grouped within its row, a few documents at a time, so nothing is shuffled.
    """

    def grouped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in parts for x in _cut(batch)):
            terms, rows, held = [], [], np.zeros((len(CLASSES) + 1, part.num_rows), np.int64)
            for k in range(len(CLASSES)):
                lists = pc.split_pattern(part.column(2 + k), " ")
                flat, row = lists.flatten(), np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                said = pc.not_equal(flat, "")
                terms.append(flat.filter(said))
                rows.append(row[said.to_numpy(zero_copy_only=False)])
                held[k + 1] = np.bincount(rows[k], minlength=part.num_rows)
            row, weight = np.concatenate(rows), np.repeat(np.arange(len(CLASSES)), [len(x) for x in rows])
            if not len(row):
                continue
            # places are counted through a document: behind all of the classes before
            before, begun = np.cumsum(held, axis=0), [np.cumsum(n) - n for n in held[1:]]
            position = np.concatenate([np.arange(len(x)) - begun[k][x] + before[k][x] + 1 for k, x in enumerate(rows)])
            coded = pa.concat_arrays(terms).dictionary_encode()
            key = row * len(coded.dictionary) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            own, term = np.divmod(key[first], len(coded.dictionary))
            counts = [pa.array(np.add.reduceat((weight[order] == k).astype(np.int64), first)) for k in range(len(CLASSES))]
            places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), pa.array(position[order].astype(np.int32)))
            where = pa.array(own)
            yield pa.RecordBatch.from_arrays([part.column(0).take(where), coded.dictionary.take(pa.array(term)), part.column(1).take(where), *counts, places], names=["search_index_id", "term", "id", "n_a", "n_b", "n_c", "places"])

    texts = [F.concat_ws(" ", *[normalized(F.coalesce(F.col(n), F.lit(""))) for n, c in FIELDS if c == w and n in docs.columns]).alias(w) for w in CLASSES]
    return _weighed(docs.select(_scope(docs), F.col("id").cast("long").alias("id"), *texts).mapInArrow(grouped, POSTING))


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows, the texts of all but the first of which have less than CUT_BYTES together: what is held at once doesn't grow with the rows of a batch."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(2 + k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(CLASSES)))
    ends = np.cumsum(sizes) // CUT_BYTES
    starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def _weighed(table: DataFrame) -> DataFrame:
    """Postings as they are stored, with the weight class of each place: those of n_a come first, then those of n_b."""
    weight = lambda k: F.when(k < F.col("n_a"), "A").when(k < F.col("n_a") + F.col("n_b"), "B").otherwise("C")
    places = F.transform("places", lambda x, k: F.struct(x.alias("position"), weight(k).alias("weight")))
    return table.select("search_index_id", "term", "id", "n_a", "n_b", "n_c", places.alias("positions"))


def _stored_form(table: DataFrame) -> DataFrame:
    """Postings without the weight class of each place."""
    return table.select("search_index_id", "term", "id", "n_a", "n_b", "n_c", F.col("positions.position").alias("places"))


#: Characters of a gram of a path, and what stands behind its end, so that shorter needles begin a gram too.
GRAM, END = 3, "\u0000"
KEYS = ("name", "title", "path")


def keys(docs: DataFrame) -> DataFrame:
    """search_index_id, field, key, id: the fields that a query may equal or begin, lower case; a null one is empty."""
    every = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.coalesce(F.col(f), F.lit(""))).alias("key")) for f in KEYS])
    return docs.select(_scope(docs), F.col("id").cast("long").alias("id"), F.explode(every).alias("x")).select("search_index_id", "x.field", "x.key", "id")


def grams(docs: DataFrame) -> DataFrame:
    """search_index_id, gram, id: the distinct runs of GRAM characters of lower-case paths."""
    text = F.concat(F.lower(F.coalesce(F.col("path"), F.lit(""))), F.lit(END * (GRAM - 1)))
    own = F.transform(F.sequence(F.lit(1), F.length("text_") - (GRAM - 1)), lambda k: F.substr(F.col("text_"), k, F.lit(GRAM)))
    rows = docs.select(_scope(docs), F.col("id").cast("long").alias("id"), text.alias("text_")).filter(F.length("text_") >= GRAM)
    return rows.select("search_index_id", "id", F.explode(F.array_distinct(own)).alias("gram")).select("search_index_id", "gram", "id")


def with_needle(table: DataFrame, needle: str) -> DataFrame:
    """Ids of the documents whose grams allow for the needle (lower case, not empty): all that contain it, and for a long needle a few that don't."""
    if len(needle) < GRAM:
        return table.filter(F.startswith("gram", F.lit(needle))).select("id").distinct()
    own = sorted({needle[k : k + GRAM] for k in range(len(needle) - GRAM + 1)})
    hits = table.filter(F.col("gram").isin(own))
    return hits.select("id") if len(own) == 1 else hits.groupBy("id").agg(F.count(F.lit(1)).alias("hits_")).filter(F.col("hits_") == len(own)).select("id")


def impacts(table: DataFrame) -> DataFrame:
    """search_index_id, term, impact, id of postings: what a term alone weighs in a document."""
    return table.select("search_index_id", "term", impact().alias("impact"), "id")


def tops(table: DataFrame) -> DataFrame:
    """search_index_id, term, nth, impact: of impacts, those of a term's 1st, 2nd, 4th, 8th, ... document. So many documents of the term weigh no less.

    Documents of a term that weigh the same are one row with their number, so a term of very many
    documents is as many rows as it has different impacts.
    """
    own = table.groupBy("search_index_id", "term", "impact").agg(F.count(F.lit(1)).alias("n_"))
    upto = F.sum("n_").over(Window.partitionBy("search_index_id", "term").orderBy(F.desc("impact")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    powers = lambda n: F.when(n > 0, F.length(F.bin(n))).otherwise(0)  # noqa: E731  how many powers of two are not above n
    met = own.withColumn("upto_", upto).withColumns({"low_": powers(F.col("upto_") - F.col("n_")), "high_": powers(F.col("upto_")) - 1}).filter("low_ <= high_")
    return met.select("search_index_id", "term", F.explode(F.sequence("low_", "high_")).alias("k_"), "impact").select("search_index_id", "term", F.expr("shiftleft(1L, k_)").alias("nth"), "impact")


def write_sorted(table: DataFrame, path: str, order: tuple[str, ...]) -> None:
    ranged = table.repartitionByRange("search_index_id", *order).sortWithinPartitions("search_index_id", *order)
    ranged.write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("search_index_id").parquet(path)


#: What an index is made of; one that is written whole has impacts and tops besides.
TABLES = ("heads", "postings", "keys", "grams")
WHOLE = (*TABLES, "impacts", "tops")
#: What each table is sorted by.
ORDERS = {"postings": ("term", "id"), "keys": ("field", "key", "id"), "grams": ("gram", "id"), "impacts": ("term", "impact", "id"), "tops": ("term", "nth")}


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    own = spark.read.parquet(f"{root}/{name}")
    return _weighed(own) if name == "postings" else own


@dataclass(frozen=True)
class SearchIndex:
    """What queries read of search documents: heads (all but the content), postings of terms, keys in their order, and grams of paths. Content is never scanned by a query."""

    heads: DataFrame
    postings: DataFrame
    keys: DataFrame
    grams: DataFrame
    impacts: DataFrame | None = None
    tops: DataFrame | None = None

    @classmethod
    def of(cls, docs: DataFrame) -> SearchIndex:
        """Made anew with each query."""
        return cls(docs.drop("content"), postings(docs), keys(docs), grams(docs))

    @classmethod
    def write(cls, docs: DataFrame, root: str) -> SearchIndex:
        """Written once: each table by search index, in ranges of what it is looked up by and sorted, so that row group statistics leave out all but what a query asks for.

        A term that is in every document fills several ranges.
        """
        IndexOnDemand(docs, root).write(*WHOLE)
        return cls.read(docs.sparkSession, root)

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> SearchIndex:
        return cls(*[_table(spark, root, name) for name in WHOLE])


class IndexOnDemand:
    """A search index of which each table is written, of all documents, when it is first asked for, and read from then on. So a lookup of keys doesn't make terms of texts first."""

    def __init__(self, docs: DataFrame, root: str):
        self.docs, self.root, self.spark, self._held = docs, root, docs.sparkSession, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in WHOLE:
            raise AttributeError(name)
        if name not in self._held:
            self._write(name)
            self._held[name] = _table(self.spark, self.root, name)
        return self._held[name]

    def write(self, *names: str) -> None:
        for name in names:
            getattr(self, name)

    def _write(self, name: str) -> None:
        """Tables are written as they come first: ranges are found by a sample, for which they would be made twice."""
        if name == "heads":
            self.docs.drop("content").repartition("id").write.mode("overwrite").parquet(f"{self.root}/heads")
            return
        if name == "impacts":  # a plain expression of a stored table
            write_sorted(impacts(self.postings), f"{self.root}/impacts", ORDERS[name])
            return
        unsorted = f"{self.root}/unsorted-{name}"
        self._made(name).write.mode("overwrite").parquet(unsorted)
        write_sorted(self.spark.read.parquet(unsorted), f"{self.root}/{name}", ORDERS[name])
        delete(self.spark, unsorted)

    def _made(self, name: str) -> DataFrame:
        if name == "postings":
            # many texts may come from one task, and making terms of them takes longest
            tasks = max(4 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
            return _stored_form(postings(self.docs.repartition(tasks, "id")))
        return {"keys": lambda: keys(self.heads), "grams": lambda: grams(self.heads), "tops": lambda: tops(self.impacts)}[name]()


class SegmentedIndex:
    """A search index that grows by segments: an upsert writes the tables of its own documents only, and which ids they take the place of.

    A row counts unless its id was written or removed by a later segment. Segments become visible
    by a mark that is made last, so readers see all of an upsert or nothing. merge() writes what counts as one
    segment of another index, while readers go on with this one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def segments(self) -> list[int]:
        return sorted(int(x) for x in listed(self.spark, f"{self.root}/published"))

    def upsert(self, docs: DataFrame, removed: DataFrame | None = None) -> int:
        """Write docs (ids distinct) in place of what the index has of their ids, and remove others (id). Returns the segment's number."""
        own = self.segments()
        k = own[-1] + 1 if own else 0
        path = f"{self.root}/segment-{k}"
        IndexOnDemand(docs, path).write(*TABLES)
        gone = self.spark.read.parquet(f"{path}/heads").select(F.col("id").cast("long").alias("id"))
        gone = gone if removed is None else gone.unionByName(removed.select(F.col("id").cast("long").alias("id"))).distinct()
        (gone if own else gone.limit(0)).write.mode("overwrite").parquet(f"{path}/gone")
        mark(self.spark, f"{self.root}/published/{k}")
        return k

    def read(self) -> SearchIndex:
        """What counts, as an index like any other: filters of lookups reach the tables of each segment."""
        own = self.segments()
        if not own:
            raise ValueError(f"{self.root} has no segment")
        of = lambda name, k: _table(self.spark, f"{self.root}/segment-{k}", name)
        gone = None
        for k in own[1:]:
            part = of("gone", k).withColumn("since_", F.lit(k))
            gone = part if gone is None else gone.unionByName(part)
        last = None if gone is None else gone.groupBy("id").agg(F.max("since_").alias("since_"))
        if last is not None and last.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            last = F.broadcast(last)

        def live(name: str) -> DataFrame:
            every = None
            for k in own:
                part = of(name, k).withColumn("segment_", F.lit(k))
                every = part if every is None else every.unionByName(part)
            if last is None:
                return every.drop("segment_")
            return every.join(last, "id", "left").filter(F.col("since_").isNull() | (F.col("segment_") >= F.col("since_"))).drop("segment_", "since_")

        return SearchIndex(*[live(name) for name in TABLES])

    def merge(self, root: str) -> SegmentedIndex:
        """The same index as one segment below another root."""
        out, own = SegmentedIndex(self.spark, root), self.read()
        path = f"{out.root}/segment-0"
        own.heads.write.parquet(f"{path}/heads")
        for name in ("postings", "keys", "grams"):
            table = getattr(own, name)
            write_sorted(_stored_form(table) if name == "postings" else table, f"{path}/{name}", ORDERS[name])
        own.heads.select(F.col("id").cast("long").alias("id")).limit(0).write.parquet(f"{path}/gone")
        mark(self.spark, f"{out.root}/published/0")
        return out


def lowered(spark: SparkSession, raw: str) -> str:
    """raw in lower case as columns have it; the planner folds it, no job runs."""
    return spark.sql("SELECT lower(:raw) AS q", args={"raw": raw}).first()["q"]


def key_signals(table: DataFrame, needle: str) -> DataFrame:
    """id and the five signals of fields that equal or begin with the needle (lower case), for documents with any: ranges of the sorted keys."""
    own = table.filter(F.col("field").isin(*KEYS) & F.startswith("key", F.lit(needle)))
    same = F.col("key") == needle
    of = lambda field, ok: F.bool_or(ok & (F.col("field") == field))
    out = own.groupBy("id").agg(
        of("name", same).alias("exact_identifier"), of("title", same).alias("exact_title"), of("path", same).alias("exact_path"), of("title", F.lit(True)).alias("title_prefix"), of("name", F.lit(True)).alias("identifier_prefix"),
    )
    return out.filter("exact_path or title_prefix or identifier_prefix")


def lookup(table: DataFrame, query: list[str]) -> DataFrame:
    """Ids of the documents that hold all terms, by the postings: a row for each of a document's terms."""
    wanted = sorted(set(query))
    own = table.filter(F.col("term").isin(wanted))
    return own.select("id") if len(wanted) == 1 else own.groupBy("id").agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") == len(wanted)).select("id")


def exact_score() -> Column:
    total = F.lit(0)
    for name, weight in SIGNALS:
        total = total + F.when(F.col(name), weight).otherwise(0)
    return total


def candidates(docs: DataFrame | SearchIndex | IndexOnDemand, raw: str, **filters) -> DataFrame:
    """Documents that match by any of the seven signals, with the signals, exact (the sum of the six), rank (cover density of the terms) and score, the sum of both.

    Signals come from the index's tables, each asked for a few ranges; heads are read for what was found,
    and tell whether a path that has all grams of the query holds it.
    """
    index = SearchIndex.of(docs) if isinstance(docs, DataFrame) else docs
    heads, needle = optional_filters(index.heads, **filters), lowered(index.heads.sparkSession, raw)
    return _scored(index, heads, raw, needle, rank(index.postings, query_terms(raw)))


def _exact_ids(index: SearchIndex | IndexOnDemand, needle: str) -> DataFrame:
    """id and signals of documents that may match by a field."""
    inside = with_needle(index.grams, needle).withColumn("path_contains", F.lit(True))
    return key_signals(index.keys, needle).join(inside, "id", "full_outer")


def _scored(index: SearchIndex | IndexOnDemand, heads: DataFrame, raw: str, needle: str, ranks: DataFrame) -> DataFrame:
    names = [name for name, _ in SIGNALS]
    if needle == "":  # is everywhere
        met = exact_signals(heads, raw).join(ranks, "id", "left")
    else:
        ids = _exact_ids(index, needle).join(ranks, "id", "full_outer")
        met = heads.join(ids, "id")
        met = met.withColumns({n: F.coalesce(n, F.lit(False)) for n in names}).withColumn("path_contains", F.col("path_contains") & F.contains(F.lower(F.coalesce(F.col("path"), F.lit(""))), F.lit(needle)))
    found = met.withColumns({"lexical": F.col("rank").isNotNull(), "rank": F.coalesce("rank", F.lit(0.0)), "exact": exact_score()})
    hit = F.col("lexical")
    for name in names:
        hit = hit | F.col(name)
    return found.filter(hit).withColumn("score", round6(F.col("exact") + F.col("rank")))


def first_page(index: SearchIndex | IndexOnDemand, raw: str, page_number: int = 1, limit: int = 20) -> DataFrame:
    """The page of all candidates in page_order, for a query of one term by fewer postings of it.

    As many documents as the pages up to this one hold weigh no less than the impact that tops has for them; what
    weighs less, by more than scores are rounded, and matches by no field can't enter. Impacts are sorted, so
    the bound reaches the scan. Documents that match by a field are asked for by their ids, if they are few.
    """
    spark, wanted, needle, most = index.heads.sparkSession, query_terms(raw), lowered(index.heads.sparkSession, raw), page_number * limit
    whole = lambda: page(candidates(index, raw), page_order(), page_number, limit)
    if len(wanted) != 1 or index.tops is None or not needle:
        return whole()
    bound = index.tops.filter((F.col("term") == wanted[0]) & (F.col("nth") >= most)).agg(F.max("impact").alias("impact")).first()["impact"]
    exact = [r["id"] for r in _exact_ids(index, needle).select("id").limit(PINNED + 1).collect()]
    if bound is None or len(exact) > PINNED:
        return whole()
    bound -= 1e-7 * (bound + 1) ** 2  # weighs in a score what rounding may hide, several times over
    heavy = index.impacts.filter((F.col("term") == wanted[0]) & (F.col("impact") >= bound)).select("id", "impact")
    named = index.postings.filter((F.col("term") == wanted[0]) & F.col("id").isin(exact)).select("id", impact().alias("impact"))
    ranks = heavy.unionByName(named).groupBy("id").agg(F.max("impact").alias("impact")).select("id", rank_of(F.col("impact")).alias("rank"))
    return page(_scored(index, index.heads, raw, needle, ranks), page_order(), page_number, limit)


def page_order() -> list[Column]:
    return [F.desc("score"), ordinal("source_type", SOURCE_TYPES).asc(), F.asc("title"), F.asc("id")]


def page(df: DataFrame, order: list[Column], page_number: int = 1, limit: int = 20) -> DataFrame:
    """One page of an ordered listing; plans as a top-k."""
    return df.orderBy(*order).offset((page_number - 1) * limit).limit(limit)


def pinned(seeds: DataFrame, most: int = GRAPH_SEEDS) -> DataFrame:
    """The seeds of an expansion as rows of the plan itself: a page's first few, so that its many joins don't make them anew each time."""
    rows = seeds.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"an expansion has {most} seeds at most")
    return seeds.sparkSession.createDataFrame(rows, seeds.schema)


def _key(kind: str, a: Column, b: Column | None = None) -> Column:
    """What a document is found by: a symbol, a file with its hash, or a node; null without it."""
    own = F.struct(F.lit(kind).alias("k"), a.cast("long").alias("a"), (F.lit(0) if b is None else b).cast("long").alias("b"))
    return F.when(a.isNotNull() if b is None else a.isNotNull() & b.isNotNull(), own)


def _ways(outgoing: bool | None) -> list[tuple[str, str, str]]:
    return [x for x in (("source", "target", "outgoing"), ("target", "source", "incoming")) if outgoing is None or (x[2] == "outgoing") == outgoing]


def _from(df: DataFrame, columns: dict[str, list[str]], starts: dict[str, list[int]] | None) -> DataFrame:
    """The rows of df that may begin at one of the keys, by columns of each kind of key, where the keys are few; their values reach the scan."""
    if starts is None:
        return df
    wanted = F.lit(False)
    for kind, own in columns.items():
        for c in own if starts.get(kind) else []:
            wanted = wanted | F.col(c).isin(starts[kind])
    return df.filter(wanted)


def _starts(seeds: DataFrame) -> dict[str, list[int]] | None:
    """Values of the seeds' keys by kind; None if they are too many for a plan. Seeds that are rows of the plan itself cost no job."""
    rows = seeds.select("code_symbol_id", "indexed_file_id", "knowledge_node_id").limit(PINNED + 1).collect()
    if len(rows) > PINNED:
        return None
    return {k: sorted({r[c] for r in rows if r[c] is not None}) for k, c in (("s", "code_symbol_id"), ("f", "indexed_file_id"), ("n", "knowledge_node_id"))}


def _dependency_ways(deps: DataFrame, outgoing: bool | None, starts: dict[str, list[int]] | None) -> DataFrame:
    """A row for each way along a dependency: near, the key it starts from, and far, the key it leads to (the symbol, or else the file). One scan for all."""
    rows = []
    for near, far, way in _ways(outgoing):
        to = F.coalesce(_key("s", F.col(f"{far}_symbol_id")), _key("f", F.col(f"{far}_indexed_file_id"), F.col(f"{far}_file_hash_id")))
        for start in (_key("s", F.col(f"{near}_symbol_id")), _key("f", F.col(f"{near}_indexed_file_id"), F.col(f"{near}_file_hash_id"))):
            rows.append(F.when(start.isNotNull() & to.isNotNull(), F.struct(F.lit(way).alias("direction"), start.alias("near"), to.alias("far"))))
    nears = [near for near, _, _ in _ways(outgoing)]
    deps = _from(deps, {"s": [f"{x}_symbol_id" for x in nears], "f": [f"{x}_indexed_file_id" for x in nears]}, starts)
    return deps.select(F.lit("code_dependency").alias("graph_source"), "kind", "id", F.explode(F.array_compact(F.array(*rows))).alias("x"))


def _edge_ways(edges: DataFrame, outgoing: bool | None, starts: dict[str, list[int]] | None) -> DataFrame:
    edges = _from(edges, {"n": [f"{near}_node_id" for near, _, _ in _ways(outgoing)]}, starts)
    rows = [F.struct(F.lit(way).alias("direction"), _key("n", F.col(f"{near}_node_id")).alias("near"), _key("n", F.col(f"{far}_node_id")).alias("far")) for near, far, way in _ways(outgoing)]
    return edges.select(F.lit("knowledge_edge").alias("graph_source"), "kind", "id", F.explode(F.array(*rows)).alias("x"))


def _relations(seeds: DataFrame, ways: DataFrame, docs: DataFrame) -> DataFrame:
    """Neighbours of seeds along ways: seeds, the first GRAPH_SEEDS of a page, are broadcast, so ways aren't shuffled; what they lead to meets all keys of documents in one join."""
    symbol, node = _key("s", F.col("code_symbol_id")), _key("n", F.col("knowledge_node_id"))
    file = _key("f", F.col("indexed_file_id"), F.col("file_hash_id"))
    # a seed with a symbol is no file here
    starts = F.array_compact(F.array(F.coalesce(symbol, file), node))
    own = seeds.select("seed_id", "seed_order", F.explode(starts).alias("s")).select("seed_id", "seed_order", *[F.col(f"s.{c}").alias(f"s_{c}") for c in "kab"])
    flat = ways.select("graph_source", F.col("kind").alias("relationship_kind"), F.col("id").alias("relationship_id"), "x.direction", *[F.col(f"x.near.{c}").alias(f"s_{c}") for c in "kab"], *[F.col(f"x.far.{c}").alias(c) for c in "kab"])
    met = flat.join(F.broadcast(own), ["s_k", "s_a", "s_b"])
    ends = F.array_compact(F.array(symbol, F.when(F.col("source_type") == "file", file), node))
    held = docs.select(F.col("id").alias("document_id"), F.explode(ends).alias("e")).select("document_id", "e.*")
    out = met.join(held, ["k", "a", "b"]).filter(F.col("document_id") != F.col("seed_id"))
    return out.select("seed_id", "seed_order", "document_id", "graph_source", "relationship_kind", "direction", "relationship_id")


def dependency_relations(seeds: DataFrame, deps: DataFrame, docs: DataFrame, outgoing: bool) -> DataFrame:
    """Neighbours of seeds by code dependencies: of its symbol, or of its file where it has none."""
    return _relations(seeds, _dependency_ways(deps, outgoing, _starts(seeds)), docs)


def edge_relations(seeds: DataFrame, edges: DataFrame, docs: DataFrame, outgoing: bool) -> DataFrame:
    return _relations(seeds, _edge_ways(edges, outgoing, _starts(seeds)), docs)


def relations(seeds: DataFrame, deps: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Neighbours of all kinds and both directions: dependencies, edges and documents are each read once."""
    starts = _starts(seeds)
    return _relations(seeds, _dependency_ways(deps, None, starts).unionByName(_edge_ways(edges, None, starts)), docs)


def deduplicated(rel: DataFrame) -> DataFrame:
    """One relation per (seed, document): the first by source, kind, direction, id. A map-side minimum, no sort."""
    first = F.min(F.struct("graph_source", "relationship_kind", "direction", "relationship_id")).alias("r")
    return rel.groupBy("seed_id", "seed_order", "document_id").agg(first).select("seed_id", "seed_order", "document_id", "r.*")


def ranked_neighbours(rel: DataFrame) -> DataFrame:
    """neighbour_rank within the seed and seed_candidates, counted before any cut."""
    by = Window.partitionBy("seed_id")
    order = by.orderBy("graph_source", "relationship_kind", "direction", "document_id")
    return rel.withColumns({"seed_candidates": F.count(F.lit(1)).over(by), "neighbour_rank": F.row_number().over(order)})


def top_neighbours(ranked: DataFrame, per_seed: int = NEIGHBOURS, most: int = CANDIDATES) -> DataFrame:
    """The first per_seed of each seed, cut at most + 1 rows: the one more tells that there are more."""
    return ranked.filter(F.col("neighbour_rank") <= per_seed).orderBy("seed_order", "neighbour_rank", "document_id").limit(most + 1)


def truncated(top: DataFrame, per_seed: int = NEIGHBOURS, most: int = CANDIDATES) -> DataFrame:
    """Whether rows were cut, by the rows that were kept: too many overall, or a kept seed had more."""
    return top.agg(((F.count(F.lit(1)) > most) | F.coalesce(F.bool_or(F.col("seed_candidates") > per_seed), F.lit(False))).alias("truncated"))


def contribution(score: Column) -> Column:
    weight = F.when(F.col("graph_source") == "knowledge_edge", SOURCE_WEIGHT["knowledge_edge"]).otherwise(SOURCE_WEIGHT["code_dependency"]) + F.when(F.col("direction") == "outgoing", OUTGOING_WEIGHT).otherwise(0)
    return round6(weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0)) / 100)))


def capped(contributions: DataFrame, cap: float = GRAPH_CAP) -> DataFrame:
    """accepted: what of each contribution to a document fits below the cap, in seed order."""
    before = F.coalesce(F.sum("contribution").over(Window.partitionBy("document_id").orderBy("seed_order", "neighbour_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return contributions.withColumn("accepted", round6(F.greatest(F.lit(0.0), F.least(F.col("contribution"), F.lit(float(cap)) - before))))


def fused(lexical: DataFrame, graph: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document: lexical_score, graph_score and total_score of a page and its neighbours.

    lexical: id, score; graph: document_id, contribution.
    """
    sums = graph.groupBy(F.col("document_id").alias("id")).agg(F.least(F.lit(float(GRAPH_CAP)), round6(F.sum("contribution"))).alias("graph_score"))
    both = lexical.select("id", round6(F.col("score").cast("double")).alias("lexical_score")).join(sums, "id", "full_outer")
    both = both.select("id", F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.coalesce("graph_score", F.lit(0.0)).alias("graph_score"))
    return both.withColumn("total_score", round6(F.col("lexical_score") + F.col("graph_score"))).join(docs.select("id", "source_type", "title"), "id")


def fused_order() -> list[Column]:
    """Source types as text here, unlike on lexical pages."""
    return [F.desc("total_score"), F.desc("lexical_score"), F.asc("source_type"), F.asc("title"), F.asc("id")]


def signal_rows(found: DataFrame) -> DataFrame:
    """A row per matched exact signal: id, name, contribution; and the lexical residue where there is one."""
    every = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("contribution"), F.col(n).alias("matched")) for n, w in SIGNALS])
    return found.select("id", F.explode(F.filter(every, lambda s: s["matched"])).alias("s")).select("id", "s.name", "s.contribution")
