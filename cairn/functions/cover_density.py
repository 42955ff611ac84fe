"""Cover-density rank: how closely a query's terms stand together, by weighted positions.

After the published method (covers: shortest spans that hold all terms). A cover of weights w over a
span of n positions scores mean(w) of its terms scaled down by the positions between them that are
no query term; covers add up. The sum r is returned as r / (r + 1) * 50, so it stays under 50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import normalized

# Weights of the classes C, B, A, and the scale.
WEIGHTS = {"C": 0.2, "B": 0.4, "A": 1.0}
SCALE = 50.0
FIELDS = (("title", "A"), ("path", "A"), ("kind", "B"), ("language", "B"), ("content", "C"))


def weighted_terms(columns: list[str] | None = None) -> Column:
    """array of (term, position, weight class): fields one after another, positions counted through; columns: the fields that there are."""

    def field(name: str, weight: str) -> Column:
        own = F.filter(F.split(normalized(F.coalesce(F.col(name), F.lit(""))), " "), lambda x: x != "")
        return F.transform(own, lambda x: F.struct(x.alias("term"), F.lit(weight).alias("weight")))

    parts = [field(n, w) for n, w in FIELDS if columns is None or n in columns]
    return F.transform(F.concat(*parts), lambda x, k: F.struct(x["term"].alias("term"), (k + 1).alias("position"), x["weight"].alias("weight")))


def covers(positions: list[tuple[int, str, float]], wanted: set[str]) -> float:
    """Sum over the shortest covers; positions are (position, term, weight) of query terms in order."""
    last: dict[str, tuple[int, float]] = {}
    total, begun = 0.0, -1
    for at, term, weight in positions:
        last[term] = (at, weight)
        if len(last) < len(wanted):
            continue
        first = min(p for p, _ in last.values())
        if first > begun:  # a shorter cover than any that begins there
            begun = first
            inside = at - first + 1
            noise = max(0, inside - len(wanted))
            mean = len(wanted) / sum(1 / w for _, w in last.values())
            total += mean / (1 + noise)
    return total


def impact() -> Column:
    """The covers of a term alone: its places by weight class (n_a, n_b, n_c)."""
    return WEIGHTS["A"] * F.col("n_a") + WEIGHTS["B"] * F.col("n_b") + WEIGHTS["C"] * F.col("n_c")


def rank_of(r: Column) -> Column:
    return SCALE * r / (r + 1)


def rank(postings: DataFrame, query: list[str]) -> DataFrame:
    """id and rank of the documents that hold all terms of the query, by their postings (id, term, n_a, n_b, n_c, positions) of these terms.

    A single term's covers are its places, so its rank is a sum of counts; those of several terms are found
    by one pass over their sorted places.
    """
    wanted = sorted(set(query))
    if not wanted:
        return postings.select("id", F.lit(0.0).alias("rank")).limit(0)
    own = postings.filter(F.col("term").isin(wanted))
    if len(wanted) == 1:
        return own.select("id", rank_of(impact()).alias("rank"))
    term = F.array_position(F.array(*[F.lit(x) for x in wanted]), F.col("term")).cast("int")
    weight = lambda x: F.when(x["weight"] == "A", WEIGHTS["A"]).when(x["weight"] == "B", WEIGHTS["B"]).otherwise(WEIGHTS["C"])
    places = F.flatten(F.collect_list(F.transform("positions", lambda x: F.struct(x["position"].cast("int").alias("position"), term.alias("term"), weight(x).alias("weight")))))
    hits = own.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.array_sort(places).alias("hits")).filter(F.col("terms") == len(wanted))
    r = covered(F.col("hits"), len(wanted))
    return hits.select("id", r.alias("r_")).select("id", rank_of(F.col("r_")).alias("rank"))


def covered(hits: Column, n: int) -> Column:
    """covers() as an expression: one pass over the sorted hits (position, term from 1 to n, weight), keeping the last place of each term, what the cover counted last began at, and the sum."""
    none = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("weight"))
    start = F.struct(F.array_repeat(none, n).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).alias("total"))

    def step(held: Column, x: Column) -> Column:
        last = F.transform(held["last"], lambda own, k: F.when(k + 1 == x["term"], F.struct(x["position"].alias("at"), x["weight"].alias("weight"))).otherwise(own))
        return _counted(held, x, last, n)

    return F.aggregate(hits, start, step, lambda held: held["total"])


def _counted(held: Column, x: Column, last: Column, n: int) -> Column:
    """The sum with the cover that ends at x, if all terms were met and it begins later than the one before. `last` is made once, as the element of an array."""

    def of(last: Column) -> Column:
        first = F.array_min(F.transform(last, lambda own: own["at"]))
        noise = F.greatest(F.lit(0), x["position"] - first + 1 - n)
        mean = n / F.aggregate(last, F.lit(0.0), lambda s, own: s + F.when(own["weight"] > 0, 1 / own["weight"]).otherwise(0.0))
        new = (first >= 0) & (first > held["begun"])
        return F.struct(last.alias("last"), F.when(new, first).otherwise(held["begun"]).alias("begun"), F.when(new, held["total"] + mean / (1 + noise)).otherwise(held["total"]).alias("total"))

    return F.transform(F.array(last), of)[0]
