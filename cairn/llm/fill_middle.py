"""Fill-in-middle transformation (13): a counted-quantifier regex for each row.

regexp_count gives the number of units (code points) of a text. Two draws of a hash of the id say where
it is cut; they stand as counts in a pattern of the row's own, whose possessive groups unit{a} and
unit{b-a} take prefix and middle without backtracking and leave the suffix. The row's replacement names
the groups in the order of its form, so one match cuts the text and puts the parts in order. All of it
is built-in expressions of one projection: nothing is shuffled, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A code point, line ends included.
UNIT = "(?s:.)"
#: Units that are counted as one match.
RUN = 1_000
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 cut ones so many are written suffix first.
CUT, SUFFIX_FIRST = 90, 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(id_: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """The first n 8-digit groups of the hex SHA-256 of `seed:id`, as numbers; a null id is written as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(n)]


def units(text: Column, run: int = RUN) -> Column:
    """Code points of text: matches of a whole run of units, and of one unit in what is left.

    regexp_count lists its matches, so single units of a long text would take many times its memory.
    """
    left = F.regexp_extract(text, rf"\A(?:{UNIT}{{{run}}})*+({UNIT}*)\z", 1)
    return run * F.regexp_count(text, F.lit(f"{UNIT}{{{run}}}")).cast("long") + F.regexp_count(left, F.lit(UNIT))


def cut_pattern(first: Column, second: Column) -> Column:
    """A pattern that takes the first `first` units, those up to `second`, and the rest."""
    return F.concat(F.lit(rf"\A({UNIT}{{"), first.cast("string"), F.lit(rf"}}+)({UNIT}{{"), (second - first).cast("string"), F.lit(rf"}}+)({UNIT}*)\z"))


def restored(form: Column, output: Column) -> Column:
    """The text of an output of that form. A cut text holds no marker, so each marker stands once."""
    parts = lambda *order: rf"(?s)\A{order[0]}(.*){order[1]}(.*){order[2]}(.*)\z"
    psm = F.regexp_replace(output, F.lit(parts(PREFIX, SUFFIX, MIDDLE)), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(parts(SUFFIX, PREFIX, MIDDLE)), F.lit("$2$3$1"))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of docs: doc_id, n (code points), form (plain, psm, spm), prefix_chars, middle_chars, output.

    A text stays plain if it is empty, holds a marker or isn't drawn; the two counts are null then. A
    null text is empty, and its output is empty. Repeated rows are cut alike, as the draws depend on
    the id alone; rows with a null id share one draw. Texts of any length are cut in one pass. Other
    columns are left out. An empty table gives an empty result.
    """
    text, n = F.col("text_"), F.col("n")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text_"))
    counted = rows.withColumn("n", units(text))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    plain = (n == 0) | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= cut)
    form = F.when(plain, PLAIN).when(h4 % 100 < suffix_first, SPM).otherwise(PSM)
    placed = counted.withColumns({"form": form, "a_": F.least(h1 % (n + 1), h2 % (n + 1)), "b_": F.greatest(h1 % (n + 1), h2 % (n + 1))})
    own = F.col("form") != PLAIN
    order = F.when(F.col("form") == PSM, f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(own, F.regexp_replace(text, cut_pattern(F.col("a_"), F.col("b_")), order)).otherwise(text)
    return placed.select("doc_id", "n", "form", F.when(own, F.col("a_")).alias("prefix_chars"), F.when(own, F.col("b_") - F.col("a_")).alias("middle_chars"), output.alias("output"))


def fill_digest(filled: DataFrame) -> DataFrame:
    """filled with digests of the output and of the text restored from it, in place of the output."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return filled.withColumns({"output_sha256": digest(F.col("output")), "restored_sha256": digest(restored(F.col("form"), F.col("output")))}).drop("output")
