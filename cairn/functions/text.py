"""Text and number functions, all as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# Where camel case is parted, and what stands between terms.
CAPITALS, CAMEL, BETWEEN = r"([A-Z]+)([A-Z][a-z])", r"([a-z\d])([A-Z])", r"[^\p{L}\p{N}]+"


def normalized(c: Column) -> Column:
    """Search text: camel case parted, runs of other characters than letters and digits to one space, trimmed, lower case."""
    c = F.regexp_replace(c, CAPITALS, "$1 $2")
    c = F.regexp_replace(c, CAMEL, "$1 $2")
    return F.lower(F.trim(F.regexp_replace(c, BETWEEN, " ")))


def terms(c: Column) -> Column:
    """Distinct terms of search text; an empty array without any."""
    return F.array_distinct(F.filter(F.split(normalized(c), " "), lambda t: t != ""))


def query_terms(raw: str) -> list[str]:
    """Distinct terms of a query, as terms() has them, at the driver: literals that reach a scan."""
    for pattern in (CAPITALS, CAMEL):
        raw = re.sub(pattern, r"\1 \2", raw, flags=re.ASCII)
    own = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in raw).lower()
    return list(dict.fromkeys(x for x in own.split(" ") if x))


def round6(c: Column) -> Column:
    """Six decimals, halves up (toward positive infinity)."""
    return F.floor(c * 1e6 + F.lit(0.5)).cast("double") / 1e6


def joined(parts: Sequence[Column], sep: str = "\n") -> Column:
    """Trimmed parts joined, null and empty ones left out."""
    trimmed = F.transform(F.array_compact(F.array(*parts)), lambda x: F.trim(x))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), sep)


def sanitized(c: Column) -> Column:
    """NUL characters to spaces."""
    return F.translate(c, "\u0000", " ")


def iso_utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def extension(path: Column) -> Column:
    """Lower-cased extension of the last segment, 1 to 32 characters, else null; a leading dot makes no extension."""
    found = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    return F.when(F.length(found).between(1, 32), found)


def provider(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(host.isin("github.com", "www.github.com"), "github").when(host.isin("gitlab.com", "www.gitlab.com"), "gitlab").when(host.isin("bitbucket.org", "www.bitbucket.org"), "bitbucket").otherwise("generic")


def normalized_url(url: Column) -> Column:
    """A clone URL without trailing slashes; null where it isn't https, or has credentials, a query or a fragment."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    fine = (F.lower(part("PROTOCOL")) == "https") & part("HOST").isNotNull() & part("USERINFO").isNull() & part("QUERY").isNull() & part("REF").isNull()
    return F.when(fine, F.concat(F.lit("https://"), F.lower(part("HOST")), F.regexp_replace(part("PATH"), r"/+$", "")))


def progress(status: Column, done: Column, total: Column) -> Column:
    return F.when(status == "succeeded", 100).when(total == 0, 0).otherwise(F.least(F.lit(100), F.floor(done * 100 / F.nullif(total, F.lit(0))))).cast("long")
