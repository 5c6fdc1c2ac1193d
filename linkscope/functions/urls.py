"""URL functions as column expressions, after RFC 3986; a part that is missing is an empty string, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(url, "(?s)" + PARTS, n)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def comparable_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def comparable_url(url: Column) -> Column:
    """The same for any scheme, port and outer slashes."""
    query = part(url, 4)
    path = F.regexp_replace(part(url, 3), r"^/+|/+$", "")
    return F.concat(comparable_host(url), F.lit("/"), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def last_segment(url: Column) -> Column:
    return F.lower(F.regexp_extract(part(url, 3), r"([^/]+)/*$", 1))


def remove_dot_segments(path: Column) -> Column:
    """Empty segments stay; a dot segment at the end leaves its slash."""
    up = lambda kept, seg: F.when(seg == ".", kept).when((seg == "..") & (F.size(kept) > 1), F.slice(kept, 1, F.size(kept) - 1)).when(seg == "..", kept).otherwise(F.concat(kept, F.array(seg)))
    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), up)
    return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(""))


def _built(scheme: Column, authority: Column, path: Column, query: Column) -> Column:
    bare = F.lower(F.regexp_replace(authority, r"^.*@", ""))
    clean = remove_dot_segments(F.when(path == "", "/").otherwise(path))
    url = F.concat(F.lower(scheme), F.lit("://"), bare, clean, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.regexp_replace(bare, r":\d*$", "") != "", url)


def resolve(href: Column, base: Column) -> Column:
    """The absolute http(s) URL of a link on the page base, or null if it leads nowhere: empty, a fragment, another scheme."""
    ref = F.regexp_replace(href, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")
    scheme = F.lower(F.regexp_extract(ref, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    base_scheme = F.when(part(base, 1) != "", part(base, 1)).otherwise("https")
    path, base_path = part(ref, 3), F.when(part(base, 3) != "", part(base, 3)).otherwise("/")
    joined = F.when(path == "", base_path).when(path.startswith("/"), path).otherwise(F.concat(F.regexp_replace(base_path, r"[^/]*$", ""), path))
    query = F.when((path == "") & (part(ref, 4) == ""), part(base, 4)).otherwise(part(ref, 4))
    return (
        F.when((ref == "") | ref.startswith("#"), None)
        .when(scheme.isin("http", "https"), _built(scheme, part(ref, 2), path, part(ref, 4)))
        .when(scheme != "", None)
        .when(host(base) == "", None)
        .when(ref.startswith("//"), _built(base_scheme, part(ref, 2), path, part(ref, 4)))
        .otherwise(_built(base_scheme, part(base, 2), joined, query))
    )


def is_internal(url: Column, site: Column) -> Column:
    return (comparable_host(url) != "") & (comparable_host(url) == comparable_host(site))


def stored(url: Column, chars: int = 500) -> Column:
    return F.substring(url, 1, chars)
