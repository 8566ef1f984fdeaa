"""Column functions: normalisation, keys, paths, canonical JSON.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest excerpt that an evidence row keeps, in code points.
EXCERPT = 4000
#: Keys whose values are never shown (fixed list of sensitive names).
SENSITIVE = r"(?i)(password|secret|token|credential|api[-_.]?key|private[-_.]?key|authorization)"


def terms(text: Column) -> Column:
    """Distinct letter-and-number runs of the lower-cased text, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")))


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def percent_encode(part: Column) -> Column:
    """Percent-encoding that leaves ``A-Za-z0-9-_.!~*'()`` alone and writes a space as %20."""
    out = F.url_encode(part)
    for code, char in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, code, char)
    return out


def entity_key(kind: Column, source: Column, scope: Column, name: Column) -> Column:
    """``type:source:scope:name``; names are case-insensitive except those of modules."""
    folded = F.when(kind == "module", name).otherwise(F.lower(name))
    return F.concat_ws(":", kind, source, percent_encode(scope), percent_encode(folded))


def relationship_key(kind: Column, source_key: Column, target_key: Column) -> Column:
    return F.concat(kind, F.lit(":"), source_key, F.lit("->"), target_key)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def extension(filename: Column) -> Column:
    """From the last dot on, lower-cased; empty without a dot."""
    return F.regexp_extract(F.lower(filename), r"(\.[^.]*)$", 1)


def lines_of(text: Column) -> Column:
    """Lines with any of the three line ends."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def excerpt(text: Column, limit: int = EXCERPT) -> Column:
    """(excerpt, truncated) of a trimmed text."""
    bare = trimmed(text)
    return F.struct(F.left(bare, F.lit(limit)).alias("excerpt"), (F.char_length(bare) > limit).alias("truncated"))


def first_sentence(text: Column, limit: int = 4096) -> Column:
    """The first sentence without Markdown emphasis and link targets."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]", "")
    found = F.regexp_extract(bare, r"^(.*?[.!?])(?=\s|$)", 1)
    return F.left(F.when(found == "", bare).otherwise(found), F.lit(limit))


def escape_pointer(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_pointer(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def ancestors(path: Column) -> Column:
    """Every proper ancestor folder of a path, from the longest to the shortest."""
    parts = F.split(path, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` resolved; leading ``..`` are kept."""

    def step(acc: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return (
            F.when(part.isin("", "."), acc)
            .when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def short_name(name: Column) -> Column:
    """The last two segments of a dotted or slashed name."""
    parts = F.split(name, r"[./]")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")


def owner_of_method(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def is_safe_path(path: Column) -> Column:
    """A relative path without empty, ``.`` or ``..`` segments, backslashes or control characters."""
    parts = F.split(path, "/", -1)
    return (path != "") & ~path.rlike(r"[\\\x00-\x1f]") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def is_sensitive(key: Column) -> Column:
    return key.rlike(SENSITIVE)


def health(age_seconds: Column) -> Column:
    return F.when(age_seconds <= 30, "healthy").when(age_seconds <= 90, "degraded").otherwise("offline")


def canonical_json(*columns: Column) -> Column:
    """A struct as JSON with the given (sorted) fields; nulls are written."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
