"""Column expressions for text, numbers and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a question adds and a search leaves out.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "this", "to", "we", "what", "where", "which", "who", "with"]
#: Published formats of keys, each with its fixed beginning: cloud access keys, code-hosting,
#: chat, mail, payment and map tokens, signed web tokens and private keys in text form.
KEY_FORMATS = [
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[opsu]_[0-9A-Za-z]{36}\b",
    r"\bglpat-[0-9A-Za-z_-]{20}\b",
    r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    r"\bSG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}\b",
    r"\bsk_live_[0-9A-Za-z]{24,}",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----",
    # any quoted literal of 32 or more letters and digits that is assigned
    r"[=:]\s*[\x22\x27][0-9A-Za-z+/_-]{32,}[\x22\x27]",
]
SECRET = "|".join(KEY_FORMATS)


def alias_key(x: Column) -> Column:
    return F.lower(F.trim(x))


def stable_id(kind: Column, key: Column) -> Column:
    """``wkg:<kind>:`` and 20 hex digits of the hash of kind and key."""
    digest = F.sha2(F.concat(kind, F.lit("\0"), key), 256)
    return F.concat(F.lit("wkg:"), kind, F.lit(":"), F.substring(digest, 1, 20))


def tokens(x: Column) -> Column:
    """Lower-case alphanumeric tokens of two or more characters, with those of camel-case parts."""
    parts = F.concat(F.split(F.lower(x), "[^a-z0-9]+"), F.split(F.lower(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"))
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) > 1))


def round_half_up(x: Column, digits: int = 3) -> Column:
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def pointer_escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def node_id(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_]", "_")


def slug(x: Column) -> Column:
    """Lower case, with a hyphen for each run of other characters than letters, digits, ``.``, ``_`` and ``-``, none at
    the ends; ``unknown`` for nothing."""
    own = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(own == "", F.lit("unknown")).otherwise(own)


def alnum(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def safe_path(x: Column) -> Column:
    """A relative path, or ``unknown`` for an absolute one and one that leaves its folder."""
    path = F.replace(x, F.lit("\\"), F.lit("/"))
    bad = path.rlike("^/") | path.rlike("^[A-Za-z]:") | F.array_contains(F.split(path, "/"), "..") | (F.trim(path) == "")
    return F.when(bad | path.isNull(), F.lit("unknown")).otherwise(path)


def estimated_tokens(x: Column) -> Column:
    return F.ceil(F.length(x) / 4).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector of length 0; null where the sizes differ."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))
