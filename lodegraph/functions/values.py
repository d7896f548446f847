"""Column expressions for numbers, versions, statements and maps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def finite_non_negative(x: Column) -> Column:
    """The number, or 0 for a negative one, one that is not finite and none."""
    y = x.cast("double")
    return F.coalesce(F.when(~F.isnan(y) & (y >= 0) & (y < float("inf")), y), F.lit(0.0))


def version_key(x: Column) -> Column:
    """A struct in the order of versions ``[v]major.minor.patch[-prerelease][+build]``: a prerelease comes before
    its release and by its text; null for what is no such version."""
    shape = r"^\s*v?(\d+)\.(\d+)\.(\d+)(?:-([^+]+))?(?:\+.+)?\s*$"
    number = lambda k: F.regexp_extract(x, shape, k).try_cast("long")
    pre = F.regexp_extract(x, shape, 4)
    return F.when(x.rlike(shape), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("release"), pre.alias("prerelease")))


def dotted_prerelease_key(pre: Column) -> Column:
    """An array in the order of prereleases by their dotted parts: numbers by value and before words."""
    digits = lambda p: p.rlike(r"^\d+$")
    return F.transform(F.split(pre, r"\."), lambda p: F.struct((~digits(p)).alias("word"), F.when(digits(p), p.try_cast("long")).alias("n"), p.alias("text")))


def line_of(text: Column, token: Column) -> Column:
    """The number, from 1, of the first line that holds the token; null without one, 1 for an empty token."""
    return F.when(token == "", F.lit(1)).when(F.contains(text, token), F.size(F.split(F.substr(text, F.lit(1), F.position(token, text) - 1), "\n")))


def statement(x: Column) -> Column:
    """Lower-case letters and digits, with a blank for each run of anything else between them."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def covered_by(issue: Column, told: Column) -> Column:
    """Whether a statement says what an issue says: either, as ``statement``, holds the other.  An empty issue is
    covered by anything, an empty statement covers nothing else."""
    a, b = statement(issue), statement(told)
    return F.when(a == "", F.lit(True)).otherwise((b != "") & (F.contains(a, b) | F.contains(b, a)))


def env_keys(env: Column) -> Column:
    """The keys of a map in order; values are not read."""
    return F.array_sort(F.map_keys(env))


def env_names(env: Column) -> Column:
    """The keys of an array of ``KEY=value`` in order; values are not kept."""
    return F.array_sort(F.filter(F.transform(env, lambda x: F.btrim(F.split_part(x, F.lit("="), F.lit(1)), F.lit(" \t\r\n"))), lambda k: k != ""))


def portable(attributes: Column) -> Column:
    """A map of attributes as JSON, without nulls and in order of keys."""
    own = F.array_sort(F.map_entries(F.map_filter(attributes, lambda _, v: v.isNotNull())))
    return F.to_json(F.map_from_entries(own))


def string_hash(x: Column) -> Column:
    """31 h + code over the UTF-16 units, as a signed 32-bit number."""
    digits = F.hex(F.encode(x, "UTF-16BE"))
    codes = F.transform(F.regexp_extract_all(digits, F.lit("(....)"), F.lit(1)), lambda c: F.conv(c, 16, 10).cast("long"))
    wrapped = lambda h: F.pmod(h + 2**31, F.lit(2**32)) - 2**31
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrapped(h * 31 + c)).cast("int")


def seeded_vectors(seed: pa.Array, dims: int) -> pa.Array:
    """For each seed a unit vector of the numbers that a linear congruential generator gives from it on."""
    state = seed.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty((len(state), dims))
    for k in range(dims):
        state = (state * 1664525 + 1013904223 + 2**31) % 2**32 - 2**31
        out[:, k] = state / 0xFFFFFFFF * 2 - 1
    out /= np.sqrt((out * out).sum(1))[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dims, dtype=np.int32)), pa.array(out.ravel()))


def mock_embedding(x: Column, dims: int = 1536) -> Column:
    """A unit vector that follows from the text alone: numbers seeded with its ``string_hash``."""

    @F.arrow_udf(ArrayType(DoubleType()))
    def vectors(seed: pa.Array) -> pa.Array:
        return seeded_vectors(seed, dims)

    return vectors(string_hash(x))
