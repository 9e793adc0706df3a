"""The attribute column of annotation lines."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The attribute patterns of the annotation format, its white space.
SPACES = " \t\n\x0b\f\r"
COVERAGE_PATTERN = '(?<![A-Za-z0-9_])coverage "([^"]*)"'
COV_PATTERN = '(?<![A-Za-z0-9_])cov "([^"]*)"'


def quoted_attribute(attrs: Column, key: str) -> Column:
    """Value of ``key "value"``, NULL when the key is absent or empty."""
    return F.nullif(F.regexp_extract(attrs, re.escape(key) + r'\s+"([^"]+)"', 1), F.lit(""))


def _first_word(text: Column) -> Column:
    """What stands before the first white space."""
    return F.substring_index(F.translate(text, SPACES, " " * len(SPACES)), " ", 1)


def attributes_map(attrs: Column) -> Column:
    """All attributes as a map; accepts quoted, bare and ``key=value`` entries, last one wins."""
    parts = F.filter(
        F.transform(F.split(attrs, ";"), lambda p: F.trim(p)), lambda p: F.length(p) > 0
    )
    # first word and rest; cut once per part, as a lambda evaluates every mention of an expression anew
    cut = F.transform(parts, lambda p: F.struct(p.alias("part"), _first_word(p).alias("word")))
    named = F.transform(
        cut,
        lambda c: F.struct(
            c["part"].alias("part"), c["word"].alias("word"),
            F.ltrim(F.substring(c["part"], F.length(c["word"]) + 1, F.length(c["part"])), F.lit(SPACES)).alias("rest"),
        ),
    )

    def entry(e: Column) -> Column:
        part, word, rest = e["part"], e["word"], e["rest"]
        opened = (word != "") & rest.startswith('"')
        inner = F.substring(rest, F.lit(2), F.length(rest))
        quoted = opened & inner.contains('"')
        equals = part.contains("=") & ~opened
        key = (
            F.when(equals, F.trim(F.substring_index(part, "=", 1)))
            .when(rest != "", word)
            .otherwise(F.lit(""))
        )
        value = (
            F.when(equals, F.trim(F.substring(part, F.instr(part, "=") + 1, F.length(part))))
            .when(quoted, F.substring_index(inner, '"', 1))
            .otherwise(F.btrim(_first_word(rest), F.lit('"')))
        )
        return F.struct(key.alias("key"), value.alias("value"))

    pairs = F.filter(F.transform(named, entry), lambda e: e["key"] != "")

    def as_map(ps: Column) -> Column:
        # map_from_entries rejects repeated keys, so earlier occurrences are dropped first
        last = F.filter(
            ps, lambda e, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda later: later["key"] == e["key"])
        )
        once = F.size(F.array_distinct(F.transform(ps, lambda e: e["key"]))) == F.size(ps)
        return F.when(once, F.map_from_entries(ps)).otherwise(F.map_from_entries(last))

    # a list of one, so that the entries are made once and have a name
    return F.get(F.transform(F.array(pairs), as_map), F.lit(0))


def coverage_value(attrs: Column) -> Column:
    """Numeric ``coverage`` attribute, else ``cov``, else 0.0."""
    raw = F.when(
        attrs.rlike(COVERAGE_PATTERN), F.regexp_extract(attrs, COVERAGE_PATTERN, 1)
    ).otherwise(F.regexp_extract(attrs, COV_PATTERN, 1))
    return F.coalesce(F.trim(raw).try_cast("double"), F.lit(0.0))


def _replace_first(attrs: Column, pattern: str, literal: Column) -> Column:
    """Swap the first match of ``pattern`` for ``literal`` and keep the rest untouched."""
    before = F.regexp_extract(attrs, f"(?s)^(.*?){pattern}", 1)
    matched = F.regexp_extract(attrs, pattern, 0)
    rest = F.substring(attrs, F.length(before) + F.length(matched) + 1, F.length(attrs))
    return F.concat(before, literal, rest)


def score_text(value: Column) -> Column:
    """Shortest decimal text of a number; an exponent only below 1e-4 and from 1e16, as in ``1e-05``.

    Digits are those of the JVM, which writes the least denormal as ``4.9e-324``.  Text that is no number with an
    exponent, and null, stay as they are.
    """
    text = value.cast("string")
    wide = F.regexp_replace(text.try_cast("decimal(38,17)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    powers = ((r"E-([0-9])$", "e-0$1"), (r"E-([0-9]+)$", "e-$1"), (r"E([0-9]+)$", "e+$1"), (r"\.0e", "e"))
    short = functools.reduce(lambda t, p: F.regexp_replace(t, *p), powers, text)
    return (
        F.when(~text.rlike(r"^-?[0-9]\.[0-9]+E-?[0-9]+$"), text)
        .when(text.endswith("E-4"), F.regexp_replace(text, r"^(-?)([0-9])\.(?:0(?=E)|([0-9]+))E-4$", "$10.000$2$3"))
        .when(text.rlike(r"E([7-9]|1[0-5])$"), wide)
        .otherwise(short)
    )


def set_coverage(attrs: Column, value: Column) -> Column:
    """Write ``cov "<value>"`` over the first ``cov`` or ``coverage`` entry, or append it."""
    literal = F.concat(F.lit('cov "'), score_text(value), F.lit('"'))
    tail = F.rtrim(attrs)
    closed = F.when((tail == "") | tail.endswith(";"), tail).otherwise(F.concat(tail, F.lit(";")))
    appended = F.when(closed == "", F.concat(literal, F.lit(";"))).otherwise(
        F.concat(closed, F.lit(" "), literal, F.lit(";"))
    )
    return (
        F.when(attrs.rlike(COV_PATTERN), _replace_first(attrs, COV_PATTERN, literal))
        .when(attrs.rlike(COVERAGE_PATTERN), _replace_first(attrs, COVERAGE_PATTERN, literal))
        .otherwise(appended)
    )


def set_attribute(attrs: Column, key: str, value: Column) -> Column:
    """Replace the first ``key "..."`` entry, or append one."""
    pattern = re.escape(key) + r'\s+"[^"]*"'
    literal = F.concat(F.lit(f'{key} "'), value, F.lit('"'))
    bare = F.trim(attrs)
    closed = F.when((bare == "") | bare.endswith(";"), bare).otherwise(F.concat(bare, F.lit(";")))
    return F.when(attrs.rlike(pattern), _replace_first(attrs, pattern, literal)).otherwise(
        F.trim(F.concat(closed, F.lit(" "), literal, F.lit(";")))
    )
