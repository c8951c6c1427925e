"""Text, array and id expressions. All are Spark columns; nothing here runs Python on executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import schemas as S


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_term(c: str | Column) -> Column:
    """Trimmed, lower-cased, white space runs (Unicode) as one blank."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"(?U)\s+", " "))


def unique_strings(*arrays: str | Column) -> Column:
    """Ordered union of arrays of strings: trimmed, without empty and repeated ones; null arrays count as empty."""
    joined = F.concat(*[F.coalesce(col(a), F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(F.transform(joined, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def merge_text(*blocks: str | Column) -> Column:
    """Distinct trimmed non-empty blocks joined by a blank line."""
    return F.array_join(unique_strings(F.array(*[col(b) for b in blocks])), "\n\n")


def stable_suffix(*parts: str | Column) -> Column:
    """First 12 hex digits of the SHA-1 of the parts joined by two bars; null parts count as empty."""
    return F.substring(F.sha1(F.concat_ws("||", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])), 1, 12)


def canonical_node_id(kind: str | Column, name: str | Column, subkind: str | Column | None = None) -> Column:
    sub = F.lit(None).cast("string") if subkind is None else col(subkind)
    prefix = F.when(F.coalesce(sub, F.lit("")) != "", F.concat_ws("/", col(kind), sub)).otherwise(col(kind))
    return F.concat(prefix, F.lit(":auto-"), stable_suffix(prefix, normalize_term(name)))


def contains_any(c: str | Column, needles: Sequence[str]) -> Column:
    """True if one of the literal needles (no wildcards) is a substring."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(col(c), F.lit(n))
    return out


def content_role(title: str | Column, label: str | Column | None = None, explicit: str | Column | None = None) -> Column:
    """knowledge, summary, assessment or excluded: the explicit role if valid, else by the title and label."""
    shown = F.trim(F.concat_ws(" ", F.trim(F.coalesce(col(title), F.lit(""))), F.trim(F.coalesce(col(label), F.lit(""))) if label is not None else F.lit("")))
    by_title = (
        F.when(shown.rlike(S.ASSESSMENT_TITLE), "assessment").when(shown.rlike(S.SUMMARY_TITLE), "summary").when(shown.rlike(S.EXCLUDED_TITLE), "excluded").otherwise("knowledge")
    )
    if explicit is None:
        return by_title
    e = F.trim(col(explicit))
    return F.when(e.isin("knowledge", "summary", "assessment", "excluded"), e).otherwise(by_title)


def excerpt(text: str | Column, limit: int) -> Column:
    """Lines trimmed and joined, white space collapsed, cut at ``limit`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(col(text), r"\s+", " "))
    return F.when(F.char_length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit("..."))).otherwise(flat)


def like_pattern(needle: str) -> str:
    """A LIKE pattern for a literal substring."""
    return "%" + needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def stable_angle(c: str | Column) -> Column:
    """A stable angle 0..359 of a string: multiply by 31 and add the next code, modulo 2**32, then modulo 360."""
    codes = F.filter(F.split(col(c), ""), lambda x: x != "")
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: (h * 31 + F.ascii(x)) % F.lit(1 << 32)) % 360).cast("int")


def subkind_code(c: str | Column) -> Column:
    """The code of a subkind: by the fixed list, else the value as a lower-case ASCII slug if that is a valid code, else null."""
    raw = F.trim(col(c))
    codes = F.create_map(*[F.lit(x) for kv in S.SUBKIND_CODES.items() for x in kv])
    slug = F.regexp_replace(F.regexp_replace(F.lower(raw), r"[\s\-/]+", "_"), "^_+|_+$", "")
    mapped = F.coalesce(F.element_at(codes, raw), slug)
    return F.when(mapped.rlike("^[a-z][a-z0-9_]*$"), mapped)


def primary_subkind(existing: str | Column, staged: str | Column) -> Column:
    """The specific code wins over a generic one; the existing one wins otherwise."""
    a, b = subkind_code(existing), subkind_code(staged)
    generic = lambda x: x.isin(*S.GENERIC_SUBKINDS)
    return F.when(a.isNotNull() & ~generic(a), a).when(b.isNotNull() & ~generic(b), b).otherwise(F.coalesce(a, b))
