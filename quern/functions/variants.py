"""JSON as VARIANT: parse, extract, set, merge, containment, each, aggregate. Malformed text counts as null, what is no object as an empty one.

Objects are changed as maps from keys to variants and turned back, so values of any kind pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X


def parse(c: str | Column) -> Column:
    """A VARIANT of JSON text; null for null and malformed text."""
    return F.try_parse_json(X.col(c))


def record(v: Column) -> Column:
    """The entries of an object as map<string, variant>; an empty map for anything else."""
    return F.coalesce(F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v.try_cast("map<string,variant>")), F.create_map().cast("map<string,variant>"))


def to_object(entries: Column) -> Column:
    return F.to_variant_object(entries)


def text_of(v: Column) -> Column:
    """JSON text; keys of objects are sorted."""
    return F.to_json(v)


def merged(a: Column, b: Column) -> Column:
    """Entries of two maps; those of ``b`` win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def put(v: Column, **entries: Column) -> Column:
    """The object with entries set to variants; null variants leave the entry as it is."""
    new = F.map_filter(F.create_map(*[x for k, e in entries.items() for x in (F.lit(k), e)]), lambda _, e: e.isNotNull())
    return to_object(merged(record(v), new))


def strings_at(v: Column, path: str) -> Column:
    """The distinct trimmed non-empty strings of an array; an empty array for anything else."""
    held = F.try_variant_get(v, F.lit(path), "array<string>")
    array = F.startswith(F.coalesce(F.schema_of_variant(F.try_variant_get(v, F.lit(path), "variant")), F.lit("")), F.lit("ARRAY"))
    return X.unique_strings(F.when(array, held))


def contains(v: Column, part: Column) -> Column:
    """Whether an object holds every entry of another (values compared whole)."""
    a, b = record(v), record(part)
    return F.forall(F.map_entries(b), lambda e: F.coalesce(F.to_json(F.try_element_at(a, e["key"])) == F.to_json(e["value"]), F.lit(False)))


def each(df: DataFrame, column: str, key: str = "key", value: str = "value") -> DataFrame:
    """A row per entry of the object in ``column`` (VARIANT), which is replaced by ``key`` and ``value``."""
    return df.select(*[c for c in df.columns if c != column], F.explode(record(F.col(column))).alias(key, value))


def gather(df: DataFrame, by: str, key: str, value: str, order: str, out: str = "object") -> DataFrame:
    """One object per ``by`` of (key, value: VARIANT) rows; of a repeated key the last by ``order`` counts."""
    last = df.groupBy(by, key).agg(F.max_by(F.to_json(value), order).alias(value))
    return last.groupBy(by).agg(to_object(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value")))))).alias(out)).withColumn(out, to_object(F.transform_values(record(F.col(out)), lambda _, x: F.parse_json(x.cast("string")))))


def _classified(properties: Column, codes: Column, raw: Column) -> Column:
    v = parse(properties)
    codes, raw = X.unique_strings(strings_at(v, "$.classifications.subkinds"), codes), X.unique_strings(strings_at(v, "$.classifications.raw_subkinds"), raw)
    filled = lambda a: F.when(F.size(a) > 0, to_object(a))
    inner = put(F.try_variant_get(v, F.lit("$.classifications"), "variant"), subkinds=filled(codes), raw_subkinds=filled(raw))
    return text_of(F.when((F.size(codes) == 0) & (F.size(raw) == 0), to_object(record(v))).otherwise(put(v, classifications=inner)))


def add_classification(properties: str | Column, subkind: str | Column) -> Column:
    """Properties (JSON text) with the code of a subkind, and its label where it is no code, among their classifications."""
    code, label = X.subkind_code(subkind), F.trim(F.coalesce(X.col(subkind), F.lit("")))
    return _classified(X.col(properties), F.array(code), F.array(F.when(~label.eqNullSafe(code), label)))


def merge_classifications(properties: str | Column, subkinds: str | Column, raw: str | Column) -> Column:
    """Properties with the codes of several subkinds and further labels among their classifications."""
    return _classified(X.col(properties), F.transform(F.coalesce(X.col(subkinds), F.array().cast("array<string>")), lambda s: X.subkind_code(s)), X.col(raw))
