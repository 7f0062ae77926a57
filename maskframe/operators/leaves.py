"""Walking the string leaves of nested columns by their schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A leaf function sees the value and the path of the leaf, e.g. "messages[0].content".
LeafMap = Callable[[Column, Column], Column]


def has_strings(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StringType):
        return True
    if isinstance(data_type, T.StructType):
        return any(has_strings(field.dataType) for field in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return has_strings(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return has_strings(data_type.valueType)
    return False


def _index(path: Column, i: Column) -> Column:
    return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))


def map_leaves(value: Column, data_type: T.DataType, change: LeafMap, path: Column) -> Column:
    """``value`` with ``change(leaf, path)`` for each string leaf; same type."""
    if isinstance(data_type, T.StringType):
        return change(value, path)
    if not has_strings(data_type):
        return value
    if isinstance(data_type, T.StructType):
        fields = [
            map_leaves(value[f.name], f.dataType, change, F.concat(path, F.lit("." + f.name))).alias(f.name)
            for f in data_type.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda v, i: map_leaves(v, data_type.elementType, change, _index(path, i)))
    return F.transform_values(
        value, lambda k, v: map_leaves(v, data_type.valueType, change, _index(path, k)))


def collect_leaves(value: Column, data_type: T.DataType, visit: LeafMap, element_type: str, path: Column) -> Column:
    """Concatenation of the arrays ``visit(leaf, path)`` gives for each string leaf."""
    nothing = F.array().cast(f"array<{element_type}>")
    if isinstance(data_type, T.StringType):
        return F.coalesce(visit(value, path), nothing)
    if not has_strings(data_type):
        return nothing
    if isinstance(data_type, T.StructType):
        parts = [
            collect_leaves(value[f.name], f.dataType, visit, element_type, F.concat(path, F.lit("." + f.name)))
            for f in data_type.fields if has_strings(f.dataType)
        ]
        return F.concat(*parts)
    if isinstance(data_type, T.ArrayType):
        inner = F.transform(
            value, lambda v, i: collect_leaves(v, data_type.elementType, visit, element_type, _index(path, i)))
    else:
        inner = F.transform(
            F.map_entries(value),
            lambda e: collect_leaves(e["value"], data_type.valueType, visit, element_type, _index(path, e["key"])))
    return F.coalesce(F.flatten(inner), nothing)
