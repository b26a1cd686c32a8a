"""Nested cells: tags, checks, JSON nodes, reading and changing values by path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.paths import let


def tag_value(tags: Column, key: str) -> Column:
    """Value of the first tag with the given key."""
    return F.get(F.filter(tags, lambda t: t["Key"] == key), 0)["Value"]


def passed_checks(*details: Column) -> Column:
    """How many checks of all given detail lists have passed."""
    total = F.lit(0)
    for d in details:
        total = total + F.coalesce(F.size(F.filter(d, lambda c: c["Status"] == "passed")), F.lit(0))
    return total


def region_of_zone(zone: Column) -> Column:
    return F.left(zone, F.length(zone) - 1)


def family_and_size(instance_type: Column) -> dict[str, Column]:
    parts = F.split(instance_type, r"\.")
    return {"InstanceFamily": F.get(parts, 0), "InstanceXlarge": F.get(parts, 1)}


def _node_type(value: Column, text: Column) -> Column:
    """Type of a node by its JSON text; only numbers are asked for the type they are held as."""
    number = F.when(F.schema_of_variant(value).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int")).otherwise(F.lit("float"))
    return (
        F.when(F.startswith(text, F.lit("{")), F.lit("dict"))
        .when(F.startswith(text, F.lit("[")), F.lit("list"))
        .when(F.startswith(text, F.lit('"')), F.lit("str"))
        .when(text.isin("true", "false"), F.lit("bool"))
        .when(text == "null", F.lit("NoneType"))
        .otherwise(number)
    )


def json_nodes(json: Column, depth: int = 3) -> Column:
    """Every node of a JSON cell down to ``depth``: path, type and text of the value.

    All levels are built inside the row, so one scan and no shuffle is needed. ``operators.columns.nested_paths``
    goes on to the last level.
    """
    levels = json_levels(json, F.lit("(root)"), depth)
    return F.transform(levels, lambda n: F.struct(n["path"].alias("path"), n["data_type"].alias("data_type"), n["value"].alias("value")))


def json_levels(json: Column, root: Column, depth: int) -> Column:
    """The nodes of a cell whose own path is ``root``, each with its ``level`` below it."""
    def node(path: Column, value: Column) -> Column:
        return F.struct(path.alias("path"), value.alias("value"), F.to_json(value).alias("text"))

    none = F.array().cast("array<struct<path:string,value:variant,text:string>>")

    def children(parent: Column) -> Column:
        named = F.transform(
            F.map_entries(F.try_variant_get(parent["value"], "$", "map<string,variant>")),
            lambda e: node(F.concat(parent["path"], F.lit("['"), e["key"], F.lit("']")), e["value"]),
        )
        placed = F.transform(
            F.try_variant_get(parent["value"], "$", "array<variant>"),
            lambda v, i: node(F.concat(parent["path"], F.lit("["), i.cast("string"), F.lit("]")), v),
        )
        found = F.when(F.startswith(parent["text"], F.lit("{")), named).when(F.startswith(parent["text"], F.lit("[")), placed)
        return F.coalesce(found, none)

    def shown(number: int):
        return lambda n: F.struct(
            n["path"].alias("path"),
            _node_type(n["value"], n["text"]).alias("data_type"),
            n["text"].alias("value"),
            F.lit(number).alias("level"),
        )

    def below(level: Column, number: int) -> Column:
        """A level's nodes and all below it; each level is built once."""
        own = F.transform(level, shown(number))
        if number == depth:
            return own
        return F.concat(own, let(F.flatten(F.transform(level, children)), lambda lower: below(lower, number + 1)))

    return let(F.try_parse_json(json), lambda cell: below(F.array(node(root, cell)), 0))


def get_by_path(json: Column, path: Sequence[str | int], dtype: str = "string") -> Column:
    """One nested value of a JSON cell; null if the path or the type does not fit."""
    steps = "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in path)
    return F.try_variant_get(F.try_parse_json(json), "$" + steps, dtype)


def set_by_path(col: Column, dtype: T.DataType, path: Sequence[str | int], value: Column) -> Column:
    """The same nested value with the element at ``path`` replaced."""
    if not path:
        return value
    step, rest = path[0], path[1:]
    if isinstance(dtype, T.StructType):
        return col.withField(step, set_by_path(col[step], dtype[step].dataType, rest, value))
    if isinstance(dtype, T.MapType):
        changed = set_by_path(F.try_element_at(col, F.lit(step)), dtype.valueType, rest, value)
        kept = F.map_filter(col, lambda k, _: k != F.lit(step))
        return F.map_concat(kept, F.create_map(F.lit(step), changed))
    if isinstance(dtype, T.ArrayType):
        return F.transform(
            col,
            lambda x, i: F.when(
                i == step, set_by_path(x, dtype.elementType, rest, value)
            ).otherwise(x),
        )
    raise TypeError(f"no nested value at {step!r} in {dtype.simpleString()}")


def wrap_list(col: Column) -> Column:
    return F.when(col.isNotNull(), F.array(col)).otherwise(F.slice(F.array(col), 1, 0))


def wrap_map(col: Column) -> Column:
    wrapped = F.create_map(F.lit("original_data"), col)
    return F.when(col.isNotNull(), wrapped).otherwise(F.map_filter(wrapped, lambda k, v: F.lit(False)))


def append_item(col: Column, value: Column) -> Column:
    return F.array_append(col, value)


def append_key(col: Column, key: str, value: Column) -> Column:
    kept = F.map_filter(col, lambda k, _: k != F.lit(key))
    return F.map_concat(kept, F.create_map(F.lit(key), value))


def display_value(col: Column, dtype: T.DataType, key: str = "key", delimiter: str = "/") -> Column:
    """Nested value as editable text."""
    if isinstance(dtype, T.StructType):
        return col[key].cast("string") if key in dtype.names else F.to_json(col)
    if isinstance(dtype, T.MapType):
        return F.coalesce(F.try_element_at(col, F.lit(key)).cast("string"), F.to_json(col))
    if isinstance(dtype, T.ArrayType):
        return F.array_join(col.cast("array<string>"), delimiter)
    return col.cast("string")


def from_display(text: Column, original: Column, dtype: T.DataType, key: str = "key", delimiter: str = "/") -> Column:
    """Edited text put back into the nested value."""
    if isinstance(dtype, T.StructType):
        return original.withField(key, text)
    if isinstance(dtype, T.MapType):
        return append_key(original, key, text)
    if isinstance(dtype, T.ArrayType):
        return F.split(text, "\\Q" + delimiter + "\\E")
    return text
