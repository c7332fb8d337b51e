"""Canonical JSON of columns, and the content hashes made of it.

Keys sorted, no white space, everything outside ASCII escaped, numbers as the shortest text that reads back: equal values give
equal bytes whatever wrote them, so a hash of them names the content."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that JSON writes with a letter.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _number(value: Column) -> Column:
    """A double as the shortest text that reads back, as JSON writes it."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else json.dumps(x) for x in column.to_pylist()], pa.string())

    return run(value)


def _string(text: Column) -> Column:
    """A JSON string. Only texts with characters to escape are walked through."""

    def one(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(c == '"', SHORT['"'])
        for k, v in list(SHORT.items())[1:]:
            out = out.when(c == k, v)
        unit = lambda x: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(x), 4, "0")))
        high, low = F.shiftright(code - 0x10000, 10) + 0xD800, (code - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00
        return out.when((code >= 32) & (code < 127), c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    escaped = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r'[^\x20-\x7e]|["\\]'), escaped).otherwise(text), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType, leave_out: frozenset[str] = frozenset(), path: str = "") -> Column:
    """A column's canonical JSON; null is ``null``. leave_out: dotted paths of struct fields that are no content.

    Structs and maps of string keys are objects, arrays keep their order. Dates, timestamps and decimals are their text."""
    if isinstance(kind, T.StructType):
        fields = sorted((f for f in kind.fields if f"{path}{f.name}" not in leave_out), key=lambda f: f.name)
        parts = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical_json(value[f.name], f.dataType, leave_out, f"{path}{f.name}.")) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_string(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.BooleanType) or isinstance(kind, T.IntegralType):
        out = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _number(value.cast("double"))
    else:
        out = _string(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(out)


def with_content_hash(rows: DataFrame, column: str, leave_out: list[str] | None = None, name: str = "content_hash") -> DataFrame:
    """``rows`` with the sha256 of a struct column's canonical JSON, fields in ``leave_out`` (dotted paths) aside.

    A double inside an array or map is refused: only columns and fields of structs have their shortest text here."""
    kind = rows.schema[column].dataType
    _refuse_nested_doubles(kind, False)
    return rows.withColumn(name, F.sha2(canonical_json(F.col(column), kind, frozenset(leave_out or [])), 256))


def _refuse_nested_doubles(kind: T.DataType, inside: bool) -> None:
    if inside and isinstance(kind, (T.DoubleType, T.FloatType)):
        raise ValueError("doubles inside arrays or maps have no canonical text here: cast them to decimal or string")
    for child in ([f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else []):
        _refuse_nested_doubles(child, inside)
    for child in ([kind.elementType] if isinstance(kind, T.ArrayType) else [kind.valueType] if isinstance(kind, T.MapType) else []):
        _refuse_nested_doubles(child, True)


def run_id(dataset: Column, processing: Column, spec: Column, workflow: Column) -> Column:
    """The identity of one run: of a dataset's, a processing's and a spec's content hash and a workflow version."""
    return F.sha2(F.concat(dataset, F.lit("|proc="), processing, F.lit("|spec="), spec, F.lit("|wf="), workflow), 256)
