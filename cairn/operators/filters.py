"""The five predicates, over typed columns or over JSON text.

Types never mix: a number compares with numbers and a string with strings; any other
pairing is false, as is a field that isn't there.  Field names are literal, dots too.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_number(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


class TypedFields:
    """Fields are columns; null stands for both null and missing."""

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def exists(self, name: str) -> Column:
        return F.col(quoted(name)).isNotNull() if name in self.types else F.lit(False)

    def equals(self, name: str, value: Any) -> Column:
        if name not in self.types:
            return F.lit(False)
        column = F.col(quoted(name))
        if value is None:
            return column.isNull()
        return column == F.lit(value) if self._comparable(name, value) else F.lit(False)

    def among(self, name: str, values: tuple) -> Column:
        """One membership test, which the scan can use, of the values that fit the type."""
        fitting = [v for v in values if v is not None and name in self.types and self._comparable(name, v)]
        found = F.col(quoted(name)).isin(*fitting) if fitting else F.lit(False)
        return found | self.equals(name, None) if None in values else found

    def _comparable(self, name: str, value: Any) -> bool:
        kind = self.types[name]
        fits = (
            (isinstance(value, bool) and isinstance(kind, T.BooleanType))
            or (isinstance(value, int) and not isinstance(value, bool) and isinstance(kind, T.IntegralType))
            or (isinstance(value, float) and isinstance(kind, (T.FractionalType, T.DecimalType)))
            or (isinstance(value, str) and isinstance(kind, T.StringType))
        )
        other = not isinstance(value, (bool, int, float, str)) and isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BinaryType))
        return fits or other

    def ordered(self, name: str, value: Any, above: bool) -> Column:
        kind = self.types.get(name)
        fits = (is_number(value) and isinstance(kind, T.NumericType)) or (isinstance(value, str) and isinstance(kind, T.StringType))
        if not fits:
            return F.lit(False)
        column = F.col(quoted(name))
        return column > F.lit(value) if above else column < F.lit(value)

    def sort_keys(self, name: str) -> list[Column]:
        return [F.col(quoted(name))] if name in self.types else []

    def text(self, name: str) -> Column:
        """JSON-like text of a field, null where it is missing."""
        return F.col(quoted(name)).cast("string") if name in self.types else F.lit(None).cast("string")


class JsonFields:
    """Fields are top-level members of a JSON text column."""

    def __init__(self, column: str = "doc"):
        self.column = column

    def _value(self, name: str) -> Column:
        path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
        return F.try_variant_get(F.try_parse_json(F.col(self.column)), path, "variant")

    def _as(self, name: str, kind: str) -> Column:
        return F.try_variant_get(self._value(name), "$", kind)

    def _tag(self, name: str) -> Column:
        return F.schema_of_variant(self._value(name))

    def exists(self, name: str) -> Column:
        return F.coalesce(F.array_contains(F.json_object_keys(F.col(self.column)), name), F.lit(False))

    def equals(self, name: str, value: Any) -> Column:
        tag = self._tag(name)
        if value is None:
            return self.exists(name) & F.coalesce(tag == "VOID", F.lit(True))
        if isinstance(value, bool):
            return (tag == "BOOLEAN") & (self._as(name, "boolean") == F.lit(value))
        if isinstance(value, int):
            return (tag == "BIGINT") & (self._as(name, "bigint") == F.lit(value))
        if isinstance(value, float):
            return (tag.startswith("DECIMAL") | (tag == "DOUBLE")) & (self._as(name, "double") == F.lit(value))
        if isinstance(value, str):
            return (tag == "STRING") & (self._as(name, "string") == F.lit(value))
        want = F.to_json(F.parse_json(F.lit(json.dumps(value))))
        return (tag.startswith("ARRAY") | tag.startswith("OBJECT")) & (F.to_json(self._value(name)) == want)

    def among(self, name: str, values: tuple) -> Column:
        found = F.lit(False)
        for value in values:
            found = found | F.coalesce(self.equals(name, value), F.lit(False))
        return found

    def ordered(self, name: str, value: Any, above: bool) -> Column:
        tag = self._tag(name)
        if is_number(value):
            fits, column, value = (tag == "BIGINT") | (tag == "DOUBLE") | tag.startswith("DECIMAL"), self._as(name, "double"), float(value)
        elif isinstance(value, str):
            fits, column = tag == "STRING", self._as(name, "string")
        else:
            return F.lit(False)
        return fits & (column > F.lit(value) if above else column < F.lit(value))

    def sort_keys(self, name: str) -> list[Column]:
        tag = self._tag(name)
        number = F.when((tag == "BIGINT") | (tag == "DOUBLE") | tag.startswith("DECIMAL"), self._as(name, "double"))
        return [number, F.when(tag == "STRING", self._as(name, "string"))]

    def text(self, name: str) -> Column:
        """JSON text; a string without its quotes, null as 'null', missing as null."""
        tag = self._tag(name)
        shown = F.when(tag == "STRING", self._as(name, "string")).otherwise(F.to_json(self._value(name)))
        return F.when(self.exists(name), F.coalesce(F.get_json_object(F.col(self.column), "$['" + name + "']"), shown, F.lit("null")))


@dataclass(frozen=True)
class Eq:
    field: str
    value: Any

    def column(self, fields) -> Column:
        return fields.equals(self.field, self.value)


@dataclass(frozen=True)
class Gt:
    field: str
    value: Any

    def column(self, fields) -> Column:
        return fields.ordered(self.field, self.value, True)


@dataclass(frozen=True)
class Lt:
    field: str
    value: Any

    def column(self, fields) -> Column:
        return fields.ordered(self.field, self.value, False)


@dataclass(frozen=True)
class In:
    field: str
    values: tuple

    def column(self, fields) -> Column:
        return fields.among(self.field, self.values)


@dataclass(frozen=True)
class Exists:
    field: str

    def column(self, fields) -> Column:
        return fields.exists(self.field)


def forced_match(df: DataFrame, fields, field: str, value: Any) -> DataFrame:
    """Rows whose field has the same text, whatever the case; missing never matches."""
    text = value if isinstance(value, str) else json.dumps(value)
    return df.where(F.lower(fields.text(field)) == F.lower(F.lit(text)))
