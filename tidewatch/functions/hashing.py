"""Identifiers and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in order and absent values left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def canonical(value: Column, kind: T.DataType) -> Column:
    """JSON text of a value of any type: keys of structs and maps in order at every level, absent values of both left out (in arrays
    they are null), whole doubles without a fraction. Variants keep the order of their keys, which is sorted already. Keys are
    ordered by their UTF-8 bytes. Null for a null value."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(_quoted(F.lit(f.name)), F.lit(":"), canonical(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name.encode())]
        body = F.array_join(F.array_compact(F.array(*parts)), ",") if parts else F.lit("")
        text = F.concat(F.lit("{"), body, F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_keys(F.map_filter(value, lambda k, v: v.isNotNull())))
        body = F.transform(entries, lambda k: F.concat(_quoted(k.cast("string")), F.lit(":"), canonical(value[k], kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: F.coalesce(canonical(x, kind.elementType), F.lit("null"))), ","), F.lit("]"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (value == F.floor(value)) & (F.abs(value) < 2.0**53)
        text = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit("null")).when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))
    elif isinstance(kind, T.VariantType):
        text = F.to_json(value)
    elif isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        text = value.cast("string")
    else:
        text = _quoted(value.cast("string"))
    return F.when(value.isNotNull(), text)


def canonical_row(df: DataFrame, *columns: str) -> Column:
    """Canonical JSON of these columns of df, by default all."""
    fields = [f for f in df.schema.fields if not columns or f.name in columns]
    return canonical(F.struct(*(F.col(f.name) for f in fields)), T.StructType(fields))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def event_id(event_type: Column, message: Column, room_id: Column, timestamp: Column, user_id: Column) -> Column:
    return F.left(sha256(canonical_json(eventType=event_type, message=message, roomId=room_id, timestamp=timestamp, userId=user_id)), F.lit(32))


def handle(user_id: Column, salt: str = "tidewatch") -> Column:
    """A short name to show instead of the user's id."""
    return F.upper(F.left(sha256(F.concat(F.lit(f"{salt}:"), user_id)), F.lit(6)))


def incident_id(user_id: Column, room_id: Column, start_ms: Column) -> Column:
    """The same for every run over the same events."""
    day = F.date_format(F.timestamp_millis(start_ms), "yyyyMMdd")
    return F.concat(F.lit("INC-"), day, F.lit("-"), F.left(sha256(F.concat_ws("|", user_id, room_id, start_ms.cast("string"))), F.lit(8)))
