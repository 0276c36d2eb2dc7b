"""Stable hashes for ids, ranks and choices; equal to what hashlib gives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import plain_path


def _joined(parts: tuple[Column, ...]) -> Column:
    return F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def hash_id(*parts: Column, digits: int = 16) -> Column:
    """The first hex digits of the SHA-256 of the parts, joined by line ends; null counts as empty."""
    return F.substring(F.sha2(_joined(parts), 256), 1, digits)


def short_id(prefix: str, *parts: Column, digits: int = 12) -> Column:
    """prefix and the first hex digits of the SHA-1 of the parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(_joined(parts)), 1, digits))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits: 52 bits, exact in a double."""
    return F.conv(hash_id(*parts, digits=13), 16, 10).cast("double") / float(1 << 52)


def hash_choice(options: list[str], *parts: Column) -> Column:
    """One of the options, the same for equal parts, evenly spread."""
    at = (hash_unit(*parts) * len(options)).cast("int")
    return F.element_at(F.array(*map(F.lit, options)), at + 1)


def hash_unit_64(*parts: Column) -> Column:
    """A number in [0, 1) from the first 16 hex digits: 64 bits, rounded to a double."""
    return F.conv(hash_id(*parts, digits=16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def hash_int63(*parts: Column) -> Column:
    """A whole number from 0 to 2^63 - 1 from the last 63 of the first 64 bits."""
    return F.conv(hash_id(*parts, digits=16), 16, -10).cast("long").bitwiseAND(F.lit((1 << 63) - 1))


def python_json(c: Column, sort_keys: bool = False, blanks: bool = True, ascii_only: bool = False) -> Column:
    """A value as Python's json writes it, structure and all: null, true, numbers in their shortest form, NaN, texts, lists and records.

    Structs and maps become objects, in the order of their fields, or sorted by name; bytes become the text that they encode; what JSON
    has no form for becomes a text. blanks: behind commas and colons. Python's form of doubles is another than the JVM's.
    """
    import json

    form = {"sort_keys": sort_keys, "ensure_ascii": ascii_only, "separators": None if blanks else (",", ":")}

    def plain(value, kind: pa.DataType):
        if value is None or isinstance(value, (bool, int, float, str)):
            return value
        if isinstance(value, bytes):
            return value.decode("utf-8", errors="replace")
        if pa.types.is_map(kind):
            return {str(k): plain(v, kind.item_type) for k, v in value}
        if pa.types.is_struct(kind):
            return {f.name: plain(value[f.name], f.type) for f in kind}
        if pa.types.is_list(kind) or pa.types.is_large_list(kind):
            return [plain(v, kind.value_type) for v in value]
        return int(value) if pa.types.is_decimal(kind) and kind.scale == 0 else str(value)

    @F.arrow_udf(T.StringType())
    def shown(values: pa.Array) -> pa.Array:
        return pa.array([json.dumps(plain(v, values.type), **form) for v in values.to_pylist()], pa.string())

    return shown(c)


def json_loaded(c: Column) -> Column:
    """A VARIANT from text that python_json() wrote: null for null and empty text, and a text that isn't JSON as it is."""
    return F.when(c != "", F.coalesce(F.try_parse_json(c), c.cast("variant")))


def json_loaded_as(c: Column, kind: str) -> Column:
    """The value of the type `kind` from text that python_json() wrote, NaN and infinities included; null where the text has another form."""
    held = F.from_json(F.concat(F.lit('{"x": '), c, F.lit("}")), f"struct<x: {kind}>", {"allowNonNumericNumbers": "true", "mode": "PERMISSIVE"})
    return held["x"]


def stable_hash(texts: Sequence[str | Column], others: Mapping[int, Column] | None = None, digits: int = 24) -> Column:
    """The first hex digits of the SHA-256 of the parts, joined by line ends: texts as they are, others as JSON with sorted keys.

    others: values that aren't texts, by their place among the parts; null is one of them.
    """
    parts = [F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit("null")) for t in texts]
    for at, value in sorted((others or {}).items()):
        parts.insert(at, python_json(value, sort_keys=True))
    return F.substring(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), 1, digits)


def progress_key(name: Column, model: Column, folder: Column) -> Column:
    """A run's name, :: and 12 digits that tell apart its name, model and output folder, as compact JSON in ASCII."""
    identity = F.struct(name.alias("run_name"), model.alias("model_identity"), plain_path(folder).alias("output_root"))
    shown = python_json(identity, sort_keys=True, blanks=False, ascii_only=True)
    return F.concat(name, F.lit("::"), F.substring(F.sha2(shown.cast("binary"), 256), 1, 12))
