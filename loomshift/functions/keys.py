"""Typed keys: keyset predicates, and keys as text."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyset_after(keys: list[str], last: list, types: list[str] | None = None) -> Column:
    """Rows after the key ``last`` in key order; the leading bound lets scans prune by the first key."""
    values = [F.lit(v) if types is None else F.lit(v).cast(types[k]) for k, v in enumerate(last)]
    steps = [reduce(lambda a, b: a & b, [F.col(keys[m]) == values[m] for m in range(k)] + [F.col(keys[k]) > values[k]]) for k in range(len(keys))]
    chain = reduce(lambda a, b: a | b, steps)
    return chain if len(keys) == 1 else (F.col(keys[0]) >= values[0]) & chain


def key_json(keys: list[str]) -> Column:
    """The key of a row as {"__k0": ...}."""
    return F.to_json(F.struct(*(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys))))


class KeyFault(ValueError):
    """code: bad_key, key_type, key_null or key_missing."""

    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


#: Types that can be keys, and the Spark types that hold them.
KEY_TYPES = {"tinyint": "smallint", "smallint": "smallint", "int": "int", "bigint": "bigint", "decimal": "decimal", "numeric": "decimal", "money": "decimal(19,4)", "smallmoney": "decimal(10,4)", "float": "double", "real": "float", "bit": "boolean", "char": "string", "varchar": "string", "nchar": "string", "nvarchar": "string", "date": "date", "datetime2": "timestamp_ntz", "datetime": "timestamp_ntz", "smalldatetime": "timestamp_ntz", "uniqueidentifier": "string", "binary": "binary", "varbinary": "binary", "time": "string", "datetimeoffset": "string"}


def encode_key(parts: list[dict]) -> str:
    """Parts {t, s, p, c, v}: type, size, precision, scale and value as invariant text."""
    for part in parts:
        if part.get("t") not in KEY_TYPES:
            raise KeyFault("key_type", f"{part.get('t')} cannot be a key")
        if part.get("v") is None:
            raise KeyFault("key_null", "a key value is null")
    return json.dumps([{k: part[k] for k in ("t", "s", "p", "c", "v") if part.get(k) is not None} for part in parts], separators=(",", ":"))


def decode_key(text: str, expected: int | None = None) -> list[dict]:
    try:
        parts = json.loads(text)
    except ValueError as bad:
        raise KeyFault("bad_key", "the key is not JSON") from bad
    if not isinstance(parts, list) or not all(isinstance(p, dict) and "t" in p for p in parts):
        raise KeyFault("bad_key", "the key is no list of typed values")
    if expected is not None and len(parts) != expected:
        raise KeyFault("key_missing", f"{expected} key values are wanted, {len(parts)} are there")
    encode_key(parts)
    return parts
