"""Scalar pieces of the query dialect, as SQL text."""

from __future__ import annotations

# Names of cast targets and the Spark types they mean.
CASTS = {"bool": "boolean", "boolean": "boolean", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "vchar": "string", "varchar": "string", "string": "string"}
WIDTH = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string")


def divide(a: str, b: str) -> str:
    """Always double, with infinities and NaN where the divisor is zero."""
    n, d = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return f"(CASE WHEN {d} <> 0 THEN {n} / {d} WHEN {d} IS NULL OR {n} IS NULL THEN NULL WHEN {n} = 0 OR isnan({n}) THEN double('NaN') WHEN {n} > 0 THEN double('Infinity') ELSE double('-Infinity') END)"


def remainder(a: str, b: str) -> str:
    return f"try_mod({a}, {b})"


def cast(e: str, of: str, to: str) -> str:
    """Narrowing keeps the low bits of whole numbers and ends at the bounds for others; text that is no number is NULL."""
    to = CASTS.get(to.lower())
    if to is None:
        raise ValueError("unknown type in a cast")
    if of == to:
        return e
    if to == "boolean" and of == "string":
        return f"(lower({e}) <> 'false')"
    if of == "string":
        return f"TRY_CAST({e} AS {to})"
    if to == "int" and of == "bigint":
        return f"CAST((({e} & 4294967295L) ^ 2147483648L) - 2147483648L AS INT)"
    if to in ("int", "bigint") and (of in ("float", "double") or of.startswith("decimal")):
        low, high = ("-2147483648", "2147483647") if to == "int" else ("-9223372036854775808", "9223372036854775807")
        d = f"CAST({e} AS DOUBLE)"
        return f"(CASE WHEN isnan({d}) THEN CAST(0 AS {to}) WHEN {d} >= {high}D THEN CAST({high} AS {to}) WHEN {d} <= {low}D THEN CAST({low} AS {to}) ELSE CAST({d} AS {to}) END)"
    return f"CAST({e} AS {to})"


def one(of: str) -> str:
    return "'1'" if of == "string" else f"CAST(1 AS {of})"
