"""SQL fragments for the DuckDB side of the checks."""

from __future__ import annotations

from offerscope.sources.tables import offers_sql, raw_offers_sql

BASE = "Home Store"


def over_offers(body: str) -> str:
    return f"WITH offers AS MATERIALIZED (\n{offers_sql()}\n)\n{body}"


def over_raw(body: str) -> str:
    return f"WITH raw AS MATERIALIZED (\n{raw_offers_sql()}\n)\n{body}"


def norm(x: str) -> str:
    ascii_ = f"regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')"
    return f"lower(trim(regexp_replace({ascii_}, '\\s+', ' ', 'g')))"


def r2(x: str, scale: str = "100.0") -> str:
    return f"(floor(({x}) * CAST({scale} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({scale} AS DOUBLE))"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def num(x: str) -> str:
    """Strict numeric text to double, else null."""
    return (f"CASE WHEN regexp_full_match(trim({x}), '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
            f"THEN TRY_CAST(trim({x}) AS DOUBLE) END")


def cases(x: str, table: dict[str, object], default: str) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    arms = " ".join(f"WHEN {x} = {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {arms} ELSE {default} END"
