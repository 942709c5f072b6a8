"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def wilson_sql(k: str, n: str, z: str = "1.96e0") -> tuple[str, str]:
    zz = f"({z} * {z})"
    p, den, centre = f"({k}::DOUBLE / {n})", f"(1 + {zz} / {n})", f"({k}::DOUBLE / {n} + {zz} / ({n} * 2.0e0))"
    half = f"(sqrt({p} * (1 - {p}) / {n} + {zz} / ({n}::DOUBLE * {n} * 4.0e0)) * {z})"
    return f"greatest(0.0e0, ({centre} - {half}) / {den})", f"least(1.0e0, ({centre} + {half}) / {den})"
