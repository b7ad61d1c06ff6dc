"""Query registry: a name, a Spark callable, and the SQL that must agree with it."""

from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def rounded(df, digits: int = 6, skip=()):
    """Round every double column; minus zero becomes zero."""
    return df.select(*[
        (F.round(c, digits) + 0.0).alias(c) if t == "double" and c not in skip else F.col(c)
        for c, t in df.dtypes])


def r(expr: str, name: str, digits: int = 6) -> str:
    """The same rounding as SQL text."""
    return f"round({expr}, {digits}) + 0.0::double AS {name}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, n, digits) for n in names)
