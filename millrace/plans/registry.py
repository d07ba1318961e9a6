"""All registered queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated builder under ``name`` with its check SQL."""

    def add(builder: Query) -> Query:
        _FOUND[name] = (builder, sql)
        return builder

    return add


def same_sql(name: str, sql: str, *tables: str) -> None:
    """A query whose Spark SQL and check SQL are one text, with its tables in braces; no view is made in the session."""

    def run(spark, sf_dir):
        from millrace.session import table

        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})

    _FOUND[name] = (run, sql.format(**{t: t for t in tables}))


def _load() -> dict:
    from millrace.plans import analytic, extension, relational, scalar, streams, text  # noqa: F401  they register themselves

    return _FOUND


def queries() -> dict[str, Query]:
    return {name: builder for name, (builder, _) in sorted(_load().items())}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in sorted(_load().items()) if sql}
