"""Registration of queries, and literal tables that both engines can read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkmill.session import spread, table

#: Tables whose rows are worth more time than moving them takes.
TEXTS = ("documents", "pages")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, tables) as a query; tables(name) reads a supplied table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, lambda t: spread(table(spark, sf_dir, t)) if t in TEXTS else table(spark, sf_dir, t))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


DUCK = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


class Literal:
    """A small table of given rows; schema as in "a string, b int"."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows
        self.columns = [c.split() for c in schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        values = ", ".join("(" + ", ".join(self._cell(v, kind.upper()) for v, (_, kind) in zip(row, self.columns)) + ")" for row in self.rows)
        names = ", ".join(n for n, _ in self.columns)
        return spark.sql(f"SELECT * FROM VALUES {values} AS {self.name}({names})")

    def sql(self) -> str:
        """A common table expression with the same rows for the other engine."""
        values = ", ".join("(" + ", ".join(self._cell(v, DUCK[kind], False) for v, (_, kind) in zip(row, self.columns)) + ")" for row in self.rows)
        names = ", ".join(n for n, _ in self.columns)
        return f"{self.name}({names}) AS (VALUES {values})"

    @staticmethod
    def _cell(value, kind: str, spark: bool = True) -> str:
        if isinstance(value, str):
            if spark:
                text = "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
            else:
                text = "'" + value.replace("'", "''") + "'"
        else:
            text = "NULL" if value is None else str(value).upper() if isinstance(value, bool) else repr(value)
        return f"CAST({text} AS {kind})"
