"""Inputs written by hand, dealt to the rows of a table, beside the results that the formats' definitions ask for.

Row n of the table gets input n mod the number of inputs; the SQL joins the expected results to the rows in the
same way, so it states what is right without restating how the library finds it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesift.plans.pages import read
from pagesift.sources.scratch import dealt_out


def dealt(spark, sf_dir: str, inputs: Sequence, table: str = "customer", key: str = "c_custkey", names: Sequence[str] = ("h",)) -> DataFrame:
    """(id, names): an input is a value, or a tuple of as many as there are names."""
    rows = [x if isinstance(x, tuple) else (x,) for x in inputs]
    cells = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])
    keyed = dealt_out(read(spark, sf_dir, table).select(F.col(key).alias("id")), "id")
    return keyed.withColumn("x", F.get(cells, F.pmod(F.col("id"), F.lit(len(rows))).cast("int"))).select("id", "x.*")


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def expected(columns: str, rows: Sequence[tuple], table: str = "customer", key: str = "c_custkey") -> str:
    """SQL for (id, columns); ``columns`` are names with types, one row for each input. A list of rows for an input unfolds it."""
    typed = [c.strip().split(" ", 1) for c in columns.split(",")]
    listed = [(k, *r) for k, of in enumerate(rows) for r in (of if isinstance(of, list) else [of])]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in listed)
    casts = ", ".join(f'CAST(v."{n}" AS {t}) AS "{n}"' for n, t in typed)
    names = ", ".join(f'"{n}"' for n, _ in typed)
    return f"SELECT {key} AS id, {casts} FROM {table} JOIN (VALUES {values}) v(__input, {names}) ON {key} % {len(rows)} = v.__input"


class Cases:
    """Registers queries over dealt inputs with their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, columns: str, cases: Sequence[tuple], make: Callable[[DataFrame], DataFrame], table: str = "customer", key: str = "c_custkey", names: Sequence[str] = ("h",)) -> None:
        """``cases`` are (input, expected row or list of rows); ``make`` gets (id, names) and gives id and the columns."""
        inputs, rows = [c[0] for c in cases], [c[1] for c in cases]
        wanted = [c.strip().split(" ", 1)[0] for c in columns.split(",")]
        self.queries[name] = lambda spark, sf_dir: make(dealt(spark, sf_dir, inputs, table, key, names)).select("id", *wanted)
        self.sql[name] = expected(columns, rows, table, key)
