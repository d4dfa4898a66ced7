"""Declarative data checks, evaluated together in as few passes as possible."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.operators.spread import HotKeys

REPORT_DDL = (
    "check_id STRING, model STRING, column_name STRING, kind STRING, failures BIGINT, status STRING"
)


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Check:
    """A property every row of a model must have.

    ``unique`` ignores NULL keys; ``accepted_values`` and ``expression`` let NULL pass, as a
    comparison with NULL is neither true nor false. An ``advisory`` check that finds rows is
    reported as a warning and never holds back a publish.
    """

    model: str
    column: str
    kind: str
    values: tuple[str, ...] = ()
    expression: str = ""
    advisory: bool = False
    name: str = ""

    @property
    def check_id(self) -> str:
        return self.name or f"{self.kind}_{self.model}_{self.column}"

    def fails(self) -> str:
        """SQL that is true for a failing row; ``unique`` looks across rows and has none."""
        if self.kind == "not_null":
            return f"{self.column} IS NULL"
        if self.kind == "accepted_values":
            return f"{self.column} NOT IN ({', '.join(map(quoted, self.values))})"
        return f"NOT ({self.expression})"


def unique(model: str, column: str) -> Check:
    return Check(model, column, "unique")


def not_null(model: str, *columns: str) -> list[Check]:
    return [Check(model, c, "not_null") for c in columns]


def accepted_values(model: str, column: str, values: Sequence[str]) -> Check:
    return Check(model, column, "accepted_values", values=tuple(values))


def not_negative(model: str, *columns: str) -> list[Check]:
    return [Check(model, c, "expression_is_true", expression=f"{c} >= 0") for c in columns]


def assertion(model: str, name: str, expression: str, advisory: bool = True) -> Check:
    """A singular check on whole rows."""
    return Check(model, "", "singular", expression=expression, advisory=advisory, name=name)


def _report_row(check: Check, failures: str) -> str:
    found = "warn" if check.advisory else "fail"
    return (
        f"struct({quoted(check.check_id)} AS check_id, {quoted(check.model)} AS model, "
        f"{quoted(check.column)} AS column_name, {quoted(check.kind)} AS kind, "
        f"CAST({failures} AS BIGINT) AS failures, "
        f"IF({failures} > 0, '{found}', 'pass') AS status)"
    )


def _counted(df: DataFrame, key: str | None, checks: Sequence[Check]) -> DataFrame:
    """One report row per check from one aggregation.

    With a ``key``, its repeated values are counted on the way: row-wise failures are added up
    per key first, so the grouping by key is the only shuffle there is.
    """
    # Written as SQL text: some fifty checks as Column calls take longer to put together than
    # small tables take to check.
    row_wise = [(f"f{i}", c) for i, c in enumerate(checks) if c.kind != "unique"]
    across = [(f"f{i}", c) for i, c in enumerate(checks) if c.kind == "unique"]
    counts = [F.expr(f"count_if({c.fails()}) AS {f}") for f, c in row_wise]
    if key is None:
        totals = df.agg(*counts)
    else:
        repeated = f"count_if(_rows > 1 AND {key} IS NOT NULL)"
        totals = (
            df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("_rows"), *counts)
            .agg(
                *[F.expr(f"coalesce(sum({f}), 0) AS {f}") for f, _ in row_wise],
                *[F.expr(f"{repeated} AS {f}") for f, _ in across],
            )
        )
    rows = ", ".join(_report_row(c, f) for f, c in row_wise + across)
    return totals.selectExpr(f"inline(array({rows}))")


def _narrow(df: DataFrame, key: str, checks: Sequence[Check]) -> DataFrame:
    """One report row per check, reading ``df`` once and moving little but the key.

    Every row becomes its key and, for each check it fails, the number of that check. Both are
    counted on every task first, so what moves is a row per key and one per task and failed check.
    """
    tagged = [f"IF({key} IS NOT NULL, struct(-1 AS tag, {key} AS key), NULL)"]
    row_wise = [c for c in checks if c.kind != "unique"]
    for i, c in enumerate(row_wise):
        tagged.append(f"IF({c.fails()}, struct({i} AS tag, IF(false, {key}, NULL) AS key), NULL)")
    counted = (
        df.selectExpr(f"inline(array_compact(array({', '.join(tagged)})))")
        .groupBy("tag", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counted.agg(
        F.expr("count_if(tag = -1 AND n > 1) AS repeated"),
        *[
            F.expr(f"coalesce(sum(n) FILTER (WHERE tag = {i}), 0) AS f{i}")
            for i in range(len(row_wise))
        ],
    )
    rows = [_report_row(c, f"f{i}") for i, c in enumerate(row_wise)]
    rows += [_report_row(c, "repeated") for c in checks if c.kind == "unique"]
    return totals.selectExpr(f"inline(array({', '.join(rows)}))")


def run_checks(
    df: DataFrame, checks: Sequence[Check], stored: bool = False, clustered: bool = True
) -> DataFrame:
    """The report of all ``checks`` on one relation.

    A computed relation is read once. Where its rows already lie by the key to be unique
    (``clustered``), row-wise failures are added up per key without a shuffle; elsewhere only the
    key moves. A ``stored`` relation is cheaper read again, each time only the columns in question:
    row-wise checks then need no shuffle either.
    """
    keys = list(dict.fromkeys(c.column for c in checks if c.kind == "unique"))
    row_wise = [c for c in checks if c.kind != "unique"]
    passes = [(k, [c for c in checks if c.kind == "unique" and c.column == k]) for k in keys]
    if row_wise and (stored or not passes):
        passes.append((None, row_wise))
    elif row_wise:
        passes[0] = (keys[0], passes[0][1] + row_wise)
    if passes and passes[0][0] and not stored and not clustered:
        parts = [_narrow(df, *passes[0])]
    else:
        parts = [_counted(df, *passes[0])]
    return reduce(DataFrame.unionAll, parts + [_counted(df, *p) for p in passes[1:]])


#: Rows that a task of ``duplicate_keys`` counts about.
ROWS_A_TASK = 500_000


def duplicate_keys(df: DataFrame, keys: Sequence[str], hot: HotKeys | None = None) -> DataFrame:
    """Key values held by more than one row, with the number of rows.

    With ``hot``, the frequent keys of a column in ``keys``, the rows are dealt over as many tasks as
    their number asks for, so that none holds more keys the larger the table. A frequent key is
    counted part by part first.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows, n = df.where(complete).select(*keys), F.count(F.lit(1))
    tasks = math.ceil(hot.rows / ROWS_A_TASK) if hot is not None else 1
    if tasks > 1 and hot:
        rows = rows.withColumn("_part", F.spark_partition_id())
        rows = rows.repartition(tasks, *keys, "_part").groupBy(*keys, "_part").agg(n.alias("_rows"))
        n = F.sum("_rows")
    if tasks > 1:
        rows = rows.repartition(tasks, *keys)
    return rows.groupBy(*keys).agg(n.alias("n_records")).where("n_records > 1")


def values_outside(df: DataFrame, accepted: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """(model, column_name, value, n_records): values that are not accepted, all in one pass.

    ``accepted`` holds a model's name, a column of ``df`` and its accepted values, each. Only values
    outside leave a row, and they are counted on every task first.
    """
    found = [
        f"IF({column} NOT IN ({', '.join(map(quoted, values))}), "
        f"struct({quoted(model)} AS model, {quoted(column)} AS column_name, {column} AS value), NULL)"
        for model, column, values in accepted
    ]
    return (
        df.selectExpr(f"inline(array_compact(array({', '.join(found)})))")
        .groupBy("model", "column_name", "value")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child key values without a parent row, with the number of child rows.

    Child rows are counted per key before they meet the parents, so a frequent key is one row.
    """
    held = (
        child.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key_value"))
        .agg(F.count(F.lit(1)).alias("child_rows"))
    )
    parents = parent.select(F.col(parent_key).alias("key_value"))
    return held.join(parents, "key_value", "left_anti")


def status_tally(report: DataFrame) -> DataFrame:
    """How many results are errors, failures and skips, and their sum."""
    counted = report.agg(
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.count_if(F.col("status") == "fail").alias("failure_count"),
        F.count_if(F.col("status") == "skipped").alias("skip_count"),
    )
    return counted.withColumn(
        "total_failures", F.expr("error_count + failure_count + skip_count")
    )
