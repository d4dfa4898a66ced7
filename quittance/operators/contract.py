"""Contract enforcement: schema, constraints and per-row validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.schemas import MART_V1, Contract

BREACH = "contract breach in"


class ContractDrift(ValueError):
    """The columns or types of a build differ from its contract."""


def schema_drift(df: DataFrame, contract: Contract) -> list[str]:
    """Differences between the columns of ``df`` and the contract, in words."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    declared = contract.types
    return (
        [f"{c} is missing" for c in declared if c not in actual]
        + [f"{c} is not in the contract" for c in actual if c not in declared]
        + [
            f"{c} is {actual[c]}, declared {t}"
            for c, t in declared.items()
            if c in actual and actual[c] != t
        ]
    )


def schema_report(df: DataFrame, contract: Contract) -> DataFrame:
    """Each contract column with its actual type, how often it is NULL, and a status."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    nulls = [
        f"count_if({c.name} IS NULL) AS {c.name}"
        if c.name in actual
        else f"CAST(NULL AS BIGINT) AS {c.name}"
        for c in contract.columns
    ]
    rows = []
    for c in contract.columns:
        found = f"'{actual[c.name]}'" if c.name in actual else "CAST(NULL AS STRING)"
        status = f"IF({c.required} AND {c.name} > 0, 'nulls', 'ok')"
        if actual.get(c.name) != c.data_type:
            status = "'drift'"
        rows.append(
            f"struct('{c.name}' AS column_name, '{c.data_type}' AS declared_type, "
            f"{found} AS actual_type, {c.required} AS is_required, {c.name} AS null_rows, "
            f"{status} AS status)"
        )
    return df.agg(*map(F.expr, nulls)).selectExpr(f"inline(array({', '.join(rows)}))")


def _constraints(contract: Contract) -> list[tuple[str, str, str]]:
    """(column, kind, SQL that is true when breached) per constraint; NULL passes a check."""
    found = []
    for c in contract.columns:
        if c.required:
            found.append((c.name, "not_null", f"{c.name} IS NULL"))
        if c.check:
            found.append((c.name, "check", f"coalesce(NOT ({c.check}), false)"))
    return found


def constraint_report(df: DataFrame, contract: Contract) -> DataFrame:
    """Breaches per constraint, all counted in one pass."""
    constraints = _constraints(contract)
    counts = [F.expr(f"count_if({bad}) AS {kind}_{name}") for name, kind, bad in constraints]
    rows = ", ".join(
        f"struct('{name}' AS column_name, '{kind}' AS constraint_kind, "
        f"{kind}_{name} AS breaches)"
        for name, kind, _ in constraints
    )
    return df.agg(*counts).selectExpr(f"inline(array({rows}))")


# Rules below are pairs of a code and the SQL that is true for a row breaking the rule.


def _any(rules: list[tuple[str, str]]) -> str:
    return " OR ".join(f"({bad})" for _, bad in rules)


def _codes(rules: list[tuple[str, str]]) -> str:
    each = ", ".join(f"IF({bad}, '{code}', NULL)" for code, bad in rules)
    return f"concat_ws(',', {each})"


def _failing(df: DataFrame, rules: list[tuple[str, str]], what: str) -> DataFrame:
    """``df`` unchanged, but reading a row that breaks a rule fails the job."""
    first = df.columns[0]
    complain = f"raise_error(concat('{what}: ', {_codes(rules)}))"
    return df.withColumn(first, F.expr(f"IF({_any(rules)}, {complain}, {first})"))


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` in contract order; any drift raises now, any breach fails the job that writes it.

    The constraints ride along with the write, so they cost no pass of their own.
    """
    drift = schema_drift(df, contract)
    if drift:
        raise ContractDrift("; ".join(drift))
    rules = [(f"{name}:{kind}", bad) for name, kind, bad in _constraints(contract)]
    rows = df.select(*contract.names)
    return _failing(rows, rules, f"{BREACH} {contract.dataset}") if rules else rows


def breaches(df: DataFrame, contract: Contract) -> bool:
    """Whether a constraint does not hold on ``df``."""
    return not constraint_report(df, contract).where("breaches > 0").isEmpty()


def _row_rules(contract: Contract) -> list[tuple[str, str]]:
    rules = [(f"{c}:missing", f"{c} IS NULL") for c in contract.row_required]
    for c in contract.row_not_negative:
        # NaN is no number >= 0, though Spark orders it above every number.
        below = f"coalesce({c} < 0 OR isnan(CAST({c} AS DOUBLE)), false)"
        rules.append((f"{c}:negative", below))
    for c, values in contract.row_allowed:
        allowed = ", ".join(f"'{v}'" for v in values)
        rules.append((f"{c}:not_allowed", f"coalesce({c} NOT IN ({allowed}), false)"))
    return rules


def valid_rows(df: DataFrame, contract: Contract = MART_V1) -> DataFrame:
    rules = _row_rules(contract)
    return df.where(f"NOT ({_any(rules)})") if rules else df


def rejected_rows(df: DataFrame, contract: Contract = MART_V1) -> DataFrame:
    """Rows breaking the row contract, with the codes of the broken rules."""
    rules = _row_rules(contract) or [("", "false")]
    return df.where(_any(rules)).withColumn("violations", F.expr(_codes(rules)))


def require_valid(df: DataFrame, contract: Contract = MART_V1) -> DataFrame:
    """``df`` unchanged; one bad row fails the whole read."""
    rules = _row_rules(contract)
    return _failing(df, rules, f"{BREACH} the row contract") if rules else df
