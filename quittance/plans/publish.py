"""Gated publish: write a build, audit what was written, then point readers at it.

Layout under one root folder:

    <root>/<schema>/<build>/<model>         the tables of a build (schemas dev, prod_blue, prod_green)
    <root>/<schema>/<build>/check_results   what its audit found
    <root>/<schema>/<build>/_complete       what the build holds, written last
    <root>/<schema>/<build>/_lease          renewed while the build runs
    <root>/public/deployments               the log of deployments (``deployments.py``)

Every build has a folder of its own, which nothing writes to again: whoever reads a build keeps
its files, and rows that the gate refused stand where no reader looks. A build that was killed has
no ``_complete`` and is never taken for the newest. A deployment becomes live by one file that
appears in the log; the views of SQL users move with it, but only those that belong to this
warehouse. Old builds go when ``prune`` is called.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quittance.operators.checks import REPORT_DDL, Check, run_checks, status_tally
from quittance.operators.contract import ContractDrift, breaches, enforce
from quittance.operators.spread import HotKeys, find_hot_keys
from quittance.plans import quality
from quittance.plans.deployments import DeploymentLog
from quittance.plans.marts import int_invoice_totals, mart_invoice_ledger
from quittance.plans.quality import LEDGER_MODELS, STAGING_MODELS, checks_of, declared_checks
from quittance.plans.staging import stage
from quittance.schemas import CONTRACTS, LATEST_VERSION, Contract
from quittance.session import shuffle_width
from quittance.sources import files
from quittance.sources.csv_files import read_clustered, store_clustered, store_table

# The build targets and the schema each writes to.
TARGETS = {"dev": "dev", "blue": "prod_blue", "green": "prod_green"}
PUBLISHED_TARGETS = ("blue", "green")
#: The table property that tells which warehouse a view belongs to.
OWNER = "quittance.root"
#: Seconds after which a build that shows no sign of life may be deleted.
LEASE = 24 * 3600
#: Lines that a bucket of a stored table holds before there are more buckets.
BUCKET_ROWS = 2_000_000


class ForeignView(ValueError):
    """A view of that name belongs to another warehouse, or to none."""


@dataclass(frozen=True)
class Warehouse:
    """A root folder and the contract versions that its builds are written in."""

    spark: SparkSession
    root: str
    contracts: Mapping[str, Contract] = field(default_factory=lambda: CONTRACTS)
    #: The database of the views over the live build; warehouses that share a catalog need their own.
    public: str = "public"

    @property
    def log(self) -> DeploymentLog:
        return DeploymentLog(self.spark, self.path("public", "deployments"))

    def path(self, schema: str, *names: str) -> str:
        return "/".join([self.root.rstrip("/"), schema, *names])

    def builds(self, schema: str) -> list[str]:
        """The names of a slot's builds, oldest first."""
        return [n for n in files.names_in(self.spark, self.path(schema)) if n.startswith("build-")]

    def new_build(self, schema: str) -> Build:
        """A build that nothing has been written to; no other one has its name."""
        last = self.builds(schema)[-1:] or ["build-0-"]
        number = int(last[0].split("-")[1]) + 1
        return Build(self, schema, f"build-{number:09d}-{uuid.uuid4().hex[:8]}")

    def last_build(self, schema: str, *tables: str) -> Build:
        """The newest complete build of a slot that has all the given tables."""
        for name in reversed(self.builds(schema)):
            build = Build(self, schema, name)
            if (held := build.catalogue()) is not None and held.keys() >= set(tables):
                return build
        raise LookupError(f"{schema} has no complete build" + (f" with {', '.join(tables)}" if tables else ""))

    def table(self, schema: str, table: str) -> DataFrame:
        """A table of the newest build of a slot."""
        return self.last_build(schema, table).table(table)


@dataclass(frozen=True)
class Build:
    """The tables of one run, written once."""

    wh: Warehouse
    schema: str
    name: str
    # Of the tables stored so far: their schemas, and key and number of buckets where they have some.
    schemas: dict[str, str] = field(default_factory=dict, compare=False)
    layouts: dict[str, list] = field(default_factory=dict, compare=False)

    def path(self, table: str) -> str:
        return self.wh.path(self.schema, self.name, table)

    def table(self, table: str) -> DataFrame:
        layout = self.layouts.get(table)
        if layout is None and table not in self.schemas:  # stored by another driver, or earlier
            layout = (self.catalogue() or {}).get(table, {}).get("clustered")
        if layout is None:
            return self.wh.spark.read.parquet(self.path(table))
        return read_clustered(self.wh.spark, self.path(table), *layout)

    def store(
        self, df: DataFrame, table: str, key: str | None = None, buckets: int = 0
    ) -> DataFrame:
        """Write a table, with a ``key`` so that its rows lie by it."""
        self.renew()
        if key is None:
            stored = store_table(df, self.path(table))
        else:
            stored = store_clustered(df, self.path(table), key, buckets)
            self.layouts[table] = [key, buckets]
        self.schemas[table] = hashlib.sha256(stored.schema.json().encode()).hexdigest()
        self.renew()
        return stored

    def renew(self) -> None:
        """Show that this build is alive, which keeps it from ``prune``."""
        files.replace_text(self.wh.spark, self.path("_lease"), "")

    def finish(self) -> None:
        """Declare the build complete: every table with its files, bytes and schema."""
        spark, held = self.wh.spark, {}
        for table, schema in self.schemas.items():
            count, size = files.size(spark, self.path(table))
            held[table] = {"files": count, "bytes": size, "schema_sha256": schema}
            if table in self.layouts:
                held[table]["clustered"] = self.layouts[table]
        files.put_once(spark, self.path("_complete"), json.dumps(held, indent=1))

    def catalogue(self) -> dict[str, dict] | None:
        """What the build holds, by table; None while it is not complete."""
        text = files.read_text(self.wh.spark, self.path("_complete"))
        return None if text is None else json.loads(text)


@dataclass(frozen=True)
class BuildResult:
    target: str
    results: tuple[Row, ...]
    published: bool


# -- deployment state ---------------------------------------------------------------------


def deployments(wh: Warehouse) -> DataFrame:
    """All deployments so far; no rows before the first."""
    return wh.log.all()


def latest_deployment(wh: Warehouse) -> DataFrame:
    """The live deployment, the last one published: one row, or none before the first."""
    return wh.log.newest()


def deployment_state(wh: Warehouse) -> DataFrame:
    return latest_deployment(wh).select("active_schema", "deployed_at")


def next_slot(state: DataFrame) -> DataFrame:
    """The target to build next: green while blue is live, blue in every other case."""
    return state.agg(F.max("active_schema").alias("active_schema")).withColumn(
        "next_target", F.when(F.col("active_schema") == "prod_blue", "green").otherwise("blue")
    )


def deployment_status(wh: Warehouse) -> DataFrame:
    """One row with the live schema and its time.

    The schema is 'unknown' when nothing is deployed, and when the state cannot be read.
    """
    try:
        row = deployment_state(wh).withColumn("deployed_at", F.col("deployed_at").cast("string")).first()
    except (PySparkException, Py4JJavaError, ValueError, TypeError):
        row = None
    schema, deployed_at = tuple(row) if row else ("unknown", None)
    ddl = "status STRING, active_schema STRING, deployed_at STRING"
    return wh.spark.createDataFrame([("healthy", schema, deployed_at)], ddl)


def live_build(wh: Warehouse) -> Build | None:
    found = wh.log.latest()
    return Build(wh, found.active_schema, found.build) if found else None


def _must_be_live(wh: Warehouse) -> Build:
    build = live_build(wh)
    if build is None:
        raise LookupError("nothing has been published yet")
    return build


# -- gate ---------------------------------------------------------------------------------


def publish_gate(results: DataFrame, target: str, expected: Sequence[Check]) -> DataFrame:
    """One row telling whether ``target`` may go live.

    It may when it is a published target, every expected check has a result, and no result is
    an error, a failure or a skip.
    """
    ids = [c.check_id for c in expected]
    wanted = F.array(*map(F.lit, ids))
    seen = results.agg(
        F.collect_set(F.when(F.col("check_id").isin(ids), F.col("check_id"))).alias("ids"),
        F.count_if(F.col("status").isin("error", "fail", "skipped")).alias("total_failures"),
    )
    return seen.select(
        F.lit(target).alias("target"),
        "total_failures",
        F.size(F.array_except(wanted, "ids")).cast("bigint").alias("missing_checks"),
    ).withColumn(
        "publish",
        F.lit(target in PUBLISHED_TARGETS)
        & (F.col("total_failures") == 0)
        & (F.col("missing_checks") == 0),
    )


# -- build --------------------------------------------------------------------------------


def _model(name: str, status: str) -> Row:
    return Row(
        check_id=name, model=name, column_name="", kind="model", failures=0, status=status
    )


def _skipped(checks: Sequence[Check]) -> list[Row]:
    return [
        Row(
            check_id=c.check_id,
            model=c.model,
            column_name=c.column,
            kind=c.kind,
            failures=0,
            status="skipped",
        )
        for c in checks
    ]


def _failed(results: Sequence[Row]) -> bool:
    return any(r["status"] in ("error", "fail") for r in results)


def _audit(*relations: tuple[DataFrame, Sequence[Check]], stored: bool = True) -> list[Row]:
    """The results of all checks, in one job; one row per check, however large the data."""
    reports = [run_checks(df, checks, stored) for df, checks in relations if checks]
    return reduce(DataFrame.unionAll, reports).collect() if reports else []


def _buckets(spark: SparkSession, rows: int) -> int:
    """How many buckets staging tables get whose lines number ``rows`` (0: nobody has counted).

    A divisor of the width of a shuffle: what lay in one of its partitions is then of one bucket,
    so that every task writes one file. Large tables get that width itself.
    """
    width = shuffle_width(spark)
    wanted = width if not rows else max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))
    return next(n for n in range(1, width + 1) if width % n == 0 and n >= min(wanted, width))


def _store_staging(
    build: Build, raw: dict[str, DataFrame], hot_invoices: HotKeys | None
) -> dict[str, DataFrame]:
    """Write the staging tables, as independent jobs side by side.

    Their audit and the ledger both read them, and a lost executor costs no recomputation of
    the deduplication.
    """
    if hot_invoices is None:
        hot_invoices = find_hot_keys(raw["invoice_line_items"], "invoice_id")
    staged = stage(raw, hot_invoices)
    # Lines of a hot invoice must not end up in one bucket; the other two have a row per key.
    keys = {"stg_invoices": "invoice_id", "stg_customers": "customer_id"}
    if not hot_invoices:
        keys["stg_invoice_line_items"] = "invoice_id"
    buckets = _buckets(build.wh.spark, hot_invoices.rows)

    def store(model: str) -> DataFrame:
        return build.store(staged[model], model, keys.get(model), buckets)

    # The jobs keep the caller's job group and scheduler pool.
    with ThreadPoolExecutor(len(staged)) as jobs:
        return dict(zip(staged, jobs.map(inheritable_thread_target(build.wh.spark)(store), staged)))


def _store_ledger(build: Build, totals: DataFrame) -> DataFrame:
    """Write the ledger in every contract version; returns it as the first one holds it."""
    contracts = build.wh.contracts
    if len(contracts) > 1:
        totals = build.store(totals, "int_invoice_totals")
    for contract in contracts.values():
        build.store(enforce(mart_invoice_ledger(totals, contract), contract), contract.dataset)
    return build.table(audited(build.wh).dataset)


def audited(wh: Warehouse) -> Contract:
    """The version that the declared checks are written for."""
    return wh.contracts[LATEST_VERSION]


def _build_ledger(
    build: Build, staged: dict[str, DataFrame], checks: Sequence[Check]
) -> list[Row]:
    intermediate, mart = (checks_of(checks, m) for m in LEDGER_MODELS)
    invoices, customers, lines = (staged[m] for m in STAGING_MODELS)
    totals = int_invoice_totals(
        invoices, customers, lines, find_hot_keys(invoices, "customer_id")
    )
    try:
        ledger = _store_ledger(build, totals)
    except ContractDrift:
        raise
    except (PySparkException, Py4JJavaError):
        # The job failed. Only if a row really breaks a constraint is that the reason.
        contracts = build.wh.contracts.values()
        if not any(breaches(mart_invoice_ledger(totals, c), c) for c in contracts):
            raise
        found = _audit((totals, intermediate), stored=False)
        broken = "skipped" if _failed(found) else "error"
        return [
            _model("int_invoice_totals", "success"),
            *found,
            _model("mart_invoice_ledger", broken),
            *_skipped(mart),
        ]
    # The stored mart has every column of the intermediate model, so one pass audits both.
    found = _audit((ledger, [*intermediate, *mart]))
    on_totals = [r for r in found if r["model"] == "int_invoice_totals"]
    on_mart = [r for r in found if r["model"] == "mart_invoice_ledger"]
    if _failed(on_totals):
        on_mart = [_model("mart_invoice_ledger", "skipped"), *_skipped(mart)]
    else:
        on_mart = [_model("mart_invoice_ledger", "success"), *on_mart]
    return [_model("int_invoice_totals", "success"), *on_totals, *on_mart]


def build(
    wh: Warehouse,
    raw: dict[str, DataFrame],
    target: str | None = None,
    checks: Sequence[Check] | None = None,
    deployed_at: datetime | None = None,
    min_rows: int = 0,
    hot_invoices: HotKeys | None = None,
) -> BuildResult:
    """Build, audit and, if the gate opens, publish.

    ``target`` defaults to the idle slot; ``dev`` builds and audits without publishing. Models
    after a failed check are skipped, and skips hold back the publish as failures do.
    ``min_rows`` guards against publishing the outcome of an empty load. ``hot_invoices`` saves
    looking for them in the raw lines where that can be done cheaper.
    """
    move_views(wh)  # a driver that died right after a deployment has left them behind
    state = next_slot(latest_deployment(wh)).first()
    target = target or state["next_target"]
    schema = TARGETS[target]
    if schema == state["active_schema"]:
        raise ValueError(f"{schema} is live; build the idle slot")
    checks = declared_checks() if checks is None else checks

    made = wh.new_build(schema)
    staged = _store_staging(made, raw, hot_invoices)
    results = [_model(m, "success") for m in staged]
    results += _audit(*[(df, checks_of(checks, m)) for m, df in staged.items()])
    if _failed(results):
        results += [_model(m, "skipped") for m in LEDGER_MODELS]
        results += _skipped(checks_of(checks, *LEDGER_MODELS))
    else:
        results += _build_ledger(made, staged, checks)

    report = made.store(
        wh.spark.createDataFrame(results, REPORT_DDL).coalesce(1), "check_results"
    )
    published = publish_gate(report, target, checks).first()["publish"]
    if published and min_rows:
        published = made.table(audited(wh).dataset).count() >= min_rows
    made.finish()
    if published:
        publish(made, deployed_at)
    return BuildResult(target, tuple(results), published)


def publish(build: Build, deployed_at: datetime | None = None) -> None:
    """Make ``build`` the live one, as of now unless a time is given in the session's zone.

    The last publish wins, whatever the clocks say. Views registered for this warehouse move along.
    """
    wh = build.wh
    if build.catalogue() is None:
        build.finish()
    when = F.lit(str(deployed_at)) if deployed_at else F.current_timestamp()
    moment = wh.spark.range(1).select(F.unix_micros(when.cast("timestamp"))).first()[0]
    wh.log.append(build.schema, build.name, moment)
    move_views(wh)


def move_views(wh: Warehouse) -> None:
    """Point the views that belong to this warehouse at the live build.

    Of publishes at once, each looks again after it has moved them, so the newest one stays.
    """
    owned = [c for c in wh.contracts.values() if _owned(wh, wh.public, _public_name(wh, c))]
    while owned:
        live = wh.log.latest()
        for contract in owned:
            register_views(wh, contract.version)
        if wh.log.latest() == live:
            return


# -- reading ------------------------------------------------------------------------------


def read_ledger(wh: Warehouse, version: str = LATEST_VERSION) -> DataFrame:
    """The live ledger: exactly the contracted columns, whatever else is stored.

    The rows are those of one build: later deployments change nothing for a reader that has begun.
    """
    contract = wh.contracts[version]
    return _must_be_live(wh).table(contract.dataset).select(*contract.read_order)


def recheck(wh: Warehouse, schema: str, checks: Sequence[Check] | None = None) -> DataFrame:
    """Audit the newest build of a slot as it is, without building anything."""
    build = wh.last_build(schema, *STAGING_MODELS, audited(wh).dataset)
    staged = {m: build.table(m) for m in STAGING_MODELS}
    checks = declared_checks() if checks is None else checks
    return quality.report(staged, build.table(audited(wh).dataset), checks, stored=True)


def _public_name(wh: Warehouse, contract: Contract) -> str:
    """The public view of a version: that of the first has the plain name."""
    first = next(iter(wh.contracts.values()))
    return "mart_invoice_ledger" if contract is first else f"mart_invoice_ledger_{contract.version}"


def register_views(wh: Warehouse, version: str = LATEST_VERSION) -> None:
    """Give SQL users ``public.mart_invoice_ledger`` and ``public.deployment_state``.

    From then on every publish moves the view to the build it makes live. A view names a build's
    folder, which is never written again, so it cannot show rows that the gate has not passed.
    """
    build, contract = _must_be_live(wh), wh.contracts[version]
    live = wh.log.latest()
    name, columns = _public_name(wh, contract), ", ".join(contract.read_order)
    _replace_view(wh, wh.public, name, build.path(contract.dataset), columns)
    _create_view(
        wh,
        wh.public,
        "deployment_state",
        f"SELECT '{live.active_schema}' AS active_schema, "
        f"timestamp_micros({live.deployed_us}) AS deployed_at",
    )


def register_slot(wh: Warehouse, schema: str) -> None:
    """Give SQL users the models of a slot's newest build under its schema name."""
    build = wh.last_build(schema, *STAGING_MODELS, *(c.dataset for c in wh.contracts.values()))
    for model in STAGING_MODELS:
        _replace_view(wh, schema, model, build.path(model))
    stored = audited(wh)
    columns = ", ".join(stored.read_order)
    _replace_view(wh, schema, "int_invoice_totals", build.path(stored.dataset), columns)
    for contract in wh.contracts.values():
        _replace_view(wh, schema, contract.dataset, build.path(contract.dataset))


def _replace_view(wh: Warehouse, schema: str, name: str, path: str, columns: str = "*") -> None:
    _create_view(wh, schema, name, f"SELECT {columns} FROM parquet.`{path}`")


def _create_view(wh: Warehouse, schema: str, name: str, query: str) -> None:
    """Create or move a view, unless the name is taken by another warehouse that still exists."""
    wh.spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
    taken = wh.spark.catalog.tableExists(f"{schema}.{name}")
    if taken and not _owned(wh, schema, name):
        owner = _owner(wh, schema, name)
        if owner is None or files.exists(wh.spark, owner):
            raise ForeignView(f"{schema}.{name} belongs to {owner or 'somebody else'}")
    wh.spark.sql(
        f"CREATE OR REPLACE VIEW {schema}.{name} "
        f"TBLPROPERTIES ('{OWNER}' = '{wh.root.rstrip('/')}') AS {query}"
    )


def _owner(wh: Warehouse, schema: str, name: str) -> str | None:
    """The root of the warehouse that a view belongs to; None if it belongs to none."""
    if not wh.spark.catalog.tableExists(f"{schema}.{name}"):
        return None
    properties = wh.spark.sql(f"SHOW TBLPROPERTIES {schema}.{name}").collect()
    return next((r["value"] for r in properties if r["key"] == OWNER), None)


def _owned(wh: Warehouse, schema: str, name: str) -> bool:
    """Whether there is a view of that name that belongs to this warehouse."""
    return _owner(wh, schema, name) == wh.root.rstrip("/")


def prune(wh: Warehouse, keep: int = 2, lease: float = LEASE) -> None:
    """Delete all but the last ``keep`` complete builds of each slot; the live build always stays.

    So does a build that is still running; one that was killed goes ``lease`` seconds after its last
    sign of life. Readers of a deleted build lose its files, so keep those that a job may be reading.
    """
    live = live_build(wh)
    for schema in TARGETS.values():
        builds = [Build(wh, schema, name) for name in wh.builds(schema)]
        complete = [b for b in builds if b.catalogue() is not None]
        kept = complete[max(0, len(complete) - keep) :]
        for b in builds:
            alive = b not in complete and (files.age(wh.spark, b.path("_lease")) or 0) < lease
            if b not in kept and b != live and not alive:
                files.delete(wh.spark, b.path(""))


def reset(wh: Warehouse) -> None:
    """Drop both slots, the public state and the views over them, all of this root and no other's."""
    for schema in (TARGETS["blue"], TARGETS["green"], wh.public):
        if wh.spark.catalog.databaseExists(schema):
            for view in wh.spark.catalog.listTables(schema):
                if not view.isTemporary and _owned(wh, schema, view.name):
                    wh.spark.sql(f"DROP VIEW {schema}.{view.name}")
    for folder in (TARGETS["blue"], TARGETS["green"], "public"):
        files.delete(wh.spark, wh.path(folder))


def status_summary(wh: Warehouse, schema: str) -> DataFrame:
    """Error, failure and skip counts of the last audit of a slot."""
    return status_tally(wh.table(schema, "check_results"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that two relations share if they hold the same rows equally often, in any order.

    The number of rows and the sums of two hashes of each row. A hash is added in three parts of 22
    bits, which 2**41 rows cannot overflow, so a task sends seven numbers on.
    """
    # A hash passes over NULLs, so which columns are NULL is hashed as well.
    whole = [F.col(c) for c in df.columns] + [F.col(c).isNull() for c in df.columns]
    sums = []
    for salt in ("one", "two"):
        row_hash = F.xxhash64(F.lit(salt), *whole)
        for shift in (0, 22, 44):
            part = F.shiftrightunsigned(row_hash, shift).bitwiseAND(F.lit(2**22 - 1))
            sums.append(F.coalesce(F.sum(part), F.lit(0)).alias(f"{salt}_{shift}"))
    return df.agg(F.count(F.lit(1)).alias("rows"), *sums)


def idempotence(first: DataFrame, second: DataFrame) -> DataFrame:
    """How two builds differ, counting repeated rows: one row, with zeros when they agree.

    They agree when their fingerprints do, for which no row moves. Only builds that differ are
    compared row by row.
    """
    second = second.select(*first.columns)
    (one, two) = (fingerprint(df).first() for df in (first, second))
    if one == two and first.dtypes == second.dtypes:
        ddl = "rows_first BIGINT, rows_second BIGINT, only_first BIGINT, only_second BIGINT"
        rows = [(one["rows"], two["rows"], 0, 0)]
        return first.sparkSession.createDataFrame(rows, ddl)
    return row_differences(first, second)


def row_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of each relation, and those it holds beyond the other: one row.

    Both are counted together by whole row, so a single shuffle answers both directions.
    """
    signed = first.withColumn("_side", F.lit(1)).unionByName(second.withColumn("_side", F.lit(-1)))
    surplus = signed.groupBy(*first.columns).agg(
        F.sum("_side").alias("_surplus"), F.count_if(F.col("_side") == 1).alias("_first"),
        F.count_if(F.col("_side") == -1).alias("_second"),
    )
    return surplus.agg(
        F.coalesce(F.sum("_first"), F.lit(0)).alias("rows_first"),
        F.coalesce(F.sum("_second"), F.lit(0)).alias("rows_second"),
        F.coalesce(F.sum(F.greatest("_surplus", F.lit(0))), F.lit(0)).alias("only_first"),
        F.coalesce(F.sum(F.greatest(-F.col("_surplus"), F.lit(0))), F.lit(0)).alias("only_second"),
    )
