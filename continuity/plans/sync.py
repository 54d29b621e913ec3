"""One sync run: schemas, tables by name, tables by path, volumes, views, grants, in order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from continuity.functions.names import quote
from continuity.operators.grants import (
    DIRECT,
    GRANT,
    REFUSED,
    effective_grants,
    grant_changes,
    grant_diff,
    grant_placement,
    grant_status,
    grants_after,
)
from continuity.operators.joins import keyed_join
from continuity.operators.listing import copy_candidates, missing_schemas, securables
from continuity.operators.volumes import registry_after, volume_upsert
from continuity.plans.clone import clone_by_name, clone_by_path, duplicate_targets
from continuity.plans.databases import create_schemas
from continuity.plans.journal import Journal
from continuity.plans.replicate import run_clone_plan
from continuity.plans.status import StatusLog, record, stamped
from continuity.plans.views import create_views, view_plan
from continuity.sources.inventory import Inventory
from continuity.workspace import stored


@dataclass(frozen=True)
class SyncOptions:
    """How names and folders of the two sides relate, and what is taken along.

    ``source_database`` / ``target_database`` turn (catalog, schema) into a database of the
    session catalog, which has two name levels only.
    """

    source_database: Callable[[str, str], str]
    target_database: Callable[[str, str], str]
    # Home of the copies made by name and of new schemas; no scratch folder.
    folder: str
    named_types: Sequence[str] = ("MANAGED",)
    path_types: Sequence[str] = ("EXTERNAL",)
    catalog_types: Sequence[str] = ("MANAGED_CATALOG",)
    formats: Sequence[str] | None = None
    source_suffix: str = "_share"
    view_definition: Callable[[Row], str] = lambda row: row.view_definition
    effective: bool = True
    # Give the effective grants by the smallest set of direct ones, so that what is inherited in
    # the source is inherited in the target. The run's grants are then direct ones.
    least: bool = False
    fmt: str | None = None
    workers: int = 8
    fail_fast: bool = False
    skip_unchanged: bool = False
    # Folder of the run's journal. A run started again with it goes on where it was stopped.
    journal: str | None = None


@dataclass(frozen=True)
class SyncResult:
    status: DataFrame
    volumes: DataFrame
    grant_changes: DataFrame
    grants: DataFrame


def run_sync(
    spark: SparkSession, source: Inventory, target: Inventory, options: SyncOptions
) -> SyncResult:
    log = Journal(spark, options.journal) if options.journal else StatusLog(spark)
    return run_logged(spark, source, target, options, log)


def run_logged(
    spark: SparkSession,
    source: Inventory,
    target: Inventory,
    options: SyncOptions,
    log: StatusLog,
) -> SyncResult:
    """The run, with a log of the caller's."""
    if options.least and not options.effective:
        raise ValueError("least grants are worked out from effective ones")
    source, target = log.inventory("source", source), log.inventory("target", target)
    grants_known = source.grants is not None and target.grants is not None
    source, target = source.complete(spark), target.complete(spark)
    folder = options.folder.rstrip("/")

    def candidates(types: Sequence[str]) -> DataFrame:
        return copy_candidates(
            source.tables, source.catalogs, types, options.catalog_types, options.formats
        )

    plans = log.once(
        "plan",
        clone_by_name(candidates(options.named_types), options.source_suffix).unionByName(
            clone_by_path(candidates(options.path_types), source.locations, target.locations)
        ),
    )
    views = view_plan(source.tables)
    repeated = duplicate_targets(plans).take(3)
    if repeated:
        raise ValueError(f"targets planned more than once: {[r.target for r in repeated]}")
    _refuse_meeting_targets(spark, plans, views, options.target_database)

    missing = missing_schemas(source.schemas, target.schemas)
    create_schemas(
        spark,
        missing,
        log,
        options.target_database,
        lambda row: f"{folder}/schemas/{row.catalog}/{row.schema}",
    )

    run_clone_plan(
        spark,
        plans,
        log,
        source_of=lambda r: quote(options.source_database(r.catalog, r.schema), r.table),
        target_of=lambda r: quote(options.target_database(r.catalog, r.schema), r.table),
        folder_of=lambda r: f"{folder}/tables/{r.catalog}/{r.schema}/{r.table}",
        fmt=options.fmt,
        workers=options.workers,
        fail_fast=options.fail_fast,
        skip_unchanged=options.skip_unchanged,
    )

    made = log.frame().filter(~F.col("status").startswith("FAIL"))
    schemas_now = target.schemas.select("catalog", "schema").unionByName(
        made.filter("kind = 'schema'").select("catalog", "schema")
    )
    upserted = volume_upsert(source.volumes, target.volumes, schemas_now)
    log.add_frame(
        stamped(
            upserted.select(
                "catalog", "schema", F.col("name").alias("table"), F.lit("volume").alias("kind"), "status"
            )
        ),
        "volumes",
    )

    create_views(
        spark,
        views,
        log,
        lambda r: quote(options.target_database(r.catalog, r.schema), r.view),
        options.view_definition,
        options.workers,
        lambda r: quote(options.target_database(r.catalog, r.schema)),
    )

    volumes = registry_after(source.volumes, target.volumes, schemas_now)
    if not grants_known:
        log.add(record(None, None, None, "grants", "SKIPPED: no grants exported"))
        nothing = spark.createDataFrame([], target.grants.schema)
        return SyncResult(
            status=log.frame(),
            volumes=volumes,
            grant_changes=grant_changes(grant_diff(nothing, nothing)),
            grants=target.grants,
        )
    ours = securables(source.catalogs, source.schemas, source.tables, source.volumes)
    # Schemas, tables and volumes of the source exist in the target by now, as far as the
    # steps above could create them.
    made = log.frame().filter(~F.col("status").startswith("FAIL"))
    theirs = _securables_now(source, target, made, volumes)
    have, want = target.grants, source.grants
    # Grants on objects that the inventory does not list (functions, system schemas) stay.
    unlisted = keyed_join(
        target.grants, theirs.select("securable_type", "full_name").distinct(),
        ["securable_type", "full_name"], "left_anti", spread_by=["principal", "privilege"],
    )
    if options.effective:
        have = stored(effective_grants(theirs, have), "target_grants")
        want = stored(effective_grants(ours, want), "source_grants")
    after = grants_after(want, have, (ours, theirs))
    refused = None
    if options.least:
        # Objects that only the target has count too: nothing may reach them through a container.
        placed = stored(grant_placement(theirs, after), "grant_placement")
        after = placed.filter(F.col("placement") == DIRECT).select(*GRANT)
        refused = placed.filter(F.col("placement") == REFUSED)
        have = keyed_join(
            target.grants, theirs.select("securable_type", "full_name").distinct(),
            ["securable_type", "full_name"], "left_semi", spread_by=["principal", "privilege"],
        )
        diff = every = grant_diff(after, have)
    else:
        diff, every = grant_diff(want, have, (ours, theirs)), grant_diff(want, have)
    statuses = grant_status(every, ours, theirs)
    named_status = statuses.join(ours, ["securable_type", "full_name"])
    if refused is not None:
        kept_back = refused.select(
            "securable_type",
            "full_name",
            F.format_string(
                "REFUSED: %s for %s would reach %d more objects", "privilege", "principal", "n_surplus"
            ).alias("status"),
        )
        places = theirs.select("securable_type", "full_name", "catalog", "schema").distinct()
        named_status = named_status.unionByName(
            kept_back.join(places, ["securable_type", "full_name"])
        )
    log.add_frame(
        stamped(
            named_status.select(
                "catalog",
                "schema",
                F.col("full_name").alias("table"),
                F.concat(F.lit("grants_"), F.lower("securable_type")).alias("kind"),
                "status",
            )
        ),
        "grants",
    )
    return SyncResult(
        status=log.frame(),
        volumes=volumes,
        grant_changes=grant_changes(diff),
        grants=after.unionByName(unlisted.select(*GRANT)) if options.effective else after,
    )


def _refuse_meeting_targets(
    spark: SparkSession,
    plans: DataFrame,
    views: DataFrame,
    target_database: Callable[[str, str], str],
) -> None:
    """Raise before anything is written if two tables or views would get one name: databases
    are made up by a callable, and names do not tell upper from lower case."""
    named = plans.select("catalog", "schema", F.col("table").alias("name")).unionByName(
        views.select("catalog", "schema", F.col("view").alias("name"))
    )
    # One row per schema: the work list of the run.
    places = [
        (r.catalog, r.schema, target_database(r.catalog, r.schema).lower())
        for r in named.select("catalog", "schema").distinct().toLocalIterator()
    ]
    databases = spark.createDataFrame(places, "catalog string, schema string, database string")
    meeting = (
        named.join(databases, ["catalog", "schema"])
        .groupBy("database", F.lower("name").alias("name"))
        .count()
        .filter("count > 1")
        .take(3)
    )
    if meeting:
        names = [f"{r.database}.{r.name}" for r in meeting]
        raise ValueError(f"targets planned more than once: {names}")


def _securables_now(
    source: Inventory, target: Inventory, made: DataFrame, volumes: DataFrame
) -> DataFrame:
    """Securables of the target after the objects were created."""

    def created(kinds: list[str], name: bool) -> DataFrame:
        rows = made.filter(F.col("kind").isin(kinds))
        return rows.select("catalog", "schema", *([F.col("table").alias("name")] if name else []))

    schemas = target.schemas.select("catalog", "schema").unionByName(created(["schema"], False))
    tables = target.tables.select("catalog", "schema", "name").unionByName(
        created(["table_by_name", "table_by_path", "view"], True)
    )
    return securables(
        target.catalogs, schemas.distinct(), tables.distinct(), volumes.select("catalog", "schema", "name")
    )
