"""Compare the grants of two sides and work out what makes the target follow the source.

Grants are flat rows (securable_type, full_name, principal, privilege). Both sides go through
one aggregate with a flag per side instead of two ``distinct`` and a full outer join: one
shuffle, combined on the map side, so copies of one grant never pile up in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuity.operators.joins import DEFAULT_LIMITS, JoinLimits, keyed_join, shuffled
from continuity.workspace import stored

SECURABLE = ["securable_type", "full_name"]
PRINCIPAL = [*SECURABLE, "principal"]
GRANT = [*PRINCIPAL, "privilege"]

ADD, REMOVE, SAME = "add", "remove", "same"
DIRECT, INHERITED, REFUSED = "direct", "inherited", "refused"

_GIVEN = "given"


def _flagged(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    def side(df: DataFrame, in_source: bool) -> DataFrame:
        return df.select(
            *keys, F.lit(in_source).alias("in_source"), F.lit(not in_source).alias("in_target")
        )

    both = side(source, True).unionByName(side(target, False))
    return both.groupBy(*keys).agg(
        F.max("in_source").alias("in_source"), F.max("in_target").alias("in_target")
    )


def _real(grants: DataFrame) -> DataFrame:
    return grants.filter(F.col("privilege").isNotNull())


def common_securables(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.select(*SECURABLE).join(target.select(*SECURABLE), SECURABLE, "left_semi")


def not_found(source_securables: DataFrame, target_securables: DataFrame) -> DataFrame:
    """Securables of the source that the target lacks; nothing is changed for them."""
    return source_securables.join(target_securables.select(*SECURABLE), SECURABLE, "left_anti")


def _within(
    df: DataFrame,
    source: DataFrame,
    target: DataFrame,
    securables: tuple[DataFrame, DataFrame] | None,
    spread_by: list[str],
    limits: JoinLimits,
) -> DataFrame:
    """Keep rows of securables found on both sides."""
    if securables is None:
        return df
    keys_of = source.select(*SECURABLE).unionByName(target.select(*SECURABLE))
    return keyed_join(
        df,
        common_securables(*securables),
        SECURABLE,
        "left_semi",
        spread_by=spread_by,
        keys_of=keys_of,
        limits=limits,
    )


def grant_diff(
    source: DataFrame,
    target: DataFrame,
    securables: tuple[DataFrame, DataFrame] | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Every grant of either side with ``change`` = add, remove or same.

    ``securables``: the objects of the source and of the target. Given them, only objects
    found on both sides are compared: those missing in the target are ``not_found``, those
    only in the target are left alone.
    """
    flagged = _flagged(_real(source), _real(target), GRANT)
    kept = _within(flagged, source, target, securables, ["principal", "privilege"], limits)
    change = (
        F.when(~F.col("in_target"), ADD).when(~F.col("in_source"), REMOVE).otherwise(SAME)
    )
    return kept.select(*GRANT, change.alias("change"))


def grant_adds(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("change") == ADD).select(*GRANT)


def grant_removes(diff: DataFrame) -> DataFrame:
    return diff.filter(F.col("change") == REMOVE).select(*GRANT)


def grant_principals(
    source: DataFrame,
    target: DataFrame,
    securables: tuple[DataFrame, DataFrame] | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """Principals with an entry on either side, per securable."""
    united = source.select(*PRINCIPAL).unionByName(target.select(*PRINCIPAL)).distinct()
    return _within(united, source, target, securables, ["principal"], limits)


def grant_changes(diff: DataFrame) -> DataFrame:
    """One row per principal to change: sorted ``add`` and ``remove`` and the ``change_kind``.

    An array holds distinct privileges of one principal on one object; the catalog's list of
    privileges bounds it, not the number of grants.
    """
    changed = diff.filter(F.col("change") != SAME)

    def privileges(change: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("change") == change, F.col("privilege"))))

    grouped = changed.groupBy(*PRINCIPAL).agg(
        privileges(ADD).alias("add"), privileges(REMOVE).alias("remove")
    )
    adds, removes = F.size("add") > 0, F.size("remove") > 0
    kind = F.when(adds & removes, "both").when(adds, ADD).otherwise(REMOVE)
    return grouped.withColumn("change_kind", kind)


def grant_status(
    diff: DataFrame, source_securables: DataFrame, target_securables: DataFrame
) -> DataFrame:
    """One row per source securable: SUCCESS (changed), NotFound, or null (nothing to do).

    One aggregate over the three inputs, each with its own flag; ``diff`` need not be cut
    down to common securables for this, which saves its semi join.
    """

    def flag(df: DataFrame, name: str) -> DataFrame:
        flags = [F.lit(name == other).alias(other) for other in ("ours", "theirs", "changed")]
        return df.select(*SECURABLE, *flags)

    rows = (
        flag(source_securables, "ours")
        .unionByName(flag(target_securables, "theirs"))
        .unionByName(flag(diff.filter(F.col("change") != SAME), "changed"))
    )
    seen = rows.groupBy(*SECURABLE).agg(*[F.max(c).alias(c) for c in ("ours", "theirs", "changed")])
    status = F.when(~F.col("theirs"), "NotFound").when(F.col("changed"), "SUCCESS")
    return seen.filter("ours").select(*SECURABLE, status.alias("status"))


def grants_after(
    source: DataFrame,
    target: DataFrame,
    securables: tuple[DataFrame, DataFrame] | None = None,
    limits: JoinLimits = DEFAULT_LIMITS,
) -> DataFrame:
    """The target's grants after the changes: target minus removes plus adds.

    On securables found on both sides that is what the source has, elsewhere what the target
    had.
    """
    flagged = _flagged(_real(source), _real(target), GRANT)
    if securables is None:
        return flagged.filter("in_source").select(*GRANT)
    common = common_securables(*securables).distinct().withColumn("common", F.lit(True))
    keys_of = source.select(*SECURABLE).unionByName(target.select(*SECURABLE))
    marked = keyed_join(
        flagged,
        common,
        SECURABLE,
        "left",
        spread_by=["principal", "privilege"],
        keys_of=keys_of,
        limits=limits,
    )
    kept = F.when(F.col("common").isNotNull(), F.col("in_source")).otherwise(F.col("in_target"))
    return marked.filter(kept).select(*GRANT)


def _ancestors() -> Column:
    """The containers above a securable, nearest first, as (kind, name)."""
    in_catalog = F.struct(F.lit("CATALOG").alias("kind"), F.col("catalog").alias("name"))
    in_schema = F.struct(
        F.lit("SCHEMA").alias("kind"), F.concat_ws(".", "catalog", "schema").alias("name")
    )
    none = F.array().cast("array<struct<kind:string,name:string>>")
    return (
        F.when(F.col("securable_type") == "CATALOG", none)
        .when(F.col("securable_type") == "SCHEMA", F.array(in_catalog))
        .otherwise(F.array(in_schema, in_catalog))
    )


def effective_grants(
    securables: DataFrame, direct: DataFrame, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Privileges each securable has by its own grants or those of its schema and catalog.

    Own grants are a semi join (the grants are the big side). Inherited ones are one join:
    each object names its ancestors, which meet the grants given on schemas and catalogs.
    """
    real = _real(direct)
    listed = securables.select(*SECURABLE)
    own = keyed_join(
        real.select(*GRANT),
        listed,
        SECURABLE,
        "left_semi",
        spread_by=["principal", "privilege"],
        limits=limits,
    )
    chained = (
        securables.filter(F.col("securable_type") != "CATALOG")
        .select(*SECURABLE, F.explode(_ancestors()).alias("up"))
        .select(*SECURABLE, F.col("up.kind").alias("kind"), F.col("up.name").alias("name"))
    )
    handed_down = (
        real.filter(F.col("securable_type").isin("CATALOG", "SCHEMA"))
        .select(
            F.col("securable_type").alias("kind"),
            F.col("full_name").alias("name"),
            "principal",
            "privilege",
        )
        .distinct()
    )
    inherited = keyed_join(
        chained, handed_down, ["kind", "name"], "inner", spread_by=["full_name"], limits=limits
    ).select(*GRANT)
    return own.unionByName(inherited).distinct()


def _given_by(df: DataFrame) -> DataFrame:
    """``df`` with what is given to whom as one key. Nulls within a struct are equal, so a null
    principal is a principal like others."""
    return df.withColumn(_GIVEN, F.struct("principal", "privilege"))


def _places(securables: DataFrame) -> DataFrame:
    """Each listed securable once, with its catalog and schema."""
    return securables.groupBy(*SECURABLE).agg(
        F.min("catalog").alias("catalog"), F.min("schema").alias("schema")
    )


def grant_placement(
    securables: DataFrame, wanted: DataFrame, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """Where each wanted effective grant has to be given: ``placement`` and ``n_surplus``.

    - ``direct``: it must be given on this object, no container hands it down;
    - ``inherited``: a grant placed on a container above hands it down;
    - ``refused``: given here it would also reach ``n_surplus`` listed objects that are not to
      have it. (Wanted sets that are themselves effective grants have none of these.) Objects
      below a refused one are placed by themselves.

    The direct rows are the smallest set of grants on listed objects whose effective grants are
    all wanted rows but the refused ones, and there is only one such set: whatever hands a row
    down is itself a wanted row above it, so a row with none above must be given as it is, and
    the rows with none above give all others. Refused rows cannot be had without more than is
    wanted, whatever else is given.

    Grants on objects that are not listed, and rows without a privilege, give no row; equal rows
    count once. A null principal is a principal like others. Containers that are not listed
    cannot be granted on, so they hand nothing down.

    ``wanted`` is computed once. Rows are counted per container with combining on the map side,
    so a container with a large share of the objects is no hot key; the joins salt hot ones.
    """
    is_container = F.col("securable_type").isin("CATALOG", "SCHEMA")
    places = _places(securables)
    given = stored(_real(wanted).select(*GRANT).distinct(), "wanted_grants")
    listed = stored(
        _given_by(
            keyed_join(
                given,
                places,
                SECURABLE,
                "inner",
                spread_by=["principal", "privilege"],
                limits=limits,
            )
        ).select(
            *SECURABLE,
            _GIVEN,
            F.when(~is_container, F.concat_ws(".", "catalog", "schema")).alias("in_schema"),
            F.when(F.col("securable_type") != "CATALOG", F.col("catalog")).alias("in_catalog"),
        ),
        "listed_grants",
    )
    own = listed.filter(is_container).select(
        F.col("securable_type").alias("kind"),
        F.col("full_name").alias("name"),
        _GIVEN,
        "in_schema",
        "in_catalog",
    )
    sizes = (
        places.select(F.explode(_ancestors()).alias("up"))
        .groupBy(F.col("up.kind").alias("kind"), F.col("up.name").alias("name"))
        .agg(F.count(F.lit(1)).alias("n_below"))
    )
    # Of the rows below a container only those count that it has itself.
    reached = (
        keyed_join(
            listed.select(
                "full_name",
                _GIVEN,
                F.stack(
                    F.lit(2), F.lit("SCHEMA"), "in_schema", F.lit("CATALOG"), "in_catalog"
                ).alias("kind", "name"),
            ).filter(F.col("name").isNotNull()),
            own.select("kind", "name", _GIVEN),
            ["kind", "name", _GIVEN],
            "left_semi",
            spread_by=["full_name"],
            limits=limits,
        )
        .groupBy("kind", "name", _GIVEN)
        .agg(F.count(F.lit(1)).alias("n_reached"))
    )
    sized = keyed_join(own, sizes, ["kind", "name"], "left", spread_by=[_GIVEN], limits=limits)
    surplus = F.coalesce("n_below", F.lit(0)) - F.coalesce("n_reached", F.lit(0))
    containers = stored(
        sized.join(shuffled(reached), ["kind", "name", _GIVEN], "left").select(
            *own.columns, surplus.cast("bigint").alias("n_surplus")
        ),
        "container_grants",
    )
    marks = (
        listed.filter(~is_container)
        .withColumn("n_surplus", F.lit(0).cast("bigint"))
        .unionByName(
            containers.withColumnsRenamed({"kind": "securable_type", "name": "full_name"})
        )
    )
    for kind, name in (("SCHEMA", "in_schema"), ("CATALOG", "in_catalog")):
        hands_down = containers.filter((F.col("kind") == kind) & (F.col("n_surplus") == 0)).select(
            F.col("name").alias(name), _GIVEN, F.lit(True).alias(f"from_{kind}")
        )
        marks = keyed_join(
            marks, hands_down, [name, _GIVEN], "left", spread_by=["full_name"], limits=limits
        )
    placement = (
        F.when(F.col("n_surplus") > 0, REFUSED)
        .when(F.coalesce("from_SCHEMA", "from_CATALOG"), INHERITED)
        .otherwise(DIRECT)
    )
    return marks.select(
        *SECURABLE,
        F.col(_GIVEN)["principal"].alias("principal"),
        F.col(_GIVEN)["privilege"].alias("privilege"),
        placement.alias("placement"),
        "n_surplus",
    )


def least_grants(
    securables: DataFrame, wanted: DataFrame, limits: JoinLimits = DEFAULT_LIMITS
) -> DataFrame:
    """The smallest set of direct grants that gives the wanted effective ones and no others
    (``grant_placement`` says what cannot be had so)."""
    placed = grant_placement(securables, wanted, limits)
    return placed.filter(F.col("placement") == DIRECT).select(*GRANT)
