"""Order-dependent operators cut into time buckets, so that one busy key never lands in one task.

Each operator works inside (key, bucket) groups and carries a small per-bucket summary across the
bucket edges; the summaries of a key grow with the time span, not with the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediawatch.functions.timefn import epoch_seconds

HOUR = 3_600
GAP_BUCKET = 6 * 3_600
#: Buckets, or groups of them, whose maps are composed at once.
GROUP = 64
#: Levels at which maps may be composed.
LEVELS = 5


def time_bucket(ts: Column, width: int) -> Column:
    return F.floor(epoch_seconds(ts) / width).cast("bigint")


def neighbour_instants(
    rows: DataFrame, keys: list[str], order: str, width: int = HOUR
) -> DataFrame:
    """Distinct (keys, order) with the nearest earlier and later instant of the same key."""
    marks = rows.select(*keys, order).distinct().withColumn("_b", time_bucket(F.col(order), width))
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_b")
    edges = (
        marks.groupBy(*keys, "_b")
        .agg(F.min(order).alias("_first"), F.max(order).alias("_last"))
        .select(
            *keys,
            "_b",
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
        )
    )
    return (
        marks.withColumn("_prev", F.lag(order).over(inside))
        .withColumn("_next", F.lead(order).over(inside))
        .join(edges, [*keys, "_b"])
        .select(
            *keys,
            order,
            F.coalesce("_prev", "_before").alias("prev_ts"),
            F.coalesce("_next", "_after").alias("next_ts"),
        )
    )


def asof_last(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    payload: list[str],
    out: str = "asof",
    bucket: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Each left row with the struct of the last right row of its key at or before it (or NULL).

    Right rows that tie on the instant are ranked by the payload, the largest wins.
    """
    l_struct = F.struct(*[F.col(c) for c in left.columns])
    r_struct = F.struct(F.col(right_ts).alias("at"), *[F.col(c) for c in payload])
    lrows = left.select(
        *keys,
        F.col(left_ts).alias("_t"),
        F.lit(1).alias("_side"),
        l_struct.alias("_l"),
        F.lit(None).cast(right.select(r_struct.alias("r")).schema["r"].dataType).alias("_r"),
    )
    rrows = right.groupBy(*keys, F.col(right_ts).alias("_t")).agg(F.max(r_struct).alias("_r")).select(
        *keys,
        "_t",
        F.lit(0).alias("_side"),
        F.lit(None).cast(lrows.schema["_l"].dataType).alias("_l"),
        "_r",
    )
    place = bucket or (lambda c: time_bucket(c, HOUR))
    timeline = lrows.unionByName(rrows).withColumn("_b", place(F.col("_t")))
    inside = (
        Window.partitionBy(*keys, "_b")
        .orderBy("_t", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = (
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        timeline.groupBy(*keys, "_b")
        .agg(F.max("_r").alias("_last"))
        .select(*keys, "_b", F.last("_last", ignorenulls=True).over(across).alias("_carry"))
    )
    return (
        timeline.withColumn("_in", F.last("_r", ignorenulls=True).over(inside))
        .filter(F.col("_side") == 1)
        .join(carried, [*keys, "_b"])
        .select("_l.*", F.coalesce("_in", "_carry").alias(out))
    )


def greedy_starts(
    rows: DataFrame, keys: list[str], pos: str, reach: str, row_id: str, active: str, gap: int, width: int
) -> DataFrame:
    """Greedy selection along `pos` (BIGINT, one row per key and pos comes out, lowest row_id).

    A row is kept when `reach - gap` lies beyond the last *kept* pos of its key; rows whose `active`
    flag is off are all kept. `width` is the bucket size, several times the gap.

    A bucket's effect on the next one is the map from its possible first kept rows to its last kept
    one. Where a key has more than 64 maps, those of 64 buckets in a row are composed to one, and so on level by
    level; entry states then go down the same way, as rows, and the buckets are folded independently. No task holds a
    key's rows, and no array more than 64 maps (the last of the levels holds 64^4 buckets, thousands of years).
    """
    scope = [*keys, active]
    packs = (
        rows.groupBy(*scope, F.col(pos).alias("_t"))
        .agg(F.min(F.struct(F.col(row_id).alias("id"), F.col(reach).alias("r"))).alias("_v"))
        .withColumn("_b", F.floor(F.col("_t") / width).cast("bigint"))
        .groupBy(*scope, "_b")
        .agg(F.array_sort(F.collect_list(F.struct("_t", "_v.r", "_v.id"))).alias("_rows"))
    )
    none = F.lit(None).cast("bigint")

    def free(r: Column, last: Column) -> Column:
        return last.isNull() | (r["r"] - gap > last)

    def last_from(start: Column) -> Column:
        return F.aggregate(
            F.filter("_rows", lambda r: r["_t"] >= start),
            none,
            lambda last, r: F.when(free(r, last), r["_t"]).otherwise(last),
        )

    # Rows past the first one that no earlier bucket can hold back are never a first kept row.
    opening = F.array_min(
        F.transform(
            F.filter("_rows", lambda r: r["r"] - gap >= F.col("_b") * width), lambda r: r["_t"]
        )
    )
    heads = F.transform(
        F.filter("_rows", lambda r: F.col("_open").isNull() | (r["_t"] <= F.col("_open"))),
        lambda r: F.struct(r["r"].alias("r"), last_from(r["_t"]).alias("out")),
    )
    maps = packs.withColumn("_open", opening).select(
        *scope, F.struct("_b", F.col("_b").alias("end"), heads.alias("heads"), none.alias("none")).alias("_m")
    )

    def passed(m: Column, entry: Column) -> Column:
        """Last kept position after a map that is entered with `entry`."""
        first = F.filter(m["heads"], lambda h: free(h, entry))
        return F.when(F.size(first) > 0, F.get(first, F.lit(0))["out"]).otherwise(m["none"])

    def entered(acc: Column, m: Column) -> Column:
        return F.when(acc["b"] == m["_b"] - 1, acc["last"])

    def through(ms: Column, end: Column, last: Column) -> Column:
        start = F.struct(end.alias("b"), last.alias("last"))
        return F.aggregate(
            ms, start, lambda acc, m: F.struct(m["end"].alias("b"), passed(m, entered(acc, m)).alias("last"))
        )["last"]

    def composed(lower: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
        """(maps of the groups, the maps they are made of as arrays): `width` buckets to a group."""
        packed = lower.groupBy(*scope, F.floor(F.col("_m._b") / width).cast("bigint").alias("_g")).agg(
            F.array_sort(F.collect_list("_m")).alias("_ms")
        )
        first, rest = F.get("_ms", F.lit(0)), F.slice("_ms", 2, F.size("_ms"))
        whole = F.struct(
            first["_b"].alias("_b"),
            F.element_at("_ms", -1)["end"].alias("end"),
            F.transform(first["heads"], lambda h: F.struct(h["r"].alias("r"), through(rest, first["end"], h["out"]).alias("out"))).alias("heads"),
            through(rest, first["end"], first["none"]).alias("none"),
        )
        return packed.select(*scope, whole.alias("_m")), packed

    def entries_of(packed: DataFrame, width: int, above: DataFrame | None) -> DataFrame:
        """(_at: scope and first bucket, _entry) of every map in the arrays, from the entries of the groups above."""
        given = packed.withColumn("_entry", none)
        if above is not None:
            group = above.select(F.struct("_at.*").alias("_up"), F.col("_entry").alias("_given"))
            same = [F.col(c).eqNullSafe(F.col(f"_up.{c}")) for c in scope]
            given = packed.join(group, [*same, F.floor(F.col("_up._b") / width) == F.col("_g")], "left").withColumn("_entry", F.col("_given"))

        def step(acc: Column, m: Column) -> Column:
            entry = F.when(F.size(acc["entries"]) == 0, F.col("_entry")).otherwise(entered(acc, m))
            return F.struct(
                m["end"].alias("b"), passed(m, entry).alias("last"),
                F.concat(acc["entries"], F.array(F.struct(m["_b"].alias("_b"), entry.alias("_entry")))).alias("entries"),
            )

        start = F.struct(none.alias("b"), none.alias("last"), F.array().cast("array<struct<_b:bigint,_entry:bigint>>").alias("entries"))
        found = given.select(*scope, F.explode(F.aggregate("_ms", start, step)["entries"]).alias("_e"))
        return found.select(F.struct(*scope, "_e._b").alias("_at"), "_e._entry").filter(F.col("_entry").isNotNull())

    # As many levels as it takes until a key's maps fit one array.
    buckets = rows.select(*scope, F.floor(F.col(pos) / width).cast("bigint").alias("_b")).distinct()
    spans = [GROUP**n for n in range(LEVELS)]
    sizes = buckets.groupBy(*scope).agg(*[F.count_distinct(F.floor(F.col("_b") / w)).alias(f"_{w}") for w in spans])
    most = sizes.agg(*[F.max(f"_{w}") for w in spans]).first()
    tops, levels = maps, []
    for group, n in zip(spans[1:], most):
        if (n or 0) <= GROUP:
            break
        tops, packed = composed(tops, group)
        levels.append((packed, group))
    high = tops.groupBy(*scope).agg(F.array_sort(F.collect_list("_m")).alias("_ms"))
    entries = entries_of(high, 1, None)
    for packed, group in reversed(levels):
        entries = entries_of(packed, group, entries)

    element = packs.schema["_rows"].dataType.simpleString()
    fold_start = F.struct(F.col("_entry").alias("last"), F.array().cast(element).alias("kept"))

    def fold(acc: Column, r: Column) -> Column:
        return F.when(
            free(r, acc["last"]),
            F.struct(r["_t"].alias("last"), F.concat(acc["kept"], F.array(r)).alias("kept")),
        ).otherwise(acc)

    kept = F.when(F.col(active), F.aggregate("_rows", fold_start, fold)["kept"]).otherwise(
        F.col("_rows")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_at.{c}")) for c in (*scope, "_b")]
    return (
        packs.join(entries, same, "left")
        .select(*keys, F.explode(kept).alias("_k"))
        .select(*keys, F.col("_k._t").alias(pos), F.col("_k.id").alias(row_id))
    )


def keep_spaced(
    hits: DataFrame, keys: list[str], ts: str, row_id: str, active: str, gap: int = 60
) -> DataFrame:
    """Greedy minimum gap in time: keep a hit only if the last kept hit of its key lies before
    floor(second) - gap. One row per (keys, ts) comes out."""
    micros = (epoch_seconds(F.col(ts)) * 1_000_000).cast("bigint")
    placed = hits.select(*keys, active, row_id, micros.alias("_pos")).withColumn(
        "_reach", F.col("_pos") - F.pmod(F.col("_pos"), F.lit(1_000_000))
    )
    kept = greedy_starts(
        placed, keys, "_pos", "_reach", row_id, active, gap * 1_000_000, GAP_BUCKET * 1_000_000
    )
    instant = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(F.col("_pos") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    )
    return kept.select(*keys, instant.alias(ts), row_id)


def running_total(
    rows: DataFrame, value: str, levels: list[str], tie: list[str], out: str, keys: list[str] | None = None
) -> DataFrame:
    """Sum of `value` over all rows of the keys ordered before each row, by nested order columns.

    `levels` go from coarse to fine, each a step in the row's place in the order. Totals of a level
    are summed inside the level above, so no window holds more than one level's groups; the
    coarsest one holds a row per distinct first level.
    """
    keys = keys or []
    base = rows
    parts = []
    for depth in range(len(levels)):
        scope = [*keys, *levels[: depth + 1]]
        sums = rows.groupBy(*scope).agg(F.sum(value).alias("_s"))
        before = (
            Window.partitionBy(*scope[:-1])
            .orderBy(scope[-1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        name = f"_p{depth}"
        parts.append(name)
        base = base.join(
            sums.select(*scope, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias(name)), scope
        )
    w = (
        Window.partitionBy(*keys, *levels)
        .orderBy(*tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    total = F.coalesce(F.sum(value).over(w), F.lit(0))
    for name in parts:
        total = total + F.col(name)
    return base.withColumn(out, total).drop(*parts)
