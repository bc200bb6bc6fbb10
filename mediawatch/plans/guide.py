"""Programme-guide queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.operators import guide
from mediawatch.plans import oracle as O
from mediawatch.plans.registry import query


@query(
    "programme_at",
    O.with_ctes(
        """SELECT c.id, coalesce(max_by(p.title, p.start_ts), '') AS programme FROM chunks c
        LEFT JOIN programmes p ON p.channel_name = c.channel_name AND p.start_ts <= c.ts AND p.stop_ts > c.ts
        GROUP BY c.id"""
    ),
)
def programme_at(spark: SparkSession, sf: str) -> DataFrame:
    chunks = X.chunks(spark, sf).select("id", "channel_name", "ts")
    return guide.with_programme(chunks, X.programmes(spark, sf)).select("id", "programme")


_COVERED = """m JOIN programmes p ON p.channel_name = m.channel_name AND p.start_ts <= m.ts AND p.stop_ts > m.ts"""


@query(
    "programme_facet",
    O.with_ctes(f"SELECT DISTINCT p.title FROM matches {_COVERED} WHERE m.search_id = 1 ORDER BY 1 LIMIT 200"),
)
def programme_facet(spark: SparkSession, sf: str) -> DataFrame:
    own = X.matches(spark, sf).filter("search_id = 1")
    return guide.programme_titles(own, X.programmes(spark, sf), guide.TITLES_SHOWN)


@query(
    "programme_semi",
    O.with_ctes(f"SELECT DISTINCT m.match_id, m.search_id FROM matches {_COVERED} AND p.title IN ('prog_3', 'prog_8')"),
)
def programme_semi(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.matches(spark, sf).select("match_id", "search_id", "channel_name", "ts")
    return guide.during_programmes(rows, X.programmes(spark, sf), ["prog_3", "prog_8"]).select("match_id", "search_id")


@query(
    "guide_coverage",
    O.with_ctes(
        """SELECT channel_name, count(*) AS total, min(start_ts) AS first_start, max(stop_ts) AS last_stop,
        string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM programmes GROUP BY channel_name"""
    ),
)
def guide_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return guide.coverage(X.programmes(spark, sf))


@query("first_source_wins", O.with_ctes("SELECT channel_name, start_ts, stop_ts, title, source FROM programmes"))
def first_source_wins(spark: SparkSession, sf: str) -> DataFrame:
    return guide.first_source_wins(X.programme_sources(spark, sf))


@query(
    "latest_source_wins",
    O.with_ctes("SELECT channel_name, start_ts, stop_ts, title || '_alt' AS title, 'guide_c' AS source FROM programmes"),
)
def latest_source_wins(spark: SparkSession, sf: str) -> DataFrame:
    return guide.first_source_wins(X.programme_sources(spark, sf), latest=True)


@query(
    "missing_coverage",
    O.with_ctes("SELECT name AS channel_name FROM roster EXCEPT SELECT channel_name FROM programmes"),
)
def missing_coverage(spark: SparkSession, sf: str) -> DataFrame:
    wanted = X.roster(spark, sf).select(F.col("name").alias("channel_name"))
    return guide.missing_coverage(wanted, X.programmes(spark, sf))


_WANTED = [(1, "North", ["example.org", "thther"]), (2, "South", ["m.", "net"]), (3, "East", ["/es/"]), (4, "None", ["zzzz"])]


def _wanted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_WANTED, "wanted_pos int, name string, fragments array<string>")


_WANTED_SQL = "(VALUES " + ", ".join(f"({p}, '{n}', {f})" for p, n, f in _WANTED) + ") w(wanted_pos, name, fragments)"


@query(
    "guide_channel_map",
    f"""SELECT guide_id, max_by(name, wanted_pos) AS name FROM (
        SELECT w.wanted_pos, w.name, min_by(page_id, page_id) AS guide_id FROM pages p, {_WANTED_SQL}
        WHERE len(list_filter(w.fragments, lambda f: contains(lower(p.url), f))) > 0 GROUP BY 1, 2) GROUP BY guide_id""",
)
def guide_channel_map(spark: SparkSession, sf: str) -> DataFrame:
    """Guide channels (page addresses) matched to wanted names, first in file order."""
    listed = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.col("page_id").alias("guide_id"), F.col("page_id").alias("file_pos"), F.col("url").alias("haystack")
    )
    return guide.map_guide_channels(listed, _wanted(spark))


@query(
    "live_channel_map",
    f"""SELECT page_id AS uuid, min_by(name, frag_pos) AS name FROM pages p,
        (SELECT wanted_pos * 10 + i AS frag_pos, name, fragments[i] AS fragment FROM
          (SELECT *, unnest(range(1, len(fragments) + 1)) AS i FROM {_WANTED_SQL})) f
        WHERE contains(lower(p.url), f.fragment) GROUP BY page_id""",
)
def live_channel_map(spark: SparkSession, sf: str) -> DataFrame:
    """Every live channel (page address) named by the first fragment found in it."""
    frags = _wanted(spark).select("wanted_pos", "name", F.posexplode("fragments").alias("p", "fragment")).select(
        (F.col("wanted_pos") * 10 + F.col("p") + 1).alias("frag_pos"), "name", "fragment"
    )
    live = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.col("page_id").alias("uuid"), F.col("url").alias("live_name")
    )
    return guide.map_live_channels(live, frags)


@query(
    "guide_refresh_due",
    O.with_ctes(
        f"""SELECT channel_name AS source FROM channel_status
        WHERE epoch(TIMESTAMP '{X.NOW}') - epoch(date_trunc('second', last_seen)) >= 12 * 3600 OR channel_id % 7 = 0"""
    ),
)
def guide_refresh_due(spark: SparkSession, sf: str) -> DataFrame:
    """Sources due for a fetch; every seventh has an unreadable mark."""
    state = X.channel_status(spark, sf).select(
        F.col("channel_name").alias("source"),
        F.when(F.col("channel_id") % 7 == 0, F.lit("n/a"))
        .otherwise(F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss")).alias("last_fetch"),
        F.lit(12.0).alias("hours"),
    )
    return guide.refresh_due(state, X.now()).select("source")
