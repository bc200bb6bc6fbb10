"""Search lifecycle queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.operators import lifecycle, matching
from mediawatch.plans import oracle as O
from mediawatch.plans.registry import query


@query(
    "expire_searches",
    O.with_ctes(
        f"""SELECT s.search_id, CASE WHEN s.status = 'active' AND s.date_end < DATE '{X.TODAY}' THEN 'completed' ELSE s.status END AS status,
        count(m.match_id) AS n_matches FROM searches s LEFT JOIN matches m ON m.search_id = s.search_id GROUP BY ALL"""
    ),
)
def expire_searches(spark: SparkSession, sf: str) -> DataFrame:
    n = X.matches(spark, sf).groupBy("search_id").agg(F.count(F.lit(1)).alias("n_matches"))
    after = lifecycle.expire(X.searches(spark), X.today())
    return after.join(n, "search_id", "left").na.fill(0, ["n_matches"]).select("search_id", "status", "n_matches")


@query(
    "reports_due",
    O.with_ctes(
        f"""SELECT m.search_id, r.mode, count(*) AS n_matches FROM matches m JOIN (
          SELECT search_id, 'daily' AS mode FROM searches WHERE delivery_mode = 'daily' AND report_email <> '' AND status = 'active'
            AND hour(TIMESTAMP '2024-01-02 08:00:00') >= 7 AND (last_report IS NULL OR last_report < DATE '2024-01-02')
          UNION ALL SELECT search_id, 'final' FROM searches WHERE delivery_mode = 'final' AND report_email <> ''
            AND status IN ('active', 'completed') AND date_end < DATE '2024-01-02' AND (last_report IS NULL OR last_report < date_end)) r
        ON r.search_id = m.search_id WHERE r.mode = 'final' OR m.found_at::DATE = DATE '2024-01-02' GROUP BY 1, 2"""
    ),
)
def reports_due(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-02 08:00:00").cast("timestamp_ntz")
    rows = lifecycle.report_matches(X.searches(spark), X.matches(spark, sf), now)
    return rows.groupBy("search_id", "mode").agg(F.count(F.lit(1)).alias("n_matches"))


def _edited(spark: SparkSession) -> DataFrame:
    """Search 1 gets a new keyword, 2 other media, 3 only a spacing and delivery change."""
    return X.searches(spark).withColumns(
        {
            "keywords": F.when(F.col("search_id") == 1, F.array(F.lit("that"))).otherwise(F.col("keywords")),
            "media_types": F.when(F.col("search_id") == 2, F.array(F.lit("tv"), F.lit("radio"))).otherwise(F.col("media_types")),
            "dedup_channel": F.when(F.col("search_id") == 3, F.lit(False)).otherwise(F.col("dedup_channel")),
            "delivery_mode": F.when(F.col("search_id") == 3, F.lit("final")).otherwise(F.col("delivery_mode")),
        }
    )


@query(
    "reinit_searches",
    O.with_ctes("SELECT search_id, count(*) AS n_matches FROM matches WHERE search_id NOT IN (1, 2) GROUP BY 1"),
)
def reinit_searches(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that survive an edit of the searches."""
    stale = lifecycle.to_rescan(X.searches(spark), _edited(spark))
    left = lifecycle.without_rescanned(X.matches(spark, sf), stale)
    return left.groupBy("search_id").agg(F.count(F.lit(1)).alias("n_matches"))


@query(
    "news_due",
    O.with_ctes(
        """SELECT s.search_id, count(a.page_id) AS n_articles FROM searches s LEFT JOIN articles a
        ON a.published::DATE = DATE '2024-01-02' WHERE s.date_end >= DATE '2024-01-02' AND s.search_id % 2 = 0
        AND (s.search_id <> 4) GROUP BY 1"""
    ),
)
def news_due(spark: SparkSession, sf: str) -> DataFrame:
    """Even-numbered searches also cover news; number 4 was fetched ten minutes ago."""
    now = F.lit("2024-01-02 08:00:00").cast("timestamp_ntz")
    searches = X.searches(spark).withColumns(
        {
            "media_types": F.when(F.col("search_id") % 2 == 0, F.array_append("media_types", F.lit("news"))).otherwise(F.col("media_types")),
            "news_last_fetch": F.when(F.col("search_id") == 4, now - F.make_dt_interval(mins=F.lit(10))),
        }
    )
    per_day = X.articles(spark, sf).groupBy(F.to_date("published").alias("day")).agg(F.count(F.lit(1)).alias("n_articles"))
    due = lifecycle.news_due(searches, now).select("search_id", F.to_date(now).alias("day"))
    return due.join(per_day, "day", "left").na.fill(0, ["n_articles"]).select("search_id", "n_articles")


@query(
    "news_union",
    O.with_ctes(
        """SELECT search_id, CASE WHEN channel_id = 9001 THEN 'news' ELSE 'broadcast' END AS origin, count(*) AS n FROM (
          SELECT search_id, channel_id FROM matches
          UNION ALL SELECT k.search_id, 9001 FROM (SELECT DISTINCT published, CASE WHEN contains(title, 'que') THEN 'que' ELSE 'that' END AS keyword FROM articles) a
          JOIN kws k ON k.keyword = a.keyword)
        GROUP BY 1, 2"""
    ),
)
def news_union(spark: SparkSession, sf: str) -> DataFrame:
    """Broadcast matches together with the news landed for two keywords, keyed inserts included."""
    asked_for = F.when(F.contains("title", F.lit("que")), "que").otherwise("that")
    landed = X.articles(spark, sf).withColumn("keyword", asked_for)
    found = F.lit(X.NOW).cast("timestamp_ntz")
    news = lifecycle.news_matches(X.searches(spark), landed, found)
    fresh = matching.drop_known(news, X.matches(spark, sf))
    both = X.matches(spark, sf).unionByName(fresh, allowMissingColumns=True)
    origin = F.when(F.col("channel_id") == 9001, F.lit("news")).otherwise(F.lit("broadcast"))
    return both.groupBy("search_id", origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))
