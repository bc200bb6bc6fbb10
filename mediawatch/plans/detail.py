"""Search detail, dashboard, export and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.operators import detail, outbox
from mediawatch.plans import oracle as O
from mediawatch.plans.matching import _AT, _LOCATED
from mediawatch.plans.registry import query

_FACETS = """search_id = 1 AND keyword IN ('that') AND ts >= DATE '2024-01-01' AND ts < DATE '2024-01-03' + INTERVAL 1 DAY
    AND (channel_id < 27 OR (channel_id >= 27 AND channel_id < 52)) AND EXISTS (SELECT 1 FROM programmes p
      WHERE p.channel_name = m.channel_name AND p.start_ts <= m.ts AND p.stop_ts > m.ts AND p.title IN ('prog_1', 'prog_2', 'prog_3'))"""


@query("facet_filter", O.with_ctes(f"SELECT match_id, keyword, channel_name, ts FROM matches m WHERE {_FACETS}"))
def facet_filter(spark: SparkSession, sf: str) -> DataFrame:
    own = X.matches(spark, sf).filter("search_id = 1")
    return detail.facet_filter(
        own,
        keywords=["that"],
        media=["tv", "radio"],
        date_from="2024-01-01",
        date_to="2024-01-03",
        titles=["prog_1", "prog_2", "prog_3"],
        programmes=X.programmes(spark, sf),
    ).select("match_id", "keyword", "channel_name", "ts")


@query("keyword_stats", O.with_ctes("SELECT search_id, keyword, count(*) AS n FROM matches GROUP BY 1, 2"))
def keyword_stats(spark: SparkSession, sf: str) -> DataFrame:
    return detail.counts_by(X.matches(spark, sf), "keyword")


@query("channel_stats", O.with_ctes("SELECT search_id, channel_name, count(*) AS n FROM matches GROUP BY 1, 2"))
def channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    return detail.counts_by(X.matches(spark, sf), "channel_name")


@query(
    "heatmap",
    O.with_ctes(
        f"""SELECT d.search_id, d.day, h.hour, count(m.match_id) AS n FROM
        (SELECT search_id, unnest(generate_series(date_start::TIMESTAMP,
           greatest(least(DATE '{X.TODAY}', date_end), date_start)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM searches) d,
        (SELECT unnest(range(0, 24))::INT AS hour) h
        LEFT JOIN matches m ON m.search_id = d.search_id AND m.ts::DATE = d.day AND hour(m.ts) = h.hour
        GROUP BY 1, 2, 3"""
    ),
)
def heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return detail.heatmap(X.matches(spark, sf), X.searches(spark), X.today())


@query(
    "heatmap_days",
    O.with_ctes(
        f"""SELECT search_id, day, string_agg(n, ',' ORDER BY hour) AS hours, max(max(n)) OVER (PARTITION BY search_id) AS max_n FROM (
        SELECT d.search_id, d.day, h.hour, count(m.match_id) AS n FROM
        (SELECT search_id, unnest(generate_series(date_start::TIMESTAMP,
           greatest(least(DATE '{X.TODAY}', date_end), date_start)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM searches) d,
        (SELECT unnest(range(0, 24))::INT AS hour) h
        LEFT JOIN matches m ON m.search_id = d.search_id AND m.ts::DATE = d.day AND hour(m.ts) = h.hour
        GROUP BY 1, 2, 3) GROUP BY search_id, day"""
    ),
)
def heatmap_days(spark: SparkSession, sf: str) -> DataFrame:
    cells = detail.heatmap(X.matches(spark, sf), X.searches(spark), X.today())
    hours = F.array_join(F.transform("hours", lambda n: n.cast("string")), ",")
    return detail.heatmap_rows(cells).select("search_id", "day", hours.alias("hours"), "max_n")


@query(
    "dashboard_counts",
    O.with_ctes(
        """SELECT s.search_id, s.name, u.name AS owner, count(m.match_id) AS n_matches,
        CASE s.status WHEN 'active' THEN 0 WHEN 'paused' THEN 1 WHEN 'completed' THEN 2 ELSE 3 END AS status_rank
        FROM searches s JOIN users u ON u.user_id = s.user_id LEFT JOIN matches m ON m.search_id = s.search_id
        GROUP BY ALL"""
    ),
)
def dashboard_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = detail.search_list(X.searches(spark), X.matches(spark, sf), X.users(spark))
    return rows.select("search_id", "name", "owner", "n_matches", "status_rank")


@query(
    "dashboard_totals",
    O.with_ctes(
        f"""SELECT (SELECT count(*) FROM searches) AS total_searches,
        (SELECT count(*) FROM searches WHERE status = 'active' AND date_end >= DATE '{X.TODAY}') AS active_searches,
        (SELECT count(*) FROM matches) AS total_matches, (SELECT count(*) FROM users) AS total_users"""
    ),
)
def dashboard_totals(spark: SparkSession, sf: str) -> DataFrame:
    return detail.dashboard_totals(X.searches(spark), X.matches(spark, sf), X.users(spark), X.today())


@query(
    "user_scope",
    O.with_ctes(
        """SELECT s.user_id, s.search_id, count(m.match_id) AS n_matches FROM searches s
        LEFT JOIN matches m ON m.search_id = s.search_id WHERE s.user_id = 2 GROUP BY 1, 2"""
    ),
)
def user_scope(spark: SparkSession, sf: str) -> DataFrame:
    own = detail.owned_searches(X.searches(spark), 2, is_admin=False)
    return detail.search_counts(own, X.matches(spark, sf)).select("user_id", "search_id", "n_matches")


@query(
    "user_counts",
    O.with_ctes(
        """SELECT u.user_id, u.name, count(DISTINCT s.search_id) AS n_searches, count(m.match_id) AS n_matches FROM users u
        LEFT JOIN searches s ON s.user_id = u.user_id LEFT JOIN matches m ON m.search_id = s.search_id GROUP BY 1, 2"""
    ),
)
def user_counts(spark: SparkSession, sf: str) -> DataFrame:
    searches = X.searches(spark)
    per_user = detail.search_counts(searches, X.matches(spark, sf)).groupBy("user_id").agg(
        F.sum("n_matches").alias("n_matches")
    )
    users = detail.user_counts(X.users(spark), searches).select("user_id", "name", "n_searches")
    return users.join(per_user, "user_id", "left").na.fill(0, ["n_matches"])


@query(
    "recent_matches",
    O.with_ctes(
        """SELECT m.match_id, m.ts, m.keyword, s.name AS search_name, u.name AS owner FROM matches m
        JOIN searches s ON s.search_id = m.search_id JOIN users u ON u.user_id = s.user_id
        ORDER BY m.ts DESC, m.match_id DESC LIMIT 25"""
    ),
)
def recent_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = detail.recent_matches(X.matches(spark, sf), X.searches(spark), X.users(spark))
    return rows.select("match_id", "ts", "keyword", "search_name", "owner")


@query(
    "match_page",
    O.with_ctes(
        """SELECT match_id, ts, precise_ts, centered_text FROM enriched WHERE search_id = 1
        ORDER BY ts DESC, match_id DESC LIMIT 50 OFFSET 50""",
        _LOCATED,
    ),
)
def match_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = detail.match_page(X.matches(spark, sf), X.searches(spark), 1, page=2)
    return rows.select("match_id", "ts", "precise_ts", "centered_text")


@query(
    "match_feed",
    O.with_ctes(
        """(SELECT 'after' AS mode, match_id, found_at FROM matches WHERE search_id = 1 AND match_id > 11000000000
          ORDER BY match_id LIMIT 100)
        UNION ALL (SELECT 'since', match_id, found_at FROM matches WHERE search_id = 1 AND found_at > TIMESTAMP '2024-01-01 12:00:00'
          ORDER BY found_at DESC, match_id DESC LIMIT 50)
        UNION ALL (SELECT 'latest', match_id, found_at FROM matches WHERE search_id = 3 ORDER BY found_at DESC, match_id DESC LIMIT 50)"""
    ),
)
def match_feed(spark: SparkSession, sf: str) -> DataFrame:
    m = X.matches(spark, sf)
    parts = [
        ("after", detail.match_feed(m, 1, after_id=11_000_000_000)),
        ("since", detail.match_feed(m, 1, since="2024-01-01 12:00:00")),
        ("latest", detail.match_feed(m, 3)),
    ]
    rows = [df.select(F.lit(mode).alias("mode"), "match_id", "found_at") for mode, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_NEAR = """(SELECT string_agg(c.text, ' ' ORDER BY c.ts, c.id) FROM chunks c WHERE c.channel_id = e.channel_id
    AND c.text NOT IN ('', '[~]') AND c.ts >= date_trunc('second', e.ts) - INTERVAL 15 SECOND
    AND c.ts < date_trunc('second', e.ts) + INTERVAL 15 SECOND)"""


@query(
    "nearby_text",
    O.with_ctes(f"SELECT match_id, md5(coalesce({_NEAR}, '')) AS context_md5 FROM matches e"),
)
def nearby_text(spark: SparkSession, sf: str) -> DataFrame:
    m = X.matches(spark, sf).select("match_id", "channel_id", "ts")
    rows = detail.nearby_text(m, X.chunks(spark, sf))
    return rows.select("match_id", F.md5("context").alias("context_md5"))


@query(
    "export_rows",
    O.with_ctes(
        rf"""SELECT search_id, substr(regexp_replace(search_name, '[\\/*?:\[\]]', '', 'g'), 1, 31) AS sheet, match_id,
        date_trunc('second', ts) AS signal_time, channel_name AS channel, coalesce({_AT}, '') AS programme, keyword,
        md5(matched_text) AS text_md5, md5(coalesce({_NEAR}, '')) AS context_md5, date_trunc('second', found_at) AS found_at
        FROM glued e"""
    ),
)
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = detail.export_rows(
        X.matches(spark, sf), X.searches(spark), X.programmes(spark, sf), X.chunks(spark, sf)
    )
    return rows.select(
        "search_id", "sheet", "match_id", "signal_time", "channel", "programme", "keyword",
        F.md5("matched_text").alias("text_md5"), F.md5("context").alias("context_md5"), "found_at",
    )


@query(
    "report_stats",
    O.with_ctes(
        """SELECT search_id, kind, label, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id, kind ORDER BY n DESC, label) AS rank FROM (
        SELECT search_id, 'keyword' AS kind, keyword AS label, count(*) AS n FROM matches GROUP BY ALL
        UNION ALL SELECT search_id, 'channel', channel_name, count(*) FROM matches GROUP BY ALL))
        WHERE kind = 'keyword' OR rank <= 5"""
    ),
)
def report_stats(spark: SparkSession, sf: str) -> DataFrame:
    return detail.report_stats(X.matches(spark, sf))


@query(
    "facet_values",
    O.with_ctes(
        """SELECT DISTINCT search_id, 'keyword' AS facet, keyword AS value FROM matches
        UNION ALL SELECT DISTINCT search_id, 'channel', channel_name FROM matches"""
    ),
)
def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    return detail.facet_values(X.matches(spark, sf))


@query(
    "alert_outbox",
    O.with_ctes(
        """SELECT m.match_id, 'email' AS channel, s.report_email AS recipient,
        'Alert: "' || m.keyword || '" heard on ' || m.channel_name AS subject, md5(m.matched_text) AS body_md5
        FROM glued m JOIN searches s ON s.search_id = m.search_id WHERE s.delivery_mode = 'immediate' AND s.report_email <> ''
        UNION ALL
        SELECT m.match_id, 'chat', coalesce(nullif(u.chat_id, ''), '900'), m.search_name, md5(substr(m.matched_text, 1, 300))
        FROM glued m JOIN searches s ON s.search_id = m.search_id JOIN users u ON u.user_id = s.user_id WHERE s.notify_chat"""
    ),
)
def alert_outbox(spark: SparkSession, sf: str) -> DataFrame:
    rows = outbox.alerts(X.matches(spark, sf), X.searches(spark), X.users(spark), global_chat="900")
    return rows.select("match_id", "channel", "recipient", "subject", F.md5("body").alias("body_md5"))


@query(
    "report_email_rows",
    O.with_ctes(
        """SELECT search_id, count(*) AS n_rows, md5(string_agg(keyword || '|' || channel_name || '|' ||
          strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || substr(matched_text, 1, 140), chr(10) ORDER BY found_at, match_id)) AS body_md5,
        max(total) AS total FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY found_at, match_id) AS rn,
          count(*) OVER (PARTITION BY search_id) AS total FROM glued) WHERE rn <= 1000 GROUP BY search_id"""
    ),
)
def report_email_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = outbox.email_report(X.matches(spark, sf))
    return rows.select("search_id", "n_rows", F.md5("body").alias("body_md5"), "total")


_LINES = """SELECT search_id, match_id, found_at, '• ' || strftime(ts, '%Y-%m-%d %H:%M') || ' · ' || channel_name || ' · <b>' || keyword ||
    '</b>: <i>' || replace(replace(replace(substr(matched_text, 1, 100), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</i>' AS line FROM glued"""
_ENDS = """SELECT *, row_number() OVER w AS rn, sum(length(line) + 1) OVER w AS stop_at, sum(length(line) + 1) OVER w - length(line) - 1 AS start_at
    FROM lines WINDOW w AS (PARTITION BY search_id ORDER BY found_at, match_id)"""
_BLOCKS = """SELECT search_id, 0::HUGEINT AS start_at FROM ends WHERE rn = 1
    UNION ALL SELECT b.search_id, min(e.start_at) FROM blocks b JOIN ends e ON e.search_id = b.search_id AND e.stop_at - b.start_at > 3800
    AND e.start_at > b.start_at GROUP BY b.search_id, b.start_at"""


@query(
    "chat_report_blocks",
    O.with_ctes(
        """SELECT e.search_id, b.start_at::BIGINT AS block, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY rn)) AS body_md5
        FROM ends e JOIN (SELECT search_id, start_at, lead(start_at) OVER (PARTITION BY search_id ORDER BY start_at) AS next_at FROM blocks) b
        ON b.search_id = e.search_id AND e.start_at >= b.start_at AND (b.next_at IS NULL OR e.start_at < b.next_at) GROUP BY 1, 2""",
        {"lines": _LINES, "ends": _ENDS, "blocks": _BLOCKS},
        ("blocks",),
    ),
)
def chat_report_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = outbox.chat_report(X.matches(spark, sf))
    return rows.select("search_id", "block", "n_lines", F.md5("body").alias("body_md5"))
