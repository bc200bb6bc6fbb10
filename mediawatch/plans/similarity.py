"""Near-duplicate spot queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediawatch import fixtures as X
from mediawatch.functions.marking import mark_fragment
from mediawatch.functions.text import FOLD_FROM, FOLD_TO
from mediawatch.operators import detail, similarity
from mediawatch.plans import oracle as O
from mediawatch.plans.matching import _LOCATED
from mediawatch.plans.registry import query


def _build_windows(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.windows(X.matches(spark, sf))


def _build_members(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.cluster_members(windows(spark, sf))


windows = partial(X._stored, "windows", _build_windows)
members = partial(X._stored, "members", _build_members)

_CTES = {
    "content": f"""SELECT search_id, match_id, row_number() OVER (PARTITION BY match_id ORDER BY ix) - 1 AS pos, n, wd FROM (
        SELECT search_id, match_id, ix, wd, {O.fold('wd')} AS n FROM (
          SELECT search_id, match_id, unnest(ws) AS wd, unnest(range(len(ws))) AS ix FROM (
            SELECT search_id, match_id, {O.word_list("concat_ws(' ', prev_text, cur_text, next_text)")} AS ws FROM matches)))
        WHERE n <> ''""",
    "mentions": f"""SELECT c.match_id, c.pos FROM (SELECT *, lead(n) OVER (PARTITION BY match_id ORDER BY pos) AS n2 FROM content) c
        JOIN (SELECT match_id, {O.fold("split_part(keyword, ' ', 1)")} AS k1, {O.fold("split_part(keyword, ' ', 2)")} AS k2 FROM matches) m
        ON m.match_id = c.match_id WHERE contains(c.n, m.k1) AND (m.k2 = '' OR contains(c.n2, m.k2))""",
    "anchor": """SELECT c.match_id, coalesce(min(m.pos), max(c.pos + 1) // 2) AS a FROM content c
        LEFT JOIN mentions m ON m.match_id = c.match_id GROUP BY 1""",
    "win": """SELECT c.search_id, c.match_id, c.pos - greatest(a.a - 50, 0) AS pos, c.n, c.wd FROM content c JOIN anchor a
        ON a.match_id = c.match_id WHERE c.pos >= a.a - 50 AND c.pos <= a.a + 50""",
    "local": """SELECT DISTINCT a.match_id, coalesce(m.pos, a.a) - greatest(a.a - 50, 0) AS ia FROM anchor a
        LEFT JOIN mentions m ON m.match_id = a.match_id AND m.pos >= a.a - 50 AND m.pos <= a.a + 50""",
    "lists": """SELECT search_id, match_id, list(n ORDER BY pos) AS ns FROM win GROUP BY 1, 2""",
    "grams": """SELECT DISTINCT search_id, match_id, array_to_string(ns[i:i + 4], ' ') AS shingle FROM (
        SELECT search_id, match_id, ns, unnest(range(1, len(ns) - 3)) AS i FROM lists WHERE len(ns) >= 5)""",
    "usable": """SELECT search_id, shingle, count(*) AS n_docs FROM grams GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 150""",
    "info": "SELECT search_id, match_id, list(n ORDER BY pos) AS ns, list(wd ORDER BY pos) AS os FROM win GROUP BY 1, 2",
    "anchs": "SELECT match_id, list(ia ORDER BY ia) AS ancs FROM local GROUP BY 1",
    "spot": """SELECT c.cluster_id, c.match_id, i.search_id, i.ns, i.os, a.ancs, length(g.matched_text) AS text_len, g.ts, g.channel_name
        FROM comps c JOIN info i ON i.match_id = c.match_id JOIN anchs a ON a.match_id = c.match_id JOIN glued g ON g.match_id = c.match_id""",
    "runkeys": """SELECT DISTINCT search_id, match_id, l || ' ' || array_to_string(ns[ia - l + 1 : ia], ' ') || ' | ' ||
        array_to_string(ns[ia + 2 : ia + 12 - l], ' ') AS key FROM (
        SELECT t.search_id, t.match_id, t.ns, a.ia, unnest(range(0, 12)) AS l FROM lists t JOIN local a ON a.match_id = t.match_id)
        WHERE ia - l >= 0 AND ia + 11 - l < len(ns)""",
    "twins": """SELECT DISTINCT x.search_id, x.match_id AS a, y.match_id AS b FROM runkeys x JOIN runkeys y
        ON x.search_id = y.search_id AND x.key = y.key AND x.match_id <> y.match_id""",
    "reach": """SELECT a, b FROM twins UNION SELECT r.a, t.b FROM reach r JOIN twins t ON t.a = r.b""",
    "comps": "SELECT a AS match_id, least(a, min(b)) AS cluster_id FROM reach GROUP BY a",
}


def _fragment_ctes(members: str) -> dict[str, str]:
    """The best lined-up run of a cluster's longest text with another member, and the fragment cut from it."""
    left, right = "least(ia, ib)", "least(len(a) - 1 - ia, len(b) - 1 - ib)"
    return {
        f"ref_{members}": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY text_len DESC, ts, match_id) AS rn
            FROM {members}) WHERE rn = 1""",
        f"pair_{members}": f"""SELECT cluster_id, os, ancs, a, match_id, ts, b, ia, unnest(ib_list) AS ib FROM (
            SELECT r.cluster_id, r.os, r.ancs, r.ns AS a, x.match_id, x.ts, x.ns AS b, x.ancs AS ib_list, unnest(r.ancs) AS ia
            FROM ref_{members} r JOIN {members} x ON x.cluster_id = r.cluster_id AND x.match_id <> r.match_id)""",
        f"run_{members}": f"""SELECT *,
            coalesce(list_min(list_filter(range(1, {left} + 1), lambda d: a[ia + 1 - d] <> b[ib + 1 - d])) - 1, {left}) AS lft,
            coalesce(list_min(list_filter(range(1, {right} + 1), lambda d: a[ia + 1 + d] <> b[ib + 1 + d])) - 1, {right}) AS rgt
            FROM pair_{members}""",
        f"best_{members}": f"""SELECT *, lft + rgt + 1 AS total, ia - lft AS st, ia + rgt AS en FROM run_{members}
            QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY lft + rgt DESC, ts, match_id, ia, ib) = 1""",
        f"cut_{members}": f"""SELECT *, CASE WHEN full_run THEN greatest(st, center - 13) ELSE st END AS cs FROM (SELECT *,
            en - st + 1 >= 0.9 * 101 AS full_run,
            coalesce(list_min(list_filter(ancs, lambda p: p >= st AND p <= en)), (st + en) // 2) AS center FROM best_{members})""",
        f"frag_{members}": f"""SELECT cluster_id, CASE WHEN total >= 12
            THEN array_to_string(os[cs + 1 : CASE WHEN full_run THEN least(en, cs + 25) ELSE en END + 1], ' ') ELSE '' END AS common_fragment
            FROM cut_{members}""",
    }


_CTES |= _fragment_ctes("spot")
_CTES |= {
    "folded": f"""SELECT s.search_id, f.cluster_id, list_transform({O.word_list('f.common_fragment')}, lambda w: {O.fold('w')}) AS fw
        FROM frag_spot f JOIN (SELECT DISTINCT cluster_id, search_id FROM spot) s ON s.cluster_id = f.cluster_id""",
    "grams12": """SELECT DISTINCT search_id, cluster_id, array_to_string(fw[i : i + 11], ' ') AS gram FROM (
        SELECT *, unnest(range(1, len(fw) - 10)) AS i FROM folded WHERE len(fw) >= 12)""",
    "clinks": """SELECT DISTINCT x.cluster_id AS a, y.cluster_id AS b FROM grams12 x JOIN grams12 y
        ON x.search_id = y.search_id AND x.gram = y.gram AND x.cluster_id <> y.cluster_id""",
    "creach": "SELECT a, b FROM clinks UNION SELECT r.a, t.b FROM creach r JOIN clinks t ON t.a = r.b",
    "cto": "SELECT a AS cluster_id, least(a, min(b)) AS to_id FROM creach GROUP BY a",
    "joined": """SELECT s.* REPLACE (coalesce(t.to_id, s.cluster_id) AS cluster_id) FROM spot s LEFT JOIN cto t ON t.cluster_id = s.cluster_id""",
    "chans": """SELECT search_id, cluster_id, coalesce(channel_name, '?') AS name, count(*) AS n, min(ts) AS f, max(ts) AS l
        FROM joined GROUP BY ALL""",
}
_CTES |= _fragment_ctes("joined")
_CTES |= {
    "spots": """SELECT c.search_id, c.cluster_id, sum(c.n)::BIGINT AS size, string_agg(c.name || ':' || c.n, ',' ORDER BY c.n DESC, c.name) AS channels,
        min(c.f) AS first_ts, max(c.l) AS last_ts, any_value(f.common_fragment) AS common_fragment
        FROM chans c LEFT JOIN frag_joined f ON f.cluster_id = c.cluster_id GROUP BY c.search_id, c.cluster_id""",
    "shown": """SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY size DESC, first_ts, cluster_id)::INT AS rank
        FROM spots WHERE size >= 2 QUALIFY rank <= 150""",
}
_LOOPS = ("reach", "creach")


@query(
    "spot_windows",
    O.with_ctes(
        """SELECT m.match_id, count(w.pos) AS n_words, md5(coalesce(string_agg(w.n, ' ' ORDER BY w.pos), '')) AS norm_md5,
        coalesce(any_value(l.anchors), '0') AS anchors FROM matches m LEFT JOIN win w ON w.match_id = m.match_id
        LEFT JOIN (SELECT match_id, string_agg(ia, ',' ORDER BY ia) AS anchors FROM local GROUP BY 1) l
        ON l.match_id = m.match_id GROUP BY 1""",
        _CTES,
    ),
)
def spot_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = similarity.windows(X.matches(spark, sf))
    anchors = F.array_join(F.transform("anchors", lambda a: a.cast("string")), ",")
    return rows.select(
        "match_id", F.size("norm").cast("bigint").alias("n_words"), F.md5(F.array_join("norm", " ")).alias("norm_md5"), anchors.alias("anchors")
    )


@query("shingle_candidates", O.with_ctes("SELECT search_id, shingle, n_docs FROM usable", _CTES))
def shingle_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.shingle_counts(windows(spark, sf), max_docs=150).filter("usable").select("search_id", "shingle", "n_docs")


@query("spot_links", O.with_ctes("SELECT DISTINCT a AS match_id, true AS strong FROM twins", _CTES))
def spot_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every linked match, and whether all its links have a lined-up run of at least 12 words."""
    wins = windows(spark, sf)
    links = similarity.scored_links(wins, similarity.spot_links(wins))
    ends = links.select(F.explode(F.array("a", "b")).alias("match_id"), "score")
    return ends.groupBy("match_id").agg((F.min("score") >= similarity.MIN_WORDS).alias("strong"))


@query(
    "spot_scores",
    O.with_ctes(
        """SELECT cluster_id, match_id, max(lft + rgt + 1)::INT AS score FROM run_joined GROUP BY 1, 2""", _CTES, _LOOPS
    ),
)
def spot_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Longest lined-up run of every member of a merged cluster with the cluster's longest text."""
    return similarity.scored_members(members(spark, sf))


@query("spot_components", O.with_ctes("SELECT match_id, cluster_id FROM comps", _CTES, ("reach",)))
def spot_components(spark: SparkSession, sf: str) -> DataFrame:
    """Transitive clusters before the fragment merge."""
    return similarity.clustered(windows(spark, sf)).select("match_id", "cluster_id")


@query("spot_components_uncapped", O.with_ctes("SELECT match_id, cluster_id FROM comps", _CTES, ("reach",)))
def spot_components_uncapped(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a cut that no shingle reaches: keys are then checked for a usable shingle, and all have one."""
    return similarity.clustered(windows(spark, sf), max_docs=10**9).select("match_id", "cluster_id")


@query(
    "spot_clusters",
    O.with_ctes(
        "SELECT search_id, cluster_id, size, common_fragment, channels, first_ts, last_ts FROM spots", _CTES, _LOOPS
    ),
)
def spot_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Merged clusters with size, fragment, channels and time span."""
    rows = similarity.cluster_report(members(spark, sf))
    channels = F.array_join(F.transform("channels", lambda c: F.concat(c["name"], F.lit(":"), c["count"].cast("string"))), ",")
    return rows.select("search_id", "cluster_id", "size", "common_fragment", channels.alias("channels"), "first_ts", "last_ts")


@query("spot_members", O.with_ctes("SELECT search_id, cluster_id, match_id FROM joined", _CTES, _LOOPS))
def spot_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the merged clusters."""
    return members(spark, sf).select("search_id", "cluster_id", "match_id")


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&#34;'), chr(39), '&#39;')"
_FOLDED = f"list_transform(regexp_extract_all({{}}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+'), lambda w: translate(lower(w), '{FOLD_FROM}', '{FOLD_TO}'))"
_MARKED = {
    **_LOCATED,
    **_CTES,
    "said": f"""SELECT j.cluster_id, j.match_id, s.rank, e.centered_text AS t, {_FOLDED.format('e.centered_text')} AS tw,
        {_FOLDED.format('s.common_fragment')} AS fw
        FROM joined j JOIN shown s ON s.cluster_id = j.cluster_id JOIN enriched e ON e.match_id = j.match_id""",
    "pos_t": "SELECT match_id, generate_subscripts(tw, 1) AS i, unnest(tw) AS w FROM said",
    "pos_f": "SELECT match_id, generate_subscripts(fw, 1) AS j, unnest(fw) AS w FROM said",
    "same": "SELECT a.match_id, a.i, a.i - b.j AS d FROM pos_t a JOIN pos_f b ON a.match_id = b.match_id AND a.w = b.w",
    "isles": """SELECT match_id, count(*) AS n, min(i) AS lo, max(i) AS hi FROM (
        SELECT *, i - row_number() OVER (PARTITION BY match_id, d ORDER BY i) AS g FROM same) GROUP BY match_id, d, g""",
    "longest": "SELECT * FROM isles QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY n DESC, lo) = 1",
    "cutat": r"""SELECT s.match_id, l.lo, l.hi, regexp_split_to_array(t, '[\p{L}\p{N}]+') AS gaps, regexp_extract_all(t, '[\p{L}\p{N}]+') AS ws
        FROM said s JOIN longest l ON l.match_id = s.match_id AND l.n >= least(4, len(s.fw))""",
    "sides": """SELECT match_id, array_to_string(list_transform(range(1, lo), lambda k: gaps[k] || ws[k]), '') || gaps[lo] AS head,
        ws[lo] || array_to_string(list_transform(range(lo + 1, hi + 1), lambda k: gaps[k] || ws[k]), '') AS inside,
        array_to_string(list_transform(range(hi + 1, len(ws) + 1), lambda k: gaps[k] || ws[k]), '') || gaps[-1] AS tail FROM cutat""",
}


@query(
    "spot_display",
    O.with_ctes(
        f"""SELECT s.cluster_id, s.match_id, s.rank, md5(CASE WHEN c.match_id IS NULL THEN {_ESCAPED.format('s.t')} ELSE
        {_ESCAPED.format('c.head')} || '<mark>' || {_ESCAPED.format('c.inside')} || '</mark>' || {_ESCAPED.format('c.tail')} END) AS html_md5
        FROM said s LEFT JOIN sides c ON c.match_id = s.match_id""",
        _MARKED,
        _LOOPS,
    ),
)
def spot_display(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the displayed clusters: centred text with the common fragment marked."""
    rows = members(spark, sf)
    shown = similarity.shown_clusters(similarity.cluster_report(rows), min_size=2)
    texts = detail.enrich(X.matches(spark, sf), X.searches(spark)).select("match_id", "centered_text")
    out = rows.select("cluster_id", "match_id").join(shown.select("cluster_id", "common_fragment", "rank"), "cluster_id")
    return out.join(texts, "match_id").select(
        "cluster_id", "match_id", "rank", F.md5(mark_fragment(F.col("centered_text"), F.col("common_fragment"))).alias("html_md5")
    )


@query(
    "spot_display_counts",
    O.with_ctes(
        """SELECT coalesce(r.search_id, u.search_id) AS search_id, coalesce(n_pairs, 0) AS pairs_hidden,
        greatest(coalesce(n_shown, 0) - 150, 0) AS clusters_truncated, greatest(coalesce(n_unique, 0) - 200, 0) AS unique_truncated FROM
        (SELECT search_id, count(*) FILTER (size = 2) AS n_pairs, count(*) FILTER (size >= 3) AS n_shown FROM spots GROUP BY 1) r FULL JOIN
        (SELECT search_id, count(*) AS n_unique FROM matches WHERE match_id NOT IN (SELECT match_id FROM comps) GROUP BY 1) u
        ON u.search_id = r.search_id""",
        _CTES,
        _LOOPS,
    ),
)
def spot_display_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = members(spark, sf)
    unique = similarity.unique_matches(X.matches(spark, sf).select("match_id", "search_id"), rows)
    return similarity.display_counts(similarity.cluster_report(rows), unique, unique_cap=200)


@query(
    "unique_matches",
    O.with_ctes(
        "SELECT match_id, search_id, ts FROM matches WHERE match_id NOT IN (SELECT match_id FROM comps)", _CTES, ("reach",)
    ),
)
def unique_matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = similarity.unique_matches(X.matches(spark, sf), members(spark, sf))
    return rows.select("match_id", "search_id", "ts")


@query(
    "report_staleness",
    O.with_ctes(
        """SELECT search_id, count(*) FILTER (ts < TIMESTAMP '2024-01-02') AS match_count, count(*) AS current_count,
        count(*) FILTER (ts < TIMESTAMP '2024-01-02') <> count(*) AS stale FROM matches GROUP BY 1"""
    ),
)
def report_staleness(spark: SparkSession, sf: str) -> DataFrame:
    """Reports stored on the second day against all matches."""
    m = X.matches(spark, sf)
    early = F.count_if(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).alias("match_count")
    stored = m.groupBy("search_id").agg(early)
    return similarity.staleness(stored, m).select("search_id", "match_count", "current_count", "stale")
