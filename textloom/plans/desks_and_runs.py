"""Listing pages by section; runs, their events and who may see them. Orders stand for runs, line items for their events,
customers for profiles, and nations for organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import links as H
from ..operators import runs as R
from . import news as N
from . import tables as T
from .registry import query

SECTIONS = {"toi": ("business", "world", "sports"), "reuters": ("business", "technology", ""), "guardian": ("sport", "world", "")}
#: Links in those sections; {n} is the page's number.
MORE = (
    '<a href="/business/a/articleshow/{n}1.cms">a</a><a href="/BUSINESS/b/articleshow/{n}2.cms">b</a><a href="https://timesofindia.indiatimes.com/business/c/articleshow/{n}3.cms">c</a><a href="/sports/d/articleshow/{n}4.cms">d</a>',
    '<a href="/business/energy/oil-rises-{n}">e</a><a href="/business/energy/x/oil-falls-{n}">f</a><a href="/technology/chips-ABC{n}DEF/">g</a><a href="https://www.reuters.com/technology/live/x-ABCDEFG">h</a><a href="/item-IDABCDE{n}/">i</a><a href="/a/item-IDABCDE{n}/">i</a><a href="/item-IDABCDE{n}">j</a>',
    '<a href="/sport/2024/jan/1/a{n}">k</a><a href="/sport/2024/feb/1/b{n}">l</a><a href="/sport/2023/feb/1/c{n}">m</a><a href="/sport/2024/feb/2/d{n}">m</a><a href="/sport/2024/mar/2/e{n}">m</a><a href="/sport/2022/mar/2/f{n}">m</a><a href="/world/2024/dec/2/g{n}">m</a><a href="/sport/video/2024/dec/2/h{n}">m</a>',
    "",
)


def _rules() -> dict[str, H.LinkRule]:
    return {f"{name}:{section}": H.of_section(name, section) for name, sections in SECTIONS.items() for section in sections}


_PG = N._LISTINGS.replace("coalesce(html, '') AS html", f"replace({N._pick_sql(MORE, 'page_id')}, '{{n}}', CAST(page_id AS VARCHAR)) || coalesce(html, '') AS html")


@query(f"WITH {_PG} " + " UNION ALL ".join(N._rule_sql(n, r) for n, r in _rules().items()))
def section_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the listing pages of several sections."""
    i = F.col("page_id")
    three = [F.replace(N._pick(N.LISTING, i + k), F.lit("{n}"), i.cast("string")) for k in range(3)]
    more = F.replace(N._pick(MORE, i), F.lit("{n}"), i.cast("string"))
    pages = T.table(spark, sf_dir, "pages").select("page_id", F.concat(*three, more, F.coalesce("html", F.lit(""))).alias("html"))
    return H.by_publisher(pages, rules=_rules()).withColumn("pos", F.col("pos").cast("long"))


STATUS = {"O": "running", "F": "queued", "P": "stopping"}
_DAY = 86400
#: How long each status may be silent: the tables know days alone.
LIMITS = {"queued": 60 * _DAY, "stopping": 30 * _DAY, "running": 20 * _DAY}


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 9 == 0, "completed").otherwise(F.element_at(F.create_map(*(F.lit(x) for p in STATUS.items() for x in p)), F.col("o_orderstatus")))
    created = F.col("o_orderdate").cast("timestamp")
    return T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 25).cast("int").alias("org_id"), status.alias("status"), created.alias("created_at"), F.when(F.col("o_orderkey") % 5 == 0, F.timestamp_seconds(F.unix_timestamp(created) + 90 * _DAY)).alias("started_at"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "lineitem").where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")).alias("event_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"))


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").cast("int").alias("org_id"))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items())
_RUNS = f"""rn AS (SELECT o_orderkey AS run_id, CAST(o_custkey % 25 AS INT) AS org_id, CASE WHEN o_orderkey % 9 = 0 THEN 'completed' ELSE CASE o_orderstatus {_CASES} END END AS status,
 CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 DAY END AS started_at FROM orders),
ev AS (SELECT l_orderkey AS run_id, CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS event_id, CAST(l_shipdate AS TIMESTAMP) AS created_at FROM lineitem WHERE l_orderkey % 4 > 0)"""
#: "Now" of the query.
NOW = 883612800


@query(f"""WITH {_RUNS}, ls AS (SELECT run_id, arg_max(created_at, (event_id, created_at)) AS event_at FROM ev GROUP BY 1),
ac AS (SELECT run_id, status, CAST(epoch(greatest(created_at, started_at, event_at)) AS BIGINT) AS activity_s FROM rn LEFT JOIN ls USING (run_id))
SELECT run_id, status, activity_s FROM ac WHERE {NOW} - activity_s >= CASE status WHEN 'queued' THEN {LIMITS['queued']} WHEN 'stopping' THEN {LIMITS['stopping']} WHEN 'running' THEN {LIMITS['running']} END""")
def abandoned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active runs whose start, creation and last event are all too long ago."""
    rows = R.abandoned(_runs(spark, sf_dir), _events(spark, sf_dir), F.timestamp_seconds(F.lit(NOW)), LIMITS)
    return rows.select("run_id", "status", F.unix_timestamp("activity").alias("activity_s"))


@query(f"""WITH {_RUNS}, br AS (SELECT org_id, run_id, count(event_id) AS n FROM rn LEFT JOIN ev USING (run_id) GROUP BY 1, 2), bo AS (SELECT org_id, count(*) AS n_runs, sum(n) AS n_events FROM br GROUP BY 1)
SELECT c_custkey AS profile_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(n_events, 0) AS BIGINT) AS n_events FROM customer LEFT JOIN bo ON org_id = c_nationkey""")
def visible_to_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs and events each profile may see."""
    return R.visible_counts(_events(spark, sf_dir), _runs(spark, sf_dir), _profiles(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT ev.run_id, event_id FROM ev JOIN rn USING (run_id) JOIN customer ON c_custkey = 1 AND c_nationkey = org_id WHERE status IN ('queued', 'running', 'stopping')")
def visible_active_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of active runs that one reader may see."""
    return R.visible_events(_events(spark, sf_dir), R.active(_runs(spark, sf_dir)), _profiles(spark, sf_dir), F.lit(1)).select("run_id", "event_id")
