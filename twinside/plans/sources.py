"""Queries S-*: feeds, stores and gates on sources.

The raw season feed is rebuilt from the contests with the blemishes real files
have: padded and foreign names, two date styles, unplayed and broken rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from twinside.functions.numbers import to_number
from twinside.plans.base import query
from twinside.session import work_path
from twinside.sources import feeds, store
from twinside.sources.tables import contests, table
from twinside.operators.aggregates import profile
from twinside.operators.sides import side_rows
from twinside.sources.tables import METRICS

NAMES = {"N-One": "NATION_1", "N-Two": "NATION_2"}
ZONE = "Europe/London"
FEED = [
    "event_id", "season", "feed", "Div", "Date", "Time", "HomeTeam", "AwayTeam", "Referee",
    "FTHG", "FTAG", "HF", "AF", "HC", "AC", "HY", "AY", "B365H", "B365A",
]


def raw_feed(spark, root) -> DataFrame:
    c = contests(spark, root)
    every = lambda n: F.col("event_id") % n == 0
    whole = lambda col: F.coalesce(F.col(col).cast("bigint").cast("string"), F.lit(""))
    padded = lambda side: F.when(F.col(side) == "NATION_1", " N-One ").when(F.col(side) == "NATION_2", "N-Two").when(
        every(3), F.concat(F.lit(" "), F.col(side), F.lit(" "))
    ).otherwise(F.col(side))
    price = lambda col: (F.col(col) / 4 + 1.5).cast("string")
    return c.select(
        "event_id",
        "season",
        F.substring("season", 3, 5).alias("feed"),
        F.when(every(61), "D2").otherwise("D1").alias("Div"),
        F.when(every(59), "soon").when(every(2), F.date_format("event_date", "dd/MM/yyyy")).otherwise(F.date_format("event_date", "dd/MM/yy")).alias("Date"),
        F.col("kickoff_time").alias("Time"),
        padded("side_a").alias("HomeTeam"),
        F.when(every(67), "").otherwise(padded("side_b")).alias("AwayTeam"),
        F.coalesce(F.concat(F.lit("  "), F.col("official"), F.lit(" ")), F.lit("")).alias("Referee"),
        F.when(every(40), "").otherwise(whole("a_score")).alias("FTHG"),
        F.when(every(40) | every(41), "").otherwise(whole("b_score")).alias("FTAG"),
        F.when(every(43), "n/a").when(every(47), "-3").otherwise(whole("a_qty")).alias("HF"),
        whole("b_qty").alias("AF"),
        F.when(every(53), "2.5").otherwise(whole("a_lines")).alias("HC"),
        whole("b_lines").alias("AC"),
        whole("a_bulk").alias("HY"),
        whole("b_bulk").alias("AY"),
        price("a_lines").alias("B365H"),
        price("b_lines").alias("B365A"),
    )


def _padded(side):
    return f"CASE WHEN {side} = 'NATION_1' THEN ' N-One ' WHEN {side} = 'NATION_2' THEN 'N-Two' WHEN event_id % 3 = 0 THEN ' ' || {side} || ' ' ELSE {side} END"


def _whole(col):
    return f"coalesce(CAST(CAST({col} AS BIGINT) AS VARCHAR), '')"


RAW = f""", raw AS (SELECT event_id, season, substr(season, 3, 5) AS feed,
  CASE WHEN event_id % 61 = 0 THEN 'D2' ELSE 'D1' END AS Div,
  CASE WHEN event_id % 59 = 0 THEN 'soon' WHEN event_id % 2 = 0 THEN strftime(event_date, '%d/%m/%Y') ELSE strftime(event_date, '%d/%m/%y') END AS "Date",
  kickoff_time AS "Time", {_padded('side_a')} AS HomeTeam, CASE WHEN event_id % 67 = 0 THEN '' ELSE {_padded('side_b')} END AS AwayTeam,
  coalesce('  ' || official || ' ', '') AS Referee,
  CASE WHEN event_id % 40 = 0 THEN '' ELSE {_whole('a_score')} END AS FTHG,
  CASE WHEN event_id % 40 = 0 OR event_id % 41 = 0 THEN '' ELSE {_whole('b_score')} END AS FTAG,
  CASE WHEN event_id % 43 = 0 THEN 'n/a' WHEN event_id % 47 = 0 THEN '-3' ELSE {_whole('a_qty')} END AS HF, {_whole('b_qty')} AS AF,
  CASE WHEN event_id % 53 = 0 THEN '2.5' ELSE {_whole('a_lines')} END AS HC, {_whole('b_lines')} AS AC,
  {_whole('a_bulk')} AS HY, {_whole('b_bulk')} AS AY,
  CAST(a_lines / 4 + 1.5 AS VARCHAR) AS B365H, CAST(b_lines / 4 + 1.5 AS VARCHAR) AS B365A, event_date AS real_date FROM contests)
"""
_name = lambda c: f"CASE trim({c}) WHEN 'N-One' THEN 'NATION_1' WHEN 'N-Two' THEN 'NATION_2' ELSE trim({c}) END"
PLAYED = f""", played AS (SELECT event_id, season, feed, {_name('HomeTeam')} AS HomeTeam, {_name('AwayTeam')} AS AwayTeam, trim(Referee) AS Referee,
  CASE WHEN "Date" <> 'soon' THEN real_date END AS "Date", FTHG, FTAG, HF, HC FROM raw
  WHERE trim(HomeTeam) <> '' AND trim(AwayTeam) <> '' AND trim(FTHG) <> '' AND trim(FTAG) <> '')
"""


def written_feed(spark, root) -> str:
    """The raw feed as one CSV folder per season below the shared folder.

    Seasons that begin in an odd year have another order of columns, lack the
    second price, and are not UTF-8.
    """
    path = work_path(spark, "feed")
    rows = raw_feed(spark, root).withColumn("Town", F.concat(F.lit("Málaga "), "event_id"))
    odd = F.substring("season", 4, 1).cast("int") % 2 == 1
    text = dict(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows.filter(~odd).drop("season").write.partitionBy("feed").csv(path, **text)
    other = rows.filter(odd).drop("season", "B365A")
    other.select("Town", *reversed([c for c in other.columns if c not in ("Town", "feed")]), "feed").write.partitionBy("feed").mode("append").csv(
        path, encoding="ISO-8859-1", **text
    )
    return path


@query(
    "S_01_csv_scan",
    RAW + """SELECT event_id, HomeTeam, CASE WHEN AwayTeam <> '' THEN AwayTeam END AS AwayTeam, "Date", Div,
    CASE WHEN FTHG <> '' THEN FTHG END AS FTHG, B365H, CASE WHEN CAST(substr(season, 4, 1) AS BIGINT) % 2 = 0 THEN B365A END AS B365A, 'Málaga ' || event_id AS Town FROM raw""",
)
def csv_scan(spark, root):
    path = written_feed(spark, root)
    got = feeds.read_feed(spark, path)
    text = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return got.select(F.col("event_id").cast("bigint"), "HomeTeam", text("AwayTeam"), "Date", "Div", text("FTHG"), "B365H", "B365A", "Town")


@query("S_02_header_cleaning", "SELECT event_id, side_a AS HomeTeam, side_b AS AwayTeam FROM contests")
def headers(spark, root):
    from twinside.functions.text import clean_header

    dirty = contests(spark, root).select(
        F.col("event_id").alias("﻿event_id"), F.col("side_a").alias("ï»¿HomeTeam"), F.col("side_b").alias(" AwayTeam ")
    )
    return dirty.toDF(*[clean_header(c) for c in dirty.columns])


@query(
    "S_03_season_from_path",
    "SELECT '20' || substr(season, 3, 5) AS season, count(*) AS row_count FROM contests GROUP BY season",
)
def season_files(spark, root):
    got = feeds.read_feed(spark, written_feed(spark, root))
    return got.groupBy(feeds.season_of_path(F.col("_path"), depth=2).alias("season")).agg(F.count("*").alias("row_count"))


@query(
    "S_04_normalized_feed",
    RAW + PLAYED + 'SELECT event_id, feed, HomeTeam, AwayTeam, Referee, "Date", FTHG, FTAG FROM played',
)
def normalized(spark, root):
    got = feeds.normalize_feed(raw_feed(spark, root), NAMES)
    return got.select("event_id", "feed", "HomeTeam", "AwayTeam", "Referee", "Date", "FTHG", "FTAG")


@query(
    "S_05_json_fixtures",
    """SELECT 1 + event_id % 38 AS match_round, CAST(t AS DATE) AS event_date, strftime(t, '%H:%M') AS kickoff_time, side_a, side_b, event_id AS source_number
    FROM (SELECT *, timezone('Europe/London', timezone('UTC', event_date + CAST(kickoff_time || ':00' AS TIME))) AS t FROM contests)""",
)
def json_fixtures(spark, root):
    path = work_path(spark, "fixtures")
    contests(spark, root).select(
        F.col("event_id").alias("MatchNumber"),
        (F.col("event_id") % 38 + 1).alias("RoundNumber"),
        F.concat(F.date_format("event_date", "yyyy-MM-dd"), F.lit(" "), F.col("kickoff_time"), F.lit(":00Z")).alias("DateUtc"),
        F.col("side_a").alias("HomeTeam"),
        F.col("side_b").alias("AwayTeam"),
    ).write.json(path)
    return feeds.read_fixture_feed(spark, path, ZONE, NAMES)


CODES = {i: f"NATION_{i}" for i in range(25)}
NOW = "2000-12-31 23:59:59"


@query(
    "S_06_played_union",
    """, copies AS (
      SELECT event_id // 3 AS match_id, event_id AS load_order, event_id % 7 <> 0 AS finished,
        CASE WHEN event_id % 5 = 0 THEN 'Cup' ELSE ' League ' END AS tournament, event_date + CAST(kickoff_time || ':00' AS TIME) AS utc,
        side_a, side_b, a_score FROM contests),
    newest AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY load_order DESC) AS rn FROM copies WHERE finished)
    SELECT match_id, side_a AS HomeTeam, side_b AS AwayTeam, a_score AS home_score, load_order FROM newest
    WHERE rn = 1 AND lower(trim(tournament)) = 'league' AND utc <= TIMESTAMP '2000-12-31 23:59:59'""",
)
def played_union(spark, root):
    c = contests(spark, root)
    code = lambda s: F.regexp_extract(s, r"(\d+)$", 1)
    rows = c.select(
        F.expr("event_id div 3").alias("match_id"),
        F.col("event_id").alias("load_order"),
        F.when(F.col("event_id") % 7 != 0, "True").otherwise("0").alias("finished"),
        F.when(F.col("event_id") % 5 == 0, "Cup").otherwise(" League ").alias("tournament"),
        F.concat(F.col("event_date").cast("string"), F.lit(" "), F.col("kickoff_time"), F.lit(":00")).alias("kickoff_time"),
        code("side_a").alias("home_team"),
        code("side_b").alias("away_team"),
        F.col("a_score").alias("home_score"),
    )
    now = F.lit(NOW).cast("timestamp_ntz")
    got = feeds.played_union(rows, CODES, now, ["league", "main league"], ["load_order"], ZONE)
    return got.select("match_id", "HomeTeam", "AwayTeam", "home_score", "load_order")


@query(
    "S_07_foreign_schema",
    """SELECT event_id AS match_id, CAST(a_score AS VARCHAR) AS FTHG, CAST(b_score AS VARCHAR) AS FTAG,
    CASE WHEN a_score > b_score THEN 'H' WHEN a_score < b_score THEN 'A' ELSE 'D' END AS FTR, CAST(NULL AS VARCHAR) AS HTHG, CAST(NULL AS VARCHAR) AS HTR
    FROM contests""",
)
def foreign(spark, root):
    rows = contests(spark, root).select(
        F.col("event_id").alias("match_id"), F.col("a_score").cast("string").alias("home_score"), F.col("b_score").cast("string").alias("away_score")
    )
    return feeds.foreign_to_core(rows, {"home_score": "FTHG", "away_score": "FTAG"}, ["match_id", "FTHG", "FTAG", "FTR", "HTHG", "HTR"])


@query(
    "S_08_enrichment",
    """SELECT c.event_id, CASE WHEN c.event_id % 3 = 0 THEN CASE WHEN c.event_id % 2 = 0 THEN 'Old official' WHEN c.event_id % 5 = 0 THEN 'Appointed' END
      ELSE coalesce(official, CASE WHEN c.event_id % 2 = 0 THEN 'Old official' WHEN c.event_id % 5 = 0 THEN 'Appointed' END) END AS official,
      CASE WHEN c.event_id % 2 = 0 THEN CAST(a_lines AS DOUBLE) END AS odds FROM contests c""",
)
def enrichment(spark, root):
    c = contests(spark, root)
    fresh = c.select("event_id", F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("official")).alias("official"))
    old = c.filter("event_id % 2 = 0").select("event_id", F.lit("Old official").alias("official"), F.col("a_lines").cast("double").alias("odds"))
    appointed = c.filter("event_id % 5 = 0").select("event_id", F.lit("Appointed").alias("official"))
    return feeds.enrich(fresh, old, ["event_id"], "official", appointed)


@query(
    "S_09_acceptance_gate",
    RAW + "SELECT count(*) > 0 AS accepted, count(*) AS played, CASE WHEN count(*) = 0 THEN 'no played rows' END AS reason FROM raw WHERE FTHG <> '' AND FTAG <> ''",
)
def acceptance(spark, root):
    return feeds.acceptance(raw_feed(spark, root))


@query(
    "S_10_freshness_guard",
    RAW + """SELECT count(*) FILTER (FTHG <> '' AND FTAG <> '') AS fresh_played,
      count(*) FILTER (FTHG <> '' AND FTAG <> '' AND event_id % 3 <> 0) AS cached_played, count(*) AS due,
      count(*) FILTER (FTHG <> '' AND FTAG <> '') >= count(*) FILTER (FTHG <> '' AND FTAG <> '' AND event_id % 3 <> 0)
        AND count(*) FILTER (FTHG <> '' AND FTAG <> '') <= count(*) AS accepted FROM raw""",
)
def freshness(spark, root):
    fresh = raw_feed(spark, root)
    return feeds.freshness(fresh, fresh.filter("event_id % 3 <> 0"), contests(spark, root))


@query("S_11_table_export", "SELECT event_id, season, side_a, side_b FROM contests")
def export(spark, root):
    path = work_path(spark, "export")
    store.export_tables({"contests": contests(spark, root)}, path, "csv")
    got = spark.read.csv(f"{path}/contests", header=True)
    return got.select(F.col("event_id").cast("bigint"), "season", "side_a", "side_b")


@query("S_12_season_replace", "SELECT season, count(*) AS row_count, sum(CASE WHEN season = '1997-98' THEN 1 ELSE 0 END)::BIGINT AS replaced FROM contests GROUP BY season")
def season_replace(spark, root):
    path = work_path(spark, "by-season")
    rows = contests(spark, root).select("season", "event_id", F.lit(0).alias("version"))
    store.replace_seasons(rows, path)
    again = rows.filter("season = '1997-98'").withColumn("version", F.lit(1))
    store.replace_seasons(again, path)
    store.replace_seasons(again, path)
    return spark.read.parquet(path).groupBy("season").agg(F.count("*").alias("row_count"), F.sum("version").alias("replaced"))


@query("S_13_replace_with_schema", "SELECT event_id, side_a || ' v ' || side_b AS label FROM contests")
def replace_schema(spark, root):
    path = work_path(spark, "replaced")
    c = contests(spark, root)
    store.replace_table(c.select("event_id", "a_score"), path)
    store.replace_table(c.select("event_id", F.concat_ws(" v ", "side_a", "side_b").alias("label")), path)
    return spark.read.parquet(path)


@query(
    "S_14_upsert",
    """, u AS (SELECT event_id // 4 AS id, event_id AS loaded, side_a, 0 AS fresh FROM contests WHERE event_id % 2 = 0
      UNION ALL SELECT event_id // 4, event_id, side_b, 1 FROM contests WHERE event_id % 2 = 1)
    SELECT id, loaded, side FROM (SELECT id, loaded, side_a AS side, row_number() OVER (PARTITION BY id ORDER BY fresh DESC, loaded DESC) AS rn FROM u) WHERE rn = 1""",
)
def upsert(spark, root):
    rows = contests(spark, root).withColumn("id", F.expr("event_id div 4"))
    pick = lambda df, side: df.select("id", F.col("event_id").alias("loaded"), F.col(side).alias("side"))
    stored = pick(rows.filter("event_id % 2 = 0"), "side_a")
    return store.upsert(stored, pick(rows.filter("event_id % 2 = 1"), "side_b"), ["id"], "loaded")


@query(
    "S_15_source_log",
    """SELECT 'contests' AS table_name, count(*) AS row_count FROM contests UNION ALL SELECT 'sides', count(*) FROM sides
    UNION ALL SELECT 'season_profile', count(*) FROM (SELECT DISTINCT season, side FROM sides)""",
)
def source_log(spark, root):
    c = contests(spark, root)
    rows = side_rows(c, METRICS)
    return store.source_log({"contests": c, "sides": rows, "season_profile": profile(rows, ["season", "side"], METRICS)})


@query(
    "S_16_html_facts",
    r""", blocks AS (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS pos FROM (
        SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>|<p[^>]*>.*?</p>') AS b FROM pages)),
    texts AS (SELECT page_id, pos, regexp_matches(block, '^<h') AS is_heading, trim(regexp_replace(regexp_replace(block, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM blocks),
    carried AS (SELECT *, last_value(CASE WHEN is_heading THEN t END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM texts)
    SELECT page_id, pos, heading, regexp_extract(t, '^[A-Z][a-z]+ ([^.:]+)[.:]', 1) AS value FROM carried
    WHERE NOT is_heading AND regexp_matches(t, '^[A-Z][a-z]+ ([^.:]+)[.:]')""",
)
def html_facts(spark, root):
    return feeds.html_facts(table(spark, root, "pages"), r"^[A-Z][a-z]+ ([^.:]+)[.:]")


@query(
    "S_17_article_selection",
    """SELECT page_id AS id FROM pages WHERE regexp_matches(regexp_extract(html, '<title>([^<]*)', 1), '^T') AND regexp_matches(html, 'the')
    AND (page_id % 4 <> 0 OR page_id % 3 = 0)""",
)
def articles(spark, root):
    reference = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("id"))
    rows = table(spark, root, "pages").select(
        F.col("page_id").alias("id"),
        F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"),
        F.col("html").alias("body"),
        F.when(F.col("page_id") % 4 == 0, F.array(reference("season", F.col("page_id") % 3))).otherwise(
            F.array(reference("other", F.lit(1)))
        ).alias("references"),
    )
    return feeds.select_articles(rows, "^T", "the", {"season": "0"}).select("id")


@query("S_18_training_rows", "SELECT season, count(*) AS row_count, round(avg(qty_for), 6) AS target_mean FROM sides WHERE qty_for IS NOT NULL GROUP BY season")
def training(spark, root):
    rows = side_rows(contests(spark, root), METRICS)
    return store.training_rows(rows, "qty_for").groupBy("season").agg(F.count("*").alias("row_count"), F.avg("qty_for").alias("target_mean"))


CONTRACT = T.StructType(
    [
        T.StructField("season", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("result", T.StringType()),
        T.StructField("profit_units", T.DoubleType()),
    ]
)


@query("S_19_ledger_contract", "SELECT season, event_id, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS DOUBLE) AS profit_units FROM contests")
def ledger_contract(spark, root):
    path = work_path(spark, "ledger")
    empty = store.read_or_empty(spark, path, CONTRACT)
    contests(spark, root).select("event_id", "season").write.parquet(path)
    return store.read_or_empty(spark, path, CONTRACT).unionByName(empty)


# Double round robins of 20 sides: every 20 suppliers are a league of their own.
ROUND_ROBIN = """
WITH sides AS (SELECT concat('L', s_suppkey - s_suppkey % 20) AS season, s_suppkey % 20 AS slot, s_name FROM {supplier}),
full_leagues AS (SELECT season FROM sides GROUP BY season HAVING count(*) = 20),
legs AS (SELECT r, k, CASE WHEN k = 0 THEN 19 ELSE (r + k) % 19 END AS x, CASE WHEN k = 0 THEN r ELSE (r + 19 - k) % 19 END AS y FROM {rounds}),
pairs AS (SELECT r + 1 AS match_round, x AS a, y AS b FROM legs UNION ALL SELECT r + 20, y, x FROM legs)
SELECT h.season, CAST(match_round AS BIGINT) AS match_round, h.s_name AS side_a, w.s_name AS side_b
FROM pairs JOIN sides h ON h.slot = a JOIN sides w ON w.slot = b AND w.season = h.season WHERE h.season IN (SELECT season FROM full_leagues)
"""


@query(
    "S_21_schedule_read",
    ROUND_ROBIN.format(supplier="supplier", rounds="(SELECT i // 10 AS r, i % 10 AS k FROM range(190) t(i))"),
    raw=True,
)
def schedule_read(spark, root):
    path = work_path(spark, "schedule")
    rounds = spark.range(190).selectExpr("id div 10 AS r", "id % 10 AS k")
    spark.sql(ROUND_ROBIN, supplier=table(spark, root, "supplier"), rounds=rounds).write.parquet(path)
    return store.read_schedule(spark, path, "season string, match_round bigint, side_a string, side_b string")


@query(
    "S_20_match_status_json",
    """SELECT CAST(event_id AS VARCHAR) AS key, 1 + event_id % 38 AS match_round, kickoff_time AS kickoff, 'PreMatch' AS period, 'BST' AS zone, side_a, side_b,
      CASE WHEN event_id % 11 = 0 THEN 'wrong identity' ELSE '' END || CASE WHEN event_id % 11 = 0 AND season <> '1998-99' THEN ',' ELSE '' END
        || CASE WHEN season <> '1998-99' THEN 'wrong seasonId' ELSE '' END AS violations FROM contests""",
)
def status_json(spark, root):
    c = contests(spark, root)
    side = lambda s: F.struct(F.col(s).alias("name"))
    body = F.struct(
        F.when(F.col("event_id") % 11 == 0, "0x").otherwise(F.col("event_id").cast("string")).alias("matchId"),
        (F.col("event_id") % 38 + 1).alias("matchWeek"),
        F.col("kickoff_time").alias("kickoff"),
        F.lit("PreMatch").alias("period"),
        F.lit("BST").alias("kickoffTimezoneString"),
        side("side_a").alias("homeTeam"),
        side("side_b").alias("awayTeam"),
        F.lit("8").alias("competitionId"),
        F.col("season").alias("seasonId"),
    )
    docs = c.select(F.to_json(F.create_map(F.col("event_id").cast("string"), body)).alias("doc"))
    got = feeds.match_status(docs, "doc", {"competitionId": "8", "seasonId": "1998-99"}, {})
    return got.withColumn("violations", F.array_join("violations", ","))


@query("U_07_input_violations", RAW + f""", n AS (SELECT *, {_name('HomeTeam')} AS h, {_name('AwayTeam')} AS a, try_cast(FTHG AS DOUBLE) AS x, try_cast(FTAG AS DOUBLE) AS y FROM raw),
    rules AS (SELECT event_id, CASE WHEN HF = 'n/a' THEN 'unparsable HF' END AS r FROM n
      UNION ALL SELECT event_id, 'negative HF' FROM n WHERE HF = '-3'
      UNION ALL SELECT event_id, 'fractional HC' FROM n WHERE HC = '2.5'
      UNION ALL SELECT event_id, 'missing side' FROM n WHERE h = '' OR a = ''
      UNION ALL SELECT event_id, 'half-filled result' FROM n WHERE (x IS NULL) <> (y IS NULL)
      UNION ALL SELECT event_id, 'missing statistic' FROM n WHERE x IS NOT NULL AND y IS NOT NULL AND (HF IN ('', 'n/a') OR AF = '')
      UNION ALL SELECT event_id, 'invalid date' FROM n WHERE x IS NOT NULL AND y IS NOT NULL AND "Date" = 'soon'
      UNION ALL SELECT event_id, 'wrong division' FROM n WHERE Div <> 'D1')
    SELECT event_id, string_agg(r, ',' ORDER BY r) AS violations FROM rules WHERE r IS NOT NULL GROUP BY event_id""")
def violations(spark, root):
    got = feeds.input_violations(raw_feed(spark, root), NAMES, "D1")
    return got.select("event_id", F.array_join(F.array_sort("violations"), ",").alias("violations"))


@query(
    "U_07_lost_rows",
    RAW + """, old AS (SELECT event_id, CASE WHEN HF NOT IN ('', 'n/a') THEN HF END AS HF FROM raw),
    new AS (SELECT event_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE HF END AS HF FROM old WHERE event_id % 31 <> 0)
    SELECT event_id, 'fixture vanished' AS violation FROM old WHERE event_id % 31 = 0
    UNION ALL SELECT event_id, 'lost statistic HF' FROM old JOIN new USING (event_id) WHERE old.HF IS NOT NULL AND new.HF IS NULL""",
)
def lost(spark, root):
    old = raw_feed(spark, root).select("event_id", to_number(F.col("HF")).alias("HF"))
    new = old.filter("event_id % 31 <> 0").withColumn("HF", F.when(F.col("event_id") % 29 != 0, F.col("HF")))
    return feeds.lost_rows(new, old, ["event_id"], ["HF"])


@query("P_08_tall_odds", """SELECT event_id, 'B365H' AS odds_key, a_lines / 4 + 1.5 AS odds_value FROM contests
    UNION ALL SELECT event_id, 'B365A', b_lines / 4 + 1.5 FROM contests""")
def odds(spark, root):
    from twinside.operators.sides import tall_metrics

    raw = raw_feed(spark, root)
    extra = [c for c in raw.columns if c not in feeds.CORE_COLUMNS and c not in ("event_id", "season", "feed")]
    numeric = raw.select("event_id", *[to_number(F.col(c)).alias(c) for c in extra])
    return tall_metrics(numeric, ["event_id"], extra, "odds_key", "odds_value")
