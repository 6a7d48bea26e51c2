"""Season files, foreign schemas, JSON fixtures and HTML facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from twinside.functions import calendar as cal
from twinside.functions.numbers import to_number
from twinside.functions.text import blank_to_null, canonical_name, clean_header, is_blank

# The column names of a raw season file.
CORE_COLUMNS = (
    "Div", "Date", "Time", "HomeTeam", "AwayTeam", "Referee",
    "FTHG", "FTAG", "FTR", "HTHG", "HTAG", "HTR",
    "HS", "AS", "HST", "AST", "HF", "AF", "HC", "AC", "HY", "AY", "HR", "AR", "HxG", "AxG",
)
# What a played row must state, and all statistics that are checked when present.
REQUIRED_STATS = ("FTHG", "FTAG", "HF", "AF", "HC", "AC", "HY", "AY")
CHECKED_STATS = (
    "FTHG", "FTAG", "HTHG", "HTAG", "HF", "AF", "HC", "AC", "HY", "AY", "HR", "AR", "HS", "AS", "HST", "AST", "HxG", "AxG",
)
FRACTIONAL_STATS = ("HxG", "AxG")


def text_encoding(spark: SparkSession, path: str, fallback: str = "windows-1252") -> str:
    """UTF-8 when every line of the source is valid UTF-8, else the fallback.

    The whole source is tested on the executors; one boolean comes back.
    """
    valid = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).first()["ok"]
    return "UTF-8" if valid is None or valid else fallback


# The reader knows ISO-8859-1; Windows text differs from it in these control positions only.
_WINDOWS = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_WINDOWS = {k: v for k, v in _WINDOWS.items() if v}


def feed_layouts(spark: SparkSession, path: str, fallback: str = "windows-1252") -> DataFrame:
    """(header, encoding, paths): the files of a source by their header line and by whether all their lines are UTF-8.

    One pass over the lines; of each file its first line and one boolean
    remain. Lines keep their order within a split, so the smallest running
    number of a file's first split is its header.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start") == 0).alias("first"), F.monotonically_increasing_id().alias("at")
    )
    files = lines.groupBy("path").agg(
        F.min_by("value", F.when(F.col("first"), F.col("at"))).alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")
    )
    encoding = F.when(F.col("utf8"), "UTF-8").otherwise(fallback)
    return files.groupBy("header", encoding.alias("encoding")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def read_feed(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Header CSV files as text columns with cleaned names, plus where each row came from.

    Files are read by their own header and, unless ``encoding`` is given, in
    their own encoding; columns that a file lacks are null. The driver sees one
    row for each layout.
    """
    layouts = feed_layouts(spark, path).sort("header", "encoding").collect()
    if not layouts:
        return read_layout(spark, path, encoding or "UTF-8")
    frames = [read_layout(spark, r["paths"], encoding or r["encoding"]) for r in layouts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_layout(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Files of one header and one encoding."""
    windows = encoding == "windows-1252"
    df = spark.read.csv(path, header=True, encoding="ISO-8859-1" if windows else encoding, inferSchema=False)
    located = df.select("*", F.col("_metadata.file_path").alias("_path"))
    if windows:
        plain, real = "".join(_WINDOWS), "".join(_WINDOWS.values())
        located = located.select(*[F.translate(F.col(f"`{c}`"), plain, real).alias(c) for c in located.columns])
    return located.toDF(*[clean_header(c) for c in located.columns])


def season_of_path(path: Column, depth: int = 1) -> Column:
    """Season label from the file name (``depth`` 1) or from a folder above it."""
    return cal.season_from_text(F.element_at(F.split(path, "/"), F.lit(-depth)))


def normalize_feed(raw: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Played rows with canonical names, trimmed official and real dates."""
    played = raw.filter(~is_blank(F.col("HomeTeam")) & ~is_blank(F.col("AwayTeam")))
    played = played.filter(~is_blank(F.col("FTHG")) & ~is_blank(F.col("FTAG")))
    return played.withColumns(
        {
            "HomeTeam": canonical_name(F.col("HomeTeam"), names),
            "AwayTeam": canonical_name(F.col("AwayTeam"), names),
            "Referee": F.trim("Referee"),
            "Date": cal.day_first_date(F.col("Date")),
        }
    )


def acceptance(raw: DataFrame, required: Sequence[str] = ("HomeTeam", "AwayTeam", *REQUIRED_STATS)) -> DataFrame:
    """One row: is this source usable (columns present, at least one played row)?"""
    missing = sorted(set(required) - set(raw.columns))
    if missing:
        return raw.agg(F.lit(False).alias("accepted"), F.lit(0).alias("played"), F.lit(f"missing columns {missing}").alias("reason"))
    played = F.count_if(to_number(F.col("FTHG")).isNotNull() & to_number(F.col("FTAG")).isNotNull())
    return raw.agg(played.alias("played")).select(
        (F.col("played") > 0).alias("accepted"), "played", F.when(F.col("played") == 0, "no played rows").alias("reason")
    )


def freshness(fresh: DataFrame, cached: DataFrame, due: DataFrame | None = None) -> DataFrame:
    """One row comparing played counts: not older than the cache, not ahead of the schedule."""
    played = lambda df: df.agg(
        F.count_if(to_number(F.col("FTHG")).isNotNull() & to_number(F.col("FTAG")).isNotNull())
    ).scalar()
    due_count = due.agg(F.count("*")).scalar() if due is not None else F.lit(None).cast("bigint")
    one = fresh.agg(
        F.count_if(to_number(F.col("FTHG")).isNotNull() & to_number(F.col("FTAG")).isNotNull()).alias("fresh_played")
    ).withColumns({"cached_played": played(cached), "due": due_count})
    return one.withColumn(
        "accepted",
        (F.col("fresh_played") >= F.col("cached_played")) & (F.col("due").isNull() | (F.col("fresh_played") <= F.col("due"))),
    )


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one loaded last.  A maximum combines on the map side, so copies never gather."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return newest.select(*keys, "_r.*").select(*df.columns)


def played_union(
    rows: DataFrame, codes: Mapping[int, str], now: Column, competitions: Sequence[str], order: Sequence[str], zone: str
) -> DataFrame:
    """Finished rows of many small files: newest copy per id, one competition, kickoff reached, names for codes."""
    finished = rows.filter(F.lower(F.col("finished").cast("string")).isin("true", "1"))
    newest = keep_last(finished, ["match_id"], order)
    kickoff = newest.filter(F.lower(F.trim("tournament")).isin(*competitions)).withColumn(
        "_utc", F.col("kickoff_time").try_cast("timestamp_ntz")
    )
    name = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    local = cal.utc_to_local(F.col("_utc"), zone)
    return kickoff.filter(F.col("_utc") <= now).withColumns(
        {
            "Date": F.date_format(local, "dd/MM/yyyy"),
            "Time": F.date_format(local, "HH:mm"),
            "HomeTeam": F.try_element_at(name, F.col("home_team").try_cast("double").cast("int")),
            "AwayTeam": F.try_element_at(name, F.col("away_team").try_cast("double").cast("int")),
        }
    ).drop("_utc")


def foreign_to_core(df: DataFrame, mapping: Mapping[str, str], wanted: Sequence[str]) -> DataFrame:
    """Project a foreign schema onto core columns; result letters from the scores; absent columns are null."""
    have = {v: F.col(k) for k, v in mapping.items() if k in df.columns}

    def letter(h: str, a: str) -> Column:
        if h not in have or a not in have:
            return F.lit(None).cast("string")
        x, y = to_number(have[h]), to_number(have[a])
        return F.when(x > y, "H").when(x < y, "A").when(x == y, "D")

    made = {"FTR": letter("FTHG", "FTAG"), "HTR": letter("HTHG", "HTAG")}
    pick = lambda c: have.get(c, made.get(c, F.col(c) if c in df.columns else F.lit(None).cast("string")))
    return df.select(*[pick(c).alias(c) for c in wanted])


def enrich(fresh: DataFrame, old: DataFrame, keys: Sequence[str], official: str, appointments: DataFrame | None = None) -> DataFrame:
    """Fresh rows stay authoritative; the old copy fills a blank official and columns the fresh source lacks.

    Never adds rows: of a key that ``old`` or ``appointments`` repeats, the largest row counts.
    """
    extra = [c for c in old.columns if c not in fresh.columns]
    one = lambda df: keep_last(df, keys, [c for c in df.columns if c not in keys])
    joined = fresh.join(one(old.select(*keys, F.col(official).alias("_old_official"), *extra)), list(keys), "left")
    filled = F.coalesce(blank_to_null(F.col(official)), F.col("_old_official"))
    if appointments is not None:
        joined = joined.join(one(appointments.select(*keys, F.col(official).alias("_appointed"))), list(keys), "left")
        filled = F.coalesce(blank_to_null(filled), F.col("_appointed"))
    return joined.withColumn(official, filled).select(*fresh.columns, *extra)


def input_violations(raw: DataFrame, names: Mapping[str, str], division: str | None = None) -> DataFrame:
    """Rows with the ids of all rules they break; one pass, plus one count for repeated pairs.

    ``raw`` carries ``season`` next to the feed columns.
    """
    stats = [c for c in CHECKED_STATS if c in raw.columns]
    home, away = canonical_name(F.col("HomeTeam"), names), canonical_name(F.col("AwayTeam"), names)
    num = {c: to_number(F.col(c)) for c in stats}
    played = num["FTHG"].isNotNull() & num["FTAG"].isNotNull()
    start = cal.season_start_or_null(F.col("season"))
    date = cal.day_first_date(F.col("Date"))
    rules: list[tuple[str, Column]] = []
    for c in stats:
        rules += [
            (f"unparsable {c}", ~is_blank(F.col(c)) & num[c].isNull()),
            (f"infinite {c}", num[c].isin(float("inf"), float("-inf"))),
            (f"negative {c}", num[c] < 0),
        ]
        if c not in FRACTIONAL_STATS:
            rules.append((f"fractional {c}", F.when(F.abs(num[c]) < float("inf"), num[c] % 1 != 0)))
    rules += [
        ("missing side", is_blank(home) | is_blank(away)),
        ("self pair", home == away),
        ("half-filled result", num["FTHG"].isNull() != num["FTAG"].isNull()),
        ("missing statistic", played & F.lit(False) if not stats else played & F.greatest(*[num[c].isNull().cast("int") for c in REQUIRED_STATS]).cast("boolean")),
        ("invalid date", played & date.isNull()),
        ("date outside season", played & (cal.season_start_of(date) != start)),
        ("invalid season", start.isNull()),
    ]
    if division is not None and "Div" in raw.columns:
        rules.append(("wrong division", ~F.equal_null(F.col("Div"), F.lit(division))))
    broken = F.filter(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules]), lambda r: r.isNotNull())
    return raw.withColumns({"HomeTeam": home, "AwayTeam": away, "violations": broken}).filter(F.size("violations") > 0)


def lost_rows(new: DataFrame, old: DataFrame, keys: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Regressions against the prior load: a vanished pair, or a statistic that became empty."""
    vanished = old.join(new.select(*keys), list(keys), "left_anti").select(*keys, F.lit("fixture vanished").alias("violation"))
    paired = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in stats]).join(new.select(*keys, *stats), list(keys))
    gone = F.array_compact(
        F.array(*[F.when(F.col(f"_old_{c}").isNotNull() & F.col(c).isNull(), F.lit(f"lost statistic {c}")) for c in stats])
    )
    return vanished.unionByName(paired.select(*keys, F.explode(gone).alias("violation")))


FIXTURE_FEED = T.StructType(
    [
        T.StructField("MatchNumber", T.LongType()),
        T.StructField("RoundNumber", T.LongType()),
        T.StructField("DateUtc", T.StringType()),
        T.StructField("HomeTeam", T.StringType()),
        T.StructField("AwayTeam", T.StringType()),
    ]
)


def read_fixture_feed(spark: SparkSession, path: str, zone: str, names: Mapping[str, str], multi_line: bool = False) -> DataFrame:
    """Fixture JSON (an array per file, or one object per line) with UTC instants as local wall time."""
    raw = spark.read.schema(FIXTURE_FEED).json(path, multiLine=multi_line)
    utc = F.regexp_replace("DateUtc", "Z$", "").try_cast("timestamp_ntz")
    bad = F.raise_error(F.concat(F.lit("invalid DateUtc: "), F.coalesce("DateUtc", F.lit("null"))))
    local = cal.utc_to_local(F.when(utc.isNull(), bad.cast("timestamp_ntz")).otherwise(utc), zone)
    return raw.select(
        F.col("RoundNumber").alias("match_round"),
        F.to_date(local).alias("event_date"),
        F.date_format(local, "HH:mm").alias("kickoff_time"),
        canonical_name(F.col("HomeTeam"), names).alias("side_a"),
        canonical_name(F.col("AwayTeam"), names).alias("side_b"),
        F.col("MatchNumber").alias("source_number"),
    )


MATCH_STATUS = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("matchId", T.StringType()),
            T.StructField("matchWeek", T.LongType()),
            T.StructField("kickoff", T.StringType()),
            T.StructField("period", T.StringType()),
            T.StructField("kickoffTimezoneString", T.StringType()),
            T.StructField("homeTeam", T.StructType([T.StructField("name", T.StringType())])),
            T.StructField("awayTeam", T.StructType([T.StructField("name", T.StringType())])),
            T.StructField("competitionId", T.StringType()),
            T.StructField("seasonId", T.StringType()),
        ]
    ),
)


def match_status(documents: DataFrame, text: str, expected: Mapping[str, str], names: Mapping[str, str]) -> DataFrame:
    """JSON documents keyed by match id to fixture rows with the identity rules they break."""
    rows = documents.select(F.explode(F.from_json(text, MATCH_STATUS)).alias("key", "m"))
    rules = [F.when(~F.equal_null(F.col("m.matchId"), F.col("key")), F.lit("wrong identity"))]
    rules += [F.when(~F.equal_null(F.col(f"m.{k}").cast("string"), F.lit(v)), F.lit(f"wrong {k}")) for k, v in expected.items()]
    return rows.select(
        "key",
        F.col("m.matchWeek").alias("match_round"),
        F.col("m.kickoff").alias("kickoff"),
        F.col("m.period").alias("period"),
        F.col("m.kickoffTimezoneString").alias("zone"),
        canonical_name(F.col("m.homeTeam.name"), names).alias("side_a"),
        canonical_name(F.col("m.awayTeam.name"), names).alias("side_b"),
        F.array_compact(F.array(*rules)).alias("violations"),
    )


HEADING_OR_PARAGRAPH = r"(?s)<h[1-6][^>]*>.*?</h[1-6]>|<p[^>]*>.*?</p>"


def html_facts(pages: DataFrame, fact: str, tag: str = HEADING_OR_PARAGRAPH) -> DataFrame:
    """``fact`` matches in paragraphs, each with the last heading above it on the page.

    Whole pages are cut into tagged blocks by one expression; the last heading
    is carried forward by a window inside the page.
    """
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(tag), F.lit(0))).alias("pos", "block"))
    text = F.trim(F.regexp_replace(F.regexp_replace("block", "<[^>]*>", " "), r"\s+", " "))
    heading = F.col("block").rlike("^<h")
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = blocks.select("page_id", "pos", heading.alias("is_heading"), text.alias("text")).withColumn(
        "heading", F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(w)
    )
    value = F.regexp_extract("text", fact, 1)
    return carried.filter(~F.col("is_heading") & F.col("text").rlike(fact)).select("page_id", "pos", "heading", value.alias("value"))


def select_articles(articles: DataFrame, title: str, season: str, references: Mapping[str, str]) -> DataFrame:
    """Articles whose title and season text match and whose typed references do not contradict."""
    ok = F.col("title").rlike(title) & F.col("body").rlike(season)
    for kind, value in references.items():
        ok = ok & F.forall("references", lambda r: (r["type"] != kind) | (r["id"] == value))
    return articles.filter(ok)
