"""Calendar, office timeline, roles, rosters, votes and committee averages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Member, first day in office, office (None: out of office).
OFFICES = (
    ("Jerome H. Powell", "2012-05-25", "governor"),
    ("Jerome H. Powell", "2018-02-05", "chair"),
    ("Jerome H. Powell", "2026-05-22", "governor"),
    ("Kevin M. Warsh", "2006-02-24", "governor"),
    ("Kevin M. Warsh", "2011-04-02", None),
    ("Kevin M. Warsh", "2026-05-22", "chair"),
    ("John C. Williams", "2011-03-01", "pres:San Francisco"),
    ("John C. Williams", "2018-06-18", "pres:NY"),
    ("Philip N. Jefferson", "2022-05-23", "governor"),
    ("Michelle W. Bowman", "2018-11-26", "governor"),
    ("Michael S. Barr", "2022-07-19", "governor"),
    ("Lisa D. Cook", "2022-05-23", "governor"),
    ("Christopher J. Waller", "2020-12-18", "governor"),
    ("Mary C. Daly", "2018-10-01", "pres:San Francisco"),
    ("Neel Kashkari", "2016-01-01", "pres:Minneapolis"),
    ("Thomas I. Barkin", "2018-01-04", "pres:Richmond"),
    ("Lorie K. Logan", "2022-08-22", "pres:Dallas"),
    ("Susan M. Collins", "2022-07-01", "pres:Boston"),
    ("Austan D. Goolsbee", "2023-01-09", "pres:Chicago"),
    ("Beth M. Hammack", "2024-08-21", "pres:Cleveland"),
    ("Jeffrey R. Schmid", "2023-08-21", "pres:Kansas City"),
    ("Anna Paulson", "2025-07-01", "pres:Philadelphia"),
)
#: Member, first day in the chair, the day after the last (None: still there).
CHAIRS = (("Jerome H. Powell", "2018-02-05", "2026-05-22"), ("Kevin M. Warsh", "2026-05-22", None))
#: Bank, modulus, remainder of the years in which it votes.
ROTATION = (
    ("Chicago", 2, 1), ("Cleveland", 2, 0), ("Boston", 3, 0), ("Philadelphia", 3, 1), ("Richmond", 3, 2), ("St. Louis", 3, 0),
    ("Dallas", 3, 1), ("Atlanta", 3, 2), ("Kansas City", 3, 0), ("Minneapolis", 3, 1), ("San Francisco", 3, 2),
)


def offices(spark: SparkSession) -> DataFrame:
    """member, start, end (exclusive, null while it lasts), office: 22 rows."""
    rows = spark.createDataFrame(OFFICES, "member string, start string, office string").withColumn("start", F.to_date("start"))
    return rows.withColumn("end", F.lead("start").over(Window.partitionBy("member").orderBy("start")))


def rotation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROTATION, "bank string, modulus int, remainder int")


def roles(dates: DataFrame, office: DataFrame, turns: DataFrame) -> DataFrame:
    """member, date, office, is_voting, is_chair for each date and member of the timeline.

    dates: date (null gives null roles).  A gap or a date before the first segment has no
    office and no vote.  The dimension tables have some twenty rows, so the range join
    is a broadcast of those.
    """
    members = F.broadcast(office.select("member").distinct())
    seg = F.broadcast(office.withColumnRenamed("member", "m"))
    on = (F.col("member") == F.col("m")) & (F.col("start") <= F.col("date")) & (F.col("end").isNull() | (F.col("date") < F.col("end")))
    held = dates.select("date").distinct().crossJoin(members).join(seg, on, "left").select("member", "date", "office")
    bank = F.when(F.startswith("office", F.lit("pres:")), F.substring("office", 6, 100))
    held = held.withColumn("bank", bank).join(F.broadcast(turns), "bank", "left")
    always = F.col("office").isin("governor", "chair", "pres:NY")
    turn = F.coalesce(F.pmod(F.year("date"), F.col("modulus")) == F.col("remainder"), F.lit(False))
    voting = F.when(F.col("date").isNull(), None).otherwise(F.coalesce(always, F.lit(False)) | turn)
    terms = [(F.col("member") == m) & (F.col("date") >= F.lit(a).cast("date")) & (F.lit(True) if b is None else F.col("date") < F.lit(b).cast("date")) for m, a, b in CHAIRS]
    chair = F.when(F.col("date").isNull(), None).otherwise(reduce(lambda x, y: x | y, terms))
    return held.select("member", "date", "office", voting.alias("is_voting"), chair.alias("is_chair"))


def sitting(roles_: DataFrame, voting_only: bool = False) -> DataFrame:
    """member, date, office of those in office, or of those who vote."""
    kept = roles_.where("office is not null")
    return (kept.where("is_voting") if voting_only else kept).select("member", "date", "office")


def roster(chunks: DataFrame, meetings: DataFrame, least: int = 5) -> DataFrame:
    """date, member, n: members with at least ``least`` chunks dated on or before the meeting.

    Chunks are counted by day first, so what meets the (small) calendar is members x days.
    """
    days = chunks.where("posted is not null").groupBy("member", "posted").count()
    return days.join(F.broadcast(meetings.select("date")), F.col("posted") <= F.col("date")).groupBy("date", "member").agg(F.sum("count").alias("n")).where(F.col("n") >= least)


def two_level_mean(rows: DataFrame, value: str, group: str, inner: str) -> DataFrame:
    """group, index: mean over ``inner`` of each one's mean."""
    return rows.groupBy(group, inner).agg(F.avg(value).alias("v")).groupBy(group).agg(F.avg("v").alias("index"), F.count("*").alias("n_members"))


def modal_vote(votes: DataFrame) -> DataFrame:
    """meeting, vote: the most frequent; of equals the one met first by roster position ``pos``."""
    c = votes.groupBy("meeting", "vote").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("meeting").orderBy(F.col("n").desc(), "first"))).where("r = 1").select("meeting", "vote", "n")


def decisions(meetings: DataFrame, target: DataFrame) -> DataFrame:
    """date, before, after, bps, label; the new level is read eight days later.  Null where one is missing
    or no observation lies after the meeting."""
    from .statistics import as_of

    both = as_of(as_of(meetings, target, "date", out="before").withColumn("later", F.date_add("date", 8)), target, "later", out="after")
    last = target.agg(F.max("date").alias("last"))
    both = both.crossJoin(F.broadcast(last)).withColumn("after", F.when(F.col("last") > F.col("date"), F.col("after")))
    bps = F.rint((F.col("after") - F.col("before")) * 100).cast("long")
    return both.withColumn("bps", bps).select("date", "before", "after", "bps", F.when(F.col("bps") > 0, "hike").when(F.col("bps") < 0, "cut").when(F.col("bps") == 0, "hold").alias("label"))


def interval_join(points: DataFrame, spans: DataFrame, on: str, start: str, end: str, days: int = 16) -> DataFrame:
    """Pairs of ``points`` and ``spans`` (other column names) where start <= on < end; an open end never ends.

    For sides too large to broadcast: time is cut into buckets of ``days``, a span stands in each that it meets, and
    the sides meet by bucket, so no pair is looked at but those of one bucket.  Days beyond the points' range make no
    bucket.  Null days and starts meet nothing.
    """
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    bucket = lambda d: F.floor(d / days).cast("long")
    edge = points.agg(F.min(day(on)).alias("_low"), F.max(day(on)).alias("_high"))
    asked = points.withColumn("_bucket", bucket(day(on)))
    first = F.greatest(day(start), F.col("_low"))
    last = F.least(F.coalesce(day(end) - 1, F.col("_high")), F.col("_high"))
    met = spans.crossJoin(F.broadcast(edge)).where(first <= last).withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(last)))).drop("_low", "_high")
    inside = (F.col(on).cast("date") >= F.col(start).cast("date")) & (F.col(end).isNull() | (F.col(on).cast("date") < F.col(end).cast("date")))
    return asked.join(met, "_bucket").where(inside).drop("_bucket")
