"""PostgreSQL server logs: entries, pairing of statements with durations, normalised executions.

Log files are read by ranges (`sources/ranges.py`): a row an entry, in the order of `entry_no`. What follows is Catalyst expressions. An
entry is matched once for its prefix and once for its body. Control character 1, which separates the
pieces, is dropped from texts. Texts of whole files (file, text) are taken, too, and cut here.

Every line that begins with a date, a time and a zone begins an entry; such an entry is in `entries` or, if its prefix does not parse, with the text before a
file's first entry, in `quarantined`, where `executions` leaves statements of unknown zone or unreadable time as well. Zones are the names of `ZONES` and
distances from UTC (+02, -0330, +05:30).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlsift.sources.ranges import BEGIN, LogSource

START = "(?md)" + BEGIN
#: A host has its port in brackets, a client of the same machine is [local]. Nothing of a prefix runs over a line end.
PREFIX = r"(?sd)^(\d+-\d+-\d+) +(\d\S*) +(\w+|[+-]\d[\d:]*):([^\n]*?)(?:\((\d+)\)|(?<=:\[local\])):([^@\n]*)@([^:\n]*):\[(\d+)\]:(\w+):[ \t]*(.*)$"
BODY = r"(?s)^(?:duration: ([\d.]+) (\w+)\s*)?(?:(statement|execute|parse|bind)(?: ([^:]*))?: ?(.*))?$"
#: Zones of log prefixes.
ZONES = {"UTC": "UTC", "GMT": "UTC", "PDT": "America/Los_Angeles", "PST": "America/Los_Angeles", "EDT": "America/New_York", "EST": "America/New_York", "CDT": "America/Chicago", "CST": "America/Chicago", "MDT": "America/Denver", "MST": "America/Denver"}


def read_logs(spark: SparkSession, path: str, range_bytes: int = 64 << 20, files: list[str] | None = None) -> DataFrame:
    """file, entry_no (its first byte), entry of every log file under a path, or of those named, read in ranges of a file."""
    spark.dataSource.register(LogSource)
    reader = spark.read.format(LogSource.name()).option("rangeBytes", range_bytes)
    return (reader if files is None else reader.option("files", json.dumps(files))).load(path)


_SEPARATOR = "\x01"


def _pieces(text, pattern: str, groups: int):
    """The groups of a match, after an empty piece; the text alone if it does not match."""
    return F.split(F.regexp_replace(text, pattern, "".join(f"{_SEPARATOR}${n}" for n in range(1, groups + 1))), _SEPARATOR, groups + 1)


def _cut(files: DataFrame) -> DataFrame:
    """file, entry_no, entry of texts of whole files, in which an entry's number is its place among its file's."""
    if "entry" in files.columns:
        return files.select("file", "entry_no", "entry")
    raw = F.split("text", START)
    return files.select("file", F.posexplode(raw).alias("entry_no", "entry")).withColumn("entry_no", F.col("entry_no").cast("long"))


def _split(files: DataFrame) -> DataFrame:
    """file, entry_no, entry and p (the pieces of its prefix and its body) of each entry."""
    rows = _cut(files)
    text = F.rtrim(F.regexp_replace(F.translate("entry", _SEPARATOR, ""), r"[\r\n]+\z", ""))
    # an array of one, taken apart again: filters on the pieces stay above the match
    return rows.select("file", "entry_no", "entry", F.explode(F.array(_pieces(text, PREFIX, 10))).alias("p")).filter(F.trim(F.translate("entry", "\r\n\t", "")) != "")


def parsed(files: DataFrame) -> DataFrame:
    """One row per log entry, as parsed, with its text (entry) and whether its prefix parses (fits); fields of one that does not are null."""
    part = lambda n: F.get("p", F.lit(n))
    raw = _split(files).select(
        "entry", (F.size("p") > 1).alias("fits"), "file", "entry_no", part(1).alias("date"), part(2).alias("time"), part(3).alias("timezone"), part(4).alias("remote_host"), part(5).try_cast("int").alias("remote_port"),
        part(6).alias("user"), part(7).alias("database"), part(8).try_cast("int").alias("pid"), part(9).alias("severity"), F.regexp_replace(part(10), r"(?m)^[ \t\r]+", "").alias("body"),
    )
    is_error = F.col("severity") == "ERROR"
    is_params = F.col("body").startswith("parameters: ")
    # an array of one, taken apart again: filters on the pieces stay above the match
    raw = raw.select("*", F.explode(F.array(F.when(~(is_error | is_params), _pieces(F.col("body"), BODY, 5)))).alias("b"))
    piece = lambda n: F.coalesce(F.get("b", F.lit(n)), F.lit(""))
    return raw.select(
        *raw.columns[:-2], piece(1).alias("duration_lit"), piece(2).alias("duration_measure"), piece(3).alias("prepared_step"), F.trim(piece(4)).alias("prepared_name"),
        F.trim(piece(5)).alias("query"), F.when(is_params & ~is_error, F.substring("body", 13, 1 << 30)).otherwise("").alias("parameters"), F.when(is_error, F.col("body")).otherwise("").alias("error"),
    )


def entries(files: DataFrame) -> DataFrame:
    """One row per log entry whose prefix parses; `files` may be `parsed` already."""
    rows = files if "fits" in files.columns else parsed(files)
    return rows.filter("fits").drop("entry", "fits")


def _zone():
    """The zone's name for Spark, null if it is unknown."""
    named = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[F.col("timezone")]
    hours, minutes = (F.regexp_extract("timezone", r"^[+-](\d\d?)(?::?(\d\d))?$", k) for k in (1, 2))
    offset = F.concat(F.substring("timezone", 1, 1), F.lpad(hours, 2, "0"), F.lit(":"), F.when(minutes == "", "00").otherwise(minutes))
    return F.when(F.col("timezone").rlike(r"^[+-](0?\d|1[0-7])(:?[0-5]\d)?$"), offset).otherwise(named)


def _local_time():
    """The time as written, null if it cannot be read."""
    text = F.concat_ws(" ", "date", F.substring("time", 1, 8))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), text.try_cast("timestamp_ntz"))


def _executed():
    return F.col("prepared_step").isin("statement", "execute")


def quarantined(files: DataFrame) -> DataFrame:
    """file, entry_no, entry of what is no entry, and of statements that `executions` leaves out for their zone or time; `files` may be `parsed` already."""
    rows = files if "fits" in files.columns else parsed(files)
    return rows.filter(~F.col("fits") | _executed() & (_zone().isNull() | _local_time().isNull())).select("file", "entry_no", "entry")


def kind():
    """What pairing takes an entry for: a statement that waits for its duration (hold), a duration alone, or whole."""
    hold = (F.col("severity") == "LOG") & (F.col("duration_lit") == "") & (F.col("query") != "")
    alone = (F.col("query") == "") & (F.col("duration_lit") != "")
    return F.when(hold, "hold").when(alone, "duration").otherwise("whole")


def followed(rows: DataFrame, client: list[str], span: int = 64 << 20, *age: str) -> DataFrame:
    """Holds of `rows` (with `kind`) and `next`, what follows each of its client (kind, entry_no, duration_lit, duration_measure), null where nothing does.

    Entries of a client are in the order of `age`, if given, file and entry_no. They are taken in stretches of `span` numbers (bytes, as `read_logs` counts) of a file.
    Within a stretch an entry sees the one behind it of its client; of each client and stretch only the first and the last entry are carried on and scanned in
    order, so that no task holds a client's entries of a file, however many there are.
    """
    after = F.lead(F.struct("kind", "entry_no", "duration_lit", "duration_measure"))
    within = Window.partitionBy(*dict.fromkeys([*client, *age, "file", "stretch"])).orderBy("entry_no")
    seen = rows.filter("kind <> 'whole'").withColumn("stretch", F.floor(F.col("entry_no") / span)).withColumn("next", after.over(within)).withColumn("first", F.lag("kind").over(within).isNull())
    # the ends of all stretches of a client are one group, what stands between them stays with its stretch
    group = F.when(F.col("first") | F.col("next").isNull(), F.lit(-1)).otherwise(F.col("stretch"))
    carried = Window.partitionBy(*client, "group").orderBy(*age, "file", "entry_no")
    met = seen.withColumn("group", group).withColumn("carried", after.over(carried)).withColumn("next", F.coalesce("next", "carried"))
    return met.filter("kind = 'hold'").select(*rows.columns, "next")


def with_next(holds: DataFrame, columns: list[str]) -> DataFrame:
    """Holds at the place and with the duration of their `next`; one without it stays as it is."""
    return holds.select(*[F.coalesce(f"next.{c}", c).alias(c) if c in ("entry_no", "duration_lit", "duration_measure") else c for c in columns])


def paired(rows: DataFrame, strict_session: bool = False, span: int = 64 << 20) -> DataFrame:
    """Fills the duration of an entry that came without one from the next duration-only entry of its client (see `followed`).

    The pair stands at the later position with the earlier entry's fields. A later hold replaces an earlier one.
    `strict_session` also requires the process to be the same.
    """
    columns, rows = rows.columns, rows.withColumn("kind", kind())
    holds = followed(rows, ["file", "remote_host", "user", "database", "severity"] + ["pid"] * strict_session, span)
    return rows.filter("kind = 'whole'").drop("kind").unionByName(with_next(holds.filter("next.kind = 'duration'"), columns))


def microseconds(amount, unit):
    """Microseconds of a duration; -1 without one, 0 if it cannot be read."""
    value = amount.try_cast("double")
    return F.when(amount == "", F.lit(-1)).when(unit == "ms", F.coalesce((value * 1000).try_cast("long"), F.lit(0))).when(unit == "sec", F.coalesce((value * 1000000).try_cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def executions(rows: DataFrame) -> DataFrame:
    """Executed statements with local time, hour and microseconds; those of unknown zone or unreadable time are in `quarantined`."""
    good = rows.filter(_executed()).withColumn("zone", _zone()).withColumn("local_time", _local_time()).filter("zone is not null and local_time is not null")
    return good.select(
        "file", "entry_no", "local_time", F.date_trunc("hour", "local_time").cast("timestamp_ntz").alias("hour"), F.convert_timezone(F.col("zone"), F.lit("UTC"), F.col("local_time")).alias("utc_time"),
        "user", "database", "query", microseconds(F.col("duration_lit"), F.col("duration_measure")).alias("duration_us"),
    )
