"""Mixed timestamp formats and time zones, normalised to microseconds since 1970 UTC.

Raw texts are deduplicated together with what their meaning depends on (the zone of their source and its
order of day and month) into a dictionary. Each entry is parsed exhaustively once; entries are appended to a
stored dictionary, so that later runs parse only texts never seen before; instants are joined back to rows. Columns
of whole numbers hold no texts: ``integer_to_us`` answers them in place.

Defined results
* Numbers are seconds, milli-, micro- or nanoseconds, whichever puts them into the years 2001 to 2100;
  other numbers are no time. Finer digits than microseconds are cut.
* Texts need a date and a time that exist; anything else (NULL, blank, junk, a date alone) is no time: NULL.
* A zone, offset or abbreviation in the text wins over the source's zone. A text without any, whose source
  has no zone, is no time. Unknown zone names are no time.
* A local time that occurs twice is the first one; one that is skipped is moved on by the gap.
* Repeated rows are kept as they are; joining back never multiplies or drops rows.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.runtime import broadcast_within, materialise, shared_dir

#: First second of 2001 and of 2101.
FIRST_SECOND, END_SECOND = 978_307_200, 4_133_980_800

#: European and North American zone abbreviations as offsets from UTC in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

_MONTH = r"([A-Za-z]{3})[a-z]*\.?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: *([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_ZONE = r"(?: *([+-]\d{2}(?::?\d{2})?|[A-Za-z]{1,5}|[A-Za-z_]++(?:/[A-Za-z_+\-0-9]++)++))?"
#: Fixed formats, with the order in which their groups give year, month, day, hour, minute, second, fraction, half, zone.
FORMATS = {
    "iso": (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt]| +){_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "basic": (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[Tt](\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "mail": (rf"^(?:[A-Za-z]{{3,9}},? +)?(\d{{1,2}}) +{_MONTH} +(\d{{4}}),? +{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "named": (rf"^(?:[A-Za-z]{{3,9}},? +)?{_MONTH} +(\d{{1,2}}),? +(\d{{4}}),? +{_CLOCK}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "dots": (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),? +{_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "yearfirst": (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:[Tt]| +){_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
}
_SLASHES = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),? +{_CLOCK}{_ZONE}$"
_NUMBER = r"^\+?\d{1,19}(?:\.\d*)?$"


def number_unit(value: Column) -> Column:
    """``s``, ``ms``, ``us`` or ``ns`` for an exact number, NULL if none puts it into 2001 to 2100."""
    out = F.lit(None).cast("string")
    for unit, scale in (("ns", 10**9), ("us", 10**6), ("ms", 10**3), ("s", 1)):
        out = F.when((value >= F.lit(FIRST_SECOND * scale)) & (value < F.lit(END_SECOND * scale)), F.lit(unit)).otherwise(out)
    return out


def _div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by).cast("long"))


def integer_to_us(value: Column) -> Column:
    """Microseconds of a bigint in whichever unit ``number_unit`` finds, in 64-bit arithmetic."""
    unit = number_unit(value)
    return (
        F.when(unit == "s", value * F.lit(1_000_000)).when(unit == "ms", value * F.lit(1000))
        .when(unit == "us", value).when(unit == "ns", _div(value, 1000))
    ).cast("long")


def integer_to_seconds(value: Column) -> Column:
    """Whole seconds of a bigint in any unit, NULL if it is no time."""
    return _div(integer_to_us(value), 1_000_000)


def parse_instants(df: DataFrame, raw: str = "raw", zone: str = "zone", day_order: str = "day_order") -> DataFrame:
    """``df`` plus ``epoch_us``: what ``raw`` states, or NULL. Built-in expressions only.

    The steps are separate projections, since later ones use the results of earlier ones many times over.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    text, order = F.trim(F.col(raw)), F.col(day_order)
    slash = F.when(order == "mdy", F.regexp_replace(text, _SLASHES, "$3|$1|$2|$4|$5|$6|$7|$8|$9")).when(
        order == "dmy", F.regexp_replace(text, _SLASHES, "$3|$2|$1|$4|$5|$6|$7|$8|$9")
    )
    number = text.rlike(_NUMBER)
    parts = F.when(number, F.lit(None)).when(text.rlike(_SLASHES), slash)
    for pattern, groups in FORMATS.values():
        parts = parts.when(text.rlike(pattern), F.regexp_replace(text, pattern, groups))
    whole, fraction = F.substring_index(text, ".", 1), F.rpad(F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise(""), 6, "0")
    step = df.select(
        *columns, F.when(number, whole.try_cast("long")).alias("__i"), F.when(number, fraction).alias("__fr"), F.split(parts, r"\|").alias("__p")
    )
    digits_of = {"s": F.col("__fr"), "ms": F.substring("__fr", 1, 3)}
    step = step.select(*columns, "__i", "__fr", "__p", number_unit(F.col("__i")).alias("__u"))
    us = F.when(F.col("__u") == "s", F.col("__i") * 1_000_000 + digits_of["s"].try_cast("long"))
    us = us.when(F.col("__u") == "ms", F.col("__i") * 1000 + digits_of["ms"].try_cast("long")).when(F.col("__u") == "us", F.col("__i"))
    step = step.select(*columns, us.when(F.col("__u") == "ns", _div(F.col("__i"), 1000)).alias("__n"), "__p")
    p = F.col("__p")
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])
    integer = lambda c: c.try_cast("int")
    step = step.select(
        *columns, "__n", integer(p[0]).alias("__y"), F.coalesce(integer(p[1]), F.try_element_at(months, F.lower(p[1]))).alias("__mo"),
        integer(p[2]).alias("__d"), integer(p[3]).alias("__h"), integer(p[4]).alias("__mi"),
        F.when(p[5] == "", F.lit(0)).otherwise(integer(p[5])).alias("__s"), F.rpad(p[6], 6, "0").try_cast("long").alias("__f"),
        F.lower(p[7]).alias("__half"), p[8].alias("__z"),
    )
    h, half, z = F.col("__h"), F.col("__half"), F.col("__z")
    hour = F.when(half == "", h).when(h.between(1, 12), F.pmod(h, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    leap = (F.col("__y") % 4 == 0) & ((F.col("__y") % 100 != 0) | (F.col("__y") % 400 == 0))
    longest = F.when(F.col("__mo").isin(4, 6, 9, 11), 30).when(F.col("__mo") == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    exists = F.col("__mo").between(1, 12) & (F.col("__d") >= 1) & (F.col("__d") <= longest) & (F.col("__y") >= 1)
    exists = exists & hour.between(0, 23) & F.col("__mi").between(0, 59) & F.col("__s").between(0, 59)
    day = F.unix_date(F.make_date("__y", "__mo", "__d")).cast("long")
    wall = F.when(exists, day * 86_400_000_000 + (hour * 3600 + F.col("__mi") * 60 + F.col("__s")).cast("long") * 1_000_000 + F.col("__f"))
    digits = F.regexp_replace(z, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    short = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    fixed = F.when(z.rlike("^[+-]"), F.when(minutes <= 18 * 60, F.when(z.startswith("-"), -minutes).otherwise(minutes)))
    fixed = fixed.otherwise(F.try_element_at(short, F.upper(z)))
    step = step.select(*columns, "__n", wall.alias("__w"), fixed.alias("__o"), F.when(z == "", F.col(zone)).otherwise(z).alias("__name"))
    known = F.col("__name").isin(sorted(zoneinfo.available_timezones()))
    local = F.when(F.col("__o").isNotNull(), F.col("__w") - F.col("__o").cast("long") * 60_000_000).when(known, _at_zone(F.col("__w"), F.col("__name")))
    return step.select(*columns, F.coalesce("__n", local).alias("epoch_us"))


def _at_zone(wall_us: Column, zone: Column) -> Column:
    """Local microseconds in a zone as UTC microseconds: the first of two, gaps moved on."""
    as_if_utc = F.timestamp_micros(wall_us)
    return F.unix_micros(F.to_utc_timestamp(as_if_utc, zone))


class InstantDictionary:
    """A stored dictionary of parsed texts: ``raw, zone, day_order, n, epoch_us``, one folder per batch.

    ``n`` is how often the batch that brought a text held it; it says nothing of later batches.
    """

    COLUMNS = ("raw", "zone", "day_order")

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or shared_dir(spark, "instants")).rstrip("/")
        self._next = 0

    def _batches(self) -> list[str]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        done = [n for n in names if n.startswith("batch-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        self._next = max((int(n[6:]) + 1 for n in names if n.startswith("batch-")), default=0)
        return sorted(done)

    def read(self) -> DataFrame | None:
        names = self._batches()
        return self.spark.read.parquet(*[f"{self.path}/{n}" for n in names]) if names else None

    def _on(self, left: DataFrame, right: DataFrame) -> list[Column]:
        return [left[c].eqNullSafe(right[c]) for c in self.COLUMNS]

    def add(self, values: DataFrame) -> DataFrame:
        """Parse the texts of ``values`` (``raw, zone, day_order``) that are new, store them, and return the entries of
        all texts of ``values``, with ``n`` their number in ``values``."""
        counts = values.where(F.col("raw").isNotNull()).groupBy(*self.COLUMNS).agg(F.count("*").alias("n"))
        known = self.read()
        if known is None:
            batch = f"{self.path}/batch-{self._next:06d}"
            parse_instants(counts).write.parquet(batch)
            return self.spark.read.parquet(batch)
        counts = materialise(counts, "texts")
        parse_instants(counts.join(known, self._on(counts, known), "left_anti")).write.parquet(f"{self.path}/batch-{self._next:06d}")
        known = self.read()
        return counts.join(known, self._on(counts, known)).select(*[counts[c] for c in self.COLUMNS], counts["n"], known["epoch_us"])


def normalise(rows: DataFrame, dictionary: InstantDictionary, hot_share: int = 1000) -> DataFrame:
    """``rows`` (with ``raw, zone, day_order``) plus ``epoch_us``, which replaces a column of that name.

    Texts that make up more than one ``hot_share``-th of these rows, whatever earlier batches held, are at most ``hot_share``
    many, so these are broadcast; the other rows meet the dictionary in a shuffled join in which no key can be hot. Rows
    already answered are spread over the partitions of that join by a hash of their own.
    """
    keys = list(InstantDictionary.COLUMNS)
    entries = dictionary.add(rows.select(*keys))
    pack = lambda: F.concat_ws("\x1f", *[F.coalesce(F.col(k), F.lit("\x1e")) for k in keys])
    entries = entries.select(pack().alias("key"), "n", "epoch_us")
    floor = max(1, (entries.agg(F.sum("n")).first()[0] or 0) // hot_share)
    hot = broadcast_within(entries.where(F.col("n") > floor).select(F.col("key").alias("hot"), F.col("epoch_us").alias("hot_us")), hot_share)
    cold = entries.where(F.col("n") <= floor).select(F.col("key").alias("cold"), F.col("epoch_us").alias("cold_us"))
    kept = [c for c in rows.columns if c.lower() != "epoch_us"]
    marked = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.when(F.col("raw").isNotNull(), pack()).alias("key"))
    marked = marked.join(hot, F.col("key") == F.col("hot"), "left")
    own = F.concat(F.lit("\x1d"), F.xxhash64("row", F.monotonically_increasing_id()).cast("string"))
    marked = marked.withColumn("key", F.when(F.col("hot").isNotNull() | F.col("key").isNull(), own).otherwise(F.col("key")))
    joined = marked.join(cold, F.col("key") == F.col("cold"), "left")
    us = F.when(F.col("hot").isNotNull(), F.col("hot_us")).otherwise(F.col("cold_us"))
    return joined.select("row", us.alias("epoch_us")).select("row.*", "epoch_us")
