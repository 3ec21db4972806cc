"""Mixed timestamp forms and zones, brought to one UTC moment.

``parse_moments`` reads every written form with Spark expressions only: a handful of patterns split the text into date,
clock and zone parts, and the parts are assembled once.  ``resolve_zones`` then chooses, for each group of lines that
state no zone, the offset history (a zone id) under which the fewest lines contradict what is known about their order:
a moment later than the line's arrival, a clock time that the history skips, or a step back against the stated sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import checked_join, fence

# Month names, zone abbreviations as used in Europe (minutes east of UTC) and the day-number epoch.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ABBREVIATIONS = {"Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "BST": 60, "IST": 60, "WEST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "TRT": 180}
SHEET_EPOCH_DAYS = -25569

DEFAULT_ZONE = "Europe/London"
#: Histories tried for lines without a zone, besides the prior.
CANDIDATE_ZONES = ("UTC", "Europe/Paris", "Europe/Athens")

_DAY_FIRST = r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})(?![\d/.])"
_NAMED = r"^(?:[A-Za-z]{3,9},? +)?(\d{1,2})(?:st|nd|rd|th)?[- ]+([A-Za-z]{3,9})\.?,?[- ]+(\d{4}|\d{2})(?!\d)"
_ISO = r"^(\d{4})-(\d{2})-(\d{2})(?!\d)"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?=T?\d{4})"
_CLOCK = r"^(?:T|,? +)(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)? ?([AaPp])?(?:\.?[Mm]\.?)? ?(.*)$"
_COMPACT_CLOCK = r"^T?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?() ?(.*)$"
_OFFSET = r"^(?:UTC|GMT)?([+-])(\d{2}):?(\d{2})?$"
_REGION = r"^\[?([A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+-]+){1,2})\]?$"


def known_zones(spark) -> list[str]:
    """Region names that both this Python and the executors' time-zone data know."""
    import zoneinfo

    jvm = set(spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z and z in jvm)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_moments(df: DataFrame, text: str, zones: Sequence[str] | None = None) -> DataFrame:
    """Add ``_kind``, ``_local``, ``_offset_min``, ``_region`` and ``_instant`` to ``df`` for the text column ``text``.

    ``_local`` is the written wall clock in microseconds as if it were UTC; ``_instant`` is set where the text itself
    fixes the moment (a count since 1970, or a stated offset).  ``_kind`` is 'count', 'sheet', 'clock', 'day' or NULL.
    NULL, blank, impossible and unreadable texts give NULL in all five.  No row is added or dropped.
    """
    zones = list(zones) if zones is not None else known_zones(df.sparkSession)
    d = df.withColumn("_t", F.regexp_replace(F.regexp_replace(F.col(text), r"[\s\u00a0\ufeff]+", " "), r"^ | $", ""))
    t = F.col("_t")
    form = (
        F.when(t.rlike(r"^\d{9,10}$"), "s").when(t.rlike(r"^\d{13}$"), "ms").when(t.rlike(r"^\d{16}$"), "us").when(t.rlike(r"^\d{19}$"), "ns")
        .when(t.rlike(r"^\d{5}\.\d+$"), "sheet").when(t.rlike(r"^\d{5}$"), "sheetday")
        .when(t.rlike(_ISO), "iso").when(t.rlike(_DAY_FIRST), "dayfirst").when(t.rlike(_NAMED), "named").when(t.rlike(_COMPACT), "compact")
    )
    d = d.withColumn("_form", form)
    f = F.col("_form")
    pattern = {"iso": _ISO, "dayfirst": _DAY_FIRST, "named": _NAMED, "compact": _COMPACT}

    def pick(groups: dict[str, int]) -> Column:
        out = None
        for k, g in groups.items():
            out = (out.when(f == k, F.regexp_extract(t, pattern[k], g)) if out is not None else F.when(f == k, F.regexp_extract(t, pattern[k], g)))
        return out

    rest = None
    for k in pattern:
        rest = rest.when(f == k, F.regexp_replace(t, pattern[k], "")) if rest is not None else F.when(f == k, F.regexp_replace(t, pattern[k], ""))
    d = d.select(
        "*",
        pick({"iso": 1, "dayfirst": 3, "named": 3, "compact": 1}).alias("_y"),
        pick({"iso": 2, "dayfirst": 2, "named": 2, "compact": 2}).alias("_mo"),
        pick({"iso": 3, "dayfirst": 1, "named": 1, "compact": 3}).alias("_d"),
        rest.alias("_rest"),
    )
    has_clock = F.when(f == "compact", F.col("_rest").rlike(_COMPACT_CLOCK)).otherwise(F.col("_rest").rlike(_CLOCK))

    def on_clock(g: int) -> Column:
        return F.when(f == "compact", F.regexp_extract("_rest", _COMPACT_CLOCK, g)).otherwise(F.regexp_extract("_rest", _CLOCK, g))

    year = F.when(F.length("_y") == 2, F.concat(F.lit("20"), F.col("_y"))).otherwise(F.col("_y")).cast("int")
    name = F.lower("_mo")
    by_name = F.create_map(*[F.lit(x) for i, (a, b) in enumerate(zip(MONTHS, LONG_MONTHS, strict=True)) for x in ([a, i + 1] if a == b else [a, i + 1, b, i + 1])], F.lit("sept"), F.lit(9))
    month = F.when(f == "named", F.try_element_at(by_name, name)).otherwise(F.expr("try_cast(_mo as int)"))
    d = d.withColumn("_has_clock", F.coalesce(has_clock, F.lit(False)))
    d = d.select(
        "*", year.alias("_yy"), month.alias("_mm"), F.expr("try_cast(_d as int)").alias("_dd"),
        F.when(F.col("_has_clock"), on_clock(1).cast("int")).alias("_h0"), F.when(F.col("_has_clock"), on_clock(2).cast("int")).alias("_mi"),
        F.when(F.col("_has_clock"), F.coalesce(F.nullif(on_clock(3), F.lit("")).cast("int"), F.lit(0))).alias("_s"),
        F.when(F.col("_has_clock"), F.substring(F.rpad(on_clock(4), 6, "0"), 1, 6).cast("int")).alias("_us"),
        F.when(F.col("_has_clock"), F.lower(on_clock(5))).alias("_half"), F.when(F.col("_has_clock"), F.trim(on_clock(6))).alias("_zone"),
    )
    half = F.col("_half")
    hour = F.when(half == "", F.col("_h0")).when(F.col("_h0").between(1, 12), F.col("_h0") % 12 + F.when(half == "p", 12).otherwise(0))
    sane = (F.col("_mi") < 60) & (F.col("_s") < 60) & (hour < 24)
    day = F.expr("try_make_timestamp(_yy, _mm, _dd, 0, 0, 0, 'UTC')")
    clock_us = F.unix_micros(day) + ((hour * 60 + F.col("_mi")) * 60 + F.col("_s")).cast("bigint") * 1_000_000 + F.col("_us")
    sheet_us = F.round((F.expr("try_cast(_t as decimal(20,12))") + F.lit(SHEET_EPOCH_DAYS)) * 86_400, 0).cast("bigint") * 1_000_000
    zone = F.col("_zone")
    abbreviation = F.try_element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), F.upper(zone))
    sign = F.when(F.regexp_extract(zone, _OFFSET, 1) == "-", -1).otherwise(1)
    offset = F.when(zone.rlike(_OFFSET), sign * (F.regexp_extract(zone, _OFFSET, 2).cast("int") * 60 + F.coalesce(F.nullif(F.regexp_extract(zone, _OFFSET, 3), F.lit("")).cast("int"), F.lit(0)))).otherwise(abbreviation)
    region = _part(zone, _REGION, 1)
    region = F.when(region.isin(zones), region)
    d = d.withColumn("_off0", offset).withColumn("_reg0", F.when(F.col("_off0").isNull(), region))
    readable = (zone == "") | F.col("_off0").isNotNull() | F.col("_reg0").isNotNull()
    good = F.col("_has_clock") & sane & readable & day.isNotNull()
    kind = (
        F.when(f.isin("s", "ms", "us", "ns"), "count").when(f == "sheet", "sheet").when(f == "sheetday", "day")
        .when(good, "clock").when((F.col("_rest") == "") & day.isNotNull(), "day")
    )
    number = F.expr("try_cast(_t as bigint)")
    count_us = F.when(f == "s", number * 1_000_000).when(f == "ms", number * 1_000).when(f == "us", number).when(f == "ns", F.expr("try_cast(_t as bigint) div 1000"))
    d = d.withColumn("_kind", kind)
    local = F.when(F.col("_kind") == "clock", clock_us).when(F.col("_kind") == "sheet", sheet_us)
    d = d.withColumn("_local", local)
    k = F.col("_kind")
    d = d.select(
        *[F.col(f"`{c}`") for c in df.columns], "_kind", "_local",
        F.when(k == "clock", F.col("_off0")).alias("_offset_min"), F.when(k == "clock", F.col("_reg0")).alias("_region"),
        F.when(k == "count", count_us).when((k == "clock") & F.col("_off0").isNotNull(), F.col("_local") - F.col("_off0").cast("bigint") * 60_000_000).alias("_instant"),
    )
    return fence(d, ["_kind", "_local", "_offset_min", "_region", "_instant"])


def local_to_utc(local: Column, zone: str | Column) -> Column:
    """Microseconds UTC of a wall clock in a zone: the earlier of two instants, NULL for a time that never occurs."""
    utc = F.to_utc_timestamp(F.timestamp_micros(local), zone)
    back = F.unix_micros(F.from_utc_timestamp(utc, zone))
    return F.when(back == local, F.unix_micros(utc))


def zone_violations(parsed: DataFrame, group: Sequence[str], arrival: str, zones: Sequence[str], sequence: str | None = None) -> DataFrame:
    """Per group, the lines without a zone and, for each candidate history, how many of them contradict it.

    A line contradicts a history if its moment would lie after its arrival, if the history skips its clock time, or (when
    ``sequence`` names a non-decreasing moment column known from elsewhere) if it would precede that moment.
    """
    free = F.col("_kind").isin("clock", "sheet") & F.col("_offset_min").isNull() & F.col("_region").isNull()
    counts = [F.count_if(free).alias("lines")]
    for i, z in enumerate(zones):
        utc = local_to_utc(F.col("_local"), z)
        bad = utc.isNull() | F.coalesce(utc > F.unix_micros(F.col(arrival).cast("timestamp")), F.lit(False))
        if sequence:
            bad = bad | F.coalesce(utc < F.unix_micros(F.col(sequence).cast("timestamp")), F.lit(False))
        counts.append(F.count_if(free & bad).alias(f"v{i}"))
    return parsed.groupBy(*group).agg(*counts)


def choose_zones(violations: DataFrame, zones: Sequence[str], least_gain: float = 0.5) -> DataFrame:
    """The history of each group: ``zones[0]`` (the prior) unless another removes violations of more than ``least_gain`` of the lines.

    Among those, the one with the fewest violations wins, the earlier in ``zones`` on a tie.
    """
    best = F.least(*[F.struct(F.col(f"v{i}").alias("v"), F.lit(i).alias("i")) for i in range(len(zones))]) if len(zones) > 1 else F.struct(F.col("v0").alias("v"), F.lit(0).alias("i"))
    names = F.array(*[F.lit(z) for z in zones])
    gain = (F.col("v0") - F.col("_b.v")) > F.col("lines") * F.lit(least_gain)
    return violations.withColumn("_b", best).withColumn("zone", F.when(gain, F.element_at(names, F.col("_b.i") + 1)).otherwise(F.lit(zones[0]))).drop("_b")


def normalise_moments(df: DataFrame, text: str, group: Sequence[str], arrival: str, prior: str = DEFAULT_ZONE, candidates: Sequence[str] = CANDIDATE_ZONES, least_gain: float = 0.5, bound: int = 10_000, sequence: str | None = None) -> DataFrame:
    """``df`` with ``utc_micros`` (bigint) and ``zone_used``.

    Texts that fix their moment keep it.  A stated region is applied as it is.  Other clock times and spreadsheet
    numbers take the history chosen for their group, by their ``arrival`` and, where ``sequence`` names a moment column that a line
    can't precede (such as that of the line before it), by their order.  NULL, blank or unreadable texts, days without a time, impossible
    days and clock times that never occurred give NULL; repeated rows stay repeated; an empty table stays empty; columns
    of other names are untouched, those named utc_micros or zone_used are replaced.  A group whose key is NULL is a group of its own.
    """
    zones = [prior, *[z for z in candidates if z != prior]]
    keys = [f"_g{i}" for i in range(len(group))]
    # the row travels as one struct, so that no helper column can clash with one of its own
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"), F.col(f"`{arrival}`").alias("_arrival"), (F.col(f"`{sequence}`") if sequence else F.lit(None).cast("timestamp")).alias("_sequence"), *[F.coalesce(F.col(f"`{g}`").cast("string"), F.lit("\u0000")).alias(k) for g, k in zip(group, keys, strict=True)])
    # read twice, parsed once
    parsed = parse_moments(held, "_text").persist(StorageLevel.MEMORY_AND_DISK)
    chosen = choose_zones(zone_violations(parsed, keys, "_arrival", zones, "_sequence" if sequence else None), zones, least_gain).where(F.col("zone") != prior).select(*keys, F.col("zone").alias("_zone"))
    exceptions = chosen.limit(bound + 1).collect()
    if not exceptions:
        parsed = parsed.withColumn("_zone", F.lit(prior))
    elif len(exceptions) <= bound:
        parsed = parsed.join(F.broadcast(df.sparkSession.createDataFrame(exceptions, chosen.schema)), keys, "left").fillna({"_zone": prior})
    else:
        parsed = checked_join(parsed, chosen, keys, "left", bound=bound).fillna({"_zone": prior})
    zone = F.coalesce(F.col("_region"), F.col("_zone"))
    needs = F.col("_kind").isin("clock", "sheet") & F.col("_instant").isNull()
    utc = F.when(needs, local_to_utc(F.col("_local"), zone)).otherwise(F.col("_instant"))
    out = fence(parsed.select("_row", utc.alias("utc_micros"), F.when(needs, zone).alias("zone_used")), ["utc_micros", "zone_used"])
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in ("utc_micros", "zone_used")], "utc_micros", "zone_used")
