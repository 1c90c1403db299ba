"""Timestamp normalisation as column expressions (``dd/MM/yy HH:mm:ss.SSS``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.regex import group_indexes, java_regex, strip
from logweave.rules.timestamps import (
    CATALOGUE_DEFAULT_MONTH,
    CATALOGUE_DEFAULT_YEAR,
    MONTHS_EN,
    MONTHS_ES,
    TIMESTAMP_CATALOGUE,
)

_EN = "|".join(MONTHS_EN)
_ES_EN = "|".join(dict.fromkeys([*MONTHS_ES, *MONTHS_EN]))
_CLOCK = r"(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})"
_NUMERIC_MARK = "n"
_YEAR_MARK = "yyyy"
_NORMALISED = r"^\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\.\d+$"

# Strategies in order; group names say which part of the result they feed.
_STRATEGIES = [
    # 23-DEC-2024 11:44:26
    rf"^(?P<day>\d{{1,2}})-(?P<month_name>{_ES_EN})-(?P<year>\d{{4}})\s+{_CLOCK}",
    # Sun Aug  9 02:00:07.608092
    rf"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(?P<month_name>{_EN})\s{{1,2}}(?P<day>\d{{1,2}})\s+{_CLOCK}\.(?P<fraction>\d{{6}})",
    # Aug 20 19:14:03.206883
    rf"^(?P<month_name>{_EN})\s{{1,2}}(?P<day>\d{{1,2}})\s+{_CLOCK}\.(?P<fraction>\d{{6}})",
    # 31 jul 2026 23:34:03,027
    rf"^(?P<day>\d{{1,2}})\s+(?P<month_name>{_ES_EN})\s+(?P<year>\d{{4}})\s+{_CLOCK}[,.](?P<fraction>\d{{3}})",
    # 2020-02-14T20:14:34.807103
    rf"^(?P<year>\d{{4}})-(?P<month>\d{{2}})-(?P<day>\d{{2}})T{_CLOCK}\.(?P<fraction>\d+)",
    # 13/02/2024 10:00:00.5, day or month first
    rf"^(?P<numeric_day>\d{{1,2}})[/\-](?P<month>\d{{1,2}})[/\-](?P<year>\d{{2,4}})\s+{_CLOCK}(?:\.(?P<fraction>\d+))?",
    # Jun 14 15:16:01
    rf"^(?P<month_name>{_EN})\s{{1,2}}(?P<day>\d{{1,2}})\s+{_CLOCK}\s*$",
]


def _only(text: Column, pattern: str) -> Column:
    """The text if it has the given form, else null; names ``text`` once, so chains of steps stay small."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0))


def _canonical(text: Column, patterns: Sequence[str], default_year: str, ignore_case: bool) -> Column:
    """``day|month|year|hh:mm:ss|fraction`` of the first pattern found, lower case, numbers with spare zeros."""
    result = None
    for pattern in patterns:
        regex = java_regex(rf"(?s)^.*?(?:{pattern}).*$", ignore_case=ignore_case)
        at = {name: f"${index}" for name, index in group_indexes(pattern).items()}
        day = f"{_NUMERIC_MARK}0" + at["numeric_day"] if "numeric_day" in at else "0" + at.get("day", "01")
        month = at.get("month_name") or "0" + at.get("month", CATALOGUE_DEFAULT_MONTH)
        clock = ":".join(at.get(unit, "00") for unit in ("hour", "minute", "second"))
        fraction = (at.get("fraction") or at.get("milliseconds") or at.get("microseconds", "")) + "000"
        form = "|".join([day, month, at.get("year", default_year), clock, fraction])
        hit = text.rlike(java_regex(pattern, ignore_case=ignore_case))
        value = F.regexp_replace(text, regex, form)
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return F.lower(result)


def _assemble(canonical: Column, months: dict[str, str], year: Column) -> Column:
    """The normalised form, as a chain of steps that each name the previous one once."""
    text = F.replace(canonical, F.lit(_YEAR_MARK), year)
    for name, number in months.items():
        text = F.replace(text, F.lit(f"|{name}|"), F.lit(f"|{number}|"))
    # A month name nobody knows.
    text = F.regexp_replace(text, r"^(n?\d+)\|[^|]*[^\d|][^|]*\|", rf"$1|{CATALOGUE_DEFAULT_MONTH}|")
    # Numeric dates: the second number is the month unless only the first one can be.
    text = F.regexp_replace(text, r"^n(0*(?:\d|1[0-2]))\|(0*(?:1[3-9]|[2-9]\d))\|", "n$2|$1|")
    text = F.regexp_replace(text, r"^n(?!0*(?:[1-9]|[12]\d|3[01])\|0*(?:[1-9]|1[0-2])\|).*$", "")
    text = F.regexp_replace(
        text, r"^n?\d*?(\d{2})\|\d*?(\d{2})\|\d*?(\d{2})\|([\d:]+)\|(\d{3})\d*$", "$1/$2/$3 $4.$5"
    )
    return _only(text, _NORMALISED)


def normalize_timestamp(raw: Column, year: Column | int | None = None) -> Column:
    """Ordered strategies; formats without a year take ``year`` (the running year by default)."""
    this_year = F.year(F.current_timestamp()) if year is None else (F.lit(year) if isinstance(year, int) else year)
    canonical = _canonical(strip(raw), _STRATEGIES, _YEAR_MARK, ignore_case=True)
    return _assemble(canonical, {**MONTHS_EN, **MONTHS_ES}, this_year.cast("string"))


def generic_timestamp(raw: Column, patterns: Sequence[str] = TIMESTAMP_CATALOGUE) -> Column:
    """The catalogue variant: first pattern found decides, missing year and month take fixed defaults."""
    canonical = _canonical(strip(raw), patterns, CATALOGUE_DEFAULT_YEAR, ignore_case=False)
    return _assemble(canonical, MONTHS_EN, F.lit(CATALOGUE_DEFAULT_YEAR))


def _iso_text(timestamp: Column) -> Column:
    text = F.regexp_replace(timestamp, r"^(\d{2})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2}\.\d+)$", "20$3-$2-$1T$4")
    return _only(text, r"^20\d{2}-\d{2}-\d{2}T.*$")


def event_ts(timestamp: Column) -> Column:
    """Wall-clock instant of a normalised timestamp, null when there is none."""
    return _iso_text(timestamp).try_cast("timestamp_ntz")


def event_date(timestamp: Column) -> Column:
    """Day key of a normalised timestamp; null means undated."""
    text = F.regexp_replace(timestamp, r"^(\d{2})/(\d{2})/(\d{2}) [^ ]*$", "20$3-$2-$1")
    return _only(text, r"^20\d{2}-\d{2}-\d{2}$").try_cast("date")


def iso_timestamp(timestamp: Column, run_ts: Column) -> Column:
    """ISO text for search documents; text that is no timestamp takes the run's own time."""
    # Text of a zone-less instant: the fraction comes without trailing zeros, or not at all.
    text = F.replace(event_ts(timestamp).cast("string"), F.lit(" "), F.lit("T"))
    padded = F.regexp_replace(F.regexp_replace(text, r"\.(\d+)$", ".$1000000"), r"(\.\d{6})\d*$", "$1")
    return F.coalesce(padded, run_ts)
