"""Month names and the catalogue of timestamp formats."""

# Three-letter month names, English and Spanish.
MONTHS_EN = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}
MONTHS_ES = {
    "ene": "01", "feb": "02", "mar": "03", "abr": "04", "may": "05", "jun": "06",
    "jul": "07", "ago": "08", "sep": "09", "oct": "10", "nov": "11", "dic": "12",
}

# The timestamp catalogue, in order of preference.
TIMESTAMP_CATALOGUE = [
    # 2023-10-11 12:34:56
    r"^(?P<year>\d{4})-(?P<month>\d{2})-(?P<day>\d{2})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})",
    # 11/10/2023 12:34:56
    r"^(?P<day>\d{2})/(?P<month>\d{2})/(?P<year>\d{4})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})",
    # 2023/10/11 12:34:56
    r"^(?P<year>\d{4})/(?P<month>\d{2})/(?P<day>\d{2})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})",
    # 29 Jun 2026 02:04:07,195
    r"^(?P<day>\d{2})\s+(?P<month_name>\w{3})\s+(?P<year>\d{4})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2}),(?P<milliseconds>\d{3})",
    # 217668<TAB>Thu Jun 25 18:00:02.591327
    r"^(?P<pid>\d{6})\t(?P<day_name>\w{3})\s+(?P<month_name>\w{3})\s+(?P<day>\d{1,2})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})\.(?P<microseconds>\d{6})",
    # Thu Jun 25 18:00:02.591327
    r"^(?P<day_name>\w{3})\s+(?P<month_name>\w{3})\s+(?P<day>\d{1,2})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})\.(?P<microseconds>\d{6})",
    # Wed Jun 24 16:26:13 CEST 2026
    r"^(?P<day_name>\w{3})\s+(?P<month_name>\w{3})\s+(?P<day>\d{1,2})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})\s+(?P<timezone>\w{3,4})\s+(?P<year>\d{4})",
    # 06-JUL-2026 21:12:31
    r"^(?P<day>\d{2})-(?P<month_name>\w{3})-(?P<year>\d{4})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})",
    # Time 06-JUL-2026 21 12 31
    r"^Time\s+(?P<day>\d{2})-(?P<month_name>\w{3})-(?P<year>\d{4})\s+(?P<hour>\d{2})\s+(?P<minute>\d{2})\s+(?P<second>\d{2})",
    # 11 ene 2026 02:04:07,195
    r"^(?P<day>\d{1,2})\s+(?P<month_name>ene|feb|mar|abr|may|jun|jul|ago|sep|oct|nov|dic)\s+(?P<year>\d{4})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})[,.](?P<milliseconds>\d{3})",
    # 11 Jan 2026 02:04:07,195
    r"^(?P<day>\d{1,2})\s+(?P<month_name>Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(?P<year>\d{4})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})[,.](?P<milliseconds>\d{3})",
    # Jun 14 15:16:01
    r"^(?P<month_name>\w{3})\s+(?P<day>\d{1,2})\s+(?P<hour>\d{2}):(?P<minute>\d{2}):(?P<second>\d{2})",
]

# Year and month the catalogue variant assumes when the text has none.
CATALOGUE_DEFAULT_YEAR = "2026"
CATALOGUE_DEFAULT_MONTH = "01"
