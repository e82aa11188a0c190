"""Results depend on these names, numbers and orders."""

# A case is an entity and an observation time; its name goes along. Record ids
# may repeat from one entity to the next, so the name alone is no key.
CASE_KEY = ("case_id", "pid", "pred_dt")

# Time hierarchy of a record relative to its case, coarse to fine.
LEVELS = ("CP", "M", "W", "D", "H", "5Min")

# How many of the next finer level make one bucket
# (5-minute buckets are cut from seconds).
SECONDS_IN_5MIN = 300
FINER_PER_LEVEL = {"H": 12, "D": 24, "W": 7, "M": 4}

# Units of a check period, in microseconds.
UNIT_MICROS = {"min": 60_000_000, "H": 3_600_000_000, "D": 86_400_000_000}

# Hours (first, last) of each part of the day.
DAYPART_HOURS = {
    "Night": (0, 5),
    "Morning": (6, 11),
    "Afternoon": (12, 17),
    "Evening": (18, 23),
}

# The older preset, where two filters use the hours of the
# part of the day before theirs.
LEGACY_DAYPART_HOURS = {
    "Night": (0, 5),
    "Morning": (6, 11),
    "Afternoon": (6, 11),
    "Evening": (12, 17),
}

# Share of a completeness threshold that each filter asks for.
FILTER_SHARE = {"Whl": 1.0, "Morning": 0.25, "Afternoon": 0.25, "Evening": 0.25, "Night": 0.25}

# Default completeness thresholds per record type.
RECORD_THRESHOLDS = {"CGM5Min": {"RInDT": 0, "DTInD": 288 * 0.7, "DInCP": 0}}

# Calendar token prefixes, in list order.
CALENDAR_PREFIXES = ("Year-", "Month-", "Date-", "MEAN-", "Hour-", "Min-")
CALENDAR_GRAIN = "RDTCal"

UNK = "UNK"
UNK_IDX = 0
