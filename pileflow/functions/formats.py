"""Number formats of the reports: C's rounding, which Spark's format_string doesn't share."""


def fixed(x: float | None, digits: int = 2) -> str:
    return "NA" if x is None else f"%.{digits}f" % x


def percent(part: float | None, whole: float | None) -> float | None:
    return None if part is None or not whole else 100.0 * part / whole
