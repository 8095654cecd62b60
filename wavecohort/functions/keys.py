"""Key building and scalar column functions.

All functions return :class:`pyspark.sql.Column` expressions built from
``pyspark.sql.functions`` so that they stay inside whole-stage codegen and
filters written with them reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ, independent
    of the session time zone for NTZ values."""
    return F.timestamp_diff("MICROSECOND", _epoch_ntz(), _c(ts).cast("timestamp_ntz"))


def ntz_from_epoch_us(us) -> Column:
    """TIMESTAMP_NTZ from microseconds since the epoch, independent of the
    session time zone."""
    return F.timestamp_add("MICROSECOND", _c(us), _epoch_ntz())


def day_start(ts) -> Column:
    """Midnight of the day of ``ts`` as TIMESTAMP_NTZ."""
    return F.to_date(_c(ts)).cast("timestamp_ntz")


# ------------------------------------------------------------------ K1/K2 case id

def case_id(id_col, ts_col) -> Column:
    """K1: ``lpad(id, 10, '0') || yyyy-MM-dd``.  Note lpad also truncates ids
    longer than 10 characters, exactly as in the source."""
    return F.concat(F.lpad(_c(id_col).cast("string"), 10, "0"),
                    F.to_date(_c(ts_col)).cast("string"))


def pad_left(col, width: int) -> Column:
    """Zero-padded text of at least ``width`` characters (never cut)."""
    s = _c(col).cast("string")
    return F.when(F.char_length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def stay_key(col) -> Column:
    """Stored text form of a stay id: ten digits, longer ids whole.  Joins use the
    raw id; this is for sinks and for joins between stored tables."""
    return pad_left(col, 10)


def split_case_id(col) -> tuple[Column, Column]:
    """K2: ``(id_nda, j1)`` from a case id: ten digits or more, then the date."""
    # fixed value: the form of a stored case id
    c, form = _c(col), r"^([0-9]{10,})([0-9]{4}-[0-9]{2}-[0-9]{2})"
    return F.regexp_extract(c, form, 1), F.regexp_extract(c, form, 2)


def split_case_id_fixed(col) -> tuple[Column, Column]:
    """K2 (substring form): the last ten characters are the date, the id comes before them."""
    c = _c(col)
    cut = F.greatest(F.char_length(c) - 10, F.lit(10))
    return c.substr(F.lit(1), cut), c.substr(cut + 1, F.char_length(c) - cut)


# ------------------------------------------------------------------ K3/K4 form keys

def form_key(id_col, date_col, form_col) -> Column:
    """K3: ``id || yyyy-MM-dd || '_' || form``."""
    return F.concat(_c(id_col).cast("string"), F.date_format(_c(date_col), "yyyy-MM-dd"),
                    F.lit("_"), _c(form_col).cast("string"))


def strip_form(col) -> Column:
    """K3: drop the suffix after the last ``_`` (greedy match)."""
    return F.regexp_extract(_c(col), r"(.*)_.*", 1)


def effective_date(j1, ins) -> Column:
    """K4: ``j1`` when present, else the insertion date (wall-clock
    timestamps, independent of the session time zone)."""
    return F.coalesce(_c(j1).cast("string").try_cast("timestamp_ntz"),
                      _c(ins).cast("string").try_cast("timestamp_ntz"))


# ------------------------------------------------------------------ K5/K6 flags

def outcome(col) -> Column:
    """K5: death recorded = not null and not the ``'None'`` sentinel."""
    c = _c(col)
    return c.isNotNull() & (c.cast("string") != F.lit("None"))


def outcome_label(col) -> Column:
    return F.when(outcome(col), "dead").otherwise("alive")


def active(df: DataFrame, positive: bool = True) -> DataFrame:
    """K6: not cancelled (``dt_cancel = ''``) and, optionally, value > 0.

    Written on the raw columns so that both predicates reach the scan.
    """
    cond = F.col("dt_cancel") == ""
    if positive:
        cond = cond & (F.col("value_numeric") > 0)
    return df.filter(cond)


# ------------------------------------------------------------------ K10/K11 fields, casts

def form_fields(field_col, prefixes: list[str], names: list[str]) -> Column:
    """``field LIKE 'p%'`` for any prefix, or ``field IN names``.
    ``_`` stays a one-character wildcard as in SQL LIKE."""
    c = _c(field_col)
    cond = c.isin(list(names)) if names else F.lit(False)
    for p in prefixes:
        cond = cond | c.like(p + "%")
    return cond


def to_ts(col, fmt: str | None = None) -> Column:
    """String → timestamp; sentinels such as 'None'/'NaT' become NULL."""
    c = _c(col).cast("string")
    if fmt:
        return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")
    return c.try_cast("timestamp_ntz")


def to_float(col) -> Column:
    """Text → DOUBLE, NULL when not a number."""
    return _c(col).try_cast("double")


def round_int(col) -> Column:
    """``round(x)`` then INT (half away from zero, as SQL ROUND)."""
    return F.round(_c(col)).cast("int")


# ------------------------------------------------------------------ K13-K17

def fix_charset(col, source: str = "ISO-8859-1") -> Column:
    """Reinterpret bytes in ``source`` encoding as text."""
    return F.decode(_c(col).cast("binary"), source)


def url_unquote(col) -> Column:
    """Percent-decode like ``unquote``: valid ``%XX`` escapes are decoded,
    a ``%`` not followed by two hex digits and a ``+`` stay as they are.
    When the decoded bytes are not valid UTF-8 the raw text is kept.
    """
    c = _c(col)
    esc = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    dec = F.try_url_decode(esc)
    bad = dec.isNull() | (F.contains(dec, F.lit("\ufffd")) & ~F.contains(c, F.lit("\ufffd")))
    return F.when(bad, c).otherwise(dec)


def interval_key(var, seq, interval) -> Column:
    """``VAR || NN || '__' || interval`` with a two-digit sequence."""
    return F.concat(_c(var), F.format_string("%02d", _c(seq)), F.lit("__"), _c(interval).cast("string"))


def log1p_col(col) -> Column:
    """``ln(x + 1)``."""
    return F.log1p(_c(col).cast("double"))


def sqrt_col(col) -> Column:
    return F.sqrt(_c(col).cast("double"))


def logistic(col) -> Column:
    c = _c(col).cast("double")
    return F.exp(c) / (F.lit(1.0) + F.exp(c))
