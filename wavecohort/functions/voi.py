"""Variables of interest (VOI): a small dictionary VOI → list of measure codes (K7-K9).

The dictionary is a dimension of a handful of rows.  It is exploded to
``(voi, code)`` and joined with ``broadcast`` (its size is bounded by the
number of measure codes, not by the data).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from wavecohort.session import session_key

# The default dictionary of the source (code, label, measure codes).
DEFAULT_VOIS = [
    ("HR", "Heart rate", [10102, 10280]),
    ("RR", "Respiration rate", [10120, 10285]),
    ("ABPS", "Systolic arterial blood pressure", [11, 10281, 14]),
    ("ABPD", "Diastolic arterial blood pressure", [12, 10283, 15]),
    ("SPO2", "Blood oxygen saturation", [10168, 10291]),
    ("BT", "Body temperature", [4]),
]

# Variables that may be missing from a case (source: body temperature).
OPTIONAL_VOIS = ("BT",)

_DICTS: dict[tuple, DataFrame] = {}


def dictionary(spark: SparkSession, entries=None, code_type=None) -> DataFrame:
    """The dictionary as ``(voi STRING, label STRING, codes ARRAY<code_type>)``
    (built once per session and entry list)."""
    entries = DEFAULT_VOIS if entries is None else entries
    key = (session_key(spark), repr(entries), repr(code_type))
    if key not in _DICTS:
        _DICTS[key] = _dictionary(spark, entries, code_type)
    return _DICTS[key]


def _dictionary(spark: SparkSession, entries, code_type) -> DataFrame:
    if code_type is None:
        code_type = IntegerType() if all(isinstance(c, int) for e in entries for c in e[2]) else StringType()
    schema = StructType([StructField("voi", StringType(), False),
                         StructField("label", StringType(), False),
                         StructField("codes", ArrayType(code_type, False), False)])
    return spark.createDataFrame([(v, lab, list(c)) for v, lab, c in entries], schema)


def voi_code_table(dic: DataFrame, vois: list[str] | None = None) -> DataFrame:
    """``(voi, code)`` rows for the requested VOIs (all when ``None``)."""
    d = dic if vois is None else dic.filter(F.col("voi").isin(list(vois)))
    return d.select("voi", F.explode("codes").alias("code"))


def voi_codes(dic: DataFrame, vois: list[str]) -> DataFrame:
    """K8: union of the codes of ``vois``, sorted, as one row ``codes``.

    Nothing found gives a NULL array, like the source's ``None``.
    """
    return (voi_code_table(dic, vois)
            .agg(F.array_sort(F.collect_set("code")).alias("codes"))
            .select(F.when(F.size("codes") > 0, F.col("codes")).alias("codes")))


def codes_list(entries, vois: list[str]) -> list:
    """Driver-side code list of a fixed dictionary, for literal ``IN`` filters.

    Literal lists reach the Parquet reader as pushed ``In`` filters; the
    dictionary is a fixed handful of entries, never data.
    """
    out = set()
    for v, _lab, codes in entries:
        if v in vois:
            out.update(codes)
    return sorted(out)


def in_codes(col, codes: list) -> Column:
    """K7: membership in a literal code list."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isin(list(codes))


def voi_label(dic: DataFrame, vois: DataFrame, voi_col: str = "voi") -> DataFrame:
    """K9: label of each VOI in ``vois``; a VOI absent from the dictionary raises
    at run time (``raise_error``) as the source's lookup does."""
    j = vois.join(F.broadcast(dic.select(F.col("voi").alias("_v"), "label")),
                  F.col(voi_col) == F.col("_v"), "left")
    return j.select(*vois.columns,
                    F.when(F.col("_v").isNull(),
                           F.raise_error(F.concat(F.lit("unknown VOI: "), F.col(voi_col))))
                    .otherwise(F.col("label")).cast("string").alias("label"))
