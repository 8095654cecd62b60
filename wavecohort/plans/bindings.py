"""Role tables derived from the driver's test tables (FIXTURES.md §3).

Each role (measures, movements, stays, patients, forms, page counts, ...) is a
projection or an aggregate of the given tables computed by Spark, so the work
of every query grows with the tables.  ``SQL`` holds the same derivations as
DuckDB common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.functions.keys import pad_left, stay_key
from wavecohort.session import session_key

# Dictionary used with the test tables (VOI → event types).
TEST_VOIS = [
    ("HR", "Heart rate", ["click", "view"]),
    ("RR", "Respiration rate", ["error"]),
    ("ABPS", "Systolic arterial blood pressure", ["purchase"]),
    ("ABPD", "Diastolic arterial blood pressure", ["signup"]),
]
TEST_VOI_NAMES = [v for v, _l, _c in TEST_VOIS]
TEST_CODES = sorted({c for _v, _l, cs in TEST_VOIS for c in cs})

# Parameters of the test bindings.
DEATH_BASE = "2024-01-01 12:00:00"   # patients' death date = base + (key*13 mod 40) days
AGE_BASE, AGE_MOD = 10, 70            # age = 10 + (key*7 mod 70)
ICU_MAX_REGION = 4                    # units = nations with n_regionkey < 4
DATED_SHIFT = 18                      # days: dated page counts start in December
PAGE_DAY = "2024-01-20 13:00:00"      # "now" for the page-count windows


_TABLES: dict[tuple, DataFrame] = {}


def _memo(fn):
    """Role tables are views over the given tables: build each DataFrame once
    per (session, folder) and reuse it (lazy plans, no data is held)."""
    def wrapper(spark: SparkSession, d: str, *args):
        key = (session_key(spark), d, fn.__name__, args)
        if key not in _TABLES:
            _TABLES[key] = fn(spark, d, *args)
        return _TABLES[key]
    wrapper.__name__, wrapper.__doc__ = fn.__name__, fn.__doc__
    return wrapper


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table, resolved once per session (file listing and footer
    reads happen once, as with a catalog table)."""
    key = (session_key(spark), d, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{d}/{name}.parquet")
    return _TABLES[key]


@_memo
def sensors(spark: SparkSession, d: str) -> DataFrame:
    """Measures: ``(id_nda, id_measure_type, dt_insert, value_numeric, dt_cancel)``."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").alias("id_nda"), F.col("event_type").alias("id_measure_type"),
        F.col("ts").alias("dt_insert"), F.col("value").alias("value_numeric"),
        F.when(k < 5, F.lit("x")).otherwise(F.lit("")).alias("dt_cancel"))


def _user_spans(spark: SparkSession, d: str) -> DataFrame:
    """One aggregate of ``events`` per user shared by movements and stays
    (the same plan object, so Spark computes its shuffle once)."""
    key = (session_key(spark), d, "_user_spans")
    if key not in _TABLES:
        _TABLES[key] = table(spark, d, "events").groupBy("user_id").agg(
            F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("first_signup"),
            F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return _TABLES[key]


@_memo
def moves(spark: SparkSession, d: str) -> DataFrame:
    """Unit movements, one per user: start at the first signup, end at the last event."""
    m = _user_spans(spark, d)
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return (m.filter(F.col("first_signup").isNotNull())
            .join(cust, m.user_id == cust.c_custkey, "inner")
            .select(F.col("user_id").alias("id_nda"), F.col("user_id").alias("ids_pat"),
                    F.col("c_nationkey").alias("ids_ufr"), F.col("first_signup").alias("dt_deb_mouv_ufr"),
                    F.col("last_ts").alias("dt_fin_mouv_ufr")))


@_memo
def units(spark: SparkSession, d: str) -> DataFrame:
    """ICU units: nations of the first regions."""
    return (table(spark, d, "nation").filter(F.col("n_regionkey") < ICU_MAX_REGION)
            .select(F.col("n_nationkey").alias("ids_ufr")))


@_memo
def stays(spark: SparkSession, d: str) -> DataFrame:
    """Hospital stays per user: first to last event."""
    return _user_spans(spark, d).select(F.col("user_id").alias("id_nda"), F.col("first_ts").alias("dt_deb_nda"),
                                        F.col("last_ts").alias("dt_fin_nda"))


@_memo
def patients(spark: SparkSession, d: str) -> DataFrame:
    """Demographics from ``customer``; death date only for negative balances."""
    c = table(spark, d, "customer")
    days = F.pmod(F.col("c_custkey") * 13, F.lit(40)).cast("int")
    return c.select(
        F.col("c_custkey").alias("ids_pat"),
        (F.lit(AGE_BASE) + F.pmod(F.col("c_custkey") * 7, F.lit(AGE_MOD))).cast("double").alias("age"),
        F.when(F.pmod(F.col("c_custkey"), F.lit(2)) == 0, F.lit("F")).otherwise(F.lit("M")).alias("cd_sex_tr"),
        F.when(F.col("c_acctbal") < 0,
               F.lit(DEATH_BASE).cast("timestamp_ntz") + F.make_dt_interval(days=days)).alias("dt_deces"),
        F.col("c_mktsegment").alias("dpt"))


@_memo
def order_stays(spark: SparkSession, d: str) -> DataFrame:
    """Stays with a recorded death date from orders ⋈ lineitem:
    start = order date, end = last ship date, death = first ship date flagged 'R'."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("dt_fin_nda"),
        F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("dt_deces"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return o.join(li, o.o_orderkey == li.l_orderkey, "inner").select(
        F.col("o_orderkey").alias("id_nda"), F.col("o_orderdate").alias("dt_deb_nda"), "dt_fin_nda", "dt_deces")


@_memo
def case_table(spark: SparkSession, d: str) -> DataFrame:
    """Stored cases ``(id_nda STRING(10), j1 DATE, dt_deces)`` of order stays."""
    s = order_stays(spark, d)
    return s.select(stay_key("id_nda").alias("id_nda"),
                    F.to_date("dt_deb_nda").alias("j1"), "dt_deces")


@_memo
def form_rows(spark: SparkSession, d: str) -> DataFrame:
    """Form answers, long: form = conversation, field = 'f' || turn, value = text length mod 100."""
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("id_form"),
                    F.concat(F.lit("f"), pad_left("turn", 2)).alias("champ_formulaire"),
                    F.pmod(F.char_length("text"), F.lit(100)).cast("string").alias("lwert"), "role")


@_memo
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly page counts: ``(month_day 'MMdd', hour, prj, page, hits)``."""
    ev = table(spark, d, "events")
    return ev.select(F.date_format("ts", "MMdd").alias("month_day"), F.hour("ts").alias("hour"),
                     F.col("event_type").alias("prj"), F.col("user_id").cast("string").alias("page"),
                     F.get_json_object("props", "$.k").try_cast("bigint").alias("hits"))


@_memo
def dated_page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hourly page counts with a date, set back by 18 days so that they cross New Year:
    ``(day DATE, hour, prj, page, hits)``."""
    ev = table(spark, d, "events")
    return ev.select(F.date_sub(F.to_date("ts"), DATED_SHIFT).alias("day"), F.hour("ts").alias("hour"), F.col("event_type").alias("prj"),
                     F.col("user_id").cast("string").alias("page"), F.get_json_object("props", "$.k").try_cast("bigint").alias("hits"))


@_memo
def tensor_long(spark: SparkSession, d: str, d_vois: int = 4) -> DataFrame:
    """Waves from ``embeddings``: 64 values = 4 VOIs × 16 points; outcome = label ≥ 5.

    Long form ``(case, outcome, voi, idx, value)``.
    """
    e = table(spark, d, "embeddings")
    n = F.size("embedding")
    # equal parts only: a remainder would leave points without a VOI
    per = F.when(n % d_vois == 0, (n / d_vois).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("tensor length not divisible: "), n.cast("string"))).cast("int"))
    return (e.select(F.col("vec_id").alias("case"), (F.col("label") >= 5).alias("outcome"),
                     F.posexplode("embedding").alias("pos", "v"), per.alias("per"))
            .select("case", "outcome", (F.col("pos") / F.col("per")).cast("int").alias("voi"),
                    F.pmod(F.col("pos"), F.col("per")).cast("int").alias("idx"),
                    F.col("v").cast("double").alias("value")))


@_memo
def scores(spark: SparkSession, d: str) -> DataFrame:
    """Scored cases: score = n_chars mod 100, y = quality, id = doc_id."""
    lab = table(spark, d, "labels")
    doc = table(spark, d, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id", "inner").select(
        "doc_id", F.pmod(F.col("n_chars"), F.lit(100)).cast("double").alias("score"),
        F.col("quality").cast("int").alias("y"))


# ---------------------------------------------------------------- DuckDB oracle CTEs

SQL: dict[str, str] = {
    "sensors": """SELECT user_id AS id_nda, event_type AS id_measure_type, ts AS dt_insert,
        value AS value_numeric,
        CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) < 5 THEN 'x' ELSE '' END AS dt_cancel
        FROM events""",
    "vdict": "SELECT * FROM (VALUES " + ", ".join(
        f"('{v}', '{c}')" for v, _l, cs in TEST_VOIS for c in cs) + ") AS t(voi, code)",
    "vlabels": "SELECT * FROM (VALUES " + ", ".join(
        f"('{v}', '{lab}')" for v, lab, _c in TEST_VOIS) + ") AS t(voi, label)",
    "moves": """SELECT m.user_id AS id_nda, m.user_id AS ids_pat, c.c_nationkey AS ids_ufr,
        m.dt_deb_mouv_ufr, m.dt_fin_mouv_ufr
        FROM (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS dt_deb_mouv_ufr,
                     max(ts) AS dt_fin_mouv_ufr FROM events GROUP BY user_id) m
        JOIN customer c ON m.user_id = c.c_custkey
        WHERE m.dt_deb_mouv_ufr IS NOT NULL""",
    "units": f"SELECT n_nationkey AS ids_ufr FROM nation WHERE n_regionkey < {ICU_MAX_REGION}",
    "stays": "SELECT user_id AS id_nda, min(ts) AS dt_deb_nda, max(ts) AS dt_fin_nda FROM events GROUP BY user_id",
    "patients": f"""SELECT c_custkey AS ids_pat,
        CAST({AGE_BASE} + (c_custkey * 7) % {AGE_MOD} AS DOUBLE) AS age,
        CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS cd_sex_tr,
        CASE WHEN c_acctbal < 0 THEN TIMESTAMP '{DEATH_BASE}' + to_days(CAST((c_custkey * 13) % 40 AS INTEGER)) END AS dt_deces,
        c_mktsegment AS dpt FROM customer""",
    "order_stays": """SELECT o.o_orderkey AS id_nda, o.o_orderdate AS dt_deb_nda, l.dt_fin_nda, l.dt_deces
        FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS dt_fin_nda,
                                   min(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS dt_deces
                            FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
    "case_table": """SELECT lpad(CAST(id_nda AS VARCHAR), 10, '0') AS id_nda, CAST(dt_deb_nda AS DATE) AS j1, dt_deces
        FROM order_stays""",
    "form_rows": """SELECT conv_id AS id_form, 'f' || CASE WHEN turn < 10 THEN '0' ELSE '' END || CAST(turn AS VARCHAR) AS champ_formulaire,
        CAST(length(text) % 100 AS VARCHAR) AS lwert, role FROM conversations""",
    "page_counts": """SELECT strftime(ts, '%m%d') AS month_day, CAST(hour(ts) AS INTEGER) AS hour, event_type AS prj,
        CAST(user_id AS VARCHAR) AS page, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS hits FROM events""",
    "dated_page_counts": f"""SELECT CAST(ts AS DATE) - {DATED_SHIFT} AS day, CAST(hour(ts) AS INTEGER) AS hour, event_type AS prj,
        CAST(user_id AS VARCHAR) AS page, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS hits FROM events""",
    "tensor_long": """SELECT vec_id AS "case", label >= 5 AS outcome,
        CAST((i - 1) // (len(embedding) // 4) AS INTEGER) AS voi,
        CAST((i - 1) % (len(embedding) // 4) AS INTEGER) AS idx,
        CAST(embedding[i] AS DOUBLE) AS value
        FROM embeddings, range(1, len(embedding) + 1) AS r(i)""",
    "scores": """SELECT l.doc_id, CAST(d.n_chars % 100 AS DOUBLE) AS score, CAST(l.quality AS INTEGER) AS y
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}

# Order in which CTEs may reference each other.
_DEPS = {"case_table": ["order_stays"]}


def with_ctes(body: str, *names: str) -> str:
    """Prefix ``body`` with the named CTEs (and their dependencies) in order."""
    seen: list[str] = []

    def add(n):
        for dep in _DEPS.get(n, []):
            add(dep)
        if n not in seen:
            seen.append(n)
    for n in names:
        add(n)
    if not seen:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in seen)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return head + ",\n" + stripped[5:]
    return head + "\n" + body
