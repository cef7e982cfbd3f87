"""The catalogue of scalar functions, used through formula text (FL, FS, FM, FD, FT)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import expression
from .base import query, rounded, table


def computed(df: DataFrame, keys: list[str], formulas: dict[str, str]) -> DataFrame:
    return df.select(*keys, *[expression(df, text).alias(name) for name, text in formulas.items()])


def _batch(name: str, source: str, keys: list[str], pairs: dict[str, tuple[str, str]], prepare=None, sql_source=None):
    """One query computing several formulas; each name maps to (formula, SQL)."""
    sql = ", ".join([*keys, *[f"{q} AS {n}" for n, (_, q) in pairs.items()]])

    @query(name, f"SELECT {sql} FROM {sql_source or source}")
    def run(spark, d):
        df = table(spark, d, source)
        df = prepare(df) if prepare else df
        return rounded(computed(df, keys, {n: f for n, (f, _) in pairs.items()}), 6)

    return run


_batch(
    "fl_logic",
    "events",
    ["event_id"],
    {
        "fl1": ('if [value] > 50 then "high" elseif [value] > 10 then "mid" else "low" endif',
                "CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'mid' ELSE 'low' END"),
        "fl2": ("[value] > 5 and [k] = 'click'", "value > 5 AND k = 'click'"),
        "fl3": ("[value] > 5 or [k] = 'click'", "value > 5 OR k = 'click'"),
        "fl4": ("not [value] > 5", "NOT value > 5"),
        "fl5": ("equals([k], 'view')", "k = 'view'"),
        "fl6": ("does_not_equal([k], 'view')", "k <> 'view'"),
        "fl7": ("between([value], 3, 8)", "value BETWEEN 3 AND 8"),
        "fl8": ("contains([k], 'ic')", "contains(k, 'ic')"),
        "fl9": ("is_empty([k])", "k IS NULL"),
        "fl10": ("is_not_empty([k])", "k IS NOT NULL"),
        "fl11": ("is_string([k]) and not is_string([value])", "TRUE"),
    },
    lambda df: df.withColumn("k", F.nullif("event_type", F.lit("error"))),
    "(SELECT *, nullif(event_type, 'error') AS k FROM events)",
)
_batch(
    "fl_nulls",
    "events",
    ["event_id"],
    {
        "fl12": ("coalesce([k], [event_type])", "coalesce(k, event_type)"),
        "fl13": ("ifnull([k], 'none')", "coalesce(k, 'none')"),
        "fl14": ("NVL([n], -1)", "coalesce(n, -1)"),
        "fl15": ("nullif([event_type], 'click')", "nullif(event_type, 'click')"),
        "fl16": ("greatest([n], [user_id])", "greatest(n, user_id)"),
        "fl17": ("least([n], [user_id])", "least(n, user_id)"),
    },
    lambda df: df.withColumns(
        {
            "k": F.nullif("event_type", F.lit("error")),
            "n": F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100),
        }
    ),
    "(SELECT *, nullif(event_type, 'error') AS k, CASE WHEN event_id % 4 <> 0 THEN event_id % 100 END AS n FROM events)",
)
_batch(
    "fs_string_1",
    "part",
    ["p_partkey"],
    {
        "fs1": ("concat([p_name], '-', [p_size], nullif([p_type], 'SMALL'))",
                "concat(p_name, '-', p_size, nullif(p_type, 'SMALL'))"),
        "fs2": ("substring([p_name], 3, 4)", "substring(p_name, 3, 4)"),
        "fs3": ("mid([p_name], 2, 5)", "substring(p_name, 2, 5)"),
        "fs4": ("lowercase([p_brand])", "lower(p_brand)"),
        "fs5": ("uppercase([p_name])", "upper(p_name)"),
        "fs6": ("titlecase([p_name])",
                "array_to_string(list_transform(string_split(p_name, ' '), "
                "lambda x: upper(substring(x, 1, 1)) || lower(substring(x, 2))), ' ')"),
        "fs7": ("trim(concat('  ', [p_name], ' '))", "p_name"),
        "fs8": ("left_trim(concat('  ', [p_name], ' '))", "p_name || ' '"),
        "fs9": ("right_trim(concat('  ', [p_name], ' '))", "'  ' || p_name"),
        "fs10": ("left([p_name], 3)", "left(p_name, 3)"),
        "fs11": ("right([p_name], 3)", "right(p_name, 3)"),
        "fs12": ("length([p_name])", "CAST(length(p_name) AS INTEGER)"),
    },
)
_batch(
    "fs_string_2",
    "part",
    ["p_partkey"],
    {
        "fs13": ("replace([p_brand], '#', '.')", "replace(p_brand, '#', '.')"),
        "fs14": ("find_position([p_name], ' ')", "CAST(strpos(p_name, ' ') AS INTEGER)"),
        "fs15": ("pad_left([p_type], 6, '*')",
                 "CASE WHEN length(p_type) < 6 THEN lpad(p_type, 6, '*') ELSE p_type END"),
        "fs16": ("pad_right([p_type], 6, '*')",
                 "CASE WHEN length(p_type) < 6 THEN rpad(p_type, 6, '*') ELSE p_type END"),
        "fs17": ("repeat([p_type], 2)", "repeat(p_type, 2)"),
        "fs18": ("reverse([p_name])", "reverse(p_name)"),
        "fs19": ("array_join(split(replace([p_brand], '#', '.'), '.'), '|')", "replace(p_brand, '#', '|')"),
        "fs20": ("starts_with([p_name], 'red')", "starts_with(p_name, 'red')"),
        "fs21": ("ends_with([p_name], 'bolt')", "ends_with(p_name, 'bolt')"),
        "fs22": ("count_match([p_name], '[aeiou]')",
                 "CAST(length(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER)"),
    },
)


def _sim(function):
    return f"1 - {function}(p_name, lower(p_brand)) / CAST(greatest(length(p_name), length(p_brand)) AS DOUBLE)"


_batch(
    "fs23_string_similarity",
    "part",
    ["p_partkey"],
    {
        "levenshtein": ("string_similarity([p_name], lowercase([p_brand]), levenshtein)",
                        f"round({_sim('levenshtein')}, 6)"),
        "damerau": ("string_similarity([p_name], lowercase([p_brand]), 'damerau_levenshtein')",
                    f"round({_sim('damerau_levenshtein')}, 6)"),
        "jaro": ("string_similarity([p_name], lowercase([p_brand]), jaro)",
                 "round(jaro_similarity(p_name, lower(p_brand)), 6)"),
        "jaro_winkler": ("string_similarity([p_name], lowercase([p_brand]), jaro_winkler)",
                         "round(jaro_winkler_similarity(p_name, lower(p_brand)), 6)"),
        "hamming": ("string_similarity([p_name], lowercase([p_brand]), hamming)",
                    "CASE WHEN length(p_name) <> length(p_brand) THEN 0.0 ELSE round(1 - hamming(p_name, "
                    "lower(p_brand)) / CAST(length(p_name) AS DOUBLE), 6) END"),
    },
)
_batch(
    "fm_math_1",
    "customer",
    ["c_custkey"],
    {
        "fm1": ("abs([c_acctbal])", "abs(c_acctbal)"),
        "fm2": ("round([c_acctbal] / 7, 2)", "round(c_acctbal / 7, 2)"),
        "fm3": ("ceil([c_acctbal])", "CAST(ceil(c_acctbal) AS BIGINT)"),
        "fm4": ("floor([c_acctbal])", "CAST(floor(c_acctbal) AS BIGINT)"),
        "fm5": ("sqrt(abs([c_acctbal]))", "round(sqrt(abs(c_acctbal)), 6)"),
        "fm6": ("power([c_nationkey], 3)", "power(CAST(c_nationkey AS DOUBLE), 3)"),
        "fm7": ("mod([c_nationkey] - 12, 7)",
                "CAST(((c_nationkey - 12) % 7 + 7) % 7 AS INTEGER)"),
        "fm7_negative": ("mod([c_nationkey] - 12, -7)",
                         "CAST(((c_nationkey - 12) % 7 - 7) % 7 AS INTEGER)"),
        "fm8": ("sign([c_acctbal])", "CAST(sign(c_acctbal) AS DOUBLE)"),
        "fm9": ("negation([c_acctbal])", "-c_acctbal"),
        "fm10": ("exp([c_acctbal] / 5000)", "round(exp(c_acctbal / 5000), 6)"),
    },
)
_batch(
    "fm_math_2",
    "customer",
    ["c_custkey"],
    {
        "fm11": ("log([c_custkey] + 1)", "round(ln(c_custkey + 1), 6)"),
        "fm12": ("log10([c_custkey] + 1)", "round(log10(c_custkey + 1), 6)"),
        "fm13": ("log2([c_custkey] + 1)", "round(log2(c_custkey + 1), 6)"),
        "fm14": ("sin([c_nationkey])", "round(sin(c_nationkey), 6)"),
        "fm15": ("cos([c_nationkey])", "round(cos(c_nationkey), 6)"),
        "fm16": ("tan([c_nationkey])", "round(tan(c_nationkey), 6)"),
        "fm17": ("asin([c_nationkey] / 25)", "round(asin(c_nationkey / 25.0), 6)"),
        "fm18": ("acos([c_nationkey] / 25)", "round(acos(c_nationkey / 25.0), 6)"),
        "fm19": ("atan([c_acctbal])", "round(atan(c_acctbal), 6)"),
        "fm20": ("tanh([c_nationkey] / 10)", "round(tanh(c_nationkey / 10.0), 6)"),
        "fm21": ("between(random_int(5, 9), 5, 9)", "TRUE"),
    },
)
_batch(
    "fd_date_parts",
    "events",
    ["event_id"],
    {
        "fd1": ("year([ts])", "CAST(year(ts) AS INTEGER)"),
        "fd2": ("month([ts])", "CAST(month(ts) AS INTEGER)"),
        "fd3": ("day([ts])", "CAST(day(ts) AS INTEGER)"),
        "fd4": ("hour([ts])", "CAST(hour(ts) AS INTEGER)"),
        "fd5": ("minute([ts])", "CAST(minute(ts) AS INTEGER)"),
        "fd6": ("second([ts])", "CAST(second(ts) AS INTEGER)"),
        "fd7": ("quarter([ts])", "CAST(quarter(ts) AS INTEGER)"),
        "fd8": ("week([ts])", "CAST(week(ts) AS INTEGER)"),
        "fd9": ("weekday([ts])", "CAST(isodow(ts) AS INTEGER)"),
        "fd10": ("dayofweek([ts])", "CAST(dayofweek(ts) + 1 AS INTEGER)"),
        "fd11": ("dayofyear([ts])", "CAST(dayofyear(ts) AS INTEGER)"),
        "fd12": ("date_diff_days(today(), today())", "0"),
        "fd13": ("year(now()) >= 2024", "TRUE"),
    },
)
_batch(
    "fd_date_shifts",
    "orders",
    ["o_orderkey"],
    {
        "fd14": ("start_of_month([o_orderdate])", "CAST(date_trunc('month', o_orderdate) AS DATE)"),
        "fd15": ("end_of_month([o_orderdate])", "last_day(o_orderdate)"),
        "fd16": ("to_string(add_days([o_orderdate], 10))", "CAST(o_orderdate + INTERVAL 10 DAY AS VARCHAR)"),
        "fd17": ("to_string(add_weeks([o_orderdate], -2))", "CAST(o_orderdate - INTERVAL 14 DAY AS VARCHAR)"),
        "fd18": ("to_string(add_months([o_orderdate], 1))", "CAST(o_orderdate + INTERVAL 1 MONTH AS VARCHAR)"),
        "fd19": ("to_string(add_years([o_orderdate], 1))", "CAST(o_orderdate + INTERVAL 1 YEAR AS VARCHAR)"),
        "fd20": ("to_string(add_hours([o_orderdate], 5))", "CAST(o_orderdate + INTERVAL 5 HOUR AS VARCHAR)"),
        "fd21": ("to_string(add_minutes([o_orderdate], 90))", "CAST(o_orderdate + INTERVAL 90 MINUTE AS VARCHAR)"),
        "fd22": ("to_string(add_seconds([o_orderdate], -1))", "CAST(o_orderdate - INTERVAL 1 SECOND AS VARCHAR)"),
        "fd23": ("date_diff_days([o_orderdate], to_date('1995-01-01'))",
                 "CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INTEGER)"),
    },
)


_batch(
    "fd24_date_truncate",
    "events",
    ["event_id"],
    {
        "y": ("to_string(date_truncate([ts], 1y))", "CAST(CAST(date_trunc('year', ts) AS TIMESTAMP) AS VARCHAR)"),
        "q": ("to_string(date_truncate([ts], 1q))", "CAST(CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS VARCHAR)"),
        "mo": ("to_string(date_truncate([ts], 1mo))", "CAST(CAST(date_trunc('month', ts) AS TIMESTAMP) AS VARCHAR)"),
        "w": ("to_string(date_truncate([ts], 1w))", "CAST(CAST(date_trunc('week', ts) AS TIMESTAMP) AS VARCHAR)"),
        "d": ("to_string(date_truncate([ts], '1d'))", "CAST(CAST(date_trunc('day', ts) AS TIMESTAMP) AS VARCHAR)"),
        "h": ("to_string(date_truncate([ts], h))", "CAST(CAST(date_trunc('hour', ts) AS TIMESTAMP) AS VARCHAR)"),
        "m": ("to_string(date_truncate([ts], 1m))", "CAST(CAST(date_trunc('minute', ts) AS TIMESTAMP) AS VARCHAR)"),
        "s": ("to_string(date_truncate([ts], 1s))", "CAST(CAST(date_trunc('second', ts) AS TIMESTAMP) AS VARCHAR)"),
        "mo2": ("to_string(date_truncate([ts], 2mo))",
                "CAST(CAST(time_bucket(INTERVAL 2 MONTH, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS VARCHAR)"),
        "w2": ("to_string(date_truncate([ts], 2w))",
               "CAST(CAST(time_bucket(INTERVAL 14 DAY, ts, TIMESTAMP '1969-12-29') AS TIMESTAMP) AS VARCHAR)"),
        "h6": ("to_string(date_truncate([ts], 6h))",
               "CAST(CAST(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS VARCHAR)"),
        "m15": ("to_string(date_truncate([ts], 15m))",
                "CAST(CAST(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS VARCHAR)"),
    },
)
_batch(
    "fd25_format_date",
    "events",
    ["event_id"],
    {
        "iso": ("format_date([ts], %Y-%m-%d)", "strftime(ts, '%Y-%m-%d')"),
        "full": ("format_date([ts], '%d %B %y at %H:%M:%S')", "strftime(ts, '%d %B %y at %H:%M:%S')"),
        "short": ("format_date([ts], '%a %b %j')", "strftime(ts, '%a %b %j')"),
        "day_name": ("format_date([ts], '%A')", "strftime(ts, '%A')"),
    },
)
_batch(
    "ft_type_conversion",
    "documents",
    ["doc_id"],
    {
        "ft1": ("to_string([n_chars])", "CAST(n_chars AS VARCHAR)"),
        "ft2": ("to_date([t])", "try_cast(t AS DATE)"),
        "ft3": ("to_string(to_datetime([t]))", "CAST(try_cast(t AS TIMESTAMP) AS VARCHAR)"),
        "ft4": ("to_integer([u])", "try_cast(u AS BIGINT)"),
        "ft5": ("to_float([u])", "try_cast(u AS DOUBLE)"),
        "ft6": ("to_number([lang])", "try_cast(lang AS DOUBLE)"),
        "ft7": ("to_boolean([b])", "try_cast(b AS BOOLEAN)"),
        "ft8": ("to_float(to_decimal([n_chars] / 7, 2))", "round(n_chars / 7.0, 2)"),
    },
    lambda df: df.withColumns(
        {
            "t": F.when(F.col("doc_id") % 3 == 0, "2024-02-29").when(F.col("doc_id") % 3 == 1, "2023-02-29"),
            "u": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("x1"),
            "b": F.element_at(F.array(F.lit("true"), F.lit("false"), F.lit("maybe")), (F.col("doc_id") % 3 + 1).cast("int")),
        }
    ),
    "(SELECT *, CASE doc_id % 3 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2023-02-29' END AS t, "
    "CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'x1' END AS u, "
    "CASE doc_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'maybe' END AS b FROM documents)",
)


@query(
    "fs_text_of_documents",
    "SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars, "
    "CAST(sum(length(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) AS numbers, "
    "CAST(sum(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) AS BIGINT) AS with_the, "
    "CAST(max(length(replace(text, ' ', ''))) AS BIGINT) AS longest FROM documents GROUP BY lang",
)
def fs_documents(spark, d):
    df = table(spark, d, "documents")
    made = computed(
        df,
        ["lang"],
        {
            "c": "length([text])",
            "n": "count_match([text], '[0-9]+')",
            "t": "if contains(lowercase([text]), 'the') then 1 else 0 endif",
            "l": "length(replace([text], ' ', ''))",
        },
    )
    sums = [F.sum("c").alias("chars"), F.sum("n").alias("numbers"), F.sum("t").alias("with_the")]
    return made.groupBy("lang").agg(*sums, F.max("l").cast("long").alias("longest"))
