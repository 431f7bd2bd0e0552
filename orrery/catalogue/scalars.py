"""Scalar functions: one query per function, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, functions as F

from orrery.catalogue.registry import query
from orrery.functions import dates as D, numbers as N, passthrough as P, text as X

c = F.col  # columns need a running session, so module-level ones are functions


def scalar(name: str, table: str, keys: str, **cols: tuple[Callable[[], Column] | Column, str]) -> None:
    """Record a query that adds computed columns to the keys of a table."""
    ids = keys.split()
    sql = f"SELECT {', '.join(ids)}, {', '.join(f'{s} AS {n}' for n, (_, s) in cols.items())} FROM {table}"
    query(name, sql)(lambda t: getattr(t, table).select(*ids, *[f().alias(n) for n, (f, _) in cols.items()]))


PART, ORDER, CUST, PAGE, EVENT, DOC = (
    ("part", "p_partkey"), ("orders", "o_orderkey"), ("customer", "c_custkey"),
    ("pages", "page_id"), ("events", "event_id"), ("documents", "doc_id"),
)

# --- text ------------------------------------------------------------------------------------
scalar("concat", *PART, v=(lambda: X.concat(c("p_brand"), F.lit("-"), c("p_type")), "p_brand || '-' || p_type"))
scalar("concat_ws", *PART, v=(lambda: X.concat_ws(" / ", c("p_brand"), c("p_type"), c("p_name")), "concat_ws(' / ', p_brand, p_type, p_name)"))
scalar("substr", *CUST, v=(lambda: X.substr(c("c_name"), 9, 4), "substr(c_name, 10, 4)"))
scalar("left", *CUST, v=(lambda: X.left(c("c_name"), 4), 'c_name[1:4]'))
scalar("right", *CUST, v=(lambda: X.right(c("c_name"), 5), "right(c_name, 5)"))
scalar("strlen", *DOC, v=(lambda: X.strlen(c("text")), "length(text)"))
scalar("strpos", *PART, v=(lambda: X.strpos(c("p_name"), "ri"), "strpos(p_name, 'ri')"))
scalar(
    "find_nth", *PAGE,
    v=(lambda: X.find_nth(c("url"), "/", 3),
       "CASE WHEN len(string_split(url, '/')) > 3 THEN length(array_to_string(string_split(url, '/')[1:3], '/')) + 1 ELSE 0 END"),
)
scalar("contains", *PART, v=(lambda: X.contains(c("p_name"), F.lit("ring")), "contains(p_name, 'ring')"))
scalar("starts_with", *PART, v=(lambda: X.starts_with(c("p_name"), F.lit("red")), "starts_with(p_name, 'red')"))
scalar("ends_with", *PART, v=(lambda: X.ends_with(c("p_name"), F.lit("ring")), "ends_with(p_name, 'ring')"))
scalar("upper", *PART, v=(lambda: X.upper(c("p_name")), "upper(p_name)"))
scalar("lower", *PART, v=(lambda: X.lower(c("p_type")), "lower(p_type)"))
scalar("initcap", *CUST, v=(lambda: X.initcap(c("c_mktsegment")), "upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:])"))
scalar("trim", *PART, v=(lambda: X.trim(X.concat(F.lit("  "), c("p_name"), F.lit(" "))), "trim('  ' || p_name || ' ')"))
scalar("ltrim", *PART, v=(lambda: X.ltrim(X.concat(F.lit("  "), c("p_name"), F.lit(" "))), "ltrim('  ' || p_name || ' ')"))
scalar("rtrim", *PART, v=(lambda: X.rtrim(X.concat(F.lit("  "), c("p_name"), F.lit(" "))), "rtrim('  ' || p_name || ' ')"))
scalar("replace", *PART, v=(lambda: X.replace(c("p_name"), "ring", "coil"), "replace(p_name, 'ring', 'coil')"))
scalar("split_part", *ORDER, v=(lambda: X.split_part(c("o_orderpriority"), "-", 2), "split_part(o_orderpriority, '-', 2)"))
scalar("subfield", *PAGE, v=(lambda: X.subfield(c("url"), "/", 3), "split_part(url, '/', 3)"))
scalar("text_between", *PAGE, v=(lambda: X.text_between(c("url"), "//", "/"), "CASE WHEN regexp_matches(url, '//[^/]*/') THEN regexp_extract(url, '//([^/]*)/', 1) END"))
scalar("regexp_like", *PAGE, v=(lambda: X.regexp_like(c("url"), "[?]page="), "regexp_matches(url, '[?]page=')"))
scalar("regexp_extract", *PAGE, v=(lambda: X.regexp_extract(c("url"), "page=([0-9]+)", 1), "regexp_extract(url, 'page=([0-9]+)', 1)"))
scalar("regexp_replace", *PAGE, v=(lambda: X.regexp_replace(c("url"), "[0-9]+", "#"), "regexp_replace(url, '[0-9]+', '#', 'g')"))
scalar("regexp_count", *DOC, v=(lambda: X.regexp_count(c("text"), F.lit("[0-9]+")), "len(regexp_extract_all(text, '[0-9]+'))"))
scalar("regexp_extract_nth", *PAGE, v=(lambda: X.regexp_extract_nth(c("url"), "[0-9]+", 2), "regexp_extract_all(url, '[0-9]+')[2]"))
scalar("lpad", *PART, v=(lambda: X.lpad(c("p_size").cast("string"), 4, "0"), "lpad(p_size::VARCHAR, 4, '0')"))
scalar("rpad", *PART, v=(lambda: X.rpad(c("p_type"), 10, "."), "rpad(p_type, 10, '.')"))
scalar("reverse", *PART, v=(lambda: X.reverse(c("p_name")), "reverse(p_name)"))
scalar("repeat", *PART, v=(lambda: X.repeat(c("p_type"), 2), "repeat(p_type, 2)"))
scalar("ascii", *PART, v=(lambda: X.ascii(c("p_name")), "ascii(p_name)::BIGINT"))
scalar("chr", *PART, v=(lambda: X.chr(F.lit(65) + c("p_size") % 26), "chr(65 + p_size % 26)"))
scalar("purge_chars", *ORDER, v=(lambda: X.purge_chars(c("o_orderpriority"), "-E "), "replace(replace(replace(o_orderpriority, '-', ''), 'E', ''), ' ', '')"))
scalar("keep_chars", *CUST, v=(lambda: X.keep_chars(c("c_name"), "0123456789"), "regexp_replace(c_name, '[^0-9]', '', 'g')"))
scalar("map_substring", *PART, v=(lambda: X.map_substring(c("p_name"), {"red": "crimson", "ring": "loop"}), "replace(replace(p_name, 'red', 'crimson'), 'ring', 'loop')"))
scalar("hash128", *DOC, v=(lambda: X.hash128(c("text")), "md5(text)"))
scalar("hash256", *DOC, v=(lambda: X.hash256(c("text")), "sha256(text)"))
scalar("json_path", *EVENT, v=(lambda: X.json_path(c("props"), "$.k"), "json_extract_string(props, '$.k')"))
scalar("format_number_text", *ORDER, v=(lambda: X.format_number_text(c("o_totalprice"), 2), "format('{:,.2f}', o_totalprice)"))

# --- dates -----------------------------------------------------------------------------------
od = lambda: c("o_orderdate")
REF = lambda: F.lit("2000-06-15").cast("date")
REF_SQL = "DATE '2000-06-15'"
MONDAY = "(date_trunc('week', o_orderdate))::DATE"

scalar("today", *ORDER, v=(lambda: od() < D.today(), "o_orderdate < current_date"))
scalar("now", *ORDER, v=(lambda: od().cast("timestamp") < D.now(), "o_orderdate < now()::TIMESTAMP"))
scalar("date", *EVENT, v=(lambda: D.date(c("ts")), "ts::DATE"))
scalar("time", *EVENT, v=(lambda: D.time(c("ts")), "strftime(ts, '%H:%M:%S')"))
scalar("year", *ORDER, v=(lambda: D.year(od()), "year(o_orderdate)"), fiscal=(lambda: D.year(od(), 4), "year(date_trunc('month', o_orderdate) + INTERVAL 9 MONTH)"))
scalar("year_name", *ORDER, v=(lambda: D.year_name(od()), "year(o_orderdate)::VARCHAR"), fiscal=(lambda: D.year_name(od(), 10), "'FY_' || year(date_trunc('month', o_orderdate) + INTERVAL 3 MONTH)"))
scalar("quarter_number", *ORDER, v=(lambda: D.quarter_number(od()), "quarter(o_orderdate)"), fiscal=(lambda: D.quarter_number(od(), 2), "quarter(date_trunc('month', o_orderdate) + INTERVAL 11 MONTH)"))
scalar("month_number", *ORDER, v=(lambda: D.month_number(od()), "month(o_orderdate)"), fiscal=(lambda: D.month_number(od(), 4), "(month(o_orderdate) + 8) % 12 + 1"))
scalar("day", *ORDER, v=(lambda: D.day(od()), "day(o_orderdate)"))
scalar("month", *ORDER, v=(lambda: D.month(od()), "monthname(o_orderdate)"))
scalar("day_of_week", *ORDER, v=(lambda: D.day_of_week(od()), "dayname(o_orderdate)"))
scalar("month_number_of_quarter", *ORDER, v=(lambda: D.month_number_of_quarter(od()), "(month(o_orderdate) - 1) % 3 + 1"))
scalar("day_number_of_week", *ORDER, v=(lambda: D.day_number_of_week(od()), "isodow(o_orderdate)"))
scalar("day_number_of_quarter", *ORDER, v=(lambda: D.day_number_of_quarter(od()), "date_diff('day', date_trunc('quarter', o_orderdate)::DATE, o_orderdate::DATE) + 1"))
scalar("day_number_of_year", *ORDER, v=(lambda: D.day_number_of_year(od()), "dayofyear(o_orderdate)"))
scalar("hour_of_day", *EVENT, v=(lambda: D.hour_of_day(c("ts")), "hour(ts)"))
scalar("minute", *EVENT, v=(lambda: D.minute(c("ts")), "minute(ts)"))
scalar("second", *EVENT, v=(lambda: D.second(c("ts")), "second(ts)"))
scalar("week_number_of_year", *ORDER, v=(lambda: D.week_number_of_year(od()), "week(o_orderdate)"))
scalar("week_number_of_quarter", *ORDER, v=(lambda: D.week_number_of_quarter(od()), f"date_diff('day', date_trunc('week', date_trunc('quarter', o_orderdate))::DATE, {MONDAY}) // 7 + 1"))
scalar("week_number_of_month", *ORDER, v=(lambda: D.week_number_of_month(od()), f"date_diff('day', date_trunc('week', date_trunc('month', o_orderdate))::DATE, {MONDAY}) // 7 + 1"))
scalar("week_year", *ORDER, v=(lambda: D.week_year(od()), "isoyear(o_orderdate)"))
scalar("is_weekend", *ORDER, v=(lambda: D.is_weekend(od()), "isodow(o_orderdate) >= 6"))
scalar("start_of_year", *ORDER, v=(lambda: D.start_of_year(od()), "date_trunc('year', o_orderdate)::DATE"),
       fiscal=(lambda: D.start_of_year(od(), 4), "(date_trunc('year', date_trunc('month', o_orderdate) + INTERVAL 9 MONTH) - INTERVAL 9 MONTH)::DATE"))
scalar("start_of_quarter", *ORDER, v=(lambda: D.start_of_quarter(od()), "date_trunc('quarter', o_orderdate)::DATE"))
scalar("start_of_month", *ORDER, v=(lambda: D.start_of_month(od()), "date_trunc('month', o_orderdate)::DATE"))
scalar("start_of_week", *ORDER, v=(lambda: D.start_of_week(od()), MONDAY))
scalar("start_of_hour", *EVENT, v=(lambda: D.start_of_hour(c("ts")), "date_trunc('hour', ts)"))
scalar("start_of_min", *EVENT, v=(lambda: D.start_of_min(c("ts")), "date_trunc('minute', ts)"))
scalar("start_of_current", *ORDER, y=(lambda: od() >= D.start_of("year", REF()), f"o_orderdate >= date_trunc('year', {REF_SQL})"),
       q=(lambda: od() >= D.start_of("quarter", REF()), f"o_orderdate >= date_trunc('quarter', {REF_SQL})"),
       w=(lambda: od() >= D.start_of("week", REF()), f"o_orderdate >= date_trunc('week', {REF_SQL})"))
scalar("start_of_last", *ORDER, y=(lambda: D.start_of("year", od(), -1), "(date_trunc('year', o_orderdate) - INTERVAL 1 YEAR)::DATE"),
       m=(lambda: D.start_of("month", od(), -1), "(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH)::DATE"),
       w=(lambda: D.start_of("week", od(), -1), f"({MONDAY} - INTERVAL 7 DAY)::DATE"))
scalar("end_of", *ORDER, y=(lambda: D.end_of("year", od(), -1), "(date_trunc('year', o_orderdate) - INTERVAL 1 DAY)::DATE"),
       q=(lambda: D.end_of("quarter", od()), "(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE"))
scalar("month_end", *ORDER, v=(lambda: D.month_end(od()), "last_day(o_orderdate)"))
scalar("quarter_end", *ORDER, v=(lambda: D.quarter_end(od()), "(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE"))
scalar("year_end", *ORDER, v=(lambda: D.year_end(od()), "make_date(year(o_orderdate), 12, 31)"))
scalar("week_end", *ORDER, v=(lambda: D.week_end(od()), f"({MONDAY} + INTERVAL 6 DAY)::DATE"))
for _unit in ("day", "week", "month", "quarter", "year"):
    scalar(f"diff_{_unit}s", *ORDER, v=(lambda u=_unit: D.diff(u, REF(), od()),
           f"date_diff('day', {MONDAY}, date_trunc('week', {REF_SQL})::DATE) // 7" if _unit == "week" else f"date_diff('{_unit}', o_orderdate::DATE, {REF_SQL})"))
TS = "TIMESTAMP '2024-01-15 00:00:00'"
AT = lambda: F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
scalar("diff_time", *EVENT, v=(lambda: D.diff_time(AT(), c("ts")), f"date_diff('second', ts, {TS})"))
scalar("diff_hours", *EVENT, v=(lambda: D.diff_hours(AT(), c("ts")), f"date_diff('hour', ts, {TS})"))
scalar("diff_minutes", *EVENT, v=(lambda: D.diff_minutes(AT(), c("ts")), f"date_diff('minute', ts, {TS})"))
for _name, _fn, _n, _iv in (
    ("days", D.add_days, 45, "45 DAY"), ("weeks", D.add_weeks, -3, "-21 DAY"), ("months", D.add_months, 1, "1 MONTH"),
    ("quarters", D.add_quarters, 2, "6 MONTH"), ("years", D.add_years, -1, "-12 MONTH"),
):
    scalar(f"add_{_name}", *ORDER, v=(lambda f=_fn, n=_n: f(od(), n), f"(o_orderdate + INTERVAL ({_iv.split()[0]}) {_iv.split()[1]})::DATE"))
for _name, _fn in (("hours", D.add_hours), ("minutes", D.add_minutes), ("seconds", D.add_seconds)):
    scalar(f"add_{_name}", *EVENT, v=(lambda f=_fn: f(c("ts"), 90), f"ts + INTERVAL 90 {_name.upper()}"))
scalar("to_date", *ORDER, v=(lambda: D.to_date(D.to_char_date(od(), "dd/MM/yyyy"), "dd/MM/yyyy"), "o_orderdate::DATE"),
       bad=(lambda: D.to_date(c("o_orderpriority"), "dd/MM/yyyy"), "NULL::DATE"))
scalar("to_timestamp", *EVENT, v=(lambda: D.to_timestamp(D.to_char_date(c("ts"), "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss"), "date_trunc('second', ts)"))
scalar("to_char_date", *ORDER, v=(lambda: D.to_char_date(od(), "yyyy/MM"), "strftime(o_orderdate, '%Y/%m')"))
scalar("is_date", *PAGE, v=(lambda: D.is_date(X.split_part(c("url"), "/", 5), "yyyy"), "regexp_matches(split_part(url, '/', 5), '^[0-9]{4}$')"))
scalar("make_date", *ORDER, v=(lambda: D.make_date(F.year(od()), F.month(od()), F.lit(1)), "make_date(year(o_orderdate), month(o_orderdate), 1)"))
scalar("make_time", *EVENT, v=(lambda: D.make_time(F.hour("ts"), F.minute("ts"), F.second("ts")), "strftime(ts, '%H:%M:%S')"))
scalar("make_datetime", *EVENT, v=(lambda: D.make_datetime(D.date(c("ts")), D.time(c("ts"))), "date_trunc('second', ts)"))
scalar("age_years", *ORDER, v=(lambda: D.age_years(od(), REF()), f"(year({REF_SQL}) - year(o_orderdate) - CASE WHEN month({REF_SQL}) * 100 + day({REF_SQL}) >= month(o_orderdate) * 100 + day(o_orderdate) THEN 0 ELSE 1 END)"))
scalar("parse_fiscal_label", *ORDER,
       fy=(lambda: D.parse_fiscal_label(F.concat(F.lit("FY"), F.year(od()))), "make_date(year(o_orderdate), 1, 1)"),
       span=(lambda: D.parse_fiscal_label(F.concat(F.lit("_"), F.year(od()), F.lit("_17"))), "make_date(year(o_orderdate), 1, 1)"),
       ym=(lambda: D.parse_fiscal_label(D.to_char_date(od(), "yyyy-MM")), "date_trunc('month', o_orderdate)::DATE"),
       bad=(lambda: D.parse_fiscal_label(c("o_orderpriority")), "NULL::DATE"))
scalar("convert_user_timezone", *EVENT, v=(lambda: D.convert_user_timezone(c("ts"), "Asia/Tokyo"), "ts + INTERVAL 9 HOUR"))

_A = "(CASE WHEN isodow({d}) >= 6 THEN ({d}::DATE + (8 - isodow({d}))::INTEGER)::TIMESTAMP ELSE {d} END)".format(d="ts")
_E = "(ts + INTERVAL (event_id % 20) DAY)"
_BD = f"(CASE WHEN isodow({_E}) >= 6 THEN ({_E}::DATE - (isodow({_E}) - 5)::INTEGER)::TIMESTAMP ELSE {_E} END)"
_BM = f"(CASE WHEN isodow({_E}) >= 6 THEN ({_E}::DATE - (isodow({_E}) - 5)::INTEGER)::TIMESTAMP + INTERVAL '23:59:59' ELSE {_E} END)"
_WEEKS = "(date_diff('day', date_trunc('week', {a})::DATE, date_trunc('week', {b})::DATE) // 7)"
_MIN = f"(date_diff('minute', {_A}, {_BM}) - {_WEEKS.format(a=_A, b=_BM)} * 2880)"
_end = lambda: c("ts") + F.make_interval(days=(c("event_id") % 20).cast("int"))
scalar("business_minutes", *EVENT, v=(lambda: D.business_minutes(c("ts"), _end()), _MIN))
scalar("business_days", *EVENT,
       v=(lambda: D.business_days(c("ts"), _end()), f"date_diff('day', {_A}::DATE, {_BD}::DATE) - {_WEEKS.format(a=_A, b=_BD)} * 2"),
       incl=(lambda: D.business_days(c("ts"), _end(), True), f"date_diff('day', {_A}::DATE, {_BD}::DATE) + 1 - {_WEEKS.format(a=_A, b=_BD)} * 2"))
scalar("business_duration_str", *EVENT, v=(lambda: D.business_duration_str(c("ts"), _end()),
       f"(CASE WHEN {_MIN} >= 0 THEN {_MIN} // 60 ELSE -((59 - {_MIN}) // 60) END)::VARCHAR || ':' || lpad(({_MIN} % 60)::VARCHAR, 2, '0')"))

_PRICE = lambda: c("o_totalprice").cast("bigint")
_SEC = "trunc(o_totalprice)::BIGINT"
_TWO = "CASE WHEN {x} < 100 THEN lpad(({x})::VARCHAR, 2, '0') ELSE ({x})::VARCHAR END"
_p = lambda x: _TWO.format(x=x)
scalar("seconds_to_hms", *ORDER, v=(lambda: D.seconds_to_hms(_PRICE()), f"concat_ws(':', {_p(f'{_SEC} // 3600')}, {_p(f'{_SEC} % 3600 // 60')}, {_p(f'{_SEC} % 60')})"))
scalar("seconds_to_dhms", *ORDER, v=(lambda: D.seconds_to_dhms(_PRICE()), f"concat_ws(':', {_p(f'{_SEC} // 86400')}, {_p(f'{_SEC} % 86400 // 3600')}, {_p(f'{_SEC} % 3600 // 60')}, {_p(f'{_SEC} % 60')})"))
scalar("minutes_to_hm", *ORDER, v=(lambda: D.minutes_to_hm(_PRICE()), f"concat_ws(':', {_p(f'{_SEC} // 60')}, {_p(f'{_SEC} % 60')})"))
scalar("minutes_to_dhm", *ORDER, v=(lambda: D.minutes_to_dhm(_PRICE()), f"concat_ws(':', {_p(f'{_SEC} // 1440')}, {_p(f'{_SEC} % 1440 // 60')}, {_p(f'{_SEC} % 60')})"))

# --- numbers ---------------------------------------------------------------------------------
bal = lambda: c("c_acctbal")
size = lambda: c("p_size")
price = lambda: c("p_retailprice")
R = lambda x, n=6: F.round(x, n)


def R_sql(x: str, n: int = 6) -> str:
    return f"round({x}, {n})"


scalar("safe_divide", *PART, v=(lambda: R(N.safe_divide(price(), size() % 5)), R_sql("coalesce(p_retailprice / nullif(p_size % 5, 0), 0.0)")))
scalar("ratio", *PART, v=(lambda: R(N.ratio(price(), size() % 5)), R_sql("p_retailprice / nullif(p_size % 5, 0)")))
scalar("round_digits", *CUST, v=(lambda: N.round_digits(bal() / 7, 2), "round(c_acctbal / 7, 2)"))
scalar("round_to_increment", *CUST, v=(lambda: N.round_to_increment(bal(), 25), "round(c_acctbal / 25) * 25"))
scalar("floor", *CUST, v=(lambda: N.floor(bal()), "floor(c_acctbal)::BIGINT"), s=(lambda: N.floor(bal(), 50.0), "floor(c_acctbal / 50.0) * 50"))
scalar("ceil", *CUST, v=(lambda: N.ceil(bal()), "ceil(c_acctbal)::BIGINT"), s=(lambda: N.ceil(bal(), 50.0), "ceil(c_acctbal / 50.0) * 50"))
scalar("trunc", *CUST, v=(lambda: N.trunc(bal()), "trunc(c_acctbal)"), d=(lambda: N.trunc(bal() / 7, 1), "trunc(c_acctbal / 7 * 10) / 10"))
scalar("int", *CUST, v=(lambda: N.to_int(bal()), "trunc(c_acctbal)::BIGINT"))
scalar("abs", *CUST, v=(lambda: N.abs(bal()), "abs(c_acctbal)"))
scalar("sign", *CUST, v=(lambda: N.sign(bal()), "sign(c_acctbal)::DOUBLE"))
scalar("mod", *CUST, v=(lambda: N.mod(bal().cast("bigint"), 7), "trunc(c_acctbal)::BIGINT % 7"))
scalar("pow", *PART, v=(lambda: N.pow(size(), F.lit(3)), "pow(p_size, 3)"))
scalar("square", *PART, v=(lambda: N.square(size()), "(p_size * p_size)::BIGINT"))
scalar("sqrt", *PART, v=(lambda: R(N.sqrt(price())), R_sql("sqrt(p_retailprice)")))
scalar("exp", *PART, v=(lambda: R(N.exp(size() / 10.0)), R_sql("exp(p_size / 10.0)")))
scalar("ln", *PART, v=(lambda: R(N.ln(price())), R_sql("ln(p_retailprice)")))
scalar("log2", *PART, v=(lambda: R(N.log2(price())), R_sql("log2(p_retailprice)")))
scalar("log10", *PART, v=(lambda: R(N.log10(price())), R_sql("log10(p_retailprice)")))
scalar("log_base", *PART, v=(lambda: R(N.log_base(price(), 3)), R_sql("ln(p_retailprice) / ln(3)")))
for _f in ("sin", "cos", "tan"):
    scalar(_f, *PART, deg=(lambda f=_f: R(getattr(N, f + "_deg")(size())), R_sql(f"{_f}(radians(p_size))")),
           rad=(lambda f=_f: R(getattr(N, f + "_rad")(size())), R_sql(f"{_f}(p_size)")))
for _f in ("asin", "acos", "atan"):
    scalar(_f, *PART, deg=(lambda f=_f: R(getattr(N, f + "_deg")(size() / 50.0)), R_sql(f"degrees({_f}(p_size / 50.0))")),
           rad=(lambda f=_f: R(getattr(N, f + "_rad")(size() / 50.0)), R_sql(f"{_f}(p_size / 50.0)")))
scalar("atan2", *PART, v=(lambda: R(N.atan2(size(), F.lit(25))), R_sql("atan2(p_size, 25)")))
scalar("cot", *PART, v=(lambda: R(N.cot(size())), R_sql("cot(p_size)")))
scalar("pi", *PART, v=(lambda: R(N.pi() * size()), R_sql("pi() * p_size")))
scalar("radians", *PART, v=(lambda: R(N.radians(size())), R_sql("radians(p_size)")))
scalar("degrees", *PART, v=(lambda: R(N.degrees(size())), R_sql("degrees(p_size)")))
scalar("greatest", *PART, v=(lambda: N.greatest(price(), size() * 40.0, F.lit(None)), "greatest(p_retailprice, p_size * 40.0)"))
scalar("least", *PART, v=(lambda: N.least(price(), size() * 40.0, F.lit(None)), "least(p_retailprice, p_size * 40.0)"))
_odd, _three = (lambda: F.when(size() % 2 == 1, size())), (lambda: F.when(size() % 3 == 0, size() * 2))
_ODD, _THREE = "(CASE WHEN p_size % 2 = 1 THEN p_size END)", "(CASE WHEN p_size % 3 = 0 THEN p_size * 2 END)"
scalar("range_sum", *PART, v=(lambda: N.range_sum(_odd(), _three()), f"(coalesce({_ODD}, 0) + coalesce({_THREE}, 0))::DOUBLE"))
scalar("range_avg", *PART, v=(lambda: N.range_avg(_odd(), _three()), f"list_avg([{_ODD}, {_THREE}])"))
scalar("range_min", *PART, v=(lambda: N.range_min(_odd(), _three()), f"least({_ODD}, {_THREE})::BIGINT"))
scalar("range_max", *PART, v=(lambda: N.range_max(_odd(), _three()), f"greatest({_ODD}, {_THREE})::BIGINT"))
scalar("div", *CUST, v=(lambda: N.div(bal(), 7), "floor(c_acctbal / 7)::BIGINT"))
scalar("frac", *CUST, v=(lambda: R(N.frac(bal()), 4), R_sql("c_acctbal - floor(c_acctbal)", 4)))
scalar("odd", *PART, v=(lambda: N.odd(size()), "p_size % 2 <> 0"))
scalar("even", *PART, v=(lambda: N.even(size()), "p_size % 2 = 0"))
_N = lambda: (size() % 12 + 1).cast("int")
scalar("combination", *PART, v=(lambda: N.combination(_N(), F.lit(3)), "CASE WHEN p_size % 12 + 1 < 3 THEN 0.0 ELSE (factorial(p_size % 12 + 1) / (factorial(greatest(p_size % 12 + 1 - 3, 0)) * 6))::DOUBLE END"))
scalar("permutation", *PART, v=(lambda: N.permutation(_N(), F.lit(3)), "CASE WHEN p_size % 12 + 1 < 3 THEN 0.0 ELSE (factorial(p_size % 12 + 1) / factorial(greatest(p_size % 12 + 1 - 3, 0)))::DOUBLE END"))
scalar("ifnull", *PART, v=(lambda: N.ifnull(_odd(), F.lit(-1)), f"ifnull({_ODD}, -1)::BIGINT"))
scalar("nullif", *PART, v=(lambda: N.nullif(size(), F.lit(7)), "nullif(p_size, 7)::BIGINT"))
scalar("coalesce", *PART, v=(lambda: N.coalesce(_odd(), _three(), F.lit(0)), f"coalesce({_ODD}, {_THREE}, 0)::BIGINT"))
scalar("nvl2", *PART, v=(lambda: N.nvl2(_odd(), F.lit("odd"), F.lit("even")), f"CASE WHEN {_ODD} IS NOT NULL THEN 'odd' ELSE 'even' END"))
scalar("zeroifnull", *PART, v=(lambda: N.zeroifnull(_odd()), f"coalesce({_ODD}, 0)::BIGINT"))
scalar("nullifzero", *PART, v=(lambda: N.nullifzero(size() % 4), "nullif(p_size % 4, 0)::BIGINT"))
scalar("to_integer", *CUST, v=(lambda: N.to_integer((bal() / 7).cast("string")), "round(c_acctbal / 7)::BIGINT"),
       bad=(lambda: N.to_integer(c("c_mktsegment")), "NULL::BIGINT"))
scalar("to_double", *EVENT, v=(lambda: N.to_double(F.get_json_object("props", "$.k")), "json_extract_string(props, '$.k')::DOUBLE"),
       bad=(lambda: N.to_double(c("event_type")), "TRY_CAST(event_type AS DOUBLE)"))
scalar("to_string", *PART, v=(lambda: N.to_string(size()), "p_size::VARCHAR"))
scalar("to_bool", *PART, v=(lambda: N.to_bool(F.when(N.odd(size()), "true").when(size() > 40, "x").otherwise("no")),
       "CASE WHEN p_size % 2 <> 0 THEN true WHEN p_size > 40 THEN NULL ELSE false END"))
scalar("parse_number", *ORDER, v=(lambda: N.parse_number(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)), "$999,999,999.99"), "o_totalprice"))
scalar("future_value", *PART, v=(lambda: R(N.future_value(F.lit(0.01), size(), F.lit(-100.0), F.lit(-1000.0)), 4),
       R_sql("-(-1000.0 * pow(1.01, p_size) + -100.0 * ((pow(1.01, p_size) - 1) / 0.01))", 4)))
scalar("present_value", *PART, v=(lambda: R(N.present_value(F.lit(0.01), size(), F.lit(-100.0)), 4),
       R_sql("-(-100.0 * ((pow(1.01, p_size) - 1) / 0.01)) / pow(1.01, p_size)", 4)))


@query("npv", "SELECT o_custkey, round(sum(o_totalprice / pow(1.01, n)), 2) AS npv FROM (SELECT o_custkey, o_totalprice, "
       "date_diff('quarter', TIMESTAMP '1995-01-01', o_orderdate) + 1 AS n FROM orders) GROUP BY o_custkey")
def npv(t):
    n = D.diff_quarters(od(), F.lit("1995-01-01").cast("date")) + 1
    return t.orders.groupBy("o_custkey").agg(F.round(N.npv(0.01, c("o_totalprice"), n), 2).alias("npv"))


@query("custom_calendar", """
    SELECT retail_year, retail_month, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM (
      SELECT o_totalprice, n // 364 + 1 AS retail_year,
             (n % 364) // 91 * 3 + CASE WHEN (n % 91) // 7 < 4 THEN 1 WHEN (n % 91) // 7 < 8 THEN 2 ELSE 3 END AS retail_month
      FROM (SELECT o_totalprice, date_diff('day', DATE '1994-12-26', o_orderdate::DATE) AS n FROM orders)
    ) GROUP BY ALL""")
def custom_calendar(t):
    calendar = D.retail_calendar(t.spark, "1994-12-26", "2002-12-29")
    rows = D.custom_calendar(t.orders, "o_orderdate", calendar)
    return rows.groupBy("retail_year", "retail_month").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("network_days", """
    WITH hol AS (SELECT o_orderdate::DATE AS h FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 HAVING count(*) >= 3),
    spans AS (SELECT event_id, (TIMESTAMP '1996-01-01' + INTERVAL (event_id % 700) DAY)::DATE AS s,
                     (TIMESTAMP '1996-01-01' + INTERVAL (event_id % 700 + user_id % 60) DAY)::DATE AS e FROM events)
    SELECT event_id, (SELECT count(*) FROM range(0, date_diff('day', s, e) + 1) r(i)
                      WHERE isodow(s + i::INTEGER) <= 5 AND NOT EXISTS (SELECT 1 FROM hol WHERE h = s + i::INTEGER)) AS network_days
    FROM spans""")
def network_days(t):
    holidays = t.orders.filter(c("o_orderpriority") == "1-URGENT").groupBy(F.to_date("o_orderdate").alias("h")).count().filter("count >= 3")
    base = F.lit("1996-01-01").cast("date")
    s = F.date_add(base, (c("event_id") % 700).cast("int"))
    spans = t.events.select("event_id", s.alias("s"), F.date_add(s, (c("user_id") % 60).cast("int")).alias("e"))
    return D.network_days(spans, "s", "e", holidays, "h").select("event_id", "network_days")


# --- templates and named SQL functions ---------------------------------------------------------
scalar("sql_scalar_op", *PART,
       s=(lambda: P.sql_scalar_op("string", "upper({0})", "p_name"), "upper(p_name)"),
       i=(lambda: P.sql_scalar_op("int", "{0} * 2 + length({1})", "p_size", "p_name"), "(p_size * 2 + length(p_name))::BIGINT"),
       d=(lambda: P.sql_scalar_op("double", "round({0} / 3, 2)", "p_retailprice"), "round(p_retailprice / 3, 2)"),
       b=(lambda: P.sql_scalar_op("bool", "{0} LIKE '%ring'", "p_name"), "p_name LIKE '%ring'"))


@query("sql_aggregate_op", "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types, sum(p_size * 2)::BIGINT AS twice FROM part GROUP BY p_brand")
def sql_aggregate_op(t):
    return t.part.groupBy("p_brand").agg(
        P.sql_aggregate_op("string", "array_join(array_sort(collect_set({0})), '|')", "p_type").alias("types"),
        P.sql_aggregate_op("int", "sum({0} * 2)", "p_size").alias("twice"),
    )


@query("register_sql_udf", "SELECT p_partkey, (p_size * 7) // 60 || ':' || lpad(((p_size * 7) % 60)::VARCHAR, 2, '0') AS hm FROM part")
def register_sql_udf(t):
    P.register_sql_udf(t.spark, "hour_minute", "m INT", "STRING", "concat(CAST(m DIV 60 AS STRING), ':', lpad(CAST(m % 60 AS STRING), 2, '0'))")
    return t.part.select("p_partkey", F.expr("hour_minute(p_size * 7)").alias("hm"))
