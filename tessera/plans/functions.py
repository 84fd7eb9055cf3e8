"""One query a scalar function: its value for each row of a table, beside DuckDB's spelling of the same."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import checked as K
from tessera.functions import jsons as J
from tessera.functions import numbers as N
from tessera.functions import patterns as P
from tessera.functions import ranges as R
from tessera.functions import search as S
from tessera.functions import strings as T
from tessera.functions import times as D
from tessera.plans.query import Query

KEYS = {"customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "nation": "n_nationkey", "supplier": "s_suppkey", "documents": "doc_id", "embeddings": "vec_id"}
#: A JSON document as DuckDB text, and texts and lists made of columns.
NEST = '\'{"a": {"b": [1, "two", null], "s": "t"}, "n": \' || p_size || \', "z": null}\''
DMIX = "('  x-' || c_name || '_y ' || chr(9))"
VARY = """('{"k' || (p_size % 3) || '": 1, "v": ' || CASE p_size % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '"s"' WHEN 2 THEN '[1,2,' || p_size || ']' WHEN 3 THEN '{"k":"' || p_size || '"}' ELSE 'null' END || '}')"""
DARR = "[p_size, p_size + 1, 7]"
u = F.col


def columns() -> SimpleNamespace:
    """Columns that many entries share; they need a session."""
    c = SimpleNamespace(NAME=u("c_name"), BRAND=u("p_name"), SIZE=u("p_size"), PRICE=u("p_retailprice"), BAL=u("c_acctbal"), DAY=u("o_orderdate"), TS=u("ts"), TEXT=u("text"), PROPS=u("props"), VEC=u("embedding"))
    c.MIX = F.concat(F.lit("  x-"), c.NAME, F.lit("_y \t"))
    c.DOC = F.concat(F.lit('{"a": {"b": [1, "two", null], "s": "t"}, "n": '), c.SIZE.cast("string"), F.lit(', "z": null}'))
    c.VARY = F.expr(VARY.replace("VARCHAR", "STRING"))
    c.ARR = F.array(c.SIZE, c.SIZE + 1, F.lit(7))
    c.RANGE = R.discrete(c.SIZE, F.lit(20), "[]")
    c.VECTOR = S.to_tsvector(c.BRAND)
    return c


def digits(x: Column, n: int = 9) -> Column:
    return F.round(x, n)


#: name: table, Column, DuckDB expression (None: no such expression there)
FUNCTIONS: dict[str, tuple[str, Callable[..., Column], str | None]] = {
    # text
    "length": ("customer", lambda c: F.length(c.NAME), "length(c_name)"),
    "char_length": ("documents", lambda c: F.char_length(c.TEXT), "length(text)"),
    "character_length": ("documents", lambda c: F.character_length(c.TEXT), "length(text)"),
    "octet_length": ("documents", lambda c: F.octet_length(c.TEXT), "strlen(text)"),
    "bit_length": ("documents", lambda c: F.bit_length(c.TEXT), "bit_length(text)"),
    "lower": ("customer", lambda c: F.lower("c_mktsegment"), "lower(c_mktsegment)"),
    "upper": ("part", lambda c: F.upper(c.BRAND), "upper(p_name)"),
    "substring": ("customer", lambda c: T.substring(c.NAME, -2, 5), "substring(c_name, 1, 5)"),
    "substr": ("customer", lambda c: T.substr(c.NAME, -2, 5), "substring(c_name, 1, 2)"),
    "left": ("customer", lambda c: T.left(c.NAME, 3), "left(c_name, 3)"),
    "right": ("customer", lambda c: T.right(c.NAME, 3), "right(c_name, 3)"),
    "trim": ("customer", lambda c: T.btrim(c.MIX), f"trim({DMIX}, ' ' || chr(9))"),
    "btrim": ("customer", lambda c: T.btrim(c.MIX, " xy_\t"), f"trim({DMIX}, ' xy_' || chr(9))"),
    "ltrim": ("customer", lambda c: T.ltrim(c.MIX), f"ltrim({DMIX})"),
    "rtrim": ("customer", lambda c: T.rtrim(c.MIX), f"rtrim({DMIX}, ' ' || chr(9))"),
    "lpad": ("nation", lambda c: F.lpad("n_name", 8, "*"), "lpad(n_name, 8, '*')"),
    "rpad": ("nation", lambda c: F.rpad("n_name", 8, "ab"), "rpad(n_name, 8, 'ab')"),
    "concat": ("nation", lambda c: F.concat("n_name", F.lit("-"), F.when(u("n_nationkey") > 5, u("n_name"))), "n_name || '-' || CASE WHEN n_nationkey > 5 THEN n_name END"),
    "concat_ws": ("nation", lambda c: T.concat_ws("/", u("n_name"), F.when(u("n_nationkey") > 5, u("n_name"))), "concat_ws('/', n_name, CASE WHEN n_nationkey > 5 THEN n_name END)"),
    "replace": ("customer", lambda c: T.replace(c.NAME, "0", "oo"), "replace(c_name, '0', 'oo')"),
    "translate": ("customer", lambda c: F.translate(c.NAME, "0123C", "abc"), "translate(c_name, '0123C', 'abc')"),
    "overlay": ("customer", lambda c: F.overlay(c.NAME, F.lit("__"), F.lit(3), F.lit(4)), "left(c_name, 2) || '__' || substring(c_name, 7)"),
    "position": ("customer", lambda c: F.locate("0", c.NAME), "position('0' IN c_name)"),
    "strpos": ("customer", lambda c: T.strpos(c.NAME, "er"), "strpos(c_name, 'er')"),
    "repeat": ("nation", lambda c: T.repeat(u("n_name"), 3), "repeat(n_name, 3)"),
    "reverse": ("documents", lambda c: F.reverse(c.TEXT), "reverse(text)"),
    "initcap": ("part", lambda c: T.initcap(F.concat(F.upper(c.BRAND), F.lit("-fOO bar2baz"))), "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || lower(substring(x, 2))), ' ') || '-Foo Bar2baz'"),
    "ascii": ("customer", lambda c: T.ascii_code(c.NAME), "ascii(c_name)"),
    "chr": ("part", lambda c: T.chr_of(c.SIZE + 64), "chr(p_size + 64)"),
    "split_part": ("customer", lambda c: T.split_part(F.concat(c.NAME, F.lit("#a#b")), "#", -2), "split_part(c_name || '#a#b', '#', -2)"),
    "starts_with": ("part", lambda c: F.startswith(c.BRAND, F.lit("b")), "starts_with(p_name, 'b')"),
    "to_hex": ("customer", lambda c: T.to_hex(u("c_custkey")), "lower(to_hex(c_custkey))"),
    "format": ("nation", lambda c: T.format_text("%s is %I, %L %%", u("n_nationkey"), u("n_name"), u("n_name")), """n_nationkey || ' is ' || CASE WHEN regexp_matches(n_name, '^[a-z_][a-z0-9_]*$') THEN n_name ELSE '"' || n_name || '"' END || ', ''' || n_name || ''' %'"""),
    "quote_literal": ("customer", lambda c: T.quote_literal(F.concat(c.NAME, F.lit("'s"))), "'''' || replace(c_name || '''s', '''', '''''') || ''''"),
    "quote_ident": ("customer", lambda c: T.quote_ident(c.NAME), "'\"' || c_name || '\"'"),
    "nvl": ("nation", lambda c: F.nvl(F.when(u("n_nationkey") > 5, u("n_name")), F.lit("?")), "coalesce(CASE WHEN n_nationkey > 5 THEN n_name END, '?')"),
    "ifnull": ("nation", lambda c: F.ifnull(F.when(u("n_nationkey") > 5, u("n_name")), F.lit("?")), "ifnull(CASE WHEN n_nationkey > 5 THEN n_name END, '?')"),
    "md5": ("documents", lambda c: F.md5(c.TEXT), "md5(text)"),
    "encode_hex": ("customer", lambda c: T.encode(c.NAME, "hex"), "lower(hex(c_name))"),
    "encode_base64": ("customer", lambda c: T.encode(c.NAME, "base64"), "to_base64(encode(c_name))"),
    "encode_escape": ("nation", lambda c: T.encode(F.concat(F.lit("é\\"), u("n_name")), "escape"), "'\\303\\251\\\\' || n_name"),
    "decode_escape": ("customer", lambda c: T.decode(T.encode(F.concat(F.lit("é\\"), c.NAME), "escape"), "escape").cast("string"), "'é\\' || c_name"),
    "decode_hex": ("customer", lambda c: T.decode(T.encode(c.NAME, "hex"), "hex").cast("string"), "c_name"),
    "decode_base64": ("customer", lambda c: T.decode(T.encode(c.NAME, "base64"), "base64").cast("string"), "c_name"),
    "similar_to": ("part", lambda c: T.similar_to(c.BRAND, "(a|b)%"), "regexp_full_match(p_name, '(a|b).*')"),
    "coalesce": ("nation", lambda c: F.coalesce(F.when(u("n_nationkey") > 5, u("n_regionkey")), F.lit(-1)), "coalesce(CASE WHEN n_nationkey > 5 THEN n_regionkey END, -1)"),
    "nullif": ("nation", lambda c: F.nullif("n_regionkey", F.lit(1)), "nullif(n_regionkey, 1)"),
    "greatest": ("part", lambda c: F.greatest(c.SIZE, F.lit(25), F.lit(None)), "greatest(p_size, 25, NULL)"),
    "least": ("part", lambda c: F.least(c.SIZE, F.lit(25), F.lit(None)), "least(p_size, 25, NULL)"),
    # numbers
    "abs": ("customer", lambda c: F.abs(c.BAL), "abs(c_acctbal)"),
    "round": ("part", lambda c: F.round(c.PRICE, 1), "round(p_retailprice, 1)"),
    "ceil": ("customer", lambda c: F.ceil(c.BAL), "CAST(ceil(c_acctbal) AS BIGINT)"),
    "ceiling": ("customer", lambda c: F.ceiling(c.BAL), "CAST(ceiling(c_acctbal) AS BIGINT)"),
    "floor": ("customer", lambda c: F.floor(c.BAL), "CAST(floor(c_acctbal) AS BIGINT)"),
    "trunc": ("customer", lambda c: N.trunc(c.BAL), "trunc(c_acctbal)"),
    "trunc_digits": ("customer", lambda c: N.trunc(c.BAL * 1.001, 2), "CAST(trunc(CAST(CAST(c_acctbal * 1.001 AS VARCHAR) AS DECIMAL(38, 18)) * 100) / 100 AS DOUBLE)"),
    "sign": ("customer", lambda c: N.sign(c.BAL), "CAST(sign(c_acctbal) AS INT)"),
    "sqrt": ("part", lambda c: digits(F.sqrt(c.PRICE)), "round(sqrt(p_retailprice), 9)"),
    "cbrt": ("part", lambda c: digits(F.cbrt(c.PRICE)), "round(cbrt(p_retailprice), 9)"),
    "exp": ("part", lambda c: digits(F.exp(c.SIZE / 50.0)), "round(exp(p_size / 50.0), 9)"),
    "ln": ("part", lambda c: digits(F.ln(c.PRICE)), "round(ln(p_retailprice), 9)"),
    "log": ("part", lambda c: digits(N.log(c.PRICE, 2)), "round(ln(p_retailprice) / ln(2), 9)"),
    "log10": ("part", lambda c: digits(F.log10(c.PRICE)), "round(log10(p_retailprice), 9)"),
    "power": ("part", lambda c: digits(F.power(c.SIZE, F.lit(1.5))), "round(power(p_size, 1.5), 9)"),
    "pow": ("part", lambda c: F.pow(c.SIZE, F.lit(2)), "pow(p_size, 2)"),
    "random": ("part", lambda c: F.rand().between(0, 1), "random() BETWEEN 0 AND 1"),
    "mod": ("part", lambda c: N.mod(c.SIZE, u("p_partkey") % 4), "CASE WHEN p_partkey % 4 <> 0 THEN p_size % (p_partkey % 4) END"),
    "div": ("part", lambda c: N.div(c.SIZE, u("p_partkey") % 4), "CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size // (p_partkey % 4) AS BIGINT) END"),
    "gcd": ("part", lambda c: N.gcd(c.SIZE, u("p_partkey")), "CAST(gcd(p_size, p_partkey) AS BIGINT)"),
    "lcm": ("part", lambda c: N.lcm(c.SIZE, u("p_partkey")), "CAST(lcm(p_size, p_partkey) AS BIGINT)"),
    "factorial": ("part", lambda c: F.factorial(c.SIZE % 15), "CAST(factorial(p_size % 15) AS BIGINT)"),
    "width_bucket": ("part", lambda c: F.width_bucket(c.SIZE.cast("double"), F.lit(10.0), F.lit(40.0), F.lit(6)), "CASE WHEN p_size < 10 THEN 0 WHEN p_size >= 40 THEN 7 ELSE CAST(floor((p_size - 10) / 5.0) AS BIGINT) + 1 END"),
    "pi": ("nation", lambda c: digits(F.pi()), "round(pi(), 9)"),
    **{f: ("part", lambda c, f=f: digits(getattr(F, f)(c.SIZE / 60.0)), f"round({f}(p_size / 60.0), 9)") for f in ("sin", "cos", "tan", "asin", "acos", "atan", "cot", "sinh", "cosh", "tanh", "asinh", "atanh", "degrees", "radians")},
    "acosh": ("part", lambda c: digits(F.acosh(c.SIZE + 1.0)), "round(acosh(p_size + 1.0), 9)"),
    "atan2": ("part", lambda c: digits(F.atan2(c.SIZE, F.lit(3))), "round(atan2(p_size, 3), 9)"),
    # times
    **{f"extract_{f}": ("orders", lambda c, f=f: D.extract(f, c.DAY), f"CAST(extract({f} FROM o_orderdate) AS BIGINT)") for f in ("year", "month", "day", "hour", "minute", "quarter", "decade", "century", "millennium", "dow", "isodow", "doy", "week")},
    "extract_second": ("events", lambda c: D.extract("second", c.TS), "CAST(floor(extract(second FROM ts)) AS BIGINT)"),
    "extract_epoch": ("events", lambda c: D.extract("epoch", c.TS), "CAST(floor(epoch(ts)) AS BIGINT)"),
    "date_part": ("orders", lambda c: D.date_part("doy", c.DAY), "CAST(date_part('doy', o_orderdate) AS BIGINT)"),
    **{f"date_trunc_{f}": ("events", lambda c, f=f: F.date_trunc(f, c.TS), f"date_trunc('{f}', ts)::TIMESTAMP") for f in ("year", "quarter", "month", "day", "hour", "minute", "second")},
    "make_date": ("part", lambda c: D.make_date(F.lit(2024), c.SIZE % 12 + 1, c.SIZE), "CASE WHEN p_size <= day(last_day(make_date(2024, p_size % 12 + 1, 1))) THEN make_date(2024, p_size % 12 + 1, least(p_size, day(last_day(make_date(2024, p_size % 12 + 1, 1))))) END"),
    "make_time": ("part", lambda c: D.make_time(c.SIZE % 24, c.SIZE, c.SIZE), "lpad(CAST(p_size % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_size AS VARCHAR), 2, '0')"),
    "make_timestamp": ("part", lambda c: D.make_timestamp(F.lit(2024), c.SIZE % 12 + 1, c.SIZE % 28 + 1, c.SIZE % 24, c.SIZE, c.SIZE), "make_timestamp(2024, p_size % 12 + 1, p_size % 28 + 1, p_size % 24, p_size, CAST(p_size AS DOUBLE))"),
    "timezone": ("orders", lambda c: D.timezone("UTC+5:30".replace("5:30", "05:30"), c.DAY), "o_orderdate + INTERVAL '5 hours 30 minutes'"),
    "timestamp_plus_interval": ("orders", lambda c: D.plus(c.DAY, "1 month 2 days 03:04:05"), "o_orderdate + INTERVAL '1 month' + INTERVAL '2 days' + INTERVAL '3 hours 4 minutes 5 seconds'"),
    "timestamp_minus_interval": ("orders", lambda c: D.plus(c.DAY, "1-2 ago"), "o_orderdate - INTERVAL '14 months'"),
    "interval_times": ("orders", lambda c: D.plus(c.DAY, "1 day 2 hours", 3), "o_orderdate + INTERVAL '3 days 6 hours'"),
    "interval_plus_interval": ("orders", lambda c: c.DAY + (D.interval("1 day") + D.interval("02:30:00")), "o_orderdate + INTERVAL '1 day' + INTERVAL '150 minutes'"),
    "interval_minus_interval": ("orders", lambda c: c.DAY + (D.interval("3 days") - D.interval("1 day 1 hour")), "o_orderdate + INTERVAL '47 hours'"),
    "interval_times_column": ("orders", lambda c: c.DAY + D.scaled("1 day 1 hour", u("o_orderkey") % 5), "o_orderdate + INTERVAL '25 hours' * CAST(o_orderkey % 5 AS INT)"),
    **{f: ("nation", lambda c, f=f: getattr(D, f)() >= F.lit("2020-01-01").cast("timestamp"), "year(current_date) >= 2020") for f in ("now", "current_timestamp", "transaction_timestamp", "statement_timestamp", "clock_timestamp")},
    "current_date": ("nation", lambda c: F.abs(F.datediff(D.current_date(), F.to_date(D.now()))) <= 1, "current_date >= DATE '2020-01-01'"),
    "localtimestamp": ("nation", lambda c: F.year(D.localtimestamp()) >= 2020, "year(current_date) >= 2020"),
    "current_time": ("nation", lambda c: D.current_time().rlike("^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$"), "year(current_date) >= 2020"),
    "localtime": ("nation", lambda c: D.localtime().rlike("^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$"), "year(current_date) >= 2020"),
    "to_char_date": ("orders", lambda c: D.to_char(c.DAY, 'YYYY-MM-DD "at" HH24:MI:SS Q DDD D WW'), "strftime(o_orderdate, '%Y-%m-%d at %H:%M:%S ') || quarter(o_orderdate) || ' ' || strftime(o_orderdate, '%j ') || (dayofweek(o_orderdate) + 1) || ' ' || lpad(CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS VARCHAR), 2, '0')"),
    "to_char_names": ("orders", lambda c: D.to_char(c.DAY, "MONTH|MON|DY|DAY|HH12 AM"), "rpad(upper(strftime(o_orderdate, '%B')), 9, ' ') || '|' || upper(strftime(o_orderdate, '%b')) || '|' || upper(strftime(o_orderdate, '%a')) || '|' || rpad(upper(strftime(o_orderdate, '%A')), 9, ' ') || '|' || strftime(o_orderdate, '%I %p')"),
    "to_char_number": ("part", lambda c: D.number_to_char(c.SIZE + 0.5, "FM9990.00"), "format('{:.2f}', p_size + 0.5)"),
    "to_date": ("orders", lambda c: F.to_date(F.date_format(c.DAY, "yyyyMMdd"), "yyyyMMdd"), "CAST(o_orderdate AS DATE)"),
    "to_number": ("part", lambda c: F.try_to_number(c.SIZE.cast("string"), F.lit("999")).cast("int"), "p_size"),
    # arrays
    "array_construct": ("part", lambda c: A.array_to_string(c.ARR, ","), f"array_to_string({DARR}, ',')"),
    "array_subscript": ("part", lambda c: A.element(c.ARR, -1), f"{DARR}[-1]"),
    "array_slice": ("part", lambda c: A.array_to_string(A.part(c.ARR, 2, 3), ","), f"array_to_string({DARR}[2:3], ',')"),
    "array_length": ("embeddings", lambda c: A.array_length(c.VEC), "nullif(len(embedding), 0)"),
    "cardinality": ("part", lambda c: A.cardinality(F.array(c.ARR, c.ARR), 2), f"CAST(len(flatten([{DARR}, {DARR}])) AS INT)"),
    "array_ndims": ("part", lambda c: A.array_ndims(F.when(c.SIZE % 7 != 0, c.ARR).otherwise(F.array().cast("array<int>"))) * 10 + A.array_ndims(F.array(c.ARR, c.ARR)), "CASE WHEN p_size % 7 <> 0 THEN 12 END"),
    "array_lower": ("part", lambda c: A.array_lower(F.filter(c.ARR, lambda x: x > 30)), f"CASE WHEN len(list_filter({DARR}, lambda x: x > 30)) > 0 THEN 1 END"),
    "array_upper": ("part", lambda c: A.array_upper(F.filter(c.ARR, lambda x: x > 30)), f"nullif(CAST(len(list_filter({DARR}, lambda x: x > 30)) AS INT), 0)"),
    "array_append": ("part", lambda c: A.array_to_string(F.array_append(c.ARR, 9), ","), f"array_to_string(list_append({DARR}, 9), ',')"),
    "array_prepend": ("part", lambda c: A.array_to_string(F.array_prepend(c.ARR, 9), ","), f"array_to_string(list_prepend(9, {DARR}), ',')"),
    "array_cat": ("part", lambda c: A.array_to_string(A.array_cat(c.ARR, F.when(c.SIZE > 20, c.ARR)), ","), f"array_to_string(list_concat({DARR}, CASE WHEN p_size > 20 THEN {DARR} ELSE [] END), ',')"),
    "array_position": ("part", lambda c: A.array_position(c.ARR, 7), f"CAST(list_position({DARR}, 7) AS BIGINT)"),
    "array_to_string": ("part", lambda c: A.array_to_string(F.array(c.SIZE, F.lit(None)), "-", "?"), "p_size || '-?'"),
    "string_to_array": ("customer", lambda c: A.array_to_string(A.string_to_array(c.NAME, "0", ""), "|", "-"), "replace(array_to_string(list_transform(string_split(c_name, '0'), lambda x: CASE WHEN x = '' THEN '-' ELSE x END), '|'), '~', '~')"),
    "string_to_array_chars": ("customer", lambda c: A.array_to_string(A.string_to_array(c.NAME, None), "|"), "array_to_string(string_split(c_name, ''), '|')"),
    "array_contains": ("part", lambda c: A.contains(c.ARR, F.array(F.lit(7), c.SIZE % 20)), f"list_has_all({DARR}, [7, p_size % 20])"),
    "array_contained": ("part", lambda c: A.contained(F.array(c.SIZE % 9, F.lit(7)), c.ARR), f"list_has_all({DARR}, [p_size % 9, 7])"),
    "array_overlaps": ("part", lambda c: A.overlaps(c.ARR, F.array(F.lit(8), F.lit(9))), f"list_has_any({DARR}, [8, 9])"),
    # JSON
    "json_step": ("part", lambda c: J.get_text(c.DOC, "a", "b", 1), f"json_extract_string({NEST}, '$.a.b[1]')"),
    "json_step_json": ("part", lambda c: J.get(c.VARY, "v"), f"CAST(json_extract({VARY}, '$.v') AS VARCHAR)"),
    "json_null_text": ("part", lambda c: J.get_text(c.VARY, "v"), f"json_extract_string({VARY}, '$.v')"),
    "json_events": ("events", lambda c: J.get_text(c.PROPS, "k").cast("int"), "CAST(json_extract_string(props, '$.k') AS INT)"),
    "json_typeof": ("part", lambda c: J.typeof(J.get(c.VARY, "v")), f"CASE json_type({VARY}, '$.v') WHEN 'UBIGINT' THEN 'number' WHEN 'VARCHAR' THEN 'string' ELSE lower(json_type({VARY}, '$.v')) END"),
    "json_array_length": ("part", lambda c: J.array_length(J.get(c.VARY, "v")), f"CASE WHEN json_type({VARY}, '$.v') = 'ARRAY' THEN CAST(json_array_length({VARY}, '$.v') AS INT) END"),
    "json_build_array": ("part", lambda c: J.build_array(c.SIZE, c.SIZE + 1), "'[' || p_size || ',' || (p_size + 1) || ']'"),
    "json_build_object": ("part", lambda c: J.build_object(k=c.SIZE, b=c.BRAND), "'{\"k\":' || p_size || ',\"b\":\"' || p_name || '\"}'"),
    "to_json": ("part", lambda c: F.to_json(F.struct(c.SIZE.alias("s"))), "'{\"s\":' || p_size || '}'"),
    "json_extract_path": ("part", lambda c: J.get(c.VARY, "v", "k"), f"CAST(json_extract({VARY}, '$.v.k') AS VARCHAR)"),
    "json_extract_path_text": ("part", lambda c: J.get_text(c.DOC, "n"), "CAST(p_size AS VARCHAR)"),
    "json_contains": ("part", lambda c: J.contains(c.VARY, F.lit('{"v": [2]}')), f"coalesce(list_contains(CAST(json_extract({VARY}, '$.v[*]') AS VARCHAR[]), '2'), FALSE)"),
    "json_exists": ("part", lambda c: F.array_contains(F.json_object_keys(c.VARY), F.concat(F.lit("k"), c.SIZE % 5)), f"list_contains(json_keys({VARY}), 'k' || (p_size % 5))"),
    "json_pretty": ("nation", lambda c: J.pretty(F.to_json(F.struct("n_nationkey"))), "'{' || chr(10) || '    \"n_nationkey\": ' || n_nationkey || chr(10) || '}'"),
    # patterns
    "regexp_replace": ("customer", lambda c: P.regexp_replace(c.NAME, "0+", "<\\0>".replace("\\0", "z")), "regexp_replace(c_name, '0+', '<z>')"),
    "regexp_replace_ahead": ("customer", lambda c: P.regexp_replace(c.NAME, "0(?=[1-9])", "<>"), "regexp_replace(c_name, '0([1-9])', '<>\\1')"),
    "regexp_replace_all": ("customer", lambda c: P.regexp_replace(c.NAME, "([0-9])", "\\1.", "g"), "regexp_replace(c_name, '([0-9])', '\\1.', 'g')"),
    "regexp_match": ("customer", lambda c: A.array_to_string(P.regexp_match(c.NAME, "([A-Za-z]+)#0*([0-9]+)"), ","), "CASE WHEN regexp_matches(c_name, '([A-Za-z]+)#0*([0-9]+)') THEN regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 1) || ',' || regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2) END"),
    "regexp_split_to_array": ("documents", lambda c: F.md5(A.array_to_string(P.regexp_split_to_array(c.TEXT, "[ \n]+"), "|")), "md5(array_to_string(regexp_split_to_array(text, '[ \n]+'), '|'))"),
    "regexp_count": ("documents", lambda c: P.regexp_count(c.TEXT, "th"), "CAST(len(regexp_extract_all(text, 'th')) AS INT)"),
    "regexp_substr": ("documents", lambda c: P.regexp_substr(c.TEXT, "[a-z]+", 1, 3), "regexp_extract_all(text, '[a-z]+')[3]"),
    # ranges
    "range_text": ("part", lambda c: R.text(c.RANGE), "CASE WHEN p_size > 20 THEN 'empty' ELSE '[' || p_size || ',21)' END"),
    "range_lower": ("part", lambda c: R.lower(c.RANGE), "CASE WHEN p_size <= 20 THEN p_size END"),
    "range_upper": ("part", lambda c: R.upper(c.RANGE), "CASE WHEN p_size <= 20 THEN 21 END"),
    "isempty": ("part", lambda c: R.isempty(c.RANGE), "p_size > 20"),
    "lower_inc": ("part", lambda c: R.lower_inc(c.RANGE), "p_size <= 20"),
    "upper_inc": ("part", lambda c: R.upper_inc(c.RANGE), "p_size IS NULL"),
    "lower_inf": ("part", lambda c: R.lower_inf(R.discrete(F.when(c.SIZE > 20, c.SIZE), c.SIZE + 5)), "p_size <= 20"),
    "upper_inf": ("part", lambda c: R.upper_inf(R.discrete(c.SIZE, F.when(c.SIZE > 20, c.SIZE + 5))), "p_size <= 20"),
    # full-text search
    "to_tsvector": ("part", lambda c: A.array_to_string(F.transform(c.VECTOR, lambda x: F.concat_ws(":", x["lexeme"], x["pos"])), " "), "array_to_string(list_transform(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda x, i: x || ':' || i), ' ')"),
    "ts_match": ("part", lambda c: S.matches(c.VECTOR, "(almond | azure) & !blue"), "list_has_any(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ['almond', 'azure']) AND NOT list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'blue')"),
    "ts_phrase": ("documents", lambda c: S.matches(S.to_tsvector(c.TEXT), "of <-> the", c.TEXT), "regexp_matches(lower(text), '(^|[^a-z0-9])of[^a-z0-9]+the([^a-z0-9]|$)')"),
    "plainto_tsquery": ("documents", lambda c: S.matches(S.to_tsvector(c.TEXT), S.plainto_tsquery("The of")), "list_has_all(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'of'])"),
    "to_tsquery": ("documents", lambda c: S.matches(S.to_tsvector(c.TEXT), S.to_tsquery("the | of")), "list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['the', 'of'])"),
    "setweight_rank": ("part", lambda c: S.ts_rank(S.setweight(c.VECTOR, "A"), "red | zzz"), "round(0.05 + CASE WHEN list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'red') THEN 0.2 + 0.1 / list_position(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'red') ELSE 0 END, 4)"),
    "ts_rank": ("part", lambda c: S.ts_rank(S.to_tsvector(F.concat(F.lit("cow "), c.BRAND)), "red & cow"), "round(0.05 + CASE WHEN list_contains(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'red') THEN 0.4 + 0.01 + 0.01 / (1 + list_position(regexp_extract_all(lower(p_name), '[a-z0-9]+'), 'red')) ELSE 0.21 END, 4)"),
}
# the jsonb names are the same functions
FUNCTIONS |= {n.replace("json", "jsonb", 1): FUNCTIONS[n] for n in ("json_typeof", "json_array_length", "json_build_array", "json_build_object", "json_extract_path", "json_extract_path_text", "json_contains", "json_exists", "json_pretty")}
FUNCTIONS |= {"to_jsonb": FUNCTIONS["to_json"], "instr": FUNCTIONS["strpos"]}
# checked types
FUNCTIONS |= {
    "uuid": ("part", lambda c: K.canonical(F.concat(F.lit("A0EEBC99-9c0b-4ef8-bb6d-"), F.lpad(c.SIZE.cast("string"), 11, "0"), F.when(c.SIZE > 20, "f").otherwise("")), "uuid"), "CASE WHEN p_size > 20 THEN 'a0eebc99-9c0b-4ef8-bb6d-' || lpad(CAST(p_size AS VARCHAR), 11, '0') || 'f' END"),
    "inet": ("part", lambda c: K.canonical(F.concat(F.lit("10.0."), c.SIZE * 8, F.lit(".1/24")), "inet"), "CASE WHEN p_size * 8 <= 255 THEN '10.0.' || (p_size * 8) || '.1/24' END"),
    "inet_within": ("part", lambda c: K.in_network(F.concat(F.lit("10.0."), c.SIZE, F.lit(".1")), F.lit("10.0.16.0/20")), "p_size BETWEEN 16 AND 31"),
    "macaddr": ("part", lambda c: K.canonical(F.concat(F.lit("08:00:2B:01:02:"), c.SIZE), "macaddr"), "CASE WHEN p_size > 9 THEN '08:00:2b:01:02:' || p_size END"),
    "bit_string": ("part", lambda c: K.canonical(F.bin(c.SIZE), "bit", 5), "CASE WHEN p_size BETWEEN 16 AND 31 THEN bin(p_size) END"),
    "point": ("part", lambda c: K.canonical(F.concat(F.lit("( "), c.SIZE, F.when(c.SIZE > 20, ", 1.5 )").otherwise(" 1 )")), "point"), "CASE WHEN p_size > 20 THEN '(' || p_size || ',1.5)' END"),
    "enum_order": ("orders", lambda c: K.enum_order(u("o_orderstatus"), ["O", "P"]), "CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 END"),
}
QUERIES = {f"fn_{name}": Query(lambda t, n=name: getattr(t, FUNCTIONS[n][0]).select(KEYS[FUNCTIONS[n][0]], FUNCTIONS[n][1](columns()).alias("value")), duck and f"SELECT {KEYS[tab]}, {duck} AS value FROM {tab}") for name, (tab, _, duck) in FUNCTIONS.items()}
