"""The catalogue of formula queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import families
from .operators.table import Table, sequence

QUERIES: dict = dict(families.QUERIES)
ORACLE_SQL: dict[str, str] = dict(families.ORACLE_SQL)


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str, *order: str) -> Table:
    return Table(spark.read.parquet(f"{d}/{name}.parquet"), list(order))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@_query("SELECT l_returnflag, round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, CAST(count(*) AS DOUBLE) AS n, max(l_quantity) AS high, min(l_quantity) AS low FROM lineitem GROUP BY 1")
def sum_measure(spark, d):
    m = _t(spark, d, "lineitem").measures({"total": "=SUM([l_quantity])", "mean": "=AVERAGE([l_quantity])", "n": "=COUNT([l_quantity])", "high": "=MAX([l_quantity])", "low": "=MIN([l_quantity])"}, ["l_returnflag"])
    return _rounded(_rounded(m, 2, "total"), 6, "mean")


@_query(
    """SELECT round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 30), 2) AS s, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS DOUBLE) AS n,
    round(avg(l_discount) FILTER (WHERE l_quantity <= 10), 6) AS a, max(l_tax) FILTER (WHERE l_returnflag <> 'A') AS hi, min(l_quantity) FILTER (WHERE l_quantity >= 7) AS lo FROM lineitem"""
)
def sumifs_fused(spark, d):
    m = _t(spark, d, "lineitem").measures(
        {"s": '=SUMIFS([l_extendedprice],[l_returnflag],"R",[l_quantity],">30")', "n": '=COUNTIFS([l_linestatus],"O")', "a": '=AVERAGEIFS([l_discount],[l_quantity],"<=10")', "hi": '=MAXIFS([l_tax],[l_returnflag],"<>A")', "lo": '=MINIFS([l_quantity],[l_quantity],">=7")'}
    )
    return _rounded(_rounded(m, 2, "s"), 6, "a")


@_query("SELECT round(sum(o_totalprice), 2) AS s FROM orders WHERE o_totalprice > 200000")
def sumif_single(spark, d):
    return _rounded(_t(spark, d, "orders").filter("=[o_totalprice]>200000").measures({"s": '=SUMIF([o_totalprice],">200000")'}), 2, "s")


@_query("SELECT CAST(count(*) FILTER (WHERE p_type ILIKE 'econ%') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE p_brand ILIKE 'brand#_1') AS DOUBLE) AS b FROM part")
def countif_wildcard(spark, d):
    return _t(spark, d, "part").measures({"a": '=COUNTIF([p_type],"ECON*")', "b": '=COUNTIF([p_brand],"Brand#?1")'})


@_query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS spent, CAST(count(*) OVER (PARTITION BY o_custkey) AS DOUBLE) AS n FROM orders")
def grouped_sumifs(spark, d):
    return _rounded(_t(spark, d, "orders").with_group({"spent": "=SUM([o_totalprice])", "n": "=COUNT([o_totalprice])"}, ["o_custkey"]).select("o_orderkey", "spent", "n"), 2, "spent")


@_query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_quantity * l_quantity), 2) AS squares FROM lineitem")
def sumproduct_revenue(spark, d):
    return _rounded(_t(spark, d, "lineitem").measures({"revenue": "=SUMPRODUCT([l_extendedprice],1-[l_discount])", "squares": "=SUMSQ([l_quantity])"}), 2, "revenue", "squares")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity / 4 AS quarter, floor(l_extendedprice * 10 + 0.5) / 10 AS tenth FROM lineitem")
def calc_column(spark, d):
    t = _t(spark, d, "lineitem").columns({"charge": "=[l_extendedprice]*(1-[l_discount])*(1+[l_tax])", "quarter": "=[l_quantity]/4", "tenth": "=ROUND([l_extendedprice],1)"})
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "charge", "quarter", "tenth")


@_query(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'small' END AS size, CASE WHEN o_totalprice < 50000 THEN 1.0 WHEN o_totalprice < 150000 THEN 2.0 ELSE 3.0 END AS band,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, (o_totalprice > 1000 AND o_orderstatus = 'O') AS both_, (o_totalprice > 1000) <> (o_orderstatus = 'O') AS one FROM orders"""
)
def if_ifs_switch(spark, d):
    t = _t(spark, d, "orders").columns(
        {"size": '=IF([o_totalprice]>150000,"big","small")', "band": "=IFS([o_totalprice]<50000,1,[o_totalprice]<150000,2,TRUE,3)", "state": '=SWITCH([o_orderstatus],"F","done","O","open","other")', "both_": '=AND([o_totalprice]>1000,[o_orderstatus]="O")', "one": '=XOR([o_totalprice]>1000,[o_orderstatus]="O")'}
    )
    return t.select("o_orderkey", "size", "band", "state", "both_", "one")


@_query("SELECT p_partkey, coalesce(p_retailprice / nullif(p_size % 5, 0), -1) AS ratio, CASE WHEN p_size % 5 = 0 THEN '#DIV/0!' END AS raw_error FROM part")
def iferror_div(spark, d):
    t = _t(spark, d, "part").columns({"ratio": "=IFERROR([p_retailprice]/MOD([p_size],5),-1)"}).columns({"raw": "=[p_retailprice]/MOD([p_size],5)"}, errors=True)
    return t.select("p_partkey", "ratio", "raw_error")


@_query("SELECT o_orderkey, c_name, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def vlookup_exact(spark, d):
    return _t(spark, d, "orders").lookup("o_custkey", _t(spark, d, "customer", "c_custkey"), "c_custkey", {"c_name": "c_name", "c_acctbal": "c_acctbal"}).select("o_orderkey", "c_name", "c_acctbal")


@_query("SELECT o_orderkey, v AS near FROM orders ASOF LEFT JOIN (SELECT p_retailprice * 100 AS k, max(p_partkey) AS v FROM part GROUP BY 1) p ON o_totalprice >= k")
def vlookup_approx(spark, d):
    part = _t(spark, d, "part").columns({"k": "=[p_retailprice]*100"}).df
    return _t(spark, d, "orders").lookup_near("o_totalprice", Table(part, ["p_partkey"]), "k", "p_partkey", "near").select("o_orderkey", "near")


@_query("SELECT o_orderkey, v AS above FROM orders ASOF LEFT JOIN (SELECT p_retailprice * 100 AS k, min(p_partkey) AS v FROM part GROUP BY 1) p ON o_totalprice <= k")
def xlookup_next_larger(spark, d):
    part = _t(spark, d, "part").columns({"k": "=[p_retailprice]*100"}).df
    return _t(spark, d, "orders").lookup_near("o_totalprice", Table(part, ["p_partkey"]), "k", "p_partkey", "above", larger=True).select("o_orderkey", "above")


@_query("SELECT c_custkey, k AS last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def xlookup_last(spark, d):
    return _t(spark, d, "customer").lookup("c_custkey", _t(spark, d, "orders", "o_orderkey"), "o_custkey", {"o_orderkey": "last_order"}, last=True).select("c_custkey", "last_order")


@_query("SELECT c_custkey, k AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def index_match(spark, d):
    return _t(spark, d, "customer").lookup("c_custkey", _t(spark, d, "orders", "o_orderkey"), "o_custkey", {"o_orderkey": "first_order"}).select("c_custkey", "first_order")


@_query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lookup_missing(spark, d):
    return _t(spark, d, "documents").missing("doc_id", _t(spark, d, "labels"), "doc_id").select("doc_id", "source")


@_query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def countif_exists(spark, d):
    return _t(spark, d, "documents").matched("doc_id", _t(spark, d, "labels"), "doc_id").select("doc_id", "source")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND (l_returnflag = 'R' OR l_discount < 0.02)")
def filter_rows(spark, d):
    return _t(spark, d, "lineitem").filter('=AND([l_quantity]>45,OR([l_returnflag]="R",[l_discount]<0.02))').select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@_query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_topk(spark, d):
    return _t(spark, d, "orders", "o_orderkey").top("o_totalprice", 25).select("o_orderkey", "o_totalprice")


@_query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_retailprice DESC, p_partkey) AS place FROM part")
def sortby_multi(spark, d):
    return _t(spark, d, "part", "p_partkey").ordered("place", [("p_size", True), ("p_retailprice", False)], ["p_brand"]).select("p_partkey", "place")


@_query("SELECT arg_min(p_type, p_partkey) AS p_type FROM part GROUP BY lower(p_type)")
def unique_ci(spark, d):
    return _t(spark, d, "part", "p_partkey").unique("p_type")


@_query("SELECT min(p_retailprice) AS p_retailprice FROM part GROUP BY p_retailprice HAVING count(*) = 1")
def unique_once(spark, d):
    return _t(spark, d, "part", "p_partkey").unique("p_retailprice", once=True)


@_query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) AS place FROM orders")
def rank_fill(spark, d):
    return _t(spark, d, "orders").rank("place", "o_totalprice").select("o_orderkey", "place")


@_query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS place FROM orders")
def rank_by_group(spark, d):
    return _t(spark, d, "orders").rank("place", "o_totalprice", True, ["o_custkey"]).select("o_orderkey", "place")


@_query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, round(median(p_retailprice), 6) AS med, round(quantile_cont(p_retailprice, 0.25), 6) AS q1 FROM part GROUP BY 1")
def percentile_quartile(spark, d):
    return _rounded(_t(spark, d, "part").measures({"p90": "=PERCENTILE([p_retailprice],0.9)", "med": "=MEDIAN([p_retailprice])", "q1": "=QUARTILE([p_retailprice],1)"}, ["p_brand"]), 6, "p90", "med", "q1")


@_query("SELECT c_mktsegment, round(var_samp(c_acctbal), 2) AS v, round(var_pop(c_acctbal), 2) AS vp, round(stddev_samp(c_acctbal), 4) AS s, round(stddev_pop(c_acctbal), 4) AS sp, round(var_pop(c_acctbal) * count(*), 0) AS dev FROM customer GROUP BY 1")
def var_family(spark, d):
    m = _t(spark, d, "customer").measures({"v": "=VAR([c_acctbal])", "vp": "=VARP([c_acctbal])", "s": "=STDEV([c_acctbal])", "sp": "=STDEVP([c_acctbal])", "dev": "=DEVSQ([c_acctbal])"}, ["c_mktsegment"])
    return _rounded(_rounded(_rounded(m, 2, "v", "vp"), 4, "s", "sp"), 0, "dev")


@_query("SELECT p_brand, round(avg(abs(p_retailprice - m)), 6) AS dev FROM part JOIN (SELECT p_brand AS b, avg(p_retailprice) AS m FROM part GROUP BY 1) ON p_brand = b GROUP BY 1")
def avedev(spark, d):
    t = _t(spark, d, "part").with_group({"m": "=AVERAGE([p_retailprice])"}, ["p_brand"])
    return _rounded(t.measures({"dev": "=AVERAGE(ABS([p_retailprice]-[m]))"}, ["p_brand"]), 6, "dev")


@_query("SELECT p_brand, round(exp(avg(ln(p_retailprice))), 6) AS g, round(count(*) / sum(1 / p_retailprice), 6) AS h FROM part GROUP BY 1")
def geo_har_mean(spark, d):
    return _rounded(_t(spark, d, "part").measures({"g": "=GEOMEAN([p_retailprice])", "h": "=HARMEAN([p_retailprice])"}, ["p_brand"]), 6, "g", "h")


@_query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(corr(l_extendedprice, l_quantity), 6) AS r, round(regr_intercept(l_extendedprice, l_quantity), 3) AS base, round(covar_pop(l_extendedprice, l_quantity), 2) AS c, round(regr_intercept(l_extendedprice, l_quantity) + 60 * regr_slope(l_extendedprice, l_quantity), 3) AS f FROM lineitem GROUP BY 1")
def regression(spark, d):
    p = "[l_extendedprice],[l_quantity]"
    m = _t(spark, d, "lineitem").measures({"slope": f"=SLOPE({p})", "r": f"=CORREL({p})", "base": f"=INTERCEPT({p})", "c": f"=COVAR({p})", "f": f"=FORECAST(60,{p})"}, ["l_returnflag"])
    return _rounded(_rounded(_rounded(_rounded(m, 4, "slope"), 6, "r"), 3, "base", "f"), 2, "c")


@_query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS three FROM events")
def moving_window(spark, d):
    return _rounded(_t(spark, d, "events", "event_id").moving("three", "SUM", "value", -2, 0, ["user_id"]).select("event_id", "three"), 4, "three")


@_query("SELECT o_orderkey, sum(floor(o_totalprice * 100 + 0.5)) OVER (ORDER BY o_orderkey) AS total FROM orders")
def running_total(spark, d):
    cents = _t(spark, d, "orders", "o_orderkey").columns({"cents": "=ROUND([o_totalprice]*100,0)"})
    return cents.running("total", "cents", "o_orderkey").select("o_orderkey", "total")


@_query("SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS delta FROM events")
def lag_delta(spark, d):
    t = _t(spark, d, "events", "event_id").shifted("before", "value", -1, ["user_id"])
    return t.df.select("event_id", (F.col("value") - F.col("before")).alias("delta"))


@_query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, CAST(date_diff('day', DATE '1899-12-30', d) AS DOUBLE) AS serial, CAST(year(d) AS DOUBLE) AS y, CAST(month(d) AS DOUBLE) AS m, CAST(day(d) AS DOUBLE) AS dd,
    CAST(dayofweek(d) + 1 AS DOUBLE) AS wd, CAST(date_diff('day', DATE '1899-12-30', last_day(d)) AS DOUBLE) AS eom, CAST(week(d) AS DOUBLE) AS iso FROM o"""
)
def date_parts(spark, d):
    t = _t(spark, d, "orders").columns({"s": "=INT([o_orderdate])"}).columns({"serial": "=[s]", "y": "=YEAR([s])", "m": "=MONTH([s])", "dd": "=DAY([s])", "wd": "=WEEKDAY([s])", "eom": "=EOMONTH([s],0)", "iso": "=WEEKNUM([s],21)"})
    return t.select("o_orderkey", "serial", "y", "m", "dd", "wd", "eom", "iso")


@_query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS b FROM orders)
    SELECT o_orderkey, CAST((SELECT count(*) FROM generate_series(a, b, INTERVAL 1 DAY) g(x) WHERE dayofweek(x) BETWEEN 1 AND 5) AS DOUBLE) AS n FROM o"""
)
def networkdays(spark, d):
    return _t(spark, d, "orders").columns({"n": "=NETWORKDAYS(INT([o_orderdate]),INT([o_orderdate])+MOD([o_orderkey],40))"}).select("o_orderkey", "n")


@_query(
    """SELECT o_orderkey, CAST((year(b) - year(a)) * 360 + (month(b) - month(a)) * 30 + least(day(b), 30) - least(day(a), 30) AS DOUBLE) AS d360, CAST(date_diff('day', a, b) AS DOUBLE) / 365 AS frac, CAST(date_diff('day', a, b) AS DOUBLE) AS days
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 400 AS b FROM orders)"""
)
def days360_yearfrac(spark, d):
    t = _t(spark, d, "orders").columns({"a": "=INT([o_orderdate])"}).columns({"d360": "=DAYS360([a],[a]+400,TRUE)", "frac": "=YEARFRAC([a],[a]+400,3)", "days": '=DATEDIF([a],[a]+400,"D")'})
    return t.select("o_orderkey", "d360", "frac", "days")


@_query("SELECT p_partkey, left(p_name, 4) AS l, right(p_name, 3) AS r, substr(p_name, 3, 5) AS m, CAST(length(p_name) AS DOUBLE) AS n, upper(p_name) AS u, trim(p_type) AS t FROM part")
def text_slice(spark, d):
    return _t(spark, d, "part").columns({"l": "=LEFT([p_name],4)", "r": "=RIGHT([p_name],3)", "m": "=MID([p_name],3,5)", "n": "=LEN([p_name])", "u": "=UPPER([p_name])", "t": "=TRIM([p_type])"}).select("p_partkey", "l", "r", "m", "n", "u", "t")


@_query("SELECT p_partkey, CAST(strpos(p_brand, '#') AS DOUBLE) AS f, CAST(strpos(lower(p_type), 'a') AS DOUBLE) AS s, replace(p_brand, '#', '-') AS sub, substr(p_brand, 1, 2) || 'XY' || substr(p_brand, 5) AS rep FROM part WHERE strpos(lower(p_type), 'a') > 0")
def text_find(spark, d):
    t = _t(spark, d, "part").filter('=ISNUMBER(SEARCH("A",[p_type]))').columns({"f": '=FIND("#",[p_brand])', "s": '=SEARCH("A",[p_type])', "sub": '=SUBSTITUTE([p_brand],"#","-")', "rep": '=REPLACE([p_brand],3,2,"XY")'})
    return t.select("p_partkey", "f", "s", "sub", "rep")


@_query("SELECT p_partkey, split_part(p_brand, '#', 1) AS b, split_part(p_brand, '#', 2) AS a, p_brand || '/' || p_type AS j FROM part")
def textbefore_after(spark, d):
    return _t(spark, d, "part").columns({"b": '=TEXTBEFORE([p_brand],"#")', "a": '=TEXTAFTER([p_brand],"#")', "j": '=TEXTJOIN("/",TRUE,[p_brand],[p_type])'}).select("p_partkey", "b", "a", "j")


@_query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS part, CAST(unnest(range(len(string_split(p_type, ' ')))) AS INTEGER) AS part_no FROM part")
def textsplit_rows(spark, d):
    return _t(spark, d, "part").split("p_type", " ").select("p_partkey", "part", "part_no")


@_query("SELECT o_orderkey, round((o_totalprice * 0.01 * pow(1.01, 24)) / (pow(1.01, 24) - 1) * -1, 4) AS pmt, round(-(o_totalprice * pow(1.01, 24)), 2) AS fv, (o_totalprice - 100) / 10 AS sln, (o_totalprice - 100) * (10 - 3 + 1) * 2 / (10 * 11) AS syd FROM orders")
def pmt_family(spark, d):
    t = _t(spark, d, "orders").columns({"pmt": "=PMT(0.01,24,[o_totalprice])", "fv": "=FV(0.01,24,0,[o_totalprice])", "sln": "=SLN([o_totalprice],100,10)", "syd": "=SYD([o_totalprice],100,10,3)"})
    return _rounded(_rounded(t.select("o_orderkey", "pmt", "fv", "sln", "syd"), 4, "pmt"), 2, "fv")


@_query(
    """SELECT p_partkey, CAST(p_size % 7 AS DOUBLE) AS m, CAST(ceil(p_retailprice / 5) * 5 AS DOUBLE) AS c, CAST(floor(p_retailprice / 5) * 5 AS DOUBLE) AS f, CAST(gcd(p_size, 12) AS DOUBLE) AS g, CAST(p_size & 5 AS DOUBLE) AS ba, CAST(p_size | 8 AS DOUBLE) AS bo,
    CAST(xor(p_size, 3) AS DOUBLE) AS bx, CAST(trunc(p_retailprice) AS DOUBLE) AS t, sign(p_size - 20.0) AS s FROM part"""
)
def math_misc(spark, d):
    t = _t(spark, d, "part").columns({"m": "=MOD([p_size],7)", "c": "=CEILING([p_retailprice],5)", "f": "=FLOOR([p_retailprice],5)", "g": "=GCD([p_size],12)", "ba": "=BITAND([p_size],5)", "bo": "=BITOR([p_size],8)", "bx": "=BITXOR([p_size],3)", "t": "=TRUNC([p_retailprice])", "s": "=SIGN([p_size]-20)"})
    return t.df.select("p_partkey", "m", "c", "f", "g", "ba", "bo", "bx", "t", F.col("s").cast("double").alias("s")).withColumn("s", F.col("s").cast("tinyint"))


@_query("SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(atan2(p_size, 3), 9) AS a, round(sqrt(p_retailprice), 9) AS q FROM part")
def trig_log(spark, d):
    t = _t(spark, d, "part").columns({"l": "=LN([p_retailprice])", "l10": "=LOG10([p_retailprice])", "s": "=SIN([p_size])", "c": "=COS([p_size])", "a": "=ATAN2(3,[p_size])", "q": "=SQRT([p_retailprice])"})
    return _rounded(t.select("p_partkey", "l", "l10", "s", "c", "a", "q"), 9, "l", "l10", "s", "c", "a", "q")


@_query("SELECT range AS row, 5 + range * 3 AS value FROM range(1000)")
def sequence_gen(spark, d):
    return sequence(spark, 1000, 5, 3)


@_query("SELECT p_partkey, true AS num, false AS txt, false AS blank, CAST(2 AS DOUBLE) AS kind, p_size % 2 = 0 AS even FROM part")
def type_info(spark, d):
    return _t(spark, d, "part").columns({"num": "=ISNUMBER([p_size])", "txt": "=ISTEXT([p_size])", "blank": "=ISBLANK([p_name])", "kind": "=TYPE([p_name])", "even": "=ISEVEN([p_size])"}).select("p_partkey", "num", "txt", "blank", "kind", "even")
