"""Queries over families of functions: each column is a formula and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .operators.table import Table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _family(name: str, table: str, key: str, cases: dict[str, tuple[str, str]], digits: int = 8, source: str | None = None, before: dict[str, str] | None = None) -> None:
    """A query of formula columns; SQL starting with "n:" is a number, rounded on
    both sides, with "t:" text and with "b:" a logical."""
    fields = []
    for alias, (_, sql) in cases.items():
        kind, expression = sql.split(":", 1)
        fields.append(f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {alias}" if kind == "n" else f"{expression} AS {alias}")
    ORACLE_SQL[name] = f"SELECT {key}, {', '.join(fields)} FROM {source or table}"

    def query(spark, d) -> DataFrame:
        t = Table(spark.read.parquet(f"{d}/{table}.parquet"), [key])
        if before:
            t = t.columns(before)
        t = t.columns({a: f for a, (f, _) in cases.items()})
        return t.df.select(key, *[(F.round(F.col(a).cast("double"), digits) + 0.0).alias(a) if s.startswith("n:") else a for a, (_, s) in cases.items()])

    query.__name__ = name
    QUERIES[name] = query


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark, d: str, name: str, *order: str) -> Table:
    return Table(spark.read.parquet(f"{d}/{name}.parquet"), list(order))


_family("rounding", "part", "p_partkey", {
    "a": ("=ROUND([p_retailprice]/7,3)", "n:round(p_retailprice / 7, 3)"), "b": ("=ROUNDUP([p_retailprice],0)", "n:ceil(p_retailprice)"), "c": ("=ROUNDDOWN([p_retailprice],-1)", "n:floor(p_retailprice / 10) * 10"),
    "d": ("=TRUNC(-[p_retailprice])", "n:-floor(p_retailprice)"), "e": ("=INT(-[p_retailprice])", "n:floor(-p_retailprice)"), "f": ("=EVEN([p_size])", "n:ceil(p_size / 2) * 2"), "g": ("=ODD([p_size])", "n:p_size + (1 - p_size % 2)"),
    "h": ("=MROUND([p_size],4)", "n:floor(p_size / 4 + 0.5) * 4"), "i": ("=ABS(20-[p_size])", "n:abs(20 - p_size)"), "j": ("=SIGN(20-[p_size])", "n:sign(20 - p_size)"), "k": ("=CEILING([p_size],6)", "n:ceil(p_size / 6) * 6"), "l": ("=FLOOR([p_size],6)", "n:floor(p_size / 6) * 6"),
})
_family("powers_logs", "part", "p_partkey", {
    "a": ("=POWER([p_size],1.5)", "n:pow(p_size, 1.5)"), "b": ("=EXP([p_size]/10)", "n:exp(p_size / 10)"), "c": ("=LN([p_size]+1)", "n:ln(p_size + 1)"), "d": ("=LOG([p_size]+1,3)", "n:ln(p_size + 1) / ln(3)"), "e": ("=LOG([p_size]+2)", "n:log10(p_size + 2)"), "f": ("=LOG10([p_retailprice])", "n:log10(p_retailprice)"),
    "g": ("=SQRTPI([p_size])", "n:sqrt(p_size * pi())"), "h": ("=PI()*[p_size]", "n:pi() * p_size"), "i": ("=RADIANS([p_size])", "n:radians(p_size)"), "j": ("=DEGREES([p_size]/50)", "n:degrees(p_size / 50)"), "k": ("=SQRT([p_size])", "n:sqrt(p_size)"), "l": ("=[p_size]^2%", "n:pow(p_size, 0.02)"), "m": ("=+[p_size]*-1", "n:-p_size"),
}, 6)
_family("trigonometry", "part", "p_partkey", {
    "a": ("=SIN([p_size])", "n:sin(p_size)"), "b": ("=COS([p_size])", "n:cos(p_size)"), "c": ("=TAN([p_size]/40)", "n:tan(p_size / 40)"), "d": ("=ASIN([p_size]/60)", "n:asin(p_size / 60)"), "e": ("=ACOS([p_size]/60)", "n:acos(p_size / 60)"), "f": ("=ATAN([p_size])", "n:atan(p_size)"), "g": ("=ATAN2([p_size],2)", "n:atan2(2, p_size)"),
    "h": ("=SINH([p_size]/10)", "n:(exp(p_size / 10) - exp(-p_size / 10)) / 2"), "i": ("=COSH([p_size]/10)", "n:(exp(p_size / 10) + exp(-p_size / 10)) / 2"), "j": ("=TANH([p_size]/30)", "n:(exp(p_size / 15) - 1) / (exp(p_size / 15) + 1)"), "k": ("=ASINH([p_size])", "n:ln(p_size + sqrt(p_size * p_size + 1))"), "l": ("=ACOSH([p_size]+1)", "n:ln(p_size + 1 + sqrt((p_size + 1) * (p_size + 1) - 1))"), "m": ("=ATANH([p_size]/60)", "n:0.5 * ln((1 + p_size / 60) / (1 - p_size / 60))"),
}, 6)
_ROMAN = "['', 'M'][(p_size + 900) // 1000 + 1] || ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(p_size + 900) // 100 % 10 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(p_size + 900) // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][(p_size + 900) % 10 + 1]"
_family("integers", "part", "p_partkey", {
    "a": ("=FACT(MOD([p_size],12))", "n:(p_size % 12)!"), "b": ("=COMBIN([p_size]+3,3)", "n:(p_size + 3) * (p_size + 2) * (p_size + 1) / 6"), "c": ("=PERMUT([p_size]+2,2)", "n:(p_size + 2) * (p_size + 1)"), "d": ("=LCM([p_size],6)", "n:lcm(p_size, 6)"), "e": ("=GCD([p_size],18,27)", "n:gcd(gcd(p_size, 18), 27)"),
    "f": ("=BITLSHIFT([p_size],3)", "n:p_size * 8"), "g": ("=BITRSHIFT([p_size],2)", "n:p_size // 4"), "h": ("=BITAND([p_size],6)", "n:p_size & 6"), "i": ("=BITOR([p_size],9)", "n:p_size | 9"), "j": ("=BITXOR([p_size],7)", "n:xor(p_size, 7)"), "k": ("=DELTA([p_size],7)", "n:CASE WHEN p_size = 7 THEN 1 ELSE 0 END"), "l": ("=GESTEP([p_size],20)", "n:CASE WHEN p_size >= 20 THEN 1 ELSE 0 END"),
    "m": ("=BASE([p_size],2)", "t:bin(p_size)"), "n": ("=BASE([p_partkey],16)", "t:upper(hex(p_partkey))"), "o": ("=DECIMAL(BASE([p_partkey],36),36)", "n:p_partkey"), "p": ("=ROMAN([p_size]+900)", f"t:{_ROMAN}"), "q": ("=ARABIC(ROMAN([p_size]+900))", "n:p_size + 900"),
})
_LIST = "[CAST(l_quantity AS DOUBLE), l_linenumber, 9]"
_family("row_aggregates", "lineitem", "l_orderkey", {
    f"a{i}": (f"={f}([l_quantity],[l_linenumber],9)", f"n:{s}")
    for i, (f, s) in enumerate({
        "SUM": f"list_sum({_LIST})", "AVERAGE": f"list_avg({_LIST})", "MIN": f"list_min({_LIST})", "MAX": f"list_max({_LIST})", "PRODUCT": "l_quantity * l_linenumber * 9", "SUMSQ": "l_quantity * l_quantity + l_linenumber * l_linenumber + 81", "COUNT": "3", "COUNTA": "3", "MEDIAN": f"list_median({_LIST})",
        "VAR": f"list_var_samp({_LIST})", "STDEV": f"list_stddev_samp({_LIST})", "VARP": f"list_var_pop({_LIST})", "STDEVP": f"list_stddev_pop({_LIST})", "DEVSQ": f"list_var_pop({_LIST}) * 3", "GEOMEAN": "pow(l_quantity * l_linenumber * 9, 1.0 / 3)", "HARMEAN": "3 / (1 / l_quantity + 1 / l_linenumber + 1.0 / 9)",
        "AVEDEV": f"list_avg(list_transform({_LIST}, lambda x: abs(x - list_avg({_LIST}))))",
    }.items())
}, 6)
_family("array_formulas", "part", "p_partkey", {
    "a": ("=SUM({1,2,3}*[p_size])", "n:6 * p_size"), "b": ("=MAX({10,20}-[p_size])", "n:20 - p_size"), "c": ("=SUM(({5,15,25}<[p_size])*1)", "n:(CASE WHEN p_size > 5 THEN 1 ELSE 0 END) + (CASE WHEN p_size > 15 THEN 1 ELSE 0 END) + (CASE WHEN p_size > 25 THEN 1 ELSE 0 END)"), "d": ("=SUM({1;2}+{10,20})+[p_size]", "n:66 + p_size"),
    "e": ("=INDEX({7,8;9,10},1+ISODD([p_size]),2)", "n:CASE WHEN p_size % 2 = 1 THEN 10 ELSE 8 END"), "f": ("=SUMPRODUCT({1,2},{3,4})*[p_size]", "n:11 * p_size"), "g": ("=LARGE({4,8,6},1+MOD([p_size],3))", "n:[8, 6, 4][p_size % 3 + 1]"), "h": ("=SMALL({4,8,6},1+MOD([p_size],3))", "n:[4, 6, 8][p_size % 3 + 1]"), "i": ("=-SUM({1,2}%)*[p_size]", "n:-0.03 * p_size"), "j": ('=CONCAT({"a","b"}&[p_type])', "t:'a' || p_type || 'b' || p_type"),
})
_family("dynamic_arrays", "part", "p_partkey", {
    "a": ("=SUM(SEQUENCE(1+MOD([p_size],9)))", "n:(p_size % 9 + 1) * (p_size % 9 + 2) / 2"), "b": ("=SUM(SEQUENCE(2,3,[p_size],2))", "n:6 * p_size + 30"), "c": ("=SUM(UNIQUE({1;2;2}*[p_size]))", "n:3 * p_size"), "d": ("=INDEX(SORT({3;1;2}*[p_size],1,-1),2)", "n:2 * p_size"), "e": ("=SUM(FILTER({5,15,25,50},{5,15,25,50}>=[p_size]))", "n:list_sum(list_filter([5, 15, 25, 50], lambda x: x >= p_size))"),
    "f": ("=INDEX(SORTBY({1,2,3}+[p_size],{3,1,2}),1)", "n:p_size + 2"), "g": ('=INDEX(TEXTSPLIT([p_name]," "),2)', "t:split_part(p_name, ' ', 2)"), "h": ('=COLUMNS(TEXTSPLIT([p_name]," "))', "n:len(string_split(p_name, ' '))"), "i": ("=ROWS(SEQUENCE(1+MOD([p_size],4)))", "n:p_size % 4 + 1"),
})
_family("table_lookups", "part", "p_partkey", {
    "a": ('=VLOOKUP([p_size],{0,"small";15,"middle";35,"big"},2)', "t:CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'middle' ELSE 'big' END"), "b": ('=IFNA(VLOOKUP([p_type],{"economy",1;"PROMO",2},2,FALSE),0)', "n:CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 ELSE 0 END"), "c": ("=HLOOKUP(MOD([p_size],3),{0,1,2;5,6,7},2,FALSE)", "n:p_size % 3 + 5"),
    "d": ("=MATCH([p_size],{0,10,20,30,40})", "n:least(p_size // 10 + 1, 5)"), "e": ('=LOOKUP([p_size],{0,20},{"lo","hi"})', "t:CASE WHEN p_size < 20 THEN 'lo' ELSE 'hi' END"), "f": ("=CHOOSE(1+MOD([p_size],3),7,8,9)", "n:7 + p_size % 3"), "g": ('=XLOOKUP(MOD([p_size],5),{1,2,3},{"x","y","z"},"none")', "t:['none', 'x', 'y', 'z', 'none'][p_size % 5 + 1]"), "h": ("=XMATCH([p_size],{10,20,60},1)", "n:CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 20 THEN 2 ELSE 3 END"),
    "i": ('=IFERROR(XMATCH("*"&LEFT([p_type],2)&"*",{"an EConomy","PRomo"},2),9)', "n:CASE WHEN left(p_type, 2) = 'EC' THEN 1 WHEN left(p_type, 2) = 'PR' THEN 2 ELSE 9 END"), "j": ("=INDEX({5,6,7},1+MOD([p_size],3))", "n:5 + p_size % 3"), "k": ("=ADDRESS([p_size]+1,2)", "t:'$B$' || (p_size + 1)"), "l": ("=COUNTIF({10,20,30},\"<\"&[p_size])", "n:(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) + (CASE WHEN p_size > 20 THEN 1 ELSE 0 END) + (CASE WHEN p_size > 30 THEN 1 ELSE 0 END)"),
})
_family("text_functions", "part", "p_partkey", {
    "a": ("=LOWER([p_type])", "t:lower(p_type)"), "b": ("=PROPER([p_type])", "t:upper(left(p_type, 1)) || lower(substr(p_type, 2))"), "c": ("=REPT([p_type],2)", "t:p_type || p_type"), "d": ("=CHAR(65+MOD([p_size],26))", "t:chr(65 + p_size % 26)"), "e": ("=CODE([p_type])", "n:ascii(p_type)"), "f": ("=UNICODE([p_name])", "n:unicode(p_name)"), "g": ("=UNICHAR(945+MOD([p_size],20))", "t:chr(945 + p_size % 20)"),
    "h": ('=VALUE(TEXTAFTER([p_brand],"#"))', "n:CAST(split_part(p_brand, '#', 2) AS DOUBLE)"), "i": ('=EXACT([p_type],UPPER([p_type]))', "b:p_type = upper(p_type)"), "j": ('=CONCATENATE([p_brand],"/",[p_size])', "t:p_brand || '/' || p_size"), "k": ("=FIXED([p_retailprice],1)", "t:format('{:,.1f}', p_retailprice)"), "l": ("=DOLLAR(-[p_size],0)", "t:CASE WHEN p_size = 0 THEN '$0' ELSE '($' || p_size || ')' END"), "m": ('=TEXT([p_size]*1000,"#,##0.0")', "t:format('{:,.1f}', CAST(p_size * 1000 AS DOUBLE))"),
    "n": ('=CLEAN([p_type]&CHAR(9))', "t:p_type"), "o": ('=[p_size]/4&""', "t:format('{:.15g}', p_size / 4)"), "p": ('=TEXTBEFORE([p_name],"RING",1,1,0,"none")', "t:CASE WHEN strpos(lower(p_name), 'ring') > 0 THEN left(p_name, strpos(lower(p_name), 'ring') - 1) ELSE 'none' END"), "q": ('=SUBSTITUTE([p_name]," ","_",1)', "t:regexp_replace(p_name, ' ', '_')"), "r": ('=IFERROR(SEARCH("r?n",[p_name]),0)', "n:CASE WHEN regexp_matches(p_name, 'r.n') THEN length(regexp_extract(p_name, '^(.*?)r.n', 1)) + 1 ELSE 0 END"),
    "s": ('=IFERROR(FIND("w",[p_name]),0)', "n:strpos(p_name, 'w')"), "t": ('=CONCAT([p_brand],{"-","+"})', "t:p_brand || '-+'"), "u": ("=T([p_type])&T([p_size])", "t:p_type"), "v": ('=MID([p_name],2,3)&LEFT([p_type])&RIGHT([p_type],2)', "t:substr(p_name, 2, 3) || left(p_type, 1) || right(p_type, 2)"), "w": ('=LEN(TRIM("  "&[p_name]&"  x "))', "n:length(p_name) + 2"),
})
_family("information", "part", "p_partkey", {
    "a": ("=ISNONTEXT([p_size])", "b:true"), "b": ("=ISLOGICAL([p_size]>9)", "b:true"), "c": ("=ISERROR(1/MOD([p_size],4))", "b:p_size % 4 = 0"), "d": ("=ISERR(1/MOD([p_size],4))", "b:p_size % 4 = 0"), "e": ("=ISNA(IF([p_size]>20,NA(),1))", "b:p_size > 20"), "f": ("=ISODD([p_size])", "b:p_size % 2 = 1"), "g": ("=N([p_size]>20)", "n:CAST(p_size > 20 AS INTEGER)"), "h": ("=IFNA(ERROR.TYPE(1/MOD([p_size],4)),0)", "n:CASE WHEN p_size % 4 = 0 THEN 2 ELSE 0 END"),
    "i": ("=IFNA(IF([p_size]>20,NA(),1),5)", "n:CASE WHEN p_size > 20 THEN 5 ELSE 1 END"), "j": ("=NOT([p_size]>20)", "b:NOT p_size > 20"), "k": ("=OR(TRUE(),FALSE())=([p_size]>20)", "b:p_size > 20"), "l": ("=XOR([p_size]>20,[p_size]>30,TRUE)", "b:((p_size > 20) <> (p_size > 30)) <> true"), "m": ("=AND({1,1},[p_size]>20)", "b:p_size > 20"), "n": ('=TYPE([p_type])+TYPE(1/0)+TYPE({1,2})', "n:82"), "o": ("=ISTEXT([p_type])", "b:true"), "p": ("=ISNUMBER([p_type])", "b:false"), "q": ("=ISBLANK([p_type])", "b:false"), "r": ("=ISEVEN([p_size])", "b:p_size % 2 = 0"),
    "s": ('=IFS([p_size]<10,"a",[p_size]<30,"b",TRUE,"c")', "t:CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 30 THEN 'b' ELSE 'c' END"), "t": ('=SWITCH(MOD([p_size],4),0,"zero",1,"one","more")', "t:CASE p_size % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END"), "v": ("=IFERROR(1/MOD([p_size],4),0)", "n:CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1.0 / (p_size % 4) END"), "w": ("=ISREF([p_size])", "b:false"), "x": ("=0.1*[p_size]+0.2=0.3", "b:p_size = 1"),
})
_DAY = "(SELECT *, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey % 700 AS INTEGER) AS k FROM orders)"
_SERIAL = "date_diff('day', DATE '1899-12-30', {})"
_BEFORE = {"s": "=INT([o_orderdate])", "k": "=MOD([o_orderkey],700)"}
_MONTHS = "((year(d + k) - year(d)) * 12 + month(d + k) - month(d) - CAST(day(d + k) < day(d) AS INTEGER))"
_family("dates", "orders", "o_orderkey", {
    "a": ("=DATE(YEAR([s]),MONTH([s])+[k],DAY(1))", "n:" + _SERIAL.format("CAST(date_trunc('month', d) AS DATE) + to_months(k)")), "b": ("=EDATE([s],[k])", "n:" + _SERIAL.format("CAST(d + to_months(k) AS DATE)")), "c": ("=EOMONTH([s],-[k])", "n:" + _SERIAL.format("last_day(CAST(d - to_months(k) AS DATE))")), "e": ("=DAYS([s]+[k],[s])", "n:k"), "f": ("=WEEKDAY([s],2)", "n:isodow(d)"), "g": ("=WEEKDAY([s],3)", "n:isodow(d) - 1"), "h": ("=WEEKDAY([s],13)", "n:(isodow(d) + 4) % 7 + 1"),
    "i": ("=WEEKNUM([s],2)", "n:(dayofyear(d) + isodow(CAST(date_trunc('year', d) AS DATE)) - 2) // 7 + 1"), "j": ("=WEEKNUM([s])", "n:(dayofyear(d) + dayofweek(CAST(date_trunc('year', d) AS DATE)) - 1) // 7 + 1"), "t": ("=TODAY()-TODAY()+YEAR([s])", "n:year(d)"), "u": ("=ISNUMBER(NOW())", "b:true"),
}, source=_DAY, before=_BEFORE)
_family("date_spans", "orders", "o_orderkey", {
    "l": ("=YEARFRAC([s],[s]+[k],2)", "n:k / 360"), "m": ("=YEARFRAC([s],[s]+[k],3)", "n:k / 365"), "n": ('=DATEDIF([s],[s]+[k],"M")', f"n:{_MONTHS}"), "o": ('=DATEDIF([s],[s]+[k],"Y")', f"n:{_MONTHS} // 12"), "p": ('=DATEDIF([s],[s]+[k],"YM")', f"n:{_MONTHS} % 12"),
    "q": ("=WORKDAY([s],5*[k])", "n:" + _SERIAL.format("CASE WHEN k > 0 AND isodow(d) > 5 THEN d - CAST(isodow(d) - 5 AS INTEGER) ELSE d END") + " + 7 * k"), "r": ("=NETWORKDAYS([s],[s]+13,{1,2,3})", "n:10"), "v": ("=DAYS360([s],[s]+[k],TRUE)", "n:(year(d + k) - year(d)) * 360 + (month(d + k) - month(d)) * 30 + least(day(d + k), 30) - least(day(d), 30)"), "w": ("=NETWORKDAYS([s],[s]+6,WORKDAY([s]-1,1))", "n:4"),
}, source=_DAY, before=_BEFORE)
_family("times", "events", "event_id", {
    "a": ("=HOUR([s])", "n:hour(s)"), "b": ("=MINUTE([s])", "n:minute(s)"), "c": ("=SECOND([s])", "n:second(s)"), "d": ("=TIME(HOUR([s]),MINUTE([s]),SECOND([s]))*86400", "n:hour(s) * 3600 + minute(s) * 60 + second(s)"), "e": ("=TIME([event_id],75,0)*24", "n:(event_id + 1.25) % 24"),
}, 5, source="(SELECT event_id, date_trunc('second', ts) AS s FROM events)", before={"s": "=INT([ts])+INT(([ts]-INT([ts]))*86400+0.000001)/86400"})
_R, _P = "0.01", "o_totalprice"
_family("finance", "orders", "o_orderkey", {
    "a": (f"=PV({_R},12,[{_P}])", f"n:-{_P} * (1 - pow(1.01, -12)) / 0.01"), "b": (f"=FV({_R},12,[{_P}],0,1)", f"n:-{_P} * (pow(1.01, 12) - 1) / 0.01 * 1.01"), "c": (f"=NPER({_R},-[{_P}]/10,[{_P}])", "n:-ln(1 - 0.1) / ln(1.01)"), "d": (f"=IPMT({_R},1,12,[{_P}])", f"n:-{_P} * 0.01"), "e": (f"=PPMT({_R},1,12,[{_P}])", f"n:{_P} * 0.01 - {_P} * 0.01 / (1 - pow(1.01, -12))"), "f": (f"=NPV(0.1,[{_P}],[{_P}])", f"n:{_P} / 1.1 + {_P} / 1.21"),
    "g": (f"=ROUND(RATE(24,PMT(0.02,24,[{_P}]),[{_P}]),6)", "n:0.02"), "h": (f"=ROUND(RATE(2,0,-[{_P}],[{_P}]*1.44),6)", "n:0.2"), "i": (f"=SLN([{_P}],10,7)", f"n:({_P} - 10) / 7"), "j": (f"=SYD([{_P}],0,4,2)", f"n:{_P} * 3 / 10"), "k": (f"=DDB([{_P}],0,10,2)", f"n:{_P} * 0.8 * 0.2"), "l": (f"=DB([{_P}],[{_P}]/10,5,2)", f"n:{_P} * (1 - 0.369) * 0.369"), "m": (f"=PMT(0,10,[{_P}])", f"n:-{_P} / 10"),
}, 4)
_family("normal", "part", "p_partkey", {
    "a": ("=NORM.S.DIST([p_size]/20,FALSE)", "n:exp(-p_size * p_size / 800) / sqrt(2 * pi())"), "b": ("=NORM.DIST([p_size],20,5,FALSE)", "n:exp(-(p_size - 20) * (p_size - 20) / 50) / 5 / sqrt(2 * pi())"), "c": ("=NORMSDIST(NORMSINV(([p_size]+1)/60))", "n:(p_size + 1) / 60"), "d": ("=NORMDIST(NORMINV(([p_size]+1)/60,3,2),3,2,TRUE)", "n:(p_size + 1) / 60"), "e": ("=NORM.S.DIST(NORM.S.INV(([p_size]+1)/60),TRUE)", "n:(p_size + 1) / 60"), "f": ("=NORM.INV(0.5,[p_size],3)", "n:p_size"),
})


@_query("SELECT l_returnflag, round(sum(l_quantity) + 5, 4) AS total, CAST(count(*) * 2 + 2 AS DOUBLE) AS n, greatest(max(l_quantity), 99) AS high , least(min(l_quantity), 0.5) AS low, CAST(count(*) + 1 AS DOUBLE) AS filled, round(sum(l_quantity * l_quantity) + 9, 2) AS squares FROM lineitem GROUP BY 1")
def measures_with_literals(spark, d):
    m = _t(spark, d, "lineitem").measures({"total": "=SUM([l_quantity],5)", "n": '=COUNT([l_quantity],[l_tax],7,"8")', "high": "=MAX([l_quantity],99)", "low": "=MIN([l_quantity],0.5)", "filled": '=COUNTA([l_linestatus],"x")', "squares": "=SUMSQ([l_quantity],3)"}, ["l_returnflag"])
    return m.withColumns({"total": F.round("total", 4), "squares": F.round("squares", 2)})


@_query("""WITH v AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS x FROM lineitem UNION ALL SELECT l_returnflag, l_linenumber FROM lineitem)
    SELECT l_returnflag, median(x) AS mid, round(var_samp(x), 6) AS v, round(stddev_pop(x), 6) AS s, round(var_pop(x) * count(*), 2) AS dev, round(avg(x), 6) AS mean, round(exp(avg(ln(x))), 6) AS geo, round(count(*) / sum(1 / x), 6) AS har FROM v GROUP BY 1""")
def measures_of_ranges(spark, d):
    both = "([l_quantity],[l_linenumber])"
    m = _t(spark, d, "lineitem").measures({"mid": f"=MEDIAN{both}", "v": f"=VAR{both}", "s": f"=STDEVP{both}", "dev": f"=DEVSQ{both}", "mean": f"=AVERAGE{both}", "geo": f"=GEOMEAN{both}", "har": f"=HARMEAN{both}"}, ["l_returnflag"])
    return m.select("l_returnflag", "mid", F.round("dev", 2).alias("dev"), *[F.round(c, 6).alias(c) for c in ("v", "s", "mean", "geo", "har")])


@_query("""SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_nationkey) AS joined, string_agg(n_name, '' ORDER BY n_nationkey) AS one, bool_and(n_nationkey > 3) AS every, bool_or(n_nationkey > 20) AS some, sum(CAST(n_nationkey > 9 AS INTEGER)) % 2 = 1 AS odd,
    CAST(count(*) AS DOUBLE) AS rows_, CAST(0 AS DOUBLE) AS blank FROM nation GROUP BY 1""")
def measures_of_text(spark, d):
    return _t(spark, d, "nation", "n_nationkey").measures({"joined": '=TEXTJOIN("/",TRUE,[n_name])', "one": "=CONCAT([n_name])", "every": "=AND([n_nationkey]>3)", "some": "=OR([n_nationkey]>20)", "odd": "=XOR([n_nationkey]>9)", "rows_": "=ROWS([n_name])", "blank": "=COUNTBLANK([n_name])"}, ["n_regionkey"])


@_query("""WITH v AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem)
    SELECT l_orderkey, max(q) FILTER (WHERE r = 2) AS second, min(q) AS least_, round(avg(q), 6) AS mean, round(sum(q / pow(1.1, i)), 6) AS npv, CAST(1 + count(*) FILTER (WHERE q > 25) AS DOUBLE) AS place, median(q) AS mid FROM v GROUP BY 1""")
def order_statistics(spark, d):
    t = _t(spark, d, "lineitem", "l_linenumber", "l_partkey", "l_extendedprice")
    m = t.measures({"second": "=LARGE([l_quantity],2)", "least_": "=SMALL([l_quantity],1)", "mean": "=AVERAGE([l_quantity])", "npv": "=NPV(0.1,[l_quantity])", "place": "=1+COUNTIF([l_quantity],\">25\")", "mid": "=QUARTILE([l_quantity],2)"}, ["l_orderkey"])
    return m.withColumns({"mean": F.round("mean", 6), "npv": F.round("npv", 6)})


@_query("SELECT l_returnflag, CAST(mode(l_linenumber) AS DOUBLE) AS often, round(avg(abs(l_quantity - m)), 6) AS dev FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem WHERE l_linenumber < 3 OR l_linenumber > 3) GROUP BY 1")
def mode_avedev(spark, d):
    t = Table(spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber <> 3"), ["l_orderkey", "l_linenumber", "l_partkey"])
    return t.measures({"often": "=MODE([l_linenumber])", "dev": "=AVEDEV([l_quantity])"}, ["l_returnflag"]).withColumn("dev", F.round("dev", 6))


@_query("SELECT l_returnflag, l_quantity FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 100")
def nth_of_group(spark, d):
    return _t(spark, d, "lineitem", "l_orderkey", "l_linenumber").nth("l_quantity", 100, ["l_returnflag"])


@_query("SELECT o_orderkey, CAST(count(*) OVER (ORDER BY o_totalprice RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS upto, CAST(count(*) OVER () - count(*) OVER (ORDER BY o_totalprice RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS above, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC RANGE UNBOUNDED PRECEDING) AS DOUBLE) AS own FROM orders")
def criteria_of_the_row(spark, d):
    t = _t(spark, d, "orders", "o_orderkey").compared("upto", "COUNT", "o_totalprice", "o_totalprice", "<=")
    return t.compared("above", "COUNT", "o_totalprice", "o_totalprice", ">").compared("own", "COUNT", "o_totalprice", "o_totalprice", ">=", ["o_custkey"]).select("o_orderkey", "upto", "above", "own")


@_query("SELECT c_custkey, n_regionkey AS region FROM customer LEFT JOIN nation ON lower(n_name) = 'nation_' || c_nationkey")
def lookup_other_case(spark, d):
    customers = _t(spark, d, "customer", "c_custkey").columns({"key": '="nation_"&[c_nationkey]'})
    return customers.lookup("key", _t(spark, d, "nation", "n_nationkey"), "n_name", {"n_regionkey": "region"}).select("c_custkey", "region")


@_query("SELECT c_custkey, (SELECT min(n_nationkey) FROM nation WHERE n_name ILIKE 'nation#__' || (c_custkey % 10) ESCAPE '#') AS first FROM customer")
def lookup_by_pattern(spark, d):
    customers = _t(spark, d, "customer", "c_custkey").columns({"key": '="nation_?"&MOD([c_custkey],10)'})
    return customers.lookup_pattern("key", _t(spark, d, "nation", "n_nationkey"), "n_name", "n_nationkey", "first").select("c_custkey", "first")


@_query("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_size DESC, p_partkey) AS place FROM part")
def sorted_places(spark, d):
    return _t(spark, d, "part", "p_partkey").ordered("place", [("p_name", True), ("p_size", False)]).select("p_partkey", "place")


@_query("SELECT o_orderkey, rank() OVER (ORDER BY o_orderdate DESC) AS place FROM orders")
def rank_of_dates(spark, d):
    return _t(spark, d, "orders", "o_orderkey").rank("place", "o_orderdate").select("o_orderkey", "place")


def _lines(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    return spark.read.parquet(f"{d}/lineitem.parquet").withColumn("i", F.row_number().over(w) - 1)


@_query("""SELECT CAST(l_orderkey AS VARCHAR) AS book, CAST(i AS INTEGER) AS "row", round(l_quantity * (1 + l_tax), 6) AS gross, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS upto, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share,
    CAST(i + 1 AS DOUBLE) AS at FROM (SELECT l_orderkey, l_quantity, l_tax, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS i FROM lineitem)""")
def workbooks(spark, d):
    """Each order as a workbook: its lines in rows, formulas filled down."""
    from .sources.cells import evaluated, laid_out, spread

    cells = laid_out(_lines(spark, d), "l_orderkey", "i", ["l_quantity", "l_tax"], formulas={"gross": "=A{row}*(1+B{row})", "upto": "=SUM($A$1:A{row})", "share": "=A{row}/SUM(A$1:A$999)", "at": "=ROW()"})
    got = spread(evaluated(cells), {2: "gross", 3: "upto", 4: "share", 5: "at"})
    return got.select("book", "row", *[F.round(c, 6).alias(c) for c in ("gross", "upto", "share")], "at")


@_query("""SELECT CAST(n_regionkey AS VARCHAR) AS book, CAST(count(*) AS DOUBLE) AS sheets_rows, CAST(max(n_nationkey) AS DOUBLE) AS last, CAST(min(n_nationkey) * 2 AS DOUBLE) AS twice, CAST(sum(n_nationkey) AS DOUBLE) AS spilled FROM nation GROUP BY 1""")
def workbook_references(spark, d):
    """References that only a sheet has: OFFSET, INDIRECT, ranges, spilled arrays."""
    from pyspark.sql import Window

    from .sources.cells import evaluated, laid_out, spread

    nations = spark.read.parquet(f"{d}/nation.parquet").withColumn("i", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    cells = laid_out(nations, "n_regionkey", "i", ["n_nationkey"])
    heads = nations.select(F.col("n_regionkey").cast("string").alias("book")).distinct()
    made = {4: "=COUNT(A1:A99)", 5: '=INDIRECT("A"&E1)', 6: "=OFFSET(E1,0,-4)*2", 7: "=SUM(C1:C99)", 2: "=A1:A5+0"}
    more = heads.select("book", F.lit("Sheet1").alias("sheet"), F.lit(0).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(f).alias("content")) for c, f in made.items()])).alias("c")).select("book", "sheet", "row", "c.column", "c.content")
    got = spread(evaluated(cells.unionByName(more)), {4: "sheets_rows", 5: "last", 6: "twice", 7: "spilled"}).where("row = 0")
    return got.select("book", "sheets_rows", "last", "twice", "spilled")


@_query("SELECT " + ", ".join(f"CAST(sum(range * {k + 1} % 97) AS DOUBLE) AS c{k}" for k in range(100)) + " FROM range(1000)")
def column_sums(spark, d):
    """A hundred columns of a thousand values, each with its SUM."""
    sheet = spark.range(1000).select(*[(F.col("id") * (k + 1) % 97).cast("double").alias(f"c{k}") for k in range(100)])
    return Table(sheet).measures({f"c{k}": f"=SUM([c{k}])" for k in range(100)})


@_query("SELECT range AS place, CAST(range + 1 AS DOUBLE) AS value FROM range(50000)")
def chain_of_cells(spark, d):
    """Fifty thousand cells, each one more than the cell above: the recurrence as
    a sum over an expanding range."""
    return Table(spark.range(50_000).select(F.col("id").alias("place"), F.lit(1.0).alias("step")), ["place"]).running("value", "step", "place").select("place", "value")


@_query("SELECT 'ATAN2' AS name, 2 AS least, 2 AS most, 'scalar' AS mode, false AS volatile, true AS expression UNION ALL SELECT 'OFFSET', 3, 5, 'lazy', true, false UNION ALL SELECT 'SUMIFS', 3, 255, 'range', false, false")
def function_catalogue(spark, d):
    from .functions.catalogue import catalogue_table

    return catalogue_table(spark).where(F.col("name").isin("ATAN2", "OFFSET", "SUMIFS"))
