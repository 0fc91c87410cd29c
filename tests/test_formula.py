"""Parsing, serialising, and values of formulas without and with Spark."""

import math

import pytest

from gridloom.operators.table import Table
from gridloom.plans.formula import FormulaError, parse, serialise

CASES = {
    "=-2^2": 4.0, "=2^3^2": 64.0, "=1+2*3": 7.0, "=50%+1": 1.5, "=1/0": "#DIV/0!", "=\"5\"+1": 6.0, "=\"x\"+1": "#VALUE!", "=TRUE+1": 2.0, "=1&2": "12", "=1=\"1\"": False, "=\"a\"=\"A\"": True, "=0.5&\"\"": "0.5",
    "=IFERROR(1/0,7)": 7.0, "=IFNA(NA(),1)": 1.0, "=IF(1>2,1)": False, "=NOPE(1)": "#NAME?", "=ABS(1,2)": "#N/A", "=SQRT(-16)": "#NUM!", "=MOD(-3,2)": 1.0, "=ROUND(8.25,1)": 8.3, "=ROUND(-8.25,1)": -8.3, "=CEILING(7,0)": 0.0, "=FLOOR(7,0)": "#DIV/0!",
    "=ROMAN(1994)": "MCMXCIV", "=ARABIC(\"MCMXCIV\")": 1994.0, "=BASE(255,16,4)": "00FF", "=DECIMAL(\"ff\",16)": 255.0, "=GCD(12,18)": 6.0, "=LCM(14,21)": 42.0, "=FACT(7)": 5040.0, "=COMBIN(5,2)": 10.0, "=PERMUT(9,3)": 504.0, "=BITXOR(44,21)": 57.0, "=EVEN(-13.2)": -14.0, "=ODD(16.5)": 17.0,
    "=LEFT(\"abc\",2)": "ab", "=MID(\"abcd\",2,2)": "bc", "=FIND(\"ow\",\"yellow\")": 5.0, "=FIND(\"Y\",\"yellow\")": "#VALUE!", "=SEARCH(\"B?\",\"abc\")": 2.0, "=PROPER(\"two words\")": "Two Words", "=TRIM(\"  a   b \")": "a b", "=SUBSTITUTE(\"a-b-c\",\"-\",\"+\",2)": "a-b+c",
    "=TEXTBEFORE(\"a,b,c\",\",\",2)": "a,b", "=TEXTAFTER(\"a,b,c\",\",\",-1)": "c", "=TEXTJOIN(\"-\",TRUE,\"a\",\"\",\"b\")": "a-b", "=FIXED(87654.321,1)": "87,654.3", "=DOLLAR(-5)": "($5.00)", "=REPT(\"ab\",2)": "abab", "=VALUE(\" 12.5% \")": 0.125, "=CHAR(103)": "g",
    "=DATE(2008,1,1)": 39448.0, "=DATE(1900,2,29)": 60.0, "=YEAR(42000.9)": 2014.0, "=DAY(60)": 28.0, "=WEEKDAY(1)": 1.0, "=EOMONTH(39448,1)": 39507.0, "=NETWORKDAYS(39448,39478)": 23.0, "=WORKDAY(39448,10)": 39462.0, "=DATEDIF(39448,39813,\"M\")": 11.0, "=HOUR(7.3)": 7.0,
    "=ROUND(PMT(0.01,12,1000),4)": -88.8488, "=SLN(1000,100,9)": 100.0, "=ROUND(DB(1000,100,5,1),2)": 369.0, "=ROUND(DDB(1000,100,5,2),2)": 240.0, "=NPER(0,-10,100)": 10.0, "=NPV(0.1,110,121)": 200.0, "=NPV(-1,1)": "#DIV/0!", "=UNICHAR(1046)": "Ж", "=UNICHAR(128512)": "\U0001F600", "=UNICHAR(0)": "#VALUE!",
    "=ISNUMBER(1/0)": False, "=ISERR(NA())": False, "=ERROR.TYPE(1/0)": 2.0, "=TYPE(1/0)": 16.0, "=SWITCH(2,1,\"a\",2,\"b\")": "b", "=CHOOSE(3,1,2)": "#VALUE!", "=AND(FALSE,1/0)": "#DIV/0!", "=IFS(FALSE,1)": "#N/A", "=XOR(TRUE,FALSE,TRUE,TRUE)": True,
}


@pytest.mark.parametrize("text", ["=1+2*3", "=(1+2)*3", "=-2^2", "=-(2^2)", "=SUM($A$1:B2,Sheet2!C3)", "='My sheet'!A1%", "={1,2;3,4}", '=IF([a]>1,"x""y",)', "=A1:B2 B1:C3", "=1-(2-3)", "=#N/A"])
def test_round_trip(text):
    tree = parse(text)
    assert parse(serialise(tree)) == tree


@pytest.mark.parametrize("text", ["=", "=1+", "=(1", "=1 2", "={1,2;3}", "=A1:Sheet2!B2", "=F(1"])
def test_no_formula(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_values(spark):
    names = {f"f{i}": text for i, text in enumerate(CASES)}
    got = Table(spark.range(1)).columns(names, errors=True).df.first()
    wrong = []
    for i, (text, want) in enumerate(CASES.items()):
        value = got[f"f{i}_error"] or got[f"f{i}"]
        same = math.isclose(value, want, rel_tol=1e-9) if isinstance(want, float) and isinstance(value, (int, float)) and value is not None else (value or False) == want
        if not same:
            wrong.append((text, value, want))
    assert not wrong


def test_measures_of_nothing(spark):
    t = Table(spark.createDataFrame([(None, None), (1.0, "a")], "x double, s string"))
    row = t.measures({"n": "=COUNT([x])", "a": "=COUNTA([s])", "b": "=COUNTBLANK([s])", "w": '=COUNTIF([s],"A*")', "avg": '=AVERAGEIFS([x],[s],"z")', "total": "=SUM([x])*2+SUM([s])"}).first()
    assert row.asDict() == {"n": 1.0, "a": 1.0, "b": 1.0, "w": 1.0, "avg": None, "total": 2.0}


def test_mode_and_avedev_of_large_groups(spark):
    """The kernel's results, without a group's cells in one place."""
    from pyspark.sql import functions as F

    rows = [("a", 1, 4.0, 1.0, None), ("a", 2, 1.0, 2.0, "1"), ("a", 3, 1.0, None, "x"), ("a", 4, 4.0, 7.0, "y"), (None, 1, 3.0, 3.0, "z"), (None, 2, 5.0, None, None), ("b", 1, None, None, None), ("c", 1, 2.0, 9.0, "")]
    t = Table(spark.createDataFrame(rows, "g string, i int, x double, y double, s string"), ["i"])
    formulas = {"m": "=MODE([x])", "two": "=MODE([y],[x],{9,7})+1", "fixed": "=MODE(2,[x],7)", "none": "=MODE([s])", "d": "=AVEDEV([x])", "e": "=AVEDEV([x],[y],10)", "f": "=AVEDEV([s])"}
    got = {r["g"]: r.asDict() for r in t.measures(formulas, ["g"], errors=True).collect()}
    assert [got[g]["m"] for g in ("a", None, "b", "c")] == [1.0, None, None, None] and got["b"]["m_error"] == got["a"]["none_error"] == "#N/A"
    assert [got[g]["two"] for g in ("a", None, "b", "c")] == [2.0, 4.0, None, 10.0] and [got[g]["fixed"] for g in ("a", "c")] == [1.0, 2.0]
    assert [got[g]["d"] for g in ("a", None, "b", "c")] == [1.5, 1.0, None, 0.0] and got["b"]["d_error"] == got["a"]["f_error"] == "#NUM!"
    assert math.isclose(got["a"]["e"], sum(abs(x - 3.75) for x in (4, 1, 1, 4, 1, 2, 7, 10)) / 8) and got["b"]["e"] == 0.0
    whole = Table(t.df.where("false"), ["i"]).measures({"m": "=MODE([x],5,5)", "n": "=MODE([x])", "d": "=AVEDEV([x],1,3)", "e": "=AVEDEV([x])"}, errors=True).first()
    assert (whole["m"], whole["n_error"], whole["d"], whole["e_error"]) == (5.0, "#N/A", 1.0, "#NUM!")
    many = Table(spark.range(300_000).select("id", F.when(F.col("id") % 5 < 2, 7.0).otherwise(F.col("id").cast("double")).alias("x")), ["id"])
    plan = many.measures({"m": "=MODE([x])", "d": "=AVEDEV([x])"})._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "collect_list" not in plan
    row = many.measures({"m": "=MODE([x])", "d": "=AVEDEV([x])"}).first()
    xs = [7.0 if i % 5 < 2 else float(i) for i in range(300_000)]
    mean = sum(xs) / len(xs)
    assert row["m"] == 7.0 and math.isclose(row["d"], sum(abs(x - mean) for x in xs) / len(xs), rel_tol=1e-9)
