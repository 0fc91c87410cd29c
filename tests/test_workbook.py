"""Workbooks: edits, recalculation, spills, names, sheets, export; as cells of a
table; in another language; on a stream."""

import time

import pytest
from pyspark.sql import functions as F

from gridloom.functions.catalogue import catalogue_table
from gridloom.kernel.cells import Err
from gridloom.operators.workbook import Workbook, WorkbookError, adjusted, parse_content
from gridloom.plans.formula import parse, serialise
from gridloom.plans.locale import SPANISH


@pytest.mark.parametrize(("typed", "content"), [("12.5", 12.5), ("8%", 0.08), ("true", True), ("#N/A", Err("#N/A")), ("=A1", "=A1"), ("1,5", "1,5"), ("=", "="), (None, None)])
def test_content(typed, content):
    assert parse_content(typed) == content


def test_recalculation():
    b = Workbook()
    b.set_many({"A1": 4, "A2": "=A1*2", "B1": "=SUM(A1:A2)", "C1": "unrelated"})
    assert b.value("B1") == 12.0
    assert set(b.set("A1", 5)) == {("Sheet1", 0, 0), ("Sheet1", 1, 0), ("Sheet1", 0, 1)}
    assert b.value("B1") == 15.0 and b.formula_at("A2") == "=A1*2" and b.formula_at("A1") is None
    assert b.set("A1", 5) == {}
    b.set("A1", None)
    assert b.value("A1") is None and b.value("B1") == 0.0


def test_cycles():
    b = Workbook()
    b.set_many({"A1": "=B1", "B1": "=A1+1", "C1": "=A1", "D1": "=D1", "E1": "=IFERROR(A1,3)"})
    assert [b.value(c).code for c in ("A1", "B1", "C1", "D1")] == ["#CIRCULAR!"] * 4 and b.value("E1") == 3.0
    b.set("B1", 7)
    assert b.value("A1") == b.value("C1") == 7.0


def test_spill():
    b = Workbook()
    b.set_many({"A1": "=SEQUENCE(2,2)", "D1": "=SUM(A1:B2)"})
    assert [b.value(c) for c in ("A1", "B1", "A2", "B2", "D1")] == [1.0, 2.0, 3.0, 4.0, 10.0]
    b.set("B2", "in the way")
    assert b.value("A1") == Err("#SPILL!") and b.value("A2") is None and b.value("B2") == "in the way"
    b.set("B2", None)
    assert b.value("B2") == 4.0 and b.value("D1") == 10.0
    b.set("A1", 1)
    assert b.value("B2") is None and b.value("D1") == 1.0


def test_undo_and_batch():
    b = Workbook()
    b.batch(lambda w: [w.set(f"A{i}", i) for i in range(1, 4)])
    b.set("A1", 9)
    b.undo()
    assert b.value("A1") == 1.0 and b.can_undo() and b.can_redo()
    b.undo()
    assert b.value("A3") is None and not b.can_undo()
    b.redo()
    b.redo()
    assert b.value("A1") == 9.0 and not b.can_redo()
    with pytest.raises(WorkbookError):
        b.batch(lambda w: w.batch(lambda x: None))


def test_copy():
    b = Workbook()
    b.set_many({"B2": "=A1+$A$1+B$1", "A1": 1, "B1": 2, "C1": 3})
    b.copy("B2", "C3")
    assert b.formula_at("C3") == "=B2+$A$1+C$1" and b.value("C3") == 8.0
    b.copy("B2", "A1")
    assert "#REF!" in b.formula_at("A1")
    assert serialise(adjusted(parse("=SUM(A$1:B2)"), 1, 1)) == "SUM(B$1:C3)"


def test_names_and_sheets():
    b = Workbook()
    b.set("A1", "=fee*2")
    assert b.value("A1") == Err("#NAME?")
    b.define("fee", 4)
    assert b.value("A1") == 8.0
    other = b.add_sheet()
    b.set_many({"Sheet2!A1": 6, "B1": "=Sheet2!A1", "C1": "=SHEETS()"})
    b.define("fee", "=Sheet2!A1+1")
    assert (other, b.value("A1"), b.value("B1"), b.value("C1")) == ("Sheet2", 14.0, 6.0, 2.0)
    b.set("Sheet2!A1", 9)
    assert b.value("A1") == 20.0
    again = Workbook.from_json(b.to_json())
    assert again.values == b.values and not again.can_undo()
    b.remove_sheet("sheet2")
    assert b.value("B1") == Err("#REF!") and b.value("C1") == 1.0
    for name in ("A1", "TRUE", "2x"):
        with pytest.raises(WorkbookError):
            b.define(name, 1)
    with pytest.raises(WorkbookError):
        b.add_sheet("SHEET1")


def test_long_chain():
    b = Workbook()
    b.set_many({("Sheet1", 0, 0): 1.0, **{("Sheet1", i, 0): f"=A{i}+1" for i in range(1, 3000)}})
    b.set("A1", 11)
    assert b.value("A3000") == 3010.0


def test_spanish():
    assert SPANISH.canonical('=SI(A1>1,5;"a;b";SUMA({1\\2;3\\4}))') == '=IF(A1>1.5,"a;b",SUM({1,2;3,4}))'
    tree = parse('=IF(TRUE,#N/A,(1.5+2)*NORM.DIST(A1,0,1,FALSE))')
    local = SPANISH.serialise(tree)
    assert local == "SI(VERDADERO;#N/D;(1,5+2)*DISTR.NORM.N(A1;0;1;FALSO))"
    assert SPANISH.parse(local) == tree and SPANISH.parse("=SUM(1;2)") == parse("=SUM(1,2)")


def test_cells_of_tables(spark, tmp_path):
    from gridloom.sources.cells import evaluated, laid_out, parsed, read_books, written

    df = spark.createDataFrame([("b1", 0, 2.0, "x"), ("b1", 1, 3.0, None), ("b2", 0, 5.0, "y")], "book string, i int, q double, s string")
    cells = laid_out(df, "book", "i", ["q", "s"], formulas={"t": "=A{row}*10", "u": "=COUNTA(B1:B9)"})
    got = {(r["book"], r["row"], r["column"]): (r["kind"], r["n"], r["s"], r["is_formula"]) for r in evaluated(cells).collect()}
    assert got[("b1", 1, 2)] == ("number", 30.0, None, True) and got[("b1", 0, 3)][1] == 1.0 and got[("b2", 0, 1)] == ("text", None, "y", False)
    written(cells, str(tmp_path / "books"))
    back = read_books(spark, str(tmp_path / "books"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    kinds = spark.createDataFrame([("12",), ("=A1",), ("true",), ("a b",), ("5%",), ("",)], "c string").select(parsed(F.col("c")).alias("p")).select("p.*").collect()
    assert [(r["kind"], r["n"], r["b"]) for r in kinds] == [("number", 12.0, None), ("formula", None, None), ("logical", None, True), ("text", None, None), ("number", 0.05, None), ("empty", None, None)]


def test_catalogue(spark):
    table = catalogue_table(spark)
    assert table.count() == 212 and table.where("volatile").count() == 6


def test_stream(spark, tmp_path):
    from gridloom.streaming.formulas import columns, windowed

    source = tmp_path / "in"
    spark.createDataFrame([(f"2024-01-01 00:0{i}:00", float(i)) for i in range(6)], "at string, x double").selectExpr("cast(at as timestamp) as at", "x").write.parquet(str(source))
    stream = spark.readStream.schema("at timestamp, x double").parquet(str(source))
    made = windowed(columns(stream, {"y": "=[x]*2"}), "at", "3 minutes", {"total": "=SUM([y],1)", "n": "=COUNT([y])"})
    query = made.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    end = time.time() + 60
    while query.isActive and time.time() < end:
        time.sleep(0.2)
    assert sorted((r["total"], r["n"]) for r in spark.table("windows").collect()) == [(7.0, 3.0), (25.0, 3.0)]


def test_workbooks_of_one_layout(spark):
    """Evaluated together, to the last bit as each by itself; odd ones among them."""
    import random

    from gridloom.sources.cells import evaluated

    draw = random.Random(4)
    layouts = [
        ["=A1*(1+B1)", "=SUM($A$1:A2)", "=A1/SUM(A$1:A$99)", "=ROW()+COLUMN()", "=-C1%", "=H1-A2", "=AVERAGE(A1:B3,C1)"],
        ["=MAX(A1:B9)-MIN(A1:B9)", "=COUNT(A1:C9)/7", "=C1+Z9", "=SUM(Y1:Z9)", "=+sheet1!A1", "=1/B1", "=C1+D1+E1"],
        ["=C2", "=IF(A1>B1,A1,\"less\")", "=A1:A2", "=NOPE(1)", "=A1&B1", "=1+", "=AVERAGE(Z1:Z3)"],
    ]
    rows = []
    for k in range(90):
        formulas = layouts[k % 3]
        for r in range(2 + k % 2):
            rows += [(f"b{k}", "Sheet1", r, c, str(draw.choice([draw.uniform(-9, 9), draw.randint(-3, 3), 1e300 if k % 10 == 0 else 0.1]))) for c in range(2)]
        rows += [(f"b{k}", "Sheet1", 0, c + 2, f) for c, f in enumerate(formulas[:3])] + [(f"b{k}", "Sheet1", 1, c + 2, f) for c, f in enumerate(formulas[3:])]
    rows += [("b3", "Sheet1", 9, 9, "text"), ("b4", "Other", 0, 0, "5%"), (None, "Sheet1", 0, 0, "2"), (None, "Sheet1", 0, 1, "=A1*2"), ("b6", "Sheet1", 8, 8, "")]
    want = {}
    for name in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == name]
        book = Workbook(sorted({r[0] for r in own}))
        book.set_many({(s, r, c): x for s, r, c, x in own})
        want |= {(name, *k): (x.code if isinstance(x, Err) else x, book.formula(*k) is not None) for k, x in book.values.items()}
    cells = spark.createDataFrame(rows, "book string, sheet string, row int, column int, content string")
    got = {(r["book"], r["sheet"], r["row"], r["column"]): (r["n"] if r["kind"] == "number" else r["b"] if r["kind"] == "logical" else r["s"], r["is_formula"]) for r in evaluated(cells).collect()}
    assert got == want and any(x == "#DIV/0!" for x, _ in want.values()) and any(x == "#CIRCULAR!" or x == "less" for x, _ in want.values())


def test_layout_plans():
    from gridloom.sources.layouts import Plan, Unsupported

    at = [("Sheet1", 0, c) for c in range(3)]
    Plan(at, [None, "=A1+1", "=SUM(A1:B1)"], {})
    for formulas in ([None, "=C1", "=B1"], [None, "=B1", None], [None, "=A1^2", None], [None, "=A1:A2", None], [None, "=(", None]):
        with pytest.raises(Unsupported):
            Plan(at, formulas, {})
    with pytest.raises(Unsupported):
        Plan(at, [None, "=SUM(A1)", None], {"SUM": len})


def test_many_small_workbooks_take_seconds(spark):
    from gridloom.sources.cells import evaluated, laid_out

    lines = spark.range(160_000).selectExpr("id div 4 book", "id % 4 line", "cast(id % 50 as double) a", "0.25D b")
    cells = laid_out(lines, "book", "line", ["a", "b"], formulas={"gross": "=A{row}*(1+B{row})", "upto": "=SUM($A$1:A{row})", "share": "=A{row}/SUM(A$1:A$999)"})
    evaluated(cells.where("book = '1'")).count()
    began = time.time()
    assert evaluated(cells).selectExpr("count(*) n", "sum(case when column = 2 then n end) s").first() == (800_000, 160_000 * 24.5 * 1.25)
    assert time.time() - began < 40
