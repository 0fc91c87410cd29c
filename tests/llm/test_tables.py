"""Operators against brute force on a table, and their defined results for odd rows."""

import importlib
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import components, decontam, html, jaccard, langid, pieces, pq, quality, tokencount, toxicity
from gridloom.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def _naive(text, trained):
    """Greedy longest matches by substring search."""
    t = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    rates = {}
    for lang, known in trained.items():
        i = n = 0
        while i < len(t):
            k = 1
            while i + k <= len(t) and t[i : i + k] in known:
                k += 1
            i, n = i + max(k - 1, 1), n + 1
        rates[lang] = n * math.log2(max(len(known), 2)) / max(len(t), 1)
    return rates


def test_language_against_a_plain_parser(spark, documents):
    trained = langid.learn(documents)
    parser = langid.Parser(trained)
    texts = [r["text"][:240] for r in documents.where("length(text) > 3").limit(120).collect()]
    for text, (lang, _) in zip(texts, parser.predict(texts)):
        if any(c.isalpha() for c in text):
            rates = _naive(text, trained)
            # a space after the last letter is parsed too
            assert rates[lang] <= min(rates.values()) * 1.05


def test_language_many_letters():
    random = np.random.default_rng(2)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    trained = {lang: "".join(random.permutation(signs)) * 3 for lang in ("a", "b")}
    parser = langid.Parser(trained)
    assert parser.table.shape[1] <= langid.DENSE + 3 and len(parser.keys)
    for lang, known in trained.items():
        assert parser.predict([known[100:200]])[0][0] == lang
    assert langid._even(["ab", "cdefgh", "ij"], 8) == "ab ij cdef"
    assert parser.predict([None, "", "12 3"]) == [("und", 0.0)] * 3


def test_counts_against_the_library(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    random = np.random.default_rng(5)
    signs = [chr(0x4E00 + i) for i in range(5000)]
    more = ["".join(random.choice(signs, 3000)), "ab" * 4000, "".join(random.choice(list("abcdefgh"), 20000)), "🙂" * 700, " " * 900 + "x", "".join(chr(c) for c in random.integers(33, 0x2FFF, 4000))]
    table = documents.select("doc_id", "text").union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    for r in tokencount.op7(table).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]])), r["doc_id"]


def test_vectors_of_many_lists(spark):
    """Recall with as many lists as the root of the rows."""
    random = np.random.default_rng(9)
    base = random.normal(size=(400, 32))
    x = np.repeat(base, 8, axis=0) + random.normal(size=(3200, 32)) * random.choice([0.1, 0.25, 0.35], size=(3200, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.arange(3200) // 8 % 5
    got = {r["vec_id"]: r["n_links"] for r in pq.op6(spark, spark.createDataFrame([(i, v.tolist(), int(label[i])) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    want = near.sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum() and want.sum() > 1000


def test_vectors_empty_and_unequal(spark):
    kind = "vec_id long, embedding array<double>, label int, n_links int"
    assert pq.op6(spark, spark.createDataFrame([], kind)).count() == 0
    rows = [(1, [1.0, 0.0], 0, 7), (2, [1.0, 0.0, 0.0], 0, 7), (3, [2.0, 0.0], 0, 7), (None, [1.0, 0.0], 0, 7)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq.op6(spark, spark.createDataFrame(rows, kind)).collect()}
    assert got[1] == (1, 1) and got[3] == (1, 1) and got[2] == (0, 2) and got[None][0] == 0


def test_components_by_stars(spark, monkeypatch):
    links = [(i, i + 1) for i in range(0, 60, 2)] + [(i, i + 2) for i in range(0, 30, 2)] + [(99, 99), (70, 3), (3, 70)]
    frame = spark.createDataFrame(links, "x long, y long")
    few = {tuple(r) for r in components.connected_components(frame, Scratch(spark, "t")).collect()}
    monkeypatch.setattr(components, "FEW", 0)
    assert few == {tuple(r) for r in components.connected_components(frame, Scratch(spark, "t")).collect()}


def test_main_text_nested_and_linked():
    for page in ("<div>x" * 20_000, "<span>" * 20_000 + "x</b>" * 20_000, "<b><div>" * 20_000 + "</b>" * 20_000):
        began = time.time()
        html.extract(page)
        assert time.time() - began < 10
    words = "<p>Words of an article, long enough to count, with commas, and so on and on.</p>"
    page = f"<body><nav><a href=1>Menu</a></nav><article>{words}<ul><li><a href=2>A source</a></li><li><a href=3>Another</a></li></ul><h2>Next</h2>{words}</article></body>"
    assert "A source" in html.extract(page) and "Next" in html.extract(page) and "Menu" not in html.extract(page)
    assert html.extract(f"<div>{words}</div>" * 2) and html.extract(None) == ""


def test_indicators_see_content():
    assert set(quality.features("cold water")) != set(quality.features("cold summer"))
    long = "abcdefghijklmnopqrst"
    assert set(toxicity.features(long + "uv")) != set(toxicity.features(long + "uw"))
    assert len(quality.features("")) == len(quality.features(None)) == 0 and quality.features("x " * 200_000).max() < quality.DIM


def test_hinge_loss():
    """The dual variables stay between 0 and C, and the margin is right."""
    from gridloom.llm.linear import dual_coordinate_descent

    rows, y = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])] * 5, np.array([1.0, -1, 1, -1] * 5)
    w, b = dual_coordinate_descent(rows, [np.ones(len(r)) for r in rows], y, 3, np.full(20, 10.0), passes=200)
    assert all(s * (w[r].sum() + b) >= 0.95 for s, r in zip(y, rows)) and abs(w[2]) < 0.1


def test_one_of_each_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text, "a"), (1, text, "b"), (2, text + " end", "c"), (None, text, "d"), (None, other, "e"), (None, other, "f"), (1, other + " x", "g"), (5, None, "h"), (5, "", "i"), (None, None, "j")]
    got = jaccard.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string, _id string"))
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["_id"] in "hij") for r in got.collect())
    assert got.columns == ["doc_id", "text", "_id"]
    assert kept == sorted([(1, text, False), (1, other + " x", False), (5, "", True), (5, "", True), (0, "", True)])


def test_leaks_without_ids(spark):
    item = " ".join(f"item{i}" for i in range(20))
    docs = spark.createDataFrame([(None, "a b c " + item), (None, "harmless words only"), (1, item), (1, "other words"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(str(r["text"]) for r in decontam.without_leaks(spark, docs, bench).collect()) == ["None", "harmless words only", "other words"]


@pytest.mark.parametrize("at", range(5))
def test_pipeline_stages_take_odd_rows(spark, at):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x" * 300_000, None, None, 3), (3, "word " * 90_000, "xx", "", 1)], docs.schema)
    name, stage = pipeline.STAGES[at]
    few = stage(spark, docs.unionByName(odd).withColumn("score", F.lit("mine")), DATA)
    assert few.count() > 0
    if at < 4:
        assert few.columns == [*docs.columns, "score"]
    assert stage(spark, docs.where("false"), DATA).count() == 0


def test_nothing_else_imports_this_package():
    for name in ("gridloom.queries", "gridloom.operators.table", "gridloom.operators.workbook", "gridloom.kernel.library"):
        assert "gridloom.llm" not in open(importlib.import_module(name).__file__).read()
