import math

import fixtures as X
import pytest

from treeloom import schema as S
from treeloom.plans.grammar import Compiler
from treeloom.plans.query import Variables, XPath, XPathError, select_nodes, sort
from treeloom.sources.shred import shred


@pytest.fixture(scope="module")
def forest(spark):
    """One node table with a document for each text of the fixtures, and the text's number."""
    texts = sorted({c[0] for cases in (X.NODE_SETS, X.NUMBERS, X.STRINGS, X.TRUTHS) for c in cases})
    number = {t: k for k, t in enumerate(texts)}
    nodes = shred(spark.createDataFrame([(k, t) for t, k in number.items()], "doc_id long, xml string"), flags=S.FULL).cache()
    nodes.count()
    return nodes, number


def _grouped(cases):
    """Cases by query: each query runs once, over all its documents."""
    by: dict = {}
    for doc, context, query, expected in cases:
        by.setdefault(query, []).append((doc, context, expected))
    return by


def _contexts(spark, number, group):
    return spark.createDataFrame([(number[d], c) for d, c, _ in group], "doc_id long, pre int")


def _run(spark, forest, cases, method):
    nodes, number = forest
    wrong = []
    parts = []
    for query, group in _grouped(cases).items():
        parts.append((query, group, getattr(XPath(query), method)(nodes, _contexts(spark, number, group))))
    for query, group, df in parts:
        got = {(r["doc_id"], r["context"]): r["value"] for r in df.collect()}
        for doc, context, expected in group:
            value = got[number[doc], context]
            same = value == expected or (isinstance(expected, float) and math.isnan(expected) and math.isnan(value)) or (isinstance(expected, float) and math.isclose(value, expected, rel_tol=1e-15))
            if not same:
                wrong.append((doc, context, query, expected, value))
    assert not wrong


def test_node_sets(spark, forest):
    nodes, number = forest
    wrong = []
    for query, group in _grouped(X.NODE_SETS).items():
        rows = XPath(query).evaluate_nodes(nodes, _contexts(spark, number, group)).select("doc_id", "context", "pre").collect()
        for doc, context, expected in group:
            got = sorted(r["pre"] for r in rows if (r["doc_id"], r["context"]) == (number[doc], context))
            if got != expected:
                wrong.append((doc, context, query, expected, got))
    assert not wrong


def test_numbers(spark, forest):
    _run(spark, forest, X.NUMBERS, "evaluate_number")


def test_strings(spark, forest):
    _run(spark, forest, X.STRINGS, "evaluate_string")


def test_truths(spark, forest):
    _run(spark, forest, X.TRUTHS, "evaluate_boolean")


@pytest.mark.parametrize("query", X.BAD_QUERIES)
def test_rejected(query):
    with pytest.raises(XPathError):
        Compiler(query).run()


def test_whole_documents_need_no_join(spark, forest):
    nodes, number = forest
    found = select_nodes(nodes, "//fern")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert sorted((r["doc_id"], r["pre"]) for r in found.where(f"doc_id = {number[X.GARDEN]}").collect()) == [(number[X.GARDEN], 6), (number[X.GARDEN], 10)]


def test_variables(spark, forest):
    nodes, number = forest
    own = f"doc_id = {number[X.GARDEN]}"
    v = Variables(index=2)
    query = XPath("garden/bed[$index]", v)
    assert [r["pre"] for r in query.evaluate_nodes(nodes).where(own).collect()] == [8]
    assert v.set("index", 1) and not v.set("index", "a") and v.find("index") == "number"
    assert [r["pre"] for r in query.evaluate_nodes(nodes).where(own).collect()] == [3]
    assert v.get("index", "string") == "" and v.get("missing") is None
    v.set("set", spark.createDataFrame([(number[X.GARDEN], 10), (number[X.GARDEN], 11)], "doc_id long, pre int"))
    assert [r["value"] for r in XPath("count($set/..)", v).evaluate_number(nodes).where(own).collect()] == [1.0]
    with pytest.raises(XPathError):
        XPath("$other", v)


def test_results(spark, forest):
    nodes, number = forest
    own = f"doc_id = {number[X.GARDEN]}"
    with pytest.raises(XPathError):
        XPath("1 + 1").evaluate_nodes(nodes)
    row = XPath("name(/*)").evaluate_string(nodes, capacity=4).where(own).first()
    assert (row["value"], row["full_size"]) == ("gar", 7)
    assert XPath("//a | b").return_type == "nodes" and XPath("1 = 2").return_type == "boolean"
    back = sort(select_nodes(nodes, "//*").where(own), reverse=True).collect()
    assert [r["pre"] for r in back] == [13, 12, 11, 10, 8, 7, 6, 5, 3, 1]
    one = XPath("//fern").evaluate_node(nodes).where(own).collect()
    assert [r["pre"] for r in one] == [6]
