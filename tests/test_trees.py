import fixtures as X
import pytest
from pyspark.sql import functions as F

from treeloom import schema as S
from treeloom.operators import edit, navigate, serialize, typed
from treeloom.plans.query import select_nodes
from treeloom.sources.shred import documents, read_files, read_table, shred, write_table
from treeloom.streaming import ingest

RAW = serialize.RAW | serialize.NO_DECLARATION


def tree(spark, *texts, flags=S.DEFAULT):
    return shred(spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string"), flags=flags).cache()


def raw(nodes, flags=RAW):
    return [r["xml"] for r in serialize.save(nodes, flags=flags).orderBy("doc_id").collect()]


def at(spark, *pre):
    return spark.createDataFrame([(0, p) for p in pre], "doc_id long, pre int")


def test_save(spark):
    texts = [
        "<hut door='oak'><roof>reed</roof></hut>", "<hut><roof><beam/>reed</roof><!--old--></hut>", "<hut sign='&quot;in &lt; out&quot;&#10;&#9;'>wind &amp; rain &lt; &#7;</hut>",
        "<hut><![CDATA[a]]]]><![CDATA[>b]]></hut>", "<hut><!--empty--><?sweep twice?><bed/></hut>",
    ]
    nodes = tree(spark, *texts, flags=S.FULL)
    assert raw(nodes) == [
        '<hut door="oak"><roof>reed</roof></hut>', "<hut><roof><beam />reed</roof><!--old--></hut>", '<hut sign="&quot;in &lt; out&quot;&#10;\t">wind &amp; rain &lt; &#07;</hut>',
        "<hut><![CDATA[a]]]]><![CDATA[>b]]></hut>", "<hut><!--empty--><?sweep twice?><bed /></hut>",
    ]
    assert raw(nodes.where("doc_id = 2"), RAW | serialize.NO_ESCAPES) == ['<hut sign=""in < out"\n\t">wind & rain < \x07</hut>']
    indented = [r["xml"] for r in serialize.save(nodes).orderBy("doc_id").collect()]
    assert indented[1] == '<?xml version="1.0"?>\n<hut>\n\t<roof>\n\t\t<beam />\n\t\treed\n\t</roof>\n\t<!--old-->\n</hut>\n'
    part = serialize.printed(nodes.where("doc_id = 1"), spark.createDataFrame([(1, 2)], "doc_id long, pre int"), flags=serialize.RAW).first()
    assert part["xml"] == "<roof><beam />reed</roof>"
    assert serialize.encoded(spark.createDataFrame([("füße",)], "xml string"), "utf16_le").first()["xml"] == "füße".encode("utf-16-le")


def test_cdata_and_comments(spark):
    df = spark.createDataFrame([("x[y[0]]>z]]>", "up--down---")], "c string, d string").select(serialize.cdata(F.col("c")), serialize.comment(F.col("d"))).first()
    assert tuple(df) == ("<![CDATA[x[y[0]]]]><![CDATA[>z]]]]><![CDATA[>]]>", "<!--up- -down- - - -->")


def test_navigation(spark):
    nodes = tree(spark, X.GARDEN)
    pre = lambda df: sorted(r["pre"] for r in df.collect())
    assert pre(navigate.children(nodes, at(spark, 1))) == [3, 7, 8, 13] and pre(navigate.children(nodes, at(spark, 1, 3), "bed")) == [3, 8]
    assert pre(navigate.child(nodes, at(spark, 3, 8), "fern")) == [6, 10]
    assert pre(navigate.first_child(nodes, at(spark, 1))) == [3] and pre(navigate.last_child(nodes, at(spark, 1))) == [13]
    assert pre(navigate.first_attribute(nodes, at(spark, 8))) == [9] and pre(navigate.last_attribute(nodes, at(spark, 1))) == [2]
    assert pre(navigate.next_sibling(nodes, at(spark, 3))) == [7] and pre(navigate.next_sibling(nodes, at(spark, 3), "bed")) == [8]
    assert pre(navigate.previous_sibling(nodes, at(spark, 13))) == [8] and pre(navigate.previous_sibling(nodes, at(spark, 13), "path")) == [7]
    assert pre(navigate.parent(nodes, at(spark, 12, 0))) == [11] and pre(navigate.root(nodes, at(spark, 12))) == [0]
    assert pre(navigate.attribute(nodes, at(spark, 3), "no")) == [4] and pre(navigate.attributes(nodes, at(spark, 1))) == [2]
    assert pre(navigate.document_element(nodes)) == [1]
    assert pre(navigate.first_element_by_path(nodes, at(spark, 0), "garden//bed/rose")) == [5]
    assert pre(navigate.first_element_by_path(nodes, at(spark, 12), "../../fern/.")) == [10] and pre(navigate.first_element_by_path(nodes, at(spark, 12), "/garden/gate")) == [13]
    assert pre(navigate.find_node(nodes, at(spark, 0), F.col("name") == "fern")) == [6]
    assert pre(navigate.find_child_by_attribute(nodes, at(spark, 1), "no", "2")) == [8]
    assert {r["path"] for r in navigate.path(nodes, at(spark, 0, 12)).collect()} == {"", "/garden/bed/moss/spore"}
    seen = navigate.traverse(nodes, at(spark, 1), lambda: F.col("name") == "moss").orderBy("pre").collect()
    assert [(r["pre"], r["depth"]) for r in seen] == [(3, 0), (5, 1), (6, 1), (7, 0), (8, 0), (10, 1), (11, 1)]


def test_paths_of_other_kinds(spark):
    """A step is a name, of whatever kind its node is."""
    nodes = tree(spark, "<hut><?sweep twice?><sweep><dust/></sweep></hut>", flags=S.FULL)
    found = navigate.first_element_by_path(nodes, at(spark, 0), "hut/sweep").collect()
    assert [(r["pre"], r["kind"]) for r in found] == [(2, "pi")]
    assert [r["pre"] for r in navigate.first_element_by_path(nodes, at(spark, 0), "hut/sweep/dust").collect()] == [4]


def test_text(spark):
    nodes = tree(spark, "<a><b>one</b><c/>two<![CDATA[three]]></a>")
    assert [r["value"] for r in navigate.text(nodes, at(spark, 1)).collect()] == ["two"]
    assert [r["value"] for r in navigate.child_value(nodes, at(spark, 1), "b").collect()] == ["one"]
    assert [r["value"] for r in navigate.child_value(nodes, at(spark, 4)).collect()] == [""]


#: text: as int, unsigned, double and bool, 7 and true being the defaults of nothing. The limits follow from the width of the types.
READS = {
    "12": (12, 12, 12.0, True), "-3": (-3, 2**32 - 3, -3.0, False), "0042": (42, 42, 42.0, False), "0xff": (255, 255, 0.0, False), "\t6 eggs": (6, 6, 6.0, False), "2.75e1": (2, 2, 27.5, False),
    str(2**40): (2**31 - 1, 2**32 - 1, float(2**40), True), str(-(2**31)): (-(2**31), 2**31, -(2.0**31), False), "yes": (0, 0, 0.0, True), "True": (0, 0, 0.0, True), "no": (0, 0, 0.0, False), "": (0, 0, 0.0, False), None: (7, 7, 7.0, True),
}


@pytest.mark.parametrize(("text", "expected"), READS.items())
def test_typed_reads(spark, text, expected):
    v = F.col("v")
    row = spark.createDataFrame([(text,)], "v string").select(typed.as_int(v, 7), typed.as_uint(v, 7), typed.as_double(v, 7), typed.as_bool(v, True)).first()
    assert tuple(row) == expected


def test_typed_writes(spark):
    values = [0.25, 3e6, 987654321.0, 0.0002, 0.00005678, -80.125, 0.0, 400000.0]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(typed.of_double(F.col("v"))).collect()]
    assert got == ["%g" % v for v in values]


def test_edits(spark):
    nodes = tree(spark, "<a x='1'><b/>t</a>")  # a 1, x 2, b 3, t 4
    assert raw(edit.set_name(nodes, at(spark, 1, 4), "n")) == ['<n x="1"><b />t</n>']
    assert raw(edit.set_value(nodes, at(spark, 1, 2, 4), "v")) == ['<a x="v"><b />v</a>']
    assert raw(edit.insert_attribute(nodes, at(spark, 1, 4), "y", "2")) == ['<a x="1" y="2"><b />t</a>']
    assert raw(edit.insert_attribute(nodes, at(spark, 2), "y", "2", "before")) == ['<a y="2" x="1"><b />t</a>']
    assert raw(edit.insert_child(nodes, at(spark, 1), "element", "c", where="prepend")) == ['<a x="1"><c /><b />t</a>']
    assert raw(edit.insert_child(nodes, at(spark, 3), "pcdata", "", "s", "after")) == ['<a x="1"><b />st</a>']
    assert raw(edit.insert_child(nodes, at(spark, 3), "element", "c", where="before")) == ['<a x="1"><c /><b />t</a>']
    assert raw(edit.insert_child(nodes, at(spark, 1), "declaration", "xml")) == ['<a x="1"><b />t</a>']
    assert raw(edit.insert_child(nodes, at(spark, 1, 3), "element", "c")) == ['<a x="1"><b><c /></b>t<c /></a>']
    assert raw(edit.remove(nodes, at(spark, 2, 3))) == ["<a>t</a>"]
    assert raw(edit.set_text(nodes, at(spark, 3, 1), "new")) == ['<a x="1"><b>new</b>new</a>']
    pair = lambda pre, source: spark.createDataFrame([(0, pre, source)], "doc_id long, pre int, source int")
    assert raw(edit.insert_copy(nodes, pair(1, 1))) == ['<a x="1"><b />t<a x="1"><b />t</a></a>']
    assert raw(edit.insert_move(nodes, pair(3, 4))) == ['<a x="1"><b>t</b></a>']
    assert raw(edit.insert_move(nodes, pair(3, 1))) == ['<a x="1"><b />t</a>']
    assert raw(edit.insert_move(nodes, pair(3, 4), "before")) == ['<a x="1">t<b /></a>']
    moved = edit.insert_move(nodes, pair(3, 2))
    assert raw(moved) == ['<a><b x="1" />t</a>']
    assert [tuple(r) for r in moved.orderBy("pre").select("pre", "size", "level", "parent", "anc", "sval").collect()] == [(0, 4, 0, None, [], "t"), (1, 3, 1, 0, [0], "t"), (2, 1, 2, 1, [0, 1], ""), (3, 0, 3, 2, [0, 1, 2], "1"), (4, 0, 2, 1, [0, 1], "t")]
    fragments = spark.createDataFrame([(0, 3, "x<y/>"), (0, 4, "z")], "doc_id long, pre int, xml string")
    grown, states = edit.append_fragments(nodes, fragments)
    assert raw(grown) == ['<a x="1"><b>x<y /></b>t</a>']
    assert {(r["pre"], r["status"]) for r in states.collect()} == {(3, "ok"), (4, "append_invalid_root")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes("﻿<a>é</a>".encode("utf-16"))
    (tmp_path / "b.xml").write_text("<a")
    nodes, files = read_files(spark, [str(tmp_path / "a.xml"), str(tmp_path / "b.xml"), str(tmp_path / "none.xml")])
    assert {(r["path"][-5:], r["status"]) for r in files.collect()} == {("a.xml", "ok"), ("b.xml", "bad_start_element"), ("e.xml", "file_not_found")}
    assert [r["value"] for r in select_nodes(nodes, "//text()").collect()] == ["é"]
    write_table(nodes, str(tmp_path / "table"))
    assert read_table(spark, str(tmp_path / "table")).count() == nodes.count()
    states = documents(tree(spark, "<a/>", None)).orderBy("doc_id").collect()
    assert [(r["status"], r["status_code"], r["n_nodes"]) for r in states] == [("ok", 0, 2), ("io_error", 2, 1)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.xml").write_text(f"<a n='{k}'/>")
    query = ingest.write_stream(ingest.read_stream(spark, str(tmp_path / "in"), files_per_batch=2), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    found = spark.read.schema(S.NODES).parquet(*[str(p) for p in (tmp_path / "out").iterdir()])
    assert sorted(r["value"] for r in select_nodes(found, "/a/@n").collect()) == ["0", "1", "2"]
