"""Whole batches at once against the parser, and what Python writes against what Spark reads."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_growth import MARKS, plain_rows

from treeloom import files, publish, tables
from treeloom import schema as S
from treeloom.sources import columns, parser, plain, shred

TAGS = ["<a>", "</a>", '<b x="1">', "</b>", '<c y="2" z="a &gt; b"/>', '<c y="<>\'" y.z="" y="="/>', "text", " t u ", " ", "<d/>", "<d></d>"]
ODD = ["", "x", "<a>", "<a>'</a>", '<a>"x="y"</a>', '<a b="1" ></a>', "<a b='1'/>", "<a></b>", "<a/><b/>", "<a/>t", "<a>é</a>", '<a b="1"c="2"/>', '<a ="1"/>', '<1a/>', "<a/ >", "<>", "</>", '<a "b"/>', '<a b"1"/>', '<a  b="1"/>', "<a>></a>", "<!--x--><a/>", "<?p q?><a/>", "<a><![CDATA[x]]></a>", '<a b="1"/', '<a b="1', "﻿<a/>", "<a>\n</a>", "</a><a>", '<a>b="<c>"</a>', '<a b="x"></a b="y">', "<a/b/>", "<a b=\"1\"/c=\"2\"/>"]


def found(texts, flags=S.DEFAULT):
    parsed = []

    def slowly(keys, some):
        parsed.extend(keys.to_pylist())
        trees = (parser.Tree(status="io_error") if t is None else parser.parse(t.removeprefix("﻿"), flags) for t in some.to_pylist())
        return parser.batches((k, "utf8", tree) for k, tree in zip(keys.to_pylist(), trees, strict=True))

    out = [tuple(r.values()) for b in shred._nodes(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), slowly) for r in b.to_pylist()]
    return out, parsed


@pytest.mark.parametrize("flags", [S.DEFAULT, S.FULL, S.MINIMAL, S.DEFAULT | S.WS_PCDATA, S.DEFAULT | S.FRAGMENT])
def test_plain_documents(flags):
    chosen = random.Random(5)

    def element(depth):
        inside = "".join(element(depth + 1) if chosen.random() < 0.6 else chosen.choice(["text", " t u ", ""]) for _ in range(chosen.randrange(4))) if depth < 4 else ""
        attributes = "".join(f' {chosen.choice("xyz")}="{chosen.choice(["", "1", "a b", "<>", chr(39) + "="])}"' for _ in range(chosen.randrange(4)))
        name = chosen.choice(["a", "b:c", "_d.e-1"])
        return f"<{name}{attributes}/>" if not inside and chosen.random() < 0.5 else f"<{name}{attributes}>{inside}</{name}>"

    texts = [element(0) for _ in range(300)]
    rows, parsed = found(texts, flags)
    assert rows == [r for k, t in enumerate(texts) for r in plain_rows(parser.parse(t, flags), k)] and not parsed


def test_documents_that_are_not_plain():
    chosen = random.Random(6)
    mixed = ["".join(chosen.choices(marks, k=chosen.randrange(1, 12))) for marks in (TAGS, MARKS) for _ in range(1500)]
    for texts in ([t] for t in [*ODD, *mixed]):
        rows, _ = found(texts)
        assert rows == plain_rows(parser.parse(texts[0].removeprefix("﻿")), 0), texts
    texts = ["<a x=\"1\">t</a>"] * 200
    texts[70], texts[71], texts[190] = ODD[7], ODD[3], "<e>"
    rows, parsed = found(texts)
    assert rows == [r for k, t in enumerate(texts) for r in plain_rows(parser.parse(t), k)] and set(parsed) <= {70, 71, 190}


def test_parents_at_once():
    for level in ([0], [0, 1, 2, 2, 1, 0, 1], [0, 1, 2, 3, 3, 1, 2, 0, 0]):
        assert columns.above(np.array(level)).tolist() == columns.parents(level, [x == 0 for x in level])[1]


@pytest.mark.parametrize("length", [1, 2, 5, 100])
def test_orders_across_batches(length):
    rows = [(0, True, "lost"), (1, False, "<o>"), (1, True, "<i/>"), (1, True, None), (2, False, None), (2, True, "<i/>"), (3, False, "<o>"), (4, True, "lost"), (5, False, "<p>"), (5, False, "<o>"), (5, True, "<i/>")]
    batches = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.string()), strict=True)], ["doc_id", "is_item", "text"]).to_batches(length)
    made = [tuple(r.values()) for b in publish._whole(iter(batches)) for r in b.to_pylist()]
    assert made == [(1, "<o><i/></order>"), (2, None), (3, "<o></order>"), (5, "<p></order>"), (5, "<o><i/></order>")]
    assert [b.num_rows for b in publish._whole(iter([]))] == [0]


def test_python_writes_buckets(spark):
    """The buckets are Spark's, wherever the rows come from, and nodes don't go through the JVM on their way to the table."""
    keys = [0, 1, -1, 2**40 + 7, -(2**62), *range(100, 200)]
    docs = spark.createDataFrame([(k, f"<a n='{k}'/>") for k in keys], "doc_id long, xml string")
    assert [r[0] for r in docs.select(F.pmod(F.hash("doc_id"), F.lit(7))).collect()] == files.buckets(np.array(keys), 7).tolist()
    nodes = tables.dealt(shred.shred(docs.repartition(5)), "treeloom_test_of_buckets")  # not dealt by document
    assert sorted(int(r["value"]) for r in nodes.where("kind = 'attribute'").collect()) == sorted(keys)
    assert nodes.schema == S.NODES
    own = nodes.select("doc_id", F.pmod(F.hash("doc_id"), F.lit(tables.partitions(spark))).alias("bucket"), F.regexp_extract(F.input_file_name(), r"_(\d+)\.c000", 1).cast("int").alias("of"))
    assert own.where("bucket <> of").isEmpty()
    assert nodes.join(nodes.select("doc_id").hint("merge"), "doc_id")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    made = publish.orders_xml(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem")))
    assert shred.shred(made)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
