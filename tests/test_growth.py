"""What node tables and queries over them move: nothing through the driver, and nodes only once."""

import random

import duckdb
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_trees import at, raw, tree

from treeloom import publish as P
from treeloom import queries as tree_queries
from treeloom import schema as S
from treeloom import tables
from treeloom.operators import edit
from treeloom.sources import columns, parser


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dom_first_by_path", "ser_raw", "xp_lag", "xp_round", "nest_path", "nest_copy_between"])
def test_queries_broadcast_nothing(spark, name):
    assert "Broadcast" not in plan(tree_queries.queries()[name](spark, str(SF)))


EDITS = ["nest_attribute_before", "nest_attribute_after", "nest_child_before", "nest_child_cdata", "nest_copy_before", "nest_move_after", "nest_fragment", "nest_remove_text", "dom_edit_remove", "dom_edit_append", "dom_edit_move"]


@pytest.mark.parametrize("name", EDITS)
def test_edits_broadcast_nothing(spark, name, monkeypatch):
    seen, numbered = [], edit._numbered

    def looked_at(rows):
        seen.append(plan(rows))
        return numbered(rows)

    monkeypatch.setattr(edit, "_numbered", looked_at)
    seen.append(plan(tree_queries.queries()[name](spark, str(SF))))
    assert len(seen) == 2 and not [p for p in seen if "Broadcast" in p]


def test_nodes_are_written_where_they_are_parsed(spark, monkeypatch):
    made, dealt = [], tables.dealt

    def looked_at(df, name):
        made.append(plan(df))
        return dealt(df, name)

    monkeypatch.setattr(tables, "dealt", looked_at)
    docs = spark.createDataFrame([(k, f"<a n='{k}'/>") for k in range(50)], "doc_id long, xml string")
    nodes = tables.node_table(spark, "test of places", lambda: P.shred(P.spread(docs)))
    assert made[0].count("Exchange") == 1 and made[0].index("MapInArrow") < made[0].index("Exchange")
    both = nodes.where("kind = 'attribute'").join(nodes.where("kind = 'element'").select("doc_id", F.col("pre").alias("parent")).hint("merge"), ["doc_id", "parent"])
    assert "Exchange" not in plan(both) and sorted(int(r["value"]) for r in both.collect()) == list(range(50))


def test_edited_tables_move_nothing(spark):
    nodes = P.order_nodes(spark, str(SF))
    items = nodes.where("name = 'item'").select("doc_id", "pre")
    changed = edit.remove(nodes, items)
    joined = changed.select("doc_id", "pre").join(changed.select("doc_id", "parent").hint("merge"), "doc_id")
    assert "Exchange" not in plan(joined)
    assert changed.count() == nodes.where("kind = 'document' or level = 1 or (kind = 'attribute' and level = 2)").count()


def test_nested_targets(spark):
    nodes = tree(spark, "<a><b><c>x</c></b>y<b><c/></b></a>")  # a 1, b 2, c 3, x 4, y 5, b 6, c 7
    assert raw(edit.remove(nodes, at(spark, 2, 3, 4, 7))) == ["<a>y<b /></a>"]
    assert raw(edit.remove(nodes, at(spark, 0))) == raw(nodes)
    pairs = spark.createDataFrame([(0, 1, 3), (0, 6, 2)], "doc_id long, pre int, source int")
    assert raw(edit.insert_copy(nodes, pairs)) == ["<a><b><c>x</c></b>y<b><c /><b><c>x</c></b></b><c>x</c></a>"]


def plain_rows(t, doc_id):
    """The rows by their definitions, each for itself."""
    n = len(t.kind)
    anc = [[] for _ in range(n)]
    for k in range(1, n):
        anc[k] = [*anc[t.parent[k]], t.parent[k]]
    out = []
    for k in range(n):
        beside = [j for j in range(n) if k and j and t.parent[j] == t.parent[k] and (t.kind[j] == "attribute") == (t.kind[k] == "attribute")] or [k]
        below = [j for j in range(n) if k in anc[j]]
        texts = "".join(t.value[j] for j in below if t.kind[j] in ("pcdata", "cdata"))
        sval = texts if t.kind[k] in ("element", "document") else "" if t.kind[k] in ("declaration", "doctype") else t.value[k]
        dup = t.kind[k] == "attribute" and any(t.name[j] == t.name[k] for j in beside if j < k)
        head = (t.status, t.error_offset, "utf8") if not k else (None, None, None)
        out.append((doc_id, k, len(below), len(anc[k]), t.parent[k] if k else None, t.kind[k], t.name[k], t.value[k], beside.index(k) + 1, len(beside), anc[k], sval, t.offset[k], dup, *head))
    return out


MARKS = ["<a>", "</a>", '<b x="1">', "</b>", "<c y='2' y=\"3\"/>", "t&amp;u", "<!--n-->", "<![CDATA[z]]>", '<d k="v w" k="u" l=""/>', '<e f="&lt;"/>', " ", '<g h="1"i="2">', "<"]


def test_columns_of_batches():
    """Many documents to a batch, and batches within a document."""
    chosen = random.Random(3)
    trees = [parser.parse("".join(chosen.choices(MARKS, k=chosen.randrange(1, 30))), S.FULL) for _ in range(300)]
    wanted = [r for k, t in enumerate(trees) for r in plain_rows(t, k)]
    found = [tuple(r.values()) for b in parser.batches((k, "utf8", t) for k, t in enumerate(trees)) for r in b.to_pylist()]
    assert found == wanted
    deep = parser.parse("<a>" * 3000 + "<b/>" * 20_000 + "</a>" * 3000)
    rows = 0
    for b in parser.batches([(1, "utf8", deep)], string_values=False):
        assert b.num_rows <= columns.BATCH and len(b.column("anc").flatten()) <= columns.ANCESTORS
        assert all(a == list(range(p)) if p <= 3000 else a == list(range(3001)) for p, a in zip(b.column("pre").to_pylist()[::997], b.column("anc").to_pylist()[::997], strict=True))
        rows += b.num_rows
    assert rows == 23_001


@pytest.mark.parametrize("length", [1, 3, 7, 1000])
def test_numbering_across_batches(length):
    """A document may lie in several batches, and a batch in several documents."""
    trees = [parser.parse(t) for t in ("<a x='1'><b/>t<c><d/>u</c></a>", "", "<e/>", "<f><g><h>v</h></g></f>")]
    wanted = [tuple(r.values()) for b in parser.batches((k, "utf8", t) for k, t in enumerate(trees)) for r in b.to_pylist()]
    loose = pa.Table.from_pylist([dict(zip(columns.ARROW.names, r, strict=True)) for r in wanted], columns.ARROW)
    loose = loose.select(["doc_id", "level", "kind", "name", "value", "offset", "status", "error_offset", "encoding"])
    assert [tuple(r.values()) for b in columns.numbered(iter(loose.to_batches(length))) for r in b.to_pylist()] == wanted


def test_orders_are_made_by_one_move(spark):
    """An order without items, items without an order, values that are null, and all in few batches."""
    orders = spark.createDataFrame([(k, "O", 1.5) for k in range(40)] + [(40, None, 2.0)], "o_orderkey long, o_orderstatus string, o_totalprice double")
    of = spark.createDataFrame([(k, n, k) for k in (*range(1, 40), 41) for n in (2, 1)] + [(3, 3, None)], "l_orderkey long, l_linenumber long, l_partkey long")
    rest = {"l_suppkey": 5, "l_quantity": 1.0, "l_extendedprice": 2.0, "l_discount": 0.0, "l_tax": 0.0, "l_returnflag": "N", "l_linestatus": "O"}
    items = of.withColumns({k: F.lit(v) for k, v in rest.items()} | {"l_shipdate": F.lit("1996-03-13").cast("date")})
    made = P.orders_xml(orders, items)
    assert plan(made).count("Exchange") == 1
    item = lambda k, n: f'<item part="{k}" supp="5" line="{n}" qty="1.00" price="2.00" disc="0.00" flag="N" ship="1996-03-13"/>'
    wanted = {k: f'<order key="{k}" status="O" total="1.50">{item(k, 1) + item(k, 2) if k else ""}</order>' for k in range(40)} | {40: None}
    assert {r["doc_id"]: r["xml"] for r in made.collect()} == wanted and made.count() == 41
    places = made.select(F.spark_partition_id().alias("p"), F.pmod(F.hash("doc_id"), F.lit(tables.partitions(spark))).alias("bucket"))
    assert places.where("p <> bucket").isEmpty()


#: Edits that are run, one for each finding of driver memory.
RUN = ["nest_attribute_prepend", "nest_child_after", "nest_child_cdata", "nest_copy_before", "nest_child_prepend", "nest_copy_between", "nest_fragment", "nest_move_after", "nest_fragment_status", "nest_move_append", "nest_move_before", "nest_remove_attribute"]


@pytest.mark.parametrize("name", RUN)
def test_edits_run_without_broadcasts(spark, name):
    """Whatever Spark plans anew while they run: with sizes that it knows by then, and a threshold that all tables are under. The rows are those of the SQL."""
    P.customer_nodes(spark, str(SF))
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1g"}
    kept = {k: spark.conf.get(k, None) for k in settings}
    bus.waitUntilEmpty()
    before = store.executionsCount()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = tree_queries.queries()[name](spark, str(SF)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    bus.waitUntilEmpty()
    ran = store.executionsList()
    plans = [ran.apply(k).physicalPlanDescription() for k in range(before, ran.size())]
    assert any("AdaptiveSparkPlan" in p for p in plans) and not [p for p in plans if "Broadcast" in p]
    con = duckdb.connect()
    for table in ("customer", "nation", "orders"):
        con.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    assert found and sorted(map(tuple, found)) == sorted(con.execute(tree_queries.oracle_sql()[name]).fetchall())
