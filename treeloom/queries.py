"""The registered queries over published documents and pages, each with SQL over the base tables that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom import publish as P
from treeloom.operators import edit, navigate, serialize, typed
from treeloom.plans.query import Variables, XPath, select_nodes
from treeloom.sources.shred import documents
from treeloom.tables import merged

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Items in document order with their place, and where their nodes lie: an item has eight attributes after it.
_ITEMS = """
WITH o AS (SELECT o_orderkey AS doc_id, o_orderstatus, o_totalprice FROM orders),
i AS (SELECT o_orderkey AS doc_id, lineitem.*, row_number() OVER w AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, (5 + 9 * (row_number() OVER w - 1))::INTEGER AS pre
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))
"""


def _query(name: str, sql: str | None = None, items: bool = True) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = (_ITEMS if items else "") + sql
        return function

    return register


def _nodes(name: str, xpath: str, sql: str, value: bool = False, variables: Variables | None = None) -> None:
    """A node-set query over orders: (doc_id, pre), with the nodes' values too."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = select_nodes(P.order_nodes(spark, sf_dir), xpath, variables=variables)
        return found.select("doc_id", "pre", *(["value"] if value else []))

    _query(name, sql)(run)


def _scalar(name: str, xpath: str, sql: str, kind: str = "number", of: Callable = P.order_nodes, digits: int | None = None, items: bool = True) -> None:
    """A scalar query, one value a document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = getattr(XPath(xpath), f"evaluate_{kind}")(of(spark, sf_dir))
        return found if digits is None else found.select("doc_id", F.round("value", digits).alias("value"))

    _query(name, sql, items)(run)


# numbers of documents

_scalar("xp_sum_attr", "sum(/order/item/@qty)", "SELECT o.doc_id, round(coalesce(sum(l_quantity), 0), 2) AS value FROM o LEFT JOIN i USING (doc_id) GROUP BY o.doc_id", digits=2)
_scalar("xp_count", "count(//item)", "SELECT o.doc_id, count(l_partkey)::DOUBLE AS value FROM o LEFT JOIN i USING (doc_id) GROUP BY o.doc_id")
_scalar("xp_arith", "sum(//item/@qty) div (count(//item) + 1) - 2 * count(//item)", "SELECT o.doc_id, round(coalesce(sum(l_quantity), 0) / (count(l_partkey) + 1) - 2 * count(l_partkey), 6) AS value FROM o LEFT JOIN i USING (doc_id) GROUP BY o.doc_id", digits=6)
_scalar("xp_mod", "count(//item) mod 3", "SELECT o.doc_id, (count(l_partkey) % 3)::DOUBLE AS value FROM o LEFT JOIN i USING (doc_id) GROUP BY o.doc_id")
_scalar("xp_div_zero", "1 div count(//item[@flag='R']) > 1000000", "SELECT o.doc_id, count(l_partkey) FILTER (l_returnflag = 'R') = 0 AS value FROM o LEFT JOIN i USING (doc_id) GROUP BY o.doc_id", "boolean")
_scalar("xp_floor", "floor(/order/@total)", "SELECT doc_id, floor(round(o_totalprice, 2)) AS value FROM o")
_scalar("xp_ceiling", "ceiling(/order/@total)", "SELECT doc_id, ceil(round(o_totalprice, 2)) AS value FROM o")
_scalar("xp_round", "round(/order/@total)", "SELECT doc_id, floor(round(o_totalprice, 2) + 0.5) AS value FROM o")
_scalar("xp_negate", "-(/order/@total)", "SELECT doc_id, -round(o_totalprice, 2) AS value FROM o")
_scalar("xp_number_string", "string(number(/order/@total))", "SELECT doc_id, regexp_replace(printf('%.2f', o_totalprice), '\\.?0+$', '') AS value FROM o", "string")
_scalar("xp_boolean_conv", "boolean(//item)", "SELECT o.doc_id, count(l_partkey) > 0 AS value FROM o LEFT JOIN i USING (doc_id) GROUP BY o.doc_id", "boolean")
_scalar("xp_name", "concat(name(/*), '/', local-name(/order/@*[2]))", "SELECT doc_id, 'order/status' AS value FROM o", "string")

# node sets

_nodes("xp_pred_attr_eq", "//item[@flag='R']", "SELECT doc_id, pre FROM i WHERE l_returnflag = 'R'")
_nodes("xp_pred_num", "//item[@qty > 25]/@price", "SELECT doc_id, (pre + 5)::INTEGER AS pre, printf('%.2f', l_extendedprice) AS value FROM i WHERE l_quantity > 25", value=True)
_nodes("xp_pred_and_or", "//item[@flag='R' and (@qty < 10 or @qty >= 40)]", "SELECT doc_id, pre FROM i WHERE l_returnflag = 'R' AND (l_quantity < 10 OR l_quantity >= 40)")
_nodes("xp_first", "/order/item[1]", "SELECT doc_id, pre FROM i WHERE pos = 1")
_nodes("xp_last", "/order/item[last()]", "SELECT doc_id, pre FROM i WHERE pos = n")
_nodes("xp_nth", "/order/item[2]", "SELECT doc_id, pre FROM i WHERE pos = 2")
_nodes("xp_top_k", "/order/item[position() <= 3]", "SELECT doc_id, pre FROM i WHERE pos <= 3")
_nodes("xp_chained_preds", "//item[@flag='R'][2]", "SELECT doc_id, pre FROM (SELECT doc_id, pre, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS k FROM i WHERE l_returnflag = 'R') WHERE k = 2")
_nodes("xp_filter_expr", "(//item)[2]", "SELECT doc_id, pre FROM i WHERE pos = 2")
_nodes("xp_union", "//item[@flag='R'] | //item[@qty>40]", "SELECT doc_id, pre FROM i WHERE l_returnflag = 'R' OR l_quantity > 40")
_nodes("xp_exists", "/order[item]", "SELECT doc_id, 1 AS pre FROM o SEMI JOIN i USING (doc_id)")
_nodes("xp_not_exists", "/order[not(item)]", "SELECT doc_id, 1 AS pre FROM o ANTI JOIN i USING (doc_id)")
_nodes("xp_set_eq_join", "//item[@part = preceding-sibling::item/@part]", "SELECT a.doc_id, a.pre FROM i a WHERE EXISTS (SELECT 1 FROM i b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.l_partkey = a.l_partkey)")
_nodes("xp_rel_sets", "//item[@qty < following-sibling::item/@qty]", "SELECT a.doc_id, a.pre FROM i a WHERE EXISTS (SELECT 1 FROM i b WHERE b.doc_id = a.doc_id AND b.pos > a.pos AND b.l_quantity > a.l_quantity)")
_nodes("xp_muenchian", "//item[not(@flag = preceding-sibling::item/@flag)]/@flag", "SELECT doc_id, (min(pre) + 7)::INTEGER AS pre, l_returnflag AS value FROM i GROUP BY doc_id, l_returnflag", value=True)
_nodes("xp_parent", "//item/..", "SELECT DISTINCT doc_id, 1 AS pre FROM i")
_nodes("xp_ancestor", "//item/ancestor::node()", "SELECT DISTINCT doc_id, unnest([0, 1]) AS pre FROM i")
_nodes("xp_ancestor_or_self", "//item/ancestor-or-self::*", "SELECT doc_id, pre FROM i UNION SELECT DISTINCT doc_id, 1 FROM i")
_nodes("xp_following", "//item[1]/following::*", "SELECT doc_id, pre FROM i WHERE pos > 1")
_nodes("xp_preceding", "//item[last()]/preceding::*", "SELECT doc_id, pre FROM i WHERE pos < n")
_nodes("xp_following_sibling", "//item[2]/following-sibling::item[1]", "SELECT doc_id, pre FROM i WHERE pos = 3")
_nodes("xp_preceding_sibling", "//item[last()]/preceding-sibling::item[1]", "SELECT doc_id, pre FROM i WHERE pos = n - 1")
_nodes("xp_descendant", "/order/descendant::node()", "SELECT doc_id, pre FROM i")
_nodes("xp_descendant_or_self", "/descendant-or-self::*", "SELECT doc_id, pre FROM i UNION ALL SELECT doc_id, 1 FROM o")
_nodes("xp_self", "//item/self::item[@flag='A']", "SELECT doc_id, pre FROM i WHERE l_returnflag = 'A'")
_nodes("xp_attribute_any", "/order/@*", "SELECT doc_id, unnest([2, 3, 4]) AS pre FROM o")
_scalar("xp_namespace_axis", "count(//item/namespace::node() | //item)", "SELECT o.doc_id, count(l_partkey)::DOUBLE AS value FROM o LEFT JOIN i USING (doc_id) GROUP BY o.doc_id")
_scalar("xp_id", "count(id('x') | //item[1])", "SELECT o.doc_id, least(count(l_partkey), 1)::DOUBLE AS value FROM o LEFT JOIN i USING (doc_id) GROUP BY o.doc_id")
_nodes("xp_nested_preds", "/order[item[@qty > 45]]/item[@qty = ../item[last()]/@qty]", "SELECT a.doc_id, a.pre FROM i a WHERE EXISTS (SELECT 1 FROM i b WHERE b.doc_id = a.doc_id AND b.l_quantity > 45) AND EXISTS (SELECT 1 FROM i b WHERE b.doc_id = a.doc_id AND b.pos = b.n AND b.l_quantity = a.l_quantity)")
_nodes("xp_variable", "//item[@qty = $q]", "SELECT doc_id, pre FROM i WHERE l_quantity = 10", variables=Variables(q=10))


def _beside(name: str, xpath: str, sql: str) -> None:
    """A string for each item."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = P.order_nodes(spark, sf_dir)
        items = select_nodes(nodes, "//item").select("doc_id", "pre")
        return XPath(xpath).evaluate_string(nodes, items).select("doc_id", F.col("context").alias("pre"), "value")

    _query(name, sql)(run)


_beside("xp_lag", "preceding-sibling::item[1]/@qty", "SELECT doc_id, pre, coalesce(printf('%.2f', lag(l_quantity) OVER (PARTITION BY doc_id ORDER BY pos)), '') AS value FROM i")
_beside("xp_lead", "following-sibling::item[1]/@qty", "SELECT doc_id, pre, coalesce(printf('%.2f', lead(l_quantity) OVER (PARTITION BY doc_id ORDER BY pos)), '') AS value FROM i")

# strings of parts

_PART = "SELECT p_partkey AS doc_id, {} AS value FROM part"
for _name, _xpath, _sql, _kind in [
    ("xp_concat", "concat(/part/name, ' [', /part/brand, ']')", "concat(p_name, ' [', p_brand, ']')", "string"),
    ("xp_contains", "contains(/part/type, 'A')", "contains(p_type, 'A')", "boolean"),
    ("xp_starts_with", "starts-with(/part/name, 'p')", "starts_with(p_name, 'p')", "boolean"),
    ("xp_substr_before", "substring-before(/part/name, 'a')", "CASE WHEN contains(p_name, 'a') THEN substr(p_name, 1, strpos(p_name, 'a') - 1) ELSE '' END", "string"),
    ("xp_substr_after", "substring-after(/part/brand, '#')", "CASE WHEN contains(p_brand, '#') THEN substr(p_brand, strpos(p_brand, '#') + 1) ELSE '' END", "string"),
    ("xp_substring", "substring(/part/type, 2, 4.4)", "substr(p_type, 2, 4)", "string"),
    ("xp_strlen", "string-length(/part/name)", "length(p_name)::DOUBLE", "number"),
    ("xp_normalize", "normalize-space(concat('  ', /part/name, '  x  '))", "trim(regexp_replace(concat('  ', p_name, '  x  '), '[ \\t\\r\\n]+', ' ', 'g'))", "string"),
    ("xp_translate", "translate(/part/type, 'ABCDE-', 'abcde')", "translate(p_type, 'ABCDE-', 'abcde')", "string"),
    ("xp_sval", "string(/part)", "concat(p_name, p_brand, p_type)", "string"),
]:
    _scalar(_name, _xpath, _PART.format(_sql), _kind, P.part_nodes, items=False)

_scalar("xp_lang", "count(/*[lang('de')])", "SELECT doc_id, (coalesce(lang, '') = 'de')::INTEGER::DOUBLE AS value FROM documents", "number", P.language_nodes, items=False)
_scalar("xp_ns", "concat(namespace-uri(/*), '|', namespace-uri(//plain), '|', string(/d:doc/d:*))", "SELECT doc_id, concat('urn:docs||', coalesce(source, '')) AS value FROM documents", "string", P.language_nodes, items=False)


# navigation and typed access


def _context(nodes: DataFrame, xpath: str) -> DataFrame:
    return select_nodes(nodes, xpath).select("doc_id", "pre")


@_query("dom_child_value", "SELECT p_partkey AS doc_id, p_name AS value FROM part", False)
def dom_child_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.part_nodes(spark, sf_dir)
    return navigate.child_value(nodes, _context(nodes, "/part"), "name").select("doc_id", "value")


@_query("dom_attr_typed", "SELECT p_partkey AS doc_id, p_size::INTEGER AS as_int, p_size::DOUBLE AS as_double, starts_with(p_size::VARCHAR, '1') AS as_bool FROM part", False)
def dom_attr_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.part_nodes(spark, sf_dir)
    found = navigate.attribute(nodes, _context(nodes, "/part"), "size")
    value = F.col("value")
    return found.select("doc_id", typed.as_int(value).alias("as_int"), typed.as_double(value).alias("as_double"), typed.as_bool(value).alias("as_bool"))


@_query("dom_path", "SELECT doc_id, pre, '/order/item' AS path FROM i")
def dom_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.order_nodes(spark, sf_dir)
    return navigate.path(nodes, _context(nodes, "//item")).select("doc_id", F.col("context").alias("pre"), "path")


@_query("dom_find_child", "SELECT doc_id, min(pre) AS pre FROM i WHERE l_returnflag = 'R' GROUP BY doc_id")
def dom_find_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.order_nodes(spark, sf_dir)
    return navigate.find_child_by_attribute(nodes, _context(nodes, "/order"), "flag", "R", "item").select("doc_id", "pre")


@_query("dom_first_by_path", "SELECT p_partkey AS doc_id, p_type AS sval FROM part", False)
def dom_first_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.part_nodes(spark, sf_dir)
    return navigate.first_element_by_path(nodes, _context(nodes, "/"), "/part/name/../type").select("doc_id", "sval")


@_query("dom_siblings", "SELECT doc_id, pre, lead(pre) OVER (PARTITION BY doc_id ORDER BY pos) AS next_pre FROM i QUALIFY next_pre IS NOT NULL")
def dom_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.order_nodes(spark, sf_dir)
    return navigate.next_sibling(nodes, _context(nodes, "//item")).select("doc_id", F.col("context").alias("pre"), F.col("pre").alias("next_pre"))


@_query("dom_traverse", "SELECT doc_id, pre, 0 AS depth FROM i")
def dom_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.order_nodes(spark, sf_dir)
    return navigate.traverse(nodes, _context(nodes, "/order")).select("doc_id", "pre", "depth")


# edits, queried afterwards


@_query("dom_edit_set", "SELECT doc_id, pre, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE l_returnflag END AS value FROM i")
def dom_edit_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.order_nodes(spark, sf_dir)
    changed = edit.set_value(nodes, _context(nodes, "//item/@flag[. = 'R']"), "returned")
    return select_nodes(changed, "//item/@flag").select("doc_id", (F.col("pre") - 7).cast("int").alias("pre"), "value")


@_query("dom_edit_remove", "SELECT doc_id, (5 + 9 * (row_number() OVER (PARTITION BY doc_id ORDER BY pre) - 1))::INTEGER AS pre FROM i WHERE l_quantity <= 25")
def dom_edit_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.order_nodes(spark, sf_dir)
    return select_nodes(edit.remove(nodes, _context(nodes, "//item[@qty > 25]")), "//item").select("doc_id", "pre")


@_query("dom_edit_append", "SELECT o.doc_id, (5 + 9 * count(l_partkey))::INTEGER AS pre, 'note' AS name FROM o LEFT JOIN i USING (doc_id) GROUP BY o.doc_id")
def dom_edit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.order_nodes(spark, sf_dir)
    return select_nodes(edit.insert_child(nodes, _context(nodes, "/order"), "element", "note"), "/order/*[last()][self::note]").select("doc_id", "pre", "name")


@_query("dom_edit_move", "SELECT doc_id, (CASE WHEN pos = n THEN 5 ELSE pre + 9 END)::INTEGER AS pre, l_partkey::VARCHAR AS value FROM i")
def dom_edit_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.order_nodes(spark, sf_dir)
    last = _context(nodes, "/order/item[last()]").withColumnRenamed("pre", "source")
    moved = edit.insert_move(nodes, last.join(merged(_context(nodes, "/order")), "doc_id"), "prepend")
    return select_nodes(moved, "//item/@part").select("doc_id", (F.col("pre") - 1).cast("int").alias("pre"), "value")


@_query("ser_raw", "SELECT o.doc_id, md5('<order key=\"' || o.doc_id || '\" status=\"' || o_orderstatus || '\" total=\"' || printf('%.2f', o_totalprice) || '\"' || CASE WHEN count(l_partkey) = 0 THEN ' />' ELSE '>' || string_agg('<item part=\"' || l_partkey || '\" supp=\"' || l_suppkey || '\" line=\"' || l_linenumber || '\" qty=\"' || printf('%.2f', l_quantity) || '\" price=\"' || printf('%.2f', l_extendedprice) || '\" disc=\"' || printf('%.2f', l_discount) || '\" flag=\"' || l_returnflag || '\" ship=\"' || strftime(l_shipdate, '%Y-%m-%d') || '\" />', '' ORDER BY pos) || '</order>' END) AS digest FROM o LEFT JOIN i USING (doc_id) GROUP BY o.doc_id, o_orderstatus, o_totalprice")
def ser_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = serialize.save(P.order_nodes(spark, sf_dir), flags=serialize.RAW | serialize.NO_DECLARATION)
    return out.select("doc_id", F.md5("xml").alias("digest"))


# malformed pages: what was read before the error


@_query("parse_status", "SELECT page_id AS doc_id, 'end_element_mismatch' AS status, 14 AS status_code FROM pages", False)
def parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(P.page_nodes(spark, sf_dir)).select("doc_id", "status", "status_code")


@_query("parse_title", "SELECT page_id AS doc_id, replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS value FROM pages", False)
def parse_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XPath("string(//title)").evaluate_string(P.page_nodes(spark, sf_dir))


@_query("parse_html_lang", "SELECT page_id AS doc_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS value FROM pages", False)
def parse_html_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return XPath("string(/html/@lang)").evaluate_string(P.page_nodes(spark, sf_dir))


def queries() -> dict[str, Query]:
    from treeloom import nested

    return _QUERIES | nested.QUERIES


def oracle_sql() -> dict[str, str]:
    from treeloom import nested

    return _SQL | nested.SQL
