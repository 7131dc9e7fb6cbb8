"""Registered queries over documents with depth, text, comments, CDATA and instructions, and over files, each with SQL over the base tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom import publish as P
from treeloom.operators import edit, navigate, serialize, typed
from treeloom.plans.query import XPath, select_nodes
from treeloom.session import shared_folder
from treeloom.sources import sinks
from treeloom.sources.shred import documents, read_files, shred
from treeloom.tables import merged

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Customers, and their orders with their places in the year, in the customer, and of the year.
_ROWS = """
WITH c AS (SELECT c_custkey AS doc_id, customer.*, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT *, max(ypos) OVER (PARTITION BY doc_id) AS yn FROM (
  SELECT c_custkey AS doc_id, o_orderkey::VARCHAR AS key, o_orderkey, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS date, year(o_orderdate) AS y,
    row_number() OVER (PARTITION BY c_custkey, year(o_orderdate) ORDER BY o_orderkey) AS pos, count(*) OVER (PARTITION BY c_custkey, year(o_orderdate)) AS n,
    row_number() OVER (PARTITION BY c_custkey ORDER BY year(o_orderdate), o_orderkey) AS place, dense_rank() OVER (PARTITION BY c_custkey ORDER BY year(o_orderdate)) AS ypos
  FROM orders JOIN customer ON c_custkey = o_custkey)),
t AS (SELECT doc_id, y, string_agg(date, '' ORDER BY o_orderkey) AS dates, min(o_orderkey) AS least, max(o_orderkey) AS most, count(*) AS n FROM p GROUP BY doc_id, y),
w AS (SELECT c.doc_id, c_name, CASE WHEN c_acctbal < 0 THEN 'balance < 0' ELSE '' END AS note, coalesce(dates, '') AS dates
  FROM c LEFT JOIN (SELECT doc_id, string_agg(dates, '' ORDER BY y) AS dates FROM t GROUP BY doc_id) x ON x.doc_id = c.doc_id)
"""


def _query(name: str, sql: str, rows: bool = True) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        SQL[name] = (_ROWS if rows else "") + sql
        return function

    return register


def _at(nodes: DataFrame, xpath: str) -> DataFrame:
    return select_nodes(nodes, xpath).select("doc_id", "pre")


def _found(nodes: DataFrame, xpath: str) -> DataFrame:
    return select_nodes(nodes, xpath).select("doc_id", F.col("string_value").alias("value"))


def _values(name: str, xpath: str, sql: str) -> None:
    """The string values of a node set."""
    _query(name, sql)(lambda spark, sf_dir: _found(P.customer_nodes(spark, sf_dir), xpath))


def _scalar(name: str, xpath: str, kind: str, sql: str) -> None:
    """One value a document."""
    _query(name, sql)(lambda spark, sf_dir: getattr(XPath(xpath), f"evaluate_{kind}")(P.customer_nodes(spark, sf_dir)))


def _context(name: str, contexts: str, xpath: str, kind: str, sql: str) -> None:
    """One value a context node, without its place."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = P.customer_nodes(spark, sf_dir)
        return getattr(XPath(xpath), f"evaluate_{kind}")(nodes, _at(nodes, contexts)).select("doc_id", "value")

    _query(name, sql)(run)


# node tests

_values("nest_text", "//name/text()", "SELECT doc_id, c_name AS value FROM c")
_values("nest_comment", "//comment()", "SELECT doc_id, 'nation ' || n_name AS value FROM c")
_values("nest_pi", "/customer/processing-instruction()", "SELECT doc_id, c_nationkey::VARCHAR AS value FROM c")
_values("nest_pi_target", "//processing-instruction('rank')", "SELECT doc_id, c_nationkey::VARCHAR AS value FROM c")
_values("nest_cdata", "//note/text()", "SELECT doc_id, 'balance < 0' AS value FROM c WHERE c_acctbal < 0")
_values("nest_not_elements", "/customer/node()[not(self::*)]", "SELECT doc_id, unnest(['nation ' || n_name, c_nationkey::VARCHAR]) AS value FROM c")

# axes and predicates at depth

_values("nest_not_equal", "//order[@status != 'O']/@key", "SELECT doc_id, key AS value FROM p WHERE status <> 'O'")
_values("nest_descendant", "//year[1]//text()", "SELECT doc_id, date AS value FROM p WHERE ypos = 1")
_values("nest_second", "//year/order[2]/@key", "SELECT doc_id, key AS value FROM p WHERE pos = 2")
_values("nest_last", "//year/order[last()]/@key", "SELECT doc_id, key AS value FROM p WHERE pos = n")
_values("nest_fifth", "(//order)[5]/@key", "SELECT doc_id, key AS value FROM p WHERE place = 5")
_values("nest_following", "//year[2]/following::order/@key", "SELECT doc_id, key AS value FROM p WHERE ypos > 2")
_values("nest_following_set", "//order[@status = 'P']/following::order/@key", "SELECT p.doc_id, key AS value FROM p JOIN (SELECT doc_id, min(place) AS first FROM p WHERE status = 'P' GROUP BY doc_id) f ON f.doc_id = p.doc_id WHERE place > first")
_values("nest_following_attribute", "//year[2]/@no/following::order/@key", "SELECT doc_id, key AS value FROM p WHERE ypos >= 2")
_values("nest_preceding", "//year[last()]/preceding::order/@key", "SELECT doc_id, key AS value FROM p WHERE ypos < yn")
_values("nest_preceding_text", "//year[1]/preceding::text()", "SELECT c.doc_id, unnest(CASE WHEN c_acctbal < 0 THEN [c_name, 'balance < 0'] ELSE [c_name] END) AS value FROM c SEMI JOIN p ON p.doc_id = c.doc_id")
_values("nest_ancestor", "//order[@status = 'P']/ancestor::year/@no", "SELECT DISTINCT doc_id, y::VARCHAR AS value FROM p WHERE status = 'P'")
_values("nest_sibling_next", "//order/following-sibling::order[1]/@key", "SELECT doc_id, key AS value FROM p WHERE pos > 1")
_values("nest_sibling_second", "//order/preceding-sibling::order[2]/@key", "SELECT doc_id, key AS value FROM p WHERE pos <= n - 2")
_values("nest_sibling_kinds", "/customer/name/preceding-sibling::node()[2]", "SELECT doc_id, 'nation ' || n_name AS value FROM c")
_values("nest_sibling_any", "//order[@status = 'P']/preceding-sibling::order/@key", "SELECT p.doc_id, key AS value FROM p JOIN (SELECT doc_id, y, max(pos) AS last FROM p WHERE status = 'P' GROUP BY doc_id, y) f ON f.doc_id = p.doc_id AND f.y = p.y WHERE pos < last")
_values("nest_muenchian", "//order[not(@status = preceding-sibling::order/@status)]/@key", "SELECT doc_id, min(o_orderkey)::VARCHAR AS value FROM p GROUP BY doc_id, y, status")
_values("nest_exists", "//year[order/@status = 'P']/@no", "SELECT DISTINCT doc_id, y::VARCHAR AS value FROM p WHERE status = 'P'")
_values("nest_union", "//note | //order[@status = 'P']/@key", "SELECT doc_id, 'balance < 0' AS value FROM c WHERE c_acctbal < 0 UNION ALL SELECT doc_id, key FROM p WHERE status = 'P'")

# values

_scalar("nest_ancestors", "count(//order/@status[. = 'P']/ancestor::*)", "number", "SELECT c.doc_id, (count(DISTINCT y) + count(DISTINCT key) + least(count(y), 1))::DOUBLE AS value FROM c LEFT JOIN p ON p.doc_id = c.doc_id AND status = 'P' GROUP BY c.doc_id")
_scalar("nest_sum", "sum(//@no)", "number", "SELECT c.doc_id, coalesce(sum(DISTINCT y), 0)::DOUBLE AS value FROM c LEFT JOIN p ON p.doc_id = c.doc_id GROUP BY c.doc_id")
_scalar("nest_string", "string(/customer)", "string", "SELECT doc_id, concat(c_name, note, dates) AS value FROM w")
_scalar("nest_set_not_equal", "//order/@status != 'O'", "boolean", "SELECT c.doc_id, coalesce(bool_or(status <> 'O'), false) AS value FROM c LEFT JOIN p ON p.doc_id = c.doc_id GROUP BY c.doc_id")
_scalar("nest_set_less", "//year/@no < 1994", "boolean", "SELECT c.doc_id, coalesce(bool_or(y < 1994), false) AS value FROM c LEFT JOIN p ON p.doc_id = c.doc_id GROUP BY c.doc_id")
_scalar("nest_names", "concat(name(/customer/*[last()]), ' ', local-name(//processing-instruction()), ' ', name(//@*[last()]))", "string", "SELECT c.doc_id, concat(CASE WHEN count(y) > 0 THEN 'year' WHEN any_value(c_acctbal) < 0 THEN 'note' ELSE 'name' END, ' rank balance') AS value FROM c LEFT JOIN p ON p.doc_id = c.doc_id GROUP BY c.doc_id")
_context("nest_context", "//year", "concat(name(), '|', local-name(), '|', namespace-uri(), '|', string-length(), '|', normalize-space(), '|', string(), '|', position(), last())", "string", "SELECT doc_id, concat('year|year||', length(dates), '|', dates, '|', dates, '|11') AS value FROM t")
_context("nest_context_number", "//year/@no", "number() * 2", "number", "SELECT doc_id, (y * 2)::DOUBLE AS value FROM t")

# navigation


@_query("nest_traverse", "SELECT doc_id, depth, count(*) AS n FROM (SELECT doc_id, unnest([0, 0, 0, 1]) AS depth FROM c UNION ALL SELECT doc_id, unnest([0, 1]) FROM c WHERE c_acctbal < 0 UNION ALL SELECT doc_id, 0 FROM t UNION ALL SELECT doc_id, unnest([1, 2]) FROM p) GROUP BY doc_id, depth")
def nest_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.customer_nodes(spark, sf_dir)
    return navigate.traverse(nodes, _at(nodes, "/customer")).groupBy("doc_id", "depth").agg(F.count(F.lit(1)).alias("n"))


@_query("nest_path", "SELECT doc_id, unnest(['customer|name', 'customer|year|order']) AS path, unnest([1, n]) AS n FROM (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id) UNION ALL SELECT doc_id, 'customer|name', 1 FROM c ANTI JOIN p ON p.doc_id = c.doc_id")
def nest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.customer_nodes(spark, sf_dir)
    found = navigate.path(nodes, _at(nodes, "//order | //name"), "|").withColumn("path", F.ltrim(F.col("path"), F.lit("|")))
    return found.groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n"))


@_query("nest_path_pi", "SELECT doc_id, c_nationkey::VARCHAR AS value FROM c")
def nest_path_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.customer_nodes(spark, sf_dir)
    return navigate.first_element_by_path(nodes, _at(nodes, "//name"), "../rank").select("doc_id", "value")


@_query("nest_ends", "SELECT c.doc_id, 'nation ' || n_name AS first, CASE WHEN dates IS NOT NULL THEN dates WHEN c_acctbal < 0 THEN 'balance < 0' ELSE c_name END AS last FROM c LEFT JOIN (SELECT doc_id, arg_max(dates, y) AS dates FROM t GROUP BY doc_id) x ON x.doc_id = c.doc_id")
def nest_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.customer_nodes(spark, sf_dir)
    own = _at(nodes, "/customer")
    first, last = (f(nodes, own).select("doc_id", F.col("sval").alias(n)) for f, n in ((navigate.first_child, "first"), (navigate.last_child, "last")))
    return first.join(merged(last), "doc_id")


@_query("nest_texts", "SELECT doc_id, date AS value FROM p")
def nest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.customer_nodes(spark, sf_dir)
    return navigate.text(nodes, _at(nodes, "//order")).select("doc_id", "value")


@_query("nest_attributes", "SELECT doc_id, unnest(['key', 'segment', 'balance']) AS name, unnest([doc_id::VARCHAR, c_mktsegment, printf('%.2f', c_acctbal)]) AS value FROM c")
def nest_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.customer_nodes(spark, sf_dir)
    return navigate.attributes(nodes, _at(nodes, "/customer")).select("doc_id", "name", "value")


@_query("nest_typed", "SELECT doc_id, trunc(round(c_acctbal, 2))::INTEGER AS as_int, CASE WHEN trunc(round(c_acctbal, 2)) < 0 THEN 4294967296 ELSE 0 END + trunc(round(c_acctbal, 2))::BIGINT AS as_uint, trunc(round(c_acctbal, 2))::BIGINT AS as_llong, round(c_acctbal, 2) AS as_double, round(c_acctbal::FLOAT::DOUBLE, 1) AS as_float, c_mktsegment AS as_string, c_mktsegment[1] IN ('1', 't', 'T', 'y', 'Y') AS as_bool FROM c")
def nest_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.customer_nodes(spark, sf_dir)
    own = _at(nodes, "/customer")
    balance, segment = (navigate.attribute(nodes, own, n).select("doc_id", F.col("value").alias(n)) for n in ("balance", "segment"))
    b, s = F.col("balance"), F.col("segment")
    return balance.join(merged(segment), "doc_id").select("doc_id", typed.as_int(b).alias("as_int"), typed.as_uint(b).cast("long").alias("as_uint"), typed.as_llong(b).alias("as_llong"), typed.as_double(b).alias("as_double"), F.round(typed.as_float(b).cast("double"), 1).alias("as_float"), typed.as_string(s).alias("as_string"), typed.as_bool(s).alias("as_bool"))


# edits, queried afterwards


def _edited(name: str, change: Callable[[DataFrame], DataFrame], xpath: str, sql: str) -> None:
    _query(name, sql)(lambda spark, sf_dir: _found(change(P.customer_nodes(spark, sf_dir)), xpath))


def _pairs(nodes: DataFrame, where: str, source: str) -> DataFrame:
    """(doc_id, pre, source): of each year, the two nodes of these paths."""
    of = lambda path, name: XPath(path).evaluate_nodes(nodes, _at(nodes, "//year")).select("doc_id", "context", F.col("pre").alias(name))
    return of(where, "pre").join(merged(of(source, "source")), ["doc_id", "context"]).drop("context")


_edited("nest_set_name", lambda n: edit.set_name(n, _at(n, "//order[@status = 'P']"), "pending"), "//pending/@key", "SELECT doc_id, key AS value FROM p WHERE status = 'P'")
_edited("nest_set_attribute_name", lambda n: edit.set_name(n, _at(n, "//order/@key"), "status"), "//order/@status", "SELECT doc_id, key AS value FROM p")
_edited("nest_set_value", lambda n: edit.set_value(n, _at(n, "//name/text()"), "x"), "/customer", "SELECT doc_id, concat('x', note, dates) AS value FROM w")
_edited("nest_set_text", lambda n: edit.set_text(n, _at(n, "//year"), "y"), "//year", "SELECT doc_id, dates || 'y' AS value FROM t")
_edited("nest_attribute_append", lambda n: edit.insert_attribute(n, _at(n, "//order"), "seen", "1"), "//order/@*[3]", "SELECT doc_id, '1' AS value FROM p")
_edited("nest_attribute_prepend", lambda n: edit.insert_attribute(n, _at(n, "//order"), "seen", "1", "prepend"), "//order/@*[2]", "SELECT doc_id, key AS value FROM p")
_edited("nest_attribute_before", lambda n: edit.insert_attribute(n, _at(n, "//order/@status"), "seen", "1", "before"), "//order/@*[2]", "SELECT doc_id, '1' AS value FROM p")
_edited("nest_attribute_after", lambda n: edit.insert_attribute(n, _at(n, "//order/@key"), "seen", "1", "after"), "//order/@*[3]", "SELECT doc_id, status AS value FROM p")
_edited("nest_child_prepend", lambda n: edit.insert_child(n, _at(n, "//year"), "pcdata", "", "a", "prepend"), "//year/node()[1]", "SELECT doc_id, 'a' AS value FROM t")
_edited("nest_child_before", lambda n: edit.insert_child(n, _at(n, "//order[2]"), "comment", "", "b", "before"), "//year/node()[2][self::comment()]/following-sibling::order[1]/@key", "SELECT doc_id, key AS value FROM p WHERE pos = 2")
_edited("nest_child_after", lambda n: edit.insert_child(n, _at(n, "//order[1]"), "element", "gap", "", "after"), "//gap/preceding-sibling::*[1]/@key", "SELECT doc_id, key AS value FROM p WHERE pos = 1")
_edited("nest_child_cdata", lambda n: edit.insert_child(n, _at(n, "//name"), "cdata", "", "<&>"), "//name", "SELECT doc_id, c_name || '<&>' AS value FROM c")
_edited("nest_copy_append", lambda n: edit.insert_copy(n, _pairs(n, ".", "order[1]")), "//year", "SELECT t.doc_id, dates || date AS value FROM t JOIN p ON p.doc_id = t.doc_id AND p.y = t.y AND pos = 1")
_edited("nest_copy_prepend", lambda n: edit.insert_copy(n, _pairs(n, ".", "order[last()]"), "prepend"), "//year/order[1]/@key", "SELECT doc_id, most::VARCHAR AS value FROM t")
_edited("nest_copy_after", lambda n: edit.insert_copy(n, _pairs(n, "order[1]", "order[last()]"), "after"), "//year/order[2]/@key", "SELECT doc_id, most::VARCHAR AS value FROM t")
_edited("nest_copy_before", lambda n: edit.insert_copy(n, _pairs(n, "order[1]/@key", "order[1]/@status"), "before"), "//year/order[1]/@*[1]", "SELECT doc_id, status AS value FROM p WHERE pos = 1")
_edited("nest_move_append", lambda n: edit.insert_move(n, _pairs(n, ".", "order[1]")), "//year/order[last()]/@key", "SELECT doc_id, least::VARCHAR AS value FROM t")
_edited("nest_move_after", lambda n: edit.insert_move(n, _pairs(n, "order[last()]", "order[1]"), "after"), "//year/order[last()]/@key", "SELECT doc_id, least::VARCHAR AS value FROM t")
_edited("nest_move_before", lambda n: edit.insert_move(n, _pairs(n, "order[1]", "order[last()]"), "before"), "//year/order[1]/@key", "SELECT doc_id, most::VARCHAR AS value FROM t")
_edited("nest_remove_attribute", lambda n: edit.remove(n, _at(n, "//order/@key")), "//order/@*", "SELECT doc_id, status AS value FROM p")
_edited("nest_remove_text", lambda n: edit.remove(n, _at(n, "//name/text() | //comment()")), "/customer/node()[position() < 3]", "SELECT doc_id, unnest([c_nationkey::VARCHAR, '']) AS value FROM c")


@_query("nest_copy_between", "SELECT doc_id, concat(c_name, note, dates, lag(c_name) OVER (ORDER BY doc_id)) AS value FROM w QUALIFY lag(c_name) OVER (ORDER BY doc_id) IS NOT NULL")
def nest_copy_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer gets a copy of the name in the document before."""
    nodes = P.customer_nodes(spark, sf_dir)
    names = _at(nodes, "//name").select((F.col("doc_id") + 1).alias("doc_id"), F.col("doc_id").alias("source_doc"), F.col("pre").alias("source"))
    copied = edit.insert_copy(nodes, _at(nodes, "/customer").join(merged(names), "doc_id"))
    return _found(copied, "/customer[name[2]]")


def _with_fragments(nodes: DataFrame) -> DataFrame:
    return edit.append_fragments(nodes, _at(nodes, "/customer").withColumn("xml", F.lit("<tag>in</tag>out")))[0]


_edited("nest_fragment", _with_fragments, "/customer/tag | /customer/tag/following-sibling::node()", "SELECT doc_id, unnest(['in', 'out']) AS value FROM c")


@_query("nest_fragment_status", "SELECT doc_id, 'append_invalid_root' AS status FROM c UNION ALL SELECT doc_id, 'bad_start_element' FROM t")
def nest_fragment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.customer_nodes(spark, sf_dir)
    fragments = _at(nodes, "//name/text()").withColumn("xml", F.lit("<a/>")).union(_at(nodes, "//year").withColumn("xml", F.lit("<b")))
    return edit.append_fragments(nodes, fragments)[1].select("doc_id", "status")


@_query("nest_reset", "SELECT doc_id, CASE WHEN c_acctbal < 0 THEN 1 ELSE 4 + 2 + CASE WHEN y THEN 1 ELSE 0 END END AS least FROM c JOIN (SELECT c.doc_id, count(p.y) > 0 AS y FROM c LEFT JOIN p ON p.doc_id = c.doc_id GROUP BY c.doc_id) x USING (doc_id)")
def nest_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with notes are emptied; the others have a document, an element, three attributes, a comment and more."""
    nodes = P.customer_nodes(spark, sf_dir)
    sizes = documents(edit.reset(nodes, _at(nodes, "//note").select("doc_id").distinct()))
    return sizes.select("doc_id", F.least("n_nodes", F.when(F.col("n_nodes") > 9, 7).otherwise(6)).alias("least"))


# texts that can't be parsed to the end

_BROKEN = {"AUTOMOBILE": ("<a b=1/>", "bad_attribute", 5), "BUILDING": ("<a><b></a>", "end_element_mismatch", 9), "FURNITURE": ("<!-- a", "bad_comment", 5), "HOUSEHOLD": ("<a>b</a>", "ok", 0), "MACHINERY": ("<a", "bad_start_element", 1)}


@_query("parse_broken", "SELECT c_custkey AS doc_id, " + ", ".join(f"CASE c_mktsegment {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v[n]!r}' for k, v in _BROKEN.items())} END AS {name}" for n, name in ((1, "status"), (2, "error_offset"))) + " FROM customer", False)
def parse_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    texts = F.create_map(*[F.lit(x) for k, v in _BROKEN.items() for x in (k, v[0])])
    return documents(shred(customers.select("c_custkey", F.element_at(texts, F.col("c_mktsegment")).alias("xml")), "c_custkey")).select("doc_id", "status", "error_offset")


# serialisation

_OPEN = "'<customer key=\"' || doc_id || '\" segment=\"' || c_mktsegment || '\" balance=\"' || printf('%.2f', c_acctbal) || '\">'"
_INDENTED = f"""
SELECT doc_id, md5(concat('<?xml version="1.0"?>', chr(10), {_OPEN}, chr(10), chr(9), '<!--nation ', n_name, '-->', chr(10), chr(9), '<?rank ', c_nationkey, '?>', chr(10), chr(9), '<name>', c_name, '</name>', chr(10),
  CASE WHEN c_acctbal < 0 THEN concat(chr(9), '<note><![CDATA[balance < 0]]></note>', chr(10)) ELSE '' END, coalesce(years, ''), '</customer>', chr(10))) AS digest
FROM c LEFT JOIN (SELECT doc_id, string_agg(concat(chr(9), '<year no="', y, '">', chr(10), orders, chr(9), '</year>', chr(10)), '' ORDER BY y) AS years
  FROM (SELECT doc_id, y, string_agg(concat(chr(9), chr(9), '<order key="', key, '" status="', status, '">', date, '</order>', chr(10)), '' ORDER BY o_orderkey) AS orders FROM p GROUP BY doc_id, y) GROUP BY doc_id) USING (doc_id)
"""


@_query("ser_indent", _INDENTED)
def ser_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialize.save(P.customer_nodes(spark, sf_dir)).select("doc_id", F.md5("xml").alias("digest"))


@_query("ser_print", "SELECT doc_id, md5(concat('<year no=\"', y, '\">', orders, '</year>')) AS digest FROM (SELECT doc_id, y, string_agg(concat('<order key=\"', key, '\" status=\"', status, '\">', date, '</order>'), '' ORDER BY o_orderkey) AS orders FROM p GROUP BY doc_id, y)")
def ser_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = P.customer_nodes(spark, sf_dir)
    return serialize.printed(nodes, _at(nodes, "//year"), flags=serialize.RAW).select("doc_id", F.md5("xml").alias("digest"))


# files: written in an encoding, read back


def _round_trip(name: str, encoding: str, flags: int = serialize.DEFAULT, given: str = "auto", own_format: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes, folder = P.supplier_nodes(spark, sf_dir), f"{shared_folder(spark)}/treeloom/files-{uuid.uuid4().hex}"
        if own_format:
            sinks.register(spark)
            serialize.save(nodes, flags=flags).write.format(sinks.XmlFiles.name()).option("path", folder).option("encoding", encoding).mode("append").save()
        else:
            serialize.save_files(nodes, folder, flags=flags, encoding=encoding)
        back, files = read_files(spark, f"{folder}/*.xml", encoding=given)
        names = XPath("concat(/supplier/@key, ' ', /supplier/name)").evaluate_string(back)
        found = back.where("kind = 'document'").select("doc_id", "encoding")
        return files.join(merged(names), "doc_id").join(merged(found), "doc_id").select("value", "status", "encoding")

    _query(name, f"SELECT concat(s_suppkey, ' né ', s_name) AS value, 'ok' AS status, '{encoding}' AS encoding FROM supplier", False)(run)


_round_trip("file_utf8", "utf8")
_round_trip("file_utf8_marked", "utf8", serialize.DEFAULT | serialize.WRITE_BOM)
_round_trip("file_utf16_le", "utf16_le", serialize.RAW)
_round_trip("file_utf16_be", "utf16_be", serialize.DEFAULT | serialize.WRITE_BOM)
_round_trip("file_utf32_le", "utf32_le")
_round_trip("file_utf32_be", "utf32_be", own_format=True)
_round_trip("file_latin1", "latin1", given="latin1")
