"""Navigation: from context nodes (doc_id, pre) to other nodes.

Each function takes a node table and contexts and returns (doc_id, context, NODE columns) of what it finds; a context
from which there is nothing gives no row, so chains of calls end quietly where a node is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.schema import NODE_COLUMNS
from treeloom.tables import merged

_REST = [c for c in NODE_COLUMNS if c != "doc_id"]
_KEY = ["doc_id", "context"]


def at(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """The context nodes themselves."""
    return nodes.join(merged(contexts.select("doc_id", "pre").distinct()), ["doc_id", "pre"]).withColumn("context", F.col("pre")).select(*_KEY, *_REST)


def _own(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """(doc_id, context, c_...): what joins need of the context nodes."""
    names = ["kind", "parent", "size", "level", "ord", "anc"]
    return at(nodes, contexts).select(*_KEY, *[F.col(c).alias(f"c_{c}") for c in names])


def _picked(found: DataFrame, by: Column, last: bool = False) -> DataFrame:
    """One row a context: the first (or last) in the order given."""
    pick = F.max_by if last else F.min_by
    return found.groupBy(*_KEY).agg(pick(F.struct(*_REST), by).alias("n")).select(*_KEY, "n.*")


def _below(nodes: DataFrame, contexts: DataFrame, attributes: bool, name: str | None = None) -> DataFrame:
    kind = F.col("kind") == "attribute"
    right = nodes.where(kind if attributes else ~kind)
    right = right if name is None else right.where(F.col("name") == name)
    left = contexts.select("doc_id", F.col("pre").alias("context")).distinct().withColumn("parent", F.col("context"))
    return left.join(merged(right), ["doc_id", "parent"]).select(*_KEY, *_REST)


def children(nodes: DataFrame, contexts: DataFrame, name: str | None = None) -> DataFrame:
    return _below(nodes, contexts, False, name)


def attributes(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """All attributes, namespace declarations as well."""
    return _below(nodes, contexts, True)


def child(nodes: DataFrame, contexts: DataFrame, name: str) -> DataFrame:
    """The first child of the name, of any kind that has names."""
    return _picked(_below(nodes, contexts, False, name), F.col("pre"))


def attribute(nodes: DataFrame, contexts: DataFrame, name: str) -> DataFrame:
    return _below(nodes, contexts, True, name).where("not dup")


def first_child(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    return _below(nodes, contexts, False).where("ord = 1")


def last_child(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    return _below(nodes, contexts, False).where("ord = nsib")


def first_attribute(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    return _below(nodes, contexts, True).where("ord = 1")


def last_attribute(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    return _below(nodes, contexts, True).where("ord = nsib")


def _beside(nodes: DataFrame, contexts: DataFrame, step: int, attributes: bool, name: str | None) -> DataFrame:
    own = _own(nodes, contexts).where(F.col("c_kind") == "attribute" if attributes else F.col("c_kind") != "attribute").withColumn("parent", F.col("c_parent"))
    kind = F.col("kind") == "attribute"
    right = nodes.where(kind if attributes else ~kind)
    if name is None:
        return own.withColumn("ord", F.col("c_ord") + step).join(merged(right), ["doc_id", "parent", "ord"]).select(*_KEY, *_REST)
    found = own.join(merged(right.where(F.col("name") == name)), ["doc_id", "parent"]).where(F.col("ord") > F.col("c_ord") if step > 0 else F.col("ord") < F.col("c_ord"))
    return _picked(found.select(*_KEY, *_REST), F.col("ord"), step < 0)


def next_sibling(nodes: DataFrame, contexts: DataFrame, name: str | None = None) -> DataFrame:
    """The next sibling, or the next of a name."""
    return _beside(nodes, contexts, 1, False, name)


def previous_sibling(nodes: DataFrame, contexts: DataFrame, name: str | None = None) -> DataFrame:
    return _beside(nodes, contexts, -1, False, name)


def next_attribute(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    return _beside(nodes, contexts, 1, True, None)


def previous_attribute(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    return _beside(nodes, contexts, -1, True, None)


def parent(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    return _own(nodes, contexts).withColumn("pre", F.col("c_parent")).join(merged(nodes), ["doc_id", "pre"]).select(*_KEY, *_REST)


def root(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    left = contexts.select("doc_id", F.col("pre").alias("context")).distinct()
    return left.join(merged(nodes.where("kind = 'document'")), "doc_id").select(*_KEY, *_REST)


def document_element(nodes: DataFrame) -> DataFrame:
    """The first element of each document."""
    return _picked(nodes.where("level = 1 and kind = 'element'").withColumn("context", F.lit(0)).select(*_KEY, *_REST), F.col("pre"))


def text(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """The node that holds a context's text: itself if it is character data, else its first such child."""
    kinds = F.col("kind").isin("pcdata", "cdata")
    return _picked(at(nodes, contexts).where(kinds).union(_below(nodes, contexts, False).where(kinds)), F.struct((F.col("pre") != F.col("context")).alias("below"), "pre"))


def child_value(nodes: DataFrame, contexts: DataFrame, name: str | None = None) -> DataFrame:
    """(doc_id, context, value): value of the first child that is character data, of the context or of its first child of a name; '' without one."""
    left = contexts.select("doc_id", F.col("pre").alias("context")).distinct()
    inner = left.withColumn("pre", F.col("context")) if name is None else child(nodes, contexts, name).select(*_KEY, "pre")
    found = _picked(_below(nodes, inner, False).where(F.col("kind").isin("pcdata", "cdata")), F.col("pre")).select("doc_id", F.col("context").alias("pre"), "value")
    return left.join(merged(inner), _KEY, "left").join(merged(found), ["doc_id", "pre"], "left").select(*_KEY, F.coalesce("value", F.lit("")).alias("value"))


def path(nodes: DataFrame, contexts: DataFrame, delimiter: str = "/") -> DataFrame:
    """(doc_id, context, path): the names from the root on, joined."""
    own = at(nodes, contexts)
    above = own.select(*_KEY, F.explode("anc").alias("pre")).join(merged(nodes.select("doc_id", "pre", F.col("name").alias("step"))), ["doc_id", "pre"])
    names = above.groupBy(*_KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "step"))), lambda x: x["step"]), delimiter).alias("above"))
    whole = F.when(F.size("anc") == 0, F.col("name")).otherwise(F.concat("above", F.lit(delimiter), "name"))
    return own.join(merged(names), _KEY, "left").select(*_KEY, whole.alias("path"))


def first_element_by_path(nodes: DataFrame, contexts: DataFrame, steps: str, delimiter: str = "/") -> DataFrame:
    """The first node on a path of names, '.' and '..' from the context, or from the root if the path begins with the delimiter. Repeated delimiters count once, and a step without the rest of the path is passed over for the next of its name."""
    start = contexts.select("doc_id", F.col("pre").alias("context")).distinct().withColumn("pre", F.col("context"))
    if steps.startswith(delimiter):
        start = start.withColumn("pre", F.lit(0))
    for step in [s for s in steps.split(delimiter) if s and s != "."]:
        if step == "..":
            above = nodes.select("doc_id", "pre", "parent").where("parent is not null")
            start = start.join(merged(above), ["doc_id", "pre"]).select(*_KEY, F.col("parent").alias("pre"))
        else:
            below = nodes.where((F.col("name") == step) & (F.col("kind") != "attribute")).select("doc_id", "parent", F.col("pre").alias("next"))
            start = start.withColumnRenamed("pre", "parent").join(merged(below), ["doc_id", "parent"]).select(*_KEY, F.col("next").alias("pre"))
    chosen = start.groupBy(*_KEY).agg(F.min("pre").alias("pre"))
    return chosen.join(merged(nodes), ["doc_id", "pre"]).select(*_KEY, *_REST)


def find_attribute(nodes: DataFrame, contexts: DataFrame, wanted: Column) -> DataFrame:
    """The first attribute for which the condition on its columns holds; likewise for children and descendants below."""
    return _picked(attributes(nodes, contexts).where(wanted), F.col("pre"))


def find_child(nodes: DataFrame, contexts: DataFrame, wanted: Column) -> DataFrame:
    return _picked(children(nodes, contexts).where(wanted), F.col("pre"))


def descendants(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    tagged = nodes.where("kind <> 'attribute'").withColumn("context", F.explode("anc"))
    return contexts.select("doc_id", F.col("pre").alias("context")).distinct().join(merged(tagged), _KEY).select(*_KEY, *_REST)


def find_node(nodes: DataFrame, contexts: DataFrame, wanted: Column) -> DataFrame:
    return _picked(descendants(nodes, contexts).where(wanted), F.col("pre"))


def find_child_by_attribute(nodes: DataFrame, contexts: DataFrame, attribute_name: str, value: str, name: str | None = None) -> DataFrame:
    """The first child, of a name or of any, with an attribute of this name and value."""
    owners = nodes.where((F.col("kind") == "attribute") & (F.col("name") == attribute_name) & (F.col("value") == value)).select("doc_id", F.col("parent").alias("pre")).distinct()
    return _picked(children(nodes, contexts, name).where("kind = 'element' or kind = 'declaration'").join(merged(owners), ["doc_id", "pre"], "left_semi").select(*_KEY, *_REST), F.col("pre"))


def traverse(nodes: DataFrame, contexts: DataFrame, stop: Callable[[], Column] | None = None) -> DataFrame:
    """All descendants with depth, in document order within each context; with stop, none from the first row on for which it holds (that row is the last)."""
    own = _own(nodes, contexts).select(*_KEY, "c_level")
    rows = descendants(nodes, contexts).join(merged(own), _KEY).withColumn("depth", F.col("level") - F.col("c_level") - 1).drop("c_level")
    if stop is None:
        return rows
    before = Window.partitionBy(*_KEY).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("stopped", F.coalesce(F.max(stop().cast("int")).over(before), F.lit(0))).where("stopped = 0").drop("stopped")


def hash_value(nodes: DataFrame) -> DataFrame:
    """nodes with hash_value, a hash of each node's identity."""
    return nodes.withColumn("hash_value", F.xxhash64("doc_id", "pre"))
