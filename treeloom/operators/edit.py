"""Edits: node tables to node tables.

A node table is immutable, so an edit gives a new one. Rows get a position (an array that sorts them: [pre] for what was
there, [anchor + 0.5, ...] for what comes in after an anchor) and a level; _numbered() then derives pre and all that
follows from it, document by document. Where a rule
forbids an edit (a kind without a name, an anchor that isn't a child, a move into its own subtree) the row stays as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom import schema as S
from treeloom.session import ship, written
from treeloom.sources.columns import numbered
from treeloom.tables import dealt, mapped, merged, partitions


def _loose(nodes: DataFrame) -> DataFrame:
    """Rows with place and level instead of the columns that follow from the order."""
    return nodes.select("doc_id", F.array(F.col("pre").cast("double")).alias("place"), F.size("anc").alias("level"), "kind", "name", "value", "offset", "status", "error_offset", "encoding")


def _numbered(rows: DataFrame) -> DataFrame:
    """The node table of loose rows, as a written table: edits can follow each other without their plans growing.

    Order and levels say what the tree is, so rows move once, to their documents' buckets, and are numbered in one pass.
    """
    spark = ship(rows.sparkSession)
    ordered = rows.repartition(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "place")
    return dealt(mapped(ordered.drop("place"), numbered, S.NODES), f"treeloom_edited_{uuid.uuid4().hex}")


def _within(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """nodes with _inside: whether a node is one of tops (doc_id, pre) or below one. By how far the subtrees before reach, in one pass in document order."""
    marked = nodes.join(merged(tops.select("doc_id", "pre").distinct().withColumn("_top", F.lit(True))), ["doc_id", "pre"], "left")
    so_far = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("_top"), F.col("pre") + F.col("size"))).over(so_far)
    return marked.withColumn("_inside", F.coalesce(reach >= F.col("pre"), F.lit(False))).drop("_top")


def _marked(nodes: DataFrame, targets: DataFrame, **values: Column | str) -> DataFrame:
    """nodes left joined with targets (doc_id, pre, ...), which are marked by _hit."""
    names = [c for c in targets.columns if c not in ("doc_id", "pre")]
    return nodes.join(merged(targets.select("doc_id", "pre", *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_hit")).dropDuplicates(["doc_id", "pre"])), ["doc_id", "pre"], "left")


def _column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def set_name(nodes: DataFrame, targets: DataFrame, name: Column | str) -> DataFrame:
    """Rename elements, instructions, declarations and attributes; a Column sees the targets' further columns with an underscore before their names. Places stay: a join and a projection."""
    named = F.coalesce("_hit", F.lit(False)) & F.col("kind").isin("element", "pi", "declaration", "attribute")
    rows = _marked(nodes, targets).withColumn("_named", named)
    offset = F.when(F.col("_named") & (F.col("kind") != "attribute"), F.lit(-1)).otherwise(F.col("offset"))
    rows = rows.withColumns({"name": F.when(F.col("_named"), _column(name)).otherwise(F.col("name")), "offset": offset})
    touched = rows.where("_named and kind = 'attribute'").select("doc_id", "parent").distinct()
    if not touched.isEmpty():  # which attributes repeat a name of their owner
        rows = written(rows.select(*S.NODE_COLUMNS, "_named"), "renamed")
        touched = rows.where("_named and kind = 'attribute'").select("doc_id", "parent").distinct()
        same = Window.partitionBy("doc_id", "parent", "name").orderBy("pre")
        again = rows.where("kind = 'attribute'").join(merged(touched), ["doc_id", "parent"], "left_semi").select("doc_id", "pre", (F.row_number().over(same) > 1).alias("_dup"))
        rows = rows.join(merged(again), ["doc_id", "pre"], "left").withColumn("dup", F.coalesce("_dup", "dup"))
    return rows.select(*S.NODE_COLUMNS)


def set_value(nodes: DataFrame, targets: DataFrame, value: Column | str) -> DataFrame:
    """Set values of character data, comments, instructions, doctypes and attributes. Places stay: a join and a projection, and for character data the string values above it anew."""
    hit = F.coalesce("_hit", F.lit(False)) & F.col("kind").isin("pcdata", "cdata", "comment", "pi", "doctype", "attribute")
    rows = _marked(nodes, targets).withColumn("_set", hit)
    rows = rows.withColumn("value", F.when(F.col("_set"), _column(value)).otherwise(F.col("value")))
    own = F.when(F.col("_set") & (F.col("kind") != "doctype") & F.col("sval").isNotNull(), F.col("value")).otherwise(F.col("sval"))
    offset = F.when(F.col("_set") & F.col("kind").isin("pcdata", "cdata", "comment", "doctype"), F.lit(-1)).otherwise(F.col("offset"))
    rows = rows.withColumns({"sval": own, "offset": offset})
    text = F.col("kind").isin("pcdata", "cdata")
    if not rows.where(F.col("_set") & text).isEmpty():
        rows = written(rows.select(*S.NODE_COLUMNS, "_set"), "reset")
        above = lambda df, *more: df.where(text).select("doc_id", *more, F.explode("anc").alias("above"))
        touched = above(rows.where("_set")).distinct()
        texts = above(rows, "pre", "value").join(merged(touched), ["doc_id", "above"], "left_semi").groupBy("doc_id", "above").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda x: x["value"]), "").alias("_texts"))
        rows = rows.join(merged(texts.withColumnRenamed("above", "pre")), ["doc_id", "pre"], "left").withColumn("sval", F.when(F.col("sval").isNotNull(), F.coalesce("_texts", "sval")))
    return rows.select(*S.NODE_COLUMNS)


def _attributes_of(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'attribute'").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.max("pre").alias("last_attribute"))


def _spots(nodes: DataFrame, targets: DataFrame, where: str, attribute: bool) -> DataFrame:
    """(doc_id, pre, _anchor, _level, _depth, ...): after which place a new node comes for each target, and at which level.

    where: append, prepend (targets are the owners), before, after (targets are the siblings). Targets that the rules
    forbid are left out: attributes belong to elements and declarations, children to elements and documents.
    """
    rows = targets.join(merged(nodes.select("doc_id", "pre", "size", "kind", "parent", "anc")), ["doc_id", "pre"]).join(merged(_attributes_of(nodes)), ["doc_id", "pre"], "left")
    last = F.coalesce("last_attribute", "pre")
    if where in ("append", "prepend"):
        owners = ("element", "declaration") if attribute else ("element", "document")
        rows = rows.where(F.col("kind").isin(*owners))
        after = (last if where == "append" else F.col("pre")) if attribute else (F.col("pre") + F.col("size") if where == "append" else last)
        above = F.size("anc")
    else:
        rows = rows.where((F.col("kind") == "attribute") if attribute else (~F.col("kind").isin("attribute", "document")))
        after = F.col("pre") - 1 if where == "before" else F.col("pre") + F.col("size")
        above = F.greatest(F.lit(0), F.size("anc") - 1)
    # what is added at one place comes in the order of calls: later ones at the end sort behind by the deeper level of their owner
    rows = rows.withColumns({"_anchor": after.cast("double") + 0.5, "_level": above + 1, "_depth": (-above).cast("double")})
    return rows.drop("size", "kind", "parent", "anc", "last_attribute")


def _added(nodes: DataFrame, spots: DataFrame, kind: str, name: Column | str, value: Column | str) -> DataFrame:
    place = F.array("_anchor", "_depth", F.col("pre").cast("double"))
    new = spots.select("doc_id", place.alias("place"), F.col("_level").alias("level"), F.lit(kind).alias("kind"), _column(name).alias("name"), _column(value).alias("value"), F.lit(-1).alias("offset"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("error_offset"), F.lit(None).cast("string").alias("encoding"))
    return _numbered(_loose(nodes).unionByName(new))


def insert_attribute(nodes: DataFrame, targets: DataFrame, name: Column | str, value: Column | str = "", where: str = "append") -> DataFrame:
    """A new attribute: append or prepend to the target elements, or before or after the target attributes."""
    return _added(nodes, _spots(nodes, targets, where, True), "attribute", name, value)


def insert_child(nodes: DataFrame, targets: DataFrame, kind: str = "element", name: Column | str = "", value: Column | str = "", where: str = "append") -> DataFrame:
    """A new node: append or prepend to the target elements or documents, or before or after the target nodes. Declarations and doctypes go below documents only; attributes and documents can't be children."""
    if kind in ("attribute", "document"):
        return nodes
    spots = _spots(nodes, targets, where, False)
    if kind in ("declaration", "doctype"):
        spots = spots.where("_level = 1")
    return _added(nodes, spots, kind, name, value)


def set_text(nodes: DataFrame, targets: DataFrame, value: Column | str) -> DataFrame:
    """Set the text of elements: the value of the first child that is character data, or a new child where there is none."""
    from treeloom.operators import navigate

    there = navigate.text(nodes, targets).select("doc_id", "context", F.col("pre").alias("text"))
    own = targets.join(merged(there.withColumnRenamed("context", "pre")), ["doc_id", "pre"], "left")
    changed = set_value(nodes, own.where("text is not null").drop("pre").withColumnRenamed("text", "pre"), value)
    return insert_child(changed, own.where("text is null").drop("text"), "pcdata", "", value)


def insert_copy(nodes: DataFrame, pairs: DataFrame, where: str = "append") -> DataFrame:
    """A deep copy of source for each row of pairs (doc_id, pre, source), placed by pre as in insert_child or insert_attribute; a copy below itself copies what was there. With a column source_doc the source is that document's node."""
    return _placed(nodes, pairs, where, True)


def insert_move(nodes: DataFrame, pairs: DataFrame, where: str = "append") -> DataFrame:
    """Move source to where pre says, within its document. Nothing moves into its own subtree or next to itself."""
    above = nodes.select("doc_id", "pre", F.concat("anc", F.array("pre")).alias("_chain"))
    legal = pairs.join(merged(above), ["doc_id", "pre"]).where(~F.array_contains("_chain", F.col("source"))).drop("_chain")
    return _placed(nodes, legal, where, False)


def _placed(nodes: DataFrame, pairs: DataFrame, where: str, copy: bool) -> DataFrame:
    if "source_doc" not in pairs.columns:
        pairs = pairs.withColumn("source_doc", F.col("doc_id"))
    kinds = nodes.select(F.col("doc_id").alias("source_doc"), F.col("pre").alias("source"), F.col("kind").alias("_kind"), F.size("anc").alias("_top"))
    pairs = pairs.join(merged(kinds), ["source_doc", "source"]).where("_kind <> 'document'")
    attributes = _spots(nodes, pairs.where("_kind = 'attribute'"), where, True)
    children = _spots(nodes, pairs.where("_kind <> 'attribute'"), where, False).where(~F.col("_kind").isin("declaration", "doctype") | (F.col("_level") == 1))
    spots = attributes.unionByName(children).select("doc_id", "pre", "source", "source_doc", "_anchor", "_level", "_depth", "_top").withColumnRenamed("pre", "_target")
    spots = written(spots, "spots")  # read more than once below
    # the subtree of each source, itself included
    tops = spots.select(F.col("source_doc").alias("doc_id"), F.col("source").alias("pre"))
    below = _within(nodes, tops).where("_inside").drop("_inside").withColumnRenamed("doc_id", "source_doc").withColumn("source", F.explode(F.concat("anc", F.array("pre"))))
    inside = below.join(merged(spots), ["source_doc", "source"])
    head = F.array("_anchor", "_depth", F.col("_target").cast("double"), F.col("source").cast("double"), F.col("source_doc").cast("double"))
    new = inside.select("doc_id", F.concat(head, F.array(F.col("pre").cast("double"))).alias("place"), (F.col("_level") + F.size("anc") - F.col("_top")).alias("level"), "kind", "name", "value", F.when(F.lit(copy), F.lit(-1)).otherwise(F.col("offset")).alias("offset"), "status", "error_offset", "encoding")
    rest = _loose(nodes if copy else nodes.join(merged(inside.select("doc_id", "pre")), ["doc_id", "pre"], "left_anti"))
    return _numbered(rest.unionByName(new))


def remove(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Take out attributes, or nodes with all below them; documents stay."""
    gone = targets.where("pre <> 0")
    return _numbered(_loose(_within(nodes, gone).where("not _inside")))


def append_fragments(nodes: DataFrame, fragments: DataFrame, flags: int = S.DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Parse texts and append what they hold to elements or documents.

    fragments has doc_id, pre and xml. Returns the new node table and (doc_id, pre, status): append_invalid_root for
    targets of other kinds. What was parsed before an error is appended.
    """
    from treeloom.sources.shred import shred

    owners = nodes.select("doc_id", "pre", "kind", "size", "anc")
    known = fragments.join(merged(owners), ["doc_id", "pre"])
    good = known.where("kind in ('element', 'document')").withColumn("key", F.xxhash64("doc_id", "pre"))
    below = shred(good.select("key", "xml"), "key", "xml", flags | S.FRAGMENT)
    parsed = below.withColumnRenamed("doc_id", "key").drop("status", "error_offset", "encoding", "size")
    spots = good.select("key", "doc_id", F.col("pre").alias("_target"), F.col("size").alias("_size"), F.col("anc").alias("_anc"))
    inside = parsed.where("kind <> 'document'").join(merged(spots), "key")
    head = F.array((F.col("_target") + F.col("_size")).cast("double") + 0.5, (-F.size("_anc")).cast("double"), F.col("_target").cast("double"))
    new = inside.select("doc_id", F.concat(head, F.array(F.col("pre").cast("double"))).alias("place"), (F.size("_anc") + F.size("anc")).alias("level"), "kind", "name", "value", F.lit(-1).alias("offset"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("error_offset"), F.lit(None).cast("string").alias("encoding"))
    states = below.where("kind = 'document'").select(F.col("doc_id").alias("key"), "status").join(merged(good.select("key", "doc_id", "pre")), "key").select("doc_id", "pre", "status")
    refused = known.where("kind not in ('element', 'document')").select("doc_id", "pre", F.lit("append_invalid_root").alias("status"))
    return _numbered(_loose(nodes).unionByName(new)), states.union(refused)


def copied(nodes: DataFrame, doc_id: Column) -> DataFrame:
    """The documents under another identity."""
    return nodes.withColumn("doc_id", doc_id.cast("long"))


def reset(nodes: DataFrame, targets: DataFrame, prototype: DataFrame | None = None) -> DataFrame:
    """The documents of targets (doc_id) without their nodes, or as copies of the one document of the prototype (a node table)."""
    own = targets.select("doc_id").distinct()
    rest, gone = nodes.join(merged(own), "doc_id", "left_anti"), nodes.join(merged(own), "doc_id", "left_semi").where("kind = 'document'")
    if prototype is None:
        empty = gone.withColumns({"size": F.lit(0), "sval": F.when(F.col("sval").isNotNull(), "")})
        return rest.unionByName(empty.select(*S.NODE_COLUMNS))
    copies = gone.select("doc_id").join(F.broadcast(prototype.drop("doc_id")))  # one document, given by the caller
    return rest.unionByName(copies.withColumn("offset", F.lit(-1)).select(*S.NODE_COLUMNS))
