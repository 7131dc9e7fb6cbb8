"""Node tables to XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.tables import merged

#: Format flags. Fixed values.
INDENT, WRITE_BOM, RAW, NO_DECLARATION, NO_ESCAPES, SAVE_FILE_TEXT = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20
DEFAULT = INDENT


def _replaced(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def escaped(s: Column, attribute: bool) -> Column:
    """References for & < > and control characters; in attributes also for quotes and line ends, but not for tabs."""
    kept = "\t" if attribute else "\t\r\n"
    controls = [(chr(c), f"&#{c:02d};") for c in range(1, 32) if chr(c) not in kept]
    plain = _replaced(s, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if attribute else []))
    return F.when(s.rlike("[\\x01-\\x1f]"), _replaced(plain, controls)).otherwise(plain)


def cdata(s: Column) -> Column:
    """A CDATA section; the end mark inside is split between two sections."""
    return F.concat(F.lit("<![CDATA["), F.replace(s, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def comment(s: Column) -> Column:
    """A comment; a blank keeps hyphens apart, and the last one from the end mark."""
    apart = F.regexp_replace(F.regexp_replace(s, "-(?=-)", "- "), "-$", "- ")
    return F.concat(F.lit("<!--"), apart, F.lit("-->"))


def _named(name: Column) -> Column:
    return F.when(F.length(name) == 0, ":anonymous").otherwise(name)


def pieces(nodes: DataFrame, indent: str = "\t", flags: int = DEFAULT, base: int = 1) -> DataFrame:
    """(doc_id, at, closes, text): the stretches of output in order; base is the level that isn't indented."""
    raw, bare = bool(flags & RAW), bool(flags & NO_ESCAPES)
    attribute = lambda s: s if bare else escaped(s, True)
    content = lambda s: s if bare else escaped(s, False)
    kind, name, value = F.col("kind"), F.col("name"), F.col("value")
    given = nodes.where("kind = 'attribute'").select("doc_id", F.col("parent").alias("pre"), F.struct("ord", F.concat(F.lit(" "), _named(name), F.lit('="'), attribute(value), F.lit('"')).alias("t")).alias("a"))
    lists = given.groupBy("doc_id", "pre").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("a")), lambda x: x["t"])).alias("attrs"))
    below = nodes.where("kind <> 'attribute'").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("kind", "value"), F.col("pre")).alias("only"))
    rows = nodes.where("kind not in ('attribute', 'document')").join(merged(lists), ["doc_id", "pre"], "left").join(merged(below), ["doc_id", "pre"], "left")
    parents = below.where("n = 1 and only.kind in ('pcdata', 'cdata')").select("doc_id", F.col("pre").alias("parent"), F.lit(True).alias("inline"))
    rows = rows.join(merged(parents.join(merged(nodes.where("kind = 'element'").select("doc_id", F.col("pre").alias("parent"))), ["doc_id", "parent"])), ["doc_id", "parent"], "left")
    rows = rows.where("inline is null")  # the only text of an element goes into its parent's stretch
    attrs = F.coalesce("attrs", F.lit(""))
    inner = F.when(F.col("only.kind") == "cdata", cdata(F.col("only.value"))).otherwise(content(F.col("only.value")))
    tag = F.concat(F.lit("<"), _named(name), attrs)
    element = F.when(F.col("n").isNull(), F.concat(tag, F.lit(" />"))).when((F.col("n") == 1) & F.col("only.kind").isin("pcdata", "cdata"), F.concat(tag, F.lit(">"), inner, F.lit("</"), _named(name), F.lit(">"))).otherwise(F.concat(tag, F.lit(">")))
    spaced = F.when(F.length(value) > 0, F.concat(F.lit(" "), value)).otherwise("")
    opening = (
        F.when(kind == "element", element).when(kind == "pcdata", content(value)).when(kind == "cdata", cdata(value)).when(kind == "comment", comment(value))
        .when(kind == "pi", F.concat(F.lit("<?"), _named(name), spaced, F.lit("?>"))).when(kind == "declaration", F.concat(F.lit("<?"), _named(name), attrs, F.lit("?>")))
        .otherwise(F.concat(F.lit("<!DOCTYPE"), spaced, F.lit(">")))
    )
    before = F.repeat(F.lit(indent), F.col("level") - base) if flags & INDENT and not raw else F.lit("")
    end = "" if raw else "\n"
    opens = rows.select("doc_id", F.struct(F.col("pre").alias("p"), F.lit(0).alias("c"), F.lit(0).alias("l")).alias("at"), F.concat(before, opening, F.lit(end)).alias("text"))
    wide = rows.where((kind == "element") & (F.col("n") > 0) & ~((F.col("n") == 1) & F.col("only.kind").isin("pcdata", "cdata")))
    closes = wide.select("doc_id", F.struct((F.col("pre") + F.col("size")).alias("p"), F.lit(1).alias("c"), (-F.col("level")).alias("l")).alias("at"), F.concat(before, F.lit("</"), _named(name), F.lit(f">{end}")).alias("text"))
    return opens.union(closes)


def _joined(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])).alias("xml"))


def save(nodes: DataFrame, indent: str = "\t", flags: int = DEFAULT) -> DataFrame:
    """(doc_id, xml) of whole documents; a declaration is put first unless there is one or the flags say no."""
    texts = nodes.where("kind = 'document'").select("doc_id").join(merged(_joined(pieces(nodes, indent, flags))), "doc_id", "left")
    first = nodes.where("level = 1 and kind = 'element'").groupBy("doc_id").agg(F.min("pre").alias("f"))
    declared = nodes.where("level = 1 and kind = 'declaration'").groupBy("doc_id").agg(F.min("pre").alias("d"))
    line = '<?xml version="1.0"?>' + ("" if flags & RAW else "\n")
    has = F.col("d").isNotNull() & (F.col("f").isNull() | (F.col("d") < F.col("f")))
    head = F.lit("") if flags & NO_DECLARATION else F.when(has, "").otherwise(line)
    mark = "﻿" if flags & WRITE_BOM else ""
    rows = texts.join(merged(first), "doc_id", "left").join(merged(declared), "doc_id", "left")
    return rows.select("doc_id", F.concat(F.lit(mark), head, F.coalesce("xml", F.lit(""))).alias("xml"))


def printed(nodes: DataFrame, contexts: DataFrame, indent: str = "\t", flags: int = DEFAULT, depth: int = 0) -> DataFrame:
    """(doc_id, context, xml) of the subtrees of contexts, without a declaration."""
    own = contexts.select("doc_id", F.col("pre").alias("context")).distinct().join(merged(nodes.select("doc_id", F.col("pre").alias("context"), F.col("level").alias("top"), F.col("kind").alias("of"))), ["doc_id", "context"])
    tagged = nodes.withColumn("context", F.explode(F.concat("anc", F.array("pre"))))
    inside = own.join(merged(tagged), ["doc_id", "context"])
    # a subtree is written as a document of its own, with its root at the level of document elements
    low = F.when(F.col("of") == "document", F.lit(0)).otherwise(F.col("top") - 1 - depth)
    whole = inside.withColumns({"doc": F.struct("doc_id", "context"), "level": F.col("level") - low}).withColumn("parent", F.when(F.col("pre") == F.col("context"), F.lit(-1)).otherwise(F.col("parent")))
    out = _joined(pieces(whole.drop("doc_id").withColumnRenamed("doc", "doc_id"), indent, flags))
    return out.select("doc_id.doc_id", "doc_id.context", "xml")


def save_files(nodes: DataFrame, folder: str, indent: str = "\t", flags: int = DEFAULT, encoding: str = "utf8") -> DataFrame:
    """Write each document to a file of its own, doc_id.xml; (doc_id, target, n_bytes) of all files."""
    from treeloom.session import written
    from treeloom.sources import sinks

    texts = save(nodes, indent, flags & ~WRITE_BOM)
    return written(sinks.deliver(texts, sinks.files(folder), encoding, bool(flags & WRITE_BOM)), "saved")


def encoded(texts: DataFrame, encoding: str = "utf8", bom: bool = False, column: str = "xml") -> DataFrame:
    """texts with the column as bytes of an encoding."""
    from treeloom.session import ship
    from treeloom.sources import encoding as E

    ship(texts.sparkSession)

    @F.pandas_udf("binary")
    def run(values):  # noqa: ANN001, ANN202
        return values.map(lambda t: E.encode(t, encoding, bom))

    return texts.withColumn(column, run(column))
