"""The node table, parse flags and parse statuses."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = ["document", "element", "pcdata", "cdata", "comment", "pi", "declaration", "doctype", "attribute"]

#: Parse flags. Fixed values.
PI, COMMENTS, CDATA, WS_PCDATA, ESCAPES, EOL, WCONV_ATTRIBUTE, WNORM_ATTRIBUTE, DECLARATION, DOCTYPE, WS_PCDATA_SINGLE, TRIM_PCDATA, FRAGMENT = (
    0x0001, 0x0002, 0x0004, 0x0008, 0x0010, 0x0020, 0x0040, 0x0080, 0x0100, 0x0200, 0x0400, 0x0800, 0x1000,
)
MINIMAL = 0
DEFAULT = CDATA | ESCAPES | WCONV_ATTRIBUTE | EOL
FULL = DEFAULT | PI | COMMENTS | DECLARATION | DOCTYPE

#: Parse statuses with their codes and messages. Fixed values.
STATUSES = [
    ("ok", "No error"),
    ("file_not_found", "File was not found"),
    ("io_error", "Error reading from file/stream"),
    ("out_of_memory", "Could not allocate memory"),
    ("internal_error", "Internal error occurred"),
    ("unrecognized_tag", "Could not determine tag type"),
    ("bad_pi", "Error parsing document declaration/processing instruction"),
    ("bad_comment", "Error parsing comment"),
    ("bad_cdata", "Error parsing CDATA section"),
    ("bad_doctype", "Error parsing document type declaration"),
    ("bad_pcdata", "Error parsing PCDATA section"),
    ("bad_start_element", "Error parsing start element tag"),
    ("bad_attribute", "Error parsing element attribute"),
    ("bad_end_element", "Error parsing end element tag"),
    ("end_element_mismatch", "Start-end tags mismatch"),
    ("append_invalid_root", "Unable to append nodes: root is not an element or document"),
    ("no_document_element", "No document element found"),
]
CODES = {name: code for code, (name, _) in enumerate(STATUSES)}

#: One row a node. pre is the document order (the document is 0, attributes follow their owner), the subtree of a node is pre + 1 .. pre + size;
#: anc holds the pre of all ancestors, root first; dup marks an attribute whose name an earlier one of its owner has;
#: status, error_offset and encoding are those of the document, on its own row.
NODES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("pre", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("nsib", T.IntegerType()),
        T.StructField("anc", T.ArrayType(T.IntegerType())),
        T.StructField("sval", T.StringType()),
        T.StructField("offset", T.IntegerType()),
        T.StructField("dup", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_offset", T.IntegerType()),
        T.StructField("encoding", T.StringType()),
    ]
)
NODE_COLUMNS = NODES.fieldNames()
