import fixtures as X
import pytest

from treeloom import schema as S
from treeloom.sources import encoding as E
from treeloom.sources.parser import parse, parse_fragment


def kinds(tree, kind):
    return [v for k, v in zip(tree.kind, tree.value, strict=True) if k == kind]


@pytest.mark.parametrize(("text", "flags", "status", "offset"), X.STATUSES)
def test_statuses(text, flags, status, offset):
    given = S.DEFAULT
    for f in flags:
        given |= getattr(S, f)
    tree = parse(text, given)
    assert (tree.status, tree.error_offset) == (status, offset)


def test_numbering():
    rows = parse(X.GARDEN).rows(1)
    assert [(r[1], r[2], r[3], r[4], r[8], r[10]) for r in rows] == [
        (0, 13, 0, None, 1, []), (1, 12, 1, 0, 1, [0]), (2, 0, 2, 1, 1, [0, 1]), (3, 3, 2, 1, 1, [0, 1]), (4, 0, 3, 3, 1, [0, 1, 3]), (5, 0, 3, 3, 1, [0, 1, 3]), (6, 0, 3, 3, 2, [0, 1, 3]),
        (7, 0, 2, 1, 2, [0, 1]), (8, 4, 2, 1, 3, [0, 1]), (9, 0, 3, 8, 1, [0, 1, 8]), (10, 0, 3, 8, 1, [0, 1, 8]), (11, 1, 3, 8, 2, [0, 1, 8]), (12, 0, 4, 11, 1, [0, 1, 8, 11]), (13, 0, 2, 1, 4, [0, 1]),
    ]


@pytest.mark.parametrize(
    ("text", "flags", "values"),
    [
        ("<t>&#65;&#x42;&#x63;&#8364;</t>", S.ESCAPES, ["ABc€"]),
        ("<t>&#q; &#xZ; &#4x; &# &amp</t>", S.ESCAPES, ["&#q; &#xZ; &#4x; &# &amp"]),
        ("<t>&lt;b&gt; &amp;&amp; &quot;&apos;&nbsp;</t>", S.ESCAPES, ["<b> && \"'&nbsp;"]),
        ("<t>&lt;b&gt;</t>", 0, ["&lt;b&gt;"]),
        ("<t>up\r\ndown\rside\n</t>", S.EOL, ["up\ndown\nside\n"]),
        ("<t>up\r\ndown\rside\n</t>", 0, ["up\r\ndown\rside\n"]),
        ("<t> \n left  right\t</t>", S.TRIM_PCDATA, ["left  right"]),
        ("<t>\n<i/>\t<i/></t>", S.WS_PCDATA, ["\n", "\t"]),
        ("<t>\n<i/>\t<i/></t>", 0, []),
        ("<t>  <i>   </i>  </t>", S.WS_PCDATA_SINGLE, ["   "]),
        ("<t>  <i>   </i>  </t>", S.WS_PCDATA | S.TRIM_PCDATA, []),
        ("loose<t/>ends", S.DEFAULT, []),
        ("loose<t/>ends", S.DEFAULT | S.FRAGMENT, ["loose", "ends"]),
    ],
)
def test_character_data(text, flags, values):
    assert kinds(parse(text, flags), "pcdata") == values


@pytest.mark.parametrize(("flags", "value"), [(S.WNORM_ATTRIBUTE, "one two three"), (S.WCONV_ATTRIBUTE, "   one two   three "), (S.EOL, "  \tone\ntwo \n three\n"), (0, "  \tone\r\ntwo \r three\n")])
def test_attribute_values(flags, value):
    assert kinds(parse('<t words="  \tone\r\ntwo \r three\n"/>', flags), "attribute") == [value]


def test_other_kinds():
    text = "<?xml encoding='utf-8'?><!DOCTYPE tree [<!ELEMENT leaf (#PCDATA)> <?note > ?> <!-- ]> -->]><!--first\r\nlast--><?water  every day?><tree><![CDATA[a < b]]></tree>"
    tree = parse(text, S.FULL)
    assert tree.status == "ok"
    assert tree.kind == ["document", "declaration", "attribute", "doctype", "comment", "pi", "element", "cdata"]
    assert tree.value[3].startswith("tree [<!ELEMENT") and tree.value[3].endswith("-->]") and tree.value[4] == "first\nlast" and (tree.name[5], tree.value[5]) == ("water", "every day") and tree.value[7] == "a < b"
    assert parse(text).kind == ["document", "element", "cdata"] and parse(text, S.MINIMAL).kind == ["document", "element"]
    assert parse("<tree><!DOCTYPE leaf></tree>").status == "bad_doctype" and parse("<tree><?xml?></tree>", S.FULL).status == "bad_pi"


def test_partial_tree_survives():
    tree = parse("<tree><leaf hue='red'>maple</leaf><root></tree>")
    assert tree.status == "end_element_mismatch" and tree.name[1:] == ["tree", "leaf", "hue", "", "root"]


def test_several_roots_and_duplicates():
    tree = parse("<oak age='9' age='90'/><elm/>")
    assert tree.status == "ok" and [r[13] for r in tree.rows(1)] == [False, False, False, True, False]


def test_depth_needs_no_recursion():
    n = 3000
    tree = parse("<twig>" * n + "</twig>" * n)
    assert tree.status == "ok" and len(tree.rows(1, string_values=False)) == n + 1


def test_fragment_of_an_element():
    tree = parse_fragment("sap<bark/>", "oak")
    assert tree.status == "ok" and tree.kind == ["element", "pcdata", "element"]


#: Byte order marks by encoding.
MARKS = {"utf8": b"\xef\xbb\xbf", "utf16_le": b"\xff\xfe", "utf16_be": b"\xfe\xff", "utf32_le": b"\xff\xfe\x00\x00", "utf32_be": b"\x00\x00\xfe\xff"}


@pytest.mark.parametrize("encoding", MARKS)
@pytest.mark.parametrize("text", ["<leaf>é漢</leaf>", "<?xml version='1.0'?><leaf>é漢</leaf>"])
def test_encodings(encoding, text):
    """Bytes are recognised by their mark, or by how '<' or '<?' look."""
    data = text.encode(encoding.replace("utf", "utf-").replace("_", "-"))
    assert E.decode(MARKS[encoding] + data) == (text, encoding) and E.decode(data) == (text, encoding)
    assert E.encode(text, encoding) == data and E.encode(text, encoding, bom=True) == MARKS[encoding] + data


def test_invalid_bytes_are_left_out():
    assert E.decode(b"<leaf>gre\xff\xfeen</leaf>")[0] == "<leaf>green</leaf>"
    assert E.decode(b"<leaf>caf\xe9</leaf>", "latin1")[0] == "<leaf>café</leaf>" and E.encode("café 5€", "latin1") == b"caf\xe9 5?"
