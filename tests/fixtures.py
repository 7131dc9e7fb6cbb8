"""Own documents, and queries with what the rules of XPath 1.0 give over them. Nodes are named by their place (pre) in document order."""

#: 1 garden 2 @name 3 bed 4 @no 5 rose 6 fern 7 path 8 bed 9 @no 10 fern 11 moss 12 spore 13 gate
GARDEN = "<garden name='east'><bed no='1'><rose/><fern/></bed><path/><bed no='2'><fern/><moss><spore/></moss></bed><gate/></garden>"
#: 1 box 2 box 3 box 4 lid 5 box
BOXES = "<box><box><box/><lid/></box><box/></box>"
#: 1 m 2 text 3 CDATA 4 comment 5 instruction 6 b 7 text 8 text
MIXED = "<m>one<![CDATA[two]]><!--note--><?go far?><b>three</b>four</m>"
#: 1 r 2 3 namespaces 4 k:a 5 @k:v 6 @w 7 k:b 8 a 9 j:a
SPACES = "<r xmlns='urn:one' xmlns:k='urn:two'><k:a k:v='1' w='2'/><k:b/><a/><j:a/></r>"
#: 1 u 2 @a 3 @b 4 @a again
TWICE = "<u a='1' b='2' a='3'/>"
#: 1 set 2 x 3 @v 4 x 5 @v 6 y 7 @v 8 z 9 @v
VALUES = "<set><x v='4'/><x v='9'/><y v='7'/><z v='n'/></set>"
#: 1 l 2 text 3 m 4 text 5 m 6 text
LEDGER = "<l>10<m>5</m><m>x</m></l>"
#: 1 d 2 @xml:lang 3 p 4 q 5 p 6 @xml:lang
TONGUES = "<d xml:lang='de-AT'><p><q/></p><p xml:lang='fr'/></d>"

#: (document, context, query, places of the result in document order)
NODE_SETS = [
    (GARDEN, 1, "child::node()", [3, 7, 8, 13]),
    (GARDEN, 2, "child::node()", []),
    (GARDEN, 2, "..", [1]),
    (GARDEN, 0, "descendant::node()", [1, 3, 5, 6, 7, 8, 10, 11, 12, 13]),
    (GARDEN, 8, "descendant-or-self::node()", [8, 10, 11, 12]),
    (GARDEN, 12, "ancestor::node()", [0, 1, 8, 11]),
    (GARDEN, 12, "ancestor::*[2]", [8]),
    (GARDEN, 9, "ancestor-or-self::node()", [0, 1, 8, 9]),
    (GARDEN, 9, "ancestor-or-self::*", [1, 8]),
    (GARDEN, 4, "following::node()", [5, 6, 7, 8, 10, 11, 12, 13]),
    (GARDEN, 3, "following::node()", [7, 8, 10, 11, 12, 13]),
    (GARDEN, 4, "preceding::node()", []),
    (GARDEN, 9, "preceding::node()", [3, 5, 6, 7]),
    (GARDEN, 10, "preceding::*", [3, 5, 6, 7]),
    (GARDEN, 12, "preceding::node()[1]", [10]),
    (GARDEN, 5, "following::fern", [6, 10]),
    (GARDEN, 5, "following::fern[2]", [10]),
    (GARDEN, 7, "following-sibling::*", [8, 13]),
    (GARDEN, 13, "preceding-sibling::*[2]", [7]),
    (GARDEN, 13, "preceding-sibling::bed", [3, 8]),
    (GARDEN, 4, "following-sibling::node()", []),
    (GARDEN, 0, "//@*", [2, 4, 9]),
    (GARDEN, 0, "//fern/..", [3, 8]),
    (GARDEN, 0, "//fern[1]", [6, 10]),
    (GARDEN, 0, "(//fern)[2]", [10]),
    (GARDEN, 0, "garden/*[fern]", [3, 8]),
    (GARDEN, 0, "garden/*[not(fern)]", [7, 13]),
    (GARDEN, 0, "garden/*[last()]", [13]),
    (GARDEN, 0, "garden/*[position() < 3]", [3, 7]),
    (GARDEN, 0, "garden/*[position() = last() - 1]", [8]),
    (GARDEN, 0, "garden/bed[last()]", [8]),
    (GARDEN, 0, "garden/bed[last() - 1]", [3]),
    (GARDEN, 0, "garden/bed[1.5]", []),
    (GARDEN, 0, "//bed[fern][2]", [8]),
    (GARDEN, 0, "//bed[2][moss]", [8]),
    (GARDEN, 0, "//bed[@no = 2]/*", [10, 11]),
    (GARDEN, 0, "//*[@no > //bed[1]/@no]", [8]),
    (GARDEN, 0, "//fern[../moss]", [10]),
    (GARDEN, 0, "//bed/fern[following-sibling::moss]", [10]),
    (GARDEN, 0, "//moss | //rose | //moss", [5, 11]),
    (GARDEN, 0, "//bed/* | //bed/@no", [4, 5, 6, 9, 10, 11]),
    (GARDEN, 12, "/garden/gate", [13]),
    (GARDEN, 0, "/", [0]),
    (GARDEN, 8, "*/*", [12]),
    (GARDEN, 1, ".//fern", [6, 10]),
    (GARDEN, 0, "//..", [0, 1, 3, 8, 11]),
    (GARDEN, 0, "//*/preceding::*", [3, 5, 6, 7, 8, 10, 11, 12]),
    (GARDEN, 0, "//*/following::*", [6, 7, 8, 10, 11, 12, 13]),
    (GARDEN, 0, "//fern/preceding::*", [3, 5, 6, 7]),
    (GARDEN, 0, "//fern/following::bed", [8]),
    (GARDEN, 0, "//bed/following-sibling::*", [7, 8, 13]),
    (GARDEN, 0, "//bed/preceding-sibling::*", [3, 7]),
    (GARDEN, 0, "//bed/preceding-sibling::*[1]", [7]),
    (GARDEN, 0, "//bed/following-sibling::*[1]", [7, 13]),
    (GARDEN, 0, "//*[preceding-sibling::bed]", [7, 8, 13]),
    (GARDEN, 0, "//*[@no = following-sibling::*/@no]", []),
    (GARDEN, 1, "namespace::node()", []),
    (GARDEN, 0, "id('east')", []),
    (BOXES, 0, "//box[1]", [1, 2, 3]),
    (BOXES, 0, "//box[last()]", [1, 3, 5]),
    (BOXES, 0, "/descendant::box[2]", [2]),
    (BOXES, 0, "//box/box", [2, 3, 5]),
    (BOXES, 0, "(//box)[last()]", [5]),
    (BOXES, 3, "ancestor::box[last()]", [1]),
    (MIXED, 1, "text()", [2, 3, 8]),
    (MIXED, 1, "comment()", [4]),
    (MIXED, 1, "processing-instruction()", [5]),
    (MIXED, 1, "processing-instruction('go')", [5]),
    (MIXED, 1, "processing-instruction('stop')", []),
    (MIXED, 1, "node()", [2, 3, 4, 5, 6, 8]),
    (MIXED, 1, "*", [6]),
    (MIXED, 0, "//text()", [2, 3, 7, 8]),
    (MIXED, 1, "b/preceding-sibling::text()[1]", [3]),
    (MIXED, 4, "following-sibling::node()[2]", [6]),
    (SPACES, 1, "k:*", [4, 7]),
    (SPACES, 1, "k:a", [4]),
    (SPACES, 1, "a", [8]),
    (SPACES, 1, "@*", []),
    (SPACES, 1, "@xmlns", []),
    (SPACES, 4, "@k:*", [5]),
    (SPACES, 4, "@w", [6]),
    (TWICE, 1, "@a", [2]),
    (TWICE, 1, "@*", [2, 3, 4]),
    (VALUES, 1, "x[@v < ../y/@v]", [2]),
    (VALUES, 1, "*[@v > 4]", [4, 6]),
    (VALUES, 1, "*[@v != 4]", [4, 6, 8]),
    (VALUES, 1, "*[@v != 4][2]", [6]),
    (VALUES, 1, "*[@v < following-sibling::*/@v]", [2]),
    (VALUES, 1, "*[@v > preceding-sibling::*/@v]", [4, 6]),
]

#: (document, context, query, number)
NUMBERS = [
    (LEDGER, 1, "sum(m)", float("nan")),
    (LEDGER, 1, "sum(m[1])", 5.0),
    (LEDGER, 1, "sum(text())", 10.0),
    (LEDGER, 1, "sum(none)", 0.0),
    (LEDGER, 1, "string-length()", 4.0),
    (LEDGER, 3, "number()", 5.0),
    (LEDGER, 1, "-m | m[1]", -5.0),
    (LEDGER, 0, "number('  -7.25 ')", -7.25),
    (LEDGER, 0, "number('.5')", 0.5),
    (LEDGER, 0, "number('7e2')", float("nan")),
    (LEDGER, 0, "number('+7')", float("nan")),
    (LEDGER, 0, "number(true())", 1.0),
    (LEDGER, 0, "-9 mod 4", -1.0),
    (LEDGER, 0, "9 mod -4", 1.0),
    (LEDGER, 0, "2.5 mod 1", 0.5),
    (LEDGER, 0, "3--4", 7.0),
    (LEDGER, 0, "-(1 + 2)", -3.0),
    (LEDGER, 0, "6 div 4 * 2 - 1", 2.0),
    (LEDGER, 0, "round(2.5)", 3.0),
    (LEDGER, 0, "round(-2.5)", -2.0),
    (LEDGER, 0, "floor(-0.1)", -1.0),
    (LEDGER, 0, "ceiling(0.1) + floor(1.9)", 2.0),
    (GARDEN, 0, "count(//*)", 10.0),
    (GARDEN, 0, "count(//bed/@no | //fern)", 4.0),
    (GARDEN, 0, "string-length(name(//bed/*[2]))", 4.0),
]

#: (document, context, query, string)
STRINGS = [
    (LEDGER, 0, "3 div 0", "Infinity"),
    (LEDGER, 0, "-3 div 0", "-Infinity"),
    (LEDGER, 0, "3 mod 0", "NaN"),
    (LEDGER, 0, "substring('garden', 2, 3)", "ard"),
    (LEDGER, 0, "substring('garden', 2.5, 2)", "rd"),
    (LEDGER, 0, "substring('garden', 0, 3)", "ga"),
    (LEDGER, 0, "substring('garden', 3)", "rden"),
    (LEDGER, 0, "substring('garden', 9)", ""),
    (LEDGER, 0, "substring('garden', number('x'))", ""),
    (LEDGER, 0, "substring('garden', -1 div 0, 1 div 0)", ""),
    (LEDGER, 0, "substring('garden', -5, 1 div 0)", "garden"),
    (LEDGER, 0, "substring-before('a-b-c', '-')", "a"),
    (LEDGER, 0, "substring-before('rose', 'z')", ""),
    (LEDGER, 0, "substring-before('rose', '')", ""),
    (LEDGER, 0, "substring-after('a-b-c', '-')", "b-c"),
    (LEDGER, 0, "substring-after('rose', '')", "rose"),
    (LEDGER, 0, "translate('fern', 'ef', 'EF')", "FErn"),
    (LEDGER, 0, "translate('a-b-c', '-', '')", "abc"),
    (LEDGER, 0, "translate('noon', 'oo', '12')", "n11n"),
    (LEDGER, 1, "translate('mint', m[2], 'y')", "mint"),
    (LEDGER, 1, "translate('six', m[2], concat('', 'p'))", "sip"),
    (LEDGER, 0, "normalize-space('  wet \t moss\n')", "wet moss"),
    (LEDGER, 3, "normalize-space()", "5"),
    (LEDGER, 0, "string(0.5 + 0.25)", "0.75"),
    (LEDGER, 0, "string(250000000000)", "250000000000"),
    (LEDGER, 0, "string(1 div 3 < 1)", "true"),
    (LEDGER, 0, "string(-0.0625)", "-0.0625"),
    (LEDGER, 0, "concat('n', 2, true())", "n2true"),
    (LEDGER, 1, "string()", "105x"),
    (LEDGER, 1, "string(m)", "5"),
    (LEDGER, 1, "string(none)", ""),
    (GARDEN, 0, "name((//bed)[2]/*[1])", "fern"),
    (GARDEN, 11, "name()", "moss"),
    (GARDEN, 9, "local-name()", "no"),
    (GARDEN, 0, "string(//bed[2]/@no)", "2"),
    (MIXED, 0, "string(/m)", "onetwothreefour"),
    (MIXED, 0, "string(//comment())", "note"),
    (MIXED, 0, "string(//processing-instruction())", "far"),
    (MIXED, 5, "name()", "go"),
    (SPACES, 0, "namespace-uri(/*)", "urn:one"),
    (SPACES, 0, "namespace-uri(/*/*[1])", "urn:two"),
    (SPACES, 8, "namespace-uri()", "urn:one"),
    (SPACES, 0, "namespace-uri(//@k:v)", "urn:two"),
    (SPACES, 0, "namespace-uri(//@w)", ""),
    (SPACES, 0, "local-name(/*/*[2])", "b"),
    (SPACES, 0, "name(/*/*[2])", "k:b"),
    (SPACES, 0, "local-name(//@k:v)", "v"),
]

#: (document, context, query, truth)
TRUTHS = [
    (TONGUES, 4, "lang('de')", True),
    (TONGUES, 4, "lang('DE-at')", True),
    (TONGUES, 4, "lang('at')", False),
    (TONGUES, 5, "lang('fr')", True),
    (TONGUES, 5, "lang('de')", False),
    (TONGUES, 0, "lang('de')", False),
    (LEDGER, 0, "number('x') < 1", False),
    (LEDGER, 0, "number('x') = number('x')", False),
    (LEDGER, 0, "number('x') != number('x')", True),
    (VALUES, 1, "x/@v = 9", True),
    (VALUES, 1, "x/@v != 9", True),
    (VALUES, 1, "x/@v > 9", False),
    (VALUES, 1, "x/@v >= 9", True),
    (VALUES, 1, "9 > x/@v", True),
    (VALUES, 1, "x/@v = y/@v", False),
    (VALUES, 1, "x/@v < y/@v", True),
    (VALUES, 1, "x/@v > y/@v", True),
    (VALUES, 1, "y/@v != y/@v", False),
    (VALUES, 1, "x/@v != x/@v", True),
    (VALUES, 1, "z/@v < 100", False),
    (VALUES, 1, "y/@v = '7'", True),
    (VALUES, 1, "y/@v = string(y/@v)", True),
    (VALUES, 1, "x/@v > true()", True),
    (VALUES, 1, "x = true()", True),
    (VALUES, 1, "nothing = 1", False),
    (VALUES, 1, "nothing != 1", False),
    (VALUES, 1, "nothing = nothing", False),
    (VALUES, 1, "nothing = false()", True),
    (VALUES, 1, "x and y", True),
    (VALUES, 1, "x and nothing", False),
    (VALUES, 1, "nothing or z", True),
    (VALUES, 1, "not(x)", False),
    (LEDGER, 0, "boolean('')", False),
    (LEDGER, 0, "boolean('0')", True),
    (LEDGER, 0, "boolean(0 div 0)", False),
    (LEDGER, 0, "false() or true()", True),
    (LEDGER, 0, "1 = '1'", True),
    (LEDGER, 0, "true() = 'no'", True),
    (LEDGER, 0, "contains('moss', 'os')", True),
    (LEDGER, 0, "starts-with('moss', 'os')", False),
    (LEDGER, 0, "starts-with('moss', '')", True),
]

BAD_QUERIES = [
    "", "garden[", "garden]", "garden//", "//[2]", "@", "@@no", "sideways::bed", "bed::", "@child::bed", "count()", "count(1)", "concat('x')", "sum('x')", "string(1, 2)", "nothing()",
    "text(1)", "processing-instruction(2)", "bed |", "bed | 3", "3[1]", "..[2]", "'open", '"open', "$", "$q", "1 +", "+ 1", "(1", "1)", "bed bed", "k:", "3mod2", "position(1)", "bed[", "(3)/bed",
]

#: (text, extra flags by name, status, offset)
STATUSES = [
    ("<leaf/>", [], "ok", 0), ("", [], "no_document_element", 0), ("just words", [], "no_document_element", 10), ("<7up/>", [], "unrecognized_tag", 1), ("x <", [], "unrecognized_tag", 2),
    ("<?ink", ["PI"], "bad_pi", 4), ("<!--open", ["COMMENTS"], "bad_comment", 4), ("<![CDATA[open]", [], "bad_cdata", 9), ("<!DOCTYPE tree [", [], "bad_doctype", 15), ("<stem", [], "bad_start_element", 4),
    ("<stem*/>", [], "bad_start_element", 6), ("<stem len=3/>", [], "bad_attribute", 10), ("<stem len='3/>", [], "bad_attribute", 11), ("<s></s!>", [], "bad_end_element", 6),
    ("<oak></oat>", [], "end_element_mismatch", 10), ("<oak><bark></oak>", [], "end_element_mismatch", 14),
]
