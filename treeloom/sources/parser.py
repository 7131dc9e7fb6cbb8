"""A tolerant XML parser: text to the columns of the node table.

Parsing stops at the first error, and the tree up to there is kept with a status and an offset. Several root elements
and repeated attributes are allowed; end tags are compared as text. There is no recursion, so depth is unbounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa

from treeloom import schema as S
from treeloom.sources import columns as C

_NAME = re.compile(r"[A-Za-z_:\x80-\U0010ffff][A-Za-z_:\x80-\U0010ffff0-9.\-]*")
_SYMBOLS = re.compile(r"[A-Za-z_:\x80-\U0010ffff0-9.\-]*")
_SPACE = re.compile(r"[ \t\r\n]*")
_REFERENCE = re.compile(r"&(?:#x([0-9a-fA-F]+);|#([0-9]+);|(lt|gt|amp|apos|quot);)")
_LINE_END = re.compile(r"\r\n?")
_CONVERTED = re.compile(r"[&\t\r\n]")
#: A start tag of attributes in double quotes, one blank before each, without anything to be converted in them; and its attributes.
_PLAIN_TAG = re.compile(r"([A-Za-z_:\x80-\U0010ffff][A-Za-z_:\x80-\U0010ffff0-9.\-]*+)((?: [A-Za-z_:\x80-\U0010ffff][A-Za-z_:\x80-\U0010ffff0-9.\-]*+=\"[^\"&\t\r\n]*+\")*+)(/?)>")
_PLAIN_ATTRIBUTE = re.compile(r" ([^=]+)=\"([^\"]*)\"")
_BLANKS = " \t\r\n"

#: The predefined entities.
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}


def _reference(m: re.Match) -> str:
    if m[3]:
        return ENTITIES[m[3]]
    code = (int(m[1], 16) if m[1] else int(m[2])) % (1 << 32)
    # NUL, surrogates and what lies beyond Unicode have no place in a string column
    return chr(code) if 0 < code < 0xD800 or 0xDFFF < code < 0x110000 else ""


def expand(text: str) -> str:
    """Character and predefined entity references replaced; others stay as they are."""
    return _REFERENCE.sub(_reference, text) if "&" in text else text


def text_converter(flags: int) -> Callable[[str], str]:
    """What the flags ask for character data."""

    def convert(text: str) -> str:
        if flags & S.EOL and "\r" in text:
            text = _LINE_END.sub("\n", text)
        if flags & S.ESCAPES:
            text = expand(text)
        return text.rstrip(_BLANKS) if flags & S.TRIM_PCDATA else text

    return convert


def attribute_converter(flags: int) -> Callable[[str], str]:
    """What the flags ask for attribute values; normalisation goes before conversion of blanks, and both before line ends."""

    def convert(text: str) -> str:
        if not flags & S.WNORM_ATTRIBUTE and not _CONVERTED.search(text):
            return text
        if flags & S.WNORM_ATTRIBUTE:
            text = re.sub(r"[ \t\r\n]+", " ", text).strip(" ")
        elif flags & S.WCONV_ATTRIBUTE:
            text = re.sub(r"\r\n|[\t\r\n]", " ", text)
        elif flags & S.EOL and "\r" in text:
            text = _LINE_END.sub("\n", text)
        return expand(text) if flags & S.ESCAPES else text

    return convert


class _Failure(Exception):
    def __init__(self, status: str, at: int) -> None:
        super().__init__(status)
        self.status, self.at = status, at


@dataclass
class Tree:
    """Columns of the nodes of one document, by pre; parent is -1 for the document."""

    kind: list[str] = field(default_factory=list)
    name: list[str] = field(default_factory=list)
    value: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    status: str = "ok"
    error_offset: int = 0

    def add(self, kind: str, parent: int, name: str = "", value: str = "", offset: int = -1) -> int:
        self.kind.append(kind)
        self.name.append(name)
        self.value.append(value)
        self.parent.append(parent)
        self.level.append(self.level[parent] + 1 if parent >= 0 else 0)
        self.offset.append(offset)
        return len(self.kind) - 1

    def rows(self, doc_id: int, encoding: str = "utf8", string_values: bool = True) -> list[tuple]:
        """Rows of the node table."""
        return [tuple(r.values()) for batch in batches([(doc_id, encoding, self)], string_values) for r in batch.to_pylist()]


def batches(trees: Iterable[tuple[int, str, Tree]], string_values: bool = True) -> Iterator[pa.RecordBatch]:
    """The node table of (doc_id, encoding, tree)."""
    held: list[tuple[int, str, Tree]] = []
    n = 0
    for one in trees:
        held.append(one)
        n += len(one[2].kind)
        if n >= C.BATCH:
            yield from _table(held, string_values)
            held, n = [], 0
    if held:
        yield from _table(held, string_values)


def _table(trees: list[tuple[int, str, Tree]], string_values: bool) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(t.kind) for _, _, t in trees])
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    n = int(sizes.sum())
    first = np.repeat(starts, sizes)
    flat = lambda column: list(chain.from_iterable(getattr(t, column) for _, _, t in trees))
    parent = np.array(flat("parent"), np.int64)
    parent = np.where(parent < 0, -1, parent + first)

    def heads(values: Iterable, kind: pa.DataType) -> pa.Array:
        out: list = [None] * n
        for at, v in zip(starts.tolist(), values, strict=True):
            out[at] = v
        return pa.array(out, kind)

    yield from C.table(
        np.repeat(np.array([d for d, _, _ in trees], np.int64), sizes), first, np.array(flat("level"), np.int64), parent, *[pa.array(flat(c), pa.string()) for c in ("kind", "name", "value")], pa.array(flat("offset"), pa.int32()),
        heads((t.status for _, _, t in trees), pa.string()), heads((t.error_offset for _, _, t in trees), pa.int32()), heads((e for _, e, _ in trees), pa.string()), string_values,
    )


class Parser:
    """One document's parse. Positions are code points of the text."""

    def __init__(self, text: str, flags: int = S.DEFAULT, below: str = "") -> None:
        """below: the name of the element that the text is a fragment of; '' for a document of its own."""
        self.whole = len(text)
        self.text = text.partition("\0")[0] if "\0" in text else text
        self.n = len(self.text)
        self.flags = flags
        self.tree = Tree()
        self.root = self.tree.add("element" if below else "document", -1, below)
        self.nested = bool(below)
        self.open = [self.root]
        self.filled = {self.root: False}
        self.convert_text, self.convert_attribute = text_converter(flags), attribute_converter(flags)

    def run(self) -> Tree:
        tree = self.tree
        try:
            self._content()
            if len(self.open) > 1:
                raise _Failure("end_element_mismatch", self.n)
            elements = any(p == self.root and kind == "element" for p, kind in zip(tree.parent, tree.kind, strict=True))
            if not self.flags & S.FRAGMENT and not elements:
                tree.status, tree.error_offset = "no_document_element", self.whole
        except _Failure as e:
            # an error at the end of the text is told as one at its last character
            tree.status, tree.error_offset = e.status, e.at - 1 if e.at == self.whole and e.at > 0 else e.at
        return tree

    def _inside(self) -> bool:
        """Whether the cursor has a parent: below the root, or in a fragment of an element."""
        return len(self.open) > 1 or self.nested

    def _push(self, kind: str, name: str = "", value: str = "", offset: int = -1) -> int:
        self.filled[self.open[-1]] = True
        return self.tree.add(kind, self.open[-1], name, value, offset)

    def _blank(self, at: int) -> int:
        return _SPACE.match(self.text, at).end()

    def _content(self) -> None:
        text, n, flags = self.text, self.n, self.flags
        at = 0
        while at < n:
            if text[at] != "<":
                end = text.find("<", at)
                end = n if end < 0 else end
                solid = self._blank(at)
                if solid >= end:
                    keep = flags & (S.WS_PCDATA | S.WS_PCDATA_SINGLE) and not flags & S.TRIM_PCDATA
                    if keep and flags & S.WS_PCDATA_SINGLE:
                        keep = text.startswith("</", end) and not self.filled[self.open[-1]]
                    if not keep:
                        at = end
                        continue
                if self._inside() or flags & S.FRAGMENT:
                    start = solid if flags & S.TRIM_PCDATA else at
                    self._push("pcdata", value=self.convert_text(text[start:end]), offset=start)
                at = end
                if at >= n:
                    break
            at = self._tag(at + 1)

    def _tag(self, at: int) -> int:
        """What follows '<'; returns where content goes on."""
        text = self.text
        if not self.flags & S.WNORM_ATTRIBUTE and (m := _PLAIN_TAG.match(text, at)):
            return self._plain(m)
        m = _NAME.match(text, at)
        if m:
            node = self._push("element", m[0], offset=at)
            self.open.append(node)
            self.filled[node] = False
            at = m.end()
            after = text[at : at + 1]
            if after == ">":
                return at + 1
            if after and after in _BLANKS:
                return self._attributes(at, -1)
            if after == "/" and text[at + 1 : at + 2] == ">":
                self.open.pop()
                return at + 2
            raise _Failure("bad_start_element", min(at + 1, self.n))
        first = text[at : at + 1]
        if first == "/":
            return self._end_tag(at + 1)
        if first == "?":
            return self._question(at + 1)
        if first == "!":
            return self._exclamation(at + 1)
        raise _Failure("unrecognized_tag", at)

    def _plain(self, m: re.Match) -> int:
        """An element whose start tag holds nothing to be converted."""
        node, tree = self._push("element", m[1], offset=m.start()), self.tree
        if m[2]:
            given = list(_PLAIN_ATTRIBUTE.finditer(self.text, *m.span(2)))
            tree.kind += ["attribute"] * len(given)
            tree.name += [a[1] for a in given]
            tree.value += [a[2] for a in given]
            tree.parent += [node] * len(given)
            tree.level += [tree.level[node] + 1] * len(given)
            tree.offset += [a.start(1) for a in given]
        self.filled[node] = False
        if not m[3]:
            self.open.append(node)
        return m.end()

    def _attributes(self, at: int, question: int) -> int:
        """Attributes up to the end of a tag; question: where the '?' of a declaration stands that ends it like '/'."""
        text, n, owner = self.text, self.n, self.open[-1]
        while True:
            at = self._blank(at)
            m = _NAME.match(text, at)
            if m:
                node = self.tree.add("attribute", owner, m[0], "", at)
                at = m.end()
                if at + 1 >= n:
                    raise _Failure("bad_attribute", min(at + (at < n), n))
                after, at = text[at], at + 1
                if after in _BLANKS:
                    at = self._blank(at)
                    if at >= n:
                        raise _Failure("bad_attribute", n)
                    after, at = text[at], at + 1
                if after != "=":
                    raise _Failure("bad_attribute", at)
                at = self._blank(at)
                quote = text[at : at + 1]
                if not quote or quote not in "\"'":
                    raise _Failure("bad_attribute", at)
                end = text.find(quote, at + 1)
                self.tree.value[node] = self.convert_attribute(text[at + 1 : end if end >= 0 else n])
                if end < 0:
                    raise _Failure("bad_attribute", at + 1)
                at = end + 1
                if _NAME.match(text, at):
                    raise _Failure("bad_attribute", at)
                continue
            c = text[at : at + 1]
            if c == ">":
                return at + 1
            if c == "/" or at == question:
                if text[at + 1 : at + 2] == ">":
                    self.open.pop()
                    return at + 2
                at += 1
            raise _Failure("bad_start_element", min(at, n))

    def _end_tag(self, at: int) -> int:
        name = self.tree.name[self.open[-1]]
        if not name:
            raise _Failure("end_element_mismatch", at)
        found = _SYMBOLS.match(self.text, at)[0]
        if found != name:
            same = next((k for k, (a, b) in enumerate(zip(found, name, strict=False)) if a != b), min(len(found), len(name)))
            raise _Failure("end_element_mismatch", at + same + (same < len(found)))
        if len(self.open) > 1:
            self.open.pop()
        at = self._blank(at + len(name))
        if self.text[at : at + 1] != ">":
            raise _Failure("bad_end_element", at)
        return at + 1

    def _find(self, what: str, at: int, status: str, on_error: int = -1) -> int:
        end = self.text.find(what, at)
        if end < 0:
            raise _Failure(status, self.n if on_error < 0 else on_error)
        return end

    def _question(self, at: int) -> int:
        text, flags = self.text, self.flags
        m = _NAME.match(text, at)
        if not m:
            raise _Failure("bad_pi", at)
        if m.end() >= self.n:
            raise _Failure("bad_pi", self.n)
        declaration = m[0].lower() == "xml"
        if not flags & (S.DECLARATION if declaration else S.PI):
            return self._find("?>", m.end(), "bad_pi") + 2
        if declaration and self._inside():
            raise _Failure("bad_pi", m.end())
        node = self._push("declaration" if declaration else "pi", m[0], offset=at)
        after, at = text[m.end()], m.end() + 1
        if after == "?":
            if text[at : at + 1] != ">":
                raise _Failure("bad_pi", at)
            return at + 1
        if after not in _BLANKS:
            raise _Failure("bad_pi", at)
        at = self._blank(at)
        end = self._find("?>", at, "bad_pi")
        if declaration:
            self.open.append(node)
            self.filled[node] = False
            return self._attributes(at, end)
        self.tree.value[node] = text[at:end]
        return end + 2

    def _exclamation(self, at: int) -> int:
        text, flags = self.text, self.flags
        if text.startswith("-", at):
            if not text.startswith("--", at):
                raise _Failure("bad_comment", at + 1)
            at += 2
            kept = flags & S.COMMENTS
            node = self._push("comment", offset=at) if kept else -1
            end = self._find("-->", at, "bad_comment", at if kept and flags & S.EOL else -1)
            if kept:
                self.tree.value[node] = _LINE_END.sub("\n", text[at:end]) if flags & S.EOL else text[at:end]
            return end + 3
        if text.startswith("[", at):
            for k, c in enumerate("CDATA[", at + 1):
                if text[k : k + 1] != c:
                    raise _Failure("bad_cdata", min(k, self.n))
            at += 7
            kept = flags & S.CDATA
            node = self._push("cdata", offset=at) if kept else -1
            end = self._find("]]>", at, "bad_cdata", at if kept and flags & S.EOL else -1)
            if kept:
                self.tree.value[node] = _LINE_END.sub("\n", text[at:end]) if flags & S.EOL else text[at:end]
            return end + 3
        if text.startswith("DOCTYPE", at):
            if self._inside():
                raise _Failure("bad_doctype", at - 2)
            end = self._doctype_end(at - 1)
            if flags & S.DOCTYPE:
                start = min(self._blank(at + 7), end)
                self._push("doctype", value=text[start:end], offset=start)
            return end + 1
        raise _Failure("unrecognized_tag", at)

    def _doctype_end(self, at: int) -> int:
        """The '>' of a document type declaration, from its '!' on."""
        text, n, depth = self.text, self.n, 1
        special = re.compile(r"[<>\"']")
        while True:
            m = special.search(text, at)
            if not m:
                raise _Failure("bad_doctype", n)
            at, c = m.start(), m[0]
            if c == ">":
                depth -= 1
                if not depth:
                    return at
                at += 1
            elif c in "\"'":
                at = self._find(c, at + 1, "bad_doctype") + 1
            elif text.startswith("<![", at):
                at = self._ignored(at)
            elif text.startswith("<!", at) and not text.startswith("<!-", at):
                depth += 1
                at += 1
            elif text.startswith("<?", at):
                at = self._find("?>", at + 2, "bad_doctype") + 2
            elif text.startswith("<!--", at):
                at = min(self._find("-->", at + 4, "bad_doctype") + 4, n)  # one character after the comment goes with it
            else:
                raise _Failure("bad_doctype", at)

    def _ignored(self, at: int) -> int:
        """Where a conditional section, with those inside it, ends."""
        depth = 0
        for m in re.compile(r"<!\[|\]\]>").finditer(self.text, at):
            depth += 1 if m[0] == "<![" else -1
            if not depth:
                return m.end()
        raise _Failure("bad_doctype", self.n)


def parse(text: str, flags: int = S.DEFAULT) -> Tree:
    """The tree of a text. A null text is the caller's to handle."""
    return Parser(text, flags).run()


def parse_fragment(text: str, below: str, flags: int = S.DEFAULT) -> Tree:
    """The tree of a text that is to be appended to an element of this name; pre 0 is that element."""
    return Parser(text, flags | S.FRAGMENT, below).run()
