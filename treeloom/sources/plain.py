"""Plain documents, a whole batch at once: ASCII, start tags as _PLAIN_TAG has them, matching end tags, and text that nothing is to be converted in.

What isn't plain is left to the parser, which gives the same nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from treeloom import schema as S
from treeloom.sources import columns as C

#: Flags under which plain text isn't taken as it is.
CHANGING = S.WNORM_ATTRIBUTE | S.TRIM_PCDATA

_LT, _GT, _QUOTE, _SLASH, _EQUALS, _BLANK = (ord(c) for c in '<>"/= ')
_KINDS = pa.array(["document", "element", "attribute", "pcdata"])


def _bytes(characters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(characters))


_FIRST = _bytes(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_:")
_NAME = _FIRST | _bytes(b"0123456789.-")
_STRANGE = _bytes(b"&\t\r\n\0") | (np.arange(256) > 127)


def _strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The stretches of data, none of which is null."""
    edges = np.r_[0, np.cumsum(length)]
    found = data[np.repeat(start - edges[:-1], length) + np.arange(edges[-1])]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(found))


def scan(data: np.ndarray, edges: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, Iterator[pa.RecordBatch] | None]:
    """(which documents aren't plain, the node table if all are); document k is data[edges[k]:edges[k + 1]]. Of documents that aren't plain some may be told only when the others are gone."""
    strange = np.diff(edges) == 0
    of = lambda places: np.searchsorted(edges, places, "right") - 1
    strange[of(np.flatnonzero(_STRANGE[data]))] = True
    quotes = np.flatnonzero(data == _QUOTE)
    strange |= np.diff(np.searchsorted(quotes, edges)) % 2 == 1
    if strange.any():
        return strange, None

    # tags: '<' and '>' outside quotes by turns, from the first character to the last
    opening, closing = quotes[0::2], quotes[1::2]
    turn = np.zeros(len(data), np.int8)
    turn[opening], turn[closing] = 1, -1
    outside = np.cumsum(turn, dtype=np.int8) == 0
    lt, gt = np.flatnonzero((data == _LT) & outside), np.flatnonzero((data == _GT) & outside)
    begin, end = np.searchsorted(lt, edges), np.searchsorted(gt, edges)
    tags = np.diff(begin)
    strange = (tags != np.diff(end)) | (tags == 0)
    if strange.any():
        return strange, None
    doc = np.repeat(np.arange(len(tags)), tags)
    strange[doc[lt > gt]] = True
    strange[doc[1:][gt[:-1] > lt[1:]]] = True
    strange |= (lt[begin[:-1]] != edges[:-1]) | (gt[begin[1:] - 1] != edges[1:] - 1)
    if strange.any():
        return strange, None

    # attributes: as many blanks as pairs of quotes in a tag, each before a name and '='
    ends = data[lt + 1] == _SLASH
    alone = (data[gt - 1] == _SLASH) & ~ends
    owner = np.searchsorted(lt, opening, "right") - 1
    strange[doc[owner[opening > gt[owner]]]] = True
    blanks = np.flatnonzero((data == _BLANK) & outside)
    blank_in = np.searchsorted(lt, blanks, "right") - 1
    inside = blanks < gt[blank_in]
    blanks, blank_in = blanks[inside], blank_in[inside]
    count = np.bincount(owner, minlength=len(lt))
    strange[doc[(count != np.bincount(blank_in, minlength=len(lt))) | (ends & (count > 0))]] = True
    if strange.any():
        return strange, None
    stop = gt - alone
    leads = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    trails = np.r_[leads[1:], True] if len(owner) else leads
    right = (data[opening - 1] == _EQUALS) & (opening - 1 > blanks + 1)
    right[1:] &= leads[1:] | (blanks[1:] == closing[:-1] + 1)
    right &= ~trails | (closing + 1 == stop[owner])
    strange[doc[owner[~right]]] = True
    if strange.any():
        return strange, None
    name_at, name_end = lt + 1 + ends, stop.copy()
    name_end[owner[leads]] = blanks[leads]
    other = np.r_[0, np.cumsum(~_NAME[data], dtype=np.int32)]
    named = lambda a, b: (b > a) & _FIRST[data[a]] & (other[np.maximum(a, b)] == other[a])
    strange[doc[~named(name_at, name_end)]] = True
    key_at, key_end = blanks + 1, opening - 1
    strange[doc[owner[~named(key_at, key_end)]]] = True

    # nesting: at each depth, start and end tags by turns and of the same names
    step = np.where(ends, -1, np.where(alone, 0, 1))
    after = np.cumsum(step)
    after -= np.repeat((after - step)[begin[:-1]], tags)
    depth = after - step
    strange[doc[after < 0]] = True
    strange |= after[begin[1:] - 1] != 0
    text = np.flatnonzero(lt[1:] - gt[:-1] > 1)
    text_at, text_end = gt[text] + 1, lt[text + 1]
    solid = np.r_[0, np.cumsum(data != _BLANK, dtype=np.int32)]
    strange[doc[text[(after[text] == 0) | (solid[text_at] == solid[text_end])]]] = True
    if strange.any():
        return strange, None
    paired = np.flatnonzero(step)
    paired = paired[np.argsort(C.short(np.where(ends, after, depth)[paired]), kind="stable")]
    codes = _strings(data, name_at, name_end - name_at).dictionary_encode().indices.to_numpy()
    strange[doc[paired[0::2][codes[paired[0::2]] != codes[paired[1::2]]]]] = True
    if strange.any():
        return strange, None

    # nodes, in the order of their places
    element = np.flatnonzero(~ends)
    mark = np.zeros(len(data), np.int8)
    mark[lt[element]], mark[key_at], mark[text_at] = 1, 1, 1
    place = np.cumsum(mark, dtype=np.int64)
    documents = place[edges[:-1]] + np.arange(len(tags)) - 1
    groups = ((documents, 0), (place[lt[element]] + doc[element], 1), (place[key_at] + doc[owner], 2), (place[text_at] + doc[text], 3))
    n = sum(len(at) for at, _ in groups)
    name_from, name_size, value_from, value_size, level, kind, offset = (np.zeros(n, np.int64) for _ in range(7))
    shift = edges[:-1][doc]
    for (at, code), names, values, levels, begins in zip(
        groups,
        (None, (name_at[element], name_end[element]), (key_at, key_end), None),
        (None, None, (opening + 1, closing), (text_at, text_end)),
        (0, depth[element] + 1, depth[owner] + 2, after[text] + 1),
        (-1, name_at[element] - shift[element], key_at - shift[owner], text_at - shift[text]),
        strict=True,
    ):
        kind[at], level[at], offset[at] = code, levels, begins
        for given, starts, sizes in ((names, name_from, name_size), (values, value_from, value_size)):
            if given:
                starts[at], sizes[at] = given[0], given[1] - given[0]
    sizes = np.diff(np.r_[documents, n])
    of_document = lambda value, form: pa.array([value], form).take(pa.array(np.zeros(n, np.int8), mask=kind != 0))
    return strange, C.table(
        np.repeat(doc_id, sizes), np.repeat(documents, sizes), level, C.above(level), pa.DictionaryArray.from_arrays(pa.array(kind, pa.int8()), _KINDS).cast(pa.string()),
        _strings(data, name_from, name_size), _strings(data, value_from, value_size), pa.array(offset, pa.int32()), of_document("ok", pa.string()), of_document(0, pa.int32()), of_document("utf8", pa.string()),
    )
