"""Nodes in document order, with their levels, to all columns of the node table: whole batches of documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("pre", pa.int32()), ("size", pa.int32()), ("level", pa.int32()), ("parent", pa.int32()), ("kind", pa.string()), ("name", pa.string()),
        ("value", pa.string()), ("ord", pa.int32()), ("nsib", pa.int32()), ("anc", pa.list_(pa.int32())), ("sval", pa.string()), ("offset", pa.int32()), ("dup", pa.bool_()),
        ("status", pa.string()), ("error_offset", pa.int32()), ("encoding", pa.string()),
    ]
)

#: Nodes of a record batch, and ancestors in it; levels up to which ancestors are written for all nodes of a batch at once.
BATCH, ANCESTORS, FLAT = 16_384, 1 << 22, 64


def parents(level: list[int], begins: list[bool]) -> tuple[list[int], list[int]]:
    """(levels, parents) of nodes in document order, -1 for none: the last node before of the document with a lower level. Levels without a node are closed up."""
    chain: list[tuple[int, int]] = []
    levels, above = [], []
    for k, depth in enumerate(level):
        if begins[k]:
            chain.clear()
        while chain and chain[-1][0] >= depth:
            chain.pop()
        levels.append(len(chain))
        above.append(chain[-1][1] if chain else -1)
        chain.append((depth, k))
    return levels, above


def short(levels: np.ndarray) -> np.ndarray:
    """levels in a form that numpy sorts in one pass, if they fit."""
    return levels.astype(np.int16) if not len(levels) or levels.max() < 1 << 15 else levels


def above(level: np.ndarray) -> np.ndarray:
    """The parents that parents() gives, where each document begins at level 0 and no level lacks a node: the last node before that is one level up."""
    out = np.full(len(level), -1, np.int64)
    by_level = np.argsort(short(level), kind="stable")
    ends = np.searchsorted(level[by_level], np.arange(level.max() + 2)) if len(level) else np.zeros(1, np.int64)
    for depth in range(1, len(ends) - 1):
        up, at = by_level[ends[depth - 1] : ends[depth]], by_level[ends[depth] : ends[depth + 1]]
        out[at] = up[np.searchsorted(up, at) - 1]
    return out


def numbered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node rows of (doc_id, level, kind, name, value, offset, status, error_offset, encoding), sorted by document and place in it."""
    held: list[pa.RecordBatch] = []  # of the last document, which may go on
    for batch in source:
        if not batch.num_rows:
            continue
        ids = batch.column("doc_id").to_numpy()
        if held and held[-1].column("doc_id")[0].as_py() != ids[0]:
            yield from _numbers(held)
            held = []
        last = int(np.searchsorted(ids, ids[-1]))
        if last:
            yield from _numbers([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield from _numbers(held)


def _numbers(found: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(found).combine_chunks().to_batches()[0]
    ids = rows.column("doc_id").to_numpy()
    begins = np.r_[True, ids[1:] != ids[:-1]]
    first = np.maximum.accumulate(np.where(begins, np.arange(len(ids)), 0))
    levels = rows.column("level").to_numpy().astype(np.int64)
    if (levels[begins] == 0).all() and (begins[1:] | ((levels[1:] > 0) & (np.diff(levels) < 2))).all():
        found_above = above(levels)
    else:
        levels, found_above = map(np.array, parents(levels.tolist(), begins.tolist()))
    yield from table(ids, first, levels, found_above, *[rows.column(c) for c in ("kind", "name", "value", "offset", "status", "error_offset", "encoding")])


def table(doc_id: np.ndarray, first: np.ndarray, level: np.ndarray, parent: np.ndarray, kind: pa.Array, name: pa.Array, value: pa.Array, offset: pa.Array, status: pa.Array, error_offset: pa.Array, encoding: pa.Array, string_values: bool = True) -> Iterator[pa.RecordBatch]:
    """The rows of whole documents. first and parent are places among these rows: where a node's document begins, and its parent, below 0 for documents."""
    n = len(level)
    coded = kind.dictionary_encode()
    kinds = coded.dictionary.to_pylist()
    is_ = lambda *which: np.isin(coded.indices.to_numpy(), [k for k, x in enumerate(kinds) if x in which])
    attribute, text, holder, blank = is_("attribute"), is_("pcdata", "cdata"), is_("element", "document"), is_("declaration", "doctype")

    size = np.zeros(n, np.int64)
    by_level = np.argsort(short(level), kind="stable")
    ends = np.searchsorted(level[by_level], np.arange(level.max() + 2)) if n else np.zeros(1, np.int64)
    for depth in range(len(ends) - 2, 0, -1):
        at = by_level[ends[depth] : ends[depth + 1]]
        np.add.at(size, parent[at], size[at] + 1)

    # siblings in document order stand together among the nodes of their level; documents are nobody's
    by_group = np.argsort(short(2 * level + attribute), kind="stable")
    beside, attributes = parent[by_group], attribute[by_group]
    starts = np.flatnonzero(np.r_[True, (beside[1:] != beside[:-1]) | (attributes[1:] != attributes[:-1]) | (beside[1:] < 0)]) if n else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, n])
    ord_, nsib = np.empty(n, np.int64), np.empty(n, np.int64)
    ord_[by_group] = np.arange(n) - np.repeat(starts, counts) + 1
    nsib[by_group] = np.repeat(counts, counts)

    dup = np.zeros(n, bool)
    at = np.flatnonzero(attribute)
    if len(at):
        names = name.take(pa.array(at)).dictionary_encode()
        code, owner = names.indices.fill_null(0).to_numpy().astype(np.int64), parent[at]
        # owners with names in another order than they first came in are the only ones that may repeat one
        loose = owner[1:][(owner[1:] == owner[:-1]) & (code[1:] <= code[:-1])]
        if len(loose):
            of = np.isin(owner, loose)
            at, key = at[of], owner[of] * len(names.dictionary) + code[of]
            _, once = np.unique(key, return_index=True)
            dup[at] = True
            dup[at[once]] = False

    if string_values:
        below = np.r_[0, np.cumsum(text)]
        pieces = [t or "" for t in value.filter(pa.array(text)).to_pylist()]
        own = np.flatnonzero(holder | blank)
        low, high = below[own], np.where(holder[own], below[own + size[own] + 1], below[own])
        joined = ["" if a == b else pieces[a] if b == a + 1 else "".join(pieces[a:b]) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        sval = pc.replace_with_mask(value, pa.array(holder | blank), pa.array(joined, pa.string()))
    else:
        sval = pa.nulls(n, pa.string())

    total = np.r_[0, np.cumsum(level)]
    a = 0
    while a < n:
        b = min(a + BATCH, n, max(a + 1, int(np.searchsorted(total, total[a] + ANCESTORS, "right")) - 1))
        part = slice(a, b)
        ints = lambda x: pa.array(x[part], pa.int32())
        own = parent[part]
        anc = pa.ListArray.from_arrays(pa.array(total[a : b + 1] - total[a], pa.int32()), pa.array(_ancestors(a, b, first, level, parent, total), pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc_id[part], pa.int64()), pa.array(np.arange(a, b) - first[part], pa.int32()), ints(size), ints(level), pa.array(own - first[part], pa.int32(), mask=own < 0), kind[part], name[part],
                value[part], ints(ord_), ints(nsib), anc, sval[part], offset[part], pa.array(dup[part]), status[part], error_offset[part], encoding[part],
            ],
            schema=ARROW,
        )
        a = b


def _ancestors(a: int, b: int, first: np.ndarray, level: np.ndarray, parent: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The ancestors of nodes a to b, root first, one node's after the other's."""
    flat = np.empty(total[b] - total[a], np.int64)
    if level[a:b].max() <= FLAT:
        node, at = parent[a:b], total[a + 1 : b + 1] - total[a] - 1
        start = first[a:b]
        while len(node):
            there = node >= 0
            node, at, start = node[there], at[there], start[there]
            flat[at] = node - start
            node, at = parent[node], at - 1
        return flat
    chain = np.empty(level[a:b].max() + 1, np.int64)
    node = parent[a]
    while node >= 0:
        chain[level[node]] = node - first[node]
        node = parent[node]
    at = 0
    for k in range(a, b):
        depth = level[k]
        flat[at : at + depth] = chain[:depth]
        chain[depth] = k - first[k]
        at += depth
    return flat
