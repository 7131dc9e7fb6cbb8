"""Exact n-gram Jaccard join by parity sketches, and the components its links form.

Each text's distinct word shingles are dealt by hash to blocks; a block's sketch is the XOR of its shingles' hashes. A
shingle that two sets don't share changes one block at most, so the number of blocks that differ (their Hamming
distance, block by block) is a lower bound of the symmetric difference. Two sets of sizes a <= b with Jaccard of at
least t differ in at most (1 - t) / (1 + t) * (a + b) shingles; with more blocks than that, one block at least is equal
(pigeonhole), and sets are joined on (size band, block, sketch). Every candidate is then verified on the whole sets.

Blocks that hold no shingle are alike in unrelated texts, and passages that are repeated everywhere make blocks alike too.
So shingles of frequent passages are left out of the sketches (never out of the comparison): what two sets differ in
without them is no more than with them. Each band has spare blocks, more than the bound asks for; a text with no more
empty blocks than spares must share a block that isn't empty with each near text. Texts with more empty blocks (they
consist of frequent passages, or are short) are also joined with each other by sketches of all their shingles. No pair is
lost either way, whatever counts as frequent.

What is joined are classes of equal sets, each once. A first round deals the first few blocks of each class only: there
nearly all near sets meet, each with the first of its group, and their links give components. The second round deals all
blocks, and groups whose classes are in one component already give nothing. In the others, pairs between different
components are refused by a second parity sketch (each shingle flips one bit, and again the Hamming distance is a lower
bound) before any text moves: first a spanning forest of the nearest pairs that it allows is compared in full, then all
that it allows between what is still apart. So components are exact without listing the pairs of a group of copies.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import forget, free_name, lean, partitions, small, small_batches, written

WORDS, PERCENT = 5, 80

#: Each band of sizes reaches to this many times its least size.
RATIO = 1.5
#: A shingle is frequent if it is in this part (and number) of the different texts that a task reads in a row, so any
#: that is in this part of all texts is found; the most frequent ones are told to all tasks (8 bytes each).
FREQUENT, LEAST_FREQUENT, TOLD = 0.0008, 3, 200_000
#: Shingles that a task counts at once.
COUNTED = 2_000_000
#: Bits a shingle, at least, of the sketch by which pairs are refused before their sets are compared, and of the largest one.
BITS, MOST_BITS = 4, 16384
#: Marks of a class's groups by which a pair that shares several groups is told from one of them.
MARKS = 8
#: Sketches that a task holds before it passes them on.
FLUSH = 250_000
#: Tasks that the second round is dealt to, for each partition of the session: a task holds all keys of its part.
PARTS = 4
#: Bytes of a table of classes that is broadcast, so that texts needn't move.
WIDE_BYTES = 32_000_000
#: Blocks of each band that the first round deals.
FIRST_BLOCKS = 6
#: Pairs of one class that are verified in a row; classes in more pairs are sent once for each so many.
HUB = 64
#: Classes of a group that are compared with each other in one task; larger groups are dealt in squares of that side.
SIDE = 1024

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> np.ndarray:
    """A 64-bit hash of each word: A-Z lower-cased, words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes, in order, of all word shingles of a text; of the whole sequence if it has fewer words; none without words."""
    each = words_of(text) if text else np.zeros(0, np.uint64)
    n = len(each)
    if not n:
        return each
    width = min(words, n)
    value = each[: n - width + 1].copy()
    for k in range(1, width):
        value *= _ODD
        value += each[k : n - width + 1 + k]
    value = np.sort(_mixed(value + np.uint64(width)))
    return value[np.concatenate(([True], value[1:] != value[:-1]))]


@lru_cache
def bands() -> list[int]:
    """The least size of each band."""
    edges, at = [1], 1
    while at < 1 << 40:
        at = max(at + 1, int(at * RATIO))
        edges.append(at)
    return edges


def bound(band: int, percent: int) -> int:
    """Most shingles in which a set of this band and one at least as large can differ and still have the similarity."""
    least = bands()[band + 1] - 1
    other = 100 * least // percent
    return (100 - percent) * (least + other) // (100 + percent)


def blocks(band: int, percent: int) -> tuple[int, int]:
    """(number of blocks, spares) of a band."""
    most = bound(band, percent)
    spare = 6 + most * 2 // 5
    return most + 1 + spare, spare


class Frequent:
    """The frequent shingles: a bit map that most others fail, then a search."""

    def __init__(self, found: np.ndarray) -> None:
        self.sorted = np.sort(found)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.sorted & np.uint64((1 << 20) - 1)] = True

    def without(self, found: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return found
        maybe = np.flatnonzero(self.bits[found & np.uint64((1 << 20) - 1)])
        if not len(maybe):
            return found
        at = np.searchsorted(self.sorted, found[maybe])
        hit = maybe[self.sorted[np.minimum(at, len(self.sorted) - 1)] == found[maybe]]
        return np.delete(found, hit) if len(hit) else found


def _sketched(found: np.ndarray, band: int, m: int, salt: int, first: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, blocks that have shingles): hashes of (band, block, XOR of the block's shingles); of the first blocks only if first is given."""
    if not len(found):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    block = ((found >> np.uint64(20)) % np.uint64(m)).astype(np.uint16 if m < 1 << 16 else np.uint64)  # short numbers are sorted by radix
    if first is not None:
        chosen = np.flatnonzero(block < first)
        block, found = block[chosen], found[chosen]
        if not len(found):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    order = np.argsort(block, kind="stable")
    dealt = block[order]
    begin = np.flatnonzero(np.concatenate(([True], dealt[1:] != dealt[:-1])))
    at = dealt[begin].astype(np.uint64)
    return _mixed(np.bitwise_xor.reduceat(found[order], begin) ^ _mixed(at * np.uint64(4096) + np.uint64(band + salt))), at


def sketches(found: np.ndarray, band: int, percent: int, frequent: Frequent) -> np.ndarray:
    """The keys on which a set is joined in a band."""
    m, spare = blocks(band, percent)
    keys, at = _sketched(frequent.without(found), band, m, 0, None)
    if m - len(at) <= spare:
        return keys
    more, at = _sketched(found, band, m, 128, None)
    if m - len(at) > spare:  # even so: its empty blocks count as well
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), at)
        more = np.concatenate((more, _mixed(_mixed(empty * np.uint64(4096) + np.uint64(band)) ^ np.uint64(0x5EED))))
    return np.concatenate((keys, more))


def first_sketches(found: np.ndarray, band: int, percent: int, frequent: Frequent) -> np.ndarray:
    """The keys of the first blocks of a band, with and without frequent shingles."""
    m, _ = blocks(band, percent)
    rest = frequent.without(found)
    keys, _ = _sketched(rest, band, m, 0, FIRST_BLOCKS)
    return keys if len(rest) == len(found) else np.concatenate((keys, _sketched(found, band, m, 128, FIRST_BLOCKS)[0]))


def keys_of(found: np.ndarray, percent: int, frequent: Frequent, of_band: Callable = sketches) -> np.ndarray:
    """All join keys of a set: in its own band, and in the bands whose sets it may be the larger partner of."""
    n = len(found)
    edges = bands()
    band = bisect_right(edges, n) - 1
    out = []
    while band >= 0 and 100 * (edges[band + 1] - 1) >= percent * n:
        if bound(band, percent) > 0:  # otherwise only equal sets are near enough, and those are classes already
            out.append(of_band(found, band, percent, frequent))
        band -= 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bit_sketch(found: np.ndarray) -> np.ndarray:
    """The parity sketch of a set in 64-bit words: each shingle flips one bit. The number of bits is a power of two, BITS for each shingle at least, MOST_BITS at most."""
    bits = min(MOST_BITS, max(64, 1 << (BITS * len(found) - 1).bit_length()))
    flipped = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flipped.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches at fewer words: what the same sets would have there."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


_SETS = "doc_id long, n_shingles long, signature binary, sketch binary, shingle long, times long"


def sets(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, signature, sketch, shingle, times): size, 128-bit hash and bit sketch of each text's set (null
    for empty sets), with null in the last two; and frequent shingles of the texts that a task read in a row, with null in the others."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("signature", pa.binary()), ("sketch", pa.binary()), ("shingle", pa.int64()), ("times", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def counted() -> Iterator[pa.RecordBatch]:
            every = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1], [True])))
            times = np.diff(edge)
            many = times >= max(LEAST_FREQUENT, FREQUENT * len(held))
            found, times = every[edge[:-1][many]].astype(np.int64), times[many]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(found), f.type) for f in list(schema)[:4]), pa.array(found), pa.array(times)], schema=schema)

        for batch in source:
            number, signature, sketch = [], [], []
            for t in batch.column(1).to_pylist():
                found = shingles(t, words)
                number.append(len(found))
                mark = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
                signature.append(mark)
                sketch.append(bit_sketch(found).tobytes() if mark else None)
                if mark and mark not in seen:
                    seen.add(mark)
                    held.append(found)
                    size += len(found)
                    if size >= COUNTED:
                        yield from counted()
                        held, size = [], 0
                        seen.clear()
            n = len(number)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(number, pa.int64()), pa.array(signature, pa.binary()), pa.array(sketch, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
        if held:
            yield from counted()

    return docs.select(key, text).mapInArrow(lean(run), _SETS)


def told(found: DataFrame) -> np.ndarray:
    """The TOLD most frequent shingles of sets()."""
    rows = found.where("times is not null").groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(TOLD).select("shingle").toArrow()
    return rows.column(0).to_numpy().astype(np.uint64)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(text, signature, node, component): a text of each class of nodes (node, component, first, signature). A key that
    is repeated with other texts brings these as well; their signature tells them apart."""
    of = nodes.select(F.col("first").alias("doc_id"), "signature", "node", "component")
    return docs.join(small(of, WIDE_BYTES), "doc_id").select("text", "signature", "node", "component")


def _dealt(texts: DataFrame, words: int, percent: int, buckets: int, frequent: Broadcast, of_band: Callable) -> DataFrame:
    """(bucket, keys, ids, others): the join keys of all classes, packed by bucket, with their nodes, and the XOR of node and component."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Frequent(frequent.value)
        held_keys, held_ids, held_others, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held_keys:
                return
            n = [len(k) for k in held_keys]
            keys, ids, others = np.concatenate(held_keys), np.repeat(np.array(held_ids, np.int64), n), np.repeat(np.array(held_others, np.int64), n)
            bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, keys, ids, others = bucket[order], keys[order].astype(np.uint32), ids[order], others[order]
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            for k in range(0, len(edge) - 1, 512):
                part = list(zip(edge[k : k + 512], edge[k + 1 : k + 513], strict=False))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[[a for a, _ in part]]), *(pa.array([x[a:b].tobytes() for a, b in part], pa.binary()) for x in (keys, ids, others))], names=["bucket", "keys", "ids", "others"])
            held_keys.clear()
            held_ids.clear()
            held_others.clear()

        for batch in source:
            for text, signature, node, component in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = shingles(text, words)
                if not len(found) or xxhash.xxh3_128_digest(found.tobytes()) != signature:
                    continue
                keys = keys_of(found, percent, known, of_band)
                if len(keys):
                    held_keys.append(keys)
                    held_ids.append(node)
                    held_others.append(node ^ component)
                    size += len(keys)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.mapInArrow(lean(run), "bucket int, keys binary, ids binary, others binary")


def _groups(source: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes in order of key and node, their components, begin of each group of two or more, their sizes) of one partition."""
    keys, ids, others = [], [], []
    for batch in source:
        # the bucket is the rest of the key; what few keys meet by chance are refused when sets are compared
        keys += [np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        ids += [np.frombuffer(b, np.int64) for b in batch.column(2).to_pylist()]
        others += [np.frombuffer(b, np.int64) for b in batch.column(3).to_pylist()]
    if not keys:
        return (np.zeros(0, np.int64),) * 4
    key, who = np.concatenate(keys), np.concatenate(ids)
    component = np.concatenate(others) ^ who
    del keys, ids, others
    # most keys occur once: those go before the sort by node
    order = np.argsort(key, kind="stable")
    key, who, component = key[order], who[order], component[order]
    same = key[1:] == key[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    key, who, component = key[shared], who[shared], component[shared]
    order = np.lexsort((who, key))
    key, who, component = key[order], who[order], component[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (who[1:] != who[:-1]))) if len(key) else np.zeros(0, bool)
    key, who, component = key[fresh], who[fresh], component[fresh]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    return who, component, begin[size > 1], size[size > 1]


def _starred(dealt: DataFrame) -> DataFrame:
    """(a, b): the first of the classes that share a key with every other."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, _, begin, size = _groups(source)
        if not len(begin):
            return
        first = np.repeat(who[begin], size - 1)
        inner = np.arange(size.sum() - len(size)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
        other = who[np.repeat(begin + 1, size - 1) + inner]
        order = np.lexsort((other, first))
        first, other = first[order], other[order]
        keep = np.concatenate(([True], (first[1:] != first[:-1]) | (other[1:] != other[:-1])))
        first, other = first[keep], other[keep]
        for k in range(0, len(first), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(first[k : k + 100_000]), pa.array(other[k : k + 100_000])], names=["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long")


def _mixed_groups(dealt: DataFrame) -> DataFrame:
    """(mark, nodes, components): the different groups of classes that share a key and are of more than one component, packed."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, component, begin, size = _groups(source)
        if not len(begin):
            return
        end = begin + size
        edges = np.stack((begin, end), 1).ravel()
        # the last edge may lie behind the array
        padded = np.append(component, component[-1:])
        several = np.minimum.reduceat(padded, edges)[::2] != np.maximum.reduceat(padded, edges)[::2]
        known: set[bytes] = set()
        held: list[tuple[bytes, bytes, bytes]] = []
        for a, b in zip(begin[several].tolist(), end[several].tolist(), strict=True):
            nodes = who[a:b].tobytes()
            mark = xxhash.xxh3_128_digest(nodes)
            if mark not in known:
                known.add(mark)
                held.append((mark, nodes, component[a:b].tobytes()))
            if len(held) >= 1000:
                yield _row(held)
                held = []
        if held:
            yield _row(held)

    def _row(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*held, strict=True)], names=["mark", "nodes", "components"])

    return dealt.mapInArrow(lean(run), "mark binary, nodes binary, components binary")


def _unpacked(groups: DataFrame) -> DataFrame:
    """(mark, square, side, node) for each class of each packed group, the mark as a number: in groups of more than SIDE,
    each stretch of SIDE classes meets itself (square (i, i), side 0 only) and each later stretch (square (i, j), sides 0 and 1)."""
    names = ["mark", "square", "side", "node"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            times = [len(h[3]) for h in held]
            columns = [pa.array(np.repeat(np.array([h[k] for h in held], t), times)) for k, t in ((0, np.int64), (1, np.int64), (2, np.int32))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([h[3] for h in held]))], names=names)

        for batch in source:
            for long_mark, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark, who = int.from_bytes(long_mark[:8], "little", signed=True) | 1, np.frombuffer(nodes, np.int64)
                stretches = range(0, len(who), SIDE)
                for i, a in enumerate(stretches):
                    for j, b in enumerate(stretches):
                        for side, at in ((0, a),) if i == j else ((0, a), (1, b)) if i < j else ():
                            held.append((mark, i * len(stretches) + j, side, who[at : at + SIDE]))
                            size += len(held[-1][3])
                            if size >= 32 * SIDE:
                                yield out()
                                held, size = [], 0
        if held:
            yield out()

    return groups.select("mark", "nodes").mapInArrow(lean(run), "mark long, square long, side int, node long")


def near_pairs(sizes: np.ndarray, components: np.ndarray, sketch: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, places j, bits that differ) of all pairs of different components (and, if sides are given and both occur, of different sides) whose sizes and sketches allow the similarity, each once."""
    order = np.argsort(sizes, kind="stable")
    sizes, components, rows = sizes[order], components[order], [sketch[k] for k in order]
    sides = None if sides is None or (sides == sides[0]).all() else sides[order]
    words = np.array([len(x) for x in rows])
    at_words = {w: folded_to(rows, words, int(w)) for w in np.unique(words)}
    last = np.searchsorted(sizes, 100 * sizes // percent, side="right")
    for i in range(len(order) - 1):
        # partners no smaller than i, within the size bound; their sketches are as long or longer
        begin, end = i + 1, int(last[i])
        fit = components[begin:end] != components[i]
        if sides is not None:
            fit &= sides[begin:end] != sides[i]
        fit = np.flatnonzero(fit) + begin
        if not len(fit):
            continue
        start, at = at_words[words[i]]
        differ = np.bitwise_count(at[fit - start] ^ at[i - start]).sum(axis=1, dtype=np.int64)
        near = (100 + percent) * differ <= (100 - percent) * (sizes[fit] + sizes[i])
        if near.any():
            yield int(order[i]), order[fit[near]], differ[near]


def folded_to(rows: list[np.ndarray], words: np.ndarray, least: int) -> tuple[int, np.ndarray]:
    """(place of the first row with that many words, all rows from there on folded to that many); rows are in order of size, so of words."""
    start = int(np.searchsorted(words, least))
    return start, np.concatenate([folded(np.stack(rows[a:b]), least) for a, b in _stretches(words, start)])


def _stretches(words: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
    edge = [start, *(np.flatnonzero(np.diff(words[start:])) + start + 1).tolist(), len(words)]
    yield from zip(edge[:-1], edge[1:], strict=True)


def _once(mark: int, marks: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, others) this group is to give: those whose least common mark is this group's, and those of which no common mark is known."""
    common = (marks[others][:, :, None] == marks[i][None, None, :]) & (marks[i] != 0)
    first = np.where(common.any(2), marks[others], np.iinfo(np.int64).max).min(1)
    return (first == mark) | (first == np.iinfo(np.int64).max)


def _forest(a: np.ndarray, b: np.ndarray, differ: np.ndarray, components: np.ndarray) -> np.ndarray:
    """Which of the pairs, the nearest first, connect components that those before don't."""
    ends = np.sort(np.stack((components[a], components[b])), axis=0)
    order = np.lexsort((b, a, differ, ends[1], ends[0]))
    fresh = np.concatenate(([True], (ends[:, order[1:]] != ends[:, order[:-1]]).any(0)))
    best = order[fresh]  # the nearest of two components
    best = best[np.lexsort((b[best], a[best], differ[best]))]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, x, y in zip(best.tolist(), *ends[:, best].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


def _marks(groups: DataFrame) -> DataFrame:
    """(node, marks): the least marks of each class, which is in no more groups than it has blocks."""
    rows = _unpacked(groups).where("side = 0").select("node", "mark").distinct()
    return rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("mark")), 1, MARKS).alias("marks"))


def _allowed(groups: DataFrame, marks: DataFrame, nodes: DataFrame, percent: int, parts: int, spanning: bool) -> DataFrame:
    """(a, b): pairs of classes of one group but different components whose bit sketches differ in no more bits than near
    sets may differ in shingles; all of them, or a spanning forest of each group. Groups are gone through in memory, at
    most 2 * SIDE classes at once, and no other pair leaves a task."""
    about = written(marks.hint("merge").join(small(nodes.select("node", "component", F.col("n_shingles").alias("n"), "sketch")), "node"), "members")
    dealt = _unpacked(groups).hint("merge").join(small(about), "node").select("mark", "square", "side", "node", "component", "n", "sketch", "marks").repartition(parts, "mark", "square").sortWithinPartitions("mark", "square")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            side, node, component, n, sketch, marks = zip(*held, strict=True)
            component = np.array(component)
            if (component == component[0]).all():
                return
            node = np.array(node)
            own = np.zeros((len(node), MARKS), np.int64)
            for k, x in enumerate(marks):
                own[k, : len(x)] = x
            a, b, differ = [], [], []
            for i, others, bits in near_pairs(np.array(n), component, [np.frombuffer(x, np.uint64) for x in sketch], percent, np.array(side)):
                keep = _once(group[0], own, i, others)
                a.append(np.full(keep.sum(), i))
                b.append(others[keep])
                differ.append(bits[keep])
            if a and sum(map(len, a)):
                a, b = np.concatenate(a), np.concatenate(b)
                if spanning:
                    keep = _forest(a, b, np.concatenate(differ), component)
                    a, b = a[keep], b[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

        for batch in source:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if row[:2] != group:
                    if held:
                        yield from pairs()
                    group, held = row[:2], []
                held.append(row[2:])
        if held:
            yield from pairs()

    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def _refused(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of pairs whose sizes and bit sketches allow the similarity."""
    of = lambda side: small(nodes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keep = []
            for n, x, m, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                fits = 100 * min(n, m) >= percent * max(n, m)
                if fits:
                    x, y = np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None]
                    words = min(x.shape[1], y.shape[1])
                    fits = (100 + percent) * int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= (100 - percent) * (n + m)
                keep.append(fits)
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(chosen), batch.column(1).filter(chosen)], names=["a", "b"])

    return both.mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows (a, b) of pairs whose whole sets have the similarity.

    Each text is sent once for each pair it is b in, and once for HUB pairs that it is a in: a hub's pairs are dealt to
    as many tasks as they need.
    """
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).alias("salts"))
    pairs = pairs.hint("merge").join(small(hubs), "a").withColumn("salt", F.pmod(F.xxhash64("b"), "salts"))
    pairs = written(pairs.select("a", "salt", "b"), "salted")
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    found = _texts(docs, nodes.join(small(ends), "node", "left_semi")).select("node", "text", "signature")
    mine = pairs.select("a", "salt").distinct().withColumn("b", F.lit(None).cast("long")).withColumn("node", F.col("a"))
    both = mine.union(pairs.withColumn("node", F.col("b"))).hint("merge").join(found.hint("merge"), "node")
    dealt = both.select("a", "salt", "b", "text", "signature").repartition(partitions(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of_hub = None, None
        for batch in source:
            a_out, b_out = [], []
            for a, b, text, signature in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                found = shingles(text, words)
                if xxhash.xxh3_128_digest(found.tobytes()) != signature:
                    continue  # another text under a repeated key
                if b is None:
                    hub, of_hub = a, found
                elif a == hub:
                    both = len(np.intersect1d(of_hub, found, assume_unique=True))
                    if both > 0 and 100 * both >= percent * (len(of_hub) + len(found) - both):
                        a_out.append(a)
                        b_out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(lean(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable, for each node of the edges (a, b).

    Alternating large-star and small-star steps; each step's edges are a written table, and the hub of a star is never
    gathered in one task: its smallest neighbour comes from a partial aggregate.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        before = edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = large.where("u <> v").distinct()
        # small star: the smaller neighbours of each node, and the node itself, go to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        star = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(star.where("u <> v").distinct(), "edges")
        forget(before)
        now = edges.agg(F.count(F.lit(1)), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").union(roots.select(F.col("component").alias("node"), "component").distinct())


def _resolved(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes) of docs (doc_id, text): (doc_id, n_shingles, signature) per row, and (signature, first, component),
    the smallest key of each class of equal sets and the number of the class that stands for its component."""
    spark = docs.sparkSession
    n = partitions(spark)
    found = written(sets(docs, "doc_id", "text", words), "sets")
    own = found.where("times is null").select("doc_id", "n_shingles", "signature")
    grouped = found.where("signature is not null and doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    numbered = grouped.select(F.monotonically_increasing_id().alias("node"), "*")
    nodes = written(numbered.select("node", F.col("node").alias("component"), "first", "signature", "n_shingles", "sketch"), "nodes")
    frequent = spark.sparkContext.broadcast(told(found))
    # the first blocks, then all of them, where components differ: spanning forests, then all pairs
    dealt = _dealt(_texts(docs, nodes), words, percent, n, frequent, first_sketches).repartition(n, "bucket")
    nodes = _linked(written(_refused(_starred(dealt).distinct(), nodes, percent), "pairs"), docs, nodes, words, percent)
    dealt = _dealt(_texts(docs, nodes), words, percent, PARTS * n, frequent, sketches).repartition(PARTS * n, "bucket")
    groups = written(_mixed_groups(dealt).dropDuplicates(["mark"]), "groups")
    marks = written(_marks(groups), "marks")
    for spanning in (True, False):
        nodes = _linked(written(_allowed(groups, marks, nodes, percent, n, spanning), "pairs"), docs, nodes, words, percent)
    frequent.destroy()
    forget(groups)
    forget(marks)
    return own, nodes.select("signature", "first", "component")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """nodes with the components that result from those pairs (a written table, used up) that have the similarity."""
    if pairs.isEmpty():
        return nodes
    links = written(verified(pairs, docs, nodes, words, percent), "links")
    of = lambda side: small(nodes.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    roots = written(components(between), "roots")
    named = nodes.join(small(roots.select(F.col("node").alias("component"), F.col("component").alias("root"))), "component", "left")
    out = written(named.select("node", F.coalesce("root", "component").alias("component"), "first", "signature", "n_shingles", "sketch"), "nodes")
    for table in (pairs, links, roots, nodes):
        forget(table)
    return out


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs.

    Texts link when 100 * intersection >= percent * union of their sets of word shingles (lower-cased A-Z, words between
    ASCII white space; words are told apart by 64-bit hashes). component_id is the smallest key reachable by links, the
    row's own included. A text of fewer words than a shingle has is one shingle; null, empty and white-space texts have
    none and are linked with nothing, not even with each other. Rows with a null key get a null component. Rows that
    repeat a key are rows of their own, with the component of their own text. Other columns of docs are not looked at.
    """
    small_batches(docs.sparkSession)
    own, classes = _resolved(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), words, percent)
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(small(written(least, "components")), "component").select("signature", "component_id")
    result = own.hint("merge").join(small(written(named, "named")), "signature", "left")
    return result.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with one document of each component, that of the smallest key; docs' own columns.

    Of rows that repeat the key and the set of shingles, one stays: the first in order of all columns. Of rows that repeat a key with
    other sets, each is a document of its own. Documents without shingles (null or empty texts) are in no component and
    stay, and so do rows with a null key.
    """
    small_batches(docs.sparkSession)
    own, classes = _resolved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words, percent)
    chosen = classes.groupBy("component").agg(F.min(F.struct("first", "signature")).alias("kept")).select(F.col("kept.first").alias("doc_id"), F.col("kept.signature").alias("signature"))
    chosen = written(chosen, "kept")
    own = own.where("doc_id is not null")
    rows = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("signature").isNull()).alias("empty"))
    alone = written(rows.join(small(chosen.select("doc_id").distinct()), "doc_id", "left_semi").where("n = 1").select("doc_id").union(rows.where("n = 1 and empty").select("doc_id")), "kept-alone")
    repeated = written(rows.where("n > 1").select("doc_id"), "repeated")
    out = docs.join(small(alone), "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    if repeated.isEmpty():
        return out

    names = free_name(docs.columns, "own_signature"), free_name(docs.columns, "own_rank")

    @F.pandas_udf("binary")
    def signed(column):  # noqa: ANN001, ANN202
        import pandas as pd  # here only: most workers don't need it

        each = [shingles(t, words) for t in column]
        return pd.Series([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in each], dtype=object)

    again = docs.join(small(repeated), "doc_id", "left_semi").select(*docs.columns, signed("text").alias(names[0]))
    keep = chosen.select("doc_id", F.col("signature").alias(names[0]))
    order = Window.partitionBy("doc_id", names[0]).orderBy(*[F.col(c) for c in docs.columns])
    first = again.join(small(keep), ["doc_id", names[0]], "left_semi").withColumn(names[1], F.row_number().over(order)).where(F.col(names[1]) == 1)
    return out.union(first.select(*docs.columns)).union(again.where(F.col(names[0]).isNull()).select(*docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
links AS (
  SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS shared FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL)
  WHERE 100 * shared >= 80 * (n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
