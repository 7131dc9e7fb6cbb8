"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters of any script, of order 5. Its n-grams, their counts and what follows from them are tables
that grow with the trusted text; they are counted in each task before they are shuffled by n-gram, and all estimates are
joins of such tables. The finished model is one table of n-grams (log probability) and contexts (log weight of the order
below). Documents are scored against it whole: by workers that read the table from the shared folder, or, where it takes
more than ``MODEL_BYTES``, by a join sharded by n-gram of what each block of documents needs. Either way gives the same.

The model is trained on four fifths of the trusted texts. The others, which it has not seen, give each language's
quantile, and a document is kept if its score is no higher than that of its language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import by_batch, forget, free_name, labels_of, lean, partitions, small, small_batches, written

ORDER = 5
#: Bits of a character's class: characters up to U+0FFF are their own class, apart from white space and digits; others share classes by hash.
BITS = 12
SIZE = 1 << BITS
#: Bytes of a model that each worker may hold; larger ones are joined.
MODEL_BYTES = 96_000_000
#: Entries of a shard of a joined model, and documents of a block.
SHARD, BLOCK = 500_000, 256

#: Characters of prior weight with which a text's score is drawn to its language's mean, so that short texts aren't judged on a few letters.
PRIOR_CHARS = 80
#: Quantile of a language's held-out trusted scores beyond which a text is rejected; one in so many texts is held out.
QUANTILE, HELD_OUT = 0.995, 5
#: Languages with fewer held-out trusted texts are judged by the quantile of all languages.
LEAST_TEXTS = 30
#: Columns that documents are given.
NEW = ("quality_score", "perplexity", "threshold", "keep", "cost", "cost_chars")
#: Places of context weights in the table's keys, above those of the orders.
_WEIGHTS = ORDER + 1


def _classes() -> np.ndarray:
    table = np.arange(SIZE, dtype=np.uint64)
    for code in range(SIZE):
        c = chr(code)
        if c in "\n\r\x0b\x0c\x1c\x1d\x1e\x85":
            table[code] = 0x0A
        elif c.isspace() or code < 0x20:
            table[code] = 0x20
        elif c.isdigit():
            table[code] = 0x30
    return table


_table: list[np.ndarray] = []


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes of all texts in lower case, each with ORDER - 1 borders (class 0) before it, where each text's characters begin, and how many they are."""
    if not _table:
        _table.append(_classes())
    gap = "\x00" * (ORDER - 1)
    texts = [t.lower().replace("\x00", " ") for t in texts]
    codes = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _table[0][np.minimum(codes, SIZE - 1)]
    out[codes == 0] = 0
    other = np.flatnonzero(codes >= SIZE)
    out[other] = 1 + codes[other] % np.uint32(SIZE - 1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    return out, starts, lengths


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each position from ORDER - 1 on, BITS for each character."""
    key = codes[: len(codes) - ORDER + 1].copy()
    for k in range(1, ORDER):
        key <<= np.uint64(BITS)
        key |= codes[k : len(codes) - ORDER + 1 + k]
    return key


def _portions(texts: list[str | None], most: int = 500_000) -> Iterator[list[str]]:
    """Lists of texts of about that many characters; one text may be longer."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    edge = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[edge], np.add.reduceat(n, edge)


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): how often each n-gram of the highest order occurs in all texts; counted in each task before the shuffle."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[0][k : k + 100_000].astype(np.int64)), pa.array(counts[0][k : k + 100_000])], names=["gram", "n"])
            keys.clear()
            counts.clear()

        for batch in source:
            for texts in _portions(batch.column(0).to_pylist()):
                codes, _, _ = classes(texts)
                if len(codes) < ORDER:
                    continue
                found, n = np.unique(grams(codes)[codes[ORDER - 1 :] != 0], return_counts=True)
                keys.append(found)
                counts.append(n.astype(np.int64))
                size += len(found)
                if size > 2_000_000:
                    keys[:], counts[:] = ([x] for x in _summed(keys, counts))
                    size = len(keys[0])
                    if size > 1_000_000:
                        yield from flush()
                        size = 0
        if keys:
            keys[:], counts[:] = ([x] for x in _summed(keys, counts))
            yield from flush()

    return docs.where(F.col(text).isNotNull()).select(text).mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> list[float]:
    """What is taken off counts of 1, 2, and 3 or more, from the numbers of n-grams that occur once to four times."""
    seen = {r["n"]: r["c"] for r in table.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    n1, n2, n3, n4 = (seen.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


def estimate(counts: DataFrame) -> DataFrame:
    """The model, a written table (key, value), by modified Kneser-Ney from (gram, n), a written table.

    For each order below the highest, an n-gram counts once for each different n-gram one longer that it ends. Counts
    are joined with the totals of their contexts and with the probabilities of the order below. No counts at all give an
    empty model, which is the uniform distribution.
    """
    tables = {ORDER: counts.select("gram", "n")}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("gram")
        tables[order] = written(tables[order + 1].groupBy(shorter).agg(F.count(F.lit(1)).alias("n")), f"grams-{order}")
    model: DataFrame | None = None
    below: DataFrame | None = None
    made = []
    for order in range(1, ORDER + 1):
        d = _discounts(tables[order])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        t = tables[order].withColumn("context", F.shiftrightunsigned("gram", BITS))
        totals = written(t.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("freed")), f"contexts-{order}")
        joined = t.join(small(totals), "context").withColumns({"own": (F.col("n") - off) / F.col("total"), "rest": F.col("freed") / F.col("total")})
        if below is None:
            p = joined.select("gram", (F.col("own") + F.col("rest") / SIZE).alias("p"))
        else:
            joined = joined.withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)))
            p = joined.join(small(below.select(F.col("gram").alias("end"), F.col("p").alias("lower"))), "end").select("gram", (F.col("own") + F.col("rest") * F.col("lower")).alias("p"))
        below = written(p, f"probabilities-{order}")
        made += [totals, below]
        own = below.select((F.col("gram") + F.lit(order << 60)).alias("key"), F.log("p").cast("float").alias("value"))
        weights = totals.select((F.col("context") + F.lit(_WEIGHTS << 60 | order << 48)).alias("key"), F.log(F.col("freed") / F.col("total")).cast("float").alias("value"))
        model = own.union(weights) if model is None else model.union(own).union(weights)
    out = written(model, "language-model")
    for table in (*made, *(tables[order] for order in range(1, ORDER))):
        forget(table)
    return out


class Model:
    """Entries (key, value) in order of the key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        edges = np.searchsorted(self.keys, np.array([k << 60 for k in range(1, ORDER + 2)] + [_WEIGHTS << 60 | k << 48 for k in range(1, ORDER + 2)], np.uint64))
        self.edges = edges[: ORDER + 1].tolist(), edges[ORDER + 1 :].tolist()

    def _found(self, base: int, place: tuple[int, int], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether they are there, values) of keys among the entries of that place."""
        a, b = place
        if a == b:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        own = keys + np.uint64(base)
        at = np.minimum(np.searchsorted(self.keys[a:b], own), b - a - 1) + a
        hit = self.keys[at] == own
        return hit, np.where(hit, self.values[at], np.float32(0))

    def each(self, found: np.ndarray) -> np.ndarray:
        """The log probability of the last character of each n-gram."""
        out = np.zeros(len(found))
        left = np.arange(len(found))
        for order in range(ORDER, 0, -1):
            own = found[left] & np.uint64((1 << BITS * order) - 1)
            hit, value = self._found(order << 60, (self.edges[0][order - 1], self.edges[0][order]), own)
            out[left] += value
            left, own = left[~hit], own[~hit]
            out[left] += self._found(_WEIGHTS << 60 | order << 48, (self.edges[1][order - 1], self.edges[1][order]), own >> np.uint64(BITS))[1]
        out[left] -= np.log(SIZE)
        return out

    def cost(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(minus the log probability in nats, number of characters) of each text."""
        codes, starts, lengths = classes(texts)
        if len(codes) < ORDER:
            return np.zeros(len(texts)), lengths
        sums = np.concatenate(([0.0], np.cumsum(self.each(grams(codes)))))
        begin = starts - (ORDER - 1)
        return sums[begin] - sums[begin + lengths], lengths

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same, in portions."""
        parts = [self.cost(portion) for portion in _portions(texts)]
        return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in ((0, np.float64), (1, np.int64)))

    @staticmethod
    def needed(texts: list[str | None]) -> np.ndarray:
        """The keys of all entries that a model may have for texts."""
        out = []
        for portion in _portions(texts):
            codes, _, _ = classes(portion)
            if len(codes) >= ORDER:
                found = np.unique(grams(codes))
                for order in range(ORDER, 0, -1):
                    own = np.unique(found & np.uint64((1 << BITS * order) - 1))
                    out += [own + np.uint64(order << 60), np.unique(own >> np.uint64(BITS)) + np.uint64(_WEIGHTS << 60 | order << 48)]
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _read(folder: str) -> Model:
    """The whole model."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".parquet"))
    tables = []
    for file in files:
        with fs.open_input_file(file) as opened:
            tables.append(pq.read_table(opened, columns=["key", "value"], use_threads=False))
    keys, values = (np.concatenate([t.column(c).to_numpy() for t in tables]) if tables else np.zeros(0, kind) for c, kind in (("key", np.int64), ("value", np.float32)))
    return Model(keys.astype(np.uint64), values)


def scored(docs: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """docs with (cost double, cost_chars long): minus log probability and length of each whole text; null texts have 0, 0. model is a written table."""
    if model.count() * 16 > MODEL_BYTES:
        return _joined(docs, model, text)
    folder = model._written_at

    def run() -> Callable:
        own = _read(folder)
        return lambda texts: pa.StructArray.from_arrays([pa.array(x) for x in own.costs(texts.to_pylist())], names=["cost", "cost_chars"])

    run = by_batch(run, "cost double, cost_chars long")
    name = free_name(docs.columns, "scored")
    return docs.withColumn(name, run(F.col(text))).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{name}.cost").alias("cost"), F.col(f"{name}.cost_chars").alias("cost_chars"))


def _joined(docs: DataFrame, model: DataFrame, text: str) -> DataFrame:
    """The same by joins: documents are numbered and put into blocks, each block asks the shards of the model for the keys
    that it needs, and meets the answers. No task holds more than a shard, or a block with its answers."""
    spark = docs.sparkSession
    number, block = free_name(docs.columns, "number_of_row"), free_name(docs.columns, "block_of_row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered").withColumn(block, F.floor(F.col(number) / BLOCK))
    shards = max(partitions(spark), model.count() // SHARD)
    schema = "shard int, block long, keys binary, values binary"

    def asked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            of, texts = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            for b in np.unique(of).tolist():
                keys = Model.needed([texts[k] for k in np.flatnonzero(of == b)])
                shard = _shard(keys, shards)
                order = np.argsort(shard, kind="stable")
                keys, shard = keys[order], shard[order]
                edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
                n = len(edge) - 1
                yield pa.RecordBatch.from_arrays([pa.array(shard[edge[:-1]].astype(np.int32)), pa.array(np.full(n, b, np.int64)), pa.array([keys[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary()), pa.nulls(n, pa.binary())], names=["shard", "block", "keys", "values"])

    def packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys, values = batch.column(0).to_numpy().astype(np.uint64), batch.column(1).to_numpy()
            shard = _shard(keys, shards)
            for x in np.unique(shard).tolist():
                own = shard == x
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([-1], pa.int64()), pa.array([keys[own].tobytes()], pa.binary()), pa.array([values[own].astype(np.float32).tobytes()], pa.binary())], names=["shard", "block", "keys", "values"])

    def answered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, known = None, [], None
        for batch in source:
            out = []
            for own, b, keys, values in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if own != shard:
                    shard, held, known = own, [], None
                if b < 0:
                    held.append((np.frombuffer(keys, np.uint64), np.frombuffer(values, np.float32)))
                    continue
                if known is None:
                    every = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.uint64)
                    order = np.argsort(every)
                    known = every[order], (np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.float32))[order]
                wanted = np.frombuffer(keys, np.uint64)
                if len(known[0]):
                    at = np.minimum(np.searchsorted(known[0], wanted), len(known[0]) - 1)
                    hit = known[0][at] == wanted
                    out.append((b, wanted[hit].tobytes(), known[1][at[hit]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["block", "keys", "values"])

    asks = rows.select(block, text).mapInArrow(lean(asked), schema)
    both = asks.union(model.select("key", "value").mapInArrow(lean(packed), schema)).repartition(shards, "shard").sortWithinPartitions("shard", "block")
    answers = both.mapInArrow(lean(answered), "block long, keys binary, values binary")
    fields = [*docs.schema.fields, T.StructField("cost", T.DoubleType()), T.StructField("cost_chars", T.LongType())]
    names = [f"c{k}" for k in range(len(docs.columns))]
    place = docs.columns.index(text)

    def judged(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, values = (np.concatenate([np.frombuffer(x, kind) for x in right.column(c).to_pylist()] or [np.zeros(0, kind)]) for c, kind in (("keys", np.uint64), ("values", np.float32)))
        once = np.unique(keys, return_index=True)[1]  # a block that two tasks read in part asks twice
        cost, chars = Model(keys[once], values[once]).costs(left.column(place).to_pylist())
        return pa.table([*(left.column(k) for k in range(len(names))), pa.array(cost), pa.array(chars)], names=[*names, "cost", "cost_chars"])

    left = rows.toDF(*names, "number_of_row", "block").groupBy("block")
    own = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)), *fields[-2:]])
    return left.cogroup(answers.groupBy("block")).applyInArrow(judged, own).toDF(*docs.columns, "cost", "cost_chars")


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, text, held) of all documents whose label for quality is 1; held says which are for the quantiles (copies of a text fall on the same side)."""
    good = labels_of(labels, "quality", "min").where("quality = 1").select("doc_id")
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    return docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("lang"), "text").where("length(text) > 0").join(small(good), "doc_id", "left_semi").select("lang", "text", held.alias("held"))


@dataclass
class Thresholds:
    """Mean cost a character and highest allowed score, by language; '*' for all others."""

    mean: dict[str, float]
    most: dict[str, float]

    def column(self, which: dict[str, float], lang: str) -> Column:
        known = [x for k, v in which.items() if k != "*" for x in (F.lit(k), F.lit(v))]
        rest = F.lit(which["*"])
        return F.coalesce(F.try_element_at(F.create_map(*known), F.coalesce(F.col(lang), F.lit(""))), rest) if known else rest


def thresholds(trusted: DataFrame, model: DataFrame) -> Thresholds:
    """From the scores of all trusted texts given. Languages are grouped before anything is sent to the driver: one row each."""
    each = written(scored(trusted, model).where("cost_chars > 0").select("lang", "cost", "cost_chars"), "trusted-scores")
    sums = each.groupBy("lang").agg(F.sum("cost").alias("cost"), F.sum("cost_chars").alias("chars"), F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["chars"] for r in sums)
    mean = {"*": sum(r["cost"] for r in sums) / total if total else 0.0}
    mean |= {r["lang"]: r["cost"] / r["chars"] for r in sums if r["n"] >= LEAST_TEXTS}
    known = Thresholds(mean, {})
    score = each.select("lang", _score(known.column(mean, "lang")).alias("score"))
    quantile = F.percentile_approx("score", QUANTILE, 100_000).alias("q")
    most = {r["lang"]: r["q"] for r in score.groupBy("lang").agg(quantile).collect() if r["lang"] in mean}
    whole = score.agg(quantile).first()["q"]
    forget(each)
    return Thresholds(mean, most | {"*": float("inf") if whole is None else whole})


def _score(mean: Column) -> Column:
    return (F.col("cost") + PRIOR_CHARS * mean) / (F.col("cost_chars") + PRIOR_CHARS)


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Thresholds]:
    """Model and thresholds from all documents that the labels call good. Where none fall on one side, all are on both."""
    small_batches(docs.sparkSession)
    trusted = trusted_texts(docs, labels)
    split = trusted.agg(F.count_if("held"), F.count_if(~F.col("held"))).first()
    seen, held = (trusted.where("not held"), trusted.where("held")) if all(split) else (trusted, trusted)
    counts = written(count_grams(seen), "trusted-grams")
    model = estimate(counts)
    forget(counts)
    return model, thresholds(held, model)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with quality_score (nats a character), perplexity, threshold and keep.

    perplexity is exp of the mean cost a character of the whole text, threshold the quantile that the score must not
    exceed. Null, empty and white-space texts have a null perplexity and are not kept. A language with few trusted
    texts, or none, is judged by the quantile of all languages. Repeated rows are each judged alike. Without any trusted
    text all non-empty texts are kept. Columns of docs pass unchanged; those called like a new one are replaced.
    """
    model, limit = train(docs, labels)
    base = docs.drop(*[c for c in docs.columns if c.lower() in NEW])
    rows = scored(base, model)
    mean, most = limit.column(limit.mean, "lang"), limit.column(limit.most, "lang")
    empty = F.length(F.trim(F.translate(F.coalesce(F.col("text"), F.lit("")), "\t\n\r", "   "))) == 0
    rows = rows.withColumns({"quality_score": F.when(~empty, _score(mean)), "perplexity": F.when(~empty, F.exp(F.col("cost") / F.col("cost_chars"))), "threshold": most})
    return rows.withColumn("keep", F.coalesce(F.col("quality_score") <= F.col("threshold"), F.lit(False))).drop("cost", "cost_chars")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns, whatever their names."""
    names = {c: free_name(docs.columns, f"own_{c}") if c.lower() in NEW else c for c in docs.columns}
    kept = judged(docs.withColumnsRenamed(names), labels).where("keep")
    return kept.select(*[F.col(f"`{own}`").alias(c) for c, own in names.items()])
