"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: words are counted per label, and those whose log-odds with an informative Dirichlet prior (the words' shares
of the whole training text) have a high z score are candidates. A second count takes each candidate once a document and
once a context, so that neither one long text nor a copied one makes a word frequent; what chance can't explain there
makes up the lexicon, with the log-odds of these counts.

Scoring: each token has its log-odds, tokens outside the lexicon a small negative score. A linear scan finds all
maximal scoring segments of the whole text; each gets its bits above chance from extreme-value statistics (the scale
that solves sum p * exp(scale * s) = 1, and the length of the text). The best segment's bits, with what further
significant ones add, go through a logistic curve fitted to the training labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import batches, by_batch, labels_of, lean, lower_words, small, small_batches, written

#: What lower_words takes for a word, to find it in the text.
WORD = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")

#: Pseudo-tokens of the Dirichlet prior, spread by the words' shares, and what each word gets besides.
PRIOR, LEAST_PRIOR = 500.0, 0.5
#: Least z score of a candidate; least number of toxic documents with contexts of their own of a word of the lexicon; and
#: the odds against chance, over all words of the vocabulary, that such a word must have (natural logarithm).
Z_COUNT, LEAST_CONTEXTS, AGAINST_CHANCE = 1.5, 3, 2.0
#: Candidates that are sent to the workers as a set; more are joined, with the same results.
CANDIDATES = 50_000
#: Words of the lexicon that may be broadcast; a larger one is an error, never cut.
LEXICON = 1_000_000
#: Log-odds are held in these bounds, so that no single word outweighs all else.
HIGHEST = 8.0
#: Distinct words that a task counts before it passes them on.
FLUSH = 150_000


@dataclass
class Model:
    words: dict[bytes, float] = field(default_factory=dict)
    drift: float = -0.02
    scale: float = 1.0
    #: The K of extreme-value statistics: a clean text of m tokens has K * m * exp(-scale * s) segments of s and more.
    rate: float = 1e-3
    weight: float = 1.0
    bias: float = -3.0

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments (start, end, score) of the tokens, in one linear scan."""
        get = self.words.get
        hits = [(i, s) for i, w in enumerate(words) if (s := get(w)) is not None]
        # stacked segments: (start, end, total before it, total after it, place of the nearest one below that begins lower or -1)
        stack: list[tuple[int, int, float, float, int]] = []
        out: list[tuple[int, int, float]] = []
        total, at = 0.0, 0
        for i, s in hits:
            total += self.drift * (i - at)
            at = i + 1
            begin, end, before, after = i, i + 1, total, total + s
            total = after
            if s <= 0:
                continue
            while True:
                k = len(stack) - 1
                while k >= 0 and stack[k][2] >= before:
                    k = stack[k][4]
                if k < 0:  # none begins lower: nothing that follows can be joined to those on the stack
                    out += [(b, e, high - low) for b, e, low, high, _ in stack]
                    stack.clear()
                    break
                if stack[k][3] >= after:
                    break
                begin, before = stack[k][0], stack[k][2]
                del stack[k:]
            stack.append((begin, end, before, after, k))
        return out + [(b, e, high - low) for b, e, low, high, _ in stack]

    def feature(self, words: list[bytes]) -> float:
        """Bits above chance of the best segment, and the logarithm of how many are significant."""
        if self.words.keys().isdisjoint(words):
            return 0.0
        chance = math.log(max(self.rate * len(words), 1e-12)) if words else 0.0
        above = [max(0.0, self.scale * s - chance) for _, _, s in self.segments(words)]
        strong = [x for x in above if x > 0]
        return max(strong) + math.log(len(strong)) if strong else 0.0

    def score(self, text: str | None) -> float:
        x = self.weight * self.feature(lower_words(text)) + self.bias
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, bits above chance) of each significant passage, in code points of the text."""
        found = list(WORD.finditer(text or ""))
        words = [m[0].lower().encode("utf-8", "surrogatepass") for m in found]
        chance = math.log(max(self.rate * len(words), 1e-12)) if words else 0.0
        return [(found[b].start(), found[e - 1].end(), bits) for b, e, s in self.segments(words) if (bits := self.scale * s - chance) > 0]


def _odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """Log-odds of the shares of toxic and of clean documents that have a word, with an informative Dirichlet prior."""
    prior = LEAST_PRIOR + (toxic + clean) / (all_toxic + all_clean + 1)
    t, c = toxic + prior, clean + prior
    return np.log(t / (all_toxic + 2 * prior - t)) - np.log(c / (all_clean + 2 * prior - c))


def _surprise(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Half the likelihood-ratio statistic of so many toxic among the documents that have a word; 0 where they are fewer than the share."""
    n = toxic + clean
    part = lambda x, p: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(n * p, 1e-12)), 0.0)
    return np.where(toxic > n * share, part(toxic, share) + part(clean, 1 - share), 0.0)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of all labelled documents that aren't held out."""
    known = labels_of(labels, "toxic").where(~held_out("doc_id"))
    return docs.select("doc_id", "text").where("text is not null").join(small(known), "doc_id").select("text", "toxic")


def held_out(key: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def _word_counts(rows: DataFrame) -> DataFrame:
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            words = counts[0].keys() | counts[1].keys()
            yield from batches(((w.decode("utf-8", "replace"), counts[1][w], counts[0][w]) for w in words), schema, 50_000)
            for c in counts:
                c.clear()

        for batch in source:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[1 if toxic else 0].update(lower_words(text))
                if len(counts[0]) + len(counts[1]) > FLUSH:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(lean(run), "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _contexts(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(word, toxic, contexts): in how many documents, by label, each candidate (word) stands, where documents in which
    it first stands between the same two words count once: copies of one text are one finding."""
    few = candidates.select("word").limit(CANDIDATES + 1).collect()
    shared = rows.sparkSession.sparkContext.broadcast({r["word"].encode() for r in few}) if len(few) <= CANDIDATES else None
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int32()), ("context", pa.string())])

    def found(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = shared.value if shared is not None else None
        for batch in source:
            seen = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = lower_words(text)
                first = {w: i for i, w in zip(range(len(words) - 1, -1, -1), reversed(words), strict=True)} if known is None else {w: words.index(w) for w in known.intersection(words)}
                for w, i in first.items():
                    seen.add((w.decode("utf-8", "replace"), int(bool(toxic)), b" ".join(words[max(0, i - 1) : i + 2]).decode("utf-8", "replace")))
                if len(seen) > FLUSH:
                    yield from seen
                    seen.clear()
            yield from seen

    each = rows.mapInArrow(lean(lambda source: batches(found(source), schema)), "word string, toxic int, context string")
    if shared is None:
        each = each.join(small(candidates.select("word")), "word", "left_semi")
    return each.distinct().groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("contexts"))


def _lexicon(candidates: DataFrame, contexts: DataFrame, texts: dict[bool, float], vocabulary: int) -> DataFrame:
    """(word, toxic, clean, odds) of the candidates whose contexts chance can't explain."""
    n = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("contexts")).otherwise(0))
    pairs = contexts.groupBy("word").agg(n(1).alias("own_toxic"), n(0).alias("own_clean"))
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64()), ("odds", pa.float64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            toxic, clean = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (3, 4))
            odds = _odds(toxic, clean, texts[True], texts[False])
            surprise = _surprise(toxic, clean, texts[True] / (texts[True] + texts[False]))
            chosen = pa.array((toxic >= LEAST_CONTEXTS) & (surprise >= math.log(vocabulary) + AGAINST_CHANCE) & (odds > 0.5))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(odds)], schema=schema).filter(chosen)

    joined = candidates.join(pairs, "word").select("word", "toxic", "clean", "own_toxic", "own_clean")
    return joined.mapInArrow(lean(run), "word string, toxic long, clean long, odds double")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled documents that aren't held out.

    Null texts and labels are left out; no labelled documents at all give a model that finds nothing toxic.
    """
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels)
    counts = written(_word_counts(rows), "toxic-words")
    sums = counts.agg(F.sum("toxic"), F.sum("clean"), F.count(F.lit(1))).first()
    all_toxic, all_clean, vocabulary = float(sums[0] or 0), float(sums[1] or 0), int(sums[2])
    model = Model()
    if not all_toxic or not all_clean:
        return model
    texts = {r["toxic"] > 0: float(r["n"]) for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    t, c = F.col("toxic"), F.col("clean")
    prior = LEAST_PRIOR + PRIOR * (t + c) / (all_toxic + all_clean)
    odds = F.log((t + prior) / F.lit(all_toxic)) - F.log((c + prior) / F.lit(all_clean))
    z = odds / F.sqrt(1 / (t + prior) + 1 / (c + prior))
    candidates = written(counts.withColumn("z", z).where((F.col("z") >= Z_COUNT) & (t >= LEAST_CONTEXTS)).select("word", "toxic", "clean"), "toxic-candidates")
    if candidates.isEmpty():
        return model
    lexicon = written(_lexicon(candidates, _contexts(rows, candidates), texts, vocabulary), "toxic-lexicon")
    chosen = sorted(lexicon.limit(LEXICON + 1).collect(), key=lambda r: r["word"])
    if len(chosen) > LEXICON:
        raise ValueError(f"the lexicon has more than {LEXICON} words, too many to broadcast")
    model.words = {r["word"].encode(): float(min(r["odds"], HIGHEST)) for r in chosen}
    if not model.words:
        return model
    inside = np.array([(r["toxic"], r["clean"]) for r in chosen], float)
    rest = np.log((all_toxic - inside[:, 0].sum() + 1) / (all_toxic + 1)) - np.log((all_clean - inside[:, 1].sum() + 1) / (all_clean + 1))
    model.drift = float(min(-0.02, rest))
    # the scale and rate of chance segments in clean text
    share = (inside[:, 1] + PRIOR * 1e-4) / (all_clean + PRIOR)
    scores = np.array([*model.words.values(), model.drift])
    share = np.array([*share, max(0.0, 1 - share.sum())])
    model.scale = _scale(scores, share)
    model.rate = float(share[:-1].sum())
    return _calibrate(_rated(model, rows), rows)


def _scale(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive solution of sum share * exp(scale * score) = 1; 1 where the mean score isn't negative."""
    value = lambda x: float(np.sum(share * np.exp(np.clip(x * scores, -700, 700)))) - 1
    if float(np.sum(share * scores)) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while value(high) < 0 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _rated(model: Model, rows: DataFrame) -> Model:
    """model with K from the clean training texts: the number of their segments whose scaled score is 1 and more, over what K = 1 lets expect."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, high, tokens = shared.value, 0, 0
        for batch in source:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not toxic:
                    words = lower_words(text)
                    tokens += len(words)
                    if not own.words.keys().isdisjoint(words):
                        high += sum(own.scale * s >= 1 for _, _, s in own.segments(words))
        yield pa.RecordBatch.from_arrays([pa.array([high], pa.int64()), pa.array([tokens], pa.int64())], names=["high", "tokens"])

    found = rows.mapInArrow(lean(run), "high long, tokens long").agg(F.sum("high").alias("high"), F.sum("tokens").alias("tokens")).first()
    shared.destroy()
    if found["tokens"]:
        model.rate = (found["high"] + 0.5) * math.e / found["tokens"]
    return model


def _calibrate(model: Model, rows: DataFrame) -> Model:
    """Logistic curve over the feature, fitted to a histogram of (feature to three digits, label) counts of all training texts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("bin", pa.float64()), ("toxic", pa.int32()), ("n", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        own, counts = shared.value, Counter()
        for batch in source:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[float(f"{own.feature(lower_words(text)):.3g}"), int(bool(toxic))] += 1
        yield from ((*k, n) for k, n in counts.items())

    bins = rows.mapInArrow(lean(lambda source: batches(run(source), schema)), "bin double, toxic int, n long").groupBy("bin", "toxic").agg(F.sum("n").alias("n")).collect()  # 900 rows a power of ten and label at most
    shared.destroy()
    x = np.array([r["bin"] for r in bins])
    y = np.array([float(r["toxic"]) for r in bins])
    n = np.array([float(r["n"]) for r in bins])
    design = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([0.5, -2.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.01 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-7:
            break
    model.weight, model.bias = float(max(beta[0], 0.0)), float(beta[1])
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (double from 0 to 1): a null or empty text has the score of a text without findings."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    run = by_batch(lambda: lambda texts: pa.array([shared.value.score(t) for t in texts.to_pylist()], pa.float64()), "double")
    return docs.withColumn("score", run(F.col(text)))


def found_passages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end, bits) per significant toxic passage of the whole texts, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:int,end:int,bits:double>>")
    def run(column):  # noqa: ANN001, ANN202
        return column.map(lambda t: [{"start": a, "end": b, "bits": x} for a, b, x in shared.value.passages(t)])

    return docs.select(key, F.explode(run(F.col(text))).alias("p")).select(key, "p.start", "p.end", "p.bits")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is under 0.5, with docs' own columns."""
    name = "score" if "score" not in {c.lower() for c in docs.columns} else None
    if name:
        return scored(docs, train(docs, labels)).where("score < 0.5").select(*docs.columns)
    plain = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c.lower() == "score"})
    return scored(plain, train(docs, labels)).where("score < 0.5").select(*[F.col(f"_own_{c}" if c.lower() == "score" else c).alias(c) for c in docs.columns])
