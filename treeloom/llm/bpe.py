"""BPE encoding by backtracking over longest matches, decoding by an offset table.

The encoder never runs the merge loop on a text. One scan with an Aho-Corasick automaton gives the longest token at each
position; a token is kept if it may follow the one before it, which the pair-compatibility table answers: two tokens
may stand side by side in a BPE result exactly if no merge across their border comes before the merges that made them.
Where a token may not follow, the next shorter one is tried, then the token before it is taken back. A bit set of dead
positions keeps this linear in the length of the word.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.common import by_batch, lean, small_batches

#: The characters that have Unicode's White_Space property.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: The Latin letters that stay single letters of this range in lower case and under NFC. Texts of these,
#: ASCII and nothing else are split by the standard library's engine, others by one that knows all of Unicode.
LATIN = "\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u012f\\u0131-\\u0148\\u014a-\\u017e"
_OTHER = re.compile(f"[^\\x00-\\x7f{LATIN}]")

#: Marks the end of a word inside the automaton; no byte symbol uses it.
_END = "\x00"

#: Bytes of the words that a worker remembers, in two halves: when the newer one is full, it takes the place of the older.
#: Words are of any length, so that a number of them would bound nothing.
MEMO_BYTES = 32_000_000

#: Pairs of tokens that a worker remembers, in two halves like its words.
MEMO_PAIRS = 200_000

#: Token ids after which a batch of results is handed on: texts are of any length, and rows of a batch many.
BATCH_IDS = 1 << 18


def byte_symbols() -> list[str]:
    """The printable symbol for each byte of a byte-level vocabulary: printable Latin-1 stays, the rest moves to U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A word-end byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        known: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*known.values(), *self.special.values()])
        names = [""] * size
        for token, i in (*known.items(), *self.special.items()):
            names[i] = token
        # the offset table: token i is the stretch offsets[i]:offsets[i + 1] of one string
        self.joined = "".join(names)
        self.offsets = [0]
        for name in names:
            self.offsets.append(self.offsets[-1] + len(name))
        #: ids as text, and the tokens by them
        self.written = [str(i) for i in range(size)]
        self.tokens = {text: self.token(i) for i, text in enumerate(self.written)}
        inner = {i: self._inner(t) for t, i in known.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: left id << 32 | right id to the rank of their merge
        self.merge: dict[int, int] = {}
        #: by id: the rank of the merge that makes a token (-1: none), and the two tokens it merges
        self.rank, self.left, self.right = (array("i", [-1]) * size for _ in range(3))
        for rank, (a, b) in enumerate(merges):
            whole, left, right = known[a + b], known[a], known[b]
            self.merge.setdefault(left << 32 | right, rank)
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, left, right
        #: finds, from the end of a word on, the tokens that begin at each place
        self.automaton = ahocorasick.Automaton()
        by_text = {text: i for i, text in inner.items() if self.rank[i] >= 0 or self._is_symbol(text)}
        for text, i in by_text.items():
            self.automaton.add_word(text[::-1], i)
        self.automaton.make_automaton()
        #: token to the longest token that is a proper prefix of it, or -1
        self.shorter = array("i", [-1]) * size
        for text, i in by_text.items():
            self.shorter[i] = next((by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in by_text), -1)
        self.lengths = array("i", [len(inner.get(i, "")) for i in range(size)])
        self.compatible: dict[int, bool] = {}
        self.older: dict[int, bool] = {}
        self.symbols = byte_symbols()
        pattern = f"'s|'t|'re|'ve|'m|'ll|'d|[\\p{{L}}]+|[\\p{{N}}]|[^{WHITE_SPACE}\\p{{L}}\\p{{N}}]+"
        self.words = regex.compile(pattern)
        self.latin_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\\t-\\r a-z0-9{LATIN}]+")
        self.space = regex.compile(f"[{WHITE_SPACE}]+")
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _inner(self, token: str) -> str:
        return token[: -len(self.suffix)] + _END if self.suffix and token.endswith(self.suffix) else token

    def _is_symbol(self, text: str) -> bool:
        return len(text) == 1 or (len(text) == 2 and text[1] == _END)

    def token(self, i: int) -> str:
        return self.joined[self.offsets[i] : self.offsets[i + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side in a BPE result."""
        key = left << 32 | right
        known = self.compatible.get(key)
        if known is None:
            known = self.older.get(key)
            if known is None:
                known = self._fits(left, right)
            if len(self.compatible) >= MEMO_PAIRS // 2:
                self.older, self.compatible = self.compatible, {}
            self.compatible[key] = known
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Undo both tokens' merges from the latest on; a merge over the border that came before the one undone rules the pair out."""
        limit = float("inf")
        while True:
            found = self.merge.get(left << 32 | right)
            if found is not None and found < limit:
                return False
            of_left, of_right = self.rank[left], self.rank[right]
            if of_left < 0 and of_right < 0:
                return True
            # the later of the two merges is undone; at equal ranks the one further left came first
            if of_left > of_right:
                limit, left = of_left, self.right[left]
            else:
                limit, right = of_right + 1, self.left[right]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte symbols without the end mark."""
        text = word + _END if self.suffix else word
        n = len(text)
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        dead = bytearray(n + 1)
        path: list[int] = []
        starts: list[int] = []
        at = 0
        longest = self._longest(text)
        last = n - 1
        token = longest.get(last, -1)
        while at < n:
            while token >= 0:
                end = at + lengths[token]
                if not dead[end]:
                    if not path:
                        break
                    known = compatible.get(path[-1] << 32 | token)
                    if self.fits(path[-1], token) if known is None else known:
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                starts.append(at)
                at = end
                if at < n:
                    token = longest.get(last - at, -1)
            else:
                dead[at] = 1
                if not path:
                    raise ValueError(f"no encoding of {word!r}")
                at = starts.pop()
                token = shorter[path.pop()]
        return path

    def _longest(self, text: str) -> dict[int, int]:
        """The longest token that begins at each place, by the place counted from the end, by one scan of the reversed text."""
        found = list(self.automaton.iter(text[::-1]))
        found.reverse()  # of the tokens that begin at a place the scan tells the longest first
        return dict(found)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not _OTHER.search(text):
            return self.latin_words.findall(text.lower())
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        return self.words.findall("".join(map(str.lower, text)) if "Σ" in text else text.lower())

    def encode_split(self, word: str) -> list[int]:
        """Ids of a word of split()."""
        return self.encode_word(word if word.isalpha() and word.isascii() else "".join([self.symbols[b] for b in word.encode("utf-8")]))

    def decode(self, ids: list[int]) -> str:
        """Tokens as they are written in the vocabulary, with one space between: what a file without a decoder gives."""
        return " ".join([self.joined[self.offsets[i] : self.offsets[i + 1]] for i in ids])


class Encoder:
    """Vocabulary with a memo from words to their ids as text: tokens are looked up from the ids, so that many words fit."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.held = 0  # bytes of memo

    def _word(self, word: str) -> str:
        got = self.memo.get(word)
        if got is not None:
            return got
        got = self.older.get(word)
        if got is None:
            written = self.vocabulary.written
            got = " ".join([written[i] for i in self.vocabulary.encode_split(word)])
        # 100: the entry
        size = sys.getsizeof(word) + sys.getsizeof(got) + 100
        if size <= MEMO_BYTES // 100:
            if self.held + size > MEMO_BYTES // 2:
                self.older, self.memo, self.held = self.memo, {}, 0
            self.memo[word] = got
            self.held += size
        return got

    def _parts(self, text: str) -> list[str]:
        get, word = self.memo.get, self._word
        return [get(w) or word(w) for w in self.vocabulary.split(text)]

    def text(self, text: str) -> tuple[str, str, int]:
        """Ids and decoded tokens, each joined by one space, and the number of ids, of a whole text; special tokens in it are taken first, as they stand."""
        own = self.vocabulary
        if own.specials is None or "<" not in text:
            parts = self._parts(text)
        else:
            parts, at = [], 0
            for m in own.specials.finditer(text):
                parts += self._parts(text[at : m.start()])
                parts.append(str(own.special[m[0]]))
                at = m.end()
            parts += self._parts(text[at:])
        if not parts:
            return "", "", 0
        joined = " ".join(parts)
        ids = joined.split(" ")
        return joined, " ".join(map(own.tokens.__getitem__, ids)), len(ids)

    def ids(self, text: str) -> list[int]:
        joined = self.text(text)[0]
        return [int(i) for i in joined.split(" ")] if joined else []


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """docs with an array column of the token ids of each whole text, and with the text decoded from them where ``decoded`` names a column for it.

    A null or empty text gives an empty array. Columns called like a new one are replaced; other columns pass unchanged.
    vocabulary is the path of the tokenizers file on every executor (an installed package's file, for instance).
    """
    small_batches(docs.sparkSession)
    new = {ids.lower(), (decoded or ids).lower()}
    rest = [c for c in docs.columns if c.lower() not in new]
    source = docs.select(*rest, F.col(text).alias("_text"))
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(vocabulary)  # once a task: workers outlive their tasks, and idle ones need none
        for batch in batches:
            values, edges, tokens, start = [], [0], [], 0
            for at, value in enumerate(batch.column(len(rest)), 1):
                as_text, back, n = own.text(value.as_py() or "")
                values.append(np.fromstring(as_text, np.int32, sep=" ") if n else np.zeros(0, np.int32))
                edges.append(edges[-1] + n)
                if decoded:
                    tokens.append(back)
                if edges[-1] >= BATCH_IDS or at == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(values)))
                    passed = [c.slice(start, at - start) for c in batch.columns[: len(rest)]]
                    columns = [*passed, lists, *([pa.array(tokens, pa.string())] if decoded else [])]
                    values, edges, tokens, start = [], [0], [], at
                    yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return source.mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """encoded with a text column decoded from the ids; null ids give an empty text."""

    def run() -> Callable:
        own = Vocabulary(vocabulary)
        return lambda column: pa.array([own.decode(x) if x is not None else "" for x in column.to_pylist()], pa.string())

    return encoded.withColumn(text, by_batch(run, "string")(F.col(ids)))


def digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row, from one pass that encodes and decodes each whole text.

    Null and empty texts have no tokens and the digests of the empty string. Repeated rows give repeated results.
    A text is worked on as a whole, whatever its length; memory is that of one Arrow batch, the longest text and the memo.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(vocabulary)
        sha = hashlib.sha256
        for batch in source:
            number, of_ids, of_text = [], [], []
            for value in batch.column(1):
                ids, tokens, n = own.text(value.as_py() or "")
                number.append(n)
                of_ids.append(sha(ids.encode()).hexdigest())
                of_text.append(sha(tokens.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
