"""BPE encoding and decoding with a transducer lexicon.

The vocabulary's whole words (those with the end-of-word mark, the words that were frequent where
the vocabulary comes from) are merged once on the driver and compiled into a minimal acyclic
transducer with their ids as outputs. Its block is broadcast (a few MB, checked) and memory-mapped
by each worker. A word of a text is looked up in it; an unseen word is merged exactly, lowest rank
first and leftmost among equals, with a heap when it is long. Results of the last distinct words
are remembered up to a bound.

Edge cases: null and empty texts have no ids and decode to an empty text. The strings of special
tokens in a text become their ids, as the library does. Repeated rows are answered one by one,
extra columns are ignored. A very long word takes O(n log n) time; its result isn't remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, prepare
from .lexicon import Lexicon, compile_lexicon

#: Most bytes of model that are broadcast, distinct words that a worker remembers, and their longest.
MODEL_LIMIT, REMEMBERED, LONGEST = 64 << 20, 250_000, 64
#: Rows that go into one output batch.
ROWS = 256
#: Unicode white space.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
#: The split pattern of the vocabulary, in full and for texts within Latin-1.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_L, _N = "a-zA-Z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^ {_L}{_N}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """The merge table of a vocabulary with end-of-word marks."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.table = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}

    def merge(self, word: bytes) -> list[int]:
        ids = [self.inner[b] for b in word]
        if not ids:
            return ids
        ids[-1] = self.last[word[-1]]
        return self._long(ids) if len(ids) > 48 else self._short(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get = self.table.get
        found = [get(a << 20 | b) for a, b in zip(ids, ids[1:])]
        while True:
            best = min((f for f in found if f), default=None)
            if best is None:
                return ids
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i < len(found):
                found[i] = get(ids[i] << 20 | ids[i + 1])
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | ids[i])

    def _long(self, ids: list[int]) -> list[int]:
        get, n = self.table.get, len(ids)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(f[0], i, f[1]) for i in range(n - 1) if (f := get(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or (get(ids[i] << 20 | ids[j]) or (0, -1))[1] != new:
                continue
            ids[i], ids[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                if f := get(new << 20 | ids[right[j]]):
                    heapq.heappush(heap, (f[0], i, f[1]))
            if left[i] >= 0 and (f := get(ids[left[i]] << 20 | new)):
                heapq.heappush(heap, (f[0], left[i], f[1]))
        return [x for x in ids if x >= 0]


class Model:
    """What workers need, in one picklable object: vocabulary, merges, special tokens, lexicon block."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, special: dict[str, int], words: list[str] | None = None):
        self.vocab, self.merges, self.suffix, self.special = vocab, merges, suffix, special
        merger = Merger(vocab, merges, suffix)
        back = {c: b for b, c in enumerate(byte_letters())}
        if words is None:
            words = [bytes(back[c] for c in t[: -len(suffix)]) for t in vocab if t.endswith(suffix) and len(t) > len(suffix) and all(c in back for c in t[: -len(suffix)])]
        else:
            words = [w.encode() for w in words]
        self.block = compile_lexicon((w, merger.merge(w)) for w in set(words))

    @classmethod
    def from_json(cls, path: str, words: list[str] | None = None) -> "Model":
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        return cls(model["vocab"], model["merges"], model["end_of_word_suffix"], {t["content"]: t["id"] for t in whole["added_tokens"]}, words)


class Coder:
    """Encodes and decodes in a worker. Words map to (ids as bytes, their tokens joined by blanks)."""

    def __init__(self, model: Model):
        self.lexicon, self.merger = Lexicon(model.block), Merger(model.vocab, model.merges, model.suffix)
        self.tokens = {i: t for t, i in model.vocab.items()} | {i: t for t, i in model.special.items()}
        self.special = model.special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) + ")") if model.special else None
        self.known: dict[str, tuple[bytes, str]] = {}

    def word(self, word: str) -> tuple[bytes, str]:
        data = word.encode("utf-8", "surrogatepass")
        ids = self.lexicon.find(data)
        if ids is None:
            ids = b"".join(i.to_bytes(4, "little") for i in self.merger.merge(data))
        out = (ids, " ".join([self.tokens[i] for i in memoryview(ids).cast("I")]))
        if len(data) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = out
        return out

    def split(self, text: str) -> list[str]:
        """Normalised words: composed, white space joined, lower case by character."""
        text = _SPACE.sub(" ", text if text.isascii() else unicodedata.normalize("NFC", text))
        text = text.replace("Σ", "σ").lower()  # no final form of sigma: each character for itself
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _WORDS.findall(text)
        return _LATIN.findall(text)

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text."""
        if not text:
            return b"", ""
        pieces = self.cut.split(text) if self.cut else [text]
        pairs: list[tuple[bytes, str]] = []
        for piece in pieces:
            if piece in self.special:
                pairs.append((self.special[piece].to_bytes(4, "little"), piece))
            elif piece:
                words = self.split(piece)
                known = self.known
                try:
                    pairs += [known[w] for w in words]
                except KeyError:
                    pairs += [known.get(w) or self.word(w) for w in words]
        return b"".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs if p[1]])


def coder(model: Model) -> Coder:
    """One coder for each worker process and model."""
    return held("bpe" + hashlib.sha256(model.block).hexdigest(), lambda: Coder(model))


def default_model() -> Model:
    import public_tokenizers

    return Model.from_json(public_tokenizers.path("word_bpe_49k.json"))


def _broadcast(spark: SparkSession, model: Model):
    size = len(model.block) + sum(map(len, model.vocab)) * 3
    if size > MODEL_LIMIT:
        raise ValueError(f"the model has {size} bytes; at most {MODEL_LIMIT} are broadcast")
    return prepare(spark).sparkContext.broadcast(model)


def encode(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with `ids` (array of int) and `decoded` (string) added; all other columns stay."""
    shared = _broadcast(docs.sparkSession, model or default_model())
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = docs.select(*kept).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shared.value)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                found = [own.encode(t.as_py()) for t in part.column("text")]
                ends = [0]
                for ids, _ in found:
                    ends.append(ends[-1] + len(ids) // 4)
                flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids for ids, _ in found))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array([d for _, d in found], pa.string())], [*kept, "ids", "decoded"])

    return docs.select(*kept).mapInArrow(work, schema)


def decode(encoded: DataFrame, model: Model | None = None) -> DataFrame:
    """encoded (with an `ids` column) with `decoded` added: the tokens joined by blanks."""
    model = model or default_model()
    tokens = {i: t for t, i in [*model.vocab.items(), *model.special.items()]}
    shared = prepare(encoded.sparkSession).sparkContext.broadcast(tokens)
    kept = [c for c in encoded.columns if c != "decoded"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for batch in batches:
            text = [None if ids.as_py() is None else " ".join(names[i] for i in ids.as_py()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(work, encoded.select(*kept).schema.add("decoded", "string"))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op2."""
    shared = _broadcast(docs.sparkSession, default_model())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = coder(shared.value), hashlib.sha256
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids, decoded = own.encode(text.as_py())
                rows.append((len(ids) // 4, sha(ids).hexdigest(), sha(decoded.encode("utf-8")).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
