"""Encoding of texts by a public byte-level BPE vocabulary, as a lazily determinised transducer.

The merges of a vocabulary define which token may follow which: a sequence of tokens is the
encoding of its text exactly if that holds for every two neighbours, and the encoding of a
prefix is found by extending encodings of shorter prefixes. So a word can be read byte by byte:
a state is the last token that is certain and the bytes after it that are not; a token is
emitted as soon as no continuation can change it, at the latest when more bytes are pending than
the longest token has. States and transitions are made when first met and then looked up.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies of this family cut a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and states remembered by one worker before it starts over.
WORDS, STATES = 1 << 18, 1 << 20


class Vocabulary:
    """Tokens with their ranks, which are also their ids, from lines of base64 text and rank."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}
        self.token = {i: t for t, i in self.rank.items()}
        self.begins = {t[:k] for t in self.rank for k in range(1, len(t))}
        self._pair: dict[tuple[int, int], bool] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """The merges applied by their definition; the transducer needs it for two tokens only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self._pair:
            x, y = self.token[a], self.token[b]
            self._pair[key] = self.merge(x + y) == [x, y]
        return self._pair[key]


class _State:
    """sure: the last certain token (-1 at a word's beginning); open: the bytes after it.

    ways: places in `open` where a further token may begin, each with the token that ends there
    and the place that token began at.
    """

    __slots__ = ("next", "open", "rest", "sure", "ways")

    def __init__(self, sure: int, open_: bytes, ways: dict[int, tuple[int, int]]):
        self.sure, self.open, self.ways = sure, open_, ways
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}
        out, at = [], len(open_)
        while at:
            token, at = ways[at]
            out.append(token)
        self.rest = tuple(reversed(out))


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words: dict[str, tuple[int, ...]] = {}
        self.cut = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[int, bytes], _State] = {}
        self.start = self._state(-1, b"", {})

    def _state(self, sure: int, open_: bytes, ways: dict[int, tuple[int, int]]) -> _State:
        key = (sure, open_)
        if key not in self.states:
            self.states[key] = _State(sure, open_, ways)
        return self.states[key]

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """Determinise one transition."""
        voc, now = self.vocabulary, state.open + bytes([byte])
        end = len(now)
        ways = dict(state.ways)
        for at in [0, *sorted(ways)]:
            token = voc.rank.get(now[at:])
            if token is None:
                continue
            before = ways[at][0] if at else state.sure
            if before < 0 or voc.may_follow(before, token):
                ways[end] = (token, at)
                break
        # Places from which no token can reach beyond the end are closed for good.
        alive = [at for at in [0, *sorted(ways)] if at == end or now[at:] in voc.begins]

        def back(at: int) -> list[int]:
            out = [at]
            while at:
                at = ways[at][1]
                out.append(at)
            return out

        # The last place that every living way passes: walk the foremost way back over the others.
        ahead = [at for at in alive if at]
        while len(ahead) > 1:
            ahead[-1] = ways[ahead[-1]][1]
            ahead = sorted(set(ahead))
        sure_at = 0 if 0 in alive else ahead[0]
        emitted, at = [], sure_at
        while at:
            token, at = ways[at]
            emitted.append(token)
        emitted.reverse()
        kept = {}
        for place in alive:
            for at in back(place):
                if at > sure_at:
                    kept[at - sure_at] = (ways[at][0], ways[at][1] - sure_at)
        following = self._state(emitted[-1] if emitted else state.sure, now[sure_at:], kept)
        state.next[byte] = (following, tuple(emitted))
        return state.next[byte]

    def word(self, data: bytes) -> tuple[int, ...]:
        state, out = self.start, []
        for byte in data:
            step = state.next.get(byte)
            if step is None:
                step = self._step(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        return (*out, *state.rest)

    def text(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one. What looks like a special token is text."""
        out: list[int] = []
        if not text:
            return out
        words = self.words
        for w in self.cut(text):
            ids = words.get(w)
            if ids is None:
                if len(self.states) > STATES:
                    self._reset()
                ids = self.word(w.encode())
                if len(w) <= 64:
                    if len(words) >= WORDS:
                        words.clear()
                    words[w] = ids
            out += ids
        return out


class StreamDecoder:
    """Ids to text as they come: bytes of an unfinished character are held back."""

    def __init__(self, vocabulary: Vocabulary):
        self.token = vocabulary.token
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.utf8.decode(b"".join(map(self.token.__getitem__, ids)))

    def close(self) -> str:
        return self.utf8.decode(b"", True)


_MADE: dict[int, Transducer] = {}


def transducer(lines: bytes) -> Transducer:
    """The process's transducer of a vocabulary; what it has learnt serves all its tasks."""
    key = hash(lines)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Transducer(Vocabulary(lines))
    return _MADE[key]


def vocabulary_file(name: str, folder: str = "/opt/tokenizers") -> bytes:
    """A vocabulary as ranks, read on the driver; its size is that of the vocabulary (under 1 MB)."""
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        return file.read()


def spread(docs: DataFrame) -> DataFrame:
    """At least two partitions per core where the files give fewer; large inputs stay as they are split."""
    least = 2 * docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(least) if docs.rdd.getNumPartitions() < least else docs


def encode(documents: DataFrame, vocabulary: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>), one row per row: the ids without special tokens, an empty list for null and empty texts.

    Texts of any length are read whole, byte by byte; a word of a million letters costs a million
    steps. Repeated rows give repeated rows, an empty table an empty result. Only the two named
    columns are read.
    """
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    docs = spread(documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shared.value)
        for batch in batches:
            # a slice at a time, so that one batch of long texts doesn't pile up its ids
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids = [machine.text(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["key", "ids"])

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: bytes, *, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids); null ids give null, no ids an empty text, broken characters U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = transducer(shared.value).vocabulary
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                d = StreamDecoder(voc)
                out.append(None if ids is None else d.feed(ids) + d.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "text"])

    rows = encoded.select(F.col(key).alias("key"), "ids")
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)
