"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is held as two parallel arrays: the symbols between its part
boundaries, and the merge rank of every adjacent pair.  The smallest rank is
found by a scan of the contiguous array, its boundary is deleted, and the two
neighbouring ranks are refreshed, until no pair has a rank.  Words beyond
``LONG_WORD`` bytes (for which the scans would be quadratic) take the same
merges in the same order from a heap of ranks.

The vocabulary file is a parameter: the driver reads it and Spark broadcasts
it (its size is fixed by the vocabulary, not by the data).  Texts never leave
their partition, so the work is one map over the documents; each Python worker
remembers the words that it has encoded, in a table of bounded size.

Defined cases: a null text is an empty text and gives no token; ids may be
null or repeat (rows are independent); an empty table gives an empty table;
further columns are carried along by name, and columns that the result names
itself are replaced.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm.common import binary_list, bound_batches, lean

#: The public byte-level pattern that splits a text before the merges.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
LONG_WORD = 256
MEMO_WORDS = 400_000
_NONE = 1 << 30


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable in Latin-1, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordMemo(dict):
    """Packed tokens by word; emptied when it has ``MEMO_WORDS`` words, long words are not kept."""

    def __init__(self, model: BpeModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        parts = self.model.encode_word(word.encode())
        packed = struct.pack(f"<{len(parts)}I", *parts)
        if len(word) <= LONG_WORD:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = packed
        return packed


class BpeModel:
    """Merges and vocabulary of a byte-level BPE file, ready for encoding."""

    def __init__(self, raw: str):
        data = json.loads(raw)
        kind = (data.get("pre_tokenizer") or {}).get("type")
        if data["model"].get("type", "BPE") != "BPE" or kind != "ByteLevel" or data.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        if data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("add_prefix_space is not supported")
        vocab = data["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_letters())}
        self.byte_id = [vocab[c] for c in byte_letters()]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.pair_rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pair_rank[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.token_length = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self._find = regex.compile(SPLIT_PATTERN).findall
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._memo = WordMemo(self)

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of one word (a piece between two splits)."""
        if len(word) > LONG_WORD:
            return self._encode_long(word)
        parts = [self.byte_id[b] for b in word]
        rank_of = self.pair_rank.get
        ranks = [rank_of(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = self.made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 32 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 32 | parts[i + 1], _NONE)
        return parts

    def _encode_long(self, word: bytes) -> list[int]:
        n = len(word)
        parts: list[int] = [self.byte_id[b] for b in word]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.pair_rank.get
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i] << 32 | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i] if parts[i] >= 0 else n
            if j >= n or rank_of(parts[i] << 32 | parts[j], _NONE) != rank:
                continue
            parts[i], parts[j] = self.made[rank], -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := rank_of(parts[a] << 32 | parts[b], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> bytes:
        """The tokens of a text, packed as little-endian unsigned 32-bit integers; strings of special tokens are those tokens."""
        pieces = self._cut(text) if self._cut else [text]
        if len(pieces) == 1:
            return b"".join(map(self._memo.__getitem__, self._find(text)))
        return b"".join(
            struct.pack("<I", self.special[piece]) if k % 2 else b"".join(map(self._memo.__getitem__, self._find(piece)))
            for k, piece in enumerate(pieces)
        )

    def decode(self, ids: list[int]) -> str:
        """The text of tokens; bytes that are no UTF-8 become replacement characters."""
        known, spell = len(self.token_bytes), self.token_bytes
        return b"".join([spell[i] for i in ids if i < known]).decode("utf-8", "replace")


_MODELS: dict[int, BpeModel] = {}


def model_of(broadcast) -> BpeModel:
    """The model of a broadcast vocabulary file, built once in a Python worker."""
    key = hash(broadcast.value)
    if key not in _MODELS:
        _MODELS[key] = BpeModel(broadcast.value)
    return _MODELS[key]


def broadcast_model(spark, path: str):
    """Read the vocabulary file on the driver and ship it; a file's size doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def with_columns(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    """The schema of *df* with *added* fields in the place of its own of the same name (in any case)."""
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in names] + added)


def encode(df: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """*df* without its text, with ``n_tokens`` and ``token_ids`` (little-endian unsigned 32-bit integers)."""
    bound_batches(df.sparkSession)
    shipped = broadcast_model(df.sparkSession, path)
    added = [T.StructField("n_tokens", T.LongType(), False), T.StructField("token_ids", T.BinaryType(), False)]
    fields = [f for f in with_columns(df, added).fields if f.name != text_column]
    schema = T.StructType(fields)
    kept = [f.name for f in fields[:-2]]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_column}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shipped)
        for batch in batches:
            counts, packed = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                ids = model.encode(text) if text else b""
                counts.append(len(ids) // 4)
                packed.append(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=[*kept, "n_tokens", "token_ids"])

    return source.mapInArrow(lean(run), schema)


def decode(df: DataFrame, path: str, ids_column: str = "token_ids") -> DataFrame:
    """*df* with ``decoded``, the text of the packed tokens in *ids_column* (null: empty)."""
    shipped = broadcast_model(df.sparkSession, path)
    schema = with_columns(df, [T.StructField("decoded", T.StringType(), False)])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shipped)
        for batch in batches:
            packed = binary_list(batch.column(batch.schema.get_field_index(ids_column)))
            texts = [model.decode(np.frombuffer(x, dtype="<u4").tolist()) if x else "" for x in packed]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(texts, pa.string())], names=[*kept, "decoded"])

    return df.mapInArrow(lean(run), schema)


def round_trip(df: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """As :func:`decode` of :func:`encode`, in one pass: *df* without its text, with ``n_tokens``, ``token_ids`` and ``decoded``."""
    bound_batches(df.sparkSession)
    shipped = broadcast_model(df.sparkSession, path)
    added = [T.StructField("n_tokens", T.LongType(), False), T.StructField("token_ids", T.BinaryType(), False), T.StructField("decoded", T.StringType(), False)]
    fields = [f for f in with_columns(df, added).fields if f.name != text_column]
    kept = [f.name for f in fields[:-3]]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_column}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shipped)
        for batch in batches:
            packed = [model.encode(text) if text else b"" for text in batch.column(batch.num_columns - 1).to_pylist()]
            texts = [model.decode(np.frombuffer(ids, dtype="<u4").tolist()) for ids in packed]
            columns = [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*kept, "n_tokens", "token_ids", "decoded"])

    return source.mapInArrow(lean(run), T.StructType(fields))


def round_trip_digests(df: DataFrame, path: str) -> DataFrame:
    """Per document its token count and the digests of its tokens and of their decoded text."""
    coded = round_trip(df.select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
