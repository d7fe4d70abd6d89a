"""Token ids as binary shards with Elias-Fano document boundaries.

A shard row holds the ids of consecutive documents as one array (two bytes an
id where the vocabulary allows) and the documents' end positions as an
Elias-Fano code: the low bits of each position are packed, the high bits are
set in unary, and a sparse sample of positions of set bits makes ``select``
quick. The ascending doc_ids are coded likewise, from the shard's first on.
Nothing stores a 64-bit number for each document. Spark's Parquet
writer commits the rows, so a task that is run again leaves no second copy.

Defined cases: a null text is empty and has the end id alone; rows with equal
doc_id stand next to each other, ordered by text; a null doc_id comes first;
a very long text makes its shard as much longer; an empty table gives an empty file; further columns are not read.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, slices, text_bytes

#: A set bit's place is kept for every so many.
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of integers from 0 to ``top``, less than 2^64."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, places: np.ndarray):
        self.n, self.width, self.low, self.high, self.places = n, width, low, high, places

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        v, n = np.asarray(values).astype(np.uint64), len(values)
        width = max(0, (int(top) // max(n, 1)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        set_at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(set_at[-1]) + 1 if n else 0, np.uint8)
        unary[set_at] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little").tobytes(), set_at[::SAMPLE].astype(np.int32))

    def _low(self, i: int) -> int:
        at = i * self.width
        part = int.from_bytes(self.low[at // 8 : (at + self.width + 7) // 8], "little")
        return (part >> at % 8) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """Value ``i``: start at the nearest sampled place and count set bits from there."""
        at, left = int(self.places[i // SAMPLE]), i % SAMPLE
        byte, seen = at // 8, self.high[at // 8] >> (at % 8) << (at % 8)
        while (ones := seen.bit_count()) <= left:
            left -= ones
            byte += 1
            seen = self.high[byte]
        for _ in range(left):
            seen &= seen - 1
        return (byte * 8 + (seen & -seen).bit_length() - 1 - i) << self.width | self._low(i)

    def values(self) -> np.ndarray:
        set_at = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width]
        low = bits.reshape(self.n, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return ((set_at - np.arange(self.n)) << self.width) | low


class WordIds(dict):
    """Ids of a word, as bytes, for tokenizers that never join words over white space.

    Words are kept with A-Z in lower case; the first ``limit`` different ones stay.
    Latin words go straight to the tokenizer's model in lower case, since the rest of its
    normaliser and its splitter change nothing there; all others take the whole way.
    A full stop or comma after a Latin letter is a token of its own.
    """

    _plain = re.compile("[a-zÀ-ÖØ-Þß-öø-ÿŒœ]+")
    #: The same letters before a mark, as UTF-8.
    _marked = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc5[\x92\x93])[.,]\Z").search

    def __init__(self, path: str, width: int, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.limit, self.kind = Tokenizer.from_file(path), limit, f"<u{width}"
        self.model, level = self.tok.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(c)[0][0] for c in "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x17F)))}

    def _ids(self, word: str) -> list[int]:
        if self._plain.fullmatch(word):
            return [t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word.lower())))]
        return self.tok.encode(word, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> bytes:
        if self._marked(word):
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = self._bytes(self._ids(word.decode()))
        if len(self) < self.limit and len(word) < 64:
            self[word] = ids
        return ids

    def _bytes(self, ids: list[int]) -> bytes:
        x = array("H" if self.kind == "<u2" else "I", ids)
        if sys.byteorder == "big":
            x.byteswap()
        return x.tobytes()

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:  # a special token's string counts only as it is written
            return np.array(self.tok.encode(text.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


def word_ids(path: str, width: int) -> WordIds:
    return kept("token_binary", (path, width), lambda: WordIds(path, width))


_CODE = "struct<n:long, width:int, low:binary, high:binary, places:array<int>>"
SHARD = f"part long, seq long, n_docs long, n_tokens long, id_width int, ids binary, ends {_CODE}, n_null long, first_id long, doc_ids {_CODE}"
_CODE_TYPE = pa.struct([("n", pa.int64()), ("width", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("places", pa.list_(pa.int32()))])


def _coded(values: np.ndarray) -> dict:
    x = EliasFano.of(values, int(values[-1]) if len(values) else 0)
    return {"n": x.n, "width": x.width, "low": x.low, "high": x.high, "places": x.places.tolist()}


def _shard(part: int, seq: int, ids: list, data: list[bytes], width: int) -> pa.RecordBatch:
    """Document ends, and doc_ids from the first on, as Elias-Fano codes; rows without a doc_id come first and are counted."""
    ends = np.cumsum([len(x) // width for x in data])
    known = np.array([i for i in ids if i is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    own = known.view(np.uint64) - np.array([first], np.int64).view(np.uint64)
    row = {"part": part, "seq": seq, "n_docs": len(ids), "n_tokens": int(ends[-1]), "id_width": width, "ids": b"".join(data), "ends": _coded(ends), "n_null": len(ids) - len(known), "first_id": first, "doc_ids": _coded(own)}
    kinds = {"id_width": pa.int32(), "ids": pa.binary(), "ends": _CODE_TYPE, "doc_ids": _CODE_TYPE}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()], list(row))


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, vocabulary: int, shard_tokens: int = 1 << 20) -> None:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order.

    Rows are dealt by ranges of doc_id and sorted in each; a shard closes at
    ``shard_tokens`` ids, so a task holds one shard and one Arrow batch.
    """
    width = 2 if vocabulary <= 1 << 16 else 4
    end = np.array([end_id], f"<u{width}").tobytes()

    def encode(batches):
        words, part, seq, held = word_ids(tokenizer_path, width), TaskContext.get().partitionId(), 0, 0
        ids: list = []
        data: list[bytes] = []
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data.append(words.encode(text) + end)
                ids.append(doc)
                held += len(data[-1]) // width
                if held >= shard_tokens:
                    yield _shard(part, seq, ids, data, width)
                    ids, data, held, seq = [], [], 0, seq + 1
        if ids:
            yield _shard(part, seq, ids, data, width)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, SHARD).write.parquet(path)


def shard_offsets(shards: DataFrame) -> DataFrame:
    """(part, seq, before): ids in all earlier shards; summed within each part and over the few parts."""
    own = shards.select("part", "seq", "n_tokens")
    earlier = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = own.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", earlier(Window.orderBy("part")).alias("part_before"))
    return own.join(parts, "part").select("part", "seq", (F.col("part_before") + earlier(Window.partitionBy("part").orderBy("seq"))).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, from the files.

    Boundaries and doc_ids are read through ``select``.
    """
    shards = spark.read.parquet(path)

    def documents(batches):
        for b in slices(batches, 1):
            row = b.to_pylist()[0]
            n = row["n_docs"]
            ends = np.array(list(map(EliasFano(**row["ends"]).select, range(n))))
            starts = np.concatenate([[0], ends[:-1]])
            known = map(EliasFano(**row["doc_ids"]).select, range(n - row["n_null"]))
            doc_ids = [None] * row["n_null"] + [row["first_id"] + x for x in known]
            ids = np.frombuffer(row["ids"], f"<u{row['id_width']}").astype("<u4")
            crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]
            columns = [pa.array(doc_ids, pa.int64()), pa.array([row["part"]] * n, pa.int64()), pa.array([row["seq"]] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(documents, "doc_id long, part long, seq long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_offsets(shards), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
