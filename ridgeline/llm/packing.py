"""Packing: documents in order, cut into sequences by dynamic programming.

Each task takes the documents of its part of the table as one stream of token
ids and packs it in stretches of about a million tokens. A sequence is a window
of the stream, so documents keep the order in which they are read. Windows end
at document ends, at sentence ends, or, in a sentence longer than a quarter of a
window, at every 64th of its tokens. A window costs its padding, a little for being one, and a
penalty if it cuts a document, which is larger inside a sentence. The cheapest
windows come from one pass over the places: padding is linear in the window's
length, so the best start of a padded window is the least of a sliding range, which a
monotone queue keeps; windows of a power of two of tokens need no padding and
are tried one by one. No row is shuffled.

Defined cases: a null or empty text is the end id alone; rows without a doc_id,
and rows that share one, are documents of their own; a string of a special token
is that token, as in the tokenizer's own reading; a very long text is encoded in
blocks, and its ids are a stretch of their own; an empty table gives no
sequences; further columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices

WINDOW = 1024
#: What a cut at a sentence end or inside a sentence costs, and a window itself, in padding tokens.
AT_SENTENCE, INSIDE, EACH = 4, 24, 1
#: Tokens of a stretch, characters of a block.
STRETCH, TEXT = 1 << 20, 1 << 20
PLACE = 64


class PieceIds(dict):
    """Ids, as bytes, of the parts that the tokenizer splits a text into.

    A line of Latin words, numbers, full stops and commas is cut before spaces and
    marks, which is where the tokenizer splits it; other lines are split by its
    pattern, texts that are odd otherwise by itself. The first ``limit`` different
    short parts are kept. A line break between visible characters is a part."""

    _letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x180)]))
    _other = re.compile(f"[^ .,\n0-9{_letters}]")
    _word = re.compile(f" ?(?:[{_letters}]+|[0-9]+)")

    def __init__(self, path: str, pattern: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.limit, self.split = Tokenizer.from_file(path), limit, regex.compile(pattern).findall
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, level = self.tok.model, ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x180))})
        self.parts: dict[str, bytes] = {}
        self |= {c: self._whole(c) for c in ".,\n"}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        if not self._word.fullmatch(word):
            raise LookupError
        ids = self._ids(word)
        if len(self) < self.limit and len(word) < 32:
            self[word] = ids
        return ids

    def _ids(self, part: str) -> bytes:
        """What the tokenizer does with a part that it has split off."""
        return np.array([t.id for t in self.model.tokenize(part.translate(self.table))], self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.get(part) or self.parts.get(part)
        if ids is None:
            ids = self._ids(part)
            if len(self.parts) < self.limit // 4 and len(part) < 32:
                self.parts[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text; of a very long one block by block, cut before spaces that follow a visible character."""
        if "<|" in text or "\0" in text:
            return self._whole(text)
        if len(text) <= TEXT:
            return self._block(text)
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > TEXT:
                border = text.find(" ", at + TEXT)
                while border > 0 and text[border - 1].isspace():
                    border = text.find(" ", border + 1)
                end = border if border > 0 else end
            out.append(self._block(text[at:end]))
            at = end
        return b"".join(out)

    def _block(self, text: str) -> bytes:
        if not self._other.search(text):
            try:
                return self._plain(text)
            except LookupError:  # such as two spaces, or a letter after a full stop
                pass
        lines = text.split("\n")
        if any(x[:1].isspace() or x[-1:].isspace() or not x for x in lines[1:-1]) or lines[0][-1:].isspace() or len(lines) > 1 and (not lines[0] or lines[-1][:1].isspace() or not lines[-1]):
            return self._whole(text)
        return self["\n"].join(map(self._line, lines))

    def _plain(self, text: str) -> bytes:
        if ".." in text or ",," in text or ".," in text or ",." in text:
            raise LookupError
        parts = text.replace(" ", "\0 ").replace(".", "\0.").replace(",", "\0,").replace("\n", "\0\n\0").split("\0")
        if not parts[0] and len(parts) > 1:
            del parts[0]
        if not parts[-1]:  # a line break at the end
            del parts[-1]
        return b"".join(map(self.__getitem__, parts))

    def _line(self, line: str) -> bytes:
        if not self._other.search(line):
            try:
                return self._plain(line)
            except LookupError:
                pass
        return b"".join(map(self._part, self.split(line))) if line and max(line) < "\u0180" else self._whole(line)


def piece_ids(path: str, pattern: str) -> PieceIds:
    return kept("packing", path, lambda: PieceIds(path, pattern))


def sentence_marks(path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: whether the token ends like a sentence, and whether it starts with white space."""

    def make():
        tok = piece_ids(path, pattern).tok
        text = [tok.decode([k]) for k in range(tok.get_vocab_size())]
        return np.array([t.rstrip()[-1:] in tuple(".!?…。") and bool(t.strip()) or t.endswith("\n") for t in text]), np.array([t[:1].isspace() for t in text])

    return kept("packing", (path, "marks"), make)


def cut_places(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, gaps: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places where a window may end, and the penalty of each."""
    cost = np.full(len(ids) + 1, -1, np.int32)
    cost[1:-1][stops[ids[:-1]] & gaps[ids[1:]]] = AT_SENTENCE
    cost[ends] = 0
    place = np.append(0, np.flatnonzero(cost >= 0))
    wide = np.flatnonzero(np.diff(place) > window // 4)
    for a, b in zip(place[wide].tolist(), place[wide + 1].tolist()):
        cost[a + min(PLACE, window) : b : min(PLACE, window)] = INSIDE
    place = np.flatnonzero(cost >= 0)
    return np.append(0, place[place > 0]), np.append(0, cost[place[place > 0]])


def best_windows(place: np.ndarray, cost: np.ndarray, window: int) -> np.ndarray:
    """The ends of the windows with the least sum of padding and penalties.

    ``place`` starts with 0, ascends, and has no step above ``window``."""
    n, total = len(place), int(place[-1])
    at = np.full(total + 1, -1, np.int32)
    at[place] = np.arange(n)
    exact: list = [()] * n  # starts of windows of a power of two that end at a place
    size = 1
    while size <= window:
        own = np.flatnonzero(place >= size)
        start = at[place[own] - size]
        for j, i in zip(own[start >= 0].tolist(), start[start >= 0].tolist()):
            exact[j] = (*exact[j], i)
        size *= 2
    where, price = place.tolist(), (cost + EACH).tolist()
    least, before = [0] * n, [0] * n  # cost of the best windows up to a place, and where the last one starts
    rank = [0] * n  # that cost and the place: what a padded window adds up from
    queue, head = [0], 0  # the monotone queue: places ahead of which no later one is cheaper
    for j in range(1, n):
        end = where[j]
        while where[queue[head]] < end - window:
            head += 1
        start = queue[head]
        best = rank[start] + window - end
        for i in exact[j]:
            if least[i] <= best and (least[i] < best or i < start):
                best, start = least[i], i
        least[j] = best = best + price[j]
        before[j] = start
        rank[j] = best = best + end
        while len(queue) > head and rank[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(where[j])
        j = before[j]
    return np.array(out[::-1], np.int64)


def padded(length: int, window: int) -> int:
    return length if length & (length - 1) == 0 else window


_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
SEQUENCES = "sequence_id long, length int, padded int, id_width int, ids binary, pieces array<struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>>"


def sequences(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0, window: int = WINDOW, stretch_tokens: int = STRETCH) -> DataFrame:
    """A row for each sequence: its ids without padding, what it is padded to, and the pieces of documents in it.
    ``pattern`` is the tokenizer's split.

    ``sequence_id`` ascends in the order of the documents of a task; its high bits are the task's."""

    def stretch(names: list, data: list[bytes], first: int) -> pa.RecordBatch:
        own = piece_ids(tokenizer_path, pattern)
        ids = np.frombuffer(b"".join(data), own.kind)
        ends = np.cumsum([len(x) // own.kind.itemsize for x in data])
        cuts = best_windows(*cut_places(ids, ends, *sentence_marks(tokenizer_path, pattern), window), window)
        opens = np.append(0, cuts[:-1])
        borders = np.union1d(ends, cuts)
        starts = np.append(0, borders[:-1])
        doc, seq = np.searchsorted(ends, starts, side="right"), np.searchsorted(cuts, starts, side="right")
        lengths = np.diff(np.append(0, ends))
        columns = [pa.array([names[k] for k in doc.tolist()], pa.int64()), *map(pa.array, (starts - (ends - lengths)[doc], borders - starts, lengths[doc], starts - opens[seq]))]
        pieces = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(seq, np.arange(len(cuts))), len(seq)).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(_PIECE)))
        sizes, raw, width = cuts - opens, ids.tobytes(), own.kind.itemsize
        parts = [raw[a * width : b * width] for a, b in zip(opens.tolist(), cuts.tolist())]
        numbers = pa.array(first + np.arange(len(cuts)), pa.int64())
        return pa.RecordBatch.from_arrays([numbers, pa.array(sizes, pa.int32()), pa.array([padded(x, window) for x in sizes.tolist()], pa.int32()), pa.array(np.full(len(cuts), width), pa.int32()), pa.array(parts, pa.binary()), pieces], ["sequence_id", "length", "padded", "id_width", "ids", "pieces"])

    def packed(batches):
        own = piece_ids(tokenizer_path, pattern)
        end, first = np.array([end_id], own.kind).tobytes(), TaskContext.get().partitionId() << 36
        names, data, size = [], [], 0
        for b in slices(batches):
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                names.append(name)
                data.append(own.encode(text.as_py() or "") + end)
                size += len(data[-1]) // own.kind.itemsize
                if size >= stretch_tokens:
                    out = stretch(names, data, first)
                    first += out.num_rows
                    yield out
                    names, data, size = [], [], 0
        if names:
            yield stretch(names, data, first)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, SEQUENCES)


def piece_report(rows: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece in ``sequences``."""

    def digests(batches):
        for b in slices(batches):
            pieces = b.column("pieces")
            flat, counts = pieces.flatten(), pieces.value_lengths().to_numpy()
            lengths, offsets = (flat.field(c).to_numpy() for c in ("length", "offset"))
            at, sums = 0, []
            for ids, width, n in zip(b.column("ids").to_pylist(), b.column("id_width").to_pylist(), counts.tolist()):
                raw = memoryview(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())
                for length, offset in zip(lengths[at : at + n].tolist(), offsets[at : at + n].tolist()):
                    sums.append(zlib.crc32(raw[4 * offset : 4 * (offset + length)]))
                at += n
            sequence = pa.array(np.repeat(b.column("sequence_id").to_numpy(), counts), pa.int64())
            yield pa.RecordBatch.from_arrays([flat.field("doc_id"), flat.field("start"), flat.field("length"), pa.array(sums, pa.int64()), flat.field("doc_tokens"), sequence, flat.field("offset")], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.select("sequence_id", "id_width", "ids", "pieces").mapInArrow(digests, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
