"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over the model's pieces reads a text once; its output links name
all pieces that end at each position. How a path is chosen among them follows
the training of the model file:

- merging pairs: at each position the piece is settled that can follow the
  encoding of what stands before it; whether two pieces can be neighbours is
  found by replaying merges over the two alone: of all neighbours that together are
  a piece, those with the highest score (of equal ones the leftmost) become
  one, until there are none (`MergeModel`). The ids are the library's.
- else each piece relaxes the best score of the position where it ends
  (Viterbi), and the path with the highest total is read backwards
  (`PieceModel`). A character without a piece costs ten less than the lowest
  score.

A character without a piece becomes byte pieces.

No piece holds a space mark behind another character (checked on loading), and
no path crosses a border between two characters that stand together in no
piece, by merges or otherwise. So words, and within them the stretches between such borders, are
segmented on their own, once, and kept. For a merge-trained file the words of some
hundred texts that aren't kept yet are read side by side: each step moves
the automaton of all of them by one character (`Lanes`).

Decoding is exact for either.

Defined cases: a null or empty text has no pieces and decodes to the empty
text; a text's own U+2581 becomes byte pieces, so that it survives decoding; of
equal scores the leftmost merge, or the path with the longer last piece, is
taken; a very long text is encoded whole, an unbroken run of letters included;
columns named like an output are replaced, all others pass through.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, list_array, slices, without

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: The library's penalty of an unknown character below the lowest score.
UNKNOWN_PENALTY = 10.0


def piece_bytes(p) -> bytes:
    if p.type == BYTE:
        return bytes([int(p.piece[1:-1], 16)])
    return p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER) else b""


class _Words(dict):
    """Ids, as bytes, of what stands between two single spaces, with the first of them.

    The first ``limit`` different words are kept. A line feed is a chunk of its
    own, and what follows it has no space mark.
    """

    def __init__(self, model: PieceModel, limit: int):
        self.model, self.limit, self.starts = model, limit, {}

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:
            first, *lines = word.split("\n")
            return self[first] + b"".join(self._line(x) for x in lines)
        ids = self.model.chunk_ids(SPACE + word)
        if len(self) < self.limit and len(word) < 64:
            self[word] = ids
        return ids

    def _line(self, word: str) -> bytes:
        """A line feed and the first word after it."""
        ids = self.starts.get(word)
        if ids is None:
            ids = self.model.chunk_ids("\n") + self.model.chunk_ids(word)
            if len(self.starts) < self.limit // 8 and len(word) < 64:
                self.starts[word] = ids
        return ids


class Lanes:
    """The automaton of a merge-trained file as arrays, for many words side by side.

    Moves are a table over ``most`` characters, the space mark, those of Latin-1 and then those that most
    pieces hold; words with other characters, and those beyond ``longest`` characters, are left to the caller.
    ``apart`` tells whether piece ``b`` can follow ``a`` (-1: nothing); its answers are kept
    in a hash table of ``1 << bits`` slots until that is half full.
    """

    def __init__(self, pieces: dict[str, int], apart: Callable[[int, int], bool], most: int = 250, longest: int = 40, bits: int = 20, lot: int = 1 << 14):
        self.apart, self.longest, self.bits, self.lot = apart, longest, bits, lot
        often = Counter(c for p in pieces for c in p)
        letters = sorted((c for c in often if c < "\uffff"), key=lambda c: (c != SPACE and not (c <= "\xff" and c.isprintable()), -often[c], c))[:most]
        self.letter_of = np.full(1 << 16, len(letters), np.uint8)
        self.letter_of[[ord(c) for c in letters]] = np.arange(len(letters))
        self.none, known = len(letters), set(letters)
        state = {"": 0}
        for p in pieces:
            if known.issuperset(p):
                for k in range(1, len(p) + 1):
                    state.setdefault(p[:k], len(state))
        n = len(state)
        self.moves = np.zeros((n, len(letters)), np.uint16 if n <= 1 << 16 else np.int32)
        self.piece, self.size, self.link, fail = (np.zeros(n, np.int64) for _ in range(4))
        levels: dict[int, list[str]] = {}
        for p in state:
            self.piece[state[p]], self.size[state[p]] = pieces.get(p, -1), len(p)
            levels.setdefault(len(p), []).append(p)
        for size in range(1, len(levels)):
            own, parent, letter = (np.array([f(p) for p in levels[size]]) for f in (state.get, lambda p: state[p[:-1]], lambda p: self.letter_of[ord(p[-1])]))
            fail[own] = self.moves[fail[parent], letter] if size > 1 else 0
            self.moves[parent, letter] = own
            self.moves[own] = self.moves[fail[own]]
            self.link[own] = np.where(self.piece[fail[own]] >= 0, fail[own], self.link[fail[own]])
        #: The longest piece that ends here: its state (0: none).
        self.first = np.where(self.piece >= 0, np.arange(n), self.link)
        self.slots, self.held = np.full(1 << bits, -1, np.int64), 0

    def follows(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``apart`` of each pair."""
        key, mask = (before + 1) << 31 | piece, len(self.slots) - 1
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slots[slot]
        out = found & 1 == 1
        at = np.flatnonzero(found >> 1 != key)
        new = [at[:0]]
        while len(at):  # another pair is in the slot: look at the next ones
            found = self.slots[slot[at]]
            new.append(at[found < 0])
            same = found >> 1 == key[at]
            out[at[same]] = found[same] & 1 == 1
            at = at[(found >= 0) & ~same]
            slot[at] = (slot[at] + 1) & mask
        new = np.concatenate(new)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            answers = np.array([self.apart((k >> 31) - 1, k & 0x7FFFFFFF) for k in keys.tolist()])
            out[new] = answers[back]
            for k, answer, s in zip(keys.tolist(), answers.tolist(), slot[new[np.unique(back, return_index=True)[1]]].tolist()):
                if self.held > mask // 2:
                    break
                while self.slots[s] >= 0:
                    s = (s + 1) & mask
                self.slots[s] = k << 1 | answer
                self.held += 1
        return out

    def __call__(self, words: list[str]) -> list[bytes | None]:
        """Ids, as bytes, of each word; None where it can't be read here."""
        out: list[bytes | None] = [None] * len(words)
        own = [k for k, w in enumerate(words) if 0 < len(w) <= self.longest]
        for at in range(0, len(own), self.lot):
            lot = own[at : at + self.lot]
            for k, ids in self._read([words[k] for k in lot]):
                out[lot[k]] = ids
        return out

    def _read(self, words: list[str]):
        """(place in ``words``, ids) of those that could be read."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = self.letter_of[np.minimum(np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), 0xFFFF)]
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        order = order[~np.logical_or.reduceat(letters == self.none, starts)[order]]
        sizes, starts, n = sizes[order], starts[order], len(order)
        if not n:
            return []
        # for each place in a word the piece that ends there (-2: none yet) and its first place, of all words
        piece_of, start_of = np.full((int(sizes[0]) + 1) * n, -2, np.int64), np.zeros((int(sizes[0]) + 1) * n, np.int64)
        piece_of[:n] = -1
        state = np.zeros(n, np.int64)
        for k in range(int(sizes[0])):
            active = int(np.searchsorted(-sizes, -k))  # words of more than k characters
            state = self.moves[state[:active], letters[starts[:active] + k]].astype(np.int64)
            at = self.first[state]
            lane = np.flatnonzero(at)
            at = at[lane]
            while len(lane):
                start, piece = k + 1 - self.size[at], self.piece[at]
                before = piece_of[start * n + lane]
                settled = before >= -1
                settled[settled] = self.follows(before[settled], piece[settled])
                done = (k + 1) * n + lane[settled]
                piece_of[done], start_of[done] = piece[settled], start[settled]
                lane, at = lane[~settled], self.link[at[~settled]]
                lane, at = lane[at > 0], at[at > 0]
        lane = np.flatnonzero(piece_of[sizes * n + np.arange(n)] >= 0)  # others hold a piece that merges don't lead to
        end, ids, count = sizes[lane], np.zeros((len(lane), int(sizes[0])), np.int32), np.zeros(len(lane), np.int64)
        back = np.arange(len(lane))
        while len(back):
            place = end[back] * n + lane[back]
            count[back] += 1
            ids[back, -count[back]] = piece_of[place]
            end[back] = start_of[place]
            back = back[end[back] > 0]
        data, ends = ids.tobytes(), (np.arange(len(lane)) + 1) * 4 * ids.shape[1]
        return [(k, data[a:z]) for k, a, z in zip(order[lane].tolist(), (ends - 4 * count).tolist(), ends.tolist())]


class PieceModel:
    def __init__(self, path: str, limit: int = 120_000):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models that keep the text as it is and add a leading space are supported")
        self.byte_ids = [0] * 256
        self.single: set[str] = set()
        self.automaton = ahocorasick.Automaton()
        scores = []
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
            elif p.type in (NORMAL, USER):
                if re.search(f"[^{SPACE}]{SPACE}", p.piece):
                    raise ValueError(f"piece {p.piece!r} has a space mark inside")
                self.automaton.add_word(p.piece, (len(p.piece), p.score, i))
                scores.append(p.score)
                if len(p.piece) == 1:
                    self.single.add(p.piece)
        self.automaton.make_automaton()
        #: Neighbours in some piece: no path crosses any other border of two characters.
        self.crossed = {p[k : k + 2] for p in self.automaton for k in range(len(p) - 1)}
        self.segments: dict[str, bytes] = {}
        #: Ids of chunks that were read ahead, for the texts at hand.
        self.ahead: dict[str, bytes] = {}
        self.limit = limit
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.newline_alone = not any("\n" in p.piece for p in proto.pieces if p.type in (NORMAL, USER))
        #: Words with the space marks before them; a line feed without a piece stands alone.
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.newline_alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.words = _Words(self, limit)

    def viterbi(self, text: str) -> list[int]:
        """Piece ids of the path with the highest total score; of equal ones that whose last piece is longest."""
        n = len(text)
        best, size_of, piece_of = [0.0] + [-np.inf] * n, [1] * (n + 1), [-1] * (n + 1)
        # characters without a piece, in order; their edges are taken once all before them is final
        strange = [] if self.single.issuperset(text) else [k for k, c in enumerate(text) if c not in self.single]
        waiting = iter(strange)
        at = next(waiting, n)
        for last, (size, score, piece) in self.automaton.iter(text):
            while at < last:
                if best[at] + self.unknown > best[at + 1]:
                    best[at + 1], size_of[at + 1], piece_of[at + 1] = best[at] + self.unknown, 1, -1
                at = next(waiting, n)
            total = best[last + 1 - size] + score
            if total > best[last + 1]:
                best[last + 1], size_of[last + 1], piece_of[last + 1] = total, size, piece
        while at < n:
            if best[at] + self.unknown > best[at + 1]:
                best[at + 1], size_of[at + 1], piece_of[at + 1] = best[at] + self.unknown, 1, -1
            at = next(waiting, n)
        ids: list[int] = []
        while n:
            piece = piece_of[n]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode()))
            n -= size_of[n]
        return ids[::-1]

    path = viterbi

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids, as bytes, of a chunk: the paths between its borders that no piece crosses."""
        if chunk in self.ahead:
            return self.ahead[chunk]
        out, start, crossed = [], 0, self.crossed
        if len(chunk) < 64 and crossed.issuperset(map(add, chunk, chunk[1:])):
            return self.segments.get(chunk) or self._segment_ids(chunk)
        for end in range(1, len(chunk) + 1):
            if end == len(chunk) or chunk[end - 1 : end + 1] not in crossed:
                part = chunk[start:end]
                out.append(self.segments.get(part) or self._segment_ids(part))
                start = end
        return b"".join(out)

    def _segment_ids(self, part: str) -> bytes:
        ids = array("i", self.path(part)).tobytes()
        if len(self.segments) < self.limit and len(part) < 64:
            self.segments[part] = ids
        return ids

    def plain(self, text: str) -> bool:
        """Whether no two space marks meet, so that words can be read one by one."""
        return bool(text) and SPACE not in text and "  " not in text and text[0] != " " and self.newline_alone

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encode(t) for t in texts]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.plain(text):
            return np.frombuffer(b"".join(map(self.words.__getitem__, text.split(" "))), np.int32)
        parts = text.split(SPACE)
        ids: list[bytes] = []
        for k, part in enumerate(parts):
            if k:
                ids.append(array("i", [self.byte_ids[b] for b in SPACE.encode()]).tobytes())
            ids.extend(map(self.chunk_ids, self.chunks((SPACE if not k else "") + part.replace(" ", SPACE))))
        return np.frombuffer(b"".join(ids), np.int32)


class MergeModel(PieceModel):
    """Encodes as the library does for a model trained by merging pairs.

    Merging is local: pieces are a text's encoding if each two neighbours, taken
    alone, are encoded as those two. So of the pieces that end at a position
    just one can follow the encoding of what stands before it, and the position
    is settled as soon as an output link names that piece. Whether two pieces
    may be neighbours is found by replaying their merges, once for each pair.
    """

    def __init__(self, path: str, limit: int = 120_000):
        super().__init__(path, limit)
        self.text_of = {v[2]: p for p, v in self.automaton.items()}
        self.pairs: dict[int, bool] = {}
        self.lanes = Lanes({p: v[2] for p, v in self.automaton.items()}, self.apart)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """``encode`` of each text; words that aren't kept are read side by side first."""
        kept, lines = self.words, self.words.starts
        split = [t.split(" ") if self.plain(t) else [] for t in texts]
        new = [w for w in set().union(*split) if w not in kept]
        parts = [w.split("\n") for w in new if "\n" in w]
        words = list({w for w in new if "\n" not in w} | {p[0] for p in parts if p[0] not in kept})
        starts = list({x for p in parts for x in p[1:] if x not in lines})
        read = {w: ids for w, ids in zip(words, self.lanes([SPACE + w for w in words])) if ids is not None}
        self.ahead = {x: ids for x, ids in zip(starts, self.lanes(starts)) if ids is not None}
        stay = max(0, kept.limit - len(kept))
        kept.update(read)
        try:
            return [np.frombuffer(b"".join(map(kept.__getitem__, own)), np.int32) if own else self.encode(t) for t, own in zip(texts, split)]
        finally:
            for k, w in enumerate(read):
                if k >= stay:
                    del kept[w]
            self.ahead = {}

    def path(self, text: str) -> list[int]:
        if not self.single.issuperset(text):
            return self.merged(text)
        n = len(text)
        piece_of, start_of = [-1] * (n + 1), [0] * (n + 1)
        for last, (size, _, piece) in self.automaton.iter(text):
            end, start = last + 1, last + 1 - size
            if piece_of[end] < 0 and (piece_of[start] >= 0 or not start) and self.neighbours(piece_of[start], piece):
                piece_of[end], start_of[end] = piece, start
        if n and piece_of[n] < 0:  # some piece that merges don't lead to
            return self.merged(text)
        ids: list[int] = []
        while n:
            ids.append(piece_of[n])
            n = start_of[n]
        return ids[::-1]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging keeps piece ``b`` apart from ``a`` before it (-1: from nothing) and whole."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            known = self.apart(a, b)
            if len(self.pairs) < 2 * self.limit:
                self.pairs[a << 32 | b] = known
        return known

    def apart(self, a: int, b: int) -> bool:
        return self.merged((self.text_of[a] if a >= 0 else "") + self.text_of[b]) == ([a, b] if a >= 0 else [b])

    def merged(self, text: str) -> list[int]:
        return self.short_path(text) if len(text) <= 64 else self.long_path(text)

    def short_path(self, text: str) -> list[int]:
        """The best neighbours are sought anew for each merge, which is the faster for some dozen characters."""
        n, none = len(text), np.inf
        width = n + 1
        rank, piece_of = {}, {}
        for last, (size, score, piece) in self.automaton.iter(text):
            k = (last + 1 - size) * width + last + 1
            rank[k], piece_of[k] = -score, piece
        # borders of the symbols, and the rank of each symbol with the next one
        at, pairs, get = list(range(width)), [rank.get(k, none) for k in range(2, n * width - width, width + 1)], rank.get
        while pairs:
            least = min(pairs)
            if least == none:
                break
            k = pairs.index(least)
            del at[k + 1], pairs[k]
            if k < len(pairs):
                pairs[k] = get(at[k] * width + at[k + 2], none)
            if k:
                pairs[k - 1] = get(at[k - 1] * width + at[k + 1], none)
        ids: list[int] = []
        for a, z in zip(at, at[1:]):
            piece = piece_of.get(a * width + z)
            if piece is None:
                ids.extend(self.byte_ids[b] for b in text[a].encode())
            else:
                ids.append(piece)
        return ids

    def long_path(self, text: str) -> list[int]:
        """Neighbours wait in a heap, so the time is n log n."""
        n = len(text)
        found = {(last + 1 - size, last + 1): (-score, piece) for last, (size, score, piece) in self.automaton.iter(text)}
        # where the symbol that starts here ends (-1: it is part of another one), and where the one before it starts
        end, before = list(range(1, n + 1)), list(range(-1, n))
        waiting = [(found[k, k + 2][0], k, k + 1, k + 2) for k in range(n - 1) if (k, k + 2) in found]
        heapify(waiting)
        while waiting:
            _, a, m, z = heappop(waiting)
            if end[a] != m or end[m] != z:
                continue
            end[a], end[m], before[z] = z, -1, a
            p = before[a]
            if p >= 0 and (p, z) in found:
                heappush(waiting, (found[p, z][0], p, a, z))
            if z < n and (a, end[z]) in found:
                heappush(waiting, (found[a, end[z]][0], a, z, end[z]))
        ids: list[int] = []
        k = 0
        while k < n:
            if (k, end[k]) in found:
                ids.append(found[k, end[k]][1])
            else:
                ids.extend(self.byte_ids[b] for b in text[k].encode())
            k = end[k]
        return ids


class PieceTexts:
    """What decoding needs of a model: the bytes of each piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.bytes_of = [piece_bytes(p) for p in proto.pieces]

    def decode(self, ids: list[int]) -> str:
        """The text whose encoding ``ids`` is: bytes of the pieces without the leading space."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")


def piece_model(path: str, kind: type = PieceModel):
    return kept("pieces", (path, kind), lambda: kind(path))


def encoder(path: str) -> PieceModel:
    """The model that encodes as the file was trained."""

    def merging() -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        return proto.trainer_spec.model_type == pb.TrainerSpec.BPE

    return piece_model(path, MergeModel if kept("pieces", (path, "merging"), merging) else PieceModel)


def _appended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``ids`` (array of int) of each text's pieces."""
    docs = without(docs, ["ids"])
    at = docs.columns.index(text_col)

    def encode(batches):
        model = encoder(model_path)
        for b in slices(batches, 500):
            ids = model.encode_all([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, list_array(ids, pa.int32())], [*b.schema.names, "ids"])

    return docs.mapInArrow(encode, _appended(docs, "ids", T.ArrayType(T.IntegerType())))


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with a column ``decoded``, the text of its ``ids`` (null: empty)."""
    encoded = without(encoded, ["decoded"])
    at = encoded.columns.index("ids")

    def decode(batches):
        model = piece_model(model_path, PieceTexts)
        for b in slices(batches, 500):
            column = b.column(at)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum([n or 0 for n in column.value_lengths().to_pylist()]).tolist()
            text = [model.decode(flat[a:z]) for a, z in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(decode, _appended(encoded, "decoded", T.StringType()))


def piece_report(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as decimal numbers joined by
    blanks) and round_trip: whether decoding gives back the text."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = decode_pieces(encode_pieces(text, model_path), model_path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.crc32(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("ids_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
