"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space markers.

The vocabulary is read from a SentencePiece model file. Its pieces keep the file's order; a unigram model needs log scores,
and where the file holds merge ranks instead, a piece of rank r scores ``-log(r + 2.7)`` less a constant (Zipf's law).

A text is normalised by one space before it and the marker U+2581 for each space. Pieces hold markers only at their
beginning (checked on reading), so the best segmentation of a text is that of its stretches that begin at a marker behind
another character. Each distinct stretch is segmented once, many side by side: the trie is walked for all of them from one
place after the other. Long stretches, and those with characters outside the vocabulary, are segmented one by one.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.words import text_slices, word_hashes

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_STRETCHES = 200_000
_SLICE = 500_000  # bytes of text a worker encodes together: its arrays take some 100 times that
_SIDE_BY_SIDE = 48  # bytes; longer stretches are segmented one by one
# Fixed values of the file format: the kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of each piece of a model file, in the order of ids."""

    def fields(buffer):
        at = 0
        while at < len(buffer):
            key, at = varint(buffer, at)
            if key & 7 == 0:
                value, at = varint(buffer, at)
            elif key & 7 == 2:
                size, at = varint(buffer, at)
                value, at = buffer[at : at + size], at + size
            else:
                size = 4 if key & 7 == 5 else 8
                value, at = buffer[at : at + size], at + size
            yield key >> 3, value

    def varint(buffer, at):
        value = shift = 0
        while True:
            byte = buffer[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    pieces = []
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
    return pieces


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Log scores from the order of the pieces, for files whose scores are merge ranks."""
    ranks = sorted((i for i, p in enumerate(pieces) if p[2] == NORMAL), key=lambda i: -pieces[i][1])
    total = math.log(sum(1 / (r + 2.7) for r in range(len(ranks))))
    out = [0.0] * len(pieces)
    for r, i in enumerate(ranks):
        out[i] = -math.log(r + 2.7) - total
    return out


class Vocabulary:
    """Pieces as a double-array trie over bytes: from state s, byte c leads to ``base[s] + c`` if ``check`` there is s."""

    def __init__(self, pieces: list[tuple[str, float, int]], scores: list[float] | None = None):
        self.scores = np.array(scores if scores is not None else [p[1] for p in pieces], np.float64)
        self.kinds = [p[2] for p in pieces]
        self.bytes = [p[0].encode() for p in pieces]
        self.fallback = [-1] * 256
        self.unknown = 0
        words = {}
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.fallback[int(piece[3:5], 16)] = i
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind in (NORMAL, USER):
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {piece!r} holds a marker behind another character")
                words[piece.encode().replace(MARK.encode(), b" ")] = i
        used = [self.scores[i] for i in words.values()]
        self.lowest = float(min(used, default=0.0)) - UNKNOWN_PENALTY
        self._build(words)

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        """A vocabulary from the plain parts that travel to the executors."""
        own = cls.__new__(cls)
        own.__dict__.update(state)
        return own

    def _build(self, words: dict[bytes, int]) -> None:
        tree: dict = {}
        for word, i in words.items():
            node = tree
            for c in word:
                node = node.setdefault(c, {})
            node[-1] = i
        used = bytearray(1 << 20)
        base, check, value = {}, {0: 0}, {}
        used[0] = 1
        queue, low, wide = [(0, tree)], 1, 1
        while queue:
            state, node = queue.pop()
            children = sorted(c for c in node if c >= 0)
            value[state] = node.get(-1, -1)
            if not children:
                continue
            # The first place free for all children; nodes with many begin behind the last such node.
            low = used.find(0, low)
            slot = max(low if len(children) < 4 else wide, children[0] + 1)
            while True:
                slot = used.find(0, slot)
                at = slot - children[0]
                if slot + 512 > len(used):
                    used.extend(bytes(len(used)))
                if not any(used[at + c] for c in children):
                    break
                slot += 1
            if len(children) >= 4:
                wide = slot
            base[state] = at
            for c in children:
                used[at + c] = 1
                check[at + c] = state
            queue += [(at + c, node[c]) for c in children]
        size = max(max(check), max(base.values(), default=0)) + 257
        fill = lambda d, empty: np.array([d.get(i, empty) for i in range(size)], np.int32)
        self.base, self.check, self.value = fill(base, 0), fill(check, -1), fill(value, -1)

    def encode_one(self, text: bytes) -> list[int]:
        """Segment one stretch, spaces standing for markers."""
        base, check, value, scores = self.base, self.check, self.value, self.scores
        n = len(text)
        best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = text[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            state, single = 0, False
            for j in range(at, n):
                nxt = base[state] + text[j]
                if check[nxt] != state:
                    break
                state = nxt
                piece = value[state]
                if piece >= 0:
                    single |= j + 1 - at == size
                    score = best[at] + scores[piece]
                    if score > best[j + 1]:
                        best[j + 1], back[j + 1] = score, (at, int(piece))
            if not single and best[at] + self.lowest > best[at + size]:
                best[at + size], back[at + size] = best[at] + self.lowest, (at, -1)
            at += size
        out, end = [], n
        while end:
            at, piece = back[end]
            if piece >= 0:
                out.append(piece)
            else:
                own = [self.fallback[c] for c in reversed(text[at:end])]
                out += own if min(own) >= 0 else [self.unknown]
            end = at
        return out[::-1]

    def encode_many(self, stretches: list[bytes]) -> list[np.ndarray]:
        """Segment many stretches side by side."""
        out: list = [None] * len(stretches)
        sizes = np.array([len(s) for s in stretches], np.int64)
        for i in np.flatnonzero(sizes > _SIDE_BY_SIDE):
            out[i] = np.array(self.encode_one(stretches[i]), np.int32)
        for low, high in ((0, 8), (8, 16), (16, _SIDE_BY_SIDE)):
            at = np.flatnonzero((sizes > low) & (sizes <= high))
            for p in range(0, len(at), 20_000):
                self._side_by_side(stretches, at[p : p + 20_000], sizes, high, out)
        return out

    def _side_by_side(self, stretches, at, sizes, width, out) -> None:
        m, size = len(at), sizes[at]
        text = np.frombuffer(b"".join(stretches[i].ljust(width, b"\xff") for i in at), np.uint8).reshape(m, width)
        best = np.full((m, width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((m, width + 1), np.int16), np.full((m, width + 1), -2, np.int32)
        for i in range(width):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (i < size))
            state, here = np.zeros(len(rows), np.int32), best[rows, i]
            if not len(rows):
                continue
            lead = text[rows, i]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single = np.zeros(m, bool)
            all_rows, all_here, all_char = rows, here, char
            for j in range(i, width):
                nxt = self.base[state] + text[rows, j]
                on = (self.check[nxt] == state) & (j < size[rows])
                if not on.any():
                    break
                rows, here, char, state = rows[on], here[on], char[on], nxt[on]
                found = self.value[state]
                hit = np.flatnonzero(found >= 0)
                r, f = rows[hit], found[hit]
                single[r[char[hit] == j + 1 - i]] = True
                score = here[hit] + self.scores[f]
                more = score > best[r, j + 1]
                r = r[more]
                best[r, j + 1], start[r, j + 1], piece[r, j + 1] = score[more], i, f[more]
            lost = ~single[all_rows]
            r, to, score = all_rows[lost], i + all_char[lost], all_here[lost] + self.lowest
            more = score > best[r, to]
            best[r[more], to[more]], start[r[more], to[more]], piece[r[more], to[more]] = score[more], i, -1
        # Back from the ends, all rows at once.
        end, rows = size.copy(), np.arange(m)
        taken, bad = [], np.zeros(m, bool)
        while True:
            go = end > 0
            if not go.any():
                break
            p = np.where(go, piece[rows, end], -9)
            bad |= p == -1
            taken.append(p)
            end = np.where(go, start[rows, end], 0)
        taken = np.array(taken[::-1], np.int32).T  # each row ends with its last piece, after some -9
        filled = taken > -9
        flat, counts = taken[filled], filled.sum(axis=1)
        edges = np.concatenate(([0], np.cumsum(counts)))
        for k in range(m):
            out[at[k]] = np.array(self.encode_one(stretches[at[k]]), np.int32) if bad[k] else flat[edges[k] : edges[k + 1]]

    def decode(self, ids) -> str:
        """The text of ids: bytes of fallback pieces are joined before they are read; one leading marker goes."""
        parts = []
        for i in ids:
            kind = self.kinds[i]
            parts.append(bytes([int(self.bytes[i][3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else self.bytes[i])
        text = b"".join(parts).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def load_vocabulary(path: str, scores: str = "zipf") -> Vocabulary:
    """``scores``: "zipf" for files of merge ranks, "file" for unigram files."""
    with open(path, "rb") as f:
        pieces = read_model(f.read())
    return Vocabulary(pieces, zipf_scores(pieces) if scores == "zipf" else None)


def _stretches(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the stretches, and the place of each text's first one. Every text begins with a space."""
    space = data == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first)
    return starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, offsets)


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``docs`` as one struct column ``row``, ``ids`` (array of int) and ``lossless``: do the ids decode to the text?

    Null and empty texts have no ids. A text that itself holds U+2581 decodes with a space in its place, so it is not
    lossless. Every row stays; the columns travel in one struct, so their names never clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.__dict__)  # the vocabulary: its size does not grow with the data
    index = docs.columns.index(text_col)

    def encode(batches):
        vocab = Vocabulary.of(shared.value)
        known: dict[int, bytes] = {}
        table = [b if k in (NORMAL, USER) else bytes([int(b[3:5], 16)]) if k == BYTE else b"" for b, k in zip(vocab.bytes, vocab.kinds)]
        table = [b.replace(MARK.encode(), b" ") for b in table]
        shown, places = np.frombuffer(b"".join(table), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in table])))
        for b in batches:
            given = pa.compute.struct_field(b.column(0), index).cast(pa.string()).fill_null("")
            for first, end, _, _ in text_slices(given, _SLICE):
                marked = pa.compute.replace_substring(given.slice(first, end - first), MARK, " ")
                marked = pa.compute.if_else(pa.compute.equal(marked, ""), "", pa.compute.binary_join_element_wise(" ", marked, ""))
                _, _, data, offsets = next(text_slices(marked, 2**62))
                starts, ends, of_text = _stretches(data, offsets)
                hashes, at, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
                keys = hashes.tolist()
                if len(known) + len(keys) > CACHE_STRETCHES:
                    known.clear()
                new = [i for i, h in enumerate(keys) if h not in known]
                text = data.tobytes()
                for i, ids in zip(new, vocab.encode_many([text[starts[k] : ends[k]] for k in at[new]])):
                    known[keys[i]] = ids.tobytes()
                coded = [known[h] for h in keys]
                sizes = np.array([len(x) // 4 for x in coded], np.int64)
                flat = np.frombuffer(b"".join(coded), np.int32)
                begin = np.concatenate(([0], np.cumsum(sizes)))
                per = sizes[inverse]
                total = np.concatenate(([0], np.cumsum(per)))
                ids = flat[np.repeat(begin[inverse] - total[:-1], per) + np.arange(total[-1])]
                cuts = total[of_text]
                # Decoding: the bytes of all pieces, set against the bytes of the texts.
                lengths = places[ids + 1] - places[ids]
                ends_ = np.concatenate(([0], np.cumsum(lengths)))
                back = shown[np.repeat(places[ids] - ends_[:-1], lengths) + np.arange(ends_[-1])]
                same = ends_[cuts] == offsets
                if same.all() and len(back) == len(data):
                    wrong = np.concatenate(([0], np.cumsum(back != data)))
                    fine = wrong[offsets[1:]] == wrong[offsets[:-1]]
                else:
                    fine = np.array([back[ends_[cuts[i]] : ends_[cuts[i + 1]]].tobytes() == text[offsets[i] : offsets[i + 1]] for i in range(end - first)])
                plain = ~np.asarray(pa.compute.match_substring(given.slice(first, end - first), MARK))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)), pa.array(fine & plain)],
                    ["row", "ids", "lossless"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    return docs.select(F.struct("*").alias("row")).mapInArrow(encode, schema)


def decode_texts(coded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``coded`` as one struct column ``row``, and ``text``. Null ids decode to null, no ids to the empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary.__dict__)
    index = coded.columns.index(ids_col)

    def decode(batches):
        vocab = Vocabulary.of(shared.value)
        for b in batches:
            lists = pa.compute.struct_field(b.column(0), index).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if x is None else vocab.decode([i for i in x if i is not None]) for x in lists], pa.string())], ["row", "text"])

    schema = T.StructType([T.StructField("row", coded.schema), T.StructField("text", T.StringType())])
    return coded.select(F.struct("*").alias("row")).mapInArrow(decode, schema)
