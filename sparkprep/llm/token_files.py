"""Token ids in fixed-width bit packing: written in order of the document ids, read back by blocks.

A shard holds whole documents, at most about ``SHARD_IDS`` ids (or one longer document), little-endian throughout:

    magic ``TOKBITS1`` | bits u32 | ids in a block u32 | number of documents u64 | number of ids u64 | first i64
    document ids i64 x documents | null flags u8 x documents | lengths in ids u64 x documents
    block offsets u64 x (blocks + 1), from the start of the payload | payload

``first`` is the number of ids before the shard in its part. Each id takes ``bits`` bits, the fewest that hold the largest
id of the vocabulary, lowest bit first; each block begins at a whole byte, so any block is unpacked alone by numpy. Shards
are written by Spark, as rows of a Parquet dataset (part, shard, sizes, payload), so that a lost task leaves no half file
and any store that Spark can write to will do.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm.words import ragged, text_slices, word_hashes, word_places

BLOCK_IDS = 4096
SHARD_IDS = 1_000_000
CACHE_WORDS = 1_000_000
BATCH_WORDS = 20_000
# The splitter whose tokens never hold letters with anything else, and never two digits; apostrophes are its one exception.
_CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _DIGIT, _SIGN, _OTHER, _SPACE = range(5)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MAGIC = b"TOKBITS1"
_HEAD = "<8sIIQQq"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids ``0 .. vocabulary - 1``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_block(data, count: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((count, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = raw.reshape(count, bits // 8)
    else:
        places = np.zeros((count, 32), np.uint8)
        places[:, :bits] = np.unpackbits(raw, count=count * bits, bitorder="little").reshape(count, bits)
        out = np.packbits(places, axis=1, bitorder="little")
    return out.view("<u4").ravel()


def pack_shard(doc_ids: list, lengths: list[int], ids: np.ndarray, first: int, bits: int, block: int = BLOCK_IDS) -> bytes:
    blocks = [pack_block(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    return b"".join([
        struct.pack(_HEAD, _MAGIC, bits, block, len(doc_ids), len(ids), first),
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<u8").tobytes(), offsets.tobytes(), *blocks,
    ])


class Shard:
    """A shard's bytes, read in place: ``doc_ids``, ``lengths``, and ``ids(start, stop)`` that unpacks only the blocks it needs."""

    def __init__(self, data):
        magic, self.bits, self.block, docs, self.n_ids, self.first = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(_HEAD)
        known = np.frombuffer(data, "<i8", docs, at)
        null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(known, null)]
        self.lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        low, high = start // self.block, -(-stop // self.block)
        count = lambda b: min(self.block, self.n_ids - b * self.block)
        parts = [unpack_block(self.payload[self.offsets[b] : self.offsets[b + 1]], count(b), self.bits) for b in range(low, high)]
        return np.concatenate(parts)[start - low * self.block : stop - low * self.block]


def _kinds(described: dict) -> bytes | None:
    """The kind of each byte for ``WordIds.cut``; none if the tokenizer may join or look beyond letters, digits and signs."""
    normal, split, model = (described.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps, splits = normal.get("normalizers", [normal]), split.get("pretokenizers", [split])
    plain = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
    first = {"type": "Split", "pattern": {"Regex": _CLASSES}, "behavior": "Removed", "invert": True}
    second = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    if any(x not in plain for x in steps) or {"type": "Lowercase"} not in steps or model.get("type") != "BPE" or model.get("dropout") or not model.get("end_of_word_suffix"):
        return None
    if len(splits) != 2 or splits[0] != first or splits[1] | second != splits[1] or described.get("post_processor"):
        return None
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[33:127], kinds[48:58], kinds[65:91], kinds[97:123], kinds[9:14], kinds[32] = _SIGN, _DIGIT, _LETTER, _LETTER, _SPACE, _SPACE
    begins = "'" + "".join(c for t in described.get("added_tokens") or [] for c in (t["content"][:1].lower(), t["content"][:1].upper()))
    kinds[[ord(c) for c in begins if c.isascii()]] = _OTHER
    kinds[0xC3] = _LETTER if begins.isascii() else _OTHER
    return kinds.tobytes()


class WordIds:
    """A tokenizer whose tokens never go over white space, and the ids of the words it has met, as arrays sorted by hash."""

    def __init__(self, described: str):
        from tokenizers import Tokenizer

        self.described, self.encoder = described, Tokenizer.from_str(described)
        parts = json.loads(described)
        self.kinds = _kinds(parts)
        if self.kinds is not None:
            self.lowered = Tokenizer.from_str(json.dumps(parts | {"normalizer": None}))
            ids = self.encoder.get_vocab(with_added_tokens=True)
            self.final = np.zeros(max(ids.values()) + 1, bool)
            self.final[[i for w, i in ids.items() if w.endswith(parts["model"]["end_of_word_suffix"])]] = True
        specials = [t["content"] for t in parts.get("added_tokens") or []]
        self.specials = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.hashes, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)  # met in more than one slice
        self.ids = np.zeros(0, np.uint32)

    def cut(self, data: np.ndarray, offsets: np.ndarray):
        """The bytes to look up, ``word_places`` and which places are plain: words of Latin-1 letters, digits and signs are lowered and cut.

        Their tokens are those of their runs of letters, their digits one by one, and their runs of signs. There are far
        fewer of these than of words with a comma behind them and the like. NFC leaves such words as they are.
        """
        starts, ends, of_text = word_places(data, offsets)
        if self.kinds is None or not len(starts):
            return data, starts, ends, of_text, np.zeros(len(starts), bool)
        raw = data.tobytes()
        kind = np.frombuffer(raw.translate(self.kinds), np.uint8).copy()
        latin = np.flatnonzero(data[:-1] == 0xC3) + 1  # the second bytes of U+00C0 to U+00FF: letters but for two
        second = data[latin]
        kind[latin] = np.where((second == 0x97) | (second == 0xB7), _OTHER, _LETTER)
        odd = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == _OTHER, out=odd[1:])
        whole = odd[ends] > odd[starts]
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts[whole]] += 1
        edge[ends[whole]] -= 1
        plain = np.cumsum(edge[:-1], dtype=np.int8) == 0
        first = plain & (kind != _SPACE)
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins = np.zeros(len(data), bool)
        begins[starts] = True
        places = np.flatnonzero(first | begins)
        word = np.cumsum(begins[places]) - 1
        stops = np.minimum(np.append(places[1:], len(data)), ends[word])
        low = np.where(plain, np.frombuffer(raw.translate(_LOWER), np.uint8), data)
        low[latin] += np.where(plain[latin] & (second <= 0x9E), 32, 0).astype(np.uint8)
        return low, places, stops, np.searchsorted(places, offsets), ~whole[word]

    def encode_plain(self, pieces: bytes) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for plain pieces: nothing to normalise, and each one's last token is the one with the suffix."""
        coded = self.lowered.encode_batch_fast([pieces.decode()], add_special_tokens=False)[0]
        ids = np.array(coded.ids, np.uint32)
        last = np.flatnonzero(self.final[ids])
        if len(last) != pieces.count(b"\n") or len(last) and last[-1] != len(ids) - 1:  # letters that the vocabulary lacks
            return self.encode(pieces)
        return ids, np.diff(last, prepend=-1)

    def encode(self, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with a line break behind each one, and how many each word has."""
        text = words.decode()
        if self.specials and self.specials.search(text):
            # Special tokens may take white space beside them, so these words are encoded one by one.
            found = [e.ids for e in self.encoder.encode_batch(text.split("\n")[:-1], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        coded = self.encoder.encode(text, add_special_tokens=False)
        breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
        of = np.searchsorted(breaks, np.fromiter((a for a, _ in coded.offsets), np.int64, len(coded)))
        return np.array(coded.ids, np.uint32), np.bincount(of, minlength=len(breaks)).astype(np.int64)

    def slice_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray | None = None):
        """The ids of all words, one after another, and how many each one has. New words are encoded, each once.

        ``plain`` marks those that ``encode_plain`` may take.
        """
        hashes, at, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        known = self.hashes[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        self.again[place[known]] = True
        new = np.flatnonzero(~known)
        simple = np.zeros(len(new), bool) if plain is None else plain[at[new]]
        new = np.concatenate((new[~simple], new[simple]))
        others = len(new) - int(simple.sum())
        low, high = starts[at[new]], ends[at[new]]
        ids, sizes = [self.ids], [np.zeros(0, np.int64)]
        first, until = 0, np.cumsum(high - low)
        while first < len(new):
            last = min(first + BATCH_WORDS, max(first + 1, int(np.searchsorted(until, until[first] + 1_000_000))))
            last = min(last, others) if first < others else last
            lengths = high[first:last] - low[first:last]
            some = np.full(int(lengths.sum()) + last - first, 10, np.uint8)
            some[ragged(np.cumsum(lengths + 1) - lengths - 1, lengths)] = data[ragged(low[first:last], lengths)]
            found, counts = (self.encode if first < others else self.encode_plain)(some.tobytes())
            ids.append(found)
            sizes.append(counts)
            first = last
        added = np.concatenate(sizes)
        begins = np.cumsum(added) - added + len(self.ids)
        self.ids = np.concatenate(ids)
        order = np.argsort(np.concatenate((self.hashes, hashes[new])), kind="stable")
        self.hashes, self.begins, self.sizes, self.again = (
            np.concatenate(x)[order] for x in ((self.hashes, hashes[new]), (self.begins, begins), (self.sizes, added), (self.again, np.zeros(len(new), bool))))
        place = np.searchsorted(self.hashes, hashes)[inverse]
        sizes = self.sizes[place]
        out = self.ids[ragged(self.begins[place], sizes)]
        if len(self.hashes) > CACHE_WORDS:
            self._forget()
        return out, sizes

    def _forget(self):
        """Keep the words met in several slices, or none if they are more than half of what may be held."""
        keep = self.again if self.again.sum() <= CACHE_WORDS // 2 else np.zeros(len(self.again), bool)
        self.ids = self.ids[ragged(self.begins[keep], self.sizes[keep])]
        self.hashes, self.sizes = self.hashes[keep], self.sizes[keep]
        self.begins, self.again = np.cumsum(self.sizes) - self.sizes, np.zeros(len(self.sizes), bool)


def _word_ids(described: str) -> WordIds:
    """This worker's tokenizer and the words it has met.

    The package travels by value, so its own globals are new in every task; what outlasts one stands among the modules.
    """
    kept = sys.modules.setdefault("sparkprep_kept", types.ModuleType("sparkprep_kept"))
    if getattr(kept, "word_ids", None) is None or kept.word_ids.described != described:
        kept.word_ids = WordIds(described)
    return kept.word_ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 1, parts: int | None = None) -> None:
    """Encode every text, end it with ``end_id``, and write shards to ``path`` in ascending order of ids (null first).

    Null and empty texts hold the end id alone. Equal ids are ordered by a hash of their text. Other columns are not
    looked at. White space parts the tokens of this kind of tokenizer, so a worker encodes each distinct word once, as long as it
    holds it (``CACHE_WORDS``); where the splitter is known to keep letters, digits and signs apart, each run of these.
    """
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        described = f.read()
    bits = bits_for(max(Tokenizer.from_str(described).get_vocab_size(), end_id + 1))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    shared = docs.sparkSession.sparkContext.broadcast(described)  # the vocabulary: its size does not grow with the data

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _word_ids(shared.value)
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, pieces, held = [], [], [], 0

        def close():
            nonlocal shard, before, doc_ids, lengths, pieces, held
            blob = pack_shard(doc_ids, lengths, np.concatenate(pieces), before, bits)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(doc_ids)], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([blob], pa.binary())], ["part", "shard", "n_docs", "n_ids", "data"])
            shard, before, doc_ids, lengths, pieces, held = shard + 1, before + held, [], [], [], 0
            return out

        for b in batches:
            names = b.column(0).to_pylist()
            for first, end, data, offsets in text_slices(b.column(1)):
                data, starts, ends, of_text, plain = encoder.cut(data, offsets)
                ids, per_word = encoder.slice_ids(data, starts, ends, plain)
                total = np.concatenate(([0], np.cumsum(per_word)))
                cuts = total[of_text]
                for row in range(first, end):
                    doc_ids.append(names[row])
                    pieces += [ids[cuts[row - first] : cuts[row - first + 1]], np.array([end_id], np.uint32)]
                    lengths.append(int(cuts[row - first + 1] - cuts[row - first]) + 1)
                    held += lengths[-1]
                    if held >= SHARD_IDS:
                        yield close()
        if doc_ids:
            yield close()

    (
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(encode, "part int, shard int, n_docs long, n_ids long, data binary")
        .write.parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and ``ids`` if asked."""
    shards = spark.read.parquet(path)
    # One row per range partition of the writer, whatever the size of the data.
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(sums):
        base[part], total = total, total + sums[part]

    def decode(batches):
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                shard = Shard(data.as_buffer())
                ends = np.cumsum(shard.lengths)
                crc, lists = [], []
                for i in range(0, len(ends), 256):
                    low = int(ends[i - 1]) if i else 0
                    ids = shard.ids(low, int(ends[min(i + 256, len(ends)) - 1]))
                    for e, n in zip(ends[i : i + 256] - low, shard.lengths[i : i + 256]):
                        crc.append(zlib.crc32(ids[e - n : e].astype("<u4").tobytes()))
                        if with_ids:
                            lists.append(ids[e - n : e].tolist())
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(base[part] + shard.first + ends - shard.lengths),
                           pa.array(shard.lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shards.select("part", "data").mapInArrow(decode, schema)
