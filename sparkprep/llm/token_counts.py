"""Token counts by rank-synchronous array merging.

A tokenizer of this kind drops white space, so a text's count is the sum of its words' counts, and each distinct word is
counted once per worker. New words are normalised and cut into pre-tokens by the library that owns the tokenizer; the merges
are numpy's. All pre-tokens of a batch lie behind one another in one ragged array of symbols. In a round every sequence
applies its pair of lowest rank, all sequences at the same time; sequences with no pair left leave the arrays, and the
symbols that survive are the tokens.

Rounds must not grow with the length of a sequence, so a long one applies every pair that is the lowest *within reach*: no
token has more symbols than ``reach``, so whatever merges earlier beyond that distance cannot touch the pair. Both need that
a merge never makes a pair of lower rank than its own, which is checked when the vocabulary is loaded.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.words import SLICE_BYTES, ragged, text_slices, word_hashes, word_places

CACHE_WORDS = 500_000
BATCH_WORDS = 50_000
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes as they are, others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    return [moved.get(b, chr(b)) for b in range(256)]


@dataclass
class Vocabulary:
    """A tokenizer's tables: symbols of bytes, merges sorted by pair, and the library's own normaliser and splitter."""

    inner: np.ndarray
    last: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    size: int
    reach: int
    specials: re.Pattern | None
    normal: object
    split: object
    known: dict[int, int] = field(default_factory=dict)


def load(described: str) -> Vocabulary:
    """The tables of a byte-level BPE tokenizer (the text of its JSON file) whose splitter drops white space.

    Other kinds are refused with ``ValueError``: their counts could not be summed word by word.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    spec = json.loads(described)
    model = spec["model"]
    end = model.get("end_of_word_suffix") or ""
    steps = spec["normalizer"]["normalizers"] if (spec.get("normalizer") or {}).get("type") == "Sequence" else []
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    plain = (
        model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback")
        and not model.get("continuing_subword_prefix") and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
        and {s["type"] for s in steps} <= {"NFC", "Lowercase", "Replace"} and spec.get("truncation") is None and spec.get("padding") is None
        and all(s["type"] != "Replace" or (s["pattern"] == {"Regex": r"\s+"} and s["content"] == " ") for s in steps)
    )
    specials = [t["content"] for t in spec["added_tokens"]]
    clear = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    if not plain or not clear or any(re.search(r"\s", s) for s in specials):
        raise ValueError("counting by words needs a byte-level BPE tokenizer whose splitter drops white space")
    vocab = model["vocab"]
    letters = byte_letters()
    inner = np.array([vocab[x] for x in letters], np.int64)
    last = np.array([vocab[x + end] for x in letters], np.int64)
    merges = [tuple(p) if not isinstance(p, str) else tuple(p.split(" ", 1)) for p in model["merges"]]
    least: dict[str, int] = {}
    for rank, pair in enumerate(merges):
        for part in pair:
            least.setdefault(part, rank)
    if any(least.get(a + b, len(merges)) <= rank for rank, (a, b) in enumerate(merges)):
        raise ValueError("a merge of this vocabulary makes a pair of lower rank than its own")
    size = max(vocab.values()) + 1
    pairs = np.array([vocab[a] * size + vocab[b] for a, b in merges], np.int64)
    order = np.argsort(pairs, kind="stable")
    # White space never lies inside of a pre-token, so the step that replaces it changes no count.
    return Vocabulary(
        inner, last, pairs[order], order.astype(np.int32), np.array([vocab[a + b] for a, b in merges], np.int64)[order], size,
        max(len(a + b) for a, b in merges), re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None,
        normalizers.Sequence([getattr(normalizers, s["type"])() for s in steps if s["type"] != "Replace"]),
        pre_tokenizers.Split(Regex(splits[0]["pattern"]["Regex"]), "removed", invert=True))


def _look(v: Vocabulary, left: np.ndarray, right: np.ndarray):
    """Rank and result of each pair; pairs that never merge have rank ``_NONE``."""
    key = left * v.size + right
    at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
    found = v.pairs[at] == key
    return np.where(found, v.ranks[at], _NONE), np.where(found, v.made[at], -1)


def _lowest_near(rank: np.ndarray, reach: int) -> np.ndarray:
    """The least rank among each place and ``reach`` places on both sides, by windows that double."""
    padded = np.concatenate((np.full(reach, _NONE), rank, np.full(reach, _NONE)))
    width, want = 1, 2 * reach + 1
    while width * 2 <= want:
        padded = np.minimum(padded[:-width], padded[width:])
        width *= 2
    rest = want - width
    return np.minimum(padded[: len(padded) - rest], padded[rest:])[: len(rank)] if rest else padded[: len(rank)]


def merged_sizes(v: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The number of symbols each sequence keeps when all merges are done. ``symbols``: all sequences, one after another."""
    out = np.zeros(len(lengths), np.int64)
    owner = np.flatnonzero(lengths)  # which sequence each one still at work is
    lengths = lengths[owner]
    same = np.ones(len(symbols), bool)
    same[np.cumsum(lengths) - 1] = False
    rank, made = np.full(len(symbols), _NONE), np.full(len(symbols), -1, np.int64)
    at = np.flatnonzero(same)
    rank[at], made[at] = _look(v, symbols[at], symbols[at + 1])
    while len(owner):
        begins = np.cumsum(lengths) - lengths
        least = np.minimum.reduceat(rank, begins)
        done = least == _NONE
        if done.any():
            out[owner[done]] = lengths[done]
            stay = np.repeat(~done, lengths)
            symbols, rank, made = symbols[stay], rank[stay], made[stay]
            owner, lengths, least = owner[~done], lengths[~done], least[~done]
            begins = np.cumsum(lengths) - lengths
            if not len(owner):
                break
        floor = np.repeat(least, lengths)
        long = np.flatnonzero(lengths > 4 * v.reach)
        for i in long:  # few: each is longer than four times the longest token
            part = slice(begins[i], begins[i] + lengths[i])
            floor[part] = _lowest_near(rank[part], v.reach)
        pick = (rank == floor) & (rank != _NONE)
        # Pairs that overlap have one rank (a a a): from the first of such a run on, every other one is applied.
        new_run = np.ones(len(rank), bool)
        new_run[1:] = rank[1:] != rank[:-1]
        new_run[begins] = True
        first = np.maximum.accumulate(np.where(new_run, np.arange(len(rank)), 0))
        pick &= pick[first] & ((np.arange(len(rank)) - first) % 2 == 0)
        at = np.flatnonzero(pick)
        symbols[at] = made[at]
        # The pair behind a merged one is now that of the symbol swallowed.
        rank[at], made[at] = rank[at + 1], made[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        lengths = lengths - np.add.reduceat(pick.astype(np.int64), begins)
        moved = np.cumsum(keep) - 1
        symbols, rank, made = symbols[keep], rank[keep], made[keep]
        at = moved[at]
        final = np.zeros(len(symbols), bool)
        final[np.cumsum(lengths) - 1] = True
        before = at[at > 0] - 1
        changed = np.unique(np.concatenate((at, before)))
        rank[changed], made[changed] = _NONE, -1
        changed = changed[~final[changed]]
        rank[changed], made[changed] = _look(v, symbols[changed], symbols[changed + 1])
    return out


def _bytes_to_sequences(v: Vocabulary, pieces: list[bytes]):
    lengths = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    symbols = v.inner[data]
    ends = np.cumsum(lengths)[lengths > 0] - 1
    symbols[ends] = v.last[data[ends]]
    return symbols, lengths


def count_words_tokens(v: Vocabulary, words: list[str]) -> np.ndarray:
    """Tokens of each word (a text without ASCII white space)."""
    counts = np.zeros(len(words), np.int64)
    if v.specials:
        of, parts = [], []
        for i, w in enumerate(words):
            if v.specials.search(w):
                cut = v.specials.split(w)
                counts[i] += len(cut) - 1
                of += [i] * len(cut)
                parts += cut
            else:
                of.append(i)
                parts.append(w)
    else:
        of, parts = range(len(words)), words
    text = v.normal.normalize_str("\n".join(parts))
    pieces = v.split.pre_tokenize_str(text)
    numbers: dict[str, int] = {}
    which = np.array([numbers.setdefault(p, len(numbers)) for p, _ in pieces], np.int64)
    places = np.array([at[0] for _, at in pieces], np.int64)
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)
    sizes = merged_sizes(v, *_bytes_to_sequences(v, [p.encode() for p in numbers]))
    of = np.asarray(of, np.int64)
    if len(which):
        counts += np.bincount(of[np.searchsorted(breaks, places)], weights=sizes[which], minlength=len(words)).astype(np.int64)
    return counts


def count_slice(v: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text of a run of texts (bytes and offsets)."""
    starts, ends, of_text = word_places(data, offsets)
    hashes, at, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    keys = hashes.tolist()
    if len(v.known) > CACHE_WORDS:
        for k in list(v.known)[: CACHE_WORDS // 2]:
            del v.known[k]
    new = [i for i, k in enumerate(keys) if k not in v.known]
    text = data.tobytes()
    words = [text[starts[j] : ends[j]].decode() for j in at[new]]
    for i in range(0, len(new), BATCH_WORDS):
        v.known.update(zip([keys[j] for j in new[i : i + BATCH_WORDS]], count_words_tokens(v, words[i : i + BATCH_WORDS]).tolist()))
    per_word = np.array([v.known[k] for k in keys], np.int64)[inverse] if keys else np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(per_word)))
    return total[of_text[1:]] - total[of_text[:-1]]


def _count_one(v: Vocabulary, data: np.ndarray) -> int:
    """Tokens of one long text, cut at white space so that the arrays stay small."""
    total, first = 0, 0
    while first < len(data):
        end = min(first + SLICE_BYTES, len(data))
        while end < len(data):
            near = data[end : end + SLICE_BYTES]
            gaps = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))
            end += int(gaps[0]) if len(gaps) else len(near)
            if len(gaps):
                break
        total += int(count_slice(v, data[first:end], np.array([0, end - first]))[0])
        first = end
    return total


_loaded: dict[str, Vocabulary] = {}  # of this worker: one tokenizer and the words it has counted


def _vocabulary(described: str) -> Vocabulary:
    if described not in _loaded:
        _loaded.clear()
        _loaded[described] = load(described)
    return _loaded[described]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    ``tokenizer`` is the path of a tokenizer file on the driver. Special tokens written in a text count as the library counts
    them, one each; none is added. Null and empty texts have 0 bytes and 0 tokens; equal ids and equal texts stay rows of
    their own; an empty table gives no rows; other columns are not looked at, so their names cannot clash. Each task reads its
    texts once, nothing is shuffled, and a very long text is counted in pieces that end at white space.
    """
    with open(tokenizer, encoding="utf-8") as f:
        described = f.read()
    load(described)  # refuse other kinds before any task starts
    shared = docs.sparkSession.sparkContext.broadcast(described)  # the vocabulary: its size does not grow with the data
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        v = _vocabulary(shared.value)
        for b in batches:
            sizes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in text_slices(b.column(1)):
                sizes.append(np.diff(offsets))
                long = len(offsets) == 2 and len(data) > 2 * SLICE_BYTES
                counts.append(np.array([_count_one(v, data)]) if long else count_slice(v, data, offsets))
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(sizes), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                ["id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean").fields])
    return rows.mapInArrow(count, schema).withColumnRenamed("id", id_col)
