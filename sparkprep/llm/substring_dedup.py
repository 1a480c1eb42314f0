"""Remove word sequences that also stand elsewhere, by counting windows that share an anchor.

A window of ``window`` words holds one anchor, the run of ``ANCHOR`` words with the least hash. Equal windows have their
anchor at the same place, so a window can only be repeated if the words of its anchor are. The windows that share an anchor
are consecutive in one text and travel together, as one row with their words; anchors that stand once are left out.

Groups of at most ``group_rows`` rows are gathered in memory-sized batches, where prefix doubling gives equal runs of 1, 2,
4, ... and at last ``window`` words equal numbers, which are counted. There is no tree: no inner nodes, and no repeats by
length beyond the window. The windows of larger groups are counted by a 128-bit hash of their words, with map-side sums, so
that no task holds such a group. Both ways give the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.words import gram_hashes, ragged, text_slices, word_hashes, word_places
from sparkprep.session import cut

ANCHOR = 8
GROUP_ROWS = 20_000
BATCH_WORDS = 2_000_000


def _runs(data, offsets, window: int, anchor: int):
    """Rows (text number, anchor hash, first window, last window), with windows counted in words of the text."""
    starts, ends, of_text = word_places(data, offsets)
    hashes = word_hashes(data, starts, ends)
    grams = gram_hashes(hashes, anchor)
    n = len(hashes) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return starts, ends, of_text, (empty, empty.view(np.uint64), empty, empty)
    # The least gram of each window, the leftmost of equal ones, by doubling the width.
    width, value, at = 1, grams, np.arange(len(grams))
    while width < window - anchor + 1:
        step = min(width, window - anchor + 1 - width)
        right = value[step:]
        left = value[: len(right)]
        less = right < left
        at, value = np.where(less, at[step:], at[: len(right)]), np.where(less, right, left)
        width += step
    text = np.searchsorted(of_text, np.arange(n), "right") - 1
    whole = np.arange(n) + window <= of_text[text + 1]
    at, value, text, place = at[:n][whole], value[:n][whole], text[whole], np.flatnonzero(whole)
    if not len(at):
        return starts, ends, of_text, (empty, empty.view(np.uint64), empty, empty)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    stop = np.concatenate((new[1:], [len(at)])) - 1
    text = text[new]
    return starts, ends, of_text, (text, value[new], place[new] - of_text[text], place[stop] - of_text[text])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id`` and ``_hash`` name a row by what it holds: equal rows share the name, and share what is found for it."""
    return docs.select(
        F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_hash"),
        F.col(text_col).cast("string").alias("_text"),
    )


def _with(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    lists = lists.withColumnsRenamed({"_hash": "_h", "_id": "_i"})
    return rows.join(lists, (rows["_hash"] == lists["_h"]) & rows["_id"].eqNullSafe(lists["_i"]), how)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
                 group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (_id, _hash, first, last): windows ``first .. last`` (numbers of their first words) stand elsewhere too.

    Rows may overlap. Null and short texts have no windows; equal rows of ``docs`` repeat each other.
    """
    return _find(_rows(docs, id_col, text_col), window, group_rows)


def _find(rows: DataFrame, window: int, group_rows: int) -> DataFrame:
    anchor = min(ANCHOR, window)

    def anchors(batches):
        for b in batches:
            for first, end, data, offsets in text_slices(b.column(2)):
                text, value, low, high = _runs(data, offsets, window, anchor)[3]
                take = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(value.view(np.int64)),
                     pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["_id", "_hash", "anchor", "low", "high"])

    found = rows.mapInArrow(anchors, "_id long, _hash long, anchor long, low int, high int")
    repeated = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    lists = (
        found.join(repeated, "anchor").groupBy("_hash", "_id")
        .agg(F.collect_list(F.struct("low", "anchor", "high", "n")).alias("runs"))
    )

    def with_words(batches):
        for b in batches:
            runs = b.column(3).flatten()
            per_row = np.diff(np.asarray(b.column(3).offsets))
            low, key, high, n = (np.asarray(runs.field(i)) for i in range(4))
            edges = np.concatenate(([0], np.cumsum(per_row)))
            for first, end, data, offsets in text_slices(b.column(2)):
                out = ([], [], [], [], [], [])
                for row in range(first, end):
                    # Rows that are equal have one list, with each run as often as there are such rows.
                    own = edges[row] + np.unique(low[edges[row] : edges[row + 1]], return_index=True)[1]
                    words = data[offsets[row - first] : offsets[row - first + 1]].tobytes().split()
                    for i in own:
                        for column, x in zip(out, (row, key[i], n[i], low[i], high[i], b" ".join(words[low[i] : high[i] + window]))):
                            column.append(x)
                take = pa.array(out[0], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.int32()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary())],
                    ["_id", "_hash", "anchor", "n", "low", "high", "words"])

    suffixes = cut(
        _with(rows, lists, "inner").select("_id", "_hash", "_text", "runs")
        .mapInArrow(with_words, "_id long, _hash long, anchor long, n long, low int, high int, words binary"), "suffixes")

    def tree(batches):
        held, words = [], 0
        for b in batches:
            for first in range(0, b.num_rows, 2000):
                part = b.slice(first, 2000)
                held.append(part)
                words += int((np.asarray(part.column(5)) - np.asarray(part.column(4)) + window).sum())
                if words > BATCH_WORDS:
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    key = np.asarray(table.column(2))
                    other = np.flatnonzero(key != key[-1])
                    if len(other):  # the last group may go on
                        end = int(other[-1]) + 1
                        yield _deep(table.slice(0, end), window)
                        held = [table.slice(end)]
                        words = 0
        if held:
            yield _deep(pa.Table.from_batches(held).combine_chunks().to_batches()[0], window)

    in_trees = suffixes.where(F.col("n") <= group_rows).repartition("anchor").sortWithinPartitions("anchor") \
        .mapInArrow(tree, "_id long, _hash long, first int, last int")

    def windows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                rows_, place, high_, low_ = [], [], [], []
                for i, (low, text) in enumerate(zip(part.column(4).to_pylist(), part.column(6).to_pylist())):
                    words = text.split()
                    for k in range(len(words) - window + 1):
                        digest = xxhash.xxh3_128_digest(b" ".join(words[k : k + window]))
                        rows_.append(i)
                        place.append(low + k)
                        high_.append(int.from_bytes(digest[:8], "little", signed=True))
                        low_.append(int.from_bytes(digest[8:], "little", signed=True))
                take = pa.array(rows_, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(place, pa.int32()), pa.array(high_, pa.int64()),
                     pa.array(low_, pa.int64())], ["_id", "_hash", "first", "w1", "w2"])

    long_prefix = suffixes.where(F.col("n") > group_rows).mapInArrow(windows, "_id long, _hash long, first int, w1 long, w2 long")
    counted = long_prefix.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1")
    by_hash = long_prefix.join(counted, ["w1", "w2"]).select("_id", "_hash", "first", F.col("first").alias("last"))
    return in_trees.unionByName(by_hash)


def _deep(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """The suffixes of ``batch`` below nodes of depth ``window`` with two leaves or more, as runs of windows."""
    numbers: dict[bytes, int] = {}
    ids, lengths = [], []
    for text in batch.column(6):
        words = text.as_py().split()
        lengths.append(len(words))
        ids.extend([numbers.setdefault(w, len(numbers)) for w in words])
    name, depth = np.array(ids, np.int64), 1
    while depth < window:
        step = min(depth, window - depth)
        nxt = np.concatenate((name[step:], np.zeros(min(step, len(name)), np.int64)))
        name = np.unique(name * (int(name.max(initial=0)) + 1) + nxt, return_inverse=True)[1]
        depth += step
    lengths = np.array(lengths, np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    many = lengths - window + 1
    leaf = ragged(begins, many)
    row = np.repeat(np.arange(len(many)), many)
    _, inverse, count = np.unique(name[leaf], return_inverse=True, return_counts=True)
    deep = count[inverse] > 1
    leaf, row = leaf[deep], row[deep]
    new = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1] + 1) | (row[1:] != row[:-1])))) if len(leaf) else np.zeros(0, np.int64)
    stop = np.concatenate((new[1:], [len(leaf)]))[: len(new)] - 1
    low = np.asarray(batch.column(4))
    take = pa.array(row[new])
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(take), batch.column(1).take(take),
         pa.array((low[row[new]] + leaf[new] - begins[row[new]]).astype(np.int32)),
         pa.array((low[row[new]] + leaf[stop] - begins[row[new]]).astype(np.int32))], ["_id", "_hash", "first", "last"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
                   group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``n_removed`` and ``kept``, the words left, one space between.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes when a window of ``window`` words over it also starts elsewhere; all
    copies go. Null text: no words, ``kept`` is empty. Null ids are kept; equal ids with different texts are rows of their
    own; equal rows repeat each other. Other columns are not looked at. An empty table gives an empty result.
    """
    rows = _rows(docs, id_col, text_col)
    spans = _find(rows, window, group_rows).groupBy("_hash", "_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def keep(batches):
        for b in batches:
            total, removed, kept = [], [], []
            for text, spans_ in zip(b.column(1), b.column(2)):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if spans_.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    runs = spans_.values
                    np.add.at(cover, np.asarray(runs.field(0)), 1)
                    np.add.at(cover, np.asarray(runs.field(1)) + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["_id", "n_words", "n_removed", "kept"])

    return (
        _with(rows, spans, "left").select("_id", "_text", "spans")
        .mapInArrow(keep, "_id long, n_words long, n_removed long, kept string").withColumnRenamed("_id", id_col)
    )
