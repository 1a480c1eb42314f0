"""Phrase collocations from weighted acyclic automata over words.

Every word starts a path of up to ``most_words`` words inside its piece of text; the count of a phrase is the number of paths
that begin with it. A shard (some millions of paths of one task) sorts its paths and builds from them, layer by layer, an
acyclic count transducer: arcs carry a word and the number of paths behind it, and states with the same arcs are one state.
The transducers are cut at common boundaries of the sorted paths, so that each *prefix range* holds about as many paths
however common its words are, and the pieces of a range are united and their weights summed in one task. Only the phrases on
the two edges of a range can go on in the next one; their partial counts meet in a last sum. The sizes below suit tasks with
some 300 MB for Python; there are (paths / ``SHARD_PATHS``) x (paths / ``RANGE_PATHS``) pieces, so raise both where tasks have more.

A phrase is never more frequent than a word in it, so paths end before words that are rarer than the least count. Words are
numbered by 64-bit hashes. A bitmap of a fixed size tells the frequent ones; where two words share a bit a rare word may stay
in, which changes no result.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm.words import lower_ascii, mix, ragged, run_places, text_slices, word_hashes
from sparkprep.session import cut

SHARD_PATHS = 800_000  # paths a task holds before it builds a transducer
RANGE_PATHS = 1_000_000  # paths of all shards that one range may hold
FOLD_PATHS = 500_000  # paths from pieces that a range gathers before it sums them
COMMON_WORDS = 65_536  # the most frequent words, known to all tasks; pieces need not spell them out
BITS = 1 << 26  # of the bitmap of frequent words
NONE = -(2**63)  # behind the end of a path; comes before every word


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, hashes and texts of the words of a run of texts, and whether the next word goes on in the same piece."""
    data = lower_ascii(data)
    stop = ((data >= 10) & (data <= 13)) | np.isin(data, np.frombuffer(b".,;:!?", np.uint8))
    starts, ends, of_text = run_places(~(stop | (data == 32) | (data == 9)), offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(of_text))
    hashes = word_hashes(data, starts, ends).view(np.int64)
    hashes[hashes == NONE] += 1
    piece = np.cumsum(stop, dtype=np.int64)[starts] if len(data) else np.zeros(0, np.int64)
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    return data, starts, ends, hashes, text, goes_on


def count_words(rows: DataFrame, least: int) -> DataFrame:
    """(h0, h, word, n): the words of each language with ``least`` occurrences; all others in one row with h null."""

    def count(batches):
        for b in batches:
            langs = np.asarray(b.column(0))
            for first, end, data, offsets in text_slices(b.column(1)):
                data, starts, ends, hashes, text, _ = words_of(data, offsets)
                own = langs[first:end][text]
                for lang in np.unique(own):
                    of = np.flatnonzero(own == lang)
                    distinct, at, n = np.unique(hashes[of], return_index=True, return_counts=True)
                    begin, size = starts[of[at]], (ends - starts)[of[at]]
                    put = np.concatenate(([0], np.cumsum(size)))
                    letters = data[ragged(begin, size)]
                    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(put), pa.py_buffer(letters)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), lang)), pa.array(distinct), words.cast(pa.large_string()).cast(pa.string()), pa.array(n)],
                        ["h0", "h", "word", "n"])

    counted = rows.mapInArrow(count, "h0 long, h long, word string, n long").groupBy("h0", "h", "word").agg(F.sum("n").alias("n"))
    often = F.col("n") >= least
    return counted.groupBy("h0", F.when(often, F.col("h")).alias("h"), F.when(often, F.col("word")).alias("word")).agg(F.sum("n").alias("n"))


def word_bitmap(words: DataFrame) -> np.ndarray:
    """The bits of the frequent words, ``BITS / 8`` bytes."""
    bit = F.col("h").bitwiseXOR(F.col("h0")).bitwiseAND(F.lit(BITS - 1)) + 1
    blocks = words.where("h is not null").groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # at most BITS / 32768 rows of 4 KB
    out = np.zeros((max(1, BITS // 32768), 4096), np.uint8)
    for r in blocks:
        out[r["b"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def frequent_paths(data, offsets, langs: np.ndarray, bitmap: np.ndarray, most_words: int):
    """Words of paths: language, hash, and how many words the path that starts there has."""
    _, _, _, hashes, text, goes_on = words_of(data, offsets)
    own = langs[text]
    bit = (hashes ^ own) & (BITS - 1)
    often = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
    linked = goes_on & often
    linked[:-1] &= often[1:]
    length = often.astype(np.int8)
    go = often
    for i in range(1, most_words):
        go = go[: len(go) - 1] & linked[i - 1 : i - 1 + len(go) - 1] if len(go) else go
        length[: len(go)] += go
    return own[often], hashes[often], length[often]


def columns_of(own, hashes, length, most_words: int, none=NONE) -> list[np.ndarray]:
    """Language and words of each path, as columns; places behind the end hold ``none``."""
    out = [own, hashes]
    for i in range(1, most_words):
        moved = np.full(len(hashes), none, hashes.dtype)
        moved[: len(hashes) - i] = hashes[i:]
        moved[length <= i] = none
        out.append(moved)
    return out


def _places(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted(sorted_values, values).astype(np.int32)


def _numbered(columns: list[np.ndarray]):
    """Words (and languages) as numbers that keep their order; 0 is no word."""
    langs = np.unique(columns[0])
    words = np.unique(np.concatenate([np.unique(c) for c in columns[1:]]))
    words = words[words != NONE]
    numbers = [_places(langs, columns[0]) + 1]
    numbers += [np.where(c == NONE, 0, _places(words, c) + 1).astype(np.int32) for c in columns[1:]]
    return langs, words, numbers


def _summed(numbers: list[np.ndarray], counts: np.ndarray, n_langs: int, n_words: int):
    """Equal paths made one, in order, their counts summed."""
    key, top = numbers[0].astype(np.int64), n_langs + 1
    for c in numbers[1:]:
        if top * (n_words + 1) >= 2**62:
            distinct, key = np.unique(key, return_inverse=True)
            top = len(distinct)
        key = key * (n_words + 1) + c
        top *= n_words + 1
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return [c[order[first]] for c in numbers], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _layers(paths: list[np.ndarray], counts: np.ndarray, of_range: np.ndarray | None = None):
    """Nodes of the sorted paths by depth: (first row, label, weight, node of each row or -1). No node reaches over ranges."""
    total = np.concatenate(([0], np.cumsum(counts)))
    changed = np.zeros(len(counts), bool)
    if len(changed):
        changed[0] = True
        if of_range is not None:
            changed[1:] = of_range[1:] != of_range[:-1]
    out = []
    for label in paths:
        changed = changed.copy()
        changed[1:] |= label[1:] != label[:-1]
        first = np.flatnonzero(changed)
        weight = np.diff(total[np.append(first, len(counts))])
        real = label[first] != 0
        of_row = np.where(label != 0, np.cumsum(changed & (label != 0), dtype=np.int32) - 1, np.int32(-1))
        out.append((first[real], label[first[real]], weight[real], of_row))
    return out


def build(paths: list[np.ndarray], counts: np.ndarray, of_range: np.ndarray):
    """The minimal transducer of sorted paths: for each depth (range of the state, first arc, label, weight, target).

    States never reach over ranges, and those of a range lie together, so each layer can be cut by range. The root of a
    range is its one state at depth 0; state -1 has no arcs.
    """
    nodes = _layers(paths, counts, of_range)
    layers = []
    state = np.full(len(nodes[-1][0]), -1, np.int64)  # of the nodes at the depth below
    for depth in range(len(paths) - 1, -1, -1):
        first, label, weight, _ = nodes[depth]
        if depth:
            above_first, _, _, of_row = nodes[depth - 1]
            parent, n_parents = of_row[first], len(above_first)
            ranges = of_range[above_first]
        else:
            parent = of_range[first]
            n_parents = int(parent[-1]) + 1 if len(parent) else 0
            ranges = np.arange(n_parents)
        begin = np.searchsorted(parent, np.arange(n_parents))
        size = np.searchsorted(parent, np.arange(n_parents), "right") - begin
        # Two independent sums over the arcs tell states apart.
        arc = mix(label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(weight.astype(np.uint64) + mix(state.astype(np.uint64))))
        sums = [np.concatenate(([0], np.cumsum(a, dtype=np.uint64))) for a in (arc, mix(arc ^ np.uint64(0xD6E8FEB86659FD93)))]
        signs = [s[begin + size] - s[begin] for s in sums]
        has = np.flatnonzero(size)
        order = has[np.lexsort((signs[1][has], signs[0][has], size[has], ranges[has]))]
        same = np.ones(max(len(order) - 1, 0), bool)
        for column in (ranges, size, *signs):
            same &= column[order[1:]] == column[order[:-1]]
        new = np.concatenate((np.ones(min(len(order), 1), bool), ~same))
        chosen = order[new]
        of_node = np.full(n_parents, -1, np.int64)
        of_node[order] = np.cumsum(new) - 1
        arcs = ragged(begin[chosen], size[chosen])
        layers.append((ranges[chosen], np.concatenate(([0], np.cumsum(size[chosen]))), label[arcs], weight[arcs], state[arcs]))
        state = of_node
    return layers[::-1]


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers (0 and above) in the narrowest type."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _write(arrays: list[np.ndarray]) -> bytes:
    head = np.array([len(arrays)] + [v for a in arrays for v in (a.dtype.itemsize, len(a))], "<i8")
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def _read(blob) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    head = np.frombuffer(blob, "<i8", 2 * n, 8).reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for width, size in head:
        out.append(np.frombuffer(blob, f"<u{width}", size, at))
        at += width * size
    return out


def pieces(langs: np.ndarray, words: np.ndarray, layers, common: np.ndarray):
    """(range, bytes) for each range of a shard's transducer, with those of its words that are not among the ``common``."""
    place = np.searchsorted(common, words)
    known = np.append(common, NONE)[place] == words
    if not len(layers[0][0]):
        return
    for r in layers[0][0].tolist():
        cuts = [np.searchsorted(layer[0], [r, r + 1]) for layer in layers]
        arrays, labels = [], []
        for depth, (layer, (low, high)) in enumerate(zip(layers, cuts)):
            _, first, label, weight, target = layer
            arcs = slice(first[low], first[high])
            below = cuts[depth + 1][0] if depth + 1 < len(layers) else 0
            arrays.append([first[low : high + 1] - first[low], weight[arcs], np.where(target[arcs] < 0, 0, target[arcs] - below + 1)])
            labels.append(label[arcs])
        used = np.unique(np.concatenate(labels[1:]) - 1)
        rare = used[~known[used]]
        out = [langs[labels[0] - 1].view(np.uint64), words[rare].view(np.uint64)]
        for depth, (first, weight, target) in enumerate(arrays):
            at = labels[depth] - 1
            label = np.arange(len(at)) if depth == 0 else np.where(known[at], place[at], len(common) + np.searchsorted(rare, at))
            out += [_small(first), _small(label), _small(weight), _small(target)]
        yield r, _write(out)


def paths_of(blob, common: np.ndarray):
    """The paths of a piece and how many end there: (languages, words, columns of places in them, counts)."""
    arrays = _read(blob)
    langs, words = arrays[0].view(np.int64), np.concatenate((common, arrays[1].view(np.int64)))
    layers = [arrays[i : i + 4] for i in range(2, len(arrays), 4)]
    columns, weight, state = [], None, np.ones(1, np.int64)
    found, ends = [], []
    for first, label, arc_weight, target in layers:
        first = np.concatenate(([0], first.astype(np.int64)))  # state 0 has no arcs
        low = np.where(state > 0, first[state], 0)
        size = np.where(state > 0, first[np.minimum(state + 1, len(first) - 1)] - low, 0)
        arcs, parent = ragged(low, size), np.repeat(np.arange(len(state)), size)
        if weight is not None:
            own = weight - np.bincount(parent, weights=arc_weight[arcs], minlength=len(weight)).astype(np.int64)
            at = np.flatnonzero(own)
            found.append([c[at] for c in columns])
            ends.append(own[at])
        columns = [c[parent] for c in columns] + [label[arcs].astype(np.int32)]
        weight, state = arc_weight[arcs].astype(np.int64), target[arcs].astype(np.int64)
    found.append(columns)
    ends.append(weight)
    width = len(layers)
    full = [np.concatenate([f[i] if i < len(f) else np.full(len(e), -1, np.int32) for f, e in zip(found, ends)]) for i in range(width)]
    return langs, words, full, np.concatenate(ends)


def unite(blobs, width: int, common: np.ndarray):
    """The sum of pieces of one range: languages, words, sorted paths (numbers, 0 behind the end) and counts."""
    columns, counts, held = [[] for _ in range(width)], [], 0

    def fold():
        nonlocal columns, counts, held
        joined = [np.concatenate(c) for c in columns]
        langs, words, numbers = _numbered(joined)
        numbers, total = _summed(numbers, np.concatenate(counts), len(langs), len(words))
        with_none = np.concatenate(([NONE], words))
        columns = [[langs[numbers[0] - 1]], *[[with_none[n]] for n in numbers[1:]]]
        counts, held = [total], 0
        return langs, words, numbers, total

    for blob in blobs:
        langs, words, paths, n = paths_of(blob, common)
        with_none = np.append(words, NONE)  # place -1
        columns[0].append(langs[paths[0]])
        for c, p in zip(columns[1:], paths[1:]):
            c.append(with_none[p])
        counts.append(n)
        held += len(n)
        if held > FOLD_PATHS:
            fold()
    return fold()


def phrase_counts(rows: DataFrame, words: DataFrame, most_words: int, least: int) -> DataFrame:
    """(h0, p, f): every phrase of 1 to ``most_words`` words that occurs ``least`` times or more, as an array of hashes."""
    spark = rows.sparkSession
    total = words.where("h is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bitmap = spark.sparkContext.broadcast(word_bitmap(words))  # BITS / 8 bytes
    top = words.where("h is not null").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON_WORDS)
    common = spark.sparkContext.broadcast(np.array(sorted(r["h"] for r in top.collect()), np.int64))  # COMMON_WORDS at most
    names = ["h0", *[f"h{i}" for i in range(1, most_words + 1)]]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(math.ceil(total / RANGE_PATHS), min(parts, math.ceil(total / 50_000)), 1)

    def sample(batches):
        for b in batches:
            langs = np.asarray(b.column(0))
            for first, end, data, offsets in text_slices(b.column(1)):
                columns = columns_of(*frequent_paths(data, offsets, langs[first:end], bitmap.value, most_words), most_words)
                yield pa.RecordBatch.from_arrays([pa.array(c[::64]) for c in columns], names)

    bounds = []
    if ranges > 1:  # a sample serves only to lay the boundaries, as it does in any sort of Spark's
        some = rows.sample(0.02, seed=7).mapInArrow(sample, ", ".join(f"{n} long" for n in names))
        dealt = some.repartitionByRange(ranges, *names).groupBy(F.spark_partition_id().alias("i")).agg(F.min(F.struct(*names)).alias("low"))
        bounds = sorted({tuple(r["low"]) for r in dealt.collect()})[1:]  # one row per range
    shared = spark.sparkContext.broadcast(bounds)

    def shards(batches):
        held, size = [], 0

        def close():
            nonlocal held, size
            own, hashes, length = (np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            langs, known = np.unique(own), np.unique(hashes)
            numbers = columns_of(_places(langs, own) + 1, _places(known, hashes) + 1, length, most_words, 0)
            del own, hashes, length
            paths, counts = _summed(numbers, np.ones(len(numbers[0]), np.int64), len(langs), len(known))
            del numbers
            with_none = np.concatenate(([NONE], known))

            def path(i):
                return (int(langs[paths[0][i] - 1]), *[int(with_none[p[i]]) for p in paths[1:]])

            places = [bisect.bisect_left(range(len(counts)), x, key=path) for x in shared.value]
            of_range = np.searchsorted(np.array(places, np.int64), np.arange(len(counts)), "right")
            for r, blob in pieces(langs, known, build(paths, counts, of_range), common.value):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([blob], pa.binary())], ["range", "data"])

        for b in batches:
            langs = np.asarray(b.column(0))
            for first, end, data, offsets in text_slices(b.column(1)):
                found = frequent_paths(data, offsets, langs[first:end], bitmap.value, most_words)
                if len(found[0]):
                    held.append(found)
                    size += len(found[0])
                if size >= SHARD_PATHS:
                    yield from close()
        if held:
            yield from close()

    def sums(table: pa.Table) -> pa.Table:
        langs, known, paths, counts = unite((x.as_buffer() for x in table.column("data")), most_words + 1, common.value)
        out = [[], [], []]
        nodes = _layers(paths, counts)
        for depth in range(1, most_words + 1):
            first, _, weight, _ = nodes[depth]
            keep = weight >= least
            keep[:1] = keep[-1:] = True  # these may go on in the ranges beside this one
            at = first[keep]
            out[0].append(langs[paths[0][at] - 1])
            out[1].append(np.stack([known[p[at] - 1] for p in paths[1 : depth + 1]], axis=1).ravel() if len(at) else np.zeros(0, np.int64))
            out[2].append(weight[keep])
        sizes = np.repeat(np.arange(1, most_words + 1), [len(x) for x in out[0]])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(out[1])))
        return pa.table([pa.array(np.concatenate(out[0])), lists, pa.array(np.concatenate(out[2]))], names=["h0", "p", "f"])

    blobs = rows.mapInArrow(shards, "range int, data binary")
    partial = blobs.groupBy("range").applyInArrow(sums, "h0 long, p array<long>, f long")
    return partial.groupBy("h0", "p").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _key(lang: str, words: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a phrase of a language."""
    return [F.xxhash64(F.col(lang), words), F.xxhash64(F.lit(1), words, F.col(lang))]


def collocations(docs: DataFrame, most_words: int = 4, least: int = 30, top: int = 2000, scale: int = 2_000_000, inside_percent: int = 80,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The phrases of 2 to ``most_words`` words that hold together best, per language: lang, rank, phrase, a, l, r, n, score.

    ``a``, ``l`` and ``r`` count the phrase and its two parts at the cut with the lowest score (``scale * a / (l + r)``, floored;
    ties to the earliest cut), ``n`` all words of the language. Phrases under ``least`` do not count, nor do those inside of
    a longer one that has ``inside_percent`` percent of their occurrences. The ``top`` first of each language are returned by
    score, count and phrase.

    Null texts are empty and a null language is ``und``. Empty texts and empty tables give nothing; equal rows count each; a
    very long text is one of many in a shard; columns other than the two are not looked at, so their names cannot clash.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(F.xxhash64(lang).alias("h0"), F.col(text_col).cast("string").alias("text"))
    words = cut(count_words(rows, least), "words")
    phrases = cut(phrase_counts(rows, words, most_words, least).select(
        "h0", "p", "f", *[k.alias(n) for n, k in zip(("k1", "k2"), _key("h0", F.col("p")))]), "phrases")

    # Phrases inside of longer ones: the greatest count among the longer ones settles it.
    longer = phrases.where(F.size("p") > 2)
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for n in range(2, most_words) for i in range(1, most_words - n + 2)])
    inner = longer.select("h0", "p", "f", F.explode(spans).alias("s")).where("s.n < size(p) and s.i + s.n - 1 <= size(p)")
    inner = inner.select(*[k.alias(n) for n, k in zip(("k1", "k2"), _key("h0", F.expr("slice(p, s.i, s.n)")))], "f")
    inner = inner.groupBy("k1", "k2").agg(F.max("f").alias("longest"))
    open_ = phrases.where(F.size("p") > 1).join(inner, ["k1", "k2"], "left")
    open_ = open_.where(F.expr(f"longest is null or 100 * cast(longest as decimal(38,0)) < {inside_percent} * cast(f as decimal(38,0))"))

    # Composition with the counts: each cut of each phrase looks its two parts up.
    cuts = open_.select("h0", "p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    for name, part in (("l", "slice(p, 1, k)"), ("r", "slice(p, k + 1, size(p) - k)")):
        cuts = cuts.select("*", *[k.alias(n) for n, k in zip(("k1", "k2"), _key("h0", F.expr(part)))])
        cuts = cuts.join(phrases.select("k1", "k2", F.col("f").alias(name)), ["k1", "k2"]).drop("k1", "k2")
    score = F.expr(f"(cast({scale} as decimal(38,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.groupBy("h0", "p", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")).select("h0", "p", "a", "s.score", "s.l", "s.r")
    best = Window.partitionBy("h0").orderBy(F.col("score").desc(), F.col("a").desc())
    near = scored.withColumn("_rank", F.rank().over(best)).where(F.col("_rank") <= top).drop("_rank")

    # Only now are the words themselves needed.
    spelled = near.select("*", F.posexplode("p").alias("_i", "h")).join(words.where("h is not null").select("h0", "h", "word"), ["h0", "h"])
    spelled = spelled.groupBy("h0", "p", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("_i", "word"))).alias("w"))
    spelled = spelled.withColumn("phrase", F.array_join(F.col("w.word"), " "))
    order = Window.partitionBy("h0").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    sizes = words.groupBy("h0").agg(F.sum("n").alias("n"))
    langs = docs.select(lang.alias("lang")).distinct().select(F.xxhash64("lang").alias("h0"), "lang")
    return ranked.join(sizes, "h0").join(langs, "h0").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
