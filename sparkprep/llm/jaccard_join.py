"""Jaccard join on word shingles: links between texts whose sets of shingles overlap by at least 3/4 (a parameter).

Equal sets are one class. Which classes can link: of two sets with Jaccard t, the first ``n - ceil(t n) + 1`` elements of
each, in any one order of all elements, share at least one. The order here puts rare shingles first: a table of ``SLOTS``
counters, summed over all texts, estimates how often each occurs, so that a passage which many texts share is looked at
last. Classes that share such an element form a group; groups are found in buckets of hashes that are packed as arrays.

A group first gives a few candidates per member, with the group's least class and three others (``CENTERS``). Candidates
are bounded by bitmaps: sizes must lie within the same band (ratio t), and elements that set a bit in one bitmap but not in
the other cannot be common, so bit counts bound the overlap from above. Bitmap lengths follow the size of the set; the longer
of two is folded. What remains is decided by intersecting the sorted arrays of hashes. Members that the exact links have
joined need no further look. Groups that still hold several components go into tiles by size, where the bitmaps of all
members of different components are compared, and the pairs that pass are decided exactly as before. Near copies meet in
many groups; a pair is given by the least of them, as far as the first ``LISTED`` groups of its two members tell. So no link
between components is lost, and groups of near copies cost as many pairs as members.

Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.graph import components
from sparkprep.llm.words import gram_hashes, lower_ascii, mix, text_slices, word_hashes, word_places
from sparkprep.session import cut

SHINGLE = 5
SLOTS = 1 << 18
_CHUNK = 1 << 13
_SLICE = 500_000  # bytes of text a worker looks at together: its arrays take some 25 times that
CENTERS = (0.0, 1.0, 1 / 3, 2 / 3)  # places among a group's classes, in the order of their keys
BUCKET = 1_000_000  # elements in a bucket, about
TILE = 1024
LISTED = 64  # open groups that a member carries; beyond these a pair may be given more than once


def shingle_sets(texts, shingle: int = SHINGLE):
    """For each slice of an Arrow array of texts: (first row, offsets, hashes), with each row's distinct hashes sorted."""
    for first, end, data, offsets in text_slices(texts, _SLICE):
        low = lower_ascii(data)
        starts, ends, of_text = word_places(low, offsets)
        words = word_hashes(low, starts, ends)
        grams = gram_hashes(words, shingle)
        text = np.searchsorted(of_text, np.arange(len(grams)), "right") - 1
        whole = np.arange(len(grams)) + shingle <= of_text[text + 1]
        grams, text = grams[whole], text[whole]
        # A text of fewer words is one shingle of all of them.
        sizes = np.diff(of_text)
        short = np.flatnonzero((sizes > 0) & (sizes < shingle))
        if len(short):
            own = [gram_hashes(words[of_text[i] : of_text[i + 1]], int(sizes[i]))[0] + np.uint64(sizes[i]) for i in short]
            grams, text = np.concatenate((grams, np.array(own, np.uint64))), np.concatenate((text, short))
        order = np.lexsort((grams, text))
        grams, text = grams[order], text[order]
        new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (text[1:] != text[:-1]))) if len(grams) else np.zeros(0, bool)
        grams, text = grams[new], text[new]
        yield first, np.searchsorted(text, np.arange(end - first + 1)), grams


def bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each hash, in a number of bits that is a power of two from 64 up: at least four times the number of hashes, from 1024
    bits on twice (long bitmaps are most of what is shuffled, and sets of that size differ in enough bits)."""
    n = len(hashes)
    bits = 1 << max(6, min((4 * n - 1).bit_length(), max(10, (2 * n - 1).bit_length())))
    marks = np.zeros(bits, np.uint8)
    marks[(hashes >> np.uint64(20)) & np.uint64(bits - 1)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def overlap_bound(n1: int, bits1: np.ndarray, n2: int, bits2: np.ndarray) -> int:
    """No less than the number of common elements."""
    size = min(len(bits1), len(bits2))
    a, b = fold(bits1, size), fold(bits2, size)
    return min(n1 - int(np.bitwise_count(a & ~b).sum()), n2 - int(np.bitwise_count(b & ~a).sum()))


def _enough(common, n1, n2, percent: int):
    return 100 * common >= percent * (n1 + n2 - common)


def _prefix(n, percent: int):
    return n - -(-percent * n // 100) + 1


def shingle_table(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, percent: int = 75) -> tuple[DataFrame, np.ndarray]:
    """(id, mark, n, key, bits) per row, written to the shared folder, and the table of counters.

    ``mark`` is a hash of id and text, ``key`` one of the set (null for no words).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        counts = np.zeros(SLOTS, np.uint64)
        names = ["id", "mark", "n", "key", "bits", "chunk"]
        for b in batches:
            for first, offsets, hashes in shingle_sets(b.column(2), shingle):
                m = len(offsets) - 1
                counts += np.bincount((hashes & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint64)
                sets = [hashes[offsets[i] : offsets[i + 1]] for i in range(m)]
                keys = [int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, m), b.column(1).slice(first, m), pa.array(np.diff(offsets)), pa.array(keys, pa.int64()),
                     pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(m, pa.int32())], names)
        if counts.any():
            chunks = counts.reshape(-1, _CHUNK)
            k = len(chunks)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                 pa.array([c.tobytes() for c in chunks], pa.binary()), pa.array(np.arange(k, dtype=np.int32))], names)

    both = cut(rows.mapInArrow(scan, "id long, mark long, n long, key long, bits binary, chunk int"), "shingles")

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, data in zip(b.column(0).to_pylist(), b.column(1)):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(data.as_buffer(), np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["chunk", "bits"])

    counters = np.zeros(SLOTS, np.uint64)
    parts = both.where("chunk is not null").select("chunk", "bits").repartition(SLOTS // _CHUNK, "chunk").mapInArrow(add, "chunk int, bits binary")
    for r in parts.collect():  # SLOTS counters in all
        counters[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] += np.frombuffer(r["bits"], np.uint64)
    return both.where("chunk is null").drop("chunk"), counters


def _stars(docs: DataFrame, text_col: str, counters: np.ndarray, total: int, shingle: int, percent: int) -> DataFrame:
    """(group, member, center, more, near): classes that share an element of their prefixes, each with the least class of the
    group, and with further centers where ``more``. ``near``: sizes and the element's places in both orders leave a link
    possible; pairs with further centers are given only then."""
    buckets = max(1, -(-total // BUCKET))
    shared = docs.sparkSession.sparkContext.broadcast(counters)  # SLOTS numbers

    def pack(batches):
        order_of = shared.value
        for b in batches:
            held, keys, whole, places, seen = [], [], [], [], set()
            for _, offsets, hashes in shingle_sets(b.column(0), shingle):
                rare = order_of[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
                for i in range(len(offsets) - 1):
                    own = hashes[offsets[i] : offsets[i + 1]]
                    if not len(own):
                        continue
                    key = int.from_bytes(xxhash.xxh3_64_digest(own.tobytes()), "little", signed=True)
                    if key in seen:
                        continue
                    seen.add(key)
                    take = np.lexsort((own, rare[offsets[i] : offsets[i + 1]]))[: _prefix(len(own), percent)]
                    keys.append(key)
                    whole.append(len(own))
                    held.append(own[take])
                    places.append(np.minimum(np.arange(len(take)) * 1000 // len(own), 255).astype(np.uint8))
            if not keys:
                continue
            sizes = [len(h) for h in held]
            all_ = mix(np.concatenate(held) + np.uint64(0x5851F42D4C957F2D))
            who = np.repeat(np.arange(len(keys), dtype=np.uint32), sizes)
            bucket = ((all_ >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            names, whole, places = np.array(keys, np.int64), np.array(whole, np.int32), np.concatenate(places)
            out = ([], [], [], [], [], [])
            for k in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[k] : cuts[k + 1]]
                some, local = np.unique(who[at], return_inverse=True)
                for column, x in zip(out, (k, (all_[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), local.astype(np.uint32 if len(some) > 65_535 else np.uint16).tobytes(), names[some].tobytes(), whole[some].tobytes(), places[at].tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), *[pa.array(x, pa.binary()) for x in out[1:]]], ["bucket", "hashes", "local", "keys", "sizes", "places"])

    def stars(batches):
        bucket, held = None, []
        for b in batches:
            for row in zip(b.column(0).to_pylist(), *[b.column(c) for c in range(1, 6)]):
                if row[0] != bucket:
                    if held:
                        yield from _group(bucket, held, percent)
                    bucket, held = row[0], []
                hashes = np.frombuffer(row[1].as_buffer(), np.uint32)
                keys = np.frombuffer(row[3].as_buffer(), np.int64)
                local = np.frombuffer(row[2].as_buffer(), np.uint32 if len(keys) > 65_535 else np.uint16)
                held.append((hashes, keys[local], np.frombuffer(row[4].as_buffer(), np.int32)[local], np.frombuffer(row[5].as_buffer(), np.uint8)))
        if held:
            yield from _group(bucket, held, percent)

    packed = docs.select(F.col(text_col).cast("string")).mapInArrow(pack, "bucket long, hashes binary, local binary, keys binary, sizes binary, places binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(stars, "group long, member long, center long, more boolean, near boolean")


def _group(bucket: int, held, percent: int):
    """The stars of a bucket. ``held``: for each batch its hashes, the places, and of each element's class the key and the size."""
    hashes, keys, n, place = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.lexsort((keys, hashes))
    hashes, keys = hashes[order], keys[order]
    # Copies in other batches have the same key; each class is a member once.
    once = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])))
    order = order[once]
    hashes, keys, n, place = hashes[once], keys[once], n[order], place[order]
    del order, once
    starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    ends = np.append(starts[1:], len(hashes))
    first = 0
    while first < len(starts):  # whole groups, some 100,000 members at a time
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + 100_000, "right")))
        low, high = starts[first], ends[last - 1]
        begins, sizes = starts[first:last] - low, ends[first:last] - starts[first:last]
        yield from _group_stars(bucket, hashes[low:high], keys[low:high], n[low:high], place[low:high].astype(np.int64), np.repeat(begins, sizes), np.repeat(sizes, sizes), percent)
        first = last


def _group_stars(bucket: int, hashes, keys, n, place, begin, size, percent: int):
    # Elements of a set before and behind this one, at most: the place is known to a thousandth of the set.
    n = n.astype(np.int64)
    before = np.where(place == 255, n - 1, ((place + 1) * n - 1) // 1000)
    behind = n - 1 - -(-place * n // 1000)
    for k, share in enumerate(CENTERS):
        at = begin + ((size - 1) * share).astype(np.int64)
        center = keys[at]
        # Both sets are in one order, so what they share lies before this element in both, or behind it in both.
        near = _enough(np.minimum(before, before[at]) + 1 + np.minimum(behind, behind[at]), n, n[at], percent)
        near &= 100 * np.minimum(n, n[at]) >= percent * np.maximum(n, n[at])
        mine = (keys != center) & ((size > 2) & (keys != keys[begin]) & near if k else size > 1)
        group = (np.int64(bucket) << np.int64(32)) | hashes[mine].astype(np.int64)
        if len(group):
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), pa.array(keys[mine]), pa.array(center[mine]), pa.array(np.full(len(group), k > 0)), pa.array(near[mine])],
                ["group", "member", "center", "more", "near"])


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps leave possible."""
    one, two = (classes.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")

    def look(batches):
        for batch in batches:
            keep = []
            for n1, b1, n2, b2 in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5)):
                bound = overlap_bound(n1, np.frombuffer(b1.as_buffer(), np.uint8), n2, np.frombuffer(b2.as_buffer(), np.uint8))
                keep.append(_enough(bound, n1, n2, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.join(one, "a").join(two, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return sized.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(look, "a long, b long")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sorted arrays overlap enough. A center's array meets its partners' one by one."""
    one, two = (sets.select(F.col("key").alias(k), F.col("hashes").alias(f"set_{k}")) for k in "ab")

    def intersect(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((u, v))
                both.sort(kind="stable")
                keep.append(_enough(int((both[1:] == both[:-1]).sum()), len(u), len(v), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(intersect, "a long, b long")


def _sets_of(pairs: DataFrame, docs: DataFrame, table: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(key, hashes) of the classes in ``pairs``, from one row of each class."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    first = table.join(keys, "key", "left_semi").groupBy("key").agg(F.min("mark").alias("mark")).select("mark").distinct()
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))

    def sets(batches):
        for b in batches:
            for _, offsets, hashes in shingle_sets(b.column(0), shingle):
                own = [hashes[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(offsets) - 1)]
                keys_ = [int.from_bytes(xxhash.xxh3_64_digest(s), "little", signed=True) for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(keys_, pa.int64()), pa.array(own, pa.binary())], ["key", "hashes"])

    return cut(rows.join(first, "mark", "left_semi").select("text").mapInArrow(sets, "key long, hashes binary"), "sets")


def _across(members: DataFrame, percent: int, tile: int) -> DataFrame:
    """Pairs (a, b) of one group and different components that sizes and bitmaps leave possible, by tiles of like size.

    ``listed`` has the least groups of each member, in which a pair that meets there again is left to the first.
    """

    def tiles(batches):
        group, held = None, []
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in range(4)], b.column(4), b.column(5).to_pylist()):
                if row[0] != group:
                    yield from _tile_pairs(held, percent, tile)
                    group, held = row[0], []
                held.append(row)
        yield from _tile_pairs(held, percent, tile)

    return members.repartition("group").sortWithinPartitions("group", "n", "key") \
        .select("group", "key", "n", "component", "bits", "listed").mapInArrow(tiles, "a long, b long").distinct()


def _tile_pairs(rows: list, percent: int, tile: int):
    if len({r[3] for r in rows}) < 2:
        return
    key, n, comp = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
    bits = [np.frombuffer(r[4].as_buffer(), np.uint8) for r in rows]
    earlier = [frozenset(g for g in r[5] if g < r[0]) for r in rows]
    for first in range(0, len(rows), tile):
        last = min(first + tile, len(rows))
        # Rows are ordered by size: a tile meets the tiles above it whose sizes are still in its band.
        for low in range(first, len(rows), tile):
            if percent * n[low] > 100 * n[last - 1]:
                break
            high = min(low + tile, len(rows))
            size = min(len(x) for x in bits[first:last] + bits[low:high])
            one = np.array([fold(x, size) for x in bits[first:last]])
            two = one if low == first else np.array([fold(x, size) for x in bits[low:high]])
            a_out, b_out = [], []
            for i in range(first, last):
                j = np.arange(max(low, i + 1), high)
                j = j[(comp[j] != comp[i]) & (percent * n[j] <= 100 * n[i])]
                if len(j):
                    x, y = one[i - first], two[j - low]
                    bound = np.minimum(n[i] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n[j] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
                    j = j[_enough(bound, n[i], n[j], percent)]
                    j = j[[earlier[i].isdisjoint(earlier[x]) for x in j.tolist()]] if earlier[i] else j
                    a_out.append(np.full(len(j), key[i]))
                    b_out.append(key[j])
            if a_out:
                a, b = np.concatenate(a_out), np.concatenate(b_out)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = SHINGLE,
                    tile: int = TILE) -> DataFrame:
    """(id, mark, n, key, component) for each row of ``docs``: rows linked directly or through others share a component.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a set holds the distinct runs of ``shingle`` words, or all words
    as one where there are fewer. Null and empty texts, and texts of white space, have no set and a null component: they
    link with nothing. Equal sets link. Rows need no unique ids: ``mark`` is a hash of id and text. Other columns are not
    looked at.
    """
    table, counters = shingle_table(docs, id_col, text_col, shingle, percent)
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    classes = cut(table.where("key is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    total = classes.agg(F.sum(prefix)).first()[0] or 0
    stars = cut(_stars(docs, text_col, counters, total, shingle, percent), "stars")

    def decide(candidates: DataFrame) -> DataFrame:
        possible = cut(_bounded(candidates, classes, percent), "possible")
        return cut(_exact(possible, _sets_of(possible, docs, table, id_col, text_col, shingle), percent), "links")

    tested = stars.where("near").select(F.greatest("member", "center").alias("a"), F.least("member", "center").alias("b")).distinct()
    links = decide(tested)
    group = cut(components(links, "near"), "near")

    # Groups of three classes or more, with members in different components: their other pairs are still to be looked at.
    comp = lambda of: group.select(F.col("node").alias(of), F.col("component").alias(f"c_{of}"))
    known = stars.where("not more").join(comp("member"), "member", "left").join(comp("center"), "center", "left")
    known = known.select("group", "member", "center", F.coalesce("c_member", "member").alias("c_member"), F.coalesce("c_center", "center").alias("c_center"))
    open_ = known.groupBy("group").agg(F.count("*").alias("c"), F.max((F.col("c_member") != F.col("c_center")).cast("int")).alias("split")).where("c > 1 and split = 1")
    known = cut(known.join(open_.select("group"), "group", "left_semi"), "open")
    members = known.select("group", F.col("member").alias("key"), F.col("c_member").alias("component")).unionByName(
        known.groupBy("group").agg(F.first("center").alias("key"), F.first("c_center").alias("component")))
    listed = members.groupBy("key").agg(F.slice(F.sort_array(F.collect_list("group")), 1, LISTED).alias("listed"))
    pairs = cut(_across(members.join(classes, "key").join(listed, "key"), percent, tile), "across")
    pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"), "rest")
    if not pairs.isEmpty():
        more = decide(pairs)
        group = cut(components(links.unionByName(more), "all"), "all")
    return table.join(group.withColumnRenamed("node", "key"), "key", "left").select("id", "mark", "n", "key", F.coalesce("component", "key").alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` and ``component_id``, the smallest id of its component."""
    rows = jaccard_classes(docs, id_col, text_col, percent, shingle)
    least = rows.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    return rows.join(least, "component", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (nulls last), then the smallest hash of id and text.

    Rows without words all stay, but equal ones are the same row twice and stay twice.
    """
    rows = jaccard_classes(docs, id_col, text_col, percent, shingle)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("mark").alias("mark"))
    first = rows.where("component is not null").groupBy("component").agg(F.min(order).alias("o")).select(F.col("o.mark").alias("_mark")).distinct()
    empty = ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_mark"), empty.alias("empty"))
    # Equal rows have one mark; the mark's partition keeps one of them.
    kept = named.where("not empty").join(first, "_mark", "left_semi").dropDuplicates(["_mark"])
    return kept.select("row.*").unionByName(named.where("empty").select("row.*"))


def brute_force_links(texts: list[str | None], percent: int = 75, shingle: int = SHINGLE, words: Callable | None = None) -> list[tuple[int, int]]:
    """All links by comparing all pairs, for tests on small lists."""
    split = words or (lambda t: (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split())
    sets = []
    for t in texts:
        w = split(t)
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
