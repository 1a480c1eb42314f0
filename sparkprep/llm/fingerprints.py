"""Document fingerprints that keep edit distance: a random walk over the characters, sampled, and banded.

The walk reads the character at its place, writes it down, and steps on or stays by a shared random bit that depends on
the number of the step and the character. After an edit two walks drift back together, so a small edit distance becomes a
small Hamming distance between what is written (Chakraborty, Goldenberg and Koucky's embedding). The walk takes
``2 n + 8 sqrt(n) + 16`` steps, enough to reach the end of a text of n characters.

The fingerprint samples ``SLOTS`` places of the output. Slot k takes the place below the output's length with the least
value of a random order of its own, so that outputs of near lengths are sampled at the same places, and keeps one byte of a
hash of the place and the four characters written there. Likeness is the share of equal slots.

``near_groups`` finds the alike texts of a table. Its bands are chosen so that any two alike fingerprints share one; the classes
of a bucket are compared tile by tile, and a link is decided by the whole walks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.graph import components
from sparkprep.llm.words import mix
from sparkprep.session import cut

SLOTS = 128
GRAM = 4
TILE = 512  # classes of a tile
_TILE_CHARS = 8_000_000  # most characters of a tile's texts
_JOBS_IN_TASK = 8
_WIDE = 4096  # texts walked side by side
_FEW = 24  # so many walks or fewer go on one by one, where arrays across walks would be too short
_CELLS = 24_000_000  # most steps written down at once
_STRETCH = 1 << 18  # places whose order is looked at in one go


def _steps(length: np.ndarray) -> np.ndarray:
    return (2 * length + 8 * np.sqrt(length) + 16).astype(np.int64)


def _coins() -> np.ndarray:
    """Random bits by step (modulo 4096) and low byte of the character's hash."""
    return np.random.default_rng(7).integers(0, 2, (4096, 256)).astype(np.int8) * (np.arange(256) != 255).astype(np.int8)


_kept: dict[int, list[np.ndarray]] = {}  # of this worker: the records for its longest texts so far


def _records(limit: int) -> list[np.ndarray]:
    """For each slot, the places at which its order falls to a new least value, up to ``limit`` or further."""
    limit = -(-(limit + 1) // _STRETCH) * _STRETCH
    if _kept and max(_kept) >= limit:
        return _kept[max(_kept)]
    begin, known = (max(_kept), _kept[max(_kept)]) if _kept else (0, [np.zeros(0, np.int64)] * SLOTS)
    out = []
    for k in range(SLOTS):
        found, order = [known[k]], np.uint64((k + 1) << 40)
        least = mix(known[k][-1:].astype(np.uint64) + order)[0] if len(known[k]) else np.uint64(2**64 - 1)
        for first in range(begin, limit, _STRETCH):
            value = mix(np.arange(first, min(first + _STRETCH, limit), dtype=np.uint64) + order)
            low = np.flatnonzero(value < least)  # few, and among them the records
            if len(low):
                value = value[low]
                lows = np.minimum.accumulate(value)
                found.append(first + low[np.concatenate(([True], lows[1:] < lows[:-1]))])
                least = lows[-1]
        out.append(np.concatenate(found))
    _kept.clear()
    _kept[limit] = out
    return out


def _bytes(text: str) -> np.ndarray:
    """One byte per character: even numbers for characters; 255 is left for the end mark, where no coin moves on."""
    parts = [text[i : i + 1_000_000].encode("utf-32-le", "surrogatepass") for i in range(0, max(len(text), 1), 1_000_000)]
    return np.concatenate([mix(np.frombuffer(p, "<u4").astype(np.uint64)).astype(np.uint8) & np.uint8(254) for p in parts])


def _alone(characters: bytes, place: int, begin: int, stop: int, coins: list[bytes]) -> np.ndarray:
    """What one walk writes from step ``begin`` to ``stop``; ``characters`` end with their end mark."""
    out, last = bytearray(b"\xff") * (stop - begin), len(characters) - 1
    for j in range(begin, stop):
        if place == last:
            break
        c = characters[place]
        out[j - begin] = c
        place += coins[j & 4095][c]
    return np.frombuffer(out, np.uint8)


def _walked(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their numbers of steps, what is written: a column per row) for groups of texts walked side by side."""
    low = [_bytes(t) for t in texts]
    length = np.array([len(x) for x in low], np.int64)
    coins, steps_of = _coins(), _steps(length)
    order = np.argsort(-length, kind="stable")
    at, plain = 0, None
    while at < len(order):
        end, most = at + 1, int(steps_of[order[at]])
        end = min(len(order), at + max(1, min(_WIDE, _CELLS // most)))
        rows, at = order[at:end], end
        flat = np.concatenate([np.append(low[r], np.uint8(255)) for r in rows])
        steps = steps_of[rows]
        place = np.cumsum(length[rows] + 1) - 1 - length[rows]
        # Beyond a walk's own last step stands its end mark, as if it had gone on.
        written = np.full((most + GRAM, len(rows)), 255, np.uint8)
        step = np.zeros(len(rows), np.int8)
        # The longest come first; between two lengths the walks that go on are the first so many.
        stops = np.unique(steps)
        j = 0
        for stop in stops:
            n = int(np.searchsorted(-steps, -stop, "right"))
            if n <= _FEW:
                plain = plain or [row.tobytes() for row in coins]
                for i in range(n):
                    begin = int(np.sum(length[rows[:i]] + 1))
                    own = flat[begin : begin + int(length[rows[i]]) + 1].tobytes()
                    written[j : steps[i], i] = _alone(own, int(place[i]) - begin, j, int(steps[i]), plain)
                break
            place, step = place[:n], step[:n]
            for j in range(j, int(stop)):  # noqa: B020
                c = written[j, :n]
                flat.take(place, out=c, mode="clip")
                coins[j & 4095].take(c, out=step, mode="clip")
                place += step
            j = int(stop)
        yield rows, steps, written


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of ``SLOTS`` bytes per text."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    if not len(texts):
        return out
    records = _records(int(_steps(np.array([max(map(len, texts))]))[0]))
    for rows, steps, written in _walked(texts):
        for k in range(SLOTS):
            spot = records[k][np.searchsorted(records[k], steps, "left") - 1]
            value = spot.astype(np.uint64)
            for g in range(GRAM):
                value = value * np.uint64(257) + written[spot + g, np.arange(len(rows))]
            out[rows, k] = (mix(value + np.uint64(k << 48)) >> np.uint64(56)).astype(np.uint8)
    return out


def walks(texts: list[str]) -> list[np.ndarray]:
    """The whole output of each text's walk, with ``GRAM`` end marks after it."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
    for rows, steps, written in _walked(texts):
        for i, (r, n) in enumerate(zip(rows, steps)):
            out[r] = written[: n + GRAM, i].copy()
    return out


def whole_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness without samples: the share of the longer walk's places at which both have the same ``GRAM`` characters."""
    n = min(len(a), len(b)) - GRAM
    same = a[: n + GRAM - 1] == b[: n + GRAM - 1]
    grams = same[:n].copy()
    for g in range(1, GRAM):
        grams &= same[g : n + g]
    return float(grams.sum() / (max(len(a), len(b)) - GRAM))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def bands(least: float) -> list[list[int]]:
    """Sets of four or more slots: two fingerprints with a likeness of ``least`` or more agree in the whole of at least one.

    With up to 31 unequal slots there is one more set than those, and no slot is in two. With more, slots are dealt to
    groups, and all fours within a group are sets: to break each of them takes all but three slots of every group.
    """
    if not 0.5 <= least <= 1:
        raise ValueError("least must be between 0.5 and 1")
    unequal = SLOTS - math.ceil(least * SLOTS - 1e-9)
    slots = np.random.default_rng(11).permutation(SLOTS)
    if (unequal + 1) * 4 <= SLOTS:
        return [sorted(map(int, x)) for x in np.array_split(slots, unequal + 1)]
    groups = (SLOTS - 1 - unequal) // 3
    return [sorted(map(int, four)) for x in np.array_split(slots[: unequal + 1 + 3 * groups], groups) for four in combinations(x, 4)]


def band_keys(marks: np.ndarray, sets: list[list[int]]) -> np.ndarray:
    """A key per fingerprint and set of slots."""
    out = np.zeros((len(marks), len(sets)), np.uint64)
    for k, slots in enumerate(sets):
        for s in slots:
            out[:, k] = mix(out[:, k] + marks[:, s] + np.uint64(k << 8))
    return out


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75) -> DataFrame:
    """The representative links of ``near_groups``."""
    return near_groups(docs, id_col, text_col, least)[0]


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Representative links (id, other, likeness, text_likeness), and (id, copy_of, group_id) for each row of ``docs``.

    Equal texts are one class under their smallest id (``copy_of``). Two classes are linked if their fingerprints and their
    whole walks are both alike in ``least`` or more; ``group_id`` is the smallest id that links reach. Any two alike
    fingerprints share a band. First each class meets the first one of its buckets; then, in buckets with classes that are
    not in one group yet, all pairs of these are compared, tile against tile. Links that join what is joined already are
    not given, so the links are a part of all pairs, and the groups are those of all pairs. Null texts count as empty.
    """
    sets = bands(least)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.sha2("text", 256).alias("key"), "text")

    def mark(batches):
        for b in batches:
            for part in _parts(b, 2):
                marks = fingerprints(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([m.tobytes() for m in marks], pa.binary()), pa.array(band_keys(marks, sets).view(np.int64).tolist(), pa.list_(pa.int64()))],
                    ["key", "id", "text", "mark", "bands"])

    classes = rows.groupBy("key").agg(F.min("id").alias("id"), F.first("text").alias("text")).mapInArrow(
        mark, "key string, id long, text string, mark binary, bands array<long>")
    classes = cut(classes.select(F.xxhash64("key").alias("node"), F.length("text").cast("long").alias("chars"), "*"), "classes")
    texts = classes.select("node", "text")
    banded = classes.select("node", "chars", "mark", F.posexplode("bands").alias("k", "band"))

    # Stars: one pair per class and bucket.
    first = banded.groupBy("k", "band").agg(F.min(F.struct("node", "mark")).alias("f"), F.count("*").alias("n")).where("n > 1")
    stars = banded.join(first.select("k", "band", F.col("f.node").alias("other"), F.col("f.mark").alias("theirs")), ["k", "band"])
    stars = stars.where("node <> other").select("node", "other", "mark", "theirs").distinct()

    def alike(batches):
        for b in batches:
            same = likeness(*(np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (2, 3)))
            rows = pa.array(np.flatnonzero(same >= least))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(same).take(rows)], ["a", "b", "likeness"])

    def settle(batches):
        for b in batches:
            for part in _parts(b, 3, 4_000_000):
                ours, theirs = part.column(3).to_pylist(), part.column(4).to_pylist()
                distinct = list(dict.fromkeys(ours + theirs))
                walk = dict(zip(distinct, walks(distinct)))
                whole = np.array([whole_likeness(walk[x], walk[y]) for x, y in zip(ours, theirs)])
                rows = pa.array(np.flatnonzero(whole >= least))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(rows) for i in range(3)), pa.array(whole, pa.float64()).take(rows)], ["a", "b", "likeness", "text_likeness"])

    linked = "a long, b long, likeness double, text_likeness double"
    stars = stars.mapInArrow(alike, "a long, b long, likeness double")
    stars = stars.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "likeness", "x", "y")
    stars = cut(stars.mapInArrow(settle, linked), "stars")

    # Tiles: of the classes in buckets that hold several groups.
    group = components(stars.select("a", "b"), "stars")
    banded = banded.join(group, "node", "left").select("k", "band", F.coalesce("component", "node").alias("group"), "node", "chars", "mark")
    mixed = banded.groupBy("k", "band").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("k", "band")
    order = ["k", "band", "group", "node"]

    def lay(batches):
        part, number, held, chars = TaskContext.get().partitionId() << 32, 0, [], 0

        def close():
            nonlocal number
            number += 1
            groups = [r[2] for r in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([part + number]), pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]]), pa.array([min(groups)]), pa.array([max(groups)]),
                 pa.array([groups], pa.list_(pa.int64())), pa.array([[r[3] for r in held]], pa.list_(pa.int64())), pa.array([b"".join(r[5] for r in held)])],
                ["tile", "k", "band", "low", "high", "groups", "nodes", "marks"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (len(held) == tile or chars + row[4] > _TILE_CHARS or held[0][:2] != row[:2]):
                    yield close()
                    held, chars = [], 0
                held.append(row)
                chars += row[4]
        if held:
            yield close()

    tiles = cut(banded.join(mixed, ["k", "band"]).select(*order, "chars", "mark").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lay, "tile long, k int, band long, low long, high long, groups array<long>, nodes array<long>, marks binary"), "tiles")
    meta = tiles.select("tile", "k", "band", "low", "high")
    jobs = meta.join(meta.select(F.col("tile").alias("other"), "k", "band", F.col("low").alias("low2"), F.col("high").alias("high2")), ["k", "band"])
    jobs = cut(jobs.where("tile <= other and least(low, low2) <> greatest(high, high2)").select("tile", "other", "k"), "jobs")
    data = F.struct("groups", "nodes", "marks")
    jobs = jobs.join(tiles.select("tile", data.alias("x")), "tile").join(tiles.select(F.col("tile").alias("other"), data.alias("y")), "other")
    jobs = jobs.select("tile", "other", "k", "x", "y").repartition(max(1, -(-jobs.count() // _JOBS_IN_TASK)))

    def compare(batches):
        read = lambda s: (s["groups"].values.to_numpy(), s["nodes"].values.to_numpy(), np.frombuffer(s["marks"].as_buffer(), np.uint8).reshape(-1, SLOTS))
        for b in batches:
            for r in range(b.num_rows):
                one, two, k = (b.column(c)[r].as_py() for c in range(3))
                (gx, nx, mx), (gy, ny, my) = read(b.column(3)[r]), read(b.column(4)[r])
                found = []
                for i in range(len(nx)):
                    equal = mx[i] == my
                    share = equal.mean(axis=1)
                    j = np.flatnonzero((share >= least) & (gy != gx[i]) & ((np.arange(len(ny)) > i) | (one != two)))
                    # A pair belongs to the first band that it shares.
                    for q in sets[:k] if len(j) else ():
                        j = j[~equal[j][:, q].all(axis=1)]
                    found.append((np.full(len(j), nx[i]), np.full(len(j), gx[i]), ny[j], gy[j], share[j]))
                a, ga, c, gc, share = (np.concatenate(x) for x in zip(*found))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array([one]), pa.array([two]), *(pa.array([x]) for x in (a, ga, c, gc, share))], ["tile", "other", "a", "ga", "b", "gb", "likeness"])

    asked = cut(jobs.mapInArrow(compare, "tile long, other long, a array<long>, ga array<long>, b array<long>, gb array<long>, likeness array<double>"), "asked")
    needed = asked.select("tile", "other", F.explode(F.array_union("a", "b")).alias("node")).join(texts, "node")
    needed = needed.groupBy("tile", "other").agg(F.collect_list("node").alias("nodes"), F.collect_list("text").alias("texts"))

    def decide(batches):
        for b in batches:
            for r in range(b.num_rows):
                a, ga, c, gc, share, nodes, written = (b.column(x)[r].as_py() for x in range(7))
                walk, up, out = dict(zip(nodes, walks(written))), {}, []

                def top(g):
                    while up.get(g, g) != g:  # noqa: B023
                        g = up[g]  # noqa: B023
                    return g

                for x, gx, y, gy, s in zip(a, ga, c, gc, share):
                    gx, gy = sorted((top(gx), top(gy)))
                    if gx != gy and (whole := whole_likeness(walk[x], walk[y])) >= least:
                        up[gy] = gx
                        out.append((x, y, s, whole))
                columns = zip(*out) if out else ([], [], [], [])
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["a", "b", "likeness", "text_likeness"])

    more = asked.join(needed, ["tile", "other"]).select("a", "ga", "b", "gb", "likeness", "nodes", "texts").mapInArrow(decide, linked)
    links = cut(stars.unionByName(more), "links")
    known = classes.select("node", "key", "id").join(components(links.select("a", "b"), "links"), "node", "left")
    known = known.select("key", "id", F.coalesce("component", "node").alias("group"))
    known = known.join(known.groupBy("group").agg(F.min("id").alias("group_id")), "group").select("key", F.col("id").alias("copy_of"), "group_id")
    members = rows.select("id", "key").join(known, "key").select("id", "copy_of", "group_id")
    ids = classes.select("node", "id")
    links = links.join(ids.toDF("a", "x"), "a").join(ids.toDF("b", "y"), "b")
    swap = F.coalesce(F.col("x") < F.col("y"), F.lit(False))
    return links.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("id"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("other"), "likeness", "text_likeness"), members


def _parts(batch: pa.RecordBatch, column: int, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text."""
    sizes = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()])
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, "right")))
        yield batch.slice(first, end - first)
        first = end


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text, or by all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how alike these and the next document's are.

    Documents are ordered by descending id, after the last comes the first. Null ids
    come last; equal ids are ordered by a hash of their text. Null texts count as empty. One document is its own next.
    Ranges of ids are sorted side by side; each gets a guest, the first document of the next range, so no range waits
    for another and nothing is sorted in one task.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.coalesce("id", F.lit(-(2**63))).alias("at"), F.xxhash64("text").alias("tie"))
    bounds = sorted(set(rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    bucket = F.lit(0)
    if bounds:
        edges = F.array(*[F.lit(b) for b in bounds])
        bucket = F.size(F.filter(edges, lambda e: e < F.col("at")))
    rows = rows.withColumn("bucket", bucket)
    place = F.struct("at", "tie", "text")
    firsts = rows.groupBy("bucket").agg(F.max(place).alias("p"))
    known = sorted((r[0] for r in firsts.select("bucket").collect()), reverse=True)  # at most as many as parts
    after = dict(zip(known, known[1:] + known[:1]))
    if not known:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = {v: k for k, v in after.items()}
    host = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("bucket")]
    guests = firsts.select(F.lit(None).cast("long").alias("id"), F.col("p.text").alias("text"), F.lit(None).cast("long").alias("at"),
                           F.lit(None).cast("long").alias("tie"), host.alias("bucket"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition(parts, "bucket") \
        .sortWithinPartitions("bucket", "guest", F.desc("at"), F.desc("tie"), F.desc("text")).select("id", "text", "bucket", "guest")

    def walk(batches):
        held = None  # the last row, which waits for the next one
        for b in batches:
            for part in _parts(b, 1):
                texts, ids = part.column(1).to_pylist(), part.column(0).to_pylist()
                guest, marks = part.column(3).to_pylist(), fingerprints(texts)
                if held:
                    texts, ids, guest = [held[0], *texts], [held[1], *ids], [held[2], *guest]
                    marks = np.concatenate((held[3][None], marks))
                mine = [i for i in range(len(texts) - 1) if not guest[i]]
                edited = [edited_text(texts[i], texts[i + 1]) for i in mine]
                theirs = fingerprints(edited)
                own, following = marks[mine], marks[[i + 1 for i in mine]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in mine], pa.int64()), pa.array([len(texts[i]) for i in mine], pa.int64()), pa.array(edited, pa.string()),
                     pa.array([m.tobytes().hex() for m in own], pa.string()), pa.array([m.tobytes().hex() for m in theirs], pa.string()),
                     pa.array(likeness(own, theirs) if mine else [], pa.float64()), pa.array(likeness(own, following) if mine else [], pa.float64())],
                    ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                held = (texts[-1], ids[-1], guest[-1], marks[-1])

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(walk, schema)
