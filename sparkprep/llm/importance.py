"""Draw the documents that look most like a target, by importance weights with noise.

Features are runs of 1 and 2 words, hashed to buckets by the crc32 of their bytes. A bucket's gain is the logarithm of its
share in the target over its share in the documents, both smoothed; a document's weight is the mean gain of its features, and
its score adds Gumbel noise made from its id, so that taking the highest scores draws without replacement in proportion to
the weights.

Scores are written once, without texts. The cutoff comes from numeric bisection on that copy: each job counts exactly how
many rows reach each of ``POINTS`` thresholds, the interval shrinks to the step that holds the wanted count, and rows tied
at the last score are cut by their id in the same way. Only the drawn rows are then put in order, over all partitions.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.llm.words import lower_ascii, run_places, text_slices, word_hashes
from sparkprep.operators.ordering import number_rows
from sparkprep.session import cut

POINTS = 16
_LONG = 64  # bytes; the crc of a longer word is zlib's, one by one
_NO_ID = 2**63 - 1  # where a null id stands among ties


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def _shift_tables(most: int) -> np.ndarray:
    """[length, byte, value]: what ``length`` more bytes make of a crc's byte with that value (the map is linear)."""
    out = np.empty((most + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, most + 1):
        out[n] = _TABLE[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out


_SHIFT = _shift_tables(_LONG)


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each stretch of bytes, byte by byte for all stretches at once."""
    length = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.where(length > _LONG, 0, length), kind="stable")
    sizes = np.where(length > _LONG, 0, length)[order]
    state = crc[order]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -j, "left"))  # stretches longer than j come first
        state[:n] = _TABLE[(state[:n] ^ data[starts[order[:n]] + j]) & 255] ^ (state[:n] >> np.uint32(8))
    crc[order] = ~state
    for i in np.flatnonzero(length > _LONG):
        crc[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return crc


def _followed(crc: np.ndarray, then: np.ndarray, length: np.ndarray, data, starts, ends) -> np.ndarray:
    """The crc32 of stretches joined: ``crc`` of the first, ``then`` and ``length`` of the second."""
    n = np.minimum(length, _LONG)
    out = then.copy()
    for k in range(4):
        out ^= _SHIFT[n, k, (crc >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(length > _LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(crc[i]))
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int):
    """Buckets of the single words and of the word pairs of a run of texts, and the text of each: (b1, t1, b2, t2)."""
    data = lower_ascii(data)
    letter = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    starts, ends, of_text = run_places(letter, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(of_text))
    _, at, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    own = crc32_of(data, starts[at], ends[at])
    state = ~own  # the register of the crc; a blank follows
    spaced = ~(_TABLE[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8)))
    left = np.flatnonzero(text[1:] == text[:-1])
    right = left + 1
    pair = _followed(spaced[which[left]], own[which[right]], (ends - starts)[right], data, starts[right], ends[right])
    return (own[which] % np.uint32(buckets)).astype(np.int64), text, (pair % np.uint32(buckets)).astype(np.int64), text[left]


def bucket_counts(docs: DataFrame, buckets: int, text_col: str = "text") -> DataFrame:
    """(bucket, n) over all texts; each task sends its own sums, at most one row per bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offsets in text_slices(b.column(0)):
                one, _, two, _ = feature_buckets(data, offsets, buckets)
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """Of each bucket, a thousand times the log of its share in the target over its share in the documents, floored."""

    def counts(df):
        out = [0] * buckets
        for r in bucket_counts(df, buckets, text_col).collect():  # one row per bucket
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(docs), counts(target)
    raw, aim = sum(s), sum(t)
    found = [math.floor(1000 * math.log((t[i] + 1) * (raw + buckets) / ((s[i] + 1) * (aim + buckets)))) for i in range(buckets)]
    return np.array(found, np.int64)


def score_documents(docs: DataFrame, target: DataFrame, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(docs, target, buckets, text_col))  # one number per bucket

    def weigh(batches):
        for b in batches:
            columns = [[np.zeros(0, np.int64)] for _ in range(3)]
            for _, _, data, offsets in text_slices(b.column(1)):
                n = len(offsets) - 1
                one, of_one, two, of_two = feature_buckets(data, offsets, buckets)
                words = np.bincount(of_one, minlength=n)
                features = words + np.bincount(of_two, minlength=n)
                total = np.zeros(n, np.int64)
                np.add.at(total, of_one, gain.value[one])
                np.add.at(total, of_two, gain.value[two])
                for c, x in zip(columns, (words, features, np.where(features > 0, total // np.maximum(features, 1), 0))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(np.concatenate(c), pa.int64()) for c in columns]], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))


def _bisect(rows: DataFrame, value: Column, low: int, high: int, wanted: int) -> tuple[int, int]:
    """The greatest threshold that at least ``wanted`` rows reach, and how many rows lie above it.

    ``low`` is reached by ``wanted`` rows or more, ``high`` by fewer. Each round is one exact count of all rows at ``POINTS``
    thresholds between the two.
    """
    above = 0
    while high - low > 1:
        steps = sorted({low + (high - low) * i // (POINTS + 1) for i in range(1, POINTS + 1)} - {low})
        counted = rows.agg(*[F.count_if(value >= F.lit(x)).alias(f"n{i}") for i, x in enumerate(steps)]).first()
        for i, x in enumerate(steps):
            if counted[i] >= wanted:
                low = x
            else:
                high, above = x, counted[i]
                break
    return low, above


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = 10_000, seed: int = 7,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null for those not drawn.

    Of the documents with at least ``min_words`` words, ``percent`` percent (floored) with the highest scores are drawn, ties to
    the smaller id. Null and empty texts have no features, weight 0 and no rank (as long as ``min_words`` is above 0). A null
    id draws its noise from the empty text and stands behind all others among ties; rows of equal id and score (repeated rows)
    are told apart by nothing, so any of them take the ranks that are left. An empty table gives no rows, an empty target
    gives gains by the documents alone, and other columns are not looked at, so their names cannot clash.
    """
    scored = cut(score_documents(docs, target, buckets, seed, id_col, text_col), "scores")
    able, key = F.col("n_words") >= min_words, F.coalesce("doc_id", F.lit(_NO_ID))
    pool = scored.where(able)
    size, low, high = pool.agg(F.count("*"), F.min("score"), F.max("score")).first()
    wanted = size * percent // 100
    if not wanted:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    edge, above = _bisect(pool, F.col("score"), low, high + 1, wanted)
    tied = pool.where(F.col("score") == edge)
    first, last = tied.agg(F.min(key), F.max(key)).first()
    # Small ids come first, so the threshold runs over -1 - id, which falls as the id rises and fits in 64 bits.
    cutoff, _ = _bisect(tied, -1 - key, -1 - last, -first, wanted - above)
    inside = able & ((F.col("score") > edge) | ((F.col("score") == edge) & (-1 - key >= F.lit(cutoff))))
    ranked = number_rows(scored.where(inside), [F.col("score").desc(), key.asc()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))  # repeated rows beyond the last seat
    rest = scored.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
