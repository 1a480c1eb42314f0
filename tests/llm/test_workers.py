"""What one Python worker holds, and what it asks of the library."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark import cloudpickle
from tokenizers import Tokenizer

from sparkprep.llm import jaccard_join, token_files, toxicity, words
from sparkprep.llm.sentencepiece_unigram import encode_texts, load_vocabulary


def _batch(megabytes):
    """Texts of some 2,000 bytes over a few thousand words, as one Arrow batch of rows."""
    rng = np.random.default_rng(5)
    known = np.array(["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(3_000)])
    texts = [" ".join(known[rng.integers(0, len(known), 330)]) for _ in range(500 * megabytes)]
    return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([pa.array(texts)], ["text"])], ["row"])


@pytest.mark.parametrize("stage", ["toxicity", "tokens"])
def test_arrays_of_a_worker(spark, monkeypatch, stage):
    """A worker's arrays are those of a slice of half a million bytes, whatever the size of the batch."""
    docs, taken = spark.createDataFrame([("a",)], "text string"), []
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", lambda self, function, schema: taken.append(function))
        if stage == "toxicity":
            terms = np.sort(np.random.default_rng(1).integers(0, 2**63, 2_000).astype(np.uint64))
            toxicity.score_toxicity(docs, toxicity.Toxicity(terms, np.ones(2_000, np.int64), np.zeros(2_004), 0.0))
        else:
            encode_texts(docs, load_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    words._powers(words.SLICE_BYTES)  # held by every worker
    batch = _batch(4)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in taken[0]([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == batch.num_rows
    assert peak < 60e6, peak


def _traced(work):
    words._powers(words.SLICE_BYTES)  # held by every worker
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_arrays_of_shingles():
    """The sets of op10 are made slice by slice, whatever the size of the batch; slices do not change them."""
    texts = _batch(4).column(0).field(0)
    n, peak = _traced(lambda: sum(len(offsets) - 1 for _, offsets, _ in jaccard_join.shingle_sets(texts)))
    assert n == len(texts)
    assert peak < 25e6, peak
    firsts, sets = zip(*((first, [h[a:b].tolist() for a, b in zip(o, o[1:])]) for first, o, h in jaccard_join.shingle_sets(texts)))
    assert len(firsts) > 4 and list(firsts) == np.cumsum([0, *map(len, sets)])[:-1].tolist()
    alone = [next(iter(jaccard_join.shingle_sets(texts.slice(i, 1))))[2].tolist() for i in range(0, len(texts), 97)]
    assert [x for s in sets for x in s][::97] == alone


def _described():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def _coded(held, texts):
    for first, _, data, offsets in words.text_slices(pa.array(texts)):
        data, starts, ends, of_text, plain = held.cut(data, offsets)
        ids, sizes = held.slice_ids(data, starts, ends, plain)
        cuts = np.concatenate(([0], np.cumsum(sizes)))[of_text]
        yield from (ids[a:b].tolist() for a, b in zip(cuts, cuts[1:]))


def test_words_with_signs_are_encoded_once():
    """Signs, digits and capitals beside a word ask nothing new of the library."""
    held, asked = token_files.WordIds(_described()), []
    for name in ("encode", "encode_plain"):
        monkey = getattr(held, name)
        setattr(held, name, lambda pieces, f=monkey: (asked.extend(pieces.split()), f(pieces))[1])
    texts = [f"{w}{s}" for w in ("stühle", "Stühle", "ÄRGERT", "thhetiin") for s in (",", ".", "!", "7", "12", "-weg", "")]
    got = list(_coded(held, texts))
    assert len(asked) == len(set(asked)) == 11  # stühle, ärgert, thhetiin, weg, four signs, and three digits
    library = Tokenizer.from_str(_described())
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_cut_words_keep_the_library_s_ids():
    """Apostrophes, special strings, marks that compose, signs among Latin letters, other scripts, odd spaces."""
    library, held = Tokenizer.from_str(_described()), token_files.WordIds(_described())
    odd = ["don't", "'tis", "a!'s", "I'LL'd", "x×y÷z", "ÀÉÞß", "éa,b", "ẹ́x", "<|endoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "<|", "|>",
           "ΟΔΟΣ,a", "日本,語7", "İx", "1234,5", "٣4", "²x", "ª1", "a\u0085b", "\x1ca\x7fb", "😀!a", "_a-b__c", "...", "KK", "ŒUVRE.", "ÿ", " a", "#1!é2"]
    rng = np.random.default_rng(9)
    letters = list("abAB09.,'!<|>éÀ×ßΣ́日 \t\n")
    texts = odd + [" ".join(odd), "".join(odd), "", " "] + ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3_000)]
    assert list(_coded(held, texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_splitters_keep_whole_words():
    described = _described().replace("[\\\\p{N}]|", "[\\\\p{N}]+|")
    assert described != _described()
    held = token_files.WordIds(described)
    assert held.kinds is None
    texts = ["abc123,d 45", "don't"]
    library = Tokenizer.from_str(described)
    assert list(_coded(held, texts)) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_keeps_its_words_between_tasks():
    """Each task unpickles the package's functions anew; the words met by an earlier one are still there."""
    tasks = [cloudpickle.loads(cloudpickle.dumps(token_files._word_ids)) for _ in range(2)]
    first = tasks[0](_described())
    list(_coded(first, ["stühle, stühle", "a"]))
    assert tasks[1](_described()) is first
    assert len(tasks[1](_described()).hashes) == 3
    other = _described() + " "
    assert tasks[1](other) is not first
