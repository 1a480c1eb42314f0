"""Chunking holds a bounded part of a batch as Python objects."""

import tracemalloc

import pyarrow as pa

from sparkprep.operators.corpus import _in_slices


def test_few_texts_of_a_batch_are_python_objects():
    texts = pa.array([f"{i} " * 2500 for i in range(4000)] + [None, ""])
    tracemalloc.start()
    chunks = _in_slices(texts, lambda t: t.split("9 ", 1) if t else [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000  # of some 45 MB
    assert len(chunks) == 4002 and chunks[9].as_py() == ["", "9 " * 2499] and chunks[4000].as_py() == chunks[4001].as_py() == []
