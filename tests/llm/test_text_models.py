"""Tokens, token files, chats, fingerprints, personal data, mixing and toxicity: round trips, brute force, held-out rows."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkprep.llm.chat_format import format_chats, loss_spans, loss_texts, parse_chat
from sparkprep.llm import fingerprints as module
from sparkprep.llm.fingerprints import bands, edited_text, fingerprint_with_edits, fingerprints, likeness, near_groups, near_pairs, walks, whole_likeness
from sparkprep.llm.mixing import mix_sources
from sparkprep.llm.pii import Booster, detect, redact, train, written
from sparkprep.llm.sentencepiece_unigram import BYTE, MARK, decode_texts, encode_texts, load_vocabulary
from sparkprep.llm.token_files import Shard, pack_shard, read_tokens, write_tokens
from sparkprep.llm.toxicity import held_out, score_toxicity
from sparkprep.llm.toxicity import train as train_toxicity
from sparkprep.session import shared_folder


def test_pieces(spark):
    vocab = load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["", None, "  a  b ", "漢字 \U0001f600 q", "\n\t x", "a" * 300, "x▁y", " ", "the and of " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = encode_texts(df, vocab)
    for r in coded.collect():
        assert vocab.decode(r.ids) == (r.row.text or "").replace(MARK, " ")
        assert r.lossless == (MARK not in (r.row.text or ""))
        # No other segmentation scores higher: the best one by plain dynamic programming over the same pieces.
        text = (" " + (r.row.text or "").replace(MARK, " ")).encode() if r.row.text else b""
        if text and not any(vocab.kinds[i] == BYTE for i in r.ids):
            pieces = {vocab.bytes[i].replace(MARK.encode(), b" "): s for i, s in enumerate(vocab.scores) if vocab.kinds[i] == 1}
            best = [0.0] + [-1e18] * len(text)
            for e in range(1, len(text) + 1):
                best[e] = max((best[b] + pieces[text[b:e]] for b in range(max(0, e - 48), e) if text[b:e] in pieces), default=-1e18)
            assert sum(vocab.scores[i] for i in r.ids) == pytest.approx(best[-1])
    back = decode_texts(coded.select(F.col("row.doc_id").alias("doc_id"), "ids"), vocab)
    assert {r.row.doc_id: r.text for r in back.collect()}[2] == "  a  b "
    assert encode_texts(df.limit(0), vocab).count() == 0


def test_packing():
    for bits in (1, 3, 13, 16, 17, 32):
        ids = np.random.default_rng(0).integers(0, 2**bits, 1001, dtype=np.uint64).astype(np.uint32)
        s = Shard(pack_shard([1, None], [1000, 1], ids, 5, bits, block=100))
        assert (s.ids(0, 10**9) == ids).all() and (s.ids(250, 777) == ids[250:777]).all() and s.doc_ids == [1, None] and s.first == 5


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(None, None), (-5, ""), (10**12, "a <|endoftext|>b ΣΑΣ́ ́x ΑΣ. \x1cqq\x85z É é"), (3, "dup"), (3, "two"), (7, "word " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    to = f"{shared_folder(spark)}/tokens-test"
    write_tokens(df, to, path)
    got = sorted(read_tokens(spark, to, with_ids=True).collect(), key=lambda r: r.start)
    start = 0
    for g in got:
        assert g.start == start and g.n_tokens == len(g.ids) and g.ids_crc32 == zlib.crc32(np.array(g.ids, "<u4").tobytes())
        start += g.n_tokens
        assert g.ids in [library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows if i == g.doc_id]
    assert [g.doc_id for g in got] == [None, -5, 3, 3, 7, 10**12]


def test_chats(spark):
    rows = [(1, 2, "user", "x </turn>\n"), (1, 1, None, None), (1, 2, "user", "x </turn"), (None, None, "a[1]: \\", "### user[0]: q </turn>\n### b"),
            (3, 0, "assistant", "\\\\#<[ </turn>"), (3, 0, "assistant", "\\\\#<[ </turn>"), (4, 1, "as\nsis", ">\n"), (5, 0, "assistant", "é" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    key = lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for r in format_chats(df).select("*", parse_chat(F.col("formatted")).alias("p"), loss_spans(F.col("formatted")).alias("s"), loss_texts(F.col("formatted")).alias("l")).collect():
        assert [tuple(p) for p in r.p] == [(t[2] or "", t[3] or "") for t in sorted((t for t in rows if t[0] == r.conv_id), key=key)]
        assert [len(x) <= s.end - s.start for x, s in zip(r.l, r.s)] == [True] * len(r.l)
    assert format_chats(df.limit(0)).count() == 0


def test_walks(spark):
    text = " ".join(random.Random(3).choices(["alpha", "beta", "gamma", "delta", "of"], k=400))
    marks = fingerprints([text, text[:500] + "X" + text[500:], "other " * 300, "", text])
    assert likeness(marks[0], marks[1]) > 0.8 and likeness(marks[0], marks[2]) < 0.2 and (marks[0] == marks[4]).all()
    rows = [(i, text[i * 7 :] + str(i)) for i in range(20)] + [(None, None), (40, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(0))
    got = {r.doc_id: r for r in fingerprint_with_edits(df).collect()}
    ring = sorted((r for r in rows if r[0] is not None), reverse=True) + [(None, "")]
    for (i, t), (_, following) in zip(ring, ring[1:] + ring[:1]):
        assert got[i].edited == edited_text(t or "", following or "") and got[i].n_chars == len(t or "")
    assert fingerprint_with_edits(df.limit(0)).count() == 0
    pairs = near_pairs(spark.createDataFrame([(1, text), (2, text[:900] + "zz" + text[900:]), (3, "other " * 300)], "doc_id long, text string"))
    assert [(r.id, r.other) for r in pairs.collect()] == [(2, 1)]


def _blocks(rng, n):
    return ["".join(rng.choices("abcdefgh ", k=600)) for _ in range(n)]


def test_near_texts_in_crowded_buckets(spark):
    rng = random.Random(5)
    base = _blocks(rng, 10)
    # Each of the smallest ids has six of the ten blocks, so it is first in buckets of the near pair and near to nothing.
    texts = {i: "".join(x if k in keep else _blocks(rng, 1)[0] for k, x in enumerate(base)) for i in range(40) for keep in [rng.sample(range(10), 6)]}
    texts |= {100: "".join(base), 101: "".join(base[:9] + _blocks(rng, 1)), 102: "".join(base[:8] + _blocks(rng, 1) + base[9:])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids, marks, whole = list(texts), fingerprints(list(texts.values())), walks(list(texts.values()))
    near = {(ids[j], ids[i]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if likeness(marks[i], marks[j]) >= 0.75 and whole_likeness(whole[i], whole[j]) >= 0.75}
    group = {i: i for i in ids}
    for _ in ids:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    assert near and {(r.id, r.other) for r in near_pairs(df).collect()} <= near
    for tile in (512, 3):
        links, members = near_groups(df, tile=tile)
        found = {(r.id, r.other) for r in links.collect()}
        assert found <= near and len(found) >= len(ids) - len(set(group.values()))
        assert {(r.id, r.copy_of, r.group_id) for r in members.collect()} == {(i, i, group[i]) for i in ids}


def test_near_texts_copies_and_bands(spark):
    text = " ".join(random.Random(3).choices(["alpha", "beta", "gamma", "delta", "of"], k=400))
    rows = [(i, text) for i in (9, 4, 6, 4)] + [(None, text), (2, text[:900] + "zz" + text[900:]), (1, "other " * 300), (8, None), (7, ""), (None, "lone")]
    links, members = near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.id, r.other) for r in links.collect()] == [(4, 2)]
    got = sorted(((r.id, r.copy_of, r.group_id) for r in members.collect()), key=repr)
    assert got == sorted([(9, 4, 2), (4, 4, 2), (6, 4, 2), (4, 4, 2), (None, 4, 2), (2, 2, 2), (1, 1, 1), (8, 7, 7), (7, 7, 7), (None, None, None)], key=repr)
    assert near_groups(spark.createDataFrame([], "doc_id long, text string"))[1].count() == 0
    # Whichever slots are unequal, as many as a likeness allows, one band is whole.
    rng = np.random.default_rng(1)
    for least in (0.5, 0.7, 0.75, 0.76, 0.9, 1.0):
        sets = bands(least)
        assert min(map(len, sets)) >= 4
        for _ in range(300):
            order = list(np.concatenate([rng.permutation(x) for x in sets]))[:: rng.integers(1, 4)] + list(rng.permutation(128))
            broken = set(list(dict.fromkeys(order))[: int(128 * (1 - least) + 1e-9)])
            assert any(not broken & set(x) for x in sets)


# The base patterns as they are stated.
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _base(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum((d := int(c) * (1 + i % 2)) - 9 * (d > 9) for i, c in enumerate(reversed(digits))) % 10 == 0
            fits = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}
            if fits[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab0123456789  --..@@%_+()é😀") for _ in range(rng.choice([0, 5, 60, 300])))) for i in range(400)]
    odd = "1.2.3.4.5.6.7.8 a@b.c_d@e.f 0000255.1.1.1 256.1.1.1 a..b@c-.d..e x@y.z."
    rows += [(None, None), (7, odd), (7, odd), (8, "4111111111111111 4111-1111 1111-1111 4111  1111 x+1 (017) 555-7713"), (9, "1 " * 20_000), (10, "x@" + "a." * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("row", F.lit(2))
    model = train(df)
    got = detect(df, model=model).select("row.text", written(F.col("base")).alias("w"), written(F.col("spans")).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.w == _base(r.text or "") and set(r.w.split(",")) <= set(r.s.split(","))
    out = redact(spark.createDataFrame([(1, "to a.b@c.de or +1 (017) 555-7713!"), (2, None), (3, "")], "doc_id long, text string"), model=model)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "to <EMAIL> or <PHONE>!", 2: None, 3: ""}
    assert detect(df.limit(0)).count() == 0


def test_thresholds_of_wider_kinds():
    # (kind, length, digits, left, right, assigned, check): sure base spans do not pay for the wrong spans of other kinds.
    cells = [(f, held, p, n) for held in (False, True) for f, p, n in [
        ((1, 4, 0, 0, 0, 0, 1), 100_000, 100_000), ((1, 4, 0, 0, 0, 0, 0), 0, 50), ((5, 1, 3, 0, 0, 0, 2), 400, 2000),
        ((6, 4, 1, 1, 1, 1, 2), 970, 1000), ((6, 4, 1, 0, 0, 0, 2), 10, 1000)]]
    model = Booster().fit(cells)
    assert set(model.thresholds) == {6}
    assert model.score((6, 4, 1, 1, 1, 1, 2)) >= model.thresholds[6] > model.score((6, 4, 1, 0, 0, 0, 2))


def test_mixing(spark):
    rows = [(i, "w " * 10, "big" if i < 3000 else "mid" if i < 3600 else None) for i in range(3900)] + [(5000, None, "none"), (5001, "", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("u", F.lit("clash"))
    counts = {r.source: r.n for r in mix_sources(df, max_repeats=2.0).groupBy("row.source").agg(F.count("*").alias("n")).collect()}
    assert counts["big"] == 3000 and counts[None] == 600 and 600 <= counts["mid"] <= 1200 and counts["none"] == 2
    exact = mix_sources(df, target_entropy=0.9, budget=20_000).select("row.*", "mix_weight", "mix_block", "mix_order")
    weights = {r.source: r.w for r in exact.groupBy("source").agg(F.max("mix_weight").alias("w")).collect() if r.source != "none"}
    assert -sum(w * np.log(w) for w in weights.values()) == pytest.approx(0.9, abs=1e-6)
    for r in exact.groupBy("source").agg(F.count("*").alias("n")).collect():
        if r.source in weights:
            assert 0 <= 2000 * weights[r.source] - r.n <= 1
    assert exact.groupBy("doc_id", "mix_block").count().where("count > 1").count() == 0
    assert mix_sources(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    calm = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(900):
        toxic = i % 6 == 0
        words = rng.choices(calm, k=40) + ([rng.choice(["scumbag", "moron", "vequ" + str(rng.randrange(90))]) for _ in range(3)] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (5000, "")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = score_toxicity(docs, train_toxicity(docs, labels)).select("row.doc_id", "score", held_out(F.col("row.doc_id")).alias("h")).collect()
    assert len(got) == 902 and all(0 <= r.score <= 1 for r in got)
    held = [(rows[r.doc_id][2], r.score >= 0.7) for r in got if r.h and r.doc_id is not None and r.doc_id < 900]
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert score_toxicity(docs, train_toxicity(docs, labels.limit(0))).where("score >= 0.7").count() == 0


def plain_base(text):
    """The base spans by the contract's own patterns, over the whole text."""
    def luhn(d):
        return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))), (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds, 1) for m in re.finditer(p, text or "") if ok(m.group())]


def test_personal_data_in_long_texts(spark):
    r = random.Random(11)
    parts = ["jane.doe@mail.example.org", "a@b.c", "x@y", "10.0.0.255", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 4111 1111",
             "+49 (30) 123 45-67", "+1 2", "12 34 56 78 90 12 34 56 78 90", "key=Ab3dEf6hIj9lMn2pQr5tUv8x", "word", "é漢", "(", "-", "5", "...", "3.14"]
    texts = ["".join(r.choice(parts) + r.choice([" ", " ", " ", "\n", ", ", "", "  ", ";"]) for _ in range(n)) for n in (5, 300, 900, 900, 2500)]
    texts += ["1 " * 5000, "+1 " * 4000, "a@b.c" * 3000, "7" * 9000, "x" * 20_000 + " me@home.org", " ".join(f"u{i}@m{i % 7}.org" for i in range(20_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = train(df)
    for row in detect(df, model=model).collect():
        assert [tuple(x) for x in row.base] == plain_base(row.row.text)
        assert [tuple(x) for x in row.spans] == sorted(tuple(x) for x in row.spans) and set(map(tuple, row.base)) <= set(map(tuple, row.spans))
    clean = {x.doc_id: x.text for x in redact(df, model=model).collect()}
    assert "@" not in clean[len(texts) - 1] and clean[len(texts) - 1].count("<EMAIL>") == 20_000 and clean[9].endswith(" <EMAIL>")


def test_walks_step_by_step(monkeypatch):
    """Walks side by side, alone, and one character at a time write the same."""
    r = random.Random(2)
    texts = ["".join(r.choice("abc déf漢") for _ in range(r.choice([0, 1, 5, 40, 300, 2000]))) for _ in range(60)]

    def plain(text):
        coins, low, place, out = module._coins(), [*module._bytes(text).tolist(), 255], 0, []
        for j in range(int(module._steps(np.array([len(text)]))[0])):
            out.append(low[place])
            place += int(coins[j & 4095][low[place]])
        return out + [255] * module.GRAM

    wanted = [plain(t) for t in texts]
    marks = []
    for few in (0, 24, 1000):
        monkeypatch.setattr(module, "_FEW", few)
        assert [w.tolist() for w in walks(texts)] == wanted
        marks.append(module.fingerprints(texts).tolist())
    assert marks[0] == marks[1] == marks[2]


def test_sampled_places_are_the_least_of_their_order():
    module._kept.clear()
    short = module._records(1000)
    known = module._records(600_000)  # goes on from the shorter ones
    value = module.mix(np.arange(600_000, dtype=np.uint64) + np.uint64(5 << 40))
    records = np.flatnonzero(value == np.minimum.accumulate(value))
    assert known[4][known[4] < 600_000].tolist() == records.tolist() and short[4].tolist() == [x for x in known[4].tolist() if x < max(short[4]) + 1]


def test_a_very_long_walk():
    text = "".join(random.Random(1).choices("abcdefgh ", k=600_000))
    a, b = module.fingerprints([text, text[:300_000] + "!" + text[300_000:]])
    assert (a == b).mean() > 0.8


def test_word_ids_are_kept_between_slices(monkeypatch):
    """Each word is encoded once, also when more words come than one slice holds; odd words have the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from sparkprep.llm import token_files, words

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        described = f.read()
    library, held = Tokenizer.from_str(described), token_files.WordIds(described)
    encoded = []
    first = held.encode
    monkeypatch.setattr(held, "encode", lambda x: encoded.extend(x.decode().split("\n")[:-1]) or first(x))

    def ids_of(texts):
        out = []
        for begin, end, data, offsets in words.text_slices(pa.array(texts), 200):
            starts, ends, of = words.word_places(data, offsets)
            ids, sizes = held.slice_ids(data, starts, ends)
            total = np.concatenate(([0], np.cumsum(sizes)))[of]
            out += [ids[total[i] : total[i + 1]].tolist() for i in range(end - begin)]
        return out

    texts = [f"w{i % 300} é İx a b <|endoftext|>x \u0085 it's ́" for i in range(900)] + ["", None, "y" * 5000]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids_of(texts) == want
    assert len(encoded) == len(set(encoded))
    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    assert ids_of(texts) == want and len(held.hashes) <= 60
