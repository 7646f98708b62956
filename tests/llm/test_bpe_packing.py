"""Encoding against the library, packing against its conditions."""

import hashlib
import random
import resource
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bpe, packing
from quillstone.llm.packing import Packer, best_fill
from quillstone.llm.util import KEY_CHARS, MEAN_CHARS, Kept

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.ForcedBoundaryBPE(PATH)


def library_ids(codec, text):
    return codec.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aAbzéÉüßñ'’ \t\n\xa0²½_-!.,09sStTrRevmLld|<>İΣσςカ漢é\x85\x1cthe", max_size=40))
def test_encoding_is_the_librarys(text):
    codec = bpe.codec(PATH)
    ids = library_ids(codec, text)
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids
    assert codec.decode(ids) == codec.library.decode(ids, skip_special_tokens=False)


def test_special_tokens_in_a_text(codec):
    for text in ("a <|endoftext|> b", "<|startoftext|><|endoftext|>", "<|endoftex"):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library_ids(codec, text)


def test_fragments_join_to_the_whole(codec):
    # pieces between forced boundaries, merged apart, give what merging the whole word gives
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüßñ") for _ in range(rng.randint(1, 14))).encode()
        symbols = tuple(s for f in codec.cut(word) for s in f)
        assert b"".join(codec._merge(f) for f in codec.cut(word)) == codec._merge(symbols)
    assert len(codec.cut(b"zqxj" * 3)) > 1


def test_other_scripts_take_the_method_too(codec, monkeypatch):
    rng = random.Random(8)
    alphabets = ["αβγδέήΐΣς", "абвгдежзЖЁ", "漢字仮名交じり文", "😀🎉👩‍👧", "“”–—…€ abc", "एकदोहिन्दी", "e\u0301a\u0308 \u00a0x\u2028y\u0085", "가각한글"]
    texts = ["".join(rng.choices(a + "the ,.", k=rng.randint(1, 300))) for a in alphabets for _ in range(20)]
    want = [library_ids(codec, t) for t in texts]
    fresh = bpe.ForcedBoundaryBPE(PATH)
    cuts = []
    cut = fresh.cut
    monkeypatch.setattr(fresh, "cut", lambda raw: cuts.append(raw) or cut(raw))
    monkeypatch.setattr(fresh, "library", type("Parts", (), {"normalizer": codec.library.normalizer, "pre_tokenizer": codec.library.pre_tokenizer}))  # no encode
    assert [np.frombuffer(fresh.encode(t), "<u4").tolist() for t in texts] == want and len(cuts) > 500


def test_long_fragments(codec, monkeypatch):
    rng = random.Random(5)
    for letters, n in (("the", 3000), ("ab", 500), ("ainoer", 5000), ("漢字", 900)):
        text = "".join(rng.choices(letters, k=n))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library_ids(codec, text)
        symbols = tuple(codec.inner[b] for b in text[:300].encode())
        long = codec._merge(symbols)
        monkeypatch.setattr(bpe, "LONG", 10**9)
        assert codec._merge(symbols) == long
        monkeypatch.undo()
    began = time.time()
    codec._merge(tuple(codec.inner[b] for b in rng.choices(b"ainoerthd", k=100_000)))
    assert time.time() - began < 5


def test_caches_stay_bounded(codec):
    kept = Kept(str.upper, 10)
    for i in range(100):
        assert kept[f"a{i}"] == f"A{i}"
    assert len(kept) + len(kept.old) <= 21
    for i in range(1000):
        assert kept["long" * 10 + str(i)] == "LONG" * 10 + str(i) and sum(map(len, [*kept, *kept.old])) < 2 * (10 * MEAN_CHARS + KEY_CHARS)
    assert kept["x" * (KEY_CHARS + 1)] and all(len(k) <= KEY_CHARS for k in [*kept, *kept.old])


def test_pieces_without_white_space_take_little_memory(codec):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    fresh, rng = bpe.ForcedBoundaryBPE(PATH), random.Random(6)
    for _ in range(300):
        fresh.encode(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=20_000)) for _ in range(2)))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000  # kilobytes; 12 million characters went by


def test_query_digests(spark, documents, codec):
    got = {r.doc_id: r for r in bpe.digests(documents, PATH).collect()}
    for d in documents.select("doc_id", "text").collect():
        ids = library_ids(codec, d.text)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_texts(spark, awkward, codec):
    rows = bpe.decode(bpe.encode(awkward.withColumnRenamed("score", "ids"), PATH), PATH).collect()
    assert len(rows) == 10
    for r in rows:
        assert r.ids == library_ids(codec, r.text or "") and r.decoded == codec.library.decode(r.ids, skip_special_tokens=False)
    assert bpe.encode(awkward.limit(0), PATH).count() == 0
    assert bpe.encode(awkward, PATH, decoded="text_again").select("text_again").collect() == [(codec.library.decode(r.ids, skip_special_tokens=False),) for r in rows]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 60))
def test_fill_is_the_closest(counts, capacity):
    chosen = best_fill(sorted(counts), counts, capacity)
    sums = {0}
    for n, k in counts.items():
        sums = {s + n * i for s in sums for i in range(k + 1) if s + n * i <= capacity}
    assert all(k <= counts[n] for n, k in chosen.items())
    assert sum(n * k for n, k in chosen.items()) == max(sums)


def check(rows, window):
    """Every id once, sequences without gaps, none over the window, padding only short of a power of two."""
    docs, sequences = {}, {}
    for key, start, length, ids, n, seq, offset, filled in rows:
        docs.setdefault(key, []).append((start, ids, n))
        sequences.setdefault(seq, []).append((offset, length, filled))
        assert length == len(ids) // 4 > 0
    for parts in docs.values():
        parts.sort()
        assert [s for s, *_ in parts] == [sum(len(i) // 4 for _, i, _ in parts[:k]) for k in range(len(parts))]
        assert sum(len(i) // 4 for _, i, _ in parts) == parts[0][2]
    padding = 0
    for parts in sequences.values():
        parts.sort()
        assert [o for o, *_ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))]
        total = sum(n for _, n, _ in parts)
        assert total == parts[0][2] <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    return padding


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=80), st.sampled_from([16, 64]))
def test_packer(lengths, window):
    packer = Packer(window)
    for k, n in enumerate(lengths):
        packer.add(k, np.arange(n + 1, dtype="<u4").tobytes())
    packer.finish()
    assert check(packer.rows, window) == 0
    assert {r[0] for r in packer.rows} == set(range(len(lengths)))


def test_one_length_only_leaves_no_padding():
    packer = Packer(2048)
    for k in range(500):
        packer.add(k, bytes(4 * 1500))
    packer.finish()
    assert check(packer.rows, 2048) == 0


def test_packing_documents(spark, documents, codec):
    rows = packing.pack(documents.repartition(3), PATH).collect()
    assert check([tuple(r) for r in rows], 2048) == 0
    texts = {r.doc_id: r.text for r in documents.collect()}
    whole = {}
    for r in sorted(rows, key=lambda r: r.start):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    assert {k: np.frombuffer(v, "<u4").tolist() for k, v in whole.items()} == {k: [*library_ids(codec, t), 1] for k, t in texts.items()}
    for r in packing.pieces(documents.repartition(3), PATH).collect():
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][4 * r.start : 4 * (r.start + r.length)])


def test_packing_awkward_rows(spark, awkward):
    rows = packing.pack(awkward, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(r.length for r in rows if r.doc_id is None) > 1
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert packing.pack(awkward.limit(0), PATH).count() == 0
