"""BPE and packing against the tokenizers library."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from shoebox.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_bpe_equals_the_library(odd, odd_rows, library):
    lexicon = bpe.build_lexicon(odd, bpe.default_tokenizer(), top=200)
    rows = bpe.encode_documents(odd, lexicon=lexicon).collect()
    assert len(rows) == len(odd_rows)
    texts = {}
    for i, t in odd_rows:
        texts.setdefault(i, []).append(t or "")
    for r in rows:
        want = [(e, library.decode(e, skip_special_tokens=False)) for e in (library.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id])]
        assert (r.ids, r.decoded) in want and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_white_space_and_marks(library):
    rnd = random.Random(1)
    encoder = bpe.Encoder(bpe.default_tokenizer())
    for _ in range(2000):
        text = "".join(rnd.choice(" \n\t\x1c\x85\xa0ab'sé1.,<|>endoftxñ²") for _ in range(rnd.randint(0, 40)))
        parts = encoder.encode(text)
        ids = bpe.parse_ids(",".join(parts))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and encoder.decode(ids) == text


def test_left_to_right_equals_merging():
    rnd = random.Random(2)
    model = bpe.ByteBpe(bpe.default_tokenizer())
    for _ in range(3000):
        word = bytes(rnd.choice(b"aeiouthnrs \xc3\xa9") for _ in range(rnd.randint(0, 25)))
        assert model.encode(word) == model.merge(word)


def test_lexicon_is_minimal_and_exact():
    words = {"".join(w).encode(): [i, i + 1] for i, w in enumerate(itertools.product("ab", "cd", ["", "tion", "tions"]))}
    compiled = bpe.compile_lexicon(words)
    lexicon = bpe.Lexicon(compiled)
    assert all(lexicon.find(w) == ids for w, ids in words.items())
    assert all(lexicon.find(w) is None for w in (b"", b"a", b"act", b"actionss", b"x"))
    # shared prefixes and shared endings: root, a|b, then one common tail
    assert int(np.frombuffer(compiled[:4], np.uint32)[0]) == 8
    assert bpe.Lexicon(bpe.compile_lexicon({})).find(b"a") is None


def pieces(df, **kw):
    return packing.pack_documents(df, **kw).collect()


@pytest.mark.parametrize("length", [4096, 64])
def test_packing_loses_nothing(odd, odd_rows, length):
    own = Tokenizer.from_file(packing.default_tokenizer())
    rows = pieces(odd, length=length)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length
    ids = {}
    for r in rows:
        ids.setdefault(r.doc_id, []).append((r.start, bytes(r.ids), r.doc_tokens))
    for i, t in odd_rows:
        if i is None or sum(x == i for x, _ in odd_rows) > 1:
            continue
        whole = b"".join(b for _, b, _ in sorted(ids[i]))
        want = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(whole, "<u4").tolist() == want and {n for _, _, n in ids[i]} == {len(want)}
    sizes = [sum(n for _, n in p) for p in sequences.values()]
    wasted = sum(length - n for n in sizes if n & (n - 1))
    assert wasted < (0.05 if length == 4096 else 0.15) * sum(sizes)


def test_cuts_are_optimal():
    rnd = random.Random(3)
    for _ in range(200):
        places = np.array(sorted(rnd.sample(range(1, 60), rnd.randint(1, 9)) + [60]))
        places = np.unique(np.concatenate([places, np.arange(12, 61, 12)]))
        cost = np.array([rnd.choice([0, 4, 64]) for _ in places])
        cost[-1] = 0
        found = packing.choose_cuts(places, cost, 20)

        def total(cuts):
            at, sum_ = 0, 0
            for c in cuts:
                if places[c] - at > 20:
                    return None
                sum_ += 20 - (places[c] - at) + cost[c]
                at = places[c]
            return sum_

        options = (total([*c, len(places) - 1]) for n in range(len(places)) for c in itertools.combinations(range(len(places) - 1), n))
        assert total(found) == min(o for o in options if o is not None)


def test_digests(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in packing.packed_digests(df).collect()}
    assert got[2].doc_tokens == 1 and got[2].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes()) and set(got) == {1, 2}


def test_empty_tables(none):
    assert bpe.encode_documents(none).count() == 0 and packing.pack_documents(none).count() == 0
    assert bpe.count_words(none) == []
