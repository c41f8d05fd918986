import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hazegrid.llm import dominance, packing, queries, word_cache
from hazegrid.llm.common import tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(FILE.decode())


def optimum(sizes, capacity):
    """Fewest bins, by trying all."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best if sizes else 0


def best_fit_one_by_one(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=10))
def test_reduction_keeps_an_optimal_packing(sizes):
    counts = [sizes.count(s) for s in range(25)]
    fixed = dominance.reduce(counts, 24)
    rest = [s for s, n in enumerate(counts) for _ in range(n)]
    assert sum(n for n, _ in fixed) + optimum(rest, 24) == optimum(sizes, 24)
    assert all(sum(p) <= 24 for _, p in fixed)
    packed = Counter(itertools.chain(*(p * n for n, p in fixed))) + Counter(rest)
    assert packed == Counter(sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_best_fit_on_counts_equals_one_by_one(sizes):
    patterns = dominance.best_fit([sizes.count(s) for s in range(41)], 40)
    assert sum(n for n, _ in patterns) == best_fit_one_by_one(sizes, 40)
    bound = dominance.lower_bound(Counter(sizes), 40)
    assert bound <= sum(n for n, _ in dominance.pack(Counter(sizes), 40))


def test_reduction_helps_and_odd_instances():
    sizes = {6: 3, 5: 1, 4: 3, 3: 1, 2: 1}
    assert sum(n for n, _ in dominance.pack(sizes, 10)) == dominance.lower_bound(sizes, 10) == optimum([6] * 3 + [5] + [4] * 3 + [3, 2], 10)
    assert dominance.pack({}, 10) == [] and dominance.pack({10: 7}, 10) == [(7, (10,))]
    with pytest.raises(ValueError):
        dominance.pack({11: 1}, 10)


@pytest.mark.parametrize(("length", "want"), [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (19, [(0, 3), (3, 8), (11, 8)])])
def test_cuts(length, want):
    assert packing.cuts(length, 8) == want


ODD = [
    "", "plain words, and more words", "  lead \n\n\ttabs\r\n  trail  ", "a b  c\x1c d\x85\ne\x0b f!\x1c", "it's we'll 'd x's\n's", "äöü 漢字漢字 🙂🙂 нет слов",
    "<|endoftext|> in <|endoftext|>text", " " * 70_000, "x" * 20_000, "!\x1c! \x1d", "\n" * 300 + "end", "٣٤ ½ Ⅷ ²", "᠎ ​﻿ x",
]


@pytest.mark.parametrize("plain", [False, True])
def test_kept_words_give_the_library_s_ids(plain):
    library = Tokenizer.from_str(FILE.decode())
    library.encode_special_tokens = plain
    encoder = word_cache.ByteBpe(FILE, plain_specials=plain)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_all(ODD)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aBé1'sl!.,)- \n\t\r\x0b\x1c\x85  　é漢🙂"), max_size=30))
def test_pieces_are_encoded_as_in_the_text(text):
    encoder, library = _PAIR
    assert b"".join(word_cache.cut([text])[0].to_pylist()) == text.encode()
    assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


_PAIR = (word_cache.ByteBpe(FILE), Tokenizer.from_str(FILE.decode()))


def check(rows, texts, library, capacity):
    """``rows`` hold the whole of ``texts`` (id, text), each piece once, without gaps or overlaps."""
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    expected = Counter()
    for i, several in want.items():
        for ids in several:
            for k, (s, n) in enumerate(packing.cuts(len(ids), capacity)):
                expected[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    sizes = Counter(r["length"] for r in rows)
    assert len(bins) == sum(n for n, _ in dominance.pack(sizes, capacity)) if rows else not bins
    return bins


def test_whole_tables_and_odd_rows(make_docs, library):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(3, None), (3, None), (None, "no id"), (None, None), (7, "word and " * 3000), (7, "word and " * 3000), (2**60, "big id")]
    rows = packing.pack(make_docs(texts), FILE, 2, capacity=64, outputs=("ids_crc32",)).collect()
    check(rows, texts, library, 64)
    assert packing.pack(make_docs([]), FILE, 2).collect() == []


def test_sequences_hold_the_ids(make_docs, library):
    texts = [(i, "some words " * (i % 9)) for i in range(40)]
    packed = packing.pack(make_docs(texts), FILE, 2, capacity=32, outputs=("ids", "ids_crc32"))
    rows = packed.collect()
    check(rows, texts, library, 32)
    whole = {r["sequence_id"]: list(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in rows:
        part = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert part == list(r["ids"]) and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]


def test_query_on_the_small_tables(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = queries.QUERIES["op12_best_fit_packing"](spark, sf).collect()
    bins = check(rows, texts, library, 1024)
    assert len(bins) <= dominance.lower_bound(Counter(r["length"] for r in rows), 1024) * 1.01 + 1
