import hashlib
import os
import random
from collections import Counter

import pytest

from hazegrid.llm import suffixes
from hazegrid.llm.deepshallow import common_prefix, sort_strings


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length):
    """Texts from common passages of lengths around the threshold, some periodic, some copied as a whole."""
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passages = [text(rng.choice([length - 8, length - 1, length, length + 1, 2 * length, 5 * length])) for _ in range(8)]
    texts = ["".join(rng.choice([text(rng.randrange(150)), rng.choice(passages)]) for _ in range(rng.randrange(7))) for _ in range(60)]
    texts += ["ab" * 400, "z" * (length + 1), "z" * (length - 1), "y" * length, passages[5], passages[5] + "x", texts[3], texts[3], None, ""]
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "length", "group_rows"), [(1, 200, 16_384), (2, 80, 16_384), (3, 200, 2), (4, 120, 5)])
def test_measure_equals_counting_all_strings(make_docs, seed, length, group_rows):
    rows = corpus(seed, length)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.measure(make_docs(rows), length, group_rows=group_rows).collect()}
    assert [got[i] for i, _ in rows] == brute(rows, length)


def test_odd_rows(make_docs):
    rng = random.Random(9)
    body, other = ("".join(rng.choice("abcdef ") for _ in range(n)) for n in (900, 700))
    rows = [(1, body), (1, body), (None, other + body[:300]), (None, None), (4, "é" * 150 + other[:250]), (5, "tail " + other[-201:])]
    docs = make_docs(rows)
    got = suffixes.measure(docs)
    want = Counter((i, *w) for (i, _), w in zip(rows, brute(rows, 200), strict=True))
    assert Counter(tuple(r) for r in got.collect()) == want
    cut = suffixes.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == 6
    by_text = {(r["doc_id"], r["text"]): r["n_chars"] for r in cut.collect()}
    assert by_text[(1, "")] == 0 and (None, None) in by_text
    assert all(n == len(t) for (_, t), n in by_text.items() if t is not None)
    assert suffixes.measure(make_docs([])).collect() == [] and suffixes.without_repeats(make_docs([])).collect() == []
    with pytest.raises(ValueError, match="length"):
        suffixes.measure(docs, 20)


def test_deep_shallow_order():
    for seed in range(60):
        rng = random.Random(seed)
        base = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(6)]
        strings = [rng.choice(base)[: rng.randint(0, 40)] + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 60))]
        strings += [rng.choice(strings) for _ in range(10)] if strings else []
        for shallow in (0, 1, 2):
            order, lcp = sort_strings(strings, shallow)
            assert [strings[i] for i in order] == sorted(strings)
            pairs = [len(os.path.commonprefix([strings[order[k - 1]], strings[order[k]]])) for k in range(1, len(order))]
            assert lcp == [0] * bool(strings) + pairs
    assert common_prefix(b"", b"a") == 0 and common_prefix(b"\0\0a", b"\0\0b") == 2


def test_texts_that_share_an_id_are_told_apart(make_docs):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(350)
    rows = [(1, noise(500) + passage + noise(100)), (1, noise(1168)), (2, passage + noise(700)), (1, noise(300) + passage), (3, noise(900))]
    got = sorted(tuple(r)[1:] for r in suffixes.measure(make_docs(rows)).collect())
    assert got == sorted(brute(rows, 200))
    one_id = [(7, t) for _, t in rows]
    assert sorted(tuple(r)[1:] for r in suffixes.measure(make_docs(one_id)).collect()) == sorted(brute(rows, 200))
    docs = make_docs(one_id).selectExpr("*", "1 AS _place", "2 AS _key", "3 AS _gone", "4 AS _spans", "5 AS text_key", "6 AS spans")
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns
    assert sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in left.collect()) == sorted(d for *_, d in brute(rows, 200))
    assert {(r["_place"], r["_key"], r["_gone"], r["_spans"], r["text_key"], r["spans"]) for r in left.collect()} == {(1, 2, 3, 4, 5, 6)}
