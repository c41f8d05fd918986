import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazegrid.llm import alignment, queries
from hazegrid.llm.common import tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_str(A.decode())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_proto=B)


def byte_alphabet():
    keep = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 173]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


ALPHABET = byte_alphabet()


def group_by_scan(a, b, text):
    """Groups of ids by walking both token lists, or [] if the bytes differ."""
    if not text:
        return []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(ALPHABET[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = []
    for i in ids_b:
        p = b.id_to_piece(i)
        bytes_b.append(bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode())
    want = b" " + text.encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return []
    out, i, j, x, y, part = [], 0, 0, 0, 0, ([], [])
    while i < len(ids_a) or j < len(ids_b):
        if x <= y and i < len(ids_a):
            part[0].append(ids_a[i])
            x += len(bytes_a[i])
            i += 1
        else:
            part[1].append(ids_b[j])
            y += len(bytes_b[j])
            j += 1
        if x == y:
            out.append(part)
            part = ([], [])
    return out


def brute(libraries, texts):
    found = [group_by_scan(*libraries, t) for _, t in texts]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in found]
    count = Counter(p for c in links for p in c)
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, c in zip(texts, found, links, strict=True):
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((
            i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]),
            sum(n * count[p] for p, n in c.items()), hashlib.sha256(written.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


ODD = [
    (1, "Hello world, hello again."), (2, None), (3, ""), (4, " "), (5, "äöü 漢字漢字 🙂🙂 нет слов، مرحبا"), (5, "äöü 漢字漢字 🙂🙂 нет слов، مرحبا"), (None, "no id, hello"),
    (None, None), (7, "\n\n\t tabs  and   blanks \r\n"), (8, "<|endoftext|> <s> </s> <0x41> <unk>"), (9, "mark ▁ inside"), (10, "z" * 3000), (11, "🙂" * 700 + "漢" * 900),
    (12, "word and more " * 4000), (13, "\x00 \x01 nul"), (2**60, "naïve ﬁne ½ ＡＢ"), (-4, "1234567890 0x00ff"),
]


@pytest.mark.parametrize("head", [1, 40, alignment.HEAD])
def test_equals_a_scan_for_any_size_of_the_broadcast(make_docs, libraries, head):
    got = alignment.align(make_docs(ODD), A, B, head=head)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(libraries, ODD)


def test_empty_table_and_rows_without_tokens(make_docs):
    assert alignment.align(make_docs([]), A, B).collect() == []
    assert [tuple(r) for r in alignment.align(make_docs([(1, None)]), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_groups_are_returned(make_docs, libraries):
    texts = [(i, t) for i, t in ODD if i in (1, 5, 7, 10)]
    got = {r["id"]: [(list(g["a"]), list(g["b"])) for g in r["groups"]] for r in alignment.groups(alignment.aligned(make_docs(texts), A, B)).collect()}
    assert got == {str(i): group_by_scan(*libraries, t) for i, t in texts}


ends = st.lists(st.integers(1, 60), min_size=1, max_size=30, unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ends, ends), max_size=5))
def test_leaf_groups_are_cut_at_every_common_end(docs):
    end_a, end_b, docs_a, docs_b, want, base = [], [], [], [], [], 0
    for x, y in docs:
        x, y = [*[e for e in x if e < 61], 61], [*y, 61]
        want += [base + e for e in sorted(set(x) & set(y))]
        end_a += [base + e for e in x]
        end_b += [base + e for e in y]
        docs_a.append(len(end_a))
        docs_b.append(len(end_b))
        base += 61
    end_a, end_b = np.array(end_a, np.int64), np.array(end_b, np.int64)
    sa, sb = alignment.leaf_groups(end_a, end_b, np.array(docs_a, np.int64), np.array(docs_b, np.int64))
    assert end_a[sa - 1].tolist() == end_b[sb - 1].tolist() == want


def test_a_long_interval_without_cuts_and_one_cut_far_from_the_middle():
    end_a = np.append(np.arange(2, 4000, 2), 4000)
    end_b = np.array([*range(3, 3990, 2), 3996, 4000])
    sa, sb = alignment.leaf_groups(end_a, end_b, np.array([len(end_a)]), np.array([len(end_b)]))
    assert end_a[sa - 1].tolist() == end_b[sb - 1].tolist() == [3996, 4000]


def test_query_on_the_small_tables(spark, libraries):
    sf = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).collect()]
    got = sorted(map(tuple, queries.QUERIES["op13_token_alignment"](spark, sf).collect()), key=str)
    assert got == brute(libraries, texts)
