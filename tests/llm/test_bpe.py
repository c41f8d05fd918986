import hashlib

import public_tokenizers
import pytest

from hazegrid.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    (1, "Hello world, it's 1234 o'clock!"), (2, None), (3, ""), (4, "   \n\n\t x  "), (5, "äöü ß çé 漢字 🙂"), (5, "äöü ß çé 漢字 🙂"),
    (None, "no id"), (7, "a" * 5000), (8, ("word, and \t more\n\n  text. " * 9000) + "\u00a0 \u2003x"), (9, "<|endoftext|> stays text"),
]


@pytest.fixture(scope="module")
def reference():
    return bpe.codec(RANKS, public_tokenizers.PATTERN).encoding


def test_ids_and_round_trip(make_docs, reference):
    rows = bpe.encode(make_docs(ODD), RANKS, public_tokenizers.PATTERN, outputs=tuple(bpe.OUTPUTS)).collect()
    assert len(rows) == len(ODD)
    texts = {i: t or "" for i, t in ODD}
    for r in rows:
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_decode_operator_and_empty_table(make_docs, spark):
    encoded = bpe.encode(make_docs(ODD), RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in ODD}
    assert bpe.encode(make_docs([]), RANKS, public_tokenizers.PATTERN).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(nothing, RANKS, public_tokenizers.PATTERN).first()["decoded"]) == b""


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_pieces_meet_at_safe_boundaries(reference, chunk):
    for _, text in ODD[:7] + [(0, "it's  'll we 're\n\n  x' s \u00a0a b"), (0, "x" * 300)]:
        text = text or ""
        assert "".join(bpe.pieces(text, chunk)) == text
        assert bpe.codec(RANKS, public_tokenizers.PATTERN).encode(text, chunk) == reference.encode_ordinary(text)


def whole_matches(text):
    """Ids by the pattern's matches, found without the library."""
    import regex

    single = bpe.codec(RANKS, public_tokenizers.PATTERN).encoding._encode_single_piece
    return [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in single(m.group())]


LONG = [
    " " * 1_000_000, "word" + " " * 200_000 + "word", "\n" * 150_000 + "x", "a" + " \n\t" * 50_000, "\u00a0\u3000 " * 20_000 + "!", " " * 1023 + "x", " " * 1025 + "\u2003",
    "x" + " " * 5000 + "y" + "\r\n" * 5000 + "z" + "\t" * 5000, "\x1c" * 5000 + "q" + "\x85" * 2000,
]


@pytest.mark.parametrize("k", range(len(LONG)))
def test_long_white_space(k):
    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = c.encode(LONG[k])
    assert ids == whole_matches(LONG[k]) and c.decode(ids) == LONG[k].encode()


def test_long_white_space_in_a_table(make_docs):
    rows = {r["doc_id"]: r for r in bpe.encode(make_docs(list(enumerate(LONG))), RANKS, public_tokenizers.PATTERN, outputs=("decoded_sha256", "n_tokens")).collect()}
    for i, t in enumerate(LONG):
        assert rows[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_words_of_any_script_are_cut(reference):
    text = "привет мир это длинный текст без латинских букв " * 9000
    parts = list(bpe.pieces(text))
    assert len(parts) > 5 and max(map(len, parts)) < bpe.CHUNK + 100 and "".join(parts) == text
    assert bpe.codec(RANKS, public_tokenizers.PATTERN).encode(text) == reference.encode_ordinary(text)
