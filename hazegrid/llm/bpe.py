"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hazegrid.llm.common import small_batches

#: Characters after which a long text is cut at the next safe boundary.
CHUNK = 1 << 16
#: Between a character that no engine takes for white space and a following space or line feed. A match that holds
#: such a character never goes on into white space, and white space never looks back, so no match crosses.
_SAFE = re.compile(r"\S(?=[ \n])")
#: Characters of a run of white space from which on it is not given to the pattern, which would need a deep stack.
LONG_RUN = 1024
#: White space of the pattern's engine.
_BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG = re.compile(_BLANK + "{%d,}" % LONG_RUN)
_TWO = re.compile(_BLANK + "{2}")
_CODECS: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encoder and decoder for one rank file and one split pattern; built once per Python worker."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: str(rank) for rank in self.tokens}

    def encode(self, text: str, chunk: int = CHUNK) -> list[int]:
        ids: list[int] = []
        at = 0
        for start, end in long_runs(text):
            # one match: all of the run, or all but the character before a word
            stop = end if end == len(text) else end - 1
            ids += self._encode(text[at:start], chunk)
            ids += self.encoding._encode_single_piece(text[start:stop])
            at = stop
        return ids + self._encode(text[at:], chunk) if at else self._encode(text, chunk)

    def _encode(self, text: str, chunk: int) -> list[int]:
        if len(text) <= chunk:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece in pieces(text, chunk):
            ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def written(self, ids) -> str:
        return " ".join(map(self.digits.__getitem__, ids))


def long_runs(text: str) -> list[tuple[int, int]]:
    """Where the text has ``LONG_RUN`` or more characters of white space in a row."""
    # such a run covers two neighbours of every such sample
    return [m.span() for m in _LONG.finditer(text)] if _TWO.search(text[:: LONG_RUN // 2]) else []


def pieces(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """The text cut at safe boundaries, each piece ``chunk`` characters or as few more as the next boundary needs."""
    at = 0
    while at < len(text):
        found = _SAFE.search(text, at + chunk - 1) if at + chunk < len(text) else None
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def ranks_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def codec(ranks_path: str, pattern: str) -> Codec:
    return _codec(ranks_file(ranks_path), pattern)


def _codec(ranks: bytes, pattern: str) -> Codec:
    key = (hashlib.md5(ranks).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


#: What :func:`encode` can return for a text.
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType(), False),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded": T.BinaryType(),
    "decoded_sha256": T.StringType(),
}


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs=("ids",)) -> DataFrame:
    """``id_col`` and the chosen outputs for every row, in one pass without a shuffle.

    ``ids`` are the tokens, ``n_tokens`` their number, ``ids_sha256`` the hash of the decimal ids joined by one
    space, ``decoded`` the bytes that the ids decode to and ``decoded_sha256`` their hash. A null or empty text has
    no tokens. Repeated rows, null ids and further columns do no harm: only the two named columns are read. A text
    is encoded in pieces of bounded size; only a run without any safe boundary stays in one piece. The rank file
    is read here and sent to the tasks.
    """
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_file(ranks_path))
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(o, OUTPUTS[o]) for o in outputs]])

    def one(c: Codec, text: str) -> list:
        ids = c.encode(text)
        row = {"ids": ids, "n_tokens": len(ids)}
        if "ids_sha256" in outputs:
            row["ids_sha256"] = hashlib.sha256(c.written(ids).encode()).hexdigest()
        if "decoded" in outputs or "decoded_sha256" in outputs:
            row["decoded"] = c.decode(ids)
            row["decoded_sha256"] = hashlib.sha256(row["decoded"]).hexdigest()
        return [row[o] for o in outputs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = _codec(ranks.value, pattern)
        for pdf in batches:
            rows = [one(c, t or "") for t in pdf["_text"]]
            yield pd.DataFrame({id_col: pdf["_id"], **{o: pd.Series([r[i] for r in rows], dtype=object) for i, o in enumerate(outputs)}})

    return source.mapInPandas(run, schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded`` (raw bytes, which need not be valid UTF-8); null ids decode to no bytes."""
    small_batches(tokens.sparkSession)
    ranks = tokens.sparkSession.sparkContext.broadcast(ranks_file(ranks_path))
    source = tokens.select(tokens[id_col].alias("_id"), tokens[ids_col].alias("_ids"))
    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = _codec(ranks.value, pattern)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf["_id"], "decoded": [c.decode(ids) if ids is not None else b"" for ids in pdf["_ids"]]})

    return source.mapInPandas(run, schema)
