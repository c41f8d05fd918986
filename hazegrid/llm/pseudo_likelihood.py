"""Language-model scoring by masked pseudo-likelihood.

A small window network predicts a word from the two words on either side. It is trained on a masked share of the words
of every document: each task trains a copy on its documents, and the copies are averaged by the number of words that
they have seen. A document's score is the sum of the logarithms of the probabilities of its words, each predicted from
both sides.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import in_groups, small_batches

#: The output layer has two levels: CLASSES classes of MEMBERS words. The rarer words share RARE places by hash.
CLASSES, MEMBERS, RARE = 32, 32, 64
SIZE = CLASSES * MEMBERS
KNOWN = SIZE - RARE
#: Words on each side, embedding width, hidden width.
SIDE, WIDTH, HIDDEN = 2, 16, 32
MASKED = 0.15
STEP_WORDS = 2048
SCORE_WORDS = 16_384
_SHAPES = {
    "embed": (SIZE + 1, WIDTH),
    "hidden": (2 * SIDE * WIDTH, HIDDEN),
    "hidden_bias": (HIDDEN,),
    "classes": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "members": (CLASSES, HIDDEN, MEMBERS),
    "member_bias": (CLASSES, MEMBERS),
}
_COUNTS = [int(np.prod(s)) for s in _SHAPES.values()]
#: Parameters of one row when copies are averaged.
PART = 4096


@dataclass
class Network:
    """Flat parameter vector with named views."""

    flat: np.ndarray

    def __post_init__(self):
        at = 0
        for (name, shape), n in zip(_SHAPES.items(), _COUNTS, strict=True):
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 11) -> Network:
        """Small random weights; the biases give each word its frequency."""
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(sum(_COUNTS), np.float32))
        net.embed[:] = rng.normal(0, 0.3, net.embed.shape)
        net.hidden[:] = rng.normal(0, (2 * SIDE * WIDTH) ** -0.5, net.hidden.shape)
        share = ((counts + 1.0) / (counts + 1.0).sum()).reshape(CLASSES, MEMBERS)
        net.class_bias[:] = np.log(share.sum(axis=1))
        net.member_bias[:] = np.log(share / share.sum(axis=1, keepdims=True))
        return net

    def forward(self, context: np.ndarray, target: np.ndarray, back: bool = False):
        """Log probability of each target; with ``back`` also the gradient of their mean."""
        n = len(target)
        x = self.embed[context].reshape(n, -1)
        h = np.tanh(x @ self.hidden + self.hidden_bias)
        group, member = target // MEMBERS, target % MEMBERS
        row = np.arange(n)

        def log_softmax(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(scores, what to subtract from each row of them)."""
            top = z.max(axis=1)
            return z, np.log(np.exp(z - top[:, None]).sum(axis=1)) + top

        by_class, less = log_softmax(h @ self.classes + self.class_bias)
        out = by_class[row, group] - less
        order = np.argsort(group.astype(np.uint8), kind="stable")
        bounds = np.searchsorted(group[order], np.arange(CLASSES + 1))
        if back:
            grad = Network(np.zeros_like(self.flat))
            d = -np.exp(by_class - less[:, None])
            d[row, group] += 1
            d /= n
            grad.classes[:] = h.T @ d
            grad.class_bias[:] = d.sum(axis=0)
            dh = d @ self.classes.T
        for c in range(CLASSES):
            k = order[bounds[c] : bounds[c + 1]]
            if not len(k):
                continue
            own = h[k]
            within, less = log_softmax(own @ self.members[c] + self.member_bias[c])
            out[k] += within[np.arange(len(k)), member[k]] - less
            if back:
                d = -np.exp(within - less[:, None])
                d[np.arange(len(k)), member[k]] += 1
                d /= n
                grad.members[c] = own.T @ d
                grad.member_bias[c] = d.sum(axis=0)
                dh[k] += d @ self.members[c].T
        if not back:
            return out
        da = dh * (1 - h * h)
        grad.hidden[:] = x.T @ da
        grad.hidden_bias[:] = da.sum(axis=0)
        word = context.ravel()
        order = np.argsort(word, kind="stable")
        first = np.flatnonzero(np.r_[True, word[order][1:] != word[order][:-1]])
        grad.embed[word[order[first]]] = np.add.reduceat((da @ self.hidden.T).reshape(-1, WIDTH)[order], first)
        return out, grad.flat


class Reader:
    """Texts as word numbers; words are runs without ASCII white space, A-Z count as a-z."""

    def __init__(self, vocabulary: dict[bytes, int]):
        class Lookup(dict):
            def __missing__(self, w: bytes) -> int:
                n = vocabulary.get(w)
                if n is None:
                    n = KNOWN + zlib.crc32(w) % RARE
                self[w] = n
                return n

        self.lookup = Lookup()

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.lookup) > 500_000:
            self.lookup.clear()
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.lookup.__getitem__, words), np.int32, len(words))


def contexts(texts: list[np.ndarray], share: float = 1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, target, text) of all words, or of a random share of them in random order.

    Beyond the ends of a text the context is the padding word.
    """
    n = np.array([len(t) for t in texts], dtype=np.int64)
    pad = np.full(SIDE, SIZE, np.int32)
    flat = np.concatenate([x for t in texts for x in (pad, t)] + [pad])
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(n.sum()) + SIDE * (owner + 1)
    if share < 1:
        rng = np.random.default_rng(seed)
        chosen = rng.permutation(np.flatnonzero(rng.random(len(at)) < share))
        at, owner = at[chosen], owner[chosen]
    around = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
    return flat[at[:, None] + around], flat[at], owner


def vocabulary_of(docs: DataFrame) -> list[tuple[bytes, int]]:
    """The KNOWN most frequent words of all documents with their counts (ties by the word), and the count of others."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": list(total.keys()), "n": list(total.values())})

        for pdf in batches:
            for text in pdf["text"]:
                total.update((text or "").encode("utf-8", "surrogatepass").lower().split())
            if len(total) > 300_000:
                yield rows()
                total.clear()
        if total:
            yield rows()

    words = docs.mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [(bytes(r["word"]), r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(KNOWN).collect()]


def train(docs: DataFrame, vocabulary: list[tuple[bytes, int]], rate: float = 0.01, rounds: int = 1) -> Network:
    """Network from a masked share of the words of every document. ``docs`` has ``text``."""
    spark = docs.sparkSession
    numbers = {w: i for i, (w, _) in enumerate(vocabulary)}
    counts = np.zeros(SIZE)
    counts[: len(vocabulary)] = [n for _, n in vocabulary]
    # the rare places share what the last known word has, a guess that training corrects
    counts[KNOWN:] = counts[len(vocabulary) - 1] * 4 if vocabulary else 1
    net = Network.start(counts)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((numbers, net.flat))

        def learn(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known, start = shared.value
            reader, own, seen, step = Reader(known), Network(start.copy()), 0, 0
            mean, square = np.zeros_like(own.flat), np.zeros_like(own.flat)
            token = 0
            for pdf in batches:
                for lo in range(0, len(pdf), 64):
                    raw = [t or "" for t in pdf["text"].iloc[lo : lo + 64]]
                    seed = zlib.crc32(raw[0].encode("utf-8", "surrogatepass"))
                    token ^= seed
                    context, target, _ = contexts([reader(t) for t in raw], MASKED, seed)
                    for at in range(0, len(target), STEP_WORDS):
                        k = slice(at, at + STEP_WORDS)
                        _, g = own.forward(context[k], target[k], back=True)
                        step, seen = step + 1, seen + len(target[k])
                        mean += 0.1 * (g - mean)
                        square += 0.01 * (g * g - square)
                        own.flat += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
            if seen:
                weighted = own.flat.astype(np.float64) * seen
                parts = [weighted[i : i + PART] for i in range(0, len(weighted), PART)]
                yield pd.DataFrame({"part": range(len(parts)), "lane": token % 256, "seen": seen, "cells": [p.tobytes() for p in parts]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            out = [(part, 0, g["seen"].sum(), np.sum([np.frombuffer(c, np.float64) for c in g["cells"]], axis=0).tobytes()) for (part, _), g in pdf.groupby(["part", "lane"])]
            return pd.DataFrame(out, columns=["part", "lane", "seen", "cells"])

        kinds = "part int, lane int, seen long, cells binary"
        # copies are added up in up to 256 lanes first, so that no task adds them all
        lanes = in_groups(docs.select("text").mapInPandas(learn, kinds), ["part", "lane"], add, kinds, rows=256)
        total = sorted(in_groups(lanes, ["part", "lane"], add, kinds, rows=256).collect(), key=lambda r: r["part"])
        if not total:
            break
        net = Network((np.concatenate([np.frombuffer(r["cells"], np.float64) for r in total]) / total[0]["seen"]).astype(np.float32))
    return net


def score(docs: DataFrame, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, pseudo_log_likelihood, per_word`` of every row, from a model of all rows.

    The score of a text without words (null, empty, white space) is 0 and its mean null. Repeated rows are learnt
    from as often as they occur and get equal scores; null ids are kept; further columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    vocabulary = vocabulary_of(source.select("text"))
    net = train(source, vocabulary, rounds=rounds)
    shared = spark.sparkContext.broadcast(({w: i for i, (w, _) in enumerate(vocabulary)}, net.flat))

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, flat = shared.value
        reader, own = Reader(known), Network(flat)
        for pdf in batches:
            sums, sizes = np.zeros(len(pdf)), np.zeros(len(pdf), np.int64)
            for lo in range(0, len(pdf), 64):
                texts = [reader(t) for t in pdf["text"].iloc[lo : lo + 64]]
                context, target, owner = contexts(texts)
                for at in range(0, len(target), SCORE_WORDS):
                    k = slice(at, at + SCORE_WORDS)
                    sums[lo : lo + 64] += np.bincount(owner[k], own.forward(context[k], target[k]), len(texts))
                sizes[lo : lo + 64] = [len(t) for t in texts]
            yield pd.DataFrame({"id": pdf["id"], "n_words": sizes, "total": sums})

    scored = source.mapInPandas(rate, f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, total double")
    mean = F.when(F.col("n_words") > 0, F.round(F.col("total") / F.col("n_words"), 4))
    return scored.select(F.col("id").alias(id_col), "n_words", F.round("total", 2).alias("pseudo_log_likelihood"), mean.alias("per_word"))
