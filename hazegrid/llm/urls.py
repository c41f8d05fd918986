"""URL filter: all wildcard rules run at once as one bit-parallel Shift-And automaton.

A rule is a glob over the canonical form ``.host/path`` of a URL: ``*`` stands for any characters but ``/``, ``**``
for any characters, ``?`` for one character that is no ``/``. Every glob takes one run of bits in a row of 64-bit
words; reading one character moves all rules of all URLs of a batch by a handful of word operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import ascii_lower

#: The rules that the contract of the query names, as (host, path, verdict).
HOST_PATH_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Globs that decide where no rule fits: host names and paths of link farms and trackers.
SPAM_GLOBS = (
    "*.spam*/**", "*.spam*",
    "*.casino*/**", "*.casino*",
    "*.cheap-*/**", "*.cheap-*",
    "*.free-bets*/**", "*.free-bets*",
    "*.ads-*/**", "*.ads-*",
    "**/wp-login*", "**/cgi-bin/**",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_glob(host: str, path: str) -> str:
    """The host and all its subdomains, and every path that starts with ``path``."""
    return f"*.{host}{path}**"


class ShiftAnd:
    """Globs packed into ``words`` 64-bit words, simulated over many strings at once.

    Bit 0 of a glob is its start state, bit j means that j elements have been read. A state may also stay where it
    is, if the ``*`` or ``**`` that follows it takes the character. ``table`` has the masks of each byte.
    """

    def __init__(self, globs: Sequence[str]):
        spans, elements = [], []
        for glob in globs:
            states: list[list] = [["", ""]]  # (the element that leads to the state, the loop on the state)
            i, raw = 0, glob.encode()
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    states[-1][1] = "any"
                    i += 2
                elif raw[i : i + 1] == b"*":
                    states[-1][1] = states[-1][1] or "segment"
                    i += 1
                else:
                    states.append([raw[i], ""])
                    i += 1
            spans.append((len(elements), len(elements) + len(states) - 1))
            elements += states
        self.words = max(1, -(-len(elements) // 64))
        self.final = np.array([last for _, last in spans], dtype=np.int64)
        self.start = np.zeros(self.words, np.uint64)
        self.move = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        slash = ord("/")
        for first, _ in spans:
            self.start[first // 64] |= np.uint64(1 << first % 64)
        for j, (element, loop) in enumerate(elements):
            bit, word = np.uint64(1 << j % 64), j // 64
            if element == ord("?"):
                self.move[[c for c in range(256) if c != slash], word] |= bit
            elif element != "":
                self.move[element, word] |= bit
            if loop:
                self.stay[[c for c in range(256) if loop == "any" or c != slash], word] |= bit

    def run(self, strings: Iterable[str]) -> np.ndarray:
        """Boolean matrix (strings, globs): the globs that match each whole string."""
        raw = [s.encode() for s in strings]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        state = np.tile(self.start, (len(raw), 1))
        bytes_ = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
        size, at = size[order], np.concatenate([[0], np.cumsum(size[order])])[:-1]
        sixty_three = np.uint64(63)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, "left"))  # strings longer than step come first
            c, now = bytes_[at[:live] + step], state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> sixty_three
            state[:live] = (moved & self.move[c]) | (now & self.stay[c])
        hit = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1)
        out = np.zeros((len(raw), len(self.final)), bool)
        out[order] = hit.astype(bool)
        return out


def matching_globs(canonical: Column, globs: Sequence[str]) -> Column:
    """Ascending indexes of the globs that match the whole string; a null string matches none."""
    machine = ShiftAnd(globs)

    @F.pandas_udf("array<int>")
    def match(urls: pd.Series) -> pd.Series:
        if not len(urls):
            return pd.Series([], dtype=object)
        found = machine.run(urls.fillna(""))
        found[urls.isna().to_numpy()] = False
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in found], dtype=object)

    return match(canonical)


def judge(pages: DataFrame, url_col: str = "url", rules=HOST_PATH_RULES, spam: Sequence[str] = SPAM_GLOBS) -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` and ``verdict`` of their URL.

    The longest rule that fits gives rule and verdict. Where none fits, rule is null and the verdict is ``block`` if
    a spam glob matches, else ``allow``. A null URL, or one without ``://``, has an empty host and path, fits no rule
    and is allowed. Row by row without a shuffle; columns of those four names are replaced.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    globs = [rule_glob(h, p) for h, p, _ in ranked] + list(spam)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*keep, host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    matched = parsed.withColumn("_hit", matching_globs(F.concat(F.lit("."), "host", "path"), globs))
    first = F.get("_hit", 0)  # indexes ascend, so the longest rule that fits comes first
    table = F.array(*[F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ranked], F.lit(None).cast("struct<rule:string,verdict:string>"))
    fit = F.get(table, F.when(first < len(ranked), first).otherwise(len(ranked)))
    method = F.when(F.size("_hit") > 0, "block").otherwise("allow")
    return matched.select(*keep, "host", "path", fit["rule"].alias("rule"), F.coalesce(fit["verdict"], method).alias("verdict"))
