"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are the openings of its elements (by path) and the text runs outside article-like parts. Tokens that
occur equally often in every page of a host have equal occurrence vectors and form an equivalence class. Classes that
enough pages support nest into the host's template; the slot that holds the article is chosen from it, text runs that
belong to the template are dropped, and what is left in the slot is the main text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import small_batches
from hazegrid.llm.html_blocks import Page, read_page
from hazegrid.llm.urls import host_of
from hazegrid.session import materialize

#: A class belongs to the template if so many of a host's pages have its tokens.
SUPPORT = 0.5
#: Without an article-like element, the slot must hold so much of the text.
TEXT_SHARE = 0.6
_LOW = 0xFFFFFFFF


def _run_token(path: str, text: str) -> str:
    return f"{path}#{xxhash.xxh3_64_hexdigest(text)}"


def _page_tokens(page: Page) -> dict[str, list[int]]:
    """token -> [times, characters of text below that is no chrome, 1 if article-like]."""
    out = {path: [times, 0, int(path.rsplit("/", 1)[-1].split(".")[0] in ("article", "main"))] for path, times in page.elements.items()}
    for b in page.blocks:
        if b.chrome:
            continue
        path = b.path
        while path:
            if path in out:
                out[path][1] += len(b.text)
            path = path.rpartition("/")[0]
        if not b.main:
            out.setdefault(_run_token(b.path, b.text), [0, 0, 0])[0] += 1
    return out


def _tokens(pages: DataFrame) -> DataFrame:
    """Per host and token, summed over the pages of a batch: pages, the occurrence vector as two sums, text below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: dict[tuple[str, str], list[int]] = {}
            for host, source in zip(pdf["host"], pdf["html"], strict=True):
                if not source:
                    continue
                own = xxhash.xxh3_64_intdigest(source)
                for token, (times, chars, article) in [*_page_tokens(read_page(source)).items(), ("", (1, 0, 0))]:
                    # a page adds a hash of itself and of how often it has the token: equal sums, equal vectors
                    h = xxhash.xxh3_64_intdigest(times.to_bytes(8, "little"), seed=own)
                    row = total.setdefault((host, token), [0, 0, 0, 0, 0, article])
                    for i, v in enumerate((1, times, h & _LOW, h >> 32, chars)):
                        row[i] += v
            yield pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["host", "token", "n_pages", "times", "low", "high", "chars", "article"])

    return pages.select("host", "html").mapInPandas(run, "host string, token string, n_pages long, times long, low long, high long, chars long, article int")


def deduce(pages: DataFrame) -> DataFrame:
    """One row per host: ``slot`` (path of the element with the article, null if none) and ``fixed`` (template runs).

    ``pages`` has ``host`` and ``html``.
    """
    # copies of a page say nothing on what its host's pages share: each different page counts once
    pages = pages.where("html <> ''").groupBy("host", F.xxhash64("html").alias("own"), F.length("html").alias("size")).agg(F.first("html").alias("html"))
    sums = [F.sum(c).alias(c) for c in ("n_pages", "times", "low", "high", "chars")]
    tokens = _tokens(pages).groupBy("host", "token").agg(*sums, F.max("article").alias("article"))
    tokens = materialize(tokens, "tokens")
    # the empty token stands for the page itself
    hosts = tokens.where("token = ''").select("host", F.col("n_pages").alias("all_pages"))
    supported = tokens.where("token <> ''").join(hosts, "host").where(F.col("n_pages") >= F.greatest(F.lit(SUPPORT) * F.col("all_pages"), F.lit(1)))
    # tokens with one vector are one class; the vector is known by support and sums
    vector = ["host", "n_pages", "times", "low", "high"]
    classes = supported.groupBy(*vector).agg(F.collect_list(F.struct("token", "chars", "article", "all_pages")).alias("members"))
    # nesting: a member lies below the class if another member is the start of its path; a class that occurs once in
    # each of its pages is a part of the template's skeleton, one that occurs more often is a repeated slot
    skeleton = classes.withColumn("once", F.col("times") == F.col("n_pages"))
    member = skeleton.select("host", "once", "n_pages", F.size("members").alias("class_size"), F.explode("members").alias("m")).select("host", "once", "n_pages", "class_size", "m.*")
    element = ~F.contains("token", F.lit("#"))
    body = member.where(element).groupBy("host").agg(F.max("chars").alias("most"))
    depth = F.size(F.split("token", "/"))
    named = F.when(F.regexp_like("token", F.lit(r"/article(\.[a-z]+)?$")), 2).otherwise(F.col("article"))
    # an article outermost, else the deepest part of the skeleton that still holds most of the text
    leaf = F.regexp_like("token", F.lit(r"/(p|h[1-6]|li|pre|blockquote|dt|dd|figcaption)(\.[a-z]+)?$"))
    fit = (named > 0) | (~leaf & F.col("once") & (F.col("class_size") > 1) & (F.col("chars") >= TEXT_SHARE * F.col("most")))
    rank = F.struct(named.alias("named"), F.when(named > 0, -depth).otherwise(depth).alias("depth"), F.col("n_pages").alias("n"), F.col("token").alias("token"))
    slots = member.where(element).join(body, "host").where(fit & (F.col("chars") > 0)).groupBy("host").agg(F.max(rank).alias("best")).select("host", F.col("best.token").alias("slot"))
    # a run is fixed only if several pages agree on it
    fixed = member.where(~element & (F.col("n_pages") > 1)).groupBy("host").agg(F.collect_set("token").alias("fixed"))
    return materialize(hosts.select("host").join(slots, "host", "left").join(fixed, "host", "left").select("host", "slot", "fixed"), "templates")


def main_text(source: str | None, slot: str | None, fixed: frozenset[str] | set[str]) -> str:
    """Blocks of one page that lie in the host's slot, else in its own article, else anywhere outside the template."""
    if not source:
        return ""
    blocks = [b for b in read_page(source).blocks if not b.chrome]
    inside = [b for b in blocks if slot and (b.path == slot or b.path.startswith(slot + "/"))]
    if any(b.main for b in blocks) and not any(b.main for b in inside):
        inside = [b for b in blocks if b.main]
    found = inside or blocks
    kept = [b for b in found if b.main or _run_token(b.path, b.text) not in fixed]
    # the template never takes all of a page
    return "\n\n".join(b.text for b in kept or found)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The rows without their HTML, with ``text`` (main text) and ``n_chars`` (its code points).

    Pages are grouped by the host of their URL; pages without one form a group of their own. A null or empty page
    has an empty text. Pages are shuffled by their own hash and templates summed up before the next shuffle, so a host
    may hold any share of the pages. Repeated rows count once in their host and get equal texts; columns named ``text``, ``n_chars`` or ``host`` are replaced.
    """
    small_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in ("text", "n_chars", "host", html_col)]
    read = pages.select(*[pages[c] for c in keep], pages[html_col].alias("_html"), host_of(pages[url_col]).alias("_host"))
    templates = deduce(read.select(F.col("_host").alias("host"), F.col("_html").alias("html")))
    joined = read.join(templates.toDF("_host", "_slot", "_fixed"), "_host", "left")

    @F.pandas_udf("string")
    def cut(sources: pd.Series, slots: pd.Series, fixed: pd.Series) -> pd.Series:
        out, sets = [], {}
        for source, slot, runs in zip(sources, slots, fixed, strict=True):
            key = tuple(runs) if runs is not None and len(runs) else ()
            if key not in sets:
                sets = {key: frozenset(key)}
            out.append(main_text(source, slot, sets[key]))
        return pd.Series(out, dtype=object)

    done = joined.select(*keep, cut("_html", "_slot", "_fixed").alias("text"))
    return done.select(*keep, "text", F.char_length("text").cast("long").alias("n_chars"))
