"""Registered queries of the training-data operators, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm import alignment, bpe, decontamination, hyperminhash, licenses, line_quality, merkle, ordinal, packing, pseudo_likelihood, suffixes, templates, urls
from hazegrid.llm.common import ascii_lower, table, tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _like(glob: str) -> str:
    """A URL glob as a regular expression for SQL."""
    marks = {"**": "[\\s\\S]*", "*": "[^/]*", "?": "[^/]"}
    out, i = "", 0
    while i < len(glob):
        for mark, pattern in marks.items():
            if glob.startswith(mark, i):
                out, i = out + pattern, i + len(mark)
                break
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "-_/" else "\\" + glob[i]), i + 1
    return f"^{out}$"


_RANKED = sorted(urls.HOST_PATH_RULES, key=lambda r: (-len(r[0] + r[1]), r))
_FITS = [f"(('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}'))" for h, p, _ in _RANKED]
_SPAM = " OR ".join(f"regexp_matches('.' || host || path, '{_like(g)}')" for g in urls.SPAM_GLOBS)
_URL_SQL = f"""
WITH parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(_FITS, _RANKED, strict=True))} END AS rule,
       CASE {" ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(_FITS, _RANKED, strict=True))}
            WHEN {_SPAM} THEN 'block' ELSE 'allow' END AS verdict
FROM parsed
"""


@register("op1_pseudo_likelihood")
def masked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


@register("op2_latent_decontamination")
def latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_url_filter", _URL_SQL)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


@register("op4_template_text")
def template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register("op5_license_scan", licenses.duckdb_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op6_suffix_array")
def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.measure(table(spark, sf_dir, "documents"))


@register("op7_hyperminhash")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@register("op8_line_labels")
def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = line_quality.judge(docs, line_quality.train(docs, table(spark, sf_dir, "labels")))
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *figures, "base_failed", "kept", F.round("content_share", 6).alias("content_share"))


@register("op9_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@register("op10_ordinal_quality")
def ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ordinal.score(docs, ordinal.train(docs, table(spark, sf_dir, "labels"))).drop("text")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: Trees by recursion over the levels, siblings by joins with whole levels, and roots by recursion along the steps.
_MERKLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc),
marked AS (
  SELECT doc_id, source, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
         CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d))),
                                   lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 5 = 0
              THEN sha256({_HEAD} || {_FIELD.format(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS tampered
  FROM documents, crc_table),
leaves AS (
  SELECT row_number() OVER () AS k, *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n
  FROM marked),
tree AS (
  SELECT 0 AS lvl, source, pos, leaf AS x, n FROM leaves
  UNION ALL
  SELECT lvl + 1, source, pos // 16, sha256(string_agg(x, '' ORDER BY pos)), (n + 15) // 16
  FROM tree WHERE n > 1 GROUP BY lvl, source, pos // 16, n),
subroots AS (
  SELECT source, x AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, subroot AS x, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(x, '' ORDER BY pos)), (n + 15) // 16
  FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n),
walk AS (
  SELECT k, source, 0 AS lvl, pos, n FROM leaves
  UNION ALL
  SELECT k, source, lvl + 1, pos // 16, (n + 15) // 16 FROM walk WHERE n > 1),
over_walk AS (
  SELECT source, 0 AS lvl, pos, n FROM subroots
  UNION ALL
  SELECT source, lvl + 1, pos // 16, (n + 15) // 16 FROM over_walk WHERE n > 1),
below AS (
  SELECT w.k, 0 AS part, w.lvl, coalesce(string_agg(t.x, '' ORDER BY t.pos) FILTER (t.pos < w.pos), '') AS lft,
         coalesce(string_agg(t.x, '' ORDER BY t.pos) FILTER (t.pos > w.pos), '') AS rgt
  FROM walk w JOIN tree t ON w.source IS NOT DISTINCT FROM t.source AND w.lvl = t.lvl AND w.pos // 16 = t.pos // 16
  WHERE w.n > 1 GROUP BY w.k, w.lvl),
above AS (
  SELECT w.source, w.lvl, coalesce(string_agg(t.x, '' ORDER BY t.pos) FILTER (t.pos < w.pos), '') AS lft,
         coalesce(string_agg(t.x, '' ORDER BY t.pos) FILTER (t.pos > w.pos), '') AS rgt
  FROM over_walk w JOIN top t ON w.lvl = t.lvl AND w.pos // 16 = t.pos // 16
  WHERE w.n > 1 GROUP BY w.source, w.lvl),
steps AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY part, lvl) AS step, lft, rgt
  FROM (SELECT k, part, lvl, lft, rgt FROM below
        UNION ALL SELECT l.k, 1, a.lvl, a.lft, a.rgt FROM leaves l JOIN above a ON l.source IS NOT DISTINCT FROM a.source)),
folding AS (
  SELECT k, 0 AS step, coalesce(tampered, leaf) AS x FROM leaves
  UNION ALL
  SELECT f.k, s.step, sha256(s.lft || f.x || s.rgt) FROM folding f JOIN steps s ON f.k = s.k AND s.step = f.step + 1),
proofs AS (SELECT k, string_agg(lft || rgt, '' ORDER BY step) AS proof FROM steps GROUP BY k),
folded AS (SELECT k, arg_max(x, step) AS x FROM folding GROUP BY k),
root AS (SELECT x AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.x AS folded_root, f.x = r.root AS verified
FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN folded f ON l.k = f.k LEFT JOIN proofs p ON l.k = p.k, root r
"""


@register("op11_merkle_manifest", _MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    changed = merkle.leaf([F.col(c) for c in docs.columns[:-1]] + [ascii_lower(F.col("text"))])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, changed)
    out = merkle.manifest(docs, docs.columns, carry={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@register("op12_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2, outputs=("ids_crc32",))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op13_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
