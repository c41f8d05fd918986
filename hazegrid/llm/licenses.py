"""Licence scan by sentences: known licence sentences become identifiers, identifier sequences become licences.

A text is cut into sentences; sentences that speak of licensing are normalised (lower case, only letters, digits, dots
and plus signs) and mapped to the identifier of the first pattern that they match in full, or to ``unknown``. Ordered
rules then read the sequence of identifiers: each rule takes its identifiers out of the sequence and adds a licence.

Licence texts are mostly wrapped: lines that make up a known sentence are read as one, and a sentence of several clauses
is read by clauses if that tells more. ``duckdb_sql`` reads line by line and without gaps, so it agrees on other texts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import ascii_lower

#: A sentence without one of these says nothing on licensing.
HINT = r"(?i)licen[cs]|permission|redistribut|copyright|warrant|public domain|spdx|rights reserved|provided .as is"
#: Fixed values: (identifier, pattern of the whole normalised sentence), the first that matches counts.
SENTENCES = (
    ("spdx_mit", r"spdx license identifier mit"),
    ("spdx_apache_2", r"spdx license identifier apache 2.0"),
    ("spdx_gpl_3", r"spdx license identifier gpl 3.0( only| or later|\+)?"),
    ("apache_2_ref", r"(this (work|file|project|software) is )?(licensed|released|distributed|available) under the (terms of the )?apache (software )?license,? ?(version|v) ?2(\.0)?( \(?the license\)?)?"),
    ("apache_comply", r"you may not use this file except in compliance with the license"),
    ("apache_copy", r"you may obtain a copy of the license at.*"),
    ("apache_asis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("gpl_later_3", r"this (program|library|work|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license.*version 3.*any later version"),
    ("gpl_later_2", r"this (program|library|work|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license.*version 2.*any later version"),
    ("lgpl_ref", r".*(licensed|released|distributed|available|terms).*gnu (lesser|library) general public license.*"),
    ("agpl_ref", r".*(licensed|released|distributed|available|terms).*gnu affero general public license.*"),
    ("gpl_3_ref", r"(this (work|file|project|software|program) is )?(licensed|released|distributed|available) under the (terms of the )?gnu general public license,? ?(version|v) ?3(\.0)?"),
    ("gpl_2_ref", r"(this (work|file|project|software|program) is )?(licensed|released|distributed|available) under the (terms of the )?gnu general public license,? ?(version|v) ?2(\.0)?"),
    ("gpl_nowarranty", r"this (program|library) is distributed in the hope that it will be useful but without any warranty.*"),
    ("gpl_copy", r"you should have received a copy of the gnu (lesser |affero )?general public license.*"),
    ("mit_ref", r"(this (work|file|project|software) is )?(licensed|released|distributed|available) under the (terms of the )?mit license"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy.*"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_asis", r"the software is provided as is without warranty of any kind.*"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted.*"),
    ("bsd_source", r"(1. )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd_binary", r"(2. )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd_names", r"(3. )?neither the name of .* may be used to endorse or promote products.*"),
    ("bsd_asis", r"this software is provided by the (copyright holders|regents|author).*as is.*"),
    ("mpl_2_ref", r"this source code form is subject to the terms of the mozilla public license v(ersion)? ?\.? ?2.0"),
    ("cc_by_nc_sa", r"(this (work|text|page) is )?(licensed|released|available) under (a |the )?(cc|creative commons) by nc sa [0-9.]+"),
    ("cc_by_nc_nd", r"(this (work|text|page) is )?(licensed|released|available) under (a |the )?(cc|creative commons) by nc nd [0-9.]+"),
    ("cc_by_nc", r"(this (work|text|page) is )?(licensed|released|available) under (a |the )?(cc|creative commons) by nc [0-9.]+"),
    ("cc_by_sa", r"(this (work|text|page) is )?(licensed|released|available) under (a |the )?(cc|creative commons) by sa [0-9.]+"),
    ("cc_by_nd", r"(this (work|text|page) is )?(licensed|released|available) under (a |the )?(cc|creative commons) by nd [0-9.]+"),
    ("cc_by", r"(this (work|text|page) is )?(licensed|released|available) under (a |the )?(cc|creative commons) by [0-9.]+"),
    ("public_domain", r"(this (work|file|software) (is|has been) )?(placed in|released into|in) the public domain.*"),
    ("reserved", r"(copyright .* )?all rights reserved"),
)
#: Fixed values: (licence, identifiers that follow each other); earlier rules take their identifiers first.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "mit_asis")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_asis")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_asis")),
    ("GPL-3.0-or-later", ("gpl_later_3", "gpl_nowarranty", "gpl_copy")),
    ("GPL-2.0-or-later", ("gpl_later_2", "gpl_nowarranty", "gpl_copy")),
    ("Apache-2.0", ("apache_2_ref", "apache_comply", "apache_copy", "apache_asis")),
    ("GPL-3.0-or-later", ("gpl_later_3",)),
    ("GPL-2.0-or-later", ("gpl_later_2",)),
    ("Apache-2.0", ("apache_2_ref",)),
    ("Apache-2.0", ("spdx_apache_2",)),
    ("MIT", ("mit_ref",)),
    ("MIT", ("spdx_mit",)),
    ("ISC", ("isc_grant",)),
    ("GPL-3.0", ("gpl_3_ref",)),
    ("GPL-3.0", ("spdx_gpl_3",)),
    ("GPL-2.0", ("gpl_2_ref",)),
    ("LGPL", ("lgpl_ref",)),
    ("AGPL", ("agpl_ref",)),
    ("MPL-2.0", ("mpl_2_ref",)),
    ("CC-BY-NC-SA", ("cc_by_nc_sa",)),
    ("CC-BY-NC-ND", ("cc_by_nc_nd",)),
    ("CC-BY-NC", ("cc_by_nc",)),
    ("CC-BY-SA", ("cc_by_sa",)),
    ("CC-BY-ND", ("cc_by_nd",)),
    ("CC-BY", ("cc_by",)),
    ("public domain", ("public_domain",)),
    ("all rights reserved", ("reserved",)),
)

#: A sentence ends at a line feed or at a stop with white space behind it.
END = r"([.!?])[ \t\r\n]+"
NOISE = r"[^a-z0-9.+]+"
#: Line feeds that end a sentence without a stop: before a line without letters, a numbered or marked point, an opening.
OPENING = (
    r"permission is hereby granted|permission to use|redistributions? (and use|of source|in binary)|the above copyright notice and|the software is provided|"
    r"this (program|library|work|file) is|this software is (provided by|licensed|released)|this source code form is|(licensed|released) under|"
    r"unless required by|you may (not use|obtain)|you should have received|neither the name|all rights reserved|copyright (\(c\)|©|[0-9])|spdx-"
)
BLOCK_END = rf"\n(?=[^A-Za-z0-9\n]*+\n|[ \t]*(?:[-•]|\(?[0-9a-z]{{1,2}}[.)])[ \t]|[^A-Za-z0-9\n]*+(?i:{OPENING}))"


def sequence_pattern(identifiers: tuple[str, ...]) -> str:
    """In ``|a|b|c|``, the identifiers one after the other, with their leading bars."""
    return "".join(rf"\|{i}" for i in identifiers) + r"(\||$)"


def spaced_pattern(identifiers: tuple[str, ...]) -> str:
    """The same, with unknown sentences between."""
    return r"(?:\|unknown)*".join(rf"\|{i}" for i in identifiers) + r"(\||$)"


def normalised(sentence: Column) -> Column:
    plain = F.regexp_replace(ascii_lower(sentence), NOISE, " ")
    return F.regexp_replace(F.trim(plain), r"[. ]+$", "")


def identified(sentence: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(f"^({pattern})$"), name).otherwise(out)
    return out


def _known(ids: Column) -> Column:
    return F.filter(ids, lambda i: i != "unknown")


def _readings(sentence: Column) -> Column:
    """Identifiers of a sentence by its lines, as a whole and by its clauses."""

    def each(parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda s: s.rlike(HINT)), lambda s: identified(normalised(s)))

    whole = F.when(sentence.contains("\n"), identified(normalised(sentence))).otherwise("unknown")
    clauses = F.when(sentence.contains(";"), each(F.split(sentence, ";"))).otherwise(F.array().cast("array<string>"))
    return F.struct(each(F.split(sentence, "\n")).alias("lines"), whole.alias("whole"), clauses.alias("clauses"))


def _best(reading: Column) -> Column:
    """The whole if it is known and no line says anything else, else the clauses if more of them are known, else the lines."""
    others = F.filter(reading["lines"], lambda i: (i != "unknown") & (i != reading["whole"]))
    more = F.size(_known(reading["clauses"])) > F.size(_known(reading["lines"]))
    return F.when((reading["whole"] != "unknown") & (F.size(others) == 0), F.array(reading["whole"])).when(more, reading["clauses"]).otherwise(reading["lines"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, sentence_ids, licenses, n_known, n_unknown`` of every row.

    ``sentence_ids`` holds the identifiers in text order between bars (empty: no licensing sentence), ``licenses`` the
    distinct licences in the order of the rules, joined by ``;``: ``UNKNOWN`` if there are licensing sentences but no
    rule fits, ``NONE`` if there are none, as for a null or empty text. Only built-in expressions, row by row, so
    repeated rows and null ids need no care; only the two named columns are read.
    """
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    # most texts never speak of licensing: they are not cut into sentences
    speaks = F.coalesce(F.col("_text").rlike(HINT.replace(" ", r"\s+")), F.lit(False))
    sentences = F.split(F.regexp_replace(F.regexp_replace("_text", END, "$1\n\n"), BLOCK_END, "\n\n"), "\n\n+")
    found = source.select("_id", F.when(speaks, F.transform(sentences, _readings)).alias("_read"))
    found = found.select("_id", F.coalesce(F.flatten(F.transform("_read", _best)), F.array().cast("array<string>")).alias("_ids"))
    found = found.withColumn("_left", F.when(F.size("_ids") > 0, F.concat(F.lit("|"), F.array_join("_ids", "|"))).otherwise(""))
    # each rule reads what the earlier ones have left
    hits = []
    left = F.col("_left")
    work = found
    for n, (licence, identifiers) in enumerate(RULES):
        pattern = spaced_pattern(identifiers)
        work = work.withColumn(f"_hit{n}", F.when(left.rlike(pattern), licence)).withColumn("_left", F.regexp_replace(left, pattern, "$1"))
        hits.append(F.col(f"_hit{n}"))
    licences = F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), ";")
    unknown = F.size(F.filter("_ids", lambda i: i == "unknown")).cast("long")
    return work.select(
        F.col("_id").alias(id_col),
        F.when(F.size("_ids") > 0, F.concat(F.lit("|"), F.array_join("_ids", "|"), F.lit("|"))).otherwise("").alias("sentence_ids"),
        F.when(licences != "", licences).when(F.size("_ids") > 0, "UNKNOWN").otherwise("NONE").alias("licenses"),
        (F.size("_ids").cast("long") - unknown).alias("n_known"),
        unknown.alias("n_unknown"),
    )


def duckdb_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = "translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = f"regexp_replace(trim(regexp_replace({low}, {quote(NOISE)}, ' ', 'g')), '[. ]+$', '')"
    cases = " ".join(f"WHEN regexp_matches(t, {quote(f'^({p})$')}) THEN {quote(n)}" for n, p in SENTENCES)
    steps = [
        f"""found AS (
  SELECT doc_id, list_transform(list_transform(list_filter(string_split(regexp_replace(coalesce(text, ''), {quote(END)}, '\\1' || chr(10), 'g'), chr(10)),
         lambda s: regexp_matches(s, {quote(HINT)})), lambda s: {plain}), lambda t: CASE {cases} ELSE 'unknown' END) AS ids FROM {table})""",
        "r0 AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN '|' || array_to_string(ids, '|') ELSE '' END AS l, CAST([] AS VARCHAR[]) AS hits FROM found)",
    ]
    for n, (licence, identifiers) in enumerate(RULES):
        p = quote(sequence_pattern(identifiers))
        steps.append(f"r{n + 1} AS (SELECT doc_id, ids, regexp_replace(l, {p}, '\\1', 'g') AS l, CASE WHEN regexp_matches(l, {p}) AND NOT list_contains(hits, {quote(licence)}) THEN list_append(hits, {quote(licence)}) ELSE hits END AS hits FROM r{n})")
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, CASE WHEN len(ids) > 0 THEN '|' || array_to_string(ids, '|') || '|' ELSE '' END AS sentence_ids,
       CASE WHEN len(hits) > 0 THEN array_to_string(hits, ';') WHEN len(ids) > 0 THEN 'UNKNOWN' ELSE 'NONE' END AS licenses,
       CAST(len(list_filter(ids, lambda i: i <> 'unknown')) AS BIGINT) AS n_known,
       CAST(len(list_filter(ids, lambda i: i = 'unknown')) AS BIGINT) AS n_unknown
FROM r{len(RULES)}"""
