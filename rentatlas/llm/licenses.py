"""Licence scans by sentence rules.

Texts are cut into sentences, at blank lines and sentence ends; wrapped lines belong together. Each
sentence is normalised and yields the identifiers of all known licence sentences it holds, from left
to right, and the sequence of identifiers of a text is matched against licence rules in order; what
a rule has matched is used up. All of it is one projection of built-in functions.

The checking SQL cuts at every line break and colon and names one licence sentence per piece, so it
agrees on notices of one line only; the wrapped licence texts are held by the tests.

Defined results: a missing text has no sentences; repeated rows repeat their result; an empty table
yields no rows; texts of any length are read whole; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentatlas.llm.common import text_of

#: A text or sentence without any of these holds no known sentence and is not looked at further.
STEMS = (
    "(?i)licen[cs]|copyright|permission|redistribut|public domain|creative commons|spdx|cc.?by|cc0"
    "|software is provided|all rights|any later version|neither the name of"
)
SENTENCE_END = r"[.!?;:]+[ \t\r]+|[\r\n]+"

# Known licence sentences: identifier and what the normalised sentence must contain. The first
# one that fits names the sentence. Fixed values, from the published licence texts and notices.
SENTENCES = [
    ("SPDX-Apache-2.0", "spdx license identifier apache 2 0"),
    ("SPDX-MIT", "spdx license identifier mit"),
    ("SPDX-GPL-3.0", "spdx license identifier gpl 3 0"),
    ("SPDX-GPL-2.0", "spdx license identifier gpl 2 0"),
    ("ApacheNotice-2.0", "licensed under the apache license version 2 0"),
    ("ApacheNotice", "licensed under the apache license"),
    ("ApacheCopy", "you may not use this file except in compliance with the license"),
    ("ApacheLimits", "see the license for the specific language governing permissions"),
    ("MITNotice", "(released|licensed|distributed|available) under the( terms of the)? mit license"),
    ("MITGrant", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("MITKeep", "the above copyright notice and this permission notice shall be included"),
    ("AsIs", "software is provided as is"),
    ("LGPLNotice-3.0", "gnu lesser general public license version 3"),
    ("LGPLNotice-2.1", "gnu lesser general public license version 2 1"),
    ("AGPLNotice-3.0", "gnu affero general public license version 3"),
    ("GPLNotice-3.0", "gnu general public license version 3"),
    ("GPLNotice-2.0", "gnu general public license version 2"),
    ("GPLNotice", "gnu general public license"),
    ("GPLLater", "at your option any later version"),
    ("BSDRedist", "redistribution and use in source and binary forms"),
    ("BSDSource", "redistributions of source code must retain"),
    ("BSDBinary", "redistributions in binary form must reproduce"),
    ("BSDName", "neither the name of .* may be used to endorse"),
    ("MPLNotice-2.0", "mozilla public license v(ersion)? ?2 0"),
    ("CC-BY-NC-4.0", "cc by nc 4 0|creative commons attribution noncommercial 4 0"),
    ("CC-BY-NC", "cc by nc( [0-9] [0-9])?$|creative commons attribution noncommercial"),
    ("CC-BY-SA-4.0", "cc by sa 4 0|creative commons attribution sharealike 4 0"),
    ("CC-BY-SA", "cc by sa( [0-9] [0-9])?$|creative commons attribution sharealike"),
    ("CC-BY-4.0", "cc by 4 0|creative commons attribution 4 0"),
    ("CC-BY", "cc by( [0-9] [0-9])?$|creative commons attribution"),
    ("CC0", "cc0|dedicated to the public domain"),
    ("AllRights", "all rights reserved"),
    ("Copyright", "^copyright (c )?[0-9]{4}"),
]

# A sentence ends at a blank line, be it in a comment, and behind its mark; not behind an initial or
# a short form such as "v." or "Inc.", nor where the text goes on with a small letter. A run of marks
# is tried once, from its first mark and as a whole, so long runs take no more than their length.
SENTENCE_CUT = (
    r"(?<![.!?])(?<!\b(?i:[a-z]|inc|ltd|llc|corp|co|ver|vers))[.!?]++(?=\s)(?![\s*#/;%|-]*+[a-z])"
    r"|(?:\r\n|\r(?!\n)|\n)[ \t*#/;%|-]*(?=[\r\n])"
)
# Places within a sentence that end a line or a clause: phrases run over them, "^" and "$" hold there.
SOFT_END = r"(?<![.!?;:])[.!?;:]++[ \t\r]+|[\r\n]+"
# The stems as they look across wrapped lines and comment marks.
WRAPPED_STEMS = (
    r"(?i)licen[cs]|copyright|permission|redistribut|public\W+domain|creative\W+commons|spdx"
    r"|cc\W{0,8}by|cc0|software\W+is\W+provided|all\W+rights|any\W+later\W+version"
    r"|neither\W+the\W+name\W+of"
)



def spanning(opening: str, closing: str) -> str:
    """From the last opening before a closing to that closing, whatever stands between them.

    A search ends at the next opening, so many openings without a closing are still read once.
    """
    return f"{opening}(?:(?!{opening}).)*?{closing}"


# Wordings of the published texts beside the one-line forms of ``SENTENCES``.
_FSF = "( as published by the free software foundation)?( either)? version"
PUBLISHED = {
    "ApacheNotice-2.0":
        "licensed under the apache license version 2 0|apache license version 2 0 january 2004",
    "AsIs": "software is provided as is|" + spanning("software is provided by ", " as is"),
    "LGPLNotice-3.0": f"gnu lesser general public license{_FSF} 3",
    "LGPLNotice-2.1": f"gnu lesser general public license{_FSF} 2 1",
    "AGPLNotice-3.0": f"gnu affero general public license{_FSF} 3",
    "GPLNotice-3.0": f"gnu general public license{_FSF} 3|version 3 of the gnu general public license",
    "GPLNotice-2.0": f"gnu general public license{_FSF} 2|version 2 of the gnu general public license",
    "BSDName": spanning("neither the name of ", " may be used to endorse"),
}
# The patterns over lines: a space stands for a space or a line end.
PHRASES = [
    (name, PUBLISHED.get(name, pattern).replace(" ", "\\s")) for name, pattern in SENTENCES
]
ANY_PHRASE = "(?ms)" + "|".join(f"(?:{pattern})" for _, pattern in PHRASES)

# Licence rules in the order they are tried: licence and the identifiers that prove it, in order.
RULES = [
    ("Apache-2.0", ";ApacheNotice-2\\.0;(ApacheCopy;)?(ApacheLimits;)?"),
    ("Apache-2.0", ";SPDX-Apache-2\\.0;"),
    ("Apache", ";ApacheNotice;(ApacheCopy;)?(ApacheLimits;)?"),
    ("MIT", ";MITGrant;(MITKeep;)?(AsIs;)?"),
    ("MIT", ";(MITNotice|SPDX-MIT);"),
    ("BSD-3-Clause", ";BSDRedist;BSDSource;BSDBinary;BSDName;(AsIs;)?"),
    ("BSD-2-Clause", ";BSDRedist;BSDSource;BSDBinary;(AsIs;)?"),
    ("LGPL-3.0", ";LGPLNotice-3\\.0;(GPLLater;)?"),
    ("LGPL-2.1", ";LGPLNotice-2\\.1;(GPLLater;)?"),
    ("AGPL-3.0", ";AGPLNotice-3\\.0;(GPLLater;)?"),
    ("GPL-3.0-or-later", ";GPLNotice-3\\.0;GPLLater;"),
    ("GPL-2.0-or-later", ";GPLNotice-2\\.0;GPLLater;"),
    ("GPL-3.0", ";(GPLNotice-3\\.0|SPDX-GPL-3\\.0);"),
    ("GPL-2.0", ";(GPLNotice-2\\.0|SPDX-GPL-2\\.0);"),
    ("GPL", ";GPLNotice;(GPLLater;)?"),
    ("MPL-2.0", ";MPLNotice-2\\.0;"),
    ("CC-BY-NC-4.0", ";CC-BY-NC-4\\.0;"),
    ("CC-BY-NC", ";CC-BY-NC;"),
    ("CC-BY-SA-4.0", ";CC-BY-SA-4\\.0;"),
    ("CC-BY-SA", ";CC-BY-SA;"),
    ("CC-BY-4.0", ";CC-BY-4\\.0;"),
    ("CC-BY", ";CC-BY;"),
    ("CC0-1.0", ";CC0;"),
    ("Proprietary", ";(Copyright;)?AllRights;"),
]


def normalised(sentence: Column) -> Column:
    """Lower-case letters and digits in words one space, or one line end, apart."""
    lines = F.regexp_replace(F.lower(sentence), SOFT_END, "\n")
    words = F.regexp_replace(lines, "[^a-z0-9\n]+", " ")
    return F.trim(F.regexp_replace(words, " ?\n[ \n]*", "\n"))


def phrase_name(phrase: Column) -> Column:
    """Identifier of what ``ANY_PHRASE`` has found: the first that fits from its beginning."""
    name = F.lit(None).cast("string")
    for identifier, pattern in reversed(PHRASES):
        name = F.when(phrase.rlike(f"(?ms)\\A(?:{pattern})"), identifier).otherwise(name)
    return name


def known_sentences(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in their order."""
    sentences = F.filter(F.split(text, SENTENCE_CUT), lambda s: s.rlike(WRAPPED_STEMS))
    found = F.flatten(F.transform(
        sentences,
        lambda s: F.transform(
            F.regexp_extract_all(normalised(s), F.lit(ANY_PHRASE), F.lit(0)), phrase_name
        ),
    ))
    none = F.array().cast("array<string>")
    return F.when(text.rlike(WRAPPED_STEMS), found).otherwise(none)


def licences_of(names: Column) -> Column:
    """Licences the identifiers prove; each rule takes the identifiers it has matched away."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("rule")) for n, p in RULES])
    # Identifiers stand between doubled marks, so that neighbours can match rules of their own.
    start = F.struct(
        F.concat(F.lit(";"), F.array_join(names, ";"), F.lit(";")).alias("left"),
        F.array().cast("array<string>").alias("found"),
    )

    def step(state: Column, rule: Column) -> Column:
        hit = F.regexp_like(state["left"], rule["rule"])
        return F.struct(
            F.when(hit, F.regexp_replace(state["left"], rule["rule"], F.lit(";")))
            .otherwise(state["left"]).alias("left"),
            F.when(hit, F.array_append(state["found"], rule["name"]))
            .otherwise(state["found"]).alias("found"),
        )

    found = F.aggregate(rules, start, step, lambda s: F.array_distinct(s["found"]))
    return F.when(F.size(names) > 0, found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, the known sentences and the licences of every row, as arrays."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), known_sentences(text_of()).alias("sentences")
    )
    return named.select("doc_id", "sentences", licences_of(F.col("sentences")).alias("licences"))


def sequences(found: DataFrame) -> DataFrame:
    """The arrays of ``scan`` as text, with the number of known sentences."""
    return found.select(
        "doc_id", F.size("sentences").alias("n_sentences"),
        F.array_join("sentences", ";").alias("sentences"),
        F.array_join("licences", ",").alias("licences"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same result by unnesting sentences and by one query level per rule."""
    cases = " ".join(
        f"WHEN regexp_matches(s, {_quoted(p)}) THEN {_quoted(n)}" for n, p in SENTENCES
    )
    worth = _quoted(STEMS)
    level = (
        "SELECT doc_id, n, names, ';' || coalesce(names, '') || ';' AS rest, '' AS got FROM named"
    )
    for name, rule in RULES:
        hit = f"n > 0 AND regexp_matches(rest, {_quoted(rule)})"
        add = (
            f"CASE WHEN list_contains(string_split(got, ','), {_quoted(name)}) THEN got"
            f" WHEN got = '' THEN {_quoted(name)} ELSE got || ',' || {_quoted(name)} END"
        )
        level = (
            f"SELECT doc_id, n, names, CASE WHEN {hit} THEN regexp_replace(rest, {_quoted(rule)},"
            f" ';', 'g') ELSE rest END AS rest, CASE WHEN {hit} THEN {add} ELSE got END AS got"
            f" FROM ({level})"
        )
    return (
        "WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text"
        " FROM documents), cut AS (SELECT rn, unnest(parts) AS s, generate_subscripts(parts, 1) AS"
        f" i FROM (SELECT rn, string_split_regex(text, '{SENTENCE_END}') AS parts FROM docs WHERE"
        f" regexp_matches(text, {worth}))),"
        " plain AS (SELECT rn, i, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s"
        f" FROM cut WHERE regexp_matches(s, {worth})), hits AS (SELECT rn, i, CASE {cases} END AS name FROM plain),"
        " lists AS (SELECT rn, string_agg(name, ';' ORDER BY i) AS names, count(name) AS n FROM"
        " hits GROUP BY rn), named AS (SELECT d.doc_id, names, coalesce(n, 0) AS n FROM docs d"
        " LEFT JOIN lists l ON d.rn = l.rn) SELECT doc_id, cast(n AS int) AS n_sentences,"
        f" coalesce(names, '') AS sentences, got AS licences FROM ({level})"
    )
