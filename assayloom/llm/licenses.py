"""Licence scan by canonical digests.

A text is brought to a canonical form (letters A-Z in lower case, equivalent spellings made one,
copyright statements removed, punctuation and white space as single spaces), its SHA-256 digest is
hash-joined to the digests of known licences and notices. Whole texts are looked up (with and
without a title line at their start), and each of their paragraphs and lines as whole texts of
their own, since notices stand in other texts. Full licences run over several paragraphs and
stand inside other texts too: their canonical body is searched as a run of words in the canonical
form of the whole text, however it is wrapped or parted. Templates with a holder's name inside
the body are known only in the spelling of KNOWN and license_texts.

Defined cases: null and empty texts, and units that are empty in canonical form, match nothing;
texts of any length are read whole (units longer than any known licence cannot match and are
not hashed); rows with equal doc_id are scanned each on its own; extra columns play no part.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.session import constant_table

# Public licence texts and the usual one-line notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with
or without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with
or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no
event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the
original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This
notice may not be removed or altered from any source distribution.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
}
# Published files, and where the body begins and ends (the file's own, if empty).
FULL_TEXTS = {
    "Apache-2.0": ("TERMS AND CONDITIONS FOR USE", "END OF TERMS AND CONDITIONS"),
    "BSD-2-Clause": ("", ""),
    "BSD-3-Clause": ("", ""),
    "GPL-2.0": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "GPL-3.0": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "LGPL-2.1": ("Preamble", "END OF TERMS AND CONDITIONS"),
    "LGPL-3.0": ("This version of the GNU Lesser", ""),
    "MPL-2.0": ("1. Definitions", ""),
}
# Spellings that count as one, in this order, on lower-case text.
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("authoris", "authoriz"),
    ("acknowledgement", "acknowledgment"), ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"),
    ("https://", "http://"), ("©", "copyright"), ("(c)", "copyright"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright [^\n]*|all rights reserved[^\n]*)"
_REST = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
# Fixed value: titles at the start of a licence file, in canonical form.
_TITLE = (
    "^(the )?(mit|expat|isc|zlib|0bsd|bsd zero clause|(new |simplified |revised |modified )?bsd"
    "( [23] clause)?|[23] clause bsd) license (mit |isc |zlib |0bsd )?"
)
# Fixed value: words that follow "copyright" where a licence speaks of it, not where one is stated.
_SPEAKS = ("notice", "holder", "owner", "ownership", "statement", "law", "license", "permission",
           "interest", "disclaimer", "treaty", "treatie")


@lru_cache(maxsize=1)
def full_texts() -> tuple[tuple[str, str, str], ...]:
    """(name, whole file, body) of every full licence; lists of clauses with and without numbers."""
    out = [(n, t, t) for n, t in KNOWN.items() if "notice" not in n]
    for name, (first, last) in FULL_TEXTS.items():
        text = (Path(__file__).parent / "license_texts" / f"{name}.txt").read_text("utf-8")
        start = text.index(first)
        out.append((name, text, text[start:text.index(last, start) if last else len(text)]))
        if name.startswith("BSD"):
            bare = re.sub(r"(?m)^ *\d\. ", "", text)
            out.append((name, bare, bare))
    return tuple(out)


def _speaking() -> str:
    """Pattern of what follows "copyright" inside the known texts, so that no wrap loses a line."""
    pairs = set()
    for text in [*KNOWN.values(), *(body for _, _, body in full_texts())]:
        text = text.lower()
        for old, new in SPELLINGS:  # a list item (c) reads as copyright, too
            text = text.replace(old, new)
        words = re.findall("[a-z0-9]+", text)
        pairs.update(zip(*(words[i:] for i in range(3))))
    own = {(b, c) for a, b, c in pairs if a == "copyright"
           and b.removesuffix("s") not in _SPEAKS and b not in ("copyright", "year", "yyyy") and not b.isdigit()}
    return "|".join([*(f"{w}s?\\b" for w in _SPEAKS),
                     *(f"{b}[^a-z0-9]+{c}\\b" for b, c in sorted(own))])


def _statement_line() -> str:
    """As _COPYRIGHT_LINE, but lines of a licence's body that begin with "copyright" stay."""
    return (r"(^|\n)[ \t#*/;-]*(copyright (?!" + _speaking()
            + r")[^\n]*|all rights reserved[^\n]*)")


def canonical(text: Column) -> Column:
    out = F.translate(text, _UPPER, _LOWER)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, _statement_line(), "\n")
    return F.trim(F.regexp_replace(out, _REST, " "))


def _canonical_sql(text: str) -> str:
    out = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    out = f"regexp_replace({out}, '{_COPYRIGHT_LINE}', chr(10), 'g')"
    return f"trim(regexp_replace({out}, '{_REST}', ' ', 'g'))"


def units(text: Column) -> Column:
    """The whole text, its paragraphs and its lines, each once."""
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(
        F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    )


def known_digests(spark) -> DataFrame:
    """``digest, license, size``: one row per known text."""
    full = full_texts()
    texts = constant_table(spark, {
        "license": ("string", [*KNOWN, *(n for n, _, _ in full), *(n for n, _, _ in full)]),
        "text": ("string", [*KNOWN.values(), *(w for _, w, _ in full), *(b for _, _, b in full)]),
    })
    form = canonical(F.col("text"))
    return texts.select(
        F.sha2(form, 256).alias("digest"), "license", F.length(form).alias("size")
    ).distinct()


def _bodies(spark) -> list[tuple[str, str]]:
    """(name, canonical body) of every full licence: a fixed list of a few rows."""
    full = full_texts()
    rows = constant_table(spark, {"license": ("string", [n for n, _, _ in full]),
                                  "text": ("string", [b for _, _, b in full])})
    return sorted({(r.license, r.form) for r in
                   rows.select("license", canonical(F.col("text")).alias("form")).collect()})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, licenses (sorted names, comma-joined, empty if none),
    n_licenses, and whole_text: the entire text is a known licence."""
    known = known_digests(docs.sparkSession)
    limits = known.agg(F.min("size"), F.max("size")).first()  # one row, of a fixed list
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint"),
        F.col("text").cast("string"),
    ).select("row", "doc_id", F.posexplode(units(F.col("text"))).alias("at", "unit"))
    form = canonical(F.col("unit"))
    padded = F.concat(F.lit(" "), F.col("form"), F.lit(" "))
    inside = F.array_compact(F.array(*(
        F.when((F.length("form") >= len(body)) & F.contains(padded, F.lit(f" {body} ")), name)
        for name, body in _bodies(docs.sparkSession)
    )))
    untitled = F.when(F.col("at") == 0, F.regexp_replace("form", _TITLE, "")).otherwise(F.col("form"))
    # A canonical form is no longer than its text, but a copyright sign may grow to a word.
    looked_up = rows.select("row", "doc_id", "at", form.alias("form")).select(
        "row", "doc_id", "at", F.when(F.col("at") == 0, inside).alias("inside"),
        untitled.alias("form"),
    ).select(
        "row", "doc_id", "at", "inside",
        F.when(F.length("form").between(limits[0], limits[1]), F.sha2("form", 256)).alias("digest"),
    )
    # The known digests are a constant list of a few rows.
    found = looked_up.join(F.broadcast(known.drop("size")), "digest", "left")
    return found.groupBy("row", "doc_id").agg(
        F.collect_set("license").alias("units"), F.max("inside").alias("inside"),
        F.max((F.col("license").isNotNull() & (F.col("at") == 0))).alias("whole_text"),
    ).select(
        "doc_id", F.array_sort(F.array_union("units", "inside")).alias("names"), "whole_text",
    ).select(
        "doc_id", F.array_join("names", ",").alias("licenses"),
        F.size("names").alias("n_licenses"), "whole_text",
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""WITH known AS (
  SELECT license, sha256({_canonical_sql('text')}) AS digest
  FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in KNOWN.items())}) k(license, text)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, doc_id, true AS whole, text AS unit FROM d
  UNION ALL SELECT r, doc_id, false, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) FROM d
  UNION ALL SELECT r, doc_id, false, unnest(string_split(text, chr(10))) FROM d),
h AS (SELECT r, doc_id, whole, sha256({_canonical_sql('unit')}) AS digest FROM u)
SELECT doc_id, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses,
  CAST(count(DISTINCT license) AS INTEGER) AS n_licenses,
  bool_or(license IS NOT NULL AND whole) AS whole_text
FROM h LEFT JOIN known USING (digest) GROUP BY r, doc_id"""
