"""Operator 9. License scans by canonical digest, in DataFrame functions only.

A text's canonical form has lower case, no copyright lines, one spelling of equivalent words and single
spaces for all else than letters and digits.  Its SHA-256 is joined to the digests of known license texts.
Whole documents are looked up, and so is each line, since short notices stand as lines of their own.

Known are the texts of ``KNOWN`` and the digests of ``DIGESTS`` (whole texts only), or the caller's own table
``license, text``.

Defined cases: null, empty and all-punctuation texts have no canonical form, a null digest and no license;
very long texts are digested whole; rows that repeat each get a row, and every row, with or without an id, goes by
its own text.  Two known texts of one digest give the smaller name; a known text without a canonical form is no
text.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words taken as equal in license texts.
EQUIVALENT = [
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("licencing", "licensing"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorise", "authorize"),
    ("authorised", "authorized"), ("centre", "center"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilise", "utilize"), ("whilst", "while"), ("wilful", "willful"),
]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Texts and notices of common public licenses, by SPDX name.
KNOWN = [
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

#: Canonical digests of longer public licenses, as a whole, without what follows their terms, and that without their title.
DIGESTS = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", "c876a853e3837603a39d56da29306b74786b34411bf636ce5072eb840e764cab"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("CC0-1.0", "a142ae38742c8c4c35f5fa19e0a40ebfa60fc38535daf9c570ca3d7e012e1e32"),
    ("GFDL-1.3-only", "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7"),
    ("GFDL-1.3-only", "0cb0736777286efc71748df95c0748e42cbf34246d31f42e488fded6114061ce"),
    ("GFDL-1.3-only", "2d328b8240a295bbc2d9b77bef84c19ca01d38c19c33d474a6c9482cbb6b9515"),
    ("GFDL-1.2-only", "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f"),
    ("GFDL-1.2-only", "925dba96dda1b00cd8ff146661df40b6b2a302af5bf2f1243976eddb6d5a8450"),
    ("GFDL-1.2-only", "35ae67113854c89d267fca97775f50c442bcb8b5380e884e6a2b0b79295a8ea3"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0-only", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0-only", "422dc6ece1afadb367f2bcdbf6ac496f4c7ad5c973c45cdd09ae377ceb4c8a12"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0-only", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0-only", "a268f9c0a6d81f308a4286dac3b04b899da32e1ba02acf6eb78972ce623846e1"),
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0-only", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0-only", "ce818a0d5cb7a9a9261f63641713dbb4ca4750284738a6c3f546d86d81a541d2"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0-only", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0-only", "6e6982d8bb4468c5ce7a88e400f1540201513f39e8dd96e3607ee631b813c06f"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1-only", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1-only", "127c98b05c4e2851a27843fcf90984e5592c3841d8a6b7638dbcd00bcefe46dd"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("LGPL-3.0-only", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-1.1", "4af313306d3670f620531dea4ee9151519ff89f0c3dac5c84daf18cd55ac7b08"),
    ("MPL-1.1", "e06cb92a4ee8947f33d9dd6fce18b2a05371123fd565f9f54e1f9f5d6329c022"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-2.0", "7dbba1c8f6e4d81e4b4ad1bb3e11ca28000a384d93b575cd7488bfb9f02c577c"),
    ("MPL-2.0", "ebd3a3e67c4cfd1ff71f0e445a7404e5d5cd8cb6c95d6a0341f62435af9c85cd"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("Artistic-1.0-Perl", "09298ea5f55a44867296b42e98842579815a99e2b295c0aa24cf234134c9ebeb"),
]

#: Lines that name a holder or reserve rights; only whole lines go. Words about copyright within a text's own lines stay.
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{]|by )|©|\(c\)[ \t]*(copyright|[0-9]{4})|all rights reserved[^\p{L}\p{N}\n]*$)[^\n]*$"
_OTHER = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form; null when nothing is left. Rare rewrites run only on texts that hold what they rewrite."""
    low = F.lower(text)
    holder = low.contains("copyright") | low.contains("©") | low.contains("(c)") | low.contains("all rights reserved")
    c = F.when(holder, F.regexp_replace(low, _COPYRIGHT, " ")).otherwise(low)
    # two spaces between words: each word has a space of its own on both sides
    return F.transform(F.array(F.concat(F.lit(" "), F.regexp_replace(c, _OTHER, "  "), F.lit(" "))), _one_spelling)[0]


def _one_spelling(c: Column) -> Column:
    new = c
    for a, b in EQUIVALENT:
        new = F.replace(new, F.lit(f" {a} "), F.lit(f" {b} "))
    other = c.rlike(" (" + "|".join(a for a, _ in EQUIVALENT) + ") ")
    c = F.trim(F.replace(F.when(other, new).otherwise(c), F.lit("  "), F.lit(" ")))
    return F.when(c != "", c)


#: More known texts than this are joined as Spark chooses; more words than this are not worth looking for.
BROADCAST_ROWS, MARKS = 50_000, 64


def _marks(texts: DataFrame) -> list[str] | None:
    """Words of which every known text's canonical form holds one, in all spellings: a line without all of them is none of
    the texts. None where that would be more than ``MARKS`` words, so that every line is looked up."""
    longest = F.array_max(F.transform(F.split(canonical(F.col("text")), " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = [r["w"] for r in texts.select(longest.alias("w")).filter("w is not null").distinct().orderBy("w").limit(MARKS + 1).collect()]
    return None if len(words) > MARKS else sorted({*words, *(a for a, b in EQUIVALENT if b in words)})


def _holds(text: Column, words: list[str] | None) -> Column:
    if words is None:
        return F.lit(True)
    low = F.lower(text)
    return reduce(Column.__or__, [low.contains(w) for w in words], F.lit(False))


def known_licenses(texts: DataFrame) -> DataFrame:
    """``license, digest`` of a table ``license, text``, one row a digest."""
    rows = texts.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).filter("digest is not null")
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def _small(known: DataFrame) -> DataFrame:
    """A hint to broadcast, given after counting."""
    return F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known


def scan(docs: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, digest, license`` (of the whole text) and ``line_licenses`` (of its lines, sorted).

    ``texts`` is a table ``license, text`` of known texts; it takes the place of ``KNOWN`` and ``DIGESTS``."""
    spark: SparkSession = docs.sparkSession
    own = texts is not None
    texts = texts.select("license", "text") if own else spark.createDataFrame(KNOWN, "license string, text string")
    of_lines = known_licenses(texts)
    of_texts = of_lines if own else of_lines.unionByName(spark.createDataFrame(DIGESTS, "license string, digest string")).groupBy("digest").agg(F.min("license").alias("license"))
    of_lines, of_texts, words = _small(of_lines), _small(of_texts), _marks(texts)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("row", F.xxhash64("doc_id", "text"))
    whole = source.select("doc_id", "row", F.sha2(canonical(F.col("text")), 256).alias("digest")).join(of_texts, "digest", "left")
    lines = source.filter(_holds(F.col("text"), words)).select("row", F.explode(F.split("text", "\n")).alias("line")).filter(_holds(F.col("line"), words))
    lines = lines.select("row", F.sha2(canonical(F.col("line")), 256).alias("digest")).join(of_lines, "digest")
    lines = lines.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"))
    return whole.join(lines, "row", "left").select("doc_id", "digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def oracle() -> str:
    """The same in DuckDB SQL over ``documents``; spellings are taken word by word."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    spelling = "CASE w " + " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in EQUIVALENT) + " ELSE w END"

    def form(x: str) -> str:
        words = f"string_split(trim(regexp_replace(regexp_replace(lower({x}), {quote(_COPYRIGHT)}, ' ', 'g'), {quote(_OTHER)}, ' ', 'g')), ' ')"
        return f"sha256(nullif(array_to_string(list_transform({words}, lambda w: {spelling}), ' '), ''))"

    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    digests = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in DIGESTS)
    return f"""
WITH of_lines AS (SELECT {form("t")} AS digest, min(l) AS license FROM (VALUES {values}) AS v(l, t) GROUP BY 1),
of_texts AS (SELECT digest, min(license) AS license FROM (SELECT digest, license FROM of_lines UNION ALL SELECT d, l FROM (VALUES {digests}) AS v(l, d)) GROUP BY 1),
rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows),
per_row AS (
  SELECT r, array_to_string(list_sort(list_distinct(list(license))), ',') AS line_licenses
  FROM (SELECT r, {form("line")} AS digest FROM lines) JOIN of_lines USING (digest) GROUP BY r
)
SELECT d.doc_id, d.digest, k.license, coalesce(p.line_licenses, '') AS line_licenses
FROM (SELECT r, doc_id, {form("text")} AS digest FROM rows) d
LEFT JOIN of_texts k ON d.digest = k.digest LEFT JOIN per_row p ON d.r = p.r
"""
