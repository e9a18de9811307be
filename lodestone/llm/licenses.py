"""Licence scan by canonical digest lookup, in DataFrame operations only.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space) and its md5 is
looked up among the digests of known licence texts, which are normalised the same way. Looked up are the entire text of a
document and, as entire texts too, each of its lines, since notices stand on a line of their own.

Known are the notices and bodies in KNOWN and the whole texts in the folder license_texts, each with and without its title, heading,
appendix, list numbers and older postal addresses: a fixed list of some hundred digests, so the join side has a proven bound. The
lookup of whole texts also leaves out what holders fill in: copyright lines without a year, 'all rights reserved' lines, the names
in the clauses of NAMES, a copyright notice of up to 400 characters that shares its line with the first words of a licence, and whether
links are https. text_digest keeps these, but loses all of a line that begins with a copyright notice and a year. Texts that are edited otherwise, and licences that are not in the
list, are not recognised.

Result: one row for each document, with the digest of the whole text, the licence of the whole text (null if unknown),
the sorted distinct licences of its lines joined by commas ('' if none), and the count of matching lines. Null or empty texts,
and texts that normalise to nothing, have a null digest and match nothing. Rows that are repeated are each reported. Other
columns are ignored.
"""

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, in the order in which they are replaced.
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("favour", "favor"), ("authorisation", "authorization"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"),
    ("whilst", "while"), ("wilful", "willful"), ("copyright owner", "copyright holder"), ("redistributions", "redistribution"),
]

# Notices and short licence texts.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]

# A line that holds no more than a copyright statement; \n keeps it to whole lines in either engine.
COPYRIGHT_LINE = r"\n[ \t]*(copyright|\(c\)|©)[^\n]*[0-9][0-9][0-9][0-9][^\n]*"

# What the lookup of whole texts leaves out besides: a line of its own that names the holder, with a year or not, or reserves rights.
OWNER_LINE = r"\n[ \t#*/;-]*(?:(?i:copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*|(?i:copyright)[ \t:]*(?:\([cC]\)|©)[^\n]*|©[^\n]*|Copyright (?!(?i:licen|and |holder|owner|notice|law))[^\n]*|(?i:all rights? reserved)[ \t\r.*/#]*)(?=\n|\z)"

# A notice that shares its line with the licence: what stands from the notice to the words the licence begins with.
NOTICE = r"(?i)\n[ \t#*/;-]*(?:copyright|\(c\)|©)(?:(?!permission is hereby|permission to use|redistribution and use|licensed under|released under|this software is|this work is)[^\n]){0,400}(?=permission is hereby|permission to use|redistribution and use|licensed under|released under|this software is|this work is)"

# Clauses of the normal form in which holders put their own names, and what stands for them.
NAMES = [
    (r"neither the names? of .{1,200}? nor the names? of (its|the|any|other) contributors", "neither the name of x nor the names of its contributors"),
    (r"this software is provided by .{1,200}? as is", "this software is provided by x as is"), (r"in no event shall .{1,200}? be liable", "in no event shall x be liable"),
]

# Texts without any of these are their own lookup form.
FILLED = r"(?i)copyright|©|\(c\)|rights? reserved|https://|neither\W+the\W+name|software\W+is\W+provided\W+by|in\W+no\W+event\W+shall"

TEXTS = Path(__file__).parent / "license_texts"

# Titles that stand above texts that do not hold one.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "Expat License", "This software is released under the MIT license:", "License: MIT"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "BSD License", "The BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng license"], "Unlicense": ["The Unlicense", "Unlicense"], "Apache-2.0": ["The Apache License"],
}

# Where the texts that hold a heading begin and end without it and without what explains their use.
BEGINS = {"Apache-2.0": "TERMS AND CONDITIONS FOR USE", "BSL-1.0": "Permission is hereby granted", "MPL-2.0": "1. Definitions"}
ENDS = [r"[ \t]*END OF TERMS AND CONDITIONS", r"[ \t]*(APPENDIX|Appendix): How to", r"[ \t]*How to Apply These Terms", r"EXHIBIT A ?-", r"Exhibit A -", r"For more information, please refer"]
ADDRESS = r"51 Franklin St(reet)?,\s+Fifth Floor,\s+Boston,? MA\s+02110-1301,?\s+USA"
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA"]


def _forms(name: str, text: str) -> set[str]:
    """The forms in which a whole text is handed on."""
    out = {text} | {text[: m.start()] for e in ENDS for m in re.finditer(rf"(?m)^{e}", text)}
    out |= {text[: m.end()] for m in re.finditer(rf"(?m)^{ENDS[0]}", text)}
    out |= {t[t.index(BEGINS[name]) :] for t in out} if name in BEGINS else set()
    out |= {re.sub(r"(?m)^[ \t]*[0-9]\.[ \t]", "", t) for t in out} if name.startswith("BSD") or name == "Zlib" else set()
    out |= {re.sub(ADDRESS, a, t) for t in out for a in ADDRESSES}
    out |= {re.sub("(licenses|philosophy)/why-not-lgpl", f"{at}/why-not-lgpl", t) for t in out for at in ("licenses", "philosophy")}
    return out | {f"{title}\n\n{t}" for t in out for title in TITLES.get(name, [])}


def known_texts() -> list[tuple[str, str]]:
    """Licence and text; files NAME_2 and so on hold other issues of the text of NAME."""
    texts = [(f.stem.split("_")[0], f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    whole = [(name, t) for name, t in KNOWN] + [(name, form) for name, text in texts for form in sorted(_forms(name, text))]
    return list(dict.fromkeys(whole))


def _normal(text: Column) -> Column:
    t = F.concat(F.lit("\n"), F.lower(text))
    t = F.regexp_replace(t, COPYRIGHT_LINE, "")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def _bare(text: Column) -> Column:
    """The normal form without what holders fill in."""
    t = F.regexp_replace(F.concat(F.lit("\n"), text), NOTICE, "\n")
    t = _normal(F.replace(F.regexp_replace(t, OWNER_LINE, ""), F.lit("https://"), F.lit("http://")))
    for a, b in NAMES:
        t = F.regexp_replace(t, a, b)
    return t


def _digested(df: DataFrame, text: str, name: str, normal=_normal) -> DataFrame:
    """df with a text column replaced by its digest; the normal form is a column in between, so that it is made once."""
    n = f"__{name}"
    return df.withColumn(n, normal(F.col(text))).withColumn(name, F.when(F.col(n) != "", F.md5(n))).drop(n, text)


def known_digests(spark) -> DataFrame:
    """Of entire lines; a text of many lines is known on one line too."""
    lines = [(name, " ".join(text.split())) for name, text in known_texts()]
    return _digested(spark.createDataFrame(lines, "license string, body string"), "body", "digest").distinct()


def known_whole(spark) -> DataFrame:
    """Of whole texts, in the lookup form."""
    return _digested(spark.createDataFrame(known_texts(), "license string, body string"), "body", "digest", _bare).distinct()


def scan(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    known = F.broadcast(known_digests(spark))  # the fixed list above
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", lines.alias("lines"))
    rows = rows.withColumn("filled", F.when(F.col("text").rlike(FILLED), F.col("text")))
    rows = _digested(_digested(rows, "text", "text_digest"), "filled", "bare", _bare)  # null where text_digest serves
    units = _digested(rows.select("row", "doc_id", "text_digest", "bare", F.explode_outer("lines").alias("line")), "line", "digest")
    found = units.join(known.withColumnRenamed("license", "notice"), "digest", "left")
    # rows of a document leave the scan together: the partial aggregate leaves one row of each
    each = found.groupBy("row", "doc_id", "text_digest", "bare").agg(
        F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("line_licenses"), F.count("notice").alias("n_license_lines")
    )
    each = each.withColumn("lookup", F.coalesce("bare", "text_digest"))
    whole = F.broadcast(known_whole(spark)).select(F.col("license").alias("text_license"), F.col("digest").alias("lookup"))
    return each.join(whole, "lookup", "left").select("doc_id", "text_digest", "text_license", "line_licenses", "n_license_lines")


def _sql_normal(text: str) -> str:
    t = f"regexp_replace(chr(10) || lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
    t = f"' ' || trim(regexp_replace({t}, '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        t = f"replace({t}, ' {a} ', ' {b} ')"
    return f"trim({t})"


def _sql_digest(text: str) -> str:
    return f"CASE WHEN {_sql_normal(text)} <> '' THEN md5({_sql_normal(text)}) END"


def oracle() -> str:
    body = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
    WITH known AS (SELECT DISTINCT license, {_sql_digest('body')} AS digest FROM (VALUES {body}) v(license, body)),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    hits AS (SELECT l.doc_id, k.license FROM lines l JOIN known k ON {_sql_digest('l.line')} = k.digest),
    each AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS ls, count(*) AS n FROM hits GROUP BY doc_id)
    SELECT d.doc_id, {_sql_digest('d.text')} AS text_digest, k.license AS text_license, coalesce(e.ls, '') AS line_licenses,
           coalesce(e.n, 0) AS n_license_lines
    FROM documents d LEFT JOIN each e USING (doc_id) LEFT JOIN known k ON {_sql_digest('d.text')} = k.digest"""
