"""Licence scans by canonical digest lookup.

A text and each known licence go through one normalisation: lower case; copyright lines out where a
year, mark or holder follows; list marks out; punctuation and white space to single spaces;
equivalent spellings made one; a title before the text and the holder's name inside it out.  The
SHA-256 of the result is hash-joined to the digests of the known licences (``license``).

Whole texts are compared, so a licence quoted inside other prose isn't found that way.  Files often
carry a one-line notice instead; every line that names a licence goes through the same lookup
against the digests of known notices (``notices``).

The known table is a parameter, (license, text) rows; its default is a table of digests.  Copies of
one licence may be a third of all rows: the join has the known digests, one row each, on its other
side, and they are broadcast only below ``BROADCAST_ROWS`` rows of fixed width (else the join is
left to the optimiser, which splits skewed partitions).

Defined results: null text counts as empty; an empty text matches nothing; of known texts that
normalise alike the name that sorts first is reported; notices are distinct, in order of name; every
row gives a row; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import text_or_empty

BROADCAST_ROWS = 10_000

#: SHA-256 of the normal forms of public licence texts, by SPDX name.
DIGESTS = {
    "0BSD": ("342fe583c6ef0310b5ba2e1153a21da3dc23009bbb54543a4995a545654c470f",),
    "Apache-2.0": (
        "24ba171ebbbd6eca7b8e3ff38b568cbcf55acee49ca31ff39168122f6ddc98fe",
        "7a46cf4a5d56898d746584f4fe57bdf571d600a8f39d21063431d88929f803c7",
        "a90d314b38bc929584b450323ba681c3b92aad865d69b8fc496a63a99735f409",
        "d4660dd61c430428a5a8a94b10068fbbbf015ab69577e38e518d54f2a6b291c6",
        "f213b407df637bc294997de205aecfc82e06a5e4ef6d75893ec348ca26dd13c2",
    ),
    "Artistic-1.0-Perl": ("4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651",),
    "BSD-2-Clause": ("fd0ad3b700184692cbb784accb0a0c07da669851b06353d096636a566134b3ee",),
    "BSD-3-Clause": ("610fc0ac89b9ef6c8019d159b7df37979ec705d8513ba8c923d7089ef59a07e1",),
    "BSL-1.0": ("5ecfa549edc94e370c690ca3ae5cfecfb658cc4658e827e312bea1603d016e3d",),
    "BlueOak-1.0.0": ("9d112ef603d3207d4e033c8a2a46961291832b2ee49b6047ca349781c7898a95",),
    "CC0-1.0": ("39d45f9c62b038145006a228a201a41f601ba17dc8b3133443fa291466ba1913",),
    "GFDL-1.2": ("75207116182dc7a457379a4cb40f9bbbcf06e960e67994a1357280e949aef260",),
    "GFDL-1.3": ("e5dd78ecf7abe7a3268324a0dc7eb16d93d111fd8823b8fe0d390a7e23c7fb85",),
    "GPL-1.0": ("e8685e919e5ea52b9ef2660fa789d96721c62ad4128cf24e5eef964e6d7085a4",),
    "GPL-2.0": (
        "2250f729249146467e03b43f22c5826a4b44a12c7242c65acc6644a613f7f183",
        "4c29518bd35fe371ce8a627de5ecaaa3fab03f78bc4e258df856a35051046e5f",
        "8879c2ca4a9c17295f106da20624f5ffc10c5d11eaa5d6dad5a0800f163ef74a",
    ),
    "GPL-3.0": (
        "32f08d9193a6ad096f5096c48087500767badf0f9783d28353881bb41c21253f",
        "ef2c49c0ccbb7200618ccd69ead6a05e43691b0868c0e28b0edc8518d1f983d8",
    ),
    "ISC": (
        "82def1f20e50700d40b3098b99612b6b82e644e1076e77e773d45feb5f8d786f",
        "b39a3e1d0c79e5f52a6dc5e879c0a912961996e28c2abce32da8598a9bddf25f",
    ),
    "LGPL-2.0": (
        "4c34e1afe24da5481e6368398641dc9b1e911208e4c78ab5b191837a21782507",
        "8de543235202115e36f5fb7d044be23106478821be1b7c988dda8533ccd1b667",
    ),
    "LGPL-2.1": (
        "8fcd2ca38a931102750cac6729e4336fa32936dfde83c9aae6ad4b57d5df65b1",
        "b79ef74459f8d483aa94a90a268840b077eb7b8b459896dc4e407cc534d96ca5",
    ),
    "LGPL-3.0": ("cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",),
    "MIT": ("aa9626e471f65dbcb5d97dd168d16f67e8f3696c4a817adbcd1d7c8a663307d5",),
    "MPL-1.1": ("a1ea0c4b634aa7b4256d56525c941092a1facf7d3e96c4ecb68ba71bc6744f7d",),
    "MPL-2.0": ("8dce888cb942d93cebeb8e0fea8afac43e084f54254ac4d9b99cfde68a62468b",),
    "Unicode-3.0": ("4bb3117c65f36e3c77a54c546cca06f74d09f8a3e46d5176c794ad4cb73db0c3",),
    "Unlicense": ("8fde3c11aec6ded4f889c924240dd03f35259bde7ffe3722a320e3f190f31643",),
    "WTFPL": ("0f65ef39d26d7352b72163ea61a7839f6973825fa0a5c2914b938205bead0f23",),
    "Zlib": ("9ddc78a5797b5008d488969fd959f4281a97821e07ddc5d19ca9c163fdbeeb73",),
}

#: One-line notices, by SPDX name.
NOTICES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
}
#: Every notice's line holds one of these, whatever its spelling; other lines needn't be looked up.
NOTICE_WORDS = ("licens", "licenc")

#: Steps on the lower-cased text, (pattern, replacement), with the marks one of which a
#: text must hold for the step to matter.  The patterns mean the same in Java and RE2.
LINE_STEPS = (
    (r"(^|\n)[^\S\n]*[/*#;%>|-]*[^\S\n]*((copyright|©|\(c\))[^\S\n:]*(\(c\)|©|[0-9<\[{]|by\b|the [^\n]*(authors|contributors)\b|[^\n]*\b(19|20)[0-9][0-9])[^\n]*|all rights reserved\.?[^\S\n]*(\r?\n|$))|^\s*(copyright|©|\(c\))[^\n]*\n", "\n", ("copyright", "©", "(c)", "all rights reserved")),
    (r"(^|\n)[^\S\n]*[/*#;%>|-]*[^\S\n]*(\(?([0-9]{1,2}|[a-z]|[ivx]{1,4})[.)]|[*•·o-])[^\S\n]+", "\n", ()),
)

#: Equivalent spellings and symbols, after punctuation has become spaces.
SPELLINGS = (
    (" https ", " http "),
    (" acknowledgement", " acknowledgment"),
    (" analogue", " analog"),
    (" analys", " analyz"),
    (" artefact", " artifact"),
    (" authoris", " authoriz"),
    (" calibre", " caliber"),
    (" cancelled ", " canceled "),
    (" capitalis", " capitaliz"),
    (" catalogue", " catalog"),
    (" categoris", " categoriz"),
    (" centre", " center"),
    (" copyright holders ", " copyright holder "),
    (" copyright owners ", " copyright holder "),
    (" copyright owner ", " copyright holder "),
    (" customis", " customiz"),
    (" emphasis", " emphasiz"),
    (" favour", " favor"),
    (" fulfil ", " fulfill "),
    (" fulfilment", " fulfillment"),
    (" initialis", " initializ"),
    (" judgement", " judgment"),
    (" labelling", " labeling"),
    (" labour", " labor"),
    ("licenc", "licens"),
    (" maximis", " maximiz"),
    (" merchantibility ", " merchantability "),
    (" minimis", " minimiz"),
    (" modelled ", " modeled "),
    (" modelling ", " modeling "),
    (" non commercial", " noncommercial"),
    (" non infringement ", " noninfringement "),
    (" offence", " offense"),
    (" optimis", " optimiz"),
    (" organis", " organiz"),
    (" per cent ", " percent "),
    (" practis", " practic"),
    (" programme", " program"),
    (" realis", " realiz"),
    (" recognis", " recogniz"),
    (" signalling ", " signaling "),
    (" sub licens", " sublicens"),
    (" utilis", " utiliz"),
    (" whilst ", " while "),
    (" wilful", " willful"),
)

#: A title before the text, and the holder's name inside it, in the spaced form.
FORM_STEPS = (
    (r"^ (the )?(mit|expat|isc|zlib|0bsd|bsd zero clause|bsd [23] clause (new or revised|new|simplified)|bsd [23] clause|[23] clause bsd|new bsd|modified bsd|simplified bsd|bsd)( (licens|copyright)[a-z]*)?( mit| expat| isc| zlib| text)? ", " ", ()),
    (r" neither the names? of .{1,200}? nor the names of .{1,80}? contributors ", " neither the name of nor the names of contributors ", (" neither the name",)),
    (r" and the .{1,80}? disclaims? all warranties ", " and the author disclaims all warranties ", (" all warranties ",)),
    (r" is provided by .{1,200}? as is ", " is provided by as is ", (" is provided by ",)),
    (r" in no event shall .{1,200}? be liable ", " in no event shall be liable ", (" in no event shall ",)),
)


def _stepped(rows: DataFrame, col: str, steps) -> DataFrame:
    for pattern, new, marks in steps:
        done = F.regexp_replace(col, F.lit(pattern), F.lit(new))
        has = reduce(lambda a, b: a | b, (F.contains(F.col(col), F.lit(m)) for m in marks)) if marks else F.lit(True)
        rows = rows.withColumn(col, F.when(has, done).otherwise(F.col(col)))
    return rows


def _spaced(text: Column) -> Column:
    """Words of a lower-cased text in one spelling, with a space before each and behind the last."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    words = F.replace(F.replace(words, F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" "))
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), SPELLINGS, words)


def canonical(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """``rows`` with the normal form of ``text`` as column ``name``."""
    rows = _stepped(rows.withColumn(name, F.lower(text)), name, LINE_STEPS)
    rows = _stepped(rows.withColumn(name, _spaced(F.col(name))), name, FORM_STEPS)
    return rows.withColumn(name, F.trim(F.col(name)))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest, license: a row for each distinct normal form of the known licences."""
    if known is None:
        return spark.createDataFrame([(d, name) for name, ds in DIGESTS.items() for d in ds], "digest string, license string").groupBy("digest").agg(F.min("license").alias("license"))
    form = canonical(known.select(F.col("license").alias("license"), text_or_empty().alias("text")), F.col("text"), "form").where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))


def _notices(text: Column, notices: dict[str, str]) -> Column:
    """Names of the notices that stand on a line of their own, comma-joined; null without any."""
    held = lambda x: reduce(lambda a, b: a | b, (F.contains(F.lower(x), F.lit(w)) for w in NOTICE_WORDS))
    digest = lambda x: F.sha2(F.trim(_spaced(F.lower(x))), 256)
    table = F.create_map(*(c for name, line in notices.items() for c in (digest(F.lit(line)), F.lit(name))))
    found = F.transform(F.filter(F.split(text, "\n"), held), lambda x: F.try_element_at(table, digest(x)))
    return F.when(held(text), F.nullif(F.array_join(F.array_sort(F.array_distinct(F.array_compact(found))), ","), F.lit("")))


def license_scan(docs: DataFrame, known: DataFrame | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest of the normal form, license and notices (null: none) of every row of ``docs``."""
    table = known_digests(docs.sparkSession, known)
    if known is None or known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = canonical(texts, F.col("text"), "form").select("doc_id", F.sha2("form", 256).alias("digest"), _notices(F.col("text"), NOTICES if notices is None else notices).alias("notices"))
    return rows.join(table, "digest", "left").select("doc_id", "digest", "license", "notices")


def _quote(x: str) -> str:
    return "chr(10)" if x == "\n" else "'" + x.replace("'", "''") + "'"


def _spaced_sql(text: str) -> str:
    words = f"' ' || regexp_replace(replace(lower({text}), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
    words = f"replace(replace({words}, '  ', ' '), '  ', ' ')"
    return reduce(lambda t, s: f"replace({t}, {_quote(s[0])}, {_quote(s[1])})", SPELLINGS, words)


def form_sql(text: str) -> str:
    """The normal form as SQL; a text without a step's marks is unchanged by it."""
    stepped = lambda t, steps: reduce(lambda t, s: f"regexp_replace({t}, {_quote(s[0])}, {_quote(s[1])}, 'g')", steps, t)
    return f"trim({stepped(_spaced_sql(stepped(f'lower({text})', LINE_STEPS)), FORM_STEPS)})"


def oracle_sql() -> str:
    values = lambda rows: ", ".join(f"({_quote(a)}, {_quote(b)})" for a, b in rows)
    return f"""
        WITH k AS (SELECT digest, min(license) AS license FROM (VALUES {values((d, n) for n, ds in DIGESTS.items() for d in ds)}) t(digest, license) GROUP BY 1),
             n AS (SELECT name, trim({_spaced_sql("line")}) AS form FROM (VALUES {values(NOTICES.items())}) t(name, line)),
             l AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
                   FROM (SELECT doc_id, trim({_spaced_sql("line")}) AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) JOIN n USING (form) GROUP BY 1),
             d AS (SELECT doc_id, sha256({form_sql("coalesce(text, '')")}) AS digest FROM documents)
        SELECT doc_id, d.digest AS digest, license, notices FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN l USING (doc_id)"""
