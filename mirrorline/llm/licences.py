"""Licence scans by sentence rules (DataFrame functions only).

A text is cut at the ends of sentences and at empty lines (also those of a comment
block, which hold signs only), each sentence is normalised (ASCII lower case,
anything else than letters and digits one space, so wrapped lines and comment
signs go), known sentences become their identifiers, and the sequence of
identifiers is matched against ordered rules: a rule holds where its identifiers
follow each other among the known sentences. Lines of a sentence that is not
known are looked up one by one, since a notice may stand between lines that end
without a stop.

Defined cases: a null or empty text has no sentences and no licences; repeated
sentences count each time; copies and repeated rows get equal results; an empty
table gives an empty result; other columns pass through, input columns named
like the results (or ``_licence_cut``, ``_licence_at``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Normalised licence sentences, as the cutter yields them, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0-short",
    "licensed under the apache license version 2 0 the license": "apache-2.0-grant",
    "you may not use this file except in compliance with the license": "apache-2.0-comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0-copy",
    "released under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-project",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-short",
    "licensed under cc by 4 0": "cc-by-4.0-short",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-work",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all rights reserved": "all-rights-reserved",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "http www apache org licenses license 2 0": "apache-2.0-address",
    "https www apache org licenses license 2 0": "apache-2.0-address",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2.0-see",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2.0-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2.0-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2.0-copy",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-anyone",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
}

# What the notices of the public licences of one family differ in.
FAMILY = {"GPL": ("gnu general public license", ("2", "3")), "LGPL": ("gnu lesser general public license", ("2 1", "3")), "AGPL": ("gnu affero general public license", ("3",))}
WORKS = ("program", "library", "software", "file")
FAMILY_RULES = []
for work in WORKS:
    SENTENCES[f"this {work} is free software"] = "gpl-free"
    SENTENCES[f"this {work} is distributed in the hope that it will be useful but without any warranty"] = "gpl-hope"
for short, (long, versions) in FAMILY.items():
    SENTENCES[f"see the {long} for more details"] = f"{short.lower()}-details"
    for work in WORKS:
        SENTENCES[f"you should have received a copy of the {long} along with this {work}"] = f"{short.lower()}-received"
    for version in versions:
        number = version.replace(" ", ".") if " " in version else f"{version}.0"
        published = f"you can redistribute it and or modify it under the terms of the {long} as published by the free software foundation"
        for end, kind in ((f"either version {version} of the license or at your option any later version", "or-later"), (f"version {version} of the license", "only")):
            name = f"{short.lower()}-{number}-{kind}"
            SENTENCES[f"{published} {end}"] = name
            FAMILY_RULES.append((f"{short}-{number}-{kind}", ("gpl-free", name, "gpl-hope", "gpl-implied")))

# Ordered rules, the licence each shows.
RULES = (
    ("Apache-2.0", ("apache-2.0-short",)),
    ("Apache-2.0", ("apache-2.0-grant", "apache-2.0-comply", "apache-2.0-copy")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-project",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("GPL-3.0", ("gpl-3.0-short",)),
    ("GPL-3.0", ("gpl-3.0-grant", "gpl-warranty", "gpl-details")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-short",)),
    ("CC-BY-4.0", ("cc-by-4.0-short",)),
    ("CC-BY-4.0", ("cc-by-4.0-work",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("Proprietary", ("all-rights-reserved",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("MPL-2.0", ("mpl-2.0-form", "mpl-2.0-copy")),
    ("Unlicense", ("unlicense-grant", "unlicense-anyone")),
    *FAMILY_RULES,
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[.!?;:][\x20\x09-\x0D]+|\n([^a-z0-9\n]*\n)+"


def licence_scan(docs: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """``docs`` with sentence_ids (array, in text order) and licences (array, in
    the rules' order, each once)."""
    known = F.array(*[F.lit(s) for s in sentences])
    names = F.array(*[F.lit(i) for i in sentences.values()])

    def place(s):
        return F.array_position(known, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))).cast("int") - 1

    def of_lines(s):
        return F.array_compact(F.transform(F.split(s, "\n"), lambda line: F.get(names, place(line))))

    cut = F.split(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), BREAK)
    out = docs.drop("sentence_ids", "licences", "_licence_cut", "_licence_at").withColumn("_licence_cut", cut).withColumn("_licence_at", F.transform("_licence_cut", place))
    ids = F.flatten(F.transform("_licence_cut", lambda s, i: F.when(F.get("_licence_at", i) >= 0, F.array(F.get(names, F.get("_licence_at", i))))
                                .when(F.contains(s, F.lit("\n")), of_lines(s)).otherwise(F.array().cast("array<string>"))))
    out = out.withColumn("sentence_ids", ids).drop("_licence_cut", "_licence_at")
    row = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    hits = [F.when(F.contains(row, F.lit("," + ",".join(seq) + ",")), F.lit(name)) for name, seq in rules]
    return out.withColumn("licences", F.when(F.size("sentence_ids") > 0, F.array_distinct(F.array_compact(F.array(*hits)))).otherwise(F.array().cast("array<string>")))


def op4_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: known sentences in order, licences."""
    found = licence_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licences", ",").alias("licences"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rules = ", ".join(f"({k}, '{name}', ',{','.join(seq)},')" for k, (name, seq) in enumerate(RULES))
    return rf"""
with known(s, id) as (values {known}), rules(k, name, seq) as (values {rules}),
cut as (select doc_id, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.!?;:][\x20\x09-\x0D]+|\n(?:[^a-z0-9\n]*\n)+') as parts from documents),
sentence as (select doc_id, p, parts[p] as raw, trim(regexp_replace(parts[p], '[^a-z0-9]+', ' ', 'g')) as s from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as p from cut)),
whole as (select doc_id, p, 0 as q, id from sentence join known using (s)),
line as (select doc_id, p, q, trim(regexp_replace(rows[q], '[^a-z0-9]+', ' ', 'g')) as s from
  (select doc_id, p, string_split(raw, chr(10)) as rows, unnest(range(1, len(string_split(raw, chr(10))) + 1)) as q from sentence where contains(raw, chr(10)) and s not in (select s from known))),
each as (select * from whole union all select doc_id, p, q, id from line join known using (s)),
ids as (select doc_id, count(*) as n, string_agg(id, ',' order by p, q) as ids from each group by doc_id),
found as (select doc_id, name, min(k) as k from ids join rules on contains(',' || ids || ',', seq) group by doc_id, name),
names as (select doc_id, string_agg(name, ',' order by k) as names from found group by doc_id)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_sentences, coalesce(ids, '') as sentence_ids, coalesce(names, '') as licences
from documents d left join ids on d.doc_id = ids.doc_id left join names on d.doc_id = names.doc_id
"""


OP4_SQL = _sql()
