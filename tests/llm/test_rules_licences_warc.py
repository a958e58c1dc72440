"""Quality ledger, licence rules and archives."""
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from mirrorline.llm import licences, quality_rules, warc


def measured(text):
    import re
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)


def test_ledger_matches_plain_counting(spark):
    texts = [None, "", " \n", "one two three", "a b c d e f a b c d e", "x y z w v " * 30, "# $ % & | < > *", "l1\nl1\n\n \nl2\nl1", "é ñ\x0b日本 x\x0cy",
             " ".join(f"w{i}" for i in range(40)), "AAA BBB!! CCC!! " * 3, "a a a a a a a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality_rules.ledger(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == measured(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert bool(r["failed_bits"] & 1) == (r["n_words"] < 10)


def test_policies_and_ablations(spark):
    rows = [(1, 0), (2, 1), (3, 3), (4, 8), (5, 8), (6, 9), (7, 128)]
    led = spark.createDataFrame(rows, "doc_id bigint, failed_bits int")
    kept = {p: {r["doc_id"] for r in led.where(quality_rules.verdict(p)).collect()} for p in quality_rules.POLICIES}
    assert kept["base"] == {1, 4, 5, 7} and kept["v1"] == {1, 7} and kept["v2"] == {1}
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["also_failed_bits"]) for r in quality_rules.ablations(led).collect()}
    assert got["duplicate_lines"] == (3, 2, 1) and got["few_words"] == (3, 1, 10) and got["upper_case"] == (1, 1, 0)


def test_ledger_odd_rows(odd, empty):
    assert quality_rules.ledger(odd).count() == odd.count() and quality_rules.ledger(empty).count() == 0
    assert "Python" not in quality_rules.ledger(odd)._jdf.queryExecution().toString()


def test_licence_sequences(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
           "to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial "
           "portions of the Software.\n THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.")
    swapped = "\n".join(reversed(mit.split("\n")))
    rows = [(1, mit), (2, swapped), (3, "Released under the MIT License.\nx. All rights reserved. All rights reserved."), (4, None), (5, "no licence here"),
            (6, "Licensed under the Apache License, Version 2.0.")]
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == (["mit-grant", "mit-notice", "mit-warranty"], ["MIT"])
    assert len(got[2][0]) == 3 and got[2][1] == []
    assert got[3] == (["mit-short", "all-rights-reserved", "all-rights-reserved"], ["MIT", "Proprietary"])
    assert got[4] == got[5] == ([], []) and got[6][1] == ["Apache-2.0"]


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "BSD-3-Clause": """Copyright (c) 2020, Some One

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
NOTICES["LGPL-2.1-or-later"] = NOTICES["GPL-3.0-or-later"].replace("General", "Lesser General").replace("version 3 ", "version 2.1 ").replace("This program", "This library").replace("software:", "software;")
NOTICES["BSD-2-Clause"] = NOTICES["BSD-3-Clause"][:NOTICES["BSD-3-Clause"].index("3. N")] + NOTICES["BSD-3-Clause"][NOTICES["BSD-3-Clause"].index("THIS SOFT"):]


def test_whole_notices_wrapped_and_in_comments(spark):
    """Real notices at several widths and in comment blocks, between other lines."""
    import textwrap
    rows, want = [], {}
    for name, text in NOTICES.items():
        for width in (50, 72, 100_000):
            lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width, break_on_hyphens=False), ""]]
            for head, mark, tail in (("", "", ""), ("", "# ", ""), ("/*\n", " * ", "\n */"), ("", "// ", "")):
                want[len(rows)] = [name]
                rows.append((len(rows), "some words before\n\n" + head + "\n".join((mark + x).rstrip() for x in lines) + tail + "\nint main()"))
    got = {r["doc_id"]: r["licences"] for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_licence_odd_rows(odd, empty):
    out = licences.licence_scan(odd.withColumn("licences", F.lit(1)))
    assert out.columns == [*odd.columns, "sentence_ids", "licences"] and out.count() == odd.count()
    assert licences.licence_scan(empty).count() == 0


PAGES = [(3, "http://a/x y", "<p>" + "long page ñ " * 20), (1, None, "<p>" + "long page ñ " * 20), (2, "http://b/", "short"), (4, "http://c/", "short"), (5, "http://d/", None),
         (None, "http://e/", "\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n" * 8), (6, "http://f/", "HTTP/1.1 200 OK\r\n\r\n" + "z" * 200), (9, "http://g/", "<p>" + "long page ñ " * 20)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a/x y\n", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nbody\nwith lines\n"), ("http://b/", "20200102030405", "image/png", b"\0\1\n\n\2"), (None, "20200102030405", "text/plain", b"")]
    content = warc.arc_bytes("n.arc", version, records)
    got = list(warc.parse_arc(content))
    assert [b for _, b in got] == [r[3] for r in records]
    assert [f["URL"] for f, _ in got] == ["http://a/x%20y%0A", "http://b/", "-"]
    a, b, c = (warc.converted(*g) for g in got)
    assert (a["kind"], b["kind"]) == ("response", "resource") and a["payload"] == b"body\nwith lines\n" and a["date"] == "2020-01-02T03:04:05Z"
    assert b["payload_digest"] == hashlib.sha256(b"\0\1\n\n\2").hexdigest() and c["payload_bytes"] == 0
    for broken in (content[:-10], content.replace(b" 0 archive", b"7 0 archive", 1), content[:40]):
        with pytest.raises(ValueError):
            list(warc.parse_arc(broken))


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES + [PAGES[2]], "page_id bigint, url string, html string").repartition(3)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r["page_id"], r["payload_bytes"]): r for r in warc.op7_warc(spark, str(tmp_path)).collect()}
    long = len(PAGES[0][2].encode())
    assert [(got[i, long]["record_type"], got[i, long]["refers_to"]) for i in (1, 3, 9)] == [("response", None), ("revisit", 1), ("revisit", 1)]
    assert all(got[i, 5]["record_type"] == "response" for i in (2, 4)) and got[5, 0]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    for i, _, html in PAGES:
        body = (html or "").encode()
        assert got[i, len(body)]["payload_digest"] == hashlib.sha256(body).hexdigest()
    assert warc.op7_warc(spark, str(tmp_path)).count() == len(PAGES) + 1


def test_written_files_are_warc_records(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(1)
    records = warc.convert(warc.legacy_archives(pages)).withColumn("key", F.lit(None).cast("bigint"))
    warc.write_archives(warc.with_revisits(records), str(tmp_path / "w"))
    content = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.gz"))
    found = list(warc.parse_warc(io.BytesIO(content)))
    assert len(found) == len(PAGES) and content.count(b"WARC/1.0\r\nWARC-Type: ") == len(PAGES)
    assert sum(h["warc-type"] == "revisit" for h, _ in found) == 2
    for h, b in found:
        assert h["warc-block-digest"] == "sha256:" + hashlib.sha256(b).hexdigest()
    with pytest.raises(ValueError):
        list(warc.parse_warc(io.BytesIO(content[:-30])))


def test_warc_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op7_warc(spark, str(tmp_path)).count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k} " + "x" * (9000 if k == 7 else 150)) for k in range(40)], "page_id bigint, url string, html string").coalesce(2)
    records = warc.convert(warc.legacy_archives(pages)).withColumn("key", F.lit(None).cast("bigint"))
    warc.write_archives(warc.with_revisits(records), str(tmp_path / "w"), file_bytes=4000)
    sizes = [[len(b) for _, b in warc.parse_warc(io.BytesIO(gzip.decompress(p.read_bytes())))] for p in (tmp_path / "w").glob("*.gz")]
    assert sum(map(len, sizes)) == 40 and len(sizes) > 6
    assert all(sum(s) < 4000 or len(s) == 1 for s in sizes) and any(len(s) > 1 for s in sizes)
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 40
