"""Top-k against a full sort, licences against SQL and texts, WARC records field by field."""

import base64
import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from provenir.llm import licenses, queries, topk, warc
from tests.llm.cases import ROWS, docs, empty

SF = "/root/testdata/sf0.01"


def best(rows, queries_, k):
    vectors = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in vectors:
        if q in queries_:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "bins", "k"), [(1024, 64, 5), (3, 2, 5), (1024, 64, 500), (2, 3, 1)])
def test_top_k_with_ties_and_odd_vectors(spark, monkeypatch, block, bins, k):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "BINS", bins)
    draw = random.Random(6)
    rows = [(i, [draw.choice([-1.0, 0.5, 0.25, 1.0]) for _ in range(3)]) for i in range(200)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(200, 300)]  # one vector very often
    rows += [(300, None), (301, []), (302, [1.0, None, 1.0]), (303, [float("nan")] * 3), (304, [float("inf"), 0.0, 0.0]), (305, [1.0]), (None, [1.0, 1.0, 1.0]), (306, [-3e5, 2e5, 1e5])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, vector string").repartition(5)
    asked = {0, 50, 250, 300, 302, 305, 306}
    got = topk.top_k(table, table.where(F.col("vec_id").isin(*asked)), k=k)
    assert sorted(map(tuple, got.collect())) == best(rows, asked, k)


def test_top_k_of_nothing(spark):
    table = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(table, table).count() == 0
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op2_license_scan", "op5_decontaminate", "op10_exact_top_k"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in want.description]
    got = [tuple(r[c] for c in order) for r in queries.queries()[name](spark, SF).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want.fetchall()))


def sentence(name):
    return licenses.SENTENCES[name]


@pytest.mark.parametrize(
    ("text", "rules"),
    [
        ("Some text.\nReleased under the MIT License.", ["mit-release"]),
        (f"{sentence('mit-grant').upper()}:\n\n{sentence('mit-notice')}. {sentence('as-is-software')}.", ["mit-text"]),
        (f"{sentence('mit-notice')}. {sentence('mit-grant')}. {sentence('as-is-software')}.", []),  # another order
        (f"The MIT License\n{sentence('mit-grant').replace(' copy ', ' copy\n')}.", ["mit-title-text"]),
        (f"The MIT License. {sentence('mit-grant').replace(' copy ', ' copy\n')}.", ["mit-title-text"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl3-notice"]),
        ("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", ["cc-by-4", "cc-by-nc-4"]),
        ("Unlicensed under the Apache License", []),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ["apache-header"]),
        ("", []),
        (None, []),
    ],
)
def test_license_rules(spark, text, rules):
    assert licenses.scan_licenses(docs(spark, [(1, text)])).first()["rules"] == rules


MIT_FILE = """MIT License

Copyright (c) 2020 X

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
MIT_TEXT = ["mit-grant", "mit-notice", "as-is-software"]


@pytest.mark.parametrize(
    ("text", "found", "rules"),
    [
        (MIT_FILE, MIT_TEXT, ["mit-text"]),
        (MIT_FILE.replace("\n", "\r\n"), MIT_TEXT, ["mit-text"]),
        ("/*\n" + "".join(f" * {line}\n" for line in MIT_FILE.splitlines()) + " */", MIT_TEXT, ["mit-text"]),
        (f"The {MIT_FILE}", ["mit-title", *MIT_TEXT], ["mit-text", "mit-title-text"]),
        # One-line notices without a full stop before, between and after wrapped sentences.
        (f"Licensed under CC BY 4.0\nby X\n\n{MIT_FILE}\nReleased under the MIT License\nby X", ["cc-by-4", *MIT_TEXT, "mit-release"], ["cc-by-4", "mit-release", "mit-text"]),
        ("Licensed under the Apache License, Version 2.0\n(the \"License\"); you may not use this file\nexcept in compliance with the License.", ["apache-header", "apache-compliance"], ["apache-header"]),
    ],
)
def test_wrapped_license_texts(spark, text, found, rules):
    got = licenses.scan_licenses(docs(spark, [(1, text)])).first()
    assert (got["sentences"], got["rules"]) == (found, rules)


BSD = """Copyright (c) 2020 X. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
ADVERT = """3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by X.
"""
GPL = """Copyright (C) 2020  X

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Copyright 2020 X

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def endorse(name):
    return f"""3. Neither the name of {name} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


@pytest.mark.parametrize(
    ("text", "rules", "names"),
    [
        (GPL, ["gpl3-header"], ["GPL-3.0-or-later"]),
        (GPL.replace("software:", "software;"), ["gpl3-header"], ["GPL-3.0-or-later"]),
        ("".join(f"# {line}\n" for line in GPL.splitlines()), ["gpl3-header"], ["GPL-3.0-or-later"]),
        (BSD + BSD_END, ["bsd-2-text"], ["BSD-2-Clause"]),
        (BSD + endorse("the copyright holder") + BSD_END, ["bsd-3-text"], ["BSD-3-Clause"]),
        (BSD + endorse("Google Inc.") + BSD_END, ["bsd-3-text"], ["BSD-3-Clause"]),
        (BSD + endorse("the University") + BSD_END, ["bsd-3-text"], ["BSD-3-Clause"]),
        (BSD + ADVERT + endorse("X") + BSD_END, ["bsd-4-text"], ["BSD-4-Clause"]),
        (BSD + endorse("X") + BSD_END + BSD + BSD_END, ["bsd-2-text", "bsd-3-text"], ["BSD-2-Clause", "BSD-3-Clause"]),
        (APACHE, ["apache-header"], ["Apache-2.0"]),
        ("Licensed under the Apache License,\nVersion 2.0.", ["apache-notice"], ["Apache-2.0"]),
        (f"The {MIT_FILE}", ["mit-text", "mit-title-text"], ["MIT"]),
        ("Released under\nthe MIT License.", ["mit-release"], ["MIT"]),
        ("Licensed under\nthe MIT License.", ["mit-licensed"], ["MIT"]),
        ("This work is licensed under the GNU General\nPublic License, version 3.", ["gpl3-notice"], ["GPL-3.0-only"]),
        *((f"Licensed under CC\n{k[3:-2].upper()} 4.0.", [k], [f"CC-{k[3:-2].upper()}-4.0"]) for k in ("cc-by-4", "cc-by-nc-4", "cc-by-sa-4")),
    ],
)
def test_wrapped_official_wordings(spark, text, rules, names):
    got = licenses.scan_licenses(docs(spark, [(1, text)])).first()
    assert (got["rules"], got["licenses"]) == (rules, names)


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL = GPL.replace("GNU General", "GNU Affero General")
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
CC0 = """To the extent possible under law, the author(s) have dedicated all
copyright and related and neighboring rights to this software to the
public domain worldwide. This software is distributed without any warranty.
"""
BOOST = "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at\nhttps://www.boost.org/LICENSE_1_0.txt)\n"
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
NOTICES = {
    "ISC": ISC, "0BSD": ISC.replace("granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "granted."),
    "MPL-2.0": MPL, "GPL-2.0-or-later": GPL2, "GPL-2.0-only": GPL2.replace("either version 2\nof the License, or (at your option) any later version", "version 2 of the License"),
    "LGPL-2.1-or-later": LGPL, "AGPL-3.0-or-later": AGPL, "Unlicense": UNLICENSE, "CC0-1.0": CC0, "BSL-1.0": BOOST, "Zlib": ZLIB,
}


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", ";; ", "-- "])
def test_notices_wrapped_and_commented(spark, prefix):
    lines = {name: ["A title", "Copyright (c) 2020 X", *text.splitlines()] for name, text in NOTICES.items()}
    rows = [(i, "".join(f"{prefix}{line}\n" for line in own)) for i, own in enumerate(lines.values())]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {i: [name] for i, name in enumerate(NOTICES)}


def test_tag_lines(spark):
    rows = [(i, f"// SPDX-License-Identifier: {name}\nint main;") for i, name in enumerate(licenses.SPDX)]
    rows += [(100 + i, f"license {name}\n{name}") for i, name in enumerate(licenses.SPDX)]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got == {i: [name] for i, name in enumerate(licenses.SPDX)} | {100 + i: [] for i in range(len(licenses.SPDX))}


def test_tight_text_and_see_the_file(spark):
    tight = MIT_FILE.replace("\n\n", "\n")
    rows = [(1, tight), (2, "Licensed under the MIT license, see the file."), (3, tight.replace("\n", "\r\n"))]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, rows)).collect()}
    assert got[1].sentences == got[3].sentences == MIT_TEXT and got[1].licenses == got[2].licenses == ["MIT"]


@pytest.mark.parametrize("blank", ["\n", " \n", "\r\n", "\t \r\n", ".\n", "...\n ", "\n# ", "; \n", " " * 7, "-"])
def test_very_many_blank_lines(spark, blank):
    text = f"{MIT_FILE}{blank * 100_000}\nReleased under the MIT License{blank * 100_000}\n{MIT_FILE}"
    found = licenses.scan_licenses(docs(spark, [(1, text)])).first().sentences
    assert [s for s in found if s != "mit-release"] == MIT_TEXT * 2
    assert "mit-release" in found or blank in ("-", " " * 7, "\n# ")


def test_known_sentences_are_as_the_splitter_makes_them():
    import re

    assert {r.name for r in licenses.RULES if not set(r.sentences + r.not_before) <= set(licenses.SENTENCES)} == set()
    assert all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s) for s in licenses.SENTENCES.values())


def test_licenses_of_awkward_rows(spark):
    rows = [*ROWS, (20, "Licensed under CC BY 4.0.\n" * 5000)]
    got = licenses.scan_licenses(docs(spark, rows))
    assert got.count() == len(rows)
    assert got.where("doc_id = 20").first().licenses == ["CC-BY-4.0"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert licenses.scan_licenses(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="anchor"):
        licenses.scan_licenses(empty(spark), {"x": "some other sentence"}, [])


HTML = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nServer: x\r\n"
RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload binary, payload_digest string, content string"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_records(spark):
    page = '<html lang="es-419"><title>A &amp; b</title><p title="x>y">Caf\xe9 <b>o</b>ne<br>two<script>no</script><a href=1>l</a><a name=n>'.encode("latin-1")
    rows = [
        ("<urn:uuid:1>", "https://h.example/1", "2024-01-01T00:00:00Z", HTML, page, None, "x"),
        ("<urn:uuid:2>", None, None, None, None, None, "x"),
        ("<urn:uuid:3>", "u", "d", "Content-Type: image/png\r\n", b"\x89PNG", sha1(b"\x89PNG"), "x"),
        ("<urn:uuid:4>", "u", "d", "Content-Type: text/plain; charset=nonsense\r\n", "ü\n x".encode(), "sha1:WRONG", "x"),
        ("<urn:uuid:5>", "u", "d", HTML, b"", None, "x"),
        (None, "u", "d", HTML, page, None, "x"),
    ]
    got = warc.derive(spark.createDataFrame(rows, RESPONSE)).collect()
    found = {(r.refers_to, r.record_type): r for r in got}
    assert set(found) == {(f"<urn:uuid:{i}>", "metadata") for i in range(1, 6)} | {(f"<urn:uuid:{i}>", "conversion") for i in (1, 4, 5)}
    assert len({r.record_id for r in got}) == len(got)
    for r in got:
        block = bytes(r.content)
        assert r.content_length == len(block) and r.block_digest == sha1(block)
        header = r.headers.split("\r\n")
        assert header[0] == "WARC/1.1" and f"WARC-Refers-To: {r.refers_to}" in header and f"Content-Length: {len(block)}" in header
    text = found["<urn:uuid:1>", "conversion"]
    assert bytes(text.content).decode() == "A & b\nCafé one\ntwol"
    assert (text.source_headers, text.source_digest, text.source_digest_holds) == (HTML, sha1(page), None)
    fields = bytes(found["<urn:uuid:1>", "metadata"].content).decode()
    assert "title: A & b\r\nlanguage: es-419\r\nlinks: 1\r\n" in fields
    assert "http-status-line: HTTP/1.1 200 OK\r\nhttp-header: Content-Type: text/html; charset=iso-8859-1\r\nhttp-header: Server: x\r\n" in fields
    for kind in ("metadata", "conversion"):
        header = found["<urn:uuid:1>", kind].headers.split("\r\n")
        assert {"WARC-Refers-To-Target-URI: https://h.example/1", "WARC-Refers-To-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: {sha1(page)}"} <= set(header)
    assert "http-header: Content-Type: image/png\r\n" in bytes(found["<urn:uuid:3>", "metadata"].content).decode()
    assert found["<urn:uuid:3>", "metadata"].source_digest_holds is True
    assert found["<urn:uuid:4>", "metadata"].source_digest_holds is False
    assert found["<urn:uuid:4>", "metadata"].source_digest == "sha1:WRONG"
    assert bytes(found["<urn:uuid:4>", "conversion"].content).decode() == "ü\n x"


def test_warc_text_of_broken_pages():
    for piece in ('<a "', "<script", "<!--", "<", "<title ", '<html lang="', "<a href='", "&"):
        warc.plain_text(piece * 50_000)
        list(warc._derived({"record_id": "x", "target_uri": "u", "date": "d", "http_headers": HTML, "payload": (piece * 50_000).encode(), "payload_digest": None}, None))


def test_warc_query(spark):
    got = queries.op8_warc_derivatives(spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert got.where("record_type = 'metadata'").count() == got.where("record_type = 'conversion'").count() == pages.count()
    own = {sha1(r.html.encode()) for r in pages.select("html").collect()}
    assert {r.source_digest for r in got.select("source_digest").collect()} == own
    assert warc.derive(warc.responses_of(pages.limit(0), "d")).count() == 0
