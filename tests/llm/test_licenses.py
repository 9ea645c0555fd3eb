import math
from collections import Counter

from filecorpus.llm import licenses as L
from tests.llm.conftest import EDGES

FILES = [
    (1, "/a/LICENSE", "Released under the MIT License."),
    (2, "/a/x.txt", "nothing of the kind"),
    (3, "/a/b/c/y.txt", "text"),
    (4, "/a/b/LICENSE.md", "Licensed under the Apache License,\nVersion 2.0"),
    (5, "/a/b/c/d/z.txt", "# This work is licensed under the GNU General Public License, version 3.\ncode"),
    (6, "/ab/w.txt", "text"),
    (7, "/LICENSE2/v.txt", None),
    (8, "/a/COPYING", "some words that are not a licence"),
    (9, None, "no path"),
    (10, "/q/notice", "Licensed under CC BY-NC 4.0."),
    (11, "/q/licence.txt", "Licensed under CC BY-NC 4.0 to you and to all others who ask"),
    (12, "/q/r/s.txt", ""),
    (12, "/q/r/s.txt", ""),
]


def test_inheritance(spark):
    files = spark.createDataFrame([(*f, "x", 1) for f in FILES], "file_id long, path string, text string, license string, term int")
    got = {r["file_id"]: (r["own_license"], r["license"], r["licensed_by"]) for r in L.scan_licenses(files).collect()}
    assert got == {
        1: ("MIT", "MIT", "/a/LICENSE"), 2: (None, "MIT", "/a"), 3: (None, "Apache-2.0", "/a/b"),
        4: ("Apache-2.0", "Apache-2.0", "/a/b/LICENSE.md"), 5: ("GPL-3.0", "GPL-3.0", "/a/b/c/d/z.txt"),
        6: (None, None, None), 7: (None, None, None), 8: (None, "MIT", "/a"), 9: (None, None, None),
        10: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "/q/notice"), 11: got[11], 12: (None, "CC-BY-NC-4.0", "/q"),
    }
    assert L.scan_licenses(files).count() == len(FILES)
    assert L.scan_licenses(files.filter("file_id = 99")).count() == 0


def cosine(passage, template, files, found, every):
    a, b = Counter(L.terms_of(passage)), Counter(L.terms_of(template))
    weight = lambda t: math.log((1 + files) / (1 + (found.get(t, 0) if t in every else 1))) + 1
    x, y = ({t: n * weight(t) for t, n in c.items()} for c in (a, b))
    norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
    return sum(v * y.get(t, 0) for t, v in x.items()) / norm if norm else 0


def test_cosines_against_plain_code(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in L.op7_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    every = set().union(*(L.terms_of(t) for _, t in L.TEMPLATES))
    found = Counter(t for d in docs for t in every & set(L.terms_of(d["text"])))
    n_found = 0
    # Brute force over all windows takes long: every document that has a licence, and others.
    for d in docs:
        if not got[d["doc_id"]]["own_license"] and d["doc_id"] % 10:
            continue
        lines = [L.terms_of(line) for line in d["text"].split("\n")]
        whole = [[t for line in lines for t in line]] if d["doc_id"] % 50 == 0 else []
        blocks = whole or list(L.paragraphs(lines))
        best = (0, None)
        for p in lines + whole + list(L.paragraphs(lines)):
            if len(set(p) & every) >= 3:
                for name, template in L.TEMPLATES:
                    best = max(best, (cosine(b" ".join(p).decode(), template, len(docs), found, every), name), key=lambda b: b[0])
        for name, template in L.TEMPLATES:
            n = len(L.terms_of(template))
            rare = set(L.terms_of(template)) - {b"the", b"of", b"and", b"a", b"to", b"in", b"is", b"this"}
            for block in blocks:
                for at in range(len(block) - n + 1):
                    if len(rare.intersection(block[at : at + n])) >= 3:
                        run = b" ".join(block[at : at + n]).decode()
                        best = max(best, (cosine(run, template, len(docs), found, every), name), key=lambda b: b[0])
        if best[0] >= L.MIN_COSINE:
            n_found += 1
            assert got[d["doc_id"]]["own_license"] == best[1]
            assert math.isclose(got[d["doc_id"]]["similarity"], best[0], rel_tol=1e-9)
        else:
            assert got[d["doc_id"]]["own_license"] is None
    assert n_found >= 3


def test_edges(spark, edges):
    rows = L.scan_licenses(L.document_paths(edges)).collect()
    assert len(rows) == len(EDGES) and all(r["own_license"] is None for r in rows)


HEADERS = {
    "GPL-3.0": """// Copyright (C) 2024 Some One
//
// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.""",
    "GPL-2.0": """ * A module. This program is free software; you can redistribute it
 * and/or modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.""",
    "Apache-2.0": """# Licensed to some people; you may not use this file except in
# compliance with the License. You may obtain a copy of
# the License at
#     http://www.apache.org/licenses/LICENSE-2.0""",
    "MIT": """Permission is hereby granted, free of charge,
to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software""",
    "BSD-3-Clause": """-- Redistribution and use in source and binary
-- forms, with or without modification,
-- are permitted provided that the following
-- conditions are met:""",
    "MPL-2.0": """/* This Source Code Form is subject to
 * the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
 * one at https://mozilla.org/MPL/2.0/. */""",
}


def test_wrapped_headers(spark):
    code = "\n".join(f"let value_{i} = compute(value_{i + 1}, {i});" for i in range(300))
    rows = [(i, f"/src/f{i}.rs", f"{code}\n\n{h}\n\n{code}") for i, h in enumerate(HEADERS.values())]
    rows += [(100, "/one/LICENSE", " ".join(HEADERS["MIT"].split()) + " and " + code.replace("\n", " "))]
    rows += [(200 + i, f"/plain/{i}.rs", code) for i in range(20)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = {r["file_id"]: r["own_license"] for r in L.scan_licenses(files).collect()}
    assert [got[i] for i in range(len(HEADERS))] == list(HEADERS)
    assert got[100] == "MIT" and not any(got[200 + i] for i in range(20))


def test_windows_in_parts(monkeypatch):
    found = {"license": 3, "the": 20, "of": 20}
    templates = L.Templates.of(L.TEMPLATES, 50, found)
    every = set(templates.idf)
    words = ("the of the of filler " * 40 + L.TEMPLATES[2][1] + " extra " + L.TEMPLATES[6][1]).split()
    del words[210]
    terms = L.terms_of(" ".join(words))
    wanted = max(
        (cosine(" ".join(t.decode() for t in terms[at : at + n]), text, 50, found, every), name)
        for (name, text), n in zip(L.TEMPLATES, templates.lengths, strict=True)
        for at in range(len(terms) - n + 1)
    )
    for step in (7, 64, 20_000):
        monkeypatch.setattr(L, "WINDOW_TERMS", step)
        got = templates.nearest_window(terms, 0.7)
        assert got[1] == wanted[1] and math.isclose(got[0], wanted[0], rel_tol=1e-9)


def test_texts_are_read_twice_only(spark):
    files = L.document_paths(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = L.scan_licenses(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "documents.parquet" not in plan
