import re
from collections import Counter

from tidemark.llm import licenses

WORD = re.compile(licenses.WORD)
COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    norm, hits = " ".join(w), []
    for n, label, priority, confidence, keyword, pattern in licenses.rules():
        if keyword in norm:
            hits += [(m.start(), m.end(), priority, n, label, confidence) for m in re.finditer(pattern, norm)]

    def beats(g, h):
        longer = (g[1] - g[0]) - (h[1] - h[0])
        return g[0] <= h[0] and g[1] >= h[1] and (g[2] > h[2] or g[2] == h[2] and (longer > 0 or longer == 0 and g[3] < h[3]))

    kept = [h for h in hits if not any(beats(g, h) for g in hits)]
    starts = [i for i, _ in places]
    base = {x for _, x in places}
    score = max([h[5] for h in kept], default=0.5 if places else 0.0)
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h[4] for h in kept})), score)


def check(rows, docs):
    assert Counter(tuple(r[c] for c in COLUMNS) for r in rows) == Counter((r["doc_id"], *brute(r["text"])) for r in docs.collect())


def test_whole_table(spark, small):
    check(licenses.op4_license_scans(spark, small).collect(), spark.read.parquet(f"{small}/documents.parquet"))


def test_cases(spark, edge, empty):
    texts = [
        "Licensed under CC BY-NC 4.0.", "licensed under the Apache License, Version 2.0. MIT License MIT license", "cc\n\nby and CC.BY mit-license",
        "This work is licensed under the GNU General Public License, version 3. GNU Affero General Public License v3", "Copyright (c) 2020 X. All rights reserved.", "mitlicense xmit license",
        "Key MIT LICENSE É" + " pad" * 20_000 + " bsd 3 clause", "the unlicense; released under the terms of the zlib license",
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], edge.schema.names and "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, edge, empty):
        out = licenses.scan(d).select("doc_id", *(f"licence.{c}" for c in COLUMNS[1:]))
        check(out.collect(), d)


def test_there_are_hundreds_of_rules():
    assert len(licenses.rules()) > 300
    gate = re.compile(licenses._GATE)
    for _, _, _, _, keyword, _ in licenses.rules():
        assert keyword == keyword.lower() and (gate.search(keyword + " license ") is not None)


def test_each_name_implies_its_keyword():
    for _, _, keyword, names, _ in licenses.FAMILIES:
        for name in names:
            least = re.sub(r"\(\?:([^|)]*)[^)]*\)", r"\1", re.sub(r"\(\?:[^)]*\)\?|.\?", "", name.replace("(?:c )?", ""))).replace("[sc]", "c")
            assert keyword in least and keyword in least.replace("licence", "license"), name


def test_names_without_the_keyword_of_another(spark):
    texts = ["Licensed under the PSF License.", "licensed under the ASF license 2.0", "PSF licence 2", "asf licence v1.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan(docs).orderBy("doc_id").select("licence.labels", "licence.score").collect()
    assert [tuple(r) for r in rows] == [("psf", 0.9), ("apache", 1.0), ("psf", 0.75), ("apache", 0.8)]
    ungated = [{r[1] for r in licenses.rules() if re.search(r[5], " ".join(WORD.findall(t.lower())))} for t in texts]
    assert [set(r["labels"].split(",")) for r in rows] == ungated


def test_many_hits_in_one_text(spark):
    import time

    docs = spark.createDataFrame([(1, "mit license and gpl v2 text " * 20_000)], "doc_id long, text string")
    start = time.time()
    row = licenses.scan(docs).select("licence.n_base", "licence.labels", "licence.hits").first()
    assert row["n_base"] == 20_000 and {"gpl", "mit"} <= set(row["labels"].split(",")) and len(row["hits"]) >= 40_000 and time.time() - start < 60


BODY = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted.\n* Redistributions of source code must retain the above copyright notice.",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published",
    "lgpl": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "apache": 'you may not use this file except in compliance with the License.\nYou may obtain a copy',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "The origin of this software must not be misrepresented; you must not claim",
    "proprietary": "Unauthorized copying of this file, via any medium is strictly prohibited.",
    "warranty-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING',
}


def test_licence_bodies(spark):
    plain = ["you can redistribute the seats", "a warranty of any kind is not free", "permission was granted to use the hall", "unauthorized persons are prohibited"]
    docs = spark.createDataFrame(list(enumerate([*BODY.values(), *plain])), "doc_id long, text string")
    rows = licenses.scan(docs).orderBy("doc_id").select("doc_id", *(f"licence.{c}" for c in COLUMNS[1:])).collect()
    check(rows, docs)
    for r, label in zip(rows, BODY, strict=False):
        assert label in r["labels"].split(",") and r["score"] >= 0.7, label
    assert all(r["labels"] == "" for r in rows[len(BODY) :])


def spellings(pattern):
    """Texts that match: each alternative, optional part and letter of a set is tried with and without, the others fixed."""
    def of(nodes):
        each = []
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                each.append([chr(arg)])
            elif name == "IN":
                each.append([chr(c) for o, v in arg for c in ([v] if str(o) == "LITERAL" else v if str(o) == "RANGE" else [])])
            elif name == "BRANCH":
                each.append([x for b in arg[1] for x in of(b)])
            elif name == "SUBPATTERN":
                each.append(of(arg[3]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                assert high <= 1, pattern  # no windows inside rules
                each.append(of(inner) + ([""] if low == 0 else []))
            else:
                assert name in ("ASSERT_NOT", "ASSERT"), name
        out = set()
        for tail in (0, -1):
            fixed = [x[tail] for x in each]
            out |= {"".join([*fixed[:k], v, *fixed[k + 1 :]]) for k, vs in enumerate(each) for v in vs} | {"".join(fixed)}
        return sorted(out)

    return of(re._parser.parse(pattern))


def test_every_spelling_of_every_rule_has_its_keyword():
    gate, n = re.compile(licenses._GATE), 0
    for _, label, _, _, keyword, pattern in licenses.rules():
        for x in spellings(pattern):
            assert re.search(pattern, x) and keyword in x and gate.search(x), (label, keyword, x)
            n += 1
    assert n > 3000


def test_both_spellings_of_a_body(spark):
    texts = ["You may not use this file except in compliance with the Licence.", "You may not use this file except in compliance with the License."]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["l"] for r in licenses.scan(docs).orderBy("doc_id").selectExpr("licence.labels AS l").collect()] == ["apache", "apache"]


def test_each_hand_written_rule_has_a_text_that_matches_and_one_that_does_not():
    written = [(k, p) for _, _, _, k, p in licenses.BODIES] + [(k, p) for _, k, p in licenses.NOTICES]
    assert len(written) > 200 and len({p for _, p in written}) == len(written)
    for _, p in written:
        rule = re.compile(rf"(?<![^ ]){p}(?![^ ])")
        assert all(rule.fullmatch(x) for x in spellings(p))
        x = min(spellings(p), key=len)  # without optional parts
        w = x.split()
        assert not rule.search("un" + x) and not rule.search(x + "ing") and (len(w) == 1 or not rule.search(" ".join([*w[: len(w) // 2], "zzz", *w[len(w) // 2 :]])))


def test_notices_in_context(spark):
    texts = {
        "apache": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,",
        "gpl": "You should have received a copy of the GNU General Public License along with this program.", "cc-by-nc-sa": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International",
        "bsd": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "perl": "you can redistribute it and/or modify it under the same terms as Perl itself.", "mpl": "The contents of this file are subject to the Mozilla Public License Version 1.1",
        "gpl-exception": "This file is distributed under the GPL v2 with the Autoconf exception.", "cc-by-nc-sa ": "Creative Commons Attribution-Non Commercial-Share Alike 3.0 Unported",
        "bsd-4-clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement:", "lgpl": "SPDX-License-Identifier: LGPL-2.1-or-later",
        "dual-license": "Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "sqlite": "The author disclaims copyright to this source code.  In place of a legal notice, here is a blessing:",
        "proprietary": "No part of this book may be reproduced in any form without permission of the copyright owner.", "public-domain": "This code has been released into the public domain",
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    rows = licenses.scan(docs).orderBy("doc_id").select("doc_id", *(f"licence.{c}" for c in COLUMNS[1:])).collect()
    check(rows, docs)
    for r, label in zip(rows, texts, strict=True):
        assert label.strip() in r["labels"].split(","), (label, r["labels"])
