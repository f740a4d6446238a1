import brute

from lodegraph.llm import licences


def plain(text, least=0.8):
    w = [x.strip(".,;:()[]\"'!?*").lower() for x in brute.words(text)]
    names = set()
    for name, line in licences.TEMPLATES:
        t = [x.strip(".,;:()[]\"'!?*").lower() for x in line.split()]
        want = {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
        for s in range(0, len(w), len(t)):
            own = w[s : s + 2 * len(t)]
            if len(want & {tuple(own[i : i + 3]) for i in range(len(own) - 2)}) >= least * len(want):
                names.add(name)
    return sorted(names)


def test_licences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = licences.scan_licences(docs).collect()
    assert all(r.licences == plain(r.text) for r in out) and sum(bool(r.licences) for r in out) > 10


def test_odd_texts(spark):
    filler = "lorem ipsum dolor sit amet " * 9
    rows = [(1, None), (2, ""), (3, "mit license"), (4, filler + "RELEASED under (the) MIT license! " + filler),
            (5, filler + " this work is licensed under the gnu xx public license, version 3"),
            (6, "this work is licensed under the gnu lesser public licence")] + [(7, licences.TEMPLATES[1][1] + " " + filler)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS licences", "1 AS extra")
    got = licences.scan_licences(df).collect()
    assert [r.licences for r in got] == [plain(t) for _, t in rows] and got[3].licences == ["MIT"] and got[7].licences == ["MIT"]
    assert licences.scan_licences(df.limit(0)).count() == 0


def gnu(kind, what="program", version="version 3 of the License"):
    return (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General "
            f"Public License as published by the Free Software Foundation, either {version}, or (at your option) any later version.")


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
NOTICES = [
    (gnu(""), ["GPL"]), (gnu("", version="version 2 of the License"), ["GPL"]), (gnu("Lesser "), ["LGPL"]), (gnu("Affero "), ["AGPL"]),
    (gnu("Lesser ", "library", "version 2.1 of the License"), ["LGPL"]), (BSD + AS_IS, ["BSD", "BSD-2-Clause"]),
    (BSD + THIRD + AS_IS, ["BSD", "BSD-3-Clause"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies.", ["ISC"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("It is dedicated to the public domain under CC0 1.0 Universal.", ["CC0-1.0"]),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
     ["Apache-2.0"]),
    ("Licensed under the ISC License.", ["ISC"]), ("Licensed under the MIT License.", ["MIT"]),
]


def test_standard_notices(spark):
    filler = "lorem ipsum dolor sit amet " * 9
    df = spark.createDataFrame([(i, filler + t + " " + filler) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan_licences(df).collect()}
    assert [got[i] for i in range(len(NOTICES))] == [want for _, want in NOTICES]


def test_whole_texts(spark):
    """Each text is found as what it is; of other names only those of its family."""
    from lodegraph.llm.licence_texts import TEXTS

    rows = [(i, f"Some words before. {t}\nAnd some behind it.") for i, (_, t) in enumerate(TEXTS)]
    got = {r.doc_id: r.licences for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(TEXTS):
        assert name in got[i] and all(x.split("-")[0] == name.split("-")[0] for x in got[i]), (name, got[i])
