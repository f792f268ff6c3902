from sentrylake.llm.licences import scan


def test_own_and_inherited_licences(spark):
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "a/b/c/x.py", "nothing here"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), (4, "a/b/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."),
        (5, "z.txt", "licensed plumber wanted in town, call now for more about our many services"), (6, None, "Released under the MIT License."), (7, "ab/x", None), (None, "a/q", "Released under the MIT License."), (8, "a/b", ""),
    ]
    files = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, licence string")
    found = {r["doc_id"]: (r["licence"], r["from_directory"], r["cosine"]) for r in scan(files).collect()}
    assert found[1][0] == "MIT" and found[2][:2] == ("GPL-3.0", "a/b/c") and found[3][0] == "Apache-2.0" and found[3][2] > 0.9
    assert found[4][0] == "GPL-3.0" and found[5] == (None, None, None) and found[6][0] == "MIT" and found[7] == (None, None, None)
    assert found[None][:2] == ("MIT", "a") and found[8][:2] == ("MIT", "a")
    assert scan(files.limit(0)).count() == 0


GNU = """{sign} This program is free software; you can redistribute it and/or modify
{sign} it under the terms of the GNU {name} License as published by
{sign} the Free Software Foundation; either version {version} of the License, or
{sign} (at your option) any later version.
{sign}
{sign} This program is distributed in the hope that it will be useful,
{sign} but WITHOUT ANY WARRANTY.
code = 1
"""


def test_wrapped_headers_identifiers_and_whole_licences(spark):
    title = "                    GNU GENERAL PUBLIC LICENSE\n                       Version {}\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"
    cases = [
        ("GPL-2.0", "x.py", GNU.format(sign="#", name="General Public", version=2)), ("GPL-3.0", "x.c", "/*\n" + GNU.format(sign=" *", name="General Public", version=3)),
        ("AGPL-3.0", "x.js", GNU.format(sign="//", name="Affero General Public", version=3)), ("GPL-2.0", "y.py", GNU.format(sign="", name="General Public", version=2).replace("\n", " ")),
        ("MIT", "z.py", "# SPDX-License-Identifier: MIT\nx = 1"), ("Apache-2.0", "z.c", "/* SPDX-License-Identifier: Apache-2.0 */"), ("GPL-2.0", "z.h", "// SPDX-License-Identifier: GPL-2.0-or-later"),
        ("GPL-2.0", "p/COPYING", title.format("2, June 1991")), ("GPL-3.0", "q/COPYING", title.format("3, 29 June 2007")),
        ("Apache-2.0", "w.py", "# Licensed under the Apache\n# License, Version 2.0.\n"), (None, "n.txt", "A free software fair with licensed vendors\nopens in town, and all are invited to come."),
    ]
    files = spark.createDataFrame([(k, f"d{k}/{path}", text) for k, (_, path, text) in enumerate(cases)], "doc_id long, path string, text string")
    found = {r["doc_id"]: r["licence"] for r in scan(files).collect()}
    assert found == {k: licence for k, (licence, _, _) in enumerate(cases)}
