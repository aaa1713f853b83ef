import time

import pytest
from compare import connect, differences
from llm.conftest import ODD_TEXTS

from rentatlas.llm import licenses, queries

TEXTS = [
    (20, "Prose before.\nLicensed under the Apache License, Version 2.0.\nProse behind."),
    (21, "Released under the MIT License."),
    (22, "Permission is hereby granted, free of charge, to any person obtaining a copy. The above "
         "copyright notice and this permission notice shall be included! THE SOFTWARE IS "
         "PROVIDED \"AS IS\"."),
    (23, "This is under the GNU General Public License, version 2; either that or (at your option)"
         " any later version."),
    (24, "GNU General Public License version 3.\nGNU General Public License version 3."),
    (25, "A licence for fishing and some permission to speak. No warranty."),
    (26, "Licensed under CC BY-NC 4.0\nLicensed under CC-BY 4.0."),
    (27, "Redistribution and use in source and binary forms are permitted.\nRedistributions of "
         "source code must retain this.\nRedistributions in binary form must reproduce it."),
    (28, "Copyright (c) 2001 A. All rights reserved."),
]
EXPECTED = {
    20: "Apache-2.0", 21: "MIT", 22: "MIT", 23: "GPL-2.0-or-later", 24: "GPL-3.0", 25: "",
    26: "CC-BY-NC-4.0,CC-BY-4.0", 27: "BSD-2-Clause", 28: "Proprietary",
}


def test_rules(spark, documents):
    out = licenses.sequences(licenses.scan(documents(TEXTS + ODD_TEXTS, clash=True))).collect()
    assert len(out) == len(TEXTS) + len(ODD_TEXTS)
    found = {r.doc_id: r.licences for r in out}
    assert {i: found[i] for i in EXPECTED} == EXPECTED
    assert {found[i] for i, _ in ODD_TEXTS} == {""}


def test_no_python_runs(spark, documents):
    plan = licenses.scan(documents(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_sql_agrees_on_odd_rows(spark, documents, tmp_path):
    import duckdb

    df = documents(TEXTS + ODD_TEXTS)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert differences(licenses.sequences(licenses.scan(df)), con, licenses.oracle_sql()) == []


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE[name]) == []


def test_empty_table(spark, documents):
    assert licenses.sequences(licenses.scan(documents([]))).collect() == []


MIT = """MIT License

Copyright (c) 2020 A. Holder

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""
BSD_HEAD = """Copyright (c) 2020, A. Holder

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD3 = BSD_HEAD + BSD_NAME + BSD_TAIL


def comment(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


PUBLISHED = [
    ("MIT", "Copyright;MITGrant;MITKeep;AsIs", MIT),
    ("BSD-3-Clause", "Copyright;BSDRedist;BSDSource;BSDBinary;BSDName;AsIs", BSD3),
    ("BSD-3-Clause", "Copyright;BSDRedist;BSDSource;BSDBinary;BSDName;AsIs", comment(BSD3, " *")),
    ("BSD-3-Clause", "Copyright;BSDRedist;BSDSource;BSDBinary;BSDName;AsIs",
     BSD3.replace("\n", "\r\n")),
    ("BSD-3-Clause", "Copyright;BSDRedist;BSDSource;BSDBinary;BSDName;AsIs",
     BSD3.replace("the copyright holder nor", "A. Holder Inc. nor")),
    ("BSD-2-Clause", "Copyright;BSDRedist;BSDSource;BSDBinary;AsIs", BSD_HEAD + BSD_TAIL),
    ("Apache-2.0", "ApacheNotice-2.0;ApacheCopy;ApacheLimits", APACHE),
    ("Apache-2.0", "ApacheNotice-2.0;ApacheCopy;ApacheLimits", comment(APACHE, "#")),
    ("GPL-3.0-or-later", "GPLNotice-3.0;GPLLater", GPL3),
    ("GPL-3.0-or-later", "GPLNotice-3.0;GPLLater", comment(GPL3, "//")),
    ("GPL-2.0-or-later", "GPLNotice-2.0;GPLLater", GPL2),
    ("LGPL-2.1", "LGPLNotice-2.1;GPLLater", LGPL),
    ("AGPL-3.0", "AGPLNotice-3.0;GPLLater", GPL3.replace("GNU General", "GNU Affero General")),
    ("MPL-2.0", "MPLNotice-2.0", MPL),
    ("GPL-3.0", "GPLNotice-3.0", "    GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n"),
    ("GPL-2.0", "GPLNotice-2.0", "    GNU GENERAL PUBLIC LICENSE\n      Version 2, June 1991\n"),
    ("Apache-2.0", "ApacheNotice-2.0",
     "     Apache License\n   Version 2.0, January 2004\n http://www.apache.org/licenses/\n"),
    ("MIT", "SPDX-MIT", "// SPDX-License-Identifier: MIT\npackage a;\n"),
    ("Apache-2.0", "SPDX-Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nimport a\n"),
    ("GPL-2.0", "SPDX-GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0 */\nint a;\n"),
    ("GPL-3.0", "SPDX-GPL-3.0;Copyright", "# SPDX-License-Identifier: GPL-3.0-only\n"
     "# Copyright 2020 A. Holder\n"),
    ("MIT,Apache-2.0", "MITNotice;ApacheNotice-2.0", "It is released under the MIT license and "
     "parts of it\nare licensed under the Apache License, Version 2.0"),
    ("CC-BY", "CC-BY", "Pictures: CC BY\nWords by others"),
]


def test_published_texts(spark, documents):
    rows = [(i, text) for i, (_, _, text) in enumerate(PUBLISHED)]
    got = {r.doc_id: r for r in licenses.sequences(licenses.scan(documents(rows))).collect()}
    for i, (licence, sentences, text) in enumerate(PUBLISHED):
        assert set(got[i].licences.split(",")) == set(licence.split(",")), text
        assert got[i].sentences == sentences and got[i].n_sentences == len(sentences.split(";"))


@pytest.mark.parametrize("text", [
    "licence " + "." * 1_000_000,
    "licence " + "?;:!." * 200_000,
    "licence " + '"' * 1_000_000,
    "software is provided by us " * 37_000,
    "neither the name of us " * 43_000,
    "licence.\n * " * 80_000,
    "licence" + " " * 1_000_000 + "x",
], ids=["stops", "marks", "quotes", "as is", "names", "comments", "spaces"])
def test_long_texts_take_time_in_proportion(spark, documents, text):
    licenses.scan(documents([(1, "licence")])).collect()
    began = time.monotonic()
    row = licenses.scan(documents([(1, text)])).collect()[0]
    assert row.licences == [] and time.monotonic() - began < 10


def test_a_phrase_reaches_from_its_last_opening(spark, documents):
    text = "This software is provided by A. The software is provided by B and others \"as is\" here."
    far = "Neither the name of " + "somebody else " * 20_000 + "may be used to endorse products"
    found = licenses.scan(documents([(1, text), (2, far)])).collect()
    assert {r.doc_id: r.sentences for r in found} == {1: ["AsIs"], 2: ["BSDName"]}
