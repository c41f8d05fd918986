import duckdb
import pytest
from oracle_check import frames_equal

from hazegrid.llm import licenses

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software. The above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
)
CASES = [
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Text before.\nThis work is licensed under the GNU General Public License, version 3. More", "GPL-3.0"),
    ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "MIT;CC-BY-NC"),
    (MIT.replace("\n", " "), "MIT"),
    (MIT.replace("\n", " ").split(" THE ")[0], "UNKNOWN"),
    ("Licensed under the Made Up License 9.", "UNKNOWN"),
    ("All rights reserved. Released under the MIT License! SPDX-License-Identifier: MIT", "MIT;all rights reserved"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice. "
     "Redistributions in binary form must reproduce the above copyright notice. This software is provided by the copyright holders \"as is\".", "BSD-2-Clause"),
    ("nothing of the kind", "NONE"), (None, "NONE"), ("", "NONE"), ("licence " * 20_000, "UNKNOWN"),
]


def test_cases_and_sql(make_docs):
    rows = [(i, t) for i, (t, _) in enumerate(CASES)] + [(None, CASES[0][0]), (0, CASES[0][0])]
    got = licenses.scan(make_docs(rows))
    for r in got.collect():
        assert r["licenses"] == CASES[r["doc_id"] or 0][1], r
    documents = make_docs(rows, extra=False).toPandas()  # noqa: F841  read by DuckDB
    assert frames_equal(got.toPandas(), duckdb.sql(licenses.duckdb_sql()).df()) is None
    assert licenses.scan(make_docs([])).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in licenses.SENTENCES])
def test_every_identifier_is_in_a_rule(name):
    assert any(name in ids for _, ids in licenses.RULES)


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 Somebody

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
LIABILITY.
""",
    "GPL-3.0-or-later": """    Copyright (C) 2020  Somebody
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
""",
    "Apache-2.0": """# Licensed under the Apache License, Version 2.0 (the "License"); you may not
# use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
""",
}


def test_published_wrapped_texts(make_docs):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    cases = [*WRAPPED.items(), *((k, t.replace("\n", "\r\n")) for k, t in WRAPPED.items()), ("Apache-2.0", apache), ("MIT", "words before\nReleased under the\nMIT License.")]
    got = {r["doc_id"]: r for r in licenses.scan(make_docs([(i, t) for i, (_, t) in enumerate(cases)])).collect()}
    assert [got[i]["licenses"] for i in range(len(cases))] == [k for k, _ in cases]
    assert "mit_grant|mit_notice|mit_asis" in got[0]["sentence_ids"] and "gpl_later_3|gpl_nowarranty" in got[1]["sentence_ids"]
    assert "bsd_grant|bsd_source|bsd_binary|bsd_names|bsd_asis" in got[2]["sentence_ids"] and "apache_2_ref|apache_comply|apache_copy" in got[3]["sentence_ids"]
