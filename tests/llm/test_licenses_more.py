"""Sentences with a slot, and the wider rules, wrapped and not; the SQL on the same lines."""

import duckdb
import pytest

from duoscope.llm import licenses

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """ This {} is free software; you can redistribute it and/or modify it under the
 terms of the GNU {} as published by the Free Software
 Foundation; either version {} of the License, or (at your option) any later version.
"""


@pytest.fixture(scope="module")
def found(spark):
    def scan(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()]

    return scan


def test_bsd_of_any_holder(found):
    holders = ["Google Inc.", "the University of California, Berkeley", "the copyright holder", "the copyright holders", "Some-One & Sons, Ltd. of Old Town", "X"]
    assert found([BSD + NAMES.format(h) for h in holders]) == ["BSD-3-Clause"] * len(holders)
    assert found([BSD + NAMES.format(h).replace("\n", "\n# ") for h in holders]) == ["BSD-3-Clause"] * len(holders)
    far = " ".join(["word"] * 13)
    assert found([BSD, BSD + NAMES.format(far), BSD + NAMES.format(""), NAMES.format("X")]) == ["BSD-2-Clause", "BSD-2-Clause", "BSD-2-Clause", ""]
    old = "\nThe name of the author may not be used to endorse or promote products derived\nfrom this software without specific prior written permission.\n"
    assert found([BSD + old]) == ["BSD-3-Clause"]


def test_more_licences(found):
    texts = {
        GPL.format("program", "General Public License", "2"): "GPL-2.0-or-later", GPL.format("program", "General Public License", "3"): "GPL-3.0-or-later",
        GPL.format("library", "Lesser General Public License", "2.1"): "LGPL-2.1-or-later", GPL.format("library", "Lesser General Public License", "3"): "LGPL-3.0-or-later",
        GPL.format("program", "Affero General Public License", "3"): "AGPL-3.0-or-later", "CC0 1.0 Universal\n": "CC0-1.0", "Distributed under the Boost Software License, Version 1.0.\n(See file)": "BSL-1.0",
        "Eclipse Public License - v 2.0\n": "EPL-2.0", "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License v. 2.0 which is available at\n": "EPL-2.0",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n": "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n": "ISC",
        "This software is provided 'as-is', without any express or implied\nwarranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n": "Zlib",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "CC-BY-3.0", "The Artistic License 2.0\n": "Artistic-2.0", "our licence is none of these, and cc0 is only a word": "",
    }
    assert found(list(texts)) == list(texts.values())


def test_sql_knows_slots_and_rules(spark):
    """On texts whose sentences are on one line each."""
    flat = lambda t: t.replace("\n\n", "@").replace("\n", " ").replace("@", "\n")
    texts = [flat(BSD), flat(BSD + NAMES.format("Google Inc")), flat(NAMES.format("the authors")), flat(GPL.format("program", "General Public License", "2")), "CC0 1.0 Universal", "The Artistic License 2.0", None, "", *licenses.SENTENCES.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    db = duckdb.connect()
    rows = df.toPandas()
    db.register("documents", rows)
    want = {r[0]: r[1:] for r in db.sql(f"SELECT doc_id, n_sentences, sentence_ids, licenses FROM ({licenses.oracle_sql()})").fetchall()}
    assert {r.doc_id: (r.n_sentences, r.sentence_ids, r.licenses) for r in licenses.scan(df).collect()} == want
