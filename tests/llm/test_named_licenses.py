"""Licences that a sentence names, alone or together, and titles."""

from __future__ import annotations

import duckdb

from tessera.llm.licenses import ORACLE_SQL, license_scan

CASES = {
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0,MIT",
    "This crate is dual-licensed under the MIT and Apache 2.0 licenses.": "Apache-2.0,MIT",
    "License: MIT": "MIT",
    "It is released under the BSD license.": "BSD",
    "Released under the 3-clause BSD license.": "BSD-3-Clause",
    "Code is under the GPL-2.0-only and MIT licenses.": "GPL-2.0-only,MIT",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.": "GPL-3.0",
    "Creative Commons Attribution 4.0 International Public License\n\nBy exercising": "CC-BY-4.0",
    "The Artistic License 2.0\n\nCopyright (c) 2000-2006, The Perl Foundation.": "Artistic-2.0",
    "MIT License\n\nCopyright (c) 2020 A. Holder\n\nAll rights reserved.": "MIT",
    "Copyright (c) 2020 A. Holder. All rights reserved.": "Proprietary",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "It is not licensed under the MIT and BSD licenses.": "",
    "A driving license and a fishing license are needed.": "",
    "Licensed under the LGPL 2.1 or later and the ISC license": "ISC,LGPL-2.1-or-later",
}


def test_named_licences_in_spark_and_sql(spark):
    rows = list(enumerate(CASES))
    got = {r.doc_id: (r.licenses, r.licensed) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[k][0] for k, t in rows} == CASES
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    told = con.execute(ORACLE_SQL)
    at = {c[0]: k for k, c in enumerate(told.description)}
    assert {r[at["doc_id"]]: (r[at["licenses"]], r[at["licensed"]]) for r in told.fetchall()} == got
