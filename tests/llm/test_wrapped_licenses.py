"""Licence sentences that are wrapped over lines, plain and in comments."""

from __future__ import annotations

import pytest

from tessera.llm.licenses import license_scan

BSD2 = """Copyright (c) 2020, A. Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = f"""{BSD2}
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MIT = """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation files, to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
LGPL = "This library is licensed under the GNU Lesser\nGeneral Public License, version 2.1."
CC = "The pictures are licensed under the Creative Commons\nAttribution-NonCommercial\n4.0\nand no more"
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS).
"""
MIT_END = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
APACHE = """Copyright 2021 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def gnu(what, kind, mark, version):
    return f"""This {what} is free software{mark} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{',' if mark == ':' else ';'} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this {what}.  If not, see <http://www.gnu.org/licenses/>.
"""


LINUX = """This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License version 2 as published by
the Free Software Foundation.
"""
UNLICENSE = "This is free and unencumbered software released into the public\ndomain.\n\nAnyone is free to copy."
BSD_IDS = "copyright,reserved,bsd-head,bsd-source,bsd-binary"
GNU_REST = "gpl-hope,gpl-copy"
#: Text, identifiers of its sentences, licences.
WANT = [
    (BSD2, BSD_IDS, "BSD-2-Clause"),
    (BSD3, f"{BSD_IDS},bsd-names", "BSD-3-Clause"),
    (BSD2 + BSD_END, f"{BSD_IDS},bsd-as-is,bsd-liability", "BSD-2-Clause"),
    (BSD3 + BSD_END, f"{BSD_IDS},bsd-names,bsd-as-is,bsd-liability", "BSD-3-Clause"),
    (MIT, "mit-grant,mit-notice", "MIT"),
    ("MIT License\n\nCopyright (c) 2019 A. Holder\n\n" + MIT + MIT_END, "mit-title,copyright,mit-grant,mit-notice,mit-as-is,mit-liability", "MIT"),
    (ISC, "isc-grant,isc-as-is", "ISC"),
    (APACHE, "copyright,apache-grant,apache-copy,apache-as-is,apache-see", "Apache-2.0"),
    (gnu("program", "", ":", 3), f"GPL-3.0-or-later,{GNU_REST}", "GPL-3.0-or-later"),
    (gnu("program", "", ";", 2), f"GPL-2.0-or-later,{GNU_REST}", "GPL-2.0-or-later"),
    (gnu("library", "Lesser ", ";", "2.1"), f"LGPL-2.1-or-later,{GNU_REST}", "LGPL-2.1-or-later"),
    (gnu("library", "Library ", ";", "2"), f"LGPL-2.0-or-later,{GNU_REST}", "LGPL-2.0-or-later"),
    (gnu("program", "Affero ", ":", 3), f"AGPL-3.0-or-later,{GNU_REST}", "AGPL-3.0-or-later"),
    (LINUX, "GPL-2.0-only", "GPL-2.0-only"),
    (MPL, "mpl-2,mpl-copy", "MPL-2.0"),
    (LGPL, "LGPL-2.1", "LGPL-2.1"),
    (CC, "CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC-ND 3.0. Licensed under CC BY 4.0.", "CC-BY-NC-ND-3.0,CC-BY-4.0", "CC-BY-4.0,CC-BY-NC-ND-3.0"),
    (UNLICENSE, "unlicense", "Unlicense"),
    ("Released under the MIT License. Text.\n" + APACHE, "mit-mention,copyright,apache-grant,apache-copy,apache-as-is,apache-see", "Apache-2.0,MIT"),
    ("Copyright 2020 Them.\n\nAll rights reserved.", "copyright,reserved", "Proprietary"),
    ("It is not licensed under the Apache License, Version 2.0.", "", ""),
    ("Unlike others, this is never distributed under the GNU General\nPublic License.", "", ""),
    ("Permission is hereby granted to enter. A driving license is needed.", "", ""),
]


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", "-- ", "> "])
def test_wrapped_licences(spark, prefix):
    rows = [(k, "".join(prefix + line for line in text.splitlines(keepends=True))) for k, (text, *_) in enumerate(WANT)]
    rows += [(k + 100, text.replace("\n", "\r\n")) for k, text in rows]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (_, ids, licenses) in enumerate(WANT):
        assert got[k] == got[k + 100] == (ids, licenses)


def test_blank_lines_and_marks_end_sentences(spark):
    rows = [(1, "with the Mozilla. Public\nsubject to the terms of the Mozilla\n\nPublic License"), (2, "subject to the terms of the Mozilla.\nPublic License"), (3, "Neither the name of it\n//\n// contributors may be used to endorse or promote products")]
    assert {r.sentence_ids for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {""}
