"""License scan by sentence rules.

Texts are normalised (lower case, letters and digits only, single spaces) with marks at line and
sentence ends, and known licence sentences are found in them, wrapped or not; the sequence of their
identifiers in a document is matched against ordered rules, each a sequence of identifiers that must
follow one another among the recognised sentences. Column functions only.

Defined results: null or empty text has no sentence and no licence; equal rows are kept; a rule is
listed once a document, in rule order; an empty table gives an empty table; extra columns are
ignored, and a kept column with a result's name gives way to it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.llm.frames import without

#: Identifier and sentence, as the public licence texts and notices have them.
SENTENCES = [
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-released", "Released under the MIT License."),
    ("mit-licensed", "Licensed under the MIT License."),
    ("mit-subject", "This software is released under the MIT License."),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("gpl3-work", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-details", "See the GNU General Public License for more details."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "This work is dedicated to the public domain."),
    ("reserved", "All rights reserved."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl-details", "See the GNU Lesser General Public License for more details."),
    ("agpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-details", "See the GNU Affero General Public License for more details."),
    ("mpl-subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense-domain", "This is free and unencumbered software released into the public domain."),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-liability", "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("apache-title", "Apache License Version 2.0, January 2004"),
    ("apache-terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("apache-submission", "Unless You explicitly state otherwise, any Contribution intentionally submitted for inclusion in the Work by You to the Licensor shall be under the terms and conditions of this License, without any additional terms or conditions."),
    ("gpl2-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl3-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl21-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl3-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl3-title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("gnu-copies", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("gpl3-preamble", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("agpl3-preamble", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("gpl2-preamble", "The licenses for most software are designed to take away your freedom to share and change it."),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program."),
    ("lgpl-copy", "You should have received a copy of the GNU Lesser General Public License along with this program."),
    ("agpl-copy", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("mpl-title", "Mozilla Public License Version 2.0"),
    ("isc-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("unlicense-free", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib-warranty", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-title", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("boost-notice", "Distributed under the Boost Software License, Version 1.0."),
    ("apache-short", "Licensed under the Apache License 2.0."),
    ("apache-free", "Released under the Apache License 2.0."),
    ("bsd3-notice", "Licensed under the BSD 3-Clause License."),
    ("bsd2-notice", "Licensed under the BSD 2-Clause License."),
    ("gpl3-notice", "Licensed under the GNU General Public License v3.0."),
    ("gpl3-terms", "Licensed under the terms of the GNU General Public License, version 3."),
    ("mit-terms", "Licensed under the terms of the MIT License."),
    ("mit-available", "Available under the MIT License."),
    ("mit-distributed", "Distributed under the MIT License."),
    ("cc-by-work", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-work", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("confidential", "Proprietary and confidential."),
    ("unauthorized", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
]
#: Identifiers of the SPDX list, whose lines are sentences too, and their licences.
SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0",
    "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "MPL-2.0": "MPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0",
    "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0",
}
#: Ordered rules: licence, class, sentence identifiers in order. Longer rules come first.
RULES = [
    ("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("GPL-2.0", "copyleft", ["gpl2-free"]),
    ("LGPL-2.1", "copyleft", ["lgpl21-free"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-free"]),
    ("AGPL-3.0", "copyleft", ["agpl3-free"]),
    ("MPL-2.0", "copyleft", ["mpl-subject"]),
    ("ISC", "permissive", ["isc-grant"]),
    ("Unlicense", "permissive", ["unlicense-domain"]),
    ("Apache-2.0", "permissive", ["apache-header", "apache-copy", "apache-as-is", "apache-see"]),
    ("GPL-3.0", "copyleft", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", "permissive", ["apache-header"]),
    ("Apache-2.0", "permissive", ["apache-notice"]),
    ("GPL-3.0", "copyleft", ["gpl3-work"]),
    ("GPL-3.0", "copyleft", ["gpl-free"]),
    ("MIT", "permissive", ["mit-released"]),
    ("MIT", "permissive", ["mit-licensed"]),
    ("MIT", "permissive", ["mit-subject"]),
    ("CC-BY-4.0", "permissive", ["cc-by"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", "restricted", ["cc-by-nc"]),
    ("CC-BY-NC-4.0", "restricted", ["cc-by-nc-work"]),
    ("CC0-1.0", "permissive", ["cc0"]),
    ("Proprietary", "restricted", ["reserved"]),
    ("MIT", "permissive", ["mit-warranty"]),
    ("Apache-2.0", "permissive", ["apache-title", "apache-terms"]),
    ("Apache-2.0", "permissive", ["apache-title"]),
    ("Apache-2.0", "permissive", ["apache-short"]),
    ("Apache-2.0", "permissive", ["apache-free"]),
    ("GPL-2.0", "copyleft", ["gpl2-title"]),
    ("GPL-3.0", "copyleft", ["gpl3-title"]),
    ("GPL-3.0", "copyleft", ["gpl3-preamble"]),
    ("GPL-3.0", "copyleft", ["gpl3-notice"]),
    ("GPL-3.0", "copyleft", ["gpl3-terms"]),
    ("LGPL-2.1", "copyleft", ["lgpl21-title"]),
    ("LGPL-3.0", "copyleft", ["lgpl3-title"]),
    ("AGPL-3.0", "copyleft", ["agpl3-title"]),
    ("MPL-2.0", "copyleft", ["mpl-title"]),
    ("Zlib", "permissive", ["zlib-warranty", "zlib-grant"]),
    ("Zlib", "permissive", ["zlib-grant"]),
    ("BSL-1.0", "permissive", ["boost-title"]),
    ("BSL-1.0", "permissive", ["boost-notice"]),
    ("BSD-3-Clause", "permissive", ["bsd3-notice"]),
    ("BSD-2-Clause", "permissive", ["bsd2-notice"]),
    ("MIT", "permissive", ["mit-terms"]),
    ("MIT", "permissive", ["mit-available"]),
    ("MIT", "permissive", ["mit-distributed"]),
    ("CC-BY-4.0", "permissive", ["cc-by-work"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa-work"]),
    ("Proprietary", "restricted", ["confidential"]),
    ("Proprietary", "restricted", ["unauthorized"]),
]
_CLASS = {name: kind for name, kind, _ in RULES}
SENTENCES += [(f"spdx-{i.lower()}", f"SPDX-License-Identifier: {i}") for i in SPDX]
RULES += [(name, _CLASS[name], [f"spdx-{i.lower()}"]) for i, name in SPDX.items()]
#: What may stand before a sentence that begins with one of these words: a subject such as "this project is". One class of
#: characters is repeated, not a group, so that a long line takes no deep recursion.
SUBJECT, VERBS = r"(?:this|the|our|all)[\x20\x02][\p{L}\p{N}\x20\x02]*?[\x20\x02](?:is|are)[\x20\x02]+", ("licensed ", "released ", "distributed ", "available ")
#: Part of a known sentence that names a holder, with the words that may stand in its place.
HOLDER, ANY_HOLDER = "the copyright holder", "[^\x01]+?"
#: The sentence that belongs to a copyright line where a licence follows it.
RESERVED = "reserved"
SENTENCE_END = r"[.!?:]+(?=[\x20\x09-\x0D]|$)"
#: A line end before a line without any letter or digit, such as an empty comment line.
BLANK_LINE = r"\n[^\p{L}\p{N}\n]*(?=\n)"
#: Leaders of comment lines that are words; the others are no letters and fall away.
LEADER = r"(?<![^\n])[\x20\t]*+(?i:dnl|rem)(?=[\x20\t\r\n])"
NOT_WORD = r"[^\p{L}\p{N}\x01-\x03]+"
#: Marks of a blank line, of a line end and of a sentence's end.
BLANK, LINE, END = "\x01", "\x02", "\x03"
MARKS = r"[\x20\x01-\x03]+"


def normalised(sentence: str) -> str:
    """The form of a known sentence that the column expression gives for it in a text."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def wrapped(sentence: str) -> str:
    """A pattern of a known sentence in a marked text: its pieces in order, wrapped at any word."""
    pieces = [normalised(x).replace(" ", r"[\x20\x02]+") for x in re.split(r"[.!?:]+(?=\s|$)", sentence) if normalised(x)]
    line = r"[\x20\x02\x03]+".join(pieces)
    if normalised(sentence).startswith(VERBS):
        line = f"(?:{SUBJECT})?{line}"
    return line.replace(HOLDER.replace(" ", r"[\x20\x02]+"), ANY_HOLDER)


def recognised(text: Column, sentences: list[tuple[str, str]] = SENTENCES) -> Column:
    """Identifiers of the known sentences of ``text``, in order.

    A known sentence begins and ends at a line or sentence end. Inside it a line end is a space; a
    blank line is none.
    """
    known = {normalised(s): i for i, s in sentences}
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(LINE), F.lit(" ")), F.lit(END), F.lit(" "))
    cut = F.regexp_replace(F.regexp_replace(plain, LEADER, ""), SENTENCE_END, END)
    lines = F.replace(F.regexp_replace(cut, BLANK_LINE, BLANK), F.lit("\n"), F.lit(LINE))
    marked = F.regexp_replace(F.lower(lines), NOT_WORD, " ")
    longest = sorted((s for _, s in sentences), key=lambda s: -len(normalised(s)))
    any_of = "|".join(map(wrapped, longest))
    found = F.regexp_extract_all(marked, F.lit(rf"(?<![^\x01-\x03])\x20?(?:{any_of})(?=\x20?(?:[\x01-\x03]|\z))"), F.lit(0))
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # A holder's name is put back to the words of the known sentence.
    holders = [normalised(s).split(HOLDER) for _, s in sentences if HOLDER in normalised(s)]

    def identifier(m: Column) -> Column:
        one = F.regexp_replace(F.btrim(F.regexp_replace(m, MARKS, " ")), rf"^{SUBJECT}(?={'|'.join(VERBS)})", "")
        for before, after in holders:
            named = one.startswith(before) & one.endswith(after)
            one = F.when(named, F.lit(before + HOLDER + after)).otherwise(one)
        return F.coalesce(F.try_element_at(ids, one), F.try_element_at(ids, F.btrim(F.regexp_replace(m, MARKS, " "))))

    return F.transform(found, identifier)


def scan(
    docs: DataFrame, keep: list[str], text: str = "text", rules: list[tuple[str, str, list[str]]] = RULES
) -> DataFrame:
    """``keep`` with ``n_known``, ``sentence_ids``, ``licenses`` and ``license_class`` of each document.

    The class is the strictest of the matched rules: restricted, copyleft, permissive or none. Rights
    reserved directly before a licence are part of its copyright line and restrict nothing.
    """
    keep = without(keep, ["n_known", "sentence_ids", "licenses", "license_class"])
    picked = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], recognised(F.col(text)).alias("ids"))
    granting = "|".join(" ".join(ids) for _, kind, ids in rules if kind != "restricted")
    joined = F.concat(F.lit(" "), F.array_join("ids", " "), F.lit(" "))
    line = F.regexp_replace(joined, rf"(?:\x20{RESERVED})++(?=\x20(?:{granting})\x20)", "") if granting else joined
    by_name: dict[str, Column] = {}
    classes: dict[str, Column] = {}
    for name, kind, ids in rules:
        left = line
        for other, _, longer in rules:
            if other != name and longer[: len(ids)] == ids and len(longer) > len(ids):
                left = F.replace(left, F.lit(" ".join(longer)), F.lit("-"))
        hit = left.contains(f" {' '.join(ids)} ")
        by_name[name] = by_name[name] | hit if name in by_name else hit
        classes[kind] = classes[kind] | hit if kind in classes else hit
    listed = F.array_join(F.array(*[F.when(hit, name) for name, hit in by_name.items()]), ",")
    strict = F.coalesce(
        *[F.when(classes[k], k) for k in ("restricted", "copyleft", "permissive") if k in classes], F.lit("none")
    )
    return picked.select(
        *[F.col(f"k_{c}").alias(c) for c in keep],
        F.size("ids").cast("bigint").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        listed.alias("licenses"),
        strict.alias("license_class"),
    )
