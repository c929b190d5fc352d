"""Licence scans by sentence rules, in DataFrame operations only.

A text's sentences, normalised, are looked up among the known licence sentences. The sequence of identifiers found
is matched against the licence rules in their order; a rule takes the sentences that it matches, so that a licence's
full text isn't found again by its notice. A known sentence that the parting of texts cuts is known by its pieces, too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, punctuated so that they are cut as in the usual notices.
SENTENCES = {
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-licensed-the-license": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-compliance": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-permissions": "See the License for the specific language governing permissions and limitations under the License",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-title-short": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-conditions-reserved": "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-licensed": "Licensed under the BSD License",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "apache-title": "Apache License",
    "gpl2-date": "Version 2, June 1991",
    "gpl3-date": "Version 3, 29 June 2007",
    "lgpl21-date": "Version 2.1, February 1999",
    "agpl3-date": "Version 3, 19 November 2007",
    "apache2-date": "Version 2.0, January 2004",
    "lgpl21-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "agpl3-terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "mpl2-full": "Mozilla Public License Version 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "epl2-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "epl2-full": "Eclipse Public License - v 2.0",
    "bsd-as-is": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-line": "Distributed under the Boost Software License, Version 1.0",
    "boost-full": "Boost Software License - Version 1.0 - August 17th, 2003",
    "artistic2-full": "The Artistic License 2.0",
    "perl-terms": "you can redistribute it and/or modify it under the same terms as Perl itself",
    "cc0-full": "CC0 1.0 Universal",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc-by-sa-4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-4-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "Copyright holders reserve all rights",
    "reserved-line": "All rights reserved",
}
#: Rules in order: licence, whether it lets anyone use the text for any purpose, sentences in order.
RULES = [
    ("Apache-2.0", True, ["apache-licensed-the-license", "apache-compliance", "apache-obtain", "apache-as-is", "apache-permissions"]),
    ("Apache-2.0", True, ["apache-licensed-the-license", "apache-compliance"]),
    ("MIT", True, ["mit-title", "mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", True, ["mit-title-short", "mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", True, ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", True, ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", True, ["bsd-conditions-reserved", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    ("BSD-2-Clause", True, ["bsd-conditions-reserved", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-3-Clause", True, ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    ("BSD-2-Clause", True, ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-3-Clause", True, ["bsd-conditions-reserved", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", True, ["bsd-conditions-reserved", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", True, ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", True, ["bsd-conditions", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", True, ["apache-title", "apache2-date"]),
    ("GPL-2.0", False, ["gpl-title", "gpl2-date"]),
    ("GPL-3.0", False, ["gpl-title", "gpl3-date"]),
    ("LGPL-2.1", False, ["lgpl-title", "lgpl21-date"]),
    ("LGPL-3.0", False, ["lgpl-title", "gpl3-date"]),
    ("AGPL-3.0", False, ["agpl-title", "agpl3-date"]),
    ("MPL-2.0", False, ["mpl2-full"]),
    ("EPL-2.0", False, ["epl2-full"]),
    ("BSL-1.0", True, ["boost-full"]),
    ("Artistic-2.0", True, ["artistic2-full"]),
    ("CC0-1.0", True, ["cc0-full"]),
    ("CC0-1.0", True, ["cc0-dedicated"]),
    ("LGPL-2.1-or-later", False, ["lgpl21-terms", "lgpl-warranty"]),
    ("LGPL-3.0-or-later", False, ["lgpl3-terms", "lgpl-warranty"]),
    ("AGPL-3.0-or-later", False, ["agpl3-terms", "gpl-warranty"]),
    ("LGPL-2.1-or-later", False, ["lgpl21-terms"]),
    ("LGPL-3.0-or-later", False, ["lgpl3-terms"]),
    ("AGPL-3.0-or-later", False, ["agpl3-terms"]),
    ("Zlib", True, ["zlib-as-is", "zlib-grant"]),
    ("BSL-1.0", True, ["boost-line"]),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", True, ["perl-terms"]),
    ("EPL-2.0", False, ["epl2-made"]),
    ("CC-BY-SA-4.0", False, ["cc-by-sa-4-work"]),
    ("CC-BY-NC-4.0", False, ["cc-by-nc-4-work"]),
    ("CC-BY-ND-4.0", False, ["cc-by-nd-4-work"]),
    ("MPL-2.0", False, ["mpl2-form", "mpl2-copy"]),
    ("GPL-3.0-or-later", False, ["gpl3-terms", "gpl-warranty"]),
    ("GPL-2.0-or-later", False, ["gpl2-terms", "gpl-warranty"]),
    ("GPL-3.0-or-later", False, ["gpl3-terms"]),
    ("GPL-2.0-or-later", False, ["gpl2-terms"]),
    ("GPL-3.0-only", False, ["gpl3-work"]),
    ("ISC", True, ["isc-grant"]),
    ("Apache-2.0", True, ["apache-licensed"]),
    ("MIT", True, ["mit-released"]),
    ("MIT", True, ["mit-licensed"]),
    ("BSD", True, ["bsd-licensed"]),
    ("CC-BY-NC-4.0", False, ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", False, ["cc-by-sa-4"]),
    ("CC-BY-4.0", True, ["cc-by-4"]),
    ("CC-BY-4.0", True, ["cc-by-4-work"]),
    ("MPL-2.0", False, ["mpl2-form"]),
    ("Unlicense", True, ["unlicense"]),
    ("all-rights-reserved", False, ["reserved"]),
    ("all-rights-reserved", False, ["reserved-line"]),
]
#: The short form of licences in source files, and whether they let anyone use the text for any purpose.
SHORT_FORMS = {"0BSD": True, "AGPL-3.0-only": False, "AGPL-3.0-or-later": False, "Apache-2.0": True, "BSD-2-Clause": True, "BSD-3-Clause": True, "BSL-1.0": True, "CC-BY-4.0": True, "CC-BY-SA-4.0": False, "CC0-1.0": True, "EPL-2.0": False, "GPL-2.0-only": False, "GPL-2.0-or-later": False, "GPL-3.0-only": False, "GPL-3.0-or-later": False, "ISC": True, "LGPL-2.1-only": False, "LGPL-2.1-or-later": False, "LGPL-3.0-or-later": False, "MIT": True, "MPL-2.0": False, "Unlicense": True, "Zlib": True}
SENTENCES |= {f"spdx-{x.lower().replace('.', '-')}": f"SPDX-License-Identifier: {x}" for x in SHORT_FORMS}
RULES += [(x, free, [f"spdx-{x.lower().replace('.', '-')}"]) for x, free in SHORT_FORMS.items()]
#: Slots of normalised sentences, and what they count as: names of holders, by which notices differ.
SLOTS = [
    ("^neither the name of .* nor the names of its contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    ("^the name of .* may not be used to endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    ("^(this software is provided by) .* (as is and any express or implied warranties)", r"\1 the copyright holders and contributors \2"),
    ("^to the extent possible under law .* (?:has|have) (?:waived|dedicated) all copyright and related (?:or|and) neighboring rights to .*$", "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("^(this program and the accompanying materials are made available under the terms of the eclipse public license) v(?:ersion)? ?(2 0)", r"\1 \2"),
    ("^this (program|library|software|package) is (free software) (you can redistribute)", r"\3"),
]
#: Every rule has a sentence with one of these; other texts aren't parted at all.
HINT = "licen[sc]e|cc0|copyright|redistribut|warranty|permission|public domain|reserve"
SPACE = r"[ \t\n\x0B\f\r]"
SEP = "\x01"


def normalise(sentence: str) -> str:
    """Lower case, and one space for each run of what isn't a letter or digit of ASCII."""
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def slotted(norm: str) -> str:
    """A normalised sentence with its slots as they are known."""
    for pattern, put in SLOTS:
        norm = re.sub(pattern, put, norm)
    return norm


def pieces(sentence: str) -> list[str]:
    """The normalised pieces that a text's parting makes of a sentence."""
    return [slotted(normalise(s)) for s in re.split(rf"[.;:!?]{SPACE}+|\n{SPACE}*\n", sentence)]


KNOWN = {slotted(normalise(s)): k for k, s in SENTENCES.items()}
# a piece that is known already, or belongs to two sentences, keeps its first identifier
for _k, _s in SENTENCES.items():
    for _n, _piece in enumerate(pieces(_s) if len(pieces(_s)) > 1 else [], 1):
        KNOWN.setdefault(_piece, f"{_k}-{_n}")


def rule_pattern(sentences: list[str]) -> str:
    """Finds the identifiers in order in a string like "a b c ", others between them left in groups.

    A sentence that is cut stands as a whole, or as all its pieces with nothing between them.
    """
    cut = {s: " ".join(KNOWN[x] for x in pieces(SENTENCES[s])) for s in sentences}
    return "(^| )" + "((?:[a-z0-9-]+ )*?)".join(f"{s} " if cut[s] == s else f"(?:{s}|{cut[s]}) " for s in sentences)


def _identifiers(text: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in KNOWN.items() for x in kv])
    def norm(s: Column) -> Column:
        out = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
        for pattern, put in SLOTS:
            out = F.regexp_replace(out, pattern, put.replace("\\", "$"))
        return out

    ident = lambda s: F.try_element_at(lookup, norm(s))
    sentences = F.split(F.regexp_replace(F.regexp_replace(text, rf"([.;:!?]){SPACE}+", f"$1{SEP}"), rf"\n{SPACE}*\n", SEP), SEP)
    lines = lambda s: F.filter(F.transform(F.split(s, "\n"), ident), lambda x: x.isNotNull())
    # a sentence over several lines, or else known sentences that stand on lines of their own
    return F.flatten(F.transform(sentences, lambda s: F.when(ident(s).isNotNull(), F.array(ident(s))).otherwise(lines(s))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licences, n_licences, open_use): a row per document.

    sentence_ids: the known sentences, or pieces of those that are cut, in text order, parted by spaces; licences: what
    the rules find, each once, in the order of the rules, parted by commas; open_use: at least one, and all of them, let
    anyone use the text. Null texts and those without known sentences have empty strings. Repeated rows count each; an
    empty table gives none; other columns are ignored.
    """
    text = F.col("text")
    found = docs.select("doc_id", F.when(F.lower(text).rlike(HINT), F.array_join(_identifiers(text), " ")).alias("ids"))
    found = found.select("doc_id", F.coalesce("ids", F.lit("")).alias("sentence_ids"))
    rows = found.withColumn("rest", F.when(F.col("sentence_ids") != "", F.concat("sentence_ids", F.lit(" "))).otherwise("")).withColumn("found", F.array().cast("array<int>"))
    for n, (_, _, sentences) in enumerate(RULES):
        hit = F.col("rest").rlike(rule_pattern(sentences))
        gaps = "".join(f"${k + 1}" for k in range(len(sentences)))
        # both from the same rest; a rule takes all that it matches at once
        rows = rows.withColumns({"found": F.when(hit, F.concat("found", F.array(F.lit(n)))).otherwise(F.col("found")), "rest": F.when(hit, F.regexp_replace("rest", rule_pattern(sentences), gaps)).otherwise(F.col("rest"))})
    names, uses = F.array(*[F.lit(x) for x, _, _ in RULES]), F.array(*[F.lit(x) for _, x, _ in RULES])
    licences = F.array_distinct(F.transform("found", lambda n: F.element_at(names, n + 1)))
    return rows.select(
        "doc_id", "sentence_ids", F.array_join(licences, ",").alias("licences"), F.size(licences).cast("bigint").alias("n_licences"), ((F.size("found") > 0) & F.forall("found", lambda n: F.element_at(uses, n + 1))).alias("open_use")
    )


def oracle() -> str:
    """The same in DuckDB SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(k)}, {q(v)})" for k, v in KNOWN.items())

    def norm(s: str) -> str:
        out = f"trim(regexp_replace(lower({s}), '[^a-z0-9]+', ' ', 'g'))"
        for pattern, put in SLOTS:
            out = f"regexp_replace({out}, {q(pattern)}, {q(put)})"
        return out

    steps, last = [], "z"
    for n, (_, _, sentences) in enumerate(RULES):
        p, gaps = q(rule_pattern(sentences)), "".join(f"\\{k + 1}" for k in range(len(sentences)))
        steps.append(f"r{n} AS (SELECT doc_id, sentence_ids, CASE WHEN regexp_matches(rest, {p}) THEN regexp_replace(rest, {p}, '{gaps}', 'g') ELSE rest END AS rest, CASE WHEN regexp_matches(rest, {p}) THEN list_append(hits, {n}) ELSE hits END AS hits FROM {last})")
        last = f"r{n}"
    rules = ", ".join(f"({n}, {q(x)}, {str(u).lower()})" for n, (x, u, _) in enumerate(RULES))
    return rf"""
WITH known(norm, id) AS (VALUES {values}),
rules(n, licence, free) AS (VALUES {rules}),
s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.;:!?]){SPACE}+', '\1' || chr(1), 'g'), '\n{SPACE}*\n', chr(1), 'g'), chr(1)) AS parts FROM documents WHERE regexp_matches(lower(text), '{HINT}')),
a AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM s),
b AS (SELECT a.doc_id, a.i, k.id, a.part FROM a LEFT JOIN known k ON k.norm = {norm('a.part')}),
l AS (SELECT doc_id, i, unnest(string_split(part, chr(10))) AS line, generate_subscripts(string_split(part, chr(10)), 1) AS j FROM b WHERE id IS NULL),
u AS (SELECT doc_id, i, 0 AS j, id FROM b WHERE id IS NOT NULL UNION ALL SELECT l.doc_id, l.i, l.j, k.id FROM l JOIN known k ON k.norm = {norm('l.line')}),
g AS (SELECT doc_id, string_agg(id, ' ' ORDER BY i, j) AS ids FROM u GROUP BY doc_id),
z AS (SELECT d.doc_id, coalesce(g.ids, '') AS sentence_ids, CASE WHEN g.ids IS NULL THEN '' ELSE g.ids || ' ' END AS rest, CAST([] AS INTEGER[]) AS hits FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id),
{', '.join(steps)},
h AS (SELECT doc_id, unnest(hits) AS n FROM {last}),
m AS (SELECT h.doc_id, r.licence, min(h.n) AS n, bool_and(r.free) AS free FROM h JOIN rules r ON r.n = h.n GROUP BY h.doc_id, r.licence),
o AS (SELECT doc_id, string_agg(licence, ',' ORDER BY n) AS licences, count(*) AS n_licences, bool_and(free) AS open_use FROM m GROUP BY doc_id)
SELECT z.doc_id, z.sentence_ids, coalesce(o.licences, '') AS licences, coalesce(o.n_licences, 0) AS n_licences, coalesce(o.open_use, false) AS open_use FROM z LEFT JOIN o ON o.doc_id = z.doc_id"""
