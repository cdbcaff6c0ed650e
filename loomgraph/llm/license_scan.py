"""Licence scan by sentence rules, all of it JVM-side expressions on one row: no join, no shuffle, no Python.

A text is cut into sentences, each is normalised (A-Z lowered, runs of other than letters and digits to one blank),
known licence sentences become identifiers, and the sequence of identifiers of a document is matched against an
ordered list of rules; a rule is a run of identifiers. Unknown sentences between two known ones do not break a run.

Sentences end at .!? and at a newline; a known sentence may also run over several lines (hard-wrapped, with or without
comment marks), from the start of a line or sentence to the end of one, but not over a blank line. Of those that start at
one place the longest counts. A known sentence that itself holds a stop ("v. 2.0") is known whole, stop included. `n_sentences` counts by lines.

Null and empty texts have no sentences; no rule: `license` is null. Texts of any length are scanned whole, repeated rows each for itself, and an empty table
gives no rows; where several rules match the first in order names the licence. Control characters 1 and 2 in a text count as blanks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STOP = "[.!?]+([ \\t\\n\\f\\r]|$)"
#: between two words of a known sentence: a blank or one line break
GAP = "(?: ?\u0002 ?| )"
#: a stop inside a known sentence
INNER = " ?\u0001 ?\u0002? ?"

#: identifier -> sentence (fixed values: wordings of public licences and the notices that refer to them).
SENTENCES = {
    1: "Licensed under the Apache License, Version 2.0",
    2: "you may not use this file except in compliance with the License",
    3: "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    4: "You may obtain a copy of the License at",
    5: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    6: "See the License for the specific language governing permissions and limitations under the License",
    10: "Released under the MIT License",
    11: "Licensed under the MIT License",
    12: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    13: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    14: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    20: "This work is licensed under the GNU General Public License, version 3",
    21: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    22: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    23: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    24: "See the GNU General Public License for more details",
    30: "Licensed under CC BY-NC 4.0",
    31: "Licensed under CC BY 4.0",
    32: "Licensed under CC BY-SA 4.0",
    33: "This work is licensed under a Creative Commons Attribution 4.0 International License",
    34: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    40: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    41: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    42: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    43: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    50: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    51: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    52: "This is free and unencumbered software released into the public domain",
    53: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    57: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    54: "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License",
    55: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1",
    56: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    60: "All rights reserved",
    70: "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    71: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    72: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    73: "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    74: "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    75: "See the GNU Lesser General Public License for more details",
    76: "See the GNU Affero General Public License for more details",
    77: "Licensed under the GNU General Public License v3.0",
    78: "Licensed under the GNU General Public License v2.0",
    80: "Distributed under the Boost Software License, Version 1.0",
    81: "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    82: "This software is provided 'as-is', without any express or implied warranty",
    83: "In no event will the authors be held liable for any damages arising from the use of this software",
    84: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    85: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    86: "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    87: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    88: "This software is distributed without any warranty",
    89: "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    90: "Licensed under the BSD 3-Clause License",
    91: "Licensed under the BSD 2-Clause License",
    92: "Licensed under the Mozilla Public License, version 2.0",
    93: "Licensed under the ISC License",
    94: "Licensed under the Eclipse Public License 2.0",
    95: "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    96: "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file",
    97: "This file is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    98: "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    99: "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
}

#: (licence, run of identifiers), the more specific first; the first that matches names the document's licence.
RULES = [
    ("Apache-2.0", (3, 4, 5, 6)), ("Apache-2.0", (3,)), ("Apache-2.0", (1, 2)), ("Apache-2.0", (1,)),
    ("BSD-4-Clause", (40, 41, 42, 89, 43)), ("BSD-3-Clause", (40, 41, 42, 43)), ("BSD-2-Clause", (40, 41, 42)), ("BSD-3-Clause", (90,)), ("BSD-2-Clause", (91,)), ("LicenseRef-BSD", (95,)),
    ("MIT", (12, 13, 14)), ("MIT", (12, 13)), ("MIT", (10,)), ("MIT", (11,)),
    ("GPL-3.0-or-later", (21, 23, 24)), ("GPL-3.0-or-later", (21,)), ("GPL-2.0-or-later", (22, 23, 24)), ("GPL-2.0-or-later", (22,)), ("GPL-3.0-only", (20,)), ("GPL-3.0-only", (77,)), ("GPL-2.0-only", (73,)), ("GPL-2.0-only", (78,)),
    ("LGPL-2.1-or-later", (70, 74, 75)), ("LGPL-2.1-or-later", (70,)), ("LGPL-3.0-or-later", (71,)), ("AGPL-3.0-or-later", (72,)),
    ("CC-BY-NC-4.0", (30,)), ("CC-BY-NC-4.0", (34,)), ("CC-BY-SA-4.0", (32,)), ("CC-BY-4.0", (31,)), ("CC-BY-4.0", (33,)),
    ("CC-BY-SA-4.0", (97,)), ("CC-BY-SA-4.0", (98,)), ("CC-BY-ND-4.0", (99,)), ("MPL-2.0", (50, 53)), ("MPL-2.0", (50, 57)), ("MPL-2.0", (50,)), ("MPL-2.0", (92,)), ("MPL-1.1", (54,)), ("MPL-1.1", (55,)),
    ("ISC", (51,)), ("0BSD", (56,)), ("ISC", (93,)), ("Unlicense", (52,)), ("BSL-1.0", (80,)), ("EPL-2.0", (81,)), ("EPL-2.0", (94,)),
    ("Zlib", (82, 83, 84)), ("WTFPL", (85,)), ("WTFPL", (86,)), ("CC0-1.0", (87, 88)), ("CC0-1.0", (87,)), ("LicenseRef-MIT-style", (96,)), ("LicenseRef-all-rights-reserved", (60,)),
]


def normal_form(sentence: str) -> str:
    """What a sentence becomes, on the driver (for the table above and for tests); inner stops stay as \u0001."""
    lower = "".join(c.lower() if c in UPPER else c for c in sentence)
    marked = re.sub("[^a-z0-9\u0001]+", " ", re.sub("[.!?]+([ \t\n\f\r]|$)", "\u0001", lower))
    return re.sub(" ?\u0001 ?", "\u0001", marked).strip(" \u0001")


def known_sentences() -> dict[str, int]:
    return {normal_form(s): n for n, s in SENTENCES.items()}


def flattened(text: Column) -> Column:
    """Normalised text; sentence ends are \u0001, other newlines \u0002."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER + "\u0001\u0002", LOWER + "  ")
    return F.regexp_replace(F.translate(F.regexp_replace(lower, STOP, "\u0001"), "\n", "\u0002"), "[^a-z0-9\u0001\u0002]+", " ")


def sentences(flat: Column) -> Column:
    """array<string> of normalised sentences, empty ones left out."""
    return F.filter(F.transform(F.split(flat, "[\u0001\u0002]"), lambda s: F.trim(s)), lambda s: s != "")


def known_pattern() -> str:
    longest_first = sorted(known_sentences(), key=len, reverse=True)
    return "(?:^|[\u0001\u0002]) ?(" + "|".join(s.replace(" ", GAP).replace("\u0001", INNER) for s in longest_first) + ")(?= ?(?:[\u0001\u0002]|$))"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_sentences long, sentence_ids array<int>, matches array<string> (in rule order), license string."""
    known = known_sentences()
    ids = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    out = docs.withColumn("_loom_s", flattened(F.col(text_col)))
    out = out.withColumn("n_sentences", F.size(sentences(F.col("_loom_s"))).cast("long"))
    met = F.regexp_extract_all("_loom_s", F.lit(known_pattern()), F.lit(1))
    out = out.withColumn("sentence_ids", F.transform(met, lambda s: F.element_at(ids, F.regexp_replace(F.regexp_replace(s, INNER, "\u0001"), GAP, " "))))
    run = F.concat(F.lit(","), F.array_join(F.col("sentence_ids").cast("array<string>"), ","), F.lit(","))
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col("_loom_run"), F.lit("," + ",".join(map(str, r)) + ",")), F.lit(name)) for name, r in RULES]))
    out = out.withColumn("_loom_run", run).withColumn("matches", F.array_distinct(hits))
    return out.withColumn("license", F.get("matches", F.lit(0))).drop("_loom_s", "_loom_run")


def scan_sql(docs: str = "documents") -> str:
    """The same rows in DuckDB, for texts whose known sentences stand on one line each."""
    known = {s.replace("\u0001", "#"): n for s, n in known_sentences().items()}
    names = ", ".join(f"'{s}'" for s in known)
    lookup = "map {" + ", ".join(f"'{s}': {n}" for s, n in known.items()) + "}"
    hits = ", ".join(f"case when contains(run, ',{','.join(map(str, r))},') then '{name}' end" for name, r in RULES)
    whole = "chr(1) || array_to_string(s, chr(1) || chr(1)) || chr(1)"
    for s in known:
        if "#" in s:  # a sentence of several parts: put together again
            whole = f"replace({whole}, chr(1) || '{s.replace('#', chr(39) + ' || chr(1) || chr(1) || ' + chr(39))}' || chr(1), chr(1) || '{s}' || chr(1))"
    return f"""
with cut as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}\u0001', '{LOWER} '),
    '[.!?]+([ \\t\\n\\f\\r]|$)|\\n', chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') as s from {docs}),
parts as (select doc_id, len(s) as n_sentences, string_split({whole}, chr(1)) as s from cut),
ids as (select doc_id, n_sentences, list_transform(list_filter(s, lambda x: x in ({names})), lambda x: cast({lookup}[x] as varchar)) as ids from parts),
runs as (select *, ',' || array_to_string(ids, ',') || ',' as run from ids),
hits as (select *, list_filter([{hits}], lambda x: x is not null) as hits from runs)
select doc_id, cast(n_sentences as bigint) as n_sentences, array_to_string(ids, ',') as sentence_ids, hits[1] as license,
    array_to_string(list_filter(hits, lambda x, i: list_position(hits, x) = i), '|') as licenses from hits"""
