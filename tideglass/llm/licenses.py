"""License scans by sentence rules (operator 8), of built-in expressions only.

A text is split into sentences, each is normalised (lower case, runs of anything but letters and digits
become one space) and looked up in the known sentences. The identifiers of a
text, in their order, are matched against the rules from top to bottom: a rule is a
sequence of identifiers, others may stand between. What a rule matches is used up, so that
a shorter rule below doesn't report the parts of a longer one again.

Licences are often wrapped, and their headings often end with a line only. So first the lines are looked at: where the first or
the last sentence of a line is known by itself, a sentence ends there, and after copyright lines; any other line goes on in the next one. Then the whole is split into sentences. So
both kinds are found in one text, in their order. Everything is done within the row: no shuffle, no join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.session import fresh

# Sentences of public licences and licence notices in normalised form, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-grant",
    "licensed under the apache license version 2 0 the license": "apache2-grant",
    "released under the apache license version 2 0": "apache2-grant",
    "this project is licensed under the apache license version 2 0": "apache2-grant",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-include",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this work is licensed under the gnu general public license version 3": "gpl3-grant",
    "licensed under the gnu general public license version 3": "gpl3-grant",
    "this work is licensed under the gnu general public license version 2": "gpl2-grant",
    "licensed under the gnu general public license version 2": "gpl2-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-or-later",
    # (the parts of notices that have a colon, semicolon or full stop within, as they are split there)
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-or-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-or-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-free",
    "either version 3 of the license or at your option any later version": "gpl3-version",
    "either version 2 of the license or at your option any later version": "gpl2-version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "licensed under the gnu lesser general public license version 3": "lgpl3-grant",
    "licensed under the gnu affero general public license version 3": "agpl3-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-grant",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by nd 4 0": "cc-by-nd-4",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4",
    "licensed under cc by nc nd 4 0": "cc-by-nc-nd-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this work is dedicated to the public domain under cc0 1 0": "cc0-grant",
    "all rights reserved": "all-rights",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "apache license": "apache-title",
    "version 2 0 january 2004": "apache2-date",
    "terms and conditions for use reproduction and distribution": "apache2-terms",
    "gnu general public license": "gpl-title",
    "gnu lesser general public license": "lgpl-title",
    "gnu affero general public license": "agpl-title",
    "version 3 29 june 2007": "gnu3-date",
    "version 2 june 1991": "gnu2-date",
    "version 2 1 february 1999": "gnu21-date",
    "version 3 19 november 2007": "agpl3-date",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-verbatim",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-or-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-or-later",
    "either version 2 1 of the license or at your option any later version": "gnu21-version",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-or-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3-terms",
    "mozilla public license version 2 0": "mpl2-title",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "boost software license version 1 0 august 17th 2003": "bsl1-title",
    "distributed under the boost software license version 1 0": "bsl1-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-grant",
    "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0": "epl1-grant",
    "do what the fuck you want to public license": "wtfpl-title",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution share alike 4 0 international license": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-4",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-4",
    "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd-4",
    "this work is licensed under the creative commons attribution 4 0 international license": "cc-by-4",
    "this work is licensed under the creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-deed",
    "creative commons attribution 4 0 international public license": "cc-by-4-title",
    "creative commons attribution sharealike 4 0 international public license": "cc-by-sa-4-title",
    "creative commons legal code": "cc-legal",
    "cc0 1 0 universal": "cc0-title",
}
# Identifiers of SPDX that may stand in a line of their own.
SPDX = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib"]
SENTENCES |= {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", x.lower()): f"spdx-{x.lower()}" for x in SPDX}
# Rules from the most to the least specific; identifiers in the order in which they must stand.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("MIT", ["mit-grant", "mit-include", "mit-warranty"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant", "isc-warranty"]),
    ("Zlib", ["zlib-grant", "zlib-altered", "zlib-notice"]),
    ("Apache-2.0", ["apache-title", "apache2-date", "apache2-terms"]),
    ("AGPL-3.0-only", ["agpl-title", "agpl3-date", "gnu-verbatim"]),
    ("LGPL-3.0-only", ["lgpl-title", "gnu3-date", "gnu-verbatim"]),
    ("LGPL-2.1-only", ["lgpl-title", "gnu21-date", "gnu-verbatim"]),
    ("GPL-3.0-only", ["gpl-title", "gnu3-date", "gnu-verbatim"]),
    ("GPL-2.0-only", ["gpl-title", "gnu2-date", "gnu-verbatim"]),
    ("CC-BY-4.0", ["cc-by-4-title"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-title"]),
    ("CC0-1.0", ["cc-legal", "cc0-title"]),
    ("Apache-2.0", ["apache2-grant", "apache2-comply", "apache2-copy", "apache2-warranty", "apache2-see"]),
    ("Apache-2.0", ["apache2-grant"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-title"]),
    ("GPL-3.0-or-later", ["gpl3-or-later", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl2-or-later", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-version", "gpl-warranty"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-version", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-version"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-version"]),
    ("AGPL-3.0-or-later", ["agpl3-or-later"]),
    ("AGPL-3.0-or-later", ["agpl-terms", "gpl3-version"]),
    ("LGPL-3.0-or-later", ["lgpl3-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl-terms", "gpl3-version"]),
    ("LGPL-2.1-or-later", ["lgpl21-or-later"]),
    ("LGPL-2.1-or-later", ["lgpl-terms", "gnu21-version"]),
    ("GPL-3.0-only", ["gpl3-terms"]),
    ("GPL-2.0-only", ["gpl2-terms"]),
    ("AGPL-3.0-only", ["agpl3-grant"]),
    ("LGPL-3.0-only", ["lgpl3-grant"]),
    ("GPL-3.0-only", ["gpl3-grant"]),
    ("GPL-2.0-only", ["gpl2-grant"]),
    ("MPL-2.0", ["mpl2-grant"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("Unlicense", ["unlicense-grant"]),
    ("BSL-1.0", ["bsl1-title"]),
    ("BSL-1.0", ["bsl1-grant"]),
    ("EPL-2.0", ["epl2-grant"]),
    ("EPL-1.0", ["epl1-grant"]),
    ("WTFPL", ["wtfpl-title"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0-grant"]),
    ("CC0-1.0", ["cc0-deed"]),
    ("all-rights-reserved", ["all-rights"]),
    *((x, [f"spdx-{x.lower()}"]) for x in SPDX),
]
# Each known sentence holds one of these, so that other texts and sentences are left out early.
CLUES = ["licens", "permi", "warrant", "redistribut", "endorse", "public domain", "rights reserved", "version 2", "version 3", "altered", "terms and", "cc0", "legal code", "copy of the mpl", "free software", "free to copy"]

#: A tag whose colon doesn't end a sentence.
TAG = r"(?i)SPDX-License-Identifier\s*:"
#: An empty line ends a sentence; line breaks with what may stand before a line of a licence inside a comment; ends of sentences inside a line, and in the whole.
PARAGRAPH = r"\n[ \t\r]*\n\s*"
BREAK = r"[ \t]*[\r\n]+[ \t]*(?:[#*;]+|//+|--+)?[ \t]*"
INSIDE, ENDS = r"[.:;][ \t]+", r"[.:;]\s+"
#: Lines that say whose the text is; they end with the line.
OWNER = r"(?i)^[^a-z0-9]*copyright[^a-z]"


def normalise(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _clued(text: Column) -> Column:
    found = F.lit(False)
    for clue in CLUES:
        found = found | text.contains(clue)
    return found


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences in their order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    one = lambda s: F.element_at(known, normalise(s))
    plain = F.regexp_replace(F.regexp_replace(text, TAG, "SPDX-License-Identifier "), PARAGRAPH, ".\n")

    def marked(line: Column) -> Column:
        parts = F.split(line, INSIDE)
        return F.concat(F.when(one(parts[0]).isNotNull(), ". ").otherwise(""), line, F.when(line.rlike(OWNER) | one(F.element_at(parts, -1)).isNotNull(), ". ").otherwise(" "))

    whole = F.array_join(F.transform(F.split(plain, BREAK), marked), "")
    sentences = F.transform(F.split(whole, ENDS), normalise)
    return F.filter(F.transform(F.filter(sentences, _clued), lambda s: F.element_at(known, s)), lambda i: i.isNotNull())


def _pattern(sequence: list[str]) -> str:
    return "(?s)" + "(.*?)".join(f" {i} " for i in sequence)


def match_rules(ids: Column) -> Column:
    """The licences, once each, in the order of the rules."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_pattern(seq)).alias("pattern"), F.lit("".join(f"${i}" for i in range(1, len(seq)))).alias("rest")) for name, seq in RULES])
    start = F.struct(F.array().cast("array<string>").alias("found"), F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.rlike(acc["left"], rule["pattern"])
        return F.struct(
            F.when(hit, F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"),
            F.when(hit, F.regexp_replace(acc["left"], rule["pattern"], rule["rest"])).otherwise(acc["left"]).alias("left"),
        )

    return F.aggregate(rules, start, step, lambda acc: F.array_distinct(acc["found"]))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of df with license_ids and sentence_ids: arrays of licences and of known sentences.

    Null, empty and other texts without a known sentence get empty arrays; repeated rows are scanned each for themselves; an empty table gives no rows. Columns of df with
    these two names are replaced, all others stay.
    """
    ids, found = fresh(df, "_ids", "_found")
    body, none = F.coalesce(F.col(text), F.lit("")), F.array().cast("array<string>")
    looked = df.withColumn(ids, F.when(_clued(F.lower(body)), sentence_ids(body)).otherwise(none))
    looked = looked.withColumn(found, F.when(F.size(ids) > 0, match_rules(F.col(ids))).otherwise(none))
    return looked.withColumns({"license_ids": F.col(found), "sentence_ids": F.col(ids)}).drop(ids, found)


def oracle_sql() -> str:
    """The scan of documents as DuckDB SQL, made of the same fixed values."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in SENTENCES.items())
    clued = lambda x: "(" + " OR ".join(f"contains({x}, {quote(c)})" for c in CLUES) + ")"
    steps, last = [], "chosen"
    for n, (name, seq) in enumerate(RULES):
        pattern = _pattern(seq).removeprefix("(?s)")
        rest = "".join(f"\\{i}" for i in range(1, len(seq)))
        steps.append(
            f"r{n} AS (SELECT r, ids, CASE WHEN regexp_matches(l, {quote(pattern)}, 's') THEN list_append(found, {quote(name)}) ELSE found END AS found, "
            f"regexp_replace(l, {quote(pattern)}, {quote(rest)}, 'gs') AS l FROM {last})"
        )
        last = f"r{n}"
    plain = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return (
        f"WITH known(s, id) AS (VALUES {known}), d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),\n"
        f"t AS (SELECT r, string_split_regex(regexp_replace(regexp_replace(text, {quote(TAG)}, 'SPDX-License-Identifier ', 'g'), {quote(PARAGRAPH)}, '.' || chr(10), 'g'), {quote(BREAK)}) AS x FROM d WHERE {clued('lower(text)')}),\n"
        "line AS (SELECT r, unnest(x) AS l, generate_subscripts(x, 1) AS i FROM t),\n"
        f"part AS (SELECT r, i, l, string_split_regex(l, {quote(INSIDE)}) AS p FROM line),\n"
        f"mark AS (SELECT r, i, CASE WHEN a.id IS NOT NULL THEN '. ' ELSE '' END || l || CASE WHEN b.id IS NOT NULL OR regexp_matches(l, {quote(OWNER)}) THEN '. ' ELSE ' ' END AS l FROM part LEFT JOIN known a ON a.s = {plain('p[1]')} LEFT JOIN known b ON b.s = {plain('p[-1]')}),\n"
        f"whole AS (SELECT r, string_split_regex(string_agg(l, '' ORDER BY i), {quote(ENDS)}) AS x FROM mark GROUP BY r),\n"
        f"said AS (SELECT r, list(id ORDER BY i) AS ids FROM (SELECT r, i, {plain('s')} AS s FROM (SELECT r, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM whole)) p JOIN known k ON p.s = k.s WHERE {clued('p.s')} GROUP BY r),\n"
        "chosen AS (SELECT r, coalesce(ids, []) AS ids, CAST([] AS VARCHAR[]) AS found, ' ' || array_to_string(coalesce(ids, []), '  ') || ' ' AS l FROM d LEFT JOIN said USING (r)),\n"
        + ",\n".join(steps)
        + f"\nSELECT doc_id, coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ','), '') AS license_ids, coalesce(array_to_string(ids, ','), '') AS sentence_ids FROM {last} JOIN d USING (r)"
    )
