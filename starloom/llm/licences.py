"""Licence recognition by sentence rules.

A text is cut into sentences; a sentence, normalised, may be a known licence
sentence and then stands for an identifier. The sequence of a text's
identifiers is matched against an ordered list of rules: a rule takes its
sequence of identifiers out wherever it stands, so a later rule sees only what
the earlier ones left. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import free_name

# Licence sentences in normalised form (lower case, single spaces, letters and digits only), by identifier.
SENTENCES = {
    "Apache2": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this file is licensed to you under the apache license version 2 0 the license"],
    "Apache2Only": ["you may not use this file except in compliance with the license"],
    "Apache2Copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "Apache2AsIs": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "Apache2See": ["see the license for the specific language governing permissions and limitations under the license"],
    "Gpl3": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "Gpl2": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "Gpl3Later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "Gpl2Later": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "GplNoWarranty": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GplSee": ["see the gnu general public license for more details"],
    "GplCopy": ["you should have received a copy of the gnu general public license along with this program"],
    "Mit": ["released under the mit license", "licensed under the mit license", "this work is licensed under the mit license"],
    "MitPermission": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AsIs": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "MitNoLiability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "BsdPermission": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "BsdNames": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CcByNc4": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "CcBy4": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "CcBySa4": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"],
    "AllRights": ["all rights reserved"],
}
# Rules in the order in which they take their sentences, longest first.
RULES = [
    ("Apache-2.0", ["Apache2", "Apache2Only", "Apache2Copy", "Apache2AsIs", "Apache2See"]),
    ("MIT", ["MitPermission", "MitNotice", "AsIs", "MitNoLiability"]),
    ("BSD-3-Clause", ["BsdPermission", "BsdSource", "BsdBinary", "BsdNames"]),
    ("BSD-2-Clause", ["BsdPermission", "BsdSource", "BsdBinary"]),
    ("GPL-3.0-or-later", ["Gpl3Later", "GplNoWarranty", "GplSee", "GplCopy"]),
    ("GPL-2.0-or-later", ["Gpl2Later", "GplNoWarranty", "GplSee", "GplCopy"]),
    ("GPL-3.0-or-later", ["Gpl3Later"]),
    ("GPL-2.0-or-later", ["Gpl2Later"]),
    ("Apache-2.0", ["Apache2"]),
    ("GPL-3.0-only", ["Gpl3"]),
    ("GPL-2.0-only", ["Gpl2"]),
    ("MIT", ["Mit"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("all-rights-reserved", ["AllRights"]),
]
#: Sentences begin and end at line ends, and after . ! ? or ; before white space; inside one, either is white space.
ENDS = r"[.!?;][\x20\x09-\x0D]+|[\x0A-\x0D]+"
#: Every known sentence holds one of these.
HINTS = "licen|right|warrant|software|redistribut|apache|copy|neither|gnu|unless"


def _known() -> list[tuple[str, str]]:
    return [(s, i) for i, found in SENTENCES.items() for s in found]


def scan(docs: DataFrame, text_col: str = "text", licences: str = "licences", sentences: str = "n_sentences", rest: str = "unmatched") -> DataFrame:
    """The columns of ``docs`` but its text, with the licences found (in rule order, once each, joined by a space),
    the number of licence sentences recognised, and the identifiers no rule took.

    Null and empty texts have none. Repeated rows give equal results. Other
    columns pass through; a new name that one of them has gets underscores
    before it. No rows: no rows.
    """
    others = docs.drop(text_col)
    licences, sentences, rest = (free_name(others, c) for c in (licences, sentences, rest))
    own = [free_name(others, c) for c in ("ids", "n_found", *(f"left_{k}" for k in range(len(RULES) + 1)))]
    found_ids, found_n, left = own[0], own[1], own[2:]
    known = F.create_map(*(F.lit(x) for pair in _known() for x in pair))
    keys = [c for c in docs.columns if c != text_col]
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # Words one space apart, but a bar where a sentence may begin or end: a wrapped or commented sentence has bars inside.
    marked = F.regexp_replace(F.translate(text, "|", " "), ENDS, "|")
    words = F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9|]+", " "), r" *\|[ |]*", "|")
    every = sorted((s for s, _ in _known()), key=lambda s: (-len(s), s))
    pattern = r"(?<=\|)(?:" + "|".join(s.replace(" ", "[ |]") for s in every) + r")(?=\|)"
    near = F.when(F.rlike(text, F.lit(HINTS)), F.regexp_extract_all(F.concat(F.lit("|"), F.trim(words), F.lit("|")), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    ids = docs.select(*keys, F.transform(near, lambda s: F.element_at(known, F.translate(s, "|", " "))).alias(found_ids))
    out = ids.select(*keys, F.size(found_ids).cast("bigint").alias(found_n), F.concat(F.lit(""), F.array_join(F.transform(found_ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")).alias(left[0]))
    hits = []
    for k, (name, rule) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in rule)
        out = out.withColumn(left[k + 1], F.replace(F.col(left[k]), F.lit(pattern), F.lit("|")))
        hits.append(F.when(F.contains(F.col(left[k]), F.lit(pattern)), F.lit(name)))
    found = F.array_join(F.array_distinct(F.array(*hits)), " ")
    return out.select(*keys, found.alias(licences), F.col(found_n).alias(sentences), F.replace(F.col(left[-1]), F.lit("|"), F.lit("")).alias(rest))


def oracle() -> str:
    """The same in DuckDB: sentences as rows, rules as nested replacements."""
    table = ", ".join(f"('{s}', '{i}')" for s, i in _known())
    steps, last = [], "r0"
    for k, (_, rule) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in rule)
        steps.append(f"s{k + 1} AS (SELECT *, replace(r{k}, '{pattern}', '|') AS r{k + 1} FROM s{k})")
        last = f"r{k + 1}"
    names = list(dict.fromkeys(n for n, _ in RULES))
    hit = {n: " OR ".join(f"contains(r{k}, '{''.join(f'<{i}>' for i in rule)}')" for k, (m, rule) in enumerate(RULES) if m == n) for n in names}
    found = ", ".join(f"CASE WHEN {hit[n]} THEN '{n}' END" for n in names)
    return f"""
WITH known(s, id) AS (VALUES {table}),
line AS (SELECT doc_id, i, line FROM (SELECT doc_id, string_split_regex(lower(text), '[\\x0A-\\x0D]+') AS l FROM documents), unnest(l) WITH ORDINALITY AS u(line, i)),
part AS (SELECT doc_id, i, j, p FROM (SELECT doc_id, i, string_split(regexp_replace(line, '([.!?;])[\\x20\\x09-\\x0D]+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM line), unnest(l) WITH ORDINALITY AS u(p, j)),
hit AS (SELECT doc_id, i, j, id FROM part JOIN known ON known.s = trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g'))),
seq AS (SELECT doc_id, count(*) AS n, string_agg('<' || id || '>', '' ORDER BY i, j) AS r FROM hit GROUP BY doc_id),
s0 AS (SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(r, '') AS r0 FROM documents d LEFT JOIN seq ON seq.doc_id = d.doc_id),
{", ".join(steps)}
SELECT doc_id, array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ' ') AS licences, n_sentences, replace({last}, '|', '') AS unmatched FROM s{len(RULES)}
"""
