"""Licence scans by sentence rules, with DataFrame functions only.

A text becomes the sequence of its sentences, a sentence that is known becomes its identifier, and licence rules are ordered
sequences of identifiers. Up to GAP unknown sentences may stand between two of a rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unknown sentences that a rule lets pass between two of its own.
GAP = 2

# Licence rules, each the ordered sentences of a notice.
RULES: dict[str, list[tuple[str, ...]]] = {
    "MIT": [
        ("Released under the MIT License.",),
        ("Licensed under the MIT License.",),
        ("This project is licensed under the MIT License.",),
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ),
    ],
    "Apache-2.0": [
        ("Licensed under the Apache License, Version 2.0.",),
        ("Released under the Apache License, Version 2.0.",),
        (
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ),
    ],
    "BSD-2-Clause": [
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ),
        ("Released under the BSD 2-Clause License.",),
    ],
    "BSD-3-Clause": [
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ),
        ("Released under the BSD 3-Clause License.",),
    ],
    "ISC": [
        (
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ),
        ("Released under the ISC License.",),
    ],
    "GPL-2.0": [
        ("This work is licensed under the GNU General Public License, version 2.",),
        (
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ),
    ],
    "GPL-3.0": [
        ("This work is licensed under the GNU General Public License, version 3.",),
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ),
    ],
    "LGPL-3.0": [
        ("This work is licensed under the GNU Lesser General Public License, version 3.",),
        (
            "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ),
    ],
    "MPL-2.0": [
        (
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ),
    ],
    "Unlicense": [("This is free and unencumbered software released into the public domain.",)],
    "CC0-1.0": [("To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain.",)],
    "CC-BY-4.0": [
        ("Licensed under CC BY 4.0.",),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    ],
    "CC-BY-SA-4.0": [
        ("Licensed under CC BY-SA 4.0.",),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    ],
    "CC-BY-NC-4.0": [
        ("Licensed under CC BY-NC 4.0.",),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    ],
    "CC-BY-ND-4.0": [
        ("Licensed under CC BY-ND 4.0.",),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",),
    ],
    "CC-BY-NC-SA-4.0": [
        ("Licensed under CC BY-NC-SA 4.0.",),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",),
    ],
    "CC-BY-NC-ND-4.0": [
        ("Licensed under CC BY-NC-ND 4.0.",),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",),
    ],
    "AGPL-3.0": [
        (
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ),
    ],
    "LGPL-2.1": [
        (
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ),
    ],
    "EPL-2.0": [
        (
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        ),
    ],
    "CDDL-1.0": [
        ("The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").", "You may not use this file except in compliance with the License."),
    ],
    "BSL-1.0": [("Distributed under the Boost Software License, Version 1.0.",)],
    "Zlib": [
        (
            "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        ),
    ],
    "0BSD": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",)],
    "MIT-0": [
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        ),
    ],
    "PostgreSQL": [
        (
            "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
        ),
    ],
    "WTFPL": [("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",)],
}
#: Every known sentence holds one of these, which a test proves; texts without them have no known sentence.
ANCHOR = "(?i)licen[sc]e|copyright|redistribut|permission|public domain|endorse|mozilla"


#: Blank lines, and single line ends. No group is repeated and a run of blanks is entered at its start only, so both are linear
#: and need no stack, whatever the text.
BLANKS = r"(?<![ \t\r])[ \t\r]*\n[ \t\r\n]*\n"
BREAK = r"(?<![ \t\r])[ \t\r]*\n[ \t\r]*"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def sentences_of(rule: tuple[str, ...]) -> list[str]:
    """Normalised sentences of a rule, cut as texts are. What is left of a few words after a cut, such as a version, is none."""
    return [n for s in rule for part in re.sub(r"([.!?])[ \t\r]+", r"\1\n", s).split("\n") if len((n := normal(part)).split()) > 3]


KNOWN: dict[str, int] = {}
SEQUENCES: list[tuple[str, tuple[int, ...]]] = []
for _name, _notices in RULES.items():
    for _notice in _notices:
        _ids = tuple(KNOWN.setdefault(s, len(KNOWN) + 1) for s in sentences_of(_notice))
        SEQUENCES.append((_name, _ids))


def pattern(ids: tuple[int, ...]) -> str:
    """Of an identifier sequence written as ,3,0,4, with 0 for unknown sentences."""
    return "," + f",(0,){{0,{GAP}}}".join(map(str, ids)) + ","


def identifiers(text: Column) -> Column:
    """The sequence ,id,id, of a text whose sentences end at line ends or at . ! ? before a space."""
    cut = F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n")
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    norm = F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))), lambda s: s != "")
    ids = F.transform(norm, lambda s: F.coalesce(F.try_element_at(known, s), F.lit(0)).cast("string"))
    return F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_known (known sentences, read line by line), and licenses (names of the rules met, sorted,
    comma-joined).

    A text is read twice: line by line, and with single line ends as spaces, for notices that are wrapped. A rule that either
    reading meets counts; a rule whose sentences another met rule begins with counts too. Null text is the empty text. Null
    ids and repeated rows keep a row each. Whole texts are read. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    held = F.rlike("text", F.lit(ANCHOR))
    folded = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", BLANKS, "\x01"), BREAK, " "), "\x01", "\n")
    rows = rows.select("doc_id", F.when(held, identifiers(F.col("text"))).alias("lines"), F.when(held, identifiers(folded)).alias("folded"))
    rows = rows.select("doc_id", F.coalesce("lines", F.lit("")).alias("lines"), F.concat_ws("|", "lines", "folded").alias("both"))
    met = F.array(*[F.when(F.rlike("both", F.lit(pattern(ids))), F.lit(name)) for name, ids in SEQUENCES])
    return rows.select(
        "doc_id",
        F.regexp_count("lines", F.lit("[1-9][0-9]*")).cast("long").alias("n_known"),
        F.when(F.rlike("both", F.lit("[1-9]")), F.array_join(F.sort_array(F.array_distinct(F.array_compact(met))), ",")).otherwise(F.lit("")).alias("licenses"),
    )


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)


def oracle() -> str:
    """The same in SQL, by joins: sentences as rows, identifiers and rules as tables."""
    known = ", ".join(f"('{s}', {k})" for s, k in KNOWN.items())
    rules = ", ".join(f"('{name}', '{pattern(ids)}')" for name, ids in SEQUENCES)
    return rf"""
with known(s, k) as (values {known}), rules(name, p) as (values {rules}),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
readings as (
  select r, 0 as kind, text as t from d
  union all
  select r, 1, replace(regexp_replace(regexp_replace(text, '[ \t\r]*\n([ \t\r]*\n)+', chr(1), 'g'), '[ \t\r]*\n[ \t\r]*', ' ', 'g'), chr(1), chr(10)) from d
),
cut as (select r, kind, string_split(regexp_replace(t, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) as parts from readings),
lines as (select r, kind, unnest(parts) as s, unnest(range(len(parts))) as pos from cut),
norm as (select r, kind, pos, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) as s from lines),
ids as (select n.r, n.kind, n.pos, coalesce(known.k, 0) as k from norm n left join known on known.s = n.s where n.s <> ''),
seqs as (select r, kind, ',' || string_agg(cast(k as varchar), ',' order by pos) || ',' as q, count(*) filter (k > 0) as n from ids group by r, kind having max(k) > 0),
met as (select distinct r, name from seqs, rules where regexp_matches(q, p)),
named as (select r, string_agg(name, ',' order by name) as licenses from met group by r)
select d.doc_id, coalesce((select n from seqs where seqs.r = d.r and kind = 0), 0) as n_known, coalesce(named.licenses, '') as licenses
from d left join named on named.r = d.r
"""
