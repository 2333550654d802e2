"""License scan by sentence rules.  DataFrame functions only.

A text is cut into sentences (at full stops, question and exclamation marks before white space and at
blank lines; a line end, and a semicolon or colon before white space, may end a sentence or stand inside
one), and normalised: lower case, everything but letters and digits, so comment marks too, as one
space.  Known license sentences map to sentence identifiers; all others have none and are passed
over.  A document thus becomes a sequence of identifiers, and a rule is such a sequence: it matches
where its identifiers come one after the other, in its order, with no other known sentence between
them.  A rule may end or begin inside a longer run of identifiers.

The sentence table is a fixed literal of this module or given by the caller; it is looked up as a
literal map inside the scan, so the operator has no shuffle at all.

Defined results: null and empty texts have no sentences and match nothing; repeated rows match
alike; a sentence counts each time it stands there, a rule once per document, with its number of
matches; rules are reported in name order; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Well-known sentences of license notices and texts, by identifier.
SENTENCES: dict[str, str] = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-the-license": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
                  "portions of the Software.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                          "provided that the following conditions are met:",
    "rights-reserved": "All rights reserved.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                      "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
                      "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
                      "conditions:",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                      "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                 "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                 "option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
                   "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
                   "(at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                  "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                  "your option) any later version.",
    # The full stop of "v. 2.0" ends the sentence.
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: Rules: license, then the identifiers of its sentences in order.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0 header", ("apache-notice-the-license", "apache-compliance", "apache-copy", "apache-url")),
    ("MIT", ("mit-released",)),
    ("MIT licensed", ("mit-licensed",)),
    ("MIT text", ("mit-title", "mit-notice")),
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0-or-later notice", ("gpl-free", "gpl-hope", "gpl-see")),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("BSD", ("bsd-redistribution",)),
    ("BSD with rights reserved", ("rights-reserved", "bsd-redistribution")),
    ("MIT full text", ("mit-permission", "mit-notice")),
    ("ISC", ("isc-permission",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("MPL-2.0", ("mpl-form", "mpl2-copy")),
)
# Marks in a normalised text: an end of a sentence or paragraph, and a border that a sentence may run over.
HARD, SOFT = "\ue001", "\ue002"
# In order: what becomes a mark or a space.  Comment marks at line borders are neither letters nor digits.
MARKS = (
    (f"[{HARD}{SOFT}]", " "), (r"\r\n?", "\n"),
    (r"\n(?:[^\p{L}\p{N}\n]*+\n)++", HARD),
    (r"[.!?](?=[ \t\n])", HARD), (r"\n|[;:](?=[ \t])", SOFT),
    (rf"[^\p{{L}}\p{{N}}{HARD}{SOFT}]+", " "),
    (f" ?{HARD}[ {HARD}{SOFT}]*+", HARD), (f" ?{SOFT}[ {SOFT}]*+", SOFT), (f"{SOFT}{HARD}", HARD))


def normalised_text(sentence: str) -> str:
    """``normalised`` for the literals of the table: ASCII letters and digits only."""
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(kept.split())


def marked(text: Column) -> Column:
    """``text`` in lower case with single spaces, and its marks."""
    out = F.lower(text)
    for pattern, mark in MARKS:
        out = F.regexp_replace(out, pattern, mark)
    return F.trim(out)


def sentence_ids(text: Column, sentences: Mapping[str, str]) -> Column:
    """The identifiers of the known sentences of ``text``, in order."""
    known: dict[str, str] = {}
    for name, s in sentences.items():
        if known.setdefault(normalised_text(s), name) != name:
            raise ValueError(f"{name} and {known[normalised_text(s)]} are the same sentence")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # Longer sentences first; between words may stand a line end, around a sentence must stand marks.
    within = "|".join(s.replace(" ", f"[ {SOFT}]") for s in sorted(known, key=len, reverse=True))
    pattern = f"(?<![^{HARD}{SOFT}])(?:{within})(?![^{HARD}{SOFT}])"
    # Texts without the longest word of any sentence are not normalised.
    least = "|".join(sorted({max(s.split(), key=len) for s in known}))
    found = F.regexp_extract_all(marked(text), F.lit(pattern), F.lit(0))
    ids = F.transform(found, lambda s: F.element_at(table, F.translate(s, SOFT, " ")))
    return F.when(F.lower(text).rlike(least), ids).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: Mapping[str, str] = SENTENCES,
                  rules: Sequence[tuple[str, Sequence[str]]] = RULES) -> DataFrame:
    """(id, licenses, matches, sentence_ids) of every row: the matched rules and the times each matched.

    Identifiers must not hold ``|``."""
    ids = F.concat_ws("||", F.col("sentence_ids"))
    line = F.concat(F.lit("|"), ids, F.lit("|"))
    counts = []
    for name, sequence in sorted(rules):
        pattern = "|" + "||".join(sequence) + "|"
        n = ((F.length("line") - F.length(F.replace(F.col("line"), F.lit(pattern)))) / len(pattern)).cast("int")
        counts.append(F.struct(F.lit(name).alias("license"), n.alias("n")))
    scanned = (docs.select(F.col(id_col), sentence_ids(F.coalesce(F.col(text_col).cast("string"), F.lit("")), sentences).alias("sentence_ids"))
               .withColumn("line", line))
    hits = F.when(F.size("sentence_ids") > 0, F.filter(F.array(*counts), lambda c: c["n"] > 0)).otherwise(
        F.filter(F.array(*counts), lambda c: F.lit(False)))
    return (scanned.withColumn("hits", hits)
            .select(id_col, F.transform("hits", lambda h: h["license"]).alias("licenses"),
                    F.transform("hits", lambda h: h["n"]).alias("matches"), "sentence_ids"))
