"""Licence scans by sentence rules, with DataFrame functions only.

A text is cut into sentences at line ends and at a full stop before a blank. Sentences are normalised (lower case,
other characters than letters, digits and inner stops to one blank) and looked up among known licence sentences; the
sequence of identifiers found, in the order of the text, is matched against rules, each an ordered run of
identifiers. A sentence may also go over the lines of a paragraph: from each piece that begins as a known sentence does,
the longest known one that ends at the end of a piece is taken, comment marks being no letters; the pieces within it are
not looked up again. A blank line, or one of comment marks alone, ends a paragraph. All of it is one projection: no shuffle, no Python, nothing that grows with the corpus is broadcast.

Defined results: a null or empty text has no sentences and no licence; a sentence that repeats is in the sequence as
often; unknown sentences between known ones don't part a run; a rule that holds is named once, in order of the rules, and
not for a run that is the beginning of another licence's longer run. n_sentences counts pieces: lines, cut at full stops.
Other columns pass through; a clash with an output name raises ValueError.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences in normalised form, by identifier.
SENTENCES = {
    "mit-release": "released under the mit license",
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liable": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-2-short": "licensed under the apache license version 2.0",
    "apache-2-long": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-2-copy": "you may obtain a copy of the license at",
    "apache-2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "cc-by-nc-4": "licensed under cc by nc 4.0",
    "cc-by-4": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc-by-sa-4": "this work is licensed under a creative commons attribution sharealike 4.0 international license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "rights": "all rights reserved",
    "gpl-2-work": "this work is licensed under the gnu general public license version 2",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-2-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "gpl-3-only": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation",
    "lgpl-2.1-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    "lgpl-3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "cc0-title": "cc0 1.0 universal",
    "cc0-work": "this work is dedicated to the public domain under cc0 1.0",
    "cc0-extent": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl-title": "boost software license version 1.0",
    "bsl-under": "distributed under the boost software license version 1.0",
    "epl-2-title": "eclipse public license v 2.0",
    "artistic-2-title": "the artistic license 2.0",
    "cc-by-3": "this work is licensed under a creative commons attribution 3.0 unported license",
    "cc-by-2": "this work is licensed under a creative commons attribution 2.0 generic license",
}
# Sentences with a slot of one to SLOT words between two ends, by identifier.
TEMPLATES = {
    "bsd-names": ("neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd-name": ("the name of", "may not be used to endorse or promote products derived from this software without specific prior written permission"),
    "epl-2-under": ("this program and the accompanying materials are made available under the terms of the eclipse public license", "2.0 which is available at"),
}
SLOT = 12
# Rules as (licence, identifiers in order); the longer form of a licence stands before the shorter.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "as-is", "mit-liable"]),
    ("MIT", ["mit-title-the", "mit-grant", "mit-notice", "as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-release"]),
    ("Apache-2.0", ["apache-2-long", "apache-2-copy", "apache-2-basis", "apache-2-see"]),
    ("Apache-2.0", ["apache-2-long", "apache-2-copy"]),
    ("Apache-2.0", ["apache-2-short"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-3.0-only", ["gpl-3-work"]),
    ("GPL-3.0-only", ["gpl-3-only"]),
    ("GPL-2.0-or-later", ["gpl-2-free"]),
    ("GPL-2.0-only", ["gpl-2-only"]),
    ("GPL-2.0-only", ["gpl-2-work"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-free"]),
    ("LGPL-3.0-or-later", ["lgpl-3-free"]),
    ("AGPL-3.0-or-later", ["agpl-3-free"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-work"]),
    ("CC0-1.0", ["cc0-extent"]),
    ("CC-BY-3.0", ["cc-by-3"]),
    ("CC-BY-2.0", ["cc-by-2"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl-title"]),
    ("BSL-1.0", ["bsl-under"]),
    ("EPL-2.0", ["epl-2-title"]),
    ("EPL-2.0", ["epl-2-under"]),
    ("Artistic-2.0", ["artistic-2-title"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("MPL-2.0", ["mpl-2"]),
    ("Unlicense", ["unlicense"]),
    ("all-rights-reserved", ["rights"]),
]
# Each known sentence holds one of these, so that others need not be normalised.
ANCHORS = ["licen", "permission", "copyright", "warrant", "liable", "redistribut", "unencumbered", "rights", "cc0"]

NAMES = ("n_sentences", "sentence_ids", "licenses")


def sentences(text: Column) -> Column:
    """Not empty sentences in order."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(". "), F.lit(".\n")), "\n")
    return F.filter(lines, lambda s: s != "")


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " "), F.lit(" ."))


def pieces(text: Column) -> Column:
    """Sentences as above, with the empty lines between them."""
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(". "), F.lit(".\n")), "\n")


Templates = dict[str, tuple[str, str]]


def with_slot(template: tuple[str, str]) -> str:
    """Pattern of a normalised sentence with words in the slot, over blanks."""
    first, last = (re.escape(x).replace("\\ ", " ") for x in template)
    return f"{first} (?:[^ ]+ ){{1,{SLOT}}}?{last}"


def begins(known: dict[str, str], templates: Templates) -> str:
    """Pattern of a piece that begins as a known sentence does: by its first two words, or the first alone if that is all."""
    gap, starts = "[^a-z0-9]+", set()
    for sentence in [*known.values(), *(first for first, _ in templates.values())]:
        first, *more = sentence.split(" ")
        starts |= {re.escape(first) + "[^a-z0-9]*$"} | {re.escape(first) + gap + re.escape(w) + "([^a-z0-9]|$)" for w in more[:1]}
    return f"^[^a-z0-9]*({'|'.join(sorted(starts))})"


def found_ids(text: Column, known: dict[str, str], templates: Templates) -> Column:
    """Identifiers of the known sentences in order, those over several pieces included."""
    most = max([*(len(s.split(" ")) for s in known.values()), *(len(" ".join(t).split(" ")) + SLOT for t in templates.values())])  # a piece of a sentence has a word at least
    longest = sorted(known.items(), key=lambda x: (-len(x[1]), x[0]))

    def at(all_: Column, i: Column) -> Column:
        """(name, first piece, first piece after it) of the longest known sentence that begins with piece i."""
        ahead = F.array_join(F.transform(F.slice(all_, i, most), normalised), "\n")

        def longest_of(lines: Column) -> Column:
            flat, out = F.translate(lines, "\n", " "), None
            for name, sentence in longest:
                size = len(sentence)
                over = F.size(F.split(F.substring(lines, 1, size), "\n"))
                ends = F.substring(lines, size + 1, 1).isin("", "\n")
                value = F.struct(F.lit(name).alias("name"), i.alias("at"), (i + over).alias("to"))
                out = F.when(F.startswith(flat, F.lit(sentence)) & ends, value) if out is None else out.when(F.startswith(flat, F.lit(sentence)) & ends, value)
            for name, template in sorted(templates.items()):
                size = F.length(F.regexp_extract(flat, f"^{with_slot(template)}(?= |$)", 0))
                over = F.size(F.split(F.substring(lines, F.lit(1), size), "\n"))
                met = F.startswith(flat, F.lit(template[0])) & (size > 0) & F.substring(lines, size + 1, F.lit(1)).isin("", "\n")
                value = F.struct(F.lit(name).alias("name"), i.alias("at"), (i + over).alias("to"))
                out = F.when(met, value) if out is None else out.when(met, value)
            return out

        return F.element_at(F.transform(F.array(ahead), longest_of), 1)

    def of(all_: Column) -> Column:
        starts = F.filter(F.transform(all_, lambda s, i: F.when(F.lower(s).rlike(begins(known, templates)), i + 1)), lambda i: i.isNotNull())
        met = F.filter(F.transform(starts, lambda i: at(all_, i)), lambda m: m.isNotNull())
        none = F.struct(F.lit(1).alias("to"), F.array().cast("array<string>").alias("names"))
        step = lambda a, m: F.when(m["at"] >= a["to"], F.struct(m["to"].alias("to"), F.concat(a["names"], F.array(m["name"])).alias("names"))).otherwise(a)
        return F.aggregate(met, none, step, lambda a: a["names"])

    return F.element_at(F.transform(F.array(pieces(text)), of), 1)


def scan(df: DataFrame, text: str = "text", known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, templates: Templates | None = None) -> DataFrame:
    """df with n_sentences, sentence_ids (by blanks) and licenses (by commas)."""
    templates = templates if templates is not None else TEMPLATES if known is None else {}
    known, rules = known or SENTENCES, rules or RULES
    taken = {c.lower() for c in df.columns}
    if clash := [c for c in NAMES if c in taken]:
        raise ValueError(f"the input already has columns {clash}")
    ids = F.array().cast("array<string>")
    maybe = "|".join(ANCHORS) if known is SENTENCES else "."
    ids = F.when(F.lower(F.col(text)).rlike(maybe), found_ids(F.col(text), known, templates)).otherwise(ids)
    out = df.withColumn("n_sentences", F.size(sentences(F.col(text))).cast("long")).withColumn("sentence_ids", F.array_join(ids, " "))
    run = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    held = []
    for name, sequence in rules:
        rest = run
        for other, longer in rules:
            if other != name and len(longer) > len(sequence) and longer[: len(sequence)] == sequence:
                rest = F.replace(rest, F.lit(f" {' '.join(longer)} "), F.lit(" - "))
        held.append(F.when(F.contains(rest, F.lit(f" {' '.join(sequence)} ")), name))
    return out.withColumn("licenses", F.array_join(F.array_distinct(F.filter(F.array(*held), lambda x: x.isNotNull())), ","))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of op3 over the view documents."""
    values = ", ".join(f"('{sentence}', '{name}')" for name, sentence in SENTENCES.items())
    order = list(dict.fromkeys(name for name, _ in RULES))
    slots = " UNION ALL ".join(f"SELECT doc_id, place, '{name}' FROM plain WHERE regexp_full_match(sentence, '{with_slot(t)}')" for name, t in TEMPLATES.items())
    shorter = "' ' || replace(run, 'bsd-redistribution bsd-source bsd-binary bsd-name', '-') || ' '"
    held = ", ".join(f"CASE WHEN {' OR '.join(f'contains({shorter if n == 'BSD-2-Clause' else 'run'}, $${chr(32)}{chr(32).join(sequence)}{chr(32)}$$)' for n, sequence in RULES if n == name)} THEN '{name}' END" for name in order)
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
lines AS (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), '. ', '.' || chr(10)), chr(10)), lambda s: s <> '') AS l FROM documents),
flat AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS place FROM lines),
plain AS (SELECT doc_id, place, trim(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), ' .') AS sentence FROM flat),
named AS (SELECT doc_id, place, id FROM plain JOIN known USING (sentence) UNION ALL {slots}),
met AS (SELECT doc_id, string_agg(id, ' ' ORDER BY place) AS ids FROM named GROUP BY doc_id),
runs AS (SELECT doc_id, len(l)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, ' ' || coalesce(ids, '') || ' ' AS run FROM lines LEFT JOIN met USING (doc_id))
SELECT doc_id, n_sentences, sentence_ids, concat_ws(',', {held}) AS licenses FROM runs"""
