"""Licence scan by sentences, in column expressions alone.

Each sentence of a text is normalised and looked up among known licence
sentences. Sentences may go over several lines, with signs of comments in front;
where one is not known as a whole, its lines are looked up, and its end, since a
heading may stand above it. The identifiers found, in order, are then matched
against rules: sequences of identifiers, longest first. Identifiers that a rule
has used are not used again.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from reachgrid.llm.texts import free

#: Licence sentences, normalised (A-Z lower-cased, runs of other ASCII
#: than letters and digits made one space), with their identifiers.
SENTENCES = {
    "mit-name": "released under the mit license",
    "mit-name-2": "licensed under the mit license",
    "mit-head": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-name": "licensed under the apache license version 2 0",
    "apache-head": "licensed under the apache license version 2 0 the license",
    "apache-file": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-name": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "ccbync4-name": "licensed under cc by nc 4 0",
    "ccby4-name": "licensed under cc by 4 0",
    "ccbysa4-name": "licensed under cc by sa 4 0",
    "cc0-name": "released under cc0 1 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "reserved": "all rights reserved",
    "bsd-neither": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-2": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl1-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "apache-head-file": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "ofl-font": "this font software is licensed under the sil open font license version 1 1",
    "odbl-name": "this database is made available under the open database license",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "artistic2-free": "this program is free software you can redistribute it and or modify it under the terms of the artistic license 2 0",
}

#: Licences as sentences name them, normalised.
TITLES = {
    "MIT": "mit license",
    "Apache-2.0": "apache license version 2 0",
    "BSD-2-Clause": "bsd 2 clause license",
    "BSD-3-Clause": "bsd 3 clause license",
    "ISC": "isc license",
    "Zlib": "zlib license",
    "BSL-1.0": "boost software license version 1 0",
    "MPL-2.0": "mozilla public license version 2 0",
    "EPL-2.0": "eclipse public license version 2 0",
    "GPL-2.0": "gnu general public license version 2",
    "GPL-3.0": "gnu general public license version 3",
    "LGPL-2.1": "gnu lesser general public license version 2 1",
    "LGPL-3.0": "gnu lesser general public license version 3",
    "AGPL-3.0": "gnu affero general public license version 3",
    "Artistic-2.0": "artistic license 2 0",
    "Unlicense": "unlicense",
    "OFL-1.1": "sil open font license version 1 1",
    "ODbL-1.0": "open database license version 1 0",
}
#: How a sentence begins that names a licence.
BEGINNINGS = ["released under the", "licensed under the", "distributed under the", "this work is licensed under the", "this project is licensed under the"]
#: Elements of a CC licence by their codes.
CC = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
#: Further identifiers that a package file may name.
SPDX = ["0BSD", "CC0-1.0", "EPL-1.0", "PostgreSQL", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later"]


def _plain(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


def _named() -> dict[str, tuple[str, str]]:
    """{sentence: (identifier, licence)} of the sentences that only name a licence."""
    out = {f"{b} {title}": (f"name{i}:{licence}", licence) for licence, title in TITLES.items() for i, b in enumerate(BEGINNINGS)}
    for code, title in CC.items():
        licence = f"CC-{code.upper().replace(' ', '-')}-4.0"
        out[f"licensed under cc {code} 4 0"] = (f"cc:{licence}", licence)
        out[f"this work is licensed under a creative commons {title} 4 0 international license"] = (f"cc-long:{licence}", licence)
        out[f"spdx license identifier {_plain(licence)}"] = (f"spdx:{licence}", licence)
    for licence in [*TITLES, *SPDX]:
        short = licence.removesuffix("-only").removesuffix("-or-later")
        out[f"spdx license identifier {_plain(licence)}"] = (f"spdx:{licence}", short)
    return {s: v for s, v in out.items() if s not in SENTENCES.values()}


NAMED = _named()
SENTENCES |= {identifier: sentence for sentence, (identifier, _) in NAMED.items()}

#: Fixed values: (licence, identifiers in order), tried from the first to the last.
RULES = [
    ("MIT", ["mit-head", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-head", "apache-file", "apache-copy", "apache-basis"]),
    ("Apache-2.0", ["apache-head", "apache-file"]),
    ("Apache-2.0", ["apache-head-file", "apache-copy", "apache-basis"]),
    ("Apache-2.0", ["apache-head-file"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-neither", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-neither"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("LGPL-2.1", ["lgpl21-free"]),
    ("LGPL-3.0", ["lgpl3-free", "gpl-hope"]),
    ("LGPL-3.0", ["lgpl3-free"]),
    ("AGPL-3.0", ["agpl3-free", "gpl-hope"]),
    ("AGPL-3.0", ["agpl3-free"]),
    ("MPL-2.0", ["mpl-form", "mpl-copy"]),
    ("MPL-2.0", ["mpl-form", "mpl-copy-2"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-2"]),
    ("0BSD", ["0bsd-grant"]),
    ("EPL-1.0", ["epl1-terms"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("Unlicense", ["unlicense-free"]),
    ("OFL-1.1", ["ofl-font"]),
    ("ODbL-1.0", ["odbl-name"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("Artistic-2.0", ["artistic2-free"]),
    ("GPL-3.0", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0", ["gpl2-free", "gpl-hope"]),
    ("MIT", ["mit-name"]),
    ("MIT", ["mit-name-2"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["apache-name"]),
    ("Apache-2.0", ["apache-head"]),
    ("Apache-2.0", ["spdx-apache"]),
    ("GPL-3.0", ["gpl3-name"]),
    ("GPL-3.0", ["gpl-free"]),
    ("GPL-2.0", ["gpl2-free"]),
    ("GPL-3.0", ["spdx-gpl3"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("CC-BY-NC-4.0", ["ccbync4-name"]),
    ("CC-BY-SA-4.0", ["ccbysa4-name"]),
    ("CC-BY-4.0", ["ccby4-name"]),
    ("CC0-1.0", ["cc0-name"]),
    *[(licence, [identifier]) for identifier, licence in NAMED.values()],
    ("proprietary", ["reserved"]),
]
#: What a notice alone stands for; licences themselves have the same notice.
NOTICE = "proprietary"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Behind these a sentence is over: a full stop before a space, a stop at the end of a line, an empty line.
CUT = r"([.!?])[ \t\r\f]+|([.!?:;])[ \t\r\f]*\n|\n[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\n"
OVER = "\x1e"


def likely(known: dict[str, str]) -> str:
    """A pattern that every known sentence holds in any case, of few long words; no other sentence need be normalised."""
    left, chosen = sorted(set(known.values())), []
    while left:
        words = {w for s in left for w in s.split() if len(w) >= min(7, max(map(len, s.split())))}
        chosen.append(max(sorted(words), key=lambda w: (sum(w in s for s in left), len(w))))
        left = [s for s in left if chosen[-1] not in s]
    return "(?i)" + "|".join(chosen)


def sentences(text: Column) -> Column:
    """Sentences of a text, over as many lines as they go."""
    return F.split(F.regexp_replace(text, CUT, "$1$2" + OVER), OVER)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def identifiers(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    names = F.create_map(*[F.lit(x) for x in chain(*((v, k) for k, v in known.items()))])
    endings = F.array(*[F.struct(F.lit(f" {v}").alias("end"), F.lit(k).alias("id")) for k, v in by_length(known)])
    pattern = likely(known)

    def found(sentence: Column) -> Column:
        own = normalised(sentence)
        lines = F.filter(F.transform(F.split(sentence, "\n"), lambda x: F.when(x.rlike(pattern), names[normalised(x)])), lambda x: x.isNotNull())
        last = F.transform(F.slice(F.filter(endings, lambda e: F.endswith(F.concat(F.lit(" "), own), e["end"])), 1, 1), lambda e: e["id"])
        # Its last line may be what it ends with.
        parts = F.concat(F.when((F.size(lines) > 0) & (F.size(last) > 0) & (F.element_at(lines, -1) == F.element_at(last, 1)), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines), last)
        whole = F.array(names[own])
        return F.when(names[own].isNotNull(), whole).when(F.contains(sentence, F.lit("\n")), parts).otherwise(F.array().cast("array<string>"))

    some = F.filter(sentences(text), lambda s: s.rlike(pattern))
    return F.flatten(F.transform(some, found))


def by_length(known: dict[str, str]) -> list[tuple[str, str]]:
    """(identifier, sentence), the longest sentence first."""
    return sorted(known.items(), key=lambda x: (-len(x[1]), x[1]))


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """*docs* with sentence_ids (identifiers in order) and licences (one name for each rule that matched, by rule).

    A rule matches where its identifiers stand next to each other among the
    recognised sentences; text between them that is not recognised does not
    matter. Every occurrence is used up by the first rule that matches it. A
    notice of rights (``proprietary``) counts only where no licence is found. A
    null or empty text has neither. Rows are never joined or grouped, so
    repeated rows and null ids are of no matter. Columns of these names are
    replaced.
    """
    steps = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(spelt(q)).alias("ids")) for n, q in rules])

    def used(acc: Column, rule: Column) -> Column:
        names = F.when(F.contains(acc["left"], rule["ids"]), F.array_append(acc["names"], rule["name"])).otherwise(acc["names"])
        return F.struct(F.replace(acc["left"], rule["ids"], F.lit("|")).alias("left"), names.alias("names"))

    def matched(ids: Column) -> Column:
        start = F.struct(F.concat_ws("", F.transform(ids, lambda i: F.concat(F.lit(";"), i, F.lit(";")))).alias("left"), F.array().cast("array<string>").alias("names"))
        names = F.aggregate(steps, start, used, lambda acc: acc["names"])
        return F.struct(ids.alias("ids"), F.transform(F.array(names), licensed)[0].alias("licences"))

    def licensed(names: Column) -> Column:
        return F.when(F.exists(names, lambda n: n != NOTICE), F.array_remove(names, NOTICE)).otherwise(names)

    # The identifiers stand in an array of one, so that they are found once and used twice.
    both = F.transform(F.array(identifiers(F.coalesce("text", F.lit("")), known)), matched)[0]
    scan_name = free(docs, "_scan")
    others = [c for c in docs.columns if c not in ("sentence_ids", "licences")]
    found = docs.withColumn(scan_name, both)
    return found.select(*others, F.col(f"{scan_name}.ids").alias("sentence_ids"), F.col(f"{scan_name}.licences").alias("licences"))


def spelt(sequence: list[str]) -> str:
    """";a;;b;": identifiers as they stand in a row."""
    return "".join(f";{i};" for i in sequence)
