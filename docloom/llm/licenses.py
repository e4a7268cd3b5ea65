"""Licence scans by sentence rules, in native column functions only.

A text is cut into sentences, and sentences are reduced to lower-case letters and digits. Slots are taken out:
who grants, what is granted, years and holders, the articles and verbs before a licence's name. What is left is
looked up among the known sentences and becomes its identifier; a sentence with licence words that is not known
becomes UNKNOWN, any other a gap. Numbers of list items and copyright lines are passed over. The sequence of
identifiers, with unknown sentences and gaps in their places, is then held against ordered rules, longest first:
a rule matches where its identifiers follow one another with nothing between, and what it matched is used up.
Identifiers that are a licence on their own are looked up in what is left. The text is read twice: once by
lines, for notices that stand alone, and once with line breaks as spaces, for sentences that wrap.

Known sentences are the notices below, cut like any text, and statements ("under the X"), SPDX tags and names
made from tables of families, versions and variants; about 790. A first test for words of which every known
sentence holds one keeps the other texts from being cut, and keeps other sentences from being looked up; it
drops none that could match, as ``_anchored`` checks. Everything is a column expression of the row itself: no
shuffle, and hot keys do not matter.

Defined cases: a null or empty text has no sentences and no licences; repeated notices count each time in
n_sentences and once in licenses; equal rows give equal rows; extra columns are ignored by ``scan``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of notices, by name; {holder} marks a slot.
NOTICES = {
    "mit grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-0 grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "mit notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd name": "Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache use": "you may not use this file except in compliance with the License.",
    "apache copy": "You may obtain a copy of the License at",
    "apache copy at": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache see": "See the License for the specific language governing permissions and limitations under the License.",
    "isc grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc grant 2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "gnu hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl 2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl 2 copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl 1.1": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License");',
    "epl 2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "boost statement": "Distributed under the Boost Software License, Version 1.0.",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
}

# The GNU licences: name, wording, and versions; and what a notice calls the work.
GNU = {"GPL": ("GNU General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")), "AGPL": ("GNU Affero General Public License", ("1.0", "3.0"))}
GNU_WORKS = ("program", "library", "file", "software")

# Rules of several notices in order, longest first: a licence and the notices that must follow one another.
RULES = [
    ("BSD-4-Clause", ("bsd grant", "bsd source", "bsd binary", "bsd advertising")),
    ("BSD-3-Clause", ("bsd grant", "bsd source", "bsd binary", "bsd name")),
    ("Apache-2.0", ("apache grant", "apache use", "apache copy")),
    ("Apache-2.0", ("apache grant", "apache use", "apache copy at")),
    ("MIT", ("mit grant", "mit notice", "mit warranty")),
    ("BSD-2-Clause", ("bsd grant", "bsd source", "bsd binary")),
    ("MPL-2.0", ("mpl 2", "mpl 2 copy")),
    ("MIT", ("mit grant", "mit notice")),
    ("MIT-0", ("mit-0 grant", "mit warranty")),
    ("Zlib", ("zlib warranty", "zlib grant")),
]

# Notices that are a licence on their own.
ALONE = {"mit-0 grant": "MIT-0", "isc grant": "ISC", "isc grant 2": "ISC", "0bsd grant": "0BSD", "mpl 2": "MPL-2.0", "mpl 1.1": "MPL-1.1", "epl 2": "EPL-2.0", "zlib grant": "Zlib", "unlicense": "Unlicense", "boost grant": "BSL-1.0", "boost statement": "BSL-1.0", "ofl": "OFL-1.1", "cc0": "CC0-1.0", "reserved": "all-rights-reserved"}

# Names by which other licences are stated.
NAMES = {
    "MIT": ("MIT License", "MIT Licence", "MIT", "Expat License", "X11 License"),
    "ISC": ("ISC License", "ISC"),
    "Apache-1.1": ("Apache License, Version 1.1", "Apache License 1.1", "Apache Software License 1.1"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache License v2", "Apache 2.0 License", "Apache 2.0", "Apache-2 License", "Apache Software License 2.0", "Apache Software License, Version 2.0", "ASL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License", "Original BSD License"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPLv2"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0", "Eclipse Public License, Version 1.0", "EPL 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0", "EPL 2.0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0", "CDDL 1.0"),
    "EUPL-1.2": ("European Union Public License 1.2", "European Union Public Licence, Version 1.2", "EUPL 1.2"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License"),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "WTFPL": ("WTFPL", "Do What The Fuck You Want To Public License"),
    "PSF-2.0": ("Python Software Foundation License", "PSF License"),
    "OFL-1.1": ("SIL Open Font License 1.1", "Open Font License 1.1"),
    "ODbL-1.0": ("Open Database License", "Open Database License 1.0", "ODbL"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    "AFL-3.0": ("Academic Free License 3.0", "Academic Free License, Version 3.0"),
}

# Terms and versions of Creative Commons licences.
CC_TERMS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Every known sentence holds one of these, whole or as a part of a word.
ANCHORS = ["licen", "rights", "permi", "copyright", "warrant", "redistribut", "public", "under ", "advertising", "free software", "2 0"]
#: Words of a sentence that speaks of a licence.
LIKE = r"\b(licen[cs]e[ds]?|copyright|warrant(y|ies)|redistribut\w+|permission is)\b"

# Slots, on reduced sentences. The verb with what stands before it and the article after it; the holder; the tail after a licence's name.
_VERB = r"^(?:(?:this|the|all|our|these) (?:[a-z0-9]+ ){1,4}(?:is|are) |(?:is|are) )?(?:dual )?(?:licensed|released|distributed|(?:made )?available|published|provided) under (?:the terms of )?(?:the |a |an )?"
_HOLDER = r"^neither the name of .{1,120}? nor the names of its contributors"
_TAIL = r"^(under .{2,80}?(?:licen[cs]e|[0-9])(?: international| unported| generic)?(?: licen[cs]e)?) (?:by|c|copyright|see) .*$"
#: Sentences that stand between notices and mean nothing: numbers and letters of list items, copyright lines.
_PASSED = r"^(?:[0-9]{0,3}|[a-z]|copyright (?:c )?[0-9]{4}.*|c [0-9]{4}.*)$"
_CUT = r"[.!?;:]+[\x20\x09-\x0D]+"


def reduced(sentence: str) -> str:
    """What a sentence is looked up by: lower-case letters and digits, slots taken out."""
    s = re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()
    return re.sub(_TAIL, r"\1", re.sub(_HOLDER, "neither the name of holder nor the names of its contributors", re.sub(_VERB, "under ", s)))


def cut(text: str) -> list[str]:
    """A text's sentences as they are looked up, without those passed over."""
    spared = re.sub(r"(?i)spdx-license-identifier:[ \t]*", "SPDX-License-Identifier ", re.sub(r"(?i)\bv\. +(?=[0-9])", "v", text))
    return [s for x in re.split(_CUT, spared + " ") if not re.match(_PASSED, s := reduced(x))]


def gnu_notices() -> dict[str, tuple[str, str]]:
    """Licence and wording of the GNU notices, by name: each licence, version, work, and with or without later versions."""
    out = {}
    for short, (name, versions) in GNU.items():
        for v in versions:
            n = v.removesuffix(".0")
            for work in GNU_WORKS:
                head = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name}"
                later = f"{head} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
                out[f"{short} {v} later {work}"] = (f"{short}-{v}-or-later", later)
                out[f"{short} {v} later {work} 2"] = (f"{short}-{v}-or-later", later.replace("software: you", "software; you"))
                out[f"{short} {v} only {work}"] = (f"{short}-{v}-only", f"{head} version {n} as published by the Free Software Foundation.")
    return out


def statements() -> dict[str, str]:
    """Licence by reduced statement: "under X" for every name, and SPDX tags."""
    names: dict[str, list[str]] = {k: list(v) for k, v in NAMES.items()}
    for short, (name, versions) in GNU.items():
        for v in versions:
            n = v.removesuffix(".0")
            for plain in (f"{name}, version {n}", f"{name} version {v}", f"{name} v{n}", f"{name} {v}", f"GNU {short} version {n}", f"GNU {short} v{n}", f"{short} {v}", f"{short} v{n}", f"{short}v{n}", f"{short} version {n}"):
                names.setdefault(f"{short}-{v}", []).append(plain)
                names.setdefault(f"{short}-{v}-only", []).append(plain + " only")
                names.setdefault(f"{short}-{v}-or-later", []).extend([plain + " or later", plain + " or any later version", plain + " or (at your option) any later version"])
    for code, words in CC_TERMS.items():
        for v in CC_VERSIONS:
            full = f"Creative Commons {words} {v}"
            names[f"CC-{code}-{v}"] = [f"CC {code} {v}", f"CC-{code}-{v} license", full, f"{full} License", f"{full} International", f"{full} International License", f"{full} Unported License", f"{full} Generic License"]
    out = {reduced(f"licensed under the {x}"): k for k, some in names.items() for x in some}
    out |= {reduced(f"SPDX-License-Identifier {k}"): k for k in names}
    return out


class Rules:
    """Known sentences with their identifiers, rules of several identifiers, and licences of single ones."""

    def __init__(self) -> None:
        gnu = gnu_notices()
        parts = {name: cut(text.replace("{holder}", "the copyright holder")) for name, text in NOTICES.items()} | {name: cut(text) for name, (_, text) in gnu.items()}
        single = statements()
        self.known = {s: i for i, s in enumerate(dict.fromkeys([s for some in parts.values() for s in some] + list(single)))}
        ids = {name: tuple(self.known[s] for s in some) for name, some in parts.items()}
        several = [(licence, tuple(i for n in names for i in ids[n])) for licence, names in RULES]
        several += [(licence, ids[name]) for name, (licence, _) in gnu.items() if len(ids[name]) > 1]
        self.several = list(dict.fromkeys(several))
        self.alone = {self.known[s]: licence for s, licence in single.items()} | {ids[name][0]: licence for name, licence in ALONE.items()}


_CODE = "<{}>"
GAP, UNKNOWN = "-", "?"


def _anchored(known: dict[str, int], anchors: list[str]) -> None:
    if missing := [s for s in known if not any(a in s for a in anchors)]:
        raise ValueError(f"no anchor for {missing}")


def sentences_of(text: Column) -> Column:
    """As ``cut``, in columns: reduced sentences, passed-over ones included."""
    spared = F.regexp_replace(F.regexp_replace(text, r"(?i)\bv\. +(?=[0-9])", "v"), r"(?i)spdx-license-identifier:[ \t]*", "SPDX-License-Identifier ")
    pieces = F.split(F.concat(spared, F.lit(" ")), _CUT)

    def one(s: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " "))
        holder = F.regexp_replace(F.regexp_replace(plain, _VERB, "under "), _HOLDER, "neither the name of holder nor the names of its contributors")
        return F.regexp_replace(holder, _TAIL, "$1")

    return F.transform(pieces, one)


def sequence(sentences: Column, rules: Rules, anchors: list[str]) -> Column:
    """Identifiers as <i>, UNKNOWN for a licence-like sentence, GAP for runs of others; sentences passed over leave nothing."""
    table = F.create_map(*[F.lit(x) for s, i in rules.known.items() for x in (s, _CODE.format(i))])
    longest = max(map(len, rules.known))

    def one(s: Column) -> Column:
        maybe = s.rlike("|".join(anchors))
        found = F.when(maybe & (F.length(s) <= longest), F.try_element_at(table, s))
        other = F.when(s.rlike(_PASSED), "").when(maybe & s.rlike(LIKE), UNKNOWN).otherwise(GAP)
        return F.coalesce(found, other)

    return F.regexp_replace(F.array_join(F.transform(sentences, one), ""), "-{2,}", GAP)


def scan(docs: DataFrame, rules: Rules | None = None, anchors: list[str] = ANCHORS) -> DataFrame:
    """doc_id, n_sentences and n_unknown (known and licence-like ones, by lines or by flow, whichever knows more), licenses (sorted, joined by commas) and first_license (of the first rule that matched, else of the first single sentence; null if none)."""
    rules = rules or Rules()
    _anchored(rules.known, anchors)
    reach = [a if a != "2 0" else "2[^a-z0-9]+0" for a in anchors]
    maybe = F.when(F.col("text").rlike("(?i)" + "|".join(a.replace(" ", "[^a-z0-9]+") if a != "2[^a-z0-9]+0" else a for a in reach)), F.col("text"))
    by_line, by_flow = (sequence(sentences_of(t), rules, anchors) for t in (F.regexp_replace("maybe", r"[\n\r]+", ". "), F.col("maybe")))
    found = docs.select("doc_id", maybe.alias("maybe")).select("doc_id", F.coalesce(by_line, F.lit("")).alias("by_line"), F.coalesce(by_flow, F.lit("")).alias("by_flow"))
    count = lambda c, sign: (F.length(c) - F.length(F.replace(F.col(c), F.lit(sign), F.lit("")))).cast("long")
    flow = count("by_flow", "<") >= count("by_line", "<")
    unknown = F.when(flow, count("by_flow", UNKNOWN)).otherwise(count("by_line", UNKNOWN))
    state = found.select("doc_id", F.greatest(count("by_line", "<"), count("by_flow", "<")).alias("n_sentences"), unknown.alias("n_unknown"), F.concat("by_line", F.lit("|"), "by_flow").alias("rest"))
    hits = []
    # A pass for each dozen of rules, so that expressions stay shallow.
    for at in range(0, len(rules.several), 12):
        rest, names = F.col("rest"), []
        for licence, ids in rules.several[at : at + 12]:
            pattern = F.lit("".join(_CODE.format(i) for i in ids))
            names.append(F.when(F.contains(rest, pattern), F.lit(licence)))
            rest = F.replace(rest, pattern, F.lit("|"))
        hits.append(f"hits_{at}")
        some = F.col("rest").rlike("|".join({re.escape("".join(_CODE.format(i) for i in ids[:2])) for _, ids in rules.several[at : at + 12]}))
        state = state.select("*", F.when(some, F.array_compact(F.array(*names))).otherwise(F.array().cast("array<string>")).alias(hits[-1]), F.when(some, rest).otherwise(F.col("rest")).alias("next")).drop("rest").withColumnRenamed("next", "rest")
    names = F.array(*[F.lit(rules.alone.get(i)) for i in range(len(rules.known))])
    single = F.transform(F.regexp_extract_all("rest", F.lit("<([0-9]+)>"), 1), lambda i: F.get(names, i.cast("int")))
    every = state.select("doc_id", "n_sentences", "n_unknown", F.when(F.col("n_sentences") > 0, F.array_compact(F.concat(*hits, single))).otherwise(F.array().cast("array<string>")).alias("hits"))
    return every.select("doc_id", "n_sentences", "n_unknown", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("licenses"), F.get("hits", F.lit(0)).alias("first_license"))
