"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences and these are normalised; a normalised sentence that is
known becomes its identifier. The identifiers, in their order, are matched against
rules, each an ordered sequence of identifiers that must stand side by side.

A sentence ends at a full stop, semicolon, colon, or a line without letters or digits.
It may also begin and end with a line, since titles and notices often have no full stop,
and may run over line ends, since texts are wrapped. So all lines, and all stretches of
whole lines between hard ends, are sentences, and the known ones are found by a single
search for any of them.

Plan: a projection over the scan, without a shuffle or a join. Tables of sentences and
rules are short and part of the plan. Only texts that hold a word without which no
known sentence can be are searched at all. Patterns repeat single characters only, so
neither a very long text nor one of very many blank lines overflows the stack.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The public wording of licence notices, lower-cased, without punctuation,
# cut where SENTENCE_END cuts: what stands before and after a ';' or ':' are two.
SENTENCES = {
    "mit-title": "the mit license",
    "mit-release": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to"
        " permit persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mit-notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the software"
    ),
    "as-is-software": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to"
        " the warranties of merchantability fitness for a particular purpose and noninfringement"
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met"
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer"
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    "bsd-advert": (
        "all advertising materials mentioning features or use of this software must display the following"
        " acknowledgement"
    ),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission"
    ),
    "bsd-disclaimer": (
        "this software is provided by the copyright holders and contributors as is and any express or implied"
        " warranties including but not limited to the implied warranties of merchantability and fitness for a"
        " particular purpose are disclaimed"
    ),
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-compliance": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl-free-terms": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by"
        " the free software foundation either version 3 of the license or at your option any later version"
    ),
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-warranty-implied": (
        "without even the implied warranty of merchantability or fitness for a particular purpose"
    ),
    "gpl-terms": (
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by"
        " the free software foundation"
    ),
    "version-2-later": "either version 2 of the license or at your option any later version",
    "version-2-1-later": "either version 2 1 of the license or at your option any later version",
    "version-3-later": "either version 3 of the license or at your option any later version",
    "version-2-only": "version 2 of the license",
    "lgpl-free": "this library is free software",
    "lgpl-terms": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as"
        " published by the free software foundation"
    ),
    "lgpl3-terms": (
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as"
        " published by the free software foundation either version 3 of the license or at your option any later version"
    ),
    "agpl3-terms": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as"
        " published by the free software foundation either version 3 of the license or at your option any later version"
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "isc-disclaimer": (
        "the software is provided as is and the author disclaims all warranties with regard to this software including"
        " all implied warranties of merchantability and fitness"
    ),
    "0bsd-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted"
    ),
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v",
    "mpl2-copy": (
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"
    ),
    "unlicense-release": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form"
        " or as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
    "cc0-dedication": (
        "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights"
        " to this software to the public domain worldwide"
    ),
    "boost-notice": "distributed under the boost software license version 1 0",
    "boost-grant": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"
        " and accompanying documentation covered by this license the software to use reproduce display distribute"
        " execute and transmit the software and to prepare derivative works of the software and to permit third"
        " parties to whom the software is furnished to do so all subject to the following"
    ),
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to"
        " alter it and redistribute it freely subject to the following restrictions"
    ),
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
}
# Other wordings of these sentences.
OTHER_WORDINGS = {
    "mit-title": ("the mit license mit",),
    "mit-licensed": (
        "licensed under the mit license see the file",
        "licensed under the terms of the mit license",
        "this project is licensed under the mit license",
        "this software is licensed under the mit license",
    ),
    "isc-grant": (
        "permission to use copy modify and distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "mpl2-copy": (
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ),
}
# Identifiers of the public list of licences that a tag line may name.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SPDX_TAG = "spdx-license-identifier:"
SENTENCES |= {
    f"spdx-{i.lower()}": f"spdx license identifier {' '.join(re.findall('[a-z0-9]+', i.lower()))}" for i in SPDX
}


class LicenseRule(NamedTuple):
    """A licence, known by sentences that follow each other among the known ones.

    Where one of ``not_before`` follows them, it is another licence.
    """

    name: str
    license: str
    sentences: tuple[str, ...]
    not_before: tuple[str, ...] = ()


RULES = (
    LicenseRule("mit-text", "MIT", ("mit-grant", "mit-notice", "as-is-software")),
    LicenseRule("mit-title-text", "MIT", ("mit-title", "mit-grant")),
    LicenseRule("mit-release", "MIT", ("mit-release",)),
    LicenseRule("mit-licensed", "MIT", ("mit-licensed",)),
    LicenseRule("bsd-2-text", "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), ("bsd-endorse", "bsd-advert")),
    LicenseRule("bsd-3-text", "BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    LicenseRule("bsd-4-text", "BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    LicenseRule("apache-notice", "Apache-2.0", ("apache-notice",)),
    LicenseRule("apache-header", "Apache-2.0", ("apache-header", "apache-compliance")),
    LicenseRule("gpl3-notice", "GPL-3.0-only", ("gpl3-notice",)),
    LicenseRule("gpl3-header", "GPL-3.0-or-later", ("gpl-free", "gpl-free-terms", "gpl-warranty", "gpl-warranty-implied")),
    LicenseRule("gpl2-header", "GPL-2.0-or-later", ("gpl-free", "gpl-terms", "version-2-later")),
    LicenseRule("gpl3-header-parted", "GPL-3.0-or-later", ("gpl-free", "gpl-terms", "version-3-later")),
    LicenseRule("gpl2-only-header", "GPL-2.0-only", ("gpl-free", "gpl-terms", "version-2-only")),
    LicenseRule("lgpl2-header", "LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "version-2-1-later")),
    LicenseRule("lgpl3-header", "LGPL-3.0-or-later", ("lgpl3-terms",)),
    LicenseRule("agpl3-header", "AGPL-3.0-or-later", ("gpl-free", "agpl3-terms")),
    LicenseRule("isc-text", "ISC", ("isc-grant", "isc-disclaimer")),
    LicenseRule("0bsd-text", "0BSD", ("0bsd-grant", "isc-disclaimer")),
    LicenseRule("mpl2-notice", "MPL-2.0", ("mpl2-form", "mpl2-copy")),
    LicenseRule("unlicense-text", "Unlicense", ("unlicense-release", "unlicense-grant")),
    LicenseRule("cc0-dedication", "CC0-1.0", ("cc0-dedication",)),
    LicenseRule("boost-notice", "BSL-1.0", ("boost-notice",)),
    LicenseRule("boost-text", "BSL-1.0", ("boost-grant",)),
    LicenseRule("zlib-text", "Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    *(LicenseRule(f"spdx-{i.lower()}", i, (f"spdx-{i.lower()}",)) for i in SPDX),
    LicenseRule("cc-by-nc-4", "CC-BY-NC-4.0", ("cc-by-nc-4",)),
    LicenseRule("cc-by-4", "CC-BY-4.0", ("cc-by-4",)),
    LicenseRule("cc-by-sa-4", "CC-BY-SA-4.0", ("cc-by-sa-4",)),
)

# Every known sentence holds one of these.
ANCHORS = ("license", "redistribut", "permission", "warrant", "software", "mozilla", "unencumbered")

# After a word only: what stands at the start of a line is the mark of a comment.
SENTENCE_END = r"(?<![ \t\r\n.!?;:])[.!?;:]+(?:[ \t\r\n]+|$)"
NOT_WORD = r"[^a-z0-9\n\x01]+"
# The third BSD clause names whom it protects; a full stop in the name cuts off its head.
ENDORSER = r"^(?:neither the name of .*)?nor the names of (?:its|their|any|the) contributors may be used "
_ENDORSED = "neither the name of the copyright holder nor the names of its contributors may be used "
_OF_WHOM = r"(?:neither the name of [^\x01]{1,300}? )?nor the names of (?:its|their|any|the) contributors may be used "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _wordings(sentences: Mapping[str, str]) -> list[tuple[str, str]]:
    """Identifier and wording, the longest wordings first."""
    pairs = [(i, w) for i, known in sentences.items() for w in (known, *OTHER_WORDINGS.get(i, ()))]
    return sorted(pairs, key=lambda p: (-len(p[1]), p))


def _any_of(wordings: Sequence[str]) -> str:
    """A pattern for the wordings as whole lines, whose blanks may be line ends.

    Of several that begin at one place the longest is taken, as it stands first.
    """

    def pattern(wording: str) -> str:
        return _OF_WHOM + wording.removeprefix(_ENDORSED) if wording.startswith(_ENDORSED) else wording

    either = "|".join(map(pattern, wordings)).replace(" ", "[ \n]")
    return rf"(?<![^\n\x01])(?:{either})(?![^\n\x01])"


def license_sentences(text: Column, sentences: Mapping[str, str] = SENTENCES) -> Column:
    """The identifiers of known sentences in a text, in order.

    A blank line, and a full stop, semicolon or colon before a blank, end a sentence for
    certain; a line may begin or end one. So a title above a wrapped sentence is found as
    well as the sentence, and a sentence of one line as well as one of many.
    """
    lower = F.translate(text, _UPPER, _LOWER)
    whole = F.replace(lower, F.lit(SPDX_TAG), F.lit(SPDX_TAG.replace(":", " ")))
    marked = F.regexp_replace(F.regexp_replace(whole, SENTENCE_END, "\x01\n"), NOT_WORD, " ")
    lines = F.regexp_replace(F.regexp_replace(marked, " ?\n ?", "\n"), "\n\n+", "\x01")
    tidy = F.regexp_replace(F.regexp_replace(lines, " ?\x01[\n\x01 ]*", "\x01"), "^ | \\z", "")
    wordings = _wordings(sentences)
    texts, names = (F.array(*map(F.lit, column)) for column in ([w for _, w in wordings], [i for i, _ in wordings]))

    def named(found: Column) -> Column:
        plain = F.regexp_replace(F.translate(found, "\n", " "), ENDORSER, _ENDORSED)
        return F.element_at(names, F.array_position(texts, plain).cast("int"))

    found = F.transform(F.regexp_extract_all(tidy, F.lit(_any_of([w for _, w in wordings])), 0), named)
    may = reduce(lambda a, b: a | b, (F.contains(lower, F.lit(a)) for a in ANCHORS))
    return F.when(may, found).otherwise(F.array().cast("array<string>"))


def scan_licenses(
    docs: DataFrame,
    sentences: Mapping[str, str] = SENTENCES,
    rules: Sequence[LicenseRule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, sentences array, rules array, licenses array`` for every row of ``docs``.

    ``sentences`` are identifiers of the known sentences in order; ``rules`` the names
    of the rules whose sequence stands in them, and not before what excludes it, sorted;
    ``licenses`` the distinct licences of these, sorted. The arrays are empty for a null,
    empty or unlicensed text; a very long text is searched as a whole. Rows are
    independent, so repeated ones are alike; an empty table gives no rows. Other columns
    of ``docs``, whatever their names, are not read. Sentences given must hold one of
    ``ANCHORS`` and be of lower-case letters, digits and single spaces.
    """
    for name, sentence in _wordings(sentences):
        if not any(a in sentence for a in ANCHORS):
            raise ValueError(f"the sentence {name} holds no anchor")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    found = docs.select(docs[id_col].alias("doc_id"), license_sentences(text, sentences).alias("sentences"))
    sequence = F.concat(F.lit("|"), F.array_join("sentences", "|"), F.lit("|"))

    def holds(rule: LicenseRule) -> Column:
        known = f"|{'|'.join(rule.sentences)}|"
        if not rule.not_before:
            return F.contains(sequence, F.lit(known))
        others = "|".join(map(re.escape, rule.not_before))
        return F.rlike(sequence, F.lit(f"{re.escape(known)}(?!(?:{others})\\|)"))

    hits = [F.when(holds(r), F.lit(r.name)) for r in rules]
    named = [F.when(holds(r), F.lit(r.license)) for r in rules]
    return found.select(
        "doc_id",
        "sentences",
        F.array_sort(F.array_compact(F.array(*hits))).alias("rules"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))).alias("licenses"),
    )
