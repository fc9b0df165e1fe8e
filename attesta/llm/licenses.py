"""Licence recognition: sentences to identifiers, identifier sequences to ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifier of each known sentence, by its normalised form.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache-2.0-short",
    "licensed under the apache license version 2 0 the license": "apache-2.0-head",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy-at",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "this project is licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-short",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0-short",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-header",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2.0-terms",
    "either version 3 of the license or at your option any later version": "gpl-3.0-later",
    "either version 2 of the license or at your option any later version": "gpl-2.0-later",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-short",
    "licensed under cc by 4 0": "cc-by-4.0-short",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-short",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-short",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-endorse",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "all rights reserved": "reserved",
    "this work is dedicated to the public domain": "public-domain",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "the mit license mit": "mit-title",
    "apache license version 2 0 january 2004": "apache-2.0-title",
    "gnu general public license version 3 29 june 2007": "gpl-3.0-title",
    "gnu general public license version 2 june 1991": "gpl-2.0-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3.0-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl-2.1-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3.0-title",
    "mozilla public license version 2 0": "mpl-2.0-title",
    "this library is free software": "lgpl-free",
    "either version 2 1 of the license or at your option any later version": "lgpl-2.1-later",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2.0-terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2.0-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2.0-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-anyone",
    "cc0 1 0 universal": "cc0-title",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "you should have received a copy of the cc0 public domain dedication along with this software": "cc0-copy",
    "spdx license identifier": "spdx",
}
for _kind, _marks in (("GNU Lesser", "lgpl"), ("GNU Affero", "agpl")):
    _terms = f"you can redistribute it and or modify it under the terms of the {_kind.lower()} general public license as published by the free software foundation"
    SENTENCES[_terms] = f"{_marks}-terms"
    for _version, _mark in (("3", "3.0"), ("2 1", "2.1")):
        SENTENCES[f"{_terms} either version {_version} of the license or at your option any later version"] = f"{_marks}-{_mark}-terms"

#: Creative Commons licences and versions, as names and as marks.
_COMMONS = (("attribution", "by"), ("attribution sharealike", "by-sa"), ("attribution noncommercial", "by-nc"), ("attribution noncommercial sharealike", "by-nc-sa"), ("attribution noderivatives", "by-nd"), ("attribution noncommercial noderivatives", "by-nc-nd"))
_VERSIONS = (("4 0 international", "4.0"), ("3 0 unported", "3.0"))
for _name, _mark in _COMMONS:
    for _version, _number in _VERSIONS:
        for _article in ("a", "the"):
            SENTENCES[f"this work is licensed under {_article} creative commons {_name} {_version} license"] = f"cc-{_mark}-{_number}-short"
        SENTENCES[f"licensed under cc {_mark.replace('-', ' ')} {_number.replace('.', ' ')}"] = f"cc-{_mark}-{_number}-short"

#: Licences that may follow an SPDX tag.
_TAGGED = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Unlicense", "CC0-1.0", *(f"CC-{m.upper()}-{n}" for _, m in _COMMONS for _, n in _VERSIONS))
for _licence in _TAGGED:
    for _suffix in ("", "-only", "-or-later", "+"):
        SENTENCES.setdefault(re.sub(r"[^a-z0-9]+", " ", (_licence + _suffix).lower()).strip(), f"spdx-{_licence}")

#: Ordered rules: licence, then the sentence identifiers that must follow one another. The first
#: rule that matches at a place wins, so longer and more specific rules come first.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    *((licence, ("spdx", f"spdx-{licence}")) for licence in _TAGGED),
    ("Apache-2.0", ("apache-2.0-title",)),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("mit-title",)),
    ("LGPL-3.0", ("lgpl-3.0-title",)),
    ("LGPL-2.1", ("lgpl-2.1-title",)),
    ("AGPL-3.0", ("agpl-3.0-title",)),
    ("GPL-3.0", ("gpl-3.0-title",)),
    ("GPL-2.0", ("gpl-2.0-title",)),
    *(("LGPL-" + v, (free, f"lgpl-{v}-terms")) for free in ("lgpl-free", "gpl-free") for v in ("3.0", "2.1")),
    *(("LGPL-3.0", (free, "lgpl-terms", "gpl-3.0-later")) for free in ("lgpl-free", "gpl-free")),
    *(("LGPL-2.1", (free, "lgpl-terms", "lgpl-2.1-later")) for free in ("lgpl-free", "gpl-free")),
    *(("LGPL", (free, "lgpl-terms")) for free in ("lgpl-free", "gpl-free")),
    ("AGPL-3.0", ("gpl-free", "agpl-3.0-terms")),
    ("AGPL-3.0", ("gpl-free", "agpl-terms", "gpl-3.0-later")),
    ("MPL-2.0", ("mpl-2.0-terms", "mpl-2.0-copy")),
    ("MPL-2.0", ("mpl-2.0-terms",)),
    ("MPL-2.0", ("mpl-2.0-title",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("Unlicense", ("unlicense-domain",)),
    ("CC0-1.0", ("cc0-dedication", "cc0-copy")),
    ("CC0-1.0", ("cc0-dedication",)),
    ("CC0-1.0", ("cc0-title",)),
    ("Apache-2.0", ("apache-2.0-head", "apache-comply", "apache-copy-at")),
    ("Apache-2.0", ("apache-2.0-short", "apache-comply")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0", ("gpl-3.0-header",)),
    ("GPL-3.0", ("gpl-free", "gpl-3.0-terms")),
    ("GPL-2.0", ("gpl-free", "gpl-2.0-terms")),
    ("GPL-3.0", ("gpl-free", "gpl-terms", "gpl-3.0-later")),
    ("GPL-2.0", ("gpl-free", "gpl-terms", "gpl-2.0-later")),
    ("GPL", ("gpl-free", "gpl-terms")),
    ("Apache-2.0", ("apache-2.0-short",)),
    ("Apache-2.0", ("apache-2.0-head",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-grant",)),
    ("GPL-3.0", ("gpl-3.0-short",)),
    ("GPL-2.0", ("gpl-2.0-short",)),
    *((f"CC-{m.upper()}-{n}", (f"cc-{m}-{n}-short",)) for _, m in _COMMONS for _, n in _VERSIONS),
    ("Public-Domain", ("public-domain",)),
    ("Proprietary", ("reserved",)),
)

#: A sentence ends at a full stop and the like before white space, or at a line's end, unless a known
#: sentence goes on in the next line.
_ENDS = re.compile(r"\n|(?<=[.;:!?])[ \t]+")
_NOT_WORD = re.compile(r"[^a-z0-9]+")

def normalise(sentence: str) -> str:
    return _NOT_WORD.sub(" ", sentence.lower()).strip()


@lru_cache(8)
def _beginnings(sentences: tuple[str, ...]) -> frozenset[str]:
    """What known sentences may begin with, in whole words."""
    return frozenset(" ".join(words[:k]) for words in map(str.split, sentences) for k in range(1, len(words)))


def cues(sentences: dict[str, str], rules: tuple) -> re.Pattern:
    """The longest word of each sentence that a rule begins with: no rule matches in a text without any."""
    begins = {wanted[0] for _, wanted in rules if wanted}
    words = {max(s.split(), key=len) for s, name in sentences.items() if name in begins and s}
    return re.compile(b"(?i)" + b"|".join(re.escape(w.encode()) for w in sorted(words))) if words else re.compile(b"(?!)")


def identifiers(text: str, sentences: dict[str, str]) -> list[tuple[str, int]]:
    """(identifier, character offset) of each known sentence of a text, in order.

    A sentence may be wrapped over lines, each behind a comment's marks; the longest known one counts.
    """
    starts, pieces, wraps, at = [], [], [], 0
    for m in [*_ENDS.finditer(text), None]:
        end = m.start() if m else len(text)
        starts.append(at), pieces.append(normalise(text[at:end])), wraps.append(m is not None and m.group() == "\n")
        at = m.end() if m else end
    known, found, i = _beginnings(tuple(sentences)), [], 0
    while i < len(pieces):
        whole, last, name, k = pieces[i], i, sentences.get(pieces[i]), i
        while whole in known and wraps[k] and k + 1 < len(pieces) and pieces[k + 1]:
            k += 1
            whole = f"{whole} {pieces[k]}"
            if whole in sentences:
                last, name = k, sentences[whole]
        if name:
            found.append((name, starts[i]))
        i = last + 1
    return found


def match_rules(names: list[str], rules: tuple) -> list[tuple[str, int, int]]:
    """(licence, first, length) of rules matched from left to right; matched sentences aren't used again."""
    found, at = [], 0
    while at < len(names):
        for licence, wanted in rules:
            if tuple(names[at : at + len(wanted)]) == wanted:
                found.append((licence, at, len(wanted)))
                at += len(wanted)
                break
        else:
            at += 1
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """(id, licence, sentence_ids, start, n_sentences): one row per rule matched in a document.

    ``start`` is the code-point offset of the first matched sentence. One pass without a shuffle.
    Documents without a licence, null and empty texts give no row; repeated rows, also of one id, each
    give theirs. Of rules that match at one place the first counts; other columns don't matter.
    """
    kind, cue = dict(docs.dtypes)[id_col], cues(sentences, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, raw in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                if not raw or not cue.search(raw):
                    continue
                ids = identifiers(raw.decode("utf-8", "replace"), sentences)
                for licence, first, n in match_rules([x for x, _ in ids], rules):
                    rows.append(i)
                    out.append((licence, ",".join(x for x, _ in ids[first : first + n]), ids[first][1], n))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)]
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), *arrays], ["id", "licence", "sentence_ids", "start", "n_sentences"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, licence string, sentence_ids string, start bigint, n_sentences int")
