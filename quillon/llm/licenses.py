"""License scan: ordered signature rules gated by keywords, with priority and containment suppression."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import lean, slices, table, text_bytes
from quillon.llm.kernels import LOWERED, words

# Phrases whose places are counted, and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Label, keywords (parted by |, one of which every name has), names as regular expressions over words
# separated by one space.
FAMILIES = [
    ("mit", "mit|expat", r"mit|mit x11|x11 mit|expat"), ("mit-0", "mit", r"mit 0|mit no attribution"), ("x11", "x11|x consortium|x window system", r"x11|x consortium|x window system"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: license)?,? (?:version )?1 0"), ("apache-1.1", "apache", r"apache(?: software)?(?: license)? (?:version )?1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)? (?:version |v )?2 0|apache 2"), ("apache", "apache", r"apache(?: software)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"), ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)"), ("0bsd", "bsd", r"(?:0bsd|zero clause bsd)"), ("bsd", "bsd", r"bsd(?: style)?"),
    ("gpl-1.0", "gnu", r"gnu general public license (?:version |v )?1(?: 0)?"), ("gpl-2.0", "gnu", r"gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?"), ("gpl", "gpl", r"gpl|gnu gpl|gplv[123]|gpl v?[123](?: 0)?"),
    ("lgpl-2.0", "gnu", r"gnu library general public license (?:version |v )?2(?: 0)?"), ("lgpl-2.1", "gnu", r"gnu lesser general public license (?:version |v )?2 1"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public license (?:version |v )?3(?: 0)?"), ("lgpl", "lgpl", r"lgpl|gnu lgpl|lgplv[23]|lgpl v?[23](?: [01])?"), ("lgpl", "lesser", r"(?:gnu )?lesser general public"), ("lgpl", "library", r"(?:gnu )?library general public"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license (?:version |v )?3(?: 0)?"), ("agpl", "affero", r"(?:gnu )?affero general public"), ("agpl", "agpl", r"agpl|agplv3|agpl v?3(?: 0)?"),
    ("mpl-1.0", "mozilla", r"mozilla public license (?:version |v )?1 0"), ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v )?1 1"), ("mpl-2.0", "mozilla", r"mozilla public license (?:version |v )?2 0"), ("mpl", "mozilla", r"mozilla(?: public)?"), ("mpl", "mpl", r"mpl|mpl v?[12] [01]"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v )?1 0"), ("epl-2.0", "eclipse", r"eclipse public license (?:version |v )?2 0"), ("epl", "eclipse", r"eclipse(?: public| distribution)?"), ("epl", "epl", r"epl|epl v?[12] 0"),
    ("cddl-1.0", "cddl", r"cddl|cddl v?1 [01]"), ("cddl-1.0", "common development", r"common development and distribution"), ("cpl-1.0", "common public", r"common public"), ("ipl-1.0", "ibm", r"ibm public"),
    ("isc", "isc|internet systems consortium", r"isc|internet systems consortium"), ("zlib", "zlib", r"zlib|zlib libpng"), ("libpng", "libpng", r"libpng"), ("boost-1.0", "boost|bsl 1 0", r"boost(?: software)?|bsl 1 0"), ("unlicense", "unlicense", r"(?:the )?unlicense"), ("wtfpl", "wtfpl", r"wtfpl"),
    ("cc0-1.0", "cc0", r"cc0|cc0 1 0(?: universal)?"), ("cc-by", "cc by", r"cc by(?: [1234] 0)?"), ("cc-by-sa", "cc by sa", r"cc by sa(?: [1234] 0)?"), ("cc-by-nc", "cc by nc", r"cc by nc(?: [1234] 0)?"), ("cc-by-nd", "cc by nd", r"cc by nd(?: [1234] 0)?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1234] 0)?"), ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1234] 0)?"), ("cc-by", "creative", r"creative commons attribution(?: [1234] 0)?"), ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1234] 0)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1234] 0)?"), ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?(?: [1234] 0)?"), ("cc", "creative", r"creative commons"),
    ("artistic-1.0", "artistic", r"artistic license 1 0"), ("artistic-2.0", "artistic", r"artistic license 2 0"), ("artistic", "artistic", r"artistic"), ("perl", "perl", r"same terms as perl(?: itself)?"), ("python-2.0", "python|psf", r"python(?: software foundation)?|psf"),
    ("ruby", "ruby", r"ruby"), ("php-3.0", "php", r"php(?: license)?(?: version)? 3 0[01]?"), ("openssl", "openssl", r"openssl"), ("ofl-1.1", "sil", r"sil open font"), ("odbl", "open database", r"open database"), ("eupl", "european", r"european union public"), ("eupl", "eupl", r"eupl"),
    ("osl-3.0", "open software", r"open software license(?: v)? 3 0"), ("afl-3.0", "academic", r"academic free"), ("ms-pl", "microsoft", r"microsoft public"), ("ms-rl", "microsoft", r"microsoft reciprocal"), ("postgresql", "postgresql", r"postgresql"), ("ncsa", "ncsa|university of illinois", r"ncsa|university of illinois"),
    ("sspl", "server side", r"server side public"), ("busl", "business source", r"business source"), ("elastic", "elastic", r"elastic"), ("vim", "vim", r"vim"), ("w3c", "w3c", r"w3c(?: software)?"), ("beerware", "beerware|beer ware", r"beerware|beer ware"),
]
# The forms in which a name is written, words of which every match has one, and confidence; each
# family gives a rule by each form.
FORMS = [
    (r"spdx license identifier (?:{0})", "license", 1.0), (r"licensed under (?:the )?(?:terms of )?(?:the )?(?:{0})(?: licen[cs]e)?", "licensed", 0.95), (r"released under (?:the )?(?:{0})(?: licen[cs]e)?", "released", 0.95),
    (r"distributed under (?:the )?(?:terms of )?(?:the )?(?:{0})(?: licen[cs]e)?", "distributed", 0.9), (r"(?:the )?(?:{0}) licen[cs]e", "license licence", 0.85), (r"licen[cs]e (?:type )?(?:is )?(?:the )?(?:{0})", "license licence", 0.7),
]
# Wordings of texts and notices of licenses: label, a phrase that every match has, the wording, confidence.
WORDINGS = [
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0), ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 1.0), ("public-domain", "public domain", r"(?:released into|dedicated to|placed in(?:to)?|in) the public domain", 0.8),
    ("proprietary", "all rights reserved", r"(?:copyright [^ ]+ (?:[^ ]+ ){0,4})?all rights reserved", 0.4), ("gpl", "free software", r"this program is free software you can redistribute it and or modify it", 1.0), ("warranty", "warranty", r"without warranty of any kind|as is without warranty", 0.3),
    ("mit", "the above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 1.0),
    ("mit-0", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", 1.0),
    ("x11", "x consortium shall not", r"the name of the x consortium shall not be used in advertising", 1.0),
    ("apache-2.0", "compliance with the license", r"you may not use this file except in compliance with the license", 1.0),
    ("apache-2.0", "apache org licenses", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?", 1.0),
    ("apache-2.0", "applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation", 0.9),
    ("bsd-2-clause", "binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice", 0.8),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software", 1.0),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display", 1.0),
    ("isc", "appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("0bsd", "hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 1.0),
    ("gpl-2.0", "any later version", r"version 2 of the license or at your option any later version", 1.0),
    ("gpl-3.0", "any later version", r"version 3 of the license or at your option any later version", 1.0),
    ("gpl-2.0", "59 temple place", r"59 temple place suite 330 boston ma 02111 1307", 0.7), ("gpl-2.0", "51 franklin", r"51 franklin (?:street|st) fifth floor boston ma 02110 1301", 0.7),
    ("gpl", "copy of the gnu", r"you should have received a copy of the gnu general public license along with", 1.0),
    ("gpl-3.0", "copyleft license", r"the gnu general public license is a free copyleft license for software and other kinds of works", 1.0),
    ("gpl-2.0", "take away your freedom", r"the licenses for most software are designed to take away your freedom to share and change it", 1.0),
    ("lgpl", "copy of the gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", 1.0),
    ("lgpl-2.1", "any later version", r"version 2 1 of the license or at your option any later version", 1.0),
    ("agpl-3.0", "copy of the gnu", r"you should have received a copy of the gnu affero general public license along with", 1.0),
    ("agpl-3.0", "network server software", r"specifically designed to ensure cooperation with the community in the case of network server software", 1.0),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0", 1.0),
    ("mpl-2.0", "mozilla org mpl", r"obtain one at (?:https? )?mozilla org mpl 2 0", 1.0), ("mpl-1.1", "contents of this file", r"the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl-1.0", "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl v10 html", 1.0), ("epl-2.0", "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl 2 0", 1.0),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse", 1.0),
    ("cddl-1.0", "common development", r"the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 1.0), ("zlib", "origin of this software", r"the origin of this software must not be misrepresented", 1.0),
    ("boost-1.0", "boost org license", r"(?:https? )?(?:www )?boost org license 1 0 txt", 1.0), ("boost-1.0", "machine executable", r"solely in the form of machine executable object code generated by a source language processor", 1.0),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain", 1.0), ("unlicense", "unlicense org", r"(?:https? )?(?:www )?unlicense org", 0.9),
    ("wtfpl", "do what the", r"do what the [^ ]+ you want to public license", 1.0), ("wtfpl", "you just do what", r"you just do what the [^ ]+ you want to", 1.0),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0", 1.0), ("cc0-1.0", "waived all copyright", r"has waived all copyright and related or neighboring rights", 1.0),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1234] [05]", 1.0), ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1234] [05]", 1.0),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1234] [05]", 1.0), ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1234] [05]", 1.0),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1234] [05]", 1.0), ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1234] [05]", 1.0),
    ("artistic-2.0", "standard version", r"you may distribute verbatim copies of the source form of the standard version", 0.9), ("artistic", "artistic control", r"maintain some semblance of artistic control over the development of the package", 1.0),
    ("perl", "free software", r"this (?:library|program|module) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl", 1.0),
    ("python-2.0", "python software foundation", r"this license agreement is between the python software foundation", 1.0), ("ruby", "either the terms", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", 0.9),
    ("php-3.0", "php software", r"this product includes php software freely available from", 1.0), ("openssl", "openssl project", r"this product includes software developed by the openssl project", 1.0),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license", 1.0), ("ofl-1.1", "reserved font name", r"with reserved font name", 0.9),
    ("odbl", "open database", r"this [^ ]+ is made available under the open database license", 1.0), ("eupl", "european union public", r"you may not use this work except in compliance with the licen[cs]e (?:[^ ]+ ){0,20}european union public", 0.9),
    ("ms-pl", "this license governs", r"this license governs use of the accompanying software", 0.9), ("postgresql", "university of california", r"in no event shall the university of california be liable to any party for direct", 0.8),
    ("ncsa", "with the software without", r"to deal with the software without restriction", 0.9), ("sspl", "service source code", r"offering the program as a service you must make the service source code available", 1.0),
    ("busl", "change date", r"effective on the change date", 0.8), ("elastic", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim", 1.0), ("w3c", "w3c", r"title to copyright in this (?:work|software) (?:[^ ]+ ){0,12}w3c", 0.8),
    ("beerware", "buy me a beer", r"you can buy me a beer in return", 1.0), ("jsr", "shall be used for good", r"the software shall be used for good not evil", 1.0),
    ("commons-clause", "commons clause", r"commons clause license condition v?1 0", 1.0), ("proprietary", "confidential and proprietary", r"(?:strictly )?confidential and proprietary", 0.7),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this (?:file|work|material) via any medium is strictly prohibited", 0.9), ("proprietary", "may not be reproduced", r"(?:this (?:[^ ]+ ){0,4})?may not be reproduced (?:[^ ]+ ){0,8}without (?:the )?(?:prior )?(?:written )?permission", 0.6),
    ("non-commercial", "non commercial", r"for (?:personal )?non commercial (?:use|purposes) only", 0.7), ("research-only", "research purposes", r"for (?:academic and )?research purposes only", 0.7),
]
_NEEDED = {w for _, ws, _ in FORMS for w in ws.split()} | {max(reversed(k.split()), key=len) for k in [p for p, _ in BASE] + [k for _, k, _, _ in WORDINGS]}
#: A document without any of these words is not looked at by any rule: every match of a rule has one of them
#: (its form's, or the longest of its base phrase or of its wording's keyword).
GATE = tuple(sorted(w.encode() for w in _NEEDED if not any(v != w and v in w for v in _NEEDED)))
IS_GAP = np.ones(256, bool)
IS_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SPACED = LOWERED.copy()
SPACED[IS_GAP] = 32


@lru_cache(maxsize=1)
def rules():
    """(priority, keywords, pattern, label, confidence); every match has one of the keywords. A lower priority goes
    first. Base phrases lead, then longer-named families before shorter ones in each form."""
    out = [(0, (p.encode(),), re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label, 0.9) for p, label in BASE]
    made = [(1 + i, k, form.format(name), label, w) for i, (form, _, w) in enumerate(FORMS) for label, k, name in FAMILIES]
    made += [(1, k, text, label, w) for label, k, text, w in WORDINGS]
    return out + [(p, tuple(k.encode().split(b"|")), re.compile(rb"(?<![^ ])(?:" + t.encode() + rb")(?![^ ])"), label, w) for p, k, t, label, w in made]


def detect(text: bytes, all_rules) -> list[tuple[int, int, int, str, float]]:
    """Detections (start, end, priority, label, confidence) in words joined by single spaces.

    Rules run only where one of their keywords stands. A detection inside one of a rule that goes first, or inside
    a longer one of an equal rule, is suppressed; base phrases (priority 0) are never."""
    found = [(m.start(), m.end(), p, label, w) for p, ks, pattern, label, w in all_rules if any(k in text for k in ks) for m in pattern.finditer(text)]
    found.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))  # what could contain a detection comes before it
    reach, kept, same = [-1] * (1 + max((d[2] for d in found), default=0)), [], set()
    for d in found:
        start, end, p, label, _ = d
        if p == 0 or (start, end, label) not in same and max(reach[1 : p + 1]) < end:
            kept.append(d)
            same.add((start, end, label))
            reach[p] = max(reach[p], end)  # how far the detections of a priority reach so far
    return kept


def scan_licenses(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Licenses of every whole text: id, n_words, n_base, first_word, last_word, base_labels, labels, score
    and spans (word, label, confidence of each detection that stays, in order).

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters above U+007F. score: one minus
    the product of one minus each label's best confidence. A null or empty text has no words, no labels
    (empty strings) and score 0. Rows are judged one by one; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        all_rules = rules()
        for b in batches:
            data, off = text_bytes(b.column(1))
            for a, z in slices(off):
                part, bounds = SPACED[data[off[a] : off[z]]], off[a : z + 1] - off[a]
                starts, _ = words(part, bounds[:-1], IS_GAP)
                n_words = np.diff(np.searchsorted(starts, bounds))
                raw, open_ = part.tobytes(), set()
                for g in GATE:
                    at = raw.find(g)
                    while at >= 0:
                        i = int(np.searchsorted(bounds, at, "right")) - 1
                        open_.add(i)
                        at = raw.find(g, int(bounds[i + 1]))
                rows = [(0, None, None, "", "", 0.0, [])] * (z - a)
                for i in open_:
                    text = b" ".join(raw[bounds[i] : bounds[i + 1]].split())
                    found = sorted(detect(text, all_rules))
                    if not found:
                        continue
                    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                    at = np.searchsorted(gaps, [d[0] for d in found]).tolist()
                    spans = [(i, label, w) for i, (_, _, _, label, w) in zip(at, found)]
                    base = [i for i, (_, _, p, _, _) in zip(at, found) if p == 0]
                    best: dict = {}
                    for _, label, w in spans:
                        best[label] = max(w, best.get(label, 0))
                    rows[i] = (len(base), min(base, default=None), max(base, default=None), ",".join(sorted({d[3] for d in found if d[2] == 0})), ",".join(sorted(best)), float(1 - np.prod([1 - w for w in best.values()])), [{"word": s, "label": x, "confidence": w} for s, x, w in spans])
                cols = list(zip(*rows)) if rows else [()] * 7
                span = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("confidence", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), pa.array(n_words, pa.int64()), *(pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]))],
                    names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<word:bigint,label:string,confidence:double>>")


def op6_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
