"""License scan by ordered signature rules.

A rule is a regular expression over the words of a text (lower case, joined by one blank), a label, a
priority, a confidence, a keyword without which it can't match, and names of which one must occur. One automaton
looks for all of these; only the rules that they let through are run. Detections are then taken in order of priority, then length: one that lies
inside a detection taken already is suppressed. Phrase rules, which name a label's fixed words, have the
first priority, so none of them is ever suppressed.

Null and empty texts have no words and no labels (empty strings) and the score 0. A row without a doc_id is scanned like any
other. The work on a text is in proportion to its length and the places found in it, however long it is.

The rules: SENTENCES are written one by one; a reference to a licence is one of FORMS around one of NAMES or FAMILIES, as a table of all
of them would be built from just these two lists.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_texts

#: Words are runs of ASCII letters and digits and of anything that is not ASCII; A-Z are lowered.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float
    names: tuple[str, ...] = ()


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, how the licence is called in words (a regular expression), and keywords of which one must occur.
NAMES = [
    ("mit", "mit", (" mit ",)),
    ("apache-1.1", "apache(?: software)?(?: licen[cs]e)?(?: version)? 1 1", ("apache",)),
    ("apache-2", "apache(?: software)?(?: licen[cs]e)?(?: version)? 2(?: 0)?", ("apache",)),
    ("bsd-2-clause", "(?:simplified bsd|bsd 2 clause|freebsd)", ("bsd",)),
    ("bsd-3-clause", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause)", ("bsd",)),
    ("bsd-4-clause", "(?:original bsd|bsd 4 clause)", ("bsd",)),
    ("gpl-2", "(?:gnu )?(?:gpl|general public licen[cs]e) ?v?(?: version)? ?2(?: 0)?", ("gpl", "general public")),
    ("gpl-3", "(?:gnu )?(?:gpl|general public licen[cs]e) ?v?(?: version)? ?3(?: 0)?", ("gpl", "general public")),
    ("lgpl-2.1", "(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e) ?v?(?: version)? ?2 1", ("lgpl", "general public")),
    ("lgpl-3", "(?:gnu )?(?:lgpl|lesser general public licen[cs]e) ?v?(?: version)? ?3(?: 0)?", ("lgpl", "general public")),
    ("agpl-3", "(?:gnu )?(?:agpl|affero general public licen[cs]e) ?v?(?: version)? ?3(?: 0)?", ("agpl", "affero")),
    ("mpl-1.1", "(?:mpl|mozilla public licen[cs]e) ?v?(?: version)? ?1 1", ("mpl", "mozilla")),
    ("mpl-2", "(?:mpl|mozilla public licen[cs]e) ?v?(?: version)? ?2(?: 0)?", ("mpl", "mozilla")),
    ("epl-1", "(?:epl|eclipse public licen[cs]e) ?v?(?: version)? ?1(?: 0)?", (" epl", "eclipse")),
    ("epl-2", "(?:epl|eclipse public licen[cs]e) ?v?(?: version)? ?2(?: 0)?", (" epl", "eclipse")),
    ("cddl-1", "(?:cddl|common development and distribution licen[cs]e)", ("cddl", "common development")),
    ("isc", "isc", (" isc ",)),
    ("zlib", "(?:zlib|zlib libpng)", ("zlib",)),
    ("bsl-1", "boost software licen[cs]e", ("boost",)),
    ("artistic-2", "artistic(?: licen[cs]e)?(?: version)? 2(?: 0)?", ("artistic",)),
    ("unlicense", "unlicen[cs]e", ("unlicen",)),
    ("wtfpl", "wtfpl", ("wtfpl",)),
    ("cc0-1.0", "(?:cc0|cc zero|creative commons zero)(?: v?1 0)?(?: universal)?", (" cc", "creative commons")),
    ("cc-by", "(?:cc by|creative commons attribution)(?! (?:nc|nd|sa|non|no|share))(?: [1-4] [05])?", (" cc ", "creative commons")),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?", (" cc ", "creative commons")),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative|s|atives)?(?: works)?)(?: [1-4] [05])?", (" cc ", "creative commons")),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?! (?:nd|sa|no|share))(?: [1-4] [05])?", (" cc ", "creative commons")),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?", (" cc ", "creative commons")),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)?(?: works)?)(?: [1-4] [05])?", (" cc ", "creative commons")),
    ("gfdl", "(?:gfdl|gnu free documentation licen[cs]e)", ("gfdl", "free documentation")),
    ("ofl-1.1", "(?:sil )?open font licen[cs]e", ("font",)),
    ("odbl", "(?:odbl|open database licen[cs]e)", ("odbl", "open database")),
    ("psf-2", "(?:psf|python software foundation)(?: licen[cs]e)?(?: version)?(?: 2)?", ("psf", "python software")),
    ("postgresql", "postgresql", ("postgresql",)),
    ("openssl", "openssl", ("openssl",)),
    ("upl-1", "(?:upl|universal permissive licen[cs]e)", (" upl", "universal permissive")),
    ("eupl-1.2", "(?:eupl|european union public licen[cs]e)(?: v?1 [12])?", ("eupl", "european union")),
    ("ms-pl", "(?:ms pl|microsoft public licen[cs]e)", (" ms pl", "microsoft public")),
    ("busl-1.1", "(?:busl|business source licen[cs]e)", ("busl", "business source")),
    ("sspl-1", "(?:sspl|server side public licen[cs]e)", ("sspl", "server side")),
]
# Families of licences whose version a text may leave out. They count less than a licence with its version, which suppresses them.
FAMILIES = [
    ("apache", "apache(?: software)?", ("apache",)),
    ("bsd", "bsd(?: style)?", ("bsd",)),
    ("gpl", "(?:gnu )?(?:gpl|general public)", ("gpl", "general public")),
    ("lgpl", "(?:gnu )?(?:lgpl|(?:lesser|library) general public)", ("lgpl", "general public")),
    ("agpl", "(?:gnu )?(?:agpl|affero general public)", ("agpl", "affero")),
    ("mpl", "(?:mpl|mozilla public)", ("mpl", "mozilla")),
    ("epl", "(?:epl|eclipse public)", (" epl", "eclipse")),
    ("artistic", "artistic", ("artistic",)),
    ("creative-commons", "creative commons", ("creative commons",)),
]
# How a licence is granted or referred to, by falling strength; {} is its name. Then keyword and confidence.
FORMS = [
    ("spdx licen[cs]e identifier {}", "spdx", 0.98),
    ("licen[cs]ed under(?: the)?(?: terms of the)? {}", "licen", 0.95),
    ("(?:released|distributed|published|provided|available|covered|made available) under(?: the)?(?: terms(?: and conditions)? of the)? {}", "under", 0.9),
    ("subject to(?: the)?(?: terms of the)? {}", "subject to", 0.85),
    ("(?:dual|multi) licen[cs]ed (?:under )?(?:the )?{}", "licen", 0.85),
    ("{} licen[cs]e(?:d)?", "licen", 0.7),
    ("licen[cs]e(?:s|d)?(?: (?:is|type|name))? {}", "licen", 0.65),
]
# Sentences of licence texts.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used", "neither the name"),
    ("gpl", "this program is free software you can redistribute it and or modify", "free software"),
    ("lgpl", "this library is free software you can redistribute it and or modify", "free software"),
    ("apache-2", "you may not use this file except in compliance with the licen[cs]e", "except in compliance"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public licen[cs]e", "source code form"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining", "permission is hereby"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary"),
    ("proprietary", "no part of this (?:publication|work|book|document) may be reproduced", "no part of this"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event", "as is without any"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented", "altered source versions"),
    ("mit", "the above copyright notice and this permission notice shall be included in all", "this permission notice"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to", "provided as is without warranty"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software .{1,120}? without restriction including .{1,200}? to do so(?! subject)", "permission is hereby"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("bsd", "this software is provided by the (?:regents|copyright holders?|author)(?: and contributors)? as is", "software is provided by"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising materials"),
    ("bsd-3-clause-clear", "no express or implied licen[cs]es to any party s patent rights are granted", "patent rights are granted"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "hope that it will be useful"),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e", "should have received a copy"),
    ("lgpl", "you should have received a copy of the gnu lesser general public licen[cs]e", "should have received a copy"),
    ("agpl-3", "you should have received a copy of the gnu affero general public licen[cs]e", "should have received a copy"),
    ("agpl-3", "your modified version must prominently offer all users interacting with it remotely", "interacting with it remotely"),
    ("gpl-2", "either version 2 of the licen[cs]e or at your option any later version", "either version 2"),
    ("gpl-3", "either version 3 of the licen[cs]e or at your option any later version", "either version 3"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", "required by applicable law"),
    ("apache-2", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e", "perpetual worldwide"),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software foundation"),
    ("mpl-2", "if a copy of the mpl was not distributed with this file you can obtain one at", "mpl was not distributed"),
    ("epl-2", "the accompanying program is provided under the terms of this eclipse public licen[cs]e", "accompanying program"),
    ("cddl-1", "you may not use this file except in compliance with the common development", "common development"),
    ("bsl-1", "unless such copies or derivative works are solely in the form of machine executable object code", "machine executable object code"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "permission to use"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy"),
    ("wtfpl", "you just do what the fuck you want to", "do what the fuck"),
    ("cc-by-sa", "you may distribute .{0,60}? only under (?:the same|this|an identical) licen[cs]e", "you may distribute"),
    ("cc-by-nc", "you may not (?:use (?:the|this) (?:work|material)|exercise .{1,60}?) for commercial purposes", "commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material", "remix transform"),
    ("cc-by", "you must give appropriate credit provide a link to the licen[cs]e", "appropriate credit"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain", "this deed"),
    ("cc0-1.0", "to the extent possible under law .{1,80}? has waived all copyright", "waived all copyright"),
    ("public-domain", "this (?:work|file|software|document) is in the public domain", "public domain"),
    ("public-domain", "no copyright is claimed", "no copyright is claimed"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "free documentation"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant sections"),
    ("ofl-1.1", "this font software is licen[cs]ed under the sil open font licen[cs]e", "font software"),
    ("ofl-1.1", "the fonts? .{0,40}? may be bundled redistributed and or sold with any software", "bundled redistributed"),
    ("odbl", "any rights in individual contents of the database are licen[cs]ed under the database contents licen[cs]e", "database contents"),
    ("psf-2", "psf grants licen[cs]ee a nonexclusive royalty free world wide licen[cs]e", "psf grants"),
    ("openssl", "this product includes software developed by the openssl project", "openssl project"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "without a written agreement"),
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service", "as a service"),
    ("busl-1.1", "the licensor may make an additional use grant above permitting limited production use", "additional use grant"),
    ("artistic-2", "you are permitted to use the standard version and create and use modified versions for any purpose without restriction", "standard version"),
    ("proprietary", "(?:this is )?unpublished proprietary source code", "unpublished proprietary"),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|use) of this .{1,60}? (?:is (?:strictly )?)?prohibited", "prohibited"),
    ("proprietary", "may not be (?:copied|reproduced|distributed) .{0,60}? without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)", "may not be"),
    ("proprietary", "for internal use only", "internal use only"),
    ("non-commercial", "for (?:personal and )?non ?commercial use only", "commercial use only"),
    ("research-only", "for (?:academic and )?research (?:purposes|use) only", "research"),
    ("evaluation-only", "for evaluation (?:purposes|use) only", "evaluation"),
]


def default_rules() -> list[Rule]:
    """Phrases first, then sentences of licence texts, then each form of reference to each licence."""
    rules = [Rule(label, re.escape(p).replace("\\ ", " "), p, 0, 1.0) for p, label in PHRASES.items()]
    weak = {"proprietary": 0.6, "non-commercial": 0.6, "research-only": 0.6, "evaluation-only": 0.6}
    rules += [Rule(label, p, keyword, 1, weak.get(label, 1.0)) for label, p, keyword in SENTENCES]
    for place, (form, keyword, confidence) in enumerate(FORMS):
        for label, name, names in NAMES:
            rules.append(Rule(label, form.format(f"(?:{name})"), keyword, 2 + place, confidence, names))
        for label, name, names in FAMILIES:
            rules.append(Rule(label, form.format(f"(?:{name})"), keyword, 2 + len(FORMS) + place, confidence / 2, names))
    return rules


@dataclass(frozen=True)
class Detection:
    label: str
    first: int  # number of the first word
    last: int
    priority: int
    confidence: float


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.by_keyword: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for r in rules:
            # word borders on both sides; a look-ahead, so that places may overlap
            self.by_keyword.setdefault(r.keyword, []).append((r, re.compile(f"(?<= )(?=({r.pattern}) )")))
        self.automaton = ahocorasick.Automaton()
        for k in {*self.by_keyword, *(n for r in rules for n in r.names)}:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    def all_matches(self, text: bytes) -> tuple[int, list[Detection]]:
        """The number of words, and every place at which a rule matches."""
        words = text.translate(_TO_WORDS).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        present = {k for _, k in self.automaton.iter(line)}
        found: list[Detection] = []
        starts: list[int] = []  # where each word starts, made for the first match only
        for k in sorted(present & self.by_keyword.keys()):
            for rule, pattern in self.by_keyword[k]:
                if rule.names and present.isdisjoint(rule.names):
                    continue
                for m in pattern.finditer(line):
                    if not starts:
                        starts = list(accumulate((len(w) + 1 for w in words[:-1]), initial=1))
                    first = bisect_left(starts, m.start())
                    found.append(Detection(rule.label, first, first + m[1].count(" "), rule.priority, rule.confidence))
        return len(words), found


def resolve(found: list[Detection]) -> list[Detection]:
    """Drop each detection that lies inside one of better priority, or of the same priority and longer."""
    kept: list[Detection] = []
    firsts: list[int] = []  # the kept intervals that lie in no other one; their ends ascend with their starts
    lasts: list[int] = []
    for d in sorted(set(found), key=lambda d: (d.priority, d.first - d.last, d.first, d.label)):
        at = bisect_right(firsts, d.first) - 1
        inside = at >= 0 and lasts[at] >= d.last
        if d.priority == 0 or not inside:
            kept.append(d)
        if not inside:
            a, b = bisect_left(firsts, d.first), bisect_right(lasts, d.last)
            firsts[a:b], lasts[a:b] = [d.first], [d.last]
    return sorted(kept, key=lambda d: (d.first, d.last, d.label))


@lru_cache(maxsize=1)
def _default() -> Scanner:
    return Scanner(default_rules())


def scan_text(text: bytes) -> tuple[int, list[Detection], list[Detection]]:
    """Number of words, places of the phrases, and the detections that stay."""
    n, found = _default().all_matches(text)
    return n, [d for d in found if d.priority == 0], resolve(found)


def scan(docs: DataFrame) -> DataFrame:
    """Words, places and labels of the phrases, the labels of all detections that stay, the best confidence, and their number."""

    def work(texts: list[bytes]) -> dict:
        out: dict = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections")}
        for t in texts:
            n, base, kept = scan_text(t)
            out["n_words"].append(n)
            out["n_base"].append(len(base))
            out["first_word"].append(min((d.first for d in base), default=None))
            out["last_word"].append(max((d.first for d in base), default=None))
            out["base_labels"].append(",".join(sorted({d.label for d in base})))
            out["labels"].append(",".join(sorted({d.label for d in kept})))
            out["score"].append(max((d.confidence for d in kept), default=0.0))
            out["n_detections"].append(len(kept))
        return out

    return map_texts(docs, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections int", work)
