"""License scans by ordered signature rules, in Spark SQL expressions only.

A text's ASCII letters are lowered and every run of other than word characters becomes one space, so
signatures are patterns over words. A text's words are cut once and held against the rules' keywords; only a text that
has one is looked at, and a rule runs only where one of its keywords is. Keywords are made from the rules' own patterns, so they lose nothing. Each match is an interval of words. Rules are ordered by tier: a match
whose interval lies within that of a match of the same or an earlier tier is dropped (equal ones: the
first in tier and label stays), so "cc by" inside "cc by nc" says nothing. The base phrases always
stay. There's no shuffle: every document is handled in its own row.

Null text: empty. Texts without words or matches: no labels, null places, score 0. Null and repeated ids pass
through, repeated rows are scanned each. Columns beyond id and text aren't read, whatever their names. A very long text is one
row; a rule takes time in proportion to its length, and so does the sweep over its matches, in blocks of `BLOCK`, but for
looking up the largest ends of the blocks before each. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that are always found, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label -> pattern of its names among words. Each makes a rule with every form below.
NAMES = {
    "mit": "(?:mit|expat|mit expat)",
    "mit-0": "mit (?:0|no attribution)",
    "x11": "x11",
    "isc": "isc",
    "apache-2": "apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?",
    "apache-1.1": "apache(?: software)?(?: license)?(?: version)? v?1 1",
    "bsd-2-clause": "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd)",
    "bsd-3-clause": "(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd|three clause bsd)",
    "bsd-4-clause": "(?:bsd 4 clause|4 clause bsd|original bsd)",
    "bsd": "bsd",
    "gpl-3": "(?:gnu )?(?:gpl|general public licen[sc]e(?: gpl)?)(?: version)? v?3(?: 0)?(?: or later)?",
    "gpl-2": "(?:gnu )?(?:gpl|general public licen[sc]e(?: gpl)?)(?: version)? v?2(?: 0)?(?: or later)?",
    "gpl": "(?:gnu (?:gpl|general public licen[sc]e)|gpl)",
    "lgpl-3": "(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version)? v?3(?: 0)?(?: or later)?",
    "lgpl-2.1": "(?:gnu )?(?:lgpl|lesser general public licen[sc]e)(?: version)? v?2 1(?: or later)?",
    "lgpl": "(?:gnu )?(?:lgpl|lesser general public licen[sc]e)",
    "agpl-3": "(?:gnu )?(?:agpl|affero general public licen[sc]e)(?: version)?(?: v?3(?: 0)?)?(?: or later)?",
    "gfdl": "(?:gnu )?(?:gfdl|fdl|free documentation licen[sc]e)(?: version)?(?: v?1 [123])?",
    "mpl-2": "(?:mpl|mozilla public licen[sc]e)(?: version)? v?2(?: 0)?",
    "mpl-1.1": "(?:mpl|mozilla public licen[sc]e)(?: version)? v?1 1",
    "epl-2": "(?:epl|eclipse public licen[sc]e)(?: version)? v?2(?: 0)?",
    "epl-1": "(?:epl|eclipse public licen[sc]e)(?: version)? v?1(?: 0)?",
    "eupl-1.2": "(?:eupl|european union public licen[sc]e)(?: version)? v?1 2",
    "cddl-1": "(?:cddl|common development and distribution licen[sc]e cddl)(?: version)?(?: v?1(?: [01])?)?",
    "cpl-1": "common public licen[sc]e(?: version)?(?: v?1(?: 0)?)?",
    "artistic-2": "artistic(?: license)?(?: version)? v?2(?: 0)?",
    "artistic": "artistic",
    "bsl-1": "boost software(?: license)?(?: version)?(?: v?1(?: 0)?)?",
    "busl-1.1": "business source(?: license)?(?: version)?(?: v?1 1)?",
    "zlib": "(?:zlib|zlib libpng)",
    "unlicense": "unlicense",
    "wtfpl": "wtfpl(?: version)?(?: v?2)?",
    "postgresql": "postgresql",
    "python-2": "(?:python software foundation|psf)(?: license)?(?: version)?(?: v?2(?: 0)?)?",
    "php-3": "php(?: license)?(?: version)? v?3(?: 0[01]?)?",
    "ofl-1.1": "(?:sil )?open font(?: license)?(?: version)?(?: v?1 1)?",
    "odbl-1": "(?:open data commons )?open database(?: license)?(?: v?1(?: 0)?)?",
    "odc-by-1": "open data commons attribution(?: license)?(?: v?1(?: 0)?)?",
    "cc0-1": "(?:creative commons )?cc0(?: v?1(?: 0)?)?(?: universal)?",
    "cc-by": "cc by(?: [1-4](?: [05])?)?",
    "cc-by-sa": "cc by sa(?: [1-4](?: [05])?)?",
    "cc-by-nd": "cc by nd(?: [1-4](?: [05])?)?",
    "cc-by-nc": "cc by nc(?: [1-4](?: [05])?)?",
    "cc-by-nc-sa": "cc by nc sa(?: [1-4](?: [05])?)?",
    "cc-by-nc-nd": "cc by nc nd(?: [1-4](?: [05])?)?",
}
#: More licenses by name.
MORE_NAMES = {
    "0bsd": "(?:0bsd|zero clause bsd|bsd zero clause|bsd 0 clause)",
    "afl-3": "(?:academic free licen[sc]e|afl)(?: version)? v?3(?: 0)?",
    "apl-1": "adaptive public licen[sc]e(?: version)?(?: v?1(?: 0)?)?",
    "apsl-2": "apple public source licen[sc]e(?: version)?(?: v?2(?: 0)?)?",
    "blueoak-1": "blue oak model(?: licen[sc]e)?(?: version)?(?: v?1(?: 0 0)?)?",
    "bsd-3-clause-clear": "clear bsd",
    "bsd-3-clause-lbnl": "lawrence berkeley national labs bsd",
    "cecill-2.1": "cecill(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: version)?(?: v?2 1)?",
    "cern-ohl-2": "cern open hardware licen[sc]e(?: version)?(?: v?2)?",
    "ecl-2": "educational community licen[sc]e(?: version)?(?: v?2(?: 0)?)?",
    "efl-2": "eiffel forum licen[sc]e(?: version)?(?: v?2)?",
    "elastic-2": "elastic licen[sc]e(?: version)? v?2(?: 0)?",
    "fair": "fair license",
    "ftl": "freetype(?: project)? license",
    "hpnd": "historical permission notice and disclaimer",
    "icu": "icu license",
    "ijg": "independent jpeg group(?: license)?",
    "ipl-1": "ibm public licen[sc]e(?: version)?(?: v?1(?: 0)?)?",
    "lppl-1.3": "latex project public licen[sc]e(?: version)?(?: v?1 3[ac]?)?",
    "mit-cmu": "cmu license",
    "ms-pl": "microsoft public licen[sc]e",
    "ms-rl": "microsoft reciprocal licen[sc]e",
    "mulan-2": "mulan(?: permissive software)?(?: licen[sc]e)?(?: version)?(?: v?2)?",
    "ncsa": "(?:university of illinois )?ncsa(?: open source)?",
    "npl-1.1": "netscape public licen[sc]e(?: version)?(?: v?1 1)?",
    "oldap-2.8": "openldap(?: public)?(?: licen[sc]e)?(?: version)?(?: v?2 8)?",
    "openssl": "openssl",
    "osl-3": "(?:open software licen[sc]e|osl)(?: version)? v?3(?: 0)?",
    "pddl-1": "public domain dedication and licen[sc]e(?: version)?(?: v?1(?: 0)?)?",
    "qpl-1": "q public licen[sc]e(?: version)?(?: v?1(?: 0)?)?",
    "rpl-1.5": "reciprocal public licen[sc]e(?: version)?(?: v?1 5)?",
    "ruby": "ruby license",
    "sleepycat": "sleepycat",
    "spl-1": "sun public licen[sc]e(?: version)?(?: v?1(?: 0)?)?",
    "sspl-1": "(?:server side public licen[sc]e|sspl)(?: version)?(?: v?1)?",
    "tcl": "tcl(?: tk)? license",
    "unicode": "unicode(?: terms of use| license agreement)",
    "upl-1": "universal permissive licen[sc]e(?: version)?(?: v?1(?: 0)?)?",
    "vim": "vim license",
    "w3c": "w3c software(?: notice)?(?: and)?(?: document)?(?: licen[sc]e)?",
    "zpl-2.1": "zope public licen[sc]e(?: version)?(?: v?2 1)?",
}
NAMES |= MORE_NAMES
#: Creative Commons licenses written out, by the words for their terms.
LONG_NAMES = {
    "cc-by": "attribution",
    "cc-by-sa": "attribution share ?alike",
    "cc-by-nd": "attribution no ?deriv(?:ative)?s?",
    "cc-by-nc": "attribution non ?commercial",
    "cc-by-nc-sa": "attribution non ?commercial share ?alike",
    "cc-by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
VERBS = "(?:licen[sc]ed|released|distributed|redistributed|available|published|provided|shared|offered|covered) under"
#: Tier -> (confidence, the pattern around a name). Earlier tiers go first.
FORMS = {
    1: (1.0, "spdx license identifier {}"),
    2: (0.95, VERBS + " (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: (?:public )?licen[sc]e)?"),
    3: (0.85, "under (?:the )?(?:terms of (?:the )?)?{} licen[sc]e"),
    4: (0.7, "(?:{0} licen[sc]e|licen[sc]e (?:is |type )?{0})"),
}
#: Names that stand for a license without any word around them, and the confidence then.
ALONE = {"gpl-3", "gpl-2", "lgpl-3", "lgpl-2.1", "agpl-3", "apache-2", "mpl-2", "bsd-2-clause", "bsd-3-clause", "cc0-1", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd", "unlicense", "wtfpl"}
ALONE_CONFIDENCE = 0.5
#: Signatures of licenses' own texts and notices: (tier, confidence, label, pattern).
OTHERS = [
    (2, 0.9, "public-domain", "(?:dedicated to|released (?:in)?to|placed in|in) the public domain"),
    (2, 0.9, "public-domain", "has waived all copyright and related or neighboring rights"),
    (2, 0.9, "public-domain", "no copyright is claimed"),
    (2, 0.9, "proprietary", "all rights reserved"),
    (2, 0.9, "proprietary", "proprietary and confidential"),
    (2, 0.9, "proprietary", "(?:contains|constitutes) (?:the )?(?:valuable )?trade secrets? (?:of|and)"),
    (2, 0.9, "proprietary", "unauthorized copying of this (?:file|work|document)"),
    (2, 0.9, "proprietary", "may not be reproduced (?:or transmitted )?without prior written permission"),
    (2, 0.9, "proprietary", "for internal use only"),
    (2, 0.9, "mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    (2, 0.9, "mit", "to deal in the software without restriction including without limitation the rights"),
    (2, 0.9, "mit", "shall be included in all copies or substantial portions of the software"),
    (2, 0.9, "mit", "the software is provided as is without warranty of any kind express or implied"),
    (2, 0.9, "isc", "permission to use copy modify and or distribute this software"),
    (2, 0.9, "isc", "the software is provided as is and the author disclaims all warranties"),
    (2, 0.9, "bsd", "redistribution and use in source and binary forms"),
    (2, 0.9, "bsd", "redistributions of source code must retain the above copyright notice"),
    (2, 0.9, "bsd", "redistributions in binary form must reproduce the above copyright notice"),
    (2, 0.9, "bsd-3-clause", "may be used to endorse or promote products derived from this software"),
    (2, 0.9, "bsd-4-clause", "all advertising materials mentioning features or use of this software"),
    (2, 0.9, "bsd", "this software is provided by the copyright holders and contributors as is"),
    (2, 0.9, "zlib", "provided as is without any express or implied warranty"),
    (2, 0.9, "zlib", "altered source versions must be plainly marked as such"),
    (2, 0.9, "zlib", "the origin of this software must not be misrepresented"),
    (2, 0.9, "wtfpl", "do what the fuck you want to public license"),
    (2, 0.9, "unlicense", "free and unencumbered software released into the public domain"),
    (2, 0.9, "unlicense", "please refer to (?:http|https) unlicense org"),
    (2, 0.9, "apache-2", "www apache org licenses license 2 0"),
    (2, 0.9, "apache-2", "you may not use this file except in compliance with the license"),
    (2, 0.9, "apache-2", "see the license for the specific language governing permissions and limitations"),
    (2, 0.9, "apache-2", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    (2, 0.9, "apache-2", "terms and conditions for use reproduction and distribution"),
    (2, 0.9, "apache-1.1", "this product includes software developed by the apache software foundation"),
    (2, 0.9, "gpl", "terms of the gnu general public licen[sc]e as published by the free software foundation"),
    (2, 0.9, "gpl-2", "either version 2 of the licen[sc]e or at your option any later version"),
    (2, 0.9, "gpl-3", "either version 3 of the licen[sc]e or at your option any later version"),
    (2, 0.9, "gpl", "you should have received a copy of the gnu general public licen[sc]e"),
    (2, 0.9, "lgpl", "you should have received a copy of the gnu lesser general public licen[sc]e"),
    (2, 0.9, "agpl-3", "you should have received a copy of the gnu affero general public licen[sc]e"),
    (2, 0.9, "gpl", "is free software you can redistribute it and or modify it"),
    (2, 0.9, "gpl", "designed to take away your freedom to share and change it"),
    (2, 0.9, "gpl", "www gnu org licenses gpl(?: 2 0| 3 0)?"),
    (2, 0.9, "lgpl", "www gnu org licenses lgpl(?: 2 1| 3 0)?"),
    (2, 0.9, "agpl-3", "www gnu org licenses agpl(?: 3 0)?"),
    (2, 0.9, "lgpl", "gnu library general public licen[sc]e"),
    (2, 0.9, "gfdl", "with no invariant sections(?: no front cover texts)?(?: and no back cover texts)?"),
    (2, 0.9, "gfdl", "www gnu org licenses fdl(?: 1 3)?"),
    (2, 0.9, "mpl-2", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    (2, 0.9, "mpl-2", "mozilla org mpl 2 0"),
    (2, 0.9, "mpl-1.1", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    (2, 0.9, "epl-2", "www eclipse org legal epl 2 0"),
    (2, 0.9, "epl-1", "www eclipse org legal epl v10"),
    (2, 0.9, "epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0"),
    (2, 0.9, "eupl-1.2", "joinup ec europa eu (?:software page|collection) eupl"),
    (2, 0.9, "cddl-1", "common development and distribution licen[sc]e"),
    (2, 0.9, "cc0-1", "creativecommons org publicdomain zero 1 0"),
    (2, 0.9, "cc0-1", "no rights reserved"),
    (2, 0.9, "public-domain", "creativecommons org publicdomain mark 1 0"),
    (2, 0.9, "cc-by", "creativecommons org licenses by [1-4] [05]"),
    (2, 0.9, "cc-by-sa", "creativecommons org licenses by sa [1-4] [05]"),
    (2, 0.9, "cc-by-nd", "creativecommons org licenses by nd [1-4] [05]"),
    (2, 0.9, "cc-by-nc", "creativecommons org licenses by nc [1-4] [05]"),
    (2, 0.9, "cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] [05]"),
    (2, 0.9, "cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] [05]"),
    (3, 0.85, "cc-by", "you are free to share copy and redistribute the material in any medium or format"),
    (3, 0.85, "cc-by-nc", "noncommercial you may not use the material for commercial purposes"),
    (3, 0.85, "cc-by-sa", "sharealike if you remix transform or build upon the material"),
    (3, 0.85, "cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    (2, 0.9, "ofl-1.1", "with reserved font names?"),
    (2, 0.9, "ofl-1.1", "scripts sil org ofl"),
    (2, 0.9, "bsl-1", "www boost org license 1 0(?: txt)?"),
    (2, 0.9, "bsl-1", "machine executable object code generated by a source language processor"),
    (2, 0.9, "busl-1.1", "change license apache"),
    (2, 0.9, "postgresql", "without fee and without a written agreement is hereby granted"),
    (2, 0.9, "python-2", "psf hereby grants licensee a nonexclusive royalty free"),
    (2, 0.9, "php-3", "this product includes php software freely available from"),
    (2, 0.9, "openssl", "developed by the openssl project for use in the openssl toolkit"),
    (2, 0.9, "openssl", "this product includes cryptographic software written by eric young"),
    (2, 0.9, "ncsa", "to deal with the software without restriction"),
    (2, 0.9, "w3c", "www w3 org consortium legal"),
    (2, 0.9, "hpnd", "for any purpose and without fee is hereby granted provided that the above copyright notice"),
    (2, 0.9, "x11", "except as contained in this notice the name of the x consortium shall not be used"),
    (2, 0.9, "artistic", "the artistic license preamble"),
    (2, 0.9, "artistic-2", "you may distribute (?:verbatim copies of )?the source form of the standard version"),
    (2, 0.9, "elastic-2", "provide the software to third parties as a hosted or managed service"),
    (2, 0.9, "sspl-1", "make the functionality of the program (?:or a modified version )?available to third parties as a service"),
    (2, 0.9, "commons-clause", "commons clause (?:license condition|restriction)"),
    (2, 0.9, "json", "the software shall be used for good not evil"),
    (2, 0.9, "beerware", "you can buy me a beer in return"),
    (2, 0.9, "odbl-1", "opendatacommons org licenses odbl(?: 1 0)?"),
    (2, 0.9, "odc-by-1", "opendatacommons org licenses by(?: 1 0)?"),
    (2, 0.9, "pddl-1", "opendatacommons org licenses pddl(?: 1 0)?"),
    (2, 0.9, "ogl-uk-3", "open government licen[sc]e(?: v?3(?: 0)?)?"),
    (2, 0.9, "openrail", "open responsible ai licen[sc]e"),
    (2, 0.9, "llama-community", "llama [2-4](?: [0-9])? community license(?: agreement)?"),
    (2, 0.9, "gemma", "gemma terms of use"),
    (2, 0.9, "nasa-1.3", "nasa open source agreement(?: version)?(?: v?1 3)?"),
    (2, 0.9, "cdla-permissive-2", "community data license agreement permissive(?: version)?(?: v?2(?: 0)?)?"),
    (2, 0.9, "cdla-sharing-1", "community data license agreement sharing(?: version)?(?: v?1(?: 0)?)?"),
]
#: Words that many texts have: no keyword, if a phrase has another word.
COMMON = {"a", "all", "any", "be", "by", "code", "commons", "copy", "free", "general", "in", "is", "it", "license", "licence", "licenses", "may", "no", "not", "of", "open", "or", "permission", "public", "software", "source", "terms", "that", "the", "this", "to", "under", "use", "version", "with", "work", "you", "your"}
#: Matches in a block of the sweep.
BLOCK = 64
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def phrases(pattern: str) -> set[str]:
    """All texts that a pattern matches; the rules' patterns have no open repeats, so there are few."""

    def made(parsed) -> set[str]:
        out = {""}
        for op, value in parsed:
            kind = str(op)
            if kind == "LITERAL":
                some = {chr(value)}
            elif kind == "IN":
                some = {chr(c) for k, v in value for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else [v])}
            elif kind == "BRANCH":
                some = set().union(*map(made, value[1]))
            elif kind == "SUBPATTERN":
                some = made(value[3])
            elif kind == "MAX_REPEAT" and value[:2] == (0, 1):
                some = made(value[2]) | {""}
            else:
                raise ValueError(f"{kind} in {pattern}")
            out = {x + y for x in out for y in some}
        return out

    return made(re._parser.parse(pattern))


def keywords(pattern: str) -> list[str]:
    """Words of which every text that the pattern matches has one: the first longest of each that isn't common, if it has such a word."""
    return sorted({max(p.split(), key=lambda w: (w not in COMMON, len(w))) for p in phrases(pattern)})


def rules() -> list[tuple[int, float, str, list[str], str]]:
    """(tier, confidence, label, keywords, pattern): every name in every form, and the rest."""
    out = []
    of_names = {label: keywords(name) for label, name in NAMES.items()}
    for tier, (confidence, form) in FORMS.items():
        for label, name in NAMES.items():
            out.append((tier, confidence, label, of_names[label], form.format(name)))
    for label, name in NAMES.items():
        if label in ALONE:
            out.append((5, ALONE_CONFIDENCE, label, of_names[label], name))
    for label, terms in LONG_NAMES.items():
        out.append((2, 0.9, label, ["commons"], f"creative commons {terms}(?: [1-4](?: [05])?)?(?: international| unported)?(?: licen[sc]e)?"))
    return out + [(tier, confidence, label, keywords(pattern), pattern) for tier, confidence, label, pattern in OTHERS]


def gate() -> list[str]:
    """Words of which a text must have one before it is looked at: all keywords, and one word of each base phrase."""
    return sorted({k for _, _, _, keys, _ in rules() for k in keys} | {k for p in BASE for k in keywords(p)})


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(text: str, pattern: str) -> str:
    """SQL: the intervals of words [s, e) of each match of ' pattern(?= )' in words that are led and followed by one space.

    Matches are set between two control characters, which words can't hold; cut at spaces, a word's place then is its
    number, and the characters hang on the last word before a match and on the match's last one."""
    at = lambda sign: f"filter(transform(w, (x, i) -> if(contains(x, '{sign}'), i, -1)), i -> i >= 0)"
    found = f"transform(array(split(r, ' ')), w -> zip_with({at(chr(1))}, {at(chr(2))}, (s, e) -> named_struct('s', s, 'e', e)))[0]"
    return f"transform(array(regexp_replace({text}, {pattern}, '{chr(1)}$0{chr(2)}')), r -> if(contains(r, '{chr(1)}'), {found}, cast(array() AS array<struct<s:int,e:int>>)))[0]"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, base (array of label, s, e) and found (array of tier, confidence, label, s, e): the
    intervals of words of the base phrases and of the other rules' matches that stay."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    raw = F.coalesce(F.col(text), F.lit(""))
    spaced = lambda x: F.regexp_replace(F.concat(F.lit(" "), x, F.lit(" ")), BETWEEN, " ")
    strings = lambda values: f"array({', '.join(map(_text, values))})"
    found_rules = rules()
    table = "array(" + ", ".join(f"named_struct('t', {t}, 'c', {c}D, 'l', {_text(label)}, 'k', {strings(keys)}, 'p', {_text(f' {p}(?= )')})" for t, c, label, keys, p in found_rules) + ")"
    base = "array(" + ", ".join(f"named_struct('l', {_text(label)}, 'p', {_text(f' {p}(?= )')})" for p, label in BASE.items()) + ")"
    matches = f"""flatten(transform(filter({table}, r -> arrays_overlap(r.k, held)), r -> transform({_places("words", "r.p")}, m -> named_struct('s', m.s, 'e', -m.e, 't', r.t, 'l', r.l, 'c', r.c))))"""
    best = [f"a.m{k}" for k in range(1, 6)]
    within = " OR ".join(f"(x.t >= {k} AND {m} >= -x.e)" for k, m in enumerate(best, 1))
    kept = "array<struct<tier:int,confidence:double,label:string,s:int,e:int>>"
    one = "named_struct('tier', x.t, 'confidence', x.c, 'label', x.l, 's', x.s, 'e', -x.e)"
    # A fold copies its state at every step, so it must stay small: matches are swept in blocks, each from the ends that those before it reached.
    ends = ", ".join(f"'m{k}', coalesce(array_max(slice(tops[{k - 1}], 1, n)), -1)" for k in range(1, 6))
    block = f"""aggregate(b, named_struct({ends}, 'out', cast(array() AS {kept})),
      (a, x) -> named_struct({", ".join(f"'m{k}', if(x.t = {k}, greatest(a.m{k}, -x.e), a.m{k})" for k in range(1, 6))}, 'out', if({within}, a.out, array_append(a.out, {one}))),
      a -> a.out)"""
    tops = "transform(array(1, 2, 3, 4, 5), k -> transform(cut, b -> coalesce(array_max(transform(filter(b, x -> x.t = k), x -> -x.e)), -1)))"
    cuts = f"transform(sequence(0, (size(z) - 1) div {BLOCK}), n -> slice(z, int(n) * {BLOCK} + 1, {BLOCK}))"
    sweep = f"transform(array(array_sort({matches})), z -> transform(array({cuts}), cut -> transform(array({tops}), tops -> flatten(transform(cut, (b, n) -> {block})))[0])[0])[0]"
    found_base = f"flatten(transform({base}, r -> transform({_places('words', 'r.p')}, m -> named_struct('label', r.l, 's', m.s, 'e', m.e))))"
    # The lower case of all letters, not of A-Z alone, has the same words and all that those have: enough to count and to gate.
    cut = docs.select("doc_id", raw.alias("raw"), F.split(spaced(F.lower(raw)), " ").alias("cut"))
    held = cut.select("doc_id", "raw", F.greatest(F.size("cut") - 2, F.lit(0)).cast("long").alias("n_words"), F.expr(f"array_intersect(cut, {strings(gate())})").alias("held"))
    gated = held.select("doc_id", "n_words", "held", F.when(F.size("held") > 0, spaced(F.translate("raw", upper, lower))).alias("words"))
    return gated.select("doc_id", "n_words", F.expr(f"if(words IS NULL, cast(array() AS array<struct<label:string,s:int,e:int>>), {found_base})").alias("base"), F.expr(f"if(words IS NULL, cast(array() AS array<struct<tier:int,confidence:double,label:string,s:int,e:int>>), {sweep})").alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found."""
    out = scan(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.expr("cast(array_min(transform(base, m -> m.s)) AS long)").alias("first_word"),
        F.expr("cast(array_max(transform(base, m -> m.s)) AS long)").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(base.label)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(base.label, found.label))), ',')").alias("labels"),
        F.expr("if(size(base) > 0, 1.0D, coalesce(array_max(found.confidence), 0.0D))").alias("score"),
        F.size("found").cast("long").alias("n_found"),
    )
