"""License scans: prioritised signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import any_of, let

#: Words of the base count, after lower-casing A-Z; and their pattern before it.
BASE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE_PHRASES = {"mit": ("mit", "license"), "apache": ("apache", "license"), "gpl": ("general", "public", "license")}

#: What a blank of a pattern takes: a run of white space and of the marks that comments, quotes and boxes put around line ends.
MARKS = r"\s\u00a0*#/;%>|!\"'\\.-"
GAP = rf"[*\"'\\/#]*+[\s\u00a0][{MARKS}]*+(?:(?:dnl|rem)\s[{MARKS}]*+)?+"
#: Label, what every match of the name holds, the license's name as a pattern, its SPDX identifier.
LICENSES = (
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.1", "apache-1.1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?", "apache-2.0"),
    ("mit", "mit", r"mit licen[sc]e", "mit"),
    ("mit", "expat", r"expat licen[sc]e", "mit"),
    ("mit-0", "no attribution", r"mit no attribution(?: licen[sc]e)?", "mit-0"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2[- ]clause|2[- ]clause bsd|freebsd)(?: licen[sc]e)?", "bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|revised bsd|modified bsd|bsd 3[- ]clause|3[- ]clause bsd)(?: licen[sc]e)?", "bsd-3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4[- ]clause|4[- ]clause bsd)(?: licen[sc]e)?", "bsd-4-clause"),
    ("0bsd", "bsd", r"(?:zero[- ]clause bsd|bsd zero[- ]clause)(?: licen[sc]e)?", "0bsd"),
    ("isc", "isc", r"isc licen[sc]e", "isc"),
    ("gpl-2.0", "general public", r"gnu general public licen[sc]e,? (?:version |v\.? ?)2(?:\.0)?", "gpl-2.0(?:-only|-or-later)?"),
    ("gpl-3.0", "general public", r"gnu general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?", "gpl-3.0(?:-only|-or-later)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[sc]e,? (?:version |v\.? ?)2\.1", "lgpl-2.1(?:-only|-or-later)?"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?", "lgpl-3.0(?:-only|-or-later)?"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[sc]e,? (?:version |v\.? ?)3(?:\.0)?", "agpl-3.0(?:-only|-or-later)?"),
    ("gfdl-1.3", "free documentation", r"gnu free documentation licen[sc]e(?:,? (?:version |v\.? ?)1\.[0-3])?", "gfdl-1.3(?:-only|-or-later)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e,? (?:version |v\.? ?)?1\.1", "mpl-1.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?", "mpl-2.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e,? (?:version |v\.? ?)?1(?:\.0)?", "epl-1.0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?", "epl-2.0"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?", "cddl-1.0"),
    ("eupl-1.2", "european union public", r"european union public licen[sc]e(?:,? (?:version |v\.? ?)?1\.2)?", "eupl-1.2"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?", "artistic-2.0"),
    ("boost-1.0", "boost", r"boost software licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?", "bsl-1.0"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", "zlib"),
    ("unlicense", "unlicense", r"the unlicense", "unlicense"),
    ("wtfpl", "you want to public", r"do what the f\w+ you want to public licen[sc]e", "wtfpl"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("python-2.0", "python software", r"python software foundation licen[sc]e(?:,? (?:version |v\.? ?)?2)?", "psf-2.0|python-2.0"),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl"),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?", "odbl-1.0"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)?", "ofl-1.1"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", "ms-pl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", "cc0-1.0"),
)
#: The Creative Commons licenses are a rule: each set of terms in each version.
CC_TERMS = {"by": "attribution", "by-sa": "attribution[- ]sharealike", "by-nd": "attribution[- ]noderiv(?:ative)?s", "by-nc": "attribution[- ]noncommercial", "by-nc-sa": "attribution[- ]noncommercial[- ]sharealike", "by-nc-nd": "attribution[- ]noncommercial[- ]noderiv(?:ative)?s"}
CC_VERSIONS = ("2.0", "2.5", "3.0", "4.0")
#: Short names: label, keyword, pattern, whether the name tells a license also where nothing is said to be under it.
_V = r"(?:,? (?:version |v\.? ?)|-?v\.?|[-\t\x20]{0,3}(?=\d)| (?=\d\.\d))"
_END = r"(?:\+|-only|-or-later)?(?!\.\d)"
SHORT = (
    ("gpl-2.0", "gpl", rf"(?<![\w-])(?:gnu )?gpl{_V}2(?:\.0)?{_END}", True),
    ("gpl-3.0", "gpl", rf"(?<![\w-])(?:gnu )?gpl{_V}3(?:\.0)?{_END}", True),
    ("lgpl-2.1", "lgpl", rf"(?<![\w-])(?:gnu )?lgpl{_V}2\.1{_END}", True),
    ("lgpl-3.0", "lgpl", rf"(?<![\w-])(?:gnu )?lgpl{_V}3(?:\.0)?{_END}", True),
    ("agpl-3.0", "agpl", rf"(?<![\w-])(?:gnu )?agpl{_V}3(?:\.0)?{_END}", True),
    ("gfdl-1.3", "gfdl", rf"(?<![\w-])(?:gnu )?gfdl{_V}1\.[0-3]{_END}", True),
    ("cddl-1.0", "cddl", rf"(?<![\w-])cddl{_V}1\.0(?!\.\d)", True),
    ("eupl-1.2", "eupl", rf"(?<![\w-])eupl{_V}1\.2(?!\.\d)", True),
    ("odbl-1.0", "odbl", rf"(?<![\w-])odbl{_V}1\.0(?!\.\d)", True),
    ("wtfpl", "wtfpl", r"(?<![\w-])wtfpl", True),
    ("mpl-1.1", "mpl", rf"(?<![\w-])mpl{_V}1\.1(?!\.\d)", True),
    ("mpl-2.0", "mpl", rf"(?<![\w-])mpl{_V}2(?:\.0)?(?!\.\d)", True),
    ("epl-1.0", "epl", rf"(?<![\w-])epl{_V}1(?:\.0)?(?!\.\d)", False),
    ("epl-2.0", "epl", rf"(?<![\w-])epl{_V}2(?:\.0)?(?!\.\d)", False),
    ("ofl-1.1", "ofl", rf"(?<![\w-])ofl{_V}1\.1(?!\.\d)", False),
    ("apache-1.1", "apache", rf"(?<![\w-])apache{_V}1\.1(?!\.\d)", False),
    ("apache-2.0", "apache", rf"(?<![\w-])apache{_V}2(?:\.0)?(?!\.\d)", False),
    ("apache-2.0", "asl", rf"(?<![\w-])asl{_V}2(?:\.0)?(?!\.\d)", False),
    ("bsd-2-clause", "bsd-2-clause", r"(?<![\w-])bsd-2-clause", True),
    ("bsd-3-clause", "bsd-3-clause", r"(?<![\w-])bsd-3-clause", True),
    ("bsd-4-clause", "bsd-4-clause", r"(?<![\w-])bsd-4-clause", True),
    ("0bsd", "0bsd", r"(?<![\w-])0bsd", True),
    ("mit", "mit", r"(?<![\w-])mit(?= ?(?:[.,;:)\]/]|$|or |and |terms))", False),
    ("isc", "isc", r"(?<![\w-])isc(?= ?(?:[.,;:)\]/]|$|or |and |terms))", False),
)
#: Forms of a short name that does not stand alone.
UNDER, NAMED, BARE = 1, 2, 7
#: How a license is spoken of, most telling first; {name} and {spdx} are filled in. Priority, what every match holds beside the keyword, pattern.
FORMS = (
    (5, "spdx", r"spdx-license-identifier: ?(?:{spdx})(?![\w.-])"),
    (4, "under", r"(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}(?![\w-])"),
    (3, "licen", r"licen[sc]e: ?(?:the )?{name}(?![\w-])"),
    (3, "licen", r"licen[sc]e: ?(?:{spdx})(?![\w.-])"),
    (4, "licen", r"licen[sc]e[\"']? ?[:=] ?[\"'](?:{spdx})[\"']"),
    (3, "copy of the", r"copy of the {name}(?![\w-])"),
    (3, "see the", r"see the {name}(?![\w-])"),
    (2, "", r"{name}(?![\w-])"),
)
#: Families named without a version, and grants of rights that name no license.
GENERIC = (
    ("apache", 1, "apache", r"apache (?:software )?licen[sc]e"),
    ("gpl", 1, "general public", r"(?:gnu )?general public licen[sc]e"),
    ("lgpl", 1, "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("agpl", 1, "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("gpl", 1, "gpl", r"(?<![\w-])(?:gnu )?gpl(?![\w-])"),
    ("lgpl", 1, "lgpl", r"(?<![\w-])(?:gnu )?lgpl(?![\w-])"),
    ("agpl", 1, "agpl", r"(?<![\w-])(?:gnu )?agpl(?![\w-])"),
    ("mpl", 1, "mozilla", r"mozilla public licen[sc]e"),
    ("bsd", 1, "bsd", r"bsd licen[sc]e"),
    ("creative-commons", 1, "creative commons", r"creative commons licen[sc]e"),
    ("public-domain", 1, "public domain", r"(?:released|dedicated|placed) (?:in)?to the public domain"),
    ("mit", 3, "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("bsd", 3, "redistribution and use", r"redistribution and use in source and binary forms"),
    ("proprietary", 1, "all rights reserved", r"all rights reserved"),
)


#: Sentences of license texts and of the notices that refer to them, addresses of licenses, and words that keep or give up rights. Label, priority, keywords, pattern.
_FSF = r"as published by the free software foundation[;,:]? (?:either )?version"
SIGNATURES = (
    ("mit", 3, "permission notice substantial", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software"),
    ("mit", 3, "granted without restriction", r"is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the software[\"']?\), to deal in the software without restriction"),
    ("x11", 3, "contained except notice", r"except as contained in this notice, the names?"),
    ("json", 4, "evil good", r"the software shall be used for good, not evil"),
    ("isc", 3, "fee is hereby granted", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", 3, "fee is hereby granted", r"permission to use, copy, modify,? and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("ntp", 3, "fee is hereby granted", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("postgresql", 3, "granted agreement written", r"and without a written agreement is hereby granted"),
    ("bsd", 2, "redistributions source", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", 2, "redistributions binary", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd", 2, "express implied warranties", r"as is[\"']? and any express or implied warranties, including"),
    ("bsd-3-clause", 3, "contributors endorse", r"nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 3, "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", 4, "apache licen", r"licensed under the apache license, version 2\.0 \(the license[\"']?\)"),
    ("apache-2.0", 3, "except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", 3, "agreed in writing", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is[\"']? basis"),
    ("apache-2.0", 3, "contributor licen", r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache-2.0", 4, "apache osi licen", r"license :: osi approved :: apache software license"),
    ("apache-1.1", 3, "apache product includes", r"this product includes software developed by the apache (?:group|software foundation)"),
    ("gpl", 3, "general public licen", r"this (?:program|file|software|package|code) is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", 3, "general public licen", rf"gnu general public license {_FSF} 2"),
    ("gpl-3.0", 3, "general public licen", rf"gnu general public license {_FSF} 3"),
    ("lgpl-2.0", 3, "library general public licen", rf"gnu library general public license {_FSF} 2"),
    ("lgpl-2.1", 3, "lesser general public licen", rf"gnu lesser general public license {_FSF} 2\.1"),
    ("lgpl-3.0", 3, "lesser general public licen", rf"gnu lesser general public license {_FSF} 3"),
    ("agpl-3.0", 3, "affero general public licen", rf"gnu affero general public license {_FSF} 3"),
    ("gpl", 2, "received general public licen", r"you should have received a copy of the gnu general public license"),
    ("lgpl", 2, "received lesser public licen", r"you should have received a copy of the gnu lesser general public license"),
    ("agpl", 2, "received affero public licen", r"you should have received a copy of the gnu affero general public license"),
    ("lgpl", 3, "library lesser public licen", r"this library is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu lesser general public license"),
    ("gpl-2.0", 3, "licen freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", 3, "copyleft general public licen", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("agpl-3.0", 3, "copyleft affero public licen", r"the gnu affero general public license is a free, copyleft license for software and other kinds of works"),
    ("gfdl", 3, "free documentation licen", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("classpath-exception", 3, "statically dynamically", r"linking this library statically or dynamically with other modules"),
    ("gcc-exception", 2, "gcc runtime library exception", r"gcc runtime library exception"),
    ("mpl-2.0", 4, "mozilla public licen", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-2.0", 3, "mpl copy", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", 4, "mozilla public licen", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("epl", 3, "eclipse public licen", r"accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-1.0", 3, "eclipse public licen", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cddl", 3, "common development licen", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", 2, "common public licen", r"common public license(?: -)?(?: version| v)? 1\.0"),
    ("ipl-1.0", 2, "ibm public licen", r"ibm public license(?: version)? 1\.0"),
    ("boost-1.0", 4, "organization obtaining granted", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", 3, "liable author event", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", 3, "origin misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 2, "altered plainly marked", r"altered source versions must be plainly marked as such"),
    ("libpng", 3, "png reference library", r"the png reference library is supplied as is"),
    ("unlicense", 4, "unencumbered public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 3, "anyone compile sell", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", 3, "verbatim changing allowed", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("gnu-license-text", 2, "verbatim changing allowed", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("beerware", 3, "retain notice whatever stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0-1.0", 3, "extent possible law waived", r"to the extent possible under law, [\w\s,.'-]{1,60}? (?:has|have) waived all copyright"),
    ("cc0-1.0", 3, "person associated deed public domain", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", 3, "creativecommons publicdomain", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", 3, "creativecommons publicdomain", r"creativecommons\.org/publicdomain/mark/1\.0"),
    ("creative-commons", 2, "creative commons legal code", r"creative commons legal code"),
    ("creative-commons", 2, "creative commons attribution licen", r"this (?:work|book|document|article|content) is licensed under (?:a|the) creative commons attribution"),
    ("openssl", 3, "openssl product includes", r"this product includes software developed by the openssl project"),
    ("ssleay", 3, "cryptographic eric young", r"this product includes cryptographic software written by eric young"),
    ("python-2.0", 3, "psf python licensee", r"psf is making python available to licensee on an as is[\"']? basis"),
    ("artistic-1.0", 3, "intent package copied", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", 3, "licen package copied", r"this license establishes the terms under which a given free software package may be copied"),
    ("perl", 3, "perl terms", r"you (?:can|may) redistribute it and/or modify it under the same terms as perl(?: itself)?"),
    ("php-3.01", 3, "php licen", r"this source file is subject to version 3\.01 of the php license"),
    ("php-3.01", 3, "php product includes", r"this product includes php software, freely available from"),
    ("ofl-1.1", 4, "font open licen", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("ofl-1.1", 3, "goals open font licen", r"the goals of the open font license"),
    ("ofl-1.1", 2, "reserved font name", r"with reserved font names?"),
    ("ms-pl", 3, "governs accompanying licen", r"this license governs use of the accompanying software"),
    ("odbl-1.0", 3, "open database licen", r"is made available under the open database license"),
    ("eupl", 3, "eupl licen", r"licensed under the eupl"),
    ("afl-3.0", 2, "academic free licen", r"academic free license(?:,? version| v\.?)? ?3\.0"),
    ("osl-3.0", 2, "open software licen", r"open software license(?:,? version| v\.?)? ?3\.0"),
    ("ncsa", 3, "illinois ncsa licen", r"university of illinois/ncsa open source license"),
    ("upl-1.0", 2, "universal permissive licen", r"universal permissive license"),
    ("busl-1.1", 2, "business source licen", r"business source license(?:,? version| v\.?)? ?1\.1"),
    ("sspl-1.0", 2, "server side public licen", r"server side public license"),
    ("elastic-2.0", 2, "elastic licen", r"elastic license(?:,? version| v\.?)? ?2\.0"),
    ("commons-clause", 3, "commons clause licen", r"commons clause[\"']? license condition"),
    ("cecill", 2, "cecill licen", r"cecill(?:-b|-c)?(?: free software)? license"),
    ("vim", 2, "vim licen", r"the vim license"),
    ("apache-2.0", 4, "apache.org licen", r"apache\.org/licenses/license-2\.0"),
    ("mit", 4, "opensource.org licen", r"opensource\.org/licenses/mit(?:-license)?(?![\w-])"),
    ("bsd-3-clause", 4, "opensource.org licen", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-2-clause", 4, "opensource.org licen", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd", 3, "opensource.org licen", r"opensource\.org/licenses/bsd-license"),
    ("isc", 4, "opensource.org licen", r"opensource\.org/licenses/isc(?![\w-])"),
    ("gpl-2.0", 4, "gnu.org licen", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", 4, "gnu.org licen", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl-2.1", 4, "gnu.org licen", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", 4, "gnu.org licen", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", 4, "gnu.org licen", r"gnu\.org/licenses/agpl-3\.0"),
    ("mpl-2.0", 4, "mozilla.org mpl", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1.1", 4, "mozilla.org mpl", r"mozilla\.org/(?:en-us/)?mpl/(?:mpl-)?1\.1"),
    ("epl-1.0", 4, "eclipse.org epl", r"eclipse\.org/(?:legal|org/documents)/epl-(?:v10|1\.0)"),
    ("epl-2.0", 4, "eclipse.org epl", r"eclipse\.org/(?:legal|org/documents)/epl-(?:v20|2\.0)"),
    ("boost-1.0", 4, "boost.org", r"boost\.org/license_1_0\.txt"),
    ("ofl-1.1", 4, "sil.org ofl", r"scripts\.sil\.org/ofl"),
    ("unlicense", 4, "unlicense.org", r"unlicense\.org"),
    ("proprietary", 2, "confidential and proprietary", r"(?:strictly )?confidential and proprietary"),
    ("proprietary", 2, "unauthorized copying prohibited", r"unauthorized copying of this (?:file|software|document|work), via any medium,? is strictly prohibited"),
    ("proprietary", 2, "reproduced part", r"no part of this (?:publication|book|work|document) may be reproduced"),
    ("proprietary", 2, "permission without", r"may not be (?:copied|reproduced|redistributed|republished) without (?:the )?(?:express )?(?:prior )?(?:written )?permission"),
    ("non-commercial", 2, "commercial use only", r"for non-?commercial use only"),
    ("public-domain", 2, "public domain", r"this (?:work|file|software|code|image|document) is in the public domain"),
    ("public-domain", 2, "public domain", r"has been (?:dedicated to|placed in) the public domain"),
)


def _gapped(pattern: str) -> str:
    """`pattern` with GAP for each blank, and for each blank that is a choice of a class."""
    pattern = pattern.replace("[- ,]*", rf"[,{MARKS}]*+").replace("[- ]", f"(?:-|{GAP})").replace(" ?", f"(?:{GAP})?")
    return pattern.replace(" ", GAP)


def signature_rules() -> list[tuple[str, int, tuple[str, ...], str]]:
    """label, priority, keywords, pattern: the hand-written SIGNATURES and GENERIC, and every license in every form; every match holds all keywords.

    123 rules are written by hand, the others are the licenses' names in FORMS; about 220 of those are the Creative Commons template.
    """
    named = list(LICENSES)
    for terms, words in CC_TERMS.items():
        for v in CC_VERSIONS:
            dotted = v.replace(".", r"\.")
            named.append((f"cc-{terms}-{v}", v, rf"(?:cc[- ]{terms}|creative commons {words})[- ,]*(?:version )?{dotted}", f"cc-{terms}-{v}"))
    stem = lambda spdx: "" if "|" in spdx.split("(")[0] else re.match(r"[a-z0-9-]+", spdx)[0]  # an identifier comes without the license's name
    rules = [(label, priority, stem(spdx) if "{spdx}" in form else key, beside, form.format(name=f"(?:{name})", spdx=spdx.replace(".", r"\."))) for label, key, name, spdx in named for priority, beside, form in FORMS]
    rules += [(label, priority, key, beside, form.format(name=f"(?:{name})")) for label, key, name, alone in SHORT for i, (priority, beside, form) in enumerate(FORMS) if "{name}" in form and (alone or i in (UNDER, NAMED))]
    rules += [(f"cc-{terms}-{v}", 4, "creativecommons.org licen", "", r"creativecommons\.org/licenses/" + f"{terms}/" + v.replace(".", r"\.")) for terms in CC_TERMS for v in CC_VERSIONS]
    rules += [(label, priority, key, "", pattern) for label, priority, key, pattern in (*GENERIC, *SIGNATURES)]
    return [(label, priority, tuple(dict.fromkeys(f"{key} {beside}".split())), _gapped(pattern)) for label, priority, key, beside, pattern in dict.fromkeys(rules)]


#: Every rule needs all words of one of these, or a short name that something is under.
NAME_GATES = ("licen", "spdx", "cc-by", "creative commons", "cc by 2.", "cc by 3.0", "cc by 4.0", "attribution", "cc0", "bsd", "public domain", "permission is hereby granted", "redistribution and use", "all rights reserved", "gpl", "gfdl", "cddl", "eupl", "odbl", "wtfpl", "mpl 1.1", "mpl 2")
GATES = (*NAME_GATES, *dict.fromkeys(key for _, _, key, _ in SIGNATURES if not any(all(any(w in k for k in key.split()) for w in gate.split()) for gate in NAME_GATES)))
UNDER_SHORT = _gapped(r"under (?:the )?(?:terms of )?(?:the )?(?:" + "|".join(dict.fromkeys(key for _, key, _, alone in SHORT if not alone)) + ")")


def _gate(low: Column) -> Column:
    """Whether any rule's keywords can stand in the text."""
    holds = lambda words: reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words])
    return any_of([*[holds(g.split()) for g in GATES], F.contains(low, F.lit("under")) & F.rlike(low, F.lit(UNDER_SHORT))])


SPAN = "struct<start:int,end:int,priority:int,label:string>"
#: Items of an array that are gathered before they are put behind those before them.
RUN = 256


def _gathered(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What `step` gives for each of `items` in order: from a state, `start` at first, and an item, the next state and an array of spans.

    An array that grows by each item is copied for each; so items are gathered in runs of RUN, and the runs' arrays joined at the end.
    """

    def inner(a: Column, x: Column) -> Column:
        state, out = step(a["state"], x)
        return F.struct(state.alias("state"), F.concat(a["out"], out).alias("out"))

    def outer(a: Column, k: Column) -> Column:
        run = F.slice(items, k * RUN + 1, F.lit(RUN))
        begin = F.struct(a["state"].alias("state"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(run, begin, inner, lambda r: F.struct(r["state"].alias("state"), F.concat(a["runs"], F.array(r["out"])).alias("runs")))

    none = F.struct(start.alias("state"), F.array().cast(f"array<array<{SPAN}>>").alias("runs"))
    return F.when(F.size(items) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), none, outer, lambda a: a["runs"])))


def _spans(text: Column, rule: Column) -> Column:
    """array<SPAN> of the rule's matches: the lengths of the pieces between them and of the matches give the places."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start, end = at + x["skip"], at + x["skip"] + x["own"]
        return end, F.array(F.struct(start.alias("start"), (-end).alias("end"), (-rule["priority"]).alias("priority"), rule["label"].alias("label")))

    # cut into pieces once, not once for each match, and only where there is one
    lengths = lambda found, pieces: F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda f, p: F.struct(F.length(p).alias("skip"), F.length(f).alias("own")))
    each = lambda found: let(lengths(found, F.split(text, rule["pattern"], -1)), lambda items: _gathered(items, F.lit(0), step))
    return let(F.regexp_extract_all(text, rule["pattern"], F.lit(0)), lambda found: F.when(F.size(found) > 0, each(found)).otherwise(F.array().cast(f"array<{SPAN}>")))


def detections(text: Column) -> Column:
    """The license detections of a text: array<struct<start, end, priority, label>>, by start.

    Rules run only where their keywords stand in the text. Of the detections, sorted by start and the longest
    first, one is dropped if an earlier one of the same or a higher priority contains it; of equal spans
    the higher priority stays. Words of a pattern may stand apart by more than a blank (GAP). Places are code points from 0; end is exclusive.
    """
    rules = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(p).alias("priority"), F.array(*[F.lit(w) for w in k]).alias("keys"), F.lit(x).alias("pattern")) for a, p, k, x in signature_rules()])
    keywords = F.array(*[F.lit(w) for w in sorted({w for r in signature_rules() for w in r[2]})])
    levels = sorted({r[1] for r in signature_rules()})

    def kept(spans: Column) -> Column:
        # ends: how far the detections of at least this priority reach so far, one for each level
        def step(ends: Column, s: Column) -> tuple[Column, Column]:
            end, priority = -s["end"], -s["priority"]
            reach = reduce(lambda x, y: F.when(priority == y[1], F.element_at(ends, y[0] + 1)).otherwise(x), enumerate(levels), F.lit(-1))
            further = F.transform(ends, lambda e, i: F.when(priority >= F.element_at(F.array(*[F.lit(x) for x in levels]), i + 1), F.greatest(e, end)).otherwise(e))
            out = F.struct(s["start"].alias("start"), end.alias("end"), priority.alias("priority"), s["label"].alias("label"))
            return further, F.when(end <= reach, F.array().cast(f"array<{SPAN}>")).otherwise(F.array(out))

        return let(spans, lambda x: _gathered(x, F.array(*[F.lit(-1) for _ in levels]), step))

    def scan(low: Column) -> Column:
        # each word is looked for once, not once for each rule
        due = let(F.filter(keywords, lambda w: ~F.contains(low, w)), lambda absent: F.filter(rules, lambda r: ~F.arrays_overlap(r["keys"], absent)))
        return kept(F.sort_array(F.flatten(F.transform(due, lambda r: _spans(low, r)))))

    low = F.lower(F.coalesce(text, F.lit("")))
    return let(low, lambda x: F.when(_gate(x), scan(x)).otherwise(F.array().cast(f"array<{SPAN}>")))


def base_places(text: Column) -> Column:
    """array<struct<at, label>>: where the base phrases' words stand consecutively, at counting words from 0."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def places(w: Column) -> Column:
        here = lambda i, phrase: reduce(lambda a, b: a & b, [F.coalesce(F.get(w, i + k) == x, F.lit(False)) for k, x in enumerate(phrase)])
        label = lambda i: reduce(lambda rest, p: F.when(here(i, p[1]), F.lit(p[0])).otherwise(rest), BASE_PHRASES.items(), F.lit(None).cast("string"))
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - 1)), lambda i: label(i).isNotNull())
        return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), label(i).alias("label")))

    words = F.regexp_extract_all(F.translate(text, upper, upper.lower()), F.lit(BASE_WORD), F.lit(0))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit("license")), let(words, places)).otherwise(none)


def license_report(docs: DataFrame) -> DataFrame:
    """Licenses of every row of `docs` (doc_id, text).

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections. Labels are distinct,
    sorted and joined by commas. The score is the strength of the strongest evidence: 0.5 for a license
    named without a version up to 1 for an SPDX identifier, 0.6 at least for a base phrase, 0 for none. Null texts
    count as empty; repeated rows are scanned each; other columns are not read. Each row is scanned
    where it stands: nothing is shuffled.
    """
    rows = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long").alias("n_words"), base_places(F.col("text")).alias("_base"), detections(F.col("text")).alias("detections"))
    strength = F.transform("detections", lambda d: 0.4 + 0.12 * d["priority"])
    own, base = F.transform("detections", lambda d: d["label"]), F.transform("_base", lambda b: b["label"])
    at = F.transform("_base", lambda b: b["at"])
    return rows.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(F.lit(0.0), F.coalesce(F.array_max(strength), F.lit(0.0)), F.when(F.size("_base") > 0, F.lit(0.6))).cast("double").alias("score"), "detections",
    )


def op8_query(spark, sf_dir: str) -> DataFrame:
    return license_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
