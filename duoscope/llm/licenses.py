"""License scans: ordered signature rules behind a keyword prefilter, with overlapping detections resolved."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import map_texts

#: Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: License families (label, names as regex, SPDX identifiers as regex, versions as regex or "").
FAMILIES = [
    ("agpl", r"(?:gnu )?affero general public licen[cs]e|(?:gnu )?agpl", r"agpl", r"3|3\.0|1\.0"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e|(?:gnu )?lgpl", r"lgpl", r"2|2\.0|2\.1|3|3\.0"),
    ("gfdl", r"gnu free documentation licen[cs]e|gfdl", r"gfdl", r"1\.1|1\.2|1\.3"),
    ("gpl", r"gnu general public licen[cs]e|gnu gpl|gpl", r"gpl", r"1|2|3|1\.0|2\.0|3\.0"),
    ("apache", r"apache(?: software)? licen[cs]e|asl|apache", r"apache", r"1\.0|1\.1|2|2\.0"),
    ("mit", r"mit(?: \(expat\)| expat|/x11)? licen[cs]e|expat licen[cs]e|x11 licen[cs]e", r"mit(?:-0|-advertising|-modern-variant)?", ""),
    ("bsd-4-clause", r"(?:original|4[- ]clause|four[- ]clause) bsd(?: licen[cs]e)?|bsd[- ]4[- ]clause", r"bsd-4-clause", ""),
    ("bsd-3-clause", r"(?:new|revised|modified|3[- ]clause|three[- ]clause) bsd(?: licen[cs]e)?|bsd[- ]3[- ]clause", r"bsd-3-clause", ""),
    ("bsd-2-clause", r"(?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd(?: licen[cs]e)?|bsd[- ]2[- ]clause", r"bsd-2-clause", ""),
    ("bsd", r"bsd(?:[- ]style)? licen[cs]e", r"0bsd|bsd-1-clause", ""),
    ("mpl", r"mozilla public licen[cs]e|mpl", r"mpl", r"1\.0|1\.1|2|2\.0"),
    ("epl", r"eclipse public licen[cs]e|epl", r"epl", r"1\.0|2\.0"),
    ("cpl", r"common public licen[cs]e", r"cpl", r"1\.0"),
    ("cddl", r"common development and distribution licen[cs]e|cddl", r"cddl", r"1\.0|1\.1"),
    ("eupl", r"european union public licen[cs]e|eupl", r"eupl", r"1\.0|1\.1|1\.2"),
    ("artistic", r"artistic licen[cs]e", r"artistic", r"1\.0|2\.0"),
    ("zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib", ""),
    ("libpng", r"libpng licen[cs]e", r"libpng(?:-2\.0)?", ""),
    ("isc", r"isc licen[cs]e", r"isc", ""),
    ("boost", r"boost software licen[cs]e", r"bsl", r"1\.0"),
    ("python", r"python software foundation licen[cs]e|psf licen[cs]e", r"psf|python", r"2\.0|2"),
    ("ruby", r"ruby licen[cs]e", r"ruby", ""),
    ("php", r"php licen[cs]e", r"php", r"3\.0|3\.01"),
    ("perl", r"same terms as perl(?: itself)?", r"perl", ""),
    ("openssl", r"openssl licen[cs]e", r"openssl", ""),
    ("unlicense", r"(?:the )?unlicen[cs]e", r"unlicense", ""),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", r"wtfpl", ""),
    ("postgresql", r"postgresql licen[cs]e", r"postgresql", ""),
    ("ms-pl", r"microsoft public licen[cs]e|ms-pl", r"ms-pl", ""),
    ("ms-rl", r"microsoft reciprocal licen[cs]e|ms-rl", r"ms-rl", ""),
    ("ofl", r"sil open font licen[cs]e|open font licen[cs]e", r"ofl", r"1\.0|1\.1"),
    ("odbl", r"open (?:data commons open )?database licen[cs]e|odbl", r"odbl", r"1\.0"),
    ("odc-by", r"open data commons attribution licen[cs]e|odc-by", r"odc-by", r"1\.0"),
    ("pddl", r"public domain dedication and licen[cs]e|pddl", r"pddl", r"1\.0"),
    ("bsl", r"business source licen[cs]e", r"busl", r"1\.1"),
    ("sspl", r"server side public licen[cs]e|sspl", r"sspl", r"1\.0"),
    ("elastic", r"elastic licen[cs]e", r"elastic", r"2\.0"),
    ("upl", r"universal permissive licen[cs]e", r"upl", r"1\.0"),
    ("afl", r"academic free licen[cs]e", r"afl", r"1\.1|1\.2|2\.0|2\.1|3\.0"),
    ("osl", r"open software licen[cs]e", r"osl", r"1\.0|1\.1|2\.0|2\.1|3\.0"),
    ("ncsa", r"university of illinois(?:/|, )ncsa open source licen[cs]e", r"ncsa", ""),
    ("w3c", r"w3c (?:software notice and )?licen[cs]e", r"w3c", ""),
    ("vim", r"vim licen[cs]e", r"vim", ""),
    ("curl", r"curl licen[cs]e", r"curl", ""),
    ("json", r"json licen[cs]e", r"json", ""),
    ("qpl", r"q public licen[cs]e", r"qpl", r"1\.0"),
    ("cecill", r"cecill(?:-[bc])? licen[cs]e", r"cecill", r"1\.0|2\.0|2\.1|b|c"),
    ("mulan", r"mulan (?:permissive|public) (?:software )?licen[cs]e", r"mulanpsl", r"1\.0|2\.0"),
    ("cc0", r"cc0(?: 1\.0)?(?: universal)?|creative commons zero", r"cc0", r"1\.0"),
    ("cc-by-nc-nd", r"cc[- ]by[- ]nc[- ]nd|attribution-noncommercial-noderiv(?:ative)?s?", r"cc-by-nc-nd", r"2\.0|2\.5|3\.0|4\.0"),
    ("cc-by-nc-sa", r"cc[- ]by[- ]nc[- ]sa|attribution-noncommercial-sharealike", r"cc-by-nc-sa", r"2\.0|2\.5|3\.0|4\.0"),
    ("cc-by-nc", r"cc[- ]by[- ]nc|attribution-noncommercial", r"cc-by-nc", r"2\.0|2\.5|3\.0|4\.0"),
    ("cc-by-nd", r"cc[- ]by[- ]nd|attribution-noderiv(?:ative)?s", r"cc-by-nd", r"2\.0|2\.5|3\.0|4\.0"),
    ("cc-by-sa", r"cc[- ]by[- ]sa|attribution-sharealike", r"cc-by-sa", r"2\.0|2\.5|3\.0|4\.0"),
    ("cc-by", r"cc[- ]by|creative commons attribution", r"cc-by", r"2\.0|2\.5|3\.0|4\.0"),
]

#: Rules without a family (label, priority, regex, keyword).
SINGLE_RULES = [
    ("mit", 90, r"permission is hereby granted, free of charge, to any person obtaining a copy", "hereby granted"),
    ("isc", 90, r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", "with or without fee"),
    ("bsd", 85, r"redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use"),
    ("bsd-3-clause", 95, r"neither the name of .{1,120}? nor the names of its contributors may be used", "neither the name"),
    ("zlib", 90, r"this software is provided 'as-is', without any express or implied warranty", "as-is"),
    ("boost", 90, r"boost software license - version 1\.0", "boost software"),
    ("public-domain", 60, r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", "public domain"),
    ("unlicense", 90, r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("all-rights-reserved", 40, r"all rights reserved", "all rights reserved"),
    ("copyright-notice", 20, r"(?:copyright|\(c\)|©) ?(?:\(c\) ?|© ?)?(?:19|20)\d\d", "copyright|(c)|©"),
    ("proprietary", 50, r"proprietary and confidential|unauthorized copying of this file", "proprietary|unauthorized copying"),
]

#: Sentences of license texts and file headers, lower-cased (label, priority, regex, keyword).
SIGNATURES = [
    ("mit", 92, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "permission notice shall be included"),
    ("mit", 60, r"the software is provided [\"']?as is[\"']?, without warranty of any kind, express or implied", "without warranty of any kind"),
    ("mit-0", 91, r"to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided", "to deal in the software"),
    ("bsd", 84, r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "redistributions of source code"),
    ("bsd", 84, r"redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer", "redistributions in binary form"),
    ("bsd-4-clause", 96, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising materials"),
    ("bsd", 62, r"this software is provided by (?:the )?[\w ,.&-]{1,80}? [\"'`]{0,2}as is[\"']{0,2} and any express or implied warranties", "express or implied warranties"),
    ("bsd", 75, r"use of this source code is governed by a bsd-style license", "bsd-style"),
    ("0bsd", 93, r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided", "with or without fee"),
    ("apache", 94, r"licensed under the apache license, version 2\.0 \(the [\"']?license[\"']?\)", "apache license"),
    ("apache", 80, r"you may not use this file except in compliance with the license", "in compliance with the license"),
    ("apache", 78, r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an [\"']?as is[\"']? basis", "distributed under the license"),
    ("apache", 93, r"apache license version 2\.0, january 2004", "january 2004"),
    ("apache", 82, r"licensed to the apache software foundation \(asf\) under one or more contributor license agreements", "contributor license"),
    ("apache", 84, r"this product includes software developed by the apache software foundation", "apache software foundation"),
    ("gpl", 88, r"it under the terms of the gnu general public license as published by the free software foundation[;,] either version \d(?:\.\d)? of the license,? or", "gnu general public license"),
    ("gpl", 88, r"it under the terms of the gnu general public license version \d(?:\.\d)? (?:only )?as published by the free software foundation", "gnu general public license"),
    ("gpl", 70, r"you should have received a copy of the gnu general public license along with", "received a copy of the gnu"),
    ("gpl", 95, r"the gnu general public license is a free, copyleft license for software and other kinds of works", "copyleft license"),
    ("gpl", 95, r"gnu general public license version \d, (?:june 1991|29 june 2007)", "gnu general public license"),
    ("gpl-exception", 86, r"as a special exception, (?:the copyright holders? (?:of [\w -]{1,40}? )?gives? (?:you )?permission to link|you may (?:use|create|include))", "special exception"),
    ("lgpl", 89, r"it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation[;,] either version \d(?:\.\d)?", "general public license"),
    ("lgpl", 71, r"you should have received a copy of the gnu (?:lesser|library) general public license along with", "received a copy of the gnu"),
    ("lgpl", 95, r"this license, the lesser general public license, applies to some specially designated software packages", "specially designated"),
    ("agpl", 89, r"it under the terms of the gnu affero general public license as published by the free software foundation[;,] either version \d", "affero general public"),
    ("agpl", 95, r"remote network interaction; use with the gnu general public license", "remote network interaction"),
    ("gfdl", 89, r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license", "free documentation license"),
    ("fsf-verbatim", 40, r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed", "verbatim copies"),
    ("fsf-all-permissive", 90, r"copying and distribution of this file, with or without modification, are permitted in any medium without royalty", "without royalty"),
    ("mpl", 94, r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0", "source code form"),
    ("mpl", 85, r"the contents of this file are subject to the mozilla public license version 1\.\d", "mozilla public license"),
    ("mpl", 72, r"if a copy of the mpl was not distributed with this file", "copy of the mpl"),
    ("epl", 88, r"are made available under the terms of the eclipse public license", "eclipse public license"),
    ("epl", 90, r"the accompanying program is provided under the terms of this eclipse public license", "accompanying program"),
    ("cpl", 88, r"are made available under the terms of the common public license", "common public license"),
    ("cddl", 88, r"the contents of this file are subject to the terms of the common development and distribution license", "common development"),
    ("eupl", 88, r"licen[cs]ed under the eupl,? version 1\.\d", "eupl"),
    ("artistic", 92, r"the intent of this document is to state the conditions under which a package may be copied", "under which a package"),
    ("artistic", 92, r"the artistic license 2\.0 copyright \(c\) 2000-2006, the perl foundation", "perl foundation"),
    ("zlib", 92, r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", "plainly marked as such"),
    ("zlib", 86, r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software", "must not be misrepresented"),
    ("libpng", 90, r"the png reference library is supplied [\"']as is[\"']", "png reference library"),
    ("isc", 84, r"permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("curl", 91, r"provided that the above copyright notice and this permission notice appear in all copies\. the software is provided [\"']as is[\"'], without warranty of any kind", "appear in all copies"),
    ("boost", 92, r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization"),
    ("boost", 88, r"distributed under the boost software license, version 1\.0", "boost software"),
    ("python", 88, r"this license agreement is between the python software foundation", "python software foundation"),
    ("php", 86, r"this product includes php software, freely available from", "php software"),
    ("ruby", 86, r"you can redistribute it and/or modify it under either the terms of the (?:2-clause bsdl|gpl)", "under either the terms"),
    ("openssl", 88, r"this product includes software developed by the openssl project", "openssl project"),
    ("ssleay", 88, r"this product includes cryptographic software written by eric young", "cryptographic software"),
    ("unlicense", 91, r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "anyone is free to copy"),
    ("wtfpl", 92, r"you just do what the fuck you want to", "you just do what"),
    ("beerware", 90, r"as long as you retain this notice you can do whatever you want with this stuff", "whatever you want with this stuff"),
    ("postgresql", 90, r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "without a written agreement"),
    ("hpnd", 85, r"permission to use, copy, modify,? (?:and )?distribute(?:,? and sell)? this software and its documentation for any purpose (?:and without fee )?is hereby granted", "and its documentation for any purpose"),
    ("ntp", 86, r"permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted", "and its documentation for any purpose"),
    ("x11", 92, r"except as contained in this notice, the name of the x consortium shall not be used in advertising", "x consortium"),
    ("icu", 87, r"icu license - icu 1\.8\.1 and later", "icu license"),
    ("unicode", 90, r"unicode, inc\. license agreement - data files and software", "unicode, inc"),
    ("ms-pl", 85, r"this license governs use of the accompanying software\. if you use the software, you accept this license", "license governs use"),
    ("ofl", 93, r"permission is hereby granted, free of charge, to any person obtaining a copy of the font software", "font software"),
    ("ofl", 88, r"this font software is licensed under the sil open font license", "font software"),
    ("odbl", 88, r"made available under the open database license", "open database license"),
    ("pddl", 88, r"made available under the public domain dedication and license", "public domain dedication"),
    ("busl", 90, r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work", "licensed work"),
    ("sspl", 90, r"if you make the functionality of the program or a modified version available to third parties as a service", "third parties as a service"),
    ("elastic", 90, r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    ("commons-clause", 90, r"the software is provided to you by the licensor under the license, as defined below, subject to the following condition", "subject to the following condition"),
    ("upl", 90, r"the larger works? to which the software is contributed", "larger work"),
    ("afl", 86, r"licensed under the academic free license version \d", "academic free license"),
    ("osl", 86, r"licensed under the open software license version \d", "open software license"),
    ("ncsa", 90, r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers\.", "following disclaimers"),
    ("json", 93, r"the software shall be used for good, not evil", "not evil"),
    ("ijg", 86, r"this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("freetype", 86, r"portions of this software are copyright .{1,60}? the freetype project", "freetype project"),
    ("info-zip", 88, r"for the purposes of this copyright and license, [\"']info-zip[\"'] is defined as", "info-zip"),
    ("vim", 88, r"there are no restrictions on distributing unmodified copies of vim", "copies of vim"),
    ("cecill", 88, r"this software is governed by the cecill(?:-[bc])? license under french law", "cecill"),
    ("mulan", 88, r"you can use this software according to the terms and conditions of the mulan p(?:ub|s)l", "mulan p"),
    ("cc0", 92, r"to the extent possible under law, .{1,120}? waived all copyright and related or neighbou?ring rights", "neighb"),
    ("cc-by", 86, r"this work is licensed under (?:a|the) creative commons attribution(?: \d\.\d)?(?: international| unported)? license", "creative commons"),
    ("cc-by-sa", 87, r"this work is licensed under (?:a|the) creative commons attribution-share ?alike(?: \d\.\d)?(?: international| unported)? license", "creative commons"),
    ("sun-rpc", 88, r"sun rpc is a product of sun microsystems, inc\. and is provided for unrestricted use", "sun rpc"),
    ("ibm-public", 86, r"the accompanying program is provided under the terms of this ibm public license", "ibm public"),
    ("apsl", 88, r"this file contains original code and/or modifications of original code as defined in and that are subject to the apple public source license", "apple public source"),
    ("npl", 86, r"the contents of this file are subject to the netscape public license", "netscape public"),
    ("lppl", 88, r"it may be distributed and/or modified under the conditions of the latex project public license", "latex project"),
    ("sleepycat", 88, r"redistributions in any form must be accompanied by information on how to obtain complete source code", "complete source code"),
    ("proprietary", 55, r"this software is the (?:confidential and )?proprietary (?:information|property) of", "proprietary"),
    ("proprietary", 55, r"no part of this (?:publication|software|work|file) may be reproduced,? (?:stored|distributed|copied)", "may be reproduced"),
]

#: Addresses of license texts (label, regex).
ADDRESSES = [
    ("apache", r"apache\.org/licenses/license-[\d.]+"),
    ("gpl", r"gnu\.org/licenses/(?:old-licenses/)?gpl(?:-[\d.]+)?"),
    ("lgpl", r"gnu\.org/licenses/(?:old-licenses/)?lgpl(?:-[\d.]+)?"),
    ("agpl", r"gnu\.org/licenses/agpl(?:-[\d.]+)?"),
    ("gfdl", r"gnu\.org/licenses/fdl(?:-[\d.]+)?"),
    ("mit", r"opensource\.org/licen[cs]es?/mit\b"),
    ("bsd-2-clause", r"opensource\.org/licen[cs]es?/bsd-2-clause"),
    ("bsd-3-clause", r"opensource\.org/licen[cs]es?/bsd-3-clause"),
    ("isc", r"opensource\.org/licen[cs]es?/isc\b"),
    ("mpl", r"mozilla\.org/(?:en-us/)?mpl/\d"),
    ("epl", r"eclipse\.org/legal/epl"),
    ("boost", r"boost\.org/license_1_0\.txt"),
    ("unlicense", r"unlicense\.org"),
    ("ofl", r"scripts\.sil\.org/ofl"),
    ("odbl", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", r"opendatacommons\.org/licenses/by"),
    ("cc0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", r"creativecommons\.org/licenses/by-nc(?!-)"),
    ("cc-by-nd", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", r"creativecommons\.org/licenses/by(?!-)"),
]

#: What a family's rules look like; N is the name, V the version, S the SPDX identifier.
TEMPLATES = [
    ("spdx", 100, r"spdx-licen[cs]e-identifier:\s*S(?:-V)?(?:-only|-or-later|\+)?(?![\w.-])", "spdx"),
    ("grant", 80, r"(?:licen[cs]ed|released|distributed|available|published|provided)(?: \w+){0,4}? under (?:the )?(?:terms of )?(?:the )?(?:N)(?:,? ?v(?:ersion|er\.?|\.)? ?V| V)?(?![\w-])", "under"),
    ("versioned", 70, r"\b(?:N),? ?(?:v(?:ersion|er\.?|\.)? ?)?V(?![\w.]*\w)", ""),
    ("field", 65, r"\blicen[cs]e\s*[:=]\s*[\"']?(?:S|N)(?:-V)?(?![\w-])", "licen"),
    ("name", 50, r"\b(?:N)(?![\w-])", ""),
]

_SEPARATORS = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Comment marks before a line's words.
_LEAD = re.compile(r"(?:\*/|[\s*#;%>|]|//+!?|/\*+|<!--+|--(?!-)|dnl\b|rem\b)+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rules() -> list[tuple[str, int, str, tuple[str, ...]]]:
    """The ordered signature table: (label, priority, regex, keywords of which a text must hold one)."""
    out = []
    for label, names, spdx, versions in FAMILIES:
        words = tuple(dict.fromkeys(_keyword(x) for x in _branches(names)))
        for kind, priority, pattern, key in TEMPLATES:
            if kind == "versioned" and not versions:
                continue
            # bare short names are too common as words of their own
            named = names if kind in ("grant", "field", "versioned") else "|".join(x for x in _branches(names) if "licen" in x or "-" in x or "cc" in x or " " in x or "gpl" in x)
            if "N" in pattern and not named:
                continue
            r = re.sub("[NVS]", lambda m: {"N": named, "V": f"(?:{versions or '[0-9.]+'})", "S": f"(?:{spdx})"}[m[0]], pattern)
            gate = words if kind in ("name", "versioned", "grant") else (key,)
            out.append((label, priority, r, gate))
    out += [(label, priority, r, tuple(key.split("|")) if key else ()) for label, priority, r, key in SINGLE_RULES + SIGNATURES]
    out += [(label, 75, r, (re.match(r"[a-z]+", r)[0],)) for label, r in ADDRESSES]
    return sorted(out, key=lambda x: -x[1])


def _branches(names: str) -> list[str]:
    """The alternatives at the top level of a regex."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(names + "|"):
        depth += (c in "([") - (c in ")]")
        if c == "|" and depth == 0:
            out.append(names[at:i])
            at = i + 1
    return out


def _keyword(branch: str) -> str:
    """The longest run of letters, spaces and hyphens that every match of the branch holds."""
    plain = re.sub(r"\[[^]]*\][?*]?|\\.", "\0", branch)
    while (less := re.sub(r"\([^()]*\)[?*]?", "\0", plain)) != plain:
        plain = less
    plain = re.sub(r".\?", "\0", plain)
    return max(re.findall(r"[a-z0-9 -]+", plain), key=len, default="licen")


def unwrapped(low: str) -> str:
    """The text with each paragraph on one line: white space and the comment marks around lines are one space.

    Rules hold single spaces. A line without words ends a paragraph, and no rule's words go over it.
    """
    paragraphs: list[list[str]] = [[]]
    for line in low.split("\n"):
        if m := _LEAD.match(line):
            line = line[m.end() :]
        line = line.rstrip()
        line = line.removesuffix("*/").removesuffix("-->").rstrip(" \t\r*#|")
        if line:
            paragraphs[-1] += line.split()
        elif paragraphs[-1]:
            paragraphs.append([])
    return "\n".join(map(" ".join, paragraphs))


class _Furthest:
    """The greatest end among intervals that start at or before a place, as intervals are added: a binary indexed tree."""

    def __init__(self, n: int) -> None:
        self.ends = [-1] * (n + 1)

    def put(self, place: int, end: int) -> None:
        place += 1
        while place < len(self.ends):
            self.ends[place] = max(self.ends[place], end)
            place += place & -place

    def upto(self, place: int) -> int:
        place, out = place + 1, -1
        while place:
            out = max(out, self.ends[place])
            place -= place & -place
        return out


class Scanner:
    """Compiled rules; made once for each Python worker's batch run."""

    def __init__(self) -> None:
        self.rules = [(label, priority, re.compile(r), keys) for label, priority, r, keys in rules()]
        self.gate = ahocorasick.Automaton()
        for k in {k for *_, keys in self.rules for k in keys}:
            self.gate.add_word(k, k)
        self.gate.make_automaton()
        self.phrases = [(p.encode().split(), label) for p, label in BASE_PHRASES.items()]

    def detections(self, low: str) -> list[tuple[int, int, int, str]]:
        """(start, end, priority, label), after suppression; places are those of unwrapped().

        Detections come in order of priority. One is dropped if its interval lies in that of an earlier one, of a
        higher priority or, at the same priority, longer; ties go to the rule that stands first.
        """
        low = unwrapped(low)
        held = {k for _, k in self.gate.iter(low)}
        if not held:
            return []
        found = []
        for order, (label, priority, r, keys) in enumerate(self.rules):
            if held.isdisjoint(keys):
                continue
            found += [(-priority, m.start() - m.end(), order, m.start(), m.end(), label) for m in r.finditer(low)]
        rank = {s: i for i, s in enumerate(sorted({x[3] for x in found}))}
        furthest = _Furthest(len(rank))
        kept: list[tuple[int, int, int, str]] = []
        for p, _, _, start, end, label in sorted(found):
            if furthest.upto(rank[start]) < end:
                kept.append((start, end, -p, label))
                furthest.put(rank[start], end)
        return sorted(kept)

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
        low = (text or "").translate(_UPPER)
        words = low.encode("utf-8", "surrogatepass").translate(_SEPARATORS).split()
        places, base = [], set()
        have = None
        for phrase, label in self.phrases:
            if phrase[0].decode() not in low:
                continue
            if have is None:
                have = {}
                first = {p[0] for p, _ in self.phrases}
                for i, w in enumerate(words):
                    if w in first:
                        have.setdefault(w, []).append(i)
            for i in have.get(phrase[0], ()):
                if words[i : i + len(phrase)] == phrase:
                    places.append(i)
                    base.add(label)
        kept = self.detections(low)
        labels = base | {x[3] for x in kept}
        score = max([x[2] / 100 for x in kept] + [0.75] * bool(base), default=0.0)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License detections, a row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Texts are lower-cased (A-Z); signature rules run on unwrapped paragraphs (see unwrapped()), those alone of whose
    keywords the text holds one. Base phrases are runs of whole words; n_base counts their places, first_word and
    last_word are the smallest and largest place (null without one). labels holds those of the signature rules too.
    score is the highest priority among the detections that stand, as a fraction; 0 without any. A null text is empty,
    an empty table gives an empty one, and very long texts are scanned whole, in time in proportion to their length.
    Rows are independent: no shuffle, whatever repeats. Other columns are not read.
    """
    schema = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(docs, [F.col(id_col).alias("doc_id")], text_col, schema, lambda: Scanner().scan)
