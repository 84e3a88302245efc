"""Signatures of licences, as patterns over lower-case words joined by one blank.

A line is: label | priority | pattern. @2.0 stands for a version with or without the
word for it. The first word of a pattern is its keyword: it is looked for first.
Priorities: 3 wording of a licence or an identifier, 2 a full name with what tells it
apart, 1 a name or abbreviation alone, 0 a mention that leaves the licence open.
Of equal priority the longer match counts, then the earlier line.
"""

from __future__ import annotations

import re

WORDING = r"""
MIT | 3 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
MIT | 3 | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
MIT-0 | 3 | permission is hereby granted free of charge to any person obtaining a copy of this software to deal in it without restriction and without this notice
X11 | 3 | except as contained in this notice the name of (the )?(x consortium|\w+( \w+)?) shall not be used in advertising
ISC | 3 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0BSD | 3 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
HPND | 3 | permission to use copy modify (and )?distribute (and sell )?this software and its documentation for any purpose (and without fee |with or without fee )?is hereby granted
NTP | 3 | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright
BSD-2-Clause | 3 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
BSD-2-Clause | 2 | redistribution and use in source and binary forms with or without modification are permitted provided that
BSD-3-Clause | 3 | neither the name of( the)?( \w+){1,6} nor the names of its contributors may be used to endorse or promote products
BSD-4-Clause | 3 | all advertising materials mentioning features or use of this software must display the following acknowledg?ement
BSD-1-Clause | 3 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
BSL-1.0 | 3 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
Zlib | 3 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
Zlib | 3 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
Apache-2.0 | 3 | licensed under the apache license@2.0 the license you may not use this file except in compliance with the license
Apache-2.0 | 3 | you may obtain a copy of the license at (http|https) www apache org licenses license 2 0
Apache-1.1 | 3 | this product includes software developed by the apache (software foundation|group)
GPL-2.0-or-later | 3 | terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later
GPL-3.0-or-later | 3 | terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later
GPL-2.0-only | 3 | terms of the gnu general public license@2 as published by the free software foundation
GPL-3.0-only | 3 | terms of the gnu general public license@3 as published by the free software foundation
LGPL-2.1-or-later | 3 | terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or
LGPL-3.0-or-later | 3 | terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or
LGPL-2.0-or-later | 3 | terms of the gnu library general public license as published by the free software foundation either version 2 of the license or
AGPL-3.0-or-later | 3 | terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or
GFDL-1.3-or-later | 3 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license@1.3
GFDL-1.2-or-later | 3 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license@1.2
GFDL-1.1-or-later | 3 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license@1.1
MPL-2.0 | 3 | this source code form is subject to the terms of the mozilla public license( v| version)? v?2 0
MPL-1.1 | 3 | the contents of this file are subject to the mozilla public license@1.1
MPL-1.0 | 3 | the contents of this file are subject to the mozilla public license@1.0
CDDL-1.0 | 3 | the contents of this file are subject to the terms of the common development and distribution license
CPAL-1.0 | 3 | the contents of this file are subject to the common public attribution license
EPL-2.0 | 3 | made available under the terms of the eclipse public license@2.0
EPL-1.0 | 3 | made available under the terms of the eclipse public license@1.0
EUPL-1.2 | 3 | licensed under the eupl@1.2( only| or later)?
EUPL-1.1 | 3 | licensed under the eupl@1.1( only| or later)?
Unlicense | 3 | this is free and unencumbered software released into the public domain
Unlicense | 3 | anyone is free to copy modify publish use compile sell or distribute this software
CC0-1.0 | 3 | dedicated (all copyright|the work) .*?to the public domain (worldwide )?(under|by waiving)
CC0-1.0 | 3 | to the extent possible under law( \w+){1,8} (has|have) waived all copyright
WTFPL | 3 | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
Artistic-2.0 | 3 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed this license establishes
GPL-any | 3 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
OFL-1.1 | 3 | this font software is licensed under the sil open font license
OFL-1.1 | 3 | permission is hereby granted free of charge to any person obtaining a copy of the font software
PSF-2.0 | 3 | python software foundation license( version)? 2 this license agreement is between
PostgreSQL | 3 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
NCSA | 3 | permission is hereby granted free of charge to any person obtaining a copy of this software .*?to deal with the software without restriction
OpenSSL | 3 | this product includes software developed by the openssl project
Ruby | 3 | you may make and give away verbatim copies of the source form of the software without restriction
JSON | 3 | the software shall be used for good not evil
Beerware | 3 | as long as you retain this notice you can do whatever you want with this stuff
BUSL-1.1 | 3 | use limitation usage of the software is subject to this business source license
proprietary | 3 | this software is the confidential and proprietary information of
proprietary | 2 | all rights reserved unauthorized (copying|use|reproduction)
proprietary | 2 | no part of this (publication|work|book|document) may be reproduced
"""

NAMES = r"""
MIT | 2 | (the )?mit license( mit)?
MIT | 2 | mit licen[sc]ed
MIT | 2 | expat license
MIT | 2 | mit expat
MIT-0 | 2 | mit no attribution( license)?
X11 | 2 | x11 license
X11 | 2 | mit x11( license)?
Apache-2.0 | 2 | apache( software)? licen[sc]e@2.0
Apache-2.0 | 2 | apache@2.0( licen[sc]ed?)?
Apache-2.0 | 2 | asl@2.0
Apache-2.0 | 2 | al2 0
Apache-1.1 | 2 | apache( software)? licen[sc]e@1.1
Apache-1.0 | 2 | apache( software)? licen[sc]e@1.0
Apache-any | 1 | apache( software)?( foundation)? licen[sc]e
Apache-any | 1 | apache licen[sc]ed
GPL-3.0-or-later | 2 | gnu general public licen[sc]e@3.0 or( \w+){0,3} (later|newer)
GPL-3.0-or-later | 2 | gnu gpl@3.0 or( \w+){0,3} (later|newer)
GPL-3.0-or-later | 2 | gpl@3.0 or( \w+){0,3} (later|newer)
GPL-3.0-or-later | 2 | gplv3 or( \w+){0,3} (later|newer)
GPL-3.0-only | 2 | gnu general public licen[sc]e@3.0( only)?
GPL-3.0-only | 2 | general public licen[sc]e@3.0( only)?
GPL-3.0-only | 2 | gnu gpl@3.0( only)?
GPL-3.0-only | 2 | gpl@3.0( only)?
GPL-3.0-only | 2 | gplv3( only)?
GPL-3.0-only | 2 | gpl3
GPL-2.0-or-later | 2 | gnu general public licen[sc]e@2.0 or( \w+){0,3} (later|newer)
GPL-2.0-or-later | 2 | gnu gpl@2.0 or( \w+){0,3} (later|newer)
GPL-2.0-or-later | 2 | gpl@2.0 or( \w+){0,3} (later|newer)
GPL-2.0-or-later | 2 | gplv2 or( \w+){0,3} (later|newer)
GPL-2.0-only | 2 | gnu general public licen[sc]e@2.0( only)?
GPL-2.0-only | 2 | general public licen[sc]e@2.0( only)?
GPL-2.0-only | 2 | gnu gpl@2.0( only)?
GPL-2.0-only | 2 | gpl@2.0( only)?
GPL-2.0-only | 2 | gplv2( only)?
GPL-2.0-only | 2 | gpl2
GPL-2.0-with-classpath-exception | 2 | gpl@2.0 with( the)? classpath exception
GPL-2.0-with-classpath-exception | 2 | gnu general public licen[sc]e@2.0( only)? with( the)? classpath exception
GPL-1.0-only | 2 | gnu general public licen[sc]e@1.0( only)?
GPL-any | 1 | gnu general public licen[sc]e
GPL-any | 1 | general public licen[sc]e
GPL-any | 1 | gnu gpl
GPL-any | 1 | gpl( licen[sc]ed?)?
LGPL-3.0-or-later | 2 | gnu lesser general public licen[sc]e@3.0 or( \w+){0,3} later
LGPL-3.0-only | 2 | gnu lesser general public licen[sc]e@3.0( only)?
LGPL-3.0-only | 2 | lesser general public licen[sc]e@3.0( only)?
LGPL-3.0-only | 2 | lgpl@3.0( only)?
LGPL-3.0-only | 2 | lgplv3
LGPL-2.1-or-later | 2 | gnu lesser general public licen[sc]e@2.1 or( \w+){0,3} later
LGPL-2.1-or-later | 2 | lgpl@2.1 or( \w+){0,3} later
LGPL-2.1-only | 2 | gnu lesser general public licen[sc]e@2.1( only)?
LGPL-2.1-only | 2 | lesser general public licen[sc]e@2.1( only)?
LGPL-2.1-only | 2 | lgpl@2.1( only)?
LGPL-2.1-only | 2 | lgplv2 1
LGPL-2.0-only | 2 | gnu library general public licen[sc]e@2.0( only)?
LGPL-2.0-only | 2 | lgpl@2.0( only)?
LGPL-any | 2 | gnu (lesser|library) general public licen[sc]e
LGPL-any | 2 | lesser general public licen[sc]e
LGPL-any | 2 | library general public licen[sc]e
LGPL-any | 1 | gnu lgpl
LGPL-any | 1 | lgpl( licen[sc]ed?)?
AGPL-3.0-or-later | 2 | gnu affero general public licen[sc]e@3.0 or( \w+){0,3} later
AGPL-3.0-or-later | 2 | agpl@3.0 or( \w+){0,3} later
AGPL-3.0-only | 2 | gnu affero general public licen[sc]e@3.0( only)?
AGPL-3.0-only | 2 | affero general public licen[sc]e@3.0( only)?
AGPL-3.0-only | 2 | agpl@3.0( only)?
AGPL-3.0-only | 2 | agplv3
AGPL-1.0-only | 2 | affero general public licen[sc]e@1.0
AGPL-any | 2 | gnu affero general public licen[sc]e
AGPL-any | 2 | affero general public licen[sc]e
AGPL-any | 1 | gnu agpl
AGPL-any | 1 | agpl( licen[sc]ed?)?
GFDL-1.3-only | 2 | gnu free documentation licen[sc]e@1.3
GFDL-1.2-only | 2 | gnu free documentation licen[sc]e@1.2
GFDL-1.1-only | 2 | gnu free documentation licen[sc]e@1.1
GFDL-any | 1 | gnu free documentation licen[sc]e
GFDL-any | 1 | free documentation licen[sc]e
GFDL-any | 1 | gfdl
BSD-2-Clause | 2 | bsd 2 clause( licen[sc]e)?
BSD-2-Clause | 2 | 2 clause bsd( licen[sc]e)?
BSD-2-Clause | 2 | two clause bsd( licen[sc]e)?
BSD-2-Clause | 2 | simplified bsd( licen[sc]e)?
BSD-2-Clause | 2 | freebsd licen[sc]e
BSD-3-Clause | 2 | bsd 3 clause( licen[sc]e)?
BSD-3-Clause | 2 | 3 clause bsd( licen[sc]e)?
BSD-3-Clause | 2 | three clause bsd( licen[sc]e)?
BSD-3-Clause | 2 | new bsd( licen[sc]e)?
BSD-3-Clause | 2 | modified bsd( licen[sc]e)?
BSD-3-Clause | 2 | revised bsd( licen[sc]e)?
BSD-3-Clause-Clear | 2 | clear bsd( licen[sc]e)?
BSD-4-Clause | 2 | bsd 4 clause( licen[sc]e)?
BSD-4-Clause | 2 | 4 clause bsd( licen[sc]e)?
BSD-4-Clause | 2 | original bsd( licen[sc]e)?
0BSD | 2 | zero clause bsd( licen[sc]e)?
0BSD | 2 | bsd zero clause( licen[sc]e)?
0BSD | 2 | 0bsd
BSD-any | 1 | bsd style licen[sc]e
BSD-any | 1 | bsd licen[sc]ed?
ISC | 2 | isc licen[sc]ed?
MPL-2.0 | 2 | mozilla public licen[sc]e@2.0
MPL-2.0 | 2 | mpl@2.0
MPL-1.1 | 2 | mozilla public licen[sc]e@1.1
MPL-1.1 | 2 | mpl@1.1
MPL-1.0 | 2 | mozilla public licen[sc]e@1.0
MPL-any | 1 | mozilla public licen[sc]e
EPL-2.0 | 2 | eclipse public licen[sc]e@2.0
EPL-2.0 | 2 | epl@2.0
EPL-1.0 | 2 | eclipse public licen[sc]e@1.0
EPL-1.0 | 2 | epl@1.0
EPL-any | 1 | eclipse public licen[sc]e
EDL-1.0 | 2 | eclipse distribution licen[sc]e
EUPL-1.2 | 2 | european union public licen[sc]e@1.2
EUPL-1.1 | 2 | european union public licen[sc]e@1.1
EUPL-any | 1 | european union public licen[sc]e
CDDL-1.0 | 2 | common development and distribution licen[sc]e@1.0
CDDL-1.1 | 2 | common development and distribution licen[sc]e@1.1
CDDL-any | 1 | common development and distribution licen[sc]e
CDDL-any | 1 | cddl licen[sc]ed?
CPL-1.0 | 2 | common public licen[sc]e@1.0
CPL-any | 1 | common public licen[sc]e
CPAL-1.0 | 2 | common public attribution licen[sc]e
IPL-1.0 | 2 | ibm public licen[sc]e
APSL-2.0 | 2 | apple public source licen[sc]e@2.0
APSL-any | 1 | apple public source licen[sc]e
Artistic-2.0 | 2 | artistic licen[sc]e@2.0
Artistic-1.0 | 2 | artistic licen[sc]e@1.0
Artistic-any | 1 | artistic licen[sc]e
BSL-1.0 | 2 | boost software licen[sc]e( version)?( 1 0)?
BUSL-1.1 | 2 | business source licen[sc]e
Zlib | 2 | zlib libpng licen[sc]e
Zlib | 2 | zlib licen[sc]ed?
Libpng | 2 | libpng licen[sc]e
Unlicense | 2 | (the )?unlicense
WTFPL | 2 | do what the fuck you want to public licen[sc]e
WTFPL | 2 | wtfpl licen[sc]e
Beerware | 2 | beerware licen[sc]e
PSF-2.0 | 2 | python software foundation licen[sc]e
PSF-2.0 | 2 | psf licen[sc]e
PHP-3.01 | 2 | php licen[sc]e@3.01
PHP-any | 1 | php licen[sc]e
Ruby | 2 | ruby licen[sc]e
PostgreSQL | 2 | postgresql licen[sc]e
OpenSSL | 2 | openssl licen[sc]e
NCSA | 2 | university of illinois ncsa open source licen[sc]e
NCSA | 2 | ncsa open source licen[sc]e
AFL-3.0 | 2 | academic free licen[sc]e@3.0
AFL-any | 1 | academic free licen[sc]e
OSL-3.0 | 2 | open software licen[sc]e@3.0
OSL-any | 1 | open software licen[sc]e
ECL-2.0 | 2 | educational community licen[sc]e@2.0
MS-PL | 2 | microsoft public licen[sc]e
MS-PL | 2 | ms pl licen[sc]e
MS-RL | 2 | microsoft reciprocal licen[sc]e
OFL-1.1 | 2 | sil open font licen[sc]e( version)?( 1 1)?
OFL-1.1 | 2 | open font licen[sc]e( version)?( 1 1)?
UPL-1.0 | 2 | universal permissive licen[sc]e
Vim | 2 | vim licen[sc]e
W3C | 2 | w3c software( notice and)? licen[sc]e
ZPL-2.1 | 2 | zope public licen[sc]e@2.1
ZPL-any | 1 | zope public licen[sc]e
LPPL-1.3c | 2 | latex project public licen[sc]e@1.3
LPPL-any | 1 | latex project public licen[sc]e
CECILL-2.1 | 2 | cecill free software licen[sc]e agreement v?2 1
CECILL-any | 1 | cecill licen[sc]e
MulanPSL-2.0 | 2 | mulan psl v2 licen[sc]e
MulanPSL-2.0 | 2 | mulan permissive software licen[sc]e
SSPL-1.0 | 2 | server side public licen[sc]e
Elastic-2.0 | 2 | elastic licen[sc]e( v?2 0)?
NPOSL-3.0 | 2 | non profit open software licen[sc]e
QPL-1.0 | 2 | q public licen[sc]e
Sleepycat | 2 | sleepycat licen[sc]e
NASA-1.3 | 2 | nasa open source agreement licen[sc]e
RPL-1.5 | 2 | reciprocal public licen[sc]e
SPL-1.0 | 2 | sun public licen[sc]e
Watcom-1.0 | 2 | sybase open watcom public licen[sc]e
ODbL-1.0 | 2 | open (data commons open )?database licen[sc]e
ODC-By-1.0 | 2 | open data commons attribution licen[sc]e
PDDL-1.0 | 2 | open data commons public domain dedication( and)? licen[sc]e
CDLA-Permissive-2.0 | 2 | community data licen[sc]e agreement permissive@2.0
CDLA-Permissive-1.0 | 2 | community data licen[sc]e agreement permissive@1.0
CDLA-Sharing-1.0 | 2 | community data licen[sc]e agreement sharing@1.0
OGL-UK-3.0 | 2 | open government licen[sc]e v?3( 0)?
OGL-any | 1 | open government licen[sc]e
RAIL | 2 | (creativeml )?open rail m licen[sc]e
RAIL | 2 | bigscience rail licen[sc]e
Llama | 2 | llama( \d+)* community licen[sc]e
Gemma | 2 | gemma terms of use licen[sc]e
CC0-1.0 | 2 | creative commons zero( v?1 0)?( universal)?
CC0-1.0 | 2 | creative commons cc0
CC0-1.0 | 2 | cc0( v?1 0)?( universal)?
CC0-1.0 | 2 | cc zero
public-domain | 1 | in the public domain
public-domain | 1 | public domain dedication
public-domain | 1 | released (in)?to the public domain
commercial | 1 | commercial licen[sc]e
commercial | 1 | end user licen[sc]e agreement
commercial | 1 | proprietary licen[sc]e
proprietary | 0 | all rights reserved
CC-any | 0 | creative commons licen[sc]e
"""

#: The parts of Creative Commons licences, by abbreviation and by name; their versions.
COMMONS = {
    "CC-BY": ("by", "attribution"), "CC-BY-SA": ("by sa", "attribution share ?alike"), "CC-BY-NC": ("by nc", "attribution non ?commercial"), "CC-BY-ND": ("by nd", "attribution no ?deriv(ative)?s"),
    "CC-BY-NC-SA": ("by nc sa", "attribution non ?commercial share ?alike"), "CC-BY-NC-ND": ("by nc nd", "attribution non ?commercial no ?deriv(ative)?s"),
}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

ADDRESSES = r"""
MIT | 3 | opensource org licen[sc]es? mit
Apache-2.0 | 3 | apache org licenses license 2 0
Apache-2.0 | 3 | opensource org licen[sc]es? apache 2 0
GPL-3.0-only | 3 | gnu org licenses gpl 3 0
GPL-2.0-only | 3 | gnu org licenses( old licenses)? gpl 2 0
GPL-any | 2 | gnu org licenses gpl
LGPL-3.0-only | 3 | gnu org licenses lgpl 3 0
LGPL-2.1-only | 3 | gnu org licenses( old licenses)? lgpl 2 1
AGPL-3.0-only | 3 | gnu org licenses agpl 3 0
GFDL-1.3-only | 3 | gnu org licenses fdl 1 3
BSD-3-Clause | 3 | opensource org licen[sc]es? bsd 3 clause
BSD-2-Clause | 3 | opensource org licen[sc]es? bsd 2 clause
MPL-2.0 | 3 | mozilla org mpl 2 0
MPL-2.0 | 3 | opensource org licen[sc]es? mpl 2 0
EPL-2.0 | 3 | eclipse org legal epl( v)? ?2 0
BSL-1.0 | 3 | boost org license 1 0
CC0-1.0 | 3 | creativecommons org publicdomain zero 1 0
public-domain | 3 | creativecommons org publicdomain mark 1 0
"""


def lines_of(text: str) -> list[tuple[str, int, str]]:
    return [(a.strip(), int(b), c.strip()) for a, b, c in (line.split("|", 2) for line in text.strip().splitlines())]


def versioned(pattern: str) -> str:
    """@2.0 with the version's words: 2.0 and 2 are the same, 2.1 is not."""

    def words(m: re.Match) -> str:
        major, _, minor = m[1].partition(".")
        tail = "(?: 0)?(?! [0-9])" if minor in ("", "0") else f" {minor}"
        return f"(?: licen[sc]e)?(?: version| ver| v)? v?{major}{tail}"

    return re.sub(r"@([0-9]+(?:\.[0-9]+)?)", words, pattern)


def commons() -> list[tuple[str, int, str]]:
    out = []
    for label, (short, full) in COMMONS.items():
        for v in COMMONS_VERSIONS:
            number = v.replace(".", " ")
            out += [
                (f"{label}-{v}", 2, f"cc {short} {number}"), (f"{label}-{v}", 2, f"creative commons {full}( {number}| version {number}| v{number})"),
                (f"{label}-{v}", 2, f"creative commons {full}( licen[sc]e)?( version| v)? ?{number}"), (f"{label}-{v}", 3, f"creativecommons org licenses {short} {number}"),
            ]
        out += [(f"{label}-any", 1, f"cc {short}"), (f"{label}-any", 1, f"creative commons {full}( licen[sc]e)?")]
    return out


def identifiers(labels: list[str]) -> list[tuple[str, int, str]]:
    """SPDX lines of every label that names one licence."""
    words = lambda s: " ".join(re.findall("[a-z0-9]+", s.lower()))
    return [(x, 3, f"spdx license identifier {words(x)}") for x in labels if not x.endswith("-any") and x not in ("proprietary", "commercial", "public-domain", "RAIL", "Llama", "Gemma")]


def spelled_out(pattern: str) -> list[str]:
    """A pattern that may start with an optional word, once with and once without it."""
    if m := re.match(r"\(([a-z]+) \)\?(.*)", pattern):
        return [f"{m[1]} {m[2]}", m[2]]
    return [pattern]


def rules() -> list[tuple[str, str, int, str]]:
    """(keyword, label, priority, pattern) in order."""
    given = [*lines_of(WORDING), *lines_of(NAMES), *commons(), *lines_of(ADDRESSES)]
    given += identifiers(sorted({label for label, _, _ in given}))
    out = []
    for label, priority, pattern in given:
        for p in spelled_out(versioned(pattern)):
            out.append((re.match("[a-z0-9]+", p)[0], label, priority, f"^(?:{p})(?= |$)"))
    return out
