"""Signatures of licences: one line a rule family, written by hand.

A line is `label | priority | weight | keywords | pattern`, over words in lower case joined by single spaces. One of the
keywords (parted by `/`) must be a word of a text before the pattern is tried, and every match of the pattern holds one. Priority 1 is the strongest. In patterns
a blank is one word boundary; `(?:...)?` with its blank inside makes words optional. `{a/b/c}` makes one rule for each
alternative, also in the label.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

#: Phrases and labels that the contract fixes.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

RULES = """
{mit/isc/zlib/unlicense/wtfpl/x11/ntp/beerware} | 1 | 1.0 | spdx | spdx license identifier {mit/isc/zlib/unlicense/wtfpl/x11/ntp/beerware}
apache-{1 0/1 1/2 0} | 1 | 1.0 | spdx | spdx license identifier apache {1 0/1 1/2 0}
gpl-{1/2/3}.0 | 1 | 1.0 | spdx | spdx license identifier gpl {1/2/3} 0(?: only)?
gpl-{1/2/3}.0-or-later | 1 | 1.0 | spdx | spdx license identifier gpl {1/2/3} 0 or later
lgpl-{2 0/2 1/3 0} | 1 | 1.0 | spdx | spdx license identifier lgpl {2 0/2 1/3 0}(?: only| or later)?
agpl-3 0 | 1 | 1.0 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
bsd-{2/3/4}-clause | 1 | 1.0 | spdx | spdx license identifier bsd {2/3/4} clause
mpl-{1 0/1 1/2 0} | 1 | 1.0 | spdx | spdx license identifier mpl {1 0/1 1/2 0}
epl-{1 0/2 0} | 1 | 1.0 | spdx | spdx license identifier epl {1 0/2 0}
cc0-1 0 | 1 | 1.0 | spdx | spdx license identifier cc0 1 0
cc-{by/by sa/by nc/by nd/by nc sa/by nc nd}-{1 0/2 0/2 5/3 0/4 0} | 1 | 1.0 | spdx | spdx license identifier cc {by/by sa/by nc/by nd/by nc sa/by nc nd} {1 0/2 0/2 5/3 0/4 0}
gpl-{1/2/3}.0-or-later | 2 | 1.0 | gnu | gnu general public license(?: as published by the free software foundation)?(?: either)? (?:v|version )?{1/2/3}(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-{1/2/3}.0 | 3 | 0.9 | gnu | gnu general public license(?: as published by the free software foundation)?(?: either)? (?:v|version )?{1/2/3}(?: 0)?
lgpl-{2/3}.0-or-later | 2 | 1.0 | gnu | gnu (?:lesser|library) general public license(?: as published by the free software foundation)?(?: either)? (?:v|version )?{2/3}(?: 0)?(?: of the license)? or (?:at your option )?any later version
lgpl-2.1-or-later | 2 | 1.0 | gnu | gnu (?:lesser|library) general public license(?: as published by the free software foundation)?(?: either)? (?:v|version )?2 1(?: of the license)? or (?:at your option )?any later version
lgpl-{2/3}.0 | 3 | 0.9 | gnu | gnu (?:lesser|library) general public license(?: as published by the free software foundation)?(?: either)? (?:v|version )?{2/3}(?: 0)?
lgpl-2.1 | 3 | 0.9 | gnu | gnu (?:lesser|library) general public license(?: as published by the free software foundation)?(?: either)? (?:v|version )?2 1
lgpl | 4 | 0.7 | gnu | gnu (?:lesser|library) general public license
agpl-3.0 | 3 | 0.9 | affero | gnu affero general public license (?:v|version )?3(?: 0)?
agpl | 4 | 0.7 | affero | (?:gnu )?affero general public license
gfdl-{1 1/1 2/1 3} | 3 | 0.9 | gnu | gnu free documentation license (?:v|version )?{1 1/1 2/1 3}
gfdl | 4 | 0.7 | gnu | gnu free documentation license
gpl | 5 | 0.6 | gnu | gnu general public license
gpl-{1/2/3}.0 | 4 | 0.7 | gpl/gplv1/gplv2/gplv3 | gpl ?v{1/2/3}(?: 0)?
lgpl-{2/3}.0 | 4 | 0.7 | lgpl/lgplv2/lgplv3 | lgpl ?v{2/3}(?: 0)?
lgpl-2.1 | 4 | 0.7 | lgpl/lgplv2 | lgpl ?v2 1
agpl-3.0 | 4 | 0.7 | agpl/agplv3 | agpl ?v3(?: 0)?
gpl | 6 | 0.4 | gpl | (?:gnu )?gpl(?: license| licence)
lgpl | 6 | 0.4 | lgpl | (?:gnu )?lgpl(?: license| licence)
agpl | 6 | 0.4 | agpl | (?:gnu )?agpl(?: license| licence)
gpl-exception-{classpath/bison/autoconf/libtool/gcc runtime library/font/linking/openssl} | 2 | 0.9 | exception | (?:special )?{classpath/bison/autoconf/libtool/gcc runtime library/font/linking/openssl} exception
apache-{1 0/1 1/2 0} | 2 | 1.0 | apache | apache license (?:v|version )?{1 0/1 1/2 0}
apache-2 0 | 1 | 1.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-{1 0/1 1/2 0} | 3 | 0.8 | apache | apache(?: software)?(?: license| licence)? (?:v|version )?{1 0/1 1/2 0}
apache | 5 | 0.6 | apache | apache(?: software)? (?:license|licence)
asl-{1 0/1 1/2 0} | 5 | 0.5 | asl | asl (?:v|version )?{1 0/1 1/2 0}
mit | 1 | 1.0 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 3 | 0.9 | mit | (?:released|licensed|distributed|available) under the(?: terms of the)? mit (?:license|licence)
mit | 5 | 0.6 | mit | (?:the )?mit (?:license|licence)
mit-0 | 4 | 0.8 | mit | mit no attribution
mit-{x11/expat/modern variant} | 4 | 0.8 | mit | mit {x11/expat/modern variant}(?: license)?
expat | 5 | 0.6 | expat | expat (?:license|licence)
x11 | 5 | 0.6 | x11 | x11 (?:license|licence)
isc | 1 | 1.0 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 5 | 0.6 | isc | isc (?:license|licence)
0bsd | 3 | 0.9 | zero | zero clause bsd(?: license)?
0bsd | 4 | 0.8 | 0bsd | 0bsd
bsd | 1 | 1.0 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-{2/3/4}-clause | 3 | 0.9 | clause | (?:bsd {2/3/4} clause|{2/3/4} clause bsd)(?: license)?
bsd-{simplified/new/original/modified/revised} | 3 | 0.8 | bsd | {simplified/new/original/modified/revised} bsd(?: license)?
bsd | 5 | 0.5 | bsd | bsd(?: style)? (?:license|licence)
mpl-{1 0/1 1/2 0} | 2 | 1.0 | mozilla | mozilla public license (?:v|version )?{1 0/1 1/2 0}
mpl-2 0 | 1 | 1.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl | 5 | 0.6 | mozilla | mozilla public license
npl | 5 | 0.6 | netscape | netscape public license
epl-{1 0/2 0} | 2 | 1.0 | eclipse | eclipse public license (?:v|version )?{1 0/2 0}
epl | 5 | 0.6 | eclipse | eclipse public license
edl-1 0 | 3 | 0.9 | eclipse | eclipse distribution license
cddl-{1 0/1 1} | 2 | 1.0 | cddl | cddl (?:v|version )?{1 0/1 1}
cddl | 5 | 0.6 | common | common development and distribution license
cpl | 5 | 0.6 | common | common public license
cpal | 5 | 0.6 | common | common public attribution license
eupl-{1 0/1 1/1 2} | 3 | 0.9 | european | european union public (?:license|licence) (?:v|version )?{1 0/1 1/1 2}
eupl | 5 | 0.6 | european | european union public (?:license|licence)
cecill-{1 0/1 1/2 0/2 1/b/c} | 4 | 0.8 | cecill | cecill (?:v|version )?{1 0/1 1/2 0/2 1/b/c}
boost-1 0 | 2 | 1.0 | boost | boost software license (?:v|version )?1 0
boost | 5 | 0.6 | boost | boost software license
zlib | 1 | 1.0 | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 5 | 0.6 | zlib | zlib (?:license|licence)
libpng | 5 | 0.6 | libpng | libpng (?:license|licence)
openssl | 5 | 0.6 | openssl | openssl (?:license|licence)
curl | 5 | 0.5 | curl | curl (?:license|licence)
python-2 0 | 4 | 0.7 | python | python software foundation license(?: version 2)?
artistic-{1 0/2 0} | 3 | 0.9 | artistic | artistic license (?:v|version )?{1 0/2 0}
artistic | 5 | 0.6 | artistic | artistic license
ruby | 5 | 0.5 | ruby | ruby (?:license|licence)
php-{3 0/3 01} | 4 | 0.8 | php | php license (?:v|version )?{3 0/3 01}
php | 5 | 0.5 | php | php license
perl | 4 | 0.7 | perl | same terms as perl(?: itself)?
unlicense | 1 | 1.0 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 5 | 0.6 | unlicense | the unlicense
wtfpl | 4 | 0.8 | fuck | do what the fuck you want to public license
beerware | 4 | 0.8 | beer/beerware | beer ?ware license
json | 3 | 0.8 | evil | the software shall be used for good not evil
public-domain | 4 | 0.7 | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
cc0-1 0 | 3 | 0.9 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0 | 3 | 0.9 | creative | creative commons (?:zero|cc0)
cc-by | 4 | 0.8 | creative | creative commons attribution(?: international| unported| generic)?
cc-by-sa | 3 | 0.9 | creative | creative commons attribution(?: sharealike| share alike)
cc-by-nc | 3 | 0.9 | creative | creative commons attribution (?:noncommercial|non commercial)
cc-by-nc-sa | 3 | 0.9 | creative | creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)
cc-by-nc-nd | 3 | 0.9 | creative | creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives)
cc-by-nd | 3 | 0.9 | creative | creative commons attribution (?:noderivatives|noderivs|no derivatives)
cc | 6 | 0.4 | creative | creative commons (?:license|licence)
cc-{by sa/by nc/by nd/by nc sa/by nc nd}-{1 0/2 0/2 5/3 0/4 0} | 2 | 1.0 | cc | cc {by sa/by nc/by nd/by nc sa/by nc nd} (?:v|version )?{1 0/2 0/2 5/3 0/4 0}
cc-{by sa/by nc/by nd/by nc sa/by nc nd} | 3 | 0.8 | cc | cc {by sa/by nc/by nd/by nc sa/by nc nd}
cc-by-{1 0/2 0/2 5/3 0/4 0} | 3 | 0.9 | cc | cc by (?:v|version )?{1 0/2 0/2 5/3 0/4 0}
cc-by | 5 | 0.6 | cc | cc by
ofl-1 1 | 3 | 0.9 | sil | sil open font license(?: version)?(?: 1 1)?
odbl | 4 | 0.8 | database | open (?:data commons )?(?:open )?database license
odc-by | 4 | 0.8 | commons | open data commons attribution license
pddl | 4 | 0.8 | commons | (?:open data commons )?public domain dedication and (?:license|licence)
ogl-{1 0/2 0/3 0} | 4 | 0.8 | government | open government licence v ?{1 0/2 0/3 0}
ms-{pl/rl} | 4 | 0.7 | ms | ms {pl/rl}
ms-{public/reciprocal/limited public} | 4 | 0.8 | microsoft | microsoft {public/reciprocal/limited public} license
apsl | 4 | 0.8 | apple | apple public source license
ipl | 4 | 0.8 | ibm | ibm public license
qpl | 4 | 0.8 | public | q public license
spl | 4 | 0.8 | sun | sun public license
osl-{1 0/2 0/2 1/3 0} | 4 | 0.8 | open | open software license (?:v|version )?{1 0/2 0/2 1/3 0}
afl-{1 2/2 0/2 1/3 0} | 4 | 0.8 | academic | academic free license (?:v|version )?{1 2/2 0/2 1/3 0}
ecl-2 0 | 4 | 0.8 | educational | educational community license
upl | 4 | 0.7 | universal | universal permissive license
postgresql | 4 | 0.7 | postgresql | postgresql (?:license|licence)
ncsa | 4 | 0.7 | ncsa | (?:university of illinois )?ncsa open source license
vim | 5 | 0.5 | vim | vim license
sspl | 3 | 0.9 | server | server side public license
busl | 3 | 0.9 | business | business source license
elastic | 3 | 0.9 | elastic | elastic license(?: 2 0)?
commons-clause | 3 | 0.9 | clause | commons clause(?: license condition)?
polyform-{noncommercial/small business/shield/strict/perimeter} | 4 | 0.8 | polyform | polyform {noncommercial/small business/shield/strict/perimeter} license
openrail | 4 | 0.8 | openrail | (?:creativeml |bigscience )?openrail(?: m)?(?: license)?
llama-community | 4 | 0.8 | community | llama (?:2|3|3 1|3 2)? ?community license
proprietary | 4 | 0.6 | proprietary | proprietary and confidential
proprietary | 5 | 0.5 | reserved | all rights reserved
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: str


def rules(text: str = RULES) -> list[Rule]:
    """A rule for each line, or for each choice of alternatives: a brace with the same alternatives takes the same choice."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        label, priority, weight, keyword, pattern = (part.strip() for part in line.split(" | "))
        braces = list(dict.fromkeys(re.findall(r"\{[^}]*\}", pattern)))
        for choice in product(*(b[1:-1].split("/") for b in braces)):
            name, pat = label, pattern
            for brace, took in zip(braces, choice, strict=True):
                name, pat = name.replace(brace, took), pat.replace(brace, took)
            out.append(Rule(re.sub(r"(?<=\d) (?=\d)", ".", name).replace(" ", "-"), int(priority), float(weight), tuple(keyword.split("/")), pat))
    return out
