"""Signatures of licence texts, as patterns over lower-case words that single spaces part.

A line of NAMES: label | SPDX id or - | v (the pattern names a version) or n | keyword | pattern.  Every match of the
pattern has the keyword as a word.  ~ stands for the word license or licence.  Each name gives a rule for the name alone, one for
a notice that puts something under it, and one for its SPDX line where it has an id.
"""

from __future__ import annotations

from typing import NamedTuple

NAMES = r"""
gpl-1.0 | gpl-1.0 | v | gnu | gnu general public ~ (?:as published by the free software foundation )?(?:either )?(?:version 1|v1)(?: 0)?
gpl-2.0 | gpl-2.0 | v | gnu | gnu general public ~ (?:as published by the free software foundation )?(?:either )?(?:version 2|v2)(?: 0)?
gpl-3.0 | gpl-3.0 | v | gnu | gnu general public ~ (?:as published by the free software foundation )?(?:either )?(?:version 3|v3)(?: 0)?
gpl-2.0-or-later | - | v | gnu | gnu general public ~ (?:as published by the free software foundation )?(?:either )?(?:version 2|v2)(?: 0)?(?: of the ~)? or (?:at your option )?any later version
gpl-3.0-or-later | - | v | gnu | gnu general public ~ (?:as published by the free software foundation )?(?:either )?(?:version 3|v3)(?: 0)?(?: of the ~)? or (?:at your option )?any later version
gpl | - | n | gnu | gnu (?:general public ~|gpl)
gpl-2.0 | - | v | gpl | gpl (?:version 2|v2|2)(?: 0)?(?: only)?
gpl-3.0 | - | v | gpl | gpl (?:version 3|v3|3)(?: 0)?(?: only)?
gpl-2.0 | - | v | gplv2 | gplv2
gpl-3.0 | - | v | gplv3 | gplv3
lgpl-2.0 | lgpl-2.0 | v | gnu | gnu library general public ~ (?:version 2|v2)(?: 0)?
lgpl-2.1 | lgpl-2.1 | v | gnu | gnu lesser general public ~ (?:as published by the free software foundation )?(?:either )?(?:version 2|v2) 1
lgpl-3.0 | lgpl-3.0 | v | gnu | gnu lesser general public ~ (?:as published by the free software foundation )?(?:either )?(?:version 3|v3)(?: 0)?
lgpl | - | n | gnu | gnu (?:lesser|library) (?:general )?public ~
lgpl-2.1 | - | v | lgpl | lgpl (?:version 2|v2|2) 1
lgpl-3.0 | - | v | lgpl | lgpl (?:version 3|v3|3)(?: 0)?
lgpl-3.0 | - | v | lgplv3 | lgplv3
agpl-3.0 | agpl-3.0 | v | affero | (?:gnu )?affero general public ~ (?:version 3|v3)(?: 0)?
agpl-1.0 | agpl-1.0 | v | affero | affero general public ~ (?:version 1|v1)(?: 0)?
agpl | - | n | affero | (?:gnu )?affero (?:general public ~|gpl)
agpl-3.0 | - | v | agplv3 | agplv3
gfdl-1.1 | gfdl-1.1 | v | gnu | gnu free documentation ~ (?:version 1|v1) 1
gfdl-1.2 | gfdl-1.2 | v | gnu | gnu free documentation ~ (?:version 1|v1) 2
gfdl-1.3 | gfdl-1.3 | v | gnu | gnu free documentation ~ (?:version 1|v1) 3
gfdl | - | n | gnu | gnu free documentation ~
apache-1.0 | apache-1.0 | v | apache | apache (?:software )?~ (?:version |v)?1 0
apache-1.1 | apache-1.1 | v | apache | apache (?:software )?~ (?:version |v)?1 1
apache-2.0 | apache-2.0 | v | apache | apache (?:software )?~ (?:version 2|v2|2)(?: 0)?
apache-2.0 | - | v | apache | (?:www )?apache org licenses license 2 0
apache | - | n | apache | apache (?:software )?~
mit | mit | n | mit | mit(?: x11| expat)? ~
mit-0 | mit-0 | v | mit | mit (?:0|no attribution)(?: ~)?
mit | - | n | expat | expat ~
x11 | x11 | n | x11 | x11 ~
mit | - | n | granted | permission is hereby granted free of charge to any person obtaining a copy
isc | isc | n | isc | isc ~
isc | - | n | distribute | permission to use copy modify and or distribute this software for any purpose
bsd-1-clause | bsd-1-clause | v | bsd | bsd 1 clause(?: ~)?
bsd-2-clause | bsd-2-clause | v | bsd | (?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd style bsd|two clause bsd)(?: ~)?
bsd-3-clause | bsd-3-clause | v | bsd | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: ~)?
bsd-4-clause | bsd-4-clause | v | bsd | (?:original bsd|old bsd|bsd 4 clause|4 clause bsd)(?: ~)?
0bsd | 0bsd | n | 0bsd | 0bsd
0bsd | - | n | bsd | zero clause bsd(?: ~)?
bsd | - | n | bsd | bsd(?: style)? ~
bsd | - | n | redistribution | redistribution and use in source and binary forms with or without modification are permitted
freebsd-doc | freebsd-doc | n | freebsd | freebsd documentation ~
cc-by-1.0 | cc-by-1.0 | v | cc | cc by 1 0
cc-by-2.0 | cc-by-2.0 | v | cc | cc by 2 0
cc-by-2.5 | cc-by-2.5 | v | cc | cc by 2 5
cc-by-3.0 | cc-by-3.0 | v | cc | cc by 3 0
cc-by-4.0 | cc-by-4.0 | v | cc | cc by 4 0
cc-by-sa-2.0 | cc-by-sa-2.0 | v | cc | cc by sa 2 0
cc-by-sa-3.0 | cc-by-sa-3.0 | v | cc | cc by sa 3 0
cc-by-sa-4.0 | cc-by-sa-4.0 | v | cc | cc by sa 4 0
cc-by-nd-3.0 | cc-by-nd-3.0 | v | cc | cc by nd 3 0
cc-by-nd-4.0 | cc-by-nd-4.0 | v | cc | cc by nd 4 0
cc-by-nc-3.0 | cc-by-nc-3.0 | v | cc | cc by nc 3 0
cc-by-nc-4.0 | cc-by-nc-4.0 | v | cc | cc by nc 4 0
cc-by-nc-sa-3.0 | cc-by-nc-sa-3.0 | v | cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc-by-nc-sa-4.0 | v | cc | cc by nc sa 4 0
cc-by-nc-nd-3.0 | cc-by-nc-nd-3.0 | v | cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc-by-nc-nd-4.0 | v | cc | cc by nc nd 4 0
cc-by-nc-nd | - | n | cc | cc by nc nd
cc-by-nc-sa | - | n | cc | cc by nc sa
cc-by-nc | - | n | cc | cc by nc
cc-by-nd | - | n | cc | cc by nd
cc-by-sa | - | n | cc | cc by sa
cc-by | - | n | cc | cc by
cc0-1.0 | cc0-1.0 | v | cc0 | cc0 1 0(?: universal)?
cc0 | - | n | cc0 | cc0
cc0 | - | n | creativecommons | creativecommons org publicdomain zero 1 0
cc-by-nc-nd | - | n | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc-sa | - | n | creative | creative commons attribution non ?commercial share ?alike
cc-by-nc | - | n | creative | creative commons attribution non ?commercial
cc-by-nd | - | n | creative | creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa | - | n | creative | creative commons attribution share ?alike
cc-by-4.0 | - | v | creative | creative commons attribution 4 0(?: international)?(?: ~)?
cc-by-3.0 | - | v | creative | creative commons attribution 3 0(?: unported)?(?: ~)?
cc-by | - | n | creative | creative commons attribution(?: ~)?
cc-by-nc-nd | - | n | creativecommons | creativecommons org licenses by nc nd
cc-by-nc-sa | - | n | creativecommons | creativecommons org licenses by nc sa
cc-by-nc | - | n | creativecommons | creativecommons org licenses by nc
cc-by-nd | - | n | creativecommons | creativecommons org licenses by nd
cc-by-sa | - | n | creativecommons | creativecommons org licenses by sa
cc-by | - | n | creativecommons | creativecommons org licenses by
mpl-1.0 | mpl-1.0 | v | mozilla | mozilla public ~ (?:version |v)?1 0
mpl-1.1 | mpl-1.1 | v | mozilla | mozilla public ~ (?:version |v)?1 1
mpl-2.0 | mpl-2.0 | v | mozilla | mozilla public ~ (?:version 2|v2|2)(?: 0)?
mpl | - | n | mozilla | mozilla public ~
npl-1.1 | npl-1.1 | v | netscape | netscape public ~ (?:version |v)?1 1
epl-1.0 | epl-1.0 | v | eclipse | eclipse public ~ (?:version |v)?1 0
epl-2.0 | epl-2.0 | v | eclipse | eclipse public ~ (?:version 2|v2|2)(?: 0)?
epl | - | n | eclipse | eclipse public ~
edl | - | n | eclipse | eclipse distribution ~
cpl-1.0 | cpl-1.0 | n | common | common public ~
cddl-1.0 | cddl-1.0 | v | development | common development and distribution ~ (?:version |v)?1 0
cddl-1.1 | cddl-1.1 | v | development | common development and distribution ~ (?:version |v)?1 1
cddl | - | n | development | common development and distribution ~
eupl-1.1 | eupl-1.1 | v | european | european union public ~ (?:version |v)?1 1
eupl-1.2 | eupl-1.2 | v | european | european union public ~ (?:version |v)?1 2
eupl | - | n | european | european union public ~
artistic-1.0 | artistic-1.0 | v | artistic | artistic ~ (?:version |v)?1 0
artistic-2.0 | artistic-2.0 | v | artistic | artistic ~ (?:version 2|v2|2)(?: 0)?
artistic | - | n | artistic | (?:the )?(?:perl )?artistic ~
psf-2.0 | psf-2.0 | n | python | python software foundation ~(?: version 2)?
python-2.0 | python-2.0 | n | python | python ~(?: 2 0)?
ruby | ruby | n | ruby | ruby ~
php-3.01 | php-3.01 | v | php | php ~ (?:version |v)?3 01
php | - | n | php | php ~
zlib | zlib | n | zlib | zlib(?: libpng)? ~
libpng | libpng | n | libpng | libpng ~
openssl | openssl | n | openssl | openssl ~
curl | curl | n | curl | curl ~
boost-1.0 | bsl-1.0 | n | boost | boost software ~(?: (?:version |v)?1 0)?
wtfpl | wtfpl | n | wtfpl | wtfpl
unlicense | unlicense | n | unlicense | (?:the )?unlicense
unlicense | - | n | unencumbered | this is free and unencumbered software released into the public domain
postgresql | postgresql | n | postgresql | postgresql ~
vim | vim | n | vim | vim ~
w3c | w3c | n | w3c | w3c software(?: notice and)? ~
ofl-1.1 | ofl-1.1 | n | sil | sil open font ~(?: (?:version |v)?1 1)?
odbl-1.0 | odbl-1.0 | n | database | open (?:data commons open )?database ~(?: (?:version |v)?1 0)?
odc-by-1.0 | odc-by-1.0 | n | commons | open data commons attribution ~
pddl-1.0 | pddl-1.0 | n | domain | public domain dedication and ~
ms-pl | ms-pl | n | microsoft | microsoft public ~
ms-rl | ms-rl | n | microsoft | microsoft reciprocal ~
ecl-2.0 | ecl-2.0 | n | educational | educational community ~(?: (?:version |v)?2 0)?
afl-3.0 | afl-3.0 | n | academic | academic free ~(?: (?:version |v)?3 0)?
osl-3.0 | osl-3.0 | n | open | open software ~(?: (?:version |v)?3 0)?
qpl-1.0 | qpl-1.0 | n | q | q public ~
ipl-1.0 | ipl-1.0 | n | ibm | ibm public ~
apsl-2.0 | apsl-2.0 | n | apple | apple public source ~
upl-1.0 | upl-1.0 | n | universal | universal permissive ~
mulan-psl-2.0 | mulanpsl-2.0 | n | mulan | mulan permissive software ~(?: (?:version 2|v2))?
sspl-1.0 | sspl-1.0 | n | server | server side public ~
busl-1.1 | busl-1.1 | n | business | business source ~
elastic-2.0 | elastic-2.0 | n | elastic | elastic ~(?: (?:version 2|v2|2)(?: 0)?)?
blueoak-1.0.0 | blueoak-1.0.0 | n | oak | blue oak model ~
ncsa | ncsa | n | ncsa | (?:university of illinois )?ncsa open source ~
hpnd | hpnd | n | historical | historical permission notice and disclaimer
ntp | ntp | n | ntp | ntp ~
"""

# patterns of no single licence, with their keywords
GENERIC = r"""
public-domain | domain | (?:released into|dedicated to|placed in|in) the public domain
all-rights-reserved | reserved | all rights reserved
proprietary | proprietary | (?:proprietary and confidential|proprietary ~)
non-commercial | commercial | (?:for )?non commercial use only
free-software | software | this (?:program|software|library) is free software
open-source | source | (?:an )?open source ~
no-warranty | warranty | without warranty of any kind
"""

NOTICE = r"(?:licensed|released|distributed|redistributed|published|provided|available|covered|governed) (?:to you )?(?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
SPDX, UNDER, VERSIONED, NAMED, OTHER = range(5)  # priority levels: the first wins
CONFIDENCE = {SPDX: 1.0, UNDER: 0.95, VERSIONED: 0.9, NAMED: 0.8, OTHER: 0.5}


class Rule(NamedTuple):
    place: int
    level: int
    label: str
    keyword: str
    pattern: str  # over ' w0  w1  w2 ', the words of the match in group 1; the same in Java, RE2 and Python


def _over_words(body: str) -> str:
    """Two spaces part the words, so that neighbouring matches each have a space of their own on both sides."""
    return f" ({body.replace('~', 'licen[cs]e').replace('non ?', 'non(?: )?').replace('no ?', 'no(?: )?').replace('share ?', 'share(?: )?').replace(' ', '  ')}) "


def rules() -> list[Rule]:
    """All rules, in order."""
    found = []
    for line in NAMES.strip().splitlines():
        label, spdx, kind, keyword, body = (x.strip() for x in line.split(" | "))
        if spdx != "-":
            words = spdx.replace("-", " ").replace(".", " ")
            found.append((SPDX, label, "spdx", rf"spdx license identifier {words}(?: only| or later)?"))
        found.append((UNDER, label, keyword, NOTICE + f"(?:{body})"))
        found.append((VERSIONED if kind == "v" else NAMED, label, keyword, body))
    for line in GENERIC.strip().splitlines():
        label, keyword, body = (x.strip() for x in line.split(" | "))
        found.append((OTHER, label, keyword, body))
    found.sort(key=lambda r: r[0])  # stable: as written within a level
    return [Rule(k, level, label, keyword, _over_words(body)) for k, (level, label, keyword, body) in enumerate(found)]
