"""Ordered signature rules for licence texts, over lower-cased text.

A rule has a label, a priority (1 is strongest), a weight, keywords parted by ";", and a regular
expression that is tried on texts that hold one of them.  In it a space stands for a run of white space.  Every licence gives rules for its
SPDX tag, for a grant ("licensed under ..."), for its name, and for its address where it has one;
general notices follow.
"""

from __future__ import annotations

# SPDX identifier | regular expression of the name | keyword of the name | address (or -) | keyword of the address
LICENCES = r"""
0bsd | (?:zero[- ]clause bsd|bsd zero clause|0bsd) | bsd | opensource\.org/licen[cs]es/0bsd | licen
afl-3.0 | academic free licen[cs]e(?:,? (?:version|v\.?) ?3(?:\.0)?)? | academic free | opensource\.org/licen[cs]es/afl-3\.0 | licen
agpl-3.0 | (?:gnu )?affero general public licen[cs]e(?:,? (?:version|v\.?) ?3(?:\.0)?)? | affero | gnu\.org/licen[cs]es/agpl(?:-3\.0)? | licen
apache-1.1 | apache (?:software )?licen[cs]e,? (?:version |v\.?)?1\.1 | apache | apache\.org/licen[cs]es/license-1\.1 | licen
apache-2.0 | apache (?:software )?licen[cs]e,? (?:version |v\.?)?2(?:\.0)? | apache | apache\.org/licen[cs]es/license-2\.0 | licen
apsl-2.0 | apple public source licen[cs]e | apple public | opensource\.apple\.com/license/apsl | licen
artistic-2.0 | artistic licen[cs]e(?:,? (?:version |v\.?)?2(?:\.0)?)? | artistic | perlfoundation\.org/artistic_license_2_0 | licen
blueoak-1.0.0 | blue oak model licen[cs]e | blue oak | blueoakcouncil\.org/licen[cs]e/1\.0\.0 | licen
bsd-2-clause | (?:bsd 2[- ]clause|2[- ]clause bsd|simplified bsd|freebsd) licen[cs]e | bsd | opensource\.org/licen[cs]es/bsd-2-clause | licen
bsd-3-clause | (?:bsd 3[- ]clause|3[- ]clause bsd|new bsd|revised bsd|modified bsd) licen[cs]e | bsd | opensource\.org/licen[cs]es/bsd-3-clause | licen
bsd-4-clause | (?:bsd 4[- ]clause|4[- ]clause bsd|original bsd) licen[cs]e | bsd | - | -
bsl-1.0 | boost software licen[cs]e(?: -)?(?:,? (?:version |v\.?)?1\.0)? | boost | boost\.org/license_1_0 | licen
busl-1.1 | business source licen[cs]e(?:,? (?:version |v\.?)?1\.1)? | business source | mariadb\.com/bsl11 | mariadb
cc-by-3.0 | (?:creative commons attribution 3\.0|cc[- ]by[- ]3\.0) | cc by;cc-by;creative commons | creativecommons\.org/licen[cs]es/by/3\.0 | creativecommons
cc-by-4.0 | (?:creative commons attribution 4\.0|cc[- ]by[- ]4\.0) | cc by;cc-by;creative commons | creativecommons\.org/licen[cs]es/by/4\.0 | creativecommons
cc-by-nc-4.0 | (?:creative commons attribution[- ]non-?commercial(?: 4\.0)?|cc[- ]by[- ]nc(?:[- ]4\.0)?)(?![- ](?:sa|nd|share|no)) | cc by;cc-by;creative commons | creativecommons\.org/licen[cs]es/by-nc/4\.0 | creativecommons
cc-by-nc-nd-4.0 | (?:creative commons attribution[- ]non-?commercial[- ]no-?derivatives(?: 4\.0)?|cc[- ]by[- ]nc[- ]nd(?:[- ]4\.0)?) | cc by;cc-by;creative commons | creativecommons\.org/licen[cs]es/by-nc-nd/4\.0 | creativecommons
cc-by-nc-sa-4.0 | (?:creative commons attribution[- ]non-?commercial[- ]share-?alike(?: 4\.0)?|cc[- ]by[- ]nc[- ]sa(?:[- ]4\.0)?) | cc by;cc-by;creative commons | creativecommons\.org/licen[cs]es/by-nc-sa/4\.0 | creativecommons
cc-by-nd-4.0 | (?:creative commons attribution[- ]no-?derivatives(?: 4\.0)?|cc[- ]by[- ]nd(?:[- ]4\.0)?) | cc by;cc-by;creative commons | creativecommons\.org/licen[cs]es/by-nd/4\.0 | creativecommons
cc-by-sa-4.0 | (?:creative commons attribution[- ]share-?alike(?: 4\.0)?|cc[- ]by[- ]sa(?:[- ]4\.0)?) | cc by;cc-by;creative commons | creativecommons\.org/licen[cs]es/by-sa/4\.0 | creativecommons
cc0-1.0 | (?:cc0(?: 1\.0)?(?: universal)?|creative commons zero) | cc0;creative commons | creativecommons\.org/publicdomain/zero/1\.0 | creativecommons
cddl-1.0 | common development and distribution licen[cs]e | common development | opensource\.org/licen[cs]es/cddl-1\.0 | licen
cecill-2.1 | cecill(?: free software licen[cs]e)?(?: agreement)? | cecill | cecill\.info/licen[cs]es | cecill
cpl-1.0 | common public licen[cs]e(?: version)?(?: 1\.0)? | common public | opensource\.org/licen[cs]es/cpl1\.0 | licen
ecl-2.0 | educational community licen[cs]e | educational community | opensource\.org/licen[cs]es/ecl-2\.0 | licen
epl-1.0 | eclipse public licen[cs]e(?: -)?,? (?:version |v\.? ?)?1\.0 | eclipse | eclipse\.org/legal/epl-v10 | eclipse
epl-2.0 | eclipse public licen[cs]e(?: -)?,? (?:version |v\.? ?)?2\.0 | eclipse | eclipse\.org/legal/epl-2\.0 | eclipse
etalab-2.0 | (?:etalab open licen[cs]e|licence ouverte) | licen | etalab\.gouv\.fr/licence-ouverte | licen
eupl-1.2 | european union public licen[cs]e | european union public | joinup\.ec\.europa\.eu/.{0,40}eupl | eupl
gfdl-1.3 | gnu free documentation licen[cs]e | free documentation | gnu\.org/licen[cs]es/fdl | licen
gpl-2.0 | (?:gnu )?general public licen[cs]e,? (?:\(gpl\) )?(?:version |v\.? ?)2(?:\.0)? | general public | gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?gpl-2\.0 | licen
gpl-3.0 | (?:gnu )?general public licen[cs]e,? (?:\(gpl\) )?(?:version |v\.? ?)3(?:\.0)? | general public | gnu\.org/licen[cs]es/gpl(?:-3\.0)? | licen
hpnd | historical permission notice and disclaimer | historical permission | opensource\.org/licen[cs]es/hpnd | licen
ipl-1.0 | ibm public licen[cs]e | ibm public | opensource\.org/licen[cs]es/ipl-1\.0 | licen
isc | isc licen[cs]e | isc licen | opensource\.org/licen[cs]es/isc | licen
json | the software shall be used for good, not evil | evil | json\.org/license | json
lgpl-2.1 | (?:gnu )?(?:lesser|library) general public licen[cs]e,? (?:version |v\.? ?)2(?:\.1)? | general public | gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?lgpl-2\.1 | licen
lgpl-3.0 | (?:gnu )?lesser general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)? | lesser | gnu\.org/licen[cs]es/lgpl(?:-3\.0)? | licen
lppl-1.3c | latex project public licen[cs]e | latex project | latex-project\.org/lppl | lppl
mit | (?:mit|expat|x11) licen[cs]e | licen | opensource\.org/licen[cs]es/mit | licen
mit-0 | mit no attribution | no attribution | github\.com/aws/mit-0 | mit-0
mpl-1.1 | mozilla public licen[cs]e,? (?:version |v\.? ?)1\.1 | mozilla | mozilla\.org/mpl/(?:mpl-)?1\.1 | mozilla
mpl-2.0 | mozilla public licen[cs]e,? (?:version |v\.? ?)2\.0 | mozilla | mozilla\.org/(?:en-us/)?mpl/2\.0 | mozilla
ms-pl | microsoft public licen[cs]e | microsoft public | opensource\.org/licen[cs]es/ms-pl | licen
ms-rl | microsoft reciprocal licen[cs]e | microsoft reciprocal | opensource\.org/licen[cs]es/ms-rl | licen
mulanpsl-2.0 | mulan permissive software licen[cs]e | mulan | license\.coscl\.org\.cn/mulanpsl2 | mulan
ncsa | university of illinois/ncsa open source licen[cs]e | ncsa | opensource\.org/licen[cs]es/ncsa | licen
odbl-1.0 | (?:open (?:data commons )?open )?database licen[cs]e | database licen | opendatacommons\.org/licen[cs]es/odbl | licen
odc-by-1.0 | open data commons attribution licen[cs]e | open data commons | opendatacommons\.org/licen[cs]es/by | licen
ofl-1.1 | sil open font licen[cs]e | open font | scripts\.sil\.org/ofl | sil.org
openssl | openssl licen[cs]e | openssl | openssl\.org/source/license | openssl
osl-3.0 | open software licen[cs]e | open software | opensource\.org/licen[cs]es/osl-3\.0 | licen
pddl-1.0 | public domain dedication (?:and|&) licen[cs]e | public domain | opendatacommons\.org/licen[cs]es/pddl | licen
php-3.01 | php licen[cs]e | php licen | php\.net/license | php
postgresql | postgresql licen[cs]e | postgresql | opensource\.org/licen[cs]es/postgresql | licen
psf-2.0 | python software foundation licen[cs]e | python software | docs\.python\.org/.{0,10}license | licen
qpl-1.0 | q public licen[cs]e | public licen | opensource\.org/licen[cs]es/qpl-1\.0 | licen
ruby | ruby licen[cs]e | ruby licen | ruby-lang\.org/.{0,10}license | licen
sspl-1.0 | server side public licen[cs]e | server side | mongodb\.com/licensing/server-side-public-license | mongodb
unlicense | (?:the )?unlicense\b | unlicen | unlicense\.org | unlicen
upl-1.0 | universal permissive licen[cs]e | universal permissive | opensource\.org/licen[cs]es/upl | licen
vim | vim licen[cs]e | vim licen | vimhelp\.org/uganda | vimhelp
w3c | w3c software (?:notice and|and document) licen[cs]e | w3c licen;w3c softw | w3\.org/consortium/legal/.{0,20}copyright-software | w3.org
wtfpl | do what the fuck you want to public licen[cs]e | what the | wtfpl\.net | wtfpl
x11-distribute | x consortium licen[cs]e | x consortium | x\.org/.{0,20}licen[cs]e | licen
zlib | (?:zlib|libpng|zlib/libpng) licen[cs]e | zlib;libpng | zlib\.net/zlib_license | zlib
zpl-2.1 | zope public licen[cs]e | zope | opensource\.org/licen[cs]es/zpl-2\.0 | licen
"""

# label | priority | weight | keyword | regular expression
NOTICES = r"""
copyright-notice | 4 | 0.4 | copyright | copyright (?:\(c\)|©)? ?(?:19|20)\d\d(?:[-,] ?(?:19|20)?\d\d)*
copyright-notice | 4 | 0.4 | (c) | \(c\) (?:19|20)\d\d(?:[-,] ?(?:19|20)?\d\d)*
copyright-notice | 4 | 0.4 | © | © ?(?:19|20)\d\d
copyright-holder | 4 | 0.3 | copyright | copyright (?:held|owned) by
reserved | 3 | 0.6 | reserved | all rights (?:are )?(?:expressly )?reserved
reserved | 3 | 0.6 | reserved | alle rechte vorbehalten
reserved | 3 | 0.6 | rechte vorbehalten | alle rechte vorbehalten
reserved | 3 | 0.6 | droits r | tous droits r[ée]serv[ée]s
reserved | 3 | 0.6 | derechos reservados | todos los derechos reservados
some-reserved | 3 | 0.5 | reserved | some rights reserved
proprietary | 3 | 0.7 | proprietary | proprietary and confidential
proprietary | 3 | 0.7 | confidential | confidential and proprietary
proprietary | 3 | 0.6 | be copied;be reproduced;be distributed;be redistributed | (?:may not|must not|shall not) be (?:copied|reproduced|distributed|redistributed)
proprietary | 3 | 0.6 | permission | without (?:the )?(?:prior |express )?(?:written )?permission
public-domain | 3 | 0.7 | public domain | (?:released|dedicated|placed|belongs) (?:in|into|to) the public domain
public-domain | 4 | 0.4 | public domain | public domain
warranty-disclaimer | 4 | 0.5 | warrant | without warrant(?:y|ies) of any kind
warranty-disclaimer | 4 | 0.5 | "as is";'as is';“as is” | provided ["'“]as is["'”]
warranty-disclaimer | 4 | 0.4 | warrant | (?:merchantability|fitness for a particular purpose)
warranty-disclaimer | 4 | 0.4 | warrant | disclaim(?:s|ed|ing)? all warranties
mit | 2 | 0.9 | permission | permission is hereby granted, free of charge, to any person obtaining a copy
isc | 2 | 0.9 | permission | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose
bsd | 2 | 0.9 | redistribution | redistribution and use in source and binary forms
bsd-3-clause | 2 | 0.9 | endorse | neither the name of .{1,120}? nor the names of its contributors
gpl | 3 | 0.6 | gpl | \bgpl(?:[- ]?v?\d(?:\.\d)?)?\+?(?![a-z0-9])
lgpl | 3 | 0.6 | lgpl | \blgpl(?:[- ]?v?\d(?:\.\d)?)?\+?(?![a-z0-9])
agpl | 3 | 0.6 | agpl | \bagpl(?:[- ]?v?\d(?:\.\d)?)?\+?(?![a-z0-9])
gpl | 4 | 0.5 | general public | general public licen[cs]e
lgpl | 3 | 0.6 | lesser | lesser general public licen[cs]e
creative-commons | 4 | 0.5 | creative commons | creative commons
cc-by | 3 | 0.6 | cc by;cc-by | \bcc[- ]by(?![a-z0-9])
unknown-licence | 4 | 0.3 | licen | (?:licen[cs]ed|released|distributed) under (?:the )?[a-z0-9.+-]+(?: [a-z0-9.+-]+){0,4} licen[cs]e
unknown-licence | 4 | 0.2 | licen | (?:see|read) (?:the )?licen[cs]e (?:file )?for (?:more )?(?:details|terms|information)
unknown-licence | 4 | 0.2 | licen | licen[cs]e (?:agreement|terms)
"""


def rules() -> list[tuple[int, str, int, float, str, str]]:
    """(number, label, priority, weight, keyword, Java regular expression), in order."""
    out = []

    def add(label, priority, weight, keyword, regex):
        out.append((len(out), label, priority, weight, keyword, regex.replace(" ?", r"\s*").replace(" ", r"\s+")))

    for line in filter(None, LICENCES.splitlines()):
        label, name, keyword, address, word = (x.strip() for x in line.split(" | "))
        tag = label.replace(".", r"\.").replace("+", r"\+")
        add(label, 1, 1.0, "spdx", rf"spdx-licen[cs]e-identifier: ?{tag}(?:-only|-or-later|\+)?(?![a-z0-9.-])")
        add(label, 2, 0.95, keyword, rf"(?:licen[cs]ed|released|distributed|available|provided) under (?:the )?(?:terms (?:of the|and conditions of the) )?{name}")
        add(label, 3, 0.8, keyword, rf"(?<![a-z0-9]){name}")
        if address != "-":
            add(label, 3, 0.85, word, rf"(?:https?://)?(?:www\.)?{address}")
    for line in filter(None, NOTICES.splitlines()):
        label, priority, weight, keyword, regex = (x.strip() for x in line.split(" | "))
        add(label, int(priority), float(weight), keyword, regex)
    return out
