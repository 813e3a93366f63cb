"""The signature rules of the license scan.

Rules are regular expressions over *normal text*: words in lower case, one space
between them, one before the first and one after the last.  Each has a keyword that must
be in the text before the expression is tried, a priority and a confidence.

Some 300 expressions are written by hand: the sentences of licenses and notices, and the names of licenses. The rules around
the names (grants, notices, identifiers) are built from templates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class LicenseRule:
    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float
    #: the beginning of a word that is also in every matching text; one for several rules
    stem: str = ""


#: label, keyword, expression for the full name, SPDX-like identifiers (as words)
_NAMES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("mit", "mit", r"mit licen[cs]e", ("mit",)),
    ("mit", "expat", r"expat licen[cs]e", ()),
    ("mit-0", "attribution", r"mit no attribution(?: licen[cs]e)?", ("mit 0",)),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e (?:version |v )?1 1", ("apache 1 1",)),
    ("apache-2", "apache", r"apache(?: software)? licen[cs]e (?:version |v )?2(?: 0)?", ("apache 2 0", "apache 2")),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", ("apache",)),
    ("gpl-1", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v )?1(?: 0)?", ("gpl 1 0", "gpl 1 0 only")),
    ("gpl-2", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)?", ("gpl 2 0", "gpl 2 0 only", "gplv2")),
    ("gpl-3", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)?", ("gpl 3 0", "gpl 3 0 only", "gplv3")),
    ("gpl", "general public", r"gnu general public licen[cs]e", ("gpl",)),
    ("gpl-2-or-later", "later", r"general public licen[cs]e (?:version |v )?2(?: 0)? or (?:at your option )?any later version", ("gpl 2 0 or later",)),
    ("gpl-3-or-later", "later", r"general public licen[cs]e (?:version |v )?3(?: 0)? or (?:at your option )?any later version", ("gpl 3 0 or later",)),
    ("lgpl-2.1", "general public", r"(?:gnu )?lesser general public licen[cs]e (?:version |v )?2 1", ("lgpl 2 1", "lgpl 2 1 only")),
    ("lgpl-3", "general public", r"(?:gnu )?lesser general public licen[cs]e (?:version |v )?3(?: 0)?", ("lgpl 3 0", "lgpl 3 0 only")),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", ("lgpl",)),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[cs]e (?:version |v )?3(?: 0)?", ("agpl 3 0", "agpl 3 0 only")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", ("agpl",)),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?", ("gfdl 1 3", "gfdl")),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?", ("bsd 2 clause",)),
    ("bsd-2-clause", "freebsd", r"freebsd(?: licen[cs]e)?", ()),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", ("bsd 3 clause",)),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?", ("bsd 4 clause",)),
    ("0bsd", "bsd", r"(?:zero clause bsd|0 clause bsd)(?: licen[cs]e)?", ("0bsd",)),
    ("bsd", "bsd", r"bsd licen[cs]e", ("bsd",)),
    ("isc", "isc", r"isc licen[cs]e", ("isc",)),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v )?1 1", ("mpl 1 1",)),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e (?:version |v )?2(?: 0)?", ("mpl 2 0",)),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", ("mpl",)),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?", ("epl 1 0",)),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?", ("epl 2 0",)),
    ("epl", "eclipse", r"eclipse public licen[cs]e", ("epl",)),
    ("cddl", "common development", r"common development and distribution licen[cs]e(?: version 1 [01])?", ("cddl 1 0", "cddl 1 1")),
    ("eupl", "european union", r"european union public licen[cs]e(?: (?:version |v )?1 [12])?", ("eupl 1 1", "eupl 1 2")),
    ("unlicense", "unlicen", r"(?:the )?unlicen[cs]e", ("unlicense",)),
    ("wtfpl", "what the", r"do what the \w+ you want to public licen[cs]e", ("wtfpl",)),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", ("zlib",)),
    ("boost", "boost", r"boost software licen[cs]e(?: version 1 0)?", ("bsl 1 0",)),
    ("artistic-2", "artistic", r"artistic licen[cs]e (?:version |v )?2(?: 0)?", ("artistic 2 0",)),
    ("artistic", "artistic", r"artistic licen[cs]e", ("artistic 1 0",)),
    ("python", "python", r"python(?: software foundation)? licen[cs]e", ("python 2 0", "psf 2 0")),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", ("postgresql",)),
    ("openssl", "openssl", r"openssl licen[cs]e", ("openssl",)),
    ("odbl", "open database", r"open database licen[cs]e(?: version 1 0)?", ("odbl 1 0",)),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", ("odc by 1 0",)),
    ("pddl", "public domain dedication", r"public domain dedication and licen[cs]e", ("pddl 1 0",)),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e(?: version 1 1)?", ("ofl 1 1",)),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", ("ms pl",)),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", ("ms rl",)),
    ("busl", "business source", r"business source licen[cs]e(?: 1 1)?", ("busl 1 1",)),
    ("sspl", "server side", r"server side public licen[cs]e", ("sspl 1 0",)),
    ("elastic-2", "elastic", r"elastic licen[cs]e(?: 2 0)?", ("elastic 2 0",)),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?", ("openrail",)),
    ("openrail", "open rail", r"(?:bigscience |creativeml )?open rail(?: m)?(?: licen[cs]e)?", ()),
    ("bigscience", "responsible ai", r"responsible ai licen[cs]e", ("rail",)),
)

_GRANT = (
    r"(?:licen[cs]ed|released|distributed|published|available|provided|offered|issued|covered|shared|"
    r"made available|redistribute it and or modify it) under (?:the )?(?:terms of (?:the )?)?"
)

#: Sentences of license texts and other notices, one a line: label | keyword | expression.  Written by hand; of two that begin at
#: one place the earlier stands.  The keyword is in every text that the expression matches.
_SENTENCES = r"""
mit | free of charge to any person | permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?
mit | substantial portions of the software | (?:this permission notice )?shall be included in all copies or substantial portions of the software
mit | deal in the software | to deal in the software without restriction
mit | rights to use copy modify merge | the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies
mit | authors or copyright holders be liable | in no event shall the authors or copyright holders be liable for any claim
mit | of the mit | (?:governed by|subject to) the (?:terms|terms and conditions) of the mit licen[cs]e
x11 | x consortium | the name of the x consortium shall not be used in advertising
x11 | x11 | (?:the )?x11 licen[cs]e
mit-modern | provided that the above copyright notice | provided that the above copyright notice and this permission notice appear in all copies
hpnd | hereby granted without fee | permission to use copy modify (?:and )?distribute (?:and sell )?this software (?:and its documentation )?for any purpose is hereby granted without fee
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | author disclaims all warranties | the author disclaims all warranties with regard to this software
bsd | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions of source code | redistributions of source code must retain the above copyright notice
bsd | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice
bsd | copyright holders and contributors as is | this software is provided by the copyright holders and contributors as is
bsd | regents and contributors as is | this software is provided by the regents and contributors as is
bsd | bsd style | bsd style licen[cs]e
bsd | bsd type | bsd type licen[cs]e
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from this software without
bsd-3-clause | nor the names of | neither the name of (?:the )?\w+(?: \w+){0,4} nor the names of (?:its|any) contributors
bsd-3-clause-clear | no express or implied licenses | no express or implied licenses to any party s patent rights are granted
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software
bsd-patent | licensable by such copyright holder | patent claims licensable by such copyright holder or contributor
apache-2 | in compliance with the | you may not use this (?:file|work|software|project) except in compliance with the licen[cs]e
apache-2 | apache org licenses | apache org licenses licen[cs]e 2 0
apache-2 | copyright license subject to the | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license subject to the
apache-2 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the licen[cs]e
apache-2 | limitations under the | specific language governing permissions and limitations under the licen[cs]e
apache-1.1 | acknowledgment | this product includes software developed by the apache software foundation(?: and)?(?: this)? acknowledgment
apache | apache software foundation asf | licensed to the apache software foundation asf under one or more contributor
apache | apache style | apache style licen[cs]e
gpl | published by the free software foundation | under the terms of the gnu general public licen[cs]e as published by the free software foundation
gpl | hope that it will be useful | this program is distributed in the hope that it will be useful but without any warranty
gpl | is free software you can redistribute | this (?:program|file|library|software|package) is free software you can redistribute it and or modify it
gpl | received a copy of the gnu general public | you should have received a copy of the gnu general public licen[cs]e
gpl | program into proprietary programs | does not permit incorporating your program into proprietary programs
gpl | verbatim copies of this license document | everyone is permitted to copy and distribute verbatim copies of this license document
gpl | copyleft | (?:strong |weak )?copyleft licen[cs]e
gpl | gnu gpl | gnu gpl
gpl-2 | june 1991 | version 2 june 1991
gpl-3 | 29 june 2007 | version 3 29 june 2007
gpl-2 | gnu gpl v | gnu gpl v(?:ersion )?2(?: 0)?
gpl-3 | gnu gpl v | gnu gpl v(?:ersion )?3(?: 0)?
gpl-2-or-later | or at your option any later version | version 2 (?:of the licen[cs]e )?or at your option any later version
gpl-3-or-later | or at your option any later version | version 3 (?:of the licen[cs]e )?or at your option any later version
gpl-classpath-exception | classpath exception | (?:with (?:the )?)?classpath exception
gpl-linking-exception | permission to link | as a special exception the copyright holders of this library give you permission to link
gcc-exception | gcc runtime library exception | gcc runtime library exception
lgpl | lesser general public | as published by the free software foundation under the lesser general public licen[cs]e
lgpl | received a copy of the gnu lesser | you should have received a copy of the gnu lesser general public licen[cs]e
lgpl | gnu lgpl | gnu lgpl
lgpl-2.1 | february 1999 | version 2 1 february 1999
agpl | remote network interaction | remote network interaction use with the gnu general public licen[cs]e
agpl | gnu agpl | gnu agpl
agpl-3 | 19 november 2007 | version 3 19 november 2007
gfdl | no invariant sections | with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
gfdl | gnu fdl | gnu fdl
mpl-2 | this source code form | this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0
mpl | this source code form | this source code form is subject to the terms of the mozilla public licen[cs]e
mpl | mozilla org mpl | mozilla org mpl(?: 2 0)?
mpl-1.1 | subject to the mozilla public | the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl | contents of this file are subject to the | the contents of this file are subject to the mozilla public licen[cs]e
npl | netscape public | netscape public licen[cs]e
cddl | contents of this file are subject to the | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
epl-2 | eclipse public | made available under the terms of the eclipse public licen[cs]e 2 0
epl | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
cpl | common public | common public licen[cs]e(?: version)?(?: 1 0)?
ibm-pl | ibm public | ibm public licen[cs]e(?: version)?(?: 1 0)?
osl-3 | open software | (?:licensed under the )?open software licen[cs]e version 3 0
osl | open software | open software licen[cs]e
afl-3 | academic free | academic free licen[cs]e version 3 0
afl | academic free | academic free licen[cs]e
ecl-2 | educational community | educational community licen[cs]e(?: version 2 0)?
ncsa | university of illinois | university of illinois(?: ncsa)? open source licen[cs]e
ncsa | ncsa open source | ncsa open source licen[cs]e
zlib | origin of this software | the origin of this software must not be misrepresented
zlib | plainly marked | altered source versions must be plainly marked as such
zlib | held liable for any damages | in no event will the authors be held liable for any damages arising from the use of this software
libpng | libpng | (?:the )?libpng licen[cs]e
libtiff | libtiff | (?:the )?libtiff licen[cs]e
ijg | independent jpeg group | based in part on the work of the independent jpeg group
curl | curl | (?:the )?curl licen[cs]e
vim | vim | (?:the )?vim licen[cs]e
ruby | ruby | (?:the )?ruby licen[cs]e
php-3 | php | php licen[cs]e version 3 0[01]?
php | php | (?:the )?php licen[cs]e
php | php | this product includes php software
perl | same terms as perl | under the same terms as perl(?: itself)?
python | agreement for python | licen[cs]e agreement for python
python | psf license agreement | psf license agreement for python
tcl | tcl | tcl tk licen[cs]e
w3c | w3c | w3c software(?: notice)? and(?: document)? licen[cs]e
w3c | w3c | w3c document licen[cs]e
unicode | unicode | unicode licen[cs]e agreement
icu | icu | (?:the )?icu licen[cs]e
openssl | openssl project | this product includes software developed by the openssl project
ssleay | eric young | this product includes cryptographic software written by eric young
intel-sample | intel | intel simplified software licen[cs]e
nvidia | nvidia | nvidia software licen[cs]e(?: agreement)?
oracle-bcl | oracle | oracle binary code licen[cs]e(?: agreement)?
otn | oracle technology network | oracle technology network licen[cs]e(?: agreement)?
upl | universal permissive | universal permissive licen[cs]e(?: version)?(?: v)?(?: ?1 0)?
apple-psl | apple public source | apple public source licen[cs]e
sun-public | sun public | sun public licen[cs]e
qpl | q public | q public licen[cs]e
sleepycat | sleepycat | (?:the )?sleepycat licen[cs]e
cecill | cecill | cecill(?: [abc])?(?: free software)? licen[cs]e
mulan | mulan | mulan (?:permissive software|psl|public) licen[cs]e(?: v2)?
eupl | under the eupl | licensed under the eupl
eupl | public licence v | european union public licence v ?1 [12]
beerware | beer ware | (?:the )?beer ware licen[cs]e
beerware | buy me a beer | you can buy me a beer in return
wtfpl | do what the fuck | you just do what the fuck you want to
wtfpl | wtf public | wtf public licen[cs]e
unlicense | free and unencumbered | this is free and unencumbered software released into the public domain
unlicense | unlicense org | unlicense org
0bsd | this software is provided as is | zero clause licen[cs]e this software is provided as is
public-domain | public domain | (?:this (?:work|text|file|software|code)|it) is in the public domain
public-domain | public domain | (?:dedicated to|released into|released to|placed in|placed into|donated to) the public domain
public-domain | public domain | public domain (?:mark|dedication)(?: 1 0)?
public-domain | copyright has been waived | all copyright has been waived
public-domain | no known copyright | no known copyright restrictions
cc0 | waived all copyright | has waived all copyright and related or neighbou?ring rights
cc0 | no rights reserved | (?:some )?no rights reserved
cc | creativecommons org | creativecommons org publicdomain
cc | some rights reserved | some rights reserved
cc-by | creativecommons org licenses by | creativecommons org licenses by [1-4] [05]
cc-by-sa | creativecommons org licenses by sa | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | creativecommons org licenses by nc | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | creativecommons org licenses by nd | creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd [1-4] [05]
cc-by | appropriate credit | you must give appropriate credit provide a link to the licen[cs]e
cc-by-sa | under the same license as the original | you must distribute your contributions under the same license as the original
cc-by-nc | for commercial purposes | you may not use the material for commercial purposes
cc-by-nd | distribute the modified material | you may not distribute the modified material
cc-by-sa | text is available under the creative commons | text is available under the creative commons attribution share ?alike licen[cs]e
odbl | open database | made available under the open database licen[cs]e
odbl | openstreetmap | openstreetmap contributors
ogl | open government | (?:contains public sector information licensed under the )?open government licen[cs]e(?: v(?:ersion )?[123] 0)?
etalab | etalab | licence ouverte etalab(?: 2 0)?
cdla | community data license | community data license agreement(?: permissive| sharing)?
ofl | reserved font name | with reserved font name
ofl | font software | this font software is licensed under the sil open font licen[cs]e
ogl-game | open game | open game licen[cs]e(?: version 1 0a)?
free-art | free art | free art licen[cs]e(?: 1 3)?
openrail | use based restrictions | use based restrictions as referenced in paragraph
openrail | openrail | openrail (?:m|s|d|a) licen[cs]e
llama | llama | llama [234](?: [0-9])? community licen[cs]e(?: agreement)?
llama | meta llama | meta llama [234](?: [0-9])? is licensed under
gemma | gemma terms | gemma terms of use
falcon | falcon | falcon(?: 180b)? tii licen[cs]e
bigcode | bigcode openrail | bigcode openrail m(?: v1)? licen[cs]e
ai2-impact | impact license | ai2 impact license
sspl | the functionality of the program or a modified version | making the functionality of the program or a modified version available to third parties as a service
busl | change date | on the change date(?: or the fourth anniversary)?
busl | additional use grant | additional use grant
commons-clause | commons clause | commons clause(?: licen[cs]e)?(?: condition)?
commons-clause | right to sell the software | does not grant to you the right to sell the software
polyform | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) licen[cs]e
prosperity | prosperity public | prosperity public licen[cs]e
parity | parity public | parity public licen[cs]e
hippocratic | hippocratic | hippocratic licen[cs]e
elastic-2 | managed service | you may not provide the software to third parties as a hosted or managed service
timescale | timescale | timescale licen[cs]e
confluent | confluent community | confluent community licen[cs]e
redis | redis source available | redis source available licen[cs]e
fair-source | functional source | functional source licen[cs]e
jetbrains | intellij | intellij platform licen[cs]e
ms-lpl | microsoft limited public | microsoft limited public licen[cs]e
ms-eula | microsoft software license terms | microsoft software license terms
eula | end user | end user licen[cs]e agreement
eula | by installing | by installing(?: or using)?(?: this| the)? software you agree to
eula | click i agree | click i agree
all-rights-reserved | all rights reserved | all rights reserved
all-rights-reserved | tous droits | tous droits réservés
all-rights-reserved | alle rechte | alle rechte vorbehalten
all-rights-reserved | todos los derechos | todos los derechos reservados
all-rights-reserved | may be reproduced | no part of this (?:work|publication|book|document|site) may be reproduced
all-rights-reserved | without the prior written permission | without the prior written permission of the (?:publisher|author|copyright owner|copyright holder)
all-rights-reserved | without permission | (?:reproduction|copying|redistribution) without permission is (?:strictly )?(?:prohibited|forbidden)
all-rights-reserved | may not be published broadcast | this material may not be published broadcast rewritten or redistributed
proprietary | proprietary | proprietary and confidential
proprietary | proprietary | confidential and proprietary
proprietary | proprietary | proprietary licen[cs]e
proprietary | ed copying of this | unauthori[sz]ed copying of this (?:file|work)
proprietary | trade secret | contains (?:confidential )?(?:information and )?trade secrets? of
proprietary | not be disclosed | may not be disclosed to third parties
proprietary | internal use only | for internal use only
proprietary | commercial licen | (?:under a )?commercial licen[cs]e(?: agreement)?
proprietary | licensed not sold | this software is licensed not sold
proprietary | nondisclosure | subject to a nondisclosure agreement
evaluation-only | evaluation | for evaluation(?: purposes)? only
trial | trial | trial licen[cs]e
shareware | shareware | this (?:program|software) is shareware
freeware | freeware | this (?:program|software) is freeware
donationware | donation | this software is donation ?ware
non-commercial | noncommercial use | noncommercial use only
non-commercial | non commercial use | non commercial use only
non-commercial | commercial | not for commercial use
non-commercial | noncommercial | free for (?:personal and )?noncommercial use
non-commercial | non commercial | free for (?:personal and )?non commercial use
non-commercial | commercial | commercial use is (?:strictly )?(?:prohibited|forbidden|not allowed|not permitted)
non-commercial | for noncommercial | (?:solely|only) for noncommercial (?:use|purposes|research)
non-commercial | for non commercial | (?:solely|only) for non commercial (?:use|purposes|research)
personal-use | personal use | (?:for )?personal use only
personal-use | personal use | free for personal use
research-only | for research | for research(?: and (?:academic|research))? (?:use|purposes) only
research-only | for academic | for academic(?: and (?:academic|research))? (?:use|purposes) only
research-only | educational | for (?:research and )?educational (?:use|purposes) only
research-only | research purposes only | made available for research purposes only
no-derivatives | derivative works | (?:no derivative works|derivative works are not permitted)
no-ai-training | train | may not be used to train(?: any)? (?:ai|artificial intelligence|machine learning)(?: models| systems)?
no-ai-training | text and data mining | (?:all )?rights (?:are )?reserved for text and data mining
no-ai-training | robots | robots noai
fair-use | fair use | fair use under (?:the )?copyright
fair-use | fair use | (?:this is|constitutes) (?:a )?fair use
fair-dealing | fair dealing | fair dealing (?:exception|provisions)
permission | with permission | (?:reprinted|reproduced) with permission
permission | by permission | by permission of the (?:publisher|author)
permission | permission | used with(?: the)? permission
trademark | registered trademark | (?:is a|are) registered trademarks? of
trademark | of their respective owners | (?:are|is)(?: the)? (?:property|trademarks) of their respective owners
patent | patent | patents? pending
warranty | without warranty | provided as is without warranty of any kind
warranty | merchantability | implied warranties? of merchantability
warranty | fitness for a particular purpose | fitness for a particular purpose
open-access | open access | this is an open access article(?: distributed)? under the
open-access | open access | open access(?: article| licen[cs]e)
crown-copyright | crown copyright | crown copyright
gutenberg | project gutenberg | project gutenberg(?: tm)? licen[cs]e
gutenberg | gutenberg | you may copy it give it away or re ?use it under the terms of the project gutenberg
copyright | copyright | copyright (?:c )?[12][0-9]{3}(?: [12][0-9]{3})?
copyright | copyright | (?:c )?copyright by
copyright | copyright | copyright (?:notice|owner|holder)
copyright | copyrighted | (?:this is )?copyrighted material
"""


def _sentences() -> list[tuple[str, str, str]]:
    """label, keyword and expression of every line."""
    return [tuple(part.strip() for part in line.split(" | ", 2)) for line in _SENTENCES.strip().splitlines()]  # type: ignore[misc]


_CC = (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"), ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
       ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))


def _cc_rules() -> list[LicenseRule]:
    out = []
    for short, long in _CC:
        name = "cc-" + short.replace(" ", "-")
        for version in ("", "1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"{name}-{version[0]}" if version else name
            if version:
                label = f"{name}-{version.replace(' ', '.')}"
            tail = f" {version}" if version else ""
            out += [
                LicenseRule(label, "cc by", rf"{_GRANT}(?:a )?cc {short}{tail}(?: licen[cs]e)?", 3, 0.95),
                LicenseRule(label, "cc by", rf"cc {short}{tail}(?: international| unported)?", 2, 0.9),
                LicenseRule(label, "creative commons", rf"creative commons {long}{tail}(?: international| unported)?(?: licen[cs]e)?", 2, 0.9),
            ]
    out += [
        LicenseRule("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 2, 0.9),
        LicenseRule("cc0", "creative commons", r"creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?", 2, 0.9),
        LicenseRule("cc", "creative commons", r"creative commons licen[cs]e", 1, 0.6),
    ]
    return out


_GROUP = re.compile(r"\((?:\?:)?[^()]*\)(?:\{[^}]*\}|\?)?")
_LOOSE = re.compile(r"\\w[+*?]?|\[[^\]]*\](?:\{[^}]*\}|[+*?])?|.\?")
#: words that are too common to find a rule by
_COMMON = frozenset("what under beer version versions only this that with under have from been they mit the and for use used all not may you your by see only free non just return".split())


def required(regex: str) -> list[str]:
    """Beginnings of words that are in every match: what stands outside groups, classes and optional letters."""
    while (shorter := _GROUP.sub("\0", regex)) != regex:
        regex = shorter
    if "|" in regex:
        return []
    return re.findall(r"(?:^| )([^ \0]+)", _LOOSE.sub("\0", regex))


def stem_of(keyword: str, regex: str) -> str:
    """The longest beginning of a word that is in every match; of equally long ones the first."""
    # words of the keyword that begin a word wherever the expression has them
    named = [w for w in re.findall(r"(?:^ ?| )(\w+)", keyword) if len(re.findall(rf"(?:^|[ (|:]| \)\??){w}", regex)) == regex.count(w)]
    words = named + required(regex)
    return max([w for w in words if w not in _COMMON] or words, key=len)


def with_stems(rules: list[LicenseRule]) -> tuple[LicenseRule, ...]:
    """Rules with their stems; no stem begins with another."""
    stems = [stem_of(r.keyword, r.regex) for r in rules]
    least = {s: min((t for t in set(stems) if s.startswith(t)), key=len) for s in set(stems)}
    return tuple(replace(r, stem=least[s]) for r, s in zip(rules, stems, strict=True))


def trie(words: list[str]) -> str:
    """An expression for any of ``words``, none of which begins with another, without trying them one by one."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            by.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + trie(rest) for c, rest in by.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""


def build_rules() -> tuple[LicenseRule, ...]:
    """All rules in order: at equal priority, length and place the earlier one stands."""
    weak = ("copyright", "warranty", "trademark", "patent", "permission")  # notices that name no license
    out = [LicenseRule(label, keyword, regex, 1 if label in weak else 3, 0.5 if label in weak else 0.9) for label, keyword, regex in _sentences()]
    out += _cc_rules()
    for label, keyword, name, ids in _NAMES:
        out.append(LicenseRule(label, keyword, _GRANT + name, 3, 0.98))
        out.append(LicenseRule(label, keyword, name, 2, 0.8))
        out.append(LicenseRule(label, keyword, rf"see (?:the )?{name} for (?:more )?details", 3, 0.85))
        for i in ids:
            out.append(LicenseRule(label, f"identifier {i} ", rf"spdx licen[cs]e identifier {i}", 3, 1.0))
            out.append(LicenseRule(label, f"e {i} ", rf"licen[cs]e {i}", 1, 0.6))
            out.append(LicenseRule(label, f" {i} licen", rf"{i} licen[cs]ed", 1, 0.6))
    return with_stems(out)
