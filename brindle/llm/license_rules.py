"""Hand-written licence signatures over normalised text: lower case, words of letters and digits, single spaces.

A line of ``NAMES`` is: label | keywords | the name's expression | the public identifier, normalised. From each come an
identifier rule, a grant rule and a name rule; ``TEXTS`` adds rules for well-known sentences and addresses. Every
match of a rule's expression holds one of its keywords as a whole word.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass
from functools import cache

import regex

NAMES = """
mit | mit | mit(?: expat)? | mit
mit-0 | mit | mit (?:no attribution|0) | mit 0
apache-2 | apache | apache(?: software)?(?: license| licence)?(?: version)? 2(?: 0)? | apache 2 0
apache-1.1 | apache | apache(?: software)?(?: license| licence)?(?: version)? 1 1 | apache 1 1
apache-1.0 | apache | apache(?: software)?(?: license| licence)?(?: version)? 1 0 | apache 1 0
gpl-1 | gpl general gpl1 gplv1 | (?:gnu )?(?:gpl|general public license|general public licence)(?: v| version)? ?v?1(?: 0)? | gpl 1 0(?: only| or later)?
gpl-2 | gpl general gpl2 gplv2 | (?:gnu )?(?:gpl|general public license|general public licence)(?: v| version)? ?v?2(?: 0)? | gpl 2 0(?: only| or later)?
gpl-3 | gpl general gpl3 gplv3 | (?:gnu )?(?:gpl|general public license|general public licence)(?: v| version)? ?v?3(?: 0)? | gpl 3 0(?: only| or later)?
gpl | gpl general | (?:gnu gpl|gnu general public license|gnu general public licence|gpl) | gpl
lgpl-2 | lgpl library lgpl2 lgplv2 | (?:gnu )?(?:lgpl|library general public license)(?: v| version)? ?v?2(?: 0)? | lgpl 2 0(?: only| or later)?
lgpl-2.1 | lgpl lesser lgpl2 lgplv2 | (?:gnu )?(?:lgpl|lesser general public license|lesser general public licence)(?: v| version)? ?v?2 1 | lgpl 2 1(?: only| or later)?
lgpl-3 | lgpl lesser lgpl3 lgplv3 | (?:gnu )?(?:lgpl|lesser general public license|lesser general public licence)(?: v| version)? ?v?3(?: 0)? | lgpl 3 0(?: only| or later)?
lgpl | lgpl lesser | (?:gnu lgpl|gnu lesser general public license|gnu lesser general public licence|lgpl) | lgpl
agpl-1 | agpl affero agpl1 agplv1 affero1 afferov1 | (?:affero|agpl)(?: general public license)?(?: v| version)? ?v?1(?: 0)? | agpl 1 0(?: only| or later)?
agpl-3 | agpl affero agpl3 agplv3 | (?:gnu )?(?:agpl|affero general public license|affero general public licence)(?: v| version)? ?v?3(?: 0)? | agpl 3 0(?: only| or later)?
agpl | agpl affero | (?:gnu )?(?:agpl|affero general public license|affero gpl) | agpl
gfdl-1.1 | gfdl documentation | (?:gnu )?(?:gfdl|free documentation license)(?: version)? 1 1 | gfdl 1 1(?: only| or later)?
gfdl-1.2 | gfdl documentation | (?:gnu )?(?:gfdl|free documentation license)(?: version)? 1 2 | gfdl 1 2(?: only| or later)?
gfdl-1.3 | gfdl documentation | (?:gnu )?(?:gfdl|free documentation license)(?: version)? 1 3 | gfdl 1 3(?: only| or later)?
gfdl | gfdl documentation | (?:gnu free documentation license|gfdl) | gfdl
bsd-1-clause | bsd | (?:bsd 1 clause|1 clause bsd|one clause bsd) | bsd 1 clause
bsd-2-clause | bsd freebsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) | bsd 2 clause
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd) | bsd 3 clause
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd) | bsd 4 clause
bsd-3-clause-clear | bsd | bsd 3 clause clear | bsd 3 clause clear
bsd-2-clause-patent | bsd | bsd 2 clause(?: plus)? patent | bsd 2 clause patent
0bsd | bsd 0bsd | (?:0bsd|zero clause bsd|bsd zero clause) | 0bsd
bsd | bsd | bsd(?: style)? | bsd
isc | isc | isc | isc
mpl-1.0 | mpl mozilla mpl1 mplv1 | (?:mpl|mozilla public license)(?: v| version)? ?v?1 0 | mpl 1 0
mpl-1.1 | mpl mozilla mpl1 mplv1 | (?:mpl|mozilla public license)(?: v| version)? ?v?1 1 | mpl 1 1
mpl-2 | mpl mozilla mpl2 mplv2 | (?:mpl|mozilla public license)(?: v| version)? ?v?2(?: 0)? | mpl 2 0
mpl | mozilla | mozilla public license | mpl
epl-1 | epl eclipse epl1 eplv1 | (?:epl|eclipse public license)(?: v| version)? ?v?1(?: 0)? | epl 1 0
epl-2 | epl eclipse epl2 eplv2 | (?:epl|eclipse public license)(?: v| version)? ?v?2(?: 0)? | epl 2 0
epl | eclipse | eclipse public license | epl
edl-1 | edl eclipse edl1 edlv1 | (?:edl|eclipse distribution license)(?: version)? ?v?1(?: 0)? | edl 1 0
cddl-1.0 | cddl development | (?:cddl|common development and distribution license)(?: version)? 1 0 | cddl 1 0
cddl-1.1 | cddl development | (?:cddl|common development and distribution license)(?: version)? 1 1 | cddl 1 1
cddl | cddl development | (?:cddl|common development and distribution license) | cddl
cpl-1 | cpl common | (?:cpl|common public license)(?: version)? 1(?: 0)? | cpl 1 0
cpal-1 | cpal attribution | (?:cpal|common public attribution license)(?: version)? 1(?: 0)? | cpal 1 0
ipl-1 | ibm | ibm public license(?: version)? 1(?: 0)? | ipl 1 0
eupl-1.1 | eupl eupl1 euplv1 european | (?:eupl|european union public licen[cs]e)(?: v| version)? ?v?1 1 | eupl 1 1
eupl-1.2 | eupl eupl1 euplv1 european | (?:eupl|european union public licen[cs]e)(?: v| version)? ?v?1 2 | eupl 1 2
cecill-1 | cecill | cecill(?: version)? 1(?: 0)? | cecill 1 0
cecill-2 | cecill | cecill(?: version)? 2(?: 0| 1)? | cecill 2 [01]
cecill-b | cecill | cecill b | cecill b
cecill-c | cecill | cecill c | cecill c
artistic-1 | artistic | artistic license(?: version)? 1(?: 0)? | artistic 1 0
artistic-2 | artistic | artistic license(?: version)? 2(?: 0)? | artistic 2 0
artistic | artistic | (?:perl )?artistic license | artistic
boost-1 | boost bsl | boost(?: software)?(?: license)?(?: version)?(?: 1 0)? | bsl 1 0
zlib | zlib | zlib(?: libpng)? | zlib
libpng | libpng | libpng | libpng
libpng-2 | libpng | libpng(?: version)? 2(?: 0)? | libpng 2 0
openssl | openssl | openssl | openssl
python-2 | python psf | (?:python software foundation|psf|python)(?: license)?(?: version)? 2(?: 0)? | python 2 0
psf | psf python | (?:python software foundation|psf) | psf 2 0
php-3 | php | php license(?: version)? 3(?: 0)? | php 3 0
php-3.01 | php | php license(?: version)? 3 01 | php 3 01
ruby | ruby | ruby | ruby
postgresql | postgresql | postgresql | postgresql
unlicense | unlicense | (?:the )?unlicense | unlicense
wtfpl | wtfpl want | (?:wtfpl|do what the f\\w* you want to public license) | wtfpl
beerware | beerware beer | beer ?ware | beerware
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? | ncsa
x11 | x11 | x11 | x11
hpnd | hpnd historical | (?:hpnd|historical permission notice and disclaimer) | hpnd
ms-pl | ms microsoft | (?:ms pl|microsoft public license) | ms pl
ms-rl | ms microsoft | (?:ms rl|microsoft reciprocal license) | ms rl
afl-2.1 | afl academic | (?:afl|academic free license)(?: version)? 2 1 | afl 2 1
afl-3 | afl academic | (?:afl|academic free license)(?: version)? 3(?: 0)? | afl 3 0
osl-1 | osl open | (?:osl|open software license)(?: version)? 1 [01] | osl 1 [01]
osl-2 | osl open | (?:osl|open software license)(?: version)? 2 [01] | osl 2 [01]
osl-3 | osl open | (?:osl|open software license)(?: version)? 3(?: 0)? | osl 3 0
ecl-2 | ecl educational | (?:ecl|educational community license)(?: version)? 2(?: 0)? | ecl 2 0
upl-1 | upl universal | (?:upl|universal permissive license)(?: version)?(?: 1 0)? | upl 1 0
vim | vim | vim | vim
ofl-1.1 | ofl sil font | (?:sil )?(?:ofl|open font license)(?: version)?(?: 1 1)? | ofl 1 1
lppl-1.3c | lppl latex | (?:lppl|latex project public license)(?: version)? 1 3c? | lppl 1 3c
lppl | lppl latex | (?:lppl|latex project public license) | lppl
ntp | ntp | ntp | ntp
curl | curl | curl | curl
zpl-2.1 | zpl zope | (?:zpl|zope public license)(?: version)? 2 1 | zpl 2 1
zpl | zpl zope | zope public license | zpl 2 0
watcom-1 | watcom | (?:sybase )?open watcom public license(?: version)?(?: 1 0)? | watcom 1 0
apsl-2 | apsl apple | (?:apsl|apple public source license)(?: version)? 2(?: 0)? | apsl 2 0
nasa-1.3 | nasa | nasa open source agreement(?: version)? 1 3 | nasa 1 3
sleepycat | sleepycat | sleepycat | sleepycat
w3c | w3c | w3c(?: software)?(?: notice)?(?: and)? | w3c
xerox | xerox | xerox | xerox
rpl-1.5 | rpl reciprocal | (?:rpl|reciprocal public license)(?: version)? 1 5 | rpl 1 5
qpl-1 | qpl q | (?:qpl|q public license)(?: version)?(?: 1 0)? | qpl 1 0
sspl-1 | sspl sspl1 ssplv1 server | (?:sspl|server side public license)(?: v| version)?(?: ?v?1)? | sspl 1 0
busl-1.1 | busl business | (?:busl|business source license)(?: version)?(?: 1 1)? | busl 1 1
elastic-2 | elastic | elastic license(?: version)?(?: 2(?: 0)?)? | elastic 2 0
mulan-2 | mulan | mulan(?: psl| permissive software license)(?: version)?(?: ?v?2)? | mulanpsl 2 0
blueoak-1 | blueoak blue | blue ?oak model license(?: 1 0 0)? | blueoak 1 0 0
cc0 | cc0 creative cc | (?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)? | cc0 1 0
cc-by | cc creative | (?:cc by|creative commons attribution) [1-4](?: [05])? | cc by [1-4] [05]
cc-by-sa | cc creative | (?:cc by sa|creative commons attribution share ?alike)(?: [1-4](?: [05])?)? | cc by sa [1-4] [05]
cc-by-nd | cc creative | (?:cc by nd|creative commons attribution no ?deriv(?:ative|atives|s))(?: [1-4](?: [05])?)? | cc by nd [1-4] [05]
cc-by-nc | cc creative | (?:cc by nc|creative commons attribution non ?commercial) [1-4](?: [05])? | cc by nc [1-4] [05]
cc-by-nc-sa | cc creative | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4](?: [05])?)? | cc by nc sa [1-4] [05]
cc-by-nc-nd | cc creative | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative|atives|s))(?: [1-4](?: [05])?)? | cc by nc nd [1-4] [05]
odbl-1 | odbl database odbl1 odblv1 | (?:odbl|open database license)(?: version)?(?: ?v?1 0)? | odbl 1 0
odc-by-1 | odc commons | (?:odc by|open data commons attribution license)(?: 1 0)? | odc by 1 0
pddl-1 | pddl domain | (?:pddl|public domain dedication and license)(?: 1 0)? | pddl 1 0
ogl-uk-3 | ogl government ogl3 oglv3 | (?:ogl|open government licen[cs]e)(?: version)?(?: ?v?3(?: 0)?)? | ogl uk 3 0
etalab-2 | etalab ouverte | (?:etalab|licence ouverte)(?: open licence)?(?: version)?(?: 2 0)? | etalab 2 0
dl-de-by-2 | datenlizenz | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)? | dl de by 2 0
llama-2 | llama | llama 2(?: community)? | llama2
llama-3 | llama | (?:meta )?llama 3(?: [1-3])?(?: community)? | llama3
openrail | openrail rail openrailm railm | (?:bigscience )?(?:creativeml )?open ?rail(?: ?[m])?(?: rail)? | openrail
"""

#: priority | label | keywords | expression | confidence
TEXTS = """
90 | mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files | 1.0
90 | isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | 1.0
90 | bsd-3-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that .{0,900}neither the name of | 1.0
85 | bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted | 0.9
90 | zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original | 0.95
90 | gpl-2 | free | free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 | 1.0
90 | gpl-3 | free | free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 | 1.0
90 | agpl-3 | affero | under the terms of the gnu affero general public license as published by the free software foundation either version 3 | 1.0
90 | lgpl-2.1 | lesser | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 | 1.0
90 | lgpl-3 | lesser | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 | 1.0
90 | mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0 | 1.0
90 | unlicense | unencumbered | this is free and unencumbered software released into the public domain | 1.0
90 | boost-1 | boost | distributed under the boost software license version 1 0 | 1.0
90 | wtfpl | verbatim | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed | 0.9
70 | apache-2 | apache | apache org licenses license 2 0 | 0.95
70 | mit | opensource | opensource org licenses mit | 0.95
70 | bsd-3-clause | opensource | opensource org licenses bsd 3 clause | 0.95
70 | gpl-3 | gnu | gnu org licenses gpl 3 0 | 0.95
70 | gpl-2 | gnu | gnu org licenses(?: old licenses)? gpl 2 0 | 0.95
70 | gpl | gnu | gnu org licenses gpl | 0.9
70 | agpl-3 | gnu | gnu org licenses agpl 3 0 | 0.95
70 | lgpl | gnu | gnu org licenses lgpl | 0.9
70 | mpl-2 | mozilla | mozilla org mpl 2 0 | 0.95
70 | unlicense | unlicense | unlicense org | 0.9
70 | cc0 | creativecommons | creativecommons org publicdomain zero 1 0 | 0.95
70 | public-domain | creativecommons | creativecommons org publicdomain mark 1 0 | 0.9
70 | cc-by | creativecommons | creativecommons org licenses by [1-4] [05] | 0.95
70 | cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05] | 0.95
70 | cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05] | 0.95
70 | cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05] | 0.95
70 | cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05] | 0.95
70 | cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [05] | 0.95
50 | public-domain | domain | (?:released into|dedicated to|placed in|in) the public domain | 0.8
30 | all-rights-reserved | reserved | copyright .{0,80}all rights reserved | 0.6
"""

GRANT = "(?:licensed|licenced|released|distributed|available|published|provided|covered|offered|redistributed|shared|used|copied)(?: by us)? under(?: the)?(?: terms of)?(?: the)?(?: conditions of)?(?: the)? "




@dataclass(frozen=True)
class Rule:
    """``openings`` are the words that a match can begin with, ``span`` is the most words that it can have."""

    order: int
    priority: int
    label: str
    keywords: tuple[str, ...]
    expression: str
    confidence: float
    openings: tuple[str, ...]
    span: int

    def as_row(self) -> dict:
        return asdict(self) | {"expression": f"^(?:{self.expression})(?= )"}


def openings(expression: str, keywords: tuple[str, ...]) -> tuple[str, ...]:
    """Of the words in an expression and its keywords, those that a match can begin with."""
    form = regex.compile(expression)
    words = {*re.findall("[0-9a-z]+", expression), *keywords}
    return tuple(sorted(w for w in words if form.fullmatch(w) or form.fullmatch(f"{w} ", partial=True)))


def span(expression: str) -> int:
    """Spaces part words, and of the characters that a dot stands for every second one can be a space."""
    return 1 + expression.count(" ") + sum(1 + int(n) // 2 for n in re.findall(r"\.\{0,([0-9]+)\}", expression))


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order, each once; a match of one holds at least one of its keywords."""
    found: list[tuple[int, str, list[str], str, float]] = []
    for line in NAMES.strip().splitlines():
        label, keywords, name, identifier = (x.strip() for x in line.split(" | "))
        found.append((100, label, ["spdx"], f"spdx license identifier {identifier}", 1.0))
        found.append((80, label, keywords.split(), f"{GRANT}{name}(?: license| licence)?", 0.95))
        found.append((60, label, keywords.split(), f"{name} licen[cs]e", 0.8))
    for line in TEXTS.strip().splitlines():
        priority, label, keywords, expression, confidence = (x.strip() for x in line.split(" | "))
        found.append((int(priority), label, keywords.split(), expression, float(confidence)))
    once = dict.fromkeys((p, label, tuple(k), e, c) for p, label, k, e, c in found)
    return tuple(Rule(i, p, label, k, e, c, openings(e, k), span(e)) for i, (p, label, k, e, c) in enumerate(once))
