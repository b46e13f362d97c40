"""Signature rules of licenses, as text: hand-written wordings, and families that give a rule for each way of naming a license.

A rule is matched against a text's words: A-Z in lower case, words of ASCII letters, digits and characters beyond ASCII, one blank between them. The word in braces
is its keyword; the regex before it must end at the keyword, the regex after it must begin there, both at whole words. No rule reaches further
than ``REACH`` words from its keyword.
"""
from __future__ import annotations

import re
from typing import NamedTuple

REACH = 24
# Priorities, best first, and how sure a detection of each is.
IDENTIFIER, GRANT, WORDING, NAME, HINT = range(5)
SURENESS = (1.0, 0.95, 0.9, 0.8, 0.4)


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    before: str
    after: str
    base: bool = False


# The base phrases and their labels.
BASE = """
cc-by | {cc} by
gpl | general {public} license
reserved | all rights {reserved}
"""

# Label | identifier words after "SPDX-License-Identifier" | names in running text, between semicolons.
FAMILIES = """
apache-1.1 | apache 1 1 | {apache} (?:software )?license (?:version )?1 1; {apache} 1 1
apache-2.0 | apache 2 0 | {apache} (?:software )?license (?:v|version )?2(?: 0)?; {apache} 2 0; {apachev2}; {asl} 2 0
apache | apache | {apache} (?:software |public )?licen[cs]e
mit-0 | mit 0 | {mit} no attribution(?: license)?; {mit} 0
mit | mit | {mit} (?:x11 )?licen[cs]e; {mit} style licen[cs]e; {expat} licen[cs]e; {x11} licen[cs]e
bsd-0-clause | 0bsd | zero clause {bsd}(?: license)?; {0bsd}
bsd-2-clause | bsd 2 clause(?: patent| views)? | {bsd} 2 clause(?: license)?; (?:2|two) clause {bsd}(?: license)?; simplified {bsd} license; {freebsd} license
bsd-3-clause | bsd 3 clause(?: clear| lbnl)? | {bsd} 3 clause(?: license)?; (?:3|three) clause {bsd}(?: license)?; (?:new|modified|revised) {bsd} license
bsd-4-clause | bsd 4 clause | {bsd} 4 clause(?: license)?; (?:4|four) clause {bsd}(?: license)?; original {bsd} license
bsd | bsd | {bsd} licen[cs]e; {bsd} style licen[cs]e
gpl-1.0 | gpl 1 0(?: only| or later)? | {gpl} (?:v|version )?1 0; {gplv1}; general {public} license (?:v|version )1(?: 0)?
gpl-2.0 | gpl 2 0(?: only| or later)? | {gpl} (?:v|version )?2(?: 0)?; {gplv2}; general {public} license (?:v|version )2(?: 0)?
gpl-3.0 | gpl 3 0(?: only| or later)? | {gpl} (?:v|version )?3(?: 0)?; {gplv3}; general {public} license (?:v|version )3(?: 0)?
gpl | gpl | gnu {gpl}; gnu general {public} licen[cs]e; {gpl} licen[cs]e
lgpl-2.0 | lgpl 2 0(?: only| or later)? | {lgpl} (?:v|version )?2 0; (?:library|lesser) general {public} license (?:v|version )2(?: 0)?
lgpl-2.1 | lgpl 2 1(?: only| or later)? | {lgpl} (?:v|version )?2 1; {lgplv2} 1; (?:library|lesser) general {public} license (?:v|version )2 1
lgpl-3.0 | lgpl 3 0(?: only| or later)? | {lgpl} (?:v|version )?3(?: 0)?; {lgplv3}; lesser general {public} license (?:v|version )3(?: 0)?
lgpl | lgpl | {lgpl}(?: license)?; (?:gnu )?(?:library|lesser) general {public} licen[cs]e
agpl-3.0 | agpl 3 0(?: only| or later)? | {agpl} (?:v|version )?3(?: 0)?; {agplv3}; affero general {public} license (?:v|version )3(?: 0)?
agpl | agpl | {agpl}(?: license)?; (?:gnu )?affero general {public} licen[cs]e
gfdl | gfdl 1 [123](?: only| or later| invariants only)? | {gfdl}; gnu free {documentation} license
mpl-1.1 | mpl 1 1 | {mozilla} public license (?:v|version )?1 1; {mpl} (?:v|version )?1 1
mpl-2.0 | mpl 2 0(?: no copyleft exception)? | {mozilla} public license (?:v|version )?2(?: 0)?; {mpl} (?:v|version )?2(?: 0)?
mpl | mpl | {mozilla} public licen[cs]e; {mpl} license
epl-1.0 | epl 1 0 | {eclipse} public license (?:v|version )?1(?: 0)?; {epl} (?:v|version )?1 0
epl-2.0 | epl 2 0 | {eclipse} public license (?:v|version )?2(?: 0)?; {epl} (?:v|version )?2 0
epl | epl | {eclipse} public licen[cs]e
edl-1.0 | bsd 3 clause edl | {eclipse} distribution license(?: version 1 0)?
cddl-1.0 | cddl 1 0 | common development and {distribution} license(?: version 1 0)?; {cddl} (?:v|version )?1 0
cddl-1.1 | cddl 1 1 | common development and {distribution} license version 1 1; {cddl} (?:v|version )?1 1
cpl-1.0 | cpl 1 0 | common {public} license(?: version 1 0)?
eupl-1.1 | eupl 1 1 | {eupl} (?:v|version )?1 1; european union {public} licen[cs]e (?:v|version )?1 1
eupl-1.2 | eupl 1 2 | {eupl} (?:v|version )?1 2; european union {public} licen[cs]e (?:v|version )?1 2
artistic-1.0 | artistic 1 0(?: perl| cl8)? | {artistic} license (?:v|version )?1(?: 0)?
artistic-2.0 | artistic 2 0 | {artistic} license (?:v|version )?2(?: 0)?
artistic | artistic | {artistic} licen[cs]e
bsl-1.0 | bsl 1 0 | {boost} software license(?: (?:version )?1 0)?
isc | isc | {isc} licen[cs]e; internet systems {consortium} license
zlib | zlib | {zlib} licen[cs]e; {zlib} libpng license
libpng | libpng 2 0 | {libpng} licen[cs]e; png reference {library} license
unlicense | unlicense | the {unlicense}; {unlicense} org
wtfpl | wtfpl | {wtfpl}; do what the [^ ]+ you want to {public} license
ncsa | ncsa | university of illinois ncsa open {source} license; {ncsa} license
ofl-1.1 | ofl 1 1(?: no rfn| rfn)? | {sil} open font license(?: version 1 1)?; open {font} license(?: version)? 1 1
psf-2.0 | (?:psf|python) 2 0(?: 1)? | {python} software foundation license(?: version 2)?; {psf} license
php-3.01 | php 3 01 | {php} license(?: (?:v|version )?3 01)?
ruby | ruby | {ruby} license
openssl | openssl | {openssl} license; {ssleay} license
postgresql | postgresql | {postgresql} licen[cs]e
ms-pl | ms pl | {microsoft} public license
ms-rl | ms rl | {microsoft} reciprocal license
osl-3.0 | osl 3 0 | open {software} license (?:v|version )?3 0
afl-3.0 | afl 3 0 | {academic} free license (?:v|version )?3 0; {academic} free license
upl-1.0 | upl 1 0 | {universal} permissive license(?: (?:v|version )?1 0)?
blueoak-1.0.0 | blueoak 1 0 0 | {blueoak} 1 0 0; blue {oak} model license(?: 1 0 0)?
mulan-psl-2.0 | mulanpsl 2 0 | {mulan} psl v2; {mulan} permissive software license(?: v2)?
odbl-1.0 | odbl 1 0 | open {database} license(?: (?:v|version )?1 0)?; {odbl}
odc-by-1.0 | odc by 1 0 | open data {commons} attribution license; {odc} by
pddl-1.0 | pddl 1 0 | public domain {dedication} and license; {pddl}
cdla-permissive-2.0 | cdla permissive 2 0 | community data license {agreement} permissive(?: version)? 2 0
cdla-sharing-1.0 | cdla sharing 1 0 | community data license {agreement} sharing(?: version)? 1 0
etalab-2.0 | etalab 2 0 | {etalab} 2 0; {licence} ouverte(?: version)?(?: 2 0)?
ogl-uk-3.0 | ogl uk 3 0 | open {government} licence(?: v3 0)?
cecill-2.1 | cecill 2 1 | {cecill} (?:v|version )?2 1; {cecill}
sspl-1.0 | sspl 1 0 | server side {public} license(?: (?:v|version )?1)?; {sspl}
busl-1.1 | busl 1 1 | {business} source license(?: (?:v|version )?1 1)?; {busl} 1 1
elastic-2.0 | elastic 2 0 | {elastic} license(?: (?:v|version )?2(?: 0)?)?
openrail | (?:creativeml openrail m|bigscience openrail m|openrail) | {openrail}(?: m)?(?: license)?
cc0-1.0 | cc0 1 0 | {cc0}(?: 1 0)?(?: universal)?; creative {commons} (?:zero|0)(?: 1 0)?; creative {commons} cc0
"""

# The Creative Commons licenses, as their codes and as their written names; every version is a rule of its own.
COMMONS = """
cc-by-nc-nd | nc nd | attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | nc sa | attribution non ?commercial share ?alike
cc-by-nc | nc | attribution non ?commercial
cc-by-nd | nd | attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-sa | sa | attribution share ?alike
cc-by | | attribution
"""
VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Label | priority | wording.
WORDINGS = """
mit | wording | permission is {hereby} granted free of charge to any person obtaining a copy
mit | wording | the software is {provided} as is without warranty of any kind express or implied
isc | wording | permission to use copy modify and or {distribute} this software for any purpose with or without fee is hereby granted
bsd | wording | redistribution and use in source and binary {forms} with or without modification are permitted
bsd-3-clause | wording | neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its {contributors} may be used to endorse
bsd-4-clause | wording | all advertising materials mentioning {features} or use of this software must display
bsd | wording | redistributions of source code must {retain} the above copyright notice
apache-2.0 | wording | you may not use this file except in {compliance} with the license
apache-2.0 | wording | unless required by applicable law or agreed to in writing {software} distributed under the license
gpl | wording | this program is free software you can {redistribute} it and or modify it
gpl | wording | under the terms of the gnu general {public} license as published by the free software foundation
gpl-2.0 | wording | either {version} 2 (?:of the license )?or at your option any later version
gpl-3.0 | wording | either {version} 3 (?:of the license )?or at your option any later version
gpl | wording | you should have received a {copy} of the gnu general public license
lgpl | wording | you should have received a {copy} of the gnu (?:lesser|library) general public license
agpl | wording | you should have received a {copy} of the gnu affero general public license
gfdl | wording | permission is granted to copy distribute and or modify this {document} under the terms of the gnu free documentation license
mpl-2.0 | wording | this source code form is {subject} to the terms of the mozilla public license
epl | wording | this program and the {accompanying} materials are made available under the terms of the eclipse public license
bsl-1.0 | wording | permission is {hereby} granted free of charge to any person or organization obtaining a copy of the software
zlib | wording | altered source versions must be plainly {marked} as such
zlib | wording | the {origin} of this software must not be misrepresented
unlicense | wording | this is free and {unencumbered} software released into the public domain
ofl-1.1 | wording | this font software is {licensed} under the sil open font license
artistic | wording | you may distribute this {package} under the terms of the artistic license
psf-2.0 | wording | this license {agreement} is between the python software foundation
openssl | wording | this product {includes} software developed by the openssl project
cc-by | wording | you must give {appropriate} credit provide a link to the license and indicate if changes were made
cc-by-sa | wording | you must {distribute} your contributions under the same license as the original
cc-by-nc | wording | you may not use the material for {commercial} purposes
cc-by-nd | wording | you may not distribute the {modified} material
cc0-1.0 | wording | has {waived} all copyright and related or neighboring rights
public-domain | wording | (?:released|placed|dedicated) (?:in|into|to) the public {domain}
public-domain | wording | this (?:work|file|text|document) is in the public {domain}
public-domain | name | public {domain} dedication
reserved | wording | no part of this (?:publication|book|work) may be {reproduced}
reserved | wording | unauthori[sz]ed {copying} of this file via any medium is strictly prohibited
reserved | wording | {proprietary} and confidential
reserved | hint | some rights {reserved}
reserved | hint | may not be {reproduced} without (?:the )?(?:prior )?(?:written )?permission
non-commercial | hint | for non ?commercial {use} only
non-commercial | hint | (?:personal|research|academic|educational) {use} only
copyright-notice | hint | {copyright} (?:c )?[12][0-9]{3}
copyright-notice | hint | {copyright} by
copyright-notice | hint | {copyrighted} (?:material|work)
copyright-notice | hint | © ?[12][0-9]{3} {by}
license-reference | hint | see (?:the )?(?:file )?(?:license|copying) (?:file )?for {details}
license-reference | hint | see the {license} file
license-reference | hint | {license} txt
license-reference | hint | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:[^ ]+ ){0,4}{license}
license-reference | hint | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:[^ ]+ ){0,4}{licence}
license-reference | hint | {licensed} under
license-reference | hint | spdx license {identifier}
license-reference | hint | {licensed} to you under
license-reference | hint | end {user} licen[cs]e agreement
license-reference | hint | subject to the {terms} and conditions of the licen[cs]e
open-source | hint | open {source} licen[cs]e
open-source | hint | free {software} licen[cs]e
open-source | hint | osi {approved} licen[cs]e
open-access | hint | open {access} article (?:distributed )?under
royalty-free | hint | royalty {free} licen[cs]e
terms-of-use | hint | {terms} of (?:use|service)
terms-of-use | hint | by using this (?:site|website|service) you {agree}
"""

GIVEN = r"(?:dual )?(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistributed|made available|shared) (?:to you )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:either )?(?:the |a |an )?(?:gnu |mit or |[^ ]+ or )?"


def _lines(text: str) -> list[list[str]]:
    return [[part.strip() for part in line.split(" | ")] for line in text.strip().splitlines()]


def rule(label: str, priority: int, wording: str, base: bool = False) -> Rule:
    found = re.fullmatch(r"(.*?)\{([^{}]*[^{}0-9,][^{}]*)\}(.*)", wording)
    if not found:
        raise ValueError(f"no keyword in: {wording}")
    before, keyword, after = found.groups()
    return Rule(label, priority, keyword, before, after, base)


def build() -> list[Rule]:
    """All rules, in the order of their labels' first mention."""
    rules = [rule(label, NAME, wording, True) for label, wording in _lines(BASE)]
    names = [(label, spdx, name) for label, spdx, many in _lines(FAMILIES) for name in many.split("; ")]
    for code, tail, written in _lines(COMMONS.replace(" | | ", " |  | ")):
        for version in ("", *VERSIONS):
            label = code + (f"-{version.replace(' ', '.')}" if version else "")
            ending = f" {version}" if version else ""
            names.append((label, f"cc by {tail} {version}".replace("  ", " ").strip() if version else "", f"{{cc}} by{' ' + tail if tail else ''}{ending}"))
            names.append((label, "", f"creative {{commons}} {written}{f' (?:international |unported |generic )?(?:public )?(?:license )?(?:version )?{version}' if version else ' licen[cs]e'}"))
    seen = set()
    for label, spdx, name in names:
        rules += [rule(label, NAME, name), rule(label, GRANT, GIVEN + name)]
        if spdx and (label, spdx) not in seen:
            seen.add((label, spdx))
            rules.append(rule(label, IDENTIFIER, f"spdx license {{identifier}} {spdx}"))
    ranks = {"wording": WORDING, "name": NAME, "hint": HINT}
    return rules + [rule(label, ranks[rank], wording) for label, rank, wording in _lines(WORDINGS)]


RULES = build()
