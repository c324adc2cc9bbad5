"""Hand-written license signatures, one a line: label, priority, pattern over words.

In a pattern, [ ] holds words that may be missing, { | } alternatives, # is a number and _
any word; `license` is read as `licence`, too. Priorities: 1 a bare name, 2 a license's
name, 3 a name with a version or a sentence that licenses, 4 a license's own words or an
identifier. A detection inside another of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import re

TEXT = """
mit 4 permission is hereby granted free of charge to any person obtaining a copy
mit 4 the above copyright notice and this permission notice shall be included in all copies
mit 4 spdx license identifier mit
mit 3 {licensed|released|distributed|available|published|provided|covered} {under|by} [the] [terms of] [the] mit [license]
mit 3 opensource org licenses mit
mit 2 mit license
mit 2 mit x11
mit 2 {expat|x11} license
mit-0 4 spdx license identifier mit 0
mit-0 3 mit no attribution
isc 4 permission to use copy modify and or distribute this software for any purpose with or without fee
isc 4 permission to use copy modify and distribute this software
isc 4 spdx license identifier isc
isc 3 {licensed|released|distributed|available} under [the] [terms of the] isc
isc 2 isc license
0bsd 4 spdx license identifier 0bsd
0bsd 2 {zero clause bsd|0 clause bsd|bsd zero clause|bsd 0 clause}
bsd 4 redistribution and use in source and binary forms with or without modification are permitted
bsd 4 redistributions of source code must retain the above copyright notice
bsd 4 redistributions in binary form must reproduce the above copyright notice
bsd 3 {licensed|released|distributed|available} under [the] [terms of the] [a] [modified|new|simplified] bsd
bsd 2 bsd license
bsd 2 bsd style license
bsd 2 berkeley software distribution
bsd-2-clause 4 spdx license identifier bsd 2 clause
bsd-2-clause 3 bsd 2 clause
bsd-2-clause 3 {2 clause|two clause|simplified|freebsd} bsd
bsd-3-clause 4 spdx license identifier bsd 3 clause
bsd-3-clause 4 neither the name of _ nor the names of its contributors may be used to endorse
bsd-3-clause 4 neither the name of the copyright holder nor the names of its contributors
bsd-3-clause 3 bsd 3 clause
bsd-3-clause 3 {3 clause|three clause|new|modified|revised} bsd
bsd-4-clause 4 spdx license identifier bsd 4 clause
bsd-4-clause 4 all advertising materials mentioning features or use of this software must display
bsd-4-clause 3 bsd 4 clause
bsd-4-clause 3 {4 clause|four clause|original} bsd
apache-2.0 4 licensed under the apache license version 2 [0]
apache-2.0 4 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 4 spdx license identifier apache 2 0
apache-2.0 4 www apache org licenses license 2 0
apache-2.0 3 apache [software] license [version] 2 [0]
apache-2.0 3 apache [version] 2 [0] [license]
apache-2.0 3 {asl|apl} 2 0
apache-1.1 4 spdx license identifier apache 1 1
apache-1.1 3 apache [software] license [version] 1 1
apache-1.0 3 apache [software] license [version] 1 0
apache 3 {licensed|released|distributed|available} under [the] [terms of the] apache
apache 3 licensed to the apache software foundation
apache 2 apache [software] license
gpl 4 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl 4 you should have received a copy of the gnu general public license
gpl 4 see the gnu general public license for more details
gpl 3 {licensed|released|distributed|available|published|covered} under [the] [terms of] [the] [gnu] {gpl|general public license}
gpl 3 subject to [the] [terms of] [the] [gnu] {gpl|general public license}
gpl 2 [gnu] general public license
gpl 2 gnu gpl
gpl 2 gpl license
gpl 1 gpl
gpl-1.0 4 spdx license identifier gpl 1 0 [{only|or later}]
gpl-1.0 3 {gplv1|gpl v1}
gpl-2.0 4 spdx license identifier gpl 2 0 [{only|or later}]
gpl-2.0 4 either version 2 of the license or at your option any later version
gpl-2.0 3 [gnu] general public license [as published by the free software foundation] {version 2|v2} [0]
gpl-2.0 3 {gplv2|gpl v2|gpl 2|gpl version 2} [0]
gpl-3.0 4 spdx license identifier gpl 3 0 [{only|or later}]
gpl-3.0 4 either version 3 of the license or at your option any later version
gpl-3.0 3 [gnu] general public license [as published by the free software foundation] {version 3|v3} [0]
gpl-3.0 3 {gplv3|gpl v3|gpl 3|gpl version 3} [0]
gpl-exception 4 {classpath|gcc runtime library|autoconf|bison|font} exception
lgpl 4 you should have received a copy of the gnu {lesser|library} general public license
lgpl 3 {licensed|released|distributed|available} under [the] [terms of] [the] [gnu] {lgpl|lesser general public license|library general public license}
lgpl 3 [gnu] {lesser|library} general public license
lgpl 2 gnu lgpl
lgpl 2 lgpl license
lgpl 1 lgpl
lgpl-2.0 4 spdx license identifier lgpl 2 0 [{only|or later}]
lgpl-2.0 3 [gnu] library general public license {version 2|v2} [0]
lgpl-2.1 4 spdx license identifier lgpl 2 1 [{only|or later}]
lgpl-2.1 4 either version 2 1 of the license or at your option any later version
lgpl-2.1 3 [gnu] lesser general public license [as published by the free software foundation] {version 2|v2} 1
lgpl-2.1 3 {lgplv2|lgpl v2|lgpl 2|lgpl version 2} [1]
lgpl-3.0 4 spdx license identifier lgpl 3 0 [{only|or later}]
lgpl-3.0 3 [gnu] lesser general public license [as published by the free software foundation] {version 3|v3} [0]
lgpl-3.0 3 {lgplv3|lgpl v3|lgpl 3|lgpl version 3} [0]
agpl 4 you should have received a copy of the gnu affero general public license
agpl 4 affero general public license
agpl 3 {licensed|released|distributed|available} under [the] [terms of] [the] [gnu] {agpl|affero}
agpl 2 gnu agpl
agpl 1 agpl
agpl-3.0 4 spdx license identifier agpl 3 0 [{only|or later}]
agpl-3.0 4 [gnu] affero general public license [as published by the free software foundation] {version 3|v3} [0]
agpl-3.0 3 {agplv3|agpl v3|agpl 3|agpl version 3} [0]
sspl 4 server side public license
sspl 3 spdx license identifier sspl 1 0
sspl 1 sspl
gfdl 4 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl 3 spdx license identifier gfdl
gfdl 2 [gnu] free documentation license
gfdl 1 gfdl
mpl-1.0 3 mozilla public license [version] 1 0
mpl-1.1 4 spdx license identifier mpl 1 1
mpl-1.1 3 mozilla public license [version] 1 1
mpl-1.1 3 {mpl|mplv1} 1 1
mpl-2.0 4 this source code form is subject to the terms of the mozilla public license
mpl-2.0 4 spdx license identifier mpl 2 0
mpl-2.0 3 mozilla public license [{version|v}] 2 [0]
mpl-2.0 3 mpl 2 [0]
mpl 2 mozilla public license
epl-1.0 4 spdx license identifier epl 1 0
epl-1.0 3 eclipse public license [{version|v}] {1|v1} [0]
epl-2.0 4 spdx license identifier epl 2 0
epl-2.0 3 eclipse public license [{version|v}] {2|v2} [0]
epl-2.0 3 epl 2 0
epl 2 eclipse public license
edl 3 eclipse distribution license
cddl-1.0 4 spdx license identifier cddl 1 0
cddl-1.0 3 common development and distribution license [version] 1 0
cddl-1.1 3 {cddl 1 1|common development and distribution license version 1 1}
cddl 2 common development and distribution license
cddl 1 cddl
cpl 3 common public license [version 1 0]
ipl 3 ibm public license
spl 3 sun public license
bcl 3 binary code license agreement
unlicense 4 this is free and unencumbered software released into the public domain
unlicense 4 spdx license identifier unlicense
unlicense 2 the unlicense
unlicense 1 unlicense
wtfpl 4 do what the fuck you want to public license
wtfpl 4 spdx license identifier wtfpl
wtfpl 1 wtfpl
zlib 4 this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib 4 altered source versions must be plainly marked as such
zlib 4 spdx license identifier zlib
zlib 2 zlib license
zlib 2 zlib libpng
libpng 2 libpng license
boost-1.0 4 boost software license version 1 0
boost-1.0 4 spdx license identifier bsl 1 0
boost-1.0 4 permission is hereby granted free of charge to any person or organization obtaining a copy of the software
boost 2 boost [software] license
artistic-1.0 4 spdx license identifier artistic 1 0
artistic-1.0 3 artistic license 1 0
artistic-2.0 4 spdx license identifier artistic 2 0
artistic-2.0 3 artistic license [version] 2 [0]
artistic 2 artistic license
perl 3 under the same terms as perl [itself]
python-2.0 4 spdx license identifier python 2 0
python-2.0 3 {python software foundation|psf} license version 2
python 2 python software foundation license
python 2 psf license
php-3.0 3 php license [version] 3 0 [#]
php 2 php license
ruby 2 ruby license
postgresql 4 permission to use copy modify and distribute this software and its documentation for any purpose without fee
postgresql 3 spdx license identifier postgresql
postgresql 2 postgresql license
openssl 4 this product includes software developed by the openssl project
openssl 2 openssl license
ssleay 4 this product includes cryptographic software written by eric young
curl 3 spdx license identifier curl
curl 2 curl license
ntp 2 ntp license
x11 3 spdx license identifier x11
w3c 3 w3c software notice and license
w3c 2 w3c license
unicode 3 unicode license agreement
unicode 2 unicode license
icu 2 icu license
ijg 3 independent jpeg group
freetype 3 freetype project license
freetype 2 freetype license
imagemagick 2 imagemagick license
vim 2 vim license
tcl 2 tcl tk license
beerware 4 buy me a beer in return
beerware 1 beerware
json 4 the software shall be used for good not evil
json 2 json license
ofl-1.1 4 this font software is licensed under the sil open font license
ofl-1.1 4 spdx license identifier ofl 1 1
ofl-1.1 3 [sil] open font license [version] 1 1
ofl 2 [sil] open font license
bitstream-vera 3 bitstream vera fonts copyright
eupl-1.1 3 {eupl|european union public license} [{v|v1|version}] 1 1
eupl-1.2 4 spdx license identifier eupl 1 2
eupl-1.2 3 {eupl|european union public license} [{v|version}] 1 2
eupl 2 european union public license
eupl 1 eupl
cecill-2.1 3 cecill [{v2|version 2|2}] 1
cecill 3 spdx license identifier cecill
cecill 1 {cecill|cecill b|cecill c}
osl-3.0 4 licensed under the open software license version 3 0
osl-3.0 3 {osl 3 0|open software license 3 0}
osl 2 open software license
afl-3.0 3 {afl 3 0|academic free license version 3 0|academic free license 3 0}
afl 2 academic free license
ecl-2.0 3 educational community license [version] 2 0
ms-pl 4 spdx license identifier ms pl
ms-pl 2 microsoft public license
ms-pl 1 ms pl
ms-rl 2 microsoft reciprocal license
ms-rl 1 ms rl
upl 2 universal permissive license
ncsa 3 university of illinois ncsa open source license
ncsa 2 ncsa [open source] license
blueoak 3 blue oak model license
mulan 3 mulan {psl|permissive software license}
anti-996 2 anti 996 license
hippocratic 2 hippocratic license
elastic 4 you may not provide the software to third parties as a hosted or managed service
elastic 3 elastic license [version] [{2|2 0|v2}]
busl 4 spdx license identifier busl 1 1
busl 3 business source license [version] [1 1]
commons-clause 3 commons clause [license condition]
polyform 3 polyform {noncommercial|small business|strict|shield|perimeter|free trial} license
confluent 2 confluent community license
cc0 4 spdx license identifier cc0 1 0
cc0 4 to the extent possible under law the author has waived all copyright
cc0 3 {cc0 1 0|creative commons zero}
cc0 1 cc0
cc-by 3 creative commons attribution [{#|# 0|license}]
cc-by 4 spdx license identifier cc by #
cc-by 3 licensed under [a] [the] {cc by|creative commons attribution}
cc-by 1 cc by
cc-by-sa 4 spdx license identifier cc by sa
cc-by-sa 4 creative commons attribution share alike
cc-by-sa 4 creative commons attribution sharealike
cc-by-sa 3 cc by sa [#]
cc-by-nc 4 creative commons attribution {noncommercial|non commercial}
cc-by-nc 3 cc by nc [#]
cc-by-nc-sa 4 cc by nc sa [#]
cc-by-nc-sa 4 creative commons attribution {noncommercial|non commercial} {sharealike|share alike}
cc-by-nc-nd 4 cc by nc nd [#]
cc-by-nc-nd 4 creative commons attribution {noncommercial|non commercial} {noderivatives|noderivs|no derivatives}
cc-by-nd 4 creative commons attribution {noderivatives|noderivs|no derivatives}
cc-by-nd 3 cc by nd [#]
cc 3 creativecommons org licenses
cc 2 creative commons [license]
odbl 4 spdx license identifier odbl 1 0
odbl 3 {odbl 1 0|open database license version 1 0}
odbl 2 open database license
odc-by 3 open data commons attribution license
pddl 3 public domain dedication and license
cdla 3 community data license agreement {permissive|sharing}
ogl-uk 3 open government license [{v|version}] [#]
etalab 3 licence ouverte
dl-de 3 datenlizenz deutschland
openrail 3 {openrail|openrail m|creativeml open rail m} [license]
llama 3 llama # community license [agreement]
public-domain 3 {released|dedicated|placed} {into|to|in} the public domain
public-domain 2 {is|are} in the public domain
public-domain 1 public domain
proprietary 3 {proprietary and confidential|confidential and proprietary}
proprietary 3 unauthorized {copying|reproduction|distribution} of this {file|software|document|work} [via any medium] is strictly prohibited
proprietary 3 may not be {copied|reproduced|distributed|redistributed} without [the] [express] [prior] [written] {permission|consent}
proprietary 2 proprietary license
proprietary 2 {commercial license|end user license agreement}
proprietary 1 eula
shareware 2 this [software] is shareware
reserved 2 all rights reserved
reserved 2 alle rechte vorbehalten
reserved 2 todos los derechos reservados
reserved 2 tous droits réservés
copyright 2 copyright [c] # _ _
copyright 1 copyright [c] [by] [#] #
copyright 1 {copyright c|copr} #
no-warranty 3 the software is provided as is without warranty of any kind
no-warranty 2 {without|absolutely no} [any] warranty
no-warranty 2 in no event shall the {authors|author|copyright holders|contributors} [or copyright holders] be liable
non-commercial 2 for {non commercial|noncommercial} use only
non-commercial 2 {personal|educational|academic|research} use only
attribution 2 {attribution required|with attribution|please credit the author}
license-file 2 see [the] [file] {license|copying|notice} [file] [for] [more] [details]
license-file 2 {license|copying} {txt|md} [file]
"""

#: words too common to gate a rule by, unless it has no other
COMMON = frozenset("a an and any are as at be by c can do for file for free from in into is it its may must no not of on only or org other public see shall should software source "
                   "terms that the this to under use version was which will with without work works you your 0 1 2 3 4 # _ v license licensed released distributed available".split())
_TOKEN = re.compile(r"[\[\]{}|]|[^\s\[\]{}|]+")


def lines() -> list[tuple[str, int, str]]:
    """(label, priority, pattern), higher priorities first, then as written."""
    out = [(label, int(rank), pattern) for label, rank, pattern in (line.split(" ", 2) for line in TEXT.strip().splitlines())]
    return sorted(out, key=lambda r: -r[1])


def parse(pattern: str):
    """A sequence of words, ("maybe", alternatives) and ("one", alternatives); an alternative is a sequence."""
    tokens, at = _TOKEN.findall(pattern), 0

    def group(close):
        nonlocal at
        out = [[]]
        while at < len(tokens) and tokens[at] != close:
            t = tokens[at]
            at += 1
            if t == "|":
                out.append([])
            elif t in "[{":
                kind, end = ("maybe", "]") if t == "[" else ("one", "}")
                out[-1].append((kind, group(end)))
                at += 1
            else:
                out[-1].append(t)
        return out

    return group(None)[0]


def word_regex(word: str) -> str:
    return {"#": "[0-9]+", "_": "[^ ]+"}.get(word, re.escape(word).replace("license", "licen[cs]e"))


def compiled(pattern: str, numbered: bool = False) -> str:
    """The pattern over text in which every word stands between two spaces of its own, numbered: with its place after \\x02."""

    def one(part):
        if isinstance(part, str):
            word = word_regex(part)
            return f" {word.replace('[^ ]', '[^ \x02]')}\x02[0-9]+ " if numbered else f" {word} "
        kind, alternatives = part
        alternatives = sorted(alternatives, key=len, reverse=True)  # the longest that fits
        return "(?:" + "|".join("".join(map(one, a)) for a in alternatives) + ")" + ("?" if kind == "maybe" else "")

    return "".join(map(one, parse(pattern)))


def keywords(pattern: str) -> frozenset[str]:
    """Words of which every text that matches holds one: the longest that are not common, of each alternative where no single word will do."""

    def of(sequence) -> list[frozenset[str]]:
        found = []
        for part in sequence:
            if isinstance(part, str):
                if part not in "#_":
                    found.append(frozenset([part]))
            elif part[0] == "one":
                inside = [of(a) for a in part[1]]
                if all(inside):
                    found.append(frozenset().union(*(best(i) for i in inside)))
        return found

    def best(options):
        return min(options, key=lambda o: (any(w in COMMON for w in o), len(o), -min(map(len, o)), sorted(o)))

    words = best(of(parse(pattern)))
    return words | {w.replace("license", "licence") for w in words}
