"""Ordered signature rules for licenses: names, sentences of license texts, links, tags and exclusions.

All patterns are over text in normal form: words of digits, small letters and
characters beyond ASCII, with one space between them.  ``~`` stands for license
or licence, ``@`` for an optional version word.  A line is
``label | words, one of which a match must have | pattern``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

#: Kinds of rules, the most telling first, and how sure a match is.
KINDS = {"exclusion": 0.0, "tag": 0.99, "text": 0.97, "link": 0.95, "grant": 0.9, "name": 0.7}

# Names of licenses, as prose gives them.
NAMES = """
0bsd | 0bsd,zero | (?:zero clause bsd|bsd zero clause|0bsd)(?: ~)?
aal | attribution | attribution assurance ~
abstyles | abstyles | abstyles ~
adobe-2006 | adobe | adobe systems incorporated source code ~(?: agreement)?
afl-1.1 | academic,afl | (?:academic free ~|afl) @1 1
afl-1.2 | academic,afl | (?:academic free ~|afl) @1 2
afl-2.0 | academic,afl | (?:academic free ~|afl) @2 0
afl-2.1 | academic,afl | (?:academic free ~|afl) @2 1
afl-3.0 | academic,afl | (?:academic free ~|afl) @3(?: 0)?
agpl | agpl,affero | (?:gnu )?affero (?:general public|gpl) ~|gnu agpl
agpl-1.0 | agpl,affero | (?:(?:gnu )?affero (?:general public|gpl) ~|agpl) @1(?: 0)?
agpl-3.0 | agpl,affero,agplv3,agpl3 | (?:(?:gnu )?affero (?:general public|gpl) ~|(?:gnu )?agpl) @3(?: 0)?|agplv3|agpl3
agpl-3.0-or-later | agpl,affero,agplv3 | (?:(?:(?:gnu )?affero general public ~|(?:gnu )?agpl) @3(?: 0)?|agplv3) or (?:at your option )?(?:any )?later(?: version)?
aladdin | aladdin | aladdin free public ~
apache | apache | apache(?: software)? ~
apache-1.0 | apache | apache(?: software)? ~ @1(?: 0)?
apache-1.1 | apache | apache(?: software)? ~ @1 1
apache-2 | apache,asl | (?:apache(?: software| public)? ~|asl) @2(?: 0)?|apache 2(?: 0)? ~
apsl-1.0 | apple,apsl | (?:apple public source ~|apsl) @1(?: 0)?
apsl-2.0 | apple,apsl | (?:apple public source ~|apsl) @2(?: 0)?
artistic | artistic | (?:perl )?artistic ~
artistic-1.0 | artistic | (?:perl )?artistic ~ @1(?: 0)?
artistic-2.0 | artistic | (?:perl )?artistic ~ @2(?: 0)?
beerware | beer,beerware | beer ?ware ~
bittorrent-1.1 | bittorrent | bittorrent open source ~
blueoak-1.0.0 | blue | blue oak model ~(?: @1 0 0)?
bsd | bsd,berkeley | (?:modified |revised |simplified |new )?bsd(?: style| type)? ~|berkeley software distribution ~
bsd-1-clause | bsd | (?:one|1) clause bsd(?: ~)?|bsd (?:one|1) clause(?: ~)?
bsd-2-clause | bsd,freebsd | (?:two|2) clause bsd(?: ~)?|bsd (?:two|2) clause(?: ~)?|simplified bsd ~|freebsd ~
bsd-3-clause | bsd | (?:three|3) clause bsd(?: ~)?|bsd (?:three|3) clause(?: ~)?|(?:new|modified|revised) bsd ~
bsd-4-clause | bsd | (?:four|4) clause bsd(?: ~)?|bsd (?:four|4) clause(?: ~)?|(?:original|old) bsd ~
bsl-1.0 | boost,bsl | boost software ~(?: @1(?: 0)?)?
busl-1.1 | business | business source ~(?: @1 1)?
bzip2-1.0.6 | bzip2 | bzip2(?: and libbzip2)? ~
cal-1.0 | cryptographic | cryptographic autonomy ~
caldera | caldera | caldera ~
catosl-1.1 | computer | computer associates trusted open source ~
cc-by | cc,commons | (?:creative commons|cc) (?:attribution|by)
cc-by-1.0 | cc,commons | (?:creative commons attribution|cc by)(?: (?:generic|unported|international))?(?: ~)? @1 0
cc-by-2.0 | cc,commons | (?:creative commons attribution|cc by)(?: (?:generic|unported|international))?(?: ~)? @2 0
cc-by-2.5 | cc,commons | (?:creative commons attribution|cc by)(?: (?:generic|unported|international))?(?: ~)? @2 5
cc-by-3.0 | cc,commons | (?:creative commons attribution|cc by)(?: (?:generic|unported|international))?(?: ~)? @3 0
cc-by-4.0 | cc,commons | (?:creative commons attribution|cc by)(?: (?:generic|unported|international))?(?: ~)? @4 0
cc-by-nc | cc,commons | (?:creative commons|cc) (?:attribution non ?commercial|by nc)
cc-by-nc-2.0 | cc,commons | (?:creative commons|cc) (?:attribution non ?commercial|by nc)(?: generic)? @2 0
cc-by-nc-3.0 | cc,commons | (?:creative commons|cc) (?:attribution non ?commercial|by nc)(?: unported)? @3 0
cc-by-nc-4.0 | cc,commons | (?:creative commons|cc) (?:attribution non ?commercial|by nc)(?: international)? @4 0
cc-by-nc-nd | cc,commons | (?:creative commons|cc) (?:attribution non ?commercial no ?deriv(?:ative)?s(?: works)?|by nc nd)
cc-by-nc-nd-3.0 | cc,commons | (?:creative commons|cc) (?:attribution non ?commercial no ?deriv(?:ative)?s(?: works)?|by nc nd) @3 0
cc-by-nc-nd-4.0 | cc,commons | (?:creative commons|cc) (?:attribution non ?commercial no ?deriv(?:ative)?s(?: works)?|by nc nd) @4 0
cc-by-nc-sa | cc,commons | (?:creative commons|cc) (?:attribution non ?commercial share ?alike|by nc sa)
cc-by-nc-sa-3.0 | cc,commons | (?:creative commons|cc) (?:attribution non ?commercial share ?alike|by nc sa) @3 0
cc-by-nc-sa-4.0 | cc,commons | (?:creative commons|cc) (?:attribution non ?commercial share ?alike|by nc sa) @4 0
cc-by-nd | cc,commons | (?:creative commons|cc) (?:attribution no ?deriv(?:ative)?s(?: works)?|by nd)
cc-by-nd-3.0 | cc,commons | (?:creative commons|cc) (?:attribution no ?deriv(?:ative)?s(?: works)?|by nd) @3 0
cc-by-nd-4.0 | cc,commons | (?:creative commons|cc) (?:attribution no ?deriv(?:ative)?s(?: works)?|by nd) @4 0
cc-by-sa | cc,commons | (?:creative commons|cc) (?:attribution share ?alike|by sa)
cc-by-sa-2.5 | cc,commons | (?:creative commons|cc) (?:attribution share ?alike|by sa) @2 5
cc-by-sa-3.0 | cc,commons | (?:creative commons|cc) (?:attribution share ?alike|by sa) @3 0
cc-by-sa-4.0 | cc,commons | (?:creative commons|cc) (?:attribution share ?alike|by sa) @4 0
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: universal)?(?: ~)?(?: @1 0)?(?: universal)?
cddl-1.0 | cddl,distribution | (?:common development and distribution ~|cddl)(?: @1(?: 0)?)?
cddl-1.1 | cddl,distribution | (?:common development and distribution ~|cddl) @1 1
cecill-1.0 | cecill | cecill(?: free software)?(?: ~)?(?: agreement)? @1(?: 0)?
cecill-2.0 | cecill | cecill(?: free software)?(?: ~)?(?: agreement)? @2(?: 0)?
cecill-2.1 | cecill | cecill(?: free software)?(?: ~)?(?: agreement)? @2 1
cecill-b | cecill | cecill b(?: ~)?
cecill-c | cecill | cecill c(?: ~)?
clartistic | clarified | clarified artistic ~
cnri-python | cnri | cnri(?: open source)? ~(?: agreement)?
cpal-1.0 | cpal,attribution | (?:common public attribution ~|cpal)(?: @1(?: 0)?)?
cpl-1.0 | cpl,common | (?:ibm )?common public ~(?: @1(?: 0)?)?|cpl @1 0
curl | curl | curl ~
ecl-1.0 | educational,ecl | (?:educational community ~|ecl) @1(?: 0)?
ecl-2.0 | educational,ecl | (?:educational community ~|ecl) @2(?: 0)?
efl-2.0 | eiffel | eiffel forum ~(?: @2)?
elastic-2.0 | elastic | elastic ~(?: @2(?: 0)?)?
entessa | entessa | entessa public ~
epl-1.0 | eclipse,epl | (?:eclipse public ~|epl)(?: @1(?: 0)?)?
epl-2.0 | eclipse,epl | (?:eclipse public ~|epl) @2(?: 0)?
edl-1.0 | eclipse,edl | (?:eclipse distribution ~|edl)(?: @1(?: 0)?)?
eudatagrid | eu | eu datagrid software ~
eupl-1.1 | eupl,european | (?:european union public ~|eupl) @1 1
eupl-1.2 | eupl,european | (?:european union public ~|eupl)(?: @1 2)?
fair | fair | fair ~ usage of the works
frameworx-1.0 | frameworx | frameworx(?: open)? ~
ftl | freetype | freetype (?:project )?~
gfdl-1.1 | fdl,gfdl,documentation | (?:gnu free documentation ~|gnu fdl|gfdl) @1 1
gfdl-1.2 | fdl,gfdl,documentation | (?:gnu free documentation ~|gnu fdl|gfdl) @1 2
gfdl-1.3 | fdl,gfdl,documentation | (?:gnu free documentation ~|gnu fdl|gfdl)(?: @1 3)?
gpl | gpl,general | (?:gnu )?general public ~|gnu gpl|gpl ~
gpl-1.0 | gpl,general | (?:(?:gnu )?general public ~|(?:gnu )?gpl) @1(?: 0)?
gpl-2.0 | gpl,general,gplv2,gpl2 | (?:(?:gnu )?general public ~|(?:gnu )?gpl) @2(?: 0)?|gplv2|gpl2
gpl-2.0-or-later | gpl,general,gplv2 | (?:(?:(?:gnu )?general public ~|(?:gnu )?gpl) @2(?: 0)?|gplv2) or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0 | gpl,general,gplv3,gpl3 | (?:(?:gnu )?general public ~|(?:gnu )?gpl) @3(?: 0)?|gplv3|gpl3
gpl-3.0-or-later | gpl,general,gplv3 | (?:(?:(?:gnu )?general public ~|(?:gnu )?gpl) @3(?: 0)?|gplv3) or (?:at your option )?(?:any )?later(?: version)?
gpl-with-classpath | classpath | (?:gnu )?classpath exception
gpl-with-linking | linking | (?:gpl|general public ~) with (?:a |the )?linking exception
hpnd | historical | historical permission notice and disclaimer
icu | icu | icu ~
ijg | jpeg | independent jpeg group ~
imlib2 | imlib2 | imlib2 ~
intel | intel | intel open source ~
ipa | ipa | ipa font ~
ipl-1.0 | ibm | ibm public ~(?: @1(?: 0)?)?
isc | isc,internet | isc ~|internet systems consortium ~|internet software consortium ~
jasper-2.0 | jasper | jasper ~
json | json | json ~
lgpl | lgpl,lesser,library | (?:gnu )?(?:lesser|library) (?:general public|gpl) ~|gnu lgpl|lgpl ~
lgpl-2.0 | lgpl,lesser,library,lgplv2 | (?:(?:gnu )?(?:lesser|library) general public ~|(?:gnu )?lgpl) @2(?: 0)?|lgplv2
lgpl-2.1 | lgpl,lesser,library,lgplv2 | (?:(?:gnu )?(?:lesser|library) general public ~|(?:gnu )?lgpl) @2 1|lgplv2 1
lgpl-2.1-or-later | lgpl,lesser,library,lgplv2 | (?:(?:(?:gnu )?(?:lesser|library) general public ~|(?:gnu )?lgpl) @2 1|lgplv2 1) or (?:at your option )?(?:any )?later(?: version)?
lgpl-3.0 | lgpl,lesser,lgplv3 | (?:(?:gnu )?lesser general public ~|(?:gnu )?lgpl) @3(?: 0)?|lgplv3
lgpl-3.0-or-later | lgpl,lesser,lgplv3 | (?:(?:(?:gnu )?lesser general public ~|(?:gnu )?lgpl) @3(?: 0)?|lgplv3) or (?:at your option )?(?:any )?later(?: version)?
libpng | libpng | (?:libpng|png reference library) ~(?: @2)?
libtiff | libtiff | libtiff ~
liliq-p-1.1 | quebec | licence libre du quebec permissive
lpl-1.02 | lucent | lucent public ~
lppl-1.3c | latex,lppl | (?:latex project public ~|lppl)(?: @1 3c?)?
mirros | miros | miros ~
mit | mit,expat | mit(?: x11| style)? ~|expat(?: mit)? ~|x11 mit ~
mit-0 | mit | mit no attribution(?: ~)?|mit 0(?: ~)?
motosoto | motosoto | motosoto open source ~
mpl-1.0 | mozilla,mpl | (?:mozilla public ~|mpl) @1(?: 0)?
mpl-1.1 | mozilla,mpl | (?:mozilla public ~|mpl) @1 1
mpl-2.0 | mozilla,mpl,mplv2 | (?:mozilla public ~|mpl) @2(?: 0)?|mplv2
mpl | mozilla | mozilla public ~
ms-lpl | microsoft | microsoft limited public ~
ms-pl | microsoft,ms | microsoft public ~|ms pl ~
ms-rl | microsoft,ms | microsoft reciprocal ~|ms rl ~
mulan-psl-2.0 | mulan | mulan (?:permissive software ~|psl)(?: @2)?
multics | multics | multics ~
nasa-1.3 | nasa | nasa open source agreement(?: @1 3)?
naumen | naumen | naumen public ~
ncsa | ncsa | (?:university of illinois )?ncsa open source ~|ncsa ~
nethack | nethack | nethack general public ~
nokia | nokia | nokia open source ~
nosl-3.0 | non | non profit open software ~(?: @3 0)?
npl-1.1 | netscape | netscape public ~(?: @1 1)?
ntp | ntp | ntp ~
oclc-2.0 | oclc | oclc research public ~(?: @2(?: 0)?)?
odbl-1.0 | odbl,database | (?:open (?:data commons open )?database ~|odbl)(?: @1(?: 0)?)?
odc-by-1.0 | odc,attribution | (?:open data commons attribution ~|odc by)(?: @1(?: 0)?)?
ofl-1.0 | ofl,sil,font | (?:sil )?open font ~ @1 0|ofl 1 0
ofl-1.1 | ofl,sil,font | (?:sil )?open font ~(?: @1 1)?|sil ofl(?: 1 1)?|ofl 1 1
ogc-1.0 | ogc | ogc software ~
ogl-uk-3.0 | ogl,government | (?:uk )?open government ~(?: @3(?: 0)?)?
oldap-2.8 | openldap | openldap public ~(?: @2 8)?
openssl | openssl | openssl ~
osl-1.0 | osl,software | (?:open software ~|osl) @1(?: 0)?
osl-2.1 | osl,software | (?:open software ~|osl) @2 1
osl-3.0 | osl,software | (?:open software ~|osl) @3(?: 0)?
pddl-1.0 | pddl,dedication | (?:open data commons )?public domain dedication and ~|pddl(?: @1(?: 0)?)?
php-3.0 | php | php ~ @3(?: 0)?
php-3.01 | php | php ~(?: @3 01)?
polyform-nc-1.0.0 | polyform | polyform non ?commercial ~(?: @1 0 0)?
postgresql | postgresql | postgresql ~
psf-2.0 | python,psf | python(?: software foundation)? ~(?: agreement)?(?: @2(?: 0)?)?|psf ~(?: agreement)?(?: @2)?
public-domain | public | (?:released|placed|dedicated) (?:in|into|to) the public domain|public domain dedication
qpl-1.0 | qpl,q | q public ~(?: @1(?: 0)?)?|qpl @1 0
rpl-1.5 | reciprocal,rpl | (?:reciprocal public ~|rpl)(?: @1 5)?
rpsl-1.0 | realnetworks | realnetworks public source ~
ruby | ruby | ruby(?: s)? ~
saxpath | saxpath | saxpath ~
sgi-b-2.0 | sgi | sgi free software ~ b(?: @2(?: 0)?)?
simpl-2.0 | simple | simple public ~(?: @2 0)?
sissl | sissl,sun | sun industry standards source ~|sissl
sleepycat | sleepycat | sleepycat ~
spl-1.0 | sun | sun public ~(?: @1(?: 0)?)?
sspl-1.0 | sspl,server | (?:server side public ~|sspl)(?: @1(?: 0)?)?
tcl | tcl | tcl(?: tk)? ~
ucl-1.0 | upstream | upstream compatibility ~
unicode | unicode | unicode (?:data files and software )?~(?: agreement)?
unlicense | unlicense | (?:the )?unlicense
upl-1.0 | universal | universal permissive ~(?: @1(?: 0)?)?
vim | vim | vim ~
vsl-1.0 | vovida | vovida software ~
w3c | w3c | w3c software(?: and document)?(?: notice and)? ~
watcom-1.0 | watcom | sybase open watcom public ~
wtfpl | wtfpl,want | (?:do what the fuck you want to public ~|wtfpl)(?: @2)?
x11 | x11 | x11 ~
xfree86-1.1 | xfree86 | xfree86 ~(?: @1 1)?
zend-2.0 | zend | zend(?: engine)? ~(?: @2(?: 0)?)?
zlib | zlib | zlib(?: libpng)? ~
zpl-2.1 | zope,zpl | (?:zope public ~|zpl)(?: @2 1)?
"""

# Sentences of license texts and notices.
TEXTS = """
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | copies | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
isc | hereby | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd | hereby | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-3-clause | endorse | neither the names? of (?:the )?(?:[^ ]+ ){1,12}?nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | apache | licensed under the apache ~ version 2 0 the license you may not use this file except in compliance with the ~
apache-2 | contributor | subject to the terms and conditions of this ~ each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright ~
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl | gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public ~ as published by the free software foundation
gpl-2.0-or-later | foundation | under the terms of the gnu general public ~ as published by the free software foundation either version 2 of the ~ or at your option any later version
gpl-3.0-or-later | foundation | under the terms of the gnu general public ~ as published by the free software foundation either version 3 of the ~ or at your option any later version
gpl-2.0 | foundation | under the terms of the gnu general public ~ version 2 (?:only )?as published by the free software foundation
gpl-3.0 | foundation | under the terms of the gnu general public ~ version 3 (?:only )?as published by the free software foundation
gpl-2.0 | freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | copyleft | the gnu general public ~ is a free copyleft ~ for software and other kinds of works
gpl | gnu | you should have received a copy of the gnu general public ~ along with this (?:program|file|package|library)
lgpl | library | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public ~
lgpl-2.1-or-later | foundation | under the terms of the gnu lesser general public ~ as published by the free software foundation either version 2 1 of the ~ or at your option any later version
lgpl-3.0-or-later | foundation | under the terms of the gnu lesser general public ~ as published by the free software foundation either version 3 of the ~ or at your option any later version
lgpl-2.0 | library | under the terms of the gnu library general public ~ as published by the free software foundation either version 2 of the ~
lgpl | gnu | you should have received a copy of the gnu lesser general public ~ along with this
agpl-3.0-or-later | affero | under the terms of the gnu affero general public ~ as published by the free software foundation either version 3 of the ~ or at your option any later version
agpl-3.0 | affero | the gnu affero general public ~ is a free copyleft ~ for software and other kinds of works specifically designed to ensure cooperation with the community
gfdl-1.3 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation ~ version 1 3
gfdl-1.2 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation ~ version 1 2
gfdl-1.1 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation ~ version 1 1
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public ~ v 2 0 if a copy of the mpl was not distributed with this file
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public ~ version 1 1 the ~ you may not use this file except in compliance with the ~
mpl-1.0 | mozilla | the contents of this file are subject to the mozilla public ~ version 1 0
npl-1.1 | netscape | the contents of this file are subject to the netscape public ~ version 1 1
cddl-1.0 | cddl,distribution | the contents of this file are subject to the terms of the common development and distribution ~
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public ~ v1 0
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public ~ 2 0
edl-1.0 | eclipse | made available under the terms of the eclipse distribution ~ v 1 0
cpl-1.0 | common | made available under the terms of the common public ~ v1 0
epl-1.0 | agreement | the accompanying program is provided under the terms of this eclipse public ~ agreement
ipl-1.0 | ibm | the accompanying program is provided under the terms of this ibm public ~ agreement
artistic-1.0 | artistic | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2.0 | establishes | this ~ establishes the terms under which a given free software package may be copied modified distributed and or redistributed
bsl-1.0 | accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this ~
bsl-1.0 | boost | distributed under the boost software ~ version 1 0
zlib | damages | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | you just do what the fuck you want to
beerware | beer | you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer in return
cc0-1.0 | waives | to the extent possible under law (?:[^ ]+ ){1,12}?has waived all copyright and related or neighboring rights
cc-by-4.0 | commons | this work is licensed under (?:a |the )?creative commons attribution 4 0 international ~
cc-by-3.0 | commons | this work is licensed under (?:a |the )?creative commons attribution 3 0 unported ~
cc-by-sa-4.0 | commons | this work is licensed under (?:a |the )?creative commons attribution sharealike 4 0 international ~
cc-by-sa-3.0 | commons | this work is licensed under (?:a |the )?creative commons attribution sharealike 3 0 unported ~
cc-by-nc-4.0 | commons | this work is licensed under (?:a |the )?creative commons attribution noncommercial 4 0 international ~
cc-by-nc-sa-4.0 | commons | this work is licensed under (?:a |the )?creative commons attribution noncommercial sharealike 4 0 international ~
cc-by-nc-nd-4.0 | commons | this work is licensed under (?:a |the )?creative commons attribution noncommercial noderivatives 4 0 international ~
cc-by-nd-4.0 | commons | this work is licensed under (?:a |the )?creative commons attribution noderivatives 4 0 international ~
ofl-1.1 | font | this font software is licensed under the sil open font ~ version 1 1
ofl-1.1 | font | the goals of the open font ~ ofl are to stimulate worldwide development of collaborative font projects
odbl-1.0 | database | this database is made available under the open database ~
pddl-1.0 | database | this database is made available under the public domain dedication and ~
psf-2.0 | psf | this ~ agreement is between the python software foundation psf and the individual or organization
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | cryptographic | this product includes cryptographic software written by eric young
ijg | jpeg | this software is based in part on the work of the independent jpeg group
libpng | png | the png reference library is supplied as is
ftl | freetype | portions of this software are copyright (?:[^ ]+ ){0,4}the freetype project
ntp | hereby | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies
hpnd | hereby | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
postgresql | agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | documentation | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
json | evil | the software shall be used for good not evil
php-3.01 | php | this product includes php software freely available from
ms-pl | governs | this ~ governs use of the accompanying software if you use the software you accept this ~
upl-1.0 | condition | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
ecl-2.0 | educational | licensed under the educational community ~ version 2 0 the license you may not use this file except in compliance with the ~
afl-3.0 | academic | licensed under the academic free ~ version 3 0
osl-3.0 | open | licensed under the open software ~ version 3 0
eupl-1.2 | eupl | licensed under the eupl version 1 2
lppl-1.3c | latex | this work may be distributed and or modified under the conditions of the latex project public ~
vim | vim | there are no restrictions on distributing unmodified copies of vim except that they must include this ~ text
w3c | w3c | this work is being provided by the copyright holders under the following ~ (?:[^ ]+ ){0,20}?w3c
sspl-1.0 | service | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | change | effective on the change date or the fourth anniversary of the first publicly available distribution
elastic-2.0 | hosted | you may not provide the software to third parties as a hosted or managed service
proprietary | reserved,reproduction | all rights reserved (?:[^ ]+ ){0,6}?(?:no part|unauthori[sz]ed (?:copying|reproduction))
proprietary | confidential | this (?:software|file|source code) is (?:the )?(?:confidential and proprietary|proprietary and confidential)(?: information)?
proprietary | unauthorized,unauthorised | unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|software|document|work) (?:via any medium )?is (?:strictly )?prohibited
"""

# Addresses of license texts.
LINKS = """
mit | mit | opensource org licenses mit(?: license php)?
apache-2 | apache | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2 | apache | opensource org licenses apache 2 0
apache-1.1 | apache | (?:www )?apache org licenses license 1 1
bsd-2-clause | bsd | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | opensource org licenses bsd 3 clause
bsd | bsd | opensource org licenses bsd license php
isc | isc | opensource org licenses isc
zlib | zlib | opensource org licenses zlib
unlicense | unlicense | unlicense org
wtfpl | wtfpl | (?:www )?wtfpl net
bsl-1.0 | boost | (?:www )?boost org license 1 0 txt
mpl-2.0 | mozilla | (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-1.1 | mozilla | (?:www )?mozilla org mpl mpl 1 1 html
epl-1.0 | eclipse | (?:www )?eclipse org legal epl v10 html
epl-2.0 | eclipse | (?:www )?eclipse org legal epl 2 0
gpl | gnu | (?:www )?gnu org (?:copyleft|licenses) gpl html
gpl-2.0 | gnu | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3.0 | gnu | (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
lgpl-2.1 | gnu | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3.0 | gnu | (?:www )?gnu org licenses lgpl 3 0(?: html| txt)?
agpl-3.0 | gnu | (?:www )?gnu org licenses agpl 3 0(?: html| txt)?
gfdl-1.3 | gnu | (?:www )?gnu org licenses fdl 1 3(?: html| txt)?
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
cc-by-2.0 | creativecommons | creativecommons org licenses by 2 0
cc-by-2.5 | creativecommons | creativecommons org licenses by 2 5
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-sa-2.5 | creativecommons | creativecommons org licenses by sa 2 5
cc-by-sa-3.0 | creativecommons | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
cc-by-nc-2.0 | creativecommons | creativecommons org licenses by nc 2 0
cc-by-nc-3.0 | creativecommons | creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
cc-by-nd-3.0 | creativecommons | creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0 | creativecommons | creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0 | creativecommons | creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
odbl-1.0 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | opendatacommons | opendatacommons org licenses by(?: 1 0)?
pddl-1.0 | opendatacommons | opendatacommons org licenses pddl(?: 1 0)?
ofl-1.1 | sil | scripts sil org ofl
artistic-2.0 | perlfoundation | (?:www )?perlfoundation org artistic license 2 0
php-3.01 | php | (?:www )?php net license 3 01 txt
psf-2.0 | python | docs python org (?:3 )?license html
zpl-2.1 | zope | (?:www )?zope org resources zpl
eupl-1.2 | eupl | joinup ec europa eu (?:[^ ]+ ){0,4}?eupl
ogl-uk-3.0 | nationalarchives | (?:www )?nationalarchives gov uk doc open government licence version 3
"""

# Where a license is named but not given.
EXCLUSIONS = """
 | compatible,incompatible | (?:in)?compatible with (?:[^ ]+ ){0,3}?(?:[^ ]+ ){1,7}?~
 | unlike | unlike (?:the )?(?:[^ ]+ ){1,7}?~
 | not | not (?:licensed|released|distributed|available|covered|published) under (?:[^ ]+ ){1,9}?~
 | neither | neither (?:the )?(?:[^ ]+ ){1,6}?~ nor (?:the )?(?:[^ ]+ ){1,6}?~
 | driver,drivers,driving,fishing,hunting,marriage,liquor | (?:drivers?|driving|fishing|hunting|marriage|liquor)(?: s)? ~
"""

_GRANT = r"(?:(?:dual )?licen[cs]ed|released|(?:re)?distributed|available|published|provided|shared|issued|open sourced|offered|covered) (?:[^ ]+ ){0,2}?(?:under|by|with) (?:the |a |an )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"
_TAG = r"(?:spdx license identifier|~ (?:id|identifier|type|name)|classifier ~(?: osi approved)?) (?:the )?"


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keys: frozenset[bytes]
    pattern: re.Pattern[bytes]


def _rows(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ", 2)] for line in table.splitlines() if line.strip()]


def _compiled(text: str) -> re.Pattern[bytes]:
    text = text.replace("~", "licen[cs]es?").replace("@", "(?:version |v |release )?(?:v)?")
    return re.compile(rf"(?<![^ ])(?:{text})(?![^ ])".encode())


def _spdx(label: str) -> str:
    """The identifier of a license as words."""
    return " ".join(re.findall("[0-9a-z]+", label))


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, those of the more telling kinds first."""
    names, out = _rows(NAMES), []
    keys = lambda text: frozenset(k.encode() for k in text.split(","))
    out += [Rule(label, "exclusion", keys(k), _compiled(p)) for label, k, p in (["", *row[-2:]] for row in _rows(EXCLUSIONS))]
    out += [Rule(label, "tag", frozenset([b"identifier", b"id", b"type", b"name", b"classifier"]), _compiled(f"{_TAG}(?:{_spdx(label)}(?: only)?|{p})")) for label, _, p in names]
    out += [Rule(label, "text", keys(k), _compiled(p)) for label, k, p in _rows(TEXTS)]
    out += [Rule(label, "link", keys(k), _compiled(p)) for label, k, p in _rows(LINKS)]
    out += [Rule(label, "grant", keys(k), _compiled(f"{_GRANT}(?:{p})")) for label, k, p in names]
    out += [Rule(label, "name", keys(k), _compiled(p)) for label, k, p in names]
    return tuple(out)
