"""License signatures written by hand: one regular expression a line, by kind of evidence.

A line has a label, the words that open the rule (any of them, as a whole word of the text) and an
expression. In an expression a blank stands for any run of ASCII characters that are neither letters nor
digits, `` ?`` for one that may be missing, and the ends must not touch a letter or digit.
"""

from __future__ import annotations

# Sentences of license texts, headers and notices.
SENTENCES = """
agpl remotely if you modify the program your modified version must prominently offer all users interacting with it remotely
agpl remotely interact(?:ing)? with it remotely through a computer network
apache compliance (?:you )?may not use this file except in compliance with the licen[cs]e
apache applicable unless required by applicable law or agreed to in writing(?: software)?
apache irrevocable hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[cs]e
apache 2004 version 2 0 january 2004
artistic artistic you may (?:charge a reasonable copying fee|distribute (?:complete )?verbatim copies) .{0,80}artistic licen[cs]e
beerware beer (?:you can )?buy me a beer in return
bsd redistribution redistribution and use in source and binary forms with or without modification(?: are permitted)?
bsd redistributions redistributions of source code must retain the (?:above )?copyright notice
bsd redistributions redistributions in binary form must reproduce the (?:above )?copyright notice
bsd endorse neither the names? of (?:the )?(?:copyright holders?|author|[a-z ]{1,40}) nor the names of (?:its|their|any) contributors
bsd endorse may be used to endorse or promote products derived from this software without
bsd acknowledgement all advertising materials mentioning features or use of this software must display the following acknowledge?ment
boost organization permission is hereby granted free of charge to any person or organization obtaining a copy
cc-by credit (?:you )?must give appropriate credit(?: provide a link to the licen[cs]e)?
cc-by-nc commercial (?:you )?may not use the (?:material|work) for commercial purposes
cc-by-nd remix if you remix transform or build upon the material you may not distribute
cc-by-sa remix if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e
cc0 waived (?:has |have )?waived all (?:copyright|rights) and related (?:or|and) neighbou?ring rights
cddl cddl (?:subject to|governed by) the terms of the (?:cddl|common development and distribution licen[cs]e)
cecill cecill (?:abiding by the rules|governed by the cecill)
epl eclipse accompanying materials are made available under the terms of the eclipse public licen[cs]e
eupl eupl licen[cs]ed under the eupl(?: version| v)?(?: 1 [012])?
gfdl invariant with no invariant sections(?: with)? no front cover texts
gfdl document permission is granted to copy distribute and or modify this document under the terms of the gnu free
gpl redistribute this (?:program|file|software|code|script) is free software you can redistribute it and or modify
gpl option either version [123](?: [0-9])?(?: of the licen[cs]e)? or at your option any later version
gpl implied (?:but )?without any warranty without even the implied warranty of(?: merchantability)?
gpl gnu you should have received a copy of the gnu general public licen[cs]e
gpl foundation as published by the free software foundation
isc purpose permission to use copy modify and or distribute this software for any purpose with or without fee
lgpl redistribute this library is free software you can redistribute it and or modify
lgpl gnu you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
lgpl linking as a special exception .{0,60}link(?:ing)? this library
lppl lppl (?:distributed|modified) under the (?:conditions|terms) of the (?:latex project public licen[cs]e|lppl)
mit hereby permission is hereby granted free of charge to any person obtaining a copy of this software
mit sublicense to use copy modify merge publish distribute sublicense and or sell copies
mit permission the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies
mit noninfringement in no event shall the (?:authors?|x consortium) (?:or copyright holders )?be liable for any claim
mpl mozilla subject to the terms of the mozilla public licen[cs]e
mpl incompatible this source code form is (?:subject to|incompatible with)
ms-pl reproduction (?:each contributor grants you|the terms reproduce reproduction) .{0,90}microsoft
ncsa illinois (?:university of )?illinois (?:at )?urbana champaign .{0,80}redistributions
ofl font the font software may be sold as part of a larger software package
ofl font reserved font name(?:s)?(?: may not be used)?
openssl openssl this product includes software developed by the openssl project
php php this product includes php (?:software )?freely available from
proprietary reserved all rights reserved
proprietary confidential (?:strictly )?confidential and proprietary|proprietary and confidential
proprietary reproduced,copied,distributed (?:may|must|shall) not be (?:copied|reproduced|distributed)(?: or (?:copied|reproduced|distributed))*(?: in (?:any form|whole or in part))? without(?: the)?(?: express| prior| written)* (?:permission|consent)
proprietary publication no part of this (?:publication|work|book|document) may be reproduced
proprietary unauthori[sz]ed unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: (?:or|and) [a-z]+)* (?:of this (?:file|work|software) )?is (?:strictly )?prohibited
proprietary internal for internal use only
public-domain domain (?:released|placed|put) (?:in|into) the public domain
public-domain domain (?:hereby )?dedicated? (?:this work )?to the public domain
public-domain domain (?:this|the) (?:work|file|code|software|program) is (?:hereby )?(?:in|part of) the public domain
python psf psf hereby grants licensee a nonexclusive royalty free
sspl sspl (?:licen[cs]ed|released) under the (?:server side public licen[cs]e|sspl)
unlicense unencumbered this is free and unencumbered software released into the public domain
vim vim there are no restrictions on distributing (?:un)?modified copies of vim
wtfpl fuck you just do what the fuck you want to
zlib misrepresented (?:the )?origin of this software must not be misrepresented
zlib altered altered source versions must be plainly marked as such
zlib warranty this software is provided as is without any express or implied warranty in no event will the authors
zpl zope this product includes software developed by zope corporation
"""

# Addresses of license texts.
ADDRESSES = """
0bsd 0bsd opensource\\.org/licen[cs]es?/0bsd
afl afl opensource\\.org/licen[cs]es?/afl-?[0-9.]*
agpl agpl (?:www\\.)?gnu\\.org/licenses/agpl(?:-3\\.0)?
apache apache (?:www\\.)?apache\\.org/licenses(?:/license-[12]\\.[01](?:\\.txt)?)?
apache apache opensource\\.org/licen[cs]es?/apache-?2\\.0
artistic artistic (?:opensource\\.org/licen[cs]es?/artistic|dev\\.perl\\.org/licenses/artistic)
boost boost (?:www\\.)?boost\\.org/license_1_0\\.txt
bsd bsd opensource\\.org/licen[cs]es?/bsd(?:-[1-4]-clause)?
cc-by by creativecommons\\.org/licenses/by/[1-4]\\.[05]
cc-by-nc nc creativecommons\\.org/licenses/by-nc/[1-4]\\.[05]
cc-by-nc-nd nc creativecommons\\.org/licenses/by-nc-nd/[1-4]\\.[05]
cc-by-nc-sa nc creativecommons\\.org/licenses/by-nc-sa/[1-4]\\.[05]
cc-by-nd nd creativecommons\\.org/licenses/by-nd/[1-4]\\.[05]
cc-by-sa sa creativecommons\\.org/licenses/by-sa/[1-4]\\.[05]
cc0 publicdomain creativecommons\\.org/publicdomain/zero(?:/1\\.0)?
cddl cddl opensource\\.org/licen[cs]es?/cddl-?1(?:\\.0)?
cecill cecill (?:www\\.)?cecill\\.info/licences
ecl ecl opensource\\.org/licen[cs]es?/ecl-?[12]
elastic elastic (?:www\\.)?elastic\\.co/licensing/elastic-license
epl epl (?:www\\.)?eclipse\\.org/(?:legal/epl(?:-(?:v10|2\\.0))?|org/documents/epl-v10)
eupl eupl joinup\\.ec\\.europa\\.eu/.{0,60}eupl
gfdl fdl (?:www\\.)?gnu\\.org/(?:licenses|copyleft)/fdl
gpl gpl,gnu (?:www\\.)?gnu\\.org/(?:licenses|copyleft)/(?:old-licenses/)?gpl(?:-[123]\\.0)?
gpl gpl opensource\\.org/licen[cs]es?/gpl-[23]\\.0
isc isc opensource\\.org/licen[cs]es?/isc
lgpl lgpl,gnu (?:www\\.)?gnu\\.org/(?:licenses|copyleft)/(?:old-licenses/)?(?:lgpl|lesser)(?:-[23]\\.[01])?
lgpl lgpl opensource\\.org/licen[cs]es?/lgpl-[23]\\.[01]
lppl lppl (?:www\\.)?latex-project\\.org/lppl
mit mit opensource\\.org/licen[cs]es?/mit
mpl mpl (?:www\\.)?mozilla\\.org/(?:[a-z]{2}-[a-z]{2}/)?mpl(?:/[12]\\.[01])?
ms-pl ms opensource\\.org/licen[cs]es?/ms-pl
ncsa ncsa opensource\\.org/licen[cs]es?/ncsa
odbl odbl,odc opendatacommons\\.org/licenses/(?:odbl|by)
ofl ofl scripts\\.sil\\.org/ofl
openssl openssl (?:www\\.)?openssl\\.org/source/license
osl osl opensource\\.org/licen[cs]es?/osl-?[123]\\.[01]
php php (?:www\\.)?php\\.net/license(?:/3_01)?
postgresql postgresql (?:www\\.)?(?:postgresql\\.org/about/licence|opensource\\.org/licen[cs]es?/postgresql)
python python docs\\.python\\.org/[0-9.]*/?license|python\\.org/psf/license
unlicense unlicense unlicense\\.org
wtfpl wtfpl (?:www\\.)?wtfpl\\.net
zlib zlib (?:www\\.)?zlib\\.net/zlib_license|opensource\\.org/licen[cs]es?/zlib
zpl zpl opensource\\.org/licen[cs]es?/zpl-?2
"""

# Names that stand for a license wherever they occur.
NAMES = """
0bsd 0bsd 0bsd(?: licen[cs]e)?
0bsd clause (?:zero|0) clause bsd(?: licen[cs]e)?
afl academic academic free licen[cs]e(?: (?:v|version )?[123] [012])?
afl afl afl (?:v|version )?[123] [012]
agpl affero (?:gnu )?affero general public licen[cs]e(?: (?:v|version )?[13](?: 0)?)?
agpl agpl,agplv3 agpl ?(?:v|version )?[13](?: 0)?(?: only| or later)?
agpl agpl (?:gnu )?agpl(?: licen[cs]ed?)?
apache apache apache (?:software |public )?licen[cs]e(?:s)?(?: (?:v|version )?[12](?: [01])?)?
apache apache apache (?:v|version )?2 0(?: licen[cs]ed?)?
apache apache asl (?:v|version )?2 0|apache style licen[cs]e
apple apple apple public source licen[cs]e(?: (?:v|version )?[12] [012])?
apple apsl apsl(?: (?:v|version )?[12] [012])?
artistic artistic (?:the |perl |clarified )?artistic licen[cs]e(?: (?:v|version )?[12](?: 0)?)?
beerware beer,beerware beer ?ware(?: licen[cs]e)?
blueoak oak blue oak model licen[cs]e(?: 1 0 0)?
bsd bsd (?:new |revised |simplified |modified |original |free )?bsd (?:style |type )?licen[cs]e[ds]?
bsd bsd bsd [1234] clause(?: licen[cs]e)?|(?:[1234]|two|three|four) clause bsd(?: licen[cs]e)?
bsd freebsd,netbsd,openbsd (?:free|net|open)bsd licen[cs]e
bsl busl,bsl business source licen[cs]e(?: 1 1)?|busl 1 1
bsl source business source licen[cs]e(?: (?:v|version )?1 [01])?
boost boost boost (?:software )?licen[cs]e(?: (?:v|version )?1 0)?
boost bsl bsl 1 0
cc-by cc cc by(?: [1-4] [05])?(?: int| intl| unported| igo)?(?! n[cd]| sa)
cc-by commons creative commons attribution(?: only)?(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?(?! non| no| share)
cc-by-nc cc cc by nc(?: [1-4] [05])?(?! nd| sa)
cc-by-nc commons creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?(?! no| share)
cc-by-nc-nd cc cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd commons creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-sa cc cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa commons creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nd cc cc by nd(?: [1-4] [05])?
cc-by-nd commons creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-sa cc cc by sa(?: [1-4] [05])?
cc-by-sa commons creative commons attribution share ?alike(?: [1-4] [05])?
cc0 cc0 cc0(?: 1 0)?(?: universal)?
cc0 commons creative commons (?:zero|public domain dedication|cc0)(?: 1 0)?
cddl cddl cddl(?: (?:v|version )?1 [01])?
cddl development common development and distribution licen[cs]e(?: (?:v|version )?1 [01])?
cecill cecill cecill(?: [abc12]| 2 [01]| licen[cs]e)?
cpal attribution common public attribution licen[cs]e(?: (?:v|version )?1 0)?
cpl public common public licen[cs]e(?: (?:v|version )?1 0)?
cua office cua office public licen[cs]e
ecl educational educational community licen[cs]e(?: (?:v|version )?[12] 0)?
efl eiffel eiffel forum licen[cs]e(?: [12])?
elastic elastic elastic licen[cs]e(?: (?:v|version )?[12](?: 0)?)?
entessa entessa entessa public licen[cs]e
epl eclipse eclipse (?:public|distribution) licen[cs]e(?: (?:v|version )?[12](?: 0)?)?
epl epl epl (?:v|version )?[12](?: 0)?
eupl eupl eupl(?: (?:v|version )?1 [012])?
eupl union european union public licen[cs]e(?: (?:v|version )?1 [012])?
fair fair fair licen[cs]e
gfdl gfdl gfdl(?: (?:v|version )?1 [123])?
gfdl documentation (?:gnu )?free documentation licen[cs]e(?: (?:v|version )?1 [123])?
gpl gnu gnu (?:general public licen[cs]e|gpl)(?: (?:v|version )?[123](?: 0)?)?(?: only| or later)?
gpl gpl gpl ?(?:v|version |ver )?[123](?: [01])?(?: only| or later)?
gpl gplv1,gplv2,gplv3 gplv[123](?: only| or later)?
gpl gpl gpl licen[cs]ed?|gpl compatible licen[cs]e
hpnd historical historical permission notice and disclaimer
ibm ibm ibm public licen[cs]e(?: 1 0)?
intel intel intel open source licen[cs]e
ipa ipa ipa font licen[cs]e
isc isc isc (?:style )?licen[cs]e
isc consortium internet systems? consortium licen[cs]e
jasper jasper jasper licen[cs]e
lgpl lesser (?:gnu )?lesser general public licen[cs]e(?: (?:v|version )?[23](?: [01])?)?(?: only| or later)?
lgpl library (?:gnu )?library general public licen[cs]e(?: (?:v|version )?2(?: 0)?)?
lgpl lgpl lgpl ?(?:v|version )?[23](?: [01])?(?: only| or later)?
lgpl lgplv2,lgplv3 lgplv[23](?: [01])?(?: only| or later)?
lgpl lgpl (?:gnu )?lgpl(?: licen[cs]ed?)?
lppl latex latex project public licen[cs]e(?: 1 [0-3][abc]?)?
lppl lppl lppl(?: (?:v|version )?1 [0-3][abc]?)?
lucent lucent lucent public licen[cs]e(?: 1 0[12]?)?
mit mit mit (?:style |type |x11 |expat )?licen[cs]e[ds]?
mit mit (?:the )?mit(?: x)? consortium licen[cs]e|mit 0
mit expat,x11 (?:expat|x11) (?:style )?licen[cs]e
mpl mozilla mozilla public licen[cs]e(?: (?:v|version )?[12] [01])?
mpl mpl mpl ?(?:v|version )?[12] [01]
ms-pl microsoft microsoft public licen[cs]e
ms-pl ms ms pl
ms-rl microsoft microsoft reciprocal licen[cs]e
ms-rl ms ms rl
mulan mulan mulan (?:permissive software|psl)(?: licen[cs]e)?(?: (?:v|version )?[12])?
nasa nasa nasa open source agreement(?: 1 3)?
ncsa illinois (?:university of illinois )?ncsa open source licen[cs]e
ncsa ncsa ncsa (?:open source )?licen[cs]e
nokia nokia nokia open source licen[cs]e
odbl database open database licen[cs]e(?: (?:v|version )?1 0)?
odbl odbl odbl(?: 1 0)?
odc-by odc odc by(?: 1 0)?|open data commons attribution licen[cs]e
ofl ofl (?:sil )?ofl(?: (?:v|version )?1 [01])?
ofl font (?:sil )?open font licen[cs]e(?: (?:v|version )?1 [01])?
openldap openldap openldap public licen[cs]e(?: 2 [0-8])?
openssl openssl openssl licen[cs]e
osl software open software licen[cs]e(?: (?:v|version )?[123] [01])?
osl osl osl (?:v|version )?[123] [01]
php php php licen[cs]e(?: (?:v|version )?3(?: 01?)?)?
postgresql postgresql postgres(?:ql)? licen[cs]e
proprietary proprietary proprietary licen[cs]e|commercial licen[cs]e agreement
proprietary eula end user licen[cs]e agreement|eula
public-domain domain public domain dedication
python psf psf licen[cs]e(?: agreement)?
python python python software foundation licen[cs]e|python licen[cs]e(?: 2 0)?
qpl qpl,public (?:q public licen[cs]e|qpl)(?: 1 0)?
rpl reciprocal reciprocal public licen[cs]e(?: 1 [15])?
ruby ruby ruby licen[cs]e
sleepycat sleepycat sleepycat licen[cs]e
sissl sun sun industry standards source licen[cs]e
spl sun sun public licen[cs]e(?: 1 0)?
sspl server server side public licen[cs]e(?: (?:v|version )?1)?
sspl sspl sspl(?: (?:v|version )?1(?: 0)?)?
tcl tcl tcl(?: tk)? licen[cs]e
unicode unicode unicode (?:licen[cs]e agreement|terms of use|licen[cs]e v3)
unlicense unlicense (?:the )?unlicense(?: licen[cs]e)?(?! d)
upl universal universal permissive licen[cs]e(?: (?:v|version )?1 0)?
vim vim vim licen[cs]e
w3c w3c w3c (?:software (?:notice and )?)?licen[cs]e
wtfpl wtfpl wtfpl(?: (?:v|version )?[12])?
wtfpl fuck do what the f(?:uck|\\*ck) you want to public licen[cs]e
xfree86 xfree86 xfree86 licen[cs]e(?: 1 [01])?
zlib zlib zlib(?: libpng)? (?:style )?licen[cs]e
zpl zope zope public licen[cs]e(?: (?:v|version )?[12] [01])?
zpl zpl zpl (?:v|version )?[12] [01]
"""

# Identifiers that are too short to stand alone: they count after an SPDX tag or the words of a grant.
IDENTIFIERS = """
0bsd 0bsd 0bsd
afl afl afl(?: [123] [012])?
agpl agpl,agplv3 (?:gnu )?agpl ?(?:v|version )?(?:[13](?: 0)?)?
apache apache apache(?: (?:v|version )?[12](?: [01])?)?
artistic artistic artistic(?: [12] 0)?(?: perl| cl8)?
beerware beerware beerware
blueoak blueoak blueoak 1 0 0
boost bsl,boost bsl 1 0|boost(?: software)?
bsd bsd bsd(?: [1-4] clause)?(?: clear| patent| views| lbnl)?
bsd bsd (?:new|revised|simplified|modified|original|[234] clause) bsd
bsl busl busl(?: 1 1)?
cc-by cc cc by(?: [1-4] [05])?(?! n| s)
cc0 cc0 cc0(?: 1 0)?
cddl cddl cddl(?: 1 [01])?
cecill cecill cecill(?: [bc12]| 2 1)?
cpl cpl cpl(?: 1 0)?
curl curl curl
ecl ecl ecl(?: [12] 0)?
elastic elastic elastic(?: 2 0)?
epl epl epl(?: [12] 0)?
eupl eupl eupl(?: 1 [012])?
gfdl gfdl gfdl(?: 1 [123])?(?: invariants| no invariants)?
gpl gpl,gplv1,gplv2,gplv3 (?:gnu )?gpl ?(?:v|version )?(?:[123](?: 0)?)?
hpnd hpnd hpnd
isc isc isc
lgpl lgpl,lgplv2,lgplv3 (?:gnu )?lgpl ?(?:v|version )?(?:[23](?: [01])?)?
lppl lppl lppl(?: 1 [0-3][abc]?)?
mit mit mit(?: 0| cmu| modern variant)?
mit expat,x11 expat|x11
mpl mpl mpl(?: [12] [01])?(?: no copyleft exception)?
ms-pl ms ms pl
ms-rl ms ms rl
mulan mulanpsl mulanpsl 2 0
ncsa ncsa (?:uiuc )?ncsa
odbl odbl odbl(?: 1 0)?
ofl ofl (?:sil )?ofl(?: 1 [01])?(?: rfn| no rfn)?
openssl openssl openssl
osl osl osl(?: [123] [01])?
php php php(?: 3 0(?:1)?)?
postgresql postgresql postgresql
python psf,python psf(?: 2 0)?|python(?: 2 0)?
ruby ruby ruby
sspl sspl sspl(?: 1 0)?
tcl tcl tcl
unlicense unlicense unlicense
upl upl upl(?: 1 0)?
vim vim vim
w3c w3c w3c
wtfpl wtfpl wtfpl
zlib zlib zlib(?: acknowledgement| libpng)?
zpl zpl zpl(?: [12] [01])?
"""

#: What must stand before and may stand after an identifier, words of which one must be there, priority and confidence.
CONTEXTS = [
    ("spdx license identifier [(]?(?:{})(?: only| or later)?", "spdx", 92, 1.0),
    (
        "(?:(?:re|sub|dual |multi )?licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{})(?: only| or later)?(?: style)?(?: licen[cs]es?)?",
        "under",
        82,
        0.95,
    ),
    ("(?:licen[cs]es?|licencia|lizenz)[\\t\\x20]{{0,3}}[:=] ?(?:{})(?: only| or later)?", "license,licence,licenses,licencia,lizenz", 60, 0.8),
]
