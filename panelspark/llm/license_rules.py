"""Signature rules of licence texts, notices, tags, addresses and names.

One rule a line: label | kind | words that must all occur | pattern. Patterns are matched against a text's
lower-cased words with one blank between them (signs are gone: "CC BY-NC 4.0" reads "cc by nc 4 0").
Kinds, from the highest priority down: text (a sentence of the licence itself), notice (a grant that names the
licence), tag (a licence tag), url (the licence's address), name (its name).
"""

PERMISSIVE = r"""
mit | text | permission charge deal | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | text | substantial portions | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
mit | notice | mit license | (?:licensed|released|distributed|available|published|provided|issued) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | notice | mit license | (?:code|project|library|package|software|program|module) is mit licensed
mit | notice | mit style | under (?:a|the) mit style licen[cs]e
mit | tag | spdx mit | spdx license identifier mit(?! 0)
mit | tag | license mit | licen[cs]e mit(?= |$)
mit | url | opensource mit | opensource org licen[cs]es? mit(?: license(?: php)?)?
mit | url | mit choosealicense | choosealicense com licenses mit
mit | name | mit license | the mit licen[cs]e(?: mit)?
mit | name | expat license | expat licen[cs]e
mit-0 | text | deal permission | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit-0 | tag | mit | spdx license identifier mit 0
mit-0 | name | mit attribution | mit no attribution(?: licen[cs]e)?
x11 | text | consortium advertising | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | name | x11 license | x11 licen[cs]e
isc | text | purpose hereby provided | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc | notice | isc license | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
isc | tag | spdx isc | spdx license identifier isc
isc | url | opensource isc | opensource org licen[cs]es? isc
isc | name | isc license | isc licen[cs]e
0bsd | tag | spdx 0bsd | spdx license identifier 0bsd
0bsd | name | bsd zero clause | (?:bsd )?zero clause bsd(?: licen[cs]e)?
bsd-2-clause | text | redistribution binary forms permitted | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | text | neither contributors endorse | neither the name of (?:the )?(?:\w+ ){1,8}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | text | advertising acknowledgement features | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | notice | bsd simplified | under (?:the )?(?:terms of )?(?:the )?simplified bsd licen[cs]e
bsd-3-clause | notice | bsd modified | under (?:the )?(?:terms of )?(?:the )?(?:modified|revised|new) bsd licen[cs]e
bsd | notice | bsd license | (?:licensed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?bsd (?:style )?licen[cs]e
bsd | notice | bsd style | use of this source code is governed by a bsd style licen[cs]e(?: that can be found in the license file)?
bsd-2-clause | tag | spdx bsd 2 | spdx license identifier bsd 2 clause
bsd-3-clause | tag | spdx bsd 3 | spdx license identifier bsd 3 clause
bsd-4-clause | tag | spdx bsd 4 | spdx license identifier bsd 4 clause
bsd-2-clause | url | opensource bsd 2 | opensource org licen[cs]es? bsd 2 clause
bsd-3-clause | url | opensource bsd 3 | opensource org licen[cs]es? bsd 3 clause
bsd | url | opensource bsd | opensource org licen[cs]es? bsd license(?: php)?
bsd-2-clause | name | bsd clause | bsd 2 clause(?: licen[cs]e)?|2 clause bsd(?: licen[cs]e)?|freebsd licen[cs]e
bsd-3-clause | name | bsd clause | bsd 3 clause(?: licen[cs]e)?|3 clause bsd(?: licen[cs]e)?
bsd-4-clause | name | bsd clause | bsd 4 clause(?: licen[cs]e)?|4 clause bsd(?: licen[cs]e)?
bsd | name | bsd license | bsd licen[cs]e
apache-2.0 | text | apache terms reproduction | apache license version 2 0 january 2004 (?:http www apache org licenses )?terms and conditions for use reproduction and distribution
apache-2.0 | notice | apache compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | notice | apache version | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?
apache-2.0 | tag | spdx apache | spdx license identifier apache 2 0
apache-2.0 | tag | license apache | licen[cs]e apache (?:license )?2(?: 0)?
apache-2.0 | url | apache licenses | apache org licenses license 2 0(?: txt| html)?
apache-2.0 | url | opensource apache | opensource org licen[cs]es? apache (?:license )?2 0
apache-2.0 | name | apache license | apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?
apache-2.0 | name | apache asl | asl (?:version |v)?2(?: 0)?
apache-2.0 | name | apache | apache 2 0(?: licen[cs]e)?
apache-1.1 | text | apache acknowledgment | this product includes software developed by the apache software foundation
apache-1.1 | notice | apache license | apache (?:software )?licen[cs]e (?:version |v)?1 1
apache-1.1 | url | apache licenses | apache org licenses license 1 1
apache-1.0 | notice | apache license | apache (?:software )?licen[cs]e (?:version |v)?1 0
zlib | text | misrepresented plainly | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | text | altered misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | tag | spdx zlib | spdx license identifier zlib
zlib | name | zlib license | zlib(?: libpng)? licen[cs]e
libpng | name | libpng license | libpng licen[cs]e
bsl-1.0 | text | boost permission | boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge
bsl-1.0 | notice | boost distributed | distributed under the boost software licen[cs]e(?: version 1 0)?
bsl-1.0 | tag | spdx bsl | spdx license identifier bsl 1 0
bsl-1.0 | url | boost txt | boost org license 1 0 txt
bsl-1.0 | name | boost license | boost (?:software )?licen[cs]e(?: version)?(?: 1 0)?
unlicense | text | unencumbered domain | this is free and unencumbered software released into the public domain
unlicense | tag | spdx unlicense | spdx license identifier unlicense
unlicense | url | unlicense org | unlicense org
unlicense | name | unlicense | the unlicen[cs]e
wtfpl | text | fuck public license | do what the fuck you want to public licen[cs]e
wtfpl | tag | spdx wtfpl | spdx license identifier wtfpl
wtfpl | url | wtfpl net | wtfpl net
wtfpl | name | wtfpl | wtfpl(?: version 2| v2)?
postgresql | notice | postgresql license | (?:released|distributed|licensed) under the postgresql licen[cs]e
postgresql | tag | spdx postgresql | spdx license identifier postgresql
postgresql | name | postgresql license | postgresql licen[cs]e
python-2.0 | text | python psf agreement | this license agreement is between the python software foundation psf and the individual or organization
python-2.0 | tag | spdx python | spdx license identifier (?:python|psf) 2 0
python-2.0 | name | python license | python software foundation licen[cs]e(?: version 2)?|psf licen[cs]e
php-3.01 | text | php includes | this product includes php software freely available from
php-3.01 | notice | php license | subject to version 3 01 of the php licen[cs]e
php-3.01 | name | php license | php licen[cs]e(?: version)?(?: 3 01)?
openssl | text | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | name | openssl license | openssl licen[cs]e
curl | tag | spdx curl | spdx license identifier curl
curl | url | curl haxx | curl (?:haxx )?se docs copyright html
ntp | text | ntp suitability | makes no representations about the suitability (?:of )?this software for any purpose it is provided as is without express or implied warranty
ncsa | name | ncsa license | (?:university of illinois )?(?:ncsa )?open source licen[cs]e ncsa|university of illinois ncsa open source licen[cs]e
ncsa | tag | spdx ncsa | spdx license identifier ncsa
artistic-2.0 | notice | artistic terms | under the (?:terms of the )?artistic licen[cs]e (?:version )?2 0
artistic-2.0 | tag | spdx artistic | spdx license identifier artistic 2 0
artistic-2.0 | name | artistic license | artistic licen[cs]e (?:version )?2(?: 0)?
artistic-1.0 | name | artistic license | artistic licen[cs]e(?: (?:version )?1 0)?
artistic-1.0 | notice | perl terms | under the same terms as perl itself
afl-3.0 | notice | academic license | licensed under the academic free license version 3 0
afl-3.0 | tag | spdx afl | spdx license identifier afl 3 0
afl-3.0 | name | academic license | academic free licen[cs]e(?: version| v)?(?: ?3 0)?
ms-pl | name | microsoft license | microsoft public licen[cs]e
ms-pl | tag | spdx ms pl | spdx license identifier ms pl
ms-rl | name | microsoft license | microsoft reciprocal licen[cs]e
ms-rl | tag | spdx ms rl | spdx license identifier ms rl
upl-1.0 | notice | universal permissive | (?:licensed under )?(?:the )?universal permissive licen[cs]e v(?:ersion)? ?1 0
upl-1.0 | tag | spdx upl | spdx license identifier upl 1 0
json | text | evil good | the software shall be used for good not evil
blueoak-1.0.0 | name | blue oak license | blue oak model licen[cs]e(?: 1 0 0)?
blueoak-1.0.0 | tag | spdx blueoak | spdx license identifier blueoak 1 0 0
mulan-psl-2.0 | name | mulan license | mulan (?:permissive software licen[cs]e|psl)(?: v(?:ersion )?2| 2 0)?
mulan-psl-2.0 | tag | spdx mulanpsl | spdx license identifier mulanpsl 2 0
ecl-2.0 | name | educational license | educational community licen[cs]e(?: version)?(?: 2 0)?
ftl | name | freetype license | freetype (?:project )?licen[cs]e
imagemagick | name | imagemagick license | imagemagick licen[cs]e
hpnd | name | hpnd | historical permission notice and disclaimer
vim | name | vim license | vim licen[cs]e
unicode-dfs | text | unicode data files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
beerware | text | beer thb | as long as you retain this notice you can do whatever you want with this stuff
beerware | name | beerware license | beer ?ware licen[cs]e
"""

COPYLEFT = r"""
gpl-3.0 | text | gnu copyleft kinds | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2.0 | text | freedom share gnu | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0-or-later | notice | gnu redistribute either | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-or-later | notice | gnu redistribute either | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0-only | notice | gnu version | under the terms of (?:the )?gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-3.0 | notice | gnu public | licensed under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e (?:version |v)?3(?: 0)?(?! or)
gpl-2.0 | notice | gnu public | licensed under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e (?:version |v)?2(?: 0)?(?! or)
gpl-3.0-or-later | notice | gnu public later | gnu general public licen[cs]e (?:version |v)?3(?: 0)? or (?:any )?later
gpl-2.0-or-later | notice | gnu public later | gnu general public licen[cs]e (?:version |v)?2(?: 0)? or (?:any )?later
gpl-3.0-only | tag | spdx gpl | spdx license identifier gpl 3 0(?: only)?(?! or)
gpl-3.0-or-later | tag | spdx gpl | spdx license identifier gpl 3 0 or later
gpl-2.0-only | tag | spdx gpl | spdx license identifier gpl 2 0(?: only)?(?! or)
gpl-2.0-or-later | tag | spdx gpl | spdx license identifier gpl 2 0 or later
gpl-3.0 | url | gnu gpl | gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-2.0 | url | gnu gpl | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt| en html)?
gpl | url | gnu gpl | gnu org (?:licenses|copyleft) gpl html
gpl-3.0 | url | opensource gpl | opensource org licen[cs]es? gpl 3 0
gpl-2.0 | url | opensource gpl | opensource org licen[cs]es? gpl 2 0
gpl-3.0 | name | gnu public | gnu general public licen[cs]e (?:version |v)?3(?: 0)?
gpl-2.0 | name | gnu public | gnu general public licen[cs]e (?:version |v)?2(?: 0)?
gpl-1.0 | name | gnu public | gnu general public licen[cs]e (?:version |v)?1(?: 0)?
gpl-3.0 | name | gplv3 | gplv3
gpl-2.0 | name | gplv2 | gplv2
gpl-3.0 | name | gpl | gpl (?:version |v)?3(?: 0)?
gpl-2.0 | name | gpl | gpl (?:version |v)?2(?: 0)?
gpl | name | gnu public | gnu (?:general public licen[cs]e|gpl)
lgpl-2.1-or-later | notice | lesser redistribute either | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0-or-later | notice | lesser redistribute either | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.0-or-later | notice | library redistribute either | under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl-3.0 | tag | spdx lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 | tag | spdx lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.0 | tag | spdx lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-3.0 | url | gnu lgpl | gnu org licenses lgpl 3 0(?: html| txt)?
lgpl-2.1 | url | gnu lgpl | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl | url | gnu lgpl | gnu org (?:licenses|copyleft) (?:lgpl|lesser) html
lgpl-3.0 | name | lesser public | gnu lesser general public licen[cs]e (?:version |v)?3(?: 0)?
lgpl-2.1 | name | lesser public | gnu lesser general public licen[cs]e (?:version |v)?2 1
lgpl-3.0 | name | lgplv3 | lgplv3
lgpl-2.1 | name | lgpl | lgpl ?v?(?:ersion )? ?2 1
lgpl | name | lesser public | (?:gnu )?lesser general public licen[cs]e
lgpl | name | library public | gnu library general public licen[cs]e
agpl-3.0-or-later | notice | affero redistribute either | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0 | text | affero network interact | if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-3.0 | tag | spdx agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 | url | gnu agpl | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
agpl-3.0 | name | affero public | (?:gnu )?affero general public licen[cs]e (?:version |v)?3(?: 0)?
agpl-3.0 | name | agplv3 | agplv3
agpl | name | affero public | (?:gnu )?affero general public licen[cs]e
gfdl-1.3 | notice | documentation permission version | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
gfdl-1.2 | notice | documentation permission version | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
gfdl-1.3 | tag | spdx gfdl | spdx license identifier gfdl 1 3(?: only| or later)?
gfdl | url | gnu fdl | gnu org (?:licenses|copyleft) fdl(?: 1 3)?(?: html)?
gfdl | name | documentation license | gnu free documentation licen[cs]e
gcc-exception | text | gcc exception runtime | gcc runtime library exception(?: version 3 1)?
classpath-exception | text | linking independent exception | as a special exception the copyright holders of this library give you permission to link this library with independent modules
mpl-2.0 | text | mozilla source form | this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-2.0 | notice | mozilla public | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
mpl-2.0 | tag | spdx mpl | spdx license identifier mpl 2 0
mpl-2.0 | url | mozilla mpl | mozilla org (?:en us )?mpl 2 0
mpl-2.0 | name | mozilla public | mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
mpl-1.1 | text | mozilla contents | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | url | mozilla mpl | mozilla org mpl mpl 1 1(?: html| txt)?
mpl-1.1 | name | mozilla public | mozilla public licen[cs]e (?:version |v ?)?1 1
mpl | name | mozilla public | mozilla public licen[cs]e
epl-2.0 | notice | eclipse terms | made available under the terms of the eclipse public license (?:version |v ?)?2(?: 0)?
epl-1.0 | notice | eclipse terms | made available under the terms of the eclipse public license (?:version |v ?)?1(?: 0)?
epl-2.0 | tag | spdx epl | spdx license identifier epl 2 0
epl-1.0 | tag | spdx epl | spdx license identifier epl 1 0
epl-2.0 | url | eclipse legal | eclipse org legal epl (?:2 0|v20)(?: html)?
epl-1.0 | url | eclipse legal | eclipse org legal epl v10(?: html)?
epl | name | eclipse public | eclipse public licen[cs]e
cddl-1.0 | text | cddl distribution contents | the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0 | tag | spdx cddl | spdx license identifier cddl 1 0
cddl-1.1 | tag | spdx cddl | spdx license identifier cddl 1 1
cddl | name | development distribution license | common development and distribution licen[cs]e
cpl-1.0 | name | common public | common public licen[cs]e(?: version| v)?(?: ?1 0)?
eupl-1.2 | notice | eupl european | licensed under the eupl (?:version |v ?)?1 2
eupl-1.2 | tag | spdx eupl | spdx license identifier eupl 1 2
eupl | name | european public | european union public licen[cs]e
osl-3.0 | notice | open license | licensed under the open software license version 3 0
osl-3.0 | name | open license | open software licen[cs]e (?:version |v ?)?3 0
cecill-2.1 | name | cecill | cecill(?: licen[cs]e)?(?: (?:version |v)?2 1)?
qpl-1.0 | name | public license | q public licen[cs]e(?: version 1 0)?
sleepycat | name | sleepycat license | sleepycat licen[cs]e
ofl-1.1 | text | sil font | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | tag | spdx ofl | spdx license identifier ofl 1 1
ofl-1.1 | url | sil ofl | scripts sil org ofl
ofl-1.1 | name | sil font | sil open font licen[cs]e(?: version)?(?: 1 1)?
"""

CONTENT_AND_LIMITED = r"""
cc0-1.0 | text | cc0 waive | to the extent possible under law (?:\w+ ){1,12}has waived all copyright and related or neighboring rights
cc0-1.0 | tag | spdx cc0 | spdx license identifier cc0 1 0
cc0-1.0 | url | creativecommons zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | name | cc0 | cc0(?: 1 0)?(?: universal)?
cc-pdm | url | creativecommons mark | creativecommons org publicdomain mark 1 0
cc-by-4.0 | notice | creative attribution international | licensed under (?:a |the )?creative commons attribution 4 0 international(?: licen[cs]e)?
cc-by-sa-4.0 | notice | creative sharealike international | licensed under (?:a |the )?creative commons attribution share ?alike 4 0 international(?: licen[cs]e)?
cc-by-nc-4.0 | notice | creative noncommercial international | licensed under (?:a |the )?creative commons attribution non ?commercial 4 0 international(?: licen[cs]e)?
cc-by-nc-sa-4.0 | notice | creative noncommercial sharealike | licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike 4 0 international(?: licen[cs]e)?
cc-by-nc-nd-4.0 | notice | creative noncommercial noderivatives | licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0 international(?: licen[cs]e)?
cc-by-nd-4.0 | notice | creative noderivatives international | licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s 4 0 international(?: licen[cs]e)?
cc-by-nc-nd-4.0 | notice | cc by nc nd | (?:licensed|released|available|published|shared) under (?:a |the )?cc by nc nd 4 0
cc-by-nc-sa-4.0 | notice | cc by nc sa | (?:licensed|released|available|published|shared) under (?:a |the )?cc by nc sa 4 0
cc-by-nc-4.0 | notice | cc by nc | (?:licensed|released|available|published|shared) under (?:a |the )?cc by nc 4 0
cc-by-nd-4.0 | notice | cc by nd | (?:licensed|released|available|published|shared) under (?:a |the )?cc by nd 4 0
cc-by-sa-4.0 | notice | cc by sa | (?:licensed|released|available|published|shared) under (?:a |the )?cc by sa 4 0
cc-by-4.0 | notice | cc by | (?:licensed|released|available|published|shared) under (?:a |the )?cc by 4 0
cc-by-nc-nd-3.0 | notice | cc by nc nd | (?:licensed|released|available|published|shared) under (?:a |the )?cc by nc nd 3 0
cc-by-nc-sa-3.0 | notice | cc by nc sa | (?:licensed|released|available|published|shared) under (?:a |the )?cc by nc sa 3 0
cc-by-nc-3.0 | notice | cc by nc | (?:licensed|released|available|published|shared) under (?:a |the )?cc by nc 3 0
cc-by-sa-3.0 | notice | cc by sa | (?:licensed|released|available|published|shared) under (?:a |the )?cc by sa 3 0
cc-by-3.0 | notice | cc by | (?:licensed|released|available|published|shared) under (?:a |the )?cc by 3 0
cc-by-nc-nd-4.0 | url | creativecommons nc nd | creativecommons org licenses by nc nd 4 0
cc-by-nc-sa-4.0 | url | creativecommons nc sa | creativecommons org licenses by nc sa 4 0
cc-by-nc-4.0 | url | creativecommons nc | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | url | creativecommons nd | creativecommons org licenses by nd 4 0
cc-by-sa-4.0 | url | creativecommons sa | creativecommons org licenses by sa 4 0
cc-by-4.0 | url | creativecommons licenses | creativecommons org licenses by 4 0
cc-by-nc-nd-3.0 | url | creativecommons nc nd | creativecommons org licenses by nc nd 3 0
cc-by-nc-sa-3.0 | url | creativecommons nc sa | creativecommons org licenses by nc sa 3 0
cc-by-nc-3.0 | url | creativecommons nc | creativecommons org licenses by nc 3 0
cc-by-sa-3.0 | url | creativecommons sa | creativecommons org licenses by sa 3 0
cc-by-3.0 | url | creativecommons licenses | creativecommons org licenses by 3 0
cc-by-sa-2.0 | url | creativecommons sa | creativecommons org licenses by sa 2 0
cc-by-2.0 | url | creativecommons licenses | creativecommons org licenses by 2 0
cc-by-nc-nd-4.0 | name | cc nc nd | cc by nc nd(?: 4 0)?
cc-by-nc-sa-4.0 | name | cc nc sa | cc by nc sa(?: 4 0)?
cc-by-nc-4.0 | name | cc by nc | cc by nc 4 0
cc-by-sa-4.0 | name | cc by sa | cc by sa 4 0
cc-by-nd-4.0 | name | cc by nd | cc by nd 4 0
cc-by-4.0 | name | cc by | cc by 4 0
cc-by-sa-3.0 | name | cc by sa | cc by sa 3 0
cc-by-3.0 | name | cc by | cc by 3 0
cc-by-nc | name | cc by nc | cc by nc
cc-by-sa | name | cc by sa | cc by sa
cc-by-nd | name | cc by nd | cc by nd
cc-by | name | creative attribution | creative commons attribution(?: licen[cs]e)?
cc-by-sa | name | creative attribution | creative commons attribution share ?alike(?: licen[cs]e)?
cc-by-nc | name | creative attribution | creative commons attribution non ?commercial(?: licen[cs]e)?
cc | name | creative commons | (?:licensed|available|released) under (?:a |the )?creative commons licen[cs]e
odbl-1.0 | notice | odbl open database | (?:made available|licensed) under the open database licen[cs]e(?: odbl)?(?: v?1 0)?
odbl-1.0 | url | opendatacommons odbl | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | url | opendatacommons by | opendatacommons org licenses by(?: 1 0)?
pddl-1.0 | url | opendatacommons pddl | opendatacommons org licenses pddl(?: 1 0)?
odbl-1.0 | name | open database license | open database licen[cs]e
cdla-permissive-2.0 | name | community data agreement | community data license agreement permissive(?: version)? ?2 0
cdla-sharing-1.0 | name | community data agreement | community data license agreement sharing(?: version)? ?1 0
ogl-uk-3.0 | notice | open government licence | (?:licensed )?under the open government licence v?3 0
public-domain | notice | public domain | (?:is|are|has been|been) (?:hereby )?(?:placed|released|dedicated|put) (?:in|into|to) the public domain
public-domain | notice | public domain | this work is in the public domain
sspl-1.0 | text | service source program | if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
sspl-1.0 | tag | spdx sspl | spdx license identifier sspl 1 0
sspl-1.0 | name | server side public | server side public licen[cs]e(?: version)?(?: 1)?
busl-1.1 | text | business source change | the licensor may make an additional use grant above permitting limited production use
busl-1.1 | tag | spdx busl | spdx license identifier busl 1 1
busl-1.1 | name | business source license | business source licen[cs]e(?: version)?(?: 1 1)?
elastic-2.0 | text | hosted managed service | you may not provide the software to third parties as a hosted or managed service
elastic-2.0 | tag | spdx elastic | spdx license identifier elastic 2 0
elastic-2.0 | name | elastic license | elastic licen[cs]e (?:version |v)?2(?: 0)?
commons-clause | text | commons clause sell | the license does not grant to you the right to sell the software
commons-clause | name | commons clause | commons clause(?: licen[cs]e condition)?
polyform-noncommercial | name | polyform license | polyform noncommercial licen[cs]e(?: 1 0 0)?
polyform-shield | name | polyform license | polyform shield licen[cs]e(?: 1 0 0)?
openrail | name | openrail | (?:creativeml )?open ?rail(?: m)?(?: licen[cs]e)?
rail | text | use based restrictions | use based restrictions as referenced in paragraph 5
llama-community | name | llama community license | llama (?:2|3|3 1) community licen[cs]e(?: agreement)?
prosperity | name | prosperity license | prosperity public licen[cs]e
parity | name | parity license | parity public licen[cs]e
hippocratic | name | hippocratic license | hippocratic licen[cs]e
fair-source | name | fair source license | fair source licen[cs]e
proprietary | text | confidential proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | text | unauthorized copying prohibited | unauthorized (?:copying|reproduction|distribution)(?: \w+){0,8} (?:is )?strictly prohibited
all-rights-reserved | notice | rights reserved | all rights reserved
shareware | name | shareware | shareware (?:version|licen[cs]e)
freeware | name | freeware | freeware (?:version|licen[cs]e)
commercial | notice | commercial license | (?:a )?commercial licen[cs]e (?:is |agreement )?(?:required|available)
non-commercial | notice | commercial purposes | (?:for )?non ?commercial (?:use|purposes) only
research-only | notice | research purposes | for (?:academic )?research (?:use|purposes) only
"""

#: Priority and confidence by kind.
KINDS = {"text": (5, 1.0), "notice": (4, 0.95), "tag": (3, 0.95), "url": (2, 0.9), "name": (1, 0.75)}


def rules() -> list[tuple[str, str, tuple[str, ...], str]]:
    """(label, kind, words, pattern) of all rules, in the order in which they are written."""
    out = []
    for line in (PERMISSIVE + COPYLEFT + CONTENT_AND_LIMITED).splitlines():
        if line:
            label, kind, words, pattern = line.split(" | ", 3)
            out.append((label, kind, tuple(words.split()), pattern))
    return out
