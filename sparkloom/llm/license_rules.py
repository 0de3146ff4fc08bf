"""Signature rules for licence notices, on words in lower case with one space between.

A line is: label, kind, pattern. Patterns begin with literal text, by which they are gated, and stand
on whole words. Kinds, by falling priority: ``text`` sentences of a licence's own text; ``name`` a
licence's name; ``short`` a short name that stands for little else; ``id`` a short name that only
counts after a lead such as "licensed under the" or an SPDX tag; ``hint`` words that speak of rights
without naming a licence.
"""

RULES = r"""
apache-2.0 name apache (?:software )?licen[cs]e (?:v|version )?2(?: 0)?
apache-1.1 name apache (?:software )?licen[cs]e (?:v|version )?1 1
apache-1.0 name apache (?:software )?licen[cs]e (?:v|version )?1 0
apache name apache (?:software )?licen[cs]e
apache-2.0 short apache 2(?: 0)?
apache-2.0 short asl 2 0
apache-2.0 short al2 0
apache-2.0 text www apache org licenses license 2 0
apache-2.0 text unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis
apache-2.0 text you may not use this file except in compliance with the licen[cs]e
apache-2.0 text grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e each contributor hereby grants
apache-1.1 text this product includes software developed by the apache software foundation
apache-2.0 text licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements
mit name mit licen[cs]e
mit name mit x11 licen[cs]e
mit name x11 licen[cs]e
mit name expat licen[cs]e
mit id mit
mit id expat
mit id x11
mit-0 name mit no attribution(?: licen[cs]e)?
mit-0 short mit 0
mit text permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit text the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit text to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit text opensource org licenses mit
bsd name bsd(?: style| type)? licen[cs]e
bsd-3-clause name bsd 3 clause(?: new or revised)?(?: licen[cs]e)?
bsd-3-clause name 3 clause bsd(?: licen[cs]e)?
bsd-3-clause name three clause bsd(?: licen[cs]e)?
bsd-3-clause name new bsd licen[cs]e
bsd-3-clause name modified bsd licen[cs]e
bsd-3-clause name revised bsd licen[cs]e
bsd-2-clause name bsd 2 clause(?: simplified)?(?: licen[cs]e)?
bsd-2-clause name 2 clause bsd(?: licen[cs]e)?
bsd-2-clause name two clause bsd(?: licen[cs]e)?
bsd-2-clause name simplified bsd licen[cs]e
bsd-2-clause name freebsd licen[cs]e
bsd-4-clause name bsd 4 clause(?: licen[cs]e)?
bsd-4-clause name 4 clause bsd(?: licen[cs]e)?
bsd-4-clause name original bsd licen[cs]e
0bsd name zero clause bsd(?: licen[cs]e)?
0bsd name bsd zero clause(?: licen[cs]e)?
0bsd short 0bsd
bsd id bsd
bsd text redistribution and use in source and binary forms with or without modification are permitted
bsd text redistributions of source code must retain the above copyright notice
bsd text redistributions in binary form must reproduce the above copyright notice
bsd-3-clause text neither the name of(?: [^ ]+){1,12} nor the names of (?:its|any|the) contributors
bsd-4-clause text all advertising materials mentioning features or use of this software must display
isc name isc licen[cs]e
isc name internet systems consortium licen[cs]e
isc id isc
isc text permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd name historical permission notice and disclaimer
hpnd text permission to use copy modify and distribute this software and its documentation for any purpose
ntp name ntp licen[cs]e
gpl-1.0 name gnu general public licen[cs]e (?:v|version )1(?: 0)?
gpl-2.0 name gnu general public licen[cs]e (?:v|version )2(?: 0)?(?: only)?
gpl-2.0-or-later name gnu general public licen[cs]e (?:v|version )2(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0 name gnu general public licen[cs]e (?:v|version )3(?: 0)?(?: only)?
gpl-3.0-or-later name gnu general public licen[cs]e (?:v|version )3(?: 0)?(?: of the licen[cs]e)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0 name general public licen[cs]e (?:v|version )2(?: 0)?
gpl-3.0 name general public licen[cs]e (?:v|version )3(?: 0)?
gpl name gnu general public licen[cs]e
gpl name gnu public licen[cs]e
gpl name gnu gpl
gpl-2.0 short gplv2
gpl-3.0 short gplv3
gpl-2.0-or-later short gplv2 or later
gpl-3.0-or-later short gplv3 or later
gpl-2.0 short gpl (?:v|version )?2(?: 0)?(?: only)?
gpl-3.0 short gpl (?:v|version )?3(?: 0)?(?: only)?
gpl-2.0-or-later short gpl (?:v|version )?2(?: 0)? or later
gpl-3.0-or-later short gpl (?:v|version )?3(?: 0)? or later
gpl short gpl
gpl text this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl text you should have received a copy of the gnu general public licen[cs]e
gpl text everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed
gpl text www gnu org licenses gpl
gpl-classpath name gnu classpath exception
gpl-classpath name classpath exception
gpl text as a special exception the copyright holders of this library give you permission to link
lgpl-2.0 name gnu library general public licen[cs]e
lgpl-2.1 name gnu lesser general public licen[cs]e (?:v|version )2 1(?: only)?
lgpl-2.1-or-later name gnu lesser general public licen[cs]e (?:v|version )2 1 or (?:at your option )?(?:any )?later(?: version)?
lgpl-3.0 name gnu lesser general public licen[cs]e (?:v|version )3(?: 0)?(?: only)?
lgpl-3.0-or-later name gnu lesser general public licen[cs]e (?:v|version )3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
lgpl name gnu lesser general public licen[cs]e
lgpl name lesser general public licen[cs]e
lgpl name gnu lgpl
lgpl-2.1 short lgpl(?: v| version|v)? ?2 1(?: only| or later)?
lgpl-3.0 short lgpl(?: v| version|v)? ?3(?: 0)?(?: only| or later)?
lgpl short lgpl
lgpl text you should have received a copy of the gnu lesser general public licen[cs]e
lgpl text this library is free software you can redistribute it and or modify it
agpl-3.0 name gnu affero general public licen[cs]e (?:v|version )3(?: 0)?(?: only| or (?:any )?later(?: version)?)?
agpl name gnu affero general public licen[cs]e
agpl name affero general public licen[cs]e
agpl-3.0 short agpl(?: v| version|v)? ?3(?: 0)?(?: only| or later)?
agpl short agpl
agpl text remote network interaction use with the gnu general public licen[cs]e
gfdl-1.1 name gnu free documentation licen[cs]e (?:v|version )1 1
gfdl-1.2 name gnu free documentation licen[cs]e (?:v|version )1 2
gfdl-1.3 name gnu free documentation licen[cs]e (?:v|version )1 3
gfdl name gnu free documentation licen[cs]e
gfdl short gfdl
gfdl text with no invariant sections no front cover texts and no back cover texts
gnu-all-permissive text copying and distribution of this file with or without modification are permitted in any medium without royalty
mpl-1.0 name mozilla public licen[cs]e (?:v|version )?1 0
mpl-1.1 name mozilla public licen[cs]e (?:v|version )?1 1
mpl-2.0 name mozilla public licen[cs]e (?:v|version )?2(?: 0)?
mpl name mozilla public licen[cs]e
mpl-2.0 short mpl 2(?: 0)?
mpl-1.1 short mpl 1 1
mpl-2.0 text this source code form is subject to the terms of the mozilla public licen[cs]e
mpl-2.0 text mozilla org mpl 2 0
mpl id mpl
epl-1.0 name eclipse public licen[cs]e (?:v|version )?1(?: 0)?
epl-2.0 name eclipse public licen[cs]e (?:v|version )?2(?: 0)?
epl name eclipse public licen[cs]e
epl-1.0 short epl 1 0
epl-2.0 short epl 2 0
edl-1.0 name eclipse distribution licen[cs]e(?: (?:v|version )?1(?: 0)?)?
cpl-1.0 name common public licen[cs]e(?: (?:v|version )?1(?: 0)?)?
ipl-1.0 name ibm public licen[cs]e(?: (?:v|version )?1(?: 0)?)?
cddl-1.0 name common development and distribution licen[cs]e(?: cddl)?(?: (?:v|version )?1(?: 0)?)?
cddl-1.1 name common development and distribution licen[cs]e(?: cddl)? (?:v|version )?1 1
cddl short cddl(?: 1(?: [01])?)?
cpal-1.0 name common public attribution licen[cs]e(?: (?:v|version )?1(?: 0)?)?
eupl-1.1 name european union public licen[cs]e (?:eupl )?(?:v|version )?1 1
eupl-1.2 name european union public licen[cs]e (?:eupl )?(?:v|version )?1 2
eupl name european union public licen[cs]e
eupl short eupl(?: (?:v|version )?1 [012])?
osl-3.0 name open software licen[cs]e(?: (?:v|version )?3(?: 0)?)?
afl-3.0 name academic free licen[cs]e(?: (?:v|version )?[123](?: [012])?)?
artistic-1.0 name artistic licen[cs]e (?:v|version )?1(?: 0)?
artistic-2.0 name artistic licen[cs]e (?:v|version )?2(?: 0)?
artistic name artistic licen[cs]e
perl text under the same terms as perl itself
bsl-1.0 name boost software licen[cs]e(?: (?:v|version )?1(?: 0)?)?
bsl-1.0 short bsl 1 0
bsl-1.0 text permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
busl-1.1 name business source licen[cs]e(?: (?:v|version )?1 1)?
busl-1.1 short busl 1 1
sspl-1.0 name server side public licen[cs]e(?: (?:v|version )?1(?: 0)?)?
sspl-1.0 short sspl
elastic-2.0 name elastic licen[cs]e(?: (?:v|version )?2(?: 0)?)?
commons-clause name commons clause(?: licen[cs]e condition)?
zlib name zlib licen[cs]e
zlib name zlib libpng licen[cs]e
zlib id zlib
zlib text this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib text altered source versions must be plainly marked as such and must not be misrepresented
libpng name libpng licen[cs]e
libtiff name libtiff licen[cs]e
ijg text this software is based in part on the work of the independent jpeg group
openssl name openssl licen[cs]e
openssl text this product includes software developed by the openssl project
openssl text this product includes cryptographic software written by eric young
psf-2.0 name python software foundation licen[cs]e(?: (?:v|version )?2(?: 0)?)?
psf-2.0 name psf licen[cs]e(?: agreement)?
python-2.0 name python licen[cs]e
php-3.01 name php licen[cs]e(?: (?:v|version )?3 0?1)?
php-3.01 text this product includes php software freely available from
ruby name ruby licen[cs]e
vim name vim licen[cs]e
tcl name tcl(?: tk)? licen[cs]e
w3c name w3c software(?: notice)?(?: and document)?(?: notice)?(?: and)? licen[cs]e
unicode-dfs name unicode licen[cs]e agreement
unicode-dfs name unicode data files and software licen[cs]e
icu name icu licen[cs]e
curl name curl licen[cs]e
postgresql name postgresql licen[cs]e
ncsa name university of illinois ncsa open source licen[cs]e
ncsa name ncsa open source licen[cs]e
ms-pl name microsoft public licen[cs]e
ms-pl short ms pl
ms-rl name microsoft reciprocal licen[cs]e
ms-rl short ms rl
apsl-2.0 name apple public source licen[cs]e(?: (?:v|version )?2(?: 0)?)?
qpl-1.0 name q public licen[cs]e(?: (?:v|version )?1(?: 0)?)?
npl-1.1 name netscape public licen[cs]e(?: (?:v|version )?1 [01])?
spl-1.0 name sun public licen[cs]e(?: (?:v|version )?1(?: 0)?)?
sissl name sun industry standards source licen[cs]e
bcl name oracle binary code licen[cs]e(?: agreement)?
otn name oracle technology network licen[cs]e
intel-acpi name intel open source licen[cs]e
nvidia-eula name nvidia(?: [^ ]+){0,4} end user licen[cs]e agreement
naist text nara institute of science and technology
unlicense name the unlicense
unlicense name unlicense
unlicense text this is free and unencumbered software released into the public domain
unlicense text anyone is free to copy modify publish use compile sell or distribute this software
wtfpl name do what the fuck you want to public licen[cs]e
wtfpl short wtfpl
beerware name beer ?ware licen[cs]e
beerware text if we meet some day and you think this stuff is worth it you can buy me a beer
json text the software shall be used for good not evil
ofl-1.0 name sil open font licen[cs]e (?:v|version )?1 0
ofl-1.1 name sil open font licen[cs]e (?:v|version )?1 1
ofl name sil open font licen[cs]e
ofl name open font licen[cs]e
ofl-1.1 text this font software is licensed under the sil open font licen[cs]e
lppl-1.3 name latex project public licen[cs]e(?: (?:v|version )?1 3[ac]?)?
lppl-1.3 short lppl
ubuntu-font name ubuntu font licen[cs]e
bitstream-vera text bitstream vera is a trademark of bitstream
llama name llama(?: [23](?: [0-9])?)? community licen[cs]e(?: agreement)?
openrail name openrail(?: m)?(?: licen[cs]e)?
openrail name bigscience(?: [^ ]+){0,3} rail licen[cs]e
openrail name creativeml open rail ?m(?: licen[cs]e)?
gemma name gemma terms of use
odbl-1.0 name open data commons open database licen[cs]e
odbl-1.0 name open database licen[cs]e
odbl-1.0 short odbl
odc-by-1.0 name open data commons attribution licen[cs]e
odc-by-1.0 short odc by
pddl-1.0 name open data commons public domain dedication(?: and)? licen[cs]e
pddl-1.0 short pddl
cdla-permissive name community data licen[cs]e agreement permissive
cdla-sharing name community data licen[cs]e agreement sharing
ogl-uk name open government licen[cs]e(?: (?:v|version )?[123](?: 0)?)?
ogl-uk text contains public sector information licensed under the open government licen[cs]e
etalab-2.0 name licence ouverte(?: open licence)?
dl-de name datenlizenz deutschland
cc0-1.0 name creative commons zero(?: (?:v|version )?1 0)?
cc0-1.0 name cc0(?: 1 0)?(?: universal)?
cc0-1.0 name cc zero
cc-by-nc-nd name creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: (?:v|version )?[1-4] [05])?
cc-by-nc-sa name creative commons attribution non ?commercial share ?alike(?: (?:v|version )?[1-4] [05])?
cc-by-nc name creative commons attribution non ?commercial(?: (?:v|version )?[1-4] [05])?
cc-by-nd name creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: (?:v|version )?[1-4] [05])?
cc-by-sa name creative commons attribution share ?alike(?: (?:v|version )?[1-4] [05])?
cc-by name creative commons attribution(?: (?:v|version )?[1-4] [05])?(?: international| unported| generic)?
cc name creative commons(?: licen[cs]es?)?
cc-by-nc-nd name cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa name cc by nc sa(?: [1-4] [05])?
cc-by-nc name cc by nc(?: [1-4] [05])?
cc-by-nd name cc by nd(?: [1-4] [05])?
cc-by-sa name cc by sa(?: [1-4] [05])?
cc-by name cc by(?: [1-4] [05])?
cc-by text creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa text creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nd text creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc text creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nc-sa text creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd text creativecommons org licenses by nc nd(?: [1-4] [05])?
cc0-1.0 text creativecommons org publicdomain zero(?: 1 0)?
public-domain text creativecommons org publicdomain mark(?: 1 0)?
public-domain name public domain dedication
public-domain text (?:is|are) hereby placed in(?:to)? the public domain
public-domain text released (?:in)?to the public domain
public-domain text placed (?:in)?(?:to)? ?the public domain
public-domain text dedicated to the public domain
public-domain hint in the public domain
proprietary text all rights reserved
proprietary text alle rechte vorbehalten
proprietary text tous droits r[eé]serv[eé]s
proprietary text todos los derechos reservados
proprietary text tutti i diritti riservati
proprietary text proprietary and confidential
proprietary text confidential and proprietary
proprietary text unauthorized (?:copying|reproduction|use|distribution)(?: [^ ]+){0,8} (?:is )?(?:strictly )?prohibited
proprietary text no part of this (?:publication|book|document|work|website|site) may be reproduced
proprietary text may not be (?:reproduced|copied|redistributed|published|broadcast|rewritten)(?: [^ ]+){0,8} without(?: the)?(?: [^ ]+){0,3} (?:permission|consent)
proprietary text reproduction in whole or in part(?: [^ ]+){0,4} (?:is )?(?:strictly )?(?:prohibited|forbidden)
proprietary name end user licen[cs]e agreement
proprietary name proprietary licen[cs]e
proprietary name commercial licen[cs]e
proprietary text for internal use only
non-commercial text for (?:non ?commercial|personal|academic|research|educational)(?: and [^ ]+)? (?:use|purposes) only
non-commercial hint non ?commercial use
copyright hint copyright(?: c)? (?:19|20)[0-9]{2}
copyright hint copyrighted material
copyright hint copyright notice
warranty-disclaimer text the software is provided as is without warranty of any kind
warranty-disclaimer text this software is provided by the copyright holders and contributors as is
warranty-disclaimer text without even the implied warranty of merchantability or fitness for a particular purpose
warranty-disclaimer hint in no event shall
permissive hint free to use modify and (?:re)?distribute
permissive hint may be freely (?:used|copied|distributed|reproduced)
unnamed-license hint see(?: the)? licen[cs]e(?: file| txt| md)? for(?: [^ ]+){0,3} (?:details|information)
unnamed-license hint refer to the licen[cs]e
"""
