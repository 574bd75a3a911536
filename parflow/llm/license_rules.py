"""The ordered signature rules of the license scan, written by hand.

A line is: label, priority, weight, gate, pattern. Patterns are over lower-case words joined by single spaces, without
punctuation; the gate is a word that every match holds. Priorities: 4 notices and full texts, 3 identifiers and names with a
version, 2 names, 1 hints. Of detections that contain each other the higher priority stays, of equal ones the longer, then the
earlier rule.
"""

_RULES = r"""
apache-2.0|4|1.0|apache|licensed under the apache license version 2 0(?: the license)?
apache-2.0|4|1.0|apache|licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0|4|1.0|apache|you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0|3|0.95|apache|apache (?:software )?license(?: version)? v?2(?: 0)?
apache-2.0|3|0.95|apache|apache 2(?: 0)?(?: licensed?)?
apache-2.0|3|0.95|apache|spdx license identifier apache 2 0
apache-2.0|3|0.9|asl|asl 2 0
apache-1.1|3|0.95|apache|apache (?:software )?license(?: version)? 1 1
apache-1.0|3|0.95|apache|apache (?:software )?license(?: version)? 1 0
apache|2|0.8|apache|apache (?:software )?licen[cs]ed?
mit|4|1.0|permission|permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?
mit|4|1.0|mit|(?:released|licensed|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit licen[cs]e
mit|3|0.95|mit|spdx license identifier mit
mit|3|0.95|mit|the mit licen[cs]e(?: mit)?
mit|3|0.9|mit|mit licen[cs]ed?
mit|3|0.9|expat|expat licen[cs]e
mit-0|3|0.95|mit|mit no attribution(?: license)?
mit-0|3|0.95|mit|spdx license identifier mit 0
x11|3|0.9|x11|x11 licen[cs]e
x11|3|0.9|consortium|the x consortium shall not be used in advertising
bsd-4-clause|4|1.0|advertising|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause|4|1.0|endorse|neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd|4|0.95|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd|4|0.9|redistributions|redistributions of source code must retain the above copyright notice
bsd|4|0.9|redistributions|redistributions in binary form must reproduce the above copyright notice
bsd-2-clause|3|0.95|bsd|(?:simplified|freebsd) bsd licen[cs]e
bsd-2-clause|3|0.95|bsd|bsd 2 clause(?: license)?
bsd-2-clause|3|0.95|bsd|2 clause bsd(?: license)?
bsd-2-clause|3|0.95|bsd|two clause bsd(?: license)?
bsd-2-clause|3|0.95|freebsd|freebsd licen[cs]e
bsd-3-clause|3|0.95|bsd|(?:new|modified|revised) bsd licen[cs]e
bsd-3-clause|3|0.95|bsd|bsd 3 clause(?: license)?
bsd-3-clause|3|0.95|bsd|3 clause bsd(?: license)?
bsd-3-clause|3|0.95|bsd|three clause bsd(?: license)?
bsd-4-clause|3|0.95|bsd|bsd 4 clause(?: license)?
bsd-4-clause|3|0.95|bsd|original bsd licen[cs]e
0bsd|3|0.95|0bsd|(?:spdx license identifier )?0bsd
0bsd|3|0.95|bsd|zero clause bsd(?: license)?
bsd|2|0.8|bsd|bsd (?:style )?licen[cs]ed?
gpl-2.0|4|1.0|gnu|under the terms of the gnu general public license version 2(?: only)?
gpl-2.0+|4|1.0|gnu|gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0+|4|1.0|gnu|gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl|4|0.95|gnu|redistribute it and or modify it under the terms of the gnu general public license
gpl|4|0.9|gnu|you should have received a copy of the gnu general public license
gpl-2.0|3|0.95|general|(?:gnu )?general public license(?: gpl)?(?: version| v)? ?v?2(?: 0)?
gpl-3.0|3|0.95|general|(?:gnu )?general public license(?: gpl)?(?: version| v)? ?v?3(?: 0)?
gpl-1.0|3|0.95|general|(?:gnu )?general public license(?: gpl)?(?: version| v)? ?v?1(?: 0)?
gpl-2.0|3|0.95|gpl|gpl v?2(?: 0)?(?: only)?
gpl-2.0|3|0.95|gpl2|gpl2(?: 0)?(?: only)?
gpl-2.0|3|0.95|gplv2|gplv2(?: 0)?(?: only)?
gpl-3.0|3|0.95|gpl|gpl v?3(?: 0)?(?: only)?
gpl-3.0|3|0.95|gpl3|gpl3(?: 0)?(?: only)?
gpl-3.0|3|0.95|gplv3|gplv3(?: 0)?(?: only)?
gpl-2.0|3|0.95|gplv2|(?:gnu )?gplv2
gpl-3.0|3|0.95|gplv3|(?:gnu )?gplv3
gpl-2.0+|3|0.95|gpl|gpl 2 0 or later
gpl-3.0+|3|0.95|gpl|gpl 3 0 or later
gpl|2|0.85|general|gnu general public licen[cs]e
gpl|2|0.8|gpl|(?:gnu )?gpl(?: licen[cs]ed?)?
gpl-exception|3|0.9|classpath|classpath exception
gpl-exception|3|0.9|gcc|gcc runtime library exception
lgpl-2.1+|4|1.0|lesser|gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3.0+|4|1.0|lesser|gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1|3|0.95|lesser|(?:gnu )?lesser general public license(?: lgpl)?(?: version| v)? ?v?2 1
lgpl-3.0|3|0.95|lesser|(?:gnu )?lesser general public license(?: lgpl)?(?: version| v)? ?v?3(?: 0)?
lgpl-2.0|3|0.95|library|(?:gnu )?library general public license(?: lgpl)?(?: version)? ?2(?: 0)?
lgpl-2.1|3|0.95|lgpl|lgpl v?2 1
lgpl-2.1|3|0.95|lgpl2|lgpl2 1
lgpl-2.1|3|0.95|lgplv2|lgplv2 1
lgpl-3.0|3|0.95|lgpl|lgpl v?3(?: 0)?
lgpl-3.0|3|0.95|lgpl3|lgpl3(?: 0)?
lgpl-3.0|3|0.95|lgplv3|lgplv3(?: 0)?
lgpl-2.1|3|0.95|lgplv2|lgplv2 1
lgpl-3.0|3|0.95|lgplv3|lgplv3
lgpl|2|0.85|lesser|(?:gnu )?lesser general public licen[cs]e
lgpl|2|0.85|library|(?:gnu )?library general public licen[cs]e
lgpl|2|0.8|lgpl|(?:gnu )?lgpl
agpl-3.0|4|1.0|affero|gnu affero general public license as published by the free software foundation either version 3
agpl-3.0|3|0.95|affero|(?:gnu )?affero general public license(?: agpl)?(?: version| v)? ?v?3(?: 0)?
agpl-1.0|3|0.95|affero|affero general public license(?: version)? 1(?: 0)?
agpl-3.0|3|0.95|agpl|agpl v?3(?: 0)?
agpl-3.0|3|0.95|agpl3|agpl3(?: 0)?
agpl-3.0|3|0.95|agplv3|agplv3(?: 0)?
agpl-3.0|3|0.95|agplv3|agplv3
agpl|2|0.85|affero|(?:gnu )?affero general public licen[cs]e
agpl|2|0.8|agpl|(?:gnu )?agpl
gfdl-1.3|3|0.95|documentation|gnu free documentation license(?: version)? 1 3
gfdl-1.2|3|0.95|documentation|gnu free documentation license(?: version)? 1 2
gfdl-1.1|3|0.95|documentation|gnu free documentation license(?: version)? 1 1
gfdl|2|0.85|documentation|gnu free documentation licen[cs]e
gfdl|2|0.8|gfdl|(?:gnu )?gfdl
mpl-2.0|4|1.0|mozilla|this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0|3|0.95|mozilla|mozilla public license(?: version| v)? ?v?2(?: 0)?
mpl-1.1|3|0.95|mozilla|mozilla public license(?: version| v)? ?v?1 1
mpl-1.0|3|0.95|mozilla|mozilla public license(?: version| v)? ?v?1 0
mpl-2.0|3|0.95|mpl|mpl v?2(?: 0)?
mpl-2.0|3|0.95|mpl2|mpl2(?: 0)?
mpl-2.0|3|0.95|mplv2|mplv2(?: 0)?
mpl-1.1|3|0.95|mpl|mpl v?1 1
mpl-1.1|3|0.95|mpl1|mpl1 1
mpl-1.1|3|0.95|mplv1|mplv1 1
mpl|2|0.85|mozilla|mozilla public licen[cs]e
npl-1.1|3|0.9|netscape|netscape public license(?: version)? 1 1
npl|2|0.8|netscape|netscape public licen[cs]e
epl-2.0|3|0.95|eclipse|eclipse public license(?: version| v)? ?v?2(?: 0)?
epl-1.0|3|0.95|eclipse|eclipse public license(?: version| v)? ?v?1(?: 0)?
epl|2|0.85|eclipse|eclipse public licen[cs]e
edl-1.0|3|0.9|eclipse|eclipse distribution license(?: version| v)? ?1(?: 0)?
epl-2.0|3|0.95|epl|epl v?2(?: 0)?
epl-2.0|3|0.95|epl2|epl2(?: 0)?
epl-2.0|3|0.95|eplv2|eplv2(?: 0)?
epl-1.0|3|0.95|epl|epl v?1(?: 0)?
epl-1.0|3|0.95|epl1|epl1(?: 0)?
epl-1.0|3|0.95|eplv1|eplv1(?: 0)?
cpl-1.0|3|0.9|common|common public license(?: version)? ?1(?: 0)?
cddl-1.0|3|0.95|cddl|cddl v?1(?: 0)?
cddl-1.0|3|0.95|cddl1|cddl1(?: 0)?
cddl-1.0|3|0.95|cddlv1|cddlv1(?: 0)?
cddl-1.1|3|0.95|cddl|cddl v?1 1
cddl-1.1|3|0.95|cddl1|cddl1 1
cddl-1.1|3|0.95|cddlv1|cddlv1 1
cddl|2|0.85|cddl|cddl
cddl|2|0.85|distribution|common development and distribution licen[cs]e
cpal-1.0|3|0.9|attribution|common public attribution licen[cs]e
ibmpl-1.0|3|0.9|ibm|ibm public licen[cs]e
osl-3.0|3|0.95|open|open software license(?: version| v)? ?3 0
osl|2|0.8|open|open software licen[cs]e
afl-3.0|3|0.95|academic|academic free license(?: version| v)? ?3 0
afl|2|0.8|academic|academic free licen[cs]e
ecl-2.0|3|0.9|educational|educational community license(?: version)? ?2 0
ecl|2|0.8|educational|educational community licen[cs]e
eupl-1.2|3|0.95|eupl|eupl v?1 2
eupl-1.2|3|0.95|eupl1|eupl1 2
eupl-1.2|3|0.95|euplv1|euplv1 2
eupl-1.1|3|0.95|eupl|eupl v?1 1
eupl-1.1|3|0.95|eupl1|eupl1 1
eupl-1.1|3|0.95|euplv1|euplv1 1
eupl|2|0.85|eupl|eupl
eupl|2|0.85|european|european union public licen[cs]e
cecill|3|0.9|cecill|cecill(?: [abc])?(?: licen[cs]e)?
isc|4|1.0|permission|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|3|0.9|isc|isc licen[cs]ed?
ntp|3|0.9|ntp|ntp licen[cs]e
hpnd|3|0.9|historical|historical permission notice and disclaimer
zlib|4|1.0|misrepresented|the origin of this software must not be misrepresented
zlib|4|0.95|altered|altered source versions must be plainly marked as such
zlib|3|0.9|zlib|zlib(?: libpng)? licen[cs]e
libpng|3|0.9|libpng|libpng licen[cs]e
bsl-1.0|3|0.95|boost|boost software license(?: version)? 1 0
bsl-1.0|2|0.85|boost|boost (?:software )?licen[cs]e
busl-1.1|3|0.95|business|business source license(?: 1 1)?
sspl-1.0|3|0.95|server|server side public license(?: v(?:ersion)? ?1)?
elastic-2.0|3|0.95|elastic|elastic license(?: 2 0| v2)?
commons-clause|3|0.95|clause|commons clause(?: license condition)?
unlicense|4|1.0|unencumbered|this is free and unencumbered software released into the public domain
unlicense|3|0.95|unlicense|(?:the )?unlicense
wtfpl|3|0.95|wtfpl|wtfpl
wtfpl|4|1.0|public|do what the fuck you want to public license
wtfpl|4|1.0|public|do what the f you want to public license
beerware|3|0.95|beerware|beerware
beerware|3|0.95|beer|the beer ware license
postgresql|3|0.95|postgresql|postgresql licen[cs]e
openssl|3|0.95|openssl|openssl licen[cs]e
openssl|4|0.95|openssl|this product includes software developed by the openssl project
ssleay|4|0.95|cryptographic|this product includes cryptographic software written by eric young
python-2.0|3|0.95|python|python software foundation license(?: version)? ?2?
psf|2|0.85|psf|psf licen[cs]e
php-3.01|3|0.95|php|php license(?: version)? 3 0 ?1
php|2|0.85|php|php licen[cs]e
ruby|3|0.9|ruby|ruby licen[cs]e
artistic-2.0|3|0.95|artistic|artistic license(?: version)? 2 0
artistic-1.0|3|0.95|artistic|artistic license(?: version)? 1 0
artistic|2|0.85|artistic|artistic licen[cs]e
perl|3|0.9|perl|same terms as perl itself
vim|3|0.9|vim|vim licen[cs]e
tcl|3|0.9|tcl|tcl tk licen[cs]e
icu|3|0.9|icu|icu licen[cs]e
unicode|3|0.9|unicode|unicode (?:inc )?license agreement
w3c|3|0.9|w3c|w3c software (?:notice and |and document )?licen[cs]e
ncsa|3|0.9|ncsa|(?:university of illinois )?ncsa open source licen[cs]e
ncsa|3|0.9|illinois|university of illinois open source licen[cs]e
msl|3|0.9|microsoft|microsoft public licen[cs]e
ms-pl|3|0.9|ms|ms pl
ms-rl|3|0.9|microsoft|microsoft reciprocal licen[cs]e
apsl-2.0|3|0.9|apple|apple public source license(?: version)? ?2?(?: 0)?
intel|3|0.9|intel|intel open source licen[cs]e
qpl-1.0|3|0.9|q|q public license(?: version)? ?1?(?: 0)?
sleepycat|3|0.9|sleepycat|sleepycat licen[cs]e
watcom|3|0.9|watcom|sybase open watcom public licen[cs]e
zpl-2.1|3|0.9|zope|zope public license(?: version)? ?2 1
zpl|2|0.8|zope|zope public licen[cs]e
curl|3|0.9|curl|curl licen[cs]e
ftl|3|0.9|freetype|freetype (?:project )?licen[cs]e
ijg|3|0.9|jpeg|this software is based in part on the work of the independent jpeg group
blueoak-1.0.0|3|0.95|oak|blue oak model license(?: 1 0 0)?
upl-1.0|3|0.95|universal|universal permissive license(?: version| v)? ?1?(?: 0)?
mulan-2.0|3|0.95|mulan|mulan (?:permissive|psl)(?: software)?(?: license)?(?: version| v)? ?2?
openrail|3|0.95|openrail|(?:creativeml )?openrail(?: m)?
openrail|3|0.95|rail|(?:creativeml )?open rail(?: m)?
openrail|3|0.95|bigscience|bigscience (?:bloom )?(?:open)?rail(?: m)?(?: 1 0)?
llama-2|3|0.95|llama|llama 2 community license(?: agreement)?
llama-3|3|0.95|llama|(?:meta )?llama 3(?: \d)? community license(?: agreement)?
gemma|3|0.95|gemma|gemma terms of use
ofl-1.1|3|0.95|sil|sil open font license(?: version)? ?1?(?: 1)?
ofl-1.1|3|0.95|ofl|ofl v?1 1
ofl-1.1|3|0.95|ofl1|ofl1 1
ofl-1.1|3|0.95|oflv1|oflv1 1
odbl-1.0|3|0.95|database|open (?:data commons )?open database license(?: odbl)?(?: v ?1 0)?
odbl-1.0|3|0.95|database|open database licen[cs]e
odbl-1.0|3|0.95|odbl|odbl(?: v?1 0)?
odc-by-1.0|3|0.95|commons|open data commons attribution license(?: v?1 0)?
odc-by-1.0|3|0.95|odc|odc by(?: v?1 0)?
pddl-1.0|3|0.95|pddl|pddl(?: v?1 0)?
pddl-1.0|3|0.95|commons|open data commons public domain dedication
cdla-permissive-2.0|3|0.95|data|community data license agreement permissive(?: version)? 2 0
cdla-sharing-1.0|3|0.95|data|community data license agreement sharing(?: version)? 1 0
ogl-3.0|3|0.95|government|open government licen[cs]e(?: v3 0| version 3(?: 0)?)
ogl|2|0.85|government|open government licen[cs]e
etalab-2.0|3|0.9|etalab|(?:licence ouverte )?etalab(?: 2 0)?
dl-de-by-2.0|3|0.9|datenlizenz|datenlizenz deutschland namensnennung(?: 2 0)?
dl-de-zero-2.0|3|0.9|datenlizenz|datenlizenz deutschland zero(?: 2 0)?
cc0-1.0|4|1.0|cc0|cc0 1 0 universal(?: public domain dedication)?
cc0-1.0|3|0.95|cc0|(?:creative commons )?cc0(?: 1 0)?(?: license)?
cc0-1.0|3|0.95|zero|creative commons zero(?: v?1 0)?(?: universal)?
cc0-1.0|3|0.95|publicdomain|creativecommons org publicdomain zero 1 0
pdm-1.0|3|0.9|publicdomain|creativecommons org publicdomain mark 1 0
cc-by-4.0|4|0.98|creative|licensed under (?:a |the )?creative commons attribution 4 0(?: international)?(?: license)?
cc-by-sa-4.0|4|0.98|creative|licensed under (?:a |the )?creative commons attribution share ?alike 4 0(?: international)?(?: license)?
cc-by-4.0|3|0.95|cc|cc by 4 0
cc-by-3.0|3|0.95|cc|cc by 3 0
cc-by-2.5|3|0.95|cc|cc by 2 5
cc-by-2.0|3|0.95|cc|cc by 2 0
cc-by-1.0|3|0.95|cc|cc by 1 0
cc-by-sa-4.0|3|0.95|cc|cc by sa 4 0
cc-by-sa-3.0|3|0.95|cc|cc by sa 3 0
cc-by-sa-2.5|3|0.95|cc|cc by sa 2 5
cc-by-sa-2.0|3|0.95|cc|cc by sa 2 0
cc-by-nc-4.0|3|0.95|cc|cc by nc 4 0
cc-by-nc-3.0|3|0.95|cc|cc by nc 3 0
cc-by-nc-2.0|3|0.95|cc|cc by nc 2 [05]
cc-by-nd-4.0|3|0.95|cc|cc by nd 4 0
cc-by-nd-3.0|3|0.95|cc|cc by nd 3 0
cc-by-nc-sa-4.0|3|0.95|cc|cc by nc sa 4 0
cc-by-nc-sa-3.0|3|0.95|cc|cc by nc sa 3 0
cc-by-nc-sa-2.0|3|0.95|cc|cc by nc sa 2 [05]
cc-by-nc-nd-4.0|3|0.95|cc|cc by nc nd 4 0
cc-by-nc-nd-3.0|3|0.95|cc|cc by nc nd 3 0
cc-by-sa|2|0.9|cc|cc by sa
cc-by-nc|2|0.9|cc|cc by nc
cc-by-nd|2|0.9|cc|cc by nd
cc-by-nc-sa|2|0.92|cc|cc by nc sa
cc-by-nc-nd|2|0.92|cc|cc by nc nd
cc-by-4.0|3|0.95|creativecommons|creativecommons org licenses by 4 0
cc-by-3.0|3|0.95|creativecommons|creativecommons org licenses by 3 0
cc-by-sa-4.0|3|0.95|creativecommons|creativecommons org licenses by sa 4 0
cc-by-sa-3.0|3|0.95|creativecommons|creativecommons org licenses by sa 3 0
cc-by-nc-4.0|3|0.95|creativecommons|creativecommons org licenses by nc 4 0
cc-by-nd-4.0|3|0.95|creativecommons|creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0|3|0.95|creativecommons|creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0|3|0.95|creativecommons|creativecommons org licenses by nc nd 4 0
cc-by-4.0|3|0.95|creative|creative commons attribution(?: license)? 4 0(?: international)?
cc-by-3.0|3|0.95|creative|creative commons attribution(?: license)? 3 0(?: unported)?
cc-by-sa-4.0|3|0.95|creative|creative commons attribution share ?alike(?: license)? 4 0(?: international)?
cc-by-sa-3.0|3|0.95|creative|creative commons attribution share ?alike(?: license)? 3 0(?: unported)?
cc-by-nc-4.0|3|0.95|creative|creative commons attribution non ?commercial(?: license)? 4 0(?: international)?
cc-by-nc-sa-4.0|3|0.95|creative|creative commons attribution non ?commercial share ?alike(?: license)? 4 0(?: international)?
cc-by-nc-nd-4.0|3|0.95|creative|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: license)? 4 0(?: international)?
cc-by-nd-4.0|3|0.95|creative|creative commons attribution no ?deriv(?:ative)?s(?: license)? 4 0(?: international)?
cc-by-sa|2|0.88|creative|creative commons attribution share ?alike
cc-by-nc|2|0.88|creative|creative commons attribution non ?commercial
cc-by-nc-sa|2|0.9|creative|creative commons attribution non ?commercial share ?alike
cc-by-nc-nd|2|0.9|creative|creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nd|2|0.88|creative|creative commons attribution no ?deriv(?:ative)?s
cc-by|2|0.85|creative|creative commons attribution
cc|1|0.6|creative|creative commons(?: licen[cs]e)?
public-domain|3|0.9|public|(?:released|dedicated|placed) (?:in|to|into) the public domain
public-domain|2|0.7|public|this (?:work|file|code|software|text) is in the public domain
public-domain|1|0.5|domain|public domain
proprietary|4|0.95|confidential|proprietary and confidential
proprietary|3|0.9|unauthorized|unauthorized (?:copying|use|reproduction|distribution)(?: (?:or|and) (?:copying|use|reproduction|distribution))? (?:of this (?:file|work|material) )?is (?:strictly )?prohibited
proprietary|3|0.85|permission|may not be (?:copied|reproduced|used|distributed) without (?:the )?(?:prior )?(?:express )?(?:written )?permission
proprietary|2|0.8|proprietary|proprietary licen[cs]e
proprietary|2|0.8|commercial|commercial licen[cs]e
proprietary|2|0.8|eula|eula
proprietary|2|0.8|user|end user licen[cs]e agreement
trade-secret|3|0.9|trade|trade secrets? of
noncommercial|3|0.85|commercial|for non commercial (?:use|purposes) only
noncommercial|3|0.85|noncommercial|for noncommercial (?:use|purposes) only
research-only|3|0.85|research|for research (?:use|purposes) only
research-only|3|0.85|academic|for academic (?:use|purposes) only
personal-use|3|0.85|personal|for personal use only
internal-use|3|0.85|internal|for internal use only
no-ai-training|3|0.9|models|(?:may|must|shall) not be used (?:for|to) train(?:ing)?(?: of)?(?: any)? (?:ai|machine learning|language) models
copyright|2|0.6|copyright|(?:c )?copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)?\d\d)?
copyright|1|0.5|copyright|copyright (?:c|holders?|notice|owner)
copyright|1|0.5|copyrighted|copyrighted (?:work|material)
warranty-disclaimer|3|0.7|warranty|the software is provided as is without warranty of any kind
warranty-disclaimer|3|0.7|warranties|without warranties or conditions of any kind
warranty-disclaimer|2|0.6|warranty|without (?:any )?warranty
fair-use|2|0.6|fair|fair use
spdx|1|0.6|spdx|spdx license identifier \S+
license-hint|1|0.4|license|see (?:the )?license(?: file)? for (?:details|more information)
license-hint|1|0.4|licensed|licensed under the
license-hint|1|0.4|terms|(?:subject to|under) the terms of
"""

#: (label, priority, weight, gate, pattern)
RULES = tuple((a, int(b), float(c), d, e) for a, b, c, d, e in (line.split("|", 4) for line in _RULES.strip().split("\n")))
#: Phrases whose labels are never suppressed.
BASE = (("cc-by", "cc by", 0.85), ("gpl", "general public license", 0.8), ("reserved", "all rights reserved", 0.5))
GATES = tuple(sorted({r[3] for r in RULES} | {"cc", "general", "reserved"}))
