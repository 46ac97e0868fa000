"""Signature rules of the licence scan: label | priority | weight | keywords | pattern.

Patterns see lower-case words joined by single spaces, at word borders; every match holds at
least one of a rule's keywords (words or parts, separated by slashes).  Priorities: 9 identifier tags, 8 full titles with a version, 7 sentences from the licence text,
6 titles, 5 links, 4 notices, 3 short names.
"""

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_TABLE = r"""
gpl|9|0.99|spdx|spdx license identifier gpl [123] 0( (only|or later))?
lgpl|9|0.99|spdx|spdx license identifier lgpl [23] [01]( (only|or later))?
agpl|9|0.99|spdx|spdx license identifier agpl [13] 0( (only|or later))?
mit|9|0.99|spdx|spdx license identifier mit
mit-0|9|0.99|spdx|spdx license identifier mit 0
apache|9|0.99|spdx|spdx license identifier apache [12] [01]
bsd|9|0.99|spdx|spdx license identifier (0bsd|bsd [1234] clause( patent| clear)?)
mpl|9|0.99|spdx|spdx license identifier mpl [12] [01]
isc|9|0.99|spdx|spdx license identifier isc
zlib|9|0.99|spdx|spdx license identifier zlib
epl|9|0.99|spdx|spdx license identifier epl [12] 0
eupl|9|0.99|spdx|spdx license identifier eupl 1 [012]
cddl|9|0.99|spdx|spdx license identifier cddl 1 [01]
cc0|9|0.99|spdx|spdx license identifier cc0 1 0
cc-by|9|0.99|spdx|spdx license identifier cc by [1234] [05]
cc-by-sa|9|0.99|spdx|spdx license identifier cc by sa [1234] [05]
cc-by-nc|9|0.99|spdx|spdx license identifier cc by nc [1234] [05]
cc-by-nd|9|0.99|spdx|spdx license identifier cc by nd [1234] [05]
cc-by-nc-sa|9|0.99|spdx|spdx license identifier cc by nc sa [1234] [05]
cc-by-nc-nd|9|0.99|spdx|spdx license identifier cc by nc nd [1234] [05]
unlicense|9|0.99|spdx|spdx license identifier unlicense
wtfpl|9|0.99|spdx|spdx license identifier wtfpl
boost|9|0.99|spdx|spdx license identifier bsl 1 0
busl|9|0.99|spdx|spdx license identifier busl 1 1
artistic|9|0.99|spdx|spdx license identifier artistic [12] 0
postgresql|9|0.99|spdx|spdx license identifier postgresql
python|9|0.99|spdx|spdx license identifier (psf 2 0|python 2 0)
ofl|9|0.99|spdx|spdx license identifier ofl 1 [01]
odbl|9|0.99|spdx|spdx license identifier odbl 1 0
openssl|9|0.99|spdx|spdx license identifier openssl
php|9|0.99|spdx|spdx license identifier php 3 0(1)?
ruby|9|0.99|spdx|spdx license identifier ruby
unicode|9|0.99|spdx|spdx license identifier unicode (dfs 201[56]|3 0|tou)
upl|9|0.99|spdx|spdx license identifier upl 1 0
vim|9|0.99|spdx|spdx license identifier vim
w3c|9|0.99|spdx|spdx license identifier w3c
x11|9|0.99|spdx|spdx license identifier x11
ncsa|9|0.99|spdx|spdx license identifier ncsa
ms-pl|9|0.99|spdx|spdx license identifier ms pl
ms-rl|9|0.99|spdx|spdx license identifier ms rl
osl|9|0.99|spdx|spdx license identifier osl [123] [01]
afl|9|0.99|spdx|spdx license identifier afl [123] [012]
sspl|9|0.99|spdx|spdx license identifier sspl 1 0
elastic|9|0.99|spdx|spdx license identifier elastic 2 0
mulan|9|0.99|spdx|spdx license identifier mulanpsl [12] 0
cecill|9|0.99|spdx|spdx license identifier cecill (b|c|1 [01]|2 [01])
blueoak|9|0.99|spdx|spdx license identifier blueoak 1 0 0
gfdl|9|0.99|spdx|spdx license identifier gfdl 1 [123]( (only|or later))?
gpl|8|0.98|general public|gnu general public license( as published by the free software foundation)? (version|v) [123]( 0)?
gpl|8|0.98|general public|version [123]( 0)? of the gnu general public license
gpl|8|0.97|gplv|gplv[123]( or later)?
gpl|8|0.95|gpl|gpl (version |v)?[123]( 0)? or (later|newer)
lgpl|8|0.98|lesser general|gnu lesser general public license( version| v)? [23]( [01])?
lgpl|8|0.98|library general|gnu library general public license( version| v)? 2( 0)?
lgpl|8|0.97|lgplv|lgplv[23]( 1)?( or later)?
agpl|8|0.98|affero|gnu affero general public license( version| v)? 3( 0)?
agpl|8|0.98|affero|affero general public license( version| v)? 1( 0)?
agpl|8|0.97|agplv|agplv[13]( or later)?
apache|8|0.98|apache|apache license,? (version|v)? ?2( 0)?
apache|8|0.98|apache|apache (software )?license( version| v)? 1 [01]
apache|8|0.96|apache|apache (v)?2( 0)? license
bsd-2-clause|8|0.97|bsd|(bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license
bsd-3-clause|8|0.97|bsd|(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license
bsd-4-clause|8|0.97|bsd|(bsd 4 clause|4 clause bsd|original bsd|old bsd) license
bsd-0-clause|8|0.97|bsd|(bsd zero clause|zero clause bsd|0 clause bsd|0bsd) license
mpl|8|0.98|mozilla|mozilla public license( version| v)? [12] [01]
epl|8|0.98|eclipse|eclipse public license( version| v)? [12] 0
edl|8|0.97|eclipse|eclipse distribution license( version| v)? 1 0
eupl|8|0.98|european|european union public licen[cs]e( version| v)? 1 [012]
cddl|8|0.98|common development|common development and distribution license( version| v)? 1 [01]
cpl|8|0.97|common public|common public license( version| v)? 1 0
cpal|8|0.97|common public|common public attribution license( version| v)? 1 0
cc-by|8|0.98|creative commons|creative commons attribution [1234] [05]( international| unported| generic)?( public)? license
cc-by-sa|8|0.98|creative commons|creative commons attribution share ?alike [1234] [05]( international| unported| generic)?( public)? license
cc-by-nc|8|0.98|creative commons|creative commons attribution non ?commercial [1234] [05]( international| unported| generic)?( public)? license
cc-by-nd|8|0.98|creative commons|creative commons attribution no ?deriv(ative)?s( works)? [1234] [05]( international| unported| generic)?( public)? license
cc-by-nc-sa|8|0.98|creative commons|creative commons attribution non ?commercial share ?alike [1234] [05]( international| unported| generic)?( public)? license
cc-by-nc-nd|8|0.98|creative commons|creative commons attribution non ?commercial no ?deriv(ative)?s( works)? [1234] [05]( international| unported| generic)?( public)? license
cc0|8|0.98|cc0|cc0 1 0( universal)?( public domain dedication)?
cc-by|8|0.96|cc by|(licensed under |under )?(a |the )?cc by [1234] [05]( license)?
cc-by-sa|8|0.96|cc by sa|(licensed under |under )?(a |the )?cc by sa [1234] [05]( license)?
cc-by-nc|8|0.96|cc by nc|(licensed under |under )?(a |the )?cc by nc [1234] [05]( license)?
cc-by-nd|8|0.96|cc by nd|(licensed under |under )?(a |the )?cc by nd [1234] [05]( license)?
cc-by-nc-sa|8|0.96|cc by nc sa|(licensed under |under )?(a |the )?cc by nc sa [1234] [05]( license)?
cc-by-nc-nd|8|0.96|cc by nc nd|(licensed under |under )?(a |the )?cc by nc nd [1234] [05]( license)?
gfdl|8|0.98|free documentation|gnu free documentation license( version| v)? 1 [123]
artistic|8|0.97|artistic|(the )?artistic license( version| v)? [12] 0
osl|8|0.97|open software|open software license( version| v)? [123] [01]
afl|8|0.97|academic free|academic free license( version| v)? [123] [012]
boost|8|0.98|boost|boost software license( version| v)? 1 0
busl|8|0.97|business source|business source license( version| v)? 1 1
ofl|8|0.98|open font|(sil )?open font license( version| v)? 1 [01]
odbl|8|0.98|open database|open database license( version| v)? 1 0
odc-by|8|0.97|open data|open data commons attribution license( version| v)? 1 0
pddl|8|0.97|public domain|public domain dedication and license( version| v)? 1 0
sspl|8|0.98|server side|server side public license( version| v)? 1
elastic|8|0.97|elastic|elastic license( version| v)? 2( 0)?
lppl|8|0.97|latex|latex project public license( version| v)? 1 [0123][abc]?
mulan|8|0.97|mulan|mulan (permissive software|psl) license( version| v)? ?[12]
cecill|8|0.97|cecill|cecill( [bc])? (free software )?license agreement( version)?( [12] [01])?
ms-pl|8|0.97|microsoft public|microsoft public license( ms pl)?
ms-rl|8|0.97|microsoft reciprocal|microsoft reciprocal license( ms rl)?
upl|8|0.97|universal permissive|universal permissive license( version| v)? 1 0
qpl|8|0.96|q public|q public license( version| v)? 1 0
zpl|8|0.96|zope|zope public license( version| v)? [12] [01]
sleepycat|8|0.96|sleepycat|sleepycat license
naumen|8|0.95|naumen|naumen public license
watcom|8|0.95|watcom|sybase open watcom public license( version)?( 1 0)?
rpsl|8|0.95|realnetworks|realnetworks public source license( version| v)? 1 0
apsl|8|0.96|apple public|apple public source license( version| v)? [12] [012]
ipl|8|0.96|ibm public|ibm public license( version| v)? 1 0
npl|8|0.96|netscape|netscape public license( version| v)? 1 [01]
spl|8|0.95|sun public|sun public license( version| v)? 1 0
sissl|8|0.95|sun industry|sun industry standards source license
nasa|8|0.95|nasa open|nasa open source agreement( version)?( 1 3)?
eudatagrid|8|0.95|eu datagrid|eu datagrid software license
rpl|8|0.95|reciprocal public|reciprocal public license( version| v)? 1 [15]
mit|7|0.97|permission is hereby|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|7|0.96|substantial portions|the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0|7|0.95|permission to use|permission to use copy modify merge publish distribute sublicense and or sell copies of the software
isc|7|0.97|permission to use|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc|7|0.95|permission to use|permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
bsd|7|0.96|redistribution and use|redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause|7|0.96|endorse or promote|may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|7|0.96|advertising materials|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd|7|0.9|redistributions of source|redistributions of source code must retain the above copyright notice
bsd|7|0.9|redistributions in binary|redistributions in binary form must reproduce the above copyright notice
apache|7|0.97|unless required by|unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache|7|0.96|may not use this file|you may not use this file except in compliance with the license
apache|7|0.95|asf|licensed to the apache software foundation asf under one or more contributor license agreements
gpl|7|0.97|free software|this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl|7|0.97|free software|this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
agpl|7|0.97|free software|this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl|7|0.9|without even the implied|this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty
gpl|7|0.95|gnu general public|you should have received a copy of the gnu general public license along with this program
lgpl|7|0.95|general public|you should have received a copy of the gnu (lesser|library) general public license along with this library
agpl|7|0.95|affero|you should have received a copy of the gnu affero general public license along with this program
mpl|7|0.97|source code form|this source code form is subject to the terms of the mozilla public license
mpl|7|0.95|mpl was not distributed|if a copy of the mpl was not distributed with this file you can obtain one
zlib|7|0.96|as is without any express|this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib|7|0.95|must not be misrepresented|the origin of this software must not be misrepresented
zlib|7|0.93|altered source|altered source versions must be plainly marked as such
unlicense|7|0.97|unencumbered|this is free and unencumbered software released into the public domain
unlicense|7|0.9|anyone is free|anyone is free to copy modify publish use compile sell or distribute this software
wtfpl|7|0.97|what the|do what the (fuck|f ck) you want to public license
boost|7|0.95|boost|distributed under the boost software license version 1 0
epl|7|0.96|eclipse|this program and the accompanying materials are made available under the terms of the eclipse public license
cddl|7|0.95|common development|the contents of this file are subject to the terms of the common development and distribution license
ofl|7|0.95|font software|this font software is licensed under the sil open font license
cc0|7|0.95|waived all|has waived all copyright and related or neighboring rights
cc-by|7|0.94|creative commons|this work is licensed under (a|the) creative commons attribution( [1234] [05])?( international| unported| generic)? license
cc-by-sa|7|0.94|creative commons|this work is licensed under (a|the) creative commons attribution share ?alike( [1234] [05])?( international| unported| generic)? license
cc-by-nc|7|0.94|creative commons|this work is licensed under (a|the) creative commons attribution non ?commercial( [1234] [05])?( international| unported| generic)? license
postgresql|7|0.94|paragraph|provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
ncsa|7|0.94|with the software without|to deal with the software without restriction including without limitation
openssl|7|0.95|openssl|this product includes software developed by the openssl project for use in the openssl toolkit
php|7|0.95|php|this product includes php software
python|7|0.94|python software|this license agreement is between the python software foundation
unicode|7|0.94|unicode|permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c|7|0.94|permission to copy|permission to copy modify and distribute this (software|work) and its documentation( with or without modification)? for any purpose
vim|7|0.92|vim|there are no restrictions on distributing unmodified copies of vim
beerware|7|0.95|beer|(you )?can buy me a beer in return
ms-pl|7|0.93|accompanying software|this license governs use of the accompanying software if you use the software you accept this license
fsfap|7|0.94|copying and distribution|copying and distribution of this file with or without modification are permitted in any medium without royalty
json|7|0.95|good not evil|the software shall be used for good not evil
lppl|7|0.94|latex|this work may be distributed and or modified under the conditions of the latex project public license
gpl|6|0.94|general public/gnu gpl|(the )?gnu (general public license|gpl)
gpl|6|0.9|general public|general public licen[cs]e of the gnu project
lgpl|6|0.94|general public|(the )?gnu (lesser|library) general public license
agpl|6|0.94|affero|(the )?gnu affero general public license
apache|6|0.93|apache|(the )?apache (software )?license
mit|6|0.93|mit license|(released |licensed |available |distributed )?(under )?(the )?mit license
x11|6|0.93|x11/x consortium|(the )?(x11|x consortium) license
mit|6|0.9|expat|(the )?expat license
bsd|6|0.93|bsd|(the )?bsd( style)? license
isc|6|0.93|isc license|(the )?isc license
zlib|6|0.93|zlib|(the )?zlib( libpng)? license
libpng|6|0.93|libpng/png reference|(the )?(libpng|png reference library) license
mpl|6|0.93|mozilla|(the )?mozilla public license
epl|6|0.93|eclipse|(the )?eclipse public license
eupl|6|0.93|european|(the )?european union public licen[cs]e
cddl|6|0.93|common development|(the )?common development and distribution license
unlicense|6|0.92|unlicense|(the )?unlicense
wtfpl|6|0.92|wtfpl|(the )?wtfpl
artistic|6|0.92|artistic|(the )?(perl )?artistic license
boost|6|0.93|boost|(the )?boost software license
ofl|6|0.93|open font|(the )?(sil )?open font license
odbl|6|0.93|open database|(the )?open database license
gfdl|6|0.93|free documentation|(the )?gnu free documentation license
postgresql|6|0.93|postgresql|(the )?postgresql licen[cs]e
python|6|0.92|python/psf|(the )?(python software foundation|psf|python) license
php|6|0.92|php license|(the )?php license
ruby|6|0.92|ruby license|(the )?ruby license
openssl|6|0.92|openssl|(the )?(openssl|openssl ssleay) license
curl|6|0.92|curl license|(the )?curl license
intel|6|0.9|intel open|(the )?intel open source license
ntp|6|0.9|ntp license|(the )?ntp license
hpnd|6|0.9|historical permission|historical permission notice and disclaimer
blueoak|6|0.92|blue oak|blue oak model license
polyform|6|0.92|polyform|polyform (noncommercial|shield|strict|small business|perimeter|free trial|internal use) license
commons-clause|6|0.92|commons clause|commons clause license condition
openrail|6|0.92|openrail/open rail|(creativeml |bigscience |bigcode )?open ?rail( m| s)? license
openrail|6|0.9|responsible ai|responsible ai license
llama|6|0.9|llama|llama [123]( [0-9])? community license( agreement)?
gemma|6|0.9|gemma|gemma terms of use
cc0|6|0.92|cc0|(the )?cc0( license| waiver| public domain dedication)?
cc-by|6|0.93|creative commons|creative commons attribution( license| licence)?
cc-by-sa|6|0.93|creative commons|creative commons attribution share ?alike( license| licence)?
cc-by-nc|6|0.93|creative commons|creative commons attribution non ?commercial( license| licence)?
cc-by-nd|6|0.93|creative commons|creative commons attribution no ?deriv(ative)?s( license| licence)?
cc-by-nc-sa|6|0.93|creative commons|creative commons attribution non ?commercial share ?alike( license| licence)?
cc-by-nc-nd|6|0.93|creative commons|creative commons attribution non ?commercial no ?deriv(ative)?s( license| licence)?
public-domain|6|0.85|public domain|(released|placed|dedicated|put) (in|into|to) the public domain
public-domain|6|0.8|public domain|this (work|file|code|software) is in the public domain
ogl|6|0.92|open government|open government licen[cs]e( v[123] 0)?
gpl|5|0.95|gnu org|(https? )?www gnu org (licenses|copyleft) gpl( [123] 0)?( html| txt)?
lgpl|5|0.95|gnu org|(https? )?www gnu org (licenses|copyleft) lgpl( [23] [01])?( html| txt)?
agpl|5|0.95|gnu org|(https? )?www gnu org licenses agpl( 3 0)?( html| txt)?
gfdl|5|0.95|gnu org|(https? )?www gnu org licenses fdl( 1 [123])?( html| txt)?
apache|5|0.95|apache org|(https? )?www apache org licenses license [12] [01]( html| txt)?
mit|5|0.95|opensource org|(https? )?(www )?opensource org licenses mit( license( php)?)?
bsd|5|0.95|opensource org|(https? )?(www )?opensource org licenses bsd( license| [23] clause)?( php)?
isc|5|0.95|opensource org|(https? )?(www )?opensource org licenses isc
cc-by|5|0.95|creativecommons|(https? )?creativecommons org licenses by [1234] [05]
cc-by-sa|5|0.95|creativecommons|(https? )?creativecommons org licenses by sa [1234] [05]
cc-by-nc|5|0.95|creativecommons|(https? )?creativecommons org licenses by nc [1234] [05]
cc-by-nd|5|0.95|creativecommons|(https? )?creativecommons org licenses by nd [1234] [05]
cc-by-nc-sa|5|0.95|creativecommons|(https? )?creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-nd|5|0.95|creativecommons|(https? )?creativecommons org licenses by nc nd [1234] [05]
cc0|5|0.95|creativecommons|(https? )?creativecommons org publicdomain zero 1 0
mpl|5|0.95|mozilla org|(https? )?(www )?mozilla org mpl( [12] [01])?
epl|5|0.95|eclipse org|(https? )?www eclipse org (legal|org documents) epl (v10|2 0|v20)( html)?
unlicense|5|0.95|unlicense org|(https? )?unlicense org
boost|5|0.95|boost org|(https? )?www boost org license 1 0 txt
ofl|5|0.95|scripts sil|(https? )?scripts sil org ofl
odbl|5|0.95|opendatacommons|(https? )?(www )?opendatacommons org licenses odbl( 1 0)?
wtfpl|5|0.95|wtfpl|(https? )?(www )?wtfpl net
all-rights-reserved|4|0.7|all rights|all rights reserved
proprietary|4|0.75|proprietary|(proprietary and confidential|confidential and proprietary)
proprietary|4|0.7|unauthorized|unauthorized (copying|use|reproduction|distribution) of this (file|software|document|work)( via any medium)? is (strictly )?prohibited
proprietary|4|0.7|may not be|may not be (reproduced|copied|distributed|used)( in any form)? without( the)?( prior)?( written)? permission
non-commercial|4|0.7|commercial use|for non ?commercial use only
copyright|4|0.6|copyright|copyright (c )?(19|20)[0-9]{2}( (19|20)[0-9]{2})?
gpl|3|0.6|gpl|gpl [123]( 0)?
lgpl|3|0.6|lgpl|lgpl( [23] [01])?
agpl|3|0.6|agpl|agpl( 3 0)?
cc-by|3|0.7|cc by|cc by
cc-by-sa|3|0.7|cc by sa|cc by sa
cc-by-nc|3|0.7|cc by nc|cc by nc
cc-by-nd|3|0.7|cc by nd|cc by nd
cc-by-nc-sa|3|0.7|cc by nc sa|cc by nc sa
cc-by-nc-nd|3|0.7|cc by nc nd|cc by nc nd
"""


def _read() -> list[tuple[str, int, float, str, str]]:
    out = []
    for line in _TABLE.strip().split("\n"):
        label, priority, weight, keyword, pattern = line.split("|", 4)
        out.append((label, int(priority), float(weight), keyword, pattern))
    # The base phrases take part too, so that a text with one always passes the keyword gate.
    out += [(label, 3, 0.9, phrase, phrase) for phrase, label in BASE.items()]
    return out


RULES = _read()
