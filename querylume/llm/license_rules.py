"""The rules of the license scan, written by hand: label, kind, keywords, and what the words look like.

A rule's pattern runs over lower-cased words with blanks between, so that "GPL-3.0" reads ``gpl 3 0``. A blank stands for
whatever parts two words. LIC is licence or license, VER an optional "version" or "v". A rule is only tried on texts that
hold all of its keywords, which every match of its pattern contains.
"""

from __future__ import annotations

#: Kind of a rule: its priority (a higher one wins where detections lie within each other), and how sure it is.
KINDS = {"tag": (90, 1.0), "text": (80, 0.98), "grant": (70, 0.95), "url": (60, 0.9), "name": (50, 0.85), "bare": (30, 0.6), "hint": (10, 0.3)}

#: The phrases of the base scan and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# label | kind | keywords | pattern
RULES = r"""
mit | tag | spdx,mit | spdx license identifier mit
mit | text | permission,hereby,documentation | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | text | above,copyright,substantial | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
mit | grant | mit,under | (?:released|distributed|available|licensed|provided|published|made available) under (?:the )?(?:terms of (?:the )?)?(?:expat )?mit(?: LIC)?
mit | grant | mit,under | under the (?:terms of the )?mit(?: style)? LIC
mit | url | opensource,mit | opensource org licenses? mit(?: LIC)?(?: php)?
mit | name | mit,licen | mit LIC(?: mit)?
mit | name | expat,licen | expat LIC
mit | bare | mit,licen | LIC mit
mit-0 | tag | spdx,mit | spdx license identifier mit 0
mit-0 | name | mit,attribution | mit no attribution(?: LIC)?
x11 | tag | spdx,x11 | spdx license identifier x11
x11 | name | x11 | x11 LIC
x11 | text | consortium,advertising | the name of the x consortium shall not be used in advertising
isc | tag | spdx,isc | spdx license identifier isc
isc | text | permission,hereby,fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | grant | isc,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?isc(?: LIC)?
isc | name | isc | isc LIC
0bsd | tag | spdx,0bsd | spdx license identifier 0bsd
0bsd | name | zero,bsd | zero clause bsd(?: LIC)?
bsd-2-clause | tag | spdx,bsd | spdx license identifier bsd 2 clause
bsd-2-clause | grant | bsd,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: LIC)?
bsd-2-clause | name | bsd,clause | (?:2|two) clause bsd LIC
bsd-2-clause | name | bsd,clause | bsd (?:2|two) clause(?: LIC)?
bsd-2-clause | name | bsd,simplified | simplified bsd LIC
bsd-2-clause | name | freebsd,licen | freebsd LIC
bsd-2-clause | url | opensource,bsd | opensource org licenses? bsd 2 clause
bsd-3-clause | tag | spdx,bsd | spdx license identifier bsd 3 clause
bsd-3-clause | text | endorse,promote | neither the name of .{1,80} nor the names of (?:its|their|other) contributors may be used to endorse or promote products derived from this software
bsd-3-clause | grant | bsd,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: LIC)?
bsd-3-clause | name | bsd,clause | (?:3|three) clause bsd LIC
bsd-3-clause | name | bsd,clause | bsd (?:3|three) clause(?: LIC)?
bsd-3-clause | name | bsd | (?:new|modified|revised) bsd LIC
bsd-3-clause | url | opensource,bsd | opensource org licenses? bsd 3 clause
bsd-4-clause | tag | spdx,bsd | spdx license identifier bsd 4 clause
bsd-4-clause | text | advertising,mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | name | bsd,clause | (?:4|four) clause bsd(?: LIC)?
bsd-4-clause | name | bsd,original | original bsd LIC
bsd | text | redistribution,binary | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | text | redistributions,binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd | grant | bsd,under | (?:released|distributed|available|licensed) under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: LIC)?
bsd | bare | bsd | (?:the |a )?bsd(?: style)? LIC
apache-1.0 | tag | spdx,apache | spdx license identifier apache 1 0
apache-1.0 | name | apache | apache(?: software)? LIC VER1 0
apache-1.1 | tag | spdx,apache | spdx license identifier apache 1 1
apache-1.1 | name | apache | apache(?: software)? LIC VER1 1
apache-2 | tag | spdx,apache | spdx license identifier apache 2 0
apache-2 | text | licensed,apache,compliance | licensed under the apache license version 2 0 the license you may not use this (?:file|work|software) except in compliance with the license
apache-2 | grant | apache,under | (?:released|distributed|available|licensed|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? LIC VER2(?: 0)?
apache-2 | grant | apache,under | (?:released|distributed|available|licensed) under (?:the )?apache VER2(?: 0)?(?: LIC)?
apache-2 | url | apache,licenses | apache org licenses license 2 0(?: html| txt)?
apache-2 | url | opensource,apache | opensource org licenses? apache 2 0
apache-2 | name | apache | apache(?: software)? LIC VER2(?: 0)?
apache-2 | name | apache | apache VER2(?: 0)? LIC
apache-2 | name | asl | asl VER2(?: 0)?
apache | bare | apache | apache(?: software)? LIC
gpl-1 | tag | spdx,gpl | spdx license identifier gpl 1 0(?: only| or later)?
gpl-1 | name | general,public | (?:gnu )?(?:gpl|general public LIC(?: gpl)?) VER1(?: 0)?
gpl-2 | tag | spdx,gpl | spdx license identifier gpl 2 0(?: only)?
gpl-2-or-later | tag | spdx,gpl | spdx license identifier gpl 2 0 or later
gpl-2-or-later | text | redistribute,version,later | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2 | text | redistribute,version,foundation | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2(?: of the license)?
gpl | text | redistribute,general,foundation | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
gpl-2 | grant | general,public,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:gnu )?general public LIC(?: gnu gpl| gpl)? VER2(?: 0)?
gpl-2 | grant | gpl,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:gnu )?gpl ?VER2(?: 0)?
gpl-2 | url | gnu,licenses | gnu org (?:licenses old licenses|licenses) gpl 2 0(?: html| txt| en html)?
gpl-2 | name | general,public | (?:gnu )?general public LIC(?: gnu gpl| gpl)? VER2(?: 0)?(?: only)?
gpl-2 | name | gpl | (?:gnu )?gpl ?VER2(?: 0)?(?: only)?
gpl-2-or-later | name | gpl,later | (?:gnu )?gpl ?VER2(?: 0)? or (?:any )?later(?: version)?
gpl-2-or-later | name | general,public,later | (?:gnu )?general public LIC(?: gnu gpl| gpl)? VER2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3 | tag | spdx,gpl | spdx license identifier gpl 3 0(?: only)?
gpl-3-or-later | tag | spdx,gpl | spdx license identifier gpl 3 0 or later
gpl-3-or-later | text | redistribute,version,later | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3 | grant | general,public,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:gnu )?general public LIC(?: gnu gpl| gpl)? VER3(?: 0)?
gpl-3 | grant | gpl,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:gnu )?gpl ?VER3(?: 0)?
gpl-3 | url | gnu,licenses | gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-3 | url | opensource,gpl | opensource org licenses? gpl 3 0
gpl-3 | name | general,public | (?:gnu )?general public LIC(?: gnu gpl| gpl)? VER3(?: 0)?(?: only)?
gpl-3 | name | gpl | (?:gnu )?gpl ?VER3(?: 0)?(?: only)?
gpl-3-or-later | name | gpl,later | (?:gnu )?gpl ?VER3(?: 0)? or (?:any )?later(?: version)?
gpl-3-or-later | name | general,public,later | (?:gnu )?general public LIC(?: gnu gpl| gpl)? VER3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl | grant | general,public,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:gnu )?general public LIC
gpl | grant | gpl,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:gnu )?gpl(?: LIC)?
gpl | url | gnu,licenses | gnu org licenses gpl(?: html| txt)?
gpl | text | copy,received,general | you should have received a copy of the gnu general public license along with this (?:program|library|software)
gpl | text | copyleft,general | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | bare | general,public | gnu general public LIC
gpl | bare | gpl | gnu gpl(?: LIC)?
gpl-with-classpath-exception | tag | spdx,classpath | spdx license identifier gpl (?:2|3) 0(?: only| or later)? with classpath exception 2 0
gpl-with-classpath-exception | name | classpath | (?:gpl|general public LIC)(?: VER2(?: 0)?)? with (?:the )?classpath exception
lgpl-2 | tag | spdx,lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2 | name | library,general | (?:gnu )?library general public LIC(?: lgpl)?(?: VER2(?: 0)?)?
lgpl-2.1 | tag | spdx,lgpl | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | tag | spdx,lgpl | spdx license identifier lgpl 2 1 or later
lgpl-2.1-or-later | text | lesser,redistribute,later | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-2.1 | grant | lesser,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:gnu )?lesser general public LIC(?: gnu lgpl| lgpl)? VER2 1
lgpl-2.1 | name | lesser | (?:gnu )?lesser general public LIC(?: gnu lgpl| lgpl)? VER2 1(?: only)?
lgpl-2.1 | name | lgpl | (?:gnu )?lgpl ?VER2 1(?: only)?
lgpl-2.1-or-later | name | lgpl,later | (?:gnu )?lgpl ?VER2 1 or (?:any )?later(?: version)?
lgpl-2.1 | url | gnu,lgpl | gnu org (?:licenses old licenses|licenses) lgpl 2 1(?: html| txt)?
lgpl-3 | tag | spdx,lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3 | text | lesser,redistribute,version | you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-3 | grant | lesser,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:gnu )?lesser general public LIC(?: gnu lgpl| lgpl)? VER3(?: 0)?
lgpl-3 | name | lesser | (?:gnu )?lesser general public LIC(?: gnu lgpl| lgpl)? VER3(?: 0)?
lgpl-3 | name | lgpl | (?:gnu )?lgpl ?VER3(?: 0)?
lgpl-3 | url | gnu,lgpl | gnu org licenses lgpl 3 0(?: html| txt)?
lgpl | bare | lesser | (?:gnu )?lesser general public LIC(?: lgpl)?
lgpl | bare | lgpl | (?:gnu )?lgpl(?: LIC)?
agpl-3 | tag | spdx,agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3 | text | affero,redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3 | grant | affero,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?(?:gnu )?affero general public LIC(?: agpl)? VER3(?: 0)?
agpl-3 | name | affero | (?:gnu )?affero general public LIC(?: agpl)? VER3(?: 0)?
agpl-3 | name | agpl | (?:gnu )?agpl ?VER3(?: 0)?
agpl-3 | url | gnu,agpl | gnu org licenses agpl 3 0(?: html| txt)?
agpl-1 | name | affero | affero general public LIC VER1(?: 0)?
agpl | bare | affero | (?:gnu )?affero general public LIC
agpl | bare | agpl | (?:gnu )?agpl(?: LIC)?
gfdl-1.1 | name | documentation | (?:gnu )?free documentation LIC(?: gfdl)? VER1 1
gfdl-1.2 | name | documentation | (?:gnu )?free documentation LIC(?: gfdl)? VER1 2
gfdl-1.3 | name | documentation | (?:gnu )?free documentation LIC(?: gfdl)? VER1 3
gfdl-1.3 | tag | spdx,gfdl | spdx license identifier gfdl 1 3(?: only| or later)?
gfdl | grant | documentation,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?gnu free documentation LIC
gfdl | bare | documentation | gnu free documentation LIC
gfdl | bare | gfdl | (?:gnu )?gfdl
mpl-1.0 | tag | spdx,mpl | spdx license identifier mpl 1 0
mpl-1.0 | name | mozilla | mozilla public LIC(?: mpl)? VER1 0
mpl-1.1 | tag | spdx,mpl | spdx license identifier mpl 1 1
mpl-1.1 | name | mozilla | mozilla public LIC(?: mpl)? VER1 1
mpl-1.1 | text | contents,subject,mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | tag | spdx,mpl | spdx license identifier mpl 2 0
mpl-2.0 | text | mozilla,subject | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | text | mozilla,obtain | if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla org mpl 2 0
mpl-2.0 | grant | mozilla,under | (?:released|distributed|available|licensed) under (?:the )?(?:terms of the )?mozilla public LIC(?: mpl)? VER2(?: 0)?
mpl-2.0 | url | mozilla,mpl | mozilla org (?:en us )?mpl 2 0
mpl-2.0 | name | mozilla | mozilla public LIC(?: mpl)? VER2(?: 0)?
mpl-2.0 | name | mpl | mpl ?VER2 0
mpl | bare | mozilla | mozilla public LIC
epl-1.0 | tag | spdx,epl | spdx license identifier epl 1 0
epl-1.0 | name | eclipse | eclipse public LIC(?: epl)? VER1(?: 0)?
epl-1.0 | url | eclipse,legal | eclipse org legal epl v10(?: html)?
epl-2.0 | tag | spdx,epl | spdx license identifier epl 2 0
epl-2.0 | name | eclipse | eclipse public LIC(?: epl)? VER2(?: 0)?
epl-2.0 | url | eclipse,legal | eclipse org legal epl (?:v20|2 0)(?: html)?
epl | bare | eclipse | eclipse public LIC
edl-1.0 | name | eclipse | eclipse distribution LIC(?: edl)?(?: VER1 0)?
cddl-1.0 | tag | spdx,cddl | spdx license identifier cddl 1 0
cddl-1.0 | name | common,development | common development and distribution LIC(?: cddl)? VER1(?: 0)?
cddl-1.1 | tag | spdx,cddl | spdx license identifier cddl 1 1
cddl-1.1 | name | common,development | common development and distribution LIC(?: cddl)? VER1 1
cddl | bare | common,development | common development and distribution LIC
cddl | bare | cddl | cddl(?: LIC)?
cpl-1.0 | name | common | common public LIC(?: VER1 0)?
cpal-1.0 | name | common,attribution | common public attribution LIC(?: VER1 0)?
ipl-1.0 | name | ibm | ibm public LIC(?: VER1 0)?
eupl-1.1 | name | european | european union public LIC(?: eupl)? VER1 1
eupl-1.2 | tag | spdx,eupl | spdx license identifier eupl 1 2
eupl-1.2 | name | european | european union public LIC(?: eupl)? VER1 2
eupl | grant | eupl,under | (?:released|distributed|licensed) under (?:the )?eupl
eupl | bare | european | european union public LIC
eupl | bare | eupl | eupl
osl-3.0 | tag | spdx,osl | spdx license identifier osl 3 0
osl-3.0 | name | open | open software LIC(?: osl)? VER3(?: 0)?
afl-3.0 | name | academic | academic free LIC(?: afl)? VER3(?: 0)?
afl-2.1 | name | academic | academic free LIC(?: afl)? VER2 1
afl | bare | academic | academic free LIC
artistic-1.0 | tag | spdx,artistic | spdx license identifier artistic 1 0(?: perl)?
artistic-1.0 | name | artistic | artistic LIC VER1(?: 0)?
artistic-2.0 | tag | spdx,artistic | spdx license identifier artistic 2 0
artistic-2.0 | name | artistic | artistic LIC VER2(?: 0)?
artistic | grant | perl,terms | (?:under|on) the same terms as perl(?: 5)?(?: itself)?
artistic | bare | artistic | (?:perl )?artistic LIC
bsl-1.0 | tag | spdx,bsl | spdx license identifier bsl 1 0
bsl-1.0 | text | boost,distributed | distributed under the boost software license version 1 0
bsl-1.0 | url | boost,license | boost org license 1 0 txt
bsl-1.0 | name | boost | boost software LIC(?: bsl)?(?: VER1(?: 0)?)?
busl-1.1 | tag | spdx,busl | spdx license identifier busl 1 1
busl-1.1 | name | business | business source LIC(?: bsl| busl)?(?: VER1 1)?
sspl-1.0 | tag | spdx,sspl | spdx license identifier sspl 1 0
sspl-1.0 | name | server,side | server side public LIC(?: sspl)?(?: VER1(?: 0)?)?
elastic-2.0 | tag | spdx,elastic | spdx license identifier elastic 2 0
elastic-2.0 | name | elastic | elastic LIC(?: VER2(?: 0)?)?
zlib | tag | spdx,zlib | spdx license identifier zlib
zlib | text | altered,source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | text | origin,misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | grant | zlib,under | (?:released|distributed|licensed) under (?:the )?zlib(?: libpng)?(?: LIC)?
zlib | name | zlib | zlib(?: libpng)? LIC
libpng | name | libpng | libpng LIC
unlicense | tag | spdx,unlicense | spdx license identifier unlicense
unlicense | text | unencumbered,public | this is free and unencumbered software released into the public domain
unlicense | url | unlicense | unlicense org
unlicense | name | unlicense | unlicense
wtfpl | tag | spdx,wtfpl | spdx license identifier wtfpl
wtfpl | name | fuck,public | do what the fuck you want to public LIC(?: wtfpl)?(?: VER2)?
wtfpl | name | wtfpl | wtfpl(?: VER2)?
beerware | name | beer | beer ?ware LIC(?: revision 42)?
cc0-1.0 | tag | spdx,cc0 | spdx license identifier cc0 1 0
cc0-1.0 | text | waived,copyright,related | has waived all copyright and related or neighbou?ring rights to
cc0-1.0 | url | creativecommons,zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | name | cc0 | (?:creative commons )?cc0(?: VER1 0)?(?: universal)?(?: public domain dedication)?
cc0-1.0 | name | creative,zero | creative commons zero(?: VER1 0)?(?: universal)?
cc-pdm-1.0 | url | creativecommons,mark | creativecommons org publicdomain mark 1 0
cc-pdm-1.0 | name | public,mark | public domain mark(?: VER1 0)?
cc-by-1.0 | tag | spdx,cc | spdx license identifier cc by 1 0
cc-by-2.0 | tag | spdx,cc | spdx license identifier cc by 2 0
cc-by-2.5 | tag | spdx,cc | spdx license identifier cc by 2 5
cc-by-3.0 | tag | spdx,cc | spdx license identifier cc by 3 0
cc-by-4.0 | tag | spdx,cc | spdx license identifier cc by 4 0
cc-by-2.0 | name | cc | cc by VER2 0
cc-by-2.5 | name | cc | cc by VER2 5
cc-by-3.0 | name | cc | cc by VER3 0
cc-by-4.0 | name | cc | cc by VER4 0
cc-by-2.0 | name | creative,attribution | creative commons attribution(?: LIC)? VER2 0
cc-by-3.0 | name | creative,attribution | creative commons attribution(?: LIC)? VER3 0(?: unported| united states)?(?: LIC)?
cc-by-4.0 | name | creative,attribution | creative commons attribution(?: LIC)? VER4 0(?: international)?(?: public)?(?: LIC)?
cc-by-3.0 | url | creativecommons,licenses | creativecommons org licenses by 3 0
cc-by-4.0 | url | creativecommons,licenses | creativecommons org licenses by 4 0
cc-by | bare | creative,attribution | creative commons attribution(?: LIC)?
cc-by | bare | cc | cc by(?: LIC)?
cc-by-sa-2.0 | name | cc,sa | cc by sa VER2 0
cc-by-sa-2.5 | name | cc,sa | cc by sa VER2 5
cc-by-sa-3.0 | name | cc,sa | cc by sa VER3 0
cc-by-sa-4.0 | name | cc,sa | cc by sa VER4 0
cc-by-sa-3.0 | name | creative,attribution,share | creative commons attribution share ?alike(?: LIC)? VER3 0(?: unported)?(?: LIC)?
cc-by-sa-4.0 | name | creative,attribution,share | creative commons attribution share ?alike(?: LIC)? VER4 0(?: international)?(?: public)?(?: LIC)?
cc-by-sa-3.0 | url | creativecommons,licenses | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | url | creativecommons,licenses | creativecommons org licenses by sa 4 0
cc-by-sa | bare | creative,attribution,share | creative commons attribution share ?alike(?: LIC)?
cc-by-sa | bare | cc,sa | cc by sa(?: LIC)?
cc-by-nd-3.0 | name | cc,nd | cc by nd VER3 0
cc-by-nd-4.0 | name | cc,nd | cc by nd VER4 0
cc-by-nd-4.0 | name | creative,attribution,deriv | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: LIC)? VER4 0(?: international)?
cc-by-nd-4.0 | url | creativecommons,licenses | creativecommons org licenses by nd 4 0
cc-by-nd | bare | creative,attribution,deriv | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: LIC)?
cc-by-nd | bare | cc,nd | cc by nd(?: LIC)?
cc-by-nc-2.0 | name | cc,nc | cc by nc VER2 0
cc-by-nc-3.0 | name | cc,nc | cc by nc VER3 0
cc-by-nc-4.0 | name | cc,nc | cc by nc VER4 0
cc-by-nc-4.0 | tag | spdx,nc | spdx license identifier cc by nc 4 0
cc-by-nc-3.0 | name | creative,attribution,commercial | creative commons attribution non ?commercial(?: LIC)? VER3 0(?: unported)?(?: LIC)?
cc-by-nc-4.0 | name | creative,attribution,commercial | creative commons attribution non ?commercial(?: LIC)? VER4 0(?: international)?(?: public)?(?: LIC)?
cc-by-nc-4.0 | url | creativecommons,licenses | creativecommons org licenses by nc 4 0
cc-by-nc | bare | creative,attribution,commercial | creative commons attribution non ?commercial(?: LIC)?
cc-by-nc | bare | cc,nc | cc by nc(?: LIC)?
cc-by-nc-sa-3.0 | name | cc,nc | cc by nc sa VER3 0
cc-by-nc-sa-4.0 | name | cc,nc | cc by nc sa VER4 0
cc-by-nc-sa-4.0 | name | creative,attribution,commercial | creative commons attribution non ?commercial share ?alike(?: LIC)? VER4 0(?: international)?(?: public)?(?: LIC)?
cc-by-nc-sa-4.0 | url | creativecommons,licenses | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa | bare | creative,attribution,commercial | creative commons attribution non ?commercial share ?alike(?: LIC)?
cc-by-nc-sa | bare | cc,nc | cc by nc sa(?: LIC)?
cc-by-nc-nd-3.0 | name | cc,nc | cc by nc nd VER3 0
cc-by-nc-nd-4.0 | name | cc,nc | cc by nc nd VER4 0
cc-by-nc-nd-4.0 | name | creative,attribution,commercial | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: LIC)? VER4 0(?: international)?(?: public)?(?: LIC)?
cc-by-nc-nd-4.0 | url | creativecommons,licenses | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd | bare | creative,attribution,commercial | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: LIC)?
cc-by-nc-nd | bare | cc,nc | cc by nc nd(?: LIC)?
creative-commons | bare | creative,commons | (?:a |the )?creative commons LIC
odbl-1.0 | name | open,database | open database LIC(?: odbl)?(?: VER1 0)?
odbl-1.0 | url | opendatacommons,odbl | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | name | open,data,attribution | open data commons attribution LIC(?: VER1 0)?
odc-by-1.0 | name | odc | odc by(?: VER1 0)?
pddl-1.0 | name | public,dedication | (?:open data commons )?public domain dedication and LIC(?: pddl)?
cdla-permissive | name | community,permissive | community data LIC agreement permissive(?: VER[12] 0)?
cdla-sharing | name | community,sharing | community data LIC agreement sharing(?: VER1 0)?
ogl-uk-3.0 | name | open,government | open government LIC(?: VER3 0)
ogl-uk | bare | open,government | open government LIC
python-2.0 | tag | spdx,python | spdx license identifier python 2 0
python-2.0 | name | python | (?:psf|python software foundation) LIC(?: agreement)?(?: VER2)?
python-2.0 | bare | python | python LIC
ruby | name | ruby | ruby LIC
php-3.0 | name | php | php LIC VER3 0
php-3.01 | name | php | php LIC VER3 01
postgresql | name | postgresql | postgresql LIC
openssl | name | openssl | openssl LIC
openldap | name | openldap | openldap public LIC(?: VER2 8)?
ms-pl | name | microsoft | microsoft public LIC(?: ms pl)?
ms-rl | name | microsoft | microsoft reciprocal LIC(?: ms rl)?
ncsa | name | ncsa | (?:university of illinois )?ncsa(?: open source)? LIC
w3c | name | w3c | w3c software(?: notice and| and document)? LIC
ofl-1.1 | tag | spdx,ofl | spdx license identifier ofl 1 1
ofl-1.1 | name | open,font | (?:sil )?open font LIC(?: ofl)?(?: VER1 1)?
ofl-1.1 | url | scripts,ofl | scripts sil org ofl
vim | name | vim | vim LIC
qpl-1.0 | name | public | q public LIC(?: qpl)?(?: VER1 0)?
lppl-1.3 | name | latex | latex project public LIC(?: lppl)?(?: VER1 3c?)?
mulan-psl-2.0 | name | mulan | mulan (?:psl|permissive software LIC)(?: VER2)?
upl-1.0 | name | universal | universal permissive LIC(?: upl)?(?: VER1 0)?
blueoak-1.0.0 | name | blue,oak | blue oak model LIC(?: 1 0 0)?
hippocratic | name | hippocratic | hippocratic LIC
openrail-m | name | open | (?:creativeml |bigscience )?open ?rail m?(?: LIC)?
polyform-noncommercial | name | polyform | polyform noncommercial LIC(?: 1 0 0)?
commons-clause | name | commons,clause | commons clause(?: LIC)? condition(?: VER1 0)?
jsr-json | text | software,shall,evil | the software shall be used for good not evil
proprietary | text | confidential,proprietary | (?:this (?:software|document|file) is |is )?(?:confidential and proprietary|proprietary and confidential)
proprietary | text | unauthori,copying | unauthori[sz]ed copying of this (?:file|software|document) via any medium is strictly prohibited
proprietary | grant | end,user,agreement | end user LIC agreement
non-commercial | hint | commercial,use | (?:for )?non ?commercial use only
public-domain | grant | public,domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | bare | public,domain | (?:in|is) (?:in )?(?:the )?public domain
all-rights-reserved | hint | rights,reserved | all rights reserved
copyright | hint | copyright | copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
licensed | hint | licensed | (?:is |are )?licensed under(?: the)?(?: terms of(?: the)?)?
licensed | hint | licen | see (?:the )?(?:accompanying )?LIC(?: file)? for (?:more )?(?:details|information|the full)
"""
