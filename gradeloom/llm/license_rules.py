"""Signature rules of licences, by hand.

A line is ``label; keyword; pattern``, under a heading ``[level weight]``. Rules apply to texts
as lower-case words. In a pattern a space stands for the step from one word to the next, so a
pattern starts and ends at word ends; groups capture nothing. A keyword stands in everything
its pattern matches: where it is missing, the pattern is not tried. Levels go from 0, the
strongest, to 3: what lies within a match of the same or a stronger level is suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Places of these phrases are reported whatever else is found.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

_RULES = """
[0 1.0]
mit; spdx; spdx license identifier mit
mit-0; spdx; spdx license identifier mit 0
apache-2.0; spdx; spdx license identifier apache 2 0
apache-1.1; spdx; spdx license identifier apache 1 1
bsd-2-clause; spdx; spdx license identifier bsd 2 clause
bsd-3-clause; spdx; spdx license identifier bsd 3 clause
bsd-4-clause; spdx; spdx license identifier bsd 4 clause
0bsd; spdx; spdx license identifier 0bsd
gpl-2.0; spdx; spdx license identifier gpl 2 0( only| or later)?
gpl-3.0; spdx; spdx license identifier gpl 3 0( only| or later)?
lgpl-2.1; spdx; spdx license identifier lgpl 2 1( only| or later)?
lgpl-3.0; spdx; spdx license identifier lgpl 3 0( only| or later)?
agpl-3.0; spdx; spdx license identifier agpl 3 0( only| or later)?
mpl-2.0; spdx; spdx license identifier mpl 2 0
epl-1.0; spdx; spdx license identifier epl 1 0
epl-2.0; spdx; spdx license identifier epl 2 0
cddl-1.0; spdx; spdx license identifier cddl 1 0
isc; spdx; spdx license identifier isc
zlib; spdx; spdx license identifier zlib
bsl-1.0; spdx; spdx license identifier bsl 1 0
unlicense; spdx; spdx license identifier unlicense
wtfpl; spdx; spdx license identifier wtfpl
cc0-1.0; spdx; spdx license identifier cc0 1 0
cc-by-4.0; spdx; spdx license identifier cc by 4 0
cc-by-3.0; spdx; spdx license identifier cc by 3 0
cc-by-sa-4.0; spdx; spdx license identifier cc by sa 4 0
cc-by-sa-3.0; spdx; spdx license identifier cc by sa 3 0
cc-by-nc-4.0; spdx; spdx license identifier cc by nc 4 0
cc-by-nd-4.0; spdx; spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0; spdx; spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0; spdx; spdx license identifier cc by nc nd 4 0
artistic-2.0; spdx; spdx license identifier artistic 2 0
postgresql; spdx; spdx license identifier postgresql
python-2.0; spdx; spdx license identifier (python|psf) 2 0
eupl-1.2; spdx; spdx license identifier eupl 1 2
ofl-1.1; spdx; spdx license identifier ofl 1 1
ncsa; spdx; spdx license identifier ncsa
upl-1.0; spdx; spdx license identifier upl 1 0
ms-pl; spdx; spdx license identifier ms pl
odbl-1.0; spdx; spdx license identifier odbl 1 0
apache-2.0; apache; apache org licenses license 2 0
apache-1.1; apache; apache org licenses license 1 1
mit; opensource; opensource org licenses? mit
bsd-2-clause; opensource; opensource org licenses? bsd 2 clause
bsd-3-clause; opensource; opensource org licenses? bsd 3 clause
isc; opensource; opensource org licenses? isc
mpl-2.0; opensource; opensource org licenses? mpl 2 0
zlib; opensource; opensource org licenses? zlib
mpl-2.0; mozilla; mozilla org mpl 2 0
epl-1.0; eclipse; eclipse org legal epl v10
epl-2.0; eclipse; eclipse org legal epl (2 0|v20)
gpl-2.0; gnu; gnu org licenses (old licenses )?gpl 2 0
gpl-3.0; gnu; gnu org licenses gpl 3 0
lgpl-2.1; gnu; gnu org licenses (old licenses )?lgpl 2 1
lgpl-3.0; gnu; gnu org licenses lgpl 3 0
agpl-3.0; gnu; gnu org licenses agpl 3 0
gfdl-1.3; gnu; gnu org licenses fdl 1 3
cc0-1.0; creativecommons; creativecommons org publicdomain zero 1 0
public-domain; creativecommons; creativecommons org publicdomain mark 1 0
cc-by-4.0; creativecommons; creativecommons org licenses by 4 0
cc-by-3.0; creativecommons; creativecommons org licenses by 3 0
cc-by-2.5; creativecommons; creativecommons org licenses by 2 5
cc-by-2.0; creativecommons; creativecommons org licenses by 2 0
cc-by-sa-4.0; creativecommons; creativecommons org licenses by sa 4 0
cc-by-sa-3.0; creativecommons; creativecommons org licenses by sa 3 0
cc-by-nc-4.0; creativecommons; creativecommons org licenses by nc 4 0
cc-by-nc-3.0; creativecommons; creativecommons org licenses by nc 3 0
cc-by-nd-4.0; creativecommons; creativecommons org licenses by nd 4 0
cc-by-nd-3.0; creativecommons; creativecommons org licenses by nd 3 0
cc-by-nc-sa-4.0; creativecommons; creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0; creativecommons; creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0; creativecommons; creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0; creativecommons; creativecommons org licenses by nc nd 3 0
unlicense; unlicense; unlicense org
ofl-1.1; sil; scripts sil org ofl
wtfpl; wtfpl; wtfpl net
cc-by-4.0; cc by; cc by( version)? v?4( 0)?( international)?
cc-by-3.0; cc by; cc by( version)? v?3( 0)?( unported)?
cc-by-2.5; cc by; cc by( version)? v?2 5
cc-by-2.0; cc by; cc by( version)? v?2 0
cc-by-sa-4.0; cc by sa; cc by sa( version)? v?4( 0)?( international)?
cc-by-sa-3.0; cc by sa; cc by sa( version)? v?3( 0)?( unported)?
cc-by-sa-2.5; cc by sa; cc by sa( version)? v?2 5
cc-by-sa-2.0; cc by sa; cc by sa( version)? v?2 0
cc-by-nc-4.0; cc by nc; cc by nc( version)? v?4( 0)?( international)?
cc-by-nc-3.0; cc by nc; cc by nc( version)? v?3( 0)?( unported)?
cc-by-nc-2.0; cc by nc; cc by nc( version)? v?2 0
cc-by-nd-4.0; cc by nd; cc by nd( version)? v?4( 0)?( international)?
cc-by-nd-3.0; cc by nd; cc by nd( version)? v?3( 0)?( unported)?
cc-by-nc-sa-4.0; cc by nc sa; cc by nc sa( version)? v?4( 0)?( international)?
cc-by-nc-sa-3.0; cc by nc sa; cc by nc sa( version)? v?3( 0)?( unported)?
cc-by-nc-nd-4.0; cc by nc nd; cc by nc nd( version)? v?4( 0)?( international)?
cc-by-nc-nd-3.0; cc by nc nd; cc by nc nd( version)? v?3( 0)?( unported)?
cc0-1.0; cc0; cc0( version)? v?1( 0)?( universal)?
cc-by-4.0; attribution; creative commons attribution( license)?( version)? v?4( 0)?( international)?
cc-by-3.0; attribution; creative commons attribution( license)?( version)? v?3( 0)?( unported)?
cc-by-sa-4.0; attribution; creative commons attribution share ?alike( license)?( version)? v?4( 0)?
cc-by-sa-3.0; attribution; creative commons attribution share ?alike( license)?( version)? v?3( 0)?
cc-by-nc-4.0; attribution; creative commons attribution non ?commercial( license)?( version)? v?4( 0)?
cc-by-nc-3.0; attribution; creative commons attribution non ?commercial( license)?( version)? v?3( 0)?
cc-by-nd-4.0; attribution; creative commons attribution no ?deriv(s|atives)( license)?( version)? v?4( 0)?
cc-by-nc-sa-4.0; attribution; creative commons attribution non ?commercial share ?alike( license)?( version)? v?4( 0)?
cc-by-nc-nd-4.0; attribution; creative commons attribution non ?commercial no ?deriv(s|atives)( license)?( version)? v?4( 0)?
gpl-1.0; general public; gnu general public licen[sc]e( version)? v?1( 0)?
gpl-2.0; general public; gnu general public licen[sc]e( as published by the free software foundation)?( either)?( version)? v?2( 0)?( only| or( any)? later)?
gpl-3.0; general public; gnu general public licen[sc]e( as published by the free software foundation)?( either)?( version)? v?3( 0)?( only| or( any)? later)?
gpl-2.0; general public; version 2( 0)? of the gnu general public licen[sc]e
gpl-3.0; general public; version 3( 0)? of the gnu general public licen[sc]e
lgpl-2.0; library general; gnu library general public licen[sc]e( version)? v?2( 0)?
lgpl-2.1; lesser general; gnu lesser general public licen[sc]e( version)? v?2 1
lgpl-3.0; lesser general; gnu lesser general public licen[sc]e( version)? v?3( 0)?
agpl-3.0; affero; gnu affero general public licen[sc]e( version)? v?3( 0)?
gfdl-1.2; documentation; gnu free documentation licen[sc]e( version)? v?1 2
gfdl-1.3; documentation; gnu free documentation licen[sc]e( version)? v?1 3
apache-2.0; apache; apache( software)? licen[sc]e( version)? v?2( 0)?
apache-1.1; apache; apache( software)? licen[sc]e( version)? v?1 1
apache-1.0; apache; apache( software)? licen[sc]e( version)? v?1 0
mpl-2.0; mozilla; mozilla public licen[sc]e( version)? v?2( 0)?
mpl-1.1; mozilla; mozilla public licen[sc]e( version)? v?1 1
epl-2.0; eclipse; eclipse public licen[sc]e( version)? v?2( 0)?
epl-1.0; eclipse; eclipse public licen[sc]e( version)? v?1( 0)?
cddl-1.0; common development; common development and distribution licen[sc]e( version)? v?1 0
cddl-1.1; common development; common development and distribution licen[sc]e( version)? v?1 1
cpl-1.0; common public; common public licen[sc]e( version)? v?1( 0)?
eupl-1.1; european union; european union public licen[sc]e( version)? v?1 1
eupl-1.2; european union; european union public licen[sc]e( version)? v?1 2
ofl-1.1; open font; sil open font licen[sc]e( version)? v?1 1
bsl-1.0; boost; boost software licen[sc]e( version)? v?1( 0)?
artistic-1.0; artistic; artistic licen[sc]e( version)? v?1( 0)?
artistic-2.0; artistic; artistic licen[sc]e( version)? v?2( 0)?
afl-3.0; academic; academic free licen[sc]e( version)? v?3( 0)?
osl-3.0; open software; open software licen[sc]e( version)? v?3( 0)?
upl-1.0; universal permissive; universal permissive licen[sc]e( version)? v?1( 0)?
odbl-1.0; open database; open database licen[sc]e( version)? v?1( 0)?
odc-by-1.0; open data commons; open data commons attribution licen[sc]e( version)? v?1( 0)?
pddl-1.0; open data commons; open data commons public domain dedication
busl-1.1; business source; business source licen[sc]e( version)? v?1 1
sspl-1.0; server side; server side public licen[sc]e( version)? v?1( 0)?
elastic-2.0; elastic; elastic licen[sc]e( version)? v?2( 0)?
polyform; polyform; polyform (noncommercial|small business|shield|strict|perimeter) licen[sc]e( version)? 1 0 0
llama; llama; llama [23]( [0-9])? community licen[sc]e
openrail; openrail; (creativeml|bigscience|bigcode) openrail( m)?
openrail; open rail; (creativeml|bigscience|bigcode) open rail( m)?
mit; permission is hereby; permission is hereby granted free of charge to any person obtaining a copy of this software
isc; permission to use; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-2-clause; redistribution and use; redistribution and use in source and binary forms with or without modification are permitted
unlicense; unencumbered; this is free and unencumbered software released into the public domain
zlib; altered; altered source versions must be plainly marked as such
bsl-1.0; boost; distributed under the boost software license
wtfpl; do what the; do what the fuck you want to public licen[sc]e
beerware; beerware; the beerware licen[sc]e
bsd-3-clause; neither the name; neither the name of \\S+( \\S+)? nor the names of its contributors may be used
bsd-4-clause; advertising; all advertising materials mentioning features or use of this software
mpl-2.0; mozilla; this source code form is subject to the terms of the mozilla public license
gpl; free software you can; this program is free software you can redistribute it and or modify it
lgpl; free software you can; this library is free software you can redistribute it and or modify it
apache-2.0; express or implied; without warranties or conditions of any kind either express or implied
[1 0.9]
cc-by-sa; cc by sa; cc by sa
cc-by-nc; cc by nc; cc by nc
cc-by-nd; cc by nd; cc by nd
cc-by-nc-sa; cc by nc sa; cc by nc sa
cc-by-nc-nd; cc by nc nd; cc by nc nd
cc0; cc0; cc0
cc-by; attribution; creative commons attribution( licen[sc]e)?
cc-by-sa; attribution; creative commons attribution share ?alike( licen[sc]e)?
cc-by-nc; attribution; creative commons attribution non ?commercial( licen[sc]e)?
cc-by-nd; attribution; creative commons attribution no ?deriv(s|atives)( licen[sc]e)?
cc-by-nc-sa; attribution; creative commons attribution non ?commercial share ?alike( licen[sc]e)?
cc-by-nc-nd; attribution; creative commons attribution non ?commercial no ?deriv(s|atives)( licen[sc]e)?
cc0; creative commons; creative commons (zero|public domain dedication)
gpl; general public; gnu general public licen[sc]e
lgpl; lesser general; (gnu )?lesser general public licen[sc]e
lgpl; library general; (gnu )?library general public licen[sc]e
agpl; affero; (gnu )?affero general public licen[sc]e
gfdl; documentation; (gnu )?free documentation licen[sc]e
apache; apache; apache( software)? licen[sc]e
mit; mit; mit licen[sc]e
mit; mit; mit (style|type) licen[sc]e
mit; mit; licen[sc]ed under( the)? mit
mit; expat; expat licen[sc]e
x11; x11; x11 licen[sc]e
bsd; bsd; bsd licen[sc]e
bsd; bsd; bsd (style|type) licen[sc]e
bsd-2-clause; clause; (2|two) clause bsd( licen[sc]e)?
bsd-3-clause; clause; (3|three) clause bsd( licen[sc]e)?
bsd-4-clause; clause; (4|four) clause bsd( licen[sc]e)?
bsd-2-clause; clause; bsd (2|two) clause( licen[sc]e)?
bsd-3-clause; clause; bsd (3|three) clause( licen[sc]e)?
bsd-4-clause; clause; bsd (4|four) clause( licen[sc]e)?
bsd-2-clause; simplified; simplified bsd licen[sc]e
bsd-3-clause; bsd; (new|modified|revised) bsd licen[sc]e
bsd-4-clause; original; original bsd licen[sc]e
isc; isc; isc licen[sc]e
zlib; zlib; zlib( libpng)? licen[sc]e
libpng; libpng; libpng licen[sc]e
mpl; mozilla; mozilla public licen[sc]e
epl; eclipse; eclipse public licen[sc]e
cddl; common development; common development and distribution licen[sc]e
cpl; common public; common public licen[sc]e
eupl; european union; european union public licen[sc]e
ofl; open font; (sil )?open font licen[sc]e
bsl; boost; boost( software)? licen[sc]e
artistic; artistic; artistic licen[sc]e
afl; academic; academic free licen[sc]e
osl; open software; open software licen[sc]e
upl; universal permissive; universal permissive licen[sc]e
odbl; open database; open database licen[sc]e
odc-by; open data commons; open data commons attribution
unlicense; unlicense; (the )?unlicense
wtfpl; wtfpl; wtfpl
beerware; beer ware; beer ware licen[sc]e
python; python; python( software foundation)? licen[sc]e
psf; psf; psf licen[sc]e( agreement)?
php; php; php licen[sc]e
ruby; ruby; ruby licen[sc]e
perl; same terms as perl; (under )?the same terms as perl( itself)?
openssl; openssl; openssl licen[sc]e
postgresql; postgresql; postgresql licen[sc]e
curl; curl; curl licen[sc]e
ncsa; ncsa; (university of illinois )?ncsa( open source)? licen[sc]e
vim; vim; vim licen[sc]e
tex; latex; latex project public licen[sc]e
ms-pl; microsoft; microsoft public licen[sc]e
ms-rl; microsoft; microsoft reciprocal licen[sc]e
ibm; ibm; ibm public licen[sc]e
ipl; intel; intel open source licen[sc]e
apsl; apple; apple public source licen[sc]e
npl; netscape; netscape public licen[sc]e
qpl; q public; q public licen[sc]e
sun; sun; sun public licen[sc]e
w3c; w3c; w3c( software)?( notice and)? licen[sc]e
zpl; zope; zope public licen[sc]e
ecl; educational; educational community licen[sc]e
nasa; nasa; nasa open source agreement
cecill; cecill; cecill( [abc])?( licen[sc]e)?
etalab; ouverte; licence ouverte
dl-de; datenlizenz; datenlizenz deutschland
ogl; open government; open government licen[sc]e
bsl-source; business source; business source licen[sc]e
sspl; server side; server side public licen[sc]e
elastic; elastic; elastic licen[sc]e
commons-clause; commons clause; commons clause( licen[sc]e condition)?
rail; responsible ai; responsible ai licen[sc]e
gemma; gemma; gemma terms of use
llama; llama; llama community licen[sc]e
public-domain; public domain; (released|dedicated|placed) (in|in ?to|to) the public domain
public-domain; public domain; public domain dedication
[2 0.7]
agpl; agpl; agpl
gpl-2.0; gpl; gpl v?2( 0)?
gpl-3.0; gpl; gpl v?3( 0)?
gpl-2.0; gplv2; gplv2
gpl-3.0; gplv3; gplv3
lgpl-2.1; lgpl; lgpl v?2 1
lgpl-3.0; lgpl; lgpl v?3( 0)?
lgpl-3.0; lgplv3; lgplv3
agpl-3.0; agpl; agpl v?3( 0)?
agpl-3.0; agplv3; agplv3
gpl; gpl; gpl
lgpl; lgpl; lgpl
mpl-2.0; mpl; mpl v?2 0
epl-2.0; epl; epl v?2 0
apache-2.0; apache; apache v?2 0
cddl; cddl; cddl
eupl; eupl; eupl
ofl; sil; sil ofl
odbl; odbl; odbl
creative-commons; creative commons; creative commons( licen[sc]e)?
public-domain; public domain; public domain
copyleft; copyleft; copyleft
[3 0.4]
copyright; copyright; copyright( c| ©)?( 19[0-9][0-9]| 20[0-9][0-9])
copyright; copyrighted; copyrighted material
reserved; rights reserved; (some |certain )?rights reserved
proprietary; proprietary; proprietary and confidential
proprietary; proprietary; confidential and proprietary
proprietary; proprietary licen; proprietary licen[sc]e
no-redistribution; permission; (may|must) not be (reproduced|redistributed|copied)( or distributed)? without( prior)?( written)? permission
no-commercial; commercial; (for )?non ?commercial use only
eula; end user; end user licen[sc]e agreement
licensed; under; (licensed|released|distributed|available) under( the terms of)? (the|a|an) (following|same|above|accompanying|custom|commercial) licen[sc]e
licensed; terms of; subject to the terms of (the|this) licen[sc]e
licensed; licen; see (the )?(accompanying )?licen[sc]e( file)? for (details|more information)
no-warranty; warranty; without warranty of any kind
no-warranty; warranties; without warranties or conditions of any kind
"""

# A text that holds none of these holds no keyword of any rule.
ANCHORS = (
    "licen", "spdx", "copyright", "copyleft", "rights reserved", "cc0", " cc by", "gpl", "gnu",
    "creative commons", "creativecommons", "public domain", "wtfpl", "warrant", "proprietary",
    "commercial use", "permission", "redistribut", "contributors", "bsd", "altered source",
    "advertising materials", "mozilla org", "eclipse org", "sil o", " apache ", " mpl ", " epl ",
    "cddl", "eupl", "odbl", "open data commons", "cecill", "same terms as perl", "datenlizenz",
    "openrail", "open rail", "commons clause", "gemma terms", "nasa open", "openrailm",
    "unencumbered",
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    level: int
    weight: float
    base: bool = False


def spaced(words: str) -> str:
    """Words are stored as `` word `` each, so there are two spaces between two of them."""
    return re.sub(r"(?<=\S) (?=\S)", "  ", words)


def _regex(pattern: str) -> str:
    """`` ?`` is an optional step between words: one word or two."""
    marked = pattern.replace(" ?", "\0").replace("(", "(?:")
    return " " + marked.replace(" ", "  ").replace("\0", "(?:  )?") + " "


def rules() -> list[Rule]:
    """The base phrases, then the rules in their order."""
    out = [Rule(label, f" {spaced(p)} ", _regex(p), 3, 0.5, True) for p, label in BASE.items()]
    level, weight = 0, 0.0
    for line in _RULES.strip().split("\n"):
        if line.startswith("["):
            first, second = line.strip("[]").split()
            level, weight = int(first), float(second)
            continue
        label, keyword, pattern = line.split("; ", 2)
        out.append(Rule(label, spaced(keyword), _regex(pattern), level, weight))
    return out
