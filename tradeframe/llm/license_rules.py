"""Signatures of licences: rules in order, each a kind, a label, keywords and a regular expression over normalised words.

Text is matched as lower-case words between single spaces, so "CC-BY-SA 4.0" reads "cc by sa 4 0". A rule is tried only where
all of its keywords are: a keyword is a word, or a word's beginning where it ends in `*`. Names in braces stand for the
parts in PARTS."""

from __future__ import annotations

from typing import NamedTuple

#: Kinds from the strongest: name, and how sure a detection is. Base phrases are never suppressed.
KINDS = {"base": 0.9, "text": 0.99, "tag": 0.97, "notice": 0.9, "url": 0.85, "name": 0.7, "hint": 0.4}

PARTS = {
    "lic": "licen[sc]e",
    "under": "(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|shared|dual licen[sc]ed|free software)(?: [^ ]+){0,4}? (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?",
    "id": "spdx licen[sc]e identifier",
    "later": "(?:or later|or any later version|plus|or at your option any later version)",
    "site": "creativecommons org licenses",
}

RULES = r"""
base mit | mit licen* | under the mit license
base apache-2 | apache licen* | apache license version 2
base cc-by-nc | cc nc | cc by nc
text mit | permission* charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text mit | notice permission* | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
text mit-0 | permission* charge sublicen* | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
text isc | permission* fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
text 0bsd | permission* fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided
text hpnd | permission* fee | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
text bsd-2-clause | redistribution* binary | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
text bsd-3-clause | endorse* prior | neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
text bsd-3-clause-clear | patent* endorse* | no express or implied licenses to any party s patent rights are granted by this license
text bsd-4-clause | advertising acknowledg* | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
text bsd-1-clause | redistribution* disclaimer | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided
text apache-2 | apache compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at http(?:s)? www apache org licenses license 2 0
text apache-2 | licen* compliance | you may not use this file except in compliance with the license
text apache-2 | grant copyright perpetual | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
text apache-1.1 | apache acknowledg* | this product includes software developed by the apache software foundation
text gpl | gnu program warranty | this program is distributed in the hope that it will be useful but without any warranty
text gpl-2.0-or-later | gnu either | under the terms of the gnu general public {lic} as published by the free software foundation either version 2 of the {lic} or at your option any later version
text gpl-3.0-or-later | gnu either | under the terms of the gnu general public {lic} as published by the free software foundation either version 3 of the {lic} or at your option any later version
text gpl-2.0-only | gnu published | under the terms of the gnu general public {lic} (?:version 2 )?as published by the free software foundation version 2
text gpl-3.0-only | gnu published | under the terms of the gnu general public {lic} (?:version 3 )?as published by the free software foundation version 3
text lgpl-2.1-or-later | gnu lesser | under the terms of the gnu lesser general public {lic} as published by the free software foundation either version 2 1 of the {lic} or at your option any later version
text lgpl-3.0-or-later | gnu lesser | under the terms of the gnu lesser general public {lic} as published by the free software foundation either version 3 of the {lic} or at your option any later version
text lgpl-2.0-or-later | gnu library | under the terms of the gnu library general public {lic} as published by the free software foundation either version 2 of the {lic} or at your option any later version
text agpl-3.0-or-later | gnu affero | under the terms of the gnu affero general public {lic} as published by the free software foundation either version 3 of the {lic} or at your option any later version
text gfdl | gnu documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {lic}
text mpl-1.1 | mozilla contents | the contents of this file are subject to the mozilla public {lic} version 1 1
text mpl-2.0 | mozilla form | this source code form is subject to the terms of the mozilla public {lic} v(?:ersion)? ?2 0
text epl-1.0 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public {lic} v(?:ersion)? ?1 0
text epl-2.0 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public {lic} v? ?2 0
text cddl-1.0 | cddl contents | the contents of this file are subject to the terms of (?:either )?the common development and distribution {lic}
text zlib | altered misrepresented | this software is provided as is without any express or implied warranty in no event will the authors be held liable
text zlib | origin misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
text bsl-1.0 | boost execute | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
text unlicense | unencumbered | this is free and unencumbered software released into the public domain
text wtfpl | fuck | do what the fuck you want to(?: public {lic})?
text cc0-1.0 | waive* law* | to the extent possible under law(?: [^ ]+){1,12} (?:has|have) waived all copyright and related or neighbou?ring rights
text postgresql | postgresql permission* | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
text ncsa | illinois permission* | permission is hereby granted free of charge(?: [^ ]+){1,40} university of illinois
text ms-pl | microsoft patent* | this license governs use of the accompanying software if you use the software you accept this license
text artistic-2.0 | artistic package | this package is free software(?: [^ ]+){0,20} artistic {lic} 2 0
text proprietary | rights reserved | all rights reserved
text proprietary | confidential unauthori* | unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: [^ ]+){0,12} (?:strictly )?prohibited
text openrail | restriction* openrail | use based restrictions(?: [^ ]+){0,12} openrail
tag mit | spdx mit | {id} mit
tag mit-0 | spdx mit | {id} mit 0
tag apache-2 | spdx apache | {id} apache 2 0
tag apache-1.1 | spdx apache | {id} apache 1 1
tag apache-2-with-llvm-exception | spdx apache llvm | {id} apache 2 0 with llvm exception
tag bsd-2-clause | spdx bsd | {id} bsd 2 clause
tag bsd-3-clause | spdx bsd | {id} bsd 3 clause
tag bsd-4-clause | spdx bsd | {id} bsd 4 clause
tag 0bsd | spdx 0bsd | {id} 0bsd
tag isc | spdx isc | {id} isc
tag gpl-2.0-only | spdx gpl | {id} gpl 2 0(?: only)?
tag gpl-2.0-or-later | spdx gpl | {id} gpl 2 0 (?:or later|plus)
tag gpl-3.0-only | spdx gpl | {id} gpl 3 0(?: only)?
tag gpl-3.0-or-later | spdx gpl | {id} gpl 3 0 (?:or later|plus)
tag lgpl-2.1-only | spdx lgpl | {id} lgpl 2 1(?: only)?
tag lgpl-2.1-or-later | spdx lgpl | {id} lgpl 2 1 or later
tag lgpl-3.0-only | spdx lgpl | {id} lgpl 3 0(?: only)?
tag lgpl-3.0-or-later | spdx lgpl | {id} lgpl 3 0 or later
tag agpl-3.0-only | spdx agpl | {id} agpl 3 0(?: only)?
tag agpl-3.0-or-later | spdx agpl | {id} agpl 3 0 or later
tag mpl-1.1 | spdx mpl | {id} mpl 1 1
tag mpl-2.0 | spdx mpl | {id} mpl 2 0
tag epl-1.0 | spdx epl | {id} epl 1 0
tag epl-2.0 | spdx epl | {id} epl 2 0
tag eupl-1.2 | spdx eupl | {id} eupl 1 2
tag cddl-1.0 | spdx cddl | {id} cddl 1 0
tag zlib | spdx zlib | {id} zlib
tag bsl-1.0 | spdx bsl | {id} bsl 1 0
tag busl-1.1 | spdx busl | {id} busl 1 1
tag unlicense | spdx unlicense | {id} unlicense
tag wtfpl | spdx wtfpl | {id} wtfpl
tag cc0-1.0 | spdx cc0 | {id} cc0 1 0
tag cc-by-3.0 | spdx cc | {id} cc by 3 0
tag cc-by-4.0 | spdx cc | {id} cc by 4 0
tag cc-by-sa-3.0 | spdx cc sa | {id} cc by sa 3 0
tag cc-by-sa-4.0 | spdx cc sa | {id} cc by sa 4 0
tag cc-by-nd-4.0 | spdx cc nd | {id} cc by nd 4 0
tag cc-by-nc-4.0 | spdx cc nc | {id} cc by nc 4 0
tag cc-by-nc-sa-4.0 | spdx cc nc | {id} cc by nc sa 4 0
tag cc-by-nc-nd-4.0 | spdx cc nc | {id} cc by nc nd 4 0
tag artistic-2.0 | spdx artistic | {id} artistic 2 0
tag postgresql | spdx postgresql | {id} postgresql
tag python-2.0 | spdx python | {id} python 2 0
tag openssl | spdx openssl | {id} openssl
tag ofl-1.1 | spdx ofl | {id} ofl 1 1
tag ms-pl | spdx ms | {id} ms pl
tag blueoak-1.0.0 | spdx blueoak | {id} blueoak 1 0 0
tag upl-1.0 | spdx upl | {id} upl 1 0
tag vim | spdx vim | {id} vim
tag odbl-1.0 | spdx odbl | {id} odbl 1 0
notice mit | mit licen* | {under} mit (?:x11 )?{lic}
notice mit | mit licen* | mit {lic}(?: see| file| for details)
notice x11 | x11 licen* | {under} x11 {lic}
notice apache-2 | apache licen* | {under} apache(?: software)? {lic}(?: v?(?:ersion)? ?2(?: 0)?)
notice apache-1.1 | apache licen* | {under} apache(?: software)? {lic} v?(?:ersion)? ?1 1
notice bsd | bsd licen* | {under} bsd(?: style)? {lic}
notice bsd-2-clause | bsd clause | {under} (?:bsd 2 clause|2 clause bsd|simplified bsd)(?: {lic})?
notice bsd-3-clause | bsd clause | {under} (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: {lic})?
notice bsd-4-clause | bsd clause | {under} (?:bsd 4 clause|4 clause bsd|original bsd)(?: {lic})?
notice isc | isc licen* | {under} isc {lic}
notice gpl | gnu licen* | {under} gnu general public {lic}
notice gpl-1.0-only | gnu licen* | {under} gnu (?:general public {lic}|gpl) v?(?:ersion)? ?1(?: 0)?
notice gpl-2.0-only | gnu licen* | {under} gnu (?:general public {lic}|gpl) v?(?:ersion)? ?2(?: 0)?
notice gpl-2.0-or-later | gnu licen* later | {under} gnu (?:general public {lic}|gpl) v?(?:ersion)? ?2(?: 0)? {later}
notice gpl-3.0-only | gnu licen* | {under} gnu (?:general public {lic}|gpl) v?(?:ersion)? ?3(?: 0)?
notice gpl-3.0-or-later | gnu licen* later | {under} gnu (?:general public {lic}|gpl) v?(?:ersion)? ?3(?: 0)? {later}
notice gpl-2.0-only | gplv2 | {under} gplv2
notice gpl-3.0-only | gplv3 | {under} gplv3
notice lgpl | gnu lesser | {under} gnu lesser general public {lic}
notice lgpl-2.0-only | gnu library | {under} gnu library general public {lic}(?: v?(?:ersion)? ?2(?: 0)?)?
notice lgpl-2.1-only | gnu lesser | {under} gnu lesser general public {lic} v?(?:ersion)? ?2 1
notice lgpl-3.0-only | gnu lesser | {under} gnu lesser general public {lic} v?(?:ersion)? ?3(?: 0)?
notice agpl-3.0-only | gnu affero | {under} gnu affero general public {lic}(?: v?(?:ersion)? ?3(?: 0)?)?
notice agpl-3.0-or-later | gnu affero later | {under} gnu affero general public {lic} v?(?:ersion)? ?3(?: 0)? {later}
notice mpl-1.1 | mozilla licen* | {under} mozilla public {lic} v?(?:ersion)? ?1 1
notice mpl-2.0 | mozilla licen* | {under} mozilla public {lic}(?: v?(?:ersion)? ?2(?: 0)?)
notice epl-1.0 | eclipse licen* | {under} eclipse public {lic} v?(?:ersion)? ?1(?: 0)?
notice epl-2.0 | eclipse licen* | {under} eclipse public {lic} v?(?:ersion)? ?2(?: 0)?
notice eupl-1.2 | european licen* | {under} european union public {lic}(?: v?(?:ersion)? ?1 2)?
notice cddl-1.0 | cddl | {under} cddl(?: v?(?:ersion)? ?1 0)?
notice zlib | zlib licen* | {under} zlib(?: libpng)? {lic}
notice bsl-1.0 | boost licen* | {under} boost software {lic}(?: v?(?:ersion)? ?1 0)?
notice busl-1.1 | business licen* | {under} business source {lic}(?: v?(?:ersion)? ?1 1)?
notice elastic-2.0 | elastic licen* | {under} elastic {lic}(?: v?(?:ersion)? ?2(?: 0)?)?
notice sspl-1.0 | sspl | {under} (?:server side public {lic} )?sspl(?: v?(?:ersion)? ?1(?: 0)?)?
notice unlicense | unlicense | {under} unlicense
notice public-domain | public domain | (?:released|dedicated|placed|is|are|in) (?:in|into|to)? ?the public domain
notice cc0-1.0 | cc0 | {under} (?:creative commons )?cc0(?: 1 0)?(?: universal)?
notice cc-by | creative commons attribution | {under} creative commons attribution(?: international| unported)?(?: {lic})?
notice cc-by-2.0 | creative commons attribution | {under} creative commons attribution 2 0(?: generic)?(?: {lic})?
notice cc-by-3.0 | creative commons attribution | {under} creative commons attribution 3 0(?: unported)?(?: {lic})?
notice cc-by-4.0 | creative commons attribution | {under} creative commons attribution 4 0(?: international)?(?: {lic})?
notice cc-by-sa-3.0 | creative commons share* | {under} creative commons attribution share ?alike 3 0(?: unported)?(?: {lic})?
notice cc-by-sa-4.0 | creative commons share* | {under} creative commons attribution share ?alike 4 0(?: international)?(?: {lic})?
notice cc-by-nd-4.0 | creative commons deriv* | {under} creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: {lic})?
notice cc-by-nc | creative commons noncommercial | {under} creative commons attribution non ?commercial(?: {lic})?
notice cc-by-nc-4.0 | creative commons commercial | {under} creative commons attribution non commercial 4 0(?: international)?(?: {lic})?
notice cc-by-nc-4.0 | creative commons noncommercial | {under} creative commons attribution noncommercial 4 0(?: international)?(?: {lic})?
notice cc-by-nc-sa-4.0 | creative commons share* | {under} creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: {lic})?
notice cc-by-nc-nd-4.0 | creative commons deriv* | {under} creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: {lic})?
notice cc-by-4.0 | cc by | {under} cc by 4 0
notice cc-by-sa-4.0 | cc sa | {under} cc by sa 4 0
notice cc-by-nd-4.0 | cc nd | {under} cc by nd 4 0
notice cc-by-nc-4.0 | cc nc | {under} cc by nc 4 0
notice cc-by-nc-sa-4.0 | cc nc sa | {under} cc by nc sa 4 0
notice cc-by-nc-nd-4.0 | cc nc nd | {under} cc by nc nd 4 0
notice artistic-1.0 | artistic licen* | {under} artistic {lic}
notice artistic-2.0 | artistic licen* | {under} artistic {lic} 2 0
notice perl | perl itself | under the same terms as perl itself
notice python-2.0 | python software | {under} python software foundation {lic}
notice php-3.01 | php licen* | {under} php {lic}(?: v?(?:ersion)? ?3(?: 0?1)?)?
notice ruby | ruby licen* | {under} ruby(?: s)? {lic}
notice ofl-1.1 | sil font | {under} sil open font {lic}(?: v?(?:ersion)? ?1 1)?
notice ms-pl | microsoft public | {under} microsoft public {lic}
notice ms-rl | microsoft reciprocal | {under} microsoft reciprocal {lic}
notice wtfpl | wtfpl | {under} wtfpl
notice odbl-1.0 | open database | {under} open (?:data commons open )?database {lic}
notice odc-by-1.0 | commons attribution | {under} open data commons attribution {lic}
notice pddl-1.0 | domain dedication | {under} (?:open data commons )?public domain dedication and {lic}
notice ogl-3.0 | open government | {under} open government {lic}(?: v?(?:ersion)? ?3(?: 0)?)?
notice gfdl | gnu documentation | {under} gnu free documentation {lic}
notice llama2 | llama licen* | {under} llama 2 community {lic}
notice llama3 | llama licen* | {under} (?:meta )?llama 3(?: [0-9])? community {lic}
notice openrail | openrail | {under} (?:creativeml |bigscience |bigcode )?openrail(?: m)?
notice proprietary | proprietary licen* | {under} (?:a )?proprietary {lic}
notice noncommercial | commercial use | for non ?commercial use only
notice research-only | research purposes | for (?:academic )?research purposes only
url mit | opensource mit | opensource org licen[sc]es? mit(?: {lic})?
url bsd-2-clause | opensource bsd | opensource org licen[sc]es? bsd 2 clause
url bsd-3-clause | opensource bsd | opensource org licen[sc]es? bsd 3 clause
url isc | opensource isc | opensource org licen[sc]es? isc
url apache-2 | apache org licen* | apache org licenses license 2 0(?: txt| html)?
url apache-1.1 | apache org licen* | apache org licenses license 1 1(?: txt)?
url gpl | gnu org licen* | gnu org licenses(?: gpl(?: html| txt)?)?
url gpl-2.0-only | gnu org licen* | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
url gpl-3.0-only | gnu org licen* | gnu org licenses gpl 3 0(?: html| txt)?
url lgpl-2.1-only | gnu org licen* | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
url lgpl-3.0-only | gnu org licen* | gnu org licenses lgpl 3 0(?: html| txt)?
url agpl-3.0-only | gnu org licen* | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
url gfdl | gnu org licen* | gnu org licenses fdl(?: 1 3)?(?: html| txt)?
url mpl-2.0 | mozilla mpl | mozilla org (?:en us )?mpl 2 0
url mpl-1.1 | mozilla mpl | mozilla org (?:en us )?mpl (?:mpl )?1 1(?: html| txt)?
url epl-1.0 | eclipse org legal | eclipse org (?:org )?(?:documents|legal) epl v(?:10| ?1 0)(?: html)?
url epl-2.0 | eclipse org legal | eclipse org legal epl (?:2 0|v ?20?)(?: html)?
url bsl-1.0 | boost org | boost org license 1 0(?: txt)?
url unlicense | unlicense org | unlicense org
url wtfpl | wtfpl net | wtfpl net
url cc0-1.0 | creativecommons zero | creativecommons org publicdomain zero 1 0
url public-domain | creativecommons mark | creativecommons org publicdomain mark 1 0
url cc-by-2.0 | creativecommons licen* | {site} by 2 0
url cc-by-3.0 | creativecommons licen* | {site} by 3 0
url cc-by-4.0 | creativecommons licen* | {site} by 4 0
url cc-by-sa-2.0 | creativecommons licen* sa | {site} by sa 2 0
url cc-by-sa-3.0 | creativecommons licen* sa | {site} by sa 3 0
url cc-by-sa-4.0 | creativecommons licen* sa | {site} by sa 4 0
url cc-by-nd-4.0 | creativecommons licen* nd | {site} by nd 4 0
url cc-by-nc-3.0 | creativecommons licen* nc | {site} by nc 3 0
url cc-by-nc-4.0 | creativecommons licen* nc | {site} by nc 4 0
url cc-by-nc-sa-3.0 | creativecommons licen* nc | {site} by nc sa 3 0
url cc-by-nc-sa-4.0 | creativecommons licen* nc | {site} by nc sa 4 0
url cc-by-nc-nd-4.0 | creativecommons licen* nc | {site} by nc nd 4 0
url ofl-1.1 | scripts sil | scripts sil org ofl
url odbl-1.0 | opendatacommons odbl | opendatacommons org licenses odbl(?: 1 0)?
url odc-by-1.0 | opendatacommons by | opendatacommons org licenses by(?: 1 0)?
url ogl-3.0 | nationalarchives open | nationalarchives gov uk doc open government licence version 3
name mit | mit licen* | mit (?:x11 )?{lic}
name apache | apache licen* | apache(?: software)? {lic}
name apache-2 | apache licen* | apache(?: software)? {lic}(?: version)? 2(?: 0)?
name bsd-2-clause | bsd clause | (?:bsd 2 clause|2 clause bsd)(?: {lic})?
name bsd-3-clause | bsd clause | (?:bsd 3 clause|3 clause bsd)(?: {lic})?
name bsd | bsd licen* | bsd(?: style)? {lic}
name isc | isc licen* | isc {lic}
name gpl | gnu licen* | gnu general public {lic}
name gpl-2.0-only | gnu licen* | gnu general public {lic} v?(?:ersion)? ?2(?: 0)?
name gpl-3.0-only | gnu licen* | gnu general public {lic} v?(?:ersion)? ?3(?: 0)?
name lgpl | gnu lesser | gnu lesser general public {lic}
name agpl-3.0-only | gnu affero | gnu affero general public {lic}
name mpl-2.0 | mozilla licen* | mozilla public {lic}(?: version)? 2(?: 0)?
name mpl | mozilla licen* | mozilla public {lic}
name epl | eclipse licen* | eclipse public {lic}
name zlib | zlib licen* | zlib(?: libpng)? {lic}
name bsl-1.0 | boost licen* | boost software {lic}
name eupl | european licen* | european union public {lic}
name cddl-1.0 | distribution licen* development | common development and distribution {lic}
name gfdl | gnu documentation | gnu free documentation {lic}
name cc-by | creative commons attribution | creative commons attribution {lic}
name cc-by-sa | creative commons share* | creative commons attribution share ?alike
name cc-by-nc | creative commons commercial | creative commons attribution non commercial
name cc-by-nc | creative commons noncommercial | creative commons attribution noncommercial
name cc-by-4.0 | cc by | cc by 4 0
name cc-by-3.0 | cc by | cc by 3 0
name cc-by-sa-3.0 | cc sa | cc by sa 3 0
name cc-by-sa-4.0 | cc sa | cc by sa 4 0
name cc-by-nd-4.0 | cc nd | cc by nd 4 0
name cc-by-nc-3.0 | cc nc | cc by nc 3 0
name cc-by-nc-4.0 | cc nc | cc by nc 4 0
name cc-by-nc-sa-4.0 | cc nc sa | cc by nc sa 4 0
name cc-by-nc-nd-4.0 | cc nc nd | cc by nc nd 4 0
name cc0-1.0 | cc0 | cc0 1 0(?: universal)?
name artistic-2.0 | artistic licen* | artistic {lic} 2 0
name ofl-1.1 | sil font | sil open font {lic}
name odbl-1.0 | open database | open database {lic}
name sspl-1.0 | server side licen* | server side public {lic}
name wtfpl | wtfpl | wtfpl
name unlicense | unlicense | the unlicense
hint cc-by-sa | cc sa | cc by sa
hint cc-by-nd | cc nd | cc by nd
hint cc-by-nc-sa | cc nc sa | cc by nc sa
hint cc-by-nc-nd | cc nc nd | cc by nc nd
hint cc0-1.0 | cc0 | cc0
hint creative-commons | creative commons | creative commons(?: {lic})?
hint gpl-2.0-only | gplv2 | gplv2
hint gpl-3.0-only | gplv3 | gplv3
hint lgpl-2.1-only | lgplv2 | lgplv2 1
hint lgpl-3.0-only | lgplv3 | lgplv3
hint agpl-3.0-only | agplv3 | agplv3
hint mpl-2.0 | mplv2 | mplv2(?: 0)?
hint public-domain | public domain | public domain
hint proprietary | proprietary confidential | proprietary and confidential
hint openrail | openrail | openrail
"""


class Rule(NamedTuple):
    number: int
    level: int
    kind: str
    label: str
    keywords: tuple[str, ...]
    pattern: str


def _read(number: int, line: str) -> Rule:
    head, keywords, pattern = (x.strip() for x in line.split(" | "))
    kind, label = head.split()
    for name, part in PARTS.items():
        pattern = pattern.replace("{" + name + "}", part)
    return Rule(number, list(KINDS).index(kind), kind, label, tuple(keywords.split()), f"(?<= )(?:{pattern})(?= )")


def rules(text: str = RULES) -> list[Rule]:
    return [_read(i, line) for i, line in enumerate(text.strip().splitlines())]


def keyword_pattern(of: list[Rule]) -> str:
    """Finds each keyword of rules at a word's beginning."""
    words = sorted({k for r in of for k in r.keywords})
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:-1] if w.endswith("*") else w[1:] + "(?= )")
    return "(?<= )(?:" + "|".join(f"{h}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for h, rest in heads.items()) + ")"
