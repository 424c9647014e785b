"""License scans: ordered signature rules over the words of a text.

A rule is (priority, label, regex over space-joined words, gate words, weight). A rule runs only if the text has one of its
gate words. Detections are then taken by priority, longest first; one that lies within
a detection already taken is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwright.llm._common import only, small_batches

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Bytes that separate words; A-Z become a-z.
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

# Families by hand: label, the name's pattern (words joined by one space), gate words, weight of a bare name.
# In a pattern "@" stands for a version such as "2", "2 0" or "v2 0"; special families come before general ones.
VERSION = r"(?:version |v )?v?\d+(?: \d+)*"
FAMILIES: list[tuple[str, str, str, float]] = [
    ("agpl", r"gnu affero general public licen[sc]e|affero gpl|agpl", "affero agpl", 0.9),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e|lgpl", "lesser library lgpl", 0.9),
    ("gfdl", r"gnu free documentation licen[sc]e|gfdl", "documentation gfdl", 0.9),
    ("gpl", r"gnu general public licen[sc]e|gnu gpl|gpl licen[sc]e", "gnu gpl", 0.9),
    ("apache", r"apache (?:software )?licen[sc]e|apache 2 0", "apache", 0.9),
    ("mit", r"mit(?: x11)? licen[sc]e|mit x11", "mit", 0.9),
    ("x11", r"x11 licen[sc]e|x consortium licen[sc]e", "x11 consortium", 0.8),
    ("bsd-2-clause", r"(?:simplified bsd|bsd 2 clause|freebsd|2 clause bsd) licen[sc]e", "bsd freebsd", 0.9),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[sc]e", "bsd", 0.9),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd) licen[sc]e", "bsd", 0.9),
    ("0bsd", r"(?:zero clause bsd|0bsd|bsd 0 clause)(?: licen[sc]e)?", "bsd 0bsd", 0.9),
    ("bsd", r"bsd (?:style )?licen[sc]e", "bsd", 0.8),
    ("mpl", r"mozilla public licen[sc]e|mpl @", "mozilla mpl", 0.9),
    ("epl", r"eclipse public licen[sc]e|epl @", "eclipse epl", 0.9),
    ("edl", r"eclipse distribution licen[sc]e", "eclipse", 0.9),
    ("cpl", r"common public licen[sc]e", "common", 0.8),
    ("cddl", r"common development and distribution licen[sc]e|cddl", "common cddl", 0.9),
    ("cpal", r"common public attribution licen[sc]e", "common", 0.9),
    ("eupl", r"european union public licen[sc]e|eupl", "european eupl", 0.9),
    ("isc", r"isc licen[sc]e", "isc", 0.9),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", "zlib", 0.9),
    ("libpng", r"libpng licen[sc]e", "libpng", 0.9),
    ("boost", r"boost software licen[sc]e", "boost", 0.9),
    ("artistic", r"(?:perl )?artistic licen[sc]e", "artistic", 0.9),
    ("unlicense", r"the unlicense|unlicense org", "unlicense", 0.9),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[sc]e", "wtfpl fuck", 0.9),
    ("cc0", r"cc0|creative commons zero|cc zero", "cc0 zero", 0.9),
    ("cc-by-nc-nd", r"(?:cc by|creative commons attribution) (?:nc|non ?commercial) (?:nd|no deriv(?:ative)?s?(?: works)?)", "cc creative", 0.95),
    ("cc-by-nc-sa", r"(?:cc by|creative commons attribution) (?:nc|non ?commercial) (?:sa|share ?alike)", "cc creative", 0.95),
    ("cc-by-nd", r"(?:cc by|creative commons attribution) (?:nd|no deriv(?:ative)?s?(?: works)?)", "cc creative", 0.95),
    ("cc-by-nc", r"(?:cc by|creative commons attribution) (?:nc|non ?commercial)", "cc creative", 0.95),
    ("cc-by-sa", r"(?:cc by|creative commons attribution) (?:sa|share ?alike)", "cc creative", 0.95),
    ("cc-by", r"cc by|creative commons attribution", "cc creative", 0.8),
    ("cc", r"creative commons(?: public)? licen[sc]e", "creative", 0.7),
    ("public-domain", r"(?:in|into|to) the public domain", "domain", 0.7),
    ("python", r"(?:python software foundation|psf) licen[sc]e|python licen[sc]e", "python psf", 0.9),
    ("php", r"php licen[sc]e", "php", 0.9),
    ("ruby", r"ruby(?: s)? licen[sc]e", "ruby", 0.8),
    ("postgresql", r"postgresql licen[sc]e", "postgresql", 0.9),
    ("openssl", r"openssl(?: ssleay)? licen[sc]e", "openssl", 0.9),
    ("w3c", r"w3c software(?: and document)?(?: notice and)? licen[sc]e", "w3c", 0.9),
    ("unicode", r"unicode(?: data files)? licen[sc]e", "unicode", 0.8),
    ("icu", r"icu licen[sc]e", "icu", 0.9),
    ("curl", r"curl licen[sc]e", "curl", 0.8),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", "ncsa", 0.9),
    ("intel", r"intel (?:open source|simplified software) licen[sc]e", "intel", 0.9),
    ("ms-pl", r"microsoft public licen[sc]e|ms pl", "microsoft ms", 0.8),
    ("ms-rl", r"microsoft reciprocal licen[sc]e|ms rl", "microsoft ms", 0.8),
    ("osl", r"open software licen[sc]e", "software", 0.8),
    ("afl", r"academic free licen[sc]e", "academic", 0.9),
    ("ecl", r"educational community licen[sc]e", "educational", 0.9),
    ("odbl", r"open (?:data commons )?(?:open )?database licen[sc]e|odbl", "database odbl", 0.9),
    ("odc-by", r"open data commons attribution licen[sc]e|odc by", "commons odc", 0.9),
    ("pddl", r"public domain dedication and licen[sc]e|pddl", "dedication pddl", 0.9),
    ("ofl", r"(?:sil )?open font licen[sc]e|sil ofl", "font ofl", 0.9),
    ("upl", r"universal permissive licen[sc]e", "universal", 0.9),
    ("bsl", r"business source licen[sc]e", "business", 0.9),
    ("sspl", r"server side public licen[sc]e|sspl", "server sspl", 0.9),
    ("elastic", r"elastic licen[sc]e", "elastic", 0.9),
    ("openrail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[sc]e)?", "openrail rail", 0.9),
    ("llvm-exception", r"llvm exceptions?", "llvm", 0.9),
    ("classpath-exception", r"classpath exception", "classpath", 0.9),
    ("sleepycat", r"sleepycat licen[sc]e", "sleepycat", 0.9),
    ("zope", r"zope public licen[sc]e", "zope", 0.9),
    ("vim", r"vim licen[sc]e", "vim", 0.8),
    ("tex", r"latex project public licen[sc]e|lppl", "latex lppl", 0.9),
    ("blueoak", r"blue oak model licen[sc]e", "oak", 0.9),
    ("mulan", r"mulan (?:psl|permissive software licen[sc]e)", "mulan", 0.9),
    ("hippocratic", r"hippocratic licen[sc]e", "hippocratic", 0.9),
    ("beerware", r"beer ?ware licen[sc]e", "beerware beer", 0.9),
]
# Forms by hand: what may stand around a name, in order of priority; "%" is the name.
FORMS: list[tuple[str, float]] = [
    (r"(?:is |are |be |been )?(?:released|distributed|published|licen[sc]ed|made available|provided|available|shared) under (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?(?:%)(?: licen[sc]e)?(?: @)?", 0.3),
    (r"(?:subject to|governed by|covered by|dual licen[sc]ed under) (?:the )?(?:terms of )?(?:the )?(?:%)(?: licen[sc]e)?(?: @)?", 0.3),
    (r"(?:spdx )?licen[sc]e identifier (?:%)(?: @)?(?: only| or later)?", 0.4),
    (r"(?:%)(?: licen[sc]e)? @(?: or (?:any )?later(?: version)?| only)?", 0.2),
    (r"(?:%)", 0.0),
]
# Short names by hand: label, pattern, gate words. They count only where the words before say that they name a license.
SHORT: list[tuple[str, str, str]] = [
    ("agpl", r"agpl(?:v?3)?(?: @)?", "agpl agplv3 agpl3"),
    ("lgpl", r"(?:gnu )?lgpl(?:v?\d)?(?: @)?", "lgpl lgplv2 lgplv3 lgpl2 lgpl3"),
    ("gpl", r"(?:gnu )?gpl(?:v?\d)?(?: @)?", "gpl gplv1 gplv2 gplv3 gpl2 gpl3"),
    ("apache", r"apache(?: licen[sc]e)?(?: @)?|al2|asl 2 0", "apache al2 asl"),
    ("mit", r"mit|expat", "mit expat"),
    ("x11", r"x11", "x11"),
    ("0bsd", r"0bsd", "0bsd"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|bsd2|simplified bsd)", "bsd bsd2"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|bsd3|new bsd|modified bsd)", "bsd bsd3"),
    ("bsd", r"bsd", "bsd"),
    ("isc", r"isc", "isc"),
    ("zlib", r"zlib(?: libpng)?", "zlib"),
    ("mpl", r"mpl(?:v?\d)?(?: @)?", "mpl mplv1 mplv2 mpl2"),
    ("epl", r"epl(?: @)?", "epl"),
    ("cddl", r"cddl(?: @)?", "cddl"),
    ("eupl", r"eupl(?: @)?", "eupl"),
    ("boost", r"(?:boost|bsl 1 0)", "boost bsl"),
    ("artistic", r"artistic(?: @)?", "artistic"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", r"wtfpl", "wtfpl"),
    ("cc0", r"cc0(?: @)?", "cc0"),
    ("cc-by-nc-nd", r"cc by nc nd(?: @)?", "cc"),
    ("cc-by-nc-sa", r"cc by nc sa(?: @)?", "cc"),
    ("cc-by-nd", r"cc by nd(?: @)?", "cc"),
    ("cc-by-nc", r"cc by nc(?: @)?", "cc"),
    ("cc-by-sa", r"cc by sa(?: @)?", "cc"),
    ("ofl", r"ofl(?: @)?", "ofl"),
    ("ncsa", r"ncsa", "ncsa"),
    ("psf", r"psf(?: @)?", "psf"),
    ("postgresql", r"postgresql", "postgresql"),
    ("sspl", r"sspl(?:v1)?(?: @)?", "sspl sspl1"),
    ("upl", r"upl(?: @)?", "upl"),
    ("odbl", r"odbl(?: @)?", "odbl"),
    ("public-domain", r"public domain", "domain"),
]
# What may stand before (and after) a short name, by hand.
SHORT_FORMS: list[tuple[str, float]] = [
    (r"(?:dual |multi )?(?:licen[sc]ed|released|distributed|available|published|provided|offered|shared|covered) (?:both )?(?:under|by|with|as)(?: the)?(?: terms of)?(?: the)?(?: conditions of)?(?: the)? (?:%)(?: licen[sc]e)?(?: only| or (?:any )?later(?: versions?)?)?", 0.85),
    (r"(?:terms|conditions) of (?:the )?(?:%)(?: licen[sc]e)?(?: only| or (?:any )?later(?: versions?)?)?", 0.8),
    (r"licen[sc]es? (?:is |are |name |type |file |text |identifier )?(?:the )?(?:%)(?: only| or (?:any )?later(?: versions?)?)?", 0.7),
    (r"(?:copying|copyright|see) (?:under |the )?(?:%) licen[sc]e", 0.7),
]
# License list identifiers (words joined by one space, as they stand after "SPDX-License-Identifier:") and their labels, by hand; longer ones first where one begins another.
SPDX: list[tuple[str, str]] = [
    ("agpl 3 0 or later", "agpl"), ("agpl 3 0 only", "agpl"), ("agpl 3 0", "agpl"), ("agpl 1 0", "agpl"),
    ("lgpl 2 0 or later", "lgpl"), ("lgpl 2 0 only", "lgpl"), ("lgpl 2 1 or later", "lgpl"), ("lgpl 2 1 only", "lgpl"), ("lgpl 3 0 or later", "lgpl"), ("lgpl 3 0 only", "lgpl"), ("lgpl 2 1", "lgpl"), ("lgpl 3 0", "lgpl"), ("lgpl 2 0", "lgpl"),
    ("gpl 1 0 or later", "gpl"), ("gpl 1 0 only", "gpl"), ("gpl 2 0 or later", "gpl"), ("gpl 2 0 only", "gpl"), ("gpl 3 0 or later", "gpl"), ("gpl 3 0 only", "gpl"), ("gpl 2 0", "gpl"), ("gpl 3 0", "gpl"), ("gpl 1 0", "gpl"),
    ("gfdl 1 1 or later", "gfdl"), ("gfdl 1 2 or later", "gfdl"), ("gfdl 1 3 or later", "gfdl"), ("gfdl 1 3 only", "gfdl"), ("gfdl 1 3", "gfdl"),
    ("apache 1 0", "apache"), ("apache 1 1", "apache"), ("apache 2 0", "apache"),
    ("mit 0", "mit-0"), ("mit cmu", "mit"), ("mit modern variant", "mit"), ("mit", "mit"), ("x11", "x11"),
    ("bsd 1 clause", "bsd"), ("bsd 2 clause patent", "bsd-2-clause"), ("bsd 2 clause", "bsd-2-clause"), ("bsd 3 clause clear", "bsd-3-clause"), ("bsd 3 clause", "bsd-3-clause"), ("bsd 4 clause", "bsd-4-clause"), ("0bsd", "0bsd"),
    ("mpl 1 0", "mpl"), ("mpl 1 1", "mpl"), ("mpl 2 0 no copyleft exception", "mpl"), ("mpl 2 0", "mpl"), ("epl 1 0", "epl"), ("epl 2 0", "epl"), ("cpl 1 0", "cpl"), ("cddl 1 0", "cddl"), ("cddl 1 1", "cddl"), ("cpal 1 0", "cpal"),
    ("eupl 1 0", "eupl"), ("eupl 1 1", "eupl"), ("eupl 1 2", "eupl"), ("isc", "isc"), ("zlib acknowledgement", "zlib"), ("zlib", "zlib"), ("libpng 2 0", "libpng"), ("libpng", "libpng"), ("bsl 1 0", "boost"), ("busl 1 1", "bsl"),
    ("artistic 1 0 perl", "artistic"), ("artistic 1 0", "artistic"), ("artistic 2 0", "artistic"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("cc0 1 0", "cc0"),
    ("cc by nc nd 4 0", "cc-by-nc-nd"), ("cc by nc nd 3 0", "cc-by-nc-nd"), ("cc by nc sa 4 0", "cc-by-nc-sa"), ("cc by nc sa 3 0", "cc-by-nc-sa"), ("cc by nd 4 0", "cc-by-nd"), ("cc by nc 4 0", "cc-by-nc"), ("cc by sa 4 0", "cc-by-sa"), ("cc by sa 3 0", "cc-by-sa"), ("cc by 4 0", "cc-by"), ("cc by 3 0", "cc-by"),
    ("psf 2 0", "python"), ("python 2 0", "python"), ("php 3 01", "php"), ("ruby", "ruby"), ("postgresql", "postgresql"), ("openssl", "openssl"), ("w3c", "w3c"), ("unicode dfs 2016", "unicode"), ("unicode 3 0", "unicode"), ("icu", "icu"), ("curl", "curl"), ("ncsa", "ncsa"), ("intel", "intel"),
    ("ms pl", "ms-pl"), ("ms rl", "ms-rl"), ("osl 3 0", "osl"), ("afl 2 1", "afl"), ("afl 3 0", "afl"), ("ecl 2 0", "ecl"), ("odbl 1 0", "odbl"), ("odc by 1 0", "odc-by"), ("pddl 1 0", "pddl"), ("ofl 1 1", "ofl"), ("upl 1 0", "upl"), ("sspl 1 0", "sspl"), ("elastic 2 0", "elastic"),
    ("sleepycat", "sleepycat"), ("zpl 2 1", "zope"), ("vim", "vim"), ("lppl 1 3c", "tex"), ("blueoak 1 0 0", "blueoak"), ("mulanpsl 2 0", "mulan"), ("hippocratic 2 1", "hippocratic"), ("beerware", "beerware"), ("hpnd", "hpnd"), ("fsfap", "fsfap"), ("tcl", "tcl"), ("ijg", "ijg"), ("ftl", "freetype"), ("json", "json"),
]
# Whole notices and clauses, by hand: label, pattern, gate words, weight.
NOTICES: list[tuple[str, str, str, float]] = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby", 0.95),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial", 0.9),
    ("mit", r"the software is provided as is without warranty of any kind express or implied", "implied", 0.7),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "sublicense", 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee", "permission", 0.95),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose", "documentation", 0.85),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions", "redistributions", 0.85),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", 0.85),
    ("bsd-3-clause", r"neither the name of .{1,120}? nor the names of its contributors may be used", "neither", 0.9),
    ("bsd-3-clause", r"the names? of (?:the |its )?(?:author|contributors?|copyright holders?) may not be used to endorse or promote products", "endorse", 0.85),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising", 0.9),
    ("bsd-2-clause", r"the views and conclusions contained in the software and documentation are those of the authors", "conclusions", 0.8),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute", 0.98),
    ("gpl", r"you should have received a copy of the gnu general public license along with", "received", 0.95),
    ("gpl", r"the licenses for most software are designed to take away your freedom", "freedom", 0.9),
    ("gpl", r"when we speak of free software we are referring to freedom not price", "freedom", 0.85),
    ("gpl", r"either version \d(?: 0)? of the license or at your option any later version", "option", 0.6),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim", 0.9),
    ("lgpl", r"this library is free software you can redistribute it and or modify", "redistribute", 0.9),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", "received", 0.95),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with", "received", 0.95),
    ("agpl", r"remote network interaction use with the gnu general public license", "remote", 0.9),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "document", 0.97),
    ("gfdl", r"with no invariant sections(?: with)? no front cover texts", "invariant", 0.9),
    ("apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "compliance", 0.98),
    ("apache", r"you may obtain a copy of the license at https? www apache org licenses license 2 0", "obtain", 0.95),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "writing", 0.9),
    ("apache", r"this product includes software developed (?:by|at) the apache software foundation", "foundation", 0.85),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", "subject", 0.97),
    ("mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", "mpl", 0.95),
    ("mpl", r"the contents of this file are subject to the mozilla public license", "contents", 0.95),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying", 0.97),
    ("edl", r"this program and the accompanying materials are made available under the terms of the eclipse distribution license", "accompanying", 0.97),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "contents", 0.95),
    ("cpl", r"the accompanying program is provided under the terms of this common public license", "accompanying", 0.9),
    ("eupl", r"licensed under the eupl version 1 \d or as soon they will be approved", "eupl", 0.95),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors", "warranty", 0.9),
    ("zlib", r"altered source versions must be plainly marked as such", "altered", 0.9),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented", 0.9),
    ("libpng", r"the png reference library is supplied as is", "png", 0.9),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 0.98),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "compile", 0.9),
    ("boost", r"to use reproduce display distribute execute and transmit the software", "reproduce", 0.9),
    ("boost", r"distributed under the boost software license version 1 0 see accompanying file", "boost", 0.95),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies", "verbatim", 0.8),
    ("wtfpl", r"you just do what the fuck you want to", "fuck", 0.9),
    ("beerware", r"you can buy me a beer in return", "beer", 0.9),
    ("cc0", r"to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights", "waived", 0.95),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", "deed", 0.9),
    ("cc-by-sa", r"creativecommons org licenses by sa", "creativecommons", 0.95),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd", "creativecommons", 0.95),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa", "creativecommons", 0.95),
    ("cc-by-nd", r"creativecommons org licenses by nd", "creativecommons", 0.95),
    ("cc-by-nc", r"creativecommons org licenses by nc", "creativecommons", 0.95),
    ("cc-by", r"creativecommons org licenses by", "creativecommons", 0.9),
    ("cc0", r"creativecommons org publicdomain zero", "creativecommons", 0.95),
    ("ofl", r"this font software is licensed under the sil open font license", "font", 0.97),
    ("ofl", r"reserved font name", "font", 0.7),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "package", 0.9),
    ("artistic", r"you can redistribute it and or modify it under the same terms as perl itself", "perl", 0.9),
    ("python", r"this license agreement is between the python software foundation psf and the individual or organization", "python", 0.95),
    ("php", r"this product includes php software freely available from", "php", 0.9),
    ("ruby", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl", "bsdl", 0.9),
    ("openssl", r"this product includes software developed by the openssl project", "openssl", 0.95),
    ("openssl", r"this product includes cryptographic software written by eric young", "cryptographic", 0.9),
    ("w3c", r"by obtaining and or copying this work you the licensee agree that you have read understood and will comply", "licensee", 0.9),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode", 0.97),
    ("freetype", r"portions of this software are copyright .{1,60}? the freetype project", "freetype", 0.9),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg", 0.95),
    ("json", r"the software shall be used for good not evil", "evil", 0.95),
    ("fsfap", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", "royalty", 0.95),
    ("ncsa", r"this list of conditions and the following disclaimers", "disclaimers", 0.8),
    ("ms-pl", r"this license governs use of the accompanying software if you use the software you accept this license", "governs", 0.85),
    ("osl", r"licensed under the open software license version", "open", 0.95),
    ("afl", r"licensed under the academic free license version", "academic", 0.95),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents license", "database", 0.9),
    ("openrail", r"use based restrictions as referenced in (?:paragraph|attachment)", "restrictions", 0.85),
    ("sspl", r"offering the program as a service", "service", 0.5),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", "hosted", 0.9),
    ("bsl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "licensor", 0.9),
    ("commons-clause", r"the software is provided to you by the licensor under the license as defined below subject to the following condition", "licensor", 0.9),
    ("hippocratic", r"human rights laws", "human", 0.3),
    ("proprietary", r"all rights reserved", "reserved", 0.4),
    ("proprietary", r"(?:unauthori[sz]ed|no) (?:copying|reproduction|redistribution) .{0,80}?(?:prohibited|permitted)", "copying reproduction redistribution", 0.5),
    ("proprietary", r"confidential and proprietary", "proprietary", 0.5),
    ("proprietary", r"trade secrets? (?:of|and)", "trade", 0.4),
    ("proprietary", r"may not be (?:copied|reproduced|disclosed|distributed) .{0,80}?without (?:the )?(?:prior |express )?written (?:permission|consent)", "written", 0.5),
    ("proprietary", r"for internal use only", "internal", 0.4),
    ("proprietary", r"end user licen[sc]e agreement", "agreement", 0.6),
    ("proprietary", r"by (?:installing|downloading|using) (?:this|the) software you (?:agree|accept)", "installing downloading using", 0.5),
    ("non-commercial", r"for non ?commercial (?:use|purposes) only|non ?commercial use only", "commercial noncommercial", 0.5),
    ("research-only", r"for (?:academic|research) (?:use|purposes) only", "academic research", 0.5),
    ("disclaimer", r"without warranties or conditions of any kind|without warranty of any kind", "warranty warranties", 0.4),
    ("disclaimer", r"without even the implied warranty of merchantability", "merchantability", 0.4),
    ("disclaimer", r"in no event shall the (?:authors?|copyright holders?|copyright owner)(?: or copyright holders?| or contributors)? be liable", "liable", 0.5),
    ("copyright", r"copyright (?:c )?\d{4}(?: \d{4})?", "copyright", 0.4),
]


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    regex: re.Pattern[bytes]
    gates: frozenset[bytes]
    weight: float


def rules() -> list[Rule]:
    """All rules in order: notices, identifiers, each form of each family and then of each short name; all are listed from the special to the general."""
    found = []

    def add(label, pattern, gates, weight):
        text = pattern.replace("@", VERSION)
        found.append(Rule(len(found), label, re.compile(rf"(?<= )(?:{text})(?= )".encode()), frozenset(gates.encode().split()), min(weight, 1.0)))

    for label, pattern, gates, weight in NOTICES:
        add(label, pattern, gates, weight)
    for words, label in SPDX:
        add(label, rf"(?:spdx )?licen[sc]e identifier (?:[a-z0-9 ]{{1,60}}? (?:or|and|with) )?{words}", "identifier", 0.98)
    for form, more in FORMS[:-1]:
        for label, name, gates, weight in FAMILIES:
            add(label, form.replace("%", name), gates, weight + more * (1 - weight))
    for form, weight in SHORT_FORMS:
        for label, name, gates in SHORT:
            add(label, form.replace("%", name), gates, weight)
    for label, name, gates, weight in FAMILIES:
        add(label, FORMS[-1][0].replace("%", name), gates, weight)
    return found


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) that stay: by priority, then longest, then first; none lies within one already taken.

    A tree over the starts holds the furthest end of the detections taken up to each, so that n detections take n log n steps.
    """
    starts = sorted({a for a, _, _ in found})
    place = {a: k + 1 for k, a in enumerate(starts)}
    reach = [-1] * (len(starts) + 1)
    taken: list[tuple[int, int, Rule]] = []
    for a, b, r in sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0])):
        k, furthest = place[a], -1
        while k:
            furthest = max(furthest, reach[k])
            k &= k - 1
        if furthest >= b:
            continue
        k = place[a]
        while k < len(reach):
            reach[k] = max(reach[k], b)
            k += k & -k
        taken.append((a, b, r))
    return sorted(taken, key=lambda x: x[:2])


class Scanner:
    def __init__(self, base: dict[str, str] = BASE):
        self.rules = rules()
        by_gate: dict[bytes, list[Rule]] = {}
        for r in self.rules:
            for g in r.gates:
                by_gate.setdefault(g, []).append(r)
        self.by_gate, self.gates = by_gate, frozenset(by_gate)
        self.base = [(f" {p} ".encode(), label, p.split()[0].encode()) for p, label in base.items()]
        self.base_first = frozenset(first for _, _, first in self.base)

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, Rule]]]:
        """(number of words, places of base phrases by their first word, detections by words)."""
        words = words_of(text)
        gates = self.gates.intersection(words)
        firsts = self.base_first.intersection(words)
        if not gates and not firsts:
            return len(words), [], []
        line = b" " + b" ".join(words) + b" "
        at, owner = [], []
        for phrase, label, first in self.base:
            if first in firsts:
                k = line.find(phrase)
                while k >= 0:
                    at.append(k)
                    owner.append(label)
                    k = line.find(phrase, k + 1)
        found = []
        for r in {r.priority: r for g in gates for r in self.by_gate[g]}.values():
            found += [(m.start(), m.end(), r) for m in r.regex.finditer(line)]
        if not at and not found:
            return len(words), [], []
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)  # a word starts after the space of its number
        places = sorted(zip(np.searchsorted(spaces, at).tolist(), owner, strict=True))
        kept = suppress(found)
        first, last = (np.searchsorted(spaces, [k[e] - d for k in kept]).tolist() for e, d in ((0, 1), (1, 0)))
        return len(words), places, [(a, b, r) for a, b, (_, _, r) in zip(first, last, kept, strict=True)]


_scanner: list[Scanner] = []

SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,stop:long,rule:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _scanner:
        _scanner.append(Scanner())
    s = _scanner[0]
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("rule", pa.int32())]))
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            n, places, kept = s.scan(text)
            base = {label for _, label in places}
            miss = 1.0
            for _, _, r in kept:
                miss *= 1 - r.weight
            for _ in places:
                miss *= 0.2
            rows.append((n, len(places), places[0][0] if places else None, places[-1][0] if places else None,
                         ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in kept})), 1 - miss,
                         [{"label": r.label, "start": a, "stop": e, "rule": r.priority} for a, e, r in kept]))
        col = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(col, kinds, strict=True))],
                                         names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: word and base phrase counts, labels, a score, and the detections (word spans).

    Null text is empty: no words, empty label strings, null first_word and last_word, score 0. Repeated
    rows and null ids each give a row; other columns are ignored. One map over whole texts, no shuffle.
    """
    small_batches(docs.sparkSession)
    d = only(docs, doc_id=id_col, text=text_col)
    return d.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_scan, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
