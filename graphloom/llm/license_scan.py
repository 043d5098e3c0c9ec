r"""License scan by ordered signature rules.

A text becomes its words, lower case, with one space between. A rule is a regular
expression over those, its label, a keyword that all its matches hold and without which
it isn't tried, a tier of priority (1 is best) and a score. Among overlapping detections
one that lies within another of the same or a better tier is suppressed, so that the
longer name or the whole notice stands for what it contains. The expressions are written
by hand: some 170 names, which occur in five shapes, and some 110 notices. All of it is
built-in SQL functions on the row: no text moves, and texts without any license word
cost one search, which tries its words where a word of the text starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_V = "(?: version)?(?: v)? ?"
# Label, keyword, expression of the license's name in words.
NAMES = (
    ("mit", "mit", r"(?:the )?mit"),
    ("mit", "expat", r"(?:the )?expat"),
    ("x11", "x11", r"(?:the )?x11"),
    ("apache-2", "apache", rf"apache(?: software)?(?: license)?{_V}2(?: 0)?"),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: license)?{_V}1 1"),
    ("apache-1", "apache", rf"apache(?: software)?(?: license)?{_V}1 0"),
    ("gpl-2", "gpl", rf"(?:gnu )?gpl ?{_V}2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", rf"(?:gnu )?gpl ?{_V}3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "general public", rf"gnu general public license{_V}2(?: 0)?"),
    ("gpl-3", "general public", rf"gnu general public license{_V}3(?: 0)?"),
    ("gpl", "general public", r"(?:the )?gnu general public"),
    ("lgpl-2.1", "lgpl", rf"(?:gnu )?lgpl ?{_V}2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl", rf"(?:gnu )?lgpl ?{_V}3(?: 0)?(?: only| or later)?"),
    ("lgpl", "lesser general", r"(?:the )?gnu lesser general public"),
    ("agpl-3", "agpl", rf"(?:gnu )?agpl ?{_V}3(?: 0)?(?: only| or later)?"),
    ("agpl-3", "affero", r"(?:the )?gnu affero general public"),
    ("mpl-2", "mpl", rf"mpl ?{_V}2(?: 0)?"),
    ("mpl-2", "mozilla", rf"mozilla public(?: license)?{_V}2(?: 0)?"),
    ("mpl-1.1", "mozilla", rf"mozilla public(?: license)?{_V}1 1"),
    ("bsd-2", "bsd", r"(?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", r"(?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4", "bsd", r"(?:the )?(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd-0", "0bsd", r"(?:the )?0bsd"),
    ("bsd", "bsd", r"(?:the )?bsd"),
    ("isc", "isc", r"(?:the )?isc"),
    ("zlib", "zlib", r"(?:the )?zlib"),
    ("libpng", "libpng", r"(?:the )?libpng"),
    ("boost-1", "boost", rf"(?:the )?boost software(?: license)?{_V}(?:1 0)?"),
    ("epl-1", "eclipse", rf"(?:the )?eclipse public(?: license)?{_V}1 0"),
    ("epl-2", "eclipse", rf"(?:the )?eclipse public(?: license)?{_V}2 0"),
    ("cddl-1", "cddl", rf"(?:the )?cddl{_V}(?:1 0)?"),
    ("cpl-1", "common public", rf"(?:the )?common public(?: license)?{_V}(?:1 0)?"),
    ("eupl-1.2", "eupl", rf"(?:the )?eupl{_V}(?:1 2)?"),
    ("artistic-2", "artistic", rf"(?:the )?(?:perl )?artistic(?: license)?{_V}(?:2 0)?"),
    ("ms-pl", "microsoft", r"(?:the )?microsoft public"),
    ("ms-rl", "microsoft", r"(?:the )?microsoft reciprocal"),
    ("openssl", "openssl", r"(?:the )?openssl"),
    ("postgresql", "postgresql", r"(?:the )?postgresql"),
    ("psf-2", "psf", r"(?:the )?psf"),
    ("psf-2", "python", r"(?:the )?python(?: software foundation)?"),
    ("php-3", "php", rf"(?:the )?php{_V}(?:3 0[01]?)?"),
    ("ruby", "ruby", r"(?:the )?ruby"),
    ("vim", "vim", r"(?:the )?vim"),
    ("ofl-1.1", "open font", rf"(?:the )?(?:sil )?open font(?: license)?{_V}(?:1 1)?"),
    ("gfdl", "documentation", r"(?:the )?gnu free documentation"),
    ("ncsa", "ncsa", r"(?:the )?(?:university of illinois )?ncsa"),
    ("upl-1", "universal permissive", r"(?:the )?universal permissive"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl"),
    ("bsl-1.1", "business source", rf"(?:the )?business source(?: license)?{_V}(?:1 1)?"),
    ("sspl-1", "sspl", r"(?:the )?sspl"),
    ("elastic-2", "elastic", rf"(?:the )?elastic(?: license)?{_V}2(?: 0)?"),
    ("odbl", "open database", r"(?:the )?open database"),
    ("odc-by", "open data commons", r"(?:the )?open data commons attribution"),
    ("cc0", "cc0", rf"cc0{_V}(?:1 0)?(?: universal)?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: \d \d)?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: \d \d)?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: \d \d)?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: \d \d)?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: \d \d)?"),
    ("cc-by", "cc by", r"cc by(?: \d \d)?"),
    # families without a version, and versions by the long name
    ("gpl", "gpl", r"(?:the )?(?:gnu )?gpl"),
    ("gpl-1", "gpl", rf"(?:gnu )?gpl ?{_V}1(?: 0)?(?: only| or later)?"),
    ("lgpl", "lgpl", r"(?:the )?(?:gnu )?lgpl"),
    ("lgpl-2", "lgpl", rf"(?:gnu )?lgpl ?{_V}2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lesser general", rf"gnu lesser general public license{_V}2 1"),
    ("lgpl-3", "lesser general", rf"gnu lesser general public license{_V}3(?: 0)?"),
    ("lgpl-2", "library general", r"(?:the )?gnu library general public"),
    ("agpl", "agpl", r"(?:the )?(?:gnu )?agpl"),
    ("agpl-1", "affero", rf"affero general public license{_V}1(?: 0)?"),
    ("apache", "apache", r"(?:the )?apache(?: software)?"),
    ("mpl", "mozilla", r"(?:the )?mozilla public"),
    ("mpl-1", "mpl", rf"mpl ?{_V}1 0"),
    ("mpl-1.1", "mpl", rf"mpl ?{_V}1 1"),
    ("epl", "eclipse", r"(?:the )?eclipse public"),
    ("epl-1", "epl", rf"epl ?{_V}1 0"),
    ("epl-2", "epl", rf"epl ?{_V}2 0"),
    ("edl-1", "eclipse", rf"(?:the )?eclipse distribution(?: license)?{_V}(?:1 0)?"),
    ("cddl-1", "common development", rf"(?:the )?common development and distribution(?: license)?{_V}(?:1 [01])?"),
    ("eupl-1.1", "eupl", rf"(?:the )?eupl{_V}1 1"),
    ("eupl", "european union", r"(?:the )?european union public"),
    ("artistic-1", "artistic", rf"(?:the )?(?:perl )?artistic(?: license)?{_V}1 0"),
    ("artistic-1-cl", "clarified artistic", r"(?:the )?clarified artistic"),
    # short permissive ones
    ("mit-0", "mit", r"mit (?:0|no attribution)"),
    ("mit-modern", "mit", r"(?:the )?modern mit"),
    ("bsd-1", "bsd", r"(?:the )?(?:bsd 1 clause|1 clause bsd)"),
    ("bsd-0", "bsd", r"(?:the )?(?:bsd 0 clause|zero clause bsd)"),
    ("bsd-3-clear", "bsd", r"(?:the )?(?:bsd 3 clause clear|clear bsd)"),
    ("bsd-2-patent", "bsd", r"(?:the )?bsd 2 clause plus patent"),
    ("blueoak-1", "blue oak", rf"(?:the )?blue oak(?: model)?(?: license)?{_V}(?:1 0 0)?"),
    ("curl", "curl", r"(?:the )?curl"),
    ("hpnd", "historical permission", r"(?:the )?historical permission notice and disclaimer"),
    ("ntp", "ntp", r"(?:the )?ntp"),
    ("icu", "icu", r"(?:the )?icu"),
    ("ijg", "independent jpeg", r"(?:the )?independent jpeg group"),
    ("freetype", "freetype", r"(?:the )?freetype(?: project)?"),
    ("libtiff", "libtiff", r"(?:the )?libtiff"),
    ("imagemagick", "imagemagick", r"(?:the )?imagemagick"),
    ("info-zip", "info zip", r"(?:the )?info zip"),
    ("jasper-2", "jasper", rf"(?:the )?jasper{_V}(?:2 0)?"),
    ("unicode", "unicode", rf"(?:the )?unicode{_V}(?:3)?"),
    ("w3c", "w3c", r"(?:the )?w3c(?: software)?"),
    ("xfree86-1.1", "xfree86", rf"(?:the )?xfree86{_V}(?:1 1)?"),
    ("xnet", "x net", r"(?:the )?x net"),
    ("tcl", "tcl", r"(?:the )?tcl(?: tk)?"),
    ("mulan-2", "mulan", rf"(?:the )?mulan (?:psl|permissive software)(?: license)?{_V}(?:2)?"),
    ("miros", "miros", r"(?:the )?miros"),
    ("vsl-1", "vovida", rf"(?:the )?vovida software(?: license)?{_V}(?:1 0)?"),
    ("afl-3", "academic free", rf"(?:the )?academic free(?: license)?{_V}(?:3 0)?"),
    ("afl-2.1", "academic free", rf"(?:the )?academic free(?: license)?{_V}2 1"),
    ("ecl-2", "educational community", rf"(?:the )?educational community(?: license)?{_V}(?:2 0)?"),
    ("zpl-2.1", "zope", rf"(?:the )?zope public(?: license)?{_V}(?:2 [01])?"),
    ("openldap", "openldap", rf"(?:the )?openldap(?: public)?(?: license)?{_V}(?:2 8)?"),
    # copyleft of one maker or community
    ("apsl-2", "apple public", rf"(?:the )?apple public source(?: license)?{_V}(?:2 0)?"),
    ("osl-3", "open software", rf"(?:the )?open software license{_V}3(?: 0)?"),
    ("osl-2.1", "open software", rf"(?:the )?open software license{_V}2 1"),
    ("nposl-3", "non profit open", rf"(?:the )?non profit open software(?: license)?{_V}(?:3 0)?"),
    ("cecill-2.1", "cecill", rf"(?:the )?cecill{_V}(?:2 [01])?"),
    ("cecill-b", "cecill b", r"(?:the )?cecill b"),
    ("cecill-c", "cecill c", r"(?:the )?cecill c"),
    ("ipl-1", "ibm public", rf"(?:the )?ibm public(?: license)?{_V}(?:1 0)?"),
    ("lpl-1", "lucent public", rf"(?:the )?lucent public(?: license)?{_V}(?:1 0[2]?)?"),
    ("nokia", "nokia", r"(?:the )?nokia open source"),
    ("npl-1.1", "netscape", rf"(?:the )?netscape public(?: license)?{_V}(?:1 [01])?"),
    ("spl-1", "sun public", rf"(?:the )?sun public(?: license)?{_V}(?:1 0)?"),
    ("sissl", "sun industry", r"(?:the )?sun industry standards source"),
    ("qpl-1", "q public", rf"(?:the )?q public(?: license)?{_V}(?:1 0)?"),
    ("sleepycat", "sleepycat", r"(?:the )?sleepycat"),
    ("sgi-b-2", "sgi free", rf"(?:the )?sgi free software(?: license b)?{_V}(?:2 0)?"),
    ("watcom-1", "watcom", r"(?:the )?(?:sybase open )?watcom public"),
    ("wxwindows", "wxwindows", r"(?:the )?wxwindows library"),
    ("rpsl-1", "realnetworks", r"(?:the )?realnetworks public source"),
    ("rpl-1.5", "reciprocal public", rf"(?:the )?reciprocal public(?: license)?{_V}(?:1 [15])?"),
    ("simpl-2", "simple public", rf"(?:the )?simple public(?: license)?{_V}(?:2 0)?"),
    ("nasa-1.3", "nasa", rf"(?:the )?nasa open source(?: agreement)?{_V}(?:1 3)?"),
    ("intel", "intel", r"(?:the )?intel open source"),
    ("lppl-1.3", "latex", rf"(?:the )?latex project public(?: license)?{_V}(?:1 3c?)?"),
    ("catosl-1.1", "computer associates", r"(?:the )?computer associates trusted open source"),
    ("cpal-1", "common public attribution", rf"(?:the )?common public attribution(?: license)?{_V}(?:1 0)?"),
    ("aladdin", "aladdin", r"(?:the )?aladdin free public"),
    ("eiffel-2", "eiffel", rf"(?:the )?eiffel forum(?: license)?{_V}(?:2)?"),
    ("frameworx", "frameworx", r"(?:the )?frameworx open"),
    ("aal", "attribution assurance", r"(?:the )?attribution assurance"),
    ("apl-1", "adaptive public", r"(?:the )?adaptive public"),
    ("ypl-1.1", "yahoo", rf"(?:the )?yahoo public(?: license)?{_V}(?:1 [01])?"),
    # source available
    ("sspl-1", "server side public", rf"(?:the )?server side public(?: license)?{_V}(?:1)?"),
    ("elastic", "elastic", r"(?:the )?elastic"),
    ("confluent", "confluent", r"(?:the )?confluent community"),
    ("rsal-2", "redis", rf"(?:the )?redis source available(?: license)?{_V}(?:2)?"),
    ("fsl-1.1", "functional source", rf"(?:the )?functional source(?: license)?{_V}(?:1 1)?"),
    ("polyform-nc", "polyform", rf"(?:the )?polyform noncommercial(?: license)?{_V}(?:1 0 0)?"),
    ("polyform-sb", "polyform", rf"(?:the )?polyform small business(?: license)?{_V}(?:1 0 0)?"),
    ("polyform-shield", "polyform", rf"(?:the )?polyform shield(?: license)?{_V}(?:1 0 0)?"),
    ("prosperity-3", "prosperity", rf"(?:the )?prosperity public(?: license)?{_V}(?:3 0 0)?"),
    ("parity-7", "parity", rf"(?:the )?parity public(?: license)?{_V}(?:7 0 0)?"),
    ("hippocratic-2", "hippocratic", rf"(?:the )?hippocratic(?: license)?{_V}(?:2 [01])?"),
    # works, data, hardware, models
    ("free-art-1.3", "free art", rf"(?:the )?free art(?: license)?{_V}(?:1 3)?"),
    ("dsl", "design science", r"(?:the )?design science"),
    ("opl-1", "open publication", rf"(?:the )?open publication(?: license)?{_V}(?:1 0)?"),
    ("ogl-uk-3", "open government", rf"(?:the )?open government(?: license)?{_V}(?:3 0)?"),
    ("etalab-2", "etalab", rf"(?:the )?etalab(?: open)?(?: license)?{_V}(?:2 0)?"),
    ("pddl-1", "pddl", rf"(?:the )?pddl{_V}(?:1 0)?"),
    ("cdla-permissive-2", "community data", rf"(?:the )?community data license agreement permissive{_V}(?:[12] 0)?"),
    ("cdla-sharing-1", "community data", rf"(?:the )?community data license agreement sharing{_V}(?:1 0)?"),
    ("cern-ohl-2", "cern", rf"(?:the )?cern (?:open hardware|ohl)(?: licence)?{_V}(?:2)?"),
    ("solderpad", "solderpad", r"(?:the )?solderpad hardware"),
    ("tapr-ohl", "tapr", r"(?:the )?tapr open hardware"),
    ("openrail", "openrail", r"(?:the )?(?:creativeml |bigscience )?openrail(?: m)?"),
    ("llama", "llama", r"(?:the )?llama (?:\d )?community"),
)
_LICENCE = "licen[cs]e"
_GIVEN = "released|distributed|published|available|provided|covered|offered"
_BY = "under|by|with"
# How names occur: expression, tier, score.
SHAPES = (
    (r"spdx licen[cs]e identifier {}", 1, 1.0),
    (rf"(?:licensed|{_GIVEN}|dual licensed) (?:{_BY}) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{{}}(?: {_LICENCE})?(?: or (?:any )?later(?: version)?)?", 1, 0.95),
    (rf"under (?:the )?(?:terms of )?(?:the )?{{}} {_LICENCE}", 2, 0.9),
    (rf"{{}} {_LICENCE}", 3, 0.75),
    (rf"{_LICENCE} (?:is )?{{}}", 3, 0.65),
)
# Whole notices: label, keyword, expression, tier, score.
NOTICES = (
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 1, 1.0),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation", 1, 0.9),
    ("isc", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 1, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95),
    ("bsd-3", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission", 1, 0.95),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display", 1, 0.95),
    ("gpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public license", 1, 0.95),
    ("gpl-2", "general public", r"gnu general public license as published by the free software foundation either version 2", 1, 1.0),
    ("gpl-3", "general public", r"gnu general public license as published by the free software foundation either version 3", 1, 1.0),
    ("lgpl", "lesser general", r"under the terms of the gnu lesser general public license", 1, 0.95),
    ("agpl-3", "affero", r"under the terms of the gnu affero general public license", 1, 0.95),
    ("apache-2", "apache", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance", 1, 1.0),
    ("apache-2", "apache", r"apache license version 2(?: 0)?(?: january 2004)?", 2, 0.9),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 1, 1.0),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 1, 1.0),
    ("public-domain", "public domain", r"(?:released|dedicated|placed|donated) (?:in|in)?to the public domain", 2, 0.85),
    ("public-domain", "public domain", r"(?:is|are) (?:in|part of) the public domain", 3, 0.7),
    ("zlib", "arising from", r"in no event will the authors be held liable for any damages arising from the use of this software", 1, 0.85),
    ("boost-1", "obtaining a copy", r"obtaining a copy of the software and accompanying documentation covered by this license", 1, 0.95),
    ("wtfpl", "what the", r"do what the fuck you want to public license", 1, 1.0),
    ("beerware", "beer", r"you can buy me a beer in return", 1, 0.9),
    ("json", "good not evil", r"the software shall be used for good not evil", 1, 1.0),
    ("cc-by", "creative commons", r"creative commons attribution(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?", 2, 0.9),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?", 2, 0.95),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?", 2, 0.95),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative|ativ)e?s?(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?", 2, 0.95),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?", 2, 0.97),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative|ativ)e?s?(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?", 2, 0.97),
    ("cc0", "creative commons", r"creative commons zero(?: 1 0)?(?: universal)?", 2, 0.95),
    ("cc0", "cc0", r"cc0 1 0(?: universal)?", 2, 0.95),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: \d \d)?", 2, 0.85),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: \d \d)?", 2, 0.9),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: \d \d)?", 2, 0.9),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: \d \d)?", 2, 0.9),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: \d \d)?", 2, 0.9),
    ("cc-by", "cc by", r"cc by \d \d", 2, 0.85),
    ("proprietary", "all rights reserved", r"all rights reserved", 3, 0.4),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 2, 0.8),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes|research)(?: only)?", 3, 0.6),
    # sentences of known texts
    ("mit", "permission notice", r"the above copyright notice and this permission notice shall be included in all copies", 1, 0.95),
    ("mit", "authors or copyright", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", 1, 0.85),
    ("bsd", "redistributions of", r"redistributions of source code must retain the above copyright notice", 1, 0.9),
    ("bsd", "redistributions in", r"redistributions in binary form must reproduce the above copyright notice", 1, 0.9),
    ("bsd", "copyright holders and", r"this software is provided by the copyright holders and contributors as is", 1, 0.85),
    ("bsd-3", "neither the name", r"neither the names? of (?:the )?(?:copyright holders?|authors?|company|organization|university) nor the names of its contributors", 1, 0.95),
    ("bsd-2-views", "official policies", r"should not be interpreted as representing official policies", 1, 0.85),
    ("apache-2", "applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 1, 0.95),
    ("apache-2", "hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)", 1, 0.95),
    ("apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)", 1, 0.9),
    ("gpl", "general public", r"you should have received a copy of the gnu general public license", 1, 0.9),
    ("lgpl", "lesser general", r"you should have received a copy of the gnu lesser general public license", 1, 0.9),
    ("agpl-3", "affero", r"you should have received a copy of the gnu affero general public license", 1, 0.9),
    ("lgpl-2.1", "lesser general", r"gnu lesser general public license as published by the free software foundation either version 2 1", 1, 1.0),
    ("lgpl-3", "lesser general", r"gnu lesser general public license as published by the free software foundation either version 3", 1, 1.0),
    ("lgpl-2", "library general", r"gnu library general public license as published by the free software foundation either version 2", 1, 1.0),
    ("agpl-3", "affero", r"gnu affero general public license as published by the free software foundation either version 3", 1, 1.0),
    ("gpl-classpath", "classpath exception", r"(?:with (?:the )?)?classpath exception", 2, 0.8),
    ("gpl-gcc", "runtime library", r"gcc runtime library exception", 2, 0.85),
    ("gpl-openssl", "openssl", r"permission to link (?:this program )?with (?:the )?openssl", 1, 0.85),
    ("epl-1", "eclipse", r"made available under the terms of the eclipse public license v ?1 0", 1, 1.0),
    ("epl-2", "eclipse", r"made available under the terms of the eclipse public license(?: v)? ?2 0", 1, 1.0),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 1, 1.0),
    ("cddl-1", "common development", r"subject to the terms of the common development and distribution license", 1, 1.0),
    ("zlib", "plainly marked", r"altered source versions must be plainly marked as such", 1, 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 1, 0.95),
    ("boost-1", "boost", r"distributed under the boost software license version 1 0", 1, 1.0),
    ("cc0", "waived all", r"waived all copyright and related (?:or|and) neighboring rights", 1, 0.95),
    ("cc0", "public domain", r"public domain dedication", 2, 0.8),
    ("ofl-1.1", "font software", r"this font software is licensed under the sil open font license", 1, 1.0),
    ("gfdl", "documentation", r"modify this document under the terms of the gnu free documentation license", 1, 1.0),
    ("lppl-1.3", "latex", r"modified under the conditions of the latex project public license", 1, 1.0),
    ("perl", "perl itself", r"under the same terms as perl itself", 1, 0.9),
    ("php-3", "php software", r"this product includes php software freely available", 1, 0.9),
    ("openssl", "openssl", r"for use in the openssl toolkit", 1, 0.95),
    ("ssleay", "cryptographic", r"cryptographic software written by eric young", 1, 0.95),
    ("ijg", "independent jpeg", r"based in part on the work of the independent jpeg group", 1, 0.95),
    ("freetype", "freetype", r"portions of this software are copyright (?:c )?(?:the )?freetype project", 1, 0.9),
    ("hpnd", "without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", 1, 0.95),
    ("ntp", "with or without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 1, 0.95),
    ("ncsa", "deal with the software", r"to deal with the software without restriction", 1, 0.9),
    ("w3c", "w3c", r"w3c software notice and license", 1, 0.95),
    ("unicode", "unicode", r"copy of the unicode data files and any associated documentation", 1, 0.95),
    ("beerware", "beer", r"the beer ?ware license", 1, 0.95),
    ("commons-clause", "commons clause", r"commons clause license condition", 1, 1.0),
    # addresses of texts
    ("cc-by", "creativecommons", r"creativecommons org licenses by \d \d", 1, 0.95),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa \d \d", 1, 0.95),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc \d \d", 1, 0.95),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd \d \d", 1, 0.95),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa \d \d", 1, 0.95),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd \d \d", 1, 0.95),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero", 1, 0.95),
    ("mit", "opensource org", r"opensource org licenses? mit", 1, 0.95),
    ("bsd-2", "opensource org", r"opensource org licenses? bsd 2 clause", 1, 0.95),
    ("bsd-3", "opensource org", r"opensource org licenses? bsd 3 clause", 1, 0.95),
    ("apache-2", "apache org", r"apache org licenses license 2 0", 1, 0.95),
    ("gpl", "gnu org", r"gnu org (?:licenses|copyleft) gpl", 1, 0.85),
    ("lgpl", "gnu org", r"gnu org (?:licenses|copyleft) lesser", 1, 0.85),
    ("agpl-3", "gnu org", r"gnu org licenses agpl", 1, 0.9),
    ("mpl-2", "mozilla org", r"mozilla org mpl 2 0", 1, 0.95),
    ("unlicense", "unlicense org", r"https? unlicense org", 1, 0.9),
    # rights kept
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document)", 2, 0.8),
    ("proprietary", "trade secret", r"(?:confidential|proprietary) (?:information )?and trade secrets?", 2, 0.7),
    ("proprietary", "end user", r"end user licen[cs]e agreement", 2, 0.7),
    ("proprietary", "may not be", r"may not be (?:copied|reproduced|redistributed) without (?:prior )?(?:written )?permission", 2, 0.6),
    ("evaluation", "evaluation purposes", r"for evaluation purposes only", 2, 0.7),
    ("academic", "for academic", r"for academic (?:and research )?(?:use|purposes) only", 2, 0.7),
    ("academic", "for research", r"for research (?:and educational )?(?:use|purposes) only", 2, 0.7),
    ("personal-use", "personal use", r"for (?:your )?personal use only", 3, 0.6),
    ("public-domain", "no copyright", r"no copyright (?:is )?claimed", 2, 0.7),
    ("us-government", "government", r"work of the (?:united states|us|u s) government", 2, 0.8),
    ("crown-copyright", "crown copyright", r"crown copyright", 2, 0.7),
    ("unknown-license", "license", r"see (?:the )?license(?: file| txt| md)? for (?:more )?(?:details|information|terms)", 3, 0.4),
)


def _anchored(words: list[str]) -> str:
    """One of words at the start of a word, those of one first letter together."""
    first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        first.setdefault(w[0], []).append(w[1:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items()) + ")"


# What every rule's match holds, from the start of a word on: a shape's own words, or the
# keyword of a notice (commercial may be the end of a word).
GATE = _anchored([_LICENCE, "dual licensed", *[f"{w} (?:{_BY}) " for w in ["licensed", *_GIVEN.split("|")]], *[{"commercial": "non ?commercial"}.get(key, key) for _, key, *_ in NOTICES]])


def rules() -> list[tuple[str, str, str, int, float]]:
    """label, keyword, expression, tier, score: the notices, then every name in every shape."""
    named = [(label, key, shape.format(f"(?:{name})"), tier, score) for label, key, name in NAMES for shape, tier, score in SHAPES]
    return [(label, key, f"(?<= ){rx}(?= )", tier, score) for label, key, rx, tier, score in [*NOTICES, *named]]


def _quoted(text: str) -> str:
    return "r'" + text + "'"


def _rule_groups() -> str:
    """SQL array of struct(key, array of rules): a keyword is looked for once."""
    groups: dict[str, list[str]] = {}
    for label, key, rx, tier, score in rules():
        groups.setdefault(key, []).append(f"named_struct('label', '{label}', 'rx', {_quoted(rx)}, 'tier', {tier}, 'score', {score}d)")
    return "array(" + ", ".join(f"named_struct('key', '{k}', 'rules', array({', '.join(v)}))" for k, v in groups.items()) + ")"


# Matches of rule r in t with their places: the text between matches and the matches take turns.
_PLACES = """
  flatten(transform(array(named_struct('gap', split(t, r.rx, -1), 'hit', regexp_extract_all(t, r.rx, 0))), m ->
    aggregate(if(size(m.hit) = 0, cast(array() as array<int>), sequence(1, size(m.hit))),
      named_struct('at', 0, 'out', cast(array() as array<struct<lo:int,hi:int,tier:int,label:string,score:double>>)),
      (a, i) -> named_struct(
        'at', a.at + length(element_at(m.gap, i)) + length(element_at(m.hit, i)),
        'out', concat(a.out, array(named_struct(
          'lo', a.at + length(element_at(m.gap, i)), 'hi', a.at + length(element_at(m.gap, i)) + length(element_at(m.hit, i)),
          'tier', r.tier, 'label', r.label, 'score', r.score)))),
      a -> a.out)))
"""
_FOUND = "flatten(transform(array(words), t -> flatten(transform(flatten(transform(filter({groups}, g -> contains(t, g.key)), g -> g.rules)), r -> {places}))))"
# From left to right, longer first: e1 to e3 are the farthest ends so far in tiers up to 1 to 3.
_STANDING = """
  aggregate(array_sort(found, (x, y) -> case when x.lo <> y.lo then x.lo - y.lo when x.hi <> y.hi then y.hi - x.hi when x.tier <> y.tier then x.tier - y.tier
      when x.label < y.label then -1 when x.label > y.label then 1 else 0 end),
    named_struct('e1', 0, 'e2', 0, 'e3', 0, 'out', cast(array() as array<struct<lo:int,hi:int,tier:int,label:string,score:double>>)),
    (a, x) -> named_struct(
      'e1', if(x.tier <= 1, greatest(a.e1, x.hi), a.e1), 'e2', if(x.tier <= 2, greatest(a.e2, x.hi), a.e2), 'e3', greatest(a.e3, x.hi),
      'out', if(x.hi <= case x.tier when 1 then a.e1 when 2 then a.e2 else a.e3 end, a.out, concat(a.out, array(x)))),
    a -> a.out)
"""
_KIND = "array<struct<lo:int,hi:int,tier:int,label:string,score:double>>"


def normalised(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space before, between and after."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, " ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with words (text in normal form), detections (array of lo, hi, tier, label,
    score: places in words) of the rules that stand after suppression. Null or empty
    texts have words of two spaces and no detections."""
    d = docs.withColumn("words", normalised(F.col("text").cast("string")))
    found = f"if(rlike(words, {_quoted(GATE)}), {_FOUND.format(groups=_rule_groups(), places=_PLACES)}, cast(array() as {_KIND}))"
    d = d.withColumn("found", F.expr(found))
    return d.withColumn("detections", F.expr(f"if(size(found) = 0, found, {_STANDING})")).drop("found")


def _starts(phrase: str) -> str:
    """SQL: the word places (from 0) where the phrase stands in words; cheap without it."""
    w = phrase.split(" ")
    same = " and ".join(f"element_at(l, i + {k + 1}) = '{x}'" for k, x in enumerate(w))
    return f"if(contains(words, ' {phrase} '), flatten(transform(array(split(trim(words), ' ')), l -> filter(sequence(0, size(l) - {len(w)}), i -> {same}))), cast(array() as array<int>))"


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every
    row of docs (doc_id, text).

    n_base counts all places of the base phrases; first_word and last_word are null
    without one. labels are those of the base and of the standing detections; score is
    the best of 0.9 for a base phrase and the detections' scores, 0 without any. Null and
    empty texts have no words and empty labels. Other columns are not read.
    """
    d = scanned(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")
    bare = F.trim("words")
    d = d.withColumn("n_words", F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long"))
    each = [F.expr(f"named_struct('label', '{label}', 'at', {_starts(p)})") for p, label in BASE.items()]
    d = d.withColumn("base", F.array(*each)).select("doc_id", "n_words", "base", "detections")
    places = F.flatten(F.transform("base", lambda b: b["at"]))
    own = F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    d = d.withColumn("places", places).withColumn("own", own)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("detections", lambda x: x["score"])), F.lit(0.0))
    return d.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        joined(F.col("own")).alias("base_labels"), joined(F.concat("own", F.transform("detections", lambda x: x["label"]))).alias("labels"),
        F.greatest(best, F.when(F.size("own") > 0, 0.9).otherwise(0.0)).alias("score"),
    )
