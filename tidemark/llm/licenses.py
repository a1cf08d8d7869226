"""Licence scans: ordered signature rules behind a keyword prefilter, with priorities and containment suppression.

Texts are read as words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased, joined by single spaces.
Four base phrases give places and base labels. A few hundred signature rules then give hits with a priority; a hit inside another hit's interval goes if the other one has the higher priority, or
the same priority and a longer interval, or the same interval and an earlier rule. What stays adds its labels.

Defined results: a null text is empty: no words, no places, null first and last word, empty labels, score 0;
repeated rows are judged each; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Families of licences; label, priority, keyword that the text must contain, names, versions.
FAMILIES = (
    ("agpl", 70, "affero", ("gnu affero general public licen[sc]e", "affero general public licen[sc]e", "affero gpl"), ("1", "2", "3", "1 0", "3 0")),
    ("lgpl", 70, "lesser", ("gnu lesser general public licen[sc]e", "lesser general public licen[sc]e", "lesser gpl"), ("2", "2 1", "3", "3 0")),
    ("gpl", 60, "general public", ("gnu general public licen[sc]e", "general public licen[sc]e"), ("1", "2", "3", "2 0", "3 0")),
    ("gpl", 55, "gpl", ("gnu gpl", "gplv2", "gplv3", "gpl v2", "gpl v3"), ("2", "3", "2 0", "3 0")),
    ("apache", 60, "apache", ("apache licen[sc]e", "apache software licen[sc]e"), ("1 0", "1 1", "2", "2 0")),
    ("apache", 60, "asf", ("asf licen[sc]e",), ("1 0", "1 1", "2", "2 0")),
    ("mit", 60, "mit", ("mit licen[sc]e", "mit x11 licen[sc]e", "expat mit licen[sc]e"), ()),
    ("bsd", 60, "bsd", ("bsd licen[sc]e", "new bsd licen[sc]e", "modified bsd licen[sc]e", "simplified bsd licen[sc]e", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "2 clause bsd", "3 clause bsd"), ()),
    ("mpl", 60, "mozilla", ("mozilla public licen[sc]e",), ("1 0", "1 1", "2 0")),
    ("epl", 60, "eclipse", ("eclipse public licen[sc]e", "eclipse distribution licen[sc]e"), ("1 0", "2 0")),
    ("cddl", 60, "common development", ("common development and distribution licen[sc]e",), ("1 0", "1 1")),
    ("cpl", 60, "common public", ("common public licen[sc]e",), ("0 5", "1 0")),
    ("eupl", 60, "european union", ("european union public licen[sc]e",), ("1 0", "1 1", "1 2")),
    ("isc", 60, "isc", ("isc licen[sc]e",), ()),
    ("zlib", 60, "zlib", ("zlib licen[sc]e", "zlib libpng licen[sc]e"), ()),
    ("boost", 60, "boost", ("boost software licen[sc]e",), ("1 0",)),
    ("artistic", 60, "artistic", ("artistic licen[sc]e",), ("1 0", "2 0")),
    ("unlicense", 60, "unlicense", ("the unlicense", "unlicense org"), ()),
    ("wtfpl", 60, "wtfpl", ("wtfpl",), ("1", "2")),
    ("psf", 60, "python", ("python software foundation licen[sc]e", "python licen[sc]e"), ("2",)),
    ("psf", 60, "psf", ("psf licen[sc]e",), ("2",)),
    ("ofl", 60, "open font", ("sil open font licen[sc]e", "open font licen[sc]e"), ("1 0", "1 1")),
    ("odbl", 60, "open database", ("open database licen[sc]e", "open data commons open database licen[sc]e"), ("1 0",)),
    ("openssl", 60, "openssl", ("openssl licen[sc]e",), ()),
    ("ms-pl", 60, "microsoft", ("microsoft public licen[sc]e", "microsoft reciprocal licen[sc]e"), ()),
    ("postgresql", 60, "postgresql", ("postgresql licen[sc]e",), ()),
    ("cc-by-nc-sa", 68, "cc by nc sa", ("cc by nc sa",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", 68, "cc by nc nd", ("cc by nc nd",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", 66, "cc by nc", ("cc by nc",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", 66, "cc by sa", ("cc by sa",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", 66, "cc by nd", ("cc by nd",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", 64, "cc by", ("cc by",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", 64, "creative commons", ("creative commons attribution", "creative commons attribution licen[sc]e"), ("2 0", "3 0", "4 0")),
    ("cc-by-sa", 66, "creative commons", ("creative commons attribution share ?alike",), ("2 0", "3 0", "4 0")),
    ("cc-by-nc", 66, "creative commons", ("creative commons attribution non ?commercial",), ("2 0", "3 0", "4 0")),
    ("cc0", 66, "cc0", ("cc0",), ("1 0",)),
    ("cc0", 66, "creative commons", ("creative commons zero", "creative commons cc0"), ("1 0",)),
    ("public-domain", 50, "public domain", ("(?:is|are|into|in) the public domain", "public domain dedication"), ()),
    ("proprietary", 40, "all rights reserved", ("all rights reserved",), ()),
    ("copyright", 30, "copyright", ("copyright (?:c )?(?:19|20)[0-9][0-9]",), ()),
)
#: The ways in which a licence is invoked; each adds to the priority and the confidence.
PHRASINGS = (
    ("{name}", 0, 0.6), ("{name} v(?:ersion)? ?{version}", 4, 0.8), ("{name} {version}", 3, 0.75), ("licen[sc]ed under (?:the )?{name}", 6, 0.9),
    ("licen[sc]ed under (?:the )?{name} (?:v(?:ersion)? ?)?{version}", 9, 1.0), ("(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{name}", 6, 0.9),
    ("(?:subject to|terms of) (?:the )?{name}", 5, 0.85), ("spdx licen[sc]e identifier {name}", 8, 1.0),
)

#: Sentences of licences' own texts and notices, as words; label, priority, confidence, keyword, expression.
BODIES = (
    ("mit", 80, 1.0, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 76, 0.9, "substantial portions of the software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", 80, 1.0, "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("boost", 80, 1.0, "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsd", 78, 1.0, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 76, 0.9, "redistributions", "redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd", 76, 0.95, "endorse or promote", "may be used to endorse or promote products derived from this software"),
    ("apache", 80, 1.0, "in compliance with the", "you may not use this (?:file|work) except in compliance with the licen[sc]e"),
    ("apache", 78, 0.95, "governing permissions", "see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e"),
    ("gpl", 78, 1.0, "redistribute it", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", 79, 1.0, "redistribute it", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("agpl", 79, 1.0, "redistribute it", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("gpl", 74, 0.9, "either version", "either version [123](?: 0)? of the licen[sc]e or at your option any later version"),
    ("mpl", 80, 1.0, "mozilla", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("epl", 78, 1.0, "eclipse", "made available under the terms of the eclipse public licen[sc]e"),
    ("zlib", 80, 1.0, "origin of this software", "the origin of this software must not be misrepresented"),
    ("zlib", 76, 0.9, "altered source versions", "altered source versions must be plainly marked as such"),
    ("unlicense", 80, 1.0, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 80, 1.0, "do what the fuck you want to", "do what the fuck you want to(?: public licen[sc]e)?"),
    ("cc0", 80, 1.0, "waived all copyright", "has waived all copyright and related or neighboring rights"),
    ("cc-by", 72, 0.9, "creative commons attribution", "this work is licen[sc]ed under (?:a|the) creative commons attribution(?: [1-4] [05])? (?:international |generic |unported )?licen[sc]e"),
    ("ofl", 80, 1.0, "this font software", "this font software is licen[sc]ed under the sil open font licen[sc]e"),
    ("artistic", 78, 0.9, "perl itself", "under the same terms as perl itself"),
    ("warranty-disclaimer", 45, 0.7, "without warranty of any kind", "the software is provided as is without warranty of any kind express or implied"),
    ("warranty-disclaimer", 45, 0.7, "without any warranty", "(?:in the hope that it will be useful but )?without any warranty"),
    ("proprietary", 60, 0.9, "confidential", "(?:this (?:document|file|software) is|contains) (?:the )?(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 60, 0.9, "unauthorized", "unauthorized (?:copying|use|distribution|reproduction)(?: of (?:this|these) (?:file|files|document|software|work|material|code))?(?: via any medium)? is strictly prohibited"),
)


#: Further notices, sentences and names, as words; label, keyword, expression. They share one priority and
#: confidence.
NOTICES = (
    ("mit", "to deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies of the software"),
    ("mit", "expressly mit licen", "this (?:project|library|program|package) is expressly mit licen[sc]ed"),
    ("mit", "mit licen", "(?:code|project|library|package) is mit licen[sc]ed"),
    ("mit", "mit licen", "see the licen[sc]e file for the full text of the mit licen[sc]e"),
    ("isc", "with or without fee", "use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "free public licen", "free public licen[sc]e 1 0 0"),
    ("bsd", "must retain the above copyright", "source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "must reproduce the above copyright", "binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is"),
    ("bsd", "bsd style", "(?:governed|covered) by a bsd style licen[sc]e"),
    ("bsd", "bsd style", "bsd style licen[sc]e that can be found in the licen[sc]e file"),
    ("bsd-3-clause-clear", "no express or implied licen", "no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("apache", "obtain a copy of the licen", "you may obtain a copy of the licen[sc]e at http www apache org licen[sc]es licen[sc]e 2 0"),
    ("apache", "licensed to the apache software foundation", "licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("apache", "perpetual worldwide", "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e to reproduce"),
    ("apache", "appendix how to apply", "appendix how to apply the apache licen[sc]e to your work"),
    ("gpl", "distributed in the hope that it will be useful", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "merchantability or fitness", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e"),
    ("gpl", "received a copy of the gnu general", "you should have received a copy of the gnu general public licen[sc]e along with"),
    ("gpl", "free software foundation either version", "published by the free software foundation either version [1-3] of the licen[sc]e"),
    ("gpl", "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document"),
    ("gpl", "take away your freedom", "the licen[sc]es for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("gpl", "gpl compatible", "gpl compatible free software licen[sc]e"),
    ("gpl", "version 2 only", "gnu general public licen[sc]e version 2 only"),
    ("gpl", "any later version", "under the gpl version [1-3] or any later version"),
    ("gpl-exception", "linking exception", "gpl(?: v2| v3)? with (?:a )?linking exception"),
    ("gpl-exception", "classpath exception", "gpl(?: v2)? with (?:the )?classpath exception"),
    ("gpl-exception", "as a special exception", "as a special exception the copyright holders of this library give you permission to link this library"),
    ("gpl-exception", "font exception", "gpl with font exception"),
    ("lgpl", "received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public licen[sc]e along with"),
    ("lgpl", "received a copy of the gnu library", "you should have received a copy of the gnu library general public licen[sc]e along with"),
    ("agpl", "received a copy of the gnu affero", "you should have received a copy of the gnu affero general public licen[sc]e along with"),
    ("agpl", "remote network interaction", "remote network interaction use with the gnu general public licen[sc]e"),
    ("gfdl", "free documentation", "gnu free documentation licen[sc]e"),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts a copy of the licen[sc]e"),
    ("mpl", "mpl was not distributed", "if a copy of the mpl was not distributed with this file you can obtain one at(?: https?)? mozilla org mpl 2 0"),
    ("mpl", "incompatible with secondary licen", "this source code form is incompatible with secondary licen[sc]es as defined by the mozilla public licen[sc]e"),
    ("mpl", "the contents of this file are subject", "the contents of this file are subject to the mozilla public licen[sc]e version 1 [01]"),
    ("epl", "accompanies this distribution", "the eclipse public licen[sc]e which accompanies this distribution"),
    ("edl", "eclipse distribution", "made available under the eclipse distribution licen[sc]e"),
    ("cddl", "subject to the terms of the common development", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cddl", "include this cddl header", "include this cddl header notice in each file and include the licen[sc]e file"),
    ("cpl", "common public licen", "terms of the common public licen[sc]e which accompanies this distribution"),
    ("ipl", "ibm public", "ibm public licen[sc]e(?: version)?(?: 1 0)?"),
    ("osl", "open software licen", "open software licen[sc]e(?: version)? [1-3] [01]"),
    ("afl", "academic free", "academic free licen[sc]e(?: version)? [1-3] [01]"),
    ("ecl", "educational community", "educational community licen[sc]e(?: version)?(?: 2 0)?"),
    ("eupl", "eupl", "licen[sc]ed under the eupl(?: version 1 [0-2]| v1 [0-2])?"),
    ("cecill", "cecill", "governed by the cecill(?: b| c)? licen[sc]e under french law"),
    ("ms-pl", "microsoft public", "this licen[sc]e governs use of the accompanying software microsoft public licen[sc]e"),
    ("ms-limited", "microsoft software licen", "microsoft software licen[sc]e terms"),
    ("libpng", "png", "(?:png reference library licen[sc]e(?: version 2)?|libpng licen[sc]e)"),
    ("boost", "boost software licen", "distributed under the boost software licen[sc]e version 1 0 see accompanying file"),
    ("unlicense", "relinquishment in perpetuity", "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("wtfpl", "you just do what the fuck", "you just do what the fuck you want to"),
    ("cc0", "no copyright", "no copyright the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal(?: public domain dedication)?"),
    ("cc-by", "creative commons by", "creative commons by(?: [1-4] [05])? licen[sc]e"),
    ("cc-by", "attribution 4 0 international", "creative commons attribution 4 0 international"),
    ("cc-by", "give appropriate credit", "you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made"),
    ("cc-by-sa", "same license as the original", "you must distribute your contributions under the same license as the original"),
    ("cc-by-sa", "sharealike", "creative commons attribution sharealike [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nc", "noncommercial", "creative commons attribution noncommercial [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nc-sa", "noncommercial sharealike", "creative commons attribution noncommercial sharealike [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nc-nd", "noncommercial noderiv", "creative commons attribution noncommercial noderiv(?:ative)?s [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nd", "noderiv", "creative commons attribution noderiv(?:ative)?s [1-4] [05](?: international| unported| generic)?"),
    ("cc-pd-mark", "public domain mark", "public domain mark 1 0"),
    ("ofl", "reserved font name", "copyright (?:19|20)[0-9][0-9] with reserved font name"),
    ("ofl", "font software is furnished", "font software is furnished subject to the sil open font licen[sc]e"),
    ("odbl", "open database licen", "made available under the open database licen[sc]e any rights in individual contents"),
    ("odc-by", "open data commons attribution", "open data commons attribution licen[sc]e"),
    ("pddl", "public domain dedication and licen", "public domain dedication and licen[sc]e(?: version)?(?: 1 0)?"),
    ("ogl", "open government", "open government licen[sc]e(?: version)?(?: [1-3] 0)?"),
    ("openssl", "openssl toolkit", "redistributions of any form whatsoever must retain this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "ssleay", "(?:original )?ssleay licen[sc]e"),
    ("php", "php licen", "php licen[sc]e(?: version)?(?: 3 01| 3 0)?"),
    ("ruby", "ruby", "you can redistribute it and or modify it under (?:the same terms as ruby|either the terms of the 2 clause bsdl ruby)"),
    ("perl", "perl itself", "(?:redistribute it and or modify it under the same terms as|redistribute it under the terms of) perl itself"),
    ("vim", "vim licen", "distributed under the vim licen[sc]e"),
    ("tcl", "tcl", "tcl tk licen[sc]e(?: terms)?"),
    ("postgresql", "postgresql", "released under the postgresql licen[sc]e a liberal open source licen[sc]e"),
    ("sleepycat", "sleepycat", "sleepycat(?: software)?(?: public)? licen[sc]e"),
    ("curl", "curl licen", "curl licen[sc]e(?: mit x derivate)?"),
    ("beerware", "beer ware", "the beer ware licen[sc]e(?: revision 42)?"),
    ("elastic", "elastic licen", "elastic licen[sc]e(?: version)?(?: 2 0)?"),
    ("sspl", "server side public", "server side public licen[sc]e(?: version)?(?: 1)?"),
    ("busl", "business source", "business source licen[sc]e(?: version)?(?: 1 1)?"),
    ("commons-clause", "commons clause", "commons clause licen[sc]e condition(?: version)?(?: 1 0)?"),
    ("polyform", "polyform", "polyform (?:noncommercial|shield|strict|small business|free trial) licen[sc]e"),
    ("openrail", "openrail", "(?:creativeml|bigscience|big code|bigcode) openrail(?: m)? licen[sc]e"),
    ("llama", "llama", "llama [2-4](?: [1-9])? community licen[sc]e(?: agreement)?"),
    ("proprietary", "trade secret", "contains (?:valuable )?trade secrets? and confidential information"),
    ("proprietary", "internal use only", "confidential for internal use only"),
    ("proprietary", "end user licen", "end user licen[sc]e agreement"),
    ("proprietary", "non transferable", "non exclusive non transferable(?: limited)? licen[sc]e"),
    ("academic-use", "academic", "licen[sc]ed for academic (?:and research )?use only"),
    ("warranty-disclaimer", "in no event shall the copyright", "in no event shall the copyright (?:owners?|holders?)(?: or contributors)? be liable for any"),
    ("copyright", "copyright held by", "copyright held by the owner authors?"),
    ("copyright", "rights licensed", "publication rights licensed to"),
    ("mit-0", "mit no attribution", "mit no attribution licen[sc]e"),
    ("mit", "x11 licen", "x11 licen[sc]e"),
    ("mit", "to whom the software is furnished", "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice"),
    ("isc", "isc style", "(?:under|covered by) an isc style licen[sc]e"),
    ("0bsd", "zero clause bsd", "zero clause bsd licen[sc]e"),
    ("0bsd", "bsd zero clause", "bsd zero clause licen[sc]e"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "freebsd", "freebsd licen[sc]e"),
    ("bsd", "regents of the university", "copyright (?:c )?(?:19|20)[0-9][0-9] the regents of the university of california"),
    ("bsd", "bsd protection", "bsd protection licen[sc]e"),
    ("apache", "apache 2 0 licen", "apache 2 0 licen[sc]ed"),
    ("apache", "contributor licen", "apache (?:individual |corporate )?contributor licen[sc]e agreement"),
    ("apache-exception", "llvm exception", "apache licen[sc]e v2 0 with llvm exceptions?"),
    ("apache", "contents of the notice file", "contents of the notice file are for informational purposes only and do not modify the licen[sc]e"),
    ("apache", "grant of patent", "grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e"),
    ("gpl", "gpl 2 0 only", "spdx licen[sc]e identifier gpl 2 0 only"),
    ("gpl", "gpl 2 0 or later", "spdx licen[sc]e identifier gpl 2 0 or later"),
    ("gpl", "gpl 3 0 only", "spdx licen[sc]e identifier gpl 3 0 only"),
    ("gpl", "gpl 3 0 or later", "spdx licen[sc]e identifier gpl 3 0 or later"),
    ("lgpl", "lgpl 2 1 only", "spdx licen[sc]e identifier lgpl 2 1 only"),
    ("lgpl", "lgpl 2 1 or later", "spdx licen[sc]e identifier lgpl 2 1 or later"),
    ("lgpl", "lgpl 3 0 only", "spdx licen[sc]e identifier lgpl 3 0 only"),
    ("lgpl", "lgpl 3 0 or later", "spdx licen[sc]e identifier lgpl 3 0 or later"),
    ("agpl", "agpl 3 0 only", "spdx licen[sc]e identifier agpl 3 0 only"),
    ("agpl", "agpl 3 0 or later", "spdx licen[sc]e identifier agpl 3 0 or later"),
    ("gfdl", "gfdl 1", "spdx licen[sc]e identifier gfdl 1 [1-3](?: only| or later)?"),
    ("gpl", "free copyleft", "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works"),
    ("gpl", "corresponding source", "convey the corresponding source under the terms of this licen[sc]e"),
    ("gpl", "work based on the program", "a work based on the program means either the program or any derivative work under copyright law"),
    ("lgpl", "library general public", "gnu library general public licen[sc]e(?: version 2| v2)?"),
    ("gpl-exception", "autoconf exception", "gpl(?: v2| v3)? with (?:the )?autoconf exception"),
    ("gpl-exception", "bison exception", "gpl(?: v2| v3)? with (?:the )?bison exception"),
    ("gpl-exception", "gcc runtime library", "gpl(?: v3)? with (?:the )?gcc runtime library exception"),
    ("gpl-exception", "openssl exception", "gpl(?: v2| v3)? with (?:the |an )?openssl exception"),
    ("gpl-exception", "qt gpl", "qt gpl exception(?: 1 0)?"),
    ("gpl-exception", "syscall note", "gpl 2 0 with linux syscall note"),
    ("mpl", "mpl 2 0", "spdx licen[sc]e identifier mpl 2 0"),
    ("mpl", "no copyleft exception", "mpl 2 0 no copyleft exception licen[sc]e"),
    ("npl", "netscape public", "netscape public licen[sc]e(?: version)?(?: 1 [01])?"),
    ("epl", "epl 2 0", "spdx licen[sc]e identifier epl 2 0"),
    ("apsl", "apple public source", "apple public source licen[sc]e(?: version)?(?: [12] [0-2])?"),
    ("qpl", "q public", "q public licen[sc]e(?: version)?(?: 1 0)?"),
    ("lppl", "latex project public", "latex project public licen[sc]e(?: version)?(?: 1 [0-3])?"),
    ("spl", "sun public", "sun public licen[sc]e(?: version)?(?: 1 0)?"),
    ("intel", "intel open source", "intel open source licen[sc]e"),
    ("w3c", "w3c", "w3c software(?: and document)?(?: notice and)? licen[sc]e"),
    ("zpl", "zope public", "zope public licen[sc]e(?: version)?(?: 2 [01])?"),
    ("upl", "universal permissive", "universal permissive licen[sc]e(?: version)?(?: 1 0)?"),
    ("ncsa", "university of illinois", "university of illinois(?: ncsa)? open source licen[sc]e"),
    ("unicode", "data files and software", "unicode (?:inc )?licen[sc]e agreement data files and software"),
    ("icu", "icu licen", "icu licen[sc]e(?: icu 1 8 1 and later)?"),
    ("hpnd", "historical permission notice", "historical permission notice and disclaimer licen[sc]e"),
    ("blueoak", "blue oak model", "blue oak model licen[sc]e(?: 1 0 0)?"),
    ("mulan", "mulan", "mulan (?:psl|permissive software) licen[sc]e(?: v[12]| version [12])?"),
    ("artistic", "clarified artistic", "clarified artistic licen[sc]e"),
    ("json", "json licen", "json licen[sc]e"),
    ("rpl", "reciprocal public", "reciprocal public licen[sc]e(?: version)?(?: 1 [15])?"),
    ("ogl-canada", "open government", "open government licen[sc]e canada"),
    ("etalab", "etalab", "etalab open licen[sc]e(?: 2 0)?"),
    ("cdla", "community data", "community data licen[sc]e agreement (?:permissive|sharing)"),
    ("cc-by", "attribution 3 0 unported", "creative commons attribution 3 0 unported"),
    ("cc-by", "attribution 2 0 generic", "creative commons attribution 2 0 generic"),
    ("cc-by-sa", "attribution share alike", "creative commons attribution share alike [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nc", "attribution non commercial", "creative commons attribution non commercial [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nd", "attribution no deriv", "creative commons attribution no deriv(?:ative)?s [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-nc-sa", "non commercial share alike", "creative commons attribution non commercial share alike [1-4] [05](?: international| unported| generic)?"),
    ("cc-by-sa", "cc by sa", "spdx licen[sc]e identifier cc by sa [1-4] [05]"),
    ("cc0", "waived all copyright", "to the extent possible under law (?:the )?authors? (?:has|have) waived all copyright"),
    ("openrail", "responsible ai", "responsible ai licen[sc]es?"),
    ("falcon", "falcon", "falcon (?:llm|180b tii) licen[sc]e"),
    ("llama", "llama 2 is licen", "llama 2 is licen[sc]ed under the llama 2 community licen[sc]e"),
    ("proprietary", "may not be reproduced", "may not be reproduced (?:or distributed )?without (?:the )?prior written permission of the copyright (?:holder|owner)"),
    ("proprietary", "no part of this", "no part of this (?:publication|book|document) may be reproduced (?:or transmitted )?in any form without permission of the copyright (?:holder|owner)"),
    ("proprietary", "commercial licen", "requires a commercial licen[sc]e"),
    ("proprietary", "unpublished work", "this is an unpublished work protected (?:under|by) copyright laws?"),
    ("proprietary", "for evaluation", "licen[sc]ed for evaluation (?:purposes )?only"),
    ("proprietary", "for personal", "licen[sc]ed for personal (?:and )?non ?commercial use only"),
    ("proprietary", "do not redistribute", "confidential do not redistribute"),
    ("academic-use", "non commercial research", "licen[sc]ed for non commercial research (?:purposes|use) only"),
    ("shareware", "shareware", "shareware licen[sc]e agreement"),
    ("freeware", "freeware", "freeware licen[sc]e(?: agreement)?"),
    ("dual-license", "dual licen", "dual licen[sc]ed under (?:the )?(?:mit|gpl|bsd|apache)"),
    ("dual-license", "at your option", "licen[sc]ed under either of apache licen[sc]e version 2 0 or mit licen[sc]e at your option"),
    ("dual-license", "tri licen", "mpl gpl lgpl tri licen[sc]e"),
    ("warranty-disclaimer", "authors or copyright holders", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("copyright", "protected by copyright", "protected by copyright and (?:related|neighbou?ring) rights"),
    ("copyright", "filecopyrighttext", "spdx filecopyrighttext"),
    ("public-domain", "released", "(?:hereby |has been )?released (?:to|into) the public domain"),
    ("public-domain", "dedicated to the public", "dedicated to the public domain by"),
    ("public-domain", "united states government", "work of the united states government and is not subject to copyright protection"),
    ("public-domain", "not copyrighted", "this (?:file|software|work) is not copyrighted"),
    ("sqlite", "disclaims copyright", "the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("nist", "nist software", "nist software licen[sc]e"),
    ("cern-ohl", "cern open hardware", "cern open hardware licen[sc]e(?: version)?(?: 1 [12]| 2)?"),
    ("tapr", "tapr", "tapr open hardware licen[sc]e"),
    ("solderpad", "solderpad", "solderpad hardware licen[sc]e"),
    ("opl", "open publication", "open publication licen[sc]e(?: version 1 0| v1 0)?"),
    ("dsl", "design science", "design science licen[sc]e"),
    ("fal", "free art", "free art licen[sc]e(?: 1 [23])?"),
    ("gust", "gust font", "gust font licen[sc]e"),
    ("bitstream-vera", "bitstream vera", "bitstream vera (?:fonts )?copyright"),
    ("ubuntu-font", "ubuntu font", "ubuntu font licen[sc]e(?: version)?(?: 1 0)?"),
    ("rsa-md", "message digest algorithm", "licen[sc]e to copy and use this software is granted provided that it is identified as the rsa data security inc md[45] message digest algorithm"),
    ("ietf", "ietf trust", "copyright (?:c )?(?:19|20)[0-9][0-9] ietf trust and the persons identified as the document authors"),
)
NOTICE_PRIORITY, NOTICE_CONFIDENCE = 77, 0.9


def rules() -> list[tuple[int, str, int, float, str, str]]:
    """rule number, label, priority, confidence, keyword, regular expression: families x phrasings, then bodies and notices,
    in order."""
    out = []
    for label, priority, keyword, names, versions in FAMILIES:
        for phrasing, more, confidence in PHRASINGS:
            if "{version}" in phrasing and not versions:
                continue
            version = "(?:" + "|".join(sorted(versions, key=len, reverse=True)) + ")" if versions else ""
            for name in names:
                body = phrasing.format(name=name, version=version)
                out.append((len(out), label, priority + more, confidence, keyword, rf"(?<![^ ]){body}(?![^ ])"))
    for label, priority, confidence, keyword, body in (*BODIES, *((label, NOTICE_PRIORITY, NOTICE_CONFIDENCE, keyword, body) for label, keyword, body in NOTICES)):
        out.append((len(out), label, priority, confidence, keyword, rf"(?<![^ ]){body}(?![^ ])"))
    return out


#: What every base phrase and every rule needs somewhere in the raw text.
_GATE = rf"(?i)licen[sc]e|cc{_GAP}by|gpl|bsd{_GAP}|[234]{_GAP}clause|wtfpl|cc0|copyright|public{_GAP}domain|creative{_GAP}commons|all{_GAP}rights"
_GATE += rf"|permission{_GAP}(?:is{_GAP}hereby|to{_GAP}use)|substantial{_GAP}portions|redistribut|endorse{_GAP}or{_GAP}promote|perl{_GAP}itself|compliance{_GAP}with|mozilla|eclipse|artistic|origin{_GAP}of{_GAP}this{_GAP}software"
_GATE += rf"|altered{_GAP}source|unencumbered|fuck{_GAP}you{_GAP}want|waived{_GAP}all|font{_GAP}software|without{_GAP}(?:any{_GAP})?warranty|confidential|unauthorized|advertising{_GAP}materials"


def _base_places(w: Column) -> Column:
    """struct(start, label) for each place of each base phrase."""
    found = []
    for phrase, label in BASE:
        parts = phrase.split()

        def here(x: Column, i: Column, parts: list[str] = parts) -> Column:
            out = x == parts[0]
            for k, p in enumerate(parts[1:], 1):
                out = out & F.coalesce(F.get(w, i + k) == p, F.lit(False))
            return out

        at = F.filter(F.transform(w, lambda x, i: F.when(here(x, i), i)), lambda x: x.isNotNull())
        found.append((at, label))
    return F.concat(*(_labelled(at, label) for at, label in found))


def _labelled(at: Column, label: str) -> Column:
    return F.transform(at, lambda x: F.struct(x.cast("long").alias("start"), F.lit(label).alias("label")))


def _hits(norm: Column, active: Column) -> Column:
    """struct(start, end, label, priority, confidence, rule) of all matches of the active rules, in code points."""
    def spans(r: Column) -> Column:
        return F.transform(common.matches(norm, r["pattern"]), lambda x: F.struct(x["start"], x["end"], r["label"], r["priority"], r["confidence"], r["rule"]))

    return F.flatten(F.transform(active, spans))


def _beats(g: Column, h: Column) -> Column:
    """Whether hit g lies around hit h and takes its place."""
    length = (g["end"] - g["start"]) - (h["end"] - h["start"])
    first = (g["priority"] > h["priority"]) | ((g["priority"] == h["priority"]) & ((length > 0) | ((length == 0) & (g["rule"] < h["rule"]))))
    return (g["start"] <= h["start"]) & (g["end"] >= h["end"]) & first


def _suppressed(hits: Column) -> Column:
    """The hits without those that another one beats.

    Sorted by start, then the longer, the higher priority and the earlier rule first, a hit is only beaten by earlier
    ones that start no further back than the longest hit reaches; their number is where the search begins.
    """
    def order(h: Column) -> Column:
        return F.struct(h["start"].alias("a"), (-h["end"]).alias("b"), (-h["priority"]).alias("c"), h["rule"].alias("d"), h.alias("h"))

    def judged(h: Column) -> Column:
        def with_longest(longest: Column) -> Column:
            starts = F.transform(h, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("hit")))
            reach = F.transform(h, lambda x: F.struct((x["start"] - longest).alias("at"), F.lit(0).alias("hit")))
            return common.let(F.sort_array(F.concat(starts, reach)), found)

        def found(m: Column) -> Column:
            counts = common.scanned(F.transform(m, lambda x: x["hit"]), lambda a, b: a + b)
            first = F.transform(F.filter(F.arrays_zip(m.alias("m"), counts.alias("n")), lambda x: x["m"]["hit"] == 0), lambda x: x["n"])
            both = F.arrays_zip(h.alias("h"), first.alias("n"))
            stays = F.filter(both, lambda x, i: (x["n"] == i) | ~F.exists(F.sequence(x["n"], F.greatest(x["n"], i - 1)), lambda k: _beats(F.get(h, k), x["h"])))
            return F.transform(stays, lambda x: x["h"])

        return common.let(F.array_max(F.transform(h, lambda x: x["end"] - x["start"])), with_longest)

    ordered = F.transform(F.sort_array(F.transform(hits, order)), lambda x: x["h"])
    return F.when(F.size(hits) > 1, common.let(ordered, judged)).otherwise(hits)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct `licence`: n_words, n_base, first_word, last_word, base_labels, labels, score, hits."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    t = F.coalesce(F.col(text), F.lit(""))
    names = ("rule", "label", "priority", "confidence", "keyword", "pattern")
    table = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rules()])), "array<struct<rule int, label string, priority int, confidence double, keyword string, pattern string>>")
    out = docs.withColumn("_t", F.when(t.rlike(_GATE), F.translate(t, upper, lower)).otherwise(F.lit("")))
    out = out.withColumn("_w", F.array_remove(F.split("_t", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""))
    out = out.withColumns({"_norm": F.array_join("_w", " "), "_base": _base_places(F.col("_w"))})
    out = out.withColumn("_active", F.when(F.col("_norm") != "", F.filter(table, lambda r: F.contains(F.col("_norm"), r["keyword"]))).otherwise(F.filter(table, lambda r: F.lit(False))))
    out = out.withColumn("_hits", _hits(F.col("_norm"), F.col("_active")))
    out = out.withColumn("_hits", _suppressed(F.col("_hits")))
    starts = F.transform("_base", lambda x: x["start"])
    base = F.transform("_base", lambda x: x["label"])
    licence = F.struct(
        F.regexp_count(t, F.lit(_RAW_WORD)).cast("long").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("_hits", lambda h: h["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_hits", lambda h: h["confidence"])), F.when(F.size("_base") > 0, 0.5), F.lit(0.0)).alias("score"),
        F.col("_hits").alias("hits"),
    )
    return out.withColumn("licence", licence).drop("_t", "_w", "_norm", "_base", "_active", "_hits")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f"licence.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


QUERIES = {"op4_license_scans": op4_license_scans}
ORACLES: dict[str, str] = {}
