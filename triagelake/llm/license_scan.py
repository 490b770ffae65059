"""License scans: ordered signature rules behind a keyword prefilter, with priority and interval containment.

A text becomes its lower-cased words (``WORD``) joined by single blanks; every rule is a regular expression over that form and so
finds an interval of words. Rules come from hand-written signatures: notices (whole sentences of a license text), and for each
license of ``LICENSES`` its tag, grant, heading, address and name forms. Each rule has a priority (lower is stronger) and
keywords of which every match holds one; only rules of which a keyword occurs are run, and only texts with any trigger word are looked at beyond counting words.
Both only save work: tests hold the results with and without them against each other for every rule.
A detection is dropped when its interval lies within one of a stronger rule (or of an earlier, longer one of the same rank).

Base places (``BASE``) are always reported, whatever the rules say. ``score`` is 1 - product(1 - weight) over the kept detections,
0 where there is none.

Cases: null text is the empty text (0 words, no labels, score 0). Places count repeats and overlaps. Whole texts are scanned, each
in one step; work is linear in their length for each rule run. Rows stand alone, so ties, repeats and empty tables need no rule;
only the id and text columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, filled, slices

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Fixed phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: (label, keywords of which every name holds one, names as words): a name may hold alternatives; versions follow in the label's own words.
LICENSES = (
    ("mit", "mit|expat|x11", r"(?:the )?(?:mit|expat|x11)(?: style| x11| expat)? licen[sc]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?|mit 0(?: licen[sc]e)?"),
    ("apache-1.0", "apache", r"apache (?:software )?licen[sc]e(?: version| v)? 1 0|apache 1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e(?: version| v)? 1 1|apache 1 1"),
    ("apache-2.0", "apache|asl", r"apache (?:software )?licen[sc]e(?: version| v)? (?:2 0|v?2)|apache 2 0|asl 2 0"),
    ("gpl-1.0", "gpl|general", r"(?:gnu )?general public licen[sc]e(?: gpl)?(?: version| v)? (?:1 0|v?1)|gpl ?v?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl|general", r"(?:gnu )?general public licen[sc]e(?: gpl)?(?: version| v)? (?:2 0|v?2)|gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl|general", r"(?:gnu )?general public licen[sc]e(?: gpl)?(?: version| v)? (?:3 0|v?3)|gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.0", "lgpl|library", r"(?:gnu )?library general public licen[sc]e(?: version| v)? (?:2 0|v?2)|lgpl ?v?2(?: 0)?"),
    ("lgpl-2.1", "lgpl|lesser", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? 2 1|lgpl ?v?2 1"),
    ("lgpl-3.0", "lgpl|lesser", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? (?:3 0|v?3)|lgpl ?v?3(?: 0)?"),
    ("agpl-3.0", "agpl|affero", r"(?:gnu )?affero general public licen[sc]e(?: version| v)? (?:3 0|v?3)|agpl ?v?3(?: 0)?"),
    ("gfdl-1.1", "gfdl|documentation", r"(?:gnu )?free documentation licen[sc]e(?: version| v)? 1 1|gfdl 1 1"),
    ("gfdl-1.2", "gfdl|documentation", r"(?:gnu )?free documentation licen[sc]e(?: version| v)? 1 2|gfdl 1 2"),
    ("gfdl-1.3", "gfdl|documentation", r"(?:gnu )?free documentation licen[sc]e(?: version| v)? 1 3|gfdl 1 3"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3 clause|three clause) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?"),
    ("0bsd", "bsd", r"(?:zero clause|0 clause) bsd(?: licen[sc]e)?|0bsd"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("mpl-1.0", "mpl|mozilla", r"mozilla public licen[sc]e(?: version| v)? 1 0|mpl 1 0"),
    ("mpl-1.1", "mpl|mozilla", r"mozilla public licen[sc]e(?: version| v)? 1 1|mpl 1 1"),
    ("mpl-2.0", "mpl|mozilla", r"mozilla public licen[sc]e(?: version| v)? (?:2 0|v?2)|mpl 2 0"),
    ("epl-1.0", "epl|eclipse", r"eclipse public licen[sc]e(?: version| v)? (?:1 0|v?1)|epl 1 0"),
    ("epl-2.0", "epl|eclipse", r"eclipse public licen[sc]e(?: version| v)? (?:2 0|v?2)|epl 2 0"),
    ("cddl-1.0", "cddl|common", r"common development and distribution licen[sc]e(?: version| v)? 1 0|cddl 1 0"),
    ("cddl-1.1", "cddl|common", r"common development and distribution licen[sc]e(?: version| v)? 1 1|cddl 1 1"),
    ("cpl-1.0", "cpl|common", r"common public licen[sc]e(?: version| v)? 1 0|cpl 1 0"),
    ("eupl-1.1", "eupl|european", r"european union public licen[sc]e(?: version| v)? 1 1|eupl 1 1"),
    ("eupl-1.2", "eupl|european", r"european union public licen[sc]e(?: version| v)? 1 2|eupl 1 2"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?"),
    *((f"cc-{kind}-{version}", "cc|creative", rf"(?:cc|creative commons) {words}(?: licen[sc]e)?(?: version)? {version.replace('.', ' ')}(?: international| unported| generic)?") for kind, words in (("by", r"(?:by|attribution)"), ("by-sa", r"(?:by sa|attribution share ?alike)"), ("by-nd", r"(?:by nd|attribution no ?deriv(?:ative)?s)"), ("by-nc", r"(?:by nc|attribution non ?commercial)"), ("by-nc-sa", r"(?:by nc sa|attribution non ?commercial share ?alike)"), ("by-nc-nd", r"(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)")) for version in ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("odbl-1.0", "odbl|open", r"open (?:data commons )?(?:open )?database licen[sc]e(?: odbl)?(?: v?1 0)?|odbl(?: v?1 0)?"),
    ("odc-by-1.0", "odc|open", r"open data commons attribution licen[sc]e(?: v?1 0)?|odc by(?: v?1 0)?"),
    ("pddl-1.0", "pddl|public", r"open data commons public domain dedication(?: and licen[sc]e)?|pddl(?: v?1 0)?"),
    ("ogl-uk-3.0", "open", r"open government licen[sc]e(?: v?3 0| version 3 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl|do what", r"wtfpl|do what the fuck you want to public licen[sc]e"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e(?: version 2)?"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e(?: version| v)? 1 0|artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?: version| v)? 2 0|artistic 2 0"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business", r"business source licen[sc]e(?: version)?(?: 1 1)?"),
    ("sspl-1.0", "server", r"server side public licen[sc]e(?: version| v)?(?: 1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: version)?(?: 2 0)?"),
    ("ofl-1.1", "ofl|font", r"(?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?|ofl 1 1"),
    ("afl-3.0", "academic", r"academic free licen[sc]e(?: version| v)?(?: 3 0)?"),
    ("osl-3.0", "open", r"open software licen[sc]e(?: version| v)?(?: 3 0)?"),
    ("upl-1.0", "universal", r"universal permissive licen[sc]e(?: version| v)?(?: 1 0)?"),
    ("psf-2.0", "psf|python", r"python software foundation licen[sc]e(?: version)?(?: 2)?|psf licen[sc]e"),
    ("php-3.01", "php", r"php licen[sc]e(?: version)?(?: 3 01)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("ncsa", "ncsa|illinois", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("ms-pl", "ms pl|microsoft", r"microsoft public licen[sc]e|ms pl"),
    ("ms-rl", "ms rl|microsoft", r"microsoft reciprocal licen[sc]e|ms rl"),
    ("intel", "intel", r"intel open source licen[sc]e"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("tcl", "tcl", r"tcl(?: tk)? licen[sc]e"),
    ("openldap", "openldap", r"openldap public licen[sc]e(?: version)?(?: 2 8)?"),
    ("mulan-2.0", "mulan", r"mulan (?:permissive software|psl) licen[sc]e(?: v2| version 2)?|mulanpsl 2 0"),
    ("cecill-2.1", "cecill", r"cecill(?: free software)? licen[sc]e(?: agreement)?(?: 2 1)?|cecill 2 1"),
    ("openrail", "rail|responsible", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)?|responsible ai licen[sc]e"),
)

#: (label, priority, weight, keyword, regex over words): sentences of the license texts themselves, and marks without a license's name.
NOTICES = (
    ("mit", 0, 0.99, "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 0, 0.95, "copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", 0, 0.97, "permission", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 0, 0.95, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 1, 0.8, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 1, 0.8, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 0, 0.9, "endorse", r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", 0, 0.9, "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", 0, 0.99, "compliance", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2.0", 1, 0.85, "writing", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", 0, 0.95, "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 1, 0.7, "program", r"you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", 0, 0.95, "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", 1, 0.9, "affero", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", 0, 0.95, "permission", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", 0, 0.98, "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", 0, 0.95, "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", 0, 0.98, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", 4, 0.7, "public", r"(?:released|dedicated|placed) (?:in|into|to) the public domain|in the public domain|public domain dedication"),
    ("zlib", 0, 0.95, "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", 0, 0.95, "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("wtfpl", 0, 0.95, "copy", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("gpl", 1, 0.8, "copy", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("cc", 3, 0.7, "creative", r"licensed under a creative commons licen[sc]e|creative commons licen[sc]e"),
    ("cc-by-sa", 2, 0.85, "creative", r"text is available under the creative commons attribution share ?alike licen[sc]e"),
    ("proprietary", 5, 0.6, "rights", r"all rights reserved"),
    ("proprietary", 4, 0.75, "reproduced", r"no part of this (?:publication|work|document|book) may be reproduced"),
    ("proprietary", 4, 0.75, "confidential", r"(?:strictly )?(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 4, 0.75, "permission", r"(?:reproduction|redistribution|copying) (?:in whole or in part )?without (?:prior )?(?:written )?permission (?:is )?(?:strictly )?prohibited"),
    ("no-derivatives", 4, 0.6, "derivative", r"no derivative works? (?:are )?(?:permitted|allowed)"),
    ("non-commercial", 4, 0.6, "commercial", r"(?:for )?non ?commercial use only|not for commercial use"),
    ("copyright", 6, 0.4, "copyright", r"copyright(?: c| ©)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("warranty-disclaimer", 6, 0.4, "warrant", r"without warranty of any kind(?: express or implied)?|without warranties or conditions of any kind"),
    ("gpl", 3, 0.8, "gnu", r"gnu general public licen[sc]e|gnu gpl"),
    ("lgpl", 3, 0.8, "lesser", r"gnu lesser general public licen[sc]e"),
    ("agpl", 3, 0.8, "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("apache", 3, 0.8, "apache", r"apache (?:software )?licen[sc]e"),
    ("bsd", 3, 0.75, "bsd", r"bsd(?: style| type)? licen[sc]e"),
    ("mozilla", 3, 0.75, "mozilla", r"mozilla public licen[sc]e"),
    ("unknown-license", 6, 0.3, "licen", r"(?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |an? )?(?:[^ ]+ ){1,5}licen[sc]e"),
)

#: More sentences and names, in the same form.
MORE_NOTICES = (
    ("mit", 0, 0.95, "sublicense", r"without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit-0", 0, 0.96, "sublicense", r"distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("mit", 1, 0.8, "furnished", r"to permit persons to whom the software is furnished to do so"),
    ("mit", 1, 0.8, "noninfringement", r"merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable"),
    ("x11", 0, 0.95, "consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("hpnd", 0, 0.9, "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("ntp", 0, 0.9, "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("hpnd", 1, 0.8, "pertaining", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("isc", 1, 0.8, "disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("0bsd", 0, 0.97, "disclaims", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties"),
    ("curl", 0, 0.9, "provided", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("bsl-1.0", 1, 0.85, "executable", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("bsd-2-clause", 1, 0.8, "conclusions", r"the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd", 1, 0.75, "exemplary", r"direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    ("bsd-3-clause", 1, 0.85, "contributors", r"neither the name of the copyright holder nor the names of (?:its|the) contributors may be used"),
    ("bsd-3-clause", 1, 0.85, "university", r"neither the name of the university nor the names of its contributors may be used"),
    ("bsd-3-clause-clear", 0, 0.9, "patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-4-clause", 1, 0.85, "berkeley", r"this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-source-code", 1, 0.7, "modified", r"modified versions of the source code must be plainly marked"),
    ("apache-2.0", 1, 0.9, "apache", r"you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2.0", 1, 0.85, "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", 1, 0.85, "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2.0", 2, 0.75, "licensor", r"licensor provides the work and each contributor provides its contributions on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", 0, 0.95, "contributor", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 0, 0.95, "foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", 1, 0.85, "apache", r"products derived from this software may not be called apache nor may apache appear in their name"),
    ("gpl-2.0", 0, 0.85, "later", r"either version 2 of the license or at your option any later version"),
    ("gpl-3.0", 0, 0.85, "later", r"either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", 0, 0.9, "later", r"either version 2 1 of the license or at your option any later version"),
    ("gpl", 1, 0.8, "program", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", 1, 0.8, "library", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 1, 0.8, "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", 1, 0.9, "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", 0, 0.95, "copyleft", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", 1, 0.85, "remotely", r"your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("lgpl-3.0", 1, 0.85, "convey", r"you may convey a combined work under terms of your choice that taken together effectively do not restrict modification of the portions of the library"),
    ("gpl-with-classpath-exception", 0, 0.95, "statically", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("gpl-with-linking-exception", 1, 0.85, "exception", r"as a special exception (?:the copyright holders of this library give|you may link|if you link)"),
    ("gpl-with-autoconf-exception", 0, 0.9, "autoconf", r"as a special exception .{0,120}?configuration script generated by autoconf"),
    ("gpl-with-bison-exception", 0, 0.9, "bison", r"you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-with-font-exception", 0, 0.9, "unaltered", r"if you create a document which uses this font and embed this font or unaltered portions of this font into the document"),
    ("gpl-with-gcc-exception", 0, 0.9, "runtime", r"gcc runtime library exception"),
    ("gfdl", 1, 0.85, "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1.1", 0, 0.95, "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 1, 0.9, "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0"),
    ("mpl-2.0-no-copyleft-exception", 0, 0.96, "incompatible", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0"),
    ("cddl", 0, 0.95, "common", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", 0, 0.95, "common", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("epl-1.0", 0, 0.96, "eclipse", r"made available under the terms of the eclipse public license v ?1 0"),
    ("epl-2.0", 0, 0.96, "eclipse", r"made available under the terms of the eclipse public license v? ?2 0"),
    ("epl", 1, 0.8, "recipient", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("ipl-1.0", 2, 0.85, "ibm", r"ibm public licen[sc]e(?: version 1 0)?"),
    ("apsl-2.0", 2, 0.85, "apple", r"apple public source licen[sc]e(?: version 2 0)?"),
    ("npl-1.1", 2, 0.85, "netscape", r"netscape public licen[sc]e(?: version 1 1)?"),
    ("sun-pl-1.0", 2, 0.85, "sun", r"sun public licen[sc]e(?: version 1 0)?"),
    ("sissl", 2, 0.85, "standards", r"sun industry standards source licen[sc]e"),
    ("rpsl-1.0", 2, 0.85, "realnetworks", r"realnetworks public source licen[sc]e"),
    ("qpl-1.0", 2, 0.85, "public", r"q public licen[sc]e(?: version 1 0)?"),
    ("lpl-1.02", 2, 0.85, "lucent", r"lucent public licen[sc]e(?: version 1 02)?"),
    ("nokia", 2, 0.85, "nokia", r"nokia open source licen[sc]e"),
    ("zpl-2.1", 2, 0.85, "zope", r"zope public licen[sc]e(?: zpl)?(?: version 2 1)?"),
    ("python-cnri", 2, 0.85, "cnri", r"cnri (?:open source )?licen[sc]e(?: agreement)?"),
    ("w3c", 0, 0.9, "licensee", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("unicode", 0, 0.95, "unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("zlib", 1, 0.85, "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", 1, 0.85, "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", 0, 0.9, "png", r"the png reference library is supplied as is"),
    ("libtiff", 0, 0.9, "leffler", r"the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("ijg", 0, 0.95, "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", 0, 0.9, "freetype", r"portions of this software are copyright .{0,60}?the freetype project"),
    ("openssl", 0, 0.95, "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 0, 0.95, "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("info-zip", 2, 0.85, "zip", r"info zip licen[sc]e"),
    ("bzip2", 2, 0.85, "bzip2", r"bzip2 licen[sc]e"),
    ("vim", 1, 0.85, "unmodified", r"there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", 0, 0.9, "regents", r"this software is copyrighted by the regents of the university of california sun microsystems"),
    ("ruby", 0, 0.9, "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("artistic-1.0", 0, 0.92, "semblance", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", 1, 0.85, "gratis", r"you may distribute your modified version as source either gratis or for a distributor fee"),
    ("perl", 0, 0.9, "perl", r"this (?:library|program|module) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("php", 1, 0.85, "php", r"this product includes php software freely available from"),
    ("postgresql", 1, 0.8, "university", r"in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ofl-1.1", 0, 0.96, "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 1, 0.85, "reserved", r"with reserved font name"),
    ("ubuntu-font-1.0", 2, 0.85, "ubuntu", r"ubuntu font licen[sc]e(?: version)?(?: 1 0)?"),
    ("bitstream-vera", 0, 0.95, "fonts", r"permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license"),
    ("lppl-1.3c", 0, 0.95, "latex", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("lppl", 2, 0.85, "latex", r"latex project public licen[sc]e"),
    ("cc0-1.0", 0, 0.95, "waived", r"to the extent possible under law .{0,200}?(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", 0, 0.96, "creative", r"this work is licensed under (?:a |the )?creative commons attribution 4 0 international licen[sc]e"),
    ("cc-by-sa-4.0", 0, 0.96, "creative", r"this work is licensed under (?:a |the )?creative commons attribution share ?alike 4 0 international licen[sc]e"),
    ("cc-by-nc-4.0", 0, 0.96, "creative", r"this work is licensed under (?:a |the )?creative commons attribution non ?commercial 4 0 international licen[sc]e"),
    ("cc-by-nc-sa-4.0", 0, 0.96, "creative", r"this work is licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike 4 0 international licen[sc]e"),
    ("cc-by-nc-nd-4.0", 0, 0.96, "creative", r"this work is licensed under (?:a |the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0 international licen[sc]e"),
    ("cc-by-nd-4.0", 0, 0.96, "creative", r"this work is licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s 4 0 international licen[sc]e"),
    ("cc-by-3.0", 0, 0.95, "creative", r"this work is licensed under (?:a |the )?creative commons attribution 3 0 unported licen[sc]e"),
    ("cc-by-sa-3.0", 0, 0.95, "creative", r"this work is licensed under (?:a |the )?creative commons attribution share ?alike 3 0 unported licen[sc]e"),
    ("public-domain", 1, 0.85, "dedicate", r"dedicate any and all copyright interest in (?:this|the) (?:software|code|work) to the public domain"),
    ("unlicense", 0, 0.95, "jurisdictions", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("blessing", 0, 0.95, "blessing", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing"),
    ("beerware", 0, 0.95, "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", 0, 0.9, "evil", r"the software shall be used for good not evil"),
    ("wtfpl", 1, 0.85, "fuck", r"you just do what the fuck you want to"),
    ("odbl-1.0", 0, 0.95, "database", r"this .{0,80}?database is made available under the open database licen[sc]e"),
    ("odbl-1.0", 2, 0.7, "openstreetmap", r"openstreetmap contributors"),
    ("odc-by-1.0", 0, 0.95, "commons", r"made available under the open data commons attribution licen[sc]e"),
    ("pddl-1.0", 0, 0.95, "dedication", r"made available under the (?:open data commons )?public domain dedication and licen[sc]e"),
    ("ogl-uk-3.0", 0, 0.96, "government", r"contains public sector information licensed under the open government licen[sc]e v3 0"),
    ("crown-copyright", 3, 0.6, "crown", r"crown copyright(?: and database rights?)?"),
    ("cdla-permissive", 2, 0.9, "community", r"community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing", 2, 0.9, "community", r"community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?"),
    ("busl-1.1", 0, 0.95, "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl-1.1", 1, 0.85, "anniversary", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("sspl-1.0", 1, 0.85, "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("elastic-2.0", 1, 0.85, "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 0, 0.9, "clause", r"commons clause licen[sc]e condition(?: v?1 0)?"),
    ("commons-clause", 1, 0.85, "sell", r"the licen[sc]e does not grant to you the right to sell the software"),
    ("polyform-noncommercial", 2, 0.9, "polyform", r"polyform non ?commercial licen[sc]e(?: 1 0 0)?"),
    ("polyform-small-business", 2, 0.9, "polyform", r"polyform small business licen[sc]e(?: 1 0 0)?"),
    ("polyform-strict", 2, 0.9, "polyform", r"polyform strict licen[sc]e(?: 1 0 0)?"),
    ("polyform-shield", 2, 0.9, "polyform", r"polyform shield licen[sc]e(?: 1 0 0)?"),
    ("llama-2", 2, 0.9, "llama", r"llama 2 community licen[sc]e(?: agreement)?"),
    ("llama-3", 2, 0.9, "llama", r"(?:meta )?llama 3(?: [123])? community licen[sc]e(?: agreement)?"),
    ("gemma", 2, 0.85, "gemma", r"gemma terms of use"),
    ("openrail", 1, 0.85, "restrictions", r"use based restrictions as referenced in paragraph 5"),
    ("cern-ohl-s-2.0", 2, 0.9, "cern", r"cern open hardware licen[sc]e(?: version 2)? strongly reciprocal"),
    ("cern-ohl-w-2.0", 2, 0.9, "cern", r"cern open hardware licen[sc]e(?: version 2)? weakly reciprocal"),
    ("cern-ohl-p-2.0", 2, 0.9, "cern", r"cern open hardware licen[sc]e(?: version 2)? permissive"),
    ("solderpad", 2, 0.85, "solderpad", r"solderpad hardware licen[sc]e(?: v(?:ersion)? ?[02] 51?)?"),
    ("tapr-ohl", 2, 0.85, "tapr", r"tapr open hardware licen[sc]e"),
    ("ecl-2.0", 2, 0.85, "educational", r"educational community licen[sc]e(?: version 2 0)?"),
    ("entessa", 2, 0.85, "entessa", r"entessa public licen[sc]e"),
    ("frameworx", 2, 0.85, "frameworx", r"frameworx open licen[sc]e"),
    ("watcom-1.0", 2, 0.85, "watcom", r"sybase open watcom public licen[sc]e(?: version 1 0)?"),
    ("nasa-1.3", 2, 0.85, "nasa", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("cua-opl-1.0", 2, 0.85, "cua", r"cua office public licen[sc]e"),
    ("rpl-1.5", 2, 0.85, "reciprocal", r"reciprocal public licen[sc]e(?: version)?(?: 1 5)?"),
    ("cpal-1.0", 2, 0.85, "common", r"common public attribution licen[sc]e(?: version)?(?: 1 0)?"),
    ("oclc-2.0", 2, 0.85, "oclc", r"oclc research public licen[sc]e(?: 2 0)?"),
    ("motosoto", 2, 0.85, "motosoto", r"motosoto open source licen[sc]e"),
    ("naumen", 2, 0.85, "naumen", r"naumen public licen[sc]e"),
    ("sleepycat", 2, 0.85, "sleepycat", r"sleepycat licen[sc]e"),
    ("simpl-2.0", 2, 0.85, "simple", r"simple public licen[sc]e(?: 2 0)?"),
    ("xnet", 2, 0.85, "x net", r"x net licen[sc]e"),
    ("vsl-1.0", 2, 0.85, "vovida", r"vovida software licen[sc]e(?: v ?1 0)?"),
    ("wxwindows", 2, 0.85, "wxwindows", r"wxwindows library licen[sc]e"),
    ("ucl-1.0", 2, 0.85, "upstream", r"upstream compatibility licen[sc]e(?: v ?1 0)?"),
    ("miros", 2, 0.85, "miros", r"miros licen[sc]e"),
    ("fair", 0, 0.9, "instrument", r"usage of the works is permitted provided that this instrument is retained with the works"),
    ("catosl-1.1", 2, 0.85, "trusted", r"computer associates trusted open source licen[sc]e(?: 1 1)?"),
    ("lal-1.3", 2, 0.85, "free art", r"free art licen[sc]e(?: 1 3)?"),
    ("dsl", 2, 0.85, "science", r"design science licen[sc]e"),
    ("opl-1.0", 2, 0.85, "publication", r"open publication licen[sc]e(?: v ?1 0)?"),
    ("ogtsl", 2, 0.85, "test suite", r"open group test suite licen[sc]e"),
    ("multics", 2, 0.85, "multics", r"multics licen[sc]e"),
    ("proprietary", 4, 0.75, "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|material|work|software)(?: via any medium)? is (?:strictly )?prohibited"),
    ("proprietary", 4, 0.7, "confidential", r"this (?:software|document|file) contains confidential (?:and|or) proprietary information"),
    ("proprietary", 4, 0.7, "user", r"end user licen[sc]e agreement"),
    ("proprietary", 4, 0.65, "written", r"without the (?:prior |express )?written permission of (?:the )?(?:copyright (?:owner|holder)|publisher|author)"),
    ("trademark", 6, 0.3, "trademark", r"(?:is a |are )?(?:registered )?trademarks? of"),
    ("patent", 6, 0.3, "patent", r"patents? pending|protected by (?:one or more )?(?:us )?patents?"),
    ("attribution-required", 4, 0.6, "attribution", r"attribution (?:is )?required"),
    ("educational-use", 4, 0.6, "educational", r"(?:for )?(?:non ?profit )?educational (?:and (?:research|personal) )?(?:use|purposes) only"),
    ("research-only", 4, 0.6, "research", r"(?:for )?(?:academic |non ?commercial )?research (?:use|purposes) only"),
    ("personal-use", 4, 0.6, "personal", r"(?:for )?(?:your )?personal (?:non ?commercial )?use only"),
    ("free-commercial-use", 5, 0.5, "free", r"free (?:for|to use for) (?:personal and commercial|commercial and personal|commercial) use"),
    ("no-redistribution", 4, 0.65, "redistribut", r"(?:may|must) not (?:be )?redistributed?|redistribution is (?:not permitted|prohibited)"),
    ("no-commercial", 4, 0.65, "commercial", r"commercial (?:use|exploitation|distribution) is (?:not (?:permitted|allowed)|(?:strictly )?prohibited|forbidden)"),
    ("ai-training-reserved", 4, 0.7, "mining", r"(?:rights? )?(?:to|for) text and data mining (?:is|are) (?:expressly )?reserved|text and data mining is prohibited"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


def _rules() -> list[Rule]:
    """The rules in order: notices, then each license's tag, grant, heading, address and name."""
    whole = lambda body: re.compile(rf"(?<![^ ])(?:{body})(?![^ ])")
    rules = [Rule(label, priority, weight, (keyword,), whole(body)) for label, priority, weight, keyword, body in (*NOTICES, *MORE_NOTICES)]
    grant = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|redistributed|shared)(?: to you)? (?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
    for label, keywords, names in LICENSES:
        words = tuple(keywords.split("|"))
        tag = label.replace("-", " ").replace(".", " ")
        rules += [
            Rule(label, 1, 0.98, ("spdx",), whole(rf"spdx licen[sc]e identifier {tag}(?: only| or later)?")),
            Rule(label, 1, 0.95, words, whole(rf"{grant}(?:{names})")),
            Rule(label, 1, 0.9, (*words, tag), whole(rf"licen[sc]e (?:is |as |name )?(?:{tag}|{names})")),
            Rule(label, 2, 0.85, (tag,), whole(rf"(?:https? )?(?:www )?(?:opensource org licenses|spdx org licenses|choosealicense com licenses) {tag}")),
            Rule(label, 3, 0.8, words, whole(names)),
        ]
    return rules


#: A text without any of these holds no rule's match.
TRIGGERS = r"licen[sc]|reproduc|copyright|rights|domain|permi|warrant|redistribut|advertising|confidential|derivative|commercial|creative|spdx|cc0|cc[^a-z0-9]+by|gpl|gfdl|apache|bsd|mpl|epl|cpl|cddl|eupl|mit[^a-z0-9]+0|odbl|odc[^a-z0-9]+by|pddl|wtfpl|asl[^a-z0-9]+2|artistic|ofl|ms[^a-z0-9]+[pr]l|mulanpsl|cecill|rail|neither|gnu|attribution|mozilla|remotely|convey|statically|exception|bison|unaltered|invariant|misrepresent|png|jpeg|openssl|cryptographic|unmodified|verbatim|gratis|perl|php|exemplary|consequential|reserved|blessing|beer|evil|fuck|openstreetmap|anniversary|functionality|hosted|gemma|restrictions|nasa|conclusions|unauthorized|trademark|patent|educational|research|personal|mining|asf|developed|plainly|university"


@lru_cache(1)
def rules() -> tuple[list[Rule], list[str]]:
    found = _rules()
    return found, sorted({k for r in found for k in r.keywords})


def detections(words: list[str]) -> list[tuple[int, int, Rule]]:
    """(first word, end, rule) of what the rules find, after priority and containment."""
    joined = " ".join(words)
    every, keywords = rules()
    there = {k for k in keywords if k in joined}
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    found = []
    for rank, rule in enumerate(every):
        if there.isdisjoint(rule.keywords):
            continue
        for m in rule.pattern.finditer(joined):
            found.append((bisect_right(ends, m.start()), bisect_right(ends, m.end() - 1) + 1, rank))
    # Stronger first, then longer; an interval inside one that is kept goes. Kept intervals by start, with the farthest end so far.
    found.sort(key=lambda x: (every[x[2]].priority, x[0] - x[1], x[2], x[0]))
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    far: list[int] = []
    for a, b, rank in found:
        at = bisect_right(starts, a)
        if at and far[at - 1] >= b:
            continue
        kept.append((a, b, every[rank]))
        starts.insert(at, a)
        far.insert(at, max(b, far[at - 1] if at else 0))
        for i in range(at + 1, len(far)):
            if far[i] >= b:
                break
            far[i] = b
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].label))


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    places = []
    for phrase, label in BASE:
        parts = phrase.split()
        places += [(i - len(parts) + 1, label) for i, w in enumerate(words) if w == parts[-1] and i >= len(parts) - 1 and words[i - len(parts) + 1 : i] == parts[:-1]]
    return sorted(places)


def scan_text(lowered: str) -> dict:
    """What one text holds: base places, kept detections, labels and score."""
    words = WORD.findall(lowered)
    places, kept = base_places(words), detections(words)
    score = 1.0
    for _, _, rule in kept:
        score *= 1 - rule.weight
    base = sorted({label for _, label in places})
    return {"n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None, "base_labels": ",".join(base), "labels": ",".join(sorted({*base, *(r.label for _, _, r in kept)})), "score": max(0.9 if base else 0.0, 1 - score), "spans": [{"label": r.label, "start": a, "end": b, "priority": r.priority} for a, b, r in kept]}


_WORD_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,priority:int>>"


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text, from the kinds of its UTF-8 bytes."""
    raw, offsets = buffers(texts)
    inside = _WORD_BYTE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    starts[edges] = inside[edges]
    return np.diff(np.concatenate(([0], np.cumsum(starts)))[offsets])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each document: words, base places, labels, score and the spans (in words) of the kept detections."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("priority", pa.int32())]))
        for batch in batches:
            for part in slices(batch):
                texts = pc.ascii_lower(filled(part.column("text")))
                hit = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, TRIGGERS)))
                out = {"n_base": [0] * len(texts), "first_word": [None] * len(texts), "last_word": [None] * len(texts), "base_labels": [""] * len(texts), "labels": [""] * len(texts), "score": [0.0] * len(texts), "spans": [[] for _ in range(len(texts))]}
                for i in hit.tolist():
                    for name, value in scan_text(texts[i].as_py()).items():
                        out[name][i] = value
                types = {"n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": kind}
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(word_counts(texts)), *(pa.array(out[n], t) for n, t in types.items())], names=["doc_id", "n_words", *types])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)
