"""License scans with ordered signature rules.

Hundreds of regular expressions are tried in order of priority: first hand-written signatures of single
versions of licenses (names with a version, identifiers, sentences that one text alone has), each with a label
of its own such as gpl-2.0 or bsd-3-clause; then sentences of license texts, and one expression per license
and way of naming it, whose label is the family.
An Aho-Corasick automaton over the rules' keywords goes over the text first, and only rules whose keyword
occurs are run. Overlapping detections are resolved by containment and priority: a detection whose
interval lies inside another's is suppressed ("GPL" inside "Lesser GPL"), and of two that overlap in part
the one of higher priority stands.

The base counts ask for something plainer: places where the words of a few phrases stand consecutively.
They are taken from the same pass over the same text.

Defined results: null text is empty; empty texts have no places, no labels and score 0; repeated rows get
equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Phrases that the base counts, with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, names in running text (regex), SPDX identifiers (regex), addresses (regex), keyword.
LICENSES = (
    ("agpl", r"(?:gnu\s+)?affero\s+(?:general\s+public\s+license|gpl)", r"agpl-?(?:[13](?:\.0)?)(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl", ("affero", "agpl")),
    ("lgpl", r"(?:gnu\s+)?(?:lesser|library)\s+(?:general\s+public\s+licen[cs]e|gpl)", r"lgpl-?(?:2(?:\.[01])?|3(?:\.0)?)(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl", ("lesser", "library g", "lgpl")),
    ("gfdl", r"(?:gnu\s+)?free\s+documentation\s+licen[cs]e", r"gfdl-?1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl", ("free documentation", "gfdl", "fdl")),
    ("gpl", r"(?:gnu\s+)?general\s+public\s+licen[cs]e|gnu\s+gpl", r"gpl-?(?:[123](?:\.0)?)(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl", ("general public", "gpl")),
    ("apache", r"apache\s+(?:software\s+)?licen[cs]e", r"apache-?(?:1\.[01]|2(?:\.0)?)", r"apache\.org/licenses", ("apache",)),
    ("mit", r"(?:mit|expat)\s+licen[cs]e", r"mit(?:-0|-cmu)?", r"opensource\.org/licenses?/mit", ("mit", "expat")),
    ("bsd", r"(?:(?:two|three|four|simplified|modified|new|revised|[234])[-\s]+(?:clause\s+)?)?bsd\s+licen[cs]e|bsd[-\s][234]-clause", r"(?:0bsd|bsd-[1234]-clause)(?:-[a-z]+)*", r"opensource\.org/licenses?/bsd", ("bsd",)),
    ("isc", r"isc\s+licen[cs]e", r"isc", r"opensource\.org/licenses?/isc", ("isc",)),
    ("mpl", r"mozilla\s+public\s+licen[cs]e", r"mpl-?(?:1\.[01]|2\.0)(?:-no-copyleft-exception)?", r"mozilla\.org/mpl", ("mozilla", "mpl")),
    ("epl", r"eclipse\s+public\s+licen[cs]e", r"epl-?[12]\.0", r"eclipse\.org/legal/epl", ("eclipse", "epl")),
    ("cddl", r"common\s+development\s+and\s+distribution\s+licen[cs]e", r"cddl-?1\.[01]", r"opensource\.org/licenses?/cddl", ("common development", "cddl")),
    ("cpl", r"common\s+public\s+licen[cs]e", r"cpl-?1\.0", r"opensource\.org/licenses?/cpl", ("common public", "cpl")),
    ("eupl", r"european\s+union\s+public\s+licen[cs]e", r"eupl-?1\.[012]", r"eupl\.eu", ("european union", "eupl")),
    ("artistic", r"(?:perl\s+)?artistic\s+licen[cs]e", r"artistic-?[12]\.0", r"perlfoundation\.org/artistic", ("artistic",)),
    ("boost", r"boost\s+software\s+licen[cs]e", r"bsl-?1\.0", r"boost\.org/license", ("boost", "bsl")),
    ("zlib", r"zlib(?:/libpng)?\s+licen[cs]e", r"zlib(?:-acknowledgement)?", r"zlib\.net/zlib_license", ("zlib",)),
    ("unlicense", r"the\s+unlicen[cs]e", r"unlicense", r"unlicense\.org", ("unlicen",)),
    ("wtfpl", r"do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[cs]e", r"wtfpl", r"wtfpl\.net", ("do what the", "wtfpl")),
    ("cc0", r"creative\s+commons\s+zero|cc0", r"cc0-?1\.0", r"creativecommons\.org/publicdomain/zero", ("creative commons", "cc0", "creativecommons")),
    ("cc-by-nc-nd", r"attribution[-\s]+non-?commercial[-\s]+no-?deriv\w*", r"cc-by-nc-nd-?[1234]\.0", r"creativecommons\.org/licenses/by-nc-nd", ("attribution", "cc-by", "creativecommons")),
    ("cc-by-nc-sa", r"attribution[-\s]+non-?commercial[-\s]+share-?alike", r"cc-by-nc-sa-?[1234]\.0", r"creativecommons\.org/licenses/by-nc-sa", ("attribution", "cc-by", "creativecommons")),
    ("cc-by-nc", r"attribution[-\s]+non-?commercial", r"cc-by-nc-?[1234]\.0", r"creativecommons\.org/licenses/by-nc/", ("attribution", "cc-by", "creativecommons")),
    ("cc-by-sa", r"attribution[-\s]+share-?alike", r"cc-by-sa-?[1234]\.0", r"creativecommons\.org/licenses/by-sa", ("attribution", "cc-by", "creativecommons")),
    ("cc-by-nd", r"attribution[-\s]+no-?deriv\w*", r"cc-by-nd-?[1234]\.0", r"creativecommons\.org/licenses/by-nd", ("attribution", "cc-by", "creativecommons")),
    ("cc-by", r"creative\s+commons\s+attribution", r"cc-by-?[1234]\.0", r"creativecommons\.org/licenses/by/", ("creative commons", "cc-by", "creativecommons")),
    ("odbl", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e", r"odbl-?1\.0", r"opendatacommons\.org/licenses/odbl", ("open database", "odbl", "opendatacommons")),
    ("psf", r"(?:python|psf)\s+(?:software\s+foundation\s+)?licen[cs]e", r"(?:psf|python)-?2\.0", r"python\.org/psf/license", ("python", "psf")),
    ("ofl", r"(?:sil\s+)?open\s+font\s+licen[cs]e", r"ofl-?1\.[01]", r"scripts\.sil\.org/ofl", ("open font", "ofl", "scripts.sil")),
    ("openssl", r"openssl\s+licen[cs]e", r"openssl", r"openssl\.org/source/license", ("openssl",)),
    ("php", r"php\s+licen[cs]e", r"php-?3\.0[01]?", r"php\.net/license", ("php",)),
    ("ms-pl", r"microsoft\s+public\s+licen[cs]e", r"ms-pl", r"opensource\.org/licenses?/ms-pl", ("microsoft", "ms-pl")),
    ("upl", r"universal\s+permissive\s+licen[cs]e", r"upl-?1\.0", r"oss\.oracle\.com/licenses/upl", ("universal permissive", "upl", "oss.oracle")),
    ("mulan", r"mulan\s+(?:permissive|psl)\s*(?:software\s+)?licen[cs]e", r"mulanpsl-?[12]\.0", r"license\.coscl\.org\.cn/mulanpsl", ("mulan",)),
    ("sspl", r"server\s+side\s+public\s+licen[cs]e", r"sspl-?1\.0", r"mongodb\.com/licensing/server-side", ("server side", "sspl", "mongodb")),
    ("busl", r"business\s+source\s+licen[cs]e", r"busl-?1\.1", r"mariadb\.com/bsl", ("business source", "busl", "mariadb")),
    ("proprietary", r"proprietary\s+(?:and\s+confidential|licen[cs]e)|all\s+rights\s+reserved", r"licenseref-proprietary", r"example\.invalid/proprietary", ("proprietary", "all rights", "licenseref")),
    ("public-domain", r"(?:released|placed|dedicated)\s+(?:in)?to\s+the\s+public\s+domain", r"licenseref-public-domain", r"creativecommons\.org/publicdomain/mark", ("public domain", "licenseref", "creativecommons")),
)

#: Ways of naming a license, most telling first: kind, pattern around a name or identifier, weight.
FORMS = (
    ("spdx", r"spdx-license-identifier:\s*\(?(?:[\w.+-]+\s+(?:and|or|with)\s+)*(?:{id})(?![\w.-]*\w)", 1.0),
    ("field", r"(?:^|[\s{{,;])[\"']?licen[cs]e[\"']?\s*[:=]\s*[\"'\[]*(?:{id})(?![\w.-]*\w)", 0.95),
    ("grant", r"(?:licen[cs]ed|released|distributed|available|published|provided)\s+(?:under|with|by|subject\s+to)\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:{name})", 0.95),
    ("terms", r"(?:under|subject\s+to|see|by)\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?(?:{name})", 0.85),
    ("url", r"(?:https?://)?(?:www\.)?(?:{url})[\w./-]*", 0.9),
    ("version", r"(?:the\s+)?(?:{name})[,\s(]+(?:version|v\.?)\s*\d+(?:\.\d+)*", 0.9),
    ("name", r"\b(?:{name})\b", 0.7),
)

#: Sentences of license texts themselves: label, pattern, weight, keyword (notices: keywords).
TEXTS = (
    ("mit", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy", 1.0, "permission is hereby granted"),
    ("bsd", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification", 1.0, "redistribution and use"),
    ("isc", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose", 1.0, "permission to use"),
    ("gpl", r"this\s+program\s+is\s+free\s+software[:;]\s+you\s+can\s+redistribute\s+it", 0.9, "is free software"),
    ("lgpl", r"this\s+library\s+is\s+free\s+software[:;]\s+you\s+can\s+redistribute\s+it", 1.0, "is free software"),
    ("unlicense", r"this\s+is\s+free\s+and\s+unencumbered\s+software", 1.0, "unencumbered"),
    ("zlib", r"this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty", 0.8, "as-is"),
    ("copyright", r"(?:copyright|\(c\)|©)\s*(?:\(c\)|©)?\s*(?:19|20)\d\d(?:\s*[-–,]\s*(?:19|20)\d\d)*", 0.3, "copyright (c) ©"),
    ("copyright", r"(?:\(c\)|©)\s*(?:19|20)\d\d", 0.3, "(c) ©"),
)

#: Signatures of single versions, written by hand: label, weight, keyword, pattern (a space stands for white space).
SIGNATURES = (
    ("agpl-3.0", 1.0, "affero", r"gnu affero general public license,? (?:as published by the free software foundation,? (?:either )?)?\(?(?:version|v\.?) ?3"),
    ("agpl-3.0", 1.0, "agpl", r"\bagpl-?(?:v ?)?3(?:\.0)?(?:-only|-or-later|\+)?\b"),
    ("agpl-1.0", 1.0, "affero", r"affero general public license,? (?:version|v\.?) ?1"),
    ("lgpl-2.0", 1.0, "library", r"gnu library general public license(?: as published by the free software foundation; (?:either )?)?,? ?(?:version|v\.?) ?2(?:\.0)?(?!\.?\d)"),
    ("lgpl-2.1", 1.0, "lesser", r"gnu lesser general public license(?: as published by the free software foundation; (?:either )?)?,? ?(?:version|v\.?) ?2\.1"),
    ("lgpl-2.1", 1.0, "lgpl", r"\blgpl-?(?:v ?)?2\.1(?:-only|-or-later|\+)?"),
    ("lgpl-3.0", 1.0, "lesser", r"gnu lesser general public license(?: as published by the free software foundation[,;] (?:either )?)?,? ?(?:version|v\.?) ?3"),
    ("lgpl-3.0", 1.0, "lgpl", r"\blgpl-?(?:v ?)?3(?:\.0)?(?:-only|-or-later|\+)?\b"),
    ("lgpl-3.0", 0.9, "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl-2.1", 0.9, "lesser", r"this is the first released version of the lesser gpl"),
    ("gpl-1.0", 1.0, "general", r"gnu general public license(?: as published by the free software foundation; (?:either )?)?,? ?(?:version|v\.?) ?1(?!\.?\d)"),
    ("gpl-2.0", 1.0, "general", r"gnu general public license(?: as published by the free software foundation; (?:either )?)?,? ?\(?(?:version|v\.?) ?2(?!\.?[1-9])"),
    ("gpl-2.0", 1.0, "gpl", r"\bgpl-?(?:v ?)?2(?:\.0)?(?:-only|-or-later|\+)?\b"),
    ("gpl-2.0", 0.9, "distribute", r"everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed\. preamble the licenses for most software are designed"),
    ("gpl-3.0", 1.0, "general", r"gnu general public license(?: as published by the free software foundation[,;] (?:either )?)?,? ?\(?(?:version|v\.?) ?3"),
    ("gpl-3.0", 1.0, "gpl", r"\bgpl-?(?:v ?)?3(?:\.0)?(?:-only|-or-later|\+)?\b"),
    ("gpl-3.0", 0.9, "copyleft", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl-2.0-classpath", 1.0, "linking", r"linking this (?:library|software) statically or dynamically with other modules is making a combined work"),
    ("gpl-3.0-gcc", 1.0, "gcc", r"gcc runtime library exception,? ?(?:version|v\.?)? ?3\.1"),
    ("gfdl-1.1", 1.0, "documentation", r"gnu free documentation license,? (?:version|v\.?) ?1\.1"),
    ("gfdl-1.2", 1.0, "documentation", r"gnu free documentation license,? (?:version|v\.?) ?1\.2"),
    ("gfdl-1.3", 1.0, "documentation", r"gnu free documentation license,? (?:version|v\.?) ?1\.3"),
    ("apache-1.0", 1.0, "apache", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-1.1", 1.0, "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", 1.0, "apache", r"apache(?: software)? license,? (?:version|v\.?) ?1\.1"),
    ("apache-2.0", 1.0, "apache", r"apache(?: software)? license,? \(?(?:version|v\.?) ?2(?:\.0)?"),
    ("apache-2.0", 1.0, "apache", r"\bapache-?2(?:\.0)?\b"),
    ("apache-2.0", 1.0, "apache", r"apache\.org/licenses/license-2\.0"),
    ("apache-2.0", 0.9, "unless", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \W?as is\W? basis"),
    ("mit", 1.0, "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", 1.0, "mit", r"mit no attribution|\bmit-0\b"),
    ("mit-advertising", 1.0, "advertising", r"except as contained in this notice, the names? of [^.]{1,80} shall not be used in advertising or otherwise to promote the sale"),
    ("bsd-0-clause", 1.0, "fee", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software"),
    ("bsd-2-clause", 1.0, "bsd", r"(?:bsd[- ]2[- ]clause|(?:two|2)[- ]clause bsd|simplified bsd|freebsd license)"),
    ("bsd-3-clause", 1.0, "bsd", r"(?:bsd[- ]3[- ]clause|(?:three|3)[- ]clause bsd|(?:new|revised|modified) bsd)"),
    ("bsd-3-clause", 1.0, "neither", r"neither the names? of (?:the )?[^.]{1,120} nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 1.0, "bsd", r"(?:bsd[- ]4[- ]clause|(?:four|4)[- ]clause bsd|original bsd)"),
    ("bsd-4-clause", 1.0, "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd-3-clause-clear", 1.0, "patent", r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("isc", 1.0, "internet", r"internet systems consortium"),
    ("mpl-1.0", 1.0, "mozilla", r"mozilla public license,? (?:version|v\.?) ?1\.0"),
    ("mpl-1.1", 1.0, "mozilla", r"mozilla public license,? (?:version|v\.?) ?1\.1"),
    ("mpl-2.0", 1.0, "mozilla", r"mozilla public license,? (?:version|v\.?) ?2(?:\.0)?"),
    ("mpl-2.0", 1.0, "mozilla", r"this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0"),
    ("mpl-2.0", 1.0, "mpl", r"\bmpl-?(?:v ?)?2(?:\.0)?\b"),
    ("epl-1.0", 1.0, "eclipse", r"eclipse public license,? ?-? ?(?:version|v\.?) ?1\.0"),
    ("epl-2.0", 1.0, "eclipse", r"eclipse public license,? ?-? ?(?:version|v\.?) ?2\.0"),
    ("edl-1.0", 1.0, "eclipse", r"eclipse distribution license,? ?-? ?(?:version|v\.?) ?1\.0"),
    ("cddl-1.0", 1.0, "common", r"common development and distribution license(?: \(cddl\))?,? ?(?:version|v\.?) ?1\.0"),
    ("cddl-1.1", 1.0, "common", r"common development and distribution license(?: \(cddl\))?,? ?(?:version|v\.?) ?1\.1"),
    ("cpl-1.0", 1.0, "common", r"common public license,? ?-? ?(?:version|v\.?) ?1\.0"),
    ("eupl-1.1", 1.0, "european", r"european union public licen[cs]e,? (?:version|v\.?) ?1\.1"),
    ("eupl-1.2", 1.0, "european", r"european union public licen[cs]e,? (?:version|v\.?) ?1\.2"),
    ("artistic-1.0", 1.0, "artistic", r"the \W?artistic license\W? preamble"),
    ("artistic-2.0", 1.0, "artistic", r"(?:the )?artistic license,? ?(?:version|v\.?)? ?2\.0"),
    ("boost-1.0", 1.0, "boost", r"boost software license,? ?-? ?(?:version|v\.?) ?1\.0"),
    ("zlib", 1.0, "altered", r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("libpng-2.0", 1.0, "png", r"png reference library license version 2"),
    ("unlicense", 1.0, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl-2", 1.0, "do", r"do what the f\w+ you want to public license,? ?(?:version|v\.?) ?2"),
    ("cc0-1.0", 1.0, "cc0", r"\bcc0[- ]1\.0(?: universal)?"),
    ("cc0-1.0", 0.9, "extent", r"to the extent possible under law, [^.]{1,120} waived all copyright and related or neighboring rights"),
    ("cc-by-2.0", 1.0, "cc-by", r"\bcc-by[- ]2\.0\b"),
    ("cc-by-2.5", 1.0, "cc-by", r"\bcc-by[- ]2\.5\b"),
    ("cc-by-3.0", 1.0, "cc-by", r"\bcc-by[- ]3\.0\b"),
    ("cc-by-4.0", 1.0, "cc-by", r"\bcc-by[- ]4\.0\b"),
    ("cc-by-3.0", 1.0, "attribution", r"creative commons attribution 3\.0(?: unported)?(?: licen[cs]e)?"),
    ("cc-by-4.0", 1.0, "attribution", r"creative commons attribution 4\.0(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-sa-3.0", 1.0, "cc-by", r"\bcc-by-sa[- ]3\.0\b"),
    ("cc-by-sa-4.0", 1.0, "cc-by", r"\bcc-by-sa[- ]4\.0\b"),
    ("cc-by-sa-3.0", 1.0, "attribution", r"creative commons attribution[- ]share-?alike 3\.0(?: unported)?(?: licen[cs]e)?"),
    ("cc-by-sa-4.0", 1.0, "attribution", r"creative commons attribution[- ]share-?alike 4\.0(?: international)?(?: public)?(?: licen[cs]e)?"),
    ("cc-by-sa-4.0", 1.0, "creativecommons", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-sa-3.0", 1.0, "creativecommons", r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("cc-by-4.0", 1.0, "creativecommons", r"creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-3.0", 1.0, "creativecommons", r"creativecommons\.org/licenses/by/3\.0"),
    ("cc-by-nc-4.0", 1.0, "attribution", r"creative commons attribution[- ]non-?commercial 4\.0(?: international)?"),
    ("cc-by-nc-sa-4.0", 1.0, "attribution", r"creative commons attribution[- ]non-?commercial[- ]share-?alike 4\.0(?: international)?"),
    ("cc-by-nc-nd-4.0", 1.0, "attribution", r"creative commons attribution[- ]non-?commercial[- ]no-?deriv\w* 4\.0(?: international)?"),
    ("odbl-1.0", 1.0, "open", r"open database license(?: \(odbl\))?,? ?(?:version|v\.?) ?1\.0"),
    ("odc-by-1.0", 1.0, "open", r"open data commons attribution license,? ?(?:version|v\.?)? ?1\.0"),
    ("psf-2.0", 1.0, "python", r"python software foundation license,? (?:version|v\.?) ?2"),
    ("ofl-1.1", 1.0, "open", r"(?:sil )?open font license,? ?(?:version|v\.?) ?1\.1"),
    ("openssl", 1.0, "openssl", r"this product includes software developed by the openssl project"),
    ("ssleay", 1.0, "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("php-3.01", 1.0, "php", r"php license,? (?:version|v\.?) ?3\.01"),
    ("ms-pl", 1.0, "microsoft", r"microsoft public license \(ms-pl\)"),
    ("ms-rl", 1.0, "microsoft", r"microsoft reciprocal license"),
    ("upl-1.0", 1.0, "universal", r"universal permissive license(?: \(upl\))?,? ?(?:version|v\.?) ?1\.0"),
    ("mulan-2.0", 1.0, "mulan", r"mulan (?:psl|permissive software license),? ?(?:version|v\.?) ?2"),
    ("sspl-1.0", 1.0, "server", r"server side public license,? ?(?:version|v\.?) ?1"),
    ("busl-1.1", 1.0, "business", r"business source license,? ?(?:version|v\.?)? ?1\.1"),
    ("elastic-2.0", 1.0, "elastic", r"elastic license,? ?(?:version|v\.?)? ?2\.0"),
    ("postgresql", 1.0, "postgresql", r"postgresql licen[cs]e"),
    ("ncsa", 1.0, "ncsa", r"university of illinois/ncsa open source license"),
    ("vim", 1.0, "vim", r"\bvim license\b"),
    ("w3c", 1.0, "w3c", r"w3c software (?:and document )?notice and license"),
    ("json", 1.0, "evil", r"the software shall be used for good, not evil"),
    ("beerware", 1.0, "beer", r"buy me a beer in return"),
    ("ecl-2.0", 1.0, "educational", r"educational community license,? ?(?:version|v\.?) ?2\.0"),
    ("afl-3.0", 1.0, "academic", r"academic free license,? ?(?:version|v\.?) ?3\.0"),
    ("osl-3.0", 1.0, "open", r"open software license,? ?(?:version|v\.?) ?3\.0"),
    ("cecill-2.1", 1.0, "cecill", r"cecill free software license agreement,? ?(?:version|v\.?) ?2\.1"),
    ("blueoak-1.0", 1.0, "blue", r"blue oak model license,? ?(?:version|v\.?)? ?1\.0"),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: re.Pattern[str]
    weight: float
    priority: int  # smaller wins


def build_rules() -> tuple[list[Rule], dict[str, list[int]]]:
    """Rules in order of priority, and the rules that each keyword lets through."""
    rules, by_word = [], {}

    def add(label: str, kind: str, pattern: str, weight: float, words: tuple[str, ...]) -> None:
        for w in words:
            by_word.setdefault(w, []).append(len(rules))
        rules.append(Rule(label, kind, re.compile(pattern), weight, len(rules)))

    for label, weight, word, pattern in SIGNATURES:
        spaced = re.sub(r"\[[^\]]*\]| ", lambda m: r"\s+" if m[0] == " " else m[0].replace(" ", r"\s"), pattern)
        add(label, "signature", spaced.replace(r"\s+?", r"\s*"), weight, (word,))
    for label, pattern, weight, word in TEXTS[:-2]:
        add(label, "text", pattern, weight, (word.split()[-1] if " " in word else word,))
    for kind, form, weight in FORMS:
        for label, name, spdx, url, words in LICENSES:
            add(label, kind, form.format(name=name, id=spdx, url=url), weight, words)
    for label, pattern, weight, word in TEXTS[-2:]:
        add(label, "notice", pattern, weight, tuple(word.split()))
    # A keyword of several words may be broken by other white space; its first word is what is looked for.
    single: dict[str, list[int]] = {}
    for w, at in by_word.items():
        single.setdefault(w.split()[0], []).extend(at)
    return rules, {w: sorted(set(at)) for w, at in single.items()}


class Scanner:
    """The rules with their keyword automaton; made once in each task."""

    def __init__(self) -> None:
        self.rules, by_word = build_rules()
        self.words = ahocorasick.Automaton()
        for w, at in by_word.items():
            self.words.add_word(w, tuple(at))
        self.words.make_automaton()

    def detect(self, low: str) -> list[tuple[int, int, Rule]]:
        """Detections in lower-cased text that stand after suppression: start, end, rule."""
        wanted = sorted({r for _, at in self.words.iter(low) for r in at})
        found = [(m.start(), m.end(), self.rules[r]) for r in wanted for m in self.rules[r].pattern.finditer(low)]
        return suppress(found)


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections that stand, in order of their places.

    First containment: a detection whose interval lies inside another's goes, the one of lower priority if
    the intervals are equal. What is left overlaps in part at most and is taken in order of priority; a
    detection that overlaps one already taken goes. Signatures of versions are resolved first and copyright
    notices last, so a family's name gives way to its version, and notices give way to licenses throughout.
    """
    groups: tuple[list, list, list] = ([], [], [])
    for x in found:
        groups[{"signature": 0, "notice": 2}.get(x[2].kind, 1)].append(x)
    taken: list[tuple[int, int, Rule]] = []
    for group in groups:
        free, end = [], -1
        for x in sorted(group, key=lambda x: (x[0], -x[1], x[2].priority)):
            # Starts rise, so an interval lies inside an earlier one if its end is no further than the furthest so far.
            if x[1] > end:
                free.append(x)
                end = x[1]
        for x in sorted(free, key=lambda x: (x[2].priority, x[0])):
            at = bisect_left(taken, x[0], key=lambda t: t[1] - 1)
            if at == len(taken) or taken[at][0] >= x[1]:
                taken.insert(at, x)
    return taken


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """Places (word number, label) where the words of a base phrase stand consecutively."""
    out = []
    for phrase, label in BASE_PHRASES:
        p = phrase.split()
        at = -1
        while True:
            try:
                at = words.index(p[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(p)] == p:
                out.append((at, label))
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    scanner = Scanner()
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            text = text or ""
            low = text.lower() if text.isascii() else text.translate(_UPPER)
            words = _WORD.findall(low)
            base = base_places(words) if "license" in low else []
            spans = scanner.detect(low)
            score = 0.0
            for _, _, r in spans:
                score = 1 - (1 - score) * (1 - r.weight)
            if base:
                score = max(score, 0.7)
            rows.append((doc_id, len(words), len(base), base, [(r.label, r.kind, s, e) for s, e, r in spans], min(1.0, score)))
        at = [[i for i, _ in r[3]] for r in rows]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"],
                "n_words": [r[1] for r in rows],
                "n_base": [r[2] for r in rows],
                "first_word": pd.array([min(a) if a else None for a in at], dtype="Int64"),
                "last_word": pd.array([max(a) if a else None for a in at], dtype="Int64"),
                "base_labels": [sorted({x for _, x in r[3]}) for r in rows],
                "labels": [sorted({x for _, x in r[3]} | {x[0] for x in r[4]}) for r in rows],
                "score": [r[5] for r in rows],
                "detections": [[{"label": a, "kind": k, "start": s, "end": e} for a, k, s, e in r[4]] for r in rows],
            }
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score and
    detections (label, kind, and start and end in characters). The score is the chance that at least one
    standing detection is right, if each is with its rule's weight."""
    small_batches(docs.sparkSession)
    # Ids travel as text: pandas would turn whole numbers with nulls among them into floats.
    slim = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    found = slim.mapInPandas(
        _scan,
        "doc_id string, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, detections array<struct<label:string,kind:string,start:bigint,end:bigint>>",
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
