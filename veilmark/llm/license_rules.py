"""Signature rules of the licence scan: families in sentence forms, identifiers of tags, short names, and single notices.

Patterns read a text's words joined by single spaces, so punctuation never counts: `GPL-3.0` reads `gpl 3 0`.
A rule is (rule id, label, priority, keyword, regex). The keyword is a literal that every
match holds, or several literals between bars of which it holds one.
"""

from __future__ import annotations

#: The phrases that are counted as they stand, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Label, keyword, name as words (a regex), version as words (a regex, or empty), address as words (or empty).
FAMILIES = [
    ("0bsd", "0bsd|bsd zero", r"0bsd|bsd zero clause", r"", r"opensource org licenses 0bsd"),
    ("afl", "academic free", r"academic free", r"[123] [0-2]", r"opensource org licenses afl 3 0"),
    ("agpl", "affero", r"(?:gnu )?affero general public", r"[13](?: 0)?", r"www gnu org licenses agpl(?: 3 0)?(?: html)?"),
    ("apache", "apache", r"apache(?: software)?", r"[12](?: [01])?", r"www apache org licenses license 2 0"),
    ("apsl", "apple public", r"apple public source", r"[12] [0-2]", r"opensource apple com apsl"),
    ("artistic", "artistic", r"(?:perl )?artistic", r"[12](?: 0)?", r"opensource org licenses artistic(?: license)? 2 0"),
    ("bsd-2-clause", "bsd 2", r"(?:simplified )?bsd 2 clause", r"", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd 3", r"(?:new |modified )?bsd 3 clause", r"", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd 4", r"(?:original )?bsd 4 clause", r"", r"spdx org licenses bsd 4 clause"),
    ("bsl", "boost", r"boost software", r"1(?: 0)?", r"www boost org license 1 0(?: txt)?"),
    ("busl", "business source", r"business source", r"1 1", r"mariadb com bsl11"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?! sa| nd)", r"[1234] 0", r"creativecommons org licenses by nc [1234] 0"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd", r"[1234] 0", r"creativecommons org licenses by nc nd [1234] 0"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa", r"[1234] 0", r"creativecommons org licenses by nc sa [1234] 0"),
    ("cc-by-nd", "cc by nd", r"cc by nd", r"[1234] 0", r"creativecommons org licenses by nd [1234] 0"),
    ("cc-by-sa", "cc by sa", r"cc by sa", r"[1234] 0", r"creativecommons org licenses by sa [1234] 0"),
    ("cc-by-version", "attribution", r"creative commons attribution", r"[1234] 0", r"creativecommons org licenses by [1234] 0"),
    ("cc0", "cc0", r"cc0", r"1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cddl", "common development", r"common development and distribution", r"1 [01]", r"opensource org licenses cddl 1 0"),
    ("cecill", "cecill", r"cecill(?: [bc])?", r"[12](?: [01])?", r"www cecill info"),
    ("cpal", "common public attribution", r"common public attribution", r"1 0", r"opensource org licenses cpal 1 0"),
    ("cpl", "common public", r"common public(?! attribution)", r"1 0", r"opensource org licenses cpl 1 0"),
    ("ecl", "educational community", r"educational community", r"[12] 0", r"opensource org licenses ecl 2 0"),
    ("efl", "eiffel", r"eiffel forum", r"[12](?: 0)?", r"opensource org licenses efl 2 0"),
    ("elastic", "elastic", r"elastic", r"2 0", r"www elastic co licensing elastic license"),
    ("epl", "eclipse", r"eclipse public", r"[12] 0", r"www eclipse org legal epl (?:v10|2 0)(?: html)?"),
    ("eupl", "european union", r"european union public", r"1 [0-2]", r"joinup ec europa eu collection eupl"),
    ("fdl", "free documentation", r"(?:gnu )?free documentation", r"1 [1-3]", r"www gnu org licenses fdl(?: html)?"),
    ("ftl", "freetype", r"freetype(?: project)?", r"", r"www freetype org license html"),
    ("gpl-2", "general public license version 2", r"(?:gnu )?general public license version 2", r"", r"www gnu org licenses old licenses gpl 2 0(?: html)?"),
    ("gpl-3", "general public license version 3", r"(?:gnu )?general public license version 3", r"", r"www gnu org licenses gpl 3 0(?: html)?"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer", r"", r"opensource org licenses hpnd"),
    ("ijg", "independent jpeg", r"independent jpeg group", r"", r"dev w3 org cvsweb amaya libjpeg readme"),
    ("isc", "isc", r"isc", r"", r"opensource org licenses isc"),
    ("json", "json", r"json", r"", r"www json org license html"),
    ("lgpl", "lesser general|library general", r"(?:gnu )?(?:lesser|library) general public", r"[23](?: [01])?", r"www gnu org licenses lgpl(?: [23] [01])?(?: html)?"),
    ("llama", "llama", r"llama [234](?: [0-9])? community", r"", r"llama meta com llama[234] license"),
    ("lppl", "latex project", r"latex project public", r"1 [0-3][abc]?", r"www latex project org lppl(?: txt)?"),
    ("mit", "mit|expat", r"mit|mit x11|expat", r"", r"opensource org licenses mit(?: license)?"),
    ("mpl", "mozilla", r"mozilla public", r"[12](?: [01])?", r"(?:www )?mozilla org mpl 2 0"),
    ("ms-pl", "microsoft public", r"microsoft public", r"", r"opensource org licenses ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", r"", r"opensource org licenses ms rl"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source", r"", r"opensource org licenses ncsa"),
    ("odbl", "open database", r"open database", r"1 0", r"opendatacommons org licenses odbl 1 0"),
    ("ofl", "open font", r"(?:sil )?open font", r"1 [01]", r"scripts sil org ofl"),
    ("openrail", "rail", r"(?:creative ml |bigscience )?open ?rail(?: m)?", r"", r"huggingface co spaces bigscience license"),
    ("openssl", "openssl", r"openssl", r"", r"www openssl org source license html"),
    ("osl", "open software", r"open software", r"[123] [01]", r"opensource org licenses osl 3 0"),
    ("php", "php", r"php", r"3 0[01]?", r"www php net license 3 01(?: txt)?"),
    ("postgresql", "postgresql", r"postgresql", r"", r"www postgresql org about licence"),
    ("psf", "python software", r"python software foundation", r"2(?: 0)?", r"docs python org 3 license html"),
    ("qpl", "q public", r"q public", r"1 0", r"opensource org licenses qtpl"),
    ("ruby", "ruby", r"ruby", r"", r"www ruby lang org en about license txt"),
    ("sleepycat", "sleepycat", r"sleepycat(?: public)?", r"", r"opensource org licenses sleepycat"),
    ("sspl", "server side", r"server side public", r"1(?: 0)?", r"www mongodb com licensing server side public license"),
    ("unicode", "unicode", r"unicode", r"v?3|dfs 201[56]", r"www unicode org license txt"),
    ("unlicense", "unlicense", r"unlicense", r"", r"unlicense org"),
    ("upl", "universal permissive", r"universal permissive", r"1 0", r"oss oracle com licenses upl"),
    ("vim", "vim", r"vim", r"", r"vimhelp org uganda txt html"),
    ("w3c", "w3c", r"w3c software(?: notice and)?", r"", r"www w3 org consortium legal copyright software"),
    ("wtfpl", "wtfpl|do what the", r"wtfpl|do what the fuck you want to public", r"2(?: 0)?", r"www wtfpl net"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"", r"(?:www )?zlib net zlib license html"),
    ("zpl", "zope", r"zope public", r"2 [01]", r"opensource org licenses zpl 2 0"),
]

#: Forms: name, priority, template over name (N) and version (V). One regex a family and form.
_FORMS = [
    ("tag", 95, r"spdx license identifier (?:N)(?: license)?(?: V)?(?: only| or later)?"),
    ("grant", 80, r"(?:licensed|released|distributed|published|available|provided|redistributed|modified)(?: it)? under (?:the )?(?:terms of )?(?:the |an? )?(?:N)(?: licen[cs]e)?(?: agreement)?(?: (?:version )?V)?(?: or (?:any )?later(?: version)?)?"),
    ("subject", 75, r"(?:subject to|governed by|covered by|in compliance with|as specified in) (?:the )?(?:terms of )?(?:the )?(?:N) licen[cs]e(?: (?:version )?V)?"),
    ("titled", 60, r"(?:N)(?: licen[cs]e)? version V"),
    ("named", 45, r"(?:N) licen[cs]e(?: V)?"),
    ("field", 40, r"licen[cs]e (?:is )?(?:N)(?: V)?"),
]

#: Names that are also everyday words: behind "license" they say nothing ("driving licence unicode").
_EVERYDAY = frozenset("artistic boost elastic json openssl php postgresql ruby unicode vim w3c".split())

#: Label, identifier in a licence tag, as words (a regex). Longer identifiers stand before their beginnings.
IDENTIFIERS = [
    ("0bsd", r"0bsd"), ("afl", r"afl [123] [0-2]"), ("agpl", r"agpl [13] 0"), ("apache", r"apache [12] [01]"), ("apsl", r"apsl [12] [0-2]"),
    ("artistic", r"artistic [12] 0(?: perl| cl8)?"), ("beerware", r"beerware"), ("blueoak", r"blueoak 1 0 0"), ("bsd-1-clause", r"bsd 1 clause"),
    ("bsd-2-clause", r"bsd 2 clause(?: patent| views)?"), ("bsd-3-clause", r"bsd 3 clause(?: clear| attribution| lbnl| modification)?"),
    ("bsd-4-clause", r"bsd 4 clause(?: uc)?"), ("bsl", r"bsl 1 0"), ("busl", r"busl 1 1"), ("bzip2", r"bzip2 1 0 [56]"),
    ("cc-by-nc-sa", r"cc by nc sa [1234] [05]"), ("cc-by-nc-nd", r"cc by nc nd [1234] [05]"), ("cc-by-nc", r"cc by nc [1234] [05]"),
    ("cc-by-sa", r"cc by sa [1234] [05]"), ("cc-by-nd", r"cc by nd [1234] [05]"), ("cc-by-version", r"cc by [1234] [05]"), ("cc0", r"cc0 1 0"),
    ("cc-pddc", r"cc pddc"), ("cddl", r"cddl 1 [01]"), ("cecill", r"cecill (?:[12] [01]|b|c)"), ("cpal", r"cpal 1 0"), ("cpl", r"cpl 1 0"),
    ("curl", r"curl"), ("ecl", r"ecl [12] 0"), ("efl", r"efl [12] 0"), ("elastic", r"elastic 2 0"), ("epl", r"epl [12] 0"), ("eupl", r"eupl 1 [012]"),
    ("fdl", r"gfdl 1 [123](?: invariants| no invariants)?"), ("fsfap", r"fsfap"), ("ftl", r"ftl"), ("gpl-1", r"gpl 1 0"), ("gpl-2", r"gpl 2 0"), ("gpl-3", r"gpl 3 0"),
    ("hpnd", r"hpnd(?: sell variant)?"), ("icu", r"icu"), ("ijg", r"ijg"), ("ipl", r"ipl 1 0"), ("isc", r"isc"), ("json", r"json"),
    ("lgpl", r"lgpl [23] [01]"), ("libpng", r"libpng(?: 2 0)?"), ("lppl", r"lppl 1 [0-3][abc]?"), ("mit-0", r"mit 0"), ("mit", r"mit(?: cmu| modern variant| open group)?"),
    ("mpl", r"mpl [12] [01](?: no copyleft exception)?"), ("ms-pl", r"ms pl"), ("ms-rl", r"ms rl"), ("mulan", r"mulanpsl [12] 0"), ("ncsa", r"ncsa"),
    ("npl", r"npl 1 [01]"), ("odbl", r"odbl 1 0"), ("odc-by", r"odc by 1 0"), ("ofl", r"ofl 1 [01](?: rfn| no rfn)?"), ("openssl", r"openssl"), ("osl", r"osl [123] [01]"),
    ("pddl", r"pddl 1 0"), ("php", r"php 3 0[01]?"), ("postgresql", r"postgresql"), ("psf", r"(?:psf|python) 2 0(?: 1)?"), ("qpl", r"qpl 1 0"), ("rpl", r"rpl 1 [15]"), ("ruby", r"ruby"),
    ("sleepycat", r"sleepycat"), ("sspl", r"sspl 1 0"), ("tcl", r"tcl"), ("unicode", r"unicode (?:3 0|dfs 201[56]|tou)"), ("unlicense", r"unlicense"),
    ("upl", r"upl 1 0"), ("vim", r"vim"), ("w3c", r"w3c(?: 19980720| 20150513)?"), ("wtfpl", r"wtfpl"), ("x11", r"x11"), ("zlib", r"zlib(?: acknowledgement)?"), ("zpl", r"zpl [12] [01]"),
]

#: Label, priority, keyword, short name as it stands in running text (a regex over words).
SHORT_NAMES = [
    ("gpl-1", 52, "gpl", r"(?:gnu )?gpl(?: version)? ?v?1(?: 0)?"),
    ("gpl-2", 52, "gpl", r"(?:gnu )?gpl(?: version)? ?v?2(?: 0)?(?: only| or later| or any later version)?"),
    ("gpl-3", 52, "gpl", r"(?:gnu )?gpl(?: version)? ?v?3(?: 0)?(?: only| or later| or any later version)?"),
    ("gpl-unversioned", 36, "gpl", r"(?:gnu gpl|under (?:the )?gpl)(?! ?v?[123]| version)"),
    ("gpl-unversioned", 34, "gpl", r"gpl licen[cs]ed?"),
    ("gpl-unversioned", 34, "general public licen", r"gnu general public licen[cs]e(?! v(?:ersion)? ?[123])"),
    ("gpl-2", 62, "general public license v2", r"(?:gnu )?general public license v2(?: 0)?"),
    ("gpl-3", 62, "general public license v3", r"(?:gnu )?general public license v3(?: 0)?"),
    ("lgpl", 52, "lgpl", r"(?:gnu )?lgpl(?: version)? ?v?[23](?: [01])?(?: only| or later)?"),
    ("lgpl", 36, "lgpl", r"(?:gnu )?lgpl(?: licen[cs]ed?)?"),
    ("agpl", 52, "agpl", r"(?:gnu )?agpl(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl", 36, "agpl", r"(?:gnu )?agpl(?: licen[cs]ed?)?"),
    ("mpl", 50, "mpl", r"mpl(?: version)? ?v?[12](?: [01])?"),
    ("mpl", 36, "mozilla public", r"mozilla public licen[cs]e"),
    ("epl", 50, "epl", r"epl(?: version)? ?v?[12](?: 0)?"),
    ("cddl", 50, "cddl", r"cddl(?: version)? ?v?1(?: [01])?"),
    ("eupl", 50, "eupl", r"eupl(?: version)? ?v?1(?: [0-2])?"),
    ("ofl", 50, "ofl", r"(?:sil )?ofl(?: version)? ?v?1(?: [01])?"),
    ("apache", 50, "apache", r"apache ?v?2(?: 0)?(?: licen[cs]ed?)?"),
    ("apache", 50, "asl 2", r"asl ?v?2(?: 0)?"),
    ("bsd-2-clause", 50, "clause bsd", r"(?:2|two) clause bsd"),
    ("bsd-3-clause", 50, "clause bsd", r"(?:3|three) clause bsd"),
    ("bsd-like", 43, "bsd", r"bsd (?:style )?licen[cs]ed?"),
    ("bsd-like", 41, "under", r"under (?:the |a )?bsd"),
    ("mit", 43, "mit licensed", r"mit licensed"),
    ("mit", 43, "expat", r"expat licensed"),
    ("mit", 41, "under the mit", r"under the mit(?! [a-z]+ ?(?:program|course|school))"),
    ("isc", 41, "isc licensed", r"isc licensed"),
    ("wtfpl", 41, "wtfpl", r"wtfpl(?: ?v?2)?"),
    ("cc0", 46, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-sa", 46, "cc by sa", r"cc by sa(?: [1234] 0)?"),
    ("cc-by-nc", 46, "cc by nc", r"cc by nc(?: sa| nd)?(?: [1234] 0)?"),
    ("cc-by-nd", 46, "cc by nd", r"cc by nd(?: [1234] 0)?"),
    ("cc-by-sa", 48, "attribution", r"creative commons attribution share ?alike"),
    ("cc-by-nc", 48, "attribution", r"creative commons attribution non ?commercial(?: share ?alike| no ?deriv(?:ative|ative work)s?)?"),
    ("cc-by-nd", 48, "attribution", r"creative commons attribution no ?deriv(?:ative|ative work)s?"),
    ("mit", 64, "osi approved", r"license osi approved mit license"),
    ("apache", 64, "osi approved", r"license osi approved apache software license"),
    ("bsd-like", 64, "osi approved", r"license osi approved bsd license"),
    ("gpl-3", 64, "osi approved", r"license osi approved gnu general public license v3(?: or later)?(?: gplv3)?"),
    ("gpl-2", 64, "osi approved", r"license osi approved gnu general public license v2(?: or later)?(?: gplv2)?"),
    ("lgpl", 64, "osi approved", r"license osi approved gnu lesser general public license v[23](?: or later)?(?: lgplv[23])?"),
    ("mpl", 64, "osi approved", r"license osi approved mozilla public license 2 0(?: mpl 2 0)?"),
    ("psf", 64, "osi approved", r"license osi approved python software foundation license"),
]

#: Notices that stand alone: label, priority, keyword, regex.
NOTICES = [
    ("copyright", 30, "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*"),
    ("copyright", 28, "copyright", r"(?:c )?copyright (?:by )?[^ ]+ (?:19|20)[0-9]{2}"),
    ("copyleft", 25, "copyleft", r"copyleft"),
    ("permission", 70, "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("permission", 66, "permission", r"permission to use copy modify and or distribute this software"),
    ("bsd-like", 70, "redistribution and use", r"redistribution and use in source and binary forms with or without modification(?: are permitted)?"),
    ("bsd-like", 55, "neither the name", r"neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} may be used to endorse"),
    ("warranty", 35, "without warranty", r"(?:the software is provided )?as is without warranty of any kind"),
    ("warranty", 32, "without any warranty", r"without any warranty"),
    ("warranty", 33, "merchantability", r"merchantability (?:or|and) fitness for a particular purpose"),
    ("public-domain", 50, "public domain", r"(?:released |placed |dedicated )?(?:in|into|to) the public domain"),
    ("public-domain", 26, "public domain", r"public domain"),
    ("proprietary", 52, "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", 48, "no part of this", r"no part of this (?:publication|work|book|document) may be reproduced"),
    ("proprietary", 47, "unauthorized", r"unauthorized (?:copying|reproduction|distribution)"),
    ("reuse", 46, "reproduced with permission", r"reproduced with permission"),
    ("reuse", 44, "used by permission", r"used by permission"),
    ("non-commercial", 42, "commercial", r"(?:for )?non ?commercial (?:use|purposes)(?: only)?"),
    ("creative-commons", 38, "creative commons", r"creative commons licen[cs]e"),
    ("dual", 58, "dual", r"dual licensed under"),
]


def rules() -> list[tuple[str, str, int, str, str]]:
    """All rules, highest priority first; equal priorities keep the order of the lists above."""
    found = [(f"base:{label}", label, 10, phrase, phrase) for phrase, label in BASE_PHRASES.items()]
    for label, keyword, name, version, address in FAMILIES:
        for form, priority, template in _FORMS:
            if form == "field" and label in _EVERYDAY:
                continue
            if version or "V" not in template or form in ("tag", "grant", "subject", "named", "field"):
                regex = template.replace("(?: (?:version )?V)?", f"(?: (?:version |v )?(?:{version}))?" if version else "")
                regex = regex.replace("(?: V)?", f"(?: (?:{version}))?" if version else "").replace("V", f"(?:{version})")
                found.append((f"{form}:{label}", label, priority, keyword, regex.replace("(?:N)", f"(?:{name})")))
        if address:
            found.append((f"address:{label}", label, 85, " ".join(address.split("(")[0].split("[")[0].split()) or keyword, f"(?:https? )?{address}"))
    head = r"spdx license identifier (?:[^ ]+ ){0,12}?"  # an expression may name several, joined by and, or and with
    found += [(f"identifier:{label}", label, 95, "spdx license identifier", f"{head}({identifier}(?: only| or later)?)") for label, identifier in IDENTIFIERS]
    found += [(f"short:{label}:{i}", label, priority, keyword, regex) for i, (label, priority, keyword, regex) in enumerate(SHORT_NAMES)]
    found += [(f"notice:{label}:{i}", label, priority, keyword, regex) for i, (label, priority, keyword, regex) in enumerate(NOTICES)]
    return sorted(found, key=lambda r: -r[2])
