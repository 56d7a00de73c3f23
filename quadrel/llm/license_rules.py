"""Signature rules: (name, license, priority, keywords, pattern); a keyword with & needs all its parts.  Priority: 90 whole notices, 70 grants, 60 identifiers, 50 addresses, 30 names, 10 traces."""

from __future__ import annotations

import re

_W = r"[\s*#/;>\-]+"  # white space and comment leaders between the words of a notice


def _t(words: str) -> str:
    """Words with any white space or comment leaders between them."""
    return _W.join(words.split(" "))


#: (licence, name in prose, further ways to write it, the address after the scheme)
_NAMED: list[tuple[str, str, str, str]] = [
    ("Apache-2.0", r"Apache(?: Software)? License,? (?:Version |v\.?)?2(?:\.0)?", r"ALv2|ASL[ -]?2\.0|Apache[ -]2(?:\.0)?", r"apache\.org/licenses/LICENSE-2\.0"),
    ("Apache-1.1", r"Apache(?: Software)? License,? (?:Version |v\.?)?1\.1", r"ASL[ -]?1\.1|Apache[ -]1\.1", r"apache\.org/licenses/LICENSE-1\.1"),
    ("Apache-1.0", r"Apache(?: Software)? License,? (?:Version |v\.?)?1\.0", r"ASL[ -]?1\.0|Apache[ -]1\.0", r"apache\.org/licenses/LICENSE-1\.0"),
    ("MIT", r"MIT(?:/X11)? License", r"Expat License|X11 License \(MIT\)|MIT-licensed", r"opensource\.org/licenses/(?:MIT|mit-license(?:\.php)?)"),
    ("MIT-0", r"MIT No Attribution(?: License)?", r"MIT-0|MIT Zero", r"opensource\.org/licenses/MIT-0"),
    ("X11", r"X11 License", r"X Consortium License", r"x\.org/Downloads_terms\.html"),
    ("ISC", r"ISC License", r"Internet Systems Consortium License|ISC-licensed", r"opensource\.org/licenses/ISC"),
    ("BSD-2-Clause", r"(?:BSD 2-Clause|2-Clause BSD|Two-Clause BSD|Simplified BSD|FreeBSD) License", r"BSD-2|BSD 2 clause", r"opensource\.org/licenses/(?:BSD-2-Clause|bsd-license(?:\.php)?)"),
    ("BSD-3-Clause", r"(?:BSD 3-Clause|3-Clause BSD|Three-Clause BSD|New BSD|Modified BSD|Revised BSD) License", r"BSD-3|BSD 3 clause", r"opensource\.org/licenses/BSD-3-Clause"),
    ("BSD-4-Clause", r"(?:BSD 4-Clause|4-Clause BSD|Original BSD|Old BSD) License", r"BSD-4|BSD 4 clause", r"spdx\.org/licenses/BSD-4-Clause"),
    ("0BSD", r"(?:BSD Zero Clause|Zero-Clause BSD|Free Public) License(?: 1\.0\.0)?", r"BSD0|0-clause BSD", r"opensource\.org/licenses/0BSD"),
    ("GPL-1.0", r"GNU General Public Licen[cs]e,? (?:Version |v\.?)?1(?:\.0)?(?!\.?\d)", r"GPL[ -]?v?1(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/old-licenses/gpl-1\.0"),
    ("GPL-2.0", r"GNU General Public Licen[cs]e,? (?:Version |v\.?)?2(?:\.0)?(?!\.?\d)", r"GPL[ -]?v?2(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("GPL-3.0", r"GNU General Public Licen[cs]e,? (?:Version |v\.?)?3(?:\.0)?(?!\.?\d)", r"GPL[ -]?v?3(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/gpl-3\.0"),
    ("LGPL-2.0", r"GNU Library General Public Licen[cs]e,? (?:Version |v\.?)?2(?:\.0)?(?!\.?\d)", r"LGPL[ -]?v?2(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("LGPL-2.1", r"GNU Lesser General Public Licen[cs]e,? (?:Version |v\.?)?2\.1", r"LGPL[ -]?v?2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("LGPL-3.0", r"GNU Lesser General Public Licen[cs]e,? (?:Version |v\.?)?3(?:\.0)?(?!\.?\d)", r"LGPL[ -]?v?3(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/lgpl-3\.0"),
    ("AGPL-3.0", r"GNU Affero General Public Licen[cs]e,? (?:Version |v\.?)?3(?:\.0)?(?!\.?\d)", r"AGPL[ -]?v?3(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/agpl-3\.0"),
    ("AGPL-1.0", r"Affero General Public Licen[cs]e,? (?:Version |v\.?)?1(?:\.0)?(?!\.?\d)", r"AGPL[ -]?v?1(?:\.0)?(?!\.?\d)", r"affero\.org/oagpl\.html"),
    ("GFDL-1.1", r"GNU Free Documentation Licen[cs]e,? (?:Version |v\.?)?1\.1", r"GFDL[ -]?v?1\.1", r"gnu\.org/licenses/old-licenses/fdl-1\.1"),
    ("GFDL-1.2", r"GNU Free Documentation Licen[cs]e,? (?:Version |v\.?)?1\.2", r"GFDL[ -]?v?1\.2", r"gnu\.org/licenses/old-licenses/fdl-1\.2"),
    ("GFDL-1.3", r"GNU Free Documentation Licen[cs]e,? (?:Version |v\.?)?1\.3", r"GFDL[ -]?v?1\.3", r"gnu\.org/licenses/fdl-1\.3"),
    ("MPL-1.0", r"Mozilla Public Licen[cs]e,? (?:Version |v\.?)?1\.0", r"MPL[ -]?v?1\.0", r"mozilla\.org/MPL/MPL-1\.0"),
    ("MPL-1.1", r"Mozilla Public Licen[cs]e,? (?:Version |v\.?)?1\.1", r"MPL[ -]?v?1\.1", r"mozilla\.org/MPL/(?:MPL-)?1\.1"),
    ("MPL-2.0", r"Mozilla Public Licen[cs]e,? (?:Version |v\.?)?2\.0", r"MPL[ -]?v?2(?:\.0)?(?!\.?\d)", r"mozilla\.org/(?:en-US/)?MPL/2\.0"),
    ("EPL-1.0", r"Eclipse Public Licen[cs]e(?: -)?,? (?:Version |v\.?)?1\.0", r"EPL[ -]?v?1\.0", r"eclipse\.org/legal/epl-v10"),
    ("EPL-2.0", r"Eclipse Public Licen[cs]e(?: -)?,? (?:Version |v\.?)?2\.0", r"EPL[ -]?v?2\.0", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("EDL-1.0", r"Eclipse Distribution Licen[cs]e(?: -)?,? (?:Version |v\.?)?1\.0", r"EDL[ -]?v?1\.0", r"eclipse\.org/org/documents/edl-v10"),
    ("CDDL-1.0", r"Common Development and Distribution Licen[cs]e,? (?:Version |v\.?)?1\.0", r"CDDL[ -]?v?1\.0", r"opensource\.org/licenses/CDDL-1\.0"),
    ("CDDL-1.1", r"Common Development and Distribution Licen[cs]e,? (?:Version |v\.?)?1\.1", r"CDDL[ -]?v?1\.1", r"spdx\.org/licenses/CDDL-1\.1"),
    ("CPL-1.0", r"Common Public Licen[cs]e,? (?:Version |v\.?)?1\.0", r"CPL[ -]?v?1\.0", r"opensource\.org/licenses/cpl1\.0"),
    ("IPL-1.0", r"IBM Public Licen[cs]e,? (?:Version |v\.?)?1\.0", r"IPL[ -]v?1\.0", r"opensource\.org/licenses/IPL-1\.0"),
    ("EUPL-1.1", r"European Union Public Licen[cs]e,? (?:Version |v\.? ?)?1\.1", r"EUPL[ -]?v?1\.1", r"spdx\.org/licenses/EUPL-1\.1"),
    ("EUPL-1.2", r"European Union Public Licen[cs]e,? (?:Version |v\.? ?)?1\.2", r"EUPL[ -]?v?1\.2", r"eupl\.eu/1\.2"),
    ("CeCILL-2.1", r"CeCILL(?: FREE SOFTWARE LICENSE AGREEMENT)?,? (?:Version |v\.?)?2\.1", r"CECILL-2\.1", r"cecill\.info/licences/Licence_CeCILL_V2\.1"),
    ("CeCILL-B", r"CeCILL-B(?: FREE SOFTWARE LICENSE AGREEMENT| License)?", r"CECILL B License", r"cecill\.info/licences/Licence_CeCILL-B"),
    ("CeCILL-C", r"CeCILL-C(?: FREE SOFTWARE LICENSE AGREEMENT| License)?", r"CECILL C License", r"cecill\.info/licences/Licence_CeCILL-C"),
    ("Artistic-1.0", r"Artistic Licen[cs]e,? (?:Version |v\.?)?1\.0", r"Artistic-1\.0", r"opensource\.org/licenses/Artistic-1\.0"),
    ("Artistic-2.0", r"Artistic Licen[cs]e,? (?:Version |v\.?)?2\.0", r"Artistic-2\.0", r"opensource\.org/licenses/Artistic-2\.0"),
    ("Zlib", r"zlib(?:/libpng)? Licen[cs]e", r"zlib-licensed", r"zlib\.net/zlib_license"),
    ("Libpng", r"(?:PNG Reference Library|libpng) Licen[cs]e(?: version [12])?", r"libpng-2\.0", r"libpng\.org/pub/png/src/libpng-LICENSE"),
    ("BSL-1.0", r"Boost Software Licen[cs]e(?: -)?,? (?:Version |v\.?)?1\.0", r"BSL[ -]1\.0", r"boost\.org/LICENSE_1_0\.txt"),
    ("BUSL-1.1", r"Business Source Licen[cs]e,? (?:Version |v\.?)?1\.1", r"BUSL[ -]1\.1", r"mariadb\.com/bsl11"),
    ("Unlicense", r"The Unlicense", r"Unlicen[cs]ed into the public domain", r"unlicense\.org"),
    ("WTFPL", r"Do What The F[u*]ck You Want To Public Licen[cs]e", r"WTFPL(?: v?2)?", r"wtfpl\.net"),
    ("CC0-1.0", r"(?:Creative Commons )?CC0 1\.0(?: Universal)?|Creative Commons Zero(?: v?1\.0)?", r"CC0[ -]?1\.0|CC0 Public Domain Dedication", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("CC-BY-1.0", r"Creative Commons Attribution 1\.0", r"CC[ -]BY[ -]1\.0", r"creativecommons\.org/licenses/by/1\.0"),
    ("CC-BY-2.0", r"Creative Commons Attribution 2\.0", r"CC[ -]BY[ -]2\.0", r"creativecommons\.org/licenses/by/2\.0"),
    ("CC-BY-2.5", r"Creative Commons Attribution 2\.5", r"CC[ -]BY[ -]2\.5", r"creativecommons\.org/licenses/by/2\.5"),
    ("CC-BY-3.0", r"Creative Commons Attribution 3\.0", r"CC[ -]BY[ -]3\.0", r"creativecommons\.org/licenses/by/3\.0"),
    ("CC-BY-4.0", r"Creative Commons Attribution 4\.0", r"CC[ -]BY[ -]4\.0", r"creativecommons\.org/licenses/by/4\.0"),
    ("CC-BY-SA-2.0", r"Creative Commons Attribution-?Share-?Alike 2\.0", r"CC[ -]BY[ -]SA[ -]2\.0", r"creativecommons\.org/licenses/by-sa/2\.0"),
    ("CC-BY-SA-2.5", r"Creative Commons Attribution-?Share-?Alike 2\.5", r"CC[ -]BY[ -]SA[ -]2\.5", r"creativecommons\.org/licenses/by-sa/2\.5"),
    ("CC-BY-SA-3.0", r"Creative Commons Attribution-?Share-?Alike 3\.0", r"CC[ -]BY[ -]SA[ -]3\.0", r"creativecommons\.org/licenses/by-sa/3\.0"),
    ("CC-BY-SA-4.0", r"Creative Commons Attribution-?Share-?Alike 4\.0", r"CC[ -]BY[ -]SA[ -]4\.0", r"creativecommons\.org/licenses/by-sa/4\.0"),
    ("CC-BY-ND-3.0", r"Creative Commons Attribution-?No-?Deriv(?:ative)?s? 3\.0", r"CC[ -]BY[ -]ND[ -]3\.0", r"creativecommons\.org/licenses/by-nd/3\.0"),
    ("CC-BY-ND-4.0", r"Creative Commons Attribution-?No-?Deriv(?:ative)?s? 4\.0", r"CC[ -]BY[ -]ND[ -]4\.0", r"creativecommons\.org/licenses/by-nd/4\.0"),
    ("CC-BY-NC-2.0", r"Creative Commons Attribution-?Non-?Commercial 2\.0", r"CC[ -]BY[ -]NC[ -]2\.0", r"creativecommons\.org/licenses/by-nc/2\.0"),
    ("CC-BY-NC-3.0", r"Creative Commons Attribution-?Non-?Commercial 3\.0", r"CC[ -]BY[ -]NC[ -]3\.0", r"creativecommons\.org/licenses/by-nc/3\.0"),
    ("CC-BY-NC-4.0", r"Creative Commons Attribution-?Non-?Commercial 4\.0", r"CC[ -]BY[ -]NC[ -]4\.0", r"creativecommons\.org/licenses/by-nc/4\.0"),
    ("CC-BY-NC-SA-3.0", r"Creative Commons Attribution-?Non-?Commercial-?Share-?Alike 3\.0", r"CC[ -]BY[ -]NC[ -]SA[ -]3\.0", r"creativecommons\.org/licenses/by-nc-sa/3\.0"),
    ("CC-BY-NC-SA-4.0", r"Creative Commons Attribution-?Non-?Commercial-?Share-?Alike 4\.0", r"CC[ -]BY[ -]NC[ -]SA[ -]4\.0", r"creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("CC-BY-NC-ND-3.0", r"Creative Commons Attribution-?Non-?Commercial-?No-?Deriv(?:ative)?s? 3\.0", r"CC[ -]BY[ -]NC[ -]ND[ -]3\.0", r"creativecommons\.org/licenses/by-nc-nd/3\.0"),
    ("CC-BY-NC-ND-4.0", r"Creative Commons Attribution-?Non-?Commercial-?No-?Deriv(?:ative)?s? 4\.0", r"CC[ -]BY[ -]NC[ -]ND[ -]4\.0", r"creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("OFL-1.1", r"SIL Open Font Licen[cs]e,? (?:Version |v\.?)?1\.1", r"OFL[ -]?v?1\.1", r"scripts\.sil\.org/OFL"),
    ("ODbL-1.0", r"Open (?:Data Commons Open )?Database Licen[cs]e(?: \(ODbL\))?(?:,? v?1\.0)?", r"ODbL(?:[ -]v?1\.0)?", r"opendatacommons\.org/licenses/odbl"),
    ("ODC-By-1.0", r"Open Data Commons Attribution Licen[cs]e(?:,? v?1\.0)?", r"ODC-By(?:[ -]v?1\.0)?", r"opendatacommons\.org/licenses/by"),
    ("PDDL-1.0", r"(?:Open Data Commons )?Public Domain Dedication (?:and|&) Licen[cs]e(?:,? v?1\.0)?", r"PDDL(?:[ -]v?1\.0)?", r"opendatacommons\.org/licenses/pddl"),
    ("CDLA-Permissive-1.0", r"Community Data Licen[cs]e Agreement(?: -)? Permissive(?:,? (?:Version )?1\.0)?", r"CDLA-Permissive-1\.0", r"cdla\.io/permissive-1-0"),
    ("CDLA-Sharing-1.0", r"Community Data Licen[cs]e Agreement(?: -)? Sharing(?:,? (?:Version )?1\.0)?", r"CDLA-Sharing-1\.0", r"cdla\.io/sharing-1-0"),
    ("Python-2.0", r"Python(?: Software Foundation)? Licen[cs]e(?: Version)?,? 2(?:\.0)?", r"PSF-2\.0|PSF License", r"python\.org/psf/license"),
    ("PHP-3.01", r"PHP Licen[cs]e,? (?:Version |v\.?)?3\.01", r"PHP-3\.01", r"php\.net/license/3_01"),
    ("PHP-3.0", r"PHP Licen[cs]e,? (?:Version |v\.?)?3\.0(?!1)", r"PHP-3\.0(?!1)", r"php\.net/license/3_0(?!1)"),
    ("PostgreSQL", r"PostgreSQL Licen[cs]e", r"PostgreSQL-licensed", r"postgresql\.org/about/licence"),
    ("OpenSSL", r"OpenSSL Licen[cs]e", r"SSLeay Licen[cs]e", r"openssl\.org/source/license"),
    ("Ruby", r"Ruby(?:'s)? Licen[cs]e", r"Ruby-licensed", r"ruby-lang\.org/en/about/license"),
    ("Vim", r"Vim Licen[cs]e", r"Vim-licensed", r"vimdoc\.sourceforge\.net/htmldoc/uganda"),
    ("W3C", r"W3C Software(?: and Document)? (?:Notice and )?Licen[cs]e", r"W3C-20150513|W3C-19980720", r"w3\.org/Consortium/Legal/(?:\d{4}/)?copyright-software"),
    ("Unicode-DFS", r"Unicode(?:, Inc\.)? Licen[cs]e Agreement", r"Unicode-DFS-201[56]", r"unicode\.org/copyright"),
    ("NCSA", r"(?:University of Illinois/)?NCSA Open Source Licen[cs]e", r"UIUC Licen[cs]e", r"opensource\.org/licenses/NCSA"),
    ("ICU", r"ICU Licen[cs]e", r"ICU-licensed", r"source\.icu-project\.org/repos/icu"),
    ("AFL-3.0", r"Academic Free Licen[cs]e,? (?:Version |v\.? ?)?3\.0", r"AFL[ -]?v?3\.0", r"opensource\.org/licenses/AFL-3\.0"),
    ("AFL-2.1", r"Academic Free Licen[cs]e,? (?:Version |v\.? ?)?2\.1", r"AFL[ -]?v?2\.1", r"spdx\.org/licenses/AFL-2\.1"),
    ("OSL-3.0", r"Open Software Licen[cs]e,? (?:Version |v\.? ?)?3\.0", r"OSL[ -]?v?3\.0", r"opensource\.org/licenses/OSL-3\.0"),
    ("MS-PL", r"Microsoft Public Licen[cs]e", r"MS-PL", r"opensource\.org/licenses/MS-PL"),
    ("MS-RL", r"Microsoft Reciprocal Licen[cs]e", r"MS-RL", r"opensource\.org/licenses/MS-RL"),
    ("UPL-1.0", r"Universal Permissive Licen[cs]e,? (?:Version |v\.? ?)?1\.0", r"UPL[ -]?v?1\.0", r"oss\.oracle\.com/licenses/upl"),
    ("SSPL-1.0", r"Server Side Public Licen[cs]e,? (?:Version |v\.? ?)?1", r"SSPL(?:[ -]?v?1(?:\.0)?)?", r"mongodb\.com/licensing/server-side-public-license"),
    ("Elastic-2.0", r"Elastic Licen[cs]e,? (?:Version |v\.? ?)?2\.0", r"ELv2|Elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    ("MulanPSL-2.0", r"Mulan P(?:ermissive Software License|SL),? (?:Version |v\.? ?)?2", r"MulanPSL-2\.0", r"license\.coscl\.org\.cn/MulanPSL2"),
    ("BlueOak-1.0.0", r"Blue Oak Model Licen[cs]e(?: 1\.0\.0)?", r"BlueOak-1\.0\.0", r"blueoakcouncil\.org/license/1\.0\.0"),
    ("EFL-2.0", r"Eiffel Forum Licen[cs]e,? (?:Version |v\.? ?)?2", r"EFL-2\.0", r"opensource\.org/licenses/ver2_eiffel"),
    ("LPPL-1.3c", r"LaTeX Project Public Licen[cs]e,? (?:Version |v\.? ?)?1\.3c?", r"LPPL[ -]?(?:v?1\.3c?)", r"latex-project\.org/lppl"),
    ("QPL-1.0", r"Q Public Licen[cs]e,? (?:Version |v\.? ?)?1\.0", r"QPL-1\.0", r"doc\.qt\.io/archives/.{0,20}license\.html"),
    ("SISSL", r"Sun Industry Standards Source Licen[cs]e", r"SISSL(?:[ -]1\.[12])?", r"opensource\.org/licenses/SISSL"),
    ("OLDAP-2.8", r"OpenLDAP Public Licen[cs]e,? (?:Version |v\.? ?)?2\.8", r"OLDAP-2\.8", r"openldap\.org/software/release/license"),
    ("Sleepycat", r"Sleepycat(?: Public)? Licen[cs]e", r"Berkeley DB Licen[cs]e", r"opensource\.org/licenses/Sleepycat"),
    ("JSON", r"JSON Licen[cs]e", r"shall be used for Good, not Evil", r"json\.org/license"),
    ("Beerware", r"Beer-?ware Licen[cs]e", r"THE BEER-WARE", r"people\.freebsd\.org/~phk"),
    ("OpenRAIL-M", r"(?:CreativeML |BigScience )?Open RAIL[ -]?\+?\+?-?M(?: License)?", r"OpenRAIL(?:\+\+)?-M", r"huggingface\.co/spaces/(?:CompVis|bigscience)/.{0,20}license"),
    ("Llama-Community", r"Llama [234](?:\.\d)? Community Licen[cs]e(?: Agreement)?", r"LLAMA-COMMUNITY", r"llama\.meta\.com/license"),
]

def _spaced(pattern: str) -> str:
    """Spaces outside of character classes become any white space or comment leaders."""
    return re.sub(r"\[[^\]]*\]| ", lambda m: _W if m[0] == " " else m[0], pattern)


def _branches(pattern: str) -> list[str]:
    depth, out = 0, [""]
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _keywords(pattern: str) -> tuple[str, ...]:
    """For each branch of a pattern the plain runs that all its matches hold, joined by & (all are needed), in lower case."""
    out = []
    for b in _branches(pattern):
        b = re.sub(r"(?<!\\)\.\{[\d,]*\}", "\0", b)
        b = re.sub(r"\(\?[:!=<]*", "(", b.replace(r"\.", "."))
        b = re.sub(r"\[[^\]]*\][?*+]?|\\.", "\0", b)
        while re.search(r"\([^()]*\)\??", b):
            b = re.sub(r"\([^()]*\)\??", "\0", b)
        b = re.sub(r".[?*]", "\0", b)
        out.append("&".join(dict.fromkeys(r.lower() for r in re.findall(r"[A-Za-z0-9.:/_'-]{2,}", b) if re.search("[A-Za-z]{2}", r))))
    if not all(out):
        raise ValueError(f"no keyword in {pattern!r}")
    return tuple(dict.fromkeys(out))


def _openings(pattern: str) -> tuple[str, ...]:
    """For each branch of a short form the plain texts that it may open with."""
    out: list[str] = []
    for b in _branches(pattern):
        heads = [""]
        for piece in re.findall(r"\[ -\]\??|\\\.|.[?*]|.", b):
            if piece.startswith("[ -]"):
                heads = [h + x for h in heads for x in (" ", "-", "")[: 2 + piece.endswith("?")]]
            elif piece == "\\.":
                heads = [h + "." for h in heads]
            elif re.fullmatch(r"[A-Za-z0-9 '-]", piece):
                heads = [h + piece.lower() for h in heads]
            else:
                break
            if max(map(len, heads)) >= 6:
                break
        out += heads
    if min(map(len, out)) < 3:
        raise ValueError(f"no keyword in {pattern!r}")
    return tuple(dict.fromkeys(out))


def _rules() -> list[tuple[str, str, int, tuple[str, ...], str]]:
    out = []
    for lic, prose, short, url in _NAMED:
        plain = lic.replace(".", r"\.")
        prose_ = _spaced(prose)
        for name, priority, pattern, words in (
            ("grant", 70, rf"(?:(?:dual-)?licen[cs]ed|released|distributed|available|provided|covered|redistributed?)(?:{_W}and(?:/or)?{_W}modif(?:y|ied))?(?:{_W}\(?the{_W}[\w\" ]{{1,30}}\)?)?{_W}(?:it{_W})?(?:under|by|with){_W}(?:the{_W})?(?:terms{_W}(?:and{_W}conditions{_W})?of{_W}(?:the{_W})?)?(?:{prose_}|{short}|{plain})(?![\w-])", _keywords(prose) + _openings(short) + tuple(f"{lic.lower()}&{v}" for v in ("licen", "released", "distribut", "available", "provided", "covered"))),
            ("id", 60, rf"SPDX-License-Identifier:\s*\(?(?:[\w.+-]+\s+(?:OR|AND|WITH)\s+)*{plain}(?:-only|-or-later|\+)?(?![\w.-])", ("spdx-license-identifier",)),
            ("url", 50, rf"(?:https?://)?(?:www\.)?{url}[\w./#-]*", _keywords(url)),
            ("name", 30, rf"(?<![\w-]){prose_}(?![\w-])", _keywords(prose)),
            ("short", 20, rf"(?<![\w-])(?:{short})(?![\w-])", _openings(short)),
        ):
            out.append((f"{lic}/{name}", lic, priority, tuple(dict.fromkeys(words)), pattern))
    return out


_NOTICES: list[tuple[str, str, int, tuple[str, ...], str]] = [
    ("MIT/text", "MIT", 90, ("permission&is&hereby&granted",), _t("Permission is hereby granted, free of charge, to any person obtaining a copy") + r"[\s\S]{0,1200}?" + _t("THE SOFTWARE IS PROVIDED") + r"[\s\S]{0,20}?AS IS"),
    ("ISC/text", "ISC", 90, ("permission&to&use,&copy,&modify,",), _t("Permission to use, copy, modify,") + _W + r"and(?:/or)?" + _W + _t("distribute this software for any purpose with or without fee is hereby granted")),
    ("BSD/redistribution", "BSD", 80, ("redistribution&and&use&in&source",), _t("Redistribution and use in source and binary forms, with or without modification, are permitted")),
    ("BSD-3-Clause/endorse", "BSD-3-Clause", 80, ("endorse&neither&the&name&of",), _t("Neither the name of") + r"[\s\S]{1,120}?" + _t("may be used to endorse or promote products")),
    ("BSD-4-Clause/advert", "BSD-4-Clause", 80, ("advertising&all&materials",), _t("All advertising materials mentioning features or use of this software must display")),
    ("Apache-2.0/text", "Apache-2.0", 90, ("compliance&licensed&apache&you&may&not&use&this&file&except",), r"Licensed" + _W + _t("under the Apache License, Version 2.0") + r"[\s\S]{0,80}?" + _t("you may not use this file except in compliance with the License")),
    ("GPL/text-later", "GPL", 85, ("foundation&either&version",), _t("under the terms of the GNU General Public License as published by the Free Software Foundation") + r"[\s\S]{0,60}?either" + _W + r"version" + _W + r"[123]" + r"[\s\S]{0,60}?any" + _W + r"later" + _W + "version"),
    ("LGPL/text-later", "LGPL", 85, ("foundation&either&version",), _t("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation") + r"[\s\S]{0,60}?either" + _W + r"version" + _W + r"(?:2\.1|3)" + r"[\s\S]{0,60}?any" + _W + r"later" + _W + "version"),
    ("MPL-2.0/text", "MPL-2.0", 90, ("subject&source&code&form&is",), _t("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0")),
    ("Unlicense/text", "Unlicense", 90, ("unencumbered&free&and&software",), _t("This is free and unencumbered software released into the public domain")),
    ("Zlib/text", "Zlib", 90, ("as-is",), _t("This software is provided 'as-is', without any express or implied warranty") + r"[\s\S]{0,400}?" + _t("The origin of this software must not be misrepresented")),
    ("BSL-1.0/text", "BSL-1.0", 90, ("software&boost&license",), _t("Distributed under the Boost Software License, Version 1.0")),
    ("CC/generic", "CC", 40, ("creative&commons",), r"Creative" + _W + r"Commons" + _W + r"(?:Attribution|License|Licence)[\w-]*"),
    ("GPL/generic", "GPL", 15, ("general&public&licen",), r"GNU" + _W + r"(?:Lesser" + _W + r"|Library" + _W + r"|Affero" + _W + r")?General" + _W + r"Public" + _W + r"Licen[cs]e"),
    ("BSD/generic", "BSD", 15, ("bsd",), r"(?<![\w-])BSD(?:-style|-like)?" + _W + r"licen[cs]ed?(?![\w-])"),
    ("Proprietary/all-rights", "Proprietary", 20, ("reserved&all&rights",), r"All" + _W + r"rights" + _W + r"reserved\.?"),
    ("Proprietary/confidential", "Proprietary", 25, ("confidential",), r"(?:proprietary" + _W + r"and" + _W + r"confidential|confidential" + _W + r"and" + _W + r"proprietary)"),
    ("Proprietary/no-copy", "Proprietary", 25, ("unauthorized&copying", "unauthorised&copying"), r"Unauthori[sz]ed" + _W + r"copying" + _W + r"of" + _W + r"this" + _W + r"file"),
    ("PublicDomain/dedication", "PublicDomain", 25, ("domain&the&public",), r"(?:released|placed|dedicated)" + _W + r"(?:in|into|to)" + _W + r"the" + _W + r"public" + _W + r"domain"),
    ("Copyright/notice", "Copyright", 10, ("copyright", "©"), r"(?:copyright|©)" + r"(?:\s*(?:\(c\)|©))?\s+(?:\d{4}(?:\s*[-,]\s*\d{4})*,?\s+)?(?:by\s+)?[A-Z][\w.&' -]{1,60}"),
    ("SPDX/other", "Unknown-SPDX", 12, ("spdx-license-identifier",), r"SPDX-License-Identifier:\s*[\w.+()-]+(?:\s+(?:OR|AND|WITH)\s+[\w.+()-]+)*"),
    ("Licence/see-file", "See-file", 11, ("see&licen",), r"see" + _W + r"(?:the" + _W + r")?(?:accompanying" + _W + r")?(?:LICEN[CS]E(?:\.txt|\.md)?)(?:" + _W + r"file)?"),
    ("Licence/unknown", "Unknown", 5, ("licensed&under", "licenced&under"), r"licen[cs]ed" + _W + r"under" + _W + r"[\w .,-]{2,60}"),
]

RULES = _NOTICES + _rules()
