"""License signatures: regexes over normalized words, in order.

A rule is (priority, label, keyword, pattern). Patterns match whole words of a text whose
words are lower-cased and separated by one space. A rule is tried only on texts that contain
its keyword. Higher priorities are more exact: full statements 90 and up, names with a
version 70, names 50, hints 30.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    priority: int
    label: str
    keyword: str
    pattern: str


# The phrases of the base scan, as words, and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

_L = "licen[cs]ed?"
_THE = "(?:the )?"
_V = "(?: version| v| ver)?"

_STATEMENTS = (
    (98, "mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    (92, "mit", "mit", f"(?:released|{_L}|distributed|available|provided|published) under {_THE}mit {_L}"),
    (91, "mit", "mit", f"under the terms of {_THE}mit {_L}"),
    (70, "mit", "mit", "mit licen[cs]ed?"),
    (72, "mit-0", "mit", "mit (?:0|no attribution)"),
    (70, "mit", "expat", f"expat {_L}"),
    (98, "isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
    (70, "isc", "isc", f"isc {_L}"),
    (98, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
    (75, "bsd-2-clause", "bsd", f"(?:2|two) clause bsd(?: {_L})?"),
    (75, "bsd-3-clause", "bsd", f"(?:3|three) clause bsd(?: {_L})?"),
    (75, "bsd-4-clause", "bsd", f"(?:4|four) clause bsd(?: {_L})?"),
    (75, "bsd-2-clause", "bsd", "bsd 2(?: clause)?"),
    (75, "bsd-3-clause", "bsd", "bsd 3(?: clause)?"),
    (75, "bsd-4-clause", "bsd", "bsd 4(?: clause)?"),
    (74, "bsd-2-clause", "bsd", f"(?:simplified|freebsd) bsd(?: {_L})?"),
    (74, "bsd-3-clause", "bsd", f"(?:new|revised|modified) bsd(?: {_L})?"),
    (74, "bsd-4-clause", "bsd", f"(?:original|old) bsd(?: {_L})?"),
    (55, "bsd", "bsd", f"bsd(?: style)? {_L}"),
    (95, "apache-2", "apache", f"{_L} under {_THE}apache {_L}{_V} 2(?: 0)?"),
    (80, "apache-2", "apache", f"apache {_L}{_V} 2(?: 0)?"),
    (78, "apache-1.1", "apache", f"apache (?:software )?{_L}{_V} 1 1"),
    (78, "apache-1", "apache", f"apache (?:software )?{_L}{_V} 1 0"),
    (55, "apache", "apache", f"apache(?: software)? {_L}"),
    (96, "apache-2", "apache org", "apache org licenses license 2 0"),
    (70, "artistic-2", "artistic", f"artistic {_L}{_V} 2(?: 0)?"),
    (50, "artistic", "artistic", f"artistic {_L}"),
    (70, "boost-1", "boost", f"boost software {_L}(?:{_V} 1 0)?"),
    (70, "zlib", "zlib", f"zlib(?: libpng)? {_L}"),
    (70, "unlicense", "unlicense", "(?:the )?unlicense"),
    (95, "unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    (60, "public-domain", "public domain", "(?:released|dedicated|placed|is) (?:in|to|into) the public domain"),
    (40, "public-domain", "public domain", "public domain"),
    (70, "wtfpl", "wtfpl", "wtfpl"),
    (70, "python-2", "python", f"python software foundation {_L}"),
    (70, "php-3", "php", f"php {_L}{_V} 3(?: 0[01]?)?"),
    (70, "postgresql", "postgresql", f"postgresql {_L}"),
    (70, "openssl", "openssl", f"openssl {_L}"),
    (70, "ruby", "ruby", f"ruby {_L}"),
    (70, "vim", "vim", f"vim {_L}"),
    (70, "ofl-1.1", "open font", f"(?:sil )?open font {_L}(?:{_V} 1 1)?"),
    (70, "ncsa", "ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_L}"),
    (70, "afl-3", "academic free", f"academic free {_L}(?:{_V} 3(?: 0)?)?"),
    (70, "ms-pl", "microsoft", f"microsoft public {_L}"),
    (70, "ms-rl", "microsoft", f"microsoft reciprocal {_L}"),
    (70, "odbl-1", "open data", f"open (?:data commons open )?database {_L}"),
    (70, "odbl-1", "open database", f"open database {_L}"),
    (70, "pddl-1", "public domain dedication", f"public domain dedication and {_L}"),
    (70, "osl-3", "open software", f"open software {_L}{_V} 3(?: 0)?"),
    (70, "elastic-2", "elastic", f"elastic {_L}(?:{_V} 2(?: 0)?)?"),
    (70, "sspl-1", "server side public", f"server side public {_L}(?:{_V} 1)?"),
    (70, "busl-1.1", "business source", f"business source {_L}(?:{_V} 1 1)?"),
    (60, "proprietary", "all rights reserved", "all rights reserved"),
    (65, "proprietary", "proprietary", f"proprietary(?: and confidential| {_L}| software)"),
    (30, "copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}"),
    (30, "copyright", "copyright", "(?:c )?copyright by"),
    (30, "license", "licen", f"{_L} under(?: the)?"),
    (30, "license", "licen", f"see (?:the )?licen[cs]e(?: file)?"),
)

# Families that follow one scheme: (name in words, label, versions).
_VERSIONED = (
    ("gnu general public", "gpl", ("1", "2", "3")),
    ("gnu lesser general public", "lgpl", ("2", "2 1", "3")),
    ("gnu library general public", "lgpl", ("2", "2 1")),
    ("gnu affero general public", "agpl", ("1", "3")),
    ("gnu free documentation", "gfdl", ("1 1", "1 2", "1 3")),
    ("mozilla public", "mpl", ("1", "1 1", "2")),
    ("eclipse public", "epl", ("1", "2")),
    ("european union public", "eupl", ("1 1", "1 2")),
    ("common development and distribution", "cddl", ("1", "1 1")),
    ("common public", "cpl", ("1",)),
    ("cecill", "cecill", ("1", "2", "2 1")),
)
_ACRONYMS = (
    ("gpl", ("1", "2", "3")),
    ("lgpl", ("2", "2 1", "3")),
    ("agpl", ("1", "3")),
    ("gfdl", ("1 1", "1 2", "1 3")),
    ("mpl", ("1", "1 1", "2")),
    ("epl", ("1", "2")),
    ("eupl", ("1 1", "1 2")),
    ("cddl", ("1", "1 1")),
    ("cecill", ("2", "2 1")),
)
_CC_KINDS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_CC_WORDS = {
    "by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ativework)s?(?: works)?",
}
_CC_VERSIONS = ("1", "2", "2 5", "3", "4")


def _dotted(version: str) -> str:
    return version.replace(" ", ".")


def rules() -> list[Rule]:
    """All rules in order: an earlier rule wins over a later one of equal priority and place."""
    found = [Rule(*r) for r in _STATEMENTS]
    for name, label, versions in _VERSIONED:
        keyword = name.split()[-1] if name == "cecill" else name
        found.append(Rule(55, label, keyword, f"{name}(?: {_L})?"))
        for v in versions:
            found.append(Rule(75, f"{label}-{_dotted(v)}", keyword, f"{name} {_L}{_V} {v}(?: 0)?"))
            found.append(Rule(76, f"{label}-{_dotted(v)}-or-later", keyword, f"{name} {_L}(?: as published by the free software foundation either)?{_V} {v}(?: 0)?(?: of the license)?(?: or)?(?: any)? later(?: version)?"))
    for name, versions in _ACRONYMS:
        found.append(Rule(50, name, name, f"(?:gnu )?{name}"))
        for v in versions:
            found.append(Rule(72, f"{name}-{_dotted(v)}", name, f"(?:gnu )?{name}{_V} ?v?{v}(?: 0)?(?: only)?"))
            found.append(Rule(73, f"{name}-{_dotted(v)}-or-later", name, f"(?:gnu )?{name}{_V} ?v?{v}(?: 0)? or later"))
    for kind in _CC_KINDS:
        words = " ".join(_CC_WORDS[w] for w in kind.split())
        label = "cc-" + kind.replace(" ", "-")
        found.append(Rule(60 + kind.count(" "), label, "cc by", f"cc {kind}"))
        found.append(Rule(60 + kind.count(" "), label, "creative commons", f"creative commons {words}(?: {_L})?"))
        for v in _CC_VERSIONS:
            exact = f"{label}-{_dotted(v)}"
            found.append(Rule(80, exact, "cc by", f"cc {kind} {v}(?: 0)?"))
            found.append(Rule(80, exact, "creative commons", f"creative commons {words} {v}(?: 0)?(?: international| unported| generic)?(?: {_L})?"))
            found.append(Rule(85, exact, "creativecommons", f"creativecommons org licenses {kind} {v}(?: 0)?"))
    found.append(Rule(80, "cc0-1", "cc0", "cc0(?: 1 0)?(?: universal)?"))
    found.append(Rule(85, "cc0-1", "creativecommons", "creativecommons org publicdomain zero 1 0"))
    found.append(Rule(50, "creative-commons", "creative commons", f"creative commons(?: {_L})?"))
    return found


# A gap between words of raw text, and the place where a word begins.
_GAP = r"[\x00-/:-@\[-`{-\x7f]+"
_BEGIN = r"(?<![^\x00-/:-@\[-`{-\x7f])"
#: Keywords that are words of ordinary prose (German "mit"): their whole patterns gate.
_COMMON = ("mit",)


def _certain(pattern: str) -> str:
    """The pattern with a mark for all that a match may lack or have otherwise."""
    left = re.sub(r"\[[^]]*\]|\w\?| \?", "\0", pattern)
    while (inner := re.sub(r"\(\?:[^()]*\)\??", "\0", left)) != left:
        left = inner
    return "" if "|" in left else f" {left}"


def gate() -> str:
    """What a text must contain before any rule or base phrase is tried, as a regex over raw
    text. A rule passes by "licen" at the start of a word if all its matches have it, else by
    its keyword, or by its pattern where the keyword is common."""
    terms = []
    for keyword, pattern in [(p, p) for p, _ in BASE] + [(r.keyword, r.pattern) for r in rules()]:
        term = "licen" if " licen" in _certain(pattern) else pattern if keyword in _COMMON else keyword
        terms.append(term.replace(" ", _GAP))
    return f"(?i){_BEGIN}(?:{'|'.join(dict.fromkeys(terms))})"


GATE = gate()
