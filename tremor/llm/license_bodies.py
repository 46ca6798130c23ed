"""Licence templates: notices, headers, whole bodies (license_texts) and their paragraphs.

``LICENSES`` maps template keys to texts; what stands before ``#`` is the
licence.  Paragraphs of PARAGRAPH_WORDS or more let a part of a body be found;
one that several licences share is named after all of them.  ``REQUIRED``
gives the phrases that tell a licence from its relatives; a finding without
them is none.
"""

from __future__ import annotations

import re
from pathlib import Path

from tremor.llm.licenses import CONTAINMENT, TEMPLATES, words_of

PARAGRAPH_WORDS = 20
_FOLDER = Path(__file__).with_name("license_texts")

_OLD_HEADER = ("This {0} is free software; you can redistribute it and/or modify it under the terms of the {1} as published by the "
               "Free Software Foundation; either version {2} of the License, or (at your option) any later version")
_NEW_HEADER = _OLD_HEADER.replace(";", ":", 1).replace("Foundation;", "Foundation,")
_GPL, _LGPL, _AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

NOTICES = {
    **{k: v for k, v in TEMPLATES.items() if k not in ("mit", "apache-2.0", "gpl-3.0", "bsd-2-clause", "mpl-2.0")},
    "mit#opening": TEMPLATES["mit"],
    "apache-2.0#header": TEMPLATES["apache-2.0"],
    "bsd-2-clause|bsd-3-clause#opening": TEMPLATES["bsd-2-clause"],
    "mpl-2.0#header": TEMPLATES["mpl-2.0"],
    "gpl-2.0#header": _OLD_HEADER.format("program", _GPL, "2"),
    "gpl-3.0#header": TEMPLATES["gpl-3.0"],
    "lgpl-2.1#header": _OLD_HEADER.format("library", _LGPL, "2.1"),
    "lgpl-3.0#header": _NEW_HEADER.format("program", _LGPL, "3"),
    "agpl-3.0#header": _NEW_HEADER.format("program", _AGPL, "3"),
    "gpl-2.0-notice": "licensed under the GNU General Public License, version 2",
    "lgpl-2.1-notice": "licensed under the GNU Lesser General Public License, version 2.1",
    "lgpl-3.0-notice": "licensed under the GNU Lesser General Public License, version 3",
    "agpl-3.0-notice": "licensed under the GNU Affero General Public License, version 3",
    # the section that tells it from GPL 3; the rest of its body is found as that
    "agpl-3.0#network": "Notwithstanding any other provision of this License, if you modify the Program, your modified version must "
                        "prominently offer all users interacting with it remotely through a computer network (if your version "
                        "supports such interaction) an opportunity to receive the Corresponding Source of your version by providing "
                        "access to the Corresponding Source from a network server at no charge, through some standard or customary "
                        "means of facilitating copying of software",
}

REQUIRED = {f"{name}{form}": (family.lower(), f"version {version}")
            for form in ("-notice", "#header")
            for name, family, version in (("gpl-2.0", _GPL, "2"), ("gpl-3.0", _GPL, "3"), ("lgpl-2.1", _LGPL, "2.1"),
                                          ("lgpl-3.0", _LGPL, "3"), ("agpl-3.0", _AGPL, "3"))}
REQUIRED |= {"apache-2.0#header": ("version 2.0",), "mpl-2.0#header": ("v. 2.0",),
             "bsd-3-clause": ("endorse or promote products",)}


def _templates() -> dict[str, str]:
    bodies = {p.stem: p.read_text(encoding="utf-8") for p in sorted(_FOLDER.glob("*.txt"))}
    grams = {}
    for name, text in bodies.items():
        w = words_of(text)
        grams[name] = set(zip(w, w[1:]))
    headers = [set(zip(words_of(x), words_of(x)[1:])) for k, x in NOTICES.items() if k.endswith("#header")]
    found = {}
    for name, text in bodies.items():
        for paragraph in re.split(r"\n\s*\n", text):
            w = words_of(paragraph)
            own = set(zip(w, w[1:]))
            # headers that a body advises stand among the notices, with what tells them apart
            if len(w) < PARAGRAPH_WORDS or any(len(own & h) >= CONTAINMENT * len(h) for h in headers):
                continue
            who = "|".join(sorted(n for n, g in grams.items() if n == name or len(own & g) >= CONTAINMENT * len(own)))
            key = " ".join(w)
            found[key] = (who, paragraph)
    out = dict(NOTICES) | bodies
    for number, key in enumerate(sorted(found)):
        who, paragraph = found[key]
        out[f"{who}#{number}"] = paragraph
    return out


LICENSES = _templates()
