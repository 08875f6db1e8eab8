"""Known licence texts and one-line notices, by name.

Long texts lie in ``known_texts`` as they are published; short ones and the wordings
of notices stand here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

_FILES = Path(__file__).parent / "known_texts"


class Register(dict):
    """The main text of each name; :meth:`items` gives all its texts, so a name can come
    several times there."""

    def __init__(self, main: dict[str, str]):
        super().__init__(main)
        self.others: list[tuple[str, str]] = []

    def add(self, name: str, *texts: str) -> None:
        for t in texts:
            if self.setdefault(name, t) != t:
                self.others.append((name, t))

    def items(self) -> Iterator[tuple[str, str]]:
        yield from super().items()
        yield from self.others


_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

_ISC_TERMS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)

LICENSES = Register({
    "MIT": (
        "MIT License\n\nCopyright (c) <year> <holders>\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.\n\n" + _NO_WARRANTY
    ),
    "ISC": (
        "ISC License\n\nCopyright (c) <year> <holder>\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TERMS
    ),
    "0BSD": (
        "BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
        "\n\n" + _ISC_TERMS
    ),
    "WTFPL": (
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar\n\n"
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is "
        "allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR "
        "COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."
    ),
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "notice:CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:MIT": "Released under the MIT License.",
    "notice:MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "notice:all-rights-reserved": "All rights reserved.",
    "notice:public-domain": "This work is in the public domain.",
})

_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n\n{0}Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n\n{1}Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.\n\n"
)
_NO_ENDORSEMENT = (
    "{2}Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.\n\n"
)
_BSD_TERMS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT {owner} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
    "a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
    "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all "
    "present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
    "For more information, please refer to <{}>"
)


def _add_texts() -> None:
    for name, titles in (("MIT", ("", "The MIT License\n\n", "The MIT License (MIT)\n\n")), ("ISC", ("", "The ISC License\n\n")), ("0BSD", ("",))):
        body = LICENSES[name].split("\n\n", 1)[1]
        LICENSES.add(name, *(t + body for t in titles))
    marks = (("1. ", "2. ", "3. "), ("* ", "* ", "* "))
    for n, kinds in ((2, ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License')), (3, ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'))):
        for title in (*kinds, f"The {kinds[0]}", ""):
            for m in marks:
                for owner in ("HOLDER", "HOLDERS", "OWNER"):
                    for holder in ("the copyright holder", "the copyright holders", "the author") if n == 3 else ("",):
                        text = _CLAUSES + (_NO_ENDORSEMENT if n == 3 else "") + _BSD_TERMS
                        LICENSES.add(f"BSD-{n}-Clause", f"{title}\n\nCopyright (c) <year> <holder>\n\n" + text.format(*m, owner=owner, holder=holder))
    for url in ("https://unlicense.org",):
        LICENSES.add("Unlicense", _UNLICENSE.format(url))
    for f in sorted(_FILES.glob("*.txt")):
        name = {"Artistic": "Artistic-1.0"}.get(f.stem, re.sub(r"GPL-(\d)$", r"GPL-\1.0", f.stem))
        text = f.read_text(encoding="utf-8")
        LICENSES.add(name, text)
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:  # the appendix on how to apply it is often left out, and so is the mark of the end
            LICENSES.add(name, terms + end, terms)


_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
#: Names as notices spell them.
_FAMILIES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License", "Apache Software License 2.0"),
    "MIT": ("MIT License", "MIT", "MIT/X11 License", "Expat License"),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD 2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD 3-Clause"),
    "BSD": ("BSD License", "BSD"),
    "MPL-1.1": ("Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "EPL 2.0"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL", "WTFPL License"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal", "CC0 1.0 License"),
    "GPL": ("GNU General Public License", "GNU GPL", "GPL"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "LGPL"),
    "AGPL": ("GNU Affero General Public License", "GNU AGPL", "AGPL"),
    **{
        f"{short}-{v}": tuple(
            form.format(n=n, v=x)
            for n in (f"GNU {full}", full, f"GNU {short}", short)
            for x in dict.fromkeys((v, v.removesuffix(".0")))
            for form in ("{n}, version {v}", "{n} v{v}", "{n} {v}", "{n}v{v}", "{n} version {v} or later", "{n} v{v} or later", "{n} v{v} only", "{n} {v} License")
        )
        for short, full, versions in (
            ("GPL", "General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.0", "2.1", "3.0")),
            ("AGPL", "Affero General Public License", ("3.0",)), ("GFDL", "Free Documentation License", ("1.2", "1.3")),
        )
        for v in versions
    },
    **{
        f"CC-{short}-{v}": tuple(
            f"{n}{tail}"
            for n in (f"CC {short} {v}", f"Creative Commons {full} {v}", f"Creative Commons {short} {v}", f"Creative Commons {full} {v} {'International' if v == '4.0' else 'Unported'}")
            for tail in ("", " License")
        )
        for short, full in _CC.items() for v in ("2.0", "2.5", "3.0", "4.0")
    },
    **{f"CC-{short}": (f"CC {short}", f"CC {short} License", f"Creative Commons {full}", f"Creative Commons {full} License") for short, full in _CC.items()},
}
_SUBJECTS = ("", "This work is ", "This project is ", "This software is ")
_VERBS = ("Licensed under", "Released under", "Distributed under", "Available under")


def _add_notices() -> None:
    seen = set()
    for name, spellings in _FAMILIES.items():
        lines = []
        for x in spellings:
            articles = (" ", " a ") if name.startswith("CC") else (" the ", " ")
            lines += [f"{s}{v}{a}{x}." for s in _SUBJECTS for v in _VERBS for a in articles]
            lines += [f"License: {x}"]
        ends = ("", "-only", "-or-later") if "GPL" in name or "GFDL" in name else ("",)
        for line in [*lines, *(f"SPDX-License-Identifier: {name}{e}" for e in ends)]:
            plain = re.sub(r"[^a-z0-9]+", " ", line.lower()).replace(" v2", " version 2").replace(" v3", " version 3").strip()
            if plain not in seen:
                seen.add(plain)
                LICENSES.add(f"notice:{name}", line)
    LICENSES.add("notice:all-rights-reserved", "All rights are reserved.", "All rights reserved.")
    LICENSES.add("notice:public-domain", "This is in the public domain.", "Public domain.", "Released into the public domain.", "This work is released into the public domain.")


_add_texts()
_add_notices()
