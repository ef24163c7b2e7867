"""Wordings of licenses: complete texts, the notices that stand in files, and one-line statements.

Names are an SPDX identifier and the form. Long texts lie in ``license_texts``; they are
read on the driver only.
"""

from __future__ import annotations

import functools
from pathlib import Path

# --- Fixed values: license texts and notices as their authors publish them ---

_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
    "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)

_TEXTS = {
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause text": _BSD_GRANT + _BSD_DISCLAIMER,
    "BSD-3-Clause text": _BSD_GRANT + _BSD_ENDORSEMENT + _BSD_DISCLAIMER,
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        + _ISC_DISCLAIMER
    ),
    "0BSD text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted. " + _ISC_DISCLAIMER
    ),
    "Zlib text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE. For more information, please refer to https://unlicense.org"
    ),
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "CC0-1.0 notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work. This work is published under the CC0 1.0 Universal Public Domain Dedication."
    ),
}

_GNU_NOTICE = (
    "This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as "
    "published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any "
    "later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more "
    "details. You should have received a copy of the GNU {name} along with this {work}."
)
_GNU = {
    "GPL-2.0": ("program", "General Public License", "2"),
    "GPL-3.0": ("program", "General Public License", "3"),
    "LGPL-2.1": ("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": ("library", "Lesser General Public License", "3"),
    "AGPL-3.0": ("program", "Affero General Public License", "3"),
}

# How each license is named in a sentence.
_SPOKEN = {
    "Apache-2.0": ("the Apache License, Version 2.0",),
    "MIT": ("the MIT License",),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License"),
    "ISC": ("the ISC License",),
    "Zlib": ("the zlib License",),
    "Unlicense": ("the Unlicense",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0",),
    "GPL-2.0": ("the GNU General Public License, version 2",),
    "GPL-3.0": ("the GNU General Public License, version 3",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": (
        "CC BY-NC-SA 4.0",
        "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    ),
}
_PHRASES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.")

# Section 13 of the AGPL, where it differs from the GPL besides its name.
_AGPL_NETWORK = (
    "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of "
    "this License, if you modify the Program, your modified version must prominently offer all users interacting with "
    "it remotely through a computer network (if your version supports such interaction) an opportunity to receive the "
    "Corresponding Source of your version by providing access to the Corresponding Source from a network server at no "
    "charge, through some standard or customary means of facilitating copying of software. This Corresponding Source "
    "shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that "
    "is incorporated pursuant to the following paragraph. "
)

# --- End of fixed values ---


def _agpl(gpl: str) -> str:
    """The AGPL's text, from that of the GPL: other name, and its section on networks."""
    head, rest = gpl.split("  13. Use with the GNU Affero General Public License.")
    named = [
        part.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace(
            "GNU General Public", "GNU Affero General Public"
        )
        for part in (head, rest.replace("GNU Affero General", "GNU General", 1))
    ]
    return named[0] + _AGPL_NETWORK + named[1]


@functools.cache
def templates() -> dict[str, str]:
    """All wordings by name; the name's first word is the license."""
    found = dict(_TEXTS)
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        found[f"{path.stem} text"] = path.read_text("utf-8")
    found["AGPL-3.0 text"] = _agpl(found["GPL-3.0 text"])
    for license_, (work, name, version) in _GNU.items():
        old = version.startswith("2")
        found[f"{license_} notice"] = _GNU_NOTICE.format(
            work=work, name=name, version=version, mark=";" if old else ":", comma=";" if old else ","
        )
    for license_, spoken in _SPOKEN.items():
        lines = [phrase.format(name) for name in spoken for phrase in _PHRASES]
        found.update({f"{license_} line {i}": line for i, line in enumerate(lines, 1)})
    return found
