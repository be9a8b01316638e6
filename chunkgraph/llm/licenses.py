"""License templates by SPDX name: short licenses whole, the standard notices of long ones, and
one-line notices. Versions that differ by a word are templates of their own. Long texts can be
given to the operator as further templates.
"""

from __future__ import annotations

# License texts and notices.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so")
_MIT_NOTICE = (", subject to the following conditions: The above copyright notice and this permission notice shall be "
               "included in all copies or substantial portions of the Software.")
_MIT_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE.")
_ISC_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
              "hereby granted")
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
             "that the following conditions are met: ")
_BSD_SOURCE = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
               "the following disclaimer.")
_BSD_BINARY = (" 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
               "and the following disclaimer in the documentation and/or other materials provided with the "
               "distribution.")
_BSD_ADVERT = (" 3. All advertising materials mentioning features or use of this software must display the following "
               "acknowledgement: This product includes software developed by the organization.")
_BSD_NAMES = (" {n}. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
              "or promote products derived from this software without specific prior written permission.")
_BSD_WARRANTY = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY "
    "OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_2 = _BSD_HEAD + _BSD_SOURCE + _BSD_BINARY
_BSD_3 = _BSD_2 + _BSD_NAMES.format(n=3)
_BSD_4 = _BSD_2 + _BSD_ADVERT + _BSD_NAMES.format(n=4)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
    "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
    "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
    "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
    "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
    "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
    "distribution.")
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
    "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.")
_UNLICENSE_REST = (
    " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
    "copyright interest in the software to the public domain. We make this dedication for the benefit of the public at "
    "large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law.")
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
    "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
    "to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software "
    "and this entire statement, including the above license grant, this restriction and the following disclaimer, must "
    "be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless "
    "such copies or derivative works are solely in the form of machine-executable object code generated by a source "
    "language processor.")
_APACHE_11 = (
    _BSD_2 + " 3. The end-user documentation included with the redistribution, if any, must include the following "
    "acknowledgment: \"This product includes software developed by the Apache Software Foundation "
    "(http://www.apache.org/).\" Alternately, this acknowledgment may appear in the software itself, if and wherever "
    "such third-party acknowledgments normally appear. 4. The names \"Apache\" and \"Apache Software Foundation\" must "
    "not be used to endorse or promote products derived from this software without prior written permission. For "
    "written permission, please contact apache@apache.org. 5. Products derived from this software may not be called "
    "\"Apache\", nor may \"Apache\" appear in their name, without prior written permission of the Apache Software "
    "Foundation.")
_APACHE_2 = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_2_REST = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
    "the specific language governing permissions and limitations under the License.")
_GNU_WARRANTY = (
    " This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more "
    "details.")
_GFDL = (
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation "
    "License, Version {v}{later}; with no Invariant Sections, {covers}. A copy of the license is included in the section "
    "entitled \"GNU Free Documentation License\".")
_MPL_11 = (
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use "
    "this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/")
_MPL_2 = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.")
_EPL = ("This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "v{v} which accompanies this distribution, and is available at {at}")
_CC0 = (
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
    "work.")
_WTFPL = (
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You "
    "just DO WHAT THE FUCK YOU WANT TO.")

_TEXTS = (
    ("MIT", _MIT_GRANT + _MIT_NOTICE),
    ("MIT", _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT-0", _MIT_GRANT + "." + _MIT_WARRANTY),
    ("ISC", _ISC_GRANT + _ISC_NOTICE),
    ("ISC", _ISC_GRANT + _ISC_NOTICE + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + "." + _ISC_WARRANTY),
    *((name, text + more) for name, text in (
        ("BSD-1-Clause", _BSD_HEAD + _BSD_SOURCE), ("BSD-2-Clause", _BSD_2), ("BSD-3-Clause", _BSD_3),
        ("BSD-4-Clause", _BSD_4)) for more in ("", _BSD_WARRANTY)),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + _UNLICENSE_REST),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or "
                "copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Apache-1.1", _APACHE_11),
    ("Apache-1.1", _APACHE_11 + _BSD_WARRANTY),
    ("Apache-2.0", _APACHE_2),
    ("Apache-2.0", _APACHE_2 + _APACHE_2_REST),
    ("MPL-1.1", _MPL_11),
    ("MPL-2.0", _MPL_2),
    ("EPL-1.0", _EPL.format(v="1.0", at="http://www.eclipse.org/legal/epl-v10.html")),
    ("EPL-2.0", _EPL.format(v="2.0", at="https://www.eclipse.org/legal/epl-2.0/")),
    ("CC0-1.0", _CC0),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving "
                "all of his or her rights to the work worldwide under copyright law, including all related and "
                "neighboring rights, to the extent allowed by law."),
    ("WTFPL", _WTFPL),
)

#: One-line notices of a license by its usual names.
_NAMES = (
    ("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("Apache-2.0", "Apache License, Version 2.0"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"), ("EPL-2.0", "Eclipse Public License, Version 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"), ("Unlicense", "Unlicense"),
    *((f"{short}-{version}-only", f"GNU {kind}General Public License, version {version.removesuffix('.0')}")
      for short, kind, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser ", ("2.1", "3.0")),
                                    ("AGPL", "Affero ", ("3.0",))) for version in versions))
_LINES = ("Licensed under the {}", "Released under the {}", "This work is licensed under the {}",
          "This project is licensed under the terms of the {}")


def _gnu() -> list[tuple[str, str]]:
    """Notices of the GNU licenses: one version only, or that one and later ones."""
    out = []
    for short, kind, versions, works in (
            ("GPL", "", ("1", "2", "3"), ("program", "file")),
            ("LGPL", "Library ", ("2",), ("library",)), ("LGPL", "Lesser ", ("2.1", "3"), ("library", "program")),
            ("AGPL", "Affero ", ("3",), ("program",))):
        for version in versions:
            full = version if "." in version else version + ".0"
            for work in works:
                head = (f"This {work} is free software; you can redistribute it and/or modify it under the terms of the "
                        f"GNU {kind}General Public License as published by the Free Software Foundation; ")
                tail = _GNU_WARRANTY.format(work=work, kind=kind)
                later = head + f"either version {version} of the License, or (at your option) any later version."
                only = head + f"version {version} of the License only."
                plain = head + f"version {version} of the License."
                out += [(f"{short}-{full}-{end}", text + more) for end, text in (
                    ("or-later", later), ("only", only), ("only", plain)) for more in ("", tail)]
    return out


def _creative_commons() -> list[tuple[str, str]]:
    kinds = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
             ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
             ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    ports = (("4.0", "International"), ("3.0", "Unported"), ("3.0", "International"), ("2.5", "Generic"), ("2.0", "Generic"))
    return [(f"CC-{short}-{v}", f"This work is licensed under a Creative Commons {name} {v} {port} License")
            for short, name in kinds for v, port in ports] + [
            (f"CC-{short}-4.0", f"Licensed under CC {short} 4.0") for short, _ in kinds]


TEMPLATES: tuple[tuple[str, str], ...] = (
    *_TEXTS, *_gnu(), *_creative_commons(),
    *((name, line.format(usual)) for name, usual in _NAMES for line in _LINES),
    *((f"GFDL-{v}-{end}", _GFDL.format(v=v, later=later, covers=covers))
      for v, covers in (("1.1", "with no Front-Cover Texts, and with no Back-Cover Texts"),
                        ("1.2", "no Front-Cover Texts, and no Back-Cover Texts"),
                        ("1.3", "no Front-Cover Texts, and no Back-Cover Texts"))
      for end, later in (("or-later", " or any later version published by the Free Software Foundation"), ("only", ""))),
    ("LicenseRef-AllRightsReserved", "All rights reserved"),
)
