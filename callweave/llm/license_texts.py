"""Wording of public licenses as templates: plain words, ``[optional|regions]`` and ``<n>`` replaceable words."""

from __future__ import annotations

# The wording of licenses, to its end; names of holders and lists' marks are replaceable.
_MIT_GRANT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
[(the "Software")], to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_DISCLAIMER = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <10> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """
THE SOFTWARE IS PROVIDED "AS IS" AND <6> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <6> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: <1> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<1> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """
<1> Neither the [name|names] of <12> nor the names of [its|their|the] contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY <10> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <10> BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_GNU_NOTICE = """
<8> is free software[:|;] you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software
Foundation[, either|;] [version <2> of the License[, or (at your option) any later version]]. [<8> is distributed in the hope that it will
be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
{name} for more details. [You should have received a copy of the GNU {name} along with <8>]]"""

TEXTS: tuple[tuple[str, str], ...] = (
    (
        "mit",
        f"""{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice [(including the next
paragraph)] shall be included in all copies or substantial portions of the Software. {_MIT_DISCLAIMER}""",
    ),
    ("mit-0", f"{_MIT_GRANT}. {_MIT_DISCLAIMER}"),
    (
        "x11",
        f"""{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software. {_MIT_DISCLAIMER} Except as contained in this notice, the [name|names] of <8> shall not be used in
advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from <8>""",
    ),
    (
        "isc",
        f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}",
    ),
    ("0bsd", f"{_ISC_GRANT}. {_ISC_DISCLAIMER}"),
    ("bsd-2-clause", f"{_BSD_TERMS} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the [author|authors] be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: <1> The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. <1> Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. <1> This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless
such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING
THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "postgresql",
        """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a
written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in
all copies. IN NO EVENT SHALL <10> BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST
PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF <10> HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. <10>
SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN "AS IS" BASIS, AND <10> HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES,
ENHANCEMENTS, OR MODIFICATIONS.""",
    ),
    (
        "wtfpl",
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as
long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION <1>
You just DO WHAT THE FUCK YOU WANT TO.""",
    ),
)

# The notices that licenses ask for, and how texts name a license.
NOTICES: tuple[tuple[str, str], ...] = (
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
may obtain a copy of the License at [http|https] www.apache.org/licenses/LICENSE-2.0 [html|txt] Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("apache-2.0", "apache [software] license [version|v] 2.0"),
    ("apache-2.0", "apache 2.0 license"),
    ("gpl", "this" + _GNU_NOTICE.format(name="General Public License")),
    ("lgpl", "this" + _GNU_NOTICE.format(name="Lesser General Public License")),
    ("agpl", "this" + _GNU_NOTICE.format(name="Affero General Public License")),
    ("gpl", "gnu general public license [[version|v] <2> [or [at your option any] later [version]]]"),
    ("lgpl", "gnu lesser general public license [[version|v] <2> [or [at your option any] later [version]]]"),
    ("lgpl", "gnu library general public license [[version|v] <2> [or [at your option any] later [version]]]"),
    ("agpl", "gnu affero general public license [[version|v] <2> [or [at your option any] later [version]]]"),
    ("gpl", "gplv2"),
    ("gpl", "gplv3"),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at [http|https] mozilla.org/MPL/2.0""",
    ),
    ("mpl-2.0", "mozilla public license [version|v] 2.0"),
    (
        "epl-2.0",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License [v] 2.0 which [is
available|accompanies] [at|this distribution]""",
    ),
    ("epl-2.0", "eclipse public license [version|v] 2.0"),
    ("mit", "mit license"),
    ("mit", "licensed under [the] mit"),
    ("isc", "isc license"),
    ("bsd-2-clause", "bsd 2 clause [license]"),
    ("bsd-2-clause", "2 clause bsd [license]"),
    ("bsd-3-clause", "bsd 3 clause [license]"),
    ("bsd-3-clause", "3 clause bsd [license]"),
    ("bsd", "[new|simplified|modified] bsd license"),
    ("zlib", "zlib license"),
    ("bsl-1.0", "distributed under the boost software license, version 1.0"),
    ("bsl-1.0", "boost software license [version|v] [1.0]"),
    ("unlicense", "released into the public domain under the unlicense"),
    ("artistic-2.0", "artistic license [version|v] 2.0"),
    ("cc0", "cc0 [1.0] [universal]"),
    ("cc0", "to the extent possible under law <12> waived all copyright and related or neighboring rights to <12>"),
    ("cc-by", "cc by 4.0"),
    ("cc-by", "cc by 3.0"),
    ("cc-by-sa", "cc by sa <2>"),
    ("cc-by-nd", "cc by nd <2>"),
    ("cc-by-nc", "cc by nc <2>"),
    ("cc-by-nc-sa", "cc by nc sa <2>"),
    ("cc-by-nc-nd", "cc by nc nd <2>"),
    ("cc-by", "creative commons attribution [<1> [0]] [international|generic|unported] license"),
    ("cc-by-sa", "creative commons attribution sharealike [<1> [0]] [international|generic|unported] license"),
    ("cc-by-nd", "creative commons attribution noderivatives [<1> [0]] [international|generic|unported] license"),
    ("cc-by-nc", "creative commons attribution noncommercial [<1> [0]] [international|generic|unported] license"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike [<1> [0]] [international|generic|unported] license"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives [<1> [0]] [international|generic|unported] license"),
    ("copyright", "copyright [c] <12> all rights reserved"),
)

# Identifiers that follow ``SPDX-License-Identifier:``.
IDENTIFIERS = (
    "0BSD",
    "AGPL-3.0",
    "Apache-2.0",
    "Artistic-2.0",
    "BSD-2-Clause",
    "BSD-3-Clause",
    "BSL-1.0",
    "CC0-1.0",
    "CC-BY-4.0",
    "CC-BY-SA-4.0",
    "EPL-2.0",
    "GPL-2.0",
    "GPL-3.0",
    "ISC",
    "LGPL-2.1",
    "LGPL-3.0",
    "MIT",
    "MIT-0",
    "MPL-2.0",
    "NCSA",
    "PostgreSQL",
    "Unlicense",
    "WTFPL",
    "X11",
    "Zlib",
)
