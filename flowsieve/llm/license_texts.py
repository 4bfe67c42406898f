"""License templates: notice lines, standard file headers and whole texts of short licenses.

Fixed values, as the licenses' publishers state them; copyright lines and list marks are left out,
since they differ between copies.
"""
from __future__ import annotations

_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
          "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
          "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
          "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
          "DEALINGS IN THE SOFTWARE.")
_BSD_OPENING = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                "following conditions are met")
_BSD_CLAUSES = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of "
                "conditions and the following disclaimer in the documentation and/or other materials provided with the "
                "distribution.")
_BSD_THIRD = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission.")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
            "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
              "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
              "permit persons to whom the Software is furnished to do so")
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
            "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
            "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
            "PERFORMANCE OF THIS SOFTWARE.")


def _gnu_header(thing: str, name: str, version: str) -> str:
    return (f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as "
            f"published by the Free Software Foundation; either version {version} of the License, or (at your option) any "
            "later version")


#: Whole texts, without their copyright lines.
TEXTS = (
    ("0BSD", f"{_ISC_GRANT}. {_ISC_END}"),
    ("BSD-2-Clause", f"{_BSD_OPENING}: {_BSD_CLAUSES} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_OPENING}: {_BSD_CLAUSES} {_BSD_THIRD} {_BSD_END}"),
    ("ISC", f"{_ISC_GRANT}{_ISC_KEEP} {_ISC_END}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be "
            f"included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT-0", f"{_MIT_GRANT}. {_AS_IS}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
                  "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
                  "purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
             "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
             "following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
             "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
             "be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be "
             "misrepresented as being the original software. This notice may not be removed or altered from any source "
             "distribution."),
)
#: Standard file headers.
HEADERS = (
    ("AGPL-3.0", _gnu_header("program", "Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-1.0", _gnu_header("program", "General Public License", "1")),
    ("GPL-2.0", _gnu_header("program", "General Public License", "2")),
    ("GPL-3.0", _gnu_header("program", "General Public License", "3")),
    ("LGPL-2.0", _gnu_header("library", "Library General Public License", "2")),
    ("LGPL-2.1", _gnu_header("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _gnu_header("library", "Lesser General Public License", "3")),
    ("LGPL-3.0", _gnu_header("program", "Lesser General Public License", "3")),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
#: Notice lines. The opening of the BSD texts alone does not tell their clauses.
NOTICES = (
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD", _BSD_OPENING),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Licensed under CC0 1.0"),
    ("GFDL-1.3", "licensed under the GNU Free Documentation License, version 1.3"),
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "under the terms of the GNU General Public License, version 2"),
    ("GPL-3.0", "under the terms of the GNU General Public License, version 3"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
)
TEMPLATES = NOTICES + HEADERS + TEXTS
