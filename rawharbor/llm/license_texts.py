"""Statements, headers and passages by which files name their licence (fixed values).

Each licence has several forms: what people write in a line, the header that the licence
asks for, and the passage of its text that tells it from the others. An SPDX tag is one more
form, made from the licence's identifier.
"""

from __future__ import annotations

_GNU_REST = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
    " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
    " disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission."
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published"
        f" by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


def _gnu_head(name: str, version: str) -> str:
    return f"GNU {name.upper()} Version {version} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _creative(name: str, short: str) -> tuple[str, ...]:
    return (
        f"Licensed under {short}.",
        f"This work is licensed under a Creative Commons {name} 4.0 International License.",
        f"This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit"
        f" creativecommons.org or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    )


TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        " \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific"
        " language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions:",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "bsd-2-clause": ("Released under the BSD 2-Clause License.", _BSD_HEAD + _BSD_TWO),
    "bsd-3-clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use are permitted under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _BSD_HEAD + _BSD_TWO + _BSD_THIRD,
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        _gnu("General Public License", "2"),
        _gnu_head("General Public License", "2, June 1991"),
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        _gnu("General Public License", "3"),
        _gnu("General Public License", "3") + " " + _GNU_REST + " See the GNU General Public License for more details.",
        _gnu_head("General Public License", "3, 29 June 2007"),
    ),
    "lgpl-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        _gnu("Lesser General Public License", "2.1").replace("program", "library"),
        _gnu_head("Lesser General Public License", "2.1, February 1999"),
    ),
    "lgpl-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        _gnu("Lesser General Public License", "3"),
        _gnu_head("Lesser General Public License", "3, 29 June 2007"),
    ),
    "agpl-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        _gnu("Affero General Public License", "3"),
        _gnu_head("Affero General Public License", "3, 19 November 2007"),
    ),
    "mpl-2.0": (
        "This file is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "cc-by-4.0": _creative("Attribution", "CC BY 4.0"),
    "cc-by-sa-4.0": _creative("Attribution-ShareAlike", "CC BY-SA 4.0"),
    "cc-by-nc-4.0": _creative("Attribution-NonCommercial", "CC BY-NC 4.0"),
    "cc0-1.0": (
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under"
        " the Creative Commons CC0 1.0 Universal public domain dedication.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a"
        " compiled binary, for any purpose, commercial or non-commercial, and by any means. It is released into the public domain.",
    ),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
