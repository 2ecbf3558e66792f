"""Sentences, notices and whole texts by which licences are given or told."""

_AS_IS = (
    'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, '
    "fitness for a particular purpose{0}. In no event shall the {1} be liable for any {2} or other liability, whether in {3}contract, tort or otherwise, "
    "arising from, out of or in connection with the software or the use or other dealings in the software."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in '
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
    "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT = f"{_MIT_GRANT}: {_MIT_NOTICE} " + _AS_IS.format(" and noninfringement", "authors or copyright holders", "claim, damages", "an action of ")
_X11 = (
    f"{_MIT_GRANT}: {_MIT_NOTICE} "
    + _AS_IS.format(" and noninfringement", "X Consortium", "claim, damages", "an action of ")
    + " Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings "
    "in this Software without prior written authorization from the X Consortium."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this "
    'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
    "permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
    "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
    "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
    "language processor. " + _AS_IS.format(", title and non-infringement", "copyright holders or anyone distributing the software", "damages", "")
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_THREE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission."
)
_BSD_TAIL = (
    'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied '
    "warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any "
    "direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of "
    "use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including "
    "negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
    "notice and this permission notice appear in all copies."
)
_ISC_TAIL = (
    'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and '
    "fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of "
    "use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of "
    "this software."
)
_HPND = (
    "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above "
    "copyright notice appear in all copies, and that both that copyright notice and this permission notice appear in supporting documentation, and that the name of "
    "the copyright holder not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission."
)
_POSTGRESQL = (
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby "
    "granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."
)
_ZLIB = (
    'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of '
    "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any "
    "source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)

#: (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", _MIT_GRANT),
    ("mit", _MIT_NOTICE),
    ("mit", _MIT),
    ("x11", _X11),
    ("boost", _BOOST),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", _BSD_HEAD),
    ("bsd", "Released under the BSD License."),
    ("bsd", f"{_BSD_HEAD}: {_BSD_TWO} {_BSD_TAIL}"),
    ("bsd", f"{_BSD_HEAD}: {_BSD_TWO} {_BSD_THREE} {_BSD_TAIL}"),
    ("isc", _ISC_GRANT),
    ("isc", f"{_ISC_GRANT} {_ISC_TAIL}"),
    ("hpnd", _HPND),
    ("postgresql", _POSTGRESQL),
    ("zlib", _ZLIB),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", _UNLICENSE),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc0", "Released under CC0 1.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
