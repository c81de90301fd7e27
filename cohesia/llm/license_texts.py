"""Paragraphs of public licences, names by which texts call them, ways to state one, and text that only sounds like it."""

#: Paragraphs of the licences, by family; what differs in them is the wording of each licence itself.
PARAGRAPHS: dict[str, tuple[str, ...]] = {
    "agpl": (
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. \"Legal Entity\" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.",
        "If the Work includes a \"NOTICE\" text file as part of its distribution, then any Derivative Works that You distribute must include a readable copy of the attribution notices contained within such NOTICE file.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by": (
        "You are free to share, copy and redistribute the material in any medium or format, and to adapt, remix, transform, and build upon the material for any purpose, even commercially, as long as you give appropriate credit.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited.",
        "By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License.",
    ),
    "cc-by-nc": (
        "You may not use the material for commercial purposes. NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation.",
        "By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License.",
        "This is an open access article under a Creative Commons Attribution Non-Commercial license, which permits non-commercial use, distribution and reproduction in any medium.",
    ),
    "cc-by-sa": (
        "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
        "By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
    "gpl": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
        "You may convey a work based on the Program, or the modifications to produce it from the Program, in the form of source code, provided that you also license the entire work, as a whole, under this License to anyone who comes into possession of a copy.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
        "You may convey a Combined Work under terms of your choice that, taken together, effectively do not restrict modification of the portions of the Library contained in the Combined Work and reverse engineering for debugging such modifications.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ),
    "proprietary": (
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information and shall use it only in accordance with the license agreement.",
        "This material may not be published, broadcast, rewritten, or redistributed without permission.",
    ),
}

#: Names by which a text calls the licences of a family.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL", "AGPLv3", "AGPL-3.0 license", "GNU AGPL v3"),
    "apache": ("Apache License", "Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License", "Apache2 license"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause license", "BSD-3-Clause", "new BSD license", "simplified BSD license"),
    "cc-by": ("CC BY 4.0", "CC BY", "CC-BY-4.0", "Creative Commons Attribution License", "Creative Commons Attribution 4.0 International License", "CC BY 3.0 license"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial License", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0 license"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike License", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0 license"),
    "cc0": ("CC0 1.0", "CC0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero waiver", "Unlicense", "public domain dedication"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GPL", "GPLv3", "GPL-2.0-or-later", "GNU GPL v2"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL", "LGPLv3", "LGPL-2.1-or-later", "GNU LGPL v3"),
    "mit": ("MIT License", "MIT license", "MIT", "Expat license", "MIT/X11 license", "MIT open source license"),
    "mpl": ("Mozilla Public License", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0", "MPLv2 license", "Mozilla Public License v2"),
    "proprietary": ("proprietary license", "commercial license agreement", "proprietary license of the company", "confidential license agreement", "end user license agreement", "closed source license"),
}

#: Ways to state a licence, in three parts that share none: for training, for calibration and for measuring.
LEADS: dict[str, tuple[str, ...]] = {
    "train": ("Distributed under the {}", "Available under the {}.", "Published under the {}", "This program is covered by the {}.", "The code is made available under the terms of the {}", "You may use this file under the {}.", "Use of this library is governed by the {}.", "License: {}", "Dual licensed under the {} and another one", "SPDX-License-Identifier: {}", "Contributions are accepted under the {} only."),
    "calibrate": ("Shared under the {}", "The project uses the {}.", "See the file for the {}.", "Everything here falls under the {}"),
    "measure": ("Licensed under {}", "Released under the {}.", "This work is licensed under the {}.", "Provided to you under {}"),
}
RESERVED: dict[str, tuple[str, ...]] = {
    "train": ("Copyright {} Example Corporation, all rights reserved worldwide.", "{} The Authors. All rights are reserved by the publisher.", "(c) {} Example Ltd. All rights reserved."),
    "calibrate": ("Copyright (c) {} by the owner, all rights reserved", "All rights reserved by Example Inc, {}."),
    "measure": ("All rights reserved.", "Copyright {} Some Company. All rights reserved.", "(C) {}, all rights reserved"),
}

#: Text that is no licence, in the same three parts.
DECOYS: dict[str, tuple[str, ...]] = {
    "train": (
        "He lost his driving license after the accident last year.",
        "The city council will license more taxis and street vendors this summer.",
        "You need written permission from your parents to join the trip.",
        "The warranty on the washing machine covers parts for two years.",
        "A fishing license costs thirty dollars and is valid for one season.",
        "The court ruled that the copyright claim had expired decades ago.",
        "The gnu is a large antelope that lives in herds on the plains.",
        "The Apache people lived in the south west of the continent.",
        "Students at MIT built a robot that folds paper.",
        "The public domain contains many old novels and songs.",
        "The software update was released on Monday and fixes several problems.",
        "Human rights are reserved for nobody; they belong to all.",
        "The version of the story that he told was different from the general view.",
        "Her general practitioner lost the license to practise medicine.",
        "Public transport in the city is free for children under six.",
        "The terms of the agreement were published by the foundation.",
        "She was released under the condition that she would not leave the country.",
        "This work is the result of ten years of research in the field.",
        "The program is distributed to schools in the north of the country.",
        "A copy of the letter was found in the library; the source of it is not known.",
        "The use of the hall is permitted for members of the club only.",
        "The Berkeley campus has a library with a large collection of maps.",
        "Mozilla released a new version of its browser for the phone.",
        "The creative commons of the village is a place where all may build.",
        "Mit der Zeit kam der Regen.",
        "Komm mit uns nach Hause.",
        "Mit",
        "Mit freundlichen Grüßen",
        "Nicht mit mir",
        "Er kam mit dem Zug.",
        "Mit Sicherheit nicht.",
        "An Apache helicopter landed at the base.",
        "The Apache chief spoke to the army.",
        "Any person may visit the museum free of charge on Fridays.",
        "The software was sold to a person in Spain.",
        "They drew a map with the new software.",
        "A person who deals in furniture came to the house.",
        "La licencia de obras fue concedida por el ayuntamiento.",
        "Le permis de conduire est valable quinze ans.",
        "The bill was passed with the attribution of all costs to the state.",
        "Sales of commercial vehicles rose in the first half of the year.",
        "Version 2.0 of the report has a new section on water.",
        "The author grants an interview to the paper every spring.",
        "Without any doubt the software industry will change the city.",
        "In this section we describe the method and the conditions of the test.",
    ),
    "calibrate": (
        "She asked for permission to leave the meeting early.",
        "Copyright law is taught in the second year of the course.",
        "The house comes with a license to sell beer and wine.",
        "Mit uns zieht die neue Zeit.",
        "The distribution of rainfall in the region was uneven.",
        "Use the software to draw a map of the area.",
        "The company released its figures under pressure from the owners.",
        "The notice on the door was in two languages.",
    ),
    "measure": (
        "Poetic license allows a writer to bend the rules of grammar.",
        "The council will license three new taxis next spring.",
        "The general manager published the terms of the sale.",
        "Ein Brief kam mit der Post.",
        "The restaurant was granted permission to open on Sundays.",
        "A public library is open to any person free of charge.",
        "The conditions for a warranty claim are printed on the box.",
        "Apache helicopters flew over the town.",
    ),
}

#: Words that any text has. An n-gram of these alone is no feature.
COMMON_WORDS = frozenset(
    "a about after all also an and any are as at be because been before but by can could did do does each even for from had has have he her his how i if in into "
    "is it its may more most must my no nor not of on one only or other our out over same shall she should so some such than that the their them then there these "
    "they this those through to under until up upon was we were what when where which while who whom whose will with without would you your der die das und mit von "
    "zu im den ein eine la le les de des et un une en que el los las y con por para".replace(" mit", "").split()
)
