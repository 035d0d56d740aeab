"""Public licence notices by family, each as one paragraph.

Titles, one-line statements, standard file headers and opening paragraphs of the
licence texts, as they stand in public source trees.
"""

NOTICES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is licensed under the AGPL version 3 or later.",
        "GNU Affero General Public License v3.0",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "This project is released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the "
        "NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF "
        "licenses this file to you under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution License (CC BY).",
        "SPDX-License-Identifier: CC-BY-4.0",
        "https://creativecommons.org/licenses/by/4.0/",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "https://creativecommons.org/licenses/by-nc/4.0/",
        "Available for non-commercial use under the Creative Commons Attribution-NonCommercial license (CC BY-NC).",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "https://creativecommons.org/licenses/by-sa/4.0/",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
        "Licensed under the GNU GPL v3.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Released under the GPL version 2.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "Distributed under the LGPL license, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write "
        "to the Free Software Foundation.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "The MIT License (MIT)",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "SPDX-License-Identifier: MIT",
        "This project is MIT licensed, see the LICENSE file for details.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "Licensed under the Mozilla Public License 2.0 (MPL 2.0).",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
        "work.",
        "The author hereby places this work in the public domain.",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "Copyright (c) 2020 Example Corporation. All Rights Reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without "
        "the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
