"""The texts that the licence scan looks for.

Each licence is a list of passages, as its text is laid out; a passage has the words of
the licence and the key phrases that every use of it must hold.  Phrases marked as base
are the base scan's.
"""

from __future__ import annotations

#: Phrase and label of the base scan.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed values: (label, passage, mandatory phrases).
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ["permission is hereby granted", "free of charge"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["substantial portions of the software"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license", "in compliance with the license"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["distributed on an as is basis", "language governing permissions"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["general public license", "free software foundation"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["general public license"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["in the hope that it will be useful", "gnu general public license"]),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ["received a copy of the gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("lgpl", "you should have received a copy of the gnu lesser general public license along with this library", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", ["gnu affero general public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc", "licensed under the creative commons attribution 4 0 international license", ["creative commons"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ["copyright holders and contributors as is"]),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["source code form", "mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ["the author disclaims all warranties"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["permission is granted to anyone", "redistribute it freely"]),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["must not be misrepresented"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("wtfpl", "do what the fuck you want to public license", ["you want to public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["anyone is free to copy modify publish use compile sell"]),
]
