"""Hand-written signatures of license texts, notices and references: (label, keyword, pattern).

A pattern is over a text's words: lower case, one space between words, a space before the first one. The keyword (or one of several, with | between them) is held by every match.
Fixed values: the sentences are those of the licenses themselves.
"""

#: Sentences that stand in one license's text alone, or name it beyond doubt.
TEXTS = (
    ("mit", "permission is hereby granted", " permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "without restriction", " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "substantial portions", " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission is hereby granted", " permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit-modern-variant", "without limitation", " to deal in the software without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit-feh", "documentation and acknowledgement", " acknowledgment shall be given in the documentation and acknowledgement"),
    ("x11", "x consortium", " except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("x11", "advertising or otherwise", " shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("xfree86-1.1", "xfree86", " this product includes software developed by the xfree86 project"),
    ("isc", "purpose with or without fee", " permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "purpose with or without fee", " permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", "purpose and without fee", " permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("bsd", "source and binary forms", " redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause-views", "official policies", " the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies"),
    ("bsd-2-clause-patent", "patent license", " subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive no charge royalty free irrevocable except for failure to satisfy the conditions of this license patent license"),
    ("bsd-3-clause", "endorse or promote", " neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse or promote", " the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse or promote", " the names of the contributors may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", "patent rights", " no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-no-nuclear", "nuclear facility", " this software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("bsd-4-clause", "advertising materials", " all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-4-clause", "california berkeley", " this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-protection", "bsd protection", " bsd protection license"),
    ("apache-1.1", "apache software foundation", " this product includes software developed by the apache software foundation"),
    ("apache-1", "apache group", " this product includes software developed by the apache group for use in the apache http server project"),
    ("apache-1.1", "apache software foundation", " the names apache and apache software foundation must not be used to endorse or promote products"),
    ("apache-2", "apache license", " licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache org licenses", " (?:www )?apache org licenses license 2 0"),
    ("apache-2", "derivative works", " you must give any other recipients of the work or derivative works a copy of this license"),
    ("apache-2", "patent license", " each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license"),
    ("apache-2", "compliance with the license", " you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "limitations under the license", " see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-1", "general public license", " gnu general public license version 1 february 1989"),
    ("gpl-2", "general public license", " gnu general public license version 2 june 1991"),
    ("gpl-3", "general public license", " gnu general public license version 3 29 june 2007"),
    ("lgpl-2", "general public license", " gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "general public license", " gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "general public license", " gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "general public license", " gnu affero general public license version 3 19 november 2007"),
    ("agpl-1", "affero", " affero general public license version 1 march 2002"),
    ("gpl", "general public license", " you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2", "general public license", " under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "general public license", " under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "general public license", " under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3", "general public license", " under the terms of the gnu general public license version 3 as published by the free software foundation"),
    ("lgpl", "general public license", " you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "general public license", " you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl-2", "general public license", " under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-2.1", "general public license", " under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "general public license", " under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl", "affero general public license", " you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3", "affero general public license", " under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "with it remotely", " your modified version must prominently offer all users interacting with it remotely through a computer network|(?: all)? users who interact with it remotely through a computer network"),
    ("gpl", "general public license", " you should have received a copy of the gnu general public license along with this (?:program|library|software|file)"),
    ("lgpl", "general public license", " you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library|software)"),
    ("agpl", "general public license", " you should have received a copy of the gnu affero general public license along with this (?:program|software)"),
    ("gpl", "merchantability", " this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", "merchantability", " this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public license"),
    ("gpl", "copyleft", " the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", "verbatim copies", " everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "licenses for most software", " the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "to propagate a work|covered work", " to propagate a work means to do anything with it that without permission would make you directly or secondarily liable|(?: a)? covered work means either the unmodified program or a work based on the program"),
    ("gpl-exception-classpath", "special exception", " as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-exception-gcc", "runtime library exception", " gcc runtime library exception"),
    ("gpl-exception-bison", "special exception", " as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-exception-font", "special exception", " as a special exception if you create a document which uses this font and embed this font"),
    ("gpl-exception-autoconf", "special exception", " as a special exception the free software foundation gives unlimited permission to copy distribute and modify the configure scripts"),
    ("gfdl", "free documentation license", " permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant sections", " with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1.1", "mozilla public license", " the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla public license", " the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl-2.0", "mozilla public license", " this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla org mpl", " (?:www )?mozilla org mpl 2 0"),
    ("mpl-2.0", "incompatible with secondary licenses", " this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("npl-1.1", "netscape public license", " the contents of this file are subject to the netscape public license version 1 1"),
    ("npl-1.0", "netscape public license", " the contents of this file are subject to the netscape public license version 1 0"),
    ("epl-1.0", "eclipse public license", " this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", "eclipse public license", " this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-1.0", "eclipse org legal", " (?:www )?eclipse org legal epl v10"),
    ("epl-2.0", "eclipse org legal", " (?:www )?eclipse org legal epl 2 0"),
    ("edl-1.0", "eclipse distribution license", " eclipse distribution license(?: v)?(?: 1 0)?"),
    ("cpl-1.0", "common public license", " common public license(?: version| v)? 1 0"),
    ("ipl-1.0", "ibm public license", " ibm public license(?: version)?(?: 1 0)?"),
    ("cddl-1.0", "common development and distribution license", " the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", "opensolaris", " you can obtain a copy of the license at usr src opensolaris license"),
    ("eupl-1.1", "eupl version 1 1|european union public licence", " licensed under the eupl version 1 1 or|(?: the)? european union public licence v 1 1"),
    ("eupl-1.2", "european union public licence", " european union public licence v(?:ersion)? 1 2"),
    ("unlicense", "unencumbered software", " this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", " (?:please refer to )?(?:https? )?unlicense org"),
    ("unlicense", "anyone is free to copy", " anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "waived all copyright", " (?:has )?waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "creativecommons org publicdomain zero", " creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", "cc0 1 0 universal", " cc0 1 0 universal"),
    ("public-domain", "publicdomain mark", " creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons org licenses by ", " creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org licenses by sa", " creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons org licenses by nd", " creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons org licenses by nc", " creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", " creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", " creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by", "creative commons attribution", " creative commons attribution [1-4] [05] (?:international|generic|unported)"),
    ("cc-by-sa", "creative commons attribution share", " creative commons attribution share ?alike [1-4] [05] (?:international|generic|unported)"),
    ("cc-by-nd", "creative commons attribution no", " creative commons attribution no ?derivatives [1-4] [05] (?:international|generic|unported)"),
    ("cc-by-nc", "creative commons attribution non", " creative commons attribution non ?commercial [1-4] [05] (?:international|generic|unported)"),
    ("cc-by-nc-sa", "creative commons attribution non", " creative commons attribution non ?commercial share ?alike [1-4] [05] (?:international|generic|unported)"),
    ("cc-by-nc-nd", "creative commons attribution non", " creative commons attribution non ?commercial no ?derivatives [1-4] [05] (?:international|generic|unported)"),
    ("cc-sampling-plus", "creativecommons org licenses sampling", " creativecommons org licenses sampling 1 0"),
    ("wtfpl", "what the fuck you want to", " you just do what the fuck you want to"),
    ("wtfpl", "what the fuck you want to", " do what the fuck you want to public license"),
    ("beerware", "beer in return", " you can buy me a beer in return"),
    ("beerware", "beer ware license|beerware license", " the beer ?ware license"),
    ("zlib", "altered source versions", " altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin of this software", " the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "express or implied warranty", " this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-acknowledgement", "acknowledgment", " if you use this software in a product an acknowledgment see the following in the product documentation is required"),
    ("libpng", "png reference library", " the png reference library is supplied as is"),
    ("libtiff", "sam leffler", " the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("ijg", "independent jpeg group", " this software is based in part on the work of the independent jpeg group"),
    ("bzip2", "bzip2", " julian seward(?: [^ ]+){0,6} bzip2|(?: the)? bzip2 license"),
    ("bsl-1.0", "boost software license", " boost software license version 1 0 august 17th 2003"),
    ("bsl-1.0", "boost org license", " (?:www )?boost org license 1 0(?: txt)?"),
    ("bsl-1.0", "boost software license", " distributed under the boost software license version 1 0"),
    ("busl-1.1", "business source license", " business source license 1 1"),
    ("busl-1.1", "change license", " change date(?: [^ ]+){1,8} change license"),
    ("sspl-1.0", "server side public license", " server side public license version 1 october 16 2018"),
    ("elastic-2.0", "elastic license", " elastic license 2 0"),
    ("commons-clause", "commons clause", " commons clause license condition v1 0"),
    ("commons-clause", "right to sell", " the license does not grant to you the right to sell the software"),
    ("prosperity-3.0", "prosperity public license", " prosperity public license(?: 3 0 0)?"),
    ("polyform-noncommercial", "polyform noncommercial", " polyform noncommercial license 1 0 0"),
    ("polyform-small-business", "polyform small business", " polyform small business license 1 0 0"),
    ("polyform-strict", "polyform strict", " polyform strict license 1 0 0"),
    ("parity-7.0", "parity public license", " parity public license(?: 7 0 0)?"),
    ("blue-oak-1.0", "blue oak model license", " blue oak model license(?: version 1 0 0)?"),
    ("json", "good not evil", " the software shall be used for good not evil"),
    ("artistic-2.0", "artistic license", " everyone is permitted to copy and distribute verbatim copies of this license document(?: [^ ]+){0,12} artistic license"),
    ("artistic", "same terms as perl", " (?:you can redistribute it and or modify it )?under the same terms as perl(?: itself)?"),
    ("psf-2.0", "python software foundation license", " python software foundation license(?: version 2)?"),
    ("psf-2.0", "psf", " psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("python-2.0", "cnri", " cnri open source license agreement|(?: the)? cnri license agreement"),
    ("python-2.0", "beopen", " beopen python open source license agreement"),
    ("php-3.01", "php license", " this source file is subject to version 3 01 of the php license"),
    ("php-3.0", "php license", " this source file is subject to version 3 0 of the php license"),
    ("zend-2.0", "zend", " this source file is subject to version 2 0 of the zend (?:engine )?license"),
    ("ruby", "ruby", " (?:you can redistribute it and or modify it )?under the same terms as ruby"),
    ("openssl", "openssl", " this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", " this product includes cryptographic software written by eric young"),
    ("sleepycat", "sleepycat", " (?:the )?sleepycat license"),
    ("sleepycat", "accompanying software", " redistributions in any form must be accompanied by information on how to obtain complete source code for the db software and any accompanying software"),
    ("postgresql", "postgresql", " portions copyright c [^ ]+(?: [^ ]+){0,3} postgresql global development group|(?: the)? postgresql licen[cs]e"),
    ("postgresql", "university of california", " in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ncsa", "university of illinois", " university of illinois ncsa open source license"),
    ("ncsa", "university of illinois", " neither the names of(?: [^ ]+){1,6} university of illinois nor the names of its contributors"),
    ("ofl-1.1", "open font license", " this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", "font software", " the font software may be sold as part of a larger software package but no copy of one or more of the original or modified versions of the font software may be sold by itself"),
    ("ofl-1.1", "reserved font name", " with reserved font name"),
    ("odbl-1.0", "open database license", " is made available under the open database license"),
    ("odbl-1.0", "opendatacommons org licenses odbl", " opendatacommons org licenses odbl"),
    ("odc-by-1.0", "opendatacommons org licenses by", " opendatacommons org licenses by"),
    ("pddl-1.0", "opendatacommons org licenses pddl", " opendatacommons org licenses pddl"),
    ("cdla-permissive-2.0", "community data license agreement", " community data license agreement permissive(?: version)? 2 0"),
    ("cdla-permissive-1.0", "community data license agreement", " community data license agreement permissive(?: version)? 1 0"),
    ("cdla-sharing-1.0", "community data license agreement", " community data license agreement sharing(?: version)? 1 0"),
    ("ogl-uk-3.0", "open government licence", " open government licence(?: v| version)? ?3(?: 0)?"),
    ("ogl-uk-2.0", "open government licence", " open government licence(?: v| version)? ?2(?: 0)?"),
    ("etalab-2.0", "etalab", " (?:licence ouverte|open licence)(?: open licence)? (?:version 2 0 )?etalab|(?: la)? licence etalab"),
    ("afl-3.0", "academic free license", " licensed under the academic free license version 3 0"),
    ("afl-2.1", "academic free license", " licensed under the academic free license version 2 1"),
    ("osl-3.0", "open software license", " licensed under the open software license version 3 0"),
    ("osl-2.1", "open software license", " licensed under the open software license version 2 1"),
    ("rpl-1.5", "reciprocal public license", " reciprocal public license(?: version)? 1 5"),
    ("qpl-1.0", "q public license", " q public license(?: version)? 1 0|(?: the)? q public license"),
    ("ms-pl", "microsoft public license", " microsoft public license ms pl"),
    ("ms-rl", "microsoft reciprocal license", " microsoft reciprocal license ms rl"),
    ("ms-lpl", "microsoft limited public license", " microsoft limited public license"),
    ("ms-eula", "microsoft software license terms", " microsoft software license terms"),
    ("upl-1.0", "universal permissive license", " the universal permissive license upl version 1 0"),
    ("vim", "vim license", " (?:the )?vim license"),
    ("tcl", "existing copyright notices", " provided that existing copyright notices are retained in all copies and that this notice is included verbatim in any distributions"),
    ("icu", "unicode license|icu license", " (?:unicode|icu) license(?: v3)?"),
    ("w3c", "w3c software", " w3c software (?:and document )?(?:notice and )?license"),
    ("w3c", "w3c document", " this work is being provided by the copyright holders under the following license(?: [^ ]+){0,20} w3c document"),
    ("openldap-2.8", "openldap public license", " the openldap public license version 2 8"),
    ("openldap", "openldap public license", " openldap public license"),
    ("cecill-2.1", "cecill", " cecill (?:free software license agreement )?version 2 1"),
    ("cecill-b", "cecill b", " cecill b (?:free software )?licen[cs]e"),
    ("cecill-c", "cecill c", " cecill c (?:free software )?licen[cs]e"),
    ("cecill", "cecill", " (?:governed by|under) the cecill licen[cs]e"),
    ("mulan-psl-2.0", "mulan psl|mulan permissive", " mulan (?:psl|permissive software license)(?: v2| version 2)?"),
    ("lppl-1.3c", "latex project public license", " latex project public license(?: either version| version)? 1 3c?"),
    ("lppl", "latex project public license", " latex project public license"),
    ("apsl-2.0", "apple public source license", " apple public source license version 2 0"),
    ("apsl", "apple public source license", " apple public source license"),
    ("aladdin", "aladdin free public license", " aladdin free public license"),
    ("intel-simplified", "intel simplified software license", " intel simplified software license"),
    ("nvidia-eula", "nvidia", " nvidia software license agreement|(?: the)? license agreement for nvidia software"),
    ("cuda-eula", "cuda toolkit", " cuda toolkit end user license agreement"),
    ("oracle-bcl", "oracle binary code license", " oracle binary code license agreement"),
    ("sun-bcl", "sun microsystems", " sun microsystems inc binary code license agreement"),
    ("gemma", "gemma terms of use", " gemma terms of use"),
    ("openrail-m", "openrail", " (?:creativeml |bigscience )?openrail(?: m)? license"),
    ("fsl-1.1", "functional source license", " functional source license version 1 1"),
    ("hippocratic", "hippocratic license", " hippocratic license(?: version)?(?: [23] [01])?"),
    ("public-domain", "public domain", " (?:placed in|released into|dedicated to|released to|donated to|is in|are in) the public domain"),
    ("public-domain", "no copyright restrictions", " there are no copyright restrictions on this work|(?: with)? no copyright restrictions"),
    ("proprietary", "proprietary", " proprietary (?:and confidential )?licen[cs]e"),
    ("proprietary", "confidential", " (?:confidential and proprietary|proprietary and confidential) (?:information )?(?:of|property)"),
    ("proprietary", "unauthorized copying", " unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "without the express", " without the express(?: prior)? written permission of"),
    ("commercial", "commercial license", " a commercial license (?:is available|can be obtained|may be purchased)"),
    ("warranty-disclaimer", "warranty of any kind", " without warranty of any kind(?: express or implied)?"),
    ("warranty-disclaimer", "warranties", " any express or implied warranties including but not limited to the implied warranties of merchantability"),
    ("warranty-disclaimer", "without any warranty", " provided as is without any warranty"),
    ("liability-disclaimer", "be liable for any", " in no event shall the (?:authors?|copyright (?:holders?|owner)|contributors?)(?: [^ ]+){0,6} be liable for any"),
    ("contributor-agreement", "contributor license agreement", " (?:individual |corporate )?contributor license agreement"),
)

#: Labels whose sentences say little by themselves.
FAINT = {"warranty-disclaimer": (10, 0.2), "liability-disclaimer": (10, 0.2), "proprietary": (10, 0.3), "contributor-agreement": (10, 0.1), "commercial": (10, 0.3)}
