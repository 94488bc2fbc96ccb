"""License signature rules: a keyword that must be there once blanks are single spaces, a regex over lower-case text, a label, a priority, a score."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int
    score: float


#: Identifiers that name a license as they stand, in lower case.
IDENTIFIERS = """0bsd aal afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0
blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0
cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0
cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b
cpl-1.0 ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0-only gpl-2.0-or-later
gpl-3.0 gpl-3.0-only gpl-3.0-or-later hpnd isc ipl-1.0 lgpl-2.0 lgpl-2.1 lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0
lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa
odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 tcl unlicense upl-1.0
vim w3c wtfpl x11 zlib zpl-2.1""".split()

_V = r"[\s,]*(?:\(?\s*)?v(?:ersion|ersions|\.)?\s*"
#: Names, notices and phrases: label | keyword | regex | score.
WRITTEN = r"""
gpl-3.0 | general public | gnu\s+general\s+public\s+licen[cs]e{V}3(?:\.0)?\b | 0.95
gpl-2.0 | general public | gnu\s+general\s+public\s+licen[cs]e{V}2(?:\.0)?\b | 0.95
gpl-1.0 | general public | gnu\s+general\s+public\s+licen[cs]e{V}1(?:\.0)?\b | 0.9
gpl-3.0-or-later | general public | general\s+public\s+licen[cs]e.{0,200}?either\s+version\s+3\b.{0,60}?any\s+later\s+version | 0.97
gpl-2.0-or-later | general public | general\s+public\s+licen[cs]e.{0,200}?either\s+version\s+2\b.{0,60}?any\s+later\s+version | 0.97
gpl | general public | gnu\s+general\s+public\s+licen[cs]e | 0.85
gpl | gpl | \bgnu\s+gpl\b | 0.8
gpl-3.0 | gpl | \bgpl\s*v\.?\s*3\b | 0.85
gpl-2.0 | gpl | \bgpl\s*v\.?\s*2\b | 0.85
lgpl-3.0 | lesser general | gnu\s+lesser\s+general\s+public\s+licen[cs]e{V}3(?:\.0)?\b | 0.95
lgpl-2.1 | lesser general | gnu\s+lesser\s+general\s+public\s+licen[cs]e{V}2\.1\b | 0.95
lgpl | lesser general | gnu\s+lesser\s+general\s+public\s+licen[cs]e | 0.85
lgpl-2.0 | library general | gnu\s+library\s+general\s+public\s+licen[cs]e | 0.85
lgpl-3.0 | lgpl | \blgpl\s*v?\.?\s*3\b | 0.85
lgpl-2.1 | lgpl | \blgpl\s*v?\.?\s*2\.1\b | 0.85
agpl-3.0 | affero | gnu\s+affero\s+general\s+public\s+licen[cs]e{V}3(?:\.0)?\b | 0.95
agpl | affero | gnu\s+affero\s+general\s+public\s+licen[cs]e | 0.85
agpl-3.0 | agpl | \bagpl\s*v?\.?\s*3\b | 0.85
gfdl | free documentation | gnu\s+free\s+documentation\s+licen[cs]e | 0.9
gfdl-1.3 | free documentation | gnu\s+free\s+documentation\s+licen[cs]e{V}1\.3\b | 0.95
apache-2.0 | apache | apache\s+licen[cs]e{V}2(?:\.0)?\b | 0.95
apache-2.0 | apache | apache\s+2(?:\.0)?\s+licen[cs]e | 0.9
apache-2.0 | apache | apache\.org/licenses/license-2\.0 | 0.95
apache-1.1 | apache | apache\s+(?:software\s+)?licen[cs]e{V}1\.1\b | 0.95
apache | apache | apache\s+(?:software\s+)?licen[cs]e | 0.85
mit | mit | \bmit\s+licen[cs]e\b | 0.9
mit | mit | \breleased\s+under\s+(?:the\s+)?mit\b | 0.85
mit | mit | \blicen[cs]ed\s+under\s+(?:the\s+)?mit\b | 0.9
mit | permission is hereby | permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy | 0.95
mit-0 | no attribution | \bmit\s+no\s+attribution\b | 0.95
isc | isc | \bisc\s+licen[cs]e\b | 0.9
isc | permission to use | permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose | 0.9
bsd-3-clause | bsd | \b(?:3|three)[\s-]*clause\s+bsd\b | 0.95
bsd-3-clause | bsd | \bbsd[\s-]*(?:3|three)[\s-]*clause\b | 0.95
bsd-2-clause | bsd | \b(?:2|two)[\s-]*clause\s+bsd\b | 0.95
bsd-2-clause | bsd | \bbsd[\s-]*(?:2|two)[\s-]*clause\b | 0.95
bsd-4-clause | bsd | \b(?:4|four)[\s-]*clause\s+bsd\b | 0.95
bsd-2-clause | simplified bsd | \bsimplified\s+bsd\s+licen[cs]e | 0.9
bsd-3-clause | bsd | \b(?:new|modified|revised)\s+bsd\s+licen[cs]e | 0.9
bsd | bsd | \bbsd\s+licen[cs]e | 0.8
bsd | redistribution | redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms | 0.9
bsd-3-clause | endorse or promote | may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products | 0.85
bsd-4-clause | advertising materials | all\s+advertising\s+materials\s+mentioning\s+features | 0.9
0bsd | zero | zero[\s-]*clause\s+bsd | 0.95
mpl-2.0 | mozilla | mozilla\s+public\s+licen[cs]e{V}2(?:\.0)?\b | 0.95
mpl-1.1 | mozilla | mozilla\s+public\s+licen[cs]e{V}1\.1\b | 0.95
mpl | mozilla | mozilla\s+public\s+licen[cs]e | 0.85
mpl-2.0 | mpl | mozilla\.org/mpl/2\.0 | 0.95
epl-2.0 | eclipse | eclipse\s+public\s+licen[cs]e[\s,-]*v?(?:ersion)?\s*2(?:\.0)?\b | 0.95
epl-1.0 | eclipse | eclipse\s+public\s+licen[cs]e[\s,-]*v?(?:ersion)?\s*1(?:\.0)?\b | 0.95
epl | eclipse | eclipse\s+public\s+licen[cs]e | 0.85
cddl | common development | common\s+development\s+and\s+distribution\s+licen[cs]e | 0.9
cpl-1.0 | common public | common\s+public\s+licen[cs]e | 0.85
eupl | european union | european\s+union\s+public\s+licen[cs]e | 0.9
artistic-2.0 | artistic | artistic\s+licen[cs]e{V}2(?:\.0)?\b | 0.95
artistic | artistic | \bartistic\s+licen[cs]e | 0.85
bsl-1.0 | boost | boost\s+software\s+licen[cs]e | 0.9
busl-1.1 | business source | business\s+source\s+licen[cs]e | 0.9
elastic-2.0 | elastic | elastic\s+licen[cs]e{V}2(?:\.0)?\b | 0.95
sspl-1.0 | server side | server\s+side\s+public\s+licen[cs]e | 0.9
unlicense | unlicense | \bthe\s+unlicense\b | 0.9
unlicense | public domain | this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain | 0.97
wtfpl | wtfpl | \bwtfpl\b | 0.9
wtfpl | do what the | do\s+what\s+the\s+f\S{2,4}\s+you\s+want\s+to\s+public\s+licen[cs]e | 0.95
zlib | zlib | \bzlib(?:/libpng)?\s+licen[cs]e | 0.9
zlib | as-is | provided\s+'?as-is'?,?\s+without\s+any\s+express\s+or\s+implied\s+warranty | 0.7
python-2.0 | python software | python\s+software\s+foundation\s+licen[cs]e | 0.9
php-3.01 | php | \bphp\s+licen[cs]e\b | 0.85
ruby | ruby | \bruby\s+licen[cs]e\b | 0.8
postgresql | postgresql | \bpostgresql\s+licen[cs]e | 0.9
openssl | openssl | \bopenssl\s+licen[cs]e | 0.9
ofl-1.1 | open font | (?:sil\s+)?open\s+font\s+licen[cs]e | 0.9
ncsa | university of illinois | university\s+of\s+illinois/?\s*ncsa\s+open\s+source\s+licen[cs]e | 0.95
w3c | w3c | \bw3c\s+software\s+(?:notice\s+and\s+)?licen[cs]e | 0.9
x11 | x11 | \bx11\s+licen[cs]e | 0.9
ms-pl | microsoft public | microsoft\s+public\s+licen[cs]e | 0.9
ms-rl | microsoft reciprocal | microsoft\s+reciprocal\s+licen[cs]e | 0.9
odbl-1.0 | open database | open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e | 0.9
upl-1.0 | universal permissive | universal\s+permissive\s+licen[cs]e | 0.9
osl-3.0 | open software | open\s+software\s+licen[cs]e{V}3(?:\.0)?\b | 0.95
afl-3.0 | academic free | academic\s+free\s+licen[cs]e | 0.9
ecl-2.0 | educational community | educational\s+community\s+licen[cs]e | 0.9
blueoak-1.0.0 | blue oak | blue\s+oak\s+model\s+licen[cs]e | 0.95
mulanpsl-2.0 | mulan | mulan\s+permissive\s+software\s+licen[cs]e | 0.95
qpl-1.0 | q public | \bq\s+public\s+licen[cs]e | 0.9
sleepycat | sleepycat | sleepycat\s+licen[cs]e | 0.9
lppl-1.3c | latex project | latex\s+project\s+public\s+licen[cs]e | 0.9
hpnd | historical permission | historical\s+permission\s+notice\s+and\s+disclaimer | 0.95
cecill | cecill | \bcecill(?:-[bc])?\s+licen[cs]e | 0.85
aal | attribution assurance | attribution\s+assurance\s+licen[cs]e | 0.95
agpl-3.0-or-later | affero | affero\s+general\s+public\s+licen[cs]e.{0,200}?either\s+version\s+3\b.{0,60}?any\s+later\s+version | 0.97
agpl-3.0-or-later | agpl | \bagpl\s*v?\.?\s*3(?:\.0)?(?:\+|\s+or\s+(?:any\s+)?later\b) | 0.95
agpl-3.0-only | affero | affero\s+general\s+public\s+licen[cs]e{V}3(?:\.0)?\s+only\b | 0.97
agpl-3.0-only | agpl | \bagpl\s*v?\.?\s*3(?:\.0)?\s+only\b | 0.95
apsl-2.0 | apple public | apple\s+public\s+source\s+licen[cs]e{V}2(?:\.0)?\b | 0.95
apsl | apple public | apple\s+public\s+source\s+licen[cs]e | 0.85
artistic-1.0 | artistic | artistic\s+licen[cs]e{V}1(?:\.0)?\b | 0.95
artistic-1.0 | intent of this | the\s+intent\s+of\s+this\s+document\s+is\s+to\s+state\s+the\s+conditions\s+under\s+which\s+a\s+package\s+may\s+be\s+copied | 0.9
bsd-1-clause | bsd | \b(?:1|one)[\s-]*clause\s+bsd\b | 0.95
bsd-1-clause | bsd | \bbsd[\s-]*(?:1|one)[\s-]*clause\b | 0.95
bsd-2-clause-patent | bsd | \bbsd[\s-]*(?:2|two)[\s-]*clause\s+plus\s+patent\b | 0.97
bsd-2-clause-patent | bsd | \bbsd\s*\+\s*patent\b | 0.95
bsd-3-clause-clear | clear bsd | \bclear\s+bsd\s+licen[cs]e | 0.95
bsd-3-clause-clear | no express | no\s+express\s+or\s+implied\s+licen[cs]es\s+to\s+any\s+party's\s+patent\s+rights\s+are\s+granted\s+by\s+this\s+licen[cs]e | 0.9
cddl-1.0 | common development | common\s+development\s+and\s+distribution\s+licen[cs]e(?:\s*\(cddl\))?{V}1\.0\b | 0.95
cddl-1.1 | common development | common\s+development\s+and\s+distribution\s+licen[cs]e(?:\s*\(cddl\))?{V}1\.1\b | 0.95
cddl-1.0 | cddl | \bcddl\s*v?\.?\s*1\.0\b | 0.85
cddl-1.1 | cddl | \bcddl\s*v?\.?\s*1\.1\b | 0.85
cecill-2.1 | cecill | \bcecill(?:\s+free\s+software)?(?:\s+licen[cs]e)?(?:\s+agreement)?{V}2\.1\b | 0.95
cecill-b | cecill | \bcecill-b(?:\s+free\s+software)?\s+licen[cs]e | 0.95
eupl-1.1 | european union | european\s+union\s+public\s+licen[cs]e(?:\s*\(eupl\))?{V}1\.1\b | 0.95
eupl-1.2 | european union | european\s+union\s+public\s+licen[cs]e(?:\s*\(eupl\))?{V}1\.2\b | 0.95
eupl-1.1 | eupl | \beupl\s*v?\.?\s*1\.1\b | 0.85
eupl-1.2 | eupl | \beupl\s*v?\.?\s*1\.2\b | 0.85
gfdl-1.2 | free documentation | gnu\s+free\s+documentation\s+licen[cs]e{V}1\.2\b | 0.95
gpl-2.0-only | general public | gnu\s+general\s+public\s+licen[cs]e{V}2(?:\.0)?\s+only\b | 0.97
gpl-2.0-only | gpl | \bgpl\s*v?\.?\s*2(?:\.0)?\s+only\b | 0.95
gpl-2.0-or-later | gpl | \bgpl\s*v?\.?\s*2(?:\.0)?(?:\+|\s+or\s+(?:any\s+)?later\b) | 0.95
gpl-3.0-only | general public | gnu\s+general\s+public\s+licen[cs]e{V}3(?:\.0)?\s+only\b | 0.97
gpl-3.0-only | gpl | \bgpl\s*v?\.?\s*3(?:\.0)?\s+only\b | 0.95
gpl-3.0-or-later | gpl | \bgpl\s*v?\.?\s*3(?:\.0)?(?:\+|\s+or\s+(?:any\s+)?later\b) | 0.95
ipl-1.0 | ibm public | \bibm\s+public\s+licen[cs]e | 0.95
lgpl-2.1-only | lesser general | gnu\s+lesser\s+general\s+public\s+licen[cs]e{V}2\.1\s+only\b | 0.97
lgpl-2.1-only | lgpl | \blgpl\s*v?\.?\s*2\.1\s+only\b | 0.95
lgpl-2.1-or-later | lesser general | lesser\s+general\s+public\s+licen[cs]e.{0,200}?either\s+version\s+2\.1\b.{0,60}?any\s+later\s+version | 0.97
lgpl-2.1-or-later | lgpl | \blgpl\s*v?\.?\s*2\.1(?:\+|\s+or\s+(?:any\s+)?later\b) | 0.95
lgpl-3.0-only | lesser general | gnu\s+lesser\s+general\s+public\s+licen[cs]e{V}3(?:\.0)?\s+only\b | 0.97
lgpl-3.0-only | lgpl | \blgpl\s*v?\.?\s*3(?:\.0)?\s+only\b | 0.95
lgpl-3.0-or-later | lesser general | lesser\s+general\s+public\s+licen[cs]e.{0,200}?either\s+version\s+3\b.{0,60}?any\s+later\s+version | 0.97
lgpl-3.0-or-later | lgpl | \blgpl\s*v?\.?\s*3(?:\.0)?(?:\+|\s+or\s+(?:any\s+)?later\b) | 0.95
mpl-1.0 | mozilla | mozilla\s+public\s+licen[cs]e{V}1\.0\b | 0.95
mpl-2.0-no-copyleft-exception | incompatible with | incompatible\s+with\s+secondary\s+licen[cs]es["']?,?\s+as\s+defined\s+by\s+the\s+mozilla\s+public\s+licen[cs]e | 0.97
psf-2.0 | python software | python\s+software\s+foundation\s+licen[cs]e{V}2\b | 0.95
psf-2.0 | psf | \bpsf\s+licen[cs]e(?:\s+agreement)? | 0.85
tcl | tcl/tk | \btcl/tk\s+licen[cs]e | 0.9
vim | vim | \bvim\s+licen[cs]e\b | 0.9
zpl-2.1 | zope | zope\s+public\s+licen[cs]e(?:\s*\(zpl\))?{V}2\.1\b | 0.95
zpl | zope | zope\s+public\s+licen[cs]e | 0.85
cc0-1.0 | cc0 | \bcc0(?:\s+1\.0)?\b | 0.9
cc0-1.0 | creative commons | creative\s+commons\s+zero\b | 0.9
cc0-1.0 | publicdomain | creativecommons\.org/publicdomain/zero/1\.0 | 0.97
public-domain | public domain | (?:in|into|to)\s+the\s+public\s+domain | 0.6
proprietary | all rights reserved | \ball\s+rights\s+reserved\b | 0.5
proprietary | proprietary | \bproprietary\s+and\s+confidential\b | 0.8
proprietary | may not be | may\s+not\s+be\s+(?:reproduced|copied|distributed)[^.]{0,80}without\s+(?:prior\s+)?(?:written\s+)?permission | 0.7
gpl-3.0 | copyleft license | gnu\s+general\s+public\s+license\s+is\s+a\s+free,?\s+copyleft\s+license | 0.95
gpl-2.0 | designed to take away | licenses\s+for\s+most\s+software\s+are\s+designed\s+to\s+take\s+away\s+your\s+freedom | 0.9
gpl | copy of the gnu general | received\s+a\s+copy\s+of\s+the\s+gnu\s+general\s+public\s+licen[cs]e | 0.9
lgpl | copy of the gnu lesser | received\s+a\s+copy\s+of\s+the\s+gnu\s+lesser\s+general\s+public\s+licen[cs]e | 0.9
agpl | copy of the gnu affero | received\s+a\s+copy\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+licen[cs]e | 0.9
gpl-2.0 | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0 | 0.97
gpl-3.0 | gnu.org/licenses | gnu\.org/licenses/gpl-3\.0 | 0.97
lgpl-2.1 | gnu.org/licenses | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1 | 0.97
lgpl-3.0 | gnu.org/licenses | gnu\.org/licenses/lgpl-3\.0 | 0.97
agpl-3.0 | gnu.org/licenses | gnu\.org/licenses/agpl-3\.0 | 0.97
gfdl-1.3 | gnu.org/licenses | gnu\.org/licenses/fdl-1\.3 | 0.97
gfdl | invariant sections | with\s+no\s+invariant\s+sections,?\s+(?:with\s+)?no\s+front-cover\s+texts | 0.9
gpl-2.0-with-classpath-exception | classpath | \bclasspath\s+exception\b | 0.95
gpl-2.0-with-classpath-exception | statically or dynamically | linking\s+this\s+library\s+statically\s+or\s+dynamically\s+with\s+other\s+modules | 0.95
gpl-3.0-with-gcc-exception | runtime library exception | \bgcc\s+runtime\s+library\s+exception\b | 0.95
gpl-2.0-with-bison-exception | bison | exception,?\s+you\s+may\s+create\s+a\s+larger\s+work\s+that\s+contains\s+part\s+or\s+all\s+of\s+the\s+bison\s+parser\s+skeleton | 0.95
gpl-with-autoconf-exception | autoconf | configuration\s+script\s+generated\s+by\s+autoconf | 0.8
gpl-with-font-exception | font exception | \bgpl\s+font\s+exception\b | 0.95
gpl-with-openssl-exception | openssl | permission\s+to\s+link\s+the\s+code\s+of\s+.{1,80}?with\s+the\s+openssl\s+(?:project's\s+)?(?:openssl\s+)?library | 0.9
linux-syscall-note | system calls | does\s+not\s+cover\s+user\s+programs\s+that\s+use\s+kernel\s+services\s+by\s+normal\s+system\s+calls | 0.95
apache-2.0 | unless required by applicable | unless\s+required\s+by\s+applicable\s+law\s+or\s+agreed\s+to\s+in\s+writing,?\s+software\s+distributed\s+under\s+the\s+license | 0.9
apache-2.0 | asl | \basl\s*v?2(?:\.0)?\b | 0.8
apache-1.1 | apache software foundation | includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation | 0.8
apache-2.0-with-llvm-exception | llvm | apache\s+licen[cs]e{V}2(?:\.0)?\s+with\s+llvm\s+exceptions? | 0.97
mit | permission notice shall | the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies | 0.85
mit | expat | \bexpat\s+licen[cs]e\b | 0.9
mit | mit-style | \bmit-style\s+licen[cs]e\b | 0.85
mit | mit/x11 | \bmit/x11\s+licen[cs]e\b | 0.9
json | good, not evil | shall\s+be\s+used\s+for\s+good,\s+not\s+evil | 0.97
x11 | x consortium | the\s+name\s+of\s+the\s+x\s+consortium\s+shall\s+not\s+be\s+used | 0.95
xfree86-1.1 | xfree86 | \bxfree86\s+licen[cs]e\b | 0.9
isc | with or without fee | for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted | 0.85
bsd-3-clause | neither the name | neither\s+the\s+name\s+of\s+.{1,120}?\s+nor\s+the\s+names\s+of\s+(?:its|his|their|the)\s+contributors | 0.9
bsd | list of conditions | this\s+list\s+of\s+conditions\s+and\s+the\s+following\s+disclaimer | 0.85
bsd-2-clause-views | views and conclusions | the\s+views\s+and\s+conclusions\s+contained\s+in\s+the\s+software\s+and\s+documentation | 0.9
bsd-2-clause | freebsd | \bfreebsd\s+licen[cs]e\b | 0.9
bsd-3-clause-no-nuclear-license | nuclear facility | not\s+designed,?\s+licensed\s+or\s+intended\s+for\s+use\s+in\s+the\s+design,?\s+construction,?\s+operation\s+or\s+maintenance\s+of\s+any\s+nuclear\s+facility | 0.9
bsd-protection | bsd protection | \bbsd\s+protection\s+licen[cs]e\b | 0.95
bsd-4-clause-uc | university of california | developed\s+by\s+the\s+university\s+of\s+california,?\s+berkeley\s+and\s+its\s+contributors | 0.9
bsl-1.0 | person or organization | free\s+of\s+charge,?\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy\s+of\s+the\s+software\s+and\s+accompanying\s+documentation | 0.97
bsl-1.0 | boost.org | boost\.org/license_1_0\.txt | 0.97
zlib | plainly marked | altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such | 0.95
libpng | libpng | \blibpng\s+licen[cs]e\b | 0.9
mpl-2.0 | source code form | this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+licen[cs]e | 0.95
mpl-1.1 | mozilla.org/mpl | mozilla\.org/mpl/mpl-1\.1 | 0.97
mpl-1.1 | contents of this file are subject | the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public\s+licen[cs]e\s+version\s+1\.1 | 0.97
npl-1.1 | netscape | \bnetscape\s+public\s+licen[cs]e\b | 0.9
epl-2.0 | eclipse.org/legal | eclipse\.org/legal/epl-(?:v2?0|2\.0) | 0.95
epl-1.0 | eclipse.org/legal | eclipse\.org/legal/epl-v10 | 0.97
edl-1.0 | eclipse distribution | \beclipse\s+distribution\s+licen[cs]e | 0.9
cddl-1.0 | cddl | opensource\.org/licenses/cddl1 | 0.95
sissl | sun industry | \bsun\s+industry\s+standards\s+source\s+licen[cs]e | 0.95
spl-1.0 | sun public | \bsun\s+public\s+licen[cs]e | 0.9
artistic-1.0-perl | perl itself | under\s+the\s+same\s+terms\s+as\s+perl\s+itself | 0.85
clartistic | clarified artistic | \bclarified\s+artistic\s+licen[cs]e | 0.95
cc-by-sa | wikipedia | text\s+of\s+wikipedia\s+is\s+available\s+under\s+.{0,40}?attribution-sharealike | 0.8
cc-pddc | public domain dedication | \bpublic\s+domain\s+dedication\s+and\s+certification\b | 0.95
pddl-1.0 | public domain dedication | \bopen\s+data\s+commons\s+public\s+domain\s+dedication\b | 0.97
odc-by-1.0 | open data commons | \bopen\s+data\s+commons\s+attribution\s+licen[cs]e | 0.95
cdla-permissive | community data | \bcommunity\s+data\s+licen[cs]e\s+agreement\s*(?:-|–)?\s*permissive | 0.95
cdla-sharing | community data | \bcommunity\s+data\s+licen[cs]e\s+agreement\s*(?:-|–)?\s*sharing | 0.95
ogl-uk-3.0 | open government | \bopen\s+government\s+licen[cs]e{V}3(?:\.0)?\b | 0.95
ogl-uk | open government | \bopen\s+government\s+licen[cs]e | 0.85
etalab-2.0 | licence ouverte | \blicence\s+ouverte(?:\s*/\s*open\s+licence)?\b | 0.9
dl-de-by-2.0 | datenlizenz | \bdatenlizenz\s+deutschland\b | 0.9
fal-1.3 | free art | \bfree\s+art\s+licen[cs]e | 0.9
ofl-1.1 | reserved font name | with\s+reserved\s+font\s+name | 0.85
ofl-1.1 | scripts.sil.org | scripts\.sil\.org/ofl | 0.97
afl-2.1 | academic free | academic\s+free\s+licen[cs]e{V}2\.1\b | 0.95
osl-2.1 | open software | open\s+software\s+licen[cs]e{V}2\.1\b | 0.95
nposl-3.0 | non-profit open | \bnon-profit\s+open\s+software\s+licen[cs]e | 0.95
apl-1.0 | adaptive public | \badaptive\s+public\s+licen[cs]e | 0.95
aladdin | aladdin | \baladdin\s+free\s+public\s+licen[cs]e | 0.95
beerware | beer | the\s+beer-?ware\s+licen[cs]e | 0.95
bittorrent-1.1 | bittorrent | \bbittorrent\s+open\s+source\s+licen[cs]e | 0.95
bzip2-1.0.6 | bzip2 | \bbzip2\s+and\s+libbzip2\s+licen[cs]e | 0.95
catosl-1.1 | computer associates | \bcomputer\s+associates\s+trusted\s+open\s+source\s+licen[cs]e | 0.95
cpal-1.0 | common public attribution | \bcommon\s+public\s+attribution\s+licen[cs]e | 0.95
cpol-1.02 | code project | \bcode\s+project\s+open\s+licen[cs]e | 0.95
cua-opl-1.0 | cua office | \bcua\s+office\s+public\s+licen[cs]e | 0.95
curl | curl | \bcurl\s+licen[cs]e\b | 0.85
ecos-2.0 | ecos | \becos\s+licen[cs]e\b | 0.85
efl-2.0 | eiffel forum | \beiffel\s+forum\s+licen[cs]e | 0.95
entessa | entessa | \bentessa\s+public\s+licen[cs]e | 0.95
eudatagrid | eu datagrid | \beu\s+datagrid\s+software\s+licen[cs]e | 0.95
fair | fair license | \bthe\s+fair\s+license\b | 0.85
frameworx-1.0 | frameworx | \bframeworx\s+open\s+licen[cs]e | 0.95
ftl | freetype | \bfreetype\s+(?:project\s+)?licen[cs]e | 0.95
gsoap-1.3b | gsoap | \bgsoap\s+public\s+licen[cs]e | 0.95
hippocratic-2.1 | hippocratic | \bhippocratic\s+licen[cs]e | 0.95
ijg | independent jpeg | based\s+in\s+part\s+on\s+the\s+work\s+of\s+the\s+independent\s+jpeg\s+group | 0.95
imagemagick | imagemagick | \bimagemagick\s+licen[cs]e | 0.9
intel | intel open | \bintel\s+open\s+source\s+licen[cs]e | 0.95
ipa | ipa font | \bipa\s+font\s+licen[cs]e | 0.95
lpl-1.02 | lucent public | \blucent\s+public\s+licen[cs]e | 0.95
liliq-p-1.1 | liliq | \bliliq-p\b | 0.85
miros | miros | \bmiros\s+licen[cs]e | 0.9
motosoto | motosoto | \bmotosoto\s+open\s+source\s+licen[cs]e | 0.95
multics | multics | \bmultics\s+licen[cs]e | 0.9
nasa-1.3 | nasa open | \bnasa\s+open\s+source\s+agreement | 0.95
naumen | naumen | \bnaumen\s+public\s+licen[cs]e | 0.95
ngpl | nethack | \bnethack\s+general\s+public\s+licen[cs]e | 0.97
nokia | nokia open | \bnokia\s+open\s+source\s+licen[cs]e | 0.95
ntp | ntp license | \bntp\s+license\b | 0.85
oclc-2.0 | oclc research | \boclc\s+research\s+public\s+licen[cs]e | 0.95
oldap-2.8 | openldap | \bopenldap\s+public\s+licen[cs]e | 0.95
oset-pl-2.1 | oset public | \boset\s+public\s+licen[cs]e | 0.95
openssl | openssl toolkit | developed\s+by\s+the\s+openssl\s+project\s+for\s+use\s+in\s+the\s+openssl\s+toolkit | 0.95
ssleay | ssleay | \bssleay\s+licen[cs]e | 0.9
parity-7.0.0 | parity public | \bparity\s+public\s+licen[cs]e | 0.95
polyform-noncommercial-1.0.0 | polyform | \bpolyform\s+noncommercial\s+licen[cs]e | 0.97
polyform-small-business-1.0.0 | polyform | \bpolyform\s+small\s+business\s+licen[cs]e | 0.97
polyform-shield-1.0.0 | polyform | \bpolyform\s+shield\s+licen[cs]e | 0.97
commons-clause | commons clause | \bcommons\s+clause\s+licen[cs]e\s+condition | 0.95
python-2.0 | beopen | \bbeopen\s+python\s+open\s+source\s+licen[cs]e | 0.9
cnri-python | cnri | \bcnri\s+(?:open\s+source\s+)?licen[cs]e\s+agreement | 0.9
rpl-1.5 | reciprocal public | \breciprocal\s+public\s+licen[cs]e | 0.9
rpsl-1.0 | realnetworks | \brealnetworks\s+public\s+source\s+licen[cs]e | 0.95
rscpl | ricoh | \bricoh\s+source\s+code\s+public\s+licen[cs]e | 0.95
sgi-b-2.0 | sgi free | \bsgi\s+free\s+software\s+licen[cs]e\s+b\b | 0.95
simpl-2.0 | simple public | \bsimple\s+public\s+licen[cs]e | 0.9
sleepycat | berkeley db | redistributions\s+in\s+any\s+form\s+must\s+be\s+accompanied\s+by\s+information\s+on\s+how\s+to\s+obtain\s+complete\s+source\s+code\s+for\s+the\s+(?:db|berkeley\s+db)\s+software.{0,200}?berkeley\s+db | 0.9
sugarcrm-1.1.3 | sugarcrm | \bsugarcrm\s+public\s+licen[cs]e | 0.95
unicode-dfs-2016 | unicode | \bunicode,?\s+inc\.\s+licen[cs]e\s+agreement | 0.95
unicode-dfs-2016 | unicode data files | copy\s+of\s+the\s+unicode\s+data\s+files\s+and\s+any\s+associated\s+documentation | 0.95
vsl-1.0 | vovida | \bvovida\s+software\s+licen[cs]e | 0.95
watcom-1.0 | watcom | \bsybase\s+open\s+watcom\s+public\s+licen[cs]e | 0.95
wxwindows | wxwindows | \bwxwindows\s+library\s+licen[cs]e | 0.95
w3c | w3c document | \bw3c\s+document\s+licen[cs]e | 0.85
xnet | x.net | \bx\.net,?\s+inc\.\s+licen[cs]e | 0.9
ypl-1.1 | yahoo | \byahoo!?\s+public\s+licen[cs]e | 0.95
zend-2.0 | zend | \bzend\s+(?:engine\s+)?licen[cs]e | 0.85
zimbra-1.3 | zimbra | \bzimbra\s+public\s+licen[cs]e | 0.95
elastic-2.0 | hosted or managed service | provide\s+the\s+software\s+to\s+third\s+parties\s+as\s+a\s+hosted\s+or\s+managed\s+service | 0.9
busl-1.1 | change date | on\s+the\s+change\s+date,?\s+or\s+the\s+fourth\s+anniversary | 0.9
rail | open rail | \b(?:creativeml|bigscience|bigcode)\s+open\s*rail(?:-m)?\b | 0.95
rail | responsible ai | \bresponsible\s+ai\s+licen[cs]e | 0.85
llama-community | community license | \bllama\s+(?:2|3|3\.1)\s+community\s+license\b | 0.95
unlicense | unlicense.org | \bunlicense\.org\b | 0.97
wtfpl | wtfpl.net | \bwtfpl\.net\b | 0.97
cc0-1.0 | no copyright | \bno\s+copyright\s*(?:-|–)\s*cc0\b | 0.9
cc0-1.0 | waived all copyright | waived\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights | 0.95
public-domain | public domain | \b(?:released|placed|dedicated)\s+(?:in|into|to)\s+the\s+public\s+domain\b | 0.8
public-domain | us government work | \bus\s+government\s+work\b | 0.7
proprietary | confidential and proprietary | \bconfidential\s+and\s+proprietary\b | 0.8
proprietary | unauthorized copying | unauthorized\s+copying\s+of\s+this\s+(?:file|software),?\s+via\s+any\s+medium | 0.9
proprietary | unauthorised copying | unauthorised\s+copying\s+of\s+this\s+(?:file|software) | 0.85
proprietary | no part of this | no\s+part\s+of\s+this\s+(?:publication|book|document|work)\s+may\s+be\s+reproduced | 0.85
proprietary | trade secret | \bcontains?\s+(?:valuable\s+)?trade\s+secrets?\s+(?:of|and)\b | 0.8
proprietary | license agreement | \bend[\s-]+user\s+license\s+agreement\b | 0.7
proprietary | internal use only | \bfor\s+internal\s+use\s+only\b | 0.6
proprietary | for redistribution | \bnot\s+for\s+redistribution\b | 0.7
proprietary | evaluation purposes | \bfor\s+evaluation\s+purposes\s+only\b | 0.7
proprietary | license key | \brequires\s+a\s+valid\s+license\s+key\b | 0.6
non-commercial | non-commercial | \bfor\s+(?:personal,?\s+)?non-commercial\s+(?:use|purposes)\s+only\b | 0.75
non-commercial | personal use only | \bfor\s+personal\s+use\s+only\b | 0.6
non-commercial | research purposes | \bfor\s+(?:academic\s+|scientific\s+)?research\s+purposes\s+only\b | 0.7
"""
#: Creative Commons: label part | words of the long name after "attribution" | letters.
CC = (("by-nc-nd", r"non-?commercial[\s-]*no-?deriv\w*", "by-nc-nd"), ("by-nc-sa", r"non-?commercial[\s-]*share-?alike", "by-nc-sa"), ("by-nc", r"non-?commercial", "by-nc"), ("by-nd", r"no-?deriv\w*", "by-nd"), ("by-sa", r"share-?alike", "by-sa"), ("by", "", "by"))
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def rules() -> list[Rule]:
    """All rules, a few hundred: written ones, and for each identifier and each Creative Commons
    license and version the forms in which they are cited. Higher priority is more specific."""
    out = []
    for line in WRITTEN.strip().splitlines():
        label, keyword, regex, score = (x.strip() for x in line.split(" | "))
        out.append(Rule(label, keyword, regex.replace("{V}", _V), 60 if "-" in label else 40, float(score)))
    for name in IDENTIFIERS:
        own, end = re.escape(name), r"(?![\w+-]|\.\d)"
        out.append(Rule(name, "spdx", rf"spdx-license-identifier:\s*\(?{own}{end}", 90, 1.0))
        out.append(Rule(name, "spdx.org", rf"spdx\.org/licenses/{own}{end}", 85, 0.97))
        out.append(Rule(name, "opensource.org", rf"opensource\.org/licen[cs]es?/{own}{end}", 85, 0.97))
        out.append(Rule(name, "licen", rf"\blicen[cs]e[\"']?\s*[:=]\s*[\"']?{own}{end}", 80, 0.9))
    for part, words, letters in CC:
        gap = re.escape(letters).replace(r"\-", r"[\s-]+")
        out.append(Rule(f"cc-{part}", "creative commons", rf"creative\s+commons\s+attribution[\s-]*{words}", 50, 0.85))
        out.append(Rule(f"cc-{part}", "cc", rf"\bcc[\s-]+{gap}\b(?!-)", 50, 0.8))
        for v in VERSIONS:
            own = re.escape(v)
            out.append(Rule(f"cc-{part}-{v}", "creative commons", rf"creative\s+commons\s+attribution[\s-]*{words}\s*(?:licen[cs]e)?\s*(?:version\s*)?{own}", 70, 0.95))
            out.append(Rule(f"cc-{part}-{v}", "cc", rf"\bcc[\s-]+{gap}[\s-]+{own}\b", 70, 0.95))
            out.append(Rule(f"cc-{part}-{v}", "creativecommons.org", rf"creativecommons\.org/licenses/{letters}/{own}", 85, 0.97))
    return out
