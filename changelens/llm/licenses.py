"""License scan: TF-IDF cosine of header lines and licence files to templates, then inheritance down the directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_texts as texts
from .base import ship, written


def _gnu(name: str, version: str, tail: str = "") -> tuple[str, str, str]:
    """The standard file notice of a GNU licence: its first paragraph, with the second, and with all three."""
    first = (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
             f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
    second = (" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
              f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.")
    third = f" You should have received a copy of the GNU {name} along with this program. {tail or 'If not, see <https://www.gnu.org/licenses/>.'}"
    return first, first + second, first + second + third


_OLD_ADDRESS = "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met.")
_BSD_TWO = ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
            "in the documentation and/or other materials provided with the distribution. ")
_BSD_THREE = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
              "derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
            "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
            "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON "
            "ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
            "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.")
_APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
           "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
           "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express "
           "or implied. See the License for the specific language governing permissions and limitations under the License.")

# Notices and whole texts of common licences, by SPDX name.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software.", _MIT),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", _APACHE, texts.APACHE_2_0),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", *_gnu("General Public License", "2"),
                _gnu("General Public License", "2", _OLD_ADDRESS)[2], texts.GPL_2_0),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                *_gnu("General Public License", "3")[1:], texts.GPL_3_0),
    "LGPL-2.0": ("Licensed under the GNU Library General Public License, version 2.", *_gnu("Library General Public License", "2"),
                 _gnu("Library General Public License", "2", _OLD_ADDRESS)[2], texts.LGPL_2_0),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", *_gnu("Lesser General Public License", "2.1"),
                 _gnu("Lesser General Public License", "2.1", _OLD_ADDRESS)[2], texts.LGPL_2_1),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General Public License", "3"), texts.LGPL_3_0),
    # its text is that of the GPL but for section 13
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero General Public License", "3"), texts.GPL_3_0),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD, _BSD + _BSD_TWO + _BSD_END),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",
                     _BSD, _BSD + _BSD_TWO + _BSD_THREE + _BSD_END),
    "ISC": ("Licensed under the ISC License.", _ISC,
            _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
            "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
                  "compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", texts.MPL_2_0),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 into the public domain.", texts.CC0_1_0),
}
# What tells a licence from its siblings, as patterns over terms: all of the first must be in the matching unit, the second must
# not be in it, and the third must not start before the first of the first ends (a licence text names its siblings after itself);
# of the BSD licences in the whole file, since their clauses are paragraphs of their own.
_V2, _V3 = r"(?:\b(?:version|v|license|l?gpl) |gplv?-?|gpl-v)2(?:\.0)?(?![\d.])", r"(?:\b(?:version|v|license|[al]?gpl) |gplv?-?|gpl-v)3(?:\.0)?(?![\d.])"
_OTHER_GNU, _PLAIN_GPL = r"\b(?:lesser|library|affero|lgpl|agpl)", r"(?<!lesser )(?<!library )(?<!affero )general public license|\bgpl"
MARKS = {
    "MIT": ((r"\bmit\b|permission is hereby granted free of charge",), r"\bboost software", None),
    "Apache-2.0": ((r"\bapache", r"\b(?:version|v|license|apache) 2(?:\.0)?(?![\d.])|apache-2|v2(?:\.0)?\b"), None, None),
    "GPL-2.0": ((r"general public license|\bgpl", _V2), None, _OTHER_GNU),
    "GPL-3.0": ((r"general public license|\bgpl", _V3), None, _OTHER_GNU),
    "LGPL-2.0": ((r"\b(?:library general|lgpl)", _V2), None, _PLAIN_GPL),
    "LGPL-2.1": ((r"\b(?:lesser|lgpl)", r"2\.1(?![\d.])"), None, _PLAIN_GPL),
    "LGPL-3.0": ((r"\b(?:lesser|lgpl)", _V3), None, _PLAIN_GPL),
    "AGPL-3.0": ((r"\b(?:affero|agpl)", _V3), None, _PLAIN_GPL),
    "BSD-2-Clause": ((r"\b2-clause|simplified bsd|redistributions in binary form must",), r"endorse or promote|neither the name|advertising materials|\b[34]-clause", None),
    "BSD-3-Clause": ((r"\b3-clause|endorse or promote|neither the name",), r"advertising materials|\b4-clause", None),
    "ISC": ((r"\bisc\b|provided that the above copyright notice",), None, None),
    "MPL-2.0": ((r"\b(?:mozilla|mpl)", r"\b(?:v|version|license|mpl) 2(?:\.0)?(?![\d.])|mpl-2|v2"), None, None),
    "CC-BY-4.0": ((r"\bcc[ -]by\b|\battribution\b", r"\b4\.0"), r"noncommercial|sharealike|noderiv|by-n|by-sa", None),
    "CC-BY-SA-4.0": ((r"by-sa|sharealike", r"\b4\.0"), r"noncommercial|by-nc", None),
    "CC-BY-NC-4.0": ((r"by-nc|noncommercial", r"\b4\.0"), r"sharealike|noderiv|nc-sa|nc-nd", None),
    "CC0-1.0": ((r"\bcc0|\bzero",), None, None),
}
LEAST_COSINE = 0.7
FILE_SHARE = 0.2
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"

_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def told_apart(name: str, unit: list[str], text: str) -> bool:
    """Whether the unit (its terms) of a text has what tells the licence from its siblings."""
    if name not in MARKS:
        return True
    needs, refuses, first = MARKS[name]
    where = " ".join(terms(text) if name.startswith("BSD-") else unit)
    found = [re.search(n, where) for n in needs]
    if not all(found) or refuses and re.search(refuses, where):
        return False
    sibling = re.search(first, where) if first else None
    return not sibling or sibling.start() >= found[0].end()


_OPENERS = {"/*": "*/", "<!--": "-->", "(*": "*)", "{-": "-}", '"""': '"""', "'''": "'''"}
_COMMENTED = re.compile(r"(?m)^[ \t]*(?://|#|/\*|<!--|\(\*|\{-|--|;|%|\"\"\"|'''|\*)")
_LEADER = re.compile(r"^(?://+!?|#+!?|--+|;+|%+|\*+)(?=\s|$)")
_OWNER = re.compile(r"(?i)^\W*(?:(?:portions )?copyright\b|\(c\)|©|all rights reserved|spdx-filecopyrighttext|authors?\b|@file\b|@author\b)")


def comment_blocks(text: str) -> list[list[str]]:
    """The comment blocks of a source text: runs of comment lines without their marks.  A block ends where its closing mark
    or its run of line comments ends; a line of code ends it too."""
    blocks: list[list[str]] = [[]]
    if not _COMMENTED.search(text):
        return []
    close = None
    for line in text.split("\n"):
        s = line.strip()
        if close is None:
            opener = next((o for o in _OPENERS if s.startswith(o)), None)
            if opener is None:
                mark = _LEADER.match(s)
                if mark:
                    blocks[-1].append(s[mark.end():].strip())
                elif blocks[-1]:
                    blocks.append([])
                continue
            if blocks[-1]:
                blocks.append([])
            s, close = s[len(opener):].lstrip("*!"), _OPENERS[opener]
        at = s.find(close)
        s = s if at < 0 else s[:at]
        blocks[-1].append(_LEADER.sub("", s.strip()).strip())
        if at >= 0:
            close = None
            blocks.append([])
    return [b for b in blocks if any(b)]


def units_of(text: str) -> set[str]:
    """What is held against the templates: every line, paragraph, comment block, paragraph of one, and the whole text; blocks
    and paragraphs of comments also without their lines of owners."""
    units = {x.strip() for x in [*text.split("\n"), *re.split(r"\n\s*\n", text), text]}
    for block in comment_blocks(text):
        for lines in (block, [x for x in block if not _OWNER.match(x)]):
            units.update(x.strip() for x in ["\n".join(lines), *re.split(r"\n\s*\n", "\n".join(lines))])
    return units - {""}


def template_terms(templates: dict[str, tuple[str, ...]]) -> list[str]:
    return sorted({t for notices in templates.values() for n in notices for t in terms(n)})


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of files with each term of the (template-sized) vocabulary, over all texts."""
    known = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for t in b.column("text"):
                seen.update(known.intersection(terms(t.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])

    rows = files.select("text").mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    return files.count(), {r.t: r["n"] for r in rows}


def own_licenses(files: DataFrame, templates: dict[str, tuple[str, ...]], least: float) -> DataFrame:
    """(path, own, score, share): the best template over every line, paragraph, comment block and the whole text, of those whose cosine is
    at least ``least`` and whose licence the unit tells from its siblings, and the part of the file's terms that the matching unit makes up.  Ties go to the first name."""
    ship(files.sparkSession)
    vocabulary = template_terms(templates)
    n, df = document_frequencies(files, vocabulary)
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    rare = math.log(n + 1) + 1  # a term of no template

    def weigh(found: list[str]) -> tuple[dict[str, float], float]:
        w = {t: c * idf.get(t, rare) for t, c in Counter(found).items()}
        return w, math.sqrt(sum(x * x for x in w.values()))

    names, units = zip(*[(name, weigh(terms(notice))) for name, notices in sorted(templates.items()) for notice in notices])
    weights: dict[str, np.ndarray] = {}  # a term's weight in every template of length 1
    for i, (w, size) in enumerate(units):
        for t, x in w.items():
            weights.setdefault(t, np.zeros(len(units)))[i] = x / size

    def best(text: str):
        top, all_terms = (0.0, None, 0.0), None
        for unit in sorted(units_of(text)):
            found = terms(unit)
            if not any(t in idf for t in found):
                continue
            w, norm = weigh(found)
            known = [t for t in w if t in weights]
            # no cosine is above the part of the unit that its terms of any template make up
            if math.sqrt(sum(w[t] ** 2 for t in known)) < norm * max(least, top[0]) * (1 - 1e-9):
                continue
            cosines = np.minimum(1.0, sum(w[t] * weights[t] for t in known) / norm)
            for i in np.argsort(-cosines.round(12), kind="stable"):
                cosine = float(cosines[i])
                if cosine < least or cosine <= top[0] + 1e-12:
                    break
                if told_apart(names[i], found, text):
                    all_terms = all_terms or len(terms(text))
                    top = (cosine, names[i], len(found) / all_terms)
                    break
        return top

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [best(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("path"), pa.array([g[1] for g in got], pa.string()), pa.array([g[0] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.float64())], names=["id", "path", "own", "score", "share"])

    return files.select("id", "path", "text").mapInArrow(scan, "id long, path string, own string, score double, share double")


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST_COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """(id, path, own, score, grants, license, from_directory, distance) for every row of ``files`` (id, path, text).

    A file grants its licence to its directory if it is named like a licence
    file or the notice makes up ``file_share`` of its terms; of several the highest score
    counts, then the least path.  A file without a licence of its own takes that of
    the nearest directory above it: its own (distance 0), the parent (1), up to
    the root.  Null or empty texts have no licence of their own; a null path
    neither grants nor inherits.
    """
    known = files.select("id", F.col("path").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    own = own_licenses(known, templates, least)
    directory = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace("path", "^/+", "")), "/[^/]*$", "")
    own = own.withColumn("grants", F.coalesce(F.col("own").isNotNull() & (F.col("path").rlike(LICENSE_FILE) | (F.col("share") >= file_share)), F.lit(False)))
    own = written(own.withColumn("dir", directory), "licenses-own")
    granted = own.filter("grants AND dir IS NOT NULL").groupBy("dir").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "path", "own"))["own"].alias("granted")).withColumnRenamed("dir", "above")
    # directories, not files, climb the tree
    parts = F.split("dir", "/")
    climb = own.select("dir").filter("dir IS NOT NULL").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
    climb = climb.withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/")).withColumn("distance", F.size(parts) - F.col("depth"))
    nearest = climb.join(granted, "above").groupBy("dir").agg(F.min(F.struct("distance", "above", "granted")).alias("near"))
    out = own.join(nearest, "dir", "left")
    inherits = F.col("own").isNull()
    return out.select("id", "path", "own", "score", "grants", F.coalesce("own", "near.granted").alias("license"),
                      F.when(inherits, F.when(F.col("near.above") == "", "/").otherwise(F.col("near.above"))).alias("from_directory"),
                      F.when(inherits, F.col("near.distance")).alias("distance"))
