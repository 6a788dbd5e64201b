"""License scans: templates with optional and replaceable regions as token automata."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import slices

# Phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Templates.  [[ ... ]] is optional; {{a..b}} is a replaceable region of a to b words;
# {{a..b:pattern}} one whose words each match the pattern.  All other words are
# mandatory and must match exactly; case (A-Z), spacing and punctuation do not count.
# The wordings of public licences and of their customary notices.
_HOLDER = "{{1..8}}"
_AS_IS = f"this software is provided by {{{{1..12}}}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{{{1..12}}}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_FREE = "under the terms of the {} as published by the free software foundation [[either]] version {}"
_LATER = "[[of the license]] [[or at your option any later version]] [[only]]"
_ISC_END = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_AUTHOR_END = _ISC_END.replace("the author", "{{1..6}}")


def _header(name: str, label: str, versions: tuple[str, ...]) -> dict[str, str]:
    """The customary header of a free software licence, a template for each version."""
    lead = "{{1..6}} is free software you can redistribute it and or modify it "
    return {f"{label}-{v}-header": lead + _FREE.format(name, v.replace(".", " ").removesuffix(" 0")) + " [[0]] " + _LATER for v in versions}


TEMPLATES = {
    "gpl-2.0-notice": "[[this {{1..3}} is]] licensed under the gnu general public license [[as published by the free software foundation]] version 2 [[0]] [[of the license]] [[or [[at your option]] any later version]]",
    "gpl-3.0-notice": "[[this {{1..3}} is]] licensed under the gnu general public license [[as published by the free software foundation]] version 3 [[0]] [[of the license]] [[or [[at your option]] any later version]]",
    **_header("gnu general public license", "gpl", ("1.0", "2.0", "3.0")),
    **_header("gnu lesser general public license", "lgpl", ("2.1", "3.0")),
    **_header("gnu library general public license", "lgpl", ("2.0",)),
    **_header("gnu affero general public license", "agpl", ("3.0",)),
    "apache-2.0-notice": "licensed under the apache license version 2 0 [[the license [[you may not use this file except in compliance with the license]]]]",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[https]] [[http]] [[www]] apache org licenses license 2 0 [[html]] [[txt]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "[[this {{1..3}} is]] {{1..1:released|licensed|distributed|available}} under the [[terms of the]] mit license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{1..10}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-0": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{1..10}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies {_AUTHOR_END}",
    "0bsd": f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted {_AUTHOR_END}",
    "bsd-2-clause": f"{_BSD} {_AS_IS}",
    "bsd-3-clause": f"{_BSD} [[3]] neither the name of {_HOLDER} nor the names of {{{{1..4}}}} contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[https]] [[http]] [[www]] mozilla org mpl 2 0",
    "epl-2.0-header": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at [[https]] [[http]] [[www]] eclipse org legal epl 2 0",
    "cc0-1.0-notice": "to the extent possible under law {{1..8}} has waived all copyright and related or neighboring rights to {{1..8}}",
    "cc-by-notice": "licensed under [[a]] [[creative commons]] cc by {{1..2:[0-9]+}}",
    "cc-by-sa-notice": "licensed under [[a]] [[creative commons]] cc by sa {{1..2:[0-9]+}}",
    "cc-by-nc-notice": "licensed under [[a]] [[creative commons]] cc by nc {{1..2:[0-9]+}}",
    "cc-by-nd-notice": "licensed under [[a]] [[creative commons]] cc by nd {{1..2:[0-9]+}}",
}

_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\.\.(\d+)(?::([^}]*))?\}\}|[^\s\[\]{}]+")
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass
class Automaton:
    """States 0..last; `step[s]` holds (what, next): what is a word, a pattern or None for any word."""

    step: list[list[tuple]] = field(default_factory=lambda: [[]])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    last: int = 0

    def _new(self) -> int:
        self.step.append([])
        self.free.append(set())
        return len(self.step) - 1

    def close(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return seen

    def starts(self) -> tuple[set[bytes], bool]:
        """The words that can come first, and whether some other word can."""
        what = [w for s in self.close({0}) for w, _ in self.step[s]]
        return {w for w in what if isinstance(w, bytes)}, any(not isinstance(w, bytes) for w in what)

    def longest(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted run that begins at `at`, or -1."""
        states, end = self.close({0}), -1
        while True:
            if self.last in states:
                end = at
            if at >= len(words) or not states:
                return end
            w, on = words[at], set()
            for s in states:
                for what, t in self.step[s]:
                    if what is None or what == w or (not isinstance(what, bytes) and what.fullmatch(w)):
                        on.add(t)
            states, at = self.close(on), at + 1


def compile_template(text: str) -> Automaton:
    """The automaton of a template; unbalanced markup raises ValueError."""
    a, at, open_ = Automaton(), 0, []
    for m in _MARK.finditer(text):
        if m[0] == "[[":
            open_.append(at)
        elif m[0] == "]]":
            if not open_:
                raise ValueError("]] without [[")
            end = a._new()
            a.free[at].add(end)
            a.free[open_.pop()].add(end)
            at = end
        elif m[1]:
            low, high = int(m[1]), int(m[2])
            what = re.compile(m[3].encode()) if m[3] else None
            states = [at]
            for _ in range(high):
                states.append(a._new())
                a.step[states[-2]].append((what, states[-1]))
            end = a._new()
            for s in states[low:]:
                a.free[s].add(end)
            at = end
        else:
            nxt = a._new()
            a.step[at].append((m[0].lower().encode(), nxt))
            at = nxt
    if open_:
        raise ValueError("[[ without ]]")
    a.last = at
    return a


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES):
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.automata = {k: compile_template(t) for k, t in templates.items()}
        self.first: dict[bytes, list] = {}
        self.always = []
        for label, a in self.automata.items():
            words, other = a.starts()
            for w in words:
                self.first.setdefault(w, []).append((label, a))
            if other:
                self.always.append((label, a))
        self.need = {min((w for w in ws), key=lambda w: (-len(w), w)) for ws, _ in self.phrases}
        # A template can only match where all words that no region lets out stand.
        self.must = {label: self._mandatory(t) for label, t in templates.items()}

    @staticmethod
    def _mandatory(template: str) -> set[bytes]:
        depth, out = 0, set()
        for m in _MARK.finditer(template):
            depth += (m[0] == "[[") - (m[0] == "]]")
            if not depth and m[0] != "]]" and not m[1]:
                out.add(m[0].lower().encode())
        return out

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_WORDS).split()
        have = None
        places, spans = [], []
        if not self.need.isdisjoint(words):
            for ws, label in self.phrases:
                i = -1
                try:
                    while True:
                        i = words.index(ws[0], i + 1)
                        if words[i : i + len(ws)] == ws:
                            places.append((i, i + len(ws), label))
                except ValueError:
                    pass
        for label, must in self.must.items():
            if not must or next(iter(must)) in words:
                have = have if have is not None else set(words)
                if must <= have:
                    spans += self._find(label, words)
        base = sorted({label for _, _, label in places})
        covered: set[int] = set()
        for a, b, _ in places + spans:
            covered.update(range(a, b))
        starts = [p[0] for p in places]
        return (
            len(words), len(places), min(starts) if starts else None, max(starts) if starts else None,
            ",".join(base), ",".join(sorted({*base, *(s[2] for s in spans)})),
            len(covered) / len(words) if words else 0.0, sorted(spans),
        )

    def _find(self, label: str, words: list[bytes]) -> list[tuple[int, int, str]]:
        a, out, i = self.automata[label], [], 0
        first, other = a.starts()
        while i < len(words):
            end = a.longest(words, i) if other or words[i] in first else -1
            if end > i:
                out.append((i, end, label))
                i = end
            else:
                i += 1
        return out


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<first:long,past:long,label:string>>"
)


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
) -> DataFrame:
    """One row per document: base phrases, accepted templates (word spans) and their share.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A template is
    accepted where a run of words passes its automaton: mandatory words must match
    exactly, optional regions may be absent, replaceable ones take any words of the
    stated number; of runs from one start the longest counts, and runs of one template
    do not overlap.  `score` is the share of words in base phrases or accepted runs.
    Null and empty texts have no words and score 0; a null id is given back as null.
    Repeated rows are each scanned; extra columns are not read; an empty table gives an
    empty result.  Templates with a replaceable region at their start are tried at every word
    of the (few) texts that hold all their mandatory words.
    """

    def run(batches):
        scanner = Scanner(phrases, templates)
        for b in slices(batches):
            rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            spans = pa.array(
                [[{"first": a, "past": e, "label": k} for a, e, k in r[7]] for r in rows],
                pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("label", pa.string())])),
            )
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, spans], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
