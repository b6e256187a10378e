"""License scans by template markup.

A template is wording with optional regions ``<<opt>> ... <<end>>`` (they may nest) and
replaceable ones: ``<<var:N>>`` (zero to N words of any wording) and ``<<var:N:a|b>>`` (zero
to N of the listed words). Both compile into a token automaton: an arc per mandatory word,
an empty arc around an optional region, N skippable arcs of any or of the listed words for a
replaceable one. Templates hold the whole wording of a license or of its notice. A text is accepted where the automaton
reads consecutive words with the mandatory wording exactly as given; case, punctuation
and white space between words do not count.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. Base
phrases are reported as they stand, templates add labels. Null is the empty text, without
words: no places, empty labels, score 0. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillward.llm import common

#: Base phrases and labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Parts of licenses that several have (fixed wording).
BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<var:1:1|a|i>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<var:1:2|b|ii>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_THIRD = "<<var:1:3|c|iii>> neither the name of <<var:12>> nor the names of <<var:3:its|the|their|other>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_TAIL = "this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var:12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
ISC_TAIL = "the software is provided as is and <<var:8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:8>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
USE = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"

#: Template markup by label: notices and whole texts of well-known licenses (fixed wording).
TEMPLATES = {
    "0bsd": f"{USE} {ISC_TAIL}",
    "apache-2.0": "licensed under the apache license<<opt>> version<<end>> 2 0",
    "apache-notice": "you may not use this file except in compliance with the license<<opt>> you may obtain a copy of the license at <<var:12>><<end>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause": f"{BSD_HEAD} {BSD_TAIL}",
    "bsd-3-clause": f"{BSD_HEAD} {BSD_THIRD} {BSD_TAIL}",
    "cc-by-nc": "licensed under<<opt>> a<<end>><<opt>> the<<end>> cc by nc<<opt>> <<var:2>><<end>>",
    "cc-by-nc-sa": "licensed under<<opt>> a<<end>><<opt>> the<<end>> cc by nc sa<<opt>> <<var:2>><<end>>",
    "cc-by-sa": "licensed under<<opt>> a<<end>><<opt>> the<<end>> cc by sa<<opt>> <<var:2>><<end>>",
    "gpl-2.0": "licensed under the gnu general public license<<opt>> version<<end>> 2",
    "gpl-3.0": "licensed under the gnu general public license<<opt>> version<<end>> 3",
    "gpl-notice": "this <<var:4>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation<<opt>> either<<end>> version <<var:1:2|3>> of the license<<opt>> or at your option any later version<<end>> this <<var:4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "isc": f"{USE} provided that the above copyright notice and this permission notice appear in all copies {ISC_TAIL}",
    "mit-notice": "<<opt>>released <<end>><<opt>>licensed <<end>>under the<<opt>> terms of the<<end>> mit license",
    "mit-text": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice<<opt>> including the next paragraph<<end>> shall be included in all copies or substantial portions of the software {AS_IS}",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<var:1:http|https>> mozilla org mpl 2 0",
    "unlicense": f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {AS_IS}<<opt>> for more information please refer to <<var:1:http|https>> unlicense org<<end>>",
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_keys(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return common.word_hashes(raw, np.array([0, len(raw)]), _WORD, _FOLD)[0]


def parse(markup: str) -> list:
    """Template markup as a tree: a word, ("var", N, words or ()), or ("opt", [...])."""
    stack: list[list] = [[]]
    for m in re.finditer(r"<<opt>>|<<end>>|<<var:(\d+)(?::([0-9a-z|]+))?>>|[0-9a-z]+", markup):
        if m[0] == "<<opt>>":
            stack.append([])
        elif m[0] == "<<end>>":
            done = stack.pop()
            stack[-1].append(("opt", done))
        elif m[1]:
            stack[-1].append(("var", int(m[1]), tuple(m[2].split("|")) if m[2] else ()))
        else:
            stack[-1].append(m[0])
    if len(stack) != 1:
        raise ValueError(f"unbalanced template markup: {markup}")
    return stack[0]


class TokenAutomaton:
    """Automaton of one template; its state sets are determinised as texts ask for them."""

    def __init__(self, markup: str):
        self.words: list[dict[int, int]] = [{}]  # state -> word key -> state
        self.free: list[int] = [-1]  # state -> state after any word
        self.empty: list[list[int]] = [[]]
        self.last = self._build(parse(markup), 0)
        self.sets = [self._closure({0})]
        self.number = {self.sets[0]: 0}
        self.moves: list[dict[int, int]] = [{}]
        self.first = {k for s in self.sets[0] for k in self.words[s]}
        if any(self.free[s] >= 0 for s in self.sets[0]) or self.last in self.sets[0]:
            raise ValueError("a template must begin with a mandatory or optional word")

    def _new(self) -> int:
        self.words.append({})
        self.free.append(-1)
        self.empty.append([])
        return len(self.words) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, str):
                to = self._new()
                self.words[at][int(word_keys(part)[0])] = to
                at = to
            elif part[0] == "var":
                end = self._new()
                for _ in range(part[1]):
                    to = self._new()
                    self.empty[at].append(end)
                    if part[2]:
                        self.words[at] |= {int(word_keys(w)[0]): to for w in part[2]}
                    else:
                        self.free[at] = to
                    at = to
                self.empty[at].append(end)
                at = end
            else:
                fork, end = self._new(), self._new()
                self.empty[at] += [fork, end]
                self.empty[self._build(part[1], fork)].append(end)
                at = end
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def accepts_at(self, keys: np.ndarray, start: int) -> int:
        """End of the shortest accepted run of words from start, or -1."""
        state = 0
        for i in range(start, len(keys)):
            key = int(keys[i])
            to = self.moves[state].get(key)
            if to is None:
                now = self.sets[state]
                after = {self.words[s][key] for s in now if key in self.words[s]} | {self.free[s] for s in now if self.free[s] >= 0}
                after = self._closure(after)
                to = self.number.setdefault(after, len(self.sets))
                if to == len(self.sets):
                    self.sets.append(after)
                    self.moves.append({})
                if len(self.moves[state]) < 10_000:
                    self.moves[state][key] = to
            state = to
            if not self.sets[state]:
                return -1
            if self.last in self.sets[state]:
                return i + 1
        return -1


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.automata = {label: TokenAutomaton(x) for label, x in templates.items()}
        self.phrases = [(label, word_keys(p)) for p, label in PHRASES.items()]
        self.starts = np.array(sorted({k for a in self.automata.values() for k in a.first} | {int(p[0]) for _, p in self.phrases}), np.uint64)

    def scan(self, keys: np.ndarray) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
        """Base places (start, label) and template matches (start, end, label) of a text's words."""
        at = np.minimum(np.searchsorted(self.starts, keys), len(self.starts) - 1)
        base, found = [], []
        for i in np.flatnonzero(self.starts[at] == keys).tolist():
            for label, phrase in self.phrases:
                if keys[i] == phrase[0] and np.array_equal(keys[i : i + len(phrase)], phrase):
                    base.append((i, label))
            for label, auto in self.automata.items():
                if int(keys[i]) in auto.first:
                    end = auto.accepts_at(keys, i)
                    if end > 0:
                        found.append((i, end, label))
        return base, found


def license_scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_templates, matches).

    score: 1 when a template accepts, 0.5 when only a base phrase stands, else 0.
    matches: array of (start, end, label), word positions, end exclusive.
    """
    common.ready(spark)
    templates = TEMPLATES if templates is None else templates

    def rows(batches):
        scanner = Scanner(templates)
        for batch in batches:
            data, offsets = common.raw_bytes(batch.column("text"))
            out: list[tuple] = []
            for i, j in common.chunks(offsets):
                a = offsets[i]
                keys, row, _ = common.word_hashes(data[a : offsets[j]], offsets[i : j + 1] - a, _WORD, _FOLD)
                cut = np.searchsorted(row, np.arange(j - i + 1))
                for r in range(j - i):
                    mine = keys[cut[r] : cut[r + 1]]
                    base, found = scanner.scan(mine) if len(mine) else ([], [])
                    own = {x for _, x in base}
                    starts = [s for s, _ in base]
                    out.append((len(mine), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x for _, _, x in found})), 1.0 if found else 0.5 if base else 0.0, len({x for _, _, x in found}), [{"start": s, "end": e, "label": x} for s, e, x in found]))
            cols = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_templates", "matches"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(common.trimmed(rows), "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long, matches array<struct<start:long,end:long,label:string>>").withColumnRenamed("id", id_col)


def _regex(parts: list) -> str:
    out = ""
    for p in parts:
        out += f"{p} " if isinstance(p, str) else f"(?:(?:{'|'.join(p[2]) or '[^ ]+'}) ){{0,{p[1]}}}" if p[0] == "var" else f"(?:{_regex(p[1])})?"
    return out


def oracle() -> str:
    """DuckDB SQL over documents; template markup becomes one pattern over joined words."""
    places = []
    for phrase, label in PHRASES.items():
        w = phrase.split()
        cond = " and ".join(f"w[i + {k}] = '{x}'" if k else f"w[i] = '{x}'" for k, x in enumerate(w))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {cond}), lambda i: {{'p': i - 1, 'l': '{label}'}})")
    found = [f"case when regexp_matches(j, ' {_regex(parse(m))}') then ['{label}'] else [] end" for label, m in TEMPLATES.items()]
    base = "coalesce(list_transform(b, lambda x: x.l), [])"
    return rf"""
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
 p as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' j, {' || '.join(places)} b from t),
 f as (select *, {' || '.join(found)} f from p)
select doc_id, len(w)::bigint n_words, len(b)::bigint n_base, list_min(list_transform(b, lambda x: x.p))::bigint first_word, list_max(list_transform(b, lambda x: x.p))::bigint last_word,
 coalesce(array_to_string(list_sort(list_distinct({base})), ','), '') base_labels, coalesce(array_to_string(list_sort(list_distinct({base} || f)), ','), '') labels,
 case when len(f) > 0 then 1.0 when len(b) > 0 then 0.5 else 0.0 end::double score, len(f)::bigint n_templates from f"""
