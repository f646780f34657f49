"""License scans by template markup.

A template is the wording of a license or notice with two kinds of marked regions, written as in the public SPDX
matching templates: ``<<beginOptional>> ... <<endOptional>>`` may be left out, and
``<<var;name="x";words="0..8">>`` stands for that many words of any kind. All other words are mandatory and must match
exactly. Each template is compiled to a nondeterministic automaton over words; all of them run at once as one automaton
that is made deterministic as far as texts ask for it. A text is accepted where a template's mandatory wording
matches from its first word to its last.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null texts have no words. Matches of one template do not
overlap: the longest one from a place counts, and the search for the same template goes on behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm.common import WORD_BYTES, documents, id_and_text, text_bytes

#: Fixed phrases: each place where these words stand in a row counts.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices and license texts with their labels. The wording is that of the public licenses.
TEMPLATES = {
    "apache-2.0-notice": (
        "licensed under <<beginOptional>>the<<endOptional>> apache license "
        "<<beginOptional>>version<<endOptional>> 2.0 <<beginOptional>>the license<<endOptional>>"
    ),
    "cc-by-notice": (
        "<<beginOptional>>this <<var;name=\"work\";words=\"1..2\">> is<<endOptional>> licensed under "
        "<<beginOptional>>a<<endOptional>> cc by <<var;name=\"version\";words=\"0..4\">> <<beginOptional>>international<<endOptional>> license"
    ),
    "cc-by-nc-4.0-notice": "licensed under <<beginOptional>>a<<endOptional>> cc by nc <<beginOptional>>sa<<endOptional>> 4.0",
    "gpl-3.0-notice": (
        "<<beginOptional>>this <<var;name=\"work\";words=\"1..2\">> is<<endOptional>> licensed under the gnu general public license "
        "version 3 <<beginOptional>>or <<beginOptional>>at your option<<endOptional>> any later version<<endOptional>>"
    ),
    "mit-notice": "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
        "software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> "
        "shall be included in all copies or substantial portions of the software"
    ),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "bsd-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer"
    ),
}

_MARK = re.compile(r'<<(beginOptional|endOptional|var;name="[^"]*";words="(\d+)\.\.(\d+)")>>')
OTHER = 0


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class Automaton:
    """All templates as one automaton over word numbers; states are made deterministic when first met."""

    def __init__(self, templates: dict[str, str], vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.steps: list[list[tuple[int | None, int]]] = []  # by state: word (None: any) and the state after it
        self.free: list[list[int]] = []  # by state: states reached without a word
        self.accepts: dict[int, str] = {}
        self.known: dict[tuple[frozenset, int], frozenset] = {}
        starts = []
        for label, template in templates.items():
            begin, end, least = self._compile(template)
            if not least:
                raise ValueError(f"template {label} has no mandatory word")
            starts.append(begin)
            self.accepts[end] = label
        self.start = self._closed(starts)
        self.first = {w for s in self.start for w, _ in self.steps[s]}
        if None in self.first:
            raise ValueError("a template must not begin with a replaceable region")

    def _state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _compile(self, template: str) -> tuple[int, int, int]:
        begin = at = self._state()
        opened, mandatory, place = [], 0, 0
        for mark in [*_MARK.finditer(template), None]:
            for w in words_of(template[place : mark.start() if mark else len(template)]):
                after = self._state()
                self.steps[at].append((self.vocabulary.setdefault(w, len(self.vocabulary) + 1), after))
                at, mandatory = after, mandatory + (not opened)
            if mark is None:
                break
            place = mark.end()
            if mark[1] == "beginOptional":
                opened.append(at)
            elif mark[1] == "endOptional":
                if not opened:
                    raise ValueError(f"an optional region ends that never began: {template}")
                skip, after = opened.pop(), self._state()
                self.free[at].append(after)
                self.free[skip].append(after)
                at = after
            else:
                least, most = int(mark[2]), int(mark[3])
                states = [at]
                for _ in range(most):
                    states.append(self._state())
                    self.steps[states[-2]].append((None, states[-1]))
                end = self._state()
                for s in states[least:]:
                    self.free[s].append(end)
                at = end
        if opened:
            raise ValueError(f"an optional region never ends: {template}")
        return begin, at, mandatory

    def _closed(self, states) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def after(self, state: frozenset, word: int) -> frozenset:
        if (found := self.known.get((state, word))) is None:
            found = self._closed([t for s in state for w, t in self.steps[s] if w is None or w == word])
            self.known[state, word] = found
        return found

    def longest(self, words: np.ndarray, at: int) -> dict[str, int]:
        """Labels accepted from ``at`` on, each with the end of its longest match."""
        state, out = self.start, {}
        for i in range(at, len(words)):
            state = self.after(state, int(words[i]))
            if not state:
                break
            for s in state:
                if (label := self.accepts.get(s)) is not None:
                    out[label] = i + 1
        return out


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = Automaton(templates, self.vocabulary)
        self.phrases = []
        for phrase, label in phrases.items():
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(phrase)]
            self.phrases.append((numbers, label))
        self.first = np.array(sorted(self.automaton.first))
        # a text without any of these has no match: the longest mandatory word of each template, and of each phrase
        needed = [max(words_of(p), key=len) for p in phrases]
        for template in templates.values():
            flat, depth = [], 0
            for part in re.split(r"(<<[^>]*>>)", template):
                depth += (part == "<<beginOptional>>") - (part == "<<endOptional>>")
                flat += words_of(part) if not depth and not part.startswith("<<") else []
            needed.append(max(flat, key=len))
        self.needed = sorted(set(needed))

    def numbers(self, pieces: Iterator[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.concatenate([np.zeros(0, np.int32), *(np.fromiter((get(w, OTHER) for w in p.split()), np.int32) for p in pieces)])

    def scan(self, text: bytes) -> tuple:
        spaced = text.translate(WORD_BYTES)
        if not any(w in spaced for w in self.needed):
            return sum(len(p.split()) for p in _pieces(spaced)), [], [], []
        words = self.numbers(_pieces(spaced))
        base, starts, ends = [], [], []
        for numbers, label in self.phrases:
            places = np.ones(max(len(words) - len(numbers) + 1, 0), bool)
            for i, w in enumerate(numbers):
                places &= words[i : i + len(places)] == w
            for p in np.flatnonzero(places).tolist():
                base.append(label)
                starts.append(p)
                ends.append(p + len(numbers))
        found, free = [], {}
        for p in np.flatnonzero(np.isin(words, self.first)).tolist():
            for label, end in self.automaton.longest(words, p).items():
                if p >= free.get(label, 0):
                    found.append((label, p, end))
                    free[label] = end
        return len(words), list(zip(base, starts, ends, strict=True)), found, words


def _pieces(spaced: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """Parts of bounded size, cut between words."""
    at = 0
    while at < len(spaced):
        end = min(len(spaced), at + most)
        if end < len(spaced):
            cut = spaced.rfind(b" ", at, end)
            end = cut if cut > at else (spaced.find(b" ", end) + 1 or len(spaced))
        yield spaced[at:end]
        at = end


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_RESULT = (
    "doc_id long, n_words long, base array<struct<label:string,start:long,end:long>>, "
    "matches array<struct<label:string,start:long,end:long>>, covered long"
)


def _scan(templates, phrases):
    def of(batches):
        scanner = Scanner(templates, phrases)
        for batch in batches:
            n_words, base, matches, covered = [], [], [], []
            for text in text_bytes(batch.column(1)):
                n, found, whole, _ = scanner.scan(text)
                inside = set()
                for _, a, b in [*found, *whole]:
                    inside.update(range(a, b))
                n_words.append(n)
                base.append([{"label": x, "start": a, "end": b} for x, a, b in found])
                matches.append([{"label": x, "start": a, "end": b} for x, a, b in whole])
                covered.append(len(inside))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(base, _MATCH), pa.array(matches, _MATCH), pa.array(covered, pa.int64())],
                names=["doc_id", "n_words", "base", "matches", "covered"],
            )

    return of


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Places of phrases and of accepted templates in every text, as spans of words, and the number of words they cover.

    Columns: doc_id, n_words, base, matches (label, start, end: words from 0, end excluded), covered. A row for each row;
    texts are scanned where they are read, nothing is shuffled.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan(templates, phrases), _RESULT)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).selectExpr(
        "doc_id", "n_words", "cast(size(base) as bigint) as n_base",
        "array_min(transform(base, x -> x.start)) as first_word", "array_max(transform(base, x -> x.start)) as last_word",
        "array_join(array_sort(array_distinct(transform(base, x -> x.label))), ',') as base_labels",
        "array_join(array_sort(array_distinct(transform(concat(base, matches), x -> x.label))), ',') as labels",
        # a whole template is sure, a phrase alone is a hint
        "case when size(matches) > 0 then 1D when size(base) > 0 then 0.5D else 0D end as score",
    )


def pattern(template: str) -> str:
    """A template as a regular expression over words that are each followed by a blank."""
    out = ""
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<beginOptional>>":
            out += "(?:"
        elif part == "<<endOptional>>":
            out += ")?"
        elif part.startswith("<<var"):
            least, most = re.search(r'words="(\d+)\.\.(\d+)"', part).groups()
            out += f"(?:[^ ]+ ){{{least},{most}}}"
        else:
            out += "".join(f"{re.escape(w.decode())} " for w in words_of(part))
    return out


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The same with regular expressions over the joined words, for tests."""
    patterns = {label: re.compile(f"(?<= )(?={pattern(t)})") for label, t in TEMPLATES.items()}
    out = []
    for doc_id, text in rows:
        words = [w.decode() for w in words_of(text or "")]
        joined = " " + "".join(w + " " for w in words)
        base = [(label, i) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        labels = {x for x, _ in base}
        more = {label for label, p in patterns.items() if p.search(joined)}
        starts = [i for _, i in base]
        out.append((doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more))))
    return out
