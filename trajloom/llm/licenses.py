"""License scans: base phrases, and template mark-up compiled into token automata.

A template is a line of words in which ``[...]`` marks wording that may be missing and
``{least:most}`` a place that any words may fill. It compiles into a nondeterministic
automaton over words; a text matches where the automaton accepts a run of its words, which
means that the mandatory wording stands there word for word. Automata start only at words
that can begin a template, and all texts of a batch are cut into words as one byte array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trajloom.llm.common import batch_words, slices, table, text_bytes

#: Phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public wordings of licenses and license notices, lower case, without punctuation.
TEMPLATES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0 [the license] [you may not use this file except in compliance with the license] [you may obtain a copy of the license at {0:8}]",
    "apache-2.0-header": "you may not use this file except in compliance with the license you may obtain a copy of the license at {0:8} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "cc-by-notice": "[this work is] licensed under [a] [the] [creative commons] cc by [nc] [sa] [nd] [{1:1} 0] [{0:2} license]",
    "gpl-notice": "[this {1:3} is] licensed under the gnu general public license [version {1:1}] [or any later version] [or at your option any later version]",
    "gpl-header": "[this program is free software] you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {1:1} of the license or [at your option] any later version",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-notice": "[this {1:3} is] released under the [terms of the] mit license",
    "mit-text": "[mit license] [copyright {0:20}] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {1:8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "reserved-notice": "[copyright {0:12}] all rights reserved",
}


@dataclass
class Automaton:
    """States are numbers; ``steps`` maps (state, word) to states, ``any_steps`` takes any
    word, ``free`` takes none; ``final`` holds the label of an accepting state."""

    steps: dict[tuple[int, str], set[int]] = field(default_factory=dict)
    any_steps: dict[int, set[int]] = field(default_factory=dict)
    free: dict[int, set[int]] = field(default_factory=dict)
    final: dict[int, str] = field(default_factory=dict)
    size: int = 1

    def new(self) -> int:
        self.size += 1
        return self.size - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for state in self.free.get(todo.pop(), ()):
                if state not in found:
                    found.add(state)
                    todo.append(state)
        return frozenset(found)


def compile_templates(templates: dict[str, str]) -> Automaton:
    """One automaton that accepts each template under its label. It starts in state 0."""
    automaton = Automaton()
    for label, text in templates.items():
        parts = re.findall(r"\[|\]|\{\d+:\d+\}|[^\s\[\]{}]+", text)
        state = automaton.new()
        automaton.free.setdefault(0, set()).add(state)
        opened: list[int] = []
        for part in parts:
            if part == "[":
                opened.append(state)
            elif part == "]":
                automaton.free.setdefault(opened.pop(), set()).add(state_end := automaton.new())
                automaton.free.setdefault(state, set()).add(state_end)
                state = state_end
            elif part[0] == "{":
                least, most = map(int, part[1:-1].split(":"))
                end = automaton.new()
                for i in range(most):
                    if i >= least:
                        automaton.free.setdefault(state, set()).add(end)
                    automaton.any_steps.setdefault(state, set()).add(after := automaton.new())
                    state = after
                automaton.free.setdefault(state, set()).add(end)
                state = end
            else:
                automaton.steps.setdefault((state, part), set()).add(after := automaton.new())
                state = after
        if opened:
            raise ValueError(f"{label}: a region is not closed")
        automaton.final[state] = label
    return automaton


class Scanner:
    """Runs the automaton over word numbers: 0 for words that no template or phrase has."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automaton = compile_templates(templates)
        words = {word for _, word in self.automaton.steps} | {w for p in phrases for w in p.split()}
        ordered = sorted(words)
        hashes, _ = batch_words([w.encode() for w in ordered])
        by_hash = np.argsort(hashes)
        self.hashes, self.numbers = hashes[by_hash], by_hash + 1
        number = {w: i + 1 for i, w in enumerate(ordered)}
        self.phrases = [(np.array([number[w] for w in p.split()]), label) for p, label in phrases.items()]
        self.steps = {}
        for (state, word), after in self.automaton.steps.items():
            self.steps.setdefault(state, {}).setdefault(number[word], set()).update(after)
        self.start = self.automaton.closure({0})
        self.memory: dict[tuple[frozenset[int], int], frozenset[int]] = {}
        if any(state in self.automaton.any_steps for state in self.start):
            raise ValueError("a template must begin with wording")
        self.anchors = np.array(sorted({w for state in self.start for w in self.steps.get(state, ())}))

    def number(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)

    def step(self, states: frozenset[int], word: int) -> frozenset[int]:
        key = (states, word)
        if key not in self.memory:
            after: set[int] = set()
            for state in states:
                after |= self.automaton.any_steps.get(state, set()) | self.steps.get(state, {}).get(word, set())
            self.memory[key] = self.automaton.closure(after)
        return self.memory[key]

    def longest(self, words: np.ndarray, start: int, end: int) -> tuple[int, set[str]]:
        """End of the longest match that begins at ``start``, and the labels of all that begin there."""
        states, best, labels = self.start, start, set()
        for i in range(start, end):
            states = self.step(states, int(words[i]))
            if not states:
                break
            found = {self.automaton.final[s] for s in states if s in self.automaton.final}
            if found:
                best, labels = i + 1, labels | found
        return best, labels

    def scan(self, texts: list[bytes]) -> list[tuple]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score of each text."""
        hashes, bounds = batch_words(texts)
        words = self.number(hashes)
        text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        base: list[list[tuple[int, str]]] = [[] for _ in texts]
        for phrase, label in self.phrases:
            at = np.flatnonzero(words[: len(words) - len(phrase) + 1] == phrase[0]) if len(words) >= len(phrase) else np.zeros(0, int)
            for k in range(1, len(phrase)):
                at = at[words[at + k] == phrase[k]]
            at = at[text_of[at] == text_of[at + len(phrase) - 1]] if len(at) else at
            for i in at.tolist():
                base[text_of[i]].append((i - int(bounds[text_of[i]]), label))
        anchors = np.flatnonzero(np.isin(words, self.anchors))
        first = np.searchsorted(anchors, bounds)
        out = []
        for i in range(len(texts)):
            start, end = int(bounds[i]), int(bounds[i + 1])
            done, covered, found = start, 0, set()
            for anchor in anchors[first[i] : first[i + 1]].tolist():
                # Inside an earlier match too: another template may stand there.
                stop, labels = self.longest(words, anchor, end)
                covered, done, found = covered + max(stop - max(anchor, done), 0), max(stop, done), found | labels
            places = [p for p, _ in base[i]]
            own = {label for _, label in base[i]}
            score = covered / (end - start) if end > start else 0.0
            out.append((end - start, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | found)), score))
        return out


FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]


def scan_licenses(df: DataFrame, keep: list[str], templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """The kept columns and the findings in each row's ``text``.

    ``score`` is the share of a text's words that accepted templates cover: 1 for a text that
    is nothing but a license. From each word that can begin a template all matches give their
    labels, also inside other matches, and the longest covers; a word covered twice counts once. A text that is null,
    empty or without words has no findings and score 0.
    """
    templates, phrases = TEMPLATES if templates is None else templates, BASE if phrases is None else phrases
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for part in slices(batch, "text"):
                columns = zip(*scanner.scan(text_bytes(part.column("text"))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(columns, TYPES))], names=[*keep, *FIELDS])

    rows = df.select(*keep, *[] if "text" in keep else ["text"])
    return rows.mapInArrow(run, f"{schema}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def license_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; null and repeated ids and further columns change nothing."""
    return scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
