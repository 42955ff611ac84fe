"""License scans (1): a positional rare-token index over licence templates.

The index maps each word of the templates to postings (template, position). How rare a word is comes
from the corpus itself: one pass counts, for the words of the index, the documents that hold them.
A file is looked up by the highest-IDF words that it has itself of a template: each of their places
says, by the word's postings, where the template would begin; beginnings on which enough of these words
agree are candidates, and a candidate counts when a mandatory key phrase of the template stands, word
by word, near its place. Templates of which a file lacks all key phrases' words aren't looked up. The
asked-for phrases are templates whose key phrase is the whole, so all their places are found.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import batches, column, texts

#: Words over bytes, A-Z already in lower case: digits, letters and all that isn't ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Rare words of a file by which a template is looked up, and the share of them that must agree on its beginning.
ANCHORS, AGREE = 6, 0.5
#: Words by which a place may be off, in templates longer than a phrase.
SLACK = 4


@dataclass(frozen=True)
class Template:
    """label; words; keys: mandatory phrases, one of which must stand at its place; phrase: the whole must stand as it is."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    phrase: bool = False
    base: bool = False


# The phrases and labels that are asked for.
BASE = (
    Template("mit", "mit license", phrase=True, base=True),
    Template("apache", "apache license", phrase=True, base=True),
    Template("gpl", "general public license", phrase=True, base=True),
)
# Wording of public licences and notices, and the phrases each must show.
MORE = (
    Template("agpl", "gnu affero general public license", phrase=True),
    Template("lgpl", "gnu lesser general public license", phrase=True),
    Template("cc-by", "licensed under cc by 4 0", phrase=True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", phrase=True),
    Template("cc-by-sa", "licensed under cc by sa 4 0", phrase=True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-notice", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ("distributed on an as is basis",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    Template("mit-notice", "released under the mit license", ("under the mit license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
)
TEMPLATES = BASE + MORE


@dataclass
class Index:
    """Positions of each template's words, the words by falling IDF, and its key phrases."""

    templates: tuple[Template, ...]
    idf: dict[bytes, float]
    words: list[list[bytes]] = field(default_factory=list)
    postings: list[dict[bytes, list[int]]] = field(default_factory=list)
    rare: list[list[bytes]] = field(default_factory=list)
    keys: list[list[tuple[int, list[bytes]]]] = field(default_factory=list)
    must: list[list[frozenset[bytes]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for template in self.templates:
            words = template.text.encode().split()
            self.words.append(words)
            self.postings.append({w: [p for p, x in enumerate(words) if x == w] for w in words})
            self.rare.append(sorted(set(words), key=lambda w: (-self.idf[w], w)))
            own = [template.text] if template.phrase else list(template.keys)
            self.keys.append([(_at(words, k.encode().split()), k.encode().split()) for k in own])
            self.must.append([frozenset(k) for _, k in self.keys[-1]])
        self.vocabulary = frozenset(w for words in self.words for w in words)

    def find(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, coverage) of every place; start: the first word of the phrase, or of the key phrase."""
        have = self.vocabulary.intersection(words)
        anchors: dict[int, list[bytes]] = {}
        for t, template in enumerate(self.templates):
            if any(key <= have for key in self.must[t]):
                # one word serves for a phrase, all of which must stand there
                anchors[t] = [w for w in self.rare[t] if w in have][: 1 if template.phrase else ANCHORS]
        if not anchors:
            return []
        of = {w: [t for t, own in anchors.items() if w in own] for own in anchors.values() for w in own}
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for at, w in enumerate(words):
            for t in of.get(w, ()):
                for p in self.postings[t][w]:
                    votes[t, at - p].add(w)
        out: dict[tuple[int, int], float] = {}
        for (t, begin), mine in votes.items():
            phrase = self.templates[t].phrase
            slack, needed = (0, 1) if phrase else (SLACK, math.ceil(min(ANCHORS, len(self.rare[t])) * AGREE))
            near = set(mine)
            if len(near) < needed:
                for d in range(1, slack + 1):
                    near |= votes.get((t, begin + d), set()) | votes.get((t, begin - d), set())
            if len(near) < needed:
                continue
            for p, key in self.keys[t]:
                for d in range(-slack, slack + 1):
                    s = begin + p + d
                    if s >= 0 and words[s : s + len(key)] == key:
                        out[t, s] = max(out.get((t, s), 0.0), self._coverage(t, s - p, words))
        return [(t, s, c) for (t, s), c in sorted(out.items(), key=lambda x: (x[0][1], x[0][0]))]

    def _coverage(self, t: int, begin: int, words: list[bytes]) -> float:
        """IDF-weighted share of the template's words that stand at their places (give or take the slack)."""
        slack, have, total = 0 if self.templates[t].phrase else SLACK, 0.0, 0.0
        for p, w in enumerate(self.words[t]):
            weight = self.idf[w] + 1e-9
            total += weight
            at = begin + p
            have += weight * (w in words[max(0, at - slack) : max(0, at + slack + 1)])
        return have / total


def _at(words: list[bytes], key: list[bytes]) -> int:
    return next(p for p in range(len(words)) if words[p : p + len(key)] == key)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # of bytes: A-Z only


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the templates stands, and the number of documents. The answer has a row per word of the templates at most."""
    vocabulary = frozenset(w for t in templates for w in t.text.encode().split())

    def count(part: pa.RecordBatch) -> dict:
        n: dict[bytes, int] = defaultdict(int)
        for t in texts(part, "text_"):
            for w in vocabulary.intersection(words_of(t)):
                n[w] += 1
        n[b""] = part.num_rows
        return {"word": [w.decode() for w in n], "n": list(n.values())}

    rows = docs.select(docs[text_col].cast("string").alias("text_"))
    got = {r["word"].encode(): r["n"] for r in batches(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = got.pop(b"", 0)
    return got, total


def build_index(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> Index:
    counts, total = document_frequencies(docs, templates, text_col)
    words = {w for t in templates for w in t.text.encode().split()}
    return Index(templates, {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in words})


def license_scan(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, and matches, an array of (label, base, start, coverage) by start.

    Words are counted from 0. Null and empty texts have no words and no matches. Repeated rows are
    scanned one by one. Other columns are left out. An empty table gives an empty result. Without an index, one is built with the document
    frequencies of docs (a first pass over all texts; a few hundred counts reach the driver).
    """
    index = index or build_index(docs, text_col=text_col)
    sent = docs.sparkSession.sparkContext.broadcast((index.templates, index.idf))  # of the templates' size
    held: dict[str, Index] = {}

    def scan(part: pa.RecordBatch) -> dict:
        if "index" not in held:
            held["index"] = Index(*sent.value)
        own, n, out = held["index"], [], []
        for t in texts(part, "text_"):
            words = words_of(t)
            n.append(len(words))
            out.append([{"label": own.templates[k].label, "base": own.templates[k].base, "start": s, "coverage": c} for k, s, c in own.find(words)])
        return {"doc_id": column(part, "id_"), "n_words": n, "matches": out}

    rows = docs.select(docs[id_col].cast("long").alias("id_"), docs[text_col].cast("string").alias("text_"))
    return batches(rows, scan, "doc_id long, n_words long, matches array<struct<label:string,base:boolean,start:long,coverage:double>>")


def license_digest(scanned: DataFrame) -> DataFrame:
    """From license_scan's rows: n_base, first_word, last_word and base_labels of the base phrases; labels of all; score.

    score is 0 without a match, 0.5 with phrases only, and up to 1 by the best coverage of a longer template.
    """
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda m: m["label"]))), ",")
    phrases = [t.label for t in TEMPLATES if t.phrase]
    best = F.array_max(F.transform(F.filter("matches", lambda m: ~m["label"].isin(phrases)), lambda m: m["coverage"]))
    score = F.when(F.size("matches") == 0, 0.0).otherwise(0.5 + 0.5 * F.coalesce(best, F.lit(0.0)))
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"), F.least(score, F.lit(1.0)).alias("score"))
