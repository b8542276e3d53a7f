"""License scans by a positional rare-token index.

The templates are paragraphs and notices of licences, each with a label and a mandatory key phrase. A word's inverse
document frequency is taken over them. The index maps each anchor word to its postings, (template, position): a template's
words are taken as anchors from the rarest on until those left weigh less than the limit, so a template that reaches the
limit agrees in at least one of its anchors. In each document the anchors that occur are looked up; an anchor at document
position p and template position q proposes that the template starts at p - q, postings are intersected at that relative
position, and the share of inverse document frequency that agrees there is the template's score. A template is reported if
its score reaches the limit and its key phrase stands at its place. The phrases of the base rules are found through the
same word positions.

All of it is one projection over the scan: no shuffle, no Python. Index and templates are constants of the plan, some
kilobytes here, and grow with the number of licences, not with the data. Defined results: a null text is empty (no words,
no labels, score 0, first_word and last_word null); repeated rows are scanned one by one; extra columns are not read.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed values: (label, paragraph or notice, mandatory key phrase within it), as the licences have them.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "without warranties or conditions of any kind"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "must retain the above copyright notice"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "must reproduce the above copyright notice"),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization"),
    ("cc-by", "Licensed under CC BY 4.0", "cc by 4"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "attribution noncommercial 4 0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "attribution sharealike 4 0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gnu general public license"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gnu general public license"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "see the gnu general public license"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu general public license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "gnu lesser general public license"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3", "lesser general public"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "to deal in the software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "Released under the terms of the MIT License", "mit license"),
    ("mit", "This project is licensed under the MIT License. See the LICENSE file for details.", "mit license"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license v 2 0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "free and unencumbered software"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "in no event will the authors be held liable"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "permission is granted to anyone"),
)

#: What separates words: all ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class LicenseParams:
    """limit: least share of a template's weight that must agree."""

    limit: float = 0.8
    base_phrases: dict = field(default_factory=lambda: BASE_PHRASES)
    templates: tuple = TEMPLATES


def words_of(text: str) -> list[str]:
    """The words of a template, as the scan takes them from a document."""
    low = text.translate(str.maketrans(UPPER, UPPER.lower()))
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in low).split()


@dataclass(frozen=True)
class Index:
    """templates: words, weights (adding up to 1), place and words of the key phrase; postings by anchor word, rarest first."""

    templates: list[dict]
    postings: dict[str, list[tuple[int, int]]]


def build_index(p: LicenseParams) -> Index:
    notices = [(label, words_of(text), words_of(key)) for label, text, key in p.templates]
    frequency = Counter(w for _, words, _ in notices for w in set(words))
    idf = {w: math.log(1 + len(notices) / n) for w, n in frequency.items()}
    templates, postings = [], {}
    for t, (label, words, key) in enumerate(notices):
        total = sum(idf[w] for w in words)
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        templates.append({"label": label, "words": words, "weights": [idf[w] / total for w in words], "key": key, "key_at": at})
        left = 1.0
        for q in sorted(range(len(words)), key=lambda q, words=words: (-idf[words[q]], q)):
            if left < p.limit - 1e-9:
                break
            left -= idf[words[q]] / total
            postings.setdefault(words[q], []).append((t, q))
    return Index(templates, dict(sorted(postings.items(), key=lambda x: (-idf[x[0]], x[0]))))


def _constant(value, kind: str) -> Column:
    """A nested value as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _phrase_at(words: Column, start: Column, phrase: Column, length: Column) -> Column:
    return (start >= 0) & (F.slice(words, F.greatest(start, F.lit(0)) + 1, length) == phrase)


def scan(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the hits (label, start, score)."""
    index = build_index(params)
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, UPPER.lower())
    a = docs.select("doc_id", F.array_remove(F.split(low, SEPARATORS), "").alias("_l_words"))
    words = F.col("_l_words")

    phrases = {tuple(p.split()): label for p, label in params.base_phrases.items()}
    anchors = [*index.postings, *(w for w in {p[-1] for p in phrases} if w not in index.postings)]
    # Places of the anchors that occur: everything below works on these few places, not on all words.
    present = F.array_intersect(_constant(anchors, "array<string>"), words)
    a = a.withColumn("_l_present", present)
    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains("_l_present", w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    a = a.withColumn("_l_at", F.when(F.size("_l_present") > 0, places).otherwise(F.array().cast("array<struct<w:string,i:int>>")))
    at = F.col("_l_at")

    base = []
    for phrase, label in phrases.items():
        starts = F.transform(F.filter(at, _is(phrase[-1])), _shift(len(phrase) - 1))
        base.append(F.transform(F.filter(starts, _stands(words, phrase)), _label(label)))
    a = a.withColumn("_l_base", F.flatten(F.array(*base)))

    postings = _constant(index.postings and {w: [{"t": t, "q": q} for t, q in x] for w, x in index.postings.items()}, "map<string,array<struct<t:int,q:int>>>")
    templates = _constant(index.templates, "array<struct<label:string,words:array<string>,weights:array<double>,key:array<string>,key_at:int>>")
    # A template and where it would start, as one number: distinct numbers are found by hashing, distinct structs by pairs.
    span = 1 << 32
    place = lambda x: lambda y: y["t"].cast("long") * span + (x["i"] - y["q"]).cast("long") + span // 2
    found = F.filter(F.transform(at, lambda x: F.transform(F.element_at(postings, x["w"]), place(x))), lambda x: x.isNotNull())
    unpacked = lambda n: F.struct(F.shiftright(n, 32).cast("int").alias("t"), (n.bitwiseAND(F.lit(span - 1)) - span // 2).cast("int").alias("start"))
    proposed = F.transform(F.array_distinct(F.flatten(found)), unpacked)

    def verified(x: Column) -> Column:
        of = lambda name: F.get(templates, x["t"])[name]
        agree = F.zip_with(of("weights"), F.transform(of("words"), lambda w, j: F.get(words, x["start"] + j) == w), lambda weight, same: F.when(same, weight).otherwise(0.0))
        score = F.least(F.lit(1.0), F.aggregate(agree, F.lit(0.0), lambda s, w: s + w))
        stands = _phrase_at(words, x["start"] + of("key_at"), of("key"), F.size(of("key")))
        return F.when(stands, F.struct(of("label").alias("label"), x["start"].alias("start"), score.alias("score")))

    hits = F.filter(F.transform(proposed, verified), lambda x: x["score"] >= params.limit - 1e-9)
    # Not deterministic, though always true: later filters stay above and do not compute the word arrays anew.
    some = (F.size(at) > 0) & (F.monotonically_increasing_id() >= 0)
    a = a.withColumn("_l_hits", F.when(some, hits))
    got = F.col("_l_base")
    starts = F.transform(got, lambda x: x["start"])
    labels = F.concat(F.transform(got, lambda x: x["label"]), F.coalesce(F.transform("_l_hits", lambda x: x["label"]), F.array().cast("array<string>")))
    best = F.array_max(F.transform("_l_hits", lambda x: x["score"]))
    return a.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.size(got).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(got, lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(F.size(got) > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.coalesce("_l_hits", F.array().cast("array<struct<label:string,start:int,score:double>>")).alias("hits"),
    )


def _is(word: str):
    return lambda x: x["w"] == word


def _shift(by: int):
    return lambda x: x["i"] - by


def _label(label: str):
    return lambda s: F.struct(F.lit(label).alias("label"), s.alias("start"))


def _stands(words: Column, phrase: tuple[str, ...]):
    return lambda s: _phrase_at(words, s, F.array(*map(F.lit, phrase)), F.lit(len(phrase)))
