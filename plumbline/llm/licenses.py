"""License scans by diagonal voting.

Every text's words give rolling k-gram hashes with their positions; Spark joins them to the positions of the same
k-grams in license templates (a table of fixed size, so its side is broadcast). A hit votes for its diagonal, the text
position less the template position. Votes are counted by text, template and diagonal, neighbouring diagonals (a few
words inserted or left out) are merged, and each merged span is verified against the words themselves.

Names of licenses, short forms (CC BY-NC 4.0) and SPDX expressions are too short for votes, and one word more makes
another license: they are found word for word, the longest one at its place. A span whose only names are those of other
licenses (the Attribution notice over the words of Attribution-NonCommercial) is theirs and not counted.

Votes are gathered by text (two 64-bit hashes of it), not by id: rows that share an id, or have none, never vote together,
and equal texts get equal spans, found once. Diagonals are taken in order and merged from the lowest on, so ties need no
rule; of names at one place the longest counts. A very long text is cut into k-grams whole and sent on in parts.

Base labels come from three fixed phrases. Null and empty texts: no words, no places, score 0.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, annotate, fresh, hash_strings, mix, ngram_hashes, read_table, split_words, tuned, whole, written

#: Phrases and labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, wording) of public license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
#: Creative Commons licenses: the words of the short form and of the name.
COMMONS = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
SPELLINGS = [("noncommercial", "non commercial"), ("sharealike", "share alike"), ("noderivatives", "noderivs"), ("noderivatives", "no derivatives"), ("noderivatives", "no derivs")]
VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: SPDX identifiers and usual short forms, as words; they count after one of LEADS only.
IDENTIFIERS = {
    "mit": "mit", "mit 0": "mit", "x11": "mit", "expat": "mit", "apache": "apache", "apache 2": "apache", "isc": "isc", "unlicense": "unlicense", "zlib": "zlib", "bsl 1 0": "boost", "wtfpl": "wtfpl",
    "bsd": "bsd", "0bsd": "bsd", "cc0": "cc0", "cc0 1 0": "cc0", "artistic 2 0": "artistic", "python 2 0": "psf", "psf 2 0": "psf",
    **{f"apache {v}": "apache" for v in ("1 0", "1 1", "2 0")}, **{f"bsd {n} clause": "bsd" for n in "234"}, **{f"{n} clause bsd": "bsd" for n in "234"}, **{f"mpl{v}": "mpl" for v in ("", " 1 0", " 1 1", " 2 0")}, **{f"epl{v}": "epl" for v in ("", " 1 0", " 2 0")},
    **{f"{g}{v}{o}": g for g in ("gpl", "lgpl", "agpl") for v in ("", " 1 0", " 2 0", " 2 1", " 3 0", " v2", " v3", "v2", "v3") for o in ("", " only", " or later")},
    **{f"cc {k}{v}": f"cc-{k.replace(' ', '-')}" for k in COMMONS for v in ("", *(f" {v}" for v in VERSIONS))},
}
LEADS = ("spdx license identifier", "license", "licence", "licensed under", "licensed under the", "licensed under a", "released under", "released under the", "distributed under", "distributed under the", "available under", "available under the", "published under", "published under the", "under the terms of the")
#: What is a license's name wherever it stands.
NAMES = {
    **PHRASES, "gnu general public license": "gpl", "gnu gpl": "gpl", "lesser general public license": "lgpl", "library general public license": "lgpl", "gnu lgpl": "lgpl", "affero general public license": "agpl", "gnu agpl": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "apache 2 0 license": "apache", "bsd license": "bsd", "isc license": "isc", "zlib license": "zlib", "boost software license": "boost", "do what the fuck you want to public license": "wtfpl", "artistic license": "artistic", "python software foundation license": "psf",
    **{f"{n} clause {x}": "bsd" for n in (2, 3, 4, "two", "three", "four") for x in ("bsd", "bsd license")}, "creative commons zero": "cc0", "cc0 1 0": "cc0", "creativecommons org publicdomain zero": "cc0",
    **{x.format(k): f"cc-{k.replace(' ', '-')}" for k in COMMONS for x in ("cc {} license", "cc {} licence", "creativecommons org licenses {}", *(f"cc {{}} {v}" for v in VERSIONS))},
}
for _kind, _name in COMMONS.items():
    _wordings = {_name}
    for _one, _other in SPELLINGS:
        _wordings |= {w.replace(_one, _other) for w in _wordings}
    NAMES |= {f"creative commons {w}": f"cc-{_kind.replace(' ', '-')}" for w in _wordings}
K = 3
#: Diagonals no further apart than this are merged; a span counts if this share of the template's words is found in it.
NEAR, COVERED = 2, 0.75
#: Texts with candidate spans up to this many are broadcast to the verifying pass; beyond, they are joined by a shuffle.
BROADCAST_TEXTS = 200_000

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32


def license_words(texts: pa.Array) -> Words:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, by one table look-up per byte."""
    texts = texts.cast(pa.large_string())
    if not len(texts) or texts.buffers()[2] is None:
        return split_words(pa.array([""] * len(texts), pa.string()))
    data = _TABLE[np.frombuffer(texts.buffers()[2], np.uint8)]
    clean = pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(data), None, 0, texts.offset)
    return split_words(clean)


def text_keys(text_col: str) -> list[Column]:
    """Two hashes that tell texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def grams(batches, k: int):
    """(two hashes of the text, position, hash) of every k-gram of every text."""
    for b in batches:
        words = license_words(whole(b.column(2)))
        text = words.text_of()
        if len(text) >= k:
            inside = np.flatnonzero(text[k - 1 :] == text[: len(text) - k + 1])
            h = ngram_hashes(mix(hash_strings(words.dictionary))[words.ids], k)[inside].astype(np.int64)
            at = text[inside]
            for i in range(0, len(inside), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[s])), b.column(1).take(pa.array(at[s])), pa.array((inside[s] - words.offsets[at[s]]).astype(np.int32)), pa.array(h[s])], names=["x", "y", "pos", "gram"])


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    rows = []
    for t, (_, wording) in enumerate(templates):
        words = license_words(pa.array([wording]))
        for p, h in enumerate(ngram_hashes(mix(hash_strings(words.dictionary))[words.ids], k).astype(np.int64).tolist()):
            rows.append((h, t, p))
    return spark.createDataFrame(rows, "gram long, template int, at int")


def candidates(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, text_col: str = "text") -> DataFrame:
    """x, y (hashes of a text) and spans: array of (template, begin, stop, votes), one for each run of neighbouring
    diagonals with enough votes. Hits of copies of a text are one, which is settled before the shuffle.
    """
    spark = tuned(docs.sparkSession)
    lengths = [len(license_words(pa.array([w])).ids) for _, w in templates]
    x, y = text_keys(text_col)
    found = docs.select(x.alias("x"), y.alias("y"), F.col(text_col).alias("text")).mapInArrow(lambda it: grams(it, k), "x long, y long, pos int, gram long")
    hits = found.join(F.broadcast(template_grams(spark, templates, k)), "gram").select("x", "y", "template", "pos", "at").distinct()
    votes = hits.groupBy("x", "y", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    near = W.partitionBy("x", "y", "template").orderBy("diagonal")
    runs = votes.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(near) > NEAR).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(near))
    length = F.element_at(F.array(*map(F.lit, lengths)), F.col("template") + 1)
    merged = runs.groupBy("x", "y", "template", "run").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    merged = merged.where(F.col("votes") * 2 >= length - k + 1).select("x", "y", F.struct("template", F.greatest("low", F.lit(0)).alias("begin"), (F.col("high") + length).alias("stop"), F.col("votes").cast("int").alias("votes")).alias("span"))
    return merged.groupBy("x", "y").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def covered(words: list[str], template: list[str]) -> tuple[float, int, int]:
    """Share of the template's words found in order in a span, and where the first and the last of them are."""
    blocks = [m for m in SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if m.size]
    return sum(m.size for m in blocks) / len(template), blocks[0].a if blocks else 0, blocks[-1].a + blocks[-1].size if blocks else 0


SCANNED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.StringType()),
    ]
)


def phrase_places(words: Words) -> dict[int, list[tuple[int, str]]]:
    """Text -> (word position, label) of every base phrase."""
    place = {w: i for i, w in enumerate(words.dictionary.to_pylist())} if len(words.dictionary) else {}
    text, found = words.text_of(), {}
    for phrase, label in PHRASES.items():
        want = [place.get(w, -1) for w in phrase.split()]
        n = len(words.ids) - len(want) + 1
        if n <= 0 or min(want) < 0:
            continue
        hit = text[len(want) - 1 :] == text[:n]
        for i, w in enumerate(want):
            hit &= words.ids[i : n + i] == w
        for i in np.flatnonzero(hit).tolist():
            found.setdefault(int(text[i]), []).append((i - int(words.offsets[text[i]]), label))
    return found


def branches(phrases: dict[str, str], lead: bool) -> dict:
    """A trie of words; under None what ends here: (label, is it an identifier after a lead?)."""
    root: dict = {}
    for phrase, label in phrases.items():
        node = root
        for w in phrase.split():
            node = node.setdefault(w, {})
        node[None] = (label, lead)
    return root


_IDS = branches(IDENTIFIERS, True)
_NAMES = branches({f"{lead} {x}": label for lead in LEADS for x, label in IDENTIFIERS.items()}, True)
for _phrase, _label in NAMES.items():
    _node = _NAMES
    for _w in _phrase.split():
        _node = _node.setdefault(_w, {})
    _node.setdefault(None, (_label, False))


def longest(node: dict, words: list[str], at: int) -> tuple[int, str, bool] | None:
    """End, label and kind of the longest phrase that starts at a place."""
    best = None
    while at < len(words) and words[at] in node:
        node, at = node[words[at]], at + 1
        if None in node:
            best = (at, *node[None])
    return best


def name_places(words: Words) -> dict[int, list[tuple[int, int, str]]]:
    """Text -> (first word, end, label) of names and short forms; none lies inside another."""
    listed = words.dictionary.to_pylist()
    starts, nexts = np.zeros(len(listed) + 1, bool), np.zeros(len(listed) + 1, bool)
    seconds = set().union(*_NAMES.values()) - {None}
    for i, w in enumerate(listed):
        starts[i], nexts[i] = w in _NAMES, w in seconds
    found: dict[int, list[tuple[int, int, str]]] = {}
    if len(words.ids) < 2:
        return found
    hits = np.flatnonzero(starts[words.ids[:-1]] & nexts[words.ids[1:]])
    hits = hits[[listed[words.ids[i + 1]] in _NAMES[listed[words.ids[i]]] for i in hits.tolist()]] if len(hits) else hits
    owner = np.searchsorted(words.offsets, hits, side="right") - 1
    for t in np.unique(owner).tolist():
        low, high, stop = int(words.offsets[t]), int(words.offsets[t + 1]), 0
        mine: list[str] = [listed[i] for i in words.ids[low:high]]
        for at in (hits[owner == t] - low).tolist():
            got = longest(_NAMES, mine, at)
            while got and got[0] > stop:
                stop = got[0]
                found.setdefault(t, []).append((at, stop, got[1]))
                at = stop + 1  # an SPDX expression goes on after its operator
                got = longest(_IDS, mine, at) if got[2] and mine[stop : stop + 1] in (["or"], ["and"]) else None
    return found


def verify(texts: pa.Array, spans: list, templates: list[tuple[str, str]]) -> list[list]:
    """The columns of SCANNED for a batch; spans: candidate spans of each text, or None."""
    words = license_words(texts)
    wordings = [license_words(pa.array([w])) for _, w in templates]
    wordings = [x.dictionary.take(pa.array(x.ids)).to_pylist() for x in wordings]
    places, names = phrase_places(words), name_places(words)
    columns: list[list] = [[] for _ in SCANNED]
    for i in range(len(texts)):
        low, high = int(words.offsets[i]), int(words.offsets[i + 1])
        base = places.get(i, [])
        named = names.get(i, [])
        labels, best = {label for _, label in base} | {label for *_, label in named}, float(bool(named))
        kept = [f"{label}:{a}:{b}" for a, b, label in named]
        for s in spans[i] or ():
            begin, stop = low + s["begin"], min(high, low + s["stop"])
            share, first, last = covered(words.dictionary.take(pa.array(words.ids[begin:stop])).to_pylist(), wordings[s["template"]])
            label = templates[s["template"]][0]
            inside = {x for a, b, x in named if a < begin - low + last and begin - low + first < b}
            if share >= COVERED and (not inside or label in inside):
                labels.add(label)
                best = max(best, share)
                kept.append(f"{label}:{begin - low}:{stop - low}")
        starts = [p for p, _ in base]
        row = (high - low, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), best, ",".join(kept))
        for column, value in zip(columns, row, strict=True):
            column.append(value)
    return columns


def license_scans(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """Each row with a struct of SCANNED. The candidates are written to the shared folder, counted, then joined back."""
    found = written(candidates(docs, templates, k, text_col), "license-candidates")
    carry = docs.columns if carry is None else carry
    few = found.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS
    x, y, spans = (fresh(docs.columns, n) for n in ("x", "y", "spans"))
    right = found.select(F.col("x").alias(x), F.col("y").alias(y), F.col("spans").alias(spans))
    mine = text_keys(text_col)
    joined = docs.withColumns({x: mine[0], y: mine[1]}).join(F.broadcast(right) if few else right, [x, y], "left").select(*docs.columns, spans)
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]

    def work(b):
        columns = verify(whole(b.column(b.schema.get_field_index(text_col))), b.column(b.schema.get_field_index(spans)).to_pylist(), templates)
        return [pa.array(c, t) for c, t in zip(columns, types, strict=True)]

    return annotate(joined, work, SCANNED, carry, [text_col, spans])


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels and places of every document."""
    found, s = license_scans(read_table(tuned(spark), sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return found.select("doc_id", f"{s}.*")
