"""License scans: MinHash bands over overlapping word windows retrieve templates, exact
shingle containment verifies them. DataFrame functions only.

A template of t words is looked for in windows of t + s - 1 words, one each s = max(1, t // 2)
words, so any run of t words lies whole in a window. A window that holds CONTAINED of a
template's shingles has a similarity of 0.45 or more with it; BANDS bands of one minimum then
collide with probability 1 - 0.55**BANDS, over 0.9999994.

A band's minima can be equal only where the window holds the shingle that is the template's
minimum. So windows are made only around such shingles (GATE: at most BANDS for each template):
no other window can collide, and texts without any are done after one pass over their shingles.
Gates are a hashed table within the plan, so a shingle's lookup costs the same with any number of
templates; those are given by the driver, so they fit there.

Defined results: words are runs of characters other than ASCII blanks, controls and
punctuation, A-Z in lower case; a template shorter than a shingle is one shingle of its own
words. One row for each doc_id and license with a match; rows of one doc_id count together;
null text holds nothing; a null doc_id counts as a doc_id; ties in containment give the first
place. A very long text is one row with a list of its shingles, read whole. Other columns aren't looked at.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import TEXTS

SHINGLE = 5
#: Share of a template's distinct shingles that a window holds, in hundredths.
CONTAINED = 80
BANDS = 24

# Notices and grants as the licenses word them.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "all-rights-reserved": ("All rights reserved.",),
}
TEMPLATES = {name: (*NOTICES.get(name, ()), *TEXTS.get(name, ())) for name in [*NOTICES, *(x for x in TEXTS if x not in NOTICES)]}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _APART), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """use(value), with the value bound by a lambda: no rewrite of the plan makes it more than once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashed(words: Column, width: int) -> Column:
    """The hashes of the shingles of a list of words in order."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, width))))


def _shingles(text: Column, width: int) -> Column:
    return _bound(_words(text), lambda ws: _hashed(ws, width))


def _minima(shingles: Column) -> Column:
    """The least of each of BANDS hashes of a list of shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, k))))


def _least_shingle(shingles: Column, k: Column) -> Column:
    return F.array_min(F.transform(shingles, lambda x: F.struct(F.xxhash64(x, k), x.alias("x"))))["x"]


def _plain_words(text: str) -> list[str]:
    return [w for w in re.split(_APART, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def _indexed(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    """license, part, words, width, shingles, minima, gate of every template, made as for texts."""
    rows = [(name, k, len(_plain_words(t)), t) for name, ts in templates.items() for k, t in enumerate(ts)]
    if not all(n for _, _, n, _ in rows):
        raise ValueError("templates need words")
    out = None
    for width in sorted({min(SHINGLE, n) for _, _, n, _ in rows}):
        items = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(k).alias("part"), F.lit(n).alias("words"), F.lit(t).alias("text")) for name, k, n, t in rows if min(SHINGLE, n) == width))
        some = spark.range(1).select(F.explode(items).alias("t")).select("t.*", F.lit(width).alias("width"))
        some = some.withColumn("shingles", F.array_distinct(_shingles(F.col("text"), width)))
        out = some if out is None else out.unionByName(some)
    gate = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: _least_shingle(F.col("shingles"), k))
    return out.select("license", "part", "words", "width", "shingles", _minima(F.col("shingles")).alias("minima"), F.array_distinct(gate).alias("gate"))


def _window(words: int, width: int) -> tuple[int, int]:
    """Stride and shingles of the windows for a template of so many words."""
    stride = max(1, words // 2)
    return stride, words + stride - 1 - width + 1


def _constant(value, schema: str) -> Column:
    """A constant of nested lists, folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def _windows(h: Column, width: int, gates: list[tuple[int, int]]) -> Column:
    """The windows (width, words, at, w: its distinct shingles) of a text's shingles that hold one of
    gates (shingle, words of its template)."""
    size = 1 << max(1, len(gates)).bit_length()
    place = lambda x: x.bitwiseAND(F.lit(size - 1)).cast("int")
    slots: list[list[dict]] = [[] for _ in range(size)]
    for x, words in gates:
        slots[x & (size - 1)].append({"x": x, "words": words})
    any_gate = _constant(sorted({x for x, _ in gates}), "array<bigint>")
    known = _constant([sorted({e["x"] for e in slot}) for slot in slots], "array<array<bigint>>")
    entries = _constant(slots, "array<array<struct<x: bigint, words: int>>>")

    stride_of = lambda words: F.greatest(F.lit(1), F.floor(words / 2).cast("int"))

    def around(i: Column, words: Column) -> Column:
        """words and the place of each window around i, in one number: distinct ones are then found by hashing."""
        stride = stride_of(words)
        first = F.ceil(F.greatest(i - (words + stride - width - 1), F.lit(0)) / stride).cast("int")
        return F.transform(F.sequence(first, F.floor(i / stride).cast("int")), lambda j: F.shiftleft(words.cast("long"), 32) + j * stride)

    def window(packed: Column) -> Column:
        words, at = F.shiftright(packed, 32).cast("int"), packed.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.struct(F.lit(width).alias("width"), words.alias("words"), at.alias("at"), F.array_distinct(F.slice(h, at + 1, words + stride_of(words) - width)).alias("w"))

    hits = F.filter(F.transform(h, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.array_contains(F.get(known, place(p["x"])), p["x"]))
    mine = lambda p: F.filter(F.get(entries, place(p["x"])), lambda e: e["x"] == p["x"])
    places = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.flatten(F.transform(mine(p), lambda e: around(p["i"], e["words"]))))))
    return F.when(F.arrays_overlap(h, any_gate), F.transform(places, window)).otherwise(F.array().cast("array<struct<width: int, words: int, at: int, w: array<bigint>>>"))


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, text: str = "text") -> DataFrame:
    """doc_id, license, containment (best share of a template's shingles in a window) and
    first_word (where the first such window begins, in words) of docs (doc_id, text)."""
    spark = docs.sparkSession
    known = _indexed(spark, templates or TEMPLATES)
    gates: dict[int, set] = {}
    for words, width, gate in known.select("words", "width", "gate").collect():
        gates.setdefault(width, set()).update((x, words) for x in gate)

    def windows_of(words: Column, width: int) -> Column:
        return _bound(_hashed(words, width), lambda h: _windows(h, width, sorted(gates[width])))

    def all_windows(words: Column) -> Column:
        return F.concat(*(windows_of(words, width) for width in sorted(gates)))

    found = docs.select("doc_id", F.explode(_bound(_words(F.coalesce(F.col(text), F.lit(""))), all_windows)).alias("v")).select("doc_id", "v.*")
    bands = found.select("doc_id", "width", "words", "at", "w", F.posexplode(_minima(F.col("w"))).alias("band", "least"))
    keys = known.select("width", "words", "license", "part", F.posexplode("minima").alias("band", "least"))
    retrieved = bands.join(F.broadcast(keys), ["width", "words", "band", "least"]).select("doc_id", "license", "part", "at", "w").distinct()
    sets = known.select("license", "part", "shingles")
    share = F.size(F.array_intersect("w", "shingles"))
    checked = retrieved.join(F.broadcast(sets), ["license", "part"]).withColumn("share", share / F.size("shingles"))
    matches = checked.filter(100 * share >= CONTAINED * F.size("shingles"))
    return matches.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.min_by("at", F.struct(-F.col("share"), F.col("at"))).cast("long").alias("first_word"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scan_licenses(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "license", F.round("containment", 6).alias("containment"), "first_word")


def _oracle(templates: dict[str, tuple[str, ...]]) -> str:
    shingles, sizes = [], []
    for name, texts in templates.items():
        for k, t in enumerate(texts):
            words = _plain_words(t)
            width = min(SHINGLE, len(words))
            own = {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
            stride, size = _window(len(words), width)
            sizes.append(f"('{name}', {k}, {width}, {stride}, {size}, {len(own)})")
            shingles += [f"('{name}', {k}, '{s}')" for s in sorted(own)]
    widths = sorted({min(SHINGLE, len(_plain_words(t))) for ts in templates.values() for t in ts})
    made = " UNION ALL ".join(f"SELECT doc_id, {n} AS width, unnest(range(len(w) - {n - 1})) AS i, unnest([array_to_string(w[i + 1:i + {n}], ' ') for i in range(len(w) - {n - 1})]) AS s FROM words WHERE len(w) >= {n}" for n in widths)
    return f"""
    WITH templates(license, part, width, stride, size, n) AS (VALUES {", ".join(sizes)}),
    known(license, part, s) AS (VALUES {", ".join(shingles)}),
    words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_APART}'), lambda x: x <> '') AS w FROM documents),
    made AS ({made}),
    hits AS (SELECT doc_id, license, part, i, s, stride, size, n FROM made JOIN known USING (s) JOIN templates USING (license, part, width)),
    placed AS (SELECT doc_id, license, part, s, n, stride, unnest(range(CAST(ceil(greatest(i - (size - 1), 0) / stride) AS BIGINT), i // stride + 1)) AS j FROM hits),
    shares AS (SELECT doc_id, license, j * stride AS pos, count(DISTINCT s) / n AS share FROM placed GROUP BY doc_id, license, part, j, stride, n HAVING 100 * count(DISTINCT s) >= {CONTAINED} * n)
    SELECT doc_id, license, round(max(share), 6) AS containment, CAST(arg_min(pos, (-share, pos)) AS BIGINT) AS first_word FROM shares GROUP BY doc_id, license
    """


ORACLE = _oracle(TEMPLATES)
