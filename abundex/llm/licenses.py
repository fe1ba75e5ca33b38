"""License scans, with DataFrame functions only.

Template shingles are five consecutive words (a shorter template is one shingle). Templates of similar length share a
class with overlapping windows: a window holds `longest + step` shingles and the next one starts `step` later, so every
occurrence of a template lies in some window whole. A window's MinHash bands (one token each) are the minima of its
shingles rehashed with each band's seed. A window that contains a template to the extent of `containment` has at least a
Jaccard similarity j with it that follows from the lengths, and the number of bands makes (1 - j) ** bands less than
`miss`. Windows that share a band with a template are verified exactly, once, at the first such band: the share of the
template's shingles in the window.

Only windows with an anchor are cut. A template's anchors are words such that over 1 - containment of its shingles hold
one, so a text or window without any anchor can't reach the containment, and none is lost.

The templates are a parameter of bounded size (max_templates), known to the driver.

Defined cases: null and empty texts match nothing; a template without words is left out; a template that is given twice
counts once under its least id; documents that repeat are one row each; documents without a match have no row; extra
columns aren't read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abundex.llm.common import forget, keep

SHINGLE = 5

#: Public license statements and notices (fixed values).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: str) -> list[str]:
    import re

    return [w for w in re.split("[^a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]


def anchors(words: list[str], size: int, containment: float) -> list[str]:
    """Words, the longest first, that over 1 - containment of the shingles hold."""
    n = len(words) - size + 1
    held: set[int] = set()
    out: list[str] = []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if len(held) > n * (1 - containment) + 1e-9:
            break
        held |= {i for i in range(n) if w in words[i : i + size]}
        out.append(w)
    return out


def _words(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all shingles in order; none for fewer words."""
    some = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(size)]))
    return F.when(F.size(words) >= size, some).otherwise(F.array().cast("array<bigint>"))


class Class:
    """Templates of similar length: shingle size, window and step in shingles, band seeds."""

    def __init__(self, size: int, members: list[tuple[str, list[int]]], containment: float, miss: float):
        self.size, self.members = size, members
        distinct = [len(set(s)) for _, s in members]
        longest, shortest = max(len(s) for _, s in members), min(distinct)
        self.step = max(1, shortest // 4)
        self.window = longest + self.step
        shared = math.ceil(containment * shortest - 1e-9)
        self.jaccard = shared / (self.window + shortest - shared)
        rng = random.Random(5 * longest + size)
        self.seeds = [rng.getrandbits(63) for _ in range(math.ceil(math.log(miss) / math.log(1 - self.jaccard)))]


def classes(spark: SparkSession, templates: dict[str, str], containment: float, miss: float, max_templates: int) -> list[Class]:
    if len(templates) > max_templates:
        raise ValueError(f"more than {max_templates} templates")
    known: dict[tuple, str] = {}
    for name in sorted(templates):
        w = words_of(templates[name])
        if w:
            known.setdefault(tuple(w), name)
    by_size: dict[int, list] = {}
    for w, name in known.items():
        by_size.setdefault(min(SHINGLE, len(w)), []).append((name, " ".join(w)))
    out = []
    for size, rows in sorted(by_size.items()):
        frame = spark.createDataFrame(rows, "name string, text string")
        hashed = sorted(((r["name"], r["s"]) for r in frame.select("name", _shingles(_words(F.col("text")), size).alias("s")).collect()), key=lambda x: (len(x[1]), x[0]))
        while hashed:
            group = [x for x in hashed if len(x[1]) <= 1.5 * len(hashed[0][1])]
            out.append(Class(size, group, containment, miss))
            hashed = hashed[len(group) :]
    return out


def _tokens(shingles: Column, g: Class) -> Column:
    """One token a band."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(seed))))

    return F.array(*map(least, g.seeds))


def _windows(words: Column, shingles: Column, g: Class, wanted: list[str], number: int) -> Column:
    """(class, at, s) of the class's windows that hold one of its anchors; at and the words count from 0."""
    spots = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.element_at(words, i + 1).isin(wanted))
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - (g.size + g.window - 2)) / F.lit(g.step)).cast("int"))
    numbers = F.array_distinct(F.flatten(F.transform(spots, lambda p: F.sequence(first(p), F.floor(p / F.lit(g.step)).cast("int")))))
    starts = F.filter(F.transform(numbers, lambda a: a * g.step), lambda i: i < F.size(shingles))
    cuts = F.transform(starts, lambda i: F.struct(F.lit(number).alias("class"), i.alias("at"), F.slice(shingles, i + 1, F.lit(g.window)).alias("s")))
    return F.when(F.size(shingles) > 0, cuts).otherwise(F.array().cast("array<struct<class:int,at:int,s:array<bigint>>>"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, miss: float = 1e-7, max_templates: int = 5000) -> DataFrame:
    """doc_id, license_id, containment (the largest share of the template's shingles in a window) and first_word (the
    least start, in words, of a window with it), for every template that a document contains to that extent."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    groups = classes(spark, templates, containment, miss, max_templates)
    schema = "doc_id long, license_id string, containment double, first_word long"
    if not groups:
        return spark.createDataFrame([], schema)
    wanted = {a for t in templates.values() if (w := words_of(t)) for a in anchors(w, min(SHINGLE, len(w)), containment)}
    wanted = {a for a in wanted if not any(b != a and b in a for b in wanted)}  # a text with a has b inside
    # lower() maps ASCII letters as the words do, and may add matches of anchors, never lose one
    any_anchor = F.lit(False)
    for a in sorted(wanted):
        any_anchor = any_anchor | F.contains("_lower", F.lit(a))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lower("text").alias("_lower")).where(any_anchor)
    texts = keep(some.select("doc_id", _words(F.col("text")).alias("w")), "license-words")
    hashed = texts.select("doc_id", "w", *[_shingles(F.col("w"), size).alias(f"s{size}") for size in sorted({g.size for g in groups})])
    cuts = [_windows(F.col("w"), F.col(f"s{g.size}"), g, sorted({a for name, _ in g.members for a in anchors(words_of(templates[name]), g.size, containment)}), c) for c, g in enumerate(groups)]
    windows = keep(hashed.select("doc_id", F.explode(F.concat(*cuts)).alias("x")).select("doc_id", "x.*"), "license-windows")
    forget(texts)
    found = None
    for c, g in enumerate(groups):
        members = spark.createDataFrame([(name, sorted(set(shingles))) for name, shingles in g.members], "license_id string, template array<long>").withColumn("own", _tokens(F.col("template"), g))
        known = members.select("license_id", "template", "own", F.posexplode("own").alias("band", "token"))
        banded = windows.where(F.col("class") == c).withColumn("tokens", _tokens(F.col("s"), g)).select("doc_id", "at", "s", "tokens", F.posexplode("tokens").alias("band", "token"))
        first = F.array_position(F.zip_with("tokens", "own", lambda x, y: x == y), F.lit(True)) == F.col("band") + 1
        # the table has one row a template and band, at most max_templates in all classes
        hits = banded.join(F.broadcast(known), ["band", "token"]).where(first).select("doc_id", "at", "license_id", (F.size(F.array_intersect("template", "s")) / F.size("template")).alias("containment")).where(F.col("containment") >= containment)
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), F.max(F.struct("containment", (-F.col("at")).alias("back"))).alias("best"))
    return best.select("doc_id", "license_id", "containment", (-F.col("best.back")).cast("long").alias("first_word"))


def oracle(containment: float = 0.8) -> str:
    """The same matches from all windows, without bands."""
    from collections import defaultdict

    by_size = defaultdict(list)
    for name, text in TEMPLATES.items():
        w = words_of(text)
        by_size[min(SHINGLE, len(w))].append((name, w))
    values, cuts = [], []
    for size, rows in sorted(by_size.items()):
        rows.sort(key=lambda x: (len(x[1]), x[0]))
        cuts.append(f"select doc_id, {size} size, p - 1 p, array_to_string(w[p : p + {size - 1}], ' ') g from (select doc_id, w, unnest(generate_series(1, len(w) - {size - 1})) p from docs where len(w) >= {size})")
        while rows:
            n0 = len(rows[0][1]) - size + 1
            group = [x for x in rows if len(x[1]) - size + 1 <= 1.5 * n0]
            rows = rows[len(group) :]
            g = Class(size, [(n, list(range(len(w) - size + 1))) for n, w in group], containment, 0.5)
            for name, w in group:
                shingles = sorted({" ".join(w[i : i + size]) for i in range(len(w) - size + 1)})
                values += [f"('{name}', {size}, {g.step}, {g.window}, {len(shingles)}, '{x}')" for x in shingles]
    return f"""
with docs as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') w from documents),
t(license_id, size, step, win, n, g) as (values {", ".join(values)}),
hit as (select doc_id, license_id, step, win, n, p, t.g from ({" union all ".join(cuts)}) sh join t on sh.size = t.size and sh.g = t.g),
spread as (select *, unnest(generate_series(case when p < win then 0 else (p - win) // step + 1 end, p // step)) a from hit),
found as (select doc_id, license_id, a * step first_word, count(distinct g) / n::double containment from spread group by doc_id, license_id, a, step, n)
select doc_id, license_id, max(containment) containment, arg_max(first_word, containment * 1e6 - first_word / 1e6)::bigint first_word
from found where containment >= {containment} group by doc_id, license_id
"""


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
