"""Licence scans: a trained paragraph classifier in built-in functions.

A paragraph is a line with a word. A notice may be wrapped: a line that isn't one
alone is judged with the next line and the next two, up to a line without a word;
it counts when the rest without it holds no name of that family. Features are the
word pairs and triples that hold one of the ``ANCHORS`` or ``MARKS``; a line without
an anchor starts no notice, which one regular expression finds out. A multinomial
logistic regression with an unknown class is trained (MLlib) on notices made
from the frames and names below and on the lines of the corpus that hold an
anchor, but less than half of any name: all different ones, or a number of them
if ``sample_lines`` is set. However many they are, they weigh as much as
``unknown_weight`` lines, so notices keep their weight; their features are those
of the notices and the ``line_grams`` that most lines hold. The least probability
that counts is calibrated on half of these lines, which isn't trained on: no more
than ``false_share`` of it may pass. A predicted family is confirmed when the line
holds most of the word pairs of one of the family's names.

The weights are a constant of the plan, so a text is scored where it lies: no
shuffle, no join, no user function. Defined results: a null or empty text has no
paragraphs and no families; equal probabilities go to the family first in the
table; rows are scanned alone, and other columns aren't read.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritally.llm.common import let, written

# How notices name the licences, and sentences they stand in.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License 2.0"],
    "MIT": ["MIT License", "MIT licence", "The MIT License (MIT)"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-style license"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPL-3.0", "GPLv3 license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPL-2.0", "GPLv2 license"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL version 2.1", "LGPL-2.1", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License", "GNU AGPL version 3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL-2.0"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial License"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "proprietary": ["All rights reserved", "Proprietary and confidential"],
}
# Identifiers of a single word with the words they are told by, and paragraphs that don't name their licence.
PHRASES = {
    "MIT": ["Identifier: MIT", "License: MIT", "Licensed under MIT", "Terms of MIT", "License (MIT)"],
    "BSD": [
        "BSD-2-Clause", "BSD-4-Clause", "License: BSD", "Licensed under BSD", "Identifier: 0BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ],
    "GPL-3.0": ["License: GPLv3", "Licensed under GPLv3", "Under the GPLv3"],
    "GPL-2.0": ["License: GPLv2", "Licensed under GPLv2", "Under the GPLv2"],
    "LGPL": ["LGPL-2.0", "License: LGPL", "Licensed under LGPL", "Under the LGPL"],
    "AGPL-3.0": ["License: AGPL", "Licensed under AGPL", "Under the AGPL"],
    "MPL-2.0": ["License: MPL", "MPL 2.0"],
    "CC0": ["License: CC0", "Licensed under CC0", "Under CC0"],
}
PHRASES["MIT"].append("Permission is hereby granted, free of charge, to any person obtaining a copy of this software")
PHRASE_FRAMES = ("{}", "{}.", "SPDX-License-{}", "This file: {}", "{}, see the web site.", "Copyright (c) the authors. {}")
# Headers as they are wrapped, by name and version.
HEADERS = {
    "GPL-3.0": ("GNU General Public License", "either version 3"),
    "GPL-2.0": ("GNU General Public License", "either version 2"),
    "LGPL": ("GNU Lesser General Public License", "either version 2.1"),
    "AGPL-3.0": ("GNU Affero General Public License", "either version 3"),
}
HEADER_FRAMES = (
    "it under the terms of the {} as published by the Free Software Foundation, {} of the License, or (at your option) any later version.",
    "it under the terms of the {} as published by the Free Software Foundation; {} of the License, or",
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, {} of the License",
    "the terms of the {} as published by the Free Software Foundation, {}",
)
FRAMES = (
    "{}", "{}.", "Licensed under {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.",
    "This file is distributed under the terms of the {}.", "Released under the {} by its authors.", "SPDX-License-Identifier: {}",
    "Use of this source code is governed by the {} that can be found in the LICENSE file.", "You may use this under the {} or any later version.",
    "This program is free software under the {} as published.", "Copyright (c) the authors. {}", "License: {}", "The code is available under the {}, see the web site.",
)
OTHERS = (
    "Copyright law protects the works of authors.", "He holds a license to drive a truck.", "A licensed physician must be present.", "The Apache people lived in the south.",
    "The public library is open to the general public.", "Version 2 of the paper was published.", "The commons were open to all.", "A creative idea came up.",
    "She studied at MIT.", "The license plate was found under the car.", "All the rights of the members are listed here.", "The general said that the public was free.",
    "Under the terms of the contract the work is done.", "Please cc me on version 3 of the mail.", "Mozilla is a community.", "The license was not renewed.", "An affero model.",
)
ANCHORS = "apache mit bsd gnu gpl gplv2 gplv3 lgpl agpl mozilla mpl cc cc0 creative commons license licence licensed licenced copyright spdx rights proprietary affero permission granted redistribution redistribute".split()
MARKS = ["version"]  # words that tell licences apart without starting a notice
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Settings:
    sample_lines: int | None = 2000  # None: all, as the query has it
    unknown_weight: float = 1000.0
    line_grams: int = 2000
    false_share: float = 0.001
    least: float = 0.5
    likeness: float = 0.75
    wrapped: int = 2  # lines after the first that a notice may go on for
    strength: float = 1e-4


def has_anchor() -> str:
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(ANCHORS) + r")(?![a-z0-9])"


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def features(ws: Column) -> Column:
    """Word pairs and triples with an anchor or a mark in them."""
    anchors = F.array(*[F.lit(a) for a in (*ANCHORS, *MARKS)])
    pairs = F.transform(ws, lambda w, i: F.array(w, F.get(ws, i + 1)))
    triples = F.transform(ws, lambda w, i: F.array(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    known = F.filter(F.concat(pairs, triples), lambda g: ~F.exists(g, lambda x: x.isNull()) & F.arrays_overlap(g, anchors))
    return F.array_distinct(F.transform(known, lambda g: F.concat_ws(" ", g)))


def pairs_of(ws: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(ws, lambda w, i: F.when(F.get(ws, i + 1).isNotNull(), F.concat_ws(" ", w, F.get(ws, i + 1)))), lambda x: x.isNotNull()))


@dataclass
class Model:
    families: list[str]  # the last is unknown
    weights: dict[str, list[float]]  # per feature, in the order of families
    intercepts: list[float]
    names: dict[str, list[list[str]]]  # word pairs of each name
    least: float
    n_sampled: int = 0  # lines of the corpus that were taken as unknown
    n_calibrated: int = 0  # those of them that the least probability was calibrated on


def lines_of(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.explode(F.split(F.col(f"`{text}`"), "\n")).alias("line")).filter(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))


def unknown_lines(docs: DataFrame, text: str, names: dict[str, list[list[str]]], s: Settings) -> DataFrame:
    """All different lines with an anchor but no name; with ``sample_lines`` so many of them, those with the smallest hashes.

    Notices and repeats go before anything is counted, so a line that is common can't take another's place. What is
    ordered for a sample is about four samples at every size.
    """
    lines = lines_of(docs, text).filter(F.col("line").rlike(has_anchor()))
    if s.sample_lines is not None:
        lines = lines.filter(F.octet_length("line") <= 10_000)
    named = F.lower("line").rlike(key_pairs(names, 0.5))  # lines without it can't hold half of a name
    lines = lines.filter(~named | (let(words(F.col("line")), lambda ws: likeness(ws, names)) < 0.5))
    if s.sample_lines is None:
        return lines.distinct()
    different = lines.groupBy(F.xxhash64("line").alias("hash")).agg(F.min("line").alias("line"))
    different = written(different, "lines")
    step = max(1, different.count() // (4 * s.sample_lines))
    thinned = different.filter(F.pmod("hash", F.lit(step)) == 0)
    return thinned.orderBy("hash", "line").limit(s.sample_lines)


def fit(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> Model:
    """Trains on the notices and on half of the lines with an anchor but no name, chosen by hash."""
    s, spark = settings, docs.sparkSession
    families = [*NAMES, UNKNOWN]
    unknown = len(families) - 1
    pairs = {f: [pair_list(n) for n in (*NAMES[f], *PHRASES.get(f, []))] for f in families[:-1]}
    notices = [(frame.format(name), k) for k, f in enumerate(families[:-1]) for name in NAMES[f] for frame in FRAMES]
    notices += [(frame.format(phrase), families.index(f)) for f in PHRASES for phrase in PHRASES[f] for frame in PHRASE_FRAMES]
    notices += [(frame.format(*HEADERS[f]), families.index(f)) for f in HEADERS for frame in HEADER_FRAMES for _ in range(4)]
    notices += [(x, unknown) for x in OTHERS for _ in range(4)]
    notices = spark.createDataFrame(notices, "line string, label int").select("*", F.pmod(F.xxhash64("line"), F.lit(5)) == 0, F.lit(False))
    plain = unknown_lines(docs, text, pairs, s).select("line", F.lit(unknown), F.pmod(F.xxhash64("line", F.lit(1)), F.lit(2)) == 0, F.lit(True))
    rows = notices.union(plain).toDF("line", "label", "held", "sampled").withColumn("grams", let(words(F.col("line")), features))
    rows = written(rows.select("line", F.col("label").cast("double"), "grams", "held", "sampled"), "notices")

    used = rows.filter("not held")
    if s.sample_lines is None:
        counter = CountVectorizerModel.from_vocabulary(vocabulary(used, s), "grams", "features")
        counter.setBinary(True)
    else:
        counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2).fit(used)
    n_unknown = used.filter("sampled").count()
    used = used.withColumn("weight", F.when(F.col("sampled"), F.lit(min(1.0, s.unknown_weight / max(1, n_unknown)) if s.sample_lines is None else 1.0)).otherwise(1.0))
    learner = LogisticRegression(family="multinomial", regParam=s.strength, maxIter=100, weightCol="weight")
    trained = learner.fit(counter.transform(used))
    matrix = trained.coefficientMatrix.toArray()
    weights = {g: [round(float(x), 6) for x in matrix[:, k]] for k, g in enumerate(counter.vocabulary)}
    model = Model(families, weights, [round(float(x), 6) for x in trained.interceptVector.toArray()], pairs, s.least)
    model.n_sampled = rows.filter("sampled").count()
    wrong = written(rows.filter("sampled and held").select(judged(F.col("line"), model).alias("j")).select("j.probability"), "judged")
    n = wrong.count()
    most = wrong.orderBy(F.desc("probability")).limit(int(s.false_share * n) + 1)
    calibrated(model, [r.probability for r in most.collect()], s, n)
    return model


def vocabulary(used: DataFrame, s: Settings) -> list[str]:
    """The grams that two notices hold, and the ``line_grams`` that most lines of the corpus hold, two at least."""
    grams = used.select("sampled", F.explode("grams").alias("gram")).groupBy("gram")
    counts = written(grams.agg(F.sum((~F.col("sampled")).cast("long")).alias("notices"), F.sum(F.col("sampled").cast("long")).alias("lines")), "grams")
    own = [r.gram for r in counts.filter("notices >= 2").select("gram").collect()]  # of the fixed values above
    common = counts.filter("notices < 2 and lines >= 2").orderBy(F.desc("lines"), "gram").limit(s.line_grams)
    return sorted(own) + [r.gram for r in common.select("gram").collect()]


def calibrated(model: Model, wrong: list[float], settings: Settings, n: int | None = None) -> None:
    """Sets the least probability so that no more than ``false_share`` of ``wrong``, those of unknown lines, reach it.

    With ``n``, the number of lines, ``wrong`` may hold the largest ones alone.
    """
    model.n_calibrated = len(wrong) if n is None else n
    model.least = settings.least
    if wrong:
        first = sorted(wrong, reverse=True)[int(settings.false_share * model.n_calibrated)]
        model.least = max(settings.least, math.nextafter(first, math.inf))


def likeness(ws: Column, names: dict[str, list[list[str]]]) -> Column:
    """The largest share of a name's word pairs, of whatever family, that the words hold."""
    all_names = F.from_json(F.lit(json.dumps([n for f in names.values() for n in f])), "array<array<string>>")
    return let(pairs_of(ws), lambda own: F.array_max(F.transform(all_names, lambda n: F.size(F.array_intersect(n, own)) / F.size(n))))


def pair_list(name: str) -> list[str]:
    ws = "".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split()
    return [" ".join(p) for p in zip(ws, ws[1:])]


def key_pairs(names: dict[str, list[list[str]]], share: float) -> str:
    """A regular expression on lowered text for pairs of which each name has one at least in whatever holds ``share`` of it."""
    keys: dict[str, set[str]] = {}
    for name in (n for f in names.values() for n in f):
        own = sorted(set(name), key=lambda p: (not set(p.split()) & set(ANCHORS), -len(p), p))
        for pair in own[: max(1, len(own) - math.ceil(share * len(name)) + 1)]:
            first, second = pair.split()
            keys.setdefault(first, set()).add(second)
    return "(?<![a-z0-9])(?:" + "|".join(f"{a}[^a-z0-9]+(?:{'|'.join(sorted(b))})" for a, b in sorted(keys.items())) + ")(?![a-z0-9])"


def judged(line: Column, m: Model) -> Column:
    """A struct for one line: the likeliest family, its probability, and how much of one of its names the line holds."""
    k = len(m.families)
    weights = F.from_json(F.lit(json.dumps(m.weights)), "map<string,array<double>>")
    names = F.from_json(F.lit(json.dumps([m.names[f] for f in m.families[:-1]])), "array<array<array<string>>>")
    start = F.array(*[F.lit(x) for x in m.intercepts])
    families = F.array(*[F.lit(f) for f in m.families])

    def add(total: Column, gram: Column) -> Column:
        return let(F.element_at(weights, gram), lambda w: F.when(w.isNull(), total).otherwise(F.zip_with(total, w, lambda a, b: a + b)))

    def verdict(ws: Column) -> Column:
        def of(logits: Column) -> Column:
            top = F.array_max(F.slice(logits, 1, k - 1))
            mass = F.aggregate(logits, F.lit(0.0), lambda t, x: t + F.exp(x - top))
            at = F.array_position(F.slice(logits, 1, k - 1), top).cast("int")
            return let(F.struct(at.alias("at"), (1 / mass).alias("p"), pairs_of(ws).alias("own")), found)

        def found(v: Column) -> Column:
            shares = F.transform(F.get(names, v.at - 1), lambda n: F.size(F.array_intersect(n, v.own)) / F.size(n))
            return F.struct(F.get(families, v.at - 1).alias("family"), v.p.alias("probability"), F.array_max(shares).alias("likeness"))

        return let(F.aggregate(features(ws), start, add), of)

    return let(words(line), verdict)


def scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_paragraphs, notices, families): the confirmed notices with line number, family, probability and likeness."""
    blank = "[^\\x20\\x09-\\x0D]"
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda x: x.rlike(blank))
    names = F.from_json(F.lit(json.dumps(model.names)), "map<string,array<array<string>>>")
    keys = key_pairs(model.names, settings.likeness)  # a cheap demand of the likeness: what lacks it isn't judged
    no_verdict = F.lit(None).cast("struct<family:string,probability:double,likeness:double>")

    def sure(j: Column) -> Column:
        return (j.probability >= model.least) & (j.likeness >= settings.likeness)

    def held_by(own: Column, family: Column) -> Column:
        return F.exists(F.element_at(names, family), lambda n: F.size(F.array_intersect(n, own)) / F.size(n) >= settings.likeness)

    def grown(x: Column, k: int) -> Column:
        """The verdict on the line and its ``k`` followers, or on more of them, if a notice needs them all."""
        if k > settings.wrapped:
            return no_verdict
        rest = F.array_join(F.slice(x.after, 1, k), " ")
        joined = F.concat_ws(" ", x.text, rest)
        found = F.when(F.lower(joined).rlike(keys), judged(joined, model))
        needed = let(found, lambda j: F.when(sure(j) & ~held_by(pairs_of(words(rest)), j.family), j))
        return F.when(F.size(x.after) >= k, let(needed, lambda j: F.when(j.isNotNull(), j).otherwise(grown(x, k + 1))))

    def verdict(x: Column) -> Column:
        return let(F.when(F.lower(x.text).rlike(keys), judged(x.text, model)), lambda j: F.when(sure(j), j).otherwise(grown(x, 1)))

    def followers(raw: Column, at: Column) -> Column:
        """Up to ``wrapped`` lines after a place, none from the first without a word on."""
        some = F.slice(raw, at + 2, settings.wrapped)
        ends = F.filter(F.transform(some, lambda y, i: F.when(~y.rlike(blank), i)), lambda i: i.isNotNull())
        return F.slice(some, 1, F.coalesce(F.array_min(ends), F.lit(settings.wrapped)))

    def notices(raw: Column) -> Column:
        own = F.filter(F.transform(raw, lambda x, i: F.struct(i.alias("at"), x.alias("text"))), lambda x: x.text.rlike(blank))
        own = F.filter(F.transform(own, lambda x, i: F.struct((i + 1).alias("line"), x["at"].alias("at"), x.text.alias("text"))), lambda x: x.text.rlike(has_anchor()))
        own = F.transform(own, lambda x: F.struct(x.line.alias("line"), x.text.alias("text"), followers(raw, x["at"]).alias("after")))
        own = F.filter(own, lambda x: F.lower(F.concat_ws(" ", x.text, F.array_join(x.after, " "))).rlike(keys))
        told = F.filter(F.transform(own, lambda x: F.struct(x.line.alias("line"), verdict(x).alias("j"))), lambda x: x.j.isNotNull())
        return F.transform(told, lambda x: F.struct(x.line.alias("line"), x.j.family.alias("family"), x.j.probability.alias("probability"), x.j.likeness.alias("likeness")))

    flat = let(F.split(content, "\n"), notices)
    none = F.array().cast("array<struct<line:int,family:string,probability:double,likeness:double>>")
    out = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.size(lines).cast("long").alias("n_paragraphs"), F.when(content.rlike(has_anchor()) & F.lower(content).rlike(keys), flat).otherwise(none).alias("notices"))
    return out.withColumn("families", F.array_sort(F.array_distinct(F.transform("notices", lambda x: x.family))))
