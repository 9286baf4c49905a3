"""License scan: a trained paragraph classifier finds licence families, templates confirm them. DataFrame and SQL functions,
with Spark's own logistic regression; no Python on the executors.

Texts are looked at in windows of words: those of each line, and those that run over line ends. Their features are word
n-grams, those of the templates and near misses below; a multinomial logistic regression over families and "unknown" is
fitted on windows of these and on the windows of all lines of the corpus, each once. Only their known n-grams are shuffled,
and windows that have the same ones are a row with a count. The weights are then literals of one projection over the
documents, so that every window of every text is scored where it lies: nothing more is shuffled, and rows need no id.
Most windows are settled by a bound: each n-gram's greatest weight for a family above its weight for "unknown". Where these
do not add up to what a family needs, no family can win.

Probabilities are calibrated: the threshold for a family is the highest that a share of UNKNOWN_RATE of the held-out half of
the corpus's windows reaches, of those that no template confirms. A prediction holds if the window also shares enough n-grams with
a template of the family.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import stored, table, unused, whole

#: Words of well-known licence notices, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under Apache 2.0.",
        "Apache 2.0",
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied, Apache License",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Distributed under the GNU GPL v3.",
        "GPLv3",
        "GPLv2",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD-3-Clause",
        "BSD-2-Clause",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "CC-BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal public domain dedication."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright (c) All rights reserved. Unauthorized copying, reproduction or distribution is strictly prohibited.", "This document is confidential and proprietary; no license is granted."],
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
#: Notices that are of no family: they must stay unknown. Every other one is held out for the threshold.
NEAR_MISSES = ["This work is licensed under terms that are given elsewhere.", "See the license for details.", "The license plate was read by the camera.", "Permission is granted to enter the building.", "Released under pressure in version 2.0.", "The terms of the contract are under review by the public.", "All rights of way are reserved for cyclists."]
#: Hash classes of n-grams; share of the held-out windows that may pass; least probability.
CLASSES, UNKNOWN_RATE, LEAST = 1 << 15, 0.0005, 0.5
#: What a template's or near miss's window weighs in the fit; what all windows of the corpus weigh together, in either half, at
#: most: more of them weigh less each, so that a large corpus does not drown the templates.
OWN, CORPUS = 20.0, 2_000
#: Least share of a window's n-grams, or of a template's, that the two must have in common to confirm.
CONFIRM = 0.5
#: Words of a window, and words from one to the next.
WINDOW, STEP = 16, 8


def words(text: str) -> str:
    """SQL of the words of a text, without stops at their ends. Matches begin where a run begins, so that long runs of stops take
    linear time."""
    return f"regexp_extract_all(lower({text}), '(?<![a-z0-9.+-])[a-z0-9.+-]*[a-z0-9]', 0)"


def grams(w: str) -> str:
    """SQL of the words w and the pairs of them, each once."""
    pairs = f"CASE WHEN size({w}) > 1 THEN transform(sequence(1, size({w}) - 1), i -> concat({w}[i - 1], ' ', {w}[i])) ELSE cast(array() AS array<string>) END"
    return f"array_distinct(concat({w}, {pairs}))"


def hashed(what: str) -> str:
    return f"cast(xxhash64({what}) & {CLASSES - 1} AS int)"


def starts(n: str) -> str:
    """SQL of where the windows of n words begin."""
    return f"CASE WHEN {n} <= 0 THEN cast(array() AS array<int>) WHEN {n} <= {WINDOW} THEN array(0) ELSE sequence(0, {n} - {STEP} - 1, {STEP}) END"


def let(value: str, name: str, then: str) -> str:
    """SQL of `then`, in which `name` is value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def by_line(rows: DataFrame, text: str) -> DataFrame:
    """w (words) of each line of rows."""
    return rows.select(F.explode(F.split(text, "\n", -1)).alias("line")).select(F.expr(words("line")).alias("w"))


def literal(values: object, kind: str) -> str:
    """SQL of a literal; Spark folds it once."""
    return f"from_json('{json.dumps(values, separators=(',', ':'))}', '{kind}')"


class Model:
    """The fitted classifier as SQL. ordinary has w (words) of each line of the corpus. Its windows count once, if they are equal by
    64 bits of hash and their known n-grams; by that hash one half is held out."""

    def __init__(self, spark: SparkSession, ordinary: DataFrame):
        own = [(float(FAMILIES.index(k)), t, False) for k, ts in TEMPLATES.items() for t in ts] + [(0.0, t, k % 2 == 1) for k, t in enumerate(NEAR_MISSES)]
        own = spark.createDataFrame(own, "label double, paragraph string, held boolean")
        own = own.withColumn("all", F.expr(words("paragraph"))).withColumn("at", F.explode(F.expr(starts("size(all)"))))
        own = own.select("label", "held", F.expr(grams(f"slice(all, at + 1, {WINDOW})")).alias("g"))
        own = own.withColumn("classes", F.expr(f"transform(g, x -> {hashed('x')})")).collect()  # no more than the texts above
        of = {x: k for r in own for x, k in zip(r.g, r.classes, strict=True)}
        self.names = sorted(of, key=lambda x: (" " in x, x))  # words first
        code = {x: k for k, x in enumerate(self.names)}
        self.templates = [{"f": int(r.label), "t": sorted(code[x] for x in r.g)} for r in own if r.label]
        rows = ordinary.select(F.expr(f"inline({self.patterns('w', of)})")).distinct().withColumn("part", F.expr("cast(pmod(h, 2) AS int)"))
        rows = stored(rows.groupBy("part", "g", "n").agg(F.count("*").alias("times")), "patterns")
        total = {r.part: r.times for r in rows.groupBy("part").agg(F.sum("times").alias("times")).collect()}
        names = CountVectorizerModel.from_vocabulary([str(k) for k in range(len(code))], inputCol="names", outputCol="features").setBinary(True)
        mine = spark.createDataFrame([(int(r.held), r.label, [code[x] for x in r.g], len(r.g)) for r in own], "part int, label double, g array<int>, n int")
        each = min(1.0, CORPUS / total.get(0, 1))
        #: the corpus has notices too: what a template confirms is not fitted as unknown
        fit = rows.where("part = 0").where(f"NOT {self.confirms('g', 'n', 'true')}").groupBy("g").agg((F.sum("times") * each).alias("weight")).select(F.lit(0.0).alias("label"), "g", "weight")
        fit = fit.unionByName(mine.where("part = 0").select("label", "g", F.lit(OWN).alias("weight")))
        fit = names.transform(fit.withColumn("names", F.expr("transform(g, x -> cast(x AS string))"))).select("label", "weight", "features")
        fitted = LogisticRegression(family="multinomial", regParam=0.002, maxIter=30, weightCol="weight").fit(fit)
        weight, base = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
        self.families = literal([{"b": round(float(b), 5), "w": [round(float(x), 5) for x in w]} for b, w in zip(base, weight, strict=True)], "array<struct<b:double,w:array<double>>>")
        gain = (weight[1:] - weight[0]).max(0).clip(0)
        #: by hash class: of words, -1 for those of no template, and of pairs, which begin with a template's word
        ones, twos = [-1] * CLASSES, [0] * CLASSES
        for x, k in of.items():
            by_class = twos if " " in x else ones
            by_class[k] = max(by_class[k], round(float(gain[code[x]]) + 1e-5, 5))
        self.ones, self.twos = literal(ones, "array<double>"), literal(twos, "array<double>")
        #: what the gains of a window must add up to: below, even all families together are less probable than unknown
        self.need = float(base[0] - base[1:].max()) - math.log(len(FAMILIES) - 1) - 1e-3
        self.least = 0.0
        near = max(1, round(total.get(1, 0) / CORPUS))  # a near miss counts as much beside a large corpus as beside a small one
        held = rows.where("part = 1").select("g", "n", "times").unionByName(mine.where("part = 1").select("g", "n", F.lit(near).cast("long").alias("times")))
        held = held.select("times", F.expr(self.judged("g", "n")).alias("x")).where("NOT x.confirmed")
        #: to five digits, so that few rows are left however many windows there are
        held = held.groupBy(F.round("x.score", 5).alias("score")).agg(F.sum("times").alias("times"))
        seen = held.agg(F.percentile("score", 1 - UNKNOWN_RATE, F.col("times")).alias("p")).first()["p"]
        self.least = max(LEAST, min(seen or 0.0, 0.9))

    def patterns(self, w: str, of: dict[str, int]) -> str:
        """SQL of (g, n, h) of each window of a line's words w: the numbers, ascending, of its n-grams that the model knows, which are
        coded(grams()) without a string for each pair; its n-grams; a hash of its words. `of` has the n-grams' hash classes."""
        single = [x for x in self.names if " " not in x]
        first, after, depth = [-1] * CLASSES, [-1] * len(single), 1
        for k, x in enumerate(single):  # words of one class are a chain
            first[of[x]], after[k] = k, first[of[x]]
        for k in range(len(single)):
            n = 1
            while after[k] >= 0:
                k, n = after[k], n + 1
            depth = max(depth, n)
        pairs = [-1] * len(single) ** 2
        place = {x: k for k, x in enumerate(single)}
        for k, (a, b) in ((k, x.split(" ")) for k, x in enumerate(self.names) if " " in x):
            pairs[place[a] * len(single) + place[b]] = k
        names, first, after, pairs = literal(single, "array<string>"), literal(first, "array<int>"), literal(after, "array<int>"), literal(pairs, "array<int>")
        chain = ["k"]
        while len(chain) < depth:
            chain.append(f"get({after}, {chain[-1]})")
        word = f"CASE WHEN k < 0 THEN -1 {' '.join(f'WHEN get({names}, {k}) = {w}[i] THEN {k}' for k in chain)} ELSE -1 END"
        ones = f"transform(transform({w}, x -> get({first}, {hashed('x')})), (k, i) -> {word})"
        twos = f"transform(ones, (k, i) -> CASE WHEN k < 0 OR coalesce(get(ones, i + 1), -1) < 0 THEN -1 ELSE get({pairs}, k * {len(single)} + get(ones, i + 1)) END)"
        g = f"sort_array(array_distinct(array_remove(concat(slice(ones, s + 1, {WINDOW}), slice(twos, s + 1, {WINDOW - 1})), -1)))"
        each = f"named_struct('g', {g}, 'n', 2 * least({WINDOW}, size({w}) - s) - 1, 'h', xxhash64(slice({w}, s + 1, {WINDOW})))"
        return let(ones, "ones", let(twos, "twos", f"transform({starts(f'size({w})')}, s -> {each})"))

    def coded(self, g: str) -> str:
        """SQL of the numbers of the n-grams g that the model knows."""
        names = literal(self.names, "array<string>")
        return f"transform(array_intersect({g}, {names}), x -> cast(array_position({names}, x) AS int) - 1)"

    def gains(self, w: str) -> str:
        """SQL of bounds on what each of the words w and the pair that begins with it add for a family."""
        pair = f"coalesce(get({self.twos}, {hashed(f'concat({w}[i], \' \', get({w}, i + 1))')}), 0D)"
        each = let(f"get({self.ones}, {hashed(f'{w}[i]')})", "u", f"CASE WHEN u < 0 THEN 0D ELSE u + {pair} END")
        return f"CASE WHEN size({w}) > 0 THEN transform(sequence(0, size({w}) - 1), i -> {each}) ELSE cast(array() AS array<double>) END"

    def confirms(self, g: str, n: str, which: str) -> str:
        """SQL of whether one of those templates t for which `which` holds confirms the codes g of a window of n n-grams."""
        common = f"array_max(transform(filter({literal(self.templates, 'array<struct<f:int,t:array<int>>>')}, t -> {which}), t -> size(array_intersect(t.t, {g})) / greatest(1, least(size(t.t), {n}))))"
        return f"coalesce({common} >= {CONFIRM}, false)"

    def judged(self, g: str, n: str) -> str:
        """SQL of family, score (its probability), any (that of all families) and confirmed of the codes of a window of n
        n-grams."""
        z = f"transform({self.families}, f -> f.b + aggregate({g}, 0D, (a, x) -> a + get(f.w, x)))"
        p = let(z, "z", let("array_max(z)", "m", let("transform(z, x -> exp(x - m))", "e", "transform(e, x -> x / aggregate(e, 0D, (a, y) -> a + y))")))
        best = "array_max(transform(slice(p, 2, size(p)), (x, i) -> struct(x AS p, -i AS i)))"
        out = f"named_struct('family', get({literal(FAMILIES, 'array<string>')}, 1 - best.i), 'score', best.p, 'any', 1 - p[0], 'confirmed', {self.confirms(g, n, 't.f = 1 - best.i')})"
        return let(p, "p", let(best, "best", out))

    def likely(self, w: str) -> str:
        """SQL of the starts, as multiples of STEP, in the words w from which on a window may be likelier a notice than not. A
        line's window lies within three steps from such a start on, and all gains count, whether or not it holds the pair."""
        block = f"aggregate(slice(gains, {STEP} * k + 1, {WINDOW + STEP}), 0D, (a, x) -> a + x)"
        return let(self.gains(w), "gains", f"CASE WHEN size(gains) > 0 THEN filter(sequence(0, (size(gains) - 1) div {STEP}), k -> {block} >= {self.need}) ELSE cast(array() AS array<int>) END")

    def found(self, text: str, w: str, starts_at: str) -> str:
        """SQL of an array of (line, last, any, family, score, confirmed), for the windows of a text that are likelier a notice
        than not: those of lines, and those over line ends that begin at starts_at of its words w. family is unknown where
        the score is below the threshold or no template confirms it."""
        window = lambda line, last, w: f"named_struct('line', {line}, 'last', {last}, 'w', {w})"
        total = lambda w: f"aggregate({self.gains(w)}, 0D, (a, x) -> a + x) >= {self.need}"
        alone = f"flatten(transform(filter(lines, l -> {total('l.w')}), l -> transform({starts('size(l.w)')}, s -> {window('l.line', 'l.line', f'slice(l.w, s + 1, {WINDOW})')})))"
        over = f"filter(transform({starts_at}, k -> {window(f'of[{STEP} * k]', f'of[least({STEP} * k + {WINDOW}, size(of)) - 1]', f'slice({w}, {STEP} * k + 1, {WINDOW})')}), x -> x.line < x.last)"
        both = let("flatten(transform(lines, l -> transform(l.w, x -> l.line)))", "of", f"concat({alone}, {over})")
        lines = f"filter(transform(split({text}, '\\n', -1), (t, i) -> struct(i AS line, {words('t')} AS w)), l -> size(l.w) > 0)"
        some = f"filter({let(lines, 'lines', both)}, x -> {total('x.w')})"
        known = let(grams("x.w"), "g", let(self.coded("g"), "c", self.judged("c", "size(g)")))
        judged = let(known, "j", f"named_struct('line', x.line, 'last', x.last, 'any', j.any, 'family', CASE WHEN j.confirmed AND j.score >= {self.least} THEN j.family ELSE '{UNKNOWN}' END, 'score', j.score, 'confirmed', j.confirmed)")
        return f"filter(transform({some}, x -> {judged}), x -> x.any >= {LEAST})"


def notices(docs: DataFrame) -> DataFrame:
    """docs with `notices`, an array of (line, family, score, confirmed): one for each line (0 first) that is likelier a
    notice than not, or in which a window begins that is of a family over line ends.

    Every window of every whole text is searched. family is unknown where the score is below the calibrated threshold or no
    template confirms it. A window over line ends counts if it is of a family that none of its lines is found to be of.
    Null and empty texts have an empty array. Rows are judged one by one: nulls elsewhere, repeated rows and other columns
    stay as they are, but a column named notices is replaced. An empty table gives an empty table. The model and its threshold
    come from all lines of all rows: each distinct window of a line is in one of two halves, by its hash.
    """
    model = Model(docs.sparkSession, by_line(docs.select(whole().alias("text")), "text"))
    text, w, at = unused(docs.columns, "text_of", "words_of", "starts_of")
    out = docs.withColumn(text, whole()).withColumn(w, F.expr(words(text))).withColumn(at, F.expr(model.likely(w)))
    none = "cast(array() AS array<struct<line:int,last:int,any:double,family:string,score:double,confirmed:boolean>>)"
    best = "array_max(transform({}, x -> struct(x.family <> '" + UNKNOWN + "' AS known, x.score AS score, x.family AS family, x.confirmed AS confirmed, -x.line AS line)))"
    alone = "filter(found, x -> x.line = x.last)"
    of_line = f"transform(array_distinct(transform({alone}, x -> x.line)), l -> {best.format('filter(' + alone + ', x -> x.line = l)')})"
    wrapped = f"filter(found, o -> o.line < o.last AND o.family <> '{UNKNOWN}' AND NOT exists(found, x -> x.line = x.last AND x.family = o.family AND x.line BETWEEN o.line AND o.last))"
    by_family = let(wrapped, "ws", f"transform(array_distinct(transform(ws, x -> x.family)), f -> {best.format('filter(ws, x -> x.family = f)')})")
    rows = f"array_sort(transform(concat({of_line}, {by_family}), x -> struct(-x.line AS line, x.family AS family, x.score AS score, x.confirmed AS confirmed)))"
    found = f"CASE WHEN size({at}) > 0 THEN {model.found(text, w, at)} ELSE {none} END"
    return out.withColumn("notices", F.expr(let(found, "found", rows))).drop(w, text, at)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, line, family, score, confirmed of each of notices()."""
    rows = notices(docs.select("doc_id", "text")).select("doc_id", F.explode_outer("notices").alias("x"))  # no filter, which would compute them twice
    return rows.where("x IS NOT NULL").select("doc_id", "x.*")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its families, and how many notices stay unknown."""
    out = notices(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.array_join(F.expr(f"array_sort(array_distinct(transform(filter(notices, x -> x.family <> '{UNKNOWN}'), x -> x.family)))"), ",").alias("families"),
        F.expr(f"cast(size(filter(notices, x -> x.family = '{UNKNOWN}')) AS bigint)").alias("n_unknown"),
        F.size("notices").cast("long").alias("n_notices"),
    )
