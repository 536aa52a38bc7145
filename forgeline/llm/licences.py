"""Licence scan with a trained paragraph classifier, with DataFrame functions and pyspark.ml only.

Paragraphs are the lines of a text. Three kinds of passages are classified: a paragraph, each of its sentences, and, for hard-wrapped
notices, the short lines from a paragraph on up to an empty one, ``WRAPPED`` at most. A sparse multinomial logistic regression over word 1- to
3-grams names a passage's licence family or `unknown`. It is trained on the families' statements and names in usual frames, with
words left out in turn but for those that tell families apart, against licences that are no family here, frames without a name, single
words, and a bounded sample of the corpus's own lines, whatever they speak of; only lines that the template comparison confirms are left out
of those. A part of all training rows, with some of the other licences as a whole, is kept out of the fit; an isotonic regression over it
turns the model's probability into the share of right names, and below ``BELIEVED`` a passage is `unknown`.

A named family is confirmed by template comparison both ways, the share of some template's words and word pairs that the passage has and the
share of the passage's that the family's templates have, and by the words that tell families apart: the passage has the family's own name
(``KEYS``) with one of its versions, or is most of a longer statement; it has no version and no mark (``MARKS``) of another family; and what it
denies, that template denies too.

Every paragraph is scored. A gram is a feature if it has a word that less than ``FREQUENT`` of the corpus sample's lines have, so each
gram that speaks for a family has a word that is rare in the sample. A paragraph without any of these words has no such gram, so its scores can't
exceed `unknown`'s: that answer of the model is known without evaluating it. Where the model doesn't allow for this,
all paragraphs are evaluated. Nothing but the numbers and names of passages with such words is shuffled.

One row is returned for each row. Null and empty texts have no paragraph and no licence; repeated rows repeat their result, a null
doc_id is a value like any other, very long lines are lines like any other, other columns are not read. Training needs no
documents: over an empty table the templates alone train it and the result is empty.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Lines of the corpus that train `unknown`; documents that they are taken from, those with the smallest hash of doc_id, and characters of each.
NEGATIVES, FROM_DOCUMENTS, SLICE = 3000, 1000, 1 << 13
#: Share of the sampled lines from which a word is frequent.
FREQUENT = 0.01
#: Calibrated probability from which a family is believed.
BELIEVED = 0.5
#: Shares of a template's, and of a passage's, words and word pairs that confirm a family.
CONTAINED, EXPLAINED = 0.6, 0.6
#: Lines that a hard-wrapped notice is looked for in, and the longest of them in characters.
WRAPPED, WIDTH = 24, 120
#: Words from which a template speaks for its family without the family's name.
LONG = 12
#: Licence families and the names they go by.
NAMES = {
    "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL version 3 or later"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 licence", "Apache Software License 2.0"),
    "bsd": ("BSD License", "BSD licence", "3-Clause BSD License", "BSD 2-Clause License", "New BSD License"),
    "cc-by-3.0": ("CC BY 3.0", "CC BY 3.0 license", "Creative Commons Attribution 3.0 Unported License"),
    "cc-by-4.0": ("CC BY 4.0", "CC BY 4.0 license", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "CC BY-NC 4.0 license", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial license"),
    "cc-by-nc-nd-4.0": ("CC BY-NC-ND 4.0", "CC BY-NC-ND 4.0 license", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "cc-by-nc-sa-4.0": ("CC BY-NC-SA 4.0", "CC BY-NC-SA 4.0 license", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nd-4.0": ("CC BY-ND 4.0", "CC BY-ND 4.0 license", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-sa-3.0": ("CC BY-SA 3.0", "CC BY-SA 3.0 license", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "cc-by-sa-4.0": ("CC BY-SA 4.0", "CC BY-SA 4.0 license", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike license"),
    "epl-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0"),
    "gpl": ("GNU General Public License", "GNU GPL"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL version 2", "GPLv2", "GNU GPL version 2 or later"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL version 3", "GPLv3", "GNU GPL version 3 or later", "GPL v3 or any later version"),
    "isc": ("ISC License", "ISC licence"),
    "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL version 2.1", "LGPLv2.1"),
    "lgpl-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL version 3", "LGPLv3"),
    "mit": ("MIT License", "MIT licence", "The MIT License (MIT)", "MIT open source license"),
    "mpl-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "public-domain": ("CC0 1.0", "CC0 1.0 Universal", "public domain dedication"),
    "unlicense": ("Unlicense", "The Unlicense"),
}
#: Licences that are no family here; those after the first six are kept out of the fit as a whole.
OTHERS = (
    "Artistic License 2.0", "Boost Software License 1.0", "zlib License", "Open Database License", "SIL Open Font License 1.1", "Common Development and Distribution License 1.0",
    "Microsoft Public License", "Python Software Foundation License version 2", "European Union Public Licence 1.2", "Sleepycat License",
)
#: Sentences that a licence is named in.
FRAMES = (
    "{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This software is available under the {}.",
    "This project is published under the terms of the {}.", "You may use this code under the {}.", "License: {}", "Copyright (c) the authors, {}.",
)
#: Paragraphs that state a licence.
STATEMENTS = {
    "agpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY.",
    ),
    "gpl": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "lgpl-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "lgpl-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "public-domain": ("This work is released into the public domain.", "Dedicated to the public domain under CC0 1.0.", "This text is in the public domain.", "No copyright: this work is in the public domain."),
    "rights-reserved": ("All rights reserved.", "All rights are reserved.", "Copyright by the authors. All rights reserved.", "Copyright (c) the authors, all rights reserved.", "No part of this work may be reproduced without permission of the copyright holder."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
}
#: What a family's own name has at least, in some way; CC families have "cc by" or "creative commons attribution" besides their marks.
KEYS = {
    "agpl-3.0": (("affero",), ("agpl",), ("agplv",)), "apache-2.0": (("apache",),), "bsd": (("bsd",),), "epl-2.0": (("eclipse",), ("epl",)), "gpl": (("gnu",),), "gpl-2.0": (("gnu",), ("gpl",), ("gplv",)), "gpl-3.0": (("gnu",), ("gpl",), ("gplv",)),
    "isc": (("isc",),), "lgpl-2.1": (("lesser",), ("lgpl",), ("lgplv",)), "lgpl-3.0": (("lesser",), ("lgpl",), ("lgplv",)), "mit": (("mit",),), "mpl-2.0": (("mozilla",), ("mpl",)), "public-domain": (("public", "domain"), ("cc", "0")), "rights-reserved": (("rights", "reserved"),), "unlicense": (("unlicense",), ("unencumbered",)),
}
#: Words that tell families apart, and words that deny.
MARKS = ("affero", "agpl", "agplv", "apache", "artistic", "boost", "bsd", "eclipse", "epl", "gpl", "gplv", "isc", "lesser", "lgpl", "lgplv", "mit", "mozilla", "mpl", "nc", "nd", "noncommercial", "noderivatives", "noderivs", "sa", "sharealike", "unlicense")
DENYING = ("aren", "cannot", "isn", "neither", "never", "no", "nor", "not", "nothing", "wasn", "weren")
#: Fixed value: what counts as a word, in lower case.
TOKEN = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
FAMILIES = sorted({*NAMES, *STATEMENTS})


def stem(family: str) -> str:
    """A family without its version: what the classifier names. Versions are for the template comparison."""
    return re.sub(r"-[0-9.]+$", "", family)


STEMS = sorted({stem(f) for f in FAMILIES})


def stated(family: str) -> list[str]:
    """All templates of a family."""
    return [*STATEMENTS.get(family, ()), *(frame.format(name) for name in NAMES.get(family, ()) for frame in FRAMES)]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_list(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def keys_of(family: str) -> list[list[str]]:
    """The words one set of which a passage has if it has the family's name."""
    if not family.startswith("cc-by"):
        return [list(k) for k in KEYS.get(family, ())]
    marks = family.split("-")[2:-1]
    spelled = [{"nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}[m] for m in marks]
    return [["cc", "by", *marks], ["creative", "commons", "attribution", *spelled]]


def versions_of(family: str) -> list[str]:
    """The numbers in a family's names, and 3.0 for 3 and the other way round."""
    found = {w for t in stated(family) for w in word_list(t) if w[0].isdigit()}
    return sorted(found | {f"{v}.0" for v in found if v.isdigit()} | {v[:-2] for v in found if v.endswith(".0")})


def grams(tokens: Column, most: int = 3) -> Column:
    """All runs of 1 to ``most`` words."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.concat(*[runs(n) for n in range(1, most + 1)])


def gram_list(tokens: list[str], most: int = 3) -> list[str]:
    return [" ".join(tokens[i : i + n]) for n in range(1, most + 1) for i in range(len(tokens) - n + 1)]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row: conditions on what comes of them are not moved before them."""
    return df.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))).select(*[c for c in df.columns if c not in columns], "_once.*")


def known(spark: SparkSession) -> DataFrame:
    """One row, _known: for each family its templates' different words and pairs, those of all its templates together, and what tells it apart."""
    rows, numbers = [], {v for f in FAMILIES for v in versions_of(f)}
    for family in FAMILIES:
        each = [(sorted(set(gram_list(word_list(t), 2))), len(word_list(t)) >= LONG) for t in stated(family)]
        own = {w for t in stated(family) for w in word_list(t)}
        foreign = sorted([m for m in MARKS if m not in own] + [v for v in numbers if v not in versions_of(family)])
        unnumbered = any(not any(w[0].isdigit() for w in word_list(n)) for n in NAMES.get(family, ("",)))
        rows.append((stem(family), family, each, sorted(set(chain(*[t for t, _ in each]))), keys_of(family), [] if unnumbered else versions_of(family), versions_of(family), foreign))
    kind = "stem: string, family: string, templates: array<struct<grams: array<string>, long: boolean>>, grams: array<string>, keys: array<array<string>>, versions: array<string>, numbers: array<string>, foreign: array<string>"
    return spark.createDataFrame([(rows,)], f"_known array<struct<{kind}>>")


def met(pairs: Column, template: Column) -> Column:
    return F.size(F.array_intersect(template["grams"], pairs)) / F.size(template["grams"])


def contained(pairs: Column, family: Column) -> Column:
    return F.array_max(F.transform(family["templates"], lambda t: met(pairs, t)))


def told_apart(pairs: Column, family: Column) -> Column:
    """Whether a passage has what tells the family apart from others, nothing that tells another one, and denies only what a template of it denies."""
    named = F.exists(family["keys"], lambda k: F.size(F.array_except(k, pairs)) == 0) & ((F.size(family["versions"]) == 0) | F.arrays_overlap(family["versions"], pairs))
    denied = F.array_intersect(pairs, F.array(*map(F.lit, DENYING)))
    stated_so = lambda t: (met(pairs, t) >= CONTAINED) & (named | t["long"]) & (F.size(F.array_except(denied, t["grams"])) == 0)
    dotted = F.filter(pairs, lambda w: F.rlike(w, F.lit(r"^[0-9]+[.][0-9.]+$")))
    return F.exists(family["templates"], stated_so) & (F.size(F.array_except(dotted, family["numbers"])) == 0) & ~F.coalesce(F.arrays_overlap(family["foreign"], pairs), F.lit(False))


def explained(pairs: Column, family: Column) -> Column:
    return F.size(F.array_intersect(pairs, family["grams"])) / F.greatest(F.size(F.array_distinct(pairs)), F.lit(1))


def confirmed_by(pairs: Column, family: Column) -> Column:
    return (explained(pairs, family) >= EXPLAINED) & (contained(pairs, family) >= CONTAINED) & told_apart(pairs, family)


def positives(spark: SparkSession) -> DataFrame:
    """(family: its stem, tokens) of the templates, with each word left out in turn from those of four or more, but for words that tell families apart."""
    rows, telling = [], {*MARKS, *(w for k in KEYS.values() for ks in k for w in ks)}
    for family in FAMILIES:
        for tokens in map(word_list, stated(family)):
            rows.append((stem(family), tokens))
            rows += [(stem(family), tokens[:i] + tokens[i + 1 :]) for i, w in enumerate(tokens) if len(tokens) > 3 and w not in telling and not w[0].isdigit()]
    return spark.createDataFrame(list(dict.fromkeys((f, tuple(t)) for f, t in rows)), "family string, tokens array<string>")


def bare(spark: SparkSession) -> DataFrame:
    """(tokens) that name nothing: the frames alone and single words of templates."""
    frames = [word_list(frame.format("")) for frame in FRAMES]
    single = sorted({w for f in FAMILIES for t in stated(f) for w in word_list(t)})
    rows = list(dict.fromkeys(tuple(t) for t in [*frames, *([w] for w in single)] if t))
    return spark.createDataFrame([(list(t),) for t in rows], "tokens array<string>")


def others(spark: SparkSession) -> DataFrame:
    """(tokens, _held) of licences that are no family, in the frames; the later ones are kept out of the fit as a whole."""
    rows = [(word_list(frame.format(name)), k >= 6) for k, name in enumerate(OTHERS) for frame in FRAMES]
    return spark.createDataFrame(rows, "tokens array<string>, _held boolean")


def sampled_lines(docs: DataFrame) -> DataFrame:
    """(tokens) of at most ``NEGATIVES`` lines of the corpus, without those that the template comparison confirms."""
    at = F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - (SLICE - 1), F.lit(1))).cast("int")
    # about three times as many as are wanted are drawn by hash first, so that what is sorted does not grow with the documents
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 3 * FROM_DOCUMENTS / max(1, docs.count())))
    some = docs.filter("text IS NOT NULL").filter(drawn).select("doc_id", F.substring("text", at, F.lit(SLICE)).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(FROM_DOCUMENTS)
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''").distinct().orderBy(F.xxhash64("line"), "line").limit(NEGATIVES)
    rows = once(once(lines, tokens=words(F.col("line"))).filter("size(tokens) > 0"), _pairs=grams(F.col("tokens"), 2))
    return rows.join(F.broadcast(known(docs.sparkSession)), F.lit(True)).filter(~F.exists("_known", lambda f: confirmed_by(F.col("_pairs"), f))).select("tokens")


class Scanner:
    """Vocabulary, regression and calibration; ``telling``: words one of which every gram that speaks for a family has (none: not known)."""

    def __init__(self, vocabulary: CountVectorizerModel, regression: LogisticRegressionModel, frequency: dict[str, float]):
        self.vocabulary, self.regression = vocabulary, regression
        self.families = [UNKNOWN, *STEMS]
        self.calibration: IsotonicRegressionModel | None = None
        gain = regression.coefficientMatrix.toArray()
        speaks = (gain[1:] - gain[0]).max(axis=0) > 0
        rare = lambda gram: min((w for w in gram.split(" ") if w.isalpha()), key=lambda w: (frequency.get(w, 0.0), w))
        start = regression.interceptVector.toArray()
        self.telling = sorted({rare(g) for g, s in zip(vocabulary.vocabulary, speaks) if s}) if (start[1:] < start[0]).all() else None

    def named(self, df: DataFrame) -> DataFrame:
        """``df`` (tokens) with _family and _probability, not calibrated."""
        rows = self.vocabulary.transform(once(df, _grams=grams(F.coalesce("tokens", F.array().cast("array<string>")))))
        rows = self.regression.transform(rows).withColumn("_all", vector_to_array("_shares"))
        family = F.get(F.array(*map(F.lit, self.families)), F.col("_prediction").cast("int"))
        return rows.withColumns({"_family": family, "_probability": F.array_max("_all")}).drop("_grams", "_features", "_raw", "_shares", "_prediction", "_all")

    def calibrate(self, held: DataFrame) -> None:
        """Learn from rows (family, tokens) how often a name with a probability is right; a name by chance is never right."""
        rows = self.named(held).filter(F.col("_family") != UNKNOWN).select("_probability", (F.col("family") == F.col("_family")).cast("double").alias("_right"))
        chance = held.sparkSession.createDataFrame([(1 / len(self.families), 0.0), (1.0, 1.0)], "_probability double, _right double")
        self.calibration = IsotonicRegression(featuresCol="_probability", labelCol="_right", predictionCol="_calibrated").fit(rows.union(chance))

    def believed(self, df: DataFrame) -> DataFrame:
        """``df`` (tokens) with family, `unknown` where none is believed, and probability, calibrated."""
        rows = self.calibration.transform(self.named(df))
        family = F.when((F.col("_family") != UNKNOWN) & (F.col("_calibrated") >= BELIEVED), F.col("_family")).otherwise(UNKNOWN)
        return rows.withColumns({"family": family, "probability": F.col("_calibrated")}).drop("_family", "_probability", "_calibrated")


def compared(df: DataFrame) -> DataFrame:
    """``df`` (tokens, family: a stem) with contained, explained and confirmed, by the templates of the stem's families, and the family that is confirmed."""
    rows = df.join(F.broadcast(known(df.sparkSession)), F.lit(True)).withColumn("_own", F.filter("_known", lambda f: f["stem"] == F.col("family"))).drop("_known")
    rows = once(rows, _pairs=grams(F.coalesce("tokens", F.array().cast("array<string>")), 2))
    most = lambda share: F.coalesce(F.array_max(F.transform("_own", lambda f: share(F.col("_pairs"), f))), F.lit(0.0))
    rows = once(rows, contained=most(contained), explained=most(explained), _good=F.get(F.filter("_own", lambda f: confirmed_by(F.col("_pairs"), f)), F.lit(0))["family"])
    return rows.withColumns({"confirmed": F.col("_good").isNotNull(), "family": F.coalesce("_good", "family")}).drop("_own", "_pairs", "_good")


def train(docs: DataFrame) -> Scanner:
    spark, families = docs.sparkSession, [UNKNOWN, *STEMS]
    hashed = F.pmod(F.xxhash64("tokens"), F.lit(3)) == 0
    shorter = F.size("tokens") > 3  # short names stay in the fit
    corpus = sampled_lines(docs).withColumn("_line", F.lit(True)).unionByName(bare(spark).withColumn("_line", F.lit(False))).withColumn("family", F.lit(UNKNOWN))
    rows = corpus.unionByName(positives(spark).withColumn("_line", F.lit(False))).withColumn("_held", hashed & shorter)
    rows = rows.unionByName(others(spark).withColumns({"_line": F.lit(False), "family": F.lit(UNKNOWN)}))
    rows = rows.withColumn("_grams", grams(F.col("tokens"))).coalesce(4).cache()
    try:
        # how many sampled lines have each word of the templates: some hundred rows
        own = sorted({g for f in FAMILIES for t in stated(f) for g in gram_list(word_list(t))})
        lines = rows.filter("_line")
        total = max(1, lines.count())
        wanted = spark.createDataFrame([(g,) for g in own if " " not in g], "w string")
        counts = lines.select(F.explode(F.array_distinct("tokens")).alias("w")).groupBy("w").count().join(F.broadcast(wanted), "w", "left_semi").collect()
        frequency = {r["w"]: r["count"] / total for r in counts}
        rare = lambda w: w.isalpha() and frequency.get(w, 0.0) < FREQUENT
        vocabulary = CountVectorizerModel.from_vocabulary([g for g in own if any(map(rare, g.split(" ")))], inputCol="_grams", outputCol="_features")
        vocabulary.setBinary(True)
        label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
        regression = LogisticRegression(featuresCol="_features", predictionCol="_prediction", probabilityCol="_shares", rawPredictionCol="_raw", maxIter=60, regParam=0.0005, elasticNetParam=0.5, family="multinomial").fit(vocabulary.transform(rows.filter("NOT _held").withColumn("label", label)))
        scanner = Scanner(vocabulary, regression, frequency)
        scanner.calibrate(rows.filter("_held").select("family", "tokens"))
        return scanner
    finally:
        rows.unpersist()


def tells(text: Column, telling: list[str] | None) -> Column:
    """Whether a text has a telling word: only then can its score for a family exceed that for `unknown`."""
    return F.exists(F.split(F.lower(text), "[^a-z]+"), lambda w: w.isin(*telling)) if telling is not None else F.lit(True)


def passages(docs: DataFrame, telling: list[str] | None) -> DataFrame:
    """(doc_id, digest, paragraph, wrapped, tokens) of the paragraphs that may be more than `unknown`, their sentences and wrapped lines."""
    lines = F.split("text", "\n")
    numbered = F.filter(F.transform(lines, lambda line, k: F.struct(k.alias("no"), line.alias("line"))), lambda p: tells(p["line"], telling))
    rows = docs.filter(tells(F.col("text"), telling)).select("doc_id", F.xxhash64("text").alias("digest"), lines.alias("_lines"), F.explode(numbered).alias("_p"))
    ahead = F.slice("_lines", F.col("_p.no") + 1, WRAPPED)
    empty = F.array_position(F.transform(ahead, lambda line: F.trim(line) == ""), True)
    block = F.slice(ahead, F.lit(1), F.when(empty > 0, empty.cast("int") - 1).otherwise(F.lit(WRAPPED)))
    window = F.array_join(F.filter(block, lambda line: F.length(line) <= WIDTH), " ")
    sentences = F.filter(F.split("_p.line", r"(?<=[.!?;])\s+"), lambda s: tells(s, telling))
    parts = F.concat(
        F.array(F.struct(F.lit(False).alias("wrapped"), F.col("_p.line").alias("text"))),
        F.transform(sentences, lambda s: F.struct(F.lit(False).alias("wrapped"), s.alias("text"))),
        F.array(F.struct(F.lit(True).alias("wrapped"), window.alias("text"))),
    )
    found = rows.select("doc_id", "digest", F.col("_p.no").alias("paragraph"), F.explode(F.array_distinct(parts)).alias("_t"))
    return once(found.select("doc_id", "digest", "paragraph", F.col("_t.wrapped").alias("wrapped"), F.col("_t.text").alias("_text")), tokens=words(F.col("_text"))).drop("_text")


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_candidates (paragraphs named), n_licences (confirmed), licences (families, joined by commas; empty: none).

    n_licences counts the paragraphs that are confirmed, and the families that only wrapped lines confirm.
    """
    rows = docs.select("doc_id", "text")
    scanner = scanner or train(rows)
    found = compared(scanner.believed(passages(rows, scanner.telling)).filter(F.col("family") != UNKNOWN))
    alone, wrapped = F.col("confirmed") & ~F.col("wrapped"), F.col("confirmed") & F.col("wrapped")
    of = found.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.count_distinct(F.when(~F.col("wrapped"), F.col("paragraph"))).alias("_candidates"), F.count_distinct(F.when(alone, F.col("paragraph"))).alias("_alone"),
        F.collect_set(F.when(alone, F.col("family"))).alias("_families"), F.collect_set(F.when(wrapped, F.col("family"))).alias("_more"),
    )
    n = F.when(F.length("text") > 0, F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).otherwise(0).cast("long")
    each = rows.select("doc_id", F.xxhash64("text").alias("digest"), n.alias("n_paragraphs"))
    all_of = F.array_union("_families", "_more")
    # a line of a notice can name a licence without the version that the whole notice has
    versioned = F.filter(all_of, lambda x: ~F.exists(all_of, lambda y: F.startswith(y, F.concat(x, F.lit("-")))))
    joined = each.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(
        "doc_id",
        "n_paragraphs",
        F.coalesce("_candidates", F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce(F.col("_alone") + F.size(F.array_except("_more", "_families")), F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce(F.array_join(F.sort_array(versioned), ","), F.lit("")).alias("licences"),
    )
