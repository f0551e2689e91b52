"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Units of text are compared with the templates: every line of any file that speaks of a license (a header or notice),
the whole text of files that are named as license files, and windows of terms over the whole text, whatever its lines:
where a term of a template stands, as many terms as the template has, laid so that both have that term in one place.
So a notice within a long line or wrapped over several ones is a unit of its own. Equal units are scored once. A unit's vector has one entry
per term, its count times the term's inverse document frequency over all units and templates; terms of no template
count in the norm. A file's own license is that of its best unit. A directory has the license of its license files; a
file without its own takes that of its nearest ancestor directory, found by joining its ancestors' paths.

All of it is DataFrame operations.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, WORD, numbered, small, stored, table

#: Names of well-known licenses, the notices that grant them, and how the licenses' own texts begin.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is free software licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons Attribution-ShareAlike license, CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial license, CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license."),
    ("Proprietary", "Copyright. All rights reserved. No license is granted."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007. Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble: The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991. Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble: The licenses for most software are designed to take away your freedom to share and change it."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007. Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999. Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007. Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble: The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "Mozilla Public License Version 2.0. Definitions: Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. This software is provided by the copyright holders and contributors as is"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "By exercising the Licensed Rights, You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License."),
    ("EPL-2.0", "Eclipse Public License v 2.0. The accompanying program is provided under the terms of this Eclipse Public License."),
)
#: A line with none of these speaks of no license; every template has one.
SPEAKS = r"(?i)licen[sc]|copyright|spdx|permission is hereby|free software|public domain"
#: The same over line ends and the marks of comments.
SPEAKS_WRAPPED = r"(?i)licen[sc]|copyright|spdx|permission\W+is\W+hereby|free\W+software|public\W+domain"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"
LEAST_COSINE = 0.6
#: Terms of a template that windows are laid by: those in the fewest templates.
ANCHORS = 12
#: Terms that no window is laid by, and the least share of a template's terms that its window must have.
COMMON = frozenset("a all and any as by for in is it may no not of or the this to under with you".split())
LEAST_SHARED = 0.34


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory_of(path: Column) -> Column:
    """The path without its last part; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def anchors(bags: list[list[str]]) -> dict[str, list[tuple[int, int, int]]]:
    """For each term that windows are laid by: its (place, terms of the template, number of the template)."""
    seen = Counter(term for bag in bags for term in set(bag))
    places: dict[str, list[tuple[int, int, int]]] = {}
    for k, bag in enumerate(bags):
        own = sorted({t for t in bag if t not in COMMON}, key=lambda t: (seen[t], bag.index(t)))[:ANCHORS]
        for at, term in enumerate(bag):
            if term in own:
                places.setdefault(term, []).append((at, len(bag), k))
    return places


def windows(text: Column) -> Column:
    """The windows of terms of a text, as an array of texts."""
    bags = [re.findall(TERM, t.lower()) for _, t in TEMPLATES]
    places = anchors(bags)
    spot = lambda at, n, k: F.struct(F.lit(at).alias("at"), F.lit(n).alias("n"), F.lit(k).alias("k"))
    lookup = F.create_map(*[x for term, spots in places.items() for x in (F.lit(term), F.array(*[spot(*p) for p in spots]))])
    template = F.array(*[F.array(*map(F.lit, dict.fromkeys(bag))) for bag in bags])

    def laid_over(all_terms: Column) -> Column:
        at = F.filter(F.transform(all_terms, lambda t, i: F.when(t.isin(list(places)), i)), lambda i: i.isNotNull())
        # a window is one number (its start, its length, its template), so that equal ones are found by their hash
        lay = lambda i, p: F.greatest(i - p["at"], F.lit(0)).cast("bigint") * (1 << 24) + (p["n"] + F.least(i - p["at"], F.lit(0))) * (1 << 12) + p["k"]
        laid = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.element_at(lookup, F.get(all_terms, i)), lambda p: lay(i, p)))))
        own = lambda w: F.slice(all_terms, F.shiftright(w, 24).cast("int") + 1, F.shiftright(w, 12).bitwiseAND(F.lit(4095)).cast("int"))
        of = lambda w: F.get(template, w.bitwiseAND(F.lit(4095)).cast("int"))
        near = F.filter(laid, lambda w: F.size(F.array_intersect(own(w), of(w))) >= F.size(of(w)) * LEAST_SHARED)
        return F.array_distinct(F.transform(near, lambda w: F.array_join(own(w), " ")))

    # as a lambda's variable, the terms are taken once
    return F.flatten(F.transform(F.array(terms(text)), laid_over))


def units_of(files: DataFrame) -> DataFrame:
    """(ROW, path, whole, unit): the license-speaking lines and windows of each file, and the whole text of license files."""
    text = F.coalesce("text", F.lit(""))
    whole = F.coalesce(name_of(F.col("path")).rlike(LICENSE_FILE), F.lit(False))
    lines = F.filter(F.split(text, r"\R"), lambda x: x.rlike(SPEAKS))
    none = F.array().cast("array<string>")
    own = F.when(whole, F.array(text)).when(text.rlike(SPEAKS), lines).otherwise(none)
    units = F.concat(own, F.when(text.rlike(SPEAKS_WRAPPED), windows(text)).otherwise(none))
    return files.select(ROW, "path", whole.alias("whole"), F.explode(units).alias("unit"))


def scored(units: DataFrame, least: float, more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(address, license, score) of each distinct unit whose best template reaches `least`; ties go to the first name.

    Templates are TEMPLATES and `more`. units: (address, unit), distinct. Terms of equal documents are counted in their tasks before any shuffle.
    """
    spark = units.sparkSession
    templates = spark.createDataFrame([(f"t{i}", name, text) for i, (name, text) in enumerate((*TEMPLATES, *more))], "template string, license string, text string")
    count = lambda df, key, text: df.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    # dealt by address, a unit's terms stay together: their counts need no shuffle, and their products are summed in the task
    tf = stored(count(units.repartition("address"), "address", "unit"), "license-terms")
    template_tf = count(templates, "template", "text")
    seen = tf.select("term", F.lit(1).alias("x")).unionAll(template_tf.select("term", F.lit(1).alias("x"))).groupBy("term").agg(F.count("x").alias("df"))
    n = units.count() + len(TEMPLATES) + len(more)
    idf = stored(seen.select("term", (F.log((F.lit(1.0) + n) / (F.col("df") + 1.0)) + 1.0).alias("idf")), "license-idf")
    weigh = lambda df, idf: df.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    template_w = weigh(template_tf, idf)
    norms = template_w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    # a few hundred rows by construction: the terms of the fixed templates
    template_w = F.broadcast(stored(template_w.join(norms, "template").select("term", "template", (F.col("w") / F.col("norm")).alias("u")), "license-templates"))
    weighed = stored(weigh(tf, small(idf, 200_000)).select("address", "term", "w"), "license-weights")
    lengths = weighed.groupBy("address").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    dots = weighed.join(template_w, "term").groupBy("address", "template").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
    names = F.broadcast(templates.select("template", "license"))  # one row a template
    cosines = dots.join(lengths, "address").join(names, "template").select("address", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    return cosines.groupBy("address").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("address", "b.license", (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, least: float = LEAST_COSINE, keep: tuple[str, ...] = (), whole_texts: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(path, own_license, own_score, license, inherited_from) and the columns of `keep` for every row of files (path, text).

    A null text is empty; a null path has no ancestors. license is the file's own, else its nearest licensed ancestor's,
    else null; inherited_from is that ancestor directory. Of a directory's license files the best-scoring decides, ties
    by license name. Rows that repeat a path have each its own license. whole_texts are more templates (license, text),
    such as full license texts, that license files are compared with as a whole.
    """
    files = numbered(files.select("path", "text", *keep))
    units = stored(units_of(files).withColumn("address", F.unhex(F.substring(F.sha2("unit", 256), 1, 32))), "license-units")
    distinct = stored(units.groupBy("address").agg(F.any_value("unit").alias("unit")), "license-distinct")
    scores = stored(scored(distinct, least, whole_texts), "license-scores")
    hits = units.select(ROW, "path", "whole", "address").join(small(scores, 200_000), "address")
    best = F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")
    own = stored(hits.groupBy(ROW).agg(best, F.max("whole").alias("whole"), F.any_value("path").alias("of")).select(ROW, "of", "whole", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("own_score")), "license-own")
    by_directory = own.where("whole").select(directory_of(F.col("of")).alias("directory"), "own_license", "own_score").groupBy("directory").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("license"))).alias("b"))
    by_directory = stored(by_directory.select("directory", F.col("b.license").alias("inherited")), "license-directories")

    # each directory looks up its ancestors once, however many files it holds
    directories = files.where("path is not null").select(directory_of(F.col("path")).alias("own_directory")).distinct()
    parts = F.when(F.col("own_directory") == "", F.array().cast("array<string>")).otherwise(F.split("own_directory", "/"))
    ancestors = directories.withColumn("parts", parts).select("own_directory", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("parts", F.lit(1), k), "/").alias("directory")))).alias("a")).select("own_directory", "a.*")
    nearest = ancestors.join(small(by_directory, 200_000), "directory").groupBy("own_directory").agg(F.max_by(F.struct("directory", "inherited"), "depth").alias("n"))
    nearest = stored(nearest.select("own_directory", F.col("n.directory").alias("ancestor"), F.col("n.inherited").alias("inherited")), "license-nearest")
    named = files.select(ROW, "path", *keep, directory_of(F.col("path")).alias("own_directory"))
    out = named.join(small(own.select(ROW, "own_license", "own_score"), 200_000), ROW, "left").join(small(nearest, 200_000), "own_directory", "left")
    return out.select(*keep, "path", "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"), F.when(F.col("own_license").isNull(), F.col("ancestor")).alias("inherited_from"))


def files_of_documents(docs: DataFrame) -> DataFrame:
    """documents as a tree of files (doc_id, path, text): source / hundreds / document.

    A document that says nothing but its license (at most 25 words, and it speaks of one) is its directory's LICENSE. A
    source is a directory of its own, whatever signs it has: % and / are percent-encoded, and no source is "%".
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    name = F.when((words <= 25) & F.coalesce("text", F.lit("")).rlike(SPEAKS), F.concat(F.lit("LICENSE-"), number)).otherwise(number)
    source = F.coalesce(F.replace(F.replace("source", F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("%"))
    return docs.select("doc_id", F.concat_ws("/", source, F.floor(F.col("doc_id") / 100).cast("string"), name).alias("path"), "text")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its path, its own license with the cosine, and the license that holds for it."""
    return scan(files_of_documents(table(spark, sf_dir, "documents")), keep=("doc_id",))
