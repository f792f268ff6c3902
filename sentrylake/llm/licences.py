"""Licence scan: TF-IDF cosine to licence templates, then inheritance along directories.

Everything is DataFrame operations. Sentences that mention a licence, and whole licence
files, become sparse vectors (segment, token, weight) that are joined with the templates'
vectors; the sum of products is the cosine. Headers count as a whole as well: paragraphs
without their comment signs, and their sentences joined over line feeds, are compared with these
templates and with the standard notices and titles of whole licences. SPDX lines name
their licence. A file without a licence of its own
takes that of the licence file in its nearest ancestor directory, found by joining the
directories' ancestor paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: Smallest cosine that counts as a licence.
COSINE = 0.6
#: Names of licence files (whole name, case ignored).
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-][a-z0-9.-]*)?$"
#: A sentence without any of these is no licence statement.
MARKERS = ("licen", "copyright", "public domain", "hereby granted", "redistribution")
SENTENCE_END = r"\n|(?<=[.!?])\s+"
NOT_TOKEN = r"[^a-z0-9.+-]+|[.-]+(?![a-z0-9])"

# The usual notices of public licences, a name and one or more wordings each.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Released under the ISC License."),
    ("proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."),
)

#: What else tells of a licence in a header.
HEADER_MARKERS = (*MARKERS, "spdx", "free software", "redistribut", "creative commons", "gpl", "rights reserved")
COMMENT_SIGNS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|<!--+|%+|\.\.|dnl\b)?[ \t]*"
SPDX = r"(?i)SPDX-License-Identifier:\s*\(?\s*([a-z0-9.+-]+)"


def _gnu(name: str, version: str, subject: str = "program") -> str:
    return (
        f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} License "
        f"as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    )


# Standard notices of whole headers, and the titles of whole licence texts.
HEADERS: tuple[tuple[str, str], ...] = (
    ("GPL-2.0", _gnu("General Public", "2")), ("GPL-3.0", _gnu("General Public", "3")),
    ("LGPL-2.1", _gnu("Lesser General Public", "2.1", "library")), ("LGPL-3.0", _gnu("Lesser General Public", "3", "library")),
    ("AGPL-3.0", _gnu("Affero General Public", "3")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)

#: Licence of an SPDX identifier, in lower case and without -only, -or-later and +.
IDENTIFIERS: dict[str, str] = {name.lower(): name for name, _ in (*TEMPLATES, *HEADERS) if name != "proprietary"}


def template_tokens(text: str) -> list[str]:
    return [t for t in re.sub(NOT_TOKEN, " ", text.lower()).split(" ") if t]


def template_vectors(templates=TEMPLATES) -> tuple[dict[str, float], list[tuple[int, str, str, float]], float]:
    """Token weights (smoothed inverse template frequency), rows (template, licence, token,
    weight in the unit vector), and the weight of a token that no template has."""
    tokens = [template_tokens(text) for _, text in templates]
    frequency = Counter(t for own in tokens for t in set(own))
    weight = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in frequency.items()}
    rows = []
    for k, ((licence, _), own) in enumerate(zip(templates, tokens, strict=True)):
        vector = {t: n * weight[t] for t, n in Counter(own).items()}
        size = math.sqrt(sum(v * v for v in vector.values()))
        rows += [(k, licence, t, v / size) for t, v in sorted(vector.items())]
    return weight, rows, math.log(1 + len(templates)) + 1


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), NOT_TOKEN, " "), " "), lambda t: t != "")


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _directory(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")


def segments(files: DataFrame) -> DataFrame:
    """doc_id, segment (its text): sentences that mention a licence, whole licence files, and
    paragraphs that mention one, with their sentences, without comment signs and line feeds."""

    def mentions(text: Column, markers=MARKERS) -> Column:
        return reduce(or_, (F.lower(text).contains(m) for m in markers))

    def in_header(text: Column) -> Column:
        return mentions(text, HEADER_MARKERS)

    whole = F.coalesce(_name(F.col("path")).rlike(LICENCE_FILE), F.lit(False))
    sentences = F.filter(F.split("text", SENTENCE_END), lambda x: mentions(x))
    bare = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), COMMENT_SIGNS, "")
    paragraphs = F.transform(F.filter(F.split(bare, r"\n\s*\n"), in_header), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    joined = F.filter(F.flatten(F.transform(paragraphs, lambda x: F.split(x, r"(?<=[.!?])\s+"))), in_header)
    return (
        files.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
        .where(in_header(F.col("text")) | whole)
        .select("doc_id", F.explode(F.array_distinct(F.concat(sentences, paragraphs, joined, F.when(whole, F.array("text")).otherwise(F.array().cast("array<string>"))))).alias("segment"))
    )


def cosines(terms: DataFrame, templates) -> DataFrame:
    """doc_id, licence, cosine (six digits) of the segments in ``terms`` (doc_id, segment, token, tf) to ``templates``."""
    spark = terms.sparkSession
    weight, rows, unknown = template_vectors(templates)
    # the templates' few hundred tokens
    weights = F.broadcast(spark.createDataFrame(sorted(weight.items()), "token string, idf double"))
    vectors = F.broadcast(spark.createDataFrame(rows, "template int, licence string, token string, share double"))
    terms = terms.join(weights, "token", "left").withColumn("value", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    norms = terms.groupBy("doc_id", "segment").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = terms.join(vectors, "token").groupBy("doc_id", "segment", "template", "licence").agg(F.sum(F.col("value") * F.col("share")).alias("dot"))
    return dots.join(norms, ["doc_id", "segment"]).select("doc_id", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))


def identified(files: DataFrame) -> DataFrame:
    """doc_id, licence, cosine (1) of the SPDX lines of ``files`` with a known identifier."""
    known = F.create_map(*[F.lit(x) for pair in sorted(IDENTIFIERS.items()) for x in pair])
    names = files.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(SPDX), 1)).alias("name"))
    licence = known[F.regexp_replace(F.lower("name"), r"(-only|-or-later|\+)$", "")]
    return names.select("doc_id", licence.alias("licence"), F.lit(1.0).alias("cosine")).where(F.col("licence").isNotNull())


def detect(files: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, licence, cosine (six digits) of the files with a licence statement of their own.

    The best template of any segment wins; ties go to the licence that sorts first.
    """
    terms = materialise(
        segments(files)
        .select("doc_id", F.xxhash64("segment").alias("segment"), F.explode(_tokens(F.col("segment"))).alias("token"))
        .groupBy("doc_id", "segment", "token")
        .agg(F.count(F.lit(1)).alias("tf")),
        "licence_terms",
    )
    scored = cosines(terms, TEMPLATES).union(cosines(terms, HEADERS)).union(identified(files))
    best = scored.where(F.col("cosine") >= cosine).groupBy("doc_id").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence")).alias("best"))
    return best.select("doc_id", "best.licence", (-F.col("best.less")).alias("cosine"))


def inherited(files: DataFrame, declared: DataFrame) -> DataFrame:
    """directory, licence, from_directory: the licence in force in every directory of ``files``.

    It is that of the best licence file (by cosine, then licence, then doc_id) in the directory
    or, failing that, in its nearest ancestor; directories without one are left out.
    """
    own = (
        files.where(_name(F.col("path")).rlike(LICENCE_FILE))
        .select("doc_id", _directory(F.col("path")).alias("from_directory"))
        .join(declared, "doc_id")
        .groupBy("from_directory")
        .agg(F.min(F.struct((-F.col("cosine")).alias("less"), "licence", "doc_id")).alias("best"))
        .select("from_directory", F.col("best.licence").alias("licence"))
    )
    parts = F.split("directory", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("directory") == "", 0).otherwise(F.size(parts)))
    ancestors = (
        files.where(F.col("path").isNotNull())
        .select(_directory(F.col("path")).alias("directory"))
        .distinct()
        .select("directory", F.explode(F.transform(depths, lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("from_directory")))).alias("up"))
        .select("directory", "up.depth", "up.from_directory")
    )
    return (
        ancestors.join(own, "from_directory")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "licence", "from_directory")).alias("near"))
        .select("directory", "near.licence", "near.from_directory")
    )


def scan(files: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, path, licence, cosine, from_directory of every row of ``files`` (doc_id, path, text).

    A licence of the file's own has its ``cosine`` and no ``from_directory``; an inherited one
    the directory it comes from and no cosine; a file with neither has nulls. Null and empty texts hold
    no licence; a null path has no directory; rows without a doc_id have none of their own.
    Rows of one doc_id share the best licence found in any. Other columns are ignored.
    """
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    declared = materialise(detect(files, cosine), "licences_declared")
    names = files.select("doc_id", "path")
    force = inherited(names, declared).withColumnRenamed("licence", "inherited")
    told = names.withColumn("directory", _directory(F.col("path"))).join(declared, "doc_id", "left").join(force, "directory", "left")
    return told.select(
        "doc_id", "path", F.coalesce("licence", "inherited").alias("licence"), "cosine", F.when(F.col("licence").isNull(), F.col("from_directory")).alias("from_directory")
    )
