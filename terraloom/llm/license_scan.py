"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts and templates become shingles of ``SHINGLE`` words. A text is covered by windows of ``2 * stride`` shingles that start every
``stride``, so that any passage of at most ``stride`` shingles lies whole in one. Templates are scanned by length class, with a
stride of the class's longest template divided by ``CONTAINMENT``: copies with words inserted are longer than their template. A band is one min-wise hash; a window that holds a template of m shingles
has a Jaccard of at least m / (2 * stride + m), and the number of bands is set so that such a pair shares a band with the probability ``FOUND``.

Retrieval is a lookup: the table of bands has, for each template and band, the shingle of the least hash, which is all that
a band's value says. Shingles of texts are joined with it; of those found, a window around it shares the band if none of its
shingles has a lesser hash. Windows without any such shingle share no band, and never become rows. Verified
matches contain at least ``CONTAINMENT`` of a template's distinct shingles.

Only DataFrame functions are used. Bands and templates are broadcast where they are few, else joined by a shuffle. What is found in a text goes by a digest of it, so
copies are judged alike, and comes back to the documents by a broadcast, or by ``join_hot``.

Defined results: null is an empty text
without matches; very long texts are scanned whole; repeated rows are judged one by one; ties between templates are all reported, by name, templates of one name as one license; texts shorter than a shingle match nothing; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_KEYS, ascii_lower, join_hot, let, stage, unstage

SHINGLE = 3
CONTAINMENT = 0.8
FOUND = 0.99
#: Upper ends of the length classes, in shingles.
CLASSES = (8, 16, 32, 64, 128, 256, 512, 1024, 1 << 30)
#: Templates are broadcast if they have so many shingles at most.
BROADCAST_SHINGLES = 2_000_000

# License notices and the opening or grant passages of well-known licenses.
TEMPLATES = {
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
}
TEMPLATE_SCHEMA = "license string, template string"


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " ", -1), lambda w: w != "")


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of a text, in their order."""
    return let(F.transform(words(text), lambda w: F.xxhash64(w)), lambda w: _hashed(w, size))


def _hashed(w: Column, size: int) -> Column:
    at = F.sequence(F.lit(0), F.size(w) - size)
    return F.when(F.size(w) >= size, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def bands_needed(jaccard: float, found: float = FOUND) -> int:
    """Bands of one row after which a pair of this Jaccard shares one with this probability."""
    return math.ceil(math.log(1 - found) / math.log(1 - jaccard))


def _rank(shingle: Column, band: Column) -> Column:
    """The order of shingles in a band."""
    return F.xxhash64(shingle, band)


def length_classes(templates: DataFrame, containment: float, found: float) -> list[tuple[int, int, int]]:
    """(upper end, stride, bands) of each length class that has templates."""
    end = F.lit(CLASSES[-1])
    for c in reversed(CLASSES[:-1]):
        end = F.when(F.size("t") <= c, c).otherwise(end)
    rows = templates.groupBy(end.alias("end")).agg(F.max(F.size("t")).alias("longest"), F.min(F.size("t")).alias("least")).orderBy("end").collect()  # a row for each class
    out = []
    for r in rows:
        stride = math.ceil(r.longest / containment)
        out.append((r.end, stride, bands_needed(containment * r.least / (2 * stride + r.least), found)))
    return out


def band_table(templates: DataFrame, classes: list[tuple[int, int, int]]) -> DataFrame:
    """x, band, stride, id: the shingle that gives a template its least hash, band by band."""
    stride = bands = F.lit(1)  # without templates
    for end, s, n in reversed(classes):
        stride, bands = F.when(F.size("t") <= end, s).otherwise(stride), F.when(F.size("t") <= end, n).otherwise(bands)
    listed = templates.select("id", "t", stride.alias("stride"), F.explode(F.sequence(F.lit(0), bands - 1)).alias("band"))
    least = F.array_min(F.transform("t", lambda x: F.struct(_rank(x, F.col("band")).alias("r"), x.alias("x"))))
    return listed.select(least["x"].alias("x"), "band", "stride", "id")


def find_licenses(texts: DataFrame, templates: DataFrame, containment: float, found: float) -> DataFrame:
    """digest, license, containment (the greatest) of all matches in ``texts`` (digest, text), staged; ``templates`` has id, license and t, their shingles."""
    bands = stage(band_table(templates, length_classes(templates, containment, found)), "bands")
    few = bands.count() <= FILTER_KEYS
    small = (templates.agg(F.sum(F.size("t"))).first()[0] or 0) <= BROADCAST_SHINGLES
    hashed = texts.select("digest", shingles(F.col("text")).alias("h"))
    # outer, lest Spark adds a filter on the array's size, for which it would compute the shingles twice
    hits = hashed.select("digest", "h", F.posexplode_outer("h").alias("at", "x")).join(F.broadcast(bands) if few else bands, "x")
    at = F.floor(F.col("at") / F.col("stride")).cast("int")
    windows = hits.select("digest", "h", "x", "band", "stride", "id", F.explode(F.array_distinct(F.array(at, F.greatest(F.lit(0), at - 1)))).alias("w"))
    windows = windows.select("digest", "x", "band", "id", F.array_distinct(F.slice("h", F.col("w") * F.col("stride") + 1, 2 * F.col("stride"))).alias("window"))
    shared = windows.where(~F.exists("window", lambda y: _rank(y, F.col("band")) < _rank(F.col("x"), F.col("band"))))
    share = F.size(F.array_intersect("window", "t")) / F.size("t")
    matched = shared.join(F.broadcast(templates) if small else templates, "id").select("digest", "license", share.alias("containment")).where(F.col("containment") >= containment)
    out = stage(matched.groupBy("digest", "license").agg(F.max("containment").alias("containment")), "licenses")
    unstage(bands)
    return out


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text", containment: float = CONTAINMENT, found: float = FOUND) -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (names with containments, joined), best (the greatest containment, or null)."""
    spark = docs.sparkSession
    if templates is None:
        templates = spark.createDataFrame(sorted(TEMPLATES.items()), TEMPLATE_SCHEMA)
    own = templates.where("license is not null").select("license", F.array_distinct(shingles(F.coalesce("template", F.lit("")))).alias("t")).distinct()
    own = stage(own.where(F.size("t") > 0).select(F.xxhash64("license", "t").alias("id"), "license", "t"), "templates")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.sha2(t.cast("binary"), 256).alias("digest")
    matches = find_licenses(docs.select(digest, t.alias("text")), own, containment, found)
    listed = F.array_sort(F.collect_list(F.struct("license", "containment")))  # as many as there are licenses at most
    matched = stage(matches.groupBy("digest").agg(listed.alias("m")), "licensed")
    unstage(own, matches)
    docs = docs.select(F.col(doc_id).alias("doc_id"), digest)
    if matched.count() <= FILTER_KEYS:
        joined = docs.join(F.broadcast(matched), "digest", "left")
    else:
        facts = stage(docs.groupBy("digest").agg(F.count("*").alias("n")).join(matched, "digest", "left"), "licensed-texts")
        joined = join_hot(docs, facts, "digest")
    m = F.coalesce("m", F.array().cast("array<struct<license:string,containment:double>>"))
    return joined.select(
        "doc_id",
        F.size(m).cast("bigint").alias("n_licenses"),
        F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["license"], F.format_number(x["containment"], 3))), ",").alias("licenses"),
        F.array_max(F.transform(m, lambda x: x["containment"])).alias("best"),
    )
