"""Licence scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies [native].

A template is cut into overlapping pieces of ``PIECE`` shingles at most (a short notice is one piece), a document into
overlapping windows of its size class, a quarter longer than the piece. Bands have one row each: a piece with b filled
bins whose words stand in a document lies whole in some window, with Jaccard similarity J of at least
1 / (1.25 * GROWTH) = 0.53, and one of its bands collides with probability 1 - (1 - J) ** b or more - with few filled
bins the true figure is higher still, as a bin with one shingle of the piece seldom has another of the window. See
``shingle_search`` for the search itself.

Defined results: one row per document and licence of which at least 80 % of the distinct shingles stand in the
document; rows that repeat a doc_id give one row, with the largest share; null or short texts (under five words) match
nothing; a null doc_id is reported as null; templates under five words have no shingle and are not searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanecast.llm.shingle_search import CONTAINMENT, search, sketches, target_shingles
from lanecast.session import materialize

PIECE = 48
GROWTH = 1.5

# Public licence notices, as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "BSD-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``(license, text)`` of the given templates (default: ``TEMPLATES``)."""
    rows = sorted((TEMPLATES if texts is None else texts).items())
    return spark.createDataFrame(rows, "license string, text string").coalesce(1)


def scan(docs: DataFrame, known: DataFrame, text: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, license_shingles, shared, containment``: one row per document and licence found in it."""
    shingles = materialize(target_shingles(known, "license"))
    half = PIECE // 2
    longest = shingles.groupBy("target").agg(F.max("first").alias("last"))
    cut = shingles.join(longest, "target").withColumn(
        "piece", F.explode(F.when(F.col("last") < PIECE, F.array(F.lit(0))).otherwise(F.array_distinct(F.array(
            F.greatest(F.lit(0), F.floor(F.col("first") / half).cast("int") - 1),
            F.floor(F.col("first") / half).cast("int"))))))
    found = search(docs, shingles, materialize(sketches(cut.select("target", "piece", "h"), GROWTH)), text, containment)
    return (found.groupBy("doc_id", F.col("target").alias("license"))
            .agg(F.max("shingles").alias("license_shingles"), F.max("shared").alias("shared"))
            .withColumn("containment", F.col("shared") / F.col("license_shingles")))


def oracle() -> str:
    """The exact answer in DuckDB SQL."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    return rf"""
WITH t(license, text) AS (VALUES {rows}),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
tw AS (SELECT license, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM t),
i AS (SELECT DISTINCT license, array_to_string(w[k:k + 4], ' ') AS g
      FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS k FROM tw)),
n AS (SELECT license, count(*) AS license_shingles FROM i GROUP BY license),
d AS (SELECT DISTINCT doc_id, g FROM
      (SELECT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM
       (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM dw))
      WHERE g IN (SELECT g FROM i)),
m AS (SELECT doc_id, license, count(*) AS shared FROM d JOIN i USING (g) GROUP BY doc_id, license)
SELECT doc_id, license, license_shingles, shared, shared / license_shingles AS containment
FROM m JOIN n USING (license) WHERE shared >= 0.8 * license_shingles
"""
