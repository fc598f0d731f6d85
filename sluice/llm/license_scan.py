"""Licence scans by a positional index of rare words, with DataFrame functions only.

Licence templates, passages of well-known licences and their headers, are indexed by their words of highest IDF (over
the templates), each with its position. All of a file's indexed words are looked up; postings that agree on where a template would start are counted together, and the
template's key phrase must stand at its place. The base phrases are indexed in the same way, by
their rarest word, and every place of theirs counts.

The index is a fixed table of a few hundred rows; files are read once, and only the places of indexed words go on.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, lower_ascii, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Indexed words of a template; share of them that must agree.
ANCHORS = 6
COVERAGE = 0.6

#: Words of any English text, which tell nothing about licences and are not indexed.
COMMON = frozenset("a all an and any are as at be by can even for has how if in into is it its made may must no not of on one or other that the to was will with you".split())
#: The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Label, passage of a licence or of its usual header, and the phrase of it that must stand in its place.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit-release", "released under the mit license", "the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "in the hope that it will be useful"),
    ("mit-rights", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "merge publish distribute sublicense"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "fitness for a particular purpose and noninfringement"),
    ("apache-2.0-header", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("apache-2.0-warranty", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "without warranties or conditions of any kind"),
    ("bsd-warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "by the copyright holders and contributors as is"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived"),
    ("bsd-advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "advertising materials mentioning features"),
    ("isc-warranty", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "disclaims all warranties with regard to this software"),
    ("mpl-2.0-copy", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl was not distributed"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "alter it and redistribute it freely"),
    ("zlib-origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", "must not be misrepresented"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4 0 international"),
    ("cc-by-nc-4.0-long", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4 0 international"),
    ("cc-by-nd-4.0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "attribution noderivatives 4 0 international"),
    ("unlicense-grant", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "publish use compile sell or distribute"),
    ("verbatim-license", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim copies of this license document"),
    ("psf-2.0", "this license agreement is between the python software foundation and the individual or organization licensee accessing and otherwise using this software", "python software foundation"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("eupl-1.2", "licensed under the european union public licence", "european union public licence"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "software developed by the openssl project"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the software", "accompanied by information on how to obtain complete source code"),
    ("proprietary", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher", "no part of this publication may be reproduced"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-or-later", "either version 2 of the license or at your option any later version", "at your option any later version"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization", "promote the sale use or other dealings in this software"),
    ("hpnd", "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", "advertising or publicity pertaining to distribution"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "governs use of the accompanying software"),
    ("artistic-2.0", "this is free software licensed under the artistic license 2 0", "the artistic license 2 0"),
    ("perl", "you can redistribute it and or modify it under the same terms as perl itself", "under the same terms as perl itself"),
    ("ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl", "either the terms of the 2 clause bsdl"),
    ("json", "the software shall be used for good not evil", "used for good not evil"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "retain this notice you can do whatever"),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("php-3.01", "this product includes php software freely available from", "includes php software freely available"),
    ("upl-1.0", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data", "condition set forth below"),
    ("sspl-1.0", "licensed under the server side public license version 1", "server side public license"),
    ("elastic-2.0", "licensed under the elastic license 2 0", "elastic license 2 0"),
    ("busl-1.1", "licensed under the business source license 1 1", "business source license"),
    ("spdx-mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("spdx-apache-2.0", "spdx license identifier apache 2 0", "license identifier apache 2 0"),
    ("spdx-gpl-2.0", "spdx license identifier gpl 2 0", "license identifier gpl 2 0"),
    ("spdx-gpl-3.0", "spdx license identifier gpl 3 0", "license identifier gpl 3 0"),
    ("spdx-bsd-3-clause", "spdx license identifier bsd 3 clause", "license identifier bsd 3 clause"),
    ("spdx-mpl-2.0", "spdx license identifier mpl 2 0", "license identifier mpl 2 0"),
)


@cache
def idf() -> dict[str, float]:
    """IDF of each licence word over the templates and base phrases."""
    texts = [set(t.split()) for _, t, _ in TEMPLATES] + [set(p.split()) for p, _ in BASE]
    held = Counter(w for words in texts for w in words)
    return {w: math.log(len(texts) / n) for w, n in held.items()}


def _find(words: list[str], phrase: list[str]) -> int:
    return next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)


@cache
def postings() -> tuple[tuple[str, str, bool, int, int, int, str], ...]:
    """(word, label, base, position in the template, indexed words of it, offset of the word in the phrase, phrase).

    A word outside the key phrase has a null phrase. At least one indexed word of a template lies in its phrase.
    """
    rare = lambda w, k: (-idf()[w], -len(w), k)
    rows = []
    for phrase, label in BASE:
        words = phrase.split()
        k = min(range(len(words)), key=lambda k: rare(words[k], k))  # noqa: B023
        rows.append((words[k], label, True, k, 1, k, phrase))
    for label, text, phrase in TEMPLATES:
        words, inside = text.split(), phrase.split()
        at = _find(words, inside)
        order = sorted((k for k in range(len(words)) if words[k] not in COMMON), key=lambda k: rare(words[k], k))  # noqa: B023
        key = next(k for k in order if at <= k < at + len(inside))
        chosen = sorted({key, *order[:ANCHORS]})
        for k in chosen:
            rows.append((words[k], label, False, k, len(chosen), k - at, phrase if k == key else None))
    return tuple(rows)


def _index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(postings()), "word string, label string, base boolean, position int, anchors int, offset int, phrase string")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per input row.

    Null and empty texts have no words and no places; repeated rows are scanned and returned each; an empty table gives
    no rows; long texts are scanned whole, and other columns are not read. A place of words that several templates
    share counts for each of them, so there are no ties to break: every template that agrees gives its label. Without a place of a base phrase, n_base is 0, first_word and
    last_word are null and base_labels is empty. The score is 1 with a base phrase, else the best share of a
    template's indexed words that agree, halved where its key phrase is missing.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    rare = sorted({p[0] for p in postings()})
    reach = max(len(phrase.split()) for phrase in [p[6] for p in postings() if p[6]])
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.regexp_extract_all(lower_ascii(whole_text(text_col)), F.lit(f"({WORD})"), 1).alias("words"),
    )
    # Each file keeps its first word's place as its own row, and the places of indexed words.
    places = words.select("row", "doc_id", "words", F.posexplode_outer("words").alias("place", "word"))
    places = places.where(F.coalesce(F.col("place") == 0, F.lit(True)) | F.col("word").isin(rare))
    low = F.greatest(F.col("place") - reach, F.lit(0))
    near = F.when(F.col("word").isin(rare), F.slice("words", low + 1, 2 * reach + 1))
    places = scratch.keep(places.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "place", "word", low.alias("low"), near.alias("near")), "places")

    index = F.broadcast(_index(spark))  # one row for each posting of the fixed templates
    hits = places.where("near is not null").join(index, "word")
    begin = F.col("place") - F.col("offset")
    phrase = F.array_join(F.slice("near", begin - F.col("low") + 1, F.size(F.split("phrase", " "))), " ")
    hits = hits.withColumn("stands", F.when((begin >= F.col("low")) & F.col("phrase").isNotNull(), phrase == F.col("phrase")).otherwise(F.lit(False)))

    base = hits.where("base and stands").select("row", "label", (F.col("place") - F.col("position")).cast("long").alias("start"))
    base = base.groupBy("row").agg(F.count("*").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base_set"))

    agreed = hits.where("not base").groupBy("row", "label", "anchors", (F.col("place") - F.col("position")).alias("start")).agg(F.count("*").alias("n"), F.max("stands").alias("stands"))
    share = F.col("n") / F.col("anchors")
    agreed = agreed.groupBy("row").agg(F.array_sort(F.collect_set(F.when(F.col("stands") & (share >= COVERAGE), F.col("label")))).alias("set"), F.max(F.when(F.col("stands"), share).otherwise(share / 2)).alias("share"))

    heads = places.where("place is null or place = 0").select("row", "doc_id", F.when(F.col("place").isNull(), F.lit(0)).otherwise(F.col("n_words")).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    found = heads.join(base, "row", "left").join(agreed, "row", "left")
    return found.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.coalesce("base_set", none), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base_set", none), F.coalesce("set", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle() -> str:
    """The same scan in SQL over the table documents, word by word."""
    quote = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows = ",\n            ".join("(" + ", ".join(map(quote, p)) + ")" for p in postings())
    return rf"""
        WITH postings(word, label, base, position, anchors, "offset", phrase) AS (VALUES
            {rows}),
        split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
            FROM documents),
        places AS (
            SELECT doc_id, words, unnest(words) AS word, unnest(range(len(words))) AS place FROM split),
        hits AS (
            SELECT s.doc_id, s.word, s.place, p.label, p.base, p.anchors, s.place - p.position AS start,
                coalesce(s.place >= p."offset" AND array_to_string(list_slice(s.words, s.place - p."offset" + 1, s.place - p."offset" + len(string_split(p.phrase, ' '))), ' ') = p.phrase, false) AS stands
            FROM places s JOIN postings p ON s.word = p.word),
        base AS (
            SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS base_set
            FROM hits WHERE base AND stands GROUP BY doc_id),
        agreed AS (
            SELECT h.doc_id, h.label, CAST(count(*) AS DOUBLE) / h.anchors AS share, bool_or(h.stands) AS stands
            FROM hits h
            WHERE NOT h.base GROUP BY h.doc_id, h.label, h.anchors, h.start),
        best AS (
            SELECT doc_id, list(DISTINCT label) FILTER (stands AND share >= {COVERAGE}) AS own_set,
                max(CASE WHEN stands THEN share ELSE share / 2 END) AS share
            FROM agreed GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
            array_to_string(coalesce(b.base_set, []), ',') AS base_labels,
            array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base_set, []), coalesce(t.own_set, [])))), ',') AS labels,
            CASE WHEN b.n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(t.share, CAST(0 AS DOUBLE)) END AS score
        FROM split s LEFT JOIN base b ON s.doc_id = b.doc_id LEFT JOIN best t ON s.doc_id = t.doc_id"""
