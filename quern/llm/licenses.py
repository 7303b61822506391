"""License statements in whole texts, by diagonal voting.

Every rolling word k-gram of a text that a template has too becomes a vote for
the diagonal (place in the text less place in the template). Votes are joined
to the templates and counted by diagonal; neighbouring diagonals are merged, so
a few added or missing words don't split a statement; each merged span is then
verified by aligning its words with the template's.

Fixed phrases are found besides, by their words alone.

Null texts count as empty; very long texts are scanned whole. Repeated rows and
ids are rows of their own, and of equal scores a text keeps every label. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import seeds, words
from quern.llm.align import MATCH, local_scores
from quern.llm.scratch import stage

#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Statements that are looked for by votes, and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]

#: Words that tell no license from another. All others of a short template have to stand in its place.
GENERIC = "a an is license licensed of released terms the this under version work"

SCANNED = "rid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base int, start long, words array<long>, at array<int>, gram array<long>"


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    k: int = 3,
    band: int = 3,
    threshold: float = 0.9,
    near_threshold: float = 0.65,
    long_threshold: float = 0.6,
) -> tuple[DataFrame, DataFrame]:
    """``(documents, spans)``.

    documents: a row each with ``rid, doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score``. spans: ``rid, doc_id, template,
    label, first_word, end_word, votes, score`` of every verified statement.
    Templates of under 12 words must align with ``threshold`` of a perfect copy,
    or with ``near_threshold`` and all their words but the generic ones; longer
    ones with ``long_threshold``. Diagonals up to ``band`` apart merge.
    """
    spark = docs.sparkSession
    forms = [words.hash_words([t]) for _, t in templates]
    grams = [words.ngrams(f, k) for f in forms]
    known = spark.sparkContext.broadcast(seeds.filter_of(np.concatenate(grams)))
    pad = max(map(len, forms)) + 4 * band
    fixed = [words.hash_words([p]) for p in phrases]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = seeds.Numbering()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                b = batch.slice(lo, 1024)
                n = b.num_rows
                h, offs = words.word_hashes(b.column(1))
                at, which = [], []
                for x, f in enumerate(fixed):
                    p = np.flatnonzero(h[: max(0, len(h) - len(f) + 1)] == f[0])
                    for y in range(1, len(f)):
                        p = p[h[p + y] == f[y]]
                    p = p[p + len(f) <= offs[np.searchsorted(offs, p, side="right")]]
                    at.append(p)
                    which.append(np.full(len(p), 1 << x))
                place, bit = np.concatenate(at).astype(np.int64), np.concatenate(which).astype(np.int64)
                row = np.searchsorted(offs, place, side="right") - 1
                count = np.bincount(row, minlength=n)
                first, last, base = np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.zeros(n, np.int64)
                np.minimum.at(first, row, place - offs[row])
                np.maximum.at(last, row, place - offs[row])
                np.bitwise_or.at(base, row, bit)
                rid, none = number.take(n), count == 0
                blank = [None] * n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), b.column(0), pa.array(np.diff(offs)), pa.array(count.astype(np.int64)), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(base.astype(np.int32)), pa.array(blank, pa.int64()), pa.array(blank, pa.list_(pa.int64())), pa.array(blank, pa.list_(pa.int32())), pa.array(blank, pa.list_(pa.int64()))],
                    NAMES,
                )
                got = list(seeds.regions_of(h, offs, k, known.value, pad))
                if got:
                    r, start, w, places, g = zip(*got)
                    r, blank = np.array(r), pa.array([None] * len(got), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid[r]), b.column(0).take(pa.array(r)), blank, blank, blank, blank, blank.cast(pa.int32()), pa.array(start, pa.int64()), seeds.lists(w, pa.int64()), seeds.lists(places, pa.int32()), seeds.lists(g, pa.int64())],
                        NAMES,
                    )

    NAMES = [x.split()[0] for x in SCANNED.split(", ")]
    scanned = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(scan, SCANNED), "scanned")
    per_doc, regions = scanned.where("n_words is not null"), scanned.where("n_words is null")

    rows = [(i, p, int(g)) for i, gs in enumerate(grams) for p, g in enumerate(gs.view(np.int64))]
    places = F.broadcast(spark.createDataFrame(rows, "template int, place int, gram long"))  # the templates are constants
    votes = regions.select("rid", "start", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("rid", "start", "x.at", "x.gram").join(places, "gram")
    diagonals = votes.groupBy("rid", "start", "template", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi")
    )
    one = Window.partitionBy("rid", "start", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(one) > band).cast("int"), F.lit(1))
    merged = diagonals.withColumn("apart", apart).withColumn("run", F.sum("apart").over(one)).groupBy("rid", "start", "template", "run")
    spans = merged.agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    telling = [np.setdiff1d(f, words.hash_words([GENERIC])) for f in forms]
    bodies = regions.select("rid", "start", "doc_id", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, doc, template, n, start, lo, hi = (b.column(x).to_pylist() for x in range(7))
            o, v = b.column(7).offsets.to_numpy(), b.column(7).values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            begin = [max(0, a - len(forms[t]) - band) for a, t in zip(lo, template)]
            pairs = [(forms[t], v[o[r] : o[r + 1]][s : z + len(forms[t]) + band]) for r, (t, s, z) in enumerate(zip(template, begin, hi))]
            got, first, end = local_scores(pairs)
            share = got / np.array([MATCH * len(f) for f, _ in pairs], float)

            def stands(r: int) -> bool:
                if len(pairs[r][0]) >= 12:
                    return share[r] >= long_threshold
                return share[r] >= threshold or share[r] >= near_threshold and bool(np.isin(telling[template[r]], pairs[r][1][first[r] : end[r]]).all())

            at = [r for r in range(len(pairs)) if stands(r)]
            base = [start[r] + begin[r] for r in at]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rid[r] for r in at], pa.int64()), pa.array([doc[r] for r in at], pa.int64()), pa.array([template[r] for r in at], pa.int32()), pa.array([templates[template[r]][0] for r in at], pa.string()), pa.array([x + int(first[r]) for x, r in zip(base, at)], pa.int64()), pa.array([x + int(end[r]) for x, r in zip(base, at)], pa.int64()), pa.array([n[r] for r in at], pa.int64()), pa.array(share[at] if at else [], pa.float64())],
                ["rid", "doc_id", "template", "label", "first_word", "end_word", "votes", "score"],
            )

    spans = spans.join(bodies, ["rid", "start"]).select("rid", "doc_id", "template", "votes", "start", "lo", "hi", "words")
    spans = spans.mapInArrow(verify, "rid long, doc_id long, template int, label string, first_word long, end_word long, votes long, score double")
    spans = stage(spans, "spans")

    found = spans.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    labels = F.array(*(F.when(F.col("base").bitwiseAND(1 << x) > 0, F.lit(label)) for x, label in enumerate(phrases.values())))
    base = F.array_sort(F.array_distinct(F.array_compact(labels)))
    every = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    joined = per_doc.join(found, "rid", "left")
    documents = joined.select(
        "rid", "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )
    return documents, spans
