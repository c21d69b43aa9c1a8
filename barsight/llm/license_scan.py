"""Licence scans: sparse TF-IDF cosine to licence templates, then inheritance from the nearest ancestor directory.

Every line of a text and the text as a whole are vectors of words; a word weighs its count times ln((1 + n) / (1 + df)) + 1,
with df the number of the n lines of all texts that hold it. Notices wrapped over lines are found as blocks: 2 to BLOCK_LINES
consecutive lines, lines without words left out. The best cosine over lines, blocks, whole text and templates is a file's own
licence if it reaches THRESHOLD (of ties the first template); below that a file has no score.

Frequencies of all words are counted once. Those of template words go to the tasks, which drop the texts that could not reach
the threshold even if all their other words weighed 1, the least there is. The few texts left, each once however many copies it
has, are joined with the frequencies of their own words and scored exactly.

A licence file lends its licence to its directory (the best score, then the least path). A file without a licence of its own
takes that of the nearest directory above it that has one. Directories, not files, are joined with their ancestors, one row
for each level, so a directory with a third of all files costs one row for each of its levels; ancestors of many directories
are salted.

Cases: null and empty texts have no licence of their own and may inherit; a null path inherits nothing; files without a
directory have the directory '', the root of all; repeated rows get equal results; without files there are no rows; extra
columns of any name are kept by scan().
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, hot_join, text_key, words_of

THRESHOLD, BLOCK_LINES, CHUNK_LINES = 0.6, 40, 1024
_FLUSH_WORDS = 500_000

# How files and works commonly state these licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
)


class Templates:
    """Vocabulary, and once the words' weights are known the templates' unit vectors."""

    def __init__(self, templates) -> None:
        self.names = [n for n, _ in templates]
        lists = [words_of(t) for _, t in templates]
        self.terms = {w: i for i, w in enumerate(dict.fromkeys(w for ws in lists for w in ws))}
        self.counts = np.array([np.bincount([self.terms[w] for w in ws], minlength=len(self.terms)) for ws in lists], np.float64)

    def weigh(self, df: np.ndarray, lines: int) -> None:
        self.lines = lines
        self.idf = np.log((1 + lines) / (1 + df)) + 1
        v = self.counts * self.idf
        self.vectors = v / np.linalg.norm(v, axis=1, keepdims=True)

    def squares(self, words: Iterable[bytes], frequencies: dict[bytes, int] | None) -> float:
        """Sum of the squared weights of the words that no template holds; without their frequencies the least it can be."""
        own: dict[bytes, int] = {}
        for w in words:
            if w not in self.terms:
                own[w] = own.get(w, 0) + 1
        if frequencies is None:
            return float(sum(c * c for c in own.values()))
        return sum((c * (math.log((1 + self.lines) / (1 + frequencies.get(w, 0))) + 1)) ** 2 for w, c in own.items())

    def best(self, lists: list[list[bytes]], frequencies: dict[bytes, int] | None, threshold: float = THRESHOLD) -> tuple[int, float, float]:
        """(template, cosine, cosine of the whole text) over the lists of words, their blocks and all of them together.

        Lines go by in chunks of CHUNK_LINES with the lines that blocks begun in them reach into, so that matrices stay
        small however long the text is.
        """
        lists = [ws for ws in lists if ws]
        get, n, size = self.terms.get, len(self.terms), len(lists)
        flat = np.fromiter((get(w, n) for ws in lists for w in ws), np.int32)
        line = np.repeat(np.arange(size, dtype=np.int32), [len(ws) for ws in lists])
        known = flat < n
        if not known.any():
            return -1, 0.0, 0.0
        others = np.concatenate(([0], np.bincount(line[~known], minlength=size).cumsum()))
        line, flat = line[known], flat[known]
        rows, begins = np.unique(line, return_index=True)
        begins = np.append(begins, len(flat))

        def able(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Dot products and squares, and what could reach the threshold: only that is worth the weights of its other words."""
            v = counts * self.idf
            top, square = v @ self.vectors.T, (v * v).sum(axis=1)
            return top, square, np.flatnonzero(top.max(axis=1) >= threshold * np.sqrt(square) * (1 - 1e-9))

        best = np.zeros(len(self.names))
        for at in range(0, len(rows), CHUNK_LINES):
            end = min(at + CHUNK_LINES, len(rows))
            upto = min(end + BLOCK_LINES - 1, len(rows))
            held = np.repeat(np.arange(upto - at), np.diff(begins[at : upto + 1]))
            counts = np.bincount(held * n + flat[begins[at] : begins[upto]], minlength=(upto - at) * n).reshape(upto - at, n).astype(np.float64)
            top, square, chosen = able(counts[: end - at])
            for i in chosen.tolist():
                best = np.maximum(best, top[i] / np.sqrt(square[i] + self.squares(lists[rows[at + i]], frequencies)))
            for cosine in self.blocks(lists, rows[at:upto], end - at, counts, others, frequencies, threshold):
                best = np.maximum(best, cosine)
        top, square, chosen = able(np.bincount(flat, minlength=n).astype(np.float64)[None, :])
        whole = top[0] / np.sqrt(square[0] + self.squares((w for ws in lists for w in ws), frequencies)) if len(chosen) else np.zeros(len(best))
        best = np.maximum(best, whole)
        k = int(best.argmax())
        return k, float(best[k]), float(whole.max())

    def blocks(self, lists: list[list[bytes]], rows: np.ndarray, starts: int, counts: np.ndarray, others: np.ndarray, frequencies: dict[bytes, int] | None, threshold: float) -> Iterator[np.ndarray]:
        """The cosines to each template of the blocks that reach the threshold and begin in the first `starts` of the rows.

        A block that begins or ends with a line without template words is no better than the shorter one. Dot products
        add up over lines; with the other words as if all were different and weighed 1, a block's cosine is bounded first.
        """
        a, step = (x.ravel() for x in np.meshgrid(np.arange(starts), np.arange(1, BLOCK_LINES), indexing="ij"))
        b = a + step
        a, b = a[b < len(rows)], b[b < len(rows)]
        near = rows[b] - rows[a] < BLOCK_LINES
        a, b = a[near], b[near]
        first, end = rows[a], rows[b] + 1
        dots = (counts * self.idf) @ self.vectors.T
        upto = np.vstack([np.zeros((1, dots.shape[1])), dots.cumsum(axis=0)])
        sums = np.vstack([np.zeros((1, counts.shape[1])), counts.cumsum(axis=0)])
        for at in range(0, len(a), 1024):
            part = slice(at, at + 1024)
            x, y = a[part], b[part]
            top, least = upto[y + 1] - upto[x], (others[end[part]] - others[first[part]]).astype(np.float64)
            able = np.flatnonzero(top.max(axis=1) >= threshold * np.sqrt(least) * (1 - 1e-9))
            if not len(able):
                continue
            v = (sums[y[able] + 1] - sums[x[able]]) * self.idf
            square = (v * v).sum(axis=1)
            for j in np.flatnonzero(top[able].max(axis=1) >= (threshold - 1e-9) * np.sqrt(square + least[able])).tolist():
                i = int(able[j])
                extra = self.squares((w for ws in lists[first[at + i] : end[at + i]] for w in ws), frequencies)
                cosine = top[i] / np.sqrt(square[j] + extra)
                if cosine.max() >= threshold:
                    yield cosine


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - 2**63


def line_frequencies(files: DataFrame, text_col: str) -> DataFrame:
    """(word, df): in how many lines of all texts each word, by its 64-bit hash, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(map(word_key, seen)), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["word", "df"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    for w in set(words_of(line)):
                        seen[w] = seen.get(w, 0) + 1
                if len(seen) >= _FLUSH_WORDS:
                    yield flush()
                    seen.clear()
        yield flush()

    return cut(files.select(text_col).mapInArrow(run, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df")))


OWN = "struct<licence:string,score:double,whole:double>"


def own_licences(files: DataFrame, *, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, keep: tuple[str, ...] | None = None, own_col: str = "_own") -> DataFrame:
    """The columns of keep (all by default) and own_col: licence that the text itself states, score, and cosine of the whole
    text to its best template; all null below the threshold."""
    known = Templates(templates)
    frequencies = line_frequencies(files, text_col)
    lines = files.agg(F.sum(F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")))).first()[0] or 0
    numbers = {word_key(w): i for w, i in known.terms.items()}
    df = np.zeros(len(numbers), np.int64)
    for word, n in frequencies.where(F.col("word").isin(list(numbers))).collect():
        df[numbers[word]] = n
    known.weigh(df, lines)
    sent = files.sparkSession.sparkContext.broadcast(known)

    def split(text: str) -> list[list[bytes]]:
        return [words_of(x) for x in text.split("\n")]

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = sent.value
        for batch in batches:
            texts, chosen, words = batch.column(1).to_pylist(), [], []
            for i, text in enumerate(texts):
                lists = split(text or "")
                if used.best(lists, None, threshold)[1] >= threshold * (1 - 1e-9):
                    chosen.append(i)
                    words.append([word_key(w) for w in {w for ws in lists for w in ws} - used.terms.keys()])
            at = pa.array(chosen, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(words, pa.list_(pa.int64()))], ["tk", "text", "words"])

    texts = files.select(text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    found = cut(texts.mapInArrow(able, "tk bigint, text string, words array<bigint>"))
    copies = cut(found.groupBy("tk").agg(F.count("*").alias("n"), F.first("text").alias("text"), F.first("words").alias("words")))
    met = copies.select("tk", F.explode("words").alias("word")).join(frequencies, "word").groupBy("tk").agg(F.collect_list(F.struct("word", "df")).alias("met"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = sent.value
        for batch in batches:
            own = []
            for text, met in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lists, counted = split(text or ""), {m["word"]: m["df"] for m in met or ()}
                k, best, whole = used.best(lists, {w: counted[word_key(w)] for ws in lists for w in ws if w not in used.terms}, threshold)
                own.append({"licence": used.names[k], "score": best, "whole": whole} if best >= threshold else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.struct([("licence", pa.string()), ("score", pa.float64()), ("whole", pa.float64())]))], ["tk", "n", "own"])

    scored = cut(copies.join(met, "tk", "left").select("tk", "n", "text", "met").mapInArrow(score, f"tk bigint, n bigint, own {OWN}").where("own is not null"))
    key = fresh("_text_key", files)
    scored = scored.toDF(key, fresh("_copies", files), own_col)
    names = files.columns if keep is None else keep
    keyed = files.select(*[F.col(f"`{c}`") for c in names], text_key(F.col(text_col)).alias(key))
    out = hot_join(keyed, scored, [key], scored.columns[1], files.count(), list(names), how="left")
    return out.select(*[F.col(f"`{c}`") for c in names], own_col)


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/+$", "")


def scan(files: DataFrame, *, path_col: str = "path", text_col: str = "text", is_licence_file: Column | None = None, templates=TEMPLATES, threshold: float = THRESHOLD, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of keep (all by default), _own, _licence (own or inherited), _via ('own', 'inherited' or null) and _from (the
    lending directory); of these four, names that the files have are lengthened by underscores.

    is_licence_file tells which files with a licence lend it to their directory; by default those named LICENSE, LICENCE,
    COPYING or NOTICE, with any ending.
    """
    names = list(files.columns if keep is None else keep)
    own_name, licence, via, source = (fresh(c, files) for c in ("_own", "_licence", "_via", "_from"))
    if is_licence_file is None:
        is_licence_file = F.col(path_col).rlike(r"(?i)(^|/)(licen[sc]e|copying|notice)([.\-_][^/]*)?$")
    judged = own_licences(files, text_col=text_col, templates=templates, threshold=threshold, keep=tuple(names), own_col=own_name)
    here = fresh("_dir", judged)
    judged = cut(judged.withColumn(here, parent(F.col(path_col))))
    own = F.col(own_name)
    lenders = judged.where(F.coalesce(is_licence_file, F.lit(False)) & own["licence"].isNotNull() & F.col(here).isNotNull())
    lenders = lenders.groupBy(F.col(here).alias("above")).agg(F.min(F.struct((-own["score"]).alias("s"), F.col(path_col).alias("path"), own["licence"].alias("licence"))).alias("best")).select("above", F.col("best.licence").alias("lent"))
    dirs = judged.where(F.col(here).isNotNull()).groupBy(F.col(here).alias("dir")).agg(F.count("*").alias("files"))
    parts = F.split("dir", "/")
    # Every directory with itself and all above it, '' last; level 0 is the nearest.
    up = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    each = dirs.select("dir", "files", F.posexplode(up).alias("level", "above"))
    each = cut(each)
    # High directories are above most others, the root '' above all: lenders that many directories lie below are salted.
    below = each.groupBy("above").agg(F.count("*").alias("dirs")).join(lenders, "above")
    nearest = hot_join(each, below, ["above"], "dirs", each.count(), ["dir"]).groupBy("dir", "files").agg(F.min(F.struct("level", "above", "lent")).alias("near"))
    near, count = fresh("_near", judged), fresh("_files", judged)
    nearest = nearest.select(F.col("dir").alias(here), F.col("files").alias(count), F.col("near").alias(near))
    out = hot_join(judged, nearest, [here], count, judged.count(), [path_col], how="left")
    how = F.when(own["licence"].isNotNull(), "own").when(F.col(near).isNotNull(), "inherited")
    return out.select(*[F.col(f"`{c}`") for c in names], own_name, F.coalesce(own["licence"], F.col(near)["lent"]).alias(licence), how.alias(via), F.when(own["licence"].isNull(), F.col(near)["above"]).alias(source))


def op6(documents: DataFrame) -> DataFrame:
    """Documents as files source/lang/doc_id.txt; texts that are notices as a whole lend their licence to their directory, and
    those of English also to the whole source by lying in it."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.when(F.col("lang") != "en", F.col("lang")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = documents.select("doc_id", path.alias("path"), "text")
    out = scan(files, is_licence_file=F.col("_own.whole") >= THRESHOLD, keep=("doc_id", "path"))
    return out.select("doc_id", "path", F.col("_own.licence").alias("own_licence"), F.round("_own.score", 6).alias("score"), F.col("_licence").alias("licence"), F.col("_via").alias("via"), F.col("_from").alias("inherited_from"))
