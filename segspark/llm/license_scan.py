"""License scan by diagonal voting.

All rolling word k-grams of a text are hashed (k = 2 for the short base phrases, k = 4 for longer
templates); those whose hash occurs in some template are joined by Spark to the template positions. A hit votes for the diagonal (word index in the text
minus word index in the template); neighbouring diagonals of one template are merged, and each
merged run is verified by alignment: the longest common subsequence of the template's words and the
words of the run's own span. A base phrase is a place where every word of a phrase template stands
consecutively; a longer template is present if the share of its words in that alignment is COVER.

Only hits that pass a table of template hashes leave the scan, so the join moves a small multiple
of the license text in the corpus, never the corpus itself. Templates are a fixed, small table.

Edge cases: null and empty texts have no words, null first_word and last_word, empty labels and
score 0. Repeated rows are answered one by one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wording of widely used public licenses and notices, with the label of each.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: Least share of a long template's words that a run must cover, and diagonals that are merged.
COVER, DRIFT = 0.7, 3
#: Words of a k-gram: of the base phrases, and of the longer templates.
SHORT, LONG = 2, 4

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = np.zeros(256, np.bool_)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Bytes hashed at once.
BLOCK = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, p, np.uint64)]), dtype=np.uint64) for p in (_P, inverse))


def word_hashes(data: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word in data (bytes), and a 64-bit polynomial hash of its lower-cased bytes."""
    data = _LOWER[data]
    inside = np.concatenate([[False], _WORD[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * tables[0][: len(data)], dtype=np.uint64)])
        h = (run[ends] - run[starts]) * tables[1][starts]
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return starts, h ^ (h >> np.uint64(32))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of word hashes; of differing k they differ."""
    if len(words) < k:
        return words[:0]
    with np.errstate(over="ignore"):
        h = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            h = (h * _P + words[i : len(words) - k + 1 + i]) * _MIX
        return h ^ (h >> np.uint64(31))


def _template_rows() -> list[tuple]:
    tables, rows = powers(4096), []
    for k, (text, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()]):
        _, w = word_hashes(np.frombuffer(text.encode(), np.uint8), tables)
        rows += [(int(h), k, i) for i, h in enumerate(gram_hashes(w, SHORT if k < len(PHRASES) else LONG).view(np.int64))]
    return rows


def _names() -> list[tuple]:
    pairs = [*PHRASES.items(), *TEMPLATES.items()]
    return [(k, label, len(text.split()), text, k < len(PHRASES)) for k, (text, label) in enumerate(pairs)]


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: row, doc_id, n_words, hits (array of hash, word position, the words from there)."""
    prepare(docs.sparkSession)
    wanted = np.sort(np.array(sorted({h for h, _, _ in _template_rows()}), np.int64))
    longest = max(n for _, _, n, _, _ in _names()) + DRIFT
    schema = "doc_id long, n_words long, hits array<struct<hash:long,at:long,words:string>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = powers(BLOCK + 8)
        small = np.zeros(1 << 16, np.bool_)
        small[wanted.view(np.uint64) & np.uint64(0xFFFF)] = True
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).to_pylist():
                data = np.frombuffer((text or "").encode(), np.uint8)
                first, last, n, hits = 0, 0, 0, []
                starts_all, hashes = [], []
                while first < len(data):  # in blocks that end between words
                    last = min(first + BLOCK, len(data))
                    if last < len(data):
                        gaps = np.flatnonzero(~_WORD[data[first:last]])
                        last = first + int(gaps[-1]) + 1 if len(gaps) else last
                    if last == first + BLOCK and last < len(data) and _WORD[data[last - 1]]:  # a word longer than a block matches nothing
                        rest = np.flatnonzero(~_WORD[data[last:]])
                        last = last + int(rest[0]) if len(rest) else len(data)
                        starts_all.append(np.array([first]))
                        hashes.append(np.zeros(1, np.uint64))
                    else:
                        s, h = word_hashes(data[first:last], tables)
                        starts_all.append(s + first)
                        hashes.append(h)
                    first = last
                if starts_all:
                    starts, h = np.concatenate(starts_all), np.concatenate(hashes)
                    n = len(starts)
                    for k in (SHORT, LONG):
                        grams = gram_hashes(h, k)
                        maybe = np.flatnonzero(small[grams & np.uint64(0xFFFF)])
                        signed = grams[maybe].view(np.int64)
                        sure = np.isin(signed, wanted)
                        for i, x in zip(maybe[sure].tolist(), signed[sure].tolist(), strict=True):
                            end = starts[i + longest] if i + longest < n else len(data)
                            hits.append({"hash": x, "at": i, "words": _window(data, starts, i, longest, end)})
                counts.append(n)
                found.append(hits)
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("words", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(found, kind)], ["doc_id", "n_words", "hits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema)


def _window(data: np.ndarray, starts: np.ndarray, i: int, longest: int, end: int) -> str:
    """The lower-cased words i to i + longest, joined by blanks; of a word longer than any of a template, 64 bytes tell it apart."""
    out = []
    for s in starts[i : i + longest].tolist():
        piece = _LOWER[data[s : min(s + 64, end)]]
        stop = np.flatnonzero(~_WORD[piece])
        out.append(piece[: stop[0] if len(stop) else None].tobytes().decode("utf-8", "replace"))
    return " ".join(out)


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of integers."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        same = row & at.get(w, 0)
        row = ((row + same) | (row - same)) & full
    return len(a) - row.bit_count()


def _aligned(runs: DataFrame) -> DataFrame:
    """row, label, base, start, share: the share of the template's words that align with the run's span."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for n, phrase, skipped, words in zip(*(batch.column(k).to_pylist() for k in range(4, 8)), strict=True):
                share.append(common(phrase.split(" "), words.split(" ")[: n - skipped + DRIFT]) / n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(share, pa.float64())], ["row", "label", "base", "start", "share"])

    return runs.mapInArrow(work, "row long, label string, base boolean, start long, share double")


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs: array of (label, base, start word, words, share); one row per row of docs."""
    spark = docs.sparkSession
    scanned = stored(scan(docs).withColumn("row", F.monotonically_increasing_id()), "license-scan")
    positions = spark.createDataFrame(_template_rows(), "hash long, template int, pos int")
    names = spark.createDataFrame(_names(), "template int, label string, n int, phrase string, base boolean")
    hits = scanned.where(F.size("hits") > 0).select("row", F.inline("hits")).join(F.broadcast(positions), "hash")
    votes = hits.groupBy("row", "template", (F.col("at") - F.col("pos")).alias("diagonal")).agg(
        F.count_distinct("pos").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"), F.min_by("words", "at").alias("words"), F.min("pos").alias("from")
    ).join(F.broadcast(names), "template")
    exact = votes.where(F.col("base") & (F.col("votes") == F.col("n") - 1) & F.concat(F.col("words"), F.lit(" ")).startswith(F.concat(F.col("phrase"), F.lit(" "))))
    exact = exact.select("row", "label", "base", F.col("first").alias("start"), F.lit(1.0).alias("share"))
    # Neighbouring diagonals of a template, near each other in the text, are one run.
    order = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    far = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > DRIFT) | (F.col("first") - F.lag("last").over(order) > F.col("n"))
    runs = (
        votes.where(~F.col("base") & (F.col("votes") >= 2))
        .withColumn("new", F.coalesce(far, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("new").over(order))
        .groupBy("row", "template", "label", "base", "n", "phrase", "run")
        .agg(F.min("first").alias("start"), F.min_by("words", "first").alias("words"), F.min_by("from", "first").alias("from"))
    )
    loose = _aligned(runs.select("row", "label", "base", "start", "n", "phrase", "from", "words")).where(F.col("share") >= COVER)
    gathered = exact.unionByName(loose).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "label", "base", "share"))).alias("runs"))
    none = F.expr("cast(array() as array<struct<start:bigint,label:string,base:boolean,share:double>>)")
    return scanned.select("row", "doc_id", "n_words").join(gathered, "row", "left").select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"))


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op7."""
    base = F.filter("runs", lambda r: r["base"])
    names = lambda runs: F.array_join(F.array_sort(F.array_distinct(F.transform(runs, lambda r: r["label"]))), ",")
    starts = F.transform(base, lambda r: r["start"])
    return licenses(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("runs")).alias("labels"),
        F.coalesce(F.array_max(F.transform("runs", lambda r: r["share"])), F.lit(0.0)).cast("double").alias("score"),
    )
