"""License scans by diagonal voting.

All rolling word k-grams of all texts are hashed and joined by Spark with the k-gram positions of the templates (a fixed
list, so its side is broadcast). A hit at word p of a text and word t of a template votes for the diagonal p - t. Votes
are summed by (text, template, diagonal), neighbouring diagonals are merged, since inserted or missing words move the
offset, and spans with enough votes are verified on the words themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, gram_hashes, hash_bytes, hash_words, materialise, text_chunks, tidy, word_table

K = 2
#: Diagonals at most this far apart are merged.
GAP = 3
#: Share of a template's k-grams that must vote, and share of its words that must stand in order in the span.
VOTES, COVER = 0.5, 0.9
#: Up to so many bytes of spans are broadcast to the verification; more take a shuffle join.
BROADCAST_BYTES = 16 << 20

#: Phrases whose every place counts, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Passages of public licenses and their headers, with their labels.
PASSAGES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
DELIMITERS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: A-Z are folded before words are cut.
_INSIDE = word_table(bytes(b for b in DELIMITERS if not 65 <= b <= 90))


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def _common_length(a: Sequence[bytes], b: Sequence[bytes]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        u = row & masks.get(w, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _templates(phrases: Sequence[tuple[str, str]], passages: Sequence[tuple[str, str]]) -> list[tuple[list[bytes], str, bool]]:
    found = [(words_of(t), label, base) for group, base in ((phrases, True), (passages, False)) for t, label in group]
    if any(not K <= len(w) <= 62 + K for w, _, _ in found):
        raise ValueError(f"a template has from {K} to {62 + K} words")
    return found


def _key() -> list:
    return [F.xxhash64("key").alias("k1"), F.xxhash64("text").alias("k2")]


def license_scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES, passages: Sequence[tuple[str, str]] = PASSAGES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row.

    spans lists (label, start, end, cover) of what was verified, starts in words from 0; n_base, first_word, last_word
    and base_labels tell of the places of whole phrases, labels has those of the passages too, both sorted, distinct and
    joined by commas ("" if none), score is the best cover (0 without a span). A null or empty text has no words and no
    spans. A null key stays null, repeated rows stay repeated with equal results, an empty table gives an empty table,
    and other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    templates = _templates(phrases, passages)
    rows = []
    for i, (words, _, _) in enumerate(templates):
        grams = gram_hashes(np.array([hash_bytes(w) for w in words], dtype=np.uint64), K).view(np.int64).tolist()
        rows += [(g, i, t, 1 << t) for t, g in enumerate(grams)]
    places = F.broadcast(spark.createDataFrame(rows, "gram long, template int, t int, bit long"))
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    @tidy
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, cuts in text_chunks(batch, "text"):
                s, _, h = hash_words(buf, cuts, _INSIDE)
                at = np.searchsorted(s, cuts)
                g = gram_hashes(h, K).view(np.int64)
                n = np.maximum(np.diff(at) - K + 1, 0)
                take = np.repeat(at[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(g[take] if len(take) else np.empty(0, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("k1").slice(lo, hi - lo), batch.column("k2").slice(lo, hi - lo), lists], ["k1", "k2", "grams"])

    every = source.select(*_key(), "text").mapInArrow(grams, "k1 long, k2 long, grams array<long>").select("k1", "k2", F.posexplode("grams").alias("p", "gram"))
    hits = every.join(places, "gram").select("k1", "k2", "template", (F.col("p") - F.col("t")).alias("d"), "bit")
    votes = hits.groupBy("k1", "k2", "template", "d").agg(F.bit_or("bit").alias("mask"))
    # runs of neighbouring diagonals of a passage; a phrase keeps its diagonals apart
    n_phrases = len(phrases)
    by = Window.partitionBy("k1", "k2", "template").orderBy("d")
    new = F.when((F.col("template") < n_phrases) | (F.col("d") - F.lag("d").over(by) > GAP) | F.lag("d").over(by).isNull(), 1).otherwise(0)
    runs = votes.withColumn("new", new).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("k1", "k2", "template", "run").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.bit_count(F.bit_or("mask")).alias("votes"))
    need = F.create_map(*(F.lit(x) for i, (w, _, base) in enumerate(templates) for x in (i, len(w) - K + 1 if base else max(1, int(np.ceil(VOTES * (len(w) - K + 1)))))))
    spans = spans.where(F.col("votes") >= need[F.col("template")]).groupBy("k1", "k2").agg(F.collect_list(F.struct("template", "lo", "hi")).alias("found"))
    spans = materialise(spans, "spans")
    if (spans.agg(F.sum(F.lit(32) + F.size("found") * 48)).first()[0] or 0) <= BROADCAST_BYTES:
        spans = F.broadcast(spans)

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            n_words: list[int] = []
            for _, _, buf, cuts in text_chunks(batch, "text"):
                s, _, _ = hash_words(buf, cuts, _INSIDE)
                n_words += np.diff(np.searchsorted(s, cuts)).tolist()
            for i, found in enumerate(batch.column("found").to_pylist()):
                base, spans = [], []
                if found:
                    words = words_of(batch.column("text")[i].as_py())
                    for f in found:
                        template, label, is_base = templates[f["template"]]
                        if is_base:
                            if words[f["lo"] : f["lo"] + len(template)] == template:
                                base.append((f["lo"], label))
                                spans.append((label, f["lo"], f["lo"] + len(template), 1.0))
                        else:
                            lo, hi = max(0, f["lo"]), min(len(words), f["hi"] + len(template))
                            cover = _common_length(template, words[lo:hi]) / len(template)
                            if cover >= COVER:
                                spans.append((label, lo, hi, cover))
                starts = [x for x, _ in base]
                out.append((len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted({x[0] for x in spans})), max((x[3] for x in spans), default=0.0), [dict(zip(("label", "start", "end", "cover"), x, strict=True)) for x in sorted(spans, key=lambda x: (x[1], x[2], x[0]))]))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n_words, pa.int64()), *(pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds))], names)

    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kind = docs.schema[key].dataType.simpleString()
    whole = source.select("key", "text", *_key()).join(spans, ["k1", "k2"], "left").select("key", "text", "found")
    return whole.mapInArrow(verify, f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,cover:double>>")
