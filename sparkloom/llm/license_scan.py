"""License scans by an exact set-similarity join of text blocks and templates.

A block is a window of words; blocks overlap by half and are at least twice as long as their templates, so a template's
text lies whole in some block. A template is met where a block holds at least a share `containment` of its distinct
tokens. Tokens are ordered by their global frequency, counted over all texts first, the rarest in front. A template
that needs o of its s tokens can only be met by a block that holds one of its first s - o + 1 (prefix filter), has o
tokens of the templates' vocabulary (length filter), and has enough of them left behind the first match in the common
order (positional filter). What passes is verified on the sets. The templates are a parameter, so their index is small.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, text_bytes

# Base phrases, whose words must also stand in a row.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Passages of public licence texts, and notices.
NOTICES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-2.0": "licensed under the apache license version 2 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by-nc": "licensed under cc by nc",
    "all-rights-reserved": "all rights reserved",
}
CONTAINMENT = 0.8
#: Words of a block at least; a template's block has twice its words.
BLOCK = 32

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Lower-cases A-Z and makes what isn't part of a word a space; bytes from 0x80 are parts of words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in _SEPARATORS else b for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of digits, letters and anything outside ASCII, in lower case."""
    return data.translate(_WORDS).split()


class Templates:
    """An index of templates over the tokens that stand in any of them, ordered by global frequency."""

    def __init__(self, templates: list[tuple[str, str, float, bool]], counts: dict[bytes, int]):
        """templates: (label, text, containment, whether its words must stand in a row)."""
        texts = [words_of(t.encode()) for _, t, _, _ in templates]
        order = sorted({w for t in texts for w in t}, key=lambda w: (counts.get(w, 0), w))
        self.ranks = {w: i for i, w in enumerate(order)}
        self.templates = []
        for (label, _, share, row), words in zip(templates, texts, strict=True):
            tokens = np.array(sorted({self.ranks[w] for w in words}))
            need = max(1, math.ceil(share * len(tokens) - 1e-9))
            block = max(BLOCK, 2 * len(words))
            self.templates.append((label, tokens, need, block, np.array([self.ranks[w] for w in words]) if row else None))
        size = len(order)
        #: For each template whether a token is in its prefix, and in it at all.
        self.prefix = np.zeros((len(templates), size + 1), bool)
        self.member = np.zeros((len(templates), size + 1), bool)
        for k, (_, tokens, need, _, _) in enumerate(self.templates):
            self.prefix[k, tokens[: len(tokens) - need + 1]] = True
            self.member[k, tokens] = True

    def tokens(self, words: list[bytes]) -> np.ndarray:
        """Ranks of words; the last rank but one past the end, len(ranks), for those in no template."""
        other = len(self.ranks)
        get = self.ranks.get
        return np.fromiter((get(w, other) for w in words), np.int32, len(words))

    def scan(self, tokens: np.ndarray):
        """(template, share, start, stop of the block) of every block that meets a template, template by template."""
        held = np.flatnonzero(tokens < len(self.ranks))
        if not len(held):
            return
        known = tokens[held]
        for k, (_, own, need, block, _) in enumerate(self.templates):
            hits = held[self.prefix[k, known]]
            if not len(hits):
                continue
            stride = block // 2
            blocks = np.unique(np.concatenate([hits // stride, hits // stride - 1]))
            for b in blocks[blocks >= 0] if len(tokens) > stride else blocks[blocks == 0]:
                start, stop = int(b) * stride, min(len(tokens), int(b) * stride + block)
                have = np.unique(known[np.searchsorted(held, start) : np.searchsorted(held, stop)])
                if len(have) < need:  # length filter
                    continue
                first = have[self.prefix[k, have]]
                if not len(first):
                    continue
                at = int(first[0])
                # Positional filter: nothing matched before the first match, and this much may match from there on.
                if min(len(own) - np.searchsorted(own, at), len(have) - np.searchsorted(have, at)) < need:
                    continue
                overlap = int(self.member[k, have].sum())
                if overlap >= need:
                    yield k, overlap / len(own), start, stop

    def places(self, k: int, tokens: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Where the words of a template stand in a row within a block."""
        row = self.templates[k][4]
        span = tokens[start:stop]
        n = len(span) - len(row) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        hit = np.ones(n, bool)
        for j, r in enumerate(row):
            hit &= span[j : j + n] == r
        return np.flatnonzero(hit) + start


def token_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Texts that hold each token of the vocabulary; at most one row per token comes to the driver."""
    names = sorted(vocabulary)

    def run(batches):
        known = set(names)
        for batch in batches:
            counts: dict[bytes, int] = {}
            text = batch.column("text")
            for i in range(batch.num_rows):
                for w in known.intersection(words_of(text_bytes(text, i))):
                    counts[w] = counts.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = arrow_map(docs.select("text"), run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r.token): r.n for r in rows.collect()}


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,start:long,stop:long,containment:double>>"


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id and the columns of FOUND.

    phrases (text to label) must stand word by word: n_base counts all their places, first_word and last_word are the
    smallest and largest start, null without any. notices (label to text) are met by blocks with `containment` of their
    distinct tokens: blocks lists these, labels has both kinds, score is the largest containment met, 1 for a phrase.
    Null, empty and wordless texts have no words and no labels (''). Repeated rows get equal results; ids may be null.
    Other columns are ignored.
    """
    templates = [*((label, text, 1.0, True) for text, label in phrases.items()), *((label, text, containment, False) for label, text in notices.items())]
    vocabulary = {w for _, text, _, _ in templates for w in words_of(text.encode())}
    index = Templates(templates, token_counts(docs, vocabulary))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def one(data: bytes):
        index = sent.value
        words = words_of(data)
        tokens = index.tokens(words)
        places: dict[str, set[tuple[int, int]]] = {}
        blocks, score = [], 0.0
        for k, share, start, stop in index.scan(tokens):
            label, _, _, _, row = index.templates[k]
            if row is None:
                blocks.append({"label": label, "start": start, "stop": stop, "containment": share})
                score = max(score, share)
            elif len(at := index.places(k, tokens, start, stop)):
                places.setdefault(label, set()).update((k, x) for x in at.tolist())
                score = 1.0
        starts = {x for found in places.values() for x in found}
        at = [x for _, x in starts]
        return len(words), len(starts), min(at, default=None), max(at, default=None), ",".join(sorted(places)), ",".join(sorted({*places, *(b["label"] for b in blocks)})), score, blocks

    def run(batches):
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("containment", pa.float64())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
        for batch in batches:
            text = batch.column("text")
            rows = [one(text_bytes(text, i)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], ["doc_id", *names])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return license_scan(table(spark, sf_dir, "documents")).drop("blocks")


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """The base columns by visiting every place, for tests: n_words, n_base, first_word, last_word, base_labels."""
    import re

    out = {}
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
        at, labels = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        out[d] = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    return out
