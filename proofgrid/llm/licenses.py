"""License scans by diagonal voting.

Every rolling word k-gram of a document passes a filter of fixed size and is joined, in Spark, with the templates' positions.
Hits vote for the diagonal (place in the document minus place in the template); neighbouring diagonals merge, so a few words
more or less do no harm; the words of each merged span that has enough votes are then compared with the template's, word by
word and in order, and the share of the template found decides; of spans that lie over each other that with the largest share
stays, of equals the longer. Base phrases are templates as well, with grams as long as they
are: each of their diagonals is a place, verified by its one gram.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after folding A-Z. score is the largest verified share of a template, 1 with a base
phrase; without one half the largest share of votes; 0 without a hit.

Defined cases: a null or empty text has no words; each input row gives one result row, also repeated ones; places of a text that
holds a template several times each vote for themselves; of equal shares the first by place counts; a very long text is read in one
piece; an empty table gives an empty result; other columns are ignored. Templates are a parameter; their positions are broadcast
only where they are small.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .shared import broadcast_if_small, id_key, materialize, may_be_in, text_key

#: Words of a gram, how far apart diagonals of one span are, share of votes that is compared, share of words that counts.
GRAM, NEAR, VOTES, SHARE = 4, 3, 0.3, 0.6
FILTER_BITS = 1 << 20
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
#: Texts and notices of public licenses, as words, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + WARRANTY),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
]


def sequence_hashes(text: str, k: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return W.grams(W.Words(data, np.array([0, len(data)]), W.byte_class(True, True)).hashes(), k)


def positions(templates: list[tuple[str, str]]) -> list[tuple]:
    """(template, label, base, words, gram, k, at, size): each gram of the templates and of the base phrases."""
    out, every = [], [(label, text, False) for label, text in templates] + [(label, text, True) for text, label in BASE.items()]
    for t, (label, text, base) in enumerate(every):
        k = min(GRAM, len(text.split()))
        hashes = sequence_hashes(text, k).view(np.int64)
        out += [(t, label, base, text, int(g), k, i, len(hashes)) for i, g in enumerate(hashes)]
    return out


def scanned(documents: DataFrame, table: list[tuple]) -> DataFrame:
    """(k1, k2, doc_id, n_words, hits) of every row, written: k-grams that may stand in a template."""
    kind, sizes = W.byte_class(True, True), sorted({r[5] for r in table})
    bits = np.zeros(FILTER_BITS, bool)
    bits[np.array([r[4] for r in table], np.int64).view(np.uint64) % np.uint64(FILTER_BITS)] = True
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(bool)
        for b in batches:
            for lo, hi, data, offsets in W.chunks(b.column("text")):
                w = W.Words(data, offsets, kind)
                h, doc, n = w.hashes(), w.text_of_word(), hi - lo
                at, gram, size = [], [], []
                for k in sizes:
                    g = W.grams(h, k)
                    i = np.flatnonzero(known[(g % np.uint64(FILTER_BITS)).astype(np.int64)] & W.within(w.first, k, len(g)))
                    at, gram, size = [*at, i], [*gram, g[i]], [*size, np.full(len(i), k, np.int32)]
                at, gram, size = np.concatenate(at), np.concatenate(gram), np.concatenate(size)
                order = np.argsort(at, kind="stable")
                at, gram, size = at[order], gram[order], size[order]
                counts = np.bincount(doc[at], minlength=n) if len(at) else np.zeros(n, np.int64)
                hits = pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(size), pa.array(at - w.first[:-1][doc[at]] if len(at) else at)], ["gram", "k", "pos"])
                where = np.zeros(n + 1, np.int32)
                np.cumsum(counts, out=where[1:])
                part = b.slice(lo, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k1", "k2", "doc_id")), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(where), hits)], ["k1", "k2", "doc_id", "n_words", "hits"])
        W.release()

    out = f"k1 long, k2 long, doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_words long, hits array<struct<gram: long, k: int, pos: long>>"
    return materialize(documents.select(id_key(), text_key(), "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, out), "license-hits")


def voted(rows: DataFrame, table: list[tuple]) -> DataFrame:
    """(k1, k2, template, label, base, words, size, share, a, b), written: merged diagonals with their share of votes; words a to b."""
    side = materialize(rows.sparkSession.createDataFrame(table, "template int, label string, base boolean, words string, gram long, k int, at int, size int"), "license-templates")
    hits = rows.filter(F.size("hits") > 0).select("k1", "k2", F.explode("hits").alias("h")).select("k1", "k2", "h.*").distinct()
    key = ["k1", "k2", "template", "base", "size", "k"]
    grams = broadcast_if_small(side.drop("label", "words"))
    votes = hits.join(grams, ["gram", "k"]).groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    order = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    merged = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order)).groupBy(*key, "span").agg(F.sum("votes").alias("votes"), F.min("a").alias("a"), (F.max("b") + F.col("k")).alias("b"))
    texts = broadcast_if_small(side.select("template", "label", "words").distinct())
    return materialize(merged.join(texts, "template").select("k1", "k2", "template", "label", "base", "words", "size", F.least(F.lit(1.0), F.col("votes") / F.col("size")).alias("share"), "a", "b"), "license-votes")


def aligned(words: list[bytes], template: list[bytes]) -> tuple[float, int, int]:
    """(share of the template's words that stand in words, in order; first and last of these places)."""
    blocks = [x for x in SequenceMatcher(None, words, template, autojunk=False).get_matching_blocks() if x.size]
    return (sum(x.size for x in blocks) / len(template), blocks[0].a, blocks[-1].a + blocks[-1].size) if blocks else (0.0, 0, 0)


def settled(spans: list[tuple]) -> list[tuple]:
    """(share, a, b, label) of one document without those of which another with a larger share, or as large and longer, covers half."""
    kept: list[tuple] = []
    for share, a, b, label in sorted(set(spans), key=lambda s: (-s[0], s[1] - s[2], s[1], s[3])):
        if all(2 * (min(b, y) - max(a, x)) <= b - a for _, x, y, _ in kept):
            kept.append((share, a, b, label))
    return kept


def verified(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(k1, k2, label, share, a, b) of spans whose words are the template's, at least SHARE of them, in a stretch of twice its length at most."""
    kind = W.byte_class(True, True)
    keyed = documents.select(id_key(), text_key(), F.col("text").cast("string").alias("text"))
    able = may_be_in(keyed, spans.select("k1", "k2"), "k1", "k2")[0]
    own = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("label", "words", "a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k1, k2, text, spans in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text", "spans")), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                w = W.Words(data, np.array([0, len(data)]), kind)
                low, own = W.LOWER[data], []
                for s in spans:
                    template = s["words"].encode().split()
                    lo, hi = max(0, s["a"] - len(template)), min(len(w.starts), s["b"] + len(template))
                    share, x, y = aligned([low[i:j].tobytes() for i, j in zip(w.starts[lo:hi], w.ends[lo:hi], strict=True)], template)
                    if share >= SHARE and y - x <= 2 * len(template):
                        own.append((share, lo + x, lo + y, s["label"]))
                out += [(k1, k2, label, share, x, y) for share, x, y, label in settled(own)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["k1", "k2", "label", "share", "a", "b"])

    return able.join(own, ["k1", "k2"]).mapInArrow(run, "k1 long, k2 long, label string, share double, a long, b long")


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row a document: words, base places and labels, the method's labels, score and verified spans."""
    table = positions(TEMPLATES if templates is None else templates)
    rows = scanned(documents, table)
    spans = voted(rows, table)
    base = spans.filter("base").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("a").alias("first_word"), F.max("a").alias("last_word"), F.array_sort(F.collect_set("label")).alias("base_labels"))
    found = verified(documents, spans.filter(~F.col("base") & (F.col("share") >= VOTES))).groupBy("k1", "k2").agg(F.collect_set("label").alias("more"), F.max("share").alias("best"), F.array_sort(F.collect_set(F.struct("a", "b", "label"))).alias("spans"))
    weak = spans.filter(~F.col("base")).groupBy("k1", "k2").agg((F.max("share") / 2).alias("weak"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union(F.coalesce("base_labels", none), F.coalesce("more", none)))
    score = F.when(F.col("n") > 0, 1.0).otherwise(F.coalesce("best", "weak", F.lit(0.0)))
    joined = rows.drop("hits").join(base, ["k1", "k2"], "left").join(found, ["k1", "k2"], "left").join(weak, ["k1", "k2"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), labels.alias("labels"), score.alias("score"), "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return s.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score")
