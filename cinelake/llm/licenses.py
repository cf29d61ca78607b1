"""License scans by an exact set-similarity join, in DataFrame functions only.

Text blocks are joined with license templates by containment: a block matches if it holds at least a share
``threshold`` of a template's distinct tokens, and among them all that name the license (so that a sentence that shares only its common words
is none).  Blocks are windows of words, whatever the lines: a template of up to
S words (S a power of two) is held against all windows of 2 S words that start at multiples of S, so that every
stretch of S words lies whole in one of them.  Template tokens are ordered by their document frequency in the whole
corpus, rarest first.  A block that matches must hold one of the first |T| - need + 1 tokens (prefix filter) and have
at least ``need`` template tokens (length filter), and from the first token that both have on, each of them must
have ``need`` tokens left in that order (positional filter).  What passes is verified on the full sets.

All templates that a block matches are found.  One is dropped only where a better match of the same block, or of one
that overlaps it, covers it: the other's common tokens hold all of its own (a variant with fewer words in common).

Templates are a bounded list, so their token table is small enough to be broadcast at any corpus size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: License sentences and blocks: label, words, and the words that name the license, all of which a match holds.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted obtaining associated"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general public"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1", "gnu lesser public"),
    ("agpl", "licensed under the gnu affero general public license version 3", "gnu affero public"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution source binary permitted"),
    ("bsd", "released under the bsd 3 clause license", "bsd"),
    ("bsd", "released under the bsd license", "bsd"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copyright permission notice substantial"),
    ("gpl", "either version 3 of the license or at your option any later version see the gnu general public license for more details", "gnu general public"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "contributors endorse promote"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "authors liable arising"),
    ("boost", "distributed under the boost software license version 1 0", "boost software"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "granted sublicense furnished"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions retain reproduce"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "applicable warranties governing limitations"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "gnu general public foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser public"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero public"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla mpl"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission fee appear"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "granted anyone alter redistribute"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone compile sell means"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "granted execute transmit"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "eclipse epl"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons noncommercial"),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "creative commons noderivatives"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "deed dedicated waiving"),
]
LEAST_STRIDE = 8
THRESHOLD = 0.8
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(low: Column) -> Column:
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def token_order(words: DataFrame, tokens: list[str]) -> list[str]:
    """Template tokens by document frequency over all documents, rarest first (as many rows as templates have tokens)."""
    rows = words.select(F.explode(F.array_intersect("_w", strings(tokens))).alias("_t")).groupBy("_t").count().collect()
    seen = {r["_t"]: r["count"] for r in rows}
    return sorted(tokens, key=lambda t: (seen.get(t, 0), t))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found &= F.get(words, i + k) == part
        return F.coalesce(found, F.lit(False))

    return F.filter(at, here)


def stride_of(template: str) -> int:
    """The least power of two, from ``LEAST_STRIDE``, that is no less than a template's words."""
    return max(LEAST_STRIDE, 1 << (len(template.split()) - 1).bit_length())


def window_tokens(words: Column, stride: int, order: list[str], least: int) -> Column:
    """For each window of two strides: its distinct template tokens, rarest first; windows with fewer than ``least`` are left out.

    A window is found by its number, so that two documents' windows of one number are told apart by the document.
    """
    count = F.greatest(F.ceil(F.size(words) / stride).cast("int") - 1, F.lit(1))
    held = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.lit(stride).alias("_l"), i.alias("_i"), F.array_intersect(strings(order), F.slice(words, i * stride + 1, 2 * stride)).alias("_tok")))
    return F.filter(held, lambda w: F.size(w["_tok"]) >= least)


#: Label, words, and perhaps the words that name the license.
Template = tuple[str, str] | tuple[str, str, str]


def names_of(template: Template) -> list[str]:
    return template[2].split() if len(template) > 2 else []


def block_matches(blocks: DataFrame, order: list[str], templates: list[Template], threshold: float) -> DataFrame:
    """``_k1, _k2, _labels, _score``: what the blocks (``_k1, _k2, _l, _i, _tok``) of each document match.

    A block matches all templates whose threshold it meets, but for those that a better match, there or in the
    block before or after, covers.
    """
    rank = {t: i for i, t in enumerate(order)}
    rows = []
    for number, (label, text, *_) in enumerate(templates):
        ordered = sorted(set(text.split()), key=rank.__getitem__)
        need = needed(len(ordered), threshold)
        for place, token in enumerate(prefix(text, order, threshold)):
            rows.append((token, stride_of(text), number, label, place, need, ordered, names_of(templates[number])))
    table = blocks.sparkSession.createDataFrame(rows, "_t string, _tl int, _number int, _label string, _place int, _need int, _set array<string>, _names array<string>")
    prefixes = strings(sorted({r[0] for r in rows}))
    at = F.filter(F.transform("_tok", lambda t, j: F.struct(t.alias("_t"), j.alias("_j"))), lambda x: F.array_contains(prefixes, x["_t"]))
    met = blocks.select("_k1", "_k2", "_l", "_i", "_tok", F.inline(at))
    met = met.join(F.broadcast(table), (met["_t"] == table["_t"]) & (F.col("_l") == F.col("_tl"))).drop("_t")
    left = F.least(F.size("_set") - F.col("_place"), F.size("_tok") - F.col("_j"))
    met = met.filter((F.size("_tok") >= F.col("_need")) & (left >= F.col("_need")) & (F.size(F.array_except("_names", "_tok")) == 0))
    # The first token that both have verifies; nothing before it is common, so that the positional filter holds for it.
    met = met.filter(~F.arrays_overlap("_tok", F.slice(F.col("_set"), F.lit(1), F.col("_place"))))
    met = met.withColumn("_both", F.array_intersect("_tok", "_set")).filter(F.size("_both") >= F.col("_need"))
    match = F.struct((F.size("_both") / F.size("_set")).alias("share"), (-F.col("_number")).alias("number"), F.col("_label").alias("label"), F.col("_both").alias("both"), (F.col("_d") == 0).alias("own"))
    # A row per block with its matches and those of the two that overlap it: at most three times the templates.
    dealt = met.withColumn("_d", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    found = dealt.groupBy("_k1", "_k2", "_l", F.col("_i") + F.col("_d")).agg(F.collect_list(match).alias("_m"))
    within = lambda x, y: F.size(F.array_except(x["both"], y["both"])) == 0
    better = lambda x, y: (F.size(y["both"]) > F.size(x["both"])) | (y["share"] > x["share"]) | ((y["share"] == x["share"]) & (y["number"] > x["number"]))
    stay = F.filter("_m", lambda x: x["own"] & ~F.exists("_m", lambda y: within(x, y) & better(x, y)))
    found = found.select("_k1", "_k2", F.inline(F.transform(stay, lambda x: F.struct(x["label"].alias("_label"), x["share"].alias("_share")))))
    return found.groupBy("_k1", "_k2").agg(F.collect_set("_label").alias("_labels"), F.max("_share").alias("_score"))


def scan(docs: DataFrame, templates: list[Template] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    A null or empty text has no words and no labels; texts of any length are scanned whole.  Repeated rows are scanned
    alike, each giving a row; null ids stay null; an empty table gives no rows.  ``score`` is the best containment of a
    template in a block, and at least a half where a phrase stands.
    """
    templates = TEMPLATES if templates is None else templates
    tokens = sorted({w for t in templates for w in t[1].split()})
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    order = token_order(own.select(words_of(lowered(F.col("_text"))).alias("_w")), tokens)
    scanned = own.select("_id", lowered(F.col("_text")).alias("_low")).withColumn("_w", words_of(F.col("_low")))
    # Every template keeps a prefix token of each block that matches it, so other texts hold no match.
    near = F.arrays_overlap("_w", strings(sorted({w for t in templates for w in prefix(t[1], order, threshold)} | {p.split()[-1] for p in PHRASES})))
    scanned = scanned.withColumn("_near", near)
    place = lambda p: F.when(F.col("_near"), phrase_starts(F.col("_w"), p)).otherwise(F.array().cast("array<int>"))
    # The key is the id with a hash of the text, by which rows of one id are told apart.
    keys = [F.coalesce("_id", F.lit(0)).alias("_k1"), F.xxhash64(F.col("_low"), F.col("_id").isNull()).alias("_k2")]
    facts = scanned.select("_id", F.size("_w").cast("long").alias("n_words"), *keys, *[place(p).alias(f"_p{i}") for i, p in enumerate(PHRASES)])
    places = F.array_sort(F.concat(*[F.col(f"_p{i}") for i in range(len(PHRASES))]))
    base = F.filter(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    facts = facts.select("_id", "_k1", "_k2", "n_words", places.alias("_at"), base.alias("_base"))

    levels: dict[int, int] = {}  # stride: least tokens that a match needs
    for _, text, *_ in templates:
        need = needed(len(set(text.split())), threshold)
        levels[stride_of(text)] = min(need, levels.get(stride_of(text), need))
    blocks = scanned.filter("_near").select(*keys, F.inline(F.concat(*[window_tokens(F.col("_w"), stride, order, least) for stride, least in sorted(levels.items())])))
    out = facts.join(block_matches(blocks, order, templates, threshold), ["_k1", "_k2"], "left")
    n = F.size("_at")
    return out.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        n.cast("long").alias("n_base"),
        F.get("_at", F.lit(0)).cast("long").alias("first_word"),
        F.get("_at", n - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("_base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_labels", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.greatest(F.coalesce("_score", F.lit(0.0)), F.when(n > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def needed(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def prefix(text: str, order: list[str], threshold: float) -> list[str]:
    """The tokens of a template of which every matching block holds one."""
    rank = {t: i for i, t in enumerate(order)}
    ordered = sorted(set(text.split()), key=rank.__getitem__)
    return ordered[: len(ordered) - needed(len(ordered), threshold) + 1]


def oracle_sql() -> str:
    """The whole scan in SQL: all windows against all templates of their size, without filters."""
    listed = ", ".join(f"({i}, {stride_of(text)}, '{label}', string_split('{text}', ' '), string_split('{names}', ' '))" for i, (label, text, names) in enumerate(TEMPLATES))
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"
    spots = []
    for phrase in PHRASES:
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        spots.append(f"list_filter(range(len(w)), lambda i: coalesce({test}, false))")
    labels = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values()))
    strides = ", ".join(f"({s})" for s in sorted({stride_of(t[1]) for t in TEMPLATES}))
    return f"""
WITH templates AS (SELECT n, stride, label, list_distinct(toks) AS toks, names FROM (VALUES {listed}) AS t(n, stride, label, toks, names)),
docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
split AS (SELECT doc_id, low, {words("low")} AS w FROM docs),
spots AS (SELECT doc_id, w, {", ".join(f"{s} AS p{i}" for i, s in enumerate(spots))} FROM split),
base AS (SELECT doc_id, len(w) AS n_words, list_sort(list_concat(p0, list_concat(p1, p2))) AS spot, list_filter([{labels}], lambda x: x IS NOT NULL) AS b FROM spots),
blocks AS (SELECT doc_id, stride, i, list_distinct(w[i * stride + 1 : i * stride + 2 * stride]) AS w FROM (SELECT doc_id, stride, w, unnest(range(greatest(1, cast(ceil(len(w) / stride) AS bigint) - 1))) AS i FROM split CROSS JOIN (VALUES {strides}) AS s(stride))),
pairs AS (SELECT doc_id, stride, i, n, label, list_intersect(toks, w) AS common, len(list_intersect(toks, w)) / len(toks) AS share FROM blocks JOIN templates USING (stride) WHERE len(list_intersect(toks, w)) >= ceil({THRESHOLD} * len(toks) - 1e-9) AND list_has_all(w, names)),
covered AS (SELECT DISTINCT x.doc_id, x.stride, x.i, x.n FROM pairs x JOIN pairs y ON x.doc_id = y.doc_id AND x.stride = y.stride AND y.i BETWEEN x.i - 1 AND x.i + 1 WHERE list_has_all(y.common, x.common) AND (len(y.common) > len(x.common) OR y.share > x.share OR (y.share = x.share AND y.n < x.n))),
hits AS (SELECT pairs.* FROM pairs ANTI JOIN covered USING (doc_id, stride, i, n)),
best AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM hits GROUP BY doc_id)
SELECT doc_id, n_words, len(spot) AS n_base, spot[1] AS first_word, spot[-1] AS last_word, array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(b, coalesce(more, [])))), ',') AS labels, greatest(coalesce(share, 0.0), CASE WHEN len(spot) > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM base LEFT JOIN best USING (doc_id)
"""
