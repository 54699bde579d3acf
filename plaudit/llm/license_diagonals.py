"""License scan by diagonal voting, in DataFrame functions only.

Every template (a license phrase or notice) is a row of words; its rolling grams (three
words; the only gram of a two-word template is that pair) are joined with the rolling
grams of all texts by hash, and the words of a hit are compared, so a hash alone finds
nothing. A hit votes for its diagonal, the word of the text at which the template would
begin. Votes of a diagonal are kept as bit masks over the template's grams, so copies,
repeats and partial aggregates fold into the same few numbers. Diagonals of a template
that lie within ``slack`` words of the one before (an eighth of the template, for words
left out or put in) are merged, and a span is verified by the share of the template's
grams that its diagonals hold together (``least``) and by how far they drift apart (at
most half the template).

Base phrases count only where they stand word by word: all grams on one diagonal, and
diagonals never merge. The text's words are split once; each text also sends one marker
through the same join, so texts without any hit keep their row and nothing is read
twice. Rows are told apart by id and two hashes of the text; equal rows are counted
and dealt out again in the end, a large number of them over many tasks.

The grams of the templates are broadcast while there are at most BROADCAST_GRAMS of
them, beyond that Spark joins as it likes. The result is the same.

Null or empty texts, and texts of separators: no words, null places, empty labels and
score 0. Null and repeated ids, repeated rows: row by row. Other columns are ignored,
whatever their names. Spans may overlap; each template and place counts by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaudit.llm.common import LOWER, UPPER

#: fixed values: phrase -> label that count word by word
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: names and notices of licenses -> label, as they are printed in files and pages
TEMPLATES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "apache license": "apache",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
    "the license you may obtain a copy of the license at": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd",
    "gnu gpl": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation": "gpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "eclipse public license": "epl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc0 1 0": "cc0",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "no part of this publication may be reproduced stored in a retrieval system or transmitted in any form or by any "
    "means": "reserved",
    "unauthorized copying of this file via any medium is strictly prohibited": "proprietary",
    "spdx license identifier": "spdx",
}

BROADCAST_GRAMS = 200_000
BITS = 62          # grams a mask holds
DEALT = 1000       # equal rows that one task deals out at most
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MARK = -1         # template number of a text's marker


def _words(text):
    """['', word, ..., word, '']: the text between two separators, split at all."""
    return F.split(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), _SPLIT)


def _lower(word):
    return F.translate(word, UPPER, LOWER)


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """A row per gram: hash, words, gram number ``at``, and of its template the number
    ``tid``, label, whether it is a base phrase, grams, words and slack."""
    rows = [(label, text, True) for text, label in phrases.items()] \
        + [(label, text, False) for text, label in templates.items()]
    if any(len(text.split()) < 2 for _, text, _ in rows):
        raise ValueError("a template needs two words")
    frame = spark.range(1).select(F.posexplode(F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(base).alias("base"))
        for label, text, base in rows])).alias("tid", "t")) if rows else \
        spark.range(0).selectExpr("int(id) tid", "named_struct('label', '', 'text', '', 'base', true) t")
    frame = frame.select("tid", "t.label", "t.base", _words(_lower(F.col("t.text"))).alias("w")) \
        .withColumn("n", F.size("w") - 2).withColumn("grams", F.greatest(F.lit(1), F.col("n") - 2))
    frame = frame.select("*", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("at"))
    word = lambda k: F.get("w", F.col("at") + k)
    frame = frame.select(F.xxhash64(word(1), word(2)).alias("g_hash"), word(1).alias("g1"), word(2).alias("g2"),
                         F.when(F.col("n") > 2, word(3)).alias("g3"), "at", "tid", "label", "base", "grams", "n",
                         F.when(F.col("base"), 0).otherwise(F.greatest(F.lit(2), F.expr("n div 8"))).alias("slack"))
    mark = spark.range(1).select(
        F.lit(0).cast("long").alias("g_hash"), F.lit("").alias("g1"), F.lit(None).cast("string").alias("g2"),
        F.lit(None).cast("string").alias("g3"), F.lit(0).alias("at"), F.lit(_MARK).alias("tid"),
        F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(1).alias("grams"),
        F.lit(1).alias("n"), F.lit(0).alias("slack"))
    grams = frame.unionByName(mark)
    return F.broadcast(grams) if sum(len(t.split()) for _, t, _ in rows) <= BROADCAST_GRAMS else grams


def _diagonals(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Masks of the hits by row, template, diagonal and block of grams; markers with
    the number of equal rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    w = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h1"),
                    F.xxhash64(F.lit("second"), text).alias("_h2"), _words(F.col(text_col)).alias("_w"))
    w = w.select("*", (F.size("_w") - 2).cast("long").alias("_n"), F.posexplode("_w").alias("_pos", "_word"))
    after = lambda k: F.get("_w", F.col("_pos") + k)
    w = w.withColumn("_hash", F.when(F.col("_pos") == 0, F.lit(0).cast("long"))
                     .otherwise(F.xxhash64(F.lower("_word"), F.lower(after(1)))))
    same = (F.col("_hash") == F.col("g_hash")) & (F.col("g1") == _lower(F.col("_word"))) \
        & (F.col("g2").isNull() | (F.col("g2") == _lower(after(1)))) \
        & (F.col("g3").isNull() | (F.col("g3") == _lower(after(2)))) \
        & ((F.col("_pos") == 0) == (F.col("tid") == _MARK))
    hits = w.join(grams, same).select(
        "_id", "_h1", "_h2", "_n", "tid", "label", "base", "grams", "n", "slack",
        F.when(F.col("tid") == _MARK, 0).otherwise(F.col("_pos") - 1 - F.col("at")).cast("long").alias("diag"),
        F.expr(f"at div {BITS}").alias("block"),
        F.expr(f"shiftleft(1L, int(at % {BITS}))").alias("bit"))
    return hits.groupBy("_id", "_h1", "_h2", "_n", "tid", "label", "base", "grams", "n", "slack", "diag", "block").agg(
        F.bit_or("bit").alias("mask"), F.count(F.lit(1)).alias("times"))


def _spans(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Merged diagonals: a row per row, template and span, and one per marker."""
    d = _diagonals(docs, grams, id_col, text_col)
    row = ["_id", "_h1", "_h2", "_n", "tid"]
    w = Window.partitionBy(*row).orderBy("diag", "block")
    gap = F.col("diag") - F.lag("diag").over(w)
    d = d.withColumn("opens", F.when(gap <= F.col("slack"), 0).otherwise(1))
    d = d.withColumn("span", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kind = [*row, "label", "base", "grams", "n", "span"]
    d = d.groupBy(*kind, "block").agg(F.bit_or("mask").alias("mask"), F.min("diag").alias("lo"),
                                      F.max("diag").alias("hi"), F.max("times").alias("times"))
    return d.groupBy(*kind).agg(
        (F.sum(F.bit_count("mask")) / F.first("grams")).alias("coverage"), F.min("lo").alias("lo"),
        F.max("hi").alias("hi"), F.max("times").alias("times"))


def _found(least: float):
    """Whether a span holds: base phrases whole, templates by coverage and drift."""
    return (F.col("tid") != _MARK) & F.when(F.col("base"), F.col("coverage") == 1.0).otherwise(
        (F.col("coverage") >= least) & (F.col("hi") - F.col("lo") <= F.greatest(F.lit(2), F.expr("n div 2"))))


def license_spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
                  least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: id, label, whether a base phrase, first word, the word behind the
    last and coverage. Rows equal in id and text give their spans once."""
    s = _spans(docs, template_grams(docs.sparkSession, phrases, templates), id_col, text_col)
    return s.where(_found(least)).select(
        F.col("_id").alias(id_col), "label", "base", F.greatest("lo", F.lit(0)).alias("first_word"),
        F.least(F.col("hi") + F.col("n"), F.col("_n")).alias("end_word"), "coverage")


def license_report(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
                   least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases with the first and the last,
    labels of base phrases, all labels, and the best coverage of any template."""
    s = _spans(docs, template_grams(docs.sparkSession, phrases, templates), id_col, text_col)
    base, found, mark = F.col("base") & _found(least), _found(least), F.col("tid") == _MARK
    listed = lambda cond: F.concat_ws(",", F.sort_array(F.collect_set(F.when(cond, F.col("label")))))
    out = s.groupBy("_id", "_h1", "_h2", "_n").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("lo"))).alias("first_word"),
        F.max(F.when(base, F.col("lo"))).alias("last_word"), listed(base).alias("base_labels"),
        listed(found).alias("labels"),
        F.coalesce(F.max(F.when(~mark, F.col("coverage"))), F.lit(0.0)).alias("score"),
        F.max(F.when(mark, F.col("times"))).alias("_times"))
    # equal rows again, DEALT a task at most
    out = out.withColumn("_part", F.explode(F.sequence(F.lit(0), F.expr(f"(_times - 1) div {DEALT}"))))
    out = out.repartition("_id", "_h1", "_part").withColumn("_copy", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(DEALT), F.col("_times") - F.col("_part") * DEALT).cast("int"))))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_words"), "n_base", "first_word", "last_word",
                      "base_labels", "labels", "score")


def report_sql(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, least: float = 0.6) -> str:
    """DuckDB SQL of ``license_report`` over ``documents`` (ids not repeated), by words
    instead of hashes and lists instead of masks."""
    quoted = ", ".join(f"({k}, '{label}', {base}, '{text}')" for k, (text, label, base) in enumerate(
        [(t, x, "true") for t, x in phrases.items()] + [(t, x, "false") for t, x in templates.items()]))
    return f"""WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+') AS w FROM documents),
tpl AS (SELECT tid, label, base, string_split(text, ' ') AS w
        FROM (VALUES {quoted}) AS v(tid, label, base, text)),
gram AS (SELECT tid, label, base, len(w) AS n, greatest(1, len(w) - 2) AS grams,
                CASE WHEN base THEN 0 ELSE greatest(2, len(w) // 8) END AS slack, i AS nth,
                array_to_string(w[i + 1:i + least(len(w), 3)], ' ') AS g, least(len(w), 3) AS k
         FROM tpl, unnest(generate_series(0, greatest(1, len(w) - 2) - 1)) AS u(i)),
pos AS (SELECT doc_id, i, array_to_string(w[i:i + 1], ' ') AS g2, array_to_string(w[i:i + 2], ' ') AS g3, len(w) AS n
        FROM doc, unnest(generate_series(1, len(w))) AS u(i)),
hit AS (SELECT doc_id, tid, i - 1 - nth AS diag, nth FROM pos JOIN gram ON k = 2 AND g = g2 AND i < pos.n
        UNION SELECT doc_id, tid, i - 1 - nth, nth FROM pos JOIN gram ON k = 3 AND g = g3 AND i < pos.n - 1),
dg AS (SELECT doc_id, tid, diag, list(nth) AS ats FROM hit GROUP BY ALL),
op AS (SELECT dg.*, t.*  EXCLUDE (tid), CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, dg.tid ORDER BY diag)
                         <= slack THEN 0 ELSE 1 END AS opens
       FROM dg JOIN (SELECT DISTINCT tid, label, base, n, grams, slack FROM gram) t USING (tid)),
num AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, tid ORDER BY diag) AS span FROM op),
sp AS (SELECT doc_id, tid, label, base, n, grams, span, min(diag) AS lo, max(diag) AS hi,
              len(list_distinct(flatten(list(ats)))) / grams AS coverage
       FROM num GROUP BY doc_id, tid, label, base, n, grams, span),
ok AS (SELECT *, CASE WHEN base THEN coverage = 1 ELSE coverage >= {least} AND hi - lo <= greatest(2, n // 2) END AS found
       FROM sp),
per AS (SELECT doc_id, count(*) FILTER (base AND found) AS n_base, min(lo) FILTER (base AND found) AS first_word,
               max(lo) FILTER (base AND found) AS last_word, max(coverage) AS score,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND found) AS base_labels,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels FROM ok GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM doc LEFT JOIN per USING (doc_id)"""
