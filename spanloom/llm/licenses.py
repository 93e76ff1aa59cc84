"""License scans by a positional rare-token index, with DataFrame functions only.

Templates are sentences of well-known licences; a posting is a template's word and its place. How rare a word is, is
counted over all files. Of each template the rarest postings are looked up: a file's rarest words of them, wherever
they stand, name the place where the template would begin; the other postings must agree with that place by weight,
and the template's key phrase must stand there word by word. A base phrase is a template that is its own key phrase,
looked up by its rarest word at every place. All of it works on the words of one row, so no file or word is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import table

#: Fixed value: words of lower-cased text.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label, sentence of the licence or of its notice, key phrase within it.
TEMPLATES = (
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0 the license", "apache license version"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright"),
    ("epl", "the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "without any express or implied warranty"),
)
#: Postings of a template that count, words of a file that look it up, hundredths of the weight that must agree.
RARE, LOOKUPS, AGREE = 8, 3, 60


def tokens(text: Column) -> Column:
    """The words of a text. Beside A-Z, lower() moves letters that no template holds; the one sign that it would turn
    into an ASCII letter (U+212A, into k) is put aside first."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é"))), F.lit(WORDS), F.lit(0))


def _start(sentence: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(sentence)) if sentence[i : i + len(phrase)] == phrase)


def weights(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How rare each of ``words`` is: the binary digits of (files + 1) div (files with it + 1). A row a word is collected."""
    own = docs.select(F.array_distinct(F.filter(tokens(F.col("text")), lambda w: w.isin(words))).alias("own"))
    counts = own.select(F.explode(F.array_append("own", F.lit(""))).alias("word")).groupBy("word").count()  # "" counts the files
    found = {r["word"]: r["count"] for r in counts.collect()}
    return {w: ((found.get("", 0) + 1) // (found.get(w, 0) + 1)).bit_length() for w in words}


def _text(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _postings(found: list[tuple[str, int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(w).alias("word"), F.lit(p).alias("at"), F.lit(n).alias("weight")) for w, p, n in found])


def _index(rarity: dict[str, int], templates: tuple, base: dict[str, str]) -> tuple[list, list, list[str]]:
    """(templates, base phrases, the words that look them up); postings come the rarest first."""
    whole, phrases, asked = [], [], set()
    for label, sentence, key in templates:
        words, phrase = sentence.split(), key.split()
        rare = sorted(((w, p, rarity[w]) for p, w in enumerate(words)), key=lambda x: (-x[2], x[1]))[:RARE]
        names = sorted({w for w, _, _ in rare}, key=lambda w: (-rarity[w], w))
        asked.update(names)
        whole.append(F.struct(F.lit(label).alias("label"), _postings(rare).alias("rare"), _text(names).alias("names"), F.lit(sum(n for _, _, n in rare)).alias("total"), F.lit(_start(words, phrase)).alias("key_at"), _text(phrase).alias("key")))
    for phrase, label in base.items():
        words = phrase.split()
        at = min(range(len(words)), key=lambda p: (-rarity[words[p]], p))
        asked.add(words[at])
        phrases.append(F.struct(F.lit(label).alias("label"), F.lit(words[at]).alias("rarest"), F.lit(at).alias("at"), _text(words).alias("key")))
    return whole, phrases, sorted(asked)


def _stands(words: Column, start: Column, phrase: Column) -> Column:
    """Does the phrase stand at ``start``, word by word?"""
    return F.aggregate(F.sequence(F.lit(0), F.size(phrase) - 1), F.lit(True), lambda ok, i: ok & F.coalesce(F.get(words, start + i) == F.get(phrase, i), F.lit(False)))


def _agreed(words: Column, start: Column, rare: Column) -> Column:
    """The weight of the postings that agree with a template that begins at ``start``."""
    return F.aggregate(rare, F.lit(0), lambda n, p: n + F.when(F.get(words, start + p["at"]) == p["word"], p["weight"]).otherwise(0))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, base: dict[str, str] = BASE, agree: int = AGREE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``.

    ``score`` is 1 with a base phrase, else the greatest share of weight of a template that was found, else 0. A null
    text is empty; a text without words has no labels ('') and null places. Ties: templates of one label count once.
    Repeated rows stay rows of their own, an empty table gives no rows. Only doc_id and text are read. ``templates``
    and ``base`` are part of the plan, so they are to be short lists.
    """
    vocabulary = sorted({w for _, s, _ in templates for w in s.split()} | {w for p in base for w in p.split()})
    rarity = weights(docs, vocabulary)
    whole, phrases, asked = _index(rarity, templates, base)
    rows = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    spots = F.filter(F.transform("words", lambda w, i: F.when(w.isin(asked), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("spots", spots)
    words = F.col("words")

    def places(t: Column) -> Column:
        """Every place of a base phrase."""
        looked = F.filter("spots", lambda i: (F.get(words, i) == t["rarest"]) & _stands(words, i - t["at"], t["key"]))
        return F.transform(looked, lambda i: F.struct((i - t["at"]).alias("start"), t["label"].alias("label")))

    def best(t: Column) -> Column:
        """The greatest weight at a place that has the key phrase; null if none agrees enough."""
        own = F.slice(F.filter(t["names"], lambda w: F.exists("spots", lambda i: F.get(words, i) == w)), 1, LOOKUPS)
        looked = F.filter(t["rare"], lambda p: F.array_contains(own, p["word"]))
        starts = F.flatten(F.transform(looked, lambda p: F.transform(F.filter("spots", lambda i: F.get(words, i) == p["word"]), lambda i: i - p["at"])))
        held = F.transform(F.array_distinct(starts), lambda s: F.when(_stands(words, s + t["key_at"], t["key"]), _agreed(words, s, t["rare"])))
        return F.array_max(F.filter(held, lambda n: 100 * n >= agree * t["total"]))

    none = F.array().cast("array<struct<start int, label string>>")
    rows = rows.withColumn("base", F.when(F.size("spots") > 0, F.flatten(F.transform(F.array(*phrases), places))).otherwise(none))
    found = F.transform(F.array(*whole), lambda t: F.struct(t["label"].alias("label"), (best(t) / t["total"]).alias("share")))
    nothing = F.array().cast("array<struct<label string, share double>>")
    rows = rows.withColumn("found", F.when(F.size("spots") > 0, F.filter(found, lambda x: x["share"].isNotNull())).otherwise(nothing))
    base_labels, labels = F.col("base")["label"], F.concat(F.col("base")["label"], F.col("found")["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    score = F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("found")["share"]), F.lit(0.0)))
    starts = F.col("base")["start"].cast("array<bigint>")
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                       joined(base_labels).alias("base_labels"), joined(labels).alias("labels"), score.alias("score"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


OP13_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS words FROM documents),
placed AS (SELECT no, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM docs),
phrases(phrase, label) AS (VALUES {_values(list(BASE.items()))}),
based AS (
  SELECT p.no, p.pos, q.label FROM placed p JOIN phrases q ON p.word = split_part(q.phrase, ' ', 1) JOIN docs d ON d.no = p.no
  WHERE array_to_string(d.words[p.pos + 1 : p.pos + len(string_split(q.phrase, ' '))], ' ') = q.phrase),
base AS (SELECT no, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM based GROUP BY no),
templates(t, label, sentence, phrase, key_pos) AS (VALUES {_values([(i, *x, _start(x[1].split(), x[2].split())) for i, x in enumerate(TEMPLATES)])}),
postings AS (SELECT t, unnest(string_split(sentence, ' ')) AS word, generate_subscripts(string_split(sentence, ' '), 1) - 1 AS pos FROM templates),
rarity AS (
  SELECT v.word, length(bin(((SELECT count(*) FROM docs) + 1) // (count(DISTINCT p.no) + 1))) AS weight
  FROM (SELECT DISTINCT word FROM postings) v LEFT JOIN placed p ON p.word = v.word GROUP BY v.word),
rare AS (
  SELECT t, p.word, p.pos, weight FROM postings p JOIN rarity r ON r.word = p.word
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY weight DESC, p.pos) <= {RARE}),
own AS (
  SELECT no, t, word FROM (SELECT DISTINCT p.no, r.t, r.word, r.weight FROM placed p JOIN rare r ON r.word = p.word)
  QUALIFY row_number() OVER (PARTITION BY no, t ORDER BY weight DESC, word) <= {LOOKUPS}),
starts AS (SELECT DISTINCT o.no, o.t, p.pos - r.pos AS start FROM own o JOIN rare r ON r.t = o.t AND r.word = o.word JOIN placed p ON p.no = o.no AND p.word = o.word),
agreed AS (
  SELECT s.no, s.t, s.start, sum(r.weight) AS weight, (SELECT sum(weight) FROM rare x WHERE x.t = s.t) AS total
  FROM starts s JOIN rare r ON r.t = s.t JOIN placed p ON p.no = s.no AND p.pos = s.start + r.pos AND p.word = r.word GROUP BY ALL),
verified AS (
  SELECT a.no, t.label, CAST(a.weight AS DOUBLE) / CAST(a.total AS DOUBLE) AS share
  FROM agreed a JOIN templates t ON t.t = a.t JOIN docs d ON d.no = a.no
  WHERE 100 * a.weight >= {AGREE} * a.total AND a.start + t.key_pos >= 0
    AND array_to_string(d.words[a.start + t.key_pos + 1 : a.start + t.key_pos + len(string_split(t.phrase, ' '))], ' ') = t.phrase),
found AS (SELECT no, max(share) AS share FROM verified GROUP BY no),
told AS (SELECT no, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT no, label FROM based UNION ALL SELECT no, label FROM verified) GROUP BY no)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(t.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.share, 0.0::DOUBLE) END AS score
FROM docs d LEFT JOIN base b ON b.no = d.no LEFT JOIN found f ON f.no = d.no LEFT JOIN told t ON t.no = d.no
"""
