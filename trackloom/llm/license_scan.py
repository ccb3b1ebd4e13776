"""License scans with a positional rare-token index, with DataFrame functions only.

Method: the index holds for each word of the licence templates its templates and
positions there. Of a template's words that a file has, those with the highest
inverse document frequency (counted over all documents) are looked up:
``rare_words`` of them, or so many more that a notice can't do without them all.
Hits are intersected by relative position (place in the file less place in the
template) with the places of the template's mandatory key phrase; where one
fits, all words of the template are verified: a word is in place within
``DRIFT`` words of where the key phrase has it, and a word more for each
``STEPS`` words between them, so words may be inserted or left out.
``least_share`` of a template's words must be in place. Each template is judged
by itself, so a file gets the labels of all its notices. They join those of the
base phrases, which are found wherever their words stand consecutively.

The score is 1 with a base phrase, else the largest share of a template's words
in place, 0 without a notice.

The texts are read once; the rest works on the few with a licence word, from a
table in the shared folder.

Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Nulls and edge cases: a
null text is empty: no words, no labels, score 0; a null id is kept, and ids keep
their type; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.url_filter import LOWER, UPPER
from trackloom.plans.lineage import stored

DRIFT, STEPS = 2, 4
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Base phrases with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licence notices as (label, mandatory key phrase, words). Every key
# phrase has one of the words of ANCHORS, so a text with none of these has no licence.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]
ANCHORS = "license|licensed|permission|redistribution|rights|creative"



def key_place(phrase: str, line: str) -> int:
    """The word of a template where its key phrase starts."""
    parts, words = phrase.split(), line.split()
    return next(i for i in range(len(words)) if words[i : i + len(parts)] == parts)


def slack(place: int, phrase: str, line: str) -> int:
    """How far from its place a template's word may stand."""
    return DRIFT + abs(place - key_place(phrase, line)) // STEPS


def _lowered(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row_id, doc_id, n_words, seen (template words), and the words of texts with a licence word as one line; stored."""
    vocabulary = sorted({w for _, _, line in TEMPLATES for w in line.split()})
    line = F.trim(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), SEPARATORS, " "))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _lowered(line).alias("line"))
    n_words = F.when(F.col("line") == "", 0).otherwise(F.char_length("line") - F.char_length(F.replace("line", F.lit(" "))) + 1)
    seen = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split("line", " "))
    flagged = F.when(F.col("line").rlike(ANCHORS), F.col("line"))
    return stored(rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", n_words.cast("long").alias("n_words"), seen.alias("seen"), flagged.alias("line")), "licenses")


def _index(scanned: DataFrame) -> DataFrame:
    """word, template, place, idf of the template words; idf over all rows."""
    n = scanned.count()
    rows = [(w, k, i) for k, (_, _, line) in enumerate(TEMPLATES) for i, w in enumerate(line.split())]
    postings = scanned.sparkSession.createDataFrame(rows, "word string, template int, place int")
    found = scanned.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return postings.join(found, "word", "left").withColumn("idf", F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1))).drop("df")


def _templates(spark) -> DataFrame:
    """template, label, phrase, size, key_place, lookups, places (word, delta from the key phrase, slack)."""
    rows = []
    for k, (label, phrase, line) in enumerate(TEMPLATES):
        at, words = key_place(phrase, line), line.split()
        rows.append((k, label, phrase.split(), len(words), at, max(slack(i, phrase, line) for i in range(len(words))), [(w, i - at, slack(i, phrase, line)) for i, w in enumerate(words)]))
    return spark.createDataFrame(rows, "template int, label string, parts array<string>, size int, key_place int, widest int, places array<struct<word:string,delta:int,slack:int>>")


def _starts(words: Column, parts: Column) -> Column:
    """Word numbers where the parts stand consecutively."""
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (F.get(words, i) == F.get(parts, F.lit(0))) & (F.slice(words, i + 1, F.size(parts)) == parts))


def notices(scanned: DataFrame, rare_words: int, least_share: float) -> DataFrame:
    """row_id, labels, score of the rows with a licence notice."""
    spark = scanned.sparkSession
    lined = scanned.where("line is not null").select("row_id", F.split("line", " ").alias("words"))
    index, templates = _index(scanned), _templates(spark)  # fixed numbers of rows
    hits = lined.select("row_id", F.posexplode("words").alias("at", "word")).join(F.broadcast(index), "word")
    lookups = F.greatest(F.lit(rare_words), F.floor((1 - least_share) * F.col("size")).cast("int") + 1)
    rare = hits.select("row_id", "template", "word", "idf").distinct().groupBy("row_id", "template").agg(F.sort_array(F.collect_set(F.struct("idf", "word")), False).alias("rare"))
    rare = rare.join(F.broadcast(templates.select("template", lookups.alias("lookups"))), "template").select("row_id", "template", F.explode(F.slice("rare.word", F.lit(1), F.col("lookups"))).alias("word"))
    votes = hits.join(rare, ["row_id", "template", "word"]).groupBy("row_id", "template").agg(F.collect_set(F.col("at") - F.col("place")).alias("offsets"))
    near = votes.join(F.broadcast(templates), "template").join(lined, "row_id")
    fits = lambda p: F.exists("offsets", lambda o: F.abs(o - p + F.col("key_place")) <= F.col("widest"))
    near = near.select("row_id", "label", "size", "places", "words", F.explode(F.filter(_starts(F.col("words"), F.col("parts")), fits)).alias("p"))
    low = lambda x: F.greatest(F.col("p") + x.delta - x.slack, F.lit(0))
    span = lambda x: F.greatest(F.col("p") + x.delta + x.slack + 1 - low(x), F.lit(0))
    met = F.size(F.filter("places", lambda x: F.array_contains(F.slice("words", low(x) + 1, span(x)), x.word)))
    found = near.select("row_id", "label", (met / F.col("size")).alias("share")).where(F.col("share") >= least_share)
    return found.groupBy("row_id").agg(F.collect_set("label").alias("labels"), F.max("share").alias("score"))


def _base_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    fits = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: fits(i))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare_words: int = 8, least_share: float = 0.7) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    scanned = _scanned(docs, id_col, text_col)
    flagged = scanned.where("line is not null").select("row_id", "doc_id", "n_words", F.split("line", " ").alias("words"))
    flagged = flagged.select("row_id", "doc_id", "n_words", F.array(*[_base_places(F.col("words"), p) for p in BASE]).alias("places"))
    every, none = F.flatten("places"), F.array().cast("array<string>")
    base = F.filter(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(BASE.values())]), lambda x: x.isNotNull())
    flagged = flagged.select("row_id", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base.alias("base"))
    flagged = flagged.join(notices(scanned, rare_words, least_share), "row_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("labels", none)))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )
    nothing = F.lit(None).cast("long")
    rest = scanned.where("line is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), nothing.alias("first_word"), nothing.alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"))
    return flagged.unionByName(rest)
