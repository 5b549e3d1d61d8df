"""License scans by diagonal voting, in DataFrame functions only.

All runs of two words of the documents are joined, by hash and then by the words
themselves, to the positions of the templates' runs.  A run at document word
``i`` that stands at template word ``j`` votes for the diagonal ``i - j``.  Votes
are gathered by diagonal; for long templates neighbouring diagonals are merged,
since a word put in or left out moves the rest by one; the span is verified run by
run: each run of the template counts once, and in the template's order.  Short
phrases must be whole: every run of theirs on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tareline.session import materialise

#: Phrases that count wherever their words stand one after the other.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Well-known sentences of common licenses, matched with room for changes.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with"
    " the license": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to"
    " this software to the public domain": "cc0",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
    " granted": "isc",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed"
    " on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation": "gpl",
}
#: Diagonals this near are one occurrence; a template counts from this share of its runs.
MERGE, COVER = 3, 0.6
#: Runs of a template that one number holds as bits.
PART = 60
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_rows(phrases: dict[str, str], templates: dict[str, str]) -> list[tuple]:
    """``template, label, exact, runs, j, part, bit, w1, w2`` of every run of two words.

    Runs of a template are the bits of whole numbers, ``PART`` to a number.
    """
    rows = []
    for k, (text, label, exact) in enumerate(
        [(t, x, True) for t, x in phrases.items()] + [(t, x, False) for t, x in templates.items()]
    ):
        words = text.split()
        if len(words) < 2:
            raise ValueError(f"a phrase or template needs two words: {text!r}")
        rows += [(k, label, exact, len(words) - 1, j, j // PART, 1 << j % PART, a, b) for j, (a, b) in enumerate(zip(words, words[1:]))]
    return rows


def votes(docs: DataFrame, spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """One row per document, diagonal and part of a template with the runs met there, and one row of no template per document.

    Documents are ``doc_id`` with a key of the text; ``copies`` of the row
    without a template counts the rows that repeat both.
    """
    names = ("template", "label", "exact", "runs", "j", "part", "bit", "w1", "w2")
    fixed = {"j": "long", "part": "long", "bit": "long", "runs": "long"}
    rows = [F.struct(*[F.lit(v).cast(fixed[n]).alias(n) if n in fixed else F.lit(v).alias(n) for n, v in zip(names, r)])
            for r in template_rows(phrases, templates)]
    known = spark.range(1).select(F.inline(F.array(*rows))).withColumn("h", F.xxhash64("w1", "w2"))
    body = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    split = docs.select("doc_id", F.xxhash64("text").alias("key"), F.regexp_extract_all(body, F.lit(f"({WORD})")).alias("words"))
    # A first element without words stands for the document itself.
    runs = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("w1"), F.lit(None).cast("string").alias("w2"))),
        F.arrays_zip(F.col("words").alias("w1"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("w2"))
        .cast("array<struct<w1:string,w2:string>>"),
    )
    flat = split.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.posexplode(runs).alias("at", "run"))
    flat = flat.select("doc_id", "key", "n_words", (F.col("at") - 1).cast("long").alias("i"), "run.w1", "run.w2")
    flat = flat.where("i = -1 OR w2 IS NOT NULL").withColumn("h", F.xxhash64("w1", "w2"))
    # The templates are a fixed list of a few hundred runs.
    met = flat.join(F.broadcast(known), ["h", "w1", "w2"], "left").where("i = -1 OR template IS NOT NULL")
    return (
        met.withColumn("diagonal", F.col("i") - F.col("j"))
        .groupBy("doc_id", "key", "n_words", "template", "label", "exact", "runs", "diagonal", "part")
        .agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("copies"))
    )


def occurrences(voted: DataFrame, merge: int = MERGE, cover: float = COVER) -> DataFrame:
    """Verified places: whole phrases, and templates by merged diagonals, with start, end (last word) and score.

    A place of a template is a diagonal with those at most ``merge`` beside it,
    so it is no longer than the template and what was put in.  Each run of the
    template counts once, where it stands nearest to the diagonal, and only if it
    follows the runs before it; the score is the share that counts.  Of places
    that overlap in diagonals the best one is returned.
    """
    met = F.bit_count("bits")
    whole = (
        voted.where("exact").where(met == F.least(F.lit(PART), F.col("runs") - F.col("part") * PART))
        .groupBy("doc_id", "key", "template", "label", "runs", "diagonal").agg(F.count(F.lit(1)).alias("parts"))
        .where(F.col("parts") == F.ceil(F.col("runs") / PART))
        .select("doc_id", "key", "label", F.lit(True).alias("exact"), F.col("diagonal").alias("start"),
                (F.col("diagonal") + F.col("runs")).alias("end"), F.lit(1.0).alias("score"))
    )
    own = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    beside = own.rangeBetween(-merge, merge)
    grouped = (
        voted.where("NOT exact")
        .withColumn("around", F.collect_list(F.struct("diagonal", "part", "bits")).over(beside))
        .withColumn("votes", F.sum(met).over(beside))
        .where(F.col("votes") >= cover * F.col("runs"))
        .where("part = array_min(transform(filter(around, e -> e.diagonal = diagonal), e -> e.part))")
    )
    at = F.expr(f"""transform(sequence(0L, runs - 1), j -> j + array_min(transform(
        filter(around, e -> e.part = j div {PART} AND getbit(e.bits, cast(j % {PART} AS int)) = 1),
        e -> struct(abs(e.diagonal - diagonal), e.diagonal AS place))).place)""")
    verified = F.expr("""aggregate(at, named_struct('start', cast(null AS bigint), 'last', cast(null AS bigint), 'n', 0L),
        (s, i) -> if(i IS NOT NULL AND (s.last IS NULL OR i > s.last),
                     named_struct('start', coalesce(s.start, i), 'last', i, 'n', s.n + 1), s))""")
    scored = (
        grouped.withColumn("at", at).withColumn("span", verified)
        .withColumn("score", F.col("span.n") / F.col("runs")).where(F.col("score") >= cover)
    )
    best = F.max(F.struct("score", -F.col("diagonal"))).over(beside)
    long = scored.withColumn("best", best).where(F.col("best") == F.struct("score", -F.col("diagonal"))).select(
        "doc_id", "key", "label", F.lit(False).alias("exact"), F.col("span.start").alias("start"),
        (F.col("span.last") + 1).alias("end"), "score")
    return whole.unionByName(long)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: words, places of base phrases, their first and last word, labels and the best score.

    Null and empty texts have no words, places or labels; rows that repeat an id or a
    text each have their row; an empty table gives an empty result.  Extra columns are
    passed over.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    # Three parts of the result start from the votes; the texts are read for them once.
    voted = materialise(votes(docs.select("doc_id", "text"), docs.sparkSession, phrases, templates), "votes")
    found = occurrences(voted.where("template IS NOT NULL"))
    every = voted.where("template IS NULL").select("doc_id", "key", "n_words", "copies")
    places = found.select("doc_id", "key", "label", "exact", "start", "score")
    rows = every.unionByName(places, allowMissingColumns=True)
    base = F.when(F.col("exact"), F.col("start"))
    return rows.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), F.max("copies").alias("copies"),
    ).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("key", "copies", "copy")


#: The same in DuckDB: every template run is joined to the words, each diagonal to the runs met near it.
def scan_sql(phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> str:
    rows = template_rows(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)
    values = ", ".join(f"({k}, '{x}', {str(e).lower()}, {n}, {j}, '{a}', '{b}')" for k, x, e, n, j, _, _, a, b in rows)
    return rf"""
WITH known(template, label, exact, runs, j, w1, w2) AS (VALUES {values}),
split AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
flat AS (SELECT r, words, unnest(generate_series(1, len(words) - 1)) AS pos FROM split),
met AS (SELECT f.r, template, label, exact, runs, pos - 1 AS i, j, pos - 1 - j AS diagonal
    FROM flat f JOIN known k ON f.words[f.pos] = k.w1 AND f.words[f.pos + 1] = k.w2),
diagonals AS (SELECT DISTINCT r, template, label, runs, diagonal FROM met WHERE NOT exact),
nearest AS (SELECT d.r, d.template, d.label, d.runs, d.diagonal, m.j,
    arg_min(m.i, 2 * abs(m.diagonal - d.diagonal) + (m.diagonal > d.diagonal)::INT) AS i
    FROM diagonals d JOIN met m ON d.r = m.r AND d.template = m.template
        AND m.diagonal BETWEEN d.diagonal - {MERGE} AND d.diagonal + {MERGE}
    GROUP BY d.r, d.template, d.label, d.runs, d.diagonal, m.j),
ordered AS (SELECT *, coalesce(i > max(i) OVER (PARTITION BY r, template, diagonal ORDER BY j
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS follows FROM nearest),
found AS (SELECT r, label, true AS exact, diagonal AS start, 1.0::DOUBLE AS score FROM met WHERE exact
        GROUP BY r, template, label, runs, diagonal HAVING count(*) = runs
    UNION ALL SELECT r, label, false, min(i), (count(*) FILTER (follows))::DOUBLE / runs FROM ordered
        GROUP BY r, template, label, runs, diagonal HAVING (count(*) FILTER (follows))::DOUBLE / runs >= {COVER})
SELECT s.doc_id, any_value(len(s.words))::BIGINT AS n_words,
    count(f.start) FILTER (f.exact) AS n_base, min(f.start) FILTER (f.exact) AS first_word, max(f.start) FILTER (f.exact) AS last_word,
    coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.exact), '') AS base_labels,
    coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label), '') AS labels,
    coalesce(max(f.score), 0)::DOUBLE AS score
FROM split s LEFT JOIN found f ON s.r = f.r
GROUP BY s.r, s.doc_id"""
