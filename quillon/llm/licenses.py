"""License scans by diagonal voting, with DataFrame functions only.

All rolling word k-grams of a text are hashed (pairs from hashes of words, runs of four from hashes of pairs) and
joined with the hashed k-grams of all templates. A match whose words agree votes for a diagonal: its place in
the text less its place in the template. Votes are added up by diagonal, neighbouring diagonals (words put in or
left out) are merged to spans, and a span stands if its matched words are enough of the template. Phrases are
templates of their own, whose places must be whole and are not merged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import documents


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Words of a k-gram: 2 or 4.
    k: int = 4
    #: Share of the template's words that a span must match.
    share: float = 0.7
    #: Diagonals at most so far apart are one span.
    gap: int = 6


# Phrases of the base labels.
PHRASES = (
    Template("mit", "mit license", 2, 1.0, 0),
    Template("apache", "apache license", 2, 1.0, 0),
    Template("gpl", "general public license", 2, 1.0, 0),
)

# Notices of common licenses.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)

TEMPLATES = PHRASES + NOTICES

#: The hash of the one row that every document sends, so that documents without a match stay.
_DOCUMENT = 0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text (null: none), with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _joined(hashes: Column, step: int) -> Column:
    """Hashes of runs twice as long: each one with that ``step`` places later."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))


def _grams(df: DataFrame) -> DataFrame:
    """``df`` (with ``words``) with ``pairs`` and ``fours``, the rolling hashes of its words."""
    df = df.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("pairs", _joined(F.col("hashed"), 1)).drop("hashed")
    return df.withColumn("fours", _joined(F.col("pairs"), 2))


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row per k-gram of a template, and one for documents. As long as the templates, whatever the documents."""
    given = F.array(*[F.struct(F.lit(i).alias("tid"), F.lit(t.text).alias("text"), F.lit(t.k).alias("k")) for i, t in enumerate(templates)])
    rows = spark.range(1).select(F.explode(given).alias("t")).select("t.*").withColumn("words", words_of(F.col("text")))
    hashes = F.when(F.col("k") == 2, F.col("pairs")).otherwise(F.col("fours"))
    rows = _grams(rows).select("tid", "k", "words", F.posexplode(hashes).alias("tpos", "h"))
    rows = rows.select("h", "tid", "k", "tpos", F.expr("slice(words, tpos + 1, k)").alias("gram"))
    none = F.lit(None).cast("int")
    return rows.unionByName(spark.range(1).select(F.lit(_DOCUMENT).cast("long").alias("h"), none.alias("tid"), none.alias("k"), none.alias("tpos"), F.lit(None).cast("array<string>").alias("gram")))


def _per_template(templates: tuple[Template, ...], value) -> Column:
    return F.element_at(F.array(*[F.lit(value(t)) for t in templates]), F.col("tid") + 1)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, spans): per row of ``docs`` its spans (template, label, first, last, share, stands), by place.

    ``first`` and ``last`` are word numbers from 0; ``stands`` says whether a span matches enough of its template.
    Null texts have no words and no spans; rows with equal ids are rows of their own; other columns are ignored; a
    table without rows gives none.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("words"))
    rows = _grams(rows).select("rid", "doc_id", "words", F.size("words").alias("n"), F.concat(F.array(F.lit(_DOCUMENT).cast("long")), "pairs", "fours").alias("hashes"))
    sent = rows.select("rid", "doc_id", "words", "n", F.posexplode_outer("hashes").alias("pos", "h"))
    hits = sent.join(F.broadcast(template_grams(docs.sparkSession, templates)), "h")
    start = F.when(F.col("k") == 2, F.col("pos") - 1).otherwise(F.col("pos") - F.col("n"))
    is_document = F.col("tid").isNull() & (F.col("pos") == 0)
    same = F.when(F.col("k") == 2, F.col("pos").between(1, F.col("n") - 1)).otherwise(F.col("pos") >= F.greatest("n", F.lit(1)))
    hits = hits.withColumn("start", start).filter(is_document | (same & (F.expr("slice(words, start + 1, k)") == F.col("gram"))))
    # all that follows goes by document: one shuffle, of a row per document and match
    votes = hits.select("rid", "doc_id", "n", "tid", "k", "tpos", "start", (F.col("start") - F.col("tpos")).alias("diagonal")).repartition("rid")
    lines = votes.groupBy("rid", "doc_id", "n", "tid", "k", "diagonal").agg(F.collect_list("tpos").alias("votes"), F.min("start").alias("first"), F.max("start").alias("last"))
    along = Window.partitionBy("rid", "tid").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > _per_template(templates, lambda t: t.gap), F.lit(True))
    lines = lines.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(along))
    spans = lines.groupBy("rid", "doc_id", "n", "tid", "k", "span").agg(F.flatten(F.collect_list("votes")).alias("votes"), F.min("first").alias("first"), (F.max("last") + F.first("k") - 1).alias("last"))
    matched = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct("votes"), lambda t: F.sequence(t, t + F.col("k") - 1)))))
    spans = spans.withColumn("share", matched / _per_template(templates, lambda t: len(t.text.split())))
    found = F.struct("first", "last", F.col("tid").alias("template"), _per_template(templates, lambda t: t.label).alias("label"), "share", (F.col("share") >= _per_template(templates, lambda t: t.share)).alias("stands"))
    per = spans.groupBy("rid", "doc_id", "n").agg(F.sort_array(F.collect_list(F.when(F.col("tid").isNotNull(), found))).alias("spans"))
    return per.select("doc_id", F.col("n").cast("long").alias("n_words"), "spans")


def op13_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every document, from its spans. Nulls and repeats as in ``scan``; an empty table gives no rows."""
    found = scan(documents(spark, sf_dir)).withColumn("whole", F.filter("spans", lambda s: s["stands"]))
    found = found.withColumn("places", F.filter("whole", lambda s: s["template"] < len(PHRASES)))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    # a phrase found in part says nothing
    scores = F.transform(F.filter("spans", lambda s: s["stands"] | (s["template"] >= len(PHRASES))), lambda s: s["share"])
    starts = F.transform("places", lambda s: s["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels("places").alias("base_labels"),
        labels("whole").alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
    )


_RUNS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ROWS = ", ".join(f"({i}, '{t.label}', '{t.text}', {t.k}, {t.share}, {t.gap})" for i, t in enumerate(TEMPLATES))
OP13_SQL = f"""
WITH t AS (SELECT *, string_split(text, ' ') AS ws FROM (VALUES {_ROWS}) t(tid, label, text, k, least, gap)),
tg AS (SELECT tid, k, i - 1 AS tpos, array_to_string(ws[i : i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_RUNS.format("coalesce(text, '')")} AS ws FROM documents),
dg AS (SELECT rid, k, i - 1 AS start, array_to_string(ws[i : i + k - 1], ' ') AS g FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (VALUES (2), (4)) k(k))),
hits AS (SELECT rid, tid, k, tpos, start, start - tpos AS diagonal FROM dg JOIN tg USING (k, g)),
dia AS (SELECT DISTINCT rid, tid, diagonal FROM hits),
cut AS (SELECT dia.*, coalesce(diagonal - lag(diagonal) OVER w > gap, true)::INT AS fresh FROM dia JOIN t USING (tid) WINDOW w AS (PARTITION BY rid, tid ORDER BY diagonal)),
span AS (SELECT rid, tid, diagonal, sum(fresh) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS span FROM cut),
m AS (SELECT rid, tid, span, min(start) AS first, count(DISTINCT tpos + x) AS n FROM hits JOIN span USING (rid, tid, diagonal), range(4) r(x) WHERE x < k GROUP BY rid, tid, span),
s AS (SELECT rid, tid, first, label, n::DOUBLE / len(ws) AS share, n::DOUBLE / len(ws) >= least AS stands FROM m JOIN t USING (tid)),
p AS (SELECT rid, count(*) FILTER (stands AND tid < {len(PHRASES)}) AS n_base, min(first) FILTER (stands AND tid < {len(PHRASES)}) AS first_word, max(first) FILTER (stands AND tid < {len(PHRASES)}) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands AND tid < {len(PHRASES)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands) AS labels,
  max(share) FILTER (stands OR tid >= {len(PHRASES)}) AS score FROM s GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN p USING (rid)
"""
