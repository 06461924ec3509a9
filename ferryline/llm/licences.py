"""Licence texts found by a positional index of rare words, built-in functions only.

A template is the wording of a licence with phrases that must be there.  Of its
words the rarest over all documents are indexed with their positions.  A place of
such a word in a document points to where the template would begin; where enough
rare words of a template point to one beginning, its phrases are verified there,
each at its own position.  A plain phrase is a template of one phrase, looked up
by its rarest word, so that no place of it is missed.

One row's words never leave the row: what points to one beginning is a number of
the template and the position, and agreeing numbers stand together once sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryline.session import materialize

RARE = 4  # words of a template that are indexed
NEED = 3  # of them that must agree on a beginning
# Words before lower-casing: ASCII letters and digits and anything beyond ASCII.  Named by what is in it, it matches faster.
ANY_CASE_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    phrases: tuple[str, ...] = ()  # must be in `words`; if none is given, all of it must be there

    @property
    def exact(self) -> bool:
        return not self.phrases

    def split(self) -> list[str]:
        return self.words.split()

    def keys(self) -> list[tuple[str, int]]:
        """The phrases and where each stands in the template, first place each."""
        own, found = self.split(), []
        for phrase in self.phrases or (self.words,):
            cut = phrase.split()
            places = [i for i in range(len(own)) if own[i : i + len(cut)] == cut]
            if not places:
                raise ValueError(f"{phrase!r} is not in the template of {self.label}")
            found.append((phrase, places[0]))
        return found


# The phrases of the contract.
PHRASES = [Template("cc-by", "cc by"), Template("gpl", "general public license"), Template("reserved", "all rights reserved")]

# How well-known licences are granted.
TEMPLATES = [
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
             ("except in compliance with the license", "obtain a copy of the license")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that",
             ("redistribution and use", "with or without modification")),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             ("permission is hereby granted", "copy of this software")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
]

_SHIFT = 40  # positions stay below 2^40


def _lookup(entries: dict[str, list[int]], word: Column) -> Column:
    """The numbers of a word (it must have some)."""
    pairs = [x for w, numbers in sorted(entries.items()) for x in (F.lit(w), F.array(*[F.lit(n).cast("long") for n in numbers]))]
    return F.element_at(F.create_map(*pairs), word)


def _pointed(hits: str, entries: dict[str, list[int]]) -> Column:
    """Sorted numbers that the hits point to: a number of the word, plus the hit's position."""
    if not entries:
        return F.array().cast("array<bigint>")
    known = F.filter(hits, lambda h: h["word"].isin(*sorted(entries)))
    return F.sort_array(F.flatten(F.transform(known, lambda h: F.transform(_lookup(entries, h["word"]), lambda n: n + h["at"]))))


def _agreed(numbers: str, need: list[int]) -> Column:
    """Numbers that stand as often in a sorted array as the template or phrase they belong to needs."""
    needs = F.array(*[F.lit(n) for n in need])
    often = F.filter(numbers, lambda x, i: F.get(F.col(numbers), i + F.get(needs, F.shiftright(x, _SHIFT).cast("int")) - 1) == x)
    return F.array_distinct(often)


def rare_index(templates: list[Template], counts: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """Word to (template number, position): of each template the `RARE` places of its rarest words, of an exact one a single place.

    Ties go by the word, then the position.  Words that no document has can't be looked up.
    """
    index: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        places = sorted((counts[w], w, i) for i, w in enumerate(template.split()) if counts.get(w))
        for _, word, i in places[: 1 if template.exact else RARE]:
            index.setdefault(word, []).append((t, i))
    return index


def licence_words(docs: DataFrame, words: set[str]) -> DataFrame:
    """(doc_id, n_words, hits) of each row: hits are the places (at, word) of the given words, rising; written once."""
    vocabulary = sorted(words)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(ANY_CASE_WORD), F.lit(0)).alias("words"))
    # lower() also maps a few other letters to a-z: it only preselects
    found = F.transform("words", lambda w, i: F.when(
        F.lower(w).isin(*vocabulary), F.struct(i.alias("at"), F.translate(w, UPPER, LOWER).alias("word"))))
    hits = F.filter(found, lambda h: h.isNotNull() & h["word"].isin(*vocabulary))
    return materialize(cut.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")), "licence-words")


def find_licences(docs: DataFrame, phrases: list[Template] | None = None, templates: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, places, matches, score) of each row of `docs` (doc_id, text).

    `places` are the places of the plain `phrases`, `matches` those of the
    `templates`: arrays of (label, start, length), by label, start and length; start
    counts words from 0 and may be below 0 where a template's beginning is cut off.
    score is the share of the words that lie inside places or matches.  A null,
    empty or blank text has no words, no places and score 0.  Rows are judged one by one, so
    null, repeated or tied ids don't matter; an empty table gives none.  Extra columns are ignored.

    How many documents have each word of the templates is counted over all rows; one
    number a word reaches the driver, and the templates, a few hundred words, go into the plan.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    every = [*phrases, *templates]
    texts = licence_words(docs, {w for t in every for w in t.split()})
    each = texts.select(F.explode(F.array_distinct("hits.word")).alias("word"))
    counts = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}

    keys = sorted({phrase for t in every for phrase, _ in t.keys()})
    bias = max((len(t.split()) for t in every), default=0)  # a template may begin before the text

    def number(t: int, position: int) -> int:
        return (t << _SHIFT) + bias + position

    rare = {w: [number(t, -i) for t, i in at] for w, at in rare_index(every, counts).items()}
    in_keys: dict[str, list[int]] = {}
    for k, phrase in enumerate(keys):
        for i, word in enumerate(phrase.split()):
            in_keys.setdefault(word, []).append(number(k, -i))
    begins: list[list[int]] = [[] for _ in keys]  # of a phrase: what to add to its place for the beginning of each template
    for t, template in enumerate(every):
        for phrase, at in template.keys():
            begins[keys.index(phrase)].append((t << _SHIFT) - at)

    within = F.lit((1 << _SHIFT) - 1)
    beginnings = F.array(*[F.array(*[F.lit(b).cast("long") for b in of]) for of in begins])
    none = F.array().cast("array<bigint>")
    seen = texts.withColumn("_rare", _pointed("hits", rare))
    seen = seen.withColumn("_begun", _agreed("_rare", [1 if t.exact else NEED for t in every]))
    seen = seen.withColumn("_key_words", F.when(F.size("_begun") > 0, _pointed("hits", in_keys)).otherwise(none))
    seen = seen.withColumn("_keys", _agreed("_key_words", [len(k.split()) for k in keys]))
    seen = seen.withColumn("_held", F.sort_array(F.flatten(F.transform("_keys", lambda x: F.transform(
        F.get(beginnings, F.shiftright(x, _SHIFT).cast("int")), lambda b: b + x.bitwiseAND(within))))))
    seen = seen.withColumn("_found", F.array_intersect("_begun", _agreed("_held", [len(t.keys()) for t in every])))

    labels = F.array(*[F.lit(t.label) for t in every])
    lengths = F.array(*[F.lit(len(t.split())) for t in every])

    def place(x: Column) -> Column:
        t = F.shiftright(x, _SHIFT).cast("int")
        return F.struct(F.get(labels, t).alias("label"), (x.bitwiseAND(within) - bias).alias("start"), F.get(lengths, t).alias("length"))

    plain = F.lit(len(phrases) << _SHIFT)
    seen = seen.select("doc_id", "n_words", F.array_sort(F.transform(F.filter("_found", lambda x: x < plain), place)).alias("places"),
                       F.array_sort(F.transform(F.filter("_found", lambda x: x >= plain), place)).alias("matches"))
    inside = F.array_distinct(F.flatten(F.transform(F.concat("places", "matches"), lambda p: F.sequence(
        F.greatest(p["start"], F.lit(0)), F.least(p["start"] + p["length"], F.col("n_words")) - 1))))
    return seen.withColumn("score", F.when(F.col("n_words") > 0, F.size(inside) / F.col("n_words")).otherwise(0.0))


def label_list(*places: str) -> Column:
    """The distinct labels of some arrays of places, sorted, with commas between."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(f"{p}.label") for p in places]))), ",")
