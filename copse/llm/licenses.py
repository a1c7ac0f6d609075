"""License scans: TF-IDF cosine to templates, and inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, fresh, pinned, put, quoted, salt, salt_bit, salts_in, stored

#: Statements, notices of headers, and passages of full texts of public licences (fixed values).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: File names that speak for their directory.
LICENSE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)([.\-_].*)?$"

#: What tells files apart; key is a hash of the text.
KEY = ["id", "path", "key"]
#: Starts of runs in a part of a text; parts overlap by the longest template.
STARTS = 64


def _terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def _split(text) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _share(of: Column, own: dict[str, float]) -> Column:
    """The squared weights of a template's terms among some."""
    squares = F.create_map(*[F.lit(x) for t, v in own.items() for x in (t, v * v)])
    return F.aggregate(of, F.lit(0.0), lambda s, t: s + F.coalesce(F.element_at(squares, t), F.lit(0.0)))


def _runs(base: DataFrame, weights: list[dict[str, float]], lengths: list[int], threshold: float) -> DataFrame:
    """KEY, unit (below 0), terms and template: distinct runs of a text's terms, as long as a template, that may reach the threshold.

    A unit vector's cosine to a template is at most the root of the squared weights of the terms that both have.
    Parts of a text whose terms have too little of a template's weight are left first, then runs.
    """
    least, held = (threshold - 1e-6) ** 2, F.array(*map(F.lit, sorted({t for w in weights for t in w})))
    terms = pinned(base.select(*KEY, "text"), "terms", _split("text"))
    part = lambda j: F.struct(j.alias("j"), F.slice("terms", j * STARTS + 1, STARTS + max(lengths) - 1).alias("terms"))
    parts = terms.select(*KEY, F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("terms") / STARTS).cast("int")), part)).alias("part"))
    parts = pinned(parts, "held", F.array_intersect("part.terms", held))  # distinct
    # The greatest cosine that any template can have: most parts end here.
    enough = [F.when(_share(F.col("held"), own) >= least, F.struct(F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (own, n) in enumerate(zip(weights, lengths, strict=True))]
    some = F.when(F.size("held") > 1, F.filter(F.array(*enough), lambda c: c.isNotNull())).otherwise(F.array().cast("array<struct<i: int, n: int>>"))
    parts = pinned(parts, "chosen", some).select(*KEY, "part", F.explode("chosen").alias("c"))
    starts = parts.select(*KEY, "part", "c", F.explode(F.sequence(F.lit(1), F.lit(STARTS))).alias("start"))
    whole = F.col("start") + F.col("c.n") - 1 <= F.size("part.terms")
    starts = starts.filter(whole | ((F.col("part.j") == 0) & (F.col("start") == 1)))  # a shorter text is a run as it is
    runs = starts.select(*KEY, F.col("c.i").alias("i"), F.slice("part.terms", F.col("start"), F.col("c.n")).alias("terms"))
    alike = F.lit(False)
    for i, own in enumerate(weights):
        alike = F.when(F.col("i") == i, _share(F.array_distinct("terms"), own) >= least).otherwise(alike)
    runs = stored(pinned(runs, "alike", alike).filter("alike").select(*KEY, "terms", F.col("i").alias("template")).distinct(), "runs")
    order = Window.partitionBy(*KEY).orderBy(F.array_join("terms", " "), "template")
    return runs.select(*KEY, (-1 - F.row_number().over(order)).cast("int").alias("unit"), "terms", "template")


def document_frequencies(texts: DataFrame) -> DataFrame:
    """term and df, in how many texts it is, of all terms."""
    return texts.select(F.explode(F.array_distinct(_split("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))


def template_weights(templates, n_files: int, seen: dict[str, int]) -> list[dict[str, float]]:
    """The unit vector of each template."""
    out = []
    for _, text in templates:
        terms = _terms(text)
        w = {t: terms.count(t) * (math.log((1 + n_files) / (1 + seen.get(t, 0))) + 1) for t in terms}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


def anchors_of(weights: list[dict[str, float]], threshold: float) -> set[str]:
    """Terms without any of which a unit can't reach the threshold: the heaviest of each template."""
    out = set()
    for w in weights:
        rest = 1.0
        for t, x in sorted(w.items(), key=lambda e: (-e[1], e[0])):
            if rest < (threshold - 1e-6) ** 2:
                break
            out.add(t)
            rest -= x * x
    return out


def scored_units(units: DataFrame, frequencies: DataFrame, n_files: int, templates, weights: list[dict[str, float]]) -> DataFrame:
    """KEY, unit and best (similarity, license) of the units (KEY, unit, terms, template: the only one asked, or null).

    The frequencies of the terms that units have are joined by term and salt.
    """
    tf = units.select(*KEY, "unit", "template", F.explode("terms").alias("t")).groupBy(*KEY, "unit", "template", "t").agg(F.count(F.lit(1)).alias("n"))
    tf = stored(tf.withColumn("salt", salt(*[F.col(k) for k in KEY], F.col("unit"))), "terms")
    asked = tf.groupBy("t", "salt").agg(F.count(F.lit(1)).alias("times")).groupBy("t").agg(F.bit_or(salt_bit("salt")).alias("salts"))
    idf = F.log((F.lit(1.0) + n_files) / (F.lit(1.0) + F.col("df"))) + 1
    known = stored(asked.join(frequencies, "t").select("t", "salts", idf.alias("idf")), "idf").select("t", "idf", salts_in("salts").alias("salt"))
    vocabulary = sorted({t for w in weights for t in w})
    rows = [(t, [w.get(t, 0.0) for w in weights]) for t in vocabulary]
    table = F.broadcast(units.sparkSession.createDataFrame(rows, "t string, ws array<double>"))  # the terms of the templates
    value = F.col("n") * F.col("idf")
    joined = tf.join(known, ["t", "salt"]).join(table, "t", "left").withColumn("value", value)
    sums = joined.groupBy(*KEY, "unit", "template").agg(F.sum(F.col("value") * F.col("value")).alias("norm"), *[F.coalesce(F.sum(F.col("value") * F.col("ws")[i]), F.lit(0.0)).alias(f"dot{i}") for i in range(len(weights))])
    asked_of = lambda i: F.coalesce(F.col("template") == i, F.lit(True))
    cosines = F.array(*[F.struct(F.when(asked_of(i), -F.round(F.col(f"dot{i}") / F.sqrt("norm"), 6)).otherwise(1.0).alias("s"), F.lit(name).alias("license")) for i, (name, _) in enumerate(templates)])
    best = F.array_min(cosines)  # the greatest cosine, then the least name
    return sums.select(*KEY, "unit", F.struct((-best["s"]).alias("similarity"), best["license"].alias("license")).alias("b"))


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """files with license, how (own, inherited or none), similarity and license_dir.

    Each line of each file, each licence file as a whole, and, for each template, each run of as many terms as
    it has, across lines and comment signs, is a vector of term frequency times inverse document frequency,
    log((1 + files) / (1 + files with the term)) + 1, of all its terms over all files.  So a wrapped header
    is found, and a template that is a passage of a longer text.  The template with the greatest cosine, at
    or above threshold, is the file's own licence (ties: the least name).  Lines that share none of a
    template's heaviest terms can't reach the threshold and aren't scored; nor are runs whose terms have too
    little of the template's squared weight.  Files without their own inherit from the licence files of the
    nearest directory at or above them (of several, the most similar, then the least name).  Directories are
    joined once each, spread by salts, then files by directory and salt; so neither a large directory nor a
    common ancestor meets in one task.

    Nulls: a null text has no terms; a file with a null path is in the root and no licence file.  Rows are
    told apart by id, path and text (nulls are values like others); rows that repeat all three share one
    result.  Without files the result is empty.  Columns of files named like the results are replaced.
    """
    text, path = F.coalesce(F.col(quoted(text_col)), F.lit("")), F.coalesce(F.col(quoted(path_col)), F.lit(""))
    own_id, key = F.col(quoted(id_col)), F.xxhash64(text)
    base = files.select(own_id.alias("id"), path.alias("path"), key.alias("key"), text.alias("text"))
    n_files = files.count()
    frequencies = stored(document_frequencies(base), "frequencies")
    vocabulary = sorted({t for _, x in templates for t in _terms(x)})
    seen = dict(map(tuple, frequencies.filter(F.col("t").isin(vocabulary)).collect()))  # the terms of the templates
    weights = template_weights(templates, n_files, seen)
    pattern = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(anchors_of(weights, threshold))) + r")(?![a-z0-9])"

    is_license, directory = F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.regexp_replace("path", r"/?[^/]*$", "")
    some = stored(base.filter(F.col("text").rlike(pattern)).dropDuplicates(KEY), "some")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(pattern))
    units = some.select(*KEY, F.posexplode(F.concat(lines, F.when(is_license, F.array("text")).otherwise(F.array().cast("array<string>")))).alias("unit", "line"))
    units = units.select(*KEY, "unit", _split("line").alias("terms"), F.lit(None).cast("int").alias("template")).unionByName(_runs(some, weights, [len(_terms(x)) for _, x in templates], threshold))
    scored = scored_units(units, frequencies, n_files, templates, weights).filter(F.col("b.similarity") >= threshold)
    scored = stored(scored.groupBy(*KEY).agg(F.min_by("b", F.struct(-F.col("b.similarity"), "b.license")).alias("b")), "licensed")

    spoken = scored.filter(is_license).groupBy(directory.alias("dir")).agg(F.min_by("b", F.struct(-F.col("b.similarity"), "b.license")).alias("b"))
    dirs = base.select(directory.alias("dir"), salt(F.col("id"), F.col("path")).alias("salt")).groupBy("dir").agg(F.bit_or(salt_bit("salt")).alias("salts"))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    above = dirs.select("dir", "salts", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("up")))).alias("a"))
    above = above.select("dir", "salts", "a.depth", "a.up", salt(F.col("dir")).alias("deal"))
    spread = spoken.select(F.col("dir").alias("up"), "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("deal"))
    nearest = above.join(spread, ["up", "deal"]).groupBy("dir", "salts").agg(F.max_by(F.struct("up", "b"), "depth").alias("near"))
    nearest = nearest.select(F.col("dir").alias("x_dir"), "near", salts_in("salts").alias("x_salt"))

    mine = scored.select(F.col("id").alias("x_id"), F.col("path").alias("x_path"), F.col("key").alias("x_key"), F.col("b").alias("x_own"))
    had, d, s = fresh(files, "x_had", "x_d", "x_s")
    rows = files.withColumns({had: key, d: F.regexp_replace(path, r"/?[^/]*$", ""), s: salt(own_id, path)})
    rows = rows.join(mine, own_id.eqNullSafe(mine["x_id"]) & (path == mine["x_path"]) & (rows[had] == mine["x_key"]), "left").drop(mine["x_id"], mine["x_path"], mine["x_key"])
    rows = rows.join(nearest, (rows[d] == nearest["x_dir"]) & (rows[s] == nearest["x_salt"]), "left").drop(nearest["x_dir"], nearest["x_salt"])
    own, near = mine["x_own"], nearest["near"]
    found = F.coalesce(own, near["b"])
    return put(
        rows, license=found["license"], how=F.when(own.isNotNull(), "own").when(near.isNotNull(), "inherited").otherwise("none"),
        similarity=found["similarity"], license_dir=F.when(own.isNull(), near["up"]),
    ).drop(had, d, s, own, near)
