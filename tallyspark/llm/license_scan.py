"""License scans: TF-IDF cosine of notices and licence files to templates, and inheritance from the nearest ancestor directory.

Candidates are the lines that mention a licence, and whole texts with such a line. Their terms are weighted by tf * idf, idf being taken over all
candidates, and compared with the templates' vectors; only shared terms meet, in a join with the fixed templates. A licence file is a text that as a whole
is close to a template, whatever its length, or one that is named as such. A file without a notice of its own takes the licence of the
nearest directory above it that holds a licence file, found by joining the ancestors of each directory with the directories that have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, table

#: Names of licences and texts by which they are announced.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. BSD License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal licence."),
    ("Proprietary", "Copyright. All rights reserved. No part may be reproduced without permission."),
)
CUE = "(?i)licen[sc]e|copyright|public domain|all rights reserved|redistribution and use|permission is hereby"
TERM = "[a-z]+[0-9]*|[0-9]+(?:[.][0-9]+)?"
LEAST_COSINE = 0.55
FILE_NAME = "(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def directory(path: Column) -> Column:
    """The directory of a path, '' for the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def cosines(noted: DataFrame) -> DataFrame:
    """(path, named, whole, license, cosine) of the pieces of each noted text (path, named, text) and each template that they are close to.

    Pieces are the lines with a notice, and the whole text. idf is taken over all pieces.
    """
    spark = noted.sparkSession
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE)), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("piece")))
    pieces = noted.select("path", "named", F.posexplode(F.concat(lines, F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("piece"))))).alias("nth", "p"))
    tf = keep(pieces.select("path", "named", "p.whole", "nth", F.explode(terms(F.col("p.piece"))).alias("term")).groupBy("path", "named", "whole", "nth", "term").agg(F.count("*").alias("tf")))
    n = tf.groupBy("path", "nth").agg(F.lit(1)).count()
    known = spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, license string, text string")
    known = known.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("t_tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = lambda d: F.log((n + 1.0) / (F.coalesce(d, F.lit(0)) + 1.0)) + 1.0
    weighted = known.join(df, "term", "left").withColumn("w", F.col("t_tf") * idf(F.col("df")))
    # the templates are fixed, so that their vectors may be sent to all executors
    vectors = F.broadcast(keep(weighted.join(weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("t_norm")), "template").select("template", "license", "term", "w", "t_norm")))
    spread = tf.join(df, "term").withColumn("x", F.col("tf") * idf(F.col("df")))
    norms = spread.groupBy("path", "nth").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    dots = spread.join(vectors, "term").groupBy("path", "named", "whole", "nth", "license", "template", "t_norm").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norms, ["path", "nth"]).select("path", "named", "whole", "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("cosine"))
    return scored.where(F.col("cosine") >= LEAST_COSINE)


def scan(files: DataFrame, path: str = "path", text: str = "text", is_license_file: Column | None = None) -> DataFrame:
    """``files`` less ``text``, with license, cosine, license_from and license_source, replacing columns of these names.

    license_source says whether the licence comes from the text itself ('header'), from a licence file in the nearest directory at or above the
    file's own ('directory'; license_from is the directory, '' the root) or is unknown ('none', the rest null). Licence files are texts that as a whole have
    the least cosine to a template, and those that ``is_license_file`` tells (by name, if not given), by their closest notice. Null and empty texts have no notice;
    a null path has no directory and its text isn't read: that is 'none'. Rows that repeat a path are one file with all their notices. Ties go to the higher
    cosine, then the name of the licence. An empty table gives an empty result. Cosines are rounded to 6 places.
    """
    own = is_license_file if is_license_file is not None else F.col(path).rlike(FILE_NAME)
    base = files.drop("license", "cosine", "license_from", "license_source")
    noted = base.where(F.col(path).isNotNull() & F.col(text).rlike(CUE)).select(F.col(path).alias("path"), F.coalesce(own, F.lit(False)).alias("named"), F.col(text).alias("text"))
    scored = keep(cosines(noted))
    best = lambda rows, *by: rows.groupBy(*by).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    header = best(scored, "path").select("path", F.struct(F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine")).alias("header"))
    licensed = best(scored.where("named or whole").withColumn("at", directory(F.col("path"))), "at").select("at", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))
    # further columns travel as one, so that their names can't clash
    placed = base.select(F.col(path).alias("path"), directory(F.col(path)).alias("dir"), F.struct(*(c for c in base.columns if c != text)).alias("row"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    dirs = placed.where("path is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(F.concat(above, F.array("dir")))).alias("at"))
    inherited = dirs.join(licensed, "at").groupBy("dir").agg(F.max_by(F.struct("at", "license", "cosine"), F.length("at")).alias("above"))
    joined = placed.join(header, "path", "left").join(inherited.withColumnRenamed("dir", "of"), (F.col("dir") == F.col("of")) & F.col("path").isNotNull(), "left")
    return joined.select(
        "row.*", F.coalesce("header.license", "above.license").alias("license"), F.coalesce("header.cosine", "above.cosine").alias("cosine"),
        F.when(F.col("header").isNotNull(), F.col("path")).otherwise(F.col("above.at")).alias("license_from"),
        F.when(F.col("header").isNotNull(), "header").when(F.col("above").isNotNull(), "directory").otherwise("none").alias("license_source"),
    )


def op1_license_scan(spark, sf_dir):
    """Documents as files, whose directories are their source and language; a text that as a whole is close to a template is a licence file.

    Documents with null ids share one path in their directory. Null and empty texts have no notice; an empty table gives an empty result.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"))
    return scan(docs, is_license_file=F.lit(False))
