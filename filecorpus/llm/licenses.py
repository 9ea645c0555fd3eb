"""License scans: TF-IDF cosine of passages to templates, then inheritance down directories.

Every line of a file is a passage, so is every paragraph (lines up to one without a term, be
it blank or only a comment's mark), and every run of a paragraph's terms as long as a template,
compared with that one: a header that is wrapped over lines, or has more before and after it, is
found as well. In a licence file such runs go over the whole text. A term weighs
``ln((1 + N) / (1 + df)) + 1`` with the number ``df`` of the ``N`` files that have it; terms
that no template has weigh as those of one file. A file's own licence is that of the template
nearest to one of its passages, if the cosine is at least ``MIN_COSINE``. A directory has the
licence of the licence file in it, and a file without one of its own inherits from the
nearest directory at or above its own that has one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.functions.paths import base_name, parent_path
from filecorpus.llm.common import batches_of, query, slices, table
from filecorpus.operators.joins import BROADCAST_BYTES, lookup_join, table_bytes
from filecorpus.staging import stage

MIN_COSINE = 0.7
# Terms of a long text whose runs are looked at together.
WINDOW_TERMS = 20_000

Found = tuple[float, str]

# Usual notices of licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy"
        " of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version",
    ),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation; either"
        " version 2 of the License, or (at your option) any later version",
    ),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted",
    ),
    ("MIT", "Released under the MIT License"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
LICENSE_FILES = r"(?i)^(licen[sc]e|copying|notice)(\.(txt|md))?$"

# ASCII letters in lower case, digits and bytes of other characters; the rest is between terms.
_WRITTEN = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() or b >= 128 else 32 for b in range(128)
) + bytes(range(128, 256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_WRITTEN).split()


@dataclass(frozen=True)
class Templates:
    """Unit vectors of the templates by term, and the weight of each term."""

    names: list[str]
    lengths: list[int]  # terms of each
    idf: dict[bytes, float]
    other: float  # weight of terms that no template has
    vectors: dict[bytes, np.ndarray]  # term to its component in each template

    @staticmethod
    def of(templates: tuple[tuple[str, str], ...], files: int, found: dict[bytes, int]) -> Templates:
        counts = [Counter(terms_of(text)) for _, text in templates]
        every = sorted(set().union(*counts))
        idf = {t: float(np.log((1 + files) / (1 + found.get(t, 0))) + 1) for t in every}
        matrix = np.array([[c[t] * idf[t] for c in counts] for t in every])
        matrix /= np.linalg.norm(matrix, axis=0)
        other = float(np.log((1 + files) / 2) + 1)
        names = [name for name, _ in templates]
        lengths = [c.total() for c in counts]
        return Templates(names, lengths, idf, other, dict(zip(every, matrix, strict=True)))

    def possible(self, terms: Iterable[bytes], least: float) -> bool:
        """Whether a passage of some of the terms can come as near as ``least``.

        The part of a template that a passage has bounds the cosine.
        """
        known = self.vectors.keys() & terms
        return bool(known) and (sum(self.vectors[t] ** 2 for t in known) >= least**2 - 1e-12).any()

    def cosine(self, terms: list[bytes]) -> np.ndarray:
        """The cosine of a passage to each template."""
        counts = Counter(terms)
        weights = {t: n * self.idf.get(t, self.other) for t, n in counts.items()}
        length = float(np.sqrt(sum(w * w for w in weights.values())))
        known = sorted(self.vectors.keys() & counts.keys())
        return sum((weights[t] * self.vectors[t] for t in known), np.zeros(len(self.names))) / length

    def nearest(self, terms: list[bytes], least: float) -> Found | None:
        """The best cosine of a passage and its template, if at least ``least``.

        Of equal cosines the first template counts.
        """
        if not self.possible(terms, least):
            return None
        cosines = self.cosine(terms)
        best = int(cosines.argmax())
        return (float(cosines[best]), self.names[best]) if cosines[best] >= least - 1e-12 else None

    def nearest_window(self, terms: list[bytes], least: float) -> Found | None:
        """The same of every run of as many terms as a template has, with that template.

        A run's length is at least that of its terms taken as if none came twice, so running
        sums bound all cosines, and only runs that may be the best are looked at one by one.
        """
        best: Found | None = None
        overlap = max(self.lengths) - 1
        for start in range(0, len(terms), WINDOW_TERMS):
            part = terms[start : start + WINDOW_TERMS + overlap]
            if not self.possible(part, least):
                continue
            none = np.zeros(len(self.names))
            weights = np.array([self.idf.get(t, self.other) for t in part])
            products = np.array([self.vectors.get(t, none) for t in part]) * weights[:, None]
            dots = np.vstack([none, products.cumsum(axis=0)])
            squares = np.concatenate([[0.0], (weights * weights).cumsum()])
            for j, n in enumerate(self.lengths):
                if n > len(part):
                    continue
                bounds = (dots[n:, j] - dots[:-n, j]) / np.sqrt(squares[n:] - squares[:-n])
                for at in np.flatnonzero(bounds >= least - 1e-9):
                    if best is not None and bounds[at] <= best[0]:
                        continue
                    found = float(self.cosine(part[at : at + n])[j])
                    if found >= least - 1e-12 and (best is None or found > best[0]):
                        best = found, self.names[j]
        return best

    def of_text(self, text: str, whole: bool, least: float) -> Found | None:
        """The best of all passages of a text."""
        if not self.possible(set(terms_of(text)), least):
            return None
        lines = [terms_of(line) for line in text.split("\n")]
        blocks = [[t for line in lines for t in line]] if whole else list(paragraphs(lines))
        passages = [line for line in lines if line] + blocks
        if whole:
            passages += paragraphs(lines)
        found = [self.nearest(p, least) for p in passages if p]
        found += [self.nearest_window(b, least) for b in blocks if b]
        return max((f for f in found if f), key=lambda f: f[0], default=None)


def paragraphs(lines: Iterable[list[bytes]]) -> Iterator[list[bytes]]:
    """Terms of neighbouring lines; a line without terms ends a paragraph."""
    held: list[bytes] = []
    for line in lines:
        if line:
            held.extend(line)
        elif held:
            yield held
            held = []
    if held:
        yield held


def term_counts(
    files: DataFrame, templates: tuple[tuple[str, str], ...]
) -> tuple[int, dict[bytes, int]]:
    """Files in all, and files with each term of a template (only those leave the tasks)."""
    wanted = set().union(*(terms_of(text) for _, text in templates))
    schema = pa.schema([("term", pa.binary()), ("n", pa.int64())])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(wanted.intersection(terms_of(text or "")))
                counts[b""] += 1
        yield from batches_of(schema, counts.items(), 1000)

    rows = files.select("text").mapInArrow(counted, "term binary, n long")
    found = {bytes(r["term"]): r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


def own_licenses(files: DataFrame, templates: Templates, *, least: float = MIN_COSINE) -> DataFrame:
    """``file_id, path, own_license, similarity`` for ``file_id, path, text``; nulls if there is none."""
    schema = pa.schema(
        [
            ("file_id", pa.int64()),
            ("path", pa.string()),
            ("own_license", pa.string()),
            ("similarity", pa.float64()),
        ]
    )

    def matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in slices(batches):
                for file_id, path, whole, text in zip(
                    *(batch.column(c).to_pylist() for c in schema.names[:2]),
                    batch.column("whole").to_pylist(),
                    batch.column("text").to_pylist(),
                    strict=True,
                ):
                    similarity, name = templates.of_text(text or "", whole, least) or (None, None)
                    yield file_id, path, name, similarity

        yield from batches_of(schema, rows(), 2000)

    chosen = files.select(
        F.col("file_id").cast("long"),
        "path",
        F.coalesce(base_name("path").rlike(LICENSE_FILES), F.lit(False)).alias("whole"),
        F.col("text").cast("string"),
    )
    return chosen.mapInArrow(matched, "file_id long, path string, own_license string, similarity double")


def inherit(files: DataFrame) -> DataFrame:
    """Add ``license`` and ``licensed_by`` to ``path, own_license, similarity``.

    ``licensed_by`` is the file's own path, or the directory it inherits from. Of several
    licence files in a directory the one with the greatest similarity counts, then the
    smallest path. A file with a null path inherits nothing.
    """
    placed = files.withColumn("__dir", parent_path("path"))
    of_dir = (
        placed.filter(F.col("own_license").isNotNull() & base_name("path").rlike(LICENSE_FILES))
        .groupBy(F.col("__dir").alias("__above"))
        .agg(F.min_by("own_license", F.struct(-F.col("similarity"), "path")).alias("__license"))
    )
    # Each directory once, however many files it has, at every directory above it.
    steps = F.split("__dir", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")
    )
    inherited = (
        placed.filter(F.col("own_license").isNull() & F.col("__dir").isNotNull())
        .select("__dir")
        .distinct()
        .select("__dir", F.explode(above).alias("__above"))
        .join(of_dir, "__above")
        .groupBy("__dir")
        .agg(F.max_by(F.struct("__license", "__above"), F.length("__above")).alias("__from"))
    )
    own = F.col("own_license").isNotNull()
    every = placed.select("__dir").distinct().join(inherited, "__dir", "left")
    known = lookup_join(
        placed.filter("__dir is not null"),
        every,
        "__dir",
        ["path"],
        small=table_bytes(every.select("__dir", "__from.*")) <= BROADCAST_BYTES,
    )
    nowhere = placed.filter("__dir is null").withColumn(
        "__from", F.lit(None).cast("struct<__license:string,__above:string>")
    )
    return known.select(*nowhere.columns).unionByName(nowhere).select(
        *files.columns,
        F.when(own, F.col("own_license")).otherwise(F.col("__from.__license")).alias("license"),
        F.when(own, F.col("path")).otherwise(F.col("__from.__above")).alias("licensed_by"),
    )


def scan_licenses(
    files: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    *,
    least: float = MIN_COSINE,
) -> DataFrame:
    """``file_id, path, own_license, similarity, license, licensed_by`` for ``file_id, path, text``.

    Null and empty texts have no licence of their own. Rows that repeat an id or a path are
    separate files. An empty table gives no row. Other columns are ignored.
    """
    total, found = term_counts(files, templates)
    own = own_licenses(files, Templates.of(templates, total, found), least=least)
    # Inheritance looks at the thin rows several times, at the texts only once.
    return inherit(stage(own, "licenses"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: ``/<source>/<thousand>/<twentieth of it>/<id>.txt``.

    The first document of a thousand, and of a twentieth, stands for the licence file of its
    directory.
    """
    number = F.col("doc_id")
    upper = F.concat(
        F.lit("/"),
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")),
        F.lit("/"),
        F.floor(number / 1000).cast("string"),
    )
    lower = F.concat(upper, F.lit("/"), F.floor(F.pmod(number, F.lit(1000)) / 50).cast("string"))
    path = (
        F.when(number % 1000 == 0, F.concat(upper, F.lit("/LICENSE")))
        .when(number % 50 == 0, F.concat(lower, F.lit("/LICENSE")))
        .otherwise(F.concat(lower, F.lit("/"), number.cast("string"), F.lit(".txt")))
    )
    return docs.select(number.alias("file_id"), path.alias("path"), "text")


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or inherited."""
    found = scan_licenses(document_paths(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("file_id", "doc_id")
