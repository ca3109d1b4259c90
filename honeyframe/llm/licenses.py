"""Licences of files: statements by TF-IDF cosine, then inheritance by path.

A statement is a line of a file, or a whole licence file (by its name). Its
sparse TF-IDF vector is compared with the templates' by cosine; the best template
from ``least`` up names the licence. Words that no template has share one more
coordinate each, at the largest weight, so that other text lowers the cosine.
Document frequencies are counted over all files. A file without a statement takes
the licence of the nearest ancestor directory that has a licence file.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from honeyframe.llm.common import Written

#: Short notices of public licences, as commonly written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "BSD-3-Clause": "Redistribution and use is permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def _lines(text: str):
    return (line for line in re.split(r"[\r\n]+", text) if line.strip())


def _presence(vocabulary: frozenset):
    def run(batches):
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                low = (t.as_py() or "").lower()
                total[""] += 1
                total.update(vocabulary.intersection(_WORD.findall(low)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    return run


class Weights:
    """Inverse document frequencies and unit vectors of the templates."""

    def __init__(self, df: dict[str, int], files: int, templates: dict[str, str]):
        self.top = float(np.log((files + 1) / 1) + 1)
        self.idf = {w: float(np.log((files + 1) / (df.get(w, 0) + 1)) + 1) for w in {x for t in templates.values() for x in words(t)}}
        self.names = sorted(templates)
        self.vectors = []
        for n in self.names:
            v = {w: k * self.idf[w] for w, k in words(templates[n]).items()}
            norm = sum(x * x for x in v.values()) ** 0.5
            self.vectors.append({w: x / norm for w, x in v.items()})

    def best(self, text: str, least: float = 0.0) -> tuple[str | None, float]:
        """Template of the largest cosine; the first by name among equals.

        The cosine is at most the share that known words have in the vector's
        length, so most lines end there."""
        tf = words(text)
        known = [(w, k * self.idf[w]) for w, k in tf.items() if w in self.idf]
        inner = sum(x * x for _, x in known)
        whole = inner + sum((k * self.top) ** 2 for w, k in tf.items() if w not in self.idf)
        if not known or inner < least * least * whole:
            return None, 0.0
        scores = [sum(x * v.get(w, 0.0) for w, x in known) / whole**0.5 for v in self.vectors]
        k = int(np.argmax(scores))
        return self.names[k], float(scores[k])


def _scan(weights: Weights, least: float):
    is_license = re.compile(LICENSE_FILE)

    def run(batches):
        for b in batches:
            out = []
            for path, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                name, score, line_no, whole = None, 0.0, None, bool(path and is_license.search(path))
                parts = [(None, text)] if whole else []
                parts += list(enumerate(_lines(text)))
                for k, part in parts:
                    got = weights.best(part, least)
                    if got[1] >= least and got[1] > score:
                        name, score, line_no = got[0], got[1], k
                out.append((name, score, line_no, whole))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([
                *b.columns[:1], *b.columns[2:], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_()),
            ], names=["path", "doc_id", "own", "score", "line", "is_file"])

    return run


def parents(path: str) -> F.Column:
    """All ancestor directories of a path, nearest first."""
    parts = F.split(F.col(path), "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))


def scan_licenses(
    files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", templates: dict[str, str] = TEMPLATES, least: float = 0.8,
) -> DataFrame:
    """``doc_id, path, license, score, line, inherited_from`` for every row.

    ``license`` is the file's own (``inherited_from`` is null), or that of the
    nearest ancestor directory whose licence file has one, or null. ``line`` is
    the line of the statement, null for a whole licence file. Of equal scores the
    first line wins, of several licence files of one directory the best score,
    then the smallest path. A null text is empty; a null path has no ancestors;
    repeated rows give repeated rows; a long text is read line by line, to its end;
    other columns are not read; an empty table gives an empty result.
    """
    spark = files.sparkSession
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    vocabulary = frozenset(w for t in templates.values() for w in words(t))
    # one row for each word of the templates, whatever the number of files
    df = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(_presence(vocabulary), "term string, df long").groupBy("term").agg(F.sum("df").alias("n")).collect()}
    weights = Weights(df, df.get("", 0), templates)
    found = rows.mapInArrow(_scan(weights, least), "path string, doc_id long, own string, score double, line int, is_file boolean")
    found = Written(spark).write(found.withColumn("dir", F.get(parents("path"), F.lit(0))))
    # licences of directories, then of all directories below them: no file takes part
    given = (
        found.where("is_file and own is not null").groupBy("dir")
        .agg(F.min_by("own", F.struct(-F.col("score"), F.col("path"), F.col("own"))).alias("given"))
        .withColumnRenamed("dir", "up")
    )
    dirs = found.where("dir is not null").select("dir").distinct()
    above = dirs.select("dir", F.posexplode(F.concat(F.array("dir"), F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(parents("dir")))).alias("steps", "up"))
    nearest = above.join(given, "up").groupBy("dir").agg(F.min_by(F.struct("given", "up"), "steps").alias("n")).select("dir", "n.given", "n.up")
    return found.join(nearest, "dir", "left").select(
        "doc_id", "path", F.coalesce("own", "given").alias("license"), F.when(F.col("own").isNotNull(), F.col("score")).alias("score"), "line",
        F.when(F.col("own").isNull(), F.col("up")).alias("inherited_from"),
    )
