"""Odd tables through the pipeline's stages, spans cut by decontamination, and whole licence notices."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import decontaminate, licenses

from .test_operators import SCHEMA

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, __c0 string, score double, n_hit string, spans int, `key` long, items string"


def body(r, n):
    return " ".join(r.choice(["river", "stone", "walks", "under", "green"]) + str(r.randint(0, 999)) for _ in range(n))


@pytest.fixture()
def odd(spark, tmp_path):
    r = random.Random(21)
    question = body(r, 20)
    rows = [(i, body(r, 40)) for i in range(30)]
    rows += [(None, rows[0][1] + " x"), (None, "only here " + body(r, 30)), (None, None), (None, None), (40, None), (40, None), (41, ""), (41, ""), (42, " .. "), (5, rows[5][1]), (43, body(r, 60_000)), (44, question + " " + body(r, 5)), (None, question)]
    full = [(i, t, None, None, None if t is None else len(t), "z", 0.9, "h", 1, 7, "i") for i, t in rows]
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(30)] + [(None, 1, 1), (2, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, question), (2, None), (None, "river1"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/empty.parquet")
    return str(tmp_path), spark.createDataFrame(full, COLUMNS), question


def test_stages_on_odd_tables(spark, odd):
    path, docs, question = odd
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, path)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(rows) == len(set(rows)) and {(None, None), (40, None), (41, ""), (42, " .. ")} <= set(rows)
    assert not any(i is None and t and t.endswith(" x") for i, t in rows) and sum(i == 5 for i, _ in rows) == 1
    kept = corpus_pipeline.drop_contaminated(spark, docs, path)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert {r["n_hit"] for r in kept.collect()} == {"h"}
    kept = corpus_pipeline.redact_secrets(spark, docs, path)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    tokens = corpus_pipeline.encode(spark, docs, path)
    assert tokens.count() == docs.count() and tokens.where("n_tokens = 0").count() == 6
    kept = corpus_pipeline.drop_toxic(spark, docs, path)
    assert kept.columns == docs.columns and {(40, None), (41, "")} <= {(r["doc_id"], r["text"]) for r in kept.collect()}


def test_stages_on_empty_tables(spark, odd):
    path, _, _ = odd
    docs = spark.read.parquet(f"{path}/empty.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_spans_are_cut(spark, odd):
    path, docs, question = odd
    bench = spark.read.parquet(f"{path}/benchmark.parquet")
    got = decontaminate.clean(docs, bench, documents=False)
    assert got.columns == docs.columns and got.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in got.where("doc_id IN (40, 41, 44)").collect()}
    whole = docs.where("doc_id = 44").first()["text"]
    assert text == {40: None, 41: "", 44: whole.removeprefix(question)}
    assert decontaminate.clean(docs, bench.where("false"), documents=False).where(F.col("text") == whole).count() == 1
    assert decontaminate.cut("aébc", [{"start": 1, "end": 3}]) == "abc"


#: Whole notices as they stand in source files, fixed values; the model saw none of them whole.
NOTICES = {
    "gpl": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell',
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
}


@pytest.mark.parametrize("family", sorted(NOTICES))
def test_whole_notices(family):
    notice = NOTICES[family]
    one = " ".join(notice.split())
    narrow, line = [], ""
    for word in one.split():
        if len(line) + len(word) > 50:
            narrow.append(line)
            line = ""
        line = f"{line} {word}".strip()
    shapes = [notice, one, "\n".join([*narrow, line]), "/*\n * " + notice.replace("\n", "\n * ") + "\n */", "Some words before.\n\n" + notice + "\n\nand after", one.lower(), one + " Copyright 2020 by the authors."]
    for text in shapes:
        assert licenses.digest(text)[1] == family, text


def test_other_words_name_no_licence():
    for text in ("The library closes at nine; see the license of the driver.", "He made a general public speech under the terms of his contract.", "All seats are reserved."):
        assert licenses.digest(text)[1] == ""


#: Forms that the model is not fitted on, nor its temperature: grants of a family's names, and texts that grant nothing.
HELD_OUT = (
    "You can get it under the terms of the {} license.", "Terms: {} license", "This repository is covered by the {} licence.", "Code and docs are released under {}.", "You may copy this under the terms of the {} license.",
    "It is free software licensed under {}.", "The tool is distributed under the terms of the {}.", "Copyright 2020 the authors, {} license.",
)
HELD_OUT_NONE = ("This module is not licensed under {} terms.", "We did not release it under the {} license.", "The old code was never under the {} license.", "It is no longer distributed under the {}.")


def test_licences_in_held_out_forms():
    assert not {f.lower().strip(".") for f in HELD_OUT + HELD_OUT_NONE} & {f.lower() for f in licenses.GRANTS + licenses.REFUSALS}
    found = missed = wrong = 0
    for family, names in licenses.NAMES.items():
        for name in names:
            for form in HELD_OUT:
                got = set(filter(None, licenses.digest(form.format(name))[1].split(",")))
                found, missed, wrong = found + (family in got), missed + (family not in got), wrong + len(got - {family})
            wrong += sum(licenses.digest(form.format(name))[0] for form in HELD_OUT_NONE)
    assert found / (found + missed) >= 0.97 and found / (found + wrong) >= 0.97, (found, missed, wrong)


LICENCE_CASES = {
    "Released under GPLv3.": "gpl", "MIT licensed": "mit", "License: BSD-2-Clause": "bsd", "Dual licensed under MIT or Apache-2.0.": "apache,mit", "GNU GPL v3 or later": "gpl", "Apache 2.0": "apache",
    "Creative Commons Attribution-NonCommercial licence": "cc-by-nc", "not licensed under the MIT License": "", "Not under MIT but under the BSD license": "bsd", "We moved from Apache 2.0 to another server.": "", "Den mit.\nMit und": "",
    "This library ships with a parser that is released under the MIT License and it also has a part, by another author, which is licensed under the Apache License, Version 2.0, as its own file says.": "apache,mit",
    "Released\nunder GPLv3.": "gpl", "# distributed under the\n# MIT terms.": "mit", "released\nunder the\n\nMIT terms": "", "DISTRIBUTED UNDER THE  MIT TERMS": "mit",
}


def test_licence_cases(spark):
    docs = spark.createDataFrame(list(enumerate(LICENCE_CASES)), "doc_id long, text string").withColumn("n", F.lit("n")).withColumn("s", F.lit(1)).withColumn("rid", F.lit(0))
    got = {r["doc_id"]: (r["n_licenses"], r["families"], r["spans"]) for r in licenses.scan(docs).collect()}
    assert {i: f[1] for i, f in got.items()} == dict(enumerate(LICENCE_CASES.values()))
    assert got == {i: licenses.digest(t) for i, t in enumerate(LICENCE_CASES)}
    assert "Python" not in licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
