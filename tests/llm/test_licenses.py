from __future__ import annotations

import contextlib
import io
import random
import time

from pyspark.sql import functions as F

from strataframe.llm import licenses as op


def found(spark, texts, **more):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, license string, at string")
    return {(r["doc_id"], r["license"]): r for r in op.scan_licenses(docs, **more).collect()}


def test_every_template_is_found_anywhere(spark):
    r = random.Random(3)
    filler = lambda n: " ".join(f"w{r.randrange(10_000)}" for _ in range(n))
    want, texts = set(), []
    for name, parts in op.TEMPLATES.items():
        for t in parts:
            for n in (0, 1, 17, 400):
                want.add((len(texts), name))
                texts.append(f"{filler(n)}\n{t.upper() if n == 1 else t}\n{filler(n // 2)}")
    got = found(spark, texts)
    assert want <= set(got)
    assert all(got[k]["containment"] == 1.0 for k in want)


def test_changed_templates_by_share(spark):
    words = op.TEMPLATES["GPL-3.0"][1].split()
    few, many = list(words), list(words)
    few[3] = "changed"
    for k in range(0, len(many), 4):
        many[k] = "changed"
    got = found(spark, [" ".join(few), " ".join(many), "this is clean text under the terms of nobody"])
    assert 0.8 <= got[0, "GPL-3.0"]["containment"] < 1 and set(got) == {(0, "GPL-3.0")}


def test_own_templates_and_place(spark):
    got = found(spark, ["x " * 40 + "you may do as you like with it " + "y " * 40], templates={"own": ("You may do as you like, with it!",)})
    (key, row), = got.items()
    assert key == (0, "own") and 40 - 4 <= row["first_word"] <= 40


def test_odd_rows(spark, odd_documents, no_documents):
    got = {(r["doc_id"], r["license"]) for r in op.scan_licenses(odd_documents).collect()}
    assert got == {(9, "CC-BY-NC-4.0"), (9, "all-rights-reserved")}
    assert op.scan_licenses(no_documents).count() == 0


def test_documents_are_read_once(spark, sf_dir):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        op.op4_license_scan(spark, sf_dir).explain("simple")
    assert out.getvalue().count("documents.parquet") == 1


def test_many_templates(spark):
    r = random.Random(5)
    own = {f"l{k}": (" ".join(f"t{r.randrange(10**6)}" for _ in range(r.randrange(3, 90))),) for k in range(400)}
    texts = [f"{own[f'l{k}'][0]} and more" if k % 2 else f"more {own[f'l{k}'][0]}" for k in range(0, 400, 7)]
    assert {(k, f"l{7 * k}") for k in range(len(texts))} == set(found(spark, texts, templates=own))


def test_a_very_long_text(spark):
    filler = " ".join(f"w{k}" for k in range(150_000))
    got = found(spark, [f"{filler} {op.TEXTS['Zlib'][0]} {filler}"])
    assert (0, "Zlib") in got and 150_000 - 200 < got[0, "Zlib"]["first_word"] <= 150_000


def test_a_notice_that_a_text_repeats_costs_its_length(spark):
    took, found = [], []
    for n in (16_000, 32_000):
        df = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("All rights reserved. "), n).alias("text"))
        began = time.perf_counter()
        found.append(sorted(map(tuple, op.scan_licenses(df).collect())))
        took.append(time.perf_counter() - began)
    assert found[0] == found[1] and len(found[0]) == 1 and found[0][0][2:] == (1.0, 0)
    assert took[1] < 10
