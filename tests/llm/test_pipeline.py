"""Each stage of the pipeline against a brute-force version of it, on what the stage before kept."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loomspan.llm import mixing, quality_gam, simhash, token_store, wu_manber


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["the", "and", "of"] * 20
    bench = [(i, " ".join(f"b{rnd.randint(0, 500)}" for _ in range(20))) for i in range(6)]
    docs = []
    for i in range(160):
        if i % 5 == 0:
            text = " ".join(rnd.choice(["###", "$$$!!", "| q |", "%%%"]) for _ in range(80))
        elif i % 11 == 0:
            text = docs[i - 1][1] if i % 2 else docs[i - 1][1] + " tail"
        else:
            text = " ".join(rnd.choice(words) for _ in range(rnd.randint(30, 200)))
        if i % 13 == 1:
            text += " " + bench[i % 6][1]
        docs.append((i, text, "en", rnd.choice(["s1", "s2", "s3"]), len(text)))
    docs += [(500, None, "en", None, 0), (501, "", "en", "s1", 0), (3, docs[3][1], "en", "s2", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in docs[i][1]), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df):
    return Counter(map(str, df.collect()))


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mix", "tokens"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        got, was = spark.read.parquet(f"{tmp_path}/{k}"), docs.collect()
        if name != "tokens":
            assert got.columns == names
        if name == "quality":
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            gam = quality_gam.train(docs, labels)
            want = [r for r in was if gam.score(quality_gam.matrix([(r["text"] or "").encode()]))[0] >= 0.3]
            assert sum("###" in (r["text"] or "") for r in got.collect()) == 0 and got.count() > 110
        elif name == "near_duplicates":
            groups = simhash.brute_force([(r["doc_id"], r["text"]) for r in was])
            first: dict = {}
            for r, g in sorted(zip(was, groups, strict=True), key=lambda p: p[0]["doc_id"]):
                first.setdefault(g[2], r)
            assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in first.values()) and got.count() < len(was)
            want = None
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            flags = wu_manber.brute_force([(r["doc_id"], r["text"]) for r in was], items)
            want = [r for r, f in zip(was, flags, strict=True) if not f[5]]
            assert 0 < len(want) < len(was)
        elif name == "mix":
            copies = {(r["doc_id"]): r["copies"] for r in mixing.mix(docs).collect()}
            want = [r for r in was for _ in range(copies[r["doc_id"]])]
        else:
            from tokenizers import Tokenizer

            t, at = Tokenizer.from_file(token_store.default_tokenizer()), 0
            for r, g in zip(sorted(was, key=lambda r: r["doc_id"]), sorted(got.collect(), key=lambda g: g["start"]), strict=True):
                ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]
                assert tuple(g)[:4] == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                at += len(ids)
            want = None
        if want is not None:
            assert rows(got) == Counter(map(str, want)), name
        docs = got


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "copy"] and out.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_queries_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
