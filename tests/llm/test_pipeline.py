"""The pipeline: columns, effects of each stage, and what is left at its end against plain Python."""

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from codeloom.llm import decontam, packing, quality, secrets, simhash
from codeloom.llm.common import tokenizer


@pytest.fixture(scope="module")
def staged(spark, data, tmp_path_factory):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        folder = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], data).write.parquet(folder)
        out.append(spark.read.parquet(folder))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def smallest_of_groups(docs):
    """Components of all pairs whose five-word shingle sets are alike to 0.8, or whose fingerprints agree to 3 bits."""
    rows = []
    for r in docs.collect():
        w = r["text"].lower().split()
        rows.append((r["doc_id"], {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}, simhash.fingerprint(r["text"].encode())))
    root = {d: d for d, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x, f) in enumerate(rows):
        for b, y, g in rows[:i]:
            if (f ^ g).bit_count() <= 3 or 10 * len(x & y) >= 8 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {find(d) for d, _, _ in rows}


def test_stages(spark, data, staged):
    docs, good, single, clean, redacted, pieces = staged
    assert all(df.columns == docs.columns for df in staged[:-1])
    assert ids(good) == ids(quality.report(docs).where("kept"))
    assert ids(single) == smallest_of_groups(good)
    assert ids(clean) <= ids(single)
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    untouched = {r["doc_id"] for r in decontam.report(single, bench).where("not contaminated").collect()}
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (single, clean))
    assert untouched <= ids(clean) and all(before[d] == after[d] for d in untouched)
    assert decontam.report(clean, bench).where("contaminated").count() == 0
    final = {r["doc_id"]: r for r in redacted.collect()}
    assert ids(redacted) == ids(clean) and all(not secrets.base_spans(r["text"]) for r in final.values())
    assert all(final[d]["text"] == t for d, t in after.items() if not secrets.base_spans(t)) and all(len(r["text"]) == r["n_chars"] for r in final.values())
    model = tokenizer(packing.default_path())
    want = collections.Counter()
    for d, r in final.items():
        x = [*model.encode(r["text"], add_special_tokens=False).ids, 2]
        for a in range(0, len(x), 4096):
            want[d, a, zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in pieces.collect()) == want


def test_run_gives_the_last_stage(spark, data, staged):
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, data).collect()) == sorted(tuple(r)[:5] for r in staged[-1].collect())


def test_empty_and_odd_documents(spark, data):
    docs = spark.createDataFrame([(None, None, "en", "s", None, 3), (1, "", "en", "s", 0, 3)], "doc_id long, text string, lang string, source string, n_chars long, fp int")
    for df in (docs, docs.limit(0)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, data)
            assert i == 4 or out.columns == docs.columns
            out.collect()
