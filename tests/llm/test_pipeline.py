"""The pipeline against a brute-force version of its stages."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lexloom.llm import packing, quality, simhash
from lexloom.llm.common import BATCH_BYTES
from lexloom.llm.queries import PACK_TOKENIZER, tokenizer_path
from tests.llm.conftest import prose
from tests.llm.test_operators import brute_words, closure


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    item = prose(rng, 30)
    rows = []
    for k in range(160):
        text = prose(rng, rng.randrange(60, 120))
        if k % 8 == 0:
            text = " ".join(w + "###" for w in text.split())
        rows.append((k, text, "en", "a", len(text)))
    rows += [(200, rows[1][1].upper(), "en", "a", 1), (201, rows[1][1], "en", "b", 1), (201, rows[1][1], "en", "b", 1)]
    words = rows[2][1].split()
    rows += [(210 + k, " ".join([*words[:-1], prose(rng, 1)]), "en", "a", 1) for k in range(4)]
    rows += [(220, f"{prose(rng, 40)}. {item}. {prose(rng, 40)}", "en", "a", 1), (221, None, None, None, None), (None, rows[3][1], "en", "a", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS fp", "1 AS kept").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 8 != 0), 0) for k in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, item


def test_stages(spark, folder):
    path, rows, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    scored = quality.score_documents(spark, docs, spark.read.parquet(f"{path}/labels.parquet"))
    accepted = {(r["doc_id"]) for r in scored.collect() if r["accepted"]}
    texts = {}
    for k, t, *_ in rows:
        if k in accepted:
            texts.setdefault(k, t or "")
    named = {k: t for k, t in texts.items() if k is not None}
    kept = {k: t for k, t in named.items() if k == max(j for j, u in named.items() if u.lower() == t.lower())}
    prints = {k: simhash.fingerprint(t) for k, t in kept.items()}
    root = closure(kept, [(a, b) for a, b in itertools.combinations(kept, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    kept = {k: t for k, t in kept.items() if root[k] == k}
    w = brute_words(item)
    shingles = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    has = lambda t: len(shingles & {tuple(v[j : j + 5]) for v in [brute_words(t)] for j in range(len(v) - 4)}) >= 0.8 * len(shingles)
    kept = {k: t for k, t in kept.items() if not has(t)}

    got = corpus_pipeline.run(spark, path).toPandas()
    want = dict(kept) | ({None: texts[None]} if None in texts else {})
    assert {None if k != k else int(k) for k in got.doc_id} == set(want) and 220 not in want and 200 not in want
    assert not any(k % 8 == 0 for k in kept if k < 160)
    for k, pieces in got.groupby("doc_id"):
        ids = b"".join(pieces.sort_values("start").ids)
        assert ids == packing.encode(want[int(k)], tokenizer_path(PACK_TOKENIZER))
    assert np.isin(got.groupby("sequence_id").length.sum(), [1 << b for b in range(12)]).all()


def test_an_id_with_different_texts_loses_only_what_is_repeated(spark):
    rng = random.Random(5)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(5, a, "en"), (5, b, "en"), (5, b, "en"), (9, a.upper(), "en"), (7, c, "en")], schema)
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.exact(spark, docs, "").collect())
    assert got == sorted([(5, b), (7, c), (9, a.upper())])
    almost = next(x for x in (" ".join([*c.split()[:-1], prose(rng, 1)]) for _ in range(500)) if (simhash.fingerprint(x) ^ simhash.fingerprint(c)).bit_count() <= 4)
    docs = spark.createDataFrame([(5, almost, "en"), (5, d, "en"), (3, c, "en"), (8, c, "en")], schema)
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, "").collect())
    assert got == sorted([(3, c), (5, d)])


def test_decontamination_tells_rows_of_one_id_apart(spark, folder):
    path, _, item = folder
    rng = random.Random(6)
    a, b = prose(rng, 40), f"{prose(rng, 40)}. {item}."
    rows = [(5, a, "en"), (5, b, "en"), (7, b, "de"), (None, b, "en"), (None, a, "en"), (8, None, "en"), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS item_id", "1 AS h")
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in corpus_pipeline.decontaminated(spark, docs, path).collect())
    assert got == sorted([(5, a), (-1, a), (8, ""), (9, "")])


def test_each_stage_keeps_the_columns_and_takes_an_empty_table(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name


def test_texts_go_to_python_in_small_batches(spark, folder):
    path, rows, _ = folder
    conf, key = spark.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(k, "ale bar " * 2500, "en", "a", 20_000) for k in range(600)] + [(600, "cot " * (1 << 20), "en", "a", 1 << 22)], "doc_id long, text string, lang string, source string, n_chars long")
    sizes = lambda batches: (pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches)
    before = conf.get(key)
    try:
        for stage in (corpus_pipeline.classify, corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.packed):
            conf.set(key, before)
            stage(spark, docs.limit(0), path)
            sent = docs.coalesce(1).mapInArrow(sizes, "n long, size long").collect()
            assert sum(r["n"] for r in sent) == 601 and len(sent) >= 6
            # At most twice the bound, unless a row is longer by itself.
            assert all(r["size"] <= 2 * BATCH_BYTES for r in sent if r["size"] < 1 << 22), stage
        conf.set(key, "64k")
        corpus_pipeline.packed(spark, docs.limit(0), path)
        assert conf.get(key) == "64k"
    finally:
        conf.set(key, before)


def test_a_worker_forgets_words_once_pieces_are_laid():
    path = tokenizer_path(PACK_TOKENIZER)
    ids = packing.encode("ale bar", path)
    assert packing._words.cache_info().currsize == 1
    rows = pa.record_batch([pa.array([7]), pa.array([0], pa.int32()), pa.array([ids])], names=["doc_id", "bucket", "ids"])
    out = [r for b in packing._pieces(pa.int64(), "<u4", 2048, True)(iter([rows])) for r in b.to_pylist()]
    assert packing._words.cache_info().currsize == 0
    assert b"".join(r["ids"] for r in out) == ids


def test_every_operator_is_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
