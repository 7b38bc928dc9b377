"""Each operator over the messy table and over an empty one; the results that the docstrings state."""

import zlib

import pytest
from pyspark.sql import functions as F

from lexloom.llm import chat, decontaminate, exact_dedup, licenses, line_dedup, packing, quality, sharding, simhash, substring_dedup
from lexloom.llm.queries import PACK_TOKENIZER, tokenizer_path

N = 13


def items(spark):
    return spark.createDataFrame([(1, "one"), (2, None), (3, ""), (1, "one"), (None, "one")], "item_id long, text string")


OPERATORS = {
    "exact": lambda spark, docs, labels: exact_dedup.exact_groups(spark, docs),
    "decontaminate": lambda spark, docs, labels: decontaminate.contaminated(spark, docs, items(spark)),
    "lines": lambda spark, docs, labels: line_dedup.repeated_runs(spark, docs),
    "simhash": lambda spark, docs, labels: simhash.simhash_groups(spark, docs),
    "shards": lambda spark, docs, labels: sharding.shard_rows(spark, docs, 4),
    "quality": lambda spark, docs, labels: quality.score_documents(spark, docs, labels),
    "pack": lambda spark, docs, labels: packing.pack(spark, docs, tokenizer_path(PACK_TOKENIZER)),
    "passages": lambda spark, docs, labels: substring_dedup.repeated_passages(spark, docs),
    "licenses": lambda spark, docs, labels: licenses.scan(spark, docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_no_rows(spark, messy, labels, name):
    assert OPERATORS[name](spark, messy.limit(0), labels).collect() == []


def run(spark, messy, labels, name):
    return OPERATORS[name](spark, messy, labels).toPandas()


def test_exact(spark, messy, labels):
    got = run(spark, messy, labels, "exact")
    assert len(got) == N
    copies = got[got.group_size == 5]  # 1, 2 twice, 3 and a null id
    assert set(copies.keep_id) == {3} and copies.kept.sum() == 1
    blank = got[got.doc_id.isin([4, 5])]
    assert set(blank.keep_id) == {5} and set(blank.group_size) == {3}  # with the null id


def test_decontaminate(spark, messy, labels):
    got = run(spark, messy, labels, "decontaminate")
    assert {(r.doc_id, r.item_id) for r in got.itertuples()} == {(9, 1), (10, 1)}


def test_lines(spark, messy, labels):
    got = run(spark, messy, labels, "lines")
    assert sorted(tuple(r) for r in got.itertuples(index=False)) == [(2, 0, 0, 1, 1, 0), (10, 4, 7, 3, 10, 0)]


def test_simhash(spark, messy, labels):
    got = run(spark, messy, labels, "simhash")
    assert len(got) == N
    by = got.dropna().groupby("doc_id").component_id.first().to_dict()
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[6] == 4 and by[9] == 9


def test_shards(spark, messy, labels):
    got = run(spark, messy, labels, "shards")
    assert sorted(got.groupby("shard").size()) == [3, 3, 3, 4]
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    null = got[got.doc_id == 4].iloc[0]
    assert null["size"] == 1 and null.text_crc32 == zlib.crc32(b"")


def test_quality(spark, messy, labels):
    got = run(spark, messy, labels, "quality")
    assert len(got) == N and got.p_quality.between(0, 1).all() and got.p_toxic.between(0, 1).all()


def test_pack(spark, messy, labels):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path(PACK_TOKENIZER))
    texts = {r["doc_id"]: r["text"] or "" for r in messy.where("doc_id is not null").select("doc_id", "text").collect()}
    got = run(spark, messy, labels, "pack")
    copies = {1: 1, 2: 2}
    for doc, rows in got.dropna(subset="doc_id").groupby("doc_id"):
        want = encoder.encode(texts[doc], add_special_tokens=False).ids + [1]
        assert rows.length.sum() == len(want) * copies.get(doc, 1)
        if doc != 2:
            found = [int.from_bytes(x[k : k + 4], "little") for x in rows.sort_values("start").ids for k in range(0, len(x), 4)]
            assert found == want
    assert got.doc_id.isna().any()


def test_passages(spark, messy, labels):
    got = run(spark, messy, labels, "passages")
    assert set(got.doc_id) == {1, 2, 3} and set(got[~got.removed].doc_id) == {1}


def test_licenses(spark, messy, labels):
    assert run(spark, messy, labels, "licenses").empty


def test_chat(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, None, None, None), (1, 2, "assistant", "b"), (None, 1, "assistant", "x" * 300_000), (2, 1, "assistant", "")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x")).withColumn("loss", F.lit(1))
    got = chat.digests(chat.format_chats(chats, tokenizer_path(chat.TOKENIZER))).toPandas()
    by = {None if r.conv_id != r.conv_id else int(r.conv_id): r for r in got.itertuples()}
    assert by[1].n_turns == 4 and by[1].loss_chars == 2 and by[2].loss_chars == 0 and by[None].loss_chars == 300_000
    assert chat.digests(chat.format_chats(chats.limit(0), tokenizer_path(chat.TOKENIZER))).collect() == []
