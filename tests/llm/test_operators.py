"""Operators against brute-force versions, exact round trips and held-out accuracy."""

import itertools
import pkgutil
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.llm import chat, components, decontaminate, exact_dedup, licenses, line_dedup, packing, quality, sharding, simhash, substring_dedup
from lexloom.llm.common import Workspace
from lexloom.llm.queries import PACK_TOKENIZER, tokenizer_path
from tests.llm.conftest import prose


def closure(nodes, pairs):
    """Smallest node that each node reaches."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(30)] + [(100, k) for k in range(29, 60)]])
def test_components(spark, edges):
    got = components.connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["root"] for r in got.collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert got == closure({n for e in edges for n in e}, edges)


@pytest.mark.parametrize("star", ["_large_star", "_small_star"])
def test_a_hub_is_split(spark, star):
    """The join of a round with a hot node has a skew that adaptive execution sees."""
    options = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        hub = F.lit(0) if star == "_large_star" else F.lit(10**7)
        edges = spark.range(1, 120_000).select(F.greatest("id", hub).alias("u"), F.least("id", hub).alias("v"))
        work = Workspace(spark, "t")
        found = getattr(components, star)(work, work.table(edges, "edges"), "least")
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# --------------------------------------------------------------- exact dedup


@given(st.binary(max_size=300), st.integers(0, 300))
def test_hashes_combine(data, cut):
    prime, base = exact_dedup.FIELDS[0]
    a, b = data[:cut], data[cut:]
    value = 0
    for byte in data:
        value = (value * base + byte + 1) % prime
    assert exact_dedup.polynomial(data, prime, base) == value
    assert exact_dedup.combine(exact_dedup.polynomial(a, prime, base), exact_dedup.polynomial(b, prime, base), len(b), prime, base) == value


def test_huge_documents_hash_in_parts(spark, rng):
    texts = [prose(rng, n) for n in (0, 1, 30_000, 60_000)]
    docs = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "doc_id long, bytes binary")
    whole = sorted(map(tuple, exact_dedup.fingerprints(docs).collect()))
    parts = sorted(map(tuple, exact_dedup.fingerprints(docs, huge=0).collect()))
    assert whole == parts and len({x[3:] for x in whole}) == 4


@pytest.mark.parametrize("weaken", [0, 1, 3])
def test_exact_groups_survive_collisions(spark, rng, weaken):
    base = [prose(rng, n) for n in (1, 5, 40, 15_000)]
    texts = [rng.choice(base) for _ in range(60)] + [base[3][:-1] + "!", base[2].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(spark, docs, weaken=weaken).collect()}
    for k, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if u.lower() == t.lower()]
        assert got[k] == (max(same), len(same), k == max(same))


@pytest.mark.parametrize("weaken", [0, 1])
def test_rows_without_an_id_are_compared_too(spark, rng, weaken):
    a, b = prose(rng, 50), prose(rng, 50)
    rows = [(None, a), (None, b), (None, a.upper()), (3, a), (4, b + "."), (None, ""), (None, None)]
    got = exact_dedup.exact_groups(spark, spark.createDataFrame(rows, "doc_id long, text string"), weaken=weaken).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in got) == [(-1, -1, 1), (-1, -1, 2), (-1, -1, 2), (-1, 3, 3), (-1, 3, 3), (3, 3, 3), (4, 4, 1)]


# -------------------------------------------------------------------- simhash


@given(st.lists(st.integers(0, 2**64 - 1), max_size=4), st.lists(st.integers(0, 63), max_size=4), st.integers(0, 4))
def test_chain_finds_all_within_four_bits(_, flips, start):
    one = np.uint64(0x0123456789ABCDEF)
    other = one
    for f in set(flips):
        other = other ^ np.uint64(1 << f)
    ring = [int(np.bitwise_count((one ^ other) & np.uint64(((1 << w) - 1) << s))) for w, s in zip(simhash.WIDTHS, simhash.SHIFTS, strict=True)]
    chains = [all(sum(ring[(k + j) % 5] for j in range(n + 1)) <= (n + 1) * 4 // 5 for n in range(5)) for k in range(5)]
    assert any(chains)


@pytest.mark.parametrize(("chain", "block"), [(1, 4096), (2, 4096), (1, 7), (2, 7)])
def test_links_connect_what_brute_force_connects(spark, rng, monkeypatch, chain, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            v = centre
            for _ in range(rng.randrange(7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), chain).collect()
    mask = (1 << 64) - 1
    brute = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & mask).bit_count() <= 4]
    assert all(((a ^ b) & mask).bit_count() <= 4 for a, b in edges)
    assert closure(signed, [tuple(e) for e in edges]) == closure(signed, brute)


def test_fingerprint():
    text = "One Two\tthree  four\nFIVE Äx"
    words = ["one", "two", "three", "four", "five", "Äx"]
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) > 1.5)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(" \n") == simhash.fingerprint(None) == 0


# ------------------------------------------------------------------- sharding


@given(st.integers(1, 3000), st.integers(0, 2**40))
@settings(max_examples=40, deadline=None)
def test_permutation(n, key):
    there = sharding.permute(np.arange(n), n, key)
    assert sorted(there.tolist()) == list(range(n))
    assert (sharding.permute(there, n, key, inverse=True) == np.arange(n)).all()


def test_shards_do_not_depend_on_partitions(spark, rng):
    docs = spark.createDataFrame([(k, prose(rng, 3)) for k in range(500)], "doc_id long, text string")
    a = sorted(map(tuple, sharding.shard_rows(spark, docs.repartition(7), 16).collect()))
    b = sorted(map(tuple, sharding.shard_rows(spark, docs.coalesce(1), 16).collect()))
    assert a == b and [r[3] for r in a] == list(range(500))


def scalar_place(row, n, key=0):
    """The permutation in plain integers."""
    mask64 = (1 << 64) - 1
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)

    def mixed(half, turn):
        x = (half + key * 0x2545F4914F6CDD1D + turn * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & mask64
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask64
        return (x ^ (x >> 31)) & ((1 << bits) - 1)

    while True:
        left, right = row >> bits, row & ((1 << bits) - 1)
        for turn in range(6):
            left, right = right, left ^ mixed(right, turn)
        row = (left << bits) | right
        if row < n:
            return row


def test_shards_against_brute_force(spark, rng):
    texts = [rng.choice((None, "", "é ü", prose(rng, rng.randrange(1, 40)))) for _ in range(300)]
    rows = [(rng.randrange(10**6) if k % 9 else None, t) for k, t in enumerate(texts)]
    got = sharding.shard_rows(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 16).collect()
    data = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows]
    ordered = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    placed = {(p % 16, p // 16): x for k, x in enumerate(ordered) for p in [scalar_place(k, len(rows))]}
    assert {(r["shard"], r["slot"]): (r["doc_id"], r["size"], r["text_crc32"]) for r in got} == placed and len(placed) == len(got)
    sizes = [sum(s == k for s, _ in placed) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(j for s, j in placed if s == k) == list(range(n)) for k, n in enumerate(sizes))


# -------------------------------------------------------------------- packing


def test_hilbert_visits_neighbours():
    side, dims = 4, 3
    cells = np.array(list(itertools.product(range(side), repeat=dims)))
    order = cells[np.argsort(packing.hilbert(cells, 2))]
    assert sorted(packing.hilbert(cells, 2).tolist()) == list(range(side**dims))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@given(st.text(alphabet=st.sampled_from("aB'sLl éÉßẞŁǅ́.,!?*#$-) \x1c\t\n9²Ⅷ§<|endoftext|>ΣςİΩ"), max_size=60))
@settings(max_examples=1500, deadline=None)
def test_words_give_the_tokenizers_ids(text):
    path = tokenizer_path(PACK_TOKENIZER)
    want = packing._words(path).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encode(text, path), "<u4").tolist() == [*want, 1]


def test_pack_covers_every_id_once(spark, rng, monkeypatch):
    monkeypatch.setattr(packing, "ROWS", 40)
    texts = [prose(rng, rng.choice((0, 3, 50, 900))) for _ in range(200)] + ["same words"] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = tokenizer_path(PACK_TOKENIZER)
    got = packing.pack(spark, docs, path, width=256).toPandas()
    for k, rows in got.groupby("doc_id"):
        want = np.frombuffer(packing.encode(texts[k], path), "<u4")
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(want)) and zlib.crc32(r.ids) == r.ids_crc32
            assert (np.frombuffer(r.ids, "<u4") == want[at : at + r.length]).all()
            at += r.length
        assert at == len(want)
    assert got.doc_id.nunique() == len(texts)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]]
        total = rows.length.sum()
        assert total == rows.sequence_tokens.iloc[0] and (total & (total - 1)) == 0 and total <= 256


# ----------------------------------------------------------------------- chat


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system|>", "a\\"]), st.text(alphabet=st.sampled_from("a \n\\<|im_endstar>é\U0001f600ñ."), max_size=40)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    made = chat.format_turns(turns, tokenizer_path(chat.TOKENIZER))
    assert chat.parse(made["formatted"]) == turns
    assert chat.masked_text(made["formatted"], made["mask"]) == "".join(t for r, t in turns if r == "assistant")
    assert made["formatted"].count(chat.START) == len(turns)
    # The tokens under the mask are the masked bytes, and no other tokens lie there.
    coding, data = chat._encoder(tokenizer_path(chat.TOKENIZER)).coding, made["formatted"].encode()
    assert coding.decode_bytes(made["input_ids"].tolist()) == data and made["ends"].tolist()[-1:] == [len(data)][: len(turns)]
    for first, last, a, b in made["mask"].tolist():
        assert coding.decode_bytes(made["input_ids"][first:last].tolist()) == data[a:b]
    texts = [t for r, t in turns if r == "assistant" and t]
    assert [chat.unescape(data[a:b].decode()) for *_, a, b in made["mask"].tolist()] == texts


# -------------------------------------------------------------- decontaminate


def brute_words(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]


@pytest.mark.parametrize("share", [0.8, 0.5])
def test_containment(spark, rng, share):
    items = [prose(rng, n) for n in (5, 6, 9, 14, 33, 64, 90)] + ["two words", "same item same item same item same item"]
    docs = []
    for k, item in enumerate(items * 6):
        words = item.split()
        for _ in range(k // len(items)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        docs.append(prose(rng, rng.choice((0, 40, 3000))) + ". " + ", ".join(words) + "! " + prose(rng, 20))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contaminated(spark, d, i, share).collect()}
    want = {}
    for a, doc in enumerate(docs):
        for b, item in enumerate(items):
            w, v = brute_words(item), brute_words(doc)
            k = min(5, len(w))
            s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            part = len(s & {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}) / len(s)
            if part >= share:
                want[a, b] = part
    assert got == pytest.approx(want) and want


# ---------------------------------------------------------------------- lines


def test_repeated_runs(spark, rng):
    pool = [prose(rng, 3) for _ in range(12)]
    long = [prose(rng, 8) for _ in range(4)]
    texts = ["\n".join(rng.choice([*pool, *long[: k % 5], ""]) for _ in range(rng.randrange(30))) for k in range(40)] + ["x\n" * 9]
    whole = [prose(rng, 2) for _ in range(9)]
    texts += ["\n".join(whole[a:b]) for a, b in ((0, 4), (3, 9), (0, 9))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    filled = [[(k, x) for k, x in enumerate(text.split("\n")) if x] for text in texts]
    seen, cut = {}, {}
    for d, lines in enumerate(filled):
        for at in range(len(lines)):
            for n in (3, 1):
                gram = tuple(x for _, x in lines[at : at + n])
                if len(gram) < n or n == 1 and len(gram[0].split()) < 8:
                    continue
                if gram in seen:
                    of, first = seen[gram]
                    low = max(at, first + n) if of == d else at
                    cut.setdefault(d, set()).update(k for k, _ in lines[low : at + n])
                else:
                    seen[gram] = (d, at)
    got = line_dedup.repeated_runs(spark, docs)
    found = {}
    for r in got.collect():
        held = [(k, x) for k, x in filled[r["doc_id"]] if r["first_line"] <= k <= r["last_line"]]
        source = [(k, x) for k, x in filled[r["from_doc_id"]] if k >= r["from_line"]][: len(held)]
        assert len(held) == r["n_lines"] and [x for _, x in held] == [x for _, x in source] and source[0][0] == r["from_line"]
        assert (r["from_doc_id"], r["from_line"]) < (r["doc_id"], r["first_line"]) and not found.get(r["doc_id"], set()) & {k for k, _ in held}
        found.setdefault(r["doc_id"], set()).update(k for k, _ in held)
    assert found == {d: x for d, x in cut.items() if x}
    last = len(texts) - 1  # one source, then another; each run as long as it goes
    runs = sorted(tuple(r) for r in got.where(f"doc_id = {last}").collect())
    assert runs == [(last, 0, 3, 4, last - 2, 0), (last, 4, 8, 5, last - 1, 1)] or runs[0][3] == 4 and sum(r[3] for r in runs) == 9
    left = {r["doc_id"]: r["text"] for r in line_dedup.without_runs(docs, got).collect()}
    for d, text in enumerate(texts):
        assert [x for x in left[d].split("\n") if x] == [x for k, x in enumerate(text.split("\n")) if x and k not in cut.get(d, ())]


def test_without_runs(spark):
    rows = [(1, "a\nb\nc", 1), (1, "d\ne", 2), (2, None, 3), (None, "a\nb", 4), (3, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first_line int").selectExpr("*", "'x' AS lines", "0 AS last_line")
    runs = spark.createDataFrame([(1, 1, 1, 1, 0, 0), (1, 1, 2, 2, 0, 0), (2, 0, 0, 1, 0, 0)], "doc_id long, first_line int, last_line int, n_lines long, from_doc_id long, from_line int")
    got = line_dedup.without_runs(docs, runs)
    assert got.columns == docs.columns
    assert sorted((r["first_line"], r["text"]) for r in got.collect()) == [(1, "a"), (2, "d"), (3, None), (4, "a\nb"), (5, "")]
    assert line_dedup.without_runs(docs, runs.limit(0)).count() == 5 and line_dedup.without_runs(docs.limit(0), runs).collect() == []


# ------------------------------------------------------------------- passages


def test_tuned_bands():
    assert substring_dedup.tuned(0.8, 2, 0.99) == 5
    assert 1 - (1 - 0.8**2) ** 5 >= 0.99
    # Small sets: every pair of different similar ones has enough bands on both sides.
    assert substring_dedup.tuned_for(3) == 1 and substring_dedup.tuned_for(30) == 5
    for n, m in itertools.product(range(1, 14), repeat=2):
        for k in range(min(n, m) + 1):
            if 0.8 <= (x := k / (n + m - k)) < 1:
                assert 1 - (1 - x**2) ** min(substring_dedup.tuned_for(n), substring_dedup.tuned_for(m)) >= 0.99


def test_numbers_of_shingles(rng):
    texts = [prose(rng, n) for n in (7, 9, 30)] + ["a b c d " * 3, " ".join(["beat"] * 9)]
    c = substring_dedup.cut(texts, reach=100)
    got = substring_dedup._sizes(c, substring_dedup._shingles(c.hashes, substring_dedup.WIDTH))
    assert c.size.tolist() == [7, 9, 30, 12, 9] and got.tolist() == [3, 5, 9, 9, 9]


def test_words_and_their_places_are_those_of_the_pattern(rng):
    odd = "ǅungla naïve_x ½ ²x ٣ 漢字 a\u0301b İstanbul ΣΑΣ ß—_ 9.9!a?b\n\U0001d400x\x00y \u200dz Ⅷ " + "w" * 5000
    texts = ["", prose(rng, 40), odd, "...", odd[::-1], "\n", prose(rng, 9).upper() + ".", "a"]
    w = substring_dedup.spans_of(texts)
    of, found = {}, [[m.group() for m in re.finditer(r"\w+", t.lower())] for t in texts]
    assert np.diff(w.begins).tolist() == list(map(len, found))
    for word, h in zip(itertools.chain(*found), substring_dedup.cut(texts).hashes.tolist(), strict=True):
        assert of.setdefault(word, h) == h
    assert len(set(of.values())) == len(of) and len({h >> 32 for h in of.values()}) == len(of)
    for k in (1, 3, 5, 6, 7):
        own = slice(w.begins[k], w.begins[k + 1])
        assert list(zip(w.low[own].tolist(), w.high[own].tolist(), strict=True)) == [m.span() for m in re.finditer(r"\w+", texts[k].lower())]
    assert "stanbul" in [texts[2][a:b] for a, b in zip(w.low[w.begins[2] : w.begins[3]], w.high[w.begins[2] : w.begins[3]], strict=True)]


def test_cutting_costs_little_more_than_finding_words(rng):
    words = prose(rng, 20_000).split()
    texts = [" ".join(rng.choice(words) + rng.choice(("", "", "", ".")) + str(rng.randrange(10**4)) for _ in range(400)) for _ in range(500)]

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: substring_dedup.cut(texts)) < 1.5 * least(lambda: [re.findall(r"\w+|[.!?\n]", t.lower()) for t in texts])


def sentences(rng, n, longest=25):
    """So many words of prose in sentences."""
    words, out = prose(rng, n).split(), []
    while words:
        k = rng.randrange(2, longest)
        out.append(" ".join(words[:k]) + rng.choice(".!?"))
        words = words[k:]
    return " ".join(out)


def covered(text, rows):
    """Whether each word of a text lies in a row's span."""
    _, low, high, _ = substring_dedup.spans_of([text])
    found = np.zeros(len(low), bool)
    for r in rows.itertuples():
        found |= (low >= r.start) & (high <= r.start + r.length)
    return found


def repeats(texts, n):
    """Whether each window of so many words of each text stands in another text too."""
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    of = {}
    for k, w in enumerate(words):
        for j in range(len(w) - n + 1):
            of.setdefault(tuple(w[j : j + n]), set()).add(k)
    return [[len(of[tuple(w[j : j + n])]) > 1 for j in range(len(w) - n + 1)] for w in words]


@pytest.mark.parametrize("block", [2048, 2])
def test_every_passage_of_over_50_words_is_found(spark, rng, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    passages = [sentences(rng, rng.randrange(60, 130), rng.choice((6, 25, 200))) for _ in range(40)]
    common = [prose(rng, n) + "." for n in (9, 14, 30, 35)]
    texts = []
    for k in range(240):
        host = [sentences(rng, rng.randrange(3, 90)) for _ in range(4)]
        if k % 3 == 0:  # in mid-line, at a start or an end, and without its last mark
            host.insert(rng.randrange(5), passages[k // 3 % 40][: rng.choice((None, -1))])
        elif k % 3 == 1:
            host.insert(rng.randrange(5), rng.choice(common))
        texts.append(rng.choice((" ", ". ", "\n")).join(host) if k % 2 else " ".join(x[:-1] if rng.random() < 0.3 else x for x in host))
    texts += ["İ ǅ İ " + texts[0], texts[3].upper(), sentences(rng, 400) + " " + prose(rng, 30)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substring_dedup.repeated_passages(spark, table)
    rows = got.toPandas()
    found, runs, missed = set(rows.doc_id), 0, 0
    for k, (long, short) in enumerate(zip(repeats(texts, 51), repeats(texts, 40), strict=True)):
        if any(long):
            runs += 1
            mark = covered(texts[k], rows[rows.doc_id == k])
            places = {j + i for j, x in enumerate(long) if x for i in range(51)}
            missed += np.mean([mark[j] for j in places]) < 0.9
        elif not any(short):
            assert k not in found
    assert runs > 70 and missed <= 0.03 * runs
    assert (rows.words > 0).all() and (rows.groupby(["class_id"]).removed.apply(lambda x: (~x).sum()) <= 1).all()
    # What is removed stands elsewhere.
    left = {r["doc_id"]: r["text"] for r in substring_dedup.without_passages(table, got).collect()}
    whole = " | ".join(" ".join(re.findall(r"\w+", t.lower())) for t in left.values())
    for p in passages:
        middle = re.findall(r"\w+", p.lower())[20:-20]
        assert " ".join(middle) in whole
    assert sum(map(len, left.values())) < sum(map(len, texts)) - 40 * 200
    assert all(left[k] == t for k, t in enumerate(texts) if k not in found)


def test_edited_paragraphs_are_one_class(spark, rng):
    words = prose(rng, 64).split()  # no marks: paragraphs are cut by hashes alone
    texts = [" ".join(words)]
    for k in range(64):
        texts.append(" ".join([*words[:k], "edited", *words[k + 1 :]]))
    rows = substring_dedup.repeated_passages(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    assert set(rows.doc_id) >= {0} | {k + 1 for k in range(64) if max(k, 63 - k) >= 51}
    of = {}
    for r in rows.itertuples():
        of.setdefault(r.class_id, set()).add(texts[r.doc_id][r.start : r.start + r.length])
    assert any("edited" in x and "edited" not in y for found in of.values() for x in found for y in found)


@pytest.mark.parametrize("n", [2, 7, 40, 300])
def test_tree_edges_connect_what_brute_force_connects(rng, n):
    sets = {}
    while len(sets) < n:
        base = [rng.randrange(10**6) for _ in range(rng.randrange(1, 14))]
        for _ in range(rng.randrange(1, 12)):
            edited = {x if rng.random() > 0.1 else rng.randrange(10**6) for x in base}
            sets[len(sets)] = np.array(sorted(edited), np.uint64)
    similar = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    brute = [(a, b) for a, b in itertools.combinations(sets, 2) if similar(set(sets[a].tolist()), set(sets[b].tolist()))]
    edges = list(substring_dedup._tree_edges(sets, 0.8))
    assert closure(sets, edges) == closure(sets, brute) and {tuple(sorted(e)) for e in edges} <= set(brute)


def test_paragraphs_do_not_depend_on_what_stands_around(rng):
    text = sentences(rng, 300)
    alone, inside = substring_dedup.cut([text]), substring_dedup.cut(["", prose(rng, 77) + " " + text + " " + prose(rng, 9), "a"])
    own = lambda c, shift: {(a - shift, n) for a, n in zip(c.first.tolist(), c.size.tolist(), strict=True)}
    common = own(alone, 0) & own(inside, 77)
    assert sum(n for _, n in common) > 240
    constant = substring_dedup.cut(["beat " * 500])
    assert constant.size.sum() >= 495 and constant.size.max() <= substring_dedup.MOST


def test_passages_of_rows_that_share_an_id(spark, rng):
    a, b, c = (sentences(rng, 70) for _ in range(3))
    rows = [(5, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (8, a, 5), (8, None, 6), (None, a, 7), (9, "", 8), (10, c + "\n" + c, 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, start int").selectExpr("*", "'x' AS tid", "true AS removed", "1 AS length")
    got = substring_dedup.repeated_passages(spark, table)
    found = got.toPandas()
    assert set(found.doc_id) == {5, 7, 8}  # 10 repeats itself only
    left = sorted((r["start"], r["text"]) for r in substring_dedup.without_passages(table, got).collect())
    same = lambda k: left[k - 1][1] == rows[k - 1][1]
    assert len(left) == 9 and same(1) and same(2) and same(3) == (not same(4)) and not same(5) and all(map(same, (6, 7, 8, 9)))
    assert substring_dedup.without_passages(table.limit(0), got).collect() == []
    assert substring_dedup.without_passages(table, got.limit(0)).count() == 9


# ------------------------------------------------------------------- licences


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    texts = {
        1: "Copyright (c) 2020 Somebody\n\n" + mit.replace(",", " ,").upper(),
        2: "The licence:\nReleased under the MIT licence\nmore",
        3: mit + " And more.",
        4: "released under the mit license",
        5: "Some words.\n" + mit.replace(". ", ".\n") + "\nMore words.",
        6: "MIT License\n\n© 2020 Somebody\nAll rights reserved.\n" + mit,
        7: "Some words. " + mit,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["scope"], r["line"], r["last_line"], r["license_id"]) for r in licenses.scan(spark, docs).collect()}
    last = len(texts[5].split("\n")) - 2
    assert got == {(1, "document", None, None, "MIT"), (2, "line", 1, 1, "MIT"), (4, "document", None, None, "MIT"), (5, "passage", 1, last, "MIT"), (6, "document", None, None, "MIT")}
    forms = [licenses.canonical(t) for _, t in licenses.KNOWN]
    assert len(set(forms)) == len(forms)


def test_clauses_are_no_copyright_lines():
    assert licenses.canonical("(c) You must retain all notices") != licenses.canonical("(c) You may drop every notice")
    assert licenses.canonical("copyright notice and this permission") == "copyright notice and this permission"
    stated = ["Copyright (c) 2020, 2021 A B", "  * Copyright © The Authors", "(c) 1999 A. Corp.", "Copyright 2020 A", "Copyright [yyyy] [name]", "All rights reserved.", "© A B"]
    assert all(licenses.canonical(x) == "" for x in stated)


@pytest.mark.parametrize("inside", [False, True])
def test_licenses_at_every_width(spark, inside):
    import textwrap

    names = {n: t for n, t in reversed(licenses.KNOWN[:10])}
    texts, want = [], set()
    for name, text in names.items():
        for width in range(30, 121):
            text_ = "\n".join(textwrap.fill(x, width, break_on_hyphens=False, break_long_words=False) for x in text.split("\n"))
            want.add((len(texts), name))
            texts.append(f"Copyright (c) 2001-2020 A B\n{prose_line(width)}\n{text_}\n\nmore" if inside else f"Copyright 2020 A B\n\n{text_}")
    got = licenses.scan(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license_id"]) for r in got if r["scope"] == ("passage" if inside else "document")} == want and len(got) == len(want)


def prose_line(n):
    return " ".join(["word"] * (n % 7 + 1))


@pytest.mark.parametrize("name", licenses.WHOLE)
def test_whole_licenses(spark, name):
    import textwrap

    text = pkgutil.get_data("lexloom.llm", f"license_texts/{name}.txt").decode()
    lines = [" ".join(x.split()) for x in re.split(r"\n\s*\n", text)]
    texts = {1: "Copyright 2020 Somebody\n\n" + text.replace("License ", "Licence "), 2: "\n".join(lines).upper(), 3: re.sub(r"(?i)\bany\b", "some", text), 4: "Before.\n" + text + "\nAnd more."}
    for k, width in enumerate((50, 66, 100)):
        texts[10 + k] = "Before.\n" + "\n\n".join(textwrap.fill(x, width, break_on_hyphens=False, break_long_words=False) for x in lines) + "\nAnd more."
    got = licenses.scan(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license_id"]) for r in got if r["scope"] == "document"} >= {(1, name), (2, name)}
    assert {(r["doc_id"], r["license_id"]) for r in got if r["scope"] == "passage"} >= {(k, name) for k in (4, 10, 11, 12)}
    assert {r["license_id"] for r in got} == {name} and 3 not in {r["doc_id"] for r in got}


# -------------------------------------------------------------------- quality


def test_co_training_on_held_out_labels(spark, rng):
    rows, truth = [], []
    for k in range(1200):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        words = prose(rng, rng.randrange(20, 80)).split()
        if bad:
            words = [w + rng.choice(("###", "$$$", "***")) for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(("vile", "hateful"))
        rows.append((k, " ".join(words), "en" if rng.random() < 0.8 else "de", ("bad" if bad else "good") if rng.random() < 0.9 else "any", 10))
        truth.append((k, int(not bad), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(truth[:700], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_documents(spark, docs, labels).collect()}
    held = truth[700:]
    assert np.mean([(got[k]["p_quality"] >= 0.5) == q for k, q, _ in held]) > 0.97
    assert np.mean([(got[k]["p_toxic"] >= 0.5) == t for k, _, t in held]) > 0.95


def two_views(n=1500):
    rng = np.random.default_rng(5)
    y = (rng.random(n) < 0.5).astype(int)
    return y, y[:, None] * 4 + rng.normal(size=(n, 2)), y[:, None] * 5 + rng.normal(size=(n, 1))


def test_views_exchange_labels():
    y, text, meta = two_views()
    own, held = np.arange(1500) < 300, np.arange(300) % 3 == 0
    views = {"text": text[~own], "metadata": meta[~own]}
    head = quality.co_train(text[own], meta[own], y[own], held, lambda teachers: quality.taught(views, teachers))
    assert min(head["exchanged"]) > 1000  # all that a view is sure of, not a share of it
    both = head["both"].logit(np.column_stack([head["text"].logit(text), head["metadata"].logit(meta)]))
    assert ((both > 0) == y)[300:].mean() > 0.99


def test_guesses_change_the_other_view():
    y, text, meta = two_views()
    rare = np.hstack([meta, (np.arange(1500) % 2 * y)[:, None] * 1.0])  # a column that the labelled rows never show
    rare[:300, 1] = np.random.default_rng(1).normal(size=300) * 1e-3
    own, held = np.arange(1500) < 300, np.arange(300) % 3 == 0
    views = {"text": text[~own], "metadata": rare[~own]}
    with_pool = quality.co_train(text[own], rare[own], y[own], held, lambda teachers: quality.taught(views, teachers))
    without = quality.co_train(text[own], rare[own], y[own], held, lambda teachers: {})
    assert abs(with_pool["metadata"].w[1] - without["metadata"].w[1]) > 1e-3


def test_pool_sums_over_a_table_are_those_of_an_array(spark, rng):
    model = quality.Model({"vile": 0, "kind": 1, "sun": 2}, {})
    texts = [prose(rng, rng.randrange(1, 30)) + rng.choice(("", " vile", " kind!")) for _ in range(200)] + [None, ""]
    columns = [texts, [rng.choice(("en", "de", None)) for _ in texts], [rng.choice("abc") for _ in texts], [rng.choice((1, 10**6, None)) for _ in texts]]
    packed = model.packed(*columns)
    views = model.views(packed)
    assert np.allclose(views["text"], model.text_view(texts), atol=1e-6) and np.allclose(views["metadata"], model.metadata_view(*columns[1:]), rtol=1e-5, atol=1e-4)
    y = np.array([k % 2 for k in range(len(texts))])
    fitted = {k: quality.Logistic().fit(x, y) for k, x in views.items()}
    teachers = {k: quality.Teacher(m, quality.Logistic().fit(m.logit(views[k])[:, None] * 9, y, ridge=0.01), (1, 0)) for k, m in fitted.items()}
    for t in teachers.values():
        t.calibration.w = np.array([30.0, 0.0])  # sure of most
    want = quality.taught(views, teachers)
    table = spark.createDataFrame([(bytearray(x),) for x in packed], "x binary").repartition(5)
    got = quality._pool_sums(table, model)(teachers)
    assert want.keys() == got.keys() and len(want) >= 2
    for k, (n, g, h) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], g) and np.allclose(got[k][2], h)


def test_scores_do_not_depend_on_the_order_of_rows(spark, rng):
    rows = [(k // 2, prose(rng, 12) + (" ### $$$" if k % 4 < 2 else ""), "en", rng.choice("ab"), k) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(150)], "doc_id long, quality int, toxic int")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    scores = [quality.score_documents(spark, spark.createDataFrame(r, schema).repartition(n), labels).toPandas().sort_values(["doc_id", "p_quality"]) for r, n in ((rows, 3), (rows[::-1], 5))]
    assert np.allclose(scores[0].p_quality, scores[1].p_quality, atol=1e-9)
