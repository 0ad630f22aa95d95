"""Packing and mixing."""

import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import plain
from skyquill.llm import mixing
from skyquill.llm.packing import END, Limits, Packer, pack_documents
from skyquill.llm.tokens import WordEncoder, vocabulary


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(alphabet="aAéÉ'sΣßİ.,!7 ́ 日<|>", max_size=20), max_size=5))
def test_word_cache_gives_the_tokenizers_ids(texts):
    encode = WordEncoder(remembered=3).encode
    for _ in range(2):
        got = [np.frombuffer(x, "<u2").tolist() for x in encode([t.encode() for t in texts])]
        assert got == [vocabulary().encode(t, add_special_tokens=False).ids for t in texts]


EXAMPLES = st.lists(st.tuples(st.integers(1, 90), st.integers(0, 40)), min_size=1, max_size=60)


@settings(deadline=None, max_examples=100)
@given(EXAMPLES, st.integers(1, 6), st.integers(20, 64))
def test_packer_keeps_its_limits(examples, segments, loss):
    packer = Packer(Limits(64, segments, loss))
    packer.add(list(range(len(examples))), [n for n, _ in examples], [free for _, free in examples])
    packer.pack()
    seen = {i: [] for i in range(len(examples))}
    for pieces in packer.closed:
        length = sum(n for _, _, n in pieces)
        assert length <= 64 and len(pieces) <= segments
        assert length == 64 or length & (length - 1) == 0
        assert sum(max(0, s + n - max(s, examples[k][1])) for k, s, n in pieces) <= loss
        for key, start, n in pieces:
            seen[key].append((start, n))
    for i, (n, _) in enumerate(examples):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == n


def test_packer_without_cuts():
    packer = Packer(Limits(10, 3, 10), cut=False)
    packer.add([0, 1, 2, 3, 4], [6, 4, 5, 5, 9], [0] * 5)
    packer.pack()
    assert sorted(sum(n for _, _, n in pieces) for pieces in packer.closed) == [9, 10, 10]
    with pytest.raises(ValueError):
        packer.add([5], [11], [0])


def test_packed_documents(spark):
    rows = plain.edge_documents()
    docs = spark.createDataFrame(rows, plain.DOCUMENTS).repartition(2)
    got = pack_documents(docs, Limits(512, 8, 512), pool_tokens=2000, with_ids=True).toPandas()
    assert ((got["length"] <= 512) & (got["sequence_length"] <= 512)).all()
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert (pieces["offset"] == pieces["length"].cumsum() - pieces["length"]).all() and len(pieces) <= 8
    padded = got.drop_duplicates("sequence_id")["sequence_length"]
    assert all(n == 512 or n & (n - 1) == 0 for n in padded)
    assert all(zlib.crc32(ids) == crc and len(ids) == 4 * n for ids, crc, n in zip(got["ids"], got["ids_crc32"], got["length"], strict=True))
    once = {i: t for i, t, *_ in rows if i not in (2, None)}
    for i, text in once.items():
        own = got[got["doc_id"] == i].sort_values("start")
        ids = np.frombuffer(b"".join(own["ids"]), "<u4").tolist()
        assert ids == [*vocabulary().encode(text or "", add_special_tokens=False).ids, END]
        assert (own["doc_tokens"] == len(ids)).all() and own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist()
    assert got[got["doc_id"].isna()]["length"].sum() % 2 == 0  # two equal rows
    assert pack_documents(docs.limit(0)).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 80))
def test_fit_is_the_best_subset_sum_of_its_window(counts, budget):
    sizes = np.array(sorted(counts))
    many = np.array([counts[s] for s in sizes.tolist()])
    taken = mixing.fit(sizes, many, budget)
    assert ((taken >= 0) & (taken <= many)).all()
    total, base = int((sizes * taken).sum()), (many * budget // max(1, int((sizes * many).sum()))).clip(max=many)
    assert total <= max(budget, 0)
    reachable = {int(np.dot(sizes, x)) for x in product(*[range(b, m + 1) for b, m in zip(base, many, strict=True)])}
    assert total == max(x for x in reachable if x <= budget)


def shares(sizes: list[int], weights: tuple, share: float, most: float) -> list[float]:
    """Reshare by weight what exceeds a limit, until no target is above."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        over = [i for i in open_ if left * weights[i % len(weights)] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / total
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("sizes", [[5, 100, 7, 20, 0, 300], [10], [0, 0], [1, 1000, 1000]])
def test_targets_reshare_the_excess(spark, sizes):
    frame = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.targets(frame).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(shares(sizes, mixing.WEIGHTS, 1.5, 2.0))


def test_mix(spark):
    docs = spark.createDataFrame(plain.edge_documents(), plain.DOCUMENTS)
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].fillna(-1).values.tolist())) == sorted(map(tuple, again[key].fillna(-1).values.tolist()))
    assert len(got) == docs.count() and (got["taken"] <= 2 * got["size"]).all()
    totals = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (totals["taken"] <= totals["target"] + 1).all()
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    words = sum(len(plain.words(x["text"])) for x in rows.collect())
    assert words == got["taken"].sum()
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_sources_come_near_their_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), f"s{i % 4}" if i % 4 else None) for i in range(800)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    got["source"] = [rows[i][2] or "" for i in got["doc_id"]]
    for _, own in got.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 1


def test_equal_rows_are_taken_one_by_one(spark):
    words = " ".join(["w"] * 100)
    rows = [(7, words, "a")] * 100 + [(k, "x y z", "b") for k in range(10)] + [(None, "u v", None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs.repartition(4)).toPandas()
    for size in (100, 2):
        own = got[got["size"] == size]
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= size and (own["taken"] <= 2 * size).all()
    again = mixing.mix(docs.repartition(9)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].fillna(-1).values.tolist())) == sorted(map(tuple, again[key].fillna(-1).values.tolist()))
    assert sum(len(plain.words(x["text"])) for x in mixing.mixed(docs).collect()) == got["taken"].sum()
