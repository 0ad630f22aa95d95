"""Bin completion, fill-in-the-middle and periodic runs against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import plain
from skyquill.llm import bestfit, queries
from skyquill.llm.fim import Format, RankIndex, fill_in_middle, restored
from skyquill.llm.runs import maximal_runs, periodic_runs, runs_of_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# bin completion

def fewest(items: list[int], capacity: int) -> int:
    best = [len(items)]

    def place(k: int, rooms: list[int]) -> None:
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                rooms[rooms.index(room)] = room - items[k]
                place(k + 1, list(rooms))
                rooms[rooms.index(room - items[k])] = room
        place(k + 1, [*rooms, capacity - items[k]])
    place(0, [])
    return best[0]


@settings(deadline=None, max_examples=120)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_small_packings_are_the_best(items):
    counts = np.bincount(items, minlength=21)
    plan = bestfit.complete(counts, 20)
    placed = Counter()
    for pattern in plan:
        assert sum(size * n for size, n in pattern.filling) <= 20
        for size, n in pattern.filling:
            placed[size] += n * pattern.times
    best = fewest(sorted(items, reverse=True), 20)
    assert placed == Counter(items) and sum(p.times for p in plan) == best >= bestfit.least_bins(counts, 20)


def test_search_beats_best_fit():
    # best fit, longest first, needs four bins: 6+4, 5+5... a filling of three is better
    counts = np.bincount([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], minlength=61)
    assert sum(p.times for p in bestfit.best_fit(counts, 60)) == 4
    assert sum(p.times for p in bestfit.complete(counts, 60)) == 3 == bestfit.least_bins(counts, 60)


def test_dominance():
    assert bestfit.dominates(((6, 1),), ((4, 1), (2, 1)))
    assert bestfit.dominates(((5, 1), (3, 1)), ((5, 1), (2, 1), (1, 1)))
    assert not bestfit.dominates(((4, 1), (4, 1)), ((5, 1), (2, 1)))
    counts = np.bincount([6, 4, 2, 3], minlength=11)
    assert list(bestfit.fillings(counts, 6)) == [((6, 1),)]  # one item that fills the room is the only filling


def test_plan_is_bounded_by_the_capacity():
    counts = np.concatenate([[0], np.full(1024, 10 ** 9)])
    plan = bestfit.complete(counts, 1024)
    assert len(plan) <= 4 * 1024 and sum(p.times for p in plan) == bestfit.least_bins(counts, 1024)


@pytest.mark.parametrize("text", [
    "<|endoftext|> a<|endoftext|>", "x" + " " * 5000 + "ab" + "\n" * 4500 + " b" + " " * 4999, " " * 4097 + "\nc <|endoftext|>" + "\t" * 4096,
    " " * 5000 + "é", " " * 5000 + "<|endoftext|>" + " " * 5000 + "'s", "it's 12,000 €uro日本", "", "a" * 5000 + "!" * 5000])
def test_ids_are_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain_ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert bestfit.token_ids(text).tolist() == plain_ids


@pytest.mark.parametrize("character", [" ", "\n", " ", "a", "!"])
def test_very_long_runs_have_ids(character):
    assert len(bestfit.token_ids(character * 3_000_000 + "b"))


def test_pieces_of_whole_documents(spark):
    edge = spark.createDataFrame(plain.edge_documents(), plain.DOCUMENTS).repartition(3)
    found = bestfit.pack_whole(edge, with_ids=True).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for row in found:
        sequences[row.sequence_id].append((row.offset, row.length))
        documents[row.doc_id].append(row)
        assert zlib.crc32(bytes(row.ids)) == row.ids_crc32 and len(row.ids) == 4 * row.length
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    texts = defaultdict(list)
    for row in plain.edge_documents():
        texts[row[0]].append(bestfit.token_ids(row[1] or "").tolist() + [bestfit.END])
    for doc, wanted in texts.items():
        got = []
        for row in sorted(documents[doc], key=lambda r: (len(wanted) > 1 and r.ids_crc32, r.start)) if len(wanted) > 1 else sorted(
                documents[doc], key=lambda r: r.piece):
            got += np.frombuffer(bytes(row.ids), "<u4").tolist()
        assert Counter(got) == Counter(x for w in wanted for x in w)
        if len(wanted) == 1:
            pieces = sorted(documents[doc], key=lambda r: r.piece)
            assert got == wanted[0] and [r.piece for r in pieces] == list(range(len(pieces)))
            assert all(r.length == 1024 for r in pieces[1:]) and pieces[0].start == 0
    least = bestfit.least_bins(np.bincount([r.length for r in found], minlength=1025), 1024)
    assert len(sequences) == least


def test_nothing_to_pack(spark):
    assert bestfit.pack_whole(spark.createDataFrame([], plain.DOCUMENTS)).count() == 0


# fill-in-the-middle

@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 400), max_size=300), st.integers(1, 126))
def test_index_is_exact_and_within_its_bound(steps, bound):
    offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
    index = RankIndex.fit(offsets, bound)
    assert (index.offsets(np.arange(len(offsets))) == offsets).all() and np.abs(index.residual.astype(int)).max() <= bound + 1
    assert len(index.first) <= len(offsets)


def test_index_of_even_steps_is_one_piece():
    assert len(RankIndex.fit(np.arange(0, 70_000, 7), 1).first) == 1


def plain_fim(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    drawn = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(drawn[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def test_fim_equals_the_plain_version(spark):
    more = [(k, f" ünï{k}  code\tpoints \n{k} 日本 <{k % 3}S <S" + ("> " if k % 7 == 0 else " ") * (k % 5), None, None, 0, None, None) for k in range(100, 220)]
    rows = plain.edge_documents() + more
    cut = fill_in_middle(spark.createDataFrame(rows, plain.DOCUMENTS))
    got = cut.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored(F.col("output"), F.col("form")).alias("text")).collect()
    want = Counter((r[0], *plain_fim(r[0], r[1]), r[1] or "") for r in rows)
    assert Counter(tuple(r) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(spark.createDataFrame([], plain.DOCUMENTS)).count() == 0


def test_fim_with_other_marks(spark):
    form = Format("[prefix]", "[suf]", "[m]", rate=100, suffix_first=50, seed=7, bound=3)
    docs = spark.createDataFrame([(k, f"some text {k} to cut <P> in pieces") for k in range(40)], "doc_id long, text string")
    got = fill_in_middle(docs, form, carry=["doc_id", "text"]).select("row.text", "form", restored(F.col("output"), F.col("form"), form).alias("again"))
    assert all(r.text == r.again and r.form != "plain" for r in got.collect())


# periodic runs

def plain_runs(w, shortest=6, exponent=4):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        start = 0
        for k in range(len(w) - q + 1):
            if k + q == len(w) or w[k] != w[k + q]:
                length = k + q - start
                if length >= max(shortest, exponent * q) and (start, length) not in found:
                    found[start, length] = q
                start = k + 1
    return sorted((s, n, q) for (s, n), q in found.items())


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.tuples(st.text("abc", min_size=1, max_size=3), st.integers(1, 12)), max_size=6), min_size=1, max_size=4))
def test_runs_equal_the_plain_version(rows):
    texts = [" ".join(" ".join(part for _ in range(n)) for part, n in row) + "  " for row in rows]
    texts = [re.sub(r"(?<=\w)(?=\w)", " ", t) for t in texts]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    for shortest, exponent in ((6, 4), (2, 2)):
        row, start, length, period, counts = runs_of_rows(data, offsets, shortest, exponent)
        assert counts.tolist() == [len(t.split()) for t in texts]
        for k, text in enumerate(texts):
            got = list(zip(start[row == k].tolist(), length[row == k].tolist(), period[row == k].tolist(), strict=True))
            assert got == plain_runs(text.split(), shortest, exponent)


def test_one_word_for_long():
    s = np.concatenate([[0], np.full(200_000, 5), [9]])
    start, end, period = maximal_runs(s)
    assert (start.tolist(), end.tolist(), period.tolist()) == ([1], [200_001], [1])


def plain_row(doc, text, plant=True):
    w = plain.words(text, lower=False)
    n = len(w)
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_query_equals_the_plain_version(spark, tmp_path):
    rows = [r for r in plain.edge_documents() if r[0] is not None and len(r[1] or "") < 10_000]
    rows += [(k, " ".join(f"w{(k * i * i) % 11}" for i in range(k % 90)), "en", "a", 0, None, None) for k in range(100, 500)]
    rows += [(900, " a" * 50 + " b a b a b a b a b", "en", "a", 0, None, None)]
    spark.createDataFrame(rows, plain.DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == Counter(plain_row(r[0], r[1]) for r in rows)
    assert sum(n for r, n in got.items() if r[1]) > 20


def test_runs_of_edge_documents(spark):
    edge = spark.createDataFrame(plain.edge_documents(), plain.DOCUMENTS)
    rows = periodic_runs(edge, carry=["doc_id", "row", "h"]).collect()
    assert Counter((r.row.doc_id, r.n_words, r.collapsed, r.best) for r in rows if len(r.collapsed) < 9999) == Counter(
        (r[0], len(plain.words(r[1])), " ".join(plain.words(r[1], lower=False)), None) for r in plain.edge_documents() if len(r[1] or "") < 9999)
    long = [r for r in rows if r.n_words == 30_000]
    assert len(long) == 2 and all(not r.runs and r.row.row == "row" for r in long)
    assert periodic_runs(spark.createDataFrame([], plain.DOCUMENTS)).count() == 0
