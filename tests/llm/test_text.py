"""Words, hashes, sketches, near-duplicates and repeated passages against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import plain
from skyquill.llm import setsketch, suffixes, textkit
from skyquill.llm.near_text import near_duplicates, one_of_each
from skyquill.llm.suffixes import repeated_passages, without_repeats

TEXT = st.one_of(st.none(), st.text(alphabet="aAbÉ \t\n\x0b\x0c\r  x", max_size=30))


@settings(deadline=None, max_examples=150)
@given(st.lists(TEXT, max_size=6))
def test_words_and_shingles(texts):
    column = pa.array(texts, pa.string())
    data, offsets = textkit.text_bytes(column)
    starts, ends, first = textkit.word_borders(data, offsets)
    found = [[bytes(data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)]
             for a, b in zip(first[:-1], first[1:], strict=True)]
    assert found == [plain.words(t, lower=False) for t in texts]
    sets = [s for _, _, words, at, _, _ in textkit.lower_words(column) for s in textkit.shingle_sets(words, at, 5)]
    want = [plain.shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(sets)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def test_slices_cover_all_rows():
    column = pa.array(["x" * 10, "", None, "y" * 100, "z"])
    _, offsets = textkit.text_bytes(column.slice(1))
    assert offsets[-1] == 101
    runs = list(textkit.slices(offsets, 5))
    assert [r for a, b in runs for r in range(a, b)] == list(range(4))


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    a, b = np.sort(pool[:3000]), np.sort(pool[600:3400])
    sketch = setsketch.sketches([a, b, np.union1d(a, b), np.zeros(0, np.uint64)])
    assert (setsketch.merged(sketch[0], sketch[1]) == sketch[2]).all() and not sketch[3].any()
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    estimate, ratio = setsketch.estimates(sketch[:1], sketch[1:2], np.array([len(a)]), np.array([len(b)]), truth)
    assert abs(estimate[0] - truth) < 0.12 and ratio[0] < 25
    _, ruled_out = setsketch.estimates(sketch[:1], sketch[1:2], np.array([100]), np.array([1000]), 0.75)
    assert np.isinf(ruled_out[0])


def near_copies(seed: int) -> list[str]:
    rng = random.Random(seed)
    texts = []
    for group in range(3):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(80)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(80)] = f"new{rng.randrange(10_000)}"
            texts.append(" ".join(copy))
    return texts + [texts[3].upper(), texts[3].replace(" ", "\n"), "few words here", "few  WORDS here"]


@pytest.mark.parametrize("block", [4, 1024])
def test_near_duplicates_match_all_pairs(spark, block):
    texts = near_copies(1)
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).toPandas()
    want = plain.groups(len(texts), plain.near_links(texts))
    assert dict(zip(got["doc_id"], got["component_id"], strict=True)) == dict(enumerate(want))
    assert all(n == len(plain.shingles(texts[i])) for i, n in zip(got["doc_id"], got["n_shingles"], strict=True))


def test_near_duplicates_of_edge_cases(spark):
    docs = spark.createDataFrame(plain.edge_documents(), plain.DOCUMENTS)
    got = [tuple(x) for x in near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    by_id = {x[0]: x for x in got}
    assert len(got) == len(plain.edge_documents())
    assert by_id[2][2] == 1 and not by_id[2][3] and by_id[7][2] == 6 and by_id[14][2] == 9
    assert by_id[3] == (3, 0, 3, True)
    assert by_id[None] == (None, by_id[None][1], None, True)
    left = [tuple(x) for x in one_of_each(docs).collect()]
    assert sorted((x[0] is None, x[0] or 0) for x in left) == sorted(
        (x is None, x or 0) for x in [1, 3, 4, 5, 6, None, 9, 10, 12, 13])  # 10 and 11 share 56 of 62 shingles
    assert one_of_each(docs).columns == docs.columns
    assert near_duplicates(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0


def passages(seed: int) -> list[str]:
    rng = random.Random(seed)
    shared = [" ".join(f"s{k}p{i}" for i in range(rng.randrange(50, 120))) for k in range(4)]
    texts = []
    for i in range(60):
        parts = [" ".join(f"own{i}x{rng.randrange(10_000)}" for _ in range(rng.randrange(0, 80))) for _ in range(3)]
        picks = rng.sample(shared, rng.randrange(0, 3))
        mixed = [x for pair in zip(parts, [*picks, "", ""], strict=False) for x in pair if x]
        texts.append(" ".join(mixed))
    return [*texts, texts[0], texts[5].upper(), shared[0][:200], "again and " * 80]


def test_minimisers_are_chosen_by_content():
    words = textkit.mix(np.arange(300, dtype=np.uint64))
    alone, _ = suffixes.minimisers(words[100:180], np.array([0, 80]))
    within, _ = suffixes.minimisers(words, np.array([0, 300]))
    shared = set((alone + 100).tolist())
    assert shared <= set(within.tolist()) and shared
    # every run of 50 words holds a kept position with its 16 words
    assert all(any(s <= p <= s + 34 for p in within) for s in range(251))
    assert len(suffixes.minimisers(words[:49], np.array([0, 49]))[0]) == 0


def test_passages_match_all_windows(spark):
    texts = dict(enumerate(passages(2)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    covered, later = plain.repeated(texts)
    got = repeated_passages(docs).collect()
    found, removed = {}, {}
    for x in got:
        span = set(range(x["start_word"], x["start_word"] + x["n_words"]))
        found.setdefault(x["doc_id"], set()).update(span)
        if x["removed"]:
            removed.setdefault(x["doc_id"], set()).update(span)
    assert set(found) == set(covered)
    for i in texts:
        assert found.get(i, set()) <= covered.get(i, set()) and removed.get(i, set()) <= later.get(i, set())
    # neighbours in the order decide, so a few words at the edge of a drifting chain may stay
    assert sum(map(len, removed.values())) >= 0.98 * sum(map(len, later.values()))
    rest = {x["doc_id"]: x["text"] for x in without_repeats(docs).collect()}
    for i, text in texts.items():
        kept = [w for k, w in enumerate(plain.words(text, lower=False)) if k not in removed.get(i, set())]
        assert plain.words(rest.get(i), lower=False) == kept
    assert {w for t in texts.values() for w in plain.words(t)} == {w for t in rest.values() for w in plain.words(t)}


def frequent_line(seed: int) -> list[str]:
    """300 texts with one line of 30 words; for 40 pairs of them the 20 to 30 words before or after it are the same as well."""
    rng = random.Random(seed)
    line = [f"line{i}" for i in range(30)]
    texts = [[f"t{t}w{i}" for i in range(60)] for t in range(300)]
    for k in range(40):
        shared = [f"pair{k}w{i}" for i in range(20 + k % 11)]
        for t in rng.sample(range(300), 2):
            texts[t][30:30] = [*shared, *line] if k % 2 else [*line, *shared]
    return [" ".join(t if "line0" in t else t[:30] + line + t[30:]) for t in texts]


def test_passages_around_a_frequent_line_match_all_windows(spark):
    texts = dict(enumerate(frequent_line(6) + passages(3)))
    covered, later = plain.repeated(texts)
    found, removed = {}, {}
    for x in repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect():
        span = set(range(x["start_word"], x["start_word"] + x["n_words"]))
        found.setdefault(x["doc_id"], set()).update(span)
        if x["removed"]:
            removed.setdefault(x["doc_id"], set()).update(span)
    assert found == covered and removed == later


def test_passages_of_edge_cases(spark):
    docs = spark.createDataFrame(plain.edge_documents(), plain.DOCUMENTS)
    got = repeated_passages(docs).collect()
    # the long text repeats itself
    assert {(x["doc_id"], x["removed"]) for x in got} == {(9, False), (9, True), (14, True), (10, False), (11, True)}
    left = without_repeats(docs)
    assert left.columns == docs.columns
    by_id = {x["doc_id"]: x for x in left.collect()}
    assert 14 not in by_id and by_id[11]["text"] == "something " and by_id[11]["n_chars"] == 10
    assert by_id[10]["text"].startswith("before it passage0") and by_id[4]["text"] is None and by_id[3]["text"] == ""
    assert left.count() == docs.count() - 1
    assert repeated_passages(docs.limit(0)).count() == 0 and without_repeats(docs.limit(0)).count() == 0
