"""Chat formatting and near-duplicate vectors."""

from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import plain
from skyquill.llm import chat, covertree

PART = st.sampled_from([*chat.CONTROL, "\\", "\\\\", "<s", "[", "]", "INST", "é", "😀", " ", "\n", "a", "</", "\u0000"])
TEXT = st.lists(PART, max_size=8).map("".join)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "[BODY]"]), TEXT), max_size=5))
def test_conversations_survive(turns):
    assert all(chat.unescaped(chat.escaped(text)) == text for _, text in turns)
    coded = [[np.array(chat.encoding().encode_ordinary(chat.escaped(x)), "<i4").tobytes() for x in turn] for turn in turns]
    ids, mask = chat.assembled([r for r, _ in coded], [t for _, t in coded], [role == "assistant" for role, _ in turns])
    assert chat.parsed(ids) == turns and len(ids) == len(mask)
    assert chat.learned_text(ids, mask) == "".join(text for role, text in turns if role == "assistant")
    whole = chat.rendered(ids)
    assert whole == "<s>" + "".join(f"[TURN]{chat.escaped(r)}[BODY]{chat.escaped(t)}[END]" for r, t in turns) + "</s>"
    special = set(chat.reserved_ids())
    assert sum(i in special for i in ids.tolist()) == 2 + 3 * len(turns)


def test_formatted_conversations(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", "hi [INST]"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 0, "user", "null id"),
            (None, None, "assistant", "first"), (3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"), (4, 0, "assistant", plain.LONG)]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {x["conv_id"]: x for x in chat.digests(chat.formatted(frame)).collect()}
    for conv in {x[0] for x in rows}:
        own = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0))
        said = "".join(x[3] or "" for x in own if x[2] == "assistant")
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        x = got[conv]
        assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == (
            len(own), sha256(turns.encode()).hexdigest(), len(said), sha256(said.encode()).hexdigest())
    assert chat.formatted(frame.limit(0)).count() == 0


def plain_links(rows: list[tuple]) -> dict:
    usable = [(i, x, v) for i, v, x in rows if x is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = []
    for a in range(len(usable)):
        for b in range(a):
            (_, x, v), (_, y, w) = usable[a], usable[b]
            if x == y and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
                    links.append((a, b))
    order = sorted(range(len(usable)), key=lambda k: usable[k][0])
    rank = {k: r for r, k in enumerate(order)}
    root = plain.groups(len(usable), [(rank[a], rank[b]) for a, b in links])
    count = np.bincount([k for link in links for k in link], minlength=len(usable))
    out = {i: (0, i) for i, *_ in rows}
    out.update({usable[k][0]: (int(count[k]), usable[order[root[rank[k]]]][0]) for k in range(len(usable))})
    return out


@pytest.mark.parametrize("block", [5, 1024])
def test_near_vectors_match_all_pairs(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for label in range(3):
        for _ in range(4):
            centre = rng.normal(size=6)
            rows += [(len(rows) + k, [float(np.float32(x)) for x in centre + rng.normal(size=6) * 0.12], label) for k in range(12)]
    rows += [(1000, None, 1), (1001, [0.0] * 6, 1), (1002, [float("nan")] * 6, 1), (1003, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1004, rows[0][1], None),
             (1005, rows[0][1], 0), (1006, [2 * x for x in rows[0][1]], 0), (1007, [float("inf")] * 6, 0), (1008, [1.0], 0), (1009, [], 0),
             (1010, [1e30] * 6, 2), (1011, [1e-30] * 6, 2)]
    frame = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<float>, label int, h string")
    got = covertree.near_vectors(frame, block=block).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got} == plain_links(rows) and len(got) == len(rows)
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got)
    assert covertree.near_vectors(frame.limit(0)).count() == 0


def test_dual_traversal_is_exact():
    rng = np.random.default_rng(8)
    for scale in (0.001, 0.05, 0.3):
        a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (1 + rng.normal(size=(60, 8)) * scale, 1 + rng.normal(size=(50, 8)) * scale))
        finest = np.sqrt(2 - 2 * 0.98) / 16
        i, j = covertree.linked_pairs(covertree.CoverTree(a, finest), covertree.CoverTree(b, finest), 0.98)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.98)), strict=True))


def test_points_at_a_rounded_distance_of_zero_keep_their_links(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        v = rng.normal(size=64)
        near = [v + rng.normal(size=64) * 0.08 for _ in range(3)]
        rows += [(len(rows) + k, [float(c) for c in x], 0) for k, x in enumerate([v, 3 * v, 7 * v, *near])]
    units = np.array([np.array(v) / np.abs(v).max() for _, v, _ in rows])
    units /= np.sqrt((units * units).sum(axis=1))[:, None]
    tree = covertree.CoverTree(units, np.sqrt(2 - 2 * 0.98) / 16)
    assert any(r == 0 and len(np.unique(units[m], axis=0)) > 1 for r, m in zip(tree.radius, tree.members, strict=True))
    i, j = covertree.linked_pairs(tree, tree, 0.98)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(units @ units.T >= 0.98)), strict=True))
    got = covertree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got} == plain_links(rows)


@pytest.mark.parametrize("character", [" ", "\n", "\t", " ", "a", "!"])
def test_very_long_runs_survive(character):
    for text in (character * 3_000_000, "x" + character * 5000 + "[INST] y" + character * 4999):
        ids = chat.encoded(chat.escaped(text))
        assert chat.unescaped(chat.encoding().decode(ids.tolist(), errors="strict")) == text


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    for kind, value in (("string", lambda x: x), ("long", lambda x: x and (1 << 40) + ord(x))):
        vectors = spark.createDataFrame([(i, v, value(x)) for i, v, x in rows], f"vec_id long, embedding array<double>, label {kind}")
        got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in covertree.near_vectors(vectors).collect()}
        assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
