"""Plain versions of what the operators compute, and inputs with edge cases."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {k: k + 32 for k in range(65, 91)}

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row string, h string"

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def edge_documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named as operators name theirs."""
    rows = [
        (1, "The cat and the dog sat on the mat and then they all went home to sleep", "en", "a"),
        (2, "the CAT and the dog sat on the mat and then they all went home to sleep", "en", "a"),
        (2, "the CAT and the dog sat on the mat and then they all went home to sleep", "en", "a"),
        (3, "", "en", "b"), (4, None, "en", "b"), (5, " \t\n ", None, None), (6, "one two", "en", None), (7, "One two", None, "a"),
        (None, "a text without any id that is long enough for shingles", "en", "c"),
        (None, "a text without any id that is long enough for shingles", "en", "c"),
        (9, LONG, "en", "a"), (10, "before it " + PASSAGE + " and after it", "en", "b"), (11, "something " + PASSAGE, "xx", "é"),
        (12, "%%% *** ### 123", "de", "b"), (13, "ünïcödé wörds", "de", "b"), (14, LONG, "en", "a"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), "row", None) for i, t, lang, source in rows]


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return WORD.findall(text.translate(UPPER) if lower else text)


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def groups(n: int, links: list[tuple[int, int]]) -> list[int]:
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def near_links(texts: list[str | None], percent: int = 75) -> list[tuple[int, int]]:
    sets = [shingles(t) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            and sets[j]]


def repeated(docs: dict[int, str | None], passage: int = 50) -> tuple[dict, dict]:
    """Words of each document in a passage that occurs again, and those in one that also stands at a smaller place."""
    seen = defaultdict(list)
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - passage + 1):
            seen[tuple(w[k:k + passage])].append((i, k))
    covered, later = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for at, (i, k) in enumerate(sorted(places)):
                covered[i].update(range(k, k + passage))
                if at:
                    later[i].update(range(k, k + passage))
    return covered, later
