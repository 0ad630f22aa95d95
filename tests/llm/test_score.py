"""Language, quality rules, toxicity and address filters."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import plain
from conftest import DATA
from skyquill.llm import divergence, language, queries, toxicity, urls


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_language_of_documents(spark, documents):
    got = language.documents_language(documents).select("row.lang", "language", "kept").toPandas()
    assert (got["lang"] == got["language"]).mean() > 0.99 and got["kept"].mean() > 0.99


def test_language_uses_every_evidence(spark, documents):
    texts = {x["lang"]: x["text"] for x in documents.dropDuplicates(["lang"]).collect()}
    clear = [(i, texts[lang], lang, "en.example.org" if lang == "en" else "fr.example.org") for i, lang in enumerate(["en", "fr"] * 30)]
    unclear = [(100, "a b", "en", None), (101, "a b", "fr", None), (102, "a b", None, "en.example.org"), (103, "a b", None, "fr.example.org"),
               (104, "a b", None, "new.fr.example.org")]
    docs = spark.createDataFrame(clear + unclear, "doc_id long, text string, lang string, source string")
    got = {x["row"]["doc_id"]: x for x in language.documents_language(docs, ("en", "fr")).collect()}
    assert [got[i]["language"] for i in (100, 101, 102, 103)] == ["en", "fr", "en", "fr"]


def test_language_of_edge_cases(spark):
    docs = spark.createDataFrame(plain.edge_documents(), plain.DOCUMENTS).withColumns({"language": F.lit(1), "kept": F.lit(1), "_text": F.lit(1)})
    kept = language.spoken(docs)
    assert kept.columns == docs.columns
    ids = {x["doc_id"] for x in kept.collect()}
    assert not ids & {3, 4, 5, 12} and {1, 9, 14, 10} <= ids
    assert language.spoken(docs.limit(0)).count() == 0


def test_numbers_are_no_evidence_against_a_language(spark, documents):
    rows = [(10_001, "With +1 (807) 555-5623 the lecne.06@mail4.example.com of 39.73.140.133 4397110767823743 and that", "en", "src0", 1),
            (10_002, "password=101a821562d3999d51 der und die", "de", "src0", 1), (10_003, "101 821 #### 56", "de", "src0", 1)]
    docs = documents.unionByName(spark.createDataFrame(rows, documents.schema))
    got = {x["doc_id"]: x for x in language.documents_language(docs).where("row.doc_id > 10000").select("row.doc_id", "language", "kept").collect()}
    assert got[10_001]["kept"] and got[10_001]["language"] == "en" and got[10_002]["language"] == "de" and not got[10_003]["kept"]


def test_language_of_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = queries.page_language(spark, DATA).join(pages, "page_id").select("language", F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("l"))
    assert got.count() == pages.count() and got.where("language = l").count() >= 0.95 * pages.count()
    rows = [(1, None, None), (2, "http://x.org/en/", None), (3, None, "<html lang=fr><p>le chat et la souris dans la maison de la mer"), (3, "a", "")]
    assert language.pages_language(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 4


def repeated_words(text: str) -> int:
    w, places = plain.WORD.findall(text), {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i:i + 3]), []).append(i)
    return len({i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)})


def base(text: str | None) -> tuple:
    text = text or ""
    w, lines = plain.WORD.findall(text), [x for x in text.split("\n") if plain.WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated_words(text)


def test_base_counts(spark, documents, monkeypatch):
    rng = random.Random(3)
    rows = plain.edge_documents() + [(10_000 + i, "".join(rng.choice(["a ", "b ", "c\n", "é", "# ", "\t"]) for _ in range(rng.randrange(80))), "en", "s", 0, "", "")
                                     for i in range(60)]
    docs = spark.createDataFrame(rows, plain.DOCUMENTS)
    texts = {i: t for i, t, *_ in rows}
    for bits in (24, 3):  # a few bits make texts long enough for the wide way
        monkeypatch.setattr(divergence, "_BITS", bits)
        got = divergence.judged(docs.unionByName(documents, allowMissingColumns=True) if bits == 24 else docs).toPandas()
        for x in got[got["doc_id"].isin([i for i in texts if i is not None])].itertuples():
            if x.doc_id >= 10_000:
                assert base(texts[x.doc_id]) == (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)
    got = {x["doc_id"]: x for x in divergence.judged(docs).collect()}
    for i in (1, 3, 4, 5, 6, 9, 12, 13):
        x = got[i]
        assert base(texts[i]) == (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"])
        assert x["base_failed"] == (x["n_words"] < 50 or 2 * x["n_repeat_words"] > x["n_words"])
    assert divergence.judged(docs.limit(0)).count() == 0


def test_distance(spark):
    rows = [([1, 2, 3], [3, 2, 1]), ([1, 0], [0, 5]), ([2, 4], [1, 2]), ([0, 0], [1, 1])]
    got = [x[0] for x in spark.createDataFrame(rows, "p array<long>, q array<long>").select(divergence.distance("p", "q")).collect()]

    def js(p, q):
        if not sum(p) or not sum(q):
            return 0.0
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        return math.sqrt(sum(x * math.log2(x / z) for x, z in zip(p, m, strict=True) if x) / 2
                         + sum(x * math.log2(x / z) for x, z in zip(q, m, strict=True) if x) / 2)
    assert got == pytest.approx([js(p, q) for p, q in rows], abs=1e-7) and got[1] == pytest.approx(1)


def test_symbol_salad_is_dropped_and_prose_kept(spark):
    documents = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet")
    salad = documents.where("length(text) > 800 AND NOT contains(text, '|')").limit(5).withColumn("text", F.regexp_replace("text", "([a-z]) ", "$1%%% ")).withColumn("doc_id", -F.col("doc_id") - 1)
    got = divergence.judged(documents.unionByName(salad)).where("NOT base_failed")
    assert got.where("doc_id < 0 AND kept").count() == 0
    prose = got.join(documents.where("NOT text RLIKE '[#*$%&|<>]{3}'"), "doc_id").select("kept").toPandas()["kept"]
    assert prose.mean() > 0.99


@pytest.fixture(scope="module")
def model(documents):
    return toxicity.character_model(documents)


def test_disguised_words_are_restored(model):
    restorer = toxicity.Restorer(model)
    for written, word in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("m0r0n", "moron"),
                          ("$cum", "scum"), ("w0rthl3ss", "worthless"), ("tr@sh!", "trash")):
        assert word.encode() in restorer.words(f"the {written} and of".encode()), written
    assert restorer.words(b"the plain of words, and") == {b"the", b"plain", b"of", b"words", b"and"}
    assert restorer.words(b"") == set() and restorer.words("é é é ñ".encode())


def test_signs_miss_no_disguise(model):
    rng = random.Random(12)
    parts = ["the ", "1d10t ", "i d i o t ", "i.d.i.o.t ", "aaa", "b", "\n", "a!", "! ", "é", "x-y-z ", "$", "9", ". ", "i  d  i ", "_a_b_c_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, ""]
    restorer = toxicity.Restorer(model)
    for text, seen in zip(texts, toxicity._lower_texts(pa.array(texts)), strict=True):
        assert seen[0] == (text or "").encode() and restorer.words(*seen) == restorer.words(seen[0])


def test_viterbi_is_the_best_path(model):
    restorer = toxicity.Restorer(model)
    for written in ("c4t", "1t", "s3a", "@n7"):
        best = (-math.inf, "")
        for path in product(*[restorer._readings(c) for c in written]):
            x = y = 0
            total = 0.0
            for _, symbol, log in path:
                total += log + model[x, y, symbol]
                x, y = y, symbol
            best = max(best, (total + model[x, y, 0], "".join(p[0] for p in path)))
        assert restorer._decode(written.encode()) == best[1].encode()


def test_toxicity_is_learned_and_held_out(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    got = queries.op8_toxicity(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    seen = got[got["held_out"]].merge(labels, on="doc_id")
    assert ((seen["predicted"] == 1) & (seen["toxic"] == 0)).mean() < 0.02
    toxic, other = seen[seen["toxic"] == 1]["score"].to_numpy(), seen[seen["toxic"] == 0]["score"].to_numpy()
    assert (toxic[:, None] > other[None]).mean() + (toxic[:, None] == other[None]).mean() / 2 > 0.9
    assert got["score"].between(0, 1).all() and len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_toxicity_of_edge_cases(spark):
    docs = spark.createDataFrame(plain.edge_documents(), plain.DOCUMENTS)
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, 1), (None, 1), (10, None), (11, 0)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, scorer).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert toxicity.scored(docs.limit(0), scorer).count() == 0
    toxicity.fit(docs.limit(0), labels.limit(0))


def test_addresses(spark):
    rows = ["http://A.Example.NET/en/x?q=1#y", "https://example.net", "ftp://x.net/?a/b", None, "no scheme", "x://y://z/a", "http://net/a", "http://planet/a",
            "http://de.example.com/de/1", "http://example.org/fr/", "http://org/fr/1", "http://a.com#f/de/", "http://x.example.net/en", "://", "http:///en/"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = urls.judged(pages, spark.createDataFrame([], "page_id long, bad int"), queries.RULES).orderBy("page_id").collect()
    want = []
    for url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, path = rest[:cut].translate(plain.UPPER), rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
        fits = [r for r in queries.RULES if host and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fits, key=lambda r: len(r[1]) + len(r[2]), default=None)
        want.append((host, path, rule and rule[1] + rule[2], rule[0] if rule else "allow"))
    assert [(x["host"], x["path"], x["rule"], x["verdict"]) for x in got] == want


def test_reputation_shrinks_and_blocks(spark):
    rng = random.Random(9)
    outcomes = [("bad.spam.com", 1)] * 60 + [("new.spam.com", 1)] + [("bad.spam.com", 0)] * 2 + [("one.fine.org", 1)] + [("empty.org", None)]
    outcomes += [(f"h{i}.fine.org", int(rng.random() < 0.05)) for i in range(20) for _ in range(40)]
    frame = spark.createDataFrame(outcomes, "host string, bad int")
    got = {x["host"]: x for x in urls.reputations(frame).collect()}
    assert got["bad.spam.com"]["bound"] > 0.5 and got["one.fine.org"]["bound"] < 0.5 and "empty.org" not in got
    assert got["one.fine.org"]["mean"] < got["new.spam.com"]["mean"] < 1
    counts = Counter(h for h, b in outcomes if b is not None)
    assert all(min(x["mean"], 1 - x["mean"]) > 0 and abs(x["bound"]) < 1 for x in got.values()) and len(got) == len(counts)
    assert urls.reputations(frame.limit(0)).count() == 0


def test_hosts_without_labels_are_judged_by_what_is_above_them(spark):
    urls_of = [f"http://h{i % 5}.spam.com/{i}" for i in range(300)] + [f"http://h{i % 5}.fine.com/{i}" for i in range(300)]
    urls_of += [f"http://h{i}.d{i % 20}.bad/" for i in range(300)]
    outcomes = [(i, int(i < 300 or i >= 600)) for i in range(len(urls_of))]
    asked = ["http://new.spam.com/", "http://new.fine.com/", "http://x.new.bad/", "http://x.other/", None, "http://h0.spam.com/"]
    pages = spark.createDataFrame(list(enumerate(urls_of + asked)), "page_id long, url string")
    got = {x["page_id"] - len(urls_of): x for x in urls.judged(pages, spark.createDataFrame(outcomes, "page_id long, bad int"), []).collect()}
    assert [got[k]["verdict"] for k in range(6)] == ["block", "allow", "block", "allow", "allow", "block"]
    assert abs(got[3]["reputation"] - (600 + 1) / (900 + 2)) < 1e-9 and got[4]["reputation"] is None
    assert min(got[0]["reputation"], got[2]["reputation"]) > got[3]["reputation"] > got[1]["reputation"]
    assert len(got) == len(urls_of + asked)


def test_windows_that_agree_in_few_bits_are_told_apart(spark, documents, monkeypatch):
    """With four bits kept nearly all windows agree with another, which must not change a count."""
    want = divergence.base_counts(documents).select("doc_id", "n_repeat_words").collect()
    monkeypatch.setattr(divergence, "_BITS", 60)
    got = divergence.base_counts(documents).select("doc_id", "n_repeat_words").collect()
    assert sorted(got) == sorted(want) and sum(x["n_repeat_words"] for x in want) > 0


def test_sql_judges_hosts_without_labels_alike(spark, tmp_path):
    import duckdb

    from skyquill.llm import oracle

    pages = [(i, f"http://h{i % 9}.spam.com/p") for i in range(300)] + [(i, f"http://www{i % 5}.fine.org/") for i in range(300, 400)]
    pages += [(400, "http://new.spam.com/x"), (401, "http://new.fine.org/"), (402, "http://other.com/"), (403, "nothing"), (404, None), (405, "http://a.example/")]
    for n, labels in enumerate(([(i, 0 if i < 300 else 1, 0) for i in range(400)], [], [(1, None, 0)])):
        spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/{n}/pages.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{n}/labels.parquet")
        got = queries.op5_url_reputation(spark, f"{tmp_path}/{n}").toPandas()
        con = duckdb.connect()
        for table in ("pages", "labels"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{n}/{table}.parquet/*.parquet'")
        want = con.execute(oracle.URLS).df()
        key = lambda frame: sorted(map(tuple, frame[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(lambda x: x.notna(), None).values.tolist()))
        assert key(got) == key(want)
        assert n or got.set_index("page_id")["verdict"][400] == "block"
