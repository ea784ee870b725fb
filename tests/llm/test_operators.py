"""Operators against brute force, exact round trips and held-out accuracy on small tables."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import bpe, html_text, licenses, media, mixing, ngram_join, queries, quality, rules, suffix_dedup, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "a", "x"), (2, "", None, "x"), (3, "Don't\tstop 日本 🎉\n\n  x\x85y", "a", None), (3, "Don't\tstop 日本 🎉\n\n  x\x85y", "a", None), (None, "the the the the " * 40, "b", "x"), (4, "word " * 3000, "b", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, n_words string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_bpe_round_trip(odd, docs):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.tokenizer()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for df in (odd.withColumn("t", F.col("text")), docs.withColumn("t", F.col("text")), odd.limit(0).withColumn("t", F.col("text"))):
        for r in bpe.encode(df, path, pattern, back=True).collect():
            assert list(r.ids) == own.encode_ordinary(r.t or "")
            assert bytes(r.decoded) == (r.t or "").encode()


def test_license_places(spark, odd):
    text = "x GNU General public-license y\nReleased under the MIT License.\nmit  license"
    rows = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].phrase_labels) == (3, 1, 11, ["gpl", "mit"])
    assert "mit-notice" in rows[1].template_labels
    assert (rows[2].n_words, rows[2].n_base, rows[2].first_word, rows[2].score) == (0, 0, None, 0.0)
    assert licenses.scan(odd).count() == len(ODD)


def test_media_is_lossless(odd):
    for r in media.read(media.store(odd.withColumn("t", F.col("text")))).collect():
        raw = (r.t or "").encode()
        assert bytes(r.payload) == raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert r.n_bytes == len(raw)


def test_classifiers(spark, odd):
    d = "/root/testdata/sf0.01"
    found = queries.op4(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert found.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.97
    found = queries.op5(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert found.where("toxic = 0").agg(F.avg("predicted")).first()[0] < 0.05
    assert toxicity.score(odd, None).agg(F.max("score")).first()[0] == 0
    model = quality.train(odd.limit(0), odd.select("doc_id", F.lit(1).alias("quality")))
    assert quality.score(odd, model).count() == len(ODD)


@pytest.mark.parametrize("sizes", [(24, 1536, 48), (3, 8, 2)])
def test_ngram_components(spark, monkeypatch, sizes):
    """With production sizes, and with small ones, so that groups of this table are large and hot."""
    for name, value in zip(("SMALL", "BLOCK", "HOT"), sizes, strict=True):
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(60, 300))] for _ in range(6)]
    rows = []
    for i in range(200):
        own = list(rnd.choice(base[:2] if i % 2 else base)) if i % 3 else [rnd.choice(words) for _ in range(rnd.randrange(1, 200))] + base[0][:60]
        for _ in range(rnd.randrange(0, 9)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(None, rows[1][1]), (7, rows[1][1].upper()), (900, None), (901, ""), (902, "one two"), (903, "ONE  two\n")]
    sets = []
    for _, t in rows:
        w = [x.lower() for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))
    got = collections.Counter(tuple(r) for r in ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == want


def test_rules_counts(odd, docs):
    for r in rules.base_counts(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))).collect():
        w = WORD.findall(r.text or "")
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(covered))


def test_html(spark):
    page = "<body><nav>menu</nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four</article><footer>x</footer>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert [r.text for r in html_text.extract_text(rows).orderBy("page_id").collect()] == ["A & B\none two three\nfour", "", ""]


def test_suffix_removal(spark):
    rnd = random.Random(3)
    parts = ["x" * 300, "ab" * 200, " " * 120 + "y" * 60] + ["".join(rnd.choice("abcde é") for _ in range(90)) for _ in range(5)]
    rows = [(i, "".join(rnd.choice(parts)[rnd.randrange(20) : rnd.randrange(40, 130)] + "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(60))) for _ in range(rnd.randrange(6)))) for i in range(60)]
    rows += [(None, rows[3][1]), (5, rows[7][1]), (5, rows[7][1]), (500, None), (501, "")]
    order = [(d if d is not None else 2**63, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in order:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    want = []
    for (d, _), (k, b) in zip(rows, order, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        want.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_text=False).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_mixing(docs, odd):
    rows = mixing.plan(docs).collect()
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(mixing.plan(docs).collect())]
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 3
    for source, target, size in {(r.source, r.target, r.source_size) for r in rows}:
        assert target <= 3 * size + 1e-6 and abs(taken[source] - target) <= max(r.size for r in rows if r.source == source)
    assert abs(sum(t for _, t, _ in {(r.source, r.target, r.source_size) for r in rows}) - sum(r.size for r in rows)) < 1e-3
    assert mixing.plan(odd).count() == len(ODD) and mixing.plan(odd.limit(0)).count() == 0
