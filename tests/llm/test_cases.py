"""Cases that single operators must get right: odd rows, empty tables, long texts, clashing names, adversarial input."""

import collections
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemospark.llm import bpe, html_text, licenses, media, mixing, ngram_join, quality, queries, rules, suffix_dedup, toxicity
from mnemospark.llm.common import word_hashes

NAMES = ["kept", "tail", "expected_grade", "table", "words", "hashes", "text2", "_w", "key", "score", "feature", "payload", "pictures", "ids", "n_words", "label", "copies"]
LONG = " ".join(f"w{i % 9973}" for i in range(40_000)) + "\n" + "x" * 30_000
ROWS = [(1, None, "a"), (2, "", None), (3, "same text again and again", "a"), (3, "same text again and again", "a"), (None, "no id", "b"), (4, LONG, "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in NAMES})


def operators(spark, docs):
    """Each operator over the given rows, by name."""
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    path, pattern = queries.tokenizer()
    yield "bpe", bpe.decode(bpe.encode(docs, path, pattern), path)
    yield "licenses", licenses.scan(docs)
    yield "media", media.read(media.store(docs))
    yield "quality", quality.score(docs, quality.train(docs, labels))
    yield "toxicity", toxicity.score(docs, toxicity.train(docs, labels))
    yield "join", ngram_join.join_components(docs)
    yield "rules", rules.judge(docs, rules.ratios(docs, labels.select("doc_id")))
    yield "html", html_text.extract_text(docs.withColumnRenamed("text", "html"))
    yield "dedup", suffix_dedup.remove_repeats(docs)
    yield "mixing", mixing.plan(docs)


def test_odd_rows_and_names(spark, odd):
    for name, found in operators(spark, odd):
        assert found.count() == len(ROWS), name
    for name, found in operators(spark, odd.limit(0)):
        assert found.count() == 0, name


def test_stages_keep_columns(spark, odd, tmp_path):
    labels = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, rows, str(tmp_path))
            assert found.columns == docs.columns, name
            assert found.where("kept <> 'mine' OR key <> 'mine' OR copies <> 'mine'").count() == 0, name
            assert rows is docs or found.count() == 0


def test_word_hash():
    def morse(n, start):
        return "".join("ab"[(bin(i).count("1") + start) % 2] for i in range(n))

    words = [morse(1024, 0), morse(1024, 1), "a", "aa", "", "a" * 8, "a" * 9, "b" + "a" * 8]
    ends = np.cumsum([len(w) for w in words])
    found = word_hashes(np.frombuffer("".join(words).encode(), np.uint8), ends - [len(w) for w in words], ends)
    assert len(set(found.tolist())) == len(words)


def test_different_words_do_not_link(spark):
    def morse(n, start):
        return "".join("ab"[(bin(i).count("1") + start) % 2] for i in range(n))

    rows = spark.createDataFrame([(1, morse(1024, 0)), (2, morse(1024, 1))], "doc_id long, text string")
    assert sorted(r.component_id for r in ngram_join.join_components(rows).collect()) == [1, 2]


def test_long_pieces():
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = queries.tokenizer()
    ranks = bpe.load_ranks(path)
    own, coder, rnd = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.Coder(ranks), random.Random(1)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16_000)), "ab" * 5000, "=" * 777 + "-" * 1000, "abcdefg" * 900, "日本語テスト漢字" * 400, "".join(rnd.choice(["the", "ing", "ab" * 40, "x" * 90]) for _ in range(200))]
    ids, starts = coder.encode(texts, pattern)
    for i, text in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == own.encode_ordinary(text)


def test_wrapped_notice(spark):
    grant = "Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software\n * and associated documentation files"
    filler = "some other words of a text that has nothing to do with it " * 30
    rows = spark.createDataFrame([(1, filler + grant + " " + filler), (2, filler)], "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert found[1].template_labels == ["mit-grant"] and found[1].score == 1.0
    assert found[2].template_labels == [] and found[2].score == 0.0


def _foreign(values: np.ndarray, seed: int) -> tuple[bytes, np.ndarray]:
    """A picture with three components (the first sampled twice each way), AC coefficients and codes of nine bits."""
    rnd = random.Random(seed)
    high, wide = values.shape  # of DC values of the first component's blocks, both even
    out = []

    def put(value, bits):
        out.append(format(value, f"0{bits}b") if bits else "")

    def block(diff):
        size = abs(int(diff)).bit_length()
        put(size, 9)
        put(diff if diff >= 0 else diff + (1 << size) - 1, size)
        for _ in range(rnd.randrange(4)):
            put(0x12, 9)  # one zero, then two bits
            put(rnd.choice([2, 3, 0, 1]), 2)
        put(0, 9)

    last = [0, 0, 0]
    for y in range(0, high, 2):
        for x in range(0, wide, 2):
            for v in (values[y, x], values[y, x + 1], values[y + 1, x], values[y + 1, x + 1]):
                block(int(v) - last[0])
                last[0] = int(v)
            for k in (1, 2):
                v = rnd.randrange(-40, 40)
                block(v - last[k])
                last[k] = v
    bits = "".join(out)
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    codes = bytes([0] * 8 + [255] + [0] * 7) + bytes(range(255))
    segment = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + bytes([16]) + bytes([9] * 63)) + segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + b"\1\x22\0\2\x11\0\3\x11\0")
    head += segment(0xC4, b"\0" + codes) + segment(0xC4, b"\x10" + codes) + segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0")
    return head + data + b"\xff\xd9", np.clip((values * 16 + 4) // 8 + 128, 0, 255).astype(np.uint8)


def test_foreign_and_broken_pictures(spark):
    pictures = [_foreign(np.random.default_rng(i).integers(-60, 60, (4, 6)), i) for i in range(3)]
    several = pictures[0][0] + pictures[1][0]
    broken = [b"not a jpeg at all", b"\xff\xd8\xff", pictures[2][0][:200], None, b""]
    rows = spark.createDataFrame(list(enumerate([p for p, _ in pictures] + [several] + broken)), "id int, media binary")
    found = {r.id: r for r in media.read(rows).collect()}
    for i, (_, want) in enumerate(pictures):
        assert bytes(found[i].payload) == want.tobytes()
        assert [(p.width, p.height) for p in found[i].pictures] == [(48, 32)]
    assert bytes(found[3].payload) == pictures[0][1].tobytes() + pictures[1][1].tobytes() and len(found[3].pictures) == 2
    assert all(found[4 + i].payload is None and found[4 + i].pictures == [] for i in range(len(broken)))


def test_three_grades(spark):
    rnd = random.Random(2)
    words = [["alpha", "bravo", "carol"], ["delta", "early", "fancy"], ["gamma", "hotel", "india"]]
    rows = [(i, " ".join(rnd.choice(words[g] if rnd.random() < 0.8 else words[rnd.randrange(3)]) for _ in range(60)), g) for i in range(600) for g in (i % 3,)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality.train(docs, docs.where("doc_id < 400"), grade="grade")
    assert model["grades"] == [0, 1, 2] and model["cuts"][0] < model["cuts"][1]
    held = quality.score(docs, model, target=1).where("doc_id >= 400").collect()
    assert np.mean([round(r.expected_grade) == r.grade for r in held]) > 0.9
    assert np.mean([(r.tail > 0.5) == (r.grade >= 1) for r in held]) > 0.9


def test_positive_unlabelled():
    rnd = np.random.default_rng(3)
    text = lambda toxic: np.unique(np.concatenate([rnd.integers(0, 3000, 40), rnd.integers(3000, 3060, 6 if toxic else 0)]))
    positive, hidden, clean = ([text(t) for _ in range(n)] for t, n in ((True, 300), (True, 120), (False, 880)))
    prior = toxicity.estimate_prior(positive, hidden + clean)
    assert 0.08 < prior < 0.18
    weights, bias = toxicity.fit(positive, hidden + clean, prior)
    score = lambda rows: np.array([weights[r].sum() + bias for r in rows])
    assert (score([text(True) for _ in range(200)]) > 0).mean() > 0.9 and (score([text(False) for _ in range(200)]) > 0).mean() < 0.05


def test_llr_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    good = docs.where("doc_id % 3 = 0").select("doc_id")
    ours = {r.doc_id: r for r in rules.judge(docs, rules.ratios(docs, good)).collect()}
    hashed = {r.doc_id: r.b for r in docs.select("doc_id", F.transform(rules.words_of(F.col("text")), lambda w: F.pmod(F.xxhash64(w), F.lit(rules.BUCKETS))).alias("b")).collect()}
    raw, trusted = collections.Counter(), collections.Counter()
    for i, b in hashed.items():
        raw.update(b)
        if i % 3 == 0:
            trusted.update(b)
    share = lambda c, x: (c[x] + rules.SMOOTHING) / (c.total() + rules.SMOOTHING * rules.BUCKETS)
    for i, b in hashed.items():
        want = sum(math.log(share(trusted, x) / share(raw, x)) for x in b) / max(len(b), 1)
        assert abs(ours[i].llr - want) < 1e-9
        assert ours[i].kept == (not ours[i].base_failed and ours[i].llr >= rules.THRESHOLD)


PROSE = "Some long prose sentence that goes on with enough words to look like the content of a page, really. "
PAGES = [
    ("<nav><ul><li><a href=x>Home</a></ul></nav><article><header class='entry-header'><h1>Title</h1></header><p>A {0}</p><p>B {0}</p></article><footer>c</footer>", "Title\nA {0}\nB {0}"),
    ("<article><h1>T</h1><p>{0}</p><div class='share-price'>S {0}</div></article>", "T\n{0}\nS {0}"),
    ("<article><h1>T</h1><p>{0}</p><section class='related-work'><h2>Related work</h2><p>R {0}</p></section></article>", "T\n{0}\nRelated work\nR {0}"),
    ("<main><article><h1>T</h1><p>{0}</p></article></main><article class='related-card'><a href=q>Read this other story now</a></article>", "T\n{0}"),
    ("<div><a href=1>Home</a> <a href=2>About us</a></div><div><h1>Head</h1><p>A {0}</p><p>Short.</p><p>B {0}</p></div><div><a href=1>Imprint</a> | <a href=3>Contact the editors</a></div>", "Head\nA {0}\nShort.\nB {0}"),
    ("<article><p>{0}</p></article><section id='comments'><article class='comment'><p>C {0}</p></article></section>", "{0}"),
    ("<article><p>A {0}</p><ul><li>One<li>Two<li>Three<li>Four<li>Five</ul><p>B {0}</p></article>", "A {0}\nOne\nTwo\nThree\nFour\nFive\nB {0}"),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_regions(page, want):
    prose = (PROSE * 3).strip()
    assert html_text.extract(f"<html><body>{page.format(prose)}</body></html>") == want.format(prose)


def test_clusters_decide():
    """A line that is prose by its ratio is content, and one of the same place that is not is none."""
    lines = [html_text.Line(t, n, 0, 0, False, False) for t, n in (("menu", 9), ("x", 8), ("y", 9), ("z", 9), (PROSE * 3, 2), (PROSE * 2, 2), ("a", 9), ("b", 9), ("c", 9), ("d", 9))]
    assert html_text.regions(lines).tolist()[4:6] == [True, True] and not html_text.regions(lines)[[0, 1, 8, 9]].any()
    ratio = html_text.ratios(lines)
    kernel = lambda d: math.exp(-0.5 * (d / html_text.SIGMA) ** 2) if abs(d) <= 3 * html_text.SIGMA else 0
    want = [sum(kernel(i - j) * r for j, r in enumerate(ratio)) / sum(kernel(i - j) for j in range(len(ratio))) for i in range(len(ratio))]
    assert np.allclose(html_text.smoothed(ratio), want)


def test_sort_passes(monkeypatch):
    rnd = np.random.default_rng(5)
    data = rnd.integers(97, 100, 4000).astype(np.uint8)
    data[2000:3000] = data[:1000]
    starts, n = np.arange(0, 3900, 60), np.full(65, 35)
    doc = rnd.permutation(65)
    want = suffix_dedup.first_documents(data, starts, n, doc)
    monkeypatch.setattr(suffix_dedup, "SORT_WINDOWS", 100)
    assert (suffix_dedup.first_documents(data, starts, n, doc) == want).all()
    first = {}
    for s, k, d in zip(starts, n, doc, strict=True):
        for i in range(s, s + k):
            w = data[i : i + 50].tobytes()
            first[w] = min(first.get(w, d), d)
    assert want.tolist() == [first[data[i : i + 50].tobytes()] for s, k in zip(starts, n, strict=True) for i in range(s, s + k)]
