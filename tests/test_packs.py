"""Packs take from all that is found and from groups of any size, as brute force does."""

import random

from mnemospark.operators import reports

KINDS = ["bookmark", "note", "reference", "social_post"]


def tables(spark, seed):
    rnd = random.Random(seed)
    kind = {i: rnd.choice(KINDS) for i in range(300)}
    keys = sorted({(i, f"g{rnd.choice([0, 0, 0, 1, 2, 2, 3])}") for i in range(300)} | {(i, "h") for i in range(0, 300, 9)})
    words = [(q, i, rank) for q in "ab" for rank, i in enumerate(rnd.sample(range(300), 220))]
    registry = spark.createDataFrame([(i, k, 20 + i % 90) for i, k in kind.items()], "item long, kind string, cost long")
    return kind, keys, words, registry, spark.createDataFrame(words, "query_id string, item long, rank int"), spark.createDataFrame(keys, "item long, key string")


def shared(keys, seeds, others):
    """item: the least rank of the seeds it shares a key with."""
    near = {}
    for s, rank in seeds:
        own = {k for i, k in keys if i == s}
        for i in {i for i, k in keys if k in own and i != s and i in others}:
            near[i] = min(near.get(i, rank), rank)
    return near


def test_packs_of_large_groups_and_long_lists(spark):
    for seed in range(2):
        kind, keys, words, registry, listed, groups = tables(spark, seed)
        want, wanted = [], []
        for q in "ab":
            own = [i for query, i, _ in words if query == q]
            rank = {i: r for r, i in enumerate(own)}
            note, proof = [i for i in own if kind[i] == "note"][:5], [i for i in own if kind[i] in ("reference", "bookmark")][:5]
            near = shared(keys, [(i, rank[i]) for i in note + proof], set(kind) - set(note + proof))
            linked = sorted(near, key=lambda i: (near[i], i))[:5]
            want += [(q, b, i, n + 1) for b, items in (("vision", note), ("evidence", proof), ("linked", linked)) for n, i in enumerate(items)]
            vision, direct = [i for i in own if kind[i] in ("note", "social_post")][:2], proof[:2]
            near = shared(keys, [(i, r) for r, i in enumerate(vision) if kind[i] == "social_post"], {i for i, k in kind.items() if k in ("reference", "bookmark")})
            more = sorted((i for i in near if i not in direct), key=lambda i: (near[i], i))
            past = [i for i in own if i % 3 and i not in vision + direct and i not in near][:2]
            wanted += [(q, b, i) for b, items in (("vision", vision), ("evidence", (direct + more)[:2]), ("past_discussion", past)) for i in items]
        got = reports.context_pack(listed.join(registry, "item"), groups, [("vision", ["note"]), ("evidence", ["reference", "bookmark"])], 5).collect()
        assert sorted(map(tuple, got)) == sorted(want) and sum(r.bucket == "linked" for r in got) == 10
        past = listed.where("item % 3 > 0")
        got = reports.budget_pack(listed, registry, groups, past, ["note", "social_post"], ["reference", "bookmark"], ["social_post"], 900).collect()
        assert sorted((r.query_id, r.bucket, r.item) for r in got) == sorted(wanted)


def test_evidence_that_is_short_comes_from_a_large_group(spark):
    registry = spark.createDataFrame([(i, "social_post" if i == 0 else "reference", 10) for i in range(200)], "item long, kind string, cost long")
    groups = spark.createDataFrame([(i, "one folder") for i in range(200)], "item long, key string")
    words = spark.createDataFrame([("q", 0, 1)], "query_id string, item long, rank int")
    got = reports.budget_pack(words, registry, groups, words.limit(0), ["note", "social_post"], ["reference"], ["social_post"], 900).collect()
    assert [(r.bucket, r.item) for r in sorted(got, key=lambda r: r.item)] == [("vision", 0), ("evidence", 1), ("evidence", 2)]


def test_notes_far_down_a_list(spark):
    """Each bucket has its best items of all that is found, however many of other kinds stand before them."""
    from mnemospark.plans import retrieval

    data = "/root/testdata/sf0.01"
    most = {r.query_id: r["count"] for r in retrieval.q_items(spark, data).groupBy("query_id").count().collect()}
    assert max(most.values()) > retrieval.LISTED
    registry = spark.read.parquet(f"{data}/documents.parquet").selectExpr("doc_id AS item", "'x' AS kind")
    _, found = retrieval._found(spark, data, registry)
    assert found.groupBy("query_id").count().agg({"count": "max"}).first()[0] == max(most.values())
