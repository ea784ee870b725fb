"""Registered queries of search and recall, each with the SQL that gives the same rows.

Documents in chunks stand for items with text, embeddings for vectors of the items of the same id. The query set is every
vector whose id is divisible by 20: its own numbers, and a word of the document of the same id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions import text
from mnemospark.operators import approximate, items, refresh, reports, search
from mnemospark.plans.archive import _ITEMS, _THREADS, _items, _threads, _versions
from mnemospark.plans.queries import _CUT, _messages, _queries, _read, _units
from mnemospark.session import kept, scratch, ship

#: Items of each list that a hybrid search fuses, and how many chunks a semantic search looks at.
LISTED, POOL = 100, 100
_WORD = "[a-z]{4,7}"


def _chunks(spark, d) -> DataFrame:
    """Chunks of all documents, cut whenever they are read: a search reads them for hits, and once more for their lengths."""
    ship(spark)
    found = text.chunks(_read(spark, d, "documents"), "text", ["doc_id"])
    return found.select((F.col("doc_id") * 1000 + F.col("idx")).alias("unit_id"), F.col("doc_id").alias("item"), F.col("chunk").alias("text"))


def _asked(spark, d) -> DataFrame:
    """query_id, q, qv."""
    vectors = _read(spark, d, "embeddings").where("vec_id % 20 = 0")
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.regexp_extract(F.lower("text"), _WORD, 0).alias("q"))
    return vectors.join(docs, "vec_id").where("q <> ''").select(F.col("vec_id").alias("query_id"), "q", F.col("embedding").alias("qv"))


def _vectors(spark, d) -> DataFrame:
    return _read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), F.col("vec_id").alias("item"), F.expr("vec_id div 5").alias("fifth"), "label")


def _words(spark, d, most=LISTED) -> DataFrame:
    return kept(search.lists(_chunks(spark, d), _asked(spark, d), F.expr("unit_id div 1000"), most).select("query_id", "item", "rank"), "words")


def _near(spark, d) -> DataFrame:
    return kept(search.semantic(_vectors(spark, d), _asked(spark, d).select("query_id", "qv"), POOL, "item").select("query_id", "item", "rank"), "near")


_CHUNKS = f"chunks AS (WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS idx, 0 AS s, {_CUT.format(s='0')} AS e FROM documents WHERE regexp_matches(text, '\\S') UNION ALL SELECT doc_id, text, idx + 1, e - 200, {_CUT.format(s='(e - 200)')} FROM c WHERE e < length(text)) SELECT doc_id * 1000 + idx AS unit_id, doc_id AS item, substring(text, s + 1, e - s) AS text FROM c)"
_ASKED = f"asked AS (SELECT vec_id AS query_id, regexp_extract(lower(text), '{_WORD}', 0) AS q, embedding AS qv FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0 AND q <> '')"
_HITS = f"""{_CHUNKS}, {_ASKED}, units AS (SELECT unit_id, item, lower(text) AS t, greatest(length(text) - 2, 0) AS dl FROM chunks),
found AS (SELECT query_id, unit_id, item, (length(t) - length(replace(t, q, ''))) / length(q) AS tf, dl FROM units JOIN asked ON contains(t, q)),
freq AS (SELECT query_id, count(*) AS df FROM found GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM units),
hits AS (SELECT query_id, unit_id, item, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM found JOIN freq USING (query_id), stats),
best AS (SELECT *, count(*) OVER (PARTITION BY query_id, item) AS hit_count FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, item ORDER BY score, unit_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item) AS rank FROM best),
words AS (SELECT query_id, item, rank FROM ranked WHERE rank <= {LISTED})"""
_NEAR = f"""pairs AS (SELECT query_id, vec_id, vec_id // 5 AS fifth, label, round(list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]), 6) AS score FROM embeddings, asked),
pool AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {POOL}),
near AS (SELECT query_id, vec_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pool)"""
_LISTS = f"WITH {_HITS}, {_NEAR}, lists AS (SELECT *, 0 AS list FROM words UNION ALL SELECT *, 1 FROM near)"
_FUSED = "SELECT query_id, item, round(sum(1 / (60 + rank)), 8) AS score, CASE WHEN count(*) = 2 THEN 'both' WHEN min(list) = 0 THEN 'keyword' ELSE 'semantic' END AS match_reason FROM lists GROUP BY ALL"


def q_items(spark, d):
    return search.lists(_chunks(spark, d), _asked(spark, d), F.expr("unit_id div 1000"))


#: Where the postings of a table stand, by application and table: written once, read by all queries that follow.
_STORED: dict[tuple[str, str], str] = {}


def stored_index(spark, d, units: DataFrame, name: str) -> str:
    key = (spark.sparkContext.applicationId, f"{d}/{name}")
    if key not in _STORED:
        path = scratch(spark, f"index-{name}")
        search.store_index(units, path)
        _STORED[key] = path
    return _STORED[key]


def q_index(spark, d):
    """Postings of the asked terms' grams, from the stored index."""
    path = stored_index(spark, d, _units(spark, d), "turns")
    index = search.read_index(spark, path, search.terms(_queries(spark)))
    asked = search.terms(_queries(spark)).select(F.explode(search.grams(F.col("term"))).alias("gram")).distinct()
    return index.join(asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n_units"))


def q_stored_search(spark, d):
    path = stored_index(spark, d, _units(spark, d), "turns")
    index = search.read_index(spark, path, search.terms(_queries(spark)))
    return search.keyword(_units(spark, d), _queries(spark), index).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 4).alias("best"))


def q_index_counts(spark, d):
    """Units of the index against units with text long enough to be in it."""
    path = stored_index(spark, d, _units(spark, d), "turns")
    held = search.indexed(spark, path).select(F.explode("ids").alias("unit_id")).agg(F.count_distinct("unit_id").alias("n")).select(F.lit("index").alias("side"), "n")
    return held.unionAll(_units(spark, d).where("length(text) >= 3").agg(F.count("*").alias("n")).select(F.lit("units"), "n"))


def q_semantic(spark, d):
    found = search.semantic(_vectors(spark, d), _asked(spark, d).select("query_id", "qv"), POOL, "fifth")
    return found.select("query_id", "item", "vec_id", "score", "hit_count", "rank")


def q_item_page(spark, d):
    found = search.semantic(_vectors(spark, d), _asked(spark, d).select("query_id", "qv"), search.over_fetch(10), "fifth")
    return found.where("rank <= 10").select("query_id", "item", "score", "rank")


def q_approximate(spark, d):
    vectors, queries = _vectors(spark, d).select("vec_id", "v"), _read(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return approximate.nearest_by_codes(vectors, queries, 10, approximate.fit(vectors), rerank=40)


def q_hybrid(spark, d):
    return search.hybrid(_words(spark, d), _near(spark, d))


def q_modes(spark, d):
    words, near = _words(spark, d), _near(spark, d)
    every = None
    for mode in search.MODES:
        one = search.search(mode, words, near).select(F.lit(mode).alias("mode"), "query_id", "item", "score", "match_reason")
        every = one if every is None else every.unionAll(one)
    return every


def q_merged(spark, d):
    """Lists of threads and of items for the same words, fused."""
    asked = _asked(spark, d).select("query_id", "q")
    turns = search.lists(_units(spark, d), asked, F.expr("unit_id div 1000"), LISTED)
    threads = turns.select("query_id", (-F.col("item") - 1).alias("item"), "rank")
    return search.merged(threads, _words(spark, d))


def q_by_date(spark, d):
    asked = spark.createDataFrame([(1, "é"), (2, "ch q")], "query_id int, q string")
    turns = search.short_terms(_units(spark, d), asked).select("query_id", F.expr("unit_id div 1000").alias("conv_id")).distinct()
    threads = turns.join(_threads(spark, d).select("conv_id", "updated_at"), "conv_id").select("query_id", F.concat(F.lit("thread:"), F.col("conv_id").cast("string")).alias("item"), "updated_at")
    found = search.short_terms(_read(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text"), asked)
    own = found.join(_items(spark, d).select(F.col("item_id").alias("unit_id"), "updated_at"), "unit_id").select("query_id", F.concat(F.lit("item:"), F.col("unit_id").cast("string")).alias("item"), "updated_at")
    return search.by_date(threads, own, "updated_at").where("place <= 200")


_CUTOFF, _GROUPS = "2024-10-01", 5


def _related(spark, d) -> DataFrame:
    """Items from before the cutoff, by the lists of several queries, five to a group."""
    old = _items(spark, d).where(F.col("updated_at") <= F.lit(_CUTOFF).cast("date")).select(F.col("item_id").alias("item"), "source")
    found = search.lists(_chunks(spark, d).join(old, "item", "left_semi"), _asked(spark, d), F.expr("unit_id div 1000"), 20)
    lists = found.select("query_id", "item", "rank").join(old, "item")
    return search.related(lists.withColumn("group", F.expr(f"query_id div 20 % {_GROUPS}")), 8)


def q_related(spark, d):
    return _related(spark, d)


def q_digest(spark, d):
    """What is related, without this week's own items."""
    own = _items(spark, d).where("item_id % 3 = 0").select(F.col("item_id").alias("item"))
    return _related(spark, d).join(own, "item", "left_anti").select("group", "item", "reason")


def q_titles(spark, d):
    first = _messages(spark, d).where("turn = 0").select("conv_id", F.left("text", F.lit(40)).alias("title"))
    return reports.title_queries(first, "conv_id")


def _found(spark, d, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """q, query_id of all queries; and for each text asked for all items that hold it, with what the registry says of them.

    The second: query_id (the text), item, rank (the best score, then the item), and the registry's columns.
    """
    asked = kept(_asked(spark, d).select("query_id", "q"), "asked")
    hits = search.keyword(_chunks(spark, d), asked.select(F.col("q").alias("query_id"), "q").distinct()).withColumn("item", F.expr("unit_id div 1000"))
    best = hits.groupBy("query_id", "item").agg(F.min("score").alias("score")).select("query_id", "item", F.struct("score", "item").alias("rank"))
    return asked.withColumnRenamed("q", "_q"), kept(best.join(registry, "item"), "found")


def _of_all(asked: DataFrame, packs: DataFrame) -> DataFrame:
    """The packs of texts, for each query of its text."""
    return packs.withColumnRenamed("query_id", "_q").join(asked, "_q").drop("_q")


def q_pack(spark, d):
    """For each query: notes, then references, then one-hop links of these, each item in its first bucket, five a bucket."""
    registry = _items(spark, d).select(F.col("item_id").alias("item"), "kind", "folder")
    asked, found = _found(spark, d, registry)
    packs = reports.context_pack(found, registry.select("item", F.col("folder").alias("key")), [("vision", ["note"]), ("evidence", ["reference", "bookmark"])], 5)
    return _of_all(asked, packs).select("query_id", "bucket", "item", "place")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hash_vector(texts: pd.Series) -> pd.Series:
    """A deterministic encoder for tests: eight bytes of a digest."""
    from hashlib import md5

    return texts.map(lambda t: [b / 255 for b in md5((t or "").encode()).digest()[:8]])


def q_embedded(spark, d):
    ship(spark)
    units = _read(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    stored = units.where("unit_id % 3 > 0").select("unit_id", F.lit("hash").alias("provider"), F.when(F.col("unit_id") % 2 == 0, "v2").otherwise("v1").alias("model"))
    found = search.embedded(units, stored, "hash", "v2", _hash_vector)
    return found.select("unit_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.size("vector").alias("size"))


def _derived(spark, d) -> dict:
    i = F.col("doc_id")
    docs = _read(spark, d, "documents")
    done = docs.where("doc_id % 5 > 0").select(i.alias("unit_id"), F.when(i % 2 == 0, "v2").otherwise("v1").alias("version"))
    vectors = docs.where("doc_id % 3 > 0").select(i.alias("unit_id"), F.lit("hash").alias("provider"), F.lit("v2").alias("model"))
    links = _read(spark, d, "pages").select(F.col("page_id").alias("item"), F.lit("host").alias("via"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("key"))
    return {"chunks": done, "version": "v2", "vectors": vectors, "model": ("hash", "v2"), "encoder": _hash_vector, "links": links}


def _counts(made: dict[str, DataFrame]) -> DataFrame:
    every = None
    for name in ("chunks", "vectors", "links"):
        one = made[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        every = one if every is None else every.unionAll(one)
    return every


def q_gaps(spark, d):
    ship(spark)
    units = _read(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    return _counts(refresh.gaps_filled(units, **_derived(spark, d)))


def q_after_import(spark, d):
    ship(spark)
    stored, fresh = _versions(spark, d)
    return _counts(refresh.after_import(items.plan(fresh, stored, "doc_id"), fresh.select("doc_id", "text"), "doc_id", **_derived(spark, d)))


#: Words that are asked for at once, and the tokens of a pack.
_THREE, _TOKENS = "[a-z]{3,7}", 900


def q_windows(spark, d):
    """Of each chunk that holds three words of the asked document, the best window."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_THREE), F.lit(0))), 1, 3)
    asked = _read(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), words.alias("terms")).where(F.size("terms") > 0)
    return reports.query_windows(_chunks(spark, d), asked).withColumn("matched", F.array_join("matched", ","))


def q_budget_pack(spark, d):
    """A pack of 900 tokens for each query: notes and posts, references and bookmarks, and items of before a date."""
    registry = _items(spark, d).select(F.col("item_id").alias("item"), "kind", F.ceil(F.least(F.length("text"), F.lit(400)) / 4).alias("cost"), "folder", "updated_at")
    asked, found = _found(spark, d, registry.select("item", "updated_at"))
    words, past = found.select("query_id", "item", "rank"), found.where(F.col("updated_at") <= F.lit(_CUTOFF).cast("date")).select("query_id", "item", "rank")
    packs = reports.budget_pack(words, registry, registry.select("item", F.col("folder").alias("key")), past, ["note", "social_post"], ["reference", "bookmark"], ["social_post"], _TOKENS)
    return _of_all(asked, packs).select("query_id", "bucket", "place", "item", "cost")


_WINDOWS = f"""WITH {_CHUNKS}, asked AS (SELECT * FROM (SELECT doc_id AS query_id, list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'i': list_position(w, x), 'x': x}}))[1:3], lambda y: y.x) AS terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_THREE}') AS w FROM documents WHERE doc_id % 20 = 0)) WHERE len(terms) > 0),
hits AS (SELECT query_id, unit_id, text, terms FROM chunks, asked WHERE len(list_filter(terms, lambda x: contains(lower(text), x))) = len(terms)),
parts AS (SELECT query_id, unit_id, term, string_split(lower(text), term) AS p FROM (SELECT *, unnest(terms) AS term FROM hits)),
places AS (SELECT query_id, unit_id, term, list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(term) AS b FROM (SELECT *, unnest(range(1, len(p))) AS i FROM parts)),
wins AS (SELECT query_id, unit_id, b, list_filter(list({{'t': term, 'e': b + length(term)}}) OVER (PARTITION BY query_id, unit_id ORDER BY b RANGE BETWEEN CURRENT ROW AND 159 FOLLOWING), lambda x: x.e <= b + 160) AS held FROM places),
scored AS (SELECT query_id, unit_id, b, list_distinct(list_transform(held, lambda x: x.t)) AS ts, held FROM wins),
best AS (SELECT query_id, unit_id, min({{'n': -len(ts), 'x': list_max(list_transform(ts, lambda t: list_min(list_transform(list_filter(held, lambda h: h.t = t), lambda h: h.e)))) - b, 'b': b}}) AS w FROM scored GROUP BY ALL),
cut AS (SELECT query_id, unit_id, text, terms, greatest(w.b - (160 - w.x) // 2, 0)::BIGINT AS low FROM hits JOIN best USING (query_id, unit_id)),
marked AS (SELECT *, regexp_replace(substring(text, low + 1, 160), '(?i)(' || array_to_string(list_transform(list_sort(list_transform(terms, lambda x: {{'n': -length(x), 'x': x}})), lambda y: y.x), '|') || ')', '[[\\1]]', 'g') AS m FROM cut)
SELECT query_id, unit_id, CASE WHEN low > 0 THEN '…' ELSE '' END || m || CASE WHEN low + 160 < length(text) THEN '…' ELSE '' END AS snippet,
  (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT regexp_extract_all(m, '\\[\\[(.+?)\\]\\]', 1) AS l)) GROUP BY x)) AS matched FROM marked"""
_ALL_HITS = _HITS.replace(f" WHERE rank <= {LISTED}", "")
_BUDGET = f"""WITH {_ITEMS}, {_ALL_HITS}, reg AS (SELECT item_id AS item, kind, ceil(least(length(text), 400) / 4)::BIGINT AS cost, folder, updated_at FROM items),
listed AS (SELECT query_id, item, rank, kind, CASE WHEN kind IN ('note', 'social_post') THEN 0 ELSE 1 END AS b FROM words JOIN reg USING (item)),
direct AS (SELECT *, row_number() OVER (PARTITION BY query_id, b ORDER BY rank, item) AS r FROM listed QUALIFY r <= 2),
near AS (SELECT query_id, o.item, 1 AS b, min(r) + 2 AS r FROM direct d JOIN reg i USING (item) JOIN reg o ON o.folder = i.folder AND o.item <> d.item WHERE b = 0 AND d.kind = 'social_post' AND o.kind IN ('reference', 'bookmark') GROUP BY ALL),
every AS (SELECT query_id, item, b, r FROM direct UNION ALL SELECT query_id, item, b, r FROM near UNION ALL SELECT query_id, item, 2, rank FROM words JOIN reg USING (item) WHERE updated_at <= DATE '{_CUTOFF}'),
firsts AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, item ORDER BY b, r) = 1),
placed AS (SELECT query_id, b, item, cost, row_number() OVER (PARTITION BY query_id, b ORDER BY r, item) AS place FROM firsts JOIN reg USING (item) QUALIFY place <= 2),
filled AS (SELECT *, sum(cost) OVER (PARTITION BY query_id, b ORDER BY place) <= {_TOKENS // 3} AS own FROM placed),
summed AS (SELECT *, sum(CASE WHEN own THEN cost ELSE 0 END) OVER (PARTITION BY query_id) AS used, sum(CASE WHEN own THEN 0 ELSE cost END) OVER (PARTITION BY query_id ORDER BY b, place) AS more FROM filled)
SELECT query_id, ['vision', 'evidence', 'past_discussion'][b + 1] AS bucket, row_number() OVER (PARTITION BY query_id, b ORDER BY place) AS place, item, cost FROM summed WHERE own OR used + more <= {_TOKENS}"""

_RELATED = f"""{_ITEMS}, old AS (SELECT item_id AS item, source FROM items WHERE updated_at <= DATE '{_CUTOFF}'),
{_HITS.replace("FROM chunks)", "FROM chunks SEMI JOIN old USING (item))").replace(f"rank <= {LISTED}", "rank <= 20")},
fused AS (SELECT query_id // 20 % {_GROUPS} AS "group", item, any_value(source) AS source, round(sum(1 / (60 + rank)), 8) AS score, arg_min(query_id, (rank, query_id)) AS reason FROM words JOIN old USING (item) GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, item) AS rank FROM fused),
spare AS (SELECT *, row_number() OVER (PARTITION BY "group", source ORDER BY rank) > 4 AS overflow FROM placed),
related AS (SELECT "group", item, source, score, reason, row_number() OVER (PARTITION BY "group" ORDER BY overflow, rank) AS place FROM spare QUALIFY place <= 8)"""
_LINKS = "links AS (SELECT DISTINCT a.page_id AS x, b.page_id AS y FROM (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages) a JOIN (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages) b USING (h) WHERE a.page_id < b.page_id AND h IN (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30))"
_CHANGED = "changed AS (SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND (doc_id % 4 = 0 OR (doc_id % 5 = 0 AND lang IS DISTINCT FROM 'xx')))"
_GRAMS = "SELECT DISTINCT substring(term, i, 3) AS gram FROM (SELECT term, unnest(range(1, length(term) - 1)) AS i FROM (VALUES ('tion'), ('the'), ('and'), ('ing'), ('that'), ('zzzqq')) v(term))"
_SPLIT = "regexp_split_to_array({}, '[\\s、。・．，:：;；,.()（）\\[\\]「」『』<>《》…!?！？/／｜|—\\-‐–]+')"

REGISTERED: dict[str, tuple] = {
    "k2_keyword_items": (q_items, f"WITH {_HITS} SELECT query_id, item, unit_id, score, hit_count, rank FROM ranked"),
    "k4_stored_postings": (q_index, f"SELECT gram, count(*) AS n_units FROM ({_GRAMS}) JOIN conversations ON contains(lower(text), gram) GROUP BY gram"),
    "k4_stored_search": (q_stored_search, None),
    "q1_index_counts": (q_index_counts, "SELECT 'index' AS side, count(*) AS n FROM conversations WHERE length(text) >= 3 UNION ALL SELECT 'units', count(*) FROM conversations WHERE length(text) >= 3"),
    "k8_semantic_items": (q_semantic, f"WITH {_ASKED}, {_NEAR}, b AS (SELECT query_id, fifth AS item, vec_id, score, count(*) OVER (PARTITION BY query_id, fifth) AS hit_count FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, fifth ORDER BY score DESC, vec_id) = 1) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM b"),
    "v2_approximate": (q_approximate, None),
    "t4_item_page": (q_item_page, f"WITH {_ASKED}, {_NEAR.replace(f'<= {POOL}', '<= 80')}, b AS (SELECT query_id, fifth AS item, max(score) AS score FROM pool GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM b QUALIFY rank <= 10"),
    "k9_hybrid": (q_hybrid, f"{_LISTS} {_FUSED}"),
    "k10_search_modes": (q_modes, f"{_LISTS} SELECT 'hybrid' AS mode, * FROM ({_FUSED}) UNION ALL SELECT CASE list WHEN 0 THEN 'keyword' ELSE 'semantic' END AS mode, query_id, item, round(1 / (60 + rank), 8), mode FROM lists"),
    "k7_merged_lists": (q_merged, f"WITH {_HITS}, turns AS (SELECT conv_id, conv_id * 1000 + turn AS unit_id, lower(text) AS t, greatest(length(text) - 2, 0) AS dl FROM conversations), f2 AS (SELECT query_id, unit_id, conv_id, (length(t) - length(replace(t, q, ''))) / length(q) AS tf, dl FROM turns JOIN asked ON contains(t, q)), d2 AS (SELECT query_id, count(*) AS df FROM f2 GROUP BY ALL), s2 AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM turns), h2 AS (SELECT query_id, unit_id, conv_id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM f2 JOIN d2 USING (query_id), s2), b2 AS (SELECT query_id, conv_id, min(score) AS score FROM h2 GROUP BY ALL), r2 AS (SELECT query_id, -conv_id - 1 AS item, row_number() OVER (PARTITION BY query_id ORDER BY score, conv_id) AS rank FROM b2 QUALIFY rank <= {LISTED}) SELECT query_id, item, round(sum(1 / (60 + rank)), 8) AS score FROM (SELECT * FROM r2 UNION ALL SELECT * FROM words) GROUP BY ALL"),
    "k7_short_by_date": (q_by_date, f"WITH {_ITEMS}, {_THREADS}, f AS (SELECT DISTINCT 1 AS query_id, 'thread:' || conv_id AS item, conv_id FROM conversations WHERE contains(lower(text), 'é') UNION ALL SELECT DISTINCT 2, 'thread:' || conv_id, conv_id FROM conversations WHERE contains(lower(text), 'ch') AND contains(lower(text), 'q')), e AS (SELECT query_id, item, updated_at FROM f JOIN threads USING (conv_id) UNION ALL SELECT 1, 'item:' || item_id, updated_at FROM items WHERE contains(lower(text), 'é') UNION ALL SELECT 2, 'item:' || item_id, updated_at FROM items WHERE contains(lower(text), 'ch') AND contains(lower(text), 'q')) SELECT query_id, item, updated_at, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC NULLS LAST, item) AS place FROM e QUALIFY place <= 200"),
    "r1_related": (q_related, f"WITH {_RELATED} SELECT * FROM related"),
    "r4_digest": (q_digest, f'WITH {_RELATED} SELECT "group", item, reason FROM related WHERE item % 3 <> 0'),
    "r3_title_queries": (q_titles, None),
    "r5_context_pack": (q_pack, f"""WITH {_ITEMS}, {_ALL_HITS}, w AS (SELECT query_id, item, rank, kind FROM words JOIN items ON item_id = item),
direct AS (SELECT query_id, item, rank, CASE WHEN kind = 'note' THEN 0 ELSE 1 END AS bucket FROM w WHERE kind IN ('note', 'reference', 'bookmark')),
picked AS (SELECT * FROM direct QUALIFY row_number() OVER (PARTITION BY query_id, bucket ORDER BY rank) <= 5),
linked AS (SELECT query_id, o.item_id AS item, min(rank) AS rank, 2 AS bucket FROM picked JOIN items i ON i.item_id = item JOIN items o ON o.folder = i.folder AND o.item_id <> i.item_id GROUP BY ALL),
every AS (SELECT * FROM picked UNION ALL SELECT * FROM linked ANTI JOIN picked USING (query_id, item)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY rank, item) AS place FROM every)
SELECT query_id, ['vision', 'evidence', 'linked'][bucket + 1] AS bucket, item, place FROM placed WHERE place <= 5"""),
    "k6_best_windows": (q_windows, _WINDOWS),
    "r5_budget_pack": (q_budget_pack, _BUDGET),
    "m12_gaps_filled": (q_gaps, f"WITH {_CHUNKS}, {_LINKS} SELECT 'chunks' AS part, count(*) AS n FROM chunks WHERE item % 2 <> 0 OR item % 5 = 0 UNION ALL SELECT 'vectors', count(*) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'links', count(*) FROM links"),
    "m17_after_import": (q_after_import, f"WITH {_CHUNKS}, {_LINKS}, {_CHANGED} SELECT 'chunks' AS part, count(*) AS n FROM chunks WHERE item IN (SELECT doc_id FROM changed) UNION ALL SELECT 'vectors', count(*) FROM changed UNION ALL SELECT 'links', count(*) FROM links"),
    "v3_embedded": (q_embedded, "SELECT doc_id AS unit_id, round(('0x' || left(md5(text), 2))::INTEGER / 255, 6) AS first, 8 AS size FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 <> 0"),
}
