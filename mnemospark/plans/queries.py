"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import keys, text
from mnemospark.operators import archive, integrity, maintenance, observations, reports, search
from mnemospark.session import ship
from mnemospark.streaming import feeds


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _observations(spark, d) -> DataFrame:
    return _read(spark, d, "events").select(F.col("event_type").alias("metric"), F.col("ts").cast("date").alias("observed"), "value", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), "event_id")


_OBS = "obs AS (SELECT event_type AS metric, CAST(ts AS DATE) AS observed, value, 'u' || user_id AS source, event_id FROM events)"


def _ledger(spark, d) -> DataFrame:
    """Signups as interventions: uncertain by a day, lasting a week unless by an even user; one in five supersedes."""
    e = _read(spark, d, "events").where("event_type = 'signup' AND event_id % 50 = 0")
    start = F.col("ts").cast("date")
    return e.select("event_id", start.alias("start_earliest"), F.date_add(start, 1).alias("start_latest"), F.when(F.col("user_id") % 2 == 1, F.date_add(start, 7)).alias("end_latest"), F.when(F.col("event_id") % 250 == 0, F.col("event_id") - 50).alias("supersedes"))


_LEDGER = "ledger AS (SELECT event_id, CAST(ts AS DATE) AS start_earliest, CAST(ts AS DATE) + 1 AS start_latest, CASE WHEN user_id % 2 = 1 THEN CAST(ts AS DATE) + 7 END AS end_latest, CASE WHEN event_id % 250 = 0 THEN event_id - 50 END AS supersedes FROM events WHERE event_type = 'signup' AND event_id % 50 = 0)"


def _whole_ledger(spark, d) -> DataFrame:
    """Every signup as an intervention, with dates as above; one in five supersedes the same user's signup before it."""
    e = _read(spark, d, "events").where("event_type = 'signup'")
    start, before = F.col("ts").cast("date"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", start.alias("start_earliest"), F.date_add(start, 1).alias("start_latest"), F.when(F.col("user_id") % 2 == 1, F.date_add(start, 7)).alias("end_latest"), F.when(F.col("event_id") % 5 == 0, before).alias("supersedes"))


_WHOLE_LEDGER = "ledger AS (SELECT event_id, CAST(ts AS DATE) AS start_earliest, CAST(ts AS DATE) + 1 AS start_latest, CASE WHEN user_id % 2 = 1 THEN CAST(ts AS DATE) + 7 END AS end_latest, CASE WHEN event_id % 5 = 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS supersedes FROM events WHERE event_type = 'signup')"


def _messages(spark, d) -> DataFrame:
    return _read(spark, d, "conversations")


def _units(spark, d) -> DataFrame:
    return _messages(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("unit_id"), "conv_id", "turn", "text")


def _queries(spark) -> DataFrame:
    return spark.createDataFrame([(1, "tion"), (2, "the and"), (3, "ing that"), (4, "zzzqq")], "query_id int, q string")


_ASKED = "queries(query_id, term, n_terms) AS (VALUES (1, 'tion', 1), (2, 'the', 2), (2, 'and', 2), (3, 'ing', 2), (3, 'that', 2), (4, 'zzzqq', 1))"
_SCORED = f"""{_ASKED}, units AS (SELECT conv_id * 1000 + turn AS unit_id, conv_id, turn, lower(text) AS t, greatest(length(text) - 2, 0) AS dl FROM conversations),
found AS (SELECT query_id, term, n_terms, unit_id, conv_id, (length(t) - length(replace(t, term, ''))) / length(term) AS tf, dl FROM units JOIN queries ON contains(t, term)),
freq AS (SELECT query_id, term, count(*) AS df FROM found GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM units),
hits AS (SELECT query_id, unit_id, any_value(conv_id) AS conv_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM found JOIN freq USING (query_id, term), stats GROUP BY query_id, unit_id HAVING count(*) = any_value(n_terms))"""


def _best(spark, d) -> DataFrame:
    hits = search.keyword(_units(spark, d), _queries(spark)).join(_units(spark, d).select("unit_id", "conv_id"), "unit_id")
    return search.best_per_item(hits, "conv_id", "unit_id")


#: The query set of the searches: every row whose id is divisible by 20. The first queries ask for five rows alone.
_FIVE, _QUERY_SET = "vec_id < 5", "vec_id % 20 = 0"


def _vectors(spark, d, asked: str) -> tuple[DataFrame, DataFrame]:
    e = _read(spark, d, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").alias("v")), e.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


_KNN = """near AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, e.label FROM embeddings e, embeddings q WHERE q.vec_id < 5),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM near)"""


_CUT = "CASE WHEN {s} + 1500 >= length(text) THEN length(text) WHEN contains(substring(text, {s} + 751, 750), chr(10) || chr(10)) THEN {s} + 1501 - instr(reverse(substring(text, {s} + 751, 750)), chr(10) || chr(10)) ELSE {s} + 1500 END"
_REDACTED = "text"
for _provider, _pattern in text.SECRETS:
    # RE2 has no look-behind: the character before a key is matched and put back.
    _plain = _pattern.replace(text._START, r"(^|[^\pL\pN_])").replace(text._END, r"($|[^\pL\pN_])")
    _back = (r"\1" if text._START in _pattern else "") + f"[REDACTED:{_provider}]" + (r"\2" if text._END in _pattern else "")
    _REDACTED = f"regexp_replace({_REDACTED}, '{_plain}', '{_back}', 'g')"


def _links(spark, d) -> DataFrame:
    return archive.linked_pairs(_read(spark, d, "pages").select(F.col("page_id").alias("item"), F.lit("url").alias("via"), F.regexp_replace(keys.normal_url(F.col("url")), r"/[^/]*$", "").alias("key")))


def q_chunks(spark, d):
    ship(spark)
    return text.chunks(_read(spark, d, "documents"), "text", ["doc_id"]).select("doc_id", "idx", "start_offset", "end_offset", F.md5("chunk").alias("chunk_md5"))


def q_redact(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("redacted_md5"))


def q_orphans(spark, d):
    def relation(child, parent, key, parent_key):
        return integrity.orphan_counts(f"{child}-{parent}", _read(spark, d, child), _read(spark, d, parent), key, parent_key)

    return relation("labels", "documents", "doc_id", "doc_id").unionAll(relation("documents", "labels", "doc_id", "doc_id")).unionAll(relation("customer", "orders", "c_custkey", "o_custkey"))


def q_violations(spark, d):
    return integrity.observation_violations(_observations(spark, d), ["metric", "observed", "source"])


def q_turns(spark, d):
    return integrity.turn_structure(_messages(spark, d))


def q_recent(spark, d):
    e = _read(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))  # one row
    rows = e.join(F.broadcast(now)).select(F.col("event_type").alias("section"), "event_id", "ts", "now")
    return integrity.recent_by_section(rows, "section", "ts", "event_id", F.col("now"), 7, 20).select("section", "event_id", "place")


def q_stream_daily(spark, d):
    e = _read(spark, d, "events").schema
    feed = feeds.landed(spark, f"{d}/events.parque[t]", e).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    return feeds.drain(feeds.daily(feed, "event_type", "ts", "value"), "daily", "update", ["event_type", "day"])


def _segments(spark, d) -> DataFrame:
    """Every thread in segments of three turns; of some threads segments of four, which overlap."""
    start = (F.col("turn") - F.col("turn") % 3).alias("start_turn")
    return _messages(spark, d).select("conv_id", start).distinct().withColumn("end_turn", F.col("start_turn") + F.when(F.col("conv_id") % 5 == 0, 3).otherwise(2))


def q_segments(spark, d):
    return archive.in_segments(_messages(spark, d), _segments(spark, d)).groupBy("conv_id", "start_turn").agg(F.count("*").alias("n_turns"))


def q_segment_faults(spark, d):
    return reports.segment_faults(_segments(spark, d), _messages(spark, d))


def q_relinked(spark, d):
    return maintenance.relinked(_segments(spark, d), _messages(spark, d))


def q_pending(spark, d):
    threads = _messages(spark, d).select("conv_id").distinct()
    return maintenance.pending(threads, threads.where("conv_id % 3 = 0"), "conv_id")


def q_regenerated(spark, d):
    stored = _read(spark, d, "labels").select("doc_id", F.lit("old").alias("state"), "quality")
    fresh = _read(spark, d, "documents").select("doc_id", F.lit("new").alias("state"), F.lit(0).alias("quality"))
    return maintenance.regenerated(stored, fresh, "doc_id", F.col("quality") == 1).select("doc_id", "state")


def q_run_counts(spark, d):
    return maintenance.run_counts(q_changes(spark, d).join(_read(spark, d, "documents").select("doc_id", "source"), "doc_id"), "source")


def q_stale(spark, d):
    e = _read(spark, d, "events")
    seen = e.where("user_id % 10 > 0 OR day(ts) < 10").where("user_id % 7 > 0").select("user_id", "ts")
    return maintenance.stale(e, seen, "user_id", "ts", F.lit("2024-02-05").cast("date"), 25)


def q_dominant(spark, d):
    return maintenance.dominant(_read(spark, d, "documents"), "lang", "source")


def q_table_counts(spark, d):
    return maintenance.table_counts({t: _read(spark, d, t) for t in _COUNTED})


_COUNTED = ["documents", "embeddings", "pages", "labels", "conversations", "events"]
_ASKED_METRICS = ["click", "view", "purchase"]


def _history(spark, d) -> DataFrame:
    return reports.history(_observations(spark, d), _ASKED_METRICS, "2024-01-05", "2024-01-25", [F.desc("observed"), "metric", "event_id"])


def q_history(spark, d):
    return _history(spark, d).select("metric", "observed", "value", "event_id")


def q_snapshot(spark, d):
    return reports.snapshot(_history(spark, d), "event_id", [F.desc("observed"), F.col("metric"), F.col("event_id")])


def q_admissible(spark, d):
    lines = _read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return reports.admissible(lines, _read(spark, d, "part").where("p_size <= 30"), "l_orderkey", "p_partkey")


def q_snippets(spark, d):
    m = _messages(spark, d)
    return m.select("conv_id", "turn", reports.snippet(F.col("text"), F.lit("tion")).alias("snippet")).where("snippet IS NOT NULL")


def q_claims(spark, d):
    m = _messages(spark, d)
    claims = m.select("conv_id", "turn", F.col("role").alias("actor"), F.lit("claim").alias("kind"), F.lit("accepted").alias("status"), (F.col("conv_id") / 50).alias("confidence"), "text", F.array("turn", F.col("turn") + F.col("conv_id") % 4).alias("turns"), F.lit(0).alias("start_turn"), F.lit(6).alias("end_turn"))
    return reports.claim_faults(claims).select("conv_id", "turn", F.array_join("faults", ",").alias("faults"))


def q_daily(spark, d):
    return observations.summary(_observations(spark, d), observations.DAY)


def q_weekly(spark, d):
    return observations.summary(_observations(spark, d), observations.WEEK)


def q_monthly(spark, d):
    return observations.newest(observations.summary(_observations(spark, d), observations.MONTH), "metric", [F.desc("period")], 12)


def q_quality(spark, d):
    return observations.data_quality(_observations(spark, d))


def q_latest(spark, d):
    return observations.newest(_observations(spark, d), "metric", [F.desc("observed"), F.desc("event_id")], 1)


def q_newest_ten(spark, d):
    return observations.newest(_observations(spark, d), "metric", [F.desc("observed"), F.desc("event_id")], 10)


def q_latest_ties(spark, d):
    return observations.latest_with_ties(_observations(spark, d)).select("metric", "observed", "value", "source", "event_id")


def q_newest_dates(spark, d):
    return observations.newest_dates(_observations(spark, d), 8).select("metric", "observed", "value", "source", "event_id")


def q_missing(spark, d):
    return observations.missing_pairs(_observations(spark, d).where("metric <> 'signup' OR dayofmonth(observed) % 2 = 0"))


def q_heads(spark, d, ledger=_ledger):
    return observations.chain_heads(ledger(spark, d))


def q_response(spark, d, ledger=_ledger):
    return observations.event_response(_observations(spark, d).drop("event_id"), observations.chain_heads(ledger(spark, d)), 5)


def q_overlay(spark, d):
    """Counts, with the ids of the day in one text, as the SQL of this name asks for them."""
    obs, ledger = _observations(spark, d), _ledger(spark, d)
    ids = observations.active_days(obs, ledger).groupBy("observed").agg(F.array_join(F.array_sort(F.collect_set("event_id")).cast("array<string>"), ",").alias("active"))
    return observations.overlay(obs, ledger).join(ids, "observed", "left").select("event_id", "observed", "n_active", F.coalesce("active", F.lit("")).alias("active"))


def q_overlay_whole(spark, d):
    return observations.overlay(_observations(spark, d), _whole_ledger(spark, d)).select("event_id", "observed", "n_active")


def q_active_days(spark, d):
    return observations.active_days(_observations(spark, d), _whole_ledger(spark, d))


def q_overlaps(spark, d, ledger=_ledger):
    return observations.overlaps(ledger(spark, d), "2024-01-05", "2024-01-12").select("event_id", "start_earliest", "end_latest")


def q_fingerprints(spark, d):
    return observations.fingerprints(_observations(spark, d), "metric", "observed", "source").select("fingerprint", "metric", "observed", "source")


def q_threads(spark, d):
    return archive.thread_counts(_messages(spark, d))


def q_recency(spark, d):
    dated = archive.thread_counts(_messages(spark, d)).withColumn("updated_at", F.when(F.col("conv_id") % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("conv_id") * 37) % 365).cast("int"))))
    return archive.recency_page(dated, 20, 5).select("conv_id", "updated_at", "message_count")


def q_budget(spark, d):
    return archive.budget_page(_messages(spark, d), 8000).select("conv_id", "turn", "spent")


def q_small_budget(spark, d):
    return archive.budget_page(_messages(spark, d), 700).select("conv_id", "turn", "spent")


def q_whole_links(spark, d):
    """Pages of one address, whole."""
    return archive.linked_pairs(_read(spark, d, "pages").select(F.col("page_id").alias("item"), F.lit("url").alias("via"), keys.normal_url(F.col("url")).alias("key")))


def q_json(spark, d):
    return archive.threads_as_markdown(_messages(spark, d))


def q_duplicates(spark, d):
    return archive.duplicate_keys(_read(spark, d, "documents"), "text")


def q_changes(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    incoming = docs.where("doc_id % 3 > 0").withColumn("lang", F.when(F.col("doc_id") % 5 == 0, "xx").otherwise(F.col("lang")))
    return archive.changes(incoming, docs.where("doc_id % 4 > 0"), "doc_id", ["text", "lang", "source"])


def q_links(spark, d):
    return _links(spark, d)


def q_neighbours(spark, d):
    return archive.neighbours(_links(spark, d), _read(spark, d, "pages").where("page_id % 10 = 0").select(F.col("page_id").alias("item")))


def q_keyword(spark, d):
    return search.keyword(_units(spark, d), _queries(spark))


def q_best(spark, d):
    return _best(spark, d).select("query_id", "conv_id", "unit_id", "score", "hit_count")


def q_short(spark, d):
    return search.short_terms(_units(spark, d), spark.createDataFrame([(1, "th er"), (2, "q")], "query_id int, q string"))


def q_nearest(spark, d, asked=_FIVE):
    return search.nearest(*_vectors(spark, d, asked), 10)


def q_fusion(spark, d, asked=_FIVE):
    vectors, queries = _vectors(spark, d, asked)
    near = search.nearest(vectors, queries, 20).select("query_id", F.col("vec_id").alias("item"), "rank")
    other = search.nearest(vectors.where("label < 5"), queries, 20).select("query_id", F.col("vec_id").alias("item"), "rank")
    return search.fuse(near, other)


def q_diverse(spark, d, asked=_FIVE):
    vectors, queries = _vectors(spark, d, asked)
    near = search.nearest(vectors, queries, 30).join(vectors.select("vec_id", F.col("label").alias("source")), "vec_id")
    return search.diversify(near, 10).select("query_id", "vec_id", "source", "place")


def _summary_sql(period: str, n: int | None = None) -> str:
    body = f"SELECT metric, {period} AS period, count(value) AS n, count(*) - count(value) AS n_excluded, min(value) AS min_value, max(value) AS max_value, floor(avg(value) * 10000 + 0.5) / 10000 AS mean_value, floor(sum(value) * 10000 + 0.5) / 10000 AS sum_value FROM obs GROUP BY ALL"
    return f"WITH {_OBS} {body}" if n is None else f"WITH {_OBS}, s AS ({body}) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY metric ORDER BY period DESC) <= {n}"


# The pages' URLs have no user, port or codes, so few rules of the normal form bear on them.
_PARAMS = "list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_.*|fbclid|gclid|dclid|msclkid|igshid|si|t|ref_src|ref_url|mc_cid|mc_eid)$')))"
_NORMAL = f"regexp_extract(lower(url), '^(https?://)', 1) || regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') || CASE WHEN len({_PARAMS}) > 0 THEN '?' || array_to_string({_PARAMS}, '&') ELSE '' END"
_EDGES = f"""keyed AS (SELECT page_id AS item, regexp_replace({_NORMAL}, '/[^/]*$', '') AS key FROM pages),
good AS (SELECT key FROM keyed GROUP BY key HAVING count(*) BETWEEN 2 AND 30),
edges AS (SELECT DISTINCT x.item AS a, y.item AS b, 'url' AS via FROM keyed x JOIN keyed y USING (key) JOIN good USING (key) WHERE x.item < y.item)"""
_SEGMENTS = "segments AS (SELECT DISTINCT conv_id, turn - turn % 3 AS start_turn, turn - turn % 3 + CASE WHEN conv_id % 5 = 0 THEN 3 ELSE 2 END AS end_turn FROM conversations)"
_HISTORY = "history AS (SELECT * FROM obs WHERE metric IN ('click', 'view', 'purchase') AND observed BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' ORDER BY observed DESC, metric, event_id LIMIT 300)"
_TOP = "SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY metric ORDER BY observed DESC, event_id DESC) <= "
_HEADS = "heads AS (SELECT * FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger o WHERE o.supersedes = l.event_id))"
_SIDES = ", ".join(f"count(value) FILTER (side = '{s}') AS n_{s}, min(value) FILTER (side = '{s}') AS min_{s}, max(value) FILTER (side = '{s}') AS max_{s}, floor(avg(value) FILTER (side = '{s}') * 10000 + 0.5) / 10000 AS mean_{s}" for s in ("before", "after"))

REGISTERED: dict[str, tuple] = {
    "a3_daily_summary": (q_daily, _summary_sql("CAST(observed AS VARCHAR)")),
    "a4_weekly_summary": (q_weekly, _summary_sql("strftime(observed, '%G-W%V')")),
    "a5_monthly_summary": (q_monthly, _summary_sql("strftime(observed, '%Y-%m')", 12)),
    "a6_data_quality": (q_quality, f"WITH {_OBS} SELECT metric, count(*) AS n, count(*) - count(value) AS n_without, count(DISTINCT source) AS sources, min(observed) AS first_date, max(observed) AS last_date FROM obs GROUP BY metric"),
    "w2_latest_per_metric": (q_latest, f"WITH {_OBS} {_TOP} 1"),
    "w3_newest_per_metric": (q_newest_ten, f"WITH {_OBS} {_TOP} 10"),
    "j8_latest_with_ties": (q_latest_ties, f"WITH {_OBS} SELECT * FROM obs QUALIFY rank() OVER (PARTITION BY metric ORDER BY observed DESC) = 1"),
    "w4_newest_dates": (q_newest_dates, f"WITH {_OBS} SELECT * FROM obs WHERE observed IN (SELECT DISTINCT observed FROM obs ORDER BY 1 DESC LIMIT 8)"),
    "j12_missing_pairs": (q_missing, f"WITH {_OBS}, o AS (SELECT * FROM obs WHERE metric <> 'signup' OR day(observed) % 2 = 0) SELECT m.metric, x.observed FROM (SELECT DISTINCT metric FROM o) m, (SELECT DISTINCT observed FROM o) x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.metric = m.metric AND o.observed = x.observed AND value IS NOT NULL)"),
    "j4_chain_heads": (q_heads, f"WITH {_LEDGER}, {_HEADS} SELECT * FROM heads"),
    "a8_event_response": (q_response, f"WITH {_OBS}, {_LEDGER}, {_HEADS}, w AS (SELECT h.event_id AS eid, o.metric, o.value, CASE WHEN observed < start_earliest THEN 'before' WHEN observed > start_latest THEN 'after' ELSE 'inside' END AS side FROM obs o JOIN heads h ON observed BETWEEN start_earliest - 5 AND start_latest + 5) SELECT eid AS event_id, metric, {_SIDES}, count(*) FILTER (side = 'inside') AS n_inside, count(*) - count(value) AS n_non_numeric FROM w GROUP BY ALL"),
    "j5_overlay": (q_overlay, f"WITH {_OBS}, {_LEDGER} SELECT o.event_id, observed, count(l.event_id) AS n_active, coalesce(string_agg(CAST(l.event_id AS VARCHAR), ',' ORDER BY l.event_id), '') AS active FROM obs o LEFT JOIN ledger l ON start_earliest <= observed AND (end_latest IS NULL OR observed <= end_latest) GROUP BY o.event_id, observed"),
    "j11_period_overlap": (q_overlaps, f"WITH {_LEDGER} SELECT event_id, start_earliest, end_latest FROM ledger WHERE start_earliest <= DATE '2024-01-12' AND (end_latest IS NULL OR end_latest >= DATE '2024-01-05')"),
    "m9_fingerprints": (q_fingerprints, f"""WITH {_OBS} SELECT DISTINCT sha256('{{"metric":"' || metric || '","observed":"' || observed || '","source":"' || source || '"}}') AS fingerprint, metric, observed, source FROM obs"""),
    "a18_thread_counts": (q_threads, "SELECT conv_id, count(*) AS message_count, count(*) FILTER (role = 'user') AS user_count FROM conversations GROUP BY conv_id"),
    "t1_recency_page": (q_recency, "SELECT conv_id, CASE WHEN conv_id % 7 <> 0 THEN DATE '2024-01-01' + CAST((conv_id * 37) % 365 AS INTEGER) END AS updated_at, count(*) AS message_count FROM conversations GROUP BY conv_id ORDER BY updated_at DESC NULLS LAST, conv_id LIMIT 20 OFFSET 5"),
    "w5_budget_page": (q_budget, "SELECT conv_id, turn, spent FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM conversations) WHERE spent = 0 OR spent + length(text) <= 8000"),
    "w5_small_budget": (q_small_budget, "SELECT conv_id, turn, spent FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM conversations) WHERE spent = 0 OR spent + length(text) <= 700"),
    "j15_same_address": (q_whole_links, f"WITH keyed AS (SELECT page_id AS item, {_NORMAL} AS key FROM pages), good AS (SELECT key FROM keyed GROUP BY key HAVING count(*) BETWEEN 2 AND 30) SELECT DISTINCT x.item AS a, y.item AS b, 'url' AS via FROM keyed x JOIN keyed y USING (key) JOIN good USING (key) WHERE x.item < y.item"),
    "o2_markdown_export": (q_json, "SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id"),
    "a12_duplicate_keys": (q_duplicates, "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1"),
    "j10_changes": (q_changes, "SELECT i.doc_id, CASE WHEN s.doc_id IS NULL THEN 'insert' WHEN i.doc_id % 5 = 0 AND i.lang IS DISTINCT FROM 'xx' THEN 'update' ELSE 'skip' END AS action FROM documents i LEFT JOIN (SELECT * FROM documents WHERE doc_id % 4 > 0) s USING (doc_id) WHERE i.doc_id % 3 > 0"),
    "j15_links": (q_links, f"WITH {_EDGES} SELECT * FROM edges"),
    "j14_neighbours": (q_neighbours, f"WITH {_EDGES} SELECT a AS item, b AS neighbour, via FROM edges WHERE a % 10 = 0 UNION ALL SELECT b, a, via FROM edges WHERE b % 10 = 0"),
    "k5_keyword_bm25": (q_keyword, f"WITH {_SCORED} SELECT query_id, unit_id, score FROM hits"),
    "k1_keyword_threads": (q_best, f"WITH {_SCORED} SELECT query_id, conv_id, unit_id, score, count(*) OVER (PARTITION BY query_id, conv_id) AS hit_count FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, conv_id ORDER BY score, unit_id) = 1"),
    "k3_short_terms": (q_short, "SELECT 1 AS query_id, conv_id * 1000 + turn AS unit_id FROM conversations WHERE contains(lower(text), 'th') AND contains(lower(text), 'er') UNION ALL SELECT 2, conv_id * 1000 + turn FROM conversations WHERE contains(lower(text), 'q')"),
    "v1_nearest": (q_nearest, f"WITH {_KNN} SELECT query_id, vec_id, score, rank FROM top WHERE rank <= 10"),
    "k9_rank_fusion": (q_fusion, f"WITH {_KNN}, fifth AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r2 FROM near WHERE label < 5), l AS (SELECT query_id, vec_id AS item, rank, 0 AS list FROM top WHERE rank <= 20 UNION ALL SELECT query_id, vec_id, r2, 1 FROM fifth WHERE r2 <= 20) SELECT query_id, item, round(sum(1 / (60 + rank)), 8) AS score, count(*) AS lists, min(list) AS first_list FROM l GROUP BY ALL"),
    "f5_chunks": (q_chunks, f"WITH RECURSIVE c AS (SELECT doc_id, text, 0 AS idx, 0 AS s, {_CUT.format(s='0')} AS e FROM documents WHERE regexp_matches(text, '\\S') UNION ALL SELECT doc_id, text, idx + 1, e - 200, {_CUT.format(s='(e - 200)')} FROM c WHERE e < length(text)) SELECT doc_id, idx, s AS start_offset, e AS end_offset, md5(substring(text, s + 1, e - s)) AS chunk_md5 FROM c"),
    "f1_redact": (q_redact, f"SELECT doc_id, md5({_REDACTED}) AS redacted_md5 FROM documents"),
    "q1_orphans": (q_orphans, "SELECT 'labels-documents' AS relation, count(*) AS n_orphans, count(DISTINCT doc_id) AS n_keys FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT 'documents-labels', count(*), count(DISTINCT doc_id) FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'customer-orders', count(*), count(DISTINCT c_custkey) FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "q8_observation_rules": (q_violations, f"WITH {_OBS}, k AS (SELECT metric, count(*) AS n, count(*) - count(value) AS nv, count(*) - count(observed) AS nt FROM obs GROUP BY metric, observed, source) SELECT metric, sum(n)::BIGINT AS n_rows, sum(nv)::BIGINT AS n_no_value, sum(nt)::BIGINT AS n_no_time, sum(n - 1)::BIGINT AS n_repeated FROM k GROUP BY metric"),
    "q3_turn_structure": (q_turns, "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (step <> 1) AS n_jumps, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_blank FROM (SELECT *, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations) GROUP BY conv_id"),
    "r2_weekly_activity": (q_recent, "SELECT event_type AS section, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id)::INTEGER AS place FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY QUALIFY place <= 20"),
    "z6_stream_daily": (q_stream_daily, "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY ALL"),
    "j7_segment_turns": (q_segments, f"WITH {_SEGMENTS} SELECT conv_id, start_turn, count(*) AS n_turns FROM segments JOIN conversations USING (conv_id) WHERE turn BETWEEN start_turn AND end_turn GROUP BY ALL"),
    "q3_segment_faults": (q_segment_faults, f"WITH {_SEGMENTS}, n AS (SELECT *, lead(start_turn) OVER (PARTITION BY conv_id ORDER BY start_turn, end_turn) AS following FROM segments), j AS (SELECT *, CASE WHEN following <= end_turn THEN 'overlap' WHEN NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = n.conv_id AND turn = start_turn) OR NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = n.conv_id AND turn = end_turn) THEN 'missing' END AS fault FROM n) SELECT conv_id, start_turn, end_turn, fault FROM j WHERE fault IS NOT NULL"),
    "m6_relinked": (q_relinked, f"WITH {_SEGMENTS} SELECT s.* FROM segments s JOIN (SELECT conv_id, min(turn) AS a, max(turn) AS b FROM conversations GROUP BY conv_id) USING (conv_id) WHERE start_turn >= a AND end_turn <= b"),
    "j3_pending": (q_pending, "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 <> 0"),
    "m16_regenerated": (q_regenerated, "SELECT doc_id, 'old' AS state FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "o3_run_counts": (q_run_counts, "WITH c AS (SELECT i.source, CASE WHEN s.doc_id IS NULL THEN 'insert' WHEN i.doc_id % 5 = 0 AND i.lang IS DISTINCT FROM 'xx' THEN 'update' ELSE 'skip' END AS action FROM documents i LEFT JOIN (SELECT * FROM documents WHERE doc_id % 4 > 0) s USING (doc_id) WHERE i.doc_id % 3 > 0) SELECT source, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'skip') AS skipped, count(*) AS seen FROM c GROUP BY source"),
    "a13_stale_sources": (q_stale, "WITH l AS (SELECT user_id, CAST(max(ts) AS DATE) AS last_seen FROM events WHERE (user_id % 10 > 0 OR day(ts) < 10) AND user_id % 7 > 0 GROUP BY user_id) SELECT user_id, last_seen, DATE '2024-02-05' - last_seen AS age FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN l USING (user_id) WHERE last_seen IS NULL OR DATE '2024-02-05' - last_seen > 25"),
    "a10_dominant": (q_dominant, "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, lang, source LIMIT 1"),
    "a15_table_counts": (q_table_counts, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _COUNTED)),
    "p12_history": (q_history, f"WITH {_OBS}, {_HISTORY} SELECT metric, observed, value, event_id FROM history"),
    "r6_snapshot": (q_snapshot, f"WITH {_OBS}, {_HISTORY} SELECT count(*) AS n_rows, max(observed) AS last_observed, sha256(coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY observed DESC, metric, event_id), '')) AS result_hash FROM history"),
    "j13_admissible": (q_admissible, "SELECT l_orderkey, count(*) AS n_evidence FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 30) ON l_partkey = p_partkey GROUP BY l_orderkey HAVING count(*) FILTER (p_partkey IS NULL) = 0"),
    "k6_snippets": (q_snippets, "SELECT conv_id, turn, substring(text, greatest(p - 80, 1), p - greatest(p - 80, 1)) || '[[' || substring(text, p, 4) || ']]' || substring(text, p + 4, 80) AS snippet FROM (SELECT *, instr(lower(text), 'tion') AS p FROM conversations) WHERE p > 0"),
    "q4_claim_faults": (q_claims, "SELECT conv_id, turn, concat_ws(',', CASE WHEN role NOT IN ('user', 'assistant', 'shared') THEN 'actor' END, CASE WHEN conv_id / 50 > 1 THEN 'confidence' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'text' END, CASE WHEN turn > 6 OR turn + conv_id % 4 > 6 THEN 'turns' END) AS faults FROM conversations WHERE faults <> ''"),
    "w6_diversity": (q_diverse, f"WITH {_KNN}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) > 5 AS overflow FROM top WHERE rank <= 30), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overflow, rank) AS place FROM c) SELECT query_id, vec_id, label AS source, place FROM p WHERE place <= 10"),
}

#: The same searches with the whole query set.
for _name, _query in {"v1_nearest": q_nearest, "k9_rank_fusion": q_fusion, "w6_diversity": q_diverse}.items():
    REGISTERED[f"{_name}_whole"] = (partial(_query, asked=_QUERY_SET), REGISTERED[_name][1].replace(f"q.{_FIVE}", f"q.{_QUERY_SET}"))

#: What stands on the ledger with every signup in it. The overlay there is counts, and a row for each day and active event.
for _name, _query in {"j4_chain_heads": q_heads, "a8_event_response": q_response, "j11_period_overlap": q_overlaps}.items():
    REGISTERED[f"{_name}_whole"] = (partial(_query, ledger=_whole_ledger), REGISTERED[_name][1].replace(_LEDGER, _WHOLE_LEDGER))
_response, _sql = REGISTERED["a8_event_response_whole"]
for _side in ("before", "after"):
    # As in the operator: the order in which values are added must not decide how a half is rounded.
    _sql = _sql.replace(f"avg(value) FILTER (side = '{_side}')", f"round(avg(value) FILTER (side = '{_side}'), 9)")
REGISTERED["a8_event_response_whole"] = (_response, _sql)
_ACTIVE = "start_earliest <= observed AND (end_latest IS NULL OR observed <= end_latest)"
_DAYS = f"WITH {_OBS}, {_WHOLE_LEDGER}, days AS (SELECT observed, l.event_id FROM (SELECT DISTINCT observed FROM obs) LEFT JOIN ledger l ON {_ACTIVE})"
REGISTERED["j5_overlay_whole"] = (q_overlay_whole, f"{_DAYS}, n AS (SELECT observed, count(event_id) AS n_active FROM days GROUP BY observed) SELECT event_id, observed, n_active FROM obs JOIN n USING (observed)")
REGISTERED["j5_active_days_whole"] = (q_active_days, f"{_DAYS} SELECT * FROM days WHERE event_id IS NOT NULL")

def q_instants(spark, d):
    """Signups last from their millisecond on by so many seconds as their id says, every seventh without an end."""
    e = _read(spark, d, "events")
    end = F.when(F.col("event_id") % 7 > 0, F.col("ts") + F.make_dt_interval(secs=F.col("event_id") * 37 % 2_000_000))
    return observations.overlay_instants(e.select("event_id", "ts"), e.where("event_type = 'signup'").select("ts", end.alias("until")), "ts", "ts", "until")


REGISTERED["j5_overlay_instants"] = (q_instants, """WITH spans AS (SELECT epoch_ms(ts) AS a, CASE WHEN event_id % 7 > 0 THEN epoch_ms(ts) + event_id * 37 % 2000000 * 1000 END AS b FROM events WHERE event_type = 'signup'),
n AS (SELECT ms, count(a) AS n_active FROM (SELECT DISTINCT epoch_ms(ts) AS ms FROM events) LEFT JOIN spans ON a <= ms AND (b IS NULL OR ms <= b) GROUP BY ms)
SELECT event_id, ts, n_active FROM events JOIN n ON ms = epoch_ms(ts)""")

# The first forms asked for a part of their table; now these names run the whole job too.
for _name in ("v1_nearest", "k9_rank_fusion", "w6_diversity", "j4_chain_heads", "a8_event_response", "j11_period_overlap", "j5_overlay"):
    REGISTERED[_name] = REGISTERED[f"{_name}_whole"]

FLAGSHIP = "k1_keyword_threads"
