"""Registered queries of the readers: exports that Spark writes from the given tables, read again and held against them."""

from __future__ import annotations

import uuid

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.archive import _WS
from mnemospark.plans.queries import _messages, _observations, _read
from mnemospark.session import scratch, ship
from mnemospark.sources import exports, items, logs, measurements, threads


def _direct(path: str) -> bool:
    """Whether Python's tasks reach the folder by its address."""
    try:
        FileSystem.from_uri(path)
    except (ValueError, OSError):
        return False
    return True


def _writer(path: str, name):
    """Writes a file for each of a task's values and their numbers.

    Attempts of a task may run again or beside each other, so a file is written under a hidden name of its own and takes
    its name when it is whole; the values come in one order, so a name has the same value in every attempt.
    """

    def run(rows):
        fs, top = FileSystem.from_uri(path)
        made = set()
        for value, i in rows:
            place = f"{top}/{name(i)}"
            folder = place.rpartition("/")[0]
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                out.write((value + "\n").encode())
            fs.move(draft, place)

    return run


def _files(spark, rows: DataFrame, value: Column, name: str, named=None) -> str:
    """A file for each row; ``named`` gives files a name by their number, from 0 without a gap.

    Tasks write the files themselves under their names: Spark's writers take some 40 ms of a core for each file on a local
    disk, and can't name them. Where Python does not reach the folder, they write, and the driver renames.
    """
    path = scratch(spark, name)
    values = rows.select(F.coalesce(value.cast("string"), F.lit("")).alias("value"))
    if not _direct(path):
        values.write.option("maxRecordsPerFile", 1).text(path)
        return _renamed(spark, path, named) if named else path
    ship(spark)
    FileSystem.from_uri(path)[0].create_dir(FileSystem.from_uri(path)[1], recursive=True)
    # Rows come out of a shuffle in any order; sorted, a task that runs again numbers them as before.
    texts = values.sortWithinPartitions("value").rdd.map(lambda r: r.value)
    if named:
        texts.zipWithIndex().foreachPartition(_writer(path, named))
    else:
        # An own number in each partition, so that rows are made once.
        write = _writer(path, lambda i: f"part-{i[0]:05}-{i[1]}.txt")
        texts.mapPartitionsWithIndex(lambda part, own: write((v, (part, i)) for i, v in enumerate(own)) or ()).count()
    return path


#: Numbers of a file's rows where a row has a thousand times its thread and its turn: those of 50 threads.
_FIFTY_THREADS = 50_000


def _listed(e: str) -> Column:
    """A JSON array of a group's rows ``e`` in the order of their numbers ``n``, the same text in every run."""
    own = F.array_sort(F.collect_list(F.struct("n", F.to_json(e).alias("e"))))
    return F.concat(F.lit("["), F.array_join(F.transform(own, lambda r: r["e"]), ","), F.lit("]"))


def _arrays(spark, rows: DataFrame, name: str, share: int = 50) -> str:
    """JSON files with arrays of the rows ``e`` whose numbers ``n`` lie in one run of ``share``."""
    packed = rows.groupBy(F.expr(f"n div {share}")).agg(_listed("e").alias("value"))
    return _files(spark, packed, F.col("value"), name)


def _whole(spark, d) -> DataFrame:
    """conv_id, m: each thread with its messages in order."""
    return _messages(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))


def _renamed(spark, path: str, name) -> str:
    """Gives the files of a folder names of their own, by their number."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    path_of, made = jvm.org.apache.hadoop.fs.Path, set()
    for i, old in enumerate(found):
        new, parent = path_of(folder, name(i)), name(i).rpartition("/")[0]
        if parent not in made:
            fs.mkdirs(new.getParent())
            made.add(parent)
        fs.rename(path_of(old), new)
    return path


def _seen(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("position").cast("long").alias("position"), "role", F.md5("text").alias("text_md5"))


def _stamp(turn: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.lit(1700000000) + turn), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _turns_path(spark, d) -> str:
    turns = F.transform("m", lambda m: F.struct(m["turn"].cast("string").alias("uuid"), F.when(m["role"] == "user", "human").otherwise(m["role"]).alias("sender"), F.lit("").alias("text"), _stamp(m["turn"]).alias("created_at"), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text"))).alias("content")))
    e = F.struct(F.col("conv_id").cast("string").alias("uuid"), F.lit("t").alias("name"), turns.alias("chat_messages"))
    return _arrays(spark, _whole(spark, d).select(F.col("conv_id").alias("n"), e.alias("e")), "export-turns")


def q_turns(spark, d):
    return _seen(threads.read_turns(spark, _turns_path(spark, d)))


def _tree_path(spark, d) -> str:
    """Trees whose branch is the thread, with a node beside it that is none of it."""
    ident = lambda m: F.concat(F.lit("n"), m["turn"].cast("string"))

    def node(m, i):
        parent = F.when(i > 0, ident(F.get("m", i - 1)))
        said = F.struct(F.struct(m["role"].alias("role")).alias("author"), (F.lit(1700000000.0) + m["turn"]).alias("create_time"), F.struct(F.lit("text").alias("content_type"), F.array(m["text"]).alias("parts")).alias("content"))
        return F.struct(ident(m).alias("key"), F.struct(parent.alias("parent"), said.alias("message")).alias("value"))

    nodes = F.transform("m", node)
    other = F.transform(F.slice("m", 1, 1), lambda m: F.struct(F.lit("other").alias("key"), F.struct(ident(m).alias("parent"), F.struct(F.struct(F.lit("assistant").alias("role")).alias("author"), F.lit(1.0).alias("create_time"), F.struct(F.lit("text").alias("content_type"), F.array(F.lit("another branch")).alias("parts")).alias("content")).alias("message")).alias("value")))
    e = F.struct(F.lit("t").alias("title"), F.lit(1700000000.0).alias("create_time"), F.col("conv_id").cast("string").alias("conversation_id"), ident(F.get("m", F.size("m") - 1)).alias("current_node"), F.map_from_entries(F.concat(nodes, other)).alias("mapping"))
    return _arrays(spark, _whole(spark, d).select(F.col("conv_id").alias("n"), e.alias("e")), "export-trees")


def q_trees(spark, d):
    ship(spark)
    return _seen(threads.read_trees(spark, _tree_path(spark, d)))


def _log(spark, d, line, name: str) -> str:
    """A file of lines for each thread, with a broken line at its end."""
    lines = F.concat(F.transform("m", line), F.array(F.lit("{broken")))
    return _files(spark, _whole(spark, d), F.array_join(F.flatten(F.transform(lines, lambda x: F.array(x))), "\n"), name)


def _session_path(spark, d) -> str:
    content = lambda m: F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("text")))
    return _log(spark, d, lambda m: F.to_json(F.struct(m["role"].alias("type"), F.col("conv_id").cast("string").alias("sessionId"), _stamp(m["turn"]).alias("timestamp"), F.lit("/home").alias("cwd"), F.struct(content(m).alias("content")).alias("message"))), "export-sessions")


def q_sessions(spark, d):
    return _seen(logs.read_sessions(spark, _session_path(spark, d)))


def q_bad_lines(spark, d):
    return logs.bad_lines(spark, _session_path(spark, d)).agg(F.count("*").alias("files"), F.sum("n").alias("bad_lines"))


def q_activity(spark, d):
    """Pages as answers to prompts in activity records, some of another product, some feedback."""
    p = F.col("page_id")
    title = F.when(p % 5 == 0, "Sent feedback").otherwise(F.concat(F.lit("Prompted "), "url"))
    html = F.concat(F.lit('<p>About</p><img src="a'), p.cast("string"), F.lit('.png"><script>x</script>'))
    e = F.struct(F.when(p % 7 == 0, "Search").otherwise("Gemini Apps").alias("header"), title.alias("title"), _stamp(p).alias("time"), F.array(F.struct(html.alias("html"))).alias("safeHtmlItem"), F.array(F.concat(F.lit("a"), p.cast("string"), F.lit(".png")), F.lit("b.pdf")).alias("attachedFiles"))
    path = _arrays(spark, _read(spark, d, "pages").select(p.alias("n"), e.alias("e")), "export-activity")
    return exports.read_activity(spark, path).select("position", "role", "text", "title", F.array_join("attachments", ",").alias("attachments"))


def q_kinds(spark, d):
    """Files of three exports and some broken ones in one folder, by what they are."""
    broken = _files(spark, _read(spark, d, "region"), F.concat(F.lit("[{"), "r_name"), "export-broken")
    every = None
    for path in (_turns_path(spark, d), _tree_path(spark, d), broken):
        one = exports.export_kinds(spark, path)
        every = one if every is None else every.unionAll(one)
    return every.groupBy("kind").agg((F.count("*") > 0).alias("found"))


def q_shards(spark, d):
    """Shards of an export, one of them broken."""
    path = _turns_path(spark, d)
    _read(spark, d, "region").limit(1).select(F.lit("[{broken").alias("value")).write.mode("append").text(path)
    raw = spark.read.schema(threads.TURNS).option("multiLine", True).json(path).where("uuid IS NOT NULL").select(F.col("_metadata.file_path").alias("path"), F.col("uuid").alias("conv_id"))
    return exports.shard_counts(spark, path, raw.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))).agg(F.sum("n").alias("threads"), F.count_if("failed").alias("failed"))


def q_bookmarks(spark, d):
    """Pages as bookmarks of a service, in landed pages of its interface; every tenth comes again, newer."""
    p = F.col("page_id")
    mark = lambda day: F.struct(p.cast("string").alias("id"), F.lit("2024-01-01T00:00:00Z").alias("createdAt"), F.lit(f"2024-01-0{day}T00:00:00Z").alias("modifiedAt"), F.lit(f"v{day}").alias("title"), F.array(F.struct(F.lit("to-review").alias("name"))).alias("tags"), F.struct(F.lit("link").alias("type"), F.col("url").alias("url")).alias("content"))
    pages = _read(spark, d, "pages")
    rows = pages.select(p.alias("n"), mark(1).alias("b")).unionAll(pages.where("page_id % 10 = 0").select(p, mark(2)))
    packed = rows.groupBy(F.expr("n div 50")).agg(F.concat(F.lit('{"bookmarks":'), _listed("b"), F.lit("}")).alias("value"))
    found = items.read_bookmarks(spark, _files(spark, packed, F.col("value"), "export-bookmarks"))
    return found.select("external_id", "kind", "title", "url", F.array_join("tags", ",").alias("tags"), F.col("updated_at").cast("date").alias("updated_on"))


def q_works(spark, d):
    p = F.col("doc_id")
    e = F.struct(p.cast("string").alias("key"), F.struct(F.when(p % 6 == 0, "note").otherwise("journalArticle").alias("itemType"), F.left("text", F.lit(30)).alias("title"), F.concat(F.lit("10.1/"), p.cast("string")).alias("DOI"), F.array(F.struct(F.lit("Ann").alias("firstName"), F.col("source").alias("lastName"))).alias("creators"), F.lit("2024-02-03T00:00:00Z").alias("dateModified")).alias("data"))
    found = items.read_works(spark, _arrays(spark, _read(spark, d, "documents").select(p.alias("n"), e.alias("e")), "export-works"))
    return found.select("external_id", F.md5("title").alias("title_md5"), "doi", F.get_json_object("meta", "$.creators[0]").alias("creator"))


def q_own_posts(spark, d):
    """Turns as posts of a network, in its broken charset."""
    broken = F.decode(F.col("text").cast("binary"), "ISO-8859-1")
    m = _messages(spark, d)
    n = F.col("conv_id") * 1000 + F.col("turn")
    post = F.struct((n + 1700000000).alias("timestamp"), F.array(F.struct(broken.alias("post"))).alias("data"))
    said = F.struct((n + 1700000000).alias("timestamp"), F.array(F.struct(F.struct(broken.alias("comment"), F.when(n % 2 == 0, "Ann").otherwise("Bob").alias("author")).alias("comment"))).alias("data"))
    posts = _arrays(spark, m.where("role = 'user'").select(n.alias("n"), post.alias("e")), "export-posts", _FIFTY_THREADS)
    packed = m.where("role = 'assistant'").select(n.alias("n"), said.alias("e")).groupBy(F.expr(f"n div {_FIFTY_THREADS}")).agg(F.concat(F.lit('{"comments_v2":'), _listed("e"), F.lit("}")).alias("value"))
    found, authors = items.read_own_posts(spark, posts, _files(spark, packed, F.col("value"), "export-comments"))
    return found.groupBy(F.get_json_object("meta", "$.post_type").alias("type")).agg(F.count("*").alias("n"), F.min(F.md5("text")).alias("least")).crossJoin(F.broadcast(authors))  # one row


def q_wrapped_posts(spark, d):
    """Turns as posts and likes of a network's archive: JSON arrays behind an assignment."""
    m = _messages(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("n"), "turn", "text")
    ident = F.col("n").cast("string")
    post = F.struct(F.struct(ident.alias("id_str"), F.col("text").alias("full_text"), F.lit("Wed Jan 03 10:00:00 +0000 2024").alias("created_at"), F.when(F.col("n") % 2 == 0, F.lit("7")).alias("in_reply_to_status_id_str")).alias("tweet"))
    like = F.struct(F.struct(ident.alias("tweetId"), F.lit("https://x.com/i/1").alias("expandedUrl")).alias("like"))
    every = None
    for name, rows, e in (("tweets", m.where("turn > 0"), post), ("like", m.where("turn = 0"), like)):
        packed = rows.select("n", e.alias("e")).groupBy(F.expr(f"n div {_FIFTY_THREADS}")).agg(F.concat(F.lit(f"window.YTD.{name}.part0 = "), _listed("e")).alias("value"))
        path = _files(spark, packed, F.col("value"), f"export-{name}", lambda i, name=name: f"data/{name}-part{i}.js")
        one = items.read_wrapped_posts(spark, path)
        every = one if every is None else every.unionAll(one)
    return every.select("external_id", "kind", F.get_json_object("meta", "$.post_type").alias("type"), F.md5("text").alias("text_md5"), F.col("created_at").cast("date").alias("day"))


def q_notes(spark, d):
    """Pages as notes in two folders, one of them hidden."""
    page = _read(spark, d, "pages").select(F.concat(F.lit("note "), "url").alias("value"))
    path = _files(spark, page, F.col("value"), "export-notes", lambda i: f"{'ideas' if i % 3 else '.trash'}/n{i}.md")
    found = items.read_notes(spark, path, ["ideas", ".trash"])
    whole = _read(spark, d, "pages").agg(F.count("*").alias("files"))  # one row
    rows = found.withColumn("known", F.col("text").startswith("note http")).agg(F.count("*").alias("n"), F.count_if("known").alias("known"), F.count_distinct("text").alias("texts"))
    return rows.crossJoin(F.broadcast(whole)).select("files", "n", (F.col("known") == F.col("n")).alias("all_known"), (F.col("texts") > 0).alias("some"))


def q_sheet(spark, d):
    """Means of a metric and day as a lab sheet with a column for each day."""
    daily = _observations(spark, d).groupBy(F.concat(F.lit("Test "), "metric").alias("metric"), F.lit("mg").alias("unit")).pivot("observed").agg(F.round(F.avg("value"), 2))
    path = scratch(spark, "export-sheet")
    daily.coalesce(1).write.option("header", True).csv(path)  # a row for each metric
    names = _observations(spark, d).select("metric").distinct()
    known = names.where("metric <> 'error'").withColumn("canonical_unit", F.lit("mg"))
    aliases = exports.catalog(known, known.select(F.concat(F.lit("Test "), "metric").alias("alias"), "metric"))
    units = known.select(F.lit("mg").alias("spelling"), F.lit("mg").alias("unit")).distinct()
    found = measurements.read_sheet(spark, path, known, aliases, units)
    return found.select("original_metric", "metric", "observed", F.round("value_num", 2).alias("value"), "reason")


def q_records(spark, d):
    """Events as sensor records in XML, some of types that no metric asks for, some repeated."""
    e = _read(spark, d, "events")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))
    rows = e.select(F.col("event_type").alias("_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("_sourceName"), F.lit("count").alias("_unit"), F.col("value").cast("decimal(10,2)").cast("string").alias("_value"), at.alias("_startDate"), at.alias("_endDate"))
    path = scratch(spark, "export-records")
    rows.unionAll(rows.where("_type = 'click'")).write.format("xml").option("rootTag", "HealthData").option("rowTag", "Record").save(path)
    known = rows.select(F.col("_type").alias("type")).distinct().where("type <> 'error'").select("type", F.col("type").alias("metric"), F.lit("count").alias("canonical_unit"))
    units = known.select(F.lit("count").alias("spelling"), F.lit("count").alias("unit")).distinct()
    found = measurements.read_records(spark, path, known, units)
    counted = found.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value_num"), 2).alias("total"))
    return counted.unionByName(measurements.ignored_types(spark, path, known).select(F.col("type").alias("metric"), "n", F.lit(None).cast("double").alias("total")))


def q_ledger(spark, d):
    i = F.col("event_id")
    rows = _read(spark, d, "events").where("event_type = 'signup'").select(i.cast("string").alias("id"), F.when(i % 9 == 0, "wish").otherwise("medication_start").alias("kind"), F.lit("x").alias("label"), F.when(i % 4 == 0, F.date_format("ts", "yyyy-MM")).when(i % 4 == 1, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("start"))
    path = scratch(spark, "export-ledger")
    rows.write.json(path)
    return measurements.read_ledger(spark, path).select("id", "start_earliest", "start_latest", F.array_join("violations", ",").alias("violations"))


def q_documents(spark, d):
    """Texts as documents handed in, under two names; half are there already, some have an extract."""
    docs = _read(spark, d, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("name"), F.when(F.col("doc_id") % 2 == 0, "letter").otherwise("other").alias("kind"), F.col("text").cast("binary").alias("content"), "doc_id")
    stored = docs.where("doc_id % 4 = 1").select(F.sha2("content", 256).alias("sha"), "kind")
    new = exports.registered(docs, stored)
    extracts = docs.where("doc_id % 3 = 0").groupBy(F.sha2("content", 256).alias("sha")).agg(F.lit("text").alias("text"), F.max(F.when(F.col("doc_id") % 6 == 0, "me")).alias("verified_by"))
    return exports.with_extracts(new, extracts).groupBy("kind", "status").agg(F.count("*").alias("n"))


def q_blobs(spark, d):
    docs = _read(spark, d, "documents").select(F.col("text").cast("binary").alias("content"), "doc_id")
    stored = docs.where("doc_id % 3 = 0").select(F.sha2("content", 256).alias("hash"))
    return exports.stored_once(docs, stored).select("hash", F.length("content").cast("long").alias("size"))


def q_pointers(spark, d):
    p = F.col("page_id")
    pages = _read(spark, d, "pages")
    pointers = pages.select("page_id", F.concat(F.when(p % 4 == 0, "sediment://").otherwise("file-service://"), F.lit("file-"), p.cast("string")).alias("pointer"), p.alias("size_bytes"))
    blobs = pages.where("page_id % 3 > 0").select(F.concat(F.lit("in/zip/file-"), p.cast("string"), F.lit(".dat")).alias("path"), F.col("url").cast("binary").alias("content"))
    names = pages.where("page_id % 2 = 0").select(F.concat(F.lit("file-"), p.cast("string"), F.lit(".dat")).alias("file"), F.concat(F.lit("Photo"), p.cast("string"), F.lit(".JPG")).alias("name"))
    return exports.resolved(pointers, blobs, names).select("page_id", "name", "mime", "size", "hash")


def q_inline(spark, d):
    p = F.col("page_id")
    data = F.when(p % 5 == 0, F.lit("%%%")).otherwise(F.base64(F.col("url").cast("binary")))
    block = F.struct(F.when(p % 2 == 0, "image").otherwise("text").alias("type"), F.struct(F.lit("base64").alias("type"), F.lit("image/png").alias("media_type"), data.alias("data")).alias("source"))
    return _read(spark, d, "pages").select("page_id", F.inline(exports.inline_files(F.array(block))))


_SEEN = f"SELECT CAST(conv_id AS VARCHAR) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, role, md5(t) AS text_md5 FROM (SELECT *, trim(text, {_WS}) AS t FROM conversations) WHERE role IN ('user', 'assistant') AND t <> ''"
_PROMPT = "CASE WHEN length(url) > 60 THEN left(url, 60) || '…' ELSE url END"
_OWN = f"SELECT role, md5(text) AS m FROM conversations WHERE trim(text, {_WS}) <> ''"

REGISTERED: dict[str, tuple] = {
    "s3_turn_exports": (q_turns, _SEEN),
    "s1_tree_exports": (q_trees, _SEEN),
    "s5_session_logs": (q_sessions, _SEEN),
    "s5_bad_lines": (q_bad_lines, "SELECT count(DISTINCT conv_id) AS files, count(DISTINCT conv_id) AS bad_lines FROM conversations"),
    "s4_activity": (q_activity, f"WITH p AS (SELECT * FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0) SELECT 0 AS position, 'user' AS role, url AS text, {_PROMPT} AS title, 'b.pdf' AS attachments FROM p UNION ALL SELECT 1, 'assistant', 'About', {_PROMPT}, 'a' || page_id || '.png' FROM p"),
    "s17_export_kinds": (q_kinds, "SELECT unnest(['turns', 'tree', 'unreadable']) AS kind, true AS found"),
    "s2_shards": (q_shards, "SELECT count(DISTINCT conv_id)::BIGINT AS threads, 1::BIGINT AS failed FROM conversations"),
    "s9_bookmarks": (q_bookmarks, "SELECT CAST(page_id AS VARCHAR) AS external_id, 'bookmark' AS kind, CASE WHEN page_id % 10 = 0 THEN 'v2' ELSE 'v1' END AS title, url, 'to-review' AS tags, CASE WHEN page_id % 10 = 0 THEN DATE '2024-01-02' ELSE DATE '2024-01-01' END AS updated_on FROM pages"),
    "s10_works": (q_works, "SELECT CAST(doc_id AS VARCHAR) AS external_id, md5(left(text, 30)) AS title_md5, '10.1/' || doc_id AS doi, 'Ann ' || source AS creator FROM documents WHERE doc_id % 6 <> 0"),
    "s8_own_posts": (q_own_posts, f"SELECT CASE role WHEN 'user' THEN 'post' ELSE 'comment' END AS type, count(*) AS n, min(m) AS least, (SELECT count(DISTINCT (conv_id * 1000 + turn) % 2) FROM conversations WHERE role = 'assistant') AS comment_authors FROM ({_OWN}) WHERE role IN ('user', 'assistant') GROUP BY role"),
    "s7_wrapped_posts": (q_wrapped_posts, f"SELECT 'x:' || (conv_id * 1000 + turn) AS external_id, 'social_post' AS kind, CASE WHEN (conv_id * 1000 + turn) % 2 = 0 THEN 'reply' ELSE 'post' END AS type, md5(text) AS text_md5, DATE '2024-01-03' AS day FROM conversations WHERE turn > 0 AND trim(text, {_WS}) <> '' UNION ALL SELECT 'xlike:' || (conv_id * 1000 + turn), 'bookmark', 'like', NULL, NULL FROM conversations WHERE turn = 0"),
    "s11_notes": (q_notes, "SELECT count(*) AS files, count(*) - (count(*) + 2) // 3 AS n, true AS all_known, true AS some FROM pages"),
    "s12_lab_sheet": (q_sheet, "SELECT 'Test ' || event_type AS original_metric, CASE WHEN event_type <> 'error' THEN event_type END AS metric, CAST(ts AS DATE) AS observed, CASE WHEN event_type <> 'error' THEN round(avg(value), 2) END AS value, CASE WHEN event_type = 'error' THEN 'unknown_metric' END AS reason FROM events GROUP BY event_type, observed"),
    "s13_sensor_records": (q_records, "WITH r AS (SELECT DISTINCT event_type, user_id, date_trunc('second', ts) AS at, value FROM events WHERE event_type <> 'error') SELECT event_type AS metric, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY event_type UNION ALL SELECT event_type, count(*), NULL FROM events WHERE event_type = 'error' GROUP BY event_type"),
    "s14_ledger": (q_ledger, "SELECT CAST(event_id AS VARCHAR) AS id, CASE event_id % 4 WHEN 0 THEN CAST(date_trunc('month', ts) AS DATE) WHEN 1 THEN NULL ELSE CAST(ts AS DATE) END AS start_earliest, CASE event_id % 4 WHEN 0 THEN last_day(CAST(ts AS DATE)) WHEN 1 THEN NULL ELSE CAST(ts AS DATE) END AS start_latest, concat_ws(',', CASE WHEN event_id % 9 = 0 THEN 'kind' END, CASE WHEN event_id % 4 = 1 THEN 'start' END) AS violations FROM events WHERE event_type = 'signup'"),
    "s15_documents": (q_documents, "WITH f AS (SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 2 = 0 THEN 'letter' ELSE 'other' END AS kind FROM documents), n AS (SELECT DISTINCT sha, kind FROM f), x AS (SELECT sha, max(CASE WHEN doc_id % 6 = 0 THEN 'me' END) AS signer FROM f WHERE doc_id % 3 = 0 GROUP BY sha) SELECT kind, CASE WHEN x.sha IS NULL THEN 'none' WHEN signer IS NULL THEN 'draft' ELSE 'verified' END AS status, count(*) AS n FROM n LEFT JOIN x USING (sha) WHERE (sha, kind) NOT IN (SELECT (sha, kind) FROM f WHERE doc_id % 4 = 1) GROUP BY ALL"),
    "s18_blobs_once": (q_blobs, "SELECT DISTINCT sha256(text) AS hash, strlen(text) AS size FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)"),
    "s1c_pointers": (q_pointers, "SELECT page_id, n AS name, CASE WHEN page_id % 2 = 0 THEN 'image/jpeg' END AS mime, CASE WHEN page_id % 3 > 0 THEN strlen(url) ELSE page_id END AS size, CASE WHEN page_id % 3 > 0 THEN sha256(url) END AS hash FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'Photo' || page_id || '.JPG' ELSE 'file-' || page_id || '.dat' END AS n FROM pages WHERE page_id % 4 <> 0)"),
    "s5a_inline_files": (q_inline, "SELECT page_id, 'image/png' AS mime, strlen(url)::INTEGER AS size, sha256(url) AS hash FROM pages WHERE page_id % 2 = 0 AND page_id % 5 <> 0"),
}
