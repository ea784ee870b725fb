"""Readers of items: landed pages of bookmarks and bibliographies, notes, and archives of two social networks.

Each gives kind, external_id, title, url, doi, created_at, updated_at, text, tags, meta (a JSON text of what else is known).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import values
from mnemospark.functions.keys import content_id, repaired, stripped, title_of

# The longest texts kept of a bookmark and of a note, and entries of a bibliography that are no works.
BOOKMARK_TEXT, NOTE_TEXT = 10_000, 50_000
NO_WORKS = ["attachment", "note", "annotation"]

BOOKMARKS = "bookmarks array<struct<id:string, createdAt:string, modifiedAt:string, title:string, note:string, summary:string, favourited:boolean, archived:boolean, tags:array<struct<name:string>>, content:struct<type:string, url:string, title:string, description:string, text:string>>>, nextCursor string"
WORKS = "key string, data struct<itemType:string, title:string, DOI:string, url:string, abstractNote:string, creators:array<struct<name:string, firstName:string, lastName:string>>, tags:array<struct<tag:string>>, dateAdded:string, dateModified:string, date:string, publicationTitle:string>"
POSTS = "array<struct<tweet:struct<id_str:string, full_text:string, created_at:string, in_reply_to_status_id_str:string, entities:struct<urls:array<struct<expanded_url:string>>>>, like:struct<tweetId:string, fullText:string, expandedUrl:string>, bookmark:struct<tweetId:string, fullText:string, expandedUrl:string>>>"
OWN_POSTS = "timestamp long, title string, data array<struct<post:string>>, attachments array<struct<data:array<struct<external_context:struct<url:string>>>>>"
COMMENTS = "comments_v2 array<struct<timestamp:long, title:string, data:array<struct<comment:struct<timestamp:long, comment:string, author:string>>>>>"


def _filled(*values) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.when(F.length(v) > 0, v) for v in values))


def _items(df: DataFrame, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    of = {"kind": none, "external_id": none, "title": none, "url": none, "doi": none, "created_at": none.cast("timestamp"), "updated_at": none.cast("timestamp"), "text": none, "tags": F.array().cast("array<string>"), "meta": F.lit("{}")}
    return df.select(*({**of, **columns}[c].alias(c) for c in of))


def _capped(value: Column, most: int | None) -> Column:
    return value if most is None else F.left(value, F.lit(most))


def read_bookmarks(spark: SparkSession, path: str, most: int | None = BOOKMARK_TEXT) -> DataFrame:
    """Pages of a bookmark service. Where pages overlap, a bookmark's newest form counts.

    most: characters kept of each text; None keeps all.
    """
    raw = spark.read.schema(BOOKMARKS).option("multiLine", True).json(path).select(F.explode("bookmarks").alias("b")).where("b.id IS NOT NULL")
    b, c = F.col("b"), F.col("b.content")
    cap = lambda v: _capped(F.nullif(v, F.lit("")), most)
    stamp = lambda v: v.try_cast("timestamp")
    meta = F.to_json(F.struct(c["type"].alias("type"), cap(c["description"]).alias("description"), cap(b["note"]).alias("note"), cap(b["summary"]).alias("summary"), F.when(b["favourited"], True).alias("favourited"), F.when(b["archived"], True).alias("archived")))
    tags = F.filter(F.transform(F.coalesce(b["tags"], F.array()), lambda t: t["name"]), lambda t: F.length(t) > 0)
    items = _items(raw, kind=F.lit("bookmark"), external_id=b["id"], title=F.left(_filled(b["title"], c["title"], c["url"], cap(c["text"])), F.lit(200)), url=c["url"], created_at=stamp(b["createdAt"]), updated_at=F.coalesce(stamp(b["modifiedAt"]), stamp(b["createdAt"])), text=cap(c["text"]), tags=tags, meta=meta)
    return items.groupBy("external_id").agg(F.max_by(F.struct(*items.columns), F.struct("updated_at", "meta")).alias("r")).select("r.*")


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a bibliography service; attachments, notes and annotations are no works."""
    raw = spark.read.schema(WORKS).option("multiLine", True).json(path).where(F.col("key").isNotNull() & ~F.coalesce(F.col("data.itemType").isin(NO_WORKS), F.lit(False)))
    d = F.col("data")
    part = lambda v: F.nullif(stripped(v), F.lit(""))
    people = F.filter(F.transform(F.coalesce(d["creators"], F.array()), lambda p: F.coalesce(part(p["name"]), F.concat_ws(" ", part(p["firstName"]), part(p["lastName"])))), lambda p: p != "")
    tags = F.filter(F.transform(F.coalesce(d["tags"], F.array()), lambda t: t["tag"]), lambda t: F.length(t) > 0)
    none = F.lit("")
    meta = F.to_json(F.struct(d["itemType"].alias("itemType"), people.alias("creators"), F.nullif(d["publicationTitle"], none).alias("publication"), F.nullif(d["date"], none).alias("date")))
    return _items(raw, kind=F.lit("reference"), external_id=F.col("key"), title=F.nullif(d["title"], none), url=F.nullif(d["url"], none), doi=F.nullif(d["DOI"], none), created_at=d["dateAdded"].try_cast("timestamp"), updated_at=d["dateModified"].try_cast("timestamp"), text=F.nullif(d["abstractNote"], none), tags=tags, meta=meta)


def read_notes(spark: SparkSession, root: str, folders: list[str], most: int | None = NOTE_TEXT) -> DataFrame:
    """Markdown files below some folders of a tree; paths with a hidden part don't count.

    most: characters kept of each note; None keeps all.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:")
    place = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    rows = raw.withColumn("_p", F.coalesce(F.try_url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))), place)).where(~F.col("_p").rlike(r"(^|/)\."))
    inside = F.lit(False)
    for folder in folders:
        inside = inside | F.col("_p").startswith(folder.rstrip("/") + "/")
    text = _capped(F.make_valid_utf8(F.col("content").cast("string")), most)
    return _items(rows.where(inside), kind=F.lit("note"), external_id=F.col("_p"), title=F.regexp_extract("_p", r"([^/]+)\.md$", 1), created_at=F.col("modificationTime"), updated_at=F.col("modificationTime"), text=text, meta=F.to_json(F.struct(F.regexp_extract("_p", "^(.*)/[^/]*$", 1).alias("folder"))))


def read_wrapped_posts(spark: SparkSession, path: str) -> DataFrame:
    """An archive of one social network: JSON arrays behind an assignment, in files of posts, likes and bookmarks.

    Posts without text go, likes and bookmarks without text stay. Files of other names are not read.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "{tweet,like,bookmark}*.js").text(path).select("value", F.col("_metadata.file_name").alias("_f")).where(F.col("_f").rlike(r"^(tweets?|likes?|bookmarks?)(-part\d+)?\.js$"))
    rows = raw.select(F.explode(F.from_json(F.substr("value", F.instr("value", "=") + 1), POSTS)).alias("e"))
    t = F.col("e.tweet")
    page = lambda i: F.concat(F.lit("https://x.com/i/status/"), i)
    links = F.filter(F.transform(F.coalesce(t["entities"]["urls"], F.array()), lambda u: u["expanded_url"]), lambda u: F.length(u) > 0)
    time = values.instant(t["created_at"])
    reply = t["in_reply_to_status_id_str"]
    meta = F.to_json(F.struct(F.when(reply.isNotNull(), "reply").otherwise("post").alias("post_type"), links.alias("links"), page(reply).alias("reply_to_url")))
    posts = _items(rows.where(t["id_str"].isNotNull() & (stripped(F.coalesce(t["full_text"], F.lit(""))) != "")), kind=F.lit("social_post"), external_id=F.concat(F.lit("x:"), t["id_str"]), title=title_of(t["full_text"], 80, ""), url=F.coalesce(F.get(links, F.lit(0)), page(t["id_str"])), created_at=time, updated_at=time, text=t["full_text"], meta=meta)
    for name in ("like", "bookmark"):
        k = F.col(f"e.{name}")
        posts = posts.unionByName(_items(rows.where(k["tweetId"].isNotNull()), kind=F.lit("bookmark"), external_id=F.concat(F.lit(f"x{name}:"), k["tweetId"]), title=title_of(F.coalesce(k["fullText"], F.lit("")), 80, ""), url=_filled(k["expandedUrl"], page(k["tweetId"])), text=k["fullText"], meta=F.to_json(F.struct(F.lit(name).alias("post_type")))))
    return posts


def distinct_authors(said: DataFrame, *by: str) -> DataFrame:
    """How many authors rows have, of all or by columns. Two are an alarm, so the count is exact; blank names are none."""
    return said.where(F.length("author") > 0).groupBy(*by).agg(F.count_distinct("author").alias("comment_authors"))


def read_own_posts(spark: SparkSession, posts: str, comments: str) -> tuple[DataFrame, DataFrame]:
    """The posts and comments of another network's archive, texts read in their right charset; and how many authors the
    comments have, which is one unless the archive has others' as well."""
    raw = spark.read.schema(OWN_POSTS).option("multiLine", True).json(posts)
    texts = F.filter(F.transform(F.coalesce("data", F.array()), lambda d: repaired(d["post"])), lambda t: stripped(t) != "")
    urls = F.filter(F.flatten(F.transform(F.coalesce("attachments", F.array()), lambda a: F.transform(F.coalesce(a["data"], F.array()), lambda d: repaired(d["external_context"]["url"])))), lambda u: F.length(u) > 0)
    rows = raw.select("timestamp", F.array_join(texts, "\n").alias("t"), urls.alias("u")).where("t <> ''")
    time = F.timestamp_seconds(F.col("timestamp"))
    own = _items(rows, kind=F.lit("social_post"), external_id=content_id("fb:", F.col("timestamp"), F.col("t")), title=title_of(F.col("t"), 80, ""), url=F.get("u", F.lit(0)), created_at=time, updated_at=time, text=F.col("t"), meta=F.to_json(F.struct(F.lit("post").alias("post_type"), F.col("u").alias("links"))))
    said = spark.read.schema(COMMENTS).option("multiLine", True).json(comments).select(F.explode("comments_v2").alias("e")).select("e.timestamp", "e.title", F.explode("e.data").alias("d")).where("d.comment IS NOT NULL")
    c = F.col("d.comment")
    text, at = repaired(c["comment"]), F.coalesce(c["timestamp"], F.col("timestamp"))
    meta = F.to_json(F.struct(F.lit("comment").alias("post_type"), repaired(F.coalesce("title", F.lit(""))).alias("reply_to_context")))
    answers = _items(said.where(stripped(F.coalesce(c["comment"], F.lit(""))) != ""), kind=F.lit("social_post"), external_id=content_id("fbcomment:", at, text), title=title_of(text, 80, ""), created_at=F.timestamp_seconds(at), updated_at=F.timestamp_seconds(at), text=text, meta=meta)
    authors = distinct_authors(said.select(c["author"].alias("author")))
    return own.unionByName(answers), authors
