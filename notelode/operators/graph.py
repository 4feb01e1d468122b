"""Graph views over the store: relations between chosen nodes, neighbours, focus graphs, candidate links and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelode.functions import text as X
from notelode.operators.containment import contained
from notelode.operators.links import _DEDUP, deduped
from notelode.operators.scored import best as most_of
from notelode.operators.scored import hits, query_blocks, text_blocks
from notelode.operators.semantic import _SETS, distinct_sets, overlapping
from notelode.plans.catalog import query
from notelode.plans.checkpoints import stored
from notelode.plans.store import blocks, claims, evidence, links, mentions, notes, objects, table, verifications, with_kinds
from notelode.plans.store import with_tables as W


def relations(spark, sf_dir) -> DataFrame:
    """source, source_kind, target, confidence, doc_id, ordinal: an entity and a concept that begin and end the names of a block."""
    m = mentions(spark, sf_dir).groupBy("doc_id", "ordinal").agg(F.min("name").alias("source"), F.max("name").alias("target")).where("source <> target")
    kind = lambda c: with_kinds(m.select(F.col(c).alias("name")).distinct()).select(F.col("name").alias(c), F.col("kind").alias(f"{c}_kind"), F.col("confidence").alias(f"{c}_confidence"))
    return m.join(kind("source"), "source").join(kind("target"), "target").withColumn("confidence", F.least("source_confidence", "target_confidence"))


_REL = W("objects") + ", rl AS (SELECT doc_id, ordinal, source, target, a.kind AS source_kind, b.kind AS target_kind, least(a.confidence, b.confidence) AS confidence FROM (SELECT doc_id, ordinal, min(name) AS source, max(name) AS target FROM mentions GROUP BY ALL HAVING min(name) <> max(name)) JOIN objects a ON a.name = source JOIN objects b ON b.name = target)"
_TOP = ", tp AS (SELECT name FROM mentions GROUP BY name ORDER BY count(*) DESC, name LIMIT 200)"


def top_nodes(spark, sf_dir, k: int = 200) -> DataFrame:
    return mentions(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k).select("name")


@query(_REL + _TOP + " SELECT source, target, count(*) AS blocks, round(max(confidence), 4) AS confidence FROM rl WHERE source IN (SELECT name FROM tp) AND target IN (SELECT name FROM tp) GROUP BY ALL")
def relation_edges(spark, sf_dir) -> DataFrame:
    """Relations of which both ends are among the two hundred most mentioned objects, by distinct block."""
    top = top_nodes(spark, sf_dir)
    r = relations(spark, sf_dir)
    for end in ("source", "target"):
        r = r.join(F.broadcast(top.withColumnRenamed("name", end)), end, "left_semi")  # two hundred rows
    return r.groupBy("source", "target").agg(F.count("*").alias("blocks"), F.round(F.max("confidence"), 4).alias("confidence"))


@query(_REL + _TOP + " SELECT m.name, count(DISTINCT m.doc_id) AS docs, count(*) AS blocks FROM mentions m JOIN tp USING (name) GROUP BY m.name")
def object_documents(spark, sf_dir) -> DataFrame:
    """Documents and blocks of each of the most mentioned objects."""
    per = mentions(spark, sf_dir).join(F.broadcast(top_nodes(spark, sf_dir)), "name", "left_semi").groupBy("name", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("name").agg(F.count("*").alias("docs"), F.sum("n").alias("blocks"))


@query(_REL + ", bo AS (SELECT source AS name, target AS other, confidence FROM rl UNION ALL SELECT target, source, confidence FROM rl) SELECT bo.name, count(*) AS relations, count(DISTINCT other) AS others, count(*) FILTER (WHERE o.kind = 'entity') AS entities, min(other) AS first FROM bo JOIN objects o ON o.name = other GROUP BY bo.name")
def object_detail(spark, sf_dir) -> DataFrame:
    """Relations of each object at either end, and the kinds of the other ends."""
    r = relations(spark, sf_dir)
    both = r.select(F.col("source").alias("name"), F.col("target").alias("other"), F.col("target_kind").alias("kind")).unionAll(r.select("target", "source", "source_kind"))
    return both.groupBy("name").agg(F.count("*").alias("relations"), F.countDistinct("other").alias("others"), F.count_if(F.col("kind") == "entity").alias("entities"), F.min("other").alias("first"))


@query(_REL + " SELECT doc_id, ordinal, CASE source_kind WHEN 'entity' THEN 'E:' || source ELSE 'C:' || source END AS source_label, CASE target_kind WHEN 'entity' THEN 'E:' || target ELSE 'C:' || target END AS target_label FROM rl")
def relation_labels(spark, sf_dir) -> DataFrame:
    """Both ends of each relation resolved over entities and concepts: one dimension of both kinds, one join an end."""
    label = lambda c: F.concat(F.when(F.col(f"{c}_kind") == "entity", "E:").otherwise("C:"), c)
    return relations(spark, sf_dir).select("doc_id", "ordinal", label("source").alias("source_label"), label("target").alias("target_label"))


@query(W("claims", "evidence", "notes") + ", cf AS (SELECT event_id, 'a' || user_id % 7 AS x, 'a' || event_type AS y FROM events), en AS (SELECT event_id, x AS e FROM cf UNION ALL SELECT event_id, y FROM cf), it AS (SELECT 'a' || (doc_id % 7) AS e, topic FROM notes) SELECT topic, count(DISTINCT event_id) AS pending FROM en JOIN (SELECT DISTINCT e, topic FROM it) USING (e) GROUP BY topic")
def pending_by_topic(spark, sf_dir) -> DataFrame:
    """Queue rows that have either of two ends in a topic, once a topic: both ends become rows of one equi-join."""
    ev = table(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.concat(F.lit("a"), F.col("user_id") % 7), F.concat(F.lit("a"), "event_type"))).alias("e"))
    items = notes(spark, sf_dir).select(F.concat(F.lit("a"), F.col("doc_id") % 7).alias("e"), "topic").distinct()
    return ev.join(items, "e").select("topic", "event_id").distinct().groupBy("topic").agg(F.count("*").alias("pending"))


@query(W("objects") + ", al AS (SELECT name, left(name, 8) AS alias, kind FROM objects) SELECT alias, kind, count(*) AS n, min(name) AS first, max(name) AS last FROM al GROUP BY ALL HAVING count(*) > 1")
def alias_duplicates(spark, sf_dir) -> DataFrame:
    """Objects of a kind that share an alias (the first eight letters): groups, not pairs."""
    o = objects(spark, sf_dir).withColumn("alias", F.substring("name", 1, 8))
    return o.groupBy("alias", "kind").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last")).where("n > 1")


@query(_REL + " SELECT 'relation' AS kind, count(*) AS n FROM (SELECT source AS name FROM rl UNION SELECT target FROM rl) WHERE name NOT IN (SELECT name FROM objects WHERE status = 'active') UNION ALL SELECT 'mention', count(*) FROM (SELECT DISTINCT name FROM mentions EXCEPT SELECT name FROM objects WHERE status = 'active')")
def dangling_ends(spark, sf_dir) -> DataFrame:
    """Names that relations or mentions have and active objects have not."""
    active = objects(spark, sf_dir).where("status = 'active'").select("name")
    r = relations(spark, sf_dir)
    ends = r.select(F.col("source").alias("name")).union(r.select("target")).distinct()
    count = lambda kind, df: df.subtract(active).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("relation", ends).union(count("mention", mentions(spark, sf_dir).select("name").distinct()))


@query(_REL + ", ob AS (SELECT DISTINCT doc_id, name FROM mentions WHERE doc_id % 100 = 0) SELECT r.doc_id, count(DISTINCT r.source || '>' || r.target) AS relations, (SELECT count(*) FROM ob WHERE ob.doc_id = r.doc_id) AS objects FROM (SELECT doc_id, source, target FROM rl WHERE doc_id % 100 = 0) r WHERE EXISTS (SELECT 1 FROM ob WHERE ob.doc_id = r.doc_id AND ob.name = r.source) AND EXISTS (SELECT 1 FROM ob WHERE ob.doc_id = r.doc_id AND ob.name = r.target) GROUP BY r.doc_id")
def note_context(spark, sf_dir) -> DataFrame:
    """Of the asked notes (ids divisible by 100) the objects, and the relations of which both ends are in the note."""
    ob = mentions(spark, sf_dir).where("doc_id % 100 = 0").select("doc_id", "name").distinct()
    r = relations(spark, sf_dir).where("doc_id % 100 = 0").select("doc_id", "source", "target").distinct()
    for end in ("source", "target"):
        r = r.join(ob.withColumnRenamed("name", end), ["doc_id", end], "left_semi")
    return r.groupBy("doc_id").agg(F.count("*").alias("relations")).join(ob.groupBy("doc_id").agg(F.count("*").alias("objects")), "doc_id")


# --- links ----------------------------------------------------------------------------------------------------------------


@query(W("links") + _DEDUP + ", vw AS (SELECT src AS file, dst AS other, 'out' AS direction, status FROM d UNION ALL SELECT dst, src, 'in', status FROM d) SELECT file, other, direction, status FROM vw WHERE file % 10 = 0 AND file < 1000")
def backlinks(spark, sf_dir) -> DataFrame:
    """Links of the asked files (ids below a thousand that end in 0) in both directions."""
    d = deduped(spark, sf_dir)
    view = lambda f, o, way: d.select(F.col(f).alias("file"), F.col(o).alias("other"), F.lit(way).alias("direction"), "status")
    return view("src", "dst", "out").unionAll(view("dst", "src", "in")).where("file % 10 = 0 and file < 1000")


@query(W("links") + " SELECT status, count(*) AS kept, count(*) FILTER (WHERE weight > 25) AS heavy FROM (SELECT DISTINCT src, dst, status, weight FROM links WHERE src <> dst AND status IN ('confirmed', 'pending') AND src::varchar LIKE '%7%') GROUP BY status")
def link_list(spark, sf_dir) -> DataFrame:
    """Links without self links and repeats, of two statuses, whose source has a 7: counts by status."""
    l = links(spark, sf_dir).where("src <> dst and status in ('confirmed', 'pending')").where(F.col("src").cast("string").contains("7"))  # noqa: E741
    return l.select("src", "dst", "status", "weight").distinct().groupBy("status").agg(F.count("*").alias("kept"), F.count_if(F.col("weight") > 25).alias("heavy"))


@query("WITH l AS (SELECT l_orderkey AS src, l_partkey AS dst, l_shipmode_or AS reason FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'weak: ' || l_linestatus WHEN 1 THEN 'topic: x' WHEN 2 THEN 'title' ELSE 'semantic' END AS l_shipmode_or FROM lineitem)) SELECT reason, count(*) AS kept FROM l WHERE NOT regexp_matches(reason, '^(weak|title)') GROUP BY reason")
def weak_link_purge(spark, sf_dir) -> DataFrame:
    """Links whose reason does not begin with a weak label."""
    k = F.col("l_linenumber") % 4
    reason = F.when(k == 0, F.concat(F.lit("weak: "), "l_linestatus")).when(k == 1, "topic: x").when(k == 2, "title").otherwise("semantic")
    return table(spark, sf_dir, "lineitem").select(reason.alias("reason")).where(~F.col("reason").rlike("^(weak|title)")).groupBy("reason").agg(F.count("*").alias("kept"))


@query(_SETS + ", sh AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM rd a JOIN rd b ON a.name = b.name AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 6), ex AS (SELECT l_orderkey AS x, l_partkey AS y FROM lineitem), ba AS (SELECT x, y FROM sh WHERE NOT EXISTS (SELECT 1 FROM ex WHERE (ex.x = sh.x AND ex.y = sh.y) OR (ex.x = sh.y AND ex.y = sh.x))) SELECT x AS src, y AS dst FROM ba UNION ALL SELECT y, x FROM ba")
def backfilled_links(spark, sf_dir) -> DataFrame:
    """Documents that share six object names or more and are not linked in either direction get links both ways."""
    reps, sets = distinct_sets(mentions(spark, sf_dir))
    pairs = overlapping(reps, sets, lambda n: F.lit(6)).select(F.col("doc_a").alias("x"), F.col("doc_b").alias("y"))
    li = table(spark, sf_dir, "lineitem")
    known = li.select(F.least("l_orderkey", "l_partkey").alias("x"), F.greatest("l_orderkey", "l_partkey").alias("y")).distinct()
    ways = F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst")))
    return pairs.join(known, ["x", "y"], "left_anti").select(F.inline(ways))


_TITLES = "ti AS (SELECT page_id, lower(replace(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' '), ' ', '')) AS title FROM pages), bd AS (SELECT page_id, lower(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', '', 'g')) AS body FROM pages)"


def page_titles(spark, sf_dir) -> DataFrame:
    """page_id, title (lower case, without spaces), words (of the title)."""
    t = F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.replace(t, F.lit(" "), F.lit(""))).alias("title"), t.alias("t"))


@query("WITH " + _TITLES + " SELECT a.page_id AS src, b.page_id AS dst FROM bd a JOIN ti b ON a.page_id <> b.page_id AND length(b.title) >= 2 AND contains(a.body, b.title)")
def title_mentions(spark, sf_dir) -> DataFrame:
    """Pages whose text holds another page's title, spaces aside; different titles are looked for once (operators/containment.py)."""
    t = page_titles(spark, sf_dir).where(F.char_length("title") >= 2).select(F.col("page_id").alias("dst"), F.col("title").alias("pattern"))
    body = F.lower(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), r"\s+", ""))
    held = contained(table(spark, sf_dir, "pages").select(F.col("page_id").alias("text_id"), body.alias("body")), t)
    return held.withColumnRenamed("text_id", "src").join(t, "pattern").where("src <> dst").select("src", "dst")


@query("WITH nt AS (SELECT doc_id, source AS topic, [lang] AS tags, list_distinct(list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1, 6)) AS title FROM documents), p1 AS (SELECT a.doc_id AS x, b.doc_id AS y, 1 AS pr FROM nt a JOIN nt b ON a.topic = b.topic AND a.doc_id < b.doc_id WHERE a.doc_id % 20 = 0), tk AS (SELECT doc_id, unnest(title) AS w FROM nt WHERE len(tags) = 0 OR doc_id % 3 = 0), p3 AS (SELECT a.doc_id AS x, b.doc_id AS y, 3 AS pr FROM tk a JOIN tk b ON a.w = b.w AND a.doc_id < b.doc_id WHERE a.doc_id % 20 = 0 AND length(a.w) >= 4 GROUP BY ALL HAVING count(*) >= 2), al AS (SELECT x, y, min(pr) AS priority FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p3) GROUP BY ALL) SELECT x, y, priority FROM al ORDER BY priority, x, y LIMIT 200")
def link_candidates(spark, sf_dir) -> DataFrame:
    """The first two hundred pairs worth a link, by priority: one topic, or two words of the titles where tags say nothing;
    the first of a pair is an asked note (ids divisible by 20). Each reason is an equi-join of its own."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic"), F.array_distinct(F.slice(X.words("text"), 1, 6)).alias("title"))
    side = lambda df, c, n: df.select(F.col("doc_id").alias(n), c)
    one = side(d.where("doc_id % 20 = 0"), "topic", "x").join(side(d, "topic", "y"), "topic").where("x < y").select("x", "y", F.lit(1).alias("pr"))
    w = d.where("doc_id % 3 = 0").select("doc_id", F.explode("title").alias("w")).where(F.char_length("w") >= 4)
    three = side(w.where("doc_id % 20 = 0"), "w", "x").join(side(w, "w", "y"), "w").where("x < y").groupBy("x", "y").agg(F.count("*").alias("n")).where("n >= 2")
    return one.unionAll(three.select("x", "y", F.lit(3))).groupBy("x", "y").agg(F.min("pr").alias("priority")).orderBy("priority", "x", "y").limit(200)


@query("WITH e AS (SELECT vec_id, embedding::double[] AS e FROM embeddings), n AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_dot_product(a.e, b.e), 4) AS s FROM e a, e b WHERE a.vec_id <> b.vec_id AND round(list_dot_product(a.e, b.e), 4) >= 0.3 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) <= 6), g AS (SELECT least(x, y) AS a, greatest(x, y) AS b, max(s) AS score FROM n GROUP BY ALL), fo AS (SELECT vec_id FROM e WHERE vec_id % 50 = 0), nd AS (SELECT vec_id FROM fo UNION SELECT b FROM g WHERE a IN (SELECT vec_id FROM fo) UNION SELECT a FROM g WHERE b IN (SELECT vec_id FROM fo)) SELECT a, b, score FROM g WHERE a IN (SELECT vec_id FROM nd) AND b IN (SELECT vec_id FROM nd)")
def focus_graph(spark, sf_dir) -> DataFrame:
    """The chunks in focus (ids divisible by 50), their neighbours, and all edges between these."""
    from notelode.operators.hybrid import similarity_graph

    g = stored(similarity_graph(spark, sf_dir))
    focus = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select("vec_id")
    beside = lambda a, b: g.join(focus.withColumnRenamed("vec_id", a), a, "left_semi").select(F.col(b).alias("vec_id"))
    nodes = focus.union(beside("a", "b")).union(beside("b", "a")).distinct()
    for end in ("a", "b"):
        g = g.join(nodes.withColumnRenamed("vec_id", end), end, "left_semi")
    return g.select("a", "b", "score")


# --- context of a question ----------------------------------------------------------------------------------------------

_ASKED = "qs AS (SELECT doc_id AS query_id, list_distinct(list_filter(list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 2, 9), lambda w: length(w) >= 2)) AS terms FROM documents WHERE doc_id % 100 = 0), qt AS (SELECT query_id, len(terms) AS size, unnest(terms) AS term FROM qs)"


def asked(spark, sf_dir) -> DataFrame:
    """query_id, size, term: the different words of two letters or more among the 2nd to 9th of each asked document."""
    terms = F.array_distinct(F.filter(F.slice(X.words("text"), 2, 8), lambda w: F.char_length(w) >= 2))
    d = table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), terms.alias("terms"))
    return d.select("query_id", F.size("terms").cast("long").alias("size"), F.explode("terms").alias("term"))


@query(W("claims", "verifications") + ", " + _ASKED + ", ct AS (SELECT claim_id, unnest(list_distinct(regexp_extract_all(lower(statement), '[\\p{L}\\p{N}_]+'))) AS term FROM claims WHERE status = 'active'), sc AS (SELECT query_id, claim_id, count(*) AS common, round(count(*) / any_value(size), 4) AS score FROM qt JOIN ct USING (term) GROUP BY ALL HAVING count(*) >= 2 OR count(*) / any_value(size) >= 0.22), tp AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, claim_id) <= 3), lv AS (SELECT claim_id, verdict FROM verifications QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY checked_at DESC, ordinal DESC) = 1) SELECT query_id, claim_id, common, score, verdict FROM tp LEFT JOIN lv USING (claim_id)")
def claim_context(spark, sf_dir) -> DataFrame:
    """The three claims that share most words with each question (two, or 22 % of them, at least), with their latest verdict."""
    c = claims(spark, sf_dir).where("status = 'active'").select(F.col("claim_id").alias("id"), F.col("statement").alias("text"))
    terms = stored(asked(spark, sf_dir))
    words = query_blocks(terms.select("query_id", F.xxhash64("term").alias("term"), F.lit(1.0).alias("weight")))
    s = hits(words, text_blocks(c, once=True), most_of(3, 0), "doc_id string, score double").select("query_id", F.col("doc_id").alias("claim_id"), F.col("score").cast("long").alias("common"))
    # all claims of a query are measured by one size, so those of most words are first, and what is too little comes last
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("common"), "claim_id"))).where("r <= 3").drop("r")
    top = top.join(terms.select("query_id", "size").distinct(), "query_id").where((F.col("common") >= 2) | (F.col("common") / F.col("size") >= 0.22))
    top = stored(top.withColumn("score", F.round(F.col("common") / F.col("size"), 4)))
    v = verifications(spark, sf_dir, top.select("claim_id")).groupBy("claim_id").agg(F.max_by("verdict", F.struct("checked_at", "ordinal")).alias("verdict"))
    return top.join(v, "claim_id", "left").select("query_id", "claim_id", "common", "score", "verdict")


_SAYS = ", mc AS (SELECT name, count(*) AS n FROM mentions GROUP BY name), ok AS (SELECT o.name, kind FROM objects o JOIN mc USING (name) WHERE NOT (confidence < 0.6 AND n < 2)), de AS (SELECT name, substr(min(content), 1, 120) AS says FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(content), '\\p{L}{8,}')) AS name, content FROM blocks) GROUP BY name), ot AS (SELECT DISTINCT name, kind, term, term = name AS own FROM (SELECT name, kind, unnest(list_append(regexp_extract_all(lower(says), '[\\p{L}\\p{N}_]+'), name)) AS term FROM ok JOIN de USING (name)) WHERE length(term) >= 2)"


@query(W("objects") + ", " + _ASKED + _SAYS + ", qx AS (SELECT query_id, string_agg(term, ' ' ORDER BY term) AS text FROM qt GROUP BY query_id), al AS (SELECT query_id, name, kind, 1.0::double AS score FROM qx JOIN ok ON contains(qx.text, ok.name) UNION ALL SELECT query_id, name, kind, round(0.5 * count(*) / any_value(size) + 0.5 * count(*) FILTER (WHERE own) / any_value(size), 4) FROM qt JOIN ot USING (term) GROUP BY ALL HAVING count(*) >= 2 OR count(*) / any_value(size) >= 0.25), bs AS (SELECT query_id, name, kind, max(score) AS score FROM al GROUP BY ALL) SELECT query_id, name, kind, score FROM bs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, name) <= 4")
def object_context(spark, sf_dir) -> DataFrame:
    """The four objects most relevant to each question, rare ones of low confidence aside.

    An object whose name stands in the question scores 1. Others need two words in common with the question, or a quarter of its
    words, in their name and the first 120 characters of what is said of them (their first block by text); name and both together count half each.
    """
    terms = stored(asked(spark, sf_dir))
    found = stored(mentions(spark, sf_dir))
    good = stored(with_kinds(found.groupBy("name").agg(F.count("*").alias("n"))).where("not (confidence < 0.6 and n < 2)").select("name", "kind"))
    texts = terms.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("body"))  # eight words at most
    held = contained(texts.select(F.col("query_id").alias("text_id"), "body"), good.select(F.col("name").alias("pattern")))
    named = held.select(F.col("text_id").alias("query_id"), F.col("pattern").alias("name")).join(good, "name").select("query_id", "name", "kind", F.lit(1.0).alias("score"))

    says = found.join(blocks(spark, sf_dir).select("doc_id", "ordinal", "content"), ["doc_id", "ordinal"]).groupBy("name").agg(F.substring(F.min("content"), 1, 120).alias("says"))
    words = F.explode(F.array_distinct(F.concat(X.words("says"), F.array("name"))))
    parts = good.join(says, "name").select("name", "kind", words.alias("term")).where(F.char_length("term") >= 2)
    common, own, size = F.count("*"), F.count(F.when(F.col("term") == F.col("name"), 1)), F.first("size")
    near = terms.join(parts, "term").groupBy("query_id", "name", "kind").agg(common.alias("common"), own.alias("own"), size.alias("size"))
    near = near.where((F.col("common") >= 2) | (F.col("common") / F.col("size") >= 0.25))
    score = F.round(0.5 * F.col("common") / F.col("size") + 0.5 * F.col("own") / F.col("size"), 4)
    best = named.unionByName(near.select("query_id", "name", "kind", score.alias("score"))).groupBy("query_id", "name", "kind").agg(F.max("score").alias("score"))
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "kind", "name"))).where("r <= 4")
    return top.drop("r")


_HITS = ", hi AS (SELECT query_id, doc_id, rank FROM (SELECT d.doc_id + 0 AS query_id, l.l_partkey AS doc_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY max(l_extendedprice) DESC, l.l_partkey) AS rank FROM documents d JOIN lineitem l ON l.l_suppkey = d.doc_id WHERE l_partkey IN (SELECT doc_id FROM documents) GROUP BY d.doc_id, l.l_partkey) WHERE rank <= 5)"


@query(W("links") + _DEDUP + _HITS + ", cn AS (SELECT src AS item, dst AS other FROM d WHERE status = 'confirmed' UNION SELECT dst, src FROM d WHERE status = 'confirmed'), ne AS (SELECT query_id, other AS doc_id, min(rank) AS via FROM hi JOIN cn ON cn.item = hi.doc_id WHERE other IN (SELECT doc_id FROM documents) GROUP BY ALL), nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY via, doc_id) AS r FROM ne WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM hi)) SELECT query_id, doc_id, 'hit' AS kind, rank AS place FROM hi UNION ALL SELECT query_id, doc_id, 'backlink', 5 + r FROM nn WHERE r <= 4")
def expanded_context(spark, sf_dir) -> DataFrame:
    """A query's hits, then up to four documents linked with them, in the order of the hits; each document once."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.max("l_extendedprice").alias("p"))
    hits = li.join(d, "doc_id", "left_semi").join(d.withColumnRenamed("doc_id", "query_id"), "query_id", "left_semi")
    hits = stored(hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p"), "doc_id"))).where("rank <= 5").drop("p"))
    c = deduped(spark, sf_dir).where("status = 'confirmed'")
    linked = c.select(F.col("src").alias("doc_id"), F.col("dst").alias("other")).union(c.select("dst", "src")).distinct()
    near = hits.join(linked, "doc_id").groupBy("query_id", F.col("other").alias("doc_id")).agg(F.min("rank").alias("via")).join(d, "doc_id", "left_semi")
    near = near.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("via", "doc_id"))).where("r <= 4")
    return hits.select("query_id", "doc_id", F.lit("hit").alias("kind"), F.col("rank").alias("place")).unionAll(near.select("query_id", "doc_id", F.lit("backlink"), F.col("r") + 5))


@query(W("claims", "evidence", "notes") + ", s AS (SELECT claim_id, doc_id FROM evidence WHERE status = 'active') SELECT s.claim_id, n.path, substr(trim(n.body), 1, 20) AS title FROM s JOIN notes n USING (doc_id) JOIN claims c USING (claim_id) WHERE c.status = 'disputed' GROUP BY ALL")
def disputed_sources(spark, sf_dir) -> DataFrame:
    """Title and path of the different sources of disputed claims."""
    e = evidence(spark, sf_dir).where("status = 'active'").select("claim_id", "doc_id").distinct()
    c = claims(spark, sf_dir).where("status = 'disputed'").select("claim_id")
    n = notes(spark, sf_dir).select("doc_id", "path", F.substring(F.trim("body"), 1, 20).alias("title"))
    return e.join(c, "claim_id", "left_semi").join(n, "doc_id").select("claim_id", "path", "title").distinct()


@query(W("blocks") + " SELECT doc_id, count(*) AS failed, min(ordinal) AS first FROM blocks WHERE ('0x' || substr(hash, 1, 2))::int < 16 GROUP BY doc_id ORDER BY failed DESC, doc_id LIMIT 50")
def documents_to_retry(spark, sf_dir) -> DataFrame:
    """The fifty documents with most failed blocks."""
    failed = blocks(spark, sf_dir).where(F.conv(F.substring("hash", 1, 2), 16, 10).cast("int") < 16)
    return failed.groupBy("doc_id").agg(F.count("*").alias("failed"), F.min("ordinal").cast("long").alias("first")).orderBy(F.desc("failed"), "doc_id").limit(50)


@query(_SETS + ", sh AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM rd a JOIN rd b ON a.name = b.name AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 3), sc AS (SELECT x, y, CASE WHEN n >= 5 THEN 90 + least(n, 10) ELSE 70 + n END AS score, 'objects' AS reason FROM sh UNION ALL SELECT least(l_orderkey, l_partkey), greatest(l_orderkey, l_partkey), 60, 'link' FROM lineitem WHERE l_orderkey <> l_partkey), di AS (SELECT x AS src, y AS dst, score, reason FROM sc UNION ALL SELECT y, x, score, reason FROM sc) SELECT src, dst, max(score) AS score, min(reason) AS reasons FROM di WHERE src % 20 = 0 GROUP BY ALL")
def cross_references(spark, sf_dir) -> DataFrame:
    """What the asked documents (ids divisible by 20) may refer to, with the best score over all reasons."""
    reps, sets = distinct_sets(mentions(spark, sf_dir))
    n = F.col("shared")
    score = F.when(n >= 5, 90 + F.least(n, F.lit(10))).otherwise(70 + n)
    shares = overlapping(reps, sets, lambda n: F.lit(3)).where("doc_a % 20 = 0 or doc_b % 20 = 0").select(F.col("doc_a").alias("x"), F.col("doc_b").alias("y"), score.alias("score"), F.lit("objects").alias("reason"))
    li = table(spark, sf_dir, "lineitem").where("l_orderkey <> l_partkey")
    every = shares.unionAll(li.select(F.least("l_orderkey", "l_partkey"), F.greatest("l_orderkey", "l_partkey"), F.lit(60).cast("long"), F.lit("link")))
    ways = every.select(F.explode(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("dst")), F.struct(F.col("y").alias("src"), F.col("x").alias("dst")))).alias("w"), "score", "reason")
    return ways.where("w.src % 20 = 0").groupBy("w.src", "w.dst").agg(F.max("score").alias("score"), F.min("reason").alias("reasons"))
