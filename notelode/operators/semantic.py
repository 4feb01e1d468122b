"""Relational operators over the document store: joins, existence tests, latest rows, conflicts, co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelode.functions import text as X
from notelode.operators.blocks import sharing_enough
from notelode.plans.catalog import query
from notelode.plans.checkpoints import stored
from notelode.plans.store import blocks, bucket, change_log, claims, evidence, mentions, notes, objects, table, verifications, with_kinds
from notelode.plans.store import with_tables as W


@query(W("notes", "objects") + "SELECT o.name, o.kind, count(*) AS mention_count, count(DISTINCT m.doc_id) AS source_count, min(n.topic) AS first_topic FROM mentions m JOIN notes n USING (doc_id) JOIN objects o USING (name) WHERE o.status = 'active' GROUP BY ALL ORDER BY mention_count DESC, name LIMIT 25")
def top_objects(spark, sf_dir) -> DataFrame:
    """The most mentioned active objects, with the number of their documents."""
    m = mentions(spark, sf_dir).join(notes(spark, sf_dir).select("doc_id", "topic"), "doc_id")
    per = m.groupBy("name", "doc_id").agg(F.count("*").alias("n"), F.min("topic").alias("topic"))  # before the count of documents
    counts = per.groupBy("name").agg(F.sum("n").alias("mention_count"), F.count("*").alias("source_count"), F.min("topic").alias("first_topic"))
    return (
        with_kinds(counts).where("status = 'active'").orderBy(F.desc("mention_count"), "name").limit(25)
        .select("name", "kind", "mention_count", "source_count", "first_topic")
    )


@query(W("objects") + "SELECT o.name, o.kind, o.confidence, count(m.ordinal) AS mention_count, count(DISTINCT m.doc_id) AS source_count FROM objects o LEFT JOIN mentions m ON m.name = o.name AND ('0x' || substr(md5(m.name || '-' || m.doc_id), 1, 2))::int < 200 GROUP BY ALL")
def object_counts(spark, sf_dir) -> DataFrame:
    """Mentions and sources of every object; the filter on mentions stays in the join, so zeros are kept."""
    per = mentions(spark, sf_dir).groupBy("name", "doc_id").agg(F.count("*").alias("n"))
    active = bucket(F.concat_ws("-", "name", F.col("doc_id").cast("string"))) < 200
    counts = per.groupBy("name").agg(F.sum(F.when(active, F.col("n")).otherwise(0)).alias("mention_count"), F.count_if(active).alias("source_count"))
    return with_kinds(counts).select("name", "kind", "confidence", "mention_count", "source_count")


@query(W("objects") + ", c AS (SELECT o.*, coalesce(n, 0) AS n FROM objects o LEFT JOIN (SELECT name, count(*) AS n FROM mentions GROUP BY name) USING (name)) SELECT kind, count(*) FILTER (WHERE confidence < 0.6 AND n < 2) AS hidden, count(*) FILTER (WHERE NOT (confidence < 0.6 AND n < 2)) AS shown FROM c GROUP BY kind")
def low_frequency_hidden(spark, sf_dir) -> DataFrame:
    """Objects of low confidence that are mentioned once are hidden; how many, by kind."""
    n = mentions(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))
    hide = (F.col("confidence") < 0.6) & (F.coalesce("n", F.lit(0)) < 2)
    return objects(spark, sf_dir).join(n, "name", "left").groupBy("kind").agg(F.count_if(hide).alias("hidden"), F.count_if(~hide).alias("shown"))


@query(W("claims", "evidence", "notes") + "SELECT DISTINCT c.claim_id, n.path, n.topic FROM claims c JOIN evidence e ON e.claim_id = c.claim_id AND e.status = 'active' JOIN notes n USING (doc_id) WHERE c.status = 'active'")
def claim_sources(spark, sf_dir) -> DataFrame:
    """The different notes that hold active evidence of active claims."""
    e = evidence(spark, sf_dir).where("status = 'active'").select("claim_id", "doc_id")
    c = claims(spark, sf_dir).where("status = 'active'").select("claim_id")
    return e.join(c, "claim_id", "left_semi").join(notes(spark, sf_dir).select("doc_id", "path", "topic"), "doc_id").select("claim_id", "path", "topic").distinct()


@query(W("claims", "evidence", "notes") + "SELECT c.claim_id, c.status, coalesce(n.topic, '') AS topic FROM claims c LEFT JOIN (SELECT claim_id, min(doc_id) AS doc_id FROM evidence WHERE status = 'active' GROUP BY claim_id) e USING (claim_id) LEFT JOIN notes n USING (doc_id)")
def claim_snapshot(spark, sf_dir) -> DataFrame:
    """Every claim with the topic of its first active evidence, empty without any."""
    e = evidence(spark, sf_dir).where("status = 'active'").groupBy("claim_id").agg(F.min("doc_id").alias("doc_id"))
    rows = claims(spark, sf_dir).select("claim_id", "status").join(e, "claim_id", "left").join(notes(spark, sf_dir).select("doc_id", "topic"), "doc_id", "left")
    return rows.select("claim_id", "status", F.coalesce("topic", F.lit("")).alias("topic"))


@query(W("claims", "evidence") + "SELECT claim_id, status FROM claims c WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = c.claim_id AND e.status = 'active')")
def claims_with_evidence(spark, sf_dir) -> DataFrame:
    return claims(spark, sf_dir).select("claim_id", "status").join(evidence(spark, sf_dir).where("status = 'active'"), "claim_id", "left_semi")


@query(W("claims", "evidence") + "SELECT claim_id, 'no active evidence' AS reason FROM claims c WHERE status <> 'rejected' AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.claim_id = c.claim_id AND e.status = 'active')")
def orphan_claims(spark, sf_dir) -> DataFrame:
    """Claims to be invalidated, with the reason that goes to the log."""
    c = claims(spark, sf_dir).where("status <> 'rejected'").select("claim_id")
    return c.join(evidence(spark, sf_dir).where("status = 'active'"), "claim_id", "left_anti").withColumn("reason", F.lit("no active evidence"))


@query(W("objects") + "SELECT name, kind FROM objects o WHERE o.confidence >= 0.9 OR EXISTS (SELECT 1 FROM mentions m WHERE m.name = o.name AND m.ordinal = 0)")
def disjunctive_exists(spark, sf_dir) -> DataFrame:
    """Objects of high confidence, or mentioned in the first line of a document."""
    first = mentions(spark, sf_dir).where("ordinal = 0").select("name").distinct().withColumn("seen", F.lit(True))
    return objects(spark, sf_dir).join(first, "name", "left").where((F.col("confidence") >= 0.9) | F.col("seen")).select("name", "kind")


@query(W("claims", "verifications") + "SELECT c.claim_id, v.verdict FROM claims c LEFT JOIN (SELECT claim_id, verdict FROM verifications QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY checked_at DESC, ordinal DESC) = 1) v USING (claim_id)")
def latest_verdicts(spark, sf_dir) -> DataFrame:
    """Every claim with its latest verdict; the latest row is taken by one aggregate, before the join."""
    v = verifications(spark, sf_dir).groupBy("claim_id").agg(F.max_by("verdict", F.struct("checked_at", "ordinal")).alias("verdict"))
    return claims(spark, sf_dir).select("claim_id").join(v, "claim_id", "left")


@query(W("claims", "evidence", "verifications") + ", l AS (SELECT claim_id, verdict FROM verifications QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY checked_at DESC, ordinal DESC) = 1) SELECT c.claim_id, count(*) FILTER (WHERE e.status = 'active') AS active, count(*) FILTER (WHERE e.status = 'excluded') AS excluded, any_value(l.verdict) AS verdict FROM claims c JOIN evidence e USING (claim_id) LEFT JOIN l USING (claim_id) GROUP BY c.claim_id")
def claim_evidence_counts(spark, sf_dir) -> DataFrame:
    e = evidence(spark, sf_dir).groupBy("claim_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "excluded").alias("excluded"))
    return e.join(latest_verdicts(spark, sf_dir), "claim_id")


@query(W("claims", "evidence", "notes") + ", p AS (SELECT DISTINCT e.claim_id, n.path FROM evidence e JOIN notes n USING (doc_id) WHERE e.status = 'active'), c AS (SELECT claim_id, count(*) AS sources FROM p GROUP BY claim_id HAVING count(*) >= 2) SELECT claim_id, sources, path, rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY path) AS rank FROM p) JOIN c USING (claim_id) WHERE rank <= 5")
def evidence_lists(spark, sf_dir) -> DataFrame:
    """Of claims held by two notes or more the number of sources and the first five, as rows: no claim is one value.

    row_number() up to a bound keeps five a claim before the shuffle.
    """
    p = evidence(spark, sf_dir).where("status = 'active'").join(notes(spark, sf_dir).select("doc_id", "path"), "doc_id").select("claim_id", "path").distinct()
    counts = p.groupBy("claim_id").agg(F.count("*").alias("sources")).where("sources >= 2")
    first = p.withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy("path"))).where("rank <= 5")
    return first.join(counts, "claim_id").select("claim_id", "sources", "path", "rank")


_SETS = W("mentions") + ", d AS (SELECT DISTINCT doc_id, name FROM mentions), k AS (SELECT doc_id, count(*) AS n, md5(string_agg(name, ' ' ORDER BY name)) AS sig FROM d GROUP BY doc_id), rep AS (SELECT min(doc_id) AS doc_id, any_value(n) AS n, count(*) AS members FROM k GROUP BY sig), rd AS (SELECT d.* FROM d JOIN rep USING (doc_id))"


@query(_SETS + " SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared, CASE WHEN count(*) >= 5 THEN 90 + least(count(*), 10) ELSE 70 + count(*) END AS score FROM rd a JOIN rd b ON a.name = b.name AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 3")
def semantic_shares(spark, sf_dir) -> DataFrame:
    """Pairs of documents that share three object names or more, with the score of their tier.

    Documents with the very same names are one, so copies make no pairs among themselves.
    """
    pairs = overlapping(*distinct_sets(mentions(spark, sf_dir)), lambda n: F.lit(3))
    n = F.col("shared")
    return pairs.select("doc_a", "doc_b", "shared", F.when(n >= 5, 90 + F.least(n, F.lit(10))).otherwise(70 + n).alias("score"))


@query(_SETS + " SELECT doc_id, first, members FROM (SELECT k.doc_id, min(k.doc_id) OVER (PARTITION BY sig) AS first, count(*) OVER (PARTITION BY sig) AS members FROM k) WHERE members > 1")
def same_name_sets(spark, sf_dir) -> DataFrame:
    """Documents with the very same object names: who stands for them in semantic_shares and object_jaccard."""
    sets = mentions(spark, sf_dir).select("doc_id", "name").distinct().groupBy("doc_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("name")), " ")).alias("sig"))
    reps = sets.groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")).where("members > 1")
    return sets.join(reps, "sig").select("doc_id", "first", "members")


def distinct_sets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From found (doc_id, name): doc_id, n (names) of one document for each different set; and their rows doc_id, name, df."""
    sets = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("names"))  # the names of one document
    reps = stored(sets.groupBy(F.md5(F.array_join("names", " ")).alias("sig")).agg(F.min_by(F.struct("doc_id", "names"), "doc_id").alias("r")).select("r.*"))
    each = reps.select("doc_id", F.explode("names").alias("name"))
    df = each.groupBy("name").agg(F.count("*").alias("df"))
    return reps.select("doc_id", F.size("names").alias("n"), "names"), each.join(df, "name")


def overlapping(reps: DataFrame, sets: DataFrame, needed) -> DataFrame:
    """doc_a, doc_b, shared, n_a, n_b: pairs of sets that share needed(n) names or more for the n of either.

    Blocks of sets meet, and names are counted where they do (operators/blocks.py): hot names make no rows. Names are compared by
    hashes of 64 bits, of which ten million hold two alike in about three of a million tables.
    """
    del sets
    hashed = F.transform("names", lambda name: F.xxhash64(name))
    return sharing_enough(reps.select("doc_id", "n", needed(F.col("n")).cast("int").alias("need"), hashed.alias("names")))


@query(W("objects") + ", k AS (SELECT m.doc_id, m.ordinal, o.name, o.kind, o.confidence FROM mentions m JOIN objects o USING (name)) SELECT e.name AS entity, c.name AS concept, count(*) AS blocks, min(least(e.confidence, c.confidence)) AS confidence FROM k e JOIN k c ON e.doc_id = c.doc_id AND e.ordinal = c.ordinal WHERE e.kind = 'entity' AND c.kind = 'concept' GROUP BY ALL HAVING count(*) >= 2")
def entity_concept_edges(spark, sf_dir) -> DataFrame:
    """Entities and concepts that meet in two blocks or more; an edge has the lesser confidence."""
    k = mentions(spark, sf_dir).join(objects(spark, sf_dir), "name")
    e = k.where("kind = 'entity'").select("doc_id", "ordinal", F.col("name").alias("entity"), F.col("confidence").alias("x"))
    c = k.where("kind = 'concept'").select("doc_id", "ordinal", F.col("name").alias("concept"), F.col("confidence").alias("y"))
    return e.join(c, ["doc_id", "ordinal"]).groupBy("entity", "concept").agg(F.count("*").alias("blocks"), F.min(F.least("x", "y")).alias("confidence")).where("blocks >= 2")


_CO = ", k AS (SELECT m.doc_id, m.ordinal, o.name, o.kind, o.confidence FROM mentions m JOIN objects o USING (name) WHERE o.status = 'active'), p AS (SELECT a.name AS name_a, b.name AS name_b, a.kind = b.kind AS alike, least(a.confidence, b.confidence) AS c, count(*) AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.ordinal = b.ordinal AND a.name < b.name GROUP BY ALL)"


@query(W("objects") + _CO + " SELECT name_a, name_b, n AS blocks, round(CASE WHEN n >= 2 THEN least(0.99, c + 0.08 * n) ELSE c END, 4) AS weight FROM p WHERE CASE WHEN n >= 2 THEN least(0.99, c + 0.08 * n) >= 0.4 ELSE alike END")
def weighted_cooccurrence(spark, sf_dir) -> DataFrame:
    """Pairs of objects of one block: often together gains weight, once together counts for pairs of one kind only."""
    k = mentions(spark, sf_dir).join(objects(spark, sf_dir).where("status = 'active'"), "name")
    side = lambda s: k.select("doc_id", "ordinal", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "kind", "confidence")])
    p = side("a").join(side("b"), ["doc_id", "ordinal"]).where("name_a < name_b")
    p = p.groupBy("name_a", "name_b", (F.col("kind_a") == F.col("kind_b")).alias("alike"), F.least("confidence_a", "confidence_b").alias("c")).agg(F.count("*").alias("n"))
    often = F.least(F.lit(0.99), F.col("c") + 0.08 * F.col("n"))
    weight = F.when(F.col("n") >= 2, often).otherwise(F.col("c"))
    kept = F.when(F.col("n") >= 2, often >= 0.4).otherwise(F.col("alike"))
    return p.where(kept).select("name_a", "name_b", F.col("n").alias("blocks"), F.round(weight, 4).alias("weight"))


_STEM = """CASE WHEN length(name) > 3 AND regexp_full_match(name, '[a-z]+') THEN CASE WHEN name LIKE '%ies' AND length(name) > 4 THEN left(name, -3) || 'y' WHEN regexp_matches(name, '(sses|xes|zes|ches|shes)$') THEN left(name, -2) WHEN name LIKE '%s' AND NOT regexp_matches(name, '(ss|us|is|os|as)$') THEN left(name, -1) ELSE name END ELSE name END"""
_PRINTS = W("objects") + f", f AS (SELECT *, {_STEM} AS fingerprint FROM objects)"


@query(_PRINTS + " SELECT fingerprint, name AS keeper, confidence, n AS merged FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY confidence DESC, name) AS r, count(*) OVER (PARTITION BY fingerprint) AS n FROM f) WHERE r = 1 AND n > 1")
def fingerprint_merge(spark, sf_dir) -> DataFrame:
    """Objects of one fingerprint are merged into the one of highest confidence."""
    f = objects(spark, sf_dir).withColumn("fingerprint", X.name_fingerprint("name"))
    best = F.min_by(F.struct("name", "confidence"), F.struct(-F.col("confidence"), "name")).alias("b")
    return f.groupBy("fingerprint").agg(best, F.count("*").alias("merged")).where("merged > 1").select("fingerprint", F.col("b.name").alias("keeper"), F.col("b.confidence").alias("confidence"), "merged")


@query(_PRINTS + ", k AS (SELECT name, first_value(name) OVER (PARTITION BY fingerprint ORDER BY confidence DESC, name) AS keeper FROM f) SELECT keeper AS name, doc_id, ordinal FROM (SELECT DISTINCT k.keeper, m.doc_id, m.ordinal FROM mentions m JOIN k USING (name) WHERE m.name <> k.keeper)")
def moved_mentions(spark, sf_dir) -> DataFrame:
    """The mentions that merges by fingerprint move to another object, each once."""
    f = objects(spark, sf_dir).withColumn("fingerprint", X.name_fingerprint("name"))
    keeper = f.groupBy("fingerprint").agg(F.min_by("name", F.struct(-F.col("confidence"), "name")).alias("keeper"))
    moved = f.join(keeper, "fingerprint").where("name <> keeper").select("name", "keeper")
    return mentions(spark, sf_dir).join(moved, "name").select(F.col("keeper").alias("name"), "doc_id", "ordinal").distinct()


@query(_PRINTS + " SELECT name FROM f a WHERE EXISTS (SELECT 1 FROM f b WHERE b.fingerprint = a.fingerprint AND (b.confidence > a.confidence OR (b.confidence = a.confidence AND b.name < a.name)))")
def dominated_duplicates(spark, sf_dir) -> DataFrame:
    """Objects that a like-named one of higher confidence makes needless: all but the best of each fingerprint, which one
    aggregate finds before any shuffle of rows."""
    f = objects(spark, sf_dir).withColumn("fingerprint", X.name_fingerprint("name"))
    best = f.groupBy("fingerprint").agg(F.min_by("name", F.struct(-F.col("confidence"), "name")).alias("name"))
    return f.join(best.select("name"), "name", "left_anti").select("name")


_SIDES = W("claims", "evidence", "notes") + ", s AS (SELECT DISTINCT c.claim_id, c.direction, n.topic, substr(lower(c.statement), 1, 12) AS subject FROM claims c JOIN evidence e USING (claim_id) JOIN notes n USING (doc_id) WHERE c.status <> 'rejected')"


def claim_sides(spark, sf_dir) -> DataFrame:
    """claim_id, direction, topic, subject: what each claim says where."""
    s = evidence(spark, sf_dir).select("claim_id", "doc_id").distinct().join(claims(spark, sf_dir).where("status <> 'rejected'"), "claim_id").join(notes(spark, sf_dir).select("doc_id", "topic"), "doc_id")
    return s.select("claim_id", "direction", "topic", F.substring(F.lower("statement"), 1, 12).alias("subject")).distinct()


@query(_SIDES + ", r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY subject, topic, direction ORDER BY claim_id) <= 10) SELECT least(a.claim_id, b.claim_id) AS claim_a, greatest(a.claim_id, b.claim_id) AS claim_b, a.topic FROM r a JOIN r b ON a.subject = b.subject AND a.topic = b.topic WHERE a.direction = 'up' AND b.direction = 'down'")
def claim_conflicts(spark, sf_dir) -> DataFrame:
    """Claims on one subject and topic that say opposite things: the first ten of either side, so a hundred pairs at most."""
    return conflicts_of(claim_sides(spark, sf_dir))


def conflicts_of(sides: DataFrame, most: int = 10) -> DataFrame:
    """claim_a, claim_b, topic: pairs of the first ``most`` claims of either direction; conflict_classes tells of all."""
    w = Window.partitionBy("subject", "topic", "direction").orderBy("claim_id")
    few = sides.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    a, b = (few.where(F.col("direction") == d).select("subject", "topic", F.col("claim_id").alias(d)) for d in ("up", "down"))
    return a.join(b, ["subject", "topic"]).select(F.least("up", "down").alias("claim_a"), F.greatest("up", "down").alias("claim_b"), "topic")


@query(_SIDES + " SELECT subject, topic, count(*) FILTER (WHERE direction = 'up') AS up, count(*) FILTER (WHERE direction = 'down') AS down, min(claim_id) FILTER (WHERE direction = 'up') AS first_up, min(claim_id) FILTER (WHERE direction = 'down') AS first_down FROM s GROUP BY ALL HAVING count(DISTINCT direction) = 2")
def conflict_classes(spark, sf_dir) -> DataFrame:
    """Every subject and topic on which claims say opposite things, with the numbers of both sides: no pairs, none left out."""
    side = lambda d, f: f(F.when(F.col("direction") == d, F.col("claim_id")))
    c = claim_sides(spark, sf_dir).groupBy("subject", "topic").agg(*(side(d, f).alias(n) for d, f, n in (("up", F.count, "up"), ("down", F.count, "down"), ("up", F.min, "first_up"), ("down", F.min, "first_down"))))
    return c.where("up > 0 and down > 0")


@query(W("claims", "evidence", "notes", "objects") + "SELECT (SELECT count(*) FROM notes) AS n_notes, (SELECT count(*) FROM blocks) AS n_blocks, (SELECT count(*) FROM mentions) AS n_mentions, (SELECT count(*) FROM objects) AS n_objects, (SELECT count(*) FROM claims) AS n_claims, (SELECT count(*) FROM claims WHERE status = 'active') AS n_active, (SELECT max(ordinal) FROM blocks) AS longest")
def store_overview(spark, sf_dir) -> DataFrame:
    """Counts of the store's tables in one row."""
    one = lambda df, name, *more: df.agg(F.count("*").alias(name), *more)
    rows = one(notes(spark, sf_dir), "n_notes")
    for other in (
        one(blocks(spark, sf_dir), "n_blocks", F.max("ordinal").cast("long").alias("longest")),
        one(mentions(spark, sf_dir), "n_mentions"), one(objects(spark, sf_dir), "n_objects"),
        one(claims(spark, sf_dir), "n_claims", F.count_if(F.col("status") == "active").alias("n_active")),
    ):
        rows = rows.join(F.broadcast(other))  # one row each
    return rows


@query(W("notes") + "SELECT topic, count(*) AS n FROM notes WHERE topic = 'en' OR starts_with(topic, 'en > ') GROUP BY topic")
def topic_subtree(spark, sf_dir) -> DataFrame:
    """Notes of a topic and all topics below it."""
    t = F.col("topic")
    return notes(spark, sf_dir).where((t == "en") | t.startswith("en > ")).groupBy("topic").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT unnest([lang, lang || ' > ' || source]) AS topic FROM documents) SELECT topic, length(topic) - length(replace(topic, '>', '')) + 1 AS depth, count(*) AS files FROM t GROUP BY ALL")
def topic_tree(spark, sf_dir) -> DataFrame:
    """Every topic prefix with its depth and number of notes."""
    levels = F.split("topic", " > ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(levels)), lambda k: F.array_join(F.slice(levels, F.lit(1), k), " > "))
    t = notes(spark, sf_dir).select(F.explode(prefixes).alias("topic"))
    return t.groupBy("topic").agg(F.count("*").alias("files")).select("topic", F.size(F.split("topic", " > ")).cast("long").alias("depth"), "files")


@query(W("notes") + ", r AS (SELECT topic, doc_id // 1000 AS range, sha256(string_agg(doc_id || ':' || md5(body), ',' ORDER BY doc_id)) AS h FROM notes GROUP BY ALL) SELECT topic, sha256(string_agg(range || ':' || h, ',' ORDER BY range)) AS state FROM r GROUP BY topic")
def topic_state(spark, sf_dir) -> DataFrame:
    """A hash of each topic's ordered members and their contents, by ranges of a thousand ids: a hash of each range's members,
    then one of the ranges' hashes, so no task holds more than a range or a topic's ranges."""
    listed = lambda key, value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, value.alias("h")))), lambda x: F.concat_ws(":", x[key].cast("string"), x.h)), ",")
    ranges = notes(spark, sf_dir).groupBy("topic", F.floor(F.col("doc_id") / 1000).alias("range")).agg(F.sha2(listed("doc_id", F.md5("body")), 256).alias("h"))
    return ranges.groupBy("topic").agg(F.sha2(listed("range", F.col("h")), 256).alias("state"))


@query(W("blocks") + "SELECT hash, count(*) AS copies, count(DISTINCT doc_id) AS docs FROM blocks WHERE length(content) >= 100 GROUP BY hash HAVING count(*) > 1")
def duplicate_blocks(spark, sf_dir) -> DataFrame:
    b = blocks(spark, sf_dir).where(F.char_length("content") >= 100)
    return b.groupBy("hash").agg(F.count("*").alias("copies"), F.countDistinct("doc_id").alias("docs")).where("copies > 1")


@query(W("blocks") + ", k AS (SELECT doc_id, ordinal, row_number() OVER (PARTITION BY doc_id, lower(substr(content, 1, 80)) ORDER BY ordinal) AS seen, length(content) AS n FROM blocks) SELECT doc_id, count(*) FILTER (WHERE n < 60 AND seen > 3) AS dropped, count(*) FILTER (WHERE NOT (n < 60 AND seen > 3)) AS kept FROM k GROUP BY doc_id")
def repeated_short_lines(spark, sf_dir) -> DataFrame:
    """From the fourth time on, short lines of a document are dropped; lines left and dropped by document."""
    w = Window.partitionBy("doc_id", F.lower(F.substring("content", 1, 80))).orderBy("ordinal")
    b = blocks(spark, sf_dir).withColumn("seen", F.row_number().over(w))
    drop = (F.char_length("content") < 60) & (F.col("seen") > 3)
    return b.groupBy("doc_id").agg(F.count_if(drop).alias("dropped"), F.count_if(~drop).alias("kept"))


@query(W("change_log") + "SELECT change_kind, object_kind, count(*) AS n FROM change_log WHERE created_at >= (SELECT max(created_at) FROM change_log) - INTERVAL 7 DAY GROUP BY ALL")
def change_counts(spark, sf_dir) -> DataFrame:
    """Changes of the last seven days of the log, by kind."""
    c = change_log(spark, sf_dir)
    end = c.agg(F.max("created_at").alias("end"))
    recent = c.join(F.broadcast(end)).where("created_at >= end - interval 7 days")  # end: one row
    return recent.groupBy("change_kind", "object_kind").agg(F.count("*").alias("n"))


@query(W("change_log") + "SELECT change_kind, object_kind, count(*) AS n FROM change_log GROUP BY GROUPING SETS ((change_kind), (object_kind))")
def change_marginals(spark, sf_dir) -> DataFrame:
    c = change_log(spark, sf_dir)
    return c.groupingSets([[F.col("change_kind")], [F.col("object_kind")]], "change_kind", "object_kind").agg(F.count("*").alias("n"))


@query(W("change_log") + "SELECT id, change_kind, object_id FROM change_log ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50")
def recent_changes_page(spark, sf_dir) -> DataFrame:
    """The second page of fifty of the newest changes."""
    return change_log(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("id")).offset(50).limit(50).select("id", "change_kind", "object_id")


@query(W("change_log") + "SELECT object_kind, object_id, max(created_at) AS latest, arg_max(change_kind, id) AS last_kind, sum(json_extract(detail, '$.k')::bigint) AS k FROM change_log GROUP BY ALL")
def latest_changes(spark, sf_dir) -> DataFrame:
    """Of each object the latest change, and a sum over the JSON details."""
    k = F.get_json_object("detail", "$.k").cast("long")
    return change_log(spark, sf_dir).groupBy("object_kind", "object_id").agg(F.max("created_at").alias("latest"), F.max_by("change_kind", "id").alias("last_kind"), F.sum(k).alias("k"))


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def latest_order(spark, sf_dir) -> DataFrame:
    """Each customer with the latest order: the latest-row join at scale, as one aggregate and one join."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "c_name", "o.o_orderkey", "o.o_totalprice")
