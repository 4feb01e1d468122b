"""Incremental maintenance as functions of an old and a new snapshot: blocks, extractions, chunks, merges, queues, audits.

Each gives the next snapshot or the changes as a DataFrame; a sink writes it. Old and new states are made from the base
tables by hashes, alike in Spark and SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelode.functions import text as X
from notelode.plans.catalog import query
from notelode.plans.checkpoints import stored
from notelode.plans.store import blocks, bucket, claims, evidence, mentions, notes, objects, table, verifications, with_kinds
from notelode.plans.store import with_tables as W

_H = "('0x' || substr(md5({}), 1, 2))::int"
_OLD = W("blocks") + f", od AS (SELECT doc_id, ordinal, hash FROM blocks WHERE doc_id % 9 <> 0 AND {_H.format('hash')} >= 20), nw AS (SELECT doc_id, ordinal, hash FROM blocks WHERE doc_id % 11 <> 0 AND {_H.format('hash')} < 240)"


def two_states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """doc_id, ordinal, hash of all blocks as they were and as they are."""
    b = blocks(spark, sf_dir).select("doc_id", "ordinal", "hash")
    return b.where((F.col("doc_id") % 9 != 0) & (bucket("hash") >= 20)), b.where((F.col("doc_id") % 11 != 0) & (bucket("hash") < 240))


def block_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, ordinal, hash, change: added, removed or kept blocks of two states, by place and content."""
    key = ["doc_id", "ordinal", "hash"]
    both = old.withColumn("was", F.lit(True)).join(new.withColumn("has", F.lit(True)), key, "full_outer")
    return both.select(*key, F.when(F.col("was").isNull(), "added").when(F.col("has").isNull(), "removed").otherwise("kept").alias("change"))


_CHANGES = ", ch AS (SELECT doc_id, ordinal, hash, CASE WHEN o.w IS NULL THEN 'added' WHEN n.w IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT *, 1 AS w FROM od) o FULL JOIN (SELECT *, 1 AS w FROM nw) n USING (doc_id, ordinal, hash))"


@query(_OLD + _CHANGES + " SELECT doc_id, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'kept') AS kept FROM ch GROUP BY doc_id")
def replaced_documents(spark, sf_dir) -> DataFrame:
    """What replacing each document's blocks changes."""
    c = block_changes(*two_states(spark, sf_dir))
    return c.groupBy("doc_id").agg(*(F.count_if(F.col("change") == k).alias(k) for k in ("added", "removed", "kept")))


@query(_OLD + _CHANGES + ", gone AS (SELECT DISTINCT hash FROM ch WHERE change = 'removed' EXCEPT SELECT hash FROM ch WHERE change <> 'removed') SELECT hash AS claim_id, 'no block left' AS reason FROM gone")
def invalidated_claims(spark, sf_dir) -> DataFrame:
    """Claims of which no block is left after the change, with the reason for the log."""
    c = stored(block_changes(*two_states(spark, sf_dir)))
    gone = c.where("change = 'removed'").select("hash").distinct().join(c.where("change <> 'removed'").select("hash").distinct(), "hash", "left_anti")
    return gone.select(F.col("hash").alias("claim_id"), F.lit("no block left").alias("reason"))


@query(_OLD + " SELECT doc_id, count(*) AS blocks FROM od WHERE doc_id NOT IN (SELECT doc_id FROM nw) GROUP BY doc_id")
def purged_documents(spark, sf_dir) -> DataFrame:
    """Documents that are no longer there, with the blocks that go with them."""
    old, new = two_states(spark, sf_dir)
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.count("*").alias("blocks"))


@query(W("mentions") + ", ol AS (SELECT DISTINCT name FROM mentions WHERE doc_id % 9 <> 0), nn AS (SELECT DISTINCT name FROM mentions WHERE doc_id % 9 <> 0 AND doc_id % 2 = 0) SELECT name FROM ol EXCEPT SELECT name FROM nn")
def collected_objects(spark, sf_dir) -> DataFrame:
    """Objects that no mention holds any more once half of the documents are gone."""
    m = mentions(spark, sf_dir).where("doc_id % 9 <> 0").select("name", F.col("doc_id") % 2 == 0)
    flag = m.columns[1]
    return m.groupBy("name").agg(F.max(flag).alias("kept")).where("not kept").select("name")


def merged_extraction(old: DataFrame, new: DataFrame) -> DataFrame:
    """Objects (name, kind, description, confidence, legacy) of two extractions, one a name: the longer description, the
    greater confidence, and the old kind where the old row is marked legacy."""
    every = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    longer = F.max_by("description", F.struct(F.char_length("description"), "description"))
    kind = F.coalesce(F.max(F.when(F.col("legacy") & (F.col("age") == 0), F.col("kind"))), F.max_by("kind", "age"))
    return every.groupBy("name").agg(longer.alias("description"), F.max("confidence").alias("confidence"), kind.alias("kind"))


_EX = W("objects") + f", oe AS (SELECT name, kind, repeat('x', {_H.format('name')} % 7) AS description, confidence, {_H.format('name')} % 5 = 0 AS legacy FROM objects WHERE length(name) % 3 <> 0), ne AS (SELECT name, CASE kind WHEN 'entity' THEN 'concept' ELSE 'entity' END AS kind, repeat('y', {_H.format('name')} % 4) AS description, round(1 - confidence, 2) AS confidence, false AS legacy FROM objects WHERE length(name) % 3 <> 1)"


def two_extractions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    o = stored(objects(spark, sf_dir))
    h = bucket("name")
    old = o.where("length(name) % 3 <> 0").select("name", "kind", F.expr("repeat('x', cast(conv(substring(md5(name), 1, 2), 16, 10) as int) % 7)").alias("description"), "confidence", (h % 5 == 0).alias("legacy"))
    turned = F.when(F.col("kind") == "entity", "concept").otherwise("entity")
    new = o.where("length(name) % 3 <> 1").select("name", turned.alias("kind"), F.expr("repeat('y', cast(conv(substring(md5(name), 1, 2), 16, 10) as int) % 4)").alias("description"), F.round(1 - F.col("confidence"), 2).alias("confidence"), F.lit(False).alias("legacy"))
    return old, new


@query(_EX + ", al AS (SELECT *, 0 AS age FROM oe UNION ALL SELECT *, 1 FROM ne) SELECT name, arg_max(description, length(description) * 2 + (description LIKE 'y%')::int) AS description, max(confidence) AS confidence, coalesce(max(kind) FILTER (WHERE legacy AND age = 0), arg_max(kind, age)) AS kind FROM al GROUP BY name")
def saved_extraction(spark, sf_dir) -> DataFrame:
    """A new extraction saved over an old one."""
    return merged_extraction(*two_extractions(spark, sf_dir))


@query(W("objects") + f", mp AS (SELECT name, CASE WHEN {_H.format('name')} < 26 THEN left(name, 5) ELSE name END AS target FROM objects), ca AS (SELECT name, target FROM mp), mv AS (SELECT DISTINCT target AS name, doc_id, ordinal FROM mentions JOIN ca USING (name)) SELECT name, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM mv GROUP BY name")
def merged_entities(spark, sf_dir) -> DataFrame:
    """Mentions after some objects are merged into one of a shorter name: moved, and each once a block."""
    m = mentions(spark, sf_dir)
    target = F.when(bucket("name") < 26, F.substring("name", 1, 5)).otherwise(F.col("name"))
    moved = m.select(target.alias("name"), "doc_id", "ordinal").distinct()
    per = moved.groupBy("name", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("name").agg(F.sum("n").alias("mentions"), F.count("*").alias("docs"))


@query(W("objects") + f", mp AS (SELECT name, CASE WHEN {_H.format('name')} < 26 THEN left(name, 5) ELSE name END AS target, confidence FROM objects), rl AS (SELECT min(name) AS a, max(name) AS b FROM mentions GROUP BY doc_id, ordinal HAVING min(name) <> max(name)) SELECT x.target AS source, y.target AS target, round(max(least(x.confidence, y.confidence)), 4) AS confidence, count(*) AS merged FROM rl JOIN mp x ON x.name = a JOIN mp y ON y.name = b WHERE x.target <> y.target GROUP BY ALL")
def rekeyed_relations(spark, sf_dir) -> DataFrame:
    """Relations after the merge: keys of both ends mapped, self relations dropped, the greatest confidence of equal ones."""
    r = mentions(spark, sf_dir).groupBy("doc_id", "ordinal").agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b")
    target = F.when(bucket("name") < 26, F.substring("name", 1, 5)).otherwise(F.col("name"))
    mapped = lambda c, t, k: objects(spark, sf_dir).select(F.col("name").alias(c), target.alias(t), F.col("confidence").alias(k))
    r = r.join(mapped("a", "source", "x"), "a").join(mapped("b", "target", "y"), "b").where("source <> target")
    return r.groupBy("source", "target").agg(F.round(F.max(F.least("x", "y")), 4).alias("confidence"), F.count("*").alias("merged"))


@query(W("objects") + ", mc AS (SELECT name, count(*) AS n FROM mentions GROUP BY name) SELECT name, CASE WHEN regexp_matches(name, '(ung|tion)$') AND n < 3 THEN 'inactive' WHEN length(name) <= 20 AND n = 1 AND confidence < 0.5 THEN 'inactive' ELSE status END AS status, CASE WHEN regexp_matches(name, '(ung|tion)$') AND n < 3 THEN 'noise' WHEN length(name) <= 20 AND n = 1 AND confidence < 0.5 THEN 'mundane' ELSE 'kept' END AS reason FROM objects JOIN mc USING (name) WHERE NOT (status = 'inactive' AND n = 1)")
def deactivated_objects(spark, sf_dir) -> DataFrame:
    """Noise and unused mundane names become inactive; what was inactive and is hardly mentioned is deleted."""
    o = with_kinds(mentions(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))).where("not (status = 'inactive' and n = 1)")
    noise, mundane = F.col("name").rlike("(ung|tion)$") & (F.col("n") < 3), (F.char_length("name") <= 20) & (F.col("n") == 1) & (F.col("confidence") < 0.5)
    return o.select("name", F.when(noise | mundane, "inactive").otherwise(F.col("status")).alias("status"), F.when(noise, "noise").when(mundane, "mundane").otherwise("kept").alias("reason"))


@query(W("blocks") + f", oc AS (SELECT doc_id, ordinal, hash, 'old' AS vec FROM blocks WHERE {_H.format('hash')} < 200), nc AS (SELECT doc_id, ordinal, CASE WHEN doc_id % 13 = 0 THEN md5(hash) ELSE hash END AS hash FROM blocks) SELECT coalesce(vec, 'new') AS vector, count(*) AS n FROM nc LEFT JOIN oc USING (doc_id, ordinal, hash) GROUP BY ALL")
def reused_vectors(spark, sf_dir) -> DataFrame:
    """How many chunks keep their vector since their content is the same, and how many need a new one."""
    b = blocks(spark, sf_dir).select("doc_id", "ordinal", "hash")
    old = b.where(bucket("hash") < 200).withColumn("vec", F.lit("old"))
    new = b.withColumn("hash", F.when(F.col("doc_id") % 13 == 0, F.md5("hash")).otherwise(F.col("hash")))
    return new.join(old, ["doc_id", "ordinal", "hash"], "left").groupBy(F.coalesce("vec", F.lit("new")).alias("vector")).agg(F.count("*").alias("n"))


@query(W("blocks") + ", st AS (SELECT doc_id, ordinal, hash FROM blocks WHERE doc_id % 2 = 0 OR doc_id % 3 = 0), fr AS (SELECT doc_id, ordinal, md5(hash) AS hash FROM blocks WHERE doc_id % 6 = 0 AND ordinal % 2 = 0), nx AS (SELECT * FROM st WHERE doc_id NOT IN (SELECT doc_id FROM fr) UNION ALL SELECT * FROM fr) SELECT doc_id, count(*) AS chunks, min(hash) AS first FROM nx GROUP BY doc_id")
def replaced_chunks(spark, sf_dir) -> DataFrame:
    """The store after some files' chunks are replaced: all of a file's old chunks go, its new ones come."""
    b = blocks(spark, sf_dir).select("doc_id", "ordinal", "hash")
    old = b.where("doc_id % 2 = 0 or doc_id % 3 = 0")
    new = b.where("doc_id % 6 = 0 and ordinal % 2 = 0").withColumn("hash", F.md5("hash"))
    return replaced(old, new, "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("hash").alias("first"))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the rows of new's keys, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


@query(W("notes") + ", mf AS (SELECT path, md5(body) AS hash, doc_id FROM notes WHERE doc_id % 7 <> 0), cu AS (SELECT path, md5(CASE WHEN doc_id % 5 = 0 THEN body || '!' ELSE body END) AS hash, doc_id FROM notes WHERE doc_id % 11 <> 0), df AS (SELECT coalesce(m.doc_id, c.doc_id) AS doc_id, CASE WHEN m.path IS NULL THEN 'index' WHEN c.path IS NULL THEN 'delete' WHEN m.hash <> c.hash THEN 'index' ELSE 'keep' END AS act FROM mf m FULL JOIN cu c ON m.path = c.path) SELECT act, count(*) AS files, CASE WHEN (SELECT count(*) FILTER (WHERE act <> 'keep') FROM df) > 0.6 * (SELECT count(*) FROM df) THEN 'full' ELSE 'incremental' END AS plan FROM df GROUP BY act")
def rebuild_plan(spark, sf_dir) -> DataFrame:
    """What is to be indexed, deleted or kept, and whether a full rebuild is cheaper than an incremental one."""
    n = notes(spark, sf_dir)
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    m = n.where("doc_id % 7 <> 0").select("path", F.md5("body").alias("was"))
    c = n.where("doc_id % 11 <> 0").select("path", F.md5(edited).alias("has"))
    act = F.when(F.col("was").isNull(), "index").when(F.col("has").isNull(), "delete").when(F.col("was") != F.col("has"), "index").otherwise("keep")
    counts = stored(m.join(c, "path", "full_outer").groupBy(act.alias("act")).agg(F.count("*").alias("files")))
    total = counts.agg(F.sum("files").alias("all"), F.sum(F.when(F.col("act") != "keep", F.col("files"))).alias("todo"))
    return counts.join(F.broadcast(total)).select("act", "files", F.when(F.col("todo") > 0.6 * F.col("all"), "full").otherwise("incremental").alias("plan"))  # one row


@query(W("claims", "evidence") + ", v AS (SELECT claim_id, md5(string_agg(doc_id || '.' || ordinal, ',' ORDER BY doc_id, ordinal)) AS input FROM (SELECT DISTINCT claim_id, doc_id, ordinal FROM evidence QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY doc_id, ordinal) <= 50) GROUP BY claim_id) SELECT claim_id, input, substr(input, 1, 1) IN ('0', '1', '2') AS stale FROM v")
def view_staleness(spark, sf_dir) -> DataFrame:
    """A hash of each claim view's first fifty inputs, and whether the one that was kept is another."""
    e = evidence(spark, sf_dir).select("claim_id", "doc_id", "ordinal").distinct()
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("claim_id").orderBy("doc_id", "ordinal"))).where("r <= 50")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "ordinal"))), lambda x: F.concat_ws(".", x.doc_id.cast("string"), x.ordinal.cast("string"))), ",")
    v = e.groupBy("claim_id").agg(F.md5(listed).alias("input"))
    kept = F.when(F.substring("input", 1, 1).isin("0", "1", "2"), "older").otherwise(F.col("input"))
    return v.select("claim_id", "input", (kept != F.col("input")).alias("stale"))


@query(W("claims", "verifications") + ", ad AS (SELECT claim_id, 'active' AS before, verdict AS after, checked_at, ordinal FROM verifications WHERE verdict <> 'unclear'), la AS (SELECT claim_id, arg_max(after, checked_at * 100000 + ordinal) AS now, count(*) AS edits FROM ad GROUP BY claim_id) SELECT c.claim_id, coalesce(now, status) AS status, coalesce(edits, 0) AS edits FROM claims c LEFT JOIN la USING (claim_id)")
def audited_status(spark, sf_dir) -> DataFrame:
    """Claims with the status of their latest edit in the append-only audit."""
    v = verifications(spark, sf_dir).where("verdict <> 'unclear'").groupBy("claim_id").agg(F.max_by("verdict", F.struct("checked_at", "ordinal")).alias("now"), F.count("*").alias("edits"))
    return claims(spark, sf_dir).join(v, "claim_id", "left").select("claim_id", F.coalesce("now", "status").alias("status"), F.coalesce("edits", F.lit(0).cast("long")).alias("edits"))


@query("SELECT user_id AS item, arg_max(event_type, event_id) AS last, max(ts) AS at, count(*) AS failures FROM events WHERE event_type IN ('error', 'click') GROUP BY user_id")
def latest_failures(spark, sf_dir) -> DataFrame:
    """Of each item the latest failure, and how many there were."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "click"))
    return e.groupBy(F.col("user_id").alias("item")).agg(F.max_by("event_type", "event_id").alias("last"), F.max("ts").alias("at"), F.count("*").alias("failures"))


@query(W("notes") + f", pl AS (SELECT doc_id, topic, {_H.format('doc_id::varchar')} / 255.0 AS score, md5(body) AS hash FROM notes), kd AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN md5(body) ELSE 'older' END AS hash FROM notes WHERE doc_id % 2 = 0) SELECT doc_id, topic FROM pl WHERE score >= 0.8 AND NOT EXISTS (SELECT 1 FROM kd WHERE kd.doc_id = pl.doc_id AND kd.hash = pl.hash)")
def auto_moves(spark, sf_dir) -> DataFrame:
    """Notes that move by themselves: a score of 0.8 or more, and no decision to keep them that still fits their content."""
    n = notes(spark, sf_dir)
    p = n.select("doc_id", "topic", (bucket(F.col("doc_id").cast("string")) / 255.0).alias("score"), F.md5("body").alias("hash")).where("score >= 0.8")
    k = n.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.md5("body")).otherwise("older").alias("hash"))
    return p.join(k, ["doc_id", "hash"], "left_anti").select("doc_id", "topic")


@query(W("objects") + ", v AS (SELECT name, status, length(name) % 4 AS version FROM objects) SELECT version, count(*) AS reset FROM v WHERE version < 3 AND status = 'active' GROUP BY version")
def outdated_policy(spark, sf_dir) -> DataFrame:
    """Objects of an older policy version, which are to be judged again."""
    o = objects(spark, sf_dir).withColumn("version", (F.char_length("name") % 4).cast("long"))
    return o.where("version < 3 and status = 'active'").groupBy("version").agg(F.count("*").alias("reset"))


# --- merging texts and trees --------------------------------------------------------------------------------------------


@query(W("notes") + ", pr AS (SELECT doc_id // 2 AS pair, doc_id % 2 AS side, unnest(string_split(body, chr(10))) AS para, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM notes), ks AS (SELECT pair, side, para, pos, lower(regexp_replace(para, '\\s+', '', 'g')) AS k FROM pr WHERE trim(para) <> ''), ad AS (SELECT DISTINCT pair, k FROM ks b WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM ks a WHERE a.side = 0 AND a.pair = b.pair AND a.k = b.k)) SELECT pair, count(*) AS appended FROM ad GROUP BY pair")
def appended_paragraphs(spark, sf_dir) -> DataFrame:
    """How many paragraphs of the second note of a pair the first gets, when white space and case make no difference."""
    p = notes(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).alias("side"), F.explode(F.split("body", "\n")).alias("para")).where(F.trim("para") != "")
    k = p.select("pair", "side", F.lower(F.regexp_replace("para", r"\s+", "")).alias("k")).distinct()
    return k.where("side = 1").join(k.where("side = 0"), ["pair", "k"], "left_anti").groupBy("pair").agg(F.count("*").alias("appended"))


@query(W("notes") + ", t AS (SELECT topic, lower(regexp_replace(topic, '[0-9]+$', '')) AS k, count(*) AS n FROM notes GROUP BY topic) SELECT k AS section, count(*) AS merged, sum(n)::bigint AS notes, min(topic) AS title FROM t GROUP BY k HAVING count(*) > 1")
def merged_sections(spark, sf_dir) -> DataFrame:
    """Topics whose names differ in case and numbers only are one section under the first title."""
    t = notes(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n")).withColumn("section", F.lower(F.regexp_replace("topic", "[0-9]+$", "")))
    return t.groupBy("section").agg(F.count("*").alias("merged"), F.sum("n").alias("notes"), F.min("topic").alias("title")).where("merged > 1")


@query(W("notes") + ", tg AS (SELECT doc_id, [CASE tags[1] WHEN 'de' THEN 'german' ELSE tags[1] END, lower(tags[2]), tags[1], 'note'] AS ts FROM notes) SELECT doc_id, list_filter(ts, lambda x, i: list_position(ts, x) = i) AS tags FROM tg")
def renamed_tags(spark, sf_dir) -> DataFrame:
    """Tags after a rename, each once, in the order in which they first stand."""
    t = F.col("tags")
    renamed = F.array(F.when(t[0] == "de", "german").otherwise(t[0]), F.lower(t[1]), t[0], F.lit("note"))
    return notes(spark, sf_dir).select("doc_id", F.array_distinct(renamed).alias("tags"))


@query(W("notes") + ", s AS (SELECT split_part(path, '/', 4) AS file, topic, doc_id % 17 AS f FROM notes), a AS (SELECT DISTINCT f FROM s WHERE topic = 'en > src1'), b AS (SELECT DISTINCT f FROM s WHERE topic = 'de > src1'), c AS (SELECT DISTINCT f FROM s WHERE topic = 'es > src1') SELECT a.f AS name, 'sources' AS between FROM a JOIN b USING (f) UNION ALL SELECT f, 'target' FROM (SELECT f FROM a UNION SELECT f FROM b) JOIN c USING (f)")
def topic_merge_conflicts(spark, sf_dir) -> DataFrame:
    """File names that two topics to be merged share, or have in common with the target."""
    s = notes(spark, sf_dir).select("topic", (F.col("doc_id") % 17).alias("name"))
    of = lambda t: s.where(F.col("topic") == t).select("name").distinct()
    a, b, c = of("en > src1"), of("de > src1"), of("es > src1")
    return a.join(b, "name", "left_semi").withColumn("between", F.lit("sources")).unionAll(a.union(b).distinct().join(c, "name", "left_semi").withColumn("between", F.lit("target")))


@query("WITH g AS (SELECT doc_id, md5(text) AS h FROM documents), cand AS (SELECT a.doc_id AS x, a.doc_id + 1 AS y, a.h AS hx, b.h AS hy FROM g a JOIN g b ON b.doc_id = a.doc_id + 1), done AS (SELECT hy AS h1, hx AS h2 FROM cand WHERE x % 3 = 0) SELECT x, y FROM cand WHERE NOT EXISTS (SELECT 1 FROM done WHERE (h1 = hx AND h2 = hy) OR (h1 = hy AND h2 = hx))")
def open_candidates(spark, sf_dir) -> DataFrame:
    """Candidate pairs that are not resolved yet, in either order of their contents."""
    g = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    c = g.select(F.col("doc_id").alias("x"), (F.col("doc_id") + 1).alias("y"), F.col("h").alias("hx")).join(g.select(F.col("doc_id").alias("y"), F.col("h").alias("hy")), "y")
    c = c.withColumns({"lo": F.least("hx", "hy"), "hi": F.greatest("hx", "hy")})
    done = c.where("x % 3 = 0").select("lo", "hi").distinct()
    return c.join(done, ["lo", "hi"], "left_anti").select("x", "y")


@query(W("objects") + ", pv AS (SELECT unnest([min(name), max(name)]) AS name, unnest(['source', 'target']) AS role FROM objects WHERE confidence > 0.9) SELECT role, pv.name, (SELECT count(*) FROM mentions m WHERE m.name = pv.name) AS mentions, (SELECT count(DISTINCT doc_id) FROM mentions m WHERE m.name = pv.name) AS docs, (SELECT count(*) FROM objects o WHERE left(o.name, 6) = left(pv.name, 6) AND o.name <> pv.name) AS aliases FROM pv")
def merge_preview(spark, sf_dir) -> DataFrame:
    """What a merge of two objects touches: mentions, documents and like names of each."""
    o = objects(spark, sf_dir)
    ends = o.where("confidence > 0.9").agg(F.min("name").alias("source"), F.max("name").alias("target")).select(F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("name")) for r in ("source", "target")))).alias("p")).select("p.*")
    m = mentions(spark, sf_dir).join(F.broadcast(ends), "name").groupBy("role", "name").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("docs"))  # two rows
    like = o.select(F.col("name").alias("other"), F.substring("name", 1, 6).alias("k"))
    a = ends.join(like, F.substring("name", 1, 6) == F.col("k")).where("name <> other").groupBy("role").agg(F.count("*").alias("aliases"))
    return m.join(a, "role", "left").select("role", "name", "mentions", "docs", F.coalesce("aliases", F.lit(0).cast("long")).alias("aliases"))


@query(W("notes") + ", w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(body), '[\\p{L}\\p{N}_]+')) AS ws, lower(substr(body, 1, 60)) AS title FROM notes), tp AS (SELECT unnest(['this', 'nter', 'und', 'ouen', 'haut', 'the']) AS topic), sc AS (SELECT doc_id, topic, 3 * contains(title, topic)::int + 2 * list_contains(ws, topic)::int AS score FROM w, tp), bs AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) = 1) SELECT topic, count(*) AS notes, max(score) AS best FROM bs GROUP BY topic")
def keyword_topics(spark, sf_dir) -> DataFrame:
    """Notes by the topic whose words stand in their title and text; a few topics are an array in each row, not a join."""
    topics = F.array(*map(F.lit, ("this", "nter", "und", "ouen", "haut", "the")))
    n = notes(spark, sf_dir).select("doc_id", F.array_distinct(X.words("body")).alias("ws"), F.lower(F.substring("body", 1, 60)).alias("title"))
    score = lambda t: 3 * F.contains("title", t).cast("int") + 2 * F.array_contains("ws", t).cast("int")
    ranked = F.array_sort(F.transform(topics, lambda t: F.struct((-score(t)).alias("s"), t.alias("topic"))))
    best = n.select(ranked[0].alias("b")).where("b.s < 0")
    return best.groupBy("b.topic").agg(F.count("*").alias("notes"), F.max(-F.col("b.s")).alias("best"))


@query(W("notes") + ", f AS (SELECT doc_id, lower(split_part(path, '/', 3) || '-' || substr(body, 1, 12)) AS file, tags FROM notes), tg AS (SELECT unnest(['src1', 'src2', 'the', 'de', 'en', 'is']) AS tag) SELECT doc_id, list_sort(list(tag)) AS added FROM f, tg WHERE contains(file, tag) AND NOT list_contains(tags, tag) GROUP BY doc_id")
def suggested_tags(spark, sf_dir) -> DataFrame:
    """Known tags that stand in a file's name and are not among its tags."""
    known = F.array(*map(F.lit, ("de", "en", "is", "src1", "src2", "the")))
    file = F.lower(F.concat(F.split("path", "/")[2], F.lit("-"), F.substring("body", 1, 12)))
    n = notes(spark, sf_dir).select("doc_id", F.array_except(F.filter(known, lambda t: F.contains(file, t)), "tags").alias("added"))
    return n.where(F.size("added") > 0)


@query(W("notes") + ", tk AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(substr(body, 1, 40)), '\\p{L}{4,}'))) AS tag FROM notes) SELECT tag, count(*) AS files FROM tk GROUP BY tag HAVING count(*) > 3")
def filename_tags(spark, sf_dir) -> DataFrame:
    """Words of four letters or more that stand in more than three files' names."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(F.substring("body", 1, 40)), F.lit(r"(\p{L}{4,})"), F.lit(1)))
    return notes(spark, sf_dir).select(F.explode(w).alias("tag")).groupBy("tag").agg(F.count("*").alias("files")).where("files > 3")


@query(W("notes") + ", m AS (SELECT topic, count(*) AS sources, max(doc_id) AS newest, min(doc_id) AS compiled, count(*) FILTER (WHERE doc_id % 10 = 0) AS conflicts FROM notes GROUP BY topic) SELECT topic, sources, conflicts, newest > compiled + 100 AS stale, CASE WHEN conflicts > 3 THEN 'review' WHEN newest > compiled + 100 THEN 'stale' ELSE 'ok' END AS trust FROM m")
def topic_trust(spark, sf_dir) -> DataFrame:
    """How far a topic's page can be trusted: its sources, open conflicts, and whether something is newer."""
    m = notes(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("sources"), F.max("doc_id").alias("newest"), F.min("doc_id").alias("compiled"), F.count_if(F.col("doc_id") % 10 == 0).alias("conflicts"))
    stale = F.col("newest") > F.col("compiled") + 100
    return m.select("topic", "sources", "conflicts", stale.alias("stale"), F.when(F.col("conflicts") > 3, "review").when(stale, "stale").otherwise("ok").alias("trust"))


@query("SELECT p_brand AS item, count(*) AS due FROM part JOIN (SELECT l_partkey, max(l_shipdate) AS last FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey WHERE (SELECT max(l_shipdate) FROM lineitem) - last >= INTERVAL 30 DAY GROUP BY p_brand")
def due_items(spark, sf_dir) -> DataFrame:
    """Items whose last visit lies an interval or more before the newest of all."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("last"))
    end = li.agg(F.max("last").alias("end"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"))
    return p.join(li, "p_partkey").join(F.broadcast(end)).where("last <= end - interval 30 days").groupBy("item").agg(F.count("*").alias("due"))  # one row


@query(W("claims", "evidence", "objects") + ", i AS (SELECT claim_id AS item FROM claims WHERE confidence < 0.2 UNION ALL SELECT md5(claim_id) FROM claims WHERE confidence > 0.9) SELECT count(*) AS kept FROM i WHERE item IN (SELECT claim_id FROM claims)")
def standing_issues(spark, sf_dir) -> DataFrame:
    """Issues whose item is still there."""
    c = claims(spark, sf_dir)
    found = c.where("confidence < 0.2").select("claim_id").unionAll(c.where("confidence > 0.9").select(F.md5("claim_id")))
    return found.join(c.select("claim_id"), "claim_id", "left_semi").agg(F.count("*").alias("kept"))
