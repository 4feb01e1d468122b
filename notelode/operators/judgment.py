"""Gates over names and statements: noise names, mundane names, meaningful tags, claims that judge something, and who is said
to be better than whom.

Statements are made from documents (languages and sources in sentences of twelve kinds); raw names from object names, in
spellings that extraction gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelode.functions import text as X
from notelode.operators.names import shape, shape_sql
from notelode.plans.catalog import query
from notelode.plans.store import bucket, mentions, table
from notelode.plans.store import with_tables as W

# Verbs that compare, change or rate, in the order of matching, and those of them that are positive.
COMPARE = "优于|胜过|强于|高于|快于|好于|大于|多于|胜于|劣于|不如|弱于|低于|慢于|差于|小于|少于|落后于"
CHANGE = "提升|提高|改善|增强|增长|上升|增加|促进|有助于|加快|加速|降低|下降|减少|削弱|恶化|抑制|减慢|拖累"
RATE = "有效|可靠|稳健|适合|有益|合理|可行|重要|关键|优秀|出色|无效|不可靠|不适合|有害|不合理|不可行|不足|较差"
POSITIVE = "优于|胜过|强于|高于|快于|好于|大于|多于|胜于|提升|提高|改善|增强|增长|上升|增加|促进|有助于|加快|加速|有效|可靠|稳健|适合|有益|合理|可行|重要|关键|优秀|出色"
_PART = r"[^，。；、\s,;]"
POLARITY = f"({_PART}{{2,24}}?)({COMPARE}|{CHANGE}|{RATE})({_PART}{{0,24}})"

# What makes a statement an opinion, a matter of taste, a saying, a description of behaviour, a hypothesis or a conclusion.
OPINION = "我认为|我觉得|我个人(?:认为|觉得|的看法|的观点|而言)|在我看来|依我(?:之见|看来)|我的(?:观点|看法|立场|经验)|主观(?:上|地)?(?:认为|觉得|看|判断)|说句(?:公道话|实话|心里话)|坦白(?:地)?说|个人而言|以我之见|我(?:个人)?(?:更)?(?:喜欢|偏爱|偏好|欣赏|看好)|我(?:更)?(?:倾向|倾向于|愿意)|我不(?:喜欢|看好|赞成|同意|认为|觉得)|我(?:坚决)?(?:支持|反对)这个观点|凭(?:感觉|直觉)|感觉上|直觉上|i\\s+(?:think|believe|feel|prefer|like|recommend|personally)"
TASTE = "最(?:好|强大|优秀|出色|合适|适合|友好|流行|受欢迎|方便|好用|理想|完美|推荐)|更好(?:用|看|使)|更(?:友好|方便|好用|完美|出色)|最佳|优先级\\s*P\\d|no\\.?\\s*1|(?:the\\s+)?best(?:est)?\\b|strongest|easiest|most\\s+popular|most\\s+friendly|highly\\s+recommended"
SAYING = "^[一-鿿，,]{2,16}(?:比[一-鿿]{1,8}(?:更|较)?(?:重要|好|强|优|差|有效|值得|实在|划算|便宜|高效|清晰)|(?:远)?高于[一-鿿]{1,8})[。！!]?$"
BEHAVIOUR = "^[一-鿿A-Za-z0-9]{2,16}自动(?:告警|报警|触发|执行|识别|检测|生成|保存|记录|上报|恢复|降级|切换|汇总|同步|重试)[。！!]?$"
HYPOTHESIS = "可能|或许|也许|推测|猜想|假设|尚待|有待|待验证|待检验|未验证|如果|若(?:是|在|能|可|将|要|有|无)|倘若|may|might|could|possibly|perhaps|hypothes(?:is|ize|ized)|unverified"
CONCLUSION = (
    "优于|劣于|不如|高于|低于|强于|弱于|胜过|落后于|相比|相较|比.{1,30}(?:优|劣|好|差|高|低|强|弱|快|慢|稳健|可靠|有效|适合)|更(?:优|劣|好|差|高|低|强|弱|快|慢|稳健|可靠|有效|适合)|最(?:佳|优|差|高|低|强|弱|快|慢|重要|关键)|"
    "提升|提高|改善|增强|增长|上升|增加|降低|下降|减少|削弱|恶化|导致|造成|引发|使得|源于|取决于|影响|促进|抑制|有助于|归因于|因此|因而|趋势|逐渐|持续|越来越|预测|预计|将会|有望|"
    "建议|推荐|应当|应该|值得|适合|不适合|有效|无效|可靠|稳健|重要|关键|合理|可行|不足|优势|局限|风险|足以|难以|易于|较差|优秀|出色|表明|证明|显示|发现|可见|得出结论|支持.{0,8}(?:结论|判断|假设|推断)|"
    "outperform(?:s|ed)?|better|worse|higher|lower|improv(?:e|es|ed|ement)|increas(?:e|es|ed)|decreas(?:e|es|ed)|reduc(?:e|es|ed)|caus(?:e|es|ed)|leads?\\s+to|recommend(?:s|ed)?|should|effective|reliable|risk"
)

KINDS = ("{s}优于{t}", "{t}劣于{s}", "{s}不如{t}", "{s}提升{t}", "{s}降低{t}", "{s}有效", "{s}无效", "我认为{s}优于{t}", "{s}最好用", "选择比努力更重要", "{s}可能影响{t}", "{s} improves {t} and reduces risk")
_MADE = "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN replace(replace('{t}', '{{s}}', lang), '{{t}}', source)" for i, t in enumerate(KINDS)) + " END"
_STATEMENTS = f"WITH st AS (SELECT doc_id, {_MADE} AS statement, CASE WHEN doc_id % 5 = 0 OR doc_id % 12 = 10 THEN 'hypothesis' ELSE 'conclusion' END AS claim_type, 'g' || doc_id % 5 AS topic, CASE WHEN doc_id % 4 = 0 THEN 'scope' ELSE '' END AS scope FROM documents)"


def statements(spark, sf_dir) -> DataFrame:
    """doc_id, statement, claim_type, topic, scope."""
    d = table(spark, sf_dir, "documents")
    made = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 12 + 1).cast("int"))
    kind = F.when((F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 12 == 10), "hypothesis").otherwise("conclusion")
    return d.select(
        "doc_id", F.replace(F.replace(made, F.lit("{s}"), F.col("lang")), F.lit("{t}"), F.col("source")).alias("statement"), kind.alias("claim_type"),
        F.concat(F.lit("g"), F.col("doc_id") % 5).alias("topic"), F.when(F.col("doc_id") % 4 == 0, "scope").otherwise("").alias("scope"),
    )


def judges(statement: str, claim_type: str) -> Column:
    """Whether a statement may be a claim: no opinion, taste, saying or behaviour, and with a marker of its type."""
    s = F.col(statement)
    tasteful = F.replace(s, F.lit("最佳实践"), F.lit(""))  # best practice is no taste
    concluding = F.regexp_replace(s, "增强[生学模型器]", "")  # nor do names of methods conclude
    marked = F.when(F.col(claim_type) == "hypothesis", s.rlike(f"(?i){HYPOTHESIS}")).otherwise(concluding.rlike(f"(?i){CONCLUSION}"))
    return ~s.rlike(f"(?i){OPINION}") & ~tasteful.rlike(f"(?i){TASTE}") & ~s.rlike(SAYING) & ~s.rlike(BEHAVIOUR) & marked


def _judges_sql(s: str, kind: str) -> str:
    has = lambda x, p: f"regexp_matches({x}, '(?i){p}')"
    return (
        f"NOT {has(s, OPINION)} AND NOT {has(f'''replace({s}, '最佳实践', '')''', TASTE)} AND NOT regexp_matches({s}, '{SAYING}') AND NOT regexp_matches({s}, '{BEHAVIOUR}') "
        f"AND CASE WHEN {kind} = 'hypothesis' THEN {has(s, HYPOTHESIS)} ELSE {has(f'''regexp_replace({s}, '增强[生学模型器]', '', 'g')''', CONCLUSION)} END"
    )


@query(_STATEMENTS + f" SELECT doc_id, claim_type, {_judges_sql('statement', 'claim_type')} AS eligible FROM st")
def claim_gate(spark, sf_dir) -> DataFrame:
    """Which statements may become claims."""
    return statements(spark, sf_dir).select("doc_id", "claim_type", judges("statement", "claim_type").alias("eligible"))


@query(_STATEMENTS + f", g AS (SELECT CASE WHEN regexp_matches(statement, '(?i){OPINION}') THEN 'opinion' WHEN regexp_matches(replace(statement, '最佳实践', ''), '(?i){TASTE}') THEN 'taste' WHEN regexp_matches(statement, '{SAYING}') THEN 'saying' WHEN regexp_matches(statement, '{BEHAVIOUR}') THEN 'behaviour' WHEN NOT ({_judges_sql('statement', 'claim_type')}) THEN 'no marker' ELSE 'eligible' END AS reason FROM st) SELECT reason, count(*) AS n FROM g GROUP BY reason")
def rejection_reasons(spark, sf_dir) -> DataFrame:
    """How many statements are rejected, by the first reason."""
    s = F.col("statement")
    reason = (
        F.when(s.rlike(f"(?i){OPINION}"), "opinion").when(F.replace(s, F.lit("最佳实践"), F.lit("")).rlike(f"(?i){TASTE}"), "taste").when(s.rlike(SAYING), "saying")
        .when(s.rlike(BEHAVIOUR), "behaviour").when(~judges("statement", "claim_type"), "no marker").otherwise("eligible")
    )
    return statements(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def polarities(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, kind, subject, target, direction: what the statements of rows say, a row for each assertion.

    Comparisons are turned so that the subject comes first in order: X better than Y and Y worse than X are one.
    """
    text = X.normalize_text("statement")
    part = lambda k: F.regexp_extract_all(text, F.lit(POLARITY), F.lit(k))
    z = rows.select(*keep, F.explode(F.arrays_zip(part(1).alias("s"), part(2).alias("r"), part(3).alias("t"))).alias("z")).select(*keep, "z.*")
    compares = F.col("r").rlike(f"^(?:{COMPARE})$")
    turned = compares & (F.col("s") > F.col("t"))
    sign = F.when(F.col("r").rlike(f"^(?:{POSITIVE})$"), 1).otherwise(-1)
    kind = F.when(compares, "comparison").when(F.col("r").rlike(f"^(?:{CHANGE})$"), "change").otherwise("attribute")
    return z.select(*keep, kind.alias("kind"), F.when(turned, F.col("t")).otherwise(F.col("s")).alias("subject"), F.when(turned, F.col("s")).otherwise(F.col("t")).alias("target"), F.when(turned, -sign).otherwise(sign).alias("direction"))


def _pol_sql(keep: str) -> str:
    part = lambda k: f"regexp_extract_all(trim(regexp_replace(statement, '\\s+', ' ', 'g')), '{POLARITY}', {k})"
    return f""", z AS (SELECT {keep}, unnest({part(1)}) AS s, unnest({part(2)}) AS r, unnest({part(3)}) AS t FROM st),
y AS (SELECT *, regexp_full_match(r, '{COMPARE}') AS c, CASE WHEN regexp_full_match(r, '{POSITIVE}') THEN 1 ELSE -1 END AS sign FROM z),
po AS (SELECT {keep}, CASE WHEN c THEN 'comparison' WHEN regexp_full_match(r, '{CHANGE}') THEN 'change' ELSE 'attribute' END AS kind, CASE WHEN c AND s > t THEN t ELSE s END AS subject, CASE WHEN c AND s > t THEN s ELSE t END AS target, CASE WHEN c AND s > t THEN -sign ELSE sign END AS direction FROM y)"""


@query(_STATEMENTS + _pol_sql("doc_id") + " SELECT doc_id, kind, subject, target, direction FROM po")
def statement_polarities(spark, sf_dir) -> DataFrame:
    """Who is said to be better, to change or to be good, in which direction."""
    return polarities(statements(spark, sf_dir), "doc_id")


_CX = ", cx AS (SELECT doc_id, kind, subject, target, direction, 't:' || topic AS context FROM {0} UNION ALL SELECT doc_id, kind, subject, target, direction, 's:' || scope FROM {0} WHERE scope <> '')"


@query(_STATEMENTS + _pol_sql("doc_id, topic, scope") + _CX.format("po") + " SELECT DISTINCT least(a.doc_id, b.doc_id) AS claim_a, greatest(a.doc_id, b.doc_id) AS claim_b, a.kind, a.subject, a.target FROM cx a JOIN cx b USING (kind, subject, target, context) WHERE a.direction = 1 AND b.direction = -1 AND a.doc_id <> b.doc_id")
def polarity_conflicts(spark, sf_dir) -> DataFrame:
    """All statements that say opposite things of the same, in one topic or one scope; polarity_classes tells of them without pairs."""
    return conflicting(polarities(statements(spark, sf_dir), "doc_id", "topic", "scope"))


KEY = ("kind", "subject", "target")
# Statements of one side of a context that meet those of the other in one group of a join.
BLOCK = 1024


def _contexts() -> Column:
    return F.array_compact(F.array(F.concat(F.lit("t:"), "topic"), F.when(F.col("scope") != "", F.concat(F.lit("s:"), "scope"))))


def in_contexts(p: DataFrame) -> DataFrame:
    """The assertions p, a row for each context: topic and, if there is one, scope. So the either-or is one equi-join."""
    return p.select("doc_id", *KEY, "direction", F.explode(_contexts()).alias("context"))


def conflicting(p: DataFrame, side: int | None = None, block: int = BLOCK) -> DataFrame:
    """claim_a, claim_b and what of: all pairs of assertions (doc_id, kind, subject, target, direction, topic, scope) of opposite
    directions in one context. With ``side``, only the first so many statements of each direction, before contexts are compared.

    Each side of a context is dealt into blocks of about ``block`` statements and a group of the join is a block against a block, so
    a frequent context is many groups. A pair is listed where it first meets, which needs no distinct over all pairs.
    """
    if side is not None:
        p = p.dropDuplicates(["doc_id", *KEY, "direction", "topic", "scope"])
        p = p.withColumn("r", F.row_number().over(Window.partitionBy(*KEY, "direction").orderBy("doc_id"))).where(F.col("r") <= side)
    said = lambda d: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("direction") == d, _contexts()))))
    c = p.groupBy("doc_id", *KEY).agg(said(1).alias("pro"), said(-1).alias("con"))
    c = c.select("*", F.explode(F.array_union("pro", "con")).alias("context"))
    blocks = lambda of: F.ceil(F.count_if(F.array_contains(of, F.col("context"))) / block)
    sizes = c.groupBy(*KEY, "context").agg(blocks("pro").alias("pros"), blocks("con").alias("cons")).where("pros > 0 and cons > 0")
    c = c.join(sizes, [*KEY, "context"])
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    of = lambda end: [F.col(n).alias(f"{end}_{n}") for n in ("pro", "con")]
    a = c.where(F.array_contains("pro", F.col("context"))).select(*KEY, "context", F.col("doc_id").alias("x"), *of("x"), own("pros").alias("i"), each("cons").alias("j"))
    b = c.where(F.array_contains("con", F.col("context"))).select(*KEY, "context", F.col("doc_id").alias("y"), *of("y"), own("cons").alias("j"), each("pros").alias("i"))
    # few bytes make many pairs, so the number of tasks is not left to the sizes
    on, parts = [*KEY, "context", "i", "j"], int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.repartition(parts, *on).hint("merge").join(b.repartition(parts, *on), on).where("x <> y")
    met = met.where("size(x_pro) = 1 or size(y_con) = 1 or array_min(array_intersect(x_pro, y_con)) = context")
    met = met.where("x < y or size(x_con) = 0 or size(y_pro) = 0 or not arrays_overlap(x_con, y_pro)")
    return met.select(F.least("x", "y").alias("claim_a"), F.greatest("x", "y").alias("claim_b"), *KEY)


@query(_STATEMENTS + _pol_sql("doc_id, topic, scope") + _CX.format("po") + " SELECT kind, subject, target, context, count(DISTINCT doc_id) FILTER (WHERE direction = 1) AS positives, count(DISTINCT doc_id) FILTER (WHERE direction = -1) AS negatives, min(doc_id) FILTER (WHERE direction = 1) AS first_positive, min(doc_id) FILTER (WHERE direction = -1) AS first_negative FROM cx GROUP BY ALL HAVING positives > 0 AND negatives > 0")
def polarity_classes(spark, sf_dir) -> DataFrame:
    """All conflicts, as classes: every statement of one direction in a context is in conflict with every one of the other."""
    side = lambda d: F.when(F.col("direction") == d, F.col("doc_id"))
    c = in_contexts(polarities(statements(spark, sf_dir), "doc_id", "topic", "scope")).groupBy(*KEY, "context")
    c = c.agg(F.countDistinct(side(1)).alias("positives"), F.countDistinct(side(-1)).alias("negatives"), F.min(side(1)).alias("first_positive"), F.min(side(-1)).alias("first_negative"))
    return c.where("positives > 0 and negatives > 0")


@query(_STATEMENTS + _pol_sql("doc_id, topic, scope") + _CX.format("po") + ", cf AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM cx a JOIN cx b USING (kind, subject, target, context) WHERE a.direction = 1 AND b.direction = -1 AND a.doc_id <> b.doc_id), op AS (SELECT x AS claim_id, y AS opposite FROM cf UNION SELECT y, x FROM cf) SELECT claim_id, opposite, row_number() OVER (PARTITION BY claim_id ORDER BY opposite) AS rank FROM op QUALIFY rank <= 2")
def opposite_statements(spark, sf_dir) -> DataFrame:
    """The first two of all statements that each statement is in conflict with, in both directions."""
    return opposites(polarities(statements(spark, sf_dir), "doc_id", "topic", "scope"))


def opposites(p: DataFrame, most: int = 2) -> DataFrame:
    """claim_id, opposite, rank: for each statement of the assertions p the first ``most`` of all that it is in conflict with.

    The first of a union are among the first of its parts, and a statement may stand on both sides itself. So the first ``most`` + 1 of each
    side of each context are enough, and pairs are not laid out.
    """
    c = in_contexts(p.where("doc_id is not null")).distinct()
    side = [*KEY, "context", "direction"]
    first = c.withColumn("r", F.row_number().over(Window.partitionBy(*side).orderBy("doc_id"))).where(F.col("r") <= most + 1)
    first = first.groupBy(*side).agg(F.collect_list("doc_id").alias("others")).withColumn("direction", -F.col("direction"))
    met = c.join(first, side).select(F.col("doc_id").alias("claim_id"), F.explode("others").alias("opposite")).where("claim_id <> opposite").distinct()
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy("opposite"))).where(F.col("rank") <= most)


# --- names ----------------------------------------------------------------------------------------------------------------

#: Spellings of a name, chosen by a hash of it.
SPELLINGS = ("{n}", "{n}", "{n}s", "{n}.md", "www.{n}.com", "2{n}", "{n}/{n}", "--{n}", "{n} (note)", "@{n}", "_{n}", "v1.2", "{n}_", "06_{n}", "{N}", "404 {n}")
_RAW = W("mentions") + ", rn AS (SELECT name, CASE ('0x' || substr(md5(name), 7, 2))::int % 16 " + " ".join(f"WHEN {i} THEN replace(replace('{t}', '{{n}}', name), '{{N}}', upper(replace(name, 'ß', 'ss')))" for i, t in enumerate(SPELLINGS)) + " END AS raw FROM (SELECT DISTINCT name FROM mentions))"


def raw_names(spark, sf_dir) -> DataFrame:
    """name, raw: each object name in one of the spellings that extraction gives."""
    form = F.element_at(F.array(*map(F.lit, SPELLINGS)), bucket("name", 7) % 16 + 1)
    return mentions(spark, sf_dir).select("name").distinct().select("name", F.replace(F.replace(form, F.lit("{n}"), F.col("name")), F.lit("{N}"), F.upper(F.replace(F.col("name"), F.lit("ß"), F.lit("ss")))).alias("raw"))


def noise(c) -> Column:
    """The first rule on shapes that a name breaks, or ok."""
    return F.coalesce(shape(c), F.lit("ok"))


_NOISE_SQL = f"coalesce({shape_sql('raw')}, 'ok')"


@query(_RAW + f" SELECT raw, {_NOISE_SQL} AS gate FROM rn")
def noise_names(spark, sf_dir) -> DataFrame:
    """Which spellings are no object names, and why."""
    return raw_names(spark, sf_dir).select("raw", noise(F.col("raw")).alias("gate"))


@query(_RAW + " SELECT raw, NOT (raw = upper(raw) AND regexp_full_match(raw, '\\p{L}+')) AND NOT regexp_matches(raw, '[0-9_-]') AND length(raw) <= 20 AS mundane FROM rn")
def mundane_names(spark, sf_dir) -> DataFrame:
    """Names without capitals throughout, digits, hyphens or underscores, of twenty characters at most: they go when unused."""
    r = F.col("raw")
    return raw_names(spark, sf_dir).select("raw", (~((r == F.upper(r)) & r.rlike(r"^\p{L}+$")) & ~r.rlike("[0-9_-]") & (F.char_length(r) <= 20)).alias("mundane"))


_PRINT = """list_transform(list_filter(string_split(regexp_replace(lower(regexp_replace(raw, '[（(][^（()）]*[)）]', '', 'g')), '\\s+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND regexp_full_match(w, '[a-z]+') THEN CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN left(w, -3) || 'y' WHEN regexp_matches(w, '(sses|xes|zes|ches|shes)$') THEN left(w, -2) WHEN w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is|os|as)$') THEN left(w, -1) ELSE w END ELSE w END)"""
_FP = f"array_to_string(list_transform({_PRINT}, lambda w: CASE WHEN length(regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) > 1 THEN regexp_replace(w, '[^\\p{{L}}\\p{{N}}_]+', '', 'g') ELSE w END), '')"


@query(_RAW + f", fp AS (SELECT raw, {_FP} AS fingerprint FROM (SELECT raw FROM rn UNION SELECT name FROM rn)) SELECT fingerprint, count(*) AS spellings, min(raw) AS first FROM fp GROUP BY fingerprint HAVING count(*) > 1")
def like_named(spark, sf_dir) -> DataFrame:
    """Spellings of one fingerprint: plurals, remarks in parentheses, case and marks make no difference."""
    r = raw_names(spark, sf_dir)
    every = r.select("raw").union(r.select("name")).distinct()
    return every.groupBy(X.name_fingerprint("raw").alias("fingerprint")).agg(F.count("*").alias("spellings"), F.min("raw").alias("first")).where("spellings > 1")


# Words that tell nothing as tags.
GENERIC = ("the", "and", "for", "with", "from", "about", "note", "notes", "file", "page", "data", "thing", "using", "how", "what")


def meaningful(t: Column) -> Column:
    chinese, english = t.rlike("[一-鿿]"), t.rlike("[a-zA-Z]")
    mixed = (F.octet_length(t) > 8) & (F.size(F.regexp_extract_all(t, F.lit("([a-zA-Z0-9]+|[一-鿿]+)"), F.lit(1))) >= 2)
    return F.when(F.char_length(t) < 2, False).when(chinese & english, mixed).when(chinese, F.char_length(F.regexp_replace(t, "[^一-鿿]", "")) > 2).when(english, ~F.lower(t).isin(*GENERIC)).otherwise(False)


@query(_RAW + f", tg AS (SELECT raw AS tag FROM rn UNION SELECT statement FROM (SELECT CASE doc_id % 4 WHEN 0 THEN '模型' WHEN 1 THEN '大语言模型' WHEN 2 THEN 'RAG 检索增强' ELSE 'Notes' END AS statement FROM documents)) SELECT tag, CASE WHEN length(tag) < 2 THEN false WHEN regexp_matches(tag, '[一-鿿]') AND regexp_matches(tag, '[a-zA-Z]') THEN strlen(tag) > 8 AND len(regexp_extract_all(tag, '[a-zA-Z0-9]+|[一-鿿]+')) >= 2 WHEN regexp_matches(tag, '[一-鿿]') THEN length(regexp_replace(tag, '[^一-鿿]', '', 'g')) > 2 WHEN regexp_matches(tag, '[a-zA-Z]') THEN lower(tag) NOT IN {GENERIC} ELSE false END AS meaningful FROM tg")
def meaningful_tags(spark, sf_dir) -> DataFrame:
    """Which tags tell something: three Chinese characters, an English word that is not generic, or a longer mix of both."""
    t = F.col("tag")
    fixed = F.element_at(F.array(*map(F.lit, ("模型", "大语言模型", "RAG 检索增强", "Notes"))), (F.col("doc_id") % 4 + 1).cast("int"))
    tags = raw_names(spark, sf_dir).select(F.col("raw").alias("tag")).union(table(spark, sf_dir, "documents").select(fixed)).distinct()
    return tags.select("tag", meaningful(t).alias("meaningful"))
