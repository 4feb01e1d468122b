"""The gate that object names pass: what looks like a file, a flag, a quantity, a citation, a title, several names in one or an
everyday word is no name of an object.

RULES are tried in order; the first that matches tells why a name is refused. Everyday words are a table (parameter): a
lower-case word of three to twelve letters is refused if it, or what is left without an ending, is in it, unless it is a known
name. Null names are too short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelode.plans.catalog import query
from notelode.plans.store import table

# What no object's name looks like.
RULES = (
    ("too short", r"^.?$"),
    ("outer space", r"^[\s\p{Z}]|[\s\p{Z}]$"),
    ("hangs over", r"[._-]$"),
    ("hidden file", r"^\.[a-z0-9][\p{L}\p{N}_.-]*$"),
    ("flag", r"^[_-]"),
    ("reference", r"^@[\p{L}\p{N}_-]+"),
    ("setting", r"^[A-Z][A-Z0-9_]*_[A-Z0-9_]+$"),
    ("measure", r"^[0-9]+[KMBkmb]+\s|^[0-9]+\s*[×xX*]\s*[0-9]"),
    ("quantity", r"^[0-9]+\s*[个份篇亿万+%]"),
    ("status code", r"(?i)^[1-5][0-9][0-9][\s一-鿿A-Za-z]*?(?:OK|Created|Accepted|Moved|Found|Bad\s?Request|Unauthorized|Forbidden|Not\s?Found|服务器|请求|错误|没登录|没权限|找不到|搬家|跳转|网关|炸了|服务不可用|响应超时)"),
    ("citation", r"(?i)et al\.|,\s*[A-Z][a-z]+(?:\s*&\s*[A-Z][a-z]+)*\s*[（(](?:19|20)[0-9]{2}[)）]|[（(](?:19|20)[0-9]{2}[)）]\s*$|(?:19|20)[0-9]{2}\s*$"),
    ("random code", r"^[A-Z]*[0-9][A-Z0-9]*$"),
    ("sentence", r"^.*[，。；、！？].*$"),
    ("title", r"报告|指南|路线图|全景|速成|学习笔记|白皮书|专栏|合集|面试题|实践指南|入门教程|官方文档|源码解析|全梳理|知识体系全梳理"),
    ("file", r"(?i)\.(?:md|markdown|txt|docx?|pdf|pptx?|xlsx?|yaml|yml|json|csv|py|js|ts|jsx|tsx|css|html?|sql|sh|toml|ini|cfg)$"),
    ("version", r"(?i)^[0-9]+(?:\.[0-9]+){1,3}(?:[-+][a-z0-9.-]+)?$"),
    ("heading", r"^[0-9]+(?:[._-][0-9]+)*[._-]"),
    ("several", r"[/、／]"),
    ("host", r"^[\p{L}\p{N}_-]+\.[a-zA-Z]{2,}$"),
    ("no letters", r"^[^\p{L}]*$"),
)
# Rules that also ask for a length, so many characters at least.
LENGTHS = {"random code": 8, "sentence": 21}
# Names of libraries, tools and functions that are lower-case words.
KNOWN = (
    "aider bcrypt checkpointer curl dotenv esbuild goose helmet jieba lucia matplotlib morgan npm numpy nvm openpyxl pandas pgvector pino pnpm postgres puppeteer pyenv pyqlib ripgrep seccomp stdio "
    "tiktoken uvicorn yarn yfinance grad tanh vmap pmap jit localhost fastapi flask django pytorch tensorflow redis kafka mysql sqlite python node docker git rust java golang postgresql mongodb "
    "elasticsearch chromadb vectorstore scipy pillow ffmpeg gunicorn celery sqlalchemy requests asyncio pytest prefect airflow dbt terraform ansible kubernetes prometheus grafana okta auth0 sentry newrelic datadog"
).split()
# Endings that come off, where more than three letters are left, and the letter that may have stood there.
ENDINGS, MUTE = ("ing", "ed", "er", "ies", "es", "s"), "e"
#: A word of so large a share of all documents is an everyday word, where no table of them is given.
EVERYDAY = 0.02


def shape(c) -> Column:
    """The first of RULES that a name breaks, or null."""
    name = F.coalesce(c, F.lit(""))
    broken = lambda rule: name.rlike(rule[1]) & (F.char_length(name) >= LENGTHS.get(rule[0], 0))
    return reduce(lambda e, rule: F.coalesce(e, F.when(broken(rule), rule[0])), RULES, F.lit(None).cast("string"))


def shape_sql(c: str) -> str:
    has = lambda n, p: f"regexp_matches({c}, '{p}')" + (f" AND length({c}) >= {LENGTHS[n]}" if n in LENGTHS else "")
    return "CASE " + " ".join(f"WHEN {has(n, p)} THEN '{n}'" for n, p in RULES) + " END"


def stems(c) -> Column:
    """A word and what it may be without its ending."""
    cut = lambda end: F.when(c.endswith(end) & (F.char_length(c) > len(end) + 3), F.left(c, F.char_length(c) - len(end)))
    bare = F.filter(F.array(*map(cut, ENDINGS)), lambda x: x.isNotNull())
    return F.concat(F.array(c), bare, F.transform(bare, lambda x: F.concat(x, F.lit(MUTE))))


def gate(names: DataFrame, everyday: DataFrame, known=tuple(KNOWN)) -> DataFrame:
    """name, reason (null: it passes): a row for each different name of names (name); everyday has a column word."""
    rows = names.select("name").distinct().withColumn("shape", shape(F.col("name")))
    words = rows.where(F.col("shape").isNull() & F.col("name").rlike("^[a-z]{3,12}$") & ~F.col("name").isin(*known))
    met = words.select("name", F.explode(stems(F.col("name"))).alias("word")).join(everyday.select("word"), "word", "left_semi").select("name").distinct().withColumn("plain", F.lit("everyday word"))
    return rows.join(met, "name", "left").select("name", F.coalesce("shape", "plain").alias("reason"))


def everyday_words(docs: DataFrame, share: float = EVERYDAY) -> DataFrame:
    """word: the lower-case words that so large a share of documents has."""
    n = docs.agg(F.count("*").alias("n"))
    w = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,12})"), F.lit(1)))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("files")).join(F.broadcast(n)).where(F.col("files") >= share * F.col("n")).select("word")  # n: one row


def offered(spark, sf_dir) -> DataFrame:
    """name: what the tables hold that might name an object: parts and their brands and types, hosts and last parts of urls,
    headings of pages, files of documents, words of texts."""
    t = lambda n: table(spark, sf_dir, n)
    parts = [t("part").select(F.col(c).alias("name")) for c in ("p_name", "p_brand", "p_type")]
    urls = [t("pages").select(F.regexp_extract("url", p, 1).alias("name")) for p in ("://([^/]+)", "([^/]+)$")]
    heads = t("pages").select(F.explode(F.regexp_extract_all("html", F.lit("(?is)<(?:h1|h2|title)[^>]*>([^<]*)<"), F.lit(1))).alias("name"))
    files = t("documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("name"))
    words = t("documents").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))).alias("name"))
    return reduce(DataFrame.unionAll, [*parts, *urls, heads, files, words])


_OFFERED = """WITH offered AS (SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT regexp_extract(url, '://([^/]+)', 1) FROM pages UNION ALL SELECT regexp_extract(url, '([^/]+)$', 1) FROM pages
UNION ALL SELECT unnest(regexp_extract_all(html, '(?is)<(?:h1|h2|title)[^>]*>([^<]*)<', 1)) FROM pages UNION ALL SELECT source || '/' || doc_id || '.md' FROM documents UNION ALL SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) FROM documents)),"""
_CUTS = ", ".join(f"CASE WHEN name LIKE '%{e}' AND length(name) > {len(e) + 3} THEN left(name, -{len(e)}) END" for e in ENDINGS)


@query(
    _OFFERED + f" w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,12}}')) AS word FROM documents), everyday AS (SELECT word FROM w GROUP BY word HAVING count(*) >= {EVERYDAY} * (SELECT count(*) FROM documents)), "
    f"s AS (SELECT name, {shape_sql('name')} AS shape FROM offered), c AS (SELECT name, list_filter([{_CUTS}], lambda x: x IS NOT NULL) AS cut FROM s WHERE shape IS NULL AND regexp_full_match(name, '[a-z]{{3,12}}') AND name NOT IN {tuple(KNOWN)}), "
    f"m AS (SELECT DISTINCT name FROM (SELECT name, unnest(list_concat([name], cut, list_transform(cut, lambda x: x || '{MUTE}'))) AS word FROM c) SEMI JOIN everyday USING (word)) "
    "SELECT coalesce(shape, CASE WHEN m.name IS NOT NULL THEN 'everyday word' END, 'passes') AS reason, count(*) AS names, min(s.name) AS first FROM s LEFT JOIN m ON m.name = s.name GROUP BY 1"
)
def object_name_gate(spark, sf_dir) -> DataFrame:
    """How many names the tables offer, and how many each rule refuses."""
    g = gate(offered(spark, sf_dir), everyday_words(table(spark, sf_dir, "documents")))
    return g.groupBy(F.coalesce("reason", F.lit("passes")).alias("reason")).agg(F.count("*").alias("names"), F.min("name").alias("first"))
