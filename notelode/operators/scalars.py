"""Scalar and table functions over texts: tokens, cuts, outlines, quotes, fingerprints, parsed answers, blocks and chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notelode.functions import text as X
from notelode.plans.catalog import query
from notelode.plans.store import blocks, change_log, notes, table
from notelode.plans.store import with_tables as W


def tokenize(c) -> Column:
    """Words of two letters or more: camel case is cut, everything but letters and digits separates; lower case."""
    cut = F.regexp_replace(F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.lower(F.trim(cut)), " "), lambda w: F.char_length(w) >= 2)


@query(r"SELECT doc_id, list_filter(string_split(lower(trim(regexp_replace(regexp_replace(substr(text, 1, 200), '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'))), ' '), lambda w: length(w) >= 2) AS tokens FROM documents")
def title_tokens(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokenize(F.substring("text", 1, 200)).alias("tokens"))


@query("SELECT doc_id, length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g')) + len(regexp_extract_all(regexp_replace(regexp_replace(text, '```[^`]*```', ' ', 'g'), 'https?://[^ \\n]+', ' ', 'g'), '[A-Za-z]+')) AS n FROM documents")
def reading_length(spark, sf_dir) -> DataFrame:
    """Chinese characters and English words, without code and urls."""
    t = F.col("text")
    chinese = F.char_length(t) - F.char_length(F.regexp_replace(t, "[一-鿿]", ""))
    bare = F.regexp_replace(F.regexp_replace(t, "```[^`]*```", " "), r"https?://[^ \n]+", " ")
    return table(spark, sf_dir, "documents").select("doc_id", (chinese + F.regexp_count(bare, F.lit("[A-Za-z]+"))).cast("long").alias("n"))


def cut_at_sentence(c, most: int) -> Column:
    """The first ``most`` characters, back to the last end of a sentence if that keeps half of them; an ellipsis tells of the cut."""
    head = F.substring(c, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?。！？])", 1)
    kept = F.when(F.char_length(whole) * 2 >= most, whole).otherwise(head)
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(kept, F.lit("…")))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE CASE WHEN length(w) * 2 >= 200 THEN w ELSE substr(text, 1, 200) END || '…' END AS short, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 210) || ' … ' || right(text, 90) END AS clamped FROM (SELECT *, regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?。！？])', 1) AS w FROM documents)")
def truncated(spark, sf_dir) -> DataFrame:
    """Texts cut at the end of a sentence, and texts cut to 70 per cent of head and 30 of tail."""
    t = F.col("text")
    clamped = F.when(F.char_length(t) <= 300, t).otherwise(F.concat(F.substring(t, 1, 210), F.lit(" … "), F.right(t, F.lit(90))))
    return table(spark, sf_dir, "documents").select("doc_id", cut_at_sentence(t, 200).alias("short"), clamped.alias("clamped"))


@query("WITH b AS (SELECT doc_id, lower(regexp_replace(CASE WHEN length(text) > 4000 THEN substr(text, 1, 2000) || right(text, 2000) ELSE text END, '[^\\p{L}\\p{N}]+', '', 'g')) AS body FROM documents), s AS (SELECT DISTINCT doc_id, substr(body, unnest(range(1, greatest(length(body) - 3, 2))), 5) AS g FROM b), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT a.doc_id AS x, count(*) AS c FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 AND b.g = a.g GROUP BY a.doc_id) SELECT a.doc_id AS x, b.doc_id AS y, round(coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)), 4) AS jaccard FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 LEFT JOIN c ON c.x = a.doc_id")
def neighbour_similarity(spark, sf_dir) -> DataFrame:
    """Jaccard similarity of each note with the next, over runs of five characters of the normalised head and tail."""
    t = F.col("text")
    cut = F.when(F.char_length(t) > 4000, F.concat(F.substring(t, 1, 2000), F.right(t, F.lit(2000)))).otherwise(t)
    s = table(spark, sf_dir, "documents").select("doc_id", X.shingles(X.normalize_body(cut)).alias("g"))
    a, b = s.select(F.col("doc_id").alias("x"), F.col("g").alias("a")), s.select((F.col("doc_id") - 1).alias("x"), F.col("doc_id").alias("y"), F.col("g").alias("b"))
    return a.join(b, "x").select("x", "y", F.round(X.jaccard("a", "b"), 4).alias("jaccard"))


def quote_level(quote: Column, block: Column) -> Column:
    """At which level a quote stands in a block: 1 as it is, 2 without outer marks, 3 without any marks, 4 in pieces around an
    ellipsis, in order; 0 not at all."""
    bare = lambda x: F.regexp_replace(x, "[^0-9A-Za-z一-鿿]+", "")
    core = F.regexp_replace(quote, r"^[\s，。、；：？！,.!?;:\"'“”‘’（）()【】\[\]《》<>–—…-]+|[\s，。、；：？！,.!?;:\"'“”‘’（）()【】\[\]《》<>–—…-]+$", "")
    parts = F.filter(F.transform(F.split(quote, r"…{1,3}|\.{3,}"), bare), lambda x: F.char_length(x) >= 3)
    pattern = F.array_join(parts, ".*")  # letters and digits alone, so no part is a pattern
    return (
        F.when(F.contains(block, quote), 1).when((core != "") & F.contains(block, core), 2)
        .when((F.char_length(bare(quote)) >= 8) & F.contains(bare(block), bare(quote)), 3)
        .when((F.size(parts) >= 2) & F.regexp_like(bare(block), pattern), 4).otherwise(0)
    )


_QUOTES = W("blocks") + """, qq AS (SELECT doc_id, ordinal, content, CASE (doc_id + ordinal) % 5 WHEN 0 THEN substr(content, 3, 30) WHEN 1 THEN '“' || substr(content, 1, 25) || '”…' WHEN 2 THEN replace(substr(content, 1, 40), ' ', ', ') WHEN 3 THEN substr(content, 1, 12) || '...' || right(content, 12) ELSE 'quite another text ' || ordinal END AS quote FROM blocks WHERE length(content) >= 40)"""


@query(_QUOTES + """, z AS (SELECT *, regexp_replace(quote, '[^0-9A-Za-z一-鿿]+', '', 'g') AS cq, regexp_replace(content, '[^0-9A-Za-z一-鿿]+', '', 'g') AS cb, regexp_replace(quote, '^[\\s，。、；：？！,.!?;:"''“”‘’（）()【】\\[\\]《》<>–—…-]+|[\\s，。、；：？！,.!?;:"''“”‘’（）()【】\\[\\]《》<>–—…-]+$', '', 'g') AS core, list_filter(list_transform(regexp_split_to_array(quote, '…{1,3}|\\.{3,}'), lambda s: regexp_replace(s, '[^0-9A-Za-z一-鿿]+', '', 'g')), lambda s: length(s) >= 3) AS ps FROM qq) SELECT doc_id, ordinal, CASE WHEN contains(content, quote) THEN 1 WHEN core <> '' AND contains(content, core) THEN 2 WHEN length(cq) >= 8 AND contains(cb, cq) THEN 3 WHEN len(ps) >= 2 AND regexp_matches(cb, array_to_string(ps, '.*')) THEN 4 ELSE 0 END AS level FROM z""")
def verified_quotes(spark, sf_dir) -> DataFrame:
    """Quotes checked against their blocks, by level."""
    b = blocks(spark, sf_dir).where(F.char_length("content") >= 40)
    k, c = (F.col("doc_id") + F.col("ordinal")) % 5, F.col("content")
    quote = (
        F.when(k == 0, F.substring(c, 3, 30)).when(k == 1, F.concat(F.lit("“"), F.substring(c, 1, 25), F.lit("”…"))).when(k == 2, F.replace(F.substring(c, 1, 40), F.lit(" "), F.lit(", ")))
        .when(k == 3, F.concat(F.substring(c, 1, 12), F.lit("..."), F.right(c, F.lit(12)))).otherwise(F.concat(F.lit("quite another text "), F.col("ordinal")))
    )
    return b.select("doc_id", "ordinal", quote_level(quote, c).alias("level"))


def fuzzy_ratio(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with ratio: Ratcliff and Obershelp's similarity of two columns, as difflib gives it (0 where one is null)."""

    @F.pandas_udf("double")
    def ratio(a, b):
        import pandas as pd
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("ratio", ratio(left, right))


def simhash(c) -> Column:
    """64 bits: of each the majority among the hashes of the different runs of five characters of the normalised text."""
    hashes = F.transform(X.shingles(X.normalize_body(c)), lambda g: F.xxhash64(g))
    one = lambda i: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(F.shiftright(h, i).bitwiseAND(1) == 1, 1).otherwise(-1)) > 0
    return F.concat(*(F.when(one(i), "1").otherwise("0") for i in range(63, -1, -1)))


@query("WITH b AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM documents), s AS (SELECT doc_id, unnest(regexp_split_to_array(t, '[.!?]')) AS s, generate_subscripts(regexp_split_to_array(t, '[.!?]'), 1) AS pos FROM b), w AS (SELECT doc_id, pos, trim(s) AS s, len(regexp_extract_all(lower(s), '\\p{L}{6,}')) AS k FROM s WHERE length(trim(s)) > 8), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, pos) AS r FROM w) SELECT doc_id, string_agg(s, '. ' ORDER BY pos) AS summary FROM r WHERE r <= 2 GROUP BY doc_id")
def extractive_summaries(spark, sf_dir) -> DataFrame:
    """The two sentences of a whole text with most long words, in their order."""
    t = F.regexp_replace("text", r"\s+", " ")
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(t, "[.!?]")).alias("pos", "s")).withColumn("s", F.trim("s")).where(F.char_length("s") > 8)
    k = F.regexp_count(F.lower("s"), F.lit(r"\p{L}{6,}"))
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(k), "pos"))).where("r <= 2")
    parts = F.array_sort(F.collect_list(F.struct("pos", "s")))  # two a document
    return top.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x.s), ". ").alias("summary"))


@query("SELECT page_id, list_transform(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1), lambda x: trim(x)) AS titles, list_transform(regexp_extract_all(html, '<h([1-6])[^>]*>[^<]*</h[1-6]>', 1), lambda x: x::int) AS levels FROM pages")
def heading_outline(spark, sf_dir) -> DataFrame:
    """The headings of each page and their levels, in order."""
    of = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.transform(of("<h[1-6][^>]*>([^<]*)</h[1-6]>"), lambda x: F.trim(x)).alias("titles"), F.transform(of("<h([1-6])[^>]*>[^<]*</h[1-6]>"), lambda x: x.cast("int")).alias("levels"))


@query("SELECT event_id, try_cast(s AS timestamp) AS at FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE 'no date' END AS s FROM events)")
def parsed_times(spark, sf_dir) -> DataFrame:
    """Times from ISO text with T and Z, with a space, as a date alone; null for what is none."""
    k = F.col("event_id") % 4
    s = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy-MM-dd")).otherwise("no date")
    return table(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(F.regexp_replace(s, "Z$", "")).cast("timestamp_ntz").alias("at"))


@query("WITH a AS (SELECT event_id, 'Answer: ```json\n{\"verdict\": \"' || event_type || '\", \"score\": ' || user_id || ', \"ids\": [' || user_id || ', ' || event_id || ']}\n``` done' AS t FROM events), j AS (SELECT event_id, regexp_extract(t, '(?s)```json\\s*([{].*[}])\\s*```', 1) AS j FROM a) SELECT event_id, CASE WHEN j->>'verdict' IN ('click', 'view', 'error') THEN j->>'verdict' ELSE 'unclear' END AS verdict, (j->>'score')::bigint AS score, json_array_length(j->'ids') AS n FROM j")
def parsed_verdicts(spark, sf_dir) -> DataFrame:
    """Verdicts from fenced JSON in an answer; others than the known ones are unclear."""
    t = F.concat(F.lit('Answer: ```json\n{"verdict": "'), "event_type", F.lit('", "score": '), F.col("user_id"), F.lit(', "ids": ['), F.col("user_id"), F.lit(", "), F.col("event_id"), F.lit("]}\n``` done"))
    j = F.from_json(F.regexp_extract(t, r"(?s)```json\s*([{].*[}])\s*```", 1), "verdict string, score long, ids array<long>")
    a = table(spark, sf_dir, "events").select("event_id", j.alias("j"))
    return a.select("event_id", F.when(F.col("j.verdict").isin("click", "view", "error"), F.col("j.verdict")).otherwise("unclear").alias("verdict"), F.col("j.score").alias("score"), F.size("j.ids").cast("long").alias("n"))


@query("WITH x AS (SELECT event_id, '{\"objects\": [{\"name\": \"' || event_type || '\", \"kind\": \"entity\", \"confidence\": 0.' || (user_id % 10) || '}, {\"name\": \"\", \"kind\": \"concept\", \"confidence\": 0.9}, {\"name\": \"u' || user_id || '\", \"kind\": \"' || CASE WHEN user_id % 3 = 0 THEN 'other' ELSE 'concept' END || '\", \"confidence\": 0.7}]}' AS j FROM events), o AS (SELECT event_id, unnest(json_extract(j, '$.objects[*]')) AS o FROM x), r AS (SELECT event_id, o->>'name' AS name, o->>'kind' AS kind, (o->>'confidence')::double AS confidence FROM o) SELECT CASE WHEN name = '' THEN 'no name' WHEN kind NOT IN ('entity', 'concept') THEN 'unknown kind' WHEN confidence < 0.3 THEN 'low confidence' ELSE 'accepted' END AS outcome, count(*) AS n FROM r GROUP BY outcome")
def validated_extraction(spark, sf_dir) -> DataFrame:
    """Objects from a model's JSON, row by row, with the first rule that each breaks."""
    kind = F.when(F.col("user_id") % 3 == 0, "other").otherwise("concept")
    j = F.concat(F.lit('{"objects": [{"name": "'), "event_type", F.lit('", "kind": "entity", "confidence": 0.'), F.col("user_id") % 10, F.lit('}, {"name": "", "kind": "concept", "confidence": 0.9}, {"name": "u'), F.col("user_id"), F.lit('", "kind": "'), kind, F.lit('", "confidence": 0.7}]}'))
    rows = table(spark, sf_dir, "events").select(F.explode(F.from_json(j, "objects array<struct<name: string, kind: string, confidence: double>>").objects).alias("o")).select("o.*")
    outcome = F.when(F.col("name") == "", "no name").when(~F.col("kind").isin("entity", "concept"), "unknown kind").when(F.col("confidence") < 0.3, "low confidence").otherwise("accepted")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT conv_id, turn, text || ' [' || (turn % 3 + 1) || '] and [2] or [' || (conv_id % 4) || '], see [2]' AS t FROM conversations), c AS (SELECT conv_id, turn, regexp_extract_all(t, '\\[(\\d+)\\]', 1) AS ns FROM a) SELECT conv_id, turn, list_transform(list_filter(ns, lambda x, i: list_position(ns, x) = i), lambda x: x::int) AS cited FROM c")
def cited_sources(spark, sf_dir) -> DataFrame:
    """The sources that an answer cites, in the order of first use."""
    t = F.concat("text", F.lit(" ["), F.col("turn") % 3 + 1, F.lit("] and [2] or ["), F.col("conv_id") % 4, F.lit("], see [2]"))
    cited = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\[(\d+)\]"), F.lit(1))), lambda x: x.cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cited.alias("cited"))


@query("SELECT page_id, regexp_replace(regexp_replace(substr(url, 1, 60), '[\\\\/:*?\"<>|]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS file, CASE WHEN strlen(html) < 1024 THEN strlen(html) || ' B' WHEN strlen(html) < 1048576 THEN round(strlen(html) / 1024, 1) || ' KB' ELSE round(strlen(html) / 1048576, 1) || ' MB' END AS size FROM pages")
def file_names(spark, sf_dir) -> DataFrame:
    """Names that a file may have, and sizes as people read them."""
    n = F.octet_length("html")
    name = F.regexp_replace(F.regexp_replace(F.substring("url", 1, 60), r'[\\/:*?"<>|]', "_"), r"^[. ]+|[. ]+$", "")
    size = F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1048576, F.concat(F.round(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.round(n / 1048576, 1), F.lit(" MB")))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("file"), size.alias("size"))


@query("SELECT id, m['kind'] AS kind, m['day'] AS day FROM (SELECT id, map_from_entries(list_transform(string_split('kind=' || change_kind || ';day=' || strftime(created_at, '%Y-%m-%d') || ';x=', ';'), lambda p: struct_pack(k := split_part(p, '=', 1), v := split_part(p, '=', 2)))) AS m FROM (" + W("change_log") + "SELECT * FROM change_log))")
def page_metadata(spark, sf_dir) -> DataFrame:
    """Metadata from a comment of keys and values."""
    t = F.concat(F.lit("<!-- kind="), "change_kind", F.lit(";day="), F.date_format("created_at", "yyyy-MM-dd"), F.lit(";x= -->"))
    m = F.str_to_map(F.regexp_extract(t, "<!-- (.*) -->", 1), F.lit(";"), F.lit("="))
    return change_log(spark, sf_dir).select("id", m["kind"].alias("kind"), m["day"].alias("day"))


@query("WITH i AS (SELECT page_id, '<img src=\"/a' || page_id || '.png\" srcset=\"/s.png 1x, /m' || page_id || '.png 2x\">' || html AS html FROM pages), u AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '<img[^>]*[^a-z]src=\"([^\"]*)\"', 1), list_transform(string_split(regexp_extract(html, 'srcset=\"([^\"]*)\"', 1), ','), lambda s: split_part(trim(s), ' ', 1)))) AS url FROM i) SELECT url, count(*) AS pages FROM u WHERE url <> '' GROUP BY url")
def image_urls(spark, sf_dir) -> DataFrame:
    """Images by src and srcset."""
    h = F.concat(F.lit('<img src="/a'), F.col("page_id"), F.lit('.png" srcset="/s.png 1x, /m'), F.col("page_id"), F.lit('.png 2x">'), "html")
    src = F.regexp_extract_all(h, F.lit('<img[^>]*[^a-z]src="([^"]*)"'), F.lit(1))
    srcset = F.transform(F.split(F.regexp_extract(h, 'srcset="([^"]*)"', 1), ","), lambda s: F.split(F.trim(s), " ")[0])
    return table(spark, sf_dir, "pages").select(F.explode(F.concat(src, srcset)).alias("url")).where("url <> ''").groupBy("url").agg(F.count("*").alias("pages"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]+>', '', 'g'), '[*_`#]+', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ') AS clean, trim(regexp_extract(t, '(?m)^#{1,6} +(.+)$', 1)) AS title FROM (SELECT doc_id, '# Title ' || doc_id || chr(10) || '![i](x.png) [link](y) <b>bold</b> `c`' || chr(10) || chr(10) || chr(10) || text AS t FROM documents)")
def cleaned_markdown(spark, sf_dir) -> DataFrame:
    """Markdown without images, link targets, tags and marks, and its title."""
    t = F.concat(F.lit("# Title "), F.col("doc_id"), F.lit("\n![i](x.png) [link](y) <b>bold</b> `c`\n\n\n"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_markdown(t).alias("clean"), F.trim(F.regexp_extract(t, r"(?m)^#{1,6} +(.+)$", 1)).alias("title"))


# --- blocks and chunks ----------------------------------------------------------------------------------------------------


def semantic_blocks(docs: DataFrame) -> DataFrame:
    """From docs (doc_id, text): doc_id, ordinal, kind, heading (the titles above, outermost first), content, start_line,
    end_line. Fenced code, tables, lists and quotes are blocks as a whole; headings are no blocks of their own.

    The stack of headings depends on order, so each text is parsed within its row.
    """

    def parse(text: str | None) -> Iterator[tuple]:
        heads: list[tuple[int, str]] = []
        now: list[str] = []
        kind, begin, fence = "", 0, False

        def kind_of(line: str) -> str:
            s = line.lstrip()
            if s.startswith(("- ", "* ", "+ ")) or s[:1].isdigit() and s.split(" ", 1)[0].rstrip(".)").isdigit() and s.split(" ", 1)[0][-1:] in ".)":
                return "list"
            return "table" if s.startswith("|") else "quote" if s.startswith(">") else "paragraph"

        def block(end: int):
            path = [t for _, t in heads]
            yield kind, path, "\n".join(now), begin, end

        lines = (text or "").split("\n")
        for n, line in enumerate(lines, 1):
            if fence:
                now.append(line)
                if line.lstrip().startswith("```"):
                    yield from block(n)
                    now, fence = [], False
                continue
            marks = len(line) - len(line.lstrip("#"))
            ends = not line.strip() or line.lstrip().startswith("```") or 0 < marks <= 6 and line[marks : marks + 1] == " "
            if now and (ends or kind_of(line) != kind and not (kind == "list" and line[:1] in " \t")):
                yield from block(n - 1)
                now = []
            if line.lstrip().startswith("```"):
                now, kind, begin, fence = [line], "code", n, True
            elif ends and line.strip():
                while heads and heads[-1][0] >= marks:
                    heads.pop()
                heads.append((marks, line[marks:].strip()))
            elif line.strip():
                if not now:
                    kind, begin = kind_of(line), n
                now.append(line)
        if now:
            yield from block(len(lines))

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(doc, k, *x) for doc, text in zip(b["doc_id"], b["text"], strict=True) for k, x in enumerate(parse(text))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "kind", "heading", "content", "start_line", "end_line"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ordinal int, kind string, heading array<string>, content string, start_line int, end_line int")


def section_chunks(found: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """From semantic blocks: doc_id, section (the two outermost headings), chunk, content. Blocks of a section are packed in
    order up to ``size`` characters; a paragraph that is too long is cut with ``overlap``; code and tables stay whole.

    The packing is a recurrence over one document's blocks, which meet in one group.
    """

    def run(key, b):
        import pandas as pd

        rows, now, k, last = [], "", 0, None

        def flush(section):
            nonlocal now, k
            if now.strip():
                rows.append((key[0], section, k, now))
                k += 1
            now = ""

        for kind, heading, content in zip(*(b.sort_values("ordinal")[c] for c in ("kind", "heading", "content")), strict=True):
            section = " > ".join(list(heading)[:2])
            if section != last:
                flush(last)
                last = section
            if now and len(now) + 2 + len(content) > size:
                flush(section)
            while len(content) > size and kind not in ("code", "table"):
                now = content[:size]
                flush(section)
                content = content[size - overlap :]
            now = f"{now}\n\n{content}" if now else content
        flush(last)
        return pd.DataFrame(rows, columns=["doc_id", "section", "chunk", "content"])

    return found.groupBy("doc_id").applyInPandas(run, "doc_id long, section string, chunk int, content string")


# A line of three backticks opens or closes a fence, so the parity of their number so far tells what is code; an indented line stays in a
# list, if the last line before it that is not such a line is one.
@query(r"WITH q AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), s AS (SELECT doc_id, n, line, regexp_replace(line, '^[\s\x0b\x1c-\x1f\p{Z}]+', '') AS s FROM q), f AS (SELECT *, starts_with(s, '```') AS fence, sum(starts_with(s, '```')::int) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS inner_ FROM s), k AS (SELECT *, fence OR inner_ AS code, fence OR inner_ OR s = '' OR regexp_matches(line, '^#{1,6} ') AS ends, CASE WHEN regexp_matches(s, '^([-*+] |[0-9]+[.)]+( |$))') THEN 'list' WHEN starts_with(s, '|') THEN 'table' WHEN starts_with(s, '>') THEN 'quote' ELSE 'paragraph' END AS kind, regexp_matches(line, '^[ \t]') AS indented FROM f), r AS (SELECT *, sum(ends::int) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM k), e AS (SELECT doc_id, run, n, CASE WHEN indented AND last_value(CASE WHEN NOT indented OR kind = 'list' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id, run ORDER BY n) = 'list' THEN 'list' ELSE kind END AS kind FROM r WHERE NOT ends), b AS (SELECT doc_id, (lag(kind) OVER (PARTITION BY doc_id, run ORDER BY n) IS DISTINCT FROM kind)::int AS new FROM e UNION ALL SELECT doc_id, (fence AND inner_)::int FROM k WHERE code) SELECT doc_id, sum(new)::bigint AS blocks, count(*) AS lines FROM b GROUP BY doc_id HAVING sum(new) > 0")
def parsed_blocks(spark, sf_dir) -> DataFrame:
    """Semantic blocks and their lines of each document, with code, headings and indents."""
    b = semantic_blocks(table(spark, sf_dir, "documents"))
    return b.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("lines"))


@query(W("notes") + ", p AS (SELECT doc_id, unnest(string_split(path, '/')[2:4]) AS part, unnest([1, 2, 3]) AS depth FROM notes), x AS (SELECT doc_id, array_to_string(string_split(path, '/')[2:2 + d - 1], ' > ') AS prefix FROM notes, (SELECT unnest([1, 2]) AS d)) SELECT prefix, count(*) AS notes FROM x GROUP BY prefix")
def folder_topics(spark, sf_dir) -> DataFrame:
    """Topics that folders name, each prefix of a note's path."""
    folders = F.slice(F.split("path", "/"), 2, 2)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda k: F.array_join(F.slice(folders, F.lit(1), k), " > "))
    return notes(spark, sf_dir).select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("notes"))


def packed_batches(items: DataFrame, most: int = 8, chars: int = 2000) -> DataFrame:
    """items (grp, pos, size) with batch: in order, a batch ends when it has ``most`` items or the next one would exceed
    ``chars``. A recurrence over the items of one group, of a document as a rule."""

    def run(key, b):
        b = b.sort_values("pos").reset_index(drop=True)
        out, batch, n, total = [], 0, 0, 0
        for size in b["size"]:
            if n and (n >= most or total + size > chars):
                batch, n, total = batch + 1, 0, 0
            out.append(batch)
            n, total = n + 1, total + size
        return b.assign(batch=out)[["grp", "pos", "size", "batch"]]

    return items.groupBy("grp").applyInPandas(run, "grp long, pos long, size long, batch long")


_BATCHES = "WITH RECURSIVE " + W("blocks")[5:] + ", it AS (SELECT doc_id AS grp, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS pos, length(content) AS size FROM blocks), rc AS (SELECT grp, pos, size, 0::bigint AS batch, 1 AS n, size AS total FROM it WHERE pos = 1 UNION ALL SELECT i.grp, i.pos, i.size, CASE WHEN r.n >= 8 OR r.total + i.size > 2000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 8 OR r.total + i.size > 2000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 8 OR r.total + i.size > 2000 THEN i.size ELSE r.total + i.size END FROM rc r JOIN it i ON i.grp = r.grp AND i.pos = r.pos + 1)"


@query(_BATCHES + " SELECT grp, batch, count(*) AS items, sum(size)::bigint AS chars FROM rc GROUP BY ALL")
def extraction_batches(spark, sf_dir) -> DataFrame:
    """Blocks of each document packed into batches for extraction, by number and characters."""
    b = blocks(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    items = b.select(F.col("doc_id").alias("grp"), F.row_number().over(w).cast("long").alias("pos"), F.char_length("content").cast("long").alias("size"))
    return packed_batches(items).groupBy("grp", "batch").agg(F.count("*").alias("items"), F.sum("size").alias("chars"))


#: Characters that a topic's notes share.
BUDGET = 50_000
_BUDGET = f"WITH RECURSIVE it AS (SELECT lang AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos, length(text) AS size, count(*) OVER (PARTITION BY lang) AS n FROM documents), rc AS (SELECT grp, pos, size, n, least(size, {BUDGET} // n) AS given, {BUDGET} - least(size, {BUDGET} // n) AS rest FROM it WHERE pos = 1 UNION ALL SELECT i.grp, i.pos, i.size, i.n, least(i.size, r.rest // (i.n - i.pos + 1)), r.rest - least(i.size, r.rest // (i.n - i.pos + 1)) FROM rc r JOIN it i ON i.grp = r.grp AND i.pos = r.pos + 1)"


def allotted(notes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """grp, notes, given, rest: a budget shared among the notes (grp, pos, size; different pos) of each group in order of pos: each
    gets the rest's equal share at most, and what a short note leaves goes to those that follow.

    Shares are whole characters, so while more notes follow than the budget has characters, each gets none and nothing
    changes: only the last ``budget`` notes of a group take part in the recurrence, however many there are. A size of null is 0.
    """
    sizes = notes.select("grp", "pos", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    counts = sizes.groupBy("grp").agg(F.count("*").alias("notes"))
    last = Window.partitionBy("grp").orderBy(F.desc("pos"))
    tail = sizes.withColumn("r", F.row_number().over(last)).where(F.col("r") <= max(budget, 1))

    def run(key, b):
        import pandas as pd

        rest, given = budget, 0
        for left, size in b.sort_values("r", ascending=False)[["r", "size"]].itertuples(index=False):
            own = min(size, rest // left)  # left: this note and those that follow
            rest, given = rest - own, given + own
        return pd.DataFrame({"grp": [key[0]], "given": [given], "rest": [rest]})

    shared = tail.groupBy("grp").applyInPandas(run, "grp string, given long, rest long")
    return counts.join(shared, counts["grp"].eqNullSafe(shared["grp"])).select(counts["grp"], "notes", "given", "rest")


@query(_BUDGET + " SELECT grp, count(*) AS notes, sum(given)::bigint AS given, min(rest) AS rest FROM rc GROUP BY grp")
def allotted_budget(spark, sf_dir) -> DataFrame:
    """What the notes of each language get of a budget of characters, in order of their ids."""
    return allotted(table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.col("doc_id").alias("pos"), F.char_length("text").alias("size")))
