"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a word that holds a known key prefix, an assignment to a name that ends in password, token or the like
(db_password and clientSecret are such names), a value that follows such a name, the password of a url, what an
authorization header bears, or a run of 16 or more key characters with a digit. The forest sees the candidate's length, its
character classes and the transitions between them, its entropy, how much of it dictionary words cover (a fixed list, and
all words of ``MIN_DOCS`` documents of the corpus or more), whether it looks like a path, url or address, and its
neighbouring words. It is trained from labelled findings: any table of (before2, before, word, after, label), by default
``labelled_findings``, which writes out known forms of secrets and of what is taken for them, both among the same
neighbours. One dictionary serves training, scoring and ``held_out_figures``, which trains on some forms' rows and measures
on others. A word that stands after a colon or an equals sign does not count for the dictionary, so a pass phrase that is
copied often does not hide itself. A value of small letters alone is taken for a word. Only DataFrame functions and Spark
ML's JVM trees are used, and nothing is broadcast.

Null and empty texts have no findings. A word found twice in a text gives two findings, at their word positions. Repeated
rows give repeated findings, and there are no ties to break: each finding is judged by itself. A very long text is one row
of words in one task, and a long word is judged whole. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelode.llm.base import DOC_COLUMNS, GAP, stored, table, with_row_key

NAME = r"(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?"
#: What may stand before it: db_password, spring.datasource.password, clientSecret.
PREFIX = r"[A-Za-z0-9_.-]*"
KNOWN = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|xox[abprs]-[0-9A-Za-z-]{10,}|sk_(?:live|test)_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{30,}|eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_.-]+"
LONG = r"(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}"
GIVEN = rf"(?i:{NAME}[\"']?[:=]+[\"']?[^\s\"']{{6,}})"
#: The password of a url is the first group.
IN_URL = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@?#]*:([^\s/@]{3,})@"
HEADER = r"(?i:authorization)[\"']?[:=]+"
CANDIDATE = rf"{KNOWN}|{GIVEN}|{LONG}|{IN_URL}"
#: A text without any of these has no candidates.
ANY = rf"{CANDIDATE}|{HEADER}|(?i:{NAME}\W*[:=])"
DICTIONARY = (
    "example", "sample", "test", "dummy", "fake", "change", "default", "your", "here", "none", "null", "user", "admin", "name", "file", "path", "home",
    "http", "https", "www", "com", "org", "net", "html", "php", "index", "page", "image", "data", "node", "main", "master", "release", "version", "build",
    "commit", "branch", "lib", "usr", "local", "bin", "src", "python", "java", "package", "module", "class", "object", "number", "string", "value", "the",
    "and", "for", "with", "that", "this", "from", "tion", "ing", "word", "key", "id", "uuid", "date", "time", "order", "invoice", "chapter", "section", "part",
)
#: A word of so many documents or more is a dictionary word too, if it has four letters or more.
MIN_DOCS = 5
FEATURES = (
    "length", "upper", "lower", "digit", "other", "turns", "entropy", "covered", "common", "known", "assigned", "slashes", "dots", "at_sign", "uuid", "hex", "numeric",
    "repeats", "before_name", "before_sign", "before_other", "after_mock", "mock", "in_url", "borne", "small",
)
TRAIN_ROWS = 12_000
TREES, DEPTH = 24, 8
#: Neighbours of findings of either label.
AROUND = (
    "see", "in", "file", "user", "id", "the", "my", "note", "url", "page", "set", "use", "with", "for", "and", "of", "from", "line", "config", "server",
    "order", "path", "version", "run", "call", "value", "read", "test", "your", "new", "old", "log", "", "", "", "report",
)


def value_of(word) -> Column:
    """The key part of a candidate: the password of a url, else what follows an assignment, without quotes and closing punctuation."""
    bare = F.regexp_replace(word, rf"^.*?(?i:{NAME})[\"']?[:=]+", "")
    return F.when(word.rlike(IN_URL), F.regexp_extract(word, IN_URL, 1)).otherwise(F.regexp_replace(bare, r"^[\"'(\[{<]+|[\"')\]}>.,;:!?#*$%&|]+$", ""))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, at (the word's position), before2, before, word, after: a row for each candidate."""
    some = docs.select("doc_id", "text").where(F.col("text").rlike(ANY))
    rows = some.select("doc_id", F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), GAP).alias("w"))
    moved = lambda k: F.concat(F.array_repeat(F.lit(""), k), F.col("w"))
    after = F.concat(F.slice("w", F.lit(2), F.size("w")), F.array(F.lit("")))
    n = F.size("w")
    zipped = F.arrays_zip(F.slice(moved(2), F.lit(1), n).alias("before2"), F.slice(moved(1), F.lit(1), n).alias("before"), F.col("w").alias("word"), after.alias("after"))
    rows = rows.select("doc_id", F.posexplode(zipped).alias("at", "z")).select("doc_id", "at", "z.*")
    follows = (F.col("before").rlike(r"^[:=]+$") & F.col("before2").rlike(rf"(?i)^\W*{PREFIX}{NAME}\W*$")) | F.col("before").rlike(rf"(?i)^\W*{PREFIX}{NAME}[\"']?[:=]+$")
    return rows.where(F.col("word").rlike(CANDIDATE) | ((follows | borne()) & F.col("word").rlike(r"^[\"']?[^\s\"']{6,}")))


def borne() -> Column:
    """Whether the word is what an authorization header bears."""
    return F.col("before").rlike(r"(?i)^[\"']?(?:bearer|basic|digest|token)$") & F.col("before2").rlike(rf"{HEADER}$")


def vocabulary(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """part: the words of four letters or more (lower case) that ``least`` documents or more have elsewhere than after : or =."""
    given = r"(?<![:=])(?<![:=][ \"'])(?<![:=] [\"'])"
    own = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![\p{{L}}\p{{N}}]){given}(\p{{L}}{{4,}})(?![\p{{L}}\p{{N}}])"), F.lit(1)))
    return docs.select(F.explode(own).alias("part")).groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("part")


def with_common(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows with common: the share of value's characters that are in runs of four letters or more which are words of known."""
    if known is None:
        return rows.withColumn("common", F.lit(0.0))
    runs = F.regexp_extract_all(F.lower("value"), F.lit(r"(\p{L}{4,})"), F.lit(1))
    values = rows.select("value").distinct()
    parts = values.select("value", F.explode(runs).alias("part")).join(known, "part")
    share = parts.groupBy("value").agg((F.sum(F.char_length("part")) / F.greatest(F.char_length("value"), F.lit(1))).alias("common"))
    return rows.join(share, "value", "left").withColumn("common", F.coalesce("common", F.lit(0.0)))


def featured(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows with value and FEATURES."""
    v = F.col("value")
    named = F.concat_ws(" ", "before2", "before").rlike(rf"(?i){NAME}\b") | F.col("word").rlike(GIVEN)
    n = F.greatest(F.char_length(v), F.lit(1))
    count = lambda x, p: F.regexp_count(x, F.lit(p)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    chars = F.array_distinct(F.split(v, ""))
    bits = lambda s, c: s - F.when(c == "", 0.0).otherwise((n - F.char_length(F.replace(v, c, F.lit("")))) / n * F.log2((n - F.char_length(F.replace(v, c, F.lit("")))) / n))
    turns = count(v, "[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])|[A-Za-z0-9](?=[^A-Za-z0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])")
    cover = F.char_length(v) - F.char_length(F.regexp_replace(F.lower(v), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    return with_common(rows.withColumn("value", value_of(F.col("word"))), known).withColumns({
        "length": F.char_length(v).cast("double"),
        "upper": count(v, "[A-Z]") / n, "lower": count(v, "[a-z]") / n, "digit": count(v, "[0-9]") / n, "other": count(v, "[^A-Za-z0-9]") / n,
        "turns": turns / n,
        "entropy": F.aggregate(chars, F.lit(0.0), bits),
        "covered": cover / n,
        "known": flag(v.rlike(rf"^(?:{KNOWN})$")),
        "assigned": flag(F.col("word").rlike(GIVEN)),
        "slashes": count(v, "/"), "dots": count(v, r"\."), "at_sign": count("word", "@"),
        "uuid": flag(v.rlike(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")),
        "hex": flag(v.rlike("^[0-9a-f]+$")), "numeric": flag(v.rlike(r"^[0-9+(). -]+$")),
        "repeats": count(v, r"(.)(?=\1)") / n,
        "before_name": flag(F.concat_ws(" ", "before2", "before").rlike(rf"(?i){NAME}\b")),
        "before_sign": flag(F.col("before").rlike(r"[:=]$")),
        # what a bare value is called; where a name of a secret stands, other words say nothing
        "before_other": flag(~named & F.concat_ws(" ", "before2", "before").rlike(r"(?i)\b(?:commit|sha|hash|id|uuid|file|path|url|page|order|invoice|example|version|doi|isbn|see)\b")),
        "mock": flag(v.rlike(r"(?i)^(?:[<{$%].*|none|null|true|false|pass|password|passwd|secret|.*(?:your|change|example|dummy|sample|placeholder|getenv|environ|redacted|xxxx|\*\*\*|test).*)$")),
        "in_url": flag(F.col("word").rlike(IN_URL)), "borne": flag(borne()), "small": flag(v.rlike("^[a-z]+$")),
        "after_mock": flag(F.col("after").rlike(r"(?i)^\W*(?:example|sample|placeholder|dummy|redacted)")),
    })


def labelled_findings(spark, rows: int = TRAIN_ROWS) -> DataFrame:
    """before2, before, word, after, label, form: known forms of secrets (1) and of what resembles them (0), half of each.

    Neighbours are drawn alike for both, so they tell nothing by themselves; a form may put words of its own there. Digests
    and draws are columns of their own, which the forms name: written out in each form they made a plan that took the driver
    a gigabyte of garbage.
    """
    parts: dict[tuple, tuple[str, Column]] = {}  # the columns that forms are made of

    def part(key: tuple, value: Column) -> Column:
        return F.col(parts.setdefault(key, (f"p{len(parts)}", value))[0])

    def draw(k: int, own: tuple) -> Column:
        listed = F.split(F.lit("\t".join(own)), "\t") if isinstance(own[0], str) else F.array(*map(F.lit, own))
        return part((k, own), F.element_at(listed, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(own))).cast("int") + 1))

    h = lambda k: part((k,), F.sha2(F.concat_ws("-", F.lit(k), "id"), 256))
    upper = F.translate(F.upper(F.substring(h(1), 1, 16)), "0189", "QXYZ")
    mixed = F.regexp_replace(F.base64(F.unhex(h(2))), "[+/=]", "x")
    around, around2 = draw(20, AROUND), draw(21, AROUND)
    name = draw(1, ("password", "token", "secret", "api_key", "auth", "db_password", "client-secret", "accessKey", "PASSWORD", "credentials"))
    sign, quote = draw(2, ("=", ":", "=")), draw(3, ("", '"', "'"))
    dictionary = lambda k: draw(k, DICTIONARY)
    digits = F.translate(F.substring(h(3), 1, 16), "abcdef", "123456")
    uuid = F.concat_ws("-", F.substring(h(4), 1, 8), F.substring(h(4), 9, 4), F.substring(h(4), 13, 4), F.substring(h(4), 17, 4), F.substring(h(4), 21, 12))
    hexes = F.substring(h(5), 1, draw(4, (18, 24, 32, 40, 64)))
    short = F.concat(F.substring(mixed, 1, draw(5, (5, 8, 12))), draw(6, ("!7", "9x", "$2", "_4k")))
    letters = lambda k: F.substring(F.translate(h(k), "0123456789abcdef", "etaoinshrdlucmfw"), 1, draw(k, (4, 6, 8, 12)))
    small = F.concat(letters(31), F.substring(digits, 1, draw(32, (1, 2, 3))), draw(33, ("", "x", "k", "q")))
    scheme, host = draw(34, ("postgres", "mysql", "https", "redis", "amqp", "mongodb+srv")), draw(35, ("host", "db.local:5432/main", "10.0.0.7/app", "mail4.example.com"))
    s, lit = F.concat, F.lit
    address = lambda x: s(scheme, lit("://"), draw(36, ("admin", "root", "app", "")), lit(":"), x, lit("@"), host)
    header, bearer = draw(37, ("Authorization:", "authorization:", "Authorization=", '"Authorization":')), draw(38, ("Bearer", "bearer", "Token", "Basic"))
    given = lambda x: s(name, sign, quote, x, quote)
    apart = lambda x: s(quote, x, quote)
    true = [
        (around2, around, s(lit("AKIA"), upper)),
        (around2, around, s(lit("ghp_"), F.substring(s(mixed, mixed), 1, 36))),
        (around2, around, s(lit("sk_live_"), F.substring(mixed, 1, 24))),
        (around2, around, s(lit("xoxb-"), digits, lit("-"), F.substring(mixed, 1, 24))),
        (around2, around, s(lit("AIza"), F.substring(s(mixed, mixed), 1, 35))),
        (around2, around, given(hexes)),
        (around2, around, given(short)),
        (around2, around, given(F.substring(s(mixed, mixed), 1, draw(7, (16, 20, 40))))),
        (name, lit("="), apart(hexes)),
        (name, lit("="), apart(F.substring(mixed, 1, 20))),
        (around, s(name, lit(":")), apart(F.substring(mixed, 1, 20))),
        (around, s(name, lit("=")), apart(short)),
        (around, s(name, lit(":")), apart(hexes)),
        (name, lit(":"), apart(short)),
        (around2, around, given(small)),
        (around2, around, address(short)),
        (header, bearer, hexes),
        (header, bearer, F.substring(s(mixed, mixed), 1, draw(39, (20, 32, 40)))),
        (around2, around, address(small)),
        (around, s(name, lit(":")), apart(small)),
        (name, lit("="), apart(small)),
    ]
    false = [
        (around2, around, digits),
        (around2, around, s(lit("/usr/lib/"), dictionary(1), lit("/"), dictionary(2), lit("-"), F.substring(h(7), 1, 3), lit("/"), dictionary(3))),
        (around, draw(8, ("commit", "sha", "hash", "id", "version")), hexes),
        (draw(9, ("commit", "sha256", "hash", "id")), around, F.substring(h(8), 1, 40)),
        (around, draw(10, ("id", "uuid", "see")), uuid),
        (around2, around, uuid),
        (around2, around, given(s(lit("changeme"), F.substring(digits, 1, 3)))),
        (around2, around, given(s(lit("your_"), dictionary(4), lit("_here")))),
        (around2, around, given(s(lit("${"), F.upper(s(draw(23, ("", "db_", "my", "aws")), draw(24, ("token", "pass", "key", "secret", "pw", "cred", "jwt", "home")))), lit("}")))),
        (around2, around, given(s(lit("<"), draw(25, AROUND), lit("-"), dictionary(16), lit(">")))),
        (around2, around, given(F.repeat(lit("x"), 16))),
        (around2, around, given(s(dictionary(11), dictionary(12), dictionary(13)))),
        (around2, around, s(dictionary(5), lit("_"), dictionary(6), lit("_"), dictionary(7), lit("_"), F.substring(digits, 1, 2))),
        (around2, around, s(lit("https://www.example.com/"), dictionary(8), lit("/"), dictionary(9), lit("-"), digits)),
        (around2, around, s(dictionary(10), lit("."), F.substring(digits, 1, 2), lit("@mail"), F.substring(digits, 1, 1), lit(".example.com"))),
        (around2, around, s(lit("AKIA"), lit("IOSFODNN7EXAMPLE"))),
        (name, lit("="), apart(s(dictionary(11), dictionary(12)))),
        (around, s(name, lit(":")), apart(s(dictionary(17), lit("_"), dictionary(18)))),
        (around2, around, s(lit("2024-"), F.substring(digits, 1, 2), lit("-"), F.substring(digits, 3, 2), lit("_"), dictionary(13), lit("-"), dictionary(14))),
        (around2, around, given(s(letters(41), letters(42)))),
        (around2, around, address(draw(43, ("password", "secret", "${DB_PASS}", "<password>", "your_password", "changeme", "xxxx", "***")))),
        (header, bearer, draw(44, ("<token>", "${TOKEN}", "your_token_here", "YOUR-API-KEY", "$ACCESS_TOKEN", "{{token}}"))),
        (around, s(name, lit(":")), apart(s(letters(45), letters(46)))),
        (around2, around, s(scheme, lit("://"), host, lit("/"), dictionary(47), lit("/"), F.substring(digits, 1, 8), lit("-"), dictionary(48))),
    ]
    base, after = spark.range(rows, numPartitions=1), draw(22, AROUND)

    def forms(own: list, label: float) -> DataFrame:
        form = F.pmod(F.floor(F.col("id") / 2), F.lit(len(own))).cast("int")
        pick = lambda i: reduce(lambda e, j: e.when(F.col("form") == j, own[j][i]), range(1, len(own)), F.when(F.col("form") == 0, own[0][i]))
        kept = base.where(F.pmod("id", F.lit(2)) == int(label)).select(form.alias("form"), *(value.alias(name) for name, value in parts.values()))
        return kept.select(pick(0).alias("before2"), pick(1).alias("before"), pick(2).alias("word"), after.alias("after"), F.lit(label).alias("label"), "form")

    return forms(true, 1.0).unionByName(forms(false, 0.0))


def train(findings: DataFrame, known: DataFrame | None = None) -> PipelineModel:
    """A forest over findings (before2, before, word, after, label)."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    findings = stored(findings.select("before2", "before", "word", "after", "label"))  # written out once, not once a feature
    rows = stored(assembler.transform(featured(findings, known)).select("features", "label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=32, seed=11).fit(rows)
    return PipelineModel([assembler, forest])


def scored(rows: DataFrame, model: PipelineModel, known: DataFrame | None = None) -> DataFrame:
    """rows with value, score (the forest's probability of a secret), secret."""
    p = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return model.transform(featured(rows, known).where("value <> ''")).withColumn("score", p).withColumn("secret", p >= 0.5)


def dictionary_of(docs: DataFrame) -> DataFrame:
    """part: the vocabulary of docs and the fixed words, as a stored table."""
    listed = docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, DICTIONARY))).alias("part")).where(F.char_length("part") >= 4)
    return stored(vocabulary(docs).union(listed).distinct())


def held_out_figures(findings: DataFrame, docs: DataFrame, forms: int = 4) -> dict[str, float]:
    """Precision and recall on every ``forms``-th form of findings (with form), by a forest trained on the other forms, with the
    dictionary that ``scan`` has for docs."""
    out, known = F.pmod("form", F.lit(forms)) == forms - 1, dictionary_of(docs)
    got = scored(findings.where(out), train(findings.where(~out), known), known)
    n = got.agg(*(F.sum(((F.col("label") == label) & (F.col("secret") == secret)).cast("int")) for label, secret in ((1, True), (0, True), (1, False)))).first()
    return {"precision": n[0] / max(1, n[0] + n[1]), "recall": n[0] / max(1, n[0] + n[2])}


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, at, value, score (the forest's probability of a secret), secret: a row for each candidate."""
    known = dictionary_of(docs)
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings, known)
    rows = stored(candidates(docs))
    return scored(rows, model, known).select("doc_id", "at", "value", "score", "secret")


def op8_secret_forest(spark, sf_dir) -> DataFrame:
    """Every candidate of every document; a secret is shown by its digest only."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("at").cast("long").alias("at"), F.char_length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def secrets_stage(spark, docs, sf_dir) -> DataFrame:
    """The documents, with each secret replaced by a mark, by row: doc_ids may be null or repeated. A secret is replaced wherever
    it stands by itself in its text, however long, not inside longer runs of letters and digits. Null texts stay null; a document
    with a secret gets a new n_chars. An empty table gives an empty result; extra columns are left out."""
    rows = with_row_key(docs)
    found = scan(rows.select(F.col("_id").alias("doc_id"), "text")).where("secret").groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("value"), asc=False).alias("values"))
    alone = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
    clean = F.aggregate("values", F.col("text"), lambda t, v: F.regexp_replace(t, alone(v), F.lit("[SECRET]")))
    rows = rows.hint("merge").join(found, "_id", "left")
    rows = rows.withColumn("text", F.coalesce(clean, F.col("text"))).withColumn("n_chars", F.when(F.col("values").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return rows.select(*DOC_COLUMNS)
