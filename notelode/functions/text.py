"""Column functions over text, links and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def stable_id(kind: str, *parts) -> Column:
    """kind and 24 hex digits of the SHA-256 of the white-space-normalised parts."""
    joined = F.concat_ws("\x1f", *[normalize_text(p) for p in parts])
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(joined, 256), 1, 24))


def name_fingerprint(name) -> Column:
    """What like names have in common: no remarks in parentheses, lower case, plural endings off each word, no marks within
    words of which two letters or more are left, no spaces."""
    bare = F.lower(F.regexp_replace(name, r"[（(][^（()）]*[)）]", ""))
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")

    def stem(w: Column) -> Column:
        n = F.char_length(w)
        ending = (
            F.when(w.endswith("ies") & (n > 4), F.concat(w.substr(F.lit(1), n - 3), F.lit("y")))
            .when(w.rlike("(sses|xes|zes|ches|shes)$"), w.substr(F.lit(1), n - 2))
            .when(w.endswith("s") & ~w.rlike("(ss|us|is|os|as)$"), w.substr(F.lit(1), n - 1)).otherwise(w)
        )
        return F.when((n > 3) & w.rlike("^[a-z]+$"), ending).otherwise(w)

    def strip(w: Column) -> Column:
        kept = F.regexp_replace(w, r"[^\p{L}\p{N}_]+", "")
        return F.when(F.char_length(kept) > 1, kept).otherwise(w)

    joined = F.array_join(F.transform(words, lambda w: strip(stem(w))), "")
    return F.when(joined != "", joined).otherwise(F.regexp_replace(bare, r"(?U)\s+", ""))


def normalize_body(c) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def shingles(c, k: int = 5) -> Column:
    """The different runs of k characters, by a look-ahead at each place; a shorter text is one run."""
    runs = F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))
    return F.when(F.char_length(c) < k, F.array(c)).otherwise(runs)


def jaccard(a, b) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def words(c) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clean_markdown(c) -> Column:
    """Images off, links to their texts, marks and HTML tags off, blank lines joined."""
    for pattern, by in ((r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", ""), (r"[*_`#]+", ""), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def html_text(c) -> Column:
    """The visible text of a page: scripts, styles, comments and tags off, white space joined."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    return normalize_text(F.regexp_replace(c, r"<[^>]+>", " "))


#: Query parameters that do not tell one page from another (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "spm")


def normalize_url(c) -> Column:
    """Lower case, without fragment, tracking parameters, or slashes at the path's end."""
    raw = F.trim(c)
    bare = F.regexp_replace(raw, "#.*$", "")
    head = F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)", 1)
    path = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+([^?]*)", 1)
    asked = F.regexp_extract(bare, r"\?(.*)$", 1)
    pairs = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*TRACKING))
    pairs = F.transform(pairs, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    joined = F.array_join(pairs, "&")
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.lower(F.when(head == "", raw).otherwise(F.concat(head, path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))))


def block_kind(c) -> Column:
    return (
        F.when(c.rlike(r"^```"), "code").when(c.rlike(r"^\|.*\|$| \| "), "table").when(c.rlike(r"^(?:[-*+]|[0-9]+[.)]) "), "list")
        .when(c.rlike("^>"), "quote").when(c.rlike("^#{1,6} "), "heading").otherwise("paragraph")
    )
