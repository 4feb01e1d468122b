"""The training-data operators against brute force, round trips and edge cases on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from notelode.llm import mixing, neardup, ogg, phrases, pieces, quality, secrets, tokens, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(5)
VOCABULARY = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(3000)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def table(spark, texts, sources=None):
    """Documents with nulls in other columns, and extra columns with the names of inner ones."""
    return spark.createDataFrame([(i, t, None, None if sources is None else sources[i], None, "x", 1) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " \n\t", "one", "one two three four", "a\x0bb  c\n\n\n d é ▁ \U0001f389 \x00", "x" * 5000, prose(20_000, 1), "tie tie tie", "tie tie tie", " nbsp  word　"]
EMPTY: list = []


def test_quality_base_counts_and_verdicts(spark):
    texts = [*ODD, prose(300, 2), prose(300, 2), "a b c d\na b c d\n" * 40, *[prose(200, k) for k in range(3, 20)], *[" ".join(w + "$$$%" for w in prose(200, k).split()) for k in range(30, 36)]]
    docs = table(spark, texts)
    good = spark.createDataFrame([(i,) for i in range(len(ODD) + 3, len(ODD) + 20)], "doc_id long")
    rows = {r.doc_id: r for r in quality.judge(docs, good).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {j + d for j, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)
    n = len(ODD)
    assert all(rows[i].kept for i in range(n + 3, n + 20)) and not any(rows[i].kept for i in range(n + 20, n + 26))
    assert quality.judge(table(spark, EMPTY), good).count() == 0
    assert quality.judge(docs, good.limit(0)).where("kept = base_failed").count() == 0


def spark_hash(*values):
    """Spark's xxhash64 of strings, ints (4 bytes) and longs (8)."""
    xxhash = pytest.importorskip("xxhash")
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed


def test_quality_ratios_against_brute_force(spark):
    buckets = 64
    texts = [prose(60 + k, k) for k in range(12)] + [prose(60, 3) + " junk$$" * 30, None, "", "one two"]
    ids = [*range(len(texts) - 1), 3, 3]  # a doc_id of two texts, and a repeated row
    texts = [*texts[: len(texts) - 1], texts[5], texts[5]]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(0, 12, 2)], "doc_id long")

    def grams(t):
        w = WORD.findall(t or "")
        return [spark_hash(x) % buckets for x in w] + [spark_hash(x, y) % buckets for x, y in zip(w, w[1:])] + [spark_hash(x[-1], (1, 4)) % buckets for x in w]

    signed = lambda h: h  # pmod of a signed 64-bit number by a power of two is that of the unsigned one
    raw, target = Counter(), Counter()
    for i, t in zip(ids, texts, strict=True):
        raw.update(map(signed, grams(t)))
        if i in range(0, 12, 2):
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    ratio = [round(float(np.log((target[b] + 1) / (m + buckets)) - np.log((raw[b] + 1) / (n + buckets))), 6) for b in range(buckets)]
    assert np.allclose(quality.bucket_ratios(docs, good, buckets), ratio, atol=2e-6)
    rows = quality.judge(docs, good, buckets).collect()
    expect = sorted((i, round(sum(ratio[g] for g in grams(t)) / max(1, len(grams(t))), 6)) for i, t in zip(ids, texts, strict=True))
    assert len(rows) == len(texts) and np.allclose(sorted((r.doc_id, r.llr) for r in rows), expect, atol=3e-6)
    own = [x for i, x in expect if i in range(0, 12, 2)]
    limit = np.mean(own) - max(quality.SIGMAS * np.std(own), quality.MARGIN)
    assert all(abs(r.threshold - limit) < 1e-5 and r.kept == (not r.base_failed and r.llr >= r.threshold) for r in rows)


def test_ogg_round_trip_and_damage(spark):
    rows = {r.doc_id: r for r in ogg.digests(table(spark, ODD)).collect()}
    files = {r.doc_id: r.media for r in ogg.encode(table(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
    assert rows[8].media_sha256 == rows[9].media_sha256
    big = bytes(files[7])
    assert ogg.read(big)[0].startswith(ODD[7].encode())
    for broken in (big[:100] + bytes([big[100] ^ 1]) + big[101:], big[:-1], big[27:], b"", None):
        bad = spark.createDataFrame([(1, bytearray(broken) if broken is not None else None)], "doc_id long, media binary")
        r = ogg.decode(bad).first()
        assert r.error and r.payload is None
    assert ogg.digests(table(spark, EMPTY)).count() == 0


def test_ogg_checksum_and_long_packets():
    def slow(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
        return crc

    assert all(ogg.checksum(x) == slow(x) for x in (b"", b"OggS", bytes(range(256))))
    packets = [b"a" * 255, b"", b"b" * 200_000, b"c"]
    stream = ogg.demux(b"".join(ogg.pages_of(7, packets, [255, 255, 200_255, 200_256])))[7]
    assert [p.data for p in stream.packets] == packets and stream.pages > 3 and ogg.timed(stream)[-1] == 200_256


def test_phrases_against_brute_force(spark):
    passage, other = prose(60, 100), prose(120, 101)
    texts = [f"{prose(40, 1)} {passage} {prose(30, 2)}", f"{prose(33, 3)}\n{passage}\t{prose(80, 4)}", other, other, f"x {other} y {passage}", " ".join(other.split()[30:90]), passage + " " + passage, *ODD, prose(20_000, 1) + " end"]
    docs = table(spark, texts).union(spark.createDataFrame([(None, other, None, None, None, "", 0)], SCHEMA))
    rows = {r.doc_id: r for r in phrases.dedup(docs, text=True).collect()}
    first = {}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = {j + d for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for d in range(50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept, rows[i].kept_sha256) == (len(w), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()), i
    assert rows[None].n_removed == 0
    assert phrases.dedup(table(spark, EMPTY)).count() == 0


def test_phrases_are_confirmed_by_words(spark):
    """Only what a shard's automaton finds, word by word, is removed; a shared hash of other words removes nothing."""
    s = phrases.Passages()
    s.add(3, b"a b c d".split(), np.array([0, 1]), np.array([3, 2]))
    assert s.marked(4, b"x a b c y b c".split()) == bytearray([0, 1, 1, 1, 0, 1, 1]) and not any(s.marked(3, b"a b c".split()))
    passage = prose(60, 100)
    owner, copy, other = f"{prose(40, 1)} {passage} {prose(30, 2)}", f"{prose(33, 3)} {passage} {prose(80, 4)}", prose(200, 5)
    w = phrases.Stretches([owner], 50)
    keys = [{"k1": int(x), "k2": int(y)} for x, y in zip(w.hash[40:51], w.hash2[40:51], strict=True)]  # the passage's windows
    # as if hashes said that documents 7 and 8 hold the windows of document 2
    rows = spark.createDataFrame([(7, copy, 0, None), (8, other, 0, None), (1, copy, 0, None), (2, owner, 0, keys)], "doc_id long, text string, shard long, keys array<struct<k1: long, k2: long>>")
    routed = phrases.routed(rows.coalesce(1), 50).sortWithinPartitions("shard", "turn")
    assert {r.doc_id: r.n_removed for r in phrases.removed(routed, False).collect()} == {7: 60, 8: 0, 1: 0}
    assert [r.text for r in routed.where("turn = 0").collect()] == [passage]


def test_toxicity_learns_folds_and_excepts(spark):
    bad = ["idiot", "m0r0n", "loweick"]
    texts = [f"{prose(60, k)} {bad[k % 3]} {prose(20, 900 + k)}" if k % 4 == 0 else prose(80, k) for k in range(400)] + ODD
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(table(spark, texts), labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i in range(400) if rows[i].held_out]
    assert sum(rows[i].predicted == int(i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert toxicity.score(table(spark, EMPTY), labels).count() == 0
    assert toxicity.score(table(spark, ODD), labels.limit(0)).where("predicted = 1").count() == 0
    m = toxicity.Matcher([("idiot", 1.0), ("clown", 2.0), ("stup*", 1.0)], ["clown fish"])
    assert [toxicity.density(m, x)[1] for x in ("1d10t", "іdiоt!", "a clown fish", "clown", "stupidly", "idiots", "", None)] == [1, 1, 0, 1, 1, 0, 0, 0]


def test_toxic_lexicon_against_brute_force(spark):
    rng = np.random.default_rng(6)
    bad = ["idiot", "idiotic", "m0ron", "scheiße", "bl0ckhead"]
    texts = [(prose(40, k) + (f" {bad[rng.integers(5)]} {bad[rng.integers(5)]}" if k % 3 == 0 else "") + (" idiot" if k == 1 else ""), int(k % 3 == 0)) for k in range(240)]
    train = toxicity.folded_words(spark.createDataFrame(texts, "text string, toxic int"))
    got = dict(toxicity.learn_lexicon(train))

    def grams(text):
        words = set(toxicity.split_folded(toxicity.fold(text)))
        return {w for w in words if len(w) >= 3} | {f"{w[:k]}*" for w in words for k in range(4, min(10, len(w)) + 1)}

    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {w for t, _ in texts for w in toxicity.split_folded(toxicity.fold(t))}], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    near = [min(hashes[w] for w in toxicity.split_folded(toxicity.fold(t))) for t, _ in texts]
    n = Counter(y for _, y in texts)
    k, c, support = Counter(), Counter(), {}
    for (t, y), h in zip(texts, near, strict=True):
        for g in grams(t):
            (k if y else c)[g] += 1
            if y:
                support.setdefault(g, set()).add(h)
    groups = len({h for (_, y), h in zip(texts, near, strict=True) if y})
    weight = {g: round(float(np.log((k[g] + 0.5) / (n[1] + 1)) - np.log((c[g] + 0.5) / (n[0] + 1))), 6) for g in k if len(support[g]) >= max(3, 0.01 * groups) and k[g] >= 0.01 * n[1]}
    expect = {}
    for g in sorted((g for g, w in weight.items() if w >= toxicity.MIN_RATIO), key=lambda g: (len(g.rstrip("*")), g)):
        if not any(f"{g.rstrip('*')[:m]}*" in expect for m in range(4, len(g.rstrip("*")) + 1)):
            expect[g] = weight[g]
    assert expect and set(got) == set(expect) and all(abs(got[g] - w) < 1e-5 for g, w in expect.items())


def test_url_features_and_held_out_labels(spark):
    from math import log2

    made = [f"https://h{i}.{('com', 'net', 'shop', 'xyz', 'org')[i % 5]}/{'a/b' if i % 2 else 'item'}/{i}{'?id=%d&ref=x' % i if i % 3 else ''}" for i in range(200)] + ["", "no url", "ftp://x", "http://ä.de/ü?q=1#f"]
    labels = [int(i % 5 == 3 or "?" in u and i % 7 == 0) for i, u in enumerate(made)]
    labelled = urls.with_label(spark.createDataFrame(list(zip(made, labels, strict=True)), "url string, label int"))
    n, k = urls.counts(labelled)
    for most in (1000, 2):  # many frequent suffixes, or few and a merge join for the others
        stats = urls.suffix_statistics(labelled, n, most)
        rows = urls.lexical(labelled, stats, k / n, labelled["label"]).select("url", "label", "features").collect()
        assert len(rows) == n
        for r in rows:
            u = r.url
            m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u)
            host, path = (m[1].lower(), m[2]) if m else ("", "")
            query = (re.search(r"(?s)\?([^#]*)", u) or [None, ""])[1]
            seen = [(x, y) for x, y in zip(made, labels, strict=True) if (re.match(r"(?s)^.*?://([^/?#]*)", x) or [None, ""])[1].lower().split(".")[-1] == host.split(".")[-1]]
            rate = (sum(y for _, y in seen) - r.label + 10 * k / n) / (len(seen) - 1 + 10)
            bits = -sum(c / len(u) * log2(c / len(u)) for c in Counter(u).values())
            expect = [len(u), len(host), len(path), len(query), len(re.findall("/[^/]", path)), len(host.split(".")), len(re.findall("[0-9]", u)) / max(1, len(u)), bits, len(re.findall("[^&=]+=", query)), len(re.findall("[-_%~.#@]", u)), rate, len(seen) / n]
            assert np.allclose(r.features.toArray(), expect), u
    figures = urls.held_out_figures(spark.createDataFrame([(u + str(j), y) for j in range(5) for u, y in zip(made, labels, strict=True)], "url string, label int"))
    print("held-out urls:", figures)
    assert figures["recall"] > 0.6 and figures["precision"] > 0.6


def test_url_rules_and_trees(spark):
    cases = [
        ("https://WWW.Example.org/es/1", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/17?x=1#y", "example.org", "/en/17", "example.org/en/1", "block"),
        ("http://a.org/q", "a.org", "/q", "org/", "allow"),
        ("http://a.com/fr/x", "a.com", "/fr/x", "com/fr/", "allow"),
        ("http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://a.net?b/c", "a.net", "", None, None), ("ftp://h.org", "h.org", "", None, None), ("no url", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ]
    pages = spark.createDataFrame([(i, c[0], "", "x") for i, c in enumerate(cases)] + [(100 + i, f"http://h{i}.com/{'de' if i % 2 else 'fr'}/{i}", "", "") for i in range(80)], "page_id long, url string, html string, host string")
    rows = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages.where("page_id between 6 and 10")).collect()} == {"allow"}


def test_token_blocks_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = [*ODD, "don't  'll x", " lead", "trail ", "é a  b"]
    rows = sorted(tokens.round_trip(table(spark, texts).repartition(3), path).collect())
    at = 0
    for r, (i, t) in zip(rows, enumerate(texts), strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokens.round_trip(table(spark, EMPTY), path).count() == 0
    # many small shards, many rows of one doc_id and of none: the same starts
    again = table(spark, texts).selectExpr("if(doc_id < 4, null, 3) AS doc_id", "text")
    small = sorted(((r.start, r.n_tokens) for r in tokens.round_trip(again, path, shard_chars=4000, shard_ids=1).collect()))
    assert [a for a, _ in small] == np.cumsum([0, *[n for _, n in small][:-1]]).tolist() and sorted(n for _, n in small) == sorted(r.n_tokens for r in rows)


def test_forgotten_pieces_are_learned_again(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "MEMORY", 40)
    path = public.path("byte_bpe_50k.json")
    tok, own = Tokenizer.from_file(path), tokens.Pieces(path)
    for k in range(8):
        texts = [prose(60, k % 3), f" edge {k} ", prose(5, k) + "\u00a0x  y\n z", ""]
        ids, counts = own.encode(texts, 0)
        expect = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
        assert ids.tolist() == [x for e in expect for x in e] and counts.tolist() == list(map(len, expect))


def test_pieces_of_one_hash_are_told_apart_by_bytes():
    data = np.frombuffer(b" ab cd ab c  ab", np.uint8)
    starts, ends = np.array([0, 3, 6, 9, 12]), np.array([3, 6, 9, 12, 15])
    for keys in ([1, 1, 1, 1, 1], [1, 2, 1, 3, 1], [5, 5, 1, 1, 5]):
        first, of = tokens.Pieces.equal(np.array(keys, np.uint64), data, starts, ends)
        raw = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
        assert [raw[first[k]] for k in of] == raw
    starts, ends = np.array([0, 3]), np.array([3, 15])
    first, of = tokens.Pieces.equal(np.array([1, 1], np.uint64), data, starts, ends)
    assert first.tolist() == [0, 1] and of.tolist() == [0, 1]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_pack_any_values(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(5, 9, n, dtype=np.uint32), np.where(rng.random(n) < 0.05, 2**31, 7).astype(np.uint32), np.full(n, 3, np.uint32)):
        raw = tokens.encode_shard(np.arange(1), np.array([n]), ids)
        assert (tokens.decode_shard(raw)[2] == ids).all()
        with pytest.raises(ValueError):
            tokens.decode_shard(raw[:30] + bytes([raw[30] ^ 1]) + raw[31:])


def test_mixing_targets_and_epochs(spark):
    texts = [prose(10 + k % 7, k) for k in range(600)] + ODD
    sources = [f"s{k % 5}" if k % 3 else "hot" for k in range(600)] + [None] * len(ODD)
    docs = table(spark, texts, sources)
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) and len(rows) == len(texts)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size and r.taken >= r.epochs * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(r.source_size == size[r.source] for r in rows) and all(abs(taken[s] - t) <= 1 for s, t in target.items())
    order = [*sorted(s for s in size if s is not None), None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, free, fixed = 1.5 * sum(size.values()), set(order), {}
    while over := [s for s in free if (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) > 2 * size[s]]:
        for s in over:
            free.discard(s)
            fixed[s] = 2 * size[s]
    expect = fixed | {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
    assert all(abs(expect[s] - target[s]) < 1e-6 * max(1, expect[s]) for s in order)
    assert mixing.mix(table(spark, EMPTY)).count() == 0
    assert sum(r.taken for r in mixing.mix(table(spark, [None, "", ""])).collect()) == 0


def test_mixing_draws_against_brute_force(spark):
    texts = [prose(5 + k % 9, k) + " #$ %" * (k % 4) for k in range(300)]
    sources = ["a" if k % 3 else "b" for k in range(300)]
    rows = {r.doc_id: r for r in mixing.mix(table(spark, texts, sources)).collect()}
    for source in "ab":
        own = [i for i in range(300) if sources[i] == source]
        size = {i: len(WORD.findall(texts[i])) for i in own}
        key = {}
        for i in own:
            u = ((spark_hash((17, 4), (i, 8)) >> 11) + 0.5) / 2**53
            key[i] = -np.log(u) * (1 + min(4.0, len(re.findall(r"[#*$%&|<>]", texts[i])) / max(1, size[i])))
        target, total = rows[own[0]].target, sum(size.values())
        epochs = int(target // total)
        rest = round(target - epochs * total)
        for i in sorted(own, key=lambda i: (key[i], i, size[i])):
            part = min(size[i], max(0, rest))
            rest -= size[i]
            assert rows[i].taken == epochs * size[i] + part, i


def test_secrets(spark):
    key, hexed = "AKIA" + "SJDZWJNP6ZRYWK44", hashlib.sha1(b"x").hexdigest()
    texts = [f"{prose(30, 1)} {key} {prose(5, 2)}", f'a token = "{hexed}" b', f"z password={hexed[:18]} y", "password=changeme1 x", "card 4653732687131581 ok", "mail bgta.64@mail4.example.com", "commit " + hexed + " done", *ODD]
    rows = secrets.scan(table(spark, texts)).collect()
    assert {(r.doc_id, r.value) for r in rows if r.secret} == {(0, key), (1, hexed), (2, hexed[:18])}
    assert [r.at for r in rows if r.doc_id == 0] == [30]
    clean = {r.doc_id: r.text for r in secrets.secrets_stage(spark, table(spark, texts), "").collect()}
    assert clean[1] == 'a token = "[SECRET]" b' and clean[5] == texts[5] and clean[7] is None and len(clean) == len(texts)
    assert secrets.scan(table(spark, EMPTY)).count() == 0


def test_secrets_of_prefixed_names(spark):
    told = ["db_password: hunter2x", '"client_secret": "abcDEFgh12"', "DB_PASSWORD = s3cretpw", "clientSecret=9f86d081884c7d65ab", "a spring.datasource.password = 4f9a7c21e0b8d35f b", '{"client_secret":"abcDEFgh12"}', "my-auth-token Zx81kQ0pLm2vTr99 b"]
    values = ["hunter2x", "abcDEFgh12", "s3cretpw", "9f86d081884c7d65ab", "4f9a7c21e0b8d35f", "abcDEFgh12", "Zx81kQ0pLm2vTr99"]
    other = ["db_password=correcthorse", "compass: northeast", "author: somebody", "the db_password is"]
    docs = table(spark, [*told, *other])
    found = {(r.doc_id, r.value): r.secret for r in secrets.scan(docs).collect()}
    assert {k for k, secret in found.items() if secret} == set(enumerate(values)) and (len(told), "correcthorse") in found
    clean = {r.doc_id: r.text for r in secrets.secrets_stage(spark, docs, "").collect()}
    assert [clean[i] for i in range(len(told) + len(other))] == [*[t.replace(v, "[SECRET]") for t, v in zip(told, values, strict=True)], *other]


def test_secrets_whatever_stands_before_them(spark):
    """Words that may name a harmless value do not hide a secret that has a name; held-out forms are told apart."""
    hexed = hashlib.sha1(b"y").hexdigest()
    told = [f'the password="{hexed}"', f'see password="{hexed}"', f'in file password="{hexed}"', f"user id token={hexed}", f"commit api_key={hexed}", f'url page secret = "{hexed}"']
    other = ["see commit " + hexed, "sha256 hash " + hexed, 'see password="your_password_here"', "user id token=${TOKEN}", "order id 4653732687131581", f"uuid id {hexed[:8]}-{hexed[8:12]}-4{hexed[13:16]}-8{hexed[17:20]}-{hexed[20:32]}"]
    found = {(r.doc_id, r.secret) for r in secrets.scan(table(spark, [*told, *other])).collect()}
    assert {i for i, secret in found if secret} == set(range(len(told)))
    figures = secrets.held_out_figures(secrets.labelled_findings(spark, 4000), table(spark, [prose(300, k) for k in range(40)]))
    print("held-out forms:", figures)
    assert figures["precision"] >= 0.75 and figures["recall"] >= 0.95


def test_secrets_of_urls_headers_and_bare_texts(spark):
    hexed = hashlib.md5(b"z").hexdigest()
    told = {"password=hunter2x": "hunter2x", f"Authorization: Bearer {hexed}": hexed, "postgres://admin:Xk39fjQ2@host": "Xk39fjQ2", "use mysql://app:mfu4x9Qq!7@db.local:5432/main now": "mfu4x9Qq!7"}
    other = ["password: correcthorsebattery", "postgres://user:password@localhost", "Authorization: Bearer <token>", "https://www.example.com:8080/a/b@c", "bearer shares"]
    docs = table(spark, [*told, *other])
    found = {(r.doc_id, r.value) for r in secrets.scan(docs).collect() if r.secret}
    assert found == set(enumerate(told.values()))
    clean = {r.doc_id: r.text for r in secrets.secrets_stage(spark, docs, "").collect()}
    assert [clean[i] for i in range(len(clean))] == [*[t.replace(v, "[SECRET]") for t, v in told.items()], *other]


def test_copied_pass_phrases_do_not_hide_themselves(spark):
    """What stands after a sign is no dictionary word, however often it is copied; secrets inside longer runs stay."""
    docs = table(spark, ["a garden here", *["password: gardenia", 'x="gardenia"', "token = 'gardenia'"] * 4, *["the garden grows"] * 5])
    parts = {r.part for r in secrets.vocabulary(docs).collect()}
    assert "garden" in parts and "grows" in parts and "gardenia" not in parts
    value = "hunter2x"
    text = f"password={value} and {value}, not x{value}y nor {value}7 \\E"
    clean = secrets.secrets_stage(spark, table(spark, [text]), "").first().text
    assert clean.startswith("password=[SECRET] and [SECRET], not ") and f"x{value}y" in clean and clean.endswith("\\E")


def test_stages_keep_rows_of_null_and_repeated_ids(spark, tmp_path):
    key = "AKIA" + "SJDZWJNP6ZRYWK44"
    ids = [None, None, 1, 1, 2, None]
    texts = [*[prose(200, k) for k in range(400, 405)], "too short"]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    every = sorted(zip(ids, texts, strict=True), key=str)
    assert rows(quality.quality_stage(spark, docs, str(tmp_path))) == [x for x in every if x[1] != "too short"]
    again = docs.union(docs.where("doc_id = 1")).union(docs.limit(1).selectExpr("9L", *docs.columns[1:]))
    assert rows(neardup.neardup_stage(spark, again, "")) == sorted([*[x for x in every if x != (None, texts[0])], (9, texts[0])], key=str)
    told = docs.selectExpr("doc_id", f"if(doc_id <=> 2, text, concat(text, ' {key}')) AS text", *docs.columns[2:])
    assert rows(secrets.secrets_stage(spark, told, "")) == sorted(((i, t if i == 2 else t + " [SECRET]") for i, t in every), key=str)
    mixed = Counter(rows(mixing.mixing_stage(spark, docs, "")))
    assert set(mixed) == set(every) and set(mixed.values()) <= {1, 2}


def test_pieces_are_lossless_and_reproducible(spark):
    pytest.importorskip("public_tokenizers")
    model = pieces._model()
    docs = table(spark, [*ODD, " lead  two ", "   "])
    rows = {r.doc_id: r for r in pieces.encode(docs, model).collect()}
    again = {r.doc_id: r for r in pieces.encode(docs.repartition(5), model).collect()}
    assert all(r.lossless and r.ids == again[i].ids for i, r in rows.items()) and rows[8].ids != [] and list(rows[1].ids) == []
    back = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate([*ODD, " lead  two ", "   "]))
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert sp.decode(list(rows[5].ids)) == ODD[5]
    assert pieces.encode(table(spark, EMPTY), model).count() == 0
    assert {r.n_ids for r in pieces.encode(table(spark, ["", None]), model, digest=True).collect()} == {0}
    clash = table(spark, ["a b"]).selectExpr("*", "'x' AS ids", "1 AS lossless", "2 AS decoded")
    r = pieces.decode(pieces.encode(clash, model), model).first()
    assert (r.lossless, r.decoded) == (True, "a b") and len(r.ids) >= 2


def test_piece_sampling_follows_the_lattice():
    pytest.importorskip("public_tokenizers")
    own = pieces.lattice(pieces._model(), 1.0)
    known = {p: i for i, p in enumerate(own.pieces)}

    def paths(t):
        if not t:
            yield ()
        for k in range(1, len(t) + 1):
            if t[:k] in known:
                for rest in paths(t[k:]):
                    yield (known[t[:k]], *rest)

    weights = {s: float(np.exp(sum(own.weight[i] for i in s))) for s in paths("▁then")}
    ids, number = own.sample(["then"] * 20_000, np.arange(20_000), 3)
    drawn = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(number)[:-1]))
    total = sum(weights.values())
    assert set(drawn) <= set(weights) and all(abs(drawn[s] / 20_000 - w / total) < 0.015 for s, w in weights.items())


def test_neardup_against_brute_force(spark):
    base = [prose(200, k) for k in range(6)]
    near = lambda t, k: " ".join(w if j != k else "changed" for j, w in enumerate(t.split()))
    texts = [*base, *[near(base[0], k) for k in range(0, 200, 9)], base[1], near(base[2], 5), " ".join(base[3].split()[:100]) + " " + prose(100, 77), *ODD]
    rows = {r.doc_id: r for r in neardup.classes(table(spark, texts)).collect()}
    sets = [set(zip(*[w[i:] for i in range(5)])) if len(w := WORD.findall(t or "")) >= 5 else {tuple(w)} for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or sets[i] != {()} and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert [rows[i].class_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert neardup.classes(table(spark, EMPTY)).count() == 0 and neardup.classes(table(spark, [None, "", "x"])).where("class_id <> 0").count() == 1


def test_neardup_finds_links_between_members_of_other_leaders(spark, tmp_path):
    """Nested texts of 100, 132, 105, 126 shingles in one bucket: 105 and 126 are linked, whoever leads; in blocks of any size."""
    words = [f"w{k}" for k in range(200)]
    sizes = (100, 132, 105, 126)
    docs = neardup.with_node(spark.createDataFrame([(i, " ".join(words[: n + 4])) for i, n in enumerate(sizes)], "doc_id long, text string"))
    texts = docs.selectExpr("node", "doc_id as first", "array(7L) AS keys", "array(7L) AS plain", "100L AS size")
    kept = neardup.BLOCK_TEXTS
    try:
        for neardup.BLOCK_TEXTS in (kept, 1):
            comps = neardup.components_of(texts, docs, np.ones(16, np.float32), 0.8, neardup.Scratch(spark))
            assert len(got := comps.collect()) == 4 and len({r.comp for r in got}) == 1
    finally:
        neardup.BLOCK_TEXTS = kept


def test_neardup_finds_texts_that_repeat_their_lines(spark):
    """Like sets of shingles, but one text says all of it five times or its first half nine times."""
    base = [prose(200, k) for k in range(300, 304)]
    half = lambda t: " ".join(t.split()[:100])
    texts = [*base, *[" ".join([t] * 5) for t in base[:2]], *[" ".join([half(t)] * 9 + [t]) for t in base[2:]]]
    rows = {r.doc_id: r.class_id for r in neardup.classes(table(spark, texts)).collect()}
    assert rows == {i: i % 4 for i in range(8)}


def exact_classes(texts, least=0.8, buckets=neardup.BUCKETS):
    """Links by brute force, weighted or plain, over all pairs of texts; the class of each text and all links."""
    n = len(texts)
    counts = np.zeros(buckets, np.int64)
    vecs = []
    for t in texts:
        h, times, _ = neardup.weighted([t])
        np.add.at(counts, np.unique((h % np.uint64(buckets)).astype(np.int64)), 1)
        vecs.append(dict(zip((h & np.uint64((1 << 48) - 1)).tolist(), times.tolist(), strict=True)))
    idf = neardup.bin_weights(counts, n)
    weight = lambda x: float(idf[x % buckets])
    holders = {}
    for i, v in enumerate(vecs):
        for x in v:
            holders.setdefault(x, []).append(i)
    sizes = [sum(c * weight(x) for x, c in v.items()) for v in vecs]
    near = {(j, i) for own in holders.values() for i in own for j in own if j < i}
    links = {}
    for j, i in near:
        common = [x for x in vecs[i] if x in vecs[j]]
        both = sum(min(vecs[i][x], vecs[j][x]) * weight(x) for x in common)
        w, p = both / (sizes[i] + sizes[j] - both), len(common) / (len(vecs[i]) + len(vecs[j]) - len(common))
        if max(w, p) >= least:
            links[j, i] = w, p
    return links


def test_neardup_recall_of_links_at_planted_distances(spark):
    """Copies of 250 words with 1 to 12 changed words, half of them with each line said twice in one of the two; a hot group."""
    rng = np.random.default_rng(8)

    def changed(t, k):
        w = t.split()
        for i in rng.choice(len(w), k, replace=False):
            w[i] = f"new{rng.integers(1 << 30)}"
        return " ".join(w)

    texts = []
    for k in range(120):
        t = prose(250, 5000 + k)
        texts += [t, changed(t, 1 + k % 12)]
        if k % 2:
            texts[-1] += "\n" + texts[-1]
    hot = prose(150, 4999)
    texts += [changed(hot, int(rng.integers(0, 9))) for _ in range(150)]
    links = exact_classes(texts)
    rows = {r.doc_id: r.class_id for r in neardup.classes(table(spark, texts)).collect()}
    for least, most in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        own = [x for x, s in links.items() if least <= max(s) < most]
        share = np.mean([rows[i] == rows[j] for i, j in own])
        print(f"similarity {least} to {most}: {len(own)} links, in one class {share:.3f}")
        assert share >= 0.97
    found = {frozenset(x) for x in links}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    assert all(find(i) == find(c) for i, c in rows.items()) and found  # nothing else is put together


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_neardup_recall_on_tables(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    links = exact_classes([t for _, t in rows])
    found = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    share = np.mean([found[rows[i][0]] == found[rows[j][0]] for i, j in links])
    print(f"{sf}: {len(links)} links, in one class {share:.3f}")
    assert share >= 0.98


def test_neardup_of_pasted_texts_and_rows_without_ids(spark):
    t, other = prose(300, 61), prose(300, 62)
    docs = spark.createDataFrame([(5, t), (3, t + " " + t), (None, t), (None, other), (9, None), (8, ""), (8, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in neardup.classes(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (None, 3), (None, None), (9, 8), (8, 8), (8, 8)], key=str)
    wide = docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "1L AS n_chars", "'clash' AS node", "1 AS comp", "2 AS key", "3 AS keys")
    kept = sorted(((r.doc_id, r.text) for r in neardup.neardup_stage(spark, wide, "").collect()), key=str)
    assert kept == sorted([(3, t + " " + t), (None, other), (8, "")], key=str)
    assert neardup.neardup_stage(spark, wide.limit(0), "").count() == 0


def test_icws_agrees_as_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    w = rng.random((2, 300)) * (rng.random((2, 300)) < 0.8) + 1e-9
    sim = np.minimum(*w).sum() / np.maximum(*w).sum()
    keys = neardup.signatures(np.concatenate([h, h]), w.reshape(-1), np.array([300, 300]), 3000, 1)
    assert abs((keys[0] == keys[1]).mean() - sim) < 0.04


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages in a row over documents with nulls, repeats, copies, near copies, secrets, short texts and extra columns."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    secret = "AKIA" + "SJDZWJNP6ZRYWK44"
    one = prose(90, 700).split()
    texts = [prose(60 + k, 800 + k) for k in range(24)] + [prose(30, 1), None, "", prose(80, 801 + 20), f"{prose(70, 900)} {secret} {prose(9, 901)}", " ".join(one), " ".join([*one[:50], "other", *one[51:]]), "a b c " * 40]
    ids = [*range(22), None, None, *range(100, 107), 3]
    rows = [(i, t, None, (None, "a", "b")[k % 3], None, "x", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [rows[4], rows[4]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def base_failed(t):
        w = WORD.findall(t or "")
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {j + d for j, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for d in range(3)}
        return len(w) < 50 or 100 * len(covered) > 50 * len(w)

    kept = [(r[0], r[1], r[3]) for r in rows if not base_failed(r[1])]
    links = exact_classes([t for _, t, _ in kept])
    classes = list(range(len(kept)))
    for _ in kept:  # labels spread over links and copies
        for i, j in [*links, *((i, j) for j in range(len(kept)) for i in range(j) if kept[i][1] == kept[j][1])]:
            classes[i] = classes[j] = min(classes[i], classes[j])
    best = {}
    for k, (c, (i, t, s)) in enumerate(zip(classes, kept, strict=True)):
        order = (i is None, -1 if i is None else i, hashlib.md5(t.encode()).digest())
        if c not in best or order < best[c][0]:
            best[c] = order, k
    docs = [(kept[k][0], kept[k][1].replace(secret, "[SECRET]"), kept[k][2]) for _, k in best.values()]
    size = {x: len(WORD.findall(x[1])) for x in docs}
    total = {s: sum(size[x] for x in docs if x[2] == s) for s in {x[2] for x in docs}}
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, free, fixed = 1.5 * sum(total.values()), set(order), {}
    while over := [s for s in free if (budget - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) > 2 * total[s]]:
        for s in over:
            free.discard(s)
            fixed[s] = 2 * total[s]
    target = fixed | {s: (budget - sum(fixed.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
    expect = Counter()
    for s in order:
        own, key = [x for x in docs if x[2] == s], {}
        for x in own:
            h = spark_hash(*([] if x[0] is None else [(x[0], 8)]), x[1])
            u = ((spark_hash((17, 4), (h - (1 << 64) if h >> 63 else h, 8)) >> 11) + 0.5) / 2**53
            key[x] = -np.log(u) * (1 + min(4.0, len(re.findall(r"[#*$%&|<>]", x[1])) / size[x]))
        epochs = int(target[s] // total[s])
        rest = round(target[s] - epochs * total[s])
        for x in sorted(own, key=key.get):
            part = min(size[x], max(0, rest))
            rest -= size[x]
            expect[x] += int((epochs * size[x] + part) / size[x] + 0.5)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == +expect and all(r.lossless and len(r.ids) > 0 for r in got)
    assert any("[SECRET]" in r.text for r in got) and not any(secret in r.text for r in got)
    empty = tmp_path / "empty"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_registered_queries_and_stages():
    import __spark_entry__ as entry
    import corpus_pipeline

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and 4 <= len(corpus_pipeline.STAGES) <= 5
