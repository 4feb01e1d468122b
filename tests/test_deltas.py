"""An updated store against one that is built anew: random edits, merges, broken and repeated updates, reviews, hot names."""

import random
import uuid

import pytest

from notelode.operators import deltas
from notelode.operators.deltas import TABLES, Store
from notelode.plans.checkpoints import shared_dir

WORDS = ["document", "collection", "evidence!", "Relations", "statement", "versioned", "catalogue", "short", "and", "überblick"]


def text_of(r):
    lines = [" ".join(r.choice(WORDS) for _ in range(r.randrange(0, 8))) for _ in range(r.randrange(0, 6))]
    return r.choice([None, ""]) if r.random() < 0.1 else "\n".join(lines)


def docs(spark, some):
    return spark.createDataFrame(sorted(some.items()), "doc_id long, text string")


def fresh(spark, **given):
    return Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", buckets=4, **given)


def rows(store):
    return {name: sorted(map(tuple, store.state(name).collect())) for name in TABLES}


def open_items(store, kind):
    return {r.key for r in store.queue().where("status <> 'closed'").collect() if r.kind == kind}


def test_updated_equals_rebuilt(spark):
    r = random.Random(6)
    now = {i: text_of(r) for i in range(40)}
    store = fresh(spark, most_versions=3)
    store.apply(docs(spark, now))
    claims = {x.claim_id for x in store.claims().collect()}
    for _ in range(4):
        changed = {i: text_of(r) for i in r.sample(range(60), 9)}
        gone = set(r.sample(range(70), 6))
        store.apply(docs(spark, changed), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        now = {i: t for i, t in (now | changed).items() if i not in gone}
        claims |= {x.claim_id for x in store.claims().collect()}
    again = fresh(spark)
    again.apply(docs(spark, now))
    assert rows(store) == rows(again)
    assert open_items(store, "lonely_object") == open_items(again, "lonely_object")
    assert open_items(store, "orphan_claim") == claims - {x.claim_id for x in again.claims().collect()}
    known, before = store.versions(), rows(store)
    store.merge()
    store.clean()
    assert len(known) > 1 and len(store.versions()) == len(store._folders()) == 1 and rows(store) == before


def test_an_update_writes_what_changed_alone(spark):
    store = fresh(spark)
    first = store.apply(docs(spark, {i: f"everywhere the versioned document number{i} stands\nsecond lines stay" for i in range(300)}))
    second = store.apply(docs(spark, {7: "everywhere the versioned document number7 stands\nanother line comes"}))
    size = lambda name, v: store._rows(name, ", ".join(TABLES[name]), None, [v]).count()
    assert size("blocks", first) == 600 and size("blocks", second) == 2
    assert size("objects", first) == 3 and size("objects", second) == 0  # no name came or went
    assert {(r.name, r.blocks, r.docs) for r in store.state("objects").collect()} == {("everywhere", 300, 300), ("versioned", 300, 300), ("document", 300, 300)}
    third = store.apply(docs(spark, {7: "everywhere the versioned document number7 stands\nanother line comes"}))
    assert all(size(name, third) == 0 for name in TABLES)


def test_broken_update_is_not_seen_and_can_be_given_again(spark, monkeypatch):
    store = fresh(spark)
    store.apply(docs(spark, {1: "document collection", 2: "document"}))
    before = rows(store)
    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.apply(docs(spark, {1: "statement"}))
    assert rows(store) == before and len(store.versions()) == 1
    store.apply(docs(spark, {1: "statement"}))
    assert sorted((r.name, r.docs) for r in store.state("objects").collect()) == [("document", 1), ("statement", 1)]


def test_reviewed_items_stay_until_their_reason_goes(spark):
    store, none = fresh(spark), spark.createDataFrame([], "doc_id long, text string")
    store.apply(none)
    assert all(not some for some in rows(store).values()) and store.queue().count() == 0
    store.apply(docs(spark, {1: "document collection", 2: "document"}))
    store.review(spark.createDataFrame([("lonely_object", "collection"), ("lonely_object", "unknown")], "kind string, key string"))
    status = lambda: {r.key: r.status for r in store.queue().collect()}
    assert status() == {"collection": "dismissed"}
    store.apply(docs(spark, {1: "collection and document", 3: "catalogue"}))
    assert status() == {"collection": "dismissed", "catalogue": "open"}
    store.apply(docs(spark, {4: "collection"}), docs(spark, {3: ""}).select("doc_id"))
    assert status() == {"collection": "closed", "catalogue": "closed"}
    store.apply(none, docs(spark, {4: ""}).select("doc_id"))
    assert status()["collection"] == "open"


def test_names_of():
    assert deltas.names_of("a long, b string") == ["a", "b"]
