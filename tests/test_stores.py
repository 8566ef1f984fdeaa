"""Repository discovery, integrity in one pass, and stored differences."""

import datetime as dt
import itertools
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import diff_store, publication, search
from tessera.sources import read_repositories
from tessera.sources.repositories import fingerprint_of


def git(folder, head="ref: refs/heads/main\n", loose=None, packed=None):
    (folder / ".git/refs/heads").mkdir(parents=True)
    if head is not None:
        (folder / ".git/HEAD").write_text(head)
    if loose:
        (folder / ".git/refs/heads/main").write_text(loose + "\n")
    if packed:
        (folder / ".git/packed-refs").write_text(packed)


def test_repositories_at_any_depth(spark, tmp_path):
    deep = tmp_path / "a/b/c/d/e/f/g"
    git(deep, loose="1" * 40)
    git(deep / "h/nested", packed="# pack\n^x\n" + "2" * 40 + " refs/heads/main\n" + "3" * 40 + " refs/heads/mainly\n")
    git(tmp_path / "detached", head="4" * 40)
    git(tmp_path / "unborn")
    git(tmp_path / "odd", head="ref: refs/../x")
    git(tmp_path / "none", head=None)
    git(tmp_path / "node_modules/skipped", loose="5" * 40)
    git(tmp_path / "a/.git/inner", loose="6" * 40)
    os.symlink(tmp_path / "a", tmp_path / "link")
    found = {os.path.relpath(r.path, tmp_path): (r.head, r.fingerprint == fingerprint_of(r.path, r.head)) for r in read_repositories(spark, str(tmp_path), ("node_modules",)).collect()}
    expected = {"a/b/c/d/e/f/g": "1" * 40, "a/b/c/d/e/f/g/h/nested": "2" * 40, "detached": "4" * 40, "unborn": "ref: refs/heads/main", "odd": "ref: refs/../x", "none": None, "a": None}
    assert found == {k: (v, True) for k, v in expected.items()}
    (tmp_path / "empty").mkdir()
    assert read_repositories(spark, str(tmp_path / "empty")).count() == 0 and read_repositories(spark, str(tmp_path / "gone")).count() == 0
    assert read_repositories(spark, f"file://{deep}").first().head == "1" * 40


ENTITY, EDGE = "publication_id long, entity_id string", "publication_id long, relationship_id string, source_id string, target_id string"


def test_integrity_tells_every_fault(spark):
    entities = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b")], ENTITY)
    edges = spark.createDataFrame([(1, "r", "a", "b"), (1, "r", "a", "b"), (1, "s", "a", "a"), (1, "t", "x", "y"), (2, "u", "a", "b"), (2, "v", "a", "x")], EDGE)
    evidence = spark.createDataFrame([(2, "a", "e1"), (2, "a", "e1"), (2, "b", "e2"), (2, "u", "e3"), (2, "u", "e4")], "publication_id long, object_id string, evidence_id string")
    provenance = spark.createDataFrame([(2, "a", "e1", "l"), (2, "b", "e9", "l"), (2, "u", "e3", "l"), (2, "u", "e4", None)], "publication_id long, object_id string, evidence_id string, lineage string")
    stored = spark.createDataFrame([("e1", "l"), ("e3", "other"), ("e4", "l"), ("e7", "unused")], "evidence_id string, lineage string")
    declared = spark.createDataFrame([(1, "h"), (2, "h"), (3, "h"), (4, "h")], "publication_id long, content_hash string")
    computed = spark.createDataFrame([(1, "h"), (2, "g"), (5, "h"), (4, None)], "publication_id long, content_hash string")
    got = sorted((str(r.publication_id), r.object_id, r.problem) for r in publication.integrity_violations(entities, edges, evidence, provenance, stored, (declared, computed)).collect())
    assert got == sorted(
        [
            ("1", "b", "duplicate-entity"), ("1", "r", "duplicate-relationship"), ("1", "s", "self-edge"), ("1", "t", "missing-source"), ("1", "t", "missing-target"), ("2", "v", "missing-target"),
            ("2", "a#e1", "evidence-listed-twice"), ("2", "b#e2", "evidence-not-described"), ("2", "b#e9", "evidence-not-listed"),
            ("None", "e9", "lineage-not-stored"), ("None", "e3", "lineage-different"), ("None", "e4", "lineage-different"),
            ("2", "2", "hash-different"), ("3", "3", "hash-missing"), ("5", "5", "hash-missing"), ("4", "4", "hash-different"),
        ]
    )
    assert publication.integrity_violations(entities.where("publication_id = 2").limit(0), edges.limit(0)).count() == 0


OBJECTS = "publication_id string, key string, version_id string, content_hash string, name string, size long"


def snapshots(spark, renamed="c"):
    return spark.createDataFrame(
        [("1", "k1", "v1", "h1", "a", 1), ("1", "k2", "v2", "h2", "b", 1), ("1", "k3", "v3", "h3", "c", 1), ("2", "k1", "v1", "h1", "a", 1), ("2", "k2", "v4", "h4", "b", 2), ("2", "k4", "v5", "h5", renamed, 1), ("3", "k3", "v9", "h3", "c", 1)], OBJECTS
    )


def store(spark, path, objects, clock):
    compare = lambda pairs: diff_store.compare_pairs(pairs, objects, "entity", "key", ["name", "size"]).unionByName(diff_store.compare_pairs(pairs, objects.limit(0), "relationship", "key", ["name"]))
    return diff_store.DiffStore(spark, path, compare, lambda: F.lit(dt.datetime(2026, 1, next(clock))))


def test_differences_are_reused_replaced_and_verified(spark, tmp_path):
    path, clock = str(tmp_path / "diffs"), itertools.count(1)
    pairs = spark.createDataFrame([("1", "2"), ("2", "1"), ("1", "1"), ("1", "3"), ("1", "9")], "from_id string, to_id string")
    kept = store(spark, path, snapshots(spark), clock)
    first = {(r.from_id, r.to_id): (r.diff_id, r.action) for r in kept.save(pairs).collect()}
    assert {a for _, a in first.values()} == {"created"} and len({i for i, _ in first.values()}) == 5
    counts = {(r.from_id, r.to_id): (r.added, r.removed, r.modified, r.unchanged) for r in kept.rows().where("section = 'summary'").collect()}
    assert counts == {("1", "2"): (1, 1, 1, 1), ("2", "1"): (1, 1, 1, 1), ("1", "1"): (0, 0, 0, 3), ("1", "3"): (0, 2, 0, 1), ("1", "9"): (0, 3, 0, 0)}
    assert kept.rows().where("from_id = '1' AND to_id = '2' AND change = 'modified'").first().changed_fields == ["size"]
    times = {(r.from_id, r.to_id): r.generated_at for r in kept.verified().collect()}
    again = {(r.from_id, r.to_id): (r.diff_id, r.action) for r in kept.save(pairs).collect()}
    assert again == {p: (i, "reused") for p, (i, _) in first.items()} and {(r.from_id, r.to_id): r.generated_at for r in kept.verified().collect()} == times

    # A change that was altered in the store, and one that was lost.
    broken = kept.rows().where("from_id = '1' AND to_id IN ('2', '3')").withColumn("change", F.when((F.col("to_id") == "2") & (F.col("change") == "added"), "removed").otherwise(F.col("change"))).where("NOT (to_id = '3' AND key = 'k1')")
    rows = spark.createDataFrame(broken.collect(), broken.schema)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("from_id", "to_id").parquet(path)
    states = {(r.from_id, r.to_id): r.state for r in kept.verified().collect()}
    assert states == {p: "corrupt" if p in (("1", "2"), ("1", "3")) else "valid" for p in first}
    mended = {(r.from_id, r.to_id): (r.diff_id, r.action) for r in kept.save(pairs).collect()}
    assert {p for p, (_, a) in mended.items() if a == "replaced"} == {("1", "2"), ("1", "3")}
    assert all(mended[p][0] == first[p][0] for p in first if states[p] == "valid") and {r.state for r in kept.verified().collect()} == {"valid"}

    changed = store(spark, path, snapshots(spark, "renamed").where("key <> 'k4'"), clock)
    assert {p for p, s in {(r.from_id, r.to_id): r.state for r in changed.verified().collect()}.items() if s == "outdated"} == {("1", "2"), ("2", "1")}
    page = kept.comparisons("1", limit=2).collect()
    rest = kept.comparisons("1", after=page[-1].diff_id, limit=101).collect()
    assert [r.diff_id for r in page + rest] == sorted(i for i, _ in mended.values())
    with pytest.raises(ValueError):
        kept.comparisons("1", limit=102)


def test_saving_tells_what_verification_would_say(spark, tmp_path):
    """States of stored differences come with the one comparison of a save: valid, corrupt, outdated, or none."""
    clock = itertools.count(1)
    kept = store(spark, str(tmp_path / "diffs"), snapshots(spark), clock)
    assert {r.state for r in kept.save(spark.createDataFrame([("1", "2"), ("1", "1"), ("1", "3")], "from_id string, to_id string")).collect()} == {None}
    rows = kept.rows().where("to_id = '3'").withColumn("removed", F.col("removed") + 1)
    spark.createDataFrame(rows.collect(), rows.schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("from_id", "to_id").parquet(str(tmp_path / "diffs"))
    changed = store(spark, str(tmp_path / "diffs"), snapshots(spark, "renamed").where("key <> 'k4'"), clock)
    said = {(r.from_id, r.to_id): r.state for r in changed.verified().collect()}
    found = {(r.from_id, r.to_id): (r.state, r.action) for r in changed.save(spark.createDataFrame([("1", "2"), ("1", "1"), ("1", "3"), ("2", "1")], "from_id string, to_id string")).collect()}
    assert found == {("1", "1"): ("valid", "reused"), ("1", "2"): ("outdated", "replaced"), ("1", "3"): ("corrupt", "replaced"), ("2", "1"): (None, "created")}
    assert said == {p: s for p, (s, _) in found.items() if s}


def test_stored_differences_are_mended_by_two_comparisons(spark, monkeypatch):
    """The query compares each publication once for a save and hashes stored rows once to verify them."""
    from tessera import catalog

    compared, hashed = [], []
    monkeypatch.setattr(diff_store, "compare_pairs", lambda *a, f=diff_store.compare_pairs: compared.append(a[2]) or f(*a))
    monkeypatch.setattr(diff_store, "_hashed", lambda rows, f=diff_store._hashed: hashed.append(rows) or f(rows))
    assert catalog.QUERIES["diff_store_repair"](spark, "/root/testdata/sf0.001").count() == 6
    assert len(compared) <= 4 and len(hashed) <= 4


def test_entities_by_type_status_and_name(spark):
    rows = spark.createDataFrame([(1, "a", "api", "active", "alpha"), (1, "b", "module", "active", "beta"), (1, "c", "api", "stale", "alphabet"), (2, "a", "api", "active", "alpha")], "publication_id long, entity_id string, type string, status string, name_normalized string")
    ids = lambda **given: [r.entity_id for r in search.search_entities(rows, publication=1, **given).collect()]
    assert ids() == ["a", "b", "c"] and ids(types=["api"]) == ["a", "c"] and ids(types=["api"], statuses=["active"]) == ["a"]
    assert ids(query="ALPHA", how="prefix") == ["a", "c"] and ids(query="alpha", how="exact") == ["a"] and ids(after="a", limit=1) == ["b", "c"]
    for given in ({"types": []}, {"statuses": [""]}, {"query": ""}, {"limit": 0}):
        with pytest.raises(ValueError):
            ids(**given)
