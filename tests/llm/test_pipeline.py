"""The pipeline against a plain version of its stages, and the mixing query against a plain simulation."""

from fractions import Fraction

import pytest

import corpus_pipeline as cp
from spacemill.llm import mixing, queries as q, toxicity
from tests.llm import brute


@pytest.fixture(scope="module")
def result(spark, sf):
    return cp.run(spark, sf).collect()


def test_stages_are_those_asked_for(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = cp.STAGES[0][1](spark, docs, sf)
    assert out.columns == docs.columns


def test_run_is_the_plain_pipeline(spark, sf, result):
    docs = q.table(spark, sf, "documents")
    model = toxicity.fit(docs, q.table(spark, sf, "labels"))
    left = [(r["doc_id"], r["text"]) for r in toxicity.score(docs, model).where("predicted = 0").select("doc_id", "text").collect()]
    kept = brute.near(left)
    left = [(i, t) for i, t in left if kept[i][2]]
    items = [tuple(r) for r in q.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    hit = brute.hits(left, items)
    want = {i: t for i, t in left if not hit[i][4]}
    assert {r["doc_id"]: r["text"] for r in result} == want and len(result) == len(want)
    assert all((r["shard"], r["grown_shard"]) == (brute.jump(r["doc_id"], 24), brute.jump(r["doc_id"], 25)) for r in result)
    for s in range(24):
        slots = sorted(r["slot"] for r in result if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_run_leaves_no_tables_but_those_of_its_last_stage(spark, sf, result):
    from spacemill.llm import common

    common.clean(spark)
    assert cp.run(spark, sf).count() == len(result)
    assert sorted(p.rpartition("/")[2].rpartition("-")[0] for p in common.made(spark)) == ["pipeline-mixing", "shard-slots"]


ROWS = [(3, "T " * 30, "en", "a", 1), (7, "T " * 30, "en", "a", 1), (7, "another text of a row with the same id", "en", "a", 1), (None, "T " * 30, None, None, None), (5, None, "en", "b", None), (6, "", None, "b", 0), (None, None, None, None, None), (8, "x" * 70000, "en", "c", 70000), (9, "only once but twice there with id", "en", "c", 2), (9, "only once but twice there with id", "en", "c", 2)]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumns({"KEY": F.lit(1), "n_hit": F.lit("x"), "Slot": F.lit(2), "_file": F.lit("f"), "score": F.lit(0.5), "k1": F.lit(1)})


def keyed(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_rows_with_repeated_ids_stand_for_themselves(spark, sf, odd):
    got = cp.near_dedup_stage(spark, odd, sf)
    assert got.columns == cp.COLUMNS
    want = [ROWS[0], ROWS[2], *ROWS[4:9]]
    assert keyed(got.collect()) == sorted(((r[0], r[1]) for r in want), key=str)


def test_decontamination_judges_rows_by_their_own_text(spark, sf, odd):
    text = q.table(spark, sf, "benchmark").where("text is not null").first()["text"]
    bad = spark.createDataFrame([(7, "x " + text, "en", "a", 1), (None, text, "en", "a", 1), (5, text, "en", "a", 1)], odd.select(*cp.COLUMNS).schema)
    got = cp.decontamination_stage(spark, odd.select(*cp.COLUMNS).unionByName(bad), sf)
    assert keyed(got.collect()) == keyed(odd.collect())


def test_stages_on_odd_rows(spark, sf, odd):
    want = keyed(odd.collect())
    for name in ("toxicity", "mixing", "sharding"):
        out = dict(cp.STAGES)[name](spark, odd, sf)
        assert keyed(out.collect()) == want, name
        assert out.columns[:5] == cp.COLUMNS
    for name, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0, name


def test_stages_chain_without_being_written(spark, sf, odd):
    docs = odd
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    rows = docs.collect()
    assert keyed(rows) == sorted(((r[0], r[1]) for r in [ROWS[0], ROWS[2], *ROWS[4:9]]), key=str)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_slots_follow_the_mix(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix(docs)
    place = {r["doc_id"]: (r["mix_slot"], r["mix_place"]) for r in mixed.collect()}
    cp.mixing_stage(spark, docs, sf).write.parquet(f"{tmp_path}/mixed")
    by = {}
    for r in cp.sharding_stage(spark, spark.read.parquet(f"{tmp_path}/mixed"), sf).collect():
        by.setdefault(r["shard"], []).append((r["slot"], place[r["doc_id"]]))
    assert sum(map(len, by.values())) == len(place)
    assert all([p for _, p in sorted(x)] == sorted(p for _, p in x) for x in by.values())
    assert cp.sharding_stage(spark, spark.createDataFrame(docs.limit(20).collect(), docs.schema), sf).count() == 20


def earliest_deadline_first(p, slots):
    """Blocks served slot by slot, without any use of the period."""
    total = sum(p.values())
    w = {s: Fraction(n, total) for s, n in p.items()}
    served, out = dict.fromkeys(p, 0), []
    for t in range(slots):
        ready = [s for s in p if served[s] / w[s] // 1 <= t]
        s = min(ready, key=lambda s: (-(-(served[s] + 1) / w[s] // 1), str(s)))
        out.append((s, served[s]))
        served[s] += 1
    return out


def test_mixing_is_the_simulation(spark, sf):
    rows = q.op8_pfair_mixing(spark, sf).collect()
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in q.table(spark, sf, "documents").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(size)
    assert [(r["mix_slot"], r["mix_place"]) for r in rows] == sorted((r["mix_slot"], r["mix_place"]) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    total = {s: sum(size[r["doc_id"]] + 1 for r in x) for s, x in by.items()}
    p = mixing.parts(mixing.tempered(total))
    where = {x: t for t, x in enumerate(earliest_deadline_first(p, 3000))}
    for s, x in by.items():
        x.sort(key=lambda r: r["mix_place"])
        assert [r["mix_place"] for r in x] == list(range(len(x)))
        above = 0
        for r in x:
            assert r["mix_slot"] == where[s, above // (1 << 16)]
            above += size[r["doc_id"]]


def test_schedule_is_periodic():
    p = {"a": 3, "b": 2, "c": 7}
    slots = mixing.schedule(p)
    plain = earliest_deadline_first(p, 36)
    assert [s for s, _ in plain] == slots * 3
