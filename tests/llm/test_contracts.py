"""Each query over the whole of a small scale factor against its brute-force version."""

import pytest

from spacemill.llm import queries as q
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in q.table(spark, sf, "documents").select("doc_id", "text").collect()]


def by_id(df, *cols, key="doc_id"):
    rows = df.select(key, *cols).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_near(spark, sf, docs):
    assert by_id(q.op1_minhash_near_dedup(spark, sf), "n_shingles", "component_id", "kept") == brute.near(docs)


def test_sharding(spark, sf, docs):
    rows = q.op2_jump_sharding(spark, sf).collect()
    text = dict(docs)
    assert {r["doc_id"] for r in rows} == set(text) and len(rows) == len(text)
    slots = {}
    for r in rows:
        i = r["doc_id"]
        assert (r["shard"], r["grown_shard"], r["law"]) == (brute.jump(i, 24), brute.jump(i, 25), "key")
        assert (r["size"], r["text_crc32"]) == (len((text[i] or "").encode()) + 8, brute.crc(text[i]))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_decontamination(spark, sf, docs):
    items = [tuple(r) for r in q.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert by_id(q.op3_decontamination(spark, sf), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute.hits(docs, items)


def _spans(got, docs, base_of, kinds, n_kinds):
    import hashlib

    for i, t in docs:
        base = base_of(t)
        *counts, sha, spans = got[i]
        assert counts == [sum(s[0] == k for s in base) for k in n_kinds]
        text = brute.joined(base, n_kinds)
        assert sha == hashlib.sha256(text.encode()).hexdigest()
        found = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
        assert set(base) <= set(found) and len(found) == len(set(found))
        assert spans == brute.joined(found, list(kinds))


def test_secrets(spark, sf, docs):
    from spacemill.llm.secret_scan import BASE, KINDS

    got = by_id(q.op4_secret_scan(spark, sf), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    _spans(got, docs, brute.secrets, KINDS, list(BASE))


def test_exact(spark, sf, docs):
    assert by_id(q.op6_exact_dedup(spark, sf), "keep_id", "group_size", "kept", "text_sha256") == brute.same_texts(docs)


def test_toxicity(spark, sf):
    import zlib

    got = by_id(q.op7_toxicity(spark, sf), "held_out", "score", "predicted")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= s <= 1 and p == (s >= 0.5) for i, (h, s, p) in got.items())


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = by_id(q.op7_toxicity(spark, sf), "held_out", "score", "predicted")
    y = {r["doc_id"]: r["toxic"] for r in q.table(spark, sf, "labels").collect()}
    held = [(y[i], s, p) for i, (h, s, p) in got.items() if h and i in y]
    right = sum(a == p for a, _, p in held) / len(held)
    assert right >= 0.98
    ups, downs = [s for a, s, _ in held if a], [s for a, s, _ in held if not a]
    auc = sum((u > d) + 0.5 * (u == d) for u in ups for d in downs) / (len(ups) * len(downs))
    assert auc >= 0.95


def test_pii(spark, sf, docs):
    from spacemill.llm.pii import KINDS

    got = by_id(q.op9_pii(spark, sf), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    _spans(got, docs, brute.personal, KINDS, list(KINDS))


def test_warc(spark, sf):
    pages = [tuple(r) for r in q.table(spark, sf, "pages").select("page_id", "html").collect()]
    got = by_id(q.op10_warc(spark, sf), "payload_bytes", "payload_digest", "record_type", "refers_to", key="page_id")
    assert got == brute.captures(pages)
