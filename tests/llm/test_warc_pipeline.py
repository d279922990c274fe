"""WARC round trip, the loser tree, and the pipeline's stages."""

import base64
import hashlib
import random

import pytest

import corpus_pipeline
from ringscope.llm import exact_dedup, packing, warc


def test_loser_tree():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_stretches_are_merged_as_they_come():
    rng = random.Random(1)
    runs = [sorted((rng.randint(0, 99), k) for _ in range(30)) for k in range(5)]
    keys = [x for run in runs for x in run]
    found = warc.stretches(keys)
    assert len(found) <= 5 and [k for a, b in found for k in keys[a:b]] == keys
    assert list(warc.LoserTree([iter(keys[a:b]) for a, b in found])) == sorted(keys)
    assert warc.stretches([]) == [] and warc.stretches([(3,), (2,), (2,), (5,)]) == [(0, 1), (1, 4)]


PAGES = [
    (3, "http://www.A.example/x?q", "same"), (1, "http://b.example/", "same"), (9, None, None), (2, "https://a.example/y", ""), (7, "bad\r\nurl", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"),
    (8, "http://a.example:80/", "café \U0001f600\n\r\n"), (5, "http://b.example/", "z" * 200_000), (6, "http://b.example/", "same"),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, compression, least):
    df = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path, min_bytes=least, compression=compression)
    rows = {int(r.id_text): r for r in warc.read_warc(spark, path, with_payload=True).collect()}
    first = {}
    for i, _, h in sorted(PAGES):
        first.setdefault((h or "").encode(), i)
    for i, _, h in PAGES:
        data, r = (h or "").encode(), rows[i]
        again = len(data) >= least and first[data] != i
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.record_type == ("revisit" if again else "response") and r.refers_text == (str(first[data]) if again else None)
        assert again or r.payload == (h or "")
    by_record = {r.record_id: r for r in rows.values()}
    assert len(by_record) == len(PAGES) and all(by_record[r.refers_to_record].id_text == r.refers_text for r in rows.values() if r.refers_text)
    index = warc.capture_index(spark, path).collect()
    ordered = [r.key for r in sorted(index, key=lambda r: (r.range_no, r.place))]
    assert ordered == sorted(ordered) and len(ordered) == len(PAGES) and "example,a)/x?q" in ordered


def test_text_ids_and_large_ids_come_back(spark, tmp_path):
    ids = [" a\tb\r\n ", "100%+1", "é", ""]
    df = spark.createDataFrame([(i, "u", "same") for i in ids], "page_id string, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/s")
    assert sorted(r.id_text for r in warc.read_warc(spark, f"file://{tmp_path}/s").collect()) == sorted(ids)
    big = [1_700_000_000, (1 << 62) + 1, -5]
    warc.write_warc(spark.createDataFrame([(i, "u", str(i)) for i in big], "page_id long, url string, html string"), f"file://{tmp_path}/l")
    rows = {int(r.id_text): r.date for r in warc.read_warc(spark, f"file://{tmp_path}/l").collect()}
    assert set(rows) == set(big) and rows[1_700_000_000] == "2023-11-14T22:13:20Z" and len(set(rows.values())) == 3


def test_damaged_archive(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort")
    with pytest.raises(Exception, match="cut short"):
        warc.read_warc(spark, f"file://{tmp_path}/x.warc").collect()


def test_null_and_repeated_page_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "u", "p"), (4, "u", "p"), (4, "u", "p")], "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/n")
    rows = warc.read_warc(spark, f"file://{tmp_path}/n").collect()
    assert sorted((r.id_text, r.record_type) for r in rows) == [("", "revisit"), ("4", "response"), ("4", "revisit")]
    warc.write_warc(df.limit(0), f"file://{tmp_path}/e")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        text = spark.createDataFrame([("b", None, "p"), ("90061", "v", "q"), ("a", "u", "p"), ("a", "u", "p")], "page_id string, url string, html string")
        warc.write_warc(text, f"file://{tmp_path}/s")
        rows = sorted((r.id_text, r.record_type, r.refers_text, r.date) for r in warc.read_warc(spark, f"file://{tmp_path}/s").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert rows[0] == ("90061", "response", None, "1970-01-02T01:01:01Z")
    assert [r[:3] for r in rows[1:]] == [("a", "response", None), ("a", "revisit", "a"), ("b", "revisit", "a")]


def test_payloads_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, None, "d", "x"), (None, "u", "d", "x"), (None, "u", "d", "x")], "_id long, url string, digest string, html string")
    typed = rows.drop("html").distinct().selectExpr("*", "1L AS payload_bytes", "1L AS responses")
    found = warc.first_payloads(rows.hint("merge"), typed.hint("merge"))
    assert sorted((r._id or 0, r.url or "", r.html) for r in found.collect()) == [(0, "u", "x"), (1, "", "x")]
    plan = found._jdf.queryExecution().sparkPlan()
    executed = spark._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(spark._jsparkSession, plan).toString()
    assert executed.count("Exchange hashpartitioning(capture") == 2  # one for each side of the join, none for what follows


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps documents' columns and does to its own input what its operator
    says; packing covers exactly what the stages kept."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "no", "ti", "ra"]) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for i in range(240):
        w = [word() for _ in range(60)]
        if i % 4 == 1:
            w[::20] = ["idiot", "moron", "scum"]
        if i % 4 == 2:
            w = [x + "***" for x in w]
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 != 2), int(i % 4 == 1)))
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[4] + " tail", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in at.collect()}
    toxic = {i for i, _, t in labels if t}
    poor = {i for i, q, _ in labels if not q}
    assert len(kept["toxicity"] & toxic) <= 2 and len(kept["toxicity"]) >= len(texts) - len(toxic) - 2
    assert len(kept["quality"] & poor) <= 2
    assert {240, 241}.isdisjoint(kept["exact dedup"] - {0}) or 0 not in kept["exact dedup"]
    assert len({0, 240, 241} & kept["exact dedup"]) == 1 and len({4, 242} & kept["near dedup"]) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept["near dedup"]
    assert corpus_pipeline.STAGES[2][0] == "exact dedup" and exact_dedup and packing
