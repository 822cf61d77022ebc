"""Mixing, WARC records and the pipeline."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_helpers import documents, edge_rows, empty_documents, sentence, word_list, write_tables
from shiftspark.llm import mixing, warc


# --- mixing --------------------------------------------------------------------

def words_of(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    left, out, free = sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
            free.discard(s)
    return out


def mix_rows(spark, rows):
    got = mixing.mix(documents(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    return got.collect()


def test_targets_and_words_taken(spark):
    r = random.Random(2)
    rows = []
    for s, n in (("b", 300), ("a", 4), ("é", 90), ("Z", 60), (None, 40), ("c", 1), ("\U0001F600", 25), ("zero", 0)):
        for _ in range(n):
            rows.append((len(rows), sentence(len(rows), r.randint(0, 60)) + r.choice(("", " \t\n")), "en", s))
    rows.append((len(rows), "\u00a0 \u2003x\x0by\x1cz", "en", "a"))
    sizes = collections.Counter()
    for i, t, _, s in rows:
        sizes[s] += words_of(t)
    want = brute_targets(sizes)
    got = mix_rows(spark, rows)
    taken = collections.Counter()
    for x in got:
        i, t, _, s = rows[x["doc_id"]]
        assert x["size"] == words_of(t) and x["source_size"] == sizes[s]
        assert x["target"] == pytest.approx(want[s]) and 0 <= x["taken"] <= 3 * x["size"]
        taken[s] += x["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.02 * want[s]), s
    assert sorted(map(str, got)) == sorted(map(str, mix_rows(spark, rows[::-1])))


def test_edge_rows_take_near_their_targets(spark):
    got = mix_rows(spark, edge_rows())
    assert len(got) == len(edge_rows())
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(empty_documents(spark)).count() == 0
    assert [r["taken"] for r in mix_rows(spark, [(1, None, None, None), (2, " ", "x", "s")])] == [0, 0]


def brute_seats(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    return won


def test_seats_equal_highest_quotients_one_by_one(spark):
    r = random.Random(8)
    cases = []
    for g in range(25):
        n = r.randint(1, 12)
        votes = [r.choice((0, 1, 5, 5, 40, 1000, r.randint(1, 10 ** 6))) for _ in range(n)]
        if sum(votes):
            cases.append((votes, r.choice((0, 1, n, 3 * n, 137, 1000))))
    rows = [(g, k, float(v), s) for g, (votes, s) in enumerate(cases) for k, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, k int, votes double, seats long")
    got = collections.defaultdict(dict)
    for x in mixing.sainte_lague(df, ["g"], "votes", "seats", "k", "won").collect():
        got[x["g"]][x["k"]] = x["won"]
    for g, (votes, seats) in enumerate(cases):
        assert [got[g][k] for k in range(len(votes))] == brute_seats(votes, seats), (votes, seats)


def test_shards_share_a_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 500)
    rows = [(i, sentence(i, 20 + i % 30), "en", "ab"[i % 3 == 0]) for i in range(400)]
    taken, target = collections.Counter(), {}
    for x in mix_rows(spark, rows):
        s = rows[x["doc_id"]][3]
        taken[s] += x["taken"]
        target[s] = x["target"]
        assert x["taken"] <= 3 * x["size"]
    for s in target:
        assert abs(taken[s] - target[s]) < 0.01 * target[s]


def test_repeated_and_empty_rows_are_split(spark, monkeypatch):
    """A third of all rows repeats one id and text, another third is empty: each row once, runs and shards are many."""
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    monkeypatch.setattr(mixing, "RUN_ROWS", 7)
    rows = [(7, sentence(1, 33), "en", "a")] * 150 + [(i, " ", "en", "a") for i in range(100, 250)] + [
        (i, sentence(i, 5 + i % 40), "en", "ab"[i % 2]) for i in range(300, 420)]
    got = mixing.mix(documents(spark, rows).repartition(5)).collect()
    assert collections.Counter(x["doc_id"] for x in got) == collections.Counter(r[0] for r in rows)
    assert all(x["taken"] <= 3 * x["size"] for x in got) and all(x["taken"] == 0 for x in got if x["size"] == 0)
    size, source = {r[0]: words_of(r[1]) for r in rows}, {r[0]: r[3] for r in rows}
    assert all(x["size"] == size[x["doc_id"]] for x in got)
    taken, target = collections.Counter(), {}
    for x in got:
        taken[source[x["doc_id"]]] += x["taken"]
        target[source[x["doc_id"]]] = x["target"]
    for s in target:
        assert abs(taken[s] - target[s]) < 0.01 * target[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents(spark, rows[::-1])).collect()))


def test_no_python_runs_in_the_mix(spark):
    plan = mixing.mix(documents(spark, edge_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- WARC ----------------------------------------------------------------------

PAGES = [(1, "http://a.example/x", "<html><body><p>Caf&eacute; &amp; bar</p><script>no</script></body></html>", "clash"),
         (2, None, None, "c"), (None, "http://b.example/\r\nX: y", "line\r\n\r\nWARC/1.0 in text é", None), (1, "http://a.example/x", "<p>other", "z"), (3, "u", "", "")]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, block string")


def test_derivatives_link_back_and_digests_fit(spark):
    rec = warc.responses(pages(spark))
    source = {(r["record_id"], r["payload_digest"]): r for r in rec.collect()}
    made = warc.derivatives(rec).collect()
    assert len(made) == 2 * len(PAGES)
    for m in made:
        assert m["block_digest"] == "sha256:" + hashlib.sha256(m["block"].encode()).hexdigest()
        fits = [s for (i, _), s in source.items() if i == m["refers_to"]]
        assert fits and all(s["target_uri"] == m["target_uri"] and s["date"] == m["date"] for s in fits)
        if m["type"] == "metadata":
            fields = dict(x.split(": ", 1) for x in m["block"].split("\r\n") if x)
            s = source[m["refers_to"], m["payload_digest"]]
            assert fields["payload-digest"] == s["payload_digest"] and fields["payload-digest-status"] == "match"
            assert fields["http-status"] == "200 OK" and fields["source-record-id"] == m["refers_to"]
            assert any(c["record_id"] == fields["conversion-record-id"] for c in made)
    text = {(m["key"], m["block"]) for m in made if m["type"] == "conversion"}
    assert (1, "Café & bar") in text and (2, "") in text and (1, "other") in text
    assert warc.derivatives(warc.responses(pages(spark).limit(0))).count() == 0
    assert sorted(map(str, warc.page_derivatives(pages(spark)).collect())) == sorted(map(str, made))


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_round_trip(spark, tmp_dir, compression):
    rec = warc.responses(pages(spark))
    both = rec.union(warc.derivatives(rec)).repartition(3)
    warc.write_warc(both, f"{tmp_dir}/w", compression)
    back = warc.read_warc(spark, f"{tmp_dir}/w")
    assert back.exceptAll(both).count() == 0 and both.exceptAll(back).count() == 0


def test_file_text_is_a_warc_record(spark, tmp_dir):
    rec = warc.responses(pages(spark).where("page_id = 2"))
    warc.write_warc(rec, f"{tmp_dir}/w")
    raw = b"".join(r["content"] for r in spark.read.format("binaryFile").load(f"{tmp_dir}/w").collect())
    head, _, block = raw.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and block.endswith(b"\r\n\r\n")
    assert f"Content-Length: {len(block) - 4}".encode() in head and b"WARC-Refers-To" not in head


def test_blocks_that_hold_record_ends_and_both_versions(spark, tmp_dir):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", "a\r\n\r\nWARC/1.1\r\nb"), (2, "v", inner * 20), (3, "w", "\r\n\r\nWARC/1."), (4, "x", "\r\n\r\n"), (5, "y", "plain")]
    rec = warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc.write_warc(rec.coalesce(1), f"{tmp_dir}/w")
    back = warc.read_warc(spark, f"{tmp_dir}/w")
    assert sorted(map(str, back.collect())) == sorted(map(str, rec.collect()))
    old = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\nWARC-IP-Address: 1.2.3.4\r\nwarc-concurrent-to:<urn:uuid:8>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
    block = "HTTP/1.0 200 OK\r\nServer: s\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n<p>x"
    text = old.format(len(block), block) * 2
    spark.createDataFrame([(text.removesuffix("\r\n\r\n"),)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(f"{tmp_dir}/old")
    got = warc.read_warc(spark, f"{tmp_dir}/old")
    assert [(r.record_id, r.block, r.other_headers) for r in got.collect()] == [
        ("<urn:uuid:9>", block, "WARC-IP-Address: 1.2.3.4\r\nwarc-concurrent-to:<urn:uuid:8>")] * 2
    meta = warc.derivatives(got).where("type = 'metadata'").first().block
    assert {"source-http-server: s", "source-http-set-cookie: a=1, b=2", "source-warc-ip-address: 1.2.3.4",
            "source-warc-concurrent-to: <urn:uuid:8>"} <= set(meta.split("\r\n"))
    warc.write_warc(got, f"{tmp_dir}/again")
    assert sorted(map(str, warc.read_warc(spark, f"{tmp_dir}/again").collect())) == sorted(map(str, got.collect()))


def test_foreign_responses(spark):
    def made(block, said):
        r = {"key": 1, "type": "response", "record_id": "<urn:uuid:1>", "target_uri": "u", "date": "2020-01-01T00:00:00Z", "block": block, "payload_digest": said}
        (meta, conv) = warc.derive(r)
        return meta[7], conv[7]
    meta, conv = made("HTTP/1.1 404 Not Found\r\nContent-Type: text/plain\r\n\r\na <b> c", "sha1:X")
    assert conv == "a <b> c" and "payload-digest-status: differs from sha1:X" in meta and "http-status: 404 Not Found" in meta
    assert made("HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nxx", None)[1] == ""
    assert made(None, None)[1] == ""


def test_split_records_are_told(spark, tmp_dir):
    bad = spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort\r\n\r\n",)], "value string")
    bad.write.option("lineSep", "\n").text(f"{tmp_dir}/w")
    with pytest.raises(Exception, match="Content-Length"):
        warc.read_warc(spark, f"{tmp_dir}/w").collect()


# --- pipeline --------------------------------------------------------------------

def corpus(spark, tmp):
    rows, labels = [], []
    for i in range(150):
        w = word_list(i, 60)
        if i % 10 == 2:
            w[3:3] = ["scumbag", "scumbag"]
        labels.append((i, 1, int(i % 10 == 2)))
        rows.append((i, " ".join(w), "en", "abc"[i % 3]))
    item = sentence(7000, 25)
    rows += [(200, rows[5][1].upper(), "en", "a"), (201, rows[5][1], "en", "a"), (201, rows[5][1], "en", "a"),
             (202, rows[6][1] + " tail", "en", "b"), (203, "x " + item + " y", "en", "c")]
    docs = documents(spark, [*rows, *[(None if r[0] is None else r[0] + 5000, *r[1:]) for r in edge_rows()]])
    return docs, write_tables(tmp, spark, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
                              benchmark=spark.createDataFrame([(1, item), (2, None)], "item_id long, text string"))


def test_stages_in_order_with_effect(spark, tmp_dir):
    docs, sf = corpus(spark, tmp_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    now, ids = docs, [{r["doc_id"] for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf)
        if k < 4:
            assert now.columns == docs.columns
        now.write.parquet(f"{tmp_dir}/stage{k}")
        now = spark.read.parquet(f"{tmp_dir}/stage{k}")
        ids.append({r["doc_id"] for r in now.collect()})
    assert ids[0] - ids[1] == set(range(2, 150, 10))
    assert {5, 200} <= ids[1] - ids[2] and 201 in ids[2]
    assert ids[2] - ids[3] == {202}
    assert ids[3] - ids[4] == {203}
    assert ids[4] == ids[5] and set(range(150)) - set(range(2, 150, 10)) - {5} <= ids[5]
    assert now.groupBy("doc_id").count().where("count > 1").where("doc_id IS NOT NULL AND doc_id < 5000").count() == 0


def test_run_gives_the_last_stage(spark, tmp_dir):
    docs, sf = corpus(spark, tmp_dir)
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert got.agg(F.sum("taken")).first()[0] == pytest.approx(got.agg(F.sum("size")).first()[0], rel=0.05)


def test_run_on_empty_tables(spark, tmp_dir):
    sf = write_tables(tmp_dir, spark, documents=empty_documents(spark), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                      benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, sf).count() == 0
    assert math.isfinite(1)
