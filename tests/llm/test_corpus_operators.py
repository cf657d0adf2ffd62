"""Corpus operators against brute force, round trips and held-out accuracy on small tables."""

import base64
import hashlib
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, decontam, exact, html_extract, packing, pii, queries, simhash, substring, toxicity, warc

DOC = "doc_id long, text string, extra string, id long, size int"
ODD = [None, "", "   ", "one", "same text here", "same text here", "İ Ω <|endoftext|> it's", "w " * 3000, "x" * 9000, "a b c d e f g h i j k l m n o p q r s t u v w x y z"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "e", 1, 2) for i, t in enumerate(ODD)] + [(4, ODD[4], "e", 1, 2), (None, "one", "e", 1, 2)]
    return spark.createDataFrame(rows, DOC).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


def test_packing_is_whole_and_tight(spark, docs, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    out = packing.pack(both, path).toPandas()
    want = []
    for r in both.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        want += [(r.doc_id, zlib.crc32(ids[k : k + 16384])) for k in range(0, len(ids), 16384)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = [(None if d != d else int(d), int(c)) for d, c in zip(out.doc_id.astype(float), out.ids_crc32)]
    assert sorted(got, key=key) == sorted(want, key=key)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and (g.offset.to_numpy() == np.concatenate([[0], g.length.cumsum()[:-1]])).all()
    least = -(-int(out.length.sum()) // 4096)
    assert out.sequence_id.nunique() <= 1.03 * least + 1
    assert packing.pack(none, path).count() == 0


def test_large_items_each_get_a_sequence(spark):
    spots = packing.place(spark.range(300).select("id", F.lit(2500).alias("size"))).collect()
    assert len({r.seq for r in spots}) == 300 and {r.off for r in spots} == {0}


def test_toxicity_held_out(spark):
    from pathlib import Path

    sf = str(Path("/root/testdata/sf0.01"))
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(d, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((out.predicted == 1) & (out.toxic == 0)).mean() < 0.03
    assert out[out.toxic == 1].score.mean() > 3 * out[out.toxic == 0].score.mean()


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(none, labels.limit(0)).count() == 0


def test_segments_are_the_maximal_ones():
    model = toxicity.Model({"b": 3.0, "w": 1.0}, -1.0, 1.0, 1.0)
    rng = random.Random(2)
    for _ in range(200):
        words = rng.choices(["b", "w", "x"], weights=[1, 1, 3], k=rng.randrange(25))
        s = [model.weights.get(x, -1.0) for x in words]

        def best(lo, hi):
            """Maximal scoring runs by definition: take the best, then left and right of it."""
            runs = [(sum(s[a:b]), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            top = max(runs, default=(0, 0, 0, 0), key=lambda r: (r[0], r[1], -r[2]))
            return [] if top[0] <= 0 else best(lo, top[2]) + [(top[2], top[3], top[0])] + best(top[3], hi)

        assert sum(x[2] for x in toxicity.segments(words, model)) == pytest.approx(sum(x[2] for x in best(0, len(words))))


def test_tool_calls(spark):
    calls = [{"id": "a", "name": "f", "arguments": '{"z":1,"a":"x"}', "depends_on": []}, {"id": "b", "name": "f", "arguments": '{"a":3}', "depends_on": ["a"]}, {"id": "c", "name": "g", "arguments": "oops", "depends_on": ["a", "b", "zz"]}, {"id": "x", "name": "f", "arguments": "{}", "depends_on": ["y"]}, {"id": "y", "name": "f", "arguments": "{}", "depends_on": ["x"]}]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": calls})), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": 'r"\n'})), (1, 2, "tool", json.dumps({"tool_call_id": "q", "content": "lost"})), (2, 0, "user", None), (None, 1, "user", "x")]
    out = {r.call_id: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {"a": ("string", True)}}).collect()}
    assert out["a"].json == '{"arguments":{"a":"x","z":1},"depends_on":[],"id":"a","level":0,"name":"f","result":"r\\"\\n"}'
    assert [out[k].level for k in "abcxy"] == [0, 1, 2, None, None]
    assert (out["a"].errors, out["b"].errors, out["c"].errors, out["x"].errors) == (["unknown z"], ["type of a"], ["unknown tool"], ["missing a"])
    assert (out["a"].status, out["b"].status, out["q"].status) == ("linked", "unanswered", "orphan") and out["2:0"].errors == ["missing prompt"]
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_chains_of_calls(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(400)]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.level for r in out) == list(range(200)) and {r.status for r in out} == {"linked"}


def test_decontamination(spark, docs, data, odd, none):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    loose = lambda t: " ".join(re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")))
    passages = [f" {loose(r.text)} " for r in items.collect()]
    want = {r.doc_id for r in docs.collect() if any(p in f" {loose(r.text)} " for p in passages)}
    got = {r.doc_id for r in decontam.contamination(docs, items).filter("contaminated").collect()}
    assert got == want
    joined = {r.doc_id for r in decontam.contamination(docs, items, broadcast_seeds=0).filter("contaminated").collect()}
    assert joined == want
    words = items.first().text.split()
    swapped = [w if k % 7 != 3 else "zzz" for k, w in enumerate(words)]
    planted = spark.createDataFrame([(1, "lead in " + " ".join(swapped) + " tail"), (2, " ".join(words[:4])), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in decontam.contamination(planted, items).filter("contaminated").collect()} == {1}
    assert decontam.contamination(odd, items.limit(0)).filter("contaminated").count() == 0 and decontam.contamination(none, items).count() == 0


def test_html_extraction(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    chain = html_extract.train(pages)
    rows = [(1, "u", '<html><body><div class="menu"><a href="/">Home</a></div><div class="content"><h1>Title here</h1><p>First &amp; long enough\n  paragraph, with words.</p><p>Second paragraph of the text, also long.</p></div><div class="comments"><p>I like it very much, nice.</p></div><script>x()</script></body></html>'), (2, "u", None), (3, "u", ""), (4, None, "just text")]
    out = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), chain).collect()}
    assert out[1].text == "Title here First & long enough paragraph, with words. Second paragraph of the text, also long."
    assert out[2].text == "" and out[3].n_chars == 0 and out[4].text == "just text"
    import html as h

    for r in html_extract.main_text(pages, chain).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>)", r.html, re.S).group(1)
        assert r.text.split() == h.unescape(re.sub(r"<[^>]+>", " ", article)).split()


def test_simhash_components(spark, docs, odd, none):
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    out = [r for r in simhash.near_duplicates(both).collect() if r.doc_id is not None]
    fps = np.array([int(r.fingerprint, 16) for r in out], dtype=np.uint64)
    parent = list(range(len(out)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(out)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least: dict = {}
    for i, r in enumerate(out):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    assert all(r.component_id == least[find(i)] for i, r in enumerate(out))
    assert simhash.near_duplicates(none).count() == 0


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 60)
    values = np.unique([int(b) ^ (1 << int(k)) for b in base for k in rng.integers(0, 62, 12)])
    monkeypatch.setattr(simhash, "HOT_BUCKET", 4)
    links = simhash.near_links(spark.createDataFrame([(0, int(v)) for v in values], "family int, fp long")).collect()
    group = {int(v): int(v) for v in values}

    def joined(pairs):
        g = dict(group)

        def find(x):
            while g[x] != x:
                x = g[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            g[max(a, b)] = min(a, b)
        return {x: find(x) for x in g}

    brute = [(int(v), int(w)) for v in values for w in values[np.bitwise_count(values ^ v) <= 3]]
    assert joined((r.src, r.dst) for r in links) == joined(brute)


def brute_repeats(rows):
    first: dict = {}
    texts = [(d or 0, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            first[k] = min(first.get(k, (d, p)), (d, p))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (d, p):
                gone[p : p + 20] = [True] * 20
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, docs, odd, none):
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    rows = [(r.doc_id, r.text) for r in both.collect()]
    for size in (1 << 14, 2 << 20):
        out = substring.remove_repeats(both, block_bytes=size).collect()
        assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in out) == brute_repeats(rows)
    assert substring.remove_repeats(none).count() == 0


def test_html_with_tags_left_out():
    block = lambda page: [t for t, _, _ in html_extract.leaf_blocks(page)]
    assert block("<html><head><title>T</title><body><p>hello there</p></body></html>") == ["hello there"]
    assert block("<head><title>T</title><meta charset=utf-8><p>hello <b>there</b>") == block("<p>hello <b>there</b>")
    assert block("<head><title>T</title><meta charset=utf-8><p>hello") == ["hello"]
    assert block("<body><article><button>press<p>one</p><p>two</p></article></body>") == ["one", "two"]
    assert block("<p>a <math><mi>x</mi></math> b</p>") == ["a x b"]


def test_html_without_articles(spark):
    """Pages of div layouts only, whose menus and comments are told by names: no page marks an article."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    rows, want = [], {}
    for k in range(40):
        paragraphs = [text(rng.randint(25, 60)) + "." for _ in range(4)]
        want[k] = " ".join(paragraphs).split()
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        rows.append((k, None, f'<html><head><title>t</title><body><div class="menu"><ul><li><a href="/">{text(2)}</a></li><li><a href="/b">{text(1)}</a></li></ul></div><div>{body}</div><div class="comments"><p>{text(15)}</p></div><div class="footer">{text(4)}</div></body></html>', 1))
    rows += [(100, None, "", 1), (100, None, "", 1), (101, "u", "<p>" + "long words here. " * 30000 + "</p>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = {r.page_id: r.text.split() for r in html_extract.main_text(pages).collect()}
    both = sum(len(set(out[k]) & set(want[k])) for k in want)
    precision, recall = both / sum(len(set(out[k])) for k in want), both / sum(len(set(want[k])) for k in want)
    assert 2 * precision * recall / (precision + recall) > 0.95 and out[100] == [] and len(out[101]) == 90000
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/ b", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (5, "u", ""), (None, "u", "<p>é</p>"), (9, "v", "z" * 100000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.archive_round_trip(pages).collect()
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in out)
    size = {p: len((h or "").encode()) for p, _, h in rows}
    digest = {p: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for p, _, h in rows}
    kinds = {3: ("revisit", 1), 1: ("response", -1), 2: ("response", -1), 5: ("revisit", 2), None: ("response", -1), 9: ("response", -1)}
    assert got == sorted((p or -1, size[p], digest[p], *kinds[p]) for p, _, _ in rows)
    assert {r.url for r in out} == {"http://a/ b", None, "u", "v"}
    folder = warc.archive_folder(spark)
    index = warc.write_archives(pages, folder, min_revisit_bytes=10)
    assert {r.record_type for r in index.collect()} == {"response"}
    back = warc.read_records(index.filter("page_id = 9"), folder).collect()
    assert len(back) == 1 and bytes(back[0].payload) == b"z" * 100000 and back[0].intact


def test_warc_records_follow_the_format(spark):
    """Every member of every archive is a record of WARC/1.1, read here by the format's own rules."""
    rows = [(5, "http://a/%20x y", "<p>é</p>"), (5, "http://a/%20x y", "<p>é</p>"), (None, None, None), (7, "", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = warc.archive_folder(spark)
    index = warc.write_archives(pages, folder)
    ids, kinds = [], []
    for path in __import__("pathlib").Path(folder.removeprefix("file:")).glob("*.warc.gz"):
        data = path.read_bytes()
        while data:
            unpack = zlib.decompressobj(31)
            record, data = unpack.decompress(data), unpack.unused_data
            head, _, rest = record.partition(b"\r\n\r\n")
            lines = head.decode("ascii").split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and rest[int(fields["Content-Length"]) :] == b"\r\n\r\n"
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
            ids.append(fields["WARC-Record-ID"])
            kinds.append(fields["WARC-Type"])
            if kinds[-1] != "warcinfo":
                assert " " not in fields["WARC-Target-URI"]
            if kinds[-1] == "response":
                http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 OK\r\n") and fields["WARC-Payload-Digest"] == "sha1:" + warc.base32_digest(payload)
    assert len(set(ids)) == len(ids) and sorted(k for k in kinds if k != "warcinfo") == ["response", "response", "response", "revisit"]
    back = [(r.page_id, r.url, r.refers_to) for r in warc.read_records(index, folder).collect()]
    assert sorted(back, key=str) == sorted([(5, rows[0][1], None), (5, rows[0][1], None), (None, None, None), (7, "", 5)], key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_exact_dedup(spark, odd, none):
    out = exact.exact_duplicates(odd).collect()
    assert len(out) == odd.count() and sum(r.kept for r in out) == len({t or "" for t in ODD})
    same = [r for r in out if r.text_sha256 == hashlib.sha256(b"same text here").hexdigest()]
    assert {(r.keep_id, r.group_size) for r in same} == {(5, 3)} and exact.exact_duplicates(none).count() == 0
    assert exact.drop_exact_duplicates(odd).count() == len({t or "" for t in ODD})


def test_cuckoo_index_inserts_deletes_and_resizes(spark):
    shard = exact.Shard(expected=1)
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    for k, d in enumerate(digests):
        shard.insert(d, 1, k)
    assert all(shard.filter.contains(d) for d in digests) and shard.filter.n >= 1024
    for d in digests[:2500]:
        shard.delete(d, 1, 0)
    assert all(shard.filter.contains(d) for d in digests[2500:]) and len(shard.content) == 2500
    assert sum(shard.filter.contains(d) for d in digests[:2500]) < 100
    batch = spark.createDataFrame([(bytearray(d), 1, k) for k, d in enumerate(digests[:300])], "digest binary, n long, keep_id long")
    index = exact.CuckooIndex(spark, 3).insert(batch).insert(batch.limit(100).withColumn("keep_id", F.lit(999).cast("long"))).delete(batch.filter("keep_id >= 200"))
    live = {bytes(r.digest): (r.n, r.keep_id) for r in index.entries().collect()}
    assert len(live) == 200 and max(v[1] for v in live.values()) == 999
    assert index.may_contain(batch.filter("keep_id < 200")).count() == 200


def test_deleting_the_keeper_finds_the_next(spark):
    digests = [bytearray(hashlib.sha256(str(k).encode()).digest()) for k in range(3)]
    rows = [(d, 1, doc) for d in digests for doc in (3, 8, 9)]
    frame = lambda x: spark.createDataFrame(x, "digest binary, n long, keep_id long")
    gone = [(digests[0], 1, 9), (digests[1], 1, 3), (digests[2], 3, 9)]
    left = frame([r for r in rows if (r[0], r[2]) not in [(digests[0], 9), (digests[1], 3)] and r[0] != digests[2]])
    index = exact.CuckooIndex(spark, 2).insert(frame(rows)).delete(frame(gone), left)
    assert {bytes(r.digest): (r.n, r.keep_id) for r in index.entries().collect()} == {bytes(digests[0]): (2, 8), bytes(digests[1]): (2, 9)}


def test_exact_stage_keeps_clashing_columns(spark):
    rows = [(1, "a", "p", 7, 1), (2, "a", "q", 8, 2), (2, "a", "q", 8, 2), (None, "b", "r", 9, 3), (3, None, "s", 1, 4), (4, "", "t", 1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _digest string, _n int, _id long")
    out = exact.drop_exact_duplicates(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted([(2, "a", "q", 8, 2), (None, "b", "r", 9, 3), (4, "", "t", 1, 5)], key=str)
    assert exact.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_pii_base_spans(spark, docs):
    odd = ["a@b.c@d.e a@b.c_x@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 007.0.0.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (974) 555-3436 +12 +1 2) 3", "😀 x@y.zz é +4 123 456 789 0", "9" * 30000, None, ""]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    out = {r.doc_id: r for r in pii.find_personal_data(rows).collect()}
    for r in rows.collect():
        spans = sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, r.text or "") if valid(k, m.group()))
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert out[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pii_patterns_reveal_identifiers(spark):
    seeds = [(k, f"please write my contact: user{k}@mail.example.org today") for k in range(6)] + [(k + 10, f"please write my contact: AB-{k}9921-X today") for k in range(1)] + [(50, "item code ZZ-1234567 sold")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(seeds, "doc_id long, text string")).collect()}
    assert out[10].spans == "id:25:35" and out[50].spans == "" and out[0].n_email == 1


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_corpus_query_equals_sql(spark, duck, data, name):
    from conftest import same_as_oracle

    same_as_oracle(spark, duck, data, queries.queries()[name], queries.oracle_sql()[name])


def test_near_copies_joins_all_similar_candidates(spark, monkeypatch):
    """All texts have one fingerprint of each family, so every pair is a candidate."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    template = [word() for _ in range(60)]
    rows, groups = [], []
    for g in range(6):
        own = template[:30] + [word() for _ in range(70)]
        groups.append([])
        for k in range(4):
            text = list(own)
            text[40 + 5 * k] = word()
            groups[-1].append(g + 6 * k)
            rows.append((g + 6 * k, " ".join(text)))
    rows += [(900, rows[3][1].upper()), (901, None), (902, "")]
    families = simhash._families

    def few_bits(docs):
        return families(docs).select("doc_id", "digest", *[F.expr(f"f{i} & {mask}").alias(f"f{i}") for i in range(simhash.FAMILIES)])

    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "_families", few_bits)
    monkeypatch.setattr(simhash, "FAMILIES", 2)
    owner = next(i for i, g in enumerate(groups) if rows[3][0] in g)
    want = sorted([sorted(g + [900] * (i == owner)) for i, g in enumerate(groups)] + [[901, 902]])
    for mask, hot in ((0, 4096), (7, 4096), (7, 4)):
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        found: dict = {}
        for r in simhash.connected_components(simhash.near_copies(table)).collect():
            found.setdefault(r.component, []).append(r.node)
        assert sorted(map(sorted, found.values())) == want


@pytest.mark.parametrize("seeds", [decontam.BROADCAST_SEEDS, 0])
def test_substituted_passages_leak(spark, seeds):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((12, 15, 16, 22, 31, 44, 59) * 4)]
    docs, want = [], set()
    for k, item in items:
        words = item.split()
        n = len(words)
        plans = [[q % m == s for q in range(n)] for m in (3, 4) for s in range(m)]
        plans += [[q in chosen for q in range(n)] for r in (0.2, 0.3, 0.4, 0.5) for chosen in [set(rng.sample(range(n), int(r * n)))]]
        for plan in plans:
            docs.append((len(docs), text(8) + " " + " ".join(text(1) if gone else w for w, gone in zip(words, plan, strict=True)) + " " + text(8)))
            if n - sum(plan) >= 0.6 * n:
                want.add((docs[-1][0], k))
    out = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), seeds).collect()
    got = {(r.doc_id, k) for r in out for k in r.item_ids}
    long = {r.doc_id for r in out if any(x.matches >= decontam.LONG_RUN for x in r.leaks)}
    assert want <= got and {d for d, _ in got - want} <= long


def test_benchmark_seeds_are_slim_and_texts_of_one_id_stay_apart(spark, monkeypatch):
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    one, two, long = text(20), text(30), text(3000)
    items = spark.createDataFrame([(7, one), (7, two), (7, one), (8, long), (9, ""), (None, one)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text(5) + " " + one), (2, two + " " + text(5)), (3, " ".join(long.split()[500:540])), (4, text(60))], "doc_id long, text string")
    known = decontam.benchmark_items(items)
    assert known.count() == 3 and decontam.benchmark_seeds(known).columns == ["key", "pos", "seed"]
    looked_up = []
    lookup = decontam._lookup
    monkeypatch.setattr(decontam, "_lookup", lambda *a: looked_up.append(1) or lookup(*a))
    for most, times in ((decontam.BROADCAST_BYTES, 1), (1 << 14, 1)):
        found = {r.doc_id: sorted(x.item for x in r.leaks) for r in decontam.find_leaks(docs, items, broadcast_bytes=most).collect()}
        assert found == {1: [7], 2: [7], 3: [8], 4: []} and len(looked_up) == times


def test_open_pairs_join_members_and_not_their_buckets(spark, monkeypatch):
    """All texts have one fingerprint, so their pairs are left to the rounds."""
    texts = [" ".join(f"{g}w{j}" if j != 40 + k else "z" for j in range(60)) for g in range(2) for k in range(3)]
    families, plans, cut = simhash._families, [], simhash.cut
    monkeypatch.setattr(simhash, "FAMILIES", 1)
    monkeypatch.setattr(simhash, "_families", lambda docs: families(docs).withColumn("f0", F.lit(0).cast("bigint")))
    monkeypatch.setattr(simhash, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    links = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r.node, r.component) for r in simhash.connected_components(links).collect()} == {(k, k // 3 * 3) for k in range(6)}
    dealt = [p[: p.index("[place#")] for p in plans if "[place#" in p]
    assert len(dealt) > 1 and not any("Join" in p for p in dealt)
