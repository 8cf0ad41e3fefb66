"""The training-data operators against brute force, libraries, round trips, and on edge rows."""

import hashlib
import itertools
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import bpe_codec, chat_format, decontaminate, exact_topk, near_dedup, queries, shared, shuffle_shards, token_counts, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, score int, sig string"
ODD = [None, "", " ", "a", "  x  y ", "é漢 😀", "<|endoftext|> <s>", "the " * 3000, "ab" * 3000, "\n\n", "▁▁ x", "don't. it's", "A\tb\x0bc"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(i, x) for i, x in enumerate(ODD)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([5, 60, 90, 150]))]
        for _ in range(rng.choice([1, 2, 30])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [rows[20], (None, rows[20][1]), (None, None)]
    return spark.createDataFrame([(i, x, 1, "s") for i, x in rows], DOCS).repartition(3).cache()


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def smallest_reachable(sets):
    """{id: smallest id reachable} over links of at least 80 % of the union."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def test_near_groups_match_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    of = smallest_reachable({i: shingle_set(t) for i, t in rows if i is not None})
    want = sorted(((i, len(shingle_set(t)), of.get(i), i is None or of[i] == i) for i, t in rows), key=repr)
    assert sorted(map(tuple, near_dedup.near_groups(docs).collect()), key=repr) == want
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (6, b + " more"), (6, b + " more"), (9, "é" * 100_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_groups(rows).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (6, 5, False), (6, 5, False), (9, 9, True)]


def test_wide_regions_are_confirmed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(near_dedup, "SPREAD", 4)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(90):  # one crowded region whose members are linked to some others only
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    of = smallest_reachable({i: shingle_set(t) for i, t in rows})
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == of and len(set(of.values())) > 1


def test_token_counts_match_the_library_at_every_prefix(spark, docs):
    c = token_counts.counter()
    rng = random.Random(3)
    texts = [x for x in ODD if x] + ["".join(rng.choice(" ab thein▁\né.1-'T") for _ in range(40)) for _ in range(150)] + [" " * 33, " " * 15 + "the", "\nx  y", " \n ", "a \nb"]
    for t in texts:
        t = t[:200]
        counts = [len(c.sp.encode(t[:i])) for i in range(len(t) + 1)]
        assert [int(x) for x in c.all_prefixes(t)] == counts
        assert c.count(t) == counts[-1]
        ends, at_ends = c.word_counts(t)
        assert ends[-1] == len(t) and [counts[e] for e in ends] == list(at_ends)
        assert all(c.longest(t, b) == max(i for i, n in enumerate(counts) if n <= b) for b in (0, 1, 5, 20, 500))
    got = token_counts.count_tokens(docs, limit=1000).collect()
    assert all(r.n_tokens == len(c.sp.encode(r.text or "")) and r.over_limit == (r.n_tokens > 1000) and r.n_bytes == len((r.text or "").encode()) for r in got) and len(got) == docs.count()
    assert all((r.word_tokens[-1:] or [0])[0] == r.n_tokens and (r.word_ends[-1:] or [0])[0] == len(r.text or "") for r in got)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["漢", "1", "😀", "ภาษาไทย", "ab", "'", "é", "\u0301"])
def test_texts_without_spaces_of_any_length(spark, unit):
    text = unit * (100_000 // len(unit))
    c, lib = token_counts.counter(), bpe_codec.codec().tok
    df = spark.createDataFrame([(1, text), (1, text), (2, "  " + text)], "doc_id long, text string")
    got = token_counts.count_tokens(df, limit=1000).collect()
    assert [r.n_tokens for r in got] == [len(c.sp.encode(r.text)) for r in got]
    assert all(len(c.sp.encode(r.text[: r.fits_chars])) <= 1000 < len(c.sp.encode(r.text[: r.fits_chars + 1])) for r in got)
    e = lib.encode(text, add_special_tokens=False)
    r = bpe_codec.encode(df.limit(1)).first()
    assert r.ids == e.ids and r.decoded == lib.decode(e.ids, skip_special_tokens=False)


def test_caches_are_bounded_in_bytes():
    made = []
    cache = shared.TwoGenerations(lambda k: made.append(k) or len(k), most=3000, longest=10, each=100)
    for k in range(1000):
        assert cache[f"k{k}"] == len(f"k{k}")
    assert len(cache) + len(cache.old) <= 62 and cache["long" * 5] == 20 and "long" * 5 not in cache


def test_bpe_trees_match_the_library(spark, docs):
    small, lib = bpe_codec.TreeBpe(long=8, leaf=3, span=16), bpe_codec.codec().tok
    rng = random.Random(2)
    for t in [x for x in ODD if x] + ["".join(rng.choice("theinrsoé1'.") for _ in range(rng.randint(1, 600))) for _ in range(150)]:
        e = lib.encode(t, add_special_tokens=False)
        n, ids, text = small.parts(t)
        assert (n, ids.decode(), text.decode()) == (len(e.ids), " ".join(map(str, e.ids)), lib.decode(e.ids, skip_special_tokens=False))
    for r in bpe_codec.encode(docs).collect():
        e = lib.encode(r.text or "", add_special_tokens=False)
        assert r.ids == e.ids and r.decoded == lib.decode(e.ids, skip_special_tokens=False) and r.score == 1
    assert bpe_codec.encode(docs.limit(0)).count() == 0


def test_documents_are_encoded_through_joins(spark):
    c = bpe_codec.TreeBpe()
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for t in texts:
        e = c.tok.encode(t, add_special_tokens=False)
        n, ids, text = c.parts(t)
        assert (n, ids.decode(), text.decode()) == (len(e.ids), " ".join(map(str, e.ids)), c.tok.decode(e.ids, skip_special_tokens=False))
    long = sum(len(t.encode()) > c.span for t in texts)
    assert long > len(texts) / 2 and c.joins >= long and c.grown > c.joins / 2  # most seams are inside words


def test_chat_logs_fold_and_read_back(spark):
    e = spark.createDataFrame([(1, 0, "a", "message", "user", "hi <|im_end|> <\\|"), (1, 1, "b", "delta", "assistant", "x"), (1, 2, "b", "delta", None, "y"), (1, 3, "b", "regenerate", None, None), (1, 4, "b", "delta", None, "z<|im_start|>"), (1, 5, "b", "delta", None, "!"), (1, 6, "a", "edit", None, "hello"), (2, 0, "a", "message", None, None), (None, None, "a", "message", "r\n<n>|", "t")], "conv_id long, seq long, message string, kind string, role string, text string")
    chats = chat_format.chat_format(e.repartition(4))
    got = {r.conv_id: ([tuple(t) for t in r.t], r.loss, r.formatted, [tuple(s) for s in r.loss_spans]) for r in chats.select("*", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got[1][:2] == ([("user", "hello"), ("assistant", "z<|im_start|>!")], "z<|im_start|>!")
    (_, _, start, n) = got[1][3][0]
    assert got[1][2][start : start + n] == "z<\\|im_start|>!"
    assert got[2][0] == [("", "")] and got[None][0] == [("r\n<n>|", "t")]
    again = spark.createDataFrame([(1, 0, "a", "message", "user", "one"), (1, 1, "a", "message", "assistant", "two"), (1, 2, "a", "delta", None, "!")], "conv_id long, seq long, message string, kind string, role string, text string")
    r = chat_format.chat_format(again).select(chat_format.read_turns(F.col("formatted")).alias("t")).first()
    assert [tuple(t) for t in r.t] == [("user", "one"), ("assistant", "two!")]  # each message event with its own text
    assert chat_format.chat_format(again.limit(0)).count() == 0


def test_turns_go_through_a_log_and_come_back(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (1, 2, "assistant\nx", "y"), (1, 2, "assistant", "x\ny"), (2, 0, "assistant", "long " * 5000), (2, 1, "assistant", ""), (None, 1, "user", "<|im_end|>"), (2, 1, "assistant", "")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, seq int").repartition(3)
    log = chat_format.events_of_turns(df)
    assert {r.kind for r in log.collect()} == {"message", "edit", "delta", "regenerate"}
    chats = chat_format.format_turns(df).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: ([tuple(t) for t in r.t], r.loss) for r in chats.collect()}
    assert got == {
        1: ([("", ""), ("user", "a"), ("user", "a"), ("assistant", "x\ny"), ("assistant\nx", "y")], "x\ny"),
        2: ([("assistant", "long " * 5000), ("assistant", ""), ("assistant", "")], "long " * 5000),
        None: ([("user", "<|im_end|>")], ""),
    }
    assert chat_format.format_turns(df.limit(0)).count() == 0


def test_shards_are_exact_uniform_and_repeatable(spark, tmp_path):
    spark.range(1003).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, "t").alias("text"), F.lit("t").alias("shard"), F.lit(1).alias("bucket")).repartition(5).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    out = shuffle_shards.shuffle(df, 16, bucket=9).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [62] * 5 + [63] * 11 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(r.doc_id for r in out) == list(range(1003)) and {r.bucket for r in out} == {1}
    assert sorted(map(repr, shuffle_shards.shuffle(df, 16, bucket=9).collect())) == sorted(map(repr, out))
    first = [r.shard for r in sorted(out, key=lambda r: r.doc_id)]
    assert 4 < np.mean(first[:500]) < 11
    assert shuffle_shards.shuffle(df.limit(0)).count() == 0


def test_all_orders_are_equally_likely(spark):
    df = spark.range(0, 3, 1, 2).select(F.col("id").alias("x"))
    n, seen = 24, defaultdict(int)
    for seed in range(n):
        seen[tuple(r.x for r in sorted(shuffle_shards.shuffle(df, 2, bucket=1, seed=seed).collect(), key=lambda r: (r.shard, r.slot)))] += 1
    chi = sum((seen[p] - n / 6) ** 2 / (n / 6) for p in itertools.permutations(range(3)))
    assert chi < 21  # 5 degrees of freedom: 0.001 of fair shuffles are beyond


def test_hypergeometric_beyond_the_library(monkeypatch):
    monkeypatch.setattr(shuffle_shards, "NUMPY_MOST", 10)
    rng = np.random.default_rng(1)
    x = [shuffle_shards.hypergeometric(rng, 300, 700, 200) for _ in range(1000)]
    assert abs(np.mean(x) - 60) < 0.8 and abs(np.var(x) - 200 * 0.3 * 0.7 * 800 / 999) < 6
    small = [shuffle_shards.hypergeometric(rng, 6, 5, 4) for _ in range(1500)]
    for k in range(5):
        p = math.comb(6, k) * math.comb(5, 4 - k) / math.comb(11, 4)
        assert abs(small.count(k) / 1500 - p) < 0.05
    assert shuffle_shards.split(rng, np.array([30, 0, 70]), 50).sum() == 50


def test_log_factorials_are_exact():
    import decimal

    with decimal.localcontext() as c:
        c.prec = 60
        for n in (0, 1, 5, 200, 1000):
            assert abs(shuffle_shards._log_factorial(n) - decimal.Decimal(math.factorial(n)).ln()) < decimal.Decimal(10) ** -45


def test_shard_query_on_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op2_shuffle_shards(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode())) and r.law == "rows" and r.grown_shard is None for r in rows)
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(16) for k in range(len(rows) // 16 + (s < len(rows) % 16))]


def _arc(version, records, pack):
    parts = [warc.arc_header(version, "old")] + [h + b"\n" + body + b"\n" for h, body in records]
    return b"".join(map(warc.member, parts)) if pack == "each" else warc.member(b"".join(parts)) if pack == "whole" else b"".join(parts)


@pytest.mark.parametrize("pack", ["each", "whole", "none"])
def test_arc_of_others(spark, tmp_path, pack):
    http = b"HTTP/1.0 200 OK\r\n\r\n"
    big = b"line one\nline two\n" * 20_000
    records = [
        (b"http://a.org/two words here 1.2.3.4 19990102030405 text/html %d" % len(http + big), http + big),
        (b"http://a.org/no-length 1.2.3.4 19990102030405 text/html x", b"lost 12"),
        (b"few 7", b"1234567"),
        (b"http://a.org/copy 1.2.3.4 19990102030405 text/html %d" % len(http + big), http + big),
        (b"http://a.org/empty 1.2.3.4 19990102030405 text/html 0", b""),
        (b"http://a.org/cut 1.2.3.4 19990102030405 text/html 99", b"short"),
    ]
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / ("x.arc" if pack == "none" else "x.arc.gz")).write_bytes(_arc(1, records, pack))
    (folder / "y.arc").write_bytes(_arc(2, [(b"http://b.org/a b c 1.2.3.4 19990102030405 text/html 200 - - 0 y 3", b"abc")], "none"))
    got = warc.read_arc(spark, f"file://{folder}", strict=False).collect()
    x = [(r.url, r.status, None if r.payload is None else len(r.payload)) for r in sorted(got, key=lambda r: r.offset) if r.archive.startswith("x")]
    ok = [("http://a.org/two words here", "ok", len(big)), ("http://a.org/copy", "ok", len(big)), ("http://a.org/empty", "ok", 0)]
    if pack == "whole":  # nothing after the first bad record of a member is read
        ok = ok[:1]
    assert [r for r in x[1:] if r[1] == "ok"] == ok
    assert ("http://a.org/no-length", "no length", None) in x
    assert len({r.offset for r in got if r.archive.startswith("x")}) == len(x)
    assert [(r.url, bytes(r.payload)) for r in got if r.archive == "y.arc"][1:] == [("http://b.org/a b c", b"abc")]
    with pytest.raises(Exception, match="no length"):
        warc.read_arc(spark, f"file://{folder}").collect()
    out = f"file://{tmp_path}/warc"
    warc.convert(spark, f"file://{folder}", out, strict=False)
    back = warc.read_warc(spark, out).where("record_type <> 'warcinfo'").collect()
    assert sorted(r.url for r in back) == sorted([u for u, _, _ in ok] + ["http://b.org/a b c"])
    assert len({r.record_id for r in back}) == len(back)


def test_arc_that_is_broken_or_long(spark):
    packed = _arc(1, [(b"u 1.2.3.4 19990102030405 t 3", b"abc"), (b"v 1.2.3.4 19990102030405 t 3", b"abc")], "each")
    assert [r["status"] for r in warc.parse_arc("n", packed[:-4], strict=False)] == ["ok", "ok", "ok", "broken gzip"]
    assert list(warc.parse_arc("n", b"")) == []
    junk = [(b"w" * 3_000_000 + b" 7", b""), (b"u 1.2.3.4 19990102030405 t 3", b"abc")]  # a line that is no header
    assert [r["status"] for r in warc.parse_arc("n", _arc(1, junk, "none"), strict=False)] == ["ok", "no length", "ok"]
    many = [(b"u%d 1.2.3.4 19990102030405 t 1000" % k, b"x" * 1000) for k in range(2000)]
    assert [len(r["body"]) for r in warc.parse_arc("n", _arc(1, many, "whole"))][1:] == [1000] * 2000  # one member of 2 MB


def test_warc_converts_both_versions(spark):
    big = "é" * 600
    assert warc._fs("file:/tmp")[1] == "/tmp"
    rows = [(7, "long", "z" * 3_000_000), (1, "http://a/ b%20", big), (2, None, big), (3, "-", None), (3, "", "x"), (4, "u\nv", big), (4, "w", big), (None, "n", big), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.archive(pages)
    got = warc.read_warc(spark, folder, payloads=True).where("record_type IN ('response', 'revisit')").collect()
    assert len(got) == len(rows) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 1200 and r.page_id) == [(1, "revisit", 4), (2, "revisit", 4), (4, "response", None), (4, "response", None)]
    assert {(r.url) for r in got} >= {"http://a/ b%20", "-", "", "u\nv"} and any(r.url is None for r in got)
    ids = {r.record_id: r.page_id for r in got}
    assert len(ids) == len(rows) and all(ids[r.refers_to_id] == r.refers_to for r in got if r.record_type == "revisit")
    body = b"payload"
    for version in (1, 2):
        arc = warc.member(warc.arc_header(version, "n")) + warc.member(warc.arc_record(version, "n", 5, "u", "20200102030405", "text/plain", body))
        assert [r["body"] for r in warc.parse_arc("n", arc)][1] == body
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc("n", warc.member(warc.arc_header(1, "n")) + warc.member(b"u 0 1 t 99\nshort")))
    assert warc.read_warc(spark, warc.archive(pages.limit(0))).count() == 0
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(warc.member(b"x" * 100)[:-3]))


def test_only_archives_of_the_manifest_are_read(spark):
    pages = spark.createDataFrame([(k, "u", "x" * 1500) for k in range(6)], "page_id long, url string, html string").repartition(3)
    folder = warc.archive(pages, keep_arc=True)
    fs, at = warc._fs(folder)
    with fs.open_output_stream(f"{at}/part-000000-00000-a999.warc.gz", compression=None) as f:  # as a lost attempt leaves it
        f.write(warc.member(warc.warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "x"), ("WARC-Date", "x")], b"stale")))
    got = warc.read_warc(spark, folder).where("record_type <> 'warcinfo'").collect()
    assert len(got) == 6 and sorted(r.refers_to or -1 for r in got) == [-1] + [5] * 5
    fs.delete_dir(f"{at}/manifest")
    assert warc.read_warc(spark, folder).where("record_type = 'warcinfo'").count() > 1  # without one, the folder is listed


def test_urls_trie_and_join_agree(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    urls = [None, "", "no", "http://", "HTTP://A.Example.COM/en/71?x", "http://example.com/en/8", "x://xexample.com/en/7", "a://example.net/de/8/b#c", "a://b.net/de/", "a://org/es/?", "a://org", "a://net#/de/", "http://É.net/de/1", "a://b\n.org/es/1\n2"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    a = url_filter.judge_urls(pages, rules)
    b = url_filter.judge_urls(pages, url_filter.rules_table(spark, rules), max_broadcast=0)
    key = lambda df: sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()))
    assert key(a) == key(b)
    assert [r.verdict for r in sorted(a.collect(), key=lambda r: r.page_id)] == ["allow"] * 4 + ["allow", "block", "block", "block", "allow", "block", "allow", "allow", "allow", "block"]


def test_equal_rules_and_odd_rules(spark):
    pages = spark.createDataFrame([(1, "a://x.com/p/q"), (1, "a://x.com/p/q"), (2, "a://y.com/"), (3, "a://x.com/" + "p" * 50_000)], "page_id long, url string")
    rules = [("block", "x.com", "/p"), ("allow", "x.com", "/p"), ("block", "com", ""), ("allow", "x.com", "/ppp")]
    want = [(1, "x.com/p", "block"), (1, "x.com/p", "block"), (2, "com", "block"), (3, "x.com/ppp", "allow")]
    key = lambda df: sorted(map(tuple, df.select("page_id", "rule", "verdict").collect()))
    assert key(url_filter.judge_urls(pages, rules)) == key(url_filter.judge_urls(pages, rules, max_broadcast=0)) == want
    table = url_filter.rules_table(spark, rules)
    assert key(url_filter.judge_urls(pages, table)) == key(url_filter.judge_urls(pages, table, max_broadcast=0)) == [(i, r, "allow" if r == "x.com/p" else v) for i, r, v in want]
    assert key(url_filter.judge_urls(pages.limit(0), rules)) == [] and {r.verdict for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def noisy_or(model, text):
    """The score by the definition, apart from the operator's own code."""
    clean = 1.0
    for sentence in (text or "").replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
        z = model.bias
        for word in sentence.split():
            w = word.strip(",;:\"'()[]|*#%<>&").lower()
            if w:
                names = ["=" + w] + [f"{k}{w[:k]}" for k in (3, 4, 5, 6) if len(w) > k] + (["~" + w[-4:]] if len(w) > 4 else [])
                z += sum(float(model.weights[zlib.crc32(x.encode("utf-8", "surrogatepass")) % len(model.weights)]) for x in names)
        if sentence.strip():
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


def test_scores_are_the_noisy_or_of_the_sentences(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.training_rows(docs, labels)
    by_text = {r.text: r.doc_id for r in docs.collect()}
    assert rows and all(zlib.crc32(str(by_text[t]).encode()) % 4 != 2 for t, _, _ in rows)
    model = toxicity.fit(rows)
    got = toxicity.score(docs.unionAll(docs.limit(1)), model).collect()
    assert len(got) == docs.count() + 1
    assert all(abs(r.score - noisy_or(model, r.text)) < 1e-6 for r in got)


def test_the_lasso_is_chosen_on_training_folds():
    rng = random.Random(3)
    rows = [(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(9)) + (" grumbling" if k % 4 == 0 else ""), int(k % 4 == 0), 1.0) for k in range(200)]
    assert toxicity.choose(rows, (0.05, 50.0)) == 0.05
    assert toxicity.choose(rows[:3]) in toxicity.SHRINKS


def test_toxic_sentences_are_found(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "omega"])
    rows, labels = [], []
    for i in range(400):
        s = [" ".join(word() for _ in range(6)) for _ in range(rng.randint(1, 6))]
        bad = i % 4 == 0
        if bad:
            s[rng.randrange(len(s))] += " " + rng.choice(["grumbling", "grumbles"])
        rows.append((i, ". ".join(s)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "grumble alpha. beta")], "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(d, lab))
    got = {r.doc_id: r for r in toxicity.score(d, model, located=True).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all((got[i].score >= 0.3) == (i % 4 == 0) for i in held)
    assert got[902].score >= 0.3 and [(x.start, x.end) for x in got[902].offending] == [(0, 13)]
    assert got[900].score == got[901].score == 0.0
    none = toxicity.fit(toxicity.training_rows(d, lab.where("toxic = 0")))
    assert {r.score for r in toxicity.score(d, none).collect()} == {0.0}


def test_a_text_too_long_for_the_sample_is_passed_over(spark):
    ids = [r.id for r in spark.range(60).where(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id")).collect()]
    first = {i % 2: i for i in reversed(ids)}  # of each class in the sample's order
    texts = {i: f"text {i}" for i in ids} | dict.fromkeys(first.values(), "long " * 300)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, max_bytes=2000)
    assert sorted(t for t, _, _ in got) == sorted(f"text {i}" for i in ids if i not in first.values())
    with pytest.raises(ValueError, match="longer than the sample"):
        toxicity.training_rows(docs, labels, max_bytes=10)
    few = toxicity.training_rows(docs, labels, per_class=3, max_bytes=2000)
    assert sorted(y for _, y, _ in few) == [0, 0, 0, 1, 1, 1]


def test_topk_matches_brute_force(spark):
    rng = random.Random(4)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    rows = [(i, vec()) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 320)] + [(400, None), (401, [1.0, None] * 3), (402, [float("nan")] * 6), (403, [1.0]), (450, [2.0]), (404, []), (None, vec())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(list)
    for r in exact_topk.top_k(df, df.where("vec_id % 50 = 0"), candidates=32, query_rows=3).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v and None not in v and all(x == x for x in v)}
    for q in good:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert exact_topk.top_k(df.limit(0), df.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0], 1), (7, [2.0], 1), (7, [2.0], 1)], "vec_id long, embedding array<float>, score int")
    assert sorted(map(tuple, exact_topk.top_k(twice, twice.where("vec_id = 0")).collect())) == [(0, 1, 7, 131072), (0, 2, 7, 131072)]
    huge = spark.createDataFrame([(0, [1e18]), (1, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        exact_topk.top_k(huge, huge).collect()


def test_leaks_are_found_through_substitutions(spark):
    rng = random.Random(6)
    w = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    item, short = w(20), ["tiny", "little", "item"]
    changed = list(item)
    changed[5], changed[14] = "other", "words"
    texts = [" ".join(w(30) + item + w(9)), " ".join(w(4) + changed).upper(), " ".join(w(50)), None, "", " ".join(item[:9] + w(20)), "a tiny, little item", " ".join(item[4:])]
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(short)), (9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.item_tokens, r.matched_tokens) for r in decontaminate.contamination(d, b).collect()}
    assert got == {(0, 7): (20, 20), (1, 7): (20, 18), (7, 7): (20, 16), (6, 8): (3, 3)}
    assert decontaminate.contamination(d.limit(0), b).count() == 0 and decontaminate.contamination(d, b.limit(0)).count() == 0


def test_leaks_on_edges(spark, monkeypatch):
    long = "long " * 20_000
    d = spark.createDataFrame([(1, "red green blue"), (1, "x red green blue y"), (2, "the one"), (None, "one"), (3, long), (3, long)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "green"), (1, "green"), (1, "red green blue"), (None, "one"), (5, "absent")], "item_id long, text string")
    want = {(1, 1, 3, 3), (2, None, 1, 1), (None, None, 1, 1)}
    assert {tuple(r) for r in decontaminate.contamination(d, b).collect()} == want
    monkeypatch.setattr(decontaminate, "MOST_SEEDS", 2)  # several passes
    assert {tuple(r) for r in decontaminate.contamination(d, b).collect()} == want


def leaks_by_hand(docs, items):
    """(doc, item): (tokens, matched) of every alignment tried in turn, without seeds."""
    cut = lambda x: "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()
    out = {}
    for i, text in items:
        it = cut(text)
        window = min(13, len(it))
        for d, body in docs:
            t = cut(body)
            for shift in range(1 - len(it), len(t)) if it else ():
                same = [it[y] == t[y + shift] for y in range(max(0, -shift), min(len(it), len(t) - shift))]
                if any(5 * sum(same[k : k + window]) >= 4 * window for k in range(len(same) - window + 1)):
                    out[d, i] = (len(it), max(out.get((d, i), (0, 0))[1], sum(same)))
    return out


def test_every_allowed_substitution_is_found(spark):
    items, texts = [], []
    for n in [*range(1, 14), 15]:
        word = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(word)))
        lost = min(n, 13) - decontaminate.needed(n)[1]
        for changed in [c for k in range(lost + 2) for c in itertools.combinations(range(n), k)]:
            texts.append(" ".join("other" if k in changed else w for k, w in enumerate(word)))
    # one lone window of a long item, at its end
    word = [f"long{k}" for k in range(30)]
    items.append((30, " ".join(word)))
    texts += [" ".join("other" if k in c else w for k, w in enumerate(word[17:])) for c in itertools.combinations(range(13), 2)]
    rows = [(i, ("before " * (i % 3)) + x + (" after" * (i % 2))) for i, x in enumerate(texts)]
    want = leaks_by_hand(rows, items)
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for few in ([*range(1, 31)], [13, 15, 30], [10], [6]):
        got = {(r.doc_id, r.item_id): (r.item_tokens, r.matched_tokens) for r in decontaminate.contamination(d, b.where(F.col("item_id").isin(few))).collect()}
        assert got == {k: v for k, v in want.items() if k[1] in few}


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionAll(docs.limit(1)).unionAll(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.select("*", F.lit(1).alias("nth"), F.lit("x").alias("toxic_score"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    kept = P.drop_near_copies(spark, docs, SF)
    groups = near_dedup.near_groups(docs).where("doc_id IS NOT NULL").select("component_id").distinct().count()
    assert kept.where("doc_id IS NOT NULL").count() == groups
    left = P.drop_leaks(spark, docs, SF)
    assert decontaminate.contamination(left, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert set(P.encode(spark, docs, SF).columns) >= {"doc_id", "ids", "decoded", "ids_sha256"}


def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8)))
    vocabulary = [word() for _ in range(400)]
    prose = lambda n: ". ".join(" ".join(rng.choice(vocabulary) for _ in range(8)) for _ in range(n))
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([20, 15, 13, 9, 30])]
    texts = [prose(rng.randint(1, 12)) for _ in range(120)]
    for k in range(0, 120, 5):  # toxic
        texts[k] += ". you grumbling " + rng.choice(vocabulary)
    for k in range(1, 120, 12):  # leaks, some with a substitution
        w = rng.choice(items)[1].split()
        if k % 24 == 1:
            w[3] = "changed"
        texts[k] += ". " + " ".join(w)
    for k in range(30):  # copies, exact and near
        w = rng.choice(texts[:120]).split(" ")
        if k % 2:
            w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    texts += [None, "", " ", "x" * 3000, items[0][1]]
    rows = [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("grumbling" in (t or ""))) for i, t, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))

    left = {r[0]: r[1] for r in rows}
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    left = {i: t for i, t in left.items() if noisy_or(model, t) < 0.3}
    toxic_left = sum("grumbling" in (t or "") for t in left.values())
    of = smallest_reachable({i: shingle_set(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if of[i] == i}
    leaks = {d for d, _ in leaks_by_hand(list(left.items()), items)}
    left = {i: t for i, t in left.items() if i not in leaks}
    lib = bpe_codec.codec().tok
    want = {}
    for i, t in left.items():
        e = lib.encode(t or "", add_special_tokens=False)
        decoded = lib.decode(e.ids, skip_special_tokens=False)
        want[i] = (len(e.ids), e.ids, decoded, hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert toxic_left == 0 and leaks and len(want) < len(of) < len(rows)
    got = P.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids, r.decoded, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_queries_match_the_libraries_on_a_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sp, lib = token_counts.counter().sp, bpe_codec.codec().tok
    for r in queries.op4_token_counts(spark, SF).collect():
        n = len(sp.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    for r in queries.op10_bpe_codec(spark, SF).collect():
        e = lib.encode(texts[r.doc_id], add_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    held = {r.doc_id: r for r in queries.op7_toxicity(spark, SF).collect()}
    assert set(held) == set(texts) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in held.items())


def test_tables_and_folders(spark):
    t = shared.written(spark.range(3), "x")
    assert t.count() == 3
    shared.drop(t)
    with pytest.raises(Exception, match="(?i)exist"):
        t.count()
    assert shared.free(["a", "A_"], "a", "b", "b") == ["a__", "b", "b_"]


def test_oracle_queries_match_their_sql(spark):
    import duckdb

    import compare

    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        df = queries.queries()[name](spark, SF)
        rows = lambda xs: sorted((tuple(map(compare.normal, x)) for x in xs), key=repr)
        assert sorted(names) == sorted(df.columns) and rows([[r.asDict(True)[c] for c in names] for r in df.collect()]) == rows(got.fetchall()), name
