"""Each operator against brute force, with the edge cases that its docstring defines."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsight.llm import common, decontamination, embedding_dedup, jaccard_join, license_scan, line_dedup, sentencepiece, substring_dedup, toxicity, url_filter, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in zip(ids, texts)], SCHEMA)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


EDGE = [None, "", " ", "\n\n", "x", "é" * 900, "one two three", "one two three"]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages and lines, null, empty and long texts."""
    r = random.Random(4)
    passage, line = prose(r, 90), prose(r, 20)
    out = list(EDGE)
    for k in range(60):
        words = prose(r, r.randint(5, 200)).split()
        out.append("\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12)))
        if k % 4 == 0:
            out.append(out[-1])
        if k % 5 == 0:
            changed = out[-1].split(" ")
            changed[len(changed) // 2] = "changed"
            out.append(" ".join(changed))
        if k % 3 == 0:
            out.append(out[-1] + "\n" + passage + "\n" + line + "\n" + prose(r, 15))
    out.append(prose(r, 6000) + " " + passage)
    return out


def test_line_dedup(spark, corpus):
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(docs_of(spark, corpus)).collect()}
    seen, gone = {}, collections.defaultdict(set)
    for d, t in enumerate(corpus):
        lines = t.split("\n") if t is not None else []
        runs = [(i, 2, tuple(lines[i : i + 2])) for i in range(len(lines) - 1)] + [(i, 1, (x,)) for i, x in enumerate(lines) if len(re.split(r"\s+", x)) >= 50]
        for i, n, k in runs:
            seen.setdefault(k, []).append((d, zlib.crc32(b""), i, n))
    for places in seen.values():
        first = min((d, i) for d, _, i, _ in places)
        for d, _, i, n in places:
            if (d, i) != first:
                gone[d] |= set(range(i, i + n))
    for d, t in enumerate(corpus):
        expected = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
        assert out[d]["text"] == expected and out[d]["_n_removed"] == len(gone[d])


def test_repeated_rows_and_null_ids(spark):
    text = "a b\nc d\ne f"
    docs = docs_of(spark, [text, text, text, None], [None, 1, 1, 1]).withColumn("lines", F.lit(1)).withColumn("fp", F.lit(2))
    out = sorted((r["doc_id"] is not None, r["text"] or "") for r in line_dedup.line_dedup(docs).collect())
    assert out == [(False, text), (True, ""), (True, ""), (True, "")]
    joined = jaccard_join.op9(docs).collect()
    assert sorted(r["n_links"] for r in joined) == [0, 2, 2, 2] and {r["class_id"] for r in joined} == {1}
    assert jaccard_join.keep_one(docs).count() == 2


def test_empty_tables(spark):
    docs = docs_of(spark, ["x"]).where("false")
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    for df in (line_dedup.op1(docs), sentencepiece.op2(docs), warc.op3(pages), url_filter.op4(pages), substring_dedup.op5(docs), license_scan.op6(docs), toxicity.op7(docs, labels), decontamination.op8(docs, bench), decontamination.op8(docs, bench.where("false")), jaccard_join.op9(docs), embedding_dedup.op10(vectors)):
        assert df.count() == 0


def test_decontamination(spark, corpus, monkeypatch):
    r = random.Random(9)
    items = [prose(r, 30), "short item", None, "", corpus[20].split("\n")[0] + " " + corpus[30].split("\n")[0], "one Two THREE", " ".join((corpus[25] or "x").split()[:14])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = collections.defaultdict(set)
    for i, t in enumerate(items):
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    for size, terms, part in ((decontamination.SEGMENT_BYTES, decontamination.BUCKET_TERMS, decontamination.PART_PHRASES), (700, 3, 2)):
        monkeypatch.setattr(decontamination, "SEGMENT_BYTES", size)
        monkeypatch.setattr(decontamination, "PART_PHRASES", part)
        monkeypatch.setattr(decontamination, "BUCKET_TERMS", terms)
        out = {x["doc_id"]: x for x in decontamination.contamination(docs_of(spark, corpus), bench).collect()}
        for d, t in enumerate(corpus):
            w, hit, found = words(t), set(), set()
            for g, ids in windows.items():
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        hit |= set(range(k, k + len(g)))
                        found |= ids
            x = out[d]
            assert (x["n_words"], x["n_hit"], x["items"]) == (len(w), len(hit), sorted(map(str, found)))
            assert x["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    kept = decontamination.decontaminate(docs_of(spark, corpus).withColumn("items", F.lit(1)), bench)
    assert kept.columns[-1] == "items" and sorted(x["doc_id"] for x in kept.collect()) == [d for d in range(len(corpus)) if not out[d]["contaminated"]]


def test_proximity(spark):
    docs = docs_of(spark, ["a x b y c", "a b", "c q q q q q q q b a", None])
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    out = decontamination.proximity(docs, bench, terms=3, slop=4).collect()
    assert [(r["doc_id"], r["item_id"], r["n_places"]) for r in out] == [(0, "1", 1)]


def test_jaccard_join(spark, corpus):
    r = random.Random(2)
    base = prose(r, 120).split()
    texts = list(corpus)
    for k in range(25):
        w = list(base)
        w[r.randrange(120)] = f"edit{k}"
        texts.append(" ".join(w))
    out = {x["doc_id"]: x for x in jaccard_join.op9(docs_of(spark, texts)).collect()}
    sets = []
    for t in texts:
        w = common.words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = collections.Counter()
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert {d: (x["class_id"], x["n_links"]) for d, x in out.items()} == {d: (find(d), links[d]) for d in range(len(texts))}
    assert sum(links.values()) > 200


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    r = random.Random(8)
    base = prose(r, 150).split()
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(13)]
    out = jaccard_join.op9(docs_of(spark, texts)).collect()
    assert all(x["n_links"] == 12 and x["class_id"] == 0 for x in out)


def test_buckets_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    r = random.Random(12)
    words = prose(r, 900).split()
    texts = [" ".join(words[12 * k : 12 * k + 150]) for k in range(60)]
    units = []
    whole = jaccard_join._units
    monkeypatch.setattr(jaccard_join, "_units", lambda *a: units.append(whole(*a)) or units[-1])
    out = {x["doc_id"]: x for x in jaccard_join.op9(docs_of(spark, texts)).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    links = [sum(5 * len(a & b) >= 4 * len(a | b) for b in sets) - 1 for a in sets]
    assert [out[k]["n_links"] for k in range(60)] == links and sum(links) > 100
    assert {x["class_id"] for x in out.values()} == {0}
    assert units[0].where("band >= 0").count() > 0


def test_posterior_bounds():
    needs = dict(jaccard_join.least_matches(0.8))
    assert all(0 < m < n for n, m in needs.items()) and needs[240] > 240 * 0.6


@pytest.mark.parametrize("length,window,received", [(400, 320, 20_000), (60, 40, 20_000), (60, 40, 3)])
def test_substring_dedup(spark, corpus, length, window, received):
    texts = [*corpus, "ab" * 500, "abc" * 400 + "tail"]
    out = {x["doc_id"]: x for x in substring_dedup.substring_dedup(docs_of(spark, texts), length=length, window=window, received=received).collect()}
    for d, spans in enumerate(substring_dedup.brute_force(texts, length)):
        assert [(s["lo"], s["hi"]) for s in out[d]["removed"]] == spans
        data = (texts[d] or "").encode()
        gone = {i for a, b in spans for i in range(a, b)}
        assert bytes(out[d]["kept_bytes"]) == bytes(x for i, x in enumerate(data) if i not in gone)


def test_offsets_of_large_groups():
    r = random.Random(7)
    for n in (30, 60):
        rows = sorted((b"".join(r.choice((b"a", b"b")) for _ in range(r.randint(8, 20))), b"".join(r.choice((b"a", b"b")) for _ in range(r.randint(0, 12))), k) for k in range(n))
        keys = [x + y for x, y, _ in rows]
        order = sorted(range(n), key=keys.__getitem__)
        group = [(substring_dedup.common_prefix(keys[a], keys[b]) if i else 0, rows[b][0], rows[b][1], (b,)) for i, (a, b) in enumerate(zip([order[0], *order], order))]
        got = substring_dedup.offsets(group, 20)
        for i, g in enumerate(group):
            mine = {a for lo, hi in got[i] for a in range(lo, hi + 1)}
            string = lambda h, a: h[2][:a][::-1] + h[1][: 20 - a] if len(h[2]) >= a and len(h[1]) >= 20 - a else None
            assert mine == {a for a in range(len(g[2]) + 1) if string(g, a) and any(string(h, a) == string(g, a) for j, h in enumerate(group) if j != i)}


def test_large_groups_need_rounds_only_where_blocks_change(monkeypatch):
    # 30 suffixes of one head of 100 bytes, in pairs, behind one text of 319: few common prefixes, 319 offsets.
    left = bytes(random.Random(5).choices(b"cdef", k=319))
    rows = sorted((b"h" * 100 + bytes([65 + k // 2]) * 300, left, k) for k in range(30))
    group = [(substring_dedup.common_prefix(rows[i - 1][0] + left, x + y) if i else 0, x, y, (k,)) for i, (x, y, k) in enumerate(rows)]
    rounds = []
    whole = substring_dedup.np.cumsum
    monkeypatch.setattr(substring_dedup.np, "cumsum", lambda *a, **k: rounds.append(1) or whole(*a, **k))
    got = substring_dedup.offsets(group, 400)
    assert got == [[(0, 319)]] * 30 and len(rounds) <= 8


def test_loser_tree():
    r = random.Random(3)
    rows = [(bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))), 0, k, 0, 0) for k in range(200)]
    runs = []
    for k in range(7):
        blob = substring_dedup.front_code(sorted(rows[k::7]))
        import pyarrow as pa

        runs.append(substring_dedup.Run(pa.ipc.open_stream(blob).read_next_batch()))
    merged = list(substring_dedup.merge_runs(runs))
    assert [m[1] for m in merged] == sorted(x[0] for x in rows)
    assert all(m[0] == substring_dedup.common_prefix(a[1], m[1]) for a, m in zip(merged, merged[1:]))


def test_sentencepiece_matches_the_public_library(spark, corpus):
    spm = pytest.importorskip("sentencepiece")
    reference = spm.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    r = random.Random(5)
    texts = [*corpus, *("".join(r.choice("aabcdet hnsréñ漢\n\t .,01<>-_▁\U0001f600") for _ in range(r.randint(1, 60))) for _ in range(400))]
    out = {x["doc_id"]: x for x in sentencepiece.encode_decode(docs_of(spark, texts)).collect()}
    for d, t in enumerate(texts):
        assert out[d]["ids"] == (None if t is None else reference.encode(t))
        assert out[d]["decoded"] == (None if t is None else reference.decode(out[d]["ids"]))
        if t and "▁" not in t:
            assert out[d]["decoded"] == t
    again = sentencepiece.decode(sentencepiece.encode(docs_of(spark, texts).select("doc_id", "text"))).collect()
    assert all(x["decoded"] == out[x["doc_id"]]["decoded"] for x in again)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_character_maps_match_the_public_library(spark, tmp_path, rule, squeeze):
    spm = pytest.importorskip("sentencepiece")
    spec = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=squeeze).serialized_normalizer_spec()
    size, number = b"", len(spec)
    while number > 127:
        size, number = size + bytes([number & 127 | 128]), number >> 7
    with open(sentencepiece.MODEL, "rb") as f:
        model = f.read() + b"\x1a" + size + bytes([number]) + spec
    path = tmp_path / "mapped.model"
    path.write_bytes(model)
    reference = spm.SentencePieceProcessor(model_proto=model)
    r = random.Random(7)
    chars = "aeiouAEİßﬁ①Ａ㌔½´\u0300\u0301\u0323\u200b\u00a0\u3000\ufeff\x00\x07\n\t ▁각ㄱ\u1100\u1161\u11a8漢ｶﾞΣςﷺ\U0001f600é"
    texts = ["", " ", "▁", "x▁", "\u200b", "  a  b  ", "\u3000", "ﷺ" * 50, *("".join(r.choice(chars) for _ in range(r.randint(1, 40))) for _ in range(600)), None]
    t = sentencepiece.Transducer(model)
    for text in texts[:-1]:
        assert t.normalise(text) == reference.normalize(text), text
    out = {x["doc_id"]: x["ids"] for x in sentencepiece.encode(docs_of(spark, texts), model=str(path)).collect()}
    assert [out[d] for d in range(len(texts))] == [None if x is None else reference.encode(x) for x in texts]


def test_borders_and_forward_pass_against_merging():
    t = sentencepiece.transducer(sentencepiece.MODEL)
    r = random.Random(1)
    pieces = sorted(t.reached) + sorted(p for p in t.ids if len(p) == 1)
    for _ in range(5000):
        a, b = r.choice(pieces), r.choice(pieces)
        assert t.agree(a, b) == (t.merged(a + b) == [a, b])
        text = "▁" + "".join(r.choice(pieces) for _ in range(r.randint(1, 5))).replace("▁", "")
        assert t.best_first(text) == t.forward(text) == t.merged(text)


def test_unigram_shortest_path():
    with open(sentencepiece.MODEL, "rb") as f:
        t = sentencepiece.Transducer(f.read(), "unigram")
    t.scores = [-float(len(p) % 5 + 1) for p in t.pieces]

    def best(text):
        if not text:
            return 0.0
        return min(best(text[n:]) + (-t.scores[t.ids[text[:n]]] if text[:n] in t.ids else t.unknown_weight) for n in range(1, len(text) + 1) if n == 1 or text[:n] in t.ids)

    for text in ("hello", "▁there", "zqxj", "éa漢"):
        found = t.shortest(text)
        assert "".join(found) == text
        assert sum(-t.scores[t.ids[p]] if p in t.ids else t.unknown_weight for p in found) == pytest.approx(best(text))


def test_warc(spark, tmp_path):
    html = '<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- no --><p>One <b>two</b></p><ul><li><a href="/x?a=1&amp;b=2">three</a></li></ul>&lt;end&gt;</body></html>'
    pages = spark.createDataFrame([(1, "https://a.example/x", html), (2, None, None), (1, "https://a.example/x", html)], "page_id bigint, url string, html string")
    sources = warc.responses(pages)
    out = warc.derive(sources)
    rows = {(r["page_id"], r["record_type"]): r for r in out.collect()}
    assert out.count() == 6
    text, meta = rows[(1, "conversion")], rows[(1, "metadata")]
    assert text["block"] == "A & B\nOne two\nthree\n<end>"
    assert "title: A & B\r\n" in meta["block"] and "outlink: /x?a=1&b=2 L a/@href\r\n" in meta["block"] and "languages-html: fr\r\n" in meta["block"]
    source = {r["page_id"]: r for r in sources.collect()}[1]
    assert text["refers_to"] == meta["refers_to"] == source["record_id"] and text["concurrent_to"] == meta["record_id"] and meta["concurrent_to"] == text["record_id"]
    assert text["source_payload_digest"] == warc.digest(html.encode()) == source["payload_digest"] and text["block_digest"] == warc.digest(text["block"].encode())
    warc.write_warc(sources.unionByName(out), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w") + "/*.gz").collect()
    assert len(back) == 9
    found = {(r["headers"]["WARC-Type"], bytes(r["block"]).decode()) for r in back}
    assert ("conversion", text["block"]) in found and ("response", source["block"]) in found
    assert all(r["headers"]["WARC-Block-Digest"] == warc.digest(bytes(r["block"])) for r in back)


def test_broken_pages_take_linear_time():
    import time

    for piece in ("<a ", "<script", "<!--", "<a href='", '<meta charset="', "<title>", "</script ", "<html lang=", "<style>x", "<b 'x\">"):
        began = time.process_time()
        warc.parse(piece * (1_000_000 // len(piece)))
        assert time.process_time() - began < 10, piece


def test_parse():
    page = warc.parse("<html lang=de><title>T &amp; U</title><body><p title='a > b'>one</p>x<br/>y <i>z</i><!-- c --><style>s</style><img src=i.png><a href=\"i.png\">k</a><a href=''>e</a>1 < 2 & don't <b don't>q")
    assert page.text == "T & U\none\nx\ny z k e 1 < 2 & don't q".replace(" k e 1", " ke1") and (page.title, page.language, page.charset) == ("T & U", "de", "")
    assert page.links == [("i.png", "img/@src"), ("i.png", "a/@href")]


def test_warc_blocks_that_hold_records(spark, tmp_path):
    inner = "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nabc"
    pages = spark.createDataFrame([(k, f"http://x/{k}", inner + "é" * k) for k in range(4)], "page_id bigint, url string, html string")
    sources = warc.responses(pages)
    warc.write_warc(sources, str(tmp_path / "w"), "none")
    back = warc.read_warc(spark, str(tmp_path / "w"))
    assert sorted(bytes(r["block"]).decode() for r in back.collect()) == sorted(r["block"] for r in sources.collect())


def test_warc_files_of_many_splits(spark, tmp_path):
    r = random.Random(2)
    fake = "text\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\nContent-Length: %s\r\n\r\nabc"
    htmls = [prose(r, r.randint(1, 1500)) + (fake % r.choice(["3", "70000", "x", ""]) * r.randint(0, 4) + "é" * k) * (k % 2) for k in range(40)] + [fake % 5 * 3000, "\r\n\r\nWARC/1." * 9000, ""]
    pages = spark.createDataFrame([(k, f"http://x/{k}", h) for k, h in enumerate(htmls)], "page_id bigint, url string, html string").coalesce(1)
    sources = warc.responses(pages)
    warc.write_warc(sources, str(tmp_path / "dirty"), "none")
    warc.write_warc(warc.responses(pages.where(F.col("page_id") % 2 == 0).where("page_id < 40")), str(tmp_path / "clean"), "none")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path / "dirty")).rdd.getNumPartitions() > 8
        expected = {x["record_id"]: x["block"] for x in sources.collect()}
        for name, n in (("dirty", 43), ("clean", 20), ("*", 63)):
            back = warc.read_warc(spark, str(tmp_path / name)).collect()
            assert len(back) == n and all(bytes(x["block"]).decode() == expected[x["headers"]["WARC-Record-ID"]] for x in back)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="Content-Length"):
        warc.read_warc(spark, str(tmp_path / "bad")).collect()


URLS = ["https://www.example.com/en/7?x", "http://A.Example.COM/en/8#y", "https://x.net/de/1", "https://m.example.net/de/85", "http://site.org/es/", "http://notexample.com.evil.info/en/", "nothing", None, "", "https://h?q=/en/", "a://b://c/d", "https://casino-win.example.net/fr/1", "https://plain.example.net/fr/1"]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    out = {r["page_id"]: r for r in url_filter.op4(pages).collect()}

    def parts(u):
        if not u or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        return host.translate({c: c + 32 for c in range(65, 91)}), re.split(r"[?#]", rest[len(host) :])[0]

    for k, u in enumerate(URLS):
        host, path = parts(u)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, default=(0, None, None))
        assert (out[k]["host"], out[k]["path"], out[k]["rule"]) == (host, path, rule[1])
        assert out[k]["verdict"] in ("allow", "block") and (rule[2] is None or out[k]["verdict"] == rule[2])
    known = {r["page_id"]: r for r in url_filter.judge(pages, rejected=[f"https://casino-win.example.{top}/" for top in ("com", "net", "org")]).collect()}
    assert known[11]["ratio"] > known[12]["ratio"] and known[11]["ratio"] > out[11]["ratio"]


def test_url_verdicts_against_brute_force(spark):
    r = random.Random(4)
    urls = [f"https://{r.choice(['a', 'b', 'news', 'shop'])}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.randrange(99)}" for _ in range(300)] + [None, "", "x"]
    pages = spark.createDataFrame(list(enumerate([*urls, urls[0]])), "page_id bigint, url string")
    got = {x["page_id"]: x for x in url_filter.op4(pages).collect()}
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(2)).alias("half")).collect()
    blocked = {x["page_id"]: x["rule"] and x["verdict"] for x in got.values()}

    def fitted(rows):
        seen, total, types = collections.Counter(), collections.Counter(), collections.Counter()
        for u in rows:
            x = "\0" * url_filter.ORDER + u
            for i in range(url_filter.ORDER, len(x)):
                for k in range(url_filter.ORDER + 1):
                    seen[x[i - k : i + 1]] += 1
        for g, n in seen.items():
            total[g[:-1]] += n
            types[g[:-1]] += 1
        return seen, total, types

    def log_likelihood(model, u):
        seen, total, types = model
        x, out = "\0" * url_filter.ORDER + u, 0.0
        for i in range(url_filter.ORDER, len(x)):
            p = 1 / 256
            for k in range(url_filter.ORDER + 1):
                c = x[i - k : i]
                p = (seen[x[i - k : i + 1]] + types[c] * p) / (total[c] + types[c]) if total[c] else p
            out += np.log(max(p, 1e-12))
        return out

    ratio = {}
    for half in (0, 1):
        models = [fitted([x["url"] for x in base if x["half"] != half and (blocked[x["page_id"]] == "block") == y]) for y in (False, True)]
        for x in base:
            if x["half"] == half:
                ratio[x["page_id"]] = (log_likelihood(models[1], x["url"]) - log_likelihood(models[0], x["url"])) / max(1, len(x["url"]))
    assert {k: x["ratio"] for k, x in got.items()} == pytest.approx(ratio, abs=1e-6)
    # The threshold on a grid of the same bins, by brute force.
    width = 2 * url_filter.SPAN / (url_filter.BINS - 1)
    bins = {k: int((min(max(v, -url_filter.SPAN), url_filter.SPAN) + url_filter.SPAN) / width) for k, v in ratio.items()}
    share = lambda v, b, above: np.mean([(bins[k] >= b) == above for k in bins if blocked[k] == v])
    good = [share("block", b, True) + share("allow", b, False) for b in range(url_filter.BINS)]
    best = max(b for b, g in enumerate(good) if g >= max(good) - url_filter.TOLERANCE)
    for k, x in got.items():
        if not blocked[k] and abs(ratio[k] - (best * width - url_filter.SPAN)) > 1e-5:
            assert x["verdict"] == ("block" if ratio[k] >= best * width - url_filter.SPAN else "allow")
    assert got[0]["verdict"] == got[303]["verdict"]


def test_url_model_against_dicts(spark):
    good, bad = ["http://aa.de/x", "http://ab.de/xy"], ["http://zz.com/q", "http://zq.com/qq"]
    learning = spark.createDataFrame([(u, 0) for u in good] + [(u, 1) for u in bad], "url string, rejected int")
    model = url_filter.train(learning)

    def log_likelihood(urls, u):
        seen, total, types = collections.Counter(), collections.Counter(), collections.defaultdict(set)
        pad = "\0" * url_filter.ORDER
        for x in urls:
            for i in range(len(x)):
                for k in range(url_filter.ORDER + 1):
                    c = (pad + x)[url_filter.ORDER + i - k : url_filter.ORDER + i]
                    seen[c, x[i]] += 1
                    total[c] += 1
                    types[c].add(x[i])
        out = 0.0
        for i in range(len(u)):
            p = 1 / 256
            for k in range(url_filter.ORDER + 1):
                c = (pad + u)[url_filter.ORDER + i - k : url_filter.ORDER + i]
                if total[c]:
                    p = (seen[c, u[i]] + len(types[c]) * p) / (total[c] + len(types[c]))
            out += np.log(max(p, 1e-12))
        return out

    for u in ("http://aq.de/z", "http://zz.com/x"):
        expected = (log_likelihood(bad, u) - log_likelihood(good, u)) / len(u)
        assert model.log_ratios([u])[0] == pytest.approx(expected, rel=1e-3)


def test_url_model_of_many_contexts(spark):
    r = random.Random(6)
    host = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    classes = [[f"http://{host(60)}.de/" for _ in range(6000)], [f"http://{host(60)}.com/" for _ in range(6000)]]
    model = url_filter.train(spark.createDataFrame([(u, c) for c in (0, 1) for u in classes[c]], "url string, rejected int"))
    logs, asked = [], [classes[0][0], classes[1][0], f"http://{host(60)}.com/"]
    for urls in classes:
        seen, total, types = collections.Counter(), collections.Counter(), collections.Counter()
        for x in (url_filter.ORDER * "\0" + u for u in urls):
            for i in range(url_filter.ORDER, len(x)):
                for k in range(url_filter.ORDER + 1):
                    seen[x[i - k : i + 1]] += 1
        for g, n in seen.items():
            total[g[:-1]] += n
            types[g[:-1]] += 1
        logs.append([])
        for x in (url_filter.ORDER * "\0" + u for u in asked):
            logs[-1].append(0.0)
            for i in range(url_filter.ORDER, len(x)):
                p = 1 / 256
                for k in range(url_filter.ORDER + 1):
                    c = x[i - k : i]
                    p = (seen[x[i - k : i + 1]] + types[c] * p) / (total[c] + types[c]) if total[c] else p
                logs[-1][-1] += np.log(p)
    expected = [(b - a) / len(u) for a, b, u in zip(*logs, asked)]
    assert model.log_ratios(asked) == pytest.approx(expected, rel=1e-3, abs=1e-6)


def test_license_scan(spark):
    files = spark.createDataFrame(
        [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "plain words only"), ("a/d/COPYING", "Licensed under the Apache License, Version 2.0."), ("a/d/e/f.py", "nothing here"), ("a/d/own.py", "code\nLicensed under CC BY-NC 4.0.\ncode"), ("z.py", "none"), (None, None), ("q/r.py", "")],
        "path string, text string",
    ).withColumn("licence", F.lit(1))
    out = {r["path"]: (r["_licence"], r["_via"], r["_from"]) for r in license_scan.scan(files).collect()}
    assert out == {"a/LICENSE": ("MIT", "own", None), "a/b/c/x.py": ("MIT", "inherited", "a"), "a/d/COPYING": ("Apache-2.0", "own", None), "a/d/e/f.py": ("Apache-2.0", "inherited", "a/d"), "a/d/own.py": ("CC-BY-NC-4.0", "own", None), "z.py": (None, None, None), None: (None, None, None), "q/r.py": (None, None, None)}


def test_wrapped_headers_and_versions(spark):
    head = "// This program is free software%s you can redistribute it and/or\n// modify it under the terms of the GNU %s as\n// published by the Free Software Foundation%s either version %s\n// of the License, or (at your option) any later version.\n"
    r = random.Random(8)
    code = lambda: "\n".join(prose(r, 9) for _ in range(60))
    texts = [code() + "\n" + head % (";", g, ";", v) + code() for g, v in (("General Public License", "2"), ("General Public License", "3"), ("Lesser General Public License", "2.1"), ("Affero General Public License", "3"))]
    rows = license_scan.own_licences(docs_of(spark, [*texts, code()]).select("doc_id", "text")).collect()
    assert [x["_own"] and x["_own"]["licence"] for x in sorted(rows, key=lambda x: x["doc_id"])] == ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0", None]


def test_only_notices_lend(spark):
    r = random.Random(3)
    texts = ["Released under the MIT License.", prose(r, 300) + "\nLicensed under CC BY 4.0.\n" + prose(r, 50), prose(r, 40), prose(r, 40), None]
    docs = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id").isin(0, 2), "a").otherwise("b"))
    out = {x["doc_id"]: (x["own_licence"], x["licence"], x["via"], x["inherited_from"]) for x in license_scan.op6(docs).collect()}
    assert out == {0: ("MIT", "MIT", "own", None), 1: ("CC-BY-4.0", "CC-BY-4.0", "own", None), 2: (None, "MIT", "inherited", "a"), 3: (None, None, None, None), 4: (None, None, None, None)}


def test_long_licence_texts_by_chunks(monkeypatch):
    import tracemalloc

    r = random.Random(4)
    known = license_scan.Templates(license_scan.TEMPLATES)
    known.weigh(np.arange(len(known.terms)) % 50, 10_000)
    head = license_scan.TEMPLATES[5][1].split()
    for k in range(6):
        # A notice wrapped over lines that chunks of two lines cut everywhere.
        lines = [prose(r, 8) for _ in range(k)] + [" ".join(head[i : i + 5]) for i in range(0, len(head), 5)] + ["the end of the license", ""]
        lists = [common.words_of(x) for x in lines]
        monkeypatch.setattr(license_scan, "CHUNK_LINES", 1024)
        whole = known.best(lists, {})
        for size in (1, 2, 7):
            monkeypatch.setattr(license_scan, "CHUNK_LINES", size)
            assert known.best(lists, {}) == pytest.approx(whole, abs=1e-12) and license_scan.TEMPLATES[5][0] == known.names[whole[0]]
    monkeypatch.setattr(license_scan, "CHUNK_LINES", 1024)
    lists = [common.words_of("the end of some work or other")] * 200_000 + [common.words_of(x) for x in lines]
    tracemalloc.start()
    assert known.best(lists, {})[0] == 5 and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_inheritance_against_climbing(spark):
    r = random.Random(9)
    folders = ["", "a", "b", *("/".join(r.choice("abc") for _ in range(r.randint(2, 5))) for _ in range(60))]
    say = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY 4.0."]
    files = {"LICENSE": say[2]} if r.random() < 0.5 else {}
    for _ in range(300):
        folder, name = r.choice(folders), r.choice(["LICENSE", "COPYING.txt", "x.py", "y.py", "z.md"])
        files[f"{folder}/{name}".lstrip("/")] = r.choice(say) if r.random() < 0.15 else "plain words only"
    out = {x["path"]: (x["_licence"], x["_via"], x["_from"]) for x in license_scan.scan(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    own = {p: x[0] for p, x in out.items() if x[1] == "own"}
    assert set(own) == {p for p, t in files.items() if t in say}
    lent = {}
    # Of equal scores the least path lends.
    scores = {p: x["_own"]["score"] for x in license_scan.own_licences(spark.createDataFrame(list(files.items()), "path string, text string")).collect() for p in (x["path"],) if x["_own"]}
    for p in sorted(own, key=lambda p: (-scores[p], p)):
        folder, _, name = p.rpartition("/")
        if name in ("LICENSE", "COPYING.txt"):
            lent.setdefault(folder, own[p])
    for p in files:
        if p in own:
            continue
        at = p.rpartition("/")[0]
        while at and at not in lent:
            at = at.rpartition("/")[0]
        assert out[p] == ((lent[at], "inherited", at) if at in lent else (None, None, None))


def test_license_cosine_against_dicts(spark):
    r = random.Random(5)
    texts = ["Released under the MIT License.", "the end of the line\nunder water", "", None, "Licensed under the Apache License"]
    for k in range(40):
        lines = [" ".join(r.choice("the of under license mit apache licensed version released work".split() + prose(r, 6).split()) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 5))]
        words = license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)][1].split()
        cut_at = r.randrange(len(words))
        texts.append("\n".join([*lines, " ".join(words[:cut_at]), " ".join(words[cut_at:]) + " " + prose(r, r.randint(0, 3))]))
    rows = license_scan.own_licences(docs_of(spark, texts).select("doc_id", "text")).collect()
    lines = [[w.decode() for w in common.words_of(x)] for t in texts for x in (t or "").split("\n")]
    templates = [[w.decode() for w in common.words_of(t)] for _, t in license_scan.TEMPLATES]
    df = collections.Counter(w for x in lines for w in set(x))
    idf = lambda w: np.log((1 + len(lines)) / (1 + df[w])) + 1
    vec = lambda ws: {w: n * idf(w) for w, n in collections.Counter(ws).items()}

    def cosine(a, b):
        a, b = vec(a), vec(b)
        top = sum(v * b.get(w, 0) for w, v in a.items())
        return top / (np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) or 1)

    for r in rows:
        parts = [[w.decode() for w in common.words_of(x)] for x in (r["text"] or "").split("\n")]
        units = [*parts, [w for p in parts for w in p]] + [[w for p in parts[i:j] for w in p] for i in range(len(parts)) for j in range(i + 2, len(parts) + 1)]
        best = max(cosine(u, t) for u in units for t in templates)
        assert (r["_own"] is None) == (best < license_scan.THRESHOLD)
        if r["_own"]:
            assert r["_own"]["score"] == pytest.approx(best, abs=1e-9) and r["_own"]["whole"] == pytest.approx(max(cosine(units[len(parts)], t) for t in templates), abs=1e-9)
    assert sum(r["_own"] is not None for r in rows) > 5


def test_toxicity_counts_and_held_out(spark):
    r = random.Random(6)
    words = [prose(r, 1) for _ in range(300)]
    texts, toxic = [], []
    for k in range(1500):
        w = [r.choice(words) for _ in range(r.randint(20, 60))]
        bad = k % 5 == 0
        if bad:
            for b in ("vile", "rotten"):
                w.insert(r.randrange(len(w)), b)
        texts.append(" ".join(w))
        toxic.append(int(bad))
    texts += [None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)] + [(9_999, 1, None)], "doc_id bigint, quality int, toxic int")
    out = {x["doc_id"]: x for x in toxicity.op7(docs, labels).collect()}
    assert len(out) == len(texts) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in out.values())
    assert all(x["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, x in out.items())
    held = [d for d in range(1500) if out[d]["held_out"]]
    assert np.mean([out[d]["predicted"] == toxic[d] for d in held]) > 0.97
    assert {d for d in out} == {x["doc_id"] for x in toxicity.op7(docs.withColumn("source", F.lit("other")), labels).collect() if abs(x["score"] - out[x["doc_id"]]["score"]) < 1e-12}
    one = toxicity.op7(docs.limit(30), labels.where("toxic = 0")).select("score").distinct().collect()
    assert len(one) == 1 and one[0]["score"] < 0.5


def test_kneser_ney_against_dicts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "DISCOUNT", 0.25)
    monkeypatch.setattr(toxicity, "PAIR_DISCOUNTS", (0.75,))
    r = random.Random(11)
    texts = [(" ".join(r.choice("a b c d e f the vile".split()[: 8 if y else 7]) for _ in range(60)), k % 2, y) for y in (0, 1) for k in range(12)]
    counts = toxicity.continuation_counts(spark.createDataFrame(texts + texts[:2], "text string, half int, label int"))
    triples = [[set(), set()], [set(), set()]]
    for t, half, y in texts:
        w = ["", "", *t.split()]
        triples[y][half] |= {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    # Each half counts for itself.
    pair = [sum((collections.Counter(x[1:] for x in s) for s in halves), collections.Counter()) for halves in triples]
    word = [sum((collections.Counter(w for _, w in {x[1:] for x in s}) for s in halves), collections.Counter()) for halves in triples]
    before = [collections.Counter() for _ in pair]
    for c, b in zip(pair, before):
        for (v, _), n in c.items():
            b[v] += n
    total = [sum(c.values()) for c in word]
    rate = lambda y, w: max(word[y][w] / total[y] - 0.5 / min(total), 0)
    vocabulary = set(word[0]) | set(word[1])
    freed = 1 - sum(rate(y, w) for y in (0, 1) for w in vocabulary) / 2
    p = lambda y, w: rate(y, w) + freed * (word[0][w] + word[1][w] + 0.5) / (sum(total) + 0.5 * len(vocabulary))

    def ratio(v, w):
        least = min(before[0][v], before[1][v])
        kept = lambda y, x: max(pair[y][v, x] / before[y][v] - 1.5 / least, 0) if least else 0.0
        b = 1 - sum(kept(y, x) for y in (0, 1) for x in vocabulary) / 2
        return np.log(kept(1, w) + b * p(1, w)) - np.log(kept(0, w) + b * p(0, w))

    known = toxicity.Ratios(toxicity._split(toxicity.log_ratios(counts, (0, 1), 0.75))[0])
    for t, _, _ in texts[::5]:
        w = t.split()
        expected = [ratio(v, x) for v, x in zip(["", *w], w)]
        got = toxicity.statistics(toxicity._hashed(t, toxicity._Hashes()), [known])
        assert got[toxicity.STRETCHES.index(0)] == pytest.approx(np.mean(expected)) and got[0] == pytest.approx(max(expected))


def test_rare_ratios_are_joined(spark, monkeypatch):
    r = random.Random(6)
    words = [prose(r, 1) for _ in range(60)]
    texts = [" ".join([*(r.choice(words) for _ in range(30)), "vile" if k % 4 == 0 else "fine"]) for k in range(400)]
    docs, labels = docs_of(spark, [*texts, "", None]), spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id bigint, quality int, toxic int")
    whole = {x["doc_id"]: x["score"] for x in toxicity.op7(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 2)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 2)
    few = {x["doc_id"]: x["score"] for x in toxicity.op7(docs, labels).collect()}
    assert few == pytest.approx(whole) and whole[0] > 0.7 > whole[1]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


@pytest.mark.parametrize("recall", [1.0, embedding_dedup.RECALL])
def test_embedding_dedup(spark, recall):
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16))
    rows = [(k, [float(v) for v in centres[k % 40] + r.normal(scale=0.12, size=16)], int(k % 3)) for k in range(600)]
    rows += [(600, rows[0][1], 0), (601, None, 0), (602, [0.0] * 16, 0), (603, [float("nan")] * 16, 0), (604, rows[0][1], None), (605, rows[0][1][:8], 0), (606, [], 1), (600, rows[0][1], 0)]
    out = embedding_dedup.near_duplicates(vectors_of(spark, rows), recall=recall).collect()
    links, parent = collections.Counter(), {k: k for k, _, _ in rows}
    place = list(range(len(rows)))
    ok = [label is not None and v and len(v) == 16 and np.isfinite(v).all() and np.any(v) for _, v, label in rows]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    x = np.array([np.array(v, np.float32).astype(float) if good else np.ones(16) for (_, v, _), good in zip(rows, ok)])
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    s = x @ x.T
    for a, b in itertools.combinations(place, 2):
        if ok[a] and ok[b] and rows[a][2] == rows[b][2] and s[a, b] >= 0.93:
            links[a] += 1
            links[b] += 1
            p, q = find(rows[a][0]), find(rows[b][0])
            parent[max(p, q)] = min(p, q)
    expected = collections.Counter((k, links[n]) for n, (k, _, _) in enumerate(rows))
    got = collections.Counter((o["vec_id"], o["n_links"]) for o in out)
    total = sum(links.values())
    assert total > 500 and sum(o["n_links"] for o in out) >= 0.99 * total
    if recall == 1.0:
        assert got == expected and all(o["component_id"] == find(o["vec_id"]) for o in out)


def test_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    monkeypatch.setattr(embedding_dedup, "QUERY_BLOCK", 5)
    r = np.random.default_rng(2)
    rows = [(k, [float(v) for v in 1 + r.normal(scale=0.01, size=8)], 1) for k in range(60)]
    out = embedding_dedup.near_duplicates(vectors_of(spark, rows), recall=1.0).collect()
    assert all(o["n_links"] == 59 and o["component_id"] == 0 for o in out)


def test_no_links_of_small_groups_are_lost(spark):
    r = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    group = unit(r.normal(size=32)) + r.normal(scale=0.002, size=(600, 32))
    ones = unit(r.normal(size=(1200, 32)))
    aside = r.normal(size=(1200, 32))
    aside = unit(aside - (aside * ones).sum(axis=1, keepdims=True) * ones)
    twins = 0.94 * ones + (1 - 0.94**2) ** 0.5 * aside
    x = unit(np.concatenate([group, ones, twins]).astype(np.float32).astype(float))
    near = x @ x.T >= 0.93
    out = {o["vec_id"]: o for o in embedding_dedup.near_duplicates(vectors_of(spark, [(k, [float(v) for v in row], 1) for k, row in enumerate(x)])).collect()}
    assert [out[k]["n_links"] for k in range(len(x))] == (near.sum(axis=1) - 1).tolist()
    assert all(out[600 + k]["component_id"] == out[1800 + k]["component_id"] for k in range(1200))


def test_cells_left_out_hold_no_link():
    r = np.random.default_rng(4)
    x = np.repeat(r.normal(size=(60, 16)), 30, axis=0) + r.normal(scale=0.1, size=(1800, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = (embedding_dedup.kmeans(x[:, :8], 24), embedding_dedup.kmeans(x[:, 8:], 24))
    cell = embedding_dedup.cells(x, books)
    d = embedding_dedup.distances(x, books, cell)
    bounds, occupied = embedding_dedup.bounds_of(books, cell, np.stack([d[0], d[0], d[1], d[1]], axis=1))
    found = [set(v.tolist()) for v in embedding_dedup.visits(x, bounds, occupied, 0.93)]
    assert sum(map(len, found)) < len(x) * occupied.sum() / 2
    assert all(cell[j] in found[i] for i, j in zip(*np.nonzero(x @ x.T >= 0.93)))


def test_traversal_goes_by_distance():
    r = np.random.default_rng(6)
    for n, m, reach in ((1, 1, 0.5), (7, 5, 0.9), (40, 60, 1.1), (30, 30, 0.0)):
        a, b = np.sort(r.random(n).round(2)), np.sort(r.random(m).round(2))
        found = list(embedding_dedup.traverse(a.tolist(), b.tolist(), reach))
        sums = [a[i] + b[j] for i, j in found]
        assert sums == sorted(sums) and len(set(found)) == len(found)
        assert set(found) == {(i, j) for i in range(n) for j in range(m) if a[i] + b[j] <= reach}


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    out = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(out[k] == 0 for k in range(1, 31)) and all(out[k] == 100 for k in range(101, 140))


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = common.table(spark, SF, "documents")
    before, kept = docs, {}
    for k, (name, stage) in enumerate(C.STAGES):
        after = common.cut(stage(spark, before, SF))
        if k < 4:
            assert after.columns == docs.columns
        kept[name], before = after, after
    names = [n for n, _ in C.STAGES]
    assert kept[names[1]].count() == kept[names[0]].count() and kept[names[2]].count() < kept[names[1]].count()
    out = before.collect()
    assert len(out) == kept[names[3]].count() and all(r["round_trip"] for r in out)
    assert sorted(r["doc_id"] for r in C.run(spark, SF).select("doc_id").collect()) == sorted(r["doc_id"] for r in out)


CLASHING = ["_text_key", "_drop", "_drop_id", "_n_removed", "_own", "_dir", "near", "_near", "_licence", "ids", "decoded", "_barsight_key", "_tk", "_salt", "_hot", "tk", "c", "n", "fp", "x", "_c0", "label", "half", "score", "segment", "place", "id", "node", "rule", "host"]


def test_clashing_names(spark):
    texts = ["a b\nc d\ne f", "a b\nc d\ne f", "Released under the MIT License.", None, "", prose(random.Random(1), 60)]
    docs = docs_of(spark, texts).select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHING])
    plain = docs_of(spark, texts)
    labels = spark.createDataFrame([(0, 1, 0), (5, 1, 1)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")

    def same(got, expected, renamed=()):
        """The extra columns are as they were, the others as without them."""
        rows, other = ({r["doc_id"]: r.asDict() for r in df.collect()} for df in (got, expected))
        assert rows.keys() == other.keys()
        for k, r in rows.items():
            assert all(r[c] == f"{c}{k}" for c in CLASHING)
            assert all(r[dict(renamed).get(c, c)] == v for c, v in other[k].items())

    same(line_dedup.line_dedup(docs), line_dedup.line_dedup(plain), [("_n_removed", "_n_removed_")])
    same(jaccard_join.keep_one(docs), jaccard_join.keep_one(plain))
    same(decontamination.decontaminate(docs, bench), decontamination.decontaminate(plain, bench))
    same(toxicity.drop_toxic(docs, labels), toxicity.drop_toxic(plain, labels))
    same(sentencepiece.encode_decode(docs), sentencepiece.encode_decode(plain), [("ids", "ids_"), ("decoded", "decoded_")])
    path = F.concat(F.lit("a/"), F.col("doc_id"))
    same(license_scan.scan(docs.withColumn("path", path)), license_scan.scan(plain.withColumn("path", path)), [("_own", "_own_"), ("_licence", "_licence_")])
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "<p>x")], "page_id bigint, url string, html string")
    more = pages.select("*", *[F.lit(1).alias(c) for c in CLASHING])
    assert url_filter.op4(more).collect() == url_filter.op4(pages).collect() and warc.op3(more).collect() == warc.op3(pages).collect()
    for op, *rest in ((line_dedup.op1,), (sentencepiece.op2,), (substring_dedup.op5,), (license_scan.op6,), (toxicity.op7, labels), (decontamination.op8, bench), (jaccard_join.op9,)):
        assert sorted(map(str, op(docs, *rest).collect())) == sorted(map(str, op(plain, *rest).collect()))


def test_repeated_rows_agree(spark):
    text = "\n".join(prose(random.Random(k), 20) for k in range(12))
    docs = docs_of(spark, [text, text, "Licensed under CC BY 4.0.", "Licensed under CC BY 4.0."], [4, 4, 7, 7])
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (7, 1, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, text), (1, text), (None, text)], "item_id bigint, text string")
    for out in (license_scan.op6(docs), toxicity.op7(docs, labels), sentencepiece.op2(docs), substring_dedup.op5(docs), decontamination.op8(docs, bench)):
        rows = [str(r) for r in out.collect()]
        assert len(rows) == 4 and len(set(rows)) == 2
    assert {r["doc_id"]: (r["n_items"], r["items"]) for r in decontamination.contamination(docs, bench).collect()} == {4: (2, ["1"]), 7: (0, [])}
    assert {r["n_removed"] for r in substring_dedup.op5(docs).where("doc_id = 4").collect()} == {len(text)}
    pages = spark.createDataFrame([(1, "http://a.com/en/1", "<p>x")] * 2, "page_id bigint, url string, html string")
    assert len({str(r) for r in url_filter.op4(pages).collect()}) == 1 and len({str(r) for r in warc.op3(pages).collect()}) == 2


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as C

    copy = "\n".join(prose(random.Random(k), 20) for k in range(12))
    texts = [None, "", copy, copy, copy + "\nend", prose(random.Random(50), 30_000), "one line"]
    docs = docs_of(spark, [*texts, texts[0], "one line"], [*range(len(texts)), 0, 6]).withColumn("_text_key", F.lit("kept"))
    labels = spark.createDataFrame([(2, 1, None)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    before = docs
    for k, (_, stage) in enumerate(C.STAGES):
        after = common.cut(stage(spark, before, str(tmp_path)))
        assert k == 4 or after.columns == docs.columns
        before = after
    got = collections.Counter(r["doc_id"] for r in before.collect())
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert C.run(spark, str(tmp_path)).count() == 0


def test_sha_of_no_items():
    assert decontamination.items_digest([]) == hashlib.sha256(b"").hexdigest()
