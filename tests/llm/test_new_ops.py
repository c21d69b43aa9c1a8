"""Operators 11 to 13 against plain versions."""

import glob
import hashlib
import math
import os
import random
import time
import uuid
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsight.llm import embedding_dedup as E
from barsight.llm import filter_audit as A
from barsight.llm import prefix_trie as P
from barsight.llm import sentencepiece as T
from barsight.llm import streaming_dedup as S
from barsight.llm.common import scratch_dir

DOCS = "doc_id bigint, text string, lang string, digest string, file string, _metadata string, n bigint"


def written(spark, df, parts=1):
    path = f"{scratch_dir(spark)}/in-{uuid.uuid4().hex}"
    df.repartition(parts).write.parquet(path)
    return path


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 7) for r in rows], DOCS)


ROWS = [(1, "a", "en"), (2, "b", "en"), (3, "a", None), (4, None, "de"), (5, "", "de"), (6, "c" * 300_000, "en"), (7, "c" * 300_000, "en"), (8, "c" * 299_999 + "d", "en"), (None, "a", "en"), (None, "only", ""), (3, "a", None), (9, "B", "en")]


def plain_dedup(rows):
    groups = defaultdict(list)
    for doc, text, _ in rows:
        groups[text or ""].append(doc)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = 1
        for i in sorted(ids, key=lambda i: (i is None, i)):
            kept = i == keep and left == 1
            left -= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("digest", [S.sha256, lambda t: F.unhex(F.hex(F.length(t) % 3)), lambda t: F.unhex(F.lit("00"))], ids=["sha256", "collisions", "one digest"])
def test_dedup_matches_brute_force(spark, digest):
    path = written(spark, docs(spark, ROWS), 3)
    out = S.deduplicate(spark, path, digest=digest)
    found = Counter(tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert found == plain_dedup(ROWS)


def test_small_states_take_little_disk(spark):
    # Of many small stores each set aside 4 MB for its manifest.
    before, start = {k: spark.conf.get(k, None) for k in S.STATE}, time.time()
    path = written(spark, docs(spark, ROWS))
    assert S.deduplicate(spark, path).count() == len(ROWS)
    local = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS", "/tmp").split(",")[0]
    found = [os.stat(f) for f in glob.glob(f"{local}/**/StateStoreId*/**/MANIFEST-*", recursive=True)]
    sizes = [f.st_blocks * 512 for f in found if f.st_mtime >= start - 1]
    assert sizes and max(sizes) < 100_000
    assert {k: spark.conf.get(k, None) for k in S.STATE} == before


def test_dedup_goes_on_from_retained_state(spark):
    """Files that come later meet the state of those before; small batches give what one batch gives."""
    path, own = written(spark, docs(spark, ROWS[:5]), 2), f"{scratch_dir(spark)}/own-{uuid.uuid4().hex}"
    first = S.deduplicate(spark, path, own)
    assert Counter(tuple(r)[:5] for r in first.collect()) == plain_dedup(ROWS[:5])
    docs(spark, ROWS[5:]).repartition(3).write.mode("append").parquet(path)
    then = S.deduplicate(spark, path, own, batch=1)
    assert Counter(tuple(r)[:5] for r in then.collect()) == plain_dedup(ROWS)
    kept = spark.read.format("statestore").load(own)
    assert kept.count() == len({t or "" for _, t, _ in ROWS})
    # The state is RocksDB's.
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{own}/state/0/0")
    names = [f.getPath().getName() for f in fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs)]
    assert any(n.endswith((".zip", ".changelog")) for n in names)


def test_dedup_of_an_empty_table(spark):
    path = written(spark, docs(spark, ROWS).limit(0))
    out = S.op11(spark, path)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


LABELS = [(1, 1, 0), (1, 0, 1), (2, 1, 0), (3, None, 1), (7, 1, 1), (None, 1, 1)]
TEXTS = ["", "one two", "Caps ARE HERE", "cost $5 & more", " ".join(f"w{i}" for i in range(120)), " ".join(["again"] * 150), " ".join(f"w{i}" for i in range(99)), "A" * 11 + "b" * 89, "A" * 10 + "b" * 90, "é" * 100 + "A" * 11, "x\x1cy\x85z w " * 40, "a\tb\nc\vd\fe\rf " * 20]
AUDIT = [(i, TEXTS[i % len(TEXTS)], ("en", "de", None, "")[i % 4]) for i in range(60)] + [(3, TEXTS[3], "de"), (3, TEXTS[3], "de"), (None, TEXTS[3], "en"), (None, None, None), (61, None, "en"), (-5, TEXTS[0], "fr")]


def plain_audit(rows, labels):
    good, bad = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = defaultdict(list)
    for d, t, lang in rows:
        t, fails = t or "", set()
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if d is not None and least[t] < d else set()
        parts[lang or ""].append((fails, d in good, d in bad))
    out = []
    for part, found in parts.items():
        rows, shapley = [], Counter()
        for p in permutations("ABCDE"):
            left = found
            for step, f in enumerate(p, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                rows.append((f, ("".join(p), step, len(left), len(gone), sum(f in x[0] for x in found) - len(gone), sum(x[0] == {f} for x in found), sum(x[1] for x in gone), sum(x[2] for x in gone))))
        out += [(part, *r, shapley[f]) for f, r in rows]
    return sorted(out)


def audited(spark, rows, labels, fingerprint, held, parts):
    frame = docs(spark, rows).repartition(parts)
    failed = A.failing(frame, fingerprint, held)
    counts = A.mask_counts(failed, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    return sorted(x for part in counts.collect() for x in A.steps(*part))


@pytest.mark.parametrize("fingerprint,held", [(A.xxhash.xxh3_64_intdigest, A.HELD), (lambda t: len(t) % 3, 1), (lambda t: 5, 400)], ids=["xxhash", "collisions, flushed", "one chain"])
def test_audit_matches_brute_force(spark, fingerprint, held):
    assert audited(spark, AUDIT, LABELS, fingerprint, held, 3) == plain_audit(AUDIT, LABELS)


def test_audit_result(spark):
    out = A.audit(docs(spark, AUDIT), spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").withColumn("mask", F.lit("x")).withColumn("n", F.lit("y")))
    assert sorted(tuple(r) for r in out.collect()) == plain_audit(AUDIT, LABELS)
    empty = A.audit(docs(spark, AUDIT).limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert empty.count() == 0 and len(empty.columns) == 10


def plain_trie(convs):
    """RESULT rows from (conv_id, [(text, words), ...])."""
    nodes = defaultdict(list)
    for c, turns in convs:
        for d in range(len(turns) + 1):
            nodes[tuple(t for t, _ in turns[:d])].append((c, len(turns) == d, turns[d - 1][1] if d else 0))
    children, leaves, saved = Counter(k[:-1] for k in nodes if k), Counter(), Counter()
    for k, found in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(found) - 1) * found[0][2]
    least = {k: min(c for c, _, _ in found) for k, found in nodes.items()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((least[k], len(k), least[k[:-1]] if k else None, len(f), children[k], leaves[k], saved[k], sha([c for c, e, _ in f if e])) for k, f in nodes.items()), key=repr)


def plain_rebuilt(rows):
    """Conversations of (conv_id, turn, role, text) as op13 rebuilds them."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    own = {c: [(r.decode(), t.decode()) for _, r, t in sorted(x)] for c, x in own.items()}
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out.append((c, own.get(c - c % 20, [])[:h] + turns[h:]))
    return [(c, [(t, len(t[1].encode().split())) for t in turns]) for c, turns in out]


def as_turns(spark, convs):
    rows = [(c, [(k, hashlib.sha256(t.encode()).hexdigest()[:32], w) for k, (t, w) in enumerate(turns)]) for c, turns in convs]
    return spark.createDataFrame(rows, "conv_id bigint, turns array<struct<place: int, digest: string, tokens: bigint>>")


@pytest.fixture
def many_blocks(spark):
    """As many blocks as partitions, so that nodes reach over borders."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(3))
def test_trie_matches_brute_force(spark, many_blocks, seed):
    draw = random.Random(seed)
    letters, longest = [("ab", 6), ("abcdefgh", 4), ("a", 40)][seed]
    convs = [(c * 3 - 20, [(x, ord(x) - 90) for x in draw.choices(letters, k=draw.randrange(longest))]) for c in range(150)]
    assert sorted(map(tuple, P.trie(as_turns(spark, convs)).select(*P.RESULT).collect()), key=repr) == plain_trie(convs)


@pytest.mark.parametrize("convs", [[(5, [])], [(5, []), (6, [])], [(7, [("a", 3)]), (2, [("a", 3)]), (3, [("a", 3), ("b", 0)])], [(1, [("a", 1), ("b", 2), ("c", 3)])]], ids=["turnless", "two turnless", "prefix", "one"])
def test_trie_of_few(spark, convs):
    assert sorted(map(tuple, P.trie(as_turns(spark, convs)).select(*P.RESULT).collect()), key=repr) == plain_trie(convs)


def test_trie_of_conversations(spark, many_blocks):
    """Rebuilt conversations with null turns, roles, texts and ids, ties, repeated rows, absent and short first conversations."""
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "x", None]), draw.choice(["a b", "a  b", "", None, "c\td\x0be", "é" * 50])) for c in [*range(43), 60, 61, 62, 63, 100, 201, 2**40, 2**40 + 1] for t in range(draw.randrange(1, 6))]
    rows += [(3, None, "user", "late"), (3, None, None, None), (3, 1, "user", "a b"), (3, 1, "user", "a b"), (None, 0, "user", "lost"), (20, 0, "x", "z" * 200_000)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, block int, place int, digest int").repartition(3)
    found = P.op13(frame)
    assert sorted(map(tuple, found.select(*P.RESULT).collect()), key=repr) == plain_trie(plain_rebuilt(rows))
    assert P.op13(frame.limit(0)).count() == 0


def test_ids_of_one_conversation_travel_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 7)
    convs = [(c, [("same", 2)] * 2) for c in range(50)]
    assert sorted(map(tuple, P.trie(as_turns(spark, convs)).select(*P.RESULT).collect()), key=repr) == plain_trie(convs)


def test_embedding_chains_stay_whole(spark, monkeypatch):
    # Cosines 0.9397 from one to the next, 0.766 beyond; nodes are digests, so chains meet them in any order.
    r = random.Random(5)
    ids = list(range(480))
    r.shuffle(ids)
    rows = [(ids[12 * c + k], [math.cos(k * math.pi / 9 + c), math.sin(k * math.pi / 9 + c)], c) for c in range(40) for k in range(12)]
    want = {ids[12 * c + k]: (1 if k in (0, 11) else 2, min(ids[12 * c : 12 * c + 12])) for c in range(40) for k in range(12)}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    for block in (4096, 3):
        monkeypatch.setattr(E, "BLOCK", block)
        assert {o["vec_id"]: (o["n_links"], o["component_id"]) for o in E.op10(df).collect()} == want


def test_embedding_links_at_the_threshold(spark):
    # Whole numbers with a cosine of 93 / 100 exactly, which products of rounded unit vectors miss.
    pairs = [([-66, -88, 88, 66, -110, -110], [-27, -27, 54, 9, -27, -54]), ([-84, -112, 112, 84, -140, -140], [-2, -6, 1, 3, -5, -5]), ([-36, -48, 48, 36, -60, -60], [-15, -45, 90, 45, -45, -90])]
    assert all(100 * np.dot(a, b) == 93 * math.isqrt(np.dot(a, a)) * math.isqrt(np.dot(b, b)) for a, b in pairs)
    rows = [(2 * c + side, [float(v) for v in pair[side]], c) for c, pair in enumerate(pairs) for side in (0, 1)]
    out = E.op10(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert len(out) == 2 * len(pairs) and all(o["n_links"] == 1 and o["component_id"] == o["vec_id"] // 2 * 2 for o in out)


def test_embedding_odd_sizes(spark):
    rows = [(0, [3e200, 4e200]), (1, [3e-200, 4e-200]), (2, [3.0, 4.0]), (3, [-3e-200, 4e-200]), (4, [5.0]), (5, [7.0]), (6, [-1.0]), (7, [0.0, 0.0])]
    out = E.op10(spark.createDataFrame([(*x, 1) for x in rows], "vec_id bigint, embedding array<double>, label int")).collect()
    assert {o["vec_id"]: (o["n_links"], o["component_id"]) for o in out} == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_arcs_are_the_compiled_pieces():
    # Arcs are the compiled strings themselves, whose hashes are kept, not slices of the text that every look-up hashes anew.
    t = T.transducer(T.MODEL)
    text = "▁Internationalisation▁of▁the▁übermäßig▁日本語▁▁▁tests\n▁1234567"
    for i in range(len(text)):
        arcs = t.arcs(text, i)
        assert arcs == [text[i], *(text[i:j] for j in range(i + 2, len(text) + 1) if text[i:j] in t.reached)]
        assert all(t.arcs(text, i)[k] is arcs[k] for k in range(1, len(arcs)))
