"""Joins, near duplicates, archives, decontamination, toxicity and the pipeline, against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, embedding_dedup, jaccard, shared, toxicity, warc


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(5)
    links = [
        (r.randrange(400), r.randrange(400)) for _ in range(260)
    ] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["component"] for x in shared.components(spark.createDataFrame(links, "a long, b long").repartition(9)).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = closure({n for p in real for n in p}, real)
    assert got == want
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())


def brute_groups(rows, k, percent):
    s = {i: sets_of(t, k) for i, t in rows}
    ids = sorted(s)
    links = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])
    ]
    return {i: (len(s[i]), c) for i, c in closure(ids, links).items()}


def near_texts(n, seed):
    """Originals of many sizes with copies that differ by some words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    out = []
    while len(out) < n:
        base = [word() for _ in range(r.choice((1, 3, 5, 8, 12, 20, 40, 90, 200)))]
        for _ in range(r.choice((1, 1, 2, 5, 9))):
            t = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
                i = r.randrange(len(t) + 1)
                t[i : i + r.choice((0, 1))] = [word()] * r.choice((0, 1))
            out.append(" ".join(t))
    return list(enumerate(out[:n]))


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 70, 3), (2, 90, 4)])
def test_join_against_brute_force(spark, k, percent, seed):
    rows = near_texts(500, seed)
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_groups(
            spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k, percent
        ).collect()
    }
    assert got == brute_groups(rows, k, percent)


def test_join_in_blocks(spark, monkeypatch):
    """Clusters over the limit give the same components, by blocks with leaders and by pairs of blocks."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(w if r.random() > 0.01 * (i % 5) else f"z{r.randrange(999)}" for w in base)) for i in range(160)]
    monkeypatch.setattr(jaccard, "CLUSTER_BYTES", 20_000)
    for leaders in (32, 1):
        monkeypatch.setattr(jaccard, "LEADERS", leaders)
        got = {
            x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.join_groups(
                spark.createDataFrame(rows, "doc_id long, text string")
            ).collect()
        }
        assert got == brute_groups(rows, 4, 85)


def test_signatures_guarantee_every_pair():
    """Two sets at the threshold always share a signature that one of them probes."""
    r = np.random.default_rng(3)
    for _ in range(300):
        percent = int(r.choice([70, 80, 85, 95]))
        n = int(r.choice([2, 5, 7, 9, 14, 30, 80, 300]))
        pool = np.unique(r.integers(0, 2**63, 3 * n + 10).astype(np.uint64) * np.uint64(2))
        a = pool[:n]
        drop, add = int(r.integers(0, n)), int(r.integers(0, n))
        b = np.sort(np.concatenate([a[drop:], pool[n : n + add]]))
        if not len(b):
            continue
        inter = n - drop
        if 100 * inter < percent * (n + add):
            continue
        (ka, ta), (kb, tb) = jaccard.signatures(np.sort(a), percent), jaccard.signatures(b, percent)
        both = np.intersect1d(ka, kb)
        kinds = {int(k): (set(ta[ka == k].tolist()), set(tb[kb == k].tolist())) for k in both}
        asks = lambda x: x & {jaccard.PROBE, jaccard.BOTH}
        holds = lambda x: x & {jaccard.INDEX, jaccard.BOTH}
        assert any((asks(x) and holds(y)) or (asks(y) and holds(x)) for x, y in kinds.values())


def test_join_edges(edge, empty):
    rows = jaccard.join_groups(edge).collect()
    assert len(rows) == edge.count() and jaccard.join_groups(empty).count() == 0
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[3] == (4, 2) and got[6] == (1, 5) and got[None][1] is None and got[7] == (1, 7)


def brute_vectors(rows, t=0.95):
    ok = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / max(abs(y) for y in v)
            ok[i] = x / np.sqrt((x * x).sum())
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= t]
    n = {i: sum(i in p for p in links) for i, _ in rows}
    c = closure([i for i, _ in rows], links)
    return {i: (n[i], c[i], c[i] == i) for i, _ in rows}


def test_vectors_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(2)
    centers = r.normal(size=(12, 16))
    x = np.concatenate(
        [
            centers[r.integers(0, 12, 250)] + r.normal(size=(250, 16)) * r.choice([0.0, 0.1, 0.25, 0.4], 250)[:, None],
            r.normal(size=(60, 16))
        ]
    )
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [
        (900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None, *[1.0] * 15]), (904, [float("inf"), *[1.0] * 15]),
        (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, []), (908, [1e-40, 2e-40]), (909, [-0.0, 5.0]), (910, [0.0, 1.0])
    ]
    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "'k' AS key", "0 AS node")
    got = {q["vec_id"]: (q["n_links"], q["component_id"], q["kept"]) for q in embedding_dedup.near_duplicates(df).collect()}
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_quantisation_bounds_hold():
    r = np.random.default_rng(4)
    for dims in (2, 64, 2000):
        x = r.normal(size=(60, dims))
        x[30:] = x[:30] + r.normal(size=(30, dims)) * 0.3
        x /= np.sqrt((x * x).sum(1))[:, None]
        q = embedding_dedup.quantise(x)
        assert (np.sqrt(((x - q[0] * q[1][:, None]) ** 2).sum(1)) <= q[2]).all()
        i, j = embedding_dedup.possible(*q, *q, 0.9)
        assert {tuple(p) for p in np.argwhere(x @ x.T >= 0.9)} <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3_000)
    big, small = "ä<p>" * 100, "tiny"
    rows = [
        (5, "u5", big), (2, "u\r\n2", big), (9, None, big), (1, "u1", small), (3, "u3", small), (4, "u4", None), (6, "u6", ""),
        (2, "u2", big), (None, "u", big), (7, "u7", "z" * 10_000)
    ]
    rows += [(i, f"u{i}", hashlib.md5(str(i).encode()).hexdigest() * 9) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS bundle")
    got = sorted(
        (
            str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]
        ) for r in warc.round_trip(df).collect()
    )
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min((j for j, _, g in rows if g == h and j is not None), default=None) if len(b) >= 100 else None
        kind = "revisit" if first is not None and first != i else "response"
        want.append((str(i), len(b), hashlib.sha256(b).hexdigest(), kind, first if kind == "revisit" else None))
    assert got == sorted(want)
    assert warc.round_trip(df.where("false")).count() == 0
    folder = f"file://{tmp_path}"
    index = warc.write_archives(df, folder)
    assert index.select("bundle").distinct().count() > 1 and index.agg(F.max("frame")).first()[0] > 0
    (head, body), = warc.fetch(index, folder, 7)
    assert body == b"z" * 10_000 and head["WARC-Type"] == "response"
    head = warc.fetch(index, folder, 9)[0][0]
    assert head["WARC-Refers-To-Page-ID"] == "2" and head[
        "WARC-Refers-To-Target-URI"
    ] in ("u  2", "u2") and head["WARC-Profile"] == warc.PROFILE
    heads = [h for i in (2, 5, 7, 9) for h, _ in warc.fetch(index, folder, i)]
    assert len({h["WARC-Record-ID"] for h in heads}) == len(heads) == 5
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) for h in heads)


def test_damage_to_archives_is_noticed(spark, tmp_path):
    import zstandard

    index = warc.write_archives(
        spark.createDataFrame([(1, "u", "a" * 500), (2, "v", "b" * 500)], "page_id long, url string, html string").coalesce(1),
        f"file://{tmp_path}"
    )
    path = tmp_path / index.first()["bundle"]
    raw = path.read_bytes()
    path.write_bytes(raw[:60] + bytes([raw[60] ^ 1]) + raw[61:])
    with pytest.raises(Exception):
        warc.read_archives(index, f"file://{tmp_path}").collect()
    data = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 20).replace(b"aaaa", b"aaab", 1)
    packed = zstandard.ZstdCompressor().compress(data)
    path.write_bytes(packed + warc.seek_table([(len(packed), len(data))]))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(index, f"file://{tmp_path}").collect()


def test_frames_stand_alone(spark, tmp_path):
    import zstandard

    index = warc.write_archives(spark.createDataFrame([(1, "u", "a" * 500)], "page_id long, url string, html string"), f"file://{tmp_path}")
    name = index.first()["bundle"]
    raw = (tmp_path / name).read_bytes()
    assert zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 20).startswith(b"WARC/1.1")
    assert int.from_bytes(raw[-4:], "little") == 0x8F92EAB1


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the queen of night and day"


def test_leaks(spark):
    w = ITEM.split()
    docs = [
        (0, f"before words {ITEM} after"), (1, "Before: " + ITEM.upper().replace(" ", ", ")),
        (2, "nothing here at all, really nothing here"), (3, " ".join(w[:8])), (4, None), (5, ""), (6, f"x {ITEM} y {ITEM}"),
        (7, " ".join([*w[:-1], "morning"])), (8, " ".join(x if i % 5 else "zz" for i, x in enumerate(w))), (None, ITEM), (0, ITEM),
        (9, "short one")
    ]
    items = [
        (10, ITEM), (11, "short one"), (12, None), (13, ""), (10, ITEM),
        (14, "entirely different passage that nobody has ever copied into any text")
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS size", "3 AS key")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS size")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(d, i).collect()}
    assert set(got) == {(0, 10), (1, 10), (6, 10), (7, 10), (None, 10), (9, 11)}
    assert got[(0, 10)] == 1.0 and 0.8 <= got[(7, 10)] < 1
    assert decontaminate.find_leaks(d.where("false"), i).count() == 0 and decontaminate.find_leaks(d, i.where("false")).count() == 0


def brute_similarity(doc, item):
    """The best weighted Jaccard similarity of the item with any full window of its size."""
    count = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    d, i = doc.split(), item.split()
    found = [(count(d[b : b + len(i)]), count(i)) for b in range(max(1, len(d) - len(i) + 1))]
    return max((a & b).total() / (a | b).total() for a, b in found)


def test_leaks_between_alignments(spark):
    """Insertions, deletions and swapped parts put the best window between the alignments."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (40, 60, 150, 150)]
    docs, near = [], []
    for n, item in enumerate(items):
        for cut in (4, 6, 8, 10, 12, -4, -8, 0):
            w = list(item)
            w[4], w[-5] = word(), word()
            half = len(w) // 2
            middle = [word() for _ in range(cut)]
            w = w[:half] + middle + w[half:] if cut > 0 else w[: half + cut] + w[half:] if cut < 0 else item[half:] + item[:half]
            docs.append((len(docs), " ".join([word() for _ in range(200)] + w + [word() for _ in range(200)])))
            near.append((n, brute_similarity(docs[-1][1], " ".join(item))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.find_leaks(d, i).collect()}
    want = {(k, n): s for k, (n, s) in enumerate(near) if s >= 0.8}
    assert len(want) > 5 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def all_windows(doc, items, least=0.8):
    """{item: (similarity, start)} of the best of all windows of an item's size, cut short at the text's ends."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    d, found = words(doc), {}
    for name, text in items:
        i = words(text)
        k = min(5, len(i))
        if not i:
            continue
        shingles = lambda w, k=k: [tuple(w[p : p + k]) for p in range(len(w) - k + 1)]
        want, at, m = collections.Counter(shingles(i)), shingles(d), len(i) - k + 1
        for b in range(-m + 1, len(at)):
            own = collections.Counter(at[max(b, 0) : b + m])
            x = (own & want).total() / (own | want).total()
            if x >= least and (name not in found or x > found[name][0] + 1e-12):
                found[name] = (x, max(b, 0))
    return found


def test_leaks_against_all_windows(spark):
    """Swapped halves, repeated shingles, items at the edges, items in items, short items, long texts, null and repeated ids."""
    r = random.Random(5)
    word = lambda n=40: "abcdefghijklmnopqrstuvwxyz"[r.randrange(26)] + str(r.randrange(n))
    texts = [[word() for _ in range(n)] for n in (6, 20, 55, 100, 100)] + [
        ["ab", "cd", "ef", "gh", "ij", "kl"] * 6, ["tiny", "item"], ["one"]
    ]
    items = [(n, " ".join(w)) for n, w in enumerate(texts)] + [(3, "another text under the number of an item that exists already")]
    docs = []
    for w in texts[1:6]:
        noise = lambda n: [word() for _ in range(n)]
        half = len(w) // 2
        for x in (
            w[half:] + w[:half], w[3:], w[: len(w) - 4], noise(30) + w + noise(30), noise(9) + w[: half] + noise(3) + w[half:] + noise(9),
            w + w, [*w[: half], *w[half - 2 :]], noise(50) + [y if r.random() > 0.02 else "zz" for y in w]
        ):
            docs.append((len(docs) // 2 if len(docs) % 3 else None, ", ".join(x)))
    docs += [
        (900, " ".join(noise(150_000) + texts[3] + noise(10))), (901, "tiny ITEM"), (901, "nothing of it"),
        (902, "there is a tiny item here"), (903, "one"), (904, None), (905, ""), *docs[:3]
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "1 AS size", "2 AS start", "3 AS text_key", "4 AS n", "5 AS at"
    ).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS size", "2 AS k")
    got = {(x["doc_id"], x["item_id"]): (x["similarity"], x["start"]) for x in decontaminate.find_leaks(d, i).collect()}
    want = {}
    for doc_id, text in set(docs):
        for name, (x, at) in all_windows(text, items).items():
            best = want.get((doc_id, name), (0, 0))
            if (-x, at) < (-best[0], best[1]):
                want[(doc_id, name)] = (x, at)
    assert set(got) == set(want) and len(got) > 25
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in got)


def test_fingerprints(spark):
    """A bit is set where more than half of the hashes have it; counters do not overflow into each other."""
    r = random.Random(2)
    rows = [[r.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 1000)] + [[-1] * 3000]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, h array<long>").select("i", F.explode("h").alias("h"))
    sums = df.select("i", *decontaminate._counted("h")).groupBy("i").agg(
        *[F.sum(v).alias(v) for v in decontaminate._SUMS], F.count("*").alias("m")
    )
    got = {x["i"]: x["fp"] & (1 << 64) - 1 for x in sums.select("i", decontaminate._fingerprint("m").alias("fp")).collect()}
    assert got == {i: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x)) for i, x in enumerate(rows)}


def test_multi_index_finds_all_within_the_radius(spark):
    r = random.Random(1)
    rows = []
    for n in range(200):
        a, b = r.getrandbits(63), 0
        for bit in r.sample(range(63), r.randrange(decontaminate.RADIUS + 1)):
            b |= 1 << bit
        rows.append((n, a, a ^ b))
    df = spark.createDataFrame(rows, "n int, a long, b long").select(
        "n", decontaminate._blocks("a", True).alias("x"), decontaminate._blocks("b", False).alias("y")
    )
    assert df.where(~F.arrays_overlap("x", "y")).count() == 0


@pytest.fixture(scope="module")
def marked(spark):
    r = random.Random(4)
    rows = []
    for i in range(900):
        w = ["".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(2)) for _ in range(r.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["grumblefoo", "snarkword", "BADTERM!"]))
        rows.append((i, " ".join(w), r.choice(["en", "de", None]), "s", len(w), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int")


def test_toxicity_on_held_out_rows(spark, marked):
    docs, labels = marked.drop("toxic"), marked.selectExpr("doc_id", "0 AS quality", "toxic")
    net = toxicity.fit(docs, labels, toxicity.third() != 1)
    x = toxicity.rate(docs, net).join(marked.select("doc_id", "toxic"), "doc_id").where(toxicity.third() == 1).toPandas()
    assert ((x.score >= 0.7) == (x.toxic == 1)).mean() > 0.97
    again = toxicity.rate(
        docs.selectExpr("doc_id", "text", "'fr' AS lang", "'other' AS source"), toxicity.fit(docs, labels, toxicity.third() != 1)
    ).toPandas()
    first = toxicity.rate(docs, net).toPandas()
    assert np.allclose(again.sort_values("doc_id").score, first.sort_values("doc_id").score)


def test_training_in_a_task_gives_the_same_network(spark, data, monkeypatch):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    here = toxicity.fit(docs, labels, F.lit(True))

    def never(*_):
        raise AssertionError("the driver trains")

    monkeypatch.setattr(toxicity, "_trained", never)  # of this process only
    there = toxicity.fit(docs, labels, F.lit(True), apart=True)
    for name in ("emb", "conv", "bias", "out", "shift"):
        assert np.array_equal(getattr(here, name), getattr(there, name))
    assert here.scale == there.scale and here.cuts == there.cuts
    assert toxicity.fit(docs.limit(0), labels, F.lit(True), apart=True).scale == (1.0, 0.0)


def test_thresholds_by_language():
    """A language whose scores run lower has a lower threshold, also from few documents."""
    r = np.random.default_rng(1)
    y = np.tile([0, 1], 60)
    lang = np.array(["en"] * 100 + ["de"] * 20, object)
    logit = np.where(y == 1, 2.0, -2.0) + r.normal(0, 0.3, 120) - np.where(lang == "de", 4.5, 0.0)
    net = toxicity.Network()
    net.calibrate(logit, y, [*lang[:118], None, None])
    score = net.score_of(logit)
    assert net.cuts["en"] == toxicity.CUT and net.cuts["de"] < toxicity.CUT
    german = lang == "de"
    right = ((score >= net.cuts["de"]) == (y == 1))[german].mean()
    assert right > 0.9 and right > ((score >= toxicity.CUT) == (y == 1))[german].mean()


def test_sample_is_bounded(spark, marked, monkeypatch):
    """Repeated doc_ids and long texts do not widen what the driver receives."""
    monkeypatch.setattr(toxicity, "MOST_BYTES", 20_000)
    docs = marked.drop("toxic")
    seen = []
    real = toxicity.Network.fit
    monkeypatch.setattr(toxicity.Network, "fit", lambda self, x, starts, y: (seen.append(len(x)), real(self, x, starts, y))[1])
    toxicity.fit(docs.union(docs).union(docs.limit(3)), marked.select("doc_id", "toxic"), F.lit(True))
    assert 0 < seen[0] * 3 <= 20_000


def test_toxicity_edges(spark, marked, edge, empty):
    docs, labels = marked.drop("toxic"), marked.selectExpr("doc_id", "toxic")
    net = toxicity.fit(docs, labels.union(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")), F.lit(True))
    rows = toxicity.rate(edge, net).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.rate(empty, net).count() == 0
    blank = toxicity.fit(empty, labels, F.lit(True))
    assert toxicity.rate(edge, blank).count() == edge.count()


def test_long_texts_pool_in_pieces(marked):
    net = toxicity.fit(marked.drop("toxic"), marked.select("doc_id", "toxic"), F.lit(True))
    r = np.random.default_rng(0)
    ids = r.integers(0, toxicity.BUCKETS, (600_000, 4)).astype(np.uint16)
    doc = np.zeros(len(ids), int)
    assert np.allclose(net.pooled(ids, doc, 1)[0], net._pooled_in_pieces(ids, doc, 1), atol=1e-5)


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        after = shared.written(stage(spark, now, data), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        if name.startswith("n-gram"):
            want = {
                i for i,
                (_, c) in brute_groups([(r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()], 5, 80).items() if c == i
            }
            assert {r[0] for r in after.select("doc_id").collect()} == want
        if name.startswith("benchmark"):
            leaks = {
                r[0] for r in decontaminate.find_leaks(now, spark.read.parquet(f"{data}/benchmark.parquet")).select("doc_id").collect()
            }
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in now.select("doc_id").collect()} - leaks
        now = after
    assert now.count() > 0 and sorted(map(str, now.collect())) == sorted(map(str, corpus_pipeline.run(spark, data).collect()))


def rows_of(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_pipeline_edges(spark, edge, empty, tmp_path):
    """Null, repeated and clashing ids and columns: the exact rows of every stage."""
    spark.createDataFrame(
        [(1, "lonely words of a row without an id"), (2, "a b"), (3, None)], "item_id long, text string"
    ).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    again = edge.union(edge.where("doc_id IS NULL OR doc_id = 5"))
    for docs in (edge, again):
        kept = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
        one = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))
        assert one.columns == docs.columns
        # 3 and 3 repeat 2, 6 repeats 5, and repeated rows come once; texts without words all stay
        gone = collections.Counter(
            {(3, "one two three four five six seven"): 1, (3, "One two\tthree four five six SEVEN"): 1, (6, "a  B"): 1}
        )
        want = collections.Counter(dict.fromkeys(rows_of(docs), 1)) - gone
        assert rows_of(one) == want
        clean = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
        assert clean.columns == docs.columns
        assert rows_of(clean) == collections.Counter(
            {k: n for k, n in rows_of(docs).items() if k[1] not in ("lonely words of a row without an id", "a b", "a  B")}
        )
        mix = corpus_pipeline.mixed(spark, docs, str(tmp_path))
        assert mix.columns == docs.columns
        size = lambda t: len((t or "").split())
        taken, sizes = collections.Counter(), collections.Counter()
        for r in docs.collect():
            sizes[r["source"]] += size(r["text"])
        for (i, t), n in rows_of(mix).items():
            assert n <= 2 * rows_of(docs)[(i, t)]
        for r in mix.collect():
            taken[r["source"]] += size(r["text"])
        targets = plain_targets(sizes)
        longest = {s: max([size(r["text"]) for r in docs.collect() if r["source"] == s], default=0) for s in sizes}
        assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1 for s in sizes)
        assert rows_of(mix)[(1, None)] == rows_of(mix)[(0, "")] == rows_of(mix)[(4, " \n\t ")] == 1
        out = corpus_pipeline.sharded(spark, docs, str(tmp_path)).collect()
        assert collections.Counter((r["doc_id"], r["text_crc32"]) for r in out) == collections.Counter(
            (r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in docs.collect()
        )
    d = empty
    for _, stage in corpus_pipeline.STAGES:
        d = shared.written(stage(spark, d, str(tmp_path)), "test")
        assert d.count() == 0


def plain_targets(sizes):
    """150 % of all sizes shared by weights 3, 1, 2 in code-point order, null last, none above twice its source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        out |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return out


def test_rows_are_told_apart_by_their_texts(spark, tmp_path):
    """Null and repeated doc_ids: a clean text of the same id hides no leak, and no row goes for another's text."""
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    w = ITEM.split()
    part = " ".join([*w[:8], *["zzz"] * 14])  # shares the item's first shingles at the same place, and sorts after it
    rows = [
        (None, ITEM), (None, "clean words of a row without an id"), (3, ITEM), (3, part), (4, "unrelated text of the fourth document here"),
        (4, "another thing entirely under the same number"), (5, "unrelated text of the fourth document here"), (6, None)
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {
        (x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.find_leaks(
            d, spark.read.parquet(f"{tmp_path}/benchmark.parquet")
        ).collect()
    }
    assert got == {(None, 1): 1.0, (3, 1): 1.0}
    kept = corpus_pipeline.decontaminated(spark, d, str(tmp_path)).collect()
    assert sorted(map(str, kept)) == sorted(str(x) for x in d.collect() if x["text"] != ITEM)
    once = corpus_pipeline.keep_one_of_each(spark, d.union(d.where("doc_id = 4")), str(tmp_path)).collect()
    # 3 has that text too
    assert sorted((str(x["doc_id"]), str(x["text"])) for x in once) == sorted(
        (str(i), str(t)) for i, t in rows if i != 5 and (i, t) != (None, ITEM)
    )
