"""Words, shingles, packing, tokens, mixing, sharding and language model, against plain Python."""

import collections
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import mixing, shared, sharding, suffix_tree, textscan, token_files, tokens

BLANK = b" \t\n\r\x0b\x0c"


def words_of(text):
    return (text or "").encode().lower().split()


def shingles_of(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab Ä\t\n.", max_size=30)), max_size=12), st.integers(1, 5))
def test_shingle_sets(texts, k):
    raw, off = textscan.buffers(pa.array(texts, pa.string()))
    got = {i: len(s) for i, s in textscan.shingle_sets(raw, off, k)}
    assert got == {i: len(shingles_of(t, k)) for i, t in enumerate(texts)}


def test_long_texts_are_cut_at_blanks():
    text = "abc de " * 400_000 + "z" * (textscan.STEP + 5)
    raw, off = textscan.buffers(pa.array([text]))
    h, _ = textscan.word_hashes(raw, off)
    assert len(h) == 800_001 and len(set(h.tolist())) == 3


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_pack(values):
    x = np.array(values, np.uint64)
    assert np.array_equal(textscan.unpack(textscan.pack(x), np.uint64), x)
    x.sort()
    assert np.array_equal(textscan.unpack(textscan.pack(x, True), np.uint64, True), x)


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_token_counts(edge, library):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(edge).collect())
    want = collections.Counter()
    for r in edge.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        want[(r["doc_id"], len((r["text"] or "").encode()), n, n > 2048)] += 1
    assert got == want


def test_special_strings_inside_texts(spark, library):
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "it's o'clock 3.14 naïve ﬁ Σ ς", "é ́"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


ODD = st.text(alphabet=st.sampled_from("aAbZéÉßÿº'.,!<|>09 \t\n\x0b\x1c\x85\u2028\u00a0ñÑ\u0301Ω中🙂İ$st"), max_size=40)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    texts = ["two  blanks here", "", "line\nbreak", "a <|endoftext|> b é 中"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df, path).collect()}
    assert got == {i: len(plain_ids(path, t)) for i, t in enumerate(texts)}


def plain_ids(path, text):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).encode(text)


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def both(request):
    """The encoder and the library itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(request.param)
    return tokens.Encoder(*tokens.load_file(path)), Tokenizer.from_file(path)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.one_of(st.none(), ODD, st.sampled_from(["<|endoftext|>", "x<|startoftext|>y 's", "it's o'clock", "word%%% end..."])), max_size=8
    ),
    st.sampled_from([4, 30, 1 << 20])
)
def test_steps_and_cuts_do_not_change_ids(both, texts, step):
    e, plain = both
    column = pa.array(texts, pa.string())
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    whole = tokens.Encoder.steps
    e.steps = lambda c: whole(e, c, step)
    got = [[] for _ in texts]
    for rows, ids, n in e.ids(column):
        for r, x in zip(rows.tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
            got[r] += x.tolist()
    assert got == want
    assert e.lengths(column).tolist() == [len(x) for x in want]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=400))
def test_block_round_trip(ids):
    x = np.array(ids, np.uint32)
    y, end = token_files.decode_block(token_files.encode_block(x, 61))
    assert np.array_equal(x, y)


@pytest.mark.parametrize("n", [1, 31, 32, 5000, 70_000])
def test_block_sizes(n):
    x = (np.random.default_rng(n).zipf(1.4, n) % 49408).astype(np.uint32)
    blob = token_files.encode_block(x, 49408)
    assert np.array_equal(token_files.decode_block(blob)[0], x)


def test_repetition_compresses_and_damage_is_noticed():
    x = np.tile(np.arange(100, dtype=np.uint32) * 400, 600)
    blob = token_files.encode_block(x, 49408)
    assert len(blob) < len(x)
    bad = bytearray(blob)
    bad[len(blob) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_block(bytes(bad))


def token_rows(df, tmp_path):
    return token_files.read_files(token_files.write_files(df, f"file://{tmp_path}"), f"file://{tmp_path}").collect()


def test_token_files(edge, empty, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1 << 20)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_rows(edge, tmp_path))
    rows = sorted(edge.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    at, want = 0, []
    for r in rows:
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((at, r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_rows(empty, tmp_path) == []


def test_mix(edge, empty, spark):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count() and mixing.mix(empty).count() == 0
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    targets = {r["source"]: r["target"] for r in rows}
    assert all(taken[s] == math.floor(t) for s, t in targets.items())
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(edge.repartition(7)).collect()))


def test_mix_in_buckets(spark, monkeypatch):
    df = spark.range(3000).selectExpr(
        "id AS doc_id", "repeat('w ', CAST(id % 17 AS INT)) AS text",
        "CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('s', id % 5) END AS source"
    )
    one = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    assert sorted(map(str, mixing.mix(df).collect())) == one


def test_targets_fill_up(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got["a"] == 20 and got[None] == 0 and sum(got.values()) == pytest.approx(1.5 * 1510)


def test_shards(edge, empty):
    rows = sharding.kd_shards(edge, shards=4).collect()
    assert len(rows) == edge.count() and sharding.kd_shards(empty, shards=4).count() == 0
    slots, groups = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())


def test_shards_are_even(spark, data):
    docs = spark.range(4000).selectExpr(
        "id AS doc_id", "repeat(md5(CAST(id AS STRING)), CAST(1 + id % 20 AS INT)) AS text",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 9) END AS source", "'en' AS lang"
    )
    load = [r[1] for r in sharding.kd_shards(docs, shards=16).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(load) == 16 and max(load) < 1.03 * min(load)
    few = sharding.kd_shards(docs, target_bytes=sum(load) // 5 + 1).select("shard").distinct().count()
    assert few == 5


def plain_tree(groups, leaves, boxes=None):
    """{group: shard} by sorting every node along its widest dimension; groups are (name, bytes, keys)."""
    boxes = boxes or [(min(g[2][i] for g in groups), max(g[2][i] for g in groups)) for i in range(4)]
    if leaves == 1 or not groups:
        return {g[0]: 0 for g in groups}
    dim = max(range(4), key=lambda i: (boxes[i][1] - boxes[i][0], -i))
    left, want = leaves // 2, sum(g[1] for g in groups) * (leaves // 2) / leaves
    ordered, below = sorted(groups, key=lambda g: g[2][dim]), 0
    for at, g in enumerate(ordered):
        if below + g[1] >= want:
            break
        below += g[1]
    after = below + g[1] - want <= want - below
    cut = g[2][dim] if after else g[2][dim] - 1
    a, b = [g for g in groups if g[2][dim] <= cut], [g for g in groups if g[2][dim] > cut]
    low, high = (boxes[dim][0], max(boxes[dim][0], cut)), (min(boxes[dim][1], cut + 1), boxes[dim][1])
    out = plain_tree(a, left, [low if i == dim else x for i, x in enumerate(boxes)])
    return out | {k: v + left for k, v in plain_tree(b, leaves - left, [high if i == dim else x for i, x in enumerate(boxes)]).items()}


@pytest.mark.parametrize("leaves", [1, 5, 16, 40])
def test_shards_against_a_plain_tree(spark, data, leaves, monkeypatch):
    monkeypatch.setattr(sharding, "BINS", 64)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    groups = shared.written(sharding.coordinates(sharding.base_rows(docs)), "test")
    rows = [(r["group"], r["bytes"], [r[f"k_{d}"] for d in sharding.DIMENSIONS]) for r in groups.collect()]
    got = {r["group"]: r["shard"] for r in sharding.placed_groups(groups, leaves, 0.0).collect()}
    assert got == plain_tree(rows, leaves)


def held(df):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def base_scores(rows):
    c = collections.Counter()
    for d, t, h in rows:
        if not h:
            c.update(words_of(t))
            c["end"] += 1
    n, v = sum(c.values()), len(c)
    p = lambda w: math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1)))
    return {
        (d, t): (len(words_of(t)) + 1, sum(c[w] > 0 for w in words_of(t)) + (c["end"] > 0), n, sum(map(p, words_of(t))) + p("end")) for d,
        t, h in rows
    }


def test_language_model(spark, data, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 50_000)
    monkeypatch.setattr(suffix_tree, "MERGED_BYTES", 100_000)
    monkeypatch.setattr(suffix_tree, "MERGED_WORDS", 10_000)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = suffix_tree.score(docs, held(docs)).collect()
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in docs.collect()]
    want = {k[0]: v for k, v in base_scores(rows).items()}
    for r in got:
        n, known, total, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_edges(edge, empty):
    rows = suffix_tree.score(edge, held(edge)).collect()
    assert len(rows) == edge.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert suffix_tree.score(empty, held(empty)).count() == 0
    none = suffix_tree.score(edge, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in none)


def brute_tree(texts, train):
    """log10 scores of the suffix tree with dictionaries: every repeated word a symbol, every context seen LEAST_COUNT times a candidate."""
    c = collections.Counter(w for t, ok in zip(texts, train, strict=True) if ok for w in t)
    n, ended, once, twice = sum(c.values()) + sum(train), sum(train), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    unknown, sym = d * len(c) / n, lambda w: w if w in ("<", ">") or c[w] > 1 else "?"
    rare = once * (1 - d) / n + unknown
    root = lambda x: ended / n if x == ">" else rare if x == "?" else (c[x] - d) / n
    seqs = [["<", *map(sym, t), ">"] for t in texts]
    seen = collections.defaultdict(collections.Counter)
    for s, ok in zip(seqs, train, strict=True):
        for i in range(1, len(s)):
            for k in range(1, min(i, suffix_tree.MOST_DEPTH) + 1):
                seen[tuple(s[i - k : i])][s[i]] += ok
    states = {(): None}

    def prob(ctx, x):
        if not ctx:
            return root(x)
        return (seen[ctx][x] + 16 * prob(ctx[1:], x)) / (sum(seen[ctx].values()) + 16)

    for ctx in sorted(seen, key=len):
        total = sum(seen[ctx].values())
        if ctx[1:] in states and total >= 8:
            told = sum(
                m * (math.log(m / total) + round(-math.log(prob(ctx[1:], x)) * suffix_tree.NAT) / suffix_tree.NAT) for x,
                m in seen[ctx].items() if m
            )
            if told >= 30 and told >= 0.01 * total:
                states[ctx] = total
    out = []
    for t, s in zip(texts, seqs, strict=True):
        p = sum(math.log10(((1 - d) / n if c[w] else unknown) / rare) for w in t if c[w] <= 1)
        for i in range(1, len(s)):
            ctx = ()
            for k in range(1, min(i, suffix_tree.MOST_DEPTH) + 1):
                if tuple(s[i - k : i]) not in states:
                    break
                ctx = tuple(s[i - k : i])
            p += math.log10(prob(ctx, s[i]))
        out.append(p)
    return out, states, lambda ctx, w: prob(ctx, sym(w)) * (1 if w == ">" or c[w] > 1 else ((1 - d) / n if c[w] else unknown) / rare)


def test_next_token_probabilities_sum_to_one():
    """Over the training words, the unknown word and the end, in every state."""
    texts = [t.split() for t in ["a b a c", "a b a b a b", "c c d", "a b"] * 40 + ["e f", "g a b"]]
    _, states, prob = brute_tree(texts, [True] * len(texts))
    assert len(states) > 3
    for ctx in states:
        assert sum(prob(ctx, w) for w in {*sum(texts, []), "never seen", ">"}) == pytest.approx(1)


@pytest.mark.parametrize("key_bits", [64, 20])
def test_states_do_not_depend_on_the_size_of_the_corpus(spark, monkeypatch, key_bits):
    """Rare words and contexts among many tokens are states, as a tree in dictionaries has them; blocks and parts are many."""
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(suffix_tree, "KEY_BITS", key_bits)
    monkeypatch.setattr(suffix_tree, "MERGED_BYTES", 50_000)
    monkeypatch.setattr(suffix_tree, "MERGED_WORDS", 6_000)
    r = np.random.default_rng(6)
    texts = [[f"w{int(x)}" for x in r.zipf(1.3, r.integers(0, 60)).clip(0, 3000)] for _ in range(1500)]
    for t in texts[:40]:
        t += ["seldom", "seen", "words", "follow"]
    train = [i % 10 != 0 for i in range(len(texts))]
    want, states, _ = brute_tree(texts, train)
    assert ("seldom", "seen") in states or ("seen",) in states
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: x["score"] for x in suffix_tree.score(docs, F.col("doc_id") % 10 == 0).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_freed_memory_leaves_the_process(spark):
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    full = [bytes([i % 256]) * 50_000 for i in range(4000)]  # small enough for the C library to keep their pages
    last, before = full[-1], resident()
    del full
    shared.freed(spark)
    assert before - resident() > 150_000_000 and last


def test_memory_freed_by_the_jvm_leaves_its_process(spark):
    jvm = spark.sparkContext._jvm
    pid, native = jvm.java.lang.ProcessHandle.current().pid(), jvm.org.apache.spark.unsafe.Platform

    def resident():
        return int(open(f"/proc/{pid}/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    blocks = [native.allocateMemory(50_000) for _ in range(4000)]  # small enough for the C library to keep their pages
    for b in blocks:
        native.setMemory(b, 1, 50_000)
    *rest, last = blocks
    before = resident()
    for b in rest:
        native.freeMemory(b)
    shared.freed(spark)
    left = before - resident()
    native.freeMemory(last)
    assert left > 150_000_000
