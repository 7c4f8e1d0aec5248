"""Language-model scores from a probabilistic suffix tree over tokens.

Tokens are the words of a text and one end. Symbols of the tree are every word seen at least
OWN_COUNT times, the end, the start of a text (a context only), and one class for words seen once
or never. A token's probability is that of its symbol in the longest suffix state that the
tokens before it reach, times the token's share of its symbol. Over the training vocabulary, one
unknown word and the end, the probabilities of the next token sum to 1 in every state.

The counts that make a word a symbol and a context a state are constants, so both grow with the
corpus. No task holds them all: the tree grows a depth at a time, until no context diverges from its
suffix, and the blocks of texts look their contexts up in parts by hash. Blocks are a bucketed table, so
only what the parts send back is shuffled to them. Parts number their states, so a context is told by its
suffix's number and its oldest symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bucketed, dropped, freed, partitions_for, ship, written
from .textscan import _LOWER, STEP, _hashes, buffers, mixed, pack, slices, spans, unpack, word_hashes

#: Contexts of more tokens are not looked for.
MOST_DEPTH = 3
#: Least count of a word that is a symbol of its own, and of the tokens that a candidate state precedes.
OWN_COUNT, LEAST_COUNT = 2, 8
#: A candidate stays if its next-symbol distribution diverges from its suffix's: nats in all, nats a token.
GAIN, DIVERGENCE = 30.0, 0.01
#: Weight of the suffix's distribution in a state's, in counts.
SMOOTH = 16.0
#: Base model's added count.
ADDED = 0.1
#: Text bytes of a block, those whose words one task merges, and words of the corpus whose contexts one task merges.
BLOCK_BYTES, MERGED_BYTES, MERGED_WORDS = 6 << 20, 32 << 20, 2_000_000
END, START, RARE = 0, 1, 2
#: Code lengths are summed as integers of this many parts a nat, so their sums don't depend on the blocks.
NAT = 1 << 6
#: Bits of a context's key.
KEY_BITS = 64
#: Bits of a symbol beside the rank of its context in a part.
SYMBOL_BITS = np.uint64(40)

#: Rows of blocks (kind 0), and of their distinct words dealt by hash (kind 1), which are needed only once.
TEXTS, WORDS = 0, 1
BLOCKS = "kind int, block long, part int, doc_ids array<long>, held binary, counts binary, index binary, often binary, n_texts long, n_words long, hashes binary, train binary"
#: What a block sends of its contexts: their suffixes' numbers and oldest symbols, numbers of symbols and code lengths, and the steps from symbol to symbol and their counts.
REQUEST = ("suffixes", "oldest", "sizes", "costs", "symbols", "n")


def _scan(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, document) of every word."""
    parts = []
    for a, z in slices(off, STEP):
        sub = off[a : z + 1]
        b = _LOWER[raw[sub[0] : sub[-1]]]
        s, e, d = spans(b, sub - sub[0])
        h = word_hashes(raw, sub)[0] if z - a == 1 and len(b) > STEP else _hashes(b, s, e)
        parts.append((h, d + a))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _distinct(keys: np.ndarray) -> np.ndarray:
    s = np.sort(keys)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _grouped(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, a place of each, number of each place's key) of keys below 2**bits, in order.

    Places are sorted along in the low bits where there is room, which is the faster way.
    """
    n = len(keys)
    low = max(1, n.bit_length())
    if bits + low > 64:
        return np.unique(keys, return_index=True, return_inverse=True)
    s = (keys << np.uint64(low)) | np.arange(n, dtype=np.uint64)
    s.sort()
    at = (s & np.uint64((1 << low) - 1)).astype(np.int32 if low < 32 else np.int64)
    s >>= np.uint64(low)
    new = np.ones(n, bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    inv = np.empty(n, at.dtype)
    inv[at] = np.cumsum(new, dtype=at.dtype) - at.dtype.type(1)
    return s[new], at[new], inv


def _blocks(block_bytes: int, parts: int):
    """Blocks of documents as indexes into the block's own distinct words, and those words with their train counts."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    fields = [(n, kinds[t]) for n, t in (f.split(" ") for f in BLOCKS.split(", "))]

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in fields], names=[c for c, _ in fields]
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, seq = TaskContext.get(), 0
        for batch in batches:
            raw, off = buffers(batch.column(2))
            for i, j in slices(off, block_bytes):
                h, owner = _scan(raw, off[i : j + 1])
                uniq, index = np.unique(h, return_inverse=True)
                held = batch.column(1).slice(i, j - i).to_numpy(zero_copy_only=False)
                train = np.bincount(index, weights=~held[owner], minlength=len(uniq)).astype(np.uint32)
                counts = np.bincount(owner, minlength=j - i).astype(np.int32)
                part = (uniq % np.uint64(parts)).astype(np.int64)
                deal = np.argsort(part, kind="stable")
                often = np.bincount(index, minlength=len(uniq))[deal].astype(np.uint32)
                place = np.empty(len(uniq), np.uint32)
                place[deal[_by_number(often)]] = np.arange(len(uniq), dtype=np.uint32)
                block = (context.partitionId() << 24) + seq
                ids = [batch.column(0).slice(i, j - i).to_pylist()]
                yield rows(
                    1, kind=[TEXTS], block=[block], doc_ids=ids, held=[held.tobytes()], counts=[counts.tobytes()],
                    index=[pack(place[index])], often=[pack(often)], n_texts=[int((~held).sum())], n_words=[int(train.sum())]
                )
                to, (hashes, trains) = _dealt(part, parts, [uniq, train])
                if to:
                    yield rows(len(to), kind=[WORDS] * len(to), block=[block] * len(to), part=to, hashes=hashes, train=trains)
                seq += 1

    return cut


def _by_number(often: np.ndarray) -> np.ndarray:
    """The order in which a block numbers its words: frequent ones first, then as they were dealt."""
    return np.argsort(-often.astype(np.int64), kind="stable").astype(np.uint32)


def _dealt(part: np.ndarray, parts: int, arrays: list[np.ndarray], first_sorted: bool = True) -> tuple[list[int], list[list[bytes]]]:
    """The parts that occur, and each array cut by part; the first array is sorted unless told."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [k for k in range(parts) if cut[k] < cut[k + 1]]
    return rows, [[pack(x[order[cut[k] : cut[k + 1]]], first_sorted and i == 0) for k in rows] for i, x in enumerate(arrays)]


def _sorted_counts(c: np.ndarray, symbol: np.ndarray) -> bytes:
    """Counts in the order of the symbols, along which those of words of their own fall: small steps instead of numbers."""
    return pack(c[np.argsort(symbol, kind="stable")].astype(np.uint64), True)


def _counts_of(blob: bytes, symbol: np.ndarray) -> np.ndarray:
    c = np.empty(len(symbol), np.int64)
    c[np.argsort(symbol, kind="stable")] = unpack(blob, np.uint64, True).astype(np.int64)
    return c


def _merge(parts: int):
    """Corpus counts and symbols of a part's words, sent back block by block; block -1 has the part's sums."""

    def merge(table: pa.Table) -> pa.Table:
        blocks, part = table.column("block").to_pylist(), table.column("part")[0].as_py()
        h = [unpack(x, np.uint64, True) for x in table.column("hashes").to_pylist()]
        t = np.concatenate([unpack(x, np.uint32) for x in table.column("train").to_pylist()])
        uniq, index = np.unique(np.concatenate(h), return_inverse=True)
        c = np.bincount(index, weights=t, minlength=len(uniq)).astype(np.int64)
        own = np.flatnonzero(c >= OWN_COUNT)
        symbol = np.full(len(uniq), RARE, np.uint64)
        symbol[own[np.argsort(-c[own], kind="stable")]] = RARE + 1 + np.arange(len(own)) * parts + part  # frequent words get small numbers
        cut = np.cumsum([0, *map(len, h)])
        found = [index[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
        sums = np.array([(c > 0).sum(), c.sum(), (c == 1).sum(), (c == 2).sum(), len(own)], np.int64)
        return pa.table(
            {
                "block": pa.array([*blocks, -1], pa.int64()),
                "part": pa.array([part] * (len(blocks) + 1), pa.int32()),
                "counts": pa.array([*(_sorted_counts(c[i], symbol[i]) for i in found), sums.tobytes()], pa.binary()),
                "symbols": pa.array([*(pack(symbol[i]) for i in found), b""], pa.binary()),
            }
        )

    return merge


class Vocabulary:
    """What all blocks know of the whole vocabulary: totals and the shares of the classes."""

    def __init__(self, sums: np.ndarray, texts: int):
        self.distinct, words, once, twice = (int(x) for x in sums)
        self.texts, self.total = texts, words + texts
        self.discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
        n, d = max(1, self.total), self.discount
        self.unknown = d * self.distinct / n  # the share of words never seen
        self.end, self.rare = texts / n, once * (1 - d) / n + self.unknown
        if not self.total:
            self.end = self.rare = self.unknown = 0.5


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Block:
    """A block's texts as local symbols, and the states that the parts have sent back."""

    def __init__(self, row: dict, many: int, v: Vocabulary):
        # words in the order in which they were dealt, so in that of the replies
        index = _by_number(unpack(row["often"], np.uint32))[unpack(row["index"], np.uint32)]
        self.row, self.many, self.index = row, many, index
        self.held, self.counts = np.frombuffer(row["held"], bool), np.frombuffer(row["counts"], np.int32)
        replies = sorted(row["replies"] or [], key=lambda x: x["part"])
        symbols = [unpack(x["symbols"], np.uint64) for x in replies]
        symbol = np.concatenate([np.empty(0, np.uint64), *symbols])
        self.c = np.concatenate([np.empty(0, np.int64), *(_counts_of(x["counts"], y) for x, y in zip(replies, symbols, strict=True))])
        own, n = self.c >= OWN_COUNT, max(1, v.total)
        few = np.where(self.c > 0, (1 - v.discount) / n, v.unknown)
        self.share = np.where(own, 0.0, np.log10(np.maximum(few, 1e-300)) - np.log10(max(v.rare, 1e-300)))
        # local symbols in the order of the corpus's, so what is sent of a context is sorted
        symbol = np.concatenate([np.array([END, START, RARE], np.uint64), symbol])
        root = np.maximum(np.concatenate([[v.end, 0.0, v.rare], np.where(own, (self.c - v.discount) / n, v.rare)]), 1e-300)
        known = np.concatenate([[0, v.texts, np.iinfo(np.int64).max], self.c])
        by = np.argsort(symbol, kind="stable")
        local = np.empty(len(by), np.uint32)
        local[by] = np.arange(len(by), dtype=np.uint32)
        self.symbol, self.root, self.often = symbol[by], root[by], known[by] >= LEAST_COUNT
        length = self.counts.astype(np.int64) + 2
        first = np.cumsum(length) - length
        wide = np.int32 if length.sum() < 1 << 31 else np.int64
        inner = np.ones(int(length.sum()), bool)
        inner[first] = inner[first + length - 1] = False
        self.s = np.full(len(inner), local[END], np.uint32)
        self.s[first] = local[START]
        self.s[inner] = local[np.where(own, np.arange(len(own)) + 3, RARE)][index]
        self.depth = np.arange(len(self.s), dtype=wide) - np.repeat(first.astype(wide), length)
        self.text = np.repeat(np.arange(len(self.counts), dtype=np.int32), length)
        self.bits = max(1, int(len(by)).bit_length())

    def walk(self, depth: int, widths: list[int], ask: bool) -> tuple[np.ndarray, ...] | tuple[list[int], list[list[bytes]]]:
        """(positions, probabilities) in the longest states up to ``depth``; or the requests for the next depth.

        A state's distribution is its counts plus SMOOTH times its suffix's. Only contexts whose suffix is a state are
        asked for. A context precedes as many tokens as its newest symbol follows the others, so what
        the parts have sent of the others rules out most contexts under LEAST_COUNT without asking. The key of a
        context is its suffix's number and its oldest symbol, in as many bits as ``widths`` has for its depth,
        or a hash of the two where they are too many for 64 bits (0).
        """
        out, at = self.root[self.s], np.flatnonzero(self.depth > 0).astype(self.depth.dtype)
        live, of_live, ids = at, np.zeros(len(at), np.uint32), np.zeros(1, np.uint64)
        follows = self.often[self.s]  # whether the symbol of a place may follow the d - 1 before LEAST_COUNT times
        most = np.ones(len(self.s), bool)  # whether the context before a place may precede so many tokens
        shift, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        for d in range(1, depth + ask + 1):
            most[1:] &= follows[:-1]
            some = most[live] & (self.depth[live] >= d)
            live, of_live = live[some], of_live[some]
            room = self.bits + max(1, int(len(ids)).bit_length())
            code, _, rank = _grouped((of_live.astype(np.uint64) << shift) | self.s[live - d], room)
            suffix, oldest = ids[(code >> shift).astype(np.int64)], self.symbol[(code & low).astype(np.int64)]
            contexts = _keys(suffix, oldest, widths[d - 1])
            # contexts in the order in which they are dealt: by part, then by key
            part = (mixed(contexts) % np.uint64(self.many)).astype(np.int64)
            by = np.lexsort((contexts, part))
            place = np.empty(len(by), np.uint32)
            place[by] = np.arange(len(by), dtype=np.uint32)
            contexts, part, rank = contexts[by], part[by], place[rank]
            keys, first, inv = _grouped(
                (rank.astype(np.uint64) << shift) | self.s[live], self.bits + max(1, int(len(contexts)).bit_length())
            )
            of = (keys >> shift).astype(np.int64)
            if d > depth:
                n = np.bincount(inv, weights=~self.held[self.text[live]], minlength=len(keys))
                costs = np.bincount(of, weights=n * np.rint(-np.log(out[live[first]]) * NAT), minlength=len(contexts)).astype(np.int64)
                rows, cut = _dealt(
                    part, self.many, [suffix[by], oldest[by], np.bincount(of, minlength=len(contexts)).astype(np.uint32), costs]
                )
                symbols, new = self.symbol[(keys & low).astype(np.int64)], np.concatenate([[True], of[1:] != of[:-1]])
                symbols[1:] -= np.where(new[1:], np.uint64(0), symbols[:-1])  # each context's first, then differences
                return rows, cut + _dealt(part[of], self.many, [symbols, n.astype(np.uint32)], False)[1]
            replies = sorted(self.row[f"states{d}"] or [], key=lambda x: x["part"])
            totals, n, ids = np.zeros(len(contexts), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(contexts), np.uint64)
            totals[:] = np.concatenate([np.empty(0, np.int64), *(unpack(x["totals"], np.int64) for x in replies)])
            ids[totals > 0] = np.concatenate([np.empty(0, np.uint64), *(unpack(x["ids"], np.uint64, True) for x in replies)])
            n[totals[of] > 0] = np.concatenate([np.empty(0, np.int64), *(unpack(x["n"], np.int64) for x in replies)])
            found, follows = (totals > 0)[rank], most.copy()
            live, of_live, inv = live[found], rank[found], inv[found]
            follows[live] = (n >= LEAST_COUNT)[inv]
            out[live] = (n[inv] + SMOOTH * out[live]) / (totals[of_live] + SMOOTH)
        return at, out[at]


def _keys(suffix: np.ndarray, oldest: np.ndarray, width: int) -> np.ndarray:
    """Contexts as one number: their suffix's number above ``width`` bits of their oldest symbol, or a hash of both (0)."""
    return (suffix << np.uint64(width)) | oldest if width else mixed(mixed(suffix) + oldest + np.uint64(1))


def _asked(many: int, vocabulary, depth: int, widths: list[int]):
    """Counts of (context, symbol) of each block at ``depth``, dealt by context; held-out texts ask but do not count."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            rows, cut = Block(row, many, vocabulary.value).walk(depth - 1, widths, True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]] * len(rows), pa.int64()), pa.array(rows, pa.int32())] + [pa.array(x, pa.binary()) for x in cut],
                names=["block", "part", *REQUEST]
            )

    return ask


def _states(many: int, width: int):
    """A part's states, sent back block by block: each context's total, 0 if it is none, and the others' numbers and symbol counts.

    A state precedes LEAST_COUNT tokens and diverges from its suffix, whose code lengths the blocks have sent.
    Chunks are unpacked anew in each pass, so memory follows the distinct contexts and symbols, not the blocks.
    """

    def states(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        kinds = dict(zip(REQUEST, (np.uint64, np.uint64, np.uint32, np.int64, np.uint64, np.uint32), strict=True))

        def blob(name: str, i: int) -> np.ndarray:
            if name == "contexts":
                return _keys(blob("suffixes", i), blob("oldest", i), width)
            return unpack(table.column(name)[i].as_py(), kinds[name], name == "suffixes")

        def keys(i: int) -> tuple[np.ndarray, np.ndarray]:
            place, size, steps = np.searchsorted(contexts, blob("contexts", i)), blob("sizes", i), blob("symbols", i)
            upto, first = np.cumsum(steps), np.cumsum(size, dtype=np.int64) - size
            symbols = upto - np.repeat(upto[first] - steps[first], size)
            return place, (np.repeat(place, size).astype(np.uint64) << SYMBOL_BITS) | symbols

        every = range(table.num_rows)
        contexts = np.empty(0, np.uint64)
        for a in range(0, table.num_rows, 64):
            contexts = _distinct(np.concatenate([contexts, *(blob("contexts", i) for i in every[a : a + 64])]))
        pairs = np.empty(0, np.uint64)
        for a in range(0, table.num_rows, 32):
            pairs = _distinct(np.concatenate([pairs, *(keys(i)[1] for i in every[a : a + 32])]))
        n, costs = np.zeros(len(pairs), np.int64), np.zeros(len(contexts), np.int64)
        for i in every:
            place, k = keys(i)
            n[np.searchsorted(pairs, k)] += blob("n", i)  # a chunk has each context and each pair once
            costs[place] += blob("costs", i)
        of = (pairs >> SYMBOL_BITS).astype(np.int64)
        totals = np.bincount(of, weights=n, minlength=len(contexts)).astype(np.int64)
        told = np.bincount(
            of, weights=n * np.log(np.maximum(n, 1)), minlength=len(contexts)
        ) - totals * np.log(np.maximum(totals, 1)) + costs / NAT
        totals[(totals < LEAST_COUNT) | (told < GAIN) | (told < DIVERGENCE * totals)] = 0
        state = totals > 0
        ids = np.zeros(len(contexts), np.uint64)
        ids[state] = np.arange(1, state.sum() + 1, dtype=np.uint64) * np.uint64(many) + np.uint64(part)  # 0 is the empty context
        sent = []
        for i in every:
            place, k = keys(i)
            k = k[np.repeat(state[place], blob("sizes", i))]
            sent.append((pack(totals[place]), pack(n[np.searchsorted(pairs, k)]), pack(ids[place][state[place]], True)))
        return pa.table(
            {
                "block": table.column("block"), "part": table.column("part"), "totals": pa.array([x[0] for x in sent], pa.binary()),
                "n": pa.array([x[1] for x in sent], pa.binary()), "ids": pa.array([x[2] for x in sent], pa.binary()),
                "states": pa.array([int(state.sum())] * len(sent), pa.int64())
            }
        )

    return states


def score(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    Every document outside ``held_out`` is counted whole. Blocks of documents are kept as
    indexes into the block's distinct words; only a block's distinct words and its
    (context, symbol) counts are shuffled, dealt by hash in packed chunks and merged part by part,
    so a frequent word is one entry a block. Corpus counts of words, and of the contexts that are states,
    go back to the blocks that asked, a depth at a time, until a depth has no state or MOST_DEPTH is
    reached; nothing that grows with the corpus is broadcast or collected.

    A null or blank text has one token, the end. A null ``held_out`` (null doc_id) counts
    as training. Repeated rows are texts of their own. Without training tokens the end and the
    unknown word have probability 1/2; an empty table gives an empty result; further columns are
    ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, parts = min(100_000, partitions_for(size, BLOCK_BYTES)), partitions_for(size, MERGED_BYTES)
    table = bucketed(source.mapInArrow(_blocks(BLOCK_BYTES, parts), BLOCKS), "block", buckets, "lm-blocks", "kind")
    blocks = table.where(F.col("kind") == TEXTS).select("block", "doc_ids", "held", "counts", "index", "often")
    texts, words = table.where(F.col("kind") == TEXTS).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_texts", "n_words")]).first()
    many = partitions_for(words, MERGED_WORDS)
    asked = table.where(F.col("kind") == WORDS).select("part", "block", "hashes", "train")
    found = written(asked.groupBy("part").applyInArrow(_merge(parts), "block long, part int, counts binary, symbols binary"), "lm-found")
    del asked
    dropped(table, f"kind={WORDS}")
    replies = _gathered(found, ["part", "counts", "symbols"], "replies", buckets)
    del found
    sums = np.zeros(5, np.int64)
    for r in replies.where("block = -1").select(F.explode("replies.counts")).toLocalIterator():
        found = np.frombuffer(r[0], np.int64)
        sums = np.append(sums[:4] + found[:4], max(sums[4], found[4]))
    vocabulary = Vocabulary(sums[:4], texts)
    sent = spark.sparkContext.broadcast(vocabulary)
    known = blocks.join(replies.hint("merge"), "block", "left")
    symbol_bits = int(RARE + (sums[4] + 2) * parts).bit_length()
    depth, widths = 0, [symbol_bits]
    while depth < MOST_DEPTH:
        asked = known.drop("doc_ids").mapInArrow(
            _asked(many, sent, depth + 1, widths), f"block long, part int, {', '.join(f'{x} binary' for x in REQUEST)}"
        )
        found = written(
            asked.groupBy("part").applyInArrow(
                _states(many, widths[depth]), "block long, part int, totals binary, n binary, ids binary, states long"
            ),
            "lm-found"
        )
        del asked
        states = _gathered(found, ["part", "totals", "n", "ids", "states"], f"states{depth + 1}", buckets)
        del found
        most = states.agg(F.max(F.array_max(f"states{depth + 1}.states"))).first()[0]
        if not most:
            dropped(states)
            break
        depth += 1
        widths = [*widths, symbol_bits if int((most + 1) * many).bit_length() + symbol_bits <= KEY_BITS else 0]
        known = known.join(states.hint("merge"), "block", "left")
    total, denominator = vocabulary.total, vocabulary.total + ADDED * (vocabulary.distinct + (texts > 0) + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, many, sent.value)
            owner = np.repeat(np.arange(len(b.counts)), b.counts)
            add = lambda w, o=owner, n=len(b.counts): np.bincount(o, weights=w, minlength=n).astype(np.float64)
            at, p = b.walk(depth, widths, False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(b.held),
                    pa.array(b.counts.astype(np.int64) + 1),
                    pa.array(add((b.c > 0)[b.index].astype(float)).astype(np.int64) + int(texts > 0)),
                    pa.array(np.full(len(b.counts), total, np.int64)),
                    pa.array(add(np.log10((b.c + ADDED) / denominator)[b.index]) + np.log10((texts + ADDED) / denominator)),
                    pa.array(add(b.share[b.index]) + add(np.log10(p), b.text[at])),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return known.mapInArrow(
        scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _gathered(found: DataFrame, columns: list[str], name: str, buckets: int) -> DataFrame:
    """What the parts send back to each block, written in the buckets of the blocks, so that it is shuffled once.

    ``found`` is a written table: what the blocks have asked leaves the disks before the replies are shuffled, and the table after.
    """
    freed(found.sparkSession)
    mine = found.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))
    out = bucketed(mine, "block", buckets, f"lm-{name}")
    dropped(found)
    return out


def op10_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
