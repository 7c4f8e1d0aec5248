"""Token counts of whole texts with public tokenizer files."""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import ship
from .textscan import _BLANK, buffers, slices

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Bytes of text that are cut into words and encoded in one step.
BATCH_BYTES = 8 << 20
#: Words that go to the library as one line, and lines of a call.
WORDS_A_LINE, LINES = 200, 50
#: Letters whose lower case and composed form are letters of this set again.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTER_SET = "".join(chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªµº")
_SIMPLE = f"^[{_LETTERS}]+[!-/:-@\\[-`{{-~]*$"
#: What a word-end vocabulary must do before its merges for words to be taken apart: fixed values of the file format.
_NORMALIZER = ("NFC", "Replace", "Lowercase")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LOADED: dict[tuple, Encoder] = {}


def _byte_letters() -> np.ndarray:
    """The code point that byte-level vocabularies write for each byte; a blank stays itself here."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = np.zeros(256, np.int64)
    out[shown] = shown
    hidden = np.setdiff1d(np.arange(256), shown)
    out[hidden] = 256 + np.arange(len(hidden))
    out[32] = 32
    return out


_SHOWN = _byte_letters()


def _written(raw: bytes) -> str:
    """UTF-8 bytes, each as the letter that stands for it."""
    b = np.frombuffer(raw, np.uint8)
    code = _SHOWN[b]
    wide = code >= 128
    at = np.cumsum(1 + wide) - 1 - wide
    out = np.empty(len(b) + int(wide.sum()), np.uint8)
    out[at] = np.where(wide, 0xC0 | (code >> 6), code)
    out[at[wide] + 1] = 0x80 | (code[wide] & 63)
    return out.tobytes().decode()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of each list)."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for ids in lists for x in ids), np.uint32, int(n.sum())), n


class Encoder:
    """A tokenizer file, loaded once per Python worker.

    Vocabularies with word ends drop white space before they split a text, so a text's ids
    are the ids of its blank-separated words, one after the other: blanks are safe boundaries
    for texts of any length, and the distinct words of a batch go to the library once. Byte-level
    vocabularies never join a letter and the blank after it, so long texts are cut between the two.
    Other vocabularies get whole texts.
    """

    def __init__(self, kind: str, blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kind, self.by_word, self.before_blank, self.stems = kind, False, False, None
        if kind != "json":
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
            return
        from tokenizers import Tokenizer

        rules = json.loads(blob)
        self.library = Tokenizer.from_str(blob.decode())
        self.library.no_truncation()
        self.library.no_padding()
        suffix = rules["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [rules.get("pre_tokenizer") or {}]
        blanks = any(c.isspace() or t.get("lstrip") or t.get("rstrip") for t in rules.get("added_tokens", []) for c in t["content"])
        last = steps[-1]
        self.before_blank = not self.by_word and not rules.get("normalizer") and len(steps) == 1 and last.get("type") == "ByteLevel" and last.get("use_regex", True) and not last.get("add_prefix_space") and not blanks
        if not suffix:
            return
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(suffix)]] = True
        named = tuple(n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", []))
        if named == _NORMALIZER and [
            x.get("type") for x in steps
        ] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _SPLIT} and not last.get("use_regex", True):
            # lower-case words of letters pass these steps unchanged, so they go to the library's merges at once
            self.stems = Tokenizer.from_str(
                json.dumps(
                    rules | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}}
                )
            )

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.kind == "json":
            return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return self.library.encode(texts, num_threads=1)

    def _stem_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each) of lower-case words of letters, many words to a line.

        Each word gives one end of a word, and ids are cut behind the ends.
        """
        raw, off = buffers(words)
        found = []
        for i in range(0, len(words), LINES * WORDS_A_LINE):
            j = min(i + LINES * WORDS_A_LINE, len(words))
            text = _written(np.insert(raw[off[i] : off[j]], off[i + 1 : j] - off[i], 32).tobytes()).split(" ")
            lines = [" ".join(text[k : k + WORDS_A_LINE]) for k in range(0, len(text), WORDS_A_LINE)]
            found += [np.array(e.ids, np.uint32) for e in self.stems.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, np.uint32), *found])
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words):
            raise ValueError("words and word ends differ in number")
        return ids, np.diff(cut, prepend=0)

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, place of each, two pieces of each word) of blank-free words; piece 0 is empty."""
        n = len(words)
        two = np.zeros((n, 2), np.int64)
        simple = np.zeros(n, bool)
        ids, sizes = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
        at = 1
        if self.stems and n:
            simple = pc.match_substring_regex(words, _SIMPLE).to_numpy(zero_copy_only=False)
            some = words.filter(pa.array(simple))
            stems = pc.utf8_lower(pc.utf8_rtrim(some, characters=string.punctuation)).dictionary_encode()
            x, m = self._stem_ids(stems.dictionary)
            two[simple, 0] = stems.indices.to_numpy() + at
            ids, sizes, at = ids + [x], sizes + [m], at + len(m)
            tails = pc.utf8_ltrim(some, characters=_LETTER_SET).dictionary_encode()
            x, m = _flat(self.encode(tails.dictionary.to_pylist()))
            two[simple, 1] = tails.indices.to_numpy() + at
            ids, sizes, at = ids + [x], sizes + [m], at + len(m)
        rest = words.filter(pa.array(~simple)).to_pylist()
        x, m = _flat(self.encode(rest))
        two[~simple, 0] = np.arange(len(rest)) + at
        sizes = np.concatenate(sizes + [m])
        return np.concatenate(ids + [x]), np.concatenate([[0], np.cumsum(sizes)]), two

    def _cuts(self, b: np.ndarray) -> np.ndarray:
        """Places where a text may be cut without changing its ids."""
        if self.by_word:
            return np.flatnonzero(_BLANK[b])
        if not self.before_blank:
            return np.empty(0, np.int64)
        letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
        return np.flatnonzero((b[1:-1] == 32) & letter[:-2] & letter[2:]) + 1

    def steps(self, column: pa.Array, step: int = BATCH_BYTES) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(texts, row of each) of about ``step`` bytes together; longer texts are cut where it is safe."""
        raw, off = buffers(column)
        kind = pa.string() if not pa.types.is_large_string(column.type) else pa.large_string()
        for i, j in slices(off, step):
            size = int(off[j] - off[i])
            edges = off[i : j + 1]
            owner = np.arange(i, j)
            if size > step:  # one text
                cuts = np.concatenate([[0], self._cuts(raw[off[i] : off[j]]), [size]])
                edges, at = [0], 0
                while at < size:
                    k = int(np.searchsorted(cuts, at + step, "right")) - 1
                    k = k if cuts[k] > at else int(np.searchsorted(cuts, at, "right"))
                    at = int(cuts[k])
                    edges.append(at)
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    yield pa.array([raw[off[i] + a : off[i] + z].tobytes().decode()], kind), np.array([i])
                continue
            data = pa.py_buffer(raw[edges[0] : edges[-1]])
            rel = pa.py_buffer((edges - edges[0]).astype(np.int64))
            yield pa.Array.from_buffers(pa.large_string(), j - i, [None, rel, data]).cast(kind), owner

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(ids of pieces, place of each, two pieces of each word of the texts, number of words of each text)."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids, place, two = self.pieces(words.dictionary)
        return ids, place, two[words.indices.to_numpy()], pc.list_value_length(lists).to_numpy().astype(np.int64)

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Number of ids of every text; a null is empty."""
        out = np.zeros(len(column), np.int64)
        for texts, owner in self.steps(column):
            if self.by_word:
                _, place, two, n = self._by_words(texts)
                size = np.diff(place)[two].sum(axis=1)
                total = np.bincount(np.repeat(np.arange(len(n)), n), weights=size, minlength=len(n)).astype(np.int64)
            else:
                total = np.array([len(x) for x in self.encode(texts.to_pylist())], np.int64)
            np.add.at(out, owner, total)
        return out

    def ids(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of each text, ids of all, number of each) step by step; a long text's row comes several times."""
        for texts, owner in self.steps(column):
            if not self.by_word:
                x, n = _flat(self.encode(texts.to_pylist()))
                yield owner, x, n
                continue
            ids, place, two, n = self._by_words(texts)
            piece = two.reshape(-1)
            size = np.diff(place)[piece]
            end = np.cumsum(size)
            total = int(end[-1]) if len(end) else 0
            x = ids[np.repeat(place[piece] - (end - size), size) + np.arange(total)]
            words = np.concatenate([[0], np.cumsum(n)])
            edge = np.concatenate([[0], end])[2 * words]
            yield owner, x, np.diff(edge)


def load_file(path: str) -> tuple[str, bytes]:
    """(kind, content) of a tokenizer file: json for tokenizers, model for sentencepiece."""
    return ("model" if path.endswith(".model") else "json"), Path(path).read_bytes()


def encoder(kind: str, blob: bytes) -> Encoder:
    key = (kind, hash(blob))
    if key not in _LOADED:
        _LOADED[key] = Encoder(kind, blob)
    return _LOADED[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; no shuffle.

    Arrow batches are cut into steps of about BATCH_BYTES, longer texts at safe boundaries, and only
    lengths leave the Python workers. No begin, end or
    other special tokens are added; special strings inside texts are taken as the library
    does by default. A null text counts as the empty one: 0 bytes, 0 tokens. Null doc_ids and
    repeated rows come out as they came in; an empty table gives an empty result; further
    columns are ignored.
    """
    ship(docs.sparkSession)
    kind, blob = load_file(path or default_path())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(kind, blob)
        for batch in batches:
            _, off = buffers(batch.column(1))
            tokens = e.lengths(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(off)), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind_of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind_of}, n_bytes long, n_tokens long, over_limit boolean")


def op9_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
