"""Byte-level BPE encoding and decoding, with tree concatenation for long text.

A text of more than ``block`` characters is cut into blocks, dealt over tasks and encoded there; its blocks are then put
together two by two, as a tree. At a join two things can differ from what the halves have, and each is settled by a
growing window:

* *Words* (what the pre-tokenizer parts). From the last word end that the left half's end can't have moved, words are cut
  anew in a window that doubles until one of its word starts is one of the right half's. Cutting looks forward only, so
  from there on both sides agree.
* *Tokens* of a word that runs over the join. The last tokens of the left and the first of the right are encoded anew, in
  a window that doubles until its first and last token are those that stood there. Merges are applied in order of rank,
  so a row of tokens is the encoding exactly if every two neighbours are the encoding of their bytes; in the window and
  in both halves they are, hence so is the whole (``Encoder`` checks that each merge comes after those of its parts).

A word of more than ``WORD_BYTES`` bytes, which the pre-tokenizer leaves unsplit, is encoded by halves in the same way inside
a block too. All other words of a slice of texts are encoded once each, with the library's model, and put in their places
by position; a worker keeps ``KEPT_WORDS`` words.

Null text counts as empty: no ids, an empty text. Added tokens (such as an end-of-text mark) are found in texts as the
library finds them. Rows are independent and repeated rows get equal results; equal long texts are encoded once. Texts of
any length are taken whole, and there are no ties. An empty table gives no rows. Only doc_id and text are read, so other
columns can't clash. The tokenizer file is read on the driver and broadcast (checked: ``MAX_FILE_BYTES``).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm.common import id_text, materialise, partitions, text_slices

#: Characters of a block, bytes of a word that is encoded at once, words that a worker keeps with their ids.
BLOCK, WORD_BYTES, KEPT_WORDS = 1 << 15, 1 << 11, 400_000
#: Characters and tokens on each side of a join that the first window has.
WINDOW_CHARS, WINDOW_TOKENS = 64, 4
MAX_FILE_BYTES = 64 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)
#: What may follow an apostrophe as a word of its own; a fixed value of the pre-tokenizer.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_names() -> list[str]:
    """The character that stands for each byte in tokens: itself where it is visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    further = iter(range(256, 512))
    return [chr(b if b in visible else next(further)) for b in range(256)]


class Piece(NamedTuple):
    """Text with its encoding: characters and tokens of each word, and ids."""

    text: str
    chars: np.ndarray
    tokens: np.ndarray
    ids: np.ndarray


def ends(counts: np.ndarray) -> np.ndarray:
    """0 and the running sums: where each of the counted runs begins, and the end."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


class Encoder:
    """A byte-level BPE tokenizer file of the tokenizers library. ``classes``: the kind of each code point."""

    def __init__(self, data: bytes, classes: np.ndarray | None = None):
        said = json.loads(data)
        model, cutter = said["model"], said["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or said["normalizer"] or cutter.get("type") != "ByteLevel" or cutter["add_prefix_space"] or not cutter.get("use_regex", True) or (said["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError("not a plain byte-level BPE tokenizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in said["added_tokens"]):
            raise ValueError("an added token has conditions")
        made = dict.fromkeys(byte_names(), -1)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if left not in made or right not in made:
                raise ValueError("a merge comes before those of its parts")
            made.setdefault(left + right, rank)
        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.classes = self.known_classes() if classes is None else classes
        self.added = {t["content"]: t["id"] for t in said["added_tokens"] if t["content"]}
        self.mark = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        names = byte_names()
        self.byte_of = {n: b for b, n in enumerate(names)}
        self.to_names = {b: ord(n) for b, n in enumerate(names)}
        self.token = model["vocab"] | {t["content"]: t["id"] for t in said["added_tokens"]}
        self.token = {i: t for t, i in self.token.items()}
        count = max(self.token, default=-1) + 1
        self.raw = pa.array([self.bytes_of(self.token.get(i, "")) for i in range(count)], pa.large_binary())
        self.written = pa.array([str(i) for i in range(count)], pa.large_string())
        self.place: dict[str, int] = {}
        self.known_ids, self.known_sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def known_classes(self) -> np.ndarray:
        """The kind of every code point, as the library's own pre-tokenizer parts it."""
        out = np.zeros(0x110000, np.uint8)
        code_points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for at in range(0, len(code_points), 1 << 9):
            some = code_points[at : at + (1 << 9)]
            if len(words(f"!{''.join(map(chr, some))}1")) == 2:
                continue  # all are OTHER, as most code points that are not assigned
            if len(words(f"a{''.join(map(chr, some))}1")) == 2:
                out[some] = LETTER
                continue
            # with "a" before: a letter joins it; with "!" before: what is neither letter, number nor space does; before "1": a number
            starts = {a for _, (a, _) in words("".join(f"a{chr(c)}1!{chr(c)}1" for c in some))}
            for i, c in enumerate(some):
                base = 6 * i
                if base + 1 not in starts:
                    out[c] = LETTER
                elif base + 4 not in starts:
                    out[c] = OTHER
                elif base + 2 not in starts and c != 32:
                    out[c] = NUMBER
                else:
                    out[c] = SPACE
        return out

    def bytes_of(self, token: str) -> bytes:
        try:
            return bytes(self.byte_of[c] for c in token)
        except KeyError:
            return token.encode()

    # words

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts end to end, the first byte and character of each word, with the ends."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = len(codes)
        data = np.frombuffer(joined.encode(), np.uint8)
        if not n:
            return data, np.zeros(1, np.int64), np.zeros(1, np.int64)
        heads = np.array([0, *accumulate(map(len, texts))], np.int64)
        head = np.zeros(n + 1, bool)
        head[heads] = True
        kind = self.classes[codes]
        start = head.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        # a run of spaces leaves its last character to what follows it, and a blank goes with that
        run_end = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n]
        last = np.flatnonzero(run_end)
        start[last] = True
        blank = last[codes[last] == 32]
        start[blank + 1] = False
        # an apostrophe at the beginning of its run, and not after a blank, with one of the endings
        mark = np.flatnonzero((codes[:-1] == 39) & start[: n - 1]) if n > 1 else np.zeros(0, np.int64)
        mark = mark[(mark == 0) | head[mark] | (kind[mark - 1] != OTHER)]
        for ending in ENDINGS:
            at, stop = mark, mark + 1 + len(ending)
            fits = stop <= n
            at, stop = at[fits], stop[fits]
            for j, letter in enumerate(ending, 1):
                same = (codes[at + j] == ord(letter)) & ~head[at + j]
                at, stop = at[same], stop[same]
            start[at + 1] = False
            start[stop] = True
        chars = np.flatnonzero(start)
        sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        return data, ends(sizes)[chars], chars

    def encode_word(self, word: str) -> np.ndarray:
        """Ids of what the pre-tokenizer leaves together, by halves if it is long."""
        if len(word) > WORD_BYTES or len(raw := word.encode()) > WORD_BYTES:
            half = len(word) // 2
            return self.concatenated(self.encode_word(word[:half]), self.encode_word(word[half:]))
        return np.array([t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.to_names))], np.int32)

    def concatenated(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two encodings' bytes end to end, of one word."""
        wide = WINDOW_TOKENS
        while len(left) and len(right):
            a, b = left[-wide:], right[:wide]
            again = [t.id for t in self.model.tokenize("".join(map(self.token.__getitem__, [*a.tolist(), *b.tolist()])))]
            if (wide >= len(left) or again[0] == a[0]) and (wide >= len(right) or again[-1] == b[-1]):
                return np.concatenate([left[: max(0, len(left) - wide)], np.array(again, np.int32), right[wide:]])
            wide *= 2
        return np.concatenate([left, right])

    # texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts end to end, the number of tokens of each word, and the first character of each word, with the
        end; of texts without added tokens."""
        data, first, chars = self.words(texts)
        words = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(first), pa.py_buffer(data)).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        at = np.array([self.place.get(w, -1) for w in distinct], np.int64)
        tail = np.flatnonzero(at < 0)
        new = [distinct[i] for i in tail]
        found = [self.encode_word(w) for w in new]
        ids = np.concatenate([self.known_ids, *found])
        sizes = np.concatenate([self.known_sizes, np.array([len(f) for f in found], np.int64)])
        at[tail] = len(self.known_sizes) + np.arange(len(tail))
        begin = np.cumsum(sizes) - sizes
        place = at[words.indices.to_numpy(zero_copy_only=False)]
        tokens = sizes[place]
        flat = ids[np.arange(tokens.sum()) + np.repeat(begin[place] - (np.cumsum(tokens) - tokens), tokens)]
        self.keep(new, found)
        return flat, tokens, chars

    def keep(self, new: list[str], found: list[np.ndarray]) -> None:
        keep = [i for i, w in enumerate(new) if len(w) <= 64][: KEPT_WORDS - len(self.place)]
        self.place |= {new[i]: len(self.place) + k for k, i in enumerate(keep)}
        self.known_ids = np.concatenate([self.known_ids, *(found[i] for i in keep)])
        self.known_sizes = np.concatenate([self.known_sizes, np.array([len(found[i]) for i in keep], np.int64)])

    def sections(self, text: str) -> list[tuple[str, int]]:
        """The text between added tokens, and those (with their id; text: -1)."""
        if self.mark is None or not self.mark.search(text):
            return [(text, -1)]
        out, at = [], 0
        for m in self.mark.finditer(text):
            out += [(text[at : m.start()], -1), (m[0], self.added[m[0]])]
            at = m.end()
        return [s for s in [*out, (text[at:], -1)] if s[0]]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts end to end, and where each text's begin, with the end."""
        parts = [self.sections(t) for t in texts] if self.mark and self.mark.search("\0".join(texts)) else [[(t, -1)] for t in texts]
        plain = [s for s, token in chain.from_iterable(parts) if token < 0]
        flat, tokens, chars = self.encode(plain)
        own = ends(tokens)[np.searchsorted(chars, ends(np.array([len(s) for s in plain], np.int64)))]
        if len(plain) == len(texts) and all(len(p) == 1 for p in parts):
            return flat, own
        out, sizes, at = [], [], 0
        for part in parts:
            sizes.append(0)
            for _, token in part:
                out.append(flat[own[at] : own[at + 1]] if token < 0 else np.array([token], np.int32))
                at += token < 0
                sizes[-1] += len(out[-1])
        return np.concatenate([np.zeros(0, np.int32), *out]), ends(np.array(sizes, np.int64))

    def decode(self, flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """The bytes of each run of ids."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), self.raw.take(pa.array(flat))), pa.scalar(b"", pa.large_binary()))

    def write(self, flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """Ids in decimals, joined by commas."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(cuts), self.written.take(pa.array(flat))), pa.scalar(",", pa.large_string()))

    # tree concatenation

    def piece(self, text: str) -> Piece:
        flat, tokens, chars = self.encode([text])
        return Piece(text, np.diff(chars), tokens, flat)

    def join(self, a: Piece, b: Piece) -> Piece:
        """Two neighbouring pieces of a text as one."""
        if not a.text or not b.text:
            return b if not a.text else a
        a_ends, b_ends = ends(a.chars), ends(b.chars)
        length = len(a.text)
        kept = int(np.searchsorted(a_ends, length - 2, side="right")) - 1 if length > 1 else 0
        begin = int(a_ends[kept])
        join, wide = length - begin, WINDOW_CHARS
        while True:
            text = a.text[begin:] + b.text[:wide]
            starts = self.words([text])[2]
            # word starts in the right half that the window's end can't have moved
            sure = starts[(starts >= join) & ((starts <= len(text) - 2) | (wide >= len(b.text)))]
            agreed = sure[np.isin(sure - join, b_ends)]
            if len(agreed):
                break
            wide *= 2
        stop = int(agreed[0])
        taken = int(np.searchsorted(b_ends, stop - join))
        cuts = starts[starts <= stop]
        ids = []
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if s < join < e and e - s > WORD_BYTES // 4:
                # a word over the join: of each half's own encoding of its side where it has one
                left = a.ids[len(a.ids) - a.tokens[-1] :] if s + begin == a_ends[-2] else self.encode_word(text[s:join])
                right = b.ids[: b.tokens[0]] if e - join == b_ends[1] else self.encode_word(text[join:e])
                ids.append(self.concatenated(left, right))
            else:
                ids.append(self.encode_word(text[s:e]))
        sizes = np.array([len(i) for i in ids], np.int64)
        return Piece(
            a.text + b.text,
            np.concatenate([a.chars[:kept], np.diff(cuts), b.chars[taken:]]),
            np.concatenate([a.tokens[:kept], sizes, b.tokens[taken:]]),
            np.concatenate([a.ids[: a.tokens[:kept].sum()], *ids, b.ids[b.tokens[:taken].sum() :]]).astype(np.int32),
        )

    def tree(self, pieces: list[Piece]) -> Piece:
        """Neighbours joined level by level."""
        while len(pieces) > 1:
            pieces = [self.join(*pieces[i : i + 2]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
        return pieces[0]


#: The encoder of this worker process, by its file: a worker's next task goes on with it and its words.
_encoder: dict[str, Encoder] = {}


def encoder_of(name: str, shared) -> Encoder:
    if name not in _encoder:
        _encoder.clear()
        _encoder[name] = Encoder(*shared.value)
    return _encoder[name]


def sha(values: pa.Array, text: bool = False) -> pa.Array:
    """SHA-256 of each value; of decoded text, what is no UTF-8 counts as U+FFFD."""
    data, cuts = memoryview(values.buffers()[2] or b""), np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    read = lambda raw: bytes(raw).decode("utf-8", "replace").encode() if text else raw
    return pa.array([hashlib.sha256(read(data[a:b])).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string())


RESULT = "n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string"
NAMES = ["n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]


def encode(df: DataFrame, file: str, keep_ids: bool = True, keep_text: bool = True, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, ids (null unless ``keep_ids``), ids_sha256, decoded (null unless ``keep_text``) and decoded_sha256
    of every row of ``df``."""
    with open(file, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"the tokenizer file is over {MAX_FILE_BYTES} bytes; it is not to be broadcast")
    name = hashlib.sha256(data).hexdigest()
    spark, docs = df.sparkSession, id_text(df)
    shared, count = spark.sparkContext.broadcast((data, Encoder(data).classes)), partitions(spark)

    def results(encoder: Encoder, flat: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
        decoded = encoder.decode(flat, cuts)
        n = len(cuts) - 1
        return [
            pa.array(np.diff(cuts)),
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat)) if keep_ids else pa.nulls(n, pa.list_(pa.int32())),
            sha(encoder.write(flat, cuts)),
            pa.array([raw.decode("utf-8", "replace") for raw in decoded.to_pylist()] if keep_text else [None] * n, pa.string()),
            sha(decoded, text=True),
        ]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, shared)
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = results(encoder, *encoder.encode_texts(pc.fill_null(part.column(1), "").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["doc_id", *NAMES])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, shared)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for key, text in zip(*(c.to_pylist() for c in part.columns)):
                    sections = encoder.sections(text)
                    rows = [(s, at, section[at : at + block], token) for s, (section, token) in enumerate(sections) for at in range(0, len(section), block)]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int32()))]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.string()), *columns], names=["key", "section", "at", "text", "token"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, shared)
        for batch in batches:
            for part in text_slices(batch, "text"):
                pieces = [encoder.piece(t) if token < 0 else Piece(t, *(np.array([x], np.int32) for x in (len(t), 1, token))) for t, token in zip(part.column(3).to_pylist(), part.column(4).to_pylist())]
                columns = [pa.array([x.astype(np.int32) for x in c], pa.list_(pa.int32())) for c in (([p[i] for p in pieces]) for i in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *columns], names=["key", "section", "at", "text", "chars", "tokens", "ids"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, key, section, done, held = encoder_of(name, shared), None, None, [], []

        def close() -> pa.RecordBatch:
            flat = np.concatenate([*done, encoder.tree(held).ids]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([key]), *results(encoder, flat, np.array([0, len(flat)], np.int64))], names=["key", *NAMES])

        for batch in batches:
            for i in range(batch.num_rows):
                now, of, _, text = (batch.column(c)[i].as_py() for c in range(4))
                piece = Piece(text, *(batch.column(c)[i].values.to_numpy() for c in (4, 5, 6)))
                if held and now != key:
                    yield close()
                    done, held = [], []
                elif held and of != section:
                    done.append(encoder.tree(held).ids)
                    held = []
                key, section = now, of
                held.append(piece)
        if held:
            yield close()

    long = F.char_length("text") > block
    short = docs.filter(~F.coalesce(long, F.lit(False))).mapInArrow(whole, f"doc_id long, {RESULT}")
    keyed = docs.filter(long).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    blocks = texts.select("key", "text").mapInArrow(cut, "key string, section long, at long, text string, token int").repartition(count, "key", "section", "at")
    encoded = blocks.mapInArrow(leaves, "key string, section long, at long, text string, chars array<int>, tokens array<int>, ids array<int>")
    joined = encoded.repartition(count, "key").sortWithinPartitions("key", "section", "at").mapInArrow(trees, f"key string, {RESULT}")
    return short.unionByName(keyed.select("doc_id", "key").join(materialise(joined, "long-texts"), "key").select("doc_id", *NAMES))
