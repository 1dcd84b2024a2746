"""Operator 4: token ids in block files compressed by a static range asymmetric numeral system (rANS).

A block holds whole documents in order. Its ids are dealt over interleaved
lanes, each a 64-bit rANS state that gives out 32-bit words; the frequency
table is shared by all blocks of a data set. Each block carries its document
lengths, final lane states, checkpoints and a checksum, so any block decodes
alone and a block can be resumed at each checkpoint. Blocks are rows of a
Parquet data set, which every store that Spark writes can hold.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from kilnflow.llm.common import cut, mark, partitions, release, small_batches

LANES = 2048
#: Frequencies add up to 2 ** PROBABILITY_BITS; states stay at 2 ** 31 and above.
PROBABILITY_BITS = 20
_LOW = np.uint64(1 << 31)
#: A block closes when it has this many ids; a document is never split.
BLOCK_IDS = 1 << 18
#: A lane has this many ids at least, so that its state costs little beside them.
LANE_IDS = 128
#: Steps of all lanes between two checkpoints.
CHECKPOINT = 64
END_ID = 0
#: Bytes of pieces that a worker remembers in each of two generations, and what a piece with its ids takes of them.
REMEMBERED, _ENTRY = 128 << 20, 210
#: Characters of texts that the library gets at a time, and of texts whose pieces are looked up at a time.
_SLAB, _TOGETHER = 1 << 18, 1 << 22


def id_type(n_ids: int) -> str:
    """The narrowest little-endian type that holds all ids."""
    return "<u2" if n_ids <= 1 << 16 else "<u4"


@dataclass(frozen=True)
class Table:
    """Frequencies of all ids, none zero, and their running sums."""

    freq: np.ndarray
    start: np.ndarray
    slot: np.ndarray
    #: The frequencies add up to 2 ** bits.
    bits: int = PROBABILITY_BITS

    @staticmethod
    def of(counts: np.ndarray, bits: int = PROBABILITY_BITS) -> Table:
        """Scale counts to the fixed total; every id gets at least 1, the commonest takes up the rounding."""
        total = 1 << bits
        freq = np.maximum(1, counts.astype(np.float64) * (total - len(counts)) / max(1, counts.sum())).astype(np.int64)
        while (over := int(freq.sum()) - total) > 0:
            top = int(freq.argmax())
            freq[top] -= min(over, int(freq[top]) - 1)
        freq[freq.argmax()] += total - int(freq.sum())
        start = np.concatenate([[0], np.cumsum(freq)[:-1]])
        return Table(freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq), bits)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES) -> bytes:
    """A block's payload. Ids are dealt to lanes in turn; lanes are encoded last id first, so that decoding runs forward.

    Layout, little-endian: number of ids, lanes, words, checkpoints and steps
    between two of them (u32 each), lane states (u64), checkpoints of (word
    offset u32 and lane states u64), words (u32).
    """
    n = len(ids)
    lanes = max(1, min(lanes, n // LANE_IDS))
    steps = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    shift = np.uint64(63 - table.bits)
    for step in range(steps - 1, -1, -1):
        if step == steps - 1 or step % CHECKPOINT == CHECKPOINT - 1:  # what the ids of the steps up to a checkpoint need
            base = (step - step % CHECKPOINT) * lanes
            symbols = ids[base : (step + 1) * lanes]
            freq, start = table.freq[symbols], table.start[symbols]
            most, rest = freq << shift, np.uint64(1 << table.bits) - freq
        here = slice(step * lanes - base, (step + 1) * lanes - base)
        live = state[: len(freq[here])]
        spill = np.flatnonzero(live >= most[here])
        if len(spill):
            out = live[spill]
            words.append(out.astype(np.uint32))
            written += len(spill)
            live[spill] = out >> np.uint64(32)
        q = live // freq[here]
        q *= rest[here]
        live += q  # (q << bits) + live % freq
        live += start[here]
        if step and step % CHECKPOINT == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    head = np.array([n, lanes, len(stream), len(marks), CHECKPOINT], "<u4").tobytes()
    points = b"".join(np.array([written - w], "<u4").tobytes() + st.astype("<u8").tobytes() for w, st in reversed(marks))
    return head + state.astype("<u8").tobytes() + points + stream.astype("<u4").tobytes()


def decode(payload: bytes, table: Table, checkpoint: int = 0) -> np.ndarray:
    """The ids of a block, from its start or from a checkpoint (1, 2, ...) on."""
    n, lanes, n_words, n_marks, apart = (int(x) for x in np.frombuffer(payload, "<u4", 5))
    at = 20
    state = np.frombuffer(payload, "<u8", lanes, at).astype(np.uint64)
    at += 8 * lanes
    words = np.frombuffer(payload, "<u4", n_words, at + n_marks * (4 + 8 * lanes))
    step, w = 0, 0
    if checkpoint:
        at += (checkpoint - 1) * (4 + 8 * lanes)
        w, state, step = int(np.frombuffer(payload, "<u4", 1, at)[0]), np.frombuffer(payload, "<u8", lanes, at + 4).astype(np.uint64), checkpoint * apart
    out = np.empty(n, np.uint32)
    mask, bits = np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    for k in range(step * lanes, n, lanes):
        live = state[: min(lanes, n - k)]
        low = live & mask
        symbols = table.slot[low]
        out[k : k + len(live)] = symbols
        live = table.freq[symbols] * (live >> bits) + low - table.start[symbols]
        short = live < _LOW
        if m := int(short.sum()):
            live[short] = (live[short] << np.uint64(32)) | words[w : w + m]
            w += m
        state[: len(live)] = live
    return out[step * lanes :]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()  # documents stay whole
    tokenizer.no_truncation()
    return tokenizer


def cut_at_spaces(tokenizer) -> bool:
    """Whether ids of pieces cut before spaces join to the text's: byte-level BPE with the usual pattern and nothing before or beside it."""
    spec = json.loads(tokenizer.to_str())
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    return bool(plain and usual and spec["normalizer"] is None)


def n_ids_of(tokenizer) -> int:
    """One more than the largest id; a vocabulary may have gaps."""
    return max(tokenizer.get_vocab().values(), default=0) + 1


#: Marks that pre-tokens part from a letter before them.
_MARKS = ".,;:!?*$%&#|()\""
#: Begins a piece without a space before it, and stands between texts; texts that hold either are encoded whole.
_JOIN, _PART = "\x01", "\x02"
#: Stands for a word after which a text can't be cut into pieces: it is empty or begins with white space.
_BAD = False
#: Characters of the longest piece that is remembered.
_LONGEST = 64
#: Pieces that are encoded together.
_GROUP = 512


def _of_bytes(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text.encode())] = True
    return out


_LETTER = _of_bytes("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK, _ENDS = _of_bytes(_MARKS + "\n"), _of_bytes(_MARKS) | _LETTER


def _byte_characters() -> dict[int, str]:
    """The character that a byte-level token has for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in shown else next(others)) for b in range(256)}


_CHARACTERS = _byte_characters()
#: The same, but for the space that parts pieces and the sign before some.
_KEPT_APART = _CHARACTERS | {ord(x): x for x in (" ", _JOIN)}
_SPACE = _CHARACTERS[ord(" ")]


def cut_marks(text: bytes) -> np.ndarray:
    """The bytes of ``text``, which begins with _JOIN, with a space and _JOIN between letters and the mark or line end after them, and between a single line end and a letter.

    Pre-tokens end there, whatever comes before or after. Letters are those of
    ASCII, Latin-1 and Cyrillic; after others nothing is cut.
    """
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_MARK[data])
    last, lead = data[at - 1], data[at - 2]
    accented = (lead == 0xC3) & (last != 0x97) & (last != 0xB7)  # no signs of multiplication and division
    line = at[data[at] == 10]
    line = line[line + 1 < len(data)]
    line = line[_ENDS[data[line - 1]] & _LETTER[data[line + 1]]] + 1
    at = np.sort(np.concatenate([at[_LETTER[last] | accented | (lead == 0xD0) | (lead == 0xD1)], line]))
    gap = at + 2 * np.arange(len(at))
    out, rest = np.empty(len(data) + 2 * len(at), np.uint8), np.ones(len(data) + 2 * len(at), bool)
    out[gap], out[gap + 1] = ord(" "), ord(_JOIN)
    rest[gap] = rest[gap + 1] = False
    out[rest] = data
    return out


def distinct(data: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct pieces of UTF-8 that spaces end, in the order of their first, and which of them each piece is."""
    starts = np.concatenate([[0], np.flatnonzero(data == ord(" ")) + 1])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
    run = coded.dictionary.buffers()[2].to_pybytes().decode()
    return run.split(" ")[: len(coded.dictionary)], coded.indices.to_numpy()


class Encoder:
    """Ids of texts, by the tokenizers library, with pieces that recur kept in memory.

    In a byte-level pre-token a space comes first or among white space only. So
    where each space is followed by a mark that isn't white space, a text is cut
    before its spaces, and the pieces' ids join to the text's. They are cut at
    marks after letters, too, as pre-tokens are, so that a word is learnt once
    whatever follows it. Other texts, and those with special tokens, are encoded
    whole. New pieces are encoded many at a time, run together; as ids stand for
    bytes, their lengths tell where each piece's ids end. Words of letters alone
    are pre-tokens already and go to the file's model without its pattern.
    Tokenizers of any other kind (other models or patterns, normalisers, prefix
    spaces) get whole texts and nothing is kept.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = _tokenizer(path)
        self.encode_all = tokenizer.encode_batch_fast
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]  # these are found across pieces
        vocabulary = tokenizer.get_vocab()
        self.plain = cut_at_spaces(tokenizer) and all(x in vocabulary for x in _CHARACTERS.values())  # a byte without an id would be left out
        self.dtype = id_type(n_ids_of(tokenizer))
        self.lengths = np.zeros(n_ids_of(tokenizer), np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)  # one character of a byte-level token is one byte
        words = Tokenizer(tokenizer.model)
        words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.encode_words = words.encode_batch_fast
        self.known: dict[str, bytes | bool] = {}
        self.old: dict[str, bytes | bool] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        held: list[str] = []
        chars = 0
        for k, text in enumerate(texts, 1):
            held.append(text)
            chars += len(text)
            if chars >= _SLAB or k == len(texts):
                out += [np.array(e.ids, self.dtype).tobytes() for e in self.encode_all(held, add_special_tokens=False)]
                held, chars = [], 0
        return out

    def _keep(self, words: list[str], ids: list[int], sizes: Iterable[int]) -> None:
        """``ids`` of words run together, of so many bytes each."""
        data = np.array(ids, self.dtype)
        ends = np.searchsorted(np.cumsum(self.lengths[data]), np.cumsum(np.fromiter(sizes, np.int64, len(words))), side="right") * data.itemsize
        joined, ends = data.tobytes(), ends.tolist()
        self.known.update(zip(words, [joined[at:end] for at, end in zip([0, *ends], ends)]))

    def _together(self, words: list[str]) -> None:
        """Learn words, each after a space, that end without white space."""
        for at in range(0, len(words), _GROUP):
            group = words[at : at + _GROUP]
            self._keep(group, self.encode_all([" " + " ".join(group)], add_special_tokens=False)[0].ids, (len(w.encode()) + 1 for w in group))

    def _letters(self, words: list[str]) -> None:
        """Learn words of letters alone, after a space or _JOIN. The library's pattern may know fewer letters than Python beyond Latin-1."""
        wide = [w for w in words if not w.isascii()]
        near = [w for w in wide if max(w) <= "\xff"]
        far = [w for w in wide if max(w) > "\xff"] if len(near) < len(wide) else []
        for some in ([w for w in words if w.isascii()], near):
            for at in range(0, len(some), _GROUP):
                group = some[at : at + _GROUP]
                run = " ".join(group)
                if some is near:
                    run = run.encode().decode("latin-1").translate(_KEPT_APART)
                run = (_SPACE + run.replace(" ", " " + _SPACE)).replace(_SPACE + _JOIN, "")
                self._keep(group, self.encode_words([run], add_special_tokens=False)[0].ids, map(len, run.split(" ")))
        self._together([w for w in far if w[0] != _JOIN])
        self._alone([w for w in far if w[0] == _JOIN])

    def _alone(self, words: list[str]) -> None:
        self.known.update(zip(words, self.whole([w[1:] if w[0] == _JOIN else " " + w for w in words])))

    def learn(self, new: list[str]) -> list[str]:
        """Learn pieces; gives those that are too long to be remembered."""
        letters: list[str] = []
        joined: list[str] = []
        alone: list[str] = []
        known, get = self.known, self.old.get
        for word in new:
            ids = get(word)
            if ids is not None:
                known[word] = ids
            elif word.isalpha():
                letters.append(word)
            elif not word or word[0].isspace():
                known[word] = _BAD
            elif word[0] == _JOIN:
                (letters if word[1:].isalpha() else alone).append(word)
            else:
                (alone if word[-1].isspace() else joined).append(word)
        self._letters(letters)
        self._together(joined)
        self._alone(alone)
        return [w for w in new if len(w) > _LONGEST]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [np.frombuffer(x, self.dtype).astype("<u4").tobytes() for x in self.narrow(texts)]

    def narrow(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, as wide as the vocabulary needs."""
        if not self.plain:
            return self.whole(texts)
        if len(self.known) * _ENTRY > REMEMBERED:  # a new generation; pieces that recur move on to it
            self.old, self.known = self.known, {}
        odd = [_JOIN, _PART, *self.special]
        apart = [any(s in t for s in odd) for t in texts]
        plain = [t for t, x in zip(texts, apart) if not x]
        cut = self._pieced(plain) if plain else iter(())
        whole = iter(self.whole([t for t, x in zip(texts, apart) if x]))
        return [next(whole) if x else next(cut) for x in apart]

    def _pieced(self, texts: list[str]) -> Iterator[bytes]:
        """Each distinct piece is looked up once; Arrow joins the pieces' ids."""
        words, which = distinct(cut_marks(b"".join([f"{_JOIN}{t} {_PART} ".encode() for t in texts])))
        ids = list(map(self.known.get, words))
        lost = [i for i, x in enumerate(ids) if x is None]
        long = self.learn([words[i] for i in lost if words[i] != _PART])
        for i in lost:
            ids[i] = self.known.get(words[i])
        for word in long:
            del self.known[word]
        bad = np.array([x is _BAD for x in ids])
        parts = np.array([w == _PART for w in words])
        joined = pa.array([x or b"" for x in ids], pa.large_binary()).take(pa.array(which))
        offsets, data = np.frombuffer(joined.buffers()[1], np.int64, len(which) + 1), memoryview(joined.buffers()[2] or b"")
        ends = np.flatnonzero(parts[which])
        odd = np.zeros(len(ends), bool)
        odd[np.searchsorted(ends, np.flatnonzero(bad[which]))] = True
        starts = np.append(0, ends[:-1])  # _PART has no ids
        for text, whole, at, end in zip(texts, odd.tolist(), offsets[starts].tolist(), offsets[ends].tolist()):
            yield self.whole([text])[0] if whole else data[at:end].tobytes()


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for a worker process, whatever tasks it gets."""
    return Encoder(path)


def _forgetting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task after encoding; workers live on, so what they remember is given back before."""
    _encoder.cache_clear()
    yield from batches


_CHUNK = "shard int, seq long, ids binary, lengths array<long>, doc_ids array<long>, counts binary"


def pieces(text: str, special: list[str], most: int = 0) -> list[str]:
    """A long text in parts of about ``most`` characters whose ids join to the text's: cut before a single space between letters or digits; whole where it has special tokens."""
    most = most or _SLAB
    out, at = [], 0
    if len(text) > 2 * most and not any(s in text for s in special):
        while len(text) - at > 2 * most:
            z = text.find(" ", at + most)
            while z > 0 and not (text[z - 1].isalnum() and text[z + 1 : z + 2].isalnum()):
                z = text.find(" ", z + 1)
            if z < 0:
                break
            out.append(text[at:z])
            at = z
    return [*out, text[at:] if at else text]


def _encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, int | None, bytes]]:
    """(whether it is a document's last part, doc_id, ids) in order; texts are encoded some _TOGETHER characters at a time."""
    gc.freeze()  # the words that a worker remembers hold no cycles
    for b in batches:
        held: list[str] = []
        owner: list[tuple[bool, int | None]] = []
        chars = 0
        for i in range(b.num_rows):
            doc_id, text = b.column(0)[i].as_py(), b.column(1)[i].as_py() or ""
            parts = pieces(text, encoder.special) if encoder.plain else [text]
            for k, part in enumerate(parts):
                held.append(part)
                owner.append((k == len(parts) - 1, doc_id))
                chars += len(part)
                if chars >= _TOGETHER:
                    yield from ((*o, ids) for o, ids in zip(owner, encoder.narrow(held)))
                    held, owner, chars = [], [], 0
        yield from ((*o, ids) for o, ids in zip(owner, encoder.narrow(held)))


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Chunks of consecutive documents in ascending doc_id order: (shard, seq, ids, lengths, doc_ids, counts).

    ``ids`` are little-endian, as wide as the vocabulary needs, with ``end_id``
    after each document; null texts have that alone. A task's last row has seq
    -1 and the compressed counts of all its ids. Documents with equal doc_id
    follow by text hash, null ids come first; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seq = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        counts = np.zeros(len(encoder.lengths), np.int64)
        width, end = np.dtype(encoder.dtype).itemsize, np.array([end_id], encoder.dtype).tobytes()
        parts: list[bytes] = []
        lengths: list[int] = []
        doc_ids: list[int | None] = []
        size = begun = 0

        def row(seq: int, ids: bytes | None, counts: bytes | None) -> pa.RecordBatch:
            cols = [pa.array([shard], pa.int32()), pa.array([seq], pa.int64()), pa.array([ids], pa.binary()), pa.array([lengths], pa.list_(pa.int64())), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([counts], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["shard", "seq", "ids", "lengths", "doc_ids", "counts"])

        def chunk() -> pa.RecordBatch:
            data = b"".join(parts)
            counts[:] += np.bincount(np.frombuffer(data, encoder.dtype), minlength=len(counts))
            return row(seq, data, None)

        for last, doc_id, ids in _encoded(encoder, batches):
            parts.append(ids + end if last else ids)
            size += len(parts[-1]) // width
            if last:
                lengths.append(size - begun)
                doc_ids.append(doc_id)
                begun = size
                if size >= BLOCK_IDS:
                    yield chunk()
                    parts, lengths, doc_ids, size, begun, seq = [], [], [], 0, 0, seq + 1
        if lengths:
            yield chunk()
            parts, lengths, doc_ids, seq = [], [], [], seq + 1
        if seq:
            yield row(-1, None, zlib.compress(counts.astype("<i8").tobytes(), 1))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key_"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("key_")]
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "text").mapInArrow(run, _CHUNK)


def frequencies(chunks: DataFrame, n_ids: int) -> np.ndarray:
    """Counts of all ids, from the tasks' counts. What comes to the driver has one row per id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_ids, np.int64)
        for b in _forgetting(batches):
            for x in b.column(0):
                counts += np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids], pa.int64())], ["id", "n"])

    out = np.zeros(n_ids, np.int64)
    counts = chunks.filter("seq < 0").select("counts").coalesce(min(8, partitions(chunks.sparkSession)))
    for r in counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def write_blocks(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` into the data set at ``path``: blocks/ (a row per block) and table/ (the shared frequencies and the format's constants).

    Any tokenizer file of the library will do; ``end_id`` is one of its ids, or
    ValueError. Null texts are empty documents of one end id. Documents with equal doc_id
    follow by text hash; null ids come first. Each row is a document of its
    own; an empty table gives no blocks. Other columns are not kept.
    """
    spark = docs.sparkSession
    n_ids = n_ids_of(_tokenizer(tokenizer_path))
    if not 0 <= end_id < n_ids:
        raise ValueError(f"{end_id} is no id of the tokenizer")
    began = mark()
    chunks = cut(tokenize(docs, tokenizer_path, end_id), "token-chunks")
    counts, dtype = frequencies(chunks, n_ids), id_type(n_ids)
    shared = spark.sparkContext.broadcast(counts)
    meta = json.dumps({"probability_bits": PROBABILITY_BITS, "end_id": end_id})
    spark.createDataFrame([(meta, zlib.compress(counts.astype("<i8").tobytes()))], "meta string, counts binary").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.of(shared.value)
        for b in _forgetting(batches):
            payload, check = [], []
            for x in b.column(2):
                ids = np.frombuffer(x.as_py(), dtype).astype("<u4")
                payload.append(encode(ids, table))
                check.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(payload, pa.binary()), pa.array(check, pa.int64()), b.column(3), b.column(4), b.column(5)], ["shard", "seq", "payload", "crc32", "lengths", "doc_ids", "first"])

    # Places of blocks in the whole: sums over shards, then within each shard.
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    chunks = chunks.filter("seq >= 0")
    sizes = chunks.select("shard", "seq", n.alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select(F.col("shard").alias("s_"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    placed = sizes.join(F.broadcast(before), F.col("shard") == F.col("s_"))  # a row per partition of the range sort
    first = placed.select(F.col("shard").alias("c_"), F.col("seq").alias("q_"), (F.col("before") + F.sum("n").over(Window.partitionBy("shard").orderBy("seq")) - F.col("n")).alias("first"))
    first = cut(first, "token-places")
    rows = chunks.join(first, (F.col("shard") == F.col("c_")) & (F.col("seq") == F.col("q_"))).select("shard", "seq", "ids", "lengths", "doc_ids", "first")
    with small_batches(spark):
        rows.mapInArrow(run, "shard int, seq long, payload binary, crc32 long, lengths array<long>, doc_ids array<long>, first long").write.parquet(f"{path}/blocks")
    release(began)


def read_documents(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decode a data set: doc_id, start, n_tokens, ids_crc32 (and ids) of each document, also of null or repeated ids.

    A block whose checksum differs raises. A data set without blocks gives an empty result.
    """
    kept = spark.read.parquet(f"{path}/table").first()
    counts, bits = np.frombuffer(zlib.decompress(kept.counts), "<i8"), json.loads(kept.meta)["probability_bits"]
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.of(shared.value, bits)
        for b in _forgetting(batches):
            for k in range(b.num_rows):
                ids = decode(b.column(0)[k].as_py(), table).astype("<u4")
                if zlib.crc32(ids) != b.column(1)[k].as_py():
                    raise ValueError("a token block is damaged: its checksum differs")
                lengths = np.asarray(b.column(2)[k].as_py(), np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                cols = [pa.array(b.column(3)[k].as_py(), pa.int64()), pa.array(starts + b.column(4)[k].as_py()), pa.array(lengths), pa.array([zlib.crc32(ids[a:z]) for a, z in zip(starts, ends)], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([ids[a:z].astype(np.int64) for a, z in zip(starts, ends)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    blocks = spark.read.parquet(f"{path}/blocks").select("payload", "crc32", "lengths", "doc_ids", "first")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
