"""Token ids in binary files: Simple-8b words in blocks, written in order of the documents.

A word has 64 bits: a selector of four and a payload of sixty, which holds 60, 30, 20, 15, 12, 10, 8,
7, 6, 5, 4, 3, 2 or 1 ids of equal width. Selector 0 is an escape: its payload is the place of an id
of more than sixty bits in the list of escapes at the end of the file. A block holds BLOCK ids and
starts with a word of its own; offsets of blocks and documents allow any of them to be decoded alone.

Defined results: a null text is the empty text, which has the end id alone; null ids come first;
rows of equal id are told apart by their text and each has a row of its own; an empty table has no
file; other columns take no part. Texts of any length are encoded in pieces that end where the
tokenizer's own words end.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import id_text, shared_dir, written

#: Ids of a block, and of a file (a document isn't split, so a file of one document may hold more).
BLOCK, FILE_IDS = 1024, 1 << 22
#: Ids that one word holds, by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, *(60 // COUNTS[1:])])
PAD = 60
#: Blocks that are packed at once.
SIDE_BY_SIDE = 1024
MAGIC = b"TMTOK8B1"
#: Words that a worker knows, and ids of the longest one that stays known.
KNOWN, LONGEST = 1 << 20, 200
#: A word of letters, of ASCII and from U+00C0 to U+00FF, with a space or none before it.
WORD = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Bytes of texts that are cut at once.
AT_ONCE = 1 << 23


#: Bits of numbers below 2^16.
_SHORT = np.concatenate([[0], np.repeat(np.arange(1, 17), 1 << np.arange(16))]).astype(np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    if ids.max(initial=0) < len(_SHORT):
        return _SHORT[ids]
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    large = ids >= np.uint64(1 << 53)  # where a double may round up
    if large.any():
        bits[large] = np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), ids[large], side="right")
    return bits


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block and the end, escapes) of ids below 2^64."""
    words, offsets, escapes, n, m = [], [np.zeros(1, np.uint64)], [], 0, 0
    for k in range(0, len(ids), SIDE_BY_SIDE * BLOCK):
        w, o, e = _pack_some(np.ascontiguousarray(ids[k:k + SIDE_BY_SIDE * BLOCK], dtype=np.uint64), m)
        words.append(w)
        offsets.append(o[1:] + np.uint64(n))
        escapes.append(e)
        n, m = n + len(w), m + len(e)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(none + words), np.concatenate(offsets), np.concatenate(none + escapes)


def _pack_some(ids: np.ndarray, escaped: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word takes as many ids as fit. All blocks are cut side by side, a word of each at a time."""
    n_blocks = -(-len(ids) // BLOCK)
    row = BLOCK + PAD
    values = np.zeros((n_blocks, row), np.uint64)
    whole = len(ids) // BLOCK
    values[:whole, :BLOCK] = ids[:whole * BLOCK].reshape(whole, BLOCK)
    if whole < n_blocks:
        values[whole, :len(ids) - whole * BLOCK] = ids[whole * BLOCK:]
    values = values.reshape(-1)
    widths = _bits(values)
    escapes = np.flatnonzero(widths > 60)
    # The widest of the next c ids at each place, for c ascending; the last c that fits is taken.
    best, widest, c = np.zeros(len(values), np.uint8), widths, 1
    for selector in range(14, 0, -1):
        while c < COUNTS[selector]:
            step = min(c, int(COUNTS[selector]) - c)
            widest = np.maximum(widest, np.append(widest, np.zeros(step, np.uint8))[step:])
            c += step
        np.putmask(best, widest <= WIDTHS[selector], selector)
    ends = np.minimum(np.arange(n_blocks) * row + BLOCK, np.arange(n_blocks) * row + len(ids) - np.arange(n_blocks) * BLOCK)
    at, starts = np.arange(n_blocks) * row, []
    while len(at):
        starts.append(at)
        at = at + COUNTS[best[at]]
        open_blocks = at < ends
        at, ends = at[open_blocks], ends[open_blocks]
    starts = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    selectors = best[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors):
        own = np.flatnonzero(selectors == selector)
        if selector:
            first, payload = starts[own], values[starts[own]]
            for j in range(1, COUNTS[selector]):
                payload |= values[first + j] << np.uint64(j * WIDTHS[selector])
            words[own] |= payload
        else:
            words[own] |= (np.searchsorted(escapes, starts[own]) + escaped).astype(np.uint64)
    return words, np.searchsorted(starts, np.arange(n_blocks + 1) * row).astype(np.uint64), values[escapes]


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The n ids of whole blocks, whose words start at `offsets`."""
    n_blocks, row = len(offsets) - 1, BLOCK + PAD
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    upto = np.cumsum(counts) - counts
    of = np.repeat(np.arange(n_blocks), np.diff(offsets.astype(np.int64)))
    starts = upto - upto[offsets[:-1].astype(np.int64)][of] + of * row if len(words) else upto
    small = not len(words) or WIDTHS[selectors].max() <= 32 and (selectors > 0).all()
    out = np.zeros(n_blocks * row, np.uint32 if small else np.uint64)
    for selector in np.unique(selectors):
        own = np.flatnonzero(selectors == selector)
        first, payload = starts[own], words[own] & np.uint64((1 << 60) - 1)
        if selector:
            mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
            for j in range(COUNTS[selector]):
                out[first + j] = (payload >> np.uint64(j * WIDTHS[selector])) & mask
        else:
            out[first] = escapes[payload.astype(np.int64)]
    return out.reshape(n_blocks, row)[:, :BLOCK].reshape(-1)[:n]


def to_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    """A file: magic, six numbers, documents, offsets of blocks, words, escapes, a checksum; all little-endian 64 bits."""
    words, offsets, escapes = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(offsets) - 1, len(words), len(escapes), before], "<u8")
    known = np.array([x is not None for x in doc_ids], "<u8")
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    body = MAGIC + b"".join(x.tobytes() for x in (head, names, known, counts.astype("<u8"), offsets.astype("<u8"), words.astype("<u8"), escapes.astype("<u8")))
    return body + np.array([zlib.crc32(body)], "<u8").tobytes()


class TokenFile:
    """A file's parts; ids are decoded when they are asked for."""

    def __init__(self, data: bytes | memoryview, check: bool = True):
        view = memoryview(data)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a file of token ids")
        if check and zlib.crc32(view[:-8]) != int.from_bytes(view[-8:], "little"):
            raise ValueError("a file of token ids is damaged")
        numbers = np.frombuffer(view, "<u8")
        n_docs, self.n_ids, n_blocks, n_words, n_escapes, self.before = map(int, numbers[1:7])
        parts = np.split(numbers[7:-1], np.cumsum([n_docs, n_docs, n_docs, n_blocks + 1, n_words]))
        self.names, self.known, self.counts = parts[0].view("<i8"), parts[1] == 1, parts[2].astype(np.int64)
        self.offsets, self.words, self.escapes = parts[3:6]

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from place `first` to before `last`; only the blocks that hold them are decoded."""
        last = self.n_ids if last is None else min(last, self.n_ids)
        if first >= last:
            return np.zeros(0, np.uint64)
        a, b = first // BLOCK, -(-last // BLOCK)
        own = self.offsets[a:b + 1].astype(np.int64)
        found = unpack(self.words[own[0]:own[-1]], own - own[0], min(b * BLOCK, self.n_ids) - a * BLOCK, self.escapes)
        return found[first - a * BLOCK:last - a * BLOCK]


class Words:
    """The ids of texts by a tokenizer; each distinct word is encoded once in a worker, as long as it is known.

    Byte-level BPE encodes words apart, and its words end before white space and between a letter and
    a mark. Texts are cut there, as far as bytes tell it for sure; a cut left out changes nothing.
    Other kinds of tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        self.cuts = (kind["model"]["type"] == "BPE" and kind.get("normalizer") is None and before.get("type") == "ByteLevel"
                     and before.get("use_regex", True) and not before.get("add_prefix_space", True))
        # Byte-level models show each byte as a character: printable ones as they are, others from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = {b: 0x100 + n for n, b in enumerate(b for b in range(256) if b not in plain)}
        self._keep(np.zeros(0, np.int64))

    def _keep(self, places: np.ndarray) -> None:
        """Only the words at these places stay known."""
        if len(places):
            words = list(self.known)
            some = [self.flat[self.ends[k]:self.ends[k + 1]] for k in places]
            self.known = {words[k]: n for n, k in enumerate(places)}
            self.flat, self.ends, self.uses = np.concatenate(some), np.concatenate([[0], np.cumsum([len(x) for x in some])]), self.uses[places]
        else:
            self.known: dict[bytes, int] = {}  # in order of their places
            self.flat, self.ends, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _encoded(self, words: pa.Array) -> tuple[list[int], list[int]]:
        """(the ids of the words in turn, how many each has): words of letters alone by the tokenizer's model, others by all its steps."""
        plain = pc.match_substring_regex(words, WORD)
        ascii_ = pc.string_is_ascii(words)
        shown = pc.if_else(pc.and_(plain, ascii_), pc.replace_substring(words, " ", chr(self.shown[0x20])), words).to_pylist()
        tokenize = self.tokenizer.model.tokenize
        ids, other = [], []
        for k, (w, one, short) in enumerate(zip(shown, plain.to_pylist(), ascii_.to_pylist())):
            if one:
                ids.append([x.id for x in tokenize(w if short else w.encode().decode("latin-1").translate(self.shown))])
            else:
                ids.append([])
                other.append(k)
        for k, e in zip(other, self.tokenizer.encode_batch_fast([shown[k] for k in other], add_special_tokens=False)):
            ids[k] = e.ids
        return list(chain.from_iterable(ids)), list(map(len, ids))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of distinct words are; new ones are known from now on."""
        if len(self.known) > KNOWN or len(self.flat) > 16 * KNOWN:  # what came up again stays, if it is not too much
            often = max(2, int(np.sort(self.uses)[-(KNOWN // 2):][0]) + 1)
            self._keep(np.flatnonzero((self.uses >= often) & (np.diff(self.ends) <= LONGEST)))
        names = words.to_pylist()
        places = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(places < 0)
        if len(new):
            ids, sizes = self._encoded(words.take(pa.array(new)).cast(pa.string()))
            places[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip((names[k] for k in new), places[new].tolist()))
            self.flat, self.ends = np.concatenate([self.flat, np.array(ids, np.uint32)]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[places] += 1
        return places

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (a string array without nulls)."""
        if not self.cuts:
            for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False):
                yield np.array(e.ids, np.uint32)
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        starts = np.zeros(len(data) + 1, bool)
        starts[word_cuts(data)] = starts[offsets] = True
        cuts = np.flatnonzero(starts)
        parts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        places, of = self._places(parts.dictionary), parts.indices.to_numpy()
        # A slice and what is known have fewer ids than an int has values.
        starts, sizes = self.ends[places].astype(np.int32)[of], np.diff(self.ends)[places].astype(np.int32)[of]
        upto = np.cumsum(sizes, dtype=np.int32)
        ids = self.flat[np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)]
        at = np.concatenate([[0], upto])[np.searchsorted(cuts, offsets)]
        for a, b in zip(at[:-1], at[1:]):
            yield ids[a:b]


def _bytes_of(*ranges: tuple[int, int]) -> np.ndarray:
    found = np.zeros(256, bool)
    for a, b in ranges:
        found[a:b + 1] = True
    return found


#: White space, and the marks . , ; : ! ? before which a word ends.
SPACES, MARKS = _bytes_of((9, 13), (32, 32)), _bytes_of((0x2E, 0x2E), (0x2C, 0x2C), (0x3A, 0x3B), (0x21, 0x21), (0x3F, 0x3F))
LETTERS = _bytes_of((0x41, 0x5A), (0x61, 0x7A))
#: ASCII that is no white space for anyone; first bytes of characters of two and of three that are none; four bytes never are.
SOLID, TWO, THREE = _bytes_of((0, 8), (14, 27), (33, 127)), _bytes_of((0xC3, 0xDF)), _bytes_of((0xE0, 0xE0), (0xE4, 0xED))
ENDS = SPACES | MARKS


def word_cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 text before which a word starts for sure.

    That is white space after a character that is none, and a mark after a letter. Of characters
    beyond ASCII only those count whose first byte shows that they aren't white space.
    """
    out = [np.zeros(0, np.int64)]
    for k in range(0, len(data), AT_ONCE):
        first = max(0, k - 4)
        b = data[first:k + AT_ONCE]
        at = np.flatnonzero(ENDS[b])
        at = at[at >= max(1, k - first)]
        one = b[at - 1]
        high = one >= 0x80
        space = SPACES[b[at]]
        good = np.where(space, SOLID[one], LETTERS[one])
        if high.any():
            own = np.flatnonzero(high & (at >= 2))
            last, two = one[own], b[at[own] - 2]
            three = np.where(at[own] >= 3, b[at[own] - 3], 0)
            four = np.where(at[own] >= 4, b[at[own] - 4], 0)
            solid = TWO[two] | ((two >= 0x80) & (two < 0xC0) & (THREE[three] | ((three >= 0x80) & (three < 0xC0) & (four >= 0xF0))))
            latin = (two == 0xC3) & (last != 0x97) & (last != 0xB7)
            good[own] = np.where(space[own], solid, latin)
        out.append(at[good] + first)
    return np.concatenate(out)


#: Of this worker: what it has learnt serves its later tasks too.
_encoders: dict[str, Words] = {}


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """`docs` (doc_id, text) as files of token ids in `folder`; the manifest, one row for each file.

    Texts are dealt out by ranges of their id, so files in order of (part, number) hold documents in
    order of their ids. A file gets its name when it is complete, and a task that runs again writes
    the same files. `folder` can be a URI of any file system that pyarrow knows.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Words(tokenizer)
        words = _encoders[tokenizer]
        store, base = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        names: list[int | None] = []
        held: list[np.ndarray] = []
        state = {"ids": 0, "before": 0, "number": 0}

        def flush() -> pa.RecordBatch:
            data = to_bytes(names, np.array([len(x) for x in held], np.int64), np.concatenate(held), state["before"])
            path, own = f"{base}/part-{part:06d}-{state['number']:06d}.tok", f"{base}/_{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(data)
            store.move(own, path)
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [state["number"]], "path": [path], "n_docs": [len(names)], "n_ids": [state["ids"]], "n_bytes": [len(data)]}, schema=MANIFEST)
            state.update(ids=0, before=state["before"] + state["ids"], number=state["number"] + 1)
            names.clear()
            held.clear()
            return row

        for b in batches:
            own, texts = b.column("doc_id"), b.column("text").cast(pa.string())
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            first = 0
            while first < len(own):
                n = max(1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + AT_ONCE, side="right")) - first)
                for name, ids in zip(own[first:first + n].to_pylist(), words(texts[first:first + n])):
                    if names and state["ids"] + len(ids) + 1 > file_ids:
                        yield flush()
                    names.append(name)
                    held.append(np.append(ids, np.uint32(end_id)))
                    state["ids"] += len(ids) + 1
                first += n
        if names:
            yield flush()

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    rows = id_text(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return written(rows.mapInArrow(write, "part long, number long, path string, n_docs long, n_ids long, n_bytes long"), "token-manifest")


MANIFEST = pa.schema([(c, pa.string() if c == "path" else pa.int64()) for c in ("part", "number", "path", "n_docs", "n_ids", "n_bytes")])


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if asked for, the ids. Only one number for each part is gathered on the driver."""
    totals = {r.part: (r.n, r.files) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).collect()}
    before, upto, files = {}, 0, sum(f for _, f in totals.values())
    for part in sorted(totals):
        before[part] = upto
        upto += totals[part][0]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for part, path in zip(b.column("part").to_pylist(), b.column("path").to_pylist()):
                with store.open_input_file(path) as f:
                    found = TokenFile(f.read())
                ends = np.cumsum(found.counts)
                starts = ends - found.counts
                for k in range(0, len(ends), 4096):  # blocks of the file are decoded some documents at a time
                    first = int(starts[k])
                    some = slice(k, k + 4096)
                    ids = found.ids(first, int(ends[some][-1])).astype("<u4", copy=False)
                    own = [ids[s - first:e - first] for s, e in zip(starts[some], ends[some])]
                    columns = [pa.array(found.names[some], pa.int64(), mask=~found.known[some]), pa.array(starts[some] + (before[part] + found.before)),
                               pa.array(found.counts[some]), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    return manifest.select("part", "path").repartition(max(1, min(files, 10_000))).mapInArrow(read, schema)


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of all documents, written to files of the shared folder and read back."""
    import public_tokenizers

    folder = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(manifest, folder)
