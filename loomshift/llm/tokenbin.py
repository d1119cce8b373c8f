"""Token ids in binary files: Simple-8b words in blocks, with offsets for vectorised decoding.

File format, little-endian throughout:

- ``LSW1``, four zero bytes
- blocks of up to BLOCK ids, each a run of 64-bit words. The top four bits of a word select how many ids of how many bits
  its other sixty hold, lowest bits first. Selector 0 is an escape: one id fills the whole next word. The last word of a
  block may be padded with zeros; ids beyond the block's count are padding.
- the footer: int64 arrays of the blocks' byte offsets and id counts, of the documents' ids and id counts, and a byte for
  each document that is 1 where its doc_id is null
- int64: number of blocks, number of documents; ``LSW1END.``
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Ids a word holds by selector, and the bits of each.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: By the bits of an id, the least bits of a selector that hold it.
WIDTH_OF = np.array([min((b for b in BITS[1:].tolist() if b >= n), default=64) for n in range(66)], np.uint8)
MAGIC, END = b"LSW1\0\0\0\0", b"LSW1END."
BLOCK = 65536
#: Chunks beyond which a worker forgets what it has kept, and the longest that it keeps beyond the text at hand.
KEPT_CHUNKS, KEPT_LENGTH = 900_000, 48


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of the ids of one block (unsigned 64-bit)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    # The most ids that fit from each place on: selectors in falling order of bits, the densest that fits wins.
    width = WIDTH_OF[np.frexp(ids.astype(np.float64))[1]]  # rounding may widen ids beyond 2^53, which still decode
    choice = np.zeros(n, np.uint8)
    choice[width <= 60] = len(COUNTS) - 1
    for selector in range(len(COUNTS) - 2, 0, -1):
        fits = width <= BITS[selector]
        run, reach = int(COUNTS[selector]), 1
        while reach < run and fits.any():  # all of the next `run` ids fit; what lies beyond the end is padding
            step = min(reach, run - reach)
            if step < n:
                fits[: n - step] &= fits[step:]
            reach += step
        if fits.any():
            choice[fits] = selector
    jump = COUNTS[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += jump[at]
    starts = np.array(starts)
    chosen = choice[starts]
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(chosen == 0)[:-1]))
    words = np.zeros(len(starts) + int((chosen == 0).sum()), np.uint64)
    padded = np.concatenate((ids, np.zeros(64, np.uint64)))
    for selector in np.unique(chosen).tolist():
        here, where = starts[chosen == selector], place[chosen == selector]
        if selector == 0:
            words[where + 1] = ids[here]
            continue
        word = np.full(len(here), selector << 60, np.uint64)
        for k in range(int(COUNTS[selector])):
            word |= padded[here + k] << np.uint64(k * int(BITS[selector]))
        words[where] = word
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    words = np.asarray(words, dtype="<u8")
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == 0).any():  # what follows an escape is no selector
        payload, escaped = np.zeros(len(words), bool), np.flatnonzero(selector == 0)
        for k in escaped.tolist():
            if not payload[k]:
                payload[k + 1] = True
        head = np.flatnonzero(~payload)
    else:
        head = np.arange(len(words))
    chosen = selector[head]
    count = COUNTS[chosen]
    place = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(place[-1]), np.uint64)
    for s in np.unique(chosen).tolist():
        mine = chosen == s
        where = place[:-1][mine]
        if s == 0:
            out[where] = words[head[mine] + 1]
            continue
        word, mask = words[head[mine]], np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[where + k] = (word >> np.uint64(k * int(BITS[s]))) & mask
    return out[:n]


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class TokenFile:
    """Writes one file of documents' ids; memory holds one block and the documents' counts."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        self.pending: list[np.ndarray] = []
        self.waiting = 0
        self.blocks: list[tuple[int, int]] = []
        self.docs: list[tuple[int | None, int]] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            all_ids = np.concatenate(self.pending)
            full = len(all_ids) // BLOCK * BLOCK
            for k in range(0, full, BLOCK):
                self._block(all_ids[k : k + BLOCK])
            self.pending, self.waiting = [all_ids[full:]], len(all_ids) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids).astype("<u8").tobytes()
        self.stream.write(data)
        self.blocks.append((self.at, len(ids)))
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the file."""
        if self.waiting:
            self._block(np.concatenate(self.pending))
        numbers = [np.array([x[k] for x in self.blocks], "<i8") for k in (0, 1)]
        numbers += [np.array([x[0] or 0 for x in self.docs], "<i8"), np.array([x[1] for x in self.docs], "<i8")]
        for x in numbers:
            self.stream.write(x.tobytes())
        self.stream.write(bytes(x[0] is None for x in self.docs))
        self.stream.write(np.array([len(self.blocks), len(self.docs)], "<i8").tobytes() + END)
        self.stream.close()
        return len(self.docs), int(sum(x[1] for x in self.docs))


def read_token_file(path: str):
    """Yield (doc_id, ids) of a file in its order; memory holds a block, the longest document and the footer."""
    system, inner = open_fs(path)
    with system.open_input_file(inner) as f:
        size = f.size()
        tail = f.read_at(24, size - 24)
        if f.read_at(8, 0) != MAGIC or tail[16:] != END:
            raise ValueError(f"{path} is no token file, or incomplete")
        n_blocks, n_docs = (int(x) for x in np.frombuffer(tail[:16], "<i8"))
        start = size - 24 - n_docs - 16 * (n_blocks + n_docs)
        footer = f.read_at(size - 24 - start, start)
        numbers = np.frombuffer(footer[: len(footer) - n_docs], "<i8")
        offset, count = numbers[:n_blocks], numbers[n_blocks : 2 * n_blocks]
        doc_ids, lengths = numbers[2 * n_blocks : 2 * n_blocks + n_docs], numbers[2 * n_blocks + n_docs :]
        nulls = footer[len(footer) - n_docs :]
        ends = np.append(offset[1:], start)
        block, held = 0, np.zeros(0, np.uint64)
        for doc_id, length, null in zip(doc_ids.tolist(), lengths.tolist(), nulls):
            parts, have = [held], len(held)
            while have < length:
                words = np.frombuffer(f.read_at(int(ends[block] - offset[block]), int(offset[block])), "<u8")
                parts.append(unpack(words, int(count[block])))
                have += len(parts[-1])
                block += 1
            ids = np.concatenate(parts) if len(parts) > 1 else held
            held = ids[length:]
            yield (None if null else doc_id), ids[:length]


#: The steps before the model of tokenizers that lower-case and drop white space, as their files state them.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"


class WordEncoder:
    """Ids as the tokenizers library gives them, word by word.

    For tokenizers with the steps above, a text of Latin-1 characters without controls parts into the same words by Python's
    regular expressions: NFC leaves such texts alone, and lower-casing them changes single characters. Each word goes to the
    library once, many at a time and without the steps that are done already. What stands between blanks is kept as the
    bytes of its words' ids, so a text is one lookup for each. All other texts, those that name a special token, and all
    texts of other tokenizers go to the library whole.
    """

    WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
    CONTROLS = bytes([*range(9), *range(14, 32), *range(127, 160)])

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        told = json.loads(model)
        self.library = Tokenizer.from_str(model)
        self.parts = all(told.get(k) == v for k, v in STEPS.items()) and told["model"].get("end_of_word_suffix") == "</w>"
        self.known: dict[str, bytes] = {}
        if self.parts:
            self.specials = [x["content"] for x in told.get("added_tokens") or []]
            bare = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, STEPS["pre_tokenizer"]["pretokenizers"][1]]}
            self.words = Tokenizer.from_str(json.dumps(told | {"normalizer": None, "pre_tokenizer": bare, "added_tokens": []}))
            size = self.words.get_vocab_size()
            self.ends = np.array([(self.words.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _chunks(self, text: str) -> list[str] | None:
        """What blanks part in a text, in lower case; None if the library has to take it whole."""
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if not self.parts or len(data.translate(None, self.CONTROLS)) < len(data) or any(x in text for x in self.specials):
            return None
        return text.lower().replace("\n", " ").split(" ")

    def _learn(self, chunks: list[str]) -> None:
        """Keep the ids of chunks, by way of those of their words."""
        split = list(map(self.WORD.findall, chunks))
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in self.known]
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1  # the tokens that end a word part what the library gives for all
            if len(last) != len(some) or last[-1] != len(ids):
                self.known.update((w, self._whole(w)) for w in some)
                continue
            data, places = ids.tobytes(), (4 * last).tolist()
            self.known.update((w, data[a:b]) for w, a, b in zip(some, [0, *places], places))
        get = self.known.__getitem__
        self.known.update([(c, b"".join(map(get, x))) for c, x in zip(chunks, split) if x != [c]])

    def encode(self, texts: list[str | None], end: int | None):
        """Yield the ids of each text, and the end id."""
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        for text in texts:
            chunks = self._chunks(text or "")
            if chunks is None:
                yield np.frombuffer(self._whole(text) + tail, "<u4")
                continue
            missing = list(set(chunks).difference(self.known))
            if missing:
                if len(self.known) > KEPT_CHUNKS:
                    self.known = {c: self.known[c] for c in chunks if c in self.known}
                self._learn(missing)
            yield np.frombuffer(b"".join(map(self.known.__getitem__, chunks)) + tail, "<u4")
            for c in missing:
                if len(c) > KEPT_LENGTH:
                    self.known.pop(c, None)


@lru_cache(maxsize=1)
def encoder_of(model: str) -> WordEncoder:
    """The worker's encoder: tasks that a worker runs one after another share what it has learnt."""
    return WordEncoder(model)


def write_token_files(docs: DataFrame, model_path: str, folder: str, end_id: int | None = 1) -> list[tuple]:
    """Write the ids of docs (doc_id, text) in ascending doc_id order, null ids first, as files in ``folder``.

    Returns the manifest in order: (file, documents, ids, ids before it). One row a file, so it is small enough for the
    driver. A task that runs again writes a file of another name, and only the manifest's files count, so lost executors
    and speculative tasks leave no double rows. Null and empty texts have the end id alone.
    """
    spark = docs.sparkSession
    with open(model_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches):
        from pyspark import TaskContext

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder, out, path = None, None, ""
        for batch in batches:
            if out is None:
                encoder = encoder_of(model.value)
                path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.lsw"
                system, inner = open_fs(path)
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                out = TokenFile(system.open_output_stream(inner))
            texts = batch.column("text").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts, end_id)):
                out.add(doc_id, ids)
        if out is not None:
            n, total = out.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "file": [path], "docs": [n], "ids": [total]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = sorted(tuple(r) for r in ordered.mapInArrow(run, "part int, file string, docs long, ids long").collect())
    manifest, before = [], 0
    for _, file, n, total in files:
        manifest.append((file, n, total, before))
        before += total
    return manifest


def read_token_files(spark, manifest: list[tuple]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files of a manifest."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, rows = row["before"], []
                for doc_id, ids in read_token_file(row["file"]):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(manifest, "file string, docs long, ids long, before long").repartition(max(1, len(manifest)))
    return files.mapInArrow(run, schema)


def token_binary(docs: DataFrame, model_path: str, end_id: int | None = 1, folder: str | None = None) -> DataFrame:
    """Write docs as token files and return what reading them gives: doc_id, start, n_tokens, ids_crc32.

    Rows with equal doc_id are written in the order of a hash of their texts. Other columns are ignored; an empty table
    writes no file and gives no rows.
    """
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, model_path, folder or scratch(spark, "tokens"), end_id))
