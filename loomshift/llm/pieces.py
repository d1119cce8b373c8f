"""SentencePiece BPE encoding and decoding by a table of each prefix's last token.

A piece's encoding of a prefix of a word is the prefix's unique last token plus the encoding of what precedes it. The last
token is found among the pieces that an automaton matches at the prefix's end: it is the only one that is compatible with
the last token of the rest, that is, whose merge is not forestalled by a better merge across the boundary. One token a
prefix is kept, and the ids are recovered backwards, so a word costs time in proportion to its length however long it is.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import numbered, renamed

SPACE = "▁"
UNKNOWN = -1
FAR = 1 << 60
#: Words that a worker keeps, the longest word it keeps, and the pairs whose compatibility it keeps.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 300_000, 48, 2_000_000


@lru_cache(maxsize=4)
def load_model(path: str) -> dict:
    """What the encoder needs of a BPE model with byte fallback: pieces, ranks, kinds and how each piece is merged.

    Raises ValueError for models beyond what the method covers: another normalisation, user-defined or unused pieces, or
    white space inside pieces.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any(model.is_unused(i) for i in range(size)) or not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("only BPE models with byte fallback and without unused pieces are covered")
    normal = [i for i in range(size) if i not in special and not model.is_byte(i)]
    if any(SPACE in names[i][1:] and set(names[i]) != {SPACE} or "\n" in names[i] for i in normal):
        raise ValueError("pieces with white space inside are not covered")
    if model.decode(model.encode(" a  Åﬁ ")) != " a  Åﬁ ":
        raise ValueError("only the identity normalisation with a leading space is covered")
    ids = {names[i]: i for i in normal}
    missing = {c for p in ids for c in p} - ids.keys()
    if missing:
        raise ValueError("pieces hold characters that are no pieces themselves")
    score = {i: model.get_score(i) for i in normal}
    place = {s: n for n, s in enumerate(sorted(set(score.values()), reverse=True))}
    rank = {i: place[s] for i, s in score.items()}
    runs = {len(names[i]): i for i in normal if set(names[i]) == {SPACE}}
    longest = max(runs, default=0)
    if 1 not in runs or len({rank[i] for n, i in runs.items() if n > 1}) > 1 or any(rank[i] < max(rank.values()) for n, i in runs.items() if n > 1):
        raise ValueError("runs of white space must be pieces of equal and lowest rank")
    blanks = [[ids[p] for p in merge(SPACE * n, ids, rank)] for n in range(3 * longest)]
    if any(blanks[n] != [runs[longest]] * (n // longest) + blanks[n % longest] for n in range(3 * longest)):
        raise ValueError("long runs of white space must be encoded as the longest piece, repeated, and a rest")
    return {"names": names, "ids": ids, "rank": rank, "bytes": byte_ids, "blanks": blanks[:longest], "longest": runs[longest], "special": special, "made": [i for i in normal if len(merged(names[i], ids, rank)) == 1]}


def merged(text: str, ids: dict[str, int], rank: dict[int, int]) -> list:
    """The symbols that merging the characters of a text ends with, each with the two symbols that it was made of."""
    parts: list[tuple[str, object]] = [(c, None) for c in text]
    while len(parts) > 1:
        best = min(((rank[ids[a + b]], k) for k, ((a, _), (b, _)) in enumerate(zip(parts, parts[1:])) if a + b in ids), default=None)
        if best is None:
            break
        k = best[1]
        parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], (parts[k], parts[k + 1]))]
    return parts


def merge(text: str, ids: dict[str, int], rank: dict[int, int]) -> list[str]:
    return [symbol for symbol, _ in merged(text, ids, rank)]


class PieceCodec:
    """Encodes and decodes exactly as the library does, without its begin and end ids."""

    def __init__(self, model: dict):
        import ahocorasick

        self.names, self.ids, self.rank, self.byte_ids, self.runs, self.longest = (model[k] for k in ("names", "ids", "rank", "bytes", "blanks", "longest"))
        self.space, self.newline = self.ids[SPACE], self.byte_ids[10]
        self.length = {i: len(p) for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for i in model["made"]:  # pieces that merging never makes are no one's last token
            piece = self.names[i]
            if len(piece) == 1 or set(piece) != {SPACE}:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.edges: dict[int, tuple] = {}
        self.pairs: dict[int, bool] = {}
        self.bare, self.spaced = _Words(self, ""), _Words(self, SPACE)
        special = model["special"]
        self.text_of = ["" if i in special and n != "<unk>" else " ⁇ " if i in special else n.replace(SPACE, " ") for i, n in enumerate(self.names)]
        self.value_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.high = {i for i, b in self.value_of.items() if b > 127}
        for b in range(128):
            self.text_of[self.byte_ids[b]] = chr(b)

    def edge(self, i: int) -> tuple:
        """(right edge, left edge) of a piece: the symbols that stand at that end while it is merged, each with its rank and the rank that ends it."""
        if i not in self.edges:
            tree = merged(self.names[i], self.ids, self.rank)[0]
            sides = []
            for side in (1, 0):
                found, node, until = [], tree, FAR
                while node is not None:
                    text, parts = node
                    born = self.rank[self.ids[text]] if parts else -1
                    found.append((text, min(born, until - 1), until))
                    until = self.rank[self.ids[text]]
                    node = parts[side] if parts else None
                sides.append(found)
            self.edges[i] = tuple(sides)
        return self.edges[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the text of a and b together gives a and b."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = self._compatible(a, b)
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        left, right = self.edge(a), self.edge(b)
        for x, born_x, until_x in left[0]:
            for y, born_y, until_y in right[1]:
                if born_y < until_x and born_x <= until_y:
                    z = self.ids.get(x + y)
                    if z is not None and self.rank[z] < until_x and self.rank[z] <= until_y:
                        return False
        return True

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a text whose only white space, if any, is a leading space piece."""
        n = len(text)
        last = [UNKNOWN] * (n + 1)
        done, pairs = -1, self.pairs
        for end, (i, size) in self.automaton.iter(text):
            if end == done:
                continue
            start = end + 1 - size
            before = last[start]
            if start and before != UNKNOWN:  # a character without a piece never merges
                known = pairs.get(before << 20 | i)
                if not (self.compatible(before, i) if known is None else known):
                    continue
            last[end + 1] = i
            done = end
        out = []
        while n:
            i = last[n]
            if i == UNKNOWN:
                n -= 1
                out.extend(self.byte_ids[b] for b in reversed(text[n].encode("utf-8")))
            else:
                out.append(i)
                n -= self.length[i]
        out.reverse()
        return tuple(out)

    def blanks(self, n: int) -> list[int]:
        full, rest = divmod(n, len(self.runs))
        return [self.longest] * full + self.runs[rest]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        spaced = self.spaced.__getitem__
        for k, line in enumerate((" " + text).replace(SPACE, " ").split("\n")):
            if k:
                out.append(self.newline)
            head, *parts = line.split(" ")
            if head:
                out.extend(self.bare[head])
            if "" not in parts:
                out.extend(chain.from_iterable(map(spaced, parts)))
                continue
            run = 0
            for part in parts:
                run += 1
                if part:
                    ids = spaced(part)
                    if run > 1:
                        # merges of white space come last: a space that its word did not take joins the run before it
                        ids = (*self.blanks(run), *ids[1:]) if ids[0] == self.space else (*self.blanks(run - 1), *ids)
                    out.extend(ids)
                    run = 0
            out.extend(self.blanks(run))
        return out

    def decode(self, ids: list[int]) -> str:
        if self.high.isdisjoint(ids):
            text = "".join(map(self.text_of.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in self.value_of:
                    run.append(self.value_of[i])
                else:
                    if run:
                        parts.append(_bytes_text(bytes(run)))
                        run.clear()
                    parts.append(self.text_of[i])
            parts.append(_bytes_text(bytes(run)))
            text = "".join(parts)
        return text[1:] if text[:1] == " " and self.names[ids[0]][0] == SPACE else text


def _bytes_text(data: bytes) -> str:
    """UTF-8, with one replacement character for every byte that is part of no character."""
    out = []
    while data:
        try:
            out.append(data.decode("utf-8"))
            break
        except UnicodeDecodeError as bad:
            out.append(data[: bad.start].decode("utf-8") + "�")
            data = data[bad.start + 1 :]
    return "".join(out)


class _Words(dict):
    """Encoded words, kept while they fit."""

    def __init__(self, codec: PieceCodec, prefix: str):
        self.codec, self.prefix = codec, prefix

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.codec.word(self.prefix + word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


_CODECS: dict[str, PieceCodec] = {}


def codec_of(shared) -> PieceCodec:
    """The worker's codec for a broadcast model: tasks that a worker runs one after another share what it has learnt."""
    path, model = shared.value
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = PieceCodec(model)
    return _CODECS[path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with the columns ids (array<int>) and decoded (string) in place of text and of columns of those names.

    Every whole text is encoded as the library encodes it, without begin and end ids, and the ids are decoded again. Null
    and empty texts have no ids and decode to the empty text. Rows, repeated ones included, come back one for one.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((model_path, load_model(model_path)))
    others = [c for c in docs.columns if c.lower() not in ("text", "ids", "decoded")]

    def run(batches):
        codec = PieceCodec(model.value[1])  # of this task: what it has learnt must not stay while other stages run
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            arrays = [pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], "ids", "decoded"])

    frame = numbered(docs, others, F.col("text").cast("string").alias("words"))
    schema = StructType(frame.schema.fields[:-1]).add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return renamed(frame.mapInArrow(run, schema), others, "ids", "decoded")


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs; ids never leave the worker."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((model_path, load_model(model_path)))

    def run(batches):
        codec = codec_of(model)
        decimal = [str(i) for i in range(len(codec.names))].__getitem__
        for batch in batches:
            count, digest, back = [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text)
                count.append(len(ids))
                digest.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
