"""BPE encoding and decoding with a public vocabulary file.

A word's symbols form a doubly linked list, the possible merges wait in a priority queue by rank, and entries whose
symbols have changed meanwhile are skipped. Results of words are kept in two-generation caches of bounded size, one set
for each worker process. Decoding concatenates the vocabulary strings.

Rows are independent, so there is no shuffle and a lost executor costs only its own partitions.
Defined results: null text counts as empty (no ids, empty decoded text); repeated rows give repeated results; the
strings of special tokens in a text become their ids, as the file's library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that cuts text into pieces, as the vocabulary file states it, and the mark of a word's end.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = regex.compile(r"\s+")
#: Code points that the pattern's library takes for letters or numbers, but the vocabulary's library, of an
#: older Unicode version, for symbols (first and last of each range, hexadecimal).
UNKNOWN = """558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf
10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8
16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6
1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f
2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"""
#: Capitals of newer Unicode versions (first and last, hexadecimal) and how far their small letters are.
CAPITALS = """1c89-1c89 1, a7cb-a7cb -a567, a7cc-a7cc 1, a7ce-a7ce 1, a7d2-a7d2 1, a7d4-a7d4 1, a7da-a7da 1, a7dc-a7dc -a641, 10d50-10d65 20, 16ea0-16eb8 1b"""
SMALL = {c: c + int(by, 16) for span, by in (x.split() for x in CAPITALS.split(",")) for c in range(int(span.split("-")[0], 16), int(span.split("-")[1], 16) + 1)}
SMALL[ord("Σ")] = ord("σ")  # at the end of a word too
SYMBOLS = regex.compile("[" + "".join(f"{chr(int(a, 16))}-{chr(int(b, 16))}" for a, b in (x.split("-") for x in UNKNOWN.split())) + "]")
WORD_END = "</w>"
#: Marks that often end a word and are one piece behind it, and the end of the letters that stay as they are when composed and lowered.
MARKS = ",.;:!?"
PLAIN_END = "\u0130"
MOST_BYTES = 64 << 20
ROWS_AT_ONCE = 1000


def byte_letters() -> list[str]:
    """A printable letter for each byte: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder for a vocabulary file's text (JSON with ``model.vocab``, ``model.merges``, ``added_tokens``)."""

    def __init__(self, spec: str, cached_words: int = 120_000):
        d = json.loads(spec)
        self.vocab: dict[str, int] = d["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        self.top = max(self.vocab.values(), default=-1)
        numbers = dict(self.vocab)  # symbols by number: the vocabulary's own, others beyond them
        number = lambda x: numbers.setdefault(x, self.top + 1 + len(numbers))
        self.rank = {number(a) << 32 | number(b): k for k, (a, b) in enumerate(pairs)}
        self.merged = [number(a + b) for a, b in pairs]
        self.inner = [number(x) for x in byte_letters()]
        self.last = [number(x + WORD_END) for x in byte_letters()]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.most = cached_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Merges neighbours, lowest rank first and leftmost among equals, until no rank applies.

        An entry of the queue is a rank and a place in one number. It is stale if the pair at its place, after other
        merges, is not the rank's own.
        """
        n, rank, merged = len(symbols), self.rank.get, self.merged
        queue = [r << 32 | k for k in range(n - 1) if (r := rank(symbols[k] << 32 | symbols[k + 1])) is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            r = pop(queue)
            k = r & 0xFFFFFFFF
            r >>= 32
            j = after[k]
            if j >= n or symbols[k] < 0 or rank(symbols[k] << 32 | symbols[j]) != r:
                continue
            new = symbols[k] = merged[r]
            symbols[j] = -1
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                if (q := rank(new << 32 | symbols[j])) is not None:
                    push(queue, q << 32 | k)
            j = before[k]
            if j >= 0 and (q := rank(symbols[j] << 32 | new)) is not None:
                push(queue, q << 32 | j)
        return [x for x in symbols if x >= 0]

    def piece(self, piece: str) -> bytes:
        """Packed ids of one piece; kept like those of chunks, as most new chunks are known words with new punctuation."""
        found = self.young_pieces.get(piece)
        if found is None:
            found = self.old_pieces.get(piece)
            if found is None:
                letters = piece.encode()
                symbols = [self.inner[b] for b in letters]
                symbols[-1] = self.last[letters[-1]]
                ids = [x for x in self.merge(symbols) if x <= self.top]
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.young_pieces) >= self.most:
                self.old_pieces, self.young_pieces = self.young_pieces, {}
            if len(piece) <= 64:
                self.young_pieces[piece] = found
        return found

    def cut_chunk(self, chunk: str) -> bytes:
        """Packed ids of a run of text without white space."""
        word = chunk.rstrip(MARKS)
        if word.isalpha() and max(word) < PLAIN_END:  # letters that no normal form changes, and the marks behind them
            return self.piece(word.lower()) + (self.piece(chunk[len(word) :]) if len(word) < len(chunk) else b"")
        out = []
        for k, part in enumerate(self.cut.split(chunk) if self.cut and "<" in chunk else [chunk]):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
            elif part.isascii():
                out += map(self.piece, PIECES.findall(part.lower()))
            else:
                part = unicodedata.normalize("NFC", part).translate(SMALL).lower()
                shown = SYMBOLS.sub("§", part)
                out += [self.piece(part[m.start() : m.end()]) for m in PIECES.finditer(shown)]
        return b"".join(out)

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit integers."""
        found = self.old.get(chunk)
        if found is None:
            found = self.cut_chunk(chunk)
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        if len(chunk) <= 64:
            self.young[chunk] = found
        return found

    def decode(self, packed: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Packed ids and decoded text of a whole text."""
        get, young = self.young.get, self.young
        parts = []
        for c in SPACE.split(text) if not text.isascii() or any(x in text for x in "\x1c\x1d\x1e\x1f") else text.split():
            if (p := get(c)) is None:
                p = self.chunk(c)
                if young is not self.young:
                    get, young = self.young.get, self.young
            parts.append(p)
        packed = b"".join(parts)
        return packed, self.decode(packed)


_codecs: dict[str, Codec] = {}


def codec_of(spec: str) -> Codec:
    """The worker process's codec for a vocabulary: later tasks of the process find its caches filled."""
    digest = hashlib.sha256(spec.encode()).hexdigest()
    if digest not in _codecs:
        _codecs.clear()
        _codecs[digest] = Codec(spec)
    return _codecs[digest]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MOST_BYTES:
        raise ValueError(f"{path}: a vocabulary of {len(spec)} characters is too large to send to every worker")
    return spec


def encode_decode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` for each row, and ``ids`` (array of int) on request.

    ``vocabulary`` is the path of the file on the driver; its text (bounded by :data:`MOST_BYTES`) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    ids_field = [pa.field("ids", pa.list_(pa.int32()))] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                yield part(codec, whole.slice(at, ROWS_AT_ONCE))

    def part(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, decoded, packed, ends = [], [], [], [], [0]
        for value in batch.column(1):
            b, s = codec.encode(value.as_py() or "")
            n.append(len(b) // 4)
            ids.append(hashlib.sha256(b).hexdigest())
            decoded.append(hashlib.sha256(s.encode()).hexdigest())
            if with_ids:
                packed.append(b)
                ends.append(ends[-1] + len(b) // 4)
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.select(key).dtypes[0][1]
    schema = f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids_field else "")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
