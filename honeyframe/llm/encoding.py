"""Token ids of whole texts by the ``tokenizers`` library, with a bounded cache.

A text is cut where no token can span: at white space for the vocabulary with
word ends, before white space that follows other text for byte-level BPE. The
parts repeat a lot, so each worker keeps the ids of the parts it met last. All
ids come from the library's model; parts outside ASCII take its whole path.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as Unicode defines it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: Bytes of text that are worked on at once.
PART = 4 << 20

#: Letters, digits and signs up to U+024F: composed, without white space but the
#: ASCII one, and classed alike by every version of Unicode.
_LATIN = re.compile("[\x00-\x84\x86-\x9f\xa1-\u024f]+")

#: The splits of both tokenizers, for such texts. Letters are word
#: characters but digits, the signs of numbers and the underscore.
_NUMBER = r"\d\xb2\xb3\xb9\xbc-\xbe"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD = re.compile(rf"{_SHORT}|[^\W{_NUMBER}_]+|[{_NUMBER}]|(?:[^\w]|_)+")
_BYTE = re.compile(
    rf"{_SHORT}| ?[^\W{_NUMBER}_]+| ?[{_NUMBER}]+| ?(?:[^\w\t-\r ]|_)+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


class Recent(dict):
    """Values by key, made when first asked for; the ones used last are kept, at
    most twice ``limit`` of them (two generations)."""

    def __init__(self, limit: int, make=None):
        super().__init__()
        self.limit, self.make = limit, make
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) > self.limit:
            self._turn()
        self[key] = value
        return value

    def _turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def missing(self, keys: set) -> list:
        """Keys whose value the caller must make; older values move up."""
        out = []
        self._turn()
        for k in keys:
            if k in self:
                continue
            v = self.old.get(k)
            if v is None:
                out.append(k)
            else:
                self[k] = v
        return out


def in_parts(batch: pa.RecordBatch, column: int):
    """Slices of a batch with about ``PART`` bytes of text each, a row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < batch.num_rows:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + PART, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def quiet() -> None:
    """One thread for each task; Spark runs the tasks side by side."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def byte_chars() -> list[str]:
    """Character that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the others follow from U+0100 upwards."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_VISIBLE = dict(enumerate(byte_chars()))
_PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


def _visible(piece: str) -> str:
    """A piece as the characters that stand for its bytes."""
    return piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(_VISIBLE)


class WordEncoder:
    """Ids by a tokenizer file that drops white space (BPE with word ends)."""

    def __init__(self, path: str, cache: int = 200_000):
        quiet()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tok.model
        self.seen, self.pieces = Recent(cache, self._ids), Recent(cache, self._piece)

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isalpha() and piece.isascii() else _visible(piece))]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _lookup(self, words: list[str]) -> list[bytes]:
        pieces, seen, out = self.pieces, self.seen, []
        for w in words:
            if w.isalpha() and w.isascii():  # one piece, whose case is plain
                out.append(pieces[w.lower()])
            else:
                out.append(seen[w])
        return out

    def _ids(self, text: str) -> bytes:
        if _LATIN.fullmatch(text):  # composed already; lower case and splits are plain
            return b"".join(map(self.pieces.__getitem__, _WORD.findall(text.lower())))
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, texts: pa.Array) -> list[bytes]:
        """Distinct words are looked up once, the others are gathered."""
        split = pc.ascii_split_whitespace(texts)
        known = split.flatten().dictionary_encode()
        blobs = self._lookup(known.dictionary.to_pylist())
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        table = np.frombuffer(b"".join(blobs), "<u4")
        word = known.indices.to_numpy()
        n = size[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        first = (np.cumsum(size) - size)[word] - ends[:-1]
        ids = table[np.repeat(first, n) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (a list or an Arrow
        array); null counts as empty. Works through bounded parts."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        return [ids for part in in_parts(pa.record_batch([texts], ["text"]), 0) for ids in self._encode(part.column(0))]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteEncoder:
    """Byte-level BPE by a rank file, run by the ``tokenizers`` library.

    The file's byte strings become strings of the byte characters; every cut of
    a token into two known ones is a merge, in the order of the token's rank.
    Decoding reverses the byte table.
    """

    def __init__(self, path: str, pattern: str, cache: int = 200_000):
        quiet()
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_chars()
        shown = {t: "".join(map(chars.__getitem__, t)) for t in ranks}
        merges = []
        for t, r in ranks.items():
            cuts = [(t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
            merges += [(r, ranks[a], ranks[b], shown[a], shown[b]) for a, b in cuts]
        merges.sort()
        model = models.BPE(
            vocab={s: ranks[t] for t, s in shown.items()}, merges=[(a, b) for *_, a, b in merges], ignore_merges=True
        )
        self.tok = Tokenizer(model)
        self.tok.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.model = self.tok.model
        self.seen, self.pieces = Recent(cache, self._ids), Recent(cache, self._piece)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(_visible(piece))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, part: str) -> bytes:
        if len(part) <= 1000 and _LATIN.fullmatch(part):
            return b"".join(map(self.pieces.__getitem__, _BYTE.findall(part)))
        ids = self.tok.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        return [np.frombuffer(b"".join(map(self.seen.__getitem__, _CHUNK.findall(t or ""))), "<u4") for t in texts]

    def offsets(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each token, and the character that holds that byte; a
        token that starts inside a split character points at that character."""
        ends = np.cumsum(self.lengths[ids])
        start = ends - self.lengths[ids]
        first = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        return start, np.cumsum(first)[start] - 1 if len(start) else start

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


class StreamDecoder:
    """Text of ids that arrive in parts: bytes of a character that is split
    between parts wait for the rest; ``close`` gives what is left as U+FFFD."""

    def __init__(self, encoder: ByteEncoder):
        import codecs

        self.encoder = encoder
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.utf8.decode(self.encoder.decode(ids))

    def close(self) -> str:
        return self.utf8.decode(b"", final=True)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


_KEPT: dict = {}


def kept(make, *key):
    """One encoder for each worker process, made at its first use."""
    if (make, *key) not in _KEPT:
        _KEPT[(make, *key)] = make(*key)
    return _KEPT[(make, *key)]


_LATEST: dict = {}


def latest(kind: str, key: str, make):
    """The value for the newest key of a kind; older ones are let go."""
    if _LATEST.get(kind, (None, None))[0] != key:
        _LATEST[kind] = (key, make())
    return _LATEST[kind][1]
