"""Byte-level BPE over Arrow batches with the tokenizers library.

Text becomes bytes, and each byte one printable character (the byte table), so any
text has an encoding. Merges never cross the matches of a fixed pattern, so a match's
ids depend on nothing else. So each distinct stretch between spaces is encoded once in
a batch, and those that a worker remembers not at all; the library gets all the new
matches of a batch in one call. A stretch that begins with the space before it always
begins a match there (every alternative of the pattern takes a space only before what
follows it), as long as white space stands alone; texts with other white space are
split by the pattern itself, whole.

Decoding reverses the byte table and joins bytes before it reads them as UTF-8, since
a character's bytes can be split over ids.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import CharDelimiterSplit

from genoframe.session import ship_package, tidy

#: White space that does not stand alone, other white space, and the mark of a text's first stretch.
ODD = r"[ \n]{2}|[\t\x0b\x0c\r\x01\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FIRST = "\x01"
#: Signs that are a match of their own after a word.
SIGNS = frozenset(".,;:!?|)")
#: Distinct stretches that a worker remembers, of some 150 bytes each, and the distinct matches of texts with odd white space, of some 150.
REMEMBERED, REMEMBERED_MATCHES = 400_000, 20_000
#: What stands between matches that go to the library together; no stretch holds it.
BETWEEN = "\x01"
#: Stretches whose ids are gathered at once.
GATHERED = 1 << 17


def byte_table() -> list[str]:
    """The character of each byte: printable Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + len(table) - len(own))
    return [table[b] for b in range(256)]


SPACE = byte_table()[0x20]
TO_CHARS = {b: c for b, c in enumerate(byte_table())}
TO_BYTES = {c: b for b, c in enumerate(byte_table())}


def as_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_CHARS)


def as_bytes(chars: str) -> bytes:
    return bytes([TO_BYTES[c] for c in chars])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token of more than a byte: what remains of its bytes when lower ranks have merged."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
            if not found:
                break
            _, at = min(found)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


class Recent(dict):
    """Values by key, computed when missing. Two generations bound it: what is used again survives, the rest goes."""

    def __init__(self, compute: Callable[[str], bytes], half: int):
        super().__init__()
        self.compute, self.half = compute, half
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Stretches:
    """Ids of stretches by a dictionary into flat arrays, so that a look-up costs what is asked and not what is remembered. When full, what the last batch had stays and the rest goes."""

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], bound: int):
        self.compute, self.bound = compute, bound
        self.places: dict[str, int] = {}
        self.flat, self.ends, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = self.known = 0

    def find(self, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One flat array of ids, and where each asked stretch's ids end there and how many they are."""
        said = asked.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.places.get, said, repeat(-1)), np.int64, len(said))
        new = np.nonzero(place < 0)[0]
        fresh = [said[i] for i in new.tolist()]
        place[new] = np.arange(self.known, self.known + len(fresh))
        self._add(fresh, *self.compute(fresh))
        ends, sizes = self.ends[place], self.sizes[place]
        if self.known <= self.bound:
            return self.flat, ends, sizes
        flat, some = self.flat, slice(0, self.bound)
        self.places, self.used, self.known = {}, 0, 0
        self.flat, self.ends, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._add(said[some], gather(flat, ends[some], sizes[some]), sizes[some])
        return flat, ends, sizes

    def _add(self, stretches: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        used, known = self.used + len(ids), self.known + len(stretches)
        self.flat, self.ends, self.sizes = (_room(a, n) for a, n in ((self.flat, used), (self.ends, known), (self.sizes, known)))
        self.flat[self.used : used] = ids
        self.ends[self.known : known] = self.used + np.cumsum(sizes)
        self.sizes[self.known : known] = sizes
        self.places.update(zip(stretches, range(self.known, known), strict=True))
        self.used, self.known = used, known


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or a copy half as long again, if it is shorter than n."""
    if n <= len(array):
        return array
    out = np.empty(n + n // 2, array.dtype)
    out[: len(array)] = array
    return out


def gather(flat: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that end at ``ends``, one after another. By parts, as positions are larger than ids."""
    stop = np.cumsum(lengths)
    shift = ends - stop
    out = np.empty(stop[-1] if len(stop) else 0, flat.dtype)
    for a in range(0, len(stop), GATHERED):
        b = min(a + GATHERED, len(stop))
        low, high = int(stop[a] - lengths[a]), int(stop[b - 1])
        out[low:high] = flat[np.repeat(shift[a:b], lengths[a:b]) + np.arange(low, high)]
    return out


class Codec:
    """One vocabulary: ids of texts, bytes of ids. Held by a Python worker for as long as it lives."""

    def __init__(self, model: BPE, id_bytes: dict[int, bytes], pattern: str = public_tokenizers.PATTERN):
        self.model = model
        self.id_bytes = id_bytes
        self.pattern = regex.compile(pattern)
        # Matches go to the library in characters of the byte table, one on a line: a line break is no such character.
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = CharDelimiterSplit("\n")
        self.chars = np.array([ord("\n") if b == ord(BETWEEN) else ord(c) for b, c in enumerate(byte_table())], "<u2")
        self.lengths = np.array([len(id_bytes.get(i, b"")) for i in range(max(id_bytes) + 1)], np.int64)
        # Ids as unsigned 32-bit numbers of this machine.
        self.match_ids = Recent(self._match, REMEMBERED_MATCHES).__getitem__
        self.remembered = Stretches(self._stretches, REMEMBERED)

    @classmethod
    def from_ranks(cls, path: str) -> Codec:
        """A vocabulary given as ranks; the merges are derived from them."""
        ranks = read_ranks(path)
        merges = [(as_chars(a), as_chars(b)) for a, b in merges_of(ranks)]
        return cls(BPE({as_chars(t): r for t, r in ranks.items()}, merges), {r: t for t, r in ranks.items()})

    @classmethod
    def from_json(cls, path: str) -> Codec:
        """A vocabulary given as a tokenizers file; strings of special tokens in a text are ordinary text."""
        tokenizer = Tokenizer.from_file(path)
        return cls(tokenizer.model, {i: as_bytes(t) for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in TO_BYTES for c in t)})

    def _match(self, match: str) -> bytes:
        """Ids of one match of the pattern."""
        # Printable ASCII stands for itself in the byte table, but for the space.
        chars = match.replace(" ", SPACE) if match.isascii() and match.isprintable() else as_chars(match.encode("utf-8", "surrogatepass"))
        return array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a whole text, by the pattern."""
        return b"".join(map(self.match_ids, self.pattern.findall(text)))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), np.uint32)

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) in characters; a token that holds part of a character covers that character."""
        out = []
        for match in self.pattern.finditer(text):
            data = match.group().encode("utf-8", "surrogatepass")
            # Character of each byte of the match.
            starts = np.cumsum([(b & 0xC0) != 0x80 for b in data]) - 1 + match.start()
            at = 0
            for token in self.model.tokenize(as_chars(data)):
                end = at + len(token.value)  # a character of the byte table is a byte
                out.append((token.id, int(starts[at]), int(starts[end - 1]) + 1))
                at = end
        return out

    def _stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches one after another, and how many each has. A word, with one sign after it or none, needs no pattern: it is one match, and the sign another."""
        matches: list[str] = []
        counts = []
        for stretch in stretches:
            if stretch.isalpha():
                matches.append(" " + stretch)
                counts.append(1)
            elif stretch[-1:] in SIGNS and stretch[:-1].isalpha():
                matches += (" " + stretch[:-1], stretch[-1])
                counts.append(2)
            else:
                first = stretch[:1]
                own = self.pattern.findall(stretch[1:] if first == FIRST else stretch if first == "\n" else " " + stretch)
                matches += own
                counts.append(len(own))
        if not matches:
            return np.zeros(0, np.uint32), np.zeros(len(stretches), np.int64)
        data = np.frombuffer(BETWEEN.join(matches).encode("utf-8", "surrogatepass"), np.uint8)
        said = self.chars[data].tobytes().decode("utf-16-le")
        ids = np.array(self.library.encode_batch_fast([said], add_special_tokens=False)[0].ids, np.uint32)
        # A token's bytes are known, so the matches' bytes say where their ids end.
        stops = np.concatenate([np.nonzero(data == ord(BETWEEN))[0], [len(data)]]) - np.arange(len(matches))
        upto = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), upto, side="right"))

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, one after another, and where each text's ids end. Nulls count as empty."""
        found = [part[2:] for part in self.encode_parts(texts, [0, len(texts)])]
        return found[0] if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def encode_parts(self, texts: pa.Array, starts: Sequence[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``encode_batch`` of the texts from each start to the next, with both: stretches are looked up once for all, as a look-up reads all that is remembered, and ids are laid out by parts."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        # A line's first stretch keeps the line break before it, so it is not taken for one after a space.
        plain = pc.binary_join_element_wise(FIRST, pc.replace_substring(plain, "\n", " \n"), "")
        parts = pc.split_pattern(plain, " ")
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))])
        coded = pc.list_flatten(parts).dictionary_encode()
        flat, ends, sizes = self.remembered.find(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        for first, last in zip(starts, starts[1:]):
            if last <= first:
                continue
            own = codes[upto[first] : upto[last]]
            lengths = sizes[own]
            ids = gather(flat, ends[own], lengths)
            text_ends = np.concatenate([[0], np.cumsum(lengths)])[upto[first + 1 : last + 1] - upto[first]]
            if odd[first:last].any():
                pieces, at = [], 0
                for i, end in enumerate(text_ends, first):
                    pieces.append(self.ids(texts[i].as_py()) if odd[i] else ids[at:end])
                    at = end
                ids, text_ends = np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
            yield first, last, ids, text_ends

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes that ids stand for; unknown ids raise."""
        table = self.id_bytes
        return b"".join([table[i] for i in ids])

    def decode_array(self, ids: np.ndarray) -> bytes:
        """``decode`` for an array: gathers from one buffer of all tokens."""
        if not hasattr(self, "_buffer"):
            self._buffer = np.frombuffer(b"".join(self.id_bytes.get(i, b"") for i in range(len(self.lengths))), np.uint8)
            self._ends = np.cumsum(self.lengths)
        return gather(self._buffer, self._ends[ids], self.lengths[ids]).tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(kind: str, path: str) -> Codec:
    """The worker's own codec of a vocabulary file ("ranks" or "json"), made once."""
    if (kind, path) not in _CODECS:
        _CODECS[kind, path] = Codec.from_ranks(path) if kind == "ranks" else Codec.from_json(path)
    return _CODECS[kind, path]


def forget() -> None:
    """Drop this worker's codecs, for stages that hold much else."""
    _CODECS.clear()


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is on this machine; executors have their own copy of the package."""
    return public_tokenizers.path(name)


def encode(documents: DataFrame, *, key: str = "doc_id", text: str = "text", ranks: str = "byte_bpe_50k.tiktoken", offsets: bool = False) -> DataFrame:
    """The key and ``ids`` (array of int) of every row; ``offsets`` adds ``starts`` and ``ends``, in characters.

    Whole texts are encoded. A null or empty text has no ids. Repeated rows are encoded
    each. Only the two columns are read. A token that holds part of a character has
    the offsets of that whole character.
    """
    ship_package(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec("ranks", vocabulary(ranks))
        for batch in batches:
            if offsets:
                found = [own.offsets(t.as_py() or "") for t in batch.column(1)]
                columns = [pa.array([[x[i] for x in f] for f in found], pa.list_(pa.int32())) for i in range(3)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "ids", "starts", "ends"])
            else:
                ids, ends = own.encode_batch(batch.column(1))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, *, key: str = "doc_id", ids: str = "ids", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The key and ``bytes`` (binary) of every row; ``bytes`` of null ids is null. An id outside the vocabulary fails the task."""
    ship_package(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec("ranks", vocabulary(ranks))
        for batch in batches:
            found = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=[key, "bytes"])

    return encoded.select(key, ids).mapInArrow(tidy(run), f"{key} {kind}, bytes binary")


def round_trip(documents: DataFrame, *, key: str = "doc_id", text: str = "text", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Digests of encoding each whole text and of decoding its ids: the key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Ids are digested as decimals joined by one space. They stay in the worker, as an
    array, so nothing but digests leaves it. Null and empty texts: no tokens, and the
    digests of empty strings.
    """
    ship_package(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec("ranks", vocabulary(ranks))
        spelled = np.array([f"{i} " for i in range(max(own.id_bytes) + 1)], object)
        for batch in batches:
            ids, ends = own.encode_batch(batch.column(1))
            n, said, back, start = [], [], [], 0
            for end in ends.tolist():
                part = ids[start:end]
                n.append(end - start)
                said.append(hashlib.sha256("".join(spelled[part].tolist())[:-1].encode()).hexdigest())
                back.append(hashlib.sha256(own.decode_array(part)).hexdigest())
                start = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(key, text).mapInArrow(tidy(run), f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
