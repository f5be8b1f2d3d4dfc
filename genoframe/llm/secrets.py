"""Secret scans: fixed patterns, and random-looking strings by character Markov models.

Two first-order Markov models over characters are trained from labelled samples: one
of random strings, one of ordinary identifiers, numbers and rules (lines of repeated
signs). In a run of key characters, SHORTEST of them at least, log-likelihood ratios
of the two models, less half of what random strings have for each character, add up
from where the sum was last not above zero to where it is largest: a stretch whose sum
is above a threshold is a secret, together with the rest of the words that it begins
and ends in, so a key that is joined to a name is found without the name. Letters only have models and a threshold of their own, and are a
word below SHORTEST_LETTERS. UUIDs are identifiers, not secrets, and are left out of
runs; nothing else but the models decides. Spans of the fixed patterns always stay;
the models only add spans that overlap none of them.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.session import ship_package, tidy

KINDS = ("assign", "access", "hex", "markov")
# Letters in either case, without the two non-ASCII letters that fold to k and s: re.A.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Runs are maximal, so a bound in the pattern finds just what a bound afterwards would.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of the shortest runs that the models are asked about: any, and those of letters only.
SHORTEST, SHORTEST_LETTERS = 16, 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
WORD = re.compile(r"[A-Za-z]{%d,}" % SHORTEST_LETTERS)
UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
SEPARATORS = "+/_=-"
MIN_ASSIGNED = 6

#: States: a-z, A-Z, 0-9, one for each of + / _ = -, and one for the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
START = len(ALPHABET)
_CODE = np.full(128, START, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i


def codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]


def transition_counts(samples: Sequence[str]) -> np.ndarray:
    counts = np.zeros((START + 1, START), np.int64)
    for sample in samples:
        c = codes(sample)
        if len(c):
            np.add.at(counts, (np.concatenate([[START], c[:-1]]), c), 1)
    return counts


def log_transitions(counts: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    smooth = counts + smoothing
    return np.log(smooth / smooth.sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class MarkovPair:
    """The log-likelihood ratio of each transition, less half its mean over random strings, and the sum from which a stretch is a secret."""

    ratio: np.ndarray
    threshold: float
    min_length: int = SHORTEST
    letters: MarkovPair | None = None  # for letters only

    def ratios(self, run: str) -> list[float]:
        c = codes(run)
        return self.ratio[np.concatenate([[START], c[:-1]]), c].tolist()

    def score(self, run: str) -> float:
        """The largest sum of ratios of any stretch of the run."""
        total = largest = 0.0
        for r in self.ratios(run):
            total = max(total + r, 0.0)
            largest = max(largest, total)
        return largest

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """Stretches of a sum above the threshold, in one pass. One ends at its largest sum, and the next begins where the sum has fallen from that by a threshold, or to zero."""
        found, begin, end, total, top = [], 0, 0, 0.0, 0.0
        for i, r in enumerate(self.ratios(run)):
            if total <= 0 or top - total >= self.threshold:
                if top > self.threshold:
                    found.append((begin, end))
                begin, end, total, top = i, i, 0.0, 0.0
            total += r
            if total > top:
                end, top = i + 1, total
        return [*found, (begin, end)] if top > self.threshold else found


def random_samples(n: int, seed: int = 7, sets: Sequence[str] = (), least: int = SHORTEST) -> list[str]:
    """Labelled random strings: uniform draws of ``least`` to 64 characters from the given alphabets, or those that keys use."""
    rng = np.random.default_rng(seed)
    sets = sets or [ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef", "0123456789ABCDEF"]
    out = []
    for i in range(n):
        chars = np.array(list(sets[i % len(sets)]))
        out.append("".join(rng.choice(chars, rng.integers(least, 65))))
    return out


def identifier_samples(words: Sequence[str], n: int, seed: int = 8) -> list[str]:
    """Labelled ordinary strings: words of trusted text alone and joined in the ways names are, numbers, dates and rules."""
    rng = np.random.default_rng(seed)
    words = [w for w in words if w and all(c in _ASCII for c in w)] or list(NAMES)
    out = list(words)
    for i in range(n):
        parts = [words[j] for j in rng.integers(0, len(words), rng.integers(2, 6))]
        style = i % 9
        if style == 0:
            out.append("_".join(p.lower() for p in parts))
        elif style == 1:
            out.append("-".join(p.lower() for p in parts))
        elif style == 2:
            out.append(parts[0].lower() + "".join(p.capitalize() for p in parts[1:]))
        elif style == 3:
            out.append("_".join(p.upper() for p in parts))
        elif style == 4:
            out.append("/".join(p.lower() for p in parts))
        elif style == 5:
            out.append("".join(map(str, rng.integers(0, 10, rng.integers(SHORTEST, 65)))))
        elif style == 6:
            out.append("-".join(f"{x:02d}" for x in rng.integers(0, 100, rng.integers(6, 20))))
        elif style == 7:
            out.append((ALPHABET + SEPARATORS * 2)[i // 9 % (len(ALPHABET) + 10)] * int(rng.integers(SHORTEST, 65)))  # every character in turn
        else:
            out.append("".join(p.lower() for p in parts) + str(rng.integers(0, 10_000)))
    return out


def letter_names(words: Sequence[str], n: int, seed: int = 9) -> list[str]:
    """Labelled names of letters only: words alone and written together, in the cases that names have."""
    rng = np.random.default_rng(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or list(NAMES)
    out = list(words)
    for i in range(n):
        parts = [words[j] for j in rng.integers(0, len(words), rng.integers(2, 8))]
        style = 5 if i % 10 == 9 else i % 5
        if style == 0:
            out.append("".join(p.lower() for p in parts))
        elif style == 5:
            out.append(ALPHABET[i // 10 % 52] * int(rng.integers(SHORTEST_LETTERS, 65)))  # every letter in turn
        elif style == 1:
            out.append("".join(p.upper() for p in parts))
        elif style == 2:
            out.append("".join(p.capitalize() for p in parts))
        elif style == 3:
            out.append(parts[0].lower() + "".join(p.capitalize() for p in parts[1:]))
        else:
            out.append("".join(parts))
    return out


_ASCII = frozenset(ALPHABET)
#: Words of identifiers where no trusted text has any.
NAMES = ("value", "name", "index", "item", "count", "start", "first", "total", "address", "customer", "number", "created", "updated", "version", "content", "handler", "request", "response", "default", "service")
#: Alphabets of keys of letters only.
LETTERS = (ALPHABET[:52], ALPHABET[:26], ALPHABET[26:52])


def train(words: Sequence[str], *, samples: int = 4000, recall: float = 0.99, spared: float = 0.999, seed: int = 7) -> MarkovPair:
    """Fit both models on half of the labelled samples and the threshold on the other half.

    The threshold is the larger of two: what keeps ``recall`` of the held-out random
    strings, and what spares the share ``spared`` of the held-out identifiers. Letters
    only have models and a threshold of their own, fitted in the same way.
    """
    if not words:
        warnings.warn("no trusted words: ordinary identifiers are made of a short built-in list", stacklevel=2)
    letters = _fit(random_samples(samples, seed + 2, LETTERS, SHORTEST_LETTERS), letter_names(words, 2 * samples, seed + 3), recall, spared, seed, SHORTEST_LETTERS)
    pair = _fit(random_samples(samples, seed), identifier_samples(words, 2 * samples, seed + 1), recall, spared, seed, SHORTEST)
    return replace(pair, letters=letters)


def _fit(random: list[str], ordinary: list[str], recall: float, spared: float, seed: int, least: int) -> MarkovPair:
    rng = np.random.default_rng(seed)
    random, ordinary = ([x[i] for i in rng.permutation(len(x))] for x in (random, ordinary))
    fit = log_transitions(transition_counts(random[::2])) - log_transitions(transition_counts(ordinary[::2]))
    pair = MarkovPair(fit, 0.0, least)
    pair = replace(pair, ratio=fit - np.mean(np.concatenate([pair.ratios(x) for x in random[1::2]])) / 2)
    held = [pair.score(x) for x in random[1::2]]
    names = [pair.score(x) for x in ordinary[1::2] if len(x) >= least]
    return replace(pair, threshold=max(float(np.quantile(held, 1 - recall)), float(np.quantile(names, spared)) if names else 0.0))


def trusted_words(documents: DataFrame, labels: DataFrame, *, rows: int = 400, words: int = 20_000) -> list[str]:
    """Words of a bounded sample of trusted documents (quality 1, not toxic), those of the smallest ids that are there.

    The bound is ``rows`` documents and ``words`` distinct words: it is the labelled sample
    that the identifier model is trained on, and the only thing that comes to the driver.
    """
    trusted = labels.where("quality = 1 AND toxic = 0").select("doc_id").distinct()
    chosen = documents.select("doc_id").join(trusted, "doc_id", "left_semi").distinct().orderBy("doc_id").limit(rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    word = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,19}(?![A-Za-z0-9+/_=-])"), F.lit(0)))
    found = texts.select(word.alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(words)
    return sorted(r["w"] for r in found.collect())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the fixed patterns, in order."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _free(text: str, base: Sequence[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of key characters, and what fixed spans and UUIDs leave of them."""
    taken = sorted([(s, e) for s, _, e in base] + ([m.span() for m in UUID.finditer(text)] if "-" in text else []))
    next_taken = 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while next_taken < len(taken) and taken[next_taken][0] < end:
            s, e = taken[next_taken]
            if s - at >= SHORTEST:
                yield at, s
            at = max(at, e)
            if e > end:  # it reaches into what follows
                break
            next_taken += 1
        if end - at >= SHORTEST:
            yield at, end


def _widened(run: str, start: int, end: int) -> tuple[int, int]:
    """The stretch with the rest of the words it begins and ends in; equals signs end a key and begin none."""
    while start < end and run[start] == "=":
        start += 1
    while start > 0 and run[start] not in SEPARATORS and run[start - 1] not in SEPARATORS:
        start -= 1
    while end < len(run) and run[end - 1] not in SEPARATORS and run[end] not in SEPARATORS:
        end += 1
    return start, end


def model_spans(text: str, base: Sequence[tuple[int, int, int]], model: MarkovPair) -> list[tuple[int, int, int]]:
    """Stretches of runs that the models take for random, in order; they overlap no fixed span and not each other.

    Time is linear in the text.
    """
    spans: list[tuple[int, int, int]] = []
    for at, stop in _free(text, base):
        run = text[at:stop]
        found: list[tuple[int, int]] = []
        for s, e in model.stretches(run):
            if not found or e > found[-1][1]:  # else it lies in a word that is taken already
                found.append(_widened(run, s, e))
        if model.letters:
            # Letters only are judged by their own models alone.
            found = [(s, e) for s, e in found if not run[s:e].isalpha()]
            found += [m.span() for m in WORD.finditer(run) if model.letters.stretches(m.group())]
        for s, e in sorted(found):
            if e - s >= model.min_length:
                if spans and spans[-1][2] > at + s:
                    spans[-1] = (spans[-1][0], 3, max(spans[-1][2], at + e))
                else:
                    spans.append((at + s, 3, at + e))
    return spans


def written(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: Sequence[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones taken together, replaced by a mark."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(documents: DataFrame, model: MarkovPair, *, key: str = "doc_id", text: str = "text", redacted: bool = False) -> DataFrame:
    """One row for each row: the key, ``n_assign``, ``n_access``, ``n_hex``, ``n_markov`` (long), ``base_spans`` and ``spans`` (kind:start:end, comma-joined), ``base_sha256``.

    Offsets are code points, ends exclusive, by start, then kind. ``redacted`` adds the
    text with secrets replaced, as ``redacted``. Whole texts are scanned, of any length; a null
    text counts as empty and has no spans. Repeated rows are scanned each. Empty tables
    give no rows. Only the two columns are read, so others cannot clash.
    """
    ship_package(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, base_spans string, spans string" + ", redacted string" * redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                body = value.as_py() or ""
                base = base_spans(body)
                more = model_spans(body, base, model)
                count = [0, 0, 0]
                for _, k, _ in base:
                    count[k] += 1
                said = written(base)
                every = sorted(base + more)
                rows.append((*count, len(more), hashlib.sha256(said.encode()).hexdigest(), said, written(every), *([redact(body, every)] if redacted else [])))
            kinds = [pa.int64()] * 4 + [pa.string()] * (3 + redacted)
            names = [key, "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "base_spans", "spans", *(["redacted"] if redacted else [])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return documents.select(key, text).mapInArrow(tidy(run), schema)


def redact_documents(documents: DataFrame, model: MarkovPair, *, text: str = "text", length: str = "n_chars") -> DataFrame:
    """All rows and columns, with secrets in ``text`` replaced and ``length``, where there is such a column, set anew.

    A null text stays null. Texts without secrets, and their lengths, stay as they are,
    and so does every other column, whatever its name. Repeated rows are redacted each.
    Empty tables give no rows.
    """
    ship_package(documents.sparkSession)
    at = documents.columns.index(text)
    size = documents.columns.index(length) if length in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            sizes = columns[size].to_pylist() if size is not None else []
            for i, body in enumerate(texts):
                if body:
                    base = base_spans(body)
                    if found := base + model_spans(body, base, model):
                        texts[i] = redact(body, found)
                        if size is not None:
                            sizes[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if size is not None:
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(tidy(run), documents.schema)
