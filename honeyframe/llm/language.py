"""Language by unigram pieces with all segmentations summed.

Every language has probabilities over the pieces of a fixed public vocabulary
(and the 256 bytes, for characters that are no piece). A word's probability is
the sum over all ways to cut it into pieces, by the forward algorithm; a text's
is the product over its words. Training counts expected pieces by the backward
pass too (EM). Words are runs of letters in lower case, cut to at most
``WORD`` letters each; nothing but the text enters a prediction.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from honeyframe.llm.common import Written, rows_of
from honeyframe.llm.encoding import Recent, in_parts, kept, latest

WORD = 32
_MARK = "▁"
_STEP = 0x9E3779B97F4A7C15
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class Pieces:
    """The vocabulary, and words as arcs between their character positions."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.id_of = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                self.id_of.setdefault(sp.id_to_piece(i), i)
        self.size = sp.get_piece_size() + 256 + 1  # bytes, then a piece of probability 0
        self.byte = sp.get_piece_size()
        self.longest = max(map(len, self.id_of))
        hashes = {self._hash(p): i for p, i in self.id_of.items()}
        if len(hashes) < len(self.id_of):
            raise ValueError("two pieces have one hash")
        self.hashes = np.array(sorted(hashes), np.uint64)
        self.ids = np.array([hashes[h] for h in sorted(hashes)], np.int32)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _STEP + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def arcs(self, words: list[str]) -> np.ndarray:
        """Piece of each substring of words of one length: (words, start, length)."""
        n = len(words[0])
        wide = min(n, self.longest)
        none = self.size - 1
        out = np.full((len(words), n, wide + 1), none, np.int32)
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)
        h = np.zeros_like(code)
        for size in range(1, wide + 1):  # running hash of the substrings of one length
            starts = n - size + 1
            h = h[:, :starts] * np.uint64(_STEP) + code[:, size - 1 :]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out[:, :starts, size] = np.where(self.hashes[at] == h, self.ids[at], none)
        return out

    def bare(self, words: list[str], arcs: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """Characters that are no piece: (word, start, their bytes as pieces)."""
        odd = np.argwhere(arcs[:, :, 1] == self.size - 1)
        return [(k, i, [self.byte + b for b in words[k][i].encode()]) for k, i in odd.tolist()]


def forward(pieces: Pieces, words: list[str], prob: np.ndarray, expect: bool = False):
    """Probability of each word (all of one length) for each column of ``prob``
    and, on request, the chance of each arc times that."""
    arcs = pieces.arcs(words)
    bare = pieces.bare(words, arcs)
    m, n, wide = arcs.shape
    spare = np.zeros((m, n, prob.shape[1]))
    for k, i, units in bare:
        spare[k, i] = np.prod(prob[units], axis=0)
    alpha = np.zeros((n + 1, m, prob.shape[1]))
    alpha[0] = 1.0
    for i in range(n):
        for size in range(1, min(wide - 1, n - i) + 1):
            p = prob[arcs[:, i, size]]
            alpha[i + size] += alpha[i] * (p + spare[:, i] if size == 1 else p)
    if not expect:
        return alpha[n]
    beta = np.zeros_like(alpha)
    beta[n] = 1.0
    for i in range(n - 1, -1, -1):
        for size in range(1, min(wide - 1, n - i) + 1):
            p = prob[arcs[:, i, size]]
            beta[i] += beta[i + size] * (p + spare[:, i] if size == 1 else p)
    return alpha[n], arcs, bare, alpha, beta, spare


def by_length(words, most: int = 4096):
    """Words in groups of one length, bounded."""
    groups: dict[int, list] = {}
    for w in words:
        g = groups.setdefault(len(w), [])
        g.append(w)
        if len(g) == most:
            yield groups.pop(len(w))
    yield from groups.values()


def units(part: str) -> list[str]:
    """Marked words of a piece of text without white space."""
    if len(part) <= WORD and part.isascii() and part.isalpha():
        return [_MARK + part.lower()]
    out = []
    for w in _LETTERS.findall(part):
        w = w.lower()
        out += [_MARK + w[:WORD], *(w[i : i + WORD] for i in range(WORD, len(w), WORD))]
    return out


def _expected(model: str, prob: np.ndarray, langs: list[str]):
    """Sums of expected pieces by language over the labelled texts of a task."""

    def run(batches):
        pieces = kept(Pieces, model)
        table = prob if prob.shape[0] == pieces.size else np.full((pieces.size, 1), 1.0 / (pieces.size - 1))
        if table is not prob:
            table[-1] = 0.0
        column = {lang: k for k, lang in enumerate(langs)}
        counts: dict[str, dict[str, int]] = {}

        def sums():
            for lang, words in counts.items():
                p = table[:, [column[lang] if table is prob else 0]]
                total = np.zeros(pieces.size)
                for group in by_length(words):
                    whole, arcs, bare, alpha, beta, spare = forward(pieces, group, p, expect=True)
                    times = np.array([words[w] for w in group], float)
                    times = np.divide(times, whole[:, 0], out=np.zeros_like(times), where=whole[:, 0] > 0)
                    n = arcs.shape[1]
                    for i in range(n):
                        for size in range(1, min(arcs.shape[2] - 1, n - i) + 1):
                            share = alpha[i, :, 0] * beta[i + size, :, 0] * times
                            np.add.at(total, arcs[:, i, size], share * p[arcs[:, i, size], 0])
                    for k, i, us in bare:
                        share = alpha[i, k, 0] * spare[k, i, 0] * beta[i + 1, k, 0] * times[k]
                        for u in us:
                            total[u] += share
                hit = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(total[hit])], names=["lang", "piece", "n"]
                )
            counts.clear()

        held = 0
        for b in batches:
            texts = b.column(1)
            for lang in pc.unique(b.column(0)).to_pylist():
                c = counts.setdefault(lang, {})
                parts = pc.ascii_split_whitespace(texts.filter(pc.equal(b.column(0), lang))).flatten().value_counts()
                for part, n in zip(parts.field(0).to_pylist(), parts.field(1).to_pylist()):
                    for w in units(part):
                        if w in c:
                            c[w] += n
                        else:
                            c[w] = n
                            held += 1
            if held > 300_000:
                yield from sums()
                held = 0
        yield from sums()

    return run


class Model:
    def __init__(self, langs: list[str], prob: np.ndarray):
        self.langs, self.prob = langs, prob


def train(
    docs: DataFrame, model: str, lang: str = "lang", text: str = "text", id_col: str = "doc_id", sample: int = 5_000, rounds: int = 2, smooth: float = 0.1,
) -> Model:
    """Piece probabilities of every language among the labelled ``docs``.

    A language is learned from about ``sample`` documents at most, picked by the
    hash of their id: all of them where there are fewer. The driver gets pieces
    times languages, whatever the size of the table.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.lit(7), F.col(id_col)).alias("h")
    )
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    pieces = kept(Pieces, model)
    if not langs:
        return Model([], np.zeros((pieces.size, 0)))
    store = Written(docs.sparkSession)
    keep = F.lit(False)
    for name, n in sizes.items():
        top = int(min(1.0, sample / n) * 2**40)
        keep = keep | ((F.col("lang") == name) & (F.pmod("h", F.lit(2**40)) < top))
    chosen = store.write(labelled.where(keep).select("lang", "text"))
    prob = np.zeros((0, 0))
    for _ in range(rounds):
        got = chosen.mapInArrow(_expected(model, prob, langs), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        sums = np.full((pieces.size, len(langs)), smooth)
        sums[got["piece"].to_numpy(int), got["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int)] += got["n"].to_numpy()
        sums[-1] = 0.0
        prob = sums / sums.sum(axis=0)
    store.drop(chosen)
    return Model(langs, prob)


class Scorer:
    """Log likelihoods by language of the parts of texts, kept for later ones
    (4-byte floats; zeros for parts without letters)."""

    def __init__(self, model: str, cache: int = 300_000):
        self.pieces = kept(Pieces, model)
        self.seen = Recent(cache)

    def values(self, parts: list[str], prob: np.ndarray) -> np.ndarray:
        """A row for each of some distinct parts; unknown ones are done together."""
        new = self.seen.missing(set(parts))
        if new:
            place: dict[str, int] = {}
            each = [[place.setdefault(u, len(place)) for u in units(w)] for w in new]
            logs = np.zeros((len(place) + 1, prob.shape[1]))  # the last row is for parts without letters
            for group in by_length(place):
                logs[[place[u] for u in group]] = np.log(np.maximum(forward(self.pieces, group, prob), 1e-300))
            flat = [k for ks in each for k in ks or (len(place),)]
            starts = np.cumsum([0, *(max(len(ks), 1) for ks in each[:-1])])
            made, width = np.add.reduceat(logs[flat], starts).astype("<f4").tobytes(), 4 * prob.shape[1]
            for k, w in enumerate(new):
                self.seen[w] = made[k * width : (k + 1) * width]
        return np.frombuffer(b"".join(map(self.seen.__getitem__, parts)), "<f4").reshape(len(parts), -1)

    def totals(self, texts: pa.Array, prob: np.ndarray) -> np.ndarray:
        """Log likelihood of each text; zeros where it has no letter."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        known = split.flatten().dictionary_encode()
        rows = self.values(known.dictionary.to_pylist(), prob)
        # running sums do not change where nothing is added
        sums = np.cumsum(rows[known.indices.to_numpy()], axis=0, dtype=np.float64)
        sums = np.concatenate([np.zeros((1, prob.shape[1])), sums])
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        return sums[ends[1:]] - sums[ends[:-1]]


def predict(docs: DataFrame, model: Model, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``. The score is the language's share of the
    likelihood of all languages. ``und`` with score 0 where the text is null or
    has no letter, or no language was learned."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model.prob)
    langs, key = model.langs, zlib.crc32(model.prob.tobytes())
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        prob = broadcast.value
        scorer = latest("languages", f"{path} {key}", lambda: Scorer(path))
        for b in batches:
            for s in in_parts(b, 1):
                if not langs:
                    preds, scores = ["und"] * s.num_rows, [0.0] * s.num_rows
                else:
                    total = scorer.totals(s.column(1), prob)
                    best = total.argmax(axis=1)
                    share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                    letters = total.any(axis=1)  # every letter costs something
                    preds = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist())]
                    scores = np.where(letters, share, 0.0)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict all rows:
    ``doc_id, held_out, lang_pred, score``.

    Null labels and texts teach nothing; a null id is never held out; repeated
    rows are predicted each; long texts are read whole; of equally likely languages the
    first by name is given; an empty table gives an empty result.
    """
    model = train(docs.where(~held_out(id_col)), path, lang_col, text_col, id_col, **options)
    return predict(docs, model, path, id_col, text_col).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score")


def keep_languages(docs: DataFrame, path: str, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose text has a language with a score of ``least``."""
    found = identify(docs, path, id_col, text_col, **options)
    # ids may repeat with other texts: the decision depends on the text alone
    ok = found.groupBy("doc_id").agg(F.max(((F.col("lang_pred") != "und") & (F.col("score") >= least)).cast("int")).alias("_ok"))
    has_letter = F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")
    return rows_of(docs.where(has_letter), ok.where("_ok = 1").select("doc_id"), id_col)
