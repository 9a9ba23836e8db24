"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a
probability per piece, and a word's probability is the sum over all ways to
segment it into pieces (forward algorithm); a text's is the product over its
words. Words are runs of letters, lower-cased and marked at their start, so no
piece crosses a word and equal words cost one forward pass.

Training counts the words of each language over all training documents, then
takes one or more EM steps on the distinct words: forward-backward gives the
expected count of each piece. The first step starts from equal probabilities.
Only the piece table (vocabulary x languages) reaches the driver; its size is
checked against ``MOST_LANGUAGES``.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import batch, map_rows, stored

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words of up to this many letters, with their mark, are summed side by side;
#: longer ones one by one, in logarithms. The sums are the same.
RUN = 33
#: Probabilities are scaled by 2^SCALE a letter (exact in doubles), so that
#: neither the likeliest run leaves their range (30 x 33 < 1023) nor the least
#: likely, down to 5e-19 a letter: what 10^17 pieces of a language leave unseen.
SCALE = 30
SMOOTHING = 0.05
EM_STEPS = 1
#: Bound of the table sent to tasks (pieces x languages doubles): refuse more.
MOST_LANGUAGES = 512
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH, _KEEP, _CHARACTERS = 100_000, 400_000, 8_000_000


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, of any length, marked at the start."""
    return [MARK + w for w in _WORD.findall(text.lower())]


class Pieces:
    """The vocabulary's pieces of letters; one more stands for any letter it lacks."""

    # once per Python worker, not per task
    @classmethod
    @lru_cache(maxsize=1)
    def load(cls, path: str) -> Pieces:
        return cls(path)

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = sorted({p for p in map(model.id_to_piece, range(model.get_piece_size())) if not p.startswith("<") and all(c.isalpha() or c == MARK for c in p) and MARK not in p[1:]} | {MARK})
        self.find, self.other = ahocorasick.Automaton(), len(kept)
        for i, p in enumerate(kept):
            self.find.add_word(p, (i, len(p)))
        self.find.make_automaton()
        self.single = {p for p in kept if len(p) == 1}

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all places of pieces in the words: word, end, piece, length; and the words' lengths."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        line = "\n".join(words)
        first = np.concatenate([[0], np.cumsum(size + 1)])
        end, piece, length = [], [], []
        for e, (i, n) in self.find.iter(line):
            end.append(e)
            piece.append(i)
            length.append(n)
        lacks = set(line) - self.single - {"\n"}
        if lacks:
            for m in re.finditer("[" + re.escape("".join(sorted(lacks))) + "]", line):
                end.append(m.start())
                piece.append(self.other)
                length.append(1)
        end, piece, length = (np.array(x, np.int64) for x in (end, piece, length))
        word = np.searchsorted(first, end, "right") - 1
        return word, end - first[word] + 1, piece, length, size


def forward(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """log P of each word per language; ``p`` is pieces x languages."""
    out = np.empty((len(words), p.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= RUN]
    if short:
        word, end, piece, length, size = pieces.matches([words[i] for i in short])
        total = _forward(word, end, piece, length, size, p)
        out[short] = np.log(total[np.arange(len(short)), size]) - (SCALE * np.log(2) * size)[:, None]
    for i, w in enumerate(words):
        if len(w) > RUN:
            _, end, piece, length, _ = pieces.matches([w])
            out[i] = _log_sums(end, end - length, piece, len(w), np.log(p))[-1]
    return out


def _log_sums(to: np.ndarray, since: np.ndarray, piece: np.ndarray, n: int, log_p: np.ndarray) -> np.ndarray:
    """log P of the first 0 to n letters per language: all ways to reach ``to``
    from ``since`` by one more piece, of one word."""
    out = np.full((n + 1, log_p.shape[1]), -np.inf)
    out[0] = 0
    for j, here in enumerate(_by(to, n + 1)):
        if len(here):
            out[j] = np.logaddexp.reduce(out[since[here]] + log_p[piece[here]], axis=0)
    return out


def _by(x: np.ndarray, n: int):
    order = np.argsort(x, kind="stable")
    cut = np.searchsorted(x[order], np.arange(n + 1))
    return [order[cut[i] : cut[i + 1]] for i in range(n)]


def _add(to: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    for k in range(values.shape[1]):
        to[:, k] += np.bincount(at, values[:, k], len(to))


def _forward(word, end, piece, length, size, p) -> np.ndarray:
    """P of each word's first letters per language, times 2^SCALE for each letter."""
    most = int(size.max(initial=0))
    alpha = np.zeros((len(size), most + 1, p.shape[1]))
    alpha[:, 0] = 1
    for j, here in enumerate(_by(end, most + 1)):
        if len(here):
            _add(alpha[:, j], word[here], alpha[word[here], j - length[here]] * (p[piece[here]] * np.exp2(SCALE * length[here])[:, None]))
    return alpha


def expected_counts(pieces: Pieces, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected count of each piece in the weighted words, over all segmentations, for one column of probabilities."""
    out = np.zeros(pieces.other + 1)
    for i, w in enumerate(words):
        if len(w) > RUN:
            _, end, piece, length, _ = pieces.matches([w])
            log_p, n = np.log(p), len(w)
            before = _log_sums(end, end - length, piece, n, log_p)[:, 0]
            behind = _log_sums(n - end + length, n - end, piece, n, log_p)[::-1, 0]  # read from the end
            share = np.exp(before[end - length] + log_p[piece, 0] + behind[end] - before[n])
            out += np.bincount(piece, share * weight[i], pieces.other + 1)
    short = [i for i, w in enumerate(words) if len(w) <= RUN]
    if not short:
        return out
    words, weight = [words[i] for i in short], weight[short]
    word, end, piece, length, size = pieces.matches(words)
    alpha = _forward(word, end, piece, length, size, p)[:, :, 0]
    beta = np.zeros_like(alpha)
    beta[np.arange(len(size)), size] = 1
    start = end - length
    for j, here in reversed(list(enumerate(_by(start, alpha.shape[1])))):
        if len(here):
            beta[:, j] += np.bincount(word[here], beta[word[here], end[here]] * (p[piece[here], 0] * np.exp2(SCALE * length[here])), len(size))
    whole = alpha[np.arange(len(size)), size]
    share = alpha[word, start] * (p[piece, 0] * np.exp2(SCALE * length)) * beta[word, end] / whole[word]
    return out + np.bincount(piece, share * weight[word], pieces.other + 1)


def _count_words(batches):
    kinds = {"lang": pa.string(), "word": pa.string(), "n": pa.int64()}

    def out(count):
        return batch(kinds, {"lang": [k for k, c in count.items() for _ in c], "word": [w for c in count.values() for w in c], "n": [n for c in count.values() for n in c.values()]})

    count: dict[str, Counter] = {}
    characters = 0
    for rb in batches:
        for lang, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
            words = words_of(text)
            count.setdefault(lang, Counter()).update(words)
            characters += sum(len(w) for w in words if len(w) > RUN)  # long words: few, but large
            if sum(map(len, count.values())) >= _FLUSH or characters >= _CHARACTERS:
                yield out(count)
                count, characters = {}, 0
    yield out(count)


def _em(path: str, langs: list[str], p: np.ndarray | None):
    def run(batches):
        pieces, at = Pieces.load(path), {x: i for i, x in enumerate(langs)}
        flat = np.full((pieces.other + 1, 1), 1 / (pieces.other + 1))
        total = np.zeros((len(langs), pieces.other + 1))
        for rb in batches:
            lang, word, n = rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_numpy()
            which = np.fromiter((at[x] for x in lang), np.int64, len(lang))
            for k in np.unique(which):
                here = np.flatnonzero(which == k)
                for lo in range(0, len(here), 4096):
                    some = here[lo : lo + 4096]
                    total[k] += expected_counts(pieces, [word[i] for i in some], n[some].astype(float), flat if p is None else p[:, k : k + 1])
        k, i = np.nonzero(total)
        yield batch({"lang": pa.int32(), "piece": pa.int32(), "n": pa.float64()}, {"lang": k, "piece": i, "n": total[k, i]})

    return run


def train(labelled: DataFrame, path: str, steps: int = EM_STEPS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces x languages) from rows (lang, text)."""
    labelled = labelled.filter("lang is not null and text is not null")
    words = map_rows(labelled.select("lang", "text"), _count_words, "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = [r[0] for r in labelled.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    size, p = Pieces.load(path).other + 1, None
    for _ in range(steps if langs else 0):
        counts = map_rows(words, _em(path, langs, p), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        table = np.full((size, len(langs)), SMOOTHING)
        for k, i, n in counts.collect():  # at most pieces x languages rows
            table[i, k] += n
        p = table / table.sum(axis=0)
    return langs, p


def _predict(path: str, langs: list[str], p: np.ndarray | None):
    def run(batches):
        pieces = Pieces.load(path)
        known, table, characters = {}, np.empty((0, len(langs))), 0  # a word's row in the table of log P
        for rb in batches:
            words = [words_of(t) if t and langs and any(map(str.isalpha, t)) else [] for t in rb.column(2).to_pylist()]
            fresh = set().union(*words) - known.keys()
            if len(known) + len(fresh) > _KEEP or characters > _CHARACTERS:
                known, table, fresh, characters = {}, table[:0], set().union(*words), 0
            fresh = list(fresh)
            characters += sum(len(w) for w in fresh if len(w) > RUN)
            rows = [forward(pieces, fresh[lo : lo + 8192], p) for lo in range(0, len(fresh), 8192)]
            known.update(zip(fresh, range(len(table), len(table) + len(fresh))))
            table = np.concatenate([table, *rows])
            pred, score = [], []
            for text in words:
                s = table[np.fromiter(map(known.__getitem__, text), np.int64, len(text))].sum(axis=0)
                best = int(np.argmax(s)) if text else -1
                pred.append(langs[best] if text else "und")
                score.append(float(1 / np.exp(s - s[best]).sum()) if text else 0.0)
            yield batch({"doc_id": pa.int64(), "held_out": pa.bool_(), "lang_pred": pa.string(), "score": pa.float64()}, {"doc_id": rb.column(0), "held_out": rb.column(1), "lang_pred": pred, "score": score})

    return run


def identify_languages(docs: DataFrame, path: str | None = None, steps: int = EM_STEPS, folds: int = 5) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (posterior of the language under equal priors).

    Learns from rows with a lang and a text whose crc32 of the id as text is
    not divisible by ``folds``; predicts every row from its text alone. Null
    texts and texts without a letter give ``und`` and 0; so does everything
    when nothing can be learned. A null id counts as an empty text (remainder
    0, held out). Ties go to the first language by code point. Other columns
    are not read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text", "lang")
    langs, p = train(d.filter(~F.col("held_out")).select("lang", "text"), path, steps)
    return map_rows(d.select("doc_id", "held_out", "text"), _predict(path, langs, p), "doc_id long, held_out boolean, lang_pred string, score double")
