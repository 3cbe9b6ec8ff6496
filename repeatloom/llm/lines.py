"""Per-document text statistics, and lines labelled prose, list, table or junk by a hidden Markov model."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatloom.session import Scratch

KINDS = ["prose", "list", "table", "junk"]
PROSE, LIST, TABLE, JUNK = range(4)
SPACE, LOWER, UPPER, DIGIT, SYMBOL, LETTER = range(6)  # classes of characters; LETTER: one without case
#: Characters that are worked on at once.
CHUNK = 1 << 21


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point of the basic plane: class, lower case, and 0 to 25 for a to z with or without accents (else 26)."""
    kind, lower, base = np.full(65537, SYMBOL, np.uint8), np.arange(65537, dtype=np.uint32), np.full(65537, 26, np.uint8)
    for c in range(65536):
        s = chr(c)
        category = unicodedata.category(s)
        if category[0] == "L":
            kind[c] = UPPER if category == "Lu" else LOWER if category == "Ll" else LETTER
            small = s.lower()
            lower[c] = ord(small) if len(small) == 1 else c
            plain = unicodedata.normalize("NFD", small)[0]
            if "a" <= plain <= "z":
                base[c] = ord(plain) - ord("a")
        elif category[0] == "N":
            kind[c] = DIGIT
    kind[[ord(c) for c in " \t\n\r\f\v"]] = SPACE
    kind[65536] = LETTER  # all beyond the basic plane
    return kind, lower, base


_PRIME = 0x9E3779B97F4A7C15


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64."""
    inverse = pow(_PRIME, -1, 1 << 64)
    return tuple(np.append(np.uint64(1), np.cumprod(np.full(n, p, np.uint64))) for p in (_PRIME, inverse))


def _hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, end) of an array of lower-case characters; the same for a word wherever it stands."""
    n = len(low)
    power, inverse = _powers(1 << max(12, n.bit_length()))
    total = np.append(np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n]))
    return (total[end] - total[start]) * inverse[start]


def word_hashes(words: list[str]) -> np.ndarray:
    words = [w for w in words if w]
    size = np.array([len(w) for w in words], np.int64)
    low = np.array([ord(c) for w in words for c in w.lower()], np.uint32)
    return np.unique(_hashes(low, np.cumsum(size) - size, np.cumsum(size)))


def line_statistics(texts: list[str], common: np.ndarray, pairs: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Statistics of each line of some texts. `doc` is the text's position; lines of white space alone are not `full`.

    pairs: the log probability of each pair of letters (27 x 27), for `pair_sum` over the `pairs` of a line,
    and `back_sum`, the same read backwards.
    """
    kind_of, lower_of, base_of = _characters()
    # a space at the end: every position has one that follows
    code = np.frombuffer(("\n".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.minimum(code, 65536)
    n, kind = len(code) - 1, kind_of[code]
    newline = np.flatnonzero(code == 10)
    start, end = np.append(0, newline + 1), np.append(newline, n)
    lines = len(start)
    line_of = np.cumsum(code == 10, dtype=np.int32)
    per_line = lambda at, weight=None: np.bincount(line_of[at], weight, lines)

    of = np.bincount(line_of[:n] * 8 + kind[:n], minlength=lines * 8).reshape(lines, 8)
    of[1:, SPACE] -= 1  # the line feed before
    out = {"doc": np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts]), "chars": end - start}
    out |= {"letters": of[:, LOWER] + of[:, UPPER] + of[:, LETTER], "digits": of[:, DIGIT], "symbols": of[:, SYMBOL], "spaces": of[:, SPACE]}
    out["full"] = out["chars"] > out["spaces"]
    symbol = np.flatnonzero(kind[:n] == SYMBOL)
    mark = code[symbol]
    dot = symbol[mark == ord(".")]
    beside = np.diff(dot) == 1
    out["leaders"] = per_line(dot[np.append(False, beside) | np.append(beside, False)] if len(dot) else dot)
    out["rules"] = per_line(symbol[np.isin(mark, [ord(c) for c in "-|=+_"])])
    out["bullet"] = out["full"] & (kind[start] == SYMBOL)
    solid = np.flatnonzero(kind[:n] != SPACE)
    last = solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] if len(solid) else np.zeros(lines, np.int64)
    out["stop"] = out["full"] & np.isin(code[last], [ord(c) for c in ".!?;:"])

    letter = (kind == LOWER) | (kind == UPPER) | (kind == LETTER)
    edge = np.diff(letter.astype(np.int8), prepend=np.int8(0))
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size, low = we - ws, lower_of[code]
    differs = np.append(0, np.cumsum(low[1:] != low[:-1], dtype=np.int32))
    known = np.isin(_hashes(low, ws, we), common)
    out["words"] = per_line(ws)
    out["word_letters"] = out["letters"]
    # a single letter (but an initial or a coin's) or one letter repeated
    proper = (size == 1) & (((kind[ws] == UPPER) & (code[we] == ord("."))) | ((ws > 0) & (kind[ws - 1] == DIGIT)))
    odd = (differs[we - 1] == differs[ws]) & ~proper
    for name, mask in (("common", known), ("common_long", known & (size > 1)), ("odd", odd), ("capital", kind[ws] == UPPER), ("long", size >= 3)):
        out[name] = per_line(ws[mask])

    edge = np.diff((kind[:n] != SPACE).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    ts, te = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # tokens: what stands between white space
    inside = lambda m: (t := np.append(0, np.cumsum(m, dtype=np.int32)))[te] - t[ts]
    letters, digits, marks = inside(letter), inside(kind == DIGIT), inside((kind == SYMBOL) & (code != ord(".")) & (code != ord(",")))
    rule = inside(np.isin(code, [ord(c) for c in "-|=+_."]))
    coin = (letters == 0) | ((letters == 1) & (np.isin(code[te - 1], [ord("s"), ord("d")]) | np.isin(code[np.maximum(te - 2, 0)], [ord("s"), ord("d")])))
    initial = (letters == 1) & (digits == 0) & (marks <= 1) & (kind[ts] == UPPER) & (code[ts + 1] == ord("."))
    clean = initial | (rule == te - ts) | ((marks * 3 <= letters) & (digits == 0) & (letters >= 3)) | ((marks * 3 <= digits) & (digits > 0) & coin & (te - ts <= digits + 3))
    out["tokens"], out["clean"] = per_line(ts), per_line(ts[clean])

    edge = np.diff((kind == DIGIT).astype(np.int8), prepend=np.int8(0))
    ds, de = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(ds):
        after, apart = code[de], ds[1:] - de[:-1]
        decimal = (apart == 1) & np.isin(after[:-1], [ord("."), ord(",")])
        money = (apart <= 6) & np.isin(after[:-1], [ord(c) for c in "sSfſ"]) & np.isin(after[1:], [ord(c) for c in "dDc"])
        # a number that counts the entries of a list, as in "3) " or "3. Name", is no figure
        ordinal = (after == ord(")")) | ((after == ord(".")) & np.isin(kind[np.minimum(de + 2, n)], [LOWER, UPPER]) & (kind[np.minimum(de + 1, n)] == SPACE))
        ds = ds[np.append(True, (line_of[ds[1:]] != line_of[ds[:-1]]) | ~(decimal | money)) & ~ordinal]
    out["figures"] = per_line(ds)

    if pairs is not None:
        first = np.flatnonzero(letter[:-1] & letter[1:])
        base = base_of[code].astype(np.int16)
        a, b = base[first], base[first + 1]
        out["pairs"], out["pair_sum"] = per_line(first), per_line(first, pairs.ravel()[a * 27 + b])
        out["back_sum"] = per_line(first, pairs.ravel()[b * 27 + a])
    return out


def _pair_counts(texts: list[str], wanted: np.ndarray) -> np.ndarray:
    """Counts of letter pairs in the wanted lines."""
    _, _, base_of = _characters()
    lines = "\n".join(texts).split("\n")
    code = np.frombuffer("\n".join(x for x, w in zip(lines, wanted) if w).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind_of = _characters()[0]
    capped = np.minimum(code, 65536)
    letter = np.isin(kind_of[capped], [LOWER, UPPER, LETTER])
    at = np.flatnonzero(letter[:-1] & letter[1:])
    return np.bincount(base_of[capped[at]].astype(np.int64) * 27 + base_of[capped[at + 1]], minlength=729).reshape(27, 27)


@dataclass
class LineModel:
    """A hidden Markov model: log probabilities of the first kind, of kinds after kinds, and of each observation."""

    common: np.ndarray
    pairs: np.ndarray
    pair_mean: float
    pair_sd: float
    first: np.ndarray
    after: np.ndarray
    seen: list[np.ndarray]


#: Values of each observation of a line, in order: figures, figures for each long word in the lines about it, common words,
#: strangeness of letter pairs, whether they read better backwards, symbols, words, capitals, odd words, clean tokens in the
#: lines about it, long words, stop, bullet.
CARDINALITY = [3, 5, 4, 5, 4, 4, 5, 4, 3, 3, 3, 2, 2]
#: Lines before and after a line that count as about it.
ABOUT = 3
#: Lines that look like entries of a list are plain to see if so many follow each other; fewer may be an advert or a heading.
ENTRIES = 5


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _about(doc: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums over the lines about each line of its document."""
    at = np.arange(len(doc))
    low = np.maximum(at - ABOUT, np.searchsorted(doc, doc))
    high = np.minimum(at + ABOUT + 1, np.searchsorted(doc, doc, side="right"))
    totals = [np.append(0, np.cumsum(v)) for v in values]
    return [t[high] - t[low] for t in totals]


def observations(s: dict[str, np.ndarray], model: LineModel) -> np.ndarray:
    """Statistics of full lines as one small number per line and observation."""
    words, root = s["words"], np.sqrt(s["pairs"]) / model.pair_sd
    strange = (model.pair_mean - _share(s["pair_sum"], s["pairs"])) * root
    forward = _share(s["pair_sum"] - s["back_sum"], s["pairs"]) * root
    plain = np.maximum(s["chars"] - s["spaces"] - s["leaders"], 1)
    symbols = (s["symbols"] - s["leaders"]) / plain
    ruled = (s["letters"] + s["digits"] == 0) & (s["rules"] >= 3) & (s["rules"] >= 0.8 * s["symbols"])
    figures, long, clean, tokens = _about(s["doc"], s["figures"], s["long"], s["clean"], s["tokens"])
    return np.stack(
        [
            np.minimum(s["figures"], 2),
            np.digitize(figures / np.maximum(long, 0.5), [1e-9, 0.25, 0.75, 1.4]),
            np.digitize(_share(s["common_long"], words), [1e-9, 0.12, 0.26]),
            np.where(s["pairs"] < 3, 0, 1 + np.digitize(strange, [2.0, 4.0, 8.0])),
            np.where(s["pairs"] < 6, 0, 1 + np.digitize(forward, [-0.5, 0.8])),
            np.where(ruled, 3, np.digitize(symbols, [0.12, 0.4])),
            np.digitize(words, [1, 2, 4, 6]),
            np.where(words == 0, 0, 1 + np.digitize(_share(s["capital"], words), [0.3, 0.7])),
            np.digitize(_share(s["odd"], words), [0.3, 0.6]),
            np.digitize(_share(clean, tokens), [0.55, 0.75]),
            np.minimum(s["long"], 2),
            s["stop"].astype(np.int64),
            s["bullet"].astype(np.int64),
        ],
        axis=1,
    ).astype(np.int8)


def _runs(values: np.ndarray, new_doc: np.ndarray) -> np.ndarray:
    """For each line, how many lines of its document in a row have its value."""
    run = np.cumsum(np.append(True, values[1:] != values[:-1]) | new_doc) - 1
    return np.bincount(run)[run]


def _first_guess(o: np.ndarray, new_doc: np.ndarray) -> np.ndarray:
    """A kind for the lines that are plain to see, else -1: where training starts."""
    figures, ratio, common, strange, back, symbols, words, capitals, odd, clean, long, _, bullet = o.T
    guess = np.full(len(o), -1)
    entry = (words == 1) | ((bullet == 1) & (words <= 3)) | ((figures == 1) & (capitals >= 2)) | ((capitals == 3) & (words >= 2))
    guess[(common == 0) & (ratio <= 3) & (odd <= 1) & (strange <= 2) & (symbols < 2) & (long >= 1) & (back != 1) & (clean >= 1) & entry] = LIST
    guess[(guess == LIST) & (_runs(guess, new_doc) < ENTRIES)] = -1
    guess[(ratio == 4) & (common <= 1) & (clean >= 1) & ((figures >= 1) | (long >= 1)) & (strange <= 2)] = TABLE
    guess[(symbols == 3) & (clean >= 1)] = TABLE
    guess[(common >= 2) & (words >= 3) & (odd == 0) & (back != 1)] = PROSE
    guess[((odd == 2) & (words >= 3)) | ((strange >= 3) & (common <= 1)) | ((back == 1) & (strange >= 2)) | ((clean == 0) & (common <= 1))] = JUNK
    # lines between prose lines belong to the article
    at = np.arange(len(o))
    doc = np.cumsum(new_doc)
    before = np.maximum.accumulate(np.where(guess >= 0, at, 0))
    after = np.minimum.accumulate(np.where(guess >= 0, at, len(o) - 1)[::-1])[::-1]
    prose = lambda i: (guess[i] == PROSE) & (doc[i] == doc)
    guess[(guess < 0) & prose(before) & prose(after) & (after - before <= 2 * ENTRIES)] = PROSE
    return guess


def _estimate(kinds: np.ndarray, o: np.ndarray, new_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Log probabilities from labelled lines (-1: not labelled), each count raised by one."""
    first = np.bincount(kinds[new_doc & (kinds >= 0)], minlength=4) + 1.0
    both = ~new_doc[1:] & (kinds[1:] >= 0) & (kinds[:-1] >= 0)
    after = np.bincount(kinds[:-1][both] * 4 + kinds[1:][both], minlength=16).reshape(4, 4) + 1.0
    seen = []
    for j, size in enumerate(CARDINALITY):
        table = np.ones((4, size))
        np.add.at(table, (kinds[kinds >= 0], o[kinds >= 0, j]), 1)
        seen.append(np.log(table / table.sum(1, keepdims=True)))
    return np.log(first / first.sum()), np.log(after / after.sum(1, keepdims=True)), seen


def viterbi(o: np.ndarray, doc: np.ndarray, model: LineModel) -> np.ndarray:
    """The likeliest kinds of the lines of each document, all documents at once, line by line."""
    if not len(o):
        return np.array([], np.int64)
    emit = sum(model.seen[j].T[o[:, j]] for j in range(o.shape[1]))
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    length = np.diff(np.append(begin, len(doc)))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    score = model.first + emit[begin]
    back = np.zeros((len(o), 4), np.int8)
    for t in range(1, int(length[0])):
        m = np.searchsorted(-length, -t, side="left")  # documents of more than t lines
        step = score[:m, :, None] + model.after
        back[begin[:m] + t] = step.argmax(1)
        score[:m] = step.max(1) + emit[begin[:m] + t]
    kinds = np.empty(len(o), np.int64)
    now = score.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        m = np.searchsorted(-length, -t, side="left")
        kinds[begin[:m] + t] = now[:m]
        now[:m] = back[begin[:m] + t, now[:m]]
    return kinds


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= CHUNK:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def letter_pairs(texts: list[str], known: np.ndarray) -> np.ndarray:
    """Counts of letter pairs (27 x 27) in the lines of some texts that are plain to read by their common words."""
    counts = np.zeros((27, 27), np.int64)
    for lo, hi in _chunks(texts):
        s = line_statistics(texts[lo:hi], known)
        counts += _pair_counts(texts[lo:hi], (_share(s["common_long"], s["words"]) >= 0.2) & (s["words"] >= 4))
    return counts


def fit(texts: list[str], common: list[str], pair_counts: np.ndarray | None = None, rounds: int = 2) -> LineModel:
    """Trains the model on some texts: from the lines that are plain to see, then by labelling the others in turn.

    pair_counts: `letter_pairs` of the whole corpus; of the texts themselves if not given.
    """
    known = word_hashes(common)
    texts = texts or [""]
    counts = (letter_pairs(texts, known) if pair_counts is None else pair_counts) + 0.5
    pairs = np.log(counts / counts.sum(1, keepdims=True))
    p = counts / counts.sum()
    mean = float((p * pairs).sum())
    model = LineModel(known, pairs, mean, float(np.sqrt((p * (pairs - mean) ** 2).sum())) or 1.0, np.zeros(4), np.zeros((4, 4)), [])
    s = line_statistics(texts, known, pairs)
    s = {k: v[s["full"]] for k, v in s.items()}
    o, doc = observations(s, model), s["doc"]
    if not len(o):
        o, doc = np.zeros((1, len(CARDINALITY)), np.int8), np.zeros(1, np.int64)
    new_doc = np.append(True, doc[1:] != doc[:-1])
    plain = kinds = _first_guess(o, new_doc)
    for _ in range(rounds):
        model.first, model.after, model.seen = _estimate(kinds, o, new_doc)
        kinds = np.where(plain >= 0, plain, viterbi(o, doc, model))
    model.first, model.after, model.seen = _estimate(kinds, o, new_doc)
    return model


STATISTICS = ["n_words", "mean_word_length", "symbol_ratio", "line_stop_share", "common_word_share"]


def _describe(common: np.ndarray, model: LineModel | None):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _chunks(texts):
                s = line_statistics(texts[lo:hi], common, model.pairs if model else None)
                n, full, doc = hi - lo, s["full"], s["doc"]
                total = lambda name: np.bincount(doc, s[name], n)  # noqa: E731, B023
                lines, words, chars = total("full"), total("words"), total("chars") + total("full") * 0
                chars += np.bincount(doc, minlength=n) - 1  # the line feeds
                share = lambda a, b: pa.array(np.where(b > 0, a / np.maximum(b, 1), 0.0), mask=b == 0)
                columns = [
                    b.column(0).slice(lo, n), pa.array(lines.astype(np.int64)), pa.array(words.astype(np.int64)),
                    share(total("word_letters"), words), share(total("symbols"), chars), share(total("stop"), lines), share(total("common"), words),
                ]
                names = ["doc", "n_lines", *STATISTICS]
                if model:
                    kinds = viterbi(observations({k: v[full] for k, v in s.items()}, model), doc[full], model)
                    of = np.bincount(doc[full] * 4 + kinds, minlength=4 * n).reshape(n, 4)
                    columns += [share(of[:, k], lines) for k in range(4)]
                    other = np.array(KINDS, object)[1 + of[:, 1:].argmax(1)]
                    columns.append(pa.array(np.where(of[:, 0] * 2 < lines, other, "prose"), pa.string(), mask=lines == 0))
                    names += [f"{k}_share" for k in KINDS] + ["kind"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return describe


def _schema(df: DataFrame, doc: str, labels: bool) -> str:
    statistics = "n_lines bigint, n_words bigint, " + ", ".join(f"{s} double" for s in STATISTICS[1:])
    return f"doc {dict(df.dtypes)[doc]}, {statistics}" + (", " + ", ".join(f"{k}_share double" for k in KINDS) + ", kind string" if labels else "")


def document_statistics(df: DataFrame, doc: str, text: str, common: list[str]) -> DataFrame:
    """Word count, mean word length, symbol ratio, share of lines that end in punctuation and share of common words.

    Words are runs of letters; symbols are characters other than letters, numbers and white space; lines are those
    with more than white space, a stop one of . ! ? ; : at the end. Shares of nothing are null, as for a null or
    empty text, which has no words. One row per row of `df`; repeated rows come out repeated; other columns are not
    read. No shuffle.
    """
    return df.select(doc, text).mapInArrow(_describe(word_hashes(common), None), _schema(df, doc, False))


def _corpus(known: np.ndarray):
    """Of a task's texts: counts of letter pairs, and characters as pair -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, chars = np.zeros((27, 27), np.int64), 0
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t]
            counts += letter_pairs(texts, known)
            chars += sum(map(len, texts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 729)), pa.array(np.append(chars, counts.ravel()))], ["pair", "n"])

    return count


def fit_lines(df: DataFrame, text: str, common: list[str], sample_chars: int = 4_000_000) -> LineModel:
    """Trains the line model: letter pairs are counted over all texts, the kinds of lines are fitted on a sample.

    The sample has at most 1.1 `sample_chars` characters of different texts, those of least hash, so it does not depend
    on how rows are stored, and copies of a text count once. Texts are never cut; one of more than a tenth of
    `sample_chars` is not drawn.
    """
    counted = df.select(text).mapInArrow(_corpus(word_hashes(common)), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    of = {r["pair"]: r["n"] for r in counted.collect()}  # 730 rows
    total = of.pop(-1, 0)
    pairs = np.array([of.get(i, 0) for i in range(729)]).reshape(27, 27)
    part = min(1.0, sample_chars / max(total, 1))
    place = F.shiftrightunsigned(F.xxhash64(text), 32)
    drawn = df.where((place < int(part * (1 << 32))) & F.length(text).between(1, sample_chars // 10)).select(text).distinct()
    drawn = Scratch(df.sparkSession, "sample").write(drawn.select(F.col(text).alias("text"), place.alias("place")), "texts")
    run = F.sum(F.length("text")).over(Window.orderBy("place", "text"))  # of the drawn texts only, about sample_chars characters
    texts = drawn.withColumn("run", run).where(F.col("run") - F.length("text") <= sample_chars)
    return fit([r["text"] for r in texts.orderBy("place", "text").select("text").collect()], common, pairs)


def label_lines(df: DataFrame, doc: str, text: str, model: LineModel, common: list[str]) -> DataFrame:
    """`document_statistics` with the share of lines of each kind, and the document's kind.

    kind: prose if at least half of the lines are, else the most frequent other kind (ties: list, table, junk in
    this order); null if the document has no lines.
    """
    model.common = word_hashes(common)
    return df.select(doc, text).mapInArrow(_describe(model.common, model), _schema(df, doc, True))
