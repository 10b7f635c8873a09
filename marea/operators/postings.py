"""Terms of texts counted in Arrow batches: what a batch says of a term, a topic or a pair leaves the task as one row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that are sorted at once; a longer text is by itself.
WORDS = 1 << 22
#: Products, and sums of pairs, that are held at once; a text's own are held whatever their number.
HELD = 1 << 21


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Rows, their words in a row and the row of each word, of at most WORDS words or one text."""
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("words").offsets.to_numpy())).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + WORDS, "right")))
            rows = batch.slice(at, to - at)
            yield rows, rows.column("words").flatten(), np.repeat(np.arange(to - at, dtype=np.int64), np.diff(ends[at:to], prepend=before))
            at = to


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and where each begins among the sorted ones; the end comes last."""
    keys.sort()
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[firsts], np.append(firsts, len(keys))


def _stats(terms: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n rows: the distinct terms, how many rows have each and how often it occurs."""
    both, at = _groups(terms * n + rows)
    found, firsts = _groups(both // n)
    return found, np.diff(firsts), at[firsts[1:]] - at[firsts[:-1]]


def counts(bigrams: bool) -> Callable:
    """For mapInArrow over words: term, df and total of each batch; a pair of neighbours is a term too."""

    def run(batches):
        for rows, flat, row in _pieces(batches):
            coded = flat.dictionary_encode()
            words, code, n = coded.dictionary, coded.indices.to_numpy().astype(np.int64), rows.num_rows
            found, df, total = _stats(code, row, n)
            yield pa.record_batch([words.take(pa.array(found)), pa.array(df), pa.array(total)], names=["term", "df", "total"])
            if bigrams and len(code) > 1:
                same = row[1:] == row[:-1]
                found, df, total = _stats((code[:-1] * len(words) + code[1:])[same], row[1:][same], n)
                a, b = np.divmod(found, max(len(words), 1))
                yield pa.record_batch([pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), " "), pa.array(df), pa.array(total)], names=["term", "df", "total"])

    return run


class Coder:
    """The numbers of a vocabulary's terms, words and pairs of neighbours, by the words of a text."""

    def __init__(self, terms: list[str]):
        split = [t.split(" ") for t in terms]
        known = sorted({w for s in split for w in s})
        number = {w: i for i, w in enumerate(known)}
        self.words, self.single = pa.array(known, pa.string()), np.full(len(known) + 1, -1, np.int64)  # a word that is not known is the last
        pairs = []
        for i, s in enumerate(split):
            if len(s) == 1:
                self.single[number[s[0]]] = i
            else:
                pairs.append((number[s[0]] * len(known) + number[s[1]], i))
        # with one key above all others, so that a search always ends on one
        self.pairs, self.pair = np.array([*sorted(pairs), (np.iinfo(np.int64).max, -1)], np.int64).T.copy()

    def __call__(self, flat: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term and row of each occurrence."""
        w = len(self.words)
        code = pc.fill_null(pc.index_in(flat, value_set=self.words), w).to_numpy().astype(np.int64)
        one = self.single[code]
        next_ = np.flatnonzero((row[1:] == row[:-1]) & (code[1:] < w) & (code[:-1] < w))
        key = code[next_] * w + code[next_ + 1]
        at = np.searchsorted(self.pairs, key)
        two = np.where(self.pairs[at] == key, self.pair[at], -1)
        terms, rows = np.concatenate([one, two]), np.concatenate([row, row[next_]])
        return terms[terms >= 0], rows[terms >= 0]


def topic_counts(terms: list[str]) -> Callable:
    """For mapInArrow over topic and words: id (the topic), term and tf of each batch."""
    code, names = Coder(terms), pa.array(terms, pa.string())

    def run(batches):
        for rows, flat, row in _pieces(batches):
            topics = rows.column("topic").dictionary_encode()
            term, at = code(flat, row)
            found, firsts = _groups(topics.indices.to_numpy().astype(np.int64)[at] * len(terms) + term)
            topic, term = np.divmod(found, max(len(terms), 1))
            yield pa.record_batch([topics.dictionary.take(pa.array(topic)), names.take(pa.array(term)), pa.array(np.diff(firsts))], names=["id", "term", "tf"])

    return run


def products(terms: list[str], idf: np.ndarray, left: pa.Table, threshold: float) -> Callable:
    """For mapInArrow over id and words: left_id, right_id and s, the cosine of the pairs that may reach the threshold.

    left: left_id, term and wa, the weight of the term there times its idf. A text's terms, its length and its products
    stay in its batch.
    """
    code = Coder(terms)
    ids = left.column("left_id").combine_chunks().dictionary_encode()
    term = pc.index_in(left.column("term").combine_chunks(), value_set=pa.array(terms, pa.string())).to_numpy()
    order = np.argsort(term, kind="stable")
    names, m = ids.dictionary, len(ids.dictionary)
    owner, wa = ids.indices.to_numpy().astype(np.int64)[order], left.column("wa").to_numpy()[order]
    begin = np.searchsorted(term[order], np.arange(len(terms) + 1))

    def met(row, term, part, first, last):
        """The sums of the rows from first to before last, by row and left id, of what sorted rows say."""
        a, b = np.searchsorted(row, (first, last))
        at, n = begin[term[a:b]], begin[term[a:b] + 1] - begin[term[a:b]]
        each = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(np.repeat(row[a:b] - first, n) * m + owner[each], np.repeat(part[a:b], n) * wa[each], (last - first) * m)

    def run(batches):
        for rows, flat, row in _pieces(batches):
            t, r = code(flat, row)
            found, firsts = _groups(r * len(terms) + t)
            row, term = np.divmod(found, max(len(terms), 1))
            tf = np.diff(firsts).astype(np.float64)
            norm = np.sqrt(np.bincount(row, (tf * idf[term]) ** 2, rows.num_rows))
            shared = begin[term + 1] > begin[term]
            row, term, tf = row[shared], term[shared], tf[shared]
            part = tf / norm[row]
            n = np.concatenate([[0], np.cumsum(np.bincount(row, begin[term + 1] - begin[term], rows.num_rows))])
            first = 0
            while first < rows.num_rows and m:
                last = min(int(np.searchsorted(n, n[first] + HELD, "right")) - 1, first + HELD // m, rows.num_rows)
                last = max(last, first + 1)
                s = met(row, term, part, first, last)
                near = np.flatnonzero(s >= threshold - 1e-8)
                right, own = np.divmod(near, m)
                yield pa.record_batch([names.take(pa.array(own)), rows.column("id").take(pa.array(right + first)), pa.array(s[near])], names=["left_id", "right_id", "s"])
                first = last

    return run
