"""Token ids of whole texts from pieces that the library encodes in batches.

A byte-level BPE never joins the last one of some white space characters, and what follows it,
to what stands before, so a text may be cut in front of every space or line feed before a
visible character. Arrow cuts the texts and numbers their distinct pieces, then the distinct
words of these; words that a bounded memo does not hold are encoded once. No Python object is
made for a piece or a word, except for the few of other white space.
"""

from __future__ import annotations

import os
import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of Python but for the line feed; it includes all that the tokenizer's pattern calls so.
SPACE = r"\t\x{b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: In a text with a space put before every line feed: one of both in front of which there is no
#: cut. ``<`` may begin a special token, and white space before that stays whole.
NO_CUT = rf" (?:[{SPACE}<]|$)|\n(?:[{SPACE}\n<]|$)"
CUT = re.compile(r" (?=[^\s<])")
CUT_LINE = re.compile(r"(?=\n[^\s<])")
#: Begins the first piece of a text and words without white space before them. A piece behind a
#: line feed begins with that; all others had a space before them, which the cut took.
FIRST = "\r"
LINE = "\n"
#: Pieces with white space inside, or that may be part of a special token, are encoded alone.
ALONE = rf"(?s)^.[^{SPACE}\n<]*[{SPACE}\n<]|^[\r\n]$"
#: Marks behind a letter or digit; the tokenizer never joins the two. Only ranges that are letters
#: in every version of Unicode.
MARKED = (
    r"([0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{21f}\x{3b1}-\x{3c9}\x{410}-\x{44f}\x{4e00}-\x{9fa5}])"
    rf"([{re.escape(string.punctuation.replace('<', ''))}]+)$"
)
#: Words in one run, and pieces put together in one step.
RUN = 500
STEP = 1 << 18


class PieceEncoder:
    """Encodes texts; ``memo`` bounds the number of words kept from one call to the next."""

    def __init__(self, path: str, memo: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.memo = memo
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.line = np.zeros_like(self.spaced)
        # How byte-level vocabularies write the space and the line feed.
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.line[[i for t, i in vocabulary.items() if t == "Ċ"]] = True
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Forget the words met in one call only, and of the others all but the most frequent
        that fill half the memo."""
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > self.memo // 2:
            keep = np.sort(keep[np.argsort(-self.hits[keep], kind="stable")[:self.memo // 2]])
        self.flat = _taken(self.flat, self.size, keep)
        self.known, self.size, self.hits = self.known.take(pa.array(keep)), self.size[keep], self.hits[keep] // 2

    def _places(self, words: pa.Array) -> np.ndarray:
        """Place in the memo of distinct words; new ones are encoded."""
        if len(self.known) > self.memo:
            self._shrink()
        at = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.known) + np.arange(len(new))
        words = words.take(pa.array(new))
        flat, sizes = self._encode(words)
        self.known = pa.concat_arrays([self.known, words])
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, sizes])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.hits[at] += 1
        return at

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and the number of each. Words without white space go in runs,
        told apart by the space that begins each or by a line feed behind it; others one by one."""
        alone, first = _mask(pc.match_substring_regex(words, ALONE)), _mask(pc.starts_with(words, FIRST))
        spaced, bare, rest = (np.flatnonzero(x) for x in (~alone & ~first, ~alone & first, alone))
        a, _ = self._ids([" " + run for run in _runs(words, spaced, " ")])
        begins = np.flatnonzero(self.spaced[a])
        b, _ = self._ids([run.replace(FIRST, "") + LINE for run in _runs(words, bare, LINE)])
        ends = np.flatnonzero(self.line[b])
        if len(begins) != len(spaced) or len(ends) != len(bare):
            raise ValueError("the vocabulary does not keep the space or line feed between two words")
        odd = words.take(pa.array(rest)).to_pylist()
        c, sizes = self._ids([p[1:] if p[:1] == FIRST else p if p[:1] == LINE else " " + p for p in odd])
        order = np.concatenate([spaced, bare, rest])
        sizes = np.concatenate([np.diff(begins, append=len(a)), np.diff(ends, prepend=-1) - 1, sizes])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return _taken(np.concatenate([a, b[~self.line[b]], c]), sizes, place), sizes[place]

    def _ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings as the library gives them, in a row, and the number of each."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Memo places of the words of all distinct pieces, the number of words of each piece, the
        number of every piece of the texts, and the count of pieces of each text."""
        column = pa.array([FIRST + t.replace(LINE, " " + LINE) for t in texts], pa.large_string())
        lists = pc.split_pattern(column, " ")
        odd = np.flatnonzero(_mask(pc.match_substring_regex(column, NO_CUT)))
        if len(odd):
            order = np.arange(len(texts))
            order[odd] = len(texts) + np.arange(len(odd))
            cut = pa.array([_cut(texts[i]) for i in odd.tolist()], lists.type)
            lists = pa.concat_arrays([lists, cut]).take(pa.array(order))
        pieces = lists.flatten().dictionary_encode()
        distinct = pieces.dictionary
        alone = _mask(pc.match_substring_regex(distinct, ALONE))
        plain = distinct.filter(pa.array(~alone))
        # No plain piece holds a space, so one may part its words.
        plain = pc.replace_substring(plain, LINE, f"{LINE} {FIRST}")
        split = pc.split_pattern(pc.replace_substring_regex(plain, MARKED, rf"\1 {FIRST}\2"), " ")
        alone_too = pa.concat_arrays([split.flatten(), distinct.filter(pa.array(alone))]).dictionary_encode()
        words = self._places(alone_too.dictionary)[alone_too.indices.to_numpy()]
        n_words = np.concatenate([_lengths(split), np.ones(int(alone.sum()), np.int64)])
        # The plain pieces come first, then those encoded alone.
        number = np.where(alone, len(plain) + np.cumsum(alone), np.cumsum(~alone)) - 1
        return words, n_words, number[pieces.indices.to_numpy()], _lengths(lists)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        words, n_words, pieces, counts = self._pieces(texts)
        return _sums(_sums(self.size[words], n_words)[pieces], counts)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        words, n_words, pieces, counts = self._pieces(texts)
        flat, sizes = _taken(self.flat, self.size, words), _sums(self.size[words], n_words)
        return _taken(flat, sizes, pieces), _sums(sizes[pieces], counts)


def _mask(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy().astype(np.int64)


def _runs(words: pa.Array, index: np.ndarray, between: str) -> list[str]:
    """Words of these numbers, joined in runs."""
    cuts = np.append(np.arange(0, len(index), RUN), len(index)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cuts), words.take(pa.array(index)))
    return pc.binary_join(lists, pa.scalar(between, pa.large_string())).to_pylist()


def _cut(text: str) -> list[str]:
    """Pieces of any text."""
    found = CUT.split(text)
    found[0] = FIRST + found[0]
    return list(chain.from_iterable(CUT_LINE.split(p) if LINE in p else (p,) for p in found))


def _taken(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, which holds them one after the other in these sizes, by number."""
    begin, out = np.cumsum(size) - size, [flat[:0]]
    for i in range(0, len(index), STEP):
        sizes, begins = size[index[i:i + STEP]], begin[index[i:i + STEP]]
        ends = np.cumsum(sizes)
        out.append(flat[np.arange(int(ends[-1])) + np.repeat(begins - ends + sizes, sizes)])
    return np.concatenate(out)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker process's encoder for a vocabulary file. Its memo lasts over the tasks of the
    worker, as most words of a task are met again in the next one."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
