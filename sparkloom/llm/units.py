"""Exact whole-text encoding with a tokenizers file, where each distinct word is encoded once.

Both vocabularies split texts before a BPE merge, and no split token reaches over a single space
between two non-spaces. A text is therefore cut there, the library encodes each distinct unit, and
the ids of a text are those of its units in order. The memo is bounded.

A byte-level vocabulary marks the space that leads a unit in its first token, and in no other token
of a unit without spaces. Units that neither begin nor end with a space are therefore encoded as one
text, with a space before each, and its ids are cut where such tokens stand; units of letters and digits
without a space get line ends between, and others a mark. Its pattern also parts a letter from a full stop
or comma, and a line end from what isn't white space: units are cut there into words, so that a word is
encoded once whatever follows it. Only words are remembered; units are put together for each list of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.llm.common import texts_of

#: Two characters of white space, which are those of str.isspace.
_ADJACENT = r"[\t-\r\x1c-\x20\x{85}\p{Z}]{2}"
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Letters after which units are cut.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LETTER_SET = frozenset(re.findall(f"[{_LETTERS}]", "".join(map(chr, range(0x250)))))


def _words(name: str) -> list[str]:
    """A unit cut at line ends between other characters, and before a full stop or comma that ends such a line."""
    lines = name.split("\n")
    if "" in lines:
        return [name]
    out: list[str] = []
    for line in lines:
        if line[-1] in ".," and line[-2:-1] in _LETTER_SET:
            out += (line[:-1], line[-1] + "\n")
        else:
            out += (line, "\n")
    if len(out[-1]) > 1:
        out[-1] = out[-1][0]
    else:
        out.pop()
    return out


class UnitEncoder:
    """ids of whole texts, as ``tokenizer.encode(text, add_special_tokens=False).ids`` gives them."""

    def __init__(self, path: str, memo_units: int = 700_000, tokenizer=None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer or Tokenizer.from_file(path)
        self.memo_units = memo_units
        self.leads = self._leads()
        added = sorted(self.tokenizer.get_added_tokens_decoder().items())
        self.mark_id, self.mark = next((k, x.content) for k, x in added if x.special)
        self.line_id = self.tokenizer.get_vocab(with_added_tokens=False).get("\u010a")
        #: whether units are cut into words, which no added token may reach over
        self.cuts = self.leads is not None and self.line_id is not None and not any(x.lstrip or x.rstrip or x.single_word or any(c in x.content for c in ".,\n") for _, x in added)
        self._clear()

    def _leads(self) -> np.ndarray | None:
        """Which ids begin with a space, if the vocabulary is byte-level and splits at spaces."""
        from tokenizers import models, pre_tokenizers

        split, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        if not isinstance(split, pre_tokenizers.ByteLevel) or not split.use_regex or split.add_prefix_space or self.tokenizer.normalizer is not None:
            return None
        if not isinstance(model, models.BPE) or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix:
            return None
        out = np.zeros(self.tokenizer.get_vocab_size(), bool)
        out[[k for x, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if x.startswith("\u0120")]] = True
        return out

    def _clear(self) -> None:
        self.inner: dict[str, int] = {}  # unit without the space that leads it
        self.outer: dict[str, int] = {}  # unit as it stands
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.units = 0

    def _add(self, memo: dict[str, int], names: list[str], lead: str) -> np.ndarray:
        """Encode new names and put them into the memo; their unit numbers."""
        numbers = np.empty(len(names), np.int64)
        odd, edged, plain, bare = [], [], [], []
        simple = None if self.leads is None or self.mark.isalnum() else plain if lead else bare if self.cuts else None
        for k, x in enumerate(names):
            if simple is not None and x.isalnum():
                simple.append(k)
                continue
            word = x if lead else x[1:]
            if self.mark in lead + x:
                odd.append(k)
            elif self.leads is None or not (lead or x[:1] == " ") or not word or word[0].isspace() or word[-1].isspace() or " " in word:
                edged.append(k)
            else:
                plain.append(k)
        for own, join, size, mark in ((plain, lead, 256, None), (bare, "\n", 256, self.line_id), (edged, self.mark + lead, 16, self.mark_id)):
            for at in range(0, len(own), 4096):
                numbers[own[at : at + 4096]] = self.units + np.arange(len(own[at : at + 4096]))
                some = [names[k] for k in own[at : at + 4096]]
                # short texts, which the library may spread over threads
                batch = self.tokenizer.encode_batch_fast([lead + join.join(some[k : k + size]) for k in range(0, len(some), size)], add_special_tokens=False)
                ids: list[int] = []
                for one in batch:
                    ids += one.ids
                    if mark is not None:
                        ids.append(mark)
                found = np.array(ids, np.uint32)
                if mark is not None:
                    ends = np.flatnonzero(found == mark)
                    starts = np.append(0, ends[:-1] + 1)
                else:
                    starts = np.flatnonzero(self.leads[found])
                    ends = np.append(starts[1:], len(found))
                self._put(memo, some, found, starts, ends)
        for k in odd:
            numbers[k] = self.units
            ids = np.array(self.tokenizer.encode(lead + names[k], add_special_tokens=False).ids, np.uint32)
            self._put(memo, [names[k]], ids, np.zeros(1, np.int64), np.array([len(ids)]))
        return numbers

    def _put(self, memo: dict[str, int], names: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Store the ids of ``names``, those from ``starts`` to ``ends`` of ``ids``."""
        assert len(ends) == len(names)
        self._place(ids, starts, ends)
        memo.update(zip(names, range(self.units, self.units + len(names)), strict=True))
        self.used += len(ids)
        self.units += len(names)

    def _place(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Write units behind those that are remembered."""
        while self.units + len(ends) > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[self.units : self.units + len(ends)] = self.used + starts
        self.lengths[self.units : self.units + len(ends)] = ends - starts

    def _gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units in order, and where those of each unit begin, with the end."""
        lengths = self.lengths[index]
        total = np.concatenate([[0], np.cumsum(lengths)])
        take = np.arange(total[-1])
        take += np.repeat(self.starts[index] - total[:-1], lengths)
        return self.pool[take], total

    def _known(self, memo: dict[str, int], names: list[str], lead: str) -> np.ndarray:
        """Unit numbers of names, which may repeat; new ones are encoded."""
        found = np.array([-1 if at is None else at for at in map(memo.get, names)], np.int64)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = dict.fromkeys(names[j] for j in missing.tolist())
            self._add(memo, list(new), lead)
            found[missing] = [memo[names[j]] for j in missing.tolist()]
        return found

    def _numbers(self, names: list[str], stops: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Unit numbers of distinct names that a space leads, some of which end in a letter and a stop or hold line ends.

        Names that are cut get numbers behind those remembered, which hold until the next call.
        """
        heads = list(names)
        at = np.flatnonzero(stops & ~lines).tolist()
        rest = [names[k][-1] for k in at]
        counts = [2] * len(at)
        for k in at:
            heads[k] = names[k][:-1]
        for k in np.flatnonzero(lines).tolist():
            heads[k], *more = _words(names[k])
            if more:
                rest += more
                at.append(k)
                counts.append(1 + len(more))
        found = self._known(self.inner, heads, " ")
        if at:
            sizes = np.array(counts)
            begins = np.cumsum(sizes) - sizes
            index = np.empty(int(sizes.sum()), np.int64)
            first = np.zeros(len(index), bool)
            first[begins] = True
            index[~first] = self._known(self.outer, rest, "")
            index[first] = found[at]
            ids, total = self._gather(index)
            self._place(ids, total[begins], total[begins + sizes])
            found[at] = self.units + np.arange(len(at))
        return found

    def _index(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts in order, and how many units each text has."""
        if self.units > self.memo_units:
            self._clear()
        column = pa.array(texts, pa.large_string())
        adjacent = pc.match_substring_regex(column, _ADJACENT)
        loose = {k: _CUT.split(texts[k]) for k in np.flatnonzero(adjacent.to_numpy(zero_copy_only=False)).tolist()}
        plain = [k for k in range(len(texts)) if k not in loose]
        # Arrow splits at each space and numbers the distinct units, so Python handles each of them once
        split = pc.split_pattern(column.filter(pc.invert(adjacent)), " ")
        coded = split.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        begins = split.offsets.to_numpy()
        first = np.zeros(len(codes), bool)
        first[begins[:-1]] = True
        for k, code in zip(plain, codes[first].tolist(), strict=True):
            loose[k] = [names[code]]
        used = np.flatnonzero(np.bincount(codes[~first], minlength=len(names)))
        self._add(self.outer, [x for x in {u for own in loose.values() for u in own} if x not in self.outer], "")
        stops = lines = np.zeros(len(names), bool)
        if self.cuts:
            stops = pc.match_substring_regex(coded.dictionary, f"[{_LETTERS}][.,]$").to_numpy(zero_copy_only=False)
            lines = pc.match_substring(coded.dictionary, "\n").to_numpy(zero_copy_only=False)
        number = np.zeros(len(names), np.int64)
        number[used] = self._numbers([names[j] for j in used.tolist()], stops[used], lines[used])
        counts = np.array([len(loose[k]) for k in range(len(texts))], np.int64)
        counts[plain] = np.diff(begins)
        index = np.empty(int(counts.sum()), np.int64)
        ends = np.cumsum(counts)
        own = np.ones(len(index), bool)
        for k, units in loose.items():
            at = int(ends[k] - counts[k])
            index[at : at + len(units)] = [self.outer[x] for x in units]
            own[at : at + len(units)] = False
        index[own] = number[codes[~first]]
        return index, counts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        index, sizes = self._index(texts)
        total = np.concatenate([[0], np.cumsum(self.lengths[index])])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        index, sizes = self._index(texts)
        ids, total = self._gather(index)
        ends = np.cumsum(sizes)
        return ids, total[ends] - total[ends - sizes]


#: Units that a worker remembers.
MEMO_UNITS = 700_000
_CACHE: dict[tuple[str, int], UnitEncoder] = {}


def encoder(path: str, memo_units: int = MEMO_UNITS) -> UnitEncoder:
    """The worker's encoder for a vocabulary file; kept between tasks of a worker."""
    if (path, memo_units) not in _CACHE:
        _CACHE.clear()
        _CACHE[path, memo_units] = UnitEncoder(path, memo_units)
    return _CACHE[path, memo_units]


def forget() -> None:
    """Drop the worker's encoder; for tasks of other operators, which the worker would hold its words beside."""
    _CACHE.clear()


def gathered(batches: Iterator[pa.RecordBatch], most_chars: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """The first two columns, names and texts (null as empty), in lists of rows with about most_chars characters at most.

    Rows of several batches stand together, as a unit that repeats in a list is looked up once there.
    """
    names: list = []
    texts: list[str] = []
    chars = 0
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            if texts and chars + len(text) > most_chars:
                yield names, texts
                names, texts, chars = [], [], 0
            names.append(name)
            texts.append(text)
            chars += len(text)
    if texts:
        yield names, texts
