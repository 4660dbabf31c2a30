"""Ids of whole texts by the tokenizers library, one call for each distinct piece of text.

A byte-pair tokenizer first cuts a text into pieces and then codes each piece by itself. Where the cut
is one of the two rules below, it is made here for a whole batch at once, equal pieces are found by
dictionary encoding, and the library's model codes each distinct piece once. Pieces met often are
remembered in Arrow arrays of bounded size.
Texts with characters for which the rules below aren't plain (anything but ASCII and Latin letters with marks) go to the library whole,
as do those that may hold an added token of the vocabulary file (special or not, such as <|endoftext|>),
which stands for one id wherever it is, and everything if the file states another rule. The ids are the
same either way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .id_coder import IDS, NO_PHRASES, Phrases

_OTHER, _LETTER, _DIGIT, _SPACE = 0, 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_ODD = np.zeros(256, bool)  # bytes of texts that go to the library whole
_ODD[[*range(9), *range(14, 32), 127, 0xC0, 0xC1, 0xC2, *range(0xC6, 256)]] = True
#: Two-byte characters among the letters' lead bytes that aren't plain letters: multiplication and division sign, dotted I, n with apostrophe.
_ODD_PAIRS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0), (0xC5, 0x89))
#: The cutting rule of the second kind of file.
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Distinct pieces that are remembered; beyond, the half that was met in most batches stays.
CACHE = 1 << 18
#: The byte-level alphabet: printable Latin-1 characters stand for their bytes, characters from 256 on for the other bytes, in order.
_ALPHABET = {c: 256 + k for k, c in enumerate(c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 255 and c != 173))}
_SPELLED = np.array([_ALPHABET.get(c, c) for c in range(256)], "<u2")


def _looked_up(b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[b] of bytes by way of bytes.translate, which is several times as fast."""
    return np.frombuffer(b.tobytes().translate(table.tobytes()), table.dtype)


class PieceTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            self.rule = self._rule(json.load(f))
        self.added = self._added()
        self._forget()

    @staticmethod
    def _rule(model: dict) -> str:
        pre, norm = model.get("pre_tokenizer") or {}, model.get("normalizer")
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "byte"
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        cuts = pre.get("pretokenizers", [])
        if steps == ["NFC", "Replace", "Lowercase"] and cuts and cuts[0].get("pattern", {}).get("Regex") == _WORD_RULE:
            return "word"
        return "whole"

    def _added(self) -> str | None:
        """A pattern that is in every plain text with an added token; it may be in others, too. Tokens are
        looked for as they are and as the normalizer makes them, whatever case and white space."""
        said = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        norm = self.tokenizer.normalizer
        said |= {norm.normalize_str(t) for t in said} if norm else set()
        return "|".join(r"[\s\x0b]+".join(map(re.escape, t.split())) for t in sorted(said)) if said else None

    def _forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.used = np.zeros(0, np.int64)  # batches in which each known piece was met, halved at each cut
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start. b: bytes of plain texts one after the other; first: their starts."""
        n, kind = len(b), _looked_up(b, _CLASS)
        head = np.zeros(n + 4, bool)
        head[first] = True  # the end of the last text counts as a start, too
        start = head[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        if self.rule == "byte":
            space = kind == _SPACE
            last = space.copy()  # the last white space before something else of the same text
            last[:-1] &= ~space[1:]
            last &= ~head[1 : n + 1]
            start |= last
            joined = np.flatnonzero(last & (b == 32)) + 1
            start[joined] = False
        else:
            start |= kind == _DIGIT
        mark = np.flatnonzero((b[:-1] == 39) & start[:-1] & (kind[1:] == _LETTER))
        mark = mark[~head[mark + 1]]
        if len(mark):
            pad = np.concatenate([b, np.zeros(3, np.uint8)])
            x, y = pad[mark + 1], pad[mark + 2]
            if self.rule == "word":
                x, y = np.where((x >= 65) & (x <= 90), x | 32, x), np.where((y >= 65) & (y <= 90), y | 32, y)
            short = np.isin(x, np.frombuffer(b"stmd", np.uint8))
            long_ = (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & ~head[mark + 2]
            start[mark[short | long_] + 1] = False
            after = np.concatenate([mark[short] + 2, mark[long_] + 3])
            start[after[after < n]] = True
        return np.flatnonzero(start)

    def _coded(self, pieces: pa.Array) -> tuple[list[int], list[int]]:
        """Ids of single pieces one after the other, and how many each has, by the model of the library behind its cutting rule."""
        tokenize, ids, upto = self.tokenizer.model.tokenize, [], [0]
        for text in self._lowered(pieces) if self.rule == "word" else self._spelled(pieces):
            ids += [t.id for t in tokenize(text)]
            upto.append(len(ids))
        return ids, upto

    @staticmethod
    def _lowered(pieces: pa.Array) -> Iterator[str]:
        for p in pieces.to_pylist():
            text = (p.lower() if p.isascii() else p.decode().lower().encode()).decode("latin-1")
            yield text if text.isascii() and text.isprintable() else text.translate(_ALPHABET)

    @staticmethod
    def _spelled(pieces: pa.Array) -> Iterator[str]:
        """Pieces in the byte-level alphabet, of one string: each byte is one character."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        text = _SPELLED[np.frombuffer(pieces.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]].tobytes().decode("utf-16-le")
        bounds = (bounds - bounds[0]).tolist()
        return (text[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True))

    def _keep_common(self) -> None:
        stay = np.sort(np.lexsort((np.arange(len(self.used)), self.used))[-(CACHE // 2) :])
        count = np.diff(self.ends)[stay]
        ends = np.cumsum(count)
        self.ids = self.ids[np.repeat(self.ends[stay] - (ends - count), count) + np.arange(int(count.sum()))]
        self.ends = np.concatenate([[0], ends])
        self.known, self.used = self.known.take(pa.array(stay)), self.used[stay] // 2

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where the ids of distinct pieces are, after new ones were coded."""
        if len(self.known) > CACHE:
            self._keep_common()
        found = pc.index_in(pieces, value_set=self.known)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        self.used[at[at >= 0]] += 1
        if len(new):
            fresh = pieces.take(pa.array(new))
            got, upto = self._coded(fresh)
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known = pa.concat_arrays([self.known, fresh])
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
            self.ids = np.concatenate([self.ids, np.array(got, np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.array(upto[1:])])
        return at

    def _plain(self, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of all pieces are, and the number of pieces in each of the texts between bounds."""
        if not len(b):
            return np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
        start = self._cut(b, bounds)
        offsets = np.append(start, len(b)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(b)])
        if self.rule == "word":
            keep = _CLASS[b[start]] != _SPACE
            pieces, start = pieces.filter(pa.array(keep)), start[keep]
        coded = pieces.dictionary_encode()
        return self._places(coded.dictionary)[coded.indices.to_numpy()], np.diff(np.searchsorted(start, bounds))

    def _plain_ids(self, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number in each text."""
        at, pieces = self._plain(b, bounds)
        count = self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.ends[at] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pieces)])])

    def _parts(self, texts: pa.Array, plain: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What `plain` makes of runs of plain texts, and between them ids and their number of a text that the library takes whole."""
        if texts.null_count:
            texts = texts.fill_null("")
        raw = texts.cast(pa.binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
        data = raw.buffers()[2]
        b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        bounds = offsets - offsets[0]
        odd = self.rule == "whole" and np.arange(len(b)) or np.flatnonzero(_looked_up(b, _ODD))
        if self.rule != "whole":
            for x, y in _ODD_PAIRS:
                lead = np.flatnonzero(b[:-1] == x)
                odd = np.append(odd, lead[b[lead + 1] == y])
        hard = np.searchsorted(bounds, odd, "right") - 1
        if self.added is not None:
            held = pc.match_substring_regex(texts, self.added, ignore_case=True)
            hard = np.append(hard, np.flatnonzero(held.to_numpy(zero_copy_only=False)))
        hard = np.unique(hard)
        whole = self._whole([texts[int(i)].as_py() for i in hard]) if len(hard) else []
        at = 0
        for i, ids in zip([*hard.tolist(), len(texts)], [*whole, None], strict=True):
            if i > at or not len(hard):
                yield plain(b[bounds[at] : bounds[i]], bounds[at : i + 1] - bounds[at])
            if ids is not None:
                yield ids, np.array([len(ids)])
            at = i + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and their number in each text; null counts as empty."""
        ids, counts = zip(*self._parts(texts, self._plain_ids), strict=True)
        return np.concatenate(ids), np.concatenate(counts).astype(np.int64)

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Phrases]:
        """The same in pieces: a number for each (an id, or IDS and the place of a phrase), the numbers of pieces and of ids in each
        text, and the phrases: the pieces of other than one id. A phrase may be there more than once."""
        phrases: list[Phrases] = []
        sizes: list[np.ndarray] = []
        before = 0

        def plain(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nonlocal before
            at, pieces = self._plain(b, bounds)
            length = np.diff(self.ends)
            met = np.zeros(len(length), bool)
            met[at] = True
            many = np.flatnonzero(met & (length != 1))
            number = np.zeros(len(length), np.int32)
            one = np.flatnonzero(length == 1)
            number[one] = self.ids[self.ends[one]]
            number[many] = IDS + before + np.arange(len(many))
            before += len(many)
            phrases.append((self.ids[np.repeat(met & (length != 1), length)], length[many]))
            upto = np.concatenate([[0], np.cumsum(length.take(at))])
            sizes.append(np.diff(upto[np.concatenate([[0], np.cumsum(pieces)])]))
            return number.take(at), pieces

        numbers, counts = [], []
        for got, n in self._parts(texts, plain):
            numbers.append(got.astype(np.int32))
            counts.append(n)
            if len(sizes) < len(counts):  # a text that went to the library whole
                sizes.append(n)
        found = tuple(np.concatenate(x) for x in zip(*phrases, strict=True)) if phrases else NO_PHRASES
        return np.concatenate(numbers), np.concatenate(counts).astype(np.int64), np.concatenate(sizes).astype(np.int64), found


_made: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One for each worker and file."""
    if path not in _made:
        _made[path] = PieceTokenizer(path)
    return _made[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by the end id, and the bounds of the documents."""
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(bounds[-1], "<u4")
    body = np.ones(len(out), bool)
    body[bounds[1:] - 1] = False
    out[body] = ids
    out[bounds[1:] - 1] = end
    return out, bounds
