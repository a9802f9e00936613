"""Token ids of whole texts with the tokenizers library, for use inside Spark tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from feedlake.llm import textops as X

#: Distinct pieces whose ids a Python worker remembers (about 40 bytes each).
REMEMBERED = 500_000
#: Bytes of text that are cut into pieces at once.
BATCH_BYTES = 1 << 19

_LETTER, _SPACE, _BREAK, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[9, 10, 11, 12, 13]] = _BREAK
_KIND[32] = _SPACE
_KIND[list(b".,;:!?%$&*#()[]{}\"/=-+@_")] = _MARK        # not the apostrophe, and nothing of <|endoftext|>
_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[33:127] = True
#: First bytes of characters that may be white space, and white space itself.
_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3, *range(9, 14), *range(28, 33)]] = True


def _pair_table() -> np.ndarray:
    """Per pair of neighbouring bytes: 1 for a cut between them, 2 for a cut before the first."""
    prev, cur = np.divmod(np.arange(1 << 16), 256)
    white = (_KIND[cur] == _SPACE) | (_KIND[cur] == _BREAK)
    between = (_ASCII_WORD[prev] & white) | ((_KIND[prev] == _LETTER) & (_KIND[cur] == _MARK)) | ((_KIND[prev] == _MARK) & (_KIND[cur] == _LETTER))
    before = (_KIND[prev] == _SPACE) & ~_MAYBE_SPACE[cur]
    return between.astype(np.uint8) + 2 * before.astype(np.uint8)


_PAIRS = _pair_table()


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of pieces that byte-level BPE treats alone as it does in their text.

    Its pre-tokens never cross these places: from a non-blank to ASCII white space; before a
    blank that a non-blank follows; after a single line break; between a letter and a mark."""
    n = len(data)
    start = np.zeros(n + 1, bool)
    if n > 1:
        pair = _PAIRS[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        start[1:n] = pair & 1
        start[:n - 1] |= pair > 1
        breaks = np.flatnonzero(_KIND[data[1:-1]] == _BREAK) + 1
        start[breaks[_ASCII_WORD[data[breaks - 1]] & _ASCII_WORD[data[breaks + 1]]] + 1] = True
    start[offs] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of texts. Pieces repeat: those of a batch are hashed and deduplicated with numpy,
    new ones are encoded together by the library, and their ids are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)           # sorted piece hashes
        self.bytes = np.empty(0, np.int64)           # length of each
        self.at = np.empty(0, np.int64)              # first id and number of ids
        self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint16)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a batch (UTF-8 bytes and offsets), and the cuts between documents."""
        starts = piece_starts(data, offs)
        if not len(starts):
            return np.empty(0, np.uint16), np.zeros(len(offs), np.int64)
        ends = np.r_[starts[1:], len(data)]
        power, inverse = X.powers(len(data))
        key = X.mix(np.add.reduceat(X._BYTE_VALUES[data] * power[:len(data)], starts) * inverse[starts])
        length = ends - starts
        unique, first, place = np.unique(key, return_index=True, return_inverse=True)
        if (length[first][place] != length).any():   # two pieces of one hash: no shortcut for this batch
            return self._plain(data, offs)
        if len(self.keys) > REMEMBERED:
            self._forget()
        found = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        if len(self.keys):
            near = np.minimum(found, len(self.keys) - 1)
            known = self.keys[near] == unique
            if (self.bytes[near[known]] != length[first[known]]).any():
                return self._plain(data, offs)
        new = np.flatnonzero(~known)
        if len(new):
            ids, size = self._learn(data, starts[first[new]], ends[first[new]])
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, ids])
            where = found[new]
            self.keys = np.insert(self.keys, where, unique[new])
            self.bytes = np.insert(self.bytes, where, length[first[new]])
            self.at = np.insert(self.at, where, at)
            self.size = np.insert(self.size, where, size)
            found = np.searchsorted(self.keys, unique)
        at, size = self.at[found][place], self.size[found][place]
        ends = np.cumsum(size)
        out = self.ids[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        cuts = np.r_[0, ends][np.searchsorted(starts, offs)]
        return out, cuts

    def _plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        each = [np.array(self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint16)
                for a, b in zip(offs[:-1], offs[1:])]
        return np.concatenate(each), np.r_[0, np.cumsum([len(e) for e in each])]

    def _alone(self, piece: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint16)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has.

        Pieces without white space but a leading blank are joined by line feeds: a line feed
        between non-blanks is a token of its own, so the ids fall apart at its id."""
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        size = ends - starts
        first = np.cumsum(size) - size
        blank = np.add.reduceat(_MAYBE_SPACE[data[np.repeat(starts - first, size) + np.arange(size.sum())]], first, dtype=np.int64)
        plain = (blank == (data[starts] == 32)) & ((data[starts] != 32) | (size > 1)) & (len(self.line_feed) == 1)
        order = np.flatnonzero(plain)
        parts, sizes = [], []
        for a in range(0, len(order), 50_000):
            rows = [order[i:min(i + 500, len(order))] for i in range(a, min(a + 50_000, len(order)), 500)]
            texts = [(b"\n" + b"\n".join([pieces[i] for i in r.tolist()])).decode("utf-8", "replace") for r in rows]
            for r, got in zip(rows, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(got.ids, np.uint16)
                at = np.flatnonzero(ids == self.line_feed[0])
                if len(at) == len(r):
                    sizes.append(np.diff(np.r_[at, len(ids)]) - 1)
                    parts.append(np.delete(ids, at))
                else:                                # the line feed's id came up elsewhere
                    each = [self._alone(pieces[i]) for i in r.tolist()]
                    sizes.append(np.array([len(x) for x in each]))
                    parts.append(np.concatenate(each))
        rest = np.flatnonzero(~plain)
        each = [self._alone(pieces[i]) for i in rest.tolist()]
        parts += each
        sizes.append(np.array([len(x) for x in each], np.int64))
        ids, size = np.concatenate([np.empty(0, np.uint16), *parts]), np.concatenate(sizes).astype(np.int64)
        # back into the order of the pieces
        order = np.concatenate([order, rest])
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(size) - size
        n = np.empty(len(order), np.int64)
        n[order] = size
        return ids[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    return Encoder(path)


def encode_column(column, path: str):
    """(first row, end row, ids, cuts) of the documents of a string column, some at a time."""
    data, offs = X.utf8(column)
    own = encoder(path)
    for a, b, d, o in X.chunks(data, offs, BATCH_BYTES):
        yield a, b, *own.encode(d, o)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
