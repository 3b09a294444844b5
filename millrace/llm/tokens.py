"""Token ids of whole texts, fast: the different words of many texts are encoded once each."""

from __future__ import annotations

import itertools
import re
import sys
import types

import numpy as np

BYTE_BPE = "byte_bpe_50k.json"
EOS = 2
SPECIAL = "<|"
#: A space between white space, or between it and the end, belongs to a longer piece: such texts are encoded as one.
RUN = re.compile(r"\s (?:\s|\Z)")
#: Bytes that white space can start with.
ALONE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
KEPT = 300_000  # words whose ids an encoder remembers, about


class Powers:
    """Keys of byte strings within a buffer: polynomials of their bytes modulo 2**64, and their lengths."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def __call__(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        n = len(buf) + 1
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power, self.inverse = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (BASE, pow(BASE, -1, 2**64)))
        sums = np.zeros(n, np.uint64)
        np.cumsum(buf * self.power[: len(buf)], out=sums[1:])
        return (sums[start + size] - sums[start]) * self.inverse[start] + size.astype(np.uint64) * np.uint64(BASE)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


def per_process(key, make):
    """What ``make`` returns, once in each worker process."""
    held = sys.modules.setdefault("_millrace_process", types.ModuleType("_millrace_process")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def _ranks(path: str) -> dict[bytes, int]:
    """Bytes to id of a byte-level vocabulary file."""
    import json

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
    chars = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return {bytes(chars[c] for c in token): i for token, i in vocabulary.items() if not token.startswith(SPECIAL)}


def _special(path: str) -> dict[str, int]:
    """Names and ids of the special tokens of a vocabulary file."""
    import json

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    return {t: i for t, i in file["model"]["vocab"].items() if t.startswith(SPECIAL)} | {x["content"]: x["id"] for x in file.get("added_tokens", [])}


class Encoder:
    """Encodes texts to arrays of uint32 ids, without special tokens; the same ids as ``tokenizers`` gives.

    A byte-level BPE splits texts before every space that a word follows, so the words of many texts are encoded once
    each and their ids are put together again.  Texts where that doesn't hold, and those that may hold the name of a
    special token, go to ``tokenizers`` as a whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = _ranks(path)
        self.path, self.tokenizer = path, None
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = _special(path)
        self.bytes_of = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        self.opens = np.zeros(len(self.bytes_of), bool)  # ids that start with ASCII white space
        for token, i in ranks.items():
            self.bytes_of[i], self.opens[i] = len(token), token[:1].isspace()
        for token, i in special.items():
            self.bytes_of[i] = len(token.encode())
        self.size = len(self.bytes_of)
        self.powers = Powers()
        self.kept: tuple | None = None  # sorted keys, bytes, their starts, sizes, ids, where those of a word start, how many they are

    def whole(self, text: str) -> np.ndarray:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _words(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the given different words, and where those of each start and how many they are."""
        # Without a space at the front, or with white space after it, a word may join its neighbour's pieces.
        joined = (size > 1) & (buf[start] == 32)
        joined[joined] = ~ALONE[buf[start[joined] + 1]]
        s, n = start[joined], size[joined]
        text = buf[np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes().decode()
        ids = np.array(self.fast.encode_ordinary(text), np.uint32)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(n)) + 1
        at, many = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        many[joined] = np.diff(ends, prepend=0)
        at[joined] = ends - many[joined]
        parts, total = [ids], len(ids)
        for k in np.flatnonzero(~joined).tolist():
            own = self.fast.encode_ordinary(buf[start[k] : start[k] + size[k]].tobytes().decode())
            parts.append(np.array(own, np.uint32))
            at[k], many[k] = total, len(own)
            total += len(own)
        return np.concatenate(parts), at, many

    def _remembered(self, key: np.ndarray, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``_words`` gives for different words with sorted keys; frequent ones are remembered from call to call."""
        if self.kept is None:
            hit = np.zeros(len(key), bool)
        else:
            keys, held, begin, width, old, old_at, old_many = self.kept
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = (keys[place] == key) & (width[place] == size)
            n, both = size[hit], place[hit]
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            same = buf[np.repeat(start[hit], n) + shift] == held[np.repeat(begin[both], n) + shift]
            if not same.all():
                hit[:] = False
        ids, at, many = self._words(buf, start[~hit], size[~hit])
        if hit.any():
            new_at, new_many = at, many
            at, many = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
            at[~hit], many[~hit] = new_at + len(old), new_many
            at[hit], many[hit] = old_at[place[hit]], old_many[place[hit]]
            ids = np.concatenate([old, ids])
        if 10 * np.count_nonzero(~hit) > len(hit):
            add = np.flatnonzero(~hit)
            n = size[add]
            text = buf[np.repeat(start[add] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            more = (key[add], np.cumsum(n) - n, n, at[add], many[add])
            if hit.any() and len(keys) + len(add) <= KEPT:
                more = tuple(np.concatenate(x) for x in ((keys, more[0]), (begin, more[1] + len(held)), (width, n), (old_at, more[3]), (old_many, more[4])))
                text = np.concatenate([held, text])
            order = np.argsort(more[0])
            self.kept = (more[0][order], text, more[1][order], more[2][order], ids, more[3][order], more[4][order])
        return ids, at, many

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [SPECIAL not in t and RUN.search(t) is None for t in texts]
        raw = [t.encode() for t, p in zip(texts, plain, strict=True) if p]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        fast: list[np.ndarray] = [np.empty(0, np.uint32)] * len(raw)
        if len(buf):
            of_text = np.cumsum([0, *map(len, raw)])
            first = buf == 32
            first[of_text[:-1][np.diff(of_text) > 0]] = True
            start = np.flatnonzero(first)
            size = np.diff(start, append=len(buf))
            key = self.powers(buf, start, size)
            order = np.argsort(key)
            new = np.diff(key[order], prepend=~key[order[:1]]) != 0
            word = np.empty(len(key), np.int64)
            word[order] = np.cumsum(new) - 1
            kept = order[new]
            ids, at, many = self._remembered(key[kept], buf, start[kept], size[kept])
            if not np.array_equal(buf[np.repeat(start[kept][word] - start, size) + np.arange(len(buf))], buf):
                return [self.whole(t) for t in texts]  # two words share a key
            n = many[word]
            ends = np.cumsum(n)
            out = ids[np.repeat(at[word] - ends + n, n) + np.arange(ends[-1])]
            cut = np.concatenate([[0], ends])[np.searchsorted(start, of_text)]
            fast = [out[a:b] for a, b in itertools.pairwise(cut.tolist())]
        rest = iter(fast)
        return [next(rest) if p else self.whole(t) for t, p in zip(texts, plain, strict=True)]


def encoder(path: str) -> Encoder:
    return per_process(("encoder", path), lambda: Encoder(path))


def in_slices(texts: list, chars: int = 1_000_000):
    """Runs (start, texts) with at most so many characters, or one longer text: bounds what is split at a time."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t)
    if texts[at:]:
        yield at, texts[at:]


def few_rows(batches, rows: int = 1024):
    """Arrow batches of at most so many rows: bounds the copies that a task makes of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
