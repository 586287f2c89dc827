"""Token ids of a public byte-level BPE vocabulary, by the tokenizers library.

That vocabulary's pre-tokeniser starts a new piece at every blank before a word, so texts may be cut there: the distinct pieces of a block are looked
up in a bounded cache, the library encodes those not found, and a text's ids are gathered from its pieces' ids. Texts where that does not hold, with runs
of blanks or with a token that has a blank inside, are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fathomline.llm.common import kept, only

VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How byte-level vocabularies write bytes: printable Latin-1 characters stand for themselves, the others for code points from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {**{b: chr(b) for b in SHOWN}, **{b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}}


#: The same as an array of code units; no UTF-8 text holds the byte 255, which stands for the mark between two units.
SHOWN_AS = np.array([ord(BYTE_CHARS[b]) for b in range(255)] + [ord("\n")], "<u2")
#: Strings of letters and printable ASCII without apostrophes, which may begin a unit of their own, with single line ends after them; and what a byte
#: of theirs is: a sign, a digit, a letter or a line end.
PLAIN = "^([!-&(-~\\pL]+\n?)+$"
KIND = np.array([3 if b == 10 else 2 if b > 127 or chr(b).isalpha() else 1 if chr(b).isdigit() else 0 for b in range(256)], np.int8)
#: Units that the model is given at once, and stretches of ids that are gathered at once.
AT_ONCE = 20_000
#: Ids end to end, and how many each text has.
Ragged = tuple[np.ndarray, np.ndarray]


def gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` that begin at ``starts``, end to end."""
    ends = np.cumsum(lengths)
    out, shift = np.empty(ends[-1] if len(ends) else 0, ids.dtype), starts - (ends - lengths)
    for at in range(0, len(ends), AT_ONCE):
        part, a, z = slice(at, at + AT_ONCE), ends[at] - lengths[at], ends[min(at + AT_ONCE, len(ends)) - 1]
        out[a:z] = ids.take(np.arange(a, z) + np.repeat(shift[part], lengths[part]))
    return out


def ordered(ids: np.ndarray, lengths: np.ndarray, first: pa.Array) -> Ragged:
    """Ids of strings in their own order, where those marked in ``first`` were done before the others."""
    first = first.to_numpy(zero_copy_only=False)
    own = np.concatenate([np.flatnonzero(first), np.flatnonzero(~first)])
    starts, sizes = np.empty_like(lengths), np.empty_like(lengths)
    starts[own], sizes[own] = np.cumsum(lengths) - lengths, lengths
    return gathered(ids, starts, sizes), sizes


def runs(strings: pa.Array, before: str) -> tuple[pa.Array, np.ndarray]:
    """The units of strings that are PLAIN: runs of letters, digits or signs, and line ends. A blank in front belongs to the first."""
    if not len(strings):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    strings = pc.binary_join_element_wise(before, strings, "")
    ends = np.cumsum(pc.binary_length(strings).to_numpy().astype(np.int64))
    text = "".join(strings.to_numpy(zero_copy_only=False)).encode()
    kind, first = KIND.take(np.frombuffer(text, np.uint8)), np.concatenate([[0], ends[:-1]])
    if before:
        kind[first] = kind[first + 1]
    new = np.diff(kind, prepend=np.int8(0)) != 0
    new[first] = True
    starts = np.append(np.flatnonzero(new), len(text))
    units = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(text)])
    return units, np.diff(np.searchsorted(starts, ends), prepend=0)


def held(texts: pa.Array, strings: set[str]) -> list[str]:
    """Those of ``strings`` that texts may hold: a search of all their bytes is much faster than one of each text."""
    *_, text = texts.buffers()
    text = text.to_pybytes() if text else b""
    return [x for x in strings if x.encode() in text]


class Cache:
    """The ids of strings; after :meth:`trim` of at most ``most``. Frequent strings come early, so a full cache gives up its newer half."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def __len__(self) -> int:
        return len(self.keys)

    def clear(self) -> None:
        self.keys, self.ids, self.starts = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def trim(self) -> None:
        if len(self) > self.most:
            n = self.most // 2
            self.keys, self.starts = pa.concat_arrays([self.keys[:n], self.keys[:0]]), self.starts[: n + 1].copy()
            self.ids = self.ids[: self.starts[-1]].copy()

    def places(self, strings: pa.Array, make: Callable[[pa.Array], Ragged]) -> np.ndarray:
        """Where each of the distinct ``strings`` is, after those that were missing have come in with the ids that ``make`` gives them."""
        found = pc.index_in(strings, value_set=self.keys)
        at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = found.is_null().to_numpy(zero_copy_only=False)
        if missing.any():
            new = strings.filter(pa.array(missing))
            ids, lengths = make(new)
            at[missing] = len(self) + np.arange(len(new))
            self.keys, self.ids = pa.concat_arrays([self.keys, new]), np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        return at

    def at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids at each place."""
        starts = self.starts.take(places)
        return starts, self.starts.take(places + 1) - starts


class Encoder:
    """text -> ids as 32-bit numbers. The caches hold ``most`` pieces and a sixth as many units (about 40 bytes an entry)."""

    def __init__(self, path: str, most: int = 900_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        plan = json.loads(self.tokenizer.to_str())
        vocabulary = plan["model"].get("vocab")
        #: Only this pre-tokeniser, without a normaliser, may be done piece by piece; the model must know every byte and be plain.
        self.in_pieces = plan["normalizer"] is None and plan["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.in_pieces = self.in_pieces and plan["model"]["type"] == "BPE" and set(BYTE_CHARS.values()) <= set(vocabulary)
        self.in_pieces = self.in_pieces and not any(plan["model"].get(x) for x in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        #: What a text must not hold if it is to be cut at blanks.
        self.apart = {"  ", *(t["content"] for t in plan["added_tokens"])}
        if self.in_pieces:
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in plan["model"]["merges"]]
            # units come with marks between them, each once: the library need not look for them nor keep them
            self.model = Tokenizer(BPE(vocab=vocabulary, merges=merges, cache_capacity=0))
            self.model.pre_tokenizer = CharDelimiterSplit("\n")
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
            byte, blank = {c: b for b, c in BYTE_CHARS.items()}, BYTE_CHARS[32]
            inside = [t for t in vocabulary if blank in t[1:] and set(t) <= byte.keys()]
            self.apart |= {bytes(map(byte.__getitem__, t)).decode("utf-8", "ignore") for t in inside}
        self.apart = {x for x in self.apart if not any(y in x and y != x for y in self.apart)}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.pieces, self.units = kept(Cache(most)), kept(Cache(most // 6))

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def modelled(self, units: pa.Array) -> Ragged:
        """Ids of units of the pre-tokeniser. Tokens have as many bytes as their units, so a unit's last token ends where the unit does."""
        shown = []
        for at in range(0, len(units), AT_ONCE):
            part = units[at : at + AT_ONCE].cast(pa.binary())
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(part)], part), pa.scalar(b"\xff", pa.binary()))[0].as_py()
            shown.append(SHOWN_AS.take(np.frombuffer(joined, np.uint8)).tobytes().decode("utf-16-le"))
        ids = [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(shown, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *ids])
        ends = np.searchsorted(np.cumsum(self.sizes.take(ids)), np.cumsum(pc.binary_length(units).to_numpy().astype(np.int64))) + 1
        return ids, np.diff(ends, prepend=0)

    def units_of(self, strings: pa.Array, before: str) -> tuple[pa.Array, np.ndarray]:
        """The units of strings with ``before`` in front, end to end, and the number of each string's."""
        lists = [self.split(before + x) for x in strings.to_numpy(zero_copy_only=False)]
        return pa.array(list(chain.from_iterable(lists)), pa.string()), np.array([len(x) for x in lists], np.int64)

    def spelled(self, strings: pa.Array, before: str = "") -> Ragged:
        """Ids of strings of several units each, with ``before``, a blank or nothing, in front."""
        plain = pc.match_substring_regex(strings, PLAIN)
        one, n = runs(strings.filter(plain), before)
        more, m = self.units_of(strings.filter(pc.invert(plain)), before)
        units = pa.concat_arrays([one, more]).dictionary_encode()
        places = self.units.places(units.dictionary, self.modelled)
        starts, lengths = self.units.at(places.take(units.indices.to_numpy()))
        upto = np.concatenate([[0], np.cumsum(lengths)])
        sizes = np.diff(upto.take(np.cumsum(np.concatenate([n, m]))), prepend=0)
        return ordered(gathered(self.units.ids, starts, lengths), sizes, plain)

    def worded(self, words: pa.Array) -> Ragged:
        """Ids of pieces, given without their blank; letters alone are one unit."""
        alone = pc.utf8_is_alpha(words)
        one, n = self.modelled(pc.binary_join_element_wise(" ", words.filter(alone), ""))
        more, m = self.spelled(words.filter(pc.invert(alone)), " ")
        return ordered(np.concatenate([one, more]), np.concatenate([n, m]), alone)

    def flat(self, texts: pa.Array) -> Ragged:
        """Ids of all texts, end to end, and their number in each; none for null."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = np.ones(len(texts), bool)
        if self.in_pieces:
            whole = pc.ends_with(texts, " ").to_numpy(zero_copy_only=False)
            for x in held(texts, self.apart):
                whole = whole | pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not whole.any():
            return self.cut(texts)
        found = self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)
        found = [np.array(x.ids, np.uint32) for x in found]
        ids, lengths = self.cut(pc.if_else(pa.array(whole), "", texts)) if self.in_pieces else (np.zeros(0, np.uint32), np.zeros(len(texts), np.int64))
        starts = np.cumsum(lengths) - lengths
        lengths[whole] = n = np.array([len(x) for x in found])
        starts[whole] = len(ids) + np.cumsum(n) - n
        return gathered(np.concatenate([ids, *found]), starts, lengths), lengths

    def cut(self, texts: pa.Array) -> Ragged:
        """The same for texts that may be cut at blanks."""
        self.pieces.trim()
        self.units.trim()
        words = pc.split_pattern(texts, " ")
        first = words.offsets.to_numpy()[:-1].astype(np.int64)  # an empty text has one empty word
        words = words.flatten()
        opening, opened = self.spelled(words.take(pa.array(first)))
        later = np.ones(len(words), bool)
        later[first] = False
        words = words.filter(pa.array(later)).dictionary_encode()
        places = self.pieces.places(words.dictionary, self.worded)
        starts, lengths = np.zeros(len(later), np.int64), np.zeros(len(later), np.int64)
        starts[later], lengths[later] = self.pieces.at(places.take(words.indices.to_numpy()))
        starts[first], lengths[first] = len(self.pieces.ids) + np.cumsum(opened) - opened, opened
        return gathered(np.concatenate([self.pieces.ids, opening]), starts, lengths), np.add.reduceat(lengths, first)

    def ended(self, texts: pa.Array, end: int) -> Ragged:
        """The same with the id ``end`` after each text."""
        ids, lengths = self.flat(texts)
        return np.insert(ids, np.cumsum(lengths), np.uint32(end)), lengths + 1

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, none for null."""
        ids, lengths = self.flat(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(lengths)[:-1]) if len(lengths) else []


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, most: int = 900_000) -> Encoder:
    """One for each vocabulary and Python worker, whose caches hold ``most`` pieces."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    found = ENCODERS[path]
    found.pieces.most, found.units.most = most, most // 6
    only(found.pieces, found.units)
    return found
