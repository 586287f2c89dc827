"""An adaptive context-mixing range coder for blocks of token ids.

A block is cut into lanes of equal length that are coded side by side, as numpy arrays, with one range coder each and models in common. Of
each id first comes which prediction holds: the id that last followed the same two ids (order 2), the one that last followed the same id (order 1), or neither.
How far these predictions are trusted follows from how often each was right in a row, by counts that adapt for each pair of such runs; that mixes the orders.
An id that neither predicts is coded by adaptive frequencies of ids (order 0). The models begin anew in every block, and a checksum of its ids ends it.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES, LEAST = 4096, 256
#: Bits of the table of order 2, and the longest run of right predictions that is told apart.
TWO, RUN = 18, 7
#: Bits of the frequencies of the choice of a prediction; frequencies of ids grow by GROWTH for a coded id.
CHOICE, GROWTH = 12, 24
U = np.uint64
#: A word of code; a range is never narrower than a word when a step begins, which leaves CHOICE and 20 bits for its frequencies.
WORD, TOP = U(32), U(1 << 32)
MOST_IDS = 1 << 19


class Models:
    """What all lanes of a block have learned so far; coder and decoder keep it alike."""

    def __init__(self, vocabulary: int, lanes: int) -> None:
        # a prediction and its run in one number: 8 * id + run
        self.two, self.one = np.zeros(1 << TWO, np.int64), np.zeros(vocabulary, np.int64)
        self.chosen = np.ones((2 * (RUN + 1) ** 2, 3), np.int64)
        self.size, self.seen, self.coded, self.step = vocabulary, np.ones(vocabulary, np.int64), [], 0
        self.last, self.mixed = np.zeros(lanes, np.int64), np.zeros(lanes, U)
        self.bound_choices()
        self.bound_ids()

    def bound_choices(self) -> None:
        upto = np.cumsum(self.chosen, axis=1)
        bound = np.zeros((len(upto), 4), np.int64)
        bound[:, 1:] = np.arange(1, 4) + upto * ((1 << CHOICE) - 3) // upto[:, 2:]
        self.start = bound[:, :3].ravel().astype(U)
        self.width = np.diff(bound, axis=1).ravel().astype(U)
        self.first, self.second = bound[:, 1].astype(U), bound[:, 2].astype(U)

    def bound_ids(self) -> None:
        upto = np.cumsum(self.seen)
        bound = np.zeros(self.size + 1, np.int64)
        bound[1:] = np.arange(1, self.size + 1) + upto * ((1 << 20) - self.size) // upto[-1]
        self.bound, self.span = bound[:-1].astype(U), np.diff(bound)
        self.ids_at: np.ndarray | None = None

    def id_at(self, place: np.ndarray) -> np.ndarray:
        """The ids whose parts of the 20-bit range hold the places."""
        if self.ids_at is None:
            self.ids_at = np.repeat(np.arange(self.size, dtype=np.int32), self.span)
        return self.ids_at.take(place).astype(np.int64)

    def predict(self) -> None:
        """The predictions of every lane, and the number of their context."""
        h = self.last.view(U) * U(0x9E3779B97F4A7C15)
        self.mixed += h
        self.at_two = (self.mixed >> U(64 - TWO)).view(np.int64)
        self.mixed = h << U(7)
        e, f = self.two.take(self.at_two), self.one.take(self.last)
        self.run_two, self.run_one = e & RUN, f & RUN
        e >>= 3
        f >>= 3
        self.id_two, self.id_one = e, f
        context = self.run_two << 3
        context += self.run_one
        context += (e == f).view(np.int8) * np.int64((RUN + 1) ** 2)
        self.context = context

    def learn(self, ids: np.ndarray, right_two: np.ndarray, right_one: np.ndarray, key: np.ndarray, missed: np.ndarray) -> None:
        """Teaches the models the ids of one step: ``key`` is context and choice, ``missed`` the ids that no prediction gave."""
        entry = ids << 3
        for table, at, run, right in ((self.two, self.at_two, self.run_two, right_two), (self.one, self.last, self.run_one, right_one)):
            run += 1
            np.minimum(run, RUN, out=run)
            run *= right
            run += entry
            table[at] = run
        self.chosen += np.bincount(key, minlength=self.chosen.size).reshape(self.chosen.shape)
        self.coded.append(missed)
        self.last = ids
        self.step += 1
        early = self.step & (self.step - 1) == 0
        if self.step % 8 == 0 or early:
            self.bound_choices()
        if self.step % 64 == 0 or early:
            self.seen += GROWTH * np.bincount(np.concatenate(self.coded), minlength=self.size)
            self.coded = []
            self.bound_ids()


def settled(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Lanes whose top word can be passed on: it will not change any more, or the range is too narrow and is cut where the top word changes."""
    done = (low ^ (low + span)) < TOP
    narrow = span < TOP
    cut = np.flatnonzero(narrow & ~done)
    if len(cut):
        span[cut] = (U(0) - low[cut]) & (TOP - U(1))
    return np.flatnonzero(done | narrow)


def shape(n: int) -> tuple[int, int]:
    """Steps and lanes of a block of ``n`` ids."""
    steps = max(LEAST, -(-n // LANES))
    return steps, max(1, -(-n // steps))


def encode(ids: np.ndarray) -> bytes:
    """The code of a block: number of ids, vocabulary and checksum, the words of each lane, and the lanes' words."""
    n, size = len(ids), int(ids.max()) + 1 if len(ids) else 1
    if size > MOST_IDS:
        raise ValueError(f"ids of {MOST_IDS} and more are not supported")
    head = np.array([n, size, zlib.crc32(ids.astype("<u4").tobytes())], "<u4").tobytes()
    if not n:
        return head
    steps, lanes = shape(n)
    padded = np.zeros(steps * lanes, np.int64)
    padded[:n] = ids
    rows = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    m, out, filled = Models(size, lanes), np.zeros((lanes, 2 * steps + 2), np.uint32), np.zeros(lanes, np.int64)
    low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    for x in rows:
        m.predict()
        right_two, right_one = m.id_two == x, m.id_one == x
        choice = 2 - right_one.view(np.uint8)
        choice *= (~right_two).view(np.uint8)
        key = m.context * 3
        key += choice
        span >>= U(CHOICE)
        low += span * m.start.take(key)
        span *= m.width.take(key)
        miss = np.flatnonzero(choice == 2)
        missed = x.take(miss)
        part = span.take(miss) >> U(20)
        low[miss] += part * m.bound.take(missed)
        span[miss] = part * m.span.take(missed).view(U)
        who = settled(low, span)
        while len(who):
            top, at, narrow = low.take(who), filled.take(who), span.take(who) << WORD
            out[who, at] = top >> WORD
            filled[who] = at + 1
            top <<= WORD
            low[who] = top
            again = settled(top, narrow)
            span[who] = narrow
            who = who.take(again)
        m.learn(x, right_two, right_one, key, missed)
    for k in (32, 0):
        out[np.arange(lanes), filled] = (low >> U(k)) & (TOP - U(1))
        filled += 1
    return head + filled.astype("<u4").tobytes() + out[np.arange(out.shape[1]) < filled[:, None]].astype("<u4").tobytes()


def decode(code: bytes) -> np.ndarray:
    """The ids of a block again, as 32-bit numbers; raises if they do not match their checksum."""
    n, size, check = (int(v) for v in np.frombuffer(code, "<u4", 3))
    ids = np.zeros(0, np.uint32)
    if n:
        steps, lanes = shape(n)
        filled = np.frombuffer(code, "<u4", lanes, 12).astype(np.int64)
        flat = np.append(np.frombuffer(code, "<u4", offset=12 + 4 * lanes), np.zeros(4, np.uint32)).astype(U)
        at = np.cumsum(filled) - filled
        value = (flat[at] << WORD) | flat[at + 1]
        at += 2
        m, rows = Models(size, lanes), np.zeros((steps, lanes), np.uint32)
        low, span = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
        for t in range(steps):
            m.predict()
            span >>= U(CHOICE)
            share = value - low
            no_two, neither = share >= span * m.first.take(m.context), share >= span * m.second.take(m.context)
            key = m.context * 3
            key += no_two
            key += neither
            low += span * m.start.take(key)
            span *= m.width.take(key)
            x = np.where(no_two, m.id_one, m.id_two)
            miss = np.flatnonzero(neither)
            part, base = span.take(miss) >> U(20), low.take(miss)
            place = (value.take(miss) - base) // part
            missed = m.id_at(np.minimum(place, U((1 << 20) - 1)).view(np.int64))  # a damaged code must reach the checksum
            x[miss] = missed
            low[miss] = base + part * m.bound.take(missed)
            span[miss] = part * m.span.take(missed).view(U)
            who = settled(low, span)
            while len(who):
                where, top, narrow = at.take(who), low.take(who) << WORD, span.take(who) << WORD
                value[who] = (value.take(who) << WORD) | flat.take(where, mode="clip")
                at[who] = where + 1
                low[who] = top
                again = settled(top, narrow)
                span[who] = narrow
                who = who.take(again)
            m.learn(x, ~no_two, m.id_one == x, key, missed)
            rows[t] = x
        ids = rows.T.ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("a block's checksum does not match its ids")
    return ids
