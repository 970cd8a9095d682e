"""Statistics of the lines of texts, computed for many texts at once on arrays of code points.

A line ends at a line feed, a carriage return, or one of the other line ends of Unicode. Blank lines
are no lines. A line of over PIECE signs is measured in pieces of PIECE signs, so that one paragraph
on one line is not a single observation.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 200

UPPER, LOWER, LETTER, DIGIT, BLANK, STOP, MARK, SYMBOL, BREAK = range(9)
KINDS = 9

#: Bits of the groups of signs that are counted.
DIVIDES, COLUMN, ANGLE, VOWEL = 1, 2, 4, 8

NAMES = (
    "bias", "log_chars", "letters", "digits", "blanks", "marks", "symbols", "upper", "title_words", "log_words",
    "word_length", "longest_word", "common", "no_common", "ends_stop", "ends_separator", "goes_on", "bullet", "number_first",
    "columns", "separators", "angles", "number_words", "again_5", "again_2", "few_words", "again_line", "log_text",
    "one_line", "of_widest", "lower_first", "inner_stops", "single_signs", "same_form", "one_sign", "vowels",
    "near_common", "next_lower", "runs_on",
)
WIDTH = len(NAMES)

_STOPS, _SEPARATORS, _BULLETS = ".!?…:»”\")]", ";,", "-*•–·‣◦"
_BREAKS = "\n\r\x0b\x0c\x85  "
_VOWELS = "aeiouyäöüéèêëàâîïôûùáíóúñαειουωηάέίόύώή"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each code point, the hash of its lower-case form, and the groups it is in."""
    import unicodedata

    top = 0x20000
    kind = np.full(0x110000, SYMBOL, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    by_category = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": LETTER, "Lm": LETTER, "Nd": DIGIT, "Zs": BLANK, "Zl": BREAK, "Zp": BREAK}
    for cp in range(top):
        c = chr(cp)
        category = unicodedata.category(c)
        kind[cp] = by_category.get(category, MARK if category[0] == "P" else LETTER if category[0] == "M" else SYMBOL)
        if category == "Lu":
            low = c.lower()
            lower[cp] = ord(low) if len(low) == 1 else cp
    kind[0x20000:0x32000] = LETTER
    kind[ord("\t")] = BLANK
    for c in _BREAKS:
        kind[ord(c)] = BREAK
    for c in ".!?…":
        kind[ord(c)] = STOP
    for c in "©§¶ªº":  # signs of garbled text, whatever their category
        kind[ord(c)] = SYMBOL
    hashed = np.random.default_rng(20240607).integers(1, 1 << 63, 0x110000, dtype=np.uint64) | np.uint64(1)
    groups = np.zeros(0x110000, np.uint8)
    for bit, signs in ((DIVIDES, ";,:|*"), (COLUMN, "\t|"), (ANGLE, "<>"), (VOWEL, _VOWELS + _VOWELS.upper())):
        groups[[ord(c) for c in signs]] |= bit
    return kind, hashed[lower], groups


def word_hash(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, without regard to case; the words' signs lie end to end."""
    _, hashed, _ = _tables()
    length = ends - starts
    if not len(length):
        return np.empty(0, np.uint64)
    first = np.cumsum(length) - length
    within = np.arange(length.sum()) - np.repeat(first, length)
    at = np.repeat(starts, length) + within
    with np.errstate(over="ignore"):
        signs = hashed[points[at]] * (within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return np.add.reduceat(signs ^ (signs >> np.uint64(31)), first)


def common_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of a list of words."""
    hashes = []
    for w in words:
        p = np.array([ord(c) for c in w], np.uint32)
        if len(p):
            hashes.append(word_hash(p, np.array([0]), np.array([len(p)]))[0])
    return np.unique(np.array(hashes, np.uint64))


def _again(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the same key came before in the same text."""
    with np.errstate(over="ignore"):
        own = key * np.uint64(0xD6E8FEB86659FD93) + (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        own ^= own >> np.uint64(29)
    return repeated(own)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether the same 64-bit key came before.

    Keys name slots of a table, in which the first key of each slot is left; keys that are another than
    the one in their slot try again with other slots.
    """
    n = len(keys)
    seen, rest = np.zeros(n, bool), np.arange(n)
    bits = max(8, (2 * n).bit_length())
    table = np.empty(1 << bits, np.int64)
    while len(rest):
        with np.errstate(over="ignore"):
            slot = ((keys[rest] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        table[slot[::-1]] = rest[::-1]  # of equal slots, the last one written stays
        first = table[slot]
        same = keys[first] == keys[rest]
        seen[rest[same & (first != rest)]] = True
        rest = rest[~same]
        keys = _remixed(keys) if len(rest) else keys
    return seen


def _remixed(keys: np.ndarray) -> np.ndarray:
    """Other keys, different where the keys are."""
    with np.errstate(over="ignore"):
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return keys ^ (keys >> np.uint64(32))


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return n / np.maximum(of, 1)


class Lines:
    """Lines (or pieces of lines) of a batch of texts: ``text``, ``chars``, ``features`` of each."""

    def __init__(self, texts: pa.Array, common: np.ndarray):
        kind_of, _, group_of = _tables()
        texts = texts.cast(pa.string()).fill_null("")
        n_texts = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n_texts + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        # position of each text's first sign
        lead = np.cumsum((raw & 0xC0) != 0x80)
        bounds = np.append(0, lead)[offsets - offsets[0]]
        self.text_chars = np.diff(bounds)
        n = len(points)
        if not n:
            self.text = self.chars = self.words = self.word_chars = np.empty(0, np.int64)
            self.common, self.ends_stop = np.empty(0), np.empty(0, bool)
            self.inner_piece = np.empty(0, bool)
            self.count, self.features = np.empty((0, KINDS), np.int64), np.empty((0, WIDTH), np.float32)
            return
        kind, group = kind_of[points], group_of[points]
        text_of = np.repeat(np.arange(n_texts), self.text_chars)

        # a line begins behind a break and at the start of a text; pieces begin every PIECE signs
        begins = np.zeros(n + 1, bool)
        begins[bounds[:-1]] = True
        begins[np.flatnonzero(kind == BREAK) + 1] = True
        line_start = np.flatnonzero(begins[:n])
        line_end = np.append(line_start[1:], n)
        pieces = np.maximum(1, -(-(line_end - line_start) // PIECE))
        rank = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(line_start, pieces) + rank * PIECE
        end = np.minimum(start + PIECE, np.repeat(line_end, pieces))
        last = rank == np.repeat(pieces, pieces) - 1
        line_length = np.repeat(line_end - line_start, pieces)

        count = np.bincount(np.repeat(np.arange(len(start)), end - start) * KINDS + kind, minlength=len(start) * KINDS)
        count = count.reshape(-1, KINDS)
        seen = count.sum(axis=1) - count[:, BREAK] - count[:, BLANK] > 0
        start, end, last, line_length, count, rank = (v[seen] for v in (start, end, last, line_length, count, rank))
        m = len(start)
        self.text = text_of[start]
        chars = count.sum(axis=1) - count[:, BREAK]
        self.chars = chars
        self.count = count
        piece_of = np.full(n, -1, np.int64)
        length = end - start
        flat = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
        piece_of[flat] = np.repeat(np.arange(m), length)

        # first and last sign that is no white space
        solid = np.flatnonzero((kind != BLANK) & (kind != BREAK) & (piece_of >= 0))
        owner = piece_of[solid]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])  # every piece has one
        head, tail = solid[first], solid[np.append(first[1:], len(solid))[: len(first)] - 1]
        p_head, p_tail = points[head], points[tail]
        p_next = points[np.minimum(head + 1, n - 1)]
        next_kind = kind[np.minimum(head + 1, n - 1)]

        # words: letters and digits side by side
        wordly = kind <= DIGIT
        edge = np.zeros(n + 1, bool)
        edge[:n] = wordly
        cut = np.zeros(n + 1, bool)
        cut[bounds[:-1]] = True  # a word ends with its text
        w_start = np.flatnonzero(wordly & (~np.append(False, wordly[:-1]) | cut[:n]))
        stop_at = np.flatnonzero(~edge | cut)
        w_end = stop_at[np.searchsorted(stop_at, w_start, "right")] if len(w_start) else w_start
        w_piece = piece_of[w_start]
        w_hash = word_hash(points, w_start, w_end)
        w_text = text_of[w_start]
        w_len = w_end - w_start
        words = np.bincount(w_piece, minlength=m)
        per = lambda weights: np.bincount(w_piece, weights, minlength=m)
        is_common = np.zeros(len(w_hash), bool)
        if len(common):
            is_common = common[np.minimum(np.searchsorted(common, w_hash), len(common) - 1)] == w_hash
        self.words, self.common, self.word_chars = words, per(is_common), per(w_len)
        title = kind[w_start] == UPPER
        numeric = kind[w_start] == DIGIT

        w_first = np.flatnonzero(np.append(True, w_text[1:] != w_text[:-1])) if len(w_text) else w_text
        far = np.arange(len(w_text)) - np.repeat(w_first, np.diff(np.append(w_first, len(w_text))))

        def grams(k: int) -> np.ndarray:
            """Whether the k words up to a word came before in its text."""
            key = np.zeros(len(w_hash), np.uint64)
            with np.errstate(over="ignore"):
                for back in range(k):
                    moved = np.concatenate([np.zeros(min(back, len(w_hash)), np.uint64), w_hash[: max(len(w_hash) - back, 0)]])
                    key = key * np.uint64(0x100000001B3) + moved
            return _again(w_text, key) & (far >= k - 1)

        again_5, again_2, again_1 = grams(5), grams(2), _again(w_text, w_hash)
        text_words = np.bincount(w_text, minlength=n_texts)
        distinct = np.bincount(w_text[~again_1], minlength=n_texts)
        few = np.log1p(distinct) - np.minimum(0.75 * np.log1p(text_words), np.log(200))

        # lines whose words come again, numbers aside, and lines of the same form
        line_key = np.zeros(m, np.uint64)
        with np.errstate(over="ignore"):
            if len(w_piece):
                at = np.flatnonzero(np.append(True, w_piece[1:] != w_piece[:-1]))
                place = np.arange(len(w_piece)) - np.repeat(at, np.diff(np.append(at, len(w_piece))))
                mixed = np.where(numeric, np.uint64(77), w_hash) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                line_key[w_piece[at]] = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), at)
            head_class = np.where(kind[head] == DIGIT, 1, np.where(kind[head] <= LETTER, 2 + kind[head], p_head.astype(np.int64) + 9))
            tail_class = np.where(kind[tail] == DIGIT, 1, np.where(kind[tail] <= LETTER, 2, p_tail.astype(np.int64) + 9))
            form = (head_class * 1200007 + tail_class * 31 + np.minimum(count[:, MARK], 5)).astype(np.uint64)
            own_form = (form + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + self.text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        again_line = _again(self.text, line_key)
        number = pa.array(own_form ^ (own_form >> np.uint64(32))).dictionary_encode().indices.to_numpy()
        in_text = np.bincount(self.text, minlength=n_texts)
        same_form = np.bincount(number)[number] / np.maximum(in_text[self.text], 1)

        def signs(which: int) -> np.ndarray:
            own = piece_of[np.flatnonzero(group & which)]
            return np.bincount(own[own >= 0], minlength=m)

        # runs of three blanks or dots, tabs and pipes stand between columns
        blank3 = np.zeros(n, bool)
        if n > 2:
            same = (points[1:] == points[:-1]) & ((kind[1:] == BLANK) | (points[1:] == ord(".")))
            blank3[2:] = same[1:] & same[:-1]
            blank3[3:] &= ~(same[2:] & same[1:-1] & same[:-2])
        own = piece_of[np.flatnonzero(blank3)]
        columns = np.bincount(own[own >= 0], minlength=m) + signs(COLUMN)
        stop_inside = np.flatnonzero((kind == STOP) & (np.append(kind[1:], BREAK) == BLANK))
        own = piece_of[stop_inside]
        inner_stops = np.bincount(own[own >= 0], minlength=m)
        letters = count[:, UPPER] + count[:, LOWER] + count[:, LETTER]
        widest = np.zeros(n_texts, np.int64)
        np.maximum.at(widest, self.text, line_length)
        longest = np.zeros(m, np.int64)
        np.maximum.at(longest, w_piece, w_len)
        vowels = signs(VOWEL)
        repeats = np.zeros(n, bool)
        repeats[1:] = (points[1:] == points[:-1]) & (kind[1:] != BLANK) & (kind[1:] > DIGIT)
        own = piece_of[np.flatnonzero(repeats)]
        one_sign = np.bincount(own[own >= 0], minlength=m)
        in_set = lambda p, chars_: np.isin(p, [ord(c) for c in chars_])
        self.ends_stop = in_set(p_tail, ".!?…") & last
        self.inner_piece = ~last  # of a line, but not its last piece
        bullet = (in_set(p_head, _BULLETS) & (next_kind == BLANK)) | ((p_head == ord("(")) & (points[np.minimum(head + 2, n - 1)] == ord(")")))
        # the lines before and behind, in the same text
        lower_first = (kind[head] == LOWER) & (rank == 0)
        ends = in_set(p_tail, _STOPS + _SEPARATORS) & last
        has_next = np.append(self.text[1:] == self.text[:-1], False)
        has_before = np.append(False, has_next[:-1])
        share = _share(self.common, words)
        both = np.where(has_before, np.append(0, share[:-1]), 0) + np.where(has_next, np.append(share[1:], 0), 0)
        near_common = both / np.maximum(has_before.astype(int) + has_next, 1)
        next_lower = np.append(lower_first[1:], False) & has_next & ~ends
        runs_on = lower_first & has_before & ~np.append(False, ends[:-1])
        f = np.empty((m, WIDTH), np.float32)
        columns_of = (
            np.ones(m), np.log1p(chars) / 5, _share(letters, chars), _share(count[:, DIGIT], chars), _share(count[:, BLANK], chars),
            _share(count[:, MARK] + count[:, STOP], chars), _share(count[:, SYMBOL], chars), _share(count[:, UPPER], letters),
            _share(per(title), words), np.log1p(words) / 3, np.minimum(_share(self.word_chars, words), 20) / 10,
            np.minimum(longest, 60) / 30, share, self.common == 0, in_set(p_tail, _STOPS) & last,
            in_set(p_tail, _SEPARATORS) & last, ~last, bullet & (rank == 0), (kind[head] == DIGIT) & (rank == 0),
            np.minimum(columns, 6) / 3, np.minimum(_share(signs(DIVIDES), words), 2), np.minimum(signs(ANGLE), 6) / 3,
            _share(per(numeric), words), _share(per(again_5), words), _share(per(again_2), words), few[self.text], again_line,
            np.log1p(self.text_chars[self.text]) / 8, in_text[self.text] == 1, line_length / np.maximum(widest[self.text], 1),
            lower_first, np.minimum(inner_stops, 4) / 2, _share(per(w_len == 1), words), same_form,
            _share(one_sign, chars), _share(vowels, letters), near_common, next_lower, runs_on,
        )
        for i, column in enumerate(columns_of):
            f[:, i] = column
        self.features = f
