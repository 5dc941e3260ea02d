"""Byte-pair encoding by dynamic programming over prefixes.

Every prefix of a word has one encoding, so it has one last token. An automaton over the vocabulary gives the tokens
that end at each place, longest first; the last token of a prefix is the one that covers it, or the one whose
neighbour to the left, already known, is compatible: a pair of tokens is compatible if undoing their merges, latest
first, never shows a pair across the boundary that would have merged earlier. Back-pointers give the exact ids, in time
linear in the word.

Work is done on blocks of texts: Arrow lower-cases and splits them and numbers their words as a table of known words
does, numpy runs the dynamic programme over all new words at once, one prefix length at a time and once for words that
begin alike, and the ids of a text are gathered by the numbers of its words; ``counts`` adds up their sizes instead. Few
or very long words go one by one, in time linear in the word.

The driver reads the vocabulary once and broadcasts it (1.7 MB); each Python worker builds the automaton once and keeps
bounded tables of words and of pairs. Whole texts stream through mapInArrow; nothing is shuffled. A text of more than
``BLOCK`` bytes is taken in pieces that end at white space, so memory follows the block and the ids of one text.

Text is normalised and split as the vocabulary file says: NFC, white space, lower case; letters, single digits and
other runs. Strings of special tokens are single ids. Texts outside Latin letters go through the library's normaliser
and splitter, never through its model.

Decoding looks up the token of every id; the vocabulary file names no decoder, so tokens are joined by spaces.

Defined results: null and empty texts have no ids and decode to an empty text; very long texts and words are encoded
whole; repeated rows get equal results; bytes that are not UTF-8 count as replacement characters; a column named like
an output is replaced, all others pass through ``encode`` and ``decode``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from stratalyn.llm.common import map_rows

KEPT_WORDS = 400_000
KEPT_PAIRS = 1 << 20
BLOCK = 4 << 20
GROUP = 16_384  # words in one run of the dynamic programme
FEW = 48  # fewer words, or pairs, go one by one
#: Texts with anything but letters and signs for which NFC changes nothing and Arrow's lower case is the library's.
_PLAIN = "".join(c for c in map(chr, [*range(0xA1, 0xAD), *range(0xAE, 0x250)]) if pc.utf8_lower(pa.scalar(c)).as_py() == c.lower())
_ODD = "[^\\t\\n\\r\\x20-\\x7e" + _PLAIN + "]"
_GAP = re.compile(rb"[\t\n\r ]")


class _Map:
    """Whole numbers below 2**62 to numbers, in numpy: open addressing, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        self.mask = (1 << max(4, (2 * max(len(keys), room)).bit_length())) - 1
        self.keys, self.values, self.n = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, values.dtype), 0
        self.put(keys, values)

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table yet."""
        self.n += len(keys)
        at, left = self._start(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several at one place the last one stays
            self.values[at[free]] = values[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        at = self._start(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], default)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every piece, one piece after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


#: Kinds of letters below U+0250: 1 letters, 2 numbers, 3 all others.
_KIND = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 3) for i in range(0x250)], np.uint8)


def _runs(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words below U+0250 cut into runs of letters, single numbers and runs of others, and how many each word has."""
    raw, offsets = _raw(words)
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    kind, inside = _KIND[np.minimum(raw, 127)], (raw & 0xC0) == 0x80
    lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xCA))
    kind[lead] = kind[lead + 1] = _KIND[np.minimum((raw[lead] & 0x1F).astype(np.int64) << 6 | raw[lead + 1] & 0x3F, 0x24F)]
    head = np.ones(len(raw), bool)
    head[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    head &= ~inside
    head[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(head)
    counts = np.diff(np.searchsorted(starts, offsets))
    bounds = np.concatenate((starts, [len(raw)])).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))), counts


def _raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    _, offsets, data = strings.buffers()
    o = np.frombuffer(offsets, np.int32, len(strings) + 1, 4 * strings.offset).astype(np.int64) if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), o


def _by_start(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order of words in which those that begin alike, in up to 16 bytes, stand together."""
    key = np.zeros((len(starts), 16), np.uint8)
    for i in range(16):
        on = np.flatnonzero(sizes > i)
        key[on, i] = raw[starts[on] + i]
    key = key.view(">u8")
    return np.lexsort((key[:, 1], key[:, 0]))


class Tokenizer:
    def __init__(self, source: str):
        given = json.loads(source)
        model = given["model"]
        self.source, self.suffix = source, model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.text = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        size = max(self.text) + 1
        self.rank, self.left, self.right, self.merge = [-1] * size, [0] * size, [0] * size, {}
        for rank, (a, b) in enumerate(model["merges"]):
            t, a, b = vocab[a + b], vocab[a], vocab[b]
            self.rank[t], self.left[t], self.right[t], self.merge[a << 17 | b] = rank, a, b, rank
        self._byte = self._bytes_to_signs(vocab)
        self._pairs: dict[int, bool] = {}
        self._next: dict[int, int] = {}
        self._whole: dict[int, bool] = {}
        self._automaton(vocab)
        self._arrays()
        self._pattern = next(p["pattern"]["Regex"] for p in given["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._odd = "|".join([_ODD, *map(re.escape, self.special)])
        self._library = None
        self._forget()
        shown = [self.text.get(i, "") for i in range(size)]
        self.token_text, self.decimal = pa.array([x + " " for x in shown]), pa.array([f"{i} " for i in range(size)])

    def _arrays(self) -> None:
        """The same tables for numpy."""
        keys = lambda d: np.fromiter(d, np.int64, len(d))
        self.n_rank, self.n_left, self.n_right, self.n_length = (np.array(x, np.int64) for x in (self.rank, self.left, self.right, self.length))
        self.n_merge = _Map(keys(self.merge), np.fromiter(self.merge.values(), np.int64, len(self.merge)))
        edges = {at << 17 | s: to for at, go in enumerate(self._go) for s, to in go.items()}
        self.n_go, self.n_back = _Map(keys(edges), np.fromiter(edges.values(), np.int64, len(edges))), np.array(self._back, np.int64)
        self.n_token, self.n_hit = np.array(self._ends, np.int64), np.zeros(len(self._go), np.int64)
        for at in self._order:  # the nearest suffix, itself included, that is a token
            self.n_hit[at] = at if self._ends[at] >= 0 else self.n_hit[self._back[at]]
        self.n_more = self.n_hit[self.n_back]
        self.n_whole = np.full(len(self.rank), -1, np.int8)
        self.n_pairs = _Map(np.zeros(0, np.int64), np.zeros(0, np.int8), KEPT_PAIRS)
        self.n_byte = np.array(self._byte, np.int32)

    def _forget(self) -> None:
        """An empty table of words: their ids one after the other, where each begins, and how many it has."""
        self.known = pa.array([], pa.string())
        self.ids, self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _bytes_to_signs(self, vocab: dict[str, int]) -> list[tuple[int, int]]:
        """For each byte its symbol inside a word and at the end of one."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow 255
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        self._sign_ids = {s: (vocab[s], vocab[s + self.suffix]) for s in sign.values()}
        return [self._sign_ids[sign[b]] for b in range(256)]

    def _automaton(self, vocab: dict[str, int]) -> None:
        symbols: dict[int, tuple[int, ...]] = {}
        order = sorted(vocab.values(), key=lambda t: self.rank[t])
        for t in order:
            symbols[t] = (t,) if self.rank[t] < 0 else symbols[self.left[t]] + symbols[self.right[t]]
        self.length = [1] * len(self.rank)
        go: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for t in order:
            self.length[t], at = len(symbols[t]), 0
            for s in symbols[t]:
                at = go[at].setdefault(s, len(go))
                if at == len(go):
                    go.append({})
                    ends.append(-1)
            ends[at] = t
        back, found = [0] * len(go), [()] * len(go)
        queue = list(go[0].values())
        for at in queue:
            found[at] = found[back[at]] if ends[at] < 0 else ((ends[at], self.length[ends[at]]), *found[back[at]])
            for s, to in go[at].items():
                b = back[at]
                while b and s not in go[b]:
                    b = back[b]
                back[to] = go[b].get(s, 0)
                queue.append(to)
        # breadth first: a node's suffix is shallower, so its matches are known before the node's own
        self._go, self._back, self._found, self._ends, self._order = go, back, found, ends, queue

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of a's text followed by b's is just (a, b)."""
        rank, limit = self.rank, len(self.rank)
        while True:
            r = self.merge.get(a << 17 | b)
            if r is not None and r < limit:
                return False
            if rank[a] > rank[b]:  # a's merge is the later one; an equal rank merges left to right
                limit, a = rank[a], self.right[a]
            elif rank[b] < 0:
                return True
            else:
                limit, b = rank[b] + 1, self.left[b]

    def whole(self, t: int) -> bool:
        """Whether the encoding of t's text is t itself."""
        known = self._whole.get(t)
        if known is None:
            a, b, r = self.left[t], self.right[t], self.rank[t]
            if r >= 0 and self.whole(a) and self.whole(b):
                # nothing may merge across the boundary before rank r: the pair (a, b) itself merges at r
                self.merge.pop(a << 17 | b)
                known = self._before(a, b, r)
                self.merge[a << 17 | b] = r
            else:
                known = r < 0
            self._whole[t] = known
        return known

    def _before(self, a: int, b: int, most: int) -> bool:
        rank, limit = self.rank, most
        while True:
            r = self.merge.get(a << 17 | b)
            if r is not None and r < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] < 0:
                return True
            else:
                limit, b = rank[b] + 1, self.left[b]

    def _step(self, key: int) -> int:
        """The automaton's next state, kept in a bounded table."""
        at, s = key >> 17, key & 0x1FFFF
        while at and s not in self._go[at]:
            at = self._back[at]
        at = self._go[at].get(s, 0)
        if len(self._next) >= KEPT_PAIRS:
            self._next.clear()
        self._next[key] = at
        return at

    def encode_symbols(self, symbols: list[int]) -> list[int]:
        step, found, pairs, last, at, i = self._next, self._found, self._pairs, [], 0, 0
        for s in symbols:
            key = at << 17 | s
            at = step[key] if key in step else self._step(key)
            for t, n in found[at]:
                if n > i:
                    if self.whole(t):
                        last.append(t)
                        break
                    continue
                key = last[i - n] << 17 | t
                if key in pairs:
                    if not pairs[key]:
                        continue
                else:
                    if len(pairs) >= KEPT_PAIRS:
                        pairs.clear()
                    pairs[key] = self.compatible(last[i - n], t)
                    if not pairs[key]:
                        continue
                last.append(t)
                break
            i += 1
        out, i, length = [], len(symbols) - 1, self.length
        while i >= 0:
            out.append(last[i])
            i -= length[last[i]]
        out.reverse()
        return out

    def _next_state(self, at: np.ndarray, s: np.ndarray) -> np.ndarray:
        out = self.n_go.get(at << 17 | s, -1)
        left = np.flatnonzero(out < 0)
        while len(left):
            root = at[left] == 0
            out[left[root]] = 0
            left = left[~root]
            at[left] = self.n_back[at[left]]
            out[left] = self.n_go.get(at[left] << 17 | s[left], -1)
            left = left[out[left] < 0]
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for many pairs at once, kept in a bounded table."""
        keys = a << 17 | b
        out = self.n_pairs.get(keys, -1)
        miss = np.unique(keys[out < 0])
        if not len(miss):
            return out > 0
        if self.n_pairs.n + len(miss) > KEPT_PAIRS:
            self.n_pairs = _Map(np.zeros(0, np.int64), np.zeros(0, np.int8), max(KEPT_PAIRS, len(miss)))
        x, y, ok = miss >> 17, miss & 0x1FFFF, np.zeros(len(miss), np.int8)
        limit, left = np.full(len(miss), len(self.rank)), np.arange(len(miss))
        while len(left) >= FEW:
            p, q = x[left], y[left]
            fine = self.n_merge.get(p << 17 | q, 1 << 40) >= limit[left]
            left, p, q = left[fine], p[fine], q[fine]
            rp, rq = self.n_rank[p], self.n_rank[q]
            first, done = rp > rq, (rp <= rq) & (rq < 0)
            ok[left[done]] = 1
            limit[left] = np.where(first, rp, rq + 1)
            x[left], y[left] = np.where(first, self.n_right[p], p), np.where(first, q, self.n_left[q])
            left = left[~done]
        ok[left] = [self.compatible(k >> 17, k & 0x1FFFF) for k in miss[left].tolist()]
        self.n_pairs.put(miss, ok)
        return self.n_pairs.get(keys, 0) > 0

    def _whole_tokens(self, t: np.ndarray) -> np.ndarray:
        out = self.n_whole[t]
        for x in np.unique(t[out < 0]).tolist():
            self.n_whole[x] = self.whole(x)
        return self.n_whole[t] > 0

    def _encode_group(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has; ``symbols`` has a row a word. What a word begins with like the row before it is looked at once."""
        words, longest = symbols.shape
        same, fresh = symbols[1:] == symbols[:-1], np.zeros(words, np.int64)  # where each word leaves the one before
        fresh[1:] = np.minimum(np.where(same.all(axis=1), longest, same.argmin(axis=1)), np.minimum(sizes[1:], sizes[:-1]))
        last, state = np.zeros((longest, words), np.int32), np.zeros(words, np.int64)
        for i in range(longest):
            own = np.flatnonzero((fresh <= i) & (sizes > i))
            if not len(own):
                continue
            alike = np.diff(own, append=words)  # rows between one of these and the next are its equals so far, or at their end
            found = self._next_state(state[own], symbols[own, i].astype(np.int64))
            state[own[0] :] = np.repeat(found, alike)
            at, left, tokens = self.n_hit[found], np.arange(len(own)), np.zeros(len(own), np.int32)
            while len(left):
                t = self.n_token[at]
                n = self.n_length[t]
                head = n > i
                ok = np.empty(len(left), bool)
                ok[head] = self._whole_tokens(t[head])
                rest = np.flatnonzero(~head)
                ok[rest] = self._compatible(last[i - n[rest], own[left[rest]]].astype(np.int64), t[rest])
                tokens[left[ok]] = t[ok]
                at, left = self.n_more[at[~ok]], left[~ok]
            last[i, own[0] :] = np.repeat(tokens, alike)
        out, n, at, rows = np.zeros((words, longest), np.int32), np.zeros(words, np.int64), sizes - 1, np.arange(words)
        while len(rows):  # back-pointers
            t = last[at[rows], rows]
            out[rows, n[rows]] = t
            n[rows] += 1
            at[rows] -= self.n_length[t]
            rows = rows[at[rows] >= 0]
        turned = n[:, None] - 1 - np.arange(int(n.max()))
        return np.take_along_axis(out, np.maximum(turned, 0), axis=1)[turned >= 0], n

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of the splitter, one after the other, and how many each has."""
        raw, offsets = _raw(pieces)
        raw, offsets, sizes = raw[offsets[0] : offsets[-1]], offsets - offsets[0], np.diff(offsets)
        full = sizes > 0
        signs, ends = self.n_byte[raw, 0], offsets[1:][full] - 1
        signs[ends] = self.n_byte[raw[ends], 1]
        order = np.argsort(sizes, kind="stable")
        order = order[int((~full).sum()) :]
        n, parts, owners = np.zeros(len(sizes), np.int64), [], []
        own, lo = sizes[order], 0
        while lo < len(order):  # a run's places stay in proportion to its signs
            hi = int(np.searchsorted(own, max(16, 2 * own[lo]), side="right"))
            mine = order[lo:hi]
            if len(mine) < FEW:
                each = [self.encode_symbols(signs[offsets[r] : offsets[r + 1]].tolist()) for r in mine.tolist()]
                n[mine] = [len(x) for x in each]
                parts += [np.array(x, np.int32) for x in each]
            else:
                mine = mine[_by_start(raw, offsets[mine], sizes[mine])]
                for at in range(0, len(mine), GROUP):
                    rows = mine[at : at + GROUP]
                    size = sizes[rows]
                    matrix = np.zeros((len(rows), int(size.max())), np.int32)
                    matrix[np.arange(matrix.shape[1]) < size[:, None]] = signs[spread(offsets[rows], size)]
                    ids, n[rows] = self._encode_group(matrix, size)
                    parts.append(ids)
            owners.append(mine)
            lo = hi
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        begin = np.zeros(len(sizes), np.int64)
        placed = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        begin[placed] = np.cumsum(n[placed]) - n[placed]
        return ids[spread(begin, n)], n

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and how many each has; one from the library's splitter starts with a NUL, a special token with \\1."""
        quoted = pc.match_substring(words, "'")  # the pattern's own cases; all others are cut by the kinds of their letters
        rows = np.flatnonzero(quoted.to_numpy(zero_copy_only=False))
        others = np.setdiff1d(np.arange(len(words)), rows, assume_unique=True)
        alone, alone_counts = _runs(words.filter(pc.invert(quoted)))
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(words.filter(quoted), f"({self._pattern})", "\\1 "))
        counts, first = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for mine, each, base in ((others, alone_counts, 0), (rows, pc.list_value_length(split).to_numpy().astype(np.int64), len(alone))):
            counts[mine] = each
            first[mine] = base + np.cumsum(each) - each
        pieces = pa.concat_arrays([alone, split.flatten()]).dictionary_encode()
        ids, n = self._encode_pieces(pieces.dictionary)
        each, begin = pieces.indices.to_numpy()[spread(first, counts)], np.cumsum(n) - n
        ids, bounds = ids[spread(begin[each], n[each])], np.concatenate(([0], np.cumsum(n[each])))[np.concatenate(([0], np.cumsum(counts)))]
        sizes = np.diff(bounds)
        marked = np.flatnonzero(pc.match_substring_regex(words, "^[\\x00\\x01]").to_numpy(zero_copy_only=False)).tolist()
        if marked:
            own = [self._encode_signs(words[i].as_py()) for i in marked]
            starts = bounds[:-1].copy()
            sizes[marked] = [len(x) for x in own]
            starts[marked] = len(ids) + np.cumsum(sizes[marked]) - sizes[marked]
            ids = np.concatenate([ids, *(np.array(x, np.int32) for x in own)])[spread(starts, sizes)]
        return ids, sizes

    def _encode_signs(self, word: str) -> list[int]:
        if word[0] == "\1":
            return [self.special[word[1:]]]
        signs = [self._sign_ids[c] for c in word[1:]]
        return self.encode_symbols([*(s[0] for s in signs[:-1]), signs[-1][1]])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word in the table of words, which learns those it lacks."""
        held = len(self.known)
        coded = pa.chunked_array([self.known, words]).dictionary_encode().chunks[-1]  # numbers go on from the table's own
        table, each = coded.dictionary, coded.indices.to_numpy()
        if held and len(table) > KEPT_WORDS:  # only the words at hand stay
            here = np.zeros(len(table), bool)
            here[each] = True
            kept, each = np.flatnonzero(here), (np.cumsum(here) - 1)[each]
            old, table = kept[kept < held], table.take(pa.array(kept))
            ids, sizes, held = self.ids[spread(self.starts[old], self.sizes[old])], self.sizes[old], len(old)
            self._forget()
            self._learn(table.slice(0, held), ids, sizes)
        if len(table) > held:
            self._learn(table, *self._encode_words(table.slice(held)))
        return each

    def _learn(self, table: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """``table`` becomes the table of words; ``ids`` and ``sizes`` are those of its last words, which are new."""
        count, need = len(table), self.used + len(ids)
        first = count - len(sizes)
        if need > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(2 * need - self.used, np.int32)))
        if count > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x[:first], np.zeros(2 * count - first, np.int64))) for x in (self.starts, self.sizes))
        self.ids[self.used : need], self.sizes[first:count] = ids, sizes
        self.starts[first:count] = self.used + np.cumsum(sizes) - sizes
        self.used, self.known = need, table

    def _chunks(self, text: str) -> list[str]:
        """What an odd text splits into: special tokens are found in the raw text, before lower case; other spellings are plain text."""
        if self._library is None:
            import tokenizers

            self._library = tokenizers.Tokenizer.from_str(self.source)
        out = []
        for i, part in enumerate(self._specials.split(text) if self._specials else [text]):
            if i % 2:
                out.append("\1" + part)
            else:
                out += ["\0" + w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(part)) if w]
        return out

    def _located(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of texts, one after the other, and the bounds of each text among them."""
        odd = pc.match_substring_regex(texts, self._odd)
        strange = odd.to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pc.invert(odd)) if strange.any() else texts))
        words, counts = split.flatten(), np.zeros(len(texts), np.int64)
        counts[~strange] = pc.list_value_length(split).to_numpy()
        if strange.any():
            own = [self._chunks(x) for x in texts.filter(odd).to_pylist()]
            counts[strange] = [len(x) for x in own]
            words = pa.concat_arrays([words, pa.array([w for x in own for w in x], pa.string())])
        each = self._numbers(words) if len(words) else np.zeros(0, np.int64)
        if strange.any():  # words of odd texts stand after all others: put them in order
            lead = np.empty(len(texts), np.int64)
            for rows, base in ((np.flatnonzero(~strange), 0), (np.flatnonzero(strange), int(counts[~strange].sum()))):
                lead[rows] = base + np.cumsum(counts[rows]) - counts[rows]
            each = each[spread(lead, counts)]
        return each, np.concatenate(([0], np.cumsum(counts)))

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and the bounds of each text among them."""
        each, bounds = self._located(texts)
        n = self.sizes[each]
        return self.ids[spread(self.starts[each], n)], np.concatenate(([0], np.cumsum(n)))[bounds]

    def _blocks(self, texts: pa.Array) -> Iterator[tuple[list[int], pa.Array]]:
        """Blocks of a column of texts: the rows and their texts. A row of several pieces occurs in several blocks."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = np.diff(_raw(texts)[1])
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(size[lo:]), BLOCK, side="right")) + lo)
            block = texts.slice(lo, hi - lo)
            if size[lo] <= BLOCK or pc.any(pc.match_substring_regex(block, self._odd)).as_py():
                yield list(range(lo, hi)), block
            else:
                raw, at = block[0].as_buffer().to_pybytes(), 0
                while at < len(raw):
                    gap = _GAP.search(raw, at + BLOCK)
                    end = gap.start() if gap else len(raw)
                    yield [lo], pa.array([raw[at:end].decode()])
                    at = end
            lo = hi

    def blocks(self, texts: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """The same with ids and their bounds in place of texts."""
        for rows, block in self._blocks(texts):
            yield rows, *self.encode_block(block)

    def counts(self, column: pa.Array) -> np.ndarray:
        """How many ids every text has; the ids themselves are not put together."""
        out = np.zeros(len(column), np.int64)
        for rows, block in self._blocks(column):
            each, bounds = self._located(block)
            out[rows] += np.diff(np.concatenate(([0], np.cumsum(self.sizes[each])))[bounds])
        return out

    def texts(self, column: pa.Array) -> Iterator[list[np.ndarray]]:
        """The ids of every text, as a list of pieces, in order."""
        row, held = -1, []
        for rows, ids, bounds in self.blocks(column):
            for j, r in enumerate(rows):
                if r != row and row >= 0:
                    yield held
                    held = []
                row = r
                held.append(ids[bounds[j] : bounds[j + 1]])
        if row >= 0:
            yield held

    def encode(self, text: str | None) -> list[int]:
        return np.concatenate(next(self.texts(pa.array([text], pa.string())))).tolist()

    def shown(self, ids: np.ndarray, by: pa.Array, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Entries of ``by`` for all ids, in one buffer, and the bounds in it of what lies between ``bounds``."""
        found = by.take(pa.array(ids))
        raw, offsets = _raw(found)
        return memoryview(raw), offsets[bounds]

    def decode(self, ids: list[int]) -> str:
        raw, ends = self.shown(np.array(ids, np.int32), self.token_text, np.array([0, len(ids)]))
        return bytes(raw[ends[0] : max(ends[0], ends[1] - 1)]).decode()


@lru_cache(maxsize=2)
def tokenizer(source: str) -> Tokenizer:
    return Tokenizer(source)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, an array of token ids (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(texts: pa.Array) -> pa.Array:
        each = [np.concatenate(x) for x in tokenizer(shared.value).texts(texts)]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int32), *each])))

    return map_rows(docs, F.make_valid_utf8("text"), run, "ids", ArrayType(IntegerType()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids`` (a column of that name is replaced)."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(ids: pa.Array) -> pa.Array:
        return pa.array([tokenizer(shared.value).decode(x or []) for x in ids.to_pylist()], pa.string())

    return map_rows(encoded, F.col("ids"), run, "decoded", StringType())


def digest(docs: DataFrame, path: str) -> DataFrame:
    """The columns of op4: ids of every text, and the text decoded from these ids, as digests."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(shared.value)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            sums = {}  # row to running digests of its ids and of its decoded text
            out = [[""] * batch.num_rows for _ in range(2)]
            for rows, ids, bounds in t.blocks(batch.column(1)):
                parts = [t.shown(ids, by, bounds) for by in (t.decimal, t.token_text)]
                for j, r in enumerate(rows):
                    more, sums = sums.get(r), {}
                    for k, (raw, ends) in enumerate(parts):
                        sha = more[k] if more else hashlib.sha256()
                        if ends[j + 1] > ends[j]:
                            if n[r]:
                                sha.update(b" ")
                            sha.update(raw[ends[j] : ends[j + 1] - 1])
                        sums.setdefault(r, []).append(sha)
                        out[k][r] = sha
                    n[r] += bounds[j + 1] - bounds[j]
            shown = [pa.array([x.hexdigest() for x in part], pa.string()) for part in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *shown], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.make_valid_utf8("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
