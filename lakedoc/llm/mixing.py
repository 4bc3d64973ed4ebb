"""Context mixing over binary decisions, vectorised over many texts.

A text is a sequence of tokens: words, then one end. The frequent words (the head of the
training vocabulary) and the end are symbols of a Huffman code; any other word is an
escape symbol followed by its bytes and a terminator in a second Huffman code. So every
text is a sequence of yes/no decisions, few for what is frequent.

Every decision, of tokens and of bytes, is predicted in context: predictors look up what
followed a hashed context. For tokens these are: nothing but the place in the tree, the token before, the two tokens before; for bytes:
the two bytes before, the four bytes before, the word so far. A predictor holds a logit
and how often its context was seen. The logits are added with weights that a gate selects:
how much the two longer contexts are trusted at this place. A table by mixed logit refines
the sum. Within a text the weights and the refinement follow the gradient of the coding cost
after the symbols that begin within 128 decisions, each time only from what has been coded
before, so the probabilities of all texts add up to one at most.

In a tree, four levels share one hash and lie side by side in a table, so that most lookups
find their neighbour's part of memory.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CONTEXTS = 3
GATES = 32  # trust in two contexts, tokens and bytes
DEEPEST = 64  # more decisions than any code has: all of them are predicted in context
STEP = 128  # decisions of a text between two moves of its weights and its refinement
TREE, _INSIDE = 4, 15  # levels of a tree whose nodes lie side by side in a table, bits for the place there
RUN = 4096  # symbols whose decisions are made at a time
MANY = 16384  # decisions of some steps that are made at a time
CELLS = 33  # of the refinement table, by mixed logit
LEVEL, _MIDDLE = 0.6, 15  # where weights are fitted: distance of the levels of a logit, the middle one
TOLD = 1 << 21  # cells of `tell`
RATE = 0.03
END_WORD = b"\n"  # stands for the end among words, none of which holds it


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths; every symbol counts once more than it was seen."""
    n = len(counts)
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, np.int64)
    for at in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = at
        heapq.heappush(heap, (a[0] + b[0], at))
    depth = np.zeros(2 * n - 1, np.int64)
    for at in range(2 * n - 3, -1, -1):
        depth[at] = depth[parent[at]] + 1
    return np.maximum(depth[:n], 1)


def code_paths(
    counts: np.ndarray, salt: int, deepest: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``sizes, nodes, bits, rest``: hashed tree nodes and outcomes of all symbols' paths, one
    after the other, to a depth; ``rest`` is the cost of what follows, from the counts. The last
    four bits of a node are its place among those that share its hash."""
    lengths = code_lengths(counts)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for at in order.tolist():  # canonical code: shorter ones first, counting up
        length = int(lengths[at])
        code <<= length - before
        codes[at] = code
        code, before = code + 1, length
    sizes = np.minimum(lengths, deepest)
    # below the depth, a symbol's share of what its subtree was seen
    top = (codes >> (lengths - sizes).astype(np.uint64)) | (
        np.uint64(1) << sizes.astype(np.uint64)
    )
    _, subtree = np.unique(top, return_inverse=True)
    weight = counts + 1.0
    rest = np.log(np.bincount(subtree, weight)[subtree]) - np.log(weight)
    owner = np.repeat(np.arange(len(lengths)), sizes)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = (lengths[owner] - k).astype(np.uint64)
    prefix = codes[owner] >> left
    node = (np.uint64(1) << k.astype(np.uint64)) | prefix
    bits = (codes[owner] >> (left - np.uint64(1))) & np.uint64(1)
    # the 15 nodes of four levels lie side by side: the hash is that of their root
    below = (k % TREE).astype(np.uint64)
    inside = (node & ((np.uint64(1) << below) - np.uint64(1))) + (np.uint64(1) << below) - np.uint64(1)
    mixed = ((node >> below) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    nodes = (mixed >> np.uint64(32)).astype(np.uint32) & ~np.uint32(_INSIDE) | inside.astype(np.uint32)
    return sizes, nodes, bits.astype(np.uint8), rest


class Code:
    """Symbols: ``words``, escape, end, then 256 bytes and the terminator."""

    def __init__(self, words: list[bytes], sizes, first, nodes, bits, rest):
        self.words, self.sizes, self.first, self.rest = words, sizes, first, rest
        self.nodes, self.bits, self.placed = nodes, bits, (0, nodes)
        self.head = pa.array(words, pa.binary())
        self.escape, self.end, self.byte = len(words), len(words) + 1, len(words) + 2

    @classmethod
    def build(cls, words: list[bytes], counts, escapes: int, ends: int, byte_counts) -> Code:
        tokens = np.array([*counts, escapes, ends], np.int64)
        letters = np.append(byte_counts, escapes).astype(np.int64)
        paths = [code_paths(tokens, 1, DEEPEST), code_paths(letters, 1 << 40, DEEPEST)]
        sizes, nodes, bits, rest = (np.concatenate(part) for part in zip(*paths))
        first = (np.cumsum(sizes) - sizes).astype(np.int32)
        return cls(words, sizes.astype(np.int32), first, nodes, bits, rest)

    def find(self, words: pa.Array) -> np.ndarray:
        """Symbols of words of the head, -1 for any other word."""
        return pc.index_in(words, value_set=self.head).fill_null(-1).to_numpy()

    def decisions(self, symbols: np.ndarray, contexts, bits: int):
        """Of each symbol's decisions: how many, outcomes, and per context the slots in a table
        of 2**bits; ``contexts`` has a hash for each symbol."""
        sizes, first = self.sizes[symbols].astype(np.int64), self.first[symbols]
        ends = np.cumsum(sizes)
        at = np.repeat(first - (ends - sizes), sizes)
        at += np.arange(len(at))
        nodes, slots = self._side_by_side(bits).take(at, mode="clip"), []
        outcome = nodes & np.uint32(1)
        for hashes in contexts:  # spread already, as the nodes are
            mixed = np.repeat(hashes, sizes)
            mixed += nodes
            mixed >>= np.uint32(32 - bits)
            slots.append(mixed.astype(np.int64))  # what takes and additions index by
        return sizes, outcome, slots

    def _side_by_side(self, bits: int) -> np.ndarray:
        """The nodes, those that share a hash at neighbouring slots of a table of 2**bits. The
        last bit is the outcome; as hashes of contexts are even, no slot depends on it."""
        if self.placed[0] != bits:
            inside = self.nodes & np.uint32(_INSIDE)
            placed = (self.nodes - inside) + (inside << np.uint32(32 - bits))
            self.placed = bits, placed & ~np.uint32(1) | self.bits
        return self.placed[1]

    def parts(self) -> tuple:
        """What a worker needs to build it again: plain data."""
        arrays = (self.sizes, self.first, self.nodes, self.bits, self.rest)
        return b"\n".join(self.words), len(self.words), *arrays

    @classmethod
    def from_parts(cls, joined: bytes, n: int, *arrays) -> Code:
        return cls(joined.split(b"\n") if n else [], *arrays)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, A-Z in lower case, parted at the six ASCII spaces; how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
    there = pc.greater(pc.binary_length(words), 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sizes = np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(sizes))
    return words.filter(there).cast(pa.binary()), sizes


def trigrams(known: np.ndarray, sizes: np.ndarray, code: Code):
    """Of each token of texts with ``sizes`` words, and of their ends: two before, one before,
    and itself. A text begins after an end."""
    ends = np.cumsum(sizes + 1) - 1
    tokens = np.full(len(known) + len(sizes), code.end, np.int64)
    is_word = np.ones(len(tokens), bool)
    is_word[ends] = False
    tokens[is_word] = np.where(known < 0, code.escape, known)
    one, two = np.empty_like(tokens), np.empty_like(tokens)
    one[1:] = tokens[:-1]
    one[ends - sizes] = code.end
    two[1:] = one[:-1]
    two[ends - sizes] = code.end
    return two, one, tokens


def spelling(rare: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, each with a terminator, as letters; and how many each word has."""
    lengths = pc.binary_length(rare).to_numpy().astype(np.int64) + 1
    joined = pc.binary_join_element_wise(rare, pa.scalar(b"", pa.binary()), pa.scalar(b"\n", pa.binary()))
    start = int(np.frombuffer(joined.buffers()[1], np.int32, joined.offset + 1)[-1]) if len(rare) else 0
    raw = np.frombuffer(joined.buffers()[2] or b"", np.uint8) if len(rare) else np.empty(0, np.uint8)
    return raw[start : start + int(lengths.sum())], lengths


class Block:
    """Texts (lists of words) as symbols, with the contexts of each."""

    def __init__(self, texts: list[list[bytes]], code: Code):
        words = pa.array(list(chain.from_iterable(texts)), pa.binary())
        self._fill(words, code.find(words), np.fromiter(map(len, texts), np.int64, len(texts)), code)

    @classmethod
    def of(cls, words: pa.Array, known: np.ndarray, sizes: np.ndarray, code: Code) -> Block:
        """A block of texts whose words, one text after the other, are split and found already."""
        made = cls.__new__(cls)
        made._fill(words, known, sizes, code)
        return made

    def _fill(self, words: pa.Array, known: np.ndarray, sizes: np.ndarray, code: Code) -> None:
        self.n_texts, self.known = len(sizes), known
        two, one, tokens = trigrams(known, sizes, code)
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        self.rare = words.filter(pa.array(known < 0))
        spelt, lengths = spelling(self.rare)
        # a token takes one symbol, an escape those of its word as well
        escaped = tokens == code.escape
        self.escaped_text = text[escaped]
        widths = np.ones(len(tokens), np.int64)
        widths[escaped] += lengths
        starts = np.cumsum(widths) - widths
        total = int(widths.sum())
        self.spelt = np.ones(total, bool)
        self.spelt[starts] = False
        within = np.flatnonzero(self.spelt)
        self.symbols = np.empty(total, np.int64)
        self.symbols[starts] = tokens
        self.symbols[within] = letters(spelt, code)
        self.text = np.repeat(text, widths)
        self.contexts = []
        for a, b in zip(token_contexts(two, one), letter_contexts(spelt, lengths)):
            both = np.empty(total, np.uint32)
            both[starts], both[within] = a, b
            self.contexts.append(both)

    def decisions(self, code: Code, bits: int):
        """Slot of each context in a table of 2**bits, outcome, and symbol, per decision."""
        sizes, outcome, slots = code.decisions(self.symbols, self.contexts, bits)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return slots, outcome.astype(np.uint8), owner


def _by_step(block: Block, code: Code):
    """Symbols by the step of their text that their first decision falls into, then by text;
    symbols and decisions of each step, and decisions of each text."""
    sizes = code.sizes[block.symbols].astype(np.int64)
    of_text = np.bincount(block.text, sizes, block.n_texts).astype(np.int64)
    step = (np.cumsum(sizes) - sizes - (np.cumsum(of_text) - of_text)[block.text]) // STEP
    decided = np.bincount(step, sizes).astype(np.int64)
    short = step.astype(np.uint16) if len(decided) <= 1 << 16 else step  # sorted by radix
    return np.argsort(short, kind="stable"), np.bincount(step), decided, of_text


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the hash, in place; the last one is 0."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        hashes ^= hashes >> np.uint32(shift)
        hashes *= np.uint32(factor)
    hashes ^= hashes >> np.uint32(16)
    hashes &= ~np.uint32(1)
    return hashes


def token_contexts(two: np.ndarray, one: np.ndarray) -> list[np.ndarray]:
    """Nothing, the token before, and the two tokens before each token."""
    near = (one.astype(np.uint32) + np.uint32(1)) * np.uint32(0x2545F491)
    far = (two.astype(np.uint32) + np.uint32(7)) * np.uint32(0x2C1B3C6D) ^ near
    return [np.zeros(len(one), np.uint32), _spread(near), _spread(far ^ (far >> np.uint32(15)))]


def letters(raw: np.ndarray, code: Code) -> np.ndarray:
    """Symbols of the bytes of words, which hold no newline but as terminator."""
    return code.byte + np.where(raw == 10, 256, raw.astype(np.int64))


def letter_contexts(raw: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Two bytes, four bytes, and all bytes before each byte, within its word."""
    n = len(raw)
    if n == 0:
        return [np.empty(0, np.uint32)] * 3
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = np.arange(n) - begin
    wide = raw.astype(np.uint32)

    def back(k: int) -> np.ndarray:
        out = np.zeros(n, np.uint32)
        out[k:] = wide[:-k] + np.uint32(1) if n > k else 0
        out[inside < k] = 0
        return out

    two = back(1) * np.uint32(263) + back(2)
    four = (two * np.uint32(263) + back(3)) * np.uint32(263) + back(4)
    # from sums with growing powers of an odd number, taken back to the word's begin
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(n, _ODD), out=sums[1:])
    word = (sums[:-1] - sums[begin]) * _powers(n, _ODD_INVERSE)[begin]
    word = ((word ^ (word >> np.uint64(31))) >> np.uint64(7)).astype(np.uint32)
    two = (two + np.uint32(3)) * np.uint32(0x2545F491)
    four = (four ^ (four >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return [_spread(two), _spread(four), _spread(word)]


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def _runs(n: int):
    """Slices of symbols; the decisions of one fit a processor's cache."""
    return (slice(at, at + RUN) for at in range(0, n, RUN))


def _add(symbols, hashes, times, code: Code, bits: int, pair: np.ndarray) -> None:
    """Add the outcomes of symbols in a context, met some ``times``, to the pairs of its table.

    In the order of their hashes they meet a table's memory in a few ascending rows."""
    for part in _runs(len(symbols)):
        sizes, outcome, (slot,) = code.decisions(symbols[part], [hashes[part]], bits)
        much = np.repeat(times[part], sizes)
        much <<= outcome.astype(np.int64) << 5  # no in the lower half, yes in the upper
        np.add.at(pair, slot, much)


def _met(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that differ, ascending, and how often each is there; sorts them in place."""
    keys.sort()
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
    return keys[new], np.diff(np.append(new, len(keys)))


def _add_once(symbols, hashes, code: Code, bits: int, pair: np.ndarray) -> None:
    """As `_add`; a symbol that follows a context several times is added once, that many times."""
    keys = hashes.astype(np.int64) << 32
    keys |= symbols
    keys, times = _met(keys)
    hashes = (keys >> 32).astype(np.uint32)
    keys &= 0xFFFFFFFF
    _add(keys, hashes, times, code, bits, pair)


def count(block: Block, code: Code, bits: int, into: np.ndarray) -> None:
    """Add the outcomes to ``into[context, 2 * slot + outcome]``."""
    for pair, hashes in zip(into.view(np.int64), block.contexts):
        _add_once(block.symbols, hashes, code, bits, pair)


def count_trigrams(two, one, symbols, code: Code, bits: int, into: np.ndarray) -> None:
    """As `count` for the contexts of tokens that `trigrams` lists. What follows no context is
    left to `count_words`."""
    pairs = into.view(np.int64)
    for pair, hashes in list(zip(pairs, token_contexts(two, one)))[1:]:
        _add_once(symbols, hashes, code, bits, pair)


def count_words(words: pa.Array, times: np.ndarray, code: Code, bits: int, into: np.ndarray) -> None:
    """As `count` for all that depends on a word alone, met some ``times``: its symbol after no
    context, and its spelling if it is not of the head. `END_WORD` is the end."""
    symbols = _symbols(words, code)
    pairs = into.view(np.int64)
    _add(symbols, np.zeros(len(words), np.uint32), times, code, bits, pairs[0])
    spelt, contexts, times = _spellings(words, symbols, times, code)
    for at in range(0, len(spelt), _TOGETHER):
        part = slice(at, at + _TOGETHER)
        for pair, hashes in zip(pairs, contexts):
            _add_letters(spelt[part], hashes[part], times[part], code, bits, pair)


_TOGETHER = 1 << 22  # letters that are sorted together


def _add_letters(symbols, hashes, times, code: Code, bits: int, pair: np.ndarray) -> None:
    """As `_add`, for letters; equal ones after equal contexts are added up before."""
    keys = hashes.astype(np.uint64) << np.uint64(32)  # hash, letter (9 bits), place (22 bits)
    keys |= (symbols - code.byte).astype(np.uint64) << np.uint64(22)
    keys |= np.arange(len(keys), dtype=np.uint64)
    keys.sort()
    order = (keys & np.uint64(_TOGETHER - 1)).astype(np.int64)
    keys >>= np.uint64(22)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    first = order[new]
    _add(symbols[first], hashes[first], np.add.reduceat(times[order], new), code, bits, pair)


def distinct(two: np.ndarray, one: np.ndarray, symbols: np.ndarray, code: Code):
    """Trigrams that differ, and how often each was met."""
    width = int(code.end).bit_length()
    if 3 * width > 63:  # too many symbols for one key: each stands for itself
        return two, one, symbols, np.ones(len(symbols), np.int64)
    keys = one.astype(np.int64) << width
    keys |= two
    keys <<= width
    keys |= symbols
    keys, times = _met(keys)
    last = (1 << width) - 1
    return keys >> width & last, keys >> 2 * width, keys & last, times


def _symbols(words: pa.Array, code: Code) -> np.ndarray:
    known = code.find(words).astype(np.int64)
    known[known < 0] = code.escape
    known[pc.equal(words, END_WORD).to_numpy(zero_copy_only=False)] = code.end
    return known


def _spellings(words: pa.Array, symbols: np.ndarray, times: np.ndarray, code: Code):
    """Letters of the words that are spelt, their contexts, and how often each was met."""
    spelt = (symbols == code.escape) & (times > 0)
    raw, lengths = spelling(words.filter(pa.array(spelt)))
    return letters(raw, code), letter_contexts(raw, lengths), np.repeat(times[spelt], lengths)


def opinions(tables: np.ndarray) -> np.ndarray:
    """Per slot of `predictors` the level of its logit (five bits) and the trust in it (two)."""
    packed = np.arange(-(1 << 15), 1 << 15)
    level = np.clip(np.rint((packed >> 2) / (512 * LEVEL)), -_MIDDLE, _MIDDLE) + _MIDDLE
    known = (level.astype(np.int64) << 2 | packed & 3).astype(np.uint8)
    return known.take(tables.astype(np.int64) + (1 << 15))


def tell(block: Block, code: Code, said: np.ndarray, bits: int, into: np.ndarray) -> None:
    """Count the decisions of a block in ``into[told]``: by kind (token, byte), outcome, the
    level of the first context and the opinions of both others."""
    times = np.ones(len(block.symbols), np.int64)
    _tell(block.symbols, block.contexts, block.spelt, times, code, said, bits, into)


def tell_trigrams(two, one, symbols, times, code: Code, said, bits: int, into: np.ndarray) -> None:
    """As `tell` for tokens that `trigrams` lists, met some ``times``."""
    contexts = token_contexts(two, one)
    _tell(symbols, contexts, np.zeros(len(symbols), bool), times, code, said, bits, into)


def tell_words(words: pa.Array, times, code: Code, said, bits: int, into: np.ndarray) -> None:
    """As `tell` for the spelling of words outside the head, met some ``times``."""
    spelt, contexts, times = _spellings(words, _symbols(words, code), times, code)
    _tell(spelt, contexts, np.ones(len(spelt), bool), times, code, said, bits, into)


def _tell(symbols, contexts, spelt, times, code: Code, said, bits: int, into: np.ndarray) -> None:
    for part in _runs(len(symbols)):
        sizes, outcome, slots = code.decisions(symbols[part], [c[part] for c in contexts], bits)
        at = np.repeat(spelt[part].astype(np.int64) << 1, sizes)
        at |= outcome
        for width, known, slot in zip((5, 7, 7), said, slots):
            at <<= width
            opinion = known.take(slot, mode="clip")
            at |= opinion >> 2 if width == 5 else opinion
        np.add.at(into, at, np.repeat(times[part], sizes))


def predictors(counts: np.ndarray) -> np.ndarray:
    """Per slot a signed 16-bit number: the logit in 1/512, and in the last two bits how
    often the context was seen (never, up to 3, up to 30, more)."""
    zero, one = counts[..., 0::2].astype(np.float32), counts[..., 1::2].astype(np.float32)
    seen = zero + one
    logit = np.log((one + 0.2) / (zero + 0.2))
    trust = (seen > 0).astype(np.int16) + (seen > 3) + (seen > 30)
    packed = np.clip(np.rint(logit * 512), -8191, 8191).astype(np.int16)
    return (packed << 2) | trust.astype(np.int16)


def initial_weights() -> np.ndarray:
    """Per gate a weight for each context; more for longer ones that were seen often."""
    out = np.zeros((GATES, CONTEXTS), np.float32)
    for gate in range(GATES):
        share = (0.05, 0.45, 0.8, 1.0) if gate & 16 else (0.0, 0.05, 0.2, 0.6)
        middle, longest = share[gate >> 2 & 3], share[gate & 3]
        both = max(middle + longest, 1e-6)
        strength = min(1.0, both)
        own = 1.0 - (0.8 if gate & 16 else 0.9) * strength
        out[gate] = (own, 0.9 * strength * middle / both, 0.9 * strength * longest / both)
    return out


def cost(
    block: Block,
    code: Code,
    tables: np.ndarray,
    bits: int,
    start: np.ndarray,
    rate: float = RATE,
    refine: np.ndarray | None = None,
) -> np.ndarray:
    """Coding cost (natural logarithm) of each text of the block.

    It is quickest for texts of like lengths, the longest first: a step then has many of them.
    """
    n_texts = block.n_texts
    total = np.bincount(block.text, code.rest[block.symbols], n_texts)
    order, n_symbols, decided, of_text = _by_step(block, code)
    symbols, contexts = block.symbols[order], [hashes[order] for hashes in block.contexts]
    # the row of the text's own weights and of its refinement, which a step reads and moves;
    # the longest texts first, so that those which are left have the first rows
    rank = np.empty(n_texts, np.int64)
    rank[np.argsort(-of_text, kind="stable")] = np.arange(n_texts)
    kinds = (2 * rank[block.text] + block.spelt)[order]
    # the predictors' numbers stay as they are, and the weights are for them
    unit = np.float32(1 / 512)
    weights = [np.tile(start[:, k] * unit, n_texts) for k in range(CONTEXTS)]
    shift = np.tile(refinement() if refine is None else refine, n_texts)
    pace = rate / np.sqrt(np.maximum(np.arange(STEP + DEEPEST + 1), 1))
    pace_of_weights = pace * float(unit) ** 2
    spent = np.zeros(2 * n_texts)
    symbols_to, last = np.append(0, np.cumsum(n_symbols)), len(decided)
    step = 0
    while step < last:
        done = step  # some steps whose decisions are made at a time
        ends = [0]
        while step < last and (step == done or ends[-1] + decided[step] <= MANY):
            ends.append(ends[-1] + int(decided[step]))
            step += 1
        part = slice(symbols_to[done], symbols_to[step])
        sizes, outcome, slots = code.decisions(symbols[part], [c[part] for c in contexts], bits)
        flips = outcome.astype(np.float32)
        flips *= np.float32(-2)
        flips += np.float32(1)
        packed = [table.take(slot, mode="clip") for table, slot in zip(tables, slots)]
        kind = np.repeat(kinds[part], sizes)
        gates = (packed[1] & 3) << 2
        gates |= packed[2] & 3
        gates = gates + (kind << 4)
        kind *= CELLS
        logits = [(p >> 2).astype(np.float32) for p in packed]
        for low, high in zip(ends, ends[1:]):
            here = slice(low, high)
            own, flip = gates[here], flips[here]
            parts = [logit[here] for logit in logits]
            z = weights[0].take(own, mode="clip")
            z *= parts[0]
            for k in range(1, CONTEXTS):
                more = weights[k].take(own, mode="clip")
                more *= parts[k]
                z += more
            bucket = cells(z)
            bucket += kind[here]
            z += shift.take(bucket, mode="clip")
            z *= flip
            np.minimum(z, 30, out=z)
            np.exp(z, out=z)
            one = z + np.float32(1)
            z /= one  # the cost by the sum of logits
            z *= flip
            flip[:] = one  # which is needed no more
            _move(shift, bucket, z, pace.take(np.bincount(bucket)))
            speed = pace_of_weights.take(np.bincount(own))
            for weight, logit in zip(weights, parts):
                logit *= z
                _move(weight, own, logit, speed)
        first = np.cumsum(sizes) - sizes
        by = np.bincount(kinds[part], np.add.reduceat(np.log(flips), first))
        spent[: len(by)] += by
    return total + (spent[0::2] + spent[1::2])[rank]


def _move(of: np.ndarray, rows: np.ndarray, slopes: np.ndarray, speed: np.ndarray):
    """Move the rows against their slopes, each at its speed."""
    by = np.bincount(rows, slopes)
    by *= speed
    of[: len(by)] -= by


def cells(z: np.ndarray) -> np.ndarray:
    """Cell of the refinement table for each mixed logit."""
    at = z * np.float32(1.5)
    at += np.float32(CELLS // 2 + 0.5)
    np.clip(at, 0, CELLS - 1, out=at)
    return at.astype(np.int64)


def refinement() -> np.ndarray:
    """What is added to a mixed logit: per kind (token, byte) and cell; at first nothing."""
    return np.zeros(2 * CELLS, np.float32)


def fit_refinement(
    block: Block, code: Code, tables: np.ndarray, bits: int, weights: np.ndarray, rounds: int = 8
) -> np.ndarray:
    """The refinement table from texts that the tables have not seen, after the weights."""
    slots, outcome, owner = block.decisions(code, bits)
    packed = [tables[k].take(slot, mode="clip") for k, slot in enumerate(slots)]
    spelt = block.spelt[owner]
    gate = ((packed[1] & 3) << 2 | (packed[2] & 3)).astype(np.int64) + 16 * spelt
    z = sum((p >> 2) / 512 * weights[gate, k] for k, p in enumerate(packed))
    return _refined(z, spelt, outcome, np.ones(len(z)), rounds)


def _refined(z, spelt, ones, times, rounds: int = 8) -> np.ndarray:
    """Refinement of logits that were met some ``times`` and were right in ``ones`` of them."""
    cell = cells(z) + spelt * CELLS
    shift = np.zeros(2 * CELLS)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z + shift[cell], -30, 30)))
        slope = np.bincount(cell, p * times - ones, 2 * CELLS) + 10.0 * shift
        curve = np.bincount(cell, p * (1 - p) * times, 2 * CELLS) + 10.0
        shift -= np.clip(slope / curve, -1, 1)
    return shift.astype(np.float32)


def fit(
    told: np.ndarray, times: np.ndarray, start: np.ndarray, rounds: int = 12
) -> tuple[np.ndarray, np.ndarray]:
    """Weights of every gate, and the refinement, from cells of `tell` and how often they were met.

    Per gate this is a logistic regression, solved by Newton steps; a small penalty holds it
    near ``start``.
    """
    spelt, outcome = told >> 20, (told >> 19 & 1).astype(np.float64)
    gate = spelt << 4 | (told >> 7 & 3) << 2 | told & 3
    levels = np.stack([told >> 14 & 31, told >> 9 & 31, told >> 2 & 31], 1)
    x, weights = (levels - _MIDDLE) * LEVEL, start.astype(np.float64)
    for g in range(GATES):
        some = gate == g
        features, n, yes, w = x[some], times[some], (outcome * times)[some], weights[g].copy()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
            slope = features.T @ (p * n - yes) + 10.0 * (w - start[g])
            curve = (features * (n * (p * (1 - p) + 1e-6))[:, None]).T @ features
            step = np.clip(np.linalg.solve(curve + 10.0 * np.eye(CONTEXTS), slope), -1, 1)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
        weights[g] = w
    z = (x * weights[gate]).sum(1)
    return weights.astype(np.float32), _refined(z, spelt, outcome * times, times)
