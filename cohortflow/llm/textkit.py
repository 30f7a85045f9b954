"""Array kernels over texts, for use inside tasks: words, word and shingle hashes, sub-word tokens.

Texts of a batch are laid end to end as code points and worked on in pieces of about 131,000 characters; a longer
text is a piece of its own. Hashes are 64-bit: a random polynomial over code points (or words), mixed.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 17
U = np.uint64
_BASE, _SEED = U(0x9E6C63D0876A9A47), U(0xD1B54A32D192ED03)
SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(texts: list, most: int = PIECE):
    """(from, to) index ranges of texts with about ``most`` characters in all."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def arrow_batch(schema: str, columns: list):
    """A record batch of the Spark ``schema`` from arrays or lists; ids stay Arrow arrays, so nulls and long ids survive."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    fields = pa.schema([pa.field(x.split(" ")[0], kinds[x.split(" ")[1]]) for x in schema.split(", ")])
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c if isinstance(c, np.ndarray) else list(c), f.type)
                                       for c, f in zip(columns, fields)], schema=fields)


def free_name(columns, name: str) -> str:
    """``name``, with underscores in front until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def source_array(rows: list):
    import pyarrow as pa

    return pa.array(rows, pa.int64())


class Piece:
    """Code points ``cp`` of some texts; ``offs[d] .. offs[d + 1]`` are those of text d."""

    def __init__(self, texts: list):
        self.n = len(texts)
        self.offs = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.offs[1:])
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)

    def docs_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1

    def lowered(self) -> "Piece":
        """A-Z become a-z; nothing else changes."""
        cp = self.cp
        self.cp = np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)
        return self

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the words ``[^\\x20\\x09-\\x0D]+``."""
        cp = self.cp
        inside = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
        first = np.zeros(len(cp) + 1, bool)
        first[self.offs] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | first[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:-1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return starts, ends, self.docs_of(starts)


class Hasher:
    """Hashes of many spans of one piece from one running sum; keeps the powers it needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.mixed = mix(np.arange(1 << 16, dtype=np.uint64) + _SEED)  # of the code points that nearly all texts have

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = U(pow(int(_BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(n - 1, inverse, np.uint64)]), dtype=np.uint64)

    def spans(self, cp: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        self._powers(len(cp) + 1)
        run = np.zeros(len(cp) + 1, np.uint64)
        one = self.mixed[cp] if len(cp) and cp.max() < len(self.mixed) else mix(cp.astype(np.uint64) + _SEED)
        np.cumsum(one * self.up[: len(cp)], dtype=np.uint64, out=run[1:])
        return mix((run[hi] - run[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def sequence_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on."""
    out = np.full(len(at), k, np.uint64)
    for j in range(k):
        out = mix(out * U(0xA24BAED4963EE407) + h[at + j])
    return out


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): k-word shingles of every text, with repeats; a text with 1 to k-1 words has its whole sequence."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    own = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(own)])
    out = np.zeros(bounds[-1], np.uint64)
    which = np.repeat(np.arange(n_docs), own)
    at = first[which] + np.arange(len(which)) - bounds[which]
    long = count[which] >= k
    out[long] = sequence_hash(h, at[long], k)
    for m in range(1, k):
        short = count[which] == m
        if short.any():
            out[short] = sequence_hash(h, at[short], m)
    return out, bounds


def distinct_shingles(texts: list, hasher: Hasher, k: int = SHINGLE):
    """Sorted distinct shingle hashes of each text, in order."""
    for lo, hi in pieces(texts):
        p = Piece(texts[lo:hi]).lowered()
        s, e, d = p.words()
        out, b = shingles(hasher.spans(p.cp, s, e), d, p.n, k)
        for i in range(p.n):
            yield np.unique(out[b[i]:b[i + 1]])


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[start : start + size]``."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class SpanTokens:
    """Sub-word ids of spans: each distinct span is encoded once and its ids are gathered; what is known is forgotten
    when it has ``most`` spans, so memory stays bounded."""

    def __init__(self, encode_all, most: int = 500_000):
        self.encode_all, self.most = encode_all, most  # list of strings -> list of id lists
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def table(self, p: Piece, hasher: Hasher, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The number of each span; its ids are ``ids[starts[number] : + sizes[number]]``."""
        if len(self.number) > self.most:
            self.forget()
        h, first, which = np.unique(hasher.spans(p.cp, lo, hi), return_index=True, return_inverse=True)
        known = np.array([self.number.get(x, -1) for x in h.tolist()], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            chars = p.cp.tobytes()
            at = first[new]
            coded = self.encode_all([chars[4 * a:4 * b].decode("utf-32-le") for a, b in zip(lo[at].tolist(), hi[at].tolist())])
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            known[new] = np.arange(len(self.number), len(self.number) + len(new))
            self.number.update(zip(h[new].tolist(), known[new].tolist()))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, np.fromiter((x for c in coded for x in c), np.int32, int(sizes.sum()))])
        return known[which]


# The pattern by which the byte-level vocabulary splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def char_classes(cp: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, as the pattern above sees them; ``low``: those of the first 256."""
    import regex

    low = np.array([_class(regex, c) for c in range(256)], np.int8) if low is None else low
    out = low[np.minimum(cp, 255)]
    rest = np.flatnonzero(cp > 255)
    if len(rest):
        found, which = np.unique(cp[rest], return_inverse=True)
        out[rest] = np.array([_class(regex, int(c)) for c in found], np.int8)[which]
    return out


def _class(regex, c: int) -> int:
    x = chr(c)
    return 0 if regex.match(r"\s", x) else 1 if regex.match(r"\p{L}", x) else 2 if regex.match(r"\p{N}", x) else 3


def split_spans(p: Piece, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pattern SPLIT in every text, without apostrophes (texts with one are split by the pattern itself)."""
    cp, n = p.cp, len(p.cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = char_classes(cp, low)
    first = np.zeros(n + 1, bool)
    first[p.offs] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | first[1:n]
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    blank = kind[run] == 0
    last = first[end]  # the run ends its text
    # White space before a word: all but the last character is a span; a last plain space joins the word.
    split = blank & ~last
    lead = split & (end - run > 1)
    joins = split & (cp[end - 1] == 32)
    starts = run.copy()
    starts[1:][joins[:-1]] -= 1  # the word takes the space
    body = ~split
    alone = split & ~joins
    lo = np.concatenate([starts[body], run[lead], end[alone] - 1])
    hi = np.concatenate([end[body], end[lead] - 1, end[alone]])
    order = np.argsort(lo, kind="stable")
    return lo[order], hi[order]


def byte_bpe(path: str):
    """Encoder of single spans by the byte-level vocabulary of the tokenizer file ``path`` (ids are ranks of its merges).

    The ids are those of the file's own library, which tests compare; spans alone are encoded faster this way.
    """
    import json

    import tiktoken

    # The byte-level alphabet writes printable bytes as themselves and the others as characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)
    special = {x["content"] for x in vocab.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab["model"]["vocab"].items() if token not in special}
    encode = tiktoken.Encoding("spans", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda spans: [encode(x) for x in spans]


def token_ids(texts: list, spans: SpanTokens, hasher: Hasher):
    """Ids of each text, equal to those of the tokenizer over the whole text. Yields one int32 array per text."""
    import regex

    pattern = regex.compile(SPLIT)
    low = np.array([_class(regex, c) for c in range(256)], np.int8)
    for lo, hi in pieces(texts):
        part = texts[lo:hi]
        p = Piece(part)
        a, b = split_spans(p, low)
        odd = [i for i, t in enumerate(part) if "'" in t]
        if odd:
            keep = ~np.isin(p.docs_of(a), odd)
            more = [(p.offs[i] + m.start(), p.offs[i] + m.end()) for i in odd for m in pattern.finditer(part[i])]
            extra = np.array(more, np.int64).reshape(-1, 2)
            a, b = np.concatenate([a[keep], extra[:, 0]]), np.concatenate([b[keep], extra[:, 1]])
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
        number = spans.table(p, hasher, a, b) if len(a) else a
        flat = ragged(spans.ids, spans.starts[number], spans.sizes[number])
        sizes = np.bincount(p.docs_of(a), weights=spans.sizes[number], minlength=p.n).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(p.n):
            yield flat[at[i]:at[i + 1]]


def added_tokens(path: str) -> dict[str, int]:
    """The tokenizer file's added tokens: strings that have an id of their own wherever they stand in a text."""
    import json

    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f).get("added_tokens", [])}


def ids_with_added(texts: list, spans: SpanTokens, hasher: Hasher, added: dict[str, int]):
    """:func:`token_ids`, with added tokens cut out first: the text between two of them is encoded by itself. Where added
    tokens overlap the leftmost counts, and of those the longest."""
    if not any(a in t for t in texts for a in added):
        yield from token_ids(texts, spans, hasher)
        return
    import regex

    pattern = regex.compile("(%s)" % "|".join(map(regex.escape, sorted(added, key=len, reverse=True))))
    parts = [pattern.split(t) for t in texts]  # every second one is an added token
    found = token_ids([x for p in parts for x in p[::2]], spans, hasher)
    for p in parts:
        yield np.concatenate([np.array([added[x]], np.int32) if i % 2 else next(found) for i, x in enumerate(p)])
