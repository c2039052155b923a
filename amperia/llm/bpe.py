"""BPE encoding and decoding of whole texts with a public tokenizer file.

Encoding is one streaming transducer from characters to ids. Text is read in blocks of about BLOCK characters, cut where neither composition of characters nor an added token can reach across. What the file asks for is done as the tokenizers library does it: added tokens split the raw text, then NFC, white space, lower case, splitting into pieces, byte symbols, merges with an end-of-word suffix. A piece goes on over as many blocks as it needs. Its symbols are read into a buffer of bounded length: the merge list gives a sufficient lookahead, how far to the right of a boundary a symbol can still change it, and a token leaves as soon as the buffer reaches further than that behind it. So memory grows with neither piece nor text. Ids of short pieces and of short runs between white space are remembered in tables of bounded size, which a worker empties after each partition.

Decoding is a state machine fed with tokens: text leaves as soon as it is certain. With a byte decoder that is when the bytes end a character; without a decoder, as in the default file, tokens are joined by a space, and byte symbols and suffixes stay as they are, as in the library's result.

Letters and numbers are those of Unicode 16: Python 3.13's tables and NEW_LETTERS, NEW_NUMBERS. For every code point ids are equal to the library's. Combining marks that the library's tables give no class (NO_CLASS) stay where they are and nothing is composed across them, as there. Sequences of more marks than a block holds are read whole.

A null text is empty: no tokens, empty text. Rows that repeat are encoded each; a null doc_id stays. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of a table of what was encoded, in a worker: two tables of two generations of this size at most, about 300 bytes an entry.
REMEMBERED, LONGEST_REMEMBERED = 60_000, 48
#: Symbols read beyond the lookahead before tokens are emitted.
STRIDE = 1024
#: Symbols up to which the lowest rank is looked for by a scan.
SHORT = 24
#: Characters of a block; of a piece that is not finished at a block's end and waits for more before it is known how it begins.
BLOCK, BEGINNING = 1 << 16, 16
#: Ids that are decoded and digested at once.
TOGETHER = 1 << 14
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


# Letters and numbers of Unicode 16, and lower case of Unicode 17, that Python 3.13's tables (15.1) lack and the library's have.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# Combining marks to which the library's composition gives no class, so that nothing is moved or joined across them; U+11930, which it joins to nothing.
NO_CLASS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
UNMOVED = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NO_CLASS) + "])")
#: First and last capital, and the first one's small letter.
NEW_LOWER = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
TO_LOWER = {a + k: chr(low + k) for a, b, low in NEW_LOWER for k in range(b - a + 1)}
NEW_CAPITALS = "".join(map(chr, TO_LOWER))
#: White space for str.split(), but not here.
ODD = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int | None:
    """Symbols to the right of a boundary that can decide whether a merge crosses it. None if a merge uses a token that a later one makes.

    Merge (x, y) depends on what becomes of y: on merges of lower rank that take y, or a token at y's right end while y was being made, as their left part, and so on to the right. Following these chains in rank order sums the lengths.
    """
    ends: dict[str, set[str]] = {}  # tokens that are at some time the right end of a token in the making
    best: dict[str, int] = {}  # by left part: the furthest that its merges so far look
    made: set[str] = set()
    most = 0
    for x, y in merges:
        for part in (x, y):
            if part not in made and length[part] > 1:
                return None
        reach = length[y] + max((best.get(s, 0) for s in ends.get(y, {y}) | {y}), default=0)
        best[x] = max(best.get(x, 0), reach)
        most = max(most, reach)
        made.add(x + y)
        ends.setdefault(x + y, {x + y}).update(ends.get(y, {y}))
    return most


class Transducer:
    """Symbols in, token ids out."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], suffix: str) -> None:
        self.vocab = vocab
        length = {t: len(t.removesuffix(suffix)) if suffix else len(t) for t in chain(*merges)}
        self.length = lambda t: max(1, len(t.removesuffix(suffix)) if suffix else len(t))
        self.never = len(merges)
        self.lookahead = lookahead(merges, length)
        #: Ranks by left and right id; by rank the id that is made; by id the symbols that a token covers.
        nothing: dict[int, int] = {}
        self.rank = [nothing] * (max(vocab.values(), default=-1) + 1)
        for k, (x, y) in enumerate(merges):
            if self.rank[vocab[x]] is nothing:
                self.rank[vocab[x]] = {}
            self.rank[vocab[x]][vocab[y]] = k
        self.made = [vocab[x + y] for x, y in merges]
        self.covers = [1] * len(self.rank)
        for t, i in vocab.items():
            self.covers[i] = self.length(t)

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges of a bounded buffer of ids, lowest rank first, leftmost first."""
        if len(symbols) > SHORT:
            return self._merged_by_heap(symbols)
        s, rank, made, never = list(symbols), self.rank, self.made, self.never
        ranks = [rank[x].get(y, never) for x, y in pairwise(s)]
        while ranks and (r := min(ranks)) != never:
            i = ranks.index(r)
            s[i] = t = made[r]
            del s[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank[t].get(s[i + 1], never)
            if i:
                ranks[i - 1] = rank[s[i - 1]].get(t, never)
        return s

    def _merged_by_heap(self, symbols: list[int]) -> list[int]:
        """The same in n log n steps."""
        s: list[int | None] = list(symbols)
        rank, made, n = self.rank, self.made, len(s)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (x, y) in enumerate(pairwise(s)) if (r := rank[x].get(y)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if s[i] is None or (j := right[i]) >= n or rank[s[i]].get(s[j]) != r:
                continue  # what stood here has been merged meanwhile
            s[i] = t = made[r]
            s[j] = None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank[t].get(s[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := left[i]) >= 0 and (r := rank[s[h]].get(t)) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in s if x is not None]

    def run(self, symbols: Iterable[str]) -> Iterator[int]:
        symbols, buffer = map(self.vocab.__getitem__, symbols), []
        full = None if self.lookahead is None else self.lookahead + STRIDE
        while True:
            buffer += symbols if full is None else islice(symbols, full - len(buffer))
            if full is None or len(buffer) < full:
                break
            out = 0
            for t in self.merged(buffer):
                if out + self.covers[t] + self.lookahead > len(buffer):
                    break
                out += self.covers[t]
                yield t
            del buffer[:out]
        yield from self.merged(buffer)


class Decoder:
    """Tokens in, text out as soon as it is certain."""

    def __init__(self, kind: str | None) -> None:
        self.bytewise, self.first = kind == "ByteLevel", True
        self.byte = {c: b for b, c in enumerate(byte_symbols())} if self.bytewise else {}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, tokens: list[str]) -> str:
        """What becomes certain with the next tokens."""
        if self.bytewise:
            return self.utf8.decode(bytes(self.byte[c] for t in tokens for c in t))
        out = " ".join(tokens)
        if tokens and not self.first:
            out = " " + out
        self.first &= not tokens
        return out

    def finish(self) -> str:
        return self.utf8.decode(b"", True) if self.bytewise else ""


class Remembered:
    """A bounded table of results: what was not asked for while the table filled again is forgotten."""

    def __init__(self) -> None:
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def keep(self, key: str, make: Callable[[str], tuple[int, ...]]) -> tuple[int, ...]:
        ids = self.old.pop(key, None)
        if ids is None:
            ids = make(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[key] = ids
        return ids

    def clear(self) -> None:
        self.young, self.old = {}, {}


def classes() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of letters and of numbers, from Python's Unicode tables and what they lack."""
    out = {"L": [], "N": []}
    for k in range(sys.maxunicode + 1):
        kind = out.get(unicodedata.category(chr(k))[0])
        if kind is None:
            continue
        if kind and kind[-1][1] == k - 1:
            kind[-1][1] = k
        else:
            kind.append([k, k])
    return [(a, b) for a, b in (*out["L"], *NEW_LETTERS)], [(a, b) for a, b in (*out["N"], *NEW_NUMBERS)]


def in_class(ranges: list[tuple[int, int]], last: int = sys.maxunicode) -> str:
    """Ranges, as far as they begin up to a code point, inside a character class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges if a <= last)


def split_to_pieces(letters: str, numbers: str) -> re.Pattern:
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}{SPACE}]+")


def starts_anew(c: str) -> bool:
    """Whether composition never joins a character to what stands before it: no mark, no vowel or final of Hangul."""
    return c < "\u0300" or not (unicodedata.category(c)[0] == "M" or unicodedata.combining(c) or "\u1160" <= c <= "\u11ff" or "\ud7b0" <= c <= "\ud7ff")


class Codec:
    """A tokenizer file of word BPE: ids(text) gives ids, text(ids) text, both as streams."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.longest_added = max(map(len, self.added), default=0)
        self.decoder = (spec["decoder"] or {}).get("type")
        self.token = {i: t for t, i in (model["vocab"] | self.added).items()}
        self.machine = Transducer([tuple(m) for m in model["merges"]], model["vocab"], self.suffix)
        self.symbols = dict(enumerate(byte_symbols()))
        self.splits = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        ranges = classes()
        letters, numbers = map(in_class, ranges)
        self.space = re.compile(f"[{SPACE}]+")
        self.pieces = split_to_pieces(letters, numbers)
        #: The same for text within 16 bits: Python tries ranges beyond these one after another, for each character that is in none.
        self.near_pieces, self.far = split_to_pieces(*(in_class(x, 0xFFFF) for x in ranges)), re.compile("[\U00010000-\U0010ffff]")
        self.letters, self.signs = re.compile(f"[{letters}]*"), re.compile(f"[^{letters}{numbers}{SPACE}]*")
        self.number = re.compile(f"[{numbers}]")
        self.seen, self.known = Remembered(), Remembered()
        #: By id: as decimal number and as token.
        self.decimal = [str(i) for i in range(max(self.token) + 1)]
        self.shown = [self.token.get(i, "") for i in range(max(self.token) + 1)]

    def bytes_of(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.symbols)

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that is there as a whole."""
        raw = self.bytes_of(piece)
        symbols = [*raw[:-1], raw[-1] + self.suffix]
        if len(symbols) <= SHORT:
            return tuple(self.machine.merged(list(map(self.machine.vocab.__getitem__, symbols))))
        return tuple(self.machine.run(symbols))

    def chunk(self, low: str) -> tuple[int, ...]:
        """Ids of normal text without white space that is there as a whole."""
        known, out = self.known, []
        pieces = self.near_pieces if low.isascii() or not self.far.search(low) else self.pieces
        for p in pieces.findall(low):
            ids = known.young.get(p)
            out.append(known.keep(p, self.piece) if ids is None else ids)
        return out[0] if len(out) == 1 else tuple(chain.from_iterable(out))

    def normal(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):  # what is normal with all classes is so without some
                text = "".join(unicodedata.normalize("NFC", x) for x in UNMOVED.split(text))
            text = text.replace("Σ", "σ")  # letter by letter: no final sigma
            text = text.translate(TO_LOWER) if any(map(text.__contains__, NEW_CAPITALS)) else text
        return text.lower()

    def blocks(self, text: str) -> Iterator[str]:
        """Text without added tokens in parts, cut where composition does not reach across."""
        at = 0
        while len(text) - at > BLOCK:
            end = at + BLOCK
            while end > at + 1 and not starts_anew(text[end]):
                end -= 1
            if end == at + 1:  # marks all over: on to where they end
                end = at + BLOCK
                while end < len(text) and not starts_anew(text[end]):
                    end += 1
            yield text[at:end]
            at = end
        yield text[at:]

    def plain(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of text without added tokens, a few at a time."""
        if len(text) <= BLOCK:
            yield self.whole(self.normal(text))
            return
        rest = ""  # what may go on in the next block
        stream = (self.normal(b) for b in self.blocks(text))
        for block in stream:
            rest += block
            last = max(rest.rfind(" "), rest.rfind("\n"))
            if last < 0:
                last = max((m.start() for m in self.space.finditer(rest)), default=-1)
            if last >= 0:
                yield self.whole(rest[:last])
                rest = rest[last + 1 :]
            if len(rest) > BLOCK:
                rest = yield from self.unbroken(rest, stream)
        yield self.whole(rest)

    def whole(self, low: str) -> tuple[int, ...]:
        """Ids of normal text, about a block at most, at whose ends pieces end."""
        seen = self.seen
        chunks = self.space.split(low) if any(map(low.__contains__, ODD)) else low.split()
        out = list(map(seen.young.get, chunks))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            c = chunks[k]
            out[k] = (seen.young.get(c) or seen.keep(c, self.chunk)) if c else ()
        return tuple(chain.from_iterable(out))

    def unbroken(self, text: str, stream: Iterator[str]) -> Iterator[tuple[int, ...]]:
        """Ids of the pieces of normal text that goes on in the stream without white space; returns what follows them, from the first white space on."""
        at = 0
        while True:
            if len(text) - at < BEGINNING and (more := next(stream, "")):
                text, at = text[at:] + more, 0
                continue
            if at == len(text) or self.space.match(text, at):
                return text[at:]
            m = self.pieces.match(text, at)
            if m.end() < len(text) or self.number.match(m[0]):
                yield self.known.keep(m[0], self.piece)
                at = m.end()
                continue
            more = self.letters if self.letters.match(m[0])[0] else self.signs
            state = [m[0], ""]  # symbols of the piece so far; what comes after it

            def symbols() -> Iterator[str]:
                held = self.bytes_of(state[0])
                while block := next(stream, ""):
                    end = more.match(block).end()
                    yield from held[:-1]
                    held = held[-1] + self.bytes_of(block[:end])
                    if end < len(block):
                        state[1] = block[end:]
                        break
                yield from held[:-1]
                yield held[-1] + self.suffix

            ids = self.machine.run(symbols())
            while part := tuple(islice(ids, TOGETHER)):
                yield part
            text, at = state[1], 0

    def ids(self, text: str | None) -> Iterator[tuple[int, ...]]:
        """The ids of a text, a few at a time."""
        text, at = text or "", 0
        for m in self.splits.finditer(text) if self.added else ():
            yield from self.plain(text[at : m.start()])
            yield (self.added[m[0]],)
            at = m.end()
        yield from self.plain(text[at:] if at else text)

    def together(self, text: str | None) -> Iterator[list[int]]:
        """The same, about TOGETHER at a time."""
        flat = chain.from_iterable(self.ids(text))
        while some := list(islice(flat, TOGETHER)):
            yield some

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.ids(text)))

    def text(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """What ids stand for, as far as it is certain after each few of them."""
        machine, shown = Decoder(self.decoder), self.shown.__getitem__
        for some in ids:
            yield machine.feed(list(map(shown, some)))
        yield machine.finish()

    def decode(self, ids: list[int]) -> str:
        return "".join(self.text([ids]))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of the ids joined by a space, digest of the decoded text: nothing is held but what is in work."""
        n, numbers, back, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self.decoder)
        decimal, shown = self.decimal.__getitem__, self.shown.__getitem__
        for some in self.together(text):
            numbers.update(((" " if n else "") + " ".join(map(decimal, some))).encode())
            back.update(machine.feed(list(map(shown, some))).encode())
            n += len(some)
        back.update(machine.finish().encode())
        return n, numbers.hexdigest(), back.hexdigest()

    def clear(self) -> None:
        self.seen.clear()
        self.known.clear()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, one in each worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for b in batches:
            ids = [c.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        c.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text that ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for b in batches:
            texts = [c.decode(i.as_py() or []) for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text decoded from them, in one pass: neither is ever held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for b in batches:
            got = list(zip(*(c.digests(t.as_py()) for t in b.column(1)))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got[0], pa.int64()), pa.array(got[1], pa.string()), pa.array(got[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.clear()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
