import hashlib
import json
import random
import subprocess
import sys
import time
import unicodedata
from itertools import pairwise

import pytest
import tokenizers

from amperia.llm.bpe import Codec, Decoder, byte_symbols, decode, default_path, encode, op3_bpe, starts_anew
from amperia.llm.common import documents

WORDS = ["it's", "don’t", "naïve", "İstanbul", "ΣΟΦΟΣ", "STRASSE", "ß", "1234567890", "３４", "😀👍🏽", "é", "ẛ̣", "ﬁ", "汉字漢字", "한국어", "<|startoftext|>", "<|endoftext|>", "<|endoftext|", "a<|endoftext|>b", " ", " ", "\x1c", "\x85", "​", "!!!", "...'s", "'S", "'re", "x" * 50, "_", "\x00", "�", "٣", "ाि", "\n", "\r\n", "\t"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(default_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return Codec(default_path())


def test_odd_texts_as_the_library(library, own):
    r = random.Random(1)
    texts = ["", " ", *WORDS, *("".join(r.choice(WORDS) + r.choice(["", " ", "  "]) for _ in range(r.randint(1, 40))) for _ in range(400))]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(128, 0x2000), r.randrange(0x3000, 0xD800), r.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(300)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want, t
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_pieces_longer_than_the_buffer(library, own):
    """Pieces that leave the transducer in several goes."""
    r = random.Random(2)
    common = [t.removesuffix("</w>") for t in library.get_vocab() if t.isascii() and t.removesuffix("</w>").isalpha()]
    assert own.machine.lookahead is not None
    for n in (300, 700, 3000):
        for letters in ("a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz"):
            t = "".join(r.choice(letters) for _ in range(n))
            assert own.encode(t) == library.encode(t, add_special_tokens=False).ids
        t = "".join(r.choice(common) for _ in range(n // 4)).lower()
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids


def test_memory_of_the_transducer_is_bounded(own):
    seen, most = 0, 0

    def letters():
        nonlocal seen
        for k in range(20_000):
            seen += 1
            yield "abcdefgh"[k * k % 8]

    emitted = 0
    for i in own.machine.run(letters()):
        emitted += own.machine.length(own.token[i])
        most = max(most, seen - emitted)
    assert most <= own.machine.lookahead + 1024 + 540


def test_every_code_point_as_the_library(library, own):
    points = [k for k in range(sys.maxunicode + 1) if not 0xD800 <= k <= 0xDFFF]
    for at in range(0, len(points), 512):
        t = " ".join(f"a{chr(k)}{chr(k)}b" for k in points[at : at + 512])
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids, hex(points[at])


def test_sequences_of_marks_as_the_library(library, own):
    """Every mark beside marks of each class, in both orders, and random sequences of marks of all kinds."""
    marks = [chr(k) for k in range(sys.maxunicode + 1) if unicodedata.combining(chr(k))]
    by_class = list({unicodedata.combining(m): m for m in reversed(marks)}.values())
    texts = [f"a{m}{n} e{n}{m} {m}{n}" for m in marks for n in by_class]
    parts = (unicodedata.decomposition(chr(k)).split() for k in range(sys.maxunicode + 1))
    texts += ["".join(chr(int(x, 16)) for x in p) for p in parts if len(p) == 2 and p[0][0] != "<"]
    r = random.Random(6)
    texts += ["".join(r.choice(["a", "E", "ệ", "한", "ᄒ", "ᅡ", "ά"]) + "".join(r.choices(marks, k=r.randint(0, 5))) for _ in range(6)) for _ in range(20_000)]
    for at in range(0, len(texts), 64):
        t = " ".join(texts[at : at + 64])
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids, ascii(texts[at])


def test_composition_never_reaches_over_what_starts_anew():
    """Every second part of a composition is a character at which no block begins."""
    for k in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(k)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            assert not starts_anew(chr(int(parts[1], 16)))
    assert not any(starts_anew(chr(k)) for k in (*range(0x1160, 0x1200), 0x301, 0x9BE))


def test_texts_of_many_blocks_as_the_library(library, own, monkeypatch):
    monkeypatch.setattr("amperia.llm.bpe.BLOCK", 64)
    r = random.Random(3)
    long = [*WORDS, "e" + "\u0301" * 90, "abc" * 40, "!" * 70, "7" * 30, "'" * 3, "''s", "한국" * 40, "е" * 200, "\u3000", "\u2003", "ÀÉ" * 30]
    for _ in range(800):
        t = "".join(r.choice(long) + r.choice(["", "", "", " "]) for _ in range(r.randint(1, 60)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert own.digests(t) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_what_is_remembered_is_bounded(own, monkeypatch):
    monkeypatch.setattr("amperia.llm.bpe.REMEMBERED", 100)
    own.clear()
    for k in range(3000):
        own.encode(f"word{k} {'x' * 300}{k}")
    for held in (own.seen, own.known):
        assert len(held.young) <= 100 and len(held.old) <= 100 and all(len(x) <= 48 for x in (*held.young, *held.old))
    own.clear()
    assert not own.seen.young and not own.known.old


@pytest.mark.parametrize("unit", ["the quick brown fox, it's 12 o'clock; ", "abcdefgh", "ab1!", "ё"], ids=["words", "one piece", "no space", "two bytes"])
def test_memory_does_not_grow_with_a_text(unit):
    """Digests of texts of 128 and 512 KB, in a process of its own: what is held beside the text is the same."""
    code = f"""
import tracemalloc
from amperia.llm.bpe import Codec, default_path
c = Codec(default_path())
c.digests({unit!r} * (100_000 // len({unit!r})))
tracemalloc.start()
peaks = []
for size in (1 << 17, 1 << 19):
    t = {unit!r} * (size // len({unit!r}))
    tracemalloc.reset_peak(); held = tracemalloc.get_traced_memory()[0]
    c.digests(t)
    peaks.append(tracemalloc.get_traced_memory()[1] - held)
    del t
print(*peaks)
"""
    small, large = map(int, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout.split())
    assert large < 1.3 * small + (1 << 20) and large < 24 << 20


def test_a_piece_costs_less_than_merges_of_strings(library, own):
    """Ids of pieces that are new, in less than three quarters of the CPU time of the same merges looked up by pairs of strings."""
    model = json.loads(library.to_str())["model"]
    vocab, rank = model["vocab"], {tuple(m): k for k, m in enumerate(model["merges"])}

    def by_strings(piece):
        raw = own.bytes_of(piece)
        s = [*raw[:-1], raw[-1] + own.suffix]
        ranks = [rank.get(p, len(rank)) for p in pairwise(s)]
        while ranks and (k := min(ranks)) != len(rank):
            i = ranks.index(k)
            s[i] += s.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((s[i], s[i + 1]), len(rank))
            if i:
                ranks[i - 1] = rank.get((s[i - 1], s[i]), len(rank))
        return tuple(vocab[t] for t in s)

    r = random.Random(7)
    pieces = ["".join(r.choices(["an", "der", "tion", "é", "the", "s", "ung", "ñ", "lich"], k=r.randint(2, 5))) for _ in range(3000)]
    took = {by_strings: [], own.piece: []}
    for _ in range(7):
        for f, spent in took.items():
            began = time.process_time()
            ids = [f(p) for p in pieces]
            spent.append(time.process_time() - began)
    assert [by_strings(p) for p in pieces] == ids
    assert min(took[own.piece]) < 0.75 * min(took[by_strings]), took


def test_a_byte_decoder_waits_for_the_end_of_a_character():
    symbols = byte_symbols()
    machine, out = Decoder("ByteLevel"), []
    for b in "é한😀x".encode() + b"\xf0\x9f":
        out.append(machine.feed([symbols[b]]))
    assert out == ["", "é", "", "", "한", "", "", "", "😀", "x", "", ""] and machine.finish() == "\ufffd"
    plain = Decoder(None)
    assert plain.feed(["a", "b</w>"]) + plain.feed([]) + plain.feed(["c"]) + plain.finish() == "a b</w> c"


def test_query_over_documents(spark, library):
    docs = documents(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in op3_bpe(docs).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    few = docs.limit(20)
    back = {r.doc_id: r.text for r in decode(encode(few)).collect()}
    assert back == {d: library.decode(library.encode(texts[d] or "", add_special_tokens=False).ids, skip_special_tokens=False) for d in back}
