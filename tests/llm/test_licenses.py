import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest

from amperia.llm.flat import mix, slices, word_hashes
from amperia.llm.license_texts import NOT_LICENSES, TEMPLATES
from amperia.llm.licenses import AT_LEAST, BUCKETS, CONFIRMED, FAMILIES, Classifier, examples, license_spans, op10_licenses, resemblance, sampled_lines
from amperia.llm.licenses import scanned as scanned_text

from .conftest import prose


@pytest.fixture(scope="module")
def scanned(table):
    r = random.Random(1)
    rows = [(d, "\n".join(" ".join(prose(r, 12)) for _ in range(4))) for d in range(60)]
    planted = {}
    for k, (family, texts) in enumerate(sorted(TEMPLATES.items())):
        for j, t in enumerate(texts):
            d = 1000 + 100 * k + j
            before = "été 😀 ".join(prose(r, 10))
            rows.append((d, f"{before}\n{t}\nmore words\n"))
            planted[d] = (family, len(before) + 1, len(before) + 1 + len(t))
    rows += [(5000 + k, t) for k, t in enumerate(NOT_LICENSES)]
    return planted, {r.doc_id: r for r in license_spans(table(rows)).collect()}


def test_planted_templates_are_found_where_they_stand(scanned):
    planted, got = scanned
    right = sum([(x.family, x.start, x.end) for x in got[d].licenses] == [want] for d, want in planted.items())
    print(f"{right} of {len(planted)} templates")
    assert right >= 0.95 * len(planted)


def test_other_paragraphs_are_unknown(scanned):
    planted, got = scanned
    assert [d for d, r in got.items() if d not in planted and r.licenses] == []
    assert all(r.n_paragraphs == 1 for d, r in got.items() if d in planted)


def test_probabilities_hold_on_examples_not_trained_on():
    c = Classifier(*examples())
    assert c.held_out_accuracy > 0.9 and 0.3 <= c.temperature <= 10


def test_a_prediction_needs_its_template():
    assert resemblance("the colour of the sky is blue", "MIT") < 0.3
    assert all(resemblance(t, f) == 1 for f, ts in TEMPLATES.items() for t in ts if len(t.split()) > 2)
    assert FAMILIES[-1] == "unknown"


def test_query_and_empty_texts(table):
    got = {r.doc_id: r for r in op10_licenses(table([(1, None), (2, ""), (3, "x\n\ny"), (4, "Released under the MIT License.\nReleased under the MIT License.")])).collect()}
    assert [(got[d].n_paragraphs, got[d].n_licenses, got[d].families) for d in (1, 2, 3, 4)] == [(0, 0, ""), (0, 0, ""), (2, 0, ""), (1, 1, "MIT")]
    assert got[4].spans == "MIT:0:63"


def wrapped(text, width=40):
    return "\n".join(textwrap.wrap(text, width))


def test_a_wrapped_notice_is_one_paragraph(table):
    rows, want = [], {}
    for k, (family, texts) in enumerate(sorted(TEMPLATES.items())):
        for j, t in enumerate(x for x in texts if len(x) > 120):
            rows.append((100 * k + j, f"Own words of the author stand here first.\n\n{wrapped(t)}  \n \nand some more words after it\n"))
            want[rows[-1][0]] = f"{family}:43:{43 + len(wrapped(t))}"
    got = {r.doc_id: r.spans for r in op10_licenses(table(rows)).collect()}
    assert sum(got[d] == w for d, w in want.items()) >= 0.9 * len(want), (got, want)


def test_scan_as_a_plain_version():
    """Paragraphs, sums of weights, softmax and comparison with templates by loops over words."""
    c, r = Classifier(*examples()), random.Random(4)
    templates = [t for ts in TEMPLATES.values() for t in ts]
    texts = ["", "\n \n", "x"]
    for _ in range(120):
        parts = [r.choice([r.choice(templates), wrapped(r.choice(templates)), " ".join(prose(r, 9)), "", " \t", r.choice(NOT_LICENSES), "É " + r.choice(templates).upper()]) for _ in range(r.randint(1, 7))]
        texts.append("\n".join(parts))

    def hashed(word):
        b = np.frombuffer(word, np.uint8)
        return word_hashes(b, np.array([0]), np.array([len(b)]))

    def probabilities(text):
        signs = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in text.encode())
        h = [hashed(w) for w in signs.split()]
        grams = [*h, *(mix(x * np.uint64(3) ^ y) for x, y in zip(h, h[1:]))]
        z = sum((c.w[int(g[0] % np.uint64(BUCKETS))] for g in grams), np.zeros(len(FAMILIES))) / max(1, len(grams)) ** 0.5 + c.bias
        e = np.exp(z / c.temperature - (z / c.temperature).max())
        return e / e.sum()

    def plain(text):
        out, n, at = [], 0, 0
        for block in re.finditer(r"(?:[^\n]*[^\x20\x09-\x0D][^\n]*(?:\n|\Z))+", text):
            n += 1
            own = block[0].rstrip(" \t\n\x0b\x0c\r")
            p = probabilities(block[0])
            f = FAMILIES[p.argmax()]
            if f != "unknown" and p.max() >= AT_LEAST:
                known = set(re.findall(r"[^\W_]+", " ".join(TEMPLATES[f]).lower()))
                begin, kept = block.start(), own.split("\n")
                strange = lambda line: not (w := re.findall(r"[^\W_]+", line.lower())) or sum(x in known for x in w) < 0.6 * len(w)
                if not all(map(strange, kept)):
                    while strange(kept[0]):
                        begin += len(kept.pop(0)) + 1
                    while strange(kept[-1]):
                        kept.pop()
                own = "\n".join(kept).rstrip(" \t\n\x0b\x0c\r")
                if resemblance(own, f, own=True) >= CONFIRMED:
                    out.append((f, begin, begin + len(own)))
                    continue
            at = block.start()
            for line in block[0].split("\n"):
                p, s = probabilities(line), line.rstrip(" \t\n\x0b\x0c\r")
                f = FAMILIES[p.argmax()]
                if f != "unknown" and p.max() >= AT_LEAST and resemblance(s, f) >= CONFIRMED:
                    out.append((f, at, at + len(s)))
                at += len(line) + 1
        return n, out

    found = 0
    for i, j, data, at in slices(pa.array(texts)):
        n, got = scanned_text(c, data, at)
        for k in range(i, j):
            want = plain(texts[k])
            assert (n[k - i], [(f, s, e) for r_, f, s, e, _ in got if r_ == k - i]) == want, texts[k]
            found += len(want[1])
    assert found > 100


def test_sampled_lines_are_whole_and_bounded(table, monkeypatch):
    rows = [(d, "\n".join(f"line {k} of {d} {'x' * 50}" for k in range(30))) for d in range(40)]
    whole = {x for _, t in rows for x in t.split("\n")}
    got = sampled_lines(table(rows))
    assert sorted(got) == sorted(whole)
    monkeypatch.setattr("amperia.llm.licenses.MOST_CHARS", 6000)
    few = sampled_lines(table(rows))
    assert set(few) <= whole and 60 < len(few) < 110 and sum(map(len, few)) <= 6000
    assert len({x.split()[1] for x in few}) > 20  # at any position
    huge = [*rows, *((1000 + d, "y" * n) for d, n in enumerate((5900, 5999, 6001, 100_000)))]
    some = sampled_lines(table(huge))  # lines that do not fit are passed over
    assert set(some) <= {x for _, t in huge for x in t.split("\n")} and sum(map(len, some)) <= 6000 and sum(map(len, some)) > 5900
