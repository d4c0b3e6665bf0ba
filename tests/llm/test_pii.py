import random
import re
import time

import pytest

from docpipe.llm.pii import find_pii, mask_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def good(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")),
        "card": 13 <= len(digits) <= 19 and luhn(digits),
        "phone": 9 <= len(digits) <= 15,
    }[kind]


def expected(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def base(row):
    return [(s.kind, s.start, s.end) for s in row.pii if s.kind in PATTERNS]


def test_random_texts(documents):
    rng = random.Random(3)
    parts = ["a@b.c", "x.y@z", "@", ".", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "4111 1111 1111 1111", "0", "+", "+49 (30) 123-456", "é", "😀", " ", "-", "\n", "79927398713", "_q@w.e"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for row in find_pii(documents(texts)).collect():
        assert base(row) == expected(row.text), row.text


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("a" * 300_000, []),
        ("1" * 300_000, []),
        ("1 " * 100_000, []),
        ("+1" * 100_000, []),
        ("a@b" + ".c" * 100_000, [("email", 0, 200_003)]),
        ("AB12" * 50_000, []),
        ("1.2.3.4." * 5_000, [("ip", 8 * i, 8 * i + 7) for i in range(5_000)]),
    ],
)
def test_hostile_texts_take_linear_time(documents, text, spans):
    assert base(find_pii(documents([text])).first()) == spans


def test_many_spans(documents):
    text = "x@y.zz " * 3000
    assert base(find_pii(documents([text])).first()) == expected(text)


def test_checksums_and_context(documents):
    texts = ["IBAN DE89370400440532013000.", "DE89370400440532013001", "my SSN: 123-45-6789", "number 123-45-6789", "xDE89370400440532013000"]
    found = {r.text: [(s.kind, s.start, s.end) for s in r.pii if s.kind in ("iban", "ssn")] for r in find_pii(documents(texts)).collect()}
    assert list(found[t] for t in texts) == [[("iban", 5, 27)], [], [("ssn", 8, 19)], [], []]
    scores = {r.text: [s.score for s in r.pii if s.kind == "card"] for r in find_pii(documents(["card 4111111111111111", "4111111111111111"])).collect()}
    assert scores["card 4111111111111111"] > scores["4111111111111111"]


def test_odd_rows_and_masks(odd, none, documents):
    assert all(r.pii == [] for r in find_pii(odd).collect())
    masked = mask_pii(odd)
    assert masked.columns == odd.columns and sorted(map(str, masked.collect())) == sorted(map(str, odd.collect()))
    assert mask_pii(none).count() == 0
    text = "é😀 mail a@b.cc, call +49 30 1234567 or 1.2.3.4!"
    assert mask_pii(documents([text])).first().text == "é😀 mail [EMAIL], call [PHONE] or [IP]!"


def plain_mask(text, spans):
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end, s.kind)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def test_masks_against_a_plain_loop(documents):
    rng = random.Random(11)
    parts = ["a@b.cc", "1.2.3.4", "4111 1111 1111 1111", "+49 (30) 123-4567", "+4111111111111111", "é", "😀", " ", "\n", "word", "x1.2.3.4@w.de", "DE89370400440532013000"]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in [*range(60), 700, 1500, 4000]]
    found = {r.doc_id: plain_mask(r.text, r.pii) for r in find_pii(documents(texts)).collect()}
    assert {r.doc_id: r.text for r in mask_pii(documents(texts)).collect()} == found


def test_masking_many_spans_does_not_grow_with_their_square(documents):
    def seconds(n):
        df = documents(["é x@y.zz " * n]).coalesce(1)
        start = time.perf_counter()
        (row,) = mask_pii(df).collect()
        assert row.text == "é [EMAIL] " * n
        return time.perf_counter() - start

    seconds(1_000)
    few, many = seconds(5_000), seconds(40_000)
    assert many < 24 * few
